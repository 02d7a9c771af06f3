"""From raw texts and metadata to the corpus of single-author separate opinions, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograph.functions.text import MARKERS
from stylograph.operators import curate
from stylograph.schema import DISSENTS, SUBSET


@dataclass(frozen=True)
class Curated:
    """``subset``: all decisions with metadata; ``single``: those with one dissenting author; ``opinions``: their extracted opinions."""

    subset: DataFrame
    single: DataFrame
    opinions: DataFrame

    def report(self) -> DataFrame:
        """Rows before and after extraction, and distinct decisions lost by it."""
        return curate.integrity_report(self.single, self.opinions)

    def lost(self) -> DataFrame:
        """One row: the ids of the lost decisions, sorted, in one text. For reading; its size is that of the lost ids."""
        ids = curate.lost_keys(self.single, self.opinions)
        return ids.agg(F.concat_ws(", ", F.array_sort(F.collect_set("doc_id"))).alias("lost"))


def curate_corpus(texts: DataFrame, meta: DataFrame, markers: Sequence[str] = MARKERS) -> Curated:
    """``texts`` has doc_id and text, ``meta`` the other columns of the corpus; dates may be strings, bad ones become null."""
    dates = [c for c in ("date_decision", "date_submission", "date_publication") if c in meta.columns]
    meta = meta.withColumns({c: F.expr(f"try_to_date(cast(`{c}` as string), 'yyyy-MM-dd')") for c in dates})
    subset = curate.left_join(texts.select("doc_id", "text"), meta).select(*[c for c in SUBSET.fieldNames() if c in {"text", *meta.columns}])
    single = curate.single_author(subset)
    made = curate.extract_opinions(single, markers=markers)
    return Curated(subset, single, made.select(*[c for c in DISSENTS.fieldNames() if c in made.columns]))
