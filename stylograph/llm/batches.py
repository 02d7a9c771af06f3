"""Arrow batches for Python operators on text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points that an operator works on at once; one longer text is a piece of its own.
PIECE = 1 << 20
NO_TEXT = ("", "NA")


def pieces(texts: list[str], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` code points each, so that memory depends neither on the batch nor on its mean length."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, setup: Callable[[], None] | None = None) -> DataFrame:
    """``work`` over each Arrow batch of ``df``; it yields batches of ``schema``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


def present(c: str) -> Column:
    """The column without the strings that stand for a missing value."""
    return F.when(~F.col(c).isin(*NO_TEXT), F.col(c))


def court_texts(subset: DataFrame, dissents: DataFrame) -> DataFrame:
    """field, doc_id, text of the decisions and the extracted opinions; rows without doc_id or text are left out, repeated rows stay."""

    def one(df: DataFrame, column: str, field: str) -> DataFrame:
        return df.select(F.lit(field).alias("field"), present("doc_id").alias("doc_id"), present(column).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())

    return one(subset, "text", "subset.text").unionByName(one(dissents, "separate_opinion_extracted", "subset_disent2.separate_opinion_extracted"))
