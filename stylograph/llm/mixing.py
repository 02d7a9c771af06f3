"""Mixing sources to target weights (problem 7).

Shares are of tokens. The mixture is as long as the scarcest source allows under its cap. Each source becomes a stream: its
documents in the order of a hash, over and over, at most ``max_repeats`` times; a document's place in the stream comes from running
sums at two levels, of buckets and within a bucket, so that no task sees a whole source. The streams are cut into quanta of equal
tokens. Quantum i of a source of weight w may run from slot floor(i / w) and has to by slot ceil((i + 1) / w); of the released ones
that of the earliest deadline takes the slot. By the theory of proportionate fairness no source is then ever a whole quantum ahead of
its share or behind it.

Slots come in cycles of a fixed number, which tasks schedule on their own: at the end of each cycle the sources have their shares rounded
by the largest remainders, less than a quantum off; so within it they are less than two quanta off. Documents are whole and belong to
the quantum of their middle, which adds half a document for each source. A block is what covers both, so that at any point of the
mixture no source is a whole block off its share of what is placed. It is BLOCK tokens, however large the corpus, and more only where
documents are so long that it has to be.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stylograph.llm.tokenize import VOCABULARY, token_counts
from stylograph.session import checkpoint

#: Tokens that a source may be off its share.
BLOCK = 1 << 16
#: Slots that are scheduled together.
CYCLE = 4096
#: Documents of a source whose running sum is made in one task.
BUCKET = 50_000
#: Most sources that targets may name; they are settings, and are read by the driver.
MAX_SOURCES = 10_000


def schedule(need: dict[str, int], block: int) -> list[tuple[str, int]]:
    """(source, block number) for each slot in turn, for streams of the given numbers of tokens; earliest deadline first."""
    total = sum(need.values())
    left = {s: -(-n // block) for s, n in need.items() if n > 0}
    waiting: list[tuple[int, str, int]] = [(0, s, 0) for s in sorted(left)]
    ready: list[tuple[int, str, int]] = []
    out: list[tuple[str, int]] = []
    slot = 0
    while waiting or ready:
        if not ready and waiting[0][0] > slot:
            slot = waiting[0][0]
        while waiting and waiting[0][0] <= slot:
            _, s, i = heappop(waiting)
            heappush(ready, (-(-(i + 1) * total // need[s]), s, i))
        _, s, i = heappop(ready)
        out.append((s, i))
        slot += 1
        if i + 1 < left[s]:
            heappush(waiting, ((i + 1) * total // need[s], s, i + 1))
    return out


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, int]:
    """Tokens to take of each source that has both tokens and a target; their shares are scaled to one."""
    both = {s: (w, cap) for s, (w, cap) in targets.items() if sizes.get(s, 0) > 0 and w > 0 and cap > 0}
    weight = sum(w for w, _ in both.values())
    if not both:
        return {}
    total = min(cap * sizes[s] * weight / w for s, (w, cap) in both.items())
    return {s: min(cap * sizes[s], round(total * w / weight)) for s, (w, cap) in both.items()}


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("cap")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have targets")
    return {r["source"]: (float(r["w"] or 0), int(r["cap"] or 0)) for r in rows}


@dataclass(frozen=True)
class Layout:
    """Tokens to take of each source; the sizes of a block, a quantum and a cycle; the number of cycles."""

    need: dict[str, int]
    block: int
    quantum: int
    cycle: int
    cycles: int


def layout(sizes: dict[str, int], longest: int, targets: dict[str, tuple[float, int]], block: int = BLOCK, cycle: int = CYCLE) -> Layout | None:
    """How to mix sources of the given tokens, or None where there is nothing to mix. ``longest``: tokens of the longest document.

    Two quanta, and half a longest document for each source, make a block.
    """
    need = plan(sizes, targets)
    if not need:
        return None
    edges = -(-longest * len(need) // 2)
    block = max(block, 2 * edges)
    quantum = max(1, (block - edges) // 2)
    total, least = sum(need.values()), max(1, min(need.values()))
    cycle = max(cycle, -(-total // least))  # every source has a quantum or more a cycle
    return Layout(need, block, quantum, cycle, -(-(-(-total // quantum) + -(-total // least)) // cycle))


def _shared_out(need: dict[str, int], slots: int) -> dict[str, int]:
    """``slots`` dealt by weight, whole ones, the rest by the largest remainders."""
    total = sum(need.values())
    out = {s: n * slots // total for s, n in need.items()}
    rest = sorted(need, key=lambda s: (-(need[s] * slots % total), s))
    for s in rest[: slots - sum(out.values())]:
        out[s] += 1
    return out


def turns_of(lay: Layout, cycle: int) -> list[tuple[str, int, int]]:
    """(source, quantum, slot) of one cycle."""
    begin, end = (_shared_out(lay.need, c * lay.cycle) for c in (cycle, cycle + 1))
    own = {s: end[s] - begin[s] for s in lay.need}
    return [(s, begin[s] + i, cycle * lay.cycle + slot) for slot, (s, i) in enumerate(schedule(own, 1))]


MIX = "doc_id bigint, source string, copy int, n_tokens bigint, slot bigint, place bigint"


def sized(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens of the documents that have tokens and a source with a target, written once."""
    wanted = docs.where(F.col("source").isin([s for s, (w, cap) in _targets(targets).items() if w > 0 and cap > 0]))
    return checkpoint(token_counts(wanted, [F.col("doc_id").cast("bigint").alias("doc_id"), "source"], path).where(F.col("n_tokens") > 0))


def layout_of(made: DataFrame, targets: DataFrame, block: int = BLOCK, cycle: int = CYCLE) -> Layout | None:
    """The layout of what ``sized`` gives."""
    rows = made.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("longest")).collect()  # one row a target
    return layout({r["source"]: r["n"] for r in rows}, max((r["longest"] for r in rows), default=0), _targets(targets), block, cycle)


def mix(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """doc_id, source, copy (from 1), n_tokens, slot, place: the mixture in the order of (slot, place).

    ``docs`` has doc_id, text, source; ``targets`` has source, target_share, max_repeats, of repeated rows the greatest counts. Documents
    without a source that has a target, and those without tokens, are in no mixture. Repeated rows are documents of their own. A source is
    off its share by half a document at the end, as documents are not cut. Nothing to mix gives no rows.
    """
    return mix_sized(sized(docs, targets, path), targets, block, seed)


def mix_sized(made: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = 7, cycle: int = CYCLE, bucket: int = BUCKET) -> DataFrame:
    """``mix`` of documents whose tokens ``sized`` has counted. ``cycle`` and ``bucket`` bound what a task does."""
    spark = made.sparkSession
    lay = layout_of(made, targets, block, cycle)
    if lay is None:
        return spark.createDataFrame([], MIX)
    sizes = made.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.ceil(F.count(F.lit(1)) / bucket).alias("buckets"))
    wanted = spark.createDataFrame(sorted(lay.need.items()), "source string, need bigint")
    goal = F.broadcast(sizes.join(F.broadcast(wanted), "source"))  # MAX_SOURCES rows at most
    keyed = made.join(goal, "source").withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod("h", F.col("buckets")))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("base"))  # a row for each ``bucket`` documents
    within = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1))
    placed = keyed.withColumn("start", F.coalesce(within, F.lit(0))).join(starts, ["source", "bucket"])
    first = F.col("base") + F.col("start")
    times = F.greatest(F.lit(0), F.ceil((2 * (F.col("need") - first) - F.col("n_tokens")) / (2 * F.col("size")))).cast("int")
    copies = placed.withColumn("first", first).withColumn("times", times).where(F.col("times") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    stream = copies.withColumn("place", F.col("first") + (F.col("copy") - 1) * F.col("size"))
    stream = stream.withColumn("quantum", F.expr(f"(2 * place + n_tokens) div {2 * lay.quantum}"))
    return stream.join(_turns(spark, lay), ["source", "quantum"]).select("doc_id", "source", "copy", "n_tokens", "slot", "place")


def _turns(spark: SparkSession, lay: Layout) -> DataFrame:
    """source, quantum, slot: the whole schedule, each cycle made by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in pdf["id"]:
                yield pd.DataFrame(turns_of(lay, c), columns=["source", "quantum", "slot"])

    return spark.range(lay.cycles).mapInPandas(run, "source string, quantum bigint, slot bigint")


def shares(mixed: DataFrame, targets: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """source, target_share, n_rows, n_tokens, actual_share, most_copies for each source with a target; 0 for one that has no documents.

    With ``made``, what ``sized`` gives, also n_left_out: tokens of the source's documents that are not in the mixture at all.
    """
    used = F.sum(F.when(F.col("copy") == 1, F.col("n_tokens")))
    by = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens"), F.max("copy").alias("most_copies"), used.alias("used"))
    total = by.agg(F.sum("n_tokens").alias("total"))
    goals = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"))
    out = goals.join(by, "source", "left").crossJoin(F.broadcast(total))  # one row
    share = F.coalesce(F.col("n_tokens") / F.nullif("total", F.lit(0)), F.lit(0.0))
    more = []
    if made is not None:
        out = out.join(made.groupBy("source").agg(F.sum("n_tokens").alias("held")), "source", "left")
        more = [(F.coalesce("held", F.lit(0)) - F.coalesce("used", F.lit(0))).alias("n_left_out")]
    return out.select("source", "target_share", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_tokens", "most_copies")], F.round(share, 6).alias("actual_share"), *more)


def deviations(mixed: DataFrame, lay: Layout) -> DataFrame:
    """source, most_ahead, most_behind, block: by how many tokens each source of the mixture is off its share of what is placed, at the
    end of any slot. Both are below ``block``. No mixture gives no rows."""
    total = sum(lay.need.values())
    names = sorted(lay.need)
    weight = np.array([lay.need[s] / total for s in names])
    slots = mixed.groupBy("slot", "source").agg(F.sum("n_tokens").alias("n")).withColumn("cycle", F.expr(f"slot div {lay.cycle}"))
    sums = slots.groupBy("cycle").agg(*[F.coalesce(F.sum(F.when(F.col("source") == s, F.col("n"))), F.lit(0)).alias(f"b{i}") for i, s in enumerate(names)])
    so_far = Window.orderBy("cycle").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cycle, which stands for thousands of documents
    base = sums.select("cycle", F.array(*[F.coalesce(F.sum(f"b{i}").over(so_far), F.lit(0)) for i in range(len(names))]).alias("base"))

    def off(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        gone = np.zeros((len(pdf) + 1, len(names)))
        gone[0] = pdf["base"].iloc[0]
        gone[np.arange(1, len(pdf) + 1), [names.index(s) for s in pdf["source"]]] = pdf["n"]
        gone = np.cumsum(gone, axis=0)
        lag = gone - gone.sum(1, keepdims=True) * weight
        return pd.DataFrame({"source": names, "ahead": lag.max(0), "behind": -lag.min(0)})

    by_cycle = slots.join(base, "cycle").groupBy("cycle").applyInPandas(off, "source string, ahead double, behind double")
    return by_cycle.groupBy("source").agg(F.round(F.max("ahead"), 3).alias("most_ahead"), F.round(F.max("behind"), 3).alias("most_behind"), F.lit(lay.block).alias("block"))
