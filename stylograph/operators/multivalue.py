"""Several values packed in one field: one row for each value, with its place (problem 4).

A cell is a lattice: its nodes are the places between candidate delimiters, its edges the pieces between two nodes. Quoted spans
are atomic. Expectation maximisation over the whole column learns how frequent each piece is as a value; a cell never counts as
evidence for itself, else the best model would be to keep every cell whole. A true value is now and then seen alone, quoted, or
both first and last in a cell; a piece that is not, such as the degree behind a name, gets little weight however frequent. Viterbi then takes the likeliest path. Only distinct
cells are worked on, so that a cell that fills a third of the table is one row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograph.session import checkpoint

BLANK = r"[^\S\r\n]"
DELIMITER = re.compile(r"\s*[,;|/\t\r\n](?:\s*[,;|/\t\r\n])*\s*|\s+(?:a|and|und|et|-)\s+")
R_VECTOR = re.compile(r"(?s)c\s*\(\s*(?=[\"']|NA\b)(.*)\)")
BRACKETS = re.compile(r"(?s)\[(.*)\]")
QUOTES = "\"'"
NO_VALUE = ("", "NA")
INNER, SURE, FIRST, LAST = range(4)


@dataclass(frozen=True)
class Model:
    """Parameters. ``inner``: delimiters that one unquoted value may hold, or None for any number, which makes the lattice of a cell as
    large as the square of its elements; ``weight``: of the base measure, in cells; ``new``: the base
    measure of a piece, and ``inside``: the factor for each delimiter in it, so that unknown text is cut rather than kept; ``doubt``:
    the count that a piece without standing of its own can reach."""

    inner: int | None = 32
    iterations: int = 4
    weight: float = 1.0
    new: float = 1e-3
    inside: float = 1e-4
    doubt: float = 0.01


def _quoted_end(s: str, i: int) -> int:
    """End of the quoted span that opens at i, behind its closing quote, or -1. Doubled and backslashed quotes do not close."""
    q, j = s[i], i + 1
    while j < len(s):
        if s[j] == "\\" and j + 1 < len(s):
            j += 2
        elif s[j] == q and s[j + 1 : j + 2] == q:
            j += 2
        elif s[j] == q:
            return j + 1
        else:
            j += 1
    return -1


def _unquote(piece: str) -> str:
    q = piece[0]
    body = piece[1:-1].replace(q + q, q)
    return re.sub(r"\\(.)", r"\1", body).strip()


def lattice(cell: str, inner: int | None = 32) -> tuple[int, list[tuple[int, int, str, int]]]:
    """Number of nodes, and edges (from, to, value, delimiters inside, standing). Pieces without a value are edges of value ''.

    Standing says what the edge is evidence of: SURE (a quoted element, or all of a cell without delimiters), FIRST or LAST of
    several elements, or INNER.
    """
    s = cell.strip()
    m = R_VECTOR.fullmatch(s) or BRACKETS.fullmatch(s)
    if m:
        s = m.group(1).strip()
    cuts: list[tuple[int, int]] = []  # delimiters outside quotes
    atoms: dict[int, str] = {}  # start of an element that is one quoted span
    i, start, n = 0, True, len(s)
    while i < n:
        if start and s[i] in QUOTES:
            end = _quoted_end(s, i)
            if end > 0 and (end == n or DELIMITER.match(s, end) or not s[end:].strip()):
                atoms[i] = _unquote(s[i:end])
                i, start = end, False
                continue
        if s[i] == '"':  # a quotation inside a value keeps its delimiters
            end = _quoted_end(s, i)
            if end > 0:
                i, start = end, False
                continue
        d = DELIMITER.match(s, i)
        if d and d.end() > i:
            cuts.append((i, d.end()))
            i, start = d.end(), True
            continue
        i, start = i + 1, False
    begins, ends = [0, *[b for _, b in cuts]], [*[a for a, _ in cuts], n]
    edges = []
    for a in range(len(begins)):
        for b in range(a, len(begins) if inner is None else min(len(begins), a + inner + 1)):
            if b > a and (begins[a] in atoms or begins[b] in atoms):
                break  # a quoted element joins no other
            text = atoms.get(begins[a]) if begins[a] in atoms else s[begins[a] : ends[b]].strip()
            if b > a and (text in NO_VALUE or begins[b] == ends[b] or begins[a] == ends[a]):
                continue  # an empty element joins no other
            sure = begins[a] in atoms or len(begins) == 1
            first, last = a == 0, b == len(begins) - 1
            standing = SURE if sure else INNER if first == last else FIRST if first else LAST
            edges.append((a, b + 1, "" if text in NO_VALUE else text, b - a, standing))
    return len(begins) + 1, edges


def _score(value: str, inside: int, n: float, total: float, m: Model) -> float:
    if not value:
        return 0.0
    return math.log((max(n, 0.0) + m.weight * m.new * m.inside**inside) / (total + m.weight))


def _sum(x: list[float]) -> float:
    top = max(x)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in x))


def expected(nodes: int, edges: list, logp: list[float]) -> list[float]:
    """How often each edge is used, on average over all paths by their probability."""
    into: list[list[int]] = [[] for _ in range(nodes)]
    out: list[list[int]] = [[] for _ in range(nodes)]
    for k, e in enumerate(edges):
        out[e[0]].append(k)
        into[e[1]].append(k)
    fore, back = [-math.inf] * nodes, [-math.inf] * nodes
    fore[0] = back[-1] = 0.0
    for v in range(1, nodes):
        if into[v]:
            fore[v] = _sum([fore[edges[k][0]] + logp[k] for k in into[v]])
    for v in range(nodes - 2, -1, -1):
        if out[v]:
            back[v] = _sum([back[edges[k][1]] + logp[k] for k in out[v]])
    return [math.exp(fore[e[0]] + p + back[e[1]] - fore[-1]) for e, p in zip(edges, logp, strict=True)]


def viterbi(nodes: int, edges: list, logp: list[float]) -> list[str]:
    """The values on the likeliest path; of equal paths the one that cuts first."""
    best, came = [-math.inf] * nodes, [-1] * nodes
    best[0] = 0.0
    for k in sorted(range(len(edges)), key=lambda k: (edges[k][1], -edges[k][0])):
        a, b = edges[k][0], edges[k][1]
        if best[a] + logp[k] > best[b]:
            best[b], came[b] = best[a] + logp[k], k
    values, v = [], nodes - 1
    while v > 0 and came[v] >= 0:
        values.append(edges[came[v]][2])
        v = edges[came[v]][0]
    return [x for x in reversed(values) if x]


CELLS = "field string, cell string, seg array<string>, e array<double>, standing array<int>"


def _state(pdf: pd.DataFrame, lattices: list, es: list) -> pd.DataFrame:
    return pd.DataFrame({"field": pdf["field"], "cell": pdf["cell"], "seg": [[x[2] for x in edges] for _, edges in lattices], "e": es, "standing": [[x[4] for x in edges] for _, edges in lattices]})


def _start(m: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lattices = [lattice(cell, m.inner) for cell in pdf["cell"]]
            yield _state(pdf, lattices, [expected(n, edges, [_score(x[2], x[3], 0.0, 1.0, m) for x in edges]) for n, edges in lattices])

    return run


def _with_counts(cells: DataFrame) -> DataFrame:
    """Adds n, the column's count of each edge's value, sure and ends, what of it has standing, and total, the count of all values of the field."""
    long = cells.select("field", "cell", F.posexplode(F.arrays_zip("seg", "e", "standing")).alias("k", "x")).select("field", "cell", "k", "x.seg", "x.e", "x.standing")
    own = F.when(F.col("seg") == "", F.concat(F.lit("\0"), "cell")).otherwise(F.col("seg"))  # empty pieces have no count, and go to no common task to learn so
    seen = lambda kind: F.sum(F.when(F.col("standing") == kind, F.col("e")).otherwise(0.0))
    counts = long.where(F.col("seg") != "").groupBy("field", "seg").agg(F.sum("e").alias("n"), seen(SURE).alias("sure"), (2 * F.least(seen(FIRST), seen(LAST))).alias("ends"))
    totals = counts.groupBy("field").agg(F.sum("n").alias("total"))
    joined = long.withColumn("seg", own).join(counts, ["field", "seg"], "left")
    facts = F.struct("k", "e", F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("sure", F.lit(0.0)).alias("sure"), F.coalesce("ends", F.lit(0.0)).alias("ends"))
    back = joined.groupBy("field", "cell").agg(F.array_sort(F.collect_list(facts)).alias("a"))  # the edges of one cell
    columns = [F.col(f"a.{c}").alias(c) for c in ("e", "n", "sure", "ends")]
    return back.join(F.broadcast(totals), "field", "left").select("field", "cell", *columns, F.coalesce("total", F.lit(0.0)).alias("total"))  # one row a field


def _facts(pdf: pd.DataFrame) -> Iterator[tuple]:
    return zip(pdf["e"], pdf["n"], pdf["sure"], pdf["ends"], pdf["total"], strict=True)


def _logp(edges: list, e, n, sure, ends, total: float, m: Model) -> list[float]:
    """Scores of the edges from the counts that other cells give. For a piece with delimiters inside, only sure sights are standing:
    first and last it may be by its parts."""
    mine: dict[str, float] = {}
    for x, edge in zip(e, edges, strict=True):
        mine[edge[2]] = mine.get(edge[2], 0.0) + x
    rest = max(total - sum(x for v, x in mine.items() if v), 0.0)
    out = []
    for edge, count, alone, both in zip(edges, n, sure, ends, strict=True):
        stands = alone + (0.0 if edge[3] else both)
        others = max(count - mine[edge[2]], 0.0)
        trust = min(1.0, (stands + m.doubt) / (count + m.doubt))
        out.append(_score(edge[2], edge[3], others * trust, rest, m))
    return out


def _step(m: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lattices = [lattice(cell, m.inner) for cell in pdf["cell"]]
            es = [expected(nodes, edges, _logp(edges, *x, m)) for (nodes, edges), x in zip(lattices, _facts(pdf), strict=True)]
            yield _state(pdf, lattices, es)

    return run


def _decode(m: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lattices = [lattice(cell, m.inner) for cell in pdf["cell"]]
            vals = [viterbi(nodes, edges, _logp(edges, *x, m)) for (nodes, edges), x in zip(lattices, _facts(pdf), strict=True)]
            yield pd.DataFrame({"field": pdf["field"], "cell": pdf["cell"], "vals": vals})

    return run


def segment_cells(cells: DataFrame, model: Model = Model()) -> DataFrame:
    """field, cell, vals: the values of each distinct cell in their order; cells without a value give an empty array.

    ``cells`` has field and cell. Null, empty and 'NA' cells give no row.
    """
    kinds = cells.select("field", "cell").where(~F.col("cell").isin(*NO_VALUE)).distinct()
    state = checkpoint(kinds.mapInPandas(_start(model), CELLS))
    for _ in range(model.iterations):
        state = checkpoint(_with_counts(state).mapInPandas(_step(model), CELLS))
    return _with_counts(state).mapInPandas(_decode(model), "field string, cell string, vals array<string>")


def split_values(df: DataFrame, fields: list[str], key: str = "doc_id", model: Model = Model()) -> DataFrame:
    """field, key, pos from 1, val, n (values of the cell): one row for each value of each cell; repeated rows of a key count once.

    Rows without a key, and cells without a value, give no row; empty and 'NA' elements take no place. Values have no quotes, escapes
    and outer blanks. Other columns are not read. Each distinct cell is joined to its rows once; where one fills much of the table, adaptive
    execution splits its rows.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("cell")) for f in fields])).alias("x")
    rows = df.select(F.col(key), pairs).select(key, "x.field", "x.cell").where(F.col(key).isNotNull() & ~F.col(key).cast("string").isin(*NO_VALUE) & F.col("cell").isNotNull()).dropDuplicates([key, "field", "cell"])
    done = segment_cells(rows, model).where(F.size("vals") > 0)
    joined = rows.join(done, ["field", "cell"])
    return joined.select("field", key, F.size("vals").alias("n"), F.posexplode("vals").alias("pos", "val")).select("field", key, (F.col("pos") + 1).cast("bigint").alias("pos"), "val", "n")
