"""Long exact spans that stand in more than one record (problem 3).

A window is ``length`` code points. A position is shared if a window over it stands in the same field of another record too. Suffix
automata find those windows: the texts that may share something are cut into reference shards, each shard's automaton knows for every
substring whether more than one record has it, and the texts are streamed through it for their matching statistics; where these reach
``length``, a shared window ends. ``broadcast_spans`` does just that with shards of the whole corpus, and so passes every text over every
shard. ``shared_spans`` sends a text only to the shards that can match it. Every window is represented by its anchor, the k-gram of
least hash in it: equal windows have equal anchors, and a shard is all stretches of one anchor.

1. Each text gives its anchors, about one in 30 code points. Sorted by hash, those of two records or more are found in one stream.
2. Only texts with such an anchor go on. The windows of each of their anchors make stretches, which are sent to the anchor's shard.
   There equal stretches are one; those of a single record are streamed through the automaton of all of them.
3. An anchor of very many records, such as a phrase of a third of the corpus, gives a shard for each MOST of them. Such a shard, and one of
   more than SHARD code points, is split by the whole context: its windows become shards of their own. They are put together
   where they stand first, so that a second shuffle carries each window once a shard, and met there by their code points.
4. Runs of shared windows are merged by record.

Texts are compared by their code points wherever a match is found; hashes only choose the shard. No pair of records is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograph.llm.batches import pieces

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Records of an anchor that make one shard.
MOST = 1000
#: Code points of distinct stretches from which one automaton is made: it has two states at most for each.
SHARD = 200_000
#: Windows that are put together before they are shuffled.
HELD = 50_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class Hashed:
    """Code points of several texts in a row, with the hash of any stretch at hand."""

    def __init__(self, texts: list[str]) -> None:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.n = len(codes)
        power, self.back = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(0x51ED2701)) * power[:-1], out=self.sums[1:])

    def stretch(self, length: int) -> np.ndarray:
        """Polynomial hash of the ``length`` code points from each place on, over the borders of texts too."""
        if self.n < length:
            return np.zeros(0, np.uint64)
        return (self.sums[length:] - self.sums[:-length]) * self.back[: self.n - length + 1]

    def inside(self, length: int) -> np.ndarray:
        """Whether ``length`` code points from each place on lie in one text."""
        ok = np.ones(max(0, self.n - length + 1), bool)
        if len(ok):
            edge = np.zeros(len(ok) + 1, np.int32)
            np.add.at(edge, np.minimum(np.maximum(self.ends[:-1] - length + 1, self.begins[:-1]), len(ok)), 1)
            np.add.at(edge, np.minimum(self.ends[:-1], len(ok)), -1)
            ok = np.cumsum(edge[:-1]) == 0
            late = self.ends[-1] - length + 1
            ok[max(late, 0) :] = False
        return ok


def _gram(length: int) -> int:
    return max(1, length * 2 // 5)


def _gram_hashes(text: Hashed, k: int) -> np.ndarray:
    h = _mixed(text.stretch(k))
    h[~text.inside(k)] = _TOP
    return h


def _slide(x: np.ndarray, width: int, better) -> np.ndarray:
    """The best of each ``width`` neighbours, in doubling steps."""
    done, out = 1, x
    while done * 2 <= width:
        out = better(out[:-done], out[done:])
        done *= 2
    if done < width:
        rest = width - done
        out = better(out[:-rest], out[rest:])
    return out


def anchor_places(text: Hashed, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all anchors of windows."""
    k = _gram(length)
    width = length - k + 1
    if text.n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _gram_hashes(text, k)
    least = _slide(h, width, np.minimum)
    reach = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero((_slide(reach, width, np.maximum) == h) & (h != _TOP))
    return at, h[at]


def windows(text: Hashed, length: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash of the anchor) of all windows whose anchor is in the sorted array."""
    k = _gram(length)
    if text.n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    anchor = _slide(_gram_hashes(text, k), length - k + 1, np.minimum)
    at = np.flatnonzero(_in(anchor, known) & text.inside(length))
    return at, anchor[at]


def _in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    found = np.searchsorted(known, x)
    found[found == len(known)] = 0
    return known[found] == x


def _arrow(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _anchors(length: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, keys = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            for a, b in pieces(texts):
                text = Hashed(texts[a:b])
                at, h = anchor_places(text, length)
                doc = keys[a:b][np.searchsorted(text.ends, at, side="right")]
                # a text that repeats an anchor gives it once; fields are kept apart by their hash in the document's key
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([_arrow(h[new]), pa.array(doc[new], pa.int64())], names=["h", "dk"])

    return run


class Met:
    """Takes rows sorted by their first ``columns`` columns, then the next, the record, batch by batch; gives those whose key has two records.

    Rows of a key are held back only while all of them are of one record, so never more than the rows of one text; with ``most`` also
    until it is known whether there are more than so many, and a column ``part`` is added: 0 for keys of no more, else the number, from 1,
    of the row's ``most`` among them.
    """

    def __init__(self, columns: int, most: int | None = None) -> None:
        self.columns, self.most = columns, most
        self.held: pa.RecordBatch | None = None
        self.sure = False  # the held rows' key has two records
        self.before = 0  # rows of that key that have been given

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        if self.held is not None:
            batch = pa.Table.from_batches([self.held, batch]).combine_chunks().to_batches()[0]
        n = batch.num_rows
        changed = lambda c: pc.not_equal(batch.column(c).slice(1), batch.column(c).slice(0, n - 1)).to_numpy(zero_copy_only=False)
        same = np.ones(n - 1, bool)
        for c in range(self.columns):
            same &= ~changed(c)
        group = np.concatenate([[0], np.cumsum(~same)])
        hit = np.zeros(group[-1] + 1, bool)
        hit[group[1:][same & changed(self.columns)]] = True
        hit[0] |= self.sure
        first = np.searchsorted(group, np.arange(group[-1] + 1))
        place = np.arange(n) - first[group]
        place[group == 0] += self.before
        size = np.bincount(group)
        size[0] += self.before
        many = size > self.most if self.most is not None else np.ones(len(size), bool)
        last, out = group[-1], hit[group]
        start = n - 1 if hit[last] and many[last] else int(first[last])
        out[start:] = False
        yield self._give(batch, out, place, many[group])
        self.sure, self.before, self.held = bool(hit[last]), int(place[start]), batch.slice(start, n - start)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held is not None and self.sure:
            n = self.held.num_rows
            many = self.most is None or self.before + n > self.most
            yield self._give(self.held, np.ones(n, bool), self.before + np.arange(n), np.full(n, many))

    def _give(self, batch: pa.RecordBatch, keep: np.ndarray, place: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        out = batch.filter(pa.array(keep))
        if self.most is None:
            return out
        part = np.where(many, place // max(1, self.most) + 1, 0)[keep]
        return pa.RecordBatch.from_arrays([*out.columns, pa.array(part, pa.int64())], names=[*out.schema.names, "part"])


def _met(columns: int, most: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met(columns, most)
        for batch in it:
            yield from met.take(batch)
        yield from met.rest()

    return run


class Automaton:
    """Suffix automaton of several strings, each of one or more records; a state knows the least and the greatest of its records."""

    def __init__(self, strings: dict[str, tuple[str, str]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.low: list[str | None] = [None]
        self.high: list[str | None] = [None]
        for text, (low, high) in strings.items():
            last = 0
            for c in text:
                last = self._extend(last, c)
                if self.low[last] is None:
                    self.low[last], self.high[last] = low, high
                else:
                    self.low[last], self.high[last] = min(self.low[last], low), max(self.high[last], high)
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            p = self.link[v]
            if p > 0:
                self.low[p] = self.low[v] if self.low[p] is None else min(self.low[p], self.low[v])
                self.high[p] = self.high[v] if self.high[p] is None else max(self.high[p], self.high[v])

    def _state(self, size: int, link: int, out: dict[str, int]) -> int:
        self.next.append(out)
        self.link.append(link)
        self.size.append(size)
        self.low.append(None)
        self.high.append(None)
        return len(self.size) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        """A state for what is read up to p and c, of which q also holds longer strings."""
        nxt = self.next
        copy = self._state(self.size[p] + 1, self.link[q], dict(nxt[q]))
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: str) -> int:
        nxt, link, size = self.next, self.link, self.size
        q = nxt[last].get(c)
        if q is not None:
            return q if size[q] == size[last] + 1 else self._split(last, c, q)
        new = self._state(size[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, c, q)
        return new

    def matched(self, text: str, record: str, length: int) -> list[int]:
        """Begins of the windows of ``length`` that another record has, from the matching statistics of ``text``."""
        nxt, link, size, low, high = self.next, self.link, self.size, self.low, self.high
        v, have, out = 0, 0, []
        for i, c in enumerate(text, 1):
            while v and c not in nxt[v]:
                v = link[v]
                have = size[v]
            if c in nxt[v]:
                v = nxt[v][c]
                have += 1
            while v and low[v] == record and high[v] == record:  # no other record has it: a shorter end
                v = link[v]
                have = size[v]
            if have >= length:
                out.append(i - length)
        return out


    def runs(self, text: str, record: str, length: int) -> list[tuple[int, int]]:
        """(begin, end) of the longest runs of those windows."""
        out: list[tuple[int, int]] = []
        for i in self.matched(text, record, length):
            if out and i < out[-1][1]:
                out[-1] = out[-1][0], i + length
            else:
                out.append((i, i + length))
        return out


SENT = "field string, key bigint, part bigint, stretch string, doc_id string, places array<int>"
#: Runs of shared positions, their begin and end in ``places``, or a window and where the record has it; without places it only tells that
#: a record has it.
FOUND = "field string, stretch string, doc_id string, places array<int>"


def _send(length: int):
    """For each text the stretches of its anchors."""
    longest = 8 * length

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(2).to_pylist()
            for a, b in pieces(texts):
                own_anchors = [batch.column(c).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4)]
                known = np.unique(own_anchors[0].view(np.uint64))
                text = Hashed(texts[a:b])
                at, anchor = windows(text, length, known)
                own = np.searchsorted(text.ends, at, side="right")
                new = np.ones(len(at), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
                begin = np.flatnonzero(new)
                run_at = at - at[begin][np.cumsum(new) - 1] if len(at) else at
                new |= run_at % longest == 0  # a run that does not end, as of one letter, goes in several stretches
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at))[: len(first)] - 1
                # of its own anchors the record knows the part of the shard; those of the batch's other records may be among the windows
                parts = [dict(zip(h.as_py() or (), p.as_py() or (), strict=True)) for h, p in zip(batch.column(3).slice(a, b - a), batch.column(4).slice(a, b - a), strict=True)]
                cells: dict[tuple[int, int, int, str], list[int]] = {}
                signed = anchor.view(np.int64)
                for o, h, i, j in zip(own[first].tolist(), signed[first].tolist(), at[first].tolist(), at[last].tolist(), strict=True):
                    part = parts[o].get(h)
                    if part is not None:
                        start = i - int(text.begins[o])
                        cells.setdefault((o, h, part, texts[a + o][start : start + j - i + length]), []).append(start)
                if cells:
                    who, h, part, cut = zip(*cells, strict=True)
                    take = pa.array(np.array(who, np.int64) + a)
                    key = _mixed(np.array(h, np.int64).view(np.uint64) + np.array(part, np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), _arrow(key), pa.array(part, pa.int64()), pa.array(cut, pa.string()), batch.column(1).take(take), pa.array(list(cells.values()), pa.list_(pa.int32()))],
                        names=["field", "key", "part", "stretch", "doc_id", "places"],
                    )

    return run


class Shards:
    """Takes the rows of SENT in the order of (field, key, stretch, doc_id); ``out`` holds the rows of FOUND that are certain.

    A stretch of two records is shared as it is, and only its text is kept; memory goes to distinct texts alone, and to no more than
    ``most`` code points of them.
    """

    def __init__(self, length: int, most: int) -> None:
        self.length, self.most = length, most
        self.out: list[tuple[str, str | None, str, list[int]]] = []
        self.shard: tuple[str, int] | None = None
        self.text: str | None = None
        self.rows: list[tuple[str, list[int]]] = []
        self._begin(0)

    def _begin(self, part: int) -> None:
        self.who: dict[str, tuple[str, str]] = {}
        self.single: list[tuple[str, str, list[int]]] = []
        self.size, self.split = 0, part > 0
        self.windows: dict[str, list[tuple[str, list[int]]]] = {}

    def take(self, field: str, key: int, part: int, stretch: str, doc_id: str, places: list[int]) -> None:
        if self.shard != (field, key):
            self.close()
            self.shard = field, key
            self._begin(part)
        elif stretch != self.text:
            self._text()
        elif self.rows[0][0] != doc_id:  # two records: they need not be held
            self._run(doc_id, places, 0, len(stretch))
            if len(self.rows) == 1 or self.rows[-1][0] == self.rows[0][0]:
                for d, p in self.rows:
                    self._run(d, p, 0, len(stretch))
                self.rows = [self.rows[0], (doc_id, [])]
            return
        self.text = stretch
        self.rows.append((doc_id, places))

    def _run(self, doc_id: str, places: list[int], a: int, b: int) -> None:
        field = self.shard[0]
        self.out += [(field, None, doc_id, [p + a, p + b]) for p in places]

    def _text(self) -> None:
        """All rows of one stretch have been seen."""
        rows, self.rows = self.rows, []
        if not rows:
            return
        low, high = rows[0][0], rows[-1][0]
        if not self.split and self.size + len(self.text) > self.most:
            self.split = True
            for text, (a, b) in self.who.items():
                if a != b:
                    self._cut(text, [(a, []), (b, [])])
            for d, text, p in self.single:
                self._cut(text, [(d, p)])
            self.who, self.single = {}, []
        if self.split:
            self._cut(self.text, rows if low == high else [(low, []), (high, [])])
            return
        self.size += len(self.text)
        self.who[self.text] = low, high
        if low == high:
            self.single += [(d, self.text, p) for d, p in rows]

    def _cut(self, text: str, rows: list[tuple[str, list[int]]]) -> None:
        for i in range(len(text) - self.length + 1):
            self.windows.setdefault(text[i : i + self.length], []).extend((d, [x + i for x in p]) for d, p in rows)
        if len(self.windows) > HELD:
            self._hand_on()

    def _hand_on(self) -> None:
        """Windows of two records are shared; one of them tells the others so. The rest has to be met elsewhere."""
        field = self.shard[0]
        for window, rows in self.windows.items():
            low = min(d for d, _ in rows)
            if any(d != low for d, _ in rows):
                for d, p in rows:
                    self._run(d, p, 0, self.length)
                self.out.append((field, window, low, []))
            else:
                self.out.append((field, window, low, sorted(x for _, p in rows for x in p)))
        self.windows = {}

    def close(self) -> None:
        if self.shard is None:
            return
        self._text()
        if self.split:
            self._hand_on()
        elif self.single and len(self.who) > 1:
            automaton = Automaton(self.who)
            for d, text, p in self.single:
                for a, b in automaton.runs(text, d, self.length):
                    self._run(d, p, a, b)
        self.shard = self.text = None

    def batch(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["field", "stretch", "doc_id", "places"])


def _match(length: int, most: int):
    """Shards in the order of their rows to what is certain."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(length, most)
        for batch in it:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shards.take(*row)
            yield shards.batch()
        shards.close()
        yield shards.batch()

    return run


RUNS = "field string, doc_id string, a int, b int"


def _windows_met(length: int):
    """Runs as they are, and those of the windows, in the order of their code points, that two records have."""
    def runs(batch: pa.RecordBatch, ends: bool) -> pa.RecordBatch:
        sizes = pc.list_value_length(batch.column(3)).to_numpy()
        flat = batch.column(3).flatten().to_numpy()
        take = pa.array(np.repeat(np.arange(len(sizes)), sizes // 2 if ends else sizes), pa.int64())
        a, b = (flat[::2], flat[1::2]) if ends else (flat, flat + length)
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["field", "doc_id", "a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met(2)
        for batch in it:
            certain = pc.is_null(batch.column(1))
            yield runs(batch.filter(certain), True)
            for out in met.take(batch.filter(pc.invert(certain))):
                yield runs(out, False)
        for out in met.rest():
            yield runs(out, False)

    return run


def _records(texts: DataFrame, length: int) -> DataFrame:
    rows = texts.where(F.col("field").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") >= length))
    return rows.select("field", F.col("doc_id").cast("string").alias("doc_id"), "text")


def _merged(runs: DataFrame) -> DataFrame:
    """field, doc_id, span_start, span_end of runs that may overlap."""
    by = runs.groupBy("field", "doc_id").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("r"))  # runs of one text
    return by.mapInArrow(_merge, "field string, doc_id string, span_start bigint, span_end bigint")


def shared_spans(texts: DataFrame, length: int = 100, most: int = MOST, shard: int = SHARD) -> DataFrame:
    """field, doc_id, span_start, span_end: the longest runs of positions that other records of the field share.

    ``texts`` has field, doc_id, text; offsets count code points. Repeated rows of one doc_id are one record, whose spans are given
    once; null and short texts, and rows without doc_id, have none. Spans that differ in a single code point do not match. ``most`` and
    ``shard`` bound the size of a shard, and have no influence on the result.
    """
    rows = _records(texts, length)
    keyed = rows.select(F.xxhash64("field", "doc_id").alias("dk"), "text", F.xxhash64("field").alias("fk"))
    # equal anchors of different fields must not meet: the field's hash is part of the sort key. Two records of one hash only share their anchors
    by_field = keyed.mapInArrow(_with_field(_anchors(length)), "fk bigint, h bigint, dk bigint")
    met = by_field.repartition("fk", "h").sortWithinPartitions("fk", "h", "dk").mapInArrow(_met(2, most), "fk bigint, h bigint, dk bigint, part bigint")
    lists = met.groupBy("dk").agg(F.collect_list(F.struct("h", "part")).alias("x")).select("dk", F.col("x.h").alias("h"), F.col("x.part").alias("part"))  # anchors of one text
    chosen = rows.withColumn("dk", F.xxhash64("field", "doc_id")).join(lists.hint("shuffle_hash"), "dk").select("field", "doc_id", "text", "h", "part")
    sent = chosen.mapInArrow(_send(length), SENT)
    found = sent.repartition("field", "key").sortWithinPartitions("field", "key", "stretch", "doc_id").mapInArrow(_match(length, shard), FOUND)
    met_again = found.repartition("field", F.coalesce("stretch", "doc_id")).sortWithinPartitions("field", "stretch", "doc_id").mapInArrow(_windows_met(length), RUNS)
    return _merged(met_again)


def broadcast_spans(texts: DataFrame, length: int = 100, shard: int = SHARD) -> DataFrame:
    """The same rows by the plain form of the method: the records are dealt into reference shards of about ``shard`` code points, each
    shard's automaton is broadcast, and every text is streamed through every one. The work grows with the square of the corpus.

    A shard holds no more than twice ``shard`` code points and one text; one that does raises ValueError before it is broadcast.
    """
    rows = _records(texts, length).dropDuplicates(["field", "doc_id"])
    fields = rows.groupBy("field").agg(F.sum(F.length("text")).alias("n"), F.max(F.length("text")).alias("longest")).collect()  # one row a field
    out = rows.sparkSession.createDataFrame([], RUNS)
    for f in fields:
        count = -(-f["n"] // shard)
        mine = rows.where(F.col("field") == f["field"])
        dealt = mine.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(count)))
        for i in range(count):
            some = dealt.where(F.col("shard") == i).select("doc_id", "text")
            size = some.agg(F.sum(F.length("text"))).first()[0] or 0
            if size > 2 * shard + f["longest"]:
                raise ValueError(f"a shard of {size} code points")
            who: dict[str, tuple[str, str]] = {}
            for r in some.collect():
                low, high = who.get(r["text"], (r["doc_id"], r["doc_id"]))
                who[r["text"]] = min(low, r["doc_id"]), max(high, r["doc_id"])
            out = out.unionByName(mine.mapInArrow(_streamed(rows.sparkSession.sparkContext.broadcast(Automaton(who)), length), RUNS))
    return _merged(out)


def _streamed(shared, length: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [(f, d, a, b) for f, d, t in zip(*[c.to_pylist() for c in batch.columns], strict=True) for a, b in shared.value.runs(t, d, length)]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=["field", "doc_id", "a", "b"])

    return run


def _with_field(run):
    """Runs ``run`` over the batches of each field apart and puts the field's key, the last column, in front."""

    def outer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            last = batch.num_columns - 1
            for key in pc.unique(batch.column(last)).to_pylist():
                part = batch.filter(pc.equal(batch.column(last), key))
                for out in run(iter([part])):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(out.num_rows, key), pa.int64()), *out.columns], names=["fk", *out.schema.names])

    return outer


def _merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        row, first, last = [], [], []
        for i, runs in enumerate(batch.column(2).to_pylist()):
            for r in runs:
                if row and row[-1] == i and r["a"] <= last[-1]:
                    last[-1] = max(last[-1], r["b"])
                else:
                    row.append(i)
                    first.append(r["a"])
                    last.append(r["b"])
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["field", "doc_id", "span_start", "span_end"])


def without_shared(texts: DataFrame, length: int = 100) -> DataFrame:
    """field, doc_id, n_chars, n_left, text: every record with text, its shared stretches cut out; all of them, as no record is the owner.

    Repeated rows of one doc_id are one record, with the greatest of their texts. A record without shared stretches stays as it is, one
    that is shared from end to end is ''.
    """
    rows = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).groupBy("field", F.col("doc_id").cast("string").alias("doc_id")).agg(F.max("text").alias("text"))
    spans = shared_spans(texts, length).groupBy("field", "doc_id").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("s"))  # of one text
    edges = F.concat(F.array(F.lit(0).cast("bigint")), F.col("s.span_end"))
    begins = F.concat(F.col("s.span_start"), F.array(F.length("text").cast("bigint")))
    kept = F.array_join(F.zip_with(edges, begins, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))), "")
    out = rows.join(spans, ["field", "doc_id"], "left").withColumn("left_over", F.coalesce(kept, "text"))
    return out.select("field", "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.length("left_over").cast("bigint").alias("n_left"), F.col("left_over").alias("text"))


def shared_shares(texts: DataFrame, length: int = 100) -> DataFrame:
    """field, doc_id, n_chars, shared_chars, share of every record with text: how much of it is shared; 0 where nothing is."""
    spans = shared_spans(texts, length).groupBy("field", "doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("s"))
    sizes = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).groupBy("field", "doc_id").agg(F.max(F.length("text")).cast("bigint").alias("n_chars"))
    out = sizes.join(spans, ["field", "doc_id"], "left").withColumn("shared_chars", F.coalesce("s", F.lit(0)))
    return out.select("field", "doc_id", "n_chars", "shared_chars", F.coalesce(F.round(F.col("shared_chars") / F.nullif("n_chars", F.lit(0)), 6), F.lit(0.0)).alias("share"))
