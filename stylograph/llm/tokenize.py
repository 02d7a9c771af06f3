"""Encoding with a public byte-level vocabulary (problem 6).

Texts are laid out as one array of code points. A table gives each code point its class; classes and a look ahead give a small
alphabet of symbols; over it a finite automaton says where a slice begins. An automaton's step is a function from states to
states, and functions compose associatively: the array is cut into rows, all rows are composed at once, column by column, the row
functions are chained, and a second sweep gives every state. No regular expression is used. Slices go to pair merging, each
distinct slice once, through a cache.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylograph.llm.batches import pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct slices kept at most in a worker; beyond it the cache starts anew.
CACHE = 400_000

# Symbols of the automaton.
LETTER, DIGIT, OTHER, SHORT, LONG, INNER_BLANK, LAST_SPACE, LAST_BLANK, START = range(9)
# States: what the slice that holds the last code point is.
BEGIN, IN_LETTERS, IN_DIGITS, IN_OTHER, IN_BLANKS, JOINS, ONE_MORE, TWO_MORE = range(8)
N_SYMBOLS, N_STATES = 9, 8
#: The contractions that are slices of their own, without the apostrophe.
CONTRACTIONS_1 = "stmd"
CONTRACTIONS_2 = ("re", "ve", "ll")


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, slice begins here) by symbol and state.

    BEGIN: the next code point begins a slice. JOINS: a lone space, which the next code point joins. ONE_MORE and TWO_MORE: letters
    that a contraction still takes.
    """
    step = np.zeros((N_SYMBOLS, N_STATES), np.uint8)
    cut = np.ones((N_SYMBOLS, N_STATES), bool)
    for state in range(N_STATES):
        step[LETTER, state], step[DIGIT, state], step[OTHER, state] = IN_LETTERS, IN_DIGITS, IN_OTHER
        step[SHORT, state] = IN_OTHER if state in (IN_OTHER, JOINS) else ONE_MORE
        step[LONG, state] = IN_OTHER if state in (IN_OTHER, JOINS) else TWO_MORE
        step[INNER_BLANK, state], step[LAST_SPACE, state], step[LAST_BLANK, state], step[START, state] = IN_BLANKS, JOINS, BEGIN, BEGIN
    step[LETTER, ONE_MORE], step[LETTER, TWO_MORE] = BEGIN, ONE_MORE
    for symbol, inside in ((LETTER, (IN_LETTERS, JOINS, ONE_MORE, TWO_MORE)), (DIGIT, (IN_DIGITS, JOINS)), (OTHER, (IN_OTHER, JOINS)), (SHORT, (IN_OTHER, JOINS)), (LONG, (IN_OTHER, JOINS)), (INNER_BLANK, (IN_BLANKS,))):
        cut[symbol, list(inside)] = False
    return step, cut


STEP, CUT = _automaton()
_CLASS: np.ndarray | None = None
BLANK_CLASS = 3


def _classes() -> np.ndarray:
    """Class of every code point: LETTER, DIGIT, OTHER, or BLANK_CLASS; made once a worker."""
    global _CLASS
    if _CLASS is None:
        category = unicodedata.category
        table = np.full(0x110001, OTHER, np.uint8)
        kinds = {"L": LETTER, "N": DIGIT}
        table[: 0x110000] = [kinds.get(category(chr(c))[0], OTHER) for c in range(0x110000)]
        blank = [c for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
        table[blank] = BLANK_CLASS
        table[0x110000] = 4  # the mark before each text
        _CLASS = table
    return _CLASS


def symbols(codes: np.ndarray) -> np.ndarray:
    """The automaton's symbols; 0x110000 stands before each text and ends it."""
    kind = _classes()[codes]
    after = np.append(codes[1:], 0x110000)
    after2 = np.append(codes[2:], [0x110000] * min(2, len(codes)))[: len(codes)]
    kind_after = np.append(kind[1:], 4)
    out = kind.copy()
    quote = codes == 0x27
    short = quote & np.isin(after, [ord(c) for c in CONTRACTIONS_1])
    long = np.zeros(len(codes), bool)
    for a, b in CONTRACTIONS_2:
        long |= quote & (after == ord(a)) & (after2 == ord(b))
    out[short], out[long] = SHORT, LONG
    blank = kind == BLANK_CLASS
    inner = blank & ((kind_after == BLANK_CLASS) | (kind_after == 4))
    out[blank] = LAST_BLANK
    out[blank & (codes == 0x20)] = LAST_SPACE
    out[inner] = INNER_BLANK
    out[kind == 4] = START
    return out


def scan(symbol: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol, by composing transition functions."""
    n = len(symbol)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    grid = np.full(rows * width, START, np.uint8)
    grid[:n] = symbol
    columns = np.ascontiguousarray(grid.reshape(rows, width).T)
    table = STEP.ravel()
    through = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    for c in columns:  # all rows at once: the function of what has been read of each row
        through = table[(c.astype(np.intp) * N_STATES)[:, None] + through]
    state = np.empty(rows, np.uint8)
    now = BEGIN
    for r in range(rows):
        state[r] = now
        now = through[r, now]
    out = np.empty((width, rows), np.uint8)
    for i, c in enumerate(columns):
        out[i] = state
        state = table[c.astype(np.intp) * N_STATES + state]
    return out.T.ravel()[:n]


def slices(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All slices in order, the number of slices of each text, and each slice's offset in its text."""
    joined = "".join(["\0" + t for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    heads = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    codes[heads] = 0x110000
    symbol = symbols(codes)
    begins = np.flatnonzero(CUT[symbol, scan(symbol)])
    ends = np.append(begins[1:], len(codes))
    own = symbol[begins] != START
    which = np.searchsorted(heads, begins, side="right") - 1
    begins, ends, which = begins[own], ends[own], which[own]
    counts = np.bincount(which, minlength=len(texts))
    return [joined[a:b] for a, b in zip(begins.tolist(), ends.tolist())], counts, begins - heads[which] - 1


class Merger:
    """Pair merging by rank with a cache of slices."""

    def __init__(self, path: str) -> None:
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    piece, rank = line.split()
                    self.ranks[base64.b64decode(piece)] = int(rank)
        self.bytes = {r: p for p, r in self.ranks.items()}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[int] = []
        self.starts: list[int] = []  # of each id, in code points of its slice
        self.ends: list[int] = [0]

    def merge(self, data: bytes) -> list[int]:
        """Ids of one slice: the neighbours of lowest rank are merged first, the leftmost of equals."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        n = len(data)
        if n < 24:
            parts = [data[i : i + 1] for i in range(n)]
            while len(parts) > 1:
                best, at = 1 << 30, -1
                for i in range(len(parts) - 1):
                    r = ranks.get(parts[i] + parts[i + 1])
                    if r is not None and r < best:
                        best, at = r, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [ranks[p] for p in parts]
        end = list(range(1, n + 1))  # of the part that begins here; 0 where none does
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j = heapq.heappop(heap)
            m = end[i]
            if not m or m >= j or end[m] != j:
                continue  # one of the two has been merged since
            end[i], end[m] = j, 0
            if j < n:
                before[j] = i
                if (r := ranks.get(data[i : end[j]])) is not None:
                    heapq.heappush(heap, (r, i, end[j]))
            b = before[i]
            if b >= 0 and (r := ranks.get(data[b:j])) is not None:
                heapq.heappush(heap, (r, b, j))
        return [ranks[data[i : end[i]]] for i in range(n) if end[i]]

    def numbers(self, parts: list[str]) -> np.ndarray:
        """A number for each slice, which stands for its ids."""
        known, get = self.known, self.known.get
        out = [get(p, -1) for p in parts]
        for i, k in enumerate(out):
            if k < 0:
                p = parts[i]
                k = get(p, -1)
                if k < 0:
                    k = known[p] = len(self.ends) - 1
                    self._learn(p)
                    self.ends.append(len(self.ids))
                out[i] = k
        return np.array(out, np.int64)

    def _learn(self, part: str) -> None:
        data = part.encode("utf-8", "surrogatepass")
        made = self.merge(data)
        self.ids.extend(made)
        at = 0
        for i in made:  # an id that begins within a character has the place of that character
            self.starts.append(at if len(data) == len(part) else sum(b & 0xC0 != 0x80 for b in data[: at + 1]) - 1)
            at += len(self.bytes[i])

    def encode(self, texts: list[str], with_offsets: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(ids of all texts in a row, number of ids of each text, for each id its offset in the text)."""
        if len(self.known) > CACHE:
            self.clear()
        parts, counts, offsets = slices(texts)
        number = self.numbers(parts)
        ends = np.array(self.ends, np.int64)
        size = ends[number + 1] - ends[number]
        total = int(size.sum())
        first = np.cumsum(size) - size
        at = np.arange(total) - np.repeat(first - ends[number], size)
        ids = np.array(self.ids, np.int32)[at] if total else np.zeros(0, np.int32)
        edge = np.concatenate([[0], np.cumsum(counts)])
        held = np.concatenate([[0], np.cumsum(size)])
        return ids, held[edge[1:]] - held[edge[:-1]], np.repeat(offsets, size) + np.array(self.starts, np.int64)[at] if with_offsets else None


_MERGERS: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """The vocabulary's merger, read once a worker."""
    if path not in _MERGERS:
        _MERGERS[path] = Merger(path)
    return _MERGERS[path]


def encode(df: DataFrame, path: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """doc_id and ids of each row, without special tokens; with offsets also the code point at which each id begins, or in which, where it is a part of one.

    Null and empty texts give empty lists. Text that spells a special token is ordinary text. Rows are not grouped: repeated rows,
    and rows without doc_id, stay. Other columns are not read. ``path`` has to be readable on every executor.
    """
    schema = f"`{doc_id}` {df.schema[doc_id].dataType.simpleString()}, ids array<int>" + (", offsets array<int>" if offsets else "")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for batch in it:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in pieces(texts):
                ids, counts, starts = m.encode(texts[a:b], offsets)
                edge = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(edge, pa.array(ids, pa.int32()))]
                if offsets:
                    columns.append(pa.ListArray.from_arrays(edge, pa.array(starts, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[doc_id, "ids", "offsets"][: len(columns)])

    return df.select(doc_id, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def token_counts(df: DataFrame, keep: list[Column | str], path: str = VOCABULARY, text: str = "text") -> DataFrame:
    """The columns ``keep`` and n_tokens, the number of ids; the ids themselves never leave the worker."""
    source = df.select(*keep, F.col(text).cast("string").alias("__text"))
    kept = [f for f in source.schema if f.name != "__text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens bigint"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for batch in it:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            sizes = [m.encode(texts[a:b])[1] for a, b in pieces(texts)]
            counts = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(counts, pa.int64())], names=[*[f.name for f in kept], "n_tokens"])

    return source.mapInArrow(run, schema)


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of a list of ids; bytes that are no character become U+FFFD."""
    known = merger(path).bytes
    return b"".join([known[i] for i in ids]).decode("utf-8", "replace")


def decode_texts(df: DataFrame, path: str = VOCABULARY, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of lists of ids. Null and empty lists give ''; rows are not grouped, and other columns are not read."""
    schema = f"`{doc_id}` {df.schema[doc_id].dataType.simpleString()}, text string"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [decode(x or [], path) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[doc_id, "text"])

    return df.select(doc_id, F.col(ids).alias("ids")).mapInArrow(run, schema)
