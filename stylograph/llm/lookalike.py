"""Visually identical text with different characters (problem 5).

A text's form is found in three steps: ignorable characters go; width, kinds of blank, ligatures and composition are made uniform;
then each word is a lattice whose places hold all letters of Latin, Greek and Cyrillic that look the same, and Viterbi takes the
path that keeps to one script and reads best by that script's letter pairs. A word that could be of several scripts as a whole is of
the text's only script, or of that in which it reads best beside its neighbours. Every choice hangs only on how the text looks, never on which of the letters were stored; so two texts
have the same form exactly if they look the same.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograph.llm.batches import pieces
from stylograph.session import checkpoint

# Letters that look the same, by script; a dot where the script has none.
LATIN = "a c d e h i j l o p q s v w x y A B C E H I J K M N O P S T X Y Z"
GREEK = ". . . . . . . . ο . . . . . . . Α Β . Ε Η Ι . Κ Μ Ν Ο Ρ . Τ Χ Υ Ζ"
CYRILLIC = "а с ԁ е һ і ј ӏ о р ԛ ѕ ѵ ԝ х у А В С Е Н І Ј К М . О Р Ѕ Т Х У ."
SCRIPTS = ("latin", "greek", "cyrillic")

IGNORED = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0100, 0xE01F0)]
HYPHENS = (0x2010, 0x2011)
#: Letters that differ from their compatibility form to the eye: long s, Greek letter variants.
DIFFERENT = {0x17F, 0x1E9B, *range(0x3D0, 0x3F7)}


def _classes() -> dict[str, list[str]]:
    """For each look-alike letter its forms in Latin, Greek and Cyrillic, '' where there is none."""
    out: dict[str, list[str]] = {}
    for forms in zip(LATIN.split(), GREEK.split(), CYRILLIC.split(), strict=True):
        known = ["" if x == "." else x for x in forms]
        for x in known:
            if x:
                out[x] = known
    return out


LOOKS = _classes()


def _folded() -> dict[int, str]:
    """Code point to what it looks like, for width, blanks, ligatures, digraphs and Roman numerals, and '' for the ignorable."""
    out: dict[int, str] = {c: "" for c in IGNORED} | {c: "-" for c in HYPHENS} | {9: " "}
    for c in range(0x80, 0x20000):
        char = chr(c)
        if c in out or 0xD800 <= c < 0xE000:
            continue
        kind = unicodedata.category(char)
        if kind == "Zs":
            out[c] = " "
        form, _, _ = unicodedata.decomposition(char).partition(" ")
        if form in ("<wide>", "<narrow>") or form == "<compat>" and kind in ("Ll", "Lu", "Lt", "Nl") and c not in DIFFERENT:
            out[c] = " " if kind == "Zs" else unicodedata.normalize("NFKC", char)
    return out


FOLD = _folded()


def _ranges(codes: list[int]) -> str:
    out, start = [], None
    codes = sorted(codes)
    for i, c in enumerate(codes):
        start = c if start is None else start
        if i + 1 == len(codes) or codes[i + 1] != c + 1:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(c))}")
            start = None
    return "".join(out)


TO_FOLD = re.compile(f"[{_ranges(list(FOLD))}]")
FOREIGN = re.compile("[Ͱ-Ͽἀ-῿Ѐ-ԯ]")
WORD = re.compile(r"(?:[^\W\d_][̀-ͯ]*)+")
LIMIT = 0x530
_SCRIPT = np.full(LIMIT, -1, np.int8)
for _c in range(LIMIT):
    if chr(_c).isalpha():
        _SCRIPT[_c] = 0 if _c < 0x250 else 1 if 0x370 <= _c < 0x400 else 2 if _c >= 0x400 else -1
SWITCH = -20.0
#: What a neighbouring word adds for its script, in nats.
NEAR = 2.0


def script_of(c: str) -> int:
    """0 Latin, 1 Greek, 2 Cyrillic, -1 other or no letter."""
    n = ord(c)
    if n < LIMIT:
        return int(_SCRIPT[n])
    return 1 if 0x1F00 <= n < 0x2000 else 0 if 0x1E00 <= n < 0x1F00 else -1


def pair_counts(texts: DataFrame) -> np.ndarray:
    """How often each two neighbouring letters of one script occur, over all texts; index 0 is a word's edge.

    Counts are added up in each task. There are LIMIT * LIMIT pairs, so what is collected and broadcast does not grow with the texts.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(LIMIT * LIMIT, np.int64)
        for batch in it:
            strings = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in pieces(strings):
                codes = np.frombuffer("\0".join(strings[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32)
                codes = np.where(codes < LIMIT, codes, 0).astype(np.int64)
                script = _SCRIPT[codes]
                codes = np.where(script >= 0, codes, 0)
                same = (script[1:] == script[:-1]) | (script[1:] < 0) | (script[:-1] < 0)
                pair = (codes[:-1] * LIMIT + codes[1:])[same & ((codes[:-1] > 0) | (codes[1:] > 0))]
                held += np.bincount(pair, minlength=LIMIT * LIMIT)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["pair", "n"])

    out = np.zeros(LIMIT * LIMIT, np.int64)
    total = texts.select("text").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out[total["pair"].to_numpy()] = total["n"].to_numpy()
    return out


def pair_scores(counts: np.ndarray) -> np.ndarray:
    """Log probability of the second letter after the first, among the letters of its script; smoothed."""
    grid = counts.reshape(LIMIT, LIMIT).astype(np.float64)
    out = np.empty((LIMIT, LIMIT), np.float32)
    for s in (0, 1, 2):
        columns = np.flatnonzero(_SCRIPT == s)
        rows = np.concatenate([[0], columns])
        part = grid[np.ix_(rows, columns)] + 0.1
        out[np.ix_(rows, columns)] = np.log(part / part.sum(1, keepdims=True))
    out[:, 0] = np.log((grid[:, 0] + 0.1) / (grid.sum(1) + 0.1 * LIMIT))
    return out


class Former:
    """Brings texts to their form; remembers words."""

    def __init__(self, scores: np.ndarray) -> None:
        self.scores = scores
        self.known: dict[tuple[str, int], str] = {}

    def form(self, text: str) -> str:
        if text.isascii() and "\t" not in text:
            return text
        if TO_FOLD.search(text):
            text = text.translate(FOLD)
        text = unicodedata.normalize("NFC", text)
        if not FOREIGN.search(text):
            return text
        words = list(WORD.finditer(text))
        spans = [unicodedata.normalize("NFD", w.group()) for w in words]
        fixed = [0 if self._in_tag(text, w.start()) else self._own_script(n) for w, n in zip(words, spans, strict=True)]
        present = sorted({s for s, w in zip(fixed, words, strict=True) if s >= 0 and not self._in_tag(text, w.start())})
        before, after = self._nearest(fixed), self._nearest(fixed[::-1])[::-1]
        out, at = [], 0
        for w, nfd, own, b, a in zip(words, spans, fixed, before, after, strict=True):
            out.append(text[at : w.start()])
            out.append(self._word(nfd, own if own >= 0 else self._choose(nfd, present, b, a)))
            at = w.end()
        out.append(text[at:])
        return "".join(out)

    @staticmethod
    def _in_tag(text: str, at: int) -> bool:
        """Whether the word at this place is the name of a tag; those are Latin."""
        return text[at - 1 : at] == "<" or text[max(0, at - 2) : at] == "</"

    @staticmethod
    def _nearest(fixed: list[int]) -> list[int]:
        """For each word the script of the nearest word before it that has one of its own, else -1."""
        out, now = [], -1
        for s in fixed:
            out.append(now)
            now = s if s >= 0 else now
        return out

    def _choose(self, word: str, present: list[int], before: int, after: int) -> int:
        """The script, of those that the text has, in which a word of look-alike letters only reads best; its neighbours' count more."""
        if len(present) < 2:
            return present[0] if present else 0
        best, found = -np.inf, present[0]
        for s in present:
            letters = [LOOKS[c][s] if c in LOOKS else c for c in word if not "\u0300" <= c <= "\u036f"]
            if all(letters):
                line = [0, *[ord(c) if ord(c) < LIMIT else 0 for c in letters], 0]
                score = float(self.scores[line[:-1], line[1:]].sum()) + NEAR * ((s == before) + (s == after))
                if score > best:
                    best, found = score, s
        return found

    def _own_script(self, word: str) -> int:
        """The script of the letters that look like none of another script: of the most, if they differ; -1 without such."""
        votes = [0, 0, 0]
        for c in word:
            s = script_of(c)
            if s >= 0 and c not in LOOKS:
                votes[s] += 1
        return votes.index(max(votes)) if any(votes) else -1

    def _word(self, word: str, context: int) -> str:
        key = word, context
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = unicodedata.normalize("NFC", self._best(word, context))
        return self.known[key]

    def _best(self, word: str, context: int) -> str:
        """Viterbi over the letters that look the same; marks stay with their letter."""
        places = [(c, [x for x in LOOKS[c] if x] if c in LOOKS else [c]) for c in word if not "̀" <= c <= "ͯ"]
        back: list[list[int]] = []
        before: list[tuple[str, float]] = [("\0", 0.0)]
        for _, options in places:
            row, now = [], []
            for x in options:
                s = script_of(x)
                best, at = -np.inf, 0
                for i, (p, score) in enumerate(before):
                    q = script_of(p)
                    step = float(self.scores[ord(p), ord(x)]) if ord(p) < LIMIT and ord(x) < LIMIT and (q == s or q < 0) else -10.0
                    if q >= 0 and s >= 0 and q != s:
                        step += SWITCH
                    if score + step > best:
                        best, at = score + step, i
                if s >= 0 and s != context:
                    best += SWITCH
                row.append(at)
                now.append((x, best))
            back.append(row)
            before = now
        if not places:
            return word
        at = max(range(len(before)), key=lambda i: before[i][1])
        chosen = []
        for (_, options), row in zip(reversed(places), reversed(back), strict=True):
            chosen.append(options[at])
            at = row[at]
        letters = iter(reversed(chosen))
        return "".join(c if "̀" <= c <= "ͯ" else next(letters) for c in word)


def uniform_texts(texts: DataFrame, keep: list[str], with_text: bool = True) -> DataFrame:
    """The columns ``keep``, raw and looks, digests of the text as stored and of its form, blank, and the form itself.

    The letter pairs are learned from ``texts``. Null texts give no row; blank says that nothing visible is left. Repeated rows stay.
    """
    rows = texts.where(F.col("text").isNotNull())
    shared = texts.sparkSession.sparkContext.broadcast(pair_scores(pair_counts(rows)))
    source = rows.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text") + ", raw binary, looks binary, blank boolean" + (", form string" if with_text else "")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        former = Former(shared.value)
        digest = lambda s: hashlib.md5(s.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        for batch in it:
            stored = batch.column(batch.num_columns - 1).to_pylist()
            forms = [former.form(t) for t in stored]
            columns = [pa.array([digest(t) for t in stored], pa.binary()), pa.array([digest(t) for t in forms], pa.binary()), pa.array([not t.strip() for t in forms], pa.bool_())]
            if with_text:
                columns.append(pa.array(forms, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*keep, "raw", "looks", "blank", "form"][: len(keep) + len(columns)])

    return source.mapInArrow(run, schema)


#: Stored texts of one look whose pairs are made in one task.
SPLIT = 1000


def _stored(texts: DataFrame) -> DataFrame:
    """field, doc_id, raw, looks of records with something visible, each text formed once and written."""
    rows = texts.where(F.col("doc_id").isNotNull())
    return checkpoint(uniform_texts(rows, ["field", "doc_id"], with_text=False).where(~F.col("blank")).select("field", "doc_id", "raw", "looks").distinct())


def _stored_texts(made: DataFrame) -> DataFrame:
    """field, looks, raw, rep, n: each stored text once, with its least doc_id, of looks that have two stored texts or more; k: how many."""
    once = made.groupBy("field", "looks", "raw").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    several = made.groupBy("field", "looks").agg(F.min("raw").alias("a"), F.max("raw").alias("b"), F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("head")).where(F.col("a") != F.col("b")).drop("a", "b")
    return once.join(several, ["field", "looks"])


def same_looks(texts: DataFrame, split: int = SPLIT) -> DataFrame:
    """field, doc_id_a, doc_id_b, the smaller first: pairs of records whose texts differ as stored but look the same.

    Stored texts are paired first, each once, and then their records, so that records of one stored text make no pairs among themselves,
    however many they are, and nothing is made that is no result. A look of more than ``split`` stored texts is paired in parts. Rows
    without doc_id, and texts with nothing visible, are left out; repeated rows of one doc_id count once.
    """
    made = _stored(texts)
    some = _stored_texts(made).withColumn("parts", F.ceil(F.col("n_docs") / split).cast("int"))
    a = some.select("field", "looks", F.col("raw").alias("ra"), F.pmod(F.xxhash64("raw"), F.col("parts")).cast("int").alias("part"))
    b = some.select("field", "looks", F.col("raw").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = a.join(b, ["field", "looks", "part"]).where(F.col("ra") < F.col("rb")).select("field", "ra", "rb")
    x = made.select("field", F.col("doc_id").alias("x"), F.col("raw").alias("ra"))
    y = made.select("field", F.col("doc_id").alias("y"), F.col("raw").alias("rb"))
    both = pairs.join(x, ["field", "ra"]).join(y, ["field", "rb"]).where(F.col("x") != F.col("y"))
    return both.select("field", F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def look_classes(texts: DataFrame) -> DataFrame:
    """field, doc_id, rep, head, n_docs: one row for each record whose look has two stored texts or more.

    ``rep`` is the least doc_id with the same stored text, ``head`` the least with the same look: rep and head are the class's
    representative pair, and n_docs its records; no pairs are made. Left out and counted once are the same rows as in ``same_looks``.
    """
    made = _stored(texts)
    return made.join(_stored_texts(made), ["field", "looks", "raw"]).select("field", "doc_id", "rep", "head", "n_docs").distinct()
