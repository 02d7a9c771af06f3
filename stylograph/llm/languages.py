"""Language of documents and of the stretches of mixed ones (problem 8).

Words get a likelihood under each language from letter trigrams and word counts of labelled samples, once with accents and once
without, as texts may have lost theirs. A document is a mixture: expectation maximisation finds the shares of languages that make
its sentences likeliest, and a language joins the document's set only if the likelihood gains more than a penalty. Within the set a
Viterbi path over the sentences, which pays for each switch, gives the stretches.

A stretch's confidence is the posterior of its language under the mixture of the document's other sentences. Words are no independent witnesses, so its log
likelihoods are divided by a temperature that grows with their number; it is fitted to pieces of samples that the model has not seen. A
logistic rule, fitted to the same pieces and to those read without their own language's model, tells how likely it is that
none of the languages fits; where that is sure the language is UNKNOWN.

Most texts have one language only, whichever of their stops end sentences. Where no confidence is asked for, that is proved from the
pieces between all places where a sentence may end, and only the other texts are split into sentences.
"""

from __future__ import annotations

import functools
import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograph.llm.batches import pieces
from stylograph.llm.sentences import ALWAYS, OPENERS, Splitter, lexicon_of, masked

WORDS = re.compile(r"(?:[^\W\d_]+[\x00̀-ͯ]*)+")
#: Samples used at most for each language, in the order of their hash.
MAX_SAMPLES = 2000
#: The code of a language that is none of the samples'.
UNKNOWN = "und"
#: Words of the pieces on which confidence is fitted, and pieces of each size taken from one sample at most.
SIZES, PIECES = (1, 2, 4, 8, 16, 32, 64), 4
#: Most words remembered by a worker.
CACHE = 300_000
#: How far a language has to be ahead in each piece of a text to be that of all its sentences: two forms count at most log 2 more than the better.
AHEAD = math.log(2) + 1e-6


@dataclass(frozen=True)
class Settings:
    """``clip``: most that one word may speak for a language, in nats; ``add``: what a language has to gain to be in a document;
    ``switch``: the price of a change between sentences; ``order_weight``: of the lower order in trigram smoothing; ``unknown``: how sure
    it has to be that no language fits; ``rare``: how often that is expected."""

    clip: float = 6.0
    add: float = 10.0
    switch: float = 6.0
    order_weight: float = 3.0
    word_weight: float = 0.5
    rounds: int = 12
    unknown: float = 0.8
    rare: float = 0.05


#: Thai, Lao, Myanmar, Khmer, kana and ideographs.
UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-鿿豈-﫿\U00020000-\U0003ffff]")


def plain(word: str) -> str:
    """Lower case, compatibility form, without invisible characters."""
    return unicodedata.normalize("NFKC", word.replace("\0", "")).lower()


def bare(word: str) -> str:
    """Without accents."""
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFD", word) if not "̀" <= c <= "ͯ").replace("ł", "l").replace("ß", "ss")


def words_of(text: str) -> list[str]:
    """The words of a text; scripts without spaces give their characters."""
    out = WORDS.findall(text)
    if UNSPACED.search(text):
        out = [x for w in out for x in (filter(str.isalpha, w) if UNSPACED.match(w) else (w,))]
    return out


class Model:
    """Log likelihoods of words under each language: first all with accents, then all without. Counts of letter trigrams, smoothed by
    those of pairs and single letters, are mixed with counts of whole words."""

    def __init__(self, samples: list[tuple[str, str]], settings: Settings = Settings(), calibrate: bool = True) -> None:
        self.s = settings
        #: Of the temperature: its value for one word, and the power of the number of words.
        self.heat = (2.0, 0.5)
        #: Weights of the rule that tells whether no language fits, and the mean log likelihood of a letter in a text of each language.
        self.misfit: np.ndarray | None = None
        self.usual: dict[str, float] = {}
        self.langs = sorted({lang for lang, _ in samples})
        self.lexicon = lexicon_of([t for _, t in samples])
        n = len(self.langs)
        self.words: dict[str, np.ndarray] = {}
        self.grams: tuple[dict[str, np.ndarray], ...] = ({}, {}, {})
        self.contexts: tuple[dict[str, np.ndarray], ...] = ({}, {})
        for lang, text in samples:
            i = self.langs.index(lang)
            for w in map(plain, words_of(text)):
                for j, form in ((i, w), (n + i, bare(w))):
                    self._add(self.words, form, j)
                    p = f"\2\2{form}\3"
                    for k in range(2, len(p)):
                        for order in range(3):
                            self._add(self.grams[order], p[k - order : k + 1], j)
                        for order in (1, 2):
                            self._add(self.contexts[order - 1], p[k - order : k], j)
        self.none = np.zeros(2 * n)
        self.total = sum(self.grams[0].values(), self.none)
        self.n_words = np.maximum(sum(self.words.values(), self.none), 1)
        self.alphabet = len(self.grams[0]) + 1000
        self.known: dict[str, np.ndarray] = {}
        if calibrate:
            self._calibrate(samples)

    def _add(self, counts: dict[str, np.ndarray], key: str, j: int) -> None:
        if key not in counts:
            counts[key] = np.zeros(2 * len(self.langs))
        counts[key][j] += 1

    def _trigram(self, g: str) -> np.ndarray:
        """Log probability of the third letter behind the first two, for each language."""
        out = self.known.get(g)
        if out is None:
            k, none = self.s.order_weight, self.none
            one = (self.grams[0].get(g[2], none) + 0.1) / (self.total + 0.1 * self.alphabet)
            two = (self.grams[1].get(g[1:], none) + k * one) / (self.contexts[0].get(g[1], none) + k)
            out = np.log((self.grams[2].get(g, none) + k * two) / (self.contexts[1].get(g[:2], none) + k))
            if len(self.known) > CACHE:
                self.known.clear()
            self.known[g] = out
        return out

    def word(self, w: str) -> np.ndarray:
        """Two log likelihoods for each language; none is more than ``clip`` below the best."""
        out = self.raw(plain(w))
        return np.maximum(out, out.max() - self.s.clip)

    def raw(self, full: str) -> np.ndarray:
        """Two log likelihoods for each language of a word in its plain form."""
        p = f"\2\2{full}\3"
        letters = sum((self._trigram(p[i - 2 : i + 1]) for i in range(2, len(p))), self.none)
        share = self.words.get(full, self.none) / self.n_words
        return np.logaddexp(np.log(self.s.word_weight * share + 1e-300), np.log(1 - self.s.word_weight) + letters)

    def posterior(self, ll: np.ndarray, n_words: int, own: int, prior: np.ndarray | None) -> float:
        """Of the language ``own``, from the log likelihoods of all words together; without a prior all languages are alike."""
        x = (ll - ll[own]) / max(1.0, self.heat[0] * n_words ** self.heat[1])
        if prior is not None:
            x += np.log(prior / prior[own])
        return float(1 / np.exp(np.minimum(x, 700)).sum())

    def foreign(self, lang: str, ll: float, letters: int) -> float:
        """How likely it is that none of the languages fits, where the best one, ``lang``, gives so many letters this log likelihood."""
        if self.misfit is None or letters <= 0 or lang not in self.usual:
            return 0.0
        a, b, c, d = self.misfit
        each, size = ll / self.usual[lang] / letters, math.log(letters)
        odds = math.exp(max(-500.0, min(500.0, a + b * each + c * size + d * each * size))) * self.s.rare / (1 - self.s.rare)
        return odds / (1 + odds)

    def _calibrate(self, samples: list[tuple[str, str]]) -> None:
        """Fits ``heat`` and ``misfit`` to pieces of each half of the samples under a model of the other half."""
        halves: tuple[list, list] = ([], [])
        seen: Counter = Counter()
        for lang, text in samples:
            halves[seen[lang] % 2].append((lang, text))
            seen[lang] += 1
        totals, sizes, fits, letters, best, strange = [], [], [], [], [], []
        for train, test in (halves, halves[::-1]):
            model = Model(train, self.s, calibrate=False)
            n = len(model.langs)
            at_hand: dict[str, np.ndarray] = {}
            for lang, text in test:
                words = list(map(plain, words_of(text)))
                if lang not in model.langs or n < 3 or not words:
                    continue
                own = model.langs.index(lang)
                for w in words:
                    if w not in at_hand:
                        at_hand[w] = model.raw(w)
                rows = np.array([at_hand[w] for w in words])
                rest = np.array([j for j in range(2 * n) if j % n != own])
                for size in SIZES:
                    for at in range(0, min(len(words) - size + 1, PIECES * size), size):
                        part = rows[at : at + size]
                        count = sum(map(len, words[at : at + size]))
                        for keep, m in ((slice(None), n), (rest, n - 1)):
                            x = part[:, keep]
                            x = np.maximum(x, x.max(1, keepdims=True) - self.s.clip).sum(0)
                            ll = np.logaddexp(x[:m], x[m:])
                            fits.append(ll.max())
                            letters.append(count)
                            kept = model.langs if m == n else [x for x in model.langs if x != lang]
                            best.append(kept[int(ll.argmax())])
                            strange.append(m < n)
                            if m == n:
                                totals.append(ll - ll[own])
                                sizes.append(size)
        if not totals:
            return
        width = max(map(len, totals))
        gaps = np.full((len(totals), width), -np.inf)
        for i, t in enumerate(totals):
            gaps[i, : len(t)] = t
        n_words = np.array(sizes)

        def loss(heat: tuple[float, float]) -> float:
            x = gaps / np.maximum(1.0, heat[0] * n_words ** heat[1])[:, None]
            top = x.max(1)
            return float((np.log(np.exp(x - top[:, None]).sum(1)) + top).mean())

        self.heat = min(((a, b) for a in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0) for b in np.arange(0, 1.01, 0.1)), key=loss)
        each, odd, of = np.array(fits) / np.array(letters), np.array(strange), np.array(best)
        self.usual = {x: float(-each[~odd & (of == x)].mean()) for x in self.langs if (~odd & (of == x)).any()}
        told = np.isin(of, list(self.usual))
        scale = np.array([self.usual.get(x, 1.0) for x in best])
        self.misfit = _logistic(_fit_features(np.array(fits) / scale, np.array(letters))[told], odd[told].astype(float))


def _fit_features(ll: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """What ``Model.foreign`` weighs."""
    each, size = ll / letters, np.log(letters)
    return np.stack([np.ones(len(ll)), each, size, each * size], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return w


class Numbers(dict):
    """Word to its row in the table of likelihoods; makes the row when the word is first met."""

    def __init__(self, model: Model) -> None:
        self.model, self.table = model, np.empty((1024, 2 * len(model.langs)))

    def __missing__(self, w: str) -> int:
        k = len(self)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[k] = self.model.word(w).astype(np.float32)
        self[w] = k
        return k

    def sums(self, numbers: list[int], edge: np.ndarray) -> np.ndarray:
        """The sums of the rows of the words from each edge to the next."""
        out = np.empty((len(edge) - 1, self.table.shape[1]))
        numbers = np.array(numbers, np.int64)
        step = 500
        for at in range(0, len(out), step):
            part = slice(at, min(len(out), at + step))
            lo, hi = edge[part.start], edge[part.stop]
            out[part] = np.add.reduceat(self.table[numbers[lo:hi]], edge[part] - lo, axis=0)
        return out


# Bits of what a code point is. GAP: what a sentence's opening is looked for behind.
LETTER, MARK, END, LOWER, BLANK, DIGIT, GAP, SPACELESS = (1 << k for k in range(8))


@functools.cache
def _kinds() -> np.ndarray:
    """The bits of each code point."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for i, c in enumerate(map(chr, range(sys.maxunicode + 1))):
        if c.isalnum():
            out[i] = (0 if c.isdecimal() else LETTER) | (LOWER if c.islower() else 0) | (DIGIT if c.isdigit() else 0) | (SPACELESS if UNSPACED.match(c) else 0)
        else:
            out[i] = (BLANK | GAP if c.isspace() else 0) | (LOWER if c.islower() else 0) | (SPACELESS if UNSPACED.match(c) else 0)
    out[0] |= MARK | BLANK | GAP
    out[0x300:0x370] |= MARK
    for bit, chars in ((GAP, OPENERS), (END, ".!?…‥؟۔．？！" + ALWAYS)):
        out[list(map(ord, chars))] |= bit
    return out


class Shown:
    """The words of masked texts, all at once."""

    def __init__(self, texts: list[str]) -> None:
        joined = "\1".join(texts) + "\1"
        self.code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.kind = _kinds()[self.code]
        self.begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.kept = (self.kind & LETTER) > 0
        mark = (self.kind & MARK) > 0
        if mark.any():  # marks stay behind letters
            self.kept = self.kept[np.maximum.accumulate(np.where(mark, 0, np.arange(len(mark))))]
        #: Texts of which some words are single characters; they show none.
        self.spaceless = np.logical_or.reduceat((self.kind & SPACELESS) > 0, self.begin[:-1])
        self.kept &= ~np.repeat(self.spaceless, np.diff(self.begin))
        self.only = np.where(self.kept, self.code, 32).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")

    def words(self, k: int, a: int, b: int) -> list[str]:
        """The words of that stretch of text number k, as ``words_of`` finds them."""
        return self.only[self.begin[k] + a : self.begin[k] + b].split()

    def ends(self) -> np.ndarray:
        """Places behind which a sentence or block may end, in order: all where one does and others, but for texts with words without spaces."""
        code, kind = self.code, self.kind
        has = lambda bit: (kind & bit) > 0
        behind = np.append(kind[1:], 0)
        always = np.isin(code, list(map(ord, ALWAYS)))
        stop = np.flatnonzero(has(END) & ((behind & END) == 0) & ~always)
        solid = np.flatnonzero(~has(GAP))
        after = kind[solid[np.minimum(np.searchsorted(solid, stop, "right"), len(solid) - 1)]]
        close = behind[stop]
        before = lambda n: kind[np.maximum(stop - n, 0)]
        lone = (code[stop] == ord(".")) & ((before(1) & END) == 0)
        single = ((before(1) & (LETTER | DIGIT)) > 0) & ((before(2) & (LETTER | DIGIT | MARK)) == 0) & (stop > 1)
        number = lone & ((close & DIGIT) > 0)
        number |= lone & ((close & BLANK) > 0) & (code[np.minimum(stop + 1, len(code) - 1)] != 0) & ((after & DIGIT) > 0) & (((before(1) & DIGIT) > 0) | single)
        goes_on = ((after & LOWER) > 0) | number | np.isin(code[np.minimum(stop + 1, len(code) - 1)], [44, 58, 59])
        found = [stop[~goes_on], np.flatnonzero(always | (code == 1))]
        solid_so_far = np.cumsum(~has(BLANK))
        for c in (10, 13):  # blank lines
            line = np.flatnonzero(code == c)
            found.append(line[:-1][solid_so_far[line[:-1]] == solid_so_far[line[1:]]])
        return np.sort(np.concatenate(found))


def fit(samples: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of labelled samples (lang, text), of which at most MAX_SAMPLES a language are taken: the bound of what the driver reads."""
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    some = samples.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("r", F.row_number().over(w)).where(F.col("r") <= MAX_SAMPLES)
    return Model([(r["lang"], r["text"]) for r in some.select("lang", "text").orderBy("lang", "r").collect()], settings)


def mixture(ll: np.ndarray, langs: list[int], rounds: int) -> tuple[float, np.ndarray]:
    """Log likelihood of the sentences under the best mixture of the given languages, and its shares."""
    x = ll[:, langs]
    top = x.max(1, keepdims=True)
    p = np.exp(x - top)
    share = np.full(len(langs), 1 / len(langs))
    for _ in range(rounds if len(langs) > 1 else 0):
        resp = p * share
        resp /= resp.sum(1, keepdims=True)
        share = np.maximum(resp.sum(0) / len(resp), 1e-6)
        share /= share.sum()
    return float((np.log(p @ share) + top[:, 0]).sum()), share


def choose(ll: np.ndarray, s: Settings) -> tuple[list[int], np.ndarray]:
    """The language set by penalised likelihood: languages join one at a time while the best of them gains more than the penalty."""
    chosen = [int(ll.sum(0).argmax())]
    best, share = mixture(ll, chosen, s.rounds)
    while len(chosen) < ll.shape[1]:
        gaps = (ll - ll[:, chosen].max(1, keepdims=True)).clip(min=0).sum(0)  # more cannot be gained
        tried = [(*mixture(ll, [*chosen, c], s.rounds), c) for c in np.flatnonzero(gaps > s.add) if c not in chosen]
        if not tried:
            break
        value, shares, c = max(tried, key=lambda t: t[0])
        if value - best <= s.add:
            break
        chosen, best, share = [*chosen, int(c)], value, shares
    return chosen, share


def path(ll: np.ndarray, langs: list[int], share: np.ndarray, s: Settings) -> np.ndarray:
    """The likeliest language of each sentence when every change has its price."""
    x = ll[:, langs] + np.log(share)
    n, k = x.shape
    if k == 1:
        return np.zeros(n, np.int64)
    back = np.zeros((n, k), np.int64)
    now = x[0]
    for i in range(1, n):
        jump = now.max() - s.switch
        back[i] = np.where(now >= jump, np.arange(k), now.argmax())
        now = np.maximum(now, jump) + x[i]
    out = np.empty(n, np.int64)
    out[-1] = now.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


class Labeller:
    """Stretches of texts; remembers words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.splitter = Splitter(model.lexicon)
        self.known = Numbers(model)

    def label(self, texts: list[str], confidence: bool = True) -> list[list[tuple[int, int, str, float | None]]]:
        """For each text its stretches (begin, end, language, confidence); none for a text without letters. Without ``confidence`` that
        of some is None; all else is the same."""
        return [x for a, b in pieces(texts) for x in self._label(texts[a:b], confidence)]

    def _label(self, texts: list[str], confidence: bool) -> list[list[tuple[int, int, str, float | None]]]:
        if len(self.known) > CACHE:
            self.known = Numbers(self.model)
        hidden = [masked(t, True) for t in texts]
        shown = Shown(hidden)
        out = {} if confidence else self._proved(texts, hidden, shown)
        units: list[list[tuple[int, int]]] = []
        numbers: list[int] = []
        sizes: list[int] = []
        letters: list[int] = []
        known = self.known
        rest = [k for k in range(len(texts)) if k not in out]
        for k in rest:
            own = []
            for a, b in self.splitter.split(texts[k], True):
                found = words_of(self.splitter.text[a:b]) if shown.spaceless[k] else shown.words(k, a, b)
                if found:
                    own.append((a, b))
                    numbers += [known[w] for w in found]
                    sizes.append(len(found))
                    letters.append(len("".join(found)))
            units.append(own)
        both = known.sums(numbers, np.cumsum([0, *sizes]))
        ends = np.cumsum([0, *map(len, units)])
        for k, u, a, b in zip(rest, units, ends[:-1], ends[1:], strict=True):
            out[k] = self._stretches(len(texts[k]), u, both[a:b], len(self.model.langs), sizes[a:b], letters[a:b])
        return [out[k] for k in range(len(texts))]

    def _proved(self, texts: list[str], hidden: list[str], shown: Shown) -> dict[int, list[tuple[int, int, str, None]]]:
        """The stretches of those texts that have one language, however the places where a sentence may end are decided.

        A sentence is made of whole pieces. If in each piece one form of a language is ahead of both forms of every other one by log 2
        at least, it is so in each sentence, and the likelihoods of two forms together exceed the better one's by log 2 at most.
        Pieces where it is not are joined to those beside them if the splitter says of the stop between that the sentence goes on.
        The likelihood of the whole lies between that of the better form throughout and the sum over the pieces.
        """
        langs, n = self.model.langs, len(self.model.langs)
        word = np.flatnonzero(shown.kept & ~np.append(False, shown.kept[:-1]))
        ends = shown.ends()
        piece = np.searchsorted(ends, word)
        first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])[: len(word)])
        both = self.known.sums([self.known[w] for w in shown.only.split()], np.append(first, len(word)))
        at = np.searchsorted(word[first], shown.begin)  # pieces before each text
        inside = np.append(0, np.cumsum(shown.kept & (shown.code == 0)))[shown.begin]
        letters = np.diff(np.append(0, np.cumsum(shown.kept))[shown.begin])
        sure = ~shown.spaceless & (inside[1:] == inside[:-1])
        out: dict[int, list] = {int(k): [] for k in np.flatnonzero(sure & (at[1:] == at[:-1]))}
        some = np.flatnonzero(at[1:] > at[:-1])
        if not len(some):
            return out
        form = np.add.reduceat(both, at[some]).argmax(1)
        each = np.repeat(form, np.diff(at)[some])
        low = np.logical_or.reduceat(self._ahead(both, each) < AHEAD, at[some])
        rows = np.arange(len(both))
        least = np.add.reduceat(both[rows, each], at[some]) - 1e-6
        most = np.add.reduceat(np.logaddexp(both[rows, each % n], both[rows, n + each % n]), at[some]) + 1e-6
        for k, f, behind, bounds in zip(some.tolist(), form.tolist(), low.tolist(), zip(least.tolist(), most.tolist()), strict=True):
            part = slice(at[k], at[k + 1])
            if sure[k] and not (behind and not self._joins(both[part], f, hidden[k], int(shown.begin[k]), ends, piece[first[part]])):
                strange = [self.model.foreign(langs[f % n], x, int(letters[k])) > self.model.s.unknown for x in bounds]
                if strange[0] == strange[1]:
                    out[k] = [(0, len(texts[k]), UNKNOWN if strange[0] else langs[f % n], None)]
        return out

    @staticmethod
    def _ahead(part: np.ndarray, form: np.ndarray | int) -> np.ndarray:
        """How far a form of a language, of each piece or of all, is ahead of both of every other language in each piece."""
        n, rows = part.shape[1] // 2, np.arange(len(part))
        others = np.maximum(part[:, :n], part[:, n:])
        others[rows, form % n] = -np.inf
        return part[rows, form] - others.max(1)

    def _joins(self, part: np.ndarray, form: int, text: str, begin: int, ends: np.ndarray, piece: np.ndarray) -> bool:
        """Whether the pieces of a text can be joined so that the form is ahead in all. ``begin``: where it begins in what
        ``ends`` counts; ``piece``: how many of the ends are before each piece."""
        self.splitter.begin(text)
        parted = np.ones(len(part) + 1, bool)  # whether each piece is parted from the one before
        asked = {0, len(part)}
        while True:
            starts = np.flatnonzero(parted[:-1])
            low = np.flatnonzero(self._ahead(np.add.reduceat(part, starts), form) < AHEAD)
            if not len(low):
                return True
            stops = np.append(starts[1:], len(part))
            for e in {int(x) for i in low for x in (starts[i], stops[i])} - asked:
                asked.add(e)
                parted[e] = not all(self.splitter.goes_on(x - begin) for x in ends[piece[e - 1] : piece[e]].tolist())
            if any(parted[starts[i]] and parted[stops[i]] for i in low):
                return False

    def _stretches(self, length: int, units: list[tuple[int, int]], both: np.ndarray, n: int, sizes: list[int], letters: list[int]) -> list[tuple[int, int, str, float]]:
        if not units:
            return []
        ll = np.logaddexp(both[:, :n], both[:, n:])
        best = ll.argmax(1)
        if (best == best[0]).all():
            own = int(best[0])
            lang, sure = self._named(own, ll.sum(0), sum(sizes), sum(letters), None)
            return [(0, length, lang, sure)]
        langs, share = choose(ll, self.model.s)
        way = path(ll, langs, share, self.model.s)
        first = np.concatenate([[True], way[1:] != way[:-1]])
        starts = np.flatnonzero(first)
        stops = np.append(starts[1:], len(units))
        out = []
        for i, (a, b) in enumerate(zip(starts, stops, strict=True)):
            own = langs[way[a]]
            total = ll[a:b].sum(0)
            prior = None
            if len(starts) > 1:  # one sentence's worth for all languages; the stretch is no witness for its own prior
                prior = np.full(n, 1 / n)
                prior[langs] += np.bincount(way, minlength=len(langs)) - (b - a) * (np.arange(len(langs)) == way[a])
            lang, sure = self._named(own, total, sum(sizes[a:b]), sum(letters[a:b]), prior)
            end = units[b][0] if b < len(units) else length
            out.append((0 if i == 0 else units[a][0], end, lang, sure))
        return out

    def _named(self, own: int, total: np.ndarray, n_words: int, letters: int, prior: np.ndarray | None) -> tuple[str, float]:
        """The code of a stretch in the language ``own``, and its confidence."""
        strange = self.model.foreign(self.model.langs[own], float(total[own]), letters)
        if strange > self.model.s.unknown:
            return UNKNOWN, strange
        return self.model.langs[own], self.model.posterior(total, n_words, own, prior) * (1 - strange)


def segments(docs: DataFrame, model: Model, keep: list[str], confidence: bool = True) -> DataFrame:
    """The columns ``keep`` and seg_start, seg_end, lang, confidence: the stretches of each text.

    Null, empty and letterless texts give no row; repeated rows stay. Stretches are whole sentences and cover the text: the first begins
    at 0, others at their first sentence. Columns of ``docs`` that are not kept are not read; those kept may not have these names.
    Without ``confidence`` that of some is null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.where(F.col("text").isNotNull() & (F.col("text") != "")).select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text") + ", seg_start bigint, seg_end bigint, lang string, confidence double"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in it:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            made = labeller.label(texts, confidence)
            take = pa.array([i for i, m in enumerate(made) for _ in m], pa.int64())
            flat = [x for m in made for x in m]
            columns = [pa.array([x[j] for x in flat], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(len(keep))], *columns], names=[*keep, "seg_start", "seg_end", "lang", "confidence"])

    return source.mapInArrow(run, schema)


def wrong_or_mixed(docs: DataFrame, model: Model, label: str = "lang") -> DataFrame:
    """doc_id, seg_start, lang: the stretches of texts that have several languages, or one that their label is not.

    A label is right only if it is exactly the language's code. Each text is judged in its row; nothing is shuffled.
    """
    made = segments(docs.select("doc_id", F.col(label).alias("label"), F.length("text").alias("size"), "text"), model, ["doc_id", "label", "size"], confidence=False)
    mixed = (F.col("seg_start") > 0) | (F.col("seg_end") < F.col("size"))
    return made.where(mixed | ~F.col("label").eqNullSafe(F.col("lang"))).select("doc_id", "seg_start", "lang")


def document_labels(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, confidence, n_langs: the language of most code points of each text, of equal ones the first by name."""
    parts = segments(docs.select("doc_id", "text"), model, ["doc_id"])
    by = parts.groupBy("doc_id", "lang").agg(F.sum(F.col("seg_end") - F.col("seg_start")).alias("n"), F.avg("confidence").alias("confidence"))
    best = F.min_by(F.struct("lang", "confidence"), F.struct(-F.col("n"), F.col("lang"))).alias("x")
    return by.groupBy("doc_id").agg(best, F.count(F.lit(1)).alias("n_langs")).select("doc_id", "x.lang", "x.confidence", "n_langs")
