"""Sentence boundaries across languages and scripts (problem 1).

Document-centred disambiguation: whether a stop ends a sentence hangs on what stands before and behind it. A word that the document
has in lower case elsewhere is an ordinary word, so a capital on it after an abbreviation opens a sentence; one that it has with a
capital only in mid-sentence is a name, and opens none; one after whose stop its sentences go on is an abbreviation, and one that it
mostly has without a stop is none. Where the document is silent or contradicts itself the corpus answers: a first pass over all texts
counts how often each word is in lower case, and how often a stop behind it is followed by a sentence that goes on. Scripts have rules of their
own: ideographic and Indic stops always end, letters without case need no capital behind the stop, and in scripts without spaces
between words or stops a space ends the unit.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograph.session import checkpoint

# The elements whose begin and end end a unit.
BLOCKS = "p|h[1-6]|li|ul|ol|dl|dt|dd|div|br|hr|table|thead|tbody|tfoot|tr|td|th|caption|blockquote|pre|section|article|header|footer|address|figure|figcaption|form|fieldset|center|body|html|head|title"
MARKUP = re.compile(rf"<!--.*?-->|<(/?(?:{BLOCKS})(?![a-zA-Z0-9])[^<>]*)>|</?[a-zA-Z][^<>]*>", re.S | re.I)
ENTITY = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9a-fA-F]{1,6})|(nbsp|amp|sect|lt|gt|quot|apos|hellip|bdquo|ldquo|rdquo|laquo|raquo|ndash|mdash|ensp|emsp|thinsp));")
# What the named entities stand for.
NAMED = {"nbsp": "\xa0", "amp": "&", "sect": "§", "lt": "\x02", "gt": "\x02", "quot": '"', "apos": "'", "hellip": "…", "bdquo": "„", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "ndash": "–", "mdash": "—", "ensp": " ", "emsp": " ", "thinsp": " "}
HIDDEN = dict.fromkeys([0xAD, 0x34F, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF], "\0")
HAS_HIDDEN = re.compile("[" + "".join(map(chr, HIDDEN)) + "]")
BREAK = re.compile(r"\x01+|\n[\s\0]*\n[\s\0]*|\r(?!\n)[\s\0]*\r[\s\0]*")
STOP = re.compile(r"[.!?…‥؟۔।॥。｡．！？]+(?:[ \0\xa0]*(?<=[!?？！])[!?？！]+)*")
ALWAYS = "।॥。｡！？"
CLOSERS = "”“\"»’'›)]}\0」』）】〉》"
OPENERS = "„“\"«‚‘'‹([{「『（【〈《–—-*•"
PAIRS = re.compile(r"„[^„“”]*[“”]|“[^“”]*”|\"[^\"]*\"|«[^«»]*»|»[^«»]*«|「[^「」]*」|『[^『』]*』|\([^()]*\)|\[[^\[\]]*\]|（[^（）]*）")
HAS_PAIR = re.compile("[„“\"«»「『(（\\[]")
NUMBERING = re.compile(r"[\s\0]*[(\[]?(?:\d{1,4}(?:\.\d{1,3})*|[^\W\d_]|[IVXLC]+)[.)\]]+")
#: A number that stands alone before its stop, as that of an item within a paragraph.
BARE = re.compile(r"[\s\0]*\d{1,3}")
WORD = re.compile(r"[^\W\d_]+")
AFTER = re.compile(r"([\s\0]*)(\S?)")
#: A stop and the word before it, in text that is turned round, so that the search goes from stop to stop.
DOTTED = re.compile(r"\.([^\W\d_]+)")
#: What shows beyond doubt that a sentence goes on behind a stop: a comma or the like, or a word that is no list letter.
GOING = re.compile(r"[,;:]|[ \xa0]+([^\W\d_])(?![).])")
#: A capitalised word behind a space; what stands before the space tells whether that is mid-sentence.
CAPITALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isupper() or c.istitle())
SPACED = re.compile(rf"[ \xa0]+([{CAPITALS}][^\W\d_]*)")
#: The capitalised word behind a stop and whatever marks and blanks.
OPENED = re.compile(rf"[.!?…‥؟۔][\s.!?…‥{re.escape(CLOSERS + OPENERS)}]*([{CAPITALS}][^\W\d_]*)")
ROMAN = re.compile(r"[IVXLCDM]+$")
#: Thai, Lao, Myanmar, Khmer.
UNSPACED = "฀-໿က-႟ក-៿"
UNSPACED_GAP = re.compile(rf"(?<=[{UNSPACED}])[\s\0]+(?=[{UNSPACED}])")
HAS_UNSPACED = re.compile(f"[{UNSPACED}]")
#: Share of all words from which what the corpus says of a word is handed to all tasks: no more than 1 / SHARE words can have it. What
#: it says of rarer words is joined to the documents that ask.
SHARE = 2e-6
FLUSH = 200_000


@dataclass
class Lexicon:
    """What the corpus says: words that occur in lower case, and words that are abbreviations."""

    common: frozenset = field(default_factory=frozenset)
    short: frozenset = field(default_factory=frozenset)


def masked(text: str, html: bool) -> str:
    """The text with the same offsets: block elements as \\1, other markup and invisible characters as \\0, entities as what they show."""
    if html and "<" in text:
        text = MARKUP.sub(lambda m: ("\x01" if m.group(1) else "\0") * (m.end() - m.start()), text)
    if html and "&" in text:
        text = ENTITY.sub(_shown, text)
    return text.translate(HIDDEN) if not text.isascii() and HAS_HIDDEN.search(text) else text


def _shown(m: re.Match) -> str:
    number, hexa, name = m.groups()
    if name:
        char = NAMED[name]
    else:
        code = int(number) if number else int(hexa, 16)
        char = chr(code) if 0 < code < 0xD800 or 0xE000 <= code < 0x110000 else " "
    return char + "\0" * (m.end() - m.start() - 1)


#: What is counted of a word: all occurrences, those before a stop, those of them after which the sentence goes on, and those that
#: close a block.
COUNTS = ("n", "stops", "goes_on", "closes")


class Evidence:
    """Counts of words over masked texts."""

    def __init__(self) -> None:
        self.n, self.stops, self.goes_on, self.closes = Counter(), Counter(), Counter(), Counter()

    def add(self, text: str) -> None:
        self.n.update(WORD.findall(text))
        for x in DOTTED.finditer(text[::-1]):
            w = x.group(1)[::-1]
            gap, nxt = AFTER.match(text, len(text) - x.start()).groups()
            self.stops[w] += 1
            if not nxt or nxt == "\x01" or gap.count("\n") > 1:
                self.closes[w] += 1
            elif nxt.islower() or nxt in ",;:)" or (gap and nxt.isdigit()):
                self.goes_on[w] += 1


def _is_abbreviation(n, stops, goes_on, closes, least: int):
    """Of numbers or columns: sentences go on after the word's stop, or it has a stop always and never closes a block."""
    always = (stops >= 6) & (stops >= 0.9 * n) & (closes <= 0.02 * stops)
    return ((stops >= least) & (goes_on >= 0.3 * stops)) | always


def _plain(masked: str) -> str:
    return unicodedata.normalize("NFC", masked.replace("\0", ""))


def asked(masked: str) -> set[str]:
    """All words on which a boundary of the text may hang, in lower case and in the forms that are looked up: those before a stop, and
    capitalised ones behind one that the text does not have in lower case. Some of them are not needed in the end."""
    text = _plain(masked)
    out = {w[::-1].lower() for w in DOTTED.findall(text[::-1]) if len(w) > 1}
    behind = {w.lower() for w in OPENED.findall(text)}
    if behind:
        out |= behind.difference(WORD.findall(text))
    return out | {unicodedata.normalize("NFKC", w) for w in out if not w.isascii()}


def _lettery(c: str) -> bool:
    """Whether the character is one of which WORD consists."""
    return c.isalnum() and not c.isdecimal()


class Document:
    """What a document says itself of its words, by their unambiguous occurrences; None where it has none or they contradict each other.

    ``masked`` is its masked text; markup and invisible characters part no words, and accents may be characters of their own. The first
    words that are asked for are searched for one by one; of a text that asks for more than that all words are counted, with the same answers.
    """

    #: Searches before all words, and before all capitals in mid-sentence, are listed.
    SINGLY, NAMES = 64, 16

    def __init__(self, masked: str) -> None:
        self.masked = masked
        self.text: str | None = None
        self.low = ""
        self.left = self.SINGLY
        self.n: Counter | None = None
        self.stops: Counter | None = None
        self.names: set[str] | None = None
        self.asked: dict[str, bool] = {}
        self.told: dict[str, bool | None] = {}

    def _count(self, word: str, enough: int = 1 << 60) -> int:
        """Occurrences of the word, as a whole and in this case; counting stops at ``enough``. What is no WORD, as nothing before a sign, has none."""
        if not WORD.fullmatch(word):
            return 0
        if self.text is None:
            self.text = _plain(self.masked)
        if self.n is None and not self.left:
            self.n = Counter(WORD.findall(self.text))
        if self.n is not None:
            return self.n[word]
        self.left -= 1
        t, size, at, n = self.text, len(word), -1, 0
        while n < enough and (at := t.find(word, at + 1 if at < 0 else at + size)) >= 0:
            n += not (_lettery(t[at + size : at + size + 1]) or at and _lettery(t[at - 1]))
        return n

    def common(self, word: str) -> bool | None:
        """True: it stands in lower case. False: it has its capital in mid-sentence, and is never in lower case."""
        word = unicodedata.normalize("NFC", word)
        if self._count(word.lower(), 1):
            return True
        if self._count(word, 2) < 2:
            return None  # nowhere but where it is asked of
        if word not in self.asked and len(self.asked) < self.NAMES:
            self.asked[word] = self._named(word)
        if word in self.asked:
            return False if self.asked[word] else None
        if self.names is None:
            self.names = {x.group(1) for x in SPACED.finditer(self.text) if self._goes_on_to(x.start())}
        return False if word in self.names else None

    def _named(self, word: str) -> bool:
        t, at = self.text, 0
        while (at := t.find(word, at)) >= 0:
            if not t[at + len(word) : at + len(word) + 1].isalpha() and at and t[at - 1] in " \xa0":
                i = at - 1
                while i and t[i - 1] in " \xa0":
                    i -= 1
                if self._goes_on_to(i):
                    return True
            at += len(word)
        return False

    def _goes_on_to(self, gap: int) -> bool:
        c = self.text[gap - 1 : gap]
        return c == "," or c.islower()

    def short(self, word: str) -> bool | None:
        """True: sentences go on after its stop, and it has a stop as often as not. False: they never do, and it mostly has no stop."""
        word = unicodedata.normalize("NFC", word)
        if not WORD.fullmatch(word):
            return None
        if word not in self.told:
            low = word.lower()
            n = sum(self._count(w) for w in {low, word, low.capitalize(), low.upper()})
            stops, goes_on = self._stopped(low)
            self.told[word] = True if goes_on and goes_on >= 0.3 * stops and 2 * stops >= n else False if not goes_on and n > 2 * stops else None
        return self.told[word]

    def _stopped(self, low: str) -> tuple[int, int]:
        """How often the word stands before a stop, in any case, and how often the sentence then goes on."""
        t = self.text
        if self.stops is None and self.left:
            self.low = self.low or t.lower()
            if len(self.low) == len(t):
                self.left -= 1
                size, at, stops, goes_on = len(low), -1, 0, 0
                while (at := self.low.find(low + ".", at + 1 if at < 0 else at + size)) >= 0:
                    if not (at and _lettery(t[at - 1])):
                        stops += 1
                        goes_on += self._goes_on_from(at + size + 1)
                return stops, goes_on
        if self.stops is None:
            self.stops, self.goes_on = Counter(), Counter()
            for x in DOTTED.finditer(t[::-1]):
                w = x.group(1)[::-1].lower()
                self.stops[w] += 1
                self.goes_on[w] += self._goes_on_from(len(t) - x.start())
        return self.stops[low], self.goes_on[low]

    def _goes_on_from(self, at: int) -> bool:
        tail = GOING.match(self.text, at)
        return tail is not None and (tail.group(1) is None or tail.group(1).islower())


def _blank(c: str) -> bool:
    return c == "\0" or c.isspace()


class Splitter:
    """Splits one text at a time."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.common, self.short = lexicon.common, lexicon.short
        self.rare = Lexicon()

    def units(self, text: str, html: bool = False) -> list[tuple[int, int]]:
        m = masked(text, html)
        self.own = Document(m)
        self.text = m
        out: list[tuple[int, int]] = []
        at = 0
        for b in BREAK.finditer(m):
            if b.start() > at:
                self._block(m, at, b.start(), out)
            at = b.end()
        if at < len(m):
            self._block(m, at, len(m), out)
        return out

    def _is_common(self, word: str) -> bool:
        """Whether a capitalised word is an ordinary one: by the document first, then by the corpus."""
        said = self.own.common(word)
        return self._known(word, self.common, self.rare.common) if said is None else said

    def _block(self, m: str, a: int, b: int, out: list[tuple[int, int]]) -> None:
        pairs = [p.span() for p in PAIRS.finditer(m, a, b)] if HAS_PAIR.search(m, a, b) else []
        k = 0
        opening = NUMBERING.match(m, a, b)
        numbered = opening.end() if opening else a
        ends: list[int] = []
        for s in STOP.finditer(m, a, b):
            if s.start() < numbered:
                continue
            while k < len(pairs) and pairs[k][1] <= s.start():
                k += 1
            inside = pairs[k] if k < len(pairs) and pairs[k][0] < s.start() else None
            end = s.end()
            while end < b and m[end] in CLOSERS:
                if inside is None and m[end] in "“\"'" and k < len(pairs) and pairs[k][0] == end:
                    break  # it opens the next quotation
                end += 1
            while end > s.end() and m[end - 1] == "\0":
                end -= 1
            if inside is None:
                ended = self._ends(m, s, end, b)
            else:  # a quotation or bracket belongs to its sentence with all its stops
                ended = end >= inside[1] and (m[inside[0]] not in "([（" or end > inside[1]) and self._quotation_ends(m, inside, end, b)
            if ended and not (ends and BARE.fullmatch(m, ends[-1], s.start())):
                ends.append(end)
        if HAS_UNSPACED.search(m, a, b):
            ends = sorted({*ends, *[g.start() for g in UNSPACED_GAP.finditer(m, a, b)]})
        start = a
        for end in [*ends, b]:
            i, j = start, end
            while i < j and _blank(m[i]):
                i += 1
            while j > i and m[j - 1].isspace():
                j -= 1
            while j > i and _blank(m[j - 1]) and not self._keeps(j - 1):
                j -= 1
                while j > i and m[j - 1].isspace():
                    j -= 1
            if j > i:
                out.append((i, j))
            start = end

    def _keeps(self, at: int) -> bool:
        """An invisible character behind a visible one belongs to it; markup does not."""
        return ord(self.source[at]) in HIDDEN

    def _next(self, m: str, at: int, b: int) -> tuple[bool, int]:
        """(whether there is a gap, place of the next visible character, or b)."""
        gap = False
        while at < b and _blank(m[at]):
            gap |= m[at] != "\0"
            at += 1
        return gap, at

    def _opens(self, m: str, at: int, b: int) -> str:
        """What the text goes on with: "upper", "lower", "digit", "caseless" or "other"; looks behind opening marks."""
        while at < b and (m[at] in OPENERS or _blank(m[at])):
            at += 1
        if at >= b:
            return "other"
        c = m[at]
        if c.isdigit():
            return "digit"
        if c.isalpha():
            return "upper" if c.isupper() or c.istitle() else "lower" if c.islower() else "caseless"
        return "upper" if c == "§" else "other"

    def _word_after(self, m: str, at: int, b: int) -> tuple[str, str]:
        """The next word without hidden characters, and the character behind it."""
        while at < b and (m[at] in OPENERS or _blank(m[at])):
            at += 1
        end = at
        while end < b and (m[end].isalpha() or m[end] == "\0" or ("̀" <= m[end] <= "ͯ")):
            end += 1
        return m[at:end].replace("\0", ""), m[end : end + 1]

    def _quotation_ends(self, m: str, inside: tuple[int, int], end: int, b: int) -> bool:
        """Whether the sentence ends with the quotation that has just been closed behind a stop."""
        _, at = self._next(m, end, b)
        if at >= b:
            return True
        before = inside[0] - 1
        while before >= 0 and _blank(m[before]):
            before -= 1
        led = before >= 0 and m[before] in ":："
        kind = self._opens(m, at, b)
        if kind == "lower" or m[at] in ",;:.!?":
            return False
        if led:
            return True
        return kind == "upper" and self._is_common(self._word_after(m, at, b)[0])

    def _ends(self, m: str, s: re.Match, end: int, b: int) -> bool:
        stops = s.group()
        gap, at = self._next(m, end, b)
        if at >= b:
            return True
        kind = self._opens(m, at, b)
        first = stops[0]
        if first in ALWAYS:
            return m[at] not in "，、,;；"
        if first == ".":
            if len(stops) == 1:
                return self._period_ends(m, s.start(), gap, at, b, kind)
        if first in "…‥" or stops.startswith(".."):
            if not gap and kind != "upper":
                return False
            if kind == "caseless":
                return not (s.start() > 0 and _blank(m[s.start() - 1]))
            if kind != "upper":
                return False
            return not (s.start() > 0 and _blank(m[s.start() - 1])) or self._is_common(self._word_after(m, at, b)[0])
        if kind == "lower" or (kind == "other" and m[at] in ",;:"):
            return False
        return gap or kind in ("upper", "caseless")

    def _period_ends(self, m: str, dot: int, gap: bool, at: int, b: int, kind: str) -> bool:
        if kind == "lower" or (kind == "other" and m[at] in ",;:.)"):
            return False
        i = dot
        while i > 0 and (m[i - 1].isalnum() or m[i - 1] == "\0" or "̀" <= m[i - 1] <= "ͯ"):
            i -= 1
        w = m[i:dot].replace("\0", "")
        if not w:  # behind a bracket, a sign or a space
            return gap and kind in ("upper", "digit", "caseless")
        number = w[-1].isdigit()
        if not gap:
            if kind == "digit" or number and kind != "upper":
                return False
            if kind == "caseless":
                return not w[-1].isascii() and len(w) > 1 and not self._is_short(w)
            after, behind = self._word_after(m, at, b)
            if len(w) < 2 or (w == w.lower() and self._is_short(w)) or (behind == "." and len(after) < 3):
                return self._is_common(after) and len(w) > 1 and len(after) > 1 and not self._is_short(w)
            return True
        if kind == "digit":
            return not (number or len(w) < 2 or self._is_short(w) or ROMAN.match(w) is not None)
        if number:
            return kind in ("upper", "caseless") and (kind == "caseless" or self._is_common(self._word_after(m, at, b)[0]))
        if kind == "caseless":
            return not self._is_short(w)
        if kind == "other":
            return not (len(w) < 2 or self._is_short(w))
        after, behind = self._word_after(m, at, b)
        if behind != "." and not w.isupper() and self._is_common(after):
            return True  # after any word
        if len(w) == 1 or ROMAN.match(w) or self._is_short(w):
            if behind == "." and (len(after) == 1 and after.isupper() or ROMAN.match(after) or self._is_short(after)):
                return False  # initials, numerals, a chain of abbreviations
            if len(w) > 1 and w.isupper() and len(after) > 1 and after.isupper() and self._is_short(w):
                return False  # all in capitals: the letters tell nothing
            return self._is_common(after)
        return True

    def _is_short(self, w: str) -> bool:
        """Whether a word before a stop is an abbreviation: by the document first, then by the corpus."""
        said = self.own.short(w)
        return self._known(w, self.short, self.rare.short) if said is None else said

    @staticmethod
    def _known(word: str, words: frozenset, rare: frozenset) -> bool:
        low = word.lower()
        if low in words or low in rare:
            return True
        low = low if low.isascii() else unicodedata.normalize("NFKC", low)
        return low in words or low in rare

    def begin(self, masked: str) -> None:
        """Makes this masked text the one that ``goes_on`` is asked about."""
        self.own, self.text, self.rare = Document(masked), masked, Lexicon()

    def goes_on(self, at: int) -> bool:
        """Whether the sign at this place is a single period with no closing mark behind it that ends no unit, whatever quotations and
        brackets it stands in. Of others, and of one that may end a unit, False. Units that end for other reasons are not looked at."""
        m = self.text
        if m[at] != "." or m[at + 1 : at + 2] in CLOSERS or STOP.match(m[at + 1 : at + 2]) or at and STOP.match(m[at - 1]):
            return False
        gap, behind = self._next(m, at + 1, len(m))
        return behind < len(m) and not self._period_ends(m, at, gap, behind, len(m), self._opens(m, behind, len(m)))

    def split(self, text: str, html: bool = False, rare: Lexicon = Lexicon()) -> list[tuple[int, int]]:
        """Units of a text as (begin, end); offsets in the text as stored. ``rare``: what the corpus says besides of words of this text."""
        self.source, self.rare = text, rare
        return self.units(text, html)


def lexicon_of(texts: list[str], html: bool = True) -> Lexicon:
    """The lexicon of a few texts at hand, such as labelled samples."""
    found = Evidence()
    for t in texts:
        found.add(masked(t, html))
    low: Counter = Counter()
    sums = {c: Counter() for c in COUNTS}
    for w, n in found.n.items():
        k = w.lower()
        low[k] += n if w == k else 0
        for c in COUNTS:
            sums[c][k] += getattr(found, c)[w]
    short = [w for w in sums["n"] if _is_abbreviation(*[sums[c][w] for c in COUNTS], 2)]
    return Lexicon(frozenset(w for w, n in sums["n"].items() if low[w] >= 0.05 * n), frozenset(short))


def _flush(found: Evidence) -> pa.RecordBatch:
    keys = list(found.n)
    columns = [pa.array(keys, pa.string()), *[pa.array([getattr(found, c).get(k, 0) for k in keys], pa.int64()) for c in COUNTS]]
    return pa.RecordBatch.from_arrays(columns, names=["word", *COUNTS])


_COUNTED = "word string, " + ", ".join(f"{c} bigint" for c in COUNTS)


def word_evidence(texts: DataFrame, html: bool = True) -> DataFrame:
    """word and its COUNTS over all texts; each task adds up its own words before they are shuffled."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Evidence()
        for batch in it:
            for t in batch.column(0).to_pylist():
                if t:
                    found.add(masked(t, html))
            if len(found.n) > FLUSH:
                yield _flush(found)
                found = Evidence()
        yield _flush(found)

    parts = texts.select("text").mapInArrow(run, _COUNTED)
    return parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _evidence_and_asked(rows: DataFrame) -> DataFrame:
    """Two kinds of rows from one pass over field, doc_id, text: word and COUNTS of parts of the texts, and field, doc_id and the words
    that the record asks the corpus about."""
    schema = f"{_COUNTED}, field string, doc_id string, asked array<string>"
    kinds = {"field": pa.string(), "doc_id": pa.string(), "asked": pa.list_(pa.string())}

    def counted(found: Evidence) -> pa.RecordBatch:
        made = _flush(found)
        return pa.RecordBatch.from_arrays([*made.columns, *[pa.nulls(len(made), k) for k in kinds.values()]], names=[*made.schema.names, *kinds])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Evidence()
        for batch in it:
            lists = []
            for f, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                m = masked(t, True)
                found.add(m)
                lists.append(list(asked(m if f.endswith(".text") else masked(t, False))))
            n = len(lists)
            empty = [pa.nulls(n, pa.string()), *[pa.nulls(n, pa.int64()) for _ in COUNTS]]
            yield pa.RecordBatch.from_arrays([*empty, batch.column(0), batch.column(1), pa.array(lists, kinds["asked"])], names=["word", *COUNTS, *kinds])
            if len(found.n) > FLUSH:
                yield counted(found)
                found = Evidence()
        yield counted(found)

    return rows.mapInArrow(run, schema)


def _by_low(counts: DataFrame, share: float) -> DataFrame:
    """low, common, short, often of each word in lower case; ``often``: it makes at least ``share`` of all words."""
    n_low = F.sum(F.when(F.col("word") == F.lower("word"), F.col("n")).otherwise(0)).alias("n_low")
    merged = checkpoint(counts.groupBy(F.lower("word").alias("low")).agg(n_low, *[F.sum(c).alias(c) for c in COUNTS]))  # read several times
    total = merged.agg(F.sum("n")).first()[0] or 0
    often = (F.col("n") >= total * share) & (F.col("n") >= 2)
    return merged.select("low", (F.col("n_low") >= 0.05 * F.col("n")).alias("common"), _is_abbreviation(*map(F.col, COUNTS), 3).alias("short"), often.alias("often"))


def _handed_out(words: DataFrame) -> Lexicon:
    rows = words.where(F.col("often") & (F.col("common") | F.col("short"))).collect()  # at most 1 / share
    return Lexicon(frozenset(r["low"] for r in rows if r["common"]), frozenset(r["low"] for r in rows if r["short"]))


def learn(texts: DataFrame, html: bool = True, share: float = SHARE) -> Lexicon:
    """The corpus lexicon: words that make at least ``share`` of all words, so that no more than 1 / share of them can be handed out."""
    return _handed_out(_by_low(word_evidence(texts, html), share))


def _learn_for(rows: DataFrame, share: float = SHARE) -> tuple[Lexicon, DataFrame]:
    """The lexicon of frequent words, and what the corpus says of the rest: field, doc_id, common, short, the latter two arrays of those
    words of that kind that the record asks about."""
    made = checkpoint(_evidence_and_asked(rows))  # read twice, and smaller than the texts
    words = _by_low(made.where(F.col("word").isNotNull()), share)
    pairs = made.where(F.col("field").isNotNull()).select("field", "doc_id", F.explode("asked").alias("low"))
    often = words.where("often").select("low")  # at most 1 / share; without them no word is asked about by many
    said = pairs.join(F.broadcast(often), "low", "left_anti").join(words.where(~F.col("often") & (F.col("common") | F.col("short"))), "low")
    return _handed_out(words), said.groupBy("field", "doc_id").agg(*[F.collect_set(F.when(F.col(c), F.col("low"))).alias(c) for c in ("common", "short")])


def split_sentences(texts: DataFrame, lexicon: Lexicon | None = None, share: float = SHARE) -> DataFrame:
    """field, doc_id, sent_start, sent_end: the units of each record.

    ``texts`` has field, doc_id, text; fields that end in ".text" hold HTML, others plain text. Without a lexicon one is learned from
    ``texts``, with all words, however rare; ``share`` only parts those that are handed to all tasks from those that are joined. Repeated rows of one doc_id give their units once. Null and empty texts, and such with nothing visible, have none; rows
    without doc_id are left out.
    """
    rows = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    rows = rows.select("field", F.col("doc_id").cast("string").alias("doc_id"), "text")
    if lexicon is None:
        lexicon, said = _learn_for(rows, share)
        rows = rows.join(said, ["field", "doc_id"], "left")
    else:
        rows = rows.select("*", *[F.lit(None).cast("array<string>").alias(c) for c in ("common", "short")])
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(shared.value)
        for batch in it:
            begins, ends, edge = [], [], [0]
            for f, t, common, short in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4)], strict=True):
                for a, b in splitter.split(t, f.endswith(".text"), Lexicon(frozenset(common or ()), frozenset(short or ()))):
                    begins.append(a)
                    ends.append(b)
                edge.append(len(begins))
            offsets = pa.array(edge, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (begins, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["field", "doc_id", "a", "b"])

    made = rows.mapInArrow(run, "field string, doc_id string, a array<bigint>, b array<bigint>")
    once = made.groupBy("field", "doc_id").agg(F.min(F.struct("a", "b")).alias("u"))
    return once.select("field", "doc_id", F.explode(F.arrays_zip("u.a", "u.b")).alias("x")).select("field", "doc_id", F.col("x.a").alias("sent_start"), F.col("x.b").alias("sent_end"))
