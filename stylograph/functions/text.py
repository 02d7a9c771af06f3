"""Column expressions on text; all stay inside the JVM."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python and R see it: Unicode white space and the four separators U+001C to U+001F.
WS = r"(?U)[\s\x{1C}-\x{1F}]"

#: Named entities, those of HTML 4 and the one of XML, with the character each stands for.
NAMED_ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}
ENTITY = r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,7});"

#: The headings that open a separate opinion.
MARKERS = ("Odlišné stanovisko", "Odlišné-doplňující stanovisko", "Konkurující stanovisko")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squish(x: Column | str) -> Column:
    """Each run of white space becomes one space, none stays at the ends; null stays null."""
    return F.trim(F.regexp_replace(_col(x), WS + "+", " "))


def trim_ws(x: Column | str) -> Column:
    """Cast to string and strip Unicode white space from both ends; null stays null."""
    inner = WS.removeprefix("(?U)")
    return F.regexp_replace(_col(x).cast("string"), f"(?U)^{inner}+|{inner}+$", "")


def clean_text(x: Column | str) -> Column:
    """White space to single spaces, named entities to a space, en and em dashes to a hyphen; null gives ''."""
    once = squish(F.coalesce(_col(x), F.lit("")))
    plain = F.translate(F.regexp_replace(once, "&[a-zA-Z]+;", " "), "–—", "--")
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def word_count(x: Column | str) -> Column:
    """Number of runs without white space; null gives 0."""
    return F.coalesce(F.regexp_count(_col(x), F.lit(r"(?U)[^\s\x{1C}-\x{1F}]+")), F.lit(0))


def html_to_text(x: Column | str) -> Column:
    """Text nodes of HTML put together without a separator, comments dropped, entities decoded; null stays null.

    Entities are decimal, hexadecimal or named; those that are not known, or of no character, stay as they are, as do characters that open
    no tag.
    """
    bare = F.regexp_replace(_col(x), r"(?s)<!--.*?-->|</?[a-zA-Z][^<>]*>|<![a-zA-Z][^<>]*>", "")
    named = F.from_json(F.lit(json.dumps(NAMED_ENTITIES)), "map<string,string>")  # folded into a constant
    code = lambda e: F.when(F.substring(e, 2, 1).isin("x", "X"), F.conv(F.substring(e, 3, 6), 16, 10)).otherwise(F.substring(e, 2, 7)).cast("int")
    real = lambda n: n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    char = lambda e: F.when(e.startswith("#"), F.when(real(code(e)), F.decode(F.unhex(F.lpad(F.hex(code(e)), 8, "0")), "UTF-32"))).otherwise(F.try_element_at(named, e))
    known = F.transform(F.array_distinct(F.regexp_extract_all(bare, F.lit(ENTITY), F.lit(1))), lambda e: F.struct(e.alias("e"), char(e).alias("c")))
    known = F.filter(known, lambda p: p["c"].isNotNull() & (p["c"] != "&"))
    out = F.aggregate(known, bare, lambda acc, p: F.replace(acc, F.concat(F.lit("&"), p["e"], F.lit(";")), p["c"]))
    return F.regexp_replace(out, "&(?:amp|#0*38|#[xX]0*26);", "&")  # last and at once, so that it opens no other entity


def extract_after_marker(x: Column | str, markers: Sequence[str] = MARKERS) -> Column:
    """The text after the paragraph of the first marker, in any letter case; null where there is no marker or nothing after it.

    The paragraph ends at the first blank line; without one, the text goes on right after the marker.
    """
    one_of = "|".join(re.escape(m) for m in markers)
    found, blank = rf"(?ius)^.*?(?:{one_of})", r"(?sU)^.*?\n\s*\n"

    def behind(plain: Column) -> Column:
        rest = _once(trim_ws(F.regexp_replace(plain, found, "")), lambda after: F.regexp_replace(after, blank, ""))
        return F.when(plain.rlike(rf"(?iu){one_of}"), F.nullif(trim_ws(rest), F.lit("")))

    return _once(html_to_text(F.replace(_col(x), F.lit("&nbsp;"), F.lit(" "))), behind)


def _once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x evaluated once, however often it is used."""
    return F.transform(F.array(x), use)[0]
