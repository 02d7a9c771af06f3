import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stylograph.llm import sentences as S

CORPUS = ["Sp. zn. II. ÚS 5/90. Podle sp. zn. I. ÚS 6/90 soud rozhodl podle zák. č. 5 a odst. 2 věta. To je věta např. Novák a tzv. věc je. Soudce má názor, soud také; zásady a další.", "Dle zák. č. 7 soud má např. věci. Další zásada. Podle JUDr. Nováka a sp. zn. I. ÚS 2/90."] * 6
SPLIT = S.Splitter(S.lexicon_of(CORPUS))

CASES = [
    ("Soud má věci. Další věc je zde.", ["Soud má věci.", "Další věc je zde."]),
    ("Podle § 5 zák. č. 3/2000 Sb. zásady platí.", None),
    ("Dne 9. 3. 2020 soud, verze 7.1.3, ve výši 363.909,- Kč rozhodl.", None),
    ("Tak V. K. Lumvet a JUDr. Novotný.", None),
    ("sp. zn. IV. ÚS 4/94", None),
    ("Byl např. Novák. Soud má zák. Další věc.", ["Byl např. Novák.", "Soud má zák.", "Další věc."]),
    ("1. Soud má věc. 2. Další věc.", ["1. Soud má věc.", "2. Další věc."]),
    ("Uvedl „Je to tak! Není to?“ soud a další.", None),
    ("Uvedl: „Je to tak.“ Soud má věc.", ["Uvedl: „Je to tak.“", "Soud má věc."]),
    ("Soud (viz věc. Další zde.) má názor.", None),
    ("Soud má… názor. Tak… Soud má.", ["Soud má… názor.", "Tak…", "Soud má."]),
    ("Soud má věc.Další věc?! Soud.", ["Soud má věc.", "Další věc?!", "Soud."]),
    ("Soud\nmá věc\n\nDalší věc", ["Soud\nmá věc", "Další věc"]),
    ("法院判决。原则是平等！是的", ["法院判决。", "原则是平等！", "是的"]),
    ("法院说“判决。平等。”宪法。原则", ["法院说“判决。平等。”宪法。", "原则"]),
    ("यह है। वह था। क्या?", ["यह है।", "वह था।", "क्या?"]),
    ("ความเห็นศาล กฎหมายรัฐ", ["ความเห็นศาล", "กฎหมายรัฐ"]),
    ("ما الحق? هذا 4.5 في المئة. كما", ["ما الحق?", "هذا 4.5 في المئة.", "كما"]),
    ("   ", []),
    ("", []),
    ("​\xa0", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_plain(text, want):
    assert [text[a:b] for a, b in SPLIT.split(text)] == ([text] if want is None else want)


def test_html():
    text = "<p>sp. zn. I. ÚS 1/94</p>\n<H2 class='x'>NÁLEZ</H2><p>(1) <b>Soud</b>&nbsp;má <i>věc.</i> Další&#160;věc<br/>a ještě</p><li>a) prvek,</li><p>&nbsp;</p>"
    assert [text[a:b] for a, b in SPLIT.split(text, True)] == ["sp. zn. I. ÚS 1/94", "NÁLEZ", "(1) <b>Soud</b>&nbsp;má <i>věc.", "Další&#160;věc", "a ještě", "a) prvek,"]


OWN = [
    # the corpus does not know "zkr"; this document has it before a comma
    ("Byla zkr., a soud má zkr. Lumvet.", ["Byla zkr., a soud má zkr. Lumvet."]),
    # the corpus has "zák" for an abbreviation; in this document it is a word
    ("Onen zák byl zák a jiný zák má zák. Lumvet byl.", ["Onen zák byl zák a jiný zák má zák.", "Lumvet byl."]),
    # the corpus has "další" in lower case; here it is a name in mid-sentence
    ("Pan Další má názor dle zák. Další.", ["Pan Další má názor dle zák. Další."]),
    ("Soud má názor dle zák. Další.", ["Soud má názor dle zák.", "Další."]),
    # an abbreviation and a name of the document's own, whatever the corpus says of "další"
    ("Pan Další přišel a Další mluvil. Byl to např. Další.", ["Pan Další přišel a Další mluvil.", "Byl to např. Další."]),
    # an abbreviation opens no sentence by itself: what stands behind it decides, here a name, there a word that the document has in lower case
    ("Dle ust. zásady a ust. obce. Dle ust. Lumvet.", ["Dle ust. zásady a ust. obce.", "Dle ust. Lumvet."]),
    ("Dle ust. zásady a ust. obce. Dle ust. Zásady platí.", ["Dle ust. zásady a ust. obce.", "Dle ust.", "Zásady platí."]),
    # invisible characters and separate accents
    ("Byla zk\u200br., a soud má zkr\xad. Lumvet.", ["Byla zk\u200br., a soud má zkr\xad. Lumvet."]),
    ("Byla zkŕ., a soud má zkr\u0301. Lumvet.", ["Byla zkŕ., a soud má zkr\u0301. Lumvet."]),
    # contradictions and list letters are no evidence: the corpus answers
    ("Soud má věc. a) Další prvek, b) věc. Lumvet.", ["Soud má věc. a) Další prvek, b) věc.", "Lumvet."]),
]


@pytest.mark.parametrize("text,want", OWN)
def test_the_document_is_asked_first(text, want):
    assert [text[a:b] for a, b in SPLIT.split(text)] == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aA1.!?…„“\"() \n<>/p&;b​。", max_size=40))
def test_units_are_in_order_and_trimmed(text):
    last = 0
    for a, b in SPLIT.split(text, True):
        assert last <= a < b <= len(text) and not text[a].isspace() and not text[b - 1].isspace()
        last = b


def test_operator(spark):
    rows = [("subset.text", "d1", "<p>Soud má. Další věc.</p>"), ("subset.text", "d1", "<p>Soud má. Další věc.</p>"), ("x.extracted", "d1", "a < bé. Soud"), ("subset.text", "d2", ""), ("subset.text", "d3", None), ("subset.text", None, "Soud."), ("x.extracted", "d4", "Má soud věc. Věc má soud. " * 10_000)]
    df = spark.createDataFrame(rows, "field string, doc_id string, text string")
    got = S.split_sentences(df).collect()
    assert sorted((r.field, r.doc_id, r.sent_start, r.sent_end) for r in got if r.doc_id != "d4") == [("subset.text", "d1", 3, 11), ("subset.text", "d1", 12, 22), ("x.extracted", "d1", 0, 7), ("x.extracted", "d1", 8, 12)]
    assert sum(r.doc_id == "d4" for r in got) == 20_000
    assert S.split_sentences(df.limit(0)).count() == 0


def test_corpus_evidence_counts_all(spark):
    df = spark.createDataFrame([(t,) for t in CORPUS], "text string")
    got = {r.word: (r.n, r.stops, r.goes_on, r.closes) for r in S.word_evidence(df).collect()}
    assert got["zák"] == (12, 12, 12, 0) and got["věta"] == (12, 6, 0, 0) and got["další"] == (6, 6, 0, 6) and got["soud"][0] == len(re.findall(r"\bsoud\b", " ".join(CORPUS)))
    lex = S.learn(df)
    assert "zák" in lex.short and "soud" in lex.common and "věta" not in lex.short and "judr" in lex.short


def test_rare_words_of_a_large_corpus_count(spark):
    """Three occurrences among 2.4 million words settle a boundary of another document."""
    filler = [("subset.text", f"f{i}", "soud má věc " * 100_000) for i in range(8)]
    seen = [("subset.text", f"s{i}", "Byla zkr., a pak lumvet.") for i in range(3)]
    rows = [*filler, *seen, ("subset.text", "short", "Dle zkr. Novák."), ("subset.text", "common", "Dle zkr. Lumvet."), ("x.extracted", "wide", "Dle ｚｋｒ. Novák. Soud")]
    got = S.split_sentences(spark.createDataFrame(rows, "field string, doc_id string, text string").repartition(4)).where("not doc_id like 'f%'").collect()
    units = {d: sorted((r.sent_start, r.sent_end) for r in got if r.doc_id == d) for d in ("short", "common", "wide")}
    assert units == {"short": [(0, 15)], "common": [(0, 8), (9, 16)], "wide": [(0, 15), (16, 20)]}


def test_how_words_reach_the_tasks_changes_nothing(spark, data):
    """All words handed out, some, and none: the units are the same."""
    from stylograph.llm.queries import _texts

    made = [sorted(map(tuple, S.split_sentences(_texts(spark, data), share=x).collect())) for x in (0.0, 2e-4, 2.0)]
    assert made[0] == made[1] == made[2] and len(made[0]) > 1000


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbBčČ²1İΣσ., ()", max_size=40), st.lists(st.text(alphabet="aAbBčČ²İΣσ", min_size=1, max_size=2), max_size=5))
def test_searching_one_by_one_and_counting_all_are_the_same(text, words):
    one, all_ = S.Document(text), S.Document(text)
    all_.left = 0
    for w in words:
        assert one._count(w) == all_._count(w), w
        assert one.common(w) == all_.common(w) and one.short(w) == all_.short(w), w


def test_a_sign_behind_a_stop_is_no_word(ten_seconds):
    for text in ("Soud má věc. § 5 platí.", "Dle odst. 1. § 5 zák. platí.", "Soud má věc.(Další věc.)", "Dle čl. § 7 soud."):
        units = SPLIT.split(text)
        assert units[0][0] == 0 and units[-1][1] == len(text)
    assert [t.strip() for t in ("Soud má věc. § 5 platí."[a:b] for a, b in SPLIT.split("Soud má věc. § 5 platí."))] == ["Soud má věc.", "§ 5 platí."]
    assert [len(SPLIT.split(t)) for t in ("Dle zák. § 7 soud.", "Věc č. 1. § 5 platí.")] == [1, 1]


@pytest.mark.parametrize("word", ["", "q̌", "1a", "Q̌a"])
def test_what_is_no_word_is_not_asked_about(ten_seconds, word):
    text = "Dle q̌., 1a., q̌., a 1a. Q̌a byl q̌a. Pan Q̌a a pan Q̌a."
    one, all_ = S.Document(text), S.Document(text)
    all_.left = 0
    assert one._count(word) == all_._count(word) == 0
    assert one.common(word) is all_.common(word) is None and one.short(word) is all_.short(word) is None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbBč̌Ž1.!?…„“\"() \n<>/p&;ａ\u200b", max_size=40), st.booleans())
def test_all_words_that_are_looked_up_are_asked_for(text, html):
    class Seen(frozenset):
        def __contains__(self, word):
            looked.add(word)
            return False

    looked: set[str] = set()
    S.Splitter(S.Lexicon(Seen(), Seen())).split(text, html)
    assert {w for w in looked if S.WORD.fullmatch(w)} <= S.asked(S.masked(text, html)) | {""}
