import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stylograph.llm import lookalike as L

FORM = L.Former(L.pair_scores(np.zeros(L.LIMIT * L.LIMIT, np.int64))).form

SAME = [("Soud má názor č. 12", "Ｓｏｕｄ má názor č. １2"), ("soudce", "s​ou­dce"), ("náleží", unicodedata.normalize("NFD", "náleží")), ("soud podle", "ѕоud pоdle"), ("IV. ÚS", "Ⅳ. ÚS"), ("Kč 5-3", "Kč 5‑3"), ("ostatně", "οѕtatně"), ("решение суда", "pешение cуда"), ("ﬁnal", "final"), ("se a to", "ѕе а to")]
OTHER = [("soud", "soudu"), ("m²", "m2"), ("soudě", "soude"), ("5", "6"), ("a b", "ab"), ("č", "c"), ("№ 5", "No 5"), ("Soud", "soud")]


def test_same_and_other():
    for a, b in SAME:
        assert FORM(a) == FORM(b) == FORM(FORM(b)), (a, b)
    for a, b in OTHER:
        assert FORM(a) != FORM(b), (a, b)


def test_script_is_kept():
    assert FORM("pешение cуда") == "решение суда" and FORM("ѕоud") == "soud" and FORM("") == ""


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aecоpѕ tжαβοřšК K1.", max_size=12), st.data())
def test_form_hangs_only_on_looks(text, data):
    """Whichever look-alike letters are stored, the form is the same."""
    swapped = "".join(data.draw(st.sampled_from([x for x in L.LOOKS[c] if x])) if c in L.LOOKS else c for c in text)
    assert FORM(swapped) == FORM(text)


def test_pairs(spark):
    rows = [("f", "d1", "Soud má"), ("f", "d2", "Sоud má"), ("f", "d3", "Soud má"), ("f", "d3", "Soud má"), ("g", "d4", "Sоud má"), ("f", "d5", "Soud ma"), ("f", "d6", " "), ("f", "d7", " "), ("f", None, "Sоud má"), ("f", "d8", None), ("f", "d9", "x" * 300_000), ("f", "e1", "х" * 300_000)]
    df = spark.createDataFrame(rows, "field string, doc_id string, text string")
    for split in (1000, 1):
        assert sorted(tuple(r) for r in L.same_looks(df, split).collect()) == [("f", "d1", "d2"), ("f", "d2", "d3"), ("f", "d9", "e1")]
    assert {tuple(r) for r in L.look_classes(df).collect()} == {("f", "d1", "d1", "d1", 3), ("f", "d2", "d2", "d1", 3), ("f", "d3", "d1", "d1", 3), ("f", "d9", "d9", "d9", 2), ("f", "e1", "e1", "d9", 2)}
    assert L.look_classes(df.limit(0)).count() == 0
    assert L.same_looks(df.limit(0)).count() == 0
    forms = {r.doc_id: r.form for r in L.uniform_texts(df.where("field = 'f' and length(text) < 20"), ["field", "doc_id"]).collect()}
    assert forms["d2"] == "Soud má" and forms["d7"] == " "


def test_a_look_of_most_records(spark):
    """Many records of few stored texts, and of many: the pairs are those of different stored texts."""
    spell = ["soud má", "ѕoud má", "sоud má", "soud\u00a0má", "ｓoud má"]
    rows = [("f", f"a{i:03}", spell[0]) for i in range(150)] + [("f", f"b{i:03}", spell[1 + i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "field string, doc_id string, text string")
    want = {("f", min(x, y), max(x, y)) for _, x, t in rows for _, y, u in rows if x < y and t != u}
    got = [tuple(r) for r in L.same_looks(df, 20).collect()]
    assert set(got) == want and len(got) == len(want)
