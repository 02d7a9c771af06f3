import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stylograph.llm import tokenize as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


def ids(texts):
    made, counts, _ = T.merger(T.VOCABULARY).encode(texts)
    out, at = [], 0
    for n in counts:
        out.append(made[at : at + n].tolist())
        at += n
    return out


TEXTS = ["", " ", "I'll we've 's'sx 'rest ''s", "a  \n b", "\n\n\nq", "<|endoftext|> x", "x 　y", "a" * 300, "²³Ⅳ ½", "Soud č. j. 12/2020, náleží…", "法院判决。平等", "ความเห็นศาล", "😀👩‍👩‍👧 \t\r\n", "'d 'll'll'm", "x'", " 's"]


def test_equals_library(library):
    assert ids(TEXTS) == [e.ids for e in library.encode_batch(TEXTS, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aé's tvrelmd1²\n\t  　.法ก", max_size=20), max_size=4))
def test_property(library, texts):
    assert ids(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_round_trip(text):
    assert T.decode(ids([text])[0]) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aé ščř法😀1.\n", max_size=20), max_size=4))
def test_each_id_has_its_place(texts):
    made, counts, offsets = T.merger(T.VOCABULARY).encode(texts, True)
    known, at = T.merger(T.VOCABULARY).bytes, 0
    for t, n in zip(texts, counts):
        seen = 0
        for k in range(at, at + n):
            whole = len(t.encode()[:seen].decode("utf-8", "ignore"))
            assert offsets[k] == whole
            seen += len(known[made[k]])
        at += n


def test_operator(spark):
    rows = [(1, "Soud má", "x"), (2, "", "x"), (3, None, "x"), (1, "Soud má", "x"), (None, "a", "x"), (4, "slovo " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = T.encode(df, offsets=True).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[2].ids == by[3].ids == [] and T.decode(by[1].ids) == "Soud má"
    assert by[1].offsets[0] == 0 and max(by[1].offsets) == 6 and len(by[4].ids) >= 50_000
    back = {r.doc_id: r.text for r in T.decode_texts(T.encode(df)).collect()}
    assert back[1] == "Soud má" and back[2] == back[3] == "" and back[4] == "slovo " * 50_000
    counts = {r.doc_id: r.n_tokens for r in T.token_counts(df, ["doc_id"]).collect()}
    assert counts == {r.doc_id: len(r.ids) for r in got}
    assert T.encode(df.limit(0)).count() == 0
