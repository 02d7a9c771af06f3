import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stylograph.llm import shared_spans as P


def brute(rows, length):
    where = {}
    for f, i, t in rows:
        for j in range(len(t) - length + 1):
            where.setdefault((f, t[j : j + length]), set()).add(i)
    out = set()
    for f, i, t in rows:
        marks = [False] * (len(t) + 1)
        for j in range(len(t) - length + 1):
            if len(where[f, t[j : j + length]]) > 1:
                marks[j : j + length] = [True] * length
        start = None
        for k, m in enumerate(marks):
            if m and start is None:
                start = k
            if not m and start is not None:
                out.add((f, i, start, k))
                start = None
    return out


def sample(seed, n, alphabet="abcdefgh ščř😀"):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [word(rng.randint(15, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice([word(rng.randint(0, 30)), rng.choice(shared), rng.choice(shared)[3:-2]]) for _ in range(rng.randint(0, 6)))
        rows.append((rng.choice(["f", "g"]), f"d{i}", text))
    return rows


@pytest.mark.parametrize(("most", "shard"), [(1000, 200_000), (3, 200_000), (1, 200_000), (1000, 60), (1000, 0), (2, 60)])
def test_equals_brute_force(spark, most, shard):
    rows = sample(1, 60) + [("f", "r1", "a" * 90), ("f", "r2", "b" + "a" * 50), ("f", "self", "xyzw" * 30), ("g", "e", "")]
    df = spark.createDataFrame(rows, "field string, doc_id string, text string")
    got = [tuple(r) for r in P.shared_spans(df, 20, most, shard).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 20) and got


def test_plain_form_gives_the_same(spark):
    rows = sample(4, 40)
    df = spark.createDataFrame([*rows, rows[3]], "field string, doc_id string, text string")
    assert {tuple(r) for r in P.broadcast_spans(df, 20, 500).collect()} == brute(rows, 20)
    assert P.broadcast_spans(df.limit(0)).count() == 0


def test_texts_without_their_shared_stretches(spark):
    rows = sample(7, 40)
    made = {(r.field, r.doc_id): r for r in P.without_shared(spark.createDataFrame(rows, "field string, doc_id string, text string"), 20).collect()}
    cut = {}
    for f, i, a, b in brute(rows, 20):
        cut.setdefault((f, i), set()).update(range(a, b))
    for f, i, t in rows:
        r = made[f, i]
        assert r.text == "".join(c for k, c in enumerate(t) if k not in cut.get((f, i), ())) and (r.n_chars, r.n_left) == (len(t), len(r.text))


def sent(texts, length=100):
    """What is shuffled of texts whose anchors are all shared: cells and code points."""
    import pyarrow as pa

    h = P.Hashed(texts)
    anchors = np.unique(P.anchor_places(h, length)[1]).view(np.int64).tolist()
    n = len(texts)
    kinds = pa.list_(pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * n), pa.array([f"d{i}" for i in range(n)]), pa.array(texts), pa.array([anchors] * n, kinds), pa.array([[0] * len(anchors)] * n, kinds)], names=["field", "doc_id", "text", "h", "part"])
    out = [b for b in P._send(length)(iter([batch]))]
    return sum(b.num_rows for b in out), sum(len(t) for b in out for t in b.column(3).to_pylist()), sum(len(p) for b in out for p in b.column(5).to_pylist())


@pytest.mark.parametrize("period", ["_", "0123456789", "abcdefg", "Tento sloupec se opakuje v každém řádku tabulky, a to beze změny; "])
def test_texts_that_repeat_themselves_send_little(period):
    text = (period * 20_000)[:20_000]
    _, chars, places = sent([text])
    assert chars + 4 * places < 3 * len(text)


def test_runs_of_one_letter_and_tables(spark):
    table = "".join(f"Řádek tabulky, který se opakuje skoro beze změny a liší se jen číslem {i * 7919 % 997}.\n" for i in range(60))
    rows = [("f", "u", "_" * 3000), ("f", "v", "x" + "_" * 150), ("f", "t1", table), ("f", "t2", table[1000:3000] + "!"), ("f", "p", "0123456789" * 200), ("f", "q", "5" + "0123456789" * 30)]
    df = spark.createDataFrame(rows, "field string, doc_id string, text string")
    want = brute(rows, 100)
    for most, shard in ((1000, 200_000), (1000, 500), (1, 200_000)):
        assert {tuple(r) for r in P.shared_spans(df, most=most, shard=shard).collect()} == want


def test_rows_that_give_nothing(spark):
    t = "".join(chr(97 + i * 7 % 26) + chr(97 + i * i % 23) for i in range(80))
    rows = [("f", "a", t), ("f", "a", t), ("f", None, t), ("f", "b", None), ("g", "c", t), ("f", "d", t[:99])]
    df = spark.createDataFrame(rows, "field string, doc_id string, text string")
    assert P.shared_spans(df).count() == 0 and P.shared_spans(df.limit(0)).count() == 0
    two = df.unionByName(spark.createDataFrame([("f", "z", "!" + t)], df.schema))
    assert {tuple(r) for r in P.shared_spans(two).collect()} == {("f", "a", 0, 160), ("f", "z", 1, 161)}
    shares = {(r.field, r.doc_id): (r.n_chars, r.shared_chars, r.share) for r in P.shared_shares(two).collect()}
    assert shares["f", "a"] == (160, 160, 1.0) and shares["g", "c"] == (160, 0, 0.0)


def test_phrase_of_all_records(spark):
    phrase = "Tato věta stojí ve všech textech a je dost dlouhá na to, aby se počítala mezi sdílené úseky, jak se má stát."
    rows = [("f", f"d{i}", f"{i:04} {i * 7919 % 1000}{phrase}{i * 31 % 997} konec") for i in range(400)]
    df = spark.createDataFrame(rows, "field string, doc_id string, text string")
    got = {tuple(r) for r in P.shared_spans(df, most=50).collect()}
    assert got == brute(rows, 100) and len(got) == 400


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=25), min_size=1, max_size=5), st.integers(1, 6))
def test_automaton(texts, length):
    who = {}
    for i, t in enumerate(texts):
        i = str(i)
        low, high = who.get(t, (i, i))
        who[t] = min(low, i), max(high, i)
    made = P.Automaton(who)
    for i, t in enumerate(texts):
        want = [j for j in range(len(t) - length + 1) if any(t[j : j + length] in u for k, u in enumerate(texts) if k != i)]
        assert made.matched(t, str(i), length) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=40), min_size=1, max_size=4))
def test_every_window_has_its_anchor_among_the_anchors(texts):
    h = P.Hashed(texts)
    _, anchors = P.anchor_places(h, 10)
    at, anchor = P.windows(h, 10, np.unique(anchors))
    assert len(at) == sum(max(0, len(t) - 9) for t in texts) and set(anchor.tolist()) <= set(anchors.tolist())
