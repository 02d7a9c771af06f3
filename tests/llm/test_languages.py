import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stylograph.llm import languages as L
from stylograph.session import evened


@pytest.fixture(scope="module")
def samples(spark, data):
    return [(r.lang, r.text) for r in spark.read.parquet(f"{data}/lang_samples.parquet").orderBy("lang", "sample_no").collect()]


@pytest.fixture(scope="module")
def held_out(samples):
    """A model of four fifths of the samples, and the rest by language."""
    test = {}
    for i, (lang, text) in enumerate(samples):
        if i % 5 == 0:
            test.setdefault(lang, []).append(text)
    return L.Model([x for i, x in enumerate(samples) if i % 5]), test


def test_held_out_texts(held_out):
    model, test = held_out
    texts = [(lang, t) for lang, ts in test.items() for t in ts]
    got = L.Labeller(model).label([t for _, t in texts])
    hits = sum(len(g) == 1 and g[0][2] == lang for g, (lang, _) in zip(got, texts))
    assert hits / len(texts) > 0.93


def test_held_out_mixtures(held_out):
    model, test = held_out
    rng = random.Random(5)
    texts, want = [], []
    for _ in range(150):
        langs = rng.sample(sorted(test), rng.choice([2, 2, 3]))
        parts = [rng.choice(test[x]) for x in langs]
        at, cut = 0, []
        for lang, p in zip(langs, parts):
            cut.append((at, lang))
            at += len(p) + 2
        texts.append("\n\n".join(parts))
        want.append(cut)
    got = [[(a, lang) for a, _, lang, _ in g] for g in L.Labeller(model).label(texts)]
    assert sum(g == w for g, w in zip(got, want)) / len(want) > 0.85


def test_operator(spark, samples):
    model = L.Model(samples)
    cs, de = (next(t for lang, t in samples if lang == x) for x in ("cs", "de"))
    rows = [(1, cs, "cs", 5), (2, cs, "de", 5), (3, cs, None, 5), (4, f"{cs}\n\n{de}", "cs", 5), (5, None, "cs", 5), (6, "", None, 5), (7, "123 …", None, 5), (8, cs, "cs-CZ", 5), (9, (de + " ") * 300, "de", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, seg_start int")
    got = sorted(tuple(r) for r in L.wrong_or_mixed(df, model).collect())
    assert got == [(2, 0, "cs"), (3, 0, "cs"), (4, 0, "cs"), (4, len(cs) + 2, "de"), (8, 0, "cs")]
    labels = {r.doc_id: (r.lang, r.n_langs) for r in L.document_labels(df, model).collect()}
    assert labels[1] == ("cs", 1) and labels[4][1] == 2 and 7 not in labels
    assert all(0 < r.confidence <= 1 for r in L.segments(df, model, ["doc_id"]).collect())
    assert L.wrong_or_mixed(df.limit(0), model).count() == 0


def test_texts_with_signs_behind_stops_end(samples, ten_seconds):
    cs = next(t for lang, t in samples if lang == "cs")
    got = L.Labeller(L.Model(samples, calibrate=False)).label([f"Soud rozhodl podle čl. § 5 zákona. § 7 platí. {cs}", "Soud má věc.(Další věc je zde.)"])
    assert [[(a, lang) for a, _, lang, _ in g] for g in got] == [[(0, "cs")], [(0, "cs")]]


def test_words_inside_a_sentence_make_no_stretch(samples):
    cs = next(t for lang, t in samples if lang == "cs")
    got = L.Labeller(L.Model(samples)).label([f"Soud uvedl, že „the court held. Was it not?“ má být posouzeno jako návrh stěžovatele. {cs}"])
    assert [g[2] for g in got[0]] == ["cs"]


def test_words_beside_scripts_without_spaces_stay():
    assert L.words_of("法院 ve\u030cc so\0ud ก\u0e33ก\u0e34 a") == ["法", "院", "ve\u030cc", "so\0ud", "ก", "\u0e33", "ก", "a"]
    assert L.words_of("法 ve\u030cc") == ["法", *L.words_of("ve\u030cc")]


def test_confidence_is_calibrated_on_held_out_pieces(held_out):
    model, test = held_out
    pieces = []
    for lang, texts in test.items():
        for t in texts:
            w = t.split()
            for size in (1, 2, 3, 5, 8, 13, 21):
                pieces += [(lang, " ".join(w[at : at + size])) for at in range(0, len(w) - size + 1, size)]
    bins = {}
    for (lang, _), g in zip(pieces, L.Labeller(model).label([p for _, p in pieces])):
        if len(g) == 1:
            bins.setdefault(min(9, int(10 * g[0][3])), []).append((g[0][3], g[0][2] == lang))
    for b, rows in bins.items():
        if len(rows) >= 100:
            assert abs(sum(c for c, _ in rows) / len(rows) - sum(h for _, h in rows) / len(rows)) < 0.1, b
    assert len(bins) > 4


def test_languages_that_no_sample_has_are_unknown(held_out):
    model, test = held_out
    foreign = [
        "Perustuslakituomioistuin katsoo, että valituksenalainen päätös on lainvastainen eikä sitä voida panna täytäntöön ennen asian lopullista ratkaisua.",
        "헌법재판소는 이 사건 심판청구를 기각한다. 재판관 전원의 일치된 의견으로 결정한다.",
        "Anayasa Mahkemesi başvurunun reddine oybirliğiyle karar verdi ve gerekçeyi açıkladı.",
    ]
    assert all(len(g) == 1 and g[0][2] == L.UNKNOWN and g[0][3] > 0.8 for g in L.Labeller(model).label(foreign))
    known = [t for ts in test.values() for t in ts]
    assert not any(s[2] == L.UNKNOWN for g in L.Labeller(model).label(known) for s in g)
    assert L.Model([("a", "slovo")]).foreign("a", -1.0, 5) == 0.0  # too few samples to tell


PARTS = st.lists(st.sampled_from(["soud", "Soud", "č", "JUDr", "I", "The court", "Листина", "法院", "ก", "5", "12", "§", "a\u030c", "\u0301", ".", ".", ". ", "..", "… ", "!", "?! ", "।", "。", " ", " ", "\n", "\r\n", "\n \n", "\0", "\xad", "„", "“", '"', "(", ") ", "[", "]", ",", ":", "- ", "</b>", "<b>", "<p>", "&nbsp;", "&lt;"]), max_size=25).map("".join)


@given(st.lists(PARTS, min_size=1, max_size=4))
@settings(max_examples=500, deadline=None)
def test_units_end_at_possible_ends_only(texts):
    splitter = L.Splitter(L.lexicon_of(["soud the court. Soud č. 5, JUDr. Soud č. soud."]))
    shown = L.Shown([L.masked(t, True) for t in texts])
    ends = shown.ends()
    for k, t in enumerate(texts):
        units = splitter.split(t, True)
        m = splitter.text
        if shown.spaceless[k]:
            continue
        words = [shown.words(k, a, b) for a, b in units]
        assert words == [L.words_of(m[a:b]) for a, b in units]
        assert sum(words, []) == L.words_of(m) == shown.words(k, 0, len(m))
        own = [int(e - shown.begin[k]) for e in ends if shown.begin[k] <= e < shown.begin[k + 1] - 1]
        splitter.begin(m)
        own = [e for e in own if not splitter.goes_on(e)]
        spoken = [u for u, w in zip(units, words) if w]
        for (a, b), (c, d) in zip(spoken, spoken[1:]):
            last = max(i for i in range(a, b) if m[i].isalnum() and not m[i].isdecimal())
            first = min(i for i in range(c, d) if m[i].isalnum() and not m[i].isdecimal())
            assert any(last < e < first for e in own), (t, (a, b), (c, d))


def test_stretches_are_the_same_without_confidence(held_out):
    model, test = held_out
    rng = random.Random(7)
    pool = [t for ts in test.values() for t in ts] + ["Perustuslakituomioistuin katsoo.", "123", "", "sp. zn. II. ÚS 72/13", "<p>Soud</p> so\xadud", "法院认为。本院的"]
    texts = [rng.choice([" ", "\n\n", ". "]).join(rng.choices(pool, k=rng.choice([1, 1, 2, 3]))) for _ in range(400)]
    texts += [" ".join([t, t.upper(), "JUDr. A. B. Novák.", t]) for t in pool]
    got = L.Labeller(model).label(texts, confidence=False)
    assert [[x[:3] for x in g] for g in got] == [[x[:3] for x in g] for g in L.Labeller(model).label(texts)]


def test_texts_of_one_language_are_not_split(samples):
    cs = " ".join(t for lang, t in samples if lang == "cs")
    labeller = L.Labeller(L.Model(samples, calibrate=False))
    assert [(a, b, lang) for a, b, lang, _ in labeller.label([cs])[0]] == [(0, len(cs), "cs")]
    labeller.splitter.split = None  # cannot be called
    assert labeller.label([cs, "123"], confidence=False) == [[(0, len(cs), "cs", None)], []]


def test_words_are_kept_in_one_table(samples):
    known = L.Numbers(L.Model(samples, calibrate=False))
    words = [f"slovo{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2500)]
    assert [known[w] for w in words + words] == 2 * list(range(2500))
    want = sum(known.model.word(w).astype("float32").astype(float) for w in words[:3])
    assert abs(known.sums([0, 1, 2, 7], L.np.array([0, 3, 4]))[0] - want).max() < 1e-9


def test_one_large_row_group_is_read_by_all_tasks(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(3)
    table = pa.table({"doc_id": list(range(4000)), "text": [f"{rng.random()} slovo" for _ in range(4000)]})
    pq.write_table(table, tmp_path / "t.parquet", row_group_size=4000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = spark.read.parquet(str(tmp_path / "t.parquet"))
        assert df.rdd.getNumPartitions() >= 4
        counts = [r["count"] for r in evened(df, "doc_id", "text").groupBy(L.F.spark_partition_id()).count().collect()]
        assert sum(counts) == 4000 and max(counts) < 1500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
