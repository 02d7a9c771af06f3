import pytest

from stylograph.operators import annotate, features
from stylograph.sources import sinks
from stylograph.sources.tables import read_conllu, read_csv


def tokens(spark, *texts):
    return annotate.annotate_rules(spark.createDataFrame([(f"d{i}", t, "x") for i, t in enumerate(texts)], "doc_id string, text string, form string"))


def test_annotator(spark):
    got = [(r.sent_id, r.form, r.upos) for r in tokens(spark, "Já a 12 §! Ne.", "", None, "  ").orderBy("sent_id", "tok_id").collect()]
    assert got == [(0, "Já", "PRON"), (0, "a", "CCONJ"), (0, "12", "NUM"), (0, "§", "PUNCT"), (0, "!", "PUNCT"), (1, "Ne", "ADV"), (1, ".", "PUNCT")]


def test_surface(spark):
    t = tokens(spark, "a bb. ccc d d!", "...", "")
    rows = {r.doc_id: r for r in features.surface(t).collect()}
    assert set(rows) == {"d0", "d1"}
    r = rows["d0"]
    assert (r.sent_len_mean, r.sent_len_median, r.sent_count, r.word_len_median) == (3.5, 3.5, 2, 1)
    assert r.ttr_form == 4 / 5 and r.hapax_ratio == 3 / 5 and r["punct_._per1k"] == pytest.approx(1000 / 7)
    assert rows["d1"].word_len_mean == 0 and rows["d1"].ttr_form == 0


def test_ngrams(spark):
    t = tokens(spark, "ab", "abc", "😀ab c", "x")
    got = {(r.doc_id, r.gram): r.freq for r in features.profile(features.char_counts(t)).collect()}
    assert {k for k in got if k[0] in ("d0", "d3")} == set() and got["d1", "abc"] == 1
    assert got["d2", "😀 a"] == pytest.approx(1 / 4)
    pos = {(r.doc_id, r.gram) for r in features.profile(features.pos_counts(tokens(spark, "Já. A on.", "já"))).collect()}
    assert pos == {("d0", "PRON_PUNCT"), ("d0", "CCONJ_PRON")}


def test_vocabulary_weighs_documents_equally(spark):
    t = tokens(spark, "aaaa" * 50, "bbb")
    assert [r.gram for r in features.vocabulary(features.char_counts(t), 2).collect()] == ["aaa", "bbb"]


def test_matrix_fills_zeros(spark):
    docs = spark.createDataFrame([("d0", "x", "A že b."), ("d1", "y", ""), ("d2", "y", None)], "doc_id string, author string, text string")
    made, names = features.matrix(docs, annotate.annotate_rules(docs))
    rows = {r.doc_id: r.features for r in made.collect()}
    assert {len(v) for v in rows.values()} == {len(names)} and sum(rows["d1"]) == sum(rows["d2"]) == 0
    assert rows["d0"][names.index("fw_že")] == 0.25
    with pytest.raises(ValueError):
        features.matrix(docs, docs, ("nothing",))


def test_conllu(spark):
    text = "# c\n1-2\tab\ta\tX\t_\t_\n1\tA\ta\tX\tx\tf\n1.1\tq\tq\tX\t_\t_\n2\tB\tb\tY\ty\tg\nbad\trow\n\n\n1\tC\tc\tZ\tz\th"
    df = spark.createDataFrame([("d", text), ("e", ""), ("f", None)], "doc_id string, conllu string")
    got = [(r.sent_id, r.tok_id, r.form, r.feats) for r in read_conllu(df).orderBy("sent_id", "tok_id").collect()]
    assert got == [(0, 0, "A", "f"), (0, 1, "B", "g"), (1, 0, "C", "h")]
    assert annotate.as_documents(read_conllu(df)).first().sentences[1][0].form == "C"


def test_csv_and_pointer(spark, tmp_path):
    head = "doc_id,text,date_decision,date_submission,type_decision,importance,judge_rapporteur_name,judge_rapporteur_id,type_verdict,grounds,separate_opinion,formation,outcome,length_proceeding"
    p = tmp_path / "a.csv"
    p.write_text(head + '\n"d1","a ""b""\nc",2020-02-30,2020-02-28,NA,x,,,,,NA,,,7\n', encoding="utf-8")
    r = read_csv(spark, str(p)).first()
    assert (r.text, r.date_decision, str(r.date_submission), r.type_decision, r.importance, r.length_proceeding) == ('a "b"\nc', None, "2020-02-28", None, None, 7)
    (tmp_path / "b.csv").write_text("version https://git-lfs.github.com/spec/v1\n")
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "b.csv"))


def test_conllu_round_trip(spark):
    texts = [("d", "Věta # má „prvek“. Ｄａｌší ﬁ věc 12! Право e\u0301. 法院判决 _ ok"), ("e", "."), ("f", None), ("g", "")]
    tokens = annotate.annotate_rules(spark.createDataFrame(texts, "doc_id string, text string"))
    want = sorted((r.doc_id, r.sent_id, r.tok_id, r.form, r.lemma, r.upos) for r in tokens.collect())
    got = read_conllu(sinks.conllu_texts(annotate.as_documents(tokens))).collect()
    assert sorted((r.doc_id, r.sent_id, r.tok_id, r.form, r.lemma, r.upos) for r in got) == want
    assert {r[1] for r in want if r[0] == "d"} == {0, 1, 2, 3} and len(want) > 15


def test_udpipe_by_a_stand_in(spark, tmp_path, monkeypatch):
    """The package is not here; a module of its shape shows what is asked of it and what becomes of its answer."""
    (tmp_path / "ufal").mkdir()
    (tmp_path / "ufal" / "__init__.py").write_text("")
    (tmp_path / "ufal" / "udpipe.py").write_text(
        """
class Model:
    @staticmethod
    def load(path):
        return None if path.endswith("bad") else Model()


class Pipeline:
    DEFAULT = ""

    def __init__(self, model, how, tagger, parser, out):
        assert (how, out) == ("tokenize", "conllu")

    def process(self, text):
        rows = ["# text", "1-2\\t_\\t_\\t_\\t_\\t_"]
        rows += [f"{i}\\t{w}\\t{w.lower()}L\\tNOUN\\tN\\tCase=Nom" for i, w in enumerate(text.split(), 1)]
        return chr(10).join(rows) + chr(10) * 2
"""
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setitem(spark.sparkContext.environment, "PYTHONPATH", str(tmp_path))
    for name in ("good", "bad"):
        (tmp_path / name).write_text("model")
    df = spark.createDataFrame([("d", "Soud  &nbsp; rozhodl"), ("e", None)], "doc_id string, text string")
    got = [tuple(r) for r in annotate.annotate_udpipe(df, str(tmp_path / "good")).orderBy("tok_id").collect()]
    assert got == [("d", 0, 0, "Soud", "soudL", "NOUN", "N", "Case=Nom"), ("d", 0, 1, "rozhodl", "rozhodlL", "NOUN", "N", "Case=Nom")]
    for name, error in (("none", "FileNotFoundError"), ("bad", "RuntimeError")):
        with pytest.raises(Exception, match=error):
            annotate.annotate_udpipe(df, str(tmp_path / name)).collect()
    # lemmas that are no lower-case forms: both vocabularies count, and function words can be looked for among either
    t = spark.createDataFrame([("d", 0, 0, "Má", "mít", "VERB"), ("d", 0, 1, "mají", "mít", "VERB")], "doc_id string, sent_id int, tok_id int, form string, lemma string, upos string")
    r = features.richness(t).first()
    assert (r.ttr_form, r.ttr_lemma) == (1.0, 0.5)
    assert [(x.word, x.freq) for x in features.function_word_freq(t, ["mít", "má"]).collect()] == [("mít", 1.0)]
    assert [(x.word, x.freq) for x in features.function_word_freq(t, ["mít", "má"], use_lemmas=False).collect()] == [("má", 0.5)]
