import json

import pytest
from pyspark.sql import functions as F

from stylograph import __main__ as cli
from stylograph.operators import classify
from stylograph.plans import pipeline
from stylograph.plans.curation import curate_corpus


def test_curation(spark):
    texts = spark.createDataFrame([("d1", "<p>a</p>\n<p>Odlišné stanovisko</p>\n\nText jedna."), ("d2", "bez"), ("d3", None), ("d4", "Odlišné stanovisko\n\nc(x)"), (None, "x")], "doc_id string, text string")
    meta = spark.createDataFrame([("d1", "2020-01-02", " Eva ", "Plenum"), ("d2", "bad", "Jan", None), ("d3", None, "Jan", None), ("d4", None, "Ota", None), ("d9", None, "Ota", None)], "doc_id string, date_decision string, separate_opinion string, formation string")
    made = curate_corpus(texts, meta)
    assert made.subset.count() == 5 and {r.doc_id for r in made.single.collect()} == {"d1", "d2", "d3", "d4"}
    row = made.opinions.collect()
    assert [(r.doc_id, r.separate_opinion, r.separate_opinion_extracted, str(r.date_decision)) for r in row] == [("d1", "Eva", "Text jedna.", "2020-01-02")]
    assert made.report().first() == (4, 1, 3) and made.lost().first()[0] == "d2, d3, d4"


def test_command_line(spark, tmp_path, capsys):
    rows = [(f"d{i}", "a že b. " * (3 + i) if i % 2 else "ale on ne! " * (3 + i), "x" if i % 2 else "y", None) for i in range(8)]
    spark.createDataFrame(rows, "doc_id string, separate_opinion_extracted string, separate_opinion string, date_decision date").write.parquet(str(tmp_path / "c"))
    cli.main(["summary", "--corpus", str(tmp_path / "c"), "--min-dissents", "2"])
    cli.main(["run", "--corpus", str(tmp_path / "c"), "--output", str(tmp_path / "o"), "--min-dissents", "2", "--methods", "burrows", "--features", "function_words", "surface"])
    assert "accuracy 1.000" in capsys.readouterr().out
    assert json.loads((tmp_path / "o/confusion_matrices.json").read_text())["burrows"]["accuracy"] == 1.0
    with pytest.raises(SystemExit):
        cli.arguments(["run", "--output", "x", "--from-step", "paint"])


def _features(spark, n=40):
    rows = [(f"d{i:02}", "xyz"[i % 3], [float(i % 3 == 0) + i * 0.001, float(i % 3 == 1), 7.0]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, author string, features array<double>")


def test_a_refusal_loses_only_its_method(spark, tmp_path, monkeypatch):
    _features(spark).write.parquet(str(tmp_path / "features"))
    spark.createDataFrame([("d", "t", "a")], "doc_id string, text string, author string").write.parquet(str(tmp_path / "load"))
    monkeypatch.setattr(classify, "MAX_TRAIN_BYTES", 100)
    with pytest.warns(UserWarning, match="no predictions of svm"):
        p = pipeline.run(spark, None, str(tmp_path), "evaluate", methods=("burrows", "svm", "knn"))
    assert {r.method: r["count"] for r in p.groupBy("method").count().collect()} == {"burrows": 40, "knn": 40}
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="no predictions of svm"):
        pipeline.run(spark, None, str(tmp_path), "evaluate", methods=("svm",))


@pytest.mark.parametrize("method", ["svm", "logistic"])
def test_train_and_score(spark, method):
    f = _features(spark)
    got = classify.train_and_score(f.where("doc_id < 'd30'"), f.where("doc_id >= 'd30'"), method).collect()
    assert len(got) == 10 and all(r.predicted == r.author and r.method == method for r in got)


def test_repeats_and_several_authors(spark, tmp_path):
    texts = [(f"d{i}", "a že b. " * (3 + i) if i % 2 else "ale on ne! " * (3 + i), "x" if i % 2 else "y") for i in range(8)]
    more = [("d0", "a že b. Dále a že.", "x"), ("d1", None, "x"), ("d1", " ", "x"), ("d2", "ale on ne! " * 5, "y")]  # another author, two repeats without text, one equal
    corpus = spark.createDataFrame([(*r, None) for r in more + texts], "doc_id string, separate_opinion_extracted string, separate_opinion string, date_decision date")
    p = pipeline.run(spark, corpus, str(tmp_path), min_dissents=2, feature_sets=("function_words", "surface"), methods=("burrows", "knn"))
    keys = sorted({(d, a) for d, _, a in texts} | {("d0", "x")})
    for m in ("burrows", "knn"):
        assert sorted((r.doc_id, r.author) for r in p.where(F.col("method") == m).collect()) == keys
    kept = {(r.doc_id, r.author): r.text for r in spark.read.parquet(str(tmp_path / "load")).collect()}
    assert len(kept) == 9 and kept["d1", "x"] == texts[1][1] and kept["d0\x1fx", "x"].endswith("Dále a že.")


def test_summary_is_whole(spark, tmp_path, capsys):
    rows = spark.range(1003).selectExpr("concat('d', id) AS doc_id", "'a b' AS separate_opinion_extracted", "concat('author ', id) AS separate_opinion", "cast(null AS date) AS date_decision")
    rows.write.parquet(str(tmp_path / "c"))
    cli.main(["summary", "--corpus", str(tmp_path / "c"), "--min-dissents", "1"])
    assert "3 more authors are not shown" in capsys.readouterr().out
    cli.main(["summary", "--corpus", str(tmp_path / "c"), "--min-dissents", "1", "--output", str(tmp_path / "s")])
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 1003


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from stylograph import session

    def fake(master, conf):
        made = []
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
        frame = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, other: conf.get(k, other))), checkpoint=lambda eager: "done")
        return frame, made

    for master in ("local-cluster[3,2,1000]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.checkpoint(fake(master, {})[0])
        frame, made = fake(master, {"spark.checkpoint.dir": "hdfs://x/y"})
        assert session.checkpoint(frame) == "done" and made == ["hdfs://x/y"]
    frame, made = fake("local[4]", {})
    assert session.checkpoint(frame) == "done" and len(made) == 1
