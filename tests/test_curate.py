from pyspark.sql import functions as F

from stylograph.functions import text as X
from stylograph.operators import curate
from stylograph.schema import ColumnMap


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr("x").alias("y")).first()["y"]


def test_author_filter(spark):
    names = [None, "NA", "", " Jan Filip ", 'c("A", "B")', " Eva ", "\nNA\t"]
    df = spark.createDataFrame([(n, 1) for n in names], "separate_opinion string, extra int")
    assert [r[0] for r in curate.single_author(df).collect()] == ["Jan Filip", "Eva"]


def test_left_join_keys(spark):
    left = spark.createDataFrame([("a", "t1"), (None, "t2"), ("c", "t3")], "doc_id string, text string")
    right = spark.createDataFrame([("a", "x", "m1"), ("a", "y", "m2"), (None, "z", "m3")], "doc_id string, text string, kind string")
    plain = {(r.doc_id, r.text, r.kind) for r in curate.left_join(left, right).collect()}
    assert plain == {("a", "t1", "m1"), ("a", "t1", "m2"), (None, "t2", None), ("c", "t3", None)}
    safe = {(r.doc_id, r.text, r.kind) for r in curate.left_join(left, right, null_safe=True).collect()}
    assert (None, "t2", "m3") in safe and len(safe) == 4


def test_min_docs(spark):
    df = spark.createDataFrame([(f"d{i}", a) for i, a in enumerate("aaabbc")], "doc_id string, author string")
    assert {r.author for r in curate.at_least(df, "author", 2).collect()} == {"a", "b"}
    assert curate.at_least(df, "author", 0).count() == 6


def test_marker_extraction(spark):
    f = X.extract_after_marker
    assert one(spark, "<p>Úvod</p>\n<h3>ODLIŠNÉ STANOVISKO soudce X</h3>\n  \n<p>Text.</p>", f) == "Text."
    assert one(spark, "a odlišné stanovisko b\n\nc Odlišné stanovisko d\n\ne", f) == "c Odlišné stanovisko d\n\ne"
    assert one(spark, "Konkurující stanovisko rovnou text", f) == "rovnou text"
    assert one(spark, "bez něj", f) is None and one(spark, "Odlišné stanovisko ", f) is None and one(spark, None, f) is None
    assert one(spark, "Odlišné&nbsp;stanovisko\n\n&#160;x &sect;&#160;1", f) == "x § 1"


def test_clean_text(spark):
    f = X.clean_text
    assert one(spark, None, f) == "" and one(spark, "", f) == ""
    assert one(spark, "\t a \n b&amp;c &#160; &sup2; d–e—f\x1c", f) == "a b c &#160; &sup2; d-e-f"


def test_html_to_text(spark):
    assert one(spark, "<p>a<br/>b</p><!-- c\n -->&lt;d&gt; 3 < 4 &amp;lt; &#38;lt; &#268;", X.html_to_text) == "ab<d> 3 < 4 &lt; &lt; Č"
    assert one(spark, "x" * 300_000, X.html_to_text) == "x" * 300_000


def test_histogram_and_label(spark):
    df = spark.createDataFrame([(1,), (30,), (30,), (None,)], "w int")
    assert {(r.bin, r.n) for r in curate.histogram(df, "w").collect()} == {(0, 1), (29, 2)}
    assert {(r.bin, r.n) for r in curate.histogram(df.where("w = 1"), "w").collect()} == {(0, 1)}
    assert curate.histogram(df.where("w > 99"), "w").count() == 0
    t = spark.createDataFrame([("a", "d1", "x y"), ("a", "d2", "x y z"), ("a", "d3", None)], "separate_opinion string, doc_id string, separate_opinion_extracted string")
    r = curate.words_by_author(t).first()
    assert (r.n, r.avg_words, r.label) == (3, 2.5, "2 (n=3)")
    s = curate.author_summary(t, ColumnMap()).first()
    assert (s.n_dissents, s.median_words, s.min_words, s.total_words) == (3, 2.0, 0, 5)


def test_setdiff_nulls_and_empty(spark):
    a = spark.createDataFrame([("x",), (None,), ("y",), ("x",)], "doc_id string")
    assert {r[0] for r in curate.lost_keys(a, a.where("doc_id = 'y'")).collect()} == {"x", None}
    assert curate.lost_keys(a.limit(0), a).count() == 0
    assert curate.integrity_report(a, a.where(F.lit(False))).first() == (4, 0, 3)


def test_entities_of_all_kinds(spark):
    from html.entities import name2codepoint

    rows = ["&#xA0;&#x159;&#X159;&#345;&eacute;&copy;&#1114111;", "&amp;lt; &#38;#60; &#x26;amp; &lt;", "&nosuch; &#0; &#xD800; &#1114112; &#9999999; &; &#x; &apos;", "".join(f"&{n};" for n in sorted(name2codepoint) if n != "amp"), None, ""]
    want = ["\xa0řřřé©\U0010ffff", "&lt; &#60; &amp; <", "&nosuch; &#0; &#xD800; &#1114112; &#9999999; &; &#x; '", "".join(chr(name2codepoint[n]) for n in sorted(name2codepoint) if n != "amp"), None, ""]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    assert [r.t for r in df.select("i", X.html_to_text("t").alias("t")).orderBy("i").collect()] == want


def test_one_by_key(spark):
    import datetime

    day = lambda y: datetime.date(y, 1, 1) if y else None
    rows = [("a", "old", day(2020)), ("a", "new", day(2021)), ("a", " ", day(2030)), ("a", "a", None), ("b", None, None), (None, "x", day(2020)), ("c", "z", day(2020)), ("c", "y", day(2020))]
    df = spark.createDataFrame(rows, "doc_id string, text string, date date")
    assert {(r.doc_id, r.text) for r in curate.one_by_key(df, text="text", latest="date").collect()} == {("a", "new"), ("b", None), ("c", "y")}
    assert {(r.doc_id, r.text) for r in curate.one_by_key(df).collect()} == {("a", " "), ("b", None), ("c", "y")}
    assert curate.one_by_key(df.limit(0)).count() == 0
