"""The queries of the corpus operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograph.llm import languages, lookalike, mixing, sentences, shared_spans, tokenize
from stylograph.llm.batches import court_texts
from stylograph.session import evened
from stylograph.sources.tables import read_table, read_texts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f, sql: str | None = None):
    QUERIES[f.__name__] = f
    if sql is not None:
        SQL[f.__name__] = sql
    return f


def said(sql: str):
    """Registers a query with its SQL."""
    return lambda f: query(f, sql)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return court_texts(read_texts(spark, d, "subset"), read_texts(spark, d, "subset_disent2"))


#: The records of p1, p3 and p5, each once.
_RECORDS = """t AS (SELECT DISTINCT field, doc_id, text FROM (SELECT 'subset.text' AS field, doc_id, text FROM subset
 UNION ALL SELECT 'subset_disent2.separate_opinion_extracted', doc_id, separate_opinion_extracted FROM subset_disent2) WHERE doc_id NOT IN ('', 'NA') AND text NOT IN ('', 'NA'))"""
#: Every window of every record by brute force: x; s: the shared runs, from runs of neighbouring windows.
_SHARED = f"""{_RECORDS}, x AS (SELECT field, doc_id, o, substr(text, o + 1, 100) AS win FROM (SELECT *, unnest(range(0, length(text) - 99)) AS o FROM t WHERE length(text) >= 100)),
 met AS (SELECT field, win FROM x GROUP BY field, win HAVING min(doc_id) <> max(doc_id)),
 hit AS (SELECT DISTINCT field, doc_id, o FROM x SEMI JOIN met USING (field, win)),
 new AS (SELECT *, coalesce(o > 100 + lag(o) OVER (PARTITION BY field, doc_id ORDER BY o), true) AS begins FROM hit),
 runs AS (SELECT *, sum(begins::INT) OVER (PARTITION BY field, doc_id ORDER BY o) AS run FROM new),
 s AS (SELECT field, doc_id, min(o) AS span_start, max(o) + 100 AS span_end FROM runs GROUP BY field, doc_id, run)"""


@query
def p1_found(spark, d):
    """field, doc_id, sent_start, sent_end of each sentence unit."""
    return sentences.split_sentences(_texts(spark, d))


@said(f"WITH {_SHARED} SELECT field, doc_id, span_start, span_end FROM s")
def p3_found(spark, d):
    """field, doc_id, span_start, span_end of each stretch shared with another record."""
    return shared_spans.shared_spans(_texts(spark, d))


@said(
    f"""WITH {_SHARED}, z AS (SELECT field, doc_id, max(length(text)) AS n_chars FROM t GROUP BY 1, 2), c AS (SELECT field, doc_id, sum(span_end - span_start) AS n FROM s GROUP BY 1, 2)
 SELECT field, doc_id, n_chars, coalesce(n, 0)::BIGINT AS shared_chars, round(coalesce(n, 0) / n_chars, 6) AS share FROM z LEFT JOIN c USING (field, doc_id)"""
)
def p3_shares(spark, d):
    """How much of each record is shared."""
    return shared_spans.shared_shares(_texts(spark, d))


@said(
    f"""WITH {_SHARED}, z AS (SELECT field, doc_id, max(text) AS text FROM t GROUP BY 1, 2),
 e AS (SELECT field, doc_id, lag(span_end, 1, 0) OVER w AS a, span_start AS b FROM s WINDOW w AS (PARTITION BY field, doc_id ORDER BY span_start)
  UNION ALL SELECT field, doc_id, max(span_end), 1 << 30 FROM s GROUP BY 1, 2),
 k AS (SELECT field, doc_id, string_agg(substr(text, a + 1, b - a), '' ORDER BY a, b) AS kept FROM e JOIN z USING (field, doc_id) GROUP BY 1, 2)
 SELECT field, doc_id, length(text) AS n_chars, length(coalesce(kept, text)) AS n_left, md5(coalesce(kept, text)) AS rest_md5 FROM z LEFT JOIN k USING (field, doc_id)"""
)
def p3_rest(spark, d):
    """Every record without its shared stretches, as its length and digest."""
    return shared_spans.without_shared(_texts(spark, d)).select("field", "doc_id", "n_chars", "n_left", F.md5("text").alias("rest_md5"))


@query
def p5_found(spark, d):
    """field, doc_id_a, doc_id_b of records that look the same but are stored with different characters."""
    return lookalike.same_looks(_texts(spark, d))


@query
def p5_classes(spark, d):
    """Each record of a look with several stored texts, with its representatives."""
    return lookalike.look_classes(_texts(spark, d))


@query
def p5_forms(spark, d):
    """The uniform form of each text, as its length and digest."""
    made = lookalike.uniform_texts(_texts(spark, d), ["field", "doc_id"])
    return made.select("field", "doc_id", F.length("form").alias("n_chars"), F.md5("form").alias("form_md5"), (F.col("raw") != F.col("looks")).alias("changed")).distinct()


@query
def p6_ids(spark, d):
    """doc_id, ids by byte_bpe_50k."""
    return tokenize.encode(read_texts(spark, d, "documents"))


@said("SELECT doc_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents")
def p6_round_trip(spark, d):
    """The length and digest of each text as its ids give it back."""
    made = tokenize.decode_texts(tokenize.encode(read_texts(spark, d, "documents")))
    return made.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@query
def p6_offsets(spark, d):
    """doc_id, number of ids, and the offset of the last id."""
    made = tokenize.encode(read_texts(spark, d, "documents"), offsets=True)
    return made.select("doc_id", F.size("ids").alias("n_ids"), F.try_element_at("offsets", F.lit(-1)).alias("last_offset"))


@query
def p7_mix(spark, d):
    """The mixture of the sources in mix_targets, one row for each use of a document."""
    return mixing.mix(read_texts(spark, d, "documents"), read_table(spark, d, "mix_targets"))


@query
def p7_shares(spark, d):
    """The shares that the mixture reaches, and what it leaves out."""
    targets = read_table(spark, d, "mix_targets")
    made = mixing.sized(read_texts(spark, d, "documents"), targets)
    return mixing.shares(mixing.mix_sized(made, targets), targets, made)


@query
def p7_deviation(spark, d):
    """How far each source is off its share at most, at any point of the mixture."""
    targets = read_table(spark, d, "mix_targets")
    made = mixing.sized(read_texts(spark, d, "documents"), targets)
    return mixing.deviations(mixing.mix_sized(made, targets), mixing.layout_of(made, targets))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return evened(read_table(spark, d, "documents"), "doc_id", "text")


def _languages(spark: SparkSession, d: str) -> languages.Model:
    return languages.fit(read_table(spark, d, "lang_samples"))


@query
def p8_found(spark, d):
    """doc_id, seg_start, lang of the stretches of texts with a wrong label or several languages."""
    return languages.wrong_or_mixed(_documents(spark, d), _languages(spark, d))


@query
def p8_segments(spark, d):
    """Every stretch of every text with its language and confidence."""
    return languages.segments(_documents(spark, d).select("doc_id", "text"), _languages(spark, d), ["doc_id"])


@query
def p8_labels(spark, d):
    """The main language of each text."""
    return languages.document_labels(_documents(spark, d), _languages(spark, d))
