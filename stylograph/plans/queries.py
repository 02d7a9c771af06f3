"""The queries of the core library and the SQL that says the same, for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograph.functions import text as X
from stylograph.operators import annotate, classify, curate, delta, evaluate, features, profiles
from stylograph.operators.lexicon import function_words, word_tags
from stylograph.plans import data_queries, pipeline
from stylograph.session import checkpoint
from stylograph.sources import sinks
from stylograph.sources.tables import read_conllu, read_table, read_texts
from stylograph.schema import ColumnMap

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _present(c: str):
    return F.when(~F.col(c).isin("NA", ""), F.col(c))


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def opinions(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, author, text of each separate opinion; of repeated rows the least, one with text before one without."""
    t = read_table(spark, d, "subset_disent2").select(_present("doc_id").alias("doc_id"), _present("separate_opinion_extracted").alias("text"), X.trim_ws("separate_opinion").alias("author"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that few and short texts still go to all cores
    return t.where(F.col("doc_id").isNotNull() & F.col("author").isNotNull()).repartition(n, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNull(), "author", "text")).alias("r")).select("doc_id", "r.author", "r.text")


def opinion_tokens(spark: SparkSession, d: str) -> DataFrame:
    return annotate.annotate_rules(opinions(spark, d))


# --- SQL shared by the oracles -------------------------------------------------------------------------------------------
_WS = r"[\s\x0b\x85\x{1C}-\x{1F}\pZ]"
_TRIM = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
_SQUISH = lambda c: f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'))"
_CLEAN = lambda c: f"trim(regexp_replace(translate(regexp_replace({_SQUISH(f"coalesce({c}, '')")}, '&[a-zA-Z]+;', ' ', 'g'), '–—', '--'), ' {{2,}}', ' ', 'g'))"
_WORDS = lambda c: f"len(regexp_extract_all({c}, '[^\\s\\x0b\\x85\\x{{1C}}-\\x{{1F}}\\pZ]+'))"
#: The named entities that the tables have; "amp" has to stay last.
_ENTITIES = [(n, X.NAMED_ENTITIES[n]) for n in ("nbsp", "sect", "lt", "gt", "quot", "apos", "ndash", "mdash", "hellip", "amp")]
_HTML = lambda c: "replace(" * 12 + f"regexp_replace({c}, '<!--(?s:.*?)-->|</?[a-zA-Z][^<>]*>|<![a-zA-Z][^<>]*>', '', 'g')" + "".join(f", '{a}', '{b}')" for a, b in (("&#160;", " "), ("&#167;", "§"), *((f"&{n};", "''" if c == "'" else c) for n, c in _ENTITIES)))
_SINGLE = f"SELECT * REPLACE ({_TRIM('separate_opinion')} AS separate_opinion) FROM subset WHERE {_TRIM('separate_opinion')} NOT IN ('NA', '') AND NOT regexp_matches({_TRIM('separate_opinion')}, '^c\\s*\\(.*\\)$')"
_MARKED = "|".join(X.MARKERS)
_PLAIN = _HTML("replace(text, '&nbsp;', ' ')")
_AFTER = _TRIM(f"regexp_replace(({_PLAIN}), '(?is)^.*?(?:{_MARKED})', '')")
_EXTRACTED = f"""SELECT * FROM (SELECT doc_id, separate_opinion, nullif({_TRIM("regexp_replace(after, '(?s)^.*?\\n" + _WS + "*\\n', '')")}, '') AS separate_opinion_extracted
  FROM (SELECT doc_id, separate_opinion, CASE WHEN regexp_matches({_PLAIN}, '(?i){_MARKED}') THEN {_AFTER} END AS after FROM ({_SINGLE})))
  WHERE separate_opinion_extracted IS NOT NULL AND NOT regexp_matches(separate_opinion_extracted, '^\\s*c\\s*\\(.*\\)\\s*$')"""
_OPINIONS = f"""op AS (SELECT doc_id, author, text FROM (SELECT CASE WHEN doc_id NOT IN ('NA', '') THEN doc_id END AS doc_id,
  CASE WHEN separate_opinion_extracted NOT IN ('NA', '') THEN separate_opinion_extracted END AS text, {_TRIM('separate_opinion')} AS author FROM subset_disent2)
  WHERE doc_id IS NOT NULL AND author IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY text IS NULL, author, text) = 1)"""


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _tokens(source: str = "op") -> str:
    tags: dict[str, list[str]] = {}
    for w, t in word_tags().items():
        tags.setdefault(t, []).append(w)
    cases = " ".join(f"WHEN lemma IN ({_quoted(ws)}) THEN '{t}'" for t, ws in sorted(tags.items()))
    return f"""ct AS (SELECT doc_id, {_CLEAN('text')} AS t FROM {source}),
 se AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS sent_id FROM (SELECT doc_id, list_filter(regexp_extract_all(t, '[^.!?…]*[.!?…]+|[^.!?…]+$'), lambda s: trim(s) <> '') AS l FROM ct)),
 tk AS (SELECT doc_id, sent_id, unnest(k) AS form, generate_subscripts(k, 1) - 1 AS tok_id FROM (SELECT doc_id, sent_id, regexp_extract_all(s, '[\\pL\\pM]+|\\pN+|[^ ]') AS k FROM se)),
 tok AS (SELECT *, CASE WHEN regexp_matches(form, '^\\pP+$') THEN 'PUNCT' WHEN regexp_matches(form, '^\\pS+$') THEN 'SYM' WHEN regexp_matches(form, '^\\pN+$') THEN 'NUM' {cases} ELSE 'X' END AS upos
  FROM (SELECT *, lower(form) AS lemma FROM tk))"""


_TOK = f"WITH {_OPINIONS}, {_tokens()}"


def _grams(kind: str, t: str = "") -> str:
    """Tables g (doc_id, gram) and c (doc_id, gram, n, total), their names followed by ``t``."""
    made = {
        "char_ngrams": f"ln{t} AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY sent_id, tok_id) AS t FROM tok GROUP BY doc_id), g{t} AS (SELECT doc_id, substr(t, i, 3) AS gram FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS i FROM ln{t}))",
        "pos_ngrams": f"g{t} AS (SELECT doc_id, upos || '_' || nx AS gram FROM (SELECT doc_id, upos, lead(upos) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id) AS nx FROM tok) WHERE nx IS NOT NULL)",
    }
    return f"{made[kind]}, c{t} AS (SELECT doc_id, gram, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM g{t} GROUP BY doc_id, gram)"


def _vocab(k: int, t: str = "") -> str:
    return f"SELECT gram, weight FROM (SELECT gram, round(sum(n / total), 9) AS weight FROM c{t} GROUP BY gram) ORDER BY weight DESC, gram LIMIT {k}"


_C3, _P2 = f", {_grams('char_ngrams')}", f", {_grams('pos_ngrams')}"

# --- curation -------------------------------------------------------------------------------------------------------------


@query("SELECT s.doc_id, length(s.text) AS n_text, m.type_decision, m.importance, m.date_publication FROM (SELECT doc_id, text FROM subset) s LEFT JOIN meta m USING (doc_id)")
def corpus_left_join(spark, d):
    out = curate.left_join(read_table(spark, d, "subset").select("doc_id", "text"), read_table(spark, d, "meta"))
    return out.select("doc_id", F.length("text").alias("n_text"), "type_decision", "importance", "date_publication")


@query(f"SELECT doc_id, separate_opinion FROM ({_SINGLE})")
def single_author_filter(spark, d):
    return curate.single_author(read_table(spark, d, "subset")).select("doc_id", "separate_opinion")


@query(f"SELECT doc_id, md5(separate_opinion_extracted) AS extract_md5 FROM ({_EXTRACTED})")
def extract_after_marker(spark, d):
    return curate.extract_opinions(curate.single_author(read_texts(spark, d, "subset"))).select("doc_id", F.md5("separate_opinion_extracted").alias("extract_md5"))


@query(f"SELECT doc_id FROM ({_SINGLE}) EXCEPT SELECT doc_id FROM ({_EXTRACTED})")
def lost_docs_setdiff(spark, d):
    one = curate.single_author(read_texts(spark, d, "subset"))
    return curate.lost_keys(one, curate.extract_opinions(one))


_LATER = _EXTRACTED.replace(_MARKED, "|".join(X.MARKERS[1:]))


@query(f"SELECT doc_id FROM ({_SINGLE}) EXCEPT SELECT doc_id FROM ({_LATER})")
def lost_docs_by_marker(spark, d):
    """The decisions that are lost where only the later markers are looked for."""
    one = curate.single_author(read_texts(spark, d, "subset"))
    return curate.lost_keys(one, curate.extract_opinions(one, markers=X.MARKERS[1:]))


@query(f"SELECT (SELECT count(*) FROM ({_SINGLE})) AS n_before, (SELECT count(*) FROM ({_EXTRACTED})) AS n_after, (SELECT count(*) FROM (SELECT doc_id FROM ({_SINGLE}) EXCEPT SELECT doc_id FROM ({_EXTRACTED}))) AS n_lost")
def integrity_report(spark, d):
    one = curate.single_author(read_texts(spark, d, "subset"))
    return curate.integrity_report(one, curate.extract_opinions(one))


@query("SELECT separate_opinion, count(*) AS n FROM subset_disent2 GROUP BY 1")
def count_by_author(spark, d):
    return curate.count_by(read_table(spark, d, "subset_disent2"), "separate_opinion")


@query("SELECT year(date_decision)::INT AS year, count(*) AS n FROM subset WHERE date_decision IS NOT NULL GROUP BY 1")
def count_by_year(spark, d):
    return curate.count_by_year(read_table(spark, d, "subset"))


@query("SELECT separate_opinion, count(*) AS n FROM subset_disent2 GROUP BY 1 ORDER BY n DESC, separate_opinion LIMIT 10")
def top_authors(spark, d):
    return curate.top_by_count(read_table(spark, d, "subset_disent2"), "separate_opinion", 10)


@query(f"""WITH w AS (SELECT {_WORDS('separate_opinion_extracted')} AS w FROM subset_disent2 WHERE separate_opinion_extracted IS NOT NULL), s AS (SELECT min(w) AS lo, max(w) AS hi FROM w)
SELECT CASE WHEN hi > lo THEN floor((w - (lo - (hi - lo) / 29::DOUBLE / 2)) / ((hi - lo) / 29::DOUBLE)) ELSE 0 END::BIGINT AS bin, count(*) AS n FROM w, s GROUP BY 1""")
def word_histogram(spark, d):
    words = read_table(spark, d, "subset_disent2").where(F.col("separate_opinion_extracted").isNotNull()).select(X.word_count("separate_opinion_extracted").alias("w"))
    return curate.histogram(words, "w")


@query(f"""SELECT author, n, round(avg_words, 6) AS avg_words, round_even(avg_words, 0)::BIGINT || ' (n=' || n || ')' AS label FROM
 (SELECT separate_opinion AS author, count(*) AS n, avg({_WORDS('separate_opinion_extracted')}) AS avg_words FROM subset_disent2 GROUP BY 1)""")
def avg_words_by_author(spark, d):
    return _rounded(curate.words_by_author(read_table(spark, d, "subset_disent2")), "avg_words")


_LOADED = f"SELECT * FROM (SELECT * REPLACE ({_TRIM('separate_opinion')} AS separate_opinion, date_decision::TIMESTAMP AS date_decision), count(*) OVER (PARTITION BY {_TRIM('separate_opinion')}) AS k FROM subset_disent2) WHERE separate_opinion <> '' AND k >= 5"


@query(f"SELECT doc_id, separate_opinion, strftime(date_decision, '%Y-%m-%d %H:%M:%S') AS date_decision FROM ({_LOADED})")
def min_docs_filter(spark, d):
    return curate.load_dissents(read_table(spark, d, "subset_disent2")).select("doc_id", "separate_opinion", F.date_format("date_decision", "yyyy-MM-dd HH:mm:ss").alias("date_decision"))


@query(f"SELECT separate_opinion AS author, count(doc_id) AS n_dissents, round(avg(w), 6) AS mean_words, round(median(w), 6) AS median_words, min(w) AS min_words, max(w) AS max_words, sum(w)::BIGINT AS total_words FROM (SELECT *, coalesce({_WORDS('separate_opinion_extracted')}, 0) AS w FROM ({_LOADED})) GROUP BY 1")
def author_summary(spark, d):
    return _rounded(curate.author_summary(curate.load_dissents(read_table(spark, d, "subset_disent2"))), "mean_words", "median_words")


# --- text -----------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, length(c) AS n, md5(c) AS clean_md5 FROM (SELECT doc_id, {_CLEAN('text')} AS c FROM subset)")
def clean_text(spark, d):
    return read_texts(spark, d, "subset").select("doc_id", X.clean_text("text").alias("c")).select("doc_id", F.length("c").alias("n"), F.md5("c").alias("clean_md5"))


@query(f"SELECT doc_id, length(c) AS n, md5(c) AS text_md5 FROM (SELECT doc_id, {_HTML('text')} AS c FROM subset)")
def html_to_text(spark, d):
    return read_texts(spark, d, "subset").select("doc_id", X.html_to_text("text").alias("c")).select("doc_id", F.length("c").alias("n"), F.md5("c").alias("text_md5"))


@query(f"{_TOK} SELECT doc_id, sent_id::INT AS sent_id, tok_id::INT AS tok_id, form, lemma, upos FROM tok")
def tokenize(spark, d):
    return opinion_tokens(spark, d).select("doc_id", "sent_id", "tok_id", "form", "lemma", "upos")


@query(f"{_TOK} SELECT doc_id, (max(sent_id) + 1)::INT AS n_sentences, count(*) AS n_tokens FROM tok GROUP BY doc_id")
def document_view(spark, d):
    docs = annotate.as_documents(opinion_tokens(spark, d))
    return docs.select("doc_id", F.size("sentences").alias("n_sentences"), F.aggregate("sentences", F.lit(0).cast("long"), lambda a, s: a + F.size(s)).alias("n_tokens"))


@query(
    """SELECT doc_id, sent_id::INT AS sent_id, tok_id::INT AS tok_id, form, 'lemma' AS lemma, 'X' AS upos FROM (SELECT doc_id, unnest(k) AS form, 0 AS sent_id, generate_subscripts(k, 1) - 1 AS tok_id
 FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '^[a-zA-Z]+$')) AS k FROM documents))"""
)
def conllu_parse(spark, d):
    """Latin words of the documents written as one CoNLL-U sentence each, with a comment and rows that must be skipped, and read again.

    Whole texts, with their sentences: ``conllu_round_trip``."""
    words = F.filter(F.split("text", " "), lambda w: w.rlike("^[a-zA-Z]+$"))
    rows = F.transform(words, lambda w, i: F.concat_ws("\t", (i + 1).cast("string"), w, F.lit("lemma"), F.lit("X"), F.lit("_"), F.lit("_"), F.lit("0")))
    text = F.concat_ws("\n", F.lit("# sent"), F.lit("1-2\tab\ta\tX\t_\t_"), F.lit("1.1\tab\ta\tX\t_\t_"), F.lit("short\trow"), F.array_join(rows, "\n"), F.lit(""))
    docs = read_texts(spark, d, "documents").where(F.col("text").isNotNull() & (F.size(words) > 0)).select("doc_id", text.alias("conllu"))
    return read_conllu(docs).select("doc_id", "sent_id", "tok_id", "form", "lemma", "upos")


@query(SQL["tokenize"])
def conllu_round_trip(spark, d):
    """All tokens of the opinions written as CoNLL-U with their sentences, and read again."""
    docs = sinks.conllu_texts(annotate.as_documents(opinion_tokens(spark, d)))
    return read_conllu(docs).select("doc_id", "sent_id", "tok_id", "form", "lemma", "upos")


# --- features -------------------------------------------------------------------------------------------------------------


@query(f"{_TOK}, t AS (SELECT doc_id, count(*) AS total FROM tok GROUP BY 1) SELECT doc_id, lemma AS word, round(count(*) / any_value(total), 6) AS freq FROM tok JOIN t USING (doc_id) WHERE lemma IN ({_quoted(function_words())}) GROUP BY doc_id, lemma")
def function_word_freq(spark, d):
    return _rounded(features.function_word_freq(opinion_tokens(spark, d)), "freq")


@query(f"""{_TOK}, n AS (SELECT doc_id, sent_id, count(*) AS n FROM tok GROUP BY 1, 2) SELECT doc_id, round(avg(n), 6) AS sent_len_mean, round(stddev_pop(n), 6) AS sent_len_std, round(median(n), 6) AS sent_len_median,
 min(n)::DOUBLE AS sent_len_min, max(n)::DOUBLE AS sent_len_max, count(*)::DOUBLE AS sent_count FROM n GROUP BY doc_id""")
def sentence_length(spark, d):
    return _rounded(features.sentence_length(opinion_tokens(spark, d)), "sent_len_mean", "sent_len_std", "sent_len_median")


@query(f"{_TOK} SELECT doc_id, round(avg(length(form)), 6) AS word_len_mean, round(stddev_pop(length(form)), 6) AS word_len_std, round(median(length(form)), 6) AS word_len_median FROM tok WHERE upos <> 'PUNCT' GROUP BY doc_id")
def word_length(spark, d):
    return _rounded(features.word_length(opinion_tokens(spark, d)), "word_len_mean", "word_len_std", "word_len_median")


_MARKS = {n: f"sum((form = '{p}')::INT) * 1000 / count(*)" for n, p in zip(features.punct_names(), features.PUNCTUATION, strict=True)}


@query(f"{_TOK} " + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, round({x}, 6) AS value FROM tok GROUP BY doc_id" for n, x in _MARKS.items()))
def punct_per_1k(spark, d):
    return _rounded(features.punctuation(opinion_tokens(spark, d)).unpivot("doc_id", [F.col(f"`{n}`") for n in features.punct_names()], "name", "value"), "value")


@query(f"""{_TOK}, f AS (SELECT doc_id, lemma, count(*) AS n FROM tok WHERE upos <> 'PUNCT' GROUP BY 1, 2) SELECT doc_id, round(count(*) / sum(n), 6) AS ttr_form, round(count(*) / sum(n), 6) AS ttr_lemma,
 round(sum((n = 1)::INT) / sum(n), 6) AS hapax_ratio FROM f GROUP BY doc_id""")
def vocab_richness(spark, d):
    return _rounded(features.richness(opinion_tokens(spark, d)), "ttr_form", "ttr_lemma", "hapax_ratio")


@query(f"""{_TOK}{_C3} SELECT doc_id, gram, rank, round(n / total, 6) AS freq FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram)::INT AS rank FROM c) WHERE rank <= 20""")
def char3_topk_per_doc(spark, d):
    return _rounded(features.top_per_doc(features.char_counts(opinion_tokens(spark, d)), 20), "freq")


@query(f"SELECT gram, round(weight, 6) AS weight FROM ({_TOK}{_C3} {_vocab(200)})")
def char3_vocab(spark, d):
    return _rounded(features.vocabulary(features.char_counts(opinion_tokens(spark, d)), 200), "weight")


_GRAMS = ("je ", " na", " po", "ní ", "ost", " př", "ova")


@query(f"{_TOK}{_C3} SELECT doc_id, gram, round(n / total, 6) AS freq FROM c WHERE gram IN ({_quoted(_GRAMS)})")
def char3_fixed_vocab(spark, d):
    return _rounded(features.fixed_vocabulary(features.char_counts(opinion_tokens(spark, d)), _GRAMS), "freq")


@query(f"{_TOK}{_P2} SELECT doc_id, gram, round(n / total, 6) AS freq FROM c")
def pos2_profile(spark, d):
    return _rounded(features.profile(features.pos_counts(opinion_tokens(spark, d))), "freq")


@query(f"SELECT gram, round(weight, 6) AS weight FROM ({_TOK}{_P2} {_vocab(100)})")
def pos2_vocab(spark, d):
    return _rounded(features.vocabulary(features.pos_counts(opinion_tokens(spark, d)), 100), "weight")


#: For each surface feature the rows it is made of and its value.
_SURFACE = {
    **{f"sent_len_{k}": ("sl", x) for k, x in (("mean", "avg(n)"), ("std", "stddev_pop(n)"), ("median", "median(n)"), ("min", "min(n)"), ("max", "max(n)"))},
    "sent_count": ("sl", "count(*)"),
    **{f"word_len_{k}": ("wd", f"{x}(length(form))") for k, x in (("mean", "avg"), ("std", "stddev_pop"), ("median", "median"))},
    **{n: ("tok", x) for n, x in _MARKS.items()},
    "ttr_form": ("ty", "count(*) / sum(n)"),
    "ttr_lemma": ("ty", "count(*) / sum(n)"),
    "hapax_ratio": ("ty", "sum((n = 1)::INT) / sum(n)"),
}


def _matrix_sql(source: str, sets: tuple[str, ...] = features.FEATURE_SETS) -> str:
    """Tables up to fm: doc_id, name, value of the features of ``source``, zeros filled."""
    parts = [f"{_tokens(source)}, tt AS (SELECT doc_id, count(*) AS total FROM tok GROUP BY 1)"]
    values, names = [], []
    if "function_words" in sets:
        values.append(f"SELECT doc_id, 'fw_' || lemma AS name, count(*) / any_value(total) AS value FROM tok JOIN tt USING (doc_id) WHERE lemma IN ({_quoted(function_words())}) GROUP BY doc_id, lemma")
        names.append(f"SELECT 'fw_' || unnest([{_quoted(function_words())}]) AS name")
    if "surface" in sets:
        parts.append("sl AS (SELECT doc_id, sent_id, count(*) AS n FROM tok GROUP BY 1, 2), wd AS (SELECT * FROM tok WHERE upos <> 'PUNCT'), ty AS (SELECT doc_id, lemma, count(*) AS n FROM wd GROUP BY 1, 2)")
        values += [f"SELECT doc_id, '{n}' AS name, {x} AS value FROM {t} GROUP BY doc_id" for n, (t, x) in _SURFACE.items()]
        names.append(f"SELECT unnest([{_quoted(_SURFACE)}])")
    for kind, t, k in (("char_ngrams", "3", 200), ("pos_ngrams", "2", 100)):
        if kind in sets:
            label = "char3_" if t == "3" else "pos2_"
            parts.append(f"{_grams(kind, t)}, v{t} AS ({_vocab(k, t)})")
            values.append(f"SELECT doc_id, '{label}' || gram AS name, n / total AS value FROM c{t} SEMI JOIN v{t} USING (gram)")
            names.append(f"SELECT '{label}' || gram FROM v{t}")
    return f"{', '.join(parts)}, val AS ({' UNION ALL '.join(values)}), nam AS ({' UNION ALL '.join(names)}), fm AS (SELECT doc_id, name, coalesce(value, 0)::DOUBLE AS value FROM {source} CROSS JOIN nam LEFT JOIN val USING (doc_id, name))"


def _long(made: DataFrame, names: list[str]) -> DataFrame:
    rows = made.select("doc_id", F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("name"), F.col("features").alias("value"))).alias("x"))
    return _rounded(rows.select("doc_id", F.col("x.name").alias("name"), F.col("x.value").alias("value")), "value")


@query(f"WITH {_OPINIONS}, {_matrix_sql('op', ('function_words', 'char_ngrams'))} SELECT doc_id, name, round(value, 6) AS value FROM fm")
def feature_matrix(spark, d):
    return _long(*features.matrix(opinions(spark, d), opinion_tokens(spark, d), ("function_words", "char_ngrams")))


@query(f"WITH {_OPINIONS}, {_matrix_sql('op')} SELECT doc_id, name, round(value, 6) AS value FROM fm")
def feature_matrix_full(spark, d):
    """All features: 240 function words, 23 of the surface, 200 character and up to 100 part-of-speech n-grams, as many as there are."""
    docs = checkpoint(opinions(spark, d))
    return _long(*features.matrix(docs, checkpoint(annotate.annotate_rules(docs))))


# --- profiles, Delta, classifiers -----------------------------------------------------------------------------------------


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as (doc_id, author, features), author being the label."""
    e = read_table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("doc_id"), F.col("label").cast("string").alias("author"), F.col("embedding").cast("array<double>").alias("features"))


_E = """e AS (SELECT vec_id::VARCHAR AS doc_id, label::VARCHAR AS author, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
 st AS (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM e GROUP BY pos),
 au AS (SELECT author, pos, avg(x) AS m, sum(x) AS s, count(*) AS n FROM e GROUP BY 1, 2)"""
_SCORES = {
    "burrows": "avg(abs(x - m) / std)",
    "cosine": "CASE WHEN sum(x*x/std/std) = 0 OR sum(m*m/std/std) = 0 THEN 1.0 ELSE 1 - sum(x*m/std/std) / sqrt(sum(x*x/std/std)) / sqrt(sum(m*m/std/std)) END",
}


def _scores_sql(method: str, loo: bool) -> str:
    if not loo:
        z = "SELECT e.doc_id, e.author, au.author AS candidate, e.x, au.m, CASE WHEN st.std > 0 THEN st.std ELSE 1 END AS std FROM e JOIN au USING (pos) JOIN st USING (pos)"
    else:
        z = """SELECT doc_id, author, candidate, x, m, CASE WHEN v > 0 THEN sqrt(v) ELSE 1 END AS std FROM (SELECT e.doc_id, e.author, au.author AS candidate, e.x,
  CASE WHEN au.author = e.author THEN (au.s - e.x) / (au.n - 1) ELSE au.m END AS m, (st.q - e.x * e.x) / (st.n - 1) - ((st.s - e.x) / (st.n - 1)) ** 2 AS v
  FROM e JOIN au USING (pos) JOIN st USING (pos) WHERE au.author <> e.author OR au.n > 1)"""
    return f"WITH {_E}, z AS ({z}), sc AS (SELECT doc_id, author, candidate, round({_SCORES[method]}, 9) AS score FROM z GROUP BY 1, 2, 3)"


def _loo_sql(method: str) -> str:
    return f"""{_scores_sql(method, True)}, rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, candidate) AS r FROM sc)
 SELECT '{method}' AS method, doc_id, author, max(CASE WHEN r = 1 THEN candidate END) AS predicted, max(CASE WHEN candidate = author THEN r END)::INT AS rank_of_true FROM rk GROUP BY doc_id, author"""


@query(f"WITH {_E} SELECT author, pos::INT AS pos, round(m, 6) AS mean FROM au")
def author_profiles(spark, d):
    return _rounded(profiles.author_profiles(vectors(spark, d)), "mean")


@query(f"WITH {_E} SELECT pos::INT AS pos, round(mean, 6) AS mean, round(std, 6) AS std FROM st")
def corpus_stats(spark, d):
    return _rounded(profiles.corpus_stats(vectors(spark, d)), "mean", "std")


@query(f"WITH {_E} SELECT doc_id, pos::INT AS pos, round((x - mean) / CASE WHEN std > 0 THEN std ELSE 1 END, 6) AS z FROM e JOIN st USING (pos)")
def standard_scale(spark, d):
    return _rounded(profiles.standard_scale(vectors(spark, d)).select("doc_id", F.posexplode("features").alias("pos", "z")), "z")


@query(f"{_scores_sql('burrows', False)} SELECT doc_id, author, candidate, round(score, 6) AS score FROM sc")
def burrows_delta(spark, d):
    v = vectors(spark, d)
    return _rounded(delta.delta_scores(v, v, "burrows"), "score")


@query(f"{_scores_sql('cosine', False)} SELECT doc_id, author, candidate, round(score, 6) AS score FROM sc")
def cosine_delta(spark, d):
    v = vectors(spark, d)
    return _rounded(delta.delta_scores(v, v, "cosine"), "score")


@query(_loo_sql("burrows"))
def loo_burrows(spark, d):
    return delta.loo_delta(vectors(spark, d), "burrows")


@query(_loo_sql("cosine"))
def loo_cosine(spark, d):
    return delta.loo_delta(vectors(spark, d), "cosine")


@query(f"SELECT count(*) AS n, round(avg((predicted = author)::INT), 6) AS accuracy, round(avg((rank_of_true <= 3)::INT), 6) AS rank3_accuracy FROM ({_loo_sql('burrows')})")
def rank3_accuracy(spark, d):
    return _rounded(evaluate.metrics(delta.loo_delta(vectors(spark, d), "burrows")).select("n", "accuracy", "rank3_accuracy"), "accuracy", "rank3_accuracy")


_VOTES = """t AS (SELECT doc_id, author, label, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(dist, 9), other) AS r FROM p) WHERE r <= 3 GROUP BY 1, 2, 3)
 SELECT 'knn' AS method, doc_id, author, first(label ORDER BY n DESC, label) AS predicted, NULL::INT AS rank_of_true FROM t GROUP BY 2, 3"""


@query(
    f"""WITH {_E}, w AS (SELECT doc_id, pos, (st.q - x * x) / (st.n - 1) - ((st.s - x) / (st.n - 1)) ** 2 AS v FROM e JOIN st USING (pos)),
 p AS (SELECT a.doc_id, a.author, b.doc_id AS other, b.author AS label, sqrt(sum((a.x - b.x) ** 2 / CASE WHEN v > 0 THEN v ELSE 1 END)) AS dist
  FROM e a JOIN e b ON a.pos = b.pos AND a.doc_id <> b.doc_id JOIN w ON w.doc_id = a.doc_id AND w.pos = a.pos GROUP BY 1, 2, 3, 4), {_VOTES}"""
)
def knn_loo(spark, d):
    return classify.loo_knn(vectors(spark, d))


@query()
def loo_svm(spark, d):
    return classify.loo_linear(vectors(spark, d), "svm")


@query()
def loo_logistic(spark, d):
    return classify.loo_linear(vectors(spark, d), "logistic")


# --- the opinions by their features ----------------------------------------------------------------------------------------


def attribution_features(spark: SparkSession, d: str, least: int = 5) -> DataFrame:
    """The feature matrix of the opinions of authors with ``least`` opinions or more, written once."""
    docs = checkpoint(curate.at_least(opinions(spark, d), "author", least))
    made, _ = features.matrix(docs, checkpoint(annotate.annotate_rules(docs)))
    return checkpoint(made)


#: Each fold refitted by itself: deviations and profiles of all other texts.
_FOLDS = f"""WITH {_OPINIONS}, kept AS (SELECT * FROM op QUALIFY count(*) OVER (PARTITION BY author) >= 5), {_matrix_sql('kept')},
 e AS (SELECT doc_id, author, name, value AS x FROM fm JOIN kept USING (doc_id)), f AS (SELECT doc_id AS fold FROM kept),
 st AS (SELECT fold, name, CASE WHEN min(x) = max(x) THEN 1 ELSE stddev_pop(x) END AS s FROM f JOIN e ON e.doc_id <> fold GROUP BY 1, 2),
 au AS (SELECT fold, author AS candidate, name, avg(x) AS m FROM f JOIN e ON e.doc_id <> fold GROUP BY 1, 2, 3),
 z AS (SELECT e.doc_id, e.author, candidate, x / s AS a, m / s AS b FROM e JOIN st ON fold = e.doc_id AND st.name = e.name JOIN au ON au.fold = e.doc_id AND au.name = e.name),
 sc AS (SELECT doc_id, author, candidate, round(avg(abs(a - b)), 9) AS burrows, round(CASE WHEN sum(a * a) = 0 OR sum(b * b) = 0 THEN 1.0 ELSE 1 - sum(a * b) / sqrt(sum(a * a)) / sqrt(sum(b * b)) END, 9) AS cosine FROM z GROUP BY 1, 2, 3),
 rk AS (SELECT *, row_number() OVER (PARTITION BY method, doc_id ORDER BY score, candidate) AS r FROM (UNPIVOT sc ON burrows, cosine INTO NAME method VALUE score)),
 p AS (SELECT a.doc_id, a.author, b.doc_id AS other, b.author AS label, sqrt(sum(((a.x - b.x) / s) ** 2)) AS dist FROM e a JOIN e b ON a.name = b.name AND a.doc_id <> b.doc_id JOIN st ON fold = a.doc_id AND st.name = a.name GROUP BY 1, 2, 3, 4),
 votes AS (WITH {_VOTES})"""


@query(f"""{_FOLDS} SELECT method, doc_id, author, max(CASE WHEN r = 1 THEN candidate END) AS predicted, max(CASE WHEN candidate = author THEN r END)::INT AS rank_of_true FROM rk GROUP BY 1, 2, 3
 UNION ALL SELECT method, doc_id, author, predicted, rank_of_true FROM votes""")
def attribution(spark, d):
    """Who wrote each opinion, by all features: leave-one-out predictions of Burrows' Delta, Cosine Delta and nearest neighbours."""
    return pipeline.evaluate_methods(attribution_features(spark, d), ("burrows", "cosine", "knn"))


@query()
def attribution_linear(spark, d):
    """The same by the linear SVM and by logistic regression, refitted for each opinion."""
    return pipeline.evaluate_methods(attribution_features(spark, d), ("svm", "logistic"))


# --- metrics --------------------------------------------------------------------------------------------------------------

_PRED = "p AS (SELECT method, author, predicted AS pred, rank_of_true FROM predictions)"


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "predictions")


@query(f"WITH {_PRED} SELECT method, count(*) AS n, round(avg(coalesce(pred IS NOT DISTINCT FROM author, false)::INT), 6) AS accuracy, round(CASE WHEN count(rank_of_true) > 0 THEN avg(coalesce(rank_of_true <= 3, false)::INT) END, 6) AS rank3_accuracy FROM p GROUP BY method")
def accuracy(spark, d):
    return _rounded(evaluate.metrics(_predictions(spark, d)), "accuracy", "rank3_accuracy")


_LABELS = ", r AS (SELECT * FROM p WHERE author IS NOT NULL AND pred IS NOT NULL), l AS (SELECT method, author AS l FROM r UNION SELECT method, pred FROM r)"


@query(f"WITH {_PRED}{_LABELS}, c AS (SELECT method, author, pred, count(*) AS n FROM r GROUP BY 1, 2, 3) SELECT a.method, a.l AS true, b.l AS pred, coalesce(n, 0)::BIGINT AS n FROM l a JOIN l b USING (method) LEFT JOIN c ON c.method = a.method AND c.author = a.l AND c.pred = b.l")
def confusion_matrix(spark, d):
    return evaluate.confusion(_predictions(spark, d))


_REPORT = f"""WITH {_PRED}{_LABELS}, k AS (SELECT method, l AS label, (SELECT count(*) FROM r WHERE r.method = l.method AND r.author = l.l) AS support, (SELECT count(*) FROM r WHERE r.method = l.method AND r.pred = l.l) AS npred,
 (SELECT count(*) FROM r WHERE r.method = l.method AND r.author = l.l AND r.pred = l.l) AS tp FROM l), pr AS (SELECT method, label, coalesce(tp / nullif(npred, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, support FROM k),
 rep AS (SELECT method, label, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM pr)"""


@query(f"{_REPORT} SELECT method, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep")
def classification_report(spark, d):
    return _rounded(evaluate.class_report(_predictions(spark, d)), "precision", "recall", "f1")


_AVG = [f"{k}_{c}" for k in ("macro", "weighted") for c in ("precision", "recall", "f1")]


@query(f"{_REPORT} SELECT method, " + ", ".join(f"round(avg({c}), 6) AS macro_{c}, round(sum({c} * support) / sum(support), 6) AS weighted_{c}" for c in ("precision", "recall", "f1")) + " FROM rep GROUP BY method")
def report_averages(spark, d):
    return _rounded(evaluate.averages(evaluate.class_report(_predictions(spark, d))), *_AVG)


# --- the flagship ---------------------------------------------------------------------------------------------------------


def flagship(spark: SparkSession, d: str, words: int = 30) -> DataFrame:
    """Documents to tokens, the most common words as features, leave-one-out Burrows' Delta by source."""
    docs = read_texts(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce("source", F.lit("unknown")).alias("author"))
    toks = annotate.annotate_rules(docs)
    counts = toks.groupBy("doc_id", "lemma", (F.col("upos") == "PUNCT").alias("mark")).agg(F.count(F.lit(1)).alias("n"))
    counts = checkpoint(counts)  # texts are read once
    common = [r["lemma"] for r in counts.where(~F.col("mark")).groupBy("lemma").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lemma").limit(words).collect()]
    columns = [(F.coalesce(F.sum(F.when(F.col("lemma") == w, F.col("n"))), F.lit(0)) / F.sum("n")).alias(f"w{i}") for i, w in enumerate(common)]
    freq = counts.groupBy("doc_id").agg(*columns)
    vec = F.array(*[F.coalesce(f"w{i}", F.lit(0.0)) for i in range(len(common))])
    made = docs.select("doc_id", "author").join(freq, "doc_id", "left").select("doc_id", "author", vec.alias("features"))
    return delta.loo_delta(checkpoint(made), "burrows")


@query()
def flagship_loo_by_source(spark, d):
    return flagship(spark, d)


QUERIES.update(data_queries.QUERIES)
SQL.update(data_queries.SQL)
