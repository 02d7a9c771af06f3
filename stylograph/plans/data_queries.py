"""The queries of the data-processing operators of the core library: rows that fail to parse (p2) and packed values (p4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylograph.operators import multivalue, parse_rejects
from stylograph.sources.tables import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _parsed(spark, d):
    return parse_rejects.parse_records(read_table(spark, d, "subset_raw"))


def p2_found(spark, d):
    """raw_id, reason of each record that gives no valid row."""
    return parse_rejects.rejects(_parsed(spark, d))


def p2_cells(spark, d):
    """raw_id, column, value of each failing cell."""
    return parse_rejects.failing_cells(_parsed(spark, d))


def p2_out_of_range(spark, d):
    """raw_id, column, value of the numbers of valid rows that the type of their column does not hold."""
    return parse_rejects.out_of_range(_parsed(spark, d))


def p2_rows(spark, d):
    """The valid rows, typed."""
    return parse_rejects.valid_rows(_parsed(spark, d))


_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_NAMES = [f.name for f in parse_rejects.SUBSET_FIELDS]
_RECORDS = f"""WITH r AS (SELECT raw_id, coalesce(line, '') AS line FROM subset_raw),
 s AS (SELECT raw_id, regexp_full_match(line, '(?s){_FIELD}(?:,{_FIELD})*') AS quoted, list_transform(regexp_extract_all(line || ',', '(?s)({_FIELD}),', 1),
  lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f FROM r),
 n AS (SELECT raw_id, quoted, len(f) AS width, {', '.join(f"CASE WHEN f[{i + 1}] NOT IN ('', 'NA') THEN f[{i + 1}] END AS {c}" for i, c in enumerate(_NAMES))} FROM s)"""
_BAD = {
    "doc_id": r"NOT coalesce(regexp_full_match(doc_id, 'ECLI:CZ:US:[0-9]{4}:(Pl|[0-9])\.US\.[0-9]+\.[0-9]{2}\.[0-9]+'), false)",
    "text": r"NOT coalesce(NOT regexp_matches(text, '[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]'), false)",
    **{c: f"{c} IS NOT NULL AND NOT (regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast({c} AS DATE) IS NOT NULL)" for c in ("date_decision", "date_submission")},
    **{c: f"{c} IS NOT NULL AND NOT regexp_full_match({c}, '[0-9]+')" for c in ("importance", "length_proceeding")},
}
_REASON = f"CASE WHEN NOT quoted THEN 'quoting' WHEN width <> {len(_NAMES)} THEN 'columns' WHEN {' OR '.join(f'({x})' for x in _BAD.values())} THEN 'value' END"
_TYPED = {"date": "DATE", "int": "INT", "string": "VARCHAR"}

QUERIES |= {"p2_found": p2_found, "p2_cells": p2_cells, "p2_rows": p2_rows, "p2_out_of_range": p2_out_of_range}
SQL |= {
    "p2_found": f"{_RECORDS} SELECT raw_id, reason FROM (SELECT raw_id, {_REASON} AS reason FROM n) WHERE reason IS NOT NULL",
    "p2_cells": f"{_RECORDS}, v AS (SELECT * FROM n WHERE ({_REASON}) = 'value') " + " UNION ALL ".join(f"SELECT raw_id, '{c}' AS \"column\", {c} AS value FROM v WHERE {x}" for c, x in _BAD.items()),
    "p2_out_of_range": f"{_RECORDS}, v AS (SELECT * FROM n WHERE ({_REASON}) IS NULL) " + " UNION ALL ".join(f"SELECT raw_id, '{c}' AS \"column\", {c} AS value FROM v WHERE {c} IS NOT NULL AND try_cast({c} AS INT) IS NULL" for c in ("importance", "length_proceeding")),
    "p2_rows": f"{_RECORDS} SELECT raw_id, {', '.join(f'try_cast({f.name} AS {_TYPED[f.kind]}) AS {f.name}' for f in parse_rejects.SUBSET_FIELDS)} FROM n WHERE ({_REASON}) IS NULL",
}


def p4_found(spark, d):
    """field, doc_id, pos, val of each cell with two values or more."""
    found = multivalue.split_values(read_table(spark, d, "subset"), ["type_verdict", "separate_opinion"])
    return found.where(F.col("n") > 1).select("field", "doc_id", "pos", "val")


def p4_values(spark, d):
    """field, val, n: how many keys hold each value, over all cells."""
    return multivalue.split_values(read_table(spark, d, "subset"), ["type_verdict", "separate_opinion"]).groupBy("field", "val").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES |= {"p4_found": p4_found, "p4_values": p4_values}
_VALUES = """WITH k AS (SELECT 'type_verdict' AS field, verdict_name AS val FROM verdict_types UNION SELECT 'separate_opinion', unnest([judge_name, judge_titled]) FROM judges),
 re AS (SELECT field, string_agg(regexp_escape(val), '|' ORDER BY length(val) DESC, val) AS re FROM k GROUP BY field),
 c AS (SELECT DISTINCT field, doc_id, replace(replace(cell, '\\"', '"'), '""', '"') AS cell FROM (UNPIVOT (SELECT doc_id, type_verdict, separate_opinion FROM subset) ON type_verdict, separate_opinion INTO NAME field VALUE cell) WHERE doc_id NOT IN ('', 'NA')),
 m AS (SELECT field, doc_id, regexp_extract_all(cell, re) AS vals FROM c JOIN re USING (field))"""
SQL |= {
    "p4_found": f"{_VALUES} SELECT field, doc_id, generate_subscripts(vals, 1)::BIGINT AS pos, unnest(vals) AS val FROM m WHERE len(vals) > 1",
    "p4_values": f"{_VALUES} SELECT field, val, count(*) AS n_docs FROM (SELECT field, unnest(vals) AS val FROM m) GROUP BY 1, 2",
}
