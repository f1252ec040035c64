"""Queries of the record loader (problem 3) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from ..sources import records


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.rejected(table(spark, sf_dir, "question_csv")).select("line_id", "reason")


def p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.loaded(table(spark, sf_dir, "question_csv"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.by_file(table(spark, sf_dir, "question_csv"))


QUERIES = {"p3_found": p3_found, "p3_rows": p3_rows, "p3_report": p3_report}

_CLASSES = r"""
WITH cut AS (
  SELECT *, coalesce(delimiter, ',') AS sep, string_split(coalesce(record, ''), '"') AS parts FROM question_csv
), outside AS (
  SELECT *, list_transform(parts, lambda x, i: CASE WHEN i % 2 = 1 THEN replace(x, sep, chr(57344)) ELSE x END) AS seg,
    len(parts) % 2 = 1 AND len(list_filter(list_transform(parts, lambda x, i: i % 2 = 1 AND x <> ''
      AND NOT ((i = 1 OR starts_with(x, sep)) AND (i = len(parts) OR ends_with(x, sep)))), lambda b: b)) = 0 AS sound
  FROM cut
), raw AS (
  SELECT *, string_split(array_to_string(seg, '"'), chr(57344)) AS f FROM outside
), fields AS (
  SELECT *, list_transform(f, lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS v FROM raw
), judged AS (
  SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN len(v) <> 7 THEN 'column_count'
    WHEN NOT (regexp_full_match(v[1], '0*[1-9][0-9]*') AND regexp_matches(v[3], '[^\s\pZ\x1c-\x1f\x{85}]')
      AND v[5] IN ('pending', 'needs-input', 'flagged', 'auto-filled', 'answered')
      AND (v[6] = '' OR regexp_full_match(v[6], '0*([0-9]{1,2}|100)'))
      AND (v[7] = '' OR (regexp_full_match(v[7], '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(v[7] AS DATE) IS NOT NULL))) THEN 'value' END AS reason
  FROM fields
)
"""

SQL = {
    "p3_found": _CLASSES + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_rows": _CLASSES
    + """SELECT line_id, file_id, line_no, CAST(v[1] AS BIGINT) AS question_number, v[2] AS vendor, v[3] AS question_text, v[4] AS answer_text, v[5] AS status,
      CASE WHEN v[6] <> '' THEN CAST(v[6] AS INTEGER) END AS confidence, CASE WHEN v[7] <> '' THEN CAST(v[7] AS DATE) END AS saved_date
    FROM judged WHERE reason IS NULL""",
    "p3_report": _CLASSES
    + """SELECT file_id, count(*) AS records, count(*) FILTER (reason = 'quoting') AS quoting, count(*) FILTER (reason = 'column_count') AS column_count, count(*) FILTER (reason = 'value') AS value
    FROM judged GROUP BY file_id""",
}
