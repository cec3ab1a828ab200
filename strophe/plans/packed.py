"""Queries of problem 2: several values packed in one field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strophe.operators.packed import LIST_SEPARATORS, TEXT_SEPARATORS, split_packed


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value of a cell with at least two: feature_flags by any list separator, provenance_evidence by those that text cannot hold."""
    rec = spark.read.parquet(f"{d}/recordings.parquet")
    return split_packed(rec, "item_id", {"feature_flags": LIST_SEPARATORS, "provenance_evidence": TEXT_SEPARATORS}, least=2)


_SPACE = r"[ \t\n\r\x{a0}\x{3000}]"
_QUOTED = r'"(?:[^"\\]|""|\\.)*"|“[^”]*”|「[^」]*」|『[^』]*』|«[^»]*»'


def _pieces_sql(field: str, marks: str) -> str:
    """The values of a field by regular expressions: quoted values, or runs of escaped characters and of such as part nothing."""
    one = lambda m: f"(?:{_SPACE}*(?:{_QUOTED}){_SPACE}*(?:[{m}]|$))|(?:(?:\\\\.|[^{m}\\\\])+)"
    plain, listed = (one(m).replace("'", "''") for m in (marks, marks + ","))
    return f"""SELECT item_id, '{field}' AS field, CASE WHEN listed THEN regexp_extract_all(body, '{listed}') ELSE regexp_extract_all(body, '{plain}') END AS parts, '{marks}' || CASE WHEN listed THEN ',' ELSE '' END AS marks
      FROM (SELECT item_id, body, bracketed AND left(trim(body), 1) IN ('"', '“', '「', '『', '«') AS listed FROM (SELECT item_id, b AS bracketed, CASE WHEN b THEN c[2:-2] ELSE c END AS body
        FROM (SELECT item_id, c, regexp_full_match(c, '(?s)\\[.*\\]|【.*】') AS b FROM (SELECT DISTINCT item_id, trim({field}, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) AS c FROM recordings WHERE {field} NOT IN ('', 'NA', 'nan', 'None')))))"""


QUERIES = {"p2_found": p2_found}
SQL: dict[str, str] = {
    "p2_found": f"""WITH c AS ({_pieces_sql("feature_flags", LIST_SEPARATORS)} UNION ALL {_pieces_sql("provenance_evidence", TEXT_SEPARATORS)}),
    t AS (SELECT item_id, field, list_transform(parts, lambda p: regexp_replace(p, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS parts, marks FROM c),
    u AS (SELECT item_id, field, list_transform(parts, lambda p: CASE WHEN left(p, 1) IN ('"', '“', '「', '『', '«') AND contains(marks, right(p, 1)) THEN regexp_replace(p[1:-2], '{_SPACE}+$', '') ELSE p END) AS parts FROM t),
    q AS (SELECT item_id, field, list_filter(list_transform(parts, lambda p: CASE WHEN regexp_full_match(p, '(?s){_QUOTED.replace("'", "''")}') THEN replace(regexp_replace(p[2:-2], '\\\\([^A-Za-z0-9])', '\\1', 'g'), '""', '"') ELSE regexp_replace(p, '\\\\([^A-Za-z0-9])', '\\1', 'g') END), lambda p: p <> '') AS parts FROM u)
    SELECT item_id, field, CAST(unnest(range(len(parts))) AS INTEGER) AS pos, unnest(parts) AS piece FROM q WHERE len(parts) > 1""",
}
