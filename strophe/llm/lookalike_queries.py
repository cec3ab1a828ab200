"""Queries of problem 5: visually identical text with different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strophe.functions.text import INVISIBLE_CLASS, SPACE_CLASS, lookalike_table
from strophe.llm.lookalike import lookalike_classes, lookalike_pairs
from strophe.llm.names_queries import distinct_values

FIELDS = ["title", "song_name"]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of raw titles, and of raw song names, that read the same on screen."""
    return lookalike_pairs(distinct_values(spark.read.parquet(f"{d}/recordings.parquet"), FIELDS))


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Each recording with its title and song name in one consistent form (null where missing)."""
    rec = spark.read.parquet(f"{d}/recordings.parquet").select("item_id", *FIELDS).distinct()
    c = lookalike_classes(distinct_values(rec, FIELDS))
    for f in FIELDS:
        to = c.where(F.col("field") == f).select(F.col("value").alias(f), F.col("canonical").alias(f"{f}_canonical"))
        rec = rec.join(to, f, "left")
    return rec.select("item_id", *[F.col(f"{f}_canonical").alias(f) for f in FIELDS])


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _plain_sql(column: str) -> str:
    pairs = [(a, b) for a, b in lookalike_table().items() if ord(a) < 0x10000 and ord(b) < 0x10000]
    source, target = "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
    c = f"regexp_replace({column}, {_sql_text(INVISIBLE_CLASS)}, '', 'g')"
    c = f"regexp_replace({c}, {_sql_text(SPACE_CLASS + '+')}, ' ', 'g')"
    return f"trim(translate({c}, {_sql_text(source)}, {_sql_text(target)}))"


def _skeleton_sql(column: str) -> str:
    return f"nfc_normalize({_plain_sql(column)})"


_VALUES = """v AS (SELECT field, value, {skeleton} AS sk FROM (
  SELECT DISTINCT 'title' AS field, title AS value FROM recordings UNION SELECT DISTINCT 'song_name', song_name FROM recordings)
  WHERE value IS NOT NULL AND value NOT IN ('', 'NA', 'nan', 'None'))"""

QUERIES = {"p5_found": p5_found, "p5_canonical": p5_canonical}
SQL = {
    "p5_found": "WITH " + _VALUES.format(skeleton=_skeleton_sql("value")) + """
    SELECT a.field, a.value AS value_a, b.value AS value_b FROM v a JOIN v b ON a.field = b.field AND a.sk = b.sk AND a.value < b.value WHERE a.sk <> ''""",
    "p5_canonical": "WITH " + _VALUES.format(skeleton=_skeleton_sql("value")) + f"""
    , c AS (SELECT field, sk, arg_min(value, struct_pack(other := value <> {_plain_sql("value")}, v := value)) AS canonical FROM v WHERE sk <> '' GROUP BY field, sk), m AS (SELECT v.field, v.value, c.canonical FROM v JOIN c ON c.field = v.field AND c.sk = v.sk)
    SELECT r.item_id, t.canonical AS title, s.canonical AS song_name FROM (SELECT DISTINCT item_id, title, song_name FROM recordings) r LEFT JOIN m t ON t.field = 'title' AND t.value = r.title LEFT JOIN m s ON s.field = 'song_name' AND s.value = r.song_name""",
}
