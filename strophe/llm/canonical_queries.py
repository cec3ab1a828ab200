"""Queries of problem 1: free-entered places to the gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strophe.functions.text import is_missing
from strophe.llm.canonical import choose_entries, score_entries
from strophe.llm.readings import Readings
from strophe.session import cut

UNMATCHED = "unmatched"


def gazetteer_entries(g: DataFrame) -> DataFrame:
    """Entries of both fields: provinces for province, prefectures and counties for county_or_area."""
    stem = lambda c: F.expr(f"substring({c}, 1, length({c}) - 1)")
    field = F.when(F.col("level") == "province", "province").otherwise("county_or_area")
    provinces = g.where("level = 'province'").select(F.col("name").alias("province"), F.col("adcode").alias("within"))
    e = g.join(provinces, "province", "left")
    parents = F.when(F.col("level") == "province", F.array().cast("array<string>"))
    parents = parents.when(F.col("level") == "prefecture", F.array(stem("province"))).otherwise(F.array(stem("province"), stem("prefecture")))
    return e.select(field.alias("field"), F.col("adcode").alias("entry"), stem("name").alias("name"), F.expr("right(name, 1)").alias("kind"), "level", parents.alias("parents"), F.when(F.col("level") != "province", F.col("within")).alias("within"))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    """``(item_id, field, value, exact, adcode)`` of every present value of both fields."""
    rec = spark.read.parquet(f"{d}/recordings.parquet").select("item_id", "province", "county_or_area").distinct()
    g = spark.read.parquet(f"{d}/gazetteer.parquet")
    r = Readings.load(spark.read.parquet(f"{d}/char_forms.parquet"))
    entries = cut(gazetteer_entries(g))
    names = g.select(F.when(F.col("level") == "province", "province").otherwise("county_or_area").alias("field"), F.col("name").alias("value")).distinct().withColumn("exact", F.lit(True))

    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("province", "county_or_area")])
    values = rec.select(F.explode(cells).alias("c")).select("c.*").where(~is_missing("value")).distinct()
    scored = cut(score_entries(values, entries, r))  # both fields at once: a score does not depend on what is stated
    provinces = values.where("field = 'province'").withColumn("stated", F.lit(None).cast("string"))
    provinces = cut(choose_entries(provinces, scored)).select(F.col("value").alias("province"), F.col("entry").alias("province_code"))
    both = cut(rec.join(provinces, "province", "left"))
    places = both.where(~is_missing("county_or_area")).select("item_id", F.col("county_or_area").alias("value"), F.col("province_code").alias("stated"))
    counties = places.select(F.lit("county_or_area").alias("field"), "value", "stated").distinct()
    counties = choose_entries(counties, scored).select("value", F.col("stated").alias("s"), "entry")
    counties = places.join(counties.withColumnRenamed("value", "v"), (F.col("value") == F.col("v")) & F.col("stated").eqNullSafe(F.col("s")))
    first = both.where(~is_missing("province")).select("item_id", F.lit("province").alias("field"), F.col("province").alias("value"), F.col("province_code").alias("adcode"))
    second = counties.select("item_id", F.lit("county_or_area").alias("field"), "value", F.col("entry").alias("adcode"))
    out = first.unionAll(second).join(names, ["field", "value"], "left")
    return out.select("item_id", "field", "value", F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("adcode", F.lit(UNMATCHED)).alias("adcode"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every present value that is not exactly a gazetteer name, with the entry meant or ``unmatched``."""
    return _mapped(spark, d).where("not exact").select("item_id", "field", "adcode").distinct()


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The report of unmatched values: how many recordings hold each."""
    m = _mapped(spark, d).where(F.col("adcode") == UNMATCHED)
    return m.groupBy("field", "value").agg(F.count_distinct("item_id").alias("recordings"))


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched}
SQL: dict[str, str] = {}
