"""Queries of problem 3: same or near-same records across splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strophe.llm.linking import parse_values
from strophe.llm.names_queries import KINDS
from strophe.llm.overlap import meets, name_classes
from strophe.llm.readings import Readings
from strophe.operators.skew import join_split
from strophe.session import cut

KEY = {"song_key": KINDS["song_name"]}  # a key is a song's name


def _keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rec = spark.read.parquet(f"{d}/recordings.parquet").select("item_id", "platform", "fold", "song_key")
    rec = rec.where("fold is not null and item_id is not null and song_key is not null and not contains(song_key, '#')")
    readings = Readings.load(spark.read.parquet(f"{d}/char_forms.parquet"))
    keys = rec.groupBy(F.col("song_key").alias("value")).agg(F.max(F.col("fold") <= 2).alias("train"), F.max(F.col("fold") >= 3).alias("eval"))
    keys = cut(keys)
    parsed = parse_values(keys.select(F.lit("song_key").alias("field"), "value"), KEY, readings)
    parsed = parsed.withColumn("id", F.concat_ws("\x1f", "label", "letters"))
    return rec, cut(keys.join(parsed, "value").withColumnRenamed("value", "key"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each recording of folds 3 and 4 with every raw training key of the same song."""
    rec, keys = _keys(spark, d)
    m = meets(cut(name_classes(keys, KEY["song_key"][1])))
    e = rec.where("fold >= 3").select("item_id", F.col("song_key").alias("key")).distinct()
    return join_split(e, m, ["key"]).select("item_id", "train_key").distinct()


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Membership: each song key that an evaluation key meets, with its class and on which sides it stands."""
    return name_classes(_keys(spark, d)[1], KEY["song_key"][1])


def p3_overlap_report(spark: SparkSession, d: str) -> DataFrame:
    """Per fold and platform: evaluation recordings that name a song, those that meet a training key, and their share.
    From the membership: a class that holds a training key is met; no pairs are made."""
    rec, keys = _keys(spark, d)
    c = cut(name_classes(keys, KEY["song_key"][1]))
    met = c.groupBy("name").agg(F.max("train").alias("met")).where("met").select("name")
    m = c.where("eval").join(met, "name").select("key", F.lit(1).alias("met"))
    e = rec.where("fold >= 3").select("item_id", "platform", "fold", F.col("song_key").alias("key")).distinct()
    g = e.join(m, "key", "left").groupBy("fold", "platform").agg(F.count("*").alias("recordings"), F.count("met").alias("overlapping"))
    return g.withColumn("share", F.col("overlapping") / F.col("recordings"))


QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes, "p3_overlap_report": p3_overlap_report}
SQL: dict[str, str] = {}
