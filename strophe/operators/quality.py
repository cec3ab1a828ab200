"""Data quality: coverage, profiles, and rule lists that give review rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from strophe.functions.columns import percent
from strophe.functions.text import is_missing


def filled(df: DataFrame, c: str) -> Column:
    """True where a cell holds something: text by the spellings of missing, numbers by null and NaN."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.StringType):
        return ~is_missing(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(~F.isnan(c), F.lit(False))
    return F.col(c).isNotNull()


def coverage_wide(df: DataFrame, group: str, fields: Sequence[str]) -> DataFrame:
    """Per group: total, and for each field the filled cells and their percentage. One aggregation."""
    n = [F.count_if(filled(df, c)) for c in fields]
    cols = [x for c, k in zip(fields, n) for x in (k.alias(f"n_{c}"), percent(k, F.count("*")).alias(f"pct_{c}"))]
    return df.groupBy(group).agg(F.count("*").alias("total"), *cols)


def coverage_long(df: DataFrame, group: str, fields: Sequence[str]) -> DataFrame:
    """``(group, field, total, filled)``: aggregated first, then turned to long form, so the data is not multiplied by the fields."""
    wide = df.groupBy(group).agg(F.count("*").alias("total"), *[F.count_if(filled(df, c)).alias(c) for c in fields])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in fields])
    return wide.select(group, F.explode(pairs).alias("p"), "total").select(group, "p.field", "total", "p.filled")


def review(df: DataFrame, ident: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """``(ident, reason)``: one row for every rule that a row breaks, from one scan. Null conditions are not broken."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))
    return df.select(ident, F.explode(broken).alias("reason"))


def vocabulary_rules(columns: dict[str, Sequence[str]]) -> list[tuple[str, Column]]:
    """Rules that a present value must be one of a closed list."""
    return [(f"{c} not in vocabulary", ~is_missing(c) & ~F.col(c).isin(list(values))) for c, values in columns.items()]


def functional_dependency(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """``(determinant, n)``: values of the determinant that go with more than one dependent value."""
    g = df.where(F.col(determinant).isNotNull()).groupBy(determinant).agg(F.count_distinct(dependent).alias("n"))
    return g.where("n > 1")


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, type, rows, filled, distinct, least, most)`` of each column as text, from one aggregation."""
    columns = list(columns or df.columns)
    stats = []
    for c in columns:
        ok = filled(df, c)
        v = F.when(ok, F.col(c))
        stats.append(F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), F.count("*").alias("rows"), F.count_if(ok).alias("filled"), F.count_distinct(v).alias("distinct"), F.min(v).cast("string").alias("least"), F.max(v).cast("string").alias("most")))
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``(key, where)``: keys of one side only (``missing`` in b, ``extra`` in b)."""
    left = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("where", F.lit("missing"))
    right = b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").withColumn("where", F.lit("extra"))
    return left.unionAll(right)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(n, agree, kappa)`` of two labelings of the same rows; rows without one of the labels do not count."""
    x = df.where(f"`{a}` is not null and `{b}` is not null").groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    t = x.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    ma, mb = x.groupBy("a").agg(F.sum("n").alias("na")), x.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = ma.join(mb, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("c"))
    po, pe = F.col("same") / F.col("n"), F.col("c") / (F.col("n") * F.col("n"))
    return t.crossJoin(F.broadcast(chance)).select("n", po.alias("agree"), ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))
