"""Equi-joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_split(a: DataFrame, b: DataFrame, on: list[str], hot: int = 20_000) -> DataFrame:
    """Inner join on ``on`` in which no task gets all rows of a hot key.

    A key with more than ``hot`` rows in ``a`` is dealt over parts of about so many rows, by the hash of the whole row, and the
    rows of ``b`` with that key are copied to each part. All other keys have one part, so nothing of theirs is copied. Rows with a
    null key join nothing. Other columns of equal name are not allowed, as in any join by names. The result does not depend on ``hot``.
    """
    parts = a.groupBy(*on).agg(F.ceil(F.count("*") / hot).cast("int").alias("__parts")).where("__parts > 1")
    n = F.coalesce("__parts", F.lit(1))
    x = a.withColumn("__row", F.xxhash64(*a.columns)).join(parts, on, "left").withColumn("__part", F.pmod("__row", n).cast("int"))
    y = b.join(parts, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), n - 1)))
    return x.drop("__parts", "__row").join(y.drop("__parts"), [*on, "__part"]).drop("__part")
