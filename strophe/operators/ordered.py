"""Global order without a single task: running totals and numbering over range partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strophe.session import cut


def running_totals(df: DataFrame, order: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """Adds ``cum_<c>``: the sum of c up to and with each row in the order, which must be total.

    Rows are range-partitioned by the order and fixed in the shared folder with the number of their partition; the totals of
    earlier partitions (one row each) are added to the running totals within a partition.
    """
    p = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sums = p.groupBy("__p").agg(*[F.sum(c).alias(f"__s_{c}") for c in columns])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__p", *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in columns])
    w = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = p.join(F.broadcast(offsets), "__p")
    return got.select(*df.columns, *[(F.sum(c).over(w) + F.col(f"__o_{c}")).alias(f"cum_{c}") for c in columns])


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Adds consecutive numbers from 1 in the order, which must be total."""
    n = running_totals(df.withColumn("__one", F.lit(1).cast("long")), order, ["__one"])
    return n.withColumnRenamed("cum___one", name).drop("__one")
