"""Splits that keep related records together.

Records that share any key are one group: components of the keys by alternating large-star and small-star, on
the distinct pairs of keys that occur in one record, so a key that holds a third of all records is one node. Split
ranges are cut on the hash of the group, per stratum, at the wanted shares of records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strophe.operators.components import connected
from strophe.session import cut


def record_groups(df: DataFrame, record: str, keys: dict[str, Column]) -> DataFrame:
    """``(record, group_id, size)`` of every record; group_id is the smallest record of its group.

    keys: name to a column that is null where it ties nothing. Equal values tie only under the same name.
    A record without any key is a group of its own. Records without id are left out; repeated rows count once.
    """
    nodes = [F.when(c.isNotNull(), F.concat(F.lit(name + "\x1f"), c.cast("string"))) for name, c in keys.items()]
    rows = df.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), F.array_compact(F.array(*nodes)).alias("nodes")).distinct()
    tied = rows.where("size(nodes) > 0").select("record", F.explode("nodes").alias("node")).distinct()
    # per record its nodes in a chain; made distinct at once, so hot keys do not multiply
    pairs = rows.where("size(nodes) > 1").select("nodes").distinct().select(F.explode(F.expr("transform(sequence(1, size(nodes) - 1), i -> struct(nodes[i - 1] as a, nodes[i] as b))")).alias("p"))
    by_record = df.where(F.col(record).isNotNull()).select(F.col(record).alias("record")).distinct()
    comp = connected(pairs.select("p.a", "p.b").distinct(), "a", "b")
    # several rows of one record may hold different keys: its smallest root then stands for all, through one more round
    rooted = tied.join(comp, "node", "left").select("record", F.coalesce("root", "node").alias("root")).distinct()
    rooted = cut(rooted)
    several = rooted.groupBy("record").agg(F.min("root").alias("a"), F.collect_set("root").alias("all")).where("size(all) > 1")
    more = connected(several.select("a", F.explode("all").alias("b")), "a", "b")
    rooted = rooted.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("record", F.coalesce("top", "root").alias("root")).distinct()
    groups = rooted.groupBy("root").agg(F.min("record").alias("group_id"), F.count("*").alias("size"))
    got = rooted.join(groups, "root").select("record", "group_id", "size")
    out = by_record.join(got, "record", "left").select("record", F.coalesce("group_id", "record").alias("group_id"), F.coalesce("size", F.lit(1)).alias("size"))
    return out.withColumnRenamed("record", record)


def assign_splits(records: DataFrame, group: str, stratum: str, shares: dict[str, float], bins: int = 4096) -> DataFrame:
    """``(group, split)``: whole groups to splits, so that records come near the shares overall and in each stratum.

    A group counts in the stratum that most of its records have (of equal ones the one a hash picks), and gets a bin by the
    hash of its id. Every bin has its place in the ranges of its stratum: bins are put in the order of an exponential draw, made
    from the bin, times their records, so bins of like size come in hash order and a bin that one large group fills comes late. The
    ranges of the small splits lie first, that of the first, largest split last; a bin belongs to the range that holds its middle.
    So a group too large for a small split nearly always lies in the large one, by its place and not by a bound on its size. Only bins
    are ordered: at most ``bins`` rows a stratum, whatever the number of records. A null stratum is a stratum.
    """
    names = list(shares)
    per = records.groupBy(group, stratum).agg(F.count("*").alias("n"))
    main = per.groupBy(group).agg(F.sum("n").alias("n"), F.max_by(stratum, F.struct("n", F.md5(F.coalesce(stratum, F.lit(""))))).alias("stratum"))
    main = main.withColumn("bin", F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 8), 16, 10).cast("long") % bins)
    b = main.groupBy("stratum", "bin").agg(F.sum("n").alias("n"))
    place = F.col("n") * -F.ln((F.col("bin") + 0.5) / bins)
    w = Window.partitionBy("stratum")
    at = F.sum("n").over(w.orderBy(place, "bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") / 2
    b = b.withColumn("share", at / F.sum("n").over(w))
    ends = [(names[i], sum(shares[x] for x in names[1 : i + 1])) for i in range(1, len(names))]
    choose = reduce(lambda acc, e: F.when(F.col("share") < e[1], e[0]).otherwise(acc), reversed(ends), F.lit(names[0]))
    b = b.select(F.col("stratum").alias("s"), F.col("bin").alias("b"), choose.alias("split"))
    return main.join(b, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).select(group, "split")
