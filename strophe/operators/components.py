"""Connected components by alternating large-star and small-star.

Every round is two map-side combined minima per node and two joins; the edge set
only shrinks towards stars, so a hub costs no more than its own edges. A round is
written to the shared checkpoint folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strophe.session import cut, release


def _large_star(e: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it knows (itself included)."""
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them. Edges run from larger to smaller."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of an edge; root is the smallest node of its component.

    Null ends and loops tie nothing (a node that occurs in loops only is left out). Repeated edges do not matter.
    The result does not depend on the order of rows. More than ``rounds`` rounds is an error, never a cut-off result.
    """
    e = edges.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`")
    e = cut(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        last, e = e, cut(_small_star(_large_star(e)))
        release(last)
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
