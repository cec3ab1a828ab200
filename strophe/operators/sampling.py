"""Sampling, resampling and folds by hashes: the same rows whatever the partitioning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strophe.functions.columns import hash_order
from strophe.operators.relational import cap_per_group
from strophe.session import cut


def sample(df: DataFrame, n: int, seed: str, *keys: str) -> DataFrame:
    """n rows in hash order (a top-k plan)."""
    return df.orderBy(hash_order(seed, *keys), *keys).limit(n)


def sample_per_group(df: DataFrame, group: Sequence[str], n: int, seed: str, *keys: str) -> DataFrame:
    """At most n rows of each group in hash order."""
    return cap_per_group(df, group, [hash_order(seed, *keys), *[F.col(k) for k in keys]], n)


def top_fraction(df: DataFrame, group: str, score: Column, fraction: float, least: int, *ties: str) -> DataFrame:
    """The best fraction of each group, at least ``least`` rows."""
    w = Window.partitionBy(group)
    n = F.row_number().over(w.orderBy(score.desc(), *ties))
    d = df.withColumns({"__n": n, "__c": F.count("*").over(w)})
    return d.where(F.col("__n") <= F.greatest(F.lit(least), F.bround(fraction * F.col("__c"), 0))).drop("__n", "__c")


def hash_uniform(seed: str, *columns: str | Column) -> Column:
    """A number from 0 to 1 from the first 32 bits of the MD5 of the seed and the columns."""
    return F.conv(F.substring(hash_order(seed, *columns), 1, 8), 16, 10).cast("double") / float(1 << 32)


def poisson_weights(u: Column, most: int = 8) -> Column:
    """A Poisson(1) count from a uniform number, by the inverse of its distribution."""
    import math

    total, edges = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        edges.append(total)
    return sum(((u >= e).cast("int") for e in edges[1:]), (u >= edges[0]).cast("int"))


def group_folds(df: DataFrame, group: str, label: str, k: int, large: int = 2000, bins: int = 4096) -> DataFrame:
    """``(group, fold)``: groups are never split, folds are balanced in size and labels.

    Groups of more than 1/``large`` of all rows (at most ``large`` of them) are placed one by one; all others are hashed into
    ``bins`` bins that are placed as one. Each goes, largest first, to the fold that is then the most even. So the greedy pass
    sees at most large + bins units times labels, whatever the number of groups. Rows without group are left out.
    """
    rows = df.where(F.col(group).isNotNull())
    counts = rows.groupBy(F.col(group).alias("g"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("l")).agg(F.count("*").alias("n"))
    sizes = counts.groupBy("g").agg(F.sum("n").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    unit = F.when(F.col("size") * large > F.col("total"), F.concat(F.lit("g:"), F.col("g").cast("string"))).otherwise(F.concat(F.lit("b:"), F.pmod(F.xxhash64("g"), F.lit(bins)).cast("string")))
    units = sizes.crossJoin(F.broadcast(total)).select("g", unit.alias("unit"))
    per = counts.join(units, "g").groupBy("unit", "l").agg(F.sum("n").alias("n")).withColumn("one", F.lit(0))

    def greedy(x: pd.DataFrame) -> pd.DataFrame:
        wide = x.pivot_table(index="unit", columns="l", values="n", aggfunc="sum", fill_value=0)
        order = sorted(wide.index, key=lambda u: (-int(wide.loc[u].sum()), u))
        total = wide.sum().clip(lower=1).to_numpy(dtype=float)
        loads = np.zeros((k, wide.shape[1]))
        out = []
        for name in order:
            row = wide.loc[name].to_numpy(dtype=float)
            cost = (((loads + row) / total) ** 2 - (loads / total) ** 2).sum(axis=1)
            best = min(range(k), key=lambda f: (round(float(cost[f]), 12), float(loads[f].sum()), f))
            loads[best] += row
            out.append((name, best))
        return pd.DataFrame(out, columns=["unit", "fold"])

    placed = per.groupBy("one").applyInPandas(greedy, "unit string, fold int")
    return units.join(placed, "unit").select(F.col("g").alias(group), "fold")


def greedy_distinct(df: DataFrame, region: str, rank: Sequence[Column], n: int, distinct: Sequence[str], ident: str) -> DataFrame:
    """Per region up to n rows in rank order, of which no two share a value of any ``distinct`` column (nulls never clash).

    Of rows that agree in all ``distinct`` columns only the best can be picked (unless all are null), so the candidates are the
    best row per region and combination. Each of at most n rounds then takes, per region, the best candidate after the last
    pick that clashes with none so far: the picks of the sequential pass, without a region in one task. Equal rows count once.
    """
    fields = [f"d{i}" for i in range(len(distinct))]
    order = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], F.col(ident).alias("i"), *[F.col(c).alias(f) for c, f in zip(distinct, fields)])
    rows = df.select(F.col(region).alias("g"), order.alias("o"))
    free = reduce(and_, [F.col(f"o.{f}").isNull() for f in fields])
    tied = rows.where(~free).groupBy("g", *[F.col(f"o.{f}").alias(f) for f in fields]).agg(F.min("o").alias("o")).select("g", "o")
    candidates = cut(tied.unionAll(rows.where(free)))
    picks = None
    for k in range(1, n + 1):
        live = candidates
        if picks is not None:
            taken = picks.groupBy(F.col("g").alias("h")).agg(F.max("o").alias("last"), F.collect_list("o").alias("taken"))
            clash = F.exists("taken", lambda p: reduce(or_, [F.coalesce(p[f] == F.col(f"o.{f}"), F.lit(False)) for f in fields]))
            live = candidates.join(F.broadcast(taken), F.col("g").eqNullSafe(F.col("h"))).where((F.col("o") > F.col("last")) & ~clash)
        best = cut(live.groupBy("g").agg(F.min("o").alias("o")).withColumn("pick", F.lit(k)))
        picks = best if picks is None else picks.unionAll(best)
        if best.isEmpty():
            break
    return picks.select(F.col("g").alias(region), F.col("o.i").alias(ident), "pick")
