"""Statistics in SQL: ranks, rank tests, contingency, false discovery rate, classification scores."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strophe.operators.ordered import running_totals


def average_rank(value: Column, *partition: str) -> Column:
    """Ranks from 1, equal values sharing the mean of their ranks."""
    w = Window.partitionBy(*partition) if partition else Window.partitionBy()
    same = Window.partitionBy(*partition, value) if partition else Window.partitionBy(value)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(same) - 1) / 2.0


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """``(value, n, rank)`` of distinct values over all rows: equal values are combined before they are ordered."""
    c = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    r = running_totals(c, [value], ["n"])
    return r.select(value, "n", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("rank"))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row ``(n, k, h, epsilon2)``: H with the correction for ties, and its effect size."""
    x = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    r = value_ranks(x, "v")
    ties = r.agg(F.sum(F.pow(F.col("n").cast("double"), F.lit(3)) - F.col("n")).alias("t"))
    g = x.join(r.select("v", "rank"), "v").groupBy("g").agg(F.sum("rank").alias("s"), F.count("*").alias("c"))
    s = g.agg(F.sum("c").cast("double").alias("n"), F.count("*").alias("k"), F.sum(F.pow("s", F.lit(2)) / F.col("c")).alias("q")).crossJoin(F.broadcast(ties))
    h = (12 / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)) / F.nullif(1 - F.col("t") / (F.pow("n", F.lit(3)) - F.col("n")), F.lit(0.0))
    out = s.withColumn("h", h)
    e = F.greatest(F.lit(0.0), (F.col("h") - F.col("k") + 1) / F.nullif(F.col("n") - F.col("k"), F.lit(0.0)))
    return out.select(F.col("n").cast("long").alias("n"), "k", "h", e.alias("epsilon2"))


def contingency(df: DataFrame, a: str, b: str, least: int = 0) -> DataFrame:
    """One row ``(n, chi2, dof, cramers_v)`` of two columns; values of b with fewer than ``least`` rows are left out."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    cb = c.groupBy("b").agg(F.sum("n").alias("nb")).where(F.col("nb") >= least)
    c = c.join(cb, "b")
    ca = c.groupBy("a").agg(F.sum("n").alias("na"))
    t = c.agg(F.sum("n").cast("double").alias("t"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
    # sum over cells (o - e)^2 / e = t * (sum o^2 / (na nb) - 1), so empty cells need not be formed
    s = c.join(ca, "a").agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"))
    x = t.crossJoin(F.broadcast(s)).withColumn("chi2", F.col("t") * (F.col("s") - 1))
    v = F.sqrt(F.col("chi2") / F.nullif(F.col("t") * (F.least("r", "c") - 1), F.lit(0.0)))
    return x.select(F.col("t").cast("long").alias("n"), "chi2", ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"), v.alias("cramers_v"))


def benjamini_hochberg(df: DataFrame, p: str) -> DataFrame:
    """Adds ``q``: the least p * n / rank over this and all larger p. For the p values of a family of tests, which are few."""
    n = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(p))
    d = df.withColumns({"__r": rank, "__n": n}).withColumn("__x", F.col(p) * F.col("__n") / F.col("__r"))
    q = F.min("__x").over(Window.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("q", F.least(q, F.lit(1.0))).drop("__r", "__n", "__x")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``(n, rho)``; rows without one of the values do not count."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    ra, rb = value_ranks(x, "a").select("a", F.col("rank").alias("ra")), value_ranks(x, "b").select("b", F.col("rank").alias("rb"))
    return x.join(ra, "a").join(rb, "b").agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))


def kolmogorov_smirnov(df: DataFrame, side: Column, value: str) -> DataFrame:
    """One row ``(n_a, n_b, d)``: the greatest distance of the two distributions; side is true for the first sample."""
    c = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    r = running_totals(c, [value], ["a", "b"])
    t = c.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    x = r.select(F.col("cum_a").alias("ca"), F.col("cum_b").alias("cb")).crossJoin(F.broadcast(t))
    return x.groupBy("n_a", "n_b").agg(F.max(F.abs(F.col("ca") / F.col("n_a") - F.col("cb") / F.col("n_b"))).alias("d"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``(y, p, n)`` of rows that have both."""
    return df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(F.col(truth).cast("string").alias("y"), F.col(guess).cast("string").alias("p")).agg(F.count("*").alias("n"))


def class_scores(c: DataFrame) -> DataFrame:
    """``(cls, tp, fp, fn, precision, recall, f1)`` of every class of a confusion (y, p, n), with nothing divided by zero."""
    side = F.array(F.struct(F.col("y").alias("cls"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("y") != F.col("p"), F.col("n")).otherwise(0).alias("fn")), F.struct(F.col("p").alias("cls"), F.lit(0).alias("tp"), F.when(F.col("y") != F.col("p"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).alias("fn")))
    g = c.select(F.explode(side).alias("s")).select("s.*").groupBy("cls").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    tp = F.col("tp")
    return g.select("cls", "tp", "fp", "fn", (tp / F.greatest(tp + F.col("fp"), F.lit(1))).alias("precision"), (tp / F.greatest(tp + F.col("fn"), F.lit(1))).alias("recall"), (2 * tp / F.greatest(2 * tp + F.col("fp") + F.col("fn"), F.lit(1))).alias("f1"))


def summary_scores(c: DataFrame) -> DataFrame:
    """One row ``(n, accuracy, balanced_accuracy, macro_f1, kappa)`` of a confusion."""
    s = class_scores(c).agg(F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.col("recall"))).alias("balanced_accuracy"), F.sum(((F.col("tp") + F.col("fn")) * (F.col("tp") + F.col("fp"))).cast("double")).alias("chance"), F.sum("tp").alias("same"))
    t = c.agg(F.sum("n").alias("n"))
    x = s.crossJoin(F.broadcast(t))
    acc, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return x.select("n", acc.alias("accuracy"), "balanced_accuracy", "macro_f1", ((acc - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def partition_agreement(c: DataFrame) -> DataFrame:
    """One row ``(nmi, ari, fowlkes_mallows)`` of two partitions given as a contingency (y, p, n)."""
    pairs = lambda x: (x * (x - 1) / 2.0)
    n = F.col("n").cast("double")
    my, mp = c.groupBy("y").agg(F.sum("n").alias("m")), c.groupBy("p").agg(F.sum("n").alias("m"))
    m = F.col("m").cast("double")
    j = c.agg(F.sum(n).alias("t"), F.sum(pairs(n)).alias("ij"), F.sum(n * F.ln(n)).alias("hj"))
    a = my.agg(F.sum(pairs(m)).alias("ia"), F.sum(m * F.ln(m)).alias("ha"))
    b = mp.agg(F.sum(pairs(m)).alias("ib"), F.sum(m * F.ln(m)).alias("hb"))
    x = j.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b))
    t = F.col("t")
    hy, hp, hj = F.ln(t) - F.col("ha") / t, F.ln(t) - F.col("hb") / t, F.ln(t) - F.col("hj") / t
    expected = F.col("ia") * F.col("ib") / pairs(t)
    return x.select(
        (2 * (hy + hp - hj) / F.nullif(hy + hp, F.lit(0.0))).alias("nmi"),
        ((F.col("ij") - expected) / F.nullif((F.col("ia") + F.col("ib")) / 2 - expected, F.lit(0.0))).alias("ari"),
        (F.col("ij") / F.nullif(F.sqrt(F.col("ia") * F.col("ib")), F.lit(0.0))).alias("fowlkes_mallows"),
    )


def chi_square_tail(x: float, dof: int) -> float:
    """P(X >= x) of the chi-square distribution: the regularised upper incomplete gamma function."""
    if x <= 0 or dof <= 0:
        return 1.0
    a, x = dof / 2.0, x / 2.0
    log = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * math.exp(log))
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(log) * h


def with_p_value(df: DataFrame, statistic: str, dof: Column | str) -> DataFrame:
    """Adds ``p`` to a few rows of test statistics."""
    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else chi_square_tail(float(a), int(b)) for a, b in zip(x, k)])

    return df.withColumn("p", tail(F.col(statistic), F.col(dof) if isinstance(dof, str) else dof))


def profile_distance(df: DataFrame, unit: str, vector: str) -> DataFrame:
    """``(unit_a, unit_b, d2)``: squared distance of the mean vectors of two units, less what their sampling adds (the variance of a
    mean over its number of rows, summed over dimensions). Units are few; rows are aggregated first."""
    long = df.where(F.col(unit).isNotNull()).select(F.col(unit).alias("u"), F.posexplode(vector).alias("i", "x"))
    m = long.groupBy("u", "i").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.count("*").alias("n"))
    b = m.select(F.col("u").alias("w"), "i", F.col("m").alias("m2"), F.col("v").alias("v2"), F.col("n").alias("n2"))
    d = m.join(b, "i").where("u < w")
    g = F.sum(F.pow(F.col("m") - F.col("m2"), F.lit(2)) - F.col("v") / F.col("n") - F.col("v2") / F.col("n2"))
    return d.groupBy(F.col("u").alias("unit_a"), F.col("w").alias("unit_b")).agg(g.alias("d2"))
