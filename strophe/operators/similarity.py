"""Similarity joins on weighted terms and on texts, without nested loops."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strophe.operators.kernels import indel_ratio
from strophe.operators.relational import ngram_blocks
from strophe.operators.skew import join_split


def unit_vectors(terms: DataFrame, ident: str, term: str, smooth: bool = True, sublinear: bool = True) -> DataFrame:
    """``(ident, term, df, w)`` of unit length from (ident, term) rows: tf is 1 + ln(count), idf is ln((1 + n) / (1 + df)) + 1."""
    tf = terms.where(F.col(ident).isNotNull() & F.col(term).isNotNull()).groupBy(ident, term).agg(F.count("*").alias("tf"))
    df = tf.groupBy(term).agg(F.count("*").alias("df"))
    n = tf.select(ident).distinct().agg(F.count("*").alias("n"))
    weight = (1 + F.ln("tf") if sublinear else F.col("tf")) * (F.ln((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1 if smooth else F.ln(F.col("n") / F.col("df")))
    w = tf.join(df, term).crossJoin(F.broadcast(n)).withColumn("w", weight)
    norm = w.groupBy(ident).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, ident).select(ident, term, "df", (F.col("w") / F.col("norm")).alias("w"))


def cosine_pairs(vectors: DataFrame, ident: str, term: str, least: float) -> DataFrame:
    """``(a, b, cosine)``, a < b, of all pairs of at least ``least``. vectors: (ident, term, df, w) of unit length.

    Candidates share a term of both prefixes: of each vector, rarest first, only terms before which the rest still has a norm of
    ``least`` or more. A pair that reaches the threshold always does, so nothing is lost, and frequent terms hardly ever join.
    """
    v = vectors.groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("df", F.col(term).alias("term"), "w"))).alias("v"))
    kept = F.expr(f"aggregate(v, named_struct('m', cast(0.0 as double), 'g', cast(array() as array<string>)), (acc, x) -> named_struct('m', acc.m + x.w * x.w, 'g', if(1 - acc.m >= {least * least - 1e-9}, array_append(acc.g, x.term), acc.g)), acc -> acc.g)")
    p = v.select(F.col(ident).alias("id"), F.explode(kept).alias("term"))
    c = join_split(p.select(F.col("id").alias("a"), "term"), p.select(F.col("id").alias("b"), "term"), ["term"]).where("a < b").select("a", "b").distinct()
    side = lambda s: v.select(F.col(ident).alias(s), F.transform("v", lambda x: x["term"]).alias(f"t_{s}"), F.transform("v", lambda x: x["w"]).alias(f"w_{s}"))
    x = c.join(side("a"), "a").join(side("b"), "b")
    dot = F.aggregate(F.array_intersect("t_a", "t_b"), F.lit(0.0), lambda acc, t: acc + F.element_at("w_a", F.array_position("t_a", t).cast("int")) * F.element_at("w_b", F.array_position("t_b", t).cast("int")))
    return x.select("a", "b", dot.alias("cosine")).where(F.col("cosine") >= least)


def fuzzy_pairs(a: DataFrame, b: DataFrame, text_a: str, text_b: str, ratio: float = 80.0, least: int = 3) -> DataFrame:
    """``(text_a, text_b, ratio)`` of distinct texts whose indel ratio is at least ``ratio``, both of at least ``least`` characters.

    Blocked by pairs of neighbouring characters and bounded in length: texts of ratio r share r / 200 of their total length, so
    their lengths differ by at most a factor. If no two of m matched characters are neighbours in both texts, there are m - 1 gaps
    between them in one or the other, so the texts have 3 m - 1 characters and a ratio of at most 200 m / (3 m - 1), which for
    texts of three characters or more is at most 75. Above that some two neighbours stay together; lower ratios are refused.
    """
    if ratio <= 75 or least < 3:
        raise ValueError("texts of a ratio of 75 or less, or of two characters, need not share two neighbouring ones")
    x = a.select(F.col(text_a).alias("x")).where(F.length("x") >= least).distinct().withColumn("g", F.explode(ngram_blocks(F.col("x"), 2)))
    y = b.select(F.col(text_b).alias("y")).where(F.length("y") >= least).distinct().withColumn("g", F.explode(ngram_blocks(F.col("y"), 2)))
    c = join_split(x, y, ["g"]).where(200.0 * F.least(F.length("x"), F.length("y")) >= ratio * (F.length("x") + F.length("y"))).select("x", "y").distinct()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            r = [indel_ratio(s, t) for s, t in zip(p["x"], p["y"])]
            out = p.assign(ratio=r)
            yield out[out["ratio"] >= ratio]

    return c.mapInPandas(judge, "x string, y string, ratio double").select(F.col("x").alias(text_a), F.col("y").alias(text_b), "ratio")
