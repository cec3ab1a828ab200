"""Features, trees and composed models (survey N-02, N-16, N-17, N-24, N-25, F-S18, F-S25, A-40, O-09, G-06 to G-09, R-12, R-13, M-07 to M-14)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from strophe.operators import kernels as K, ml as M, sequences as S, stats as X
from strophe.plans.registry import Registry, fitted_on, table
from strophe.plans.sequences import NOTES_SQL, W, notes

Q = Registry()


@Q(f"""WITH {NOTES_SQL}, x AS (SELECT item, dur, pitch % 12 AS pc, least(greatest(pitch - lag(pitch) OVER w, -13), 13) AS iv, lead(pitch) OVER w % 12 AS nx FROM n WINDOW w AS (PARTITION BY item ORDER BY pos)),
    f AS (SELECT item, 'pc' || pc AS feature, sum(dur) AS v FROM x GROUP BY ALL UNION ALL SELECT item, 'iv' || iv, count(*) FROM x WHERE iv IS NOT NULL GROUP BY ALL UNION ALL SELECT item, 'tr' || pc || '_' || nx, count(*) FROM x WHERE nx IS NOT NULL GROUP BY ALL)
    SELECT item, feature, round(v / sum(v) OVER (PARTITION BY item, left(feature, 2)), 6) AS share FROM f""")
def theory_features(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a feature vector in long form: pitch classes by duration, intervals, transitions, each a distribution (N-02, D10)."""
    x = notes(spark, d).select("item", "dur", (F.col("pitch") % 12).alias("pc"), F.least(F.greatest(F.col("pitch") - F.lag("pitch").over(W()), F.lit(-13)), F.lit(13)).alias("iv"), (F.lead("pitch").over(W()) % 12).alias("nx"))
    one = F.lit(1.0)
    parts = F.array(
        F.struct(F.concat(F.lit("pc"), F.col("pc").cast("string")).alias("feature"), F.col("dur").alias("v")),
        F.when(F.col("iv").isNotNull(), F.struct(F.concat(F.lit("iv"), F.col("iv").cast("string")).alias("feature"), one.alias("v"))),
        F.when(F.col("nx").isNotNull(), F.struct(F.concat(F.lit("tr"), F.col("pc").cast("string"), F.lit("_"), F.col("nx").cast("string")).alias("feature"), one.alias("v"))),
    )
    f = x.select("item", F.explode(F.array_compact(parts)).alias("p")).groupBy("item", "p.feature").agg(F.sum("p.v").alias("v"))
    return f.select("item", "feature", F.round(F.col("v") / F.sum("v").over(Window.partitionBy("item", F.substring("feature", 1, 2))), 6).alias("share"))


@Q(f"""WITH {NOTES_SQL}, v AS (SELECT item, pos, CASE WHEN event_type = 'error' THEN 'delete' WHEN value > 400 THEN 'repitch' ELSE 'keep' END AS action, pitch FROM n)
    SELECT item, pos, CASE WHEN action = 'repitch' THEN pitch - 12 ELSE pitch END AS pitch, action FROM v WHERE action <> 'delete' UNION ALL SELECT item, max(pos) + 1, min(pitch), 'fill' FROM v GROUP BY item HAVING count(*) FILTER (WHERE action = 'delete') > 0""")
def corrected_notes(spark: SparkSession, d: str) -> DataFrame:
    """Corrections applied: notes dropped, moved and filled in (N-17)."""
    act = F.when(F.col("event_type") == "error", "delete").when(F.col("value") > 400, "repitch").otherwise("keep")
    v = notes(spark, d).select("item", "pos", "pitch", act.alias("action"))
    kept = v.where("action <> 'delete'").select("item", "pos", F.when(F.col("action") == "repitch", F.col("pitch") - 12).otherwise(F.col("pitch")).alias("pitch"), "action")
    fill = v.groupBy("item").agg((F.max("pos") + 1).alias("pos"), F.min("pitch").alias("pitch"), F.count_if(F.col("action") == "delete").alias("k")).where("k > 0")
    return kept.unionAll(fill.select("item", "pos", "pitch", F.lit("fill").alias("action")))


def missed_segments(spark: SparkSession, d: str) -> DataFrame:
    """Uncovered runs of enough length, split where their level changes (N-16); the split is sequential within a run.

    Most runs are short, so they are not groups of their own: the window over an item leaves all its rows in one partition, which is read in
    the order of items and places; only the run that a batch ends in is carried over to the next.
    """
    x = notes(spark, d).where("event_type <> 'error'")
    r = S.islands(x, "item", "onset", 43200.0)

    def ranges(item: int | None, pos: list[int], v: list[float]) -> list[tuple]:
        return [(item, pos[a], e - a, None if (m := K.middle(v[a:e])) != m else m) for a, e in K.split_steps(v)]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = {"item": pa.int64(), "first": pa.int32(), "size": pa.int32(), "level": pa.float64()}
        return pa.record_batch([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, where, run = (None, None), [], []  # the run that is open, its places and values
        for b in batches:
            found = []
            keys = list(zip(b["item"].to_pylist(), b["island"].to_pylist()))
            pos, v = b["pos"].to_pylist(), (b["value"].fill_null(float("nan")).to_numpy() / 100).tolist()
            for i, j in pairwise([0, *(k for k in range(1, len(v)) if keys[k] != keys[k - 1]), len(v)] if v else []):
                if keys[i] != at:
                    found += ranges(at[0], where, run)
                    at, where, run = keys[i], [], []
                where += pos[i:j]
                run += v[i:j]
            yield batch(found)
        yield batch(ranges(at[0], where, run))

    r = r.select("item", "island", "pos", "value").sortWithinPartitions("item", "pos")
    return r.mapInArrow(split, "item long, first int, size int, level double")


@Q(f"WITH {NOTES_SQL} SELECT a.item, CAST(b.pos - a.pos AS INTEGER) AS lag, count(*) AS equal FROM n a JOIN n b ON a.item = b.item AND a.pitch = b.pitch AND b.pos > a.pos AND b.pos - a.pos <= 8 GROUP BY ALL")
def self_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How often a value returns after each lag of up to eight (N-24), by lagged columns instead of a self-join."""
    lags = F.array(*[F.when(F.lead("pitch", k).over(W()) == F.col("pitch"), F.lit(k)) for k in range(1, 9)])
    x = notes(spark, d).select("item", lags.alias("l")).select("item", F.explode(F.array_compact("l")).alias("lag"))
    return x.groupBy("item", "lag").agg(F.count("*").alias("equal"))


@Q(f"""WITH {NOTES_SQL}, t AS (SELECT item, arg_max(pitch % 12, pos) AS tonic FROM n GROUP BY item)
    SELECT n.item, string_agg(['1','b2','2','b3','3','4','#4','5','b6','6','b7','7'][CAST((pitch - tonic + 12) % 12 AS INTEGER) + 1] || CASE WHEN dur > 3000 THEN '-' ELSE '' END, ' ' ORDER BY pos) AS degrees FROM n JOIN t ON t.item = n.item GROUP BY n.item""")
def degree_text(spark: SparkSession, d: str) -> DataFrame:
    """Sequences written as scale degrees over their last note (N-25, F-S25)."""
    n = notes(spark, d)
    t = n.groupBy("item").agg(F.max_by(F.col("pitch") % 12, "pos").alias("tonic"))
    names = F.array(*[F.lit(x) for x in ("1", "b2", "2", "b3", "3", "4", "#4", "5", "b6", "6", "b7", "7")])
    x = n.join(t, "item").withColumn("s", F.concat(F.element_at(names, (F.pmod(F.col("pitch") - F.col("tonic"), F.lit(12)) + 1).cast("int")), F.when(F.col("dur") > 3000, "-").otherwise("")))
    return x.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("a")).select("item", F.array_join(F.transform("a", lambda e: e["s"]), " ").alias("degrees"))


@Q("""WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings), k AS (SELECT vec_id, i, CASE WHEN (vec_id + i) % 3 <> 0 THEN v END AS v FROM s)
    SELECT vec_id, CAST(arg_max(i, v) AS INTEGER) AS best, round(max(v), 6) AS score, count(v) AS known FROM k GROUP BY vec_id""")
def best_of_known(spark: SparkSession, d: str) -> DataFrame:
    """The greatest of the scores that are known, and which it is (A-40)."""
    k = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    v = F.when((F.col("vec_id") + F.col("i")) % 3 != 0, F.col("x").cast("double"))
    return k.withColumn("v", v).groupBy("vec_id").agg(F.max_by("i", "v").alias("best"), F.round(F.max("v"), 6).alias("score"), F.count("v").alias("known"))


def _distances(spark: SparkSession, d: str) -> tuple[list[int], np.ndarray]:
    """Distances of the mean profiles of a handful of classes as a small matrix."""
    rows = X.profile_distance(table(spark, d, "embeddings"), "label", "embedding").limit(2_001).collect()
    if len(rows) > 2_000:
        raise ValueError("a tree on the driver takes at most 63 classes")
    names = sorted({r.unit_a for r in rows} | {r.unit_b for r in rows})
    m = np.zeros((len(names), len(names)))
    for r in rows:
        i, j = names.index(r.unit_a), names.index(r.unit_b)
        m[i, j] = m[j, i] = max(r.d2, 0.0) ** 0.5
    return names, m


@fitted_on("embeddings", "label int, cluster int, height double")
def profile_tree(spark: SparkSession, d: str) -> DataFrame:
    """The average-linkage tree of class profiles: merges, heights and the cut into three (G-09, R-13)."""
    names, m = _distances(spark, d)
    t = K.tree(m)
    cut = K.cut_tree(t, len(names), min(3, len(names)))
    rows = [(int(n), int(c), float(K.cophenetic(t, len(names))[i].max())) for i, (n, c) in enumerate(zip(names, cut))]
    return spark.createDataFrame(rows, "label int, cluster int, height double")


@fitted_on("embeddings", "label int, partner int, distance double, mantel_r double, mantel_p double, side int")
def matched_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes paired at least total distance, how distances agree with the order of names, and the best split into two by swaps (G-06, G-07, G-08, R-12)."""
    names, m = _distances(spark, d)
    half = len(names) // 2
    pairs = K.assign(m[:half, half:])
    order = np.abs(np.subtract.outer(np.arange(len(names)), np.arange(len(names)))).astype(float)
    r, p = K.mantel(m, order, 199)
    score = lambda lab: -float(sum(m[i, j] for i in range(len(lab)) for j in range(i) if lab[i] == lab[j]))
    labels, _ = K.climb([i % 2 for i in range(len(names))], score)
    rows = [(int(names[i]), int(names[half + j]), float(m[i, half + j]), r, p, labels[i]) for i, j in enumerate(pairs)]
    return spark.createDataFrame(rows, "label int, partner int, distance double, mantel_r double, mantel_p double, side int")


@fitted_on("embeddings", "label int, feature int, coefficient double")
def top_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """The three largest coefficients of each class of a linear model (O-09)."""
    return M.top_coefficients(table(spark, d, "embeddings"), "label", "embedding", 3)


@fitted_on("embeddings", "vec_id bigint, label int, guess int")
def stacked(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold probabilities of one view as features of a second model (M-07)."""
    e = table(spark, d, "embeddings").withColumn("fold", F.pmod(F.xxhash64("vec_id"), F.lit(2)).cast("int"))
    return M.stack(e, "vec_id", "label", "fold", [F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)])


@fitted_on("embeddings", "fold int, chosen double, accuracy double")
def nested_selection(spark: SparkSession, d: str) -> DataFrame:
    """Per outer fold the strength of regularisation that inner folds prefer, and its held-out accuracy (M-08, M-14, M-18)."""
    e = table(spark, d, "embeddings").withColumn("fold", F.pmod(F.xxhash64("vec_id"), F.lit(2)).cast("int"))
    return M.nested_selection(e, "vec_id", "label", "fold", F.col("embedding"), [0.001, 0.1])


@fitted_on("embeddings", "vec_id bigint, label int, guess int")
def two_stage(spark: SparkSession, d: str) -> DataFrame:
    """A coarse model, then one within each coarse class (M-11)."""
    e = table(spark, d, "embeddings").withColumns({"coarse": F.col("label") % 2, "held": F.pmod(F.xxhash64("vec_id"), F.lit(4)) == 0})
    return M.two_stage(e, "vec_id", "coarse", "label", "held", F.col("embedding"))


@fitted_on("embeddings", "vec_id bigint, label int, guess int")
def random_features(spark: SparkSession, d: str) -> DataFrame:
    """Ridge regression on random features by normal equations gathered in one pass (M-13)."""
    e = table(spark, d, "embeddings").withColumn("held", F.pmod(F.xxhash64("vec_id"), F.lit(4)) == 0)
    return M.random_feature_ridge(e, "vec_id", "label", "held", "embedding", 64)


QUERIES, SQL = Q.queries, Q.sql
QUERIES |= {f.__name__: f for f in (missed_segments, profile_tree, matched_classes, top_coefficients, stacked, nested_selection, two_stage, random_features)}
