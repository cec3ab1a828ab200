"""Models on data whose answer is known, and small kernels against brute force."""

import itertools
import random

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from strophe.operators import kernels as K, learn as L, ml as M


def blobs(spark, n=240, classes=3, width=6, shift=0.0, scale=1.0, seed=1, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(0, 3, (classes, width))
    rows = [(i, i % classes, ((centres[i % classes] + rng.normal(0, spread, width)) * scale + shift).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label int, v array<double>")


def test_moments_and_alignment(spark):
    df = blobs(spark, 50)
    x = np.array([r.v for r in df.collect()])
    n, mean, cov = L.moments(df.repartition(4), "v")
    assert n == 50 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x, rowvar=False))
    c = np.cov(x, rowvar=False)
    assert np.allclose(L.root(c) @ L.root(c), c, atol=1e-6) and np.allclose(L.root(c) @ L.root(c, inverse=True), np.eye(6), atol=1e-4)
    got = dict(L.transfer(blobs(spark), blobs(spark, shift=9.0, scale=2.0, seed=2), "id", "label", "v", ["none", "z", "coral"]))
    assert got["z"] > 0.95 and got["coral"] > 0.95 and got["none"] < got["z"]


def test_importance_weights(spark):
    w, auc = L.importance_weights(blobs(spark, seed=3), blobs(spark, seed=4).withColumn("id", F.col("id") + 1000), "id", "v")
    r = w.agg(F.avg("weight").alias("m"), F.count("*").alias("n")).first()
    assert abs(r.m - 1) < 1e-9 and r.n == 240 and auc < 0.7
    # a target of one class: its rows of the source weigh more
    w, auc = L.importance_weights(blobs(spark, seed=3), blobs(spark, seed=5).where("label = 0").withColumn("id", F.col("id") + 1000), "id", "v")
    by = {r.label: r.w for r in w.join(blobs(spark, seed=3), "id").groupBy("label").agg(F.avg("weight").alias("w")).collect()}
    assert by[0] > 5 * by[1] and auc > 0.8


def test_strategies_and_views(spark):
    x = blobs(spark).select("id", F.col("label").cast("double").alias("label"), array_to_vector("v").alias("features"))
    got = dict(L.strategies(x.where("floor(id / 3) % 3 > 0"), x.where("floor(id / 3) % 3 = 0")))
    assert set(got) == {"linear svm", "rbf svm", "forest", "boosting"}
    x = x.withColumn("label", F.floor(F.col("id") / 6) % 3 * 1.0)  # no relation to the features
    assert min(got.values()) > 0.9 and max(a for _, a in L.strategies(x.where("id % 2 = 0"), x.where("id % 2 = 1"))) < 0.7


def test_held_out_accuracy(spark):
    df = blobs(spark).withColumn("fold", (F.col("id") / 3 % 3).cast("int"))
    right = lambda p: p.agg(F.avg((F.col("label") == F.col("guess")).cast("int"))).first()[0]
    views = [F.slice("v", 1, 3), F.slice("v", 4, 3)]
    assert right(M.fuse([M.cross_validate(df, "id", "label", "fold", v) for v in views], "id", df.select("id", "label"))) > 0.95
    assert right(M.stack(df, "id", "label", "fold", views)) > 0.9
    held = df.withColumns({"held": F.col("id") % 4 == 0, "coarse": (F.col("label") > 0).cast("int")})
    two, ridge = M.two_stage(held, "id", "coarse", "label", "held", F.col("v")), M.random_feature_ridge(held, "id", "label", "held", "v", 40)
    assert right(two) > 0.9 and right(ridge) > 0.9 and two.count() == ridge.count() == 60
    rows = M.nested_selection(df, "id", "label", "fold", F.col("v"), [0.001, 0.1]).collect()
    assert [r.fold for r in rows] == [0, 1, 2] and all(r.accuracy > 0.9 and r.chosen in (0.001, 0.1) for r in rows)
    assert M.linear_probe(df.withColumn("y", F.col("v")[0] * 2 + F.col("v")[1]), "v", "y", F.col("id") % 4 == 0).first().r2 > 0.99
    top = M.top_coefficients(df, "label", "v", 2).collect()
    assert sorted(r.label for r in top) == [0, 0, 1, 1, 2, 2] and all(0 <= r.feature < 6 for r in top)


def test_more_values_than_a_model_is_made_for(spark):
    df = spark.range(300).select("id", (F.col("id") % 150).alias("fold"))
    try:
        M.few(df, "fold")
        raise AssertionError
    except ValueError:
        pass
    assert M.few(df.where("fold < 100"), "fold") == list(range(100)) and M.few(df.where("false"), "fold") == []


def test_clusters(spark):
    df = blobs(spark, 300)
    p = L.diagonal_mixture(df, "v", 3).groupBy("label", "prediction").count().collect()
    assert len(p) == 3 and len({r.prediction for r in p}) == 3
    assert all(r.nmi > 0.99 for r in L.cluster_sweep(df, "label", "v", [3], micro=12).collect())
    words = [("song of the river", "moon above the hill", "bamboo flute tune")[i % 3] + f" {i}" for i in range(60)]
    terms = spark.createDataFrame([(w, g) for w in words for g in {w[i : i + 3] for i in range(len(w) - 2)}], "t string, term string").withColumn("w", F.lit(1.0))
    got = {r.t: r.cluster for r in L.latent_clusters(terms, "t", 100, 5, 3).collect()}
    assert set(got) == set(words) and len({(w[:4], c) for w, c in got.items()}) == 3


def test_ward_takes_the_cheapest_merge():
    rng = np.random.default_rng(5)
    x, sizes = rng.normal(size=(7, 2)), [1, 3, 2, 1, 1, 4, 2]
    members = {i: [i] for i in range(7)}

    def inside(ms):
        w = np.array([sizes[m] for m in ms], float)
        c = (x[ms] * w[:, None]).sum(0) / w.sum()
        return float((w * ((x[ms] - c) ** 2).sum(1)).sum())

    for k, (a, b, h) in enumerate(K.ward(x, sizes)):
        add = {p: inside(members[p[0]] + members[p[1]]) - inside(members[p[0]]) - inside(members[p[1]]) for p in itertools.combinations(members, 2)}
        assert abs(add[tuple(sorted((a, b)))] - min(add.values())) < 1e-9 and abs(h**2 / 2 - min(add.values())) < 1e-9
        members[7 + k] = members.pop(a) + members.pop(b)
    assert K.ward(x[:1], [1]) == []


def test_trees_and_permutations(spark):
    d = np.array([[0, 1, 5, 5], [1, 0, 5, 5], [5, 5, 0, 1], [5, 5, 1, 0]], float)
    assert sorted(map(sorted, K.clades(K.tree(d), 4))) == [[0, 1], [2, 3]]
    assert K.ranks([3, 1, 3, 2]).tolist() == [3.5, 1.0, 3.5, 2.0]
    r, p = K.mantel(d, d, 24)  # 4! orders, all of them: 8 keep the matrix
    assert abs(r - 1) < 1e-12 and abs(p - 8 / 24) < 1e-12
    c, p = K.group_contrast(d, [0, 0, 1, 1], 199)
    assert abs(c - (5 - 1) / (22 / 6)) < 1e-12 and 0.2 < p < 0.5
    assert np.isnan(K.group_contrast(d, [0, 0, 0, 0], 9)[0])
    rng = np.random.default_rng(6)
    centre = {0: (0, 0), 1: (0.3, 0), 2: (9, 9), 3: (9.3, 9)}
    rows = [(i, i % 4, (np.array(centre[i % 4]) + rng.normal(0, 0.05, 2)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    p = L.resampled_profiles(df.repartition(3), "id", "label", "v", 20)
    assert L.clade_support(p) == [("0|1", 1.0), ("2|3", 1.0)]
    zero = {r.label: r.profile for r in p.where("b = 0").collect()}
    for k in range(4):
        assert np.allclose(zero[k], np.mean([v for _, label, v in rows if label == k], axis=0))
    # the same whatever the partitions
    again = L.resampled_profiles(df.repartition(7), "id", "label", "v", 20)
    assert sorted((r.b, r.label, [round(x, 9) for x in r.profile]) for r in p.collect()) == sorted((r.b, r.label, [round(x, 9) for x in r.profile]) for r in again.collect())


def test_assignment_and_swaps_equal_brute_force():
    rng = random.Random(8)
    for n in (2, 4, 5):
        cost = np.array([[rng.random() for _ in range(n)] for _ in range(n)])
        got = K.assign(cost)
        assert abs(sum(cost[i, j] for i, j in enumerate(got)) - min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))) < 1e-12
    assert abs(K.chance_recall(10, 3, 2) - (1 - (7 / 10) * (6 / 9))) < 1e-12 and K.chance_recall(5, 4, 2) == 1.0


def test_decomposition_reads_the_rows_once(spark):
    """The Gram matrix and its vectors are those of the whole matrix; what has no frequent term is clustered too; one pass, whatever the width."""
    rng = np.random.default_rng(8)
    x = np.where(rng.random((90, 30)) < 0.2, rng.random((90, 30)), 0.0)
    v = spark.createDataFrame([(k, [int(i) for i in np.flatnonzero(r)], [float(w) for w in r[r > 0]]) for k, r in enumerate(x)], "id int, i array<int>, w array<double>").repartition(5)
    gram = L.gram_matrix(v, 30, 4)
    assert np.allclose(gram, x.T @ x)
    mine, whole = L.principal(gram, 6), np.linalg.svd(x)[2][:6].T
    assert np.allclose(mine @ mine.T, whole @ whole.T) and L.principal(np.diag([4.0, 0, 0]), 2).shape == (3, 1)
    words = ["".join(rng.choice(list("abcdefghijkl"), 9)) for _ in range(200)]
    rows = [(w, g) for w in words for g in {w[i : i + 2] for i in range(8)}] + [("alone", "zz")]
    terms = spark.createDataFrame(rows, "t string, term string").withColumn("w", F.lit(0.5)).cache()
    spark.sparkContext.setJobGroup("latent", "")
    got = L.latent_clusters(terms, "t", 120, 5, 3).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("latent"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r.t for r in got) == sorted({*words, "alone"}) and jobs < 60, jobs
    assert L.latent_clusters(terms.where("false"), "t", 120, 5, 3).collect() == []
