"""Domain alignment, sweeps, resampled trees and other composed models. What reaches the driver has the size of a few features or classes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from strophe.operators import kernels as K
from strophe.operators.ml import balanced_weights
from strophe.operators.stats import confusion, partition_agreement
from strophe.session import cut


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and covariance of an array column: each batch adds its sums, and only these reach the driver."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                x = np.stack([np.asarray(v, float) for v in b["v"]])
                s = np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel()))
                total = s if total is None else total + s
        if total is not None:
            yield pd.DataFrame({"s": [total.tolist()]})

    rows = df.select(F.col(vector).alias("v")).where("v is not null").mapInPandas(sums, "s array<double>")
    s = np.array([r[0] for r in rows.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").select("x").collect()])
    if not len(s):
        raise ValueError("no vectors")
    n, d = int(s[0]), int(round((np.sqrt(4 * len(s) - 3) - 1) / 2))
    mean = s[1 : d + 1] / n
    return n, mean, (s[d + 1 :].reshape(d, d) - n * np.outer(mean, mean)) / max(1, n - 1)


def root(c: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The symmetric (inverse) square root of a covariance."""
    w, v = np.linalg.eigh(c)
    w = np.maximum(w, 1e-8)
    return v @ np.diag(w ** (-0.5 if inverse else 0.5)) @ v.T


def _mapped(df: DataFrame, vector: str, mean: np.ndarray, m: np.ndarray) -> DataFrame:
    """(x - mean) m of every vector."""

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[vector] = list((np.stack([np.asarray(v, float) for v in b[vector]]) - mean) @ m) if len(b) else []
            yield b

    rest = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != vector]
    return df.where(F.col(vector).isNotNull()).select(*[c for c in df.columns if c != vector], vector).mapInPandas(move, ", ".join([*rest, f"{vector} array<double>"]))


def aligned(source: DataFrame, target: DataFrame, vector: str, how: str, eps: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Both domains on one footing: scaled by the source (``none``), each by itself (``z``), or the source whitened and given the
    covariance of the target (``coral``)."""
    (_, ms, cs), (_, mt, ct) = moments(source, vector), moments(target, vector)
    ss, st = (np.diag(1 / np.sqrt(np.where(np.diag(c) > 0, np.diag(c), 1))) for c in (cs, ct))
    if how == "none":
        return _mapped(source, vector, ms, ss), _mapped(target, vector, ms, ss)
    if how == "z":
        return _mapped(source, vector, ms, ss), _mapped(target, vector, mt, st)
    if how != "coral":
        raise ValueError(how)
    one = eps * np.eye(len(ms))
    turn = ss @ root(ss @ cs @ ss + one, inverse=True) @ root(st @ ct @ st + one)
    return _mapped(source, vector, ms, turn), _mapped(target, vector, mt, st)


def _vectors(df: DataFrame, ident: str, label: str, features: Column, *others: str) -> DataFrame:
    return df.select(F.col(ident).alias("id"), F.col(label).cast("double").alias("label"), array_to_vector(features.cast("array<double>")).alias("features"), *others)


def right_share(predictions: DataFrame) -> float:
    return float(predictions.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] or 0.0)


def transfer(source: DataFrame, target: DataFrame, ident: str, label: str, vector: str, hows: Sequence[str]) -> list[tuple[str, float]]:
    """Accuracy on the target of a balanced logistic regression on the source, per alignment."""
    out = []
    for how in hows:
        a, b = aligned(source, target, vector, how)
        a, b = cut(_vectors(a, ident, label, F.col(vector))), _vectors(b, ident, label, F.col(vector))
        m = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=30).fit(balanced_weights(a, "label"))
        out.append((how, right_share(m.transform(b))))
    return out


def importance_weights(source: DataFrame, target: DataFrame, ident: str, vector: str, low: float = 0.05, high: float = 20.0) -> DataFrame:
    """``(ident, weight)`` of the source rows: odds of the target by a domain classifier that has not seen the row, clipped, of mean 1.
    The classifier is fit on the halves of a hash in turn."""
    both = source.select(ident, vector, F.lit(0.0).alias("__d")).unionAll(target.select(ident, vector, F.lit(1.0).alias("__d")))
    x = cut(_vectors(both, ident, "__d", F.col(vector)).withColumn("half", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")))
    fit = lambda t: LogisticRegression(weightCol="weight", regParam=0.01, maxIter=50).fit(balanced_weights(t, "label"))
    p = None
    for half in (0, 1):
        got = fit(x.where(F.col("half") != half)).transform(x.where(F.col("half") == half)).select("id", "label", vector_to_array("probability")[1].alias("p"), "rawPrediction")
        p = got if p is None else p.unionAll(got)
    p = cut(p)
    q = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    w = p.where("label = 0").select(F.col("id").alias(ident), F.least(F.greatest(q / (1 - q), F.lit(low)), F.lit(high)).alias("w"))
    mean = w.agg(F.avg("w").alias("m"))
    return w.crossJoin(F.broadcast(mean)).select(ident, (F.col("w") / F.col("m")).alias("weight")), float(BinaryClassificationEvaluator().evaluate(p))


def strategies(train: DataFrame, test: DataFrame, seed: int = 7) -> list[tuple[str, float]]:
    """Held-out accuracy of a linear and an RBF support vector machine (the second on random Fourier features), a forest, and boosted trees.
    Both sides: (id, label, features)."""
    x, y = cut(train), cut(test)
    width = len(x.first()["features"])
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 1 / np.sqrt(width), (width, 128)), rng.uniform(0, 2 * np.pi, 128)

    def waves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            v = np.cos(np.stack([np.asarray(f, float) for f in p["f"]]) @ w + b) * np.sqrt(2 / 128) if len(p) else []
            yield pd.DataFrame({"label": p["label"], "f": list(v)})

    wave = lambda t: t.select("label", vector_to_array("features").alias("f")).mapInPandas(waves, "label double, f array<double>").select("label", array_to_vector("f").alias("features"))
    svm = OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.01), parallelism=4)
    models = {
        "linear svm": (svm, x, y), "rbf svm": (svm, wave(x), wave(y)),
        "forest": (RandomForestClassifier(numTrees=40, maxDepth=8, seed=seed), x, y),
        "boosting": (OneVsRest(classifier=GBTClassifier(maxIter=5, maxDepth=3, seed=seed), parallelism=4), x, y),
    }
    return [(name, right_share(m.fit(a).transform(c))) for name, (m, a, c) in models.items()]


def diagonal_mixture(df: DataFrame, vector: str, k: int, rounds: int = 10, reg: float = 1e-4, seed: int = 7) -> DataFrame:
    """Adds ``prediction``: the likeliest of k normal distributions with diagonal covariances, by a fixed number of rounds from k-means centres.
    A round is one pass; k means, variances and shares are all that reaches the driver."""
    x = cut(df.where(F.col(vector).isNotNull()))
    km = KMeans(k=k, seed=seed).fit(x.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")))
    _, _, c = moments(x, vector)
    centres = np.array(km.clusterCenters())
    mean, var, share = centres, np.tile(np.diag(c) + reg, (len(centres), 1)), np.full(len(centres), 1 / len(centres))

    def logs(v: np.ndarray, mean: np.ndarray, var: np.ndarray, share: np.ndarray) -> np.ndarray:
        far = ((v[:, None] - mean[None]) ** 2 / var[None]).sum(2) + np.log(var).sum(1)[None]
        return np.log(np.maximum(share, 1e-300))[None] - far / 2

    for _ in range(rounds):

        def sums(batches: Iterator[pd.DataFrame], m=mean, s=var, q=share) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    v = np.stack([np.asarray(r, float) for r in b["v"]])
                    p = logs(v, m, s, q)
                    p = np.exp(p - p.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    yield pd.DataFrame({"s": [np.concatenate((p.sum(0), (p.T @ v).ravel(), (p.T @ v**2).ravel())).tolist()]})

        rows = x.select(F.col(vector).alias("v")).mapInPandas(sums, "s array<double>").select(F.posexplode("s").alias("i", "x"))
        t = np.array([r[0] for r in rows.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").select("x").collect()])
        n, parts = np.maximum(t[: len(share)], 1e-9), t[len(share) :].reshape(2, *mean.shape)
        mean, share = parts[0] / n[:, None], n / n.sum()
        var = np.maximum(parts[1] / n[:, None] - mean**2, 0) + reg

    def best(batches: Iterator[pd.DataFrame], m=mean, s=var, q=share) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["prediction"] = logs(np.stack([np.asarray(r, float) for r in b[vector]]), m, s, q).argmax(1) if len(b) else []
            yield b.astype({"prediction": "int32"})

    return x.mapInPandas(best, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in x.schema), "prediction int"]))


def cluster_sweep(df: DataFrame, label: str, vector: str, ks: Sequence[int], seed: int = 7, micro: int = 60) -> DataFrame:
    """Agreement with the labels of k-means, normal mixtures and Ward's method at several k. Ward merges the centres of ``micro`` small
    clusters, weighed by their size, so what it needs at once does not grow with the rows."""
    v = cut(df.select(label, F.col(vector).cast("array<double>").alias("v")).where("v is not null"))
    x = cut(v.select(label, array_to_vector("v").alias("features")))
    fine = KMeans(k=micro, seed=seed).fit(x)
    small = cut(fine.transform(x).select(label, F.col("prediction").alias("micro")))
    sizes = dict(small.groupBy("micro").count().collect())
    centres = np.array(fine.clusterCenters())
    merges = K.ward(centres, [sizes.get(i, 0) for i in range(len(centres))])
    out = None
    for k in ks:
        km = KMeans(k=k, seed=seed).fit(x).transform(x)
        gm = cut(diagonal_mixture(v, "v", k, seed=seed))
        to = K.cut_tree(merges, len(centres), min(k, len(centres)))
        wd = small.withColumn("prediction", F.element_at(F.array(*[F.lit(t) for t in to]), F.col("micro") + 1))
        for name, c in (("k-means", km), ("mixture", gm), ("ward", wd)):
            a = partition_agreement(confusion(c, label, "prediction")).select(F.lit(name).alias("method"), F.lit(k).alias("k"), "*")
            out = a if out is None else out.unionAll(a)
    return out


def latent_clusters(terms: DataFrame, ident: str, features: int, dims: int, k: int, seed: int = 7) -> DataFrame:
    """``(ident, cluster)`` from (ident, term, w) rows: the ``features`` most frequent terms, truncated singular value decomposition, k-means.
    The decomposition needs the Gram matrix of the features on the driver, whatever the number of rows."""
    kind = terms.schema[ident].dataType.simpleString()
    top = terms.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(features)
    names = [r[0] for r in top.select("term").collect()]
    width = len(names)
    if not width:
        return terms.sparkSession.createDataFrame([], f"{ident} {kind}, cluster int")
    index = df_index(terms.sparkSession, names)
    entry = F.when(F.col("i").isNotNull(), F.struct("i", "w"))  # what has none of these terms is kept, with nothing
    v = terms.join(F.broadcast(index), "term", "left").groupBy(ident).agg(F.sort_array(F.collect_list(entry)).alias("v"))
    v = cut(v.select(ident, F.col("v.i").alias("i"), F.col("v.w").alias("w")))
    basis = principal(gram_matrix(v, width), min(dims, max(1, width - 1)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, 1000) for at in range(0, b.num_rows, 1000)):
                z = _dense(part, width) @ basis
                flat = pa.ListArray.from_arrays(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32), z.ravel())
                yield pa.record_batch([part[ident], flat], [ident, "z"])

    z = v.mapInArrow(project, f"{ident} {kind}, z array<double>").select(ident, array_to_vector("z").alias("features"))
    z = cut(z)
    return KMeans(k=k, seed=seed).fit(z).transform(z).select(ident, F.col("prediction").alias("cluster"))


def _entries(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the rows of a batch of (i, w) arrays, and their entries one after the other."""
    return np.diff(b["i"].offsets.to_numpy()), b["i"].flatten().to_numpy(), b["w"].flatten().to_numpy()


def _dense(b: pa.RecordBatch, width: int) -> np.ndarray:
    n, i, w = _entries(b)
    x = np.zeros((b.num_rows, width))
    x[np.repeat(np.arange(len(n)), n), i] = w
    return x


def gram_matrix(v: DataFrame, width: int, pieces: int = 16) -> np.ndarray:
    """The sum of the outer products of sparse rows (i, w: arrays). A task adds up its rows and hands its matrix on in pieces, of which the
    sums reach the driver; its pairs of entries are added in runs of rows, so memory follows the width. Each pair of an i and a j, i <= j, counts."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = np.zeros(width * width), TaskContext.get().partitionId()
        for b in batches:
            for part in (b.slice(at, 500) for at in range(0, b.num_rows, 500)):
                n, i, w = _entries(part)
                after = np.repeat(np.cumsum(n), n) - np.arange(len(i))  # entries of the row from this one on
                a = np.repeat(np.arange(len(i)), after)
                other = a + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)
                total += np.bincount(i[a].astype(np.int64) * width + i[other], weights=w[a] * w[other], minlength=width * width)
        if total.any():
            cuts = np.array_split(total, pieces)
            yield pa.record_batch([pa.array(range(pieces), pa.int32()), pa.array([task] * pieces, pa.int32()), pa.array(cuts, pa.list_(pa.float64()))], ["piece", "task", "x"])

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": g["piece"].iloc[:1], "x": [np.sum(np.stack(g.sort_values("task")["x"]), axis=0)]})

    few = v.select("i", "w").coalesce(2 * v.sparkSession.sparkContext.defaultParallelism)
    got = few.mapInArrow(sums, "piece int, task int, x array<double>").groupBy("piece").applyInPandas(add, "piece int, x array<double>").collect()
    upper = np.concatenate([r["x"] for r in sorted(got, key=lambda r: r["piece"])]).reshape(width, width) if got else np.zeros((width, width))
    return upper + np.triu(upper, 1).T


def principal(gram: np.ndarray, dims: int) -> np.ndarray:
    """The right singular vectors of a matrix of this Gram matrix, largest values first; those of values that are nothing beside the first are left out."""
    values, vectors = np.linalg.eigh(gram)
    sigma = np.sqrt(np.maximum(values[::-1][:dims], 0))
    return vectors[:, ::-1][:, :dims][:, sigma >= 1e-9 * sigma[0]]


def df_index(spark, names: Sequence[str]) -> DataFrame:
    """A vocabulary with its numbers, bounded by the caller."""
    return spark.createDataFrame(list(enumerate(names)), "i int, term string")


def resampled_profiles(df: DataFrame, ident: str, label: str, vector: str, replicates: int, seed: str = "clade") -> DataFrame:
    """``(b, label, profile)``: mean vectors of the classes in Poisson resamples; replicate 0 is the data as it is. The weights of a row come
    from a generator seeded by its id, so they do not depend on the partitions; each batch adds up its part of all replicates."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for name, g in p.groupby("label"):
                x = np.stack([np.asarray(v, float) for v in g["v"]])
                w = np.stack([np.random.default_rng(zlib.crc32(f"{seed}|{i}".encode())).poisson(1.0, replicates) for i in g["id"]])
                w = np.concatenate((np.ones((len(x), 1)), w), axis=1)
                total = w.T @ np.concatenate((x, np.ones((len(x), 1))), axis=1)
                out += [(b, name, t.tolist()) for b, t in enumerate(total)]
            yield pd.DataFrame(out, columns=["b", "label", "s"])

    kind = df.schema[label].dataType.simpleString()
    rows = df.select(F.col(ident).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where("id is not null and label is not null and v is not null")
    parts = rows.mapInPandas(sums, f"b int, label {kind}, s array<double>").select("b", "label", F.posexplode("s").alias("i", "x"))
    m = parts.groupBy("b", "label", "i").agg(F.sum("x").alias("x")).groupBy("b", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("s"))
    n = F.nullif(F.element_at("s", -1), F.lit(0.0))
    return m.select("b", "label", F.transform(F.slice("s", 1, F.size("s") - 1), lambda e: e / n).alias("profile"))


def clade_support(profiles: DataFrame, most: int = 64) -> list[tuple[str, float]]:
    """``(clade, support)``: the clades of the average-linkage tree of replicate 0, and the share of the others that have them. For a few classes."""
    rows = profiles.limit(1 + most * 2_000).collect()
    labels = sorted({r["label"] for r in rows})
    if len(labels) > most:
        raise ValueError(f"trees are made of at most {most} classes")
    by: dict[int, dict] = {}
    for r in rows:
        by.setdefault(r["b"], {})[r["label"]] = np.array([np.nan if x is None else x for x in r["profile"]], float)

    def clades(p: dict) -> set[frozenset]:
        names = [n for n in labels if n in p and not np.isnan(p[n]).any()]
        x = np.stack([p[n] for n in names])
        return {frozenset(names[i] for i in c) for c in K.clades(K.tree(np.linalg.norm(x[:, None] - x[None], axis=2)), len(names))}

    ref = clades(by[0])
    others = [clades(p) for b, p in sorted(by.items()) if b]
    return sorted(("|".join(map(str, sorted(c))), sum(c in o for o in others) / max(1, len(others))) for c in ref)
