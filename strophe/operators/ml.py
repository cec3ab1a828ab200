"""Models by pyspark.ml and by SQL over long tables of probabilities."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strophe.operators.stats import confusion, partition_agreement
from strophe.session import cut

FitPredict = Callable[[DataFrame, DataFrame], DataFrame]


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: every class has the same total."""
    c = df.groupBy(label).agg(F.count("*").alias("__c"))
    t = c.agg(F.sum("__c").alias("__t"), F.count("*").alias("__k"))
    return df.join(c.crossJoin(F.broadcast(t)).select(label, (F.col("__t") / (F.col("__k") * F.col("__c"))).alias("weight")), label)


def logistic(train: DataFrame, test: DataFrame) -> DataFrame:
    """The default strategy: class-balanced multinomial logistic regression on (features, label); gives (id, p array)."""
    m = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=0.01, maxIter=50).fit(balanced_weights(train, "label"))
    return m.transform(test).select("id", vector_to_array("probability").alias("p"))


def weighted_logistic(train: DataFrame, test: DataFrame, mass: str) -> DataFrame:
    """As ``logistic``, with the rows' own weights times those that balance the classes."""
    x = balanced_weights(train, "label").withColumn("weight", F.col("weight") * F.col(mass))
    m = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=0.01, maxIter=50).fit(x)
    return m.transform(test).select("id", vector_to_array("probability").alias("p"))


def few(df: DataFrame, column: str, most: int = 100) -> list:
    """The values of a column that is to have few; more than ``most`` are an error, never left out."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} values")
    return [r[0] for r in rows]


def cross_validate(df: DataFrame, ident: str, label: str, fold: str, features: Column, fit_predict: FitPredict = logistic) -> DataFrame:
    """``(id, p)`` of every row, predicted by a model that has not seen its fold. Folds are few; each is one fit over all other rows."""
    x = cut(df.select(F.col(ident).alias("id"), F.col(label).cast("double").alias("label"), F.col(fold).alias("fold"), array_to_vector(features.cast("array<double>")).alias("features")))
    folds = few(x, "fold")
    return reduce(DataFrame.unionAll, [fit_predict(x.where(F.col("fold") != f), x.where(F.col("fold") == f)) for f in folds])


def fuse(predictions: Sequence[DataFrame], ident: str, labels: DataFrame) -> DataFrame:
    """``(ident, label, guess)``: class probabilities of several views averaged, then the first greatest."""
    all_ = reduce(DataFrame.unionAll, predictions).select("id", F.posexplode("p").alias("cls", "p"))
    m = all_.groupBy("id", "cls").agg(F.avg("p").alias("p"))
    b = m.groupBy("id").agg(F.max_by("cls", F.struct(F.round("p", 9), -F.col("cls"))).alias("guess"))
    return labels.join(b.withColumnRenamed("id", ident), ident)


def softmax_long(df: DataFrame, ident: str, scores: Column) -> DataFrame:
    """``(ident, cls, p)`` of an array of scores."""
    s = df.select(ident, F.posexplode(F.transform(scores, lambda x: F.exp(x.cast("double")))).alias("cls", "e"))
    return s.withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy(ident))).select(ident, "cls", "p")


def em_priors(p: DataFrame, ident: str, classes: int, rounds: int) -> DataFrame:
    """``(cls, prior)`` by a fixed number of rounds from a uniform start. A round is one pass; the priors are one array of a few numbers.
    No rows give no priors."""
    rows = cut(p.groupBy(ident).agg(F.transform(F.sort_array(F.collect_list(F.struct("cls", "p"))), lambda x: x["p"]).alias("p")))
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], "cls int, prior double")
    q = [1.0 / classes] * classes
    for _ in range(rounds):
        prior = F.array(*[F.lit(x) for x in q])
        w = F.zip_with("p", prior, lambda a, b: a * b)
        total = F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x)
        r = rows.select(F.posexplode(F.transform(w, lambda x: x / total)).alias("cls", "r")).groupBy("cls").agg(F.avg("r").alias("q"))
        got = {x["cls"]: x["q"] for x in r.collect()}
        q = [got.get(i, 0.0) for i in range(classes)]
    return rows.sparkSession.createDataFrame(list(enumerate(q)), "cls int, prior double")


def back_off_scores(train: DataFrame, test: DataFrame, item: str, cls: str, tokens: Sequence[str], k: float) -> DataFrame:
    """``(item, cls, score)``: mean log probability of test tokens under each class.

    tokens: the token and its predecessors. From 1 / (types + 1) on, each longer context that training has seen mixes in with weight
    total / (total + k types). Counts are aggregated; scoring joins each order once.
    """
    v = train.agg((1.0 / (F.count_distinct(tokens[0]) + 1)).alias("p"))
    # few classes: every test token is scored under each
    classes = F.array(*[F.lit(c).cast(train.schema[cls].dataType) for c in few(train, cls)])
    s = test.select(item, *tokens, F.explode(classes).alias("__c")).crossJoin(F.broadcast(v))
    for n in range(len(tokens)):
        context = list(tokens[1 : n + 1])
        known = train.where(F.col(tokens[n]).isNotNull())
        c = known.groupBy(F.col(cls).alias("__c"), *context, tokens[0]).agg(F.count("*").alias("__n"))
        t = c.groupBy("__c", *context).agg(F.sum("__n").alias("__t"), F.count("*").alias("__k"))
        s = s.join(t, ["__c", *context], "left").join(c, ["__c", *context, tokens[0]], "left")
        lam = F.col("__t") / (F.col("__t") + k * F.col("__k"))
        s = s.withColumn("p", F.when(F.col("__t").isNull(), F.col("p")).otherwise(lam * F.coalesce("__n", F.lit(0)) / F.col("__t") + (1 - lam) * F.col("p"))).drop("__n", "__t", "__k")
    return s.groupBy(item, F.col("__c").alias(cls)).agg(F.avg(F.ln("p")).alias("score"))


def kmeans_agreement(df: DataFrame, ident: str, label: str, vector: str, k: int, seed: int = 7) -> DataFrame:
    """One row of agreement between k-means clusters and labels."""
    x = df.select(ident, label, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    c = KMeans(k=k, seed=seed, featuresCol="features").fit(x).transform(x)
    return partition_agreement(confusion(c, label, "prediction"))


def linear_probe(df: DataFrame, vector: str, y: str, held_out: Column) -> DataFrame:
    """One row ``(n, r2)`` on held-out rows; the baseline of the mean has 0."""
    x = cut(df.select(F.col(y).alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"), held_out.alias("held")))
    p = LinearRegression(featuresCol="features", labelCol="label", regParam=0.01).fit(x.where("not held")).transform(x.where("held"))
    r2 = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="r2").evaluate(p)
    return df.sparkSession.createDataFrame([(p.count(), float(r2))], "n long, r2 double")


def _features(df: DataFrame, ident: str, label: str, features: Column, *others: str) -> DataFrame:
    return df.select(F.col(ident).alias("id"), F.col(label).cast("double").alias("label"), array_to_vector(features.cast("array<double>")).alias("features"), *others)


def _fit(train: DataFrame, reg: float = 0.01):
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=reg, maxIter=30).fit(balanced_weights(train, "label"))


def top_coefficients(df: DataFrame, label: str, vector: str, k: int) -> DataFrame:
    """``(label, feature, coefficient)``: the k largest of each class. The matrix has classes times features entries."""
    import numpy as np

    x = cut(df.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features")))
    m = _fit(x).coefficientMatrix.toArray()
    rows = [(c, int(i), float(m[c, i])) for c in range(len(m)) for i in np.argsort(-m[c], kind="stable")[:k]]
    return df.sparkSession.createDataFrame(rows, "label int, feature int, coefficient double")


def stack(df: DataFrame, ident: str, label: str, fold: str, views: Sequence[Column]) -> DataFrame:
    """``(ident, label, guess)``: out-of-fold probabilities of every view side by side, predicted again out of fold."""
    base = df.select(ident, label, fold)
    for i, v in enumerate(views):
        base = base.join(cross_validate(df, ident, label, fold, v).select(F.col("id").alias(ident), F.col("p").alias(f"p{i}")), ident)
    both = cut(base)
    p = cross_validate(both, ident, label, fold, F.concat(*[F.col(f"p{i}") for i in range(len(views))]))
    return fuse([p], ident, df.select(ident, label))


def nested_selection(df: DataFrame, ident: str, label: str, fold: str, features: Column, grid: Sequence[float]) -> DataFrame:
    """``(fold, chosen, accuracy)``: the strength is chosen on inner halves of the training rows only."""
    x = cut(_features(df, ident, label, features, fold))
    folds = few(x, fold)
    right = lambda m, t: m.transform(t).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    rows = []
    for f in folds:
        train, test = x.where(F.col(fold) != f), x.where(F.col(fold) == f)
        inner = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)) == 0
        # the points of the grid are fit side by side
        with ThreadPoolExecutor(max_workers=min(4, len(grid))) as pool:
            scores = list(pool.map(lambda g: right(_fit(train.where(inner), g), train.where(~inner)) or 0.0, grid))
        best = max(zip(scores, grid), key=lambda x: (x[0], -x[1]))[1]
        rows.append((int(f), float(best), float(right(_fit(train, best), test) or 0.0)))
    return df.sparkSession.createDataFrame(rows, "fold int, chosen double, accuracy double")


def two_stage(df: DataFrame, ident: str, coarse: str, fine: str, held: str, features: Column) -> DataFrame:
    """``(ident, label, guess)`` of held-out rows: routed by the coarse model to the model of their coarse class."""
    x = cut(_features(df, ident, fine, features, held, F.col(coarse).cast("double").alias("coarse")))
    train, test = x.where(~F.col(held)), x.where(F.col(held))
    route = _fit(train.select("id", F.col("coarse").alias("label"), "features")).transform(test.select("id", "features")).select("id", F.col("prediction").alias("route"))
    test = cut(test.join(route, "id"))
    classes = few(train, "coarse")
    out = [_fit(train.where(F.col("coarse") == c)).transform(test.where(F.col("route") == c)).select(F.col("id").alias(ident), F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("guess")) for c in classes]
    return reduce(DataFrame.unionAll, out)


def random_feature_ridge(df: DataFrame, ident: str, label: str, held: str, vector: str, hidden: int, reg: float = 1.0, seed: int = 7) -> DataFrame:
    """``(ident, label, guess)`` of held-out rows: a fixed random layer, then ridge regression onto the classes. Each batch adds its part of
    the normal equations (hidden x hidden and hidden x classes); only these sums reach the driver."""
    import numpy as np
    import pandas as pd

    width = df.select(F.max(F.size(vector))).first()[0]
    classes = df.select(F.max(label)).first()[0] + 1
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(width, hidden)), rng.uniform(-1, 1, hidden)
    layer = lambda v: np.tanh(np.stack([np.asarray(x, float) for x in v]) @ w + b)
    x = df.select(F.col(ident).alias("id"), F.col(label).cast("int").alias("label"), F.col(vector).alias("v"), F.col(held).alias("held")).where("v is not null and label is not null")

    def sums(batches):
        a, c = np.zeros((hidden, hidden)), np.zeros((hidden, classes))
        for p in batches:
            if len(p):
                h = layer(p["v"])
                a += h.T @ h
                c += h.T @ np.eye(classes)[p["label"].to_numpy()]
        yield pd.DataFrame({"m": [np.concatenate([a.ravel(), c.ravel()]).tolist()]})

    total = x.where("not held").mapInPandas(sums, "m array<double>").select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    a, c = total[: hidden * hidden].reshape(hidden, hidden), total[hidden * hidden :].reshape(hidden, classes)
    beta = np.linalg.solve(a + reg * np.eye(hidden), c)

    def predict(batches):
        for p in batches:
            if len(p):
                yield pd.DataFrame({"id": p["id"], "label": p["label"], "guess": (layer(p["v"]) @ beta).argmax(axis=1).astype("int32")})

    kind = df.schema[ident].dataType.simpleString()
    return x.where("held").mapInPandas(predict, f"id {kind}, label int, guess int").withColumnRenamed("id", ident)
