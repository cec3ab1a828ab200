"""Composed learning and selection (survey groups M, R, G, E-07, J-24): views, sweeps, transfer, leave-one-out, roles, draws, resampled trees."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strophe.functions.columns import hash_order
from strophe.functions.text import present
from strophe.operators import kernels as K, learn as L, ml as M, stats as X
from strophe.operators.ordered import number_rows
from strophe.operators.relational import cap_per_group
from strophe.operators.similarity import cosine_pairs, unit_vectors
from strophe.plans.models import _WEIGHTS, _name_terms
from strophe.plans.music import _VOCABULARIES, _Y, _joined_sql, token_vocabularies
from strophe.plans.registry import REC, Registry, fitted_on, recordings, sql_present, table
from strophe.session import cut

Q = Registry()

VIEWS = ("deg", "int", "dur")
_VIEW_SQL = _joined_sql({v: _VOCABULARIES[v] for v in VIEWS}, "view", "tokens")


def view_terms(spark: SparkSession, d: str, least: int = 2, most: int = 200_000) -> DataFrame:
    """``(item, view, term)`` of all n-grams of one to four tokens; terms of fewer than ``least`` items are dropped, and of a view the ``most``
    frequent terms are kept, as the model has it."""
    t = token_vocabularies(spark, d).where(F.col("vocab").isin(*VIEWS)).select("item", F.col("vocab").alias("view"), F.split("tokens", " ").alias("t"))

    def grams(n: int) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size("t") - (n - 1)), lambda i: F.array_join(F.slice("t", i, F.lit(n)), " "))
        return F.when(F.size("t") >= n, joined).otherwise(F.array().cast("array<string>"))

    g = t.select("item", "view", F.explode(F.concat(*[grams(n) for n in (1, 2, 3, 4)])).alias("term"))
    df = g.groupBy("view", "term").agg(F.count_distinct("item").alias("df"), F.count("*").alias("n")).where(F.col("df") >= least)
    kept = cap_per_group(df, ["view"], [F.desc("n"), F.col("term")], most).select("view", "term")
    return g.join(kept, ["view", "term"])


@Q(f"""WITH {_Y}, tk AS ({_VIEW_SQL}), a AS (SELECT item, view, string_split(tokens, ' ') AS t FROM tk),
    gr AS (SELECT item, view, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i+1], ' ')), list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], ' ')), list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i+3], ' ')))) AS term FROM a),
    tf AS (SELECT item, view, term, count(*) AS tf FROM gr GROUP BY ALL), df AS (SELECT view, term, count(*) AS df FROM tf GROUP BY ALL HAVING count(*) >= 2), kept AS (SELECT tf.*, df FROM tf JOIN df ON df.view = tf.view AND df.term = tf.term), nv AS (SELECT view, count(DISTINCT item) AS n FROM kept GROUP BY view),
    w AS (SELECT item, kept.view, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM kept JOIN nv ON nv.view = kept.view)
    SELECT item, view, count(*) AS terms, round(max(w) / sqrt(sum(w * w)), 6) AS heaviest, round(sum(w) / sqrt(sum(w * w)), 5) AS mass FROM w GROUP BY item, view""")
def multi_view_terms(spark: SparkSession, d: str) -> DataFrame:
    """Weighted n-grams of three views of each item, each view of unit length (M-01): per item and view the terms, the heaviest and the sum."""
    t = view_terms(spark, d)
    out = None
    for v in VIEWS:
        u = unit_vectors(t.where(F.col("view") == v), "item", "term").groupBy("item").agg(F.count("*").alias("terms"), F.round(F.max("w"), 6).alias("heaviest"), F.round(F.sum("w"), 5).alias("mass"))
        u = u.select("item", F.lit(v).alias("view"), "terms", "heaviest", "mass")
        out = u if out is None else out.unionAll(u)
    return out


@fitted_on("recordings", "title string, cluster int")
def title_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Titles by weighted n-grams of one to three characters, a truncated decomposition, and k-means (M-02): every title with its cluster."""
    t = recordings(spark, d, "title").where(present("title").isNotNull()).select("title").distinct()
    t = cut(t.withColumn("id", F.monotonically_increasing_id()))  # a title has some 70 terms, and is not moved with each of them

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("title") - (n - 1), F.lit(1))), lambda i: F.substring("title", i, F.lit(n)))

    every = F.concat(*[grams(n) for n in (1, 2, 3)])
    got = L.latent_clusters(unit_vectors(t.select("id", F.explode(every).alias("term")), "id", "term"), "id", 1000, 50, 15)
    return t.join(got, "id").select("title", "cluster")


def _split(spark: SparkSession, d: str, parts: int = 3) -> tuple[DataFrame, DataFrame]:
    """The vectors as (id, label, features), training rows and held-out ones by the hash of the id."""
    x = L._vectors(table(spark, d, "embeddings"), "vec_id", "label", F.col("embedding")).withColumn("held", F.pmod(F.xxhash64("id"), F.lit(parts)) == 0)
    return x.where("not held").drop("held"), x.where("held").drop("held")


@fitted_on("embeddings", "strategy string, accuracy double")
def strategy_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Held-out accuracy of four kinds of classifier (M-04, U-06); how good they are is tested on classes that can be told apart."""
    return spark.createDataFrame(L.strategies(*_split(spark, d)), "strategy string, accuracy double")


@fitted_on("embeddings", "vec_id bigint, label int, guess int")
def dual_view(spark: SparkSession, d: str) -> DataFrame:
    """Two views of the held-out rows: a model of the training rows, and one that also takes outside rows at the same total weight; their
    probabilities are averaged (M-06)."""
    e = table(spark, d, "embeddings").withColumn("h", F.pmod(F.xxhash64("vec_id"), F.lit(4)))
    half = lambda t, a: L._vectors(t, "vec_id", "label", F.slice("embedding", a, 32))
    train, outside, test = e.where("h in (1, 2)"), e.where("h = 3"), e.where("h = 0")
    n = e.agg(F.count_if(F.col("h").isin(1, 2)).alias("t"), F.greatest(F.count_if(F.col("h") == 3), F.lit(1)).alias("o")).first()
    both = half(train, 33).withColumn("mass", F.lit(1.0)).unionAll(half(outside, 33).withColumn("mass", F.lit(float(n.t) / n.o)))
    surface = M.logistic(half(train, 1), half(test, 1))
    skeleton = M.weighted_logistic(both, half(test, 33), "mass")
    return M.fuse([surface, skeleton], "vec_id", test.select("vec_id", "label"))


@fitted_on("embeddings", "alignment string, accuracy double")
def transfer_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """From one domain to another, unaligned, scaled each by itself, and by correlation alignment (M-10)."""
    e = table(spark, d, "embeddings")
    source, target = e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")
    return spark.createDataFrame(L.transfer(source, target, "vec_id", "label", "embedding", ["none", "z", "coral"]), "alignment string, accuracy double")


@fitted_on("embeddings", "n bigint, effective double, auc double")
def domain_weights(spark: SparkSession, d: str) -> DataFrame:
    """Importance weights of a source domain (M-10): their number, the area under the curve of the domain classifier, and the effective sample."""
    e = table(spark, d, "embeddings")
    w, auc = L.importance_weights(e.where("label < 5"), e.where("label >= 3"), "vec_id", "embedding")
    ess = (F.pow(F.sum("weight"), 2) / F.sum(F.col("weight") * F.col("weight"))).alias("effective")
    return w.agg(F.count("*").alias("n"), ess).withColumn("auc", F.lit(auc))


@fitted_on("embeddings", "method string, k int, nmi double, ari double, fowlkes_mallows double")
def cluster_sweeps(spark: SparkSession, d: str) -> DataFrame:
    """k-means, mixtures and Ward's method at three sizes, and how they agree with the labels (M-12)."""
    return L.cluster_sweep(table(spark, d, "embeddings"), "label", "embedding", [5, 10, 15])


@Q(f"""WITH {_WEIGHTS}, near AS (SELECT a.s AS a, b.s AS b FROM u a JOIN u b ON a.g = b.g GROUP BY a.s, b.s HAVING round(sum(a.w * b.w), 6) >= 0.9),
    o AS (SELECT DISTINCT item_id, song_name AS s, fold, song_key FROM {REC} WHERE fold IS NOT NULL AND song_key IS NOT NULL)
    SELECT DISTINCT x.item_id FROM o x JOIN near ON near.a = x.s JOIN (SELECT DISTINCT s, fold, song_key FROM o) y ON y.s = near.b AND y.fold <> x.fold AND y.song_key <> x.song_key""")
def cross_fold_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Recordings of which another fold holds one of nearly the same name (cosine 0.9) under another key (E-07). Names are compared once each; a
    name then carries what folds and keys it has: only whether a different one is among them matters, so no pairs of recordings are made."""
    pairs = cosine_pairs(unit_vectors(_name_terms(spark, d), "s", "g"), "s", "g", 0.8999999).where("round(cosine, 6) >= 0.9").select("a", "b")
    names = _name_terms(spark, d).select("s").distinct()
    near = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionAll(names.select(F.col("s").alias("a"), F.col("s").alias("b")))
    o = recordings(spark, d, "song_name", "fold", "song_key").where("fold is not null and song_key is not null").select("item_id", F.col("song_name").alias("s"), "fold", "song_key")
    kinds = o.select("s", "fold", "song_key").distinct()
    # per name and fold of a neighbourhood: one key, and whether there are others
    held = near.join(kinds.withColumnRenamed("s", "b"), "b").groupBy("a", "fold").agg(F.min("song_key").alias("lo"), F.max("song_key").alias("hi"))
    held = held.groupBy("a").agg(F.collect_list(F.struct("fold", "lo", "hi")).alias("folds"))
    other = F.exists("folds", lambda f: (f["fold"] != F.col("fold")) & ((f["lo"] != F.col("song_key")) | (f["hi"] != F.col("song_key"))))
    return o.join(held.withColumnRenamed("a", "s"), "s").where(other).select("item_id").distinct()


@Q(f"""WITH r AS (SELECT item_id, platform, song_key, genre FROM {REC} WHERE platform IS NOT NULL AND song_key IS NOT NULL AND {sql_present('genre')} IS NOT NULL), p AS (SELECT DISTINCT platform FROM r), k AS (SELECT DISTINCT platform, song_key FROM r),
    t AS (SELECT p.platform, r.genre, count(*) AS n FROM p, r WHERE r.platform <> p.platform AND NOT EXISTS (SELECT 1 FROM k WHERE k.platform = p.platform AND k.song_key = r.song_key) GROUP BY ALL),
    m AS (SELECT platform, arg_max(genre, struct_pack(n := n, g := genre)) AS guess, sum(n)::BIGINT AS train FROM t GROUP BY platform)
    SELECT r.platform, count(*) AS test, m.train, round(avg(CASE WHEN genre = guess THEN 1.0 ELSE 0 END), 6) AS accuracy FROM r JOIN m ON m.platform = r.platform GROUP BY r.platform, m.train""")
def left_out_platforms(spark: SparkSession, d: str) -> DataFrame:
    """Each platform predicted from all others without the songs it has itself (J-24). What is left to train on is counted as all less its own less
    the others' recordings of its songs, from aggregates: no row is copied for every platform."""
    r = recordings(spark, d, "platform", "song_key", "genre").where("platform is not null and song_key is not null").where(present("genre").isNotNull())
    per = r.groupBy("platform", "song_key", "genre").agg(F.count("*").alias("n"))
    keys = per.select(F.col("platform").alias("held"), "song_key").distinct()
    total = per.groupBy("genre").agg(F.sum("n").alias("n"))
    # rows that may not train the model of a held platform: all of its songs, on whatever platform
    barred = per.join(keys, "song_key").groupBy("held", "genre").agg(F.sum("n").alias("out"))
    t = keys.select("held").distinct().crossJoin(F.broadcast(total)).join(barred, ["held", "genre"], "left")
    t = t.select("held", "genre", (F.col("n") - F.coalesce("out", F.lit(0))).alias("n")).where("n > 0")
    m = t.groupBy("held").agg(F.max_by("genre", F.struct("n", "genre")).alias("guess"), F.sum("n").alias("train"))
    g = per.join(m, F.col("platform") == F.col("held")).groupBy("platform", "train")
    return g.agg(F.sum("n").alias("test"), F.round(F.sum(F.when(F.col("genre") == F.col("guess"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"))


@Q(f"""WITH p AS (SELECT item_id, region, duration_s AS dur, coalesce({sql_present('singer_id')}, {sql_present('channel_key')}, item_id) AS who, md5('role|' || item_id) AS prio FROM {REC} WHERE region IS NOT NULL AND duration_s BETWEEN 40 AND 600),
    home AS (SELECT region FROM p GROUP BY region ORDER BY count(*) DESC, region LIMIT 1),
    base AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY region ORDER BY prio, item_id) = 1), left1 AS (SELECT * FROM p WHERE item_id NOT IN (SELECT item_id FROM base)),
    w1 AS (SELECT * FROM left1 WHERE region IN (SELECT region FROM home) QUALIFY row_number() OVER (PARTITION BY who ORDER BY prio, item_id) = 1), target AS (SELECT * FROM w1 ORDER BY prio, item_id LIMIT 8),
    left2 AS (SELECT * FROM left1 WHERE item_id NOT IN (SELECT item_id FROM target)), c4 AS (SELECT * FROM left2 WHERE region NOT IN (SELECT region FROM home) QUALIFY row_number() OVER (PARTITION BY region ORDER BY prio, item_id) <= 4),
    w2 AS (SELECT * FROM c4 QUALIFY row_number() OVER (PARTITION BY who ORDER BY prio, item_id) = 1), comparison AS (SELECT * FROM w2 ORDER BY prio, item_id LIMIT 15),
    left3 AS (SELECT * FROM left2 WHERE item_id NOT IN (SELECT item_id FROM comparison)), calibration AS (SELECT * FROM left3 ORDER BY prio, item_id LIMIT 1),
    o AS (SELECT *, 'base' AS role, 30.0 AS len FROM base UNION ALL SELECT *, 'target', 20.0 FROM target UNION ALL SELECT *, 'comparison', 20.0 FROM comparison UNION ALL SELECT *, 'calibration', 30.0 FROM calibration)
    SELECT item_id, role, region, floor(greatest(0.25 * dur, 2.0)) AS start_s, least(floor(greatest(0.25 * dur, 2.0)) + len, dur) AS end_s FROM o""")
def role_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts by role, each taken from what the roles before it left (G-04): one a region, eight of the largest region by distinct people,
    fifteen of the others (at most four a region), one to calibrate; with where each begins and ends."""
    r = recordings(spark, d, "region", "duration_s", "singer_id", "channel_key").where("region is not null").where(F.col("duration_s").between(40, 600))
    p = r.select("item_id", "region", F.col("duration_s").alias("dur"), F.coalesce(present("singer_id"), present("channel_key"), "item_id").alias("who"), hash_order("role", "item_id").alias("prio"))
    order = [F.col("prio"), F.col("item_id")]
    top = p.groupBy("region").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "region").limit(1).select(F.col("region").alias("home"))
    base = cap_per_group(p, ["region"], order, 1)
    rest = p.join(base.select("item_id"), "item_id", "left_anti").join(F.broadcast(top), F.col("region") == F.col("home"), "left")
    one_each = lambda x, n: cap_per_group(x, ["who"], order, 1).orderBy(*order).limit(n)
    target = one_each(rest.where("home is not null"), 8)
    rest = rest.join(target.select("item_id"), "item_id", "left_anti")
    comparison = one_each(cap_per_group(rest.where("home is null"), ["region"], order, 4), 15)
    calibration = rest.join(comparison.select("item_id"), "item_id", "left_anti").orderBy(*order).limit(1)
    start = F.floor(F.greatest(0.25 * F.col("dur"), F.lit(2.0)))
    row = lambda x, role, n: x.select("item_id", F.lit(role).alias("role"), "region", start.alias("start_s"), F.least(start + n, "dur").alias("end_s"))
    return row(base, "base", 30.0).unionAll(row(target, "target", 20.0)).unionAll(row(comparison, "comparison", 20.0)).unionAll(row(calibration, "calibration", 30.0))


@Q(f"""WITH f AS (SELECT unnest(range(5)) AS held), r AS (SELECT item_id, region, fold FROM {REC} WHERE fold IS NOT NULL AND region IS NOT NULL)
    SELECT CAST(held AS INTEGER) AS held, region, item_id FROM r JOIN f ON fold <> held QUALIFY row_number() OVER (PARTITION BY held, region ORDER BY md5('shots|' || held || '|' || item_id), item_id) <= 4""")
def few_shots(spark: SparkSession, d: str) -> DataFrame:
    """Four rows a class for each held-out fold, drawn from the other folds (R-07); every fold draws anew."""
    r = recordings(spark, d, "region", "fold").where("fold is not null and region is not null")
    x = r.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("held <> fold")
    return cap_per_group(x, ["held", "region"], [hash_order("shots", "held", "item_id"), F.col("item_id")], 4).select("held", "region", "item_id")


@Q(f"""WITH a AS (SELECT unnest(['N1', 'N2', 'N3']) AS annotator), r AS (SELECT DISTINCT item_id FROM recordings WHERE core)
    SELECT annotator, item_id, row_number() OVER (PARTITION BY annotator ORDER BY md5(annotator || '|' || item_id), item_id) AS position FROM r, a""")
def annotator_orders(spark: SparkSession, d: str) -> DataFrame:
    """An order of its own for each annotator (R-09): the rows of all are numbered by hash over range partitions, then each annotator's from one."""
    r = recordings(spark, d, "core").where("core").select("item_id").distinct()
    x = r.withColumn("annotator", F.explode(F.array(*[F.lit(a) for a in ("N1", "N2", "N3")]))).withColumn("h", F.md5(F.concat_ws("|", "annotator", "item_id")))
    n = number_rows(x, ["annotator", "h", "item_id"], "n")
    first = n.groupBy("annotator").agg((F.min("n") - 1).alias("before"))
    return n.join(F.broadcast(first), "annotator").select("annotator", "item_id", (F.col("n") - F.col("before")).alias("position"))


@Q(f"""WITH g AS (SELECT region, count(*) AS pool, count(*) FILTER (WHERE core) AS true_items FROM {REC} WHERE region IS NOT NULL GROUP BY region), k AS (SELECT unnest([1, 10, 50]) AS k), x AS (SELECT *, unnest(range(k)) AS i FROM g, k WHERE pool >= k)
    SELECT region, CAST(k AS INTEGER) AS k, round(1 - product(greatest(pool - true_items - i, 0)::DOUBLE / (pool - i)), 6) AS chance FROM x GROUP BY region, k""")
def chance_recalls(spark: SparkSession, d: str) -> DataFrame:
    """The chance that k of a pool hold one of the true items (F-M10), as a product of k factors."""
    g = recordings(spark, d, "region", "core").where("region is not null").groupBy("region").agg(F.count("*").alias("pool"), F.count_if("core").alias("true_items"))
    x = g.withColumn("k", F.explode(F.array(F.lit(1), F.lit(10), F.lit(50)))).where("pool >= k")
    none = F.aggregate(F.sequence(F.lit(0), F.col("k") - 1), F.lit(1.0), lambda acc, i: acc * F.greatest(F.col("pool") - F.col("true_items") - i, F.lit(0)) / (F.col("pool") - i))
    return x.select("region", "k", F.round(1 - none, 6).alias("chance"))


@fitted_on("embeddings", "shots int, rows bigint, accuracy double")
def learning_curve(spark: SparkSession, d: str) -> DataFrame:
    """Held-out accuracy by the number of training rows a class (M-14, M-18): draws by hash, all held-out rows each time."""
    train, test = _split(spark, d)
    train, test = M.cut(train), M.cut(test)
    rows = []
    for n in (2, 8, 32):
        few = cap_per_group(train, ["label"], [hash_order("curve", "id"), F.col("id")], n)
        rows.append((n, few.count(), L.right_share(M._fit(M.cut(few)).transform(test))))
    return spark.createDataFrame(rows, "shots int, rows long, accuracy double")


@fitted_on("embeddings", "clade string, support double")
def clade_support(spark: SparkSession, d: str) -> DataFrame:
    """The clades of the class profiles and how many of a hundred resamples have them (R-13): resampling in Spark, trees of a few leaves on the driver."""
    p = L.resampled_profiles(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 100)
    return spark.createDataFrame(L.clade_support(p), "clade string, support double")


@fitted_on("embeddings", "test string, statistic double, p double")
def label_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Whether classes of one group lie nearer to each other than to the others (R-12): the contrast of distances within and between the groups,
    the rank correlation with the order of names, and their permutation shares."""
    rows = X.profile_distance(table(spark, d, "embeddings"), "label", "embedding").limit(2_001).collect()
    if len(rows) > 2_000:
        raise ValueError("permutations on the driver take at most 63 classes")
    names = sorted({r.unit_a for r in rows} | {r.unit_b for r in rows})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r.unit_a], at[r.unit_b]] = m[at[r.unit_b], at[r.unit_a]] = math.sqrt(max(r.d2, 0.0))
    order = np.abs(np.subtract.outer(np.arange(len(names)), np.arange(len(names)))).astype(float)
    out = [("contrast", *K.group_contrast(m, [i % 2 for i in range(len(names))])), ("mantel", *K.mantel(m, order))]
    return spark.createDataFrame([(n, float(a), float(b)) for n, a, b in out], "test string, statistic double, p double")


QUERIES, SQL = Q.queries, Q.sql
QUERIES |= {f.__name__: f for f in (title_clusters, strategy_accuracy, dual_view, transfer_accuracy, domain_weights, cluster_sweeps, learning_curve, clade_support, label_permutation)}
