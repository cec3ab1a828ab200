"""Scores, tests, samples, folds and review rows (survey groups A-31 to A-33, X, R, G, V)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from strophe.functions.columns import hash_order
from strophe.functions.text import number_present, present
from strophe.operators import quality as V, sampling as R, stats as X
from strophe.operators.components import connected
from strophe.operators.relational import cap_per_group
from strophe.plans.registry import REC, Registry, recordings, sql_present, table

Q = Registry()

LABELS_SQL = f"(SELECT item_id, genre AS y, CASE WHEN contains(title, '山歌') THEN '山歌' WHEN contains(title, '号子') THEN '号子' WHEN contains(title, '小调') THEN '小调' WHEN contains(title, '情歌') THEN '情歌' ELSE '民歌' END AS p FROM {REC} WHERE {sql_present('genre')} IS NOT NULL AND title IS NOT NULL)"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """A typed genre and a guess from the title."""
    t = F.col("title")
    guess = F.when(t.contains("山歌"), "山歌").when(t.contains("号子"), "号子").when(t.contains("小调"), "小调").when(t.contains("情歌"), "情歌").otherwise("民歌")
    return recordings(spark, d, "genre", "title").where(present("genre").isNotNull() & t.isNotNull()).select("item_id", F.col("genre").alias("y"), guess.alias("p"))


CLASSES_SQL = f"c AS (SELECT y, p, count(*) AS n FROM {LABELS_SQL} GROUP BY ALL), s AS (SELECT cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT y AS cls, CASE WHEN y = p THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN y <> p THEN n ELSE 0 END AS fn FROM c UNION ALL SELECT p, 0, CASE WHEN y <> p THEN n ELSE 0 END, 0 FROM c) GROUP BY cls)"


@Q(f"WITH {CLASSES_SQL} SELECT cls, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM s")
def class_scores(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of each class with guarded division (A-31, A-33)."""
    s = X.class_scores(X.confusion(labelled(spark, d), "y", "p"))
    return s.select("cls", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@Q(f"""WITH {CLASSES_SQL}, t AS (SELECT sum(n) AS n FROM c), a AS (SELECT avg(2 * tp / greatest(2 * tp + fp + fn, 1)) AS f, avg(tp / (tp + fn)) FILTER (WHERE tp + fn > 0) AS b, sum((tp + fn) * (tp + fp)) AS ch, sum(tp) AS same FROM s)
    SELECT CAST(n AS BIGINT) AS n, round(same / n, 6) AS accuracy, round(b, 6) AS balanced_accuracy, round(f, 6) AS macro_f1, round((same / n - ch / (n * n)) / (1 - ch / (n * n)), 6) AS kappa FROM a, t""")
def summary_scores(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1 and kappa (A-31)."""
    s = X.summary_scores(X.confusion(labelled(spark, d), "y", "p"))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "kappa")])


@Q(f"""WITH c AS (SELECT y, p, count(*) AS n FROM {LABELS_SQL} GROUP BY ALL), r AS (SELECT y, p, n / sum(n) OVER (PARTITION BY y) AS r FROM c)
    SELECT a.y AS a, a.p AS b, round((a.r + coalesce(b.r, 0)) / 2, 6) AS rate FROM r a LEFT JOIN r b ON b.y = a.p AND b.p = a.y WHERE a.y <> a.p""")
def confusion_rate(spark: SparkSession, d: str) -> DataFrame:
    """Row-normalised confusion, made symmetric (A-32)."""
    c = X.confusion(labelled(spark, d), "y", "p")
    r = c.withColumn("r", F.col("n") / F.sum("n").over(Window.partitionBy("y"))).select("y", "p", "r")
    t = r.select(F.col("p").alias("y"), F.col("y").alias("p"), F.col("r").alias("r2"))
    return r.join(t, ["y", "p"], "left").where("y <> p").select(F.col("y").alias("a"), F.col("p").alias("b"), F.round((F.col("r") + F.coalesce("r2", F.lit(0.0))) / 2, 6).alias("rate"))


@Q(f"""WITH x AS (SELECT {sql_present('genre')} AS a, {sql_present('song_genre')} AS b FROM {REC}), f AS (SELECT * FROM x WHERE a IS NOT NULL AND b IS NOT NULL), m AS (SELECT (SELECT count(*) FROM f) AS n, (SELECT count(*) FROM f WHERE a = b) AS same,
    (SELECT coalesce(sum(na * nb), 0) FROM (SELECT a, count(*) AS na FROM f GROUP BY a) p JOIN (SELECT b, count(*) AS nb FROM f GROUP BY b) q ON p.a = q.b) AS ch) SELECT n, round(same / n, 6) AS agree, round((same / n - ch / (n * n)) / nullif(1 - ch / (n * n), 0), 6) AS kappa FROM m""")
def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two labelings and what chance would give (V-03)."""
    r = recordings(spark, d, "genre", "song_genre").select(present("genre").alias("a"), present("song_genre").alias("b"))
    return V.agreement(r, "a", "b").select("n", F.round("agree", 6).alias("agree"), F.round("kappa", 6).alias("kappa"))


@Q(f"""WITH c AS (SELECT region AS y, province AS p, count(*) AS n FROM {REC} WHERE region IS NOT NULL AND {sql_present('province')} IS NOT NULL GROUP BY ALL), t AS (SELECT sum(n)::DOUBLE AS t, sum(n * (n - 1) / 2.0) AS ij, sum(n * ln(n)) AS hj FROM c),
    a AS (SELECT sum(m * (m - 1) / 2.0) AS ia, sum(m * ln(m)) AS ha FROM (SELECT sum(n)::DOUBLE AS m FROM c GROUP BY y)), b AS (SELECT sum(m * (m - 1) / 2.0) AS ib, sum(m * ln(m)) AS hb FROM (SELECT sum(n)::DOUBLE AS m FROM c GROUP BY p))
    SELECT round(2 * (ln(t) - ha / t + ln(t) - hb / t - (ln(t) - hj / t)) / (2 * ln(t) - ha / t - hb / t), 6) AS nmi, round((ij - ia * ib / (t * (t - 1) / 2)) / ((ia + ib) / 2 - ia * ib / (t * (t - 1) / 2)), 6) AS ari, round(ij / sqrt(ia * ib), 6) AS fowlkes_mallows FROM t, a, b""")
def partition_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Normalised mutual information, adjusted Rand and Fowlkes-Mallows of two partitions (X-06, X-07)."""
    r = recordings(spark, d, "region", "province").select("region", present("province").alias("province"))
    return X.partition_agreement(X.confusion(r, "region", "province")).select(*[F.round(c, 6).alias(c) for c in ("nmi", "ari", "fowlkes_mallows")])


@Q(f"""WITH x AS (SELECT region AS g, duration_s AS v FROM {REC} WHERE region IS NOT NULL AND NOT isnan(duration_s) AND duration_s > 0), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM x),
    s AS (SELECT sum(c)::DOUBLE AS n, count(*) AS k, sum(s * s / c) AS q FROM (SELECT g, sum(r) AS s, count(*) AS c FROM r GROUP BY g)), t AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM x GROUP BY v)),
    h AS (SELECT n, k, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (pow(n, 3) - n)) AS h FROM s, t) SELECT CAST(n AS BIGINT) AS n, k, round(h, 4) AS h, round(greatest(0, (h - k + 1) / (n - k)), 6) AS epsilon2 FROM h""")
def kruskal_by_region(spark: SparkSession, d: str) -> DataFrame:
    """Kruskal-Wallis over groups, with ties and effect size (X-01); ranks from a distributed running count."""
    r = recordings(spark, d, "region", "duration_s").where(~F.isnan("duration_s") & (F.col("duration_s") > 0))
    k = X.kruskal_wallis(r, "region", "duration_s")
    return k.select("n", "k", F.round("h", 4).alias("h"), F.round("epsilon2", 6).alias("epsilon2"))


@Q(f"""WITH c0 AS (SELECT region AS a, genre AS b, count(*) AS n FROM {REC} WHERE region IS NOT NULL AND {sql_present('genre')} IS NOT NULL GROUP BY ALL), c AS (SELECT * FROM c0 WHERE b IN (SELECT b FROM c0 GROUP BY b HAVING sum(n) >= 5)),
    t AS (SELECT sum(n)::DOUBLE AS t, count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM c), s AS (SELECT sum(n * n / (na * nb)) AS s FROM (SELECT n::DOUBLE AS n, sum(n) OVER (PARTITION BY a)::DOUBLE AS na, sum(n) OVER (PARTITION BY b)::DOUBLE AS nb FROM c))
    SELECT CAST(t AS BIGINT) AS n, round(t * (s - 1), 4) AS chi2, (r - 1) * (k - 1) AS dof, round(sqrt((s - 1) / (least(r, k) - 1)), 6) AS cramers_v FROM t, s""")
def chi_square_genres(spark: SparkSession, d: str) -> DataFrame:
    """Chi-square and Cramer's V of two columns, rare values left out (X-02)."""
    r = recordings(spark, d, "region", "genre").select("region", present("genre").alias("genre"))
    c = X.contingency(r, "region", "genre", 5)
    return c.select("n", F.round("chi2", 4).alias("chi2"), "dof", F.round("cramers_v", 6).alias("cramers_v"))


def chi_square_p(spark: SparkSession, d: str) -> DataFrame:
    """The test with its p value from the incomplete gamma function (X-02); compared with table values in the tests."""
    r = recordings(spark, d, "region", "genre").select("region", present("genre").alias("genre"))
    return X.with_p_value(X.contingency(r, "region", "genre", 5), "chi2", "dof")


@Q("""WITH p AS (SELECT l_suppkey AS test, round(exp(-count(*) / 100.0), 9) AS p FROM lineitem GROUP BY l_suppkey), r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS r, count(*) OVER () AS n FROM p)
    SELECT test, p, round(least(1, min(p * n / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r""")
def false_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Benjamini-Hochberg over a family of tests (X-03)."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("test")).agg(F.round(F.exp(-F.count("*") / 100.0), 9).alias("p"))
    return X.benjamini_hochberg(p, "p").select("test", "p", F.round("q", 9).alias("q"))


@Q("""WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS b FROM orders) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def spearman_orders(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's rank correlation (X-04)."""
    return X.spearman(table(spark, d, "orders"), "o_totalprice", "o_custkey").select("n", F.round("rho", 6).alias("rho"))


@Q("""WITH x AS (SELECT value AS v, event_type = 'error' AS a FROM events WHERE event_type IN ('error', 'click')), c AS (SELECT v, count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE NOT a) AS b FROM x GROUP BY v), t AS (SELECT sum(a) AS n_a, sum(b) AS n_b FROM c)
    SELECT CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(max(abs(ca / n_a - cb / n_b)), 6) AS d FROM (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM c WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)), t GROUP BY n_a, n_b""")
def ks_two_samples(spark: SparkSession, d: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic (X-05)."""
    e = table(spark, d, "events").where("event_type in ('error', 'click')")
    return X.kolmogorov_smirnov(e, F.col("event_type") == "error", "value").select("n_a", "n_b", F.round("d", 6).alias("d"))


@Q("""WITH f AS (SELECT label AS u, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT u, i, avg(x) AS m, var_samp(x) AS v, count(*) AS n FROM f GROUP BY ALL)
    SELECT a.u AS unit_a, b.u AS unit_b, round(sum(pow(a.m - b.m, 2) - a.v / a.n - b.v / b.n), 5) AS d2 FROM m a JOIN m b ON a.i = b.i AND a.u < b.u GROUP BY ALL""")
def profile_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of mean profiles less sampling noise (X-09, D17)."""
    return X.profile_distance(table(spark, d, "embeddings"), "label", "embedding").select("unit_a", "unit_b", F.round("d2", 5).alias("d2"))


@Q(f"SELECT item_id FROM {REC} ORDER BY md5('s1|' || item_id), item_id LIMIT 100")
def sampled_rows(spark: SparkSession, d: str) -> DataFrame:
    """A fixed sample in hash order (R-01, R-06, O-04)."""
    return R.sample(recordings(spark, d), 100, "s1", "item_id")


@Q(f"SELECT region, item_id FROM {REC} WHERE region IS NOT NULL QUALIFY row_number() OVER (PARTITION BY region ORDER BY md5('s2|' || item_id), item_id) <= 5")
def sampled_per_group(spark: SparkSession, d: str) -> DataFrame:
    """At most five of each group (R-02, R-07, R-09)."""
    return R.sample_per_group(recordings(spark, d, "region").where("region is not null"), ["region"], 5, "s2", "item_id").select("region", "item_id")


@Q(f"""WITH a AS (SELECT item_id, region, song_key FROM {REC} WHERE region IS NOT NULL AND song_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY song_key ORDER BY md5('s3|' || item_id), item_id) = 1)
    SELECT item_id, region, song_key FROM a QUALIFY row_number() OVER (PARTITION BY region ORDER BY md5('s3|' || item_id), item_id) <= 8""")
def shuffled_first(spark: SparkSession, d: str) -> DataFrame:
    """Shuffled, the first of each key, then some of each class (R-03)."""
    r = recordings(spark, d, "region", "song_key").where("region is not null and song_key is not null")
    one = R.sample_per_group(r, ["song_key"], 1, "s3", "item_id")
    return R.sample_per_group(one, ["region"], 8, "s3", "item_id").select("item_id", "region", "song_key")


@Q(f"""WITH q AS (SELECT item_id, song_key, region FROM {REC} WHERE song_key IS NOT NULL), pool AS (SELECT item_id, song_key FROM (SELECT item_id, song_key FROM {REC} WHERE song_key IS NOT NULL ORDER BY md5('pool|' || item_id), item_id LIMIT 60))
    SELECT q.item_id, p.item_id AS control FROM q JOIN pool p ON p.song_key <> q.song_key QUALIFY row_number() OVER (PARTITION BY q.item_id ORDER BY md5('s4|' || q.item_id || '|' || p.item_id), p.item_id) <= 2""")
def matched_controls(spark: SparkSession, d: str) -> DataFrame:
    """Two random partners of another song for each item, from a fixed pool of sixty (R-04, R-05): the pool travels with the rows as one list."""
    r = recordings(spark, d, "song_key").where("song_key is not null")
    pool = R.sample(r.select("item_id", "song_key"), 60, "pool", "item_id").agg(F.collect_list(F.struct("item_id", "song_key")).alias("pool"))
    q = r.crossJoin(F.broadcast(pool))
    others = F.transform(F.filter("pool", lambda p: p["song_key"] != F.col("song_key")), lambda p: F.struct(F.md5(F.concat_ws("|", F.lit("s4"), F.col("item_id"), p["item_id"])).alias("h"), p["item_id"].alias("control")))
    return q.select("item_id", F.explode(F.slice(F.array_sort(others), 1, 2)).alias("c")).select("item_id", "c.control")


@Q(f"""WITH x AS (SELECT item_id, region, duration_s AS s, row_number() OVER (PARTITION BY region ORDER BY duration_s DESC, item_id) AS n, count(*) OVER (PARTITION BY region) AS c FROM {REC} WHERE region IS NOT NULL AND NOT isnan(duration_s))
    SELECT item_id, region FROM x WHERE n <= greatest(3, round_even(0.05 * c, 0))""")
def top_fraction(spark: SparkSession, d: str) -> DataFrame:
    """The best twentieth of each class, at least three (R-08)."""
    r = recordings(spark, d, "region", "duration_s").where("region is not null").where(number_present("duration_s").isNotNull())
    return R.top_fraction(r, "region", F.col("duration_s"), 0.05, 3, "item_id").select("item_id", "region")


def _uniform_sql(expr: str) -> str:
    return f"(('0x' || left(md5({expr}), 8))::BIGINT / 4294967296.0)"


_EDGES = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]


@Q(f"""WITH l AS (SELECT item_id, CAST(y = p AS INTEGER) AS ok FROM {LABELS_SQL}), b AS (SELECT unnest(range(200)) AS b), u AS (SELECT b, ok, ('0x' || substr(md5('boot|' || (b // 4) || '|' || item_id), b % 4 * 8 + 1, 8))::BIGINT / 4294967296.0 AS u FROM l, b), w AS (SELECT b, ok, {' + '.join(f'CAST(u >= {e!r} AS INTEGER)' for e in _EDGES)} AS w FROM u), s AS (SELECT b, sum(w * ok) / sum(w)::DOUBLE AS acc FROM w GROUP BY b)
    SELECT count(*) AS replicates, round(quantile_cont(acc, 0.025), 6) AS lo, round(avg(acc), 6) AS mean, round(quantile_cont(acc, 0.975), 6) AS hi FROM s""")
def bootstrap_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap interval of an accuracy with Poisson weights from hashes (R-10): every row draws its weights where it is, and
    replicates are combined before the shuffle."""
    x = labelled(spark, d).select("item_id", (F.col("y") == F.col("p")).cast("int").alias("ok"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("q"))
    # a digest has bits for four numbers
    x = x.withColumn("h", F.md5(F.concat_ws("|", F.lit("boot"), F.col("q").cast("string"), "item_id")))
    parts = F.array(*[F.struct((F.col("q") * 4 + j).alias("b"), (F.conv(F.substring("h", j * 8 + 1, 8), 16, 10).cast("double") / 4294967296.0).alias("u")) for j in range(4)])
    x = x.select("ok", F.explode(parts).alias("z")).select("ok", "z.b", "z.u")
    w = R.poisson_weights(F.col("u"))
    s = x.withColumn("w", w).groupBy("b").agg((F.sum(F.col("w") * F.col("ok")) / F.sum("w")).alias("acc"))
    return s.agg(F.count("*").alias("replicates"), F.round(F.percentile("acc", 0.025), 6).alias("lo"), F.round(F.avg("acc"), 6).alias("mean"), F.round(F.percentile("acc", 0.975), 6).alias("hi"))


@Q(f"""WITH l AS (SELECT item_id, CAST(y = p AS INTEGER) AS a, CAST(y = '民歌' AS INTEGER) AS b FROM {LABELS_SQL}), o AS (SELECT sum(a - b) AS d FROM l), r AS (SELECT unnest(range(200)) AS r), n AS (SELECT r, sum(CASE WHEN {_uniform_sql("'perm|' || r || '|' || item_id")} < 0.5 THEN a - b ELSE b - a END) AS d FROM l, r GROUP BY r)
    SELECT CAST(any_value(o.d) AS BIGINT) AS observed, round((count(*) FILTER (WHERE abs(n.d) >= abs(o.d)) + 1) / (count(*) + 1), 6) AS p FROM n, o""")
def paired_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Paired permutation test of two predictors by hash bits (R-11)."""
    l = labelled(spark, d).select("item_id", ((F.col("y") == F.col("p")).cast("int") - (F.col("y") == "民歌").cast("int")).alias("d"))  # noqa: E741
    o = l.agg(F.sum("d").alias("o"))
    x = l.where("d <> 0").select("item_id", "d", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("r"))
    n = x.groupBy("r").agg(F.sum(F.when(R.hash_uniform("perm", "r", "item_id") < 0.5, F.col("d")).otherwise(-F.col("d"))).alias("s")).crossJoin(F.broadcast(o))
    return n.agg(F.first("o").alias("observed"), F.round((F.count_if(F.abs("s") >= F.abs("o")) + 1) / (F.count("*") + 1), 6).alias("p"))


def group_folds(spark: SparkSession, d: str) -> DataFrame:
    """Stratified folds that never split a channel (G-02); invariants are tested."""
    r = recordings(spark, d, "channel_key", "region").where(present("channel_key").isNotNull())
    f = R.group_folds(r, "channel_key", "region", 5)
    return r.join(f, "channel_key").groupBy("fold").agg(F.count("*").alias("recordings"), F.count_distinct("channel_key").alias("channels"), F.count_distinct("region").alias("regions"))


@Q(f"""WITH RECURSIVE p AS (SELECT DISTINCT region, struct_pack(known := provenance_tier IS NOT NULL, tier := coalesce(provenance_tier, ''), h := md5('rep|' || item_id), i := item_id) AS o, song_key, channel_key, singer_id
        FROM {REC} WHERE region IS NOT NULL AND song_key IS NOT NULL AND duration_s BETWEEN 60 AND 420),
    s AS (SELECT region, 0 AS pick, CAST(NULL AS VARCHAR) AS item_id, NULL::STRUCT(known BOOLEAN, tier VARCHAR, h VARCHAR, i VARCHAR) AS o, []::VARCHAR[] AS songs, []::VARCHAR[] AS channels, []::VARCHAR[] AS singers FROM (SELECT DISTINCT region FROM p)
      UNION ALL SELECT region, pick + 1, b.o.i, b.o, list_append(songs, b.s), CASE WHEN b.c IS NULL THEN channels ELSE list_append(channels, b.c) END, CASE WHEN b.g IS NULL THEN singers ELSE list_append(singers, b.g) END
        FROM (SELECT s.region, s.pick, s.songs, s.channels, s.singers, arg_min(struct_pack(o := p.o, s := p.song_key, c := p.channel_key, g := p.singer_id), p.o) AS b FROM s JOIN p ON p.region = s.region
              WHERE s.pick < 8 AND (s.o IS NULL OR p.o > s.o) AND NOT list_contains(songs, p.song_key) AND NOT coalesce(list_contains(channels, p.channel_key), false) AND NOT coalesce(list_contains(singers, p.singer_id), false) GROUP BY ALL))
    SELECT region, item_id, CAST(pick AS INTEGER) AS pick FROM s WHERE pick > 0""")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    """Per region the best recordings of distinct song, channel and singer (G-03, G-04); the invariant is tested."""
    r = recordings(spark, d, "region", "song_key", "channel_key", "singer_id", "provenance_tier", "duration_s")
    r = r.where("region is not null and song_key is not null").where(F.col("duration_s").between(60, 420))
    return R.greedy_distinct(r, "region", [F.col("provenance_tier"), hash_order("rep", "item_id")], 8, ["song_key", "channel_key", "singer_id"], "item_id")


@Q(f"""WITH x AS (SELECT item_id, region, geo_level AS stratum, row_number() OVER (PARTITION BY geo_level, region ORDER BY md5('gold|' || item_id), item_id) AS n FROM {REC} WHERE region IS NOT NULL AND geo_level IS NOT NULL)
    SELECT item_id, region, stratum FROM x QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY n, region) <= 40""")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    """A quota per stratum, taken in turns across regions (G-05)."""
    r = recordings(spark, d, "region", "geo_level").where("region is not null and geo_level is not null").withColumnRenamed("geo_level", "stratum")
    # no stratum takes more than its quota from one region, so ranks beyond it are dropped before the second pass
    x = r.withColumn("n", F.row_number().over(Window.partitionBy("stratum", "region").orderBy(hash_order("gold", "item_id"), "item_id"))).where("n <= 40")
    return cap_per_group(x, ["stratum"], [F.col("n"), F.col("region")], 40).select("item_id", "region", "stratum")


@Q("""WITH RECURSIVE h AS (SELECT adcode, name, name AS path, 0 AS depth, province, CAST('' AS VARCHAR) AS prefecture FROM gazetteer WHERE level = 'province'
    UNION ALL SELECT g.adcode, g.name, h.path || '/' || g.name, h.depth + 1, g.province, CASE WHEN g.level = 'prefecture' THEN g.name ELSE g.prefecture END FROM gazetteer g JOIN h ON (h.depth = 0 AND g.level = 'prefecture' AND g.province = h.name) OR (h.depth = 1 AND g.level = 'county' AND g.province = h.province AND g.prefecture = h.name))
    SELECT adcode, path, CAST(depth AS INTEGER) AS depth FROM h""")
def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """The path of every place from its province down (G-10): two equi-joins for a fixed depth."""
    g = table(spark, d, "gazetteer")
    p0 = g.where("level = 'province'").select("adcode", F.col("name").alias("path"), F.lit(0).alias("depth"), F.col("name").alias("province"))
    p1 = g.where("level = 'prefecture'").join(p0.select("province", F.col("path").alias("up")), "province").select("adcode", F.concat_ws("/", "up", "name").alias("path"), F.lit(1).alias("depth"), "province", F.col("name").alias("prefecture"))
    p2 = g.where("level = 'county'").join(p1.select("province", "prefecture", F.col("path").alias("up")), ["province", "prefecture"]).select("adcode", F.concat_ws("/", "up", "name").alias("path"), F.lit(2).alias("depth"))
    return p0.select("adcode", "path", "depth").unionAll(p1.select("adcode", "path", "depth")).unionAll(p2)


def _spread_sql(rounds: int) -> str:
    """The smallest label of each node's neighbourhood, handed on for a number of rounds; the last two must be equal, or there is no result."""
    step = "l{1} AS (SELECT n, min(root) AS root FROM (SELECT n, root FROM l{0} UNION ALL SELECT u.b, l{0}.root FROM l{0} JOIN u ON u.a = l{0}.n) GROUP BY n)"
    return ", ".join(step.format(i, i + 1) for i in range(rounds))


@Q(f"""WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), l0 AS (SELECT DISTINCT a AS n, a AS root FROM u), {_spread_sql(9)}
    SELECT l9.n AS node, l9.root FROM l9 WHERE (SELECT count(*) FROM l8 JOIN l9 USING (n) WHERE l8.root <> l9.root) = 0""")
def connected_groups(spark: SparkSession, d: str) -> DataFrame:
    """Connected components over the edges of all lines (G-01, D16); also compared with union-find in the tests."""
    e = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"))
    return connected(e, "a", "b").select("node", "root")


VOCABULARY = {"geo_level": ["site", "county", "prefecture", "province"], "provenance_tier": ["A", "A1", "A2", "B", "C"], "song_label_confidence": ["high", "medium", "low"]}


@Q(" UNION ALL ".join([f"SELECT item_id, '{c} not in vocabulary' AS reason FROM {REC} WHERE {sql_present(c)} IS NOT NULL AND {c} NOT IN ({', '.join(repr(v) for v in vs)})" for c, vs in VOCABULARY.items()]
    + [f"SELECT item_id, 'no duration' FROM {REC} WHERE duration_s IS NULL OR isnan(duration_s) OR duration_s <= 0", f"SELECT item_id, 'composed without composer' FROM {REC} WHERE dating_flag = 'composed' AND {sql_present('composer')} IS NULL",
       f"SELECT item_id, 'position out of range' FROM {REC} WHERE abs(lon) > 180 OR abs(lat) > 90 OR (lon = 0 AND lat = 0)"]))
def review_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows to look at, one for each broken rule, from one scan (V-01, V-02, V-08, V-10). NaN is beyond any range in SQL's order."""
    r = recordings(spark, d, *VOCABULARY, "duration_s", "dating_flag", "composer", "lon", "lat")
    lon, lat = F.col("lon"), F.col("lat")
    rules = V.vocabulary_rules(VOCABULARY) + [
        ("no duration", number_present("duration_s").isNull() | (F.col("duration_s") <= 0)),
        ("composed without composer", (F.col("dating_flag") == "composed") & present("composer").isNull()),
        ("position out of range", (F.abs(lon) > 180) | (F.abs(lat) > 90) | ((lon == 0) & (lat == 0))),
    ]
    return V.review(r, "item_id", rules)


@Q("""SELECT * FROM (SELECT DISTINCT item_id, 'missing' AS "where" FROM link_status WHERE item_id IS NOT NULL AND item_id NOT IN (SELECT item_id FROM recordings WHERE item_id IS NOT NULL) UNION ALL SELECT DISTINCT item_id, 'extra' FROM recordings WHERE item_id IS NOT NULL AND item_id NOT IN (SELECT item_id FROM link_status WHERE item_id IS NOT NULL))""")
def key_differences(spark: SparkSession, d: str) -> DataFrame:
    """Keys missing on either side (V-05, V-06)."""
    return V.key_differences(table(spark, d, "link_status").where("item_id is not null"), table(spark, d, "recordings").where("item_id is not null"), "item_id")


@Q(f"SELECT province, count(DISTINCT region) AS n FROM {REC} WHERE {sql_present('province')} IS NOT NULL GROUP BY province HAVING count(DISTINCT region) > 1")
def dependency_violations(spark: SparkSession, d: str) -> DataFrame:
    """Provinces that go with several regions (V-07)."""
    return V.functional_dependency(recordings(spark, d, "province", "region").withColumn("province", present("province")), "province", "region")


PROFILED = ["platform", "title", "round", "fold", "core", "region"]
_KINDS = {"round": "int", "fold": "int", "core": "boolean"}


@Q(" UNION ALL ".join(f"""SELECT '{c}' AS "column", '{_KINDS.get(c, "string")}' AS type, count(*) AS rows, count({v}) AS filled, count(DISTINCT {v}) AS "distinct", CAST(min({v}) AS VARCHAR) AS least, CAST(max({v}) AS VARCHAR) AS most FROM {REC}""" for c in PROFILED for v in [c if c in _KINDS else sql_present(c)]))
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per column: filled cells, distinct values, extremes, from one aggregation (V-11)."""
    return V.profile(recordings(spark, d, *PROFILED), PROFILED)


@Q(f"""SELECT region, count(*) AS n, count(*) FILTER (WHERE duration_s BETWEEN 40 AND 600 AND NOT isnan(duration_s)) AS in_range, count(DISTINCT channel_key) AS channels, count(*) - count(DISTINCT song_key) AS repeated_songs, count(*) FILTER (WHERE {sql_present('url')} IS NULL) AS no_url,
    max(per_channel) AS largest_channel FROM (SELECT *, CASE WHEN channel_key IS NOT NULL THEN count(*) OVER (PARTITION BY region, channel_key) END AS per_channel FROM {REC}) GROUP BY region""")
def audit_by_region(spark: SparkSession, d: str) -> DataFrame:
    """Hard rules counted per region (V-04), in two levels of aggregation instead of a window over channels."""
    r = recordings(spark, d, "region", "channel_key", "song_key", "duration_s", "url")
    g = r.groupBy("region").agg(F.count("*").alias("n"), F.count_if(F.col("duration_s").between(40, 600) & ~F.isnan("duration_s")).alias("in_range"), F.count_distinct("channel_key").alias("channels"), (F.count("*") - F.count_distinct("song_key")).alias("repeated_songs"), F.count_if(present("url").isNull()).alias("no_url"))
    c = r.where("channel_key is not null").groupBy("region", "channel_key").agg(F.count("*").alias("c")).groupBy("region").agg(F.max("c").alias("largest_channel")).withColumnRenamed("region", "r2")
    return g.join(c, g["region"].eqNullSafe(c["r2"]), "left").drop("r2")


QUERIES, SQL = Q.queries, Q.sql
QUERIES |= {"group_folds": group_folds, "chi_square_p": chi_square_p}
