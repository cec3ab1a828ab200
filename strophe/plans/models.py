"""Kernels, models and similarity joins (survey groups M, E-07, J-11, J-20, N-08 to N-12)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from strophe.functions.text import present
from strophe.operators import kernels as K, ml as M
from strophe.operators.similarity import cosine_pairs, fuzzy_pairs, unit_vectors
from strophe.operators.vectors import exact_neighbours
from strophe.plans.registry import REC, Registry, fitted_on, recordings, sql_present, table
from strophe.plans.sequences import NOTES_SQL, W, notes

Q = Registry()


def fuzzy_titles(spark: SparkSession, d: str) -> DataFrame:
    """Song keys and score keys of an indel ratio of at least 80 (J-11, F-S20); compared with brute force in the tests."""
    r = recordings(spark, d, "song_key").where("song_key is not null and not contains(song_key, '#')")
    s = table(spark, d, "scores").where("song_key is not null").withColumnRenamed("song_key", "score_key")
    return fuzzy_pairs(r, s, "song_key", "score_key")


_TERMS = f"t AS (SELECT DISTINCT song_name AS s, unnest(list_transform(range(1, length(song_name) - 1), lambda i: substr(song_name, i, 3))) AS g, unnest(range(1, length(song_name) - 1)) AS i FROM {REC} WHERE {sql_present('song_name')} IS NOT NULL AND length(song_name) >= 3)"
_WEIGHTS = _TERMS + """, tf AS (SELECT s, g, count(*) AS tf FROM t GROUP BY s, g), df AS (SELECT g, count(*) AS df FROM tf GROUP BY g), n AS (SELECT count(DISTINCT s) AS n FROM tf),
    w AS (SELECT s, tf.g, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN df ON df.g = tf.g, n), u AS (SELECT s, g, w / sqrt(sum(w * w) OVER (PARTITION BY s)) AS w FROM w)"""


def _name_terms(spark: SparkSession, d: str) -> DataFrame:
    r = recordings(spark, d, "song_name").where(present("song_name").isNotNull()).where(F.length("song_name") >= 3).select(F.col("song_name").alias("s")).distinct()
    return r.select("s", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 2), lambda i: F.substring("s", i, F.lit(3)))).alias("g"))


@Q(f"WITH {_WEIGHTS} SELECT a.s AS a, b.s AS b, round(sum(a.w * b.w), 6) AS cosine FROM u a JOIN u b ON a.g = b.g AND a.s < b.s GROUP BY a.s, b.s HAVING round(sum(a.w * b.w), 6) >= 0.7")
def near_duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct names whose weighted trigrams have a cosine of at least 0.7 (E-07, M-02): exact, by prefix terms."""
    p = cosine_pairs(unit_vectors(_name_terms(spark, d), "s", "g"), "s", "g", 0.6999999)
    return p.select("a", "b", F.round("cosine", 6).alias("cosine")).where("cosine >= 0.7")


@Q(f"WITH {_WEIGHTS} SELECT s AS name, g AS term, round(w, 6) AS w FROM u QUALIFY row_number() OVER (PARTITION BY s ORDER BY round(w, 9) DESC, g) <= 3")
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    """The three weightiest terms of each name: sublinear counts, smoothed idf, unit length (M-01, D11)."""
    u = unit_vectors(_name_terms(spark, d), "s", "g")
    n = F.row_number().over(Window.partitionBy("s").orderBy(F.desc(F.round("w", 9)), "g"))
    return u.withColumn("n", n).where("n <= 3").select(F.col("s").alias("name"), F.col("g").alias("term"), F.round("w", 6).alias("w"))


def note_f1(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of notes matched one to one within tolerances (J-20); compared with brute force in the tests."""
    n = notes(spark, d).select("item", (F.col("onset") / 3600).alias("onset"), "pitch", (F.col("event_id") % 5 != 0).alias("ref"), (F.col("event_id") % 3 != 0).alias("est"))
    return matched_notes(n, 1.0, 0.5)


def matched_notes(n: DataFrame, onset: float, pitch: float) -> DataFrame:
    """``(item, precision, recall, f1)`` from (item, onset, pitch, ref, est): a note is in the reference, the estimate, or both.

    Notes that can match lie in one run of onsets no farther apart than the tolerance. Rows stream through in order, and what is held and
    matched at once is a run, not an item.
    """

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run: list[tuple] = []
        counts: dict = {}

        def close() -> None:
            if not run:
                return
            ref, est = [(o, p) for _, o, p, r, _ in run if r], [(o, p) for _, o, p, _, e in run if e]
            edges = {i: [j for j, (x, q) in enumerate(est) if abs(x - o) <= onset and abs(q - p) <= pitch] for i, (o, p) in enumerate(ref)}
            c = counts.setdefault(run[0][0], [0, 0, 0])
            for k, v in enumerate((len(ref), len(est), len(K.match_one_to_one(edges)) if ref and est else 0)):
                c[k] += v
            run.clear()

        for b in batches:
            for row in zip(b["item"], b["onset"], b["pitch"], b["ref"], b["est"]):
                if run and (row[0] != run[-1][0] or row[1] - run[-1][1] > onset):
                    close()
                run.append(row)
            done, counts = counts, {}
            yield pd.DataFrame([(i, *c) for i, c in done.items()], columns=["item", "r", "e", "m"])
        close()
        yield pd.DataFrame([(i, *c) for i, c in counts.items()], columns=["item", "r", "e", "m"])

    kind = n.schema["item"].dataType.simpleString()
    ordered = n.select("item", F.col("onset").cast("double").alias("onset"), F.col("pitch").cast("double").alias("pitch"), "ref", "est").repartition("item").sortWithinPartitions("item", "onset")
    g = ordered.mapInPandas(match, f"item {kind}, r long, e long, m long").groupBy("item").agg(F.sum("r").alias("r"), F.sum("e").alias("e"), F.sum("m").alias("m"))
    p, r = F.col("m") / F.greatest("e", F.lit(1)), F.col("m") / F.greatest("r", F.lit(1))
    return g.select("item", p.alias("precision"), r.alias("recall"), F.when(F.col("m") > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).groupBy("item").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "pitch"))), lambda x: x["pitch"]).alias("p"))


def melodic_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Local alignment over transpositions, and agreement after global alignment and after one in which the second lies inside
    the first, of neighbouring items (N-09, N-10, N-11), over whole sequences; only the agreements have a limit, of 400 notes."""
    s = _sequences(spark, d)
    pair = s.join(s.select((F.col("item") - 1).alias("item"), F.col("item").alias("other"), F.col("p").alias("q")), "item")

    def align(batches):
        for b in batches:
            yield pd.DataFrame({"item": b["item"], "other": b["other"], "local": [K.align_local(x, y) for x, y in zip(b["p"], b["q"])], "agreement": [K.agreement(x, y) for x, y in zip(b["p"], b["q"])], "inside": [K.agreement(x, y, inside=True) for x, y in zip(b["p"], b["q"])]}).astype({"local": float, "agreement": float, "inside": float})

    return pair.mapInPandas(align, "item long, other long, local double, agreement double, inside double")


@Q(f"""WITH RECURSIVE {NOTES_SQL}, x AS (SELECT item, r AS run, onset / 3600 + r * 0.01 AS s, (onset + dur) / 3600 AS e, pitch FROM n, (SELECT unnest([0, 1, 2]) AS r) WHERE (event_id + r) % 4 <> 0),
    pool AS (SELECT *, row_number() OVER (PARTITION BY item, pitch ORDER BY s, run, e) AS i FROM x), k AS (SELECT item, count(DISTINCT run) // 2 + 1 AS need FROM x GROUP BY item),
    c AS (SELECT item, pitch, i, 1 AS c, s AS first, [run] AS runs FROM pool WHERE i = 1
      UNION ALL SELECT p.item, p.pitch, p.i, CASE WHEN p.s - first > 0.05 OR list_contains(runs, p.run) THEN c + 1 ELSE c END, CASE WHEN p.s - first > 0.05 OR list_contains(runs, p.run) THEN p.s ELSE first END,
        CASE WHEN p.s - first > 0.05 OR list_contains(runs, p.run) THEN [p.run] ELSE list_append(runs, p.run) END FROM c JOIN pool p ON p.item = c.item AND p.pitch = c.pitch AND p.i = c.i + 1),
    g AS (SELECT c.item, c.pitch, c.c, median(p.s) AS s, median(p.e) AS e, count(*) AS n FROM c JOIN pool p ON p.item = c.item AND p.pitch = c.pitch AND p.i = c.i GROUP BY ALL)
    SELECT g.item, round(s, 6) AS start, round(least(e, coalesce(lead(s) OVER (PARTITION BY g.item ORDER BY s, e, pitch), e)), 6) AS "end", CAST(pitch AS INTEGER) AS pitch FROM g JOIN k ON k.item = g.item WHERE n >= need""")
def voted_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes that most of three noisy runs agree on (N-12)."""
    n = notes(spark, d).withColumn("run", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("(event_id + run) % 4 <> 0")
    n = n.select("item", "run", (F.col("onset") / 3600 + F.col("run") * 0.01).alias("s"), ((F.col("onset") + F.col("dur")) / 3600).alias("e"), "pitch")

    def vote(g: pd.DataFrame) -> pd.DataFrame:
        runs = [list(zip(x["s"], x["e"], x["pitch"])) for _, x in g.groupby("run")]
        v = K.vote(runs)
        return pd.DataFrame({"item": [g["item"].iloc[0]] * len(v), "start": [x[0] for x in v], "end": [x[1] for x in v], "pitch": [int(x[2]) for x in v]}).astype({"item": "int64", "start": float, "end": float, "pitch": "int32"})

    v = n.groupBy("item").applyInPandas(vote, "item long, start double, end double, pitch int")
    return v.select("item", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "pitch")


LM_SQL = f"""WITH {NOTES_SQL}, l AS (SELECT item, item % 3 AS cls, item % 5 = 0 AS held, pos, event_type AS t0, lag(event_type, 1) OVER w AS t1, lag(event_type, 2) OVER w AS t2 FROM n WINDOW w AS (PARTITION BY item ORDER BY pos)),
    v AS (SELECT count(DISTINCT t0) AS v FROM l WHERE NOT held), c0 AS (SELECT cls, t0, count(*) AS c FROM l WHERE NOT held GROUP BY ALL), s0 AS (SELECT cls, sum(c)::DOUBLE AS tot, count(*) AS types FROM c0 GROUP BY cls),
    c1 AS (SELECT cls, t1, t0, count(*) AS c FROM l WHERE NOT held AND t1 IS NOT NULL GROUP BY ALL), s1 AS (SELECT cls, t1, sum(c)::DOUBLE AS tot, count(*) AS types FROM c1 GROUP BY cls, t1),
    c2 AS (SELECT cls, t2, t1, t0, count(*) AS c FROM l WHERE NOT held AND t2 IS NOT NULL GROUP BY ALL), s2 AS (SELECT cls, t2, t1, sum(c)::DOUBLE AS tot, count(*) AS types FROM c2 GROUP BY cls, t2, t1),
    p AS (SELECT l.item, s0.cls, 1.0 / (v + 1) AS b, s0.tot AS tot0, s0.types AS ty0, coalesce(c0.c, 0) AS n0, s1.tot AS tot1, s1.types AS ty1, coalesce(c1.c, 0) AS n1, s2.tot AS tot2, s2.types AS ty2, coalesce(c2.c, 0) AS n2
      FROM l CROSS JOIN v CROSS JOIN s0 LEFT JOIN c0 ON c0.cls = s0.cls AND c0.t0 = l.t0 LEFT JOIN s1 ON s1.cls = s0.cls AND s1.t1 = l.t1 LEFT JOIN c1 ON c1.cls = s0.cls AND c1.t1 = l.t1 AND c1.t0 = l.t0
      LEFT JOIN s2 ON s2.cls = s0.cls AND s2.t2 = l.t2 AND s2.t1 = l.t1 LEFT JOIN c2 ON c2.cls = s0.cls AND c2.t2 = l.t2 AND c2.t1 = l.t1 AND c2.t0 = l.t0 WHERE l.held),
    q0 AS (SELECT *, tot0 / (tot0 + 2.0 * ty0) * n0 / tot0 + (1 - tot0 / (tot0 + 2.0 * ty0)) * b AS p0 FROM p), q1 AS (SELECT *, CASE WHEN tot1 IS NULL THEN p0 ELSE tot1 / (tot1 + 2.0 * ty1) * n1 / tot1 + (1 - tot1 / (tot1 + 2.0 * ty1)) * p0 END AS p1 FROM q0),
    q2 AS (SELECT *, CASE WHEN tot2 IS NULL THEN p1 ELSE tot2 / (tot2 + 2.0 * ty2) * n2 / tot2 + (1 - tot2 / (tot2 + 2.0 * ty2)) * p1 END AS p2 FROM q1), s AS (SELECT item, cls, avg(ln(p2)) AS score FROM q2 GROUP BY item, cls)
    SELECT item, cls AS guess, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY item ORDER BY round(score, 9) DESC, cls) = 1"""


@Q(LM_SQL)
def language_model_classes(spark: SparkSession, d: str) -> DataFrame:
    """Back-off n-gram models by class, and the class of highest mean log probability of each held-out item (N-08)."""
    w = W()
    n = notes(spark, d).select("item", (F.col("item") % 3).alias("cls"), (F.col("item") % 5 == 0).alias("held"), F.col("event_type").alias("t0"), F.lag("event_type", 1).over(w).alias("t1"), F.lag("event_type", 2).over(w).alias("t2"))
    s = M.back_off_scores(n.where("not held"), n.where("held"), "item", "cls", ["t0", "t1", "t2"], 2.0)
    b = s.groupBy("item").agg(F.max_by(F.struct("cls", "score"), F.struct(F.round("score", 9), -F.col("cls"))).alias("b"))
    return b.select("item", F.col("b.cls").alias("guess"), F.round("b.score", 6).alias("score"))


KNN = """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), nrm AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS m FROM embeddings),
    s AS (SELECT a.vec_id AS q, a.label AS y, b.vec_id AS b, b.label AS l, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (a.m * b.m) AS c FROM nrm a, nrm b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(c, 9) DESC, b) <= 10), p AS (SELECT label, count(*) / (SELECT count(*) FROM embeddings)::DOUBLE AS prior FROM embeddings GROUP BY label),
    v AS (SELECT q, any_value(y) AS y, l, sum(1 / (1 - c + 1e-3)) / any_value(prior) AS v FROM k JOIN p ON p.label = k.l GROUP BY q, l)
    SELECT q AS query, y AS truth, l AS guess FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(v, 6) DESC, l) = 1"""


@Q(KNN)
def knn_vote(spark: SparkSession, d: str) -> DataFrame:
    """Distance-weighted, prior-corrected vote of the ten nearest (O-06, M-04)."""
    e = table(spark, d, "embeddings")
    n = exact_neighbours(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 10)
    total = e.agg(F.count("*").alias("t"))
    prior = e.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("c")).crossJoin(F.broadcast(total)).select("l", (F.col("c") / F.col("t")).alias("prior"))
    lab = e.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("l"))
    v = n.join(lab, "neighbour").join(prior, "l").groupBy("query", "l").agg((F.sum(1 / (1 - F.col("cosine") + 1e-3)) / F.first("prior")).alias("v"))
    b = v.groupBy("query").agg(F.max_by("l", F.struct(F.round("v", 6), -F.col("l"))).alias("guess"))
    return b.join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("truth")), "query").select("query", "truth", "guess")


@Q("""WITH f AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS cls FROM embeddings), p AS (SELECT vec_id, label, cls, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM f), g AS (SELECT cls, avg(ln(p)) AS m FROM p GROUP BY cls)
    SELECT p.vec_id, CAST(p.cls AS INTEGER) AS guess, round(ln(p.p) - g.m, 5) AS logit FROM p JOIN g ON g.cls = p.cls QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY round(ln(p.p) - g.m, 8) DESC, p.cls) = 1""")
def centred_logits(spark: SparkSession, d: str) -> DataFrame:
    """Log probabilities less their mean by class, then the best class (M-09)."""
    p = M.softmax_long(table(spark, d, "embeddings"), "vec_id", F.col("embedding"))
    g = p.groupBy("cls").agg(F.avg(F.ln("p")).alias("m"))
    x = p.join(F.broadcast(g), "cls").withColumn("logit", F.ln("p") - F.col("m"))
    b = x.groupBy("vec_id").agg(F.max_by(F.struct("cls", "logit"), F.struct(F.round("logit", 8), -F.col("cls"))).alias("b"))
    return b.select("vec_id", F.col("b.cls").alias("guess"), F.round("b.logit", 5).alias("logit"))


_EM = "f AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS cls FROM embeddings), p AS (SELECT vec_id, cls, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM f), q0 AS (SELECT cls, 1.0::DOUBLE / 64 AS q FROM (SELECT DISTINCT cls FROM p))"
for _i in range(1, 4):
    _EM += f", r{_i} AS (SELECT vec_id, p.cls, p * q / sum(p * q) OVER (PARTITION BY vec_id) AS r FROM p JOIN q{_i - 1} ON q{_i - 1}.cls = p.cls), q{_i} AS (SELECT cls, avg(r) AS q FROM r{_i} GROUP BY cls)"


@Q(f"WITH {_EM} SELECT CAST(cls AS INTEGER) AS cls, round(q, 6) AS prior FROM q3")
def prior_by_em(spark: SparkSession, d: str) -> DataFrame:
    """Class priors of unlabelled data by three rounds of expectation and maximisation (M-09)."""
    p = M.softmax_long(table(spark, d, "embeddings"), "vec_id", F.col("embedding"))
    return M.em_priors(p, "vec_id", 64, 3).select("cls", F.round("prior", 6).alias("prior"))


@Q("""WITH a AS (SELECT vec_id, label, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS p1, list_position(embedding[11:20], list_max(embedding[11:20])) - 1 AS p2 FROM embeddings), m AS (SELECT label AS majority FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
    SELECT count(*) AS n, round(avg(CASE WHEN label = majority THEN 1.0 ELSE 0 END), 6) AS majority, round(avg(CASE WHEN label = p1 THEN 1.0 ELSE 0 END), 6) AS first_view, round(avg(CASE WHEN label = p2 THEN 1.0 ELSE 0 END), 6) AS second_view FROM a, m""")
def baselines(spark: SparkSession, d: str) -> DataFrame:
    """A majority baseline and two single views (M-16, M-06)."""
    e = table(spark, d, "embeddings")
    top = e.groupBy("label").agg(F.count("*").alias("c")).agg(F.max_by("label", F.struct("c", -F.col("label"))).alias("majority"))
    arg = lambda c: F.array_position(c, F.array_max(c)) - 1
    x = e.crossJoin(F.broadcast(top))
    share = lambda c, n: F.round(F.avg((F.col("label") == c).cast("int")), 6).alias(n)
    return x.agg(F.count("*").alias("n"), share(F.col("majority"), "majority"), share(arg(F.slice("embedding", 1, 10)), "first_view"), share(arg(F.slice("embedding", 11, 10)), "second_view"))


@Q("""WITH f AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM f GROUP BY i) SELECT vec_id, round(sqrt(sum(pow((x - m) / nullif(s, 0), 2))), 4) AS z_norm FROM f JOIN m ON m.i = f.i GROUP BY vec_id""")
def standardised(spark: SparkSession, d: str) -> DataFrame:
    """Columns of a feature matrix standardised (M-10); one row of means and deviations travels with the rows."""
    e = table(spark, d, "embeddings")
    m = e.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    m = m.agg(F.sort_array(F.collect_list(F.struct("i", "m", "s"))).alias("m"))
    z = F.aggregate(F.zip_with("embedding", "m", lambda x, m: F.pow((x - m["m"]) / F.nullif(m["s"], F.lit(0.0)), F.lit(2))), F.lit(0.0), lambda acc, x: acc + x)
    return e.crossJoin(F.broadcast(m)).select("vec_id", F.round(F.sqrt(z), 4).alias("z_norm"))


@fitted_on("embeddings", "vec_id bigint, label int, guess int")
def cross_validated(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold predictions of two views by class-balanced logistic regression and their fusion (M-03, M-05, M-06); held-out accuracy is tested."""
    e = table(spark, d, "embeddings").withColumn("fold", F.pmod(F.xxhash64("vec_id"), F.lit(3)).cast("int"))
    a = M.cross_validate(e, "vec_id", "label", "fold", F.slice("embedding", 1, 32))
    b = M.cross_validate(e, "vec_id", "label", "fold", F.slice("embedding", 33, 32))
    return M.fuse([a, b], "vec_id", e.select("vec_id", "label"))


@fitted_on("embeddings", "nmi double, ari double, fowlkes_mallows double")
def clusters(spark: SparkSession, d: str) -> DataFrame:
    """k-means over a feature matrix, and how it agrees with the labels (M-12, X-06)."""
    return M.kmeans_agreement(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 10)


@fitted_on("embeddings", "n bigint, r2 double")
def linear_probe(spark: SparkSession, d: str) -> DataFrame:
    """How much of a quantity a linear model finds in a feature matrix, against its mean (X-08)."""
    e = table(spark, d, "embeddings").withColumn("y", F.col("label").cast("double"))
    return M.linear_probe(e, "embedding", "y", F.pmod(F.xxhash64("vec_id"), F.lit(4)) == 0)


QUERIES, SQL = Q.queries, Q.sql
QUERIES |= {f.__name__: f for f in (fuzzy_titles, note_f1, melodic_alignment, cross_validated, clusters, linear_probe)}
