"""Note sequences as models see them: feature vectors, vocabularies, viewpoints, song features, audits, augmentation, notation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from strophe.operators import kernels as K, sequences as S
from strophe.operators.relational import overlap_join
from strophe.plans.registry import Registry
from strophe.plans.sequences import GONG, NOTES_SQL, W, notes

Q = Registry()

# Names of the twelve degrees above the tonic.
DEGREES = ("宫", "♯宫", "商", "♯商", "角", "清角", "变徵", "徵", "♯徵", "羽", "闰", "变宫")
# The five degrees of the pentatonic collection and the modes that end on them.
FIVE = (0, 2, 4, 7, 9)
MODES = {0: "gong", 2: "shang", 4: "jue", 7: "zhi", 9: "yu"}

_TEMPLATE = ", ".join(f"({s}, {w})" for s, w in GONG.items())
TONIC_SQL = f"""{NOTES_SQL},
    h AS (SELECT item, pitch % 12 AS pc, sum(dur) / sum(sum(dur)) OVER (PARTITION BY item) AS w FROM n GROUP BY item, pitch % 12),
    t(s, tw) AS (VALUES {_TEMPLATE}), k AS (SELECT unnest(range(12)) AS k),
    sc AS (SELECT i.item, k, round(sum(coalesce(h.w, 0) * tw), 9) AS score FROM (SELECT DISTINCT item FROM n) i, k, t
           LEFT JOIN h ON h.item = i.item AND h.pc = (k.k + t.s) % 12 GROUP BY i.item, k),
    g AS (SELECT item, CAST(k AS INTEGER) AS gong FROM sc QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, k) = 1)"""


def with_tonic(n: DataFrame) -> DataFrame:
    """Notes with ``gong``, the tonic of their item, and ``rel``, the degree above it."""
    b = S.best_rotation(S.pitch_classes(n), GONG).select("item", F.col("tonic").alias("gong"))
    return n.join(b, "item").withColumn("rel", F.pmod(F.col("pitch") - F.col("gong"), F.lit(12)).cast("int"))


def with_relative_duration(n: DataFrame) -> DataFrame:
    """Adds ``q``: the distance to the next note (of the last one its length) in octaves of the item's median, from -2 to 3."""
    ahead = F.lead("onset").over(W()) - F.col("onset")
    x = n.withColumn("ioi", F.when(ahead > 0, ahead).otherwise(F.col("dur")))
    m = x.where("ioi > 0").groupBy("item").agg(F.percentile("ioi", 0.5).alias("m"))
    q = F.least(F.greatest(F.bround(F.log2(F.greatest(F.col("ioi"), F.lit(1e-4)) / F.col("m")), 0), F.lit(-2.0)), F.lit(3.0)).cast("int")
    return x.join(m, "item").withColumn("q", q)


def _array(names: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in names])


def _joined(x: DataFrame, kinds: dict[str, Column], kind: str, out: str) -> DataFrame:
    """One text per item and kind: the symbols of the notes in order; null symbols are left out."""
    pairs = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("kind"), c.alias("s"))) for k, c in kinds.items()]))
    e = x.select("item", "pos", F.explode(pairs).alias("e")).select("item", "pos", F.col("e.kind").alias(kind), "e.s")
    g = e.groupBy("item", kind).agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("a"))
    return g.select("item", kind, F.array_join(F.transform("a", lambda z: z["s"]), " ").alias(out))


def _joined_sql(kinds: dict[str, str], kind: str, out: str) -> str:
    return " UNION ALL ".join(f"SELECT item, '{k}' AS {kind}, string_agg({c}, ' ' ORDER BY pos) AS {out} FROM y WHERE {c} IS NOT NULL GROUP BY item" for k, c in kinds.items())


_Y = f"""{TONIC_SQL},
    x AS (SELECT n.item, pos, pitch, dur, onset, (pitch - gong + 12) % 12 AS rel, pitch - lag(pitch) OVER w AS iv, lead(onset) OVER w - onset AS ahead,
                 median(pitch) OVER (PARTITION BY n.item) AS mid, lead(pos) OVER w IS NULL AS last
          FROM n JOIN g ON g.item = n.item WINDOW w AS (PARTITION BY n.item ORDER BY pos)),
    x2 AS (SELECT *, CASE WHEN ahead > 0 THEN ahead ELSE dur END AS ioi FROM x),
    m AS (SELECT item, median(ioi) AS m FROM x2 WHERE ioi > 0 GROUP BY item), m2 AS (SELECT item, median(ahead) AS m2 FROM x2 WHERE ahead > 0 GROUP BY item),
    y AS (SELECT x2.*, CAST(least(greatest(round_even(log2(greatest(ioi, 1e-4) / m), 0), -2), 3) AS INTEGER) AS q, coalesce(m2, 1) AS m2,
                 [{", ".join(f"'{d}'" for d in DEGREES)}][CAST(rel AS INTEGER) + 1] AS deg,
                 CASE WHEN iv = 0 THEN 'R' WHEN iv > 0 THEN '+' || least(iv, 12) WHEN iv < 0 THEN '-' || least(-iv, 12) END AS step
          FROM x2 JOIN m ON m.item = x2.item LEFT JOIN m2 ON m2.item = x2.item)"""

_VOCABULARIES = {
    "int": "step", "deg": "deg", "degoct": "deg || CASE WHEN pitch < mid - 6 THEN 'L' WHEN pitch > mid + 6 THEN 'H' ELSE 'M' END", "degdur": "deg || '_' || q",
    "intdur": "step || '_' || q", "dur": "'d' || q", "contour": "CASE WHEN iv = 0 THEN 'S' WHEN iv > 2 THEN 'U' WHEN iv > 0 THEN 'u' WHEN iv < -2 THEN 'D' WHEN iv < 0 THEN 'd' END",
    "cad": "CASE WHEN q >= 1 OR last THEN deg END", "abs": "'pc' || (pitch % 12)",
}


@Q(f"WITH {_Y} {_joined_sql(_VOCABULARIES, 'vocab', 'tokens')}")
def token_vocabularies(spark: SparkSession, d: str) -> DataFrame:
    """Each item in nine vocabularies: intervals, degrees with and without register and duration, durations, contour, cadences, pitch classes (N-06)."""
    iv = F.col("pitch") - F.lag("pitch").over(W())
    whole = Window.partitionBy("item")
    x = with_relative_duration(with_tonic(notes(spark, d)))
    x = x.withColumns({"iv": iv, "mid": F.percentile("pitch", 0.5).over(whole), "last": F.lead("pos").over(W()).isNull()})
    deg, q = F.element_at(_array(DEGREES), F.col("rel") + 1), F.col("q").cast("string")
    sign = F.when(F.col("iv") > 0, "+").when(F.col("iv") < 0, "-")
    step = F.when(F.col("iv") == 0, "R").otherwise(F.concat(sign, F.least(F.abs("iv"), F.lit(12)).cast("string")))
    register = F.when(F.col("pitch") < F.col("mid") - 6, "L").when(F.col("pitch") > F.col("mid") + 6, "H").otherwise("M")
    kinds = {
        "int": step, "deg": deg, "degoct": F.concat(deg, register), "degdur": F.concat(deg, F.lit("_"), q), "intdur": F.concat(step, F.lit("_"), q), "dur": F.concat(F.lit("d"), q),
        "contour": S.contour_letter(F.col("iv")), "cad": F.when((F.col("q") >= 1) | F.col("last"), deg), "abs": F.concat(F.lit("pc"), (F.col("pitch") % 12).cast("string")),
    }
    return _joined(x, kinds, "vocab", "tokens")


_VIEWPOINTS = {
    "deg": "CAST(CAST(rel AS INTEGER) AS VARCHAR)", "int": "CASE WHEN iv IS NOT NULL THEN CAST(least(greatest(iv, -12), 12) AS VARCHAR) END",
    "degd": "CAST(rel AS INTEGER) || '.' || CASE WHEN last THEN 1 WHEN ahead / m2 < 0.7 THEN 0 WHEN ahead / m2 < 1.5 THEN 1 ELSE 2 END",
    "ctr": "CASE WHEN iv > 0 THEN 'U' WHEN iv < 0 THEN 'D' WHEN iv = 0 THEN 'R' END || CASE WHEN abs(iv) < 1 THEN 0 WHEN abs(iv) < 3 THEN 1 WHEN abs(iv) < 5 THEN 2 ELSE 3 END",
}


@Q(f"WITH {_Y} {_joined_sql(_VIEWPOINTS, 'kind', 'symbols')}")
def viewpoints(spark: SparkSession, d: str) -> DataFrame:
    """Each item from four viewpoints: degrees, clipped intervals, degrees with three classes of distance, sized contour (N-07)."""
    ahead = F.lead("onset").over(W()) - F.col("onset")
    x = with_tonic(notes(spark, d)).withColumns({"iv": F.col("pitch") - F.lag("pitch").over(W()), "ahead": ahead, "last": F.lead("pos").over(W()).isNull()})
    m = x.where("ahead > 0").groupBy("item").agg(F.percentile("ahead", 0.5).alias("m"))
    x = x.join(m, "item", "left").withColumn("r", F.col("ahead") / F.coalesce("m", F.lit(1.0)))
    pace = F.when(F.col("last"), 1).when(F.col("r") < 0.7, 0).when(F.col("r") < 1.5, 1).otherwise(2)
    size = F.when(F.abs("iv") < 1, 0).when(F.abs("iv") < 3, 1).when(F.abs("iv") < 5, 2).otherwise(3)
    letter = F.when(F.col("iv") > 0, "U").when(F.col("iv") < 0, "D").when(F.col("iv") == 0, "R")
    kinds = {
        "deg": F.col("rel").cast("string"), "int": F.when(F.col("iv").isNotNull(), F.least(F.greatest("iv", F.lit(-12)), F.lit(12)).cast("string")),
        "degd": F.concat(F.col("rel").cast("string"), F.lit("."), pace.cast("string")), "ctr": F.concat(letter, size.cast("string")),
    }
    return _joined(x, kinds, "kind", "symbols")


@Q(f"""WITH {_Y},
    z AS (SELECT *, lead(rel) OVER w AS nx, row_number() OVER (PARTITION BY item ORDER BY dur DESC, pos) AS by_dur FROM y WINDOW w AS (PARTITION BY item ORDER BY pos)),
    r AS (SELECT item, count(ahead) FILTER (WHERE ahead > 0) AS c, avg(ahead) FILTER (WHERE ahead > 0) AS mean, stddev_pop(ahead) FILTER (WHERE ahead > 0) AS sd FROM z GROUP BY item),
    p AS (SELECT z.*, c, CASE WHEN ahead > 0 AND c > 2 THEN CAST(floor(least(greatest(log2(ahead / m2), -3), 3) + 3.5) AS INTEGER) END AS rb FROM z JOIN r ON r.item = z.item),
    counted AS (SELECT item, 'pc' || CAST(rel AS INTEGER) AS feature, sum(dur) AS v FROM p GROUP BY ALL UNION ALL SELECT item, 'iv' || least(greatest(iv, -13), 13), count(*) FROM p WHERE iv IS NOT NULL GROUP BY ALL
        UNION ALL SELECT item, 'tr' || CAST(rel AS INTEGER) || '_' || CAST(nx AS INTEGER), count(*) FROM p WHERE nx IS NOT NULL GROUP BY ALL UNION ALL SELECT item, 'rh' || rb, count(*) FROM p WHERE rb IS NOT NULL GROUP BY ALL),
    shares AS (SELECT item, feature, v / sum(v) OVER (PARTITION BY item, left(feature, 2)) AS v FROM counted),
    scalars AS (SELECT item, unnest([
        struct_pack(f := 'final' || CAST(arg_max(rel, pos) AS INTEGER), v := 1.0), struct_pack(f := 'longest' || CAST(arg_min(rel, by_dur) AS INTEGER), v := 1.0),
        struct_pack(f := 'contour_up', v := avg(CASE WHEN iv > 0 THEN 1.0 WHEN iv IS NOT NULL THEN 0 END)), struct_pack(f := 'contour_down', v := avg(CASE WHEN iv < 0 THEN 1.0 WHEN iv IS NOT NULL THEN 0 END)),
        struct_pack(f := 'contour_same', v := avg(CASE WHEN iv = 0 THEN 1.0 WHEN iv IS NOT NULL THEN 0 END)), struct_pack(f := 'contour_mean', v := avg(abs(iv))),
        struct_pack(f := 'contour_leap', v := avg(CASE WHEN abs(iv) >= 5 THEN 1.0 WHEN iv IS NOT NULL THEN 0 END)), struct_pack(f := 'contour_max', v := max(abs(iv))::DOUBLE),
        struct_pack(f := 'rhythm_long', v := CASE WHEN max(c) > 2 THEN avg(CASE WHEN ahead >= 2 * m2 THEN 1.0 ELSE 0 END) FILTER (WHERE ahead > 0) END),
        struct_pack(f := 'rhythm_short', v := CASE WHEN max(c) > 2 THEN avg(CASE WHEN ahead <= 0.5 * m2 THEN 1.0 ELSE 0 END) FILTER (WHERE ahead > 0) END),
        struct_pack(f := 'register_range', v := quantile_cont(pitch, 0.95) - quantile_cont(pitch, 0.05)), struct_pack(f := 'register_sd', v := stddev_pop(pitch))], recursive := true) FROM p GROUP BY item),
    cv AS (SELECT item, 'rhythm_cv' AS f, sd / mean AS v FROM r WHERE c > 2),
    scale AS (SELECT item, unnest([struct_pack(f := 'scale_degrees', v := count(*) FILTER (WHERE v > 0.03)::DOUBLE), struct_pack(f := 'scale_semitones', v := coalesce(sum(v) FILTER (WHERE feature IN ('pc5', 'pc11')), 0)),
        struct_pack(f := 'scale_flat', v := coalesce(sum(v) FILTER (WHERE feature IN ('pc6', 'pc10')), 0))], recursive := true) FROM shares WHERE left(feature, 2) = 'pc' GROUP BY item)
    SELECT item, feature, round(v, 6) AS value FROM shares UNION ALL SELECT item, f, round(v, 6) FROM scalars WHERE v IS NOT NULL UNION ALL SELECT item, f, round(v, 6) FROM cv UNION ALL SELECT item, f, round(v, 6) FROM scale""")
def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    """The whole feature vector in long form, zeros of histograms left out (N-02): degrees by sounding time, final and longest degree, scale,
    intervals, contour, transitions, rhythm and register, all over the estimated tonic."""
    ahead = F.lead("onset").over(W()) - F.col("onset")
    x = with_tonic(notes(spark, d)).withColumns({"iv": F.col("pitch") - F.lag("pitch").over(W()), "ahead": F.when(ahead > 0, ahead), "nx": F.lead("rel").over(W())})
    r = x.groupBy("item").agg(F.count("ahead").alias("c"), F.percentile("ahead", 0.5).alias("m"))
    x = x.join(r, "item")
    enough, one = F.col("c") > 2, F.lit(1.0)
    rb = F.when(enough & F.col("ahead").isNotNull(), F.floor(F.least(F.greatest(F.log2(F.col("ahead") / F.col("m")), F.lit(-3.0)), F.lit(3.0)) + 3.5))
    name = lambda *c: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in c])
    part = lambda feature, v: F.when(feature.isNotNull(), F.struct(feature.alias("feature"), v.alias("v")))
    counted = F.array_compact(F.array(
        part(name("pc", F.col("rel")), F.col("dur")), part(F.when(F.col("iv").isNotNull(), name("iv", F.least(F.greatest("iv", F.lit(-13)), F.lit(13)))), one),
        part(name("tr", F.col("rel"), "_", F.col("nx")), one), part(name("rh", rb), one),
    ))
    counts = x.select("item", F.explode(counted).alias("p")).groupBy("item", "p.feature").agg(F.sum("p.v").alias("v"))
    shares = counts.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("item", F.substring("feature", 1, 2))))

    share = lambda cond, of: F.avg(F.when(F.col(of).isNotNull(), cond.cast("int")))
    size = F.abs("iv")
    scalars = x.groupBy("item").agg(
        F.max_by("rel", "pos").alias("final"), F.min_by("rel", F.struct(-F.col("dur"), F.col("pos"))).alias("longest"),
        share(F.col("iv") > 0, "iv").alias("contour_up"), share(F.col("iv") < 0, "iv").alias("contour_down"), share(F.col("iv") == 0, "iv").alias("contour_same"),
        F.avg(size).alias("contour_mean"), share(size >= 5, "iv").alias("contour_leap"), F.max(size).cast("double").alias("contour_max"),
        F.when(F.max(enough), F.stddev_pop("ahead") / F.avg("ahead")).alias("rhythm_cv"), F.when(F.max(enough), share(F.col("ahead") >= 2 * F.col("m"), "ahead")).alias("rhythm_long"),
        F.when(F.max(enough), share(F.col("ahead") <= 0.5 * F.col("m"), "ahead")).alias("rhythm_short"),
        (F.percentile("pitch", 0.95) - F.percentile("pitch", 0.05)).alias("register_range"), F.stddev_pop("pitch").alias("register_sd"),
    )
    named = [c for c in scalars.columns if c not in ("item", "final", "longest")]
    flat = F.array(F.struct(name("final", F.col("final")).alias("feature"), one.alias("v")), F.struct(name("longest", F.col("longest")).alias("feature"), one.alias("v")), *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in named])
    scalars = scalars.select("item", F.explode(flat).alias("p")).select("item", "p.feature", "p.v").where("v is not null")
    of = lambda *f: F.coalesce(F.sum(F.when(F.col("feature").isin(*f), F.col("v"))), F.lit(0.0))
    scale = shares.where("feature like 'pc%'").groupBy("item").agg(F.count_if(F.col("v") > 0.03).cast("double").alias("scale_degrees"), of("pc5", "pc11").alias("scale_semitones"), of("pc6", "pc10").alias("scale_flat"))
    scale = scale.select("item", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in scale.columns if c != "item"])).alias("p")).select("item", "p.feature", "p.v")
    return shares.unionByName(scalars).unionByName(scale).select("item", "feature", F.round("v", 6).alias("value"))


# The events as a song: quarter lengths from an eighth to two beats, a phrase wherever nothing happens for half a day.
SONG_SQL = f"""{NOTES_SQL},
    s0 AS (SELECT item, pos, pitch, (floor(value) % 8 + 1) * 0.25 AS d, CASE WHEN onset - lag(onset) OVER (PARTITION BY item ORDER BY pos) <= 43200 THEN 0 ELSE 1 END AS fresh FROM n),
    s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY item ORDER BY pos ROWS UNBOUNDED PRECEDING) AS INTEGER) - 1 AS phrase, pitch - lag(pitch) OVER (PARTITION BY item ORDER BY pos) AS iv FROM s0)"""


def song(spark: SparkSession, d: str) -> DataFrame:
    new = F.when(F.col("onset") - F.lag("onset").over(W()) <= 43200, 0).otherwise(1)
    x = notes(spark, d).select("item", "pos", "pitch", ((F.floor("value") % 8 + 1) * 0.25).alias("d"), new.alias("fresh"), (F.col("pitch") - F.lag("pitch").over(W())).alias("iv"))
    return x.withColumn("phrase", (F.sum("fresh").over(W().rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("fresh")


@Q(f"""WITH {SONG_SQL}, tot AS (SELECT item, pitch % 12 AS pc, sum(d) AS w FROM s GROUP BY ALL), k AS (SELECT unnest(range(12)) AS k), five(f) AS (VALUES {", ".join(f"({x})" for x in FIVE)}),
    cov AS (SELECT i.item, k, sum(coalesce(w, 0)) AS c, max(CASE WHEN f = 0 THEN coalesce(w, 0) END) AS w0 FROM (SELECT DISTINCT item FROM s) i, k, five LEFT JOIN tot ON tot.item = i.item AND tot.pc = (k + f) % 12 GROUP BY i.item, k),
    best AS (SELECT item, k AS tonic, c FROM cov QUALIFY row_number() OVER (PARTITION BY item ORDER BY c DESC, w0 DESC, k) = 1),
    ph AS (SELECT item, phrase, string_agg(iv, ',' ORDER BY pos) FILTER (WHERE not_first) AS ivs, arg_max(pitch % 12, pos) AS ends, count(*) AS size FROM (SELECT *, row_number() OVER (PARTITION BY item, phrase ORDER BY pos) > 1 AS not_first FROM s) GROUP BY item, phrase),
    rep AS (SELECT item, count(*) FILTER (WHERE size > 1 AND seen > 1) / greatest(count(*) FILTER (WHERE size > 1), 1) AS rep FROM (SELECT *, row_number() OVER (PARTITION BY item, size > 1, ivs ORDER BY phrase) AS seen FROM ph) GROUP BY item),
    fin AS (SELECT item, arg_max(pitch, pos) AS final FROM s GROUP BY item), en AS (SELECT item, -sum(p * log2(p)) AS h, count(*) AS kinds FROM (SELECT item, count(*) / sum(count(*)) OVER (PARTITION BY item) AS p FROM s GROUP BY item, d) GROUP BY item),
    ends AS (SELECT ph.item, avg(CASE WHEN ph.ends = final % 12 THEN 1.0 ELSE 0 END) AS e, count(*) AS phrases FROM ph JOIN fin ON fin.item = ph.item GROUP BY ph.item)
    SELECT s.item, max(pitch) - min(pitch) AS ambitus, round(avg(abs(iv)), 6) AS mean_interval, round(avg(CASE WHEN abs(iv) <= 2 THEN 1.0 WHEN iv IS NOT NULL THEN 0 END), 6) AS steps, round(avg(CASE WHEN abs(iv) >= 5 THEN 1.0 WHEN iv IS NOT NULL THEN 0 END), 6) AS leaps,
      round(avg(CASE WHEN abs(iv) >= 7 THEN 1.0 WHEN iv IS NOT NULL THEN 0 END), 6) AS large_leaps, round(avg(CASE WHEN iv < 0 THEN 1.0 WHEN iv IS NOT NULL THEN 0 END), 6) AS descending, round(avg(pitch) - any_value(final), 6) AS final_below_mean,
      any_value(CASE (final % 12 - tonic + 12) % 12 {" ".join(f"WHEN {d} THEN '{m}'" for d, m in MODES.items())} ELSE 'other' END) AS mode, round(1 - any_value(c) / sum(d), 6) AS outside, any_value(kinds) AS durations, round(any_value(h), 6) AS duration_entropy,
      round(avg(CASE WHEN d IN (0.375, 0.75, 1.5, 3.0) THEN 1.0 ELSE 0 END), 6) AS dotted, round(avg(CASE WHEN d <= 0.25 THEN 1.0 ELSE 0 END), 6) AS short_notes, any_value(phrases) AS phrases, round(count(*) / any_value(phrases), 6) AS notes_per_phrase,
      round(any_value(rep), 6) AS repetition, round(any_value(e), 6) AS ends_on_final, count(*) AS notes
    FROM s JOIN best ON best.item = s.item JOIN fin ON fin.item = s.item JOIN en ON en.item = s.item JOIN ends ON ends.item = s.item JOIN rep ON rep.item = s.item GROUP BY s.item""")
def song_features(spark: SparkSession, d: str) -> DataFrame:
    """Melody, mode, rhythm and form of each item, with phrases (N-04): the collection of five that sounds longest gives the tonic, a
    phrase repeats if an earlier one has the same intervals. The meter comes with the file (see ``meter_changes`` of the kern source)."""
    s = song(spark, d)
    b = S.best_rotation(S.pitch_classes(s.withColumn("dur", F.col("d"))), dict.fromkeys(FIVE, 1.0), heavier_tonic=True).select("item", "tonic", F.col("score").alias("inside"))
    ph = s.groupBy("item", "phrase").agg(F.sort_array(F.collect_list(F.struct("pos", "pitch"))).alias("a"))
    p = F.transform("a", lambda x: x["pitch"])
    steps = F.transform(F.sequence(F.lit(2), F.size("a")), lambda i: F.element_at(p, i) - F.element_at(p, i - 1))
    ph = ph.select("item", "phrase", F.when(F.size("a") > 1, F.array_join(steps.cast("array<string>"), ",")).alias("ivs"), (F.element_at(p, -1) % 12).alias("ends"))
    seen = F.when(F.col("ivs").isNotNull(), F.row_number().over(Window.partitionBy("item", "ivs").orderBy("phrase")))
    fin = s.groupBy("item").agg(F.max_by("pitch", "pos").alias("final"))
    form = ph.withColumn("seen", seen).join(fin, "item").groupBy("item").agg(
        F.count("*").alias("phrases"), F.round(F.count_if(F.col("seen") > 1) / F.greatest(F.count("seen"), F.lit(1)), 6).alias("repetition"),
        F.round(F.avg((F.col("ends") == F.col("final") % 12).cast("int")), 6).alias("ends_on_final"), F.first("final").alias("final"),
    )
    kinds = s.groupBy("item", "d").agg(F.count("*").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("item")))
    kinds = kinds.groupBy("item").agg(F.count("*").alias("durations"), F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("duration_entropy"))
    size = F.abs("iv")
    share = lambda c: F.round(F.avg(F.when(F.col("iv").isNotNull(), c.cast("int"))), 6)
    g = s.groupBy("item").agg(
        (F.max("pitch") - F.min("pitch")).alias("ambitus"), F.round(F.avg(size), 6).alias("mean_interval"), share(size <= 2).alias("steps"), share(size >= 5).alias("leaps"), share(size >= 7).alias("large_leaps"),
        share(F.col("iv") < 0).alias("descending"), F.avg("pitch").alias("mean"), F.round(F.avg(F.col("d").isin(0.375, 0.75, 1.5, 3.0).cast("int")), 6).alias("dotted"), F.round(F.avg((F.col("d") <= 0.25).cast("int")), 6).alias("short_notes"), F.count("*").alias("notes"),
    )
    x = g.join(form, "item").join(kinds, "item").join(b, "item")
    rel = F.pmod(F.col("final") % 12 - F.col("tonic"), F.lit(12))
    mode = F.coalesce(F.create_map(*[F.lit(v) for kv in MODES.items() for v in kv])[rel.cast("int")], F.lit("other"))
    cols = ["item", "ambitus", "mean_interval", "steps", "leaps", "large_leaps", "descending", "durations", "duration_entropy", "dotted", "short_notes", "phrases", "repetition", "ends_on_final", "notes"]
    return x.select(*cols, F.round(F.col("mean") - F.col("final"), 6).alias("final_below_mean"), mode.alias("mode"), F.round(1 - F.col("inside"), 6).alias("outside"), F.round(F.col("notes") / F.col("phrases"), 6).alias("notes_per_phrase"))


_SCHEMES = {
    "bars": "CASE WHEN bar > before THEN repeat('Bar ', CAST(bar - before AS INTEGER)) ELSE '' END || 'Position_' || CAST(tick % 16 AS INTEGER) || ' Pitch_' || pitch || ' Duration_' || len",
    "shifts": "CASE WHEN pos > 1 THEN 'TimeShift_' || gap || ' ' ELSE '' END || 'Pitch_' || pitch || ' Duration_' || len",
    "fixed": "'Pitch_' || pitch || ' Duration_' || len || ' TimeShift_' || gap",
}


@Q(f"""WITH {SONG_SQL}, o AS (SELECT item, pos, pitch, CAST(d * 4 AS INTEGER) AS len, CAST(coalesce(sum(d * 4) OVER (PARTITION BY item ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS tick FROM s),
    y AS (SELECT *, tick // 16 AS bar, coalesce((lag(tick) OVER w) // 16, -1) AS before, tick - coalesce(lag(tick) OVER w, 0) AS gap FROM o WINDOW w AS (PARTITION BY item ORDER BY pos))
    {_joined_sql(_SCHEMES, 'scheme', 'tokens')}""")
def symbolic_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Items in three generic token schemes (M-17, without trained merges): bars and positions, shifts in time, and a fixed number of tokens a note.
    A sixteenth is the unit, sixteen are a bar."""
    before = F.sum(F.col("d") * 4).over(W().rowsBetween(Window.unboundedPreceding, -1))
    o = song(spark, d).select("item", "pos", "pitch", (F.col("d") * 4).cast("int").alias("len"), F.coalesce(before, F.lit(0)).cast("int").alias("at"))
    last = F.lag("at").over(W())
    o = o.withColumns({"bar": F.floor(F.col("at") / 16).cast("int"), "before": F.coalesce(F.floor(last / 16), F.lit(-1)).cast("int"), "gap": F.col("at") - F.coalesce(last, F.lit(0))})
    text = lambda name, c: F.concat(F.lit(name + "_"), c.cast("string"))
    note = F.concat_ws(" ", text("Pitch", F.col("pitch")), text("Duration", F.col("len")))
    shift = text("TimeShift", F.col("gap"))
    bars = F.concat(F.expr("repeat('Bar ', bar - before)"), text("Position", F.col("at") % 16), F.lit(" "), note)
    kinds = {"bars": bars, "shifts": F.when(F.col("pos") > 1, F.concat_ws(" ", shift, note)).otherwise(note), "fixed": F.concat_ws(" ", note, shift)}
    return _joined(o, kinds, "scheme", "tokens")


# Two trackers and a level for every event: the second strays by up to a semitone, each misses some frames.
FRAMES_SQL = f"""{NOTES_SQL},
    f AS (SELECT item, onset AS t, CASE WHEN event_id % 7 <> 0 THEN 36 + value - 48 * floor(value / 48) END AS a,
                 CASE WHEN event_id % 5 <> 0 THEN 36 + value - 48 * floor(value / 48) + (event_id * 37 % 101 - 50) / 50.0 END AS b, event_id * 13 % 30 AS level FROM n),
    fc AS (SELECT *, coalesce(abs(a - b) < 0.5, false) OR (a IS NOT NULL AND level >= 20) AS sure FROM f)"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    """``(item, t, a, b, level, sure)``: a frame is sure where both trackers are within half a semitone, or the first stands out by its level (N-18)."""
    base = 36 + F.col("value") - 48 * F.floor(F.col("value") / 48)
    a = F.when(F.col("event_id") % 7 != 0, base)
    b = F.when(F.col("event_id") % 5 != 0, base + (F.col("event_id") * 37 % 101 - 50) / 50.0)
    f = notes(spark, d).select("item", F.col("onset").alias("t"), a.alias("a"), b.alias("b"), (F.col("event_id") * 13 % 30).alias("level"))
    return f.withColumn("sure", F.coalesce(F.abs(F.col("a") - F.col("b")) < 0.5, F.lit(False)) | (F.col("a").isNotNull() & (F.col("level") >= 20)))


@Q(f"""WITH {FRAMES_SQL}, tau AS (SELECT item, CASE WHEN count(*) >= 5 THEN atan2(avg(sin(2 * pi() * (a - round_even(a, 0)))), avg(cos(2 * pi() * (a - round_even(a, 0))))) / (2 * pi()) ELSE 0 END AS tau FROM fc WHERE sure GROUP BY item),
    o AS (SELECT item, event_id, onset, dur * 20 AS dur, pitch FROM n WHERE event_id % 2 = 0),
    j AS (SELECT o.item, o.event_id, o.pitch, fc.t IS NOT NULL AS met, a, sure AND t >= onset + 0.2 * dur AND t < onset + 0.8 * dur AS core FROM o LEFT JOIN fc ON fc.item = o.item AND fc.t >= o.onset AND fc.t < o.onset + o.dur),
    v AS (SELECT j.item, event_id, any_value(pitch) AS pitch, coalesce(avg(CASE WHEN a IS NOT NULL THEN 1.0 ELSE 0 END) FILTER (WHERE met), 0) AS voiced, count(*) FILTER (WHERE core) AS core, round(median(a) FILTER (WHERE core) - any_value(coalesce(tau, 0)), 9) AS med FROM j LEFT JOIN tau ON tau.item = j.item GROUP BY j.item, event_id)
    SELECT item, event_id, pitch, round(voiced, 6) AS voiced, core, round(med - pitch, 6) AS dev, CAST(round_even(med, 0) AS INTEGER) AS target,
      CASE WHEN voiced < 0.3 THEN 'unvoiced' WHEN core < 2 THEN 'uncertain' WHEN abs(med - pitch) >= 0.5 AND round_even(med, 0) <> pitch THEN CASE WHEN abs(abs(med - pitch) - 12) < 1 THEN 'octave_error' ELSE 'wrong_pitch' END ELSE 'ok' END AS verdict FROM v""")
def audited_notes(spark: SparkSession, d: str) -> DataFrame:
    """A verdict per note (N-15): its frames by a range join, the median of the sure ones in its middle part less the item's tuning, against the written pitch."""
    f = frames(spark, d)
    frac = 2 * F.pi() * (F.col("a") - F.bround("a", 0))
    tau = f.where("sure").groupBy("item").agg(F.when(F.count("*") >= 5, F.atan2(F.avg(F.sin(frac)), F.avg(F.cos(frac))) / (2 * F.pi())).otherwise(0.0).alias("tau"))
    o = notes(spark, d).where("event_id % 2 = 0").select("item", "event_id", "onset", (F.col("onset") + F.col("dur") * 20).alias("end"), (F.col("dur") * 20).alias("dur"), "pitch")
    j = overlap_join(o, f.select("item", "t", (F.col("t") + 1e-9).alias("t_end"), "a", "sure"), ["item"], 86400.0, ("onset", "end"), ("t", "t_end")).where("t_b >= onset")
    core = F.col("sure_b") & (F.col("t_b") >= F.col("onset") + 0.2 * F.col("dur")) & (F.col("t_b") < F.col("onset") + 0.8 * F.col("dur"))
    v = j.groupBy("event_id").agg(F.avg(F.col("a_b").isNotNull().cast("int")).alias("voiced"), F.count_if(core).alias("core"), F.percentile(F.when(core, F.col("a_b")), 0.5).alias("med"))
    x = o.join(v, "event_id", "left").join(tau, "item", "left").withColumn("med", F.round(F.col("med") - F.coalesce("tau", F.lit(0.0)), 9)).fillna(0, ["voiced", "core"])
    dev, target = F.col("med") - F.col("pitch"), F.bround("med", 0)
    wrong = F.when(F.abs(F.abs(dev) - 12) < 1, "octave_error").otherwise("wrong_pitch")
    verdict = F.when(F.col("voiced") < 0.3, "unvoiced").when(F.col("core") < 2, "uncertain").when((F.abs(dev) >= 0.5) & (target != F.col("pitch")), wrong).otherwise("ok")
    return x.select("item", "event_id", "pitch", F.round("voiced", 6).alias("voiced"), "core", F.round(dev, 6).alias("dev"), target.cast("int").alias("target"), verdict.alias("verdict"))


@Q(f"""WITH {FRAMES_SQL}, tr AS (SELECT fc.*, max(CASE WHEN o.item IS NOT NULL THEN pitch END) AS ref FROM (SELECT *, row_number() OVER () AS i FROM fc) fc LEFT JOIN (SELECT item, onset, dur * 20 AS dur, pitch FROM n WHERE event_id % 6 = 0) o ON o.item = fc.item AND fc.t >= o.onset AND fc.t < o.onset + o.dur GROUP BY ALL)
    SELECT item, round(avg(CASE WHEN abs(a - ref) < 12 THEN 1.0 ELSE 0 END) FILTER (WHERE ref IS NOT NULL AND a IS NOT NULL), 6) AS first_accuracy, round(avg(CASE WHEN abs(b - ref) < 12 THEN 1.0 ELSE 0 END) FILTER (WHERE ref IS NOT NULL AND b IS NOT NULL), 6) AS second_accuracy,
      round(avg(CASE WHEN abs(a - ref) < 12 THEN 1.0 ELSE 0 END) FILTER (WHERE ref IS NOT NULL AND sure), 6) AS sure_accuracy, round(count(*) FILTER (WHERE ref IS NOT NULL AND sure) / greatest(count(*) FILTER (WHERE ref IS NOT NULL), 1), 6) AS sure_share,
      round(count(*) FILTER (WHERE ref IS NULL AND a IS NOT NULL) / greatest(count(*) FILTER (WHERE ref IS NULL), 1), 6) AS first_false_alarm FROM tr GROUP BY item""")
def tracker_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How often each tracker is near the reference where there is one, and sounds where there is none (N-26)."""
    f = frames(spark, d).withColumn("i", F.struct("item", "t"))
    o = notes(spark, d).where("event_id % 6 = 0").select("item", "onset", (F.col("onset") + F.col("dur") * 20).alias("end"), "pitch")
    met = overlap_join(o, f.select("item", "t", (F.col("t") + 1e-9).alias("t_end")), ["item"], 86400.0, ("onset", "end"), ("t", "t_end")).where("t_b >= onset")
    ref = met.groupBy("item", F.col("t_b").alias("t")).agg(F.max("pitch").alias("ref"))
    x = f.drop("i").join(ref, ["item", "t"], "left")
    known = F.col("ref").isNotNull()
    near = lambda c, cond: F.round(F.avg(F.when(known & cond, (F.abs(F.col(c) - F.col("ref")) < 12).cast("int"))), 6)
    ratio = lambda a, b: F.round(F.count_if(a) / F.greatest(F.count_if(b), F.lit(1)), 6)
    return x.groupBy("item").agg(
        near("a", F.col("a").isNotNull()).alias("first_accuracy"), near("b", F.col("b").isNotNull()).alias("second_accuracy"), near("a", F.col("sure")).alias("sure_accuracy"),
        ratio(known & F.col("sure"), known).alias("sure_share"), ratio(~known & F.col("a").isNotNull(), ~known).alias("first_false_alarm"),
    )


@Q(f"""WITH {FRAMES_SQL}, s AS (SELECT item, t, a, CASE WHEN count(a) OVER w >= 3 THEN avg(a) OVER w END AS sm, row_number() OVER (PARTITION BY item ORDER BY t) AS i, count(*) OVER (PARTITION BY item) AS c FROM fc WINDOW w AS (PARTITION BY item ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    g AS (SELECT *, CASE WHEN i = 1 THEN lead(sm) OVER o - sm WHEN i = c THEN sm - lag(sm) OVER o ELSE (lead(sm) OVER o - lag(sm) OVER o) / 2 END AS slope FROM s WINDOW o AS (PARTITION BY item ORDER BY i)),
    v AS (SELECT item, count(a) AS voiced, count(*) FILTER (WHERE a IS NOT NULL AND abs(slope) < 6) AS steady FROM g GROUP BY item), st AS (SELECT g.item, a FROM g JOIN v ON v.item = g.item WHERE a IS NOT NULL AND abs(slope) < 6 AND v.voiced >= 20 AND v.steady >= 10),
    tau AS (SELECT item, round(atan2(avg(sin(2 * pi() * (a - round_even(a, 0)))), avg(cos(2 * pi() * (a - round_even(a, 0))))) / (2 * pi()), 9) AS tau FROM st GROUP BY item),
    z AS (SELECT st.item, CAST(round_even(a - tau, 0) AS INTEGER) % 12 AS pc, (a - tau - round_even(a - tau, 0)) * 100 AS dev FROM st JOIN tau ON tau.item = st.item), hist AS (SELECT item, pc, count(*) / sum(count(*)) OVER (PARTITION BY item) AS w FROM z GROUP BY item, pc),
    k AS (SELECT unnest(range(12)) AS k), five(f) AS (VALUES {", ".join(f"({x})" for x in FIVE)}), sc AS (SELECT i.item, k, round(sum(coalesce(w, 0)), 9) AS score FROM (SELECT DISTINCT item FROM z) i, k, five LEFT JOIN hist ON hist.item = i.item AND hist.pc = (k + f) % 12 GROUP BY i.item, k),
    g2 AS (SELECT item, k AS gong FROM sc QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, k) = 1), deg AS (SELECT z.item, (pc - gong + 12) % 12 AS deg, dev FROM z JOIN g2 ON g2.item = z.item),
    per AS (SELECT item, deg, count(*) / sum(count(*)) OVER (PARTITION BY item) AS occ, CASE WHEN count(*) >= 3 THEN median(dev) END AS dev, CASE WHEN count(*) >= 3 THEN quantile_cont(dev, 0.75) - quantile_cont(dev, 0.25) END AS iqr FROM deg GROUP BY item, deg)
    SELECT item, unnest(['occ_' || CAST(deg AS INTEGER), 'dev_' || CAST(deg AS INTEGER), 'iqr_' || CAST(deg AS INTEGER)]) AS feature, unnest([round(occ, 6), round(dev, 4), round(iqr, 4)]) AS value FROM per
    UNION ALL SELECT tau.item, unnest(['tuning_cents', 'n_steady', 'steady_share']), unnest([round(tau * 100, 5), steady, round(steady / voiced, 6)]) FROM tau JOIN v ON v.item = tau.item""")
def intonation_features(spark: SparkSession, d: str) -> DataFrame:
    """The intonation profile in long form (N-19): steady frames by their smoothed slope, the tuning as a circular mean, and of each degree
    above the tonic its share, the median and the quartile distance of its deviations. Items with few voiced or steady frames give no rows."""
    w = Window.partitionBy("item").orderBy("t")
    s = frames(spark, d).select("item", "t", "a", S.centred_mean(F.col("a"), w, 2, 3).alias("sm"))
    nxt, prv = F.lead("sm").over(w), F.lag("sm").over(w)
    first, last = F.lag("t").over(w).isNull(), F.lead("t").over(w).isNull()
    slope = F.when(first, nxt - F.col("sm")).when(last, F.col("sm") - prv).otherwise((nxt - prv) / 2)
    s = s.withColumn("steady", F.coalesce(F.col("a").isNotNull() & (F.abs(slope) < 6), F.lit(False)))
    frac = 2 * F.pi() * (F.col("a") - F.bround("a", 0))
    on = lambda c: F.avg(F.when(F.col("steady"), c))
    v = s.groupBy("item").agg(F.count("a").alias("voiced"), F.count_if("steady").alias("n"), F.round(F.atan2(on(F.sin(frac)), on(F.cos(frac))) / (2 * F.pi()), 9).alias("tau")).where("voiced >= 20 and n >= 10")
    a = F.col("a") - F.col("tau")
    z = s.where("steady").join(v.select("item", "tau"), "item").select("item", (F.bround(a, 0).cast("int") % 12).alias("pc"), ((a - F.bround(a, 0)) * 100).alias("dev"))
    hist = z.groupBy("item", "pc").agg(F.count("*").alias("c")).select("item", "pc", (F.col("c") / F.sum("c").over(Window.partitionBy("item"))).alias("weight"))
    gong = S.best_rotation(hist, dict.fromkeys(FIVE, 1.0)).select("item", F.col("tonic").alias("gong"))
    per = z.join(gong, "item").groupBy("item", F.pmod(F.col("pc") - F.col("gong"), F.lit(12)).cast("int").alias("deg")).agg(F.count("*").alias("c"), F.percentile("dev", 0.5).alias("dev"), (F.percentile("dev", 0.75) - F.percentile("dev", 0.25)).alias("iqr"))
    per = per.withColumn("occ", F.col("c") / F.sum("c").over(Window.partitionBy("item")))
    enough = F.col("c") >= 3
    row = lambda name, value: F.struct(name.alias("feature"), value.cast("double").alias("value"))
    named = lambda p: F.concat(F.lit(p), F.col("deg").cast("string"))
    rows = F.array(row(named("occ_"), F.round("occ", 6)), row(named("dev_"), F.when(enough, F.round("dev", 4))), row(named("iqr_"), F.when(enough, F.round("iqr", 4))))
    whole = F.array(row(F.lit("tuning_cents"), F.round(F.col("tau") * 100, 5)), row(F.lit("n_steady"), F.col("n")), row(F.lit("steady_share"), F.round(F.col("n") / F.col("voiced"), 6)))
    flat = lambda x, c: x.select("item", F.explode(c).alias("r")).select("item", "r.feature", "r.value")
    return flat(per, rows).unionByName(flat(v, whole))


@Q(f"WITH {NOTES_SQL} SELECT item, pos, round(onset, 6) AS onset, round(greatest(onset + 0.03, onset + dur - 0.05), 6) AS ending FROM n")
def trimmed_notes(spark: SparkSession, d: str) -> DataFrame:
    """Ends moved by a constant, but never before a least length (N-13)."""
    end = F.greatest(F.col("onset") + 0.03, F.col("onset") + F.col("dur") - 0.05)
    return notes(spark, d).select("item", "pos", F.round("onset", 6).alias("onset"), F.round(end, 6).alias("ending"))


def _u_sql(salt: str) -> str:
    return f"(('0x' || substr(md5('{salt}' || event_id), 1, 8))::BIGINT / 4294967296.0)"


def _u(salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("event_id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


@Q(f"""WITH {NOTES_SQL}, j AS (SELECT item, event_id, pos, onset, dur * 200 AS dur, pitch + CASE WHEN {_u_sql('jit')} < 0.2 THEN CASE WHEN {_u_sql('way')} < 0.5 THEN -1 ELSE 1 END ELSE 0 END AS pitch, lead(onset) OVER (PARTITION BY item ORDER BY pos) - onset AS ahead FROM n),
    m AS (SELECT item, median(ahead) FILTER (WHERE ahead > 0) AS m FROM j GROUP BY item),
    k AS (SELECT j.*, 0.2 * coalesce(m, 1) AS sd, lead(pitch) OVER (PARTITION BY j.item ORDER BY pos) AS nx FROM j JOIN m ON m.item = j.item),
    g AS (SELECT *, pos > 1 AND {_u_sql('grace')} < 0.1 AND dur > 2 * sd AS grace FROM k),
    h AS (SELECT *, CASE WHEN grace THEN onset + sd ELSE onset END AS on2, CASE WHEN grace THEN dur - sd ELSE dur END AS du2 FROM g),
    e AS (SELECT *, coalesce(abs(nx - pitch) >= 3 AND {_u_sql('glide')} < 0.4 AND du2 > 2 * sd, false) AS glide FROM h),
    o AS (SELECT item, pos, 0 AS part, onset, sd AS dur, pitch + CASE WHEN {_u_sql('kind')} < 0.4 THEN 2 WHEN {_u_sql('kind')} < 0.6 THEN 1 WHEN {_u_sql('kind')} < 0.8 THEN -1 ELSE -2 END AS pitch FROM e WHERE grace
      UNION ALL SELECT item, pos, 1, on2, CASE WHEN glide THEN du2 - sd ELSE du2 END, pitch FROM e
      UNION ALL SELECT item, pos, 2, on2 + du2 - sd, sd, pitch + sign(nx - pitch) * (1 + CAST(floor({_u_sql('mid')} * (abs(nx - pitch) - 1)) AS INTEGER)) FROM e WHERE glide)
    SELECT item, pos, part, round(onset, 2) AS onset, round(dur, 2) AS dur, CAST(pitch AS INTEGER) AS pitch FROM o""")
def augmented_notes(spark: SparkSession, d: str) -> DataFrame:
    """A clean score made to look performed (N-22): pitches stray by a semitone, short neighbours come before notes, wide leaps get a passing
    note. Every draw is a hash of the note, so it is the same whatever the partitioning."""
    stray = F.when(_u("jit") < 0.2, F.when(_u("way") < 0.5, -1).otherwise(1)).otherwise(0)
    j = notes(spark, d).select("item", "event_id", "pos", "onset", (F.col("dur") * 200).alias("dur"), (F.col("pitch") + stray).alias("pitch"), (F.lead("onset").over(W()) - F.col("onset")).alias("ahead"))
    m = j.where("ahead > 0").groupBy("item").agg(F.percentile("ahead", 0.5).alias("m"))
    k = j.join(m, "item", "left").withColumns({"sd": 0.2 * F.coalesce("m", F.lit(1.0)), "nx": F.lead("pitch").over(W())})
    k = k.withColumn("grace", (F.col("pos") > 1) & (_u("grace") < 0.1) & (F.col("dur") > 2 * F.col("sd")))
    k = k.withColumns({"on2": F.when(F.col("grace"), F.col("onset") + F.col("sd")).otherwise(F.col("onset")), "du2": F.when(F.col("grace"), F.col("dur") - F.col("sd")).otherwise(F.col("dur"))})
    leap = F.abs(F.col("nx") - F.col("pitch"))
    k = k.withColumn("glide", F.coalesce((leap >= 3) & (_u("glide") < 0.4) & (F.col("du2") > 2 * F.col("sd")), F.lit(False)))
    kind = _u("kind")
    near = F.when(kind < 0.4, 2).when(kind < 0.6, 1).when(kind < 0.8, -1).otherwise(-2)
    between = F.col("pitch") + F.signum(F.col("nx") - F.col("pitch")) * (1 + F.floor(_u("mid") * (leap - 1)))
    part = lambda n, on, du, p: F.struct(F.lit(n).alias("part"), F.round(on, 2).alias("onset"), F.round(du, 2).alias("dur"), p.cast("int").alias("pitch"))
    parts = F.array(
        F.when(F.col("grace"), part(0, F.col("onset"), F.col("sd"), F.col("pitch") + near)),
        part(1, F.col("on2"), F.when(F.col("glide"), F.col("du2") - F.col("sd")).otherwise(F.col("du2")), F.col("pitch")),
        F.when(F.col("glide"), part(2, F.col("on2") + F.col("du2") - F.col("sd"), F.col("sd"), between)),
    )
    return k.select("item", "pos", F.explode(F.array_compact(parts)).alias("p")).select("item", "pos", "p.*")


@Q(f"""WITH {SONG_SQL}, e AS (SELECT item, pos, CASE WHEN pos % 9 <> 0 THEN pitch END AS p, CASE WHEN pos % 9 <> 0 THEN d ELSE -d END AS d FROM s),
    r AS (SELECT *, d / lag(d) OVER (PARTITION BY item ORDER BY pos) AS ratio FROM e), i AS (SELECT item, p - lag(p) OVER (PARTITION BY item ORDER BY pos) AS iv FROM e WHERE p IS NOT NULL),
    tok AS (SELECT item, 's' AS kind, coalesce(p, 0)::DOUBLE AS v FROM r UNION ALL SELECT item, 'd', d FROM r UNION ALL SELECT item, 'r', round(ratio, 4) FROM r WHERE ratio IS NOT NULL UNION ALL SELECT item, 'i', iv FROM i WHERE iv IS NOT NULL),
    c AS (SELECT item, kind, v, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY item, kind) AS percent FROM tok GROUP BY item, kind, v),
    cls AS (SELECT item % 3 AS cls, count(*) AS items FROM (SELECT DISTINCT item FROM e) GROUP BY 1), keep AS (SELECT DISTINCT kind, v FROM (SELECT c.item % 3 AS cls, kind, v, count(*) AS df FROM c GROUP BY ALL) x JOIN cls USING (cls) WHERE df >= 0.15 * items)
    SELECT c.item, c.kind, c.v, round(percent, 6) AS percent FROM c JOIN keep ON keep.kind = c.kind AND keep.v = c.v""")
def percent_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of pitch, interval, length and ratio of lengths as percentages of their kind in an item, kept if 15 % of some class hold them (N-23). A rest has no
    pitch and a negative length."""
    sounding = F.col("pos") % 9 != 0
    e = song(spark, d).select("item", "pos", F.when(sounding, F.col("pitch")).alias("p"), F.when(sounding, F.col("d")).otherwise(-F.col("d")).alias("d"))
    r = e.withColumns({"ratio": F.round(F.col("d") / F.lag("d").over(W()), 4), "before": F.last("p", True).over(W().rowsBetween(Window.unboundedPreceding, -1))})
    token = lambda k, v: F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.cast("double").alias("v")))
    tokens = F.array_compact(F.array(token("s", F.coalesce("p", F.lit(0))), token("d", F.col("d")), token("r", F.col("ratio")), token("i", F.col("p") - F.col("before"))))
    c = r.select("item", F.explode(tokens).alias("t")).groupBy("item", "t.kind", "t.v").agg(F.count("*").alias("n"))
    c = c.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("item", "kind"))).withColumn("cls", F.col("item") % 3)
    items = c.groupBy("cls").agg(F.count_distinct("item").alias("items"))
    keep = c.groupBy("cls", "kind", "v").agg(F.count("*").alias("df")).join(items, "cls").where("df >= 0.15 * items").select("kind", "v").distinct()
    return c.join(keep, ["kind", "v"]).select("item", "kind", "v", F.round("percent", 6).alias("percent"))


# Letters of the twelve pitch classes in ABC notation.
ABC = ("C", "^C", "D", "^D", "E", "F", "^F", "G", "^G", "A", "^A", "B")


@Q(f"""WITH {TONIC_SQL}, s AS (SELECT n.item, pos, pitch + CASE WHEN gong <= 6 THEN -gong ELSE 12 - gong END AS p, floor(value) % 8 + 1 AS len FROM n JOIN g ON g.item = n.item),
    c AS (SELECT *, [{", ".join(f"'{x}'" for x in ABC)}][CAST(p % 12 AS INTEGER) + 1] AS letter, CAST(p // 12 AS INTEGER) - 5 AS oct FROM s)
    SELECT item, string_agg(CASE WHEN oct > 0 THEN lower(letter) || repeat('''', oct - 1) ELSE letter || repeat(',', -oct) END || CASE WHEN len > 1 THEN CAST(CAST(len AS INTEGER) AS VARCHAR) ELSE '' END, ' ' ORDER BY pos) AS abc FROM c GROUP BY item""")
def abc_text(spark: SparkSession, d: str) -> DataFrame:
    """Sequences moved to the nearest C and written in ABC notation with lengths in sixteenths (N-25, F-S25)."""
    n = with_tonic(notes(spark, d))
    p = F.col("pitch") + F.when(F.col("gong") <= 6, -F.col("gong")).otherwise(12 - F.col("gong"))
    x = n.withColumns({"p": p, "len": (F.floor("value") % 8 + 1).cast("int")})
    letter, octave = F.element_at(_array(ABC), (F.col("p") % 12 + 1).cast("int")), (F.floor(F.col("p") / 12) - 5).cast("int")
    name = F.when(octave > 0, F.concat(F.lower(letter), F.expr("repeat('\\'', cast(floor(p / 12) as int) - 6)"))).otherwise(F.concat(letter, F.expr("repeat(',', 5 - cast(floor(p / 12) as int))")))
    x = x.withColumn("s", F.concat(name, F.when(F.col("len") > 1, F.col("len").cast("string")).otherwise("")))
    g = x.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("a"))
    return g.select("item", F.array_join(F.transform("a", lambda z: z["s"]), " ").alias("abc"))


@Q(f"""WITH RECURSIVE {NOTES_SQL}, q AS (SELECT item, s, e, pitch, row_number() OVER (PARTITION BY item ORDER BY s, e, pitch) AS i FROM (SELECT item, onset / 3600 AS s, (onset + dur) / 3600 AS e, pitch FROM n) WHERE e - s >= 0.1),
    r AS (SELECT DISTINCT item, 0::BIGINT AS i, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS before, NULL::INTEGER AS pitch FROM q
      UNION ALL SELECT q.item, q.i, greatest(r.b, round_even(q.s / 0.25, 0) * 0.25), greatest(greatest(r.b, round_even(q.s / 0.25, 0) * 0.25) + 0.25, round_even(q.e / 0.25, 0) * 0.25), r.b, q.pitch FROM r JOIN q ON q.item = r.item AND q.i = r.i + 1)
    SELECT item, a AS start, b - a AS length, pitch FROM r WHERE i > 0 UNION ALL SELECT item, before, a - before, NULL FROM r WHERE i > 0 AND a > before""")
def quantised_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes on a grid of quarters of a beat with rests between; very short ones go into the next (N-14). Sequential by nature: one item a
    group; the SQL recurs note by note."""
    n = notes(spark, d).select("item", (F.col("onset") / 3600).alias("s"), ((F.col("onset") + F.col("dur")) / 3600).alias("e"), "pitch")

    def grid(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["s", "e", "pitch"])
        out = K.quantise(list(zip(g["s"], g["e"], g["pitch"])))
        rows = pd.DataFrame(out, columns=["start", "length", "pitch"])
        rows.insert(0, "item", g["item"].iloc[0])
        return rows.astype({"start": float, "length": float, "pitch": "Int32"})

    return n.groupBy("item").applyInPandas(grid, "item long, start double, length double, pitch int")


QUERIES, SQL = Q.queries, Q.sql
