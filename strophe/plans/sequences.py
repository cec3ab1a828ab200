"""Ordered analytics and note sequences (survey groups W and N).

An event stream stands for note sequences: the user is the item, the time since the user's first event the onset,
the pitch is 36 + floor(value) % 48, and the duration is half a minute per unit of value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from strophe.operators import sequences as S
from strophe.operators.ordered import running_totals
from strophe.operators.relational import cap_per_group
from strophe.plans.registry import REC, Registry, recordings, sql_present, table

Q = Registry()

NOTES_SQL = """n AS (SELECT user_id AS item, event_id, CAST(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS DOUBLE) / 1e6 AS onset, value * 30 AS dur, CAST(36 + floor(value) % 48 AS INTEGER) AS pitch, event_type, value,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS pos FROM events)"""


def notes(spark: SparkSession, d: str) -> DataFrame:
    """The events as notes: (item, event_id, onset, dur, pitch, event_type, value, pos)."""
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id")
    e = e.withColumns({"onset": (F.col("us") - F.min("us").over(w)).cast("double") / 1e6, "pos": F.row_number().over(w.orderBy("us", "event_id"))})
    return e.select(F.col("user_id").alias("item"), "event_id", "onset", (F.col("value") * 30).alias("dur"), (36 + F.floor("value") % 48).cast("int").alias("pitch"), "event_type", "value", "pos")


def W(order: str = "pos") -> Window:  # noqa: N802
    return Window.partitionBy("item").orderBy(order)


@Q(f"SELECT region, item_id, CAST(row_number() OVER (PARTITION BY region ORDER BY item_id) AS INTEGER) AS n FROM {REC} WHERE core")
def numbered(spark: SparkSession, d: str) -> DataFrame:
    """Row numbers within groups (W-01)."""
    r = recordings(spark, d, "region", "core").where("core")
    return r.select("region", "item_id", F.row_number().over(Window.partitionBy("region").orderBy("item_id")).alias("n"))


@Q(f"""WITH a AS (SELECT item_id, channel_key, song_key FROM {REC} WHERE channel_key IS NOT NULL AND song_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY channel_key ORDER BY item_id) <= 4)
    SELECT item_id, channel_key, song_key FROM a QUALIFY row_number() OVER (PARTITION BY song_key ORDER BY item_id) <= 2""")
def row_caps(spark: SparkSession, d: str) -> DataFrame:
    """At most four per channel, then at most two per song among those left (W-02, V-04): two passes, in this order."""
    r = recordings(spark, d, "channel_key", "song_key").where("channel_key is not null and song_key is not null")
    return cap_per_group(cap_per_group(r, ["channel_key"], [F.col("item_id")], 4), ["song_key"], [F.col("item_id")], 2)


@Q("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The first three of each sorted group (W-03)."""
    return cap_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@Q(f"WITH g AS (SELECT song_key FROM {REC} WHERE song_key IS NOT NULL GROUP BY song_key HAVING count(*) >= 20) SELECT item_id, r.song_key FROM {REC} r JOIN g ON g.song_key = r.song_key")
def groups_of_size(spark: SparkSession, d: str) -> DataFrame:
    """Rows of groups of at least twenty (A-25, W-04): counts are combined before the shuffle, then joined, instead of a window per group."""
    r = recordings(spark, d, "song_key").where("song_key is not null")
    g = r.groupBy("song_key").agg(F.count("*").alias("n")).where("n >= 20").select("song_key")
    return r.join(g, "song_key").select("item_id", "song_key")


@Q(f"WITH {NOTES_SQL} SELECT item, pos, CASE WHEN count(value) OVER f >= 3 THEN round(avg(value) OVER f, 6) END AS smooth FROM n WINDOW f AS (PARTITION BY item ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    """Centred mean of five, null with under three values (W-05)."""
    return notes(spark, d).select("item", "pos", F.round(S.centred_mean(F.col("value"), W(), 2, 3), 6).alias("smooth"))


@Q(f"WITH {NOTES_SQL} SELECT item, pos, CASE WHEN count(value) OVER f >= 5 THEN round(quantile_cont(value, 0.5) OVER f, 6) END AS smooth FROM n WINDOW f AS (PARTITION BY item ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)")
def rolling_median(spark: SparkSession, d: str) -> DataFrame:
    """Centred median of fifteen, null with under five values (W-06)."""
    return notes(spark, d).select("item", "pos", F.round(S.centred_median(F.col("value"), W(), 7, 5), 6).alias("smooth"))


@Q(f"""WITH {NOTES_SQL}, v AS (SELECT item, pos, CASE WHEN event_type NOT IN ('error', 'click') THEN value END AS v FROM n),
    k AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN pos END) OVER (PARTITION BY item ORDER BY pos) AS pb, min(CASE WHEN v IS NOT NULL THEN pos END) OVER (PARTITION BY item ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pa FROM v)
    SELECT k.item, k.pos, round(coalesce(k.v, CASE WHEN k.pos - k.pb <= 5 THEN b.v + (a.v - b.v) * (k.pos - k.pb) / (k.pa - k.pb) END), 6) AS filled FROM k LEFT JOIN v b ON b.item = k.item AND b.pos = k.pb LEFT JOIN v a ON a.item = k.item AND a.pos = k.pa""")
def gap_interpolate(spark: SparkSession, d: str) -> DataFrame:
    """Linear interpolation of at most the first five places of inner gaps (W-07)."""
    v = notes(spark, d).select("item", "pos", F.when(~F.col("event_type").isin("error", "click"), F.col("value")).alias("v"))
    return S.interpolate(v, "item", "pos", "v", 5).select("item", "pos", F.round("filled", 6).alias("filled"))


@Q(f"WITH {NOTES_SQL} SELECT item, pos, pitch - lag(pitch) OVER w AS interval, round(coalesce(lead(onset) OVER w - onset, dur), 6) AS ioi, round(least(dur, coalesce(lead(onset) OVER w - onset, dur)), 6) AS cut FROM n WINDOW w AS (PARTITION BY item ORDER BY pos)")
def intervals_and_distances(spark: SparkSession, d: str) -> DataFrame:
    """First differences, distances to the next onset (the last has its own length), and notes cut at the next onset (W-08, W-09, W-11)."""
    nxt = F.coalesce(F.lead("onset").over(W()) - F.col("onset"), F.col("dur"))
    return notes(spark, d).select("item", "pos", (F.col("pitch") - F.lag("pitch").over(W())).alias("interval"), F.round(nxt, 6).alias("ioi"), F.round(F.least("dur", nxt), 6).alias("cut"))


@Q(f"WITH {NOTES_SQL}, m AS (SELECT item, median(dur) AS m FROM n GROUP BY item) SELECT n.item, pos, round(dur / nullif(m, 0), 6) AS ratio FROM n JOIN m ON m.item = n.item")
def relative_duration(spark: SparkSession, d: str) -> DataFrame:
    """Values relative to the median of their group (W-10)."""
    n = notes(spark, d)
    m = n.groupBy("item").agg(F.percentile("dur", 0.5).alias("m"))
    return n.join(m, "item").select("item", "pos", F.round(F.col("dur") / F.nullif(F.col("m"), F.lit(0.0)), 6).alias("ratio"))


@Q(f"""WITH {NOTES_SQL}, c AS (SELECT *, CASE WHEN pitch = lag(pitch) OVER (PARTITION BY item ORDER BY onset) THEN 0 ELSE 1 END AS c FROM n), r AS (SELECT *, sum(c) OVER (PARTITION BY item ORDER BY onset ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT item, round(min(onset), 6) AS onset, round(max(onset + dur) - min(onset), 6) AS dur, min(pitch) AS pitch, count(*) AS merged FROM r GROUP BY item, run""")
def merged_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one pitch as one note (W-12)."""
    m = S.merge_repeats(notes(spark, d))
    return m.select("item", F.round("onset", 6).alias("onset"), F.round("dur", 6).alias("dur"), "pitch", "merged")


@Q(f"""WITH {NOTES_SQL}, g AS (SELECT *, CASE WHEN onset - lag(onset) OVER (PARTITION BY item ORDER BY onset) <= 21600 THEN 0 ELSE 1 END AS c FROM n), i AS (SELECT *, sum(c) OVER (PARTITION BY item ORDER BY onset ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT item, CAST(k AS BIGINT) AS island, count(*) AS n, round(min(onset), 3) AS start_s, round(max(onset), 3) AS end_s FROM i GROUP BY item, k HAVING count(*) >= 3""")
def islands_of_activity(spark: SparkSession, d: str) -> DataFrame:
    """Runs without a gap of over six hours and of at least three events (W-13, T-09)."""
    i = S.islands(notes(spark, d), "item", "onset", 21600.0)
    return i.groupBy("item", "island").agg(F.count("*").alias("n"), F.round(F.min("onset"), 3).alias("start_s"), F.round(F.max("onset"), 3).alias("end_s")).where("n >= 3")


@Q(f"""WITH {NOTES_SQL}, a AS (SELECT item, pos, CASE WHEN event_type IN ('error', 'purchase') THEN event_type END AS label FROM n),
    f AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY item ORDER BY pos) AS b, first_value(label IGNORE NULLS) OVER (PARTITION BY item ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM a)
    SELECT item, pos, coalesce(label, CASE WHEN a = b THEN b END) AS filled, CASE WHEN label IS NOT NULL THEN 'title' WHEN a = b THEN 'run' END AS source FROM f""")
def anchors_filled(spark: SparkSession, d: str) -> DataFrame:
    """Places between two neighbouring anchors of one label take the label (W-14)."""
    n = notes(spark, d).select("item", "pos", F.when(F.col("event_type").isin("error", "purchase"), F.col("event_type")).alias("label"))
    return S.fill_between_equal(n, "item", "pos", "label").select("item", "pos", "filled", "source")


@Q(f"""WITH {NOTES_SQL} SELECT item, pos, round(CASE WHEN lag(value) OVER w IS NULL THEN lead(value) OVER w - value WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END, 6) AS gradient,
    CASE WHEN event_type = 'click' AND lag(event_type) OVER w = 'click' THEN round(abs(value - lag(value) OVER w) / 0.01, 4) END AS velocity FROM n WINDOW w AS (PARTITION BY item ORDER BY pos)""")
def gradients(spark: SparkSession, d: str) -> DataFrame:
    """Central differences, one-sided at the ends, and velocity where both neighbours are valid (W-15, W-16)."""
    before, after, v = F.lag("value").over(W()), F.lead("value").over(W()), F.col("value")
    both = (F.col("event_type") == "click") & (F.lag("event_type").over(W()) == "click")
    return notes(spark, d).select("item", "pos", F.round(F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2), 6).alias("gradient"), F.when(both, F.round(F.abs(v - before) / 0.01, 4)).alias("velocity"))


@Q(f"WITH {NOTES_SQL}, p AS (SELECT pitch % 12 AS a, lead(pitch) OVER (PARTITION BY item ORDER BY pos) % 12 AS b FROM n) SELECT a, b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY a), 6) AS share FROM p WHERE b IS NOT NULL GROUP BY a, b")
def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Transitions of pitch classes with shares by row (W-17)."""
    p = notes(spark, d).select((F.col("pitch") % 12).alias("a"), (F.lead("pitch").over(W()) % 12).alias("b")).where("b is not null")
    c = p.groupBy("a", "b").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("a")), 6))


@Q(f"""WITH {NOTES_SQL}, l AS (SELECT event_type AS t0, lag(event_type, 1) OVER w AS t1, lag(event_type, 2) OVER w AS t2, lag(event_type, 3) OVER w AS t3 FROM n WINDOW w AS (PARTITION BY item ORDER BY pos)),
    g AS (SELECT t0 AS gram, 1 AS k FROM l UNION ALL SELECT t1 || ' ' || t0, 2 FROM l WHERE t1 IS NOT NULL UNION ALL SELECT t2 || ' ' || t1 || ' ' || t0, 3 FROM l WHERE t2 IS NOT NULL UNION ALL SELECT t3 || ' ' || t2 || ' ' || t1 || ' ' || t0, 4 FROM l WHERE t3 IS NOT NULL)
    SELECT k, gram, count(*) AS n FROM g GROUP BY ALL""")
def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of token n-grams of one to four (W-18)."""
    lags = [F.col("event_type")] + [F.lag("event_type", i).over(W()) for i in (1, 2, 3)]
    n = notes(spark, d).select(*[c.alias(f"t{i}") for i, c in enumerate(lags)])
    grams = F.array(*[F.when(F.col(f"t{k}").isNotNull(), F.struct(F.lit(k + 1).alias("k"), F.concat_ws(" ", *[f"t{j}" for j in range(k, -1, -1)]).alias("gram"))) for k in range(4)])
    return n.select(F.explode(F.array_compact(grams)).alias("g")).groupBy("g.k", "g.gram").agg(F.count("*").alias("n"))


@Q(f"WITH {NOTES_SQL} SELECT item, arg_max(pitch % 12, pos) AS final, arg_max(pitch % 12, (dur, -pos)) AS longest FROM n GROUP BY item")
def final_and_longest(spark: SparkSession, d: str) -> DataFrame:
    """The last element, and the first of the longest (W-19)."""
    n = notes(spark, d).withColumn("pc", F.col("pitch") % 12)
    return n.groupBy("item").agg(F.max_by("pc", "pos").alias("final"), F.max_by("pc", F.struct(F.col("dur"), -F.col("pos"))).alias("longest"))


@Q("""WITH s AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS score FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_partkey) AS rank FROM s)
    SELECT l_suppkey, min(rank) AS best_rank FROM r WHERE l_partkey % 10 = 0 GROUP BY l_suppkey""")
def rank_of_true(spark: SparkSession, d: str) -> DataFrame:
    """The best rank of the wanted items in each scored pool (W-20)."""
    s = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("score"))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("score"), "l_partkey")))
    return r.where("l_partkey % 10 = 0").groupBy("l_suppkey").agg(F.min("rank").alias("best_rank"))


@Q("""WITH n AS (SELECT event_type, value FROM events WHERE user_id % 7 = 0), q AS (SELECT event_id, event_type, value FROM events WHERE user_id % 7 <> 0)
    SELECT event_id, round(100.0 * count(n.value) FILTER (WHERE n.value < q.value) / count(n.value), 4) AS percentile FROM q JOIN n ON n.event_type = q.event_type GROUP BY event_id""")
def null_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Share of a null sample strictly below each value of the other events (W-21). The sample is counted per value, the counts are summed up in
    order over range partitions, and every event looks its value up: no pairs, and no task that holds a whole event type."""
    e = table(spark, d, "events").select("event_id", "event_type", "value", (F.col("user_id") % 7 == 0).alias("sample"))
    v = e.where("event_type is not null and value is not null").groupBy("event_type", "value").agg(F.count_if("sample").alias("n"))
    r = running_totals(v, ["event_type", "value"], ["n"]).withColumn("below", F.col("cum_n") - F.col("n"))
    t = r.groupBy("event_type").agg(F.sum("n").alias("all"), F.min("below").alias("before")).where("all > 0")
    x = e.where("not sample").join(r, ["event_type", "value"]).join(t, "event_type")
    return x.select("event_id", F.round(100.0 * (F.col("below") - F.col("before")) / F.col("all"), 4).alias("percentile"))


@Q("SELECT vec_id, round((sum(x) OVER w - x) / (count(*) OVER w - 1), 6) AS others FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings) WINDOW w AS (PARTITION BY label)")
def leave_one_out_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean of all others of the group (W-22): totals are combined before the shuffle, then joined. A row alone in its group has none."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"))
    g = e.groupBy("label").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return e.join(g, "label").select("vec_id", F.round((F.col("s") - F.col("x")) / (F.nullif(F.col("n") - 1, F.lit(0))), 6).alias("others"))


@Q(f"""WITH {NOTES_SQL}, c AS (SELECT item, count(*) AS n FROM n GROUP BY item), s AS (SELECT item, n, unnest(list_distinct(list_append(range(0, greatest(n - 16, 0) + 1, 8), greatest(n - 16, 0)))) AS start FROM c)
    SELECT s.item, CAST(start AS INTEGER) AS start, count(*) AS size, round(avg(value), 6) AS mean FROM s JOIN n ON n.item = s.item AND n.pos - 1 >= start AND n.pos - 1 < start + 16 GROUP BY s.item, start""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of sixteen with stride eight, the last flush with the end (W-23, W-24, T-08). Elements go to their windows by arithmetic, not by a join."""
    n = notes(spark, d)
    c = n.groupBy("item").agg(F.count("*").cast("int").alias("n")).select("item", F.explode(S.sliding(F.col("n"), 16, 8)).alias("start"))
    x = n.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("a"))
    s = c.join(x, "item").select("item", "start", F.transform(F.slice("a", F.col("start") + 1, F.lit(16)), lambda e: e["value"]).alias("w"))
    return s.select("item", "start", F.size("w").cast("long").alias("size"), F.round(F.aggregate("w", F.lit(0.0), lambda acc, v: acc + v) / F.size("w"), 6).alias("mean"))


@Q(f"""SELECT item_id, region, CAST(turn AS INTEGER) AS turn, round((turn - 1) / n, 9) AS progress FROM (SELECT item_id, region, row_number() OVER (PARTITION BY region ORDER BY item_id) AS turn, count(*) OVER (PARTITION BY region) AS n FROM {REC})""")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a round-robin over groups, plain and in proportion to their size (W-25, O-02)."""
    r = recordings(spark, d, "region")
    return S.proportional_order(r, "region", [F.col("item_id")]).select("item_id", "region", "turn", F.round("progress", 9).alias("progress"))


MONO_SQL = "m AS (SELECT item, onset, least(dur, coalesce(lead(onset) OVER (PARTITION BY item ORDER BY onset) - onset, dur)) AS dur, pitch FROM (SELECT item, onset, max(struct_pack(p := pitch, d := dur)).p AS pitch, max(struct_pack(p := pitch, d := dur)).d AS dur FROM n GROUP BY item, onset))"


@Q(f"WITH {NOTES_SQL}, {MONO_SQL} SELECT item, round(onset, 6) AS onset, round(dur, 6) AS dur, pitch FROM m")
def monophony(spark: SparkSession, d: str) -> DataFrame:
    """The highest note of each onset, cut at the next (N-01, O-05)."""
    m = S.monophonic(notes(spark, d))
    return m.select("item", F.round("onset", 6).alias("onset"), F.round("dur", 6).alias("dur"), "pitch")


@Q(f"WITH {NOTES_SQL} SELECT item, CAST(pitch % 12 AS INTEGER) AS pc, round(sum(dur) / sum(sum(dur)) OVER (PARTITION BY item), 6) AS weight FROM n GROUP BY item, pitch % 12")
def weighted_pitch_classes(spark: SparkSession, d: str) -> DataFrame:
    """Pitch classes weighted by duration (A-30)."""
    return S.pitch_classes(notes(spark, d)).select("item", F.col("pc").cast("int").alias("pc"), F.round("weight", 6).alias("weight"))


# Weights of the scale degrees in the two tonic templates.
GONG = {0: 1.0, 2: 1.0, 4: 1.0, 7: 1.0, 9: 1.0, 5: 0.3, 11: 0.3}
FIVE = {0: 1.0, 2: 1.0, 4: 1.0, 7: 1.0, 9: 1.0}


def _tonic_sql(template: dict[int, float], order: str) -> str:
    t = ", ".join(f"({s}, {w})" for s, w in template.items())
    return f"""WITH {NOTES_SQL}, h AS (SELECT item, pitch % 12 AS pc, sum(dur) / sum(sum(dur)) OVER (PARTITION BY item) AS w FROM n GROUP BY item, pitch % 12), t(s, tw) AS (VALUES {t}), k AS (SELECT unnest(range(12)) AS k),
    sc AS (SELECT i.item, k, round(sum(coalesce(h.w, 0) * tw), 9) AS score, round(max(CASE WHEN s = 0 THEN coalesce(h.w, 0) END), 9) AS w0 FROM (SELECT DISTINCT item FROM n) i, k, t LEFT JOIN h ON h.item = i.item AND h.pc = (k.k + t.s) % 12 GROUP BY i.item, k)
    SELECT item, CAST(k AS INTEGER) AS tonic, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY item ORDER BY {order}) = 1"""


@Q(_tonic_sql(GONG, "score DESC, k"))
def tonic_by_template(spark: SparkSession, d: str) -> DataFrame:
    """The tonic whose template fits best, the first of equal ones (F-A04)."""
    b = S.best_rotation(S.pitch_classes(notes(spark, d)), GONG)
    return b.select("item", "tonic", F.round("score", 6).alias("score"))


@Q(_tonic_sql(FIVE, "score DESC, w0 DESC, k"))
def tonic_by_weight(spark: SparkSession, d: str) -> DataFrame:
    """The tonic by five degrees, of equal ones the one that sounds longer (N-04)."""
    b = S.best_rotation(S.pitch_classes(notes(spark, d)), FIVE, heavier_tonic=True)
    return b.select("item", "tonic", F.round("score", 6).alias("score"))


@Q(f"""WITH {NOTES_SQL}, i AS (SELECT item, pitch, dur, abs(pitch - lag(pitch) OVER (PARTITION BY item ORDER BY pos)) AS a FROM n), h AS (SELECT item, pitch % 12 AS pc, sum(dur) / sum(sum(dur)) OVER (PARTITION BY item) AS w FROM n GROUP BY item, pitch % 12)
    SELECT i.item, count(*) AS notes, max(pitch) - min(pitch) AS span, round(avg(CASE WHEN a IN (1, 2) THEN 1.0 ELSE 0 END) FILTER (WHERE a IS NOT NULL), 6) AS steps, round(avg(CASE WHEN a = 5 THEN 1.0 ELSE 0 END) FILTER (WHERE a IS NOT NULL), 6) AS fourths,
    round(avg(CASE WHEN a > 5 THEN 1.0 ELSE 0 END) FILTER (WHERE a IS NOT NULL), 6) AS leaps, any_value(g.degrees) AS degrees FROM i JOIN (SELECT item, count(*) FILTER (WHERE w >= 0.03) AS degrees FROM h GROUP BY item) g ON g.item = i.item GROUP BY i.item""")
def song_stats(spark: SparkSession, d: str) -> DataFrame:
    """Range, shares of steps, fourths and leaps, and degrees of each item (N-03, N-28)."""
    n = notes(spark, d)
    i = n.withColumn("a", F.abs(F.col("pitch") - F.lag("pitch").over(W())))
    share = lambda c, name: F.round(F.avg(F.when(F.col("a").isNotNull(), c.cast("int"))), 6).alias(name)
    g = i.groupBy("item").agg(F.count("*").alias("notes"), (F.max("pitch") - F.min("pitch")).alias("span"), share(F.col("a").isin(1, 2), "steps"), share(F.col("a") == 5, "fourths"), share(F.col("a") > 5, "leaps"))
    deg = S.pitch_classes(n).groupBy("item").agg(F.count_if(F.col("weight") >= 0.03).alias("degrees"))
    return g.join(deg, "item")


@Q(f"""WITH {NOTES_SQL}, i AS (SELECT *, lead(onset) OVER w - onset AS ioi, count(*) OVER (PARTITION BY item) AS c, row_number() OVER w AS r FROM n WINDOW w AS (PARTITION BY item ORDER BY onset)), m AS (SELECT item, median(ioi) AS m FROM i WHERE ioi > 0 GROUP BY item),
    k AS (SELECT i.*, sum(CASE WHEN ioi < 0.5 * m AND r > 1 AND c >= 4 THEN 0 ELSE 1 END) OVER (PARTITION BY i.item ORDER BY onset ROWS UNBOUNDED PRECEDING) AS k FROM i LEFT JOIN m ON m.item = i.item)
    SELECT item, round(min(onset), 6) AS onset, round(max(onset + dur) - min(onset), 6) AS dur, arg_min(pitch, onset) AS pitch FROM k GROUP BY item, k""")
def reduced_notes(spark: SparkSession, d: str) -> DataFrame:
    """Short notes absorbed by the kept note before them (N-05)."""
    a = S.absorb_short(notes(spark, d))
    return a.select("item", F.round("onset", 6).alias("onset"), F.round("dur", 6).alias("dur"), "pitch")


@Q(f"""WITH {NOTES_SQL}, x AS (SELECT item, pos, pitch - lag(pitch) OVER w AS iv, CASE WHEN lead(onset) OVER w - onset > 0 THEN lead(onset) OVER w - onset ELSE dur END AS d, lead(onset) OVER w - onset AS ioi FROM n WINDOW w AS (PARTITION BY item ORDER BY pos)), m AS (SELECT item, median(ioi) AS m FROM x WHERE ioi > 0 GROUP BY item)
    SELECT x.item, string_agg(CASE WHEN iv IS NULL THEN '^' WHEN iv = 0 THEN 'S' WHEN iv > 2 THEN 'U' WHEN iv > 0 THEN 'u' WHEN iv < -2 THEN 'D' ELSE 'd' END || CAST(CAST(least(greatest(round_even(log2(greatest(d, 1e-4) / m), 0), -2), 3) AS INTEGER) AS VARCHAR), ' ' ORDER BY pos) AS tokens
    FROM x JOIN m ON m.item = x.item GROUP BY x.item""")
def contour_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Token sequences of contour and relative duration (N-06, N-07, S-26)."""
    ioi = F.lead("onset").over(W()) - F.col("onset")
    x = notes(spark, d).select("item", "pos", "dur", (F.col("pitch") - F.lag("pitch").over(W())).alias("iv"), ioi.alias("ioi"))
    m = x.where("ioi > 0").groupBy("item").agg(F.percentile("ioi", 0.5).alias("m"))
    x = x.join(m, "item").withColumn("t", F.concat(F.coalesce(S.contour_letter(F.col("iv")), F.lit("^")), S.relative_duration_bin(F.col("ioi"), F.col("dur"), F.col("m")).cast("string")))
    return x.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("a")).select("item", F.array_join(F.transform("a", lambda e: e["t"]), " ").alias("tokens"))


@Q(f"""WITH {NOTES_SQL}, x AS (SELECT item, pos, value, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS voiced, count(*) OVER (PARTITION BY item) AS c FROM n), g AS (SELECT item, count(*) AS frames, avg(voiced) AS voiced, count(*) FILTER (WHERE voiced = 1 AND pos > 0.2 * c AND pos <= 0.8 * c) AS core,
    median(value) FILTER (WHERE voiced = 1 AND pos > 0.2 * c AND pos <= 0.8 * c) AS m, any_value(c) AS c FROM x GROUP BY item)
    SELECT item, core, round(m - 60, 4) AS dev, CASE WHEN voiced < 0.2 THEN 'unvoiced' WHEN core < 5 THEN 'uncertain' WHEN abs(m - 60) >= 0.5 AND round_even(m, 0) <> 60 THEN CASE WHEN abs(abs(m - 60) - 12) < 1 THEN 'octave_error' ELSE 'wrong_pitch' END ELSE 'ok' END AS verdict FROM g""")
def frame_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A verdict per item from the frames of its middle part: voiced share, median, deviation (N-15, N-18, P-14)."""
    x = notes(spark, d).withColumns({"voiced": (F.col("event_type") != "error").cast("int"), "c": F.count("*").over(Window.partitionBy("item"))})
    core = (F.col("voiced") == 1) & (F.col("pos") > 0.2 * F.col("c")) & (F.col("pos") <= 0.8 * F.col("c"))
    g = x.groupBy("item").agg(F.avg("voiced").alias("voiced"), F.count_if(core).alias("core"), F.percentile(F.when(core, F.col("value")), 0.5).alias("m"))
    dev = F.col("m") - 60
    wrong = F.when(F.abs(F.abs(dev) - 12) < 1, "octave_error").otherwise("wrong_pitch")
    v = F.when(F.col("voiced") < 0.2, "unvoiced").when(F.col("core") < 5, "uncertain").when((F.abs(dev) >= 0.5) & (F.bround("m", 0) != 60), wrong).otherwise("ok")
    return g.select("item", "core", F.round(dev, 4).alias("dev"), v.alias("verdict"))


@Q(f"""WITH {NOTES_SQL}, s AS (SELECT item, pos, CASE WHEN count(value) OVER f >= 3 THEN avg(value) OVER f END AS v FROM n WINDOW f AS (PARTITION BY item ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), g AS (SELECT item, v, abs(v - lag(v) OVER (PARTITION BY item ORDER BY pos)) AS step FROM s),
    b AS (SELECT item, CAST(floor(v) % 12 AS INTEGER) AS pc, v - floor(v) AS frac FROM g WHERE step < 40 AND v IS NOT NULL)
    SELECT item, pc, count(*) AS frames, CASE WHEN count(*) >= 5 THEN round(quantile_cont(frac, 0.75) - quantile_cont(frac, 0.25), 6) END AS spread, round(atan2(avg(sin(2 * pi() * frac)), avg(cos(2 * pi() * frac))) / (2 * pi()), 5) AS tuning FROM b GROUP BY item, pc""")
def intonation_profile(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed frames, steady ones kept, tuning and spread per pitch class (N-19, A-36, A-37)."""
    s = notes(spark, d).select("item", "pos", S.centred_mean(F.col("value"), W(), 2, 3).alias("v"))
    g = s.withColumn("step", F.abs(F.col("v") - F.lag("v").over(W()))).where("step < 40 and v is not null")
    b = g.select("item", (F.floor("v") % 12).cast("int").alias("pc"), (F.col("v") - F.floor("v")).alias("frac"))
    a = 2 * F.pi() * F.col("frac")
    return b.groupBy("item", "pc").agg(F.count("*").alias("frames"), F.when(F.count("*") >= 5, F.round(F.percentile("frac", 0.75) - F.percentile("frac", 0.25), 6)).alias("spread"), F.round(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))) / (2 * F.pi()), 5).alias("tuning"))


@Q(f"""WITH {NOTES_SQL} SELECT item, round(sum(dur) / nullif(max(onset + dur), 0), 6) AS coverage, round(sum(abs(value - 100)), 4) AS roughness, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END), 6) AS voiced FROM n GROUP BY item""")
def coverage_of_items(spark: SparkSession, d: str) -> DataFrame:
    """Covered share and surface statistics of items (N-20, N-26, N-27)."""
    return notes(spark, d).groupBy("item").agg(F.round(F.sum("dur") / F.nullif(F.max(F.col("onset") + F.col("dur")), F.lit(0.0)), 6).alias("coverage"), F.round(F.sum(F.abs(F.col("value") - 100)), 4).alias("roughness"), F.round(F.avg((F.col("event_type") == "click").cast("int")), 6).alias("voiced"))


@Q(f"""WITH {NOTES_SQL}, c AS (SELECT item % 3 AS cls, event_type AS tok, count(DISTINCT item) AS df FROM n GROUP BY ALL), t AS (SELECT item % 3 AS cls, count(DISTINCT item) AS items FROM n GROUP BY 1)
    SELECT c.cls, tok, round(df / items, 6) AS share FROM c JOIN t ON t.cls = c.cls WHERE df / items >= 0.5""")
def tokens_of_classes(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that at least half of the items of a class hold (N-23)."""
    n = notes(spark, d).withColumn("cls", F.col("item") % 3)
    c = n.groupBy("cls", F.col("event_type").alias("tok")).agg(F.count_distinct("item").alias("df"))
    t = n.groupBy("cls").agg(F.count_distinct("item").alias("items"))
    return c.join(t, "cls").select("cls", "tok", F.round(F.col("df") / F.col("items"), 6).alias("share"), (F.col("df") / F.col("items")).alias("x")).where("x >= 0.5").drop("x")


QUERIES, SQL = Q.queries, Q.sql
