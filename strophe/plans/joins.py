"""Joins and set operations (survey groups J and E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strophe.functions.columns import norm_title
from strophe.functions.text import present
from strophe.operators.ordered import number_rows
from strophe.operators.relational import contained_pairs, keep_first, keep_last, lookup, nearest_join, overlap_join, pairs_within, replace_by_key, upsert_registry
from strophe.plans.registry import REC, Registry, recordings, sql_present, table

Q = Registry()
NORM = "lower(regexp_replace(regexp_replace(regexp_replace({c}, '^\\d+[_\\-\\s.]*', ''), '[（(\\[][^）)\\]]*[）)\\]]', '', 'g'), '[\\s《》·,，.。''\"-]', '', 'g'))"


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their time in seconds."""
    return table(spark, d, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


SEC = "(epoch_us(ts) / 1e6)"


@Q("SELECT o_orderkey, o_custkey, c_name, c_mktsegment, l_linenumber, l_quantity FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) l ON l_orderkey = o_orderkey AND l_linenumber = o_custkey % 7 + 1")
def left_joins(spark: SparkSession, d: str) -> DataFrame:
    """Left equi-joins on one and on two keys (J-01, J-02)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 7 + 1).cast("int").alias("l_linenumber"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"), F.first("l_linenumber").alias("n"))
    j = o.join(c, "o_custkey", "left").join(li, ["o_orderkey", "l_linenumber"], "left")
    return j.select("o_orderkey", "o_custkey", "c_name", "c_mktsegment", F.col("n").alias("l_linenumber"), "l_quantity")


@Q(f"""SELECT r.item_id, l.status, l.available FROM {REC} r LEFT JOIN (SELECT item_id, status, available FROM link_status
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY checked_on DESC, loaded_at DESC, coalesce(status, '') DESC, coalesce(available, false) DESC) = 1) l ON l.item_id = r.item_id""")
def lookup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """A lookup in which the last of duplicate keys wins (J-04)."""
    ls = table(spark, d, "link_status")
    order = [F.col("checked_on"), F.col("loaded_at"), F.coalesce("status", F.lit("")), F.coalesce("available", F.lit(False))]
    return lookup(recordings(spark, d), ls, ["item_id"], order, ["status", "available"]).select("item_id", "status", "available")


@Q(f"""WITH s AS (SELECT region, song_key, count(*) AS n, max(duration_s) FILTER (WHERE NOT isnan(duration_s)) AS longest, min(item_id) AS first_item, count(DISTINCT singer_id) AS singers FROM {REC} GROUP BY ALL)
    SELECT r.item_id, s.n, s.longest, s.first_item, s.singers FROM {REC} r LEFT JOIN s ON s.region = r.region AND s.song_key = r.song_key""")
def composite_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Several columns of a song table looked up by a composite key (J-05, J-08)."""
    r = recordings(spark, d, "region", "song_key", "duration_s", "singer_id")
    s = r.groupBy("region", "song_key").agg(F.count("*").alias("n"), F.max(F.when(~F.isnan("duration_s"), F.col("duration_s"))).alias("longest"), F.min("item_id").alias("first_item"), F.count_distinct("singer_id").alias("singers"))
    return r.join(s, ["region", "song_key"], "left").select("item_id", "n", "longest", "first_item", "singers")


@Q("SELECT DISTINCT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows that have a partner (J-06)."""
    o = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name").distinct()


@Q(f"SELECT item_id, song_key FROM {REC} r WHERE song_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM scores s WHERE s.song_key = r.song_key)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows that have no partner (J-07)."""
    r = recordings(spark, d, "song_key").where("song_key is not null")
    return r.join(table(spark, d, "scores").select("song_key"), "song_key", "left_anti").select("item_id", "song_key")


@Q(f"""WITH r AS (SELECT DISTINCT song_key AS k, {NORM.format(c='song_key')} AS n FROM recordings WHERE {sql_present('song_key')} IS NOT NULL AND NOT contains(song_key, '#')),
    s AS (SELECT DISTINCT song_key AS k, {NORM.format(c='song_key')} AS n FROM scores WHERE {sql_present('song_key')} IS NOT NULL),
    c AS (SELECT r.k AS a, s.k AS b, 0 AS rank FROM r JOIN s ON r.k = s.k UNION ALL SELECT r.k, s.k, 1 FROM r JOIN s ON r.n = s.n
          UNION ALL SELECT r.k, s.k, 2 FROM r JOIN s ON r.k <> s.k AND length(r.k) >= 3 AND length(s.k) >= 3 AND
            ((contains(s.k, r.k) AND length(r.k) >= 0.5 * length(s.k)) OR (contains(r.k, s.k) AND length(s.k) >= 0.5 * length(r.k))))
    SELECT a AS song_key, b AS score_key, min(rank) AS rank FROM c GROUP BY ALL""")
def priority_match(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of several kinds (exact, normalised, contained), each pair with its best rank (J-09, J-10, J-12)."""
    r = recordings(spark, d, "song_key").where(present("song_key").isNotNull() & ~F.col("song_key").contains("#")).select(F.col("song_key").alias("a")).distinct()
    s = table(spark, d, "scores").where(present("song_key").isNotNull()).select(F.col("song_key").alias("b")).distinct()
    exact = r.join(s, F.col("a") == F.col("b")).select("a", "b", F.lit(0).alias("rank"))
    norm = r.withColumn("n", norm_title(F.col("a"))).join(s.withColumn("n", norm_title(F.col("b"))), "n").select("a", "b", F.lit(1).alias("rank"))
    inside = contained_pairs(r, s, ("a", "b"), ("a", "b")).select("a", "b").unionAll(contained_pairs(s, r, ("b", "a"), ("b", "a")).select("a", "b")).where("a <> b").select("a", "b", F.lit(2).alias("rank"))
    return exact.unionAll(norm).unionAll(inside).groupBy(F.col("a").alias("song_key"), F.col("b").alias("score_key")).agg(F.min("rank").alias("rank"))


@Q(f"""WITH c AS (SELECT DISTINCT county_or_area AS area, province FROM recordings WHERE {sql_present('county_or_area')} IS NOT NULL),
    g AS (SELECT adcode, level, province AS p, left(name, length(name) - 1) AS short FROM gazetteer WHERE level <> 'province')
    SELECT area, c.province, adcode FROM c JOIN g ON contains(area, short) AND p = c.province
    QUALIFY row_number() OVER (PARTITION BY area, c.province ORDER BY CASE level WHEN 'county' THEN 0 ELSE 1 END, length(short) DESC, adcode) = 1""")
def gazetteer_contained(spark: SparkSession, d: str) -> DataFrame:
    """Place names found in a text: province agrees, finest level then longest name wins (J-13). Blocked by the first two characters of the name."""
    c = recordings(spark, d, "county_or_area", "province").where(present("county_or_area").isNotNull()).select(F.col("county_or_area").alias("area"), "province").distinct()
    g = table(spark, d, "gazetteer").where("level <> 'province'").select("adcode", "level", F.col("province"), F.expr("left(name, length(name) - 1)").alias("short"))
    grams = c.withColumn("g", F.explode(F.expr("array_distinct(transform(sequence(1, greatest(1, length(area) - 1)), i -> substring(area, i, 2)))")))
    hit = grams.join(g.withColumn("g", F.substring("short", 1, 2)), ["g", "province"]).where(F.col("area").contains(F.col("short")))
    rank = F.struct(F.when(F.col("level") == "county", 0).otherwise(1), -F.length("short"), F.col("adcode"))
    return hit.groupBy("area", "province").agg(F.min_by("adcode", rank).alias("adcode"))


KEYS = ["山歌", "民歌", "渔歌", "号子", "调"]


@Q(f"""SELECT item_id, k.key AS key FROM {REC} r JOIN (SELECT unnest({KEYS}) AS key, unnest(range(1, {len(KEYS) + 1})) AS ord) k ON contains(r.title, k.key) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ord) = 1""")
def first_keyword(spark: SparkSession, d: str) -> DataFrame:
    """The first key of an ordered list that occurs in a text (J-14): an expression, since the list is a fixed handful."""
    found = F.filter(F.array(*[F.lit(k) for k in KEYS]), lambda k: F.col("title").contains(k))
    return recordings(spark, d, "title").select("item_id", F.try_element_at(found, F.lit(1)).alias("key")).where("key is not null")


@Q(f"SELECT a.song_key, a.item_id AS item_id_a, b.item_id AS item_id_b FROM {REC} a JOIN {REC} b ON a.song_key = b.song_key AND a.region = b.region AND a.item_id < b.item_id")
def pairs_in_groups(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of recordings of one song and region (J-15); a hot song is dealt over several tasks."""
    r = recordings(spark, d, "song_key", "region")
    return pairs_within(r, ["song_key", "region"], "item_id").select("song_key", "item_id_a", "item_id_b")


@Q("SELECT a.r_name AS name_a, b.r_name AS name_b, abs(a.n - b.n) AS gap FROM (SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name) a JOIN (SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name) b ON a.r_name < b.r_name")
def group_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a handful of groups (J-16); gathered in one list, since there are as many as regions of the world."""
    g = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    all_ = g.agg(F.sort_array(F.collect_list(F.struct("r_name", "n"))).alias("l"))
    p = all_.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).where("a.r_name < b.r_name")
    return p.select(F.col("a.r_name").alias("name_a"), F.col("b.r_name").alias("name_b"), F.abs(F.col("a.n") - F.col("b.n")).alias("gap"))


@Q(f"""WITH e AS (SELECT *, {SEC} AS s FROM events), a AS (SELECT event_id, user_id, s, s + 600 AS e FROM e WHERE event_type = 'error'), b AS (SELECT event_id, user_id, s, s + 1200 AS e FROM e WHERE event_type = 'click')
    SELECT a.event_id AS event_id, b.event_id AS event_id_b, round((least(a.e, b.e) - greatest(a.s, b.s)) / (a.e - a.s), 6) AS share FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping intervals of two kinds within a user, with the share of the first (J-17); bucketed range join."""
    e = events(spark, d)
    a = e.where("event_type = 'error'").select("event_id", "user_id", F.col("sec").alias("s"), (F.col("sec") + 600).alias("e"))
    b = e.where("event_type = 'click'").select("event_id", "user_id", F.col("sec").alias("s"), (F.col("sec") + 1200).alias("e"))
    o = overlap_join(a, b, ["user_id"], 3600.0, ("s", "e"), ("s", "e"))
    return o.select("event_id", "event_id_b", F.round((F.least("e", "e_b") - F.greatest("s", "s_b")) / (F.col("e") - F.col("s")), 6).alias("share"))


@Q(f"""WITH e AS (SELECT *, {SEC} AS s FROM events), n AS (SELECT event_id, user_id, s, s + 7200 AS e FROM e WHERE event_type = 'purchase')
    SELECT n.event_id, count(f.event_id) AS frames, round(avg(f.value), 6) AS mean_value FROM n LEFT JOIN e f ON f.user_id = n.user_id AND f.s >= n.s AND f.s < n.e GROUP BY n.event_id""")
def frames_in_notes(spark: SparkSession, d: str) -> DataFrame:
    """Points assigned to the intervals that hold them, with aggregates per interval (J-18)."""
    e = events(spark, d)
    n = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("sec").alias("s"), (F.col("sec") + 7200).alias("e"))
    f = e.select("user_id", F.col("sec").alias("s"), (F.col("sec") + 1e-3).alias("e"), "value")
    o = overlap_join(n, f, ["user_id"], 7200.0, ("s", "e"), ("s", "e")).where("s_b >= s")
    g = o.groupBy("event_id").agg(F.count("*").alias("frames"), F.round(F.avg("value_b"), 6).alias("mean_value"))
    return n.select("event_id").join(g, "event_id", "left").select("event_id", F.coalesce("frames", F.lit(0)).alias("frames"), "mean_value")


@Q(f"""WITH e AS (SELECT *, {SEC} AS s FROM events), a AS (SELECT event_id, user_id, s FROM e WHERE event_type = 'error'), b AS (SELECT user_id, s FROM e WHERE event_type = 'click')
    SELECT a.event_id, round(arg_min(b.s - a.s, (abs(b.s - a.s), b.s)), 3) AS offset_s FROM a LEFT JOIN b ON a.user_id = b.user_id GROUP BY a.event_id""")
def nearest_event(spark: SparkSession, d: str) -> DataFrame:
    """The nearest event of another kind before or after (J-19): one sort of the union instead of pairs."""
    e = events(spark, d)
    a = e.where("event_type = 'error'").select("event_id", "user_id", "sec")
    b = e.where("event_type = 'click'").select("user_id", "sec")
    n = nearest_join(a, b, ["user_id"], "sec", "sec")
    return n.select("event_id", F.round(F.col("nearest") - F.col("sec"), 3).alias("offset_s"))


@Q("SELECT r_name, t.event_type, v.variant, EXISTS (SELECT 1 FROM events e WHERE e.event_type = t.event_type AND e.user_id % 5 = r_regionkey AND (v.variant = 'raw' OR e.value > 100)) AS present FROM region, (SELECT DISTINCT event_type FROM events) t, (SELECT unnest(['raw', 'large']) AS variant) v")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Every item, layer and variant, and whether it exists (J-21, K-10). Only small dimensions are multiplied, as array literals."""
    ev = table(spark, d, "events").select("event_type", (F.col("user_id") % 5).cast("int").alias("r_regionkey"), F.explode(F.when(F.col("value") > 100, F.array(F.lit("raw"), F.lit("large"))).otherwise(F.array(F.lit("raw")))).alias("variant")).distinct().withColumn("p", F.lit(True))
    kinds = table(spark, d, "events").agg(F.collect_set("event_type").alias("t"))
    dims = table(spark, d, "region").crossJoin(F.broadcast(kinds)).select("r_regionkey", "r_name", F.explode("t").alias("event_type")).withColumn("variant", F.explode(F.array(F.lit("raw"), F.lit("large"))))
    return dims.join(ev, ["event_type", "r_regionkey", "variant"], "left").select("r_name", "event_type", "variant", F.coalesce("p", F.lit(False)).alias("present"))


@Q("SELECT DISTINCT item_id, platform, available, status FROM link_status WHERE CAST(checked_on AS DATE) = (SELECT max(CAST(checked_on AS DATE)) FROM link_status)")
def latest_day(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the latest day, by an uncorrelated scalar subquery (J-22)."""
    ls = table(spark, d, "link_status").withColumn("day", F.to_date("checked_on"))
    top = ls.agg(F.max("day").alias("day"))
    return ls.join(F.broadcast(top), "day").select("item_id", "platform", "available", "status").distinct()


@Q(f"""WITH r AS (SELECT item_id, fold, song_key FROM {REC} WHERE fold IS NOT NULL AND song_key IS NOT NULL), f AS (SELECT unnest(range(5)) AS test_fold)
    SELECT test_fold, count(*) AS train FROM r, f WHERE r.fold <> test_fold AND NOT EXISTS (SELECT 1 FROM r t WHERE t.fold = test_fold AND t.song_key = r.song_key) GROUP BY test_fold""")
def leak_free_training(spark: SparkSession, d: str) -> DataFrame:
    """Per test fold the training rows whose song is not in it (J-23, J-24): one anti-join on (fold, song)."""
    r = recordings(spark, d, "fold", "song_key").where("fold is not null and song_key is not null")
    t = r.select(F.col("fold").cast("int").alias("test_fold"), "song_key").distinct()
    x = r.withColumn("test_fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("fold <> test_fold")
    return x.join(t, ["test_fold", "song_key"], "left_anti").groupBy("test_fold").agg(F.count("*").alias("train"))


@Q(f"""WITH a AS (SELECT song_key, list(DISTINCT province) AS p FROM {REC} WHERE song_key IS NOT NULL AND {sql_present("province")} IS NOT NULL GROUP BY song_key), b AS (SELECT song_key, list(DISTINCT province) AS p FROM scores WHERE song_key IS NOT NULL AND {sql_present("province")} IS NOT NULL GROUP BY song_key)
    SELECT a.song_key, list_has_any(a.p, b.p) AS same_province FROM a JOIN b ON a.song_key = b.song_key""")
def set_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Whether two set-valued columns meet (J-25, F-A02)."""
    g = lambda df, n: df.where("song_key is not null").where(present("province").isNotNull()).groupBy("song_key").agg(F.collect_set("province").alias(n))
    return g(recordings(spark, d, "song_key", "province"), "a").join(g(table(spark, d, "scores"), "b"), "song_key").select("song_key", F.arrays_overlap("a", "b").alias("same_province"))


@Q(f"""WITH s AS (SELECT song_key, string_agg(item_id, '; ' ORDER BY item_id) AS ids FROM {REC} WHERE song_key IS NOT NULL GROUP BY song_key), x AS (SELECT song_key, unnest(string_split(ids, '; ')) AS item_id FROM s)
    SELECT x.song_key, CASE WHEN count(DISTINCT region) = 1 THEN min(region) END AS region FROM x JOIN {REC} r ON r.item_id = x.item_id GROUP BY x.song_key""")
def reverse_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Ids in a delimited list looked up again; the region where all agree (J-26, F-A01)."""
    r = recordings(spark, d, "song_key", "region")
    s = r.where("song_key is not null").groupBy("song_key").agg(F.array_join(F.sort_array(F.collect_list("item_id")), "; ").alias("ids"))
    x = s.select("song_key", F.explode(F.split("ids", "; ")).alias("item_id"))
    g = x.join(r.select("item_id", "region"), "item_id").groupBy("song_key").agg(F.collect_set("region").alias("u"))
    return g.select("song_key", F.when(F.size("u") == 1, F.element_at("u", 1)).alias("region"))


@Q(f"""SELECT * FROM (SELECT 'both' AS part, count(*) AS n FROM (SELECT song_key FROM recordings WHERE song_key IS NOT NULL INTERSECT SELECT song_key FROM scores)
    UNION ALL SELECT 'recordings_only', count(*) FROM (SELECT song_key FROM recordings WHERE song_key IS NOT NULL EXCEPT SELECT song_key FROM scores)
    UNION ALL SELECT 'scores_only', count(*) FROM (SELECT song_key FROM scores WHERE song_key IS NOT NULL EXCEPT SELECT song_key FROM recordings))""")
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Keys of both, and of either side only, from one aggregation of the union (E-03)."""
    a = table(spark, d, "recordings").select("song_key", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = table(spark, d, "scores").select("song_key", F.lit(0).alias("a"), F.lit(1).alias("b"))
    k = a.unionAll(b).where("song_key is not null").groupBy("song_key").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    part = F.when(F.col("a") + F.col("b") == 2, "both").when(F.col("a") == 1, "recordings_only").otherwise("scores_only")
    return k.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@Q("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1")
def keyed_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """One row per key, the first in a total order (E-04)."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice")
    k = keep_first(li, ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")])
    return k.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@Q("SELECT item_id, checked_on, status FROM (SELECT DISTINCT * FROM link_status) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY loaded_at DESC, checked_on DESC, coalesce(status, '') DESC) = 1")
def keyed_dedup_last(spark: SparkSession, d: str) -> DataFrame:
    """One row per key, the last in a total order (E-04, T-06)."""
    ls = table(spark, d, "link_status").select("item_id", "checked_on", "loaded_at", "status").distinct()
    return keep_last(ls, ["item_id"], [F.col("loaded_at"), F.col("checked_on"), F.coalesce("status", F.lit(""))]).select("item_id", "checked_on", "status")


@Q("SELECT item_id, count(*) AS rows FROM recordings GROUP BY item_id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of more than one row (E-05, E-11)."""
    return table(spark, d, "recordings").groupBy("item_id").agg(F.count("*").alias("rows")).where("rows > 1")


@Q(f"""WITH n AS (SELECT platform, item_id, regexp_replace({NORM.format(c='title')}, '[0-9#:：]', '', 'g') AS k FROM {REC} WHERE title IS NOT NULL)
    SELECT platform, k AS norm, count(*) AS n, min(item_id) AS first_item FROM n WHERE length(k) > 2 GROUP BY ALL HAVING count(*) > 1""")
def normalised_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Groups of equal normalised text within a source (E-06)."""
    k = F.regexp_replace(norm_title(F.col("title")), "[0-9#:：]", "")
    n = recordings(spark, d, "platform", "title").where("title is not null").select("platform", "item_id", k.alias("norm")).where(F.length("norm") > 2)
    return n.groupBy("platform", "norm").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item")).where("n > 1")


@Q(f"""WITH s AS (SELECT DISTINCT song_key FROM {REC} WHERE song_key IS NOT NULL AND NOT contains(song_key, '#')), old AS (SELECT song_key, row_number() OVER (ORDER BY song_key) AS song_no FROM (SELECT DISTINCT song_key FROM scores WHERE song_key IS NOT NULL)),
    fresh AS (SELECT song_key FROM s WHERE song_key NOT IN (SELECT song_key FROM old))
    SELECT song_key, song_no FROM old UNION ALL SELECT song_key, row_number() OVER (ORDER BY song_key) + (SELECT max(song_no) FROM old) FROM fresh""")
def song_registry(spark: SparkSession, d: str) -> DataFrame:
    """A registry keeps the numbers of known keys and numbers new ones from max+1 (K-06, E-08)."""
    keys = table(spark, d, "scores").where("song_key is not null").select("song_key").distinct()
    old = number_rows(keys, ["song_key"], "song_no")
    new = recordings(spark, d, "song_key").where("song_key is not null and not contains(song_key, '#')")
    return upsert_registry(old, new, ["song_key"], "song_no", [F.col("song_key")])


@Q("""SELECT event_id, user_id, event_type, value FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 480) UNION ALL SELECT event_id, user_id, 'rescored', value FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 480)""")
def replaced_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the keys just written replace those of an earlier run (K-05)."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    again = e.join(e.where("value > 480").select("user_id").distinct(), "user_id", "left_semi").withColumn("event_type", F.lit("rescored"))
    return replace_by_key(e, again, ["user_id"])


@Q(f"""SELECT item_id, CASE WHEN label_status = 'exclude' THEN 'disputed' WHEN song_label_check = 'corrected' THEN 'corrected' WHEN song_label_confidence IN ('high', 'medium') THEN 'verified' WHEN song_label_check IS NOT NULL AND song_label_check <> '' THEN 'reviewed' ELSE 'unchecked' END AS check_state FROM {REC}""")
def check_state(spark: SparkSession, d: str) -> DataFrame:
    """Membership in several id sets by priority (E-10)."""
    r = recordings(spark, d, "label_status", "song_label_check", "song_label_confidence")
    flag = lambda cond, name: r.where(cond).select("item_id", F.lit(True).alias(name))
    x = r.select("item_id").join(flag("label_status = 'exclude'", "a"), "item_id", "left").join(flag("song_label_check = 'corrected'", "b"), "item_id", "left")
    x = x.join(flag("song_label_confidence in ('high', 'medium')", "c"), "item_id", "left").join(flag("song_label_check is not null and song_label_check <> ''", "d"), "item_id", "left")
    return x.select("item_id", F.when(F.col("a"), "disputed").when(F.col("b"), "corrected").when(F.col("c"), "verified").when(F.col("d"), "reviewed").otherwise("unchecked").alias("check_state"))


QUERIES, SQL = Q.queries, Q.sql
