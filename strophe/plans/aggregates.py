"""Aggregations, pivots, coverage and sorts on the recordings (survey groups A, O and parts of P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from strophe.functions.columns import percent
from strophe.functions.text import is_missing, number_present, present
from strophe.operators.quality import coverage_long, coverage_wide
from strophe.operators.relational import pivot_counts, reindex
from strophe.plans.registry import REC, Registry, recordings, sql_present, table

Q = Registry()
TEXT_FIELDS = ["title", "channel", "province", "county_or_area", "song_name", "singer", "genre", "composer", "ethnic_group"]
PLATFORMS = ["danmu", "soundvault", "vidhub"]


def _sql_filled(c: str) -> str:
    return f"count({sql_present(c)})"


@Q("SELECT platform, count(*) AS total, " + ", ".join(f"count({sql_present(c)}) AS n_{c}, round_even(100.0 * count({sql_present(c)}) / greatest(count(*), 1), 1) AS pct_{c}" for c in TEXT_FIELDS) + f" FROM {REC} GROUP BY platform")
def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Filled cells per platform and field, absolute and in percent, in one scan and one shuffle (A-05, A-07, P-09, P-18)."""
    return coverage_wide(recordings(spark, d, "platform", *TEXT_FIELDS), "platform", TEXT_FIELDS)


@Q("SELECT platform, field, count(*) AS total, count(v) AS filled FROM (" + " UNION ALL ".join(f"SELECT platform, '{c}' AS field, {sql_present(c)} AS v FROM {REC}" for c in TEXT_FIELDS) + ") GROUP BY platform, field")
def coverage_by_field(spark: SparkSession, d: str) -> DataFrame:
    """The coverage matrix in long form (A-07, A-24)."""
    return coverage_long(recordings(spark, d, "platform", *TEXT_FIELDS), "platform", TEXT_FIELDS)


@Q("SELECT field, count(v) AS filled, round_even(100.0 * count(v) / count(*), 1) AS pct, string_agg(DISTINCT CASE WHEN v IS NOT NULL THEN platform END, ',' ORDER BY CASE WHEN v IS NOT NULL THEN platform END) AS platforms_with FROM (" + " UNION ALL ".join(f"SELECT platform, '{c}' AS field, {sql_present(c)} AS v FROM {REC}" for c in TEXT_FIELDS) + ") GROUP BY field")
def gap_report(spark: SparkSession, d: str) -> DataFrame:
    """Per field: filled cells, share, and the platforms that fill it at all (A-39, K-07)."""
    long = coverage_long(recordings(spark, d, "platform", *TEXT_FIELDS), "platform", TEXT_FIELDS)
    g = long.groupBy("field").agg(F.sum("filled").alias("filled"), F.sum("total").alias("total"), F.sort_array(F.collect_set(F.when(F.col("filled") > 0, F.col("platform")))).alias("p"))
    return g.select("field", "filled", percent(F.col("filled"), F.col("total")).alias("pct"), F.array_join("p", ",").alias("platforms_with"))


@Q(f"SELECT region, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM {REC} WHERE region IS NOT NULL GROUP BY region")
def value_counts_share(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies and shares of a column, nulls left out (A-01, A-02, A-03)."""
    g = recordings(spark, d, "region").where("region is not null").groupBy("region").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@Q(f"""WITH c AS (SELECT region, genre, count(*) AS n FROM {REC} WHERE {sql_present("genre")} IS NOT NULL GROUP BY ALL),
    t AS (SELECT region, sum(n) AS total, max(n) AS n FROM c GROUP BY region)
    SELECT t.region, min(genre) AS genre, any_value(t.n) AS n, round(any_value(t.n) / any_value(total), 6) AS share FROM t JOIN c ON c.region IS NOT DISTINCT FROM t.region AND c.n = t.n
    GROUP BY t.region HAVING any_value(total) > 20""")
def dominant_value(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent genre of each region of more than 20 and its share; of equal ones the smallest (A-03, A-26)."""
    c = recordings(spark, d, "region", "genre").where(present("genre").isNotNull()).groupBy("region", "genre").agg(F.count("*").alias("n"))
    g = c.groupBy("region").agg(F.sum("n").alias("total"), F.min_by(F.struct("genre", "n"), F.struct(-F.col("n"), F.col("genre"))).alias("b"))
    return g.where("total > 20").select("region", "b.genre", "b.n", F.round(F.col("b.n") / F.col("total"), 6).alias("share"))


@Q(f"""SELECT region, count(*) AS n, round(sum(x) / 3600, 4) AS hours, round(avg(x), 4) AS mean_s, round(median(x), 4) AS median_s, round(quantile_cont(x, 0.9), 4) AS p90_s,
    round(min(x), 4) AS min_s, round(max(x), 4) AS max_s, count(DISTINCT song_key) AS songs
    FROM (SELECT region, song_key, CASE WHEN duration_s IS NOT NULL AND NOT isnan(duration_s) AND duration_s > 0 THEN duration_s END AS x FROM {REC}) GROUP BY region""")
def named_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Several named aggregates of one group in one pass: hours, mean, median, quantile, extremes, distinct keys (A-04, A-08, A-09, A-17, F-D05)."""
    x = recordings(spark, d, "region", "song_key", "duration_s").withColumn("x", number_present("duration_s")).withColumn("x", F.expr("if(x > 0, x, null)"))
    r = lambda c, name: F.round(c, 4).alias(name)
    return x.groupBy("region").agg(
        F.count("*").alias("n"), r(F.sum("x") / 3600, "hours"), r(F.avg("x"), "mean_s"), r(F.percentile("x", 0.5), "median_s"), r(F.percentile("x", 0.9), "p90_s"),
        r(F.min("x"), "min_s"), r(F.max("x"), "max_s"), F.count_distinct("song_key").alias("songs"),
    )


@Q(f"""WITH c AS (SELECT song_key, region, count(*) AS n FROM {REC} WHERE song_key IS NOT NULL AND region IS NOT NULL GROUP BY ALL)
    SELECT song_key, region AS main_region FROM c QUALIFY row_number() OVER (PARTITION BY song_key ORDER BY n DESC, region) = 1""")
def mode_per_song(spark: SparkSession, d: str) -> DataFrame:
    """The mode of a column per group, the smallest of tied values (A-10)."""
    c = recordings(spark, d, "song_key", "region").where("song_key is not null and region is not null").groupBy("song_key", "region").agg(F.count("*").alias("n"))
    return c.groupBy("song_key").agg(F.min_by("region", F.struct(-F.col("n"), F.col("region"))).alias("main_region"))


@Q(f"""WITH f AS (SELECT song_key, singer, min(item_id) AS o FROM {REC} WHERE song_key IS NOT NULL AND {sql_present("singer")} IS NOT NULL GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY song_key ORDER BY o, singer) AS r FROM f)
    SELECT song_key, string_agg(singer, '; ' ORDER BY r) AS singers FROM k WHERE r <= 6 GROUP BY song_key""")
def first_distinct_values(spark: SparkSession, d: str) -> DataFrame:
    """The first six distinct singers of each song in order of first occurrence, joined (A-11, E-09). Only distinct values are ranked."""
    f = recordings(spark, d, "song_key", "singer").where("song_key is not null").where(present("singer").isNotNull()).groupBy("song_key", "singer").agg(F.min("item_id").alias("o"))
    k = f.withColumn("r", F.row_number().over(Window.partitionBy("song_key").orderBy("o", "singer"))).where("r <= 6")
    return k.groupBy("song_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "singer"))), lambda x: x["singer"]), "; ").alias("singers"))


@Q(f"""WITH k AS (SELECT song_key, item_id, platform, row_number() OVER (PARTITION BY song_key ORDER BY item_id) AS r FROM {REC} WHERE song_key IS NOT NULL)
    SELECT song_key, left(string_agg(item_id || ' (' || coalesce(platform, '?') || ')', ' | ' ORDER BY item_id), 300) AS items FROM k WHERE r <= 20 GROUP BY song_key""")
def formatted_list(spark: SparkSession, d: str) -> DataFrame:
    """Formatted tuples of a group, joined in order and cut at 300 characters (A-12). Twenty entries always exceed that, so the rest is never gathered."""
    k = recordings(spark, d, "song_key", "platform").where("song_key is not null")
    k = k.withColumn("r", F.row_number().over(Window.partitionBy("song_key").orderBy("item_id"))).where("r <= 20")
    entry = F.concat("item_id", F.lit(" ("), F.coalesce("platform", F.lit("?")), F.lit(")"))
    g = k.groupBy("song_key").agg(F.sort_array(F.collect_list(F.struct("r", entry.alias("e")))).alias("a"))
    return g.select("song_key", F.substring(F.array_join(F.transform("a", lambda x: x["e"]), " | "), 1, 300).alias("items"))


@Q(f"SELECT song_key, count(DISTINCT platform) AS platforms, count(*) AS n FROM {REC} WHERE song_key IS NOT NULL AND platform IS NOT NULL GROUP BY song_key HAVING count(DISTINCT platform) > 1")
def shared_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that occur under more than one source (A-13)."""
    g = recordings(spark, d, "song_key", "platform").where("song_key is not null and platform is not null").groupBy("song_key").agg(F.count_distinct("platform").alias("platforms"), F.count("*").alias("n"))
    return g.where("platforms > 1").select("song_key", "platforms", "n")


@Q(f"""WITH p AS (SELECT DISTINCT song_key, platform FROM {REC} WHERE song_key IS NOT NULL AND platform IS NOT NULL)
    SELECT a.platform AS platform_a, b.platform AS platform_b, count(*) AS shared FROM p a JOIN p b ON a.song_key = b.song_key AND a.platform < b.platform GROUP BY ALL""")
def source_pair_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Keys shared by each pair of sources, from the distinct (key, source) pairs (A-14, J-15)."""
    p = recordings(spark, d, "song_key", "platform").where("song_key is not null and platform is not null").groupBy("song_key").agg(F.collect_set("platform").alias("s"))
    a = p.where("size(s) > 1").select(F.explode("s").alias("platform_a"), "s").select("platform_a", F.explode("s").alias("platform_b"))
    return a.where("platform_a < platform_b").groupBy("platform_a", "platform_b").agg(F.count("*").alias("shared"))


@Q(f"SELECT region, bool_or(core) AS any_core, bool_and(coalesce(core, false)) AS all_core, count(*) FILTER (WHERE core) AS n_core, round(avg(CASE WHEN core THEN 1 ELSE 0 END), 6) AS share_core FROM {REC} GROUP BY region")
def any_and_all(spark: SparkSession, d: str) -> DataFrame:
    """Any, all, count and share of a nullable flag, null counting as false (A-05, A-06, A-15)."""
    c = F.coalesce("core", F.lit(False))
    return recordings(spark, d, "region", "core").groupBy("region").agg(
        F.bool_or("core").alias("any_core"), F.bool_and(c).alias("all_core"), F.count_if(c).alias("n_core"), F.round(F.avg(c.cast("int")), 6).alias("share_core")
    )


@Q(f"SELECT channel_key, arg_min(singer, item_id) AS first_singer FROM {REC} WHERE {sql_present('singer')} IS NOT NULL AND channel_key IS NOT NULL GROUP BY channel_key")
def first_present(spark: SparkSession, d: str) -> DataFrame:
    """The first value of a group that is not missing, in the order of ids (A-16)."""
    r = recordings(spark, d, "channel_key", "singer").where(present("singer").isNotNull() & F.col("channel_key").isNotNull())
    return r.groupBy("channel_key").agg(F.min_by("singer", "item_id").alias("first_singer"))


@Q(f"""WITH x AS (SELECT CASE WHEN NOT isnan(speech_share) THEN speech_share END AS v FROM {REC})
    SELECT count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd_sample, round(stddev_pop(v), 6) AS sd_population, round(min(v), 6) AS least,
    round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS most FROM x""")
def describe_column(spark: SparkSession, d: str) -> DataFrame:
    """Summary of a numeric column with exact quantiles (A-18)."""
    x = recordings(spark, d, "speech_share").select(number_present("speech_share").alias("v"))
    r = lambda c, name: F.round(c, 6).alias(name)
    return x.agg(F.count("v").alias("n"), r(F.avg("v"), "mean"), r(F.stddev_samp("v"), "sd_sample"), r(F.stddev_pop("v"), "sd_population"), r(F.min("v"), "least"), *[r(F.percentile("v", p), f"q{int(100 * p)}") for p in (0.25, 0.5, 0.75)], r(F.max("v"), "most"))


@Q("SELECT region, " + ", ".join(f"count(*) FILTER (WHERE platform = '{p}') AS {p}" for p in PLATFORMS) + f" FROM {REC} GROUP BY region")
def pivot_by_platform(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each region by platform, one column each, 0 where none (A-19, A-20)."""
    return pivot_counts(recordings(spark, d, "region", "platform"), ["region"], "platform", PLATFORMS)


@Q("SELECT region, " + ", ".join(f"round(count(*) FILTER (WHERE platform = '{p}') / count(*) FILTER (WHERE platform IN ('danmu', 'soundvault', 'vidhub')), 6) AS {p}" for p in PLATFORMS) + f" FROM {REC} WHERE platform IN ('danmu', 'soundvault', 'vidhub') GROUP BY region")
def pivot_share(spark: SparkSession, d: str) -> DataFrame:
    """The crosstab normalised by row (A-21)."""
    p = pivot_counts(recordings(spark, d, "region", "platform").where(F.col("platform").isin(PLATFORMS)), ["region"], "platform", PLATFORMS)
    total = sum((F.col(c) for c in PLATFORMS[1:]), F.col(PLATFORMS[0]))
    return p.select("region", *[F.round(F.col(c) / total, 6).alias(c) for c in PLATFORMS])


@Q(f"SELECT coalesce(region, '(all)') AS region, coalesce(platform, '(all)') AS platform, count(*) AS n FROM {REC} WHERE region IS NOT NULL AND platform IS NOT NULL GROUP BY CUBE (region, platform)")
def crosstab_margins(spark: SparkSession, d: str) -> DataFrame:
    """The crosstab in long form with row, column and grand totals (A-22)."""
    c = recordings(spark, d, "region", "platform").where("region is not null and platform is not null").cube("region", "platform").agg(F.count("*").alias("n"))
    return c.select(F.coalesce("region", F.lit("(all)")).alias("region"), F.coalesce("platform", F.lit("(all)")).alias("platform"), "n")


@Q(f"SELECT coalesce(platform, '(all)') AS platform, count(*) AS n, count(DISTINCT song_key) AS songs FROM {REC} WHERE platform IS NOT NULL GROUP BY ROLLUP (platform)")
def rollup_all(spark: SparkSession, d: str) -> DataFrame:
    """Every group and the whole (A-23)."""
    c = recordings(spark, d, "platform", "song_key").where("platform is not null").rollup("platform").agg(F.count("*").alias("n"), F.count_distinct("song_key").alias("songs"))
    return c.select(F.coalesce("platform", F.lit("(all)")).alias("platform"), "n", "songs")


@Q(f"""SELECT g.name AS province, row_number() OVER (ORDER BY g.lat DESC, g.adcode) AS ord, coalesce(n, 0) AS n FROM gazetteer g
    LEFT JOIN (SELECT province, count(*) AS n FROM {REC} GROUP BY province) r ON r.province = g.name WHERE g.level = 'province'""")
def reindexed_provinces(spark: SparkSession, d: str) -> DataFrame:
    """All provinces of the gazetteer, north to south, with their recordings, 0 where none (A-24, O-08)."""
    n = recordings(spark, d, "province").groupBy("province").agg(F.count("*").alias("n"))
    dim = table(spark, d, "gazetteer").where("level = 'province'").select(F.col("name").alias("province"), F.row_number().over(Window.orderBy(F.desc("lat"), "adcode")).alias("ord"))
    return dim.join(reindex(n, dim, ["province"], {"n": 0}), "province").select("province", "ord", "n")


@Q("""SELECT province, count(*) AS prefectures, string_agg(prefecture || ':' || k, ',' ORDER BY prefecture) AS bundle FROM (
    SELECT province, prefecture, count(*) AS k FROM gazetteer WHERE level = 'county' GROUP BY ALL) GROUP BY province""")
def nested_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Groups of groups as sorted lists of structs, rendered as text for the comparison (A-27, F-A07)."""
    k = table(spark, d, "gazetteer").where("level = 'county'").groupBy("province", "prefecture").agg(F.count("*").alias("k"))
    g = k.groupBy("province").agg(F.sort_array(F.collect_list(F.struct("prefecture", "k"))).alias("list"))
    return g.select("province", F.size("list").cast("long").alias("prefectures"), F.array_join(F.transform("list", lambda x: F.concat_ws(":", x["prefecture"], x["k"].cast("string"))), ",").alias("bundle"))


@Q(f"SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(song_name, '')) AS ch FROM {REC} WHERE {sql_present('song_name')} IS NOT NULL) WHERE ch <> '' AND ch >= '一' AND ch <= '鿿' GROUP BY ch")
def character_frequency(spark: SparkSession, d: str) -> DataFrame:
    """How often each ideograph occurs in a text column (A-28)."""
    ch = recordings(spark, d, "song_name").where(present("song_name").isNotNull()).select(F.explode(F.split("song_name", "")).alias("ch"))
    return ch.where((F.col("ch") >= "一") & (F.col("ch") <= "鿿")).groupBy("ch").agg(F.count("*").alias("n"))


KEYWORDS = ["山歌", "民歌", "号子", "小调", "live", "field", "演唱", "其一"]


@Q("SELECT " + ", ".join(f"count(*) FILTER (WHERE contains(lower(title), '{w}')) AS k{i}" for i, w in enumerate(KEYWORDS)) + f" FROM {REC}")
def keyword_presence(spark: SparkSession, d: str) -> DataFrame:
    """Rows that hold each of a list of keywords, in one pass (A-29)."""
    t = F.lower("title")
    return recordings(spark, d, "title").agg(*[F.count_if(t.contains(w)).alias(f"k{i}") for i, w in enumerate(KEYWORDS)])


@Q(f"""SELECT count(*) AS recordings, count(DISTINCT channel_key) AS channels, count(DISTINCT singer_id) AS singers, count(DISTINCT song_key) AS songs, count(DISTINCT region) AS regions,
    count(*) FILTER (WHERE core) AS core, round(sum(CASE WHEN duration_s > 0 AND NOT isnan(duration_s) THEN duration_s END) / 3600, 3) AS hours,
    round(avg(CASE WHEN provenance_tier IN ('A1', 'A2') THEN 1 ELSE 0 END), 6) AS share_tier_a, count(*) FILTER (WHERE geo_level = 'site') AS sites,
    count(*) FILTER (WHERE upload_date >= 20200101) AS since_2020, count(*) FILTER (WHERE fold IS NULL) AS without_fold FROM {REC}""")
def headline_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Many named numbers of one table from one scan (A-04, A-06, A-38)."""
    r = recordings(spark, d, "channel_key", "singer_id", "song_key", "region", "core", "duration_s", "provenance_tier", "geo_level", "upload_date", "fold")
    return r.agg(
        F.count("*").alias("recordings"), F.count_distinct("channel_key").alias("channels"), F.count_distinct("singer_id").alias("singers"), F.count_distinct("song_key").alias("songs"), F.count_distinct("region").alias("regions"),
        F.count_if("core").alias("core"), F.round(F.sum(F.when((F.col("duration_s") > 0) & ~F.isnan("duration_s"), F.col("duration_s"))) / 3600, 3).alias("hours"),
        F.round(F.avg(F.coalesce(F.col("provenance_tier").isin("A1", "A2"), F.lit(False)).cast("int")), 6).alias("share_tier_a"), F.count_if(F.col("geo_level") == "site").alias("sites"),
        F.count_if(F.col("upload_date") >= 20200101).alias("since_2020"), F.count_if(F.col("fold").isNull()).alias("without_fold"),
    )


@Q(f"""WITH g AS (SELECT region, platform, count(x) AS n, avg(x) AS m FROM (SELECT region, platform, CASE WHEN duration_s > 0 AND NOT isnan(duration_s) THEN duration_s END AS x FROM {REC}) GROUP BY ALL)
    SELECT region, round(sum(n * m) / sum(n), 4) AS weighted_mean, round(avg(m), 4) AS plain_mean FROM g GROUP BY region""")
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    """Means of groups, weighted by their size (A-34)."""
    x = recordings(spark, d, "region", "platform", "duration_s").withColumn("x", F.when((F.col("duration_s") > 0) & ~F.isnan("duration_s"), F.col("duration_s")))
    g = x.groupBy("region", "platform").agg(F.count("x").alias("n"), F.avg("x").alias("m"))
    return g.groupBy("region").agg(F.round(F.sum(F.col("n") * F.col("m")) / F.sum("n"), 4).alias("weighted_mean"), F.round(F.avg("m"), 4).alias("plain_mean"))


@Q(f"""WITH c AS (SELECT region, genre, count(*) AS n FROM {REC} WHERE {sql_present('genre')} IS NOT NULL GROUP BY ALL), p AS (SELECT region, n / sum(n) OVER (PARTITION BY region) AS p FROM c)
    SELECT region, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY region""")
def genre_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Shannon entropy of the values of a group in bits, in one pass over counts (A-35)."""
    c = recordings(spark, d, "region", "genre").where(present("genre").isNotNull()).groupBy("region", "genre").agg(F.count("*").alias("n"))
    g = c.groupBy("region").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    # -0.0 of a single value is 0
    return g.select("region", F.round(F.log2("t") - F.col("s") / F.col("t"), 6).alias("entropy"))


@Q(f"""SELECT platform, round(atan2(avg(sin(a)), avg(cos(a))) / (2 * pi()), 6) AS phase FROM (SELECT platform, 2 * pi() * ((upload_date % 100) / 31.0) AS a FROM {REC} WHERE upload_date IS NOT NULL AND NOT isnan(upload_date)) GROUP BY platform""")
def circular_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of a cyclic quantity by its direction (A-36)."""
    a = recordings(spark, d, "platform", "upload_date").where(number_present("upload_date").isNotNull()).withColumn("a", 2 * F.pi() * ((F.col("upload_date") % 100) / 31.0))
    return a.groupBy("platform").agg(F.round(F.atan2(F.avg(F.sin("a")), F.avg(F.cos("a"))) / (2 * F.pi()), 6).alias("phase"))


@Q(f"""SELECT region, geo_level, count(x) AS n, CASE WHEN count(x) >= 30 THEN round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) END AS iqr
    FROM (SELECT region, geo_level, CASE WHEN duration_s > 0 AND NOT isnan(duration_s) THEN duration_s END AS x FROM {REC}) GROUP BY ALL""")
def guarded_iqr(spark: SparkSession, d: str) -> DataFrame:
    """Interquartile range, null in groups of under 30 values (A-37)."""
    x = recordings(spark, d, "region", "geo_level", "duration_s").withColumn("x", F.when((F.col("duration_s") > 0) & ~F.isnan("duration_s"), F.col("duration_s")))
    iqr = F.percentile("x", 0.75) - F.percentile("x", 0.25)
    return x.groupBy("region", "geo_level").agg(F.count("x").alias("n"), F.when(F.count("x") >= 30, F.round(iqr, 4)).alias("iqr"))


@Q(f"SELECT genre, count(*) AS n FROM {REC} WHERE {sql_present('genre')} IS NOT NULL GROUP BY genre ORDER BY n DESC, genre LIMIT 10")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent values, ties by value (O-01, O-03): a top-k plan, not a full sort."""
    return recordings(spark, d, "genre").where(~is_missing("genre")).groupBy("genre").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "genre").limit(10)


QUERIES, SQL = Q.queries, Q.sql
