"""Projections, predicates and ordered rules on the recordings (survey group P, V-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from strophe.functions.text import number_present, present
from strophe.operators.relational import conform, first_match, last_match, override, reasons, union_sources
from strophe.plans.registry import REC, Registry, recordings, sql_present, table

Q = Registry()

ITEM = T.StructType([T.StructField(n, t) for n, t in (("unified_id", T.StringType()), ("dataset", T.StringType()), ("original_id", T.StringType()), ("granularity", T.StringType()), ("title", T.StringType()), ("province", T.StringType()), ("region", T.StringType()), ("year", T.IntegerType()), ("duration_seconds", T.DoubleType()), ("n_notes", T.IntegerType()), ("language", T.StringType()), ("has_audio", T.BooleanType()), ("has_score", T.BooleanType()))])


def load_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Loader: recordings as items."""
    r = recordings(spark, d, "platform", "title", "province", "region", "upload_date", "duration_s")
    return r.select(
        F.concat_ws("__", F.lit("recordings"), "item_id").alias("unified_id"), F.lit("recordings").alias("dataset"), F.col("item_id").alias("original_id"), F.lit("song").alias("granularity"),
        present("title").alias("title"), present("province").alias("province"), "region", F.floor(number_present("upload_date") / 10000).cast("int").alias("year"), number_present("duration_s").alias("duration_seconds"), F.lit(True).alias("has_audio"),
    )


def load_scores(spark: SparkSession, d: str) -> DataFrame:
    """Loader: printed scores as items."""
    s = table(spark, d, "scores").distinct()
    return s.select(F.concat_ws("__", F.lit("scores"), "item_id").alias("unified_id"), F.lit("scores").alias("dataset"), F.col("item_id").alias("original_id"), F.lit("song").alias("granularity"), present("title").alias("title"), present("province").alias("province"), "region", "n_notes", F.lit(True).alias("has_score"))


def load_documents(spark: SparkSession, d: str) -> DataFrame:
    """Loader: documents as items."""
    t = table(spark, d, "documents")
    return t.select(F.concat_ws("__", F.lit("documents"), F.col("doc_id").cast("string")).alias("unified_id"), F.lit("documents").alias("dataset"), F.col("doc_id").cast("string").alias("original_id"), F.lit("segment").alias("granularity"), present("region").alias("region"), F.year("written_at").alias("year"), present("lang").alias("language"))


def _items(df: DataFrame, dataset: str, ident: str, granularity: str, **columns) -> DataFrame:
    """Rows of one source in the schema of items: its id, its constants, and what it has of the other columns."""
    ident_ = F.col(ident).cast("string")
    return df.select(F.concat_ws("__", F.lit(dataset), ident_).alias("unified_id"), F.lit(dataset).alias("dataset"), ident_.alias("original_id"), F.lit(granularity).alias("granularity"), *[c.alias(n) for n, c in columns.items()])


def load_hits(spark: SparkSession, d: str) -> DataFrame:
    """Loader: what searches found, each hit once, out of nested rows."""
    h = table(spark, d, "search_log").select(F.explode("hits").alias("h")).where("h.id is not null")
    g = h.groupBy(F.col("h.id").alias("id")).agg(F.min("h.title").alias("t"), F.max(number_present("h.duration_s")).alias("s"))
    return _items(g, "hits", "id", "song", title=present("t"), duration_seconds=F.col("s"))


def load_links(spark: SparkSession, d: str) -> DataFrame:
    """Loader: checked links, with whether any check found them."""
    g = table(spark, d, "link_status").where("item_id is not null").groupBy("item_id").agg(F.max("available").alias("a"), F.min(F.year("checked_on")).alias("y"))
    return _items(g, "links", "item_id", "song", year=F.col("y"), has_audio=F.col("a"))


def load_places(spark: SparkSession, d: str) -> DataFrame:
    """Loader: places of the gazetteer."""
    return _items(table(spark, d, "gazetteer"), "places", "adcode", "place", title=F.col("name"), province=F.col("province"))


def load_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Loader: volumes of printed scores as collections."""
    g = table(spark, d, "scores").distinct().where(present("volume").isNotNull()).groupBy("volume").agg(F.sum("n_notes").cast("int").alias("n"))
    return _items(g, "volumes", "volume", "collection", n_notes=F.col("n"), has_score=F.lit(True))


def load_channels(spark: SparkSession, d: str) -> DataFrame:
    """Loader: uploading bodies as collections of what they put up."""
    r = recordings(spark, d, "channel_key", "duration_s").where(present("channel_key").isNotNull())
    g = r.groupBy("channel_key").agg(F.round(F.sum(number_present("duration_s")), 3).alias("s"))
    return _items(g, "channels", "channel_key", "collection", duration_seconds=F.col("s"), has_audio=F.lit(True))


def load_performances(spark: SparkSession, d: str) -> DataFrame:
    """Loader: sequences of events as performances."""
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").cast("int").alias("n"), F.min(F.year("ts")).alias("y"))
    return _items(g, "performances", "user_id", "song", n_notes=F.col("n"), year=F.col("y"))


#: The registry of loaders: name to a function that gives conforming rows (U-01).
LOADERS = {
    "recordings": load_recordings, "scores": load_scores, "documents": load_documents, "hits": load_hits, "links": load_links, "places": load_places, "volumes": load_volumes,
    "channels": load_channels, "performances": load_performances,
}


def master(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all loaders in the schema of items."""
    return union_sources([conform(f(spark, d), ITEM) for f in LOADERS.values()])


_MASTER_SQL = f"""(SELECT 'recordings__' || item_id AS unified_id, 'recordings' AS dataset, item_id AS original_id, 'song' AS granularity, {sql_present("title")} AS title, {sql_present("province")} AS province, region,
    CAST(floor(CASE WHEN NOT isnan(upload_date) THEN upload_date END / 10000) AS INTEGER) AS year, CASE WHEN NOT isnan(duration_s) THEN duration_s END AS duration_seconds, CAST(NULL AS INTEGER) AS n_notes, CAST(NULL AS VARCHAR) AS language, true AS has_audio, CAST(NULL AS BOOLEAN) AS has_score FROM {REC}
    UNION ALL SELECT 'scores__' || item_id, 'scores', item_id, 'song', {sql_present("title")}, {sql_present("province")}, region, NULL, NULL, n_notes, NULL, NULL, true FROM (SELECT DISTINCT * FROM scores)
    UNION ALL SELECT 'documents__' || doc_id, 'documents', CAST(doc_id AS VARCHAR), 'segment', NULL, NULL, {sql_present("region")}, CAST(year(written_at) AS INTEGER), NULL, NULL, {sql_present("lang")}, NULL, NULL FROM documents
    UNION ALL SELECT 'hits__' || id, 'hits', id, 'song', {sql_present("t")}, NULL, NULL, NULL, s, NULL, NULL, NULL, NULL FROM (SELECT h.id AS id, min(h.title) AS t, max(CASE WHEN NOT isnan(h.duration_s) THEN h.duration_s END) AS s FROM (SELECT unnest(hits) AS h FROM search_log) WHERE h.id IS NOT NULL GROUP BY h.id)
    UNION ALL SELECT 'links__' || item_id, 'links', item_id, 'song', NULL, NULL, NULL, CAST(min(year(checked_on)) AS INTEGER), NULL, NULL, NULL, bool_or(available), NULL FROM link_status WHERE item_id IS NOT NULL GROUP BY item_id
    UNION ALL SELECT 'places__' || adcode, 'places', adcode, 'place', name, province, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM gazetteer
    UNION ALL SELECT 'volumes__' || volume, 'volumes', volume, 'collection', NULL, NULL, NULL, NULL, NULL, CAST(sum(n_notes) AS INTEGER), NULL, NULL, true FROM (SELECT DISTINCT * FROM scores) WHERE {sql_present("volume")} IS NOT NULL GROUP BY volume
    UNION ALL SELECT 'channels__' || channel_key, 'channels', channel_key, 'collection', NULL, NULL, NULL, NULL, round(sum(CASE WHEN NOT isnan(duration_s) THEN duration_s END), 3), NULL, NULL, true, NULL FROM (SELECT DISTINCT item_id, channel_key, duration_s FROM recordings) WHERE {sql_present("channel_key")} IS NOT NULL GROUP BY channel_key
    UNION ALL SELECT 'performances__' || user_id, 'performances', CAST(user_id AS VARCHAR), 'song', NULL, NULL, NULL, CAST(min(year(ts)) AS INTEGER), NULL, CAST(count(*) AS INTEGER), NULL, NULL, NULL FROM events GROUP BY user_id)"""


@Q("SELECT * FROM " + _MASTER_SQL)
def unified_items(spark: SparkSession, d: str) -> DataFrame:
    """All sources in one typed table: rename, derive, constants, absent columns as null (P-01, P-02, E-01, E-02, U-01, F-S10)."""
    return master(spark, d)


@Q("SELECT dataset, granularity, count(*) AS n, count(title) AS titles, count(DISTINCT unified_id) AS ids, min(year) AS first_year, max(year) AS last_year FROM " + _MASTER_SQL + " GROUP BY ALL")
def unified_summary(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the unified table per source (A-01, A-04)."""
    return master(spark, d).groupBy("dataset", "granularity").agg(F.count("*").alias("n"), F.count("title").alias("titles"), F.count_distinct("unified_id").alias("ids"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@Q("SELECT unified_id, coalesce(has_audio, false) AND NOT coalesce(has_score, false) AS needs_score, coalesce(has_score, false) AND NOT coalesce(has_audio, false) AS needs_audio, coalesce(has_audio, false) OR coalesce(has_score, false) AS has_music FROM " + _MASTER_SQL)
def capability_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags derived from nullable flags, null counting as false (P-19)."""
    a, s = F.coalesce("has_audio", F.lit(False)), F.coalesce("has_score", F.lit(False))
    return master(spark, d).select("unified_id", (a & ~s).alias("needs_score"), (s & ~a).alias("needs_audio"), (a | s).alias("has_music"))


@Q(f"""SELECT item_id, coalesce({sql_present("song_name")}, {sql_present("title")}, 'untitled') AS name, coalesce(CASE WHEN NOT isnan(duration_s) AND duration_s > 0 THEN duration_s END, -1) AS seconds FROM {REC}""")
def coalesced(spark: SparkSession, d: str) -> DataFrame:
    """The first source that has a value (P-03, F-D04)."""
    r = recordings(spark, d, "song_name", "title", "duration_s")
    return r.select("item_id", F.coalesce(present("song_name"), present("title"), F.lit("untitled")).alias("name"), F.coalesce(F.when((F.col("duration_s") > 0) & ~F.isnan("duration_s"), F.col("duration_s")), F.lit(-1.0)).alias("seconds"))


@Q(f"""SELECT item_id, CASE WHEN item_id < 'C' THEN 'manual' WHEN t2 = 'A' THEN 'A2' ELSE t2 END AS tier FROM (
    SELECT item_id, CASE WHEN {sql_present("singer_inheritor")} IS NOT NULL THEN 'A1' ELSE t1 END AS t2 FROM (
    SELECT *, CASE WHEN provenance_tier IN ('B', 'C') AND contains(coalesce(feature_flags, ''), 'series:') THEN 'A' ELSE provenance_tier END AS t1 FROM {REC}))""")
def tier_policy(spark: SparkSession, d: str) -> DataFrame:
    """Conditional overwrites in a fixed order, each seeing the one before; item overrides last (P-04)."""
    r = recordings(spark, d, "provenance_tier", "feature_flags", "singer_inheritor")
    t = F.when(F.col("provenance_tier").isin("B", "C") & F.coalesce("feature_flags", F.lit("")).contains("series:"), "A").otherwise(F.col("provenance_tier"))
    t = F.when(present("singer_inheritor").isNotNull(), "A1").otherwise(t)
    r = r.withColumn("t", t)
    return r.select("item_id", F.when(F.col("item_id") < "C", "manual").when(F.col("t") == "A", "A2").otherwise(F.col("t")).alias("tier"))


_REASON_SQL = f"""SELECT *, nullif(concat_ws(';', CASE WHEN label_status = 'exclude' THEN 'label' END, CASE WHEN dating_flag = 'composed' THEN 'composed' END,
    CASE WHEN {sql_present("composer")} IS NOT NULL AND coalesce(dating_flag, '') <> 'composed' THEN 'folk_style_composed' END,
    CASE WHEN speech_share >= 0.3 AND NOT isnan(speech_share) THEN 'speech' END), '') AS reason FROM {REC}"""


@Q(f"SELECT item_id, reason, reason IS NULL AS is_core, CASE WHEN contains(reason, 'folk_style') THEN 'composed_folk' WHEN reason IS NULL THEN 'core' ELSE 'excluded' END AS part FROM ({_REASON_SQL})")
def exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Reasons gathered rule by rule, and the flags that follow from them (P-05)."""
    r = recordings(spark, d, "label_status", "dating_flag", "composer", "speech_share")
    why = reasons([("label", F.col("label_status") == "exclude"), ("composed", F.col("dating_flag") == "composed"), ("folk_style_composed", present("composer").isNotNull() & (F.coalesce("dating_flag", F.lit("")) != "composed")), ("speech", (F.col("speech_share") >= 0.3) & ~F.isnan("speech_share"))])
    r = r.withColumn("reason", why)
    return r.select("item_id", "reason", F.col("reason").isNull().alias("is_core"), F.when(F.col("reason").contains("folk_style"), "composed_folk").when(F.col("reason").isNull(), "core").otherwise("excluded").alias("part"))


@Q(f"SELECT r.item_id, g.adcode, g.lat FROM {REC} r LEFT JOIN (SELECT * FROM gazetteer WHERE level = 'province') g ON g.name = r.province")
def dimension_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A dimension looked up by name, null where unknown (P-06, J-01). The dimension is fixed and small; the planner broadcasts it."""
    g = table(spark, d, "gazetteer").where("level = 'province'").select(F.col("name").alias("province"), "adcode", "lat")
    return recordings(spark, d, "province").join(g, "province", "left").select("item_id", "adcode", "lat")


@Q(f"""SELECT item_id FROM {REC} WHERE duration_s BETWEEN 40 AND 600 AND NOT isnan(duration_s) AND {sql_present("region")} IS NOT NULL AND {sql_present("composer")} IS NULL AND coalesce(dating_flag, '') <> 'composed'
    AND NOT regexp_matches(coalesce(title, ''), '(?i)live|现场') AND platform IN ('danmu', 'vidhub') AND lower(CAST(core AS VARCHAR)) = 'true'""")
def eligible(spark: SparkSession, d: str) -> DataFrame:
    """Range, membership, pattern, flag and negated conditions in one filter (P-07, P-08, P-10, P-11, P-22). Range and membership reach the scan."""
    r = recordings(spark, d, "duration_s", "region", "composer", "dating_flag", "title", "platform", "core")
    ok = F.col("duration_s").between(40, 600) & ~F.isnan("duration_s") & present("region").isNotNull() & present("composer").isNull() & (F.coalesce("dating_flag", F.lit("")) != "composed")
    ok &= ~F.coalesce("title", F.lit("")).rlike("(?i)live|现场") & F.col("platform").isin("danmu", "vidhub") & (F.lower(F.col("core").cast("string")) == "true")
    return r.where(ok).select("item_id")


GENRES = [("worksong", "号子"), ("boat", "船歌|渔歌"), ("tea", "茶歌"), ("drinking", "酒歌"), ("love", "情歌"), ("children", "童谣"), ("mountain", "山歌|长调|短调"), ("tune", "小调|小唱|调$"), ("folk", "(?i)民歌|folk song")]


@Q("SELECT item_id, CASE " + " ".join(f"WHEN regexp_matches(coalesce(title, ''), '{p}') THEN '{k}'" for k, p in GENRES) + f" ELSE 'other' END AS kind FROM {REC}")
def keyword_classes(spark: SparkSession, d: str) -> DataFrame:
    """Ordered keyword classification: the first matching pattern wins (P-12)."""
    t = F.coalesce("title", F.lit(""))
    return recordings(spark, d, "title").select("item_id", first_match([(k, t.rlike(p)) for k, p in GENRES], "other").alias("kind"))


@Q(f"""SELECT item_id, CASE WHEN {sql_present("ethnic_group")} IS NOT NULL THEN 'ethnic' WHEN geo_level IN ('site', 'county') THEN 'place' WHEN {sql_present("province")} IS NOT NULL THEN 'province' ELSE 'none' END AS rule,
    CASE WHEN {sql_present("ethnic_group")} IS NOT NULL THEN ethnic_group WHEN geo_level IN ('site', 'county') THEN region WHEN {sql_present("province")} IS NOT NULL THEN province END AS value,
    NOT ({sql_present("ethnic_group")} IS NOT NULL OR geo_level IN ('site', 'county')) OR ({sql_present("ethnic_group")} IS NULL AND geo_level IS NULL) AS review FROM {REC}""")
def rule_cascade(spark: SparkSession, d: str) -> DataFrame:
    """A cascade that returns the value, the name of the rule that gave it, and whether to look again (P-13)."""
    r = recordings(spark, d, "ethnic_group", "geo_level", "region", "province")
    e, near, p = present("ethnic_group").isNotNull(), F.coalesce(F.col("geo_level").isin("site", "county"), F.lit(False)), present("province").isNotNull()
    case = F.when(e, F.struct(F.lit("ethnic").alias("rule"), F.col("ethnic_group").alias("value"), F.lit(False).alias("review")))
    case = case.when(near, F.struct(F.lit("place").alias("rule"), F.col("region").alias("value"), F.lit(False).alias("review")))
    case = case.when(p, F.struct(F.lit("province").alias("rule"), F.col("province").alias("value"), F.lit(True).alias("review")))
    case = case.otherwise(F.struct(F.lit("none").alias("rule"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("review")))
    return r.select("item_id", case.alias("c")).select("item_id", "c.*")


@Q("""SELECT r.item_id, s.item_id AS score_id, CASE WHEN s.province IS NULL OR s.province IN ('', 'NA', 'nan', 'None') THEN 'uncertain' WHEN s.province = r.province AND s.n_notes >= 100 THEN 'match'
    WHEN s.province = r.province THEN 'likely' WHEN s.region = r.region THEN 'uncertain' ELSE 'homonym' END AS verdict
    FROM (SELECT DISTINCT item_id, song_key, province, region FROM recordings) r JOIN (SELECT DISTINCT * FROM scores) s ON s.song_key = r.song_key""")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Many-to-many join of recordings and scores, judged by a cascade over title, province and length (P-14, J-03)."""
    s = table(spark, d, "scores").distinct().select(F.col("item_id").alias("score_id"), "song_key", F.col("province").alias("province_score"), F.col("region").alias("region_score"), "n_notes")
    m = recordings(spark, d, "song_key", "province", "region").join(s, "song_key")
    same = F.col("province_score") == F.col("province")
    rules = [("uncertain", present("province_score").isNull()), ("match", same & (F.col("n_notes") >= 100)), ("likely", same), ("uncertain", F.col("region_score") == F.col("region"))]
    return m.select("item_id", "score_id", first_match(rules, "homonym").alias("verdict"))


@Q(f"""SELECT item_id, CASE WHEN g IS NULL THEN NULL WHEN g = 0 OR (g < 0.05 AND r < 0.10) THEN 'instrumental' WHEN g < 0.15 AND r > greatest(0.20, 2 * g) THEN 'second' ELSE 'first' END AS model
    FROM (SELECT item_id, speech_share AS g, CASE WHEN duration_s > 0 THEN 30 / duration_s END AS r FROM (SELECT item_id, CASE WHEN NOT isnan(speech_share) THEN speech_share END AS speech_share, CASE WHEN NOT isnan(duration_s) THEN duration_s END AS duration_s FROM {REC}))""")
def model_choice(spark: SparkSession, d: str) -> DataFrame:
    """A choice by two coverage shares and thresholds (P-15)."""
    x = recordings(spark, d, "speech_share", "duration_s").select("item_id", number_present("speech_share").alias("g"), F.when(number_present("duration_s") > 0, 30 / F.col("duration_s")).alias("r"))
    g, r = F.col("g"), F.col("r")
    return x.select("item_id", F.when(g.isNull(), None).when((g == 0) | ((g < 0.05) & (r < 0.10)), "instrumental").when((g < 0.15) & (r > F.greatest(F.lit(0.20), 2 * g)), "second").otherwise("first").alias("model"))


@Q(f"""SELECT CASE WHEN x IS NULL THEN 'none' WHEN x < 60 THEN '0-60' WHEN x < 120 THEN '60-120' WHEN x < 300 THEN '120-300' ELSE '300-' END AS bin, count(*) AS n
    FROM (SELECT CASE WHEN NOT isnan(duration_s) AND duration_s > 0 THEN duration_s END AS x FROM {REC}) GROUP BY bin""")
def fixed_bins(spark: SparkSession, d: str) -> DataFrame:
    """Counts in bins of fixed edges (P-16)."""
    x = F.when(~F.isnan("duration_s") & (F.col("duration_s") > 0), F.col("duration_s"))
    b = first_match([("none", x.isNull()), ("0-60", x < 60), ("60-120", x < 120), ("120-300", x < 300)], "300-")
    return recordings(spark, d, "duration_s").groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@Q(f"""WITH x AS (SELECT item_id, duration_s AS x FROM {REC} WHERE NOT isnan(duration_s) AND duration_s > 0), q AS (SELECT quantile_cont(x, 0.2) AS a, quantile_cont(x, 0.4) AS b, quantile_cont(x, 0.6) AS c, quantile_cont(x, 0.8) AS e FROM x)
    SELECT item_id, CAST(x > a AS INTEGER) + CAST(x > b AS INTEGER) + CAST(x > c AS INTEGER) + CAST(x > e AS INTEGER) AS bin FROM x, q""")
def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    """Bins of equal frequency by exact quantiles; the four edges are one broadcast row (P-17)."""
    x = recordings(spark, d, "duration_s").where(~F.isnan("duration_s") & (F.col("duration_s") > 0)).select("item_id", F.col("duration_s").alias("x"))
    q = x.agg(F.percentile("x", F.array(*[F.lit(p) for p in (0.2, 0.4, 0.6, 0.8)])).alias("q"))
    return x.crossJoin(F.broadcast(q)).select("item_id", F.size(F.filter("q", lambda e: F.col("x") > e)).alias("bin"))


RELEASE = ["item_id", "platform", "url", "title", "region", "province", "song_name", "absent_column", "core"]


@Q(f"SELECT item_id, platform, url, title, region, province, song_name, core FROM {REC} WHERE core")
def release_columns(spark: SparkSession, d: str) -> DataFrame:
    """The released columns that exist, of the released rows (P-20)."""
    t = table(spark, d, "recordings")
    have = set(t.columns)
    return t.where("core").select([c for c in RELEASE if c in have]).distinct()


@Q(f"""SELECT item_id, CASE WHEN item_id < 'D' THEN 'checked' ELSE genre END AS genre, CASE WHEN item_id < 'B' THEN 'none' ELSE composer END AS composer FROM {REC}""")
def applied_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Long-form corrections (item, field, value) applied over a table (P-21, V-12)."""
    r = recordings(spark, d, "genre", "composer")
    o = r.where("item_id < 'D'").select("item_id", F.lit("genre").alias("field"), F.lit("checked").alias("value"))
    o = o.unionAll(r.where("item_id < 'B'").select("item_id", F.lit("composer").alias("field"), F.lit("none").alias("value")))
    return override(r, o, "item_id", ["genre", "composer"]).select("item_id", "genre", "composer")


@Q(f"""SELECT item_id, CASE WHEN sil >= 0.5 THEN 'silence' WHEN sp >= 0.5 AND sp > 2 * sg AND mu < 0.5 THEN 'speech' WHEN sg >= 0.2 THEN 'sung' WHEN mu >= 0.3 THEN 'music' ELSE 'other' END AS label FROM (
    SELECT item_id, s AS sp, 1 - s AS sg, abs(0.5 - s) AS mu, CASE WHEN x IS NULL OR x < 20 THEN 0.6 ELSE 0.1 END AS sil FROM (SELECT item_id, coalesce(CASE WHEN NOT isnan(speech_share) THEN speech_share END, 0) AS s, CASE WHEN NOT isnan(duration_s) THEN duration_s END AS x FROM {REC}))""")
def window_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels from class scores where a later rule overwrites an earlier one (N-21)."""
    s = F.coalesce(number_present("speech_share"), F.lit(0.0))
    x = recordings(spark, d, "speech_share", "duration_s").select("item_id", s.alias("sp"), (1 - s).alias("sg"), F.abs(0.5 - s).alias("mu"), F.when(number_present("duration_s").isNull() | (F.col("duration_s") < 20), 0.6).otherwise(0.1).alias("sil"))
    rules = [("music", F.col("mu") >= 0.3), ("sung", F.col("sg") >= 0.2), ("speech", (F.col("sp") >= 0.5) & (F.col("sp") > 2 * F.col("sg")) & (F.col("mu") < 0.5)), ("silence", F.col("sil") >= 0.5)]
    return x.select("item_id", last_match(rules, "other").alias("label"))


QUERIES, SQL = Q.queries, Q.sql
