"""Scalar functions (survey group F), shown on titles, names, dates, vectors and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strophe.functions import columns as C
from strophe.functions.text import SPACE_CLASS, number_present, present
from strophe.plans.joins import NORM
from strophe.plans.registry import REC, Registry, recordings, sql_present, table

Q = Registry()


@Q(f"SELECT item_id, {NORM.format(c='title')} AS norm, regexp_replace({NORM.format(c='title')}, '[0-9]', '', 'g') AS no_digits FROM {REC} WHERE title IS NOT NULL")
def normalised_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles without numbering, brackets, marks and spaces, in lower case; and without digits (F-S01, F-S02)."""
    n = C.norm_title(F.col("title"))
    return recordings(spark, d, "title").where("title is not null").select("item_id", n.alias("norm"), F.regexp_replace(n, "[0-9]", "").alias("no_digits"))


_GENERIC = "^.{{0,4}}(" + "|".join(C.GENRE_WORDS) + ")$"


@Q(f"""WITH k AS (SELECT item_id, song_name, {NORM.format(c="coalesce(song_name, '')")} AS k FROM {REC})
    SELECT item_id, CASE WHEN k = '' OR regexp_matches(k, '{_GENERIC.format()}') OR regexp_matches(coalesce(song_name, ''), '(?i)未标|未详|不详|unknown')
      THEN CASE WHEN k = '' THEN 'untitled' ELSE k END || '#' || item_id ELSE k END AS key FROM k""")
def song_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of songs; generic titles carry their item (F-S26)."""
    return recordings(spark, d, "song_name").select("item_id", C.song_key(F.col("song_name"), F.col("item_id")).alias("key"))


@Q(f"""WITH n AS (SELECT item_id, regexp_replace(regexp_replace(regexp_replace({sql_present("singer")}, '[（(\\[][^）)\\]]*[）)\\]]', '', 'g'), '\\s', '', 'g'), '演唱|领唱|独唱|对唱|合唱|老师|等', '', 'g') AS n FROM {REC})
    SELECT item_id, CASE WHEN n <> '' THEN 'S' || left(sha1(n), 8) END AS sid, CASE WHEN n <> '' THEN md5(n) END AS md, CASE WHEN n <> '' THEN sha256(n) END AS sha FROM n""")
def hashed_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids from hashes of normalised names, stable when rows are added (F-S24)."""
    s = present("singer")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, C.BRACKETED, ""), r"\s", ""), "|".join(C.ROLE_WORDS), "")
    full = F.when(name != "", name)
    return recordings(spark, d, "singer").select("item_id", C.singer_key(s).alias("sid"), F.md5(full).alias("md"), F.sha2(full, 256).alias("sha"))


@Q(f"SELECT item_id, nullif(regexp_extract(title, '《([^》]*)》', 1), '') AS inner_title, TRY_CAST(nullif(regexp_extract(title, '(1[5-9][0-9]{{2}}|20[0-2][0-9])', 1), '') AS INTEGER) AS year FROM {REC} WHERE title IS NOT NULL")
def extracted(spark: SparkSession, d: str) -> DataFrame:
    """A title between marks, and the first year of a text (F-S03, F-S04)."""
    return recordings(spark, d, "title").where("title is not null").select("item_id", C.between_marks(F.col("title")).alias("inner_title"), C.first_year(F.col("title")).alias("year"))


@Q(f"""SELECT item_id, name FROM (SELECT item_id, regexp_replace(regexp_replace(x, '[（(\\[][^）)\\]]*[）)\\]]', '', 'g'), '^{SPACE_CLASS}+|{SPACE_CLASS}+$', '', 'g') AS name FROM (SELECT item_id, unnest(string_split_regex(singer, '[、,，;；/|&]')) AS x FROM {REC} WHERE {sql_present("singer")} IS NOT NULL)) WHERE name <> '' GROUP BY ALL""")
def name_lists(spark: SparkSession, d: str) -> DataFrame:
    """Names of a list cell, one row each, trimmed, without brackets, distinct (F-S05, F-A01)."""
    r = recordings(spark, d, "singer").where(present("singer").isNotNull())
    return r.select("item_id", F.explode(C.split_names(F.col("singer"))).alias("name"))


@Q(f"""SELECT item_id, split_part(channel_key, ':', 1) AS source, nullif(substr(channel_key, instr(channel_key, ':') + 1), '') AS ident, regexp_replace(province, '(省|市)$', '') AS short, lpad(CAST(round AS VARCHAR), 3, '0') AS padded,
    starts_with(title, '[') AS bracketed, replace(lower(trim(region_en)), ' ', '_') AS slug, substr(title, 1, 20) AS cut FROM {REC} WHERE channel_key LIKE '%:%'""")
def text_parts(spark: SparkSession, d: str) -> DataFrame:
    """Split at the first separator, drop suffixes, pad, test prefixes, slug, cut (F-S06, F-S07, F-S08, F-S09, F-S23)."""
    r = recordings(spark, d, "channel_key", "province", "round", "title", "region_en").where(F.col("channel_key").contains(":"))
    return r.select(
        "item_id", F.substring_index("channel_key", ":", 1).alias("source"), F.nullif(F.regexp_replace("channel_key", "^[^:]*:", ""), F.lit("")).alias("ident"), F.regexp_replace("province", "(省|市)$", "").alias("short"),
        F.lpad(F.col("round").cast("string"), 3, "0").alias("padded"), F.col("title").startswith("[").alias("bracketed"), C.slug(F.col("region_en")).alias("slug"), F.substring("title", 1, 20).alias("cut"),
    )


@Q(f"""SELECT item_id, nullif(regexp_replace(trim(regexp_replace(e, '[（(\\[][^）)\\]]*[）)\\]]', '', 'g')), '族$', ''), '') AS grp, coalesce(nullif(regexp_extract(e, '[（(]([^）)]*)[）)]', 1), ''), s) AS sub FROM (SELECT item_id, {sql_present("ethnic_group")} AS e, {sql_present("ethnic_subgroup")} AS s FROM {REC})""")
def group_subgroup(spark: SparkSession, d: str) -> DataFrame:
    """Group and subgroup of one cell (F-S11)."""
    g = C.group_and_subgroup(present("ethnic_group"))
    return recordings(spark, d, "ethnic_group", "ethnic_subgroup").select("item_id", g["group"].alias("grp"), F.coalesce(g["subgroup"], present("ethnic_subgroup")).alias("sub"))


HEADS = ["uploader", "title", "description", "credits", "标题"]


@Q("SELECT item_id, " + ", ".join(f"nullif(trim(regexp_extract(e, '(?:^|[;；|\\n] *){h}[:：] *([^;；|\\n]*)', 1)), '') AS h{i}" for i, h in enumerate(HEADS)) + f" FROM (SELECT item_id, provenance_evidence AS e FROM {REC} WHERE {sql_present('provenance_evidence')} IS NOT NULL)")
def header_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields after known heads in a text of heads and values (F-S12, S-19)."""
    e = recordings(spark, d, "provenance_evidence").where(present("provenance_evidence").isNotNull())
    get = lambda h: F.nullif(F.trim(F.regexp_extract("provenance_evidence", f"(?:^|[;；|\\n] *){h}[:：] *([^;；|\\n]*)", 1)), F.lit(""))
    return e.select("item_id", *[get(h).alias(f"h{i}") for i, h in enumerate(HEADS)])


@Q(f"""SELECT doc_id, len(l) AS lines, list_count(list_filter(l, lambda x: regexp_matches(x, '^[A-Z]:'))) AS turns, nullif(regexp_extract(l[1], '^([A-Z]):', 1), '') AS first_role
    FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '^{SPACE_CLASS}+|{SPACE_CLASS}+$', '', 'g')), lambda x: x <> '') AS l FROM documents)""")
def line_template(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a text, those with a role, and the role of the first (F-S13, F-S19)."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\\r\\n|\\n|\\r"), lambda x: C.trim_all(x)), lambda x: x != "")
    t = table(spark, d, "documents").select("doc_id", lines.alias("l"))
    return t.select("doc_id", F.size("l").alias("lines"), F.size(F.filter("l", lambda x: x.rlike("^[A-Z]:"))).alias("turns"), F.nullif(F.regexp_extract(F.try_element_at("l", F.lit(1)), "^([A-Z]):", 1), F.lit("")).alias("first_role"))


@Q(f"""SELECT item_id, array_to_string(list_filter([CASE WHEN core THEN 'core' END, CASE WHEN contains(coalesce(feature_flags, ''), 'instrument:') THEN 'instrumental' END, CASE WHEN geo_level = 'site' THEN 'measured' END, CASE WHEN {sql_present("composer")} IS NOT NULL THEN 'composed' END], lambda x: x IS NOT NULL), ';') AS flags FROM {REC}""")
def flag_lists(spark: SparkSession, d: str) -> DataFrame:
    """A list of flags built from conditions, and joined (F-S14, F-A03)."""
    r = recordings(spark, d, "core", "feature_flags", "geo_level", "composer")
    flags = F.array_compact(F.array(F.when(F.col("core"), "core"), F.when(F.coalesce("feature_flags", F.lit("")).contains("instrument:"), "instrumental"), F.when(F.col("geo_level") == "site", "measured"), F.when(present("composer").isNotNull(), "composed")))
    return r.select("item_id", F.array_join(flags, ";").alias("flags"))


WORDS = ["民歌", "山歌", "民歌合唱团", "Field", "live"]


@Q(f"SELECT item_id, regexp_replace(title, '{'|'.join(sorted(WORDS, key=lambda w: (-len(w), w)))}', '[x]', 'g') AS redacted, regexp_matches(coalesce(singer, ''), '^[\\x{{4e00}}-\\x{{9fff}}·]+$') AS ideographic FROM {REC} WHERE title IS NOT NULL")
def redacted(spark: SparkSession, d: str) -> DataFrame:
    """Literal replacement of a list of words, longest first, and a test of script (F-S15, F-S16, O-07)."""
    r = recordings(spark, d, "title", "singer").where("title is not null")
    return r.select("item_id", C.multi_replace(F.col("title"), WORDS, "[x]").alias("redacted"), C.is_ideographic(F.coalesce("singer", F.lit(""))).alias("ideographic"))


@Q(f"""WITH m AS (SELECT string_agg(ch, '' ORDER BY ch) AS a, string_agg(simplified, '' ORDER BY ch) AS b FROM char_forms WHERE ch <> simplified)
    SELECT item_id, translate(song_name, a, b) AS simple FROM {REC}, m WHERE {sql_present("song_name")} IS NOT NULL""")
def simplified_names(spark: SparkSession, d: str) -> DataFrame:
    """Traditional characters to simplified ones by a given table (F-S17): one row of the fixed table, broadcast."""
    pairs = table(spark, d, "char_forms").where("ch <> simplified").agg(F.sort_array(F.collect_list(F.struct("ch", "simplified"))).alias("p"))
    m = pairs.select(F.map_from_entries("p").alias("m"))
    r = recordings(spark, d, "song_name").where(present("song_name").isNotNull()).crossJoin(F.broadcast(m))
    return r.select("item_id", F.array_join(F.transform(F.split("song_name", ""), lambda ch: F.coalesce(F.col("m")[ch], ch)), "").alias("simple"))


@Q("SELECT p_partkey, levenshtein(p_name, p_brand) AS edits, round(1 - levenshtein(p_name, p_brand) / greatest(length(p_name), length(p_brand)), 6) AS likeness FROM part")
def edit_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance and likeness of two texts (F-S21)."""
    e = F.levenshtein("p_name", "p_brand")
    return table(spark, d, "part").select("p_partkey", e.cast("long").alias("edits"), F.round(1 - e / F.greatest(F.length("p_name"), F.length("p_brand")), 6).alias("likeness"))


@Q(f"""SELECT item_id, CAST(m AS VARCHAR) || ':' || lpad(CAST(s AS VARCHAR), 2, '0') AS clock, m * 60.0 + s AS seconds FROM (SELECT item_id, CAST(floor(duration_s / 60) AS BIGINT) AS m, CAST(floor(duration_s) AS BIGINT) % 60 AS s FROM {REC} WHERE NOT isnan(duration_s))""")
def clock_text(spark: SparkSession, d: str) -> DataFrame:
    """Seconds as clock text and back (F-S22)."""
    r = recordings(spark, d, "duration_s").where(number_present("duration_s").isNotNull())
    text = F.concat_ws(":", F.floor(F.col("duration_s") / 60).cast("string"), F.lpad((F.floor("duration_s") % 60).cast("string"), 2, "0"))
    return r.select("item_id", text.alias("clock")).withColumn("seconds", C.clock_seconds(F.col("clock")))


@Q(f"""SELECT item_id, CAST(floor(x / 10000) AS INTEGER) AS year, CAST(floor(floor(x / 10000) / 10) * 10 AS INTEGER) AS decade, substr(CAST(CAST(x AS BIGINT) AS VARCHAR), 1, 4) AS year_text, strftime(strptime(CAST(CAST(x AS BIGINT) AS VARCHAR), '%Y%m%d'), '%Y-%m-%d') AS day,
    coalesce(composition_year, CAST(floor(x / 10000) AS INTEGER)) AS date_best FROM (SELECT item_id, composition_year, upload_date AS x FROM {REC} WHERE upload_date IS NOT NULL AND NOT isnan(upload_date))""")
def years_and_decades(spark: SparkSession, d: str) -> DataFrame:
    """Year, decade and date of yyyymmdd numbers; the better of two dates (F-D01, F-D02, F-D04)."""
    r = recordings(spark, d, "upload_date", "composition_year").where(number_present("upload_date").isNotNull())
    x = F.col("upload_date")
    y = C.year_of_number(x)
    return r.select("item_id", y.alias("year"), C.decade(y).alias("decade"), F.substring(x.cast("long").cast("string"), 1, 4).alias("year_text"), F.date_format(C.date_of_number(x), "yyyy-MM-dd").alias("day"), F.coalesce("composition_year", y).alias("date_best"))


@Q(f"SELECT CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER) AS decade, o_orderstatus, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day FROM orders GROUP BY ALL")
def decade_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by decade (F-D02, F-D03)."""
    o = table(spark, d, "orders")
    return o.groupBy(C.decade(F.year("o_orderdate")).alias("decade"), "o_orderstatus").agg(F.count("*").alias("n"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"))


@Q(f"SELECT item_id, a AS start_s, least(a + 30, x) AS end_s FROM (SELECT item_id, duration_s AS x, 0.25 * duration_s AS a FROM {REC} WHERE NOT isnan(duration_s) AND duration_s > 0)")
def excerpt_windows(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts from a quarter of the length on, ending with the recording at the latest (F-D06, N-13)."""
    r = recordings(spark, d, "duration_s").where(number_present("duration_s") > 0)
    a = 0.25 * F.col("duration_s")
    return r.select("item_id", a.alias("start_s"), F.least(a + 30, F.col("duration_s")).alias("end_s"))


@Q("""SELECT event_id, least(greatest(value, 20), 200) AS clipped, sign(value - 50) AS side, round(69 + 12 * log2(value / 440.0), 6) AS midi, round(440 * pow(2, (36 + floor(value) % 48 - 69) / 12.0), 6) AS hz, round(20 * log10(value / 100), 6) AS db,
    CAST(((36 + floor(value) % 48 - 7 + 6) % 12) - 6 AS INTEGER) AS circle, round(value * cos(radians(30)), 6) AS planar FROM events WHERE value > 0""")
def music_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Clip, sign, pitch and frequency, decibels, circular distance, planar projection (F-M01 to F-M04, F-M06)."""
    p = 36 + F.floor("value") % 48
    return table(spark, d, "events").where("value > 0").select(
        "event_id", F.least(F.greatest("value", F.lit(20.0)), F.lit(200.0)).alias("clipped"), F.signum(F.col("value") - 50).alias("side"), F.round(C.hz_to_midi(F.col("value")), 6).alias("midi"), F.round(C.midi_to_hz(p), 6).alias("hz"),
        F.round(C.decibels(F.col("value") / 100), 6).alias("db"), C.circular_distance(p, F.lit(7)).cast("int").alias("circle"), F.round(F.col("value") * F.cos(F.radians(F.lit(30.0))), 6).alias("planar"),
    )


@Q("""SELECT a.adcode AS a, b.adcode AS b, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 6) AS km
    FROM gazetteer a JOIN gazetteer b ON a.adcode < b.adcode WHERE a.level = 'province' AND b.level = 'province'""")
def province_distances(spark: SparkSession, d: str) -> DataFrame:
    """Great-circle distances of the pairs of a fixed list of provinces (F-M05, J-16)."""
    from strophe.operators.spatial import haversine_km

    g = table(spark, d, "gazetteer").where("level = 'province'").agg(F.collect_list(F.struct("adcode", "lon", "lat")).alias("l"))
    p = g.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).where("a.adcode < b.adcode")
    return p.select(F.col("a.adcode").alias("a"), F.col("b.adcode").alias("b"), F.round(haversine_km(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")), 6).alias("km"))


@Q("""WITH f AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings), w AS (SELECT vec_id, i // 32 AS word, CAST(sum(CASE WHEN x > 0 THEN 1::BIGINT << (i % 32)::INTEGER ELSE 0 END) AS BIGINT) AS v FROM f GROUP BY ALL)
    SELECT a.vec_id AS a, b.vec_id AS b, round(sum(bit_count(xor(a.v, b.v))) / 64.0, 6) AS ber FROM w a JOIN w b ON b.vec_id = a.vec_id + 1 AND a.word = b.word GROUP BY ALL""")
def bit_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of differing bits of fingerprints of neighbouring items (F-M07, V-09)."""
    word = lambda k: F.aggregate(F.slice(F.transform("embedding", lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i % 32).cast("long")).otherwise(F.lit(0).cast("long"))), 32 * k + 1, 32), F.lit(0).cast("long"), lambda acc, x: acc + x)
    w = table(spark, d, "embeddings").select("vec_id", word(0).alias("w0"), word(1).alias("w1"))
    b = w.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("w0").alias("v0"), F.col("w1").alias("v1"))
    ber = (C.bit_error(F.col("w0"), F.col("v0")) + C.bit_error(F.col("w1"), F.col("v1"))) / 2
    return w.join(b, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(ber, 6).alias("ber"))


GRID = [0.0, 0.25, 1 / 3, 0.5, 2 / 3, 0.75, 1.0]


@Q("WITH g AS (SELECT unnest([0.0, 0.25, 1.0/3, 0.5, 2.0/3, 0.75, 1.0]::DOUBLE[]) AS g) SELECT event_id, round(floor(value) + arg_min(g, (abs(value - floor(value) - g), g)), 6) AS beat FROM events, g GROUP BY event_id, value")
def grid_quantised(spark: SparkSession, d: str) -> DataFrame:
    """The nearest place of a grid of sixteenths and triplets; of two equally near the earlier (F-M08, N-14)."""
    frac = F.col("value") - F.floor("value")
    best = F.array_min(F.transform(F.array(*[F.lit(g) for g in GRID]), lambda g: F.struct(F.abs(frac - g).alias("gap"), g.alias("g"))))
    return table(spark, d, "events").select("event_id", F.round(F.floor("value") + best["g"], 6).alias("beat"))


@Q("""SELECT event_id, meter, CASE WHEN CAST(split_part(meter, '/', 2) AS INTEGER) = 8 AND CAST(split_part(meter, '/', 1) AS INTEGER) % 3 = 0 THEN 'compound' WHEN CAST(split_part(meter, '/', 1) AS INTEGER) % 3 = 0 THEN 'triple' ELSE 'duple' END AS kind
    FROM (SELECT event_id, CAST(2 + event_id % 5 AS VARCHAR) || '/' || CAST(4 + 4 * (event_id % 2) AS VARCHAR) AS meter FROM events)""")
def meter_classes(spark: SparkSession, d: str) -> DataFrame:
    """Meter text parsed into a class (F-M09)."""
    e = table(spark, d, "events").select("event_id", F.concat_ws("/", (2 + F.col("event_id") % 5).cast("string"), (4 + 4 * (F.col("event_id") % 2)).cast("string")).alias("meter"))
    n, m = F.split("meter", "/")[0].cast("int"), F.split("meter", "/")[1].cast("int")
    return e.select("event_id", "meter", F.when((m == 8) & (n % 3 == 0), "compound").when(n % 3 == 0, "triple").otherwise("duple").alias("kind"))


@Q("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_object('event', event_type, 'user', user_id) AS doc FROM events")
def json_cells(spark: SparkSession, d: str) -> DataFrame:
    """JSON read from and written to cells (F-A06, F-A07)."""
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct(F.col("event_type").alias("event"), F.col("user_id").alias("user"))).alias("doc"))


@Q("""WITH h AS (SELECT search_id, received_at, unnest(hits) AS h, unnest(range(len(hits))) AS pos FROM (SELECT DISTINCT * FROM search_log) WHERE len(hits) > 0)
    SELECT id, arg_min(title, (received_at, search_id, pos)) AS title, arg_min(channel, (received_at, search_id, pos)) AS channel, count(*) AS seen FROM (SELECT h.id AS id, h.title AS title, h.channel AS channel, received_at, search_id, pos FROM h) WHERE id IS NOT NULL GROUP BY id""")
def first_seen_hits(spark: SparkSession, d: str) -> DataFrame:
    """Nested lists of structs: each id with what was first seen of it (F-A08, S-11)."""
    s = table(spark, d, "search_log").distinct()
    h = s.select("search_id", "received_at", F.posexplode("hits").alias("pos", "h")).where("h.id is not null")
    order = F.struct("received_at", "search_id", "pos")
    return h.groupBy(F.col("h.id").alias("id")).agg(F.min_by("h.title", order).alias("title"), F.min_by("h.channel", order).alias("channel"), F.count("*").alias("seen"))


@Q("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS top, list_transform(range(10), lambda i: CAST(i = label AS INTEGER)) = list_transform(range(10), lambda i: CAST(i = label AS INTEGER)) AS hot,
    round(CAST((embedding[4:64] || embedding[1:3])[1] AS DOUBLE), 6) AS turned FROM embeddings""")
def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    """Norm, argmax, one-hot and rotation of vectors (F-A04, F-A05, F-A11)."""
    e = table(spark, d, "embeddings")
    v = F.col("embedding")
    return e.select("vec_id", F.round(F.sqrt(C.dot(v, v)), 5).alias("norm"), C.argmax(v).alias("top"), (C.one_hot(F.col("label"), 10) == C.one_hot(F.col("label"), 10)).alias("hot"), F.round(C.rotate(v, F.lit(3))[0].cast("double"), 6).alias("turned"))


@Q("""WITH f AS (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean, count(*) AS n FROM f GROUP BY ALL""")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector of each class in long form (F-A10)."""
    return table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg("x"), 6).alias("mean"), F.count("*").alias("n"))


@Q("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS q, b.vec_id AS b, list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x)))) AS c FROM q, embeddings b WHERE q.vec_id <> b.vec_id)
    SELECT q AS query, b AS neighbour, round(c, 5) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(c, 9) DESC, b) <= 5""")
def cosine_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of each query vector by cosine (F-A09, F-A12, O-06). Queries are every fiftieth row, broadcast in blocks of
    bounded size, against all rows; each block keeps its best five before the shuffle."""
    from strophe.operators.vectors import exact_neighbours

    e = table(spark, d, "embeddings")
    return exact_neighbours(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5).select("query", "neighbour", F.round("cosine", 5).alias("cosine"))


QUERIES, SQL = Q.queries, Q.sql
