"""Round trips through files (survey groups S and K): a table is written to the shared folder in a format, read back by the source, and
compared by SQL with the table itself. Single files hold the fixed list of places only; what grows is written by Spark's own writers."""

from __future__ import annotations

import io
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from strophe.functions.columns import slug
from strophe.plans.music import SONG_SQL, song
from strophe.plans.registry import REC, Registry, recordings, sql_present, table
from strophe.plans.sequences import NOTES_SQL, notes
from strophe.session import scratch
from strophe.sources import notation as P, paged as G, sinks as K, tables as T, writers as Z

Q = Registry()

_NOTHING = ", ".join(f"'{x}'" for x in T.NA_TOKENS)


def _text(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ({_NOTHING}) THEN {c} END AS {c}"


def places(spark: SparkSession, d: str, most: int = 20_000) -> list[dict]:
    """The list of places on the driver: fixed, and refused if it is not."""
    return K.small_rows(table(spark, d, "gazetteer").select("adcode", "level", "name", "province", "lon", "lat", "children").orderBy("adcode"), most)


@Q(f"SELECT item_id, {_text('title')}, CASE WHEN NOT isnan(duration_s) THEN duration_s END AS duration_s, composition_year, core FROM (SELECT DISTINCT item_id, title, duration_s, composition_year, core FROM recordings)")
def csv_typed(spark: SparkSession, d: str) -> DataFrame:
    """Text, numbers and flags through CSV (S-01, K-02): quotes, line breaks and odd spaces survive, every spelling of nothing is null."""
    path, cols = scratch(spark, "typed"), ["item_id", "title", "duration_s", "composition_year", "core"]
    K.write_csv(recordings(spark, d, *cols[1:]), path, cols)
    return T.read_csv(spark, path, "item_id string, title string, duration_s double, composition_year int, core boolean")


@Q(f"SELECT region, platform, count(*) AS n FROM {REC} WHERE region IS NOT NULL AND platform IS NOT NULL GROUP BY ALL")
def csv_projected(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of a wide CSV (S-02)."""
    path = scratch(spark, "wide")
    r = recordings(spark, d, "title", "region", "genre", "platform", "url")
    K.write_csv(r, path, r.columns)
    t = T.read_csv(spark, path, "platform string, region string", columns=["region", "platform"])
    return t.where("region is not null and platform is not null").groupBy("region", "platform").agg(F.count("*").alias("n"))


@Q("SELECT item_id, coalesce(province, '') AS province, coalesce(song_name, '') AS song_name FROM (SELECT DISTINCT item_id, province, song_name FROM recordings)")
def csv_text(spark: SparkSession, d: str) -> DataFrame:
    """All cells as text, words for nothing kept (S-03)."""
    path = scratch(spark, "text")
    K.write_csv(recordings(spark, d, "province", "song_name"), path, ["item_id", "province", "song_name"])
    t = T.read_csv(spark, path, "item_id string, province string, song_name string", keep_tokens=True)
    return t.select("item_id", F.coalesce("province", F.lit("")).alias("province"), F.coalesce("song_name", F.lit("")).alias("song_name"))


@Q("SELECT event_id, event_type, value FROM events")
def csv_headerless(spark: SparkSession, d: str) -> DataFrame:
    """Columns named by the reader (S-04)."""
    path = scratch(spark, "bare")
    K.write_csv(table(spark, d, "events"), path, ["event_id", "event_type", "value"], header=False)
    return T.read_csv(spark, path, "event_id bigint, event_type string, value double", header=False)


@Q("SELECT adcode, name, province FROM gazetteer")
def csv_other_encoding(spark: SparkSession, d: str) -> DataFrame:
    """A file that is not UTF-8 (S-05)."""
    path = scratch(spark, "gb")
    K.put_bytes(spark, path + "/places.csv", pd.DataFrame(places(spark, d), columns=["adcode", "name", "province"]).to_csv(index=False).encode("gb18030"))
    return T.read_csv_any_encoding(spark, path, "adcode string, name string, province string")


@Q("SELECT adcode, level, children FROM gazetteer")
def csv_byte_order_mark(spark: SparkSession, d: str) -> DataFrame:
    """A byte order mark before the first name (S-06)."""
    path = scratch(spark, "bom")
    K.put_bytes(spark, path + "/places.csv", pd.DataFrame(places(spark, d), columns=["adcode", "level", "children"]).astype({"children": "Int64"}).to_csv(index=False).encode("utf-8-sig"))
    return T.read_csv(spark, path, "adcode string, level string, children int")


@Q(f"SELECT region, count(*) AS n, round(sum(CASE WHEN NOT isnan(duration_s) THEN duration_s END), 3) AS seconds FROM {REC} WHERE region IS NOT NULL GROUP BY region")
def csv_many_files(spark: SparkSession, d: str) -> DataFrame:
    """A folder per value, read again by a pattern (S-07, K-03); a hot value is written by many tasks."""
    path = scratch(spark, "parted")
    r = recordings(spark, d, "region", "duration_s").where("region is not null")
    K.write_partitioned(r, path, "region", "csv")
    t = T.read_csv(spark, path + "/region_slug=*/*.csv", "item_id string, region string, duration_s double")
    return t.groupBy("region").agg(F.count("*").alias("n"), F.round(F.sum("duration_s"), 3).alias("seconds"))


@Q("SELECT event_id, user_id, ts, event_type, value FROM events")
def parquet_table(spark: SparkSession, d: str) -> DataFrame:
    """A record store with its types (S-08, K-01)."""
    path = scratch(spark, "store")
    K.write_table(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value"), path)
    return spark.read.parquet(path)


@Q("SELECT province AS file, adcode, name, round(lon, 9) AS lon, children FROM gazetteer WHERE level = 'county'")
def workbooks(spark: SparkSession, d: str) -> DataFrame:
    """A workbook per province, whose name is a value (S-09)."""
    path, by = scratch(spark, "books"), {}
    for p in places(spark, d):
        if p["level"] == "county":
            by.setdefault(p["province"], [["name", "adcode", "lon", "children"]]).append([p["name"], p["adcode"], p["lon"], p["children"]])
    for province, rows in by.items():
        K.put_bytes(spark, f"{path}/{province}.xlsx", Z.xlsx_bytes(rows))
    if not by:
        return spark.createDataFrame([], "file string, adcode string, name string, lon double, children int")
    return T.read_excel(spark, path, "adcode string, name string, lon double, children int", file_column="file").withColumn("lon", F.round("lon", 9))


@Q("SELECT adcode, name, lat FROM gazetteer")
def json_document(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document, an array of objects (S-10)."""
    path = scratch(spark, "doc")
    K.put_bytes(spark, path + "/places.json", json.dumps(places(spark, d), ensure_ascii=False, indent=1).encode())
    return T.read_json(spark, path, "adcode string, name string, lat double")


@Q("SELECT adcode, province FROM gazetteer")
def arrow_columns(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of an Arrow file (S-12)."""
    import pyarrow as pa

    t = pa.Table.from_pylist(places(spark, d), schema=pa.schema([("adcode", pa.string()), ("level", pa.string()), ("name", pa.string()), ("province", pa.string()), ("lon", pa.float64())]))
    out = io.BytesIO()
    with pa.ipc.new_file(out, t.schema) as w:
        w.write_table(t)
    path = scratch(spark, "arrow")
    K.put_bytes(spark, path + "/places.arrow", out.getvalue())
    return T.read_arrow(spark, path, ["adcode", "province"])


@Q(f"SELECT DISTINCT 'platform_slug=' || coalesce(lower(platform), 'none') AS folder, true AS filled FROM {REC} WHERE platform IS NULL OR NOT regexp_matches(platform, '[\\s/]')")
def tree_levels(spark: SparkSession, d: str) -> DataFrame:
    """The folders of a written tree, and whether their files hold anything (S-13)."""
    path = scratch(spark, "tree")
    K.write_partitioned(recordings(spark, d, "platform"), path, "platform", "json")
    t = T.read_tree(spark, path, ["folder"], "*.json")
    return t.groupBy("folder").agg((F.sum("bytes") > 0).alias("filled"))


@Q(f"WITH {NOTES_SQL} SELECT item, round_even(onset / 600 * 480, 0) / 480 AS onset, pitch, count(*) AS n FROM n GROUP BY ALL")
def midi_notes(spark: SparkSession, d: str) -> DataFrame:
    """Items written as MIDI and read again (S-14, K-11): ten minutes are a beat, 480 ticks long."""
    n = notes(spark, d).select("item", (F.col("onset") / 600).alias("on"), (F.col("dur") / 600).alias("len"), "pitch")

    def write(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"item": [g["item"].iloc[0]], "data": [Z.midi_bytes(list(zip(g["on"], g["len"], g["pitch"])))]})

    files = n.groupBy("item").applyInPandas(write, "item long, data binary")
    t = P.parse_column(files, "item", "data", P.parse_midi, "onset double, dur double, pitch int, velocity int, track int")
    return t.groupBy("item", "onset", "pitch").agg(F.count("*").alias("n"))


_KERN = f"{SONG_SQL}, m AS (SELECT DISTINCT item, ['3/4', '2/4', '6/8', '4/4'][item % 4 + 1] AS meter FROM s)"


def _written(spark: SparkSession, d: str, write) -> DataFrame:
    """One text per item: its notes as (pitch, sixteenths, phrase) in order, and its meter."""
    s = song(spark, d).select("item", "pos", "pitch", (F.col("d") * 4).cast("int").alias("len"), "phrase")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        item = int(g["item"].iloc[0])
        meter = ("3/4", "2/4", "6/8", "4/4")[item % 4]
        return pd.DataFrame({"item": [item], "data": [write(list(zip(g["pitch"].tolist(), g["len"].tolist(), g["phrase"].tolist(), g["pos"].tolist())), meter)]})

    return s.groupBy("item").applyInPandas(one, "item long, data string")


@Q(f"WITH {_KERN} SELECT item, coalesce(sum(d) OVER (PARTITION BY item ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS onset, d AS dur, pitch, phrase + 1 AS phrase FROM s")
def kern_notes(spark: SparkSession, d: str) -> DataFrame:
    """Items written as kern and read again (S-15): lengths with dots and ties, phrases by their marks."""
    files = _written(spark, d, lambda notes, meter: Z.kern_text([n[:3] for n in notes], [meter]))
    return P.parse_column(files, "item", "data", P.parse_kern, "onset double, dur double, pitch int, phrase int").drop("error")


@Q(f"WITH {_KERN} SELECT item, meter, CASE WHEN item % 3 = 0 THEN 'free' ELSE meter END AS last, CASE WHEN item % 3 = 0 THEN 1 ELSE 0 END AS changes FROM m")
def meter_changes(spark: SparkSession, d: str) -> DataFrame:
    """The meters of a kern file in order: the first, the last, and whether they change (S-15)."""
    files = _written(spark, d, lambda notes, meter: Z.kern_text([n[:3] for n in notes], [meter]))
    free = F.when(F.col("item") % 3 == 0, F.concat("data", F.lit("\n*MX\n"))).otherwise(F.col("data"))
    t = P.parse_column(files.withColumn("data", free), "item", "data", P.parse_kern_meters, "n int, meter string")
    g = t.groupBy("item").agg(F.min_by("meter", "n").alias("meter"), F.max_by("meter", "n").alias("last"), F.count_distinct("meter").alias("k"))
    return g.select("item", "meter", "last", (F.col("k") > 1).cast("int").alias("changes"))


@Q(f"WITH {_KERN}, c AS (SELECT item, count(*) AS n, count(*) FILTER (WHERE pos % 9 <> 0) AS notes, count(*) FILTER (WHERE pos % 9 = 0) AS rests FROM s GROUP BY item) SELECT c.item, CAST(ceil(n / 4.0) AS INTEGER) AS measures, notes, rests, meter AS times FROM c JOIN m ON m.item = c.item")
def musicxml_counts(spark: SparkSession, d: str) -> DataFrame:
    """Measures, notes, rests and time signatures of items written as MusicXML (S-16, K-11)."""
    files = _written(spark, d, lambda notes, meter: Z.musicxml_text([(None if n[3] % 9 == 0 else n[0], n[1]) for n in notes], meter))
    return P.parse_column(files, "item", "data", P.parse_musicxml, "measures int, notes int, rests int, times string, lyrics int").drop("lyrics", "error")


@Q(f"""WITH {NOTES_SQL} SELECT item, CASE WHEN pos % 2 = 0 THEN 'even' ELSE 'odd "tier"' END AS tier, floor(onset) AS start, floor(onset + dur) + 1 AS ending, event_type || ' "' || pitch || '"' AS text FROM n""")
def textgrid_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of two tiers written as TextGrids and read again, quotes doubled (S-17)."""
    n = notes(spark, d).select("item", "pos", F.floor("onset").alias("a"), (F.floor(F.col("onset") + F.col("dur")) + 1).alias("b"), F.concat("event_type", F.lit(' "'), F.col("pitch").cast("string"), F.lit('"')).alias("text"))

    def write(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        rows = [(int(a), int(b), t) for a, b, t in zip(g["a"], g["b"], g["text"])]
        odd = (g["pos"] % 2).tolist()
        tiers = {"even": [r for r, o in zip(rows, odd) if not o], 'odd "tier"': [r for r, o in zip(rows, odd) if o]}
        return pd.DataFrame({"item": [g["item"].iloc[0]], "data": [Z.textgrid_text(tiers)]})

    files = n.groupBy("item").applyInPandas(write, "item long, data string")
    t = P.parse_column(files, "item", "data", P.parse_textgrid, "tier string, start double, ending double, text string")
    return t.select("item", "tier", "start", "ending", "text")


@Q("SELECT event_id, event_type AS label, value FROM events WHERE event_type IS NOT NULL")
def record_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of fields parted by white space (S-18); lines of another number of fields are no records."""
    path = scratch(spark, "lines")
    e = table(spark, d, "events").where("event_type is not null")
    line = F.concat(F.col("event_id").cast("string"), F.lit("  "), "event_type", F.lit("\t"), F.col("value").cast("string"))
    lines = e.select(F.explode(F.when(F.col("event_id") % 10 == 0, F.array(line, F.lit("# remark"))).otherwise(F.array(line))))
    lines.write.text(path)
    return T.read_records(spark, path, ["event_id", "label", "value"]).select(F.col("event_id").cast("long").alias("event_id"), "label", F.col("value").cast("double").alias("value"))


@Q(f"WITH {NOTES_SQL} SELECT item, pos, value AS first, pitch AS second FROM n WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def aligned_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames that all series of an item have (S-20), each series its own file."""
    n, paths = notes(spark, d), [scratch(spark, x) for x in ("first", "second")]
    K.write_table(n.where("event_id % 5 <> 0").select("item", "pos", F.col("value").alias("first")), paths[0])
    K.write_table(n.where("event_id % 7 <> 0").select("item", "pos", F.col("pitch").alias("second")), paths[1])
    return T.align_frames({p: spark.read.parquet(p) for p in paths}, "item", "pos")


@Q("""SELECT province AS file, CAST(row_number() OVER w - 1 AS INTEGER) AS frame, round(lon, 9) AS lon, children FROM gazetteer WHERE province <> '' WINDOW w AS (PARTITION BY province ORDER BY adcode)
    QUALIFY row_number() OVER w < count(*) OVER (PARTITION BY province)""")
def frame_archives(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of a file side by side, to the shortest of them (S-20): here the second lacks its last frame."""
    import numpy as np

    path, by = scratch(spark, "arrays"), {}
    for p in places(spark, d):
        if p["province"]:
            by.setdefault(p["province"], []).append(p)
    for province, rows in by.items():
        out = io.BytesIO()
        np.savez(out, lon=np.array([p["lon"] for p in rows]), children=np.array([p["children"] or 0 for p in rows[:-1]], dtype="int32"))
        K.put_bytes(spark, f"{path}/{province}.npz", out.getvalue())
    if not by:
        return spark.createDataFrame([], "file string, frame int, lon double, children int")
    return T.read_npz(spark, path, {"lon": "double", "children": "int"}).withColumn("lon", F.round("lon", 9))


@Q("SELECT adcode, name, lat FROM gazetteer")
def pickled_records(spark: SparkSession, d: str) -> DataFrame:
    """A store of plain records (S-21)."""
    import pickle

    path = scratch(spark, "pickled")
    K.put_bytes(spark, path + "/places.pkl", pickle.dumps(places(spark, d)))
    return T.read_pickle(spark, path, "adcode string, name string, lat double")


@Q("""SELECT province, kind, value FROM (SELECT province, 'title' AS kind, province || ' & <places>' AS value FROM gazetteer GROUP BY province
      UNION ALL SELECT province, 'link', 'https://example.org/' || adcode || '?a=1&b=2' FROM gazetteer UNION ALL SELECT province, 'image', adcode || '.png' FROM gazetteer
      UNION ALL SELECT province, 'text', string_agg(name || ' "' || level || '"', chr(10) ORDER BY adcode) FROM gazetteer GROUP BY province) WHERE province IS NOT NULL AND province <> ''""")
def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages written one file a province and read again: title, visible text, links and images (S-22)."""
    path, rows = scratch(spark, "pages"), places(spark, d)
    entry = '<li>{name}&#32;&quot;{level}&quot;</li><a href="https://example.org/{adcode}?a=1&amp;b=2"></a><img src="{adcode}.png"><script>var no = "<li>";</script>'
    names = sorted({p["province"] for p in rows if p["province"]})
    for province in names:
        body = "".join(entry.format(**p) for p in rows if p["province"] == province)
        K.put_bytes(spark, f"{path}/{province}.html", f"<html><head><title>{province} &amp; &lt;places&gt;</title></head><body><ul>{body}</ul></body></html>".encode())
    if not names:
        return spark.createDataFrame([], "province string, kind string, value string")
    t = P.parse_files(spark, path, P.parse_html, "kind string, value string", "*.html")
    return t.select(F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("province"), "kind", "value")


@Q("SELECT CAST((row_number() OVER (ORDER BY adcode) - 1) // 100 + 1 AS INTEGER) AS page, adcode, name FROM gazetteer")
def paged_search(spark: SparkSession, d: str) -> DataFrame:
    """Hits of all pages of a search, fetched side by side with retries (S-23, T-05)."""
    path, rows = scratch(spark, "search"), places(spark, d)
    pages = [rows[i : i + 100] for i in range(0, len(rows), 100)] or [[]]
    for n, hits in enumerate(pages, 1):
        K.put_bytes(spark, f"{path}/page-{n}.json", json.dumps({"pages": len(pages), "hits": hits}, ensure_ascii=False).encode())
    spark.dataSource.register(G.PagedSource)
    t = spark.read.format("paged").option("path", path).load()
    return t.select("page", F.get_json_object("hit", "$.adcode").alias("adcode"), F.get_json_object("hit", "$.name").alias("name"))


@Q("SELECT adcode, 0 AS code, CAST(octet_length(encode(name)) AS VARCHAR) AS output FROM gazetteer WHERE level = 'province'")
def probed_values(spark: SparkSession, d: str) -> DataFrame:
    """What a program of the system says about each value (S-24): here the number of its bytes."""
    p = table(spark, d, "gazetteer").where("level = 'province'").select("adcode", "name")
    return G.probe(p, "adcode", "name", ["wc", "-c"])


@Q("SELECT item_id, round FROM (SELECT DISTINCT item_id, round FROM recordings WHERE round IS NOT NULL)")
def discovered_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Folders found by their pattern, with their number as a column (S-25)."""
    path = scratch(spark, "rounds")
    r = recordings(spark, d, "round").where("round is not null")
    r.withColumn("folder", F.col("round")).drop("round").write.partitionBy("folder").parquet(path)
    if r.isEmpty():
        return r
    return T.discover(spark, path, "folder=", lambda s, p: s.read.parquet(p))


@Q(f"""SELECT unnest(['recordings', 'songs', 'hours']) AS name, unnest(['\\newcommand{{\\numRecordings}}{{' || n || '}}', '\\newcommand{{\\numSongs}}{{' || songs || '}}', '\\newcommand{{\\numHours}}{{' || hours || '}}']) AS macro
    FROM (SELECT count(DISTINCT item_id) AS n, count(DISTINCT {sql_present('song_key')}) AS songs, CAST(floor(sum(CASE WHEN NOT isnan(duration_s) THEN duration_s END) / 3600) AS BIGINT) AS hours FROM (SELECT DISTINCT item_id, song_key, duration_s FROM recordings))""")
def paper_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Named numbers as macros of a paper (K-08): one row of aggregates, written on the driver."""
    from strophe.functions.text import number_present, present

    r = recordings(spark, d, "song_key", "duration_s")
    n = r.agg(F.count_distinct("item_id").alias("recordings"), F.count_distinct(present("song_key")).alias("songs"), F.floor(F.sum(number_present("duration_s")) / 3600).alias("hours")).first().asDict()
    lines = K.latex_macros(n).splitlines()
    return spark.createDataFrame(list(zip(n, lines)), "name string, macro string")


@Q(f"SELECT 'In ' || count(DISTINCT region) || ' regions there are ' || count(DISTINCT item_id) || ' recordings {{kept}}.' AS text FROM recordings")
def filled_template(spark: SparkSession, d: str) -> DataFrame:
    """A text whose keys are replaced by numbers (K-09)."""
    n = table(spark, d, "recordings").agg(F.count_distinct("region").alias("REGIONS"), F.count_distinct("item_id").alias("RECORDINGS")).first().asDict()
    return spark.createDataFrame([(K.fill_template("In {REGIONS} regions there are {RECORDINGS} recordings {kept}.", n),)], "text string")


@Q("""WITH f AS (SELECT DISTINCT r_regionkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0)
    SELECT r_name, n_name, layer, f.n_name IS NOT NULL AND layer = 'notes' AS present FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN f USING (r_regionkey, n_name), (VALUES ('notes'), ('sound')) l(layer)""")
def published_files(spark: SparkSession, d: str) -> DataFrame:
    """A published folder and its manifest: every item and layer, and whether its file is there (K-10)."""
    path = scratch(spark, "published")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_nationkey")
    K.write_partitioned(n.where("n_nationkey % 2 = 0").select("n_name"), path + "/notes", "n_name", "json")
    files = T.read_tree(spark, path, ["layer", "folder"], "*.json").select("layer", "folder").distinct().withColumn("there", F.lit(True))
    wanted = K.manifest_rows(n, ["notes", "sound"], F.lit(False)).withColumn("folder", F.concat(F.lit("n_name_slug="), slug(F.col("n_name")))).drop("present")
    return wanted.join(files, ["layer", "folder"], "left").select("r_name", "n_name", "layer", F.coalesce("there", F.lit(False)).alias("present"))


@Q("""SELECT '<svg xmlns="http://www.w3.org/2000/svg" width="400" height="' || count(*) * 20 || '">' || string_agg('<rect x="0" y="' || (i - 1) * 20 || '" width="' || n * 400 // top || '" height="18"><title>' || event_type || ': ' || n || '</title></rect>', '' ORDER BY i) || '</svg>' AS svg
    FROM (SELECT event_type, count(*) AS n, max(count(*)) OVER () AS top, row_number() OVER (ORDER BY count(*) DESC, event_type) AS i FROM events GROUP BY event_type)""")
def bar_chart(spark: SparkSession, d: str) -> DataFrame:
    """Counts as a bar chart (K-12)."""
    rows = K.small_rows(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type"))
    return spark.createDataFrame([(K.svg_bars([(r["event_type"], r["n"]) for r in rows]),)] if rows else [], "svg string")


QUERIES, SQL = Q.queries, Q.sql
