import json
import struct

import pytest
from pyspark.sql import functions as F

from strophe.sources import notation as N, sinks, tables as S
from strophe.streaming import windows as W


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name,x\n1,甲,1.5\n2,NA,nan\n3,,oops\n".encode())
    (tmp_path / "b.csv").write_text("x,id\n2.5,4\n")
    t = S.read_csv(spark, str(tmp_path / "a.csv"), "id int, name string, x double, absent string")
    assert [tuple(r) for r in t.orderBy("id").collect()] == [(1, "甲", 1.5, None), (2, None, None, None), (3, None, None, None)]
    assert S.read_csv(spark, str(tmp_path / "a.csv"), "id int, name string", keep_tokens=True).where("name = 'NA'").count() == 1
    assert S.read_csv(spark, str(tmp_path / "none.csv"), "id int, name string").schema.names == ["id", "name"]
    (tmp_path / "g.csv").write_bytes("id,name\n1,山歌\n".encode("gbk"))
    assert S.read_csv_any_encoding(spark, str(tmp_path / "g.csv"), "id int, name string").first().name == "山歌"
    (tmp_path / "h.csv").write_text("1.0,440.0,2\n")
    assert S.read_csv(spark, str(tmp_path / "h.csv"), "onset double, hz double, dur double", header=False).first().hz == 440
    assert S.read_csv(spark, str(tmp_path / "a.csv"), "id int, x double", columns=["x"]).columns == ["x"]


def test_logs_records_trees(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": 1, "hits": [{"id": "a"}]}\nbroken\n{"id": 2, "hits": []}\n')
    assert S.read_jsonl(spark, str(tmp_path / "l.jsonl"), "id int, hits array<struct<id: string>>").count() == 2
    assert S.read_jsonl(spark, str(tmp_path / "no.jsonl"), "id int").count() == 0
    (tmp_path / "d.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    assert S.read_json(spark, str(tmp_path / "d.json"), "id int").count() == 2
    (tmp_path / "r.txt").write_text("1.0 C:maj x\nbad line\n2.0  G:7 y\n")
    assert [r.chord for r in S.read_records(spark, str(tmp_path / "r.txt"), ["at", "chord", "tag"]).orderBy("at").collect()] == ["C:maj", "G:7"]
    for p in ("tree/v1/set_a/x.wav", "tree/v2/set_b/y.WAV"):
        f = tmp_path / p
        f.parent.mkdir(parents=True)
        f.write_bytes(b"123")
    t = S.read_tree(spark, str(tmp_path / "tree"), ["version", "part"]).orderBy("file").collect()
    assert [(r.version, r.part, r.file, r.suffix, r.bytes) for r in t] == [("v1", "set_a", "x.wav", "wav", 3), ("v2", "set_b", "y.WAV", "wav", 3)]
    for n in (1, 2):
        spark.createDataFrame([(n,)], "v int").write.parquet(str(tmp_path / f"rounds/regions_v{n}"))
    d = S.discover(spark, str(tmp_path / "rounds"), "regions_v", lambda s, p: s.read.parquet(p))
    assert {tuple(r) for r in d.collect()} == {(1, 1), (2, 2)}
    with pytest.raises(FileNotFoundError):
        S.discover(spark, str(tmp_path), "nothing_v", None)


def test_arrow(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"id": [1, 2], "wide": ["x", "y"]})
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write(t)
    assert {tuple(r) for r in S.read_arrow(spark, str(tmp_path / "a.arrow"), ["id"]).collect()} == {(1,), (2,)}


def test_notation(spark, tmp_path):
    kern = "!!!OTL: A song\n!!!ARE@: Asia\n**kern\n*M4/4\n{4c\n8d\n[8e\n4e]\n4r\n=2\nqg\n2.CC#}\n*-\n"
    assert N.parse_kern(kern.encode()) == [(0.0, 1.0, 60, 1), (1.0, 0.5, 62, 1), (1.5, 1.5, 64, 1), (4.0, 3.0, 37, 1)]
    assert N.parse_record_heads(kern.encode()) == [("OTL", "A song"), ("ARE@", "Asia")]
    events = bytes([0, 0x90, 60, 90, 0x60, 0x80, 60, 0, 0, 0x99, 40, 90, 0x60, 0x89, 40, 0, 0, 0x90, 62, 80, 0x30, 62, 0, 0, 0xFF, 0x2F, 0])
    midi = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", len(events)) + events
    assert N.parse_midi(midi) == [(0.0, 1.0, 60, 90, 0), (2.0, 0.5, 62, 80, 0)]
    xml = b"<score-partwise><part><measure><attributes><time><beats>3</beats><beat-type>4</beat-type></time></attributes><note><pitch/><lyric/></note><note><rest/></note></measure></part></score-partwise>"
    assert N.parse_musicxml(xml) == [(1, 1, 1, "3/4", 1)]
    grid = 'File type = "ooTextFile"\nitem []:\n item [1]:\n  class = "IntervalTier"\n  name = "syl"\n  xmin = 0\n  xmax = 1\n  intervals: size = 2\n  intervals [1]:\n   xmin = 0\n   xmax = 0.5\n   text = "a ""b"""\n  intervals [2]:\n   xmin = 0.5\n   xmax = 1\n   text = ""\n'
    want = [("syl", 0.0, 0.5, 'a "b"'), ("syl", 0.5, 1.0, "")]
    assert N.parse_textgrid(grid.encode()) == want and N.parse_textgrid(b"\xff\xfe" + grid.encode("utf-16-le")) == want
    html = "<html><title>T &amp; U</title><script>x()</script><p>One <b>two</b></p><a href='/p?page=2'>next</a><img src='i.png'><audio src='a.mp3'></html>"
    assert N.parse_html(html.encode()) == [("title", "T & U"), ("text", "One two\nnext"), ("link", "/p?page=2"), ("image", "i.png"), ("media", "a.mp3")]
    assert N.parse_token_stream(b"<la><p60><d4><p62><d2>") == [("la", 60, 1.0), ("", 62, 0.5)]
    (tmp_path / "k").mkdir()
    (tmp_path / "k/a.mid").write_bytes(midi)
    (tmp_path / "k/b.mid").write_bytes(b"nothing")
    t = N.parse_files(spark, str(tmp_path / "k"), N.parse_midi, "onset double, dur double, pitch int, velocity int, track int", "*.mid")
    assert t.where("error is null").count() == 2 and t.where("error like 'ValueError%'").count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("East Side", 1, "x"), ("West", 2, None), (None, 3, 'q"z')], "region string, n int, t string")
    sinks.write_partitioned(df, str(tmp_path / "p"), "region")
    assert {p.name for p in (tmp_path / "p").iterdir() if p.is_dir()} == {"region_slug=east_side", "region_slug=west", "region_slug=none"}
    sinks.write_csv(df, str(tmp_path / "c"), ["n", "t"], one_file=True)
    assert {tuple(r) for r in S.read_csv(spark, str(tmp_path / "c"), "n int, t string").collect()} == {(1, "x"), (2, None), (3, 'q"z')}
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    rep = {r.region: json.loads(r.report) for r in sinks.nested_report(df, "region", ["n", "t"]).collect()}
    assert rep["West"] == {"region": "West", "n": 1, "rows": [{"n": 2}]}
    rows = sinks.small_rows(df.orderBy("n"))
    assert sinks.markdown_table(rows).splitlines()[2] == "| East Side | 1 | x |" and sinks.markdown_table([]) == ""
    assert sinks.fill_template("{A_B} of {N}", {"A_B": 1, "N": None}) == "1 of "
    assert sinks.latex_macros({"n songs": 3}) == "\\newcommand{\\numNSongs}{3}\n"
    with pytest.raises(ValueError):
        sinks.small_rows(df, 2)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(i, i * 10)], "k int, v int").coalesce(1).write.mode("append").parquet(src)
    seen = []
    s = W.event_stream(spark, src, per_trigger=1)
    assert W.run_to_end(s).count() == 3
    got = W.run_to_end(s.groupBy().agg(F.sum("v").alias("t")), "complete", lambda df, n: seen.append(n))
    assert got.first().t == 30 and len(seen) >= 1
    assert W.not_done(spark.range(5).toDF("k"), spark.range(2).toDF("k"), "k").count() == 3
