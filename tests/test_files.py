"""Writers and sources of single files, and what happens when they fail."""

import io
import json
import zipfile

import pytest

from strophe.sources import notation as P, paged as G, sinks as K, tables as T, writers as Z


def test_pace_and_retries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = G.Pace(1.0, most=3.0, clock=lambda: now[0], sleep=sleep)
    answers = [OSError("a"), OSError("b"), b"x", b"y"]

    def get():
        a = answers.pop(0)
        if isinstance(a, OSError):
            raise a
        return a

    assert G.fetch(get, pace, 3) == b"x" and G.fetch(get, pace, 1) == b"y"
    assert slept == [2.0, 3.0, 1.0]  # doubled after a failure, at most three, then the plain pause
    answers[:] = [OSError("c"), OSError("d")]
    with pytest.raises(OSError, match="d"):
        G.fetch(get, pace, 2)
    with pytest.raises(ValueError):
        G.fetch(get, pace, 0)


def test_paged_source(spark, tmp_path):
    spark.dataSource.register(G.PagedSource)
    for n in (1, 2, 3):
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"pages": 3, "hits": [{"id": n * 10 + i} for i in range(n - 1)]}))
    read = lambda **o: spark.read.format("paged").option("path", str(tmp_path)).options(**o).load()
    want = {(2, '{"id": 20}'), (3, '{"id": 30}'), (3, '{"id": 31}')}
    assert {tuple(r) for r in read().collect()} == {tuple(r) for r in read(lanes=1).collect()} == want
    (tmp_path / "page-3.json").unlink()
    with pytest.raises(Exception):
        read(attempts=1).collect()


def test_probe(spark):
    df = spark.createDataFrame([("a", "xy"), ("b", None), ("c", "")], "k string, output string")
    assert {tuple(r) for r in G.probe(df, "k", "output", ["wc", "-c"]).collect()} == {("a", 0, "2"), ("b", 0, "0"), ("c", 0, "0")}
    assert {tuple(r) for r in G.probe(df, "k", "output", ["no-such-program"]).collect()} == {("a", None, None), ("b", None, None), ("c", None, None)}
    assert [r.code for r in G.probe(df.limit(1), "k", "output", ["sleep", "5"], timeout=0.2).collect()] == [None]


def test_workbook(spark, tmp_path):
    (tmp_path / "a & b.xlsx").write_bytes(Z.xlsx_bytes([["n", "t", None, "x"], [1, "<a> & b", None, 2.5], [None, " c ", "no", None], ["NA", "", None, "y"]]))
    # shared texts, as other programs write them
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>n</t></si><si><r><t>t</t></r></si><si><t>z</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="s"><v>2</v></c></row></sheetData></worksheet>')
    (tmp_path / "c.xlsx").write_bytes(out.getvalue())
    t = T.read_excel(spark, str(tmp_path), "n int, t string, x double", file_column="file")
    assert {tuple(r) for r in t.collect()} == {(1, "<a> & b", 2.5, "a & b"), (None, " c ", None, "a & b"), (None, None, None, "a & b"), (7, "z", None, "c")}


def test_round_trips():
    notes = [(0.0, 1.0, 60), (1.0, 0.0, 60), (1.0, 0.5, 64), (900.0, 2.0, 127)]
    assert [n[:3] for n in P.parse_midi(Z.midi_bytes(notes))] == [(0.0, 1.0, 60), (1.0, 1 / 480, 60), (1.0, 0.5, 64), (900.0, 2.0, 127)]
    assert P.parse_midi(Z.midi_bytes([])) == []
    song = [(36, 1, 0), (47, 5, 0), (60, 3, 1), (61, 8, 1), (84, 6, 2)]
    got = P.parse_kern(Z.kern_text(song, ["3/4"]).encode())
    assert [(p, d * 4, f - 1) for _, d, p, f in got] == song and P.parse_kern_meters(Z.kern_text(song, ["3/4", "X"]).encode()) == [(0, "3/4"), (1, "free")]
    assert P.parse_musicxml(Z.musicxml_text([(60, 4), (None, 2), (61, 1)], "6/8", per_measure=2).encode()) == [(2, 2, 1, "6/8", 0)]
    tiers = {'a "b"': [(0, 1, 'x "y"'), (1, 2, "")], "c": []}
    assert P.parse_textgrid(Z.textgrid_text(tiers).encode()) == [('a "b"', 0.0, 1.0, 'x "y"'), ('a "b"', 1.0, 2.0, "")]


def test_bars_and_parsers_that_fail(spark):
    assert K.svg_bars([]) == '<svg xmlns="http://www.w3.org/2000/svg" width="400" height="0"></svg>' and 'width="200"' in K.svg_bars([("a", 2), ("b", 1)])
    df = spark.createDataFrame([(1, b"no midi"), (2, Z.midi_bytes([(0, 1, 60)])), (3, None)], "k int, content binary")
    rows = {r.k: r for r in P.parse_column(df, "k", "content", P.parse_midi, "onset double, dur double, pitch int, velocity int, track int").collect()}
    assert set(rows) == {1, 2} and rows[1].error.startswith("ValueError") and rows[2].pitch == 60 and rows[2].error is None


def test_stores_of_plain_values(spark, tmp_path):
    import datetime
    import pickle

    import numpy as np

    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.pkl").write_bytes(pickle.dumps([{"a": 1, "b": "x"}, {"a": None}]))
    assert sorted(map(tuple, T.read_pickle(spark, str(tmp_path / "p"), "a int, b string").collect()), key=str) == [(1, "x"), (None, None)]
    (tmp_path / "p/b.pkl").write_bytes(pickle.dumps([{"a": datetime.date(2024, 1, 1)}]))
    with pytest.raises(Exception, match="not a plain value"):
        T.read_pickle(spark, str(tmp_path / "p"), "a int, b string").collect()
    np.savez(tmp_path / "one.npz", f0=np.array([1.0, np.nan, 3.0]), conf=np.array([1, 2], dtype="int32"))
    assert [tuple(r) for r in T.read_npz(spark, str(tmp_path), {"f0": "double", "conf": "int"}).orderBy("frame").collect()] == [("one", 0, 1.0, 1), ("one", 1, None, 2)]
    with pytest.raises(Exception):
        T.read_npz(spark, str(tmp_path), {"no": "double"}).collect()
