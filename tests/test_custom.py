"""Functions of one's own, title variants, and running queries by name."""

import json

import numpy as np

from strophe import run
from strophe.functions import custom as C
from strophe.operators import kernels as K


def test_functions(spark):
    df = spark.createDataFrame([("a", 1.0, "xy"), ("a", 4.0, None), ("b", None, ""), (None, 9.0, "z" * 5000)], "k string, v double, t string")
    assert [r[0] for r in df.select(C.row_function(len, "int")("t")).collect()] == [2, None, 0, 5000]
    g = C.group_function(df.repartition(3), ["k"], "v", lambda v: (np.sqrt(v).sum(), len(v)), lambda s: s[0] / s[1], "m")
    assert {tuple(r) for r in g.collect()} == {("a", 1.5), (None, 3.0)}
    assert C.group_function(df.where("false"), ["k"], "v", lambda v: (v.sum(),), lambda s: s[0], "m").count() == 0
    f = C.group_frames(df.where("v is not null"), ["k"], ["v"], lambda x: x.tail(1)[["k", "v"]], "k string, v double")
    assert {tuple(r) for r in f.collect()} == {("a", 4.0), (None, 9.0)}
    r = C.row_rows(df, ["k"], "t", lambda t: [(c,) for c in t[:3]], "c string")
    assert sorted(map(tuple, r.where("k = 'a'").collect())) == [("a", "x"), ("a", "y")] and r.count() == 5


def test_title_variants():
    v = K.variant_keys("12. 莲雷采茶·山里人（清唱）号子", ["莲雷"])
    # the whole, its parts at the mark, without the place, without the ending
    assert v == sorted({"莲雷采茶山里人号子", "采茶山里人号子", "莲雷采茶山里人", "采茶山里人", "莲雷采茶", "采茶", "山里人号子", "山里人"})
    assert K.variant_keys("") == [] and K.variant_keys("a") == [] and K.variant_keys("（甲乙）") == []
    assert K.variant_keys("ＡＢ调") == ["ab", "ab调"] and K.variant_keys("民歌调") == ["民歌", "民歌调"]
    assert len(K.variant_keys("长" * 30_000)) == 1


def test_run_by_name(spark, data, tmp_path, capsys):
    assert run.main(["--list"], {}) == 0 and "coverage_matrix" in capsys.readouterr().out.split()
    assert run.main(["no_such_query"], {}) == 2
    assert run.main(["coverage_matrix", "--summary-only"], {"STROPHE_DATA": data}) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["rows"] > 0
    assert run.main(["coverage_matrix", "--explain", "--data", data], {}) == 0 and "Scan parquet" in capsys.readouterr().out
    assert run.main(["coverage_matrix"], {"STROPHE_DATA": data, "STROPHE_OUT": str(tmp_path), "STROPHE_FORMAT": "json"}) == 0
    assert spark.read.json(f"{tmp_path}/coverage_matrix").count() > 0
    assert run.Settings.of({"STROPHE_MASTER": "local[2]"}) == run.Settings(master="local[2]")
