"""Windows of streams are written once, late rows within the watermark count, later ones do not."""

import datetime
import os
import time

from pyspark.sql import functions as F

from strophe.streaming import windows as S

START = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, value double"


def put(spark, path, rows, n):
    """One file, with a time of its own so that files come in order."""
    spark.createDataFrame([(i, START + datetime.timedelta(hours=h), 1.0) for i, h in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    for f in os.listdir(path):
        if f.endswith(".parquet") and f not in put.seen:
            put.seen.add(f)
            os.utime(f"{path}/{f}", (time.time() - 1000 + n * 10,) * 2)


put.seen = set()


def test_late_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    # the fourth file holds a row five hours late (within six) and one twenty hours late; the last ones move the watermark past all
    for n, rows in enumerate(([(1, 0), (2, 1)], [(3, 24), (4, 25)], [(7, 26)], [(5, 20), (6, 5)], [(8, 500)], [(9, 501)])):
        put(spark, path, rows, n)
    seen = []
    e = S.with_event_time(S.event_stream(spark, path, per_trigger=1), "ts", "6 hours")
    w = S.tumbling(e, "ts", "2 hours", [], {"n": F.count("*"), "ids": F.sort_array(F.collect_list("id"))})
    out = S.run_to_end(w, "append", each=lambda df, n: seen.append((n, sorted(r.start for r in df.collect()))))
    got = {(r.start - START).total_seconds() / 3600: r.ids for r in out.collect()}
    assert got == {0: [1, 2], 24: [3, 4], 20: [5], 26: [7]}  # 6 was too late, 8 and 9 are not complete
    starts = [s for _, ss in seen for s in ss]
    assert len(starts) == len(set(starts)) == 4  # every window once


def test_closed_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, START + datetime.timedelta(minutes=37 * i), float(i)) for i in range(50)], SCHEMA)
    e = S.with_event_time(S.event_stream(spark, S.closed(df, "ts", str(tmp_path / "c"))), "ts", "1 hour")
    aggs = {"n": F.count("*"), "total": F.sum("value")}
    assert sorted(map(tuple, S.run_to_end(S.tumbling(e, "ts", "3 hours", [], aggs)).collect())) == sorted(map(tuple, S.tumbling(df, "ts", "3 hours", [], aggs).collect()))


def test_update_mode_keeps_the_last_state(spark, tmp_path):
    path = str(tmp_path / "u")
    for n, rows in enumerate(([(1, 0), (2, 1)], [(1, 5)])):
        put(spark, path, rows, n)
    u = S.run_to_end(S.latest(S.event_stream(spark, path, per_trigger=1), "id", ["ts"], ["ts"]), "update")
    assert {(r.id, r.batch) for r in u.collect()} == {(1, 0), (2, 0), (1, 1)}
