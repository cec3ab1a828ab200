"""Queries take whole inputs: what a cut, a filter or a cap would leave out is in the fixtures."""

import datetime
import random

from pyspark.sql import functions as F

from strophe.operators import kernels as K, sampling as R
from strophe.plans import joins, models, sequences, statistics

START = datetime.datetime(2024, 1, 1)


def write_events(spark, to, rows):
    """rows: (event_id, user_id, event_type, value); one event a minute in the order of the rows."""
    out = [(e, START + datetime.timedelta(minutes=i), u, t, v) for i, (e, u, t, v) in enumerate(rows)]
    spark.createDataFrame(out, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{to}/events.parquet")
    return str(to)


def test_alignment_takes_whole_sequences(spark, tmp_path):
    rng = random.Random(4)
    a = [rng.randrange(48) for _ in range(95)]
    b = [rng.randrange(48) for _ in range(62)] + a[60:]  # only what follows the sixtieth note is alike
    rows = [(i, u, "click", float(v)) for i, (u, v) in enumerate([(1, v) for v in a] + [(2, v) for v in b])]
    got = models.melodic_alignment(spark, write_events(spark, tmp_path, rows)).collect()
    p, q = [36 + v for v in a], [36 + v for v in b]
    assert [tuple(r) for r in got] == [(1, 2, K.align_local(p, q), K.agreement(p, q), K.agreement(p, q, inside=True))]
    assert got[0].local != K.align_local(p[:60], q[:60])


def test_components_of_all_lines(spark, tmp_path):
    rng = random.Random(6)
    lines = [(rng.randrange(30), rng.randrange(60), float(rng.choice([50, 7])), 0.1, 0.08) for _ in range(40)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for s, p, *_ in lines:
        parent[find(f"s{s}")] = find(f"p{p}")
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    got = {r.node: r.root for r in statistics.connected_groups(spark, str(tmp_path)).collect()}
    assert got == {x: min(g) for g in groups.values() for x in g} and len(groups) > 3


def test_every_event_is_scored(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, rng.randrange(21), rng.choice("ab"), float(rng.randrange(9))) for i in range(300)] + [(300, 1, "c", 1.0)]
    null = {t: [v for _, u, k, v in rows if u % 7 == 0 and k == t] for t in "abc"}
    want = {e: round(100 * sum(x < v for x in null[t]) / len(null[t]), 4) for e, u, t, v in rows if u % 7 and null[t]}
    got = {r.event_id: r.percentile for r in sequences.null_percentile(spark, write_events(spark, tmp_path, rows)).collect()}
    assert got == want


def test_pairs_of_all_folds(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"i{i:02}", rng.choice(["s", "t", None]), rng.choice("xy"), rng.randrange(5), rng.choice(["site", "county"])) for i in range(40)]
    spark.createDataFrame(rows, "item_id string, song_key string, region string, fold int, geo_level string").write.parquet(f"{tmp_path}/recordings.parquet")
    want = sorted((a[1], a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] and a[1:3] == b[1:3])
    assert sorted(tuple(r) for r in joins.pairs_in_groups(spark, str(tmp_path)).collect()) == want


def greedy(rows, n):
    """rows: (region, rank, id, *values) in any order."""
    out, picks, seen = [], {}, {}
    for g, _, i, *values in sorted(rows, key=lambda r: r[1:3]):
        mine = {(k, v) for k, v in enumerate(values) if v is not None}
        if picks.get(g, 0) < n and not mine & seen.setdefault(g, set()):
            picks[g] = picks.get(g, 0) + 1
            seen[g] |= mine
            out.append((g, i, picks[g]))
    return sorted(out)


def test_greedy_takes_rows_behind_a_hot_channel(spark):
    # the eight best rows of s2 are all of the channel that s1 has taken
    rows = [("r", 0, "a", "s1", "C", "p0")] + [("r", 1, f"b{i}", "s2", "C", f"p{i}") for i in range(8)] + [("r", 2, "c", "s2", "D", "q"), ("r", 3, "d", None, None, None), ("r", 4, "e", None, None, None)]
    rng = random.Random(9)
    for g in range(6):
        rows += [(f"g{g}", rng.randrange(3), f"x{g}{i:03}", rng.choice(["s1", "s2", "s3", "s4", None]), rng.choice(["C"] * 9 + ["D", "E", "F", None]), rng.choice([f"p{rng.randrange(9)}", None])) for i in range(60)]
    df = spark.createDataFrame(rows, "region string, rank int, id string, song string, ch string, singer string").repartition(5)
    got = R.greedy_distinct(df, "region", [F.col("rank")], 8, ["song", "ch", "singer"], "id")
    want = greedy(rows, 8)
    assert sorted(tuple(r) for r in got.collect()) == want and ("r", "c", 2) in want
    assert got.schema.simpleString() == "struct<region:string,id:string,pick:int>"
    assert R.greedy_distinct(df.where("false"), "region", [F.col("rank")], 8, ["song", "ch", "singer"], "id").count() == 0
