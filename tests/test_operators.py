import itertools
import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from strophe.operators import kernels as K, sampling as R, sequences as S, stats as X
from strophe.operators.components import connected
from strophe.operators.ordered import number_rows, running_totals
from strophe.operators.relational import conform, contained_pairs, keep_first, keep_last, lookup, nearest_join, overlap_join, override, reindex, replace_by_key, upsert_registry
from strophe.operators.similarity import cosine_pairs, fuzzy_pairs, unit_vectors
from strophe.operators.vectors import exact_neighbours
from strophe.plans import extras


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    for n, m in ((1, 0), (30, 20), (200, 190), (60, 400)):
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] + [(None, "x"), ("x", None), ("y", "y")]
        edges += [(f"hub{n}", f"h{i}") for i in range(50)] + [(f"c{i}", f"c{i + 1}") for i in range(40)]
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a and b and a != b:
                parent[find(a)] = find(b)
        groups = {}
        for x in list(parent):
            groups.setdefault(find(x), []).append(x)
        want = {x: min(g) for g in groups.values() for x in g}
        got = {r[0]: r[1] for r in connected(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
        assert got == want
    assert connected(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_keyed(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"), (None, 0, "w")], "k string, o int, v string")
    assert sorted(map(tuple, keep_first(df, ["k"], [F.col("o")]).collect()), key=str) == sorted([("a", 1, "y"), (None, 0, "w")], key=str)
    assert sorted(map(tuple, keep_last(df, ["k"], [F.col("o")]).collect()), key=str) == sorted([("a", 2, "x"), (None, 1, "z")], key=str)
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert sorted(((r.k, r.v) for r in lookup(left, df, ["k"], [F.col("o")], ["v"]).collect()), key=str) == sorted([("a", "x"), ("b", None), (None, None)], key=str)
    assert keep_first(df.where("false"), ["k"], [F.col("o")]).count() == 0


def test_conform_reindex_override(spark):
    df = spark.createDataFrame([("1", "x")], "a string, extra string")
    import pyspark.sql.types as T

    schema = T._parse_datatype_string("b double, a int")
    assert conform(df, schema).collect()[0].asDict() == {"b": None, "a": 1}
    assert conform(df, schema, extras=True).columns == ["b", "a", "extra"]
    dom = spark.createDataFrame([("p",), ("q",)], "k string")
    n = spark.createDataFrame([("p", 3)], "k string, n int")
    assert {tuple(r) for r in reindex(n, dom, ["k"], {"n": 0}).collect()} == {("p", 3), ("q", 0)}
    o = spark.createDataFrame([("p", "n", "9")], "k string, field string, value string")
    assert {tuple(r) for r in override(n.withColumn("n", F.col("n").cast("string")), o, "k", ["n"]).collect()} == {("p", "9")}


def test_registry(spark):
    reg = spark.createDataFrame([("b", 1), ("a", 2)], "k string, id long")
    new = spark.createDataFrame([("z",), ("c",), ("a",), ("c",)], "k string")
    assert {tuple(r) for r in upsert_registry(reg, new, ["k"], "id", [F.col("k")]).collect()} == {("b", 1), ("a", 2), ("c", 3), ("z", 4)}
    assert {tuple(r) for r in upsert_registry(reg.where("false"), new, ["k"], "id", [F.col("k")]).collect()} == {("a", 1), ("c", 2), ("z", 3)}
    got = replace_by_key(reg, spark.createDataFrame([("a", 7)], "k string, id long"), ["k"])
    assert {tuple(r) for r in got.collect()} == {("b", 1), ("a", 7)}


def test_running_totals(spark):
    rows = [(i, (i * 7) % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    want = dict(zip(range(500), itertools.accumulate(v for _, v in rows)))
    assert {r.k: r.cum_v for r in running_totals(df, ["k"], ["v"]).collect()} == want
    assert {r.k: r.n for r in number_rows(df, [F.desc("k")], "n").collect()} == {k: 500 - k for k in range(500)}


def test_range_joins_equal_brute_force(spark):
    rng = random.Random(2)
    a = [(i, i % 3, s := rng.uniform(0, 100), s + rng.uniform(0.1, 30)) for i in range(60)]
    b = [(i, i % 3, s := rng.uniform(0, 100), s + rng.uniform(0.1, 5)) for i in range(60)]
    cols = "id int, g int, s double, e double"
    o = overlap_join(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), ["g"], 10.0, ("s", "e"), ("s", "e"))
    got = sorted((r["id"], r["id_b"]) for r in o.collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    n = nearest_join(spark.createDataFrame(a, cols), spark.createDataFrame([*b, (99, 0, a[0][2], 0.0)], cols), ["g"], "s", "s").collect()
    for r in n:
        best = min((abs(y[2] - r["s"]), y[2]) for y in [*b, (99, 0, a[0][2], 0.0)] if y[1] == r["g"])
        assert abs(r["nearest"] - best[1]) < 1e-12
    lonely = nearest_join(spark.createDataFrame([(1, 7, 0.0, 1.0)], cols), spark.createDataFrame(b, cols), ["g"], "s", "s").collect()
    assert lonely[0]["nearest"] is None


def test_text_joins_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcd木") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    a = spark.createDataFrame([(w,) for w in words[:60]] + [(None,), ("",)], "x string")
    b = spark.createDataFrame([(w,) for w in words[60:]] + [(None,)], "y string")
    got = {(r.x, r.y) for r in fuzzy_pairs(a, b, "x", "y", 80.0).collect()}

    def lcs(s, t):
        row = [0] * (len(t) + 1)
        for ch in s:
            prev = 0
            for j, d in enumerate(t, 1):
                prev, row[j] = row[j], prev + 1 if ch == d else max(row[j], row[j - 1])
        return row[-1]

    assert all(K.lcs_length(s, t) == lcs(s, t) for s in words[:30] for t in words[60:90])
    ratio = lambda s, t: 200.0 * lcs(s, t) / (len(s) + len(t))
    assert got == {(s, t) for s in words[:60] for t in words[60:] if len(s) >= 3 and len(t) >= 3 and ratio(s, t) >= 80}
    inside = {tuple(r) for r in contained_pairs(a, b, ("x", "y"), ("x", "y")).collect()}
    assert inside == {(s, t) for s in words[:60] for t in words[60:] if len(s) >= 3 and s in t and len(s) >= 0.5 * len(t)}


def test_cosine_pairs_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(f"d{i}", f"t{rng.randrange(25)}") for i in range(60) for _ in range(8)]
    u = unit_vectors(spark.createDataFrame([*rows, (None, "t1"), ("d1", None)], "id string, term string"), "id", "term")
    v = {}
    for r in u.collect():
        v.setdefault(r.id, {})[r.term] = r.w
    assert all(abs(sum(x * x for x in d.values()) - 1) < 1e-9 for d in v.values())
    for least in (0.3, 0.6, 0.9):
        want = {(a, b) for a in v for b in v if a < b and sum(w * v[b].get(t, 0) for t, w in v[a].items()) >= least}
        assert {(r.a, r.b) for r in cosine_pairs(u, "id", "term", least).collect()} == want


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(80, 5))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, [0.0] * 5), (901, None)], "id long, v array<double>").repartition(5)
    got = {}
    for r in exact_neighbours(df.where("id % 10 = 0"), df, "id", "v", 3, block=4).collect():
        got.setdefault(r["query"], set()).add(r["neighbour"])
    u = m / np.linalg.norm(m, axis=1)[:, None]
    for q in range(0, 80, 10):
        s = u @ u[q]
        s[q] = -9
        assert got[q] == set(np.argsort(-s)[:3].tolist())


def test_sequences(spark):
    n = spark.createDataFrame([("a", 0.0, 1.0, 60), ("a", 0.0, 2.0, 64), ("a", 1.0, 5.0, 64), ("a", 2.0, 1.0, 62), ("b", 0.0, 1.0, 60)], "item string, onset double, dur double, pitch int")
    m = sorted(tuple(r) for r in S.monophonic(n).collect())
    assert m == [("a", 0.0, 1.0, 64), ("a", 1.0, 1.0, 64), ("a", 2.0, 1.0, 62), ("b", 0.0, 1.0, 60)]
    r = sorted(tuple(x)[:4] for x in S.merge_repeats(S.monophonic(n)).collect())
    assert r == [("a", 0.0, 2.0, 64), ("a", 2.0, 1.0, 62), ("b", 0.0, 1.0, 60)]
    up = n.withColumn("pitch", F.col("pitch") + 5)
    t = {0: 1.0, 4: 1.0, 7: 1.0}
    a = {r["item"]: r["tonic"] for r in S.best_rotation(S.pitch_classes(n), t).collect()}
    b = {r["item"]: r["tonic"] for r in S.best_rotation(S.pitch_classes(up), t).collect()}
    assert S.best_rotation(S.pitch_classes(n.where("false")), t).count() == 0 and set(a) == set(b) == {"a", "b"}
    f = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, None, None, 4.0, None, None, None, None, None, None, None, 12.0, None])], "item string, pos int, v double")
    got = [r["filled"] for r in S.interpolate(f, "item", "pos", "v", 5).orderBy("pos").collect()]
    assert got[:10] == [1, 2, 3, 4, 5, 6, 7, 8, 9, None] and got[11:] == [12, None]
    one = spark.range(1).select(*[S.sliding(F.lit(k), 4, 2).alias(f"n{k}") for k in (3, 4, 5, 8)]).first()
    assert [list(x) for x in one] == [[0], [0], [0, 1], [0, 2, 4]]


def test_kernels():
    assert K.indel_ratio("", "") == 100 and K.indel_ratio("ab", "ab") == 100 and K.indel_ratio("a", "b") == 0
    q = [60, 62, 64, 65, 67, 69, 71, 72]
    assert K.align_local(q, [x + 3 for x in q]) == 1.0 and K.align_local(q[:7], q) is None
    cost, pairs = K.align_global([1, 2, 3], [1, 3])
    assert cost == 1 and pairs == [(0, 0), (2, 1)]
    assert K.align_global([9, 9, 1, 2, 9], [1, 2], free_ends=True) == (0.0, [(2, 0), (3, 1)])
    assert K.agreement(q, [x + 5 for x in q]) == 1.0 and K.agreement([1, 2, 3], q) is None
    # whole octaves are shifted, neighbours across the octave are a semitone apart, and a part may be sought inside
    assert K.best_shift([60, 62, 64, 67], [38, 40, 42, 45]) == 22 and K.best_shift(q, [x - 24 for x in q]) == 24
    assert K.agreement([71, 72, 71, 72, 71], [71, 72, 71, 72, 71]) == 1.0 and K.align_global([71, 60], [72, 60])[0] == 0.5
    assert K.agreement([50, 52] + q + [40, 41, 43], q, inside=True) == 1.0 > K.agreement([50, 52] + q[::-1] + [40], q, inside=True)
    rng = random.Random(9)
    for _ in range(30):
        a, b = ([rng.randrange(50, 60) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        best = {}

        def cheapest(i, j):
            if (i, j) not in best:
                ways = [cheapest(i - 1, j) + 1] if i else []
                ways += [cheapest(i, j - 1) + 1] if j else []
                ways += [cheapest(i - 1, j - 1) + min(abs(a[i - 1] - b[j - 1]), 2) / 2] if i and j else []
                best[i, j] = min(ways, default=0)
            return best[i, j]

        cost, pairs = K.align_global(a, b)
        gaps = len(a) + len(b) - 2 * len(pairs)
        assert cost == cheapest(len(a), len(b)) == gaps + sum(min(abs(a[i] - b[j]), 2) / 2 for i, j in pairs)
    rng = random.Random(9)
    for _ in range(30):
        g = {u: [v for v in range(6) if rng.random() < 0.3] for u in range(6)}
        best = max((sum(1 for u, v in zip(range(6), p) if v in g[u]) for p in itertools.permutations(range(6))))
        m = K.match_one_to_one(g)
        assert len(m) == best == len(set(m.values())) and all(v in g[u] for u, v in m.items())
        c = np.array([[rng.randrange(20) for _ in range(5)] for _ in range(4)], float)
        want = min(sum(c[i, p[i]] for i in range(4)) for p in itertools.permutations(range(5), 4))
        assert sum(c[i, j] for i, j in enumerate(K.assign(c))) == want
    assert K.note_scores(np.array([[0, 60], [1, 60]]), np.array([[0.01, 60], [0.02, 60]])) == (0.5, 0.5, 0.5)
    assert K.vote([[(0, 1, 60)], [(0.02, 1, 60)], [(5, 6, 60)]]) == [(0.01, 1.0, 60)]
    assert K.quantise([(0.0, 0.26, 60), (0.3, 0.32, 61), (1.0, 1.5, 62)]) == [(0.0, 0.25, 60), (0.25, 0.75, None), (1.0, 0.5, 62)]
    assert K.split_steps([0.0] * 8 + [2.0] * 8) == [(0, 8), (8, 16)] and K.split_steps([]) == []
    d = np.array([[0, 1, 8, 9], [1, 0, 8, 9], [8, 8, 0, 2], [9, 9, 2, 0]], float)
    t = K.tree(d)
    assert K.cut_tree(t, 4, 2) == [0, 0, 1, 1] and K.cophenetic(t, 4)[0, 3] == 8.5
    r, p = K.mantel(d, d, 99)
    assert abs(r - 1) < 1e-12 and p <= 0.5
    assert len(K.partitions(5, 2)) == 15
    assert K.climb([0, 1, 0, 1], lambda x: float(x[0] == x[1]) + float(x[2] == x[3]))[1] == 2
    assert abs(K.chance_recall(10, 2, 3) - (1 - math.comb(8, 3) / math.comb(10, 3))) < 1e-12
    assert K.augment([(0, 1, 60)], "k") == K.augment([(0, 1, 60)], "k")
    assert "清江" in K.variant_keys("12. 云南清江山歌（现场）", places=("云南",))


def test_statistics(spark):
    assert abs(X.chi_square_tail(3.841459, 1) - 0.05) < 1e-6 and abs(X.chi_square_tail(18.307038, 10) - 0.05) < 1e-6 and X.chi_square_tail(0, 3) == 1
    assert abs(X.chi_square_tail(124.342113, 100) - 0.05) < 1e-6
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 3.0), ("c", None), (None, 4.0)], "g string, v double")
    k = X.kruskal_wallis(df, "g", "v").first()
    assert (k.n, k.k) == (4, 2) and abs(k.h - 1.5) < 1e-9
    p = X.with_p_value(spark.createDataFrame([(3.841459, 1), (None, 2)], "s double, d int"), "s", "d").collect()
    assert abs(p[0].p - 0.05) < 1e-6 and (p[1].p is None or p[1].p != p[1].p)


def test_folds_and_samples(spark):
    rng = random.Random(8)
    rows = [(f"g{int(rng.paretovariate(0.6)) % 300}", rng.choice("xyz"), i) for i in range(3000)] + [(None, "x", -1)]
    df = spark.createDataFrame(rows, "g string, l string, i int")
    f = R.group_folds(df, "g", "l", 5)
    assert f.count() == f.select("g").distinct().count() == df.where("g is not null").select("g").distinct().count()
    a = {tuple(r) for r in f.collect()}
    assert a == {tuple(r) for r in R.group_folds(df.repartition(9), "g", "l", 5).collect()}
    d = df.repartition(6)
    assert [r.i for r in R.sample(df, 20, "s", "i").collect()] == [r.i for r in R.sample(d, 20, "s", "i").collect()]
    e = spark.createDataFrame([("r", f"i{i}", f"s{i % 3}", f"c{i % 2}") for i in range(20)] + [("r", "j", None, None)], "region string, id string, song string, ch string")
    got = R.greedy_distinct(e, "region", [F.col("id")], 8, ["song", "ch"], "id").collect()
    songs = {r["id"]: r for r in e.collect()}
    for c in ("song", "ch"):
        v = [songs[r["id"]][c] for r in got if songs[r["id"]][c] is not None]
        assert len(v) == len(set(v))


def test_release_and_folder(spark, monkeypatch):
    """Rounds leave nothing behind, and a cluster without a shared folder is refused."""
    import os

    import pytest

    from strophe import session

    a = session.cut(spark.range(10))
    at = a._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(at) and a.count() == 10
    session.release(a)
    session.release(spark.range(3))
    assert not os.path.isdir(at)
    folder = session.checkpoint_dir(spark).removeprefix("file:")
    before = len(os.listdir(folder))
    assert connected(spark.range(50).selectExpr("concat('n', id) as a", "concat('n', id + 1) as b"), "a", "b").count() == 51
    assert len([x for x in os.listdir(folder) if x.startswith("rdd")]) <= before + 1

    class Unset:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Sc:
                    @staticmethod
                    def getCheckpointDir():  # noqa: N802
                        class No:
                            @staticmethod
                            def isDefined():  # noqa: N802
                                return False

                        return No

                return Sc

    class Session:
        sparkContext = Unset

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return None

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.checkpoint_dir(Session)


def test_split_steps_by_its_definition():
    """Levels from heaps are those of medians taken anew; a long run without a change costs no more a value than a short one."""
    rng = random.Random(4)
    for _ in range(300):
        v = [rng.choice([0.0, 0.2, 1.0, 2.5]) + (k // 9 % 2) * rng.random() * 2 for k in range(rng.randrange(60))]
        if rng.random() < 0.3 and v:
            v[rng.randrange(len(v))] = float("nan")
        want, start = [], 0
        for i in range(len(v)):
            level = np.median(v[start:i]) if i > start else None
            if i - start >= 5 and i + 5 <= len(v) and abs(v[i] - level) >= 0.5 and abs(np.median(v[i : i + 5]) - level) >= 0.5:
                want.append((start, i))
                start = i
        assert K.split_steps(v) == want + [(start, len(v))] * bool(v)
    began = time.process_time()
    assert K.split_steps([0.0, 0.0, 0.0, 2.0] * 12_500) == [(0, 50_000)]
    assert time.process_time() - began < 5


def test_missed_segments_in_batches(spark, tmp_path):
    """Runs that end within, at and after a batch, values that are missing, and no group a run."""
    rows = []
    for u in (None, 1, 2, 3):
        t = 0
        for k in range(70):
            t += rng_gap(u, k)
            rows.append((u, t * 1_000_000, "error" if k % 11 == 3 else "click", None if u == 3 and k == 5 else float((k // 8 % 2) * 300 + k % 3)))
    e = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "event_id long, user_id long, us long, event_type string, value double")
    e.select("event_id", "user_id", F.timestamp_micros("us").alias("ts"), "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = {}
    for n in (10_000, 1, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        df = extras.missed_segments(spark, str(tmp_path))
        got[n] = sorted(map(tuple, df.collect()), key=str)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[1] == got[7] == got[10_000] and {r[0] for r in got[1]} == {None, 1, 2, 3}
    assert sum(r[2] for r in got[1]) == sum(r[2] != "error" for r in rows) and len(got[1]) == len({r[:2] for r in got[1]}) > 8
    assert any(r[3] is None for r in got[1] if r[0] == 3) and all(r[3] is not None for r in got[1] if r[0] != 3)
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()


def rng_gap(u: int | None, k: int) -> int:
    """Seconds between two events: gaps that end a run at other places for each user."""
    return 50_000 if k % (13 + (u or 0)) == 12 else 600
