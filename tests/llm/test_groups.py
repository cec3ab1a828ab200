import random

from pyspark.sql import functions as F

from strophe.llm.groups import assign_splits, record_groups
from strophe.llm.groups_queries import QUERIES as G, SQL as GS, channel
from strophe.llm.lookalike import lookalike_classes, lookalike_pairs
from strophe.llm.lookalike_queries import QUERIES as L, SQL as LS
from tests.compare import by_sql, canonical


def test_queries_equal_sql(spark, data):
    for queries, sql in ((G, GS), (L, LS)):
        for name, text in sql.items():
            assert canonical(queries[name](spark, data).toPandas()) == canonical(by_sql(text, data)), name


def test_groups_equal_union_find(spark):
    rng = random.Random(2)
    rows = [(f"r{i:03d}", rng.choice([None, "hot", *[f"c{k}" for k in range(40)]]), rng.choice([None, *[f"s{k}" for k in range(60)]]), "x") for i in range(150)]
    rows += [rows[0], (None, "c1", "s1", "x"), ("r900", "c77", None, "x"), ("r900", None, "s77", "x"), ("r901", "c77", None, "x"), ("r902", None, "s77", "x")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, c, s, _ in rows:
        if r is None:
            continue
        find(r)
        for k in ("c" + c if c else None, "s" + s if s else None):
            if k:
                parent[find(r)] = find(k)
    members = {}
    for r in {x[0] for x in rows if x[0]}:
        members.setdefault(find(r), set()).add(r)
    want = {r: (min(g), len(g)) for g in members.values() for r in g}
    df = spark.createDataFrame(rows, "id string, ch string, si string, group_id string")
    got = record_groups(df, "id", {"c": F.col("ch"), "s": F.col("si")})
    assert {r["id"]: (r.group_id, r["size"]) for r in got.collect()} == want and got.count() == len(want)
    assert record_groups(df.where("false"), "id", {"c": F.col("ch"), "s": F.col("si")}).count() == 0


def test_channel_keys(spark):
    keys = ["danmu:x1", "danmu:", "danmu:nan", "danmu:None", "danmu:NULL", "", "NA", None, "plain", "vidhub:UChundredvalleys00"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "channel_key string").select(channel()).collect()]
    assert got == ["danmu:x1"] + [None] * 9


def test_splits(spark):
    rng = random.Random(4)
    rows = [(f"i{i}", f"g{int(rng.paretovariate(1.1))}", rng.choice(["a", "b", None])) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id string, group_id string, region string")
    s = assign_splits(df, "group_id", "region", {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert s.count() == s.select("group_id").distinct().count() == df.select("group_id").distinct().count()
    n = {r.split: r.n for r in df.join(s, "group_id").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sum(n.values()) == 20_000 and n["train"] >= 0.7 * 20_000
    even = spark.range(20_000).select(F.col("id").cast("string").alias("group_id"), (F.col("id") % 3).cast("string").alias("region"))
    e = even.join(assign_splits(even, "group_id", "region", {"train": 0.8, "validation": 0.1, "test": 0.1}), "group_id")
    for r in e.groupBy("region").agg(*[F.avg((F.col("split") == x).cast("int")).alias(x) for x in ("train", "validation", "test")]).collect():
        assert abs(r.train - 0.8) < 0.01 and abs(r.validation - 0.1) < 0.01 and abs(r.test - 0.1) < 0.01
    assert assign_splits(df.where("false"), "group_id", "region", {"train": 1.0}).count() == 0


def test_large_groups(spark):
    """A group of half a stratum leaves the others in proportion: it lies in the large split, and the small ones are filled."""
    for seed in range(5):
        rows = [(f"big{seed}" if i % 2 else f"g{seed}-{i // 20}", "a") for i in range(20_000)]
        df = spark.createDataFrame(rows, "group_id string, region string")
        s = df.join(assign_splits(df, "group_id", "region", {"train": 0.8, "validation": 0.1, "test": 0.1}), "group_id")
        n = {r.split: r["count"] / 20_000 for r in s.groupBy("split").count().collect()}
        assert abs(n["validation"] - 0.1) < 0.02 and abs(n["test"] - 0.1) < 0.02


def test_lookalikes(spark):
    same = [["Café ａ", "Café a", "Cаfé a", "Caf​é  a ", "　Café a"], ["⼭歌（甲）", "山歌(甲)", "山歌❨甲❩"], ["a·b", "a•b", "a・b"]]
    apart = ["山歌〔甲〕", "山歌[甲]", "cafe a", "café a", "Cafea", "圖", "图", "山歌", "x" * 50_000]
    none = [None, "", "NA", "nan", "None", "​"]
    rows = [("t", v, "k") for g in same for v in g] + [("t", v, "k") for v in apart + none] + [("t", "山歌", "k"), ("u", "山歌(甲)", "k")]
    df = spark.createDataFrame(rows, "field string, value string, canonical string")
    c = {(r.field, r.value): r.canonical for r in lookalike_classes(df).collect()}
    assert {v for f, v in c} == {v for g in same for v in g} | set(apart)
    for g in same:
        assert len({c["t", v] for v in g}) == 1
    assert c["t", same[1][0]] == "山歌(甲)" and c["u", "山歌(甲)"] == "山歌(甲)"
    assert len({c["t", v] for v in apart}) == len(apart)
    p = {(r.value_a, r.value_b) for r in lookalike_pairs(df).collect()}
    assert p == {(a, b) for g in same for a in g for b in g if a.encode() < b.encode()}
    assert lookalike_pairs(df.where("false")).count() == 0
