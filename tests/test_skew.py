import random

from strophe.operators.skew import join_split
from strophe.operators.spatial import near_keys


def test_equals_plain_join(spark):
    """Hot keys, nulls, repeated rows and empty tables: the rows of a plain join, whatever the bound."""
    rng = random.Random(1)
    a = spark.createDataFrame([(rng.choice(["hot"] * 6 + ["x", "y", None]), i % 40) for i in range(300)], "k string, a int")
    b = spark.createDataFrame([(rng.choice(["hot", "x", "y", "z", None]), i) for i in range(60)], "k string, b int")
    want = sorted(map(tuple, a.join(b, ["k"]).collect()))
    for hot in (1, 7, 100_000):
        assert sorted(map(tuple, join_split(a, b, ["k"], hot).select("k", "a", "b").collect())) == want
    assert join_split(a.where("false"), b, ["k"]).count() == 0 and join_split(a, b.where("false"), ["k"]).count() == 0


def test_hot_position(spark):
    rows = [(f"p{i:04d}", 100.0, 30.0) for i in range(120)] + [("q", 100.001, 30.0), ("r", 120.0, 30.0)]
    df = spark.createDataFrame(rows, "id string, lon double, lat double")
    assert near_keys(df, "id", "lon", "lat", 0.5).count() == 120 * 119 // 2 + 120
