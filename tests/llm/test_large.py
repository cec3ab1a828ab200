"""Components that no single task takes are clustered as small ones are."""

import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from strophe.llm.linking import average_linkage, cluster_links, compact, form_vectors, link_in_rounds, meeting, pairs_in_blocks, similar_forms
from strophe.llm.naming import Rule


def test_rounds_equal_average_linkage(spark):
    rng = random.Random(2)
    pairs = {}
    for r in range(1, 7):
        where = [rng.random() * 3 for _ in range(14)]
        pairs[r] = [(a, b, round(s + rng.random() * 1e-3, 9)) for a in range(14) for b in range(a + 1, 14) if (s := 1 - abs(where[a] - where[b])) > 0.05]
    items = spark.createDataFrame([(r, c) for r in pairs for c in range(14)], "r int, c int")
    sims = spark.createDataFrame([(r, *p) for r in pairs for p in pairs[r]], "r int, a int, b int, s double")
    want = {r: average_linkage(14, pairs[r], 0.4) for r in pairs}
    assert all(1 < len(set(x)) < 14 for x in want.values())
    for most in (0, 6):
        got = {(x.r, x.c): x.label for x in link_in_rounds(items, sims, 0.4, most).collect()}
        assert got == {(r, c): x for r in want for c, x in enumerate(want[r])}


def test_large_components_equal_small_ones(spark):
    """Every form of a component above the bound comes back, in the cluster it has below the bound."""
    rng = random.Random(3)
    rows = []
    for c in range(3):
        at = [rng.random() * 3 for _ in range(15)]
        for a in range(15):
            for b in range(a + 1, 15):
                s = 1 - abs(at[a] - at[b]) / 2 + rng.random() * 1e-3
                rows.append((f"c{c}-{a:02}", f"c{c}-{b:02}", round(s, 6), s > 0.55)) if s > 0.2 else None
    pairs = spark.createDataFrame(rows, "id_a string, id_b string, cos double, link boolean")
    small = sorted(tuple(r) for r in cluster_links(pairs, 0.4).collect())
    linked = {x for a, b, _, link in rows if link for x in (a, b)}
    assert {i for i, _ in small} == linked and 3 < len({c for _, c in small}) < len(linked)
    for most in (1, 5):
        assert sorted(tuple(r) for r in cluster_links(pairs, 0.4, most=most).collect()) == small


def moved(spark):
    """Records written by all shuffles of the session so far."""
    jvm = spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    none = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}


def test_pairs_that_share_ngrams_are_not_moved(spark):
    """Nearly every two of these forms share an n-gram and few are alike: the records moved follow the forms, not the pairs."""
    rng = random.Random(5)
    names = [[rng.choice("abcdefghij") + "a" for _ in range(12)] for _ in range(800)]
    rows = [(f"i{k:03}", "f", "", x, ["".join(x)], json.dumps([x]), True) for k, x in enumerate(names)]
    forms = spark.createDataFrame(rows, "id string, field string, label string, syllables array<string>, words array<string>, parts string, latin boolean").cache()
    before = moved(spark)
    similar_forms(forms, {"f": (None, Rule(letters=3, cosine=0.6))}).count()
    records = sum(n for k, n in moved(spark).items() if k not in before)
    assert 0 < records < 800 * 150 < 800 * 799 / 2


def test_rules_drop_no_pair_they_accept(spark):
    """Only links and short forms, from blocks of a few forms: those among all pairs."""
    rng = random.Random(6)
    forms = []
    for k in range(60):
        x = [[rng.choice(["ba", "bo", "da", "do", "ga"]) for _ in range(rng.randrange(1, 4))] for _ in range(2)]
        slip = "".join(x[1][:-1]) + "ab"
        for v in (x, x[::-1], [[x[0][0]], x[1]], [x[0], [slip]], [x[0], x[1][1:]], [x[0] + x[1]]):
            forms.append((v, rng.random() < 0.5))
    one = {("".join(s for p in v for s in p), lat): v for v, lat in forms}
    rows = [(f"{f}{a}{lat}", f, "", [s for p in v for s in p], ["".join(p) for p in v], json.dumps(v), lat) for f in "xyz" for (a, lat), v in one.items()]
    df = spark.createDataFrame(rows, "id string, field string, label string, syllables array<string>, words array<string>, parts string, latin boolean").where("size(syllables) > 0").cache()
    kinds = {"x": (None, Rule(short_first=True, cosine=0.15)), "y": (None, Rule(syllable_edits=2)), "z": (None, Rule(turned=False, letters=3, letter_edits=2, least=2))}
    every = {(r.id_a, r.id_b): (r.cos, r.link, r.short) for r in similar_forms(df, kinds).collect()}
    want = {k: v for k, v in every.items() if v[1] or v[2]}
    assert {k[0][0] for k in want} == {"x", "y", "z"} and any(v[2] for v in want.values()) and 0 < len(want) < len(every)
    assert {(r.id_a, r.id_b): (r.cos, r.link, r.short) for r in similar_forms(df, kinds, only=True).collect()} == want
    h = df.withColumn("h", F.xxhash64("id"))
    vectors = compact(form_vectors(df, kinds))
    for hot in (7, 90):
        got = pairs_in_blocks(h, vectors, ["field", "label"], hot=hot).collect()
        assert {(r.id_a, r.id_b): r.cos for r in got} == {k: v[0] for k, v in every.items()} and len(got) == len(every)
        assert set(want) <= {(r.id_a, r.id_b) for r in pairs_in_blocks(h, vectors, ["field", "label"], kinds, hot=hot).collect()}
    assert pairs_in_blocks(h.where("false"), vectors, ["field", "label"], kinds).count() == 0


def test_runs_of_rows_change_nothing():
    """However few cells are held at once, the pairs of a task are the same."""
    rng = random.Random(7)
    n = 40
    grams = [rng.sample(range(30), 6) for _ in range(n)]
    for low, high in ((0, 0), (0, 1)):
        t = pa.table({"low": [low] * n, "high": [high] * n, "mine": [rng.randrange(2) if high else 0 for _ in range(n)], "h": list(range(n)), "id": [f"i{k}" for k in range(n)], "field": ["f"] * n, "t": [0.3] * n,
                      "syllables": [["a"]] * n, "parts": ['[["a"]]'] * n, "latin": [True] * n, "grams": grams, "weights": pa.array([[0.4] * 6] * n, pa.list_(pa.float32()))})
        side = t["mine"].to_pylist()
        want = {(a, b) for a in range(n) for b in range(a + 1, n) if len(set(grams[a]) & set(grams[b])) >= 2 and (not high or side[a] != side[b])}
        for most in (1, 50, 2_000_000):
            x = meeting(t, {}, most)
            assert set(zip(x["h_a"].to_pylist(), x["h_b"].to_pylist())) == want and len(x) == len(want) > 0
