import itertools
import random

import pytest
from pyspark.sql import functions as F

from strophe.llm import names_queries, overlap_queries
from strophe.llm.canonical import match_values, token_similarity, token_ways
from strophe.llm.linking import average_linkage, candidate_pairs, form_vectors, link_spellings, similar_forms
from strophe.llm.naming import Lexicon, Rule, parse_singer as bare_singer, parse_song as bare_song, same_name
from strophe.llm.overlap import meets, merged_length, name_classes, near_keys, scan_block
from strophe.llm.readings import Readings, cut_latin, edits

CHARS = [("雪", "xue", "雪"), ("松", "song", "松"), ("椿", "chun", "椿"), ("素", "su", "素"), ("茹", "ru", "茹"), ("谣", "yao", "谣"), ("調", "diao", "调"), ("调", "diao", "调"), ("学", "xue", "学"), ("學", "xue", "学"), ("海", "hai", "海"), ("来", "lai", "来"),
         ("來", "lai", "来"), ("田", "tian", "田"), ("楠", "nan", "楠"), ("泰", "tai", "泰"), ("号", "hao", "号"), ("甜", "tian", "甜"), ("东", "dong", "东"), ("省", "sheng", "省"), ("县", "xian", "县"), ("市", "shi", "市"), ("莲", "lian", "莲"), ("雷", "lei", "雷"), ("图", "tu", "图"), ("圖", "tu", "图"),
         ("荷", "he", "荷"), ("潘", "pan", "潘"), ("塔", "ta", "塔"), ("区", "qu", "区"), ("禾", "he", "禾")]

parse_singer, parse_song, parse_body = (names_queries.KINDS[f][0] for f in ("singer", "song_name", "channel"))


@pytest.fixture(scope="module")
def readings(spark):
    return Readings.load(spark.createDataFrame([*CHARS, (None, None, None)], "ch string, reading string, simplified string"))


def test_table_is_bounded(spark):
    with pytest.raises(ValueError):
        Readings.load(spark.createDataFrame(CHARS, "ch string, reading string, simplified string"), most=3)


def test_readings(readings):
    assert cut_latin("xuesongchun", readings.syllables) == ["xue", "song", "chun"]
    assert readings.to_syllables(readings.fold("學松Chun"))[0] == ["xue", "song", "chun"]
    assert edits("abc", "acb", 1) == 1 and edits("abc", "xbc", 1, substitute=False) == 2 and edits("", "", 0) == 0


def test_parsers(readings):
    s = lambda v: parse_song(v, readings)
    assert s("学松椿素茹谣其二").label == s("Xue Song Chun Su Ru Yao No.2").label == "2"
    assert s("学松椿素茹谣其二").letters == s("《學松椿素茹謠其二》（清唱）".replace("謠", "谣")).letters == s("xuesongchunsuruyao2").letters
    for nothing in (None, "", "NA", "nan", "未详", "山歌", "海山歌", "untitled#x", "None"):
        assert s(nothing) is None
    p = parse_singer("楠泰·海来田（艺名雪松椿）", readings)
    assert [len(x) for x in p.parts] == [2, 3] and p.aliases == [["xue", "song", "chun"]]
    assert parse_singer("佚名", readings) is None and parse_singer("楠泰·海来田（演唱）", readings).aliases == []
    a, b = parse_body("雪松椿素第二文化馆官方", readings), parse_body("Culture Hall of Xuesongchunsu - Topic", readings)
    assert a.label == "hall|2" and b.label == "hall|" and a.letters == b.letters


def test_empty_lexicon(readings):
    """Without words of the field every word is part of the name."""
    assert bare_song("学松山歌", readings).letters == "xuesong山歌" and bare_song("NA", readings) is None
    assert [len(p) for p in bare_singer("楠泰 海来田", readings, Lexicon()).parts] == [2, 3]


def test_same_name():
    song, person = Rule(syllable_edits=2), Rule(short_first=True)
    base = [["xue", "song", "chun", "su", "ru", "hai"]]
    assert same_name(base, False, [["xue", "chun", "song", "su", "ru", "hai"]], False, song) > 0
    assert same_name(base, False, [["su", "ru", "hai", "xue", "song", "chun"]], False, song) == 1
    assert same_name(base, False, [["xue", "song", "chun", "su", "tu", "lai"]], False, song) == 0
    assert same_name([["nan", "tai"], ["hai", "lai", "tian"]], False, [["lian", "lei"], ["hai", "lai", "tian"]], False, person) == 0


def test_average_linkage():
    assert average_linkage(4, [(0, 1, 0.9), (2, 3, 0.8), (1, 2, 0.5)], 0.4) == [0, 0, 2, 2]
    assert average_linkage(1, [], 0.5) == [0]
    rng = random.Random(3)
    for _ in range(20):
        n = 7
        sim = {(i, j): round(rng.random(), 3) for i in range(n) for j in range(i + 1, n)}
        clusters = [[i] for i in range(n)]
        mean = lambda a, b: sum(sim[min(i, j), max(i, j)] for i in a for j in b) / (len(a) * len(b))
        while len(clusters) > 1:
            a, b = max(itertools.combinations(clusters, 2), key=lambda p: mean(*p))
            if mean(a, b) < 0.5:
                break
            clusters = [c for c in clusters if c is not a and c is not b] + [a + b]
        got = average_linkage(n, [(i, j, s) for (i, j), s in sim.items()], 0.5)
        assert {frozenset(c) for c in clusters} == {frozenset(i for i in range(n) if got[i] == x) for x in set(got)}


def test_candidates_lose_nothing(spark):
    rng = random.Random(5)
    names = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))] for _ in range(150)]
    forms = [(f"i{k}", "f", "", x, ["".join(x)], "[]", False) for k, x in enumerate(names)]
    v = form_vectors(spark.createDataFrame(forms, "id string, field string, label string, syllables array<string>, words array<string>, parts string, latin boolean"), {"f": (None, Rule(letters=3, cosine=0.4))})
    vec = {r.id: {x.gram: x.w for x in r.vec} for r in v.collect()}
    h = {r.h: r.id for r in v.select("id", F.xxhash64("id").alias("h")).collect()}
    pairs = candidate_pairs(v).collect()
    assert {tuple(r) for r in candidate_pairs(v, hot=3).collect()} == {tuple(r) for r in pairs}
    got = {tuple(sorted((h[r.h_a], h[r.h_b]))) for r in pairs}
    want = {(a, b) for a in vec for b in vec if a < b and sum(w * vec[b].get(g, 0) for g, w in vec[a].items()) >= 0.4}
    assert want and want <= got and len(pairs) == len(got)
    sims = {(tuple(sorted((r.id_a, r.id_b)))) for r in similar_forms(v.drop("vec", "t").withColumn("parts", F.lit('[["x"]]')), {"f": (None, Rule(letters=3, cosine=0.4))}).collect()}
    assert sims == want


def test_linking(spark, readings):
    groups = [
        ["学松椿素茹海谣", "學松椿素茹海谣", "学松椿素海谣", "Xue Song Chun Su Ru Hai", "学松素椿茹海谣", "xuesongchunsuruhai yao"],
        ["学松椿素茹海谣其一", "学松椿素茹海其一"],
        ["田楠泰·荷潘塔", "荷潘塔·田楠泰"],
    ]
    alone = ["山歌", "NA", "", "未详", "雷图莲市东县", "x" * 20_000]
    rows = [("song_name", v, "e") for g in groups for v in g for _ in range(2)] + [("song_name", v, "e") for v in alone] + [("song_name", None, "e")]
    out = link_spellings(spark.createDataFrame(rows, "field string, value string, entity string"), names_queries.KINDS, readings)
    by = {}
    for r in out.collect():
        by.setdefault(r.entity, set()).add(r.value)
    assert sorted(map(sorted, (v for v in by.values() if len(v) > 1))) == sorted(map(sorted, groups))
    assert not {"山歌", "NA", "", "未详"} & set().union(*by.values())
    empty = spark.createDataFrame([], "field string, value string")
    assert link_spellings(empty, names_queries.KINDS, readings).count() == 0


def test_singers(spark, readings):
    rows = ["楠泰·海来田", "海来田·楠泰", "楠·海来田", "N. Hailaitian", "Nantai Hialaitian", "楠泰·海来田（艺名雪松椿）", "雪松椿", "莲雷·海来田", "莲雷·海来田（领唱）"]
    out = link_spellings(spark.createDataFrame([("singer", v) for v in rows], "field string, value string"), names_queries.KINDS, readings)
    e = {r.value: r.entity for r in out.collect()}
    assert len({e[v] for v in rows[:7]}) == 1 and e[rows[7]] == e[rows[8]] != e[rows[0]]
    # a short form that fits two people stays alone
    two = ["楠泰·海来田", "楠东·海来田", "楠·海来田"]
    e = {r.value: r.entity for r in link_spellings(spark.createDataFrame([("singer", v) for v in two], "field string, value string"), names_queries.KINDS, readings).collect()}
    assert len(set(e.values())) == 3


def test_overlap(spark, readings):
    rule = overlap_queries.KEY["song_key"][1]
    assert merged_length([(0, 5), (3, 8), (10, 12)]) == 10 and merged_length([]) == 0
    keys = [("学松椿素茹海", True, True), ("学松素椿茹海", False, True), ("xuesongchunsuruhai", True, False), ("莲雷图荷潘塔", True, False), ("学松椿素茹海其二", True, False)]
    rows = []
    import json

    for k, train, ev in keys:
        f = parse_song(k, readings)
        rows.append((k, train, ev, f.label + "\x1f" + f.letters, f.letters, f.label, json.dumps(f.parts, ensure_ascii=False), f.latin))
    df = spark.createDataFrame(rows, "key string, train boolean, eval boolean, id string, letters string, label string, parts string, latin boolean")
    got = {tuple(r) for r in meets(name_classes(df, rule)).collect()}
    both = {"学松椿素茹海", "xuesongchunsuruhai"}
    assert got == {(e, t) for e in ("学松椿素茹海", "学松素椿茹海") for t in both}
    assert meets(name_classes(df.where("false"), rule)).count() == 0
    # neither shards nor blocks change what is found
    sides = df.where("eval").dropDuplicates(["id"]), df.dropDuplicates(["id"])
    want = {tuple(r) for r in near_keys(*sides, rule).collect()}
    assert {tuple(r) for r in near_keys(*sides, rule, shard=1, block=2).collect()} == want and len(want) == 4
    assert scan_block(df.toPandas().head(0), df.toPandas(), rule, 5, 0.2) == []


def test_token_ways(readings):
    w = lambda v: token_ways(v, readings)
    assert [("莲雷", "省")] in w("中国莲雷省，")[0] and [("莲雷", "省")] in w(" 莲 雷  省")[0] and [("莲雷", "")] in w("莲雷一带")[0]
    assert [("甜东", ""), ("荷潘", "")] in w("甜东荷潘")[0]
    assert [("甜东", "市")] in w("甜东市荷潘")[0] and [("荷潘", "")] in w("甜东市荷潘")[1]
    assert [("lianlei", "province")] in w("Lian Lei Province")[0] and [("lianlei", "")] in w("Lianlei（莲雷）")[0] and [("莲雷", "")] in w("Lianlei（莲雷）")[1]
    assert [("lianlei", ""), ("tiandong", ""), ("hepan", "县")] in w("Lian Lei Tian Dong He Pan xian")[0]
    assert [("莲雷", ""), ("甜东", ""), ("荷潘", "县")] in w("莲雷甜东荷潘县")[0]
    assert w("") == [] and w("？！") == []
    # neither the number of parts nor the length of a value bounds the ways of a part
    many = w("，".join(["甜东荷潘"] * 50))
    assert len(many) == 50 and all([("甜东", ""), ("荷潘", "")] in x for x in many)
    assert w("莲" * 5000) == [[]] and w("x" * 5000) == [[]] and w(" ".join(["la"] * 5000)) == [[]]
    assert token_similarity("lianlei", ["lian", "lei"], True, "lianlei", ["lian", "lei"], "lianlei", "莲雷") == 1
    assert token_similarity("a", ["a"], False, "b", ["b"], "甲", "乙") == 0


def test_mapping(spark, readings):
    e = [("province", "91", "莲雷", "省", "province", [], None), ("province", "92", "图荷", "省", "province", [], None), ("c", "9101", "甜东", "市", "prefecture", ["莲雷"], "91"), ("c", "910101", "荷潘", "县", "county", ["莲雷", "甜东"], "91"), ("c", "920101", "禾潘", "区", "county", ["图荷", "海来"], "92"), ("c", "920102", "塔田", "县", "county", ["图荷", "海来"], "92"), ("c", "910102", "塔田", "县", "county", ["莲雷", "甜东"], "91")]
    entries = spark.createDataFrame(e, "field string, entry string, name string, kind string, level string, parents array<string>, within string")
    cases = [("province", "蓮雷省".replace("蓮", "莲") + "​", None, "91"), ("province", "Lianlie", None, "91"), ("province", "莲雷、图荷", None, None), ("province", "海外", None, None), ("province", "涟雷".replace("涟", "莲"), None, "91"),
             ("c", "甜东 荷潘", None, "910101"), ("c", "莲雷省甜东市", None, "9101"), ("c", "甜东荷潘", None, "910101"), ("c", "莲雷甜东荷潘", None, "910101"), ("c", "Lian Lei Tian Dong He Pan", None, "910101"), ("c", "，".join(["莲雷", "甜东"] * 6 + ["荷潘"]), None, "910101"), ("c", "，".join(["莲雷甜东荷潘县"] * 9), None, "910101"), ("c", "塔田县", "91", "910102"), ("c", "塔田县", "92", "920102"), ("c", "塔田县", None, None), ("c", "Hepan", "92", "920101"), ("c", "Hepan", None, None), ("c", "禾潘", "91", "910101"), ("c", "x" * 5000, None, None), ("c", " ", None, None)]
    df = spark.createDataFrame([c[:3] for c in cases], "field string, value string, stated string")
    got = {(r.field, r.value, r.stated): r.entry for r in match_values(df, entries, readings).collect()}
    want = {c[:3]: c[3] for c in cases}
    # homophones: the stated parent decides between 荷潘 and 禾潘
    assert got == want
    assert match_values(df.where("false"), entries, readings).count() == 0
    assert match_values(df, entries.where("false"), readings).where(F.col("entry").isNotNull()).count() == 0
