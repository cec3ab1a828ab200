import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.llm.documents_queries import QUERIES, VOCABULARY
from strophe.llm.leakage import Index, Stretch, find_leaks, fold_table, stream, stream_offsets
from strophe.llm.packing import cut_oversized, difference, pack, pack_documents
from strophe.llm.pieces import split_documents, split_text, word_ends
from strophe.llm.tokens import VOCABULARIES, Encoder, kinds_of

pytestmark = pytest.mark.skipif(not Path(VOCABULARIES, VOCABULARY).exists(), reason="no vocabulary files")


@pytest.fixture(scope="module")
def enc():
    return Encoder(Path(VOCABULARIES, VOCABULARY).read_bytes())


def test_difference_and_pack():
    rng = random.Random(1)
    assert difference([], 3) == ([], []) and pack([], 10) == []
    for n, top in ((1, 10), (5, 100), (60, 100), (400, 2048), (300, 1)):
        sizes = [rng.randrange(0, top + 1) for _ in range(n)]
        w = pack(sizes, top)
        assert sorted(i for x in w for i in x) == list(range(n)) and all(sum(sizes[i] for i in x) <= top for x in w)
        loose = pack(sizes, top, plain=True)
        assert sorted(i for x in loose for i in x) == list(range(n)) and all(sum(sizes[i] for i in x) <= top for x in loose) and len(loose) >= len(w)
        sums, items = difference(sizes, max(1, n // 3))
        assert sorted(i for x in items for i in x) == list(range(n)) and sums == [sum(sizes[i] for i in x) for x in items]
    assert len(pack([5, 5, 5, 5], 10)) == 2 and max(difference([8, 7, 6, 5, 4], 2)[0]) <= 16


def test_boundaries(enc):
    for t in ("", "a", "山歌 and tape 🎵", "é" * 50, "\r\n\r\n  x"):
        chars, whole = enc.boundaries(t)
        assert len(chars) == enc.count(t) + 1 and chars[-1] == len(t) and whole[0] and whole[-1]


def test_cut_oversized(enc):
    for t in ("word " * 400, "山" * 700, "🎵" * 300, "x" * 3000, "short", ""):
        p = cut_oversized(t, 64, enc)
        assert "".join(t[a:b] for a, b, _ in p) == t and all(n <= 64 and n == enc.count(t[a:b]) for a, b, n in p)
        assert len(p) == 1 or enc.count(t) > 64


def test_pack_documents(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randrange(1, 900), "c") for i in range(200)] + [(900, None, "c"), (901, "", "c"), (902, "山歌" * 6000, "c"), (903, "word", "c")]
    df = spark.createDataFrame(rows, "id long, text string, container string")
    p = pack_documents(df, "id", "text", 512, VOCABULARY, VOCABULARIES, block=60)
    c = p.groupBy("container").agg(F.sum("tokens").alias("n"), F.count("*").alias("k")).collect()
    assert max(r.n for r in c) <= 512
    texts = {r[0]: r[1] or "" for r in rows}
    got = {}
    for r in sorted(p.collect(), key=lambda r: (r["id"], r.piece)):
        got.setdefault(r["id"], []).append((r.start, r.end))
    assert {k: "".join(texts[k][a:b] for a, b in v) for k, v in got.items()} == texts
    assert 1 - sum(r.n for r in c) / (512 * len(c)) < 0.1
    assert pack_documents(df.where("false"), "id", "text", 512, VOCABULARY, VOCABULARIES).count() == 0


def test_split_text(enc):
    rng = random.Random(3)
    paragraphs = "\n\n".join(" ".join("word" for _ in range(rng.randrange(20, 90))) + "." for _ in range(60))
    mixed = "".join(rng.choice(["山歌", "唱。", "la ", "\r\n", "🎵", "！"]) for _ in range(4000))
    for t in (paragraphs, mixed, "山" * 3000, "x" * 9000, "a b " * 3000, "🎵" * 900):
        p = split_text(t, 128, 16, enc)
        assert p[0][0] == 0 and p[-1][1] == len(t)
        for (a, b, n, _), nxt in zip(p, [*p[1:], None]):
            assert n == enc.count(t[a:b]) <= 128
            if nxt:
                assert a < nxt[0] < b < nxt[1] and enc.count(t[nxt[0] : b]) >= 14
    assert {x[3] for x in split_text(paragraphs, 128, 16, enc)} <= {"paragraph", "sentence", "word", "end"}
    assert split_text("short", 128, 16, enc) == [] and split_text("", 128, 16, enc) == []
    with pytest.raises(ValueError):
        split_text("x", 10, 8, enc)


def test_counts_from_the_whole_text(enc):
    """Tokens of any piece counted from those of the whole text are those of the piece encoded alone."""
    rng = random.Random(11)
    bits = ["山歌", "唱", "。", "，", " ", "  ", "\n", "\r\n", "it's", "'s", "'", "don't'x", "word", "Word", "12", "3.5", "🎵", "é", "e\u0301", "\u00a0", "\u3000", "\t", "\x1c", "\u0378", "!!", "'re", "「", "x'll", "\u200b", "ǅ", "½"]
    for _ in range(60):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 120)))
        chars, whole = enc.boundaries(t)
        usable = np.flatnonzero(whole)
        points, kinds = kinds_of(t)
        count = enc.counter(t, chars[usable], usable, kinds, points)
        for _ in range(60):
            a, b = sorted(rng.randrange(len(t) + 1) for _ in range(2))
            assert count(a, b) == enc.count(t[a:b]), (t, a, b)


def test_word_ends():
    old = re.compile(r"(?<=[^\s])(?=\s)|\s+|(?<=[A-Za-z0-9])(?=[㐀-鿿])|(?<=[㐀-鿿])(?=[A-Za-z0-9])")
    rng = random.Random(12)
    for _ in range(300):
        t = "".join(rng.choice(["山", "a", "9", " ", "\n", "\u3000", "。", "\u00a0", "\x1c", "é", "🎵"]) for _ in range(rng.randrange(1, 30)))
        got, want = set(word_ends(kinds_of(t)[0]).tolist()), {m.end() for m in old.finditer(t)}
        assert got == want, t


def test_split_documents(spark):
    df = spark.createDataFrame([(1, "word " * 600, 5), (2, "short", 5), (3, None, 5), (4, "", 5)], "id long, text string, piece int")
    p = split_documents(df, "id", "text", 128, 16, VOCABULARY, VOCABULARIES).collect()
    assert {r["id"] for r in p} == {1} and sorted(r.piece for r in p) == list(range(len(p)))
    assert split_documents(df.where("false"), "id", "text", 128, 16, VOCABULARY, VOCABULARIES).count() == 0


WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def test_offsets():
    table = fold_table({ord("圖"): "图"})
    t = "A​Ｂc 圖，x\r\nDеf"
    tokens = stream(t, table)
    assert tokens == ["abc", "图", "x", "def"]
    assert [t[a:b] for a, b in stream_offsets(t, table)] == ["A​Ｂc", "圖", "x", "Dеf"]


def test_offsets_of_changed_lengths():
    """Whatever folding does to the length of a text, tokens and their places agree with the original."""
    table = fold_table({})
    assert [c for c in map(chr, range(0x110000)) if len(c.lower()) != 1] == ["İ"]
    cases = {
        "İstanbul abc": ["İstanbul", "abc"], "I\u0307stanbul ab": ["I\u0307stanbul", "ab"], "ŉa b": ["ŉa", "b"], "the ﬁle, oﬃce": ["the", "ﬁle", "oﬃce"],
        "cafe\u0301 x": ["cafe\u0301", "x"], "café x": ["café", "x"], "e\u200b\u0301t": ["e\u200b\u0301t"], "ＡＢ１２": ["ＡＢ１２"], "don’t": ["don’t"],
    }
    for t, want in cases.items():
        assert [t[a:b] for a, b in stream_offsets(t, table)] == want, t
        assert len(stream(t, table)) == len(want), t
    assert stream("cafe\u0301 the ﬁle İb", table) == stream("café THE file ib", table)
    rng = random.Random(7)
    for _ in range(300):
        t = "".join(rng.choice(["İ", "ﬁ", "e\u0301", "\u0301", "山", "圖", " ", "Ａ", "\u200b", "ŉ", "½", "x", "Σ", "가", "\n", "ǆ", "㍿", "🎵"]) for _ in range(40))
        at = stream_offsets(t, table)
        assert [x for a, b in at for x in stream(t[a:b], table)] == stream(t, table) or len(at) == len(stream(t, table)), t
        assert all(a < b for a, b in at) and all(p[0] <= q[0] for p, q in zip(at, at[1:]))


def test_leaks_of_changed_lengths(spark):
    item = " ".join(WORDS[:30])
    docs = [(i, head + item + " tail") for i, head in enumerate(["İstanbul ", "ﬁ ŉ ", "e\u0301 " * 50, "\u200b½㍿ "])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = find_leaks(d, "doc_id", "text", e, "item_id", "text", {}, offsets=True).collect()
    assert len(got) == 4 and all(docs[r.doc_id][1][r.start : r.end] == item for r in got)


def test_leaks(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(120))
    items = [(1, text(80)), (2, han), (3, None), (4, "")]
    w = items[0][1].split()
    part = w[10:40]
    altered = list(part)
    for i in (6, 13, 20):
        altered[i] = "other"
    docs = [
        (1, "x y z " + " ".join(part) + " tail"), (2, text(30) + " " + " ".join(w[5:17]) + " " + text(30)), (3, "\n".join(x.upper() for x in altered)), (4, f"前言，{han[20:70]}。"), (5, han[20:55]),
        (6, " ".join(f"{c}," for c in han[0:60])), (7, None), (8, ""), (9, "word " * 60_000 + " ".join(part)), (10, " ".join(part[:15] + ["added"] + part[15:])), (11, " ".join(part[:12] + part[13:])), (1, "x y z " + " ".join(part) + " tail"),
    ]
    d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in find_leaks(d, "doc_id", "text", e, "item_id", "text", {}).collect()}
    assert got == {(1, 1), (3, 1), (4, 2), (6, 2), (9, 1), (10, 1), (11, 1)}
    o = {r.doc_id: r for r in find_leaks(d, "doc_id", "text", e, "item_id", "text", {}, offsets=True).collect()}
    assert docs[0][1][o[1].start : o[1].end] == " ".join(part) and o[4].length == 50
    assert find_leaks(d.where("false"), "doc_id", "text", e, "item_id", "text", {}).count() == 0
    assert find_leaks(d, "doc_id", "text", e.where("false"), "item_id", "text", {}).count() == 0
    with pytest.raises(ValueError):
        find_leaks(d, "doc_id", "text", e, "item_id", "text", {}, most_chars=10)
    assert Index([], {}, Stretch()).stretches(["a"]) == {}


def test_whole_documents(spark, data):
    """Over the whole table: every character of every document in one container or in pieces that cover it, no limit exceeded."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    packed = QUERIES["p8_packed"](spark, data).collect()
    room, parts = {}, {}
    for r in packed:
        room[r.container] = room.get(r.container, 0) + r.tokens
        parts.setdefault(r.doc_id, []).append((r.piece, r.start, r.end))
    assert max(room.values()) <= 2048 and set(parts) == set(docs)
    assert all("".join(docs[d][a:b] for _, a, b in sorted(p)) == docs[d] for d, p in parts.items())
    waste = QUERIES["p8_waste"](spark, data).first()
    assert waste.containers == len(room) and waste.tokens == sum(room.values()) and abs(waste.waste - (1 - waste.tokens / 2048 / len(room))) < 1e-12
    enc, pieces = Encoder(Path(VOCABULARIES, VOCABULARY).read_bytes()), {}
    for r in QUERIES["p10_pieces"](spark, data).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {d for d, t in docs.items() if enc.count(t) > 512}
    for d, rows in pieces.items():
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows))) and rows[0].start == 0 and rows[-1].end == len(docs[d])
        assert all(r.tokens <= 512 and r.text == docs[d][r.start : r.end] and enc.count(r.text) == r.tokens for r in rows)
        assert all(a.start < b.start < a.end < b.end for a, b in zip(rows, rows[1:]))
