"""Free-entered values to entries of a reference list: token repair by edit distance, then soft TF-IDF.

1. Each distinct value is cut into parts, and each part into tokens, in one or more ways (parents and places run together).
2. Each distinct token meets the reference vocabulary by edit distance: both sides are expanded to their forms with one
   letter (one syllable) left out, joined on equality, and the distance is then computed. No token is compared with
   all entries.
3. The repaired tokens are scored against complete entries (own name and the names of its parents) by soft TF-IDF: the weights
   are inverse entry frequencies, the norm of an entry is taken over the tokens that the value states. A parent that
   is not stated must not count against an entry, or two places of one name would be told apart by the weights of parents
   that nobody wrote. An entry counts if its own name is among the tokens and every token is its own or a parent's name.
4. The best entry wins; equal ones are told apart by the stated parent; what stays open is reported as unmatched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strophe.llm.readings import HAN, Readings, edits
from strophe.session import cut, spread

# Kinds of places in the spellings they are written in, and words beside a place.
KIND_CHARS = "省市州县区旗"
KIND_WORDS = {
    "sheng": "省", "shi": "市", "zhou": "州", "xian": "县", "qu": "区", "qi": "旗",
    "province": "province", "prefecture": "prefecture", "county": "county", "city": "市", "district": "区", "banner": "旗",
}
BEFORE = ("中国", "原", "今", "旧", "约", "大约", "疑似")
AFTER = ("境内", "附近", "一带", "地区", "周边", "等地", "area", "region", "nearby")
ASIDE = ("今", "原", "旧", "?", "疑")


def _strip_words(s: str) -> str:
    while True:
        t = s.strip(" .。,，、;；?？!~～-·:")
        for w in BEFORE:
            if t.startswith(w) and len(t) > len(w) + 1:
                t = t[len(w) :]
        for w in AFTER:
            if t.endswith(w) and len(t) > len(w) + 1:
                t = t[: -len(w)]
        if t == s:
            return t
        s = t


def _runs(segment: str) -> list[str]:
    """A run of ideographs, cut after each written kind."""
    return [m for m in re.findall(rf"[^{KIND_CHARS}]+[{KIND_CHARS}]?|[{KIND_CHARS}]+", segment) if m]


def _size(s: str) -> int:
    """Length of a name as it may be written: an ideograph has up to six letters."""
    return sum(6 if "㐀" <= c <= "鿿" else 1 for c in s)


def _cuts(items: list[str], most: int, least: int, parts: int = 1) -> list[list[str]]:
    """The ways to join consecutive items into 1 to 3 names, each of ``least`` items or more and of at most the size ``most``."""
    out = [["".join(items)]] if _size("".join(items)) <= most else []
    if parts < 3:
        for i in range(least, len(items) - least + 1):
            head = "".join(items[:i])
            if _size(head) > most:
                break
            out += [[head, *rest] for rest in _cuts(items[i:], most, least, parts + 1)]
    return out


def token_ways(value: str, r: Readings, longest: int = 4) -> list[list[list[tuple[str, str]]]]:
    """Per part of the value the ways to cut it into tokens ``(name, kind)``; names are folded, without kind.

    A place has a name and two parents, so a part that is to mean one is at most three names run together. longest: ideographs
    of the longest name of the reference list; misspelt it may have one more. A part longer than three such names has no way, and
    its value no entry. Parts are independent of each other: their number has no bound, and ways are not multiplied out.
    """
    most = 6 * (longest + 1)
    s = r.fold(value)
    s = re.sub(r"[(\[]([^()\[\]]*)[)\]]", lambda m: " " if m[1].strip() in ASIDE else f"|{m[1]}|", s)
    s = re.sub(r"['’]", "", s)
    out: list[list[list[tuple[str, str]]]] = []
    for part in re.split(r"[|,，、;；/·]+", s):
        part = _strip_words(part)
        if not part:
            continue
        words = part.split()
        if any(re.search(f"[{HAN}]", w) for w in words):
            if len(words) > 1 and all(len(w) == 1 for w in words):
                words = ["".join(words)]
            for p in [p for w in words for p in _runs(_strip_words(w))]:
                kind = p[-1] if p[-1] in KIND_CHARS and len(p) > 1 else ""
                name = p[:-1] if kind else p
                cut_names = _cuts(list(name), most, 2) if _size(name) <= 3 * most else []
                out.append([[*((x, "") for x in c[:-1]), (c[-1], kind)] for c in cut_names])
        elif sum(map(len, words)) > 3 * most + max(map(len, KIND_WORDS)):
            out.append([])
        else:
            kind, whole = "", "".join(words)
            if len(words) > 1 and words[-1] in KIND_WORDS:
                kind, words = KIND_WORDS[words[-1]], words[:-1]
            ways = [[*((x, "") for x in c[:-1]), (c[-1], kind)] for c in _cuts(words, most, 1)]
            if kind and "".join(words) != whole and _size(whole) <= most:  # what looks like a kind may be the end of the name
                ways.append([(whole, "")])
            out.append(ways)
    return out


def _left_out(items: list[str]) -> list[str]:
    return ["".join(items)] + ["".join(items[:i] + items[i + 1 :]) for i in range(len(items))]


def token_variants(name: str, r: Readings) -> tuple[str, list[str], bool, list[str]]:
    """Letters, syllables, whether Latin, and the join keys: the reading, and it with one letter or syllable left out."""
    syl, latin = r.to_syllables(name)
    letters = "".join(syl)
    keys = {"=" + letters}
    if len(letters) >= 5:
        keys |= {"l" + x for x in _left_out(list(letters))}
    if len(syl) >= 3:
        keys |= {"s" + x for x in _left_out(syl)}
    return letters, syl, latin, sorted(keys)


def token_similarity(a: str, sa: list[str], a_latin: bool, b: str, sb: list[str], name_a: str, name_b: str) -> float:
    """1 for the same writing or, in Latin letters, the same reading; less for other characters of the same reading and for one
    edit; 0 for more. b is the vocabulary's side, written in ideographs."""
    if a == b:
        return 1.0 if a_latin or name_a == name_b else 0.97
    if a_latin and len(a) >= 5 and edits(a, b, 1) <= 1:
        return 0.9
    if not a_latin and min(len(sa), len(sb)) >= 2 and max(len(sa), len(sb)) >= 3 and edits(sa, sb, 1) <= 1:
        return 0.8
    return 0.0


def repair_tokens(tokens: DataFrame, vocabulary: DataFrame, r: Readings) -> DataFrame:
    """``(token, stem, sim)`` of distinct tokens and the vocabulary entries within one edit of them. Both sides: one string column."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["t"]:
                letters, syl, latin, keys = token_variants(t, r)
                rows += [(t, letters, syl, latin, k) for k in keys]
            yield pd.DataFrame(rows, columns=["t", "letters", "syl", "latin", "k"])

    schema = "t string, letters string, syl array<string>, latin boolean, k string"
    a = spread(tokens.select(F.col("token").alias("t")).distinct()).mapInPandas(expand, schema)
    b = spread(vocabulary.select(F.col("stem").alias("t")).distinct()).mapInPandas(expand, schema)
    met = a.join(b.select(F.col("t").alias("stem"), F.col("letters").alias("letters_b"), F.col("syl").alias("syl_b"), "k"), "k")
    met = met.select("t", "letters", "syl", "latin", "stem", "letters_b", "syl_b").distinct()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for m in batches:
            rows = []
            for t, x, sx, lat, stem, y, sy in zip(*(m[c] for c in ("t", "letters", "syl", "latin", "stem", "letters_b", "syl_b"))):
                s = token_similarity(x, list(sx), lat, y, list(sy), t, stem)
                if s > 0:
                    rows.append((t, stem, s))
            yield pd.DataFrame(rows, columns=["token", "stem", "sim"])

    return met.mapInPandas(judge, "token string, stem string, sim double")


def score_entries(values: DataFrame, entries: DataFrame, r: Readings) -> DataFrame:
    """``(field, value, c)``: the entries a value may mean, as an array of (score, entry, within); values without any give no row.

    values: (field, value), made distinct here. entries: (field, entry, name, kind, level, parents array<string> of names without
    kind, within: id of the parent that a statement may name). An empty list of entries gives no rows.
    """

    longest = entries.select(F.explode(F.array_append("parents", F.col("name"))).alias("stem")).agg(F.max(F.length("stem"))).first()[0] or 0

    def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, v in zip(b["field"], b["value"]):
                parts = token_ways(v, r, longest)
                if all(parts):
                    rows += [(f, v, len(parts), p, w, len(tokens), i, t, k) for p, ws in enumerate(parts) for w, tokens in enumerate(ws) for i, (t, k) in enumerate(tokens)]
            yield pd.DataFrame(rows, columns=["field", "value", "parts", "part", "way", "n", "pos", "token", "kind"]).astype({c: "int32" for c in ("parts", "part", "way", "n", "pos")})

    distinct = values.where("value is not null").select("field", "value").distinct()
    w = cut(spread(distinct).mapInPandas(ways, "field string, value string, parts int, part int, way int, n int, pos int, token string, kind string"))
    own = entries.select("field", "entry", F.col("name").alias("stem"), F.lit(True).alias("own"))
    parents = entries.select("field", "entry", F.explode("parents").alias("stem")).select("field", "entry", "stem", F.lit(False).alias("own"))
    bag = own.unionAll(parents).groupBy("field", "entry", "stem").agg(F.max("own").alias("own"))
    total = entries.groupBy("field").agg(F.count("*").alias("total"))
    idf = bag.groupBy("field", "stem").agg(F.count("*").alias("df")).join(total, "field").select("field", "stem", F.log1p(F.col("total") / F.col("df")).alias("w"))
    bag = cut(bag.join(idf, ["field", "stem"]))
    sims = cut(repair_tokens(w.select("token"), bag.select("stem"), r))

    met = w.join(sims, "token")
    # entries whose own name is among the tokens of a value; only these are scored with their parents
    cand = met.join(bag.where("own").select("field", "stem", "entry"), ["field", "stem"]).select("field", "value", "entry").distinct()
    scored = met.join(cand, ["field", "value"]).join(bag, ["field", "entry", "stem"])
    way = ["field", "value", "parts", "part", "way", "n", "entry"]
    best = scored.groupBy(*way, "pos").agg(F.max(F.struct("sim", "w", "own", "kind")).alias("b"))
    # a written kind that is not that of the entry
    kinds = entries.select("field", "entry", F.col("kind").alias("own_kind"), "level", "within")
    best = best.join(kinds, ["field", "entry"])
    wrong = F.col("b.own") & (F.col("b.kind") != "") & (F.col("b.kind") != F.col("own_kind")) & (F.col("b.kind") != F.col("level"))
    # a way counts where each of its tokens is the entry's name or a parent's
    g = best.groupBy(*way, "within").agg(
        F.count("*").alias("covered"), F.max("b.own").alias("own"), F.sum(F.col("b.sim") * F.pow("b.w", F.lit(2))).alias("met"),
        F.sum(F.pow("b.w", F.lit(2))).alias("all"), F.max(wrong.cast("int")).alias("wrong"),
    ).where("covered = n")
    # each part takes its best way, and the parts together make the score
    worth = F.col("met") / F.col("all") - 0.05 * F.col("wrong") - 0.001 * F.col("n")
    g = g.groupBy("field", "value", "parts", "part", "entry", "within").agg(F.max_by(F.struct("met", "all", "wrong", "n", "own"), F.struct("own", worth)).alias("p"))
    g = g.groupBy("field", "value", "parts", "entry", "within").agg(
        F.count("*").alias("covered"), F.max("p.own").alias("own"), F.sum("p.met").alias("met"), F.sum("p.all").alias("all"),
        F.max("p.wrong").alias("wrong"), F.sum("p.n").alias("n"),
    ).where("own and covered = parts")
    g = g.select("field", "value", "entry", "within", worth.alias("score"))
    return g.groupBy("field", "value").agg(F.collect_list(F.struct("score", "entry", "within")).alias("c"))


def choose_entries(values: DataFrame, scored: DataFrame, near: float = 0.12) -> DataFrame:
    """``(field, value, stated, entry)``: the entry meant, or null where no entry or several are.

    values: (field, value, stated), stated being the id of a parent, or null. Among the entries within ``near`` of the best, those inside
    the stated parent come first; what is then still equal is open.
    """
    got = values.join(scored, ["field", "value"], "left")
    peak = F.array_max(F.transform("c", lambda x: x["score"]))
    best_of: Column = F.filter("c", lambda x: x["score"] >= F.col("peak") - near)
    got = got.withColumn("peak", peak).withColumn("c", best_of)
    got = got.withColumn("inside", F.filter("c", lambda x: x["within"] == F.col("stated")))
    got = got.withColumn("c", F.when(F.size("inside") > 0, F.col("inside")).otherwise(F.col("c")))
    # among what is left: one entry, or one that is clearly ahead
    got = got.withColumn("c", F.filter("c", lambda x: x["score"] >= F.array_max(F.transform(F.col("c"), lambda y: y["score"])) - 0.004))
    return got.select("field", "value", "stated", F.when(F.size("c") == 1, F.element_at("c", 1)["entry"]).alias("entry"))


def match_values(values: DataFrame, entries: DataFrame, r: Readings) -> DataFrame:
    """Scores and chooses in one go. Values that are null, and all values where there are no entries, have no entry."""
    return choose_entries(values, cut(score_entries(values, entries, r)))
