"""Same or near-same short keys across splits: Aho-Corasick automata over shards of the evaluation side.

Each evaluation key is normalised to its reading and cut into overlapping passages. Shards of keys become
automata; every training key is scanned by every shard in bounded blocks, so neither an automaton nor a block
grows with the data. Matched intervals of one evaluation key are merged into its coverage; pairs with enough
coverage are checked by the name rule. Equal keys take the same way: a key's own passages cover it whole.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strophe.operators.components import connected
from strophe.operators.skew import join_split
from strophe.llm.naming import Rule, same_name
from strophe.session import cut, parallelism


def passages(letters: str, width: int) -> list[tuple[str, int]]:
    """Overlapping windows of a key with their offsets; a shorter key is one passage."""
    if len(letters) <= width:
        return [(letters, 0)]
    return [(letters[i : i + width], i) for i in range(len(letters) - width + 1)]


def merged_length(spans: list[tuple[int, int]]) -> int:
    """Length of the union of intervals."""
    total, end = 0, -1
    for a, b in sorted(spans):
        if b > end:
            total += b - max(a, end)
            end = b
    return total


def scan_block(evals: pd.DataFrame, texts: pd.DataFrame, rule: Rule, width: int, coverage: float) -> list[tuple[str, str, float]]:
    """Pairs (evaluation id, text id, coverage) of one shard and one block that the rule accepts."""
    if not len(evals) or not len(texts):
        return []
    where: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i, letters in enumerate(evals["letters"]):
        for p, at in passages(letters, width):
            where[p].append((i, at))
    machine = ahocorasick.Automaton()
    for p, hits in where.items():
        machine.add_word(p, (len(p), hits))
    machine.make_automaton()
    e_parts = [json.loads(x) for x in evals["parts"]]
    e_latin, e_len, e_label, e_id = list(evals["latin"]), [len(x) for x in evals["letters"]], list(evals["label"]), list(evals["id"])
    out = []
    for tid, letters, label, parts, latin in zip(texts["id"], texts["letters"], texts["label"], texts["parts"], texts["latin"]):
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for _, (size, hits) in machine.iter(letters):
            for i, at in hits:
                if e_label[i] == label:
                    spans[i].append((at, at + size))
        t_parts = None
        for i, s in spans.items():
            share = merged_length(s) / e_len[i]
            if e_id[i] == tid:
                out.append((tid, tid, 1.0))
            elif share >= coverage:
                t_parts = t_parts or json.loads(parts)
                if same_name(e_parts[i], e_latin[i], t_parts, latin, rule) > 0:
                    out.append((e_id[i], tid, share))
    return out


def near_keys(evals: DataFrame, texts: DataFrame, rule: Rule, width: int = 5, coverage: float = 0.25, shard: int = 20_000, block: int = 50_000) -> DataFrame:
    """``(eval_id, id, coverage)`` of the evaluation keys that a text carries as the same name. Both sides: (id, letters, label, parts,
    latin), one row per form. A form on both sides meets itself, with coverage 1.

    A task holds the automaton of one shard of evaluation keys and scans one block of texts with it. shard, block: the most keys of
    an automaton and texts of a task; texts are cut into more blocks where that leaves cores idle. A text is read once
    per shard, so the work is (texts x shards), as the method has it; up to ``shard`` evaluation keys there is one shard and nothing is copied.
    """
    spark = texts.sparkSession
    shards = max(1, -(-evals.count() // shard))
    n = texts.count()
    blocks = max(1, -(-n // block), min(-(-n // 500), -(-2 * parallelism(spark) // shards)))
    cols = ["id", "letters", "label", "parts", "latin"]
    e = evals.select(*cols, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    t = texts.select(*cols, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def scan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(scan_block(a, b, rule, width, coverage), columns=["eval_id", "id", "coverage"])

    # a number of partitions of our own: a scan is far more work than its few bytes suggest
    parts = max(1, min(shards * blocks, 16 * parallelism(spark)))
    e, t = e.repartition(parts, "shard", "block"), t.repartition(parts, "shard", "block")
    return e.groupBy("shard", "block").cogroup(t.groupBy("shard", "block")).applyInPandas(scan, "eval_id string, id string, coverage double")


def name_classes(keys: DataFrame, rule: Rule, width: int = 5, coverage: float = 0.25) -> DataFrame:
    """``(key, train, eval, name)``: each key with the class of its name, the membership form of the result.

    keys: distinct (key, train boolean, eval boolean, id, letters, label, parts, latin). Keys with one reading are one
    form. Every class comes from matches of the automata, of equal forms too; matches carry on through further forms of either
    side. Keys that no evaluation key meets give no row. An empty table gives no rows.
    """
    forms = cut(keys.groupBy("id", "letters", "label").agg(F.max_by("parts", F.struct(F.length("parts"), "parts")).alias("parts"), F.max("latin").alias("latin"), F.max("eval").alias("eval")))
    links = cut(near_keys(forms.where("eval"), forms, rule, width, coverage))
    comp = connected(links, "eval_id", "id").select(F.col("node").alias("id"), "root")
    met = links.select(F.explode(F.array("eval_id", "id")).alias("id")).distinct().join(comp, "id", "left").select("id", F.coalesce("root", "id").alias("name"))
    return keys.join(met, "id").select("key", "train", "eval", "name")


def meets(classes: DataFrame) -> DataFrame:
    """``(key, train_key)`` of every evaluation key and every training key of one class; a class of very many keys is dealt over tasks."""
    e, t = classes.where("eval").select("key", "name"), classes.where("train").select("name", F.col("key").alias("train_key"))
    return join_split(t, e, ["name"]).select("key", "train_key")
