"""Functions of one's own as queries (survey group U)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from strophe.functions import custom as C
from strophe.functions.text import present
from strophe.operators import kernels as K
from strophe.plans.registry import REC, Registry, recordings, table
from strophe.plans.sequences import NOTES_SQL, notes

Q = Registry()


def _digits(text: str) -> int:
    return sum(c in "0123456789" for c in text)


@Q(f"SELECT item_id, CAST(length(regexp_replace(title, '[^0-9]', '', 'g')) AS INTEGER) AS digits FROM {REC}")
def custom_values(spark: SparkSession, d: str) -> DataFrame:
    """A row function: digits of a title (U-02)."""
    return recordings(spark, d, "title").select("item_id", C.row_function(_digits, "int")("title").alias("digits"))


@Q("SELECT o_orderpriority, round(exp(avg(ln(o_totalprice))), 4) AS typical FROM orders WHERE o_totalprice > 0 GROUP BY o_orderpriority")
def custom_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """A group function: the geometric mean, from sums of parts (U-03)."""
    o = table(spark, d, "orders").where("o_totalprice > 0")
    return C.group_function(o, ["o_orderpriority"], "o_totalprice", lambda v: (np.log(v).sum(), len(v)), lambda s: F.round(F.exp(s[0] / s[1]), 4), "typical")


@Q(f"WITH {NOTES_SQL} SELECT item, round(list_reduce(list(value ORDER BY pos), lambda a, b: 0.5 * a + 0.5 * b), 6) AS smoothed FROM n GROUP BY item")
def custom_frames(spark: SparkSession, d: str) -> DataFrame:
    """A function of a whole item in order: exponential smoothing, which is sequential (U-04)."""

    def smooth(g: pd.DataFrame) -> pd.DataFrame:
        s = float(g["value"][0])
        for v in g["value"][1:]:
            s = 0.5 * s + 0.5 * float(v)
        return pd.DataFrame({"item": [g["item"][0]], "smoothed": [s]})

    x = C.group_frames(notes(spark, d).select("item", "pos", "value"), ["item"], ["pos"], smooth, "item long, smoothed double")
    return x.select("item", F.round("smoothed", 6).alias("smoothed"))


def _shingles(text: str) -> list[tuple[int, str]]:
    return [(i, text[i : i + 2]) for i in range(len(text) - 1)]


@Q(f"SELECT item_id, CAST(i AS INTEGER) AS pos, substr(song_key, CAST(i + 1 AS INTEGER), 2) AS shingle FROM (SELECT item_id, song_key, unnest(range(length(song_key) - 1)) AS i FROM {REC} WHERE song_key IS NOT NULL)")
def custom_rows(spark: SparkSession, d: str) -> DataFrame:
    """A function from one value to many rows: pairs of neighbouring characters (U-05)."""
    return C.row_rows(recordings(spark, d, "song_key"), ["item_id"], "song_key", _shingles, "pos int, shingle string")


def title_variants(spark: SparkSession, d: str) -> DataFrame:
    """Every key that a title may be looked up by (F-S18, U-05), places from the gazetteer; tested against the rules one by one."""
    g = table(spark, d, "gazetteer").where("level in ('province', 'prefecture')").select(F.expr("substring(name, 1, length(name) - 1)").alias("p")).distinct()
    places = [r[0] for r in g.limit(5_001).collect()]
    if len(places) > 5_000:
        raise ValueError("more places than a list in every worker should hold")
    held = spark.sparkContext.broadcast(tuple(sorted(places, key=lambda p: (-len(p), p))))
    t = recordings(spark, d, "title").where(present("title").isNotNull()).select("title").distinct()
    return C.row_rows(t, ["title"], "title", lambda x: [(k,) for k in K.variant_keys(x, held.value)], "key string")


QUERIES, SQL = Q.queries, Q.sql
QUERIES |= {"title_variants": title_variants}
