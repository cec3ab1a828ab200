"""Queries of problem 7: splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strophe.functions.text import present
from strophe.llm.groups import assign_splits, record_groups
from strophe.session import cut

#: The series channel: so many unrelated recordings that it ties nothing.
SERIES = "vidhub:UChundredvalleys00"


def channel(c: str = "channel_key") -> Column:
    """The channel key, or null where it names no channel (missing, or built from a missing channel id) or the series."""
    ident = present(F.trim(F.regexp_replace(F.col(c), "^[^:]*:", "")))
    # spellings of a missing id behind the platform, and a bare platform
    names_one = F.col(c).contains(":") & ~F.lower(ident).isin("null", "none", "nan", "na", "undefined", "unknown") & (F.col(c) != SERIES)
    return F.when(F.coalesce(names_one, F.lit(False)), F.col(c))


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rec = spark.read.parquet(f"{d}/recordings.parquet").select("item_id", "channel_key", "singer_id", "region")
    return rec, record_groups(rec, "item_id", {"channel": channel(), "singer": present("singer_id")})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Recordings of groups of at least two, with the smallest item_id of the group."""
    return _groups(spark, d)[1].where("size > 1").select("item_id", "group_id")


def p7_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every recording with its group and split (80/10/10, also within each region as far as whole groups allow)."""
    rec, groups = _groups(spark, d)
    region = rec.groupBy("item_id").agg(F.min("region").alias("region"))
    both = cut(region.join(groups, "item_id"))
    s = assign_splits(both, "group_id", "region", {"train": 0.8, "validation": 0.1, "test": 0.1})
    return both.join(s, "group_id").select("item_id", "region", "group_id", "split")


def p7_balance(spark: SparkSession, d: str) -> DataFrame:
    """Per region and split the recordings and their share of the region: how near whole groups come to 80/10/10."""
    s = p7_splits(spark, d).groupBy("region", "split").agg(F.count("*").alias("recordings"))
    total = s.groupBy(F.col("region").alias("r")).agg(F.sum("recordings").alias("total"))
    return s.join(total, F.col("region").eqNullSafe(F.col("r"))).select("region", "split", "recordings", (F.col("recordings") / F.col("total")).alias("share"))


_GROUPS = """r AS (SELECT DISTINCT item_id,
        CASE WHEN channel_key LIKE '%:%' AND lower(trim(regexp_replace(channel_key, '^[^:]*:', ''))) NOT IN ('', 'na', 'nan', 'none', 'null', 'undefined', 'unknown')
              AND channel_key <> 'vidhub:UChundredvalleys00' THEN 'c' || channel_key END AS c,
        CASE WHEN singer_id NOT IN ('', 'NA', 'nan', 'None') THEN 's' || singer_id END AS s FROM recordings WHERE item_id IS NOT NULL),
    e AS (SELECT DISTINCT c AS a, s AS b FROM r WHERE c IS NOT NULL AND s IS NOT NULL),
    both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    nodes AS (SELECT c AS n FROM r WHERE c IS NOT NULL UNION SELECT s FROM r WHERE s IS NOT NULL),
    reach(n, m) AS (SELECT n, n FROM nodes UNION SELECT reach.n, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.m),
    root AS (SELECT n, min(m) AS root FROM reach GROUP BY n),
    g AS (SELECT r.item_id, coalesce(root.root, 'i' || r.item_id) AS root FROM r LEFT JOIN root ON root.n = coalesce(r.c, r.s)),
    grouped AS (SELECT item_id, min(item_id) OVER (PARTITION BY root) AS group_id, count(*) OVER (PARTITION BY root) AS size FROM g)"""

_SPLITS = _GROUPS + """,
    placed AS (SELECT item_id, min(region) AS region FROM recordings WHERE item_id IS NOT NULL GROUP BY item_id),
    x AS (SELECT placed.item_id, region, group_id FROM placed JOIN grouped USING (item_id)),
    per AS (SELECT group_id, region, count(*) AS n FROM x GROUP BY ALL),
    main AS (SELECT group_id, sum(n) OVER (PARTITION BY group_id) AS n, region AS stratum, ('0x' || substr(md5(group_id), 1, 8))::BIGINT % 4096 AS bin
             FROM per QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n DESC, md5(coalesce(region, '')) DESC) = 1),
    b AS (SELECT stratum, bin, sum(n) AS n FROM main GROUP BY ALL),
    ordered AS (SELECT stratum, bin, (sum(n) OVER (PARTITION BY stratum ORDER BY n * -ln((bin + 0.5) / 4096), bin ROWS UNBOUNDED PRECEDING) - n / 2)
                       / sum(n) OVER (PARTITION BY stratum) AS share FROM b),
    s AS (SELECT stratum, bin, CASE WHEN share < 0.1 THEN 'validation' WHEN share < 0.2 THEN 'test' ELSE 'train' END AS split FROM ordered),
    splits AS (SELECT x.item_id, x.region, x.group_id, s.split FROM x JOIN main USING (group_id) JOIN s ON s.stratum IS NOT DISTINCT FROM main.stratum AND s.bin = main.bin)"""

QUERIES = {"p7_found": p7_found, "p7_splits": p7_splits, "p7_balance": p7_balance}
SQL = {
    "p7_found": f"WITH RECURSIVE {_GROUPS} SELECT item_id, group_id FROM grouped WHERE size > 1",
    "p7_splits": f"WITH RECURSIVE {_SPLITS} SELECT * FROM splits",
    "p7_balance": f"""WITH RECURSIVE {_SPLITS} SELECT region, split, count(*) AS recordings, count(*) / sum(count(*)) OVER (PARTITION BY region) AS share
        FROM splits GROUP BY region, split""",
}
