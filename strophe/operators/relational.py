"""Relational building blocks: conforming, lookups, keyed deduplication, caps, pivots, registries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from strophe.operators.ordered import number_rows
from strophe.operators.skew import join_split


def conform(df: DataFrame, schema: T.StructType, extras: bool = False) -> DataFrame:
    """Columns of the schema in its order: absent ones as null, present ones cast; other columns dropped or kept last."""
    have = set(df.columns)
    cols = [(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    named = {f.name for f in schema}
    return df.select(*cols, *[F.col(f"`{c}`") for c in df.columns if extras and c not in named])


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name of any number of sources; columns that a source lacks are null."""
    if not frames:
        raise ValueError("no source given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a value in Spark; every source turns it into null."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the order, which must be total. Null keys are a key of their own.
    Aggregates instead of ranking, so hot keys are combined before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__row"))
    return best.select("__row.*")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the last in the order, which must be total."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("__row"))
    return best.select("__row.*")


def lookup(df: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Left join to a right side reduced to its last row per key; unmatched and null keys get nulls. Keeps the number of rows."""
    one = keep_last(right.select(*on, *columns, *[c.alias(f"__o{i}") for i, c in enumerate(order)]), on, [F.col(f"__o{i}") for i in range(len(order))])
    return df.join(one.select(*on, *columns), list(on), "left")


def cap_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """At most k rows of each group, in the order (Spark plans a group limit before the shuffle)."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__n", n).where(F.col("__n") <= k).drop("__n")


def first_match(rules: Sequence[tuple[str, Column]], default: str | None = None) -> Column:
    """Ordered classification: the label of the first rule that holds; null conditions do not hold."""
    out = F.lit(default).cast("string")
    for label, cond in reversed(list(rules)):
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


def last_match(rules: Sequence[tuple[str, Column]], default: str) -> Column:
    """Ordered overwriting: the label of the last rule that holds."""
    return first_match(list(reversed(list(rules))), default)


def reasons(rules: Sequence[tuple[str, Column]], sep: str = ";") -> Column:
    """All labels that hold, joined in the order of the rules; null where none does."""
    return F.nullif(F.concat_ws(sep, *[F.when(c, F.lit(label)) for label, c in rules]), F.lit(""))


def pivot_counts(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], fill: int = 0) -> DataFrame:
    """Counts by row keys, one column per value. The values are given, so no extra pass finds them."""
    return df.groupBy(*rows).pivot(column, list(values)).count().fillna(fill, subset=list(values))


def reindex(df: DataFrame, domain: DataFrame, keys: Sequence[str], fill: Mapping[str, int]) -> DataFrame:
    """All keys of the domain; groups without rows appear with the fill values."""
    return domain.select(*keys).distinct().join(df, list(keys), "left").fillna(dict(fill))


def override(df: DataFrame, overrides: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Applies long-form overrides (key, field, value): pivoted to one row per key, then coalesced column by column."""
    wide = overrides.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"__{f}") for f in fields])
    out = df.join(wide, key, "left")
    cols = [F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns]
    return out.select(*cols)


def upsert_registry(registry: DataFrame, new: DataFrame, keys: Sequence[str], ident: str, order: Sequence[Column]) -> DataFrame:
    """Existing keys keep their number; new ones get max+1 and on, in the order. Keys only (not rows) are numbered."""
    fresh = new.select(*keys).distinct().join(registry, list(keys), "left_anti")
    top = registry.agg(F.coalesce(F.max(ident), F.lit(0)).alias("__top"))
    numbered = number_rows(fresh, order, "__k").crossJoin(F.broadcast(top)).withColumn(ident, (F.col("__k") + F.col("__top")).cast("long"))
    return registry.select(*keys, ident).unionByName(numbered.select(*keys, ident))


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows without a key that was just written, and all new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def pairs_within(df: DataFrame, group: Sequence[str], ident: str, columns: Sequence[str] = ()) -> DataFrame:
    """Pairs ident_a < ident_b of one group: the result has a row per pair. A group of very many rows is dealt over several tasks."""
    a = df.select(*group, *[F.col(c).alias(f"{c}_a") for c in (ident, *columns)])
    b = df.select(*group, *[F.col(c).alias(f"{c}_b") for c in (ident, *columns)])
    return join_split(a, b, list(group)).where(F.col(f"{ident}_a") < F.col(f"{ident}_b"))


def overlap_join(a: DataFrame, b: DataFrame, on: Sequence[str], width: float, a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Rows of equal keys whose half-open intervals overlap, by buckets of the given width: each side is exploded to the
    buckets it touches, and a pair is kept only in the first bucket that both touch. Columns of b get the suffix _b."""
    s, e = a_span
    touched = lambda x, y: F.sequence(F.floor(F.col(x) / width), F.floor(F.col(y) / width))
    left = a.withColumn("__bucket", F.explode(touched(s, e)))
    right = b.select(*on, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in on])
    s2, e2 = (f"{c}_b" for c in b_span)
    right = right.withColumn("__bucket", F.explode(touched(s2, e2)))
    got = left.join(right, [*on, "__bucket"]).where((F.col(s) < F.col(e2)) & (F.col(s2) < F.col(e)))
    return got.where(F.col("__bucket") == F.floor(F.greatest(s, s2) / width)).drop("__bucket")


def nearest_join(a: DataFrame, b: DataFrame, on: Sequence[str], at: str, value: str) -> DataFrame:
    """Adds to each row of a the nearest ``value`` of b (same keys) on the axis ``at``; of two equally near the earlier. One sort of the
    union carries the last value before and the first after; no pair of rows is ever formed."""
    left = a.withColumns({"__at": F.col(at).cast("double"), "__b": F.lit(None).cast("double"), "__side": F.lit(1)})
    right = b.select(*on, F.col(value).cast("double").alias("__b")).withColumns({"__at": F.col("__b"), "__side": F.lit(0)})
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*on)
    before = F.last("__b", True).over(w.orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__b", True).over(w.orderBy("__at", F.desc("__side")).rowsBetween(0, Window.unboundedFollowing))
    got = both.withColumns({"__before": before, "__after": after}).where("__side = 1")
    near = F.when(F.col("__after").isNull() | (F.col("__at") - F.col("__before") <= F.col("__after") - F.col("__at")), F.col("__before")).otherwise(F.col("__after"))
    return got.withColumn("nearest", near).drop("__at", "__b", "__side", "__before", "__after")


def ngram_blocks(c: Column, n: int = 2) -> Column:
    """The distinct character n-grams of a text, the blocking keys of theta joins on texts; a shorter text is its own block."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array(c))


def contained_pairs(short: DataFrame, long: DataFrame, ident: tuple[str, str], text: tuple[str, str], least: int = 3, share: float = 0.5) -> DataFrame:
    """``(ident_short, ident_long)``: the shorter text occurs in the longer and has at least ``share`` of its length. Blocked by the
    first n-gram of the short text against all n-grams of the long one, so no nested loop is planned."""
    (i, j), (x, y) = ident, text
    s = short.where(F.length(x) >= least).select(F.col(i).alias("__i"), F.col(x).alias("__x"), F.substring(x, 1, least).alias("__g"))
    t = long.where(F.length(y) >= least).select(F.col(j).alias("__j"), F.col(y).alias("__y"), F.explode(ngram_blocks(F.col(y), least)).alias("__g"))
    hit = s.join(t, "__g").where(F.col("__y").contains(F.col("__x")) & (F.length("__x") >= share * F.length("__y")))
    return hit.select(F.col("__i").alias(i), F.col("__j").alias(j)).distinct()
