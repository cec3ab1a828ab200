"""Functions of one's own in Arrow batches: row to value, group to value, group to rows, row to rows. Built-in expressions come first; these are
for what they cannot say."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def row_function(fn: Callable[[Any], Any], returns: str) -> Callable[[Column | str], Column]:
    """A function of one value as a column expression (U-02). It is called once per value that is not null; null stays null."""

    @F.pandas_udf(returns)
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or v != v else fn(v))

    return apply


def group_function(df: DataFrame, keys: Sequence[str], value: str, partial: Callable[[np.ndarray], Sequence[float]], finish: Callable[[Column], Column], name: str) -> DataFrame:
    """``(keys, name)``: an aggregate of one's own (U-03). ``partial`` gives numbers of a part of a group that add up over parts; ``finish`` makes
    the value from the array of their sums. Parts are made batch by batch before the shuffle, so a hot group is never in one place. Null
    values are left out; a group of none gives no row."""
    cols = [f"k{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(c) for k, c in zip(keys, cols)], F.col(value).cast("double").alias("v"))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(*(k if isinstance(k, tuple) else (k,)), [float(x) for x in partial(g["v"].to_numpy())]) for k, g in b.groupby(cols, dropna=False)]
            yield pd.DataFrame(out, columns=[*cols, "s"])

    schema = T.StructType([*[T.StructField(c, df.schema[k].dataType) for k, c in zip(keys, cols)], T.StructField("s", T.ArrayType(T.DoubleType()))])
    p = rows.mapInPandas(parts, schema).select(*cols, F.posexplode("s").alias("i", "x")).groupBy(*cols, "i").agg(F.sum("x").alias("x"))
    s = p.groupBy(*cols).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("s"))
    return s.select(*[F.col(c).alias(k) for k, c in zip(keys, cols)], finish(F.col("s")).alias(name))


def group_frames(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Each group, in order, to rows of its own (U-04). For groups whose size is bounded by what they are, such as one item's notes."""

    def ordered(g: pd.DataFrame) -> pd.DataFrame:
        return fn(g.sort_values(list(order), ignore_index=True))

    return df.groupBy(*keys).applyInPandas(ordered, schema)


def row_rows(df: DataFrame, keys: Sequence[str], value: str, fn: Callable[[Any], Iterable[tuple]], schema: str) -> DataFrame:
    """``(keys, ...)``: every value to any number of rows (U-05). Null values give none."""
    fields = T._parse_datatype_string(schema)
    out = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keys], *fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r[:-1], *made) for r in b.itertuples(index=False, name=None) for made in fn(r[-1])]
            yield pd.DataFrame(rows, columns=out.names, dtype=object)

    return df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v")).mapInPandas(run, out)
