"""Exact nearest neighbours of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def exact_neighbours(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, block: int = 10_000, tile: int = 1_000) -> DataFrame:
    """``(query, neighbour, cosine)``: the k most similar rows of base for every query, not itself; of equal ones the smallest key.

    Queries travel in blocks of at most ``block`` vectors (the bound of what is broadcast); every batch of base keeps its best k
    for each query, so what is shuffled is k rows a query and batch; ``tile`` queries at a time meet a batch. Null and zero vectors have no neighbours.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    total = q.count()
    blocks = max(1, -(-total // block))
    q = q.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)))
    kind = base.schema[key].dataType.simpleString()
    out = None
    for i in range(blocks):
        part = q.where(F.col("b") == i).select("k", "v").toPandas()
        if part.empty:
            continue
        held = base.sparkSession.sparkContext.broadcast((part["k"].to_numpy(), np.stack([np.asarray(v, dtype=np.float64) for v in part["v"]])))

        def best(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            keys, m = held.value
            norm = np.linalg.norm(m, axis=1)
            qn = m[norm > 0] / norm[norm > 0][:, None]
            qk = keys[norm > 0]
            for b in batches:
                v = np.stack([np.asarray(x, dtype=np.float64) for x in b["v"]])
                n = np.linalg.norm(v, axis=1)
                v, bk = v[n > 0] / n[n > 0][:, None], b["k"].to_numpy()[n > 0]
                rows = []
                for at in range(0, len(qn), tile):  # bounds the matrix of similarities that is held at once
                    sim = np.round(qn[at : at + tile] @ v.T, 9)
                    # all that reach the (k + 1)-th value, ties too, are ordered
                    least = np.partition(sim, -(k + 1), axis=1)[:, -(k + 1)] if sim.shape[1] > k + 1 else np.full(len(sim), -2.0)
                    for j in range(len(sim)):
                        near = np.flatnonzero(sim[j] >= least[j])
                        near = near[np.lexsort((bk[near], -sim[j, near]))]
                        rows += [(qk[at + j], bk[x], float(sim[j, x])) for x in near if bk[x] != qk[at + j]][:k]
                yield pd.DataFrame(rows, columns=["query", "neighbour", "cosine"])

        got = base.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(best, f"query {kind}, neighbour {kind}, cosine double")
        out = got if out is None else out.unionAll(got)
    if out is None:
        return base.sparkSession.createDataFrame([], f"query {kind}, neighbour {kind}, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "neighbour")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")
