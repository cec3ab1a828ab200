"""Filling containers of fixed capacity: Karmarkar-Karp multiway differencing in bounded blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strophe.llm.tokens import Encoder, encoder, vocabulary
from strophe.session import cut, even, parallelism

Partition = tuple[list[int], list[list[int]]]  # sums of the windows in use, largest first, and the items of each


def _merge(a: Partition, b: Partition, k: int) -> Partition:
    """The largest windows of one partial partition meet the smallest (the empty ones first) of the other."""
    sa, ia = a
    sb, ib = b
    over = len(sa) + len(sb) - k  # windows that are in use in both
    if over <= 0:
        windows = list(zip(sa, ia)) + list(zip(sb, ib))
    else:
        keep_a, keep_b = len(sa) - over, len(sb) - over
        windows = list(zip(sa[:keep_a], ia[:keep_a])) + list(zip(sb[:keep_b], ib[:keep_b]))
        # the rest of a, largest first, meets the rest of b, smallest first
        for x in range(over):
            windows.append((sa[keep_a + x] + sb[len(sb) - 1 - x], ia[keep_a + x] + ib[len(sb) - 1 - x]))
    windows.sort(key=lambda w: -w[0])
    return [w[0] for w in windows], [w[1] for w in windows]


def difference(sizes: list[int], k: int) -> Partition:
    """k-way differencing: the two partial partitions of largest imbalance are merged until one is left."""
    heap = [(-s, n, ([s], [[n]])) for n, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        sums, items = _merge(a, b, k)
        low = 0
        if len(sums) == k:
            low = sums[-1]
        heapq.heappush(heap, (-(sums[0] - low), n, (sums, items)))
        n += 1
    return heap[0][2] if heap else ([], [])


def pack(sizes: list[int], capacity: int, slacks: tuple[float, ...] = (0.002, 0.005, 0.01, 0.02, 0.04, 0.08), least: float = 0.1, plain: bool = False) -> list[list[int]]:
    """Windows of items, none above the capacity. Every size must be at most the capacity; sizes of 0 are packed too.

    As few windows as the total allows are differenced first. Windows that exceed the capacity mean another round:
    the fullest that fit are done (at the smallest slack that holds for a share ``least`` of all, or at the widest for any), the
    items of the others are differenced again, over one window more whenever a round completes none. plain: all items are
    differenced again over one window more until nothing exceeds the capacity; this leaves more room unused.
    """
    rest, out, extra = list(range(len(sizes))), [], 0
    while rest:
        k = max(1, -(-sum(sizes[i] for i in rest) // capacity) + extra)
        sums, windows = difference([sizes[i] for i in rest], k)
        windows = [[rest[i] for i in w] for w in windows]
        if sums[0] <= capacity:
            return out + windows
        for slack in slacks:
            done = [capacity * (1 - slack) <= s <= capacity for s in sums]
            if sum(done) >= least * k:
                break
        if any(done) and not plain:
            out += [w for w, d in zip(windows, done) if d]
            rest = [i for w, d in zip(windows, done) if not d for i in w]
        else:
            extra += 1
    return out


def cut_oversized(text: str, capacity: int, enc: Encoder) -> list[tuple[int, int, int]]:
    """``(start, end, tokens)`` in characters: the whole text where it fits, else runs of at most capacity tokens, each counted
    as it would be encoded alone."""
    ids = enc.encode(text)
    if len(ids) <= capacity:
        return [(0, len(text), len(ids))]
    chars, whole = enc.boundaries(text, ids)
    out, a, last = [], 0, len(chars) - 1
    while a < last:
        b = min(a + capacity, last)
        while True:
            while b > a + 1 and not whole[b]:
                b -= 1
            if not whole[b]:  # one character of more tokens than fit does not occur: a character has at most 4
                b = next(x for x in range(a + 1, last + 1) if whole[x])
            n = enc.count(text[chars[a] : chars[b]])
            if n <= capacity or b <= a + 4:
                break
            b -= max(1, n - capacity)
        out.append((int(chars[a]), int(chars[b]), n))
        a = b
    return out


def token_items(docs: DataFrame, doc: str, text: str, capacity: int, vocabulary_name: str, folder: str) -> DataFrame:
    """``(doc, piece, start, end, tokens)``: every document as one item, or as several where it alone exceeds the capacity.
    A null or empty text is an item of 0 tokens."""
    data = vocabulary(docs.sparkSession, vocabulary_name, folder)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary_name, data.value)
        for b in batches:
            rows = [(d, i, *p) for d, t in zip(b["doc"], b["text"]) for i, p in enumerate(cut_oversized(t or "", capacity, enc))]
            yield pd.DataFrame(rows, columns=["doc", "piece", "start", "end", "tokens"]).astype({c: "int32" for c in ("piece", "start", "end", "tokens")})

    kind = docs.schema[doc].dataType.simpleString()
    return even(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))).mapInPandas(count, f"doc {kind}, piece int, start int, end int, tokens int")


def pack_documents(docs: DataFrame, doc: str, text: str, capacity: int, vocabulary_name: str, folder: str, block: int = 2000) -> DataFrame:
    """``(container, doc, piece, start, end, tokens)``: every item in one container of at most ``capacity`` tokens.

    Items are spread by hash over blocks of about ``block``, the bound of what one task differences at once;
    a block is large enough that its last, less full window hardly counts. Items that fill a container alone skip the blocks.
    """
    items = cut(token_items(docs, doc, text, capacity, vocabulary_name, folder))
    full = items.where(F.col("tokens") == capacity).select(F.concat(F.lit("f"), F.col("doc").cast("string"), F.lit("."), F.col("piece").cast("string")).alias("container"), "*")
    rest = items.where(F.col("tokens") < capacity)
    blocks = max(1, -(-rest.count() // block))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("doc", "piece"), F.lit(blocks)).cast("int"))
    kind = items.schema["doc"].dataType.simpleString()

    def fill(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["tokens", "doc", "piece"], ascending=[False, True, True], ignore_index=True)
        windows = pack([int(x) for x in g["tokens"]], capacity)
        where = np.empty(len(g), dtype=object)
        for n, w in enumerate(windows):
            where[w] = f"{g['block'][0]}.{n}"
        return pd.DataFrame({"container": where, **{c: g[c] for c in ("doc", "piece", "start", "end", "tokens")}})

    packed = rest.repartition(max(1, min(blocks, 4 * parallelism(docs.sparkSession))), "block").groupBy("block").applyInPandas(fill, f"container string, doc {kind}, piece int, start int, end int, tokens int")
    return packed.unionByName(full).withColumnRenamed("doc", doc)
