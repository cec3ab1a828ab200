"""Splitting oversized texts at natural boundaries, with an overlap between consecutive pieces.

Recursive separators: section, paragraph, line, sentence, clause, word, character. A piece is packed greedily with the parts of the
text at the strongest level. The part that does not fit is opened, and its own parts are packed one level down, and so on
until the piece is at least ``least`` full. The next piece starts so many tokens earlier as the overlap says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strophe.llm.tokens import Encoder, encoder, kinds_of, vocabulary
from strophe.session import even, once

_CLOSE = "[\"'”’」』）)\\]】》]*"
#: Boundaries, strongest first: a piece may end where the match ends.
LEVELS: tuple[tuple[str, re.Pattern[str] | None], ...] = (
    ("section", re.compile(r"(?:\r?\n[ \t　]*){3,}|\r?\n(?=\s*(?:#{1,6} |第[一二三四五六七八九十百]+[章节篇]))")),
    ("paragraph", re.compile(r"\r?\n[ \t　]*\r?\n\s*")),
    ("line", re.compile(r"\r\n|\n|\r| | ")),
    ("sentence", re.compile(rf"[。！？!?…]+{_CLOSE}|\.{_CLOSE}(?=\s)")),
    ("clause", re.compile(rf"[；;：:，,、]{_CLOSE}|[—–]+")),
    ("word", None),  # see word_ends
)


def word_ends(points: np.ndarray) -> np.ndarray:
    """Where white space begins or ends, and where Latin letters or digits and ideographs meet."""
    space = once(("spaces",), lambda: np.fromiter((chr(c).isspace() for c in range(0x3001)), dtype=bool, count=0x3001))[np.minimum(points, 0x3000)] & (points <= 0x3000)
    latin = (points >= 48) & (points <= 57) | (points >= 65) & (points <= 90) | (points >= 97) & (points <= 122)
    han = (points >= 0x3400) & (points <= 0x9FFF)
    turn = (space[:-1] != space[1:]) | latin[:-1] & han[1:] | han[:-1] & latin[1:]
    return np.append(np.flatnonzero(turn) + 1, [len(points)] if len(points) and space[-1] else []).astype(np.int64)


def split_text(text: str, limit: int, overlap: int, enc: Encoder, least: float = 0.5) -> list[tuple[int, int, int, str]]:
    """``(start, end, tokens, level)`` of ordered pieces that cover the text; [] where it is not above the limit.

    tokens is counted as the piece would be encoded alone and is at most limit; each piece but the first begins at
    least ``overlap`` tokens before the end of the one before (exactly so where a token boundary falls between characters).
    """
    if not 0 <= overlap < limit * least:
        raise ValueError("the overlap must be smaller than the least filling of a piece")
    ids = enc.encode(text)
    if len(ids) <= limit:
        return []
    chars, whole = enc.boundaries(text, ids)
    last = len(chars) - 1
    usable = np.flatnonzero(whole)
    at_char = chars[usable]
    cuts: list[np.ndarray] = []
    points, kinds = kinds_of(text)
    count = enc.counter(text, at_char, usable, kinds, points)
    for _, pattern in LEVELS:
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64) if pattern else word_ends(points)
        pos = np.searchsorted(at_char, ends)
        ok = pos < len(at_char)
        ok[ok] = at_char[pos[ok]] == ends[ok]
        cuts.append(np.unique(usable[pos[ok]]))
    out: list[tuple[int, int, int, str]] = []
    a = 0
    while True:
        room = limit
        while True:
            top = a + room
            if top >= last:
                b, level = last, "end"
            else:
                b, level = _pack(cuts, usable, 0, a, last, top, a + max(overlap + 1, int(room * least)))
            n = count(int(chars[a]), int(chars[b]))
            if n <= limit or room <= overlap + 8:
                break
            room -= max(1, n - limit)
        out.append((int(chars[a]), int(chars[b]), n, level))
        if b >= last:
            return out
        back = b - overlap
        a = int(usable[np.searchsorted(usable, back, side="right") - 1])


def _pack(cuts: list[np.ndarray], usable: np.ndarray, level: int, a: int, b: int, top: int, low: int) -> tuple[int, str]:
    """End of a piece in the unit from a to b: as many of its parts at this level as end by top; if that is not yet at low, the part
    that did not fit is opened one level down. The last level is that of characters."""
    if level == len(cuts):
        k = int(np.searchsorted(usable, top, side="right")) - 1
        return int(usable[k] if usable[k] > a else usable[k + 1]), "character"
    ends = cuts[level]
    first, past = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, top, side="right"))
    end = int(ends[past - 1]) if past > first else a
    if end >= low:
        return end, LEVELS[level][0]
    until = min(b, int(ends[past])) if past < len(ends) else b
    return _pack(cuts, usable, level + 1, end, until, top, low)


def split_documents(docs: DataFrame, doc: str, text: str, limit: int, overlap: int, vocabulary_name: str, folder: str) -> DataFrame:
    """``(doc, piece, start, end, tokens, level, text)`` of the documents above the limit, whole texts; at most one shuffle, which evens out
    the work of a table that the scan has cut coarsely.

    start and end are offsets in characters; level says where the piece was cut. Null, empty and short texts give no rows.
    Rows that repeat a document repeat its pieces.
    """
    data = vocabulary(docs.sparkSession, vocabulary_name, folder)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary_name, data.value)
        for b in batches:
            rows = [(d, i, *p, t[p[0] : p[1]]) for d, t in zip(b["doc"], b["text"]) for i, p in enumerate(split_text(t, limit, overlap, enc))]
            yield pd.DataFrame(rows, columns=["doc", "piece", "start", "end", "tokens", "level", "text"]).astype({c: "int32" for c in ("piece", "start", "end", "tokens")})

    kind = docs.schema[doc].dataType.simpleString()
    # a text has at most as many tokens as bytes
    long = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where(F.octet_length("text") > limit)
    return even(long).mapInPandas(split, f"doc {kind}, piece int, start int, end int, tokens int, level string, text string").withColumnRenamed("doc", doc)
