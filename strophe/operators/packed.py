"""Cells that hold several values: a quote-aware finite-state tokenizer.

The states are: between values, inside a bare value, inside a quoted value, and
after a closing quote. Escapes and the depth of nested brackets are tracked beside
the state. A delimiter counts only outside quotes, unescaped and at depth 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from strophe.functions.text import is_missing

#: Opening quotes and what closes them.
QUOTES = {'"': '"', "“": "”", "「": "」", "『": "』", "«": "»", "„": "“"}
#: Brackets that may nest, or stand around a whole cell.
BRACKETS = {"[": "]", "【": "】", "［": "］", "{": "}", "(": ")", "（": "）"}
#: Every list separator, and those that cannot be part of running text.
LIST_SEPARATORS = ";；,，、|｜/\t\n\r"
TEXT_SEPARATORS = ";；|｜\t\n\r"

_SPACE = " \t\n\r 　"


def tokenize_cell(cell: str, separators: str) -> list[str]:
    """The values of one cell, in order, trimmed, without quotes, brackets around the cell and escapes; empty ones dropped.

    A separator parts values only outside quotes, unescaped and at depth 0: what stands inside a pair of brackets of any kind
    stays together, and its brackets are kept. A bracket without its partner is an ordinary character.
    """
    text = cell.strip(_SPACE)
    pairs = _bracket_pairs(text) if any(b in text for b in BRACKETS) else {}
    if pairs and pairs.get(0) == len(text) - 1:
        text, pairs = text[1:-1], {a - 1: b - 1 for a, b in pairs.items() if a}
        if text.lstrip(_SPACE)[:1] in QUOTES:  # a written list of quoted values: commas part them in any field
            separators += ","
    ends = set(pairs.values())
    out: list[str] = []
    buf: list[str] = []  # characters of the value so far
    keep = 0  # length of buf that trimming may not shorten (quoted or escaped characters)
    quote = ""  # the closing quote looked for, or empty
    quoted = False  # the value began with a quote that has closed
    depth = 0  # pairs of brackets that are open
    i, n = 0, len(text)

    def emit() -> None:
        nonlocal keep, quoted
        end = len(buf)
        while end > keep and buf[end - 1] in _SPACE:
            end -= 1
        piece = "".join(buf[:end]).strip(_SPACE)
        if piece:
            out.append(piece)
        buf.clear()
        keep, quoted = 0, False

    while i < n:
        ch = text[i]
        if ch == "\\" and i + 1 < n and not text[i + 1].isalnum():
            buf.append(text[i + 1])
            keep = len(buf)
            i += 2
            continue
        if quote:
            if ch == quote:
                if text[i + 1 : i + 2] == quote and quote == '"':
                    buf.append(quote)
                    keep = len(buf)
                    i += 2
                    continue
                quote, quoted = "", True
            else:
                buf.append(ch)
                keep = len(buf)
        elif depth:
            depth += (i in pairs) - (i in ends)
            buf.append(ch)
        elif ch in separators:
            emit()
        elif not buf and not quoted and ch in _SPACE:
            pass
        elif not buf and not quoted and ch in QUOTES and _closes(text, i, separators):
            quote = QUOTES[ch]
        else:
            depth += i in pairs
            buf.append(ch)
        i += 1
    emit()
    return out


def _closes(text: str, start: int, separators: str) -> bool:
    """A quote opens a value only if a closing one follows that ends the value: then comes a separator or the end."""
    close = QUOTES[text[start]]
    i, n = text.find(close, start + 1), len(text)
    if i < 0:
        return False
    i = start + 1
    while i < n:
        if text[i] == "\\" and i + 1 < n:
            i += 2
            continue
        if text[i] == close:
            i += 1
            if close == '"' and text[i : i + 1] == '"':
                i += 1
                continue
            while i < n and text[i] in "  　":
                i += 1
            return i == n or text[i] in separators
        i += 1
    return False


def _bracket_pairs(text: str) -> dict[int, int]:
    """Opening to closing positions of the brackets that have a partner, outside quotes and unescaped."""
    ends = LIST_SEPARATORS + "".join(BRACKETS.values())
    pairs: dict[int, int] = {}
    open_: list[tuple[str, int]] = []  # the closing bracket looked for, and where its partner stands
    waiting: Counter[str] = Counter()
    quote, start, i = "", True, 0  # start: a value may begin here
    while i < len(text):
        ch = text[i]
        if ch == "\\":
            start = False
            i += 2
            continue
        if quote:
            if ch == quote:
                if quote == '"' and text[i + 1 : i + 2] == quote:
                    i += 1
                else:
                    quote = ""
        elif start and ch in QUOTES and _closes(text, i, ends):
            quote = QUOTES[ch]
        elif ch in BRACKETS:
            open_.append((BRACKETS[ch], i))
            waiting[BRACKETS[ch]] += 1
        elif waiting[ch]:
            while True:  # what opened inside and never closed is ordinary text
                closing, at = open_.pop()
                waiting[closing] -= 1
                if closing == ch:
                    pairs[at] = i
                    break
        start = ch in LIST_SEPARATORS or ch in BRACKETS or (start and ch in _SPACE)
        i += 1
    return pairs


def split_packed(df: DataFrame, key: str, fields: dict[str, str], least: int = 1) -> DataFrame:
    """One row per value of the packed cells: ``(key, field, pos, piece)``.

    fields: column name to its separators. least: cells with fewer values give no rows.
    Missing cells (null, empty, NA, nan, None) and cells of separators only give no rows. Equal rows of
    ``df`` count once by ``key``; other columns are ignored, so clashing names do not matter.
    Rows without a key are kept with a null key. pos counts from 0 over non-empty pieces.

    No shuffle but the one that makes keys distinct; cells that hold no separator at
    all cannot hold two values and are decided before the Python stage where least > 1.
    In a cell that begins with a bracket a comma may be one, whatever its field.
    """
    struct = F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("cell")) for name in fields])
    cells = df.select(F.col(key).alias("__key"), F.explode(struct).alias("c")).select("__key", "c.field", "c.cell")
    cells = cells.where(~is_missing("cell"))
    if least > 1:
        any_of = F.ltrim("cell", F.lit(_SPACE)).substr(1, 1).isin(*BRACKETS) & F.contains("cell", F.lit(","))
        for name, seps in fields.items():
            any_of = any_of | ((F.col("field") == name) & (F.length(F.translate("cell", seps, "")) < F.length("cell")))
        cells = cells.where(any_of)
    cells = cells.distinct()
    separators = dict(fields)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, names, at, got = [], [], [], []
            for k, f, c in zip(b["__key"], b["field"], b["cell"]):
                values = tokenize_cell(c, separators[f])
                if len(values) >= least:
                    keys += [k] * len(values)
                    names += [f] * len(values)
                    at += range(len(values))
                    got += values
            yield pd.DataFrame({key: pd.Series(keys, dtype=b["__key"].dtype), "field": names, "pos": pd.Series(at, dtype="int32"), "piece": got})

    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField("field", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("piece", T.StringType())])
    return cells.mapInPandas(pieces, schema)
