"""Evaluation texts inside training text: one Aho-Corasick automaton, scanned once, with offsets in the original.

A text becomes a stream of tokens: words of Latin letters or digits, and single ideographs, after case, width,
look-alike, invisible and (by the table of readings) traditional forms are folded; marks and spaces part tokens and
are dropped. Each token that the evaluation items know is one character of a code alphabet, so the automaton runs
over short strings. Its patterns are all runs of a few tokens of every item. Hits on one item are chained where they
go on in both texts, runs are extended over single altered tokens, and a stretch counts by its length in the item.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strophe.functions.text import INVISIBLE, lookalike_table
from strophe.session import even, once

_TOKEN = re.compile(r"[a-z0-9À-ɏ]+(?:'[a-z]+)?|[㐀-鿿]")
_MARKS = r"[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f]"
_MARK = re.compile(_MARKS)
_WITH_MARKS = re.compile(rf"(?s).{_MARKS}*")  # a character and its marks
_FIRST_CODE = 0xE000  # codes start in the private use area and go on in the planes of private use


@dataclass(frozen=True)
class Stretch:
    """From how many words or ideographs a stretch counts, and how it is sought."""

    words: int = 20
    ideographs: int = 40
    word_seed: int = 4  # tokens of a pattern that starts with a word
    ideograph_seed: int = 6  # tokens of a pattern that starts with an ideograph
    gap: int = 6  # altered tokens between two hits of a chain, at most


def fold_table(simplified: dict[int, str]) -> dict[int, str | None]:
    """One-to-one or deleting map of characters, so that offsets stay known."""
    table: dict[int, str | None] = {}
    for ch, to in lookalike_table().items():
        table[ord(ch)] = simplified.get(ord(to), to).lower()
    for c, to in simplified.items():
        table.setdefault(c, to)
    parts = re.findall(r"(.)(?:-(.))?", INVISIBLE)
    for lo, hi in parts:
        for c in range(ord(lo), ord(hi or lo) + 1):
            table[c] = None
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = chr(c + 32)
    table[0x130] = "i"  # the only character whose lower case is two
    return table


def _composed(text: str, table: dict[int, str | None]) -> str:
    """Accents composed, marks without a composed form dropped, compatibility forms (ligatures, enclosed letters) written out; what
    they bring in is folded too."""
    return _MARK.sub("", unicodedata.normalize("NFKC", text)).translate(table)


def _is_composed(text: str) -> bool:
    return unicodedata.is_normalized("NFKC", text) and not _MARK.search(text)


def stream(text: str, table: dict[int, str | None]) -> list[str]:
    """Tokens of the folded text."""
    if text.isascii():
        return _TOKEN.findall(text.lower())
    folded = text.translate(table)
    if not _is_composed(folded):
        folded = _composed(folded, table)
    return _TOKEN.findall(folded.lower())


def stream_offsets(text: str, table: dict[int, str | None]) -> list[tuple[int, int]]:
    """Start and end of each token of ``stream`` in the original text.

    The text is folded once, with the place of every folded character kept. A character and its combining marks are composed
    as one, so what comes of them stands where they stood.
    """
    kept = [(i, x) for i, ch in enumerate(text) if (x := table.get(ord(ch), ch)) is not None]
    folded = "".join(x for _, x in kept)
    begins, ends = [i for i, _ in kept], [i + 1 for i, _ in kept]
    if not _is_composed(folded):
        parts, b, e = [], [], []
        for m in _WITH_MARKS.finditer(folded):
            to = _composed(m[0], table)
            parts.append(to)
            b += [begins[m.start()]] * len(to)
            e += [ends[m.end() - 1]] * len(to)
        folded, begins, ends = "".join(parts), b, e
    return [(begins[m.start()], ends[m.end() - 1]) for m in _TOKEN.finditer(folded.lower())]


class Index:
    """The automaton over all items, and what is needed to judge hits."""

    def __init__(self, items: list[tuple[int, str]], table: dict[int, str | None], rule: Stretch) -> None:
        self.table, self.rule = table, rule
        self.code: dict[str, str] = {}
        self.items: list[tuple[int, str, list[bool]]] = []  # id, coded text, token is a word
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for ident, text in items:
            tokens = stream(text, table)
            coded = "".join(self.code.setdefault(t, self._char(len(self.code))) for t in tokens)
            word = [not "㐀" <= t[0] <= "鿿" for t in tokens]
            n = len(self.items)
            self.items.append((ident, coded, word))
            for i in range(len(coded)):
                k = rule.word_seed if word[i] else rule.ideograph_seed
                if i + k <= len(coded):
                    found[coded[i : i + k]].append((n, i))
        self.machine = ahocorasick.Automaton()
        for p, where in found.items():
            self.machine.add_word(p, (len(p), where))
        if found:
            self.machine.make_automaton()

    @staticmethod
    def _char(n: int) -> str:
        n += _FIRST_CODE
        return chr(n if n < 0xF900 else n - 0xF900 + 0xF0000)

    def encode(self, tokens: list[str]) -> str:
        get = self.code.get
        return "".join([get(t, "\0") for t in tokens])

    def stretches(self, tokens: list[str]) -> dict[int, tuple[int, int, int]]:
        """Item id to (length in the item, first token, last token in the text) of its longest stretch that counts."""
        if not self.items or not len(self.machine):
            return {}
        coded = self.encode(tokens)
        hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for end, (size, where) in self.machine.iter(coded):
            for n, i in where:
                hits[n].append((end - size + 1, i, size))
        out: dict[int, tuple[int, int, int]] = {}
        for n, h in hits.items():
            if len(h) < 2:
                continue
            ident, item, word = self.items[n]
            best = (0.0, 0, 0, 0)
            for j0, j1, i0, i1 in self._chains(h):
                j0, i0 = self._extend(coded, item, j0, i0, -1)
                j1, i1 = self._extend(coded, item, j1, i1, 1)
                words = sum(word[i0 : i1 + 1])
                share = words / self.rule.words + (i1 - i0 + 1 - words) / self.rule.ideographs
                if share > best[0]:
                    best = (share, i1 - i0 + 1, j0, j1)
            if best[0] >= 1:
                out[ident] = best[1:]
        return out

    def _chains(self, h: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """Runs of hits that go on in both texts within the gap: (first, last) in the text and in the item, by greedy extension
        of the chain whose end lies nearest."""
        gap = self.rule.gap
        chains: list[list[int]] = []
        live: list[int] = []  # chains that may still go on
        for j, i, size in h:
            best, cost = -1, 10**9
            keep = []
            for c in live:
                _, j1, _, i1 = chains[c]
                if j - j1 - 1 > gap:
                    continue
                keep.append(c)
                dj, di = j + size - 1 - j1, i + size - 1 - i1
                if 0 < dj and 0 < di <= gap + size and i - i1 - 1 <= gap and abs(dj - di) <= 3 and dj + abs(dj - di) < cost:
                    best, cost = c, dj + abs(dj - di)
            live = keep
            if best >= 0:
                chains[best][1], chains[best][3] = j + size - 1, i + size - 1
            else:
                chains.append([j, j + size - 1, i, i + size - 1])
                live.append(len(chains) - 1)
        return ((c[0], c[1], c[2], c[3]) for c in chains)

    @staticmethod
    def _extend(text: str, item: str, j: int, i: int, step: int) -> tuple[int, int]:
        """Moves an end outwards over equal tokens, and over one altered, added or left-out token if two equal ones follow."""
        while True:
            a, b = j + step, i + step
            if not (0 <= a < len(text) and 0 <= b < len(item)):
                return j, i
            if text[a] == item[b]:
                j, i = a, b
                continue
            for da, db in ((1, 1), (0, 1), (1, 0)):
                x, y = a + step * da, b + step * db
                xx, yy = x + step, y + step
                if 0 <= min(x, xx) and max(x, xx) < len(text) and 0 <= min(y, yy) and max(y, yy) < len(item) and text[x] == item[y] and text[xx] == item[yy]:
                    j, i = x, y
                    break
            else:
                return j, i


def find_leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, simplified: dict[int, str], rule: Stretch = Stretch(), most_chars: int = 20_000_000, offsets: bool = False) -> DataFrame:
    """``(doc, item)`` and, with offsets, ``length, start, end`` of each text that carries a stretch of an item.

    items: the evaluation texts, a stated set that does not grow with the corpus; more than ``most_chars`` characters
    are refused, since every worker holds their automaton. Null or empty texts carry nothing; repeated rows count
    once. One scan, one Arrow stage.
    """
    held = items.where(F.col(item_text).isNotNull()).agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0]
    if held > most_chars:
        raise ValueError(f"{held} characters of evaluation text; at most {most_chars} fit one automaton")
    table = fold_table(simplified)
    rows = [(r[0], r[1]) for r in items.select(item, item_text).where(F.col(item_text).isNotNull()).distinct().collect()]
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    run = uuid.uuid4().hex

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = once(("leaks", run), lambda: Index(shared.value, table, rule))  # one automaton a worker, not one a task
        for b in batches:
            out = []
            for d, t in zip(b["doc"], b["text"]):
                got = index.stretches(stream(t, table))
                if not got:
                    continue
                at = stream_offsets(t, table) if offsets else None
                for ident, (length, j0, j1) in got.items():
                    out.append((d, ident, length, at[j0][0] if at else 0, at[j1][1] if at else 0))
            yield pd.DataFrame(out, columns=["doc", "item", "length", "start", "end"]).astype({"length": "int32", "start": "int32", "end": "int32"})

    doc_type, item_type = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    least = min(rule.words, rule.ideographs)
    d = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where(F.length("text") >= least)
    found = even(d).mapInPandas(scan, f"doc {doc_type}, item {item_type}, length int, start int, end int")
    found = found.withColumnsRenamed({"doc": doc, "item": item}).distinct()
    return found if offsets else found.select(doc, item)
