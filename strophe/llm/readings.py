"""Readings of names: the common ground of scripts in which one name is spelt.

A small reference table (character, reading without tones, simplified form) maps
ideographs to syllables; Latin spellings are cut into the same syllables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from strophe.functions.text import fold_text

HAN = "㐀-鿿"


@dataclass
class Readings:
    """simplified: code point to simplified character; reading: character to syllable; syllables: all of them."""

    simplified: dict[int, str]
    reading: dict[str, str]
    syllables: frozenset[str] = field(default_factory=frozenset)

    @staticmethod
    def load(table: DataFrame, ch: str = "ch", reading: str = "reading", simplified: str = "simplified", most: int = 100_000) -> Readings:
        """Reads the reference table. It is a fixed list of characters; more than ``most`` rows is refused."""
        rows = table.select(ch, reading, simplified).where(f"{ch} is not null").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"the table of readings has more than {most} rows")
        simple = {ord(r[0]): r[2] for r in rows if len(r[0]) == 1 and r[2] and r[2] != r[0]}
        read = {r[0]: r[1].lower() for r in rows if r[1]}
        return Readings(simple, read, frozenset(read.values()))

    def fold(self, v: str) -> str:
        return fold_text(v, self.simplified)

    def to_syllables(self, s: str) -> tuple[list[str], bool]:
        """Syllables of a folded name, and whether a part of it is spelt in Latin letters.
        Ideographs without a reading stand for themselves; marks and spaces are dropped."""
        out: list[str] = []
        latin = False
        for m in re.finditer(rf"([a-z'’]+)|([0-9]+)|([{HAN}])", s):
            if m[1]:
                latin = True
                out += cut_latin(m[1].replace("'", "").replace("’", ""), self.syllables)
            else:
                out.append(self.reading.get(m[0], m[0]))
        return out, latin


def _cut(word: str, syllables: frozenset[str]) -> tuple[str, ...]:
    n = len(word)
    best: list[tuple[int, int, int]] = [(0, 0, 0)] + [(10**6, 0, 0)] * n  # letters outside syllables, pieces, start of the last piece
    for i in range(n):
        if best[i][0] >= 10**6:
            continue
        for j in range(i + 1, min(n, i + 6) + 1):
            known = word[i:j] in syllables
            if not known and j > i + 1:
                continue
            cand = (best[i][0] + (0 if known else 1), best[i][1] + 1, i)
            if cand[:2] < best[j][:2]:
                best[j] = cand
    out = []
    while n:
        i = best[n][2]
        out.append(word[i:n])
        n = i
    return tuple(reversed(out))


#: Words cut so far in this process; emptied when it grows, so a worker holds a bounded number.
_CUTS: dict[str, tuple[str, ...]] = {}


def cut_latin(word: str, syllables: frozenset[str]) -> list[str]:
    """The word in known syllables: fewest letters outside them, then fewest pieces."""
    if not word:
        return []
    if len(word) > 64:
        return list(_cut(word, syllables))
    key = f"{len(syllables)} {word}"
    if key not in _CUTS:
        if len(_CUTS) > 100_000:
            _CUTS.clear()
        _CUTS[key] = _cut(word, syllables)
    return list(_CUTS[key])


def edits(a, b, most: int, substitute: bool = True) -> int:
    """Edits that turn a into b (insert, delete, exchange of neighbours and, where allowed, substitution); most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[j - 1] + 1)
            if x == y:
                v = min(v, prev[j - 1])
            elif substitute:
                v = min(v, prev[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, prev = prev, row
    return min(prev[-1], most + 1)
