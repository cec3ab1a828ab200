"""Text predicates and folds shared by operators.

Column-level forms stay in the JVM (``translate``, ``regexp_replace``); the
Python forms serve kernels that already run in Arrow-batched workers.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F

#: The spellings of "missing" in text cells (beside null).
MISSING_WORDS = ("", "NA", "nan", "None")

#: Characters that leave no mark on screen: soft hyphen, joiners, marks of direction, variation selectors.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿"
INVISIBLE_CLASS = f"[{INVISIBLE}]"
SPACE_CLASS = "[\\s\u0085   -     　]"

# Letters and marks of other blocks that look like ASCII ones (after the public
# Unicode confusables data), in the order of the character they look like.
LOOKALIKES = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ΕЕᎬ", "G": "ԌᏀ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈᎫ",
    "K": "ΚКᏦ", "L": "Ꮮ", "M": "ΜМᎷ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "S": "ЅՏ", "T": "ΤТᎢ",
    "V": "ѴᏙ", "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "аɑα", "b": "Ƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һհ", "i": "іı", "j": "јϳ", "k": "ĸ",
    "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "х",
    "y": "уγү", "z": "ᴢ",
    "-": "‐‑‒–−˗⁃", "·": "•‧∙⋅・･᛫·", "'": "‘’‛ʹʼ′´`", '"': "“”‟″",
    "(": "❨", ")": "❩", ":": "։׃∶ː", "|": "ǀ∣", "/": "⁄∕", "~": "∼˜", "!": "ǃ", "*": "∗⁎",
}

# Brackets of another shape. They do not read as round ones, but mean the same to a parser of names.
BRACKETS_ALIKE = {"〔": "(", "〕": ")", "❲": "(", "❳": ")"}


def is_missing(c: Column | str) -> Column:
    """True for null and for every spelling of missing text."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | c.isin(*MISSING_WORDS)


def present(c: Column | str) -> Column:
    """The text, or null where it is missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~is_missing(c), c)


def number_present(c: Column | str) -> Column:
    """The number, or null where it is null or NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def width_table() -> dict[str, str]:
    """Single characters whose compatibility form is one other character of the same look:
    width variants, compatibility ideographs and radicals. Made from the Unicode tables by rule."""
    blocks = [(0x2E80, 0x2FDF), (0xF900, 0xFAFF), (0xFF01, 0xFFEE), (0x2F800, 0x2FA1F)]
    out = {}
    for lo, hi in blocks:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            to = unicodedata.normalize("NFKC", ch)
            if to != ch and len(to) == 1:
                out[ch] = to
    return out


def lookalike_table() -> dict[str, str]:
    """Character to the one it looks like: width forms first, then letters and marks of other blocks."""
    out = {x: to for to, all_ in LOOKALIKES.items() for x in all_}
    out |= {ch: out.get(to, to) for ch, to in width_table().items()}
    return out


def visible(c: Column, table: dict[str, str]) -> Column:
    """Drop invisible characters, bring every space to one plain space, then map characters (JVM only)."""
    c = F.regexp_replace(c, INVISIBLE_CLASS, "")
    c = F.regexp_replace(c, SPACE_CLASS + "+", " ")
    # translate() works on UTF-16 units of its argument: only BMP pairs are passed
    pairs = [(a, b) for a, b in table.items() if len(a) == 1 and ord(a) < 0x10000 and ord(b) < 0x10000]
    c = F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return F.trim(c)


_INVISIBLE = re.compile(INVISIBLE_CLASS)
_SPACES = re.compile(SPACE_CLASS + "+")


#: Tables made once a process. A plain dict, since functions travel to workers by value and a decorated cache does not.
_MADE: dict[str, dict] = {}


def _lookalike_map() -> dict[int, str]:
    if "map" not in _MADE:
        _MADE["map"] = str.maketrans(lookalike_table() | BRACKETS_ALIKE)
    return _MADE["map"]


def fold_text(v: str, simplified: dict[int, str] | None = None) -> str:
    """Python form for kernels: invisible characters dropped, compatibility and look-alike forms
    mapped, one space, lower case, optionally traditional characters simplified."""
    v = _INVISIBLE.sub("", v).translate(_lookalike_map())
    v = unicodedata.normalize("NFKC", v)
    if simplified:
        v = v.translate(simplified)
    return _SPACES.sub(" ", v).strip().lower()
