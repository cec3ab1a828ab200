"""Public tokenizers in Arrow workers: counts, and token boundaries that fall between characters."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from strophe.session import once

#: Folder of the vocabulary files; a parameter of every query that counts tokens.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the public pre-tokenizer pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Kinds of characters in the pattern; what is not assigned may be of another kind elsewhere.
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _kind_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER, "M": OTHER, "P": OTHER, "S": OTHER, "Z": OTHER, "C": UNKNOWN}
    table = np.fromiter((kinds[unicodedata.category(chr(c))[0]] for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    table[_WHITE] = SPACE
    return table


def kinds_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code point and kind of every character."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return points, once(("kinds",), _kind_table)[points]


class Encoder:
    """A byte-level vocabulary with numpy views of its tokens' lengths."""

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.bytes[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def boundaries(self, text: str, ids: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each token boundary (0 .. number of tokens): its offset in characters, and whether it falls between two characters.
        ids: the tokens of the text, where they are known already."""
        ids = np.asarray(self.encode(text) if ids is None else ids, dtype=np.int64)
        at = np.concatenate(([0], np.cumsum(self.bytes[ids])))
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        starts = np.concatenate(((raw & 0xC0) != 0x80, [True]))
        chars = np.concatenate(([0], np.cumsum(starts[:-1])))
        return chars[at], starts[at]

    def counter(self, text: str, at_char: np.ndarray, index: np.ndarray, kinds: np.ndarray, points: np.ndarray) -> Callable[[int, int], int]:
        """A function (a, b) to the tokens of ``text[a:b]`` encoded alone, from the tokens of the whole text.

        at_char, index: offsets of the token boundaries that fall between characters, and their numbers. Where the kind of character
        changes, and not after a space or an apostrophe, the pattern parts the text whatever stands around. So between the first and the
        last such place in a piece its tokens are those of the whole text, and only its ends are encoded again.
        """
        change = (kinds[:-1] != kinds[1:]) & (kinds[:-1] != SPACE) & (kinds[:-1] != UNKNOWN) & (kinds[1:] != UNKNOWN) & (points[:-1] != 0x27)
        parts = np.concatenate(([0], np.flatnonzero(change) + 1))

        def count(a: int, b: int) -> int:
            i, j = int(np.searchsorted(parts, a)), int(np.searchsorted(parts, b, side="right")) - 1
            if i >= j:
                return self.count(text[a:b])
            first, last = int(parts[i]), int(parts[j])
            middle = int(index[np.searchsorted(at_char, last)] - index[np.searchsorted(at_char, first)])
            return (self.count(text[a:first]) if a < first else 0) + middle + (self.count(text[last:b]) if last < b else 0)

        return count


def vocabulary(spark: SparkSession, name: str, folder: str = VOCABULARIES):
    """The vocabulary file as a broadcast (a fixed file of under 2 MB), so that workers need no copy of the folder."""
    data = Path(folder, name).read_bytes()
    if len(data) > 8_000_000:
        raise ValueError(f"{name} is larger than a vocabulary should be")
    return spark.sparkContext.broadcast(data)


def encoder(name: str, data: bytes) -> Encoder:
    """One encoder a worker and vocabulary."""
    return once(("encoder", name, len(data)), lambda: Encoder(data))
