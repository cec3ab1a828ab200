"""Scalar functions as Column expressions: names, titles, years, clock text, music arithmetic, vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from strophe.functions.text import SPACE_CLASS

# The words and patterns that define keys and ids of the released tables.
BRACKETED = r"[（(\[][^）)\]]*[）)\]]"
TITLE_MARKS = r"[\s《》·,，.。'\"-]"
GENRE_WORDS = ("民歌", "山歌", "小调", "号子", "情歌", "酒歌", "茶歌", "渔歌", "船歌", "田歌", "童谣", "长调", "短调")
UNNAMED = "(?i)未标|未详|不详|unknown"
ROLE_WORDS = ("演唱", "领唱", "独唱", "对唱", "合唱", "老师", "等")


def norm_title(c: Column) -> Column:
    """Leading number, bracketed parts, marks and spaces dropped; lower case."""
    c = F.regexp_replace(c, r"^\d+[_\-\s.]*", "")
    c = F.regexp_replace(c, BRACKETED, "")
    return F.lower(F.regexp_replace(c, TITLE_MARKS, ""))


def is_generic_title(key: Column, raw: Column) -> Column:
    """True for empty keys, bare genre words with up to four characters before them, and titles said to be unknown."""
    words = "|".join(GENRE_WORDS)
    return (key == "") | key.rlike(f"^.{{0,4}}({words})$") | F.coalesce(raw, F.lit("")).rlike(UNNAMED)


def song_key(raw: Column, ident: Column) -> Column:
    """The normalised title; generic ones carry their item so that they never meet."""
    key = norm_title(F.coalesce(raw, F.lit("")))
    generic = is_generic_title(key, raw)
    return F.when(generic, F.concat(F.when(key == "", F.lit("untitled")).otherwise(key), F.lit("#"), ident)).otherwise(key)


def singer_key(c: Column) -> Column:
    """A stable id of a name: 'S' and eight hex digits of the SHA-1 of the name without brackets, spaces and role words."""
    name = F.regexp_replace(F.regexp_replace(c, BRACKETED, ""), r"\s", "")
    name = F.regexp_replace(name, "|".join(ROLE_WORDS), "")
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("S"), F.substring(F.sha1(name), 1, 8)))


def trim_all(c: Column) -> Column:
    """Drops every kind of space at both ends."""
    return F.regexp_replace(c, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def split_names(c: Column, marks: str = r"[、,，;；/|&]") -> Column:
    """Names of a list, trimmed, without brackets; empty ones dropped, the first of equal ones kept."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), marks), lambda x: trim_all(F.regexp_replace(x, BRACKETED, "")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def group_and_subgroup(c: Column) -> Column:
    """'汉族（客家）' as (汉, 客家); the subgroup is null where none is given."""
    group = F.regexp_replace(F.trim(F.regexp_replace(c, BRACKETED, "")), "族$", "")
    sub = F.regexp_extract(c, r"[（(]([^）)]*)[）)]", 1)
    return F.struct(F.nullif(group, F.lit("")).alias("group"), F.nullif(sub, F.lit("")).alias("subgroup"))


def between_marks(c: Column, opening: str = "《", closing: str = "》") -> Column:
    """The text between the first pair of marks, or null."""
    return F.nullif(F.regexp_extract(c, f"{opening}([^{closing}]*){closing}", 1), F.lit(""))


def first_year(c: Column) -> Column:
    """The first year from 1500 to 2029 in a text, or null."""
    return F.regexp_extract(c, r"(1[5-9][0-9]{2}|20[0-2][0-9])", 1).try_cast("int")


def year_of_number(c: Column) -> Column:
    """The year of yyyymmdd, also where a null made the number a float."""
    return F.floor(c / 10000).cast("int")


def date_of_number(c: Column) -> Column:
    return F.try_to_date(F.format_string("%08d", c.cast("long")), "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(F.format_string("%08d", c.cast("long")), "yyyyMMdd")


def decade(c: Column) -> Column:
    return (F.floor(c / 10) * 10).cast("int")


def clock_seconds(c: Column) -> Column:
    """'1:02:03', '4:05' or '59' as seconds; null where a part is no number."""
    return F.aggregate(F.split(c, ":"), F.lit(0.0), lambda acc, x: acc * 60 + x.try_cast("double"))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """A percentage, rounded half to even, with nothing divided by zero."""
    return F.bround(100.0 * part / F.greatest(whole, F.lit(1)), digits)


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(c)), r"[\s/]+", "_")


def is_ideographic(c: Column) -> Column:
    """Only ideographs and middle dots."""
    return c.rlike("^[\\u4e00-\\u9fff·]+$")


def circular_distance(a: Column, b: Column, n: int = 12) -> Column:
    """Distance on a circle of n steps, from -n/2 to n/2 - 1."""
    return F.pmod(a - b + n // 2, F.lit(n)) - n // 2


def hz_to_midi(c: Column) -> Column:
    """MIDI number of a frequency; null for unvoiced frames (0 or less)."""
    return F.when(c > 0, 69 + 12 * F.log2(c / 440.0))


def midi_to_hz(c: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (c - 69) / 12.0)


def decibels(ratio: Column) -> Column:
    return F.when(ratio > 0, 20 * F.log10(ratio))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def rotate(a: Column, k: Column) -> Column:
    """The array turned left by k."""
    return F.concat(F.slice(a, k + 1, F.size(a)), F.slice(a, F.lit(1), k))


def argmax(a: Column) -> Column:
    """Index from 0 of the first greatest element."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def one_hot(c: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == c).cast("int"))


def bit_error(a: Column, b: Column) -> Column:
    """Share of the bits (of 32) that differ."""
    return F.bit_count(a.bitwiseXOR(b)) / 32.0


def hash_order(seed: str, *columns: str | Column) -> Column:
    """A fixed, portable order for sampling: the MD5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]))


def multi_replace(c: Column, words: Sequence[str], to: str) -> Column:
    """Literal replacement of a bounded list of words, the longest first."""
    import re

    if not words:
        return c
    return F.regexp_replace(c, "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))), to)
