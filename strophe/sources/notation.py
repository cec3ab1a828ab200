"""Notation and markup files as rows: Humdrum kern, MIDI, MusicXML, TextGrid, record heads, HTML. Parsers are plain functions of one
file's text or bytes; ``parse_files`` runs one over a file tree in the workers."""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, types as T


def parse_files(spark: SparkSession, path: str, parser: Callable[[bytes], Iterable[tuple]], schema: str, glob: str = "*") -> DataFrame:
    """``(path, ...)``: the rows that the parser yields for each file. A file that does not parse gives one row with ``error``."""
    fields = T._parse_datatype_string(schema)
    out = T.StructType([T.StructField("path", T.StringType()), *fields, T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"]):
                try:
                    rows += [(p, *r, None) for r in parser(bytes(data))]
                except Exception as e:
                    rows.append((p, *[None] * len(fields), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=out.names, dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(run, out)


def parse_column(df: DataFrame, key: str, content: str, parser: Callable[[bytes], Iterable[tuple]], schema: str) -> DataFrame:
    """``(key, ...)``: as ``parse_files``, over a column of texts or bytes. A null content gives no row."""
    fields = T._parse_datatype_string(schema)
    out = T.StructType([T.StructField(key, df.schema[key].dataType), *fields, T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, data in zip(b[key], b[content]):
                try:
                    rows += [(k, *r, None) for r in parser(data.encode() if isinstance(data, str) else bytes(data))]
                except Exception as e:
                    rows.append((k, *[None] * len(fields), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=out.names, dtype=object)

    return df.select(key, content).where(df[content].isNotNull()).mapInPandas(run, out)


def decode(data: bytes) -> str:
    """Text of a file by its byte order mark, else UTF-8, else GBK."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    for enc in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(enc)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


_STEPS = {"c": 0, "d": 2, "e": 4, "f": 5, "g": 7, "a": 9, "b": 11}


def kern_pitch(token: str) -> int | None:
    """MIDI number of a kern note: doubled letters are octaves, # and - alter."""
    m = re.search(r"([a-gA-G])\1*", token)
    if not m:
        return None
    run = m[0]
    octave = 4 + len(run) - 1 if run[0].islower() else 3 - (len(run) - 1)
    after = token[m.end() :]
    return 12 * (octave + 1) + _STEPS[run[0].lower()] + after.count("#") - after.count("-")


def kern_duration(token: str) -> Fraction:
    """Length in quarters: a reciprocal number and dots; 0 is a breve."""
    m = re.search(r"(\d+)(\.*)", token)
    if not m:
        return Fraction(0)
    base = Fraction(8) if int(m[1]) == 0 else Fraction(4, int(m[1]))
    return base * (2 - Fraction(1, 2 ** len(m[2])))


def parse_kern(data: bytes) -> list[tuple[float, float, int, int]]:
    """``(onset, dur, pitch, phrase)`` of the first spine: ties are merged, grace notes dropped, rests only pass time (S-15)."""
    at, phrase = Fraction(0), 0
    out: list[list] = []
    tied: list | None = None
    for line in decode(data).splitlines():
        if not line or line[0] in "!*=":
            continue
        token = line.split("\t")[0].split(" ")[0]
        if token in (".", "") or "q" in token.lower():
            continue
        if "{" in token:
            phrase += 1
        dur = kern_duration(token)
        pitch = None if "r" in token else kern_pitch(token)
        if pitch is not None:
            if tied is not None and ("_" in token or "]" in token) and tied[2] == pitch:
                tied[1] += dur
            else:
                out.append([at, dur, pitch, max(phrase, 1)])
                tied = out[-1] if "[" in token else None
            if "]" in token:
                tied = None
        at += dur
    return [(float(a), float(b), p, f) for a, b, p, f in out]


def parse_kern_meters(data: bytes) -> list[tuple[int, str]]:
    """``(n, meter)`` of the first spine in order; ``*MX`` is a free one (S-15)."""
    found = (re.match(r"\*M(?:(\d+/\d+)|X)", line.split("\t")[0]) for line in decode(data).splitlines())
    return [(n, m[1] or "free") for n, m in enumerate(m for m in found if m)]


def parse_record_heads(data: bytes) -> list[tuple[str, str]]:
    """``(key, value)`` of lines like ``!!!KEY: value`` (S-19)."""
    return [(m[1], m[2].strip()) for m in re.finditer(r"^!!!([A-Za-z@]+)\d*:[ \t]*(.*)$", decode(data), re.M)]


def _varlen(data: bytes, i: int) -> tuple[int, int]:
    n = 0
    while True:
        byte = data[i]
        n, i = n << 7 | byte & 0x7F, i + 1
        if byte < 0x80:
            return n, i


def parse_midi(data: bytes, drums: bool = False) -> list[tuple[float, float, int, int, int]]:
    """``(onset, dur, pitch, velocity, track)`` in beats. Notes of the drum channel are left out unless asked for (S-14)."""
    if data[:4] != b"MThd":
        raise ValueError("not a MIDI file")
    size, _, tracks, division = struct.unpack(">IHHH", data[4:14])
    if division & 0x8000:
        raise ValueError("times in frames are not supported")
    i, out = 8 + size, []
    for track in range(tracks):
        if data[i : i + 4] != b"MTrk":
            raise ValueError("a track is missing")
        end = i + 8 + struct.unpack(">I", data[i + 4 : i + 8])[0]
        i, tick, status = i + 8, 0, 0
        sounding: dict[tuple[int, int], list[tuple[int, int]]] = {}
        while i < end:
            delta, i = _varlen(data, i)
            tick += delta
            if data[i] & 0x80:
                status, i = data[i], i + 1
            if status == 0xFF:
                n, j = _varlen(data, i + 1)
                i = j + n
                continue
            if status in (0xF0, 0xF7):
                n, j = _varlen(data, i)
                i = j + n
                continue
            kind, channel = status & 0xF0, status & 0x0F
            if kind in (0xC0, 0xD0):
                i += 1
                continue
            a, b, i = data[i], data[i + 1], i + 2
            if kind == 0x90 and b:
                sounding.setdefault((channel, a), []).append((tick, b))
            elif kind in (0x80, 0x90) and sounding.get((channel, a)):
                start, velocity = sounding[channel, a].pop(0)
                if channel != 9 or drums:
                    out.append((start / division, (tick - start) / division, a, velocity, track))
        i = end
    return sorted(out)


def parse_musicxml(data: bytes) -> list[tuple[int, int, int, str, int]]:
    """One row: measures, notes, rests, the time signatures in order, and syllables of lyrics (S-16)."""
    root = ET.fromstring(data)
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    notes = list(root.iter("note"))
    times = list(dict.fromkeys(f"{t.findtext('beats')}/{t.findtext('beat-type')}" for t in root.iter("time")))
    return [(len(list(root.iter("measure"))), sum(n.find("pitch") is not None for n in notes), sum(n.find("rest") is not None for n in notes), " ".join(times), sum(len(n.findall("lyric")) for n in notes))]


def parse_textgrid(data: bytes) -> list[tuple[str, float, float, str]]:
    """``(tier, start, end, text)`` of the interval tiers, long or short form (S-17)."""
    tokens = re.findall(r'"(?:[^"]|"")*"|[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?', re.sub(r"^.*?=\s*", "", re.sub(r"\b(?:item|intervals|points)\s*\[\d*\]:?", "", decode(data)), flags=re.M))
    out: list[tuple[str, float, float, str]] = []
    i = 0
    while i < len(tokens):
        if tokens[i] != '"IntervalTier"':
            i += 1
            continue
        name, count = tokens[i + 1][1:-1].replace('""', '"'), int(float(tokens[i + 4]))
        i += 5
        for _ in range(count):
            out.append((name, float(tokens[i]), float(tokens[i + 1]), tokens[i + 2][1:-1].replace('""', '"')))
            i += 3
    return out


_BLOCKS = ("p", "br", "div", "li", "tr", "h1", "h2", "h3")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.title, self.in_title = 0, "", False
        self.text: list[str] = []
        self.links: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.skip += tag in ("script", "style")
        self.in_title |= tag == "title"
        if tag == "a" and a.get("href"):
            self.links.append(("link", a["href"]))
        if tag in ("img", "audio", "video", "source") and a.get("src"):
            self.links.append(("image" if tag == "img" else "media", a["src"]))
        if tag in _BLOCKS:
            self.text.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        self.in_title &= tag != "title"
        if tag in _BLOCKS:
            self.text.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.text.append(data)


def parse_html(data: bytes) -> list[tuple[str, str]]:
    """``(kind, value)``: the title, the visible text with one line per block, links, images and media (S-22)."""
    p = _Page()
    p.feed(decode(data))
    lines = [re.sub(r"\s+", " ", x).strip() for x in "".join(p.text).split("\n")]
    return [("title", p.title.strip()), ("text", "\n".join(x for x in lines if x)), *p.links]


def parse_token_stream(data: bytes) -> list[tuple[str, int, float]]:
    """``(syllable, pitch, beats)`` of a text of tokens ``<lyric>``, ``<pN>``, ``<dN>`` (in sixteenths; S-26)."""
    out: list[tuple[str, int, float]] = []
    lyric, pitch = "", None
    for t in re.findall(r"<([^>]*)>", decode(data)):
        if m := re.fullmatch(r"p(\d+)", t):
            pitch = int(m[1])
        elif m := re.fullmatch(r"d(\d+)", t):
            if pitch is not None:
                out.append((lyric, pitch, int(m[1]) / 4))
            lyric, pitch = "", None
        else:
            lyric = t
    return out
