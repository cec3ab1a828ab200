"""Writers of single files: MIDI, MusicXML, kern, TextGrid, workbooks. Plain functions of one item's rows, for use in workers."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Sequence
from xml.sax.saxutils import escape, quoteattr

# Names of the twelve pitch classes and, in kern, the reciprocal lengths of whole multiples of a sixteenth.
STEPS = (("C", 0), ("C", 1), ("D", 0), ("D", 1), ("E", 0), ("F", 0), ("F", 1), ("G", 0), ("G", 1), ("A", 0), ("A", 1), ("B", 0))
KERN_LENGTHS = {1: "16", 2: "8", 3: "8.", 4: "4", 6: "4.", 7: "4..", 8: "2"}


def _varlen(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def midi_bytes(notes: Sequence[tuple[float, float, int]], division: int = 480) -> bytes:
    """A file of one track from (onset, length, pitch) in beats; on equal ticks notes end before others begin, and every note lasts a tick (K-11)."""
    events = []
    for on, length, pitch in notes:
        start = round(on * division)
        events += [(start, 1, int(pitch)), (max(start + 1, round((on + length) * division)), 0, int(pitch))]
    track, at = bytearray(), 0
    for tick, begins, pitch in sorted(events):
        track += _varlen(tick - at) + bytes((0x90 if begins else 0x80, pitch, 80 if begins else 0))
        at = tick
    track += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, division) + b"MTrk" + struct.pack(">I", len(track)) + bytes(track)


def musicxml_text(notes: Sequence[tuple[int | None, int]], meter: str, per_measure: int = 4) -> str:
    """A score of one part from (pitch or None for a rest, length in sixteenths), so many of them a measure (K-11)."""
    beats, unit = meter.split("/")
    out = ['<score-partwise version="3.1"><part-list><score-part id="P1"><part-name>voice</part-name></score-part></part-list><part id="P1">']
    for i in range(0, len(notes), per_measure):
        out.append(f'<measure number="{i // per_measure + 1}">')
        if not i:
            out.append(f"<attributes><divisions>4</divisions><time><beats>{beats}</beats><beat-type>{unit}</beat-type></time></attributes>")
        for pitch, length in notes[i : i + per_measure]:
            if pitch is None:
                sound = "<rest/>"
            else:
                step, alter = STEPS[pitch % 12]
                sound = f"<pitch><step>{step}</step>{'<alter>1</alter>' if alter else ''}<octave>{pitch // 12 - 1}</octave></pitch>"
            out.append(f"<note>{sound}<duration>{length}</duration></note>")
        out.append("</measure>")
    return "".join([*out, "</part></score-partwise>"])


def kern_text(notes: Sequence[tuple[int, int, int]], meters: Sequence[str] = ()) -> str:
    """A spine from (pitch, length in sixteenths, phrase); lengths without a name of their own are tied from two."""
    lines = ["**kern", *[f"*M{m}" for m in meters]]
    for i, (pitch, length, phrase) in enumerate(notes):
        first, last = i == 0 or notes[i - 1][2] != phrase, i == len(notes) - 1 or notes[i + 1][2] != phrase
        step, alter = STEPS[pitch % 12]
        octave = pitch // 12 - 1
        name = (step.lower() * (octave - 3) if octave >= 4 else step * (4 - octave)) + "#" * alter
        parts = [length] if length in KERN_LENGTHS else [length - length % 4, length % 4]
        for k, n in enumerate(parts):
            tie = "" if len(parts) == 1 else "[" if k == 0 else "]"
            opens, closes = "{" if first and k == 0 else "", "}" if last and k == len(parts) - 1 else ""
            lines.append(f"{opens}{tie if tie == '[' else ''}{KERN_LENGTHS[n]}{name}{tie if tie == ']' else ''}{closes}")
    return "\n".join([*lines, "*-"])


def textgrid_text(tiers: dict[str, Sequence[tuple[int, int, str]]]) -> str:
    """A TextGrid in its long form from (start, end, text) of each tier."""
    top = max((e for rows in tiers.values() for _, e, _ in rows), default=0)
    out = ['File type = "ooTextFile"', 'Object class = "TextGrid"', "", "xmin = 0", f"xmax = {top}", "tiers? <exists>", f"size = {len(tiers)}", "item []:"]
    quoted = lambda s: '"' + s.replace('"', '""') + '"'
    for i, (name, rows) in enumerate(tiers.items(), 1):
        out += [f"    item [{i}]:", '        class = "IntervalTier"', f"        name = {quoted(name)}", "        xmin = 0", f"        xmax = {top}", f"        intervals: size = {len(rows)}"]
        for j, (a, b, text) in enumerate(rows, 1):
            out += [f"        intervals [{j}]:", f"            xmin = {a}", f"            xmax = {b}", f"            text = {quoted(text)}"]
    return "\n".join(out) + "\n"


def _column(i: int) -> str:
    name = ""
    while i >= 0:
        name, i = chr(65 + i % 26) + name, i // 26 - 1
    return name


def xlsx_bytes(rows: Sequence[Sequence[object]], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet: numbers as numbers, texts inline, None as no cell."""
    main, rels = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row):
            at = f"{_column(c)}{r}"
            if isinstance(v, (int, float)):
                cells.append(f'<c r="{at}"><v>{v!r}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
        body.append(f'<row r="{r}">{"".join(cells)}</row>')
    types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    package = "http://schemas.openxmlformats.org/package/2006"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{types}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rels}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rels}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()
