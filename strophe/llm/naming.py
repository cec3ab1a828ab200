"""What a spelling says: parsers of songs, singers and uploading bodies, and when two spellings name one.

A parser gives a ``Form``: the part that must be equal (number of a cycle, kind of
body), the syllables of the name proper, and other names given beside it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from strophe.functions.text import MISSING_WORDS
from strophe.llm.readings import HAN, Readings, edits

DIGITS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


@dataclass(frozen=True)
class Lexicon:
    """What a field of knowledge says beside names. A parameter of the parsers; an empty one makes every word part of the name."""

    unknown: frozenset[str] = frozenset()  # words that stand for nobody and nothing
    genres: tuple[str, ...] = ()  # words for a kind of work, which alone (or behind a place) name none
    endings: tuple[str, ...] = ()  # words that may end a title and be left out
    endings_by_syllable: tuple[tuple[str, ...], ...] = ()  # the same in Latin spelling
    before: tuple[str, ...] = ()  # words that may stand before a title
    notes: tuple[str, ...] = ()  # notes behind a title
    roles: tuple[str, ...] = ()  # notes behind a person's name
    other_name: tuple[str, ...] = ()  # words that introduce another name
    suffixes: str = r"(?!)"  # pattern of what an account adds to a body's name
    kinds: tuple[tuple[str, tuple[str, ...]], ...] = ()  # kinds of bodies, each with its spellings


@dataclass
class Form:
    label: str  # spellings of one entity have equal labels
    parts: list[list[str]]  # syllables of each part of the name
    latin: bool
    aliases: list[list[str]] = field(default_factory=list)

    @property
    def syllables(self) -> list[str]:
        return [s for p in self.parts for s in p]

    @property
    def letters(self) -> str:
        return "".join(self.syllables)


def numeral(s: str) -> int | None:
    """A written number from 1 to 99."""
    if s.isdigit():
        return int(s)
    if s in DIGITS:
        return DIGITS[s]
    if len(s) == 2 and s[0] == "十" and s[1] in DIGITS:
        return 10 + DIGITS[s[1]]
    if len(s) in (2, 3) and s[1] == "十" and s[0] in DIGITS:
        return DIGITS[s[0]] * 10 + DIGITS.get(s[2:], 0)
    return None


_N = "([一二三四五六七八九十]{1,3}|[0-9]{1,2})"
_SONG_NUMBER = re.compile(rf"(?:其|之|第){_N}(?:首|段|曲)?$|(?:no\.?|#|nr\.?)\s*([0-9]{{1,2}})$|[(（\[]{_N}[)）\]]$|(?<=[a-z])\s*([0-9]{{1,2}})$")


def is_missing(v: str | None) -> bool:
    return v is None or v in MISSING_WORDS


def parse_song(v: str, r: Readings, lex: Lexicon = Lexicon()) -> Form | None:
    """A song's name; None where it names none (missing, unknown, a bare genre with or without a place, a key with #)."""
    if is_missing(v):
        return None
    s = r.fold(v)
    if not s or s in lex.unknown:
        return None
    s = re.sub(r"[《》〈〉<>\"“”「」『』]", "", s).strip()
    number = None
    while True:
        t = s
        m = _SONG_NUMBER.search(s)
        if m and numeral(next(g for g in m.groups() if g)) and m.start() > 1:
            number, s = numeral(next(g for g in m.groups() if g)), s[: m.start()]
        s = re.sub(r"[(（\[][^()（）\[\]]*[)）\]]\s*$", "", s).strip() or t
        for w in lex.notes:
            if s.endswith(w) and len(s) > len(w) + 2:
                s = s[: -len(w)]
        s = s.strip(" ·-_,;:.")
        if s == t:
            break
    if "#" in s:
        return None
    for g in lex.before:
        if s.startswith(g) and len(s) - len(g) >= 4:
            s = s[len(g) :]
    core = re.sub(r"[\s·\-_.,]", "", s)
    for g in lex.genres:
        if core.endswith(g.replace(" ", "")) and len(core) - len(g.replace(" ", "")) <= 2:
            return None
    body = s
    for e in lex.endings:
        if re.sub(r"[\s\-_]", "", body).endswith(e):
            # the ending may be spelt with spaces or marks between its letters
            cutn, k = len(e), len(body)
            while cutn:
                k -= 1
                cutn -= body[k] not in " -_"
            if len(r.to_syllables(body[:k])[0]) >= 4:
                body = body[:k]
            break
    syl, latin = r.to_syllables(body)
    for tail in lex.endings_by_syllable:
        if latin and body == s and len(syl) - len(tail) >= 4 and tuple(syl[-len(tail) :]) == tail:
            syl = syl[: -len(tail)]
            break
    if not syl or r.fold("".join(syl)) in lex.unknown:
        return None
    return Form("" if number is None else str(number), [syl], latin)


def parse_singer(v: str, r: Readings, lex: Lexicon = Lexicon()) -> Form | None:
    """A person's name and the other names given beside it; None where it names nobody."""
    if is_missing(v):
        return None
    s = r.fold(v)
    if not s or s in lex.unknown:
        return None
    aliases: list[str] = []

    def beside(m: re.Match) -> str:
        inner = m[1].strip(" \"'“”")
        for w in lex.other_name:
            if inner.startswith(w):
                inner = inner[len(w) :].strip(" :\"'“”")
        if inner and inner not in lex.roles:
            aliases.append(inner)
        return " "

    s = re.sub(r"[(\[]([^()\[\]]*)[)\]]", beside, s)
    m = re.search(rf"[,，;]?\s*(?:{'|'.join(map(re.escape, lex.other_name)) or '(?!)'})\s*[:：]?\s*(.+)$", s)
    if m and m.start() > 0:
        aliases.append(m[1].strip(" \"'“”"))
        s = s[: m.start()]
    s = s.strip(" ·,;:\"")
    for w in lex.roles:
        if s.endswith(w) and len(s) > len(w) + 1:
            s = s[: -len(w)].strip(" ·,;:")
    if s in lex.unknown:
        return None
    parts, latin = [], False
    for p in re.split(r"[·,，.]|\s+", s):
        syl, lat = r.to_syllables(p)
        if syl:
            parts.append(syl)
            latin |= lat
    if not parts:
        return None
    given = [x for a in aliases if (x := r.to_syllables(a)[0])]
    return Form("", parts, latin, given)


def parse_body(v: str, r: Readings, lex: Lexicon = Lexicon()) -> Form | None:
    """An uploading body: its kind and number must agree, its name may be spelt in variants."""
    if is_missing(v):
        return None
    s = r.fold(v)
    if not s or s in lex.unknown:
        return None
    s = re.sub(lex.suffixes, "", s).strip()
    number = ""
    m = re.search(rf"\bno\.?\s*([0-9]{{1,2}})|第{_N}", s)
    if m and (n := numeral(m[1] or m[2])):
        number, s = str(n), (s[: m.start()] + " " + s[m.end() :]).strip()
    kind = ""
    spellings = sorted(((w, k) for k, ws in lex.kinds for w in ws), key=lambda x: -len(x[0]))
    for w, k in spellings:
        at = re.search(rf"\b{w}\b", s) if w.isascii() else re.search(w, s)
        if at and s != w:
            kind, s = k, (s[: at.start()] + " " + s[at.end() :]).strip()
            break
    s = re.sub(r"^of\s+|\s+of$", "", s.strip(" ·-,")).strip(" ·-,")
    syl, latin = r.to_syllables(s)
    return Form(f"{kind}|{number}", [syl], latin) if syl else None


@dataclass(frozen=True)
class Rule:
    """When two forms of equal label name one entity."""

    syllable_edits: int = 0  # insertions, deletions and exchanges of whole syllables
    letter_edits: int = 1  # slips of the keyboard, where a spelling is in Latin letters
    turned: bool = True  # parts may stand in another order
    short_first: bool = False  # the first part may be cut to its first syllable or letter
    least: int = 4  # syllables from which slips are allowed
    letters: int = 4  # length of the letter n-grams by which forms are compared
    cosine: float = 0.2  # from which similarity on two forms are compared at all


def same_name(a: list[list[str]], a_latin: bool, b: list[list[str]], b_latin: bool, rule: Rule) -> float:
    """1 for equal readings, a little less for each edit, 0 for different names."""
    sa, sb = [s for p in a for s in p], [s for p in b for s in p]
    la, lb = "".join(sa), "".join(sb)
    if la == lb:
        return 1.0
    size = max(len(sa), len(sb))
    if min(len(sa), len(sb)) < rule.least and min(len(la), len(lb)) < 8:
        return 0.0
    orders = [sb]
    if rule.turned:
        if len(b) > 1:
            orders += [[s for p in b[k:] + b[:k] for s in p] for k in range(1, len(b))]
        elif len(a) == 1:
            orders += [sb[k:] + sb[:k] for k in range(2, len(sb) - 1)]
        if len(b) == 1 and len(a) > 1:
            orders += [sb[k:] + sb[:k] for k in range(1, len(sb))]
    best = 0.0
    for o in orders:
        lo = "".join(o)
        if lo == la:
            return 1.0
        if (a_latin or b_latin) and edits(la, lo, rule.letter_edits) <= rule.letter_edits:
            best = max(best, 1 - 1 / max(len(la), len(lo)))
        elif rule.syllable_edits:
            most = min(rule.syllable_edits, (size - 2) // 2)
            d = edits(sa, o, most, substitute=False)
            if d <= most:
                best = max(best, 1 - d / size)
    return best


def is_short_of(a: list[list[str]], b: list[list[str]]) -> bool:
    """True if a is b with one part cut to its first syllable or letter (parts in either order)."""
    if len(a) != 2 or len(b) != 2:
        return False
    for x in (a, a[::-1]):
        for y in (b, b[::-1]):
            p, q = "".join(x[0]), "".join(y[0])
            if "".join(x[1]) == "".join(y[1]) and p != q and len(y[0]) > 1 and len("".join(x[1])) >= 4 and (p == q[:1] or p == y[0][0]):
                return True
    return False
