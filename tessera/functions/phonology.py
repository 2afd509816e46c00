"""Phonological rules on IAST text. Each producer reads the original text and gives edits; none changes it.

Texts without annotations go by compiled patterns; others are scanned once for the neighbours of every position. So each producer is linear. Positions count code points from 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

PART = "struct<text:string,superscript:boolean,change:boolean,svara:boolean>"
EDITS = f"array<struct<idx:int,del:int,parts:array<{PART}>,changed:boolean>>"
HOLDINGS = "array<struct<position:int,length:int,type:string>>"
CLUSTERS = "array<struct<position:int,consonants:int,held:int,length:int>>"
PAUSES = "array<struct<position:int,type:string>>"

_ASPIRATES = frozenset(C.ASPIRATES)
_CONSONANTS, _WS, _SVARA = frozenset(C.CONSONANTS), frozenset(C.PY_WS), frozenset(C.SVARA)
_V = f"(?:{'|'.join(sorted(C.VOWELS, key=len, reverse=True))})"
_S = f"[{C.SVARA}]*"
#: A pause's place: after oṁ and a space, or between two vowels with a space (and marks) between.
_PAUSE = re.compile(f"oṁ |({_V}){_S} {_S}(?=({_V}))")
_ANY = f"(?>{'|'.join(C.ASPIRATES)}|[{''.join(c for c in C.CONSONANTS if len(c) == 1)}])"
#: A cluster, and its consonants with the white space and marks before each, in a text without annotations.
_CLUSTER = re.compile(f"{_ANY}(?:[{re.escape(C.PY_WS)}\u0300-\u036f{C.SVARA}]*+{_ANY})+")
_MEMBER = re.compile(f"([{re.escape(C.PY_WS)}\u0300-\u036f{C.SVARA}]*+)({_ANY})")
_NO_DOT = C.SVARA.replace(C.DOT, "")
#: r, its marks, and then, past what isn't a letter, one that the dot stands before; in a text without annotations.
_RHOTIC = re.compile(f"r[\u0300-\u036f{_NO_DOT}]*+(?=[{re.escape(C.PY_WS)}\u0300-\u036f{_NO_DOT}\u200b-\u200d]*+[{''.join(C.SVARABHAKTI_BEFORE)}])")
#: Code points up to here are looked up in tables.
_TABLE = 0x2000
_IS_VOWEL, _IS_LONG = (np.array([chr(c) in {v for v in vowels if len(v) == 1} for c in range(_TABLE)]) for vowels in (C.VOWELS, C.LONG_VOWELS))
_ZERO_WIDTH = frozenset("\u200b\u200c\u200d\ufeff")


def part(text: str, superscript: bool = False, change: bool = True, svara: bool = False) -> tuple:
    return text, superscript, change, svara


def consonant_at(text: str, i: int) -> str:
    """The consonant that starts at i, the longer one first; empty if none."""
    two = text[i : i + 2]
    return two if two in _ASPIRATES else two[:1] if two[:1] in _CONSONANTS else ""


def is_mark(c: str) -> bool:
    return "\u0300" <= c <= "\u036f"


#: What the rule for anusvara looks at: a nasalised m, or the sign itself.
_NASAL = re.compile(f"m{C.CANDRABINDU}|[ṁṃ]")


class Scan:
    """What stands around each position of a text."""

    def __init__(self, text: str):
        self.text, n = text, len(text)
        self.annotation, self.superscript = bytearray(n), bytearray(n)
        at = text.find("m" + C.CANDRABINDU)
        while at >= 0:
            for k, c in enumerate(("m", C.CANDRABINDU, "g", "ṁ")):
                if text[at + k : at + k + 1] != c:
                    break
                self.annotation[at + k] = True
                self.superscript[at + k] = c != C.CANDRABINDU
            at = text.find("m" + C.CANDRABINDU, at + 1)
        at = text.find(C.CANDRABINDU)
        while at >= 0:
            self.annotation[at] = True
            at = text.find(C.CANDRABINDU, at + 1)

    def letter(self, i: int) -> bool:
        c = self.text[i]
        return not (c in _WS or is_mark(c) or c in _SVARA or self.annotation[i])

    def following(self, i: int, count: int = 1) -> list[int]:
        """The places of the next letters after i; looked for from there, so that a rule pays for the places it looks at."""
        out, k = [], i + 1
        while k < len(self.text) and len(out) < count:
            if self.letter(k) and self.text[k] not in _ZERO_WIDTH:
                out.append(k)
            k += 1
        return out

    def next(self, i: int) -> str:
        return "".join(self.text[k] for k in self.following(i))

    def previous(self, i: int) -> str:
        k = i - 1
        while k >= 0 and not self.letter(k):
            k -= 1
        return self.text[k] if k >= 0 else ""

    def is_gap(self, i: int) -> bool:
        """Marks and annotations, which clusters run across."""
        return self.text[i] in _SVARA or is_mark(self.text[i]) or self.annotation[i]


def svarabhakti(text: str) -> list[tuple]:
    """A dot after r and its marks, where the next letter is a sibilant, h or vocalic r and no dot stands between."""
    return [(k, 0, [part(C.DOT, svara=True)], True) for k in svarabhakti_places(text)]


def svarabhakti_places(text: str) -> list[int]:
    if C.CANDRABINDU not in text:
        return [m.end() for m in _RHOTIC.finditer(text)]
    s, out = Scan(text), []
    for i, c in enumerate(text[:-1]):
        if c == "r" and (after := s.following(i)) and text[after[0]] in C.SVARABHAKTI_BEFORE and C.DOT not in text[i : after[0]]:
            k = i + 1
            while k < len(text) and (is_mark(text[k]) or text[k] in _SVARA):
                k += 1
            out.append(k)
    return out


def pauses(text: str) -> list[tuple[int, str]]:
    """(position, type) of pauses: after oṁ and a space, and between a word's last and the next one's first vowel (long: a long before a short one)."""
    return [(m.end(), "long" if m[1] in C.LONG_VOWELS and m[2] in C.SHORT_VOWELS else "short") for m in _PAUSE.finditer(text)]


def cluster(s: Scan, i: int) -> tuple[list[tuple[str, int, bool]], int]:
    """Consonants (value, position, after white space) that run from i across marks and white space, and where to go on."""
    text, out, n, gap = s.text, [], len(s.text), False
    while i < n:
        if s.annotation[i]:
            i += 1
            continue
        value = consonant_at(text, i)
        if not value:
            break
        out.append((value, i, gap))
        i += len(value)
        while i < n and s.is_gap(i):
            i += 1
        k, gap = i, False
        while k < n and text[k] != "|" and (text[k] in _WS or s.is_gap(k)):
            gap |= text[k] in _WS
            k += 1
        if text[k : k + 1] == "|":
            return out, i
        i = k
    return out, i


def held(parts: list[tuple[str, int, bool]]) -> int:
    """Which consonant of a cluster is held: the first of a doubled pair; else, from the second word on (or the start), the first that can be."""
    for k in range(len(parts) - 1):
        if parts[k][0] == parts[k + 1][0]:
            return k
    start = next((k for k, p in enumerate(parts) if p[2]), 0)
    able = (k for k in range(start, len(parts)) if parts[k][0] not in C.NO_HOLDING or parts[k][2] and parts[k][0] in C.SIBILANTS)
    return next(able, len(parts) - 1)


class Held(dict):
    """A cluster as written -> (its number of consonants, offset of the one that is held, its length); emptied when it has grown to 50,000 clusters."""

    def __missing__(self, text: str) -> tuple[int, int, int]:
        if len(self) >= 50_000:
            self.clear()
        parts = [(m[2], m.start(2), any(c in _WS for c in m[1])) for m in _MEMBER.finditer(text)]
        value, at, _ = parts[held(parts)]
        self[text] = out = (len(parts), at, len(value))
        return out


_held = Held()


def clusters(text: str) -> list[tuple[int, int, int, int]]:
    """(start, number of consonants, position of the one that is held, its length) for each cluster of two consonants or more."""
    if C.CANDRABINDU not in text:
        found = [(m.start(), _held[m.group()]) for m in _CLUSTER.finditer(text)]
        return [(i, n, i + at, size) for i, (n, at, size) in found]
    s, out, i = Scan(text), [], 0
    while i < len(text):
        value = "" if s.annotation[i] or text[i] == "|" else consonant_at(text, i)
        if not value:
            i += 1
            continue
        parts, end = cluster(s, i)
        if len(parts) < 2:
            i += len(value)
            continue
        target, at, _ = parts[held(parts)]
        out.append((i, len(parts), at, len(target)))
        i = end
    return out


def long_before(text: str, at: np.ndarray, diphthong_long: bool = False) -> np.ndarray:
    """Whether the last vowel before each of the places is long. Of a diphthong that is its second letter, unless diphthong_long."""
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _TABLE - 1)
    vowels = np.flatnonzero(_IS_VOWEL[codes])
    k = np.searchsorted(vowels, at) - 1
    last = vowels[np.maximum(k, 0)] if len(vowels) else np.zeros(len(at), int)
    out = _IS_LONG[codes[last]] if len(codes) else np.zeros(len(at), bool)
    if diphthong_long:
        out = out | (last > 0) & (codes[np.maximum(last - 1, 0)] == ord("a")) & np.isin(codes[last], (ord("i"), ord("u")))
    return out & (k >= 0)


def holdings(text: str, diphthong_long: bool = False) -> list[tuple[int, int, str]]:
    """(position, length, type) for each cluster of two consonants or more."""
    found = clusters(text)
    long = long_before(text, np.array([c[2] for c in found], int), diphthong_long) if found else ()
    return [(at, size, "long" if x else "short") for (_, _, at, size), x in zip(found, long, strict=True)]


def _yajurveda(s: Scan, i: int) -> list[tuple]:
    after = s.following(i, 3)
    letters = "".join(s.text[k] for k in after)
    first = letters[:1]
    if letters == "ghn" or letters[:2] == "jñ":
        return [part("ṁ")]
    if first and first in C.BEFORE_G_FORMS:
        out = [part("m"), part(C.CANDRABINDU), part("g", True)]
        if letters[1:2] not in C.NON_VOWELS:
            return [*out, part("ṁ", True)]
        return [*out, part("g", True)] if s.previous(i) in ("a", "i", "u") else out
    if first and first in "vly":
        return [part("ṁ"), part({"v": "u", "l": "l", "y": "i"}[first], True)]
    pair = s.text[after[0] : after[0] + 2] if after else ""
    return [part(next((nasal for nasal, group in C.NASAL_OF.items() if first in group or pair in group or first == nasal), "ṁ"))]


def anusvara(text: str, source: str | None, skip_bija: bool = True) -> list[tuple]:
    """Edits of anusvara by tradition: yajurveda and kṛṣṇayajurveda, rigveda, or any other (restyled only)."""
    s, out = Scan(text), []
    for m in _NASAL.finditer(text):
        i, c = m.start(), m.group()
        if len(c) > 1:
            if source == "rigveda" and s.next(i + 1) in C.BEFORE_G_FORMS and s.next(i + 1):
                out.append((i, 2, [part("m"), part(C.CANDRABINDU)], True))
            continue
        if s.superscript[i]:
            continue
        if skip_bija and text[text.rfind("\n", 0, i) + 1 : i + 1].strip(C.PY_WS).lower() in C.BIJA:
            continue
        if source in ("yajurveda", "kṛṣṇayajurveda"):
            parts = _yajurveda(s, i)
        elif source == "rigveda":
            sign = {"v": "u", "l": "l", "y": "i"}.get(s.next(i))
            parts = [part(c), *([part(sign, True)] if sign else [])]
        else:
            parts = [part("ṁ")]
        out.append((i, 1, parts, True))
    return out


def visarga(text: str) -> list[tuple]:
    """Edits of visarga by what follows; where no rule applies, an edit without parts."""
    s, out = Scan(text), []
    for i in (m.start() for m in re.finditer("ḥ", text)):
        letters, prev = "".join(text[k] for k in s.following(i, 2)), s.previous(i)
        first, parts = letters[:1], []
        if first == "p":
            parts = [part("ḥ"), part("f", True)]
        elif first and first in C.SIBILANTS:
            parts = [part(first)]
        elif first and (first in C.VOICED or first in C.VOWELS) and prev not in ("a", "ā"):
            parts = [part("r")]
        elif letters == "kṣ":
            parts = [part("ḥ:"), *([part(prev, True)] if prev else [])]
        elif by := next((r for r, lead in C.VISARGA_BEFORE.items() if first == lead), ""):
            parts = [part(by)]
        out.append((i, 1, parts, bool(parts)))
    return out


def insertions(text: str, pair: str, letter: str) -> list[tuple[int, str]]:
    """(position, text): letter goes between the two of each pair."""
    out, at = [], text.find(pair)
    while at >= 0:
        out.append((at + 1, letter))
        at = text.find(pair, at + len(pair))
    return out


def _lists(texts: pa.Array, found: list[list], build: Callable[[list], pa.Array]) -> pa.Array:
    """An array of lists: those of `found`, whose items `build` makes an array of; null where the text is."""
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    offsets = pa.array(ends, mask=np.append(np.array(texts.is_null()), False)) if texts.null_count else pa.array(ends)
    return pa.ListArray.from_arrays(offsets, build([x for rows in found for x in rows]))


def _structs(names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> Callable[[list], pa.Array]:
    def f(rows: list[tuple]) -> pa.Array:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return f


_part = _structs(("text", "superscript", "change", "svara"), (pa.string(), pa.bool_(), pa.bool_(), pa.bool_()))
_pause = _structs(("position", "type"), (pa.int32(), pa.string()))
_holding = _structs(("position", "length", "type"), (pa.int32(), pa.int32(), pa.string()))
_cluster = _structs(("position", "consonants", "held", "length"), (pa.int32(),) * 4)


def _edit(rows: list[tuple]) -> pa.Array:
    parts = [r[2] for r in rows]
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)], dtype=np.int32)), _part([p for ps in parts for p in ps]))
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), lists, pa.array([r[3] for r in rows], pa.bool_())], ("idx", "del", "parts", "changed"))


def _column(kind: str, build: Callable[[list], pa.Array], produce: Callable, *columns: Column) -> Column:
    """A function over Arrow batches of texts (and of a second column, if given); null gives null."""
    if len(columns) == 1:

        def one(text: pa.Array) -> pa.Array:
            return _lists(text, [[] if t is None else produce(t) for t in text.to_pylist()], build)

        return F.arrow_udf(one, kind)(*columns)

    def two(text: pa.Array, other: pa.Array) -> pa.Array:
        return _lists(text, [[] if t is None else produce(t, o) for t, o in zip(text.to_pylist(), other.to_pylist(), strict=True)], build)

    return F.arrow_udf(two, kind)(*columns)


def svarabhakti_edits(text: Column) -> Column:
    return _column(EDITS, _edit, svarabhakti, text)


def svarabhakti_positions(text: Column) -> Column:
    """The places of the dots alone."""
    return _column("array<int>", lambda rows: pa.array(rows, pa.int32()), svarabhakti_places, text)


def visarga_edits(text: Column) -> Column:
    return _column(EDITS, _edit, visarga, text)


def anusvara_edits(text: Column, source: Column, skip_bija: bool = True) -> Column:
    return _column(EDITS, _edit, lambda t, s: anusvara(t, s, skip_bija), text, source)


def pauses_of(text: Column) -> Column:
    return _column(PAUSES, _pause, pauses, text)


def holdings_of(text: Column, diphthong_long: bool = False) -> Column:
    return _column(HOLDINGS, _holding, lambda t: holdings(t, diphthong_long), text)


def clusters_of(text: Column) -> Column:
    """Each cluster: its position, its number of consonants, which place is held, and that consonant's length."""
    return _column(CLUSTERS, _cluster, clusters, text)


def rewritten(text: str, edits: list[tuple]) -> str:
    """The text with its edits (place, length, parts, changed) done: it is cut at them once."""
    out, end = [], 0
    for at, size, parts, changed in sorted(edits, key=lambda e: e[:2]):
        if changed:
            out += [text[end:at], *(p[0] for p in parts)]
            end = max(end, at + size)
    return "".join([*out, text[end:]])


def _texts(rule: Callable[..., list[tuple]], *columns: Column) -> Column:
    """The texts of the first column as a rule's edits leave them, over Arrow batches; null gives null."""
    if len(columns) == 1:

        def one(text: pa.Array) -> pa.Array:
            return pa.array([None if t is None else rewritten(t, rule(t)) for t in text.to_pylist()], pa.string())

        return F.arrow_udf(one, "string")(*columns)

    def two(text: pa.Array, other: pa.Array) -> pa.Array:
        return pa.array([None if t is None else rewritten(t, rule(t, o)) for t, o in zip(text.to_pylist(), other.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(two, "string")(*columns)


def svarabhakti_applied(text: Column) -> Column:
    return _texts(svarabhakti, text)


def anusvara_applied(text: Column, source: Column, skip_bija: bool = True) -> Column:
    return _texts(lambda t, s: anusvara(t, s, skip_bija), text, source)


def visarga_applied(text: Column) -> Column:
    return _texts(visarga, text)


def apply_edits(text: Column, edits: Column) -> Column:
    """The text with its edits done, in built-in functions: the characters are cut at the edits once, so time grows with the text and the edits. An edit without parts
    leaves the text alone; of edits that overlap the later one goes on where the earlier ends."""
    joined = lambda e: F.array_join(F.transform(e["parts"], lambda p: p["text"]), "")

    def done(s: Column) -> Column:
        chars, order = s["chars"], s["edits"]
        end = lambda e: e["idx"] + e["del"]
        upto = lambda i: F.coalesce(F.get(order, i)["idx"], F.size(chars))
        between = lambda start, stop: F.array_join(F.slice(chars, start + 1, F.greatest(F.lit(0), stop - start)), "")
        return F.concat(between(F.lit(0), upto(F.lit(0))), F.array_join(F.transform(order, lambda e, i: F.concat(joined(e), between(end(e), upto(i + 1)))), ""))

    # Bound by lambdas, so that text and edits stand here once, and the characters and the order are made once.
    def whole(s: Column) -> Column:
        order = F.array_sort(F.filter(s["edits"], lambda e: e["changed"]))
        cut = F.transform(F.array(F.struct(F.split(s["text"], "").alias("chars"), order.alias("edits"))), done)
        return F.when(F.exists(s["edits"], lambda e: e["changed"]), F.get(cut, F.lit(0))).otherwise(s["text"])

    return F.get(F.transform(F.array(F.struct(text.alias("text"), edits.alias("edits"))), whole), F.lit(0))
