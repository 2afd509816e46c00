"""Secret scan with a recursive decoding worklist.

A text is the first layer. Each layer is searched for secrets; then what it holds in URL escapes, Unicode escapes and base64
(of text or of gzip, zlib, bzip2, xz or zstd data) is unwrapped into further layers, which join the worklist until nothing new
appears. Base64 may hold UTF-8, UTF-16 or Latin-1, may follow other signs of its alphabet (a path) and is also read across the lines that it is wrapped in. Compressed data, from base64 or from escapes, is inflated with all
its members, and again for as long as the output is itself compressed. A layer met before (same content from the same place) is not taken up again, so cycles end. Every layer
carries, for each of its characters, the range of the original text that it comes from; spans are reported in code points of the original,
end exclusive. Base64 of fewer than 12 characters isn't taken up. Escapes of escapes are unwrapped pass by pass, each a layer; what three passes leave is resolved to
its end in one run, in linear time, so nesting without end does no harm.

Defined results. A null text counts as empty and has no spans. Repeated rows give repeated results; an empty table an
empty table. Columns other than the id and the text are not read. What compressed data hold is searched to its end; past `most` bytes it
is inflated as a stream and searched in pieces of about that size, cut where no secret, escape or base64 can run across.
Data whose first member is damaged don't count as compressed; data that end early count as far as they go.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces
from .exact_dedup import ddl

# The kinds of secrets, in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex")
PATTERNS = (
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]{24,}"),
)
#: Least lengths: of the value that is assigned, of an access key.
LEAST_VALUE, LEAST_ACCESS = 6, 20

ESCAPE = re.compile(r"((?:%[0-9A-Fa-f]{2})+)|((?:\\x[0-9A-Fa-f]{2})+)|\\u\{([0-9A-Fa-f]{1,6})\}|((?:\\u[0-9A-Fa-f]{4})+)|\\U([0-9A-Fa-f]{8})|(&\#[0-9]{1,7};|&\#[xX][0-9A-Fa-f]{1,6};)|U\+([0-9A-Fa-f]{4,6})\b")
#: The same, or a plus sign, which takes no group.
FORM_ESCAPE = re.compile(rf"{ESCAPE.pattern}|\+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
#: What a token is cut at, if it isn't base64 as a whole.
BASE64_PART = re.compile(r"[A-Za-z0-9+/]{12,}={0,2}")
#: Base64 over several lines, each but the last of one length.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[ \t]*+\r?\n[ \t>]*+)+[A-Za-z0-9+/_-]++={0,2}")
WRAPPED_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Where compressed data may begin among characters that stand for bytes.
COMPRESSED = re.compile(r"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
BYTES = re.compile(r"[\x00-\xff]+")
#: Further escapes among bytes that are written as in source code.
PLAIN = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
BYTE_ESCAPE = {
    "url": re.compile(r"%([0-9A-Fa-f]{2})"),
    "form": re.compile(r"%([0-9A-Fa-f]{2})|(\+)"),
    "code": re.compile(r"""\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,2})\}|\\U000000([0-9A-Fa-f]{2})|\\([nrt0abfv\\'"/])"""),
    "entity": re.compile(r"(&\#[0-9]{1,3};|&\#[xX]0{0,4}[0-9A-Fa-f]{1,2};|&(?:amp|lt|gt|quot|apos);)"),
    "plus": re.compile(r"U\+00([0-9A-Fa-f]{2})\b\x20?"),
}
#: Where a long text may be cut: no pattern, escape or wrapped base64 runs across.
CUT = re.compile(rb"[^A-Za-z0-9+/_=\s-]\r?\n|\n\r?\n|[\x00-\x08\x0e-\x1f]")
MOST, STEP = 64 << 20, 1 << 20

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_layers", pa.int64()), ("decoded_spans", pa.string())])


def matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of a layer's own matches, leftmost and non-overlapping for each kind."""
    out = [(m.start(), 0, m.end()) for m in PATTERNS[0].finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in PATTERNS[1].finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in PATTERNS[2].finditer(text)]
    return sorted(out)


class Layer:
    """A decoded text; lo and hi: where each of its characters comes from in the original (None: it is the original)."""

    def __init__(self, text: str, lo: np.ndarray | None = None, hi: np.ndarray | None = None, how: str = "", whole: tuple[int, int] | None = None):
        """whole: one range that all characters come from (of inflated data), in place of lo and hi."""
        self.text, self.lo, self.hi, self.how, self.whole = text, lo, hi, how, whole

    def passes(self) -> int:
        """How many passes of escapes have led here since the text was something else; -1 if nothing is left for another."""
        steps = self.how.split(">")
        if steps[-1] == "escapes":
            return -1
        return next((k for k, x in enumerate(reversed(steps)) if x not in ("escape", "form")), len(steps))

    def decoded(self) -> bool:
        return self.lo is not None or self.whole is not None

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        return (start, end) if self.lo is None else (int(self.lo[start:end].min()), int(self.hi[start:end].max()))

    def within(self, text: str, lo: np.ndarray, hi: np.ndarray, how: str) -> Layer:
        """A layer whose characters come from the places lo to hi - 1 of this one."""
        if self.whole:
            return Layer(text, how=f"{self.how}>{how}", whole=self.whole)
        if self.lo is not None:
            lo, hi = self.lo[lo], self.hi[hi - 1]
        return Layer(text, lo.astype(np.int32), hi.astype(np.int32), f"{self.how}>{how}")

    def name(self) -> tuple:
        at = self.origin(0, len(self.text)) if self.text else (0, 0)
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), at


def _chars(raw: bytes) -> tuple[str, list[int]]:
    """Bytes as UTF-8, else Latin-1, and the number of bytes of each character."""
    try:
        text = raw.decode()
        return text, [len(c.encode()) for c in text]
    except UnicodeDecodeError:
        return raw.decode("latin-1"), [1] * len(raw)


def _unescape(m: re.Match) -> list[tuple[str, int, int]]:
    """(character, start, end) of an escape's decoded characters, offsets in the layer."""
    percent, hexes, braced, units, wide, entity, plus = m.groups()
    at = m.start()
    if percent or hexes:
        step = 3 if percent else 4
        text, sizes = _chars(bytes.fromhex((percent or hexes).replace("%", "").replace("\\x", "")))
        ends = np.cumsum(sizes, dtype=int) * step
        return [(c, at + int(e) - n * step, at + int(e)) for c, n, e in zip(text, sizes, ends, strict=True)]
    if units:
        text = bytes.fromhex(units.replace("\\u", "")).decode("utf-16-be", "replace")
        out, p = [], at
        for c in text:
            n = 12 if ord(c) > 0xFFFF else 6
            out.append((c, p, p + n))
            p += n
        return out
    if entity:
        return [(html.unescape(entity)[:1] or " ", at, m.end())]
    code = int(braced or wide or plus, 16)
    return [(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�", at, m.end())]


def unescaped(layer: Layer, form: bool = False) -> Layer | None:
    """The layer with its URL and Unicode escapes resolved, or None if it has none. form: and with spaces for plus signs, as in forms."""
    text = layer.text
    if form and not ("%" in text and "+" in text) or not ("%" in text or "\\" in text or "&#" in text or "U+" in text):
        return None
    parts, lo, hi, end = [], [], [], 0
    for m in (FORM_ESCAPE if form else ESCAPE).finditer(text):
        parts.append(text[end : m.start()])
        lo.append(np.arange(end, m.start()))
        hi.append(np.arange(end, m.start()) + 1)
        got = [(" ", m.start(), m.end())] if m.group() == "+" else _unescape(m)
        parts.append("".join(c for c, _, _ in got))
        lo.append(np.array([a for _, a, _ in got], int))
        hi.append(np.array([b for _, _, b in got], int))
        end = m.end()
    if not parts:
        return None
    parts.append(text[end:])
    lo, hi = (np.concatenate([*x, np.arange(end, len(text)) + k]) for x, k in ((lo, 0), (hi, 1)))
    return layer.within("".join(parts), lo, hi, "form" if form else "escape")


#: One escape that a text ends with, as ESCAPE has them, but for the byte that %XX and \\xXX stand for.
LAST_ESCAPE = re.compile(r"(?:%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|(&\#[0-9]{1,7};|&\#[xX][0-9A-Fa-f]{1,6};))\Z")
#: The same for U+; the signs that an escape can end with; its greatest length.
LAST_PLUS = re.compile(r"U\+([0-9A-Fa-f]{4,6})\Z")
ENDS, LONGEST = frozenset("0123456789abcdefABCDEF};"), 11
#: Where bytes that aren't characters by themselves are kept meanwhile: 0x80 to 0xFF from here on.
RAW = 0xF780
#: Passes of escapes that each make a layer of their own; what is nested deeper is resolved to the end in one.
PASSES = 3


def _of_code(digits: str) -> str:
    code = int(digits, 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def resolved(layer: Layer, form: bool = False) -> Layer:
    """The layer with its escapes resolved until none is left, in one run from the left: a character that comes out may complete or begin another escape. Each step makes the
    text shorter, so time grows with its length, however deep escapes are nested."""
    out: list[str] = []
    lo: list[int] = []
    hi: list[int] = []

    def fold(m: re.Match, new: str) -> None:
        n = m.end() - m.start()
        first, last = min(lo[-n:]), max(hi[-n:])
        del out[-n:], lo[-n:], hi[-n:]
        out.append(new)
        lo.append(first)
        hi.append(last)

    def settle() -> None:
        while out and out[-1] in ENDS and (m := LAST_ESCAPE.search("".join(out[-LONGEST:]))):
            byte, code = m[1] or m[2], m[3] or m[4] or m[5]
            if byte:
                fold(m, chr(int(byte, 16)) if int(byte, 16) < 0x80 else chr(RAW - 0x80 + int(byte, 16)))
            else:
                fold(m, _of_code(code) if code else html.unescape(m[6])[:1] or " ")

    text = layer.text.replace("+", " ") if form else layer.text
    for at, c in enumerate(text):
        # U+ takes as many digits as follow, so it ends where a word does.
        while out and not (c.isalnum() or c == "_") and out[-1] in ENDS and (m := LAST_PLUS.search("".join(out[-LONGEST:]))):
            fold(m, _of_code(m[1]))
            settle()
        out.append(c)
        lo.append(at)
        hi.append(at + 1)
        settle()
    while out and (m := LAST_PLUS.search("".join(out[-LONGEST:]))):
        fold(m, _of_code(m[1]))
        settle()
    # Runs of bytes beyond ASCII are characters of UTF-8, else of Latin-1.
    new, starts, ends, k = [], [], [], 0
    while k < len(out):
        j = k
        while j < len(out) and RAW <= ord(out[j]) < RAW + 0x80:
            j += 1
        if j == k:
            new.append(out[k])
            starts.append(lo[k])
            ends.append(hi[k])
            k += 1
            continue
        for c, n in zip(*_chars(bytes(ord(x) - RAW + 0x80 for x in out[k:j])), strict=True):
            new.append(c)
            starts.append(min(lo[k : k + n]))
            ends.append(max(hi[k : k + n]))
            k += n
    return layer.within("".join(new), np.array(starts, int), np.array(ends, int), "escapes")


def signature(raw: bytes) -> str | None:
    if raw[:2] == b"\x1f\x8b":
        return "gzip"
    if raw[:1] == b"\x78" and len(raw) > 2 and int.from_bytes(raw[:2], "big") % 31 == 0:
        return "zlib"
    return "bz2" if raw[:3] == b"BZh" else "xz" if raw[:6] == b"\xfd7zXZ\x00" else "zstd" if raw[:4] == b"\x28\xb5\x2f\xfd" else None


def _member(kind: str, raw: bytes, more: Iterator[bytes], rest: list[bytes]) -> Iterator[bytes]:
    """What the one member at the start of raw and more holds, in short pieces; what follows it goes to rest."""
    if kind in ("gzip", "zlib"):
        d = zlib.decompressobj(31 if kind == "gzip" else 15)
    elif kind == "zstd":
        import zstandard

        d = zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
    else:
        d = bz2.BZ2Decompressor() if kind == "bz2" else lzma.LZMADecompressor()
    while True:
        if kind in ("gzip", "zlib"):
            out = d.decompress(raw, STEP)
            raw = d.unconsumed_tail
        elif kind == "zstd":  # has no bound of the output; so much input holds 32 MiB at most
            out, left = d.decompress(raw[:1024]), raw[1024:]
            raw = left
        else:
            out, raw = d.decompress(raw, STEP), b""
        if out:
            yield out
        if d.eof:
            rest.append(d.unused_data + (raw if kind == "zstd" else b""))
            return
        if not raw and (kind == "zstd" or len(out) < STEP):
            if (raw := next(more, b"")) == b"":
                return


def members(chunks: Iterator[bytes], rest: list[bytes] | None = None) -> Iterator[bytes]:
    """What compressed data hold, all members in a row. Raises an error where the first is damaged. What follows the last one goes to rest."""
    raw, n, rest = b"", 0, [] if rest is None else rest
    while True:
        while len(raw := raw.lstrip(b"\0") if n else raw) < 6 and (new := next(chunks, b"")):
            raw += new
        if (kind := signature(raw)) is None:
            rest[:] = [raw]
            return
        after: list[bytes] = []
        try:
            yield from _member(kind, raw, chunks, after)
        except Exception:  # each library raises errors of its own for data that only look compressed
            if not n:
                raise
            rest[:] = [raw]
            return
        raw, n = b"".join(after), n + 1


def _filled(chunks: Iterator[bytes], most: int) -> tuple[bytes, bool]:
    """The chunks up to most bytes or a little more, and whether there are others."""
    parts, n = [], 0
    for x in chunks:
        parts.append(x)
        n += len(x)
        if n > most:
            return b"".join(parts), True
    return b"".join(parts), False


def cut(chunks: Iterator[bytes], most: int) -> Iterator[bytes]:
    """The chunks in pieces of about most bytes; a piece is longer where there is no place to cut."""
    held, limit = bytearray(), most
    for x in chunks:
        held += x
        if len(held) > limit:
            width, at = 1 << 16, 0
            while not at and width < 2 * len(held):
                at = max((m.end() for m in CUT.finditer(held, max(0, len(held) - width))), default=0)
                width *= 2
            if at:
                yield bytes(held[:at])
                del held[:at]
            limit = max(most, 2 * len(held))
    if held:
        yield bytes(held)


def inflated(raw: bytes, most: int) -> tuple[Iterator[bytes], int, int] | None:
    """What gzip, zlib, bzip2, xz or zstd data hold, inflated until it is no longer compressed, in pieces; how many times; the bytes of raw
    that were read. None for anything else."""
    source, head, n, used, seen = lambda: iter((raw,)), raw, 0, len(raw), set()
    while signature(head):
        if n:
            if (name := hashlib.sha256(head).digest()) in seen:
                break
            seen.add(name)
        rest: list[bytes] = []
        inner = lambda s=source, r=rest: members(s(), r)
        try:
            new, more = _filled(inner(), most)
        except Exception:  # only looks compressed
            break
        if not new:
            break
        if not n and not more:
            used -= len(b"".join(rest))
        source, head, n = inner if more else lambda x=new: iter((x,)), new, n + 1
    return (cut(source(), most), n, used) if n else None


CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")
#: Latin-1 has no characters here that texts use.
NO_LATIN = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f-\x9f]")


def _read(raw: bytes) -> tuple[str, list[int]] | None:
    """Bytes as text (UTF-8; UTF-16, if every second byte or so is 0; Latin-1) with the number of bytes of each character; None if they are no text."""
    if not CONTROL.search(raw):
        try:
            text = raw.decode()
            return text, [len(c.encode()) for c in text]
        except UnicodeDecodeError:
            return None if NO_LATIN.search(raw) else (raw.decode("latin-1"), [1] * len(raw))
    if len(raw) >= 8 and raw.count(0) * 5 >= len(raw) * 2:
        half = raw[: len(raw) & ~1]
        try:
            text = half.decode("utf-16-le" if half[1::2].count(0) >= half[::2].count(0) else "utf-16-be")
        except UnicodeDecodeError:
            return None
        if not CONTROL.search(text.encode()):
            return text, [4 if ord(c) > 0xFFFF else 2 for c in text]
    return None


def _pieces(layer: Layer, found: tuple[Iterator[bytes], int, int], start: int, end: int, how: str) -> Iterator[Layer]:
    """A layer for each piece of inflated data, every character of which comes from start to end of the layer."""
    a, b = layer.origin(start, end)
    try:
        for piece in found[0]:
            text = _chars(piece)[0] if len(piece) < STEP else _text(piece)
            yield Layer(text, how=f"{layer.how}>{how}{'>compressed' * found[1]}", whole=(a, b))
    except Exception:  # damaged past the first piece
        return


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _base64(layer: Layer, token: str, at: np.ndarray, most: int) -> Iterator[Layer]:
    """The layers that a token holds, whose characters are at these places: none if it is neither readable text nor compressed data."""
    bare = token.rstrip("=").translate({45: 43, 95: 47})
    bare = bare[:-1] if len(bare) % 4 == 1 else bare
    try:
        raw = base64.b64decode(bare + "=" * (-len(bare) % 4))
    except binascii.Error:
        return
    if (found := inflated(raw, most)) is not None:
        yield from _pieces(layer, found, int(at[0]), int(at[-1]) + 1, "base64")
    elif raw and (got := _read(raw)):
        yield _mapped(layer, *got, at, 0)


def _mapped(layer: Layer, text: str, sizes: list[int], at: np.ndarray, skipped: int) -> Layer:
    """The layer of decoded text, given the bytes of each character, the places of the base64 characters and the number of decoded bytes before the text."""
    ends = skipped + np.cumsum(sizes, dtype=int)
    return layer.within(text, at[(ends - np.array(sizes, int)) * 8 // 6], at[-(-ends * 8 // 6) - 1] + 1, "base64")


#: Base64 signs of the shortest secret that can be assigned ("token=" and six characters); out of step at least one stands before them.
LEAST_TOKEN = 16
#: Text among bytes that are otherwise none.
TEXT_RUN = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
#: Where compressed data may begin among bytes.
COMPRESSED_BYTES = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")


def _out_of_step(layer: Layer, token: str, start: int, most: int) -> Iterator[Layer]:
    """The layers of base64 that something of its own alphabet stands before (a path, a word): each of the four steps is tried, and runs of text and compressed data are
    taken from what comes out."""
    token = token.rstrip("=").translate({45: 43, 95: 47})
    for step in range(4):
        part = token[step:]
        part = part[:-1] if len(part) % 4 == 1 else part
        raw = base64.b64decode(part + "=" * (-len(part) % 4))
        at = np.arange(start + step, start + step + len(part))
        for m in TEXT_RUN.finditer(raw):
            yield _mapped(layer, m.group().decode(), [1] * (m.end() - m.start()), at, m.start())
        for m in COMPRESSED_BYTES.finditer(raw):
            if (step or m.start()) and (found := inflated(raw[m.start() :], most)) is not None:
                yield from _pieces(layer, found, int(at[m.start() * 8 // 6]), int(at[-1]) + 1, "base64")


def _any(layers: Iterator[Layer]) -> Iterator[Layer] | None:
    first = next(layers, None)
    return None if first is None else chain([first], layers)


def _wrapped(layer: Layer, most: int) -> Iterator[Layer]:
    """The layers of base64 over several lines: those of one length and a shorter last one, which may also be a word that follows."""
    for m in WRAPPED.finditer(layer.text):
        lines = [(x.group(), m.start() + x.start()) for x in WRAPPED_LINE.finditer(m.group())]
        i = 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and len(lines[j][0]) == len(lines[i][0]):
                j += 1
            ends = [j + 1] if j < len(lines) and len(lines[j][0]) < len(lines[i][0]) else []
            for end in [*ends, j]:
                if end > i + 1:
                    token, at = "".join(t for t, _ in lines[i:end]), np.concatenate([np.arange(p, p + len(t)) for t, p in lines[i:end]])
                    if got := _any(_base64(layer, token, at, most)):
                        yield from got
                        break
            i = j


def unwrapped(layer: Layer, most: int) -> Iterator[Layer]:
    """A layer for each base64 token that holds readable text or compressed data."""
    one = lambda m, start: _base64(layer, m.group(), np.arange(start + m.start(), start + m.end()), most)
    for m in BASE64.finditer(layer.text):
        got = one(m, 0)
        if first := next(got, None):
            yield first
            yield from got
            if first.text.isascii():
                continue
        else:
            for x in BASE64_PART.finditer(m.group()):
                if x.group() != m.group():
                    yield from one(x, m.start())
        # What came out, if anything, may be chance.
        if len(m.group()) > LEAST_TOKEN:
            yield from _out_of_step(layer, m.group(), m.start(), most)
    yield from _wrapped(layer, most)


def _byte(m: re.Match) -> str:
    """The byte that an escape stands for, as a character."""
    code = next(g for g in m.groups() if g is not None)
    if code[0] == "&":
        return html.unescape(code) if code[1] != "#" else chr(int(code[3:-1], 16) if code[2] in "xX" else int(code[2:-1]))
    if code == "+":
        return " "
    return PLAIN.get(code, code) if m.re is BYTE_ESCAPE["code"] and m.lastindex == 5 else chr(int(code, 16))


def escaped_data(layer: Layer, most: int) -> Iterator[Layer]:
    """The layers of compressed data whose bytes are written with escapes of one kind (beside bytes that are written as they are)."""
    text = layer.text
    for kind, mark in (("url", "%"), ("form", "%"), ("code", "\\"), ("entity", "&#"), ("plus", "U+")):
        if mark not in text or kind == "form" and "+" not in text:
            continue
        parts, ats, end = [], [], 0
        for m in BYTE_ESCAPE[kind].finditer(text):
            parts += [text[end : m.start()], _byte(m)]
            ats += [np.arange(end, m.start()), np.array([m.start()])]
            end = m.end()
        if not parts:
            continue
        at = np.concatenate([*ats, np.arange(end, len(text) + 1)])
        view, done = "".join([*parts, text[end:]]), 0
        for m in COMPRESSED.finditer(view):
            if m.start() < done:
                continue
            raw = BYTES.match(view, m.start()).group().encode("latin-1")
            if (found := inflated(raw, most)) is not None:
                done = m.start() + found[2]
                yield from _pieces(layer, found, int(at[m.start()]), int(at[done]), "escape")


def scan(text: str, most: int = MOST) -> tuple[list[tuple], dict[tuple, str], int]:
    """The base spans (start, kind, end); those that decoding adds, with how; the number of layers."""
    base, added, seen, work, n = matches(text), {}, set(), deque([Layer(text)]), 0
    have = set(base)
    while work:
        layer = work.popleft()
        if layer.decoded():
            if (name := layer.name()) in seen:
                continue
            seen.add(name)
            for start, kind, end in matches(layer.text):
                a, b = layer.origin(start, end)
                if (span := (a, kind, b)) not in have:
                    have.add(span)
                    added[span] = layer.how[1:]
        n += 1
        passes = layer.passes()
        for form in (False, True):
            if passes < 0 or (x := unescaped(layer, form)) is None:
                continue
            work.append(x if passes < PASSES else resolved(layer, form))
        if passes >= 0:
            work.extend(escaped_data(layer, most))
        work.extend(unwrapped(layer, most))
    return base, added, n


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers, decoded_spans (with the layers that led to each)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, added, n = scan(text, most)
                count = [sum(k == kind for _, kind, _ in base) for k in range(3)]
                out.append((doc, *count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted([*base, *added])), n, ",".join(f"{joined([s])}:{how}" for s, how in sorted(added.items()))))
            yield from pieces(SCHEMA, out)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return arrow_map(rows, f, ddl(SCHEMA))
