"""Removal of long repeats by prefix-free parsing.

Positions whose rolling hash is the smallest of `WINDOW` in a row are triggers; they cut every text into phrases, in the same way
wherever the same text stands. A stretch of `LENGTH` bytes is assigned to the trigger that is its own smallest, so equal
stretches lie equally around equal triggers. From this:

1. The dictionary of what follows triggers (the bytes that every stretch assigned to one must hold) is counted over the corpus; a trigger whose
   context is unique has no repeated stretch.
2. The parse: for each other trigger the span of all its stretches is one string, counted as such; if it is found again, so
   is each of its stretches.
3. Where a context has different spans and one of them is unique (at the edges of repeated regions), these are compared in blocks of a few
   stretches, each different span being taken once; and where blocks with the same core (what all their stretches hold) differ likewise,
   stretch by stretch.
4. The repeated stretches of a document, in order, give the runs of bytes to remove.

A suffix array of the whole corpus would be one sequential structure. The question asked of it (which stretches of a fixed length have
an equal neighbour in corpus order) depends only on equality at that length, so phrases and stretches are ordered by 96-bit hashes in
the shuffle instead of by suffix rank: equal ones meet in one sorted group. In each task equal strings are first combined: what
occurs twice there is settled on the spot and sent on once, so a string found in a third of all documents costs one row per batch and task.

Defined results. A null text counts as empty. Texts under LENGTH bytes lose nothing. Repeated rows are occurrences of each other, so
such texts of LENGTH bytes or more are removed in whole. An empty table gives an empty table. Columns other than the id and the text
are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, broadcast_if_small, keyed, materialize, same_row
from .exact_dedup import ddl

LENGTH, WINDOW, GRAM = 200, 128, 12
#: Bytes after a trigger that each stretch assigned to it holds.
CONTEXT = LENGTH - WINDOW + 1
#: Rows are combined in each task in batches of this many.
COMBINE = 200_000
#: Spans whose stretches must be told apart are compared in blocks of this many first.
BLOCK = 8

_rng = np.random.default_rng(5)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE2 = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 2**64)

#: h1, h2: a string's hash. n: 1, or 2 if it is known to occur twice, or 3 if the row is settled and goes under a name of its own. place: see pack().
#: x: what the strings of one context have in common.
ROW = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("n", pa.int32()), ("id", pa.int64()), ("th", pa.int64()), ("place", pa.int64()), ("x", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.string())])


class Hashes:
    """Hashes of any stretch of a text from two running sums of byte values times powers of an odd number, mod 2**64."""

    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        self.n = n = len(raw)
        cls = Hashes
        while len(cls.powers) <= n:
            m = len(cls.powers)
            cls.powers = np.concatenate([cls.powers, cls.powers * np.uint64(pow(_P, m, 2**64))])
            cls.inverse = np.concatenate([cls.inverse, cls.inverse * np.uint64(pow(_INV, m, 2**64))])
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[raw] * cls.powers[:n], dtype=np.uint64)]) for table in (_BYTE, _BYTE2)]

    def of(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        h = (self.sums[which][end] - self.sums[which][start]) * Hashes.inverse[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def triggers(h: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, lo, hi): the stretches that start at lo, ..., hi - 1 have that trigger. All of a text's stretches, in order."""
    last = h.n - LENGTH + 1
    if last <= 0:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(last + WINDOW - 1)
    # The first of equal hashes is the smallest.
    low = (h.of(at, at + GRAM) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    own = (low[:last] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lo = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
    return own[lo], lo, np.append(lo[1:], last)


def pack(lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The stretches that start at lo, ..., hi - 1 around the trigger `at`, as one number."""
    return lo << 20 | (hi - lo) << 10 | (at - lo)


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = place >> 20
    return lo, lo + (place >> 10 & 1023), lo + (place & 1023)


class Combiner:
    """Rows (h1, h2, id, th, place, x, n), given out with equal strings combined.

    What occurs twice among them is settled: its rows go on under names of their own with n = 3, and one row with n = 2, at the first
    of the places, stands for the string.
    """

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, hashes: tuple[np.ndarray, np.ndarray], i: int | None, th: int, place: np.ndarray, x: np.ndarray | int = 0, n: np.ndarray | int = 1) -> None:
        m = len(place)
        if m:
            self.parts.append((*hashes, np.full(m, 0 if i is None else i), np.full(m, i is None), np.full(m, th), place, np.zeros(m, np.int64) + x, np.zeros(m, np.int64) + n))
            self.size += m

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts, self.size = [], 0
        order = np.lexsort((columns[1], columns[0]))
        h1, h2, i, none, th, place, x, n = (c[order] for c in columns)
        first = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        many = np.add.reduceat(n, first) > 1
        own = np.repeat(many, np.diff(np.append(first, len(h1))))
        h1, h2 = h1.view(np.int64), h2.view(np.int32)
        yield from self._rows(np.where(own, _name(i, th, place), h1), np.where(own, 1, h2), np.where(own, 3, 1), i, none, th, place, x)
        t = first[many]
        yield from self._rows(h1[t], h2[t], np.full(len(t), 2), i[t], none[t], th[t], place[t], x[t])

    @staticmethod
    def _rows(h1: np.ndarray, h2: np.ndarray, n: np.ndarray, i: np.ndarray, none: np.ndarray, th: np.ndarray, place: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        cols = [pa.array(h1, pa.int64()), *(pa.array(c.astype(np.int32)) for c in (h2, n)), pa.array(i, pa.int64(), mask=none), *(pa.array(c, pa.int64()) for c in (th, place, x))]
        for k in range(0, len(h1), 20_000):
            yield pa.RecordBatch.from_arrays([c.slice(k, 20_000) for c in cols], schema=ROW)


def _name(i: np.ndarray, th: np.ndarray, place: np.ndarray) -> np.ndarray:
    x = (i.astype(np.int64).view(np.uint64) * np.uint64(_P) ^ th.astype(np.int64).view(np.uint64)) * np.uint64(_P) + place.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(33))).view(np.int64)


def _two(h: Hashes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h.of(start, end), (h.of(start, end, 1) >> np.uint64(32)).astype(np.uint32)


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, th, text): the context of each trigger."""
    found = Combiner()
    for batch in batches:
        for i, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h = Hashes(text.encode())
            at, lo, hi = triggers(h)
            found.add(_two(h, at, at + CONTEXT), i, th, pack(lo, hi, at))
            if found.size >= COMBINE:
                yield from found.out()
    yield from found.out()


def _parse(step: int) -> Callable:
    """Rows (id, th, text, places): each place's string, or that of each block of `step` of its stretches, counted from the trigger. x: what every stretch of the place, or block, holds."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Combiner()
        for batch in batches:
            for i, th, text, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, held = Hashes(text.encode()), _places(raw)
                again, (lo, hi, at) = held & 1, unpack(held >> 1)
                n = hi - lo
                start = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                place = np.repeat(np.arange(len(n)), n)
                block = (at[place] - start) // step
                first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (block[1:] != block[:-1])]))
                a, b = start[first], np.append(start[first[1:] - 1], start[-1]) + 1
                place, block = place[first], block[first]
                # What all stretches of a whole block hold, also where the block is cut off by its place.
                last = at[place] - block * step
                x = h.of(last, np.maximum(last - step + 1 + LENGTH, at[place] + CONTEXT) if step > WINDOW else last - step + 1 + LENGTH).view(np.int64)
                found.add(_two(h, a, b - 1 + LENGTH), i, th, pack(a, b, at[place]), x if step > 1 else 0, 1 + again[place])
                if found.size >= COMBINE:
                    yield from found.out()
        yield from found.out()

    return f


def _places(raw: bytes | None) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), "<i8")) if raw else np.zeros(0, np.int64)


def _counted(rows: DataFrame) -> DataFrame:
    """rows with `again`: whether the string occurs elsewhere too, and `rank` among the rows of its string."""
    return rows.withColumn("again", F.expr("sum(n) OVER (PARTITION BY h1, h2) > 1")).withColumn("rank", F.expr("row_number() OVER (PARTITION BY h1, h2 ORDER BY id, th, place)"))


def _open(strings: DataFrame) -> DataFrame:
    """Of contexts with different strings, one of them unique: each different string once, at one of its places, and whether it is repeated."""
    each = strings.filter("rank = 1 AND n < 3").select("id", "th", "place", "x", F.col("again").cast("bigint").alias("again"))
    contexts = each.groupBy("x").agg(F.count("*").alias("strings"), F.min("again").alias("least")).filter("strings > 1 AND least = 0").select("x")
    return each.join(contexts, "x").select("id", "th", "place", "again")


PACK = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("places", pa.binary())])


def _packed(places: DataFrame) -> DataFrame:
    """(id, th, places): the places of each document with their mark, in order, as compressed differences."""
    listed = places.groupBy("id", "th").agg(F.collect_set(F.shiftleft("place", 1) + F.col("again")).alias("p"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, ends = np.array(lists.flatten(), np.int64), np.cumsum(np.array(lists.value_lengths()))
            coded = [zlib.compress(np.diff(np.sort(flat[a:b]), prepend=0).astype("<i8").tobytes(), 6) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(coded, pa.binary())], schema=PACK)

    return materialize(arrow_map(listed, f, ddl(PACK)), "places")


def _at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """rows with the places of their documents; a row without any is left out."""
    small = broadcast_if_small(places, F.length("places") + 32)
    return rows.join(small, same_row(rows, small)).select(rows["id"], rows["th"], "text", "places")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, text, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data, runs = text.encode(), []
            lo, hi, _ = unpack(_places(raw) >> 1)
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b - 1 + LENGTH)
                else:
                    runs.append([a, b - 1 + LENGTH])
            kept = b"".join(data[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(data)], strict=True))
            out.append((i, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), ",".join(f"{a}:{b}" for a, b in runs)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(RESULT)], schema=RESULT)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, place): the repeated stretches."""
    rows = _rows(docs, id_col, text_col)
    long, kind = rows.filter(F.octet_length("text") >= LENGTH), ddl(ROW)
    open_places = _counted(arrow_map(long, _dictionary, kind)).filter("again").withColumn("again", F.lit(0).cast("bigint"))
    found = None
    for step in (WINDOW * 2, BLOCK, 1):
        strings = materialize(_counted(arrow_map(_at(long, _packed(open_places)), _parse(step), kind)), "strings")
        settled = strings.filter("again").select("id", "th", "place")
        found = settled if found is None else found.unionByName(settled)
        open_places = _open(strings)
    return found


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """keyed(), with th left at 0 (which packs to nothing in the shuffle) where ids name rows by themselves."""
    rows = keyed(docs, id_col, text_col)
    unique = rows.groupBy("id").count().filter("count > 1 OR id IS NULL").isEmpty()
    return rows.withColumn("th", F.lit(0).cast("bigint")) if unique else rows


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start:end of each run of removed bytes)."""
    rows = _rows(docs, id_col, text_col)
    found = _packed(repeats(docs, id_col, text_col).withColumn("again", F.lit(1).cast("bigint")))
    found = broadcast_if_small(found, F.length("places") + 32).select(F.col("id").alias("found_id"), F.col("th").alias("found_th"), "places")
    whole = rows.join(found, rows["id"].eqNullSafe(F.col("found_id")) & (rows["th"] == F.col("found_th")), "left")
    return arrow_map(whole.select(rows["id"], "text", "places"), _remove, ddl(RESULT))
