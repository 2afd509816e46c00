"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words. A run of `shortest` words of an item is a seed (an item of fewer words is one seed in
itself). Documents are read once, beside a bit filter of all seeds, which leaves of each document the passages that seeds
stand in. Their seeds are joined with those of the items; for each document and item with a seed in common, the longest match of unmarked words
is sought by running Karp-Rabin hashes over both (a window of the item is found in the document by its rolling hash), marked as a tile, and so on until no match of
a seed's length is left. An item counts as leaked into a document if the tiles cover at least `threshold` of its words, in whatever order its
parts stand there.

What is broadcast is the filter, of 32 bits a seed and 16 MB at most; a fuller filter only lets more passages through to the join. Memory for a pair is in proportion to
the passages and the item, whatever they repeat.

Defined results. A null text counts as empty. Items without a word never leak. Repeated items count once per item id; repeated
rows of docs fare alike. Empty tables give no leaks. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, broadcast_if_small, keyed, materialize, same_row
from .words import WordHashes, runs, word_hashes

SHORTEST, THRESHOLD = 5, 0.5
#: Bits of the filter for each seed, and at most; the slots of a seed.
SEED_BITS, MOST_BITS = 32, 1 << 27
SLOTS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x2545F4914F6CDD1D))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


class Rolling:
    """Karp-Rabin hashes of all windows of a sequence, of any length, mod 2**64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power, back = np.ones(n, np.uint64), np.ones(n, np.uint64)
        np.multiply.accumulate(np.full(max(0, n - 1), _BASE, np.uint64), out=power[1:])
        np.multiply.accumulate(np.full(max(0, n - 1), _INVERSE, np.uint64), out=back[1:])
        self.back = back
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power, dtype=np.uint64)])

    def windows(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * self.back[at]


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Where windows of n words without a marked one begin."""
    sums = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(sums[n:] == sums[:-n])


def tiles(doc: np.ndarray, item: np.ndarray, shortest: int, apart: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, length): the longest first, then the first in the item, then in the document.
    apart: True for places of doc that no match runs across."""
    a, b = Rolling(doc), Rolling(item)
    used, marked = np.zeros(len(doc), bool) if apart is None else apart.copy(), np.zeros(len(item), bool)
    out: list[tuple[int, int, int]] = []

    def meet(n: int) -> bool:
        return bool(np.isin(b.windows(_free(marked, n), n), a.windows(_free(used, n), n)).any())

    top = min(len(doc), len(item)) + 1
    while top > shortest and meet(shortest):
        # The longest match is of n words: n words meet, top don't.
        n = shortest
        while top - n > 1:
            middle = (n + top) // 2
            n, top = (middle, top) if meet(middle) else (n, middle)
        i, j = _free(used, n), _free(marked, n)
        hi, hj = a.windows(i, n), b.windows(j, n)
        order = np.argsort(hi, kind="stable")
        i, hi = i[order], hi[order]
        lo, end = np.searchsorted(hi, hj, "left"), np.searchsorted(hi, hj, "right")
        later: dict[int, int] = {}
        for q in np.flatnonzero(end > lo).tolist():
            y = int(j[q])
            if marked[y : y + n].any():
                continue
            k = later.get(int(lo[q]), int(lo[q]))
            while k < end[q]:
                x = int(i[k])
                if not used[x] and not used[x + n - 1] and not used[x : x + n].any() and np.array_equal(doc[x : x + n], item[y : y + n]):
                    break
                k += 1
            later[int(lo[q])] = k
            if k < end[q]:
                out.append((x, y, n))
                used[x : x + n] = marked[y : y + n] = True
        top = n
    return out


def _items(k: int) -> Callable:
    """Rows (item_id, text) -> (item_id, th, words, the seed at each place, shortest)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            words = [word_hashes(t, known) for t in batch.column(2).to_pylist()]
            seeds = [runs(w, k).view(np.int64) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(seeds, pa.list_(pa.int64())), pa.array([min(k, len(w)) for w in words], pa.int32())], names=["item_id", "ih", "item", "seeds", "shortest"])

    return f


def _slot(seeds: np.ndarray, k: int, size: int) -> np.ndarray:
    return ((seeds * SLOTS[k]) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _in_filter(seeds: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The places of those seeds all of whose slots are set."""
    at = np.arange(len(seeds))
    for k in range(len(SLOTS)):
        if not len(at):
            break
        slot = _slot(seeds[at], k, len(bits) * 8)
        at = at[(bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)]
    return at


def _bits(size: int) -> Callable:
    """Rows (seeds) -> one row of each task: the filter of its seeds."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            seeds = np.array(batch.column(0).flatten(), np.int64).view(np.uint64)
            for k in range(len(SLOTS)):
                bits[_slot(seeds, k, size)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    return f


def passages(words: np.ndarray, bits: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """What seeds (of these lengths, in the filter) cover of a document, with a 0 between passages; and those seeds."""
    found = []
    for k in lengths:
        if len(words) >= k:
            own = runs(words, k)
            at = _in_filter(own, bits)
            if len(at):
                found.append((at, at + k, own[at]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    start, end, seeds = (np.concatenate(x) for x in zip(*found, strict=True))
    at = np.flatnonzero(np.cumsum(np.bincount(start, minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1)))
    return np.insert(words[at], np.flatnonzero(np.diff(at) > 1) + 1, 0), np.unique(seeds)


def _search(shipped: object, lengths: list[int]) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = np.frombuffer(shipped.value, np.uint8), WordHashes()
        for batch in batches:
            found = [passages(word_hashes(t, known), bits, lengths) for t in batch.column(2).to_pylist()]
            has = [k for k, (_, seeds) in enumerate(found) if len(seeds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has, pa.int64())), batch.column(1).take(pa.array(has, pa.int64())), pa.array([found[k][0].tobytes() for k in has], pa.binary()), pa.array([found[k][1].view(np.int64) for k in has], pa.list_(pa.int64()))], names=["id", "th", "doc", "seeds"])

    return f


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, th, item_id, doc, item, shortest) -> (id, th, item_id, coverage)."""
    for batch in batches:
        share = []
        for doc, item, k in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True):
            doc, item = np.frombuffer(doc, np.uint64), np.frombuffer(item, np.uint64)
            share.append(sum(t[2] for t in tiles(doc, item, k, doc == 0)) / len(item))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(share, pa.float64())], names=["id", "th", "item_id", "coverage"])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shortest: int = SHORTEST, most_bits: int = MOST_BITS, matters: float | None = None) -> DataFrame:
    """(id, th, item_id, coverage) for each document (see keyed()) and item with a seed in common. Given `matters`, only for those whose shared seeds could cover
    so much of the item, and for what a document's best item is told by: a phrase that many items and documents share costs a row for each pair of them, no tiling."""
    spark, rows = docs.sparkSession, keyed(docs, id_col, text_col)
    kind, item_kind = dict(rows.dtypes)["id"], dict(benchmark.dtypes)[item_col]
    items = keyed(benchmark, item_col, item_text).select(F.col("id").alias("item_id"), F.col("th").alias("ih"), "text").distinct()
    items = materialize(arrow_map(items, _items(shortest), f"item_id {item_kind}, ih bigint, item binary, seeds array<bigint>, shortest int").filter("shortest > 0"), "items")
    n = items.agg(F.sum(F.size("seeds"))).first()[0] or 0
    size = min(most_bits, 1 << max(10, (SEED_BITS * n - 1).bit_length()))
    parts = arrow_map(items.select("seeds").coalesce(4), _bits(size), "bits binary").collect()
    bits = np.zeros(size // 8, np.uint8)
    for r in parts:
        bits |= np.frombuffer(r[0], np.uint8)
    shipped = spark.sparkContext.broadcast(bits.tobytes())
    lengths = sorted(r[0] for r in items.select("shortest").distinct().collect())
    hits = materialize(arrow_map(rows, _search(shipped, lengths), f"id {kind}, th bigint, doc binary, seeds array<bigint>"), "hits")
    shipped.unpersist()
    seeds = broadcast_if_small(items.select("item_id", "ih", F.posexplode("seeds").alias("at", "seed")), 28)
    pairs = hits.select("id", "th", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("id", "th", "item_id", "ih").agg(F.array_sort(F.collect_set("at")).alias("at"))
    known = broadcast_if_small(items.select(F.col("item_id").alias("own_id"), F.col("ih").alias("own_ih"), "item", "shortest"), F.length("item") + 32)
    sizes = broadcast_if_small(items.select(F.col("item_id").alias("own_id"), F.col("ih").alias("own_ih"), "shortest", (F.length("item") / 8).alias("words")), 40)
    # What the shared seeds cover of the item: each its own words, less those that the one before it has. Tiles are made of them, so they can't cover more.
    state = F.struct(F.lit(0).alias("sum"), F.lit(None).cast("int").alias("last"))
    covered = F.aggregate("at", state, lambda s, x: F.struct((s["sum"] + F.least(F.col("shortest"), F.coalesce(x - s["last"], F.col("shortest")))).alias("sum"), x.alias("last")), lambda s: s["sum"])
    pairs = pairs.join(sizes, pairs["item_id"].eqNullSafe(sizes["own_id"]) & (pairs["ih"] == sizes["own_ih"])).select("id", "th", "item_id", "ih", (covered / F.col("words")).alias("most"))
    pairs = materialize(pairs, "pairs")
    once = hits.select("id", "th", "doc").dropDuplicates(["id", "th"])

    def tile(some: DataFrame) -> DataFrame:
        met = some.join(known, some["item_id"].eqNullSafe(known["own_id"]) & (some["ih"] == known["own_ih"]))
        met = met.join(once, same_row(met, once)).select(met["id"], met["th"], "item_id", "doc", "item", "shortest")
        return arrow_map(met, _tiled, f"id {kind}, th bigint, item_id {item_kind}, coverage double")

    if matters is None:
        return tile(pairs)
    # The item that may cover most first; others only where they may cover more (or as much, and come before it), or enough to matter.
    rank = F.struct((-F.col("most")).alias("c"), "item_id")
    best = pairs.groupBy("id", "th").agg(F.min(F.struct((-F.col("most")).alias("c"), "item_id", "ih")).alias("b")).select("id", "th", "b.item_id", "b.ih")
    first = materialize(tile(best), "first")
    done = first.select(F.col("id").alias("d_id"), F.col("th").alias("d_th"), F.struct((-F.col("coverage")).alias("c"), "item_id").alias("best"))
    side = best.select(F.col("id").alias("b_id"), F.col("th").alias("b_th"), F.col("item_id").alias("b_item"), F.col("ih").alias("b_ih"))
    rest = pairs.join(done, pairs["id"].eqNullSafe(done["d_id"]) & (pairs["th"] == done["d_th"])).filter((F.col("most") >= matters - 1e-9) | (rank < F.col("best")))
    rest = rest.join(side, rest["id"].eqNullSafe(side["b_id"]) & (rest["th"] == side["b_th"]) & rest["item_id"].eqNullSafe(side["b_item"]) & (rest["ih"] == side["b_ih"]), "left_anti")
    return first.unionByName(tile(rest.select("id", "th", "item_id", "ih")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, **options: object) -> DataFrame:
    """One row per row of docs: id, th, coverage (the most of any item's words in tiles), item_id (the first such item, if any), n_items leaked, leaked."""
    rows = keyed(docs, options.get("id_col", "doc_id"), options.get("text_col", "text")).select("id", "th")
    found = leaks(docs, benchmark, matters=threshold, **options).groupBy(F.col("id").alias("hit_id"), F.col("th").alias("hit_th"), "item_id").agg(F.max("coverage").alias("coverage"))
    best = found.groupBy("hit_id", "hit_th").agg(F.min(F.struct((-F.col("coverage")).alias("c"), "item_id")).alias("best"), F.sum((F.col("coverage") >= threshold - 1e-9).cast("bigint")).alias("n"))
    best = materialize(best, "leaks")
    small = broadcast_if_small(best, 64)
    out = rows.join(small, rows["id"].eqNullSafe(small["hit_id"]) & (rows["th"] == small["hit_th"]), "left")
    coverage = F.coalesce(-F.col("best.c"), F.lit(0.0))
    return out.select("id", "th", coverage.alias("coverage"), F.col("best.item_id").alias("item_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_items"), (coverage >= threshold - 1e-9).alias("leaked"))
