"""Near-duplicate join: pairs of texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

1. Texts with equal shingle sets are one set class (found by digest; any number of copies costs one row per text).
2. Each class has a MinHash signature; bands of it give candidates. A bucket's pairs are compared a few MinHash values at a time and
   dropped once the posterior probability of reaching the threshold is below the tolerance. Of each bucket only a spanning forest of
   what is left goes on, so no bucket emits its pairs. Buckets over a block size are split into pairs of blocks, each one a task's share.
3. The components of these forests hold all pairs still in question. Each component's texts come together once (again in pairs of
   blocks), pairs are pruned by the same rule over the full MinHash values, and the rest is verified on the shingle sets themselves.
   Links are counted per text, and the components of the verified links are the classes.

Defined results. A null text counts as empty. Texts without a word have no links; each is a class of its own. Texts of fewer
than `k` words have one shingle, of all their words. Rows that are repeated belong to one class. The class id is the smallest id of
its rows (null ids count only if there is no other). An empty table gives an empty table. Columns other than the id and the text are not
read.

With 24 bands of 4 a pair at similarity 0.8 exactly shares none with probability 3e-6, and is pruned with one of about 1e-5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, broadcast_if_small, fresh, keyed, materialize, same_row, without
from .exact_dedup import ddl
from .graph import components
from .words import WordHashes, runs, word_hashes

K, THRESHOLD, TOLERANCE = 5, 0.8, 1e-5
BANDS, ROWS, STEP = 24, 4, 16
N_HASH = BANDS * ROWS
#: Pairs are compared within blocks of this many texts.
BLOCK = 512

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 2**64, N_HASH, dtype=np.uint64) | np.uint64(1))[None, :]
_B = _rng.integers(0, 2**64, N_HASH, dtype=np.uint64)[None, :]

SIGNED = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("set", pa.binary()), ("sig", pa.binary())])
EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary())])
FOUND = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])


def signature(shingles: np.ndarray) -> np.ndarray:
    """N_HASH MinHash values of 32 bits."""
    best = np.full(N_HASH, np.uint64(2**64 - 1))
    for k in range(0, len(shingles), 1024):
        np.minimum(best, (shingles[k : k + 1024, None] * _A + _B).min(0), out=best)
    return (best >> np.uint64(32)).astype("<u4")


def least_matches(threshold: float, tolerance: float, bits: int) -> dict[int, int]:
    """After n values, the number of matches below which P(similarity >= threshold | matches) < tolerance, for a uniform prior.
    Two values of `bits` bits that differ are equal by chance once in 2**bits."""
    chance = 0.5**bits
    j = (np.arange(20_000) + 0.5) / 20_000
    p = j + (1 - j) * chance
    out = {}
    for n in range(STEP, N_HASH + 1, STEP):
        for m in range(n + 1):
            weight = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(weight - weight.max())
            if weight[j >= threshold].sum() / weight.sum() >= tolerance:
                break
        out[n] = m
    return out


def pruned(sigs: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows of sigs that outlast the comparison of all values, STEP at a time."""
    same = np.zeros(len(i), np.int32)
    for n, m in least.items():
        if not len(i):
            break
        same += (sigs[i, n - STEP : n] == sigs[j, n - STEP : n]).sum(1, dtype=np.int32)
        alive = same >= m
        i, j, same = i[alive], j[alive], same[alive]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x, root) that join what the pairs (i, j) of n nodes join."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all() and (root[i] == root[j]).all():
            break
    x = np.flatnonzero(root != np.arange(n))
    return x, root[x]


def pairs_of(left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within `left` rows (right 0), or between these and the `right` rows after them."""
    if right:
        return np.repeat(np.arange(left), right), np.tile(np.arange(left, left + right), left)
    return np.triu_indices(left, 1)


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal keys (the first n_keys columns) of batches in order of these, as one batch."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(c.to_pylist() for c in batch.columns[:n_keys]), strict=True))
        starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for a, b in zip(starts, starts[1:], strict=False):
            if held and keys[a] != key:
                yield pa.concat_batches(held)
                held = []
            key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def _sign(k: int) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets, sigs = [], []
            for text in batch.column(2).to_pylist():
                s = np.unique(runs(word_hashes(text, known), k))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], schema=SIGNED)

    return f


def _bucket_forest(least: dict[int, int]) -> Callable:
    """Rows (key, i, j, block, set, low) in order of the first three -> edges of candidates. low: the last byte of each MinHash value."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[pa.RecordBatch, int]] = []
        n_pairs = 0

        def run() -> pa.RecordBatch:
            rows = pa.concat_batches([g for g, _ in waiting])
            sigs = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.uint8).reshape(-1, N_HASH)
            sets = np.array(rows.column(4).to_pylist(), object)
            at, ii, jj = 0, [], []
            for g, left in waiting:
                i, j = pairs_of(left, g.num_rows - left if left < g.num_rows else 0)
                ii.append(i + at)
                jj.append(j + at)
                at += g.num_rows
            x, root = forest(at, *pruned(sigs, np.concatenate(ii), np.concatenate(jj), least))
            return pa.RecordBatch.from_arrays([pa.array(sets[x], pa.binary()), pa.array(sets[root], pa.binary())], schema=EDGE)

        for g in grouped(batches, 3):
            left = g.num_rows
            if g.column(1)[0].as_py() != g.column(2)[0].as_py():
                g = g.take(np.argsort(np.array(g.column(3)) != g.column(1)[0].as_py(), kind="stable"))
                left = int((np.array(g.column(3)) == g.column(1)[0].as_py()).sum())
                if left in (0, g.num_rows):
                    continue
            waiting.append((g, left))
            n_pairs += left * max(left, g.num_rows - left)
            if n_pairs > 1_000_000:
                yield run()
                waiting, n_pairs = [], 0
        if waiting:
            yield run()

    return f


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of shingles that sets i and j share: one by one, or by counting in blocks of shingles if many pairs are asked for."""
    if len(i) < 200 or len(i) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, len(values), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        total += part @ part.T
    return total[i, j].astype(np.int64)


def _verify(k: int, threshold: float, least: dict[int, int]) -> Callable:
    """Rows (component, i, j, block, set, n_texts, text) in order of the first three -> links: (set, null, number of texts linked) and (set, root, null)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for g in grouped(batches, 3):
            first, second = g.column(1)[0].as_py(), g.column(2)[0].as_py()
            names, block = g.column(4).to_pylist(), np.array(g.column(3))
            keep, seen = [], set()
            for at in np.argsort(block != first, kind="stable"):
                if names[at] not in seen:
                    seen.add(names[at])
                    keep.append(int(at))
            left = int((block[keep] == first).sum())
            right = len(keep) - left
            if first != second and not (left and right) or len(keep) < 2:
                continue
            texts, weight = g.column(6), np.array(g.column(5))[keep]
            sets = [np.unique(runs(word_hashes(texts[at].as_py(), known), k)) for at in keep]
            sigs = np.stack([signature(s) for s in sets])
            size = np.array([len(s) for s in sets])
            i, j = pairs_of(left, right)
            fits = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
            i, j = pruned(sigs, i[fits], j[fits], least)
            both = intersections(sets, i, j)
            linked = both >= threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[linked], j[linked]
            n = np.bincount(i, weight[j], len(keep)) + np.bincount(j, weight[i], len(keep))
            x, root = forest(len(keep), i, j)
            has = np.flatnonzero(n)
            names = np.array([names[at] for at in keep], object)
            a = [*names[has], *names[x]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array([*[None] * len(has), *names[root]], pa.binary()), pa.array([*n[has].astype(int), *[None] * len(x)], pa.int64())], schema=FOUND)

    return f


def _blocked(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Each row once for every pair (i, j) of blocks of its group that it takes part in."""
    own = F.pmod(F.xxhash64("set"), F.ceil(F.col(size) / block)).cast("int")
    out = rows.withColumn("block", own)
    other = F.explode(F.sequence(F.lit(0), (F.ceil(F.col(size) / block) - 1).cast("int")))
    return out.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", size)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id, th (see keyed()), class_id, n_links (other texts at the threshold or above), keep (the row's text is the one of its class that stays)."""
    rows = keyed(docs, id_col, text_col)
    signed = materialize(arrow_map(rows, _sign(k), ddl(SIGNED)), "signed")
    texts = signed.filter("set IS NOT NULL").groupBy("set", "th").agg(F.min("id").alias("id"), F.any_value("sig").alias("sig"))
    sets = texts.groupBy("set").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("rep"), F.count("*").alias("n_texts"), F.any_value("sig").alias("sig"))
    low = F.unhex(F.regexp_replace(F.hex("sig"), "([0-9A-F]{2})[0-9A-F]{6}", "$1"))
    sets = materialize(sets.select("set", "rep.id", "rep.th", "n_texts", "sig", low.alias("low")), "sets")

    bands = sets.select("set", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * (4 * ROWS) + 1, F.lit(4 * ROWS))))).alias("key"))
    many = bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = materialize(bands.join(many, "key"), "buckets")
    shares = _blocked(met.join(sets.select("set", "low"), "set"), "key", "size", block)
    shares = shares.select("key", "i", "j", "block", "set", "low").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    in_question = components(arrow_map(shares, _bucket_forest(least_matches(threshold, tolerance, 8)), ddl(EDGE)))

    sizes = in_question.groupBy("root").agg(F.count("*").alias("size"))
    asked = materialize(in_question.join(sizes, "root").join(sets.select(F.col("set").alias("node"), "id", "th", "n_texts"), "node"), "asked")
    asked = broadcast_if_small(asked.select(F.col("root").alias("component"), F.col("node").alias("set"), "id", "th", "n_texts", "size"), 160)
    whole = _blocked(rows.join(asked, same_row(rows, asked)).select("component", "size", "set", "n_texts", "text"), "component", "size", block)
    whole = whole.select("component", "i", "j", "block", "set", "n_texts", "text").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = materialize(arrow_map(whole, _verify(k, threshold, least_matches(threshold, tolerance, 32)), ddl(FOUND)), "links")

    links = found.filter("b IS NULL").groupBy(F.col("a").alias("set")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("set"), "root")
    state = sets.select("set", "id", "th", "n_texts").join(links, "set", "left").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    first = state.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first"))
    state = state.join(first, "root").select("set", (F.coalesce("n", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"), "first")
    out = signed.select("id", "th", "set").join(state, "set", "left")
    return out.select(
        "id", "th", F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        (F.col("set").isNull() | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")))).alias("keep"),
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of docs, with all columns, of which one document of each class stays: the one of the smallest id. Of rows equal in id and text one stays."""
    found = materialize(ngram_join(docs, id_col, text_col, **options).select("id", "th", "keep").groupBy("id", "th").agg(F.max("keep").alias("keep"), F.count("*").alias("n")), "classes")
    kept = without(docs, found.filter("NOT keep OR n > 1"), id_col, text_col)
    twice = found.filter("keep AND n > 1")
    if twice.isEmpty():
        return kept
    a, b = fresh(docs, "twice_id"), fresh(docs, "twice_th")
    named = docs.withColumn(a, docs[id_col]).withColumn(b, F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    again = named.join(twice, named[a].eqNullSafe(twice["id"]) & (named[b] == twice["th"]), "left_semi").dropDuplicates([a, b])
    return kept.unionByName(again.drop(a, b))
