"""Exact deduplication by a log-structured merge index over text digests.

Each input task feeds an index: a memtable takes digests, a full memtable is flushed as a run sorted by digest with a Bloom
filter, and many runs are compacted into one; compaction adds up counts and keeps the smallest identifier. A digest that is
found again is a hit only after its bytes are compared. The groups of all tasks are then dealt out by digest and merged by the
same index, so that a group of copies sends one row per input task, however large it is; the ids of its copies stay where they were
read, and the answer is sent back to each such row.

Defined results. A null text counts as empty; empty texts are equal to each other. Of equal texts the one with the most code
points stays, then the one with the smallest id (null last), then the first read; of rows repeated in full one is kept. An empty table
gives an empty table. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import tempfile
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from heapq import merge
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

#: The characters that texts may differ in: a space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
LAST = 2**63 - 1

ENTRY = pa.schema([("entry", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("best_len", pa.int64()), ("best_id", pa.int64()), ("best_row", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64()))])
#: What goes to the merge: no more than one of these for each distinct text and input task.
SENT = [f.name for f in ENTRY if f.name not in ("ids", "rows")]
MERGED = pa.schema([("kind", pa.int32()), ("entry", pa.int64()), ("digest", pa.binary()), ("ref", pa.int64()), ("best_id", pa.int64()), ("best_row", pa.int64()), ("n", pa.int64())])


class Bloom:
    """A Bloom filter over digests, which are already uniform: its positions are slices of them."""

    def __init__(self, digests: list[bytes]):
        self.size = max(64, 12 * len(digests))
        self.bits = bytearray(self.size // 8 + 1)
        for d in digests:
            for p in self._at(d):
                self.bits[p >> 3] |= 1 << (p & 7)

    def _at(self, d: bytes) -> list[int]:
        a, b = int.from_bytes(d[:8], "big"), int.from_bytes(d[-8:], "big") | 1
        return [(a + k * b) % self.size for k in range(6)]

    def __contains__(self, d: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._at(d))


class Run:
    """Entries (digest, ref, best, n) in order of digest; ref names the distinct text."""

    def __init__(self, entries: list[tuple]):
        self.entries, self.digests = entries, [e[0] for e in entries]
        self.filter = Bloom(self.digests)

    def refs(self, d: bytes) -> Iterator[int]:
        if d in self.filter:
            k = bisect_left(self.digests, d)
            while k < len(self.digests) and self.digests[k] == d:
                yield self.entries[k][1]
                k += 1


def same(a: bytes, b: bytes) -> bool:
    """Whether two bodies hold equal bytes; machines may compress them differently."""
    return a == b or zlib.decompress(a) == zlib.decompress(b)


class LsmIndex:
    """put() groups equal texts; groups() gives each group once. Bodies lie in a spool file, not in memory."""

    def __init__(self, memtable: int = 20_000, fanout: int = 6, equal: Callable[[bytes, bytes], bool] = bytes.__eq__):
        self.memtable, self.fanout, self.equal = memtable, fanout, equal
        self.table: dict[tuple[bytes, int], tuple] = {}
        self.fresh: dict[bytes, list[int]] = {}
        self.runs: list[Run] = []
        self.spool = tempfile.TemporaryFile()
        self.where: list[tuple[int, int]] = []

    def body(self, ref: int) -> bytes:
        at, size = self.where[ref]
        self.spool.seek(at)
        return self.spool.read(size)

    def _find(self, digest: bytes, body: bytes) -> int:
        seen = set()
        for refs in (self.fresh.get(digest, ()), *(r.refs(digest) for r in self.runs)):
            for ref in refs:
                if ref not in seen and (seen.add(ref) or self.equal(self.body(ref), body)):
                    return ref
        at = self.spool.seek(0, 2)
        self.spool.write(body)
        self.where.append((at, len(body)))
        return len(self.where) - 1

    def put(self, digest: bytes, body: bytes, best: tuple, n: int) -> int:
        ref = self._find(digest, body)
        old = self.table.get((digest, ref))
        self.table[digest, ref] = (min(best, old[0]), n + old[1]) if old else (best, n)
        if not old:
            self.fresh.setdefault(digest, []).append(ref)
            if len(self.table) >= self.memtable:
                self.flush()
        return ref

    def flush(self) -> None:
        if self.table:
            self.runs.append(Run([(*k, *v) for k, v in sorted(self.table.items())]))
            self.table, self.fresh = {}, {}
        if len(self.runs) > self.fanout:
            self.compact()

    def compact(self) -> None:
        out = []
        for (d, ref), same in groupby(merge(*(r.entries for r in self.runs)), key=lambda e: e[:2]):
            same = list(same)
            out.append((d, ref, min(e[2] for e in same), sum(e[3] for e in same)))
        self.runs = [Run(out)] if out else []

    def groups(self) -> list[tuple]:
        self.flush()
        self.compact()
        return self.runs[0].entries if self.runs else []


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups of one input task."""
    index, members, task, row = LsmIndex(equal=same), {}, TaskContext.get().partitionId() << 33, 0
    for batch in batches:
        for i, n, digest, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = task + row
            row += 1
            ref = index.put(digest, zlib.compress(body.encode(), 1), (-n, LAST if i is None else i, own), 1)
            ids, rows = members.setdefault(ref, ([], []))
            ids.append(i)
            rows.append(own)
    entries = index.groups()
    for k in range(0, len(entries), 500):
        part = entries[k : k + 500]
        cols = [[members[e[1]][1][0] for e in part], [e[0] for e in part], [index.body(e[1]) for e in part], [e[2][0] for e in part], [e[2][1] for e in part], [e[2][2] for e in part], [e[3] for e in part], [members[e[1]][0] for e in part], [members[e[1]][1] for e in part]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ENTRY, strict=True)], schema=ENTRY)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups of all tasks for the digests of one partition: what came in, with the group's ref (kind 0), then each group (kind 1)."""
    index = LsmIndex(equal=same)
    for batch in batches:
        c = {name: batch.column(k).to_pylist() for k, name in enumerate(SENT)}
        refs = [index.put(d, b, (ln, i, r), n) for d, b, ln, i, r, n in zip(c["digest"], c["body"], c["best_len"], c["best_id"], c["best_row"], c["n"], strict=True)]
        none = pa.nulls(len(refs), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(refs), pa.int32()), batch.column(0), batch.column(1), pa.array(refs, pa.int64()), none, none, none], schema=MERGED)
    entries = index.groups()
    for k in range(0, len(entries), 5000):
        part = entries[k : k + 5000]
        cols = [[1] * len(part), [None] * len(part), [e[0] for e in part], [e[1] for e in part], [e[2][1] for e in part], [e[2][2] for e in part], [e[3] for e in part]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, MERGED, strict=True)], schema=MERGED)


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.binary(): "binary", pa.int64(): "bigint", pa.int32(): "int", pa.list_(pa.int64()): "array<bigint>", pa.string(): "string", pa.float64(): "double"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    digest_bytes below 32 cuts the digest that groups are sought by (for tests: texts then share digests, and only the
    comparison of bytes tells them apart); text_sha256 is cut likewise.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    body = F.translate(text, BLANKS, "")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.char_length(text).cast("bigint").alias("len"), body.alias("body"))
    rows = rows.select("id", "len", F.substring(F.unhex(F.sha2("body", 256)), 1, digest_bytes).alias("digest"), "body")
    # Written, so that the numbers of rows that entries are known by stay what they are.
    entries = materialize(arrow_map(rows, _collect, ddl(ENTRY)), "entries")
    merged = materialize(arrow_map(entries.select(*SENT).repartition("digest"), _merge, ddl(MERGED)), "exact")
    groups = merged.filter("kind = 1").select("digest", "ref", F.col("best_id").alias("keep_id"), "best_row", F.col("n").alias("group_size"))
    found = merged.filter("kind = 0").select("digest", "ref", "entry").join(groups, ["digest", "ref"]).drop("ref")
    # Ids of copies stay with the task that read them; the answer goes to each entry.
    one = entries.select("entry", "ids", "rows").join(found, "entry").select("keep_id", "group_size", "best_row", "digest", F.explode(F.arrays_zip("ids", "rows")).alias("m"))
    return one.select(
        F.col("m.ids").alias("doc_id"), F.when(F.col("keep_id") != LAST, F.col("keep_id")).alias("keep_id"), "group_size",
        (F.col("m.rows") == F.col("best_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
