"""WARC archives: a deterministic sharded writer and its reader.

Records are range-sorted by page id, and shards are cut at exact sums of bytes: an exact histogram over the ids, which splits every range
with too many rows again (and rows of one id by a hash of payload and address), gives ranges that one task can sort; running sums of bytes within and before
them give the first key of each shard. So the same table gives the same shards on any cluster, whatever its ids. Each shard is one task, which writes files that roll once their compressed size
reaches a bound. Headers and digests are made anew from the payload. A file is written under a temporary name, renamed when complete, and counts
only if its shard's manifest, written last and renamed likewise, lists it with its size and digest; a task that is run again writes the same
bytes under the same names. The reader takes the files that the manifests list.

Of records with equal payloads of at least `least` bytes, the one with the largest id is a response, the others are revisits of it; smaller ones
are all responses. Of rows of that id with that payload, the one whose hash is largest is the response; of rows repeated in full, which stay in one shard, the first.

Defined results. A null payload counts as empty; a null url leaves out the target header. A null id sorts first and has the
record name "null". Ids are integers of 64 bits. Empty tables give an archive without files and an empty table. Columns other than the three are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, broadcast_if_small, materialize, shared_dir
from .exact_dedup import ddl

LEAST, ROLL_BYTES, SHARD_BYTES = 1000, 16 << 20, 32 << 20
#: Shards grow beyond SHARD_BYTES where there would be more than this many; so many first keys, of 17 bytes, are broadcast at most.
MOST_SHARDS = 100_000
#: A range of keys that is sorted in one task has at most this many rows, or this share of all.
RANGE_ROWS, RANGE_SHARE = 512, 4096
LOWEST = -(2**63)
#: Archives are the same from run to run, so records carry this date unless another is given.
DATE = "2000-01-01T00:00:00Z"
FILE = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])
READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def named(name: str) -> int | None:
    value = name[10:-1]
    return None if value == "null" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One gzip member. A revisit keeps the payload's digest and names the response, whose payload it shares."""
    body = b"" if revisit else payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_name(page_id)), ("WARC-Date", date), ("Content-Type", "text/html; charset=utf-8")]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_name(refers_to))]
    head += [("WARC-Block-Digest", f"sha1:{hashlib.sha1(body).hexdigest()}"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Length", str(len(body)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member of a file."""
    at = 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof and at < len(data):
            part = data[at : at + (1 << 16)]
            parts.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


class Shard:
    """The files of one shard, each written under a temporary name of its own and then renamed."""

    def __init__(self, root: str, shard: int, roll: int):
        self.fs, self.path = pafs.FileSystem.from_uri(root)
        self.shard, self.roll, self.files, self.attempt = shard, roll, [], uuid.uuid4().hex
        self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
        self.parts: list[bytes] = []
        self.size = self.count = 0

    def put(self, member: bytes) -> None:
        self.parts.append(member)
        self.size += len(member)
        self.count += 1
        if self.size >= self.roll:
            self._close()

    def _commit(self, name: str, data: bytes) -> None:
        temporary = f"{self.path}/_temporary/{name}.{self.attempt}"
        with self.fs.open_output_stream(temporary, compression=None) as out:
            out.write(data)
        self.fs.move(temporary, f"{self.path}/{name}")

    def _close(self) -> None:
        data, name = b"".join(self.parts), f"shard-{self.shard:06d}-{len(self.files):05d}.warc.gz"
        self._commit(name, data)
        self.files.append((self.shard, name, self.count, len(data), hashlib.sha256(data).hexdigest()))
        self.parts, self.size, self.count = [], 0, 0

    def close(self) -> list[tuple]:
        if self.parts:
            self._close()
        self._commit(f"manifest-{self.shard:06d}.json", json.dumps([dict(zip(FILE.names, f, strict=True)) for f in self.files]).encode())
        return self.files


Key = tuple[int, int, int]


def packed(known: np.ndarray, ids: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Keys (known, id, tie) as byte strings of the same order. known: 0 where the id is null."""
    out = np.empty((len(ids), 17), np.uint8)
    out[:, 0] = known
    for k, x in ((1, ids), (9, tie)):
        out[:, k : k + 8] = (np.asarray(x, np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def index_of(firsts: list[Key]) -> Callable[..., Column]:
    """A function of the columns known, id and tie: the last of the keys `firsts`, which rise from the least, that isn't after them."""
    table = packed(*(np.array([f[k] for f in firsts], np.int64) for k in range(3)))

    @F.pandas_udf("int")
    def f(known: pd.Series, ids: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(table, packed(known.to_numpy(), ids.to_numpy(), tie.to_numpy()), "right").astype(np.int32) - 1)

    return f


def ranges(keys: DataFrame, n: int, most: int) -> tuple[list[Key], list[int]]:
    """First keys of ranges that hold at most `most` of the n rows of keys (but for rows equal in the whole key), and the bytes of each.

    Ranges with more rows are halved eight times over, until there are none; those that are left over at each turn are n / most at most.
    """
    lo, hi = keys.filter("known = 1").agg(F.min("id"), F.max("id")).first()
    shift = 0 if lo is None else next(s for s in range(0, 72, 8) if s == 64 or lo >> s == hi >> s)
    # A node is (known, id >> a, tie >> b), where 64 bits less are none; each with its rows and bytes.
    leaves: list[tuple[Key, int, int]] = []
    level, heavy = (shift, 64), None
    while heavy is None or heavy:
        a, b = level
        prefix = [F.col("known"), _shifted("id", a), _shifted("tie", b)]
        part = keys
        if heavy is not None:
            up = [F.col("known"), _shifted("id", last[0]), _shifted("tie", last[1])]  # noqa: F821
            wanted = keys.sparkSession.createDataFrame(heavy, "hk int, hi bigint, ht bigint")
            part = keys.join(F.broadcast(wanted), (up[0] == F.col("hk")) & (up[1] == F.col("hi")) & (up[2] == F.col("ht")), "left_semi")
        found = part.groupBy(*[c.alias(x) for c, x in zip(prefix, "kit", strict=True)]).agg(F.count("*"), F.sum("size")).collect()
        heavy = []
        for k, i, t, rows, size in found:
            if rows > most and (a, b) != (0, 0):
                heavy.append((k, i, t))
            else:
                leaves.append(((k, i << a if a < 64 else LOWEST, t << b if b < 64 else LOWEST), rows, size))
        last, level = level, (a - 8, 64) if a else (0, b - 8)
    firsts, sizes, held = [], [], 0
    for first, rows, size in sorted(leaves):
        if firsts and held + rows <= most:
            held, sizes[-1] = held + rows, sizes[-1] + size
        else:
            firsts.append(first)
            sizes.append(size)
            held = rows
    return firsts, sizes


def _shifted(column: str, bits: int) -> Column:
    return F.lit(0).cast("bigint") if bits == 64 else F.shiftright(column, bits)


def shards(keys: DataFrame, shard_bytes: int | None) -> list[Key]:
    """The first key of each shard: one for every shard_bytes of the rows of keys (known, id, tie, size) in order."""
    n, total = keys.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return []
    shard_bytes = shard_bytes or max(SHARD_BYTES, -(-total // MOST_SHARDS))
    firsts, sizes = ranges(keys, n, max(RANGE_ROWS, n // RANGE_SHARE))
    before = F.lit([0, *np.cumsum(sizes)[:-1].tolist()])
    t = keys.withColumn("range", index_of(firsts)("known", "id", "tie"))
    t = t.withColumn("at", F.expr("coalesce(sum(size) OVER (PARTITION BY range ORDER BY known, id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    shard = F.floor((F.element_at(before, F.col("range") + 1) + F.col("at")).cast("decimal(38,0)") / shard_bytes).cast("bigint")
    return sorted(tuple(r["first"]) for r in t.groupBy(shard.alias("shard")).agg(F.min(F.struct("known", "id", "tie")).alias("first")).collect())


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST, roll: int = ROLL_BYTES, shard_bytes: int | None = None, date: str = DATE) -> list[str]:
    """Write the archive under root (a URI that the driver and the executors can reach); gives the names of its manifests."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("own_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("known", F.col("own_id").isNotNull().cast("int")).withColumn("id", F.coalesce("own_id", F.lit(LOWEST))).withColumn("tie", F.xxhash64("sha1", "url"))
    keys = materialize(rows.select("known", "id", "tie", "sha1", (F.length("payload") + 300).cast("bigint").alias("size")), "keys")
    firsts = shards(keys, shard_bytes)
    # A payload that only one page has needs no partner: only digests met twice are joined back.
    twice = keys.filter(F.col("size") >= least + 300).groupBy("sha1").agg(F.max(F.struct("known", "id", "tie")).alias("keeper"), F.count("*").alias("n")).filter("n > 1").select("sha1", "keeper")
    twice = broadcast_if_small(materialize(twice, "twice"), 64)
    joined = rows.join(twice, "sha1", "left").withColumn("shard", index_of(firsts)("known", "id", "tie") if firsts else F.lit(0))
    dealt = joined.repartitionById(max(1, len(firsts)), "shard").sortWithinPartitions("shard", "known", "id", "tie")
    dealt = dealt.select("shard", "own_id", "url", "payload", F.lower(F.hex("sha1")).alias("sha1"), "keeper.known", F.col("keeper.id").alias("keeper_id"), F.col("keeper.tie").alias("keeper_tie"), "tie", (F.length("payload") >= least).alias("big"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, out = None, None, []
        for batch in batches:
            for s, i, url, payload, sha1, known, keeper, keeper_tie, tie, big in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.shard != s:
                    out += now.close() if now else []
                    now = Shard(root, s, roll)
                first = known is not None and (known, keeper, keeper_tie) == (i is not None, LOWEST if i is None else i, tie)
                # Rows equal to the response stand together here; all but the first of them revisit it.
                revisit = big and known is not None and (not first or last == (i, tie))
                last = (i, tie)
                now.put(record(i, url, payload, sha1, keeper if known else None, revisit, date))
        out += now.close() if now else []
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(FILE)], schema=FILE)

    done = arrow_map(dealt, store, ddl(FILE)).groupBy("shard").agg(F.sum("n_records")).collect()
    fs, path = pafs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)
    names = [f"manifest-{r[0]:06d}.json" for r in sorted(done)]
    with fs.open_output_stream(f"{path}/_manifests.json.tmp") as out:
        out.write(json.dumps({"manifests": names, "n_records": sum(r[1] for r in done)}).encode())
    fs.move(f"{path}/_manifests.json.tmp", f"{path}/manifests.json")
    fs.delete_dir_contents(f"{path}/_temporary", missing_dir_ok=True)
    return names


def read(spark: SparkSession, root: str) -> DataFrame:
    """One row per record of a committed archive: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for a revisit)."""
    listed = "array<struct<shard:bigint,file:string,n_records:bigint,n_bytes:bigint,sha256:string>>"
    fs, path = pafs.FileSystem.from_uri(root)
    with fs.open_input_stream(f"{path}/manifests.json") as f:
        names = json.loads(f.read())["manifests"]
    if not names:
        return spark.createDataFrame([], ddl(READ))
    text = spark.read.text([f"{root}/{n}" for n in names], wholetext=True)
    files = text.select(F.explode(F.from_json("value", listed)).alias("f")).select("f.file", "f.sha256")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for file, sha in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{top}/{file}", compression=None) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{file} isn't what its manifest says")
                rows, held = [], 0
                for head, block in records(data):
                    revisit = head["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and hashlib.sha1(block).hexdigest() != digest:
                        raise ValueError(f"{file}: a payload isn't what its header says")
                    rows.append((named(head["WARC-Record-ID"]), None if revisit else len(block), digest, head["WARC-Type"], named(head["WARC-Refers-To"]) if revisit else None, head.get("WARC-Target-URI"), None if revisit else block))
                    held += len(block)
                    if held > 4 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                yield _rows(rows)

    return arrow_map(files.repartition(len(names) * 2, "file"), parse, ddl(READ))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(READ)], schema=READ)


def round_trip(pages: DataFrame, **options: object) -> DataFrame:
    """Write an archive of pages into the shared folder, read it back, and give a revisit the size of the payload it refers to."""
    spark = pages.sparkSession
    base = shared_dir(spark).rstrip("/")
    root = f"{base if '://' in base else f'file://{base}' if base.startswith('/') else base.replace('file:', 'file://', 1)}/warc-{uuid.uuid4().hex}"
    write(pages, root, **options)
    found = materialize(read(spark, root).drop("payload", "url"), "read")
    sizes = found.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("whole"))
    met = found.filter("record_type = 'revisit'").select("payload_digest").distinct()
    return found.join(sizes.join(met, "payload_digest", "left_semi"), "payload_digest", "left").select("page_id", F.coalesce("payload_bytes", "whole").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
