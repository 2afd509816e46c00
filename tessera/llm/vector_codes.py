"""Vector codes by product quantisation: Lloyd's rounds whose sums are kept up to date by the parts that change their entry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize
from .vectors import matrix, whole_vectors

#: The largest magnitude of components up to which floats hold squared distances of parts exactly (for parts of up to 2048 components).
SMALL = 1 << 20
#: Vectors whose distances are worked out at once.
STRIDE = 2048

CODES = "id bigint, label string, ints array<bigint>, codes array<int>"


def assign(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of parts (int64[row, position]) the nearest entry of book, the first among equals, and its squared distance."""
    codes, errors = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    small = max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0)) <= SMALL
    for at in range(0, len(parts), STRIDE):
        x = parts[at : at + STRIDE]
        if small:
            # Whole numbers below 2^53, so the floats are exact.
            far = (x.astype(float) ** 2).sum(1)[:, None] - 2 * (x.astype(float) @ book.T.astype(float)) + (book.astype(float) ** 2).sum(1)
        else:
            far = np.stack([((x.astype(object) - entry.astype(object)) ** 2).sum(1) for entry in book], 1)
        codes[at : at + STRIDE] = best = far.argmin(1)
        errors[at : at + STRIDE] = np.minimum(far[np.arange(len(x)), best], 2**63 - 1).astype(np.int64) if not small else far[np.arange(len(x)), best]
    return codes, errors


def recode(vectors: DataFrame, books: np.ndarray, errors: bool = False) -> DataFrame:
    """vectors with codes by books (int64[part, entry, position]), before: the codes that they came with, and, if errors is set, error: the sum of squared distances."""
    n, _, width = books.shape

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index("ints")), n * width).reshape(-1, n, width)
            found = [assign(x[:, p], books[p]) for p in range(n)]
            codes = np.stack([c for c, _ in found], 1).astype(np.int32)
            error = sum((e.astype(object) for _, e in found), np.zeros(len(x), object)) if any(e.max(initial=0) > 2**55 for _, e in found) else sum(e for _, e in found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, n), pa.int32()), pa.array(codes.ravel()))
            keep = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            keep |= {"before": keep["codes"], "codes": lists, "error": pa.array(np.minimum(error, 2**63 - 1).astype(np.int64))}
            yield pa.RecordBatch.from_pydict(keep)

    out = arrow_map(vectors, f, f"{CODES}, before array<int>, error bigint")
    return out if errors else out.drop("error")


def changes(coded: DataFrame, n: int, entries: int, width: int) -> DataFrame:
    """(part, entry, position, sum): what the parts whose entry changed add to the sums of the new one and take from those of the old one; position `width` has their number.
    A task sums its own changes first, so it sends an entry of the books at most once; parts that stay send nothing."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n, entries, width + 1), object)
        for batch in batches:
            x = matrix(batch.column(0), n * width).reshape(-1, n, width)
            x = np.concatenate([x, np.ones((len(x), n, 1), np.int64)], 2)
            new = matrix(batch.column(1), n)
            old = batch.column(2)
            known = np.array(old.is_valid()) if old.null_count else np.ones(len(x), bool)
            before = np.full_like(new, -1)
            before[known] = matrix(old.drop_null(), n)
            for p in range(n):
                moved = np.flatnonzero(new[:, p] != before[:, p])
                for codes, rows, sign in ((new[moved, p], moved, 1), (before[moved[known[moved]], p], moved[known[moved]], -1)):
                    part = np.zeros((entries, width + 1), np.int64)
                    np.add.at(part, codes, x[rows, p])
                    sums[p] += sign * part.astype(object)
        at = np.argwhere(sums != 0)
        for k in range(0, len(at), 20_000):
            some = at[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in some.T), pa.array([str(sums[tuple(i)]) for i in some])], names=["part", "entry", "position", "sum"])

    parts = arrow_map(coded.select("ints", "codes", "before"), f, "part int, entry int, position int, sum string")
    return parts.groupBy("part", "entry", "position").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))


def first_books(vectors: DataFrame, n: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the smallest ids (among equal ids by their components; without an id last), as int64[part, entry, position]."""
    first = vectors.select("id", "ints").orderBy(F.asc_nulls_last("id"), "ints").limit(entries).collect()
    first.sort(key=lambda r: (r["id"] is None, r["id"] or 0, r["ints"]))
    return np.array([r["ints"] for r in first], np.int64).reshape(len(first), n, -1).transpose(1, 0, 2).copy()


def train(vectors: DataFrame, n: int, entries: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """(vectors with the codes they had in the last round, the books after it).

    The codes of a round are a table in the shared folder; the running sums and numbers of each entry are n * entries * (width
    + 1) whole numbers here, whatever the number of vectors. A round adds the changes to them, so its shuffle shrinks as
    codes settle.
    """
    books = first_books(vectors, n, entries)
    entries, width = books.shape[1], books.shape[2]
    sums = np.zeros((n, entries, width + 1), object)
    for _ in range(rounds):
        coded = materialize(recode(vectors, books), "codes")
        for r in changes(coded, n, entries, width).collect():
            sums[r["part"], r["entry"], r["position"]] += int(r["sum"])
        for p, entry in np.argwhere(sums[:, :, width] > 0):
            books[p, entry] = [int(s // sums[p, entry, width]) for s in sums[p, entry, :width]]
        vectors = coded.drop("before")
    return vectors, books


def book_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components, joined by commas, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(table: DataFrame, n: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, codes, code, error, label_error, codebooks_sha256): a row for each usable vector.

    Components are floor(scale * x), cut into n equal consecutive parts; where the length doesn't divide (or rows differ in
    it) zeros fill up. Each part's book starts as that part of the vectors of the smallest ids (rows that repeat an id count
    each, ordered by components; without an id last; fewer vectors than entries make a smaller book). In each round a part takes the
    nearest entry, the first among equals, and an entry becomes the floor of its parts' mean; unused ones stay. error: squared distances
    to the last books, summed over the parts; label_error: over all rows of that label, null being a label too. Vectors that
    are null or hold null or non-finite components are left out. No vectors give no rows. Errors beyond 64 bits saturate. Other columns aren't looked at.
    """
    spark = table.sparkSession
    label = F.col(label_col).cast("string") if label_col in table.columns else F.lit(None).cast("string")
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), label.alias("label"), F.col(vector_col).alias("embedding"))
    rows = whole_vectors(rows, scale, multiple_of=n)
    rows = materialize(rows.select("id", "label", "ints", F.lit(None).cast("array<int>").alias("codes")), "vectors")
    if rows.limit(1).count() == 0:
        return spark.createDataFrame([], "vec_id bigint, label string, codes array<int>, code string, error bigint, label_error bigint, codebooks_sha256 string")
    rows, books = train(rows, n, entries, rounds)
    coded = materialize(recode(rows, books, errors=True).drop("ints", "before"), "codes")
    total = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_e")).select(F.col("label").alias("_label"), F.least("_e", F.lit(2**63 - 1)).cast("bigint").alias("label_error"))
    hexed = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    out = coded.join(total, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias("vec_id"), "label", "codes", hexed.alias("code"), "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))
