"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: the target's (documents labelled good, a bounded sample of them) and the raw
text's (every document). A document's log importance weight is the sum over its n-grams of the log ratio of the two. Documents are
drawn without replacement in proportion to their weights: Gumbel noise is added and the k largest stay. k is, unless
given, the expected number of target documents: the sum over all documents of prior * weight, at most 1 each, where the three kinds of
n-grams, being views of the same tokens, count as one (the cube root of the weight). The noise comes from
a hash of the row, so a run can be repeated.

The n-grams are words and marks, pairs of these, and pairs of their shapes, where a word that is repeated at once counts as such.

Defined results. A null or empty text has weight 1 (log 0). Rows equal in id and text have the same noise and fare alike; documents
that tie with the last one drawn stay too. Without labels of the target every weight is 1 and all stay. An empty table gives an empty table.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keyed, materialize
from .exact_dedup import ddl

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKET_BITS, SEED = 15, 17
#: Added to the target's count of a bucket and to the count that the raw model leads to expect: rare n-grams say little either way.
SMOOTHING = 10.0
#: At most this many labelled documents make the target's model (those of the smallest hash).
TARGET_ROWS = 20_000

COUNTS = pa.schema([("bucket", pa.int64()), ("raw", pa.int64()), ("target", pa.int64())])
SCORED = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("log_weight", pa.float64()), ("n_grams", pa.int64()), ("p_target", pa.float64()), ("draw", pa.int64())])
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _shape(token: str) -> str:
    if token[0].isalnum():
        return ("0" if token.isdigit() else "A" if len(token) > 1 and token.isupper() else "Aa" if token[0].isupper() else "a") + ("" if len(token) < 4 else "+")
    return token[:3]


class Tokens(dict):
    """token -> (its hash, its shape's hash); emptied when it has grown to 100,000 tokens."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= 100_000:
            self.clear()
        self[token] = h = (xxhash.xxh64_intdigest(token), xxhash.xxh64_intdigest("shape " + _shape(token)))
        return h


def grams(text: str, known: Tokens) -> np.ndarray:
    """The buckets of a text's n-grams."""
    both = np.array([known[t] for t in TOKEN.findall(text)], np.uint64).reshape(-1, 2)
    word, shape = both[:, 0], both[:, 1]
    again = word[1:] == word[:-1]
    pairs = np.where(again, _C2, word[:-1] * _C1 + word[1:])
    shapes = np.where(again, _C1, shape[:-1] * _C2 + shape[1:] * _C1)
    return ((np.concatenate([word, pairs, shapes]) * _C1) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, total = Tokens(), np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        found = [grams(text, known) for text in batch.column(0).to_pylist()]
        for k, part in enumerate((found, [g for g, target in zip(found, batch.column(1).to_pylist(), strict=True) if target])):
            if part:
                total[k] += np.bincount(np.concatenate(part), minlength=1 << BUCKET_BITS)
    has = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[0][has]), pa.array(total[1][has])], schema=COUNTS)


def _gumbel(ids: list, ths: list) -> np.ndarray:
    h = np.array([xxhash.xxh64_intdigest(f"{SEED} {i} {t}") >> 11 for i, t in zip(ids, ths, strict=True)], np.float64)
    return -np.log(-np.log((h + 0.5) / 2.0**53))


def ordered(x: np.ndarray) -> np.ndarray:
    """Floats as integers of the same order."""
    b = np.asarray(x, np.float64).view(np.int64)
    return np.where(b >= 0, b, b ^ np.int64(2**63 - 1))


def _score(ratio: np.ndarray, prior: float) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for batch in batches:
            buckets = [grams(text, known) for text in batch.column(2).to_pylist()]
            weight = np.array([ratio[b].sum() for b in buckets])
            draw = ordered(weight + _gumbel(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            p = np.exp(np.minimum(0.0, np.log(prior) + weight / 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weight), pa.array([len(b) for b in buckets], pa.int64()), pa.array(p), pa.array(draw, pa.int64())], schema=SCORED)

    return f


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a bigint column (None if there are fewer rows), 16 bits at a time: at most 65,536 counts reach the driver at once."""
    known, shift = None, 48
    while shift >= 0:
        part = rows if known is None else rows.filter(F.shiftright(column, shift + 16) == known)
        counts = dict(part.groupBy(F.shiftright(column, shift).alias("b")).count().collect())
        for b in sorted(counts, reverse=True):
            if counts[b] >= k:
                known = b
                break
            k -= counts[b]
        else:
            return None
        shift -= 16
    return known


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", k: int | None = None, target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row per row of docs: id, th (see keyed()), log_weight, n_grams, p_target, draw, kept. labels: id_col and label_col, 1 for the target."""
    rows = keyed(docs, id_col, text_col)
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("target_id")).agg(F.max(label_col).alias("good"))
    n_labels, n_good = marked.agg(F.count("*"), F.sum("good")).first()
    prior = ((n_good or 0) + 0.5) / (n_labels + 1) if n_labels else 1.0
    target = F.broadcast(marked.filter("good = 1").select("target_id").orderBy(F.xxhash64("target_id"), "target_id").limit(target_rows))
    flagged = rows.join(target, rows["id"] == target["target_id"], "left").select("text", F.col("target_id").isNotNull().alias("target"))
    counts = arrow_map(flagged, _count, ddl(COUNTS)).groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    total = np.zeros((2, 1 << BUCKET_BITS))
    for bucket, raw, good in counts:
        total[:, bucket] = raw, good
    expected = total[0] * (total[1].sum() / max(1.0, total[0].sum()))
    ratio = np.log(total[1] + SMOOTHING) - np.log(expected + SMOOTHING)
    scored = materialize(arrow_map(rows, _score(ratio, prior if total[1].any() else 1.0), ddl(SCORED)), "scored")
    if k is None:
        k = round(scored.agg(F.sum("p_target")).first()[0] or 0)
    least = kth_largest(scored, "draw", k) if k > 0 else 2**63 - 1
    return scored.withColumn("kept", F.lit(True) if least is None else F.col("draw") >= least)
