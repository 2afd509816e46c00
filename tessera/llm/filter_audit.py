"""Filter interaction audit: what each of several filters removes in every order of them, and its Shapley value, from counts of mask cells."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

#: The filters of the audit, in the order of their bits, and their bounds.
NAMES = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Parts whose rows are made at once.
PARTS = 100

STEP = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))])


def failures(text: str) -> tuple[int, bytes]:
    """The bits of the conditions A to D that a text fails, and the SHA-256 of its bytes. bytes.split() parts at just the six signs of white space that count."""
    body = text.encode()
    words = body.split()
    bad = (
        len(words) < LEAST_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words), 100 * (len(body) - len(body.translate(None, CAPITALS))) > CAPITAL_PERCENT * len(text),
        len(body.translate(None, SIGNS)) < len(body),
    )
    return sum(b << k for k, b in enumerate(bad)), hashlib.sha256(body).digest()


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [failures(t) for t in batch.column(2).to_pylist()]
        columns = [batch.column(0), batch.column(1), pa.array([b for b, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "bits", "digest"])


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, n_good, n_toxic): the documents of a part that fail just the filters of mask (bit k: NAMES[k]), with those labelled good and toxic.

    Texts meet by their SHA-256. A row of many copies is counted by task before it moves: first by id (so that repeated ids
    are known, and labels join where the rows are), then by text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = arrow_map(rows, _judge, f"id {rows.schema['id'].dataType.simpleString()}, part string, bits int, digest binary")
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    none = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    by_id = rows.join(marks, "id", "left").groupBy("id", "digest", "part", "bits", none("good"), none("toxic")).agg(F.count("*").alias("n"))
    # n_first: rows of the smallest id, which no smaller one precedes. Rows without an id neither precede nor follow any.
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    by_text = by_id.groupBy("digest", "part", "bits", "good", "toxic").agg(F.sum("n").alias("n"), least.alias("least"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_none"))
    by_text = materialize(by_text, "audit")
    first = by_text.groupBy("digest").agg(F.min("least.id").alias("first"))
    fresh = F.col("n_none") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = by_text.join(first, "digest").select("part", "bits", "good", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("copy"), fresh.alias("n")), F.struct(F.lit(1).alias("copy"), (F.col("n") - fresh).alias("n")))).alias("c"))
    split = split.filter("c.n > 0").withColumn("mask", F.col("bits") + F.col("c.copy") * (1 << NAMES.index("E")))
    count = lambda when: F.sum(F.when(when, F.col("c.n")).otherwise(0))
    return split.groupBy("part", "mask").agg(count(F.lit(True)).alias("n"), count(F.col("good")).alias("n_good"), count(F.col("toxic")).alias("n_toxic"))


def transpositions(n: int) -> list[int]:
    """The places k whose swaps (k with k + 1), one after the other, lead from the identity through every order of n things once."""
    if n < 2:
        return []
    inner, down, out = transpositions(n - 1), True, []
    for k in range(len(inner) + 1):
        out += range(n - 2, -1, -1) if down else range(n - 1)
        if k < len(inner):
            # The largest lies in front after a walk down, so the others are one place further on.
            out.append(inner[k] + down)
        down = not down
    return out


def walk(counts: np.ndarray, names: Sequence[str] = NAMES) -> Iterator[tuple[str, np.ndarray]]:
    """Each order of the filters with its steps: int64[part, step, (filter, kept, removed, redundant, good_lost, toxic_lost)].

    counts: int64[part, mask, (n, good, toxic)]. One swap of neighbours leads from an order to the next, and only the two
    steps that it touches are worked out again from the cells.
    """
    masks, n = np.arange(1 << len(names)), len(names)
    order = list(range(n))
    steps = np.zeros((len(counts), n, 6), np.int64)

    def work_out(k: int) -> None:
        before, bit = sum(1 << f for f in order[:k]), 1 << order[k]
        gone = counts[:, (masks & before == 0) & (masks & bit > 0)].sum(1)
        steps[:, k, 0] = order[k]
        steps[:, k, 1] = counts[:, masks & (before | bit) == 0, 0].sum(1)
        steps[:, k, 2], steps[:, k, 4], steps[:, k, 5] = gone.T
        steps[:, k, 3] = counts[:, (masks & before > 0) & (masks & bit > 0), 0].sum(1)

    for k in range(n):
        work_out(k)
    yield "".join(names[f] for f in order), steps
    for k in transpositions(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        work_out(k)
        work_out(k + 1)
        yield "".join(names[f] for f in order), steps


def audit(cells: DataFrame) -> DataFrame:
    """The rows of STEP for a table of cells(): 120 orders by 5 steps for each part, zeros included."""
    m = 1 << len(NAMES)
    dense = [F.sum(F.when(F.col("mask") == k, F.col(c)).otherwise(0)) for k in range(m) for c in ("n", "n_good", "n_toxic")]
    table = cells.groupBy("part").agg(F.array(*dense).alias("counts"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 1 << np.arange(len(NAMES))
        for whole in batches:
            for at in range(0, whole.num_rows, PARTS):
                batch = whole.slice(at, PARTS)
                parts = batch.column(0)
                counts = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, m, 3)
                orders, found = [], []
                shapley = np.zeros((len(parts), len(NAMES)), np.int64)
                for order, steps in walk(counts):
                    orders.append(order)
                    found.append(steps.copy())
                    shapley[:, steps[0, :, 0]] += steps[:, :, 2]
                rows = np.stack(found, 1).reshape(-1, 6)
                n, each = len(parts), len(orders) * len(NAMES)
                which, part = rows[:, 0], np.repeat(np.arange(n), each)
                columns = [
                    parts.take(pa.array(part)), pa.array(np.tile(np.repeat(np.array(orders, object), len(NAMES)), n), pa.string()), pa.array(np.tile(np.arange(1, len(NAMES) + 1), n * len(orders)), pa.int32()),
                    *(pa.array(rows[:, k]) for k in (1, 2, 3)), pa.array(counts[:, bits, 0][part, which]), *(pa.array(rows[:, k]) for k in (4, 5)), pa.array(shapley[part, which]),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=STEP)

    schema = ", ".join(f"{x.name} {'string' if x.type == pa.string() else 'int' if x.type == pa.int32() else 'bigint'}" for x in STEP)
    return table.mapInArrow(f, schema)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part (value of source), order of the five filters and step: what is kept after it, what it removes, what of its failures was gone before
    (redundant), what only it fails (unique_fails), removed documents labelled good and toxic, and the filter's removals summed over all orders (shapley).

    A null text is empty, a null source the empty string. A document is a row: rows repeated with their id count each, and none
    of them is a copy of the other, as neither id is smaller. A row without an id is never a copy and never makes one. Of repeated labels any that says 1
    counts. No documents give no rows. Columns besides doc_id, text and source aren't looked at.
    """
    return audit(cells(docs, labels))

