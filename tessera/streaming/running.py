"""Actions as running streams: state that outlives a restart, a watermark, a stated rule for what comes late.

Late rule. An arrival is judged by the watermark that the arrivals before it have left: the latest time among them, in whole milliseconds, less the delay `late`. saves() drops an action at or
before that mark; flushes() one whose flush is at or before it; latest() drops none, as the order of arrival doesn't matter to the last write. What is dropped
changes nothing. A save comes out once the mark has passed its end, a flush once it has passed its time; what is still open then stays in
the state for the next run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.keyvalue import KeyValue
from .actions import DEBOUNCE, FLUSH

BURSTS = "starts array<bigint>, ends array<bigint>, counts array<bigint>, seqs array<bigint>, payloads array<string>"


def merged(bursts: list[tuple], quiet: int) -> list[tuple]:
    """Bursts (start, end, n, seq, payload), in micros, with those closer than quiet made one; seq and payload are those of the last action."""
    out: list[tuple] = []
    for b in sorted(bursts, key=lambda x: (x[0], x[1], x[3])):
        if out and b[0] < out[-1][1] + quiet:
            a = out[-1]
            last = max((a[1], a[3], a[4] or "", a[4]), (b[1], b[3], b[4] or "", b[4]))
            out[-1] = (a[0], max(a[1], b[1]), a[2] + b[2], last[1], last[3])
        else:
            out.append(b)
    return out


def saves(actions: DataFrame, *key: str, quiet_ms: int = int(DEBOUNCE.split()[0]), late: str = "10 seconds") -> DataFrame:
    """(key, opened, saved_at, n, payload) of a stream of actions (key, ts, seq, payload): one save for each burst of changes, with its last payload.

    A key's state holds its open bursts alone. One that may still be joined by an action that isn't late stays open, so that
    the saves are those of all actions that were taken, in whatever order these came.
    """
    quiet = quiet_ms * 1000
    kinds = dict(actions.dtypes)
    out = ", ".join([*(f"{k} {kinds[k]}" for k in key), "opened bigint, saved_at bigint, n bigint, payload string"])

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bursts = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            for f in frames:
                bursts += [(t, t, 1, s, p) for t, s, p in zip(f["us"].tolist(), f["seq"].tolist(), f["payload"].tolist(), strict=True)]
                bursts = merged(bursts, quiet)
        mark = state.getCurrentWatermarkMs() * 1000
        done = [b for b in bursts if b[1] + quiet <= mark]
        still = [b for b in bursts if b[1] + quiet > mark]
        if still:
            state.update(tuple(list(c) for c in zip(*still, strict=True)))
            state.setTimeoutTimestamp(-(-(min(b[1] for b in still) + quiet) // 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*own, a, b + quiet, n, p) for a, b, n, _, p in done], columns=[*key, "opened", "saved_at", "n", "payload"])

    rows = actions.withWatermark("ts", late).select(*key, "ts", F.unix_micros("ts").alias("us"), "seq", "payload")
    found = rows.groupBy(*key).applyInPandasWithState(step, out, BURSTS, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumns({c: F.timestamp_micros(c) for c in ("opened", "saved_at")})


def flushes(actions: DataFrame, *key: str, every: str = FLUSH, late: str = "10 seconds") -> DataFrame:
    """(key, flushed_at, n): what each periodic flush drains of a stream of actions."""
    t = actions.withWatermark("ts", late).groupBy(*key, F.window("ts", every).alias("w")).agg(F.count("*").alias("n"))
    return t.select(*key, F.col("w.end").alias("flushed_at"), "n")


def latest(actions: DataFrame, key: str, store: KeyValue) -> Callable[[DataFrame, int], None]:
    """What a stream's batches do to a store: each key has the payload of its last action by (ts, seq), whatever the batch it came in. A batch that runs again writes the same."""

    def take(batch: DataFrame, number: int) -> None:
        order = F.unix_micros("ts").cast("decimal(38,0)") * (1 << 62) + F.col("seq")
        last = batch.groupBy(F.col(key).cast("string").alias("key")).agg(F.max_by("payload", order).alias("value"), F.max(order).alias("seq"))
        store.append(last.select("seq", F.lit("put").alias("op"), "key", "value"), number)

    return take


def arrive(spark: SparkSession, arrivals: list[DataFrame], top: str, flow: Callable[[DataFrame], DataFrame] | None, batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Run a stream over arrivals: each is put into the queue below the folder top, then the stream starts, takes what is new and stops. The
    next run goes on from the checkpoint, its state included. Gives the rows that all runs have put out, or None where a function takes the batches."""
    for part in arrivals:
        part.write.mode("append").parquet(f"{top}/queue")
        stream = spark.readStream.schema(part.schema).parquet(f"{top}/queue")
        out = flow(stream) if flow else stream
        writer = out.writeStream.option("checkpointLocation", f"{top}/state").trigger(availableNow=True)
        writer = writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", f"{top}/out").outputMode("append")
        writer.start().awaitTermination()
    return None if batch else spark.read.parquet(f"{top}/out")
