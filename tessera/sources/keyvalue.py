"""Mutable keys and values (preferences, the state of a session, a scratch text): an append log of tables, a snapshot, a manifest that is swapped.

Below the folder: log-N (changes, the table of append N), snapshot-N (all changes up to log N, worked out), manifest (which snapshot counts).
A log counts from the moment its table is complete; a snapshot from the moment the manifest names it. So a run that is lost between the two loses nothing: the
logs are still there. One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "seq decimal(38,0), op string, key string, value string"
STATE = "key string, value string, seq decimal(38,0)"


class KeyValue:
    def __init__(self, spark: SparkSession, top: str):
        self.spark, self.top = spark, top.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.top).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.top))

    def append(self, changes: DataFrame, number: int | None = None) -> int:
        """Add changes (seq, op: put, delete or clear, key, value) as one log. Given a number, the log takes its place: a batch that runs again puts the same table there."""
        number = self._next() if number is None else number
        rows = changes.select(F.col("seq").cast("decimal(38,0)").alias("seq"), "op", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
        new = f"{self.top}/_new-{uuid.uuid4().hex}"
        rows.write.parquet(new)
        self._move(new, f"{self.top}/log-{number:012d}")
        return number

    def state(self) -> DataFrame:
        """(key, value, seq): the last put of each key that no later delete of it and no later clear has undone; of equal seq the later of put, delete, clear counts."""
        upto, snapshot = self._manifest()
        logs = [p for n, p in self._logs() if n > upto]
        changes = self.spark.read.schema(CHANGES).parquet(*logs) if logs else self.spark.createDataFrame([], CHANGES)
        if snapshot:
            changes = changes.unionByName(self.spark.read.schema(STATE).parquet(f"{self.top}/{snapshot}").withColumn("op", F.lit("put")))
        rank = F.struct("seq", F.array_position(F.array(*map(F.lit, ("put", "delete", "clear"))), F.col("op")).alias("rank"))
        cleared = changes.filter("op = 'clear'").agg(F.max("seq").alias("cleared"))
        last = changes.filter("op <> 'clear'").groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), rank).alias("l"))
        # One row with one number: of the last clear.
        return last.crossJoin(F.broadcast(cleared)).filter("l.op = 'put' AND (cleared IS NULL OR l.seq > cleared)").select("key", "l.value", "l.seq")

    def get(self, *keys: str) -> DataFrame:
        return self.state().filter(F.col("key").isin(*keys)).select("key", "value")

    def put(self, key: str, value: str) -> int:
        return self._one("put", key, value)

    def delete(self, key: str) -> int:
        return self._one("delete", key, None)

    def clear(self) -> int:
        return self._one("clear", None, None)

    def compact(self) -> None:
        """Work out the state as a snapshot and let the manifest name it; then what it replaces goes. A cleared or deleted key leaves nothing, so no later change may have a smaller seq than those in here."""
        logs, old = self._logs(), self._manifest()[1]
        if not logs:
            return
        name = f"snapshot-{logs[-1][0]:012d}-{uuid.uuid4().hex}"
        self.state().write.parquet(f"{self.top}/{name}")
        new = self._path(f"{self.top}/_manifest-{uuid.uuid4().hex}")
        out = self._fs.create(new)
        out.write(bytearray(json.dumps([logs[-1][0], name]).encode()))
        out.close()
        self._swap(new)
        for gone in [p for _, p in logs] + ([f"{self.top}/{old}"] if old else []):
            self._fs.delete(self._path(gone), True)

    def _one(self, op: str, key: str | None, value: str | None) -> int:
        last = self.state().agg(F.max("seq")).first()[0]
        logged = [self.spark.read.schema(CHANGES).parquet(p).agg(F.max("seq")).first()[0] for _, p in self._logs()]
        seq = max((x for x in [last, *logged] if x is not None), default=0) + 1
        return self.append(self.spark.createDataFrame([(int(seq), op, key, value)], "seq bigint, op string, key string, value string"))

    def _logs(self) -> list[tuple[int, str]]:
        """(number, path) of the complete logs, in order."""
        found = [x.getPath() for x in self._fs.listStatus(self._path(self.top))]
        return sorted((int(p.getName()[4:]), p.toString()) for p in found if p.getName().startswith("log-"))

    def _next(self) -> int:
        logs = self._logs()
        return max(logs[-1][0] if logs else -1, self._manifest()[0]) + 1

    def _manifest(self) -> tuple[int, str | None]:
        """The last log that the snapshot holds, and the snapshot."""
        found = sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(self.top)) if x.getPath().getName().startswith("manifest-"))
        if not found:
            return -1, None
        upto, name = self.spark.read.text(f"{self.top}/{found[-1]}").select(F.from_json("value", "array<string>")).first()[0]
        return int(upto), name

    def _swap(self, new) -> None:
        """Manifests are numbered, so that each comes to be by one rename; the highest counts and older ones go."""
        old = sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(self.top)) if x.getPath().getName().startswith("manifest-"))
        number = int(old[-1][9:]) + 1 if old else 0
        if not self._fs.rename(new, self._path(f"{self.top}/manifest-{number:012d}")):
            raise OSError("the manifest can't be put in place")
        for name in old:
            self._fs.delete(self._path(f"{self.top}/{name}"), False)

    def _move(self, new: str, to: str) -> None:
        self._fs.delete(self._path(to), True)
        if not self._fs.rename(self._path(new), self._path(to)):
            raise OSError(f"{to} can't be put in place")


def with_defaults(state: DataFrame, defaults: DataFrame) -> DataFrame:
    """(key, value, own): the values of state, and for other keys those of defaults (key, value); a null value in state counts. own: whether state has the key."""
    mine = state.select("key", F.col("value").alias("_v"), F.lit(True).alias("own"))
    return defaults.join(mine, "key", "full_outer").select("key", F.when(F.col("own"), F.col("_v")).otherwise(F.col("value")).alias("value"), F.coalesce("own", F.lit(False)).alias("own"))
