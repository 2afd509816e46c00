"""Action queues as streams: debounce, periodic flush, the latest state of a cell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

# A save follows the last change by 1.2 s; a flush comes every 30 s.
DEBOUNCE, FLUSH = "1200 milliseconds", "30 seconds"


def debounce(actions: DataFrame, *key: str, quiet: str = DEBOUNCE, late: str = "10 seconds") -> DataFrame:
    """(key, opened, saved_at, n, payload): one save for each burst of changes, with its last payload. Works on tables and streams."""
    source = actions.withWatermark("ts", late) if actions.isStreaming else actions
    t = source.groupBy(*key, F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n"), F.max(F.struct("ts", "seq", "payload")).alias("last"))
    return t.select(*key, F.col("w.start").alias("opened"), F.col("w.end").alias("saved_at"), "n", F.col("last.payload").alias("payload"))


def flush(actions: DataFrame, *key: str, every: str = FLUSH, late: str = "10 seconds") -> DataFrame:
    """(key, flushed_at, n): what each periodic flush drains."""
    source = actions.withWatermark("ts", late) if actions.isStreaming else actions
    t = source.groupBy(*key, F.window("ts", every).alias("w")).agg(F.count("*").alias("n"))
    return t.select(*key, F.col("w.end").alias("flushed_at"), "n")


def latest(actions: DataFrame, *key: str) -> DataFrame:
    """(key, payload): the last write wins."""
    return actions.groupBy(*key).agg(F.max(F.struct("ts", "seq", "payload")).alias("last")).select(*key, F.col("last.payload").alias("payload"))


def drain(spark: SparkSession, path: str, schema: str | StructType, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand every action that has arrived under path to `handle`, in batches, each once; what a run has taken, the next one doesn't."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(spark: SparkSession, parts: list[DataFrame], top: str) -> DataFrame:
    """What each of several runs takes from a queue under the folder top, one run after each part is put in: the columns of the parts, and run."""
    for k, part in enumerate(parts):
        part.write.mode("append").parquet(f"{top}/queue")
        take = lambda batch, _, run=k + 1: batch.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{top}/taken")
        drain(spark, f"{top}/queue", part.schema, f"{top}/state", take).awaitTermination()
    return spark.read.parquet(f"{top}/taken")
