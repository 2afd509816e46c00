"""What the operators of this package share: the shared folder, materialised tables, size-checked broadcasts, row keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured size is below this; beyond it the join shuffles.
BROADCAST_BYTES = 24 << 20
#: A list of rows that go is broadcast up to this many bytes, as held in memory (without()).
LIST_BYTES, LIST_ROW = 4 << 20, 170
#: The bitmap of a longer list has at most this many blocks (a power of two) of 4 KB.
BLOCKS = 1024
#: Arrow batches sent to Python hold at most this many bytes, and rows.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset (tests, one machine) a temporary one is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base


#: The tables that this process has written.
_written: list[str] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back. A lost executor costs no recomputation of what is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Remove the tables that materialize() has written so far; gives their number. Results that are still to be read from them are lost: call it once these are written."""
    done, jvm = 0, spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return done


def bounded(spark: SparkSession) -> None:
    """Bound the memory that a batch of rows takes in a Python worker, whatever the length of the texts. The two settings hold for the session from then on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def broadcast_if_small(df: DataFrame, size: Column | int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if the sum of size over its rows is at most limit. df should be materialised: it is read once more here."""
    total = df.agg(F.sum(size if isinstance(size, Column) else F.lit(size))).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, text): the columns an operator works on, whatever else docs holds. id and th (a hash of the text) name a row;
    rows equal in both are interchangeable. A null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """The condition that joins tables of keyed(); null ids match."""
    return a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    bounded(df.sparkSession)
    return df.mapInArrow(fn, schema)


def pieces(schema: pa.Schema, rows: list[tuple], at_most: int = 5000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most at_most rows."""
    for k in range(0, len(rows), at_most):
        part = rows[k : k + at_most]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], f.type) for i, f in enumerate(schema)], schema=schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bitmap(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, sieve): the bits of keys (key: bigint), a materialised table, in at most `blocks` blocks (a power of two) of 4 KB, however many they are."""
    bits = keys.selectExpr(f"cast(key & {blocks - 1} as int) AS block", "cast(shiftright(key, 16) & 511 as int) AS word", "shiftleft(1L, cast(shiftright(key, 32) & 63 as int)) AS bits")
    zeros = bits.select("block").distinct().selectExpr("block", "explode(sequence(0, 511)) AS word", "0L AS bits")
    words = bits.unionByName(zeros).groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words")).selectExpr("block", "transform(words, x -> x.bits) AS sieve")


def in_bitmap(key: str, blocks: int, block: str = "block", sieve: str = "sieve") -> tuple[Column, Column]:
    """Conditions: that a key belongs to a block of bitmap(), and that its bit is set there."""
    return F.expr(f"cast({key} & {blocks - 1} as int) = {block}"), F.expr(f"getbit({sieve}[cast(shiftright({key}, 16) & 511 as int)], cast(shiftright({key}, 32) & 63 as int)) = 1")


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose (id, th) isn't in gone, a materialised table, with all columns as they are. Beyond LIST_BYTES a bitmap of
    gone goes to all tasks in its place; only the rows that it holds (all that go, and few others) are shuffled."""
    a, b = fresh(docs, "gone_id"), fresh(docs, "gone_th")
    listed = gone.select(F.col("id").alias(a), F.col("th").alias(b))

    def left(rows: DataFrame, listed: DataFrame) -> DataFrame:
        th = F.xxhash64(F.coalesce(rows[text_col].cast("string"), F.lit("")))
        return rows.join(listed, rows[id_col].eqNullSafe(F.col(a)) & (th == F.col(b)), "left_anti")

    if gone.count() * LIST_ROW <= LIST_BYTES:
        return left(docs, F.broadcast(listed))
    key, block, sieve, held = (fresh(docs, f"gone_{x}") for x in ("key", "block", "sieve", "held"))
    bits = materialize(bitmap(gone.select(F.xxhash64("id", "th").alias("key")), BLOCKS), "bitmap").toDF(block, sieve)
    there, bit = in_bitmap(key, BLOCKS, block, sieve)
    th = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    marked = docs.withColumn(key, F.xxhash64(docs[id_col], th)).join(F.broadcast(bits), there, "left").withColumn(held, F.coalesce(bit, F.lit(False)))
    asked = left(marked.filter(held).select(*docs.columns), listed.hint("shuffle_hash"))
    return marked.filter(~F.col(held)).select(*docs.columns).unionByName(asked)
