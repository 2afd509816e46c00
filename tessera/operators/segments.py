"""Computations along an order (time, samples) that split one long key over many tasks: islands of near intervals, exact order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: Buckets that a round of order_statistics() cuts a stretch of values into.
BUCKETS = 256
#: Rows up to which the list of stretches still sought is broadcast; a row is a key and five numbers.
FEW = 100_000


def islands(rows: DataFrame, *key: str, width: float, start: str = "start", end: str = "end", gap: float = 0.0) -> DataFrame:
    """rows with island: equal for rows of a key whose intervals follow one another at gaps of at most `gap`, directly or through others.

    A key is cut into chunks of `width` along start, each a task's own work. What a chunk has to know of the ones before it is two values: how far
    they reach, and the last island that begins in one of them. These come from a row for each chunk, so the only windows over a whole key are over
    its chunks. Rows without a start or an end are left out.
    """
    t = rows.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_c", F.floor(F.col(start) / width))
    chunk = [*key, "_c"]
    before = Window.partitionBy(*key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    reach = t.groupBy(*chunk).agg(F.max(end).alias("_m")).select(*chunk, F.max("_m").over(before).alias("_reach"))
    w = Window.partitionBy(*chunk).orderBy(start, end)
    far = F.greatest("_reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    t = _with(t, reach, chunk).withColumn("_new", F.coalesce(F.col(start) - far > gap, F.lit(True)).cast("bigint"))
    t = t.withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    open_ = t.groupBy(*chunk).agg(F.max("_k").alias("_last")).select(*chunk, F.last(F.when(F.col("_last") > 0, F.struct("_c", F.col("_last").alias("_k"))), ignorenulls=True).over(before).alias("_open"))
    # Rows before the first island that begins in their chunk go on with the last one from before.
    out = _with(t, open_, chunk).withColumn("island", F.when(F.col("_k") > 0, F.struct("_c", "_k")).otherwise(F.col("_open")))
    return out.drop("_c", "_reach", "_new", "_k", "_open")


def _with(rows: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """rows joined with one row for each key; null keys match."""
    other = more.withColumnsRenamed({k: f"_r_{k}" for k in key})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in key]
    joined = rows.join(other, same, "left")
    return joined.drop(*[f"_r_{k}" for k in key])


def _exponent(v: Column) -> Column:
    """The order of magnitude of a number with its sign, in the order of the numbers: what the upper bits of a float say."""
    size = F.when(F.abs(v) == float("inf"), F.lit(4000)).otherwise(F.floor(F.log2(F.abs(v))) + 1100)
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)


def order_statistics(rows: DataFrame, *key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, n, and a column for each of shares): the value at place floor(n * share) of a key's n values in ascending order, exactly. Nulls and NaN aren't counted; a key without values has no row.

    Radix selection: values are counted by order of magnitude, then within the stretch that holds the place by BUCKETS parts of
    it, until a stretch has one value. A round sends a count for each bucket, key and task, however many values there are; no key's values are gathered or sorted.
    """
    v = written(rows.select(*key, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)"), "values")
    sizes = v.groupBy(*key).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    sought = F.explode(F.array(*[F.struct(F.lit(name).alias("_q"), F.floor(F.col("n") * share).alias("_at")) for name, share in shares.items()]))
    active = written(sizes.select(*key, "n", "_lo", "_hi", sought.alias("s")).select(*key, "n", "s.*", "_lo", "_hi"), "sought")
    done, first = [], True
    while True:
        done.append(active.filter("_lo = _hi").select(*key, "n", "_q", F.col("_lo").alias("_v")))
        active = active.filter("_lo < _hi")
        if not (left := active.count()):
            break
        side = active.withColumnsRenamed({k: f"_r_{k}" for k in key})
        same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in key] + [F.col("_v") >= F.col("_lo"), F.col("_v") <= F.col("_hi")]
        # After the first round a stretch has one order of magnitude and sign, so its length is a number above 0.
        part = _exponent(F.col("_v")) if first else F.least(F.lit(BUCKETS - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BUCKETS))
        hits = v.join(F.broadcast(side) if left <= FEW else side, same)
        counts = hits.groupBy(*key, "n", "_q", "_at", part.alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_c").over(Window.partitionBy(*key, "_q").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        found = counts.withColumn("_u", upto).filter((F.col("_at") < F.col("_u")) & (F.col("_at") >= F.col("_u") - F.col("_c")))
        active = written(found.select(*key, "n", "_q", (F.col("_at") - F.col("_u") + F.col("_c")).alias("_at"), "_lo", "_hi"), "sought")
        first = False
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.groupBy(*key, "n").agg(*[F.max(F.when(F.col("_q") == name, F.col("_v"))).alias(name) for name in shares])
