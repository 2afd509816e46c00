"""Long keys in many tasks, order statistics, alignment in little memory: against the plain forms."""

from __future__ import annotations

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import alignment as A
from tessera.operators import intervals as I
from tessera.operators.segments import order_statistics

INF = float("inf")


def merged(spans, gap):
    out = []
    for a, b in sorted(spans):
        if out and not a - out[-1][1] > gap:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


@pytest.mark.parametrize(("width", "longest"), [(3.0, 2), (3.0, 40), (1000.0, 5), (0.5, 3)])
def test_islands_across_chunks(spark, width, longest):
    rng = random.Random(longest)
    spans = {k: [(x := rng.randrange(400) / 4, x + rng.randrange(4 * longest) / 4) for _ in range(n)] for k, n in (("a", 60), ("b", 1), (None, 25))}
    rows = spark.createDataFrame([(k, a, b) for k, s in spans.items() for a, b in s] + [("a", None, 1.0), ("c", 1.0, None)], "k string, start double, end double")
    got = sorted(map(repr, map(tuple, I.merge_nearby(rows, "k", gap=0.5, width=width).collect())))
    assert got == sorted(repr((k, a, b)) for k, s in spans.items() for a, b in merged(s, 0.5))


def test_one_recording_is_the_work_of_many_tasks(spark):
    """No window over the frames has the recording alone as its key."""
    frames = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("frame"), (F.hash("id") % 3 != 0).alias("loud"))
    got = A.vad_intervals(frames, "k", min_speech_ms=50, min_gap_ms=20, width=500)
    w = Window.partitionBy("k").orderBy("frame")
    new = F.coalesce(F.col("frame") - F.lag("frame").over(w) > 2, F.lit(True)).cast("int")
    plain = frames.filter("loud").withColumn("p", new).withColumn("p", F.sum("p").over(w)).groupBy("p").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    plain = plain.withColumn("b", F.when(19_999 - F.col("b") < 2, 20_000).otherwise(F.col("b"))).filter("b - a >= 5")
    assert sorted((round(r.start, 6), round(r.end, 6)) for r in got.collect()) == sorted((round(r.a * 0.01, 6), round(r.b * 0.01, 6)) for r in plain.collect())
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window " in x]
    over_rows = [x for x in windows if "max(frame" in x or "sum(_new" in x]
    assert over_rows and all("_c#" in x.split("[k#")[-1].split("]")[0] for x in over_rows)


VALUES = {
    "ties": [3.0] * 40 + [1.0, 2.0], "one": [-0.5], "wide": [10.0**k * s for k in range(-300, 300, 7) for s in (1, -1)], "tiny": [5e-324 * k for k in range(50)], "signs": [0.0, -0.0, 1.0, -1.0],
    "infinite": [INF, -INF, 0.0, 1e308, -1e308], "near": [1 + k * 2.0**-52 for k in range(300)],
}


def test_order_statistics(spark):
    rng = random.Random(9)
    values = VALUES | {"random": [rng.gauss(0, 1) for _ in range(3000)], None: [2.0, 1.0]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("ties", None), ("near", float("nan")), ("none", None)]
    rng.shuffle(rows)
    shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.999}
    table = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in order_statistics(table, "k", value="v", shares=shares).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        assert got[k].n == len(vs)
        assert [got[k][s] for s in shares] == [sorted(vs)[math.floor(len(vs) * p)] for p in shares.values()], k
    assert order_statistics(table.limit(0), "k", value="v", shares=shares).count() == 0


def plain_align(cost, n, m):
    """The whole table, and the way back through it."""
    best = np.zeros((n + 1, m + 1))
    best[0, 1:], best[1:, 0] = np.cumsum(cost.skip_interval), np.cumsum(cost.skip_target)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i, j] = min(best[i - 1, j - 1] + cost.match(i - 1, j - 1), best[i - 1, j] + cost.skip_target[i - 1], best[i, j - 1] + cost.skip_interval[j - 1])
    out, i, j = [], n, m
    while i or j:
        ways = [best[i - 1, j - 1] + cost.match(i - 1, j - 1) if i and j else INF, best[i - 1, j] + cost.skip_target[i - 1] if i else INF, best[i, j - 1] + cost.skip_interval[j - 1] if j else INF]
        k = 2 if not i else 1 if not j else int(np.argmin(ways))
        if k == 0:
            out.append((i - 1, j - 1))
        i, j = i - (k != 2), j - (k != 1)
    return out[::-1]


@pytest.mark.parametrize("seed", range(12))
def test_alignment_has_the_ties_of_the_whole_table(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 40, 2)
    weights, hints = rng.integers(1, 3, n).astype(float), rng.random(n) < 0.3
    starts = np.cumsum(rng.integers(1, 4, m) * 0.25) + np.arange(m) * 0.25
    spans = [(float(a), float(a) + 0.25) for a in starts]
    cost = A.Costs(weights, hints, spans)
    assert A.Table(cost, int(n), int(m)).path() == plain_align(cost, int(n), int(m))


def test_alignment_of_thousands_takes_little_memory():
    n = 3000
    spans = [(k * 0.5, k * 0.5 + 0.3) for k in range(n)]
    tracemalloc.start()
    found = A.align(np.ones(n), np.zeros(n, bool), spans)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == n and peak < 30 << 20


def test_near_intervals_are_one_before_they_are_aligned():
    got = A.regions_of(4.0, [(0.0, 0.5), (0.6, 1.0), (3.0, 4.0)], np.ones(2), np.ones(2), np.zeros(2, bool))
    assert [(a, b) for a, b, *_ in got] == [(0.0, 1.0), (3.0, 4.0)]
