"""Speech detection and alignment of text sections to intervals: one recording is one row, with its targets in a list."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segments import islands, order_statistics

INTERVALS = "array<struct<start:double,end:double>>"
REGION = "start double, end double, target_index int, confidence double, method string"


def frame_energies(pcm: np.ndarray, rate: int) -> np.ndarray:
    """Root mean squares of 30 ms frames, 10 ms apart."""
    win, hop = max(1, math.floor(rate * 0.03 + 0.5)), max(1, math.floor(rate * 0.01 + 0.5))
    if len(pcm) < win:
        return np.zeros(0)
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(pcm, float) ** 2, win)[::hop]
    return np.sqrt(frames.mean(1))


def threshold(energies: np.ndarray) -> float:
    rank = np.sort(energies)
    at = lambda p: rank[math.floor(len(rank) * p)]
    return max(at(0.05) * 3.5, at(0.15) * 1.5, at(0.5) * 0.2, 0.005)


def speech(pcm: np.ndarray, rate: int, min_speech_ms: int = 200, min_gap_ms: int = 250) -> list[tuple[float, float]]:
    """Stretches above the threshold. One closed by silence ends at its last loud hop, one still open at the end of the signal ends there."""
    energies = frame_energies(pcm, rate)
    if not len(energies):
        return []
    loud = np.flatnonzero(energies > threshold(energies))
    if not len(loud):
        return []
    gap, least = round(min_gap_ms / 10), round(min_speech_ms / 10)
    cut = np.flatnonzero(np.diff(loud) > gap)
    starts, ends = loud[np.concatenate([[0], cut + 1])], loud[np.concatenate([cut, [len(loud) - 1]])]
    if len(energies) - 1 - ends[-1] < gap:
        ends = np.append(ends[:-1], len(energies))
    return [(s * 0.01, e * 0.01) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e - s >= least]


def _signals(kind: str, one: Callable[[np.ndarray, int], object], pcm: Column | str, rate: Column) -> Column:
    def f(signals: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else one(p, int(r)) for p, r in zip(signals, rates, strict=True)], dtype=object)

    f.__annotations__ = {"signals": pd.Series, "rates": pd.Series, "return": pd.Series}
    return F.pandas_udf(f, kind)(pcm, rate)


def detect_speech(pcm: Column | str, rate: Column) -> Column:
    return _signals(INTERVALS, lambda p, r: [{"start": a, "end": b} for a, b in speech(p, r)], pcm, rate)


def rms_energy(pcm: Column | str, rate: Column) -> Column:
    return _signals("array<double>", frame_energies, pcm, rate)


def frame_sizes(rate: int) -> tuple[int, int]:
    """Samples of a frame of 30 ms, and of the 10 ms between frames."""
    return max(1, math.floor(rate * 0.03 + 0.5)), max(1, math.floor(rate * 0.01 + 0.5))


def energy_table(samples: DataFrame, *key: str, rate: int, index: str = "i", value: str = "v") -> DataFrame:
    """(key, frame, energy) of signals given as a row per sample: a sample adds to the few frames it lies in, so sums are combined before the shuffle."""
    win, hop = frame_sizes(rate)
    frames = F.sequence(F.greatest(F.lit(0), F.ceil((F.col(index) - (win - 1)) / hop)), F.floor(F.col(index) / hop))
    parts = samples.select(*key, F.explode(frames).alias("frame"), F.col(value).alias("_v"))
    sums = parts.groupBy(*key, "frame").agg(F.sum(F.col("_v") * F.col("_v")).alias("_sum"), F.count("*").alias("_n"))
    return sums.filter(F.col("_n") == win).select(*key, "frame", F.sqrt(F.col("_sum") / win).alias("energy"))


# Shares of frames, and what their energies are multiplied with for the threshold.
LOUD_SHARES = {"p05": (0.05, 3.5), "p15": (0.15, 1.5), "p50": (0.5, 0.2)}


def loud_frames(energies: DataFrame, *key: str) -> DataFrame:
    """energies with `loud`: above the threshold that three order statistics of the recording give."""
    marks = order_statistics(energies, *key, value="energy", shares={name: share for name, (share, _) in LOUD_SHARES.items()})
    least = F.greatest(*[F.col(name) * times for name, (_, times) in LOUD_SHARES.items()], F.lit(0.005))
    marks = marks.select(*key, least.alias("_least"))
    return energies.join(marks, list(key)).withColumn("loud", F.col("energy") > F.col("_least")).drop("_least")


#: Frames that one task looks at: eleven minutes.
FRAMES = 1 << 16


def vad_intervals(frames: DataFrame, *key: str, min_speech_ms: int = 200, min_gap_ms: int = 250, width: int = FRAMES) -> DataFrame:
    """(key, start, end) of stretches of loud frames (key, frame, loud): silence of min_gap_ms closes one at its last loud frame; one still open at the end
    of the signal ends there; shorter ones than min_speech_ms go. A recording is cut into chunks of `width` frames."""
    gap, least = round(min_gap_ms / 10), round(min_speech_ms / 10)
    size = frames.groupBy(*key).agg(F.count("*").alias("_n"))
    found = islands(frames.filter("loud").select(*key, "frame"), *key, width=width, start="frame", end="frame", gap=gap)
    t = found.groupBy(*key, "island").agg(F.min("frame").alias("_a"), F.max("frame").alias("_b")).join(size, list(key))
    t = t.withColumn("_b", F.when(F.col("_n") - 1 - F.col("_b") < gap, F.col("_n")).otherwise(F.col("_b")))
    return t.filter(F.col("_b") - F.col("_a") >= least).select(*key, (F.col("_a") * 0.01).alias("start"), (F.col("_b") * 0.01).alias("end"))


def speech_table(samples: DataFrame, *key: str, rate: int, index: str = "i", value: str = "v") -> DataFrame:
    """(key, start, end): detect_speech() for signals given as a row per sample."""
    return vad_intervals(loud_frames(energy_table(samples, *key, rate=rate, index=index, value=value), *key), *key)


def alignment_figures(regions: DataFrame, intervals: DataFrame, *key: str) -> DataFrame:
    """(key, matched, avg_confidence, intervals, avg_duration, unused_intervals) of the regions that were matched with a recording's intervals; nothing for one without regions."""
    found = regions.groupBy(*key).agg(F.count("*").alias("matched"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("avg_confidence"))
    have = intervals.groupBy(*key).agg(F.count("*").alias("intervals"), F.avg(F.greatest(F.lit(0.01), F.col("end") - F.col("start"))).alias("avg_duration"))
    out = found.join(have, list(key), "left").withColumn("intervals", F.coalesce("intervals", F.lit(0)))
    return out.withColumn("unused_intervals", F.greatest(F.lit(0), F.col("intervals") - F.col("matched")))


def expected_boundaries(first: Column, last: Column, shares: Column) -> Column:
    """The times of boundaries from their shares (0 to 1) of the stretch from first to last."""
    return F.transform(shares, lambda x: first + x * (last - first))


def peaks(samples: DataFrame, *key: str, index: str = "i", value: str = "v", points: int = 6000) -> DataFrame:
    """(key, bucket, peak): the largest magnitude of each of about `points` buckets."""
    n = samples.groupBy(*key).agg(F.max(index).alias("_n"))
    width = F.greatest(F.lit(1), F.floor((F.col("_n") + 1) / points))
    return samples.join(n, list(key)).groupBy(*key, F.floor(F.col(index) / width).alias("bucket")).agg(F.max(F.abs(value)).alias("peak"))


def mono_table(samples: DataFrame, *key: str, index: str = "i", value: str = "v") -> DataFrame:
    """(key, i, v) of signals given as a row for each sample and channel: the mean of a sample's channels."""
    return samples.groupBy(*key, index).agg(F.avg(value).alias(value))


def mono_mix(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def energy_percentiles(energies: Column) -> Column:
    """Order statistics: the value at floor(n * p), not interpolated."""
    rank = F.sort_array(energies)
    at = lambda p: F.get(rank, F.floor(F.size(rank) * p).cast("int"))
    return F.struct(at(0.05).alias("p05"), at(0.15).alias("p15"), at(0.5).alias("p50"))


class Costs:
    """Costs of matching target i with interval j, and of leaving either out."""

    def __init__(self, weights: np.ndarray, hints: np.ndarray, intervals: list[tuple[float, float]]):
        start, end = np.array(intervals, float).T
        span = max(0.05, end[-1] - start[0])
        edges = start[0] + np.concatenate([[0], np.cumsum(weights)]) / (weights.sum() or len(weights)) * span
        self.duration = np.maximum(0.01, end - start)
        before = np.concatenate([[0.0], np.maximum(0, start[1:] - end[:-1])])
        after = np.append(before[1:], 0.0)
        mean = self.duration.mean()
        expected = weights / (weights.sum() or len(weights)) * span
        self.expected = np.maximum(0.03, np.where(expected > 0, expected, mean or 0.3))
        self.mid, self.place, self.span, self.hints = (start + end) / 2, (edges[:-1] + edges[1:]) / 2, span, np.asarray(hints, bool)
        self.pause, self.wide = np.where(after >= 0.16, -0.18, 0.24), np.where(np.maximum(before, after) >= 0.2, 0.1, 0.0)
        self.skip_target = 0.62 + np.minimum(1.45, np.where(weights > 0, weights, 1) * 0.25)
        self.skip_interval = 0.45 + np.minimum(0.9, self.duration / (mean + 0.03) * 0.4)

    def match(self, i: np.ndarray | int, j: np.ndarray | int) -> np.ndarray | float:
        """The costs of matching targets i with intervals j, pair by pair."""
        size = np.abs(np.log((self.duration[j] + 0.04) / (self.expected[i] + 0.04)))
        place = np.abs(self.mid[j] - self.place[i]) / self.span
        return np.maximum(0, 1.35 * size + 0.95 * place + np.where(self.hints[i], self.pause[j], 0.0) - self.wide[j])


class Table:
    """The table of least costs, by its diagonals: each follows from the two before it. Every few hundredth pair is kept, so that any stretch of diagonals can be worked out
    again, to the same numbers: memory grows with the root of the table's size times its side, and ties fall as in a table held whole."""

    def __init__(self, cost: Costs, n: int, m: int):
        self.cost, self.n, self.m = cost, n, m
        self.rows, self.columns = np.append(0.0, np.cumsum(cost.skip_target)), np.append(0.0, np.cumsum(cost.skip_interval))
        self.every = max(2, math.isqrt(n + m))
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        two, one = np.zeros(n + 1), np.zeros(n + 1)
        for d in range(1, n + m + 1):
            if (d - 1) % self.every == 0:
                self.kept[d - 1] = two, one
            two, one = one, self.following(d, two, one)[0]

    def following(self, d: int, two: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
        """Diagonal d (by row), from the two before it; its first row inside the table, and the steps from there on: 0 a match, 1 a target left out, 2 an interval."""
        low, high = max(1, d - self.m), min(self.n, d - 1)
        out, steps = np.empty(self.n + 1), np.zeros(0, np.int8)
        if low <= high:
            i = np.arange(low, high + 1)
            j = d - i
            ways = np.stack([two[low - 1 : high] + self.cost.match(i - 1, j - 1), one[low - 1 : high] + self.cost.skip_target[i - 1], one[low : high + 1] + self.cost.skip_interval[j - 1]])
            steps = ways.argmin(0).astype(np.int8)
            out[low : high + 1] = ways[steps, np.arange(len(i))]
        if d <= self.m:
            out[0] = self.columns[d]
        if d <= self.n:
            out[d] = self.rows[d]
        return out, low, steps

    def path(self) -> list[tuple[int, int]]:
        """The matches (row, column) on the way back from the last cell, in order."""
        out, i, j = [], self.n, self.m
        for start in sorted(self.kept, reverse=True):
            two, one = self.kept.pop(start)
            found = []
            for d in range(start + 1, min(start + self.every, self.n + self.m) + 1):
                new, low, steps = self.following(d, two, one)
                two, one = one, new
                found.append((low, steps))
            while i + j > start:
                low, steps = found[i + j - start - 1]
                k = 2 if i == 0 else 1 if j == 0 else steps[i - low]
                if k == 0:
                    out.append((i - 1, j - 1))
                i, j = i - (k != 2), j - (k != 1)
        return out[::-1]


def align(weights: np.ndarray, hints: np.ndarray, intervals: list[tuple[float, float]]) -> list[tuple[int, int, float]]:
    """(target, interval, cost) of the cheapest alignment in order; of equal costs a match goes before leaving out a target, that before an interval.
    Neighbours are then swapped where that is clearly cheaper."""
    if not len(weights) or not len(intervals):
        return []
    cost = Costs(weights, hints, intervals)
    out = [[i, j, float(cost.match(i, j))] for i, j in Table(cost, len(weights), len(intervals)).path()]
    for a, b in zip(out, out[1:], strict=False):
        if abs(a[0] - b[0]) == 1:
            first, second = float(cost.match(b[0], a[1])), float(cost.match(a[0], b[1])) + 0.12
            if first + second + 0.1 < a[2] + b[2]:
                a[0], b[0], a[2], b[2] = b[0], a[0], first, second
    return [tuple(x) for x in out]


def pick_boundaries(times: list[float], desired: list[float]) -> list[float]:
    """For each desired time one of the candidate times, in order, at the least sum of squared differences."""
    if not desired or len(times) < len(desired):
        return list(desired)
    t = np.array(times)
    total, back = (t - desired[0]) ** 2, []
    for d in desired[1:]:
        low = np.minimum.accumulate(np.concatenate([[np.inf], total[:-1]]))
        first = np.zeros(len(t), int)
        for k in range(1, len(t)):
            first[k] = k - 1 if total[k - 1] < low[k - 1] else first[k - 1]
        back.append(first)
        total = low + (t - d) ** 2
    k, out = int(total.argmin()), []
    for first in [*reversed(back), None]:
        out.append(times[k])
        k = int(first[k]) if first is not None else k
    return out[::-1]


def boundary_times(duration: float, intervals: list[tuple[float, float]] | None, syllables: np.ndarray) -> tuple[list[float], np.ndarray]:
    """The middles of the gaps between intervals; the edges of targets in proportion to syllables, over the intervals, or the whole where there are none."""
    share = np.concatenate([[0], np.cumsum(syllables)]) / syllables.sum()
    if not intervals:
        return [], share * duration
    return [(a[1] + b[0]) / 2 for a, b in zip(intervals, intervals[1:], strict=False)], intervals[0][0] + share * (intervals[-1][1] - intervals[0][0])


def joined(intervals: list[tuple[float, float]], gap: float = 0.12) -> list[tuple[float, float]]:
    """Intervals in order, those at most `gap` apart made one: merge_nearby() for the list of one recording."""
    out: list[tuple[float, float]] = []
    for a, b in sorted(intervals):
        if out and a - out[-1][1] <= gap:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def regions_of(duration: float, intervals: list[tuple[float, float]] | None, weights: np.ndarray, syllables: np.ndarray, hints: np.ndarray) -> list[tuple]:
    """(start, end, target, confidence, method): in proportion where there is no signal or no speech; else aligned, or by boundaries near the expected ones."""
    n = len(weights)
    share = np.concatenate([[0], np.cumsum(syllables)]) / syllables.sum()
    if not intervals:
        level, method = (0.34, "no signal") if intervals is None else (0.30, "no speech")
        return [(a * duration, b * duration, i, level, method) for i, (a, b) in enumerate(zip(share, share[1:], strict=False))]
    intervals = joined(intervals)
    found = [(intervals[j][0], intervals[j][1], i, min(0.98, max(0.05, 1 - c / 3)), "aligned") for i, j, c in align(weights, hints, intervals) if intervals[j][1] > intervals[j][0] + 0.01]
    if found:
        return sorted(found)
    middles, edges = boundary_times(duration, intervals, syllables)
    inner = pick_boundaries(middles, edges[1:-1].tolist())
    bounds = [edges[0], *inner, edges[-1]]
    return [(bounds[i], bounds[i + 1], i, 0.52, "boundaries") for i in range(n)]


def _with_targets(recordings: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, duration, speech, targets): a row per recording, with the list of its targets in order."""
    listed = targets.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("syllables", F.lit(0)).cast("double").alias("syllables"), F.coalesce("beats", F.lit(0.0)).cast("double").alias("beats"), F.coalesce("pause_after", F.lit(False)).alias("pause_after")))).alias("targets"))
    return recordings.join(listed, key).select(key, F.col("duration").cast("double").alias("duration"), "speech", "targets")


def _each(rows: DataFrame, one: Callable[[float, list | None, np.ndarray, np.ndarray, np.ndarray], list[tuple]], key: str, schema: str) -> DataFrame:
    """The rows that `one` gives for each row of _with_targets(), after its key; one: of duration, intervals, weights, syllables, pause hints."""
    names = [key, *(c.split(" ")[0] for c in schema.split(", "))]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for k, duration, speech, text in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:]), strict=True):
                syllables = np.array([t["syllables"] for t in text])
                syllables = np.where(syllables > 0, syllables, 1.0)
                beats = np.array([t["beats"] for t in text])
                intervals = None if speech is None else [(s["start"], s["end"]) for s in speech]
                found = one(duration, intervals, np.where(beats > 0, beats, syllables), syllables, np.array([t["pause_after"] for t in text], bool))
                keys += [k.as_py()] * len(found)
                out += found
            kinds = {"double": pa.float64(), "int": pa.int32(), "string": pa.string()}
            columns = [pa.array(c, kinds[x.split(" ")[1]]) for c, x in zip(zip(*out, strict=True) if out else [()] * (len(names) - 1), schema.split(", "), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *columns], names=names)

    return rows.mapInArrow(f, f"{key} {dict(rows.dtypes)[key]}, {schema}")


def auto_align(recordings: DataFrame, targets: DataFrame, key: str = "audio_id") -> DataFrame:
    """Regions of each recording (key, duration, speech: its intervals or null) for its targets (key, ord, syllables, beats, pause_after)."""
    return _each(_with_targets(recordings, targets, key), regions_of, key, REGION)


def boundaries(recordings: DataFrame, targets: DataFrame, key: str = "audio_id") -> DataFrame:
    """(key, n, desired, picked): for each expected boundary between targets the gap of the recording's speech that pick_boundaries takes; tables as for auto_align."""

    def one(duration: float, intervals: list | None, weights: np.ndarray, syllables: np.ndarray, hints: np.ndarray) -> list[tuple]:
        middles, edges = boundary_times(duration, intervals, syllables)
        desired = edges[1:-1].tolist()
        return [(i, d, float(p)) for i, (d, p) in enumerate(zip(desired, pick_boundaries(middles, desired), strict=True))]

    return _each(_with_targets(recordings, targets, key), one, key, "n int, desired double, picked double")
