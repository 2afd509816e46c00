"""Exact search for the largest inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds of the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, broadcast_if_small, materialize
from .vectors import exact, matrix, whole_vectors

#: Components of a block of candidates, and of one of queries, that meet in one task.
BLOCK_VALUES = 1 << 19
#: Queries looked at together, and candidates before a query's bound is raised.
TILE, STRIDE = 512, 1024
#: Shares of the rotated components after which partial sums are compared with the bound.
CUTS = (0.125, 0.375)
#: Share of pairs left from which the rest is summed for all pairs rather than one by one.
DENSE = 0.1
#: The id that stands for none in an order.
LAST = (1 << 63) - 1


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all vectors, by descending singular value: float64[width, width]. Each task sums its own outer products, of width * width numbers."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width).astype(float)
            gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(gram))], names=["row", "sums"])

    parts = arrow_map(vectors.select("ints"), f, "row bigint, sums array<double>").select("row", F.posexplode("sums").alias("column", "v"))
    gram = np.zeros((width, width))
    for r in parts.groupBy("row", "column").agg(F.sum("v").alias("v")).collect():
        gram[r["row"], r["column"]] = r["v"]
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy()


class Best:
    """The best k rows (score, id, own) that each of some queries has found; floor: scores below it can't change its list."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor.astype(float), k
        self.scores, self.ids, self.own = ([np.zeros(0, kind)] * len(floor) for kind in (np.int64, np.int64, bool))

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        s, i, o = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids]), np.concatenate([self.own[q], own])
        first = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q], self.own[q] = s[first], i[first], o[first]
        if len(first) == self.k:
            self.floor[q] = max(self.floor[q], float(s[first[-1]]))


def search(queries: np.ndarray, candidates: np.ndarray, ids: list[np.ndarray], own: np.ndarray, turn: np.ndarray, best: Best) -> int:
    """Bring best up to date with candidates, of which ids has the ids; gives the number of inner products that were taken whole.

    own: for each query the candidate that equals it, or -1. Bounds carry a margin for the rounding of floats, so that no
    pair is lost by it; scores are taken of whole numbers.
    """
    width, taken = queries.shape[1], 0
    length, q_length = (np.sqrt((x.astype(float) ** 2).sum(1)) for x in (candidates, queries))
    order = np.argsort(-length, kind="stable")
    cuts = sorted({max(1, round(width * share)) for share in CUTS} | {width})
    cr, qr = candidates[order] @ turn, queries @ turn
    c_rest, q_rest = ([np.sqrt((x[:, c:] ** 2).sum(1)) for c in cuts] for x in (cr, qr))
    length = length[order]
    for first in range(0, len(queries), TILE):
        for at, end in strides(len(order)):
            some = slice(at, end)
            tile = np.arange(first, min(first + TILE, len(queries)))
            # Lengths alone: what is left is no longer than the first of these, so queries that it can't help are done.
            tile = tile[q_length[tile] * length[at] * (1 + 1e-9) + 1 >= best.floor[tile]]
            if not len(tile):
                break
            floor, margin = best.floor[tile], 1e-9 * width * (1 + q_length[tile] * length[at])
            part = qr[tile, : cuts[0]] @ cr[some, : cuts[0]].T
            a, b = np.nonzero(part + q_rest[0][tile][:, None] * c_rest[0][some] >= (floor - margin)[:, None])
            sums, done = part[a, b], cuts[0]
            for k, cut in enumerate(cuts[1:], 1):
                if not len(a):
                    break
                if len(a) > DENSE * part.size:
                    sums = sums + (qr[tile, done:cut] @ cr[some, done:cut].T)[a, b]
                else:
                    sums = sums + np.einsum("ij,ij->i", qr[tile[a], done:cut], cr[at + b, done:cut])
                stays = sums + q_rest[k][tile[a]] * c_rest[k][at + b] >= (floor - margin)[a]
                a, b, sums, done = a[stays], b[stays], sums[stays], cut
            taken += len(a)
            edges = np.searchsorted(a, np.arange(len(tile) + 1))
            for n in np.flatnonzero(np.diff(edges)):
                q, found = tile[n], order[at + b[edges[n] : edges[n + 1]]]
                score = exact(np.broadcast_to(queries[q], (len(found), width)), candidates[found])
                good = score >= (max(floor[n], np.partition(score, -best.k)[-best.k]) if len(score) > best.k else floor[n])
                found, score = found[good], score[good]
                if len(found):
                    many = [len(ids[c]) for c in found]
                    best.add(q, np.repeat(score, many), np.concatenate([ids[c] for c in found]), np.repeat(found == own[q], many))
    return taken


def strides(n: int) -> Iterator[tuple[int, int]]:
    """Ranges of growing length, up to STRIDE: the first few candidates give a bound to judge the others by."""
    at, size = 0, STRIDE // 16
    while at < n:
        yield at, min(at + size, n)
        at, size = at + size, min(2 * size, STRIDE)


ENTRY = "key binary, score bigint, id bigint, own boolean"


def _meet(turn: np.ndarray, k: int):
    """The entries that one block of candidates gives to the lists of one block of queries."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        asks, has = rows[rows["ask"]], rows[~rows["ask"]]
        queries, candidates = (np.array(x["ints"].tolist(), np.int64).reshape(-1, len(turn)) for x in (asks, has))
        place = {key: n for n, key in enumerate(has["key"])}
        best = Best(asks["floor"].to_numpy(float, na_value=-np.inf), k)
        search(queries, candidates, [np.asarray(v, np.int64) for v in has["ids"]], np.array([place.get(key, -1) for key in asks["key"]]), turn, best)
        keys = np.repeat(asks["key"].to_numpy(object), [len(s) for s in best.scores])
        return pd.DataFrame({"key": keys, **{c: np.concatenate([np.zeros(0, kind), *v]) for c, v, kind in (("score", best.scores, np.int64), ("id", best.ids, np.int64), ("own", best.own, bool))}})

    return f


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """vectors with length, and block: numbers by descending length, of about `size` rows each."""
    n = max(1, -(-vectors.count() // size))
    length = F.sqrt(F.aggregate("ints", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    dealt = vectors.withColumn("length", length).repartitionByRange(n, F.desc("length"), "key")
    return materialize(dealt.withColumn("block", F.spark_partition_id()), "topk-blocks")


def _best(entries: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    return materialize(entries.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r"), "topk-entries")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block_values: int = BLOCK_VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query selects the k other rows of the largest inner product, ties to the smaller id.

    Components are floor(scale * x). Vectors that are null or hold null or non-finite components take no part, neither as
    queries nor as candidates; shorter ones are filled up with zeros. A row of a repeated id is a candidate of the others of that
    id; repeated query rows have a list each. A row without an id is a query only if is_query says so, and comes last among ties.
    With fewer than k others the list has them all. Scores beyond 64 bits saturate. No vectors give no rows. Other columns aren't looked at.

    Equal vectors are one: of n copies the k + 1 of smallest ids are all that any list can hold, and one search answers all
    queries among them. Blocks of candidates, by descending length, meet blocks of queries in rounds of one, one, two,
    four and so on; a query goes on only while its length times that of a block's longest reaches its k-th score so far.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector_col).alias("embedding")), scale)
    rows = materialize(rows.select("id", "asks", "ints", F.unhex(F.sha2(F.to_json("ints").cast("binary"), 256)).alias("key")), "topk-rows")
    if (one := rows.select(F.size("ints")).first()) is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    turn = rotation(rows, one[0])
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_last("id")))
    kept = rows.drop("asks").withColumn("_r", rank).filter(F.col("_r") <= k + 1)
    candidates = blocks(kept.groupBy("key").agg(F.first("ints").alias("ints"), F.collect_list(F.coalesce("id", F.lit(LAST))).alias("ids")), max(1, block_values // len(turn)))
    queries = materialize(candidates.select("key", "ints", "length").join(rows.filter("asks").select("key").distinct(), "key", "left_semi"), "topk-queries")
    part = F.pmod(F.xxhash64("key"), F.lit(max(1, queries.count() * len(turn) // block_values))).cast("int")
    longest = sorted(tuple(r) for r in candidates.groupBy("block").agg(F.max("length")).collect())
    entries, at = None, 0
    while at < len(longest):
        some = longest[at : max(1, 2 * at)]
        asks = queries.withColumn("floor", F.lit(None).cast("bigint"))
        if entries is not None:
            asks = queries.join(entries.groupBy("key").agg(F.when(F.count("*") > k, F.min("score")).alias("floor")), "key", "left")
        # Blocks come by descending length, so those that can help are the first so many.
        near = F.filter(F.lit([b for b, _ in some]), lambda b, n: F.col("floor").isNull() | (F.col("length") * F.get(F.lit([x for _, x in some]), n) * (1 + 1e-9) + 1 >= F.col("floor")))
        asks = asks.select(F.lit(True).alias("ask"), part.alias("part"), F.explode(near).alias("block"), "key", "ints", "floor", F.lit([]).cast("array<bigint>").alias("ids"))
        wanted = materialize(asks.select("part", "block").distinct(), "topk-wanted")
        has = candidates.join(broadcast_if_small(wanted, 16), "block").select(F.lit(False).alias("ask"), "part", "block", "key", "ints", F.lit(None).cast("bigint").alias("floor"), "ids")
        new = asks.unionByName(has).groupBy("block", "part").applyInPandas(_meet(turn, k + 1), ENTRY)
        entries = _best(new if entries is None else entries.unionByName(new), k + 1)
        at += len(some)
    lists = entries.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("down"), "id", "own", "score"))).alias("list"))
    answers = rows.filter("asks").select("key", "id").join(lists, "key")
    mine = F.array_position(F.transform("list", lambda e: e["own"] & (e["id"] == F.coalesce("id", F.lit(LAST)))), True)
    answers = answers.select(F.col("id").alias("query_id"), "list", mine.alias("mine"))
    answers = answers.select("query_id", F.posexplode(F.slice(F.filter("list", lambda e, n: n + 1 != F.col("mine")), 1, k)).alias("n", "e"))
    return answers.select("query_id", (F.col("n") + 1).alias("rank"), F.when(F.col("e.id") != LAST, F.col("e.id")).alias("vec_id"), F.col("e.score").alias("score"))
