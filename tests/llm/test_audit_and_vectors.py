"""Filter audit, exact search and vector codes: odd rows, ties, empty tables, and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, topk, vector_codes
from tessera.llm.vectors import exact

VECTORS = "vec_id bigint, embedding array<float>, label int, ints string, key string, id string, block string, codes string, error string"
NAN, INF = float("nan"), float("inf")


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, *"abcdef") for r in rows], VECTORS)


def audit_by_hand(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    docs = []
    for i, t, source in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t))]
        bad.append(i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))
        docs.append((source or "", bad, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations(range(5)):
            left = [d for d in docs if d[0] == part]
            gone = []
            for k, f in enumerate(order):
                removed = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                key = part, "".join("ABCDE"[x] for x in order), k + 1
                out[key] = [len(left), len(removed), sum(d[1][f] for d in gone), sum(d[1][f] and sum(d[1]) == 1 for d in docs if d[0] == part), sum(d[2] for d in removed), sum(d[3] for d in removed), f]
                shapley[part, f] += len(removed)
                gone += removed
    return {k: (*v[:6], shapley[k[0], v[6]]) for k, v in out.items()}


def test_audit(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        words = [rng.choice(("alpha", "Beta", "c#", "GAMMA", "dee") if rng.random() < 0.3 else [f"w{rng.randrange(200)}"]) for _ in range(rng.choice((0, 3, 49, 50, 51, 90)))]
        text = rng.choice((" ", "\n", "\x0b ")).join(words) + rng.choice(("", " ", "\x85", "é🙂"))
        rows.append((i, rng.choice([None, text, rows[i // 2][1] if rows else ""]), rng.choice(["a", "a", "b", "", None])))
    rows += [rows[3], rows[3], (None, rows[3][1], "a"), (None, "x", None), (400, "Q " * 5000, "c"), (-1, "x", "d")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit(c) for c in ("id", "digest", "part", "bits", "n", "good", "least", "mask")})
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit("x")))
    found = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got.collect()}
    assert got.count() == len(found) == 120 * 5 * len({r[2] or "" for r in rows})
    assert found == audit_by_hand(rows, labels)
    assert filter_audit.filter_audit(docs.limit(0), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).count() == 0
    assert filter_audit.filter_audit(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("n", range(6))
def test_transpositions_visit_each_order_once(n):
    order, seen = list(range(n)), []
    for k in [None, *filter_audit.transpositions(n)]:
        if k is not None:
            order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) == math.factorial(n)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def lists_by_hand(rows, step, k, scale):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows if usable(v)]
    out = Counter()
    for n, (i, v) in enumerate(kept):
        if i is not None and i % step == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for m, (j, w) in enumerate(kept) if m != n)[:k]
            out.update([(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found)])
    return out


def odd_vectors(rng, n, width, copies):
    base = rng.normal(size=(n, width)) * rng.lognormal(0, 0.5, n)[:, None]
    rows = [(int(i), [float(x) for x in v], int(i) % 4) for i, v in enumerate(base)]
    hot = rows[1][1]
    rows += [(n + k, hot, None) for k in range(copies)] + [(0, hot, 1), (0, hot, 1), rows[5], rows[5], (None, hot, 2), (None, rows[7][1], None), (-5, rows[7][1], 0), (n + 500, [0.0] * width, 3)]
    return rows + [(n + 600, None, 1), (n + 605, [NAN] * width, 1), (n + 610, [INF, *[0.0] * (width - 1)], 1), (n + 615, [None, *[1.0] * (width - 1)], 1)]


@pytest.mark.parametrize(("block", "copies"), [(1 << 19, 40), (96, 40), (96, 0)])
def test_top_k(spark, block, copies):
    rows = odd_vectors(np.random.default_rng(block), 150, 12, copies)
    got = topk.top_k(vectors_of(spark, rows), F.col("vec_id") % 5 == 0, k=7, block_values=block)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert Counter(map(tuple, got.collect())) == lists_by_hand(rows, 5, 7, 64)


def test_top_k_of_few(spark):
    few = [(0, [1.0, 2.0], 0), (20, [3.0], 0), (40, [], 0), (41, [-1.0, 0.5], 1)]
    got = sorted(map(tuple, topk.top_k(vectors_of(spark, few), F.col("vec_id") % 20 == 0).collect()))
    full = [(i, v + [0.0] * (2 - len(v)), c) for i, v, c in few]
    assert Counter(got) == lists_by_hand(full, 20, 20, 64)
    assert topk.top_k(vectors_of(spark, few).limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(vectors_of(spark, few[:1]), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(vectors_of(spark, few), F.lit(None).cast("boolean")).count() == 0
    huge = topk.top_k(vectors_of(spark, [(0, [3e38, 1.0], 0), (1, [3e38, 2.0], 0), (2, [-3e38, 2.0], 0)]), F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in huge] == [(1, 2**63 - 1), (2, -(2**63))]


def test_most_products_are_pruned():
    """Vectors of unequal length along few directions: few inner products are taken whole, and none that counts is lost."""
    rng = np.random.default_rng(3)
    x = np.floor((rng.normal(size=(4000, 6)) @ rng.normal(size=(6, 48)) + 0.05 * rng.normal(size=(4000, 48))) * rng.lognormal(0, 0.7, 4000)[:, None] * 64).astype(np.int64)
    turn = np.linalg.eigh(x.T.astype(float) @ x)[1][:, ::-1]
    best = topk.Best(np.full(40, -np.inf), 10)
    taken = topk.search(x[:40], x, list(np.arange(4000)[:, None]), np.arange(40), turn, best)
    assert taken < 0.1 * 40 * 4000
    for q in range(40):
        order = np.lexsort((np.arange(4000), -(x @ x[q])))[:10]
        assert best.ids[q].tolist() == order.tolist()
        assert best.own[q].tolist() == (order == q).tolist()


def test_products_beyond_64_bits():
    a = np.array([[2**40, 2**40], [-(2**40), 3]])
    assert exact(a, a).tolist() == [2**63 - 1, 2**63 - 1]
    assert exact(a, np.array([[1, 2], [3, 4]])).tolist() == [3 * 2**40, -3 * 2**40 + 12]


def codes_by_hand(rows, n, entries, rounds, scale):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows if usable(v)]
    width = -(-max(len(v) for _, v, _ in kept) // n)
    kept = [(i, v + [0] * (n * width - len(v)), label) for i, v, label in kept]
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(n)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(n)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda: [[min((far(x, e), k) for k, e in enumerate(books[p])) for p, x in enumerate(cut(v))] for _, v, _ in kept]
    for _ in range(rounds):
        found = nearest()
        for p in range(n):
            for k in range(len(first)):
                mine = [cut(v)[p] for (_, v, _), f in zip(kept, found) if f[p][1] == k]
                if mine:
                    books[p][k] = tuple(sum(c) // len(mine) for c in zip(*mine))
    found = nearest()
    errors = [sum(d for d, _ in f) for f in found]
    total = Counter()
    for (_, _, label), e in zip(kept, errors):
        total[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, total[label], digest) for (i, _, label), f, e in zip(kept, found, errors))


@pytest.mark.parametrize(("n", "entries", "rounds", "width"), [(4, 8, 2, 12), (4, 8, 0, 12), (3, 200, 3, 7), (1, 5, 5, 2)])
def test_vector_codes(spark, n, entries, rounds, width):
    rows = odd_vectors(np.random.default_rng(n), 90, width, 30)
    got = vector_codes.encode(vectors_of(spark, rows), n, entries, rounds).drop("label", "codes")
    assert Counter(map(tuple, got.collect())) == codes_by_hand(rows, n, entries, rounds, 256)


def test_vector_codes_of_few(spark):
    rows = [(3, [0.5, 1.0], None), (1, [], 1), (2, [1e9, -3e38, 1.0], 1)]
    assert Counter(map(tuple, vector_codes.encode(vectors_of(spark, rows[:2])).drop("label", "codes").collect())) == codes_by_hand(rows[:2], 16, 64, 2, 256)
    assert vector_codes.encode(vectors_of(spark, rows)).count() == 3
    assert vector_codes.encode(vectors_of(spark, rows).limit(0)).count() == 0
    assert vector_codes.encode(vectors_of(spark, rows).drop("label")).select("label_error").distinct().count() == 1


def test_only_changes_are_shuffled(spark):
    """Once codes have settled, a round has no contributions; sums kept up to date equal sums of all parts."""
    rows = vectors_of(spark, odd_vectors(np.random.default_rng(8), 60, 4, 0)).filter("vec_id < 60")
    whole = vector_codes.whole_vectors(rows.select(F.col("vec_id").alias("id"), F.lit(None).cast("string").alias("label"), "embedding"), 256, multiple_of=2)
    table = whole.select("id", "label", "ints", F.lit(None).cast("array<int>").alias("codes"))
    last, books = vector_codes.train(table, 2, 4, 20)
    again = vector_codes.recode(last, books)
    assert vector_codes.changes(again, 2, 4, 2).count() == 0
    assert vector_codes.changes(vector_codes.recode(table, books), 2, 4, 2).filter("position = 2").agg(F.sum("sum")).first()[0] == 2 * table.count()
