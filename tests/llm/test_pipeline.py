"""The pipeline on the smallest tables: each stage keeps what it should and the last one packs all that is left."""

from __future__ import annotations

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import greedy_tiles, prose, shingles

from tessera.llm import packing, quality
from tessera.llm.common import keyed, materialize, without
from tessera.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    first = docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        new = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert new.dtypes == first.dtypes
            assert new.join(docs, "doc_id", "left_anti").count() == 0
            kept.append(new.count())
        else:
            want = packing.pack(docs).agg(F.sum("length"), F.countDistinct("doc_id")).first()
            assert new.agg(F.sum("length"), F.countDistinct("doc_id")).first() == want
        docs = new
    assert 0 < kept[3] <= kept[2] <= kept[1] <= kept[0] < first.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = first.join(labels.filter("quality = 1"), "doc_id", "left_semi").count()
    after = spark.read.parquet(str(tmp_path / "0"))
    assert after.join(labels.filter("quality = 1"), "doc_id", "left_semi").count() >= 0.97 * good
    assert after.join(labels.filter("quality = 0"), "doc_id", "left_semi").count() == 0


def test_lines_of_any_length(spark):
    docs = spark.createDataFrame([(0, "short\nother", "en", "s", 11), (1, "short\nnew", "en", "s", 9)], "doc_id bigint, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.line_deduplication(spark, docs, SF).orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in got] == [("short\nother", 11), ("new", 3)]


def test_line_stage_sends_no_list_of_lines(spark, monkeypatch):
    """Thousands of repeated lines, each document with some: only the bitmap and at most SENT bytes of places are broadcast."""
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    monkeypatch.setattr("tessera.llm.line_dedup.SENT", 10_000, raising=False)
    texts = ["\n".join(f"line {k} of text {i % 400}, which comes twice" for k in range(5)) + f"\n{i} alone" for i in range(800)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_deduplication(spark, docs, SF).collect()}
    want = {i: t if i < 400 else f"{i} alone" for i, t in enumerate(texts)}
    # Within a text, and in texts of numbers one sign apart, lines are near each other: those of the first stay.
    assert set(got) == set(want) and all(got[i] == (want[i], len(want[i])) for i in range(400, 800)) and got[0][0].startswith(texts[0].split("\n")[0])
    assert sum(sent) <= 1024


def test_stages_send_no_list_of_rows_that_go(spark, monkeypatch):
    """40,000 rows go, which is more than a list that is broadcast may hold: a bitmap at most is sent, and all that should go does, with null and repeated ids and columns of any name."""
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    docs = spark.range(60_000).selectExpr("if(id % 1000 = 0, NULL, id - id % 2) AS doc_id", "if(id % 7 = 0, NULL, concat('text ', id)) AS text", "id AS block", "id AS sieve", "id AS `key`", "id AS gone_id")
    gone = materialize(keyed(docs).filter("pmod(th, 3) > 0").select("id", "th"), "gone")
    got = without(docs, gone)
    assert got.columns == docs.columns and sum(sent) <= 1024 < gone.count()
    listed = {(r.id, r.th) for r in gone.collect()}
    want = [tuple(r)[:-1] for r in docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit("")))).collect() if (r.doc_id, r.th) not in listed]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and 10_000 < len(want) < 30_000


def test_every_operator_has_a_query():
    assert sorted({int(n[2:].split("_")[0]) for n in queries()}) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    p = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Documents of every kind that a stage acts on, some of them repeated in full, null or empty; labels and a benchmark beside them."""
    rng = random.Random(61)
    lines = [prose(rng, rng.randint(1, 12)) for _ in range(14)]
    items = [prose(rng, 24) for _ in range(4)]
    texts = []
    for i in range(90):
        own = [rng.choice(lines) if rng.random() < 0.5 else prose(rng, rng.randint(1, 14)) for _ in range(rng.randint(1, 6))]
        if i % 9 == 0:
            own.append(items[i % 4])
        if i % 11 == 0 and texts:
            own = (texts[rng.randrange(len(texts))] or "x").split("\n")
            own[-1] += rng.choice(["", "x", " one more word"])
        texts.append("\n".join(own))
    texts += [None, "", "\n", "### ###", texts[3], "junk### " * 30]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (None, texts[5], "de", "t", 2), (7, None, None, None, None)]
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, int("###" not in (t or "")), 0) for i, t in enumerate(texts) if i % 2], "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), str(top)


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_first_stage_by_brute_force(spark, fixture):
    docs, top = fixture
    kept = {(r.id, r.th) for r in quality.resample(docs, spark.read.parquet(f"{top}/labels.parquet")).collect() if r.kept}
    named = docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    want = sorted(repr(r) for r, n in zip(docs.collect(), named.collect(), strict=True) if (n.doc_id, n.th) in kept)
    got = corpus_pipeline.quality_classifier(spark, docs, top)
    assert rows_of(got) == want and got.columns == docs.columns
    assert not got.filter("text LIKE 'junk###%'").count()


def test_line_stage_by_brute_force(spark, fixture):
    docs, top = fixture
    rows = docs.collect()
    place = lambda r: (r.doc_id is None, r.doc_id or 0)
    named = {(r.doc_id, r.text or ""): [] for r in rows}
    first = {}
    order = sorted({(place(r), r.text or "") for r in rows if r.text}, key=lambda x: x[0])
    for _, text in order:
        for line in text.split("\n"):
            if line.strip():
                first.setdefault(line, len(first))
    near = {x for x in first for y in first if len(x) >= 20 and len(y) >= 20 and first[y] < first[x] and within_one_edit(x, y)}
    seen, want = set(), {}
    for key, text in order:
        kept = []
        for line in text.split("\n"):
            if not line.strip() or line not in seen and line not in near:
                kept.append(line)
            seen.add(line)
        want[key, text] = "\n".join(kept)
    out = []
    for r in rows:
        text = r.text or ""
        new = want.get((place(r), text), text)
        if new == text:
            out.append(repr(tuple(r)))
        elif new.strip():
            out.append(repr((r.doc_id, new, r.lang, r.source, len(new))))
    assert named
    got = corpus_pipeline.line_deduplication(spark, docs, top)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(out)


def test_near_duplicate_stage_by_brute_force(spark, fixture):
    docs, top = fixture
    texts = {}
    for r in docs.collect():
        key = r.text or ""
        texts[key] = min(texts.get(key, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    names = [t for t in texts if shingles(t)]
    root = {t: t for t in names}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a in names:
        for b in names:
            if a != b and len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) >= 0.8 - 1e-9:
                x, y = sorted((find(a), find(b)), key=texts.get)
                root[y] = x
    got = corpus_pipeline.near_duplicates(spark, docs, top)
    kept = {r.text or "" for r in got.collect()}
    assert {t for t in kept if shingles(t)} == {t for t in names if find(t) == t}
    wordless = [t for t in texts if not shingles(t)]
    assert {t for t in kept if not shingles(t)} == set(wordless)
    assert got.filter(F.length("text") > 8).groupBy("text").count().filter("count > 1").count() == 0


def test_decontamination_stage_by_brute_force(spark, fixture):
    docs, top = fixture
    items = [r.text.split() for r in spark.read.parquet(f"{top}/benchmark.parquet").collect()]
    leaked = lambda t: any(sum(n for _, _, n in greedy_tiles((t or "").replace("\n", " ").lower().split(), i, 5)) >= len(i) / 2 for i in items)
    want = sorted(repr(r) for r in docs.collect() if not leaked(r.text))
    assert rows_of(corpus_pipeline.benchmark_decontamination(spark, docs, top)) == want
    assert len(want) < docs.count() - 5


def test_packing_stage_by_brute_force(spark, fixture):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, top = fixture
    docs = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in corpus_pipeline.pack(spark, docs, top).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for r in docs.collect():
        ids, at = [*t.encode(r.text or "", add_special_tokens=False).ids, 1], 0
        for start, length, crc in sorted(got.pop(r.doc_id)):
            assert start == at and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert not got
