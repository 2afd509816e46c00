from __future__ import annotations

import io
import lzma
import os
import zipfile
import zlib
from hashlib import md5

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import alignment as A
from tessera.operators import catalog as K
from tessera.operators import intervals as I
from tessera.plans import pipelines
from tessera.plans.queries import QUERIES
from tessera.sources import container, documents, docx, html
from tessera.streaming import actions as S


@given(st.text(max_size=200))
def test_container_round_trip(text):
    assert container.opened(container.sealed(text, 1)) == text
    assert container.opened(b"SMDC" + zlib.compress(text.encode())) == text


@pytest.mark.parametrize("preset", [*range(10), 9 | lzma.PRESET_EXTREME])
def test_container_takes_memory_by_its_text(preset):
    """The dictionary is the text's, or the preset's where that is less; no match reaches back further."""
    for text in ("", "x", "words and signs é🙂 " * 300, "".join(f"{k} {k * k}, " for k in range(40_000))):
        data = container.sealed(text, preset)
        whole = b"SMDI" + lzma.compress(text.encode(), preset=preset)
        assert container.opened(data) == text and len(data) <= 1.001 * len(whole)
        room = 400_000 + 2 * len(text.encode())
        assert lzma.LZMADecompressor(memlimit=room).decompress(data[4:]) == text.encode()


def sealings(spark, tmp_path, monkeypatch, query):
    """The rows of a query on the smallest tables, and how often it seals a text."""
    log, seal = str(tmp_path / "sealed"), container.sealed
    open(log, "w").close()

    def noted(text):
        at = os.open(log, os.O_WRONLY | os.O_APPEND)
        os.write(at, b".")
        os.close(at)
        return seal(text, 1)

    monkeypatch.setattr(container, "sealed", noted)
    rows = QUERIES[query](spark, "/root/testdata/sf0.001").collect()
    return rows, os.path.getsize(log)


def test_scan_seals_what_it_opens(spark, tmp_path, monkeypatch):
    rows, n = sealings(spark, tmp_path, monkeypatch, "scan_container")
    assert n == sum(r.doc_id % 3 == 1 for r in rows)


def test_sink_seals_once(spark, tmp_path, monkeypatch):
    rows, n = sealings(spark, tmp_path, monkeypatch, "sink_container")
    assert n == len(rows) and {r.mark for r in rows} == {"SMDI"}


@pytest.mark.parametrize("query", ["scan_container", "sink_container"])
def test_containers_of_odd_rows(spark, tmp_path, query):
    rows = [(k, t) for k, t in enumerate(["a", "", None, "é🙂" * 5000, "b\n", None, None, None, ""])] + [(-1, "c"), (-2, "d"), (-3, "e"), (None, "f"), (None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES[query](spark, str(tmp_path)).collect()
    assert sorted(repr((r[0], r[-1])) for r in got) == sorted(repr((k, None if t is None else md5(t.encode()).hexdigest())) for k, t in rows)


def test_read_containers(spark, tmp_path):
    (tmp_path / "a.smdoc").write_bytes(container.sealed('{"content":"x"}', 1))
    (tmp_path / "b.smdoc").write_bytes(b'{"content":"y"}')
    (tmp_path / "c.txt").write_bytes(b"no")
    rows = container.read_containers(spark, str(tmp_path)).select(documents.parse_document(F.col("json")).alias("d")).select("d.content", "d.meta.title").collect()
    assert sorted(tuple(r) for r in rows) == [("x", "Untitled"), ("y", "Untitled")]


def test_document_round_trip(spark):
    t = spark.createDataFrame([("<p>a</p>", "T", "dark"), ("b", None, "light")], "c string, t string, th string")
    json = documents.create_document(F.col("c"), F.col("t"), F.col("th"), F.lit(5).cast("bigint"))
    rows = t.select(json.alias("j"), documents.parse_document(json).alias("d")).collect()
    assert [(r.d.content, r.d.meta.title, r.d.styles.theme, r.d.meta.created) for r in rows] == [("<p>a</p>", "T", "dark", 5), ("b", "Untitled", "light", 5)]
    assert "styles" not in rows[1].j


def test_style_sheet(spark):
    got = spark.sql("""SELECT from_json('{"doc-title":{"color":"red","fontSize":"12pt"},"x":{"color":"blue"}}', 'map<string,struct<color:string,fontSize:string,fontWeight:string,fontStyle:string,textAlign:string>>') AS s""").select(documents.style_css(F.col("s"))).first()[0]
    assert got == ".ql-doc-title { color: red; font-size: 12pt; }\n"


def test_inline_runs():
    got = [(r[1], r[2], r[3], r[7]) for r in html.inline_runs('a<strong>b<em>c</strong>d</em>&amp;<span class="x y">e</span><b>f</b>')]
    assert got == [("a", False, False, []), ("b", True, False, []), ("c", True, True, []), ("d", False, True, []), ("&", False, False, []), ("e", False, False, ["x", "y"]), ("b>f", False, False, []), ("/b>", False, False, [])]


def test_docx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda text, props="": f"<w:r><w:rPr>{props}</w:rPr><w:t>{text}</w:t></w:r>"
    body = run("ag") + run("x", '<w:rStyle w:val="Hold"/>') + run(" ") + run("ni") + run("g", '<w:vertAlign w:val="superscript"/>') + run("m", '<w:rStyle w:val="Phonetic"/>') + run("b", "<w:b/>")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p>{body}</w:p></w:body></w:document>")
    t = spark.createDataFrame([(1, bytearray(buffer.getvalue()))], "id int, data binary").lateralJoin(docx.DocxRuns(F.col("data").outer()))
    got = docx.runs_to_html(t.drop("data"), "id").first().html
    assert got == 'ag <span class="ql-holding-short">ni</span><sup><span class="ql-change-style">g</span></sup><strong>b</strong>'


def spans(spark, rows):
    return spark.createDataFrame([("a", *r) for r in rows], "k string, start double, end double")


def test_merging(spark):
    got = I.merge_nearby(spans(spark, [(0.0, 1.0), (1.1, 2.0), (2.2, 3.0)]), "k").orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0, 2), (2.2, 3)]
    got = I.merge_to_count(spans(spark, [(0.0, 1.0), (2.0, 3.0), (3.5, 4.0)]), 2, "k").orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0, 1), (2, 4)]


def test_cut_and_invert(spark):
    sel = spark.createDataFrame([("a", 2.0, 3.0)], "k string, sel_start double, sel_end double")
    got = I.cut_selection(spans(spark, [(1.0, 4.0), (3.0, 5.0), (2.2, 2.8)]), sel, "k").orderBy("start", "end").collect()
    assert [(r.start, r.end) for r in got] == [(1, 2), (3, 4), (3, 5)]
    got = spark.range(1).select(I.invert_selection(F.lit(2.0), F.lit(3.0), F.lit(5.0))).first()[0]
    assert [tuple(p) for p in got] == [(0, 2), (3, 5)]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(T.confidence(F.lit(s))) for s in (0.0, 1.5, 9.0)] == [0.98, 0.5, 0.05]
    assert one(T.format_time(F.lit(61.5))) == "1:01.500"
    assert one(T.parse_time(F.lit("1:01.500"))) == 61.5
    assert one(T.parse_time(F.lit("61"))) is None


def test_speech_ends():
    rate = 1000
    loud, quiet = np.sin(np.arange(1000)), np.zeros(600)
    got = A.speech(np.concatenate([quiet, loud, quiet, loud]), rate)
    assert [x for s in got for x in s] == pytest.approx([0.58, 1.59, 2.18, 3.18], abs=0.03)
    assert A.speech(np.zeros(5000), rate) == []
    assert A.speech(np.zeros(3), rate) == []


@given(st.integers(1, 6), st.integers(1, 7), st.integers(0, 10**6))
def test_alignment_is_cheapest(n, m, seed):
    rng = np.random.default_rng(seed)
    starts = np.cumsum(rng.uniform(0.3, 2, m))
    intervals = [(s, s + d) for s, d in zip(starts, rng.uniform(0.1, 0.3, m), strict=True)]
    weights, hints = rng.integers(1, 9, n).astype(float), rng.random(n) < 0.5
    cost = A.Costs(weights, hints, intervals)

    def least(i, j):
        if i == n:
            return cost.skip_interval[j:].sum()
        if j == m:
            return cost.skip_target[i:].sum()
        return min(cost.match(i, j) + least(i + 1, j + 1), cost.skip_target[i] + least(i + 1, j), cost.skip_interval[j] + least(i, j + 1))

    got = A.align(weights, hints, intervals)
    total = sum(cost.match(i, j) for i, j, _ in got) + cost.skip_target.sum() + cost.skip_interval.sum() - sum(cost.skip_target[i] + cost.skip_interval[j] for i, j, _ in got)
    assert [j for _, j, _ in got] == sorted({j for _, j, _ in got})
    assert total <= least(0, 0) + 0.5 * len(got) + 1e-9 and len({i for i, _, _ in got}) == len(got)


@given(st.lists(st.integers(0, 100), min_size=3, max_size=7, unique=True), st.lists(st.integers(0, 100), min_size=1, max_size=3))
def test_boundaries_are_nearest_in_order(times, desired):
    from itertools import combinations

    times, desired = sorted(map(float, times)), sorted(map(float, desired))
    got = A.pick_boundaries(times, desired)
    assert got == sorted(got)
    cost = lambda c: sum((a - b) ** 2 for a, b in zip(c, desired, strict=True))
    assert cost(got) == min(map(cost, combinations(times, len(desired))))


def test_fallbacks():
    one = np.ones(2)
    assert [r[4] for r in A.regions_of(8.0, None, one, np.array([1.0, 3.0]), one > 2)] == ["no signal"] * 2
    assert [(r[0], r[1]) for r in A.regions_of(8.0, [], one, np.array([1.0, 3.0]), one > 2)] == [(0, 2), (2, 8)]


def test_verses_of_the_source_script(spark):
    page = "<html><script>x</script><p>ऋषिः मधुच्छन्दाः</p><p>अ॒ग्निमी॑ळे पु॒रोहि॑तं ।</p><p>दे॒वमृ॒त्विज॑म् ॥ १ ॥</p><p>होता॑रं ॥ २ ॥</p><p>encoded by क ख ग घ ङ च छ ज झ ञ</p></html>"
    got = pipelines.devanagari_extraction(spark.createDataFrame([(1, page)], "page_id int, html string")).orderBy("verse_no").collect()
    assert [(r.verse_no, r.n_lines) for r in got] == [(0, 1), (1, 2), (2, 1)]


def test_svara_plan_keeps_the_last_mark(spark):
    got = spark.range(1).select(K.svara_plan(F.lit("4̍2̱4̱"))).first()[0]
    assert [tuple(x) for x in got] == [(2, "̱"), (4, "̱")]


def test_drain_takes_each_action_once(spark, tmp_path):
    schema = "seq bigint, type string, payload string"
    seen: list[int] = []
    handle = lambda batch, _: seen.extend(r.seq for r in batch.collect())
    for part in ([(1, "a", "x"), (2, "a", "y")], [(3, "b", "z")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        S.drain(spark, str(tmp_path / "in"), schema, str(tmp_path / "ck"), handle).awaitTermination()
    assert sorted(seen) == [1, 2, 3]


def test_debounced_stream(spark, tmp_path):
    t = spark.sql("SELECT 'd' AS id, timestamp_millis(x) AS ts, x AS seq, cast(x AS string) AS payload FROM VALUES (0), (500), (1600), (5000), (60000) AS v(x)")
    t.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = S.debounce(stream, "id").writeStream.format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.payload) for r in spark.table("debounced").orderBy("opened").collect()] == [(3, "1600"), (1, "5000")]


def test_sorts_are_in_order(spark):
    files = spark.createDataFrame([(i, i * 7 % 5, f"n{i}") for i in range(30)], "id int, modified int, name string")
    got = [(r.modified, r.name) for r in K.media_sort(files, "modified", "name").collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1]))
    nodes = K.library_tree(spark.createDataFrame([("/L/b/x.txt",), ("/L/A.txt",), ("/L/a/y.txt",)], "path string"))
    assert [r.name for r in K.library_order(nodes).collect()] == ["a", "b", "L", "A.txt", "x.txt", "y.txt"]
    regions = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 2.0)], "id int, start double")
    assert [r.id for r in I.region_sort(regions).collect()] == [2, 1, 3]


def test_texts_and_pages_as_files(spark, tmp_path):
    texts = ["a\nb", "", "é\r\nü"]
    documents.write_texts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(1), str(tmp_path / "t"))
    assert sorted(r.text for r in documents.read_texts(spark, str(tmp_path / "t")).collect()) == sorted(texts)
    json = spark.createDataFrame([('{"content":"<p>x</p>","meta":{"title":"A"}}',)], "j string").select(documents.parse_document(F.col("j")).alias("document"))
    documents.write_pages(json, str(tmp_path / "p"))
    page = documents.read_texts(spark, str(tmp_path / "p")).first().text
    assert page.startswith("<!DOCTYPE html>") and "<title>A</title>" in page
    (tmp_path / "one.html").write_text("<p>\n</p>")
    assert documents.read_text_files(spark, str(tmp_path), "*.html").first().text == "<p>\n</p>"


@given(st.integers(1, 12), st.integers(1, 15), st.integers(0, 10**6))
def test_alignment_by_diagonals_is_that_by_cells(n, m, seed):
    rng = np.random.default_rng(seed)
    starts = np.cumsum(rng.uniform(0.3, 2, m))
    intervals = [(s, s + d) for s, d in zip(starts, rng.uniform(0.1, 0.3, m), strict=True)]
    weights, hints = rng.integers(1, 4, n).astype(float), rng.random(n) < 0.5
    cost = A.Costs(weights, hints, intervals)
    best, step = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1), int)
    best[0, 1:], step[0, 1:] = np.cumsum(cost.skip_interval), 2
    best[1:, 0], step[1:, 0] = np.cumsum(cost.skip_target), 1
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            ways = (best[i - 1, j - 1] + cost.match(i - 1, j - 1), best[i - 1, j] + cost.skip_target[i - 1], best[i, j - 1] + cost.skip_interval[j - 1])
            step[i, j] = ways.index(min(ways))
            best[i, j] = min(ways)
    want, i, j = set(), n, m
    while i or j:
        if step[i, j] == 0:
            want.add(j - 1)
        i, j = i - (step[i, j] != 2), j - (step[i, j] != 1)
    assert {a[1] for a in A.align(weights, hints, intervals)} == want
