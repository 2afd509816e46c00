"""Pages to documents, edits of long texts, formats that give way, paths in normal form."""

from __future__ import annotations

import posixpath
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import phonology as P
from tessera.functions import text as T
from tessera.operators import catalog as K
from tessera.operators import formats
from tessera.sources import documents, pages

LONG = "A" * 1_000_000
PAGES = {
    None: None,
    "": ("", "Untitled", "light", 0),
    "<p>no block</p>": ("", "Untitled", "light", 0),
    "<title></title><body data-theme=dark><div class='a ql-editor b'> <div>x<div>y</div></div> </div><div>z</div>": ("<div>x<div>y</div></div>", "Untitled", "dark", 0),
    "<body DATA-THEME='sepia'><section class=ql-editor><div>never closed</body></html>": ("<div>never closed", "Untitled", "sepia", 0),
    '<!-- <div class="ql-editor">no</div> --><div title="</div>" class="ql-editor">a<div/>b<br>c</div>d': ("a<div/>b<br>c", "Untitled", "light", 0),
    '<div class="ql-editors">no</div><div data-class="ql-editor">no</div><div class="ql-editor">yes</div>': ("yes", "Untitled", "light", 0),
    f'<title>T &lt;1&gt;</title><div class="ql-editor"><div class="ql-audio-attachment" data-audio-id="1"><b></b><audio src="data:{LONG}"></audio></div></div>': (f'<div class="ql-audio-attachment" data-audio-id="1"><b></b><audio src="data:{LONG}"></audio></div>', "T <1>", "light", 1),
    '<div class="ql-audio-attachment" data-audio-id="1"></div><audio src="after"></audio>': ("", "Untitled", "light", 0),
}


@pytest.mark.parametrize("page", PAGES, ids=range(len(PAGES)))
def test_from_html(spark, page):
    d = spark.createDataFrame([(page,)], "p string").select(documents.from_html(F.col("p")).alias("d")).first()[0]
    assert (d and (d.content, d.title, d.theme, len(d.attachments))) == PAGES[page]


def test_attachment_figures(spark):
    page = '<div class="ql-audio-attachment" data-audio-id="a" data-audio-src="s" data-start-time=" 1.5sec" data-end-time="x" data-size="1e3" data-fade-in="-.5"><div class="ql-audio-attachment" data-audio-id=\'b "q"\'><audio src=in></audio></div></div><p class="ql-audio-attachment" data-audio-id="c" data-end-time="2." data-audio-src="&amp;"></p>'
    a, b, c = spark.createDataFrame([(page,)], "p string").select(documents.from_html(F.col("p")).alias("d")).first()[0].attachments
    assert (a.id, a.label, a.src, a.startTime, a.size, a.fadeIn, a.fadeOut) == ("a", "Audio", "s", 1.5, 1000.0, -0.5, 0.0) and a.endTime != a.endTime
    assert (b.id, b.src, b.endTime) == ('b "q"', "in", None)
    assert (c.id, c.src, c.endTime) == ("c", "&", 2.0)


def test_pages_come_back(spark):
    json = '{"content":"<p>a</p><div><div>b</div></div>","meta":{"title":"x & \\"y\\" <z>"},"styles":{"theme":"dark","customCSS":"p { }"}}'
    d = spark.createDataFrame([(json,)], "j string").select(documents.from_html(documents.to_html(documents.parse_document(F.col("j")))).alias("d")).first()[0]
    assert (d.content, d.title, d.theme, d.attachments) == ("<p>a</p><div><div>b</div></div>", 'x & "y" <z>', "dark", [])


def test_many_blocks_take_linear_time(spark):
    page = "<div class='ql-editor'>" + "<div>x</div>" * 40_000 + "</div>"
    assert spark.createDataFrame([(page,)], "p string").select(F.length(pages.from_html(F.col("p"))["content"])).first()[0] == 12 * 40_000


def test_edits_of_a_long_text(spark):
    text, n = "abcdefghij" * 40_000, 40_000
    edits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 10).alias("idx"), F.lit(1).alias("del"), F.array(F.struct(F.lit("ṁ").alias("text"), F.lit(False).alias("superscript"), F.lit(False).alias("change"), F.lit(False).alias("svara"))).alias("parts"), (i % 2 == 0).alias("changed")))
    start = time.perf_counter()
    got = spark.createDataFrame([(text,)], "t string").select(P.apply_edits(F.col("t"), edits)).first()[0]
    assert got == "ṁbcdefghijabcdefghij" * 20_000
    assert time.perf_counter() - start < 20


def test_edits_at_the_ends(spark):
    part = "array(struct('X' AS text, false AS superscript, false AS change, false AS svara))"
    edit = lambda i, d: f"struct({i} AS idx, {d} AS del, {part} AS parts, true AS changed)"
    rows = spark.createDataFrame([("🙂bc",), ("",), (None,)], "t string")
    got = rows.select(P.apply_edits(F.col("t"), F.expr(f"array({edit(3, 0)}, {edit(0, 1)}, {edit(1, 0)})"))).collect()
    assert [r[0] for r in got] == ["XXbcX", "XXX", None]


def test_formats_give_way(spark):
    s = "̍"
    rows = spark.createDataFrame([(1, f"ka{s}tva ka{s}ta a{s}i ai{s} ā{s} i{s}̱kta u{s}"), (2, None), (3, "")], "id int, t string")
    found = formats.svarita_formats(rows, "id", text="t")
    held = rows.select("id", F.explode(P.clusters_of(F.col("t"))).alias("c")).select("id", "c.position")
    text = rows.first().t
    assert sorted(r.position for r in found.collect()) == [k for k, c in enumerate(text[:-1]) if c in "aiu" and text[k + 1] == s and text[k - 1 : k + 1] != "ai"]
    assert sorted(text[r.position : r.position + 4] for r in formats.giving_way(found, held, "id").collect()) == [f"a{s}i ", f"a{s}ta", f"u{s}"]


def test_path_form(spark):
    paths = ["/a/b", "/a//b/", "/a/./b", "/a/../b", "/../..", "/", "a/b/../../c", "/A/b", "", "/a/b/../../../c/.", None]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(T.path_form(F.col("p"))).collect()]
    assert got == [None if p is None else posixpath.normpath(posixpath.join("/", p)) for p in paths]


def test_recents_of_an_empty_list(spark):
    none = spark.createDataFrame([], "ord int, path string, last_accessed bigint, last_saved bigint")
    assert [tuple(r) for r in K.recents_upsert(none, "/x/../y", "open", 5).collect()] == [(-1, "/y", 5, 0)]
    two = spark.createDataFrame([(0, "/Y", 1, 2), (1, "/z/../y", 3, None)], "ord int, path string, last_accessed bigint, last_saved bigint")
    assert [tuple(r) for r in K.recents_upsert(two, "/y", "save", 9).collect()] == [(-1, "/y", 3, 9), (0, "/Y", 1, 2)]
