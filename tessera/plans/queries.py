"""The registered queries of the library's own operators, each beside SQL that computes the same by another route where SQL can."""

from __future__ import annotations

import html as html_std
import re
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions import convert as V
from ..functions import phonology as P
from ..functions import text as T
from ..operators import alignment as A
from ..operators import catalog as K
from ..operators import formats
from ..operators import intervals as I
from ..operators import verses as L
from ..operators.segments import order_statistics
from ..sources import container, docx, documents, html
from ..sources.shared import scratch
from ..streaming import actions as S
from . import pipelines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on(name: str, source: str, key: str, value: Callable[[], Column], sql: str | None = None, where: str = "true") -> None:
    """A query of one computed column over a table: (key, value). sql: the same value."""
    add(name, lambda s, d: table(s, d, source).filter(where).select(key, value().alias("value")), sql and f"SELECT {key}, {sql} AS value FROM {source} WHERE {where}")


def literal(v: object) -> str:
    return "NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)


Part = tuple[str, ...]


def derived(name: str, parts: list[Part], query: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query over rows made of the given tables: each part is a table and the columns taken of it, in words that both dialects read alike. sql: the same over a table `fx` of these rows."""

    def rows(s: SparkSession, d: str) -> DataFrame:
        made = [table(s, d, source).selectExpr(*columns) for source, *columns in parts]
        out = made[0]
        for more in made[1:]:
            out = out.unionByName(more)
        return query(out)

    source = " UNION ALL ".join(f"SELECT {', '.join(columns)} FROM {name_}" for name_, *columns in parts)
    add(name, rows, sql and f"WITH fx AS ({source}) {sql}")


WS = C.WS
text_lower = lambda: F.lower(F.col("text"))
DOCS, PAGES = "documents", "pages"
#: The name of the column; functions take it as a column.
text = "text"

# ---- sources and sinks -------------------------------------------------------------------------------------------------------
def scan_container(s: SparkSession, d: str) -> DataFrame:
    """Plain texts and both kinds of container, opened. Each text is sealed in its own kind alone."""
    docs = table(s, d, DOCS).withColumn("kind", F.pmod("doc_id", F.lit(3)))
    sealed = [container.compress(F.when(F.col("kind") == 1, F.col("text"))), container.compress_zlib(F.when(F.coalesce("kind", F.lit(2)) == 2, F.col("text")))]
    return docs.select("doc_id", F.md5(container.decompress(F.coalesce(F.when(F.col("kind") == 0, F.encode("text", "utf-8")), *sealed))).alias("value"))


add("scan_container", scan_container, "SELECT doc_id, md5(text) AS value FROM documents")
add("sink_container", lambda s, d: table(s, d, DOCS).select("doc_id", container.compress("text").alias("c")).select("doc_id", F.decode(F.substring("c", 1, 4), "utf-8").alias("mark"), F.md5(container.decompress("c")).alias("restored")), "SELECT doc_id, 'SMDI' AS mark, md5(text) AS restored FROM documents")
PATHS = "concat('/Library/', source, '/', lang, ' ', doc_id, element_at(array('.smdoc', '.HTML', '.json', '.md', '.SMDOC', '.png', '.mp3', '.tar.gz'), cast(doc_id % 8 AS int) + 1))"
PATHS_SQL = "('/Library/' || source || '/' || lang || ' ' || doc_id || (['.smdoc', '.HTML', '.json', '.md', '.SMDOC', '.png', '.mp3', '.tar.gz'])[doc_id % 8 + 1])"
path = lambda: F.expr(PATHS)
on("is_smdoc", DOCS, "doc_id", lambda: T.is_document(path()), f"lower({PATHS_SQL}) LIKE '%.smdoc'")
EXT = f"lower(regexp_extract({PATHS_SQL}, '[.]([^.]*)$', 1))"
in_list = lambda values: ", ".join(map(literal, values))
case = lambda groups, other: "CASE " + " ".join(f"WHEN {EXT} IN ({in_list(v)}) THEN '{k}'" for k, v in groups.items()) + f" ELSE '{other}' END"
on("file_kind", DOCS, "doc_id", lambda: T.file_kind(path()), case(T.KINDS, "other"))
on("viewer_dispatch", DOCS, "doc_id", lambda: T.viewer(path()), case(T.VIEWERS, "default"))
on("open_by_extension", DOCS, "doc_id", lambda: T.open_mode(path()), case({"html": ("html", "htm"), "json": ("json",), "markdown": ("md", "markdown")}, "text"))
BACK, QUOTE = "chr(92)", "chr(34)"
#: A text as JSON writes it.
IN_JSON = f"replace(replace(replace(replace(replace(text, {BACK}, {BACK} || {BACK}), {QUOTE}, {BACK} || {QUOTE}), chr(10), {BACK} || 'n'), chr(9), {BACK} || 't'), chr(13), {BACK} || 'r')"
JSONS = [("documents", "doc_id AS id", f"""CASE doc_id % 6 WHEN 0 THEN '{{"version":1,"content":"' || {IN_JSON} || '","meta":{{"title":"' || source || '","created":' || doc_id || '}}}}' WHEN 1 THEN '"{{' || {BACK} || '"content' || {BACK} || '":' || {BACK} || '"' || lang || {BACK} || '"}}"'
    WHEN 2 THEN '{{}}' WHEN 3 THEN 'not json: ' || text WHEN 4 THEN '{{"version":2,"content":"z","meta":{{"title":"","author":"' || source || '"}},"styles":{{"theme":"dark"}}}}' ELSE '{{"content":"' || {IN_JSON} || '"}}' END AS json""")]
derived("parse_document", JSONS, lambda t: t.withColumn("d", documents.parse_document(F.col("json"))).select("id", "d.version", "d.content", "d.meta.title", "d.meta.created", "d.meta.author", "d.styles.theme"),
      """, j AS (SELECT id, CASE WHEN json_valid(json) THEN CASE WHEN json_type(json) = 'VARCHAR' THEN json ->> '$' ELSE json END END AS j FROM fx)
      SELECT id, CASE WHEN j IS NOT NULL THEN coalesce(CAST(j ->> '$.version' AS INTEGER), 1) END AS version, CASE WHEN j IS NOT NULL THEN coalesce(j ->> '$.content', '') END AS content,
             CASE WHEN j IS NOT NULL THEN coalesce(nullif(j ->> '$.meta.title', ''), 'Untitled') END AS title, CASE WHEN j IS NOT NULL THEN coalesce(CAST(j ->> '$.meta.created' AS BIGINT), 0) END AS created,
             CASE WHEN j IS NOT NULL THEN coalesce(j ->> '$.meta.author', '') END AS author, CASE WHEN j IS NOT NULL THEN coalesce(nullif(j ->> '$.styles.theme', ''), 'light') END AS theme FROM j""")  # fmt: skip
add("create_document", lambda s, d: table(s, d, DOCS).select("doc_id", documents.create_document(text, F.col("source"), F.col("lang"), F.lit(7).cast("bigint")).alias("j")).select("doc_id", F.get_json_object("j", "$.content").alias("content"), F.get_json_object("j", "$.meta.title").alias("title"), F.get_json_object("j", "$.styles.theme").alias("theme")),
    f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '>{WS}{{2,}}<', '> <', 'g'), '\\n{WS}*\\n', chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g') AS content, source AS title, lang AS theme FROM documents")
on("compress_content", PAGES, "page_id", lambda: F.md5(T.compress_content(F.col("html"))), f"md5(regexp_replace(regexp_replace(regexp_replace(html, '>{WS}{{2,}}<', '> <', 'g'), '\\n{WS}*\\n', chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g'))")
on("escape_html", PAGES, "page_id", lambda: F.md5(T.escape_html(F.col("html"))), "md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;'))")
STYLED = [("documents", "doc_id AS id", """CASE doc_id % 3 WHEN 0 THEN '{"doc-title":{"color":"' || lang || '","fontSize":"' || doc_id || 'pt"},"other":{"color":"blue"}}' WHEN 1 THEN '{"doc-section":{"textAlign":"' || source || '"},"doc-title":{}}' END AS styles""")]
derived("style_css", STYLED, lambda t: t.select("id", F.coalesce(documents.style_css(F.from_json("styles", f"map<string,{documents.STYLE}>")), F.lit("")).alias("value")),
      "SELECT id, " + " || ".join(f"coalesce('.ql-{k} {{ ' || nullif(concat_ws('; ', " + ", ".join(f"'{css}: ' || nullif(styles ->> '$.\"{k}\".{field}', '')" for css, field in documents.PROPERTIES) + f"), '') || '; }}' || chr(10), '')" for k in documents.STYLE_KEYS) + " AS value FROM fx")
PAGE_SQL = [f"'{x}'".replace("\n", "' || chr(10) || '") for x in documents.PAGE]
add("to_html", lambda s, d: _pages(table(s, d, DOCS)).select("doc_id", F.md5("page").alias("value")),
    f"SELECT doc_id, md5({PAGE_SQL[0]} || source || {PAGE_SQL[1]} || chr(10) || chr(10) || chr(10) || {PAGE_SQL[2]} || 'light' || {PAGE_SQL[3]} || text || {PAGE_SQL[4]}) AS value FROM documents")
# Pages in that form, whose parts are known: nested blocks, a second editor block, a script that shows one, attachments of which two in three lack an id or a source.
ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
SOUNDS = """CASE doc_id % 3 WHEN 0 THEN '<div title="a > b" class="x ql-audio-attachment" data-audio-id="a' || doc_id || '" data-audio-label="&quot;' || source || '&quot;" data-start-time="1.5s" data-duration=' || doc_id || '><div><audio src="data:' || lang || '"></audio></div></div>'
    WHEN 1 THEN '<div class="ql-audio-attachment" data-audio-src="x"></div>' ELSE '<span class="ql-audio-attachment" data-audio-id="b"></span>' END"""
CONTENT = f"""'<p>' || {ESCAPED} || '</p><DIV class="box"><div>' || source || '</div><!-- </div> --></DIV>' || {SOUNDS} || '<br/>'"""
SECOND = """'</div><div class="ql-editor"><p>second</p>'"""
WHOLE = f"""{PAGE_SQL[0]} || 'T &amp; ' || source || {PAGE_SQL[1]} || '</style><script>x = "<div class=ql-editor>no</div>"</script><style>' || {PAGE_SQL[2]} || lang || {PAGE_SQL[3]} || '  ' || {CONTENT} || chr(10) || {SECOND} || {PAGE_SQL[4]}"""
add("from_html", lambda s, d: table(s, d, DOCS).select("doc_id", documents.from_html(F.expr(WHOLE.replace("chr(10)", "'\n'"))).alias("d")).select("doc_id", F.md5("d.content").alias("content"), "d.title", "d.theme", F.explode_outer("d.attachments").alias("a")).select("doc_id", "content", "title", "theme", "a.id", "a.label", "a.src", "a.startTime", "a.endTime", "a.duration"),
    f"""SELECT doc_id, md5({CONTENT}) AS content, 'T & ' || source AS title, lang AS theme, CASE WHEN doc_id % 3 = 0 THEN 'a' || doc_id END AS id, CASE WHEN doc_id % 3 = 0 THEN '"' || source || '"' END AS label, CASE WHEN doc_id % 3 = 0 THEN 'data:' || lang END AS src,
        CASE WHEN doc_id % 3 = 0 THEN 1.5::DOUBLE END AS startTime, NULL::DOUBLE AS endTime, CASE WHEN doc_id % 3 = 0 THEN doc_id::DOUBLE END AS duration FROM documents""")  # fmt: skip


def _pages(docs: DataFrame) -> DataFrame:
    json = F.to_json(F.struct(F.struct(F.col("source").alias("title")).alias("meta"), F.col("text").alias("content")))
    return docs.select("doc_id", documents.to_html(documents.parse_document(json)).alias("page"))


on("import_html_body", PAGES, "page_id", lambda: F.md5(T.import_html_body(F.col("html"))), "md5(CASE WHEN regexp_matches(html, '(?is)<body[^>]*>.*?</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE html END)")
derived("import_json_content", JSONS, lambda t: t.select("id", T.import_json_content(F.col("json")).alias("value")), "SELECT id, coalesce(nullif(CASE WHEN json_valid(json) THEN json ->> '$.content' END, ''), json) AS value FROM fx")
on("import_markdown", DOCS, "doc_id", lambda: F.md5(T.import_markdown(F.concat(F.lit("# T\n**b** *i*\n## U\n"), text))), "md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('# T' || chr(10) || '**b** *i*' || chr(10) || '## U' || chr(10) || text, '(?m)^### (.*)$', '<h3>\\1</h3>', 'g'), '(?m)^## (.*)$', '<h2>\\1</h2>', 'g'), '(?m)^# (.*)$', '<h1>\\1</h1>', 'g'), '\\*\\*(.*?)\\*\\*', '<strong>\\1</strong>', 'g'), '\\*(.*?)\\*', '<em>\\1</em>', 'g'), '\\n', '<br>', 'g'))")
add("html_paragraphs", lambda s, d: html.paragraphs(table(s, d, PAGES), "page_id", "html").select("page_id", "para_no", F.size("classes").alias("n_classes"), F.md5("inner").alias("inner")),
    """SELECT page_id, generate_subscripts(p, 1) - 1 AS para_no, coalesce(len(list_filter(regexp_split_to_array(coalesce(unnest(c), ''), '[ \\t\\n]+'), lambda x: x <> '')), 0) AS n_classes, md5(unnest(p)) AS inner FROM (
       SELECT page_id, regexp_extract_all(h, '(?is)<p(?:\\s+class=["'']([^"'']*)["''])?\\s*>(.*?)</p>', 1) AS c, regexp_extract_all(h, '(?is)<p(?:\\s+class=["'']([^"'']*)["''])?\\s*>(.*?)</p>', 2) AS p
       FROM (SELECT page_id, regexp_replace(html, '<br ?/?>', ' ', 'g') AS h FROM pages))""")  # fmt: skip
add("html_inline_runs", lambda s, d: _runs(s, html.paragraphs(table(s, d, PAGES), "page_id", "html")).groupBy("page_id").agg(F.count("*").alias("n_runs"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.col("bold").cast("int")).alias("n_bold")))


def _runs(spark: SparkSession, paragraphs: DataFrame) -> DataFrame:
    return paragraphs.drop("classes").lateralJoin(html.InlineRuns(F.col("inner").outer())).select("page_id", "para_no", "run_no", "text", "bold", "italic", "underline", "superscript", "subscript", "classes")


RUNS = [
    ("documents", "CAST(doc_id AS INTEGER) AS para_no", f"{k} AS run_no", f"{what} AS text", f"CASE (doc_id + {k}) % 6 WHEN 1 THEN 'Hold' WHEN 2 THEN 'Phonetic' WHEN 3 THEN 'Insert' WHEN 4 THEN 'Svara' WHEN 5 THEN '2Hold' END AS char_style",
     f"CASE WHEN (doc_id + {k}) % 5 < 2 THEN CAST(7 + (doc_id + {k}) % 5 * 4 AS DOUBLE) END AS size_pt", f"(doc_id + {k}) % 7 = 3 AS superscript")
    for k, what in enumerate(("text", "lang || ' & '", "'  '", "source"))
]
_more = lambda t: t.withColumns({c: F.lit(False) for c in ("bold", "italic", "underline", "has_border")}).withColumn("border_sz", F.lit(0))
derived("docx_runs_to_html", RUNS, lambda t: docx.runs_to_html(_more(t)))
derived("docx_format_run", RUNS, lambda t: _more(t).select("para_no", "run_no", docx.format_run().alias("value")),
      """SELECT para_no, run_no, CASE WHEN char_style LIKE 'Insert%' OR coalesce(char_style, '') NOT IN (SELECT k FROM st) AND (coalesce(size_pt, 99) <= 9 OR superscript) THEN CASE WHEN superscript THEN '<sup>' ELSE '' END || '<span class="ql-change-style">' || x || '</span>' || CASE WHEN superscript THEN '</sup>' ELSE '' END
             WHEN c IS NOT NULL AND trim(text) <> '' THEN '<span class="' || c || '">' || x || '</span>' ELSE x END AS value
         FROM (SELECT fx.*, st.v AS c, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x FROM fx LEFT JOIN st ON st.k = char_style)""".replace("st ", f"(VALUES {', '.join(f'({literal(k)}, {literal(v)})' for k, v in docx.STYLE_CLASS.items())}) AS st(k, v) ").replace("FROM st)", f"FROM (VALUES {', '.join(f'({literal(k)}, {literal(v)})' for k, v in docx.STYLE_CLASS.items())}) AS st(k, v))"))  # fmt: skip
derived("docx_title_detect", [("events", "CAST(event_id % 5 AS INTEGER) AS para_no", "CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 40 AS DOUBLE) END AS size_pt", "CASE WHEN event_id % 4 > 0 THEN event_id % 4 = 1 END AS centred")], lambda t: t.select("para_no", docx.is_title(F.col("para_no"), F.col("size_pt"), F.col("centred")).alias("value")), "SELECT para_no, para_no <= 2 AND (coalesce(size_pt, 0) >= 24 OR coalesce(centred, false)) AS value FROM fx")
derived("docx_hanging", [("events", "event_id AS id", *(f"CASE WHEN event_id % {n} > 0 THEN CAST(event_id % {m} AS DOUBLE) - 3 END AS {c}" for c, n, m in (("l", 2, 7), ("f", 3, 6), ("sl", 5, 9), ("sf", 4, 5))))], lambda t: t.select("id", docx.is_hanging(F.col("l"), F.col("f"), F.col("sl"), F.col("sf")).alias("value")), "SELECT id, coalesce(coalesce(l, sl) > 0 AND coalesce(f, sf) < 0, false) AS value FROM fx")
PARAGRAPHS = [("documents", "doc_id AS id", "source || doc_id AS a", "'é & <' || doc_id || '> ' || replace(text, chr(10), ' ') AS b", "doc_id % 3 = 0 AS bold", "doc_id % 4 = 0 AS raised")]
derived("import_docx", PARAGRAPHS, lambda t: docx.import_docx(t.select("id", docx.written(F.col("a"), F.col("b"), F.col("bold"), F.col("raised")).alias("content")), "id"),
      """SELECT id, unnest([0, 2]) AS para_no, unnest([CASE WHEN bold THEN '<strong>' || a || '</strong>' ELSE a END || CASE WHEN raised THEN '<sup><span class="ql-change-style">' || e || '</span></sup>' ELSE e END, 'end ' || a]) AS html
         FROM (SELECT *, replace(replace(replace(b, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM fx)""")  # fmt: skip
derived("style_lookup", [("documents", "CASE doc_id % 5 WHEN 0 THEN 'Heading 1' WHEN 1 THEN 'Heading 1 Char' WHEN 2 THEN 'Title ' || lang WHEN 3 THEN source ELSE 'Body' END AS style")], lambda t: t.select("style", docx.style_lookup(F.col("style"), {"Title": "ql-doc-title", "Heading 1": "ql-doc-section"}).alias("value")), "SELECT style, CASE WHEN style LIKE 'Title%' THEN 'ql-doc-title' WHEN style LIKE 'Heading 1%' THEN 'ql-doc-section' END AS value FROM fx")


def _text_files(s: SparkSession, d: str) -> DataFrame:
    """The documents written to text files, an id in front of each, and read again."""
    documents.write_texts(table(s, d, DOCS).select(F.concat(F.col("doc_id").cast("string"), F.lit(" "), "text").alias("text")), top := scratch(s, "texts"))
    return documents.read_texts(s, top).select(F.substring_index("text", " ", 1).cast("bigint").alias("doc_id"), F.expr("substring(text, instr(text, ' ') + 1)").alias("text"))


add("scan_text_file", lambda s, d: _text_files(s, d).select("doc_id", F.octet_length("text").alias("n_bytes"), F.md5("text").alias("digest")), "SELECT doc_id, octet_length(encode(text)) AS n_bytes, md5(text) AS digest FROM documents")
# ---- projections, filters, predicates ----------------------------------------------------------------------------------------
add("style_filter", lambda s, d: K.style_filter(table(s, d, DOCS), ["en", "de"], "lang").groupBy("lang").count().withColumnRenamed("count", "n"), "SELECT lang, count(*) AS n FROM documents WHERE lang NOT IN ('fr', 'es') GROUP BY lang")
add("catalog_search", lambda s, d: K.search(table(s, d, DOCS).select("doc_id", F.col("source").alias("filename"), F.col("text").alias("title"), F.col("lang").alias("romanized")), "EN the").select("doc_id"), "SELECT doc_id FROM documents WHERE len(list_filter(string_split('en the', ' '), lambda w: instr(lower(concat_ws(' ', text, lang, source)), w) = 0)) = 0")
derived("query_fold", [("documents", "'Ṛgveda Śānti puruṣa sūktaṁ Ḷ ḻ ñ ṅ ṇ ' || text AS q")], lambda t: t.select("q", T.query_fold(F.col("q")).alias("value")), "SELECT q, replace(replace(translate(lower(q), 'āīūṛṝḷḹṁṃḥṭḍṅñṇḻ', 'aiurrllmmhtdnnnl'), 'ś', 'sh'), 'ṣ', 'sh') AS value FROM fx")
add("recents_search", lambda s, d: K.recents_search(table(s, d, DOCS).select("doc_id", path().alias("path")), " SRC1 ", "/library//SRC1/en 1.html").select("doc_id"), f"SELECT doc_id FROM documents WHERE lower({PATHS_SQL}) LIKE '%src1%' AND lower({PATHS_SQL}) <> '/library/src1/en 1.html'")
add("dev_line_filter", lambda s, d: _deva(s, d).select("doc_id", "line_no"), "")
add("footer_trim", lambda s, d: L.footer_trim(_deva(s, d), "doc_id").select("doc_id", "line_no"), "")
add("preamble_split", lambda s, d: _body(s, d).select("doc_id", "line_no", "preamble"), "")
derived("shlokam_filter", [("pages", "page_id AS id", "CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '' END AS url", "CASE page_id % 4 WHEN 0 THEN 'to ' || url WHEN 1 THEN '' END AS link", "CASE page_id % 5 WHEN 0 THEN 'page' WHEN 1 THEN '' END AS subtype")], lambda t: K.post_filter(t).select("id", "url", "subtype"), "SELECT id, CASE WHEN length(url) > 0 THEN url ELSE link END AS url, CASE WHEN length(subtype) > 0 THEN subtype ELSE 'post' END AS subtype FROM fx WHERE length(url) > 0 OR length(link) > 0")
derived("attachment_filter", [("documents", "doc_id AS k", "CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN '' END AS id", "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '' WHEN 2 THEN lang END AS src")], lambda t: t.select(F.explode(documents.valid_attachments(F.array(F.struct("k", "id", "src")))).alias("a")).select("a.k"), "SELECT k FROM fx WHERE length(coalesce(id, '')) * length(coalesce(src, '')) > 0")
# Events as regions of their user's recording, some of them empty, beyond the end or without a target.
FX = [("events", "'u' || user_id AS audio_id", "event_id AS id", "CAST(event_id % 40 AS DOUBLE) / 4 AS start", "CAST(event_id % 40 AS DOUBLE) / 4 + CAST(event_id % 17 AS DOUBLE) / 4 - 0.5 AS stop", "CASE WHEN event_id % 7 < 5 THEN CAST(event_id % 7 AS INTEGER) END AS target_index")]
_end = lambda t: t.withColumnRenamed("stop", "end")
derived("region_validity", FX, lambda t: t.select("id", I.valid_region(F.col("start"), F.col("stop"), F.lit(10.0)).alias("value")), "SELECT id, CASE WHEN stop - start <= 0 THEN 'empty' WHEN stop - 10 > 0.05 THEN 'beyond the end' END AS value FROM fx")
derived("region_min_len", FX, lambda t: I.install_regions(_end(t), F.lit(10.0)).select("id", "start", F.col("end").alias("stop")), "SELECT id, greatest(0, start) AS start, least(10, stop) AS stop FROM fx WHERE least(10, stop) - greatest(0, start) > 0.01")
derived("visibility_mode", FX, lambda t: t.select("id", *[I.visible(m, F.col("id") == 2, F.col("id") > 3).alias(m) for m in ("selected", "all", "hidden", "custom")]), "SELECT id, id = 2 AS selected, true AS \"all\", false AS hidden, id <= 3 AS custom FROM fx")
on("path_guard", DOCS, "doc_id", lambda: T.is_guarded(F.concat(F.lit("/"), path()), "/Library/src1"), f"{PATHS_SQL} LIKE '/Library/src1%'")
# ---- joins -------------------------------------------------------------------------------------------------------------------
add("audio_hydrate", lambda s, d: K.lookup(table(s, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("id")), table(s, d, "customer").select((F.col("c_custkey") % 5).alias("id"), "c_custkey", "c_name"), "id", "c_custkey").select("n_nationkey", "c_name"),
    "SELECT n_nationkey, c_name FROM nation LEFT JOIN (SELECT c_custkey % 5 AS id, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey % 5 ORDER BY c_custkey DESC) = 1) c ON c.id = n_regionkey")
OLD_NEW = [("customer", "'old' AS kind", "c_custkey AS id", "c_name AS label"), ("nation", "'new' AS kind", "n_nationkey * 7 AS id", "n_name AS label")]
derived("audio_library_upsert", OLD_NEW, lambda t: K.upsert(t.filter("kind = 'old'").select("id", "label"), t.filter("kind = 'new'").select("id", "label"), "id"), "SELECT id, label FROM fx WHERE kind = 'new' OR id NOT IN (SELECT id FROM fx WHERE kind = 'new')")
# Turns of conversations as targets, events as the regions of some of them.
RT = [("events", "'r' AS kind", "'a' || event_id % 97 AS audio_id", "event_id AS id", "CAST(NULL AS STRING) AS label", "CASE WHEN event_id % 11 > 0 THEN CAST(event_id % 13 AS INTEGER) END AS ord"),
      ("conversations", "'t' AS kind", "'a' || conv_id AS audio_id", "CAST(NULL AS BIGINT) AS id", "text AS label", "CAST(turn AS INTEGER) AS ord")]
_regions = lambda t: t.filter("kind = 'r'").select("audio_id", "id", F.col("ord").alias("target_index"))
_targets = lambda t: t.filter("kind = 't'").select("audio_id", "ord", "label")
derived("region_target", RT, lambda t: K.region_target(_regions(t), _targets(t), "audio_id").select("id", "label"), "SELECT id, (SELECT label FROM fx t WHERE t.kind = 't' AND t.audio_id = r.audio_id AND t.ord = r.ord) AS label FROM fx r WHERE kind = 'r'")
derived("next_unassigned_target", RT, lambda t: K.next_unassigned(_targets(t), _regions(t), "audio_id"), "SELECT audio_id, min(ord) AS ord FROM fx t WHERE kind = 't' AND NOT EXISTS (SELECT 1 FROM fx r WHERE r.kind = 'r' AND r.audio_id = t.audio_id AND r.ord = t.ord) GROUP BY audio_id")
derived("target_has_region", RT, lambda t: K.with_region(_targets(t), _regions(t), "audio_id").select("audio_id", "ord"), "SELECT audio_id, ord FROM fx t WHERE kind = 't' AND EXISTS (SELECT 1 FROM fx r WHERE r.kind = 'r' AND r.audio_id = t.audio_id AND r.ord = t.ord)")
derived("remove_target", FX, lambda t: K.remove_target(t, 1).select("id", "target_index"), "SELECT id, CASE WHEN target_index <> 1 THEN target_index - CAST(target_index > 1 AS INTEGER) END AS target_index FROM fx")
add("verse_zip", lambda s, d: table(s, d, DOCS).select("doc_id", F.posexplode(L.verse_zip(F.split("text", "\n"), F.array("lang", "source"), F.array(F.lit("")))).alias("n", "v")).select("doc_id", "v.devanagari", "v.transliteration", "v.translation"),
    """WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS x, [lang, source] AS y FROM documents), n AS (SELECT doc_id, x, y, unnest(range(1, greatest(len(x), 2) + 1)) AS i FROM a)
       SELECT doc_id, coalesce(x[i], '') AS devanagari, coalesce(y[i], '') AS transliteration, '' AS translation FROM n WHERE coalesce(x[i], '') <> '' OR coalesce(y[i], '') <> ''""")  # fmt: skip
MICROS = lambda c: F.round(F.col(c) * 1e6).cast("bigint")
add("cut_selection", lambda s, d: I.cut_selection(_spans(table(s, d, "events")), table(s, d, "events").groupBy("user_id").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("sel_start")).withColumn("sel_end", F.col("sel_start") + 3600), "user_id").select("event_id", MICROS("start").alias("start"), MICROS("end").alias("stop")),
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + 60000000 AS b FROM events), s AS (SELECT user_id, min(a) AS s FROM e GROUP BY user_id),
       p AS (SELECT event_id, a, b, s, s + 3600000000 AS t FROM e JOIN s USING (user_id))
       SELECT event_id, a AS start, least(b, CASE WHEN a < t AND b > s THEN s ELSE b END) AS stop FROM p WHERE least(b, CASE WHEN a < t AND b > s THEN s ELSE b END) - a > 10000
       UNION ALL SELECT event_id, greatest(a, t), b FROM p WHERE a < t AND b > s AND b - greatest(a, t) > 10000""")  # fmt: skip


def _spans(events: DataFrame) -> DataFrame:
    """Events as intervals of a minute."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.select("user_id", "event_id", start.alias("start"), (start + 60).alias("end"))


# ---- aggregations ------------------------------------------------------------------------------------------------------------
SCRIPT_SQL = ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in C.SCRIPTS)
DETECT_SQL = f"""SELECT doc_id, text, lang, CASE WHEN total > 0 AND most / total >= 0.25 THEN CASE {' '.join(f"WHEN {n} = most THEN '{n}'" for n, _ in C.SCRIPTS)} END END AS script
    FROM (SELECT *, {' + '.join(n for n, _ in C.SCRIPTS)} AS total, greatest({', '.join(n for n, _ in C.SCRIPTS)}) AS most FROM (SELECT doc_id, text, lang, {SCRIPT_SQL} FROM documents))"""
add("script_detect", lambda s, d: table(s, d, DOCS).select("doc_id", T.script_detect(text).alias("script")), f"SELECT doc_id, script FROM ({DETECT_SQL})")
add("script_distribution", lambda s, d: table(s, d, DOCS).groupBy(T.script_detect(text).alias("script")).agg(F.count("*").alias("n")), f"SELECT script, count(*) AS n FROM ({DETECT_SQL}) GROUP BY script")
add("text_stats", lambda s, d: table(s, d, DOCS).select("doc_id", F.length("text").cast("bigint").alias("chars"), T.word_count(text).cast("bigint").alias("words"), T.paragraph_count(text).cast("bigint").alias("paragraphs")),
    f"SELECT doc_id, length(text) AS chars, len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) AS words, len(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_full_match(l, '{WS}*'))) AS paragraphs FROM documents")
on("paragraph_count", PAGES, "page_id", lambda: T.p_tag_count(F.col("html")), "(length(html) - length(replace(html, '<p', ''))) // 2")
EVENT_AGG = "count(*) AS n, round(sum(value), 3) AS total, round(avg(value), 6) AS mean, max(value) AS most"
FIGURES = [("events", "'u' || user_id AS audio_id", "CAST(event_id AS DOUBLE) AS start", "CAST(event_id AS DOUBLE) + CAST(event_id % 5 AS DOUBLE) / 4 AS stop", "CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 64 AS DOUBLE) / 64 END AS confidence", "CAST(greatest(0, event_id % 5 - 2) AS INTEGER) AS n_regions")]
_figures = lambda t: A.alignment_figures(_end(t).filter("n_regions > 0").withColumn("x", F.explode(F.sequence(F.lit(1), "n_regions"))), _end(t), "audio_id")
_FIGURES_SQL = "SELECT audio_id, {} AS {} FROM (SELECT audio_id, sum(n_regions) AS m, sum(coalesce(confidence, 0) * n_regions) AS c, count(*) AS k, avg(greatest(0.01, stop - start)) AS d FROM fx GROUP BY audio_id) WHERE m > 0"
for _name, _column_name, _sql in (("matched", "matched", "m"), ("avg_confidence", "avg_confidence", "round(c / m, 9)"), ("avg_duration", "avg_duration", "round(d, 9)"), ("unused_intervals", "unused_intervals", "greatest(0, k - m)")):
    derived(_name, FIGURES, lambda t, c=_column_name: _figures(t).select("audio_id", F.round(c, 9).alias(c)), _FIGURES_SQL.format(_sql, _column_name))
add("total_weight", lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.round(F.sum(I.target_weight(F.when(F.col("value") > 50, F.col("value")), F.col("event_id").cast("int") % 3)), 3).alias("total")), "SELECT user_id, round(sum(CASE WHEN value > 50 THEN value WHEN event_id % 3 > 0 THEN event_id % 3 ELSE 1 END), 3) AS total FROM events GROUP BY user_id")
add("interval_totals", lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most")), f"SELECT event_type, {EVENT_AGG} FROM events GROUP BY event_type")
add("energy_percentiles", lambda s, d: order_statistics(table(s, d, "events"), "user_id", value="value", shares={"p05": 0.05, "p15": 0.15, "p50": 0.5}).drop("n"), "SELECT user_id, v[CAST(floor(len(v) * 0.05) AS INTEGER) + 1] AS p05, v[CAST(floor(len(v) * 0.15) AS INTEGER) + 1] AS p15, v[CAST(floor(len(v) * 0.5) AS INTEGER) + 1] AS p50 FROM (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY user_id)")


def _signals(s: SparkSession, d: str) -> DataFrame:
    """(user_id, i, v): each user's events in order as a signal; an event sounds for eight samples, and five loud ones and five silent ones take turns."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    ranked = table(s, d, "events").select("user_id", (F.row_number().over(order) - 1).alias("r"), "value")
    return ranked.select("user_id", F.explode(F.sequence(F.col("r") * 8, F.col("r") * 8 + 7)).alias("i"), F.when(F.floor(F.col("r") / 5) % 2 == 0, F.col("value")).otherwise(0.0).alias("v"))


SIGNALS_SQL = """r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, value FROM events),
    v AS (SELECT user_id, r * 8 + k AS i, CASE WHEN r // 5 % 2 = 0 THEN value ELSE 0 END AS v FROM r CROSS JOIN (SELECT unnest(range(8)) AS k)),
    f AS (SELECT user_id, i AS frame, sqrt(avg(v * v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) AS e, count(*) OVER (PARTITION BY user_id) - 2 AS n FROM v),
    g AS (SELECT user_id, frame, e, n FROM f WHERE frame < n), s AS (SELECT user_id, list_sort(list(e)) AS l FROM g GROUP BY user_id),
    h AS (SELECT g.*, e > greatest(l[CAST(floor(len(l) * 0.05) AS INTEGER) + 1] * 3.5, l[CAST(floor(len(l) * 0.15) AS INTEGER) + 1] * 1.5, l[CAST(floor(len(l) * 0.5) AS INTEGER) + 1] * 0.2, 0.005) AS loud FROM g JOIN s USING (user_id))"""
# Stretches: a loud frame more than 25 after the last one begins another; the last one runs to the end unless 25 silent frames follow.
STRETCHES_SQL = """SELECT user_id, round(a * 0.01::DOUBLE, 6) AS start, round(b * 0.01::DOUBLE, 6) AS stop FROM (SELECT user_id, min(frame) AS a, CASE WHEN any_value(n) - 1 - max(frame) < 25 THEN any_value(n) ELSE max(frame) END AS b FROM (
    SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY user_id ORDER BY frame) AS k FROM (SELECT *, coalesce(frame - lag(frame) OVER (PARTITION BY user_id ORDER BY frame) > 25, true) AS fresh FROM {loud})) GROUP BY user_id, k) WHERE b - a >= 20"""
add("rms_energy", lambda s, d: A.energy_table(_signals(s, d), "user_id", rate=1000).select("user_id", "frame", F.round("energy", 6).alias("energy")),
    f"WITH {SIGNALS_SQL} SELECT user_id, i // 10 AS frame, round(e, 6) AS energy FROM (SELECT user_id, i, sqrt(avg(v * v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)) AS e, count(*) OVER (PARTITION BY user_id) AS n FROM v) WHERE i % 10 = 0 AND i + 30 <= n")
add("peaks", lambda s, d: A.peaks(_signals(s, d), "user_id", points=50), f"WITH {SIGNALS_SQL}, m AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM v) SELECT user_id, i // greatest(1, n // 50) AS bucket, max(abs(v)) AS peak FROM m GROUP BY 1, 2")
_channels = lambda s, d: _signals(s, d).unionByName(_signals(s, d).withColumn("v", F.col("i") / 8 - F.col("v")))
add("mono_mix", lambda s, d: A.mono_table(_channels(s, d), "user_id").select("user_id", "i", F.round("v", 6).alias("v")), f"WITH {SIGNALS_SQL} SELECT user_id, i, round(i / 16::DOUBLE, 6) AS v FROM v")
add("first_wins_distinct", lambda s, d: K.first_wins(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey"), "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
CATALOG = "SELECT lang AS category, source AS filename, doc_id AS pos FROM documents"
_catalog = lambda s, d: table(s, d, DOCS).select(F.col("lang").alias("category"), F.col("source").alias("filename"), F.col("doc_id").alias("pos"))
add("cross_category_distinct", lambda s, d: K.union_categories(_catalog(s, d)), f"SELECT category, filename, pos FROM (SELECT category, filename, min(pos) AS pos FROM ({CATALOG}) GROUP BY 1, 2) ORDER BY category, pos LIMIT 50")
add("last_wins_by_pos", lambda s, d: K.last_wins(table(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id"), "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
_of_lang = lambda s, d: table(s, d, DOCS).select("lang", F.concat("text", F.lit(" jñāna "), "source", F.lit("vya"), F.lit(" svar")).alias("text"))
add("rule_counts", lambda s, d: _of_lang(s, d).select("lang", *T.rule_counts(F.col("text"))).groupBy("lang").agg(*[F.sum(n).alias(n) for n in ("n_sv", "n_vy", "n_jna")]), "SELECT lang, sum(len(string_split(x, 'sv')) - 1) AS n_sv, sum(len(string_split(x, 'vy')) - 1) AS n_vy, sum(len(string_split(x, 'jñ')) - 1) AS n_jna FROM (SELECT lang, text || ' jñāna ' || source || 'vya' || ' svar' AS x FROM documents) GROUP BY lang")
# ---- order-dependent computations --------------------------------------------------------------------------------------------
LETTERS_SQL = f"""WITH c AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS ch FROM (SELECT doc_id, string_split(text, '') AS s FROM documents)),
    m AS (SELECT *, CASE WHEN NOT regexp_full_match(ch, '{WS}|[\\x{{300}}-\\x{{36f}}\\x{{2ce}}·]') THEN ch END AS letter FROM c),
    w AS (SELECT *, lead(letter IGNORE NULLS) OVER o AS next_letter, lag(letter IGNORE NULLS) OVER o AS prev_letter FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY pos))"""
_pairs = lambda name, found: lambda s, d: table(s, d, DOCS).select(F.explode(found(F.col("text"), "r")).alias(name)).groupBy(name).agg(F.count("*").alias("n"))
add("next_letter", _pairs("next_letter", T.following_letters), f"{LETTERS_SQL} SELECT next_letter, count(*) AS n FROM w WHERE letter = 'r' AND next_letter IS NOT NULL GROUP BY 1")
add("prev_letter", _pairs("prev_letter", T.preceding_letters), f"{LETTERS_SQL} SELECT prev_letter, count(*) AS n FROM w WHERE letter = 'r' AND prev_letter IS NOT NULL GROUP BY 1")
on("prev_vowel", DOCS, "doc_id", lambda: T.previous_vowel(text_lower(), (F.col("doc_id") * 7 % F.length(text)).cast("int"), "ṁṃḥ"), "coalesce(list_last(list_filter(string_split(left(lower(text), CAST(doc_id * 7 % length(text) AS INTEGER)), ''), lambda c: instr('aāiīuūṛṝḷḹeoṁṃḥ', c) > 0)), '')", "length(text) > 0")
# Character references by the table of the HTML standard: numbers, whole names, and the longest name without a semicolon that a reference begins with.
CODES = ", ".join(f"{code}: {literal(value)}" for code, value in sorted(html_std._invalid_charrefs.items()) if value not in "\0\r")
NAMES = ", ".join(f"{literal(name)}: {literal(value)}" for name, value in sorted(html5.items()))
SHORT_NAMES = ", ".join(literal(name) for name in sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
TEXT_SQL = rf"""ent AS (SELECT map {{{NAMES}}} AS names, [{SHORT_NAMES}] AS short, map {{{CODES}}} AS codes),
    t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?i)<br\s*/?\s*>|</p>|</div>', chr(10), 'g'), '<[^>]+>', '', 'g') AS x FROM pages),
    r AS (SELECT page_id, x, generate_subscripts(refs, 1) AS k, unnest(refs) AS ref FROM (SELECT page_id, x, list_concat(regexp_extract_all(x, '&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\x0C <&#;]{{1,32}};?)'), ['']) AS refs FROM t)),
    n AS (SELECT page_id, x, k, ref, CASE WHEN ref LIKE '&#%' THEN CASE WHEN lower(ref[3:3]) = 'x' THEN CAST('0x' || rtrim(ref[4:], ';') AS BIGINT) ELSE CAST(rtrim(ref[3:], ';') AS BIGINT) END END AS code FROM r),
    v AS (SELECT page_id, x, k, ref, CASE WHEN ref = '' THEN '' WHEN code IS NOT NULL THEN coalesce(codes[code], CASE WHEN code BETWEEN 55296 AND 57343 OR code > 1114111 THEN chr(65533) ELSE chr(code::INTEGER) END)
                 ELSE coalesce(names[ref[2:]], (SELECT names[list_filter(short, lambda s: starts_with(ref[2:], s))[1]] || ref[2 + length(list_filter(short, lambda s: starts_with(ref[2:], s))[1]):]), ref) END AS value FROM n, ent),
    w AS (SELECT page_id, any_value(regexp_split_to_array(x, '&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\x0C <&#;]{{1,32}};?)')) AS parts, list(value ORDER BY k) AS vals FROM v GROUP BY page_id),
    u AS (SELECT page_id, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || vals[i]), '') AS x FROM w)"""
VERSES_SQL = rf"""WITH {TEXT_SQL},
    l AS (SELECT page_id, generate_subscripts(s, 1) - 1 AS line_no, regexp_replace(unnest(s), '^{WS}+|{WS}+$', '', 'g') AS line FROM (SELECT page_id, string_split(x, chr(10)) AS s FROM u)),
    k AS (SELECT *, count(*) FILTER (WHERE regexp_matches(line, '[.!?]$')) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS verse_no FROM l WHERE line <> '')
    SELECT page_id, verse_no, string_agg(line, chr(10) ORDER BY line_no) AS verse, count(*) AS n_lines FROM k GROUP BY 1, 2"""
add("verse_extraction", lambda s, d: pipelines.verse_extraction(table(s, d, PAGES), end=F.regexp_like("line", F.lit("[.!?]$"))), VERSES_SQL)
add("verse_split", lambda s, d: L.verse_split(_body(s, d), "doc_id").groupBy("doc_id").agg(F.max("verse_no").alias("verses"), F.sum("n_lines").alias("lines")), "")
# Lines of all documents under Devanagari ones: every seventh ends a verse, the last ones are footers, accents begin at the third.
DEVA_LINES = "concat(CASE WHEN line_no % 7 = 6 THEN concat('रामो राजमणिः ॥ ', line_no, ' ॥') WHEN line_no >= n - doc_id % 3 THEN 'Encoded by क ख ग घ' WHEN line_no = 2 THEN 'अ॒ग्निमी॑ळे पुरोहितं' WHEN line_no % 5 = 4 THEN line ELSE 'दे॒वं यज्ञस्य' END)"
DEVA_SQL = "CASE WHEN line_no % 7 = 6 THEN 'रामो राजमणिः ॥ ' || line_no || ' ॥' WHEN line_no >= n - doc_id % 3 THEN 'Encoded by क ख ग घ' WHEN line_no = 2 THEN 'अ॒ग्निमी॑ळे पुरोहितं' WHEN line_no % 5 = 4 THEN line ELSE 'दे॒वं यज्ञस्य' END"
_deva = lambda s, d: table(s, d, DOCS).select("doc_id", F.split("text", "[.\n]").alias("l")).select("doc_id", F.size("l").alias("n"), F.posexplode("l").alias("line_no", "line")).select("doc_id", "line_no", F.expr(DEVA_LINES).alias("line")).filter(L.is_devanagari(F.col("line")))
DEVA_CTE = f"""dl AS (SELECT doc_id, len(l) AS n, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '[.\\n]') AS l FROM documents)),
    dv AS (SELECT doc_id, line_no, {DEVA_SQL} AS line FROM dl), df AS (SELECT *, len(regexp_extract_all(line, '[\\x{{900}}-\\x{{97f}}]')) AS c FROM dv), dk AS (SELECT doc_id, line_no, line, line LIKE 'Encoded%' AS foot FROM df WHERE c >= 3 AND c > 0.3 * length(replace(line, ' ', ''))),
    dt AS (SELECT * FROM (SELECT *, max(line_no) FILTER (WHERE NOT foot) OVER (PARTITION BY doc_id) AS last FROM dk) WHERE line_no <= last),
    dp AS (SELECT *, coalesce(line_no < min(line_no) FILTER (WHERE regexp_matches(line, '[\\x{{951}}\\x{{952}}\\x{{1cda}}]')) OVER (PARTITION BY doc_id), false) AS pre FROM dt),
    dn AS (SELECT *, CASE WHEN pre THEN 0 ELSE 1 + coalesce(count(*) FILTER (WHERE line LIKE '% ॥ % ॥') OVER (PARTITION BY doc_id, pre ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS verse_no FROM dp)"""
_body = lambda s, d: L.preamble_split(L.footer_trim(_deva(s, d), "doc_id"), "doc_id")
SQL["dev_line_filter"] = f"WITH {DEVA_CTE} SELECT doc_id, line_no FROM dk"
SQL["footer_trim"] = f"WITH {DEVA_CTE} SELECT doc_id, line_no FROM dt"
SQL["preamble_split"] = f"WITH {DEVA_CTE} SELECT doc_id, line_no, pre AS preamble FROM dp"
SQL["verse_split"] = f"WITH {DEVA_CTE} SELECT doc_id, max(verse_no) AS verses, count(*) AS lines FROM dn GROUP BY doc_id"
add("verse_number", lambda s, d: L.verse_split(_body(s, d), "doc_id").select("doc_id", "verse_no", "n_lines", F.md5("verse").alias("verse")), f"WITH {DEVA_CTE} SELECT doc_id, verse_no, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS verse FROM dn GROUP BY 1, 2")
add("merge_nearby", lambda s, d: I.merge_nearby(_spans(table(s, d, "events")), "user_id", gap=3600).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 2).alias("total")),
    """WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + 60 AS b FROM events), i AS (SELECT *, coalesce(a - lag(b) OVER o > 3600, true) AS fresh FROM e WINDOW o AS (PARTITION BY user_id ORDER BY a)),
       g AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY user_id ORDER BY a, b) AS k FROM i), m AS (SELECT user_id, k, min(a) AS a, max(b) AS b FROM g GROUP BY 1, 2)
       SELECT user_id, count(*) AS n, round(sum(b - a), 2) AS total FROM m GROUP BY 1""")  # fmt: skip
# Intervals whose gaps all differ.
INTERVALS = [("events", "'u' || user_id AS audio_id", "CAST(event_id AS DOUBLE) AS start", "CAST(event_id AS DOUBLE) + 0.25 + CAST(event_id AS DOUBLE) / 1048576 AS stop")]
derived("merge_to_count", INTERVALS, lambda t: I.merge_to_count(_end(t), 2, "audio_id").select("audio_id", "start", F.col("end").alias("stop")),
      """, g AS (SELECT *, lead(start) OVER (PARTITION BY audio_id ORDER BY start) - stop AS gap FROM fx), c AS (SELECT *, gap IN (SELECT unnest(list_sort(list(h.gap), 'DESC')[1:1]) FROM g h WHERE h.audio_id = g.audio_id AND h.gap IS NOT NULL) AS cut FROM g)
      SELECT audio_id, min(start) AS start, max(stop) AS stop FROM (SELECT *, coalesce(sum(CAST(cut AS INTEGER)) OVER (PARTITION BY audio_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM c) GROUP BY audio_id, k""")  # fmt: skip
add("gap_features", lambda s, d: I.gap_features(_spans(table(s, d, "events")), "user_id").select("event_id", F.round("mid", 3).alias("mid"), F.round("gap_before", 3).alias("gap_before"), F.round("gap_after", 3).alias("gap_after"), F.round("max_gap", 3).alias("max_gap")),
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + 60 AS b FROM events), g AS (SELECT event_id, (a + b) / 2 AS mid, coalesce(greatest(0, a - lag(b) OVER o), 0) AS x, coalesce(greatest(0, lead(a) OVER o - b), 0) AS y FROM e WINDOW o AS (PARTITION BY user_id ORDER BY a, b))
       SELECT event_id, round(mid, 3) AS mid, round(x, 3) AS gap_before, round(y, 3) AS gap_after, round(greatest(x, y), 3) AS max_gap FROM g""")  # fmt: skip
WEIGHTS = [("conversations", "'a' || conv_id AS audio_id", "CAST(turn AS INTEGER) AS ord", "CASE WHEN turn % 4 < 3 THEN CAST(1 + length(text) % 5 AS INTEGER) END AS syllables")]
derived("cum_weights", WEIGHTS, lambda t: I.running_share(t.withColumn("weight", F.coalesce("syllables", F.lit(1))), "audio_id").select("audio_id", "ord", F.round("share_from", 6).alias("share_from"), F.round("share_to", 6).alias("share_to")), "SELECT audio_id, ord, round(coalesce((SELECT sum(coalesce(syllables, 1)) FROM fx b WHERE b.audio_id = a.audio_id AND b.ord < a.ord), 0) / (SELECT sum(coalesce(syllables, 1)) FROM fx b WHERE b.audio_id = a.audio_id), 6) AS share_from, round((SELECT sum(coalesce(syllables, 1)) FROM fx b WHERE b.audio_id = a.audio_id AND b.ord <= a.ord) / (SELECT sum(coalesce(syllables, 1)) FROM fx b WHERE b.audio_id = a.audio_id), 6) AS share_to FROM fx a")
derived("proportional_split", WEIGHTS, lambda t: I.proportional_split(t, F.lit(8.0), "audio_id").select("audio_id", "ord", F.round("start", 6).alias("start"), F.round("end", 6).alias("stop")), "SELECT audio_id, ord, round(8 * (w - s) / t, 6) AS start, round(8 * w / t, 6) AS stop FROM (SELECT audio_id, ord, coalesce(syllables, 1) AS s, sum(coalesce(syllables, 1)) OVER (PARTITION BY audio_id ORDER BY ord) AS w, sum(coalesce(syllables, 1)) OVER (PARTITION BY audio_id) AS t FROM fx)")
derived("gap_candidates", INTERVALS, lambda t: I.gap_candidates(_end(t), "audio_id").select("audio_id", F.round("time", 6).alias("time"), F.round("gap", 6).alias("gap")), "SELECT a.audio_id, round((a.stop + b.start) / 2, 6) AS time, round(b.start - a.stop, 6) AS gap FROM fx a JOIN fx b ON a.audio_id = b.audio_id AND b.start = (SELECT min(c.start) FROM fx c WHERE c.audio_id = a.audio_id AND c.start > a.start)")
add("toc", lambda s, d: table(s, d, PAGES).select("page_id", F.explode(L.headings(F.col("html"))).alias("h")).select("page_id", "h.id", "h.level", "h.text"),
    rf"""SELECT page_id, 'heading-' || (i - 1) AS id, CAST(l AS INTEGER) AS level, CASE WHEN x = '' THEN 'Untitled' ELSE x END AS text FROM (SELECT page_id, generate_subscripts(t, 1) AS i, unnest(ls) AS l, regexp_replace(regexp_replace(unnest(t), '<[^>]+>', '', 'g'), '^{WS}+|{WS}+$', '', 'g') AS x
       FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1) AS ls, regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2) AS t FROM pages))""")  # fmt: skip
_recents = lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("path"), (F.col("c_custkey") * 37 % 101).cast("bigint").alias("last_accessed"), (F.col("c_custkey") * 53 % 89).cast("bigint").alias("last_saved"))
RECENTS_SQL = "(SELECT c_custkey AS ord, c_name AS path, c_custkey * 37 % 101 AS last_accessed, c_custkey * 53 % 89 AS last_saved FROM customer)"
_own_recents = lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") * 37 % 101).cast("bigint").alias("last_accessed"), F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") * 53 % 89).cast("bigint")).alias("last_saved"))
add("recents_rank", lambda s, d: K.recents_rank(_own_recents(s, d), "owner").select("owner", "ord", "rank"), "SELECT o_custkey AS owner, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY greatest(o_orderkey * 37 % 101, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey * 53 % 89 ELSE 0 END) DESC, o_orderkey) AS rank FROM orders")
# ---- sorts, limits, top-k ----------------------------------------------------------------------------------------------------
add("recents_topk", lambda s, d: K.recents_topk(_recents(s, d)).select("ord", "path", "seen"), f"SELECT ord, path, greatest(last_accessed, last_saved) AS seen FROM {RECENTS_SQL} ORDER BY seen DESC, ord LIMIT 20")
add("recents_cap", lambda s, d: K.recents_upsert(_recents(s, d), "/Customer#000000003", "open", 1000).select("path", "last_accessed", "last_saved"),
    f"SELECT path, last_accessed, last_saved FROM (SELECT -1 AS ord, '/Customer#000000003' AS path, 1000 AS last_accessed, coalesce(max(last_saved), 0) AS last_saved FROM {RECENTS_SQL} WHERE path = 'Customer#000000003' UNION ALL SELECT * FROM {RECENTS_SQL} WHERE path <> 'Customer#000000003') ORDER BY ord LIMIT 50")
add("media_sort", lambda s, d: K.media_sort(table(s, d, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey")
derived("region_sort", FX, lambda t: I.region_sort(t).select("id"), "SELECT id FROM fx ORDER BY start, id")
PLANS = [("documents", "doc_id AS id", f"CASE doc_id % {len(K.METRES) + 2} {' '.join(f'WHEN {k} THEN {literal(p[2])}' for k, p in enumerate(K.METRES.values()))} WHEN {len(K.METRES)} THEN '' ELSE '4\u030d2\u03314\u03310\u030d' END || doc_id % 30 || '\u030e' AS plan")]
derived("plan_sort", PLANS, lambda t: t.select("id", F.posexplode(K.svara_plan(F.col("plan"))).alias("n", "p")).select("id", "n", "p.pos", "p.mark"), "SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS n, pos, mark FROM (SELECT id, CAST(p AS INTEGER) AS pos, arg_max(m, k) AS mark FROM (SELECT id, generate_subscripts(a, 1) AS k, unnest(a) AS p, unnest(b) AS m FROM (SELECT id, regexp_extract_all(plan, '([0-9]+)([^0-9])', 1) AS a, regexp_extract_all(plan, '([0-9]+)([^0-9])', 2) AS b FROM fx)) WHERE p <> '0' GROUP BY 1, 2)")
add("result_limit", lambda s, d: K.search(_catalog(s, d).withColumnsRenamed({"category": "romanized"}).withColumn("title", F.lit("")), "src").orderBy("pos").limit(50).select("pos"), "SELECT doc_id AS pos FROM documents WHERE source LIKE '%src%' ORDER BY doc_id LIMIT 50")
on("preview_limit", DOCS, "doc_id", lambda: K.preview(F.split("text", " ")), "array_to_string(string_split(text, ' ')[1:3], '|') || CASE WHEN len(string_split(text, ' ')) > 3 THEN ' +' || (len(string_split(text, ' ')) - 3) ELSE '' END")
on("timeline_step", "events", "event_id", lambda: K.timeline_step(F.col("value")), "coalesce((SELECT min(s) FROM (SELECT unnest([0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 15.0, 30.0, 60.0, 120.0, 300.0, 600.0]::DOUBLE[]) AS s) WHERE s >= value), 600.0::DOUBLE)")

# ---- set operations ----------------------------------------------------------------------------------------------------------
add("union_categories", lambda s, d: K.first_wins(_catalog(s, d), ["filename"], ["category", "pos"]).select("category", "filename", "pos"), f"SELECT (arg_min(category, (category, pos))) AS category, filename, arg_min(pos, (category, pos)) AS pos FROM ({CATALOG}) GROUP BY filename")
derived("invert_selection", [("events", "event_id AS id", "CAST(event_id % 20 AS DOUBLE) / 4 AS a", "CAST(event_id % 20 + event_id % 9 AS DOUBLE) / 4 AS b", "CAST(5 AS DOUBLE) AS d")], lambda t: t.select("id", F.explode(I.invert_selection(F.col("a"), F.col("b"), F.col("d"))).alias("p")).select("id", "p.start", F.col("p.end").alias("stop")), "SELECT id, 0.0::DOUBLE AS start, a AS stop FROM fx WHERE a > 0.05 UNION ALL SELECT id, b, d FROM fx WHERE d - b > 0.05")
add("recents_remove", lambda s, d: K.recents_remove(_recents(s, d), table(s, d, "customer").filter("c_nationkey = 3").select(F.upper("c_name").alias("path"))).select("ord"), "SELECT c_custkey AS ord FROM customer WHERE c_nationkey <> 3")
derived("remove_selected", FX, lambda t: K.remove_selected(t, t.filter("id IN (2, 5)").select("id")).select("id"), "SELECT id FROM fx EXCEPT SELECT unnest([2, 5])")
# ---- texts made of every kind of sign: each word of each document stands for one ----------------------------------------------
SIGNS = [*C.VOWELS, *C.CONSONANTS, *"ḥṁrmaiāsśvy", " ", " ", " ", " ", "oṁ ", "\n", "|", "।", "॥", *C.SVARA, "\u0306", "m̐", "m̐g", "m̐gṁ", "̐", "jñ", "kṣ", "sv", "vy", "x"]
TRADITIONS = ("yajurveda", "rigveda", "smriti")
STRETCH = "(?:[^ \n]+[ \n]+){0,17}[^ \n]+"


def word_at(n: int) -> str:
    """Which of n things the word w stands for, from 0; reads alike in both dialects."""
    return f"(ascii(w) * 31 + ascii(substr(w, 2)) * 7 + ascii(reverse(w)) * 131 + length(w)) % {n}"


def stretches(s: SparkSession, d: str) -> DataFrame:
    """(id, words): every document in stretches of up to 18 words."""
    parts = table(s, d, DOCS).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(STRETCH), F.lit(0))).alias("k", "p"))
    return parts.select((F.col("doc_id") * 100000 + F.col("k")).alias("id"), F.filter(F.split("p", "[ \n]+"), lambda w: w != "").alias("words"))


STRETCHES = f"""sp AS (SELECT doc_id * 100000 + k - 1 AS id, list_filter(regexp_split_to_array(p, '[ \n]+'), lambda w: w <> '') AS words FROM (
    SELECT doc_id, generate_subscripts(a, 1) AS k, unnest(a) AS p FROM (SELECT doc_id, regexp_extract_all(text, '{STRETCH}') AS a FROM documents)))"""


def written(values: list[str]) -> tuple[str, str]:
    """The text that a list of words stands for, in Spark's SQL and in DuckDB's."""
    return (f"array_join(transform(words, w -> element_at(array({in_list(values)}), cast({word_at(len(values))} AS int) + 1)), '')", f"array_to_string(list_transform(words, lambda w: ([{in_list(values)}])[CAST({word_at(len(values))} AS INTEGER) + 1]), '')")


# Positions and marks by the words of documents, more than one for some positions.
MARKS = ("\u030d", "\u0331", "\u030e", "\u02ce", "·", "?")
_planned = f"array_join(transform(words, w -> concat(length(w) * 7 % 23, element_at(array({in_list(MARKS)}), cast({word_at(6)} AS int) + 1))), '')"
add("auto_svara_plan", lambda s, d: stretches(s, d).select("id", K.svara_plan(F.expr(_planned)).alias("p")).select("id", F.posexplode("p").alias("n", "p")).select("id", "n", "p.pos", "p.mark"),
    f"""WITH {STRETCHES}, m AS (SELECT id, j, length(w) * 7 % 23 AS pos, ([{in_list(MARKS)}])[CAST({word_at(6)} AS INTEGER) + 1] AS mark FROM (SELECT id, generate_subscripts(words, 1) AS j, unnest(words) AS w FROM sp)),
       l AS (SELECT id, pos, arg_max(mark, j) AS mark FROM m WHERE pos > 0 AND mark <> '?' GROUP BY 1, 2) SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS n, CAST(pos AS INTEGER) AS pos, mark FROM l""")  # fmt: skip


def signs(s: SparkSession, d: str) -> DataFrame:
    """(id, source, t): texts of up to 18 signs."""
    return stretches(s, d).select("id", F.expr(f"element_at(array({in_list(TRADITIONS)}), cast(id % 3 AS int) + 1)").alias("source"), F.expr(written(SIGNS)[0]).alias("t"))


# The same in SQL: texts; their characters with flags; what stands before and after each. Annotations are shown as U+E001 in t2.
SIGNS_SQL = f"""{STRETCHES}, fx AS (SELECT id, ([{in_list(TRADITIONS)}])[id % 3 + 1] AS source, {written(SIGNS)[1]} AS t FROM sp),
    t2 AS (SELECT *, replace(replace(replace(replace(t, 'm̐gṁ', repeat(chr(57345), 4)), 'm̐g', repeat(chr(57345), 3)), 'm̐', repeat(chr(57345), 2)), '̐', chr(57345)) AS t2 FROM fx),
    ch AS (SELECT id, source, t, t2, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS c, unnest(b) AS c2 FROM (SELECT *, string_split(t, '') AS a, string_split(t2, '') AS b FROM t2)),
    fl AS (SELECT *, NOT regexp_full_match(c2, '{WS}|[\\x{{300}}-\\x{{36f}}{C.SVARA}\\x{{e001}}]') AS letter FROM ch),
    pl AS (SELECT id, list({{'pos': pos, 'c': c}} ORDER BY pos) AS l FROM fl WHERE letter GROUP BY id),
    nx AS (SELECT fl.*, list_filter(l, lambda x: x.pos > fl.pos)[1:3] AS n, list_last(list_filter(l, lambda x: x.pos < fl.pos)).c AS p,
                  coalesce(array_to_string(list_transform(list_filter(l, lambda x: x.pos > fl.pos)[1:3], lambda x: x.c), ''), '') AS letters FROM fl LEFT JOIN pl USING (id))"""
VOWEL_SQL = f"(?:ai|au|[{''.join(v for v in C.VOWELS if len(v) == 1)}])"
LONG_SQL = in_list(C.LONG_VOWELS)
CONSONANT_SQL = f"(?:{'|'.join(C.ASPIRATES)}|[{''.join(c for c in C.CONSONANTS if len(c) == 1)}])"
BETWEEN_SQL = f"[{WS[1:-1]}\\x{{300}}-\\x{{36f}}{C.SVARA}\\x{{e001}}]"
# Clusters: runs of consonants across what isn't a letter; the members of each, with the white space before it; the one that is held.
CLUSTERS_SQL = f"""tok AS (SELECT id, generate_subscripts(a, 1) AS k, unnest(a) AS tok FROM (SELECT *, regexp_extract_all(t2, '(?s){CONSONANT_SQL}(?:{BETWEEN_SQL}*{CONSONANT_SQL})*|.') AS a FROM t2)),
    tk AS (SELECT *, sum(length(tok)) OVER (PARTITION BY id ORDER BY k) - length(tok) AS start, last_value(CASE WHEN tok IN ({in_list(v for v in C.VOWELS if len(v) == 1)}) THEN tok END IGNORE NULLS) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS vowel FROM tok),
    mem AS (SELECT id, start, vowel, generate_subscripts(m, 1) AS k, unnest(m) AS m, len(m) AS size FROM (SELECT *, regexp_extract_all(tok, '{BETWEEN_SQL}*{CONSONANT_SQL}') AS m FROM tk WHERE regexp_matches(tok, '^{CONSONANT_SQL}')) WHERE len(m) > 1),
    mc AS (SELECT *, regexp_extract(m, '{CONSONANT_SQL}$') AS c, regexp_matches(m, '^{BETWEEN_SQL}*?{WS}') AS gap, start + sum(length(m)) OVER (PARTITION BY id, start ORDER BY k) AS stop FROM mem),
    mf AS (SELECT *, c = lead(c) OVER w AS twin, coalesce(min(k) FILTER (WHERE gap) OVER (PARTITION BY id, start), 1) AS first_k FROM mc WINDOW w AS (PARTITION BY id, start ORDER BY k)),
    hk AS (SELECT id, start, any_value(size) AS size, coalesce(min(k) FILTER (WHERE twin), min(k) FILTER (WHERE k >= first_k AND (c NOT IN ({in_list(C.NO_HOLDING)}) OR gap AND c IN ({in_list(C.SIBILANTS)}))), max(k)) AS k FROM mf GROUP BY id, start),
    hold AS (SELECT id, hk.start, hk.size, CAST(stop - length(c) AS INTEGER) AS held, length(c) AS length, CASE WHEN vowel IN ({LONG_SQL}) THEN 'long' ELSE 'short' END AS type FROM hk JOIN mf USING (id, start, k))"""
# Decision tables of the rules for anusvara and visarga: `shown` is the new text, superscripts in brackets.
PLAIN_SIGN = "CASE n[1].c WHEN 'v' THEN '[u]' WHEN 'l' THEN '[l]' WHEN 'y' THEN '[i]' ELSE '' END"
ANUSVARA_SQL = f"""an AS (SELECT id, source, t, pos, 1 AS del, CASE
      WHEN source = 'rigveda' THEN c || {PLAIN_SIGN}
      WHEN source <> 'yajurveda' THEN 'ṁ'
      WHEN letters = 'ghn' OR letters LIKE 'jñ%' THEN 'ṁ'
      WHEN n[1].c IN ('ś', 'ṣ', 's', 'h', 'r') THEN 'm̐[g]' || CASE WHEN n[2].c IS NULL OR n[2].c NOT IN ({in_list(c for c in C.NON_VOWELS if len(c) == 1)}) THEN '[ṁ]' WHEN p IN ('a', 'i', 'u') THEN '[g]' ELSE '' END
      WHEN n[1].c IN ('v', 'l', 'y') THEN 'ṁ' || {PLAIN_SIGN}
      WHEN n[1].c IN ('k', 'g', 'ṅ') THEN 'ṅ' WHEN n[1].c IN ('c', 'j', 'ñ') THEN 'ñ' WHEN n[1].c IN ('ṭ', 'ḍ', 'ṇ') THEN 'ṇ' WHEN n[1].c IN ('t', 'd', 'n') THEN 'n' WHEN n[1].c IN ('p', 'b', 'm') THEN 'm' ELSE 'ṁ' END AS shown
    FROM nx WHERE c2 IN ('ṁ', 'ṃ') AND lower(trim(regexp_extract(substr(t, 1, pos + 1), '[^\\n]*$'))) NOT IN ({in_list(C.BIJA)})
    UNION ALL SELECT id, source, t, pos, 2, 'm̐' FROM nx WHERE source = 'rigveda' AND c = 'm' AND c2 = chr(57345) AND letters <> '' AND n[1].c IN ('ś', 'ṣ', 's', 'h', 'r'))"""
VISARGA_SQL = f"""vi AS (SELECT id, t, pos, CASE
      WHEN n[1].c = 'p' THEN 'ḥ[f]' WHEN n[1].c IN ('ś', 'ṣ', 's') THEN n[1].c
      WHEN (n[1].c IN ({in_list(c for c in C.VOICED if len(c) == 1)}) OR n[1].c IN ({in_list(v for v in C.VOWELS if len(v) == 1)})) AND coalesce(p, '') NOT IN ('a', 'ā') THEN 'r'
      WHEN letters LIKE 'kṣ%' THEN 'ḥ:' || CASE WHEN p IS NULL THEN '' ELSE '[' || p || ']' END
      WHEN n[1].c = 'c' THEN 'ś' WHEN n[1].c = 'ṭ' THEN 'ṣ' WHEN n[1].c = 't' THEN 's' END AS shown FROM nx WHERE c = 'ḥ')"""
_shown = lambda e: F.array_join(F.transform(e["parts"], lambda p: F.when(p["superscript"], F.concat(F.lit("["), p["text"], F.lit("]"))).otherwise(p["text"])), "")


def _edit_rows(t: DataFrame, edits: Column) -> DataFrame:
    return t.select("id", "source", F.explode(edits).alias("e")).select("id", "source", F.col("e.idx").alias("pos"), F.col("e.del").alias("del"), F.when(F.col("e.changed"), _shown(F.col("e"))).alias("shown"))


def on_signs(name: str, query: Callable[[DataFrame], DataFrame], sql: str, *parts: str) -> None:
    """A query over the texts of signs(); sql: the same over the tables of SIGNS_SQL (and of parts)."""
    add(name, lambda s, d: query(signs(s, d)), f"WITH {', '.join((SIGNS_SQL, *parts))} {sql}")


# ---- strings -----------------------------------------------------------------------------------------------------------------
NORMALIZE_SQL = f"replace(regexp_replace(replace(replace(replace(replace(translate(lower(text), '{C.STANDARD_FROM}', '{C.STANDARD_TO}'), '(g)m', 'ṁ'), '(g)ṁ', 'ṁ'), '(g̱)ṁ', 'ṁ'), '(g̱)m', 'ṁ'), '\\.{WS}*\\.', '॥', 'g'), '.', '।')"
on("normalize_text", DOCS, "doc_id", lambda: F.md5(T.normalize_text(text)), f"md5({NORMALIZE_SQL})")
on_signs("normalize_anusvara", lambda t: t.select("id", T.normalize_anusvara(F.col("t")).alias("value"), T.normalize_anusvara(F.col("t"), True).alias("rigveda")), "SELECT id, replace(regexp_replace(t, 'm̐(gg?ṁ?)?', 'ṁ', 'g'), '̐', '') AS value, replace(replace(regexp_replace(t, 'm̐(gg?ṁ?)?', '\u0001', 'g'), '̐', ''), '\u0001', 'm̐') AS rigveda FROM fx")
on_signs("vowel_union", lambda t: t.select("id", F.explode(F.filter(F.array_union(F.array(*map(F.lit, C.SHORT_VOWELS)), F.array(*map(F.lit, C.LONG_VOWELS))), lambda v: F.contains("t", v))).alias("v")), "SELECT id, v FROM fx CROSS JOIN (SELECT unnest(string_split('a i u ṛ ḷ ā ī ū ṝ ḹ e ai o au', ' ')) AS v) WHERE instr(t, v) > 0")
on_signs("is_combining", lambda t: t.select("id", F.posexplode(F.split("t", "")).alias("pos", "c")).filter(T.is_combining(F.col("c"))).select("id", "pos"), "SELECT id, pos FROM ch WHERE unicode(c) BETWEEN 768 AND 879")
on_signs("is_annotation", lambda t: t.select("id", F.array_join(T.annotations(F.col("t")), "").alias("value")), "SELECT id, coalesce(string_agg(c, '' ORDER BY pos) FILTER (WHERE c2 = chr(57345)), '') AS value FROM ch GROUP BY id")
on_signs("is_candrabindu_superscript", lambda t: t.select("id", F.array_join(T.superscripts(F.col("t")), "").alias("value")), "SELECT id, coalesce(string_agg(c, '' ORDER BY pos) FILTER (WHERE c2 = chr(57345) AND c <> '̐'), '') AS value FROM ch GROUP BY id")
on_signs("is_svara", lambda t: t.select("id", F.posexplode(F.split("t", "")).alias("pos", "c")).filter(T.is_svara(F.col("c"))).select("id", "pos"), "SELECT id, pos FROM ch WHERE unicode(c) IN (817, 781, 782, 718, 183)")
on_signs("consonant_at", lambda t: t.select("id", F.explode(F.sequence(F.lit(0), F.length("t") - 1)).alias("pos"), "t").select("id", "pos", T.consonant_at(F.col("t"), F.col("pos")).alias("value")), f"SELECT id, pos, CASE WHEN substr(t, pos + 1, 2) IN ({in_list(v for v in C.CONSONANTS if len(v) == 2)}) THEN substr(t, pos + 1, 2) WHEN c IN ({in_list(v for v in C.CONSONANTS if len(v) == 1)}) THEN c ELSE '' END AS value FROM ch")
on_signs("vowel_at", lambda t: t.select("id", F.explode(F.sequence(F.lit(0), F.length("t") - 1)).alias("pos"), "t").select("id", "pos", T.vowel_at(F.col("t"), F.col("pos")).alias("value")), f"SELECT id, pos, CASE WHEN substr(t, pos + 1, 2) IN ({in_list(v for v in C.VOWELS if len(v) == 2)}) THEN substr(t, pos + 1, 2) WHEN c IN ({in_list(v for v in C.VOWELS if len(v) == 1)}) THEN c ELSE '' END AS value FROM ch")
add("tokenize_phonemes", lambda s, d: table(s, d, DOCS).select("doc_id", F.size(T.tokenize_phonemes(F.lower("text"))).alias("n")), f"SELECT doc_id, length(regexp_replace(lower(text), '{'|'.join(v for v in C.VOWELS + C.CONSONANTS if len(v) == 2)}', '#', 'g')) AS n FROM documents")
PHONEME_ROWS = [(p["iast"], p["devanagari"], p["telugu"], p["tamil"], p["tamil_approx"], p["itrans"], p["kind"]) for p in C.phonemes()]
PHONEME_COLUMNS = "iast, devanagari, telugu, tamil, tamil_approx, itrans, kind"


def on_phonemes(name: str, query: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query over a phoneme (iast, kind) for each word of each document; sql: the same over the whole rows of their table."""
    n = len(PHONEME_ROWS)
    pick = lambda k: f"element_at(array({in_list(r[k] for r in PHONEME_ROWS)}), cast({word_at(n)} AS int) + 1)"
    rows = lambda s, d: stretches(s, d).select(F.explode("words").alias("w")).select(F.expr(pick(0)).alias("iast"), F.expr(pick(6)).alias("kind"))
    values = ", ".join(f"({k}, {', '.join(map(literal, r))})" for k, r in enumerate(PHONEME_ROWS))
    add(name, lambda s, d: query(rows(s, d)), f"WITH {STRETCHES}, fx AS (SELECT ph.* FROM (SELECT unnest(words) AS w FROM sp) JOIN (VALUES {values}) AS ph(k, {PHONEME_COLUMNS}) ON k = {word_at(n)}) {sql}")


on_phonemes("phoneme_lookup", lambda t: t.join(V.phoneme_table(t.sparkSession).select("iast", F.col("kind").alias("found")), "iast", "left").select("iast", "found"), "SELECT iast, kind AS found FROM fx")
BIJA_LIKE = ["oṁ", " hrīṁ ", "taṁ", "PHAṬ", "", "x", *C.BIJA]
add("bija_lookup", lambda s, d: stretches(s, d).select(F.explode("words").alias("w")).select(F.expr(f"element_at(array({in_list(BIJA_LIKE)}), cast({word_at(len(BIJA_LIKE))} AS int) + 1)").alias("w")).select("w", T.is_bija(F.col("w")).alias("value")),
    f"WITH {STRETCHES}, fx AS (SELECT ([{in_list(BIJA_LIKE)}])[CAST({word_at(len(BIJA_LIKE))} AS INTEGER) + 1] AS w FROM (SELECT unnest(words) AS w FROM sp)) SELECT w, list_contains([{in_list(C.BIJA)}], lower(trim(w))) AS value FROM fx")
on_phonemes("convert_phoneme", lambda t: t.select("iast", *[V.convert_phoneme(F.col("iast"), s).alias(f"to_{s}") for s in V.SCRIPTS]), "SELECT iast, devanagari AS to_devanagari, telugu AS to_telugu, coalesce(tamil, tamil_approx) AS to_tamil, itrans AS to_itrans FROM fx")
on_phonemes("has_equivalent", lambda t: t.select("iast", V.has_equivalent(F.col("iast"), "tamil").alias("value")), "SELECT iast, tamil IS NOT NULL AS value FROM fx")
on_phonemes("approximation", lambda t: t.select("iast", V.approximation(F.col("iast"), "tamil").alias("value")), "SELECT iast, tamil_approx AS value FROM fx")
on_phonemes("convert_syllable", lambda t: t.filter("kind = 'consonant'").select("iast", V.convert_syllable(F.col("iast"), F.lit("ā"), "devanagari").alias("aa"), V.convert_syllable(F.col("iast"), F.lit("a"), "devanagari").alias("a"), V.convert_syllable(F.col("iast"), F.lit("ṛ"), "tamil").alias("none")), "SELECT iast, devanagari || 'ा' AS aa, devanagari AS a, NULL::VARCHAR AS none FROM fx WHERE kind = 'consonant'")
on_phonemes("convert_bare", lambda t: t.filter("kind = 'consonant'").select("iast", V.convert_bare(F.col("iast"), "devanagari").alias("value")), "SELECT iast, devanagari || '्' AS value FROM fx WHERE kind = 'consonant'")
_spelled_out = written([*(p["iast"] for p in C.phonemes()), " ", "x", "1"])
add("convert_string", lambda s, d: stretches(s, d).select(F.expr(_spelled_out[0]).alias("w")).select("w", V.convert_string(F.col("w"), "devanagari").alias("value")),
    f"WITH {STRETCHES}, fx AS (SELECT {_spelled_out[1]} AS w FROM sp) SELECT w, list_reduce(list_prepend('', list_transform(regexp_extract_all(w, '({'|'.join(p['iast'] for p in C.phonemes() if len(p['iast']) == 2)}|.)'), lambda t: coalesce(map {{{', '.join(f'{literal(p['iast'])}: {literal(p['devanagari'])}' for p in C.phonemes())}}}[t], t))), lambda a, b: a || b) AS value FROM fx")
derived("script_name", [("events", "CASE event_id % 5 WHEN 0 THEN 'tamil' WHEN 1 THEN 'iast' WHEN 2 THEN 'grantha' WHEN 3 THEN 'itrans' ELSE event_type END AS s")], lambda t: t.select("s", V.script_name(F.col("s")).alias("value")), "SELECT s, CASE s WHEN 'iast' THEN 'IAST' WHEN 'itrans' THEN 'ITRANS' WHEN 'tamil' THEN 'Tamil' ELSE s END AS value FROM fx")
on_phonemes("phonemes_by_type", lambda t: t.groupBy("kind").agg(F.count("*").alias("n")), "SELECT kind, count(*) AS n FROM fx GROUP BY kind")
# Syllables as the table of phonemes and the vowel signs give them, in both scripts; texts of eight of them.
_letters = {p["iast"]: p["devanagari"] for p in C.phonemes()}
_marks = {v: x["devanagari"] for v, x in C.vowel_signs().items()}
SYLLABLES = [(_letters[c] + mark, c + v) for c in _letters if c in C.CONSONANTS and c not in "ṁṃḥ" for v, mark in _marks.items()] + [(_letters[c] + C.VIRAMA["devanagari"] + " ", c + " ") for c in _letters if c in C.CONSONANTS and c not in "ṁṃḥ"] + [(_letters[v], v) for v in C.VOWELS] + [("ं", "ṁ"), ("ः", "ḥ"), ("ऽ", "'"), ("॒", "̱"), ("॑", "̍"), ("१२ ", "12 "), (" । ", " | "), ("ॐ ", "oṁ "), ("[abc]", "[abc]")]
add("deva_to_iast", lambda s, d: stretches(s, d).select("id", V.deva_to_iast(F.expr(written([x for x, _ in SYLLABLES])[0])).alias("value")), f"WITH {STRETCHES} SELECT id, {written([x for _, x in SYLLABLES])[1]} AS value FROM sp")
on("format_ago", DOCS, "doc_id", lambda: T.format_ago(F.lit(1700000000) - F.col("doc_id") * 977, F.lit(1700000000)), "CASE WHEN a < 60 THEN 'Just now' WHEN a < 3600 THEN (a // 60) || ' min ago' WHEN a < 86400 THEN (a // 3600) || ' hours ago' WHEN a < 604800 THEN (a // 86400) || ' days ago' ELSE strftime(make_timestamp((1700000000 - a) * 1000000), '%Y-%m-%d') END".replace("a ", "(doc_id * 977) ").replace("- a)", "- doc_id * 977)"))
REFERENCES = "<p>&eacute; &#233; &#xE9 &copyright &notin; &notit; &#128; &bogus; &amp;amp; &#1114112; & x &#39;</p>"
on("html_to_text", PAGES, "page_id", lambda: F.md5(T.html_to_text(F.concat("html", F.lit(REFERENCES)))))
SQL["html_to_text"] = f"WITH {TEXT_SQL} SELECT page_id, md5(x) AS value FROM u".replace("regexp_replace(html,", f"regexp_replace(html || '{REFERENCES.replace(chr(39), chr(39) * 2)}',")
on("extract_title", PAGES, "page_id", lambda: T.extract_title(F.col("html"), F.col("url")), f"coalesce(regexp_replace(nullif(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1), ''), '^{WS}+|{WS}+$', '', 'g'), url)")
# The pages' links lead to documents of a folder here; some of its other links are kept as they are, and some names are given twice.
LINKED = "regexp_replace(regexp_replace(html, 'href=\"/([a-m][^\"]*)\"', 'href=\"/cat/$1.html\"'), 'href=\"/([n-s][^\"]*)\"', 'href=\"https://x.org/cat/$1.HTML\" title=\"t\"')"
LINKED_SQL = "regexp_replace(regexp_replace(html, 'href=\"/([a-m][^\"]*)\"', 'href=\"/cat/\\1.html\"', 'g'), 'href=\"/([n-s][^\"]*)\"', 'href=\"https://x.org/cat/\\1.HTML\" title=\"t\"', 'g')"
_linked = lambda s, d: table(s, d, PAGES).withColumn("html", F.concat(F.expr(LINKED), F.lit('<a href="/cat/index.html">i</a><a href="/cat/one.html"> </a> | <em>One</em><a href="/cat/one.html">again</a><a href="/cat/b/two.html">2</a><a href="/cat/three">3</a>')))
LINKS_SQL = f"""WITH x AS (SELECT page_id, {LINKED_SQL} || '<a href="/cat/index.html">i</a><a href="/cat/one.html"> </a> | <em>One</em><a href="/cat/one.html">again</a><a href="/cat/b/two.html">2</a><a href="/cat/three">3</a>' AS x FROM pages),
    l AS (SELECT page_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS href, unnest(b) AS inner_html, unnest(c) AS em FROM (SELECT page_id, """ + ", ".join("""regexp_extract_all(x, '(?is)<a[^>]+href=[\"''](?:[^\"'']*?cat/)?([^\"'']+?)[.]html[\"''][^>]*>(.*?)</a>(?:\\s*\\|?\\s*(?:<em[^>]*>([^<]*)</em>))?', """ + f"{k}) AS {n}" for k, n in ((1, "a"), (2, "b"), (3, "c"))) + """ FROM x)),
    a AS (SELECT page_id, pos, trim(href) AS href, trim(regexp_replace(inner_html, '<[^>]+>', '', 'g')) AS t, trim(coalesce(em, '')) AS em FROM l)"""
add("extract_links", lambda s, d: html.all_links(_linked(s, d), "page_id", "html", "cat").select("page_id", "pos", "href", "title", "romanized"), LINKS_SQL + " SELECT page_id, pos, href, CASE WHEN t = '' THEN em ELSE t END AS title, CASE WHEN em = '' THEN href ELSE em END AS romanized FROM a")
add("index_entry_filter", lambda s, d: html.links(_linked(s, d), "page_id", "html", "cat").select("page_id", "href", "title"),
    LINKS_SQL + ", k AS (SELECT *, CASE WHEN t = '' THEN em ELSE t END AS title FROM a WHERE length(href) > 0 AND NOT starts_with(href, 'http') AND instr(href, '/') = 0 AND href NOT IN ('index', 'home', 'favicon')) SELECT page_id, href, arg_min(title, pos) AS title FROM k WHERE length(title) > 0 GROUP BY page_id, href")
on("extract_divs", PAGES, "page_id", lambda: F.md5(F.array_join(L_blocks(), "|")), "md5(array_to_string(regexp_extract_all(html, '(?is)<div[^>]*class=[\"''][^\"'']*ad[^\"'']*[\"''][^>]*>(.*?)</div>', 1), '|'))")


def L_blocks() -> Column:
    return html.blocks(F.col("html"), "ad")


# ---- phonological rules ------------------------------------------------------------------------------------------------------
for _name, _rule, _pair, _new in (("insert_jna", T.insert_jna, "jñ", "jgñ"), ("insert_sv", T.insert_sv, "sv", "suv"), ("insert_vy", T.insert_vy, "vy", "vuy")):
    on_signs(_name, lambda t, r=_rule: t.select("id", r(F.col("t")).alias("value")), f"SELECT id, array_to_string(string_split(t, '{_pair}'), '{_new}') AS value FROM fx")
SVARABHAKTI_SQL = "sb AS (SELECT id, t, pos + 1 + length(regexp_extract(substr(t, pos + 2), '^[\\x{300}-\\x{36f}%s]*')) AS place FROM nx WHERE c = 'r' AND n[1].c IN ('s', 'ś', 'ṣ', 'h', 'ṛ') AND instr(substr(t, pos + 1, n[1].pos - pos), '·') = 0)" % C.SVARA
_dotted = lambda t: P.svarabhakti_positions(F.col(t))
add("svarabhakti", lambda s, d: table(s, d, DOCS).select("doc_id", F.size(_dotted("text")).alias("n")), LETTERS_SQL + " SELECT doc_id, count(*) FILTER (WHERE ch = 'r' AND next_letter IN ('s', 'ś', 'ṣ', 'h', 'ṛ')) AS n FROM w GROUP BY doc_id")
on_signs("svarabhakti_places", lambda t: t.select("id", F.explode(_dotted("t")).alias("place")), "SELECT id, place FROM sb", SVARABHAKTI_SQL)
on_signs("svarabhakti_text", lambda t: t.select("id", P.apply_edits(F.col("t"), P.svarabhakti_edits(F.col("t"))).alias("value")), "SELECT id, (SELECT string_agg(CASE WHEN pos IN (SELECT place FROM sb WHERE sb.id = fx.id) THEN '·' ELSE '' END || c, '' ORDER BY pos) FROM ch WHERE ch.id = fx.id) || CASE WHEN EXISTS (SELECT 1 FROM sb WHERE sb.id = fx.id AND place = length(fx.t)) THEN '·' ELSE '' END AS value FROM fx", SVARABHAKTI_SQL)
add("pauses", lambda s, d: table(s, d, DOCS).select("doc_id", F.size(P.pauses_of(F.lower("text"))).alias("n")),
    """WITH c AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS ch FROM (SELECT doc_id, string_split(lower(text), '') AS s FROM documents)), w AS (SELECT *, lag(ch) OVER o AS before, lead(ch) OVER o AS after FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
       SELECT doc_id, count(*) FILTER (WHERE ch = ' ' AND before IN ('a','ā','i','ī','u','ū','ṛ','ṝ','ḷ','ḹ','e','o') AND after IN ('a','ā','i','ī','u','ū','ṛ','ṝ','ḷ','ḹ','e','o')) AS n FROM w GROUP BY doc_id""")  # fmt: skip
on_signs("pause_places", lambda t: t.select("id", F.explode(P.pauses_of(F.col("t"))).alias("p")).select("id", "p.position", "p.type"), f"""SELECT id, position, type FROM (
    SELECT id, pos + 1 + length(regexp_extract(substr(t, pos + 2), '^[{C.SVARA}]*')) AS position, CASE WHEN l IN ({LONG_SQL}) AND r IN ({in_list(C.SHORT_VOWELS)}) THEN 'long' ELSE 'short' END AS type
    FROM (SELECT *, regexp_extract(substr(t, 1, pos), '({VOWEL_SQL})[{C.SVARA}]*$', 1) AS l, regexp_extract(substr(t, pos + 2), '^[{C.SVARA}]*({VOWEL_SQL})', 1) AS r FROM ch WHERE c = ' ') WHERE l <> '' AND r <> ''
    UNION ALL SELECT id, pos + 1, 'short' FROM ch WHERE c = ' ' AND pos >= 2 AND substr(t, pos - 1, 2) = 'oṁ')""")
add("holdings", lambda s, d: table(s, d, DOCS).select("doc_id", P.holdings_of(F.lower("text")).alias("h")).select("doc_id", F.size("h").alias("n"), F.size(F.filter("h", lambda x: x["type"] == "long")).alias("n_long"), F.aggregate("h", F.lit(0).cast("bigint"), lambda a, x: (a * 31 + x["position"] * 7 + x["length"]) % 1000003).alias("digest")),
    f"""WITH t2 AS (SELECT doc_id AS id, lower(text) AS t2 FROM documents), {CLUSTERS_SQL}, g AS (SELECT id, list(held * 7 + length ORDER BY start) AS h, count(*) AS n, count(*) FILTER (WHERE type = 'long') AS n_long FROM hold GROUP BY id)
       SELECT doc_id, coalesce(n, 0) AS n, coalesce(n_long, 0) AS n_long, coalesce(list_reduce(list_prepend(0::BIGINT, h), lambda a, x: (a * 31 + x) % 1000003), 0) AS digest FROM documents LEFT JOIN g ON g.id = doc_id""")  # fmt: skip
on_signs("collect_samyukta", lambda t: t.select("id", F.explode(P.clusters_of(F.col("t"))).alias("c")).select("id", "c.position", "c.consonants"), "SELECT id, start AS position, size AS consonants FROM hold", CLUSTERS_SQL)
on_signs("select_holding", lambda t: t.select("id", F.explode(P.clusters_of(F.col("t"))).alias("c")).select("id", "c.held", "c.length"), "SELECT id, held, length FROM hold", CLUSTERS_SQL)
on_signs("holding_type", lambda t: t.select("id", F.explode(P.holdings_of(F.col("t"))).alias("h")).select("id", "h.position", "h.type"), "SELECT id, held AS position, type FROM hold", CLUSTERS_SQL)
on_signs("holding_type_at", lambda t: t.select("id", "t", F.explode(F.sequence(F.lit(0), F.length("t"))).alias("pos")).select("id", "pos", T.holding_type(F.col("t"), F.col("pos")).alias("type")),
         f"SELECT id, pos, CASE WHEN coalesce(list_last(list_filter(string_split(left(t, pos), ''), lambda c: instr('{''.join(v for v in C.VOWELS if len(v) == 1)}', c) > 0)), '') IN ({LONG_SQL}) THEN 'long' ELSE 'short' END AS type FROM (SELECT id, t, unnest(range(length(t) + 1)) AS pos FROM fx)")
on_signs("anusvara", lambda t: _edit_rows(t, P.anusvara_edits(F.col("t"), F.col("source"))), "SELECT id, source, pos, del, shown FROM an", ANUSVARA_SQL)
on_signs("visarga", lambda t: _edit_rows(t, P.visarga_edits(F.col("t"))).drop("source"), "SELECT id, pos, 1 AS del, shown FROM vi", VISARGA_SQL)
# A svarita is put after every second sign.
on_signs("rigveda_svarita", lambda t: t.select("id", T.rigveda_svarita(F.regexp_replace("t", "(..)", f"$1{C.SVARITA}")).alias("value")),
         f"""SELECT id, string_agg(CASE WHEN c = '{C.SVARITA}' AND (substr(y, pos, 1) IN ({in_list(v for v in C.LONG_VOWELS if len(v) == 1)}) OR pos > 1 AND substr(y, pos - 1, 2) IN ('ai', 'au', 'aṁ', 'iṁ', 'uṁ', 'ṛṁ', 'ḷṁ')) THEN '{C.UDATTA}' ELSE c END, '' ORDER BY pos) AS value
             FROM (SELECT id, y, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS c FROM (SELECT *, string_split(y, '') AS a FROM (SELECT id, regexp_replace(t, '(..)', '\\1{C.SVARITA}', 'g') AS y FROM fx))) GROUP BY id""")  # fmt: skip
on_signs("rigveda_formats", lambda t: formats.giving_way(formats.svarita_formats(t, "id", text="t"), t.select("id", F.explode(P.clusters_of(F.col("t"))).alias("c")).select("id", "c.position"), "id"),
    f"""SELECT id, CAST(pos AS INTEGER) AS position, 1 AS length, 'dirgha-char' AS format FROM (
            SELECT id, pos, lead(c) OVER w AS mark, lag(c) OVER w AS back, c, (SELECT min(o.pos) FROM ch o WHERE o.id = ch.id AND o.pos > ch.pos + 1 AND NOT regexp_matches(o.c, '[\\x{{300}}-\\x{{36f}}]')) AS after FROM ch WINDOW w AS (PARTITION BY id ORDER BY pos)) v
        WHERE c IN ('a', 'i', 'u', 'ṛ', 'ḷ') AND mark = '\u030d' AND NOT (c IN ('i', 'u') AND coalesce(back, '') = 'a') AND NOT EXISTS (SELECT 1 FROM hk WHERE hk.id = v.id AND hk.start = v.after)""", CLUSTERS_SQL)
# Marks of accent that lie in a cluster, up to the consonant that is held.
on_signs("format_spans", lambda t: formats.meeting(t.select("id", F.posexplode(F.split("t", "")).alias("position", "c")).filter(T.is_svara(F.col("c"))).select("id", "position", F.lit(1).alias("length")), t.select("id", F.explode(P.clusters_of(F.col("t"))).alias("c")).select("id", F.col("c.position").alias("position"), (F.col("c.held") + F.col("c.length") - F.col("c.position")).alias("length")), "id"),
    "SELECT id, CAST(pos AS INTEGER) AS position, 1 AS length, (SELECT CAST(max(start) AS INTEGER) FROM hold WHERE hold.id = ch.id AND start <= pos AND held + hold.length > pos) AS span FROM ch WHERE unicode(c) IN (817, 781, 782, 718, 183)", CLUSTERS_SQL)
on_signs("final_m_tick", lambda t: t.select("id", T.final_m_tick(F.col("t")).alias("value")),
         """SELECT id, string_agg(CASE WHEN tick THEN c || 'ˎ' ELSE c END, '' ORDER BY pos) AS value FROM (SELECT *, regexp_matches(left(t, pos + 1), 'm[\\x{300}-\\x{36f}]*$') AND NOT regexp_matches(substr(t, pos + 2), '^[\\x{300}-\\x{36f}]') AND regexp_matches(substr(t, pos + 2), '^[ \\t\\n\\x0b\\f\\r]*([\\n।॥]|$)') AS tick FROM ch) GROUP BY id""")  # fmt: skip
on("syllable_count", DOCS, "doc_id", lambda: T.syllable_count(text), "length(regexp_replace(regexp_replace(lower(text), 'ai|au', 'a', 'g'), '[^aāiīuūṛṝḷḹeo]', '', 'g'))")
on_signs("apply_edits", lambda t: t.select("id", P.apply_edits(F.col("t"), P.visarga_edits(F.col("t"))).alias("value")), "SELECT id, string_agg(coalesce(replace(replace(shown, '[', ''), ']', ''), c), '' ORDER BY pos) AS value FROM ch LEFT JOIN (SELECT id, pos, shown FROM vi) USING (id, pos) GROUP BY id", VISARGA_SQL)
# All rules, in their order, for every tradition and every document; the rules one by one have SQL above.
add("rule_pipeline", lambda s, d: pipelines.rule_pipeline(table(s, d, DOCS).crossJoin(F.broadcast(s.createDataFrame([(x,) for x in TRADITIONS], "tradition string"))).select("doc_id", "tradition", F.concat(F.lit("agniḥ atra taṁ śatruṁ jñāna svar vyoma darśana agnim\n"), "text").alias("text")), source=F.col("tradition")).select("doc_id", "tradition", F.md5("text").alias("value")))


def composed_sql() -> str:
    """The rules one after another, each as its own SQL has it over the texts that the rule before it made: tables are numbered by stage."""
    names = re.compile(r"\b(fx|t2|ch|fl|pl|nx|sb|an|vi)\b")
    at = lambda k, sql: names.sub(rf"\1_{k}", sql)
    letters = SIGNS_SQL[SIGNS_SQL.index("t2 AS (SELECT *, replace") :]
    first = SIGNS_SQL[: SIGNS_SQL.index("t2 AS (SELECT *, replace")].rstrip(", \n")
    plain = NORMALIZE_SQL.replace("lower(text)", "lower(t)")
    shown = "replace(replace(shown, '[', ''), ']', '')"
    stages = [
        first, f"fx_1 AS MATERIALIZED (SELECT id, source, replace(replace(replace({plain}, 'jñ', 'jgñ'), 'sv', 'suv'), 'vy', 'vuy') AS t FROM fx)", at(1, letters), at(1, SVARABHAKTI_SQL),
        "fx_2 AS MATERIALIZED (SELECT f.id, any_value(f.source) AS source, string_agg(CASE WHEN s.place IS NULL THEN '' ELSE '·' END || c, '' ORDER BY pos) || CASE WHEN any_value(f.id) IN (SELECT b.id FROM sb_1 b JOIN fx_1 g ON g.id = b.id WHERE b.place = length(g.t)) THEN '·' ELSE '' END AS t FROM fx_1 f JOIN ch_1 h ON h.id = f.id LEFT JOIN sb_1 s ON s.id = h.id AND s.place = h.pos GROUP BY f.id)",
        at(2, letters), at(2, ANUSVARA_SQL),
        f"fx_3 AS MATERIALIZED (SELECT h.id, any_value(h.source) AS source, string_agg(coalesce({shown}, c), '' ORDER BY h.pos) AS t FROM ch_2 h LEFT JOIN an_2 a ON a.id = h.id AND a.pos = h.pos WHERE NOT EXISTS (SELECT 1 FROM an_2 x WHERE x.id = h.id AND x.pos = h.pos - 1 AND x.del = 2) GROUP BY h.id)",
        at(3, letters), at(3, VISARGA_SQL), f"fx_4 AS MATERIALIZED (SELECT h.id, any_value(h.source) AS source, string_agg(coalesce({shown}, c), '' ORDER BY h.pos) AS t FROM ch_3 h LEFT JOIN vi_3 a ON a.id = h.id AND a.pos = h.pos GROUP BY h.id)", at(4, letters),
        f"""fx_5 AS MATERIALIZED (SELECT id, any_value(source) AS source, string_agg(CASE WHEN source = 'rigveda' AND c = '{C.SVARITA}' AND pos > 0 AND (substr(t, pos, 1) IN ({in_list(v for v in C.LONG_VOWELS if len(v) == 1)}) OR pos > 1 AND substr(t, pos - 1, 2) IN ('ai', 'au', 'aṁ', 'iṁ', 'uṁ', 'ṛṁ', 'ḷṁ')) THEN '{C.UDATTA}' ELSE c END, '' ORDER BY pos) AS t FROM ch_4 GROUP BY id)""",
        at(5, letters),
    ]
    tick = SQL["final_m_tick"][SQL["final_m_tick"].rindex("SELECT id, string_agg(CASE WHEN tick") :]
    return f"WITH {', '.join(stages)} {at(5, tick)}"


add("rule_composition", lambda s, d: pipelines.rule_pipeline(signs(s, d), text="t", source=F.col("source")).select("id", F.col("t").alias("value")), composed_sql())
# ---- date, math, array, map and JSON scalars ---------------------------------------------------------------------------------
on("format_time", "events", "event_id", lambda: T.format_time(F.col("value") - 30), "CASE WHEN v < 0 THEN '-' ELSE '' END || CAST(floor(abs(v) / 60) AS BIGINT) || ':' || printf('%02d', CAST(floor(abs(v) % 60) AS BIGINT)) || '.' || printf('%03d', CAST(floor((abs(v) % 1) * 1000) AS BIGINT))".replace("v)", "value - 30)").replace("v <", "value - 30 <"))
derived("parse_time", [("events", "CASE event_id % 6 WHEN 0 THEN (event_id % 70) || ':' || (event_id % 61) || '.5' WHEN 1 THEN ':' || (event_id % 60) WHEN 2 THEN '-' || (event_id % 9) || ':30' WHEN 3 THEN event_type WHEN 4 THEN '1:2:' || event_id ELSE (event_id % 80) || ':0' || (event_id % 10) END AS t")], lambda t: t.select("t", F.round(T.parse_time(F.col("t")), 6).alias("value")), "SELECT t, CASE WHEN len(string_split(t, ':')) = 2 THEN round(try_cast(split_part(t, ':', 1) AS DOUBLE) * 60 + coalesce(try_cast(split_part(t, ':', 2) AS DOUBLE), 0), 6) END AS value FROM fx")
on("format_duration", "events", "event_id", lambda: T.format_duration(F.floor(F.col("value") * 10)), "CASE WHEN floor(value * 10) = 0 THEN '—' ELSE CAST(floor(floor(value * 10) / 60) AS BIGINT) || ':' || printf('%02d', CAST(floor(value * 10) % 60 AS BIGINT)) END")
on("clamp", "events", "event_id", lambda: T.clamp(F.col("value"), F.lit(10.0), F.lit(50.0)), "CASE WHEN value < 10 THEN 10 WHEN value > 50 THEN 50 ELSE value END")
on("confidence", "events", "event_id", lambda: F.concat(F.format_string("%.4f", T.confidence(F.col("value") / 20)), F.lit(" "), T.confidence_label(T.confidence(F.col("value") / 20))), "printf('%.4f', c) || ' ' || CASE WHEN c >= 0.75 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END".replace("c)", "greatest(0.05, least(0.98, 1 - value / 60)))").replace("c >=", "greatest(0.05, least(0.98, 1 - value / 60)) >="))
on("match_cost", "events", "event_id", lambda: F.round(I.match_cost(F.col("value"), F.lit(20.0), F.col("value") - 50, F.lit(100.0), F.col("value") > 30, F.col("value") / 100, F.col("value") / 50), 6), "round(greatest(0, 1.35 * abs(ln((value + 0.04) / 20.04)) + 0.95 * abs(value - 50) / 100 + CASE WHEN value > 30 THEN CASE WHEN value >= 16 THEN -0.18 ELSE 0.24 END ELSE 0 END - CASE WHEN value / 50 >= 0.2 THEN 0.1 ELSE 0 END), 6)")
on("skip_costs", "events", "event_id", lambda: F.round(I.skip_target_cost(F.col("value")) + I.skip_interval_cost(F.col("value"), F.lit(20.0)), 6), "round(0.62 + least(1.45, 0.25 * value) + 0.45 + least(0.9, 0.4 * value / 20.03), 6)")
on("target_weight", "events", "event_id", lambda: I.target_weight(F.when(F.col("value") > 50, F.col("value")), F.col("event_id").cast("int") % 3), "CASE WHEN value > 50 THEN value WHEN event_id % 3 > 0 THEN event_id % 3 ELSE 1 END")
on("expected_boundaries", "events", "event_id", lambda: F.array_join(F.transform(A.expected_boundaries(F.col("value"), F.col("value") + F.col("event_id"), F.array(F.lit(0.25), F.lit(0.5))), lambda x: F.format_string("%.4f", x)), " "), "printf('%.4f', round(value + event_id / 4, 4)) || ' ' || printf('%.4f', round(value + event_id / 2, 4))")
on("default_region", "events", "event_id", lambda: F.round(I.default_region(F.col("value"), F.lit(40.0))["start"], 6), "round(greatest(0, value - 2), 6)")
on("move_region", "events", "event_id", lambda: F.round(I.move_region(F.lit(10.0), F.lit(15.0), F.col("value") - 30, F.lit(60.0))["end"], 6), "round(greatest(0, least(55, value - 20)) + 5, 6)")
on("resize_region", "events", "event_id", lambda: F.round(I.resize_region(F.lit(10.0), F.lit(15.0), F.col("value"), F.lit(60.0), False)["end"], 6), "round(least(60, greatest(value, 10.05)), 6)")
on("format_audio_size", DOCS, "doc_id", lambda: T.format_audio_size(F.length("text") * F.col("doc_id")), "CASE WHEN n = 0 THEN '' WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024, 1)) ELSE printf('%.2f MB', round(n / 1048576, 2)) END".replace("n ", "(length(text) * doc_id) "))
on("array_ops", DOCS, "doc_id", lambda: F.md5(F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) > 3))), ",")), "md5(array_to_string(list_sort(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 3))), ','))")
on("map_ops", DOCS, "doc_id", lambda: F.element_at(F.map_from_arrays(F.array(F.lit("lang"), F.lit("source")), F.array("lang", "source")), "source"), "map(['lang', 'source'], [lang, source])['source']")
on("json_ops", "events", "event_id", lambda: F.get_json_object(F.to_json(F.struct("event_type", "value")), "$.event_type"), "json_object('event_type', event_type) ->> '$.event_type'")
add("data_uri", lambda s, d: table(s, d, DOCS).select("doc_id", F.md5(F.decode(documents.audio_bytes(F.concat(F.when(F.col("doc_id") % 3 > 0, F.lit("data:audio/mp3;base64,")).otherwise(F.lit("")), F.base64(F.encode("text", "utf-8")))), "utf-8")).alias("value")), "SELECT doc_id, md5(text) AS value FROM documents")
on("now_seconds", "events", "event_id", lambda: F.unix_timestamp(F.col("ts").cast("timestamp")), "floor(epoch(ts))::BIGINT")

# ---- alignment ---------------------------------------------------------------------------------------------------------------

add("detect_speech", lambda s, d: A.speech_table(_signals(s, d), "user_id", rate=100).select("user_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("stop")), f"WITH {SIGNALS_SQL} {STRETCHES_SQL.replace('{loud}', '(SELECT * FROM h WHERE loud)')}")
add("detect_speech_arrays", lambda s, d: _signals(s, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("pcm")).select("user_id", F.explode(A.detect_speech("pcm", F.lit(100))).alias("x")).select("user_id", F.round("x.start", 6).alias("start"), F.round("x.end", 6).alias("stop")), SQL["detect_speech"])
# Loudness given: a frame is loud where its event's value is above 40. All events are one recording, which is many tasks' work all the same.
add("vad_intervals", lambda s, d: A.vad_intervals(table(s, d, "events").select(F.lit(0).alias("user_id"), F.col("event_id").alias("frame"), (F.col("value") > 40).alias("loud")), "user_id", min_gap_ms=30, min_speech_ms=50, width=997).select("user_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("stop")),
    "WITH g AS (SELECT 0 AS user_id, event_id AS frame, value > 40 AS loud, count(*) OVER () AS n FROM events) " + STRETCHES_SQL.replace("{loud}", "(SELECT * FROM g WHERE loud)").replace("25", "3").replace("20", "5"))
# In whole hundredths, so that equal gaps are equal.
add("auto_split", lambda s, d: I.merge_to_count(A.speech_table(_signals(s, d), "user_id", rate=100).select("user_id", F.round(F.col("start") * 100).alias("start"), F.round(F.col("end") * 100).alias("end")), 2, "user_id").select("user_id", "start", F.col("end").alias("stop")),
    f"""WITH {SIGNALS_SQL}, st AS ({STRETCHES_SQL.replace('{loud}', '(SELECT * FROM h WHERE loud)').replace('round(a * 0.01::DOUBLE, 6)', 'a').replace('round(b * 0.01::DOUBLE, 6)', 'b')}), w AS (SELECT *, lead(start) OVER o - stop AS gap, row_number() OVER o AS i, count(*) OVER (PARTITION BY user_id) AS n FROM st WINDOW o AS (PARTITION BY user_id ORDER BY start)),
       c AS (SELECT *, gap IS NULL OR row_number() OVER (PARTITION BY user_id ORDER BY gap NULLS LAST, i) > n - 2 AS cut FROM w),
       k AS (SELECT *, coalesce(count(*) FILTER (WHERE cut) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM c)
       SELECT user_id, min(start)::DOUBLE AS start, max(stop)::DOUBLE AS stop FROM k GROUP BY user_id, k""")  # fmt: skip
_lines = lambda s, d: table(s, d, "conversations").select(F.col("conv_id").alias("audio_id"), F.col("turn").alias("ord"), T.syllable_count(text).alias("syllables"), F.lit(None).cast("double").alias("beats"), F.endswith("text", F.lit(".")).alias("pause_after"))
_audio = lambda s, d: _recordings(s, d).select("audio_id", (F.size("pcm") / 100.0).alias("duration"), A.detect_speech("pcm", F.lit(100)).alias("speech"))


def _recordings(s: SparkSession, d: str) -> DataFrame:
    """A recording (audio_id, pcm) for each conversation, of all events: these are dealt over as many signals as there are conversations (or events, if
    fewer; then conversations share signals). An event sounds for 80 ms; five loud ones and five silent ones take turns."""
    talks = table(s, d, "conversations").filter("conv_id IS NOT NULL").select(F.col("conv_id").alias("audio_id")).distinct()
    sizes = talks.agg(F.max("audio_id").alias("last")).crossJoin(table(s, d, "events").agg(F.count("*").alias("events"))).select(F.expr("least(last + 1, events)").alias("n"))
    played = F.flatten(F.transform("e", lambda e, i: F.array_repeat(F.when(F.floor(i / 5) % 2 == 0, e["value"]).otherwise(0.0), 8)))
    signals = table(s, d, "events").crossJoin(F.broadcast(sizes)).groupBy(F.expr("pmod(event_id, n)").alias("signal")).agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("e")).select("signal", played.alias("pcm"))
    return talks.crossJoin(F.broadcast(sizes)).withColumn("signal", F.expr("pmod(audio_id, n)")).join(signals, "signal").select("audio_id", "pcm")


add("auto_align", lambda s, d: A.auto_align(_audio(s, d), _lines(s, d)).withColumnRenamed("end", "stop"))
add("align_dp", lambda s, d: A.auto_align(_audio(s, d), _lines(s, d)).filter("method = 'aligned'").withColumnRenamed("end", "stop"))
add("pick_boundaries", lambda s, d: A.boundaries(_audio(s, d), _lines(s, d)))
derived("install_regions", FX, lambda t: I.install_regions(_end(t), F.lit(2.5)).select("id", "start", F.col("end").alias("stop")), "SELECT id, start, least(2.5, stop) AS stop FROM fx WHERE least(2.5, stop) - start > 0.01")
derived("uniform_confidence", RT, lambda t: K.uniform_confidence(_targets(t), _regions(t), "audio_id").select("audio_id", "ord", "status", F.col("confidence").alias("c")), "SELECT audio_id, ord, CASE WHEN m THEN 'matched' ELSE 'unmatched' END AS status, CASE WHEN m THEN 0.52::DOUBLE END AS c FROM (SELECT *, EXISTS (SELECT 1 FROM fx r WHERE r.kind = 'r' AND r.audio_id = t.audio_id AND r.ord = t.ord) AS m FROM fx t WHERE kind = 't')")
# ---- catalog and streams -----------------------------------------------------------------------------------------------------
# Paths of one file in several spellings, and names that differ in case alone.
SPELLED = "CASE c_custkey % 4 WHEN 0 THEN '/a/' || c_name WHEN 1 THEN '/a/b/../' || c_name WHEN 2 THEN '/a//./' || c_name ELSE '/A/' || c_name END"
_spelled = lambda s, d: _recents(s, d).withColumn("path", F.expr(SPELLED.replace("c_custkey", "ord").replace("c_name", "path")))
add("recents_upsert", lambda s, d: K.recents_upsert(_spelled(s, d), "/a/c/.././Customer#000000005", "save", 2000, None).select("path", "last_accessed", "last_saved").unionByName(K.recents_upsert(_spelled(s, d), "/a/Customer#000000007", "open", 3000, None).select("path", "last_accessed", "last_saved")),
    f"""WITH r AS (SELECT *, {SPELLED.replace('c_custkey', 'ord').replace('c_name', 'path')} AS p FROM {RECENTS_SQL})
        SELECT '/a/Customer#000000005' AS path, (SELECT last_accessed FROM r WHERE ord = 5) AS last_accessed, 2000 AS last_saved UNION ALL SELECT p, last_accessed, last_saved FROM r WHERE ord <> 5
        UNION ALL SELECT '/a/Customer#000000007', 3000, 0 UNION ALL SELECT p, last_accessed, last_saved FROM r""")  # fmt: skip
BLANKED = "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE c_name END AS path, CASE WHEN c_custkey % 3 > 0 THEN c_custkey END AS last_accessed, CASE WHEN c_custkey % 2 > 0 THEN c_custkey END AS last_saved"
add("recents_clean", lambda s, d: K.recents_clean(table(s, d, "customer").selectExpr("c_custkey AS ord", *BLANKED.split(", "))), f"SELECT ord, path, ifnull(last_accessed, 0) AS last_accessed, ifnull(last_saved, 0) AS last_saved FROM (SELECT c_custkey AS ord, {BLANKED} FROM customer) WHERE trim(path) <> ''")
_actions = lambda s, d: table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
add("stream_debounce", lambda s, d: S.debounce(_actions(s, d), "user_id", quiet="3600 seconds").groupBy("user_id").agg(F.count("*").alias("n_saves"), F.sum("n").alias("n")),
    "SELECT user_id, count(*) FILTER (WHERE fresh) AS n_saves, count(*) AS n FROM (SELECT user_id, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3600 SECOND, true) AS fresh FROM events) GROUP BY user_id")
add("stream_flush", lambda s, d: S.flush(_actions(s, d), "payload", every="1 day").select("payload", F.unix_timestamp("flushed_at").alias("flushed_at"), "n"), "SELECT event_type AS payload, (floor(epoch(ts))::BIGINT // 86400 + 1) * 86400 AS flushed_at, count(*) AS n FROM events GROUP BY 1, 2")
add("stream_latest", lambda s, d: S.latest(_actions(s, d), "user_id"), "SELECT user_id, arg_max(event_type, (ts, event_id)) AS payload FROM events GROUP BY user_id")


def _drained(s: SparkSession, d: str) -> DataFrame:
    """Every event, put into a queue in two parts and drained after each: what the first run has taken, the second doesn't."""
    return S.drained(s, [table(s, d, "events").filter(f"event_id % 2 = {k}").select(F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.col("value").cast("string").alias("payload")) for k in (0, 1)], scratch(s, "queue")).select("seq", "type", "run")


add("queue_drain", _drained, "SELECT event_id AS seq, event_type AS type, event_id % 2 + 1 AS run FROM events")

from . import file_queries, sql_queries, state_queries  # noqa: E402, F401  (they add their own)
