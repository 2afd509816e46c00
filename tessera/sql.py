"""The library in SQL: register(spark) makes its functions known to spark.sql, as temporary functions with SQL bodies.

A scalar function is the SQL of the same expression that Python builds, so Catalyst inlines it into the query and optimises it there. Table functions are queries over these.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .functions import convert, text
from .operators import catalog, intervals
from .sources import documents, pages

#: Functions over Arrow batches, as text.unescape() has one.
PYTHON = {"unescape_references": lambda: F.arrow_udf(text._unescaped, "string")}
#: name: (parameters, type, SQL); {p} stands for the prefix.
WRITTEN = {"html_to_text": ("html STRING", "STRING", "CASE WHEN contains({p}tagless(html), '&') THEN {p}unescape_references({p}tagless(html)) ELSE {p}tagless(html) END")}

Scalar = tuple[str, Callable[..., Column]]
#: name: (parameters, the expression of them).
SCALARS: dict[str, Scalar] = {
    "normalize_text": ("t STRING", text.normalize_text), "normalize_anusvara": ("t STRING", text.normalize_anusvara), "script_detect": ("t STRING", text.script_detect),
    "text_words": ("t STRING", text.word_count), "text_paragraphs": ("t STRING", text.paragraph_count), "p_tag_count": ("html STRING", text.p_tag_count), "escape_html": ("t STRING", text.escape_html),
    "compress_content": ("html STRING", text.compress_content), "tagless": ("html STRING", text.tagless), "extract_title": ("html STRING, other STRING", text.extract_title),
    "import_markdown": ("t STRING", text.import_markdown), "import_html_body": ("html STRING", text.import_html_body), "is_document": ("path STRING", text.is_document), "file_kind": ("path STRING", text.file_kind),
    "path_form": ("path STRING", text.path_form), "norm_path": ("path STRING", text.norm_path), "clean_filename": ("name STRING", text.clean_filename), "query_fold": ("q STRING", text.query_fold),
    "insert_jna": ("t STRING", text.insert_jna), "insert_sv": ("t STRING", text.insert_sv), "insert_vy": ("t STRING", text.insert_vy), "final_m_tick": ("t STRING", text.final_m_tick), "rigveda_svarita": ("t STRING", text.rigveda_svarita),
    "svarabhakti_text": ("t STRING", text.svarabhakti_text), "syllable_count": ("t STRING", text.syllable_count), "confidence": ("score DOUBLE", text.confidence), "format_time": ("seconds DOUBLE", text.format_time),
    "format_size": ("bytes BIGINT", text.format_size), "timeline_step": ("least DOUBLE", catalog.timeline_step), "invert_selection": ("a DOUBLE, b DOUBLE, duration DOUBLE", intervals.invert_selection),
    "deva_to_iast": ("t STRING", convert.deva_to_iast), "parse_document": ("json STRING", documents.parse_document), "html_pieces": ("page STRING", pages.pieces),
}
PARAGRAPH = r"(?is)<p(?:\\s+class=[\"\']([^\"\']*)[\"\'])?\\s*>(.*?)</p>"
#: name: (parameters, columns, query).
TABLES = {
    "text_lines": ("t STRING", "line_no INT, line STRING", "SELECT pos, col FROM (SELECT posexplode(split(t, '\\n')))"),
    "text_tokens": ("t STRING", "pos INT, token STRING", "SELECT pos, col FROM (SELECT posexplode(regexp_extract_all(t, '[^ \\\\n\\\\t]+', 0)))"),
    "html_paragraphs": ("html STRING", "para_no INT, classes STRING, inner STRING", f"SELECT pos, regexp_extract(col, '{PARAGRAPH}', 1), regexp_extract(col, '{PARAGRAPH}', 2) FROM (SELECT posexplode(regexp_extract_all(regexp_replace(html, '<br ?/?>', ' '), '{PARAGRAPH}', 0)))"),
    "html_headings": ("html STRING", "heading_no INT, level INT, heading STRING", r"SELECT pos, int(regexp_extract(col, '(?is)<h([1-6])', 1)), nullif(trim(regexp_replace(col, '<[^>]+>', '')), '') FROM (SELECT posexplode(regexp_extract_all(html, '(?is)<h([1-6])[^>]*>.*?</h[1-6]>', 0)))"),
    "path_nodes": ("path STRING", "depth INT, node STRING, is_folder BOOLEAN", "SELECT pos + 1, array_join(slice(split(ltrim('/', path), '/'), 1, pos + 1), '/'), pos + 1 < size(split(ltrim('/', path), '/')) FROM (SELECT posexplode(split(ltrim('/', path), '/')))"),
}

_LITERAL = re.compile(r"('(?:\\.|[^'\\])*')")
_OPERATOR = re.compile(r"(?<![\w`])(<=>|<=|>=|!=|==|=|<|>|\+|-|\*|/|%|and|or)\(")


def body(column: Column) -> str:
    """SQL of an expression. Inside lambdas operators are written as functions, which SQL takes in back quotes."""
    parts = _LITERAL.split(column._jc.node().sql())
    plain = lambda p: re.sub(r"\b(Infinity|NaN)\b", r"double('\1')", _OPERATOR.sub(lambda m: f"`{m[1]}`(", p))
    return "".join(p if k % 2 else plain(p) for k, p in enumerate(parts))


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make all functions known to spark.sql, each under prefix and its name; gives the names. They last as long as the session; a second call replaces them."""
    for name, make in PYTHON.items():
        spark.udf.register(prefix + name, make())
    for name, (parameters, build) in SCALARS.items():
        made = build(*[F.col(p.split(" ")[0]) for p in parameters.split(", ")])
        kind = spark.createDataFrame([], parameters).select(made).schema[0].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body(made)}")
    for name, (parameters, kind, sql) in WRITTEN.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {sql.replace('{p}', prefix)}")
    for name, (parameters, columns, query) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE({columns}) RETURN {query}")
    return [prefix + n for n in (*PYTHON, *SCALARS, *WRITTEN, *TABLES)]
