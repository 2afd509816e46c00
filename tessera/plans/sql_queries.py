"""Registered queries restated by spark.sql alone, with the functions of tessera.sql."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import sql
from .queries import PATHS, REFERENCES, SQL, add, table

PREFIX = "tes_"
TABLES = ("documents", "pages", "events", "customer")

# Each gives the rows of the query of its name without sql_.
STATEMENTS = {
    "sql_normalize_text": "SELECT doc_id, md5(tes_normalize_text(text)) AS value FROM documents",
    "sql_script_distribution": "SELECT tes_script_detect(text) AS script, count(*) AS n FROM documents GROUP BY 1",
    "sql_text_stats": "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(tes_text_words(text) AS BIGINT) AS words, CAST(tes_text_paragraphs(text) AS BIGINT) AS paragraphs FROM documents",
    "sql_compress_content": "SELECT page_id, md5(tes_compress_content(html)) AS value FROM pages",
    "sql_escape_html": "SELECT page_id, md5(tes_escape_html(html)) AS value FROM pages",
    "sql_paragraph_count": "SELECT page_id, tes_p_tag_count(html) AS value FROM pages",
    "sql_import_html_body": "SELECT page_id, md5(tes_import_html_body(html)) AS value FROM pages",
    "sql_file_kind": f"SELECT doc_id, tes_file_kind({PATHS}) AS value FROM documents",
    "sql_timeline_step": "SELECT event_id, tes_timeline_step(value) AS value FROM events",
    "sql_html_paragraphs": "SELECT page_id, para_no, size(filter(split(coalesce(classes, ''), '[ \\\\t\\\\n]+'), x -> x <> '')) AS n_classes, md5(inner) AS inner FROM pages, LATERAL tes_html_paragraphs(html)",
    "sql_toc": "SELECT page_id, concat('heading-', heading_no) AS id, level, coalesce(heading, 'Untitled') AS text FROM pages, LATERAL tes_html_headings(html)",
    "sql_html_to_text": "SELECT page_id, md5(tes_html_to_text(concat(html, :references))) AS value FROM pages",
}


def stated(statement: str):
    name = next(t for t in TABLES if f"FROM {t}" in statement)
    named = statement.replace(f"FROM {name}", f"FROM {{{name}}}")

    def query(s: SparkSession, d: str) -> DataFrame:
        sql.register(s, PREFIX)
        # The table is handed over by itself, so that runs over several folders don't disturb each other.
        return s.sql(named, args={"references": REFERENCES}, **{name: table(s, d, name)})

    return query


for _name, _statement in STATEMENTS.items():
    add(_name, stated(_statement), SQL[_name.removeprefix("sql_")])
