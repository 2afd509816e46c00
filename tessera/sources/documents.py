"""The document format: JSON <-> struct, HTML page and style sheet, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import pages

STYLE = "struct<color:string,fontSize:string,fontWeight:string,fontStyle:string,textAlign:string>"
ATTACHMENT = "struct<id:string,label:string,src:string,startTime:double,endTime:double,fadeIn:double,fadeOut:double,duration:double,size:double>"
DOCUMENT = f"struct<version:int,content:string,meta:struct<title:string,created:bigint,modified:bigint,author:string>,styles:struct<theme:string,paragraphStyles:map<string,{STYLE}>,customCSS:string>,audio:struct<attachments:array<{ATTACHMENT}>>>"

# The styles that have a rule of their own, and the properties in their order.
STYLE_KEYS = ("doc-title", "doc-subtitle", "doc-section", "doc-subsection", "doc-translation")
PROPERTIES = (("color", "color"), ("font-size", "fontSize"), ("font-weight", "fontWeight"), ("font-style", "fontStyle"), ("text-align", "textAlign"))


def _or(value: Column, default: object) -> Column:
    """value, or default where it is null or (as in the format's writers) empty or zero."""
    return F.when(value.isNull() | (value == F.lit("" if isinstance(default, str) else 0)), F.lit(default)).otherwise(value)


def unwrap_json(json: Column) -> Column:
    """A document that was encoded twice, decoded once."""
    return F.when(F.startswith(F.ltrim(json), F.lit('"')), F.get_json_object(F.concat(F.lit('{"a":'), json, F.lit("}")), "$.a")).otherwise(json)


def parse_document(json: Column) -> Column:
    """The document with defaults in place; null if it isn't an object."""
    inner = unwrap_json(json)
    d = F.from_json(inner, DOCUMENT)
    out = F.struct(
        _or(d["version"], 1).alias("version"), F.coalesce(d["content"], F.lit("")).alias("content"),
        F.struct(_or(d["meta"]["title"], "Untitled").alias("title"), _or(d["meta"]["created"], 0).alias("created"), _or(d["meta"]["modified"], 0).alias("modified"), F.coalesce(d["meta"]["author"], F.lit("")).alias("author")).alias("meta"),
        F.struct(_or(d["styles"]["theme"], "light").alias("theme"), d["styles"]["paragraphStyles"].alias("paragraphStyles"), F.coalesce(d["styles"]["customCSS"], F.lit("")).alias("customCSS")).alias("styles"),
        F.struct(F.coalesce(d["audio"]["attachments"], F.from_json(F.lit("[]"), f"array<{ATTACHMENT}>")).alias("attachments")).alias("audio"),
    )
    return F.when(F.get_json_object(inner, "$").isNotNull() & F.startswith(F.ltrim(inner), F.lit("{")), out)


def create_document(content: Column, title: Column, theme: Column, now: Column, custom_css: Column | None = None) -> Column:
    """The JSON of a document; default values are left out."""
    css = F.nullif(F.trim(custom_css), F.lit("")) if custom_css is not None else F.lit(None).cast("string")
    theme = F.nullif(F.nullif(theme, F.lit("light")), F.lit(""))
    styles = F.when(theme.isNotNull() | css.isNotNull(), F.struct(theme.alias("theme"), css.alias("customCSS")))
    return F.to_json(F.struct(F.lit(1).alias("version"), T.compress_content(content).alias("content"), F.struct(F.coalesce(title, F.lit("Untitled")).alias("title"), now.alias("created"), now.alias("modified")).alias("meta"), styles.alias("styles")))


def style_css(styles: Column) -> Column:
    """The style sheet of a paragraphStyles map: a rule for each known style that sets something."""

    def rule(key: str) -> Column:
        style = F.element_at(styles, key)
        set_ = F.array_compact(F.array(*[F.when(style[name] != "", F.concat(F.lit(f"{css}: "), style[name])) for css, name in PROPERTIES]))
        return F.when(style.isNotNull() & (F.size(set_) > 0), F.concat(F.lit(f".ql-{key} {{ "), F.array_join(set_, "; "), F.lit("; }\n")))

    return F.array_join(F.array_compact(F.array(*[rule(k) for k in STYLE_KEYS])), "")


# The form of a page; the title, style sheets, theme and content go between its parts.
PAGE = (
    '<!DOCTYPE html>\n<html lang="en">\n<head>\n    <meta charset="UTF-8">\n    <meta name="viewport" content="width=device-width, initial-scale=1.0">\n    <title>',
    "</title>\n    <style>\n",
    '    </style>\n</head>\n<body data-theme="',
    '">\n    <div class="paper">\n        <div class="content">\n            <div class="ql-editor">',
    "</div>\n        </div>\n    </div>\n</body>\n</html>",
)


def to_html(document: Column, default_css: str = "") -> Column:
    """A page of its own from a parsed document: the theme is the body's, the content lies in the paper's editor block. default_css comes before the document's own style sheets."""
    css = F.concat(F.lit(default_css + "\n"), F.coalesce(style_css(document["styles"]["paragraphStyles"]), F.lit("")), F.lit("\n"), document["styles"]["customCSS"], F.lit("\n"))
    parts = (T.escape_html(document["meta"]["title"]), css, T.escape_html(document["styles"]["theme"]), document["content"])
    return F.concat(*[x for fixed, part in zip(PAGE, parts) for x in (F.lit(fixed), part)], F.lit(PAGE[-1]))


def from_html(page: Column) -> Column:
    return pages.from_html(page)


def valid_attachments(attachments: Column) -> Column:
    """Those that have an id and a source."""
    return F.filter(attachments, lambda a: (F.coalesce(a["id"], F.lit("")) != "") & (F.coalesce(a["src"], F.lit("")) != ""))


def audio_bytes(src: Column) -> Column:
    """The data of a data URI."""
    return F.unbase64(F.substring_index(src, ",", -1))


def read_text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of the files under a path, each whole, as UTF-8."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.decode("content", "utf-8").alias("text"))


#: What ends a text in a file of several: the sign that separates records.
RECORD_END = "\x1e"


def write_texts(texts: DataFrame, path: str, text: str = "text") -> None:
    """Write texts, which may have many lines, to text files. Spark's commit makes them appear whole or not at all."""
    texts.select(text).write.option("lineSep", RECORD_END).text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text) of files that write_texts() wrote."""
    return spark.read.option("lineSep", RECORD_END).text(path).withColumnRenamed("value", "text")


def write_pages(documents: DataFrame, path: str, document: str = "document") -> None:
    """Write the page of its own of each parsed document to text files."""
    write_texts(documents.select(to_html(F.col(document)).alias("text")), path)
