"""Runs of word-processor documents: read with the standard library, mapped to HTML by DataFrame operations."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import text as T

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RUN = "para_no int, run_no int, para_style string, centred boolean, text string, char_style string, size_pt double, bold boolean, italic boolean, underline boolean, superscript boolean, has_border boolean, border_sz int"

# Character styles and their classes; styles that hold or that carry no text.
STYLE_CLASS = {"Holding": "ql-holding-short", "2Holding": "ql-holding-long", "Svara": "ql-svara-char", "Virama": "ql-svara-char", "Anusvara": "ql-change-style", "Comment": "ql-comment-style", "Long": "ql-short-pause", "Longer": "ql-long-pause"}
HOLD, SKIP = ("hold", "2hold"), ("phonetic", "footnote reference", "endnote reference", "footnote text", "endnote text", "nāma", "nama", "pause")


def runs(data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))

    def value(node: ElementTree.Element | None, name: str) -> str | None:
        found = None if node is None else node.find(W + name)
        return None if found is None else found.get(W + "val", "1")

    for p, para in enumerate(body.iter(W + "p")):
        pr = para.find(W + "pPr")
        for r, run in enumerate(para.iter(W + "r")):
            rp = run.find(W + "rPr")
            text = "".join("\n" if c.tag == W + "br" else c.text or "" for c in run if c.tag in (W + "t", W + "br"))
            border = None if rp is None else rp.find(W + "bdr")
            size = value(rp, "sz")
            yield p, r, value(pr, "pStyle"), value(pr, "jc") == "center", text, value(rp, "rStyle"), float(size) / 2 if size else None, *(value(rp, n) not in (None, "0", "none", "false") for n in ("b", "i", "u")), value(rp, "vertAlign") == "superscript", border is not None, int(border.get(W + "sz", 0)) if border is not None else 0


@udtf(returnType=RUN)
class DocxRuns:
    def eval(self, data: bytes) -> Iterator[tuple]:
        if data is not None:
            yield from runs(data)


def is_insert() -> Column:
    """Annotations: by the style's name; else, without a known style, by small type or superscript."""
    style = F.coalesce("char_style", F.lit(""))
    known = style.isin(*STYLE_CLASS)
    return F.startswith(F.lower(style), F.lit("insert")) | (~known & ((F.coalesce(F.col("size_pt") <= 9, F.lit(False))) | F.coalesce("superscript", F.lit(False))))


def format_run() -> Column:
    """The HTML of a run by itself."""
    text, span = T.escape_html(F.col("text"), quotes=False), lambda cls, t: F.concat(F.lit('<span class="'), cls, F.lit('">'), t, F.lit("</span>"))
    change = span(F.lit("ql-change-style"), text)
    table = F.create_map(*[F.lit(v) for kv in STYLE_CLASS.items() for v in kv])
    cls, known = F.element_at(table, F.col("char_style")), F.coalesce(F.col("char_style").isin(*STYLE_CLASS), F.lit(False))
    styled = F.when(known, F.when(F.trim("text") != "", span(cls, text)).otherwise(text))
    plain = F.when(F.col("has_border"), span(F.when(F.col("border_sz") > 6, F.lit("ql-holding-long")).otherwise(F.lit("ql-holding-short")), text)).otherwise(text)
    for column, tag in (("bold", "strong"), ("italic", "em"), ("underline", "u")):
        plain = F.when(F.coalesce(column, F.lit(False)), F.concat(F.lit(f"<{tag}>"), plain, F.lit(f"</{tag}>"))).otherwise(plain)
    return F.when(is_insert(), F.when(F.col("superscript"), F.concat(F.lit("<sup>"), change, F.lit("</sup>"))).otherwise(change)).otherwise(F.coalesce(styled, plain))


def runs_to_html(run_table: DataFrame, *key: str) -> DataFrame:
    """(key, para_no, html): a hold mark is applied to the next base run that isn't a separator, then dropped with the marks that carry no text."""
    style = F.lower(F.coalesce("char_style", F.lit("default paragraph font")))
    order = "PARTITION BY " + ", ".join((*key, "para_no")) + " ORDER BY run_no"
    t = run_table.withColumn("style", style).withColumn("hold", F.when(F.col("style").isin(*HOLD), F.when(F.contains("style", F.lit("2")), F.lit("ql-holding-long")).otherwise(F.lit("ql-holding-short"))))
    base = F.col("hold").isNull() & F.col("style").isin("default paragraph font", "") & ~F.coalesce("superscript", F.lit(False)) & ~F.regexp_like(F.coalesce("text", F.lit("")), F.lit("^[\\s\\-\\x{a0}\\x{2002}-\\x{2004}]*$"))
    t = t.withColumn("base", base).withColumn("marks", F.expr(f"count(hold) OVER ({order})")).withColumn("mark", F.expr(f"last_value(hold) IGNORE NULLS OVER ({order} ROWS UNBOUNDED PRECEDING)"))
    t = t.withColumn("nth", F.expr(f"sum(cast(base AS int)) OVER (PARTITION BY {', '.join((*key, 'para_no'))}, marks ORDER BY run_no ROWS UNBOUNDED PRECEDING)"))
    html = F.when(F.col("base") & (F.col("marks") > 0) & (F.col("nth") == 1), F.concat(F.lit('<span class="'), "mark", F.lit('">'), format_run(), F.lit("</span>"))).otherwise(format_run())
    kept = t.filter(F.col("hold").isNull() & ~F.col("style").isin(*SKIP) & (F.coalesce("text", F.lit("")) != "")).select(*key, "para_no", F.struct("run_no", html.alias("html")).alias("r"))
    return kept.groupBy(*key, "para_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["html"]), "").alias("html"))


def is_title(para_no: Column, size_pt: Column, centred: Column) -> Column:
    return (para_no <= 2) & (F.coalesce(size_pt >= 24, F.lit(False)) | F.coalesce(centred, F.lit(False)))


def is_hanging(left: Column, first: Column, style_left: Column, style_first: Column) -> Column:
    return F.coalesce((F.coalesce(left, style_left) > 0) & (F.coalesce(first, style_first) < 0), F.lit(False))


def style_lookup(style: Column, table: dict[str, str]) -> Column:
    """The class of a style: of its own name, else of the first name that it begins with; else null."""
    exact = F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), style)
    return F.coalesce(exact, *[F.when(F.startswith(style, F.lit(k)), F.lit(v)) for k, v in table.items()])


def import_docx(files: DataFrame, *key: str, content: str = "content") -> DataFrame:
    """(key, para_no, html) of the paragraphs of word-processor files; empty ones go."""
    run_table = files.lateralJoin(DocxRuns(F.col(content).outer())).drop(content)
    return runs_to_html(run_table.select(*key, *[c.split(" ")[0] for c in RUN.split(", ")]), *key)


def written(first: Column, second: Column, bold: Column, raised: Column) -> Column:
    """A word-processor file of two paragraphs: the first of two runs (one perhaps bold, the other perhaps superscript), the second of "end" and the first run's text."""

    def f(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        def one(x: str, y: str, strong: bool, high: bool) -> bytes:
            run = lambda text, props: f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'
            body = f"<w:p>{run(x, '<w:b/>' if strong else '')}{run(y, '<w:vertAlign w:val=\"superscript\"/>' if high else '')}</w:p><w:p/><w:p>{run('end ' + x, '')}</w:p>"
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/document.xml", f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
            return out.getvalue()

        return pd.Series([one(*r) for r in zip(a, b, c, d, strict=True)])

    return F.pandas_udf(f, "binary")(first, second, bold, raised)
