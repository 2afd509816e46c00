"""Paragraphs, runs, links and blocks of HTML."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import text as T

# A paragraph, its class and inside; the forms of a line break that are read.
PARAGRAPH = r"""(?is)<p(?:\s+class=["']([^"']*)["'])?\s*>(.*?)</p>"""
BREAK = "<br>|<br/>|<br />"


def paragraphs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, para_no, classes, inner) of each <p>; <br> becomes a space."""
    flat = F.regexp_replace(F.col(html), BREAK, " ")
    both = F.arrays_zip(F.regexp_extract_all(flat, F.lit(PARAGRAPH), 1).alias("classes"), F.regexp_extract_all(flat, F.lit(PARAGRAPH), 2).alias("inner"))
    out = pages.select(key, F.posexplode(both).alias("para_no", "p"))
    return out.select(key, "para_no", F.filter(F.split("p.classes", r"\s+"), lambda c: c != "").alias("classes"), F.col("p.inner").alias("inner"))


# The tags whose formats runs carry, text between them, and the class of a span.
_TOKEN = re.compile(r"<(/?)(strong|em|u|sup|sub|span)([^>]*)>|([^<]+)", re.I | re.S)
_CLASS = re.compile(r"""class=["']([^"']*)["']""")
RUN = "run_no int, text string, bold boolean, italic boolean, underline boolean, superscript boolean, subscript boolean, classes array<string>"


def inline_runs(inner: str) -> Iterator[tuple]:
    """Runs of text with the formats of the tags open around them; a closing tag closes the nearest of its name, others are ignored."""
    open_tags: list[tuple[str, list[str]]] = []
    number = 0
    for closing, tag, attributes, text in _TOKEN.findall(inner):
        tag = tag.lower()
        if text:
            names = {t for t, _ in open_tags}
            yield number, _html.unescape(text), "strong" in names, "em" in names, "u" in names, "sup" in names, "sub" in names, sorted({c for t, cs in open_tags if t == "span" for c in cs})
            number += 1
        elif not closing:
            found = _CLASS.search(attributes)
            open_tags.append((tag, found[1].split() if found else []))
        elif tag in (t for t, _ in open_tags):
            del open_tags[max(k for k, (t, _) in enumerate(open_tags) if t == tag)]


@udtf(returnType=RUN)
class InlineRuns:
    def eval(self, inner: str) -> Iterator[tuple]:
        if inner is not None:
            yield from inline_runs(inner)


# A link to a page of a folder (put in for %s), its inside, and the emphasised name beside it; names that aren't documents.
LINK = r"""(?is)<a[^>]+href=["'](?:[^"']*?%s/)?([^"']+?)\.html["'][^>]*>(.*?)</a>(?:\s*\|?\s*(?:<em[^>]*>([^<]*)</em>))?"""
NO_DOCUMENTS = ("index", "home", "favicon")


def is_entry(name: Column) -> Column:
    """A link's name is that of a document of the folder: not absolute, not in another folder, no icon or index."""
    return (name != "") & ~F.startswith(name, F.lit("http")) & ~F.contains(name, F.lit("/")) & ~name.isin(*NO_DOCUMENTS)


def all_links(pages: DataFrame, key: str, html: str, folder: str) -> DataFrame:
    """(key, pos, href, title, romanized) of links to pages (.html), in order."""
    cols = [F.regexp_extract_all(html, F.lit(LINK % re.escape(folder)), k).alias(n) for k, n in ((1, "href"), (2, "inner"), (3, "em"))]
    out = pages.select(key, F.posexplode(F.arrays_zip(*cols)).alias("pos", "a"))
    inner, em, href = T.trim_ws(F.regexp_replace("a.inner", "<[^>]+>", "")), T.trim_ws(F.col("a.em")), T.trim_ws(F.col("a.href"))
    return out.select(key, "pos", href.alias("href"), F.when(inner != "", inner).otherwise(em).alias("title"), F.when(em != "", em).otherwise(href).alias("romanized"))


def links(pages: DataFrame, key: str, html: str, folder: str) -> DataFrame:
    """all_links() that are entries with a title; the first of a name wins."""
    out = all_links(pages, key, html, folder).filter(is_entry(F.col("href")) & (F.col("title") != ""))
    return out.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY {key}, href ORDER BY pos)")).filter("rank = 1").drop("rank")


# A block whose class holds a name (put in for %s), up to the first closing tag.
BLOCK = r"""(?is)<div[^>]*class=["'][^"']*%s[^"']*["'][^>]*>(.*?)</div>"""


def blocks(html: Column, name: str) -> Column:
    """The insides of <div>s whose class holds a name, up to the first closing tag."""
    return F.regexp_extract_all(html, F.lit(BLOCK % re.escape(name)), 1)
