"""Lines and verses: filters on lines, footers, preambles, segmentation by line ends, headings, letters around a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions import text as T

# The end of a verse, footers, accents of the source script.
VERSE_END = rf"[।॥]{C.WS}*[0-9०-९][.0-9०-९]*{C.WS}*॥?{C.WS}*$"
FOOTERS = ("encoded", "proofread", "send corrections", "sanskritdocuments.org", "last updated", "latest update", "% text title", "% file name")
# A heading, its level and inside.
HEADING = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
ACCENTED = r"[\x{951}\x{952}\x{1cda}]"


def lines(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, line_no, line): trimmed lines that aren't empty, numbered as in the text."""
    out = rows.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return out.withColumn("line", T.trim_ws(F.col("line"))).filter("line <> ''")


def is_devanagari(line: Column) -> Column:
    """Three Devanagari characters at least, and over three tenths of what isn't a space."""
    count = F.regexp_count(line, F.lit(r"[\x{900}-\x{97f}]"))
    return (count >= 3) & (count / F.greatest(F.length(F.replace(line, F.lit(" "), F.lit(""))), F.lit(1)) > 0.3)


def is_footer(line: Column) -> Column:
    out = F.lit(False)
    for word in FOOTERS:
        out = out | F.contains(F.lower(line), F.lit(word))
    return out


def footer_trim(numbered: DataFrame, key: str, footer: Column | None = None) -> DataFrame:
    """Lines up to the last one of each text that isn't a footer."""
    footer = is_footer(F.col("line")) if footer is None else footer
    last = F.max(F.when(~footer, F.col("line_no"))).over(Window.partitionBy(key))
    return numbered.withColumn("_last", last).filter("line_no <= _last").drop("_last")


def preamble_split(numbered: DataFrame, key: str, starts: Column | None = None) -> DataFrame:
    """Lines with `preamble`: they stand before the first accented one. A text without any is all body."""
    starts = F.regexp_like("line", F.lit(ACCENTED)) if starts is None else starts
    first = F.min(F.when(starts, F.col("line_no"))).over(Window.partitionBy(key))
    return numbered.withColumn("_first", first).withColumn("preamble", F.coalesce(F.col("line_no") < F.col("_first"), F.lit(False))).drop("_first")


def verse_split(numbered: DataFrame, key: str, end: Column | None = None) -> DataFrame:
    """(key, verse_no, verse, n_lines): a line that matches `end` closes a verse; what is left is the last one. A preamble, if marked, is verse 0."""
    end = F.regexp_like("line", F.lit(VERSE_END)) if end is None else end
    marked = numbered if "preamble" in numbered.columns else numbered.withColumn("preamble", F.lit(False))
    w = Window.partitionBy(key, "preamble").orderBy("line_no")
    closed = F.coalesce(F.sum(end.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = marked.withColumn("verse_no", F.when(F.col("preamble"), F.lit(0)).otherwise(closed + 1))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n")
    return t.groupBy(key, "verse_no").agg(joined.alias("verse"), F.count("*").alias("n_lines"))


def verse_zip(devanagari: Column, transliteration: Column, translation: Column) -> Column:
    """Three arrays side by side, padded to the longest; rows with nothing in them go."""
    text = lambda c: F.coalesce(c, F.lit(""))
    zipped = F.transform(F.arrays_zip(devanagari.alias("a"), transliteration.alias("b"), translation.alias("c")), lambda r: F.struct(text(r["a"]).alias("devanagari"), text(r["b"]).alias("transliteration"), text(r["c"]).alias("translation")))
    return F.filter(zipped, lambda r: (r["devanagari"] != "") | (r["transliteration"] != "") | (r["translation"] != ""))


def headings(html: Column) -> Column:
    """(id, level, text) of a page's headings, in order."""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(HEADING), 1).alias("level"), F.regexp_extract_all(html, F.lit(HEADING), 2).alias("inner"))

    def one(h: Column, i: Column) -> Column:
        text = T.trim_ws(F.regexp_replace(h["inner"], "<[^>]+>", ""))
        return F.struct(F.concat(F.lit("heading-"), i.cast("string")).alias("id"), h["level"].cast("int").alias("level"), F.when(text == "", F.lit("Untitled")).otherwise(text).alias("text"))

    return F.transform(both, one)
