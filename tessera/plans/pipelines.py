"""Whole queries: verses of a corpus, search over link catalogs, the rule pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phonology as P
from ..functions import text as T
from ..operators import verses as V


def verse_extraction(pages: DataFrame, key: str = "page_id", html: str = "html", end: Column | None = None) -> DataFrame:
    """(key, verse_no, verse, n_lines) of each page's text."""
    numbered = V.lines(pages.select(key, T.html_to_text(F.col(html)).alias("_text")), key, F.col("_text"))
    return V.verse_split(numbered, key, end)


def devanagari_extraction(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, verse_no, verse, n_lines) of pages in the source script: other lines and footers go, the preamble is verse 0."""
    numbered = V.lines(pages.select(key, T.html_to_text(F.col(html)).alias("_text")), key, F.col("_text")).filter(V.is_devanagari(F.col("line")))
    return V.verse_split(V.preamble_split(V.footer_trim(numbered, key), key), key)


# The order of the rules; each sees the text that the one before it made.
RULES = ("normalize", "jna", "sv", "vy", "svarabhakti", "anusvara", "visarga", "svarita", "final_m")


def rule_pipeline(rows: DataFrame, text: str = "text", source: str | Column | None = None, rules: tuple[str, ...] = RULES, skip_bija: bool = True) -> DataFrame:
    """rows with the text after the rules that are on, for a tradition, or for that of each row."""
    of = source if isinstance(source, Column) else F.lit(source).cast("string")
    step = {
        "normalize": T.normalize_text, "jna": T.insert_jna, "sv": T.insert_sv, "vy": T.insert_vy, "final_m": T.final_m_tick,
        "svarabhakti": P.svarabhakti_applied, "visarga": P.visarga_applied, "anusvara": lambda t: P.anusvara_applied(t, of, skip_bija),
        "svarita": lambda t: F.when(of == "rigveda", T.rigveda_svarita(t)).otherwise(t),
    }
    out = rows
    for rule in RULES:
        if rule in rules:
            out = out.withColumn(text, step[rule](F.col(text)))
    return out
