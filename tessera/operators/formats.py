"""Formats that a rule gives to places of a text, and how they give way to those of another rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions import text as T

SHORT = "".join(C.SHORT_VOWELS)
# Fixed value: the format of a short vowel that is held long.
LENGTHENED = "dirgha-char"
#: A short vowel under svarita with the marks after it; what is neither; a vowel by itself. They make up a text without a gap.
_TOKEN = rf"((?:a[iu])|[{SHORT}]{C.SVARITA}[\x{{300}}-\x{{36f}}]*|[^{SHORT}]+|[{SHORT}])"


def svarita_formats(rows: DataFrame, *key: str, text: str = "text") -> DataFrame:
    """(key, position, length, format, after): the vowels that the second pass of the documented rule lengthens, in texts as its first pass leaves them: short ones
    still under svarita. after: where the next letter or white space stands. key should name a row; a null text gives nothing."""
    parts = rows.select(*key, F.posexplode(F.regexp_extract_all(T.rigveda_svarita(F.col(text)), F.lit(_TOKEN), F.lit(1))).alias("_n", "_t"))
    start = F.coalesce(F.sum(F.length("_t")).over(Window.partitionBy(*key).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("_at", start).filter(F.rlike("_t", F.lit(f"^[{SHORT}]{C.SVARITA}")))
    return placed.select(*key, F.col("_at").cast("int").alias("position"), F.lit(1).alias("length"), F.lit(LENGTHENED).alias("format"), (F.col("_at") + F.length("_t")).cast("int").alias("after"))


def giving_way(formats: DataFrame, held: DataFrame, *key: str) -> DataFrame:
    """The formats (key, ..., after) but for those right before a span of `held` (key, position), such as a cluster of consonants of which one is held."""
    spans = held.select(*key, F.col("position").alias("after"))
    return formats.join(spans, [*key, "after"], "left_anti").select(*key, "position", "length", "format")


def meeting(formats: DataFrame, spans: DataFrame, *key: str) -> DataFrame:
    """formats (key, position, length, ...) with `span`: the start of the last span (key, position, length) at or before their own start that still covers it, else null. Spans don't overlap.

    Both lists are sorted together by position, once per text, so that each format finds its span by one look back.
    """
    rest = [c for c in formats.columns if c not in key]
    both = formats.select(*key, F.lit(1).alias("_kind"), *rest).unionByName(spans.select(*key, F.lit(0).alias("_kind"), "position", "length"), allowMissingColumns=True)
    before = Window.partitionBy(*key).orderBy("position", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_kind") == 0, F.struct("position", "length")), ignorenulls=True).over(before)
    out = both.withColumn("_s", last).filter("_kind = 1")
    return out.select(*formats.columns, F.when(F.col("_s.position") + F.col("_s.length") > F.col("position"), F.col("_s.position")).alias("span"))
