"""Transliteration by table: phonemes, syllables and strings, as Column builders over literal maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C

SCRIPTS = ("devanagari", "telugu", "tamil", "itrans")


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def equivalents(script: str, approximate: bool = True) -> dict[str, str]:
    """IAST -> script; for Tamil the nearest letter where there is none, if asked for."""
    out = {p["iast"]: p[script] or (p["tamil_approx"] if script == "tamil" and approximate else None) for p in C.phonemes()}
    return {k: v for k, v in out.items() if v}


def phoneme_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(p.values()) for p in C.phonemes()], "iast string, devanagari string, telugu string, tamil string, tamil_approx string, itrans string, kind string")


def convert_phoneme(iast: Column, script: str) -> Column:
    if script == "iast":
        return iast
    return F.when(iast.isin(*C.ACCENTS), iast).otherwise(F.element_at(_map(equivalents(script)), iast))


def has_equivalent(iast: Column, script: str) -> Column:
    return F.lit(True) if script == "iast" else F.coalesce(iast.isin(*equivalents(script, False)), F.lit(False))


def approximation(iast: Column, script: str) -> Column:
    return F.element_at(_map({p["iast"]: p["tamil_approx"] for p in C.phonemes() if p["tamil_approx"]}), iast) if script == "tamil" else F.lit(None).cast("string")


def convert_syllable(consonant: Column, vowel: Column, script: str) -> Column:
    """Consonant and vowel sign; null where the script has no way to write it."""
    if script == "iast":
        return F.concat(consonant, vowel)
    table = _map(equivalents(script))
    if script == "itrans":
        return F.concat(F.element_at(table, consonant), F.element_at(table, vowel))
    signs = _map({v: s[script] for v, s in C.vowel_signs().items() if s[script] is not None})
    return F.concat(F.element_at(table, consonant), F.element_at(signs, vowel))


def convert_bare(consonant: Column, script: str) -> Column:
    if script == "iast":
        return consonant
    base = F.element_at(_map(equivalents(script)), consonant)
    return F.coalesce(base, consonant) if script == "itrans" else F.concat(base, F.lit(C.VIRAMA[script]))


def convert_string(text: Column, script: str) -> Column:
    """Token by token, the longest first; what isn't in the table stays. Vowels take their independent form (no virama is written)."""
    if script == "iast":
        return text
    table = equivalents(script)
    two = "|".join(k for k in (p["iast"] for p in C.phonemes()) if len(k) == 2)
    tokens = F.regexp_extract_all(text, F.lit(f"({two}|(?s:.))"), 1)
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.element_at(_map(table), t), t)), "")


def script_name(script: Column) -> Column:
    return F.coalesce(F.element_at(_map(C.SCRIPT_NAMES), script), script)


# Annotations that aren't written as a consonant without its vowel.
WHOLE_ANNOTATIONS = {"g": "ग", "u": "उ", "i": "इ", "r": "र"}
# Annotations that are.
HALF_ANNOTATIONS = ("ś", "ṣ", "s", "ṅ", "ñ", "ṇ", "n", "m")


def annotation_to_deva(annotation: Column) -> Column:
    """An annotation in Devanagari; one that isn't known stays."""
    letters = equivalents("devanagari")
    table = WHOLE_ANNOTATIONS | {a: letters[a] + C.VIRAMA["devanagari"] for a in HALF_ANNOTATIONS}
    return F.coalesce(F.element_at(_map(table), annotation), annotation)


def deva_to_iast(text: Column) -> Column:
    """Devanagari to IAST, in built-in functions: consonants with their signs and accents become syllables. From the documentation only."""
    consonants = {p["devanagari"]: p["iast"] for p in C.phonemes() if p["kind"] == "consonant"}
    vowels = {p["devanagari"]: p["iast"] for p in C.phonemes() if p["kind"] == "vowel"}
    signs = {s["devanagari"]: v for v, s in C.vowel_signs().items() if s["devanagari"]}
    others = {p["devanagari"]: p["iast"] for p in C.phonemes() if p["kind"] == "special" and p["iast"] not in "।॥"} | {"ॐ": "oṁ", "ꣳ": "ṁ", "ँ": "m" + C.CANDRABINDU, "।": "|", "॥": "||"}
    others |= {chr(0x0966 + d): str(d) for d in range(10)} | {"॑": C.SVARITA, "॒": C.ANUDATTA, "᳚": C.UDATTA}
    letters = "".join(consonants)
    tokens = F.regexp_extract_all(text, F.lit(rf"(\[[^\]]*\]|[{letters}](?:[{''.join(signs)}]|{C.VIRAMA['devanagari']})?|(?s:.))"), 1)

    def one(t: Column) -> Column:
        head, tail = F.substring(t, 1, 1), F.substring(t, 2, 4)
        ending = F.when(tail == "", F.lit("a")).when(tail == C.VIRAMA["devanagari"], F.lit("")).otherwise(F.element_at(_map(signs), tail))
        plain = F.coalesce(F.element_at(_map(vowels | others), t), t)
        return F.when(F.length(t) > 2, t).when(head.isin(*consonants), F.concat(F.element_at(_map(consonants), head), ending)).otherwise(plain)

    return F.array_join(F.transform(tokens, one), "")
