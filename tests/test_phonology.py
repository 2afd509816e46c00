"""Rules on the fixtures worked out by hand (FIXTURES.md), and properties."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import phonology as P
from tessera.functions import text as T

TEXT = st.text(alphabet="aāiuṛeokgtdrsśhmnṁḥ ̱̍·|\n.vyjñ̐", max_size=40)


def shown(edit):
    return "".join(f"[{p[0]}]" if p[1] else p[0] for p in edit[2])


@pytest.mark.parametrize(("text", "at"), [("darśana", [3]), ("varṣa", [3]), ("arhati", [2]), ("punar hi", [5]), ("kar̍śa", [4]), ("r·sa", []), ("ar", [])])
def test_svarabhakti(text, at):
    assert [e[0] for e in P.svarabhakti(text)] == at


@pytest.mark.parametrize(("text", "want"), [("devā iha", [(5, "long")]), ("iha eva", [(4, "short")]), ("ca api", [(3, "short")]), ("oṁ namaḥ", [(3, "short")]), ("loṁ x", [(4, "short")]), ("devāḥ iha", []), ("devā  iha", [])])
def test_pauses(text, want):
    assert P.pauses(text) == want


@pytest.mark.parametrize(("text", "want"), [("agni", "1g short"), ("asya", "2y short"), ("tvam", "0t short"), ("jñasya", "0j short 4y short"), ("iddeveṣu", "1d short"), ("taṁ yajñasya", "4y short 6j short 10y short"), ("vāk sma", "4s long"), ("devā asti", "7t short"), ("karma", "3m short"), ("maitra", "3t short"), ("a| kta", "3k short")])
def test_holdings(text, want):
    assert " ".join(f"{p}{text[p : p + n]} {t}" for p, n, t in P.holdings(text)) == want


def test_diphthongs_count_as_long_if_asked():
    assert P.holdings("maitra", diphthong_long=True) == [(3, 1, "long")]


ANUSVARA = {"taṁ karoti": ("ṅ", "ṁ", "ṁ"), "taṁ ca": ("ñ", "ṁ", "ṁ"), "taṁ mama": ("m", "ṁ", "ṁ"), "taṁ vada": ("ṁ[u]", "ṁ[u]", "ṁ"), "taṁ loka": ("ṁ[l]", "ṁ[l]", "ṁ"), "taṁ yajña": ("ṁ[i]", "ṁ[i]", "ṁ"), "taṁ śatru": ("m̐[g][ṁ]", "ṁ", "ṁ"), "taṁ śrī": ("m̐[g][g]", "ṁ", "ṁ"), "tāṁ śrī": ("m̐[g]", "ṁ", "ṁ"), "taṁ snāna": ("m̐[g][ṁ]", "ṁ", "ṁ"), "taṁ jñāna": ("ṁ", "ṁ", "ṁ"), "taṁ api": ("ṁ", "ṁ", "ṁ")}


@pytest.mark.parametrize("text", ANUSVARA)
def test_anusvara(text):
    assert tuple(shown(P.anusvara(text, s)[0]) for s in ("yajurveda", "rigveda", "smriti")) == ANUSVARA[text]


VISARGA = {"rāmaḥ pacati": "ḥ[f]", "rāmaḥ śete": "ś", "agniḥ gacchati": "r", "agniḥ atra": "r", "rāmaḥ gacchati": "", "rāmaḥ karoti": "", "agniḥ yāti": "", "rāmaḥ | tatra": "", "rāmaḥ": "", "rāmaḥ kṣetra": "ḥ:[a]", "rāmaḥ carati": "ś", "rāmaḥ ṭīkā": "ṣ", "rāmaḥ tatra": "s"}


@pytest.mark.parametrize("text", VISARGA)
def test_visarga(text):
    (edit,) = P.visarga(text)
    assert (shown(edit), edit[3]) == (VISARGA[text], bool(VISARGA[text]))


def applied(text, edits):
    for i, n, parts, changed in sorted(edits, reverse=True):
        if changed:
            text = text[:i] + "".join(p[0] for p in parts) + text[i + n :]
    return text


@given(TEXT)
def test_svarabhakti_is_idempotent(text):
    once = applied(text, P.svarabhakti(text))
    assert P.svarabhakti(once) == []
    assert once.replace("·", "") == text.replace("·", "")


@given(TEXT)
def test_producers_stay_within_the_text(text):
    for edits in (P.visarga(text), P.anusvara(text, "yajurveda"), P.anusvara(text, "rigveda")):
        assert all(0 <= e[0] and e[0] + e[1] <= len(text) for e in edits)
        assert [e[0] for e in edits] == sorted({e[0] for e in edits})
    assert all(0 <= p <= len(text) for p, _ in P.pauses(text))
    assert all(text[p : p + n] for p, n, _ in P.holdings(text))


def test_bija_is_left_alone():
    assert P.anusvara("oṁ namaḥ", "yajurveda") == []
    assert len(P.anusvara("oṁ namaḥ", "yajurveda", skip_bija=False)) == 1


def test_columns_apply_edits_and_keep_nulls(spark):
    t = spark.createDataFrame([("taṁ karoti", "yajurveda"), ("agniḥ atra", None), (None, None), ("", "rigveda")], "t string, s string")
    rows = t.select(P.apply_edits(F.col("t"), P.anusvara_edits(F.col("t"), F.col("s"))).alias("a"), P.apply_edits(F.col("t"), P.visarga_edits(F.col("t"))).alias("v"), P.holdings_of(F.col("t")).alias("h")).collect()
    assert [r.a for r in rows] == ["taṅ karoti", "agniḥ atra", None, ""]
    assert [r.v for r in rows] == ["taṁ karoti", "agnir atra", None, ""]
    assert rows[2].h is None
    assert rows[3].h == []


@pytest.mark.parametrize(("text", "want"), [("Agni. Rāma..", "agni। rāma॥"), ("A...B", "a॥।b"), ("1.5", "1।5"), ("saṃ (g)m", "saṁ ṁ"), ("(g)(g)m", "ṁ"), ("a॑", "a̍")])
def test_normalize(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.normalize_text(F.col("t"))).first()[0] == want


def test_rule_pipeline_by_brute_force(spark):
    from tessera.plans import pipelines

    texts = ["agniḥ atra taṁ śatruṁ Jñāna svar vyoma darśana agnim", "taṁ karoti.", "oṁ\nrāmaḥ pacati ।", "hotā̍raṁ vāk sma", ""]
    rows = [(i, t, s) for i, t in enumerate(texts) for s in ("yajurveda", "rigveda", "smriti")]
    out = pipelines.rule_pipeline(spark.createDataFrame(rows, "i int, text string, source string"), source=F.col("source"))
    plain = spark.createDataFrame(rows, "i int, text string, source string").select("i", "source", T.normalize_text(F.col("text")).alias("n"))
    tail = lambda t: spark.createDataFrame([(t,)], "t string").select(T.final_m_tick(F.col("t"))).first()[0]
    svarita = lambda t: spark.createDataFrame([(t,)], "t string").select(T.rigveda_svarita(F.col("t"))).first()[0]
    want = {}
    for i, source, t in plain.collect():
        t = t.replace("jñ", "jgñ").replace("sv", "suv").replace("vy", "vuy")
        t = applied(t, P.svarabhakti(t))
        t = applied(t, P.anusvara(t, source))
        t = applied(t, P.visarga(t))
        want[i, source] = tail(svarita(t) if source == "rigveda" else t)
    assert {(r.i, r.source): r.text for r in out.collect()} == want


@given(TEXT)
def test_compiled_patterns_agree_with_the_scan(text):
    s, found, i = P.Scan(text), [], 0
    while i < len(text):
        value = "" if s.annotation[i] or text[i] == "|" else P.consonant_at(text, i)
        parts, end = P.cluster(s, i) if value else ([], i)
        if len(parts) > 1:
            target, at, _ = parts[P.held(parts)]
            found.append((i, len(parts), at, len(target)))
            i = end
        else:
            i += max(1, len(value))
    assert P.clusters(text) == found
    dots = [i for i, c in enumerate(text) if c == "r" and (a := s.following(i)) and text[a[0]] in "sśṣhṛ" and "·" not in text[i : a[0]]]
    assert len(P.svarabhakti_places(text)) == len(dots)
