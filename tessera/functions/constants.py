"""Fixed values that results depend on: character classes, phonemes, patterns."""

from __future__ import annotations

# White space as the text editor's regular expressions and trim() see it. It works in Java, RE2 and (see PY_WS) Python.
WS = r"[\t\n\x0b\x0c\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
PY_WS = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Accent marks, and what they are standardised from.
SVARITA, ANUDATTA, UDATTA, TICK, DOT, CANDRABINDU = "\u030d", "\u0331", "\u030e", "\u02ce", "·", "\u0310"
SVARA = ANUDATTA + SVARITA + UDATTA + TICK + DOT
STANDARD = (
    ("\u0951", "\u030d"),  # devanagari stress sign udatta
    ("\u0952", "\u0331"),  # devanagari stress sign anudatta
    ("\u0332", "\u0331"),  # combining low line
    ("\u0320", "\u0331"),  # combining minus sign below
    ("\u0321", "\u0331"),  # combining palatalized hook below
    ("\u1cda", "\u030e"),  # vedic tone double svarita
    ("\u0341", "\u030e"),  # combining acute tone mark
    ("ṃ", "ṁ"),  # latin small letter m with dot below
    ("ꣳ", "ṁ"),  # devanagari sign candrabindu virama
    ("ō", "o"),  # latin small letter o with macron
    ("ē", "e"),  # latin small letter e with macron
)
STANDARD_FROM, STANDARD_TO = ("".join(side) for side in zip(*STANDARD, strict=True))

# Sounds by class.
SHORT_VOWELS = ("a", "i", "u", "ṛ", "ḷ")
LONG_VOWELS = ("ā", "ī", "ū", "ṝ", "ḹ", "e", "ai", "o", "au")
VOWELS = SHORT_VOWELS + LONG_VOWELS
ASPIRATES = ("kh", "gh", "ch", "jh", "ṭh", "ḍh", "th", "dh", "ph", "bh")
CONSONANTS = ("k", "kh", "g", "gh", "ṅ", "c", "ch", "j", "jh", "ñ", "ṭ", "ṭh", "ḍ", "ḍh", "ṇ", "t", "th", "d", "dh", "n", "p", "ph", "b", "bh", "m", "y", "r", "l", "ḻ", "v", "ś", "ṣ", "s", "h", "ḥ", "ṁ", "ṃ")
NO_HOLDING = ("ṅ", "ñ", "ṇ", "n", "m", "ṁ", "ṃ", "r", "ś", "ṣ", "s")
SIBILANTS = ("ś", "ṣ", "s")
BEFORE_G_FORMS = ("ś", "ṣ", "s", "h", "r")
NASAL_OF = {"ṅ": ("k", "kh", "g", "gh"), "ñ": ("c", "ch", "j", "jh"), "ṇ": ("ṭ", "ṭh", "ḍ", "ḍh"), "n": ("t", "th", "d", "dh"), "m": ("p", "ph", "b", "bh")}
NON_VOWELS = ("k", "kh", "g", "gh", "c", "ch", "j", "jh", "ṭ", "ṭh", "ḍ", "ḍh", "t", "th", "d", "dh", "p", "ph", "b", "bh", "m", "y", "r", "l", "v", "ś", "ṣ", "s", "h", "ḻ")
VISARGA_BEFORE = {"ś": "c", "ṣ": "ṭ", "s": "t"}
VOICED = ("g", "gh", "j", "jh", "ḍ", "ḍh", "d", "dh", "b", "bh", "m")
SVARABHAKTI_BEFORE = ("s", "ś", "ṣ", "h", "ṛ")
BIJA = ("oṁ", "auṁ", "hrīṁ", "śrīṁ", "klīṁ", "aiṁ", "sauṁ", "krīṁ", "hlīṁ", "strīṁ", "blūṁ", "glauṁ", "hauṁ", "huṁ", "phaṭ", "dūṁ", "gaṁ", "drāṁ", "grīṁ", "kṣrauṁ")

# Phonemes by their IAST, Devanagari, Telugu and Tamil letters, the nearest Tamil letter where there is no own one, ITRANS, and kind.
PHONEME_FIELDS = ("iast", "devanagari", "telugu", "tamil", "tamil_approx", "itrans", "kind")
PHONEMES = (
    ("a", "अ", "అ", "அ", None, "a", "vowel"),
    ("ā", "आ", "ఆ", "ஆ", None, "aa", "vowel"),
    ("i", "इ", "ఇ", "இ", None, "i", "vowel"),
    ("ī", "ई", "ఈ", "ஈ", None, "ii", "vowel"),
    ("u", "उ", "ఉ", "உ", None, "u", "vowel"),
    ("ū", "ऊ", "ఊ", "ஊ", None, "uu", "vowel"),
    ("ṛ", "ऋ", "ఋ", None, "ரு", "R^i", "vowel"),
    ("ṝ", "ॠ", "ౠ", None, None, "R^I", "vowel"),
    ("ḷ", "ऌ", "ఌ", None, None, "L^i", "vowel"),
    ("ḹ", "ॡ", "ౡ", None, None, "L^I", "vowel"),
    ("e", "ए", "ఏ", "ஏ", None, "e", "vowel"),
    ("ai", "ऐ", "ఐ", "ஐ", None, "ai", "vowel"),
    ("o", "ओ", "ఓ", "ஓ", None, "o", "vowel"),
    ("au", "औ", "ఔ", "ஔ", None, "au", "vowel"),
    ("k", "क", "క", "க", None, "k", "consonant"),
    ("kh", "ख", "ఖ", None, "க", "kh", "consonant"),
    ("g", "ग", "గ", None, "க", "g", "consonant"),
    ("gh", "घ", "ఘ", None, "க", "gh", "consonant"),
    ("ṅ", "ङ", "ఙ", "ங", None, "N^", "consonant"),
    ("c", "च", "చ", "ச", None, "ch", "consonant"),
    ("ch", "छ", "ఛ", None, "ச", "Ch", "consonant"),
    ("j", "ज", "జ", "ஜ", None, "j", "consonant"),
    ("jh", "झ", "ఝ", None, "ஜ", "jh", "consonant"),
    ("ñ", "ञ", "ఞ", "ஞ", None, "~n", "consonant"),
    ("ṭ", "ट", "ట", "ட", None, "T", "consonant"),
    ("ṭh", "ठ", "ఠ", None, "ட", "Th", "consonant"),
    ("ḍ", "ड", "డ", None, "ட", "D", "consonant"),
    ("ḍh", "ढ", "ఢ", None, "ட", "Dh", "consonant"),
    ("ṇ", "ण", "ణ", "ண", None, "N", "consonant"),
    ("t", "त", "త", "த", None, "t", "consonant"),
    ("th", "थ", "థ", None, "த", "th", "consonant"),
    ("d", "द", "ద", None, "த", "d", "consonant"),
    ("dh", "ध", "ధ", None, "த", "dh", "consonant"),
    ("n", "न", "న", "ந", None, "n", "consonant"),
    ("p", "प", "ప", "ப", None, "p", "consonant"),
    ("ph", "फ", "ఫ", None, "ப", "ph", "consonant"),
    ("b", "ब", "బ", None, "ப", "b", "consonant"),
    ("bh", "भ", "భ", None, "ப", "bh", "consonant"),
    ("m", "म", "మ", "ம", None, "m", "consonant"),
    ("y", "य", "య", "ய", None, "y", "consonant"),
    ("r", "र", "ర", "ர", None, "r", "consonant"),
    ("l", "ल", "ల", "ல", None, "l", "consonant"),
    ("v", "व", "వ", "வ", None, "v", "consonant"),
    ("ś", "श", "శ", "ஶ", None, "sh", "consonant"),
    ("ṣ", "ष", "ష", "ஷ", None, "Sh", "consonant"),
    ("s", "स", "స", "ஸ", None, "s", "consonant"),
    ("h", "ह", "హ", "ஹ", None, "h", "consonant"),
    ("ḻ", "ळ", "ళ", "ழ", None, "lh", "consonant"),
    ("ṁ", "ं", "ం", "ஂ", None, "M", "special"),
    ("ḥ", "ः", "ః", "ஃ", None, "H", "special"),
    ("'", "ऽ", "ఽ", None, None, ".a", "special"),
    ("।", "।", "।", "।", None, "|", "special"),
    ("॥", "॥", "॥", "॥", None, "||", "special"),
)
# Vowels and their signs in Devanagari, Telugu and Tamil; the inherent a has an empty one.
VOWEL_SIGNS = (
    ("a", "", "", ""),
    ("ā", "ा", "ా", "ா"),
    ("i", "ि", "ి", "ி"),
    ("ī", "ी", "ీ", "ீ"),
    ("u", "ु", "ు", "ு"),
    ("ū", "ू", "ూ", "ூ"),
    ("ṛ", "ृ", "ృ", None),
    ("ṝ", "ॄ", "ౄ", None),
    ("ḷ", "ॢ", "ౢ", None),
    ("ḹ", "ॣ", "ౣ", None),
    ("e", "े", "ే", "ே"),
    ("ai", "ै", "ై", "ை"),
    ("o", "ो", "ో", "ோ"),
    ("au", "ौ", "ౌ", "ௌ"),
)
VIRAMA = {"devanagari": "्", "telugu": "్", "tamil": "்", "iast": "", "itrans": ""}
SCRIPT_NAMES = {"iast": "IAST", "devanagari": "Devanagari", "telugu": "Telugu", "tamil": "Tamil", "itrans": "ITRANS"}
ACCENTS = (ANUDATTA, SVARITA, UDATTA, CANDRABINDU)

# Ranges of script detection, in the order that settles ties.
SCRIPTS = (("devanagari", r"[\x{900}-\x{97f}\x{a8e0}-\x{a8ff}]"), ("telugu", r"[\x{c00}-\x{c7f}]"), ("tamil", r"[\x{b80}-\x{bff}]"), ("kannada", r"[\x{c80}-\x{cff}]"), ("malayalam", r"[\x{d00}-\x{d7f}]"), ("latin", r"[\x{41}-\x{7a}\x{c0}-\x{24f}\x{300}-\x{36f}]"))
LEAST_SCRIPT_SHARE = 0.25


def phonemes() -> list[dict[str, str | None]]:
    """One record per phoneme, by PHONEME_FIELDS."""
    return [dict(zip(PHONEME_FIELDS, p, strict=True)) for p in PHONEMES]


def vowel_signs() -> dict[str, dict[str, str | None]]:
    """IAST vowel -> script -> sign."""
    return {v: {"devanagari": devanagari, "telugu": telugu, "tamil": tamil} for v, devanagari, telugu, tamil in VOWEL_SIGNS}
