"""String functions as Column builders."""

from __future__ import annotations

import html as html_std

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def trim_ws(text: Column) -> Column:
    """Without white space (see WS) at either end."""
    return F.regexp_replace(text, f"^{C.WS}+|{C.WS}+$", "")


def normalize_text(text: Column) -> Column:
    """Lower case; accents, anusvara and long e/o standardised; bracketed g before m resolved; full stops as dandas."""
    out = F.translate(F.lower(F.coalesce(text, F.lit(""))), C.STANDARD_FROM, C.STANDARD_TO)
    for old in ("(g)m", "(g)ṁ", "(g̱)ṁ", "(g̱)m"):
        out = F.replace(out, F.lit(old), F.lit("ṁ"))
    return F.replace(F.regexp_replace(out, rf"\.{C.WS}*\.", "॥"), F.lit("."), F.lit("।"))


def normalize_anusvara(text: Column, rigveda: bool = False) -> Column:
    """Nasalised m (and the superscripts that follow it) as plain anusvara; in the rigveda the m keeps its sign. Stray signs go."""
    keep = "\ue000" if rigveda else "ṁ"
    out = F.regexp_replace(text, f"m{C.CANDRABINDU}(?:g{{1,2}}ṁ?)?", keep)
    return F.replace(F.replace(out, F.lit(C.CANDRABINDU), F.lit("")), F.lit("\ue000"), F.lit(f"m{C.CANDRABINDU}"))


def script_counts(text: Column) -> list[Column]:
    return [F.regexp_count(text, F.lit(pattern)) for _, pattern in C.SCRIPTS]


def script_detect(text: Column) -> Column:
    """The script of most characters (ties: the earlier in SCRIPTS); null without any or below a quarter of all."""
    counts = script_counts(text)
    total, most = sum(counts[1:], counts[0]), F.greatest(*counts)
    first = F.coalesce(*[F.when(c == most, F.lit(name)) for c, (name, _) in zip(counts, C.SCRIPTS, strict=True)])
    return F.when((total > 0) & (most / total >= C.LEAST_SCRIPT_SHARE), first)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{C.WS[1:]}+"))


def paragraph_count(text: Column) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(text, "\n"), lambda line: trim_ws(line) != ""))


def p_tag_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit("<p"))


def escape_html(text: Column, quotes: bool = True) -> Column:
    out = text
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#039;")) if quotes else ())):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def compress_content(html: Column) -> Column:
    out = F.regexp_replace(F.coalesce(html, F.lit("")), rf">{C.WS}{{2,}}<", "> <")
    return trim_ws(F.regexp_replace(out, rf"\n{C.WS}*\n", "\n"))


def unescape(text: Column) -> Column:
    """Character references resolved as browsers do: named, with or without a semicolon, decimal and hexadecimal. Two thousand names and the prefix rule for those without a
    semicolon are a table of the standard library, so texts with an ampersand go through it, a batch at a time."""
    return F.when(F.contains(text, F.lit("&")), F.arrow_udf(_unescaped, "string")(text)).otherwise(text)


def _unescaped(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html_std.unescape(t) if "&" in t else "" for t in text.to_pylist()], pa.string())


# What of a page isn't text, and what ends a line.
DROPPED = (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>")
LINE_END, TAG = r"(?i)<br\s*/?\s*>|</p>|</div>", r"<[^>]+>"


def tagless(html: Column) -> Column:
    """Scripts and styles dropped, line ends for <br>, </p> and </div>, other tags dropped."""
    out = html
    for pattern in DROPPED:
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(F.regexp_replace(out, LINE_END, "\n"), TAG, "")


def html_to_text(html: Column) -> Column:
    """Text of a page: what tagless() leaves, character references resolved."""
    return unescape(tagless(html))


# The title and the body of a page.
TITLE, BODY = r"(?i)<title[^>]*>([^<]+)</title>", r"(?is)<body[^>]*>(.*?)</body>"


def extract_title(html: Column, otherwise: Column) -> Column:
    found = F.regexp_extract(html, TITLE, 1)
    return F.when(found != "", trim_ws(found)).otherwise(otherwise)


def extension(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def is_document(path: Column) -> Column:
    return F.lower(path).endswith(".smdoc")


# File extensions by the kind of icon.
KINDS = {
    "code": ("html", "htm", "xml", "js", "py", "cpp", "c", "cxx", "css", "json", "java", "ts"),
    "image": ("svg", "png", "jpg", "jpeg", "webp", "gif", "bmp", "ico"),
    "video": ("mp4", "webm", "ogg", "mov", "avi", "mkv"),
    "document": ("txt", "doc", "docx", "md", "rtf"),
    "audio": ("mp3", "wav", "aac", "flac", "m4a"),
    "smdoc": ("smdoc",),
}
# Extensions by viewer.
VIEWERS = {"smdoc": ("smdoc",), "image": ("png", "jpg", "jpeg", "gif", "bmp", "svg", "webp", "ico"), "text": ("txt", "md", "py", "js", "css", "json", "xml", "log", "ini", "conf", "sh", "bat", "csv")}


def _by_extension(path: Column, table: dict[str, tuple[str, ...]], otherwise: str) -> Column:
    ext = F.when(F.instr(path, ".") > 0, extension(path)).otherwise(F.lit(""))
    return F.coalesce(*[F.when(ext.isin(*values), F.lit(name)) for name, values in table.items()], F.lit(otherwise))


def file_kind(path: Column) -> Column:
    return _by_extension(path, KINDS, "other")


def viewer(path: Column) -> Column:
    return _by_extension(path, VIEWERS, "default")


def open_mode(path: Column) -> Column:
    return _by_extension(path, {"html": ("html", "htm"), "json": ("json",), "markdown": ("md", "markdown")}, "text")


def import_html_body(html: Column) -> Column:
    return F.when(F.regexp_like(html, F.lit(BODY)), F.regexp_extract(html, BODY, 1)).otherwise(html)


def import_json_content(json: Column) -> Column:
    """The content field; the whole text where there is none."""
    return F.coalesce(F.nullif(F.get_json_object(json, "$.content"), F.lit("")), json)


def import_markdown(text: Column) -> Column:
    out = text
    for pattern, new in ((r"(?m)^### (.*)$", "<h3>$1</h3>"), (r"(?m)^## (.*)$", "<h2>$1</h2>"), (r"(?m)^# (.*)$", "<h1>$1</h1>"), (r"\*\*(.*?)\*\*", "<strong>$1</strong>"), (r"\*(.*?)\*", "<em>$1</em>"), (r"\n", "<br>")):
        out = F.regexp_replace(out, pattern, new)
    return out


def query_fold(query: Column) -> Column:
    out = F.translate(F.lower(query), "āīūṛṝḷḹṁṃḥṭḍṅñṇḻ", "aiurrllmmhtdnnnl")
    return F.replace(F.replace(out, F.lit("ś"), F.lit("sh")), F.lit("ṣ"), F.lit("sh"))


def matches_query(haystack: Column, query: str) -> Column:
    """Every word of the query stands in the haystack, in either case."""
    words = [w for w in query.lower().split() if w]
    out = F.lit(True)
    for w in words:
        out = out & F.contains(F.lower(haystack), F.lit(w))
    return out


def clean_filename(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def clean_media_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_\-.]", "_")


def clean_doc_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_\-]", "")


def clone_name(name: Column) -> Column:
    base = F.regexp_replace(name, r"(?i)\.(smdoc|html?)$", "")
    ext = F.regexp_extract(name, r"(?i)\.(smdoc|html?)$", 0)
    return F.concat(base, F.lit(" copy"), ext)


def path_form(path: Column) -> Column:
    """A path without empty and "." parts, with each ".." taken back, its case kept; relative ones from the root, as an absolute path is made of them there."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    # An array that grows by parts and loses its last at "..".
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.array_append(done, p)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def norm_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"))


def basename(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/?[^/]*$", "")


def elide_path(path: Column, most: int = 72) -> Column:
    head = max(10, most // 4)
    tail = max(18, most - head - 1)
    return F.when(F.length(path) <= most, path).otherwise(F.concat(F.substring(path, 1, head), F.lit("…"), F.substring(path, -tail, tail)))


def format_size(n: Column) -> Column:
    return (
        F.when(n.isNull() | (n == 0), F.lit(""))
        .when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
        .when(n < 1048576, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.1f MB", n / 1048576))
    )


def format_audio_size(n: Column) -> Column:
    return F.when(n.isNull() | (n == 0), F.lit("")).when(n < 1048576, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.2f MB", n / 1048576))


def format_time(seconds: Column) -> Column:
    """m:ss.mmm with a sign; not a finite number: zero."""
    s = F.abs(seconds)
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (s < F.lit(float("inf")))
    text = F.format_string("%s%d:%02d.%03d", F.when(seconds < 0, F.lit("-")).otherwise(F.lit("")), F.floor(s / 60), F.floor(s % 60), F.floor((s % 1) * 1000))
    return F.when(finite, text).otherwise(F.lit("0:00.000"))


def parse_time(text: Column) -> Column:
    """Seconds of m:ss.mmm; null unless there is one colon."""
    parts = F.split(text, ":")
    second = F.split(parts[1], r"\.")
    fraction = F.when(F.size(second) > 1, F.concat(F.lit("0."), second[1]).try_cast("double")).otherwise(F.lit(0.0))
    return F.when(F.size(parts) == 2, parts[0].try_cast("double") * 60 + F.coalesce(second[0].try_cast("double"), F.lit(0.0)) + fraction)


def format_duration(seconds: Column) -> Column:
    return F.when(seconds.isNull() | (seconds == 0), F.lit("—")).otherwise(F.format_string("%d:%02d", F.floor(seconds / 60), F.floor(seconds % 60)))


def format_ago(then: Column, now: Column) -> Column:
    """How long ago, for two times in seconds; the date from a week on."""
    d = now - then
    number = lambda unit: F.floor(d / unit).cast("string")
    return (
        F.when(then.isNull() | (then == 0), F.lit(""))
        .when(d < 60, F.lit("Just now"))
        .when(d < 3600, F.concat(number(60), F.lit(" min ago")))
        .when(d < 86400, F.concat(number(3600), F.lit(" hours ago")))
        .when(d < 604800, F.concat(number(86400), F.lit(" days ago")))
        .otherwise(F.date_format(F.timestamp_seconds(then), "yyyy-MM-dd"))
    )


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def confidence(score: Column) -> Column:
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < F.lit(float("inf")))
    return F.when(finite, clamp(1 - score / 3.0, F.lit(0.05), F.lit(0.98))).otherwise(F.lit(0.25))


def confidence_label(value: Column) -> Column:
    return F.when(value >= 0.75, F.lit("high")).when(value >= 0.5, F.lit("medium")).otherwise(F.lit("low"))


def insert_jna(text: Column) -> Column:
    return F.replace(text, F.lit("jñ"), F.lit("jgñ"))


def insert_sv(text: Column) -> Column:
    return F.replace(text, F.lit("sv"), F.lit("suv"))


def insert_vy(text: Column) -> Column:
    return F.replace(text, F.lit("vy"), F.lit("vuy"))


def final_m_tick(text: Column) -> Column:
    """A tick after m (and its marks) at the end of a segment. From the documentation only."""
    return F.regexp_replace(text, r"(m[\x{300}-\x{36f}]*)(?=\s*(?:[\n।॥]|$))", f"$1{C.TICK}")


def rigveda_svarita(text: Column) -> Column:
    """The first pass of the documented rule: svarita on a long vowel, or on anusvara after a short one, is doubled."""
    out = F.regexp_replace(text, f"(ā|ī|ū|ṝ|ḹ|ai|au|e|o){C.SVARITA}", f"$1{C.UDATTA}")
    return F.regexp_replace(out, f"([aiuṛḷ]ṁ){C.SVARITA}", f"$1{C.UDATTA}")


def svarabhakti_text(text: Column) -> Column:
    """The text with dots put in, in one regular expression."""
    skip = rf"(?:{C.WS}|[\x{{300}}-\x{{36f}}\x{{2ce}}\x{{200b}}-\x{{200d}}])"
    return F.regexp_replace(text, rf"r([\x{{300}}-\x{{36f}}\x{{2ce}}]*)(?={skip}*[sśṣhṛ])", f"r$1{C.DOT}")


def syllable_count(text: Column) -> Column:
    """Vowel nuclei. From the documentation only."""
    return F.regexp_count(F.lower(text), F.lit("ai|au|[aāiīuūṛṝḷḹeo]"))


def one_of(values: tuple[str, ...]) -> str:
    """A pattern of the longest of values at a place."""
    return f"(?:{'|'.join(sorted(values, key=len, reverse=True))})"


def consonant_at(text: Column, i: Column) -> Column:
    """The consonant that starts at i (from 0), the longer one first; empty if none."""
    return F.regexp_extract(F.substring(text, i + 1, F.lit(2)), f"^{one_of(C.CONSONANTS)}", 0)


def vowel_at(text: Column, i: Column) -> Column:
    return F.regexp_extract(F.substring(text, i + 1, F.lit(2)), f"^{one_of(C.VOWELS)}", 0)


_VOWEL_LETTERS = "".join(v for v in C.VOWELS if len(v) == 1)


def previous_vowel(text: Column, i: Column, also: str = "") -> Column:
    """The last vowel letter (or letter of `also`) before i; empty if none. Of a diphthong that is its second letter."""
    letters = _VOWEL_LETTERS + also
    return F.regexp_extract(F.substring(text, F.lit(1), i), f"([{letters}])[^{letters}]*$", 1)


def holding_type(text: Column, i: Column) -> Column:
    """long if the vowel before i is, else short."""
    return F.when(previous_vowel(text, i).isin(*(v for v in C.LONG_VOWELS if len(v) == 1)), F.lit("long")).otherwise(F.lit("short"))


#: A nasalised m, its sign, and the superscripts that follow it; or a sign by itself.
_ANNOTATION = f"m{C.CANDRABINDU}(?:gṁ?)?|{C.CANDRABINDU}"


def annotations(text: Column) -> Column:
    """The characters of text that are annotations."""
    return F.filter(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"({_ANNOTATION})"), 1), lambda a: F.split(a, ""))), lambda c: c != "")


def superscripts(text: Column) -> Column:
    """The characters of text that are superscripts of a nasalised m: all of its annotation but the sign."""
    return F.filter(annotations(text), lambda c: c != C.CANDRABINDU)


def is_combining(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"^[\x{300}-\x{36f}]$"))


def is_svara(c: Column) -> Column:
    return (F.length(c) == 1) & F.contains(F.lit(C.SVARA), c)


def is_bija(word: Column) -> Column:
    return F.lower(trim_ws(word)).isin(*C.BIJA)


def rule_counts(text: Column) -> list[Column]:
    """How often the insertion rules apply: n_sv, n_vy, n_jna."""
    return [F.regexp_count(text, F.lit(pair)).alias(name) for name, pair in (("n_sv", "sv"), ("n_vy", "vy"), ("n_jna", "jñ"))]


# What stands between letters: white space, marks, accents (and, looking ahead, characters without a width).
_BETWEEN = rf"{C.WS[1:-1]}\x{{300}}-\x{{36f}}\x{{2ce}}·"
_NO_WIDTH = r"\x{200b}-\x{200d}\x{feff}"


def following_letters(text: Column, letter: str) -> Column:
    """For each place of a letter that another follows, that one."""
    return F.regexp_extract_all(text, F.lit(rf"{letter}(?=[{_BETWEEN}{_NO_WIDTH}]*+([^{_BETWEEN}{_NO_WIDTH}]))"), 1)


def preceding_letters(text: Column, letter: str) -> Column:
    """For each place of a letter that another precedes, that one."""
    return F.regexp_extract_all(text, F.lit(rf"([^{_BETWEEN}])[{_BETWEEN}]*+(?={letter})"), 1)


def is_guarded(path: Column, root: str) -> Column:
    """The path begins with a root (as a prefix of the text: no separator is asked for), doubled slashes being one."""
    return F.startswith(F.regexp_replace(path, "/+", "/"), F.lit(root))


def token_pattern() -> str:
    two = [v for v in C.VOWELS + C.CONSONANTS if len(v) == 2]
    return f"({'|'.join(two)}|(?s:.))"


def tokenize_phonemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(token_pattern()), 1)
