"""Documents as pages of HTML, and back: tags are scanned once, so that nested blocks end where their own closing tag stands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

#: The parts of a page, which make it up without a gap: comments, elements whose content isn't markup, tags, text.
PIECE = r"""(?is)(<!--.*?-->|<(?:script|style|title|textarea)\b(?:"[^"]*+"|'[^']*+'|[^>"'])*+>.*?</(?:script|style|title|textarea)\s*>|</?[a-z](?:"[^"]*+"|'[^']*+'|[^>"'])*+>|[^<]++|<)"""
#: What a written number begins with, as parsers of numbers in pages read it.
NUMBER = r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
EDITOR, ATTACHED = "ql-editor", "ql-audio-attachment"
SOUND = "array<struct<id:string,label:string,src:string,startTime:double,endTime:double,fadeIn:double,fadeOut:double,duration:double,size:double>>"


def pieces(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(PIECE), 1)


def tag_name(piece: Column) -> Column:
    """The name of an opening or closing tag in lower case; empty for what isn't a tag."""
    return F.lower(F.regexp_extract(piece, r"^</?([a-zA-Z][^\s/>]*)", 1))


def _closes(piece: Column) -> Column:
    return F.startswith(piece, F.lit("</"))


def plain(text: Column) -> Column:
    """The references that escaping writes, resolved."""
    for old, new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of an opening tag; null where it isn't there."""
    before = r"""^<[a-zA-Z][^\s/>]*(?:\s+[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?|/)*?\s+"""
    pattern = rf"""(?is){before}{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
    found = F.regexp_extract(tag, pattern, 1)
    return F.when(found != "", plain(F.regexp_replace(found, r"""^(["'])(.*)\1$""".replace("(.*)", "((?s:.*))"), "$2")))


def has_class(tag: Column, name: str) -> Column:
    return F.contains(tag, F.lit(name)) & F.array_contains(F.split(F.coalesce(attribute(tag, "class"), F.lit("")), r"\s+"), name)


def _opens(piece: Column, name: str) -> Column:
    return (tag_name(piece) != "") & ~_closes(piece) & has_class(piece, name)


def first_block(parts: Column, name: str) -> Column:
    """What the first element of a class holds, as written; null without one. An element ends where as many tags of its name have closed as opened in it; one that never closes runs to the end of the body."""
    zero = F.struct(F.lit(0).alias("n"), F.lit("").alias("tag"), F.lit(0).alias("start"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(s: Column, p: Column) -> Column:
        starts = (s["start"] == 0) & _opens(p, name)
        inside = (s["start"] > 0) & (s["end"] == 0)
        same = inside & (tag_name(p) == s["tag"])
        depth = F.when(starts, 1).when(same & _closes(p), s["depth"] - 1).when(same & ~F.endswith(p, F.lit("/>")), s["depth"] + 1).otherwise(s["depth"])
        ends = inside & ((depth == 0) | (_closes(p) & (tag_name(p) == "body")))
        return F.struct((s["n"] + 1).alias("n"), F.when(starts, tag_name(p)).otherwise(s["tag"]).alias("tag"), F.when(starts, s["n"] + 1).otherwise(s["start"]).alias("start"), depth.alias("depth"), F.when(ends, s["n"] + 1).otherwise(s["end"]).alias("end"))

    at = F.aggregate(parts, zero, step)
    # Looked at once: the bounds, then the pieces between them.
    inner = F.transform(F.array(at), lambda s: F.when(s["start"] > 0, F.array_join(F.slice(parts, s["start"] + 1, F.when(s["end"] > 0, s["end"]).otherwise(s["n"] + 1) - s["start"] - 1), "")))
    return F.get(inner, F.lit(0))


def _number(value: Column) -> Column:
    """The number that a text begins with; null if it begins with none."""
    return F.nullif(F.regexp_extract(F.coalesce(value, F.lit("")), NUMBER, 1), F.lit("")).cast("double")


def attachments(parts: Column) -> Column:
    """The sound attachments of a page, by their data attributes, in order; those without an id or a source are left out. A missing source is that of the first <audio> in the attachment's own element."""
    def step(s: Column, p: Column) -> Column:
        starts, name = _opens(p, ATTACHED), tag_name(p)
        move = F.when((name == "") | F.endswith(p, F.lit("/>")), 0).when(_closes(p), -1).otherwise(1)
        # open: attachments whose element isn't closed yet, each with the depth of its own name inside it.
        kept = F.filter(F.transform(s["open"], lambda o: F.struct(o["n"].alias("n"), o["tag"].alias("tag"), (o["depth"] + F.when(o["tag"] == name, move).otherwise(0)).alias("depth"))), lambda o: o["depth"] > 0)
        opened = F.when(starts, F.concat(kept, F.array(F.struct((F.size(s["tags"]) + 1).alias("n"), name.alias("tag"), F.lit(1).alias("depth"))))).otherwise(kept)
        sounds = F.when((name == "audio") & ~_closes(p) & (F.size(kept) > 0), F.concat(s["sounds"], F.transform(kept, lambda o: F.struct(o["n"].alias("n"), F.coalesce(attribute(p, "src"), F.lit("")).alias("src"))))).otherwise(s["sounds"])
        return F.struct(F.when(starts, F.concat(s["tags"], F.array(p))).otherwise(s["tags"]).alias("tags"), opened.alias("open"), sounds.alias("sounds"))

    none = lambda kind: F.array().cast(f"array<{kind}>")
    zero = F.struct(none("string").alias("tags"), none("struct<n:int,tag:string,depth:int>").alias("open"), none("struct<n:int,src:string>").alias("sounds"))

    def record(s: Column, tag: Column, k: Column) -> Column:
        text = lambda name: F.coalesce(attribute(tag, f"data-{name}"), F.lit(""))
        number = lambda name: F.coalesce(_number(attribute(tag, f"data-{name}")), F.lit(0.0))
        sound = F.get(F.filter(s["sounds"], lambda x: x["n"] == k + 1), F.lit(0))["src"]
        end = F.when(text("end-time") != "", F.coalesce(_number(text("end-time")), F.lit(float("nan"))))
        label = F.when(text("audio-label") != "", text("audio-label")).otherwise(F.lit("Audio"))
        src = F.when(text("audio-src") != "", text("audio-src")).otherwise(F.coalesce(sound, F.lit("")))
        fields = {"id": text("audio-id"), "label": label, "src": src, "startTime": number("start-time"), "endTime": end, "fadeIn": number("fade-in"), "fadeOut": number("fade-out"), "duration": number("duration"), "size": number("size")}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    states = F.array(F.aggregate(parts, zero, step))
    found = F.get(F.transform(states, lambda s: F.transform(s["tags"], lambda tag, k: record(s, tag, k))), F.lit(0))
    return F.filter(found, lambda a: (a["id"] != "") & (a["src"] != ""))


def from_html(page: Column) -> Column:
    """struct<content, title, theme, attachments> of a page. content: what the first editor block holds, trimmed, empty without one. title: "Untitled" where it is missing or empty;
    theme: that of the body, else "light". A null page gives null."""
    parts = pieces(page)
    title = F.get(F.filter(parts, lambda p: (tag_name(p) == "title") & ~_closes(p)), F.lit(0))
    body = F.get(F.filter(parts, lambda p: (tag_name(p) == "body") & ~_closes(p)), F.lit(0))
    named = lambda value, other: F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(F.lit(other))
    out = F.struct(
        T.trim_ws(F.coalesce(first_block(parts, EDITOR), F.lit(""))).alias("content"), named(plain(F.regexp_extract(title, r"(?is)^<[^>]*>(.*)</", 1)), "Untitled").alias("title"),
        named(attribute(body, "data-theme"), "light").alias("theme"), 
        F.when(F.contains(page, F.lit(ATTACHED)), attachments(parts)).otherwise(F.array().cast(SOUND)).alias("attachments"),
    )
    return F.when(page.isNotNull(), out)
