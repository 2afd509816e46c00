"""Line deduplication across documents by a deletion-neighbourhood join, in DataFrame operations only.

A line goes if an earlier line (by document id, then position) is equal or within one edit (a character replaced, inserted or left out).
Lines within one edit agree on all but one of a few segments, so each line first gives a key for all of it but each segment,
under its own length and the next; only where different lines share a key are variants made: the key with every single
character of the segment deleted. Equal variants at one position are replacements of each other; a variant equal to a shorter line is an
insertion. Variants meet in aggregates that keep the earliest line, never in pairs, and what they suggest is verified by the edit
distance of the lines themselves. Long lines are cut into few segments first, and those that are shared are cut again.

Nothing that grows with the input is broadcast: joins shuffle (but for that of documents with up to a megabyte of places), and of the
shared keys only a bitmap of fixed size goes to all tasks.

Defined results. A null text counts as empty. Lines end at a newline. Lines under `shortest` characters have no near match; those under
`exact` characters, and blank ones under `shortest`, always stay. Null
ids come last in order; rows equal in id and text count as one row and get the same result. A document without removed lines is
returned as it is. An empty table gives an empty table. Extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, broadcast_if_small, fresh, in_bitmap, keyed, materialize

SHORTEST, SEGMENT = 20, 192
#: A line is cut into at most this many segments; those of long lines are cut again, so that keys cost time in proportion to a line's length.
PARTS = 32
#: Up to this many characters the library's edit distance is taken; its time grows with the square of the length.
MEASURED = 1000
#: The bitmap of shared keys has at most this many blocks (a power of two) of 4 KB.
BLOCKS = 1024
#: Bytes, as held in memory, of places that are broadcast to documents; beyond it documents are shuffled.
SENT = 1 << 20


def _lines(rows: DataFrame, shortest: int, exact: int) -> DataFrame:
    """(id, th, pos, line, n, h1, h2) of the lines that may go. h1, h2: a digest of the line."""
    long = F.col("n") >= shortest
    lines = rows.select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("n", F.char_length("line")).filter(long | (F.col("n") >= exact) & F.col("line").rlike(r"\S") if exact < shortest else long)
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), "line"))


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), "id", "th", "pos")


def _cuts(length: str, segment: int) -> str:
    """SQL of the segments (c, b, e) of a class of lines of this length c: each from b to e."""
    n = f"least({PARTS}, greatest(3, cast(ceil({length} / {segment}) as int)))"
    return f"transform(sequence(0, {n} - 1), s -> named_struct('c', {length}, 'b', cast(floor(s * cast({length} as bigint) / {n}) as int), 'e', cast(floor((s + 1) * cast({length} as bigint) / {n}) as int)))"


def _anchors(lines: DataFrame, segment: int) -> DataFrame:
    """A row for each class (own length, or one more) and segment: key of the class and all the line but the segment, long (own length), seg (the segment)."""
    out = lines.withColumn("single", F.expr("if(octet_length(line) = n, cast(line as binary), NULL)")).withColumn("at", F.expr(f"explode(concat({_cuts('n', segment)}, {_cuts('(n + 1)', segment)}))"))
    # In a line of single bytes places are found without counting characters.
    part = lambda start, n: f"if(single IS NULL, cast(substring(line, {start}, {n}) as binary), substring(single, {start}, {n}))"
    key = F.expr(f"xxhash64(at.c, at.b, {part('1', 'at.b')}, {part('n - (at.c - at.e) + 1', 'at.c - at.e')})")
    return out.withColumn("key", key).withColumn("long", F.col("at.c") == F.col("n")).withColumn("seg", F.expr("substring(line, at.b + 1, n - at.b - (at.c - at.e))")).drop("at", "single")


def _sieved(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key may be in keys, a materialised table: all that is, and a share of the others that grows with the number of keys over the bits of the bitmap."""
    there, bit = in_bitmap("key", BLOCKS)
    return rows.join(F.broadcast(bitmap(keys, BLOCKS)), there & bit).drop("block", "sieve")


def _finer(near: DataFrame, segment: int) -> DataFrame:
    """Rows of near with their segments cut again, where different lines still share the key. Lines that share several keys (those of one sign, say) go on with one."""
    own = F.xxhash64("h1", "h2", "long").cast("decimal(38,0)")
    groups = near.groupBy("key").agg(F.count("*").alias("n"), F.sum(own).alias("s"), F.min(own).alias("lo"), F.max(own).alias("hi"))
    near = near.join(groups.groupBy("n", "s", "lo", "hi").agg(F.min("key").alias("key")).select("key").hint("merge"), "key")
    t = near.withColumn("m", F.length("seg")).withColumn("at", F.expr(f"explode({_cuts('(length(seg) + if(long, 0, 1))', segment)})"))
    key = F.expr("xxhash64(key, at.c, at.b, substring(seg, 1, at.b), substring(seg, m - (at.c - at.e) + 1))")
    t = t.select(key.alias("key"), "h1", "h2", "place", F.expr("substring(seg, at.b + 1, m - at.b - (at.c - at.e))").alias("seg"), "long").dropDuplicates(["key", "h1", "h2"])
    t = materialize(t, "finer")
    shared = t.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("long").alias("long")).filter("lo <> hi AND long").select("key")
    return t.join(shared.hint("merge"), "key")


def _within_one_edit(a: str, b: str) -> Column:
    """The edit distance is 0 or 1: measured, or, of long lines, told by what is equal before and after the first difference, which is sought by halves."""
    same = f"aggregate(transform(sequence(0, 30), k -> shiftleft(1, 30 - k)), 0, (x, w) -> if(x + cast(w as bigint) <= least(length({a}), length({b})) AND substring({a}, 1, x + w) = substring({b}, 1, x + w), x + w, x))"
    rest = f"""CASE length({a}) - length({b}) WHEN 0 THEN substring({a}, same + 2) = substring({b}, same + 2) WHEN 1 THEN substring({a}, same + 2) = substring({b}, same + 1)
               WHEN -1 THEN substring({a}, same + 1) = substring({b}, same + 2) ELSE false END"""
    return F.expr(f"CASE WHEN greatest(length({a}), length({b})) <= {MEASURED} THEN levenshtein({a}, {b}, 1) BETWEEN 0 AND 1 ELSE element_at(transform(array({same}), same -> {rest}), 1) END")


def near_lines(lines: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(h1, h2) of each line that has an earlier one at an edit distance of exactly one."""
    keys = _anchors(lines, segment).groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("long").alias("long"))
    keys = materialize(keys.filter("lo <> hi AND long").select("key"), "anchors")
    near = _sieved(_anchors(lines, segment), keys).groupBy("key", "h1", "h2").agg(F.min(_place()).alias("place"), F.any_value("line").alias("line"), F.any_value("seg").alias("seg"), F.any_value("long").alias("long"))
    near = materialize(near.join(keys.hint("merge"), "key"), "near")
    whole = near.groupBy("h1", "h2").agg(F.any_value("line").alias("line"))
    coarse = near = near.drop("line")
    # Both sides of an insertion are cut again, or neither.
    cut_again = F.expr(f"length(seg) + if(long, 0, 1) > {segment}")
    while not (coarse := coarse.filter(cut_again)).isEmpty():
        coarse = materialize(_finer(coarse, segment), "near")
        near = near.filter(~cut_again).unionByName(coarse)
    # kind 1: replacements; 2 and 3: the longer and the shorter line of an insertion.
    deleted = "concat(substring(seg, 1, i), substring(seg, i + 2))"
    variants = f"""explode(if(long,
        flatten(transform(sequence(0, length(seg) - 1), i -> array(
            named_struct('kind', 1, 'v', xxhash64(key, 1, i, {deleted})), named_struct('kind', 2, 'v', xxhash64(key, 2, {deleted}))))),
        array(named_struct('kind', 3, 'v', xxhash64(key, 2, seg)))))"""
    made = near.select(F.expr(variants).alias("x"), F.struct("place", "h1", "h2").alias("own")).select("x.v", "x.kind", "own")
    by_kind = [F.min(F.when(F.col("kind") == k, F.col("own"))).alias(f"first{k}") for k in (1, 2, 3)]
    firsts = made.groupBy("v").agg(*by_kind, F.count("*").alias("n")).filter("n > 1").drop("n")
    earlier = F.expr("CASE kind WHEN 1 THEN first1 WHEN 2 THEN first3 ELSE first2 END")
    pairs = made.join(firsts.hint("merge"), "v").withColumn("other", earlier).filter("other.place < own.place").select("own.h1", "own.h2", F.col("other.h1").alias("g1"), F.col("other.h2").alias("g2")).distinct()
    other = whole.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("other"))
    checked = pairs.join(whole.hint("merge"), ["h1", "h2"]).join(other.hint("merge"), ["g1", "g2"]).filter(_within_one_edit("line", "other"))
    return checked.select("h1", "h2").distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, segment: int = SEGMENT, exact: int = SHORTEST) -> DataFrame:
    """The rows of docs, the text without the lines that go, and `removed_lines`, their number (in place of a column of docs that is so named)."""
    lines = _lines(keyed(docs, id_col, text_col), shortest, exact)
    repeated = lines.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h1", "h2", "first")
    # All lines without a first go; a line that is both repeated and near has two marks.
    marks = materialize(repeated.unionByName(near_lines(lines.filter(F.col("n") >= shortest), segment), allowMissingColumns=True), "marks")
    gone = lines.select("h1", "h2", _place().alias("place")).join(marks.hint("shuffle_hash"), ["h1", "h2"]).filter("first IS NULL OR place <> first")
    gid, gth, pos = (fresh(docs, x) for x in ("gone_id", "gone_th", "gone_pos"))
    gone = materialize(gone.groupBy(F.col("place.id").alias(gid), F.col("place.th").alias(gth)).agg(F.collect_set("place.pos").alias(pos)), "gone")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.join(broadcast_if_small(gone.hint("shuffle_hash"), F.size(pos) * 4 + 200, SENT), docs[id_col].eqNullSafe(F.col(gid)) & (F.xxhash64(text) == F.col(gth)), "left")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(F.col(pos), i)), "\n")
    columns = [F.when(F.col(pos).isNotNull(), kept).otherwise(docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns if c.lower() != "removed_lines"]
    return out.select(*columns, F.when(F.col(pos).isNull(), F.lit(0)).otherwise(F.size(pos)).cast("bigint").alias("removed_lines"))
