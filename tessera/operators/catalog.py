"""Lists of files and texts: search, recents, library, lookups by id, first and last of equals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rank = 1").drop("_rank")


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last in order: as an aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    found = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return found.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def lookup(rows: DataFrame, table: DataFrame, key: str, order: str) -> DataFrame:
    """rows with what the table has for their key; of repeated keys in the table the last counts."""
    return rows.join(last_wins(table, [key], order), key, "left")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in place of, or added to, those of equal key."""
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in old.columns if c != key])


def search(catalog: DataFrame, query: str) -> DataFrame:
    """Entries (filename, title, romanized) in which every word of the query occurs."""
    return catalog.filter(T.matches_query(F.concat_ws(" ", "title", "romanized", "filename"), query))


def union_categories(catalog: DataFrame, most: int = 50) -> DataFrame:
    """The first `most` different entries over all categories, by category and position."""
    return first_wins(catalog, ["category", "filename"], ["pos"]).orderBy("category", "pos").limit(most)


def _seen() -> Column:
    return F.greatest(F.coalesce("last_saved", F.lit(0)), F.coalesce("last_accessed", F.lit(0)))


def recents_rank(recents: DataFrame, *owner: str) -> DataFrame:
    """recents with rank in the list of each owner: by the later of the two times, the earlier in the list first among equals."""
    return recents.withColumn("seen", _seen()).withColumn("rank", F.row_number().over(Window.partitionBy(*owner).orderBy(F.desc("seen"), "ord")))


def recents_topk(recents: DataFrame, most: int = 20) -> DataFrame:
    return recents.withColumn("seen", _seen()).orderBy(F.desc("seen"), "ord").limit(most)


def recents_search(recents: DataFrame, query: str, current: str | None = None) -> DataFrame:
    """Entries whose name, folder or path holds the query in either case, without the open one."""
    hay = F.lower(F.concat_ws(" ", T.basename(F.col("path")), T.dirname(F.col("path")), F.col("path")))
    found = recents.filter(F.contains(hay, F.lit(query.lower().strip())))
    return found if current is None else found.filter(T.norm_path(F.col("path")) != T.norm_path(F.lit(current)))


def recents_clean(recents: DataFrame) -> DataFrame:
    """Entries with a path, missing times being 0."""
    return recents.filter(F.trim(F.coalesce("path", F.lit(""))) != "").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("last_accessed", "last_saved")})


def recents_remove(recents: DataFrame, gone: DataFrame) -> DataFrame:
    """recents without the paths of `gone`, compared in normal form."""
    paths = gone.select(T.norm_path(F.col("path")).alias("_gone")).distinct()
    return recents.join(paths, T.norm_path(F.col("path")) == F.col("_gone"), "left_anti")


def post_filter(items: DataFrame) -> DataFrame:
    """Search results that have an address (url or link); without a kind they are posts."""
    address = F.coalesce(F.nullif("url", F.lit("")), F.nullif("link", F.lit("")))
    return items.filter(address.isNotNull()).withColumn("url", address).withColumn("subtype", F.coalesce(F.nullif("subtype", F.lit("")), F.lit("post")))


def media_sort(files: DataFrame, modified: str, name: str) -> DataFrame:
    """The newest first."""
    return files.orderBy(F.desc(modified), name)


def preview(items: Column, most: int = 3) -> Column:
    """The first few of a list, and how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), "|"), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(F.lit("")))


def recents_upsert(recents: DataFrame, path: str, event: str, now: int, most: int | None = 50) -> DataFrame:
    """(ord, path, last_accessed, last_saved): the list with a path moved to its head; opening and saving each set their own time, importing none.

    Paths are compared and the new one is stored in normal form (T.path_form: no empty, "." or ".." parts), with their case: entries that differ in case
    are two. Without `most` the rows come in no order, ord telling theirs, and nothing is sorted.
    """
    mine = T.path_form(F.col("path")) == T.path_form(F.lit(path))
    # The first entry of the path, as it is found from the head; an empty list gives none.
    old = recents.filter(mine).agg(F.min_by(F.struct("last_accessed", "last_saved"), "ord").alias("o"))
    stamp = lambda kind, column: F.lit(now).cast("bigint") if event == kind else F.coalesce(F.col(column), F.lit(0)).cast("bigint")
    head = old.select(F.lit(-1).cast("bigint").alias("ord"), T.path_form(F.lit(path)).alias("path"), stamp("open", "o.last_accessed").alias("last_accessed"), stamp("save", "o.last_saved").alias("last_saved"))
    out = head.unionByName(recents.filter(~mine).select(F.col("ord").cast("bigint").alias("ord"), "path", "last_accessed", "last_saved"))
    return out if most is None else out.orderBy("ord").limit(most)


def recents_apply(recents: DataFrame, events: DataFrame) -> DataFrame:
    """recents (ord, path, last_accessed, last_saved) after many events (path, event, at, seq), as if each had been put in by recents_upsert() in the order of seq: the path of the
    last event comes first, and each time is that of the path's last event of its kind, else what the first entry of the path had. One aggregate by path; nothing is sorted as a whole."""
    form = T.path_form(F.col("path"))
    last = lambda kind: F.max_by(F.when(F.col("event") == kind, F.col("at")), F.when(F.col("event") == kind, F.col("seq")))
    new = events.groupBy(form.alias("_form")).agg(F.max("seq").alias("_seq"), last("open").alias("_open"), last("save").alias("_save"))
    old = recents.withColumn("_form", form)
    firsts = old.groupBy("_form").agg(F.min_by(F.struct("last_accessed", "last_saved"), "ord").alias("_o"))
    time = lambda now, before: F.coalesce(now, F.col(f"_o.{before}"), F.lit(0)).cast("bigint").alias(before)
    heads = new.join(firsts, "_form", "left").select((-F.col("_seq") - 1).cast("bigint").alias("ord"), F.col("_form").alias("path"), time(F.col("_open"), "last_accessed"), time(F.col("_save"), "last_saved"))
    return heads.unionByName(old.join(new.select("_form"), "_form", "left_anti").select(F.col("ord").cast("bigint").alias("ord"), "path", "last_accessed", "last_saved"))


def library_order(nodes: DataFrame) -> DataFrame:
    """Folders first, then by name in either case."""
    return nodes.orderBy(F.desc("is_folder"), F.lower("name"), "path")


def library_tree(files: DataFrame) -> DataFrame:
    """(path, parent, name, depth, is_folder): the files and every folder above them, from a table of paths."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    up = files.select(parts.alias("parts")).select(F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"), "parts")
    path = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    return up.select(path(F.col("depth")).alias("path"), path(F.col("depth") - 1).alias("parent"), F.get("parts", F.col("depth") - 1).alias("name"), "depth", (F.col("depth") < F.size("parts")).alias("is_folder")).distinct()


def library_nodes(listing: DataFrame) -> DataFrame:
    """listing (path, name, is_folder, ...) with parent and depth: the tree of a folder as its files and folders lie there, empty ones included."""
    parts = F.split("path", "/")
    return listing.withColumn("parent", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).withColumn("depth", F.size(parts))


def dedup_filename(rows: DataFrame, name: str, order: str) -> DataFrame:
    """rows with unique_name: _1, _2, ... put before the extension of repeated names."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    base, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.[^.]*$", 0)
    return rows.withColumn("_k", k).withColumn("unique_name", F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat(base, F.lit("_"), F.col("_k").cast("string"), ext))).drop("_k")


def region_target(regions: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """regions with what their target has."""
    ord_ = targets.withColumnRenamed("ord", "target_index")
    return regions.join(ord_, [key, "target_index"], "left")


def remove_selected(regions: DataFrame, selected: DataFrame) -> DataFrame:
    """regions without those whose id is selected."""
    return regions.join(selected.select("id").distinct(), "id", "left_anti")


def uniform_confidence(targets: DataFrame, regions: DataFrame, key: str, confidence: float = 0.52) -> DataFrame:
    """targets with status, and one confidence for all that have a region."""
    has = regions.select(key, F.col("target_index").alias("ord")).distinct().withColumn("confidence", F.lit(confidence))
    return targets.join(has, [key, "ord"], "left").withColumn("status", F.when(F.col("confidence").isNull(), F.lit("unmatched")).otherwise(F.lit("matched")))


def next_unassigned(targets: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """(key, ord): the first target without a region."""
    free = targets.join(regions, (targets[key] == regions[key]) & (targets["ord"] == regions["target_index"]), "left_anti")
    return free.groupBy(key).agg(F.min("ord").alias("ord"))


def with_region(targets: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    return targets.join(regions, (targets[key] == regions[key]) & (targets["ord"] == regions["target_index"]), "left_semi")


def remove_target(regions: DataFrame, removed: int) -> DataFrame:
    """Regions after a target is gone: its own lose it, those of later targets move up."""
    t = F.col("target_index")
    return regions.withColumn("target_index", F.when(t == removed, None).when(t > removed, t - 1).otherwise(t))


def style_filter(paragraphs: DataFrame, enabled: list[str], column: str = "style") -> DataFrame:
    return paragraphs.filter(F.col(column).isin(*enabled))


def svara_plan(plan: Column) -> Column:
    """(pos, mark) of a plan such as 2, svarita, 4, svarita, by position from 1; the last mark of a position counts."""
    pattern = "([0-9]+)([\\x{331}\\x{30d}\\x{30e}\\x{2ce}·])"
    both = F.arrays_zip(F.transform(F.regexp_extract_all(plan, F.lit(pattern), 1), lambda p: p.cast("int")).alias("pos"), F.regexp_extract_all(plan, F.lit(pattern), 2).alias("mark"))
    last = lambda b: F.filter(b, lambda e, i: (e["pos"] > 0) & ~F.exists(F.slice(b, i + 2, F.size(b)), lambda later: later["pos"] == e["pos"]))
    # The list is bound by a lambda, so that it is made once.
    return F.get(F.transform(F.array(both), lambda b: F.array_sort(last(b))), F.lit(0))


# Metres, as syllables of the two halves and the plan of marks.
METRES = {
    "anustubh": (16, 16, "2\u030d4\u030d6\u03318\u030d9\u033111\u033114\u030d"),
    "gayatri": (8, 8, "2\u030d4\u030d6\u03318\u030d"),
    "tristubh": (11, 11, "2\u030d4\u030d6\u03318\u030d9\u033111\u030d"),
    "jagati": (12, 12, "2\u030d4\u030d6\u03318\u030d9\u033111\u030d12\u0331"),
}
# Steps of the time line, in seconds.
TIMELINE_STEPS = (0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 15.0, 30.0, 60.0, 120.0, 300.0, 600.0)


def timeline_step(least: Column) -> Column:
    """The first step that is long enough; the longest if none is."""
    return F.coalesce(F.get(F.filter(F.array(*[F.lit(s) for s in TIMELINE_STEPS]), lambda s: s >= least), F.lit(0)), F.lit(TIMELINE_STEPS[-1]))
