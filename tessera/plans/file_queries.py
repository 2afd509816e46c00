"""Queries over files: documents saved to a folder of the shared space, listed, looked up and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as K
from ..sources import files
from ..sources.shared import scratch
from .queries import DOCS, add, table

# Where each document goes, in both dialects: containers, texts and pages in folders by source and language.
PLACE = "source || '/' || lang || '/doc ' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.smdoc' WHEN 1 THEN '.txt' ELSE '.html' END"


def placed(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, DOCS).select(F.col("doc_id").alias("ord"), F.expr(PLACE).alias("path"), F.col("text").alias("content"))


def library(s: SparkSession, d: str) -> str:
    """The documents as files below a new folder."""
    files.save_files(placed(s, d), top := scratch(s, "library"), preset=1)
    return top


def _inside(top: str, column: str = "path") -> Column:
    """A path without the folder in front."""
    start = files.opened(top)[1].rstrip("/") + "/"
    return F.when(F.startswith(column, F.lit(start)), F.expr(f"substring({column}, {len(start) + 1})")).otherwise(F.col(column))


def read_file(s: SparkSession, d: str) -> DataFrame:
    return files.read_files(s, library(s, d)).select("path", F.octet_length("content").alias("n_bytes"), F.md5("content").alias("digest"))


add("read_file", read_file, f"SELECT {PLACE} AS path, octet_length(encode(text)) AS n_bytes, md5(text) AS digest FROM documents")


def file_listing(s: SparkSession, d: str) -> DataFrame:
    found = files.listing(s, library(s, d), depth=2)
    return found.select("path", "name", "is_folder", F.when(~F.endswith("path", F.lit(".smdoc")), F.col("size")).alias("size"), (F.col("modified") > 0).alias("dated"))


LISTED = f"""p AS (SELECT {PLACE} AS path, text, doc_id FROM documents), u AS (SELECT path, true AS leaf FROM p UNION SELECT regexp_extract(path, '^(.*)/[^/]*$', 1), false FROM p UNION SELECT regexp_extract(path, '^([^/]*)/', 1), false FROM p)"""
add("file_listing", file_listing, f"""WITH {LISTED} SELECT u.path, regexp_extract(u.path, '[^/]*$') AS name, NOT leaf AS is_folder, CASE WHEN NOT leaf THEN 0 WHEN u.path NOT LIKE '%.smdoc' THEN octet_length(encode(text)) END AS size, leaf AS dated FROM u LEFT JOIN p ON p.path = u.path""")


def library_tree(s: SparkSession, d: str) -> DataFrame:
    return K.library_nodes(files.listing(s, library(s, d)))


add("library_tree", lambda s, d: library_tree(s, d).select("path", "parent", "name", "depth", "is_folder"), f"""WITH {LISTED} SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '[^/]*$') AS name, CAST(length(path) - length(replace(path, '/', '')) + 1 AS INTEGER) AS depth, NOT leaf AS is_folder FROM u""")
add("library_order", lambda s, d: K.library_order(library_tree(s, d)).select("path", "is_folder"), f"WITH {LISTED} SELECT path, NOT leaf AS is_folder FROM u")


def recent_item(s: SparkSession, d: str) -> DataFrame:
    """Recents of which two in three name files that are there, one in three of those in another spelling of its place."""
    top = library(s, d)
    own = F.lit(files.opened(top)[1].rstrip("/") + "/")
    docs = table(s, d, DOCS)
    recents = docs.select("doc_id", F.concat(own, F.expr(PLACE), F.when(F.col("doc_id") % 3 == 2, F.lit(".gone")).otherwise(F.lit(""))).alias("path"))
    recents = recents.unionByName(docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.expr(f"'/other/' || {PLACE}").alias("path")))
    found = files.with_files(recents, files.listing(s, top), files.opened(top)[1])
    return found.select("doc_id", "name", "exists", F.when(~F.endswith("path", F.lit(".smdoc")), F.col("size")).alias("size"), (F.col("modified") > 0).alias("dated"), "is_internal")


add("recent_item", recent_item, f"""WITH p AS (SELECT doc_id, {PLACE} AS path, text FROM documents)
    SELECT doc_id, regexp_extract(path, '[^/]*$') || CASE WHEN doc_id % 3 = 2 THEN '.gone' ELSE '' END AS name, doc_id % 3 <> 2 AS exists, CASE doc_id % 3 WHEN 2 THEN 0 WHEN 1 THEN octet_length(encode(text)) END AS size, doc_id % 3 <> 2 AS dated, true AS is_internal FROM p
    UNION ALL SELECT -doc_id - 1, regexp_extract(path, '[^/]*$'), false, CASE WHEN doc_id % 3 > 0 THEN 0 END, false, false FROM p""")


def save_file(s: SparkSession, d: str) -> DataFrame:
    """The recents after all documents have been saved: they come first, the last one before the others; a tenth of them was there before, with a time of opening."""
    top = scratch(s, "saved")
    start = F.lit(files.opened(top)[1].rstrip("/") + "/./")
    docs = placed(s, d)
    recents = docs.filter("ord % 10 = 0").select("ord", F.concat(start, "path").alias("path"), (F.col("ord") * 7).alias("last_accessed"), F.lit(5).cast("bigint").alias("last_saved"))
    recents = recents.unionByName(table(s, d, "customer").select((F.col("c_custkey") + 10_000_000).alias("ord"), F.concat(F.lit("/old/"), "c_name").alias("path"), F.lit(None).cast("bigint").alias("last_accessed"), F.lit(3).cast("bigint").alias("last_saved")))
    return files.save_and_note(docs, recents, top, 1000).select("ord", _inside(top).alias("path"), "last_accessed", "last_saved")


add("save_file", save_file, f"""SELECT -doc_id - 1 AS ord, {PLACE} AS path, CASE WHEN doc_id % 10 = 0 THEN doc_id * 7 ELSE 0 END AS last_accessed, 1000 AS last_saved FROM documents
    UNION ALL SELECT c_custkey + 10000000, '/old/' || c_name, NULL, 3 FROM customer""")
