"""A corpus from documents to packed training sequences; each stage works on all that the one before it kept.

For all stages: a null text counts as empty, an empty table gives an empty table, columns beyond those of documents stay as they are (but for the last stage, which
returns pieces), and rows are told apart by id and text, so repeated and null ids do no harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, ngram_join, packing, quality
from tessera.llm.common import materialize, shared_dir, without


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling doesn't draw go; rows equal in id and text go or stay together. Empty texts weigh 1."""
    scored = quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, scored.filter("NOT kept"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of any length that an earlier one equals, or longer ones nearly so, go; so do documents of which nothing is left. n_chars follows the text. Of equal
    lines that of the smallest id stays (null ids last), then the first in its text; a text without removed lines, null ones too, stays as it is."""
    done = line_dedup.line_dedup(docs, exact=1)
    done = done.filter((F.col("removed_lines") == 0) | (F.trim("text") != ""))
    return done.select(*[F.when(F.col("removed_lines") > 0, F.char_length("text").cast(kind)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c, kind in docs.dtypes])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, directly or through others, the one of the smallest id stays. Texts without a word are near no
    other; of rows equal in id and text one stays."""
    return ngram_join.near_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover half of a benchmark item's words or more go. Items without a word are held by none; without items all stay."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, materialize(found.filter("leaked").select("id", "th"), "leaked"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; an empty text is its end sign alone. Rows repeated with their id are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: Importance resampling, tokens and packing aren't SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents. Each one's result is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{top}/{k}")
        docs = spark.read.parquet(path)
    return docs
