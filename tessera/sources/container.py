"""Document containers: a four-byte mark, then LZMA or zlib data; anything else is plain UTF-8."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The marks.
LZMA_MARK, ZLIB_MARK = b"SMDI", b"SMDC"
EXTENSION = ".smdoc"
# Fixed values of LZMA: the dictionary of each preset as a power of two, and the smallest one.
DICTIONARIES, LEAST_DICTIONARY = (18, 20, 21, 22, 22, 23, 23, 24, 25, 26), 4096


def opened(data: bytes) -> str:
    if data[:4] == LZMA_MARK:
        return lzma.decompress(data[4:]).decode()
    return (zlib.decompress(data[4:]) if data[:4] == ZLIB_MARK else data).decode()


def sealed(text: str, preset: int = 9 | lzma.PRESET_EXTREME) -> bytes:
    """The dictionary is no larger than the text, beyond which no match reaches: the preset's own would take up to 64 MB of fresh memory, and 60 ms, for each text."""
    data = text.encode()
    own = 1 << DICTIONARIES[preset & ~lzma.PRESET_EXTREME]
    return LZMA_MARK + lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": preset, "dict_size": min(own, max(LEAST_DICTIONARY, len(data)))}])


def _each(kind: str, one: Callable, column: Column | str, once: bool = False) -> Column:
    """Spark works out such a column for every row, also within a branch of a condition: what isn't wanted must be null on the way in.
    once: it isn't worked out again for each column made of it."""

    def f(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else one(v))

    f.__annotations__ = {"values": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(f, kind)
    return (udf.asNondeterministic() if once else udf)(column)


def decompress(data: Column | str) -> Column:
    return _each("string", opened, data)


def compress(text: Column | str) -> Column:
    return _each("binary", sealed, text, once=True)


def compress_zlib(text: Column | str) -> Column:
    """The older kind of container."""
    return _each("binary", lambda t: ZLIB_MARK + zlib.compress(t.encode()), text)


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """(path, json) of the documents under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{smdoc,SMDOC}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", decompress("content").alias("json"))
