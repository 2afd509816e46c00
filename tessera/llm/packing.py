"""Packing of token sequences: bounded-space online best fit.

Each input task keeps a fixed number of open windows. A document's tokens go, uncut, into the open window whose free space they
leave smallest; when none has room and no further window may be opened, the fullest is topped up with the head of the document
and emitted, and the rest is placed anew. What a document has beyond whole windows is all that needs a place. The windows still
open at the end of a task are merged into one, then those of up to 1024 tasks, then what is left of those, so that one
sequence of the whole result is padded.

Defined results. A null text counts as empty: its only token is the closing id. Rows that are repeated are packed as often as
they occur. An empty table gives an empty table. Ids are integers (or null). Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize
from .exact_dedup import ddl

WINDOW, OPEN, CLOSING = 2048, 64, 1
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("left", pa.int64()), ("ids", pa.binary())])
RESULT = PIECE.names[:7]

_encoders: dict[str, Callable[[str], np.ndarray]] = {}
#: Texts longer than this are encoded in parts, cut where no piece of the tokenizer's pattern and no added token runs across.
PART = 1 << 18
BREAK = re.compile(r"(?<=[A-Za-z0-9.,;])(?=[ \n])")
#: A run of this many characters with or without white space may be one piece of the pattern.
RUN = 20_000
BLANK_RUN = re.compile(r"\s{%d}" % RUN)


def long_run(text: str) -> bool:
    return max(map(len, text.split()), default=0) >= RUN or BLANK_RUN.search(text) is not None


def parts(text: str, size: int = PART) -> Iterator[str]:
    """text in parts of at least `size` characters each but the last; a part is longer where there is no place to cut."""
    start = 0
    while len(text) - start > size and (m := BREAK.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def _bytes_of(token: str) -> bytes:
    """The bytes of a token of a byte-level vocabulary, where printable Latin-1 stands for itself and the other bytes, in order, for U+0100 on."""
    return bytes(_BYTES[c] for c in token)


_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {chr(b): b for b in _PRINTABLE} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids, as the tokenizer of the JSON file at path gives them; strings of its added tokens become these.

    The file's vocabulary (whose ids are the ranks of its merges) is run by tiktoken, which gives the same ids several times faster; what holds a run too long for
    that goes to the tokenizer itself.
    """
    if path not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        ranks = {_bytes_of(token): i for token, i in slow.get_vocab(with_added_tokens=False).items() if all(c in _BYTES for c in token)}
        added = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
        for t in added:
            ranks.pop(t.encode(), None)
        fast = tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

        def encode(text: str) -> np.ndarray:
            if len(text) <= RUN:
                return np.array(fast.encode(text, allowed_special="all"), "<u4")
            return np.concatenate([np.array(slow.encode(p, add_special_tokens=False).ids if long_run(p) else fast.encode(p, allowed_special="all"), "<u4") for p in parts(text)])

        _encoders[path] = encode
    return _encoders[path]


class Packer:
    """Places documents into windows and hands out rows of PIECE as windows close."""

    def __init__(self, first_id: int, window: int = WINDOW, most_open: int = OPEN):
        self.window, self.most_open, self.next_id = window, most_open, first_id
        self.open: dict[int, list[tuple]] = {}
        #: (free, window), in order
        self.free: list[tuple[int, int]] = []
        self.rows: list[tuple] = []

    def _take(self, w: int, free: int, piece: tuple) -> None:
        """piece: (doc_id, start, ids, doc_tokens)."""
        self.open[w].append((*piece, self.window - free))
        if free == len(piece[2]):
            self._close(w)
        else:
            insort(self.free, (free - len(piece[2]), w))

    def _close(self, w: int) -> None:
        for doc, start, ids, total, offset in self.open.pop(w):
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, w, offset, None, None))

    def _new(self) -> int:
        self.next_id += 1
        self.open[self.next_id - 1] = []
        return self.next_id - 1

    def add(self, doc: int | None, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        total = len(ids) if total is None else total
        while len(ids) >= self.window:
            self._take(self._new(), self.window, (doc, start, ids[: self.window], total))
            ids, start = ids[self.window :], start + self.window
        while len(ids):
            k = bisect_left(self.free, (len(ids), -1))
            if k < len(self.free):
                free, w = self.free.pop(k)
            elif len(self.free) < self.most_open:
                free, w = self.window, self._new()
            else:
                free, w = self.free.pop(0)
            self._take(w, free, (doc, start, ids[:free], total))
            ids, start = ids[free:], start + free

    def merge(self) -> None:
        """Fill the open windows from each other, so that one at most is left."""
        held = [p[:4] for _, w in self.free for p in self.open[w]]
        self.open, self.free, self.most_open = {}, [], 1
        for doc, start, ids, total in held:
            self.add(doc, ids, start, total)

    def rest(self, left: int | None) -> None:
        """Hand out what is still open: to be merged under the number left, or finished if that is None."""
        for _, w in self.free:
            if left is None:
                self._close(w)
            else:
                self.rows += [(doc, start, len(ids), 0, total, w, offset, left, ids.tobytes()) for doc, start, ids, total, offset in self.open.pop(w)]
        self.free = []

    def taken(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(PIECE)], schema=PIECE)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, window: int = WINDOW, most_open: int = OPEN, closing: int = CLOSING, fan_in: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path), TaskContext.get().partitionId()
        packer = Packer(task << 32, window, most_open)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc, np.append(encode(text), np.array([closing], "<u4")))
            yield _batch(packer.taken())
        packer.merge()
        packer.rest(task)
        yield _batch(packer.taken())

    def gather(first_id: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def f(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            packer = Packer(first_id + (int(key[0]) << 32), window, 1)
            for r in part.sort_values(["left", "sequence_id", "offset"]).itertuples(index=False):
                packer.add(None if pd.isna(r.doc_id) else int(r.doc_id), np.frombuffer(r.ids, "<u4"), int(r.start), int(r.doc_tokens))
            packer.rest(None if last else int(key[0]))
            return _batch(packer.taken()).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

        return f

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    placed = materialize(arrow_map(rows, place, ddl(PIECE)), "packed")
    some = placed.filter("left IS NOT NULL").groupBy((F.col("left") / fan_in).cast("bigint").alias("g")).applyInPandas(gather(1 << 61, False), ddl(PIECE))
    some = materialize(some, "merged")
    last = some.filter("left IS NOT NULL").groupBy(F.lit(0).alias("g")).applyInPandas(gather(1 << 62, True), ddl(PIECE))
    return placed.filter("left IS NULL").unionByName(some.filter("left IS NULL")).unionByName(last).select(*RESULT)
