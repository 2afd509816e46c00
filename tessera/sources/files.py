"""Folders of documents: a file for each row as a sink, the listing of a folder as a source.

A save has two steps. Tasks write each file under a temporary name and note it in a list of their own; once all are done the driver puts one manifest in place, which names
the lists (a line per task, not per file). Then the files are moved to their names, again in tasks. A task that fails before the manifest is there leaves
nothing behind; after it, publish() goes on where a lost run stopped, as a file that has moved is left alone. Paths may be of any file system that pyarrow opens.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators import catalog
from . import container

LISTING = "path string, name string, is_folder boolean, size bigint, modified double"
#: Folders of a save in progress; like other names with an underscore in front they aren't listed.
SAVING, MANIFEST = "_saving-", "manifest.json"
#: Characters of text that a reading task holds before it passes them on, and the file beyond.
READ_AT_ONCE = 1 << 22


def opened(top: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    if "://" in top or top.startswith("file:"):
        return pafs.FileSystem.from_uri(top if "://" in top else f"file://{top.removeprefix('file:')}")
    return pafs.LocalFileSystem(), top


def inside(path: str) -> str:
    """A path below a folder, without what leads out of it."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if not parts or ".." in parts or parts[0].startswith("_"):
        raise ValueError(f"not a path of a file below the folder: {path!r}")
    return "/".join(parts)


def _write(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    with fs.open_output_stream(path) as f:
        f.write(data)


def cleared(top: str, name: str) -> None:
    """Remove a folder, again if tasks that are being stopped write to it meanwhile."""
    fs, base = opened(top)
    for _ in range(50):
        try:
            if fs.get_file_info(f"{base}/{name}").type != pafs.FileType.Directory:
                return
            fs.delete_dir(f"{base}/{name}")
        except OSError:
            time.sleep(0.1)


@dataclass
class Written(WriterCommitMessage):
    list: str
    n: int


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, top: str, name: str, preset: int):
        self.top, self.name, self.preset = top, name, preset

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, top = opened(self.top)
        own, n = f"{top}/{self.name}/{uuid.uuid4().hex}", 0
        # Not with its parents: once a failed save is cleared away, a task that still runs finds no place to write.
        fs.create_dir(own, recursive=False)
        try:
            with fs.open_output_stream(f"{own}/list") as names:
                for batch in batches:
                    for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                        path, text = inside(path), text or ""
                        sealed = path.lower().endswith(container.EXTENSION)
                        _write(fs, f"{own}/{n}", container.sealed(text, self.preset) if sealed else text.encode())
                        names.write(json.dumps([f"{n}", path]).encode() + b"\n")
                        n += 1
        except BaseException:
            cleared(self.top, own[len(top) + 1 :])
            raise
        return Written(own[len(top) + 1 :], n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = opened(self.top)
        body = "".join(json.dumps([m.list, m.n]) + "\n" for m in messages if m)
        _write(fs, f"{top}/{self.name}/manifest.new", body.encode())
        fs.move(f"{top}/{self.name}/manifest.new", f"{top}/{self.name}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        cleared(self.top, self.name)


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool


class ListingReader(DataSourceReader):
    """Planned by folder: the driver looks at the folders down to `depth` alone; each is listed by a task of its own."""

    def __init__(self, top: str, depth: int):
        self.top, self.depth = top, depth

    def partitions(self) -> list[Folder]:
        fs, top = opened(self.top)
        base, level, plan = top.rstrip("/"), [""], []
        for _ in range(self.depth):
            plan += [Folder(p, False) for p in level]
            below = [x for p in level for x in fs.get_file_info(pafs.FileSelector(f"{base}/{p}" if p else base, allow_not_found=True)) if x.type == pafs.FileType.Directory and shown(x.base_name)]
            level = [x.path[len(base) + 1 :] for x in below]
        return plan + [Folder(p, True) for p in level]

    def read(self, folder: Folder) -> Iterator[pa.RecordBatch]:
        fs, top = opened(self.top)
        base = top.rstrip("/")
        found = fs.get_file_info(pafs.FileSelector(f"{base}/{folder.path}" if folder.path else base, recursive=folder.deep, allow_not_found=True))
        for k in range(0, len(found), 10_000):
            rows = [(x.path[len(base) + 1 :], x.base_name, x.type == pafs.FileType.Directory, x.size or 0, x.mtime.timestamp() if x.mtime else 0.0) for x in found[k : k + 10_000]]
            rows = [r if not r[2] else (*r[:3], 0, 0.0) for r in rows if all(map(shown, r[0].split("/")))]
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=[c.split(" ")[0] for c in LISTING.split(", ")])


def shown(name: str) -> bool:
    return not name.startswith(("_", "."))


class DocumentFiles(DataSource):
    """format("document_files"), option path. Written: rows (path, content), each to a file of its own, those of the document format as containers.
    Read: (path, name, is_folder, size, modified) of all that lies below, names with _ or . in front left out; folders have no size and time."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(self.options["path"], int(self.options.get("depth", "1")))

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], self.options["name"], int(self.options.get("preset", "6")))


def listing(spark: SparkSession, top: str, depth: int = 1) -> DataFrame:
    """What lies below a folder, as rows of LISTING; nothing where it doesn't exist. depth: how many levels of folders the driver looks at to deal the rest out."""
    spark.dataSource.register(DocumentFiles)
    return spark.read.format("document_files").option("depth", depth).load(top)


def publish(spark: SparkSession, top: str, name: str) -> None:
    """Move the files of a save whose manifest is there to their names, in the place of older ones. May run again after a loss; the save's folder goes last."""
    lists = spark.read.text(f"{top}/{name}/{MANIFEST}").select(F.from_json("value", "array<string>")[0].alias("list")).repartition(max(1, spark.sparkContext.defaultParallelism))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(top)
        for batch in batches:
            n = 0
            for own in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{own}/list") as f:
                    for line in f.read().decode().splitlines():
                        temporary, path = json.loads(line)
                        if fs.get_file_info(f"{base}/{own}/{temporary}").type == pafs.FileType.File:
                            fs.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                            fs.move(f"{base}/{own}/{temporary}", f"{base}/{path}")
                            n += 1
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    lists.mapInArrow(move, "n bigint").agg(F.sum("n")).collect()
    cleared(top, name)


def unfinished(top: str) -> list[str]:
    """The saves below a folder that have a manifest and aren't published yet."""
    fs, base = opened(top)
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return sorted(x.base_name for x in found if x.base_name.startswith(SAVING) and fs.get_file_info(f"{x.path}/{MANIFEST}").type == pafs.FileType.File)


def save_files(documents: DataFrame, top: str, path: str = "path", content: str = "content", preset: int = 6) -> None:
    """Write each row's content to a file of its own below a folder; a null content is empty, a path that leads out of the folder an error. Rows of one path: any one of them stays.
    preset: the effort of compression, up to 9 (which takes 700 MB a task)."""
    spark = documents.sparkSession
    spark.dataSource.register(DocumentFiles)
    name = f"{SAVING}{uuid.uuid4().hex}"
    rows = documents.select(F.col(path).alias("path"), F.col(content).cast("string").alias("content"))
    fs, base = opened(top)
    fs.create_dir(f"{base}/{name}", recursive=True)
    rows.write.format("document_files").mode("append").option("name", name).option("preset", preset).save(top)
    publish(spark, top, name)


def read_files(spark: SparkSession, top: str) -> DataFrame:
    """(path, content) of all files below a folder, containers opened; paths are relative, names with _ or . in front are left out.
    Tasks list the folders and tasks read the files, dealt out evenly by number: Spark's own reader would hold an entry for each file in the driver."""
    fs, base = opened(top)
    if fs.get_file_info(base).type == pafs.FileType.NotFound:
        raise FileNotFoundError(top)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = listing(spark, top, depth=2).filter("NOT is_folder").select("path").repartition(tasks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(top)
        base = base.rstrip("/")
        for batch in batches:
            rows, size = [], 0
            for path in batch.column(0).to_pylist():
                # The bytes as they are, whatever the name ends in.
                with fs.open_input_stream(f"{base}/{path}", compression=None) as f:
                    rows.append((path, container.opened(f.read())))
                size += len(rows[-1][1])
                if size >= READ_AT_ONCE:
                    yield _texts(rows)
                    rows, size = [], 0
            yield _texts(rows)

    return names.mapInArrow(read, "path string, content string")


def _texts(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in (0, 1)], names=["path", "content"])


def with_files(recents: DataFrame, files: DataFrame, library: str) -> DataFrame:
    """recents (path, ...) with name, dir, exists, size, modified and is_internal: files is a listing of the folder `library`, from which paths of recents that lie in it are told."""
    top = library.rstrip("/")
    have = files.filter("NOT is_folder").select(F.concat(F.lit(f"{top}/"), "path").alias("path"), "size", "modified", F.lit(True).alias("exists"))
    out = recents.join(have, "path", "left")
    return out.withColumns({
        "exists": F.coalesce("exists", F.lit(False)), "size": F.coalesce("size", F.lit(0)), "modified": F.coalesce("modified", F.lit(0.0)), "is_internal": F.startswith(F.lower("path"), F.lit(f"{top}/".lower())),
        "name": F.substring_index("path", "/", -1), "dir": F.regexp_replace("path", "/[^/]*$", ""),
    })


def save_and_note(documents: DataFrame, recents: DataFrame, top: str, now: int) -> DataFrame:
    """save_files(), and the recents after it: each path written at the head, saved now."""
    save_files(documents, top)
    events = documents.select(F.concat(F.lit(f"{opened(top)[1].rstrip('/')}/"), "path").alias("path"), F.lit("save").alias("event"), F.lit(now).cast("bigint").alias("at"), F.col("ord").cast("bigint").alias("seq"))
    return catalog.recents_apply(recents, events)
