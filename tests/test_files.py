"""Documents as files: written whole or not at all, listed, read back."""

from __future__ import annotations

import os
import time

import pytest

from tessera.operators import catalog as K
from tessera.sources import files

SCHEMA = "path string, content string"


def below(top):
    return sorted(os.path.relpath(os.path.join(d, f), top) for d, _, names in os.walk(top) for f in names)


def test_saved_and_read(spark, tmp_path):
    rows = [("a/b/x.smdoc", "text " * 1000), ("a/y.txt", "é🙂\n"), ("z.SMDOC", ""), ("n.json", None)] + [(f"m/{k % 7}/{k}.txt", str(k)) for k in range(200)]
    for top in (f"{tmp_path}/one", f"file://{tmp_path}/two"):
        files.save_files(spark.createDataFrame(rows, SCHEMA).repartition(5), top)
        assert below(files.opened(top)[1]) == sorted(p for p, _ in rows)
        assert sorted(map(tuple, files.read_files(spark, top).collect())) == sorted((p, t or "") for p, t in rows)
    assert (tmp_path / "one/a/b/x.smdoc").read_bytes()[:4] == b"SMDI"


def test_reading_leaves_no_files_with_the_driver(spark, tmp_path):
    """Spark's own reader holds an entry for each file in the driver, and made a task of at most some tens of them."""
    rows = [(f"s{k % 3}/l{k % 2}/doc {k}.txt", f"é {k}") for k in range(1500)]
    files.save_files(spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path))
    read = files.read_files(spark, str(tmp_path))
    assert read.inputFiles() == [] and read.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, read.collect())) == sorted(rows)


def test_reading_in_parts(spark, tmp_path, monkeypatch):
    """Names of all kinds, deep and at the top; texts passed on by some characters at a time; bytes as they are."""
    monkeypatch.setattr(files, "READ_AT_ONCE", 7)
    rows = [("x.gz", "not packed"), ("a/b/c/d/e 100%.txt", "deep"), ("a/[b]*?{c}.html", "signs"), ("a/é🙂.smdoc", "z" * 50), ("e.bz2", ""), ("a/k=v.txt", "k")] + [(f"f/{k}", "12345"[: k % 6]) for k in range(40)]
    files.save_files(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "top"))
    (tmp_path / "top/a/_hidden.txt").write_text("no")
    (tmp_path / "top/empty").mkdir()
    for top in (str(tmp_path / "top"), f"{tmp_path}/top/", f"file://{tmp_path}/top"):
        assert sorted(map(tuple, files.read_files(spark, top).collect())) == sorted(rows)
    assert files.read_files(spark, str(tmp_path / "top/empty")).collect() == []
    with pytest.raises(FileNotFoundError):
        files.read_files(spark, str(tmp_path / "none"))


def test_saving_again_puts_new_for_old(spark, tmp_path):
    for k in range(2):
        files.save_files(spark.createDataFrame([("a.txt", f"v{k}"), (f"only{k}.txt", "x")], SCHEMA), str(tmp_path))
    assert below(tmp_path) == ["a.txt", "only0.txt", "only1.txt"]
    assert (tmp_path / "a.txt").read_text() == "v1"
    files.save_files(spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert len(below(tmp_path)) == 3


@pytest.mark.parametrize("bad", ["../out.txt", "a/../../b", "", "_hidden/x", "//"])
def test_a_failing_task_leaves_nothing(spark, tmp_path, bad):
    (tmp_path / "old.txt").write_text("old")
    rows = [(f"{k}.txt", "x") for k in range(50)] + [("old.txt", "new"), (bad, "y")]
    with pytest.raises(Exception, match="not a path"):
        files.save_files(spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path))
    for _ in range(100):  # a task that was stopped may be at its last file
        if os.listdir(tmp_path) == ["old.txt"]:
            break
        time.sleep(0.1)
    assert below(tmp_path) == ["old.txt"] and os.listdir(tmp_path) == ["old.txt"]
    assert (tmp_path / "old.txt").read_text() == "old"


def test_a_lost_run_is_taken_up(spark, tmp_path, monkeypatch):
    """The manifest is there and a part of the files has moved when the run is lost."""
    top, rows = str(tmp_path), [(f"d{k % 3}/{k}.txt", str(k)) for k in range(30)]
    monkeypatch.setattr(files, "publish", lambda *a: None)
    files.save_files(spark.createDataFrame(rows, SCHEMA).repartition(3), top)
    monkeypatch.undo()
    (name,) = files.unfinished(top)
    assert files.listing(spark, top).count() == 0
    own = sorted((tmp_path / name).glob("*/list"))[0].parent
    os.makedirs(tmp_path / "d0", exist_ok=True)
    first = next(p for p in sorted(own.iterdir()) if p.name == "0")
    target = next(line.split('"')[3] for line in (own / "list").read_text().splitlines() if line.startswith('["0"'))
    os.makedirs((tmp_path / target).parent, exist_ok=True)
    first.rename(tmp_path / target)
    files.publish(spark, top, name)
    assert files.unfinished(top) == [] and sorted(map(tuple, files.read_files(spark, top).collect())) == sorted(rows)


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_listing(spark, tmp_path, depth):
    for p in ("a/b/c/1.txt", "a/b/2.txt", "a/3.txt", "4.txt", "_x/5.txt", "a/.h/6.txt", "a/_7.txt", "e/f/8.txt"):
        os.makedirs((tmp_path / p).parent, exist_ok=True)
        (tmp_path / p).write_text(p)
    os.makedirs(tmp_path / "empty")
    got = {r.path: r for r in files.listing(spark, str(tmp_path), depth).collect()}
    assert {p for p, r in got.items() if r.is_folder} == {"a", "a/b", "a/b/c", "e", "e/f", "empty"}
    assert {p: r.size for p, r in got.items() if not r.is_folder} == {p: len(p) for p in ("a/b/c/1.txt", "a/b/2.txt", "a/3.txt", "4.txt", "e/f/8.txt")}
    assert all(abs(r.modified - os.stat(tmp_path / p).st_mtime) < 1e-3 and r.name == p.split("/")[-1] for p, r in got.items() if not r.is_folder)
    assert files.listing(spark, str(tmp_path / "none"), depth).count() == 0


def test_recents_with_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("12345")
    recents = spark.createDataFrame([(f"{tmp_path}/a.txt",), (f"{tmp_path}/gone.txt",), ("/elsewhere/a.txt",)], "path string")
    got = {r.path: r for r in files.with_files(recents, files.listing(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert [(r.exists, r.size, r.modified > 0, r.is_internal, r.name) for r in (got[f"{tmp_path}/a.txt"], got[f"{tmp_path}/gone.txt"], got["/elsewhere/a.txt"])] == [(True, 5, True, True, "a.txt"), (False, 0, False, True, "gone.txt"), (False, 0, False, False, "a.txt")]


def test_many_events_are_as_one_after_the_other(spark):
    old = [(0, "/a", 1, 2), (1, "/b/../b", 3, None), (2, "/c", None, 4), (3, "/b", 9, 9)]
    events = [("/c", "open", 10, 0), ("/x", "import", 11, 1), ("/b", "save", 12, 2), ("/./c", "save", 13, 3), ("/b", "open", 14, 4), ("/A", "open", 15, 5)]
    schema = "ord bigint, path string, last_accessed bigint, last_saved bigint"
    now = spark.createDataFrame(old, schema)
    for path, event, at, _ in events:
        step = K.recents_upsert(now, path, event, at).collect()
        now = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(step)], schema)
    got = K.recents_apply(spark.createDataFrame(old, schema), spark.createDataFrame(events, "path string, event string, at bigint, seq bigint")).orderBy("ord")
    assert [tuple(r)[1:] for r in got.collect()] == [tuple(r)[1:] for r in now.orderBy("ord").collect()]
