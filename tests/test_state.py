"""Stores that lose nothing, streams with late arrivals and restarts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from tessera.sources.keyvalue import KeyValue, with_defaults
from tessera.streaming import running as R

CHANGES = "seq bigint, op string, key string, value string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def now(store):
    return {r.key: r.value for r in store.state().collect()}


def test_put_get_delete_clear(spark, tmp_path):
    store = KeyValue(spark, str(tmp_path / "s"))
    assert now(store) == {} and store.compact() is None
    store.put("theme", "dark")
    store.put("size", None)
    store.put("theme", "light")
    assert now(store) == {"theme": "light", "size": None}
    store.compact()
    store.delete("size")
    assert now(KeyValue(spark, str(tmp_path / "s"))) == {"theme": "light"}
    store.compact()
    store.clear()
    assert now(store) == {}
    store.compact()
    store.put("a", "1")
    assert [tuple(r) for r in store.get("a", "theme").collect()] == [("a", "1")]


def test_a_random_log_in_any_parts(spark, tmp_path):
    rng, want, rows = random.Random(3), {}, []
    for seq in range(300):
        op = rng.choices(("put", "delete", "clear"), (10, 3, 0.3))[0]
        key, value = rng.choice("abcdefg"), rng.choice(("x", None, f"v{seq}"))
        rows.append((seq, op, key, value))
        if op == "put":
            want[key] = value
        elif op == "delete":
            want.pop(key, None)
        else:
            want.clear()
    store, at = KeyValue(spark, str(tmp_path / "r")), 0
    while at < len(rows):
        n = rng.randint(20, 90)
        store.append(spark.createDataFrame(rows[at : at + n], CHANGES))
        at += n
        if rng.random() < 0.5:
            store.compact()
    assert now(store) == want


def test_a_crash_before_the_swap_loses_nothing(spark, tmp_path, monkeypatch):
    store = KeyValue(spark, str(tmp_path / "c"))
    store.put("a", "1")
    store.compact()
    store.put("b", "2")
    with monkeypatch.context() as m:
        m.setattr(KeyValue, "_swap", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            store.compact()
    assert now(KeyValue(spark, str(tmp_path / "c"))) == {"a": "1", "b": "2"}
    with monkeypatch.context() as m:
        m.setattr(KeyValue, "_move", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            store.put("c", "3")
    assert now(store) == {"a": "1", "b": "2"}
    store.compact()
    assert now(store) == {"a": "1", "b": "2"}
    assert len([p for p in (tmp_path / "c").iterdir() if p.name.startswith("manifest-")]) == 1


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    store = KeyValue(spark, str(tmp_path / "b"))
    rows = spark.createDataFrame([(START, 1, "k", "x"), (START, 2, "k", "y"), (START - timedelta(days=9), 3, "k", "old")], "ts timestamp, seq bigint, key string, payload string")
    take = R.latest(rows, "key", store)
    for number in (0, 1, 1):
        take(rows, number)
    assert now(store) == {"k": "y"} and len(list((tmp_path / "b").glob("log-*"))) == 2


def test_defaults(spark):
    state = spark.createDataFrame([("a", "1"), ("b", None)], "key string, value string")
    defaults = spark.createDataFrame([("b", "x"), ("c", "y")], "key string, value string")
    assert sorted(map(tuple, with_defaults(state, defaults).collect())) == [("a", "1", True), ("b", None, True), ("c", "y", False)]


def test_bursts_are_merged_in_any_order():
    rng = random.Random(1)
    times = sorted(rng.sample(range(1000), 60))
    want = []
    for t in times:
        if want and t < want[-1][1] + 12:
            want[-1] = (want[-1][0], t, want[-1][2] + 1, t, str(t))
        else:
            want.append((t, t, 1, t, str(t)))
    mixed, state = times[:], []
    rng.shuffle(mixed)
    for k in range(0, 60, 7):
        state = R.merged(state + [(t, t, 1, t, str(t)) for t in mixed[k : k + 7]], 12)
    assert state == want


def test_a_late_action_and_a_restart(spark, tmp_path):
    """The third arrival has one action that is in time and joins two bursts, and one at the mark, which is dropped; a stream starts anew for each arrival."""
    at = lambda s: START + timedelta(seconds=s)
    schema = "key int, ts timestamp, seq bigint, payload string"
    parts = [[(1, at(0), 0, "a"), (1, at(100), 1, "b")], [(1, at(108), 2, "c"), (2, at(130), 3, None)], [(1, at(104), 4, "in time"), (1, at(100), 5, "late"), (2, at(131), 6, "z")], [(3, at(500), 7, "end")], [(3, at(900), 8, "end")]]
    got = R.arrive(spark, [spark.createDataFrame(p, schema) for p in parts], str(tmp_path), lambda s: R.saves(s, "key", quiet_ms=5000, late="30 seconds"))
    rows = sorted((r.key, (r.opened - START.replace(tzinfo=None)).total_seconds(), (r.saved_at - START.replace(tzinfo=None)).total_seconds(), r.n, r.payload) for r in got.collect())
    assert rows == [(1, 0.0, 5.0, 1, "a"), (1, 100.0, 113.0, 3, "c"), (2, 130.0, 136.0, 2, "z"), (3, 500.0, 505.0, 1, "end")]


