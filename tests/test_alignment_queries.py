"""The alignment queries take every conversation."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import pytest

from tessera.plans.queries import QUERIES, _audio, _lines

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["auto_align", "align_dp"])
def test_every_conversation_is_aligned(spark, name):
    talks = {r[0] for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().collect()}
    got = QUERIES[name](spark, SF).collect()
    assert {r.audio_id for r in got} == talks
    assert {r.method for r in got} == {"aligned"}


def test_boundaries_of_every_conversation_by_brute_force(spark):
    got, turns = defaultdict(list), defaultdict(list)
    for r in QUERIES["pick_boundaries"](spark, SF).orderBy("audio_id", "n").collect():
        got[r.audio_id].append((r.desired, r.picked))
    for r in _lines(spark, SF).orderBy("audio_id", "ord").collect():
        turns[r.audio_id].append(max(r.syllables or 0, 1))
    speech = {r.audio_id: r.speech for r in _audio(spark, SF).collect()}
    assert set(speech) == set(turns)
    assert set(got) == {k for k, n in turns.items() if len(n) > 1}
    chosen = 0
    for k, found in got.items():
        first, last = speech[k][0][0], speech[k][-1][1]
        want = [first + sum(turns[k][:i]) / sum(turns[k]) * (last - first) for i in range(1, len(turns[k]))]
        assert [d for d, _ in found] == pytest.approx(want)
        gaps = [(a[1] + b[0]) / 2 for a, b in zip(speech[k], speech[k][1:], strict=False)]
        cost = lambda c, want=want: sum((a - b) ** 2 for a, b in zip(c, want, strict=True))
        if len(gaps) >= len(want):
            chosen += 1
            assert cost([p for _, p in found]) == pytest.approx(min(map(cost, combinations(gaps, len(want)))))
            assert {p for _, p in found} <= set(gaps)
    assert chosen
