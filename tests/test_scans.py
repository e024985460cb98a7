"""Filters by blocks against the fold over all samples."""

import random

import pytest

from pulseloom.operators import dsp, scans


@pytest.mark.parametrize("config", [dsp.FilterConfig(), dsp.FilterConfig(enabled=False)])
def test_blocks_equal_the_fold(spark, config):
    rng = random.Random(11)
    rows = []
    for session, n in (("long", 700), ("b", 33), ("one", 1), ("two", 2)):
        t = 0
        for i in range(n):
            # Neighbours at one time, late ones, gaps, and a clock that goes back.
            t += rng.choice((4, 4, 4, 4, 0, 1, 9, -3, 250))
            t -= 50_000 if i == 400 else 0
            rows.append((session, i + 1, t, round(2000 + rng.gauss(0, 300 if i % 90 < 30 else 5)), i % 7))
    rows += [("long", 701, None, 5, 1), ("b", 34, 9, None, 1)]
    samples = spark.createDataFrame(rows, "session string, arrival_seq long, t_ms long, raw long, env long")
    expected = {(r.session, r.arrival_seq): r for r in dsp.snapshots(samples, config).collect()}
    got = scans.block_snapshots(samples, config, block=16)
    assert got.columns == dsp.snapshots(samples, config).columns
    found = {(r.session, r.arrival_seq): r for r in got.collect()}
    assert found.keys() == expected.keys() and len({r.segment for r in found.values()}) > 1
    for k, r in expected.items():
        assert tuple(found[k])[:6] == tuple(r)[:6]
        assert tuple(found[k])[6:] == pytest.approx(tuple(r)[6:], rel=1e-9, abs=1e-6), k


def test_blocks_of_one_are_refused(spark):
    with pytest.raises(ValueError):
        scans.block_snapshots(spark.createDataFrame([], "session string, arrival_seq long, t_ms long, raw long, env long"), block=1)
