"""Models of all leave-one-out folds against a fit of each fold on its own."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import folds, loso, training

SCHEMA = "session string, x double, label int"


def plain(examples, names):
    out = {}
    for s in names:
        rows = [(v, y) for n, v, y in examples if n is not None and n != s and v is not None]
        values = sorted({v for v, _ in rows})
        if not values:
            continue
        tried = [((a + b) / 2, [y for v, y in rows if v > a]) for a, b in zip(values, values[1:])] or [(values[0], [y for _, y in rows])]
        total = sum(y for _, y in rows)
        best = []
        for cut, said in tried:
            p, r = sum(said) / max(len(said), 1), sum(said) / max(total, 1)
            best.append((-(2 * p * r / max(p + r, 1e-12)), cut))
        f, cut = min(best)
        m1, m0 = (float(np.median(x)) if (x := [v for v, y in rows if y == k]) else cut for k in (1, 0))
        out[s] = (cut, -f, max(abs(m1 - m0) / 4, 1.0))
    return out


CASES = {
    "ties": lambda r: [("abcdefgh"[r.randrange(8)], float(r.randrange(12)), int(r.random() < 0.4)) for _ in range(150)],
    "own values": lambda r: [(s, float(r.randrange(60)), int(r.random() < 0.5)) for s in "abcd" for _ in range(25)] + [("e", 100.0 + i, 1) for i in range(5)] + [("f", -i - 1.0, 0) for i in range(5)],
    "no positives": lambda r: [("abc"[i % 3], float(r.randrange(30)), 0) for i in range(60)],
    "every third": lambda r: [("abcde"[i % 5], float(i), int(i % 3 == 0)) for i in range(90)],
    "one session": lambda r: [("a", float(i), i % 2) for i in range(9)],
    "two values": lambda r: [("a", 5.0, 1), ("a", 5.0, 0), ("b", 9.0, 1)],
    "empty": lambda r: [],
}


@pytest.mark.parametrize("case", CASES)
def test_folds_are_searches_on_the_other_sessions(spark, case):
    rows = CASES[case](random.Random(case))
    rows += [(None, 3.0, 1), ("a", None, 1)] if case == "ties" else []
    names = sorted({s for s, *_ in rows if s} | {"nobody"})
    examples = spark.createDataFrame(rows, SCHEMA)
    sessions = spark.createDataFrame([(s,) for s in [*names, "nobody"]], "session string")
    got = {r.session: tuple(r)[1:] for r in loso.threshold_folds(examples, sessions, "x", leaf=4, fan=2).collect()}
    expected = plain(rows, names)
    assert got.keys() == expected.keys()
    for s in got:
        assert got[s] == pytest.approx(expected[s], abs=1e-12)


def test_folds_with_the_usual_leaves(spark):
    rng = random.Random(2)
    rows = [(f"s{rng.randrange(7)}", round(rng.gauss(5 * (i % 3 == 0), 3), 2), int(i % 3 == 0)) for i in range(4000)]
    examples = spark.createDataFrame(rows, SCHEMA)
    got = {r.session: tuple(r)[1:] for r in loso.threshold_folds(examples, examples.select("session"), "x").collect()}
    for s in got:
        assert got[s] == pytest.approx(tuple(training.threshold_search(examples.where(F.col("session") != s), "x").first()), abs=1e-12)


def test_hulls_hold_the_best_point_of_any_fold():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(2, 40)
        steps = [rng.random() < rng.choice((0.1, 0.4, 0.9)) for _ in range(n)]
        said, tp = np.arange(n + 1)[::-1], np.cumsum([0, *steps])[::-1]
        kept = set(loso.hull(said, tp).tolist())
        for _ in range(20):
            # What is counted beyond these points, and a fold's constants.
            more, hits = rng.randrange(10), rng.randrange(10)
            score = loso._f1(tp + min(more, hits), said + more, max(1, int(tp.max()) + hits + rng.randrange(5)))
            assert score.max() == 0 or set(np.flatnonzero(score == score.max()).tolist()) <= kept


def test_covers_are_whole():
    rng = random.Random(4)
    for _ in range(300):
        low = rng.randrange(500)
        high = low + rng.randrange(400)
        nodes = list(loso.cover(low, high, 4, 3, 3))
        ranks = [r for k, at in nodes for r in range(at * 4 * 3**k, (at + 1) * 4 * 3**k) if k or low <= r <= high]
        assert ranks == list(range(low, high + 1))


def test_no_pairs_of_sessions_and_values(spark, tmp_path):
    """No join of the plan is without equal keys."""
    rows = CASES["ties"](random.Random(5))
    examples = spark.createDataFrame(rows, SCHEMA)
    plan = loso.threshold_folds(examples, examples.select("session"), "x")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_order_statistics_to_the_last_bit():
    rng = np.random.default_rng(6)
    values = np.r_[rng.normal(size=200), rng.normal(size=50) * 1e-300, rng.normal(size=50) * 1e300, 0.0, -0.0, 5.0, 5.0, 5.0]
    values.sort()
    target = np.arange(1, len(values) + 1)
    found = folds.narrowed(lambda v: np.searchsorted(values, v, side="right"), target, np.full(len(values), values[0]), np.full(len(values), values[-1]))
    assert (found == values).all()


def test_logistic_folds_of_many_sessions(spark, monkeypatch):
    """Folds, groups of folds and parts of matrices that are cut small, against a fit of each fold on its own."""
    monkeypatch.setattr(folds, "GROUP", 2)
    monkeypatch.setattr(folds, "CELLS", 20)
    rng = random.Random(7)
    rows = [("abcde"[min(rng.randrange(9), 4)], i, 1000 + rng.gauss(5 * (i % 4 == 0), 2), float(rng.randrange(4)), int(i % 4 == 0)) for i in range(160)]
    rows += [(None, 1, 1.0, 1.0, 1), ("a", 1, None, 1.0, 1)]
    examples = spark.createDataFrame(rows, "session string, t_ms long, wl double, rms double, label int").repartition(3)
    names = [*"abcde", "nobody"]
    got = folds.logistic_folds(examples, spark.createDataFrame([(x,) for x in names], "session string"), ["wl", "rms"], epochs=3)
    assert sorted(got) == names
    for s in names:
        one = training.fit_logreg(examples.dropna().where(F.col("session") != s), ["wl", "rms"], epochs=3)
        assert got[s]["center"] == [one["center"][f] for f in ("wl", "rms")] and got[s]["scale"] == pytest.approx([one["scale"][f] for f in ("wl", "rms")], rel=1e-14)
        assert got[s]["weights"] == pytest.approx(one["weights"], rel=1e-9) and got[s]["bias"] == pytest.approx(one["bias"], rel=1e-9)
    lone = examples.where("session = 'a'")
    assert folds.logistic_folds(lone, lone.select("session"), ["wl"], epochs=1) == {}
    assert folds.logistic_folds(examples.limit(0), lone.select("session"), ["wl"], epochs=1) == {}
