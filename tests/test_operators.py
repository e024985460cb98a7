"""Literal cases of the operators, and equality of batch, kernel and stream."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseloom import cli
from pulseloom.functions import columns as C
from pulseloom.functions import models
from pulseloom.operators import decide, dsp, evaluate, frames, islands, protocol, score, training
from pulseloom.sources import profiles, serial, sessions
from pulseloom.streaming import detector


def test_parse_line(spark):
    rows = ["123 456 78", "  1   2   3   ", "1_0 +5 007", "a b c", "1 2", "", "bad", "1.5 2 3", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, line string").select("i", C.parse_line(F.col("line")).alias("s"))
    found = [r.s and tuple(r.s) for r in df.orderBy("i").collect()]
    assert found == [(123, 456, 78), (1, 2, 3), (10, 5, 7)] + [None] * 6


def test_whole_number(spark):
    df = spark.createDataFrame([("2.9",), ("-2.9",), ("inf",), ("nan",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(C.whole_number(F.col("v"))).collect()] == [2, -2, None, None, None, None]


EXAMPLE = [(0, 2.0), (100, 3.0), (200, 30.0), (300, 35.0), (500, 3.0)]


def test_labels_threshold_and_logreg(spark):
    records = spark.createDataFrame([("a", 0, "session_start", None), ("a", 1, "label_start", 180), ("a", 2, "label_end", 340), ("a", 3, "session_end", 500)], "session string, line long, type string, t_ms long")
    rows = spark.createDataFrame([("a", *x) for x in EXAMPLE], "session string, t_ms long, waveform_length double")
    labelled = training.label_frames(rows, islands.label_intervals(records), 40)
    assert [r.label for r in labelled.orderBy("t_ms").collect()] == [0, 0, 1, 1, 0]
    best = training.threshold_search(labelled, "waveform_length").first()
    assert (best.threshold, best.f1, best.softness) == (16.5, 1.0, pytest.approx(29.5 / 4))
    model = training.fit_logreg(labelled, ["waveform_length"], epochs=30)
    assert model["weights"][0] == pytest.approx(plain_logreg([x[1] for x in EXAMPLE], [0, 0, 1, 1, 0], 30), abs=1e-9)


def plain_logreg(values, labels, epochs):
    from math import exp
    from statistics import median

    s = sorted(values)
    at = lambda p: s[int((len(s) - 1) * p)]
    centre = median(s)
    scale = max(1.4826 * median([abs(v - centre) for v in s]), (at(0.9) - at(0.1)) / 2.563, 1e-6)
    x = [(v - centre) / scale for v in values]
    w, b, n, pos = random.Random(7).uniform(-0.01, 0.01), 0.0, len(x), sum(labels)
    for _ in range(epochs):
        d = [(1 / (1 + exp(-(w * v + b))) - y) * (n / (2 * pos) if y else n / (2 * (n - pos))) for v, y in zip(x, labels)]
        w, b = w - 0.05 * (sum(a * v for a, v in zip(d, x)) / n + 1e-4 * w), b - 0.05 * sum(d) / n
    return w


def test_phases_and_scores(spark):
    markers = spark.createDataFrame([("a", 0, None, None, None, None), ("a", 1, "REST", None, 0, 5.0), ("a", 2, "CLICK 1/1", "CLICK", 5000, 1.0), ("a", 3, "ARTIFACT_NO_LABEL", None, 6000, 4.0)], "session string, line long, name string, label string, t_ms long, duration_s double")
    phases = islands.phase_windows(markers)
    assert [(r.name, r.start_ms, r.end_ms) for r in phases.orderBy("ord").collect()] == [("REST", 0, 5000), ("CLICK 1/1", 5000, 6000), ("ARTIFACT_NO_LABEL", 6000, 10000)]
    events = [("down", 2000), ("up", 2100), ("down", 5050), ("up", 6080), ("down", 7000), ("up", 7050)]
    found = spark.createDataFrame([("a", i, p, t) for i, (p, t) in enumerate(events)], "session string, ord long, phase string, t_ms long")
    clicks = spark.createDataFrame([("a", 1, 5000, 6000)], "session string, ord long, start_ms long, end_ms long")
    scores, hits = evaluate.session_scores(clicks.select("session"), found, clicks, phases)
    score = scores.first()
    assert (score.clicks, score.detected, score.missed, score.false_rest, score.false_artifact) == (1, 1, 0, 1, 1)
    assert [tuple(r) for r in hits.collect()] == [("a", 50.0, 80.0, 30.0)]
    assert (score.rest_seconds, score.artifact_seconds) == (5.0, 4.0)
    total = evaluate.aggregate_scores(scores, hits).first()
    assert (total.detection_rate, total.false_rest_per_min, total.down_latency_median) == (1.0, 12.0, 50.0)


def scored_events(spark, *events):
    """The click from 5000 to 6000 between rest and artifacts, against events ``(phase, t_ms)``."""
    markers = spark.createDataFrame([("a", 1, "REST", None, 0, 5.0), ("a", 2, "CLICK 1/1", "CLICK", 5000, 1.0), ("a", 3, "ARTIFACT_NO_LABEL", None, 6000, 4.0)], "session string, line long, name string, label string, t_ms long, duration_s double")
    found = spark.createDataFrame([("a", i, p, t) for i, (p, t) in enumerate(events)], "session string, ord long, phase string, t_ms long")
    clicks = spark.createDataFrame([("a", 1, 5000, 6000)], "session string, ord long, start_ms long, end_ms long")
    return evaluate.session_scores(clicks.select("session"), found, clicks, islands.phase_windows(markers))


def test_rates_cancels_and_misses(spark):
    total = evaluate.aggregate_scores(*scored_events(spark, ("down", 1000), ("up", 1100), ("down", 5050), ("up", 6050))).first()
    assert (total.false_rest_per_min, total.detection_rate) == (12.0, 1.0)
    score = scored_events(spark, ("down", 2000), ("cancel", 2030), ("down", 5050), ("up", 6050))[0].first()
    assert (score.detected, score.false_rest, score.cancelled) == (1, 0, 1)
    score = scored_events(spark)[0].first()
    assert (score.detected, score.missed) == (0, 1)
    assert evaluate.aggregate_scores(*scored_events(spark)).first().down_latency_median == 0.0


def test_presses_pair_and_cancel(spark):
    rows = [("a", 0, "down", 100), ("a", 1, "up", 200), ("a", 2, "down", 500), ("b", 0, "up", 1), ("b", 1, "down", 2), ("b", 2, "cancel", 3)]
    found = islands.presses(spark.createDataFrame(rows, "session string, ord long, phase string, t_ms long"))
    assert sorted((r.session, r.down_ms, r.up_ms) for r in found.collect()) == [("a", 100, 200), ("a", 500, None), ("b", 2, None)]


def test_greedy_match_against_loops(spark):
    rng = random.Random(3)
    clicks, presses, expected = [], [], set()
    for s in range(20):
        starts = sorted(rng.sample(range(0, 20000), 15))
        mine = [(s, i + 1, a, a + rng.randrange(1, 900)) for i, a in enumerate(starts)]
        downs = sorted(rng.sample(range(0, 20000), 25))
        hits = [(s, i + 1, d, d + 50 if rng.random() < 0.8 else None) for i, d in enumerate(downs)]
        clicks, presses, used = clicks + mine, presses + hits, set()
        for _, c, a, e in mine:
            for _, p, d, up in hits:
                if up is not None and p not in used and a - 400 <= d <= e + 600:
                    used.add(p)
                    expected.add((s, c, p))
                    break
    got = evaluate.greedy_match(spark.createDataFrame(clicks, "session long, ord long, start_ms long, end_ms long"), spark.createDataFrame(presses, "session long, ord long, down_ms long, up_ms long"))
    assert {tuple(r) for r in got.collect()} == expected


def test_switch_events(spark):
    rows = [("a", 1, "active", "down", 100, 100, 0), ("a", 2, "active", "up", 100, 240, 140), ("a", 3, "rest", None, 0, 100, 100), ("a", 4, "active", None, 100, 200, 100)]
    got = decide.switch_events(spark.createDataFrame(rows, "session string, ord long, state string, phase string, start_ms long, end_ms long, duration_ms long"))
    assert [(r.phase, r.t_ms, r.duration_ms) for r in got.orderBy("ord").collect()] == [("down", 100, 0), ("up", 240, 140)]


def square(session, *parts):
    values = [v for n, burst in parts for v in ([1500 if burst and i % 2 else 1000 for i in range(n)])]
    return [(session, i + 1, 4 * i, v, 0) for i, v in enumerate(values)]


def test_batch_kernel_and_stream_agree(spark):
    rows = square("press", (200, 0), (60, 1), (80, 0)) + square("short", (200, 0), (6, 1), (150, 0)) + square("open", (200, 0), (40, 1))
    samples = spark.createDataFrame(rows, "session string, arrival_seq long, t_ms long, raw long, env long")
    model, gate = detector.threshold(200.0, 20.0), decide.Gate(enter_dwell=1, release_dwell=1, min_event_ms=100, refractory_ms=0)
    one = frames.frames(dsp.snapshots(samples, hop_ms=10).drop("raw", "segment").withColumnRenamed("filtered", "raw"), "raw", 20, 10)
    scored = one.select("session", F.col("frame").alias("ord_frame"), F.col("end_ms").alias("t_ms"), C.threshold_score(F.col("waveform_length"), 200.0, 20.0).alias("p"))
    batch = sorted(map(tuple, decide.edge_events(scored, gate).collect()))
    kernel = []
    for s in ("press", "short", "open"):
        d = detector.Detector(model, gate, 20, 10)
        for _, _, t, raw, _ in (r for r in rows if r[0] == s):
            kernel += [(s, *e[:5]) for e in d.update(t, raw)]
    assert batch == sorted(kernel)
    stream = detector.replay_stream(spark, samples, model, gate, 20, 10)
    assert sorted(map(tuple, stream.collect())) == batch
    flushed = decide.edge_events(scored, gate, decide.session_ends(samples)).groupBy("session").agg(F.count_if(F.col("phase") == "down").alias("d"), F.count_if(F.col("phase") != "down").alias("e"))
    assert all(r.d == r.e and r.d > 0 for r in flushed.collect())


def test_late_rows_and_resets(spark):
    rows = [("a", i + 1, t, 10.0 * t, 0) for i, t in enumerate([0, 10, 30, 20, 40, 5, 15, 25, 35, 45])]
    samples = spark.createDataFrame(rows, "session string, arrival_seq long, t_ms long, raw double, env long")
    got = {(r.segment, r.end_ms): r.n for r in frames.frames(samples, "raw", 20, 10).collect()}
    # The 20 that comes after the 30 is late for the frames that end at 20 and 30; the 5 starts the clock anew.
    assert got == {(0, 20): 2, (0, 30): 2, (0, 40): 3, (1, 25): 3, (1, 35): 3, (1, 45): 3}


def test_protocol():
    rows = protocol.build(settle=1, rest=2, trials=3, press=0.5, gap=1, final_rest=2, artifact=4)
    assert sum(r[2] for r in rows) == 12.5
    at = 0.0
    for _, name, d, _ in rows:
        if at <= 3.1 < at + d:
            assert name == "CLICK 1/3"
        at += d


def test_grid_and_rank(spark):
    grid = evaluate.decision_grid(spark)
    assert grid.count() == 36
    rows = spark.createDataFrame([(0, 0.95, 100.0, 2.0, 1.0), (1, 0.5, 10.0, 0.0, 0.0), (2, 0.95, 100.0, 1.0, 1.0), (3, 0.95, 100.0, 1.0, 1.0)], "config int, detection_rate double, down_latency_median double, false_rest_per_min double, false_artifact_per_min double")
    assert [r.config for r in evaluate.rank_sweep(rows).orderBy("rank").collect()] == [2, 3, 0, 1]


def test_profiles(tmp_path):
    p = profiles.Profile("threshold", ["waveform_length"], model={"threshold": 20.0}, decision={"enter_threshold": 0.8})
    profiles.save(p, str(tmp_path / "m" / "p.json"))
    back = profiles.load(str(tmp_path / "m" / "p.json"))
    assert back == p and back.gate() == decide.Gate(enter=0.8)
    (tmp_path / "bad.json").write_text(json.dumps({**p.__dict__, "feature_hash": "0"}))
    with pytest.raises(ValueError):
        profiles.load(str(tmp_path / "bad.json"))
    with pytest.raises(TypeError):
        profiles.Profile("x", [], decision={"nope": 1}).gate()


def test_session_folders(spark, tmp_path):
    for name, ok in (("one", True), ("two-BAD", False), ("_three", False)):
        d = tmp_path / name
        d.mkdir()
        (d / "raw.csv").write_text("host_time_s,t_ms,raw,env,line\n1.0,10,2000.9,12,\"10 2000 12\"\n1.0,x,1,1,bad\n2.0,20,-3.5,1,z\n")
        (d / "labels.jsonl").write_text('{"type":"session_start","t_ms":null}\n\n{"type":"label_start","t_ms":180.0}\n{"type":"label_end","t_ms":340}\n')
    got = sessions.read_raw(spark, str(tmp_path))
    assert [(r.session, r.arrival_seq, r.t_ms, r.raw, r.env) for r in got.orderBy("arrival_seq").collect()] == [("one", 1, 10, 2000, 12), ("one", 3, 20, -3, 1)]
    assert sessions.session_names(spark, str(tmp_path)) == ["one"]
    (tmp_path / "one" / "raw.csv").write_text('line,env,raw,extra,t_ms\r\n"10 2000 12",12,2000,?,10\r\n')
    assert [(r.t_ms, r.raw, r.env) for r in sessions.read_raw(spark, str(tmp_path)).collect()] == [(10, 2000, 12)]
    marks = sessions.read_labels(spark, str(tmp_path), "one")
    assert [tuple(r) for r in islands.label_intervals(sessions.label_intervals_of(marks)).collect()] == [("one", 1, 180, 340)]


def test_back_off_and_lock(tmp_path):
    waits = []

    def failing():
        raise OSError

    source = serial.Reconnecting(failing, 0.2, 2.0, 1.0, waits.append)
    assert [source.read() for _ in range(4)] == [None] * 4 and waits == [0.2, 0.4, 0.8, 1.0]
    lock = serial.PortLock(str(tmp_path), "/dev/ttyUSB0")
    lock.acquire()
    with pytest.raises(RuntimeError):
        serial.PortLock(str(tmp_path), "/dev/ttyUSB0").acquire()
    lock.release()
    (tmp_path / "_dev_ttyUSB0.lock").write_text('{"pid": 999999, "port": "/dev/ttyUSB0"}')
    lock.acquire()
    (tmp_path / "_dev_ttyUSB0.lock").write_text('{"pid": 1, "port": "/dev/ttyUSB0"}')
    lock.release()
    assert (tmp_path / "_dev_ttyUSB0.lock").exists()


def test_line_source(spark, tmp_path):
    path = tmp_path / "device.txt"
    path.write_text("1 100 5\nbad\n2 110 6\nhalf")
    spark.dataSource.register(serial.LineSource)
    stream = spark.readStream.format("device_lines").option("path", str(path)).option("session", "s").load()
    query = frames.parsed_lines(stream).writeStream.format("memory").queryName("device").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("device").orderBy("arrival_seq").collect()] == [("s", 1, 1, 100, 5), ("s", 3, 2, 110, 6)]


def test_splits():
    train, val = training.split_sessions([f"s{i}" for i in range(10)], 0.25, 7)
    assert len(val) == 2 and not set(train) & set(val)
    assert training.features_of(" CORE ") == ("waveform_length", "rms_state")
    assert training.features_of("all") == ("waveform_length", "rms_state", "slope_burst", "lf_energy_ratio")
    assert training.features_of("slope_burst, rms_state") == ("slope_burst", "rms_state")
    with pytest.raises(ValueError):
        training.features_of("nope")


def test_grid_is_that_of_the_reference(spark):
    rows = [(e, x, d, 2, m, 80) for e in (0.6, 0.7, 0.8) for x in (0.4, 0.5) for m in (50, 120, 200) for d in (2, 3)]
    assert [tuple(r)[1:] for r in evaluate.decision_grid(spark).orderBy("config").collect()] == rows


def test_replay_bounds_the_rows_of_a_session_in_a_micro_batch(spark, monkeypatch):
    class Sizes(detector.Detector):
        OUTPUT = "n bigint"

    class Counted(detector.SessionProcessor):
        def handleInputRows(self, key, rows, timer):
            yield self._out(key, [(sum(map(len, rows)),)])

    def sizes(samples, *_):
        return plain(samples, None, make=lambda: Sizes(None))

    plain = detector.detect
    monkeypatch.setattr(detector, "SessionProcessor", Counted)
    monkeypatch.setattr(detector, "detect", sizes)
    monkeypatch.setattr(detector, "ROWS", 10, raising=False)
    samples = spark.range(60).select(F.lit(1).cast("bigint").alias("session"), F.col("id").alias("arrival_seq"), F.col("id").alias("t_ms"), F.lit(0).alias("raw"))
    found = [r["n"] for r in detector.replay_stream(spark, samples, None, None, 20, 10).collect()]
    assert found == [10] * 6


#: The profile of the square-wave cases.
SQUARE = {"model_type": "threshold", "feature_order": ["waveform_length"], "model": {"feature": "waveform_length", "threshold": 20.0, "softness": 2.0}, "feature_config": {"window_ms": 20, "hop_ms": 10}}
GATES = {"enter_threshold": 0.6, "exit_threshold": 0.4, "enter_dwell_frames": 1, "release_dwell_frames": 1, "refractory_ms": 0}


@pytest.mark.parametrize("parts, least, skip, has, lacks", [
    (((20, 0), (60, 1), (80, 0)), 20, 0, {"down", "up"}, set()),
    (((200, 0), (6, 1), (150, 0)), 300, 800, {"down", "cancel"}, {"up"}),
    (((40, 0), (40, 1)), 20, 0, {"down"}, set()),
    (((40, 0), (60, 1)), 20, 0, {"down"}, set()),
])
def test_square_waves(spark, parts, least, skip, has, lacks):
    """Press, transient and flush, by the detector of a live run and in batch; the first events may be left out."""
    profile = profiles.Profile(**SQUARE, decision={**GATES, "min_event_ms": least})
    rows, d = square("s", *parts), detector.Detector(score.FrameModel(profile), profile.gate(), 20, 10)
    events = [e for _, _, t, raw, _ in rows for e in d.update(t, raw)]
    phases = {e[1] for e in events if e[2] >= skip}
    assert has <= phases and not lacks & phases
    tail = d.flush()
    if len(parts) == 2:
        # An open press is closed at the last sample.
        assert len(tail) == 1 and tail[0][3] == rows[-1][2] and tail[0][4] == rows[-1][2] - tail[0][2]
    samples = spark.createDataFrame(rows, "session string, arrival_seq long, t_ms long, raw long, env long")
    batch = cli.replayed(samples, profile).orderBy("ord").collect()
    expected = [("s", e[0], e[1], e[2] if e[1] == "down" else e[3]) for e in events + tail]
    assert [(r.session, r.ord, r.phase, r.t_ms) for r in batch] == expected
    downs = sum(r.phase == "down" for r in batch)
    assert downs == sum(r.phase in ("up", "cancel") for r in batch)


def test_flush_closes_at_the_last_sample(spark):
    scored = spark.createDataFrame([("a", 0, 0, 0.9), ("a", 1, 10, 0.9), ("a", 2, 20, 0.9), ("b", 0, 0, 0.1), (None, 0, 0, 0.9), (None, 1, 10, 0.9)], "session string, ord_frame long, t_ms long, p double")
    ends = spark.createDataFrame([("a", 97), ("b", 50)], "session string, final_t_ms long")
    got = decide.edge_events(scored, decide.Gate(enter_dwell=1), ends)
    assert sorted((r.session or "", r.phase, r.end_ms, r.duration_ms) for r in got.collect()) == [("", "down", 0, 0), ("a", "down", 0, 0), ("a", "up", 97, 97)]


def test_folds_keep_large_and_null_keys_exact(spark):
    big = 9007199254740993
    rows = [(big, i, 10 * i, 0.9) for i in range(3)] + [(None, i, 10 * i, 0.9) for i in range(3)] + [(big - 1, 0, 0, 0.9), (big - 1, 1, 10, 0.9)]
    got = decide.edge_events(spark.createDataFrame(rows, "session long, ord_frame long, t_ms long, p double"), decide.Gate(enter_dwell=2))
    assert sorted(((r.session or 0), r.phase) for r in got.collect()) == [(0, "down"), (big - 1, "down"), (big, "down")]


def test_null_values_reach_no_recurrence(spark):
    rows = [("a", i + 1, 4 * i, None if i == 3 else 1000 + i % 2, 0) for i in range(10)]
    given = spark.createDataFrame(rows, "session string, arrival_seq long, t_ms long, raw long, env long")
    with_null = {r.arrival_seq: r.filtered for r in dsp.snapshots(given).collect()}
    without = {r.arrival_seq: r.filtered for r in dsp.snapshots(given.where("raw IS NOT NULL")).collect()}
    assert with_null == without and len(with_null) == 9 and all(v == v for v in with_null.values())


def test_repeated_rows_stay(spark):
    frame = spark.createDataFrame([("a", 5, 1.0)] * 3 + [("a", 50, 1.0)] * 2 + [("a", 14, 1.0), ("a", None, 2.0)], "session string, t_ms long, waveform_length double")
    intervals = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 4, 6)], "session string, ord long, start_ms long, end_ms long")
    assert sorted((r.t_ms or -1, r.label) for r in training.label_frames(frame, intervals, 4).collect()) == [(-1, 0)] + [(5, 1)] * 3 + [(50, 0)] * 2
    downs = spark.createDataFrame([("a", 5)] * 3 + [("a", 99)], "session string, down_ms long")
    phases = spark.createDataFrame([("a", 1, "REST", None, 0, 10)], "session string, ord long, name string, label string, start_ms long, end_ms long")
    assert sorted((r.down_ms, r.bucket) for r in evaluate.classify_downs(downs, phases).collect()) == [(5, "rest")] * 3 + [(99, "other")]


def test_rest_statistics_and_learning_against_loops(spark):
    from statistics import median

    rng = random.Random(31)
    rows = [("a", i + 1, 4 * i, 1000 + rng.randrange(300), 0) for i in range(400)]
    samples = spark.createDataFrame(rows, "session string, arrival_seq long, t_ms long, raw long, env long")
    got = {r.arrival_seq: (r.rest_center, r.rest_scale) for r in dsp.rest_statistics(frames.with_segments(samples), "raw", 500, most=90).collect()}
    scale = lambda v: max(v[int((len(v) - 1) * 0.9)] - v[int((len(v) - 1) * 0.5)], 1.4826 * median(abs(x - v[int((len(v) - 1) * 0.5)]) for x in v), 5.0)
    for i in range(400):
        v = sorted(float(r[3]) for r in rows[max(0, i - 89) : i + 1] if r[2] >= rows[i][2] - 500)
        assert got[i + 1] == pytest.approx((median(v), scale(v)))
    learned = {r.arrival_seq: r for r in dsp.rest_learning(samples, F.col("arrival_seq") % 3 == 0).collect()}
    s, c, window = dsp.FilterState(), dsp.FilterConfig(), []
    baseline, centre, size = 1000.0, 0.0, 5.0
    for _, seq, t, raw, _ in rows:
        s.baseline = baseline if seq > 1 else s.baseline
        made = dsp.step(s, c, t, float(raw))
        baseline = s.baseline
        if seq % 3 == 0:
            baseline += 4 / 2004 * (made[0] - baseline)
            window = [(x, v) for x, v in window + [(t, made[3])] if x >= t - 3000]
            v = sorted(v for _, v in window)
            centre, size = median(v), scale(v)
        g = learned[seq]
        assert (g.baseline_raw, g.rest_center, g.rest_scale, g.u) == pytest.approx((baseline, centre, size, (made[3] - centre) / size))


def test_bootstrap():
    s, c = dsp.FilterState(), dsp.FilterConfig()
    dsp.bootstrap(s, c, 900.0, 30.0, 1.0, 5000, [float(i) for i in range(200)])
    assert (s.baseline, s.rest_center, s.rest_scale) == (900.0, 30.0, 5.0)
    assert len(s.rest.rows) == 128 and s.rest.rows[0] == (5000 - 128, 72.0) and s.rest.rows[-1] == (4999, 199.0)


def plain_conv(x, w, b, pad, step=1):
    """``x[time][channel]``, by loops."""
    n, out = len(x), []
    for t in range(n):
        row = []
        for o in range(len(w)):
            v = b[o]
            for i in range(len(w[o])):
                for k in range(len(w[o][i])):
                    at = t + k * step - pad
                    v += w[o][i][k] * x[at][i] if 0 <= at < n else 0
            row.append(max(v, 0))
        out.append(row)
    return out


def weights(rng, *shape):
    return [weights(rng, *shape[1:]) for _ in range(shape[0])] if shape else rng.uniform(-0.5, 0.5)


def test_sequence_models_against_loops():
    from math import exp, sqrt

    rng, d, h, n = random.Random(41), 3, 4, 6
    x = weights(rng, n, d)
    cnn = {"1.weight": weights(rng, h, d, 5), "1.bias": weights(rng, h), "3.weight": weights(rng, h, h, 3), "3.bias": weights(rng, h), "7.weight": weights(rng, 1, h), "7.bias": weights(rng, 1)}
    sigmoid = lambda v: 1 / (1 + exp(-v))
    last = lambda rows, w, b: sigmoid(b[0] + sum(w[0][j] * sum(r[j] for r in rows) / len(rows) for j in range(len(w[0]))))
    expected = last(plain_conv(plain_conv(x, cnn["1.weight"], cnn["1.bias"], 2), cnn["3.weight"], cnn["3.bias"], 1), cnn["7.weight"], cnn["7.bias"])
    assert models.build("cnn", {"state_dict": cnn})(np.array([x]))[0] == pytest.approx(expected, abs=1e-5)
    tcn = {"in_proj.weight": weights(rng, h, d, 1), "in_proj.bias": weights(rng, h), "conv1.weight": weights(rng, h, h, 3), "conv1.bias": weights(rng, h), "conv2.weight": weights(rng, h, h, 3), "conv2.bias": weights(rng, h), "out.weight": weights(rng, 1, h), "out.bias": weights(rng, 1)}
    rows = plain_conv(x, tcn["in_proj.weight"], tcn["in_proj.bias"], 0)
    for name, step in (("conv1", 2), ("conv2", 4)):
        rows = plain_conv(rows, tcn[f"{name}.weight"], tcn[f"{name}.bias"], step, step)
    assert models.build("tcn", {"state_dict": tcn})(np.array([x]))[0] == pytest.approx(last(rows, tcn["out.weight"], tcn["out.bias"]), abs=1e-5)
    at = "encoder.layers.0."
    tf = {"proj.weight": weights(rng, h, d), "proj.bias": weights(rng, h), "pos": weights(rng, 1, n, h), "out.weight": weights(rng, 1, h), "out.bias": weights(rng, 1)}
    tf |= {at + "self_attn.in_proj_weight": weights(rng, 3 * h, h), at + "self_attn.in_proj_bias": weights(rng, 3 * h), at + "self_attn.out_proj.weight": weights(rng, h, h), at + "self_attn.out_proj.bias": weights(rng, h)}
    tf |= {at + "linear1.weight": weights(rng, 2 * h, h), at + "linear1.bias": weights(rng, 2 * h), at + "linear2.weight": weights(rng, h, 2 * h), at + "linear2.bias": weights(rng, h)}
    tf |= {at + f"{k}.{p}": weights(rng, h) for k in ("norm1", "norm2") for p in ("weight", "bias")}
    dot = lambda v, w, b: [b[o] + sum(p * q for p, q in zip(v, w[o])) for o in range(len(w))]
    z = [[a + b for a, b in zip(dot(v, tf["proj.weight"], tf["proj.bias"]), tf["pos"][0][t])] for t, v in enumerate(x)]
    qkv = [dot(v, tf[at + "self_attn.in_proj_weight"], tf[at + "self_attn.in_proj_bias"]) for v in z]
    met = [[0.0] * h for _ in z]
    for head in range(2):
        part = lambda v, k: v[k * h + 2 * head : k * h + 2 * head + 2]
        for t, a in enumerate(qkv):
            near = [exp(sum(p * q for p, q in zip(part(a, 0), part(b, 1))) / sqrt(2)) for b in qkv]
            for j in range(2):
                met[t][2 * head + j] = sum(w * part(b, 2)[j] for w, b in zip(near, qkv)) / sum(near)

    def norm(v, name):
        m = sum(v) / h
        s = sqrt(sum((a - m) ** 2 for a in v) / h + 1e-5)
        return [(a - m) / s * g + b for a, g, b in zip(v, tf[at + name + ".weight"], tf[at + name + ".bias"])]

    z = [norm([a + b for a, b in zip(v, dot(m, tf[at + "self_attn.out_proj.weight"], tf[at + "self_attn.out_proj.bias"]))], "norm1") for v, m in zip(z, met)]
    z = [norm([a + b for a, b in zip(v, dot([max(c, 0) for c in dot(v, tf[at + "linear1.weight"], tf[at + "linear1.bias"])], tf[at + "linear2.weight"], tf[at + "linear2.bias"]))], "norm2") for v in z]
    assert models.build("transformer", {"state_dict": tf, "config": {"heads": 2}})(np.array([x]))[0] == pytest.approx(last(z, tf["out.weight"], tf["out.bias"]), abs=1e-5)
    with pytest.raises(ValueError):
        models.build("nope", {})


def test_batch_and_frame_scores_agree(spark):
    rng = random.Random(42)
    rows = [("ab"[i % 2], i // 2, 0, *[rng.random() for _ in range(4)]) for i in range(40)]
    made = spark.createDataFrame(rows, "session string, frame long, segment long, " + ", ".join(f"{f} double" for f in training.FEATURES))
    norm = {"center": {f: 0.4 for f in training.FEATURES}, "scale": {f: 0.2 for f in training.FEATURES}, "floor": {f: 1e-6 for f in training.FEATURES}}
    state = {"1.weight": weights(rng, 4, 2, 5), "1.bias": weights(rng, 4), "3.weight": weights(rng, 4, 4, 3), "3.bias": weights(rng, 4), "7.weight": weights(rng, 1, 4), "7.bias": weights(rng, 1)}
    for profile in (
        profiles.Profile("logreg", list(training.FEATURES), norm, {"weights": [0.5, -1.0, 2.0, 0.1], "bias": 0.2}),
        profiles.Profile("cnn", ["rms_state", "slope_burst"], norm, {"config": {"seq_len": 5, "hidden": 4}, "state_dict": state}),
        profiles.Profile("threshold", ["rms_state"], model={"feature": "rms_state", "threshold": 0.5, "softness": 0.1}),
    ):
        got = {(r.session, r.frame): r.p for r in score.score_frames(made, profile).collect()}
        model, memory = score.FrameModel(profile), {"a": [], "b": []}
        for s, f, _, *values in sorted(rows):
            assert got[(s, f)] == pytest.approx(model(dict(zip(training.FEATURES, values)), memory[s]), abs=1e-6)
        if profile.model_type == "cnn":
            assert got[("a", 3)] == 0.0 != got[("a", 4)]


def test_device_lines(spark):
    got = frames.parsed_lines(dsp.device_lines(spark, 12.0)).orderBy("arrival_seq").collect()
    assert len(got) == 3000 and [r.t_ms for r in got[:3]] == [0, 4, 8] and all(0 <= r.raw <= 4095 for r in got)
    assert sum(r.env for r in got[2200:2400]) > 3 * sum(r.env for r in got[200:400])


def test_split_of_one_session(spark):
    rows = spark.createDataFrame([("a", i, float(i), i % 2) for i in range(21)], "session string, t_ms long, waveform_length double, label int")
    train, held = training.split_examples(rows, 0.25, 7)
    assert (train.count(), held.count()) == (16, 5) and not {r.t_ms for r in train.collect()} & {r.t_ms for r in held.collect()}
    assert training.split_examples(rows.limit(1))[1].count() == 0


def write_recording(root, name, seed):
    rng = random.Random(seed)
    rows, marks, t = [], [{"type": "session_start", "t_ms": None}, {"type": "prompt_phase", "phase": "REST", "t_ms": 0, "duration_s": 1.0}], 0
    for burst, n in ((0, 250), (1, 100), (0, 200), (1, 100), (0, 250)):
        if burst:
            marks += [{"type": "prompt_phase", "phase": "CLICK", "t_ms": t, "duration_s": 0.4, "label": "CLICK"}, {"type": "label_start", "label": "CLICK", "t_ms": t}]
        for i in range(n):
            rows.append(f"{t / 1000:.6f}\t{t} {1000 + (500 if burst and i % 2 else 0) + rng.randrange(5)} 0")
            t += 4
        if burst:
            marks += [{"type": "label_end", "label": "CLICK", "t_ms": t - 4}, {"type": "prompt_phase", "phase": "REST", "t_ms": t, "duration_s": 1.0}]
    return rows, marks


def test_record_train_evaluate_and_replay(spark, tmp_path, capsys):
    """Device lines to recorded sessions, a model trained and judged on them, and a recording replayed under it."""
    root = tmp_path / "sessions"
    for i in range(3):
        lines, marks = write_recording(root, f"s{i}", i)
        (tmp_path / f"device{i}.txt").write_text("\n".join(lines) + "\n")
        cli.main(["record", "--port", str(tmp_path / f"device{i}.txt"), "--out", str(root / f"s{i}"), "--label", "CLICK"])
        made = json.loads((root / f"s{i}" / "meta.json").read_text())
        assert made["label_mode"] == "toggle" and made["schema_version"] == 1
        head = (root / f"s{i}" / "raw.csv").read_text().split("\n")[0]
        assert head == "host_time_s,t_ms,raw,env,line"
        # What was pressed comes from the marks here.
        with open(root / f"s{i}" / "labels.jsonl", "a") as f:
            f.write("\n".join(map(json.dumps, marks)) + "\n")
    profile = tmp_path / "models" / "p.json"
    for model in ("threshold", "logreg"):
        rows = cli.main(["train", "--sessions", str(root), "--model", model, "--features", "wl", "--out", str(profile), "--epochs", "12"])
        assert rows[0]["val_examples"] > 0 and rows[0]["f1"] > 0.5
        assert json.loads(profile.with_suffix(".metrics.json").read_text())["profile"] == str(profile)
        played = cli.main(["replay", "--replay", str(root / "s0"), "--profile", str(profile), "--replay-speed", "0"])
        assert 1 <= max(r["clicks"] for r in played) <= 3
    found = cli.main(["eval", "--sessions", str(root), "--configs", "threshold:wl,logreg:wl,cnn:wl", "--epochs", "5", "--report", str(tmp_path / "r.csv"), "--per-session"])
    assert [r["config"] for r in found] == ["threshold:wl", "logreg:wl"] and all(r["clicks"] == 6 and r["sessions"] == 3 for r in found) and found[0]["detection_rate"] >= 0.5
    assert (tmp_path / "r.csv").read_text().count("\n") == 3
    assert cli.main(["eval", "--sessions", str(root), "--sweep", "threshold:wl", "--sweep-top", "2"])[0]["rank"] == 1
    study = cli.main(["study", "--sessions", str(root), "--models", "threshold,cnn", "--features", "wl", "--fractions", "0.5,1.0", "--epochs", "1", "--hidden", "8", "--out", str(tmp_path / "study.csv")])
    assert [("skipped" in r, r["fraction"]) for r in study] == [(False, 0.5), (True, 0.5), (False, 1.0), (True, 1.0)]
    with pytest.raises(SystemExit) as e:
        cli.main(["replay", "--replay", str(root / "s0"), "--profile", str(tmp_path / "none.json")])
    assert e.value.code == 2
    with pytest.raises(SystemExit) as e:
        cli.main(["train", "--sessions", str(tmp_path / "nothing")])
    assert e.value.code == 2


def test_prompted_recording(spark, tmp_path):
    (tmp_path / "d.txt").write_text("\n".join(f"{4 * i} {1000 + i % 3} 0" for i in range(500)))
    cli.main(["prompt-record", "--port", str(tmp_path / "d.txt"), "--out", str(tmp_path / "s" / "p"), "--settle", "0.25", "--rest", "0.25", "--trials", "2", "--press", "0.25", "--gap", "0.25", "--final-rest", "0.25"])
    records = sessions.read_labels(spark, str(tmp_path / "s")).orderBy("line").collect()
    assert [r.type for r in records][0] == "session_start" and records[-1].type == "session_end" and records[-1].samples == 500
    clicks = islands.label_intervals(sessions.label_intervals_of(sessions.read_labels(spark, str(tmp_path / "s"))))
    assert [(r.start_ms, r.end_ms) for r in clicks.orderBy("ord").collect()] == [(500, 752), (1000, 1252)]
    rows = cli.main(["monitor", "--port", str(tmp_path / "d.txt"), "--log-file", str(tmp_path / "log.csv")])
    assert rows.where("waveform_length = 0").count() > 0 and (tmp_path / "log.csv").exists()
    profile = profiles.Profile("threshold", ["waveform_length"], model={"feature": "waveform_length", "threshold": 2000.0, "softness": 200.0})
    profiles.save(profile, str(tmp_path / "p.json"))
    prompts = ["--prompt", "--prompt-settle-sec", "0.1", "--prompt-rest-sec", "0", "--prompt-trials", "1", "--prompt-press-sec", "0.5", "--prompt-final-rest-sec", "0.1"]
    with pytest.raises(SystemExit):
        cli.main(["monitor", "--port", str(tmp_path / "d.txt"), *prompts])
    shown = cli.main(["monitor", "--port", str(tmp_path / "d.txt"), "--profile", str(tmp_path / "p.json"), "--record-dir", str(tmp_path / "m"), *prompts])
    framed = shown.where("waveform_length > 0").select("active", "down", "up", "probability").collect()
    assert all(r.active in (0, 1) and 0 <= r.probability <= 1 for r in framed) and sum(r.down for r in framed) >= sum(r.up for r in framed)
    (made,) = (tmp_path / "m").iterdir()
    assert json.loads((made / "meta.json").read_text())["prompt_protocol"]["trials"] == 1


def test_live_events_of_a_logistic_profile(spark, tmp_path):
    lines, _ = write_recording(tmp_path, "x", 1)
    path = tmp_path / "device.txt"
    path.write_text("\n".join(x.split("\t")[1] for x in lines) + "\n")
    norm = {"center": {"waveform_length": 2000.0}, "scale": {"waveform_length": 500.0}, "floor": {"waveform_length": 1e-6}}
    profile = profiles.Profile("logreg", ["waveform_length"], norm, {"weights": [3.0], "bias": 0.0})
    spark.dataSource.register(serial.LineSource)
    stream = spark.readStream.format("device_lines").option("path", str(path)).option("session", "s").load()
    query = cli.live_events(stream, profile).writeStream.format("memory").queryName("live").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [r.phase for r in spark.table("live").orderBy("ord").collect()] == ["down", "up", "down", "up"]


def test_logistic_folds_are_fits_on_the_other_sessions(spark):
    rng = random.Random(43)
    rows = [("abc"[i % 3], i, rng.gauss(10 + 5 * (i % 5 == 0), 2), rng.gauss(3, 1), int(i % 5 == 0)) for i in range(90)]
    examples = spark.createDataFrame(rows, "session string, t_ms long, waveform_length double, rms_state double, label int")
    names = ["waveform_length", "rms_state"]
    folds = evaluate.loso_logreg(examples, examples.select("session").distinct(), names, epochs=4)
    frame = examples.withColumn("ord_frame", F.col("t_ms"))
    scored = {r.ord_frame: r.p for r in evaluate.score_folds(frame, folds, names).collect()}
    for s in "abc":
        one = training.fit_logreg(examples.where(F.col("session") != s), names, epochs=4)
        assert folds[s]["weights"] == pytest.approx(one["weights"]) and folds[s]["bias"] == pytest.approx(one["bias"])
        profile = profiles.Profile("logreg", names, {"center": one["center"], "scale": one["scale"], "floor": {f: 1e-6 for f in names}}, {"weights": one["weights"], "bias": one["bias"]})
        for r in score.score_frames(frame.where(F.col("session") == s), profile).collect():
            assert scored[r.ord_frame] == pytest.approx(r.p)
