"""The detector on state that is stored: seeds, resets, time to live, other detectors; paced replays and functions of SQL."""

import random
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseloom import cli
from pulseloom.functions import sql
from pulseloom.operators import decide, dsp, frames, protocol
from pulseloom.sources import profiles
from pulseloom.streaming import detector, status

SAMPLES = "session string, arrival_seq long, t_ms long, raw long, control string"


def wave(presses, seed=1):
    rng = random.Random(seed)
    return [(4 * i, 2000 + round(rng.gauss(0, 400 if 100 <= i % 375 < 200 else 3))) for i in range(375 * presses)]


def streamed(spark, tmp_path, rows, batches, **more):
    """What ``detect`` makes of ``rows`` that come in ``batches`` micro-batches."""
    size = -(-len(rows) // batches)
    live = detector.streaming_session(spark)
    for i in range(batches):
        spark.createDataFrame(rows[i * size : (i + 1) * size], SAMPLES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    if "initial" in more:
        # Initial state belongs to the stream's session.
        more["initial"].write.parquet(str(tmp_path / "initial"))
        more["initial"] = live.read.parquet(str(tmp_path / "initial"))
    found = detector.detect(stream, **more)
    writer = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    if "ttl_ms" not in more:
        assert writer.trigger(availableNow=True).start().awaitTermination(90)
    else:
        # With time to live there is always another batch to come, so the end is known by the rows that were read.
        query, end = writer.start(), time.monotonic() + 60
        try:
            while sum(p["numInputRows"] for p in query.recentProgress) < len(rows):
                assert query.isActive and time.monotonic() < end
                time.sleep(0.2)
        finally:
            query.stop()
    return sorted(tuple(r) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect())


MODEL = detector.threshold(2000.0, 200.0)


def test_seeds_and_resets_equal_a_loop(spark, tmp_path):
    given = pd.DataFrame([("s", 1990.0, 30.0, 12.0, -4, [float(i) for i in range(200)])], columns=["session", "baseline", "center", "scale", "t_ms", "seed"])
    one, expected, rows = detector.Detector(MODEL), [], []
    one.seed(given.itertuples(index=False).__next__())
    assert one.extractor.filters.rest_center == 30.0 and len(one.extractor.filters.rest.rows) == 128
    for i, (t, raw) in enumerate(wave(4)):
        rows.append(("s", 2 * i, t, raw, None))
        expected += one.update(t, raw)
        if i == 700:
            rows.append(("s", 2 * i + 1, None, None, "reset"))
            one.control("reset")
    rows.append(("s", 10_000, None, None, "flush"))
    expected += one.control("flush")
    initial = spark.createDataFrame(given, "session string, baseline double, center double, scale double, t_ms long, seed array<double>")
    got = streamed(spark, tmp_path, rows, 3, model=MODEL, initial=initial, counts=True)
    assert got == sorted(("s", *e) for e in expected) and [g[6] for g in got if g[2] == "up"] == [1, 2, 1, 2]
    # The seed tells: without it the filters begin elsewhere.
    plain = detector.Detector(MODEL)
    plain.update(*wave(1)[0])
    assert plain.extractor.filters.baseline != one.extractor.filters.baseline


def test_state_is_carried_whole():
    one, two, out = detector.Detector(MODEL), detector.Detector(MODEL), ([], [])
    for i, (t, raw) in enumerate(wave(2)):
        t -= 100_000 if i > 500 else 0
        out[0].extend(one.update(t, raw))
        out[1].extend(two.update(t, raw))
        if i % 41 == 0:
            row, lists = two.dump()
            two = detector.Detector(MODEL)
            two.load(row, lists)
    assert out[0] == out[1] and len(out[0]) > 3 and one.dump() == two.dump()


class Loudest(detector.Detector):
    """Not a detector of events at all: the loudest sample so far, after each one that is louder."""

    SCALARS, LISTS, OUTPUT = "loudest bigint", {}, "t_ms bigint, loudest bigint"

    def __init__(self):
        self.loudest = 0

    def update(self, t, raw):
        if raw <= self.loudest:
            return []
        self.loudest = raw
        return [(t, raw)]

    def dump(self):
        return (self.loudest,), {}

    def load(self, row, lists):
        (self.loudest,) = row


def test_other_detectors_and_time_to_live(spark, tmp_path):
    rows = [("s", i, t, raw, None) for i, (t, raw) in enumerate(wave(1))]
    expected, top = [], 0
    for _, _, t, raw, _ in rows:
        if raw > top:
            expected.append(("s", t, raw))
            top = raw
    got = streamed(spark, tmp_path / "a", rows, 3, model=None, make=Loudest)
    assert got == sorted(expected)
    # Forgotten after a millisecond, each micro-batch begins anew.
    forgetful = streamed(spark, tmp_path / "b", rows, 3, model=None, make=Loudest, ttl_ms=1)
    assert len(forgetful) > len(got)


def test_click_counts_after_resets(spark):
    events = spark.createDataFrame([("s", i + 1, "up" if i % 2 else "down", 10 * i, 5) for i in range(8)] + [("r", 1, "up", 7, 5)], "session string, ord long, phase string, t_ms long, duration_ms long")
    resets = spark.createDataFrame([("s", 35), ("s", 36), ("s", 70), ("x", 1)], "session string, t_ms long")
    got = {(r.session, r.ord): (r.clicks, r.last_duration_ms) for r in decide.click_counts(events, resets).collect()}
    assert [got["s", i][0] for i in range(1, 9)] == [0, 1, 1, 2, 0, 1, 1, 2] and got["s", 5] == (0, None) and got["r", 1] == (1, 5)


def test_ticks_against_a_queue(spark):
    """A tick every 10 ms takes the samples whose time has come from a queue, 25 at most."""
    rng = random.Random(4)
    times = sorted(rng.randrange(300) for _ in range(700))
    queue, left, expected, tick = [], list(range(len(times))), {}, 0
    while left or queue:
        while left and times[left[0]] - times[0] <= 10 * tick:
            queue.append(left.pop(0))
        for i in queue[:25]:
            expected[i] = tick
        queue, tick = queue[25:], tick + 1
    samples = spark.createDataFrame([("s", i, t, 5) for i, t in enumerate(times)] + [("r", 3, None, 5)], "session string, arrival_seq long, t_ms long, raw long")
    rows = detector.ticks(samples).collect()
    assert {r.arrival_seq: r.tick for r in rows if r.control is None} == expected
    assert [(r.session, r.tick) for r in rows if r.control] == [("s", max(expected.values()) + 1)]


def test_functions_of_sql(spark):
    sql.register(spark)
    sql.register(spark)
    lines = ["1 2 3", " \t1_000   -2 +3 ", "1 2", "1 2 3 4", "", None, "a b c", "1__0 2 3", "99999999999999999999 1 1", "1.5 2 3"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = spark.sql("SELECT line, parse_line(line) AS p FROM {df}", df=df).collect()
    assert {r.line: r.p for r in got} == {r.line: r.p for r in df.select("line", frames.parse_line(F.col("line")).alias("p")).collect()}
    for xs, share in (([], 0.5), ([3.0, 1.0, 2.0], 0.5), ([3.0, 1.0, 2.0, 4.0], 0.9), ([1.0], 0.0)):
        assert spark.sql(f"SELECT lower_percentile(array({', '.join(f'{x}D' for x in xs)}), {share})").first()[0] == (sorted(xs)[int((len(xs) - 1) * share)] if xs else 0.0)
    for given in ({}, {"settle": 0, "trials": 3, "artifact": 2}, {"rest": 0, "final_rest": 0, "gap": 0, "trials": 1, "press": 0}, {"trials": 0}):
        text = ", ".join(f"{k} => {v}" for k, v in given.items())
        assert [tuple(r) for r in spark.sql(f"SELECT * FROM build_protocol({text}) ORDER BY idx").collect()] == protocol.build(**given)


def test_long_protocols_are_joined_by_stretches(spark, monkeypatch):
    rng = random.Random(8)
    script = [(i, f"P{i}", rng.choice((0.1, 0.5, 3.0)), None) for i in range(60)]
    times = spark.createDataFrame([(rng.uniform(-1, 80),) for _ in range(300)] + [(0.0,)], "elapsed_s double")
    phases = spark.createDataFrame(script, protocol.SCHEMA)
    one = sorted(map(tuple, protocol.phase_at(times, phases).collect()))
    monkeypatch.setattr(protocol, "BROADCAST_PHASES", 10)
    assert sorted(map(tuple, protocol.phase_at(times, phases).collect()), key=repr) == sorted(one, key=repr)


def test_the_simulated_device_warms_up(spark):
    """The follower's base begins near the mid level, whatever the first sample says."""
    first = dsp.device_lines(spark, 0.02).orderBy("arrival_seq").first().line.split()
    assert int(first[2]) == int(0.1 * abs(int(first[1]) - 2048)) or abs(int(first[2]) - 0.1 * abs(int(first[1]) - 2048)) <= 1


def test_a_store_that_keeps_one_state_is_refused(spark):
    plain = spark.newSession()
    with pytest.raises(ValueError):
        plain.conf.set(detector.STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
        detector.detect(plain.readStream.format("rate").load().selectExpr("'s' AS session", "value AS arrival_seq", "value AS t_ms", "value AS raw"), MODEL)


def test_a_paced_replay_says_what_one_at_once_says(spark, tmp_path, capsys):
    """Through the live detector, at four times the recording's pace; the last press is open when it ends."""
    (tmp_path / "s").mkdir()
    rows = [*wave(2), *((3000 + t, raw) for t, raw in wave(1)[:170])]
    (tmp_path / "s" / "raw.csv").write_text("host_time_s,t_ms,raw,env,line\n" + "".join(f"0,{t},{raw},1,x\n" for t, raw in rows))
    (tmp_path / "s" / "labels.jsonl").write_text("")
    profiles.save(profiles.Profile("threshold", ["waveform_length"], model={"feature": "waveform_length", "threshold": 2000.0, "softness": 200.0}), str(tmp_path / "p.json"))
    given = ["replay", "--replay", str(tmp_path / "s"), "--profile", str(tmp_path / "p.json"), "--replay-speed"]
    at_once = cli.main([*given, "0"])
    capsys.readouterr()
    began = time.monotonic()
    paced = cli.main([*given, "4"])
    assert time.monotonic() - began >= 3.6 / 4
    shown = lambda found: [(r["ord"], r["phase"], r["t_ms"], r["duration_ms"], r["clicks"]) for r in found]
    assert shown(paced) == shown(at_once) and [r["phase"] for r in paced] == ["down", "up"] * 3
    assert capsys.readouterr().out.count('"phase"') == 6


def test_a_replay_ends_though_its_clock_goes_on(spark, tmp_path):
    """Each batch takes longer than the clock takes for the next rows, so there are always some to come."""
    over, found = threading.Event(), []

    def slow(batch, number):
        batch.count()
        time.sleep(2)
        if number == 2:
            over.set()

    clock = spark.readStream.format("rate").option("rowsPerSecond", 10).load()
    writer = clock.writeStream.foreachBatch(slow).option("checkpointLocation", str(tmp_path / "state"))
    run = threading.Thread(target=lambda: found.append(cli.run_live(spark, writer, status.LiveStatus(), False, over)), daemon=True)
    run.start()
    run.join(40)
    ended = not run.is_alive()
    for query in spark.streams.active:
        query.stop()
    run.join(20)
    assert ended and found and over.is_set()
