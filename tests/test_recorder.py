"""Recording live: the recorder on its own, its stream, timers, keys and files."""

import csv
import json
import os
import pty
import threading
import time

import pytest
from pyspark.sql import functions as F

from pulseloom import cli
from pulseloom.operators import protocol
from pulseloom.sources import keyboard, sessions
from pulseloom.streaming import recorder

from .test_device import Terminal, square_wave, until

NAMES = list(recorder._COLUMNS)


def labels(rows):
    out = []
    for r in rows:
        d = dict(zip(NAMES, r))
        if d["kind"] == "label":
            out.append((d["type"], d["host_time_s"], d["t_ms"], *[d[c] for c in ("label", "phase", "closed_by") if d[c]]))
    return out


def test_a_toggled_session():
    r = recorder.Recorder("toggle")
    rows = [x for i in range(5) for x in r.line(10 + i, (i, 1000, 5), f"{i} 1000 5")] + r.line(15, None, "junk") + r.control(15, "toggle") + r.control(15, "release")
    rows += r.line(16, (5, 1, 1), "5 1 1") + r.control(16.5, "toggle") + r.control(17, "toggle") + r.line(18, (6, 1, 1), "6 1 1") + r.control(19, "quit")
    assert labels(rows) == [
        ("session_start", 10, None), ("label_start", 15, 4, "CLICK"), ("label_end", 16.5, 5, "CLICK"), ("label_start", 17, 5, "CLICK"), ("label_end", 19, 6, "CLICK", "session_end"), ("session_end", 19, 6),
    ]
    assert dict(zip(NAMES, rows[-1])) | {"samples": 7, "labels": 2, "parse_errors": 1} == dict(zip(NAMES, rows[-1]))
    assert [x[0] for x in rows] == list(range(1, len(rows) + 1)) and r.due() is None


def test_a_held_session_and_its_time():
    r = recorder.Recorder("hold", duration_s=4.0)
    rows = r.line(1, (0, 1, 1), "0 1 1") + r.control(1, "press") + r.control(2, "press") + r.control(2.5, "release") + r.control(3, "release") + r.control(4, "press")
    assert r.due() == 5 + recorder.GRACE_S and r.expire(5.9) == []
    rows += r.expire(6.0)
    assert labels(rows)[1:] == [("label_start", 1, 0, "CLICK"), ("label_end", 2.5, 0, "CLICK"), ("label_start", 4, 0, "CLICK"), ("label_end", 5, 0, "CLICK", "session_end"), ("session_end", 5, 0)]
    late = recorder.Recorder("hold", duration_s=4.0)
    assert labels(late.line(1, (0, 1, 1), "") + late.line(5, (9, 1, 1), ""))[-1] == ("session_end", 5, 0)


def test_a_prompted_session_with_and_without_samples():
    script = protocol.build(settle=1, rest=1, trials=2, press=1, gap=1, final_rest=1)
    one, two = (recorder.Recorder("prompted", phases=script) for _ in range(2))
    rows = [x for i in range(61) for x in one.line(100 + i / 10, (100 * i, 1, 1), "")]
    assert [x[0] for x in labels(rows)].count("prompt_phase") == 6 and labels(rows)[-1] == ("session_end", 106, 6000)
    starts = [x for x in labels(rows) if x[0].startswith("label")]
    assert starts == [("label_start", 102, 2000, "CLICK"), ("label_end", 103, 3000, "CLICK", "phase_transition"), ("label_start", 104, 4000, "CLICK"), ("label_end", 105, 5000, "CLICK", "phase_transition")]
    # The device goes quiet within the first click: its end comes at the phase's, the session's with the protocol's.
    rows = two.line(100, (0, 1, 1), "") + two.line(102.5, (2500, 1, 1), "")
    assert two.due() == 103 + recorder.GRACE_S
    rows += two.expire(104)
    assert two.due() == 106 + recorder.GRACE_S
    rows += two.expire(200)
    assert labels(rows)[-2:] == [("label_end", 103, 2500, "CLICK", "phase_transition"), ("session_end", 106, 2500)]


def test_state_is_carried_whole():
    """A recorder that is dumped and loaded after every row says the same."""
    script = protocol.build(settle=0.5, rest=0.5, trials=2, press=0.5, gap=0.5, final_rest=0.5)
    make = lambda: recorder.Recorder("prompted", phases=script)
    one, two, out = make(), make(), ([], [])
    for i, text in enumerate(square_wave(2)):
        t, raw, env = map(int, text.split())
        out[0].extend(one.line(i / 250, (t, raw, env), text))
        out[1].extend(two.line(i / 250, (t, raw, env), text))
        if i % 37 == 0:
            row, lists = two.dump()
            two = make()
            two.load(row, lists)
    assert out[0] == out[1] and sum(r[1] == "feature" for r in out[0]) > 60


def files_of(path):
    raw = list(csv.DictReader(open(path / "raw.csv")))
    features = list(csv.DictReader(open(path / "features.csv")))
    records = [json.loads(x) for x in open(path / "labels.jsonl")]
    return raw, features, records, json.loads((path / "meta.json").read_text())


def test_a_prompted_recording_of_a_terminal_that_falls_silent(spark, tmp_path):
    """Timers end the open label and the session; files are plain ones that any tool reads, and host times are the lines'."""
    terminal = Terminal(tmp_path / "tty")
    done = threading.Event()

    def act():
        until(lambda: (tmp_path / "live" / "connection.json").exists(), 60)
        for line in square_wave(1)[:200]:
            terminal.say(line)
            time.sleep(0.004)
        done.set()

    other = threading.Thread(target=act)
    other.start()
    options = ["--settle", "0.3", "--rest", "0", "--trials", "1", "--press", "4", "--gap", "0", "--final-rest", "1"]
    cli.main(["prompt-record", "--port", terminal.path, "--out", str(tmp_path / "s" / "one"), "--checkpoint", str(tmp_path / "live"), "--lock-dir", str(tmp_path), *options])
    other.join()
    raw, features, records, meta = files_of(tmp_path / "s" / "one")
    assert len(raw) == 200 and [int(r["t_ms"]) for r in raw] == [4 * i for i in range(200)] and raw[3]["line"] == f"12 {raw[3]['raw']} 10"
    assert [r["type"] for r in records] == ["session_start", "prompt_phase", "prompt_phase", "label_start", "label_end", "session_end"]
    assert records[4]["closed_by"] == "phase_transition" and records[4]["t_ms"] == 796 and records[5]["samples"] == 200 and records[5]["labels"] == 1
    start = float(raw[0]["host_time_s"])
    assert records[4]["host_time_s"] == pytest.approx(start + 4.3, abs=0.01) and records[5]["host_time_s"] == pytest.approx(start + 5.3, abs=0.01)
    hosts = {r["host_time_s"] for r in raw}
    assert len(features) == records[5]["frames"] > 15 and all(f["host_time_s"] in hosts for f in features) and len({f["host_time_s"] for f in features}) > 3
    assert meta["prompt_protocol"]["press_sec"] == 4.0 and meta["prompt_protocol"]["phases"][1] == {"name": "CLICK 1/1", "duration_s": 4.0, "label": "CLICK"}
    assert sessions.read_raw(spark, str(tmp_path / "s")).count() == 200
    terminal.close()


def test_keys_of_a_terminal(tmp_path):
    master, slave = pty.openpty()
    os.mkfifo(tmp_path / "keys")
    fd = os.open(tmp_path / "keys", os.O_RDONLY | os.O_NONBLOCK)
    said = lambda: os.read(fd, 1000).decode()
    with keyboard.Keys(str(tmp_path / "keys"), "c", "q", fd=slave) as keys:
        os.write(master, b"cxcq")
        keys.thread.join(0.6)
        assert said() == "toggle\ntoggle\nquit\n"
        keys.say("quit")
        assert said() == "quit\n"
    with keyboard.Keys(str(tmp_path / "keys"), "c", "q", hold=True, fd=slave) as keys:
        os.write(master, b"ccc")
        keys.thread.join(1.2)
        assert said() == "press\nrelease\n"
    for x in (master, slave, fd):
        os.close(x)


def test_a_recording_that_is_started_again_loses_and_doubles_nothing(spark, tmp_path):
    """A micro-batch fails after it was written; the query that goes on writes it again under its number."""
    terminal, tries = Terminal(tmp_path / "tty"), []
    os.mkfifo(tmp_path / "keys")
    lines, _ = cli.device(spark, terminal.path, str(tmp_path / "live"), "one", 230400)
    controls = spark.readStream.format("device_lines").options(path=str(tmp_path / "keys"), session="one", journal=str(tmp_path / "live" / "k")).load()
    keep = recorder.sink(str(tmp_path / "parts"))

    def put(batch, number):
        keep(batch, number)
        n = spark.read.parquet(str(tmp_path / "parts")).where("kind = 'raw'").count()
        tries.append(n)
        if n and not any(tries[:-1]):
            raise RuntimeError("lost")

    make = lambda: recorder.Recorder("toggle")
    start = lambda: recorder.recorded(lines, controls, make).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0.2 seconds").start()
    query = start()
    for line in square_wave(1)[:60]:
        terminal.say(line)
    until(lambda: query.exception() is not None, 60)
    query = start()
    for line in square_wave(1)[60:120]:
        terminal.say(line)
    until(lambda: tries[-1] == 120, 60)
    with keyboard.Keys(str(tmp_path / "keys"), "", "") as keys:
        keys.say("toggle")
        keys.say("quit")
        until(lambda: not spark.read.parquet(str(tmp_path / "parts")).where("type = 'session_end'").isEmpty(), 60)
    query.stop()
    counts = recorder.assemble(spark, str(tmp_path / "parts"), str(tmp_path / "s" / "one"), "{}")
    raw, features, records, _ = files_of(tmp_path / "s" / "one")
    assert [int(r["t_ms"]) for r in raw] == [4 * i for i in range(120)] and counts["samples"] == 120 and counts["frames"] == len(features) and counts["labels"] == 1
    marks = sessions.read_labels(spark, str(tmp_path / "s"))
    assert [(r.type, r.t_ms) for r in marks.orderBy("line").collect()] == [("session_start", None), ("label_start", 476), ("label_end", 476), ("session_end", 476)]
    assert marks.where(F.col("host_time_s").isNull()).isEmpty()
    terminal.close()
