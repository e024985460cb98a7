"""A device that cannot seek, from the terminal to events."""

import json
import os
import pty
import signal
import threading
import time
import tty

import pytest

from pulseloom import cli
from pulseloom.sources import profiles, serial
from pulseloom.streaming import status

PROFILE = profiles.Profile("threshold", ["waveform_length"], model={"feature": "waveform_length", "threshold": 2000.0, "softness": 200.0})


class Terminal:
    """A pseudo-terminal under a name of its own, that can go away and come back."""

    def __init__(self, path):
        self.path = str(path)
        self.open()

    def open(self):
        self.master, self.slave = pty.openpty()
        tty.setraw(self.slave)
        os.symlink(os.ttyname(self.slave), self.path)

    def close(self):
        os.unlink(self.path)
        os.close(self.slave)
        os.close(self.master)

    def say(self, text):
        data = text.encode()
        while data:
            data = data[os.write(self.master, data[:2000]) :]


def until(what, seconds=30):
    end = time.monotonic() + seconds
    while not (found := what()):
        assert time.monotonic() < end
        time.sleep(0.02)
    return found


def everything(reader, start, n):
    """Rows from ``start`` on until there are ``n``, and the offsets of their batches."""
    rows, offsets = [], [start]

    def more():
        new, end = reader.read(offsets[-1])
        new = list(new)
        if end != offsets[-1]:
            offsets.append(end)
        rows.extend(new)
        return len(rows) >= n

    until(more)
    return rows, offsets


def test_lines_of_a_terminal_are_kept_until_commit(tmp_path, monkeypatch):
    monkeypatch.setattr(serial, "SEGMENT_LINES", 1)
    terminal = Terminal(tmp_path / "tty")
    reader = serial.DeviceReader(terminal.path, "s", journal=str(tmp_path / "journal"), status=str(tmp_path / "c.json"))
    assert list(reader.read({"seq": 0})[0]) == []
    terminal.say("1 100 5\r\n\n2 110")
    first, a = everything(reader, {"seq": 0}, 1)
    terminal.say(" 6\n")
    second, b = everything(reader, a[-1], 1)
    assert [(r[0], r[1], r[3]) for r in first + second] == [("s", 1, "1 100 5"), ("s", 3, "2 110 6")] and all(abs(r[2] - time.time()) < 60 for r in first)
    # The running reader, and one that is started anew, repeat what is not committed.
    again = serial.DeviceReader(terminal.path, "s", journal=str(tmp_path / "journal"))
    for r in (reader, again):
        assert [tuple(x) for x in r.readBetweenOffsets({"seq": 0}, b[-1])] == first + second
        assert [tuple(x) for x in r.readBetweenOffsets(a[-1], b[-1])] == second
    reader.commit(a[-1])
    for r in (reader, again):
        assert [tuple(x) for x in r.readBetweenOffsets(a[-1], b[-1])] == second
        with pytest.raises(RuntimeError):
            r.readBetweenOffsets({"seq": 0}, b[-1])
    # A line that nobody took is there for a query that is started again.
    terminal.say("3 120 7\n")
    until(lambda: len(reader.thread.lines) == 1)
    reader.thread.stop()
    rows, offsets = everything(again, b[-1], 1)
    assert [(r[1], r[3]) for r in rows] == [(4, "3 120 7")] and offsets[-1] == {"seq": 4}
    again.commit(offsets[-1])
    assert len(os.listdir(tmp_path / "journal")) == 1
    again.thread.stop()
    terminal.close()


def test_a_terminal_that_comes_back_costs_no_line_before_or_after(tmp_path):
    terminal = Terminal(tmp_path / "tty")
    reader = serial.DeviceReader(terminal.path, "s", status=str(tmp_path / "c.json"))
    state = lambda: json.loads((tmp_path / "c.json").read_text())
    reader.read({"seq": 0})
    until(lambda: (tmp_path / "c.json").exists() and state()["state"] == "CONNECTED")
    terminal.say("1 1 1\n2 2 2\n3 3")
    until(lambda: len(reader.thread.lines) == 2)
    terminal.close()
    until(lambda: state()["state"] == "DISCONNECTED_RETRYING" and state()["last_error"])
    terminal.open()
    until(lambda: state() == {"state": "CONNECTED", "last_error": None, "connects": 2})
    terminal.say("4 4 4\n")
    rows, offsets = everything(reader, {"seq": 0}, 3)
    # The line that was cut off is no line.
    assert [(r[1], r[3]) for r in rows] == [(1, "1 1 1"), (2, "2 2 2"), (3, "4 4 4")] and offsets[-1] == {"seq": 3}
    reader.thread.stop()
    terminal.close()


def test_a_device_that_is_read_too_slowly_waits(tmp_path, monkeypatch):
    monkeypatch.setattr(serial, "MOST_LINES", 1000)
    os.mkfifo(tmp_path / "pipe")
    reader = serial.DeviceReader(str(tmp_path / "pipe"), "s")
    reader.read({"seq": 0})
    feed = threading.Thread(target=lambda: (tmp_path / "pipe").write_text("".join(f"{i} 1 1\n" for i in range(40_000))))
    feed.start()
    rows, offsets = everything(reader, {"seq": 0}, 40_000)
    feed.join()
    assert [r[1] for r in rows] == list(range(1, 40_001)) and len(offsets) > 2
    reader.thread.stop()


def square_wave(presses, start=0):
    """Lines of presses a second and a half apart."""
    out = []
    for i in range(int(250 * 1.5 * presses)):
        loud = 100 <= i % 375 < 200
        out.append(f"{start + 4 * i} {2000 + (900 if loud else 5) * (-1) ** i} 10\n")
    return out


def test_switch_from_a_terminal_to_events(spark, tmp_path, capsys):
    """Events come out while the device runs; the terminal is closed and opened between presses; SIGTERM ends it."""
    terminal = Terminal(tmp_path / "tty")
    profiles.save(PROFILE, str(tmp_path / "p.json"))
    printed = []

    def events():
        printed.extend(x for x in capsys.readouterr().out.splitlines() if x.startswith("{"))
        return [json.loads(x) for x in printed]

    def act():
        try:
            until(lambda: (tmp_path / "live" / "connection.json").exists(), 60)
            for line in square_wave(2):
                terminal.say(line)
            until(lambda: sum(e["phase"] == "up" for e in events()) == 2, 90)
            terminal.close()
            terminal.open()
            until(lambda: json.loads((tmp_path / "live" / "connection.json").read_text())["connects"] == 2)
            terminal.say("junk\n" + "".join(square_wave(2, 3000)))
            until(lambda: sum(e["phase"] == "up" for e in events()) == 4, 90)
        finally:
            os.kill(os.getpid(), signal.SIGTERM)

    # Without the handler a signal would end the tests.
    before = signal.signal(signal.SIGTERM, signal.SIG_IGN)
    other = threading.Thread(target=act)
    other.start()
    try:
        seen = cli.main(["switch", "--port", terminal.path, "--profile", str(tmp_path / "p.json"), "--checkpoint", str(tmp_path / "live"), "--lock-dir", str(tmp_path)])
    finally:
        other.join()
        signal.signal(signal.SIGTERM, before)
    assert [e["phase"] for e in events()] == ["down", "up"] * 4 and all(e["host_time_s"] > 1e9 for e in events())
    assert seen["lines"] == 1501 and seen["parse_errors"] == 1 and seen["last_bad_line"] == "junk" and seen["state"] == "CONNECTED"
    assert not list(tmp_path.glob("*.lock"))
    terminal.close()


def test_a_batch_that_failed_is_repeated_with_the_same_rows(spark, tmp_path):
    terminal = Terminal(tmp_path / "tty")
    tries = []

    def sink(batch, number):
        rows = [(r.arrival_seq, r.line) for r in batch.orderBy("arrival_seq").collect()]
        if rows:
            tries.append((number, rows))
            if len(tries) == 1:
                raise RuntimeError("lost")

    lines, _ = cli.device(spark, terminal.path, str(tmp_path / "live"), "s", 230400)
    start = lambda: lines.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "live" / "state")).start()
    query = start()
    terminal.say("1 1 1\n2 2 2\n")
    until(lambda: query.exception() is not None, 60)
    query = start()
    until(lambda: len(tries) >= 2, 60)
    terminal.say("3 3 3\n")
    until(lambda: tries[-1][1][-1][0] == 3, 60)
    query.stop()
    assert tries[0] == tries[1] and [x for _, rows in tries[1:] for x in rows] == [(1, "1 1 1"), (2, "2 2 2"), (3, "3 3 3")]
    terminal.close()


def test_status_while_a_query_runs(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("1 1 1\nbad one\n2 2 2\nbad two\n")
    spark.dataSource.register(serial.LineSource)
    seen = status.LiveStatus()
    spark.streams.addListener(seen)
    query = status.observed(spark.readStream.format("device_lines").option("path", str(path)).load()).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until(lambda: seen.now()["lines"] == 4, 60)
        assert seen.now()["running"] and seen.now()["parse_errors"] == 2 and seen.now()["last_bad_line"] == "bad two"
        with open(path, "a") as f:
            f.write("3 3 3\nbad three\n")
        until(lambda: seen.now()["lines"] == 6, 60)
        assert seen.now()["last_bad_line"] == "bad three" and seen.now()["lines_per_s"] > 0
    finally:
        query.stop()
        spark.streams.removeListener(seen)
