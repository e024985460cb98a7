"""What a running query has met: lines, errors, the last bad line, lines a second and the connection (O-STR-7/8, O-AGG-14)."""

from __future__ import annotations

import json
import threading
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import frames

#: Name of the observation that the listener looks for.
SEEN = "lines_seen"


def observed(lines: DataFrame) -> DataFrame:
    """``lines(session, arrival_seq, line)``, counted as they go by: all, those that don't parse, and the last of these."""
    bad = frames.parse_line(F.col("line")).isNull()
    return lines.observe(
        SEEN, F.count("*").alias("lines"), F.count_if(bad).alias("parse_errors"), F.max_by(F.when(bad, F.col("line")), F.when(bad, F.col("arrival_seq"))).alias("last_bad_line")
    )


class LiveStatus(StreamingQueryListener):
    """Adds up what the queries of a session observe; ``now()`` may be called at any time. ``connection`` is the file that
    the device source writes, where there is one."""

    def __init__(self, connection: str | None = None, clock=time.monotonic) -> None:
        self.connection, self.clock, self.lock = connection, clock, threading.Lock()
        self.lines = self.parse_errors = self.batches = 0
        self.last_bad_line: str | None = None
        self.rate, self.since, self.ended, self.running = 0.0, None, threading.Event(), False

    def onQueryStarted(self, event) -> None:
        self.running = True

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(SEEN)
        if row is None:
            return
        with self.lock:
            now = self.clock()
            if row["lines"]:
                if self.since is not None:
                    self.rate = row["lines"] / max(now - self.since, 1e-6)
                self.since = now
            self.batches += 1
            self.lines += row["lines"]
            self.parse_errors += row["parse_errors"]
            self.last_bad_line = row["last_bad_line"] if row["last_bad_line"] is not None else self.last_bad_line

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.running = False
        self.ended.set()

    def now(self) -> dict:
        with self.lock:
            found = {"lines": self.lines, "parse_errors": self.parse_errors, "last_bad_line": self.last_bad_line, "lines_per_s": round(self.rate, 1), "running": self.running}
        if self.connection:
            try:
                with open(self.connection) as f:
                    found |= json.load(f)
            except FileNotFoundError:
                found["state"] = "CONNECTING"
        return found
