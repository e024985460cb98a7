"""Recording a live stream: lines and controls in, raw rows, feature rows and label records out (O-REC-*, O-ISL-4, O-SNK-1).

A session's recorder is state like a detector's. Time is the host's: a control belongs to the last sample before it, a
phase of a protocol lasts so long after the first sample. Timers close what no sample closes: an open label at the end of
its phase, and the session at the end of its protocol or of its time, when the device has gone quiet. All that a
micro-batch gives is one table, written by its number: a batch that is repeated writes it again, and nothing is lost or
doubled. At the end the tables become the session's files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames
from ..sources import sessions
from .detector import Extractor, SessionProcessor, ddl

#: Seconds that a timer waits for lines that are on their way.
GRACE_S = 1.0
_FRAME = ("env_in", "filtered_raw_hp", "rms_state", "lf_energy_ratio", "slope_burst", "waveform_length")
_COLUMNS = {
    "n": "bigint", "kind": "string", "host_time_s": "double", "t_ms": "bigint", "raw": "bigint", "env": "bigint", "line": "string", "window_start_ms": "bigint", "window_end_ms": "bigint",
    "env_in": "bigint", **{c: "double" for c in _FRAME[1:]}, "type": "string", "label": "string", "phase": "string", "duration_s": "double", "closed_by": "string",
    "samples": "bigint", "frames": "bigint", "labels": "bigint", "parse_errors": "bigint",
}
MODES = ("toggle", "hold", "prompted")


class Recorder:
    """What a recording session carries between micro-batches."""

    _OWN = {
        "started": "double", "protocol": "double", "phase": "bigint", "open": "string", "held": "boolean", "last_t": "bigint", "samples": "bigint", "frames": "bigint", "labels": "bigint",
        "parse_errors": "bigint", "n": "bigint", "done": "boolean",
    }
    SCALARS = f"{ddl(own=_OWN)}, {Extractor.ROW}"
    LISTS = Extractor.LISTS
    OUTPUT = ", ".join(f"{c} {k}" for c, k in _COLUMNS.items())

    def __init__(self, mode: str, label: str = "CLICK", phases: Sequence[tuple] = (), duration_s: float | None = None) -> None:
        """``phases(idx, name, duration_s, label)`` are those of a prompted session, which ends with them."""
        if mode not in MODES:
            raise ValueError(f"no mode {mode!r}")
        self.mode, self.label, self.phases, self.duration_s = mode, label, list(phases), duration_s
        self.ends = np.cumsum([p[2] for p in self.phases]).tolist()
        self.extractor = Extractor()
        self.started = self.protocol = self.phase = self.open = self.last_t = None
        self.samples = self.frames = self.labels = self.parse_errors = self.n = 0
        self.held = self.done = False

    def _row(self, kind: str, host: float, **given) -> tuple:
        self.n += 1
        given |= {"n": self.n, "kind": kind, "host_time_s": host}
        return tuple(given.get(c) for c in _COLUMNS)

    def _record(self, kind: str, host: float, **given) -> tuple:
        return self._row("label", host, type=kind, t_ms=given.pop("t_ms", self.last_t), **given)

    def _start(self, host: float, label: str) -> list[tuple]:
        self.open = label
        return [self._record("label_start", host, label=label)]

    def _stop(self, host: float, why: str | None = None) -> list[tuple]:
        """Ends the open interval, if any."""
        if self.open is None:
            return []
        label, self.open = self.open, None
        self.labels += 1
        return [self._record("label_end", host, label=label, closed_by=why)]

    def end(self, host: float) -> list[tuple]:
        """The session's last records."""
        out = self._begin(host) + self._stop(host, "session_end")
        self.done = True
        return out + [self._record("session_end", host, samples=self.samples, frames=self.frames, labels=self.labels, parse_errors=self.parse_errors)]

    def _begin(self, host: float) -> list[tuple]:
        if self.started is not None:
            return []
        self.started = host
        return [self._record("session_start", host, t_ms=None)]

    def line(self, host: float, sample: tuple[int, int, int] | None, text: str) -> list[tuple]:
        """Rows of a line, which is a sample or does not parse."""
        out = self._begin(host)
        if self.duration_s is not None and host - self.started >= self.duration_s:
            return out + self.end(self.started + self.duration_s)
        if sample is None:
            self.parse_errors += 1
            return out
        t, raw, env = sample
        self.last_t, self.samples = t, self.samples + 1
        out.append(self._row("raw", host, t_ms=t, raw=raw, env=env, line=text))
        for end, frame in self.extractor.update(t, raw, env):
            self.frames += 1
            out.append(self._row("feature", host, t_ms=end, window_start_ms=end - max(self.extractor.window_ms, 20), window_end_ms=end, **{c: frame[c] for c in _FRAME}))
        return out + (self._prompted(host) if self.mode == "prompted" else [])

    def _prompted(self, host: float) -> list[tuple]:
        self.protocol = host if self.protocol is None else self.protocol
        now = next((i for i, end in enumerate(self.ends) if host - self.protocol < end), None)
        if now is None:
            return self.end(host)
        if now == self.phase:
            return []
        out = self._stop(host, "phase_transition")
        self.phase = now
        _, name, duration, label = self.phases[now]
        out.append(self._record("prompt_phase", host, phase=name, duration_s=duration, label=label))
        return out + (self._start(host, label) if label is not None else [])

    def control(self, host: float, action: str) -> list[tuple]:
        """``quit`` ends a session; ``toggle``, or ``press`` and ``release``, start and end intervals."""
        out = self._begin(host)
        if action == "quit":
            return out + self.end(host)
        if self.mode == "toggle" and action == "toggle":
            return out + (self._stop(host) or self._start(host, self.label))
        if self.mode == "hold" and action in ("press", "release"):
            # A key that repeats itself while it is held is one press.
            new, self.held = (action == "press") != self.held, action == "press"
            return out + ((self._start(host, self.label) if self.held else self._stop(host)) if new else [])
        return out

    def rows(self, batches: list[pd.DataFrame]) -> list[tuple]:
        """Lines and controls of a micro-batch in the order of the host's time; at the same time a line comes first."""
        every = [r for b in batches for r in b[["host_time_s", "is_control", "seq", "ok", "t_ms", "raw", "env", "text"]].itertuples(index=False, name=None)]
        out: list[tuple] = []
        for host, is_control, _, ok, t, raw, env, text in sorted(every, key=lambda r: r[:3]):
            if not self.done:
                out += self.control(host, text) if is_control else self.line(host, (int(t), int(raw), int(env)) if ok else None, text)
        return out

    def due(self) -> float | None:
        if self.done or self.started is None:
            return None
        at = [self.started + self.duration_s] if self.duration_s is not None else []
        if self.protocol is not None and self.ends:
            at.append(self.protocol + (self.ends[self.phase] if self.open is not None else self.ends[-1]))
        return min(at) + GRACE_S if at else None

    def expire(self, now: float) -> list[tuple]:
        out: list[tuple] = []
        while (at := self.due()) is not None and at <= now:
            at -= GRACE_S
            over = self.duration_s is not None and at >= self.started + self.duration_s
            if over or self.open is None or self.mode != "prompted" or self.phase == len(self.ends) - 1:
                out += self.end(at)
            else:
                out += self._stop(at, "phase_transition")
        return out

    def dump(self) -> tuple[tuple, dict[str, list[tuple]]]:
        row, lists = self.extractor.dump()
        return (*[getattr(self, c) for c in self._OWN], *row), lists

    def load(self, row: tuple, lists: dict[str, list[tuple]]) -> None:
        values = iter(row)
        for c in self._OWN:
            setattr(self, c, next(values))
        self.extractor.load(values, lists)


def recorded(lines: DataFrame, controls: DataFrame, make: Callable[[], Recorder]) -> DataFrame:
    """Rows of the recorders of all sessions, in ``kind`` raw, feature and label, from streams of ``(session, arrival_seq,
    host_time_s, line)``; a control's line is its action. The session must use the RocksDB state store."""
    parsed = lines.withColumn("p", frames.parse_line(F.col("line")))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    shaped = lambda rows, control, ok, values: rows.select(
        "session", F.col("arrival_seq").alias("seq"), F.coalesce("host_time_s", F.lit(0.0)).alias("host_time_s"), F.lit(control).alias("is_control"), ok.alias("ok"),
        *[number(v).alias(c) for c, v in zip(("t_ms", "raw", "env"), values)], F.col("line").alias("text"),
    )
    a = shaped(parsed, False, F.col("p").isNotNull(), [F.col(f"p.{c}") for c in ("t_ms", "raw", "env")])
    b = shaped(controls, True, F.lit(False), [F.lit(0)] * 3)
    kind = dict(lines.dtypes)["session"]
    return a.union(b).groupBy("session").transformWithStateInPandas(SessionProcessor(make, timed=True), f"session {kind}, {Recorder.OUTPUT}", "append", "ProcessingTime")


def sink(root: str) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch's rows, all three kinds at once, under its number; a repeated one replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return put


def assemble(spark: SparkSession, parts: str, path: str, described: str) -> dict:
    """The files of a session from the tables that its recording left in ``parts``, and its last record's counts."""
    held = spark.read.schema(f"session string, {Recorder.OUTPUT}, batch bigint").parquet(parts)
    six = lambda rows: rows.withColumn("host_time_s", F.format_string("%.6f", "host_time_s"))
    raw = six(held.where("kind = 'raw'")).withColumn("arrival_seq", F.col("n"))
    records = held.where("kind = 'label'").select("session", F.col("n").alias("line"), "type", "label", "host_time_s", "t_ms", "phase", "duration_s", "closed_by", "samples", "frames", "labels", "parse_errors")
    sessions.write_session(path, raw, six(held.where("kind = 'feature'")), records, described, ("n",))
    last = records.where("type = 'session_end'").select("samples", "frames", "labels", "parse_errors").first()
    return last.asDict() if last else {}


def protocol_meta(described: str, phases: Sequence[tuple], **seconds: float) -> str:
    """``meta.json`` with the protocol that was asked for and its phases (O-PRO-3, O-SNK-10)."""
    shown = [{"name": name, "duration_s": duration, "label": label} for _, name, duration, label in phases]
    return json.dumps(json.loads(described) | {"prompt_protocol": {**seconds, "phases": shown}}, indent=2)
