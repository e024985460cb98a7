"""Recordings as rows: raw rows, feature rows, label records and monitor rows of sessions (O-REC-*, O-PRJ-20, O-AGG-12).

Controls are what a person did while lines came in: ``(session, seq, after_seq, action)``, where ``after_seq`` is the
arrival number of the last line before it. Label records are ``(session, line, type, label, t_ms, phase, duration_s,
closed_by, host_time_s)``; times are those of the last sample that parsed before the record, the host's among them where
samples have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .protocol import markers

RECORD = "type string, label string, t_ms bigint, phase string, duration_s double, closed_by string, host_time_s double"


def _record(kind: str, label: Column | None = None, t: Column | None = None, **more: Column) -> Column:
    given = {"type": F.lit(kind), "label": label, "t_ms": t, "phase": more.get("phase"), "duration_s": more.get("duration_s"), "closed_by": more.get("closed_by"), "host_time_s": more.get("host")}
    kinds = dict(x.split(" ") for x in RECORD.split(", "))
    return F.struct(*[(F.lit(None) if v is None else v).cast(kinds[k]).alias(k) for k, v in given.items()])


def host_of(rows: DataFrame) -> Column:
    return F.col("host_time_s") if "host_time_s" in rows.columns else F.lit(None).cast("double").alias("host_time_s")


def timed_controls(samples: DataFrame, controls: DataFrame) -> DataFrame:
    """``controls`` with ``t_ms`` and ``host_time_s`` of the last sample before each: samples and controls in one order,
    one shuffle."""
    none = F.lit(None)
    a = samples.select("session", F.col("arrival_seq").alias("at"), F.lit(0).alias("kind"), F.col("t_ms"), host_of(samples), none.cast("bigint").alias("seq"), none.cast("string").alias("action"))
    b = controls.select("session", F.col("after_seq").alias("at"), F.lit(1).alias("kind"), none.cast("bigint").alias("t_ms"), none.cast("double").alias("host_time_s"), "seq", "action")
    w = Window.partitionBy("session").orderBy("at", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    known = a.unionByName(b).withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("t_ms", "host_time_s")})
    return known.where("kind = 1").select("session", "seq", "action", "t_ms", "host_time_s")


def _closed(marks: DataFrame, ends: DataFrame, label: str) -> DataFrame:
    """``marks(session, seq, type, t_ms)`` as records, and an end for a session whose last mark is a start."""
    w = Window.partitionBy("session").orderBy("seq")
    rows = marks.select("session", "seq", _record("x", F.lit(label), F.col("t_ms"), host=F.col("host_time_s")).withField("type", F.col("type")).alias("r"))
    left = marks.withColumn("later", F.lead("type").over(w)).where("later IS NULL AND type = 'label_start'").join(_hosted(ends), "session")
    tail = left.select("session", (F.col("seq") + 1).alias("seq"), _record("label_end", F.lit(label), F.col("final_t_ms"), closed_by=F.lit("session_end"), host=F.col("final_host_s")).alias("r"))
    return rows.union(tail).select("session", F.row_number().over(w).cast("bigint").alias("line"), "r.*")


def _hosted(ends: DataFrame) -> DataFrame:
    return ends if "final_host_s" in ends.columns else ends.withColumn("final_host_s", F.lit(None).cast("double"))


def toggle_labels(samples: DataFrame, controls: DataFrame, ends: DataFrame, label: str = "CLICK") -> DataFrame:
    """Each control starts an interval or ends the one that is open (O-REC-2)."""
    turn = F.row_number().over(Window.partitionBy("session").orderBy("seq"))
    marks = timed_controls(samples, controls).withColumn("type", F.when(turn % 2 == 1, "label_start").otherwise("label_end"))
    return _closed(marks, ends, label)


def hold_labels(samples: DataFrame, controls: DataFrame, ends: DataFrame, label: str = "CLICK") -> DataFrame:
    """A ``press`` starts an interval where none is open, a ``release`` ends the open one (O-REC-3)."""
    before = F.lag("action").over(Window.partitionBy("session").orderBy("seq"))
    known = timed_controls(samples, controls.where("action IN ('press', 'release')")).withColumn("before", F.coalesce(before, F.lit("release")))
    marks = known.where("action != before").withColumn("type", F.when(F.col("action") == "press", "label_start").otherwise("label_end"))
    return _closed(marks, ends, label)


def prompt_labels(samples: DataFrame, protocol: DataFrame, ends: DataFrame, done: bool = False) -> DataFrame:
    """What a prompted recorder writes (O-REC-1): where a phase begins the open interval ends, the phase is noted, and a
    phase with a label starts an interval; with ``done`` a ``prompt_done`` record at the first sample past the
    protocol (O-REC-4), where the open interval ends too."""
    found = markers(samples, protocol, done).join(protocol.select(F.col("idx").alias("phase_idx"), "duration_s"), "phase_idx", "left")
    t, label, over, host = F.col("t_ms"), F.col("label"), F.col("name").isNull(), F.col("host_time_s")
    ended = F.when(F.col("previous_label").isNotNull(), _record("label_end", F.col("previous_label"), t, closed_by=F.lit("phase_transition"), host=host))
    noted = F.when(over, _record("prompt_done", None, t, host=host)).otherwise(_record("prompt_phase", label, t, phase=F.col("name"), duration_s=F.col("duration_s"), host=host))
    started = F.when(label.isNotNull(), _record("label_start", label, t, host=host))
    w = Window.partitionBy("session").orderBy("arrival_seq", "i")
    rows = found.select("session", "arrival_seq", F.posexplode(F.array(ended, noted, started)).alias("i", "r")).where("r IS NOT NULL")
    every = Window.partitionBy("session").orderBy("arrival_seq")
    last = found.withColumn("later", F.lead("t_ms").over(every)).where("later IS NULL AND label IS NOT NULL").join(_hosted(ends), "session")
    tail = last.select("session", (F.col("arrival_seq") + 1).alias("arrival_seq"), F.lit(9).alias("i"), _record("label_end", label, F.col("final_t_ms"), closed_by=F.lit("session_end"), host=F.col("final_host_s")).alias("r"))
    return rows.union(tail).select("session", F.row_number().over(w).cast("bigint").alias("line"), "r.*")


def session_counts(lines: DataFrame, parsed: DataFrame, frames: DataFrame, labels: DataFrame) -> DataFrame:
    """``(session, samples, frames, labels, parse_errors, final_t_ms)`` of each session with lines (O-AGG-12): what its
    last record says. ``labels`` counts intervals that ended."""
    n = lines.groupBy("session").agg(F.count("*").alias("lines"))
    s = parsed.groupBy("session").agg(F.count("*").alias("samples"), F.max_by("t_ms", "arrival_seq").alias("final_t_ms"))
    f = frames.groupBy("session").agg(F.count("*").alias("frames"))
    ends = labels.where("type = 'label_end'").groupBy("session").agg(F.count("*").alias("labels"))
    found = n.join(s, "session", "left").join(f, "session", "left").join(ends, "session", "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return found.select("session", some("samples"), some("frames"), some("labels"), (F.col("lines") - F.coalesce("samples", F.lit(0))).alias("parse_errors"), "final_t_ms")


def line_rates(lines: DataFrame) -> DataFrame:
    """``(session, n_lines, lines_per_s)`` from lines with ``host_time_s`` (O-AGG-14): over the time from first to last."""
    elapsed = F.greatest(F.max("host_time_s") - F.min("host_time_s"), F.lit(1e-6))
    return lines.groupBy("session").agg(F.count("*").alias("n_lines"), (F.count("*") / elapsed).alias("lines_per_s"))


def closing_samples(samples: DataFrame, window_ms: int, hop_ms: int) -> DataFrame:
    """``(session, segment, arrival_seq, frame)``: the sample whose arrival closes each frame; samples need
    ``segment``."""
    w = Window.partitionBy("session", "segment").orderBy("arrival_seq")
    t0, before = F.first("t_ms").over(w), F.max("t_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    low = F.greatest(F.floor((F.col("before") - F.col("t0") - window_ms) / hop_ms) + 1, F.lit(0))
    placed = samples.select("session", "segment", "arrival_seq", "t_ms", t0.alias("t0"), before.alias("before"))
    placed = placed.withColumns({"low": F.coalesce(low, F.lit(0)), "high": F.floor((F.col("t_ms") - F.col("t0") - window_ms) / hop_ms)}).where("low <= high")
    return placed.select("session", "segment", "arrival_seq", F.explode(F.sequence("low", "high")).alias("frame"))


def monitor_rows(snapshots: DataFrame, frames: DataFrame, window_ms: int, hop_ms: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the monitor (O-PRJ-20): one for each frame that a sample closes, else one for the sample itself, whose
    window is its own time, whose ratio is the artifact ratio and whose waveform length is zero. Columns ``more`` of the
    frames are kept, null in rows of samples."""
    names = ("filtered_raw_hp", "rms_state", "lf_energy_ratio", "slope_burst", "waveform_length")
    framed = closing_samples(snapshots, window_ms, hop_ms).join(
        frames.select("session", "segment", "frame", F.col("end_ms").alias("f_end"), F.col("start_ms").alias("f_start"), *[F.col(c).alias(f"f_{c}") for c in names], *more),
        ["session", "segment", "frame"],
    )
    own = {"filtered_raw_hp": F.col("filtered"), "rms_state": F.col("rms_state"), "lf_energy_ratio": F.col("artifact_ratio"), "slope_burst": F.col("slope_burst"), "waveform_length": F.lit(0.0)}
    met = snapshots.join(framed, ["session", "segment", "arrival_seq"], "left")
    return met.select(
        "session", "arrival_seq", "frame", F.coalesce("f_end", "t_ms").alias("t_ms"), F.coalesce("f_start", "t_ms").alias("window_start_ms"), F.coalesce("f_end", "t_ms").alias("window_end_ms"),
        "raw", F.col("env").alias("env_in"), *[F.coalesce(f"f_{c}", own[c]).alias(c) for c in names], *more,
    )


def hosted_frames(frames: DataFrame, samples: DataFrame, snapshots: DataFrame, window_ms: int, hop_ms: int) -> DataFrame:
    """``frames`` with ``host_time_s`` of the sample that closed each (O-REC-6); ``snapshots`` are the samples with
    ``segment``."""
    closing = closing_samples(snapshots, window_ms, hop_ms).join(samples.select("session", "arrival_seq", "host_time_s"), ["session", "arrival_seq"])
    return frames.join(closing.select("session", "segment", "frame", "host_time_s"), ["session", "segment", "frame"], "left")


def feature_rows(frames: DataFrame, host_time: Column) -> DataFrame:
    """Recorded feature rows (O-REC-6): the host's time to six decimals, then the frame."""
    return frames.select(
        "session", F.format_string("%.6f", host_time).alias("host_time_s"), F.col("end_ms").alias("t_ms"), F.col("start_ms").alias("window_start_ms"), F.col("end_ms").alias("window_end_ms"),
        "env_in", "filtered_raw_hp", "rms_state", "lf_energy_ratio", "slope_burst", "waveform_length",
    )
