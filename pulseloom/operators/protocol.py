"""Prompt protocols and their phases (O-PRO-*, O-JOIN-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Phases of a protocol that is sent to all tasks; one of more is joined by stretches of time.
BROADCAST_PHASES = 10_000
SCHEMA = "idx bigint, name string, duration_s double, label string"


def build(settle: float = 5, rest: float = 20, trials: int = 20, press: float = 1, gap: float = 3, final_rest: float = 10, artifact: float = 0) -> list[tuple]:
    """``(idx, name, duration_s, label)``: optional parts only where they last; clicks always (O-PRO-1)."""
    parts: list[tuple[str, float, str | None, bool]] = [("SETTLE", settle, None, False), ("REST", rest, None, False)]
    for i in range(1, trials + 1):
        parts.append((f"CLICK {i}/{trials}", press, "CLICK", True))
        if i < trials:
            parts.append(("REST", gap, None, False))
    parts += [("ARTIFACT_NO_LABEL", artifact, None, False), ("REST", final_rest, None, False)]
    kept = [(n, d, label) for n, d, label, always in parts if always or d > 0]
    return [(i, n, float(d), label) for i, (n, d, label) in enumerate(kept)]


def timed(protocol: DataFrame) -> DataFrame:
    """``protocol`` with ``start_s, end_s``; its phases are a handful of rows in one order."""
    end = F.sum("duration_s").over(Window.orderBy("idx"))
    return protocol.withColumn("end_s", end).withColumn("start_s", F.col("end_s") - F.col("duration_s"))


def phase_at(times: DataFrame, protocol: DataFrame) -> DataFrame:
    """``times`` with the phase that holds ``elapsed_s`` (start counted, end not), the time in it and the time left;
    nulls past the end (O-PRO-2). A recording's script, a few dozen rows, is sent to all tasks. A longer one is cut into as
    many stretches of time as it has phases, and phases and times meet by stretch."""
    n, p = protocol.count(), timed(protocol)
    inside = (F.col("elapsed_s") >= F.col("start_s")) & (F.col("elapsed_s") < F.col("end_s"))
    if n <= BROADCAST_PHASES:
        p = F.broadcast(p)
    else:
        width = (protocol.agg(F.sum("duration_s")).first()[0] or 1.0) / n
        stretch = lambda c: F.floor(F.col(c) / width)
        p = p.withColumn("__stretch", F.explode(F.sequence(stretch("start_s"), stretch("end_s"))))
        inside = inside & (stretch("elapsed_s") == F.col("__stretch"))
    return times.join(p, inside, "left").select(
        *times.columns, F.col("idx").alias("phase_idx"), F.col("name").alias("phase"), (F.col("elapsed_s") - F.col("start_s")).alias("phase_elapsed_s"), (F.col("end_s") - F.col("elapsed_s")).alias("phase_left_s")
    )


def markers(samples: DataFrame, protocol: DataFrame, done: bool = False) -> DataFrame:
    """``(session, arrival_seq, t_ms, host_time_s, phase_idx, name, label, previous, previous_label)``: a row where a session's phase
    changes, its first one included; the clock starts at the first sample (O-REC-1/4). With ``done`` also where the
    protocol is over, with nulls for the phase."""
    w = Window.partitionBy("session").orderBy("arrival_seq")
    timed_rows = samples.select("session", "arrival_seq", "t_ms", F.col("host_time_s") if "host_time_s" in samples.columns else F.lit(None).cast("double").alias("host_time_s"), ((F.col("t_ms") - F.first("t_ms").over(w)) / 1000.0).alias("elapsed_s"))
    placed = phase_at(timed_rows, protocol).join(protocol.select(F.col("idx").alias("phase_idx"), "label"), "phase_idx", "left")
    if not done:
        placed = placed.where("phase_idx IS NOT NULL")
    known = placed.withColumns({"before": F.lag("phase_idx").over(w), "previous": F.lag("phase").over(w), "previous_label": F.lag("label").over(w), "first": F.row_number().over(w) == 1})
    changed = known.where("first OR NOT (before <=> phase_idx)")
    return changed.select("session", "arrival_seq", "t_ms", "host_time_s", "phase_idx", F.col("phase").alias("name"), "label", "previous", "previous_label")
