"""Pairing of events in order (O-ISL-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(*cols: str):
    return Window.partitionBy("session").orderBy(*cols)


def label_intervals(records: DataFrame) -> DataFrame:
    """``(session, ord, start_ms, end_ms)`` from ``(session, line, type, t_ms)`` (O-ISL-1).

    A start replaces one before it, an end closes the open one; intervals that do not run forward, rows without a
    time and starts without an end fall away.
    """
    marks = records.where("t_ms IS NOT NULL AND type IN ('label_start', 'label_end')")
    w = _order("line")
    paired = marks.withColumns({"before": F.lag("type").over(w), "start_ms": F.lag("t_ms").over(w)})
    kept = paired.where("type = 'label_end' AND before = 'label_start' AND t_ms > start_ms")
    return kept.select("session", F.row_number().over(w).cast("bigint").alias("ord"), "start_ms", F.col("t_ms").alias("end_ms"))


def phase_windows(markers: DataFrame) -> DataFrame:
    """``(session, ord, name, label, start_ms, end_ms)`` from ``(session, line, name, label, t_ms, duration_s)``: up
    to the next marker, the last for its nominal duration (O-ISL-2)."""
    w = _order("line")
    nominal = F.col("t_ms") + (F.coalesce("duration_s", F.lit(0.0)) * 1000).cast("bigint")
    ended = markers.where("t_ms IS NOT NULL").withColumns({"ord": F.row_number().over(w).cast("bigint"), "end_ms": F.coalesce(F.lead("t_ms").over(w), nominal)})
    return ended.where("end_ms > t_ms").select("session", "ord", "name", "label", F.col("t_ms").alias("start_ms"), "end_ms")


def presses(events: DataFrame) -> DataFrame:
    """``(session, ord, down_ms, up_ms)`` from ``(session, ord, phase, t_ms)``: every down, with the time of an up that
    follows it at once (O-ISL-3). Keys besides ``session`` may be given as ``config``."""
    keys = ["session"] + [c for c in ("config",) if c in events.columns]
    w = Window.partitionBy(*keys).orderBy("ord")
    known = events.where("phase IN ('down', 'up', 'cancel')")
    up = F.when(F.lead("phase").over(w) == "up", F.lead("t_ms").over(w))
    return known.withColumn("up_ms", up).where("phase = 'down'").select(*keys, F.row_number().over(w).cast("bigint").alias("ord"), F.col("t_ms").alias("down_ms"), "up_ms")


def forced_close(intervals: DataFrame, ends: DataFrame) -> DataFrame:
    """``intervals(session, start_ms, end_ms)`` whose open ends are closed at ``ends(session, session_end_ms)``, with
    ``closed_by`` (O-ISL-4)."""
    return intervals.join(ends, "session", "left").select(
        "session", "start_ms", F.coalesce("end_ms", "session_end_ms").alias("end_ms"), F.when(F.col("end_ms").isNull(), "session_end").otherwise("label_end").alias("closed_by")
    )
