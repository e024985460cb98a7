"""Sample streams: parsing, clock segments, hopping frames and their features (O-PRJ-1..3, O-FRM-*, O-DSP-2/10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import parse_line, whole_number

WINDOW_MS, HOP_MS = 120, 30


def _arrivals():
    return Window.partitionBy("session").orderBy("arrival_seq")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """``(session, arrival_seq, t_ms, raw, env)`` of the lines that parse."""
    return lines.select("session", "arrival_seq", parse_line(F.col("line")).alias("s")).where("s IS NOT NULL").select("session", "arrival_seq", "s.*")


def line_counts(lines: DataFrame) -> DataFrame:
    """Lines and rejected lines of each session."""
    return lines.groupBy("session").agg(F.count("*").alias("n_lines"), F.count_if(parse_line(F.col("line")).isNull()).alias("n_errors"))


def clean_samples(rows: DataFrame) -> DataFrame:
    """O-SRC-6: text columns ``t_ms, raw, env`` to whole numbers; rows with one that is none are dropped."""
    made = rows.select("session", "arrival_seq", *[whole_number(F.col(c)).alias(c) for c in ("t_ms", "raw", "env")])
    return made.dropna(subset=["t_ms", "raw", "env"])


def with_segments(samples: DataFrame, hop_ms: int = HOP_MS) -> DataFrame:
    """``segment`` counts the clock resets so far: ``t + hop`` below the time before (O-FRM-1)."""
    reset = F.coalesce((F.col("t_ms") + hop_ms < F.lag("t_ms").over(_arrivals())).cast("bigint"), F.lit(0))
    return samples.withColumn("reset", reset).withColumn("segment", F.sum("reset").over(_arrivals())).drop("reset")


def with_dt(samples: DataFrame) -> DataFrame:
    """O-DSP-2, within segments."""
    w = Window.partitionBy("session", "segment").orderBy("arrival_seq")
    return samples.withColumn("dt_ms", F.greatest(F.coalesce(F.col("t_ms") - F.lag("t_ms").over(w), F.lit(1)), F.lit(1)))


def rolling_rms(samples: DataFrame, value: str, window_ms: int = 180) -> DataFrame:
    """O-DSP-10 where times rise strictly within a segment: both ends of the window count."""
    w = Window.partitionBy("session", "segment").orderBy("t_ms").rangeBetween(-window_ms, 0)
    return samples.withColumn("rms", F.sqrt(F.greatest(F.avg(F.col(value) * F.col(value)).over(w), F.lit(0.0))))


def members(samples: DataFrame, window_ms: int = WINDOW_MS, hop_ms: int = HOP_MS) -> DataFrame:
    """One row for each sample and frame it is in: ``segment, frame, end_ms`` added (O-FRM-2..4).

    Frames end at ``first time + window + k * hop`` and hold the samples of ``[end - window, end]`` that arrive before
    a sample at or past the end has closed the frame, and the one that closes it at its end. A sample is in at most
    ``window / hop + 1`` frames, so the rows grow with the samples.
    """
    window_ms, hop_ms = max(window_ms, 20), max(hop_ms, 10)
    w = Window.partitionBy("session", "segment").orderBy("arrival_seq")
    t0 = F.first("t_ms").over(w)
    before = F.max("t_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    last = F.max("t_ms").over(Window.partitionBy("session", "segment"))
    placed = with_segments(samples, hop_ms).select("*", t0.alias("t0"), before.alias("before"), last.alias("last"))
    low = F.greatest(F.ceil((F.col("t_ms") - F.col("t0") - window_ms) / hop_ms), F.lit(0))
    high = F.floor((F.col("t_ms") - F.col("t0")) / hop_ms)
    spread = placed.withColumns({"low": low, "high": high}).where("low <= high")
    spread = spread.withColumn("frame", F.explode(F.sequence("low", "high"))).withColumn("end_ms", F.col("t0") + window_ms + F.col("frame") * hop_ms)
    # Closed frames only; late rows are not in a frame that was emitted before they came.
    return spread.where("end_ms <= last AND (before IS NULL OR before < end_ms)").drop("low", "high", "before", "last", "t0")


def frames(samples: DataFrame, value: str, window_ms: int = WINDOW_MS, hop_ms: int = HOP_MS, slope: str | None = None, lf: str | None = None) -> DataFrame:
    """Features of every frame of two samples or more (O-FRM-6..10), under the names of recorded frames.

    ``rms_state``, ``waveform_length`` and ``filtered_raw_hp`` (the last value) are of ``value``; ``slope_burst``, a
    median, is of ``slope`` and ``lf_energy_ratio`` of ``lf`` (both ``value`` unless given).
    """
    window_ms = max(window_ms, 20)
    inside = Window.partitionBy("session", "segment", "frame").orderBy("arrival_seq")
    rows = members(samples, window_ms, hop_ms).withColumn("step", F.abs(F.col(value) - F.lag(value).over(inside)))
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return (
        rows.groupBy("session", "segment", "frame", "end_ms")
        .agg(
            F.count("*").alias("n"),
            rms(value).alias("rms_state"),
            (rms(lf or value) / F.greatest(rms(value), F.lit(1e-6))).alias("lf_energy_ratio"),
            F.coalesce(F.sum("step"), F.lit(0)).cast("double").alias("waveform_length"),
            F.median(slope or value).alias("slope_burst"),
            F.max_by("env", "arrival_seq").alias("env_in"),
            F.max_by(value, "arrival_seq").alias("filtered_raw_hp"),
        )
        .where("n >= 2")
        .withColumn("start_ms", F.col("end_ms") - window_ms)
    )


def sequences(frames_df: DataFrame, features: list[str], length: int) -> DataFrame:
    """``steps array<array<double>>``: the last ``length`` feature vectors of each frame, null until there are so
    many (O-FRM-11/12)."""
    w = Window.partitionBy("session").orderBy("segment", "frame").rowsBetween(-(length - 1), 0)
    vectors = F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(w)
    return frames_df.withColumn("steps", vectors).withColumn("steps", F.when(F.size("steps") == length, F.col("steps")))
