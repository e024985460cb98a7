"""The filter chain of a long session over many tasks: blocked scans of affine recurrences (O-DSP-1..13).

All filters are affine in their state: the rate estimate by itself; high-pass, notch, low-pass and low-frequency filter
together once the rate is known; the two slope averages once the filtered values are. So a block of samples is a map from
the state before it to the state after it. Tasks compose the maps of their blocks, a fold over the maps (one row a block)
gives every block's entry state, and tasks apply it: three such scans, equal to the fold of ``dsp.snapshots`` but for the
rounding of sums. Only numbering, differences and the level's windows, which need no Python, see a session in one order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import cos, pi, sin

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .dsp import FIELDS, FilterConfig, _lag
from .frames import HOP_MS, with_segments
from .ordered import ordered_fold

#: Samples of a block.
BLOCK = 4096
_KEYS = ["session", "segment", "block"]
#: States of the linear filters: two samples before the notch, two after it, low-pass, low-frequency filter.
_STATES = 6


def _rate_map(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    a, b = 1.0, 0.0
    for dt in rows.sort_values("pos").loc[lambda r: r["pos"] > 0, "dt"].tolist():
        a, b = 0.95 * a, 0.95 * b + 0.05 / max(dt / 1000.0, 1e-6)
    return pd.DataFrame([(*key, [a, b])], columns=[*_KEYS, "map"])


def _gain(dt: int, tau_ms: float) -> float:
    return min(max(dt / (max(tau_ms, 1.0) + dt), 0.0), 1.0)


def _chain(c: FilterConfig, fs: float, dts: Sequence[int]) -> list[tuple[float, ...]]:
    """For each sample its high-pass factor, the notch's coefficients, and the gains of low-pass and low-frequency filter."""
    out, rc = [], _lag(c.hp_hz)
    for dt in dts:
        seconds = dt / 1000.0
        fs = 0.95 * fs + 0.05 / max(seconds, 1e-6)
        omega = 2.0 * pi * min(max(c.notch_hz / max(fs, 1.0), 0.0), 0.49)
        alpha, turn = sin(omega) / (2.0 * max(c.notch_q, 1.0)), -2.0 * cos(omega)
        out.append((rc / (rc + seconds), omega, turn, 1.0 - alpha, 1.0 + alpha, seconds / (_lag(c.lp_hz) + seconds), seconds / (_lag(c.lf_hz) + seconds)))
    return out


def _step(c: FilterConfig, k: tuple[float, ...], z: list, drive, raw, baseline) -> tuple[list, object, object]:
    """A sample: the state after it, the filtered and the centered value; numbers, or arrays of one a column."""
    x1, x2, y1, y2, lp, lf = z
    factor, omega, turn, back, a0, k_lp, k_lf = k
    if c.enabled:
        hp = factor * (x1 + drive)
        out = (hp + turn * x1 + x2 - turn * y1 - back * y2) / a0 if omega > 0.0 else hp
        lp = lp + k_lp * (out - lp)
        x1, x2, y1, y2 = hp, x1, out, y1
        filtered = lp
    else:
        filtered = raw
    centered = filtered - baseline
    lf = lf + k_lf * (centered - lf)
    return [x1, x2, y1, y2, lp, lf], filtered, centered


def _linear_map(c: FilterConfig) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """A block's map as rows of a matrix: what each state before gives, and what the samples give."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        fs, baseline = float(rows["entry"].iloc[0][0]), float(rows["baseline"].iloc[0])
        rows = rows[rows["pos"] > 0]
        given = np.r_[np.zeros(_STATES), 1.0]
        z = list(np.eye(_STATES, _STATES + 1))
        for k, raw, prev in zip(_chain(c, fs, rows["dt"].tolist()), rows["raw"].tolist(), rows["prev"].tolist()):
            z, _, _ = _step(c, k, z, given * (raw - prev), given * raw, given * baseline)
        return pd.DataFrame([(*key, np.stack(z).ravel().tolist())], columns=[*_KEYS, "map"])

    return run


def _filtered(c: FilterConfig) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """A block's values from its entry states, and on its last row the map of its slope averages."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        z, fs, baseline = list(rows["state"].iloc[0]), float(rows["entry"].iloc[0][0]), float(rows["baseline"].iloc[0])
        dts, raws, prevs = rows["dt"].tolist(), rows["raw"].tolist(), rows["prev"].tolist()
        last = 0.0 if key[2] == 0 else (z[4] if c.enabled else float(prevs[0])) - baseline
        first = int(rows["pos"].iloc[0] == 0)
        # The first sample of all passes unfiltered and is the baseline.
        filtered, centered, low = [float(raws[0])] * first, [0.0] * first, [0.0] * first
        for k, raw, prev in zip(_chain(c, fs, dts[first:]), raws[first:], prevs[first:]):
            z, f, x = _step(c, k, z, float(raw - prev), float(raw), baseline)
            filtered.append(f)
            centered.append(x)
            low.append(z[5])
        slope = np.abs(np.diff(np.r_[last, centered]))
        map_: list[float] = []
        for tau in (c.fast_tau_ms, c.slow_tau_ms):
            a, b = 1.0, 0.0
            for dt, s in zip(dts, slope.tolist()):
                k = _gain(dt, tau)
                a, b = a * (1.0 - k), b + k * (s - b)
            map_ += [a, b]
        return rows.drop(columns=["entry", "state", "prev"]).assign(filtered=filtered, centered=centered, lf=low, slope=slope, map=[None] * (len(rows) - 1) + [map_])

    return run


def _averaged(c: FilterConfig) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        fast, slow = (float(x) for x in rows["state"].iloc[0])
        burst = []
        for dt, s in zip(rows["dt"].tolist(), rows["slope"].tolist()):
            fast += _gain(dt, c.fast_tau_ms) * (s - fast)
            slow += _gain(dt, c.slow_tau_ms) * (s - slow)
            burst.append(fast / max(slow, 1.0))
        return rows.drop(columns=["state", "slope", "dt"]).assign(slope_burst=burst)

    return run


def _entries(maps: DataFrame, start: list[float], name: str) -> DataFrame:
    """``(session, segment, block, name)``: the state before each block, from the maps of the blocks before it."""
    n = len(start)

    def fold(held: dict, key: tuple, rows: dict[str, list]) -> list[tuple]:
        out = []
        for block, m in zip(rows["block"], rows["map"]):
            out.append((*key, block, held["z"].tolist()))
            m = np.array(m)
            if len(m) == 2 * n:  # states of their own
                held["z"] = m[::2] * held["z"] + m[1::2]
            else:
                m = m.reshape(n, n + 1)
                held["z"] = m[:, :n] @ held["z"] + m[:, n]
        return out

    schema = f"session {dict(maps.dtypes)['session']}, segment bigint, block bigint, {name} array<double>"
    return ordered_fold(maps, _KEYS[:2], ["block"], lambda: {"z": np.array(start)}, fold, schema)


def block_snapshots(samples: DataFrame, config: FilterConfig = FilterConfig(), hop_ms: int = HOP_MS, block: int = BLOCK) -> DataFrame:
    """What ``dsp.snapshots`` gives, by blocks of ``block`` samples (2 or more): a session that holds a third of all
    rows is worked on by all tasks. Samples without a time or a value are left out."""
    if block < 2:
        raise ValueError("blocks are of two samples or more")
    w = Window.partitionBy("session", "segment").orderBy("arrival_seq")
    given = with_segments(samples.dropna(subset=["t_ms", "raw"]), hop_ms).select("session", "segment", "arrival_seq", "t_ms", "raw", "env")
    number = F.row_number().over(w)
    rows = given.withColumns(
        {
            "pos": (number - 1).cast("bigint"), "dt": F.greatest(F.coalesce(F.col("t_ms") - F.lag("t_ms").over(w), F.lit(1)), F.lit(1)).cast("bigint"),
            # The high-pass has seen no sample before the second.
            "prev": F.coalesce(F.when(number > 2, F.lag("raw").over(w)), F.lit(0)).cast("bigint"), "baseline": F.first("raw").over(w).cast("double"), "top": F.max("t_ms").over(w),
        }
    )
    rows = written(rows.withColumn("block", (F.col("pos") / block).cast("bigint")), "scan-rows")
    session = f"session {dict(samples.dtypes)['session']}"
    kept = f"{session}, segment bigint, arrival_seq bigint, t_ms bigint, raw bigint, env bigint, pos bigint"
    map_ = f"{session}, segment bigint, block bigint, map array<double>"
    rated = rows.join(_entries(rows.groupBy(*_KEYS).applyInPandas(_rate_map, map_), [config.sample_hz], "entry"), _KEYS)
    states = _entries(rated.groupBy(*_KEYS).applyInPandas(_linear_map(config), map_), [0.0] * _STATES, "state")
    shape = f"{kept}, dt bigint, baseline double, top bigint, block bigint, filtered double, centered double, lf double, slope double, map array<double>"
    made = rated.join(states, _KEYS).select("session", "segment", "arrival_seq", "t_ms", "raw", "env", "pos", "dt", "baseline", "top", "block", "prev", "entry", "state")
    made = written(made.groupBy(*_KEYS).applyInPandas(_filtered(config), shape), "scan-filtered")
    averages = _entries(made.where("map IS NOT NULL").select(*_KEYS, "map"), [0.0, 0.0], "state")
    last = f"{kept}, baseline double, top bigint, block bigint, filtered double, centered double, lf double, slope_burst double"
    done = made.drop("map").join(averages, _KEYS).groupBy(*_KEYS).applyInPandas(_averaged(config), last)
    # The level's window begins with the first sample that is not older than the newest so far allows. Samples that are
    # as new as this one but came later are taken off again.
    near = Window.partitionBy("session", "segment").orderBy("top").rangeBetween(-max(config.rms_window_ms, 40), 0)
    later = Window.partitionBy("session", "segment", "top").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    within = lambda x: F.sum(x).over(near) - F.coalesce(F.sum(x).over(later), F.lit(0))
    level = lambda x: F.sqrt(F.greatest(within(x) / F.col("n"), F.lit(0.0)))
    squares = done.withColumns({"cc": F.col("centered") * F.col("centered"), "ll": F.col("lf") * F.col("lf"), "n": within(F.lit(1))})
    out = squares.withColumns({"rms_state": level(F.col("cc")), "lf_energy": level(F.col("ll"))})
    out = out.withColumn("artifact_ratio", F.col("lf_energy") / F.greatest("rms_state", F.lit(config.scale_floor), F.lit(1e-6)))
    out = out.withColumns({"artifact_score": F.greatest("artifact_ratio", F.when(F.col("pos") >= 4, F.col("slope_burst")).otherwise(1.0)), "u": F.col("rms_state") / config.scale_floor, "baseline_raw": F.col("baseline")})
    return out.select("session", "segment", "arrival_seq", "t_ms", "raw", "env", *FIELDS)
