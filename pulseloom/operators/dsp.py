"""Filter chain and level tracking, one kernel for batch and stream (O-DSP-*, O-SRC-14)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field
from math import cos, pi, sin, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import HOP_MS, with_segments
from .ordered import ordered_fold


@dataclass(frozen=True)
class FilterConfig:
    """The defaults that results must agree with."""

    hp_hz: float = 20.0
    lp_hz: float = 230.0
    notch_hz: float = 60.0
    notch_q: float = 20.0
    rms_window_ms: int = 180
    sample_hz: float = 250.0
    scale_floor: float = 5.0
    lf_hz: float = 10.0
    fast_tau_ms: float = 40.0
    slow_tau_ms: float = 400.0
    baseline_tau_ms: float = 2000.0
    enabled: bool = True


class RestWindow:
    """Values of the last ``window_ms``, at most ``most``, in order of arrival and sorted: statistics cost a few
    bisections, whatever the window holds (O-DSP-14/15)."""

    def __init__(self, window_ms: int = 3000, most: int = 3000) -> None:
        self.window_ms, self.most = max(window_ms, 250), most
        self.rows: deque[tuple[int, float]] = deque()
        self.sorted: list[float] = []

    def _drop(self) -> None:
        _, v = self.rows.popleft()
        del self.sorted[bisect_left(self.sorted, v)]

    def put(self, t: int, v: float) -> None:
        if len(self.rows) == self.most:
            self._drop()
        self.rows.append((t, v))
        insort(self.sorted, v)

    def add(self, t: int, v: float) -> None:
        self.put(t, v)
        while self.rows[0][0] < t - self.window_ms:
            self._drop()

    def clear(self) -> None:
        self.rows.clear()
        self.sorted.clear()

    def center(self) -> float:
        s, n = self.sorted, len(self.sorted)
        return (s[(n - 1) // 2] + s[n // 2]) / 2

    def _deviation(self, centre: float, k: int) -> float:
        """The deviation from ``centre`` at rank ``k``: the nearest values are neighbours in the sorted ones."""
        s = self.sorted
        low, high = 0, len(s) - k - 1
        while low < high:
            middle = (low + high) // 2
            if centre - s[middle] > s[middle + k + 1] - centre:
                low = middle + 1
            else:
                high = middle
        return max(abs(s[low] - centre), abs(s[low + k] - centre))

    def scale(self, floor: float) -> float:
        s, n = self.sorted, len(self.sorted)
        low = s[int((n - 1) * 0.5)]
        mad = (self._deviation(low, (n - 1) // 2) + self._deviation(low, n // 2)) / 2
        return max(s[int((n - 1) * 0.9)] - low, 1.4826 * mad, floor)


@dataclass
class FilterState:
    """Everything a segment carries from one sample to the next; plain numbers, so that a state store can hold it."""

    last_t: int | None = None
    count: int = 0
    fs: float = 250.0
    hp_x: float = 0.0
    hp_y: float = 0.0
    taps: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    lp: float = 0.0
    lf: float = 0.0
    baseline: float = 0.0
    centered: float = 0.0
    fast: float = 0.0
    slow: float = 0.0
    window: deque = field(default_factory=deque)
    sums: tuple[float, float] = (0.0, 0.0)
    dt: int = 1
    rest: RestWindow = field(default_factory=RestWindow)
    rest_center: float = 0.0
    rest_scale: float = 0.0


FIELDS = ("filtered", "centered", "lf", "rms_state", "lf_energy", "artifact_ratio", "slope_burst", "artifact_score", "u", "baseline_raw")


def ema(previous: float, value: float, dt_ms: int, tau_ms: float) -> float:
    return previous + min(max(dt_ms / (max(tau_ms, 1.0) + dt_ms), 0.0), 1.0) * (value - previous)


def _lag(hz: float) -> float:
    return 1.0 / (2.0 * pi * max(hz, 0.1))


def step(s: FilterState, c: FilterConfig, t_ms: int, raw: float) -> tuple[float, ...]:
    """One sample; values in the order of ``FIELDS``. The first sample passes unfiltered and sets the baseline."""
    dt = 1
    if s.last_t is None:
        s.baseline, filtered = raw, raw
        s.rest_center, s.rest_scale = 0.0, c.scale_floor
    else:
        dt = max(t_ms - s.last_t, 1)
        filtered = _chain(s, c, raw, dt / 1000.0) if c.enabled else raw
        s.dt = dt
    s.last_t = t_ms
    centered = filtered - s.baseline
    seconds = dt / 1000.0
    s.lf += seconds / (_lag(c.lf_hz) + seconds) * (centered - s.lf)
    s.window.append((t_ms, centered * centered, s.lf * s.lf))
    total, low = s.sums[0] + centered * centered, s.sums[1] + s.lf * s.lf
    while s.window[0][0] < t_ms - max(c.rms_window_ms, 40):
        _, a, b = s.window.popleft()
        total, low = total - a, low - b
    s.sums = (total, low)
    rms, lf_energy = (sqrt(max(x / len(s.window), 0.0)) for x in (total, low))
    ratio = lf_energy / max(rms, c.scale_floor, 1e-6)
    slope, s.centered = abs(centered - s.centered), centered
    s.fast, s.slow = ema(s.fast, slope, dt, c.fast_tau_ms), ema(s.slow, slope, dt, c.slow_tau_ms)
    burst = s.fast / max(s.slow, 1.0)
    s.count += 1
    return filtered, centered, s.lf, rms, lf_energy, ratio, burst, max(ratio, burst if s.count >= 5 else 1.0), (rms - s.rest_center) / max(s.rest_scale, c.scale_floor), s.baseline


def bootstrap(s: FilterState, c: FilterConfig, baseline: float, center: float, scale: float, t_ms: int, seed: Sequence[float]) -> None:
    """Starts from known rest values (O-DSP-16): the last 128 of ``seed`` fill the window, a millisecond apart before
    ``t_ms``."""
    s.baseline, s.rest_center, s.rest_scale = baseline, center, max(scale, c.scale_floor)
    s.rest.clear()
    kept = list(seed)[-128:]
    for i, v in enumerate(kept):
        s.rest.put(t_ms - (len(kept) - i), float(v))


def learn_rest(s: FilterState, c: FilterConfig, t_ms: int, filtered: float, rms: float) -> float:
    """Takes a sample for rest (O-DSP-17): the baseline follows the filtered value, the rest statistics the level; the
    new level in units of rest."""
    s.baseline = ema(s.baseline, filtered, s.dt, c.baseline_tau_ms)
    s.rest.add(t_ms, rms)
    s.rest_center, s.rest_scale = s.rest.center(), s.rest.scale(c.scale_floor)
    return (rms - s.rest_center) / max(s.rest_scale, c.scale_floor)


def _chain(s: FilterState, c: FilterConfig, raw: float, seconds: float) -> float:
    """High-pass, notch at the rate as it is estimated now, low-pass."""
    s.fs = 0.95 * s.fs + 0.05 / max(seconds, 1e-6)
    rc = _lag(c.hp_hz)
    s.hp_y = rc / (rc + seconds) * (s.hp_y + raw - s.hp_x)
    s.hp_x = out = raw
    out = s.hp_y
    omega = 2.0 * pi * min(max(c.notch_hz / max(s.fs, 1.0), 0.0), 0.49)
    if omega > 0.0:
        x1, x2, y1, y2 = s.taps
        alpha, turn = sin(omega) / (2.0 * max(c.notch_q, 1.0)), -2.0 * cos(omega)
        a0 = 1.0 + alpha
        out = (s.hp_y + turn * x1 + x2 - turn * y1 - (1.0 - alpha) * y2) / a0
        s.taps = (s.hp_y, x1, out, y1)
    s.lp += seconds / (_lag(c.lp_hz) + seconds) * (out - s.lp)
    return s.lp


def snapshots(samples: DataFrame, config: FilterConfig = FilterConfig(), hop_ms: int = HOP_MS) -> DataFrame:
    """``samples`` with ``segment`` and ``FIELDS`` (D-3): a new filter state at every clock reset. Samples without a
    time or a value, which parsing never makes, are left out: they must not reach the recurrences."""

    def run(state: FilterState, key: tuple, rows: dict[str, list]) -> list[tuple]:
        given = zip(rows["arrival_seq"], rows["t_ms"], rows["raw"], rows["env"])
        return [(*key, seq, t, raw, env, *step(state, config, t, float(raw))) for seq, t, raw, env in given]

    given = with_segments(samples.dropna(subset=["t_ms", "raw"]), hop_ms).select("session", "segment", "arrival_seq", "t_ms", "raw", "env")
    schema = f"session {dict(samples.dtypes)['session']}, segment bigint, arrival_seq bigint, t_ms bigint, raw bigint, env bigint, " + ", ".join(f"{f} double" for f in FIELDS)
    return ordered_fold(given, ["session", "segment"], ["arrival_seq"], lambda: FilterState(fs=config.sample_hz), run, schema)


def rest_learning(samples: DataFrame, resting: Column, config: FilterConfig = FilterConfig(), hop_ms: int = HOP_MS) -> DataFrame:
    """Snapshots that learn rest from the samples for which ``resting`` holds (O-DSP-17): ``session, segment,
    arrival_seq, rms_state, baseline_raw, rest_center, rest_scale, u`` after each sample."""

    def run(state: FilterState, key: tuple, rows: dict[str, list]) -> list[tuple]:
        out = []
        for seq, t, raw, rest in zip(rows["arrival_seq"], rows["t_ms"], rows["raw"], rows["resting"]):
            made = step(state, config, t, float(raw))
            u = learn_rest(state, config, t, made[0], made[3]) if rest else made[8]
            out.append((*key, seq, made[3], state.baseline, state.rest_center, max(state.rest_scale, config.scale_floor), u))
        return out

    given = with_segments(samples.dropna(subset=["t_ms", "raw"]), hop_ms).select("session", "segment", "arrival_seq", "t_ms", "raw", F.coalesce(resting, F.lit(False)).alias("resting"))
    schema = f"session {dict(samples.dtypes)['session']}, segment bigint, arrival_seq bigint, rms_state double, baseline_raw double, rest_center double, rest_scale double, u double"
    return ordered_fold(given, ["session", "segment"], ["arrival_seq"], lambda: FilterState(fs=config.sample_hz), run, schema)


def with_aliases(snapshot: DataFrame, scale_floor: float = 5.0) -> DataFrame:
    """Old names of snapshot columns (D-3b)."""
    c = F.col
    return snapshot.withColumns(
        {"filtered_raw": c("filtered"), "rect": c("rms_state"), "fast": c("rms_state"), "slow": F.lit(0.0), "a": c("rms_state"), "sigma": F.lit(scale_floor), "z": c("u")}
    )


def rest_statistics(snapshot: DataFrame, value: str = "rms_state", window_ms: int = 3000, floor: float = 5.0, most: int = 3000) -> DataFrame:
    """``session, segment, arrival_seq, rest_center, rest_scale`` over the last ``window_ms``, at most ``most`` rows,
    after each row (O-DSP-14/15). Rows without a time or value are left out."""

    def run(window: RestWindow, key: tuple, rows: dict[str, list]) -> list[tuple]:
        out = []
        for seq, t, v in zip(rows["arrival_seq"], rows["t_ms"], rows["v"]):
            window.add(t, v)
            out.append((*key, seq, window.center(), window.scale(floor)))
        return out

    given = snapshot.select("session", "segment", "arrival_seq", "t_ms", F.col(value).cast("double").alias("v")).dropna(subset=["t_ms", "v"])
    schema = f"session {dict(snapshot.dtypes)['session']}, segment bigint, arrival_seq bigint, rest_center double, rest_scale double"
    return ordered_fold(given, ["session", "segment"], ["arrival_seq"], lambda: RestWindow(window_ms, most), run, schema)


#: Milliseconds that the device reads before its first sample, and between those readings.
WARMUP_MS, WARMUP_STEP_MS = 800, 2


def device_lines(spark: SparkSession, seconds: float, session: str = "device", sample_hz: int = 250, seed: int = 7) -> DataFrame:
    """Lines of a simulated device (O-SRC-13): a sample every ``1000 / sample_hz`` ms, noise about a mid level with a
    burst of two seconds in every ten, and the envelope of the device's own follower, whose base begins as the mean of
    what is read in the warm-up before: ``(session, arrival_seq, line)``."""
    period = 1000 // sample_hz
    quiet, loud = 20.0, 300.0

    def reading(deviation: Column, shift: int) -> Column:
        return F.greatest(F.least(F.round(2048 + F.randn(seed + shift) * deviation), F.lit(4095.0)), F.lit(0.0)).cast("bigint")

    t = F.col("id") * period
    raw = reading(F.when(F.pmod(t, F.lit(10_000)) >= 8_000, loud).otherwise(quiet), 0)
    samples = spark.range(int(seconds * 1000) // period).select(F.lit(session).alias("session"), (F.col("id") + 1).alias("arrival_seq"), raw.alias("raw"))
    # One row.
    base = spark.range(WARMUP_MS // WARMUP_STEP_MS).select(reading(F.lit(quiet), 1).alias("raw")).agg(F.avg("raw").alias("base"))
    made = device_envelope(samples.crossJoin(F.broadcast(base)))
    return made.select("session", "arrival_seq", F.concat_ws(" ", (F.col("arrival_seq") - 1) * period, "raw", F.floor("env_out")).alias("line"))


def device_envelope(samples: DataFrame) -> DataFrame:
    """The device's envelope follower (O-SRC-14): ``env, base, noise`` after each raw value; the base starts as
    ``samples`` say (``base``), or else at the first value, the noise at 10."""
    known = "base" in samples.columns

    def run(state: dict, key: tuple, rows: dict[str, list]) -> list[tuple]:
        out = []
        for seq, raw, base in zip(rows["arrival_seq"], rows["raw"], rows["base"]):
            if raw is None:
                continue
            if not state:
                state.update(env=0.0, base=float(raw if base is None else base), noise=10.0)
            env = state["env"] = 0.9 * state["env"] + 0.1 * abs(raw - state["base"])
            if env < 4.0 * state["noise"]:
                state["base"] = 0.998 * state["base"] + 0.002 * raw
                state["noise"] = 0.99 * state["noise"] + 0.01 * env
            out.append((*key, seq, raw, env, state["base"], state["noise"]))
        return out

    schema = f"session {dict(samples.dtypes)['session']}, arrival_seq bigint, raw bigint, env_out double, base double, noise double"
    base = F.col("base") if known else F.lit(None).cast("double").alias("base")
    return ordered_fold(samples.select("session", "arrival_seq", "raw", base), ["session"], ["arrival_seq"], dict, run, schema)
