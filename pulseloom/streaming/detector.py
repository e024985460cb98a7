"""The detector as a stateful stream: samples in, events out, one state for each session (O-STR-*, O-DEC-9/10, O-UDF-1).

The kernels are those of the batch operators: ``dsp.step`` for the filters and ``decide.decide`` for the gate. A session's
state is columns of numbers in the state store: one row for the gate, the filters and the schedule, and lists for the
buffers. Any class that says what its columns are can take the detector's place.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.decide import EVENTS, Gate, GateState, commit, decide
from ..operators.dsp import FilterConfig, FilterState, bootstrap, step
from ..operators.score import FrameModel
from ..sources.profiles import Profile
from ..sources.shared import shared_dir

#: The state store that keeps several states for a key, and the setting that names it.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def threshold(value: float, softness: float, feature: str = "waveform_length") -> FrameModel:
    """A threshold model of one frame feature."""
    return FrameModel(Profile("threshold", [feature], model={"feature": feature, "threshold": value, "softness": softness}))


_GATE = {"active": "boolean", "pending": "boolean", "frames": "bigint", "start_ms": "bigint", "until_ms": "bigint", "ord": "bigint"}
_FILTERS = {f.name: "bigint" if f.name in ("last_t", "count", "dt") else "double" for f in fields(FilterState) if f.name not in ("taps", "sums", "window", "rest")}
_ARRAYS = {"taps": "array<double>", "sums": "array<double>"}


def ddl(**groups: dict[str, str]) -> str:
    return ", ".join(f"{group}_{name} {kind}" for group, columns in groups.items() for name, kind in columns.items())


@dataclass
class Extractor:
    """Samples to frames, one at a time. A clock that goes back begins filters, buffer and schedule anew."""

    window_ms: int = 120
    hop_ms: int = 30
    filtered: bool = True
    filters: FilterState = field(default_factory=FilterState)
    points: deque = field(default_factory=deque)
    next_end: int | None = None
    last_t: int | None = None

    #: Columns of the state's row and of its lists.
    ROW = ddl(filters={**_FILTERS, **_ARRAYS}, frames={"next_end": "bigint", "last_t": "bigint"})
    LISTS = {"points": "t bigint, value double, slope double, lf double, env bigint", "window": "t bigint, a double, b double", "rest": "t bigint, v double"}

    def update(self, t: int, raw: int, env: int = 0) -> list[tuple[int, dict]]:
        """The frames that a sample closes, each with its end."""
        window_ms, hop_ms = max(self.window_ms, 20), max(self.hop_ms, 10)
        if self.last_t is not None and t + hop_ms < self.last_t:
            self.filters, self.points, self.next_end = FilterState(), deque(), None
        if self.next_end is None:
            self.next_end = t + window_ms
        self.last_t = t
        made = step(self.filters, FilterConfig(), t, float(raw)) if self.filtered else (float(raw),) + (0.0,) * 9
        # (time, value, slope burst, low-frequency energy, envelope)
        self.points.append((t, made[0], made[6], made[4], env))
        out = []
        while t >= self.next_end:
            inside = [p for p in self.points if self.next_end - window_ms <= p[0] <= self.next_end]
            if len(inside) >= 2:
                values = [p[1] for p in inside]
                level = lambda i: (sum(p[i] * p[i] for p in inside) / len(inside)) ** 0.5
                frame = {
                    "waveform_length": float(sum(abs(b - a) for a, b in zip(values, values[1:]))),
                    "rms_state": level(1),
                    "slope_burst": float(median(p[2] for p in inside)),
                    "lf_energy_ratio": level(3) / max(level(1), 1e-6),
                    "filtered_raw_hp": inside[-1][1],
                    "env_in": inside[-1][4],
                }
                out.append((self.next_end, frame))
            self.next_end += hop_ms
        while self.points and self.points[0][0] < t - 4 * window_ms:
            self.points.popleft()
        return out

    def dump(self) -> tuple[list, dict[str, list[tuple]]]:
        f = self.filters
        row = [getattr(f, c) for c in _FILTERS] + [list(f.taps), list(f.sums), self.next_end, self.last_t]
        return row, {"points": list(self.points), "window": list(f.window), "rest": list(f.rest.rows)}

    def load(self, values: Iterator, lists: dict[str, list[tuple]]) -> None:
        f = self.filters
        for c in _FILTERS:
            setattr(f, c, next(values))
        f.taps, f.sums = tuple(next(values)), tuple(next(values))
        self.next_end, self.last_t = next(values), next(values)
        self.points, f.window = (deque(tuple(x) for x in lists[c]) for c in ("points", "window"))
        for t, v in lists["rest"]:
            f.rest.put(t, v)


class Detector:
    """What a session carries between micro-batches. The gate and the count of clicks outlive clock resets, filters and
    frames do not."""

    _OWN = {"probability": "double", "clicks": "bigint", "last_duration_ms": "bigint"}
    #: Columns of the state: those of its one row, and those of its lists.
    SCALARS = f"{ddl(gate=_GATE, own=_OWN)}, {Extractor.ROW}"
    LISTS = {**Extractor.LISTS, "memory": "x array<double>"}
    #: Columns of what comes out after the session.
    OUTPUT = f"{EVENTS}, clicks bigint, last_duration_ms bigint"

    def __init__(self, model: Callable, config: Gate = Gate(), window_ms: int = 120, hop_ms: int = 30, filtered: bool = True) -> None:
        self.model, self.config, self.gate = model, config, GateState()
        self.extractor, self.memory = Extractor(window_ms, hop_ms, filtered), []
        self.probability, self.clicks, self.last_duration_ms = 0.0, 0, None

    def update(self, t: int, raw: int, env: int = 0) -> list[tuple]:
        """Events of one sample."""
        out = []
        for end, frame in self.extractor.update(t, raw, env):
            self.probability = self.model(frame, self.memory)
            event = decide(self.gate, self.config, end, self.probability)
            if event:
                out.append(self._counted(event))
        return out

    def _counted(self, event: tuple) -> tuple:
        self.gate.ord += 1
        if event[0] == "up":
            self.clicks, self.last_duration_ms = self.clicks + 1, event[3]
        return (self.gate.ord, *event, self.clicks, self.last_duration_ms)

    def flush(self) -> list[tuple]:
        """Closes an open press at the last sample."""
        return [self._counted(commit(self.gate, self.config, False, self.extractor.last_t))] if self.gate.active else []

    def control(self, name: str) -> list[tuple]:
        """``reset`` counts clicks anew (O-DEC-10), ``flush`` is the end of a recording; others mean nothing."""
        if name == "reset":
            self.clicks, self.last_duration_ms = 0, None
        return self.flush() if name == "flush" else []

    def seed(self, given) -> None:
        """Starts as after a sample at rest, with known rest values (O-DSP-16): ``baseline, center, scale, t_ms, seed``."""
        step(self.extractor.filters, FilterConfig(), int(given.t_ms), float(given.baseline))
        bootstrap(self.extractor.filters, FilterConfig(), given.baseline, given.center, given.scale, int(given.t_ms), list(given.seed))

    def rows(self, batches: list[pd.DataFrame]) -> list[tuple]:
        """What comes out of the rows of a micro-batch, taken in the order of arrival."""
        # A few numbers a row are all that is kept of a micro-batch until it can be put in order.
        seq, t, raw, control = (np.concatenate([b[c].to_numpy() for b in batches]) for c in ("arrival_seq", "t_ms", "raw", "control"))
        found = []
        for i in np.argsort(seq, kind="stable").tolist():
            if control[i] is not None:
                found += self.control(control[i])
            else:
                found += self.update(int(t[i]), int(raw[i]))
        return found

    def due(self) -> float | None:
        """When something is to be done without a row; never."""
        return None

    def expire(self, now: float) -> list[tuple]:
        return []

    def dump(self) -> tuple[tuple, dict[str, list[tuple]]]:
        """The state's row and lists."""
        row, lists = self.extractor.dump()
        own = [getattr(self.gate, c) for c in _GATE] + [getattr(self, c) for c in self._OWN]
        return (*own, *row), lists | {"memory": [(list(x),) for x in self.memory]}

    def load(self, row: tuple, lists: dict[str, list[tuple]]) -> None:
        values = iter(row)
        for c in _GATE:
            setattr(self.gate, c, next(values))
        for c in self._OWN:
            setattr(self, c, next(values))
        self.extractor.load(values, lists)
        self.memory = [list(x) for (x,) in lists["memory"]]


class SessionProcessor(StatefulProcessor):
    """Runs a detector, or what has its methods, for each session: ``make()`` gives one that has seen nothing, with
    ``SCALARS``, ``LISTS``, ``OUTPUT``, ``rows``, ``seed``, ``due``, ``expire``, ``dump`` and ``load``. With ``ttl_ms`` a
    session that was quiet for so long is forgotten. With ``timed`` it is woken when it is due, in seconds of the host."""

    def __init__(self, make: Callable, ttl_ms: int | None = None, timed: bool = False) -> None:
        self.make, self.ttl_ms, self.timed = make, ttl_ms, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = self.make()
        self.handle, self.columns = handle, ["session", *(x.split()[0] for x in one.OUTPUT.split(", "))]
        self.row = handle.getValueState("scalars", one.SCALARS, self.ttl_ms)
        self.lists = {name: handle.getListState(name, kind, self.ttl_ms) for name, kind in one.LISTS.items()}

    def _held(self):
        found = self.make()
        if self.row.exists():
            found.load(self.row.get(), {name: list(state.get()) for name, state in self.lists.items()})
        return found

    def _hold(self, detector) -> None:
        row, lists = detector.dump()
        self.row.update(row)
        for name, state in self.lists.items():
            if lists[name]:
                state.put(lists[name])
            elif state.exists():
                state.clear()
        if self.timed:
            due = detector.due()
            wanted = [int(due * 1000) + 1] if due is not None else []
            there = list(self.handle.listTimers())
            for t in there:
                if t not in wanted:
                    self.handle.deleteTimer(t)
            for t in wanted:
                if t not in there:
                    self.handle.registerTimer(t)

    def _out(self, key: tuple, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *e) for e in found], columns=self.columns)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        detector = self.make()
        for r in initialState.itertuples(index=False):
            detector.seed(r)
        self._hold(detector)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        detector = self._held()
        found = detector.rows(list(rows))
        self._hold(detector)
        yield self._out(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        detector = self._held()
        found = detector.expire(expiredTimerInfo.getExpiryTimeInMs() / 1000.0)
        self._hold(detector)
        yield self._out(key, found)

    def close(self) -> None:
        """Nothing is held open."""


#: Most rows of a session in a micro-batch of a replay.
ROWS = 1 << 20
COLUMNS = ["ord", "phase", "start_ms", "end_ms", "duration_ms"]


def detect(
    samples: DataFrame, model, gate: Gate = Gate(), window_ms: int = 120, hop_ms: int = 30, filtered: bool = True, *, make: Callable | None = None, initial: DataFrame | None = None, ttl_ms: int | None = None,
    counts: bool = False,
) -> DataFrame:
    """Events of a stream of ``(session, arrival_seq, t_ms, raw)``; no watermark, no flush, as live runs have it, and state
    without end unless ``ttl_ms`` is given. ``model(frame, memory)`` may be any callable of that form, ``make`` any factory
    of detectors (then what comes before it is not looked at). Rows of a micro-batch are taken in the order of
    ``arrival_seq``. A column ``control`` may say ``reset`` in rows between the samples; with ``counts`` events come with
    the clicks since then and the last one's duration. ``initial(session, baseline, center, scale, t_ms, seed
    array<double>)`` are sessions that start from known rest. The session must use the RocksDB state store."""
    spark = samples.sparkSession
    if spark.conf.get(STORE, None) != ROCKS:
        raise ValueError(f"set {STORE} to {ROCKS}")
    make = make or (lambda: Detector(model, gate, window_ms, hop_ms, filtered))
    kind = dict(samples.dtypes)["session"]
    control = F.col("control") if "control" in samples.columns else F.lit(None)
    given = samples.withColumn("control", control.cast("string")).where("control IS NOT NULL OR (t_ms IS NOT NULL AND raw IS NOT NULL)")
    whole = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c)
    given = given.select("session", whole("arrival_seq"), whole("t_ms"), whole("raw"), "control")
    start = initial.groupBy("session") if initial is not None else None
    found = given.groupBy("session").transformWithStateInPandas(
        SessionProcessor(make, ttl_ms), f"session {kind}, {make().OUTPUT}", "append", "ProcessingTime" if ttl_ms else "None", start
    )
    return found if counts or make().OUTPUT != Detector.OUTPUT else found.select("session", *COLUMNS)


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose streams use the RocksDB state store."""
    found = spark.newSession()
    for c in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        found.conf.set(c, spark.conf.get(c))
    found.conf.set(STORE, ROCKS)
    return found


def replay_stream(spark: SparkSession, samples: DataFrame, model, gate: Gate, window_ms: int, hop_ms: int, filtered: bool = True, files: int = 4) -> DataFrame:
    """Recorded samples played through ``detect`` in several micro-batches, in their order, and what it wrote
    (O-SRC-12, O-STR-3). Samples, numbered within their sessions, are cut by number into ``files`` parts, or as many as it
    takes for ``ROWS`` numbers a part; each part is a micro-batch, so that a session's state is carried on."""
    at = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    low, high = samples.agg(F.min("arrival_seq"), F.max("arrival_seq")).first()
    size = max(1, min(ROWS, -(-((high or 0) - (low or 0) + 1) // files)))
    placed = samples.where("arrival_seq IS NOT NULL").withColumn("part", F.floor((F.col("arrival_seq") - (low or 0)) / size).cast("int"))
    # Written once by part, so that each part is read alone; a part is spread over several files.
    placed.repartition("part", F.pmod(F.xxhash64("session", "arrival_seq"), F.lit(8))).write.partitionBy("part").parquet(f"{at}/parts")
    parts = sorted(r["part"] for r in placed.select("part").distinct().toLocalIterator())
    samples.limit(0).write.parquet(f"{at}/in")
    stream = streaming_session(spark).readStream.schema(samples.schema).parquet(f"{at}/in")
    events = detect(stream, model, gate, window_ms, hop_ms, filtered)
    if not parts:
        return spark.createDataFrame([], events.schema)
    stored = spark.read.schema(placed.schema).parquet(f"{at}/parts")
    for i in parts:
        stored.where(F.col("part") == i).select(*samples.columns).write.mode("append").parquet(f"{at}/in")
        sink = events.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append")
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{at}/out")


#: Milliseconds of a replay's tick, and most samples that it admits.
TICK_MS, TICK_SAMPLES = 10, 25


def ticks(samples: DataFrame) -> DataFrame:
    """``samples`` with ``tick``, when a replay at speed 1 admits them (O-STR-3): a tick admits, in order, samples whose
    time has come, ``TICK_SAMPLES`` at most. Sample i of a session, whose time comes with tick d(i), is thus due at
    ``max over j <= i of (TICK_SAMPLES * d(j) - j) + i``, over ``TICK_SAMPLES``. At the tick after a session's last sample
    comes a row that flushes it."""
    w = Window.partitionBy("session").orderBy("arrival_seq")
    rows = samples.dropna(subset=["t_ms", "raw"]).select("session", "arrival_seq", "t_ms", "raw", F.lit(None).cast("string").alias("control"))
    placed = rows.withColumns({"i": F.row_number().over(w) - 1, "d": F.ceil(F.greatest(F.col("t_ms") - F.first("t_ms").over(w), F.lit(0)) / TICK_MS)})
    placed = placed.withColumn("tick", F.floor((F.max(F.col("d") * TICK_SAMPLES - F.col("i")).over(w) + F.col("i")) / TICK_SAMPLES))
    ends = placed.groupBy("session").agg((F.max("arrival_seq") + 1).alias("arrival_seq"), (F.max("tick") + 1).alias("tick"))
    flushes = ends.select("session", "arrival_seq", F.lit(None).cast("bigint").alias("t_ms"), F.lit(None).cast("bigint").alias("raw"), F.lit("flush").alias("control"), "tick")
    return placed.drop("i", "d").unionByName(flushes)


def ticks_a_second(speed: float) -> int:
    return max(1, round(1000 / TICK_MS * max(speed, 0.01)))


def paced(samples: DataFrame, speed: float = 1.0) -> tuple[DataFrame, int]:
    """A stream of recorded ``samples`` at ``speed`` times their own pace, and the tick of its last row. The clock is
    Spark's rate source, a row a tick, which comes second by second; what it meets is the recording, written once."""
    spark = samples.sparkSession
    path = f"{shared_dir(spark)}/paced-{uuid.uuid4().hex}"
    ticks(samples).write.parquet(path)
    held = spark.read.schema("session " + dict(samples.dtypes)["session"] + ", arrival_seq bigint, t_ms bigint, raw bigint, control string, tick bigint").parquet(path)
    clock = spark.readStream.format("rate").option("rowsPerSecond", ticks_a_second(speed)).load()
    last = held.agg(F.max("tick")).first()[0]
    return clock.select(F.col("value").alias("tick")).join(held, "tick").drop("tick"), -1 if last is None else last
