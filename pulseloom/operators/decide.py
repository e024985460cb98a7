"""Decision gate: hysteresis, dwell and refractory time turn probabilities into events (O-DEC-*, O-PRJ-12)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ordered_fold


@dataclass(frozen=True)
class Gate:
    """The defaults that results must agree with."""

    enter: float = 0.60
    exit: float = 0.40
    enter_dwell: int = 2
    release_dwell: int = 2
    min_event_ms: int = 50
    refractory_ms: int = 80


GATE_COLUMNS = ("enter", "exit", "enter_dwell", "release_dwell", "min_event_ms", "refractory_ms")


@dataclass
class GateState:
    active: bool = False
    pending: bool | None = None
    frames: int = 0
    start_ms: int | None = None
    until_ms: int = 0
    ord: int = 0


def commit(s: GateState, g: Gate, active: bool, t: int) -> tuple[str, int, int, int]:
    """``(phase, start, end, duration)``; each down gets exactly one up or cancel."""
    s.active = active
    if active:
        s.start_ms = t
        return "down", t, t, 0
    start, s.start_ms = s.start_ms if s.start_ms is not None else t, None
    s.until_ms = t + g.refractory_ms
    duration = max(t - start, 0)
    return ("up" if duration >= g.min_event_ms else "cancel"), start, t, duration


def decide(s: GateState, g: Gate, t: int, p: float) -> tuple[str, int, int, int] | None:
    """The event, if any, of one frame."""
    target = p > g.exit if s.active else p >= g.enter
    if target and t < s.until_ms:
        target = False
    if target == s.active:
        s.pending, s.frames = None, 0
        return None
    s.frames = s.frames + 1 if s.pending == target else 1
    s.pending = target
    if s.frames < (g.enter_dwell if target else g.release_dwell):
        return None
    s.pending, s.frames = None, 0
    return commit(s, g, target, t)


EVENTS = "ord bigint, phase string, start_ms bigint, end_ms bigint, duration_ms bigint"


def edge_events(scored: DataFrame, gate: Gate | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Events of ``scored(session, ord_frame, t_ms, p)``, and of each ``config`` where there are gate columns.

    ``gate`` holds for all rows unless the rows bring ``config`` and ``GATE_COLUMNS``. Given ``ends(session,
    final_t_ms)``, a press that is open after the last frame is closed at that time, the session's last sample
    (O-DEC-6); without, it stays open, as in live runs.
    """
    many, flush = "config" in scored.columns, ends is not None
    keys = ["session", "config"] if many else ["session"]

    def start() -> dict:
        return {"state": GateState()}

    def step(held: dict, key: tuple, rows: dict[str, list]) -> list[tuple]:
        if "gate" not in held:
            held["gate"] = Gate(*(rows[c][0] for c in GATE_COLUMNS)) if many else gate or Gate()
        s, found = held["state"], []
        held["end"] = rows["final_t_ms"][-1] if flush else None
        for t, p in zip(rows["t_ms"], rows["p"]):
            event = decide(s, held["gate"], t, p)
            if event:
                s.ord += 1
                found.append((*key, s.ord, *event))
        return found

    def finish(held: dict, key: tuple) -> list[tuple]:
        s = held["state"]
        if held["end"] is None or not s.active:
            return []
        s.ord += 1
        return [(*key, s.ord, *commit(s, held["gate"], False, held["end"]))]

    kinds = dict(scored.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + EVENTS
    wanted = [*keys, "ord_frame", "t_ms", "p", *(GATE_COLUMNS if many else ())]
    rows = scored.select(*wanted)
    if flush:
        rows = rows.join(ends.select("session", "final_t_ms"), "session", "left")
    return ordered_fold(rows, keys, ["ord_frame"], start, step, schema, finish)


def session_ends(samples: DataFrame) -> DataFrame:
    """``(session, final_t_ms)``: the time of each session's last sample by arrival, and where samples have it the host's
    (``final_host_s``)."""
    last = [F.max_by("t_ms", "arrival_seq").alias("final_t_ms")] + ([F.max_by("host_time_s", "arrival_seq").alias("final_host_s")] if "host_time_s" in samples.columns else [])
    return samples.groupBy("session").agg(*last)


def frame_states(scored: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """``(session, ord_frame, t_ms, p, active)``: the gate's state after each frame (O-DEC-7/10)."""

    def step(s: GateState, key: tuple, rows: dict[str, list]) -> list[tuple]:
        out = []
        for o, t, p in zip(rows["ord_frame"], rows["t_ms"], rows["p"]):
            decide(s, gate, t, p)
            out.append((*key, o, t, p, int(s.active)))
        return out

    schema = f"session {dict(scored.dtypes)['session']}, ord_frame bigint, t_ms bigint, p double, active int"
    return ordered_fold(scored.select("session", "ord_frame", "t_ms", "p"), ["session"], ["ord_frame"], GateState, step, schema)


def overlay(scored: DataFrame, gate: Gate = Gate(), ends: DataFrame | None = None) -> DataFrame:
    """``(session, ord_frame, t_ms, p, active, down, up)``: the gate's state after each frame, and whether an event began or
    ended a press at its time (O-DEC-11)."""
    met = edge_events(scored, gate, ends).groupBy("session", F.col("end_ms").alias("t_ms")).agg(*[F.bool_or(F.col("phase") == x).alias(x) for x in ("down", "up")])
    none = F.lit(False)
    return frame_states(scored, gate).join(met, ["session", "t_ms"], "left").withColumns({"down": F.coalesce("down", none), "up": F.coalesce("up", none)})


def switch_events(edges: DataFrame) -> DataFrame:
    """Downs at their start without a duration, ups and cancels at their end (O-PRJ-12); other rows fall away."""
    down = F.col("phase") == "down"
    kept = [c for c in ("session", "config", "ord") if c in edges.columns]
    counted = [c for c in ("clicks", "last_duration_ms") if c in edges.columns]
    given = edges.where("phase IN ('down', 'up', 'cancel')" + (" AND state = 'active'" if "state" in edges.columns else ""))
    return given.select(
        *kept, "phase", F.when(down, F.col("start_ms")).otherwise(F.col("end_ms")).alias("t_ms"),
        F.when(down, F.lit(0).cast("bigint")).otherwise(F.col("duration_ms")).alias("duration_ms"), F.lit("active").alias("source_state"), *counted,
    )


def hysteresis(scored: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """The gate's target alone, without dwell or refractory time, as one running window (O-DEC-1)."""
    w = Window.partitionBy("session").orderBy("ord_frame")
    mark = F.when(F.col("p") >= gate.enter, 1).when(F.col("p") <= gate.exit, 0)
    return scored.withColumn("active", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0)))


def event_json(events: DataFrame, *optional: str) -> DataFrame:
    """``json`` of switch events (O-PRJ-13): type, phase, time, duration, source, and those of ``optional`` columns
    (``confidence``, ``host_time_s``) that are not null."""
    fields = [F.lit("switch").alias("type"), "phase", "t_ms", "duration_ms", "source_state", *optional]
    kept = [c for c in ("session", "config", "ord") if c in events.columns]
    return events.select(*kept, F.to_json(F.struct(*fields)).alias("json"))


def click_counts(events: DataFrame, resets: DataFrame | None = None) -> DataFrame:
    """Running number of ups, and the duration of the last one (O-AGG-15). ``resets(session, t_ms)`` begin both anew for
    events after them (O-DEC-10); an event at the time of a reset comes first."""
    up = F.col("phase") == "up"
    if resets is None:
        w = Window.partitionBy("session").orderBy("ord")
        return events.withColumns({"clicks": F.count_if(up).over(w), "last_duration_ms": F.last(F.when(up, F.col("duration_ms")), ignorenulls=True).over(w)})
    none = lambda c: F.lit(None).cast(events.schema[c].dataType).alias(c)
    marks = resets.select(*[F.col(c) if c in ("session", "t_ms") else none(c) for c in events.columns], F.lit(1).alias("__reset"))
    placed = events.withColumn("__reset", F.lit(0)).unionByName(marks)
    placed = placed.withColumn("__turn", F.sum("__reset").over(Window.partitionBy("session").orderBy("t_ms", "__reset", "ord").rowsBetween(Window.unboundedPreceding, 0))).where("__reset = 0")
    w = Window.partitionBy("session", "__turn").orderBy("ord")
    counted = placed.withColumns({"clicks": F.count_if(up).over(w), "last_duration_ms": F.last(F.when(up, F.col("duration_ms")), ignorenulls=True).over(w)})
    return counted.drop("__reset", "__turn")


