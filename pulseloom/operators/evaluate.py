"""Scoring of events against clicks and phases, leave-one-session-out, decision sweeps (O-EVL-*, O-JOIN-*)."""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_artifact, is_rest, per_minute, stable_sigmoid, threshold_score
from .decide import GATE_COLUMNS, edge_events, switch_events
from .folds import logistic_folds
from .islands import presses
from .loso import threshold_folds
from .ordered import ordered_fold
from ..sources.shared import written

def greedy_match(clicks: DataFrame, pressed: DataFrame, pre_ms: int = 400, post_ms: int = 600) -> DataFrame:
    """``(session, click_ord, press_ord)``: clicks in order take the first unused completed press whose down lies in
    ``[start - pre, end + post]`` (O-JOIN-3).

    Presses and clicks of a session (and config) stream in one order by time. Clicks are settled in their own order,
    each once no later press can reach it, and only presses in reach of clicks that are not settled are held.
    """
    keys = ["session"] + [c for c in ("config",) if c in pressed.columns]
    if "config" in keys and "config" not in clicks.columns:
        clicks = clicks.join(pressed.select(*keys).distinct(), "session")
    none = F.lit(None).cast("bigint")
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("ord")).cast("bigint")
    a = clicks.select(*keys, F.lit(0).alias("kind"), F.col("ord"), (F.col("start_ms") - pre_ms).alias("t"), (F.col("end_ms") + post_ms).alias("until"), turn.alias("turn"))
    b = pressed.where("up_ms IS NOT NULL").select(*keys, F.lit(1).alias("kind"), F.col("ord"), F.col("down_ms").alias("t"), none.alias("until"), none.alias("turn"))

    def settle(state: dict, now: int | None) -> list[tuple]:
        found, clicks, presses = [], state["clicks"], state["presses"]
        while (click := clicks.get(state["turn"])) and (now is None or click[2] < now):
            o, low, high = clicks.pop(state["turn"])
            state["turn"] += 1
            inside = [(p, t) for t, p in presses if low <= t <= high]
            if inside:
                p, t = min(inside)
                presses.remove((t, p))
                found.append((o, p))
            # No click that is held or still to come reaches back further than these.
            first = min((c[1] for c in clicks.values()), default=now)
            while presses and first is not None and presses[0][0] < first:
                presses.popleft()
        return found

    def step(state: dict, key: tuple, rows: dict[str, list]) -> list[tuple]:
        found = []
        for kind, o, t, until, turn in zip(rows["kind"], rows["ord"], rows["t"], rows["until"], rows["turn"]):
            found += settle(state, t)
            if kind == 0:
                state["clicks"][turn] = (o, t, until)
            elif state["clicks"]:
                state["presses"].append((t, o))
        return [(*key, *x) for x in found]

    def finish(state: dict, key: tuple) -> list[tuple]:
        return [(*key, *x) for x in settle(state, None)]

    kinds = dict(pressed.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", click_ord bigint, press_ord bigint"
    return ordered_fold(a.unionByName(b), keys, ["t", "kind", "ord"], lambda: {"clicks": {}, "presses": deque(), "turn": 1}, step, schema, finish)


def unused_presses(pressed: DataFrame, matched: DataFrame) -> DataFrame:
    """O-JOIN-4."""
    keys = ["session"] + [c for c in ("config",) if c in pressed.columns]
    used = matched.select(*keys, F.col("press_ord").alias("ord"))
    return pressed.where("up_ms IS NOT NULL").join(used, [*keys, "ord"], "left_anti")


def classify_downs(downs: DataFrame, phases: DataFrame) -> DataFrame:
    """``downs`` with ``bucket``: that of the first phase, by order, that holds ``down_ms``, both ends counted; other
    where none does (O-JOIN-2)."""
    p = phases.select(F.col("session").alias("__s"), F.col("ord").alias("__ord"), "start_ms", "end_ms", is_artifact(F.col("name")).alias("art"), is_rest(F.col("name"), F.col("label")).alias("rest"))
    # Places are judged once each, however many downs share one, and repeated downs stay.
    places = downs.select(F.col("session").alias("__d"), F.col("down_ms").alias("__t")).distinct()
    met = places.join(p, (F.col("__d") == F.col("__s")) & F.col("__t").between(F.col("start_ms"), F.col("end_ms")))
    bucket = F.when(F.col("art"), "artifact").when(F.col("rest"), "rest").otherwise("other")
    judged = met.groupBy("__d", "__t").agg(F.min_by(bucket, "__ord").alias("bucket"))
    found = downs.join(judged, (F.col("session") == F.col("__d")) & (F.col("down_ms") == F.col("__t")), "left")
    return found.select(*downs.columns, F.coalesce("bucket", F.lit("other")).alias("bucket"))


def phase_seconds(phases: DataFrame) -> DataFrame:
    """O-AGG-11."""
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000.0
    art = is_artifact(F.col("name"))
    total = lambda c: F.coalesce(F.sum(F.when(c, seconds)), F.lit(0.0))
    return phases.groupBy("session").agg(total(is_rest(F.col("name"), F.col("label"))).alias("rest_seconds"), total(art).alias("artifact_seconds"))


LATENCIES = ("down_latency", "up_latency", "duration_error")


def session_scores(sessions: DataFrame, events: DataFrame, clicks: DataFrame, phases: DataFrame, pre_ms: int = 400, post_ms: int = 600) -> tuple[DataFrame, DataFrame]:
    """One row of counts and seconds for each of ``sessions`` (and config), and one row of ``LATENCIES`` for each click
    that was detected (O-AGG-9)."""
    keys = ["session"] + [c for c in ("config",) if c in sessions.columns]
    clicks, pressed = written(clicks, "clicks"), written(presses(events), "presses")
    matched = written(greedy_match(clicks, pressed, pre_ms, post_ms), "matches")
    late = {
        "down_latency": F.col("down_ms") - F.col("start_ms"), "up_latency": F.col("up_ms") - F.col("end_ms"),
        "duration_error": F.greatest(F.col("up_ms") - F.col("down_ms"), F.lit(0)) - (F.col("end_ms") - F.col("start_ms")),
    }
    hits = (
        matched.join(clicks.select("session", F.col("ord").alias("click_ord"), "start_ms", "end_ms"), ["session", "click_ord"])
        .join(pressed.select(*keys, F.col("ord").alias("press_ord"), "down_ms", "up_ms"), [*keys, "press_ord"])
        .select(*keys, *[c.cast("double").alias(name) for name, c in late.items()])
    )
    detected = matched.groupBy(*keys).agg(F.count("*").alias("detected"))
    false = classify_downs(unused_presses(pressed, matched), phases).groupBy(*keys).agg(
        *[F.count_if(F.col("bucket") == b).alias(f"false_{b}") for b in ("rest", "artifact", "other")]
    )
    cancelled = pressed.groupBy(*keys).agg(F.count_if(F.col("up_ms").isNull()).alias("cancelled"))
    n = clicks.groupBy("session").agg(F.count("*").alias("clicks"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("clicks", "detected", "cancelled", "false_rest", "false_artifact", "false_other")}
    zero |= {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("rest_seconds", "artifact_seconds")}
    made = sessions.select(*keys).join(n, "session", "left").join(phase_seconds(phases), "session", "left")
    for part in (detected, false, cancelled):
        made = made.join(part, keys, "left")
    return made.withColumns(zero).withColumn("missed", F.col("clicks") - F.col("detected")), hits


def aggregate_scores(scores: DataFrame, hits: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The sixteen totals of all sessions, medians over all detected clicks among them (O-AGG-10)."""
    sums = ("clicks", "detected", "missed", "cancelled", "false_rest", "false_artifact", "rest_seconds", "artifact_seconds")
    totals = scores.groupBy(*keys).agg(F.count("*").alias("sessions"), *[F.sum(c).alias(c) for c in sums])
    pooled = hits.groupBy(*keys).agg(*[F.median(c).alias(f"{c}_median") for c in LATENCIES], F.avg("down_latency").alias("down_latency_mean"))
    # Without keys both are single rows.
    out = totals.join(pooled, list(keys), "left") if keys else totals.crossJoin(F.broadcast(pooled))
    medians = [c for c in out.columns if c.endswith(("_median", "_mean"))]
    rates = {
        "detection_rate": F.when(F.col("clicks") > 0, F.col("detected") / F.col("clicks")).otherwise(0.0),
        "false_rest_per_min": per_minute(F.col("false_rest"), F.col("rest_seconds")),
        "false_artifact_per_min": per_minute(F.col("false_artifact"), F.col("artifact_seconds")),
    }
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in medians} | rates)


def decision_grid(spark) -> DataFrame:
    """The default 36 gates in their order (O-EVL-5)."""
    rows = [
        (i, e, x, d, 2, m, 80)
        for i, (e, x, m, d) in enumerate(itertools.product((0.6, 0.7, 0.8), (0.4, 0.5), (50, 120, 200), (2, 3)))
        if x < e
    ]
    return spark.createDataFrame(rows, "config int, enter double, `exit` double, enter_dwell int, release_dwell int, min_event_ms int, refractory_ms int")


def rank_sweep(rows: DataFrame, least_detection: float = 0.9, most_latency: float = 200.0) -> DataFrame:
    """``rows`` with ``rank`` (O-EVL-7): those that meet the floor first, then fewer false downs a minute at rest, then
    in artifacts, then more detection, then less latency, then the order of the grid. A row for each config."""
    meets = (F.col("detection_rate") >= least_detection) & (F.col("down_latency_median") <= most_latency)
    order = Window.orderBy(F.when(meets, 0).otherwise(1), "false_rest_per_min", "false_artifact_per_min", -F.col("detection_rate"), "down_latency_median", "config")
    return rows.withColumns({"meets_floor": meets, "rank": F.row_number().over(order).cast("bigint")})


def loso_models(examples: DataFrame, sessions: DataFrame, feature: str) -> DataFrame:
    """``(session, threshold, f1, softness)``: the threshold model that is trained on all other sessions (O-EVL-2/3)."""
    return threshold_folds(examples, sessions, feature)


def loso_logreg(examples: DataFrame, sessions: DataFrame, features: Sequence[str], epochs: int = 200, rate: float = 0.05, l2: float = 1e-4, seed: int = 7) -> dict:
    """``session -> {weights, bias, center, scale}``: the logistic model that is trained on all other sessions
    (O-EVL-3)."""
    return logistic_folds(examples, sessions, features, epochs, rate, l2, seed)


def score_folds(frames: DataFrame, fitted: dict, features: Sequence[str]) -> DataFrame:
    """``(session, ord_frame, t_ms, p)`` of each session under its fold's logistic model."""
    kind = dict(frames.dtypes)["session"]
    rows = [(n, m["weights"], m["bias"], m["center"], m["scale"]) for n, m in fitted.items()]
    # The folds' models are at the driver, so they fit a task too.
    sent = F.broadcast(frames.sparkSession.createDataFrame(rows, f"session {kind}, w array<double>, b double, c array<double>, s array<double>"))
    total = sum((F.get("w", i) * (F.col(f).cast("double") - F.get("c", i)) / F.get("s", i) for i, f in enumerate(features)), F.col("b"))
    return frames.join(sent, "session").select("session", "ord_frame", "t_ms", stable_sigmoid(total).alias("p"))


def replay_scored(scored: DataFrame, ends: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """Switch events of scored frames, and of each gate of ``grid``; open presses close at ``ends``."""
    if grid is not None:
        scored = scored.crossJoin(F.broadcast(grid.select("config", *GATE_COLUMNS)))
    return switch_events(edge_events(scored, ends=ends))


def replay(frames: DataFrame, models: DataFrame, feature: str, ends: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """Switch events of each session under its fold's model, and of each gate of ``grid`` (O-EVL-1/6): features once,
    probabilities once, then one fold for each session and gate. Open presses close at ``ends(session, final_t_ms)``."""
    p = threshold_score(F.col(feature), F.col("threshold"), F.col("softness"))
    return replay_scored(frames.join(models, "session").select("session", F.col("ord_frame"), "t_ms", p.alias("p")), ends, grid)
