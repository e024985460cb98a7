"""Command line over recorded sessions and device lines (O-API-*): train, study, eval, record, prompt-record, monitor,
switch and replay. Errors that a user can mend end with exit code 2."""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import models
from .operators import decide, dsp, evaluate, frames, islands, protocol, record, score, training
from .sources import keyboard, profiles, serial, sessions
from .sources.shared import shared_dir
from .streaming import detector, recorder, status

MODELS = ("threshold", "logreg", *models.SEQUENCE)
PROFILE = "models/binary_profile.json"


class Refused(Exception):
    """What the user asked for can't be done."""


def items(text: str, kind=str) -> list:
    return [kind(x.strip()) for x in text.split(",") if x.strip()]


def parse_configs(text: str) -> list[tuple[str, str]]:
    """``model:features`` pairs; a missing colon is an error (O-PRJ-18)."""
    out = []
    for item in items(text):
        model, colon, features = item.partition(":")
        if not colon:
            raise ValueError(f"expected model:features, got {item!r}")
        out.append((model.strip(), features.strip()))
    return out


def feature_frames(samples: DataFrame, window_ms: int = frames.WINDOW_MS, hop_ms: int = frames.HOP_MS) -> DataFrame:
    """Frames of the filtered samples, numbered within their sessions."""
    rows = dsp.snapshots(samples, hop_ms=hop_ms).drop("raw", "segment").withColumnRenamed("filtered", "raw")
    made = frames.frames(rows, "raw", window_ms, hop_ms, slope="slope_burst", lf="lf_energy")
    number = F.row_number().over(Window.partitionBy("session").orderBy("segment", "frame")).cast("bigint")
    return made.withColumns({"ord_frame": number, "t_ms": F.col("end_ms")})


def recorded_examples(spark: SparkSession, root: str, features: Sequence[str], margin_ms: int) -> DataFrame:
    """Labelled frames of the folders that have feature rows and at least one interval (O-ML-1)."""
    names = sessions.session_names(spark, root, first="features.csv", check=False)
    if not names:
        raise Refused(f"no interval-labelled sessions under {root}")
    rows = sessions.read_features(spark, root, tuple(features)).where(F.col("session").isin(names))
    clicks = islands.label_intervals(sessions.label_intervals_of(sessions.read_labels(spark, root)))
    rows = rows.join(clicks.select("session").distinct(), "session", "left_semi")
    return training.label_frames(rows, clicks, margin_ms)


def split(examples: DataFrame, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Training and validation examples by session; with one session by a shuffle of its examples (O-ML-2)."""
    names = [r["session"] for r in examples.select("session").distinct().collect()]
    if len(names) >= 2:
        _, held = training.split_sessions(names, share, seed)
        return examples.where(~F.col("session").isin(held)), examples.where(F.col("session").isin(held))
    return training.split_examples(examples, share, seed)


def fit(model: str, train: DataFrame, features: Sequence[str], epochs: int, rate: float, seed: int) -> profiles.Profile:
    n = train.count()
    if not n:
        raise Refused("no training examples")
    about = {"trained_at_utc": datetime.now(timezone.utc).isoformat(), "train_examples": n}
    if model == "threshold":
        best = training.threshold_search(train, features[0]).first()
        return profiles.Profile("threshold", [features[0]], model={"feature": features[0], "threshold": best.threshold, "softness": best.softness}, metadata=about)
    if model == "logreg":
        m = training.fit_logreg(train, features, epochs, rate, seed=seed)
        norm = {"center": m["center"], "scale": m["scale"], "floor": {f: 1e-6 for f in features}}
        return profiles.Profile("logreg", list(features), norm, {"weights": m["weights"], "bias": m["bias"]}, metadata=about | {"epochs": epochs, "learning_rate": rate})
    models.require_torch()
    raise RuntimeError(f"training of {model} is not built here")


def metrics(profile: profiles.Profile, held: DataFrame) -> dict[str, float]:
    """Counts and rates on held-out examples; a threshold model decides at its threshold (O-ML-5)."""
    found = {}
    if not held.isEmpty():
        feature = profile.model.get("feature")
        scored = held.withColumn("p", (F.col(feature) >= profile.model["threshold"]).cast("double")) if feature else score.score_frames(held, profile)
        found = {k: float(v) for k, v in training.confusion(scored).first().asDict().items()}
    return found | ({"threshold": float(profile.model["threshold"])} if profile.model_type == "threshold" else {})


def train(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    features = training.features_of(args.features)
    rows = recorded_examples(spark, args.sessions, features, args.ignore_margin_ms).persist()
    if rows.isEmpty():
        raise Refused("no interval-labelled examples")
    part, held = split(rows, args.val_fraction, args.seed)
    out, found = Path(args.out), []
    for name in MODELS if args.model == "all" else [args.model]:
        try:
            profile = fit(name, part, features, args.epochs, args.learning_rate, args.seed)
        except RuntimeError as e:
            if args.allow_skip_optional and name in models.SEQUENCE:
                print(f"skipped {name}: {e}", file=sys.stderr)
                continue
            raise
        path = out / f"{name}.json" if args.model == "all" else out
        measured = metrics(profile, held)
        profiles.save(profile, str(path), measured, None if args.model == "all" else args.metrics_out)
        found.append({"model": name, "profile": str(path), "train_examples": profile.metadata["train_examples"], "val_examples": held.count(), **measured})
        print(json.dumps(found[-1], sort_keys=True), flush=True)
    if args.model == "all":
        (out / "summary.json").write_text(json.dumps(found, indent=2))
        if found:
            # The first of equals wins (O-SNK-7).
            profiles.save(profiles.load(max(found, key=lambda r: r.get("f1", 0.0))["profile"]), str(out / "best.json"))
    return found


def study(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    """Every model, feature set, share of the training examples and setting (O-JOIN-8, O-API-3)."""
    found = []
    for spec in items(args.features):
        features = training.features_of(spec)
        rows = recorded_examples(spark, args.sessions, features, args.ignore_margin_ms).persist()
        base, held = split(rows, 0.25, args.seed)
        for fraction in items(args.fractions, float):
            part = training.prefix(base, fraction, ["arrival_seq"])
            for name in items(args.models):
                for epochs in [1] if name == "threshold" else items(args.epochs, int):
                    for hidden in [0] if name in ("threshold", "logreg") else items(args.hidden, int):
                        row = {"model": name, "features": spec, "fraction": fraction, "epochs": epochs, "hidden": hidden, "train_examples": part.count(), "val_examples": held.count()}
                        try:
                            row |= metrics(fit(name, part, features, epochs, 0.05, args.seed), held)
                        except RuntimeError as e:
                            if name not in models.SEQUENCE:
                                raise
                            row["skipped"] = str(e)
                        found.append(row)
                        print(row, flush=True)
        rows.unpersist()
    Path(args.out).parent.mkdir(parents=True, exist_ok=True)
    Path(args.out).write_text(sessions.report(found))
    return found


def loso(spark: SparkSession, args: argparse.Namespace, model: str, spec: str, grid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of every session under the model of the others, and the latencies of its hits (O-EVL-1..6)."""
    features, exclude = training.features_of(spec), tuple(items(args.exclude))
    if model not in ("threshold", "logreg"):
        raise ValueError(f"no folds for {model!r}")
    names = sessions.session_names(spark, args.sessions, args.include_glob, exclude)
    rows = recorded_examples(spark, args.sessions, features, args.ignore_margin_ms).where(F.col("session").isin(names)).persist()
    if rows.select("session").distinct().count() < 2:
        raise ValueError("leaving one session out needs at least 2 labelled sessions")
    folds = spark.createDataFrame([(n,) for n in names], "session string")
    samples = sessions.read_raw(spark, args.sessions, args.include_glob, exclude)
    made, ends = feature_frames(samples).persist(), decide.session_ends(samples)
    if model == "threshold":
        events = evaluate.replay(made, evaluate.loso_models(rows, folds, features[0]), features[0], ends, grid)
    else:
        fitted = evaluate.loso_logreg(rows, folds, features, args.epochs, seed=args.seed)
        events = evaluate.replay_scored(evaluate.score_folds(made, fitted, features), ends, grid)
    records = sessions.read_labels(spark, args.sessions, args.include_glob)
    wanted = folds if grid is None else folds.crossJoin(F.broadcast(grid.select("config")))
    return evaluate.session_scores(
        wanted, events, islands.label_intervals(sessions.label_intervals_of(records)), islands.phase_windows(sessions.markers_of(records)), args.pre_tol_ms, args.post_tol_ms
    )


COLUMNS = (
    ("config", 16, "{}", "config"), ("detect", 8, "{:.0%}", "detection_rate"), ("miss", 6, "{}", "missed"), ("fp_rest/min", 12, "{:.2f}", "false_rest_per_min"), ("fp_artifact/min", 16, "{:.2f}", "false_artifact_per_min"),
    ("down_lat_ms", 12, "{:.0f}", "down_latency_median"), ("up_lat_ms", 10, "{:.0f}", "up_latency_median"), ("dur_err_ms", 11, "{:.0f}", "duration_error_median"),
)


def table(rows: list[dict], columns: Sequence[tuple] = COLUMNS) -> str:
    """Rows under headings, each column at its width (O-SNK-8)."""
    head = "".join(name.ljust(width) for name, width, _, _ in columns)
    return "\n".join([head, "-" * len(head)] + ["".join(form.format(r[key]).ljust(width) for _, width, form, key in columns) for r in rows])


SWEEP_COLUMNS = (
    ("enter", 7, "{:.2f}", "enter"), ("exit", 6, "{:.2f}", "exit"), ("dwell", 7, "{}", "enter_dwell"), ("min_ev", 8, "{}", "min_event_ms"), ("detect", 8, "{:.0%}", "detection_rate"), ("rest/min", 10, "{:.2f}", "false_rest_per_min"),
    ("art/min", 9, "{:.2f}", "false_artifact_per_min"), ("down_ms", 9, "{:.0f}", "down_latency_median"), ("cancel", 7, "{}", "cancelled"),
)


def evaluation(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    if args.sweep:
        grid = evaluate.decision_grid(spark)
        scores, hits = loso(spark, args, *parse_configs(args.sweep)[0], grid)
        ranked = evaluate.rank_sweep(evaluate.aggregate_scores(scores, hits, ("config",))).join(F.broadcast(grid), "config").orderBy("rank")
        rows = [r.asDict() for r in ranked.collect()]
        print(table(rows[: args.sweep_top], SWEEP_COLUMNS))
        names = {"enter": "enter_threshold", "exit": "exit_threshold", "enter_dwell": "enter_dwell_frames", "release_dwell": "release_dwell_frames"}
        print(json.dumps({names.get(c, c): rows[0][c] for c in decide.GATE_COLUMNS}, indent=2))
        return rows
    rows, each = [], []
    for model, spec in parse_configs(args.configs):
        try:
            scores, hits = loso(spark, args, model, spec)
        except (ValueError, Refused) as e:
            print(f"{model}:{spec} skipped: {e}", file=sys.stderr)
            continue
        rows.append({"config": f"{model}:{spec}", "model": model, "features": spec, **evaluate.aggregate_scores(scores, hits).first().asDict()})
        if args.per_session:
            wanted = ("session", "clicks", "detected", "missed", "false_rest", "false_artifact", "false_other")
            each += [{"model": model, "features": spec, **r.asDict()} for r in scores.select(*wanted).orderBy("session").collect()]
    if not rows:
        raise Refused("no results; at least 2 labelled sessions are needed")
    print(table(rows))
    for r in each:
        print(json.dumps(r, sort_keys=True))
    if args.report:
        Path(args.report).parent.mkdir(parents=True, exist_ok=True)
        Path(args.report).write_text(sessions.report(rows))
    return rows


def recorded(spark: SparkSession, args: argparse.Namespace) -> str:
    """A session's folder from a device (O-API-5/6) or a file of device lines: intervals by keys that toggle or hold them,
    or by the prompts of a protocol."""
    where = args.out or f"{args.sessions_root}/{sessions.default_name()}"
    port = serial.find_port(args.port)
    prompted, script = args.command == "prompt-record", []
    mode = "prompted" if prompted else "hold" if args.hold else "toggle"
    keys = {} if prompted else {"label_key": args.label_key, "quit_key": args.quit_key}
    about = sessions.meta(port, args.baud, mode, args.label, f"pulseloom-{args.command}", notes=args.notes, **keys)
    if prompted:
        script = protocol.build(args.settle, args.rest, args.trials, args.press, args.gap, args.final_rest, args.artifact)
        asked = {f"{c}_sec": getattr(args, c) for c in ("settle", "rest", "press", "gap", "final_rest", "artifact")}
        about = recorder.protocol_meta(about, script, **asked, trials=args.trials)
    if not os.path.isfile(port):
        record_live(spark, args, port, where, about, lambda: recorder.Recorder(mode, args.label, script, args.duration_sec))
        return where
    name = where.rstrip("/").split("/")[-1]
    lines = serial.file_lines(spark, port, name)
    if args.duration_sec is not None:
        first = lines.agg(F.min("host_time_s")).first()[0] or 0.0
        lines = lines.where(F.col("host_time_s") < first + args.duration_sec)
    lines = lines.persist()
    try:
        parsed = frames.parsed_lines(lines).join(lines.select("arrival_seq", "host_time_s", "line"), "arrival_seq")
        ends = decide.session_ends(parsed)
        if prompted:
            marks = record.prompt_labels(parsed, spark.createDataFrame(script, protocol.SCHEMA), ends)
        else:
            kind = "seq bigint, after_seq bigint, action string"
            pressed = spark.read.schema(kind).json(args.keys) if args.keys else spark.createDataFrame([], kind)
            marks = (record.hold_labels if args.hold else record.toggle_labels)(parsed, pressed.withColumn("session", F.lit(name)), ends, args.label)
        snap = dsp.snapshots(parsed)
        made = frames.frames(snap.drop("raw", "segment").withColumnRenamed("filtered", "raw"), "raw", slope="slope_burst", lf="lf_energy")
        counts = record.session_counts(lines, parsed, made, marks)
        first, last = (F.lit(x) for x in lines.agg(F.min("host_time_s"), F.max("host_time_s")).first())
        start = counts.select("session", F.lit(0).cast("bigint").alias("line"), F.lit("session_start").alias("type"), first.cast("double").alias("host_time_s"))
        end = counts.select("session", F.lit(1 << 62).alias("line"), F.lit("session_end").alias("type"), F.col("final_t_ms").alias("t_ms"), last.cast("double").alias("host_time_s"), "samples", "frames", "labels", "parse_errors")
        labels = marks.unionByName(start, allowMissingColumns=True).unionByName(end, allowMissingColumns=True)
        rows = record.feature_rows(record.hosted_frames(made, parsed, snap, frames.WINDOW_MS, frames.HOP_MS), F.col("host_time_s"))
        sessions.write_session(where, parsed.withColumn("host_time_s", F.format_string("%.6f", "host_time_s")), rows, labels, about)
    finally:
        lines.unpersist()
    return where


def record_live(spark: SparkSession, args: argparse.Namespace, port: str, where: str, about: str, make: Callable[[], recorder.Recorder]) -> dict:
    """Records a device until its protocol or time is over, the quit key, SIGINT or SIGTERM (O-REC-1..5). Controls come
    from a pipe: the terminal's keys, and whatever is named by ``--keys``."""
    name = where.rstrip("/").split("/")[-1]
    if sessions.exists(spark, where):
        raise Refused(f"{where} is there already")
    lock = serial.PortLock(args.lock_dir or tempfile.gettempdir(), port)
    lock.acquire()
    try:
        folder = live_folder(spark, args.checkpoint)
        lines, seen = device(spark, port, folder, name, args.baud)
        pipe = args.keys if getattr(args, "keys", None) else f"{beside(folder)}/keys"
        os.makedirs(os.path.dirname(pipe) or ".", exist_ok=True)
        if not os.path.exists(pipe):
            os.mkfifo(pipe)
        controls = spark.readStream.format("device_lines").options(path=pipe, session=name, journal=f"{beside(folder)}/key-journal").load()
        over, keep = threading.Event(), recorder.sink(f"{folder}/parts")

        def put(batch: DataFrame, number: int) -> None:
            keep(batch, number)
            if not spark.read.schema(batch.schema).parquet(f"{folder}/parts/batch={number}").where("type = 'session_end'").isEmpty():
                over.set()

        made = recorder.recorded(status.observed(lines), controls, make)
        with keyboard.Keys(pipe, getattr(args, "label_key", ""), getattr(args, "quit_key", ""), bool(getattr(args, "hold", False))) as pressed:
            run_live(spark, made.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(processingTime="0.5 seconds"), seen, args.status, over, lambda: pressed.say("quit"))
        return recorder.assemble(spark, f"{folder}/parts", where, about)
    finally:
        lock.release()


def monitor(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The monitor's rows of a file of device lines, or of a session that ``--record-dir`` records first (O-API-7, O-SNK-9):
    the last ``window_sec`` on the console, all of them as CSV where a log is wanted; with a profile the gate's state and
    its events beside each frame."""
    if args.prompt and not args.record_dir:
        raise Refused("--prompt needs --record-dir")
    port = serial.find_port(args.port)
    if args.record_dir:
        seconds = {c: getattr(args, f"prompt_{c}_sec") for c in ("settle", "rest", "press", "gap", "final_rest", "artifact")}
        given = vars(args) | seconds | {
            "command": "prompt-record" if args.prompt else "record", "trials": args.prompt_trials, "out": f"{args.record_dir}/{sessions.default_name()}", "sessions_root": None, "label": "CLICK",
            "duration_sec": None, "notes": "", "status": False, "checkpoint": None, "lock_dir": None, "keys": None, "hold": True, "label_key": "c", "quit_key": "q",
        }
        root, _, name = recorded(spark, argparse.Namespace(**given)).rpartition("/")
        parsed = sessions.read_raw(spark, root, name)
    elif os.path.isfile(port):
        parsed = frames.parsed_lines(serial.file_lines(spark, port, "live"))
    else:
        raise Refused(f"{port} is a device; record it with --record-dir")
    snap, more = dsp.snapshots(parsed), ()
    made = frames.frames(snap.drop("raw", "segment").withColumnRenamed("filtered", "raw"), "raw", slope="slope_burst", lf="lf_energy")
    if args.profile:
        profile = load_profile(args.profile)
        number = F.row_number().over(Window.partitionBy("session").orderBy("segment", "frame")).cast("bigint")
        made = made.withColumns({"ord_frame": number, "t_ms": F.col("end_ms")})
        over = decide.overlay(score.score_frames(made, profile).select("session", "ord_frame", "t_ms", "p"), profile.gate())
        made = made.join(over.select("session", "ord_frame", "active", F.col("p").alias("probability"), F.col("down").cast("int").alias("down"), F.col("up").cast("int").alias("up")), ["session", "ord_frame"])
        more = sessions.DEBUG_COLUMNS
    rows = record.monitor_rows(snap, made, frames.WINDOW_MS, frames.HOP_MS, more)
    if args.log_file:
        rows.orderBy("arrival_seq", "frame").write.option("header", True).csv(args.log_file)
    last = rows.agg(F.max("t_ms")).first()[0] or 0
    rows.where(F.col("t_ms") >= last - 1000 * args.window_sec).orderBy("arrival_seq", "frame").show(40, truncate=False)
    return rows


class Stopping:
    """Inside, SIGINT and SIGTERM ask for an end instead of making one (O-STR-1)."""

    def __init__(self) -> None:
        self.asked = threading.Event()
        self.before: dict = {}

    def __enter__(self) -> Stopping:
        if threading.current_thread() is threading.main_thread():
            self.before = {s: signal.signal(s, lambda *_: self.asked.set()) for s in (signal.SIGINT, signal.SIGTERM)}
        return self

    def __exit__(self, *_) -> None:
        for s, old in self.before.items():
            signal.signal(s, old)


def live_folder(spark: SparkSession, given: str | None) -> str:
    """Where a live query keeps its state: the folder that is named, else a new one in the shared folder."""
    return given or f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"


def beside(folder: str) -> str:
    """The same folder as a path of this machine, which the device is plugged into: its lines are journalled there."""
    path = folder.removeprefix("file://")
    if "://" in path:
        raise Refused(f"{folder} is no folder of this machine; name one with --checkpoint")
    return path


def device(spark: SparkSession, port: str, folder: str, session: str, baud: int) -> tuple[DataFrame, status.LiveStatus]:
    """The stream of a port's lines, journalled beside its query's state, and what watches it."""
    spark.dataSource.register(serial.LineSource)
    seen = status.LiveStatus(f"{beside(folder)}/connection.json")
    given = {"path": port, "session": session, "baud": baud, "journal": f"{beside(folder)}/journal", "status": seen.connection}
    return spark.readStream.format("device_lines").options(**given).load(), seen


def switch(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Lines of a device to JSON events on standard output, until SIGINT or SIGTERM (O-API-1, O-STR-1). How the stream is
    goes to standard error with ``--status`` (O-STR-8)."""
    port = serial.find_port(args.port)
    profile = load_profile(args.profile)
    lock = serial.PortLock(args.lock_dir or tempfile.gettempdir(), port)
    lock.acquire()
    try:
        folder = live_folder(spark, args.checkpoint)
        lines, seen = device(spark, port, folder, "live", args.baud)
        events = decide.switch_events(live_events(lines, profile))

        def show(batch: DataFrame, number: int) -> None:
            for r in decide.event_json(batch.withColumn("host_time_s", F.lit(time.time())), "host_time_s").orderBy("session", "ord").toLocalIterator():
                print(r["json"], flush=True)

        return run_live(spark, events.writeStream.foreachBatch(show).option("checkpointLocation", f"{folder}/state"), seen, args.status)
    finally:
        lock.release()


def run_live(spark: SparkSession, writer, seen: status.LiveStatus, told: bool, over: threading.Event | None = None, ask: Callable[[], None] | None = None) -> dict:
    """Starts a query and stops it once ``over`` is set or a signal asks for it; what it met. ``ask`` is called on a
    signal, and ``over`` then waited for. Without either, what the source has is processed first; whoever gives ``over``
    knows the end, and a source that goes on, as a clock does, is never through."""
    spark.streams.addListener(seen)
    through, over = over is None and ask is None, over or threading.Event()
    cut = False
    try:
        with Stopping() as stopping:
            query = writer.start()
            try:
                while query.isActive and not stopping.asked.is_set() and not over.is_set():
                    over.wait(0.5)
                    if told:
                        print(json.dumps(seen.now()), file=sys.stderr, flush=True)
                if ask and query.isActive and not over.is_set():
                    ask()
                    over.wait(30)
                if query.isActive and through:
                    query.processAllAvailable()
                # The batch that the stop cuts short has nothing that is still asked for.
                cut = query.isActive and not through and not ask
            finally:
                query.stop()
            if query.exception() and not cut:
                raise query.exception()
            # The last progress is told before the end is.
            seen.ended.wait(10)
    finally:
        spark.streams.removeListener(seen)
    return seen.now()


def live_events(lines: DataFrame, profile: profiles.Profile) -> DataFrame:
    """Edge events of a stream of lines under any profile; lines and those that don't parse are observed."""
    config = profile.feature_config
    return detector.detect(frames.parsed_lines(status.observed(lines)), score.FrameModel(profile), profile.gate(), int(config.get("window_ms", 120)), int(config.get("hop_ms", 30)))


def load_profile(path: str) -> profiles.Profile:
    try:
        return profiles.load(path)
    except FileNotFoundError:
        raise Refused(f"no trained profile at {path}; train one first") from None


def replayed(samples: DataFrame, profile: profiles.Profile) -> DataFrame:
    """Switch events, and the running count of clicks, of recorded samples (O-API-8, O-DEC-10); open presses end with the
    recording."""
    config = profile.feature_config
    scored = score.score_frames(feature_frames(samples, int(config.get("window_ms", 120)), int(config.get("hop_ms", 30))), profile)
    return decide.click_counts(decide.switch_events(decide.edge_events(scored.select("session", "ord_frame", "t_ms", "p"), profile.gate(), decide.session_ends(samples))))


def replay(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    """A recording's events and clicks: at its own pace times ``--replay-speed`` through the live detector, or at once
    where that is 0. They are printed as they come."""
    root, _, name = args.replay.rstrip("/").rpartition("/")
    samples, profile, found = sessions.read_raw(spark, root or ".", name), load_profile(args.profile), []

    def show(events: DataFrame) -> None:
        for r in events.orderBy("session", "ord").toLocalIterator():
            found.append(r.asDict())
            print(json.dumps({k: v for k, v in found[-1].items() if v is not None}), flush=True)

    if args.replay_speed <= 0:
        show(replayed(samples, profile))
        return found
    config = profile.feature_config
    rows, last = detector.paced(samples, args.replay_speed)
    events = detector.detect(rows, score.FrameModel(profile), profile.gate(), int(config.get("window_ms", 120)), int(config.get("hop_ms", 30)), counts=True)
    over = threading.Event()
    writer = decide.switch_events(events).writeStream.foreachBatch(lambda batch, _: show(batch)).option("checkpointLocation", f"{live_folder(spark, None)}/state").outputMode("append")

    class End(status.StreamingQueryListener):
        """Ends the replay once the clock is past its last row."""

        def onQueryStarted(self, event) -> None:
            pass

        def onQueryProgress(self, event) -> None:
            at = event.progress.sources[0].endOffset
            if at is not None and int(at) * detector.ticks_a_second(args.replay_speed) > last:
                over.set()

        def onQueryIdle(self, event) -> None:
            pass

        def onQueryTerminated(self, event) -> None:
            over.set()

    end = End()
    spark.streams.addListener(end)
    try:
        run_live(spark, writer, status.LiveStatus(), False, over)
    finally:
        spark.streams.removeListener(end)
    return found


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pulseloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        c = sub.add_parser(name)
        for flag, default, *more in options:
            if default is False:
                c.add_argument(flag, action="store_true")
            else:
                kind = {"type": type(default)} if default is not None and not isinstance(default, str) else {}
                c.add_argument(flag, default=default, **kind, **(more[0] if more else {}))

    shared = (("--seed", 7), ("--ignore-margin-ms", 80))
    port = (("--port", None), ("--baud", serial.BAUD))
    command(
        "train", ("--sessions", "sessions"), ("--model", "logreg", {"choices": (*MODELS, "all")}), ("--features", "wl"), ("--out", PROFILE), ("--metrics-out", None), ("--epochs", 100),
        ("--learning-rate", 0.05), ("--hidden", 16), ("--seq-len", 16), ("--val-fraction", 0.25), ("--allow-skip-optional", False), *shared,
    )
    command(
        "study", ("--sessions", "sessions"), ("--models", ",".join(MODELS)), ("--features", "wl,core,all"), ("--fractions", "0.25,0.5,1.0"), ("--epochs", "20,100"), ("--hidden", "8,16"),
        ("--seq-len", 16), ("--out", "studies/binary_scaling.csv"), *shared,
    )
    command(
        "eval", ("--sessions", "sessions"), ("--configs", "threshold:wl,logreg:wl,logreg:all"), ("--epochs", 200), ("--pre-tol-ms", 400), ("--post-tol-ms", 600), ("--include-glob", "*"), ("--exclude", ""),
        ("--sweep", None), ("--sweep-top", 8), ("--report", None), ("--per-session", False), *shared,
    )
    keep = (*port, ("--out", None), ("--sessions-root", "sessions"), ("--label", "CLICK"), ("--duration-sec", None, {"type": float}), ("--notes", ""), ("--status", False), ("--checkpoint", None), ("--lock-dir", None))
    command("record", *keep, ("--keys", None), ("--hold", False), ("--label-key", "c"), ("--quit-key", "q"))
    command("prompt-record", *keep, ("--settle", 5.0), ("--rest", 20.0), ("--trials", 20), ("--press", 1.0), ("--gap", 3.0), ("--final-rest", 10.0), ("--artifact", 0.0))
    command(
        "monitor", *port, ("--window-sec", 10.0), ("--profile", None), ("--log-file", None), ("--record-dir", None), ("--prompt", False), ("--prompt-settle-sec", 5.0), ("--prompt-rest-sec", 20.0),
        ("--prompt-trials", 20), ("--prompt-press-sec", 1.0), ("--prompt-gap-sec", 3.0), ("--prompt-final-rest-sec", 10.0), ("--prompt-artifact-sec", 0.0),
    )
    command("switch", *port, ("--profile", PROFILE), ("--checkpoint", None), ("--lock-dir", None), ("--status", False))
    command("replay", ("--replay", None, {"required": True}), ("--profile", PROFILE), ("--replay-speed", 1.0))
    return p


COMMANDS = {"train": train, "study": study, "eval": evaluation, "record": recorded, "prompt-record": recorded, "monitor": monitor, "switch": switch, "replay": replay}


def main(argv: list[str] | None = None):
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"pulseloom {args.command}").config(detector.STORE, detector.ROCKS).getOrCreate()
    try:
        return COMMANDS[args.command](spark, args)
    except (Refused, serial.PortInUse) as e:
        print(f"pulseloom {args.command}: {e}", file=sys.stderr)
        raise SystemExit(2) from e


if __name__ == "__main__":
    main()
