"""Labelled frames, robust normalisation, threshold and logistic models, and their metrics (O-ML-*, O-AGG-*)."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import logreg_score

#: The features of a frame in the order of models, and the presets of them (O-PRJ-5).
FEATURES = ("waveform_length", "rms_state", "slope_burst", "lf_energy_ratio")
PRESETS = {"wl": ("waveform_length",), "core": ("waveform_length", "rms_state"), "all": FEATURES}


def features_of(preset: str) -> tuple[str, ...]:
    """A preset, or a comma list of known features, in any case."""
    preset = preset.strip().lower()
    if preset in PRESETS:
        return PRESETS[preset]
    names = tuple(x.strip() for x in preset.split(",") if x.strip())
    if not names:
        raise ValueError("no features")
    if unknown := [n for n in names if n not in FEATURES]:
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    return names


def label_frames(frames: DataFrame, intervals: DataFrame, margin_ms: int = 80) -> DataFrame:
    """``frames(session, t_ms, ..)`` with ``label``: 1 inside any interval, dropped within the margin of one, else 0
    (O-JOIN-1). Repeated frames stay, a frame without a time is in no interval.

    Frames and the starts of intervals stream in one order of time: a frame is inside where the latest end of those that
    began so far is not before it. One shuffle by session, and no row is made for a pair of frame and interval."""
    none = F.lit(None).cast("bigint")
    rows = frames.select("session", F.col("t_ms").alias("__at"), F.lit(1).alias("__kind"), F.struct(*frames.columns).alias("__row"), none.alias("__in"), none.alias("__near"))
    ends = lambda at, name: intervals.select(
        "session", at.alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"),
        *[F.col("end_ms").alias(c) if c == name else F.lit(None).cast("bigint").alias(c) for c in ("__in", "__near")],
    )
    every = rows.unionByName(ends(F.col("start_ms"), "__in")).unionByName(ends(F.col("start_ms") - margin_ms, "__near"))
    sofar = Window.partitionBy("session").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    met = every.withColumns({"__in": F.max("__in").over(sofar), "__near": F.max("__near").over(sofar) + margin_ms}).where("__kind = 1")
    label = F.when(F.col("__in") >= F.col("__at"), 1).when(F.col("__near") >= F.col("__at"), None).otherwise(0)
    return met.withColumn("label", label).where("label IS NOT NULL").select("__row.*", "label")


def robust_statistics(values: DataFrame, keys: Sequence[str] = ("feature",), floor: float = 1e-6) -> DataFrame:
    """``center, scale, mad`` of ``value`` for each key (O-AGG-4..8): median and ``max(1.4826 MAD, (p90 - p10) /
    2.563, floor)``.

    Ranks come from a window over counts of distinct values, so that equal values, however many, are one row.
    """
    keys = list(keys)
    counted = values.groupBy(*keys, "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy("value")
    upto = counted.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(*keys))})
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))
    rank = lambda share: F.floor((F.col("n") - 1) * F.lit(share))
    found = upto.groupBy(*keys).agg(
        at(F.floor((F.col("n") - 1) / 2)).alias("lo"), at(F.floor(F.col("n") / 2)).alias("hi"), at(rank(0.9)).alias("p90"), at(rank(0.1)).alias("p10")
    ).withColumn("center", (F.col("lo") + F.col("hi")) / 2.0)
    off = upto.join(found.select(*keys, "center"), keys).withColumn("d", F.abs(F.col("value") - F.col("center"))).groupBy(*keys, "d", "n").agg(F.sum("c").alias("c"))
    off = off.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("d")))
    pick = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("d")))
    mad = off.groupBy(*keys).agg(((pick(F.floor((F.col("n") - 1) / 2)) + pick(F.floor(F.col("n") / 2))) / 2.0).alias("mad"))
    scale = F.greatest(F.col("mad") * 1.4826, (F.col("p90") - F.col("p10")) / 2.563, F.lit(floor))
    return found.join(mad, keys).select(*keys, "center", scale.alias("scale"), "mad", "p10", "p90")


def fit_normalisation(examples: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, center, scale)`` over all examples (O-AGG-8)."""
    pairs = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in features)
    long = examples.selectExpr(f"stack({len(features)}, {pairs}) AS (feature, value)")
    return robust_statistics(long).select("feature", "center", "scale")


def confusion(scored: DataFrame, keys: Sequence[str] = (), cut: float = 0.5) -> DataFrame:
    """Counts and rates of ``p`` against ``label`` (O-AGG-1/2)."""
    said, true = F.col("p") >= cut, F.col("label") == 1
    counts = scored.groupBy(*keys).agg(
        F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & ~true).alias("tn"), F.count_if(~said & true).alias("fn")
    )
    one = F.lit(1)
    precision, recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)
    total = F.greatest(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"), one)
    return counts.withColumns({"precision": precision, "recall": recall, "accuracy": (F.col("tp") + F.col("tn")) / total}).withColumn(
        "f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))
    )


def threshold_search(examples: DataFrame, feature: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``threshold, f1, softness`` for each key (O-ML-3/4): of the midpoints between neighbouring distinct values (a
    lone value stands for itself) the one of best F1, the lowest on ties.

    An example counts ``weight`` times. One aggregation to distinct values, then running sums: n log n for all candidates, where trying each is n * d.
    """
    keys = list(keys)
    times = F.col(weight) if weight else F.lit(1).cast("bigint")
    counted = examples.groupBy(*keys, F.col(feature).cast("double").alias("v")).agg(F.sum(times).alias("n"), F.sum(F.col("label").cast("bigint") * times).alias("pos"))
    w = Window.partitionBy(*keys).orderBy("v")
    every = Window.partitionBy(*keys)
    above = w.rowsBetween(1, Window.unboundedFollowing)
    ranked = counted.withColumns(
        {
            "next": F.lead("v").over(w), "tp": F.coalesce(F.sum("pos").over(above), F.lit(0)), "said": F.coalesce(F.sum("n").over(above), F.lit(0)),
            "all_pos": F.sum("pos").over(every), "n_all": F.sum("n").over(every), "values": F.count("*").over(every),
        }
    )
    lone = F.col("values") == 1
    tried = ranked.where(F.col("next").isNotNull() | lone).withColumns(
        {"threshold": F.when(lone, F.col("v")).otherwise((F.col("v") + F.col("next")) / 2.0), "tp": F.when(lone, F.col("all_pos")).otherwise(F.col("tp")), "said": F.when(lone, F.col("n_all")).otherwise(F.col("said"))}
    )
    p, r = F.col("tp") / F.greatest(F.col("said"), F.lit(1)), F.col("tp") / F.greatest(F.col("all_pos"), F.lit(1))
    f1 = 2 * p * r / F.greatest(p + r, F.lit(1e-12))
    best = tried.withColumn("f1", f1).groupBy(*keys).agg(F.min(F.struct(-F.col("f1"), F.col("threshold"))).alias("b"))
    best = best.select(*keys, F.col("b.threshold").alias("threshold"), (-F.col("b.col1")).alias("f1"))
    middle = lambda label: F.percentile(F.when(F.col("label") == label, F.col(feature).cast("double")), 0.5, times)
    medians = examples.groupBy(*keys).agg(middle(1).alias("m1"), middle(0).alias("m0"))
    joined = best.join(medians, keys) if keys else best.crossJoin(F.broadcast(medians))
    soft = F.greatest(F.abs(F.coalesce("m1", "threshold") - F.coalesce("m0", "threshold")) / 4.0, F.lit(1.0))
    return joined.select(*keys, "threshold", "f1", soft.alias("softness"))


def class_weights(examples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """O-AGG-13."""
    n, pos = F.count("*"), F.sum("label")
    return examples.groupBy(*keys).agg(
        n.alias("n"), (n / (2.0 * F.greatest(pos, F.lit(1)))).alias("pos_weight"), (n / (2.0 * F.greatest(n - pos, F.lit(1)))).alias("neg_weight")
    )


def fit_logreg(examples: DataFrame, features: Sequence[str], epochs: int = 200, rate: float = 0.05, l2: float = 1e-4, seed: int = 7) -> dict:
    """Full-batch gradient descent with class weights (O-ML-6): one aggregation over all examples for each epoch; only
    sums come to the driver."""
    stats = {r["feature"]: (r["center"], r["scale"]) for r in fit_normalisation(examples, features).collect()}
    weight = class_weights(examples).first()
    scaled = examples.select(*[((F.col(f).cast("double") - stats[f][0]) / max(stats[f][1], 1e-6)).alias(f) for f in features], "label").persist()
    rng = random.Random(seed)
    w, b, n = [rng.uniform(-0.01, 0.01) for _ in features], 0.0, max(weight["n"], 1)
    try:
        for _ in range(max(epochs, 1)):
            p = logreg_score([F.col(f) for f in features], w, b)
            diff = (p - F.col("label")) * F.when(F.col("label") == 1, weight["pos_weight"]).otherwise(weight["neg_weight"])
            g = scaled.agg(*[F.sum(diff * F.col(f)).alias(f) for f in features], F.sum(diff).alias("bias")).first()
            w = [x - rate * (g[f] / n + l2 * x) for x, f in zip(w, features)]
            b -= rate * g["bias"] / n
    finally:
        scaled.unpersist()
    return {"features": list(features), "weights": w, "bias": b, "center": {f: s[0] for f, s in stats.items()}, "scale": {f: s[1] for f, s in stats.items()}}


def split_sessions(names: Sequence[str], share: float = 0.25, seed: int = 7) -> tuple[list, list]:
    """Training and validation sessions (O-ML-2): names are sorted, shuffled by the seed, and ``max(1, round(n *
    share))``, halves to even, validate. Only names are in the driver."""
    order = sorted(set(names))
    random.Random(seed).shuffle(order)
    n = max(1, round(len(order) * share)) if len(order) >= 2 else 0
    return sorted(order[n:]), sorted(order[:n])


def split_examples(examples: DataFrame, share: float = 0.25, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Training and validation examples of a lone session: a shuffle by a hash of the seed and the example's place, of
    which the first ``max(1, round(n * share))`` validate; none of a single example."""
    placed = examples.withColumn("__n", F.row_number().over(Window.partitionBy("session").orderBy("t_ms")))
    n = placed.count()
    most = max(1, round(n * share)) if n > 1 else 0
    ranked = placed.withColumn("__r", F.row_number().over(Window.partitionBy("session").orderBy(F.xxhash64(F.lit(seed), "__n"), "__n")))
    return ranked.where(F.col("__r") > most).select(*examples.columns), ranked.where(F.col("__r") <= most).select(*examples.columns)


def prefix(examples: DataFrame, share: float, order: Sequence[str]) -> DataFrame:
    """The first ``max(1, int(n * share))`` of all examples, by ``session`` and then ``order`` (O-ML-13); all of them
    from a share of one on. Ranks are counts of the sessions before and a place within the session, so no task orders
    all examples."""
    if share >= 1.0:
        return examples
    counted = examples.groupBy("session").agg(F.count("*").alias("__c"))
    before = counted.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("session").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    most = counted.agg(F.greatest(F.floor(F.sum("__c") * F.lit(max(share, 0.0))), F.lit(1)).alias("__most"))
    placed = examples.withColumn("__n", F.row_number().over(Window.partitionBy("session").orderBy(*order))).join(before, "session").crossJoin(F.broadcast(most))
    return placed.where("__before + __n <= __most").select(*examples.columns)


def study_threshold(train: DataFrame, held: DataFrame, feature: str, fractions: Sequence[float], order: Sequence[str]) -> DataFrame:
    """A row for each of ``fractions``: the threshold model of that prefix of ``train`` and how it does on ``held``
    (O-JOIN-8)."""
    rows = []
    for x in fractions:
        part = prefix(train, x, order)
        model = threshold_search(part, feature)
        scored = held.crossJoin(F.broadcast(model)).select((F.col(feature) >= F.col("threshold")).cast("int").alias("p"), "label")
        counts = confusion(scored)
        n = part.agg(F.count("*").alias("train_examples"))
        rows.append(counts.crossJoin(F.broadcast(model.drop("f1"))).crossJoin(F.broadcast(n)).select(F.lit(float(x)).alias("fraction"), *counts.columns, "threshold", "softness", "train_examples"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
