"""Logistic models of all leave-one-out folds, trained side by side on examples that are stored once (O-EVL-3).

A pass goes over the examples in Arrow batches and looks at every fold there: a matrix of features times the folds'
weights, in which a fold's own session counts for nothing. What tasks find are sums for each fold, added up for
``GROUP`` folds at a time in a second step; the driver has the folds' models and nothing of the examples. An epoch of
gradient descent is a pass. So is a step of the search for order statistics, which asks for each fold how many values of
the other sessions lie below some bounds, and narrows them down to a value's last bit.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Folds whose sums are a row, bounds that a pass tries for all values together (each gets 16 to 1024), and cells of a
#: matrix that is held at once.
GROUP, BOUNDS, CELLS = 1000, 1 << 18, 1 << 21


class Examples:
    """The stored examples: ``fold`` (the number of their session's fold, -1 for none), ``label`` and features."""

    def __init__(self, examples: DataFrame, names: list, features: Sequence[str]) -> None:
        spark, kind = examples.sparkSession, dict(examples.dtypes)["session"]
        numbers = spark.createDataFrame(list(zip(names, range(len(names)))), f"session {kind}, fold bigint")
        given = examples.where("session IS NOT NULL").select("session", F.col("label").cast("int").alias("label"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
        self.table = written(given.dropna().join(numbers, "session", "left").select(F.coalesce("fold", F.lit(-1)).cast("bigint").alias("fold"), "label", *[f"x{i}" for i in range(len(features))]), "fold-examples")
        self.features, self.folds = len(features), len(names)

    def summed(self, look: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
        """The sum over all examples of ``look(fold, label, x)``, which gives ``folds x width`` numbers for a batch."""
        folds = self.folds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                fold, label, *x = (c.to_numpy() for c in b.columns)
                found = look(fold, label, np.stack(x, 1))
                total = found if total is None else total + found
            if total is not None:
                parts = range(0, folds, GROUP)
                yield pa.RecordBatch.from_arrays([pa.array([i // GROUP for i in parts], pa.int64()), pa.array([total[i : i + GROUP].astype(np.float64).tobytes() for i in parts], pa.binary())], ["part", "sums"])

        def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [key[0]], "sums": [sum(np.frombuffer(x, np.float64) for x in rows["sums"]).tobytes()]})

        out = np.zeros((folds, width))
        for r in self.table.mapInArrow(run, "part bigint, sums binary").groupBy("part").applyInPandas(add, "part bigint, sums binary").toLocalIterator():
            part = np.frombuffer(r["sums"], np.float64).reshape(-1, width)
            out[r["part"] * GROUP : r["part"] * GROUP + len(part)] = part
        return out


def _owned(fold: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The folds of a batch's sessions, and the rows of each."""
    order = np.argsort(fold, kind="stable")
    numbers, first = np.unique(fold[order], return_index=True)
    for number, rows in zip(numbers.tolist(), np.split(order, first[1:])):
        if number >= 0:
            yield number, rows


def _keys(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of floats, neighbours for neighbours."""
    bits = values.astype(np.float64).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _values(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >> np.uint64(63) == 1, keys & np.uint64((1 << 63) - 1), ~keys).view(np.float64)


def narrowed(count: Callable[[np.ndarray], np.ndarray], target: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least values, from ``low`` to ``high``, below or at which there are ``target`` examples or more. ``count(v)``
    has a bound more in its last axis than these."""
    low, high = _keys(low), _keys(high)
    ways = min(1024, max(16, BOUNDS // max(low.size, 1)))
    while (low < high).any():
        step = (high - low) // np.uint64(ways)
        # The last bound is one that is known to be high enough; where few are left they are all tried.
        tried = np.minimum(low[..., None] + np.maximum(step, np.uint64(1))[..., None] * np.arange(ways, dtype=np.uint64), high[..., None])
        enough = count(_values(tried)) >= target[..., None]
        enough[..., -1] |= tried[..., -1] == high
        some = enough.any(-1)
        first = enough.argmax(-1)
        at = lambda i: np.take_along_axis(tried, i[..., None], -1)[..., 0]
        above = np.where(some & (first == 0), low, at(np.where(some, np.maximum(first, 1) - 1, ways - 1)) + np.uint64(1))
        high = np.where(some, at(first), high)
        low = np.minimum(above, high)
    return _values(low)


def fold_statistics(examples: Examples) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fold: examples of label 0 and 1, and centers and scales of the features over the other sessions, as
    ``training.robust_statistics`` has them."""
    folds, width = examples.folds, examples.features

    def sizes(fold: np.ndarray, label: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.tile([(label != 1).sum(), (label == 1).sum()], (folds, 1)).astype(np.float64)
        for number, rows in _owned(fold):
            out[number] -= [(label[rows] != 1).sum(), (label[rows] == 1).sum()]
        return out

    n = examples.summed(sizes, 2)
    ends = examples.table.agg(*[f(f"x{i}") for i in range(width) for f in (F.min, F.max)]).first()
    least, most = (np.tile(np.array(ends[k::2], np.float64), (folds, 1)) for k in (0, 1))
    total = n.sum(1).astype(np.int64)
    ranks = np.stack([(total - 1) // 2, total // 2, ((total - 1) * 0.9).astype(np.int64), ((total - 1) * 0.1).astype(np.int64)], 1) + 1

    def counter(below: Callable[..., np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        """Counts for bounds of folds, features and so on: those of a whole batch less those of the fold's session."""

        def count(bounds: np.ndarray) -> np.ndarray:
            def look(fold: np.ndarray, label: np.ndarray, x: np.ndarray) -> np.ndarray:
                out = np.stack([below(np.sort(x[:, i]), bounds[:, i], i) for i in range(width)], 1).astype(np.float64)
                for number, rows in _owned(fold):
                    out[number] -= np.stack([below(np.sort(x[rows, i]), bounds[number : number + 1, i], i, number)[0] for i in range(width)])
                return out.reshape(folds, -1)

            size = int(np.prod(bounds.shape[1:]))
            return examples.summed(look, size).reshape(bounds.shape)

        return count

    def upto(values: np.ndarray, bounds: np.ndarray, i: int, number: int | None = None) -> np.ndarray:
        return np.searchsorted(values, bounds, side="right")

    spread = lambda a, k: np.repeat(a[:, :, None], k, 2)
    found = narrowed(counter(upto), np.repeat(ranks[:, None, :], width, 1), spread(least, 4), spread(most, 4))
    center = (found[..., 0] + found[..., 1]) / 2.0

    def near(values: np.ndarray, bounds: np.ndarray, i: int, number: int | None = None) -> np.ndarray:
        c = (center[:, i] if number is None else center[number : number + 1, i])[:, None, None]
        return np.searchsorted(values, c + bounds, side="right") - np.searchsorted(values, c - bounds, side="left")

    reach = np.maximum(most - center, center - least)
    off = narrowed(counter(near), np.repeat(ranks[:, None, :2], width, 1), np.zeros((folds, width, 2)), spread(np.nextafter(reach, np.inf), 2))
    mad = (off[..., 0] + off[..., 1]) / 2.0
    return n, center, np.maximum(np.maximum(1.4826 * mad, (found[..., 2] - found[..., 3]) / 2.563), 1e-6)


def logistic_folds(examples: DataFrame, sessions: DataFrame, features: Sequence[str], epochs: int = 200, rate: float = 0.05, l2: float = 1e-4, seed: int = 7) -> dict:
    """``session -> {weights, bias, center, scale}``: the logistic model trained on all other sessions' ``examples``, by
    ``training.fit_logreg``'s descent. Sessions without examples get the model of all; a fold without examples has none.
    Examples with a null among session, label and features are left out."""
    names = [r["session"] for r in sessions.where("session IS NOT NULL").select("session").distinct().orderBy("session").toLocalIterator()]
    held = Examples(examples, names, features)
    if not names or held.table.isEmpty():
        return {}
    n, center, scale = fold_statistics(held)
    total = np.maximum(n.sum(1), 1)
    weight = np.stack([total / (2.0 * np.maximum(n[:, k], 1)) for k in (0, 1)])
    rng = random.Random(seed)
    w = np.tile([rng.uniform(-0.01, 0.01) for _ in features], (len(names), 1))
    b = np.zeros(len(names))
    # Sums are taken of features about common centers, which the folds' are near.
    shift, unit = np.median(center, 0), np.median(scale, 0)
    for _ in range(max(epochs, 1)):
        slope, start = w * unit / scale, b + ((shift - center) / scale * w).sum(1)

        def look(fold: np.ndarray, label: np.ndarray, x: np.ndarray, slope=slope, start=start) -> np.ndarray:
            out = np.zeros((len(start), x.shape[1] + 1))
            x, size = (x - shift) / unit, max(1, CELLS // len(start))
            for lo in range(0, len(x), size):
                part, y, own = x[lo : lo + size], label[lo : lo + size], fold[lo : lo + size]
                z = part @ slope.T + start
                e = np.exp(-np.abs(z))
                diff = (np.where(z >= 0, 1.0, e) / (1.0 + e) - y[:, None]) * np.where(y[:, None] == 1, weight[1], weight[0])
                rows = np.flatnonzero(own >= 0)
                diff[rows, own[rows]] = 0.0
                out[:, :-1] += diff.T @ part
                out[:, -1] += diff.sum(0)
            return out

        sums = held.summed(look, len(features) + 1)
        g = (sums[:, :-1] * unit + sums[:, -1:] * (shift - center)) / scale
        w, b = w - rate * (g / total[:, None] + l2 * w), b - rate * sums[:, -1] / total
    kept = [i for i in range(len(names)) if n[i].sum() > 0]
    return {names[i]: {"weights": w[i].tolist(), "bias": float(b[i]), "center": center[i].tolist(), "scale": scale[i].tolist()} for i in kept}
