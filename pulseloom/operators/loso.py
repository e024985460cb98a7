"""Threshold models of all leave-one-out folds from one running count over all sessions (O-EVL-2/3, O-JOIN-6).

The examples of a fold are those of all sessions less its own. Above any value a fold thus has the counts of all less its
own session's, and these change at its own values only: between two of them they are constants. There the fold's F1,
``2 (tp - a) / (said - b + positives)``, grows along a line of the plane of all sessions' (said, tp), so only a point of
the upper hull can be best, for whatever constants. Distinct values are ranked over the cluster and cut into leaves of
ranks; nodes of ``FAN`` leaves, of ``FAN`` such nodes and so on keep their hulls. A stretch between a session's own
values is a few nodes and two parts of leaves, which are looked at with its constants. The work is that of the (session,
value) rows, times the logarithm of the distinct values; sessions and values are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Ranks of a leaf, and nodes in a node of the next level.
LEAF, FAN = 1024, 32
#: Pieces of stretches that are looked at together.
CHUNK = 50_000
#: Positions that a task of ``_ranked_values`` orders.
BLOCK = 1 << 16


def hull(said: np.ndarray, tp: np.ndarray) -> np.ndarray:
    """Places, by rising ``said``, of the points that are best for some fold: the upper hull, without its edges' inner
    points but for edges along which F1 can tie (those of a slope over 0 and under 1/2)."""
    order = np.argsort(said, kind="stable")
    x, y = said[order].tolist(), tp[order].tolist()
    kept: list[int] = []
    for i in range(len(x)):
        while len(kept) >= 2:
            a, b = kept[-2], kept[-1]
            turn = (y[b] - y[a]) * (x[i] - x[a]) - (y[i] - y[a]) * (x[b] - x[a])
            tie = turn == 0 and 0 < 2 * (y[i] - y[a]) < x[i] - x[a]
            if turn > 0 or tie:
                break
            kept.pop()
        kept.append(i)
    return order[np.array(kept, np.int64)]


def _node(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.frombuffer(x, np.int64) for x in rows[c]]) for c in ("ranks", "said", "tp"))


_NODE = "level int, at bigint, ranks binary, said binary, tp binary"


def _packed(level: int, at: int, ranks: np.ndarray, said: np.ndarray, tp: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"level": [level], "at": [at], **{c: [x.astype(np.int64).tobytes()] for c, x in (("ranks", ranks), ("said", said), ("tp", tp))}})


def _leaf(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("rank")
    return _packed(0, key[0], rows["rank"].to_numpy(), rows["said"].to_numpy(), rows["tp"].to_numpy())


def _parent(level: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ranks, said, tp = _node(rows)
        kept = hull(said, tp)
        return _packed(level, key[0], ranks[kept], said[kept], tp[kept])

    return run


def _nodes(values: DataFrame, n: int, leaf: int, fan: int) -> DataFrame:
    """Leaves with all their points, and for each level above the hulls of its nodes."""
    level = written(values.select((F.col("rank") / leaf).cast("bigint").alias("at"), "rank", "said", "tp").groupBy("at").applyInPandas(_leaf, _NODE), "loso-leaves")
    out, k, width = level, 1, leaf
    while width < n:
        level = written(level.withColumn("up", (F.col("at") / fan).cast("bigint")).groupBy("up").applyInPandas(_parent(k), _NODE), "loso-nodes")
        out, k, width = out.union(level), k + 1, width * fan
    return out


def cover(low: int, high: int, leaf: int, fan: int, levels: int) -> Iterator[tuple[int, int]]:
    """Nodes ``(level, at)`` that hold the ranks from ``low`` to ``high``; only leaves may reach beyond them."""
    while low <= high:
        level, width = 0, leaf
        while level < levels and low % (width * fan) == 0 and low + width * fan - 1 <= high:
            level, width = level + 1, width * fan
        at = low // width
        yield level, at
        low = (at + 1) * width


def _pieces(leaf: int, fan: int, levels: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            which, level, at = [], [], []
            for i, (low, high) in enumerate(zip(b["low"].tolist(), b["high"].tolist())):
                for k, x in cover(low, high, leaf, fan, levels):
                    which.append(i)
                    level.append(k)
                    at.append(x)
            out = b.iloc[which].reset_index(drop=True)
            yield out.assign(level=np.array(level, np.int32), at=np.array(at, np.int64))

    return run


def _f1(tp: np.ndarray, said: np.ndarray, positives) -> np.ndarray:
    p, r = tp / np.maximum(said, 1), tp / np.maximum(positives, 1)
    return 2 * p * r / np.maximum(p + r, 1e-12)


def _looked_at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best point of a node, and of equals that of the lowest rank, for each piece of a chunk."""
    for b in batches:
        found = []
        for row in b.itertuples(index=False):
            ranks, said, tp = (np.frombuffer(x, np.int64) for x in (row.ranks, row.said, row.tp))
            order = np.argsort(ranks)
            ranks, said, tp = ranks[order], said[order], tp[order]
            for p in row.pieces:
                lo, hi = np.searchsorted(ranks, (p["low"], p["high"] + 1))
                if hi > lo:
                    score = _f1(tp[lo:hi] - p["own_tp"], said[lo:hi] - p["own_said"], p["positives"])
                    i = int(score.argmax())
                    found.append((p["session"], float(score[i]), int(ranks[lo + i])))
        yield pd.DataFrame(found, columns=["session", "f1", "rank"])


def ranked(own: DataFrame) -> DataFrame:
    """``(rank, v, n, pos, said, tp, owner)`` of the distinct values of ``own(session, v, n, pos)``: rank from 0, counts,
    counts above, and the session that alone has the value.

    Values are dealt by range; a task numbers and sums its own, and what lies in other ranges is added from a row each.
    """
    lone = F.when(F.count("*") == 1, F.min("session"))
    values = own.groupBy("v").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), lone.alias("owner"))
    dealt = written(values.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "loso-values")
    sums = dealt.groupBy("part").agg(F.count("*").alias("d"), F.sum("n").alias("sn"), F.sum("pos").alias("sp"))
    # A row for each range.
    before, after = (Window.orderBy("part").rowsBetween(*x) for x in ((Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select("part", zero(F.sum("d").over(before)).alias("d"), zero(F.sum("sn").over(after)).alias("sn"), zero(F.sum("sp").over(after)).alias("sp"))
    within = Window.partitionBy("part").orderBy("v")
    above = within.rowsBetween(1, Window.unboundedFollowing)
    placed = dealt.withColumns({"r": F.row_number().over(within), "an": zero(F.sum("n").over(above)), "ap": zero(F.sum("pos").over(above))})
    return placed.join(F.broadcast(sums), "part").select(
        (F.col("d") + F.col("r") - 1).cast("bigint").alias("rank"), "v", "n", "pos", (F.col("an") + F.col("sn")).alias("said"), (F.col("ap") + F.col("sp")).alias("tp"), "owner"
    )


def _ranked_values(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(label, place, ..)`` with ``v``, the value at that place, from 1, of all examples of the label in order.

    Places and the first places of values are put in order together, block by block of places; a value that goes on in
    the next block begins there anew.
    """
    labels = [F.struct(F.lit(1).alias("label"), F.col("pos").alias("n"), F.col("tp").alias("above")), F.struct(F.lit(0).alias("label"), (F.col("n") - F.col("pos")).alias("n"), (F.col("said") - F.col("tp")).alias("above"))]
    by = values.select("v", F.explode(F.array(*labels)).alias("x")).select("v", "x.*").where("n > 0")
    total = by.groupBy("label").agg((F.max(F.col("n") + F.col("above"))).alias("total"))
    # Two rows.
    spans = by.join(F.broadcast(total), "label").withColumn("last", F.col("total") - F.col("above")).withColumn("first", F.col("last") - F.col("n") + 1)
    block = lambda c: (c / BLOCK).cast("bigint")
    starts = spans.select("label", "v", "first", F.explode(F.sequence(block(F.col("first")), block(F.col("last")))).alias("block"))
    starts = starts.select("label", "block", F.greatest(F.col("first"), F.col("block") * BLOCK).alias("place"), "v", F.lit(None).cast(wanted.schema["row"].dataType).alias("row"))
    asked = wanted.select("label", block(F.col("place")).alias("block"), "place", F.lit(None).cast("double").alias("v"), "row")
    order = Window.partitionBy("label", "block").orderBy("place", F.col("row").isNotNull())
    return starts.union(asked).withColumn("v", F.last("v", ignorenulls=True).over(order)).where("row IS NOT NULL").select("label", "v", "row")


def threshold_folds(examples: DataFrame, sessions: DataFrame, feature: str, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """``(session, threshold, f1, softness)`` for each of ``sessions``: the threshold model of all other sessions'
    ``examples``, exactly as ``training.threshold_search`` finds it: of the midpoints between neighbouring values of the
    fold (a lone value stands for itself) the one of best F1, the lowest on ties.

    Examples without a value or a session are left out. A fold without examples has no row. Sessions without examples
    get the model of all. ``leaf`` and ``fan`` change the work, not the result.
    """
    own = examples.select("session", F.col(feature).cast("double").alias("v"), F.col("label").cast("bigint").alias("label")).dropna(subset=["session", "v"])
    own = written(own.groupBy("session", "v").agg(F.count("*").alias("n"), F.sum("label").alias("pos")), "loso-own")
    values = written(ranked(own), "loso-ranked")
    total = values.agg(F.count("*").alias("d"), F.sum("n").alias("n"), F.sum("pos").alias("pos")).first()
    d, zero = total["d"], lambda c: F.coalesce(c, F.lit(0))
    levels = 0
    while leaf * fan**levels < d:
        levels += 1
    above = Window.partitionBy("session").orderBy("rank").rowsBetween(1, Window.unboundedFollowing)
    mine = own.join(values.select("v", "rank", F.col("said").alias("all_said"), F.col("tp").alias("all_tp"), F.col("owner").isNotNull().alias("lone")), "v")
    mine = written(mine.withColumns({"own_said": zero(F.sum("n").over(above)), "own_tp": zero(F.sum("pos").over(above))}), "loso-mine")
    # Stretches of neighbouring ranks that only one session has: what follows one is the session's next candidate.
    island = F.col("rank") - F.row_number().over(Window.partitionBy("session").orderBy("rank"))
    islands = mine.where("lone").select("session", "rank", island.alias("i")).groupBy("session", "i").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).drop("i")
    sizes = own.groupBy("session").agg(F.sum("n").alias("own_n"), F.sum("pos").alias("own_pos"))
    folds = sessions.select("session").where("session IS NOT NULL").distinct().join(sizes, "session", "left")
    folds = folds.select("session", (F.lit(total["n"] or 0) - zero(F.col("own_n"))).alias("n"), (F.lit(total["pos"] or 0) - zero(F.col("own_pos"))).alias("positives"))
    folds = folds.join(islands.where("first = 0").select("session", (F.col("last") + 1).alias("low")), "session", "left")
    folds = folds.join(islands.where(F.col("last") == d - 1).select("session", (F.col("first") - 1).alias("top")), "session", "left")
    folds = written(folds.withColumns({"low": zero(F.col("low")), "top": F.coalesce("top", F.lit(d - 1))}).where("n > 0"), "loso-folds")
    # From each own rank to the next the constants are what the session has above the first.
    next_own = F.lead("rank").over(Window.partitionBy("session").orderBy("rank"))
    stretches = mine.select("session", F.col("rank").alias("a"), F.coalesce(next_own - 1, F.lit(d - 1)).alias("b"), "own_said", "own_tp")
    lowest = mine.groupBy("session").agg(F.min("rank").alias("rank"), F.sum("n").alias("own_said"), F.sum("pos").alias("own_tp"))
    start = folds.select("session").join(lowest, "session", "left").select("session", F.lit(0).cast("bigint").alias("a"), F.coalesce(F.col("rank") - 1, F.lit(d - 1)).alias("b"), zero(F.col("own_said")).alias("own_said"), zero(F.col("own_tp")).alias("own_tp"))
    tried = stretches.union(start).join(folds, "session").select(
        "session", F.greatest("a", "low").cast("bigint").alias("low"), F.least("b", F.col("top") - 1).cast("bigint").alias("high"), "own_said", "own_tp", "positives"
    ).where("low <= high")
    kind = dict(sessions.dtypes)["session"]
    piece = f"session {kind}, low bigint, high bigint, own_said bigint, own_tp bigint, positives bigint"
    pieces = written(tried.mapInPandas(_pieces(leaf, fan, levels), f"{piece}, level int, at bigint"), "loso-pieces")
    salts = pieces.count() // CHUNK + 1
    chunks = pieces.withColumn("salt", F.pmod(F.xxhash64("session", "low"), F.lit(salts))).groupBy("level", "at", "salt").agg(F.collect_list(F.struct("session", "low", "high", "own_said", "own_tp", "positives")).alias("pieces"))
    scored = chunks.join(_nodes(values, d, leaf, fan), ["level", "at"]).select("pieces", "ranks", "said", "tp").mapInPandas(_looked_at, f"session {kind}, f1 double, rank bigint")
    best = scored.groupBy("session").agg(F.min(F.struct((-F.col("f1")).alias("f"), "rank")).alias("b")).select("session", (-F.col("b.f")).alias("f1"), F.col("b.rank").alias("rank"))
    # The next candidate is the next rank, or what follows a stretch of ranks that only the fold's session has.
    best = best.withColumn("first", F.col("rank") + 1).join(islands, ["session", "first"], "left").select("session", "f1", "rank", F.coalesce(F.col("last") + 1, F.col("first")).alias("next"))
    at = lambda name, v: values.select(F.col("rank").alias(name), F.col("v").alias(v))
    best = best.join(at("rank", "v"), "rank").join(at("next", "u"), "next").select("session", ((F.col("v") + F.col("u")) / 2.0).alias("threshold"), "f1")
    alone = folds.where("low = top").join(at("low", "v"), "low")
    p, r = F.col("positives") / F.greatest("n", F.lit(1)), F.col("positives") / F.greatest("positives", F.lit(1))
    best = best.union(alone.select("session", F.col("v").alias("threshold"), 2 * p * r / F.greatest(p + r, F.lit(1e-12))))
    middle = _medians(folds, mine, values, int(total["n"] or 0), int(total["pos"] or 0))
    soft = F.greatest(F.abs(F.coalesce("m1", "threshold") - F.coalesce("m0", "threshold")) / 4.0, F.lit(1.0))
    return best.join(middle, "session", "left").select("session", "threshold", "f1", soft.alias("softness"))


def _medians(folds: DataFrame, mine: DataFrame, values: DataFrame, n: int, pos: int) -> DataFrame:
    """``(session, m1, m0)``: the medians of the folds' values of label 1 and 0, null where there are none.

    A place among a fold's examples is that place and the session's own examples up to there among all: the own examples
    up to the last own value below which the fold has fewer than it takes.
    """
    size = {1: F.col("positives"), 0: F.col("n") - F.col("positives")}
    mine = mine.withColumns({"upto": F.sum("n").over(Window.partitionBy("session").orderBy("rank")), "upto_pos": F.sum("pos").over(Window.partitionBy("session").orderBy("rank"))})
    own = {1: F.col("upto_pos"), 0: F.col("upto") - F.col("upto_pos")}
    every = {1: F.lit(pos) - F.col("all_tp"), 0: F.lit(n - pos) - (F.col("all_said") - F.col("all_tp"))}
    joined = folds.select("session", "n", "positives").join(mine.select("session", *[x[k].alias(f"{name}{k}") for k in (0, 1) for name, x in (("own", own), ("all", every))]), "session", "left")
    ranks = {(k, half): F.floor((size[k] + half) / 2).cast("bigint") + (1 - half) for k in (0, 1) for half in (0, 1)}
    # half 1: place (size + 1) / 2, half 0: place size / 2 + 1, both rounded down; the median is the mean of the two.
    passed = lambda k, half: F.coalesce(F.max(F.when(F.col(f"all{k}") - F.col(f"own{k}") < ranks[k, half], F.col(f"own{k}"))), F.lit(0))
    places = joined.groupBy("session", "n", "positives").agg(*[passed(k, half).alias(f"c{k}{half}") for k, half in ranks])
    row = lambda k, half: F.struct(F.lit(k).alias("label"), (ranks[k, half] + F.col(f"c{k}{half}")).alias("place"), size[k].alias("size"))
    asked = places.select("session", F.explode(F.array(*[row(k, half) for k, half in ranks])).alias("x")).where("x.size > 0")
    found = _ranked_values(values, asked.select("x.label", "x.place", F.struct("session").alias("row")))
    middle = lambda k: F.avg(F.when(F.col("label") == k, F.col("v")))
    return found.groupBy(F.col("row.session").alias("session")).agg(middle(1).alias("m1"), middle(0).alias("m0"))
