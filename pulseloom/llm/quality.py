"""Quality rules whose cutoffs limit how often clean documents are rejected.

Each rule rejects a document whose score for one feature is at or above a cutoff of that rule and of the document's
stratum. Cutoffs come from labelled documents that pass the base; equal texts count once, and a hash of the text says
which half a document is in. The choosing half lays down one path for each stratum, from lenient to strict: at each
step every rule has the lowest cutoff at which it alone rejects no more than a share (``STEPS``) of the clean documents
and helps. The other half, the holdout, certifies whole steps, all rules together: a step passes while the exact
binomial tail ``P(Bin(n, epsilon) <= k)`` (n clean documents, k of them rejected by any rule) is at most ``delta``
divided by the number of strata, and testing stops at the first that fails. Fixed-sequence testing needs no correction
along the path, the division (Bonferroni) covers the strata. So with probability ``1 - delta`` in no stratum more than
``epsilon`` of the clean documents that pass the base are rejected. Of the steps that pass, the choosing half takes the
one that rejects most bad documents at the least weight of clean ones, and the more lenient one on ties. A stratum with
too few labels has no step that passes, and then its rules reject nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import SPACES, written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of the windows whose repeats count.
WINDOW = 8
#: A rule's score is a whole number from 0 to BINS; the grid of cutoffs is 1 to BINS.
BINS = 200
#: Rule -> score of 0..BINS, high is bad.
RULES = ("symbols", "capitals", "exclaiming", "short_words", "long_words", "dup_lines", "repeats", "digits")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares of clean documents that a rule alone may reject, along the path of cutoffs.
STEPS = (0.0, 0.00025, 0.0005, 0.001, 0.0015, 0.002, 0.003, 0.004, 0.005, 0.0075, 0.01)
#: Up to this many strata their cutoffs are sent to all tasks; beyond, they are joined as a table.
BROADCAST_STRATA = 10_000


def repeat_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words covered by windows of ``size`` words that occur twice or more, first occurrences included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (h[i : i + n] ^ (h[i : i + n] >> np.uint64(29)))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    # Equal windows have equal hashes; only these few are compared as words.
    suspects = np.unique(order[np.flatnonzero(np.r_[same, False] | np.r_[False, same])]).tolist()
    seen: dict[tuple, int] = {}
    hit = np.zeros(len(words) + 1, np.int64)
    for i in suspects:
        first = seen.setdefault(tuple(words[i : i + size]), i)
        if first != i:
            for at in (first, i):
                hit[at : at + size] = 1
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` and then the scores of ``RULES``."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    # One pass counts every byte; UTF-8 continuation bytes begin no character. Capitals and letters are ASCII ones.
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = lambda chars: int(by[np.frombuffer(chars.encode(), np.uint8)].sum())
    chars = len(raw) - int(by[128:192].sum()) - of(SPACES)
    symbols, up, low = of(SYMBOLS), int(by[65:91].sum()), int(by[97:123].sum())
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = repeat_words(words)
    share = lambda a, b: min(BINS, BINS * a // b) if b else 0
    mean10 = 10 * chars // n if n else 0
    scores = (
        share(symbols, n),
        share(up, up + low),
        share(of("!"), n),
        max(0, min(BINS, 2 * (40 - mean10))) if n else BINS,
        max(0, min(BINS, mean10 - 60)),
        share(dup, lines),
        share(repeats, n),
        share(of("0123456789"), chars),
    )
    return (n, chars, symbols, dup, repeats, *scores)


def measures(docs: DataFrame, keep: list[str], text_col: str, stratum_col: str) -> DataFrame:
    """``keep`` columns, ``__q_stratum``, ``__q_key`` (a hash of the text), ``COUNTS`` after ``__q_`` (long) and
    ``__q_scores`` (of ``RULES``)."""
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [measure(t) for t in b["__q_text"]]
            out = b[[*keep, "__q_stratum", "__q_key"]].copy()
            for i, c in enumerate(COUNTS):
                out[f"__q_{c}"] = pd.array([r[i] for r in rows], "int64")
            out["__q_scores"] = [list(r[len(COUNTS) :]) for r in rows]
            yield out

    made = ", ".join(f"__q_{c} bigint" for c in COUNTS)
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("__q_stratum")
    given = docs.select(*keep, F.col(text_col).alias("__q_text"), stratum, F.xxhash64(text_col).alias("__q_key"))
    return given.mapInPandas(run, f"{kinds}__q_stratum string, __q_key bigint, {made}, __q_scores array<int>")


def tail(k: int, n: int, p: float) -> float:
    """Exact ``P(Bin(n, p) <= k)``."""
    if k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def path(clean: np.ndarray, bad: np.ndarray, weight: float) -> list[list[int | None]]:
    """Cutoffs of all rules for each of ``STEPS``, from the choosing half's counts by rule and score."""
    above = lambda x: np.cumsum(x[:, ::-1], 1)[:, ::-1]  # noqa: E731  documents with this score or more
    good, poor = above(clean), above(bad)
    n_good, n_poor = max(int(good[0, 0]), 1), max(int(poor[0, 0]), 1)
    out: list[list[int | None]] = []
    for step in STEPS:
        cuts: list[int | None] = []
        for g, p in zip(good.tolist(), poor.tolist()):
            cut = next((c for c in range(1, BINS + 1) if g[c] <= step * n_good), None)
            cuts.append(cut if cut is not None and p[cut] / n_poor > weight * g[cut] / n_good else None)
        out.append(cuts)
    return out


def certified(hold: np.ndarray, clean: np.ndarray, bad: np.ndarray, epsilon: float, level: float, weight: float) -> int | None:
    """The step to take, from the numbers of documents that each step is the first to reject (the last number: that
    none does): the holdout's clean ones, the choosing half's clean and bad ones. None if no step passes or helps."""
    best, found = 0.0, None
    for step in range(len(STEPS)):
        rejected = [int(x[: step + 1].sum()) for x in (hold, clean, bad)]
        if not hold.sum() or tail(rejected[0], int(hold.sum()), epsilon) > level:
            break
        gain = rejected[2] / max(int(bad.sum()), 1) - weight * rejected[1] / max(int(clean.sum()), 1)
        if gain > best + 1e-12:
            best, found = gain, step
    return found


def cutoffs(labelled: DataFrame, epsilon: float = 0.01, delta: float = 0.05, weight: float = 10.0) -> DataFrame:
    """``(stratum, cuts array<int>)`` from ``labelled(key, stratum, clean boolean, scores)``; a null cut never rejects.

    Rows of one key are one text; it is clean if all its labels say so. Counts by stratum, rule and score, and then by
    stratum and step, are made over all labelled texts before anything is gathered: at most ``len(RULES) * (BINS + 1)``
    rows of a stratum meet in one group.
    """
    texts = labelled.groupBy("stratum", "key").agg(F.min("clean").alias("clean"), F.first("scores").alias("scores"))
    texts = written(texts.withColumn("hold", F.pmod(F.xxhash64("key"), F.lit(2)) == 0), "quality-texts")
    n_strata = max(1, texts.select("stratum").distinct().count())
    fit = texts.where("NOT hold")
    counted = fit.select("stratum", "clean", F.posexplode("scores").alias("rule", "score")).groupBy("stratum", "rule", "score").agg(
        F.count_if("clean").alias("good"), F.count_if(~F.col("clean")).alias("poor")
    )

    def lay(g: pd.DataFrame) -> pd.DataFrame:
        by = np.zeros((2, len(RULES), BINS + 1), np.int64)
        for j, c in enumerate(("good", "poor")):
            np.add.at(by[j], (g["rule"].to_numpy(), g["score"].to_numpy()), g[c].to_numpy())
        return pd.DataFrame({"stratum": [g["stratum"].iloc[0]], "steps": [path(*by, weight)]})

    paths = written(counted.groupBy("stratum").applyInPandas(lay, "stratum string, steps array<array<int>>"), "quality-paths")
    over = lambda cuts: F.exists(F.arrays_zip(F.col("scores").alias("s"), cuts.alias("c")), lambda x: F.coalesce(x["s"] >= x["c"], F.lit(False)))
    first = F.coalesce(F.array_position(F.transform("steps", over), True), F.lit(0)).cast("int")
    met = texts.join(paths, "stratum").select("stratum", "clean", "hold", F.when(first == 0, len(STEPS)).otherwise(first - 1).alias("step"))
    firsts = met.groupBy("stratum", "step").agg(
        F.count_if(F.col("clean") & F.col("hold")).alias("clean_hold"),
        F.count_if(F.col("clean") & ~F.col("hold")).alias("clean_fit"),
        F.count_if(~F.col("clean") & ~F.col("hold")).alias("bad_fit"),
    )
    level = delta / n_strata

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        by = np.zeros((3, len(STEPS) + 1), np.int64)
        for j, c in enumerate(("clean_hold", "clean_fit", "bad_fit")):
            by[j, g["step"].to_numpy()] = g[c].to_numpy()
        step = certified(*by, epsilon, level, weight)
        return pd.DataFrame({"stratum": [g["stratum"].iloc[0]], "step": pd.array([step], "Int64")})

    chosen = firsts.groupBy("stratum").applyInPandas(pick, "stratum string, step int")
    return chosen.where("step IS NOT NULL").join(paths, "stratum").select("stratum", F.get("steps", "step").alias("cuts"))


def judged(
    docs: DataFrame,
    labels: DataFrame,
    keep: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_col: str = "quality",
    epsilon: float = 0.01,
    delta: float = 0.05,
) -> DataFrame:
    """``keep`` columns (the id among them) and ``__q_`` columns: stratum, counts, scores, base_failed, kept.

    The base fails texts of under 20 words or with over 30 % of words in repeated windows. Null text is an empty one
    and fails. A null stratum counts as the stratum ''. Labels that are null or name no document are ignored; a text
    that is labelled several times is clean if all its labels say so; without labels no rule rejects. Repeated documents are judged alike, each on its
    own row. Other columns of the labels are never looked at; no column of the documents may begin with ``__q_``.
    Texts are measured once; only ids and scores are shuffled.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("clean")
    )
    found = written(measures(docs, keep, text_col, stratum_col), "quality-measured")
    base = (F.col("__q_n_words") < 20) | (100 * F.col("__q_n_repeat_words") > 30 * F.col("__q_n_words"))
    scored = found.where(~base).select(F.col(id_col).alias("id"), F.col("__q_key").alias("key"), F.col("__q_stratum").alias("stratum"), F.col("__q_scores").alias("scores"))
    cuts = written(cutoffs(written(scored.join(marked, "id"), "quality-labelled"), epsilon, delta), "quality-cuts")
    cuts = cuts.select(F.col("stratum").alias("__q_stratum"), F.col("cuts").alias("__q_cuts"))
    if cuts.count() <= BROADCAST_STRATA:
        cuts = F.broadcast(cuts)
    over = F.exists(F.arrays_zip("__q_scores", "__q_cuts"), lambda x: F.coalesce(x["__q_scores"] >= x["__q_cuts"], F.lit(False)))
    return (
        found.join(cuts, "__q_stratum", "left")
        .withColumn("__q_base_failed", base)
        .withColumn("__q_kept", ~base & ~F.coalesce(over, F.lit(False)))
        .drop("__q_cuts")
    )


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: the id, ``COUNTS``, ``base_failed``, ``kept``, ``scores``. See ``judged``."""
    found = judged(docs, labels, [id_col], id_col, **options)
    return found.select(id_col, *[F.col(f"__q_{c}").alias(c) for c in (*COUNTS, "base_failed", "kept", "scores")])


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return judged(docs, labels, docs.columns, **options).where("__q_kept").select(*docs.columns)
