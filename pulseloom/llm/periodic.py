"""Runs of repeated words by an online diagonal DP that is kept sparse.

A run is a stretch of words with smallest period ``q`` that no neighbour extends and that is ``times * q`` words long or
more. Words of a text are read from left to right. A lag is a diagonal: while it is active, its match length counts the
words that equalled the word ``lag`` before them without a break. Each word increments the lengths of the lags at which
it occurred before; a diagonal that a word does not continue has ended, and if its run (match length and lag) is long
enough it is emitted at once.

Which earlier occurrences count keeps the work small without losing a run. A run of period ``q`` matches at least
``(times - 1) * q`` words in a row, so an occurrence matters only with the words before it: the last ``k`` words, for
scales ``k`` that are ``BASE`` times powers of two, and for lags in ``(k / 2, k]`` (the least scale takes all up to
``k``). Of these only the latest occurrence counts. For a run of period ``q`` and its scale ``k`` this is complete: the
``k`` words that end anywhere from ``q + k`` words into the run on hold a whole period, which as a primitive word occurs
in the run at multiples of ``q`` only, so their latest occurrence is at lag ``q`` exactly, without a break up to the
run's end. It is also sound: a diagonal of these lags that is long enough for its lag can have no smaller period, as
that would be a later occurrence, so it is such a run and whole. Each word thus has one lag a scale, and only words that
end a repeated ``k``-gram have any: n log n in all, whatever the text repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the least scale, and bytes of text whose words are numbered together.
BASE, BLOCK = 16, 1 << 21
#: Least words of a run, and least periods in it.
LEAST, TIMES = 24, 3


def _occurrences(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys at rising places ``at``: numbers of the keys that occur twice or more, their places, and for each the
    latest earlier place of the same key (-1: none)."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    number = np.cumsum(np.r_[True, ~same][: len(key)]) - 1
    before = np.where(np.r_[False, same][: len(key)], np.r_[-1, at[order[:-1]]][: len(key)], -1)
    again = np.r_[False, same][: len(key)] | np.r_[same, False][: len(key)]
    kept = order[again]
    rising = np.argsort(kept)
    return number[again][rising], at[kept][rising], before[again][rising]


def lags(words: np.ndarray) -> np.ndarray:
    """Rows ``(place, lag, scale)`` in rising order of place: where a word, with the words before it, occurred before.
    Words are numbers; one that occurs once is in no match."""
    found, n = [], len(words)
    number, at, before = _occurrences(words, np.arange(n))
    k = 1
    while len(at):
        if k >= BASE:
            lag = at - before
            new = (before >= 0) & (lag <= k) & ((lag > k // 2) | (k == BASE))
            found.append(np.stack([at[new], lag[new], np.full(new.sum(), k)], 1))
        # Grams of twice as many words: this one and the one that ends k words before it.
        slot = np.full(n, -1)
        slot[at] = number
        left = np.where(at >= k, slot[at - k], -1)
        both = left >= 0
        number, at, before = _occurrences(left[both] * n + number[both], at[both])
        k *= 2
    every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return every[np.argsort(every[:, 0], kind="stable")]


def diagonals(steps: list[list[int]], least: int, times: int) -> list[tuple[int, int, int]]:
    """The runs ``(start, length, period)`` of a text from its rows of ``lags``, in the order they end."""
    active: dict[int, int] = {}
    runs: list[tuple[int, int, int]] = []
    last = -2

    def end(place: int, going: dict[int, int], now: dict[int, int]) -> None:
        for lag, length in going.items():
            if lag not in now and length + lag >= max(least, times * lag):
                runs.append((place - length - lag + 1, length + lag, lag))

    i, n = 0, len(steps)
    while i < n:
        place = steps[i][0]
        going = active if place == last + 1 else {}
        if going is not active:
            end(last, active, {})
        now = {}
        while i < n and steps[i][0] == place:
            _, lag, scale = steps[i]
            now[lag] = going[lag] + 1 if lag in going else scale
            i += 1
        end(last, going, now)
        active, last = now, place
    end(last, active, {})
    return runs


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > BLOCK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def runs_of(texts: list[str | None], least: int = LEAST, times: int = TIMES) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words of each text and its runs in order of start and then period."""
    for block in _blocks([(t or "").encode() for t in texts]):
        words = [t.split() for t in block]
        flat = [w for ws in words for w in ws]
        coded = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.array([len(ws) for ws in words])
        # A word that occurs once lies between neighbouring texts, so that no match goes on from one to the next.
        apart = np.empty(len(coded) + len(words), np.int64)
        ends = np.cumsum(size + 1) - 1
        real = np.ones(len(apart), bool)
        real[ends] = False
        apart[real], apart[ends] = coded, len(coded) + np.arange(len(words))
        steps = lags(apart)
        bounds = np.searchsorted(steps[:, 0], np.r_[0, ends])
        first = np.r_[0, ends[:-1] + 1]
        for ws, lo, hi, start in zip(words, bounds[:-1], bounds[1:], first.tolist()):
            found = diagonals(steps[lo:hi].tolist(), least, times) if hi > lo else []
            yield ws, sorted(((s - start, n, q) for s, n, q in found), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist()) if k]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest exact length / period; of equals the first, and then the smaller period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def repeated(docs: DataFrame, least: int = LEAST, times: int = TIMES, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__runs array<struct<start, length, period>>`` (long, by start and then period), ``__strongest``
    (that of the greatest exact length over period; null without runs) and ``__collapsed`` (the words that no run has
    after its first period, joined by one space).

    Null, empty and blank texts have no runs and collapse to an empty string. A text is worked on by itself, whole and
    by one task: rows need no shuffle, repeated rows get equal results, ids may be null, and an empty table gives an
    empty one. Columns may have any names but those beginning with two underscores. Below 3 for
    ``times`` or 23 for ``least`` the latest occurrences are not enough, which is an error.
    """
    if times < 3 or 2 * least < 3 * BASE - 2:
        raise ValueError("runs of fewer than three periods, or of fewer than 23 words, would be incomplete")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    run = "struct<start:bigint,length:bigint,period:bigint>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        shaped = lambda r: dict(zip(("start", "length", "period"), r))
        for b in batches:
            every, best, kept = [], [], []
            for words, runs in runs_of(b.column(text_col).to_pylist(), least, times):
                every.append([shaped(r) for r in runs])
                best.append(shaped(strongest(runs)) if runs else None)
                kept.append(b" ".join(collapsed(words, runs)).decode())
            made = [pa.array(every, pa.list_(kind)), pa.array(best, kind), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, "__runs", "__strongest", "__collapsed"])

    return docs.mapInArrow(work, f"{kinds}__runs array<{run}>, __strongest {run}, __collapsed string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in which a tenth of the texts, by the CRC-32 ``h`` of their id, repeat a stretch to their end: with
    ``g = floor(h / 10)`` and n words, each word ``i >= a`` becomes word ``a + (i - a) % p``, where ``a = g % n`` and
    ``p = 1 + floor((n - a) / (3 + g % 8))``. Other texts, nulls and texts of null ids are as they were."""
    h = F.crc32(F.col(id_col).cast("string"))
    chosen = docs.withColumn("__h", h).withColumn("__w", F.when(F.col("__h") % 10 == 0, F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    sized = chosen.withColumns({"__n": F.size("__w"), "__g": F.floor(F.col("__h") / 10)}).withColumn("__a", F.when(F.col("__n") > 0, (F.col("__g") % F.col("__n")).cast("int")))
    sized = sized.withColumn("__p", (1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("__w", F.col("__a") + 1, F.col("__p")), F.ceil((F.col("__n") - F.col("__a")) / F.col("__p")).cast("int")))
    words = F.concat(F.slice("__w", F.lit(1), F.col("__a")), F.slice(again, F.lit(1), F.col("__n") - F.col("__a")))
    planted = F.when(F.col("__n") > 0, F.array_join(words, " ")).otherwise(F.col(text_col))
    return sized.select(*[planted.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the strongest run and hashes of all runs and of the collapsed text."""
    line = F.transform("__runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("__strongest")
    # Whole numbers: a quotient of doubles can round up to the next.
    milli = F.expr("1000 * __strongest.length div __strongest.period")
    return found.select(
        id_col, F.size("__runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        milli.alias("exponent_milli"), F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("__runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("__collapsed", 256).alias("collapsed_sha256"),
    )
