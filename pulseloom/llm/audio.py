"""Chroma fingerprints of audio columns, and alignment of recordings by them.

Sound is cut into frames; the energy of each frame is folded into the twelve pitch classes. Sixteen filters compare
the sums of two areas of that pitch-by-time image, read from its integral image, at every frame; each gives two bits
(a Gray code of its quantised log ratio), and the sixteen make one 32-bit integer a frame. Recordings with equal
integers are one class. Equal integers of two classes vote for an offset, runs of one integer once; the offsets with
votes enough are held against each other by the bit errors of all overlapping integers. A match is both: a peak of the
offset histogram, and few bit errors about it. Bit errors alone say little over short overlaps, where one pair in forty
of recordings that have nothing in common stays under three bits in ten.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

FRAME, HOP, SPAN = 1024, 256, 16
#: (shape, lowest pitch class, pitch classes, frames) of the filters, by a rule: four shapes at four sizes.
FILTERS = tuple((k % 4, 3 * (k // 4) % 12, (12, 6, 8, 4)[k // 4] if k // 4 == 0 else 12 - 3 * (k // 4), (4, 8, 12, 16)[(k + k // 4) % 4]) for k in range(16))
#: Recordings that are handed to Python together.
RECORDINGS = 64
#: Frames whose spectra are in memory together.
FRAMES = 4096
#: A quantiser's outer bounds on the natural log of the ratio.
BOUND = 0.15


def pcm(audio: bytes | None) -> tuple[np.ndarray, int]:
    """Samples (mono, -1 to 1) and rate of a 16-bit RIFF/WAVE file; nothing for null, other or broken bytes."""
    none = np.zeros(0), 0
    if not audio or audio[:4] != b"RIFF" or audio[8:12] != b"WAVE":
        return none
    at, channels, rate, bits = 12, 1, 0, 0
    while at + 8 <= len(audio):
        name, size = audio[at : at + 4], struct.unpack_from("<I", audio, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(audio):
            channels, rate, bits = (struct.unpack_from(f, audio, at + o)[0] for f, o in (("<H", 10), ("<I", 12), ("<H", 22)))
        if name == b"data":
            if bits != 16 or not channels or not rate:
                return none
            size = min(size, len(audio) - at - 8) // (2 * channels) * 2 * channels
            return np.frombuffer(audio, "<i2", size // 2, at + 8).reshape(-1, channels).mean(1) / 32768, rate
        at += 8 + size + size % 2
    return none


def wave(samples: np.ndarray, rate: int) -> bytes:
    """A mono 16-bit RIFF/WAVE file."""
    data = np.clip(np.round(samples * 32767), -32768, 32767).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(data)) + data


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """``recordings x frames x 12`` energies of recordings of one length, each frame of unit length or zero."""
    n = (samples.shape[1] - FRAME) // HOP + 1
    if n < 1 or not rate:
        return np.zeros((len(samples), 0, 12))
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = (hz >= 55) & (hz <= 3520)
    fold = np.zeros((len(hz), 12))
    fold[np.flatnonzero(use), np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12] = 1
    windows, window = np.lib.stride_tricks.sliding_window_view(samples, FRAME, axis=1)[:, ::HOP], np.hanning(FRAME)
    # Frames of a long recording are looked at in stretches.
    step = max(1, FRAMES // len(samples))
    parts = [np.abs(np.fft.rfft(windows[:, i : i + step] * window, axis=2)) ** 2 @ fold for i in range(0, n, step)]
    out = np.concatenate(parts, 1)
    size = np.sqrt((out**2).sum(2, keepdims=True))
    return np.where(size > 1e-6, out / np.maximum(size, 1e-6), 0)


def integers(images: np.ndarray) -> np.ndarray:
    """``recordings x integers``: an unsigned 32-bit integer for each frame that has ``SPAN - 1`` more after it."""
    n = images.shape[1] - SPAN + 1
    if n < 1:
        return np.zeros((len(images), 0), np.uint32)
    total = np.zeros((len(images), images.shape[1] + 1, 25))
    total[:, 1:, 1:] = np.cumsum(np.cumsum(np.concatenate([images, images], 2), 1), 2)
    area = lambda t, w, p, h: total[:, t + w : t + w + n, p + h] - total[:, t : t + n, p + h] - total[:, t + w : t + w + n, p] + total[:, t : t + n, p]
    out = np.zeros((len(images), n), np.uint32)
    for shape, low, high, w in FILTERS:
        whole = area(0, w, low, high)
        early, lower = area(0, w // 2, low, high), area(0, w, low, high // 2)
        corner = area(0, w // 2, low, high // 2)
        middle = area(w // 4, w // 2, low, high)
        part = (early, lower, early + lower - 2 * corner, middle)[shape]
        value = np.log((1 + part) / (1 + whole - part))
        level = (value > -BOUND).astype(np.uint32) + (value > 0) + (value > BOUND)
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return out


def fingerprints(rows: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """``(id, prints array<bigint>)`` of every row; null, broken or short audio has no integers."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sounds, alike = [pcm(a) for a in b[audio_col]], {}
            for i, (samples, rate) in enumerate(sounds):
                alike.setdefault((len(samples), rate), []).append(i)
            made: list = [None] * len(sounds)
            # Recordings of one length and rate go through the filters together.
            for (_, rate), places in alike.items():
                for i, ints in zip(places, integers(chroma(np.stack([sounds[i][0] for i in places]), rate)).astype(np.int64)):
                    made[i] = ints
            yield pd.DataFrame({id_col: b[id_col], "prints": made})

    return rows.select(id_col, audio_col).mapInPandas(run, f"`{id_col}` {kind}, prints array<bigint>")


def classes(prints: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, rep)`` and classes ``(rep, members, prints)``. A class has equal integers; its representative
    is the smallest id. Rows with a null id or without integers are in no class."""
    named = prints.where(F.col(id_col).isNotNull() & (F.size("prints") > 0)).withColumn("key", F.sha2(F.array_join("prints", ","), 256))
    held = written(named.groupBy("key").agg(F.min(id_col).alias("rep"), F.count("*").alias("members"), F.first("prints").alias("prints")), "audio-classes")
    members = named.select(F.col(id_col).alias("id"), "key").join(held.select("key", "rep"), "key").select("id", "rep")
    return members, held.drop("key")


def align(queries: DataFrame, held: DataFrame, votes: int = 2, overlap: int = 16, errors: float = 0.3) -> DataFrame:
    """``(query, rep, offset, overlap, bit_errors)`` of the classes ``held`` that match those of ``queries(rep,
    prints)``: the best offset of each pair (fewest bit errors a bit, then the smallest offset).

    A key is an integer, taken where it differs from the one before, so that held notes count once. All pairs with an
    equal key vote; offsets with at least ``votes`` votes are held against all overlapping bits. Overlaps are
    ``overlap`` integers or more. A class matches itself, however short it is.
    """

    def keys(df: DataFrame, name: str, at: str) -> DataFrame:
        placed = df.select(F.col("rep").alias(name), F.col("prints").alias("k"))
        fresh = F.filter(F.transform("k", lambda x, i: F.when((i == 0) | (F.get(F.col("k"), i - 1) != x), F.struct(x.alias("k"), i.alias("i")))), lambda x: x.isNotNull())
        return placed.select(name, F.explode(fresh).alias("x")).select(name, F.col("x.k").alias("k"), F.col("x.i").alias(at))

    found = (
        keys(queries, "query", "at_q").join(keys(held, "rep", "at"), "k")
        .groupBy("query", "rep", (F.col("at") - F.col("at_q")).alias("offset")).count().where(F.col("count") >= votes).select("query", "rep", "offset")
    )
    both = found.join(queries.select(F.col("rep").alias("query"), F.col("prints").alias("a")), "query").join(held.select("rep", F.col("prints").alias("b")), "rep")
    from_a, from_b = F.greatest(-F.col("offset"), F.lit(0)), F.greatest(F.col("offset"), F.lit(0))
    size = F.least(F.size("a") - from_a, F.size("b") - from_b)
    both = both.withColumn("overlap", size).where(F.col("overlap") >= overlap)
    differ = F.zip_with(F.slice("a", from_a + 1, F.col("overlap")), F.slice("b", from_b + 1, F.col("overlap")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    judged = both.withColumn("bit_errors", F.aggregate(differ, F.lit(0), lambda s, x: s + x)).where(F.col("bit_errors") <= errors * 32 * F.col("overlap"))
    best = Window.partitionBy("query", "rep").orderBy(F.col("bit_errors") / F.col("overlap"), "offset")
    others = judged.withColumn("n", F.row_number().over(best)).where("n = 1 AND query != rep").select("query", "rep", "offset", "overlap", "bit_errors")
    zero = F.lit(0)
    own = queries.select(F.col("rep").alias("query"), "rep", zero.alias("offset"), F.size("prints").alias("overlap"), zero.alias("bit_errors"))
    return others.unionByName(own)


def search(rows: DataFrame, asks: Column, id_col: str, audio_col: str) -> DataFrame:
    """``(query_id, match_class, members, offset, overlap, bit_errors)``: the rows for which ``asks`` holds, each
    against the classes of all rows, its own included. Copies are counted as members, not expanded. Null, broken or
    short audio has no integers and neither asks nor matches; of equally good offsets the smallest is named."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, RECORDINGS)
    try:
        prints = written(fingerprints(rows, id_col, audio_col), "audio-prints")
    finally:
        conf.set(name, before)
    members, held = classes(prints, id_col)
    asking = written(members.where(asks), "audio-queries")
    wanted = held.join(asking.select("rep").distinct(), "rep", "left_semi").select("rep", "prints")
    found = align(wanted, held)
    return (
        asking.join(found, F.col("query") == asking["rep"]).select(F.col("id").alias("query_id"), found["rep"].alias("match_class"), "offset", "overlap", "bit_errors")
        .join(held.select(F.col("rep").alias("match_class"), "members"), "match_class")
        .select("query_id", "match_class", "members", "offset", "overlap", "bit_errors")
    )


def melody(vectors: DataFrame, id_col: str, vector_col: str, rate: int = 4000, note: int = 256) -> DataFrame:
    """``(id, audio)``: each vector played as a tune, a note of ``note`` samples for each component; null for null."""
    time = np.arange(note) / rate
    tone = {p: np.sin(2 * np.pi * 440 * 2 ** (p / 12) * time) * np.hanning(note) for p in range(-18, 19)}
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sounds = []
            for v in b[vector_col]:
                pitch = None if v is None else np.clip(np.nan_to_num(np.round(60 * np.array(v, float))), -18, 18).astype(int).tolist()
                sounds.append(None if pitch is None else wave(0.8 * np.concatenate([tone[p] for p in pitch] or [np.zeros(0)]), rate))
            yield pd.DataFrame({id_col: b[id_col], "audio": sounds})

    return vectors.select(id_col, vector_col).mapInPandas(run, f"`{id_col}` {kind}, audio binary")
