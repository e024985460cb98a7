"""Language identification by the nearest of several centroids per language.

A text is its UTF-8 bytes in lower case, letters kept, everything else one blank; its features are the n-grams of one to
``NGRAM`` of these bytes, hashed into ``dims`` places. A vector holds ``(1 + log tf) * idf`` of every place and has length
one. Document frequencies are counted over all training rows. A bounded sample of the training texts of each language is
clustered by spherical k-means; the unit centroids are the model. A text gets the language of the centroid with the
greatest cosine. It is rejected where its distance to that centroid is greater than that of all but a few in a thousand
of the sample texts that belong to it, and a margin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packed import pack, unpack
from .tables import shuffle_partitions, written

NGRAM = 3
#: Places that n-grams are hashed to.
DIMS = 1 << 15
#: Most different texts a language that are clustered, centroids a language, and rounds of clustering.
SAMPLE, CLUSTERS, ROUNDS = 1_000, 4, 12
#: Share of a centroid's sample texts that lie beyond its rejection distance, and the margin that is added to it.
BEYOND, MARGIN = 0.002, 0.05
#: Bytes of texts and number of texts that are counted together.
BLOCK_BYTES, BLOCK_TEXTS = 1 << 20, 1 << 12
#: Languages up to whose number the shares of their samples are sent to all tasks; with more, they are joined.
BROADCAST_LANGUAGES = 100_000
#: Bytes of centroids that are sent to all tasks at once; with more, languages are compared group by group.
MODEL_BYTES = 128 << 20
UNKNOWN = "und"

#: ASCII letters in lower case, other ASCII characters a blank, bytes of longer characters as they are.
_KEPT = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


def vectors(texts: list[str | None], dims: int = DIMS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: ``(texts before it, bounds of each text, places, counts)``, places rising within a text. Blanks
    come before and after a text, and runs of blanks are one. Repeated bytes of a text are all counted."""
    first = 0
    while first < len(texts):
        part, size, last = [], 0, first
        while last < len(texts) and (last == first or (size < BLOCK_BYTES and last - first < BLOCK_TEXTS)):
            words = (texts[last] or "").lower().encode().translate(_KEPT).split()
            part.append(b" " + b" ".join(words) + b" " if words else b"")
            size += len(part[-1])
            last += 1
        a = np.frombuffer(b"".join(part), np.uint8).astype(np.uint32)
        of = np.repeat(np.arange(len(part), dtype=np.uint32), [len(p) for p in part])
        code, keys = np.zeros(len(a), np.uint32), []
        for n in range(1, NGRAM + 1):
            code = code[: max(len(a) - n + 1, 0)] << np.uint32(8) | a[n - 1 :]
            whole = of[: len(code)] == of[n - 1 :]
            # The length is part of the hash; the upper bits of a product are the well mixed ones.
            mixed = (code[whole] + np.uint32(n << 24)) * np.uint32(0x9E3779B1)
            keys.append(of[: len(code)][whole] * np.uint32(dims) + (mixed >> np.uint32(8)) % np.uint32(dims))
        keys = np.sort(np.concatenate(keys))
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        at = keys[start].astype(np.int64)
        yield first, np.searchsorted(at, np.arange(len(part) + 1) * dims), at % dims, np.diff(np.r_[start, len(keys)])
        first = last


def weights(bounds: np.ndarray, places: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Values of the vectors of a block, each text's of length one."""
    w = (1 + np.log(counts)) * idf[places]
    squares = np.add.reduceat(np.r_[w * w, 0.0], bounds[:-1]) * (bounds[1:] > bounds[:-1])
    return w / np.sqrt(np.repeat(squares, np.diff(bounds)))


def document_frequencies(rows: DataFrame, text_col: str, dims: int = DIMS) -> tuple[int, np.ndarray]:
    """Number of rows, and in how many of them each place is. Tasks count into an array of ``dims`` numbers; these are
    added up in a few tasks, one after the other, and what is left are as many arrays as those."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(dims, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            n += len(texts)
            for _, _, places, _ in vectors(texts, dims):
                df += np.bincount(places, minlength=dims)
        if n:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n], "df": [pack(df)]}, pa.schema([("part", pa.int32()), ("n", pa.int64()), ("df", pa.binary())]))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(dims, np.int64)
        for b in batches:
            n += int(b["n"].sum())
            for x in b["df"]:
                df += unpack(x).astype(np.int64)
        if n:
            yield pd.DataFrame({"n": [n], "df": [pack(df)]})

    counted = written(rows.select(text_col).mapInArrow(count, "part int, n bigint, df binary"), "language-counts")
    sums = counted.repartition(min(64, shuffle_partitions(rows.sparkSession)), "part").select("n", "df").mapInPandas(add, "n bigint, df binary").collect()
    df = np.zeros(dims, np.int64)
    for r in sums:
        df += unpack(r["df"]).astype(np.int64)
    return sum(r["n"] for r in sums), df


def cluster(texts: list[str], idf: np.ndarray, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of ``texts`` and the least cosine each accepts. Seeds are picked one after the other, each the
    text farthest from those before it; the first is the text nearest to the mean. Texts without any feature are left
    out; with fewer texts than clusters each has its own."""
    dims = len(idf)
    parts = [(b, p, weights(b, p, c, idf)) for _, b, p, c in vectors(texts, dims)]
    rows = np.concatenate([np.diff(b) for b, _, _ in parts] or [np.zeros(0, np.int64)])
    places, w = (np.concatenate([x[i] for x in parts] or [np.zeros(0)]) for i in (1, 2))
    of = np.repeat(np.cumsum(rows > 0) - 1, rows)
    n, places = int((rows > 0).sum()), places.astype(np.int64)
    if not n:
        return np.zeros((0, dims), np.float32), np.zeros(0, np.float32)
    cosine = lambda c: np.bincount(of, w * c[places], n)
    unit = lambda c: c / max(np.linalg.norm(c), 1e-12)
    vector = lambda i: np.bincount(places[of == i], w[of == i], dims)
    centroids = [vector(int(np.argmax(cosine(np.bincount(places, w, dims)))))]
    near = cosine(centroids[0])
    while len(centroids) < min(clusters, n) and near.min() < 1 - 1e-9:
        centroids.append(vector(int(np.argmin(near))))
        near = np.maximum(near, cosine(centroids[-1]))
    before = None
    for _ in range(rounds):
        every = np.stack([cosine(c) for c in centroids])
        mine = every.argmax(0)
        if before is not None and (mine == before).all():
            break
        before = mine
        for k in range(len(centroids)):
            if (mine == k).any():
                inside = (mine == k)[of]
                centroids[k] = unit(np.bincount(places[inside], w[inside], dims))
    every = np.stack([cosine(c) for c in centroids])
    mine = every.argmax(0)
    least = [np.quantile(every[k][mine == k], BEYOND) - MARGIN if (mine == k).any() else 1.0 for k in range(len(centroids))]
    return np.stack(centroids).astype(np.float32), np.array(least, np.float32)


def fitted(train: DataFrame, text_col: str, lang_col: str, sample: int = SAMPLE, clusters: int = CLUSTERS, dims: int = DIMS) -> tuple[DataFrame, np.ndarray]:
    """The model table ``(lang, centroid binary, least float)`` and the inverse document frequencies, from training rows
    without nulls.

    The sample of a language are its texts with the smallest hashes, ``sample`` different ones at most. A bound on the
    hash that some twice as many pass keeps rows out before texts are told apart and ranked, so no task ranks a
    language; texts of which there are many copies are one.
    """
    n, df = document_frequencies(train, text_col, dims)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    hashed = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # Different texts are estimated for the bound only: where it lets too few pass, all the language's texts do.
    wanted = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("d")).select("lang", F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("d")).alias("share"))
    wanted = written(wanted, "language-shares")
    if wanted.count() <= BROADCAST_LANGUAGES:
        wanted = F.broadcast(wanted)
    passed = hashed.join(wanted, "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) <= F.col("share"))
    one = passed.groupBy("lang", "h").agg(F.min("text").alias("text"))
    ranked = one.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        centroids, least = cluster(rows.sort_values("h")["text"].tolist(), idf, clusters)
        return pd.DataFrame({"lang": [key[0]] * len(least), "centroid": [c.tobytes() for c in centroids], "least": least})

    return written(ranked.groupBy("lang").applyInPandas(fit, "lang string, centroid binary, least float"), "language-model"), idf


def _groups(model: DataFrame, dims: int, most_bytes: int) -> Iterator[list[tuple[str, bytes, float]]]:
    """Rows of the model, in order of language and centroid, as many at a time as ``most_bytes`` hold."""
    most, part = max(1, most_bytes // (4 * dims)), []
    for r in model.orderBy("lang", "centroid").toLocalIterator():
        part.append((r["lang"], bytes(r["centroid"]), r["least"]))
        if len(part) == most:
            yield part
            part = []
    if part:
        yield part


def predicted(
    docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, clusters: int = CLUSTERS, dims: int = DIMS, model_bytes: int = MODEL_BYTES
) -> DataFrame:
    """``docs`` with ``__lang`` (the nearest centroid's; ``und`` where a text is null or has no letter), ``__cosine``
    (to it, 0 to 1) and ``__rejected`` (it lies too far from that centroid; true for ``und``).

    Learns from the rows where ``train`` is true and text and language are not null; a prediction sees the text only.
    Texts without letters, which tell no language, are not learned from. Ties go to the language that sorts first.
    Repeated rows count each in the frequencies, once in the sample, and get equal predictions. With nothing to learn
    from, and in an empty table, every language is ``und``. Other columns stay as they are, under any names but those
    beginning with two underscores.

    ``model_bytes`` of centroids are sent to all tasks at a time. A model that is larger is compared in groups of
    languages, one pass over the rows after the other, each keeping the better of what it finds and what it got.
    """
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    learned = docs.where(F.coalesce(train, F.lit(False)) & F.col(lang_col).isNotNull() & letters)
    model, idf = fitted(learned.select(text_col, lang_col), text_col, lang_col, sample, clusters, dims)
    out = docs.withColumns({"__letters": letters, "__lang": F.lit(None).cast("string"), "__cosine": F.lit(0.0), "__rejected": F.lit(True)})
    spark = docs.sparkSession
    for group in _groups(model, dims, model_bytes):
        langs, least = [r[0] for r in group], np.array([r[2] for r in group], np.float64)
        # Rows are places, so that a text reads whole lines of it.
        table = spark.sparkContext.broadcast(np.ascontiguousarray(np.stack([np.frombuffer(r[1], np.float32) for r in group], 1)))

        def compare(batches: Iterator[pa.RecordBatch], langs=langs, least=least, table=table) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = b.schema.names
                texts, known = b.column(text_col).to_pylist(), b.column("__letters").to_pylist()
                lang, cosine, rejected = (b.column(c).to_pylist() for c in ("__lang", "__cosine", "__rejected"))
                for first, bounds, places, counts in vectors([t if k else None for t, k in zip(texts, known)], dims):
                    w = weights(bounds, places, counts, idf).astype(np.float32)
                    for j, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), first):
                        if hi == lo:
                            continue
                        every = w[lo:hi] @ table.value[places[lo:hi]]
                        k = int(every.argmax())
                        found = min(max(float(every[k]), 0.0), 1.0)
                        if lang[j] is None or found > cosine[j]:
                            lang[j], cosine[j], rejected[j] = langs[k], found, found < least[k]
                columns = dict(zip(names, b.columns)) | {"__lang": pa.array(lang, pa.string()), "__cosine": pa.array(cosine, pa.float64()), "__rejected": pa.array(rejected, pa.bool_())}
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

        out = out.mapInArrow(compare, out.schema)
    return out.withColumn("__lang", F.coalesce("__lang", F.lit(UNKNOWN))).drop("__letters")
