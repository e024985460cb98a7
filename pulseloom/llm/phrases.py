"""Collocations: phrases of 2 to ``LONGEST`` words that are counted exactly in counting quotient filters.

Texts are cut into pieces at punctuation and pieces into words; all counts are those of a language. Words met fewer than
``least`` times are in no candidate, nor are phrases with a part that rare, so counting goes in three steps: words,
pairs of frequent words, and phrases of three words and more all of whose neighbouring words are frequent pairs.

Frequent words of all languages are numbered together. A phrase is packed from the ``bits`` of each of its words, and a
Feistel network over the words permutes these keys invertibly, so that they are spread evenly and none is lost. A
filter holds sorted keys as quotients (the upper bits: how many keys each has) and whole remainders, with a counter for
each: a lossless table of little more than the remainders. Every task that reads texts makes one filter for each phrase
length, cuts it into ranges of quotients, and sends these to the buckets that own the range; buckets merge the sorted
filters of all tasks and keep the phrases that are frequent. What is sent is pre-aggregated, so a hot word, phrase,
language or text is a counter there, and every bucket has an even share of the distinct keys.

Texts are read once, where they lie; after that, words are numbers. Work goes on from written tables only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
import zstandard

from .packed import pack, unpack
from .tables import shuffle_partitions, written

LONGEST = 5
#: Occurrences below which a phrase is no candidate, and phrases reported for a language.
LEAST, TOP = 100, 2000
#: Bytes of text in a chunk.
CHUNK = 4 << 20
UNKNOWN = "und"
#: Parts in which the ranking of a language begins.
SALTS = 64

_ENDS = b".,;:!?\n\x0b\x0c\r"
#: ASCII capitals in small letters, ends of pieces a full stop, tabs blanks.
_PLAIN = bytes(46 if b in _ENDS else 32 if b == 9 else b for b in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    """Words, and a full stop (which no word has) where a piece ends."""
    out: list[bytes] = []
    for piece in (text or "").encode().translate(_PLAIN).split(b"."):
        # Only blanks are left of what split() cuts at.
        out += piece.split()
        out.append(b".")
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(parts: np.ndarray, bits: int, back: bool = False) -> np.ndarray:
    """``parts[i]``: the ``bits`` bits of every key's word ``i``. Twice over, each is changed by what the others say,
    which the same steps in reverse order take back."""
    parts = parts.copy()
    n = len(parts)
    steps = [(r, i) for r in range(2) for i in range(n)]
    for r, i in reversed(steps) if back else steps:
        said = np.full(parts.shape[1], (0x9E3779B97F4A7C15 * (r * n + i + 1)) % 2**64, np.uint64)
        for j in range(n):
            if j != i:
                said += parts[j] * np.uint64(0xD6E8FEB86659FD93 ** (j + 1) % 2**64)
        parts[i] ^= _mixed(said) >> np.uint64(64 - bits)
    return parts


def limbs(parts: np.ndarray, bits: int) -> np.ndarray:
    """The parts as one number of ``n * bits`` bits from the upper end of 64-bit limbs, highest first."""
    n, total = len(parts), len(parts) * bits
    out = np.zeros((-(-total // 64), parts.shape[1]), np.uint64)
    for i in range(n):
        at = i * bits
        k, shift = at // 64, 64 - bits - at % 64
        if shift >= 0:
            out[k] |= parts[i] << np.uint64(shift)
        else:
            out[k] |= parts[i] >> np.uint64(-shift)
            out[k + 1] |= parts[i] << np.uint64(64 + shift)
    return out


def parts_of(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """What ``limbs`` was made of."""
    mask = np.uint64((1 << bits) - 1)
    out = np.zeros((n, keys.shape[1]), np.uint64)
    for i in range(n):
        at = i * bits
        k, shift = at // 64, 64 - bits - at % 64
        out[i] = (keys[k] >> np.uint64(shift) if shift >= 0 else (keys[k] << np.uint64(-shift)) | (keys[k + 1] >> np.uint64(64 + shift))) & mask
    return out


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in rising order, their summed counts, and for each key given the place of its own."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    ranked = keys[:, order]
    new = np.r_[True, (ranked[:, 1:] != ranked[:, :-1]).any(0)][: ranked.shape[1]]
    first = np.flatnonzero(new)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[:, first], np.add.reduceat(counts[order], first) if len(first) else counts[:0], place


def filtered(keys: np.ndarray, counts: np.ndarray, skip: int, total: int) -> bytes:
    """Sorted keys and counts as a counting quotient filter. All keys have the same ``skip`` upper bits, which are left
    out; a key has ``total`` bits. There are about as many quotients as keys."""
    n = keys.shape[1]
    q = min(max(n - 1, 1).bit_length(), total - skip, 63 - skip)
    after = keys.copy()
    _shift(after, skip)
    quotients = (after[0] >> np.uint64(64 - q)).astype(np.int64) if q else np.zeros(n, np.int64)
    _shift(after, q)
    left = -(-(total - skip - q) // 8)
    planes = after.byteswap().view(np.uint8).reshape(len(after), n, 8).transpose(1, 0, 2).reshape(n, -1)[:, :left]
    used = np.bincount(quotients, minlength=1 << q)
    head = np.array([n, q], np.int64).tobytes()
    body = [pack(used.astype(np.uint64)), np.ascontiguousarray(planes.T).tobytes(), pack(counts.astype(np.uint64))]
    return head + b"".join(len(b).to_bytes(8, "little") + b for b in body)


def _shift(keys: np.ndarray, by: int) -> None:
    """Shifts whole keys up by fewer than 64 bits, in place."""
    if by:
        for k in range(len(keys)):
            keys[k] <<= np.uint64(by)
            if k + 1 < len(keys):
                keys[k] |= keys[k + 1] >> np.uint64(64 - by)


def _unshift(keys: np.ndarray, by: int, top: np.ndarray) -> None:
    """Shifts whole keys down by fewer than 64 bits and puts ``top`` in, in place."""
    if by:
        for k in range(len(keys) - 1, -1, -1):
            keys[k] >>= np.uint64(by)
            keys[k] |= keys[k - 1] << np.uint64(64 - by) if k else top << np.uint64(64 - by)


def opened(data: bytes, bucket: int, skip: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys, with the bucket's number in their ``skip`` upper bits, and counts of a filter."""
    n, q = np.frombuffer(data, np.int64, 2).tolist()
    at, body = 16, []
    for _ in range(3):
        size = int.from_bytes(data[at : at + 8], "little")
        body.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    left = -(-(total - skip - q) // 8)
    wide = -(-total // 64)
    raw = np.zeros((n, wide * 8), np.uint8)
    raw[:, :left] = np.frombuffer(body[1], np.uint8).reshape(left, n).T
    keys = np.ascontiguousarray(raw.reshape(n, wide, 8).transpose(1, 0, 2)).view(np.uint64).reshape(wide, n).byteswap()
    _unshift(keys, q, np.repeat(np.arange(1 << q), unpack(body[0]).astype(np.int64)).astype(np.uint64))
    _unshift(keys, skip, np.full(n, bucket, np.uint64))
    return keys, unpack(body[2]).astype(np.int64)


def shards(parts: np.ndarray, counts: np.ndarray, bits: int, deep: int) -> list[tuple[int, bytes]]:
    """The filter of the phrases with these words, cut into ranges of quotients for up to ``2 ** deep`` buckets:
    ``(bucket, filter)``."""
    keys, n, _ = added(limbs(permuted(parts, bits), bits), counts)
    total = len(parts) * bits
    skip = min(deep, total)
    of = (keys[0] >> np.uint64(64 - skip)).astype(np.int64) if skip else np.zeros(keys.shape[1], np.int64)
    at = np.searchsorted(of, np.arange((1 << skip) + 1))
    used = np.flatnonzero(at[1:] > at[:-1]).tolist()
    return [(b, filtered(keys[:, at[b] : at[b + 1]], n[at[b] : at[b + 1]], skip, total)) for b in used]


_KINDS = {"bucket": pa.int64(), "chunk": pa.int64(), "kind": pa.string(), "lang": pa.string(), "words": pa.binary(), "counts": pa.binary(), "n": pa.int64()}
_ASKED = "bucket bigint, chunk bigint, kind string, lang string, words binary, counts binary, n bigint"


def read(buckets: int):
    """From texts to numbers. For each chunk a row with the numbers of its words in order (``seq``; zero ends a piece),
    rows with its distinct words of a language and their counts for each bucket (``word``), and a row with the number of
    words of each language (``size``)."""

    def chunk_of(number: int, texts: dict[str, list[str]]) -> pa.RecordBatch:
        rows, sequences, known = [], [], 0
        for lang in sorted(texts):
            flat = [w for t in texts[lang] for w in words_of(t)]
            coded = pa.array(flat, pa.binary()).dictionary_encode()
            words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.bincount(index, minlength=len(words))
            # Words in the order in which buckets are asked for them.
            of = np.fromiter((xxhash.xxh64_intdigest(lang.encode() + b"\n" + w) % buckets for w in words), np.int64, len(words))
            of[[i for i, w in enumerate(words) if w == b"."]] = -1
            order = np.argsort(of, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            # The full stop is the first, and zero; the others go on from those of the languages before.
            number_of = np.where(rank == 0, 0, rank + known)
            sequences.append(number_of[index])
            at = np.searchsorted(of[order], np.arange(buckets + 1))
            for b in np.flatnonzero(at[1:] > at[:-1]).tolist():
                cut = order[at[b] : at[b + 1]]
                rows.append((b, number, "word", lang, zstandard.compress(b"\n".join(words[i] for i in cut.tolist()), 1), pack(counts[cut]), None))
            known += len(words) - 1
            rows.append((-1, number, "size", lang, None, None, int(counts.sum() - counts[order[0]])))
        rows.append((-1, number, "seq", None, None, pack(np.concatenate(sequences)), None))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS.values())], list(_KINDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, texts = TaskContext.get().partitionId() << 32, 0, {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text)
                size += len(text)
                if size >= CHUNK:
                    yield chunk_of(number, texts)
                    number, size, texts = number + 1, 0, {}
        if texts:
            yield chunk_of(number, texts)

    return run


def number_words(least: int, buckets: int):
    """Sums a bucket's words. ``reply``: to every chunk and language, the numbers of the words it asked about in that
    order, zero for rare ones. ``id``: a frequent word, its number and its count. Numbers of buckets interleave."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        words = [zstandard.decompress(w).split(b"\n") for w in rows["words"]]
        total: dict[tuple[str, bytes], int] = {}
        for lang, ws, counts in zip(rows["lang"], words, rows["counts"]):
            for w, c in zip(ws, unpack(counts).tolist()):
                total[lang, w] = total.get((lang, w), 0) + c
        frequent = sorted(k for k, c in total.items() if c >= least)
        number = {k: 1 + key[0] + i * buckets for i, k in enumerate(frequent)}
        out = [("id", -1, lang, number[lang, w], total[lang, w], w, None) for lang, w in frequent]
        for chunk, lang, ws in zip(rows["chunk"], rows["lang"], words):
            out.append(("reply", chunk, lang, key[0], 0, b"", pack(np.fromiter((number.get((lang, w), 0) for w in ws), np.int64, len(ws)))))
        return pd.DataFrame(out, columns=["kind", "chunk", "lang", "number", "n", "word", "numbers"])

    return run


_NUMBERED = "kind string, chunk bigint, lang string, number bigint, n bigint, word binary, numbers binary"
_SENT = "bucket bigint, chunk bigint, words int, data binary"


def _grams(seq: np.ndarray, good: np.ndarray, n: int) -> np.ndarray:
    """Places where ``n`` words begin all of whose neighbouring pairs are good."""
    ok = good[: len(seq) - n + 1].copy() if len(seq) >= n else good[:0]
    for i in range(1, n - 1):
        ok &= good[i : i + len(ok)]
    return np.flatnonzero(ok)


def _pairs(seq: np.ndarray) -> np.ndarray:
    return np.r_[(seq[1:] > 0) & (seq[:-1] > 0), False] if len(seq) else np.zeros(0, bool)


def _words(seq: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.stack([seq[at + i] for i in range(n)]).astype(np.uint64)


def _sent(number: int, seq: np.ndarray, good: np.ndarray, lengths: range, bits: int, deep: int) -> list[tuple]:
    """Rows ``(bucket, chunk, words, filter)`` of the phrases of these lengths."""
    rows = []
    for n in lengths:
        at = _grams(seq, good, n)
        if len(at):
            rows += [(b, number, n, data) for b, data in shards(_words(seq, at, n), np.ones(len(at), np.int64), bits, deep)]
    return rows


def renumber(bits: int, deep: int):
    """A chunk's words in numbers of the corpus (``words`` 0), and its filter of pairs."""

    def run(key: tuple, asked: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        replies = replies.sort_values(["lang", "number"])
        known = np.concatenate([np.zeros(1, np.int64)] + [unpack(x).astype(np.int64) for x in replies["numbers"]])
        seq = known[unpack(asked["counts"].iloc[0]).astype(np.int64)]
        rows = _sent(key[0], seq, _pairs(seq), range(2, 3), bits, deep)
        return pd.DataFrame([(-1, key[0], 0, pack(seq)), *rows], columns=["bucket", "chunk", "words", "data"])

    return run


def merge(least: int, bits: int, deep: int, reply: bool):
    """Merges a bucket's filters of one length of phrases. Frequent phrases: their numbers, packed, and counts. With
    ``reply``, to every chunk which of the phrases it sent are frequent, in that order."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bucket, n = int(key[0]), int(key[1])
        total = n * bits
        skip = min(deep, total)
        found = [opened(d, bucket, skip, total) for d in rows["data"]]
        keys, counts, place = added(np.concatenate([k for k, _ in found], 1), np.concatenate([c for _, c in found]))
        good = counts >= least
        parts = permuted(parts_of(keys[:, good], n, bits), bits, back=True)
        out = [(-1, bucket, n, pack(parts.ravel()), pack(counts[good]))] if good.any() else []
        if reply:
            bounds = np.cumsum([0] + [len(c) for _, c in found])
            for chunk, lo, hi in zip(rows["chunk"], bounds[:-1], bounds[1:]):
                out.append((int(chunk), bucket, n, zstandard.compress(np.packbits(good[place[lo:hi]]).tobytes(), 1), int(hi - lo).to_bytes(8, "little")))
        return pd.DataFrame(out, columns=["chunk", "bucket", "words", "data", "counts"])

    return run


_MERGED = "chunk bigint, bucket bigint, words int, data binary, counts binary"


def lengthen(bits: int, deep: int, longest: int):
    """A chunk's filters of the phrases of three words and more."""

    def run(key: tuple, seqs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        seq, rows = unpack(seqs["data"].iloc[0]).astype(np.int64), []
        if len(replies):
            replies = replies.sort_values("bucket")
            bits_of = [np.unpackbits(np.frombuffer(zstandard.decompress(d), np.uint8))[: int.from_bytes(n, "little")] for d, n in zip(replies["data"], replies["counts"])]
            # Replies are in the order of the keys that were sent.
            at = np.flatnonzero(_pairs(seq))
            _, _, place = added(limbs(permuted(_words(seq, at, 2), bits), bits), np.ones(len(at), np.int64))
            good = np.zeros(len(seq), bool)
            good[at] = np.concatenate(bits_of).astype(bool)[place]
            rows = _sent(key[0], seq, good, range(3, longest + 1), bits, deep)
        return pd.DataFrame(rows, columns=["bucket", "chunk", "words", "data"])

    return run


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``sizes(lang, n)``: words of each language; ``words(number, lang, word, n)``: the frequent ones; ``phrases(ids
    array<bigint>, n)``: frequent phrases of 1 to ``longest`` words by their words' numbers."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    # A power of two, so that a bucket is the upper bits of a key.
    deep = (max(shuffle_partitions(spark), -(-size // (2 * CHUNK))) - 1).bit_length()
    buckets = 1 << deep
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = written(given.mapInArrow(read(buckets), _ASKED), "phrases-asked")
    apart = lambda rows, *keys: rows.repartition(buckets, *keys).groupBy(*keys)
    numbered = written(apart(asked.where("kind = 'word'").select("bucket", "chunk", "lang", "words", "counts"), "bucket").applyInPandas(number_words(least, buckets), _NUMBERED), "phrases-words")
    words = numbered.where("kind = 'id'").select("number", "lang", F.col("word").cast("string").alias("word"), "n")
    bits = int(words.agg(F.max("number")).first()[0] or 1).bit_length()
    sequences = asked.where("kind = 'seq'").select("chunk", "counts")
    replies = numbered.where("kind = 'reply'").select("chunk", "lang", "number", "numbers")
    pairs = written(apart(sequences, "chunk").cogroup(apart(replies, "chunk")).applyInPandas(renumber(bits, deep), _SENT), "phrases-pairs")
    two = written(apart(pairs.where("words = 2"), "bucket", "words").applyInPandas(merge(least, bits, deep, True), _MERGED), "phrases-two")
    more = apart(pairs.where("words = 0"), "chunk").cogroup(apart(two.where("chunk >= 0"), "chunk")).applyInPandas(lengthen(bits, deep, longest), _SENT)
    rest = written(apart(written(more, "phrases-more"), "bucket", "words").applyInPandas(merge(least, bits, deep, False), _MERGED), "phrases-rest")

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, data, counts in zip(b["words"], b["data"], b["counts"]):
                yield pd.DataFrame({"ids": list(unpack(data).astype(np.int64).reshape(n, -1).T), "n": unpack(counts).astype(np.int64)})

    frequent = two.where("chunk < 0").union(rest).mapInPandas(unpacked, "ids array<bigint>, n bigint")
    sizes = asked.where("kind = 'size'").groupBy("lang").agg(F.sum("n").alias("n"))
    return sizes, words, words.select(F.array("number").alias("ids"), "n").union(frequent)


def score() -> Column:
    """``floor(1000 * a * n / (l * r))`` in decimals of 38 digits, which hold the products of any counts of ``a``, ``n``,
    ``l`` and ``r`` below 10**17."""
    return F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` candidates of each language.

    A candidate is a phrase of 2 to ``longest`` words met ``least`` times or more, with ``a`` its occurrences within
    pieces, overlaps included. Of the ways to cut it in two, with ``l`` and ``r`` occurrences of the parts, the lowest
    ``floor(1000 * a * n / (l * r))`` counts, and the earliest of equals; ``n`` are the language's words. One that lies
    within a longer candidate that is as frequent is dropped. Ranks go by score and ``a`` falling, then by the phrase.

    Null texts are empty, null languages ``und``; repeated rows count each. An empty table, and texts without words,
    give no rows. Ids are not needed, and other columns are ignored. Numbers are exact: products are 38-digit decimals.
    """
    sizes, words, phrases = counted(docs, least, longest, text_col, lang_col)
    phrases = written(phrases, "phrases-counted")
    cands = phrases.where(F.size("ids") > 1).withColumnRenamed("n", "a")
    # A longer candidate as frequent has all those between as frequent, so one word more is enough to look at.
    inner = lambda start: F.slice("ids", F.lit(start), F.size("ids") - 1)
    within = cands.where(F.size("ids") > 2).select(F.explode(F.array(inner(1), inner(2))).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer"))
    kept = cands.join(within, "ids", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).select("ids", "a")
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, F.size("ids"))})
    parted = cuts.join(phrases.select(F.col("ids").alias("left"), F.col("n").alias("l")), "left").join(phrases.select(F.col("ids").alias("right"), F.col("n").alias("r")), "right")
    lang = words.select(F.col("number").alias("first"), "lang")
    sized = parted.withColumn("first", F.get("ids", F.lit(0))).join(lang, "first").join(sizes, "lang")
    scored = sized.withColumn("score", score()).groupBy("ids", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    spelt = (
        scored.select("ids", F.posexplode("ids").alias("at", "number")).join(words.select("number", "word"), "number")
        .groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    rows = scored.join(spelt, "ids").select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of a language are among the first of its parts, so no task orders a language's candidates.
    part = rows.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = part.withColumn("__r", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("__r") <= top)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same by counting phrases as texts.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, [x for x in regexp_split_to_array(piece, '[ \t]+') if x <> ''] AS w FROM pieces),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang HAVING sum(len(w)) > 0),
g AS (SELECT lang, m, unnest([w[i : i + m - 1] for i in range(1, len(w) - m + 2)]) AS p
      FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, p, count(*) AS f FROM g GROUP BY lang, m, p HAVING count(*) >= 100),
longer AS (SELECT lang, p[i : i + k - 1] AS p, max(f) AS most FROM (
             SELECT lang, p, f, m, k, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM f WHERE m > 2))
           GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN longer USING (lang, p) WHERE m > 1 AND (most IS NULL OR 100 * most < 100 * f)),
cut AS (SELECT c.lang, c.m, c.p, c.f AS a, k FROM c, LATERAL (SELECT unnest(range(1, c.m)) AS k)),
s AS (SELECT cut.lang, cut.p, a, k, x.f AS l, y.f AS r, n,
             (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.p = cut.p[1 : k] JOIN f y ON y.lang = cut.lang AND y.p = cut.p[k + 1 :]
      JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n,
       CAST(score AS BIGINT) AS score
FROM ranked QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
"""
