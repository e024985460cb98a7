"""Language-model scores of texts by a probabilistic suffix tree over bytes, beside an add-one unigram base.

A text is read as its words in lower case (A-Z only), one blank between them, and an end symbol. Training counts all
contexts of up to ``DEPTH`` bytes with the byte that follows. Contexts met at least ``least`` times, a count that does
not change with the corpus, are candidates. A candidate becomes a state when its next-symbol distribution diverges from
that of its parent (the context one byte shorter) by more than a likelihood-ratio test allows. Distributions are smoothed towards
the parent's with as much weight as the context has distinct successors. A symbol is scored by the longest suffix of
what precedes it that is a state.

Counts are gathered by two-way messages: documents are dealt into chunks by a hash of their id; each chunk sends the
hashes of its distinct words with their training counts, and its distinct byte strings, in packed rows to buckets by
hash; buckets add them up and answer every chunk, in the order it asked, with the corpus counts of its words and the
scores of its byte strings. Strings are dealt by the last ``TOP + 1`` bytes of their context, so that a bucket has all
counts of the longer contexts in it and decides their states itself. Only contexts of up to ``TOP`` bytes are sent to all
buckets: strings of three bytes, of which there are at most 2**24 whatever the corpus (in valid UTF-8 a few million).
A word or string is met once for each chunk, however frequent it is. Words are told apart by 64-bit hashes: among 10**9 distinct words
about 0.03 pairs are expected to share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import bucket_of, pack, pack_sorted, slices, unpack, unpack_sorted
from .tables import shuffle_partitions, written

DEPTH = 5
#: Bytes of text in a chunk, and symbols looked at together within it.
CHUNK, BLOCK = 8 << 20, 1 << 21
#: Occurrences of a context below which the likelihood-ratio test says nothing.
LEAST = 10
#: Depth of the contexts that are sent to all buckets, and most buckets that add up their strings.
TOP, TOP_BUCKETS = 2, 64


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def grams(texts: list[list[bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts: ``(first text, codes, length of each text)``; a code packs ``DEPTH`` bytes and the
    symbol after them, the symbol lowest. Texts begin after zero bytes and end with one."""
    first = 0
    while first < len(texts):
        part, size, last = [], 0, first
        while last < len(texts) and (size < BLOCK or last == first):
            part.append(bytes(DEPTH) + b" ".join(texts[last]) + b"\0")
            size += len(part[-1])
            last += 1
        a = np.frombuffer(b"".join(part), np.uint8)
        code = np.zeros(len(a), np.uint64)
        for k in range(DEPTH + 1):
            code[k:] |= a[: len(a) - k].astype(np.uint64) << np.uint64(8 * k)
        lengths = np.array([len(p) for p in part])
        real = np.ones(len(a), bool)
        starts = np.cumsum(lengths) - lengths
        real[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
        yield first, code[real], lengths - DEPTH
        first = last


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = codes * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _mask(depth: int) -> np.uint64:
    return np.uint64((1 << (8 * depth + 8)) - 1)


def _dealt(codes: np.ndarray) -> np.ndarray:
    """What byte strings are dealt by: the last ``TOP + 1`` bytes of their contexts."""
    return _mixed((codes & _mask(TOP + 1)) >> np.uint64(8))


def _distinct(texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words in the order of their hashes, and these."""
    words = list({w for ws in texts for w in ws})
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    order = np.argsort(hashes)
    return [words[i] for i in order.tolist()], hashes[order]


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def ask(buckets: int):
    """What a chunk sends: rows ``(bucket, chunk, kind, keys, counts)``."""

    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        number = int(chunk["chunk"].iloc[0])
        texts = [words_of(t) for t in chunk["text"]]
        train = (~chunk["held_out"]).tolist()
        words, hashes = _distinct(texts)
        place = {w: i for i, w in enumerate(words)}
        used = [place[w] for ws, t in zip(texts, train) if t for w in ws]
        counts = np.bincount(np.array(used, np.int64), minlength=len(words)).astype(np.int64)
        rows = []
        numbers, at = slices(hashes, buckets)
        for b in numbers[at[1:] > at[:-1]].tolist():
            cut = slice(at[b], at[b + 1])
            rows.append((b, number, "word", pack_sorted(hashes[cut]), pack(counts[cut])))
        found = [np.unique(code, return_counts=True) for _, code, _ in grams([ws for ws, t in zip(texts, train) if t])]
        found += [(k, np.zeros(len(k), np.int64)) for k in (np.unique(code) for _, code, _ in grams([ws for ws, t in zip(texts, train) if not t]))]
        codes, n = _sum(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]).astype(np.int64))
        top, top_n = _sum(codes[n > 0] & _mask(TOP), n[n > 0])
        for kind, codes, n, mixed, most in (("gram", codes, n, _dealt(codes), buckets), ("top", top, top_n, _mixed(top), min(buckets, TOP_BUCKETS))):
            order = np.lexsort((codes, bucket_of(mixed, most)))
            codes, n = codes[order], n[order]
            numbers, at = slices(mixed[order], most)
            for b in numbers[at[1:] > at[:-1]].tolist():
                cut = slice(at[b], at[b + 1])
                rows.append((b, number, kind, pack_sorted(codes[cut]), pack(n[cut])))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "kind", "keys", "counts"])

    return run


def answer(bucket: pd.DataFrame) -> pd.DataFrame:
    """Rows ``(chunk, bucket, kind, keys, counts)``: an answer to every chunk that asked about words, the totals of
    the words (distinct with a count, all), and the bucket's short byte strings."""
    number, rows = int(bucket["bucket"].iloc[0]), []
    for kind, part in bucket.groupby("kind"):
        keys = [unpack_sorted(k) for k in part["keys"]]
        counts = np.concatenate([unpack(c) for c in part["counts"]]).astype(np.int64)
        known, total = _sum(np.concatenate(keys), counts)
        if kind == "top":
            rows.append((-1, number, "top", pack_sorted(known), pack(total)))
            continue
        for chunk, k in zip(part["chunk"], keys):
            rows.append((int(chunk), number, "reply", b"", pack(total[np.searchsorted(known, k)])))
        rows.append((-1, number, "total", b"", pack(np.array([(total > 0).sum(), total.sum()]))))
    return pd.DataFrame(rows, columns=["chunk", "bucket", "kind", "keys", "counts"])


def candidates(codes: np.ndarray, n: np.ndarray, depths: range, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth the sorted codes and counts of the contexts met ``least`` times or more; the root always is one."""
    levels = []
    for d in depths:
        k, c = _sum(codes & _mask(d), n)
        if d and len(k):
            _, back = np.unique(k >> np.uint64(8), return_inverse=True)
            keep = np.bincount(back, weights=c)[back] >= least
            k, c = k[keep], c[keep]
        levels.append((k, c))
    return levels


class Tree:
    """The model, or what a bucket has of it: for each depth sorted contexts with their state flag and the weight left to the parent, and sorted
    (context, symbol) pairs with log10 probabilities."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], top: Tree | None = None) -> None:
        """``levels[d]``: sorted codes of ``d`` context bytes and a symbol, and their counts; all candidates. With
        ``top`` they go on below it."""
        if top is None:
            (codes, n), *levels = levels
            root = np.ones(256)
            root[codes.astype(np.int64)] += n
            self.contexts = [np.zeros(1, np.uint64)]
            self.state, self.left = [np.ones(1, bool)], [np.zeros(1)]
            self.pairs, self.logs = [np.arange(256, dtype=np.uint64)], [np.log10(root / root.sum())]
        else:
            self.contexts, self.state, self.left, self.pairs, self.logs = (list(x) for x in (top.contexts, top.state, top.left, top.pairs, top.logs))
        for d, (codes, n) in enumerate(levels, len(self.contexts)):
            of = codes >> np.uint64(8)
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
            size = np.diff(np.r_[first, len(of)])
            total = np.add.reduceat(n, first) if len(first) else n[:0]
            parent = 10.0 ** self._at(d - 1, codes & np.uint64((1 << (8 * d)) - 1))
            share = n / np.repeat(total, size)
            ratio = 2 * np.add.reduceat(n * np.log(share / parent), first) if len(first) else np.zeros(0)
            smooth = (n + np.repeat(size, size) * parent) / np.repeat(total + size, size)
            self.contexts.append(of[first])
            # The statistic is near chi-squared with a degree of freedom a symbol; three deviations above its mean.
            self.state.append(ratio > size + 3 * np.sqrt(2 * size))
            self.left.append(np.log10(size / (total + size)) if len(first) else np.zeros(0))
            self.pairs.append(codes)
            self.logs.append(np.log10(smooth))

    def _at(self, depth: int, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each code's symbol after its ``depth`` context bytes, all of them candidates."""
        out, todo = np.zeros(len(codes)), np.arange(len(codes))
        for d in range(depth, -1, -1):
            want = codes[todo] & np.uint64((1 << (8 * d + 8)) - 1)
            i = np.minimum(np.searchsorted(self.pairs[d], want), max(len(self.pairs[d]) - 1, 0))
            hit = self.pairs[d][i] == want if len(self.pairs[d]) else np.zeros(len(want), bool)
            out[todo[hit]] += self.logs[d][i[hit]]
            todo, want = todo[~hit], want[~hit]
            if not len(todo):
                break
            out[todo] += self.left[d][np.searchsorted(self.contexts[d], want >> np.uint64(8))]
        return out

    def score(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol of each code after its longest suffix that is a state."""
        depth = np.zeros(len(codes), np.int64)
        for d in range(1, len(self.contexts)):
            if len(self.contexts[d]):
                want = (codes >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)
                i = np.minimum(np.searchsorted(self.contexts[d], want), len(self.contexts[d]) - 1)
                depth[(self.contexts[d][i] == want) & self.state[d][i]] = d
        out = np.zeros(len(codes))
        for d in range(len(self.contexts)):
            at = np.flatnonzero(depth == d)
            if len(at):
                out[at] = self._at(d, codes[at])
        return out


def weigh(top, least: int):
    """What a bucket answers every chunk that asked about byte strings: their scores, in the order asked."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        number = int(bucket["bucket"].iloc[0])
        keys = [unpack_sorted(k) for k in bucket["keys"]]
        known, total = _sum(np.concatenate(keys), np.concatenate([unpack(c) for c in bucket["counts"]]).astype(np.int64))
        seen = total > 0
        logs = Tree(candidates(known[seen], total[seen], range(TOP + 1, DEPTH + 1), least), top.value).score(known)
        rows = [(int(chunk), number, "log", pack(logs[np.searchsorted(known, k)].view(np.uint64))) for chunk, k in zip(bucket["chunk"], keys)]
        return pd.DataFrame(rows, columns=["chunk", "bucket", "kind", "counts"])

    return run


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    Rows where ``held_out`` is not true train. Null, empty and blank texts are a lone end token. Repeated rows count
    and are scored each on its own; a null id is allowed; an empty table gives an empty one. Without training rows
    all counts are zero. A NUL byte in a text counts as an end within it. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = max(shuffle_partitions(spark), -(-size // CHUNK))
    dealt = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    # A long document fills a chunk by itself. Different texts of one id, and null ids, are dealt apart by the text.
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))
    # As many partitions as chunks and buckets, so that a task has one or two of them whatever the corpus.
    apart = lambda rows, key: rows.repartition(chunks, key).groupBy(key)
    asked = written(apart(dealt, "chunk").applyInPandas(ask(chunks), "bucket int, chunk int, kind string, keys binary, counts binary"), "tree-asked")
    table = written(
        apart(asked.where("kind != 'gram'"), "bucket").applyInPandas(answer, "chunk int, bucket int, kind string, keys binary, counts binary"), "tree-messages"
    )
    ends = dealt.where("NOT held_out").count()
    totals = [unpack(r["counts"]) for r in table.where("kind = 'total'").select("counts").toLocalIterator()]
    distinct, tokens = (int(sum(t[i] for t in totals)) for i in (0, 1))
    distinct, tokens = distinct + (ends > 0), tokens + ends
    short = [(unpack_sorted(r["keys"]), unpack(r["counts"]).astype(np.int64)) for r in table.where("kind = 'top'").select("keys", "counts").toLocalIterator()]
    codes, n = (np.concatenate(x) for x in zip(*short)) if short else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    top = spark.sparkContext.broadcast(Tree(candidates(codes, n, range(TOP + 1), least)))
    weighed = apart(asked.where("kind = 'gram'"), "bucket").applyInPandas(weigh(top, least), "chunk int, bucket int, kind string, counts binary")

    def finish(chunk: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        texts = [words_of(t) for t in chunk["text"]]
        words, _ = _distinct(texts)
        replies = replies.sort_values("bucket")
        counts = np.concatenate([unpack(c).astype(np.int64) for c in replies["counts"][replies["kind"] == "reply"]] + [np.array([ends])])
        place = {w: i for i, w in enumerate(words)}
        logs, known = np.log10((counts + 1) / (tokens + 1 * (distinct + 1))), (counts > 0).astype(np.int64)
        n, n_known, base = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for j, ws in enumerate(texts):
            at = np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))
            n[j], n_known[j], base[j] = len(ws) + 1, known[at].sum() + known[-1], logs[at].sum() + logs[-1]
        score = np.zeros(len(texts))
        blocks = [(first, *np.unique(code, return_inverse=True), lengths) for first, code, lengths in grams(texts)]
        codes = np.unique(np.concatenate([b[1] for b in blocks]))
        log = np.empty(len(codes))
        log[np.lexsort((codes, bucket_of(_dealt(codes), chunks)))] = np.concatenate([unpack(c).view(np.float64) for c in replies["counts"][replies["kind"] == "log"]])
        for first, distinct_codes, back, lengths in blocks:
            each = log[np.searchsorted(codes, distinct_codes)][back]
            score[first : first + len(lengths)] = np.add.reduceat(each, np.cumsum(lengths) - lengths)
        return pd.DataFrame(
            {"id": chunk["id"], "held_out": chunk["held_out"], "n_tokens": n, "n_known": n_known, "train_tokens": np.int64(tokens), "base_score": base, "score": score}
        )

    replies = table.where("kind = 'reply'").select("chunk", "bucket", "kind", "counts").union(written(weighed, "tree-scores"))
    return apart(dealt, "chunk").cogroup(apart(replies, "chunk")).applyInPandas(
        finish, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    ).withColumnRenamed("id", id_col)
