"""Removal of byte strings that a document with a smaller id has too, by bounded interval expansion on a BWT.

A string of ``MIN`` bytes is judged by the smallest id of the documents it occurs in. Where an equal string is looked
for is decided by its anchor: the smallest hash of the ``GRAM``-byte strings in it, which equal strings share at the
same place. Documents are dealt into chunks by a hash of their id; the work goes in three exchanges of packed rows:

1. Chunks send the hashes of their distinct anchors; buckets answer which ones other documents have as well, and
   which have more than ``WIDE`` occurrences. Exact copies of whole documents were sorted out before, by their digests.
   With each anchor goes a digest of the byte run it stands for (its windows' strings, overlapping). Anchors whose
   runs are all one run match as a whole: for them only ids are exchanged, and the smallest comes back.
2. For each other repeated anchor a chunk sends the bytes of its runs, equal ones once with the places of
   all. The buckets concatenate the different byte runs, build their Burrows-Wheeler transform (sorted to ``DEPTH``
   bytes) and expand intervals breadth-first by backward extension: strings of growing length settle the common
   prefixes of neighbours by increasing value, and the expansion stops at ``MIN``. Neighbours that are not settled
   then share ``MIN`` bytes or more, so the classes of equal strings lie between settled bounds.
   Anchors of very many runs (a passage that a third of all documents hold) go another way, so that no bucket gathers them:
   the chunk expands its own runs, and sends for each class the 128-bit hash of its string and its smallest id;
   buckets by that hash answer with the smallest id of all.
3. The answers meet the chunks' documents, and the covered bytes are cut out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import pack, pack_sorted, slices, unpack, unpack_sorted
from .tables import shuffle_partitions, written

MIN, GRAM, DEPTH = 50, 16, 64
SIDE = (MIN - GRAM) // 2
#: Bytes of text in a chunk. A longer document is a chunk of its own.
CHUNK = 3 << 20
#: Bytes whose hashes are in memory together, some 60 bytes for each.
BLOCK = 1 << 19
#: An anchor with different runs and more occurrences than this has its strings compared by class.
WIDE = 1000
#: Random values of the bytes, an odd multiplier and its inverse, for digests of runs from prefix sums.
VALUE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
PLACE = np.uint64((1 << 24) - 1)
NO_ID = np.iinfo(np.int64).max


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_hashes(a: np.ndarray, size: int, seed: int) -> np.ndarray:
    """64-bit hashes of all ``size``-byte strings of ``a``, by joining those of half the length."""
    join = lambda x, y, s: mix(x[: len(y)] * np.uint64(0x9E3779B97F4A7C15) + y + np.uint64(s))
    power, at, out, done = mix(a.astype(np.uint64) + np.uint64(seed)), 1, None, 0
    while True:
        if size & at:
            out = power if out is None else join(out, power[done:], seed + done)
            done += at
        if done == size:
            return out
        power, at = join(power, power[at:], at), 2 * at


def run_digests(a: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit digests of the byte runs ``a[first : first + size]``, which depend on their bytes alone."""
    if len(POWERS[0]) <= len(a):
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                POWERS[i] = np.cumprod(np.r_[np.uint64(1), np.full(len(a) + BLOCK // 4, base, np.uint64)])
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(VALUE[a] * POWERS[0][: len(a)], out=total[1:])
    return mix((total[first + size] - total[first]) * POWERS[1][first] + size.astype(np.uint64))


class Chunk:
    """The documents of a chunk as one byte string, its windows of ``MIN`` bytes and their anchors."""

    def __init__(self, rows: pd.DataFrame, copies: set[tuple[int, int]]) -> None:
        self.rows = rows
        raw = [t.encode() for t in rows["text"]]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        null = rows["id"].isna().to_numpy()
        self.ids = rows["id"].fillna(NO_ID).to_numpy(np.int64)
        self.copy = np.fromiter(((i, t) in copies for i, t in zip(self.ids.tolist(), rows["th"].tolist())), bool, len(rows))
        use = ~(self.copy | null) & (self.size >= MIN)
        # Blocks of whole documents bound the memory; positions in a block fit the low bits of a key.
        parts, block, held = [], [], 0
        for j in np.flatnonzero(use).tolist():
            for lo in range(0, int(self.size[j]), BLOCK):
                # A very long document is looked at in overlapping stretches, which see every window once.
                hi = min(int(self.size[j]), lo + BLOCK + MIN - 1)
                if hi - lo < MIN:
                    continue
                if held and held + hi - lo > BLOCK + MIN:
                    parts.append(self._anchors(block))
                    block, held = [], 0
                block.append((int(self.start[j]) + lo, hi - lo))
                held += hi - lo
        if block:
            parts.append(self._anchors(block))
        none = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
        first, n, place, h, self.digest = (np.concatenate(x) for x in zip(none, *parts))
        self._groups = first, n, place, h, np.searchsorted(self.start, first, side="right") - 1

    def _anchors(self, block: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
        """Runs of windows with one anchor: ``(first window, windows, anchor's place in the first, hash, digest)``."""
        a = np.concatenate([self.bytes[s : s + n] for s, n in block])
        h = window_hashes(a, GRAM, 7)
        low = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        span, at = MIN - GRAM + 1, 1
        while 2 * at <= span:
            low, at = np.minimum(low[:-at], low[at:]), 2 * at
        low = np.minimum(low[: len(low) - (span - at)], low[span - at :])
        sizes = np.array([n for _, n in block])
        begin = np.cumsum(sizes) - sizes
        ok = np.concatenate([np.arange(b, b + n - MIN + 1) for b, n in zip(begin.tolist(), sizes.tolist())])
        anchor = (low[ok] & PLACE).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1] + 1)])
        first = ok[new]
        shift = (np.array([s for s, _ in block]) - begin)[np.searchsorted(begin, first, side="right") - 1]
        n, place = np.diff(np.r_[new, len(ok)]), anchor[new] - first
        digest = mix(run_digests(a, first, n + MIN - 1) + place.astype(np.uint64))
        # Anchors are minima, so their hashes are small ones; mixed again they spread over the buckets.
        return first + shift, n, place, mix(h[anchor[new]] * np.uint64(BASE)) >> np.uint64(16), digest

    def groups(self) -> tuple[np.ndarray, ...]:
        """Runs of windows with one anchor: ``(first window, windows, anchor's place in the first, hash, document)``."""
        return self._groups

    def distinct(self) -> tuple[np.ndarray, ...]:
        """Distinct anchor hashes, whether several documents of the chunk have each, a 63-bit digest of its run (zero
        where it has several), and its occurrences."""
        _, _, _, h, doc = self.groups()
        order = np.lexsort((self.digest, h))
        h, ids, digest = h[order], self.ids[doc[order]], self.digest[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        end = np.r_[at[1:], len(h)] - 1
        if not len(at):
            return h, np.zeros(0, bool), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        several = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
        one = digest[at] == digest[end]
        return h[at], several, np.where(one, digest[at] | np.uint64(1), np.uint64(0)), end - at + 1


def classes(text: np.ndarray, least: int = MIN) -> np.ndarray:
    """Numbers of the classes of equal ``least``-byte strings, for each place of the cyclic ``text``."""
    n = len(text)
    rank = np.zeros(n, np.uint64)
    for k in range(8):
        rank = (rank << np.uint64(8)) | np.roll(text, -k).astype(np.uint64)
    depth = 8
    while True:
        order = np.argsort(rank)
        if depth >= least:
            break
        sorted_rank = rank[order]
        dense = np.empty(n, np.uint64)
        dense[order] = np.cumsum(np.r_[False, sorted_rank[1:] != sorted_rank[:-1]]).astype(np.uint64)
        rank = (dense << np.uint64(32)) | np.roll(dense, -depth)
        depth *= 2
    before = np.roll(text, 1)[order]
    by_char = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)
    step[by_char] = np.arange(n)
    char = before[by_char]
    settled = np.zeros(n + 1, bool)
    settled[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    mark = np.full(n, -1, np.int64)
    for _ in range(least):
        size = high - low
        of = np.repeat(np.arange(len(low)), size)
        place = step[np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)]
        # Backward extension: places of one interval and character follow each other.
        if 16 * len(place) > n:
            mark[place] = of
            place = np.flatnonzero(mark >= 0)
            of = mark[place]
            mark[place] = -1
        else:
            by = np.argsort(place)
            place, of = place[by], of[by]
        cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1] + 1) | (of[1:] != of[:-1]) | (char[place[1:]] != char[place[:-1]])])
        low, high = place[cut], place[np.r_[cut[1:], len(place)] - 1] + 1
        new = ~settled[high]
        # The first interval is extended whole; its last part ends where the text ends, which is settled already.
        new |= high == n
        settled[high] = True
        low, high = low[new], high[new]
        if not len(low):
            break
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(settled[:n]) - 1
    return out


def smallest(runs: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of all ``runs``, in order: class, place in the joined text, smallest of ``ids`` in the class."""
    size = np.array([len(r) for r in runs], np.int64)
    start = np.cumsum(size + 1) - size - 1
    text = np.frombuffer(b"\0".join(runs) + bytes(DEPTH), np.uint8)
    n = size - MIN + 1
    at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
    of = classes(text)[at]
    least = np.full(of.max() + 1, NO_ID)
    np.minimum.at(least, of, np.repeat(ids, n))
    return of, at, least[of]


def _partnered(keys: list[tuple[int, int, bytes]]) -> np.ndarray:
    """Which runs ``(anchor, place, bytes)`` can share a string with another: around the anchor they agree on ``SIDE``
    bytes more to the left or to the right, as any string of ``MIN`` bytes through it has as many on one side."""
    left = [k[2][k[1] - SIDE : k[1] + GRAM] if k[1] >= SIDE else None for k in keys]
    right = [k[2][k[1] : k[1] + GRAM + SIDE] for k in keys]
    lefts, rights = Counter(left), Counter(right)
    return np.array([(x is not None and lefts[x] > 1) or rights[y] > 1 for x, y in zip(left, right)], bool)


def _bounds(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive sorted numbers: first, length."""
    cut = np.flatnonzero(np.r_[True, places[1:] != places[:-1] + 1]) if len(places) else np.zeros(0, np.int64)
    return places[cut], np.diff(np.r_[cut, len(places)])


def _chunk(rows: pd.DataFrame, more: pd.DataFrame) -> tuple[int, Chunk, dict[str, pd.DataFrame]]:
    kinds = dict(tuple(more.groupby("kind")))
    copies = kinds.get("copy")
    known = set() if copies is None else set(zip(copies["bucket"].tolist(), copies["th"].tolist()))
    rows = rows.sort_values(["id", "text"], kind="stable").reset_index(drop=True)
    return int(rows["chunk"].iloc[0]), Chunk(rows, known), kinds


MESSAGE = "chunk int, bucket bigint, th bigint, kind string, a binary, b binary, c binary, d binary, e binary"
COLUMNS = ["chunk", "bucket", "th", "kind", "a", "b", "c", "d", "e"]


def _message(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(c, b, 0, k, *x, *[b""] * (5 - len(x))) for c, b, k, *x in rows], columns=COLUMNS)


def _repeated(chunk: Chunk, answers: pd.DataFrame | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which groups have a repeated anchor, and how it is handled: 0 by bytes, 1 by id, 2 by class."""
    _, _, _, h, _ = chunk.groups()
    if answers is None or not len(h):
        none = np.zeros(0, np.int64)
        return none, none
    known = chunk.distinct()[0]
    code = np.zeros(len(known), np.uint8)
    _, at = slices(known << np.uint64(16), buckets)
    for b, a in zip(answers["bucket"].tolist(), answers["a"]):
        code[at[b] : at[b + 1]] = unpack(a).astype(np.uint8)
    found = code[np.searchsorted(known, h)]
    keep = np.flatnonzero(found)
    return keep, found[keep].astype(np.int64) - 1


def _ask(buckets: int) -> Callable:
    def run(rows: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return _message([])
        number, chunk, _ = _chunk(rows, more)
        h, several, digest, count = chunk.distinct()
        numbers, at = slices(h << np.uint64(16), buckets)
        out = []
        for b in numbers[at[1:] > at[:-1]].tolist():
            cut = slice(at[b], at[b + 1])
            out.append((number, b, "anchors", pack_sorted(h[cut]), pack(digest[cut]), pack(count[cut] * 2 + several[cut])))
        return _message(out)

    return run


def _answer(most: int, bucket: pd.DataFrame) -> pd.DataFrame:
    keys = [unpack_sorted(a) for a in bucket["a"]]
    digest = np.concatenate([unpack(b) for b in bucket["b"]])
    count = np.concatenate([unpack(c).astype(np.int64) for c in bucket["c"]])
    known, back, chunks = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    again = chunks > 1
    again[back[count & 1 > 0]] = True
    low, high = np.full(len(known), ~np.uint64(0)), np.zeros(len(known), np.uint64)
    np.minimum.at(low, back, digest)
    np.maximum.at(high, back, digest)
    total = np.bincount(back, count >> 1, len(known))
    code = np.where(~again, 0, np.where((low == high) & (low > 0), 2, np.where(total > most, 3, 1)))
    rows, at = [], 0
    for chunk, b, k in zip(bucket["chunk"].tolist(), bucket["bucket"].tolist(), keys):
        mine = code[back[at : at + len(k)]]
        at += len(k)
        if mine.any():
            rows.append((chunk, b, "repeats", pack(mine)))
    return _message(rows)


def _same(chunk: Chunk, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For groups whose anchors stand for one run: distinct hashes, their digests, smallest ids, and each group's."""
    _, _, _, h, doc = (x[groups] for x in chunk.groups())
    known, lead, back = np.unique(h, return_index=True, return_inverse=True)
    low = np.full(len(known), NO_ID)
    np.minimum.at(low, back, chunk.ids[doc])
    return known, chunk.digest[groups][lead], low, back


def _wide(chunk: Chunk, groups: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The different runs of groups whose anchors are very frequent, the smallest id of each, each group's run, and
    the two hashes of every window of every run."""
    first, n, _, _, doc = (x[groups] for x in chunk.groups())
    whole, held = chunk.bytes.tobytes(), {}
    of = np.array([held.setdefault(whole[f : f + m + MIN - 1], len(held)) for f, m in zip(first.tolist(), n.tolist())], np.int64)
    low = np.full(len(held), NO_ID)
    np.minimum.at(low, of, chunk.ids[doc])
    runs = list(held)
    size = np.array([len(r) for r in runs], np.int64)
    n = size - MIN + 1
    at = np.arange(n.sum()) + np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n), n)
    joined = np.frombuffer(b"".join(runs), np.uint8)
    return runs, low, of, np.stack([window_hashes(joined, MIN, seed)[at] for seed in (11, 13)], 1)


def _first_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, the first row of each, and the pair of each row."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    s = keys[order]
    new = np.r_[True, (s[1:] != s[:-1]).any(1)] if len(s) else np.zeros(0, bool)
    back = np.empty(len(s), np.int64)
    back[order] = np.cumsum(new) - 1
    return s[new], order[new], back


def _send(buckets: int) -> Callable:
    def run(rows: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return _message([])
        number, chunk, kinds = _chunk(rows, more)
        groups, way = _repeated(chunk, kinds.get("repeats"), buckets)
        out = []
        if (way == 1).any():
            h, digest, low, _ = _same(chunk, groups[way == 1])
            numbers, at = slices(h << np.uint64(16), buckets)
            for b in numbers[at[1:] > at[:-1]].tolist():
                cut = slice(at[b], at[b + 1])
                out.append((number, b, "same", pack_sorted(h[cut]), pack(digest[cut]), pack(low[cut].view(np.uint64))))
        if (way == 2).any():
            # The chunk's own classes, each once: the hash of its string and its smallest id.
            runs, low, _, keys = _wide(chunk, groups[way == 2])
            _, _, least = smallest(runs, low)
            keys, row, _ = _first_keys(keys)
            numbers, cut = slices(keys[:, 0], buckets)
            for b in numbers[cut[1:] > cut[:-1]].tolist():
                part = slice(cut[b], cut[b + 1])
                out.append((number, b, "wide", pack_sorted(keys[part, 0]), pack(keys[part, 1]), pack(least[row[part]].view(np.uint64))))
        first, n, place, h, doc = (x[groups[way == 0]] for x in chunk.groups())
        if len(first):
            whole = chunk.bytes.tobytes()
            of = slices(h << np.uint64(16), buckets, sort=True)
            for b in range(buckets):
                part = of[1][of[0][b] : of[0][b + 1]]
                if not len(part):
                    continue
                runs: dict[tuple, list[int]] = {}
                for g in part.tolist():
                    runs.setdefault((int(h[g]), int(place[g]), whole[first[g] : first[g] + n[g] + MIN - 1]), []).append(g)
                every = np.array([g for gs in runs.values() for g in gs])
                out.append(
                    (number, b, "runs",
                     pack(np.array([[k[0], k[1], len(k[2]), len(gs)] for k, gs in runs.items()], np.uint64).T.ravel()),
                     squeezed(b"".join(k[2] for k in runs)), pack(first[every]), pack(chunk.ids[doc[every]].view(np.uint64)))
                )
        return _message(out)

    return run


def squeezed(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def _match(bucket: pd.DataFrame) -> pd.DataFrame:
    kinds, out = dict(tuple(bucket.groupby("kind"))), []
    number = int(bucket["bucket"].iloc[0])
    if "wide" in kinds:
        part = kinds["wide"]
        each = [np.stack([unpack_sorted(a), unpack(b)], 1) for a, b in zip(part["a"], part["b"])]
        least = np.concatenate([unpack(c) for c in part["c"]]).view(np.int64)
        known, _, back = _first_keys(np.concatenate(each))
        low = np.full(len(known), NO_ID)
        np.minimum.at(low, back, least)
        at = 0
        for chunk, k in zip(part["chunk"].tolist(), each):
            out.append((chunk, number, "least", pack(low[back[at : at + len(k)]].view(np.uint64))))
            at += len(k)
    if "same" in kinds:
        part = kinds["same"]
        each = [np.stack([unpack_sorted(a), unpack(b)], 1) for a, b in zip(part["a"], part["b"])]
        known, _, back = _first_keys(np.concatenate(each))
        low = np.full(len(known), NO_ID)
        np.minimum.at(low, back, np.concatenate([unpack(c) for c in part["c"]]).view(np.int64))
        at = 0
        for chunk, k in zip(part["chunk"].tolist(), each):
            out.append((chunk, number, "one", pack(low[back[at : at + len(k)]].view(np.uint64))))
            at += len(k)
    if "runs" in kinds:
        out += _runs(kinds["runs"], number)
    return _message(out)


def _runs(part: pd.DataFrame, number: int) -> list[tuple]:
    names: dict[tuple, int] = {}
    first, ids, chunks, of = [], [], [], []
    for chunk, a, b, c, d in zip(part["chunk"].tolist(), part["a"], part["b"], part["c"], part["d"]):
        h, place, size, n = unpack(a).astype(np.int64).reshape(4, -1)
        data, end = zstandard.decompress(b), np.cumsum(size)
        mine = [names.setdefault((x, p, data[e - s : e]), len(names)) for x, p, s, e in zip(h.tolist(), place.tolist(), size.tolist(), end.tolist())]
        of.append(np.repeat(np.array(mine), n))
        first.append(unpack(c).astype(np.int64))
        ids.append(unpack(d).view(np.int64))
        chunks.append(np.full(int(n.sum()), chunk))
    of, first, ids, chunks = (np.concatenate(x) for x in (of, first, ids, chunks))
    low = np.full(len(names), NO_ID)
    np.minimum.at(low, of, ids)
    n = np.array([len(k[2]) - MIN + 1 for k in names])
    least = np.repeat(low, n)
    anchor = np.array([k[0] for k in names])
    _, back, alike = np.unique(anchor, return_inverse=True, return_counts=True)
    keys = list(names)
    mixed = _partnered(keys) & (alike[back] > 1)
    if mixed.any():
        _, _, found = smallest([k[2] for k, m in zip(keys, mixed.tolist()) if m], low[mixed])
        least[np.repeat(mixed, n)] = found
    # Each place of each run: its windows that a smaller document has.
    begin = np.cumsum(n) - n
    size = n[of]
    which = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    hit = least[np.repeat(begin[of], size) + which] < np.repeat(ids, size)
    window, chunk = (np.repeat(first, size) + which)[hit], np.repeat(chunks, size)[hit]
    order = np.lexsort((window, chunk))
    window, chunk = window[order], chunk[order]
    out = []
    for c in np.unique(chunk).tolist():
        lo, hi = np.searchsorted(chunk, [c, c + 1])
        start, length = _bounds(np.unique(window[lo:hi]))
        out.append((c, number, "covered", pack_sorted(start.astype(np.uint64)), pack(length)))
    return out


def _covered(chunk: Chunk, kinds: dict[str, pd.DataFrame], buckets: int) -> np.ndarray:
    """Which bytes of the chunk go."""
    edge = np.zeros(len(chunk.bytes) + 1, np.int32)
    if "covered" in kinds:
        for a, b in zip(kinds["covered"]["a"], kinds["covered"]["b"]):
            start, n = unpack_sorted(a).astype(np.int64), unpack(b).astype(np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + n + MIN - 1, -1)
    groups, way = _repeated(chunk, kinds.get("repeats"), buckets)
    answers = lambda kind: np.concatenate([unpack(a).view(np.int64) for a in kinds[kind].sort_values("bucket")["a"]])
    if (way == 1).any():
        mine = groups[way == 1]
        first, n, _, _, doc = (x[mine] for x in chunk.groups())
        gone = answers("one")[_same(chunk, mine)[3]] < chunk.ids[doc]
        np.add.at(edge, first[gone], 1)
        np.add.at(edge, (first + n + MIN - 1)[gone], -1)
    if (way == 2).any():
        mine = groups[way == 2]
        first, n, _, _, doc = (x[mine] for x in chunk.groups())
        runs, _, of, keys = _wide(chunk, mine)
        least = answers("least")[_first_keys(keys)[2]]
        size = np.array([len(r) - MIN + 1 for r in runs])
        begin = (np.cumsum(size) - size)[of]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = (np.repeat(first, n) + step)[least[np.repeat(begin, n) + step] < np.repeat(chunk.ids[doc], n)]
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + MIN, -1)
    out = np.cumsum(edge[:-1]) > 0
    for j in np.flatnonzero(chunk.copy & (chunk.size >= MIN)).tolist():
        out[chunk.start[j] : chunk.start[j] + chunk.size[j]] = True
    return out


def _digest(buckets: int) -> Callable:
    def run(rows: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not rows.empty:
            _, chunk, kinds = _chunk(rows, more)
            gone = _covered(chunk, kinds, buckets)
            for j, (s, n) in enumerate(zip(chunk.start.tolist(), chunk.size.tolist())):
                cut = gone[s : s + n]
                spans = int(np.count_nonzero(cut[1:] & ~cut[:-1]) + (n > 0 and cut[0]))
                kept = chunk.bytes[s : s + n][~cut].tobytes()
                out.append((chunk.rows["id"].iloc[j], n, n - len(kept), spans, hashlib.sha256(kept).hexdigest()))
        found = pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        return found.astype({"id": "Int64"})

    return run


def _texts(buckets: int, columns: list[str]) -> Callable:
    def run(rows: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return rows[columns]
        _, chunk, kinds = _chunk(rows, more)
        gone = _covered(chunk, kinds, buckets)
        # Characters of which only some bytes are covered stay whole.
        lead = np.flatnonzero((chunk.bytes & 0xC0) != 0x80)
        if len(lead):
            size = np.diff(np.r_[lead, len(chunk.bytes)])
            gone = np.repeat(np.logical_and.reduceat(gone, lead), size)
        texts = [chunk.bytes[s : s + n][~gone[s : s + n]].tobytes().decode() for s, n in zip(chunk.start.tolist(), chunk.size.tolist())]
        null = chunk.rows["null"].tolist()
        return chunk.rows.assign(text=[None if x else t for x, t in zip(null, texts)])[columns]

    return run


def _run(docs: DataFrame, id_col: str, text_col: str, extra: list[str], finish: Callable, schema: str, wide: int) -> DataFrame:
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(shuffle_partitions(spark), -(-size // CHUNK))
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.col(id_col).cast("bigint")
    key = F.xxhash64(text)
    chunk = F.pmod(F.xxhash64(ident, key), F.lit(n)).cast("int")

    def dealt(more: list) -> DataFrame:
        return docs.select(chunk.alias("chunk"), ident.alias("id"), key.alias("th"), text.alias("text"), *more)

    named = docs.where(F.col(id_col).isNotNull()).select(chunk.alias("chunk"), ident.alias("id"), key.alias("th"), F.sha2(text, 256).alias("sha"))
    firsts = named.groupBy("sha").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("sha", "low")
    copies = named.join(firsts, "sha").where("id > low").select("chunk", F.col("id").alias("bucket"), "th").distinct()
    none = [F.lit(b"").alias(c) for c in "abcde"]
    copies = written(copies.select("chunk", "bucket", "th", F.lit("copy").alias("kind"), *none), "suffix-copies")

    def meet(answers: DataFrame, function: Callable, schema: str, more: list | None = None) -> DataFrame:
        return dealt(more or []).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(function, schema)

    def by_bucket(messages: DataFrame, function: Callable) -> DataFrame:
        return messages.groupBy("bucket").applyInPandas(function, MESSAGE)

    repeats = written(by_bucket(meet(copies, _ask(n), MESSAGE), lambda bucket: _answer(wide, bucket)), "suffix-anchors")
    found = written(by_bucket(meet(copies.union(repeats), _send(n), MESSAGE), _match), "suffix-matches")
    return meet(copies.union(repeats).union(found), finish(n), schema, extra)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: int = WIDE) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row, in bytes of the UTF-8 text.

    Null text is empty. Texts of fewer than ``MIN`` bytes lose nothing. Rows with a null id match nothing and lose
    nothing. Rows with equal ids remove nothing from each other. Other columns are ignored.
    """
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return _run(docs, id_col, text_col, [], _digest, schema, wide).withColumnRenamed("id", id_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: int = WIDE) -> DataFrame:
    """``docs`` with the removed bytes cut out of ``text_col``; characters that are covered in part stay whole."""
    others = [c for c in docs.columns if c != text_col]
    extra = [F.col(text_col).isNull().alias("null")] + [F.col(c).alias(f"x{i}") for i, c in enumerate(others)]
    kept = ["text", *[f"x{i}" for i in range(len(others))]]
    schema = ", ".join(["text string", *[f"x{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others)]])
    found = _run(docs, id_col, text_col, extra, lambda n: _texts(n, kept), schema, wide)
    return found.select(*[F.col("text" if c == text_col else f"x{others.index(c)}").alias(c) for c in docs.columns])
