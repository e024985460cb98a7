"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents go from long to short in a few bands of length, as best fit wants it. A round takes the waiting documents of a
band and the gaps that are open: both are range-sorted by size over the cluster, and every partition sweeps its range
from small to large: a gap takes the nearest document below it, so each document gets its successor among the gaps. What
a partition can't match goes on to later ones: from the counts of documents and gaps left over in each partition (a few
numbers a partition, all that reaches the driver) follows which ranks meet, and these are joined. A gap that several of
the longest waiting documents would fill offers as many equal slots. Documents without a slot wait for the next round;
where no gap is met at all, new sequences are opened, no more than the waiting tokens need. Then gaps are updated.

Documents over half the capacity need a sequence each and get it at once. The last ``SMALL`` documents of a band, or
fewer, a number that does not grow with the corpus, are placed best fit by best fit in one task: rounds would cost more.

Equal lengths are told apart by item number in the range sort, so that a length that a third of all rows have is spread
like any other. Every round ends in written tables.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import discard, stored, written

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Bytes of words and ids that a Python worker remembers; beyond, it forgets all but the first met, the frequent ones.
KNOWN_BYTES = 12 << 20
#: Bytes of text looked at together.
BLOCK = 4 << 20
#: A lone full stop or comma at the end of a word, and what it becomes.
STOP = (r"([a-zA-Z])([.,])([ \t-\r])", r"\1 \2\3")
#: Lower edges of the bands of length, as shares of the capacity; lengths over a half come first, one a sequence.
BANDS = (2, 8, 64)
#: Documents of a band that are left to one task.
SMALL = 1000

#: Words whose letters neither normalizing nor the cut at ``PARTS`` changes, and how many go in one call.
PLAIN, JOINED = "^[a-zß-öø-ÿ]+$", 500
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: What the tokenizer takes for a special token wherever it stands; it separates the words of one call.
SPECIAL = "<|endoftext|>"
#: path -> WordIds. Python workers outlive their tasks, and what one task met the next one knows.
_KNOWN: dict[str, WordIds] = {}


def word_wise(config: dict) -> bool:
    """Whether a tokenizer's configuration lets a text be encoded word by word: it lower-cases, drops white space, and
    no token spans it; the special token that separates words is matched before anything else is done."""
    steps = (config.get("normalizer") or {}).get("normalizers") or []
    parts = (config.get("pre_tokenizer") or {}).get("pretokenizers") or []
    alone = [p for p in parts if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"] and "[^\\s" in p["pattern"].get("Regex", "")]
    kinds = [x["type"] for x in steps]
    special = any(t["content"] == SPECIAL and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in config.get("added_tokens", []))
    plain = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in steps)
    return plain and kinds[-1:] == ["Lowercase"] and bool(alone) and special and not config.get("post_processor") and not (config["model"].get("dropout"))


class WordIds:
    """Ids of whole texts. Where the tokenizer is ``word_wise`` each distinct word is encoded once, else each text.

    A full stop or comma that ends a word after an ASCII letter is a token of its own and is cut off. Texts that may hold
    special tokens keep their case. Columns of texts are cut into words, and words told apart and remembered, by Arrow.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        # Spark has a worker for each core; threads of a worker's own only add memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.by_word = word_wise(config)
        self.tokenizer = Tokenizer.from_file(path)
        self.end = self.tokenizer.token_to_id(SPECIAL)
        self.words, self.ids = pa.array([], pa.large_string()), np.zeros(0, "<u4")
        self.start = self.size = np.zeros(0, np.int64)
        self.plain, mark = None, config["model"].get("end_of_word_suffix")
        if self.by_word and mark and config["pre_tokenizer"]["pretokenizers"][1:] == [BYTES] and config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == PARTS:
            # The same model, without what leaves plain words as they are; ids that end a word tell words apart.
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[i for token, i in config["model"]["vocab"].items() if token.endswith(mark)]] = True

    @property
    def held(self) -> int:
        return self.words.nbytes + self.ids.nbytes + self.start.nbytes + self.size.nbytes

    def _encode(self, tokenizer: Tokenizer, words: pa.Array, between: str, closing: list[int]) -> np.ndarray:
        """Ids of the words, some hundred in a call; ``closing`` follows those of each call."""
        lists = pa.LargeListArray.from_arrays(np.r_[np.arange(0, len(words), JOINED), len(words)], words)
        found = [np.array(tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids + closing, "<u4") for t in pc.binary_join(lists, pa.scalar(between, pa.large_string())).to_pylist()]
        return np.concatenate([np.zeros(0, "<u4"), *found])

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and numbers of ids of words of ``PLAIN`` letters; None where they can't be told apart."""
        ids = self._encode(self.plain, words, "\n", [])
        at = np.flatnonzero(self.last[ids]) + 1
        return (ids, np.diff(at, prepend=0)) if len(at) == len(words) and (not len(at) or at[-1] == len(ids)) else None

    def _separated(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self._encode(self.tokenizer, words, SPECIAL, [self.end])
        at = np.flatnonzero(ids == self.end)
        return np.delete(ids, at), np.diff(at, prepend=-1) - 1

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Remembers new words; gives each one's place among those remembered."""
        odd = pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False) & (self.plain is not None)
        known = self._plain(words.filter(pa.array(plain))) if plain.any() else None
        if known is None:
            plain[:] = False
        rest = ~odd & ~plain
        parts = [known] if known is not None else []
        parts.append(self._separated(words.filter(pa.array(rest))))
        alone = [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4") for w in words.filter(pa.array(odd)).to_pylist()]
        parts.append((np.concatenate([np.zeros(0, "<u4"), *alone]), np.array([len(x) for x in alone], np.int64)))
        order = np.concatenate([np.flatnonzero(x) for x in (plain, rest, odd)])
        place = np.empty(len(words), np.int64)
        place[order] = len(self.words) + np.arange(len(words))
        size = np.concatenate([n for _, n in parts])
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.ids = np.concatenate([self.ids, *[x for x, _ in parts]])
        self.words = pa.concat_arrays([self.words, words.take(pa.array(order))])
        return place

    def _forget(self) -> None:
        n = len(self.words) // 2
        self.words = pa.concat_arrays([self.words[:n]])
        self.start, self.size = self.start[:n].copy(), self.size[:n].copy()
        self.ids = self.ids[: int(self.size.sum())].copy()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin and end; nulls have none."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            each = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([0, *map(len, each)])
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, *STOP))
        coded = cut.flatten().dictionary_encode()
        if self.held > KNOWN_BYTES:
            self._forget()
        place = pc.fill_null(pc.index_in(coded.dictionary, self.words), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = self._learn(coded.dictionary.take(pa.array(new)))
        which = place[coded.indices.to_numpy()]
        n = self.size[which]
        upto = np.cumsum(n)
        at = np.repeat(self.start[which] - (upto - n), n)
        at += np.arange(len(at))
        return self.ids[at], np.r_[0, upto][np.cumsum(np.r_[0, pc.list_value_length(cut).to_numpy()])]


def blocks(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes of text (``BLOCK`` unless given), a longer text by itself."""
    upto = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + (size or BLOCK), side="right")) - 1)
        yield at, min(to, len(texts))
        at = min(to, len(texts))


def encoder(path: str) -> WordIds:
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    return _KNOWN[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece int, start, length, ids_crc32)``: each text's ids and the end id, cut every ``capacity``."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            texts = b.column(1).cast(pa.large_string())
            for lo, hi in blocks(texts):
                ids, bounds = encode(texts[lo:hi])
                raw, rows = memoryview(ids.view(np.uint8)), []
                for i, (a, z) in enumerate(zip((4 * bounds[:-1]).tolist(), (4 * bounds[1:]).tolist()), lo):
                    n = (z - a) // 4 + 1
                    for start in range(0, n, capacity):
                        to = min(start + capacity, n)
                        crc = zlib.crc32(raw[a + 4 * start : min(a + 4 * to, z)])
                        rows.append((i, start // capacity, start, to - start, zlib.crc32(end, crc) if to == n else crc))
                which, *columns = (np.array(x) for x in zip(*rows))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(which)), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [id_col, "piece", "start", "length", "ids_crc32"]
                )
        # The worker outlives the task, and stages after this one need the memory.
        pa.default_memory_pool().release_unused()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def stack_match(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From flags in the order of size (False: a document, True: a gap): matched documents and their gaps, where each
    gap takes the nearest document before it that no gap between them takes; and the gaps and documents left over."""
    depth = np.cumsum(np.where(gap, -1, 1))
    lowest = np.minimum(0, np.minimum.accumulate(depth)) if len(gap) else depth
    alone = gap & (lowest < np.r_[0, lowest[:-1]])
    level = depth - lowest + gap
    use = np.flatnonzero(~alone)
    use = use[np.argsort(level[use], kind="stable")]
    pair = np.flatnonzero(~gap[use[:-1]] & gap[use[1:]] & (level[use[:-1]] == level[use[1:]]))
    docs, gaps = use[pair], use[pair + 1]
    waits = ~gap
    waits[docs] = False
    return docs, gaps, np.flatnonzero(alone), np.flatnonzero(waits)


SWEPT = "part int, is_gap boolean, id bigint, gap int, item bigint, length int, rank bigint"


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of the range sort (a few numbers a row, held whole): its gaps with the item and length they take, or
    without, and its waiting documents. Rank counts gaps left over from the smallest, documents from the longest."""
    held = [tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(4)) for b in batches]
    if not held:
        return
    size, is_gap, ids, gap = (np.concatenate(x) for x in zip(*held))
    docs, gaps, alone, waits = stack_match(is_gap.astype(bool))
    waits = waits[::-1]
    n, none = (len(gaps), len(alone), len(waits)), np.zeros(len(alone) + len(waits), np.int64)
    item = pa.array(np.r_[ids[docs], none], pa.int64(), mask=np.arange(sum(n)) >= n[0])
    columns = [
        pa.array(np.full(sum(n), TaskContext.get().partitionId()), pa.int32()), pa.array(np.arange(sum(n)) < n[0] + n[1]), pa.array(np.r_[ids[gaps], ids[alone], ids[waits]], pa.int64()),
        pa.array(np.r_[gap[gaps], gap[alone], gap[waits]], pa.int32()), item, pa.array(np.r_[size[docs], none[: n[1]], size[waits]], pa.int32()),
        pa.array(np.r_[np.full(n[0], -1), np.arange(n[1]), np.arange(n[2])], pa.int64()),
    ]
    for at in range(0, sum(n), 1 << 18):
        yield pa.RecordBatch.from_arrays([c.slice(at, 1 << 18) for c in columns], [x.split()[0] for x in SWEPT.split(", ")])


def meetings(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(first match number, documents' partition, first rank, gaps' partition, first rank, how many)`` from the
    partitions' ``(part, documents, gaps)`` left over: gaps take documents of the nearest partition before theirs."""
    waiting, out, number = [], [], 0
    for part, docs, gaps in sorted(left):
        rank = 0
        while gaps and waiting:
            of, first, n = waiting.pop()
            m = min(n, gaps)
            out.append((number, of, first, part, rank, m))
            number, rank, gaps = number + m, rank + m, gaps - m
            if n > m:
                waiting.append((of, first + m, n - m))
        if docs:
            waiting.append((part, 0, docs))
    return out


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """``items`` (with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Rows with equal values are packed each on its own; an empty table stays empty. Lengths outside the range are an
    error. Other columns may have any names but those beginning with two underscores.
    """
    spark = items.sparkSession
    items = written(items.withColumn("__item", F.monotonically_increasing_id()), "items")
    docs = items.select(F.col("length").cast("int").alias("length"), F.col("__item").alias("item"))
    if not docs.where(F.col("length").isNull() | ~F.col("length").between(1, capacity)).isEmpty():
        raise ValueError(f"lengths must be from 1 to {capacity}")
    half = capacity // 2 + 1
    # A sequence that such a document opens has its number; others have numbers below zero.
    alone = docs.where(F.col("length") >= half).select(
        F.lit(-1).alias("part"), F.lit(True).alias("is_gap"), F.col("item").alias("id"), F.lit(capacity).alias("gap"), "item", "length", F.lit(-1).cast("bigint").alias("rank")
    )
    placed, opened, high = [stored(alone, "sweep")], 0, half
    held = stored(spark.read.schema(SWEPT).parquet(placed[0]).select(F.col("id").alias("seq"), (F.col("gap") - F.col("length")).alias("gap")).where("gap > 0"), "gaps")

    def keep(now: DataFrame) -> None:
        nonlocal held
        before, held = held, stored(now, "gaps")
        discard(spark, before)

    for low in [*dict.fromkeys(max(1, capacity // b) for b in BANDS[1:]), 1]:
        waiting, high = docs.where((F.col("length") >= low) & (F.col("length") < high)), low
        while True:
            gaps = spark.read.schema("seq bigint, gap int").parquet(held)
            n, least, top, total, n_gaps, most = _sizes(waiting, gaps, low)
            if not n:
                break
            if n <= SMALL:
                placed.append(stored(_last(waiting, gaps, n, capacity, -1 - opened), "sweep"))
                opened += n
                keep(_updated(gaps, spark.read.schema(SWEPT).parquet(placed[-1])))
                break
            found = _round(waiting, gaps, least, top, 1 + 4 * n // n_gaps) if n_gaps and most >= least else None
            if found is None:
                need = -(-total // capacity)
                keep(gaps.union(spark.range(need).select((-1 - opened - F.col("id")).alias("seq"), F.lit(capacity).alias("gap"))))
                opened += need
                continue
            waiting, now = found[:2]
            placed += found[2]
            keep(now)
    discard(spark, held)
    taken = spark.read.schema(SWEPT).parquet(*placed).where("item IS NOT NULL")
    before = Window.partitionBy("id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    places = taken.select(F.col("item").alias("__item"), F.col("id").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return items.join(places, "__item").drop("__item")


def _sizes(waiting: DataFrame, gaps: DataFrame, low: int) -> tuple:
    """Documents: how many, the shortest, the longest, tokens; gaps of ``low`` and more: how many, the largest."""
    both = waiting.select("length", F.lit(None).cast("int").alias("gap")).union(gaps.where(F.col("gap") >= low).select(F.lit(None).cast("int"), "gap"))
    return tuple(both.agg(F.count("length"), F.min("length"), F.max("length"), F.sum("length"), F.count("gap"), F.max("gap")).first())


def _updated(gaps: DataFrame, taken: DataFrame) -> DataFrame:
    """``gaps`` less the lengths of what they took; sequences that were opened are among ``taken``."""
    rows = gaps.select(F.col("seq").alias("id"), "gap", F.lit(0).alias("length")).union(taken.select("id", "gap", "length"))
    return rows.groupBy(F.col("id").alias("seq")).agg((F.max("gap") - F.sum("length")).cast("int").alias("gap")).where("gap > 0")


def best_fits(lengths: list[tuple[int, int]], gaps: list[tuple[int, int]], capacity: int, number: int) -> list[tuple]:
    """``SWEPT`` rows of documents ``(length, item)`` in ``gaps(gap, seq)``, from the longest on each in the smallest gap
    that holds it; a document that none holds opens a sequence, numbered downwards from ``number``."""
    open_gaps, size, out = sorted(gaps), {seq: gap for gap, seq in gaps}, []
    for length, item in sorted(lengths, reverse=True):
        at = bisect_left(open_gaps, (length,))
        if at < len(open_gaps):
            gap, seq = open_gaps.pop(at)
        else:
            gap, seq, number = capacity, number, number - 1
            size[seq] = capacity
        out.append((-1, True, seq, size[seq], item, length, -1))
        if gap > length:
            insort(open_gaps, (gap - length, seq))
    return out


def _last(waiting: DataFrame, gaps: DataFrame, n: int, capacity: int, number: int) -> DataFrame:
    """``SWEPT`` rows of the last ``n`` documents of a band, placed in one task. Of gaps of one size ``n`` are enough."""
    first = F.row_number().over(Window.partitionBy("gap").orderBy("seq"))
    few = gaps.join(F.broadcast(waiting.agg(F.min("length").alias("least"))), F.col("gap") >= F.col("least")).withColumn("r", first).where(F.col("r") <= n)
    both = waiting.select(F.lit(False).alias("is_gap"), "length", F.col("item").alias("id")).union(few.select(F.lit(True), "gap", "seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        found = best_fits([r[1:] for r in rows if not r[0]], [r[1:] for r in rows if r[0]], capacity, number)
        kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], [x.split()[0] for x in SWEPT.split(", ")])

    return both.repartition(1).mapInArrow(run, SWEPT)


def _round(waiting: DataFrame, gaps: DataFrame, low: int, top: int, most: int) -> tuple[DataFrame, DataFrame, list[str]] | None:
    """The documents that still wait, the gaps as they are now, and paths of ``SWEPT`` tables of what was placed; None
    where nothing could be. Lengths are from ``low`` to ``top``; a gap offers ``most`` slots, so that there are never
    many more slots than documents."""
    spark = waiting.sparkSession
    count = F.greatest(F.least(F.floor(F.col("gap") / top), F.lit(most)), F.lit(1)).cast("int")
    slots = gaps.where(F.col("gap") >= low).withColumn("k", count).select(
        F.floor(F.col("gap") / F.col("k")).cast("int").alias("size"), F.lit(True).alias("is_gap"), F.col("seq").alias("id"), "gap", F.explode(F.sequence(F.lit(1), "k"))
    )
    both = waiting.select(F.col("length").alias("size"), F.lit(False).alias("is_gap"), F.col("item").alias("id"), F.lit(0).alias("gap")).union(slots.drop("col"))
    order = ["size", "is_gap", "id"]
    path = stored(both.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sweep, SWEPT), "sweep")
    swept = spark.read.schema(SWEPT).parquet(path)
    left = swept.groupBy("part").agg(
        F.count_if(~F.col("is_gap")), F.count_if(F.col("is_gap") & F.col("item").isNull()), F.count_if(F.col("item").isNotNull())
    ).collect()
    met = meetings([tuple(r)[:3] for r in left])
    if not met and not any(r[3] for r in left):
        return None
    still, places = swept.where("NOT is_gap"), [path]
    rows = swept.where("is_gap").select("id", "gap", "length")
    if met:
        # At most two rows for each partition.
        known = F.broadcast(spark.createDataFrame(met, "m bigint, part_d int, rank_d bigint, part_g int, rank_g bigint, n bigint"))
        reach = lambda x: (F.col("part") == F.col(f"part_{x}")) & (F.col("rank") >= F.col(f"rank_{x}")) & (F.col("rank") < F.col(f"rank_{x}") + F.col("n"))
        number = lambda x: (F.col("m") + F.col("rank") - F.col(f"rank_{x}")).alias("number")
        a = still.join(known, reach("d")).select(number("d"), F.col("id").alias("item"), "length")
        b = swept.where("is_gap AND item IS NULL").join(known, reach("g")).select(number("g"), "part", "is_gap", "id", "gap", "rank")
        places.append(stored(a.join(b, "number").select([x.split()[0] for x in SWEPT.split(", ")]), "sweep-on"))
        still = still.join(known, reach("d"), "left_anti")
        rows = rows.union(spark.read.schema(SWEPT).parquet(places[1]).select("id", "gap", "length"))
    now = rows.groupBy(F.col("id").alias("seq")).agg((F.max("gap") - F.sum("length")).cast("int").alias("gap")).where("gap > 0")
    return still.select("length", F.col("id").alias("item")), now.union(gaps.where(F.col("gap") < low)), places


def packed(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece of every document.

    Null text is an empty one: a single end id. Only documents longer than ``capacity`` are cut. Rows with equal or
    null ids are packed each on its own. Other columns are ignored.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)
