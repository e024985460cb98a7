"""SentencePiece encoding and decoding with the tokenizers library as its backend.

The model's protobuf is parsed here (a handful of wire-format fields), and its parts are rebuilt: normaliser and
white-space marker, the scored vocabulary (unigram, or byte-pair merges in the order of the scores), byte fallback
and the decoder. Batches are encoded by several threads; where the model encodes words apart from each other, each
distinct word of a batch is encoded once. All ids can be held against the sentencepiece library's own, which gets whole
texts.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import blocks

MARK = "▁"
#: Piece types of the format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(number, value)`` of a message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire)
        if size is None:
            if wire != 2:
                raise ValueError(f"wire type {wire}")
            size = varint()
        yield number, data[at : at + size]
        at += size


def parse(data: bytes) -> Model:
    out = Model()
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            out.pieces.append((got.get(1, b"").decode(), struct.unpack("<f", got.get(2, bytes(4)))[0], got.get(3, NORMAL)))
        elif number == 2:
            got = dict(_fields(value))
            out.kind, out.byte_fallback = got.get(3, UNIGRAM), bool(got.get(35, 0))
        elif number == 3:
            got = dict(_fields(value))
            out.charsmap = got.get(2, b"")
            out.dummy_prefix, out.squeeze, out.escape = (bool(got.get(i, 1)) for i in (3, 4, 5))
    return out


def parted(model: Model) -> bool:
    """No piece goes on past a white-space marker, and the normaliser changes nothing: a text is then encoded as its
    runs of blanks with the word after each."""
    return not model.charsmap and not model.squeeze and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in model.pieces)


def build(model: Model):
    """A ``tokenizers.Tokenizer`` of the model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if not model.escape or any(t == USER for _, _, t in model.pieces):
        raise ValueError("models with plain blanks or user-defined symbols are not rebuilt")
    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unk = next(i for i, (_, _, t) in enumerate(model.pieces) if t == UNKNOWN)
    if model.kind == UNIGRAM:
        worst = min((s for _, s, t in model.pieces if t == NORMAL), default=0.0)
        scores = [(p, s if t in (NORMAL, BYTE) else worst - 100.0) for p, s, t in model.pieces]
        core = models.Unigram(scores, unk_id=unk, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        usable = {p: s for p, s, t in model.pieces if t == NORMAL}
        merges = [
            (-score, vocab[p[:i]], vocab[p[i:]], p[:i], p[i:])
            for p, score in usable.items()
            for i in range(1, len(p))
            if p[:i] in usable and p[i:] in usable
        ]
        core = models.BPE(
            vocab, [m[3:] for m in sorted(merges)], unk_token=model.pieces[unk][0], fuse_unk=True, byte_fallback=model.byte_fallback
        )
    else:
        raise ValueError(f"model type {model.kind} is not rebuilt")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    out.normalizer = normalizers.Sequence(steps + [normalizers.Prepend(MARK)] * model.dummy_prefix + [normalizers.Replace(" ", MARK)])
    if parted(model):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    last = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *last])
    return out


#: Bytes of text encoded together.
BLOCK = 2 << 20
#: Texts that the library encodes in one call.
LOT = 64
#: Bytes of words and ids that a Python worker remembers; beyond, it forgets all but the first met, the frequent ones.
KNOWN_BYTES = 16 << 20
#: path -> encoder. Python workers outlive their tasks, and what one task met the next one knows.
_BUILT: dict[str, Encoder] = {}


class Encoder:
    """The rebuilt tokenizer, the library's own, and ids by word: where texts are encoded word by word, each distinct
    word is encoded and decoded again once. A word is a run of blanks and what follows it, less its first blank, which
    is the marker that the tokenizer puts before what it gets. Words are cut, told apart and looked up by Arrow, their
    ids laid out and spelled by numpy: nothing is done in Python for each word but to hand new ones to the tokenizer."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        model = parse(data)
        self.tokenizer, self.own = build(model), sentencepiece.SentencePieceProcessor(model_proto=data)
        self.parted = parted(model) and model.dummy_prefix
        spelled = [bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, _, t in model.pieces]
        self.spelled, self.length = np.frombuffer(b"".join(spelled), np.uint8), np.array(list(map(len, spelled)))
        self.begins = np.array([p.startswith(MARK) for p, _, _ in model.pieces])
        blank = self.tokenizer.token_to_id(MARK)
        # The table: words, ids of all of them, where each one's begin and how many they are, words that don't come
        # back. A lone blank can't be got by the prefix alone; its marker is a piece.
        self.words, self.ids = pa.array([""], pa.large_string()), np.array([blank if blank is not None else 0], np.int32)
        self.size, self.lost = np.ones(1, np.int64), np.zeros(1, bool)

    def _encoded(self, words: list[str], together: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has. Words without blanks can go ``together``: each
        begins with the only marker it has."""
        groups = [" ".join(words[i : i + together]) for i in range(0, len(words), together)]
        found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)]
        size, ids = np.array(list(map(len, found))), np.concatenate(found)
        if together == 1:
            return ids, size
        at = np.flatnonzero(self.begins[ids])
        begun = np.diff(np.searchsorted(at, np.cumsum(np.r_[0, size])))
        if np.any(begun[:-1] != together) or len(at) != len(words):
            return self._encoded(words, 1)
        return ids, np.diff(np.r_[at, len(ids)])

    def _learn(self, words: pa.Array, together: int) -> None:
        told = words.to_pylist()
        ids, size = self._encoded(told, together)
        n = self.length[ids]
        upto = np.cumsum(n)
        at = np.repeat((np.cumsum(self.length) - self.length)[ids] - (upto - n), n)
        at += np.arange(len(at))
        back = self.spelled[at]
        given = np.frombuffer(f" {' '.join(told)}".encode(), np.uint8)
        # Bytes of each word with its marker as they were and as they come back.
        was, now = 1 + pc.binary_length(words).to_numpy(), np.diff(np.r_[0, upto][np.cumsum(np.r_[0, size])])
        lost = was != now
        wrong = np.r_[0, np.cumsum(back[np.repeat(~lost, now)] != given[np.repeat(~lost, was)])]
        lost[~lost] = np.diff(wrong[np.cumsum(np.r_[0, was[~lost]])]) > 0
        self.words = pa.concat_arrays([self.words, words])
        self.ids, self.size, self.lost = (np.concatenate(x) for x in ((self.ids, ids), (self.size, size), (self.lost, lost)))

    def _forget(self) -> None:
        each = 4 * self.size + pc.binary_length(self.words).to_numpy() + 17
        if each.sum() > KNOWN_BYTES:
            n = max(1, int(np.searchsorted(np.cumsum(each), KNOWN_BYTES // 2)))
            self.words, self.size, self.lost = self.words[:n], self.size[:n], self.lost[:n]
            self.ids = self.ids[: self.size.sum()]

    def _places(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words in the table, to which those not met yet are added."""
        at = pc.index_in(words, value_set=self.words)
        new = np.flatnonzero(at.is_null())
        at = np.array(at.fill_null(0))
        blanks = np.array(pc.match_substring(words.take(pa.array(new)), " "), bool)
        for which, together in ((new[~blanks], 400), (new[blanks], 1)):
            if len(which):
                at[which] = len(self.words) + np.arange(len(which))
                self._learn(words.take(pa.array(which)), together)
        return at

    def _joined(self, words: pa.Array, counts: np.ndarray) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of texts that have so many of ``words`` each, and whether all of these come back."""
        coded = words.dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()]
        n = self.size[place]
        upto, bounds = np.cumsum(n), np.cumsum(np.r_[0, counts])
        at = np.repeat((np.cumsum(self.size) - self.size)[place] - (upto - n), n)
        at += np.arange(len(at))
        bad = np.r_[0, np.cumsum(self.lost[place])][bounds]
        return np.split(self.ids[at], np.r_[0, upto][bounds[1:-1]]), (bad[1:] == bad[:-1]).tolist()

    def __call__(self, texts: list[str], verify: bool, threads: int) -> tuple[list[np.ndarray], list[bool | None], list[bool]]:
        """Ids of each text, whether the library has the same (None unless asked), and whether they decode to it."""
        if not self.parted:
            ids = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            back = self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
            whole = [x == y for x, y in zip(back, texts)]
        else:
            self._forget()
            ids, whole = [np.zeros(0, np.int32)] * len(texts), [True] * len(texts)
            odd = [not t or t[0] == " " or t[-1] == " " or "  " in t or MARK in t for t in texts]
            plain = [i for i, x in enumerate(odd) if not x]
            if plain:
                cut = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
                for i, x, y in zip(plain, *self._joined(cut.flatten(), pc.list_value_length(cut).to_numpy())):
                    ids[i], whole[i] = x, y
            rest = [i for i, x in enumerate(odd) if x and texts[i]]
            if rest:
                parts = [[w[1:] for w in re.findall(" [ ]*[^ ]*", " " + texts[i].replace(MARK, " "))] for i in rest]
                words = pa.array([w for p in parts for w in p], pa.large_string())
                for i, x, y in zip(rest, *self._joined(words, np.array(list(map(len, parts))))):
                    ids[i], whole[i] = x, y and MARK not in texts[i]
        if not verify:
            return ids, [None] * len(texts), whole
        # The library's lists take ten times the room of the ids, so they are made for a few texts at once.
        own = (x for i in range(0, len(texts), LOT) for x in self.own.encode(texts[i : i + LOT], num_threads=threads))
        return ids, [array("i", x).tobytes() == y.tobytes() for x, y in zip(own, ids)], whole


def _load(path: str) -> Encoder:
    if path not in _BUILT:
        found = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        with open(found, "rb") as f:
            _BUILT[path] = Encoder(f.read())
    return _BUILT[path]


def _threads(n: int) -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", str(n))


def encoded(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = True, threads: int = 2,
    then: tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str] | None = None,
) -> DataFrame:
    """``(id, ids array<int>, parity boolean, n_bytes, round_trip boolean)`` of every row.

    ``parity``: the ids are those of the sentencepiece library; null unless ``verify``. ``round_trip``: the decoded
    ids are the text (where the normaliser is the identity and the text has no marker of its own). Null and empty
    texts have no ids. Repeated rows are encoded alike; other columns are ignored. ``model`` is a path that tasks can
    read, or the name of a file added to the session. ``then``: a function of Arrow batches of these rows and the
    columns besides the id that it makes of them (as ``DIGEST``), in the same task, so that ids need not leave it.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _threads(threads)
        encode = _load(model)
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            for lo, hi in blocks(texts, BLOCK):
                ids, same, whole = encode(texts[lo:hi].to_pylist(), verify, threads)
                listed = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)], dtype=np.int32), np.concatenate(ids))
                columns = [listed, pa.array(same, pa.bool_()), pc.binary_length(texts[lo:hi]), pa.array(whole, pa.bool_())]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], *columns], [id_col, "ids", "parity", "n_bytes", "round_trip"])

    work, columns = then or (iter, "ids array<int>, parity boolean, n_bytes bigint, round_trip boolean")
    return docs.select(id_col, text_col).mapInArrow(lambda batches: work(run(batches)), f"`{id_col}` {kind}, {columns}")


def decoded(rows: DataFrame, model: str, ids_col: str = "ids", threads: int = 2) -> DataFrame:
    """``rows`` with ``text``: the ids decoded; null for null. A column ``text`` that was there is replaced."""
    keep = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _threads(threads)
        tokenizer = _load(model).tokenizer
        for b in batches:
            texts = tokenizer.decode_batch([[] if x is None else [int(i) for i in x] for x in b[ids_col]], skip_special_tokens=False)
            yield b.assign(text=[None if x is None else t for x, t in zip(b[ids_col], texts)])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return rows.select(*[F.col(f.name) for f in keep]).mapInPandas(run, f"{kinds}text string")


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each row as a count and a CRC-32 of their little-endian unsigned 32-bit form."""
    for b in batches:
        ids, kept = b.column("ids"), ["n_bytes", "parity", "round_trip"]
        raw = memoryview(np.asarray(ids.values).astype("<i4", copy=False).view(np.uint8))
        at = [4 * i for i in ids.offsets.to_pylist()]
        made = [pc.list_value_length(ids).cast(pa.int64()), pa.array([zlib.crc32(raw[i:j]) for i, j in zip(at, at[1:])], pa.int64())]
        yield pa.RecordBatch.from_arrays([b.column(0), *made, *map(b.column, kept)], [b.schema.names[0], "n_ids", "ids_crc32", *kept])


DIGEST = (digested, "n_ids bigint, ids_crc32 bigint, n_bytes bigint, parity boolean, round_trip boolean")
