"""The pipeline's stages, each against brute force on what its predecessor kept."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from pulseloom.llm import quality

from .test_operators import DOCS, corpus, local, plain_fingerprint, plain_runs, prose


def same(docs):
    return {d["doc_id"]: d["text"] for d in docs}


def cut(docs, least=50):
    """Repeated strings of 50 bytes cut out; characters that are covered in part stay."""
    seen, out = set(), {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        b = (d["text"] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if b[i : i + least] in seen:
                gone[i : i + least] = b"\1" * least
        seen |= {b[i : i + least] for i in range(len(b) - least + 1)}
        kept, at = [], 0
        for c in d["text"] or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        if "".join(kept).strip(" \t\n\r\x0b\x0c"):
            out[d["doc_id"]] = "".join(kept)
    return out


def test_stages(spark, tmp_path):
    rng = random.Random(20)
    extra = spark.createDataFrame([(500 + i, prose(rng, 60) + "\n" + prose(rng, 30), "en", "s", 0) for i in range(20)], DOCS)
    docs = corpus(spark, 21).where("doc_id IS NOT NULL").unionByName(extra)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages, now = dict(corpus_pipeline.STAGES), spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "suffix_dedup", "best_fit_packing"]

    def step(name, before):
        after = stages[name](spark, before, str(tmp_path))
        path = str(tmp_path / name)
        after.write.parquet(path)
        return spark.read.parquet(path)

    def fine(text):
        n, _, _, _, again = quality.measure(text)[:5]
        return n >= 20 and 100 * again <= 30 * n

    good = step("quality_rules", now)
    assert same(local(good)) == {k: t for k, t in same(local(now)).items() if fine(t)} and good.columns == docs.columns
    lines = step("line_dedup", good)
    gone = plain_runs(local(good))
    assert same(local(lines)) == {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in same(local(good)).items()}
    near = step("simhash_near_dedup", lines)
    prints = {k: plain_fingerprint(t, 5) for k, t in same(local(lines)).items()}
    group = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(prints[a] ^ prints[b]).count("1") <= 3 and group[b] > group[a]:
                    group[b], changed = group[a], True
    assert set(same(local(near))) == {k for k, g in group.items() if k == g} and near.count() < lines.count()
    short = step("suffix_dedup", near)
    assert same(local(short)) == cut(local(near)) and short.columns == docs.columns
    assert all(d["n_chars"] == len(d["text"]) for d in local(short))
    packed = step("best_fit_packing", short)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {k: len(plain.encode(t, add_special_tokens=False).ids) + 1 for k, t in same(local(short)).items()}
    assert {d["doc_id"]: d["length"] for d in local(packed)} == sizes
    assert len({d["sequence_id"] for d in local(packed)}) == -(-sum(sizes.values()) // 4096)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda d: (d["doc_id"], d["piece"], d["length"], d["ids_crc32"])
    assert sorted(map(key, local(whole))) == sorted(map(key, local(packed)))
