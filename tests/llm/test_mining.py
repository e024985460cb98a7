"""Language identification, periodic runs and phrases against brute force, and on nulls, empty and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulseloom.llm import language, periodic, phrases, queries

from .test_operators import DOCS, clash, corpus, empty, local, prose

DATA = "/root/testdata/sf0.001"


def plain_runs(w, least=24, times=3):
    found = []
    for q in range(1, len(w) // times + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            start = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            s, n = start - q, i - start + q
            smaller = any(all(w[j] == w[j - p] for j in range(s + p, s + n)) for p in range(1, q))
            if n >= max(least, times * q) and not smaller:
                found.append((s, n, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(b"abc"), min_size=1, max_size=30), st.integers(1, 8), st.integers(0, 5)), max_size=5))
def test_runs_of_small_alphabets(parts):
    text = " ".join(chr(x) for word, n, more in parts for x in word * n + word[:more])
    words, runs = next(periodic.runs_of([text]))
    assert words == text.encode().split() and runs == plain_runs(words)


def test_runs_of_neighbouring_texts():
    rng = random.Random(1)
    texts = [None, "", " \n", "a " * 23, "a " * 24, "a " * 30, "a " * 30, "ab " * 5000 + "c"]
    texts += [" ".join(rng.choice("xy") for _ in range(rng.randrange(120))) for _ in range(60)]
    texts += [" ".join(([str(rng.randrange(9)) for _ in range(p)] * 9)[: rng.randrange(3 * p, 9 * p)]) for p in range(1, 80)]
    got = list(periodic.runs_of(texts))
    assert len(got) == len(texts) and got[7][1] == [(0, 5000, 1)]
    for t, (words, runs) in zip(texts, got):
        assert words == (t or "").encode().split()
        if len(words) < 1000:
            assert runs == plain_runs(words)


def plain_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = next(((s, n, q) for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])) if all(n * y >= m * q for _, m, y in runs)), (None,) * 3)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(1, 90)) for _ in range(80)] + [None, "", " \t\n", "ha " * 40, "\x1ca b\x85 " * 12]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "ha " * 40, "en", "s", 0), (3, texts[3], "en", "s", 0), (3, texts[4], "en", "s", 0)]
    df = clash(spark.createDataFrame(rows, DOCS))
    got = [tuple(r) for r in periodic.digest(periodic.repeated(periodic.with_planted_runs(df))).collect()]
    assert sorted(got, key=repr) == sorted(((i, *plain_digest(i, t)) for i, t, *_ in rows), key=repr)
    assert sum(r[1] for r in got) > 5
    assert periodic.repeated(empty(spark, df)).count() == 0
    with pytest.raises(ValueError):
        periodic.repeated(df, times=2)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(2, 5), st.integers(0, 9), st.data())
def test_filters_lose_nothing(bits, n, deep, data):
    rows = data.draw(st.lists(st.tuples(*[st.integers(0, 2**bits - 1)] * n), min_size=1, max_size=60))
    given_counts = collections.Counter(rows)
    parts = np.array(rows, np.uint64).T
    back = phrases.permuted(phrases.permuted(parts, bits), bits, back=True)
    assert (back == parts).all()
    keys = phrases.limbs(parts, bits)
    assert (phrases.parts_of(keys, n, bits) == parts).all()
    found = collections.Counter()
    for bucket, filtered in phrases.shards(parts, np.ones(len(rows), np.int64), bits, deep):
        keys, counts = phrases.opened(filtered, bucket, min(deep, n * bits), n * bits)
        words = phrases.permuted(phrases.parts_of(keys, n, bits), bits, back=True)
        for w, c in zip(words.T.tolist(), counts.tolist()):
            found[tuple(w)] += c
    assert found == given_counts


def test_filters_are_compact():
    """A filter of pairs takes little more than the bits of a key that its quotient does not say, and a small counter."""
    rng = np.random.default_rng(5)
    parts = rng.integers(0, 2**12, (2, 200_000)).astype(np.uint64)
    (_, data), *_ = phrases.shards(parts, np.ones(200_000, np.int64), 12, 0)
    assert len(data) < 200_000 * 2


def plain_collocations(rows, least, top, longest):
    f, n = collections.Counter(), collections.Counter()
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *p), a in cands.items():
        inside = lambda q: any(q[i : i + len(p)] == tuple(p) for i in range(1, len(q) - len(p) + 1))  # noqa: B023, E731
        if any(q[0] == lang and len(q) > len(p) + 1 and 100 * b >= 100 * a and inside(q) for q, b in cands.items()):
            continue
        cut = min((1000 * a * n[lang] // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k) for k in range(1, len(p)))
        l, r = f[(lang, *p[: cut[1]])], f[(lang, *p[cut[1] :])]
        out.append((lang, " ".join(p), a, l, r, n[lang], cut[0]))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


@pytest.mark.parametrize(("top", "longest"), [(2000, 5), (7, 3)])
def test_phrases(spark, top, longest):
    rng = random.Random(6)
    rows = [(r["text"], r["lang"]) for r in local(corpus(spark, 6, 90))]
    rows += [(" ".join(rng.choice(("the", "The", "of", "cat", "é", "x.y", "a,b", "q!")) for _ in range(40)), rng.choice(("en", "", "fr\n", None))) for _ in range(60)]
    rows += [("same same same same same same", "en")] * 9 + [("A\x00b c\x1cd", "en")] * 12 + [("", "en"), (None, "fr"), (None, None), ("...", "xx")]
    df = clash(spark.createDataFrame(rows, "text string, lang string"))
    got = sorted(tuple(r) for r in phrases.collocations(df.repartition(7), 8, top, longest).collect())
    expected = plain_collocations(rows, 8, top, longest)
    assert got == expected and len(got) > 15
    assert phrases.collocations(empty(spark, df)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("a", "b")], "text string, lang string")).count() == 0


def test_phrase_scores_are_exact(spark):
    """Products far over 64 bits: the decimals of the score against whole numbers."""
    rng = random.Random(7)
    rows = [(rng.randrange(1, 10 ** rng.randrange(1, 15)), rng.randrange(10**14, 10**15), *(rng.randrange(10 ** rng.randrange(6, 15), 10**15) for _ in range(2))) for _ in range(300)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select("a", "n", "l", "r", phrases.score().alias("s")).collect()
    assert all(r.s == 1000 * r.a * r.n // (r.l * r.r) for r in got)


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = local(queries.op11_language(spark, DATA).join(docs.select("doc_id", "lang", "text"), "doc_id"))
    assert len(found) == docs.count() and all(0 <= d["score"] <= 1 for d in found)
    for d in found:
        assert d["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)
        if not any(c.isalpha() for c in d["text"] or ""):
            assert d["lang_pred"] == "und" and d["score"] == 0
    held = [d for d in found if d["held_out"] and d["lang_pred"] != "und"]
    assert sum(d["lang"] == d["lang_pred"] for d in held) >= 0.95 * len(held)


def test_language_counts_and_neighbours(spark):
    """Frequencies, weights and the choice of a centroid against plain dictionaries."""
    texts = ["Été, the cat!", "the the the", "", "123 ...", "der Hund und die Katze", "x"]

    def grams(t):
        w = re.findall(r"[a-z\x80-\U0010ffff]+", t.lower())
        b = (" " + " ".join(w) + " ").encode() if w else b""
        out = collections.Counter()
        for n in (1, 2, 3):
            for i in range(len(b) - n + 1):
                code = int.from_bytes(b[i : i + n], "big") + (n << 24)
                out[((code * 0x9E3779B1) % 2**32 >> 8) % 512] += 1
        return out

    plain = [grams(t) for t in texts]
    got = []
    for _, bounds, places, counts in language.vectors(texts, 512):
        got += [dict(zip(places[a:b].tolist(), counts[a:b].tolist())) for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [dict(p) for p in plain]
    n, df = language.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), "text", 512)
    assert n == 6 and df.tolist() == [sum(p in q for q in plain) for p in range(512)]


def test_language_edges(spark):
    rng = random.Random(9)
    say = {"en": "the of and cat with house".split(), "de": "der die und katze mit haus".split(), "fr": "le la et chat avec maison".split()}
    rows = [(i, " ".join(rng.choice(say[lang]) for _ in range(rng.randrange(3, 30))), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 .", "fr"), (203, "the of and", None), (None, "der die und", "de"), (5, rows[5][1], "fr"), (204, "ЖЖЖ ЩЩЩ ЪЪЪ", None)]
    rows += [(300 + i, "the cat and the house", "en") for i in range(60)]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    train = F.col("doc_id") % 5 != 0
    one = sorted((tuple(r) for r in language.predicted(df, train).select("doc_id", "text", "__lang", "__cosine", "__rejected").collect()), key=repr)
    assert len(one) == len(rows)
    by = {(r[0], r[1]): r for r in one}
    assert [by[k][2] for k in ((200, None), (201, ""), (202, "123 ."))] == ["und"] * 3 and all(by[k][4] for k in ((200, None), (201, "")))
    assert by[203, "the of and"][2] == "en" and by[None, "der die und"][2] == "de" and not by[300, "the cat and the house"][4]
    # Far from all centroids: the nearest language, and rejected.
    assert by[204, "ЖЖЖ ЩЩЩ ЪЪЪ"][4]
    # A model that is compared centroid by centroid says the same.
    two = sorted((tuple(r) for r in language.predicted(df, train, model_bytes=1).select("doc_id", "text", "__lang", "__cosine", "__rejected").collect()), key=repr)
    assert [(r[:3], r[4]) for r in two] == [(r[:3], r[4]) for r in one] and all(abs(a[3] - b[3]) < 1e-5 for a, b in zip(one, two))
    assert {r["__lang"] for r in language.predicted(df, F.lit(False)).collect()} == {"und"}
    assert language.predicted(empty(spark, df), train).count() == 0


def test_language_sample_is_bounded(spark):
    rng = random.Random(10)
    rows = [(" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(5)) if i % 3 else "copied text", "en") for i in range(3000)]
    model, _ = language.fitted(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", sample=20, clusters=3, dims=256)
    assert model.count() == 3
