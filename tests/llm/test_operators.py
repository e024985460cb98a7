"""The corpus operators against brute force, and on nulls, empty and repeated rows, ties and clashing names."""

import collections
import gc
import hashlib
import json
import math
import random
import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pulseloom.llm import audio, lines, packing, pieces, quality, simhash, suffixes, suffixtree, urls, warc
from pulseloom.llm.tables import components

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "Été", "x"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(spark, seed=1, n=60):
    rng = random.Random(seed)
    passage = prose(rng, 40)
    texts = []
    for i in range(n):
        t = "\n".join(prose(rng, rng.randrange(1, 25)) for _ in range(rng.randrange(1, 8)))
        if i % 3 == 0:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        if i % 7 == 6:
            t = texts[i - 3] or ""
        if i % 11 == 10:
            t = (texts[i - 5] or "").replace("alpha", "ALPHA", 1)
        texts.append(t)
    texts += [None, "", " \n\t", "a" * 200, "ab" * 120, "a" * 200]
    rows = [(i, t, ("en", None)[i % 5 == 0], "s", 0) for i, t in enumerate(texts)]
    rows.append((None, texts[0], "en", "s", 0))
    return spark.createDataFrame(rows, DOCS)


def local(df):
    return [r.asDict() for r in df.collect()]


def clash(df):
    """Extra columns with names that operators might use."""
    for c in ("id", "h", "key", "chunk", "stratum", "fp", "rep", "length", "piece", "scores", "host", "rule", "count", "n"):
        df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark, df):
    return spark.createDataFrame([], df.schema)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    expected = {x: root(x) for e in edges for x in e if root(x) != x}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == expected


def plain_runs(docs, t=3):
    first, gone = {}, collections.defaultdict(set)
    for d in sorted((d for d in docs if d["doc_id"] is not None and d["text"] is not None), key=lambda d: d["doc_id"]):
        seq = [(i, x) for i, x in enumerate(d["text"].split("\n")) if x.strip(" \t\r\x0b\x0c\n")]
        for j in range(len(seq) - t + 1):
            if first.setdefault(tuple(x for _, x in seq[j : j + t]), (d["doc_id"], j)) != (d["doc_id"], j):
                gone[d["doc_id"]].update(i for i, _ in seq[j : j + t])
    return gone


def test_lines(spark):
    rng = random.Random(4)
    block = [prose(rng, 3) for _ in range(9)]
    rows = []
    for i in range(40):
        a, n = rng.randrange(6), rng.randrange(2, 6)
        rows.append((i, "\n".join([prose(rng, 4)] + block[a : a + n] + ["", " "] + block[:2] + [prose(rng, 2)] * rng.randrange(4)), "en", "s", 0))
    rows += [(50, None, "en", "s", 0), (51, "", "en", "s", 0), (52, "\n\n\n\n", "en", "s", 0), (None, rows[3][1], "en", "s", 0), (3, rows[3][1], "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    gone = plain_runs([dict(zip(("doc_id", "text"), r)) for r in rows[:40]])
    got = local(lines.deduplicated(clash(df)))
    assert len(got) == len(rows)
    for d in got:
        original = next(r[1] for r in rows if r[0] == d["doc_id"])
        if original is None or d["doc_id"] is None:
            assert d["text"] == original and d["__n_removed"] == 0
        else:
            kept = [x for i, x in enumerate(original.split("\n")) if i not in gone[d["doc_id"]]]
            assert d["text"] == "\n".join(kept) and d["__n_removed"] == len(gone[d["doc_id"]])
    assert lines.deduplicated(empty(spark, df)).count() == 0


def plain_fingerprint(text, k=3):
    w = "".join(c.lower() if c.isascii() else c for c in (text or "")).encode().split()
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    df = corpus(spark)
    got = local(simhash.near_duplicates(clash(df)))
    prints = {d["doc_id"]: plain_fingerprint(d["text"]) for d in local(df)}
    ids = sorted(i for i in prints if i is not None)
    group = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(prints[a] ^ prints[b]).count("1") <= 3 and group[b] > group[a]:
                    group[b], changed = group[a], True
    assert {d["doc_id"]: d["fp"] & (2**64 - 1) for d in got} == prints
    assert {d["doc_id"]: d["component_id"] for d in got} == {**group, None: None}
    assert simhash.near_duplicates(empty(spark, df)).count() == 0


def test_simhash_links_find_all_near_fingerprints(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(6)})
    rows = [(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)]
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame(rows, "fp long, rep long")).collect()}
    assert got == {(i, j) for j in range(len(values)) for i in range(j) if bin(values[i] ^ values[j]).count("1") <= 3}


def plain_removals(docs, least=50):
    seen, out = set(), {}
    for d in sorted((d for d in docs if d["doc_id"] is not None), key=lambda d: d["doc_id"]):
        b = (d["text"] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if b[i : i + least] in seen:
                gone[i : i + least] = b"\1" * least
        seen |= {b[i : i + least] for i in range(len(b) - least + 1)}
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d["doc_id"]] = (len(b), sum(gone), sum(g and not p for p, g in zip(b"\0" + gone, gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("wide", [0, 2, 1000])
def test_suffixes(spark, wide):
    df = corpus(spark, 3)
    got = {d.pop("doc_id"): tuple(d.values()) for d in local(suffixes.removals(clash(df), wide=wide))}
    null = got.pop(None)
    assert got == plain_removals(local(df))
    assert null[1:3] == (0, 0)
    if not wide:
        assert suffixes.removals(empty(spark, df)).count() == 0
        texts = {d["doc_id"]: d for d in local(suffixes.deduplicated(clash(df)))}
        assert texts[60]["text"] is None and texts[0]["h"] == "x" and set(texts[0]) == set(clash(df).columns)


def test_interval_expansion_against_sets():
    rng = np.random.default_rng(0)
    for sigma in (1, 2, 4, 20):
        text = rng.integers(97, 97 + sigma, 700, dtype=np.uint8)
        cyclic = np.r_[text, text[:50]].tobytes()
        of, seen = suffixes.classes(text), {}
        for i, c in enumerate(of.tolist()):
            assert seen.setdefault(cyclic[i : i + 50], c) == c
        assert len(seen) == len(set(of.tolist()))


def test_suffix_tree(spark):
    df = corpus(spark, 6)
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = {d["doc_id"]: d for d in local(suffixtree.scored(clash(df), held))}
    docs = local(df)
    out = lambda d: d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2
    tokens = lambda d: suffixtree.words_of(d["text"]) + [None]
    c = collections.Counter(t for d in docs if not out(d) for t in tokens(d))
    n, v = sum(c.values()), len(c)
    for d in docs:
        g = got[d["doc_id"]]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (out(d), len(tokens(d)), sum(c[t] > 0 for t in tokens(d)), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(d)))
        assert math.isfinite(g["score"]) and g["score"] < 0
    assert suffixtree.scored(empty(spark, df), held).count() == 0


def plain_tree(texts, least):
    """Score of a text by counts of all contexts in a dictionary."""
    symbols = lambda t: bytes(5) + b" ".join(suffixtree.words_of(t)) + b"\0"
    counts = collections.defaultdict(collections.Counter)
    for a in map(symbols, texts):
        for i in range(5, len(a)):
            for d in range(6):
                counts[a[i - d : i]][a[i]] += 1

    def p(c, s):
        n, k = counts[c].total() if c in counts else 0, len(counts.get(c, ()))
        if not c:
            return (1 + counts[c][s]) / (256 + n)
        return (counts[c][s] + k * p(c[1:], s)) / (n + k) if n >= least else p(c[1:], s)

    def state(c):
        n, k = counts[c].total() if c in counts else 0, len(counts.get(c, ()))
        return not c or n >= least and 2 * sum(m * math.log(m / n / p(c[1:], s)) for s, m in counts[c].items()) > k + 3 * math.sqrt(2 * k)

    def score(text):
        a = symbols(text)
        return sum(math.log10(p(next(a[i - d : i] for d in range(5, -1, -1) if state(a[i - d : i])), a[i])) for i in range(5, len(a)))

    return score


def test_suffix_tree_against_counts_of_all_contexts(spark):
    df = corpus(spark, 6).where("doc_id < 30")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = local(suffixtree.scored(df, held))
    text = {d["doc_id"]: d["text"] for d in local(df)}
    score = plain_tree([text[g["doc_id"]] for g in got if not g["held_out"]], suffixtree.LEAST)
    assert any(g["held_out"] for g in got)
    for g in got:
        assert g["score"] == pytest.approx(score(text[g["doc_id"]]))


def test_suffix_tree_keeps_rare_contexts_of_a_large_corpus(spark):
    """Twelve occurrences are a share of less than two millionths of these symbols."""
    rows = [(i, "ab " * 50000, "en", "s", 0) for i in range(60)] + [(100 + i, "zqxjvk", "en", "s", 0) for i in range(12)] + [(200, "zqxjvk", "en", "s", 0)]
    got = {d["doc_id"]: d for d in local(suffixtree.scored(spark.createDataFrame(rows, DOCS), F.col("doc_id") == 200))}
    assert got[200]["score"] > -10


def test_suffix_tree_beats_single_symbols_on_held_out_words(spark):
    """Words made of syllables: contexts must tell more than the frequencies of symbols do."""
    rng = random.Random(12)
    syllables = ["ka", "lo", "mi", "ren", "tis", "u", "vor", "shan"]
    rows = [(i, " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 6))) for _ in range(60)), "en", "s", 0) for i in range(300)]
    got = local(suffixtree.scored(spark.createDataFrame(rows, DOCS), F.crc32(F.col("doc_id").cast("string")) % 7 == 2))
    symbols = lambda i: rows[i][1].encode() + b"\0"
    c = collections.Counter(b for g in got if not g["held_out"] for b in symbols(g["doc_id"]))
    unseen = [g for g in got if g["held_out"]]
    single = sum(math.log10(c[b] / sum(c.values())) for g in unseen for b in symbols(g["doc_id"]))
    assert sum(g["score"] for g in unseen) > 0.6 * single


def test_suffix_tree_is_a_distribution():
    rng = random.Random(7)
    texts = [suffixtree.words_of(prose(rng, 30)) for _ in range(40)]
    code = np.concatenate([k for _, k, _ in suffixtree.grams(texts)])
    levels = []
    for d in range(suffixtree.DEPTH + 1):
        levels.append(np.unique(code & np.uint64((1 << (8 * d + 8)) - 1), return_counts=True))
    tree = suffixtree.Tree(levels)
    assert any(s.any() for s in tree.state[2:])
    for context in (0, int(code[50] >> np.uint64(8)), int.from_bytes(b"qqqqq", "big")):
        every = np.array([(context << 8) + s for s in range(256)], np.uint64)
        assert (10.0 ** tree.score(every)).sum() == pytest.approx(1)


RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def test_url_rules(spark):
    cases = [
        ("http://A.Example.com/en/1?q#f", "a.example.com", "/en/1", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("x://b.com/z", "b.com", "/z", "com/", "allow"), ("http://b.com", "b.com", "", None, "allow"), ("http://n.net/es/a", "n.net", "/es/a", "net/es/", "block"), ("http://xcom/a", "xcom", "/a", None, "allow"),
        ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://É.com/a?b/c", "É.com", "/a", "com/", "allow"),
    ]
    df = clash(spark.createDataFrame([(i, c[0], None) for i, c in enumerate(cases)], "page_id long, url string, html string"))
    got = {d["page_id"]: (d["__host"], d["__path"], d["__rule"], d["__verdict"]) for d in local(urls.judge(df, RULES))}
    # The page of n.net makes its host a blocked seed, so its other pages would be blocked too; none of these is.
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert urls.judge(empty(spark, df), RULES).count() == 0


@pytest.mark.parametrize(("tolerance", "damping"), [(1e-3, 0.85), (1e-11, 0.4)])
def test_url_propagation(spark, tolerance, damping):
    rng = random.Random(8)
    hosts = [f"h{i}" for i in range(30)]
    edges = {(a, b): rng.randrange(1, 4) for a, b in ((rng.choice(hosts), rng.choice(hosts)) for _ in range(120)) if a != b}
    seeds = [(h, int(i < 3), int(3 <= i < 6)) for i, h in enumerate(hosts)]
    links = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    got = {r.host: r for r in urls.propagate(spark.createDataFrame(seeds, "host string, trusted int, blocked int"), links, damping, tolerance).collect()}
    along, back = np.zeros((30, 30)), np.zeros((30, 30))
    for (a, b), n in edges.items():
        along[int(b[1:]), int(a[1:])], back[int(a[1:]), int(b[1:])] = n, n
    along, back = (m / np.maximum(m.sum(0), 1) for m in (along, back))
    given = np.array([[t, b, 1, 1] for _, t, b in seeds], float)
    # The converged scores solve a linear system; what comes from others is left when a seed's own mass is taken off.
    solved = [np.linalg.solve(np.eye(30) - damping * m, (1 - damping) * given[:, i]) for i, m in enumerate((along, back, along, back))]
    for i, c in enumerate(urls.SCORES):
        for h in range(30):
            # The promise: no share of what the host would have if all were seeds is off by more than this.
            most = solved[2 + i % 2][h] * tolerance / (1 - damping) + 1e-13
            assert abs((got[f"h{h}"][c] if f"h{h}" in got else 0.0) - (solved[i][h] - (1 - damping) * given[h, i])) <= most


def test_url_propagation_to_verdicts(spark):
    pages = spark.createDataFrame([(1, "http://s.net/fr/", ""), (2, "http://m.org/", '<a href="http://S.net/x">'), (3, "http://o.org/", "<a HREF=//m.org>"), (4, "http://p.org/", None)], "page_id long, url string, html string")
    assert {d["page_id"]: d["__verdict"] for d in local(urls.judge(pages, RULES))} == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_url_propagation_goes_on_to_the_end_of_a_chain(spark):
    """Distrust passes undiminished in share along hosts that link to nothing else, however many."""
    rows = [(0, "http://s.net/fr/", "")] + [(i, f"http://c{i}.org/", f'<a href="http://{"c%d.org" % (i - 1) if i > 1 else "s.net"}/">') for i in range(1, 10)]
    got = {d["page_id"]: d["__verdict"] for d in local(urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES))}
    assert set(got.values()) == {"block"}


def test_url_rules_joined_as_a_table(spark):
    rng = random.Random(22)
    names = ["a.com", "b.a.com", "com", "x.b.a.com", "org", "a.org"]
    rules = [(rng.choice(("allow", "block")), rng.choice(names) + rng.choice(("/", "/p", "/p/q", "/q"))) for _ in range(40)]
    rows = [(i, rng.choice(["b.", "x.b.", "", "zz."]) + rng.choice(["a.com", "a.org", "xcom", ""]), rng.choice(["", "/", "/p/q/r", "/pq", "/q"])) for i in range(200)]
    placed = clash(spark.createDataFrame(rows, "page_id long, __host string, __path string"))
    one = {d["page_id"]: (d["__rule"], d["__by_rule"]) for d in local(urls.with_rules(placed, rules))}
    two = {d["page_id"]: (d["__rule"], d["__by_rule"]) for d in local(urls.with_rules(placed, rules, inline=0))}
    assert one == two and len({r for r, _ in one.values()}) > 5


@pytest.mark.parametrize("farm", [3, 300])
def test_url_link_farms_of_any_size(spark, farm):
    """All hosts that link to nothing but a blocked seed are blocked; one with many other links is not."""
    rows = [(0, "http://s.net/fr/", ""), (1, "http://many.org/", "".join(f'<a href="http://g{i}.org/">' for i in range(50)) + '<a href="http://s.net/">')]
    rows += [(2, "http://www.example.com/en/", '<a href="http://s.net/">')] + [(10 + i, f"http://f{i}.org/", '<a href="http://s.net/">') for i in range(farm)]
    got = {d["page_id"]: d["__verdict"] for d in local(urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES))}
    assert got == {0: "block", 1: "allow", 2: "allow"} | {10 + i: "block" for i in range(farm)}


def test_warc(spark):
    pages = [(i, f"http://h{i % 4}.example.com/p/{i}?q={i % 3}", f"<p>{i % 9}</p>" * (i % 5)) for i in range(80)]
    pages += [(90, None, None), (91, "no scheme \n", ""), (None, "http://z.org/", "é"), (5, pages[5][1], pages[5][2])]
    df = clash(spark.createDataFrame(pages, "page_id long, url string, html string"))
    stored = warc.archives(df)
    indexed = warc.index(stored)
    got = local(warc.read_all(stored, indexed))
    assert len(got) == len(pages)
    keeper = {}
    for p, _, h in pages:
        if p is not None:
            keeper[h or ""] = max(keeper.get(h or "", -1), p)
    html = {p: h or "" for p, _, h in pages}
    for d in got:
        p, h = d["page_id"], html[d["page_id"]]
        last = p is None or keeper[h] == p
        assert (d["record_type"], d["refers_to"]) == (("response", None) if last else ("revisit", keeper[h]))
        assert d["payload_bytes"] == len(h.encode()) and (not last or bytes(d["payload"]) == h.encode())
    wanted = df.where("page_id IN (3, 17, 90)").select("url")
    assert sorted(d["page_id"] for d in local(warc.look_up(wanted, stored, indexed))) == [3, 17, 90]
    none = warc.archives(empty(spark, df))
    assert warc.read_all(none, warc.index(none)).count() == 0


def test_warc_tells_payloads_of_one_id_apart(spark):
    """Id 1 has a payload of its own, one that 2 has, and one that 3 has."""
    pages = [(1, "http://a.org/", "own"), (1, "http://b.org/", "two"), (1, "http://c.org/", "three"), (2, "http://d.org/", "two"), (3, "http://e.org/", "three")]
    stored = warc.archives(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {(d["page_id"], d["url"], d["refers_to"], d["payload"] and bytes(d["payload"])) for d in local(warc.read_all(stored, warc.index(stored)))}
    assert got == {(1, "http://a.org/", None, b"own"), (1, "http://b.org/", 2, None), (1, "http://c.org/", 3, None), (2, "http://d.org/", None, b"two"), (3, "http://e.org/", None, b"three")}


def test_warc_look_up_finds_every_record(spark, monkeypatch):
    """Urls that are encoded in their records, and more lines than a block holds."""
    pages = [(i, f"http://É{i % 50}.org/ü {i}", "x") for i in range(200)] + [(300, None, ""), (301, "No scheme \n", "y"), (302, "http://É1.org/ü 1", "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    monkeypatch.setattr(warc, "LINES", 7)
    stored = warc.archives(df)
    assert sorted(d["page_id"] for d in local(warc.look_up(df, stored, warc.index(stored)))) == sorted(p[0] for p in pages)


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_token_ids_by_word():
    from tokenizers import Tokenizer

    texts = ["Hello, world. It's A<|endoftext|>b <|ENDOFTEXT|> ok.", "", None, "ÀÉ a\u0301 x\x85y\u3000z ΣΑΣ, 12 3.4.", "a.. b,. C. don't", "\x00 \x1c"]
    plain = Tokenizer.from_file(WORD_BPE)
    expected = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    encode = packing.WordIds(WORD_BPE)
    assert encode.by_word
    for by_word in (True, False):
        encode.by_word = by_word
        ids, at = encode(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == expected


def test_token_ids_when_words_are_forgotten(monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(17)
    texts = ["".join(rng.choice("aéB .,\n'3-") for _ in range(400)) for _ in range(60)]
    monkeypatch.setattr(packing, "KNOWN_BYTES", 2000)
    encode, plain = packing.WordIds(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for t in texts:
        assert encode(pa.array([t], pa.large_string()))[0].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_token_ids_of_plain_words():
    """Words of plain letters skip normalizing; others, marks that join letters among them, do not."""
    from tokenizers import Tokenizer

    rng = random.Random(23)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for letters in ("abcß", "éèÿøaz", "aeßÉ", "ae\u0301o\u0308", "st'e", "a1÷×") for _ in range(300)]
    rng.shuffle(words)
    text = " ".join(words)
    encode, plain = packing.WordIds(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    easy = pa.array(["straße", "naïve", "a"], pa.large_string())
    ids, sizes = encode._plain(easy)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain.encode(w, add_special_tokens=False).ids for w in easy.to_pylist()]
    assert encode._plain(pa.array(["two parts"], pa.large_string())) is None
    assert encode(pa.array([text], pa.large_string()))[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    # Without the short way the ids are the same.
    other = packing.WordIds(WORD_BPE)
    other.plain = None
    assert other(pa.array([text], pa.large_string()))[0].tolist() == encode(pa.array([text], pa.large_string()))[0].tolist()


def test_remembered_words_are_small():
    """Workers keep what they remember through later stages: under 100 bytes a word with its ids, no objects."""
    encode = packing.WordIds(WORD_BPE)
    words = sorted({"".join(random.Random(i).choices("abcdefgh", k=9)) for i in range(20_000)})
    tracemalloc.start()
    try:
        encode(pa.array([" ".join(words)], pa.large_string()))
        gc.collect()
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert held < 70 * len(words)
    assert held + encode.words.nbytes < 100 * len(words)
    assert len(encode.words) == len(words) and encode.held < packing.KNOWN_BYTES


def test_word_wise_tokenizers():
    with open(WORD_BPE, encoding="utf-8") as f:
        config = json.load(f)
    assert packing.word_wise(config)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        assert not packing.word_wise(json.load(f))
    config["pre_tokenizer"]["pretokenizers"][0]["behavior"] = "Isolated"
    assert not packing.word_wise(config)


def test_packing(spark):
    from tokenizers import Tokenizer

    df = corpus(spark, 9)
    cap = 64
    got = local(packing.packed(clash(df), WORD_BPE, cap))
    plain = Tokenizer.from_file(WORD_BPE)
    ids = {d["doc_id"]: plain.encode(d["text"] or "", add_special_tokens=False).ids + [1] for d in local(df)}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for g in got:
        by_doc[g["doc_id"]].append(g)
        by_sequence[g["sequence_id"]].append(g)
    assert by_doc.keys() == ids.keys()
    for doc, parts in by_doc.items():
        parts.sort(key=lambda g: g["piece"])
        assert [g["length"] for g in parts] == [min(cap, len(ids[doc]) - i) for i in range(0, len(ids[doc]), cap)]
        for g in parts:
            cut = ids[doc][g["start"] : g["start"] + g["length"]]
            assert g["start"] == g["piece"] * cap and g["ids_crc32"] == zlib.crc32(np.array(cut, "<u4").tobytes())
    for parts in by_sequence.values():
        at = 0
        for g in sorted(parts, key=lambda g: g["offset"]):
            assert g["offset"] == at
            at += g["length"]
        assert at <= cap
    least = -(-sum(map(len, ids.values())) // cap)
    assert len(by_sequence) <= 1.1 * least + 1
    assert packing.packed(empty(spark, df), WORD_BPE).count() == 0


@pytest.mark.parametrize("counts, most", [({7: 1000}, 1000), ({10: 5, 6: 4, 4: 9, 1: 1}, 12), ({5: 3, 6: 2}, 4), ({10: 3}, 3)])
@pytest.mark.parametrize("small", [0, 1000])
def test_packing_of_equal_and_large_lengths(spark, monkeypatch, small, counts, most):
    monkeypatch.setattr(packing, "SMALL", small)
    rows = [(k, "x") for k, n in counts.items() for _ in range(n)]
    got = local(packing.pack(spark.createDataFrame(rows, "length int, item string"), 10))
    assert sorted((g["length"], g["item"]) for g in got) == sorted(rows)
    by = collections.defaultdict(list)
    for g in got:
        by[g["sequence_id"]].append((g["offset"], g["length"]))
    assert len(by) <= most
    for parts in by.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 10
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(11, "x")], "length int, item string"), 10)


@pytest.mark.parametrize("small", [0, 1000])
def test_packing_of_many_lengths_over_partitions(spark, monkeypatch, small):
    """Partitions of a few rows, so that most matches cross them; nearly as few sequences as tokens need. By rounds to
    the end, and with the last documents of a band in one task."""
    monkeypatch.setattr(packing, "SMALL", small)
    rng = random.Random(18)
    lengths = [min(100, 1 + int(rng.expovariate(0.06))) for _ in range(3000)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = local(packing.pack(spark.createDataFrame([(n,) for n in lengths], "length int"), 100))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sorted(g["length"] for g in got) == sorted(lengths)
    total = collections.Counter()
    for g in got:
        total[g["sequence_id"]] += g["length"]
    assert max(total.values()) <= 100 and len(total) <= 1.01 * sum(lengths) / 100 + 1


def test_best_fits_against_a_plain_search():
    rng = random.Random(20)
    for _ in range(100):
        docs = [(rng.randrange(1, 11), i) for i in range(rng.randrange(12))]
        gaps = [(rng.randrange(1, 10), i) for i in range(rng.randrange(8))]
        left, expected, number = {seq: gap for gap, seq in gaps}, {}, -1
        for length, item in sorted(docs, reverse=True):
            fits = [(gap, seq) for seq, gap in left.items() if gap >= length]
            if not fits:
                left[number] = 10
                fits, number = [(10, number)], number - 1
            seq = min(fits)[1]
            left[seq] -= length
            expected[item] = seq
        assert {r[4]: r[2] for r in packing.best_fits(docs, gaps, 10, -1)} == expected


def test_sweeps_match_as_a_stack():
    rng = random.Random(19)
    for _ in range(50):
        flags = [rng.random() < 0.5 for _ in range(rng.randrange(30))]
        stack, pairs, alone = [], set(), []
        for i, gap in enumerate(flags):
            if not gap:
                stack.append(i)
            elif stack:
                pairs.add((stack.pop(), i))
            else:
                alone.append(i)
        docs, gaps, left, waits = packing.stack_match(np.array(flags, bool))
        assert set(zip(docs.tolist(), gaps.tolist())) == pairs and left.tolist() == alone and waits.tolist() == stack


def test_pieces(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "", None, "  x  y\n\n z\t", "日本 🎉\x00", "<s> <0x41> ▁▁a", "é" * 300, " ", "   "])], "doc_id long, text string")
    got = {d["doc_id"]: d for d in local(pieces.encoded(clash(df), model))}
    assert all(d["parity"] for d in got.values())
    assert [got[i]["round_trip"] for i in range(9)] == [True] * 5 + [False] + [True] * 3
    back = {d["doc_id"]: d["text"] for d in local(pieces.decoded(pieces.encoded(df, model).withColumn("text", F.lit(1)), model))}
    assert back[3] == "  x  y\n\n z\t" and back[2] == "" and back[4] == "日本 🎉\x00"


def wire(number, value):
    """A protobuf field: a whole number, a float or bytes."""
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(value, int):
        return varint(8 * number) + varint(value)
    if isinstance(value, float):
        return varint(8 * number + 5) + struct.pack("<f", value)
    return varint(8 * number + 2) + varint(len(value)) + value


@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_model_against_the_library(fallback):
    import sentencepiece

    rng = random.Random(25)
    vocab = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256) if fallback]
    words = {"▁", *"abcdé"} | {"▁" * rng.randrange(2) + "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 5))) for _ in range(60)}
    vocab += [(w, -1.0 - rng.random() * 5, 1) for w in sorted(words)]
    data = b"".join(wire(1, wire(1, p.encode()) + wire(2, s) + wire(3, t)) for p, s, t in vocab)
    data += wire(2, wire(3, 1) + wire(35, int(fallback))) + wire(3, wire(1, b"identity") + wire(3, 1) + wire(4, 0) + wire(5, 1))
    own, encode = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Encoder(data)
    assert encode.tokenizer.model.__class__.__name__ == "Unigram"
    texts = ["".join(rng.choice("abcdé  " + "xß日" * (i % 2)) for _ in range(rng.randrange(40))) for i in range(300)]
    ids, same, _ = encode(texts, True, 1)
    assert [x.tolist() for x in ids] == own.encode(texts) and all(same)


def test_pieces_of_random_texts_when_words_are_forgotten(monkeypatch):
    import sentencepiece

    rng, path = random.Random(26), public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(pieces, "KNOWN_BYTES", 3000)
    with open(path, "rb") as f:
        encode = pieces.Encoder(f.read())
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    for _ in range(30):
        texts = ["".join(rng.choice(["the", "a", " ", "  ", "\n", "é", "日", "▁", "x1", ".", " word"]) for _ in range(rng.randrange(60))) for _ in range(20)]
        ids, same, whole = encode(texts, True, 1)
        assert [x.tolist() for x in ids] == own.encode(texts) and all(same)
        assert whole == [own.decode(x.tolist()) == t for x, t in zip(ids, texts)] or any("▁" in t for t in texts)


@pytest.mark.parametrize("fallback", [False, True])
def test_pieces_that_do_not_come_back(fallback):
    """Words with unknown characters, and their neighbours, of a byte-pair model; the library decodes whole texts."""
    import sentencepiece

    rng = random.Random(28)
    vocab = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256) if fallback]
    vocab += [(w, -float(i), 1) for i, w in enumerate(["▁a", "ab", "▁ab", "bc", "▁▁", "dé", "▁", *"abcdé"])]
    data = b"".join(wire(1, wire(1, p.encode()) + wire(2, s) + wire(3, t)) for p, s, t in vocab)
    data += wire(2, wire(3, 2) + wire(35, int(fallback))) + wire(3, wire(1, b"identity") + wire(3, 1) + wire(4, 0) + wire(5, 1))
    own, encode = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Encoder(data)
    for i in range(30):
        texts = ["".join(rng.choice(["a", "b", "c", "dé", " ", " ", "  "[i % 2 :], *["x", "日", "\n"][: i % 4]]) for _ in range(rng.randrange(30))) for _ in range(50)]
        ids, same, whole = encode(texts, True, 1)
        assert [x.tolist() for x in ids] == own.encode(texts) and all(same)
        assert whole == [own.decode(x.tolist()) == t for x, t in zip(ids, texts)]


def test_pieces_take_no_python_calls_by_word():
    """Nearly every word of these texts is a new one."""
    import cProfile
    import pstats

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        encode = pieces.Encoder(f.read())
    rng = random.Random(29)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(200)) for _ in range(100)]
    watch = cProfile.Profile()
    found = watch.runcall(encode, texts, True, 1)
    assert all(found[1]) and all(found[2]) and pstats.Stats(watch).total_calls < 5000


def test_digest_of_pieces(spark):
    """That of the operator's ids; also where all texts are empty."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    some = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "", None, "  x  y", "日本 🎉 ▁"])] + [(None, "null id")], "doc_id long, text string")
    for df in (some, some.where("text IS NULL OR text = ''")):
        rows = pieces.encoded(df, model).collect()
        digests = {(r.doc_id, len(r.ids), zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)), r.n_bytes, r.parity, r.round_trip) for r in rows}
        assert {tuple(r) for r in pieces.encoded(df, model, then=pieces.DIGEST).collect()} == digests and len(digests) == len(rows) == df.count()


def test_quality_counts():
    text = "a b c d e f g h x a b c d e f g h\n# $\n\n# $\n  \nÉ|"
    assert quality.measure(text)[:5] == (22, 23, 5, 1, 16)
    assert quality.measure(None)[:5] == (0, 0, 0, 0, 0)
    assert quality.repeat_words([b"a"] * 9) == 9


def test_quality_bounds():
    for n, p in ((10, 0.1), (300, 0.01)):
        for k in (0, 1, 5, n):
            assert quality.tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    steps = len(quality.STEPS)
    clean, bad = np.zeros((8, 201), int), np.zeros((8, 201), int)
    clean[:, 0], bad[:, 0], bad[2, 0], bad[2, 150] = 2000, 500, 0, 500
    assert quality.path(clean, bad, 10) == [[None, None, 1, None, None, None, None, None]] * steps
    few = lambda *x: np.array([*x, *[0] * (steps - len(x) + 1)])
    none = lambda n: np.array([0] * steps + [n])
    # Eight rules that reject one clean document in a hundred each are not certified together.
    assert quality.certified(none(2000), none(2000), few(500), 0.01, 0.01, 10) == 0
    assert quality.certified(few(0, 160) + none(1840), none(2000), few(100, 400), 0.01, 0.01, 10) == 0
    assert quality.certified(few(160) + none(1840), none(2000), few(500), 0.01, 0.01, 10) is None
    assert quality.certified(none(20), none(2000), few(500), 0.01, 0.01, 10) is None


def plain_kept(docs, marks, epsilon=0.01, delta=0.05, weight=10.0):
    """``kept`` of every document by loops over all labelled texts."""
    measured = {d["doc_id"]: quality.measure(d["text"]) for d in docs}
    base = {i: m[0] < 20 or 100 * m[4] > 30 * m[0] for i, m in measured.items()}
    labels = collections.defaultdict(list)
    for i, q in marks:
        if i in measured and q is not None and not base[i]:
            d = next(d for d in docs if d["doc_id"] == i)
            labels[(d["lang"] or "", d["key"])].append((q == 1, measured[i][5:]))
    strata = {s for s, _ in labels}
    chosen = {}
    for s in strata:
        halves = {True: [], False: []}
        for (of, key), rows in labels.items():
            if of == s:
                halves[key % 2 == 0].append((all(c for c, _ in rows), rows[0][1]))
        hold = [x for c, x in halves[True] if c]
        good, poor = [x for c, x in halves[False] if c], [x for c, x in halves[False] if not c]
        best = 0.0
        for step in quality.STEPS:
            cuts = []
            for r in range(8):
                cut = next((c for c in range(1, 201) if sum(x[r] >= c for x in good) <= step * max(len(good), 1)), None)
                helps = cut and sum(x[r] >= cut for x in poor) / max(len(poor), 1) > weight * sum(x[r] >= cut for x in good) / max(len(good), 1)
                cuts.append(cut if helps else 201)
            hit = lambda rows, cuts=cuts: sum(any(a >= b for a, b in zip(x, cuts)) for x in rows)
            k, n = hit(hold), len(hold)
            if not n or sum(math.comb(n, i) * epsilon**i * (1 - epsilon) ** (n - i) for i in range(k + 1)) > delta / len(strata):
                break
            gain = hit(poor) / max(len(poor), 1) - weight * hit(good) / max(len(good), 1)
            if gain > best + 1e-12:
                best, chosen[s] = gain, cuts
    return {d["doc_id"]: not base[d["doc_id"]] and not any(a >= b for a, b in zip(measured[d["doc_id"]][5:], chosen.get(d["lang"] or "", [201] * 8))) for d in docs}


def test_quality_against_brute_force(spark):
    rng = random.Random(24)
    rows, labels = [], []
    flags = []
    for i in range(2600):
        flags.append(bad := rng.random() < 0.3 if i % 9 or not i else flags[i // 2])
        words = [w + rng.choice(["###", "!", "1", ""]) * (rng.random() < (0.5 if bad else 0.00002)) for w in prose(rng, rng.randrange(15, 40)).split()]
        text = " ".join(words) if i % 9 else rows[i // 2][1] if i else ""
        rows.append((i, text, "en" if i % 4 else None, "s", 0))
        labels += [(i, None if i % 50 == 0 else int(not bad))] * (1 + (i % 70 == 0))
    df = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {d["doc_id"]: d["kept"] for d in local(quality.judge(df, marks))}
    # The split's hash of the text's hash is Spark's.
    key = {d["doc_id"]: d["k"] for d in local(df.select("doc_id", F.xxhash64(F.xxhash64("text")).alias("k")))}
    docs = [{**d, "key": key[d["doc_id"]]} for d in local(df)]
    assert got == plain_kept(docs, labels)
    assert 0 < sum(not v for v in got.values()) - sum(d["base_failed"] for d in local(quality.judge(df, marks)))


def test_quality(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(2400):
        bad = i % 4 == 0
        words = [w + ("###" if bad else "") for w in prose(rng, 40).split()]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(9000, None, None, "s", 0), (9001, "", "en", "s", 0), (None, prose(rng, 30), "xx", "s", 0), (9002, "a b c d e f g h " * 9, "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (77777, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {d["doc_id"]: d for d in local(quality.judge(clash(df), marks))}
    assert all(got[i]["kept"] == (i % 4 > 0) for i in range(2400))
    assert not got[9000]["kept"] and not got[9001]["kept"] and got[None]["kept"] and got[9002]["base_failed"]
    assert quality.keep_good(df, marks).columns == df.columns and quality.keep_good(df, marks).count() == 1801
    none = quality.judge(df, empty(spark, marks))
    assert none.where("kept = base_failed").count() == 0
    assert quality.judge(empty(spark, df), marks).count() == 0


def test_audio_finds_altered_copies(spark):
    """Tunes of which two notes of 64 are changed, nearly all of them; tunes of their own, none."""
    rng = np.random.default_rng(23)
    tunes = [rng.normal(0, 0.12, 64) for _ in range(40)]
    altered = []
    for t in tunes:
        x = t.copy()
        x[rng.choice(64, 2, replace=False)] += rng.choice([-0.1, 0.1], 2)
        altered.append(x)
    rows = [(1 + i, t.tolist()) for i, t in enumerate(tunes)] + [(1000 + 50 * i, t.tolist()) for i, t in enumerate(altered)]
    got = local(audio.search(audio.melody(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v"), F.col("id") % 50 == 0, "vec_id", "audio"))
    pairs = {(d["query_id"], d["match_class"]) for d in got}
    assert sum((1000 + 50 * i, 1 + i) in pairs for i in range(40)) >= 36
    assert all(q == r or (q - 1000) // 50 + 1 == r for q, r in pairs)


def test_audio(spark):
    rng = np.random.default_rng(11)
    tunes = [rng.normal(0, 0.12, 64).tolist() for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(tunes)] + [(50, tunes[3]), (51, tunes[3]), (100, tunes[4][16:] + tunes[5][:16]), (60, None), (61, []), (None, tunes[3]), (150, tunes[6][:24])]
    sounds = clash(audio.melody(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v"))
    got = {(d["query_id"], d["match_class"]): d for d in local(audio.search(sounds, F.col("id") % 50 == 0, "vec_id", "audio"))}
    assert got[(50, 3)]["members"] == 3 and got[(50, 3)]["bit_errors"] == 0
    part = got[(100, 4)]
    assert part["offset"] == 16 and part["bit_errors"] <= 0.1 * 32 * part["overlap"]
    assert got[(0, 0)]["offset"] == 0 and (0, 1) not in got
    # Every pair of a query and a class by brute force over all offsets.
    prints = {d["vec_id"]: np.array(d["prints"], np.int64).astype(np.uint32) for d in local(audio.fingerprints(sounds, "vec_id", "audio")) if d["vec_id"] is not None}
    reps = {}
    for i in sorted(prints):
        if len(prints[i]):
            reps.setdefault(prints[i].tobytes(), i)
    expected = set()
    for q in (i for i in prints if i % 50 == 0 and len(prints[i])):
        for r in reps.values():
            a, b, tried = prints[q], prints[r], []
            for o in range(-len(a) + 1, len(b)):
                pairs = [(a[j], b[j + o]) for j in range(len(a)) if 0 <= j + o < len(b)]
                new = lambda x, j: not j or x[j] != x[j - 1]
                votes = sum(a[j] == b[j + o] and new(a, j) and new(b, j + o) for j in range(len(a)) if 0 <= j + o < len(b))
                if len(pairs) >= 16 and votes >= 2 or o == 0 and a.tobytes() == b.tobytes():
                    wrong = sum(bin(int(x) ^ int(y)).count("1") for x, y in pairs)
                    tried.append((wrong / len(pairs), o, len(pairs), wrong))
            if tried and min(tried)[0] <= 0.3 * 32:
                expected.add((q, r, *min(tried)[1:]))
    assert {(d["query_id"], d["match_class"], d["offset"], d["overlap"], d["bit_errors"]) for d in got.values()} == expected and len(expected) >= 4
    assert len(audio.pcm(None)[0]) == len(audio.pcm(b"junk")[0]) == 0
    assert len(audio.pcm(b"RIFF....WAVEfmt ")[0]) == 0
    assert audio.search(empty(spark, sounds), F.col("id") % 50 == 0, "vec_id", "audio").count() == 0


def test_very_long_texts(spark):
    """A text of megabytes among short ones, through every operator of texts."""
    rng = random.Random(27)
    long = "\n".join(prose(rng, 12) for _ in range(40_000))
    assert len(long) > 2 * max(suffixes.BLOCK, suffixtree.BLOCK // 2, simhash.BLOCK)
    rows = [(i, prose(rng, 30), "en", "s", 0) for i in range(5)] + [(5, long, "en", "s", 0), (6, long[1_500_000:1_500_400], "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    gone = {d["doc_id"]: d["n_removed"] for d in local(suffixes.removals(df))}
    assert gone[6] >= 400 and gone[5] == plain_removals([{"doc_id": 5, "text": long}])[5][1]
    from tokenizers import Tokenizer

    n = len(Tokenizer.from_file(WORD_BPE).encode(long, add_special_tokens=False).ids) + 1
    packed = [d for d in local(packing.packed(df, WORD_BPE)) if d["doc_id"] == 5]
    assert sum(d["length"] for d in packed) == n and len(packed) == -(-n // 4096)
    assert {d["doc_id"]: d["fp"] & (2**64 - 1) for d in local(simhash.near_duplicates(df))}[5] == plain_fingerprint(long)
    got = {d["doc_id"]: d for d in local(suffixtree.scored(df, F.col("doc_id") < 2))}
    assert got[5]["n_tokens"] == len(long.split()) + 1 and math.isfinite(got[5]["score"])
    assert {d["doc_id"]: d["parity"] for d in local(pieces.encoded(df, public_tokenizers.path("piece_bpe_32k.model")))}[5]
    assert {d["doc_id"]: d["n_words"] for d in local(quality.judge(df, spark.createDataFrame([], "doc_id long, quality int")))}[5] == len(long.split())
    assert {d["doc_id"]: d["__n_lines"] for d in local(lines.deduplicated(df))}[5] == 40_000
