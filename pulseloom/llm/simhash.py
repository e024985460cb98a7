"""SimHash near-duplicates by multi-index hashing.

Every text gets a 64-bit fingerprint: bit b is one if it is one in more than half of the XXH64 (seed 42) hashes of
its word shingles. Two fingerprints that differ in at most three bits differ in at most one bit in one of their two
32-bit halves. So each half has a table (half -> fingerprint), each fingerprint enumerates the 33 values of the ball
of radius one about each of its halves, fetches the equal table entries by an equi-join and checks the complete
distance inside the join. Components of the links give the near-duplicate groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import components, written

#: Hashes expanded to bits at a time: 64 bytes each.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer; null, empty or blank texts have zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    at = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
    if len(words) < shingle:
        hashes = [digest(joined, 42)]
    else:
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip(at, at[shingle:])]
    h = np.array(hashes, np.uint64).view(np.uint8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8 * BLOCK):
        ones += np.unpackbits(h[i : i + 8 * BLOCK], bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id_col, fp bigint)`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "fp": pd.array([fingerprint(t, shingle) for t in b[text_col]], "int64")})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, fp bigint")


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs ``(u, v)`` of the ``rep`` values of distinct fingerprints ``(fp, rep)`` at most ``max_bits`` apart."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves and balls of radius one cover distances up to 3")
    half = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))]
    table = prints.select("fp", "rep", F.explode(F.array(half[0], half[1] + F.lit(1 << 32))).alias("key"))
    ball = [m for m in [0] + [1 << b for b in range(32)]]
    probes = prints.select(
        F.col("fp").alias("fp_a"),
        F.col("rep").alias("rep_a"),
        F.explode(
            F.concat(
                F.transform(F.array(*[F.lit(m).cast("bigint") for m in ball]), lambda m: half[0].bitwiseXOR(m)),
                F.transform(F.array(*[F.lit(m).cast("bigint") for m in ball]), lambda m: half[1].bitwiseXOR(m) + F.lit(1 << 32)),
            )
        ).alias("key"),
    )
    near = (F.col("fp_a") < F.col("fp")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp"))) <= max_bits)
    return probes.join(table, (probes.key == table.key) & near).select(F.col("rep_a").alias("u"), F.col("rep").alias("v"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """One row per document: ``id_col, fp bigint, component_id`` (smallest id reachable over links, itself included).

    Rows with a null id keep their fingerprint, have a null component and link nothing. Null, empty and blank texts
    have fingerprint zero and link like others. Repeated ids and texts, and equal fingerprints, fall in one component.
    Other columns are ignored. Fingerprints that several documents share are joined once, by their smallest id.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    reps = written(prints.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("rep")), "simhash-reps")
    groups = components(links(reps, max_bits))
    of = reps.join(groups, reps.rep == groups.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    found = prints.join(of, "fp", "left")
    return found.select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))
