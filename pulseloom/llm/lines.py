"""Line dedup by winnowing over line hashes, in DataFrame functions only.

The lines of a text that hold more than white space form a sequence of hashes. Of every ``window`` neighbouring
hashes the smallest (the first of equals) is selected as a fingerprint, so any run of ``window`` lines holds one, at
the same place wherever the run occurs. Fingerprints that occur once match nothing and go. Those that repeat are
joined with their positions, and each match is extended both ways over the lines about it: every run of ``window``
lines through the fingerprint is compared with the earliest equal run (smallest document, then smallest place).
Runs that are not the earliest are deleted; overlapping ones merge into longer runs by deleting the union of their
lines. Work is linear: a position meets the earliest run only, never all its copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FULL = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_runs(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, th, lines array<int>)``: for each later repeated run of ``window`` lines the indices of its lines."""
    text = F.col(text_col)
    numbered = F.transform(_lines(text), lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), x.rlike(FULL).alias("full")))
    seq = (
        docs.where(F.col(id_col).isNotNull() & text.isNotNull())
        .select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.filter(numbered, lambda x: x["full"]).alias("seq"))
        .where(F.size("seq") >= window)
        .select("id", "th", F.col("seq.at").alias("at"), F.col("seq.h").alias("h"))
    )
    ranked = F.transform("h", lambda h, j: F.struct(h.alias("h"), j.alias("j")))
    minima = F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.size("h") - window + 1), lambda s: F.array_min(F.slice("ranked", s, window)))
    )
    first = F.greatest(F.col("print.j") - (window - 1), F.lit(0))
    prints = (
        seq.withColumn("ranked", ranked)
        .select("id", "th", "at", "h", F.explode(minima).alias("print"))
        .select(
            "id",
            "th",
            F.col("print.h").alias("print"),
            F.col("print.j").alias("j"),
            first.alias("left"),
            F.slice("h", first + 1, F.lit(2 * window - 1)).alias("near"),
            F.slice("at", first + 1, F.lit(2 * window - 1)).alias("near_at"),
        )
    )
    again = prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    matched = prints.join(again, "print", "left_semi")
    # Runs through the fingerprint begin up to window - 1 lines before it; what lies beyond the text's ends falls away.
    last = F.least(F.size("near") - window, F.col("j") - F.col("left"))
    runs = (
        matched.where(last >= 0)
        .select("id", "th", "left", "near", "near_at", F.explode(F.sequence(F.lit(0), last)).alias("s"))
        .select(
            "id",
            "th",
            (F.col("left") + F.col("s")).alias("start"),
            F.slice("near", F.col("s") + 1, F.lit(window)).alias("run"),
            F.slice("near_at", F.col("s") + 1, F.lit(window)).alias("lines"),
        )
        .select("id", "th", "start", F.xxhash64("run").alias("k1"), F.hash("run").alias("k2"), "lines")
    )
    earliest = (
        runs.groupBy("k1", "k2")
        .agg(F.min(F.struct("id", "th", "start")).alias("e"), F.max(F.struct("id", "th", "start")).alias("l"))
        .where("e < l")
        .select("k1", "k2", "e")
    )
    return runs.join(earliest, ["k1", "k2"]).where(F.struct("id", "th", "start") > F.col("e")).select("id", "th", "lines")


def deduplicated(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` less its later repeated runs, and columns ``__n_lines`` and ``__n_removed`` (int).

    White-space lines match nothing and stay. Texts of fewer than ``window`` full lines, empty and null texts stay as
    they are (a null has no lines), as do documents with a null id. Rows with equal id and text are one document that
    occurs on several rows: they lose the same lines. Equal ids with different texts are told apart by their texts.
    Columns may have any names but those beginning with two underscores.
    """
    text = F.col(text_col)
    gone = (
        repeated_runs(docs, window, id_col, text_col)
        .groupBy("id", "th")
        .agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("__gone"))
        .select(F.col("id").alias("__id"), F.col("th").alias("__th"), "__gone")
    )
    found = docs.withColumn("__key", F.xxhash64(text)).join(
        gone, (F.col(id_col) == F.col("__id")) & (F.col("__key") == F.col("__th")), "left"
    )
    lines = _lines(text)
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.array_join(F.transform(F.array_except(every, "__gone"), lambda i: F.get(lines, i)), "\n")
    return found.select(
        *[F.when(F.col("__gone").isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(F.when(text.isNotNull(), F.size(lines)), F.lit(0)).alias("__n_lines"),
        F.coalesce(F.when(F.col("__gone").isNotNull(), F.size("__gone")), F.lit(0)).alias("__n_removed"),
    )


#: The same by comparing all runs of three lines as texts.
ORACLE = r"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS ix FROM parts),
s AS (SELECT doc_id, line, ix, row_number() OVER (PARTITION BY doc_id ORDER BY ix) AS j FROM l
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, j, ix AS a0, lead(ix, 1) OVER o AS a1, lead(ix, 2) OVER o AS a2,
             line AS l0, lead(line, 1) OVER o AS l1, lead(line, 2) OVER o AS l2
      FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY ix)),
f AS (SELECT *, first_value(doc_id) OVER k AS d0, first_value(j) OVER k AS j0
      FROM w WHERE a2 IS NOT NULL WINDOW k AS (PARTITION BY l0, l1, l2 ORDER BY doc_id, j)),
gone AS (SELECT DISTINCT doc_id, unnest([a0, a1, a2]) AS ix FROM f WHERE d0 <> doc_id OR j0 <> j),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.ix) AS text FROM l ANTI JOIN gone USING (doc_id, ix)
         GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines,
       CAST(coalesce(n.n, 0) AS INTEGER) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
