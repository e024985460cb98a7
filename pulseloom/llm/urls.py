"""URL verdicts by host rules and link-graph propagation, in DataFrame functions only.

Pages whose url fits a rule take the verdict of the longest rule that fits. For the others, hosts are judged by the
links between hosts: trust spreads along links from trusted seeds (personalised PageRank), distrust spreads against
them from blocked seeds (a host is suspect when it links to suspect hosts), until no score changes any more. Both are
taken as shares of what the host would receive if every host were a seed, so that many links to one seed, which each get
a small part of it, make none of the linking hosts less suspect. A host is blocked when its share of distrust exceeds
that of trust by a threshold. Seeds are hosts of which more than half of the pages fall to rules of one verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import discard, stored, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and protocol-relative link targets; relative ones stay on their host and say nothing about others.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
#: Up to so many rules become one expression; more are a table that is joined, with the same verdicts.
INLINE_RULES = 200
#: Scores that spread: those from seeds, and those if every host were one. Trust goes along links, distrust against them.
SCORES = ("trust", "distrust", "most_trust", "most_distrust")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: from there up to ``? #`` or
    the end. Both are empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, of equally long ones the last; nulls where none does. A rule is
    ``host/path``; it fits its host and all subdomains where the path starts with the rule's."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def with_rules(placed: DataFrame, rules: Sequence[tuple[str, str]], inline: int = INLINE_RULES) -> DataFrame:
    """``placed`` with ``__rule`` and ``__by_rule``, the verdict of the rule. More than ``inline`` rules are joined by
    the suffixes of distinct hosts, of which a host has as many as it has labels."""
    if len(rules) <= inline:
        rule, verdict = longest_rule(F.col("__host"), F.col("__path"), rules)
        return placed.withColumns({"__rule": rule, "__by_rule": verdict})
    rows = [(text.partition("/")[0], "".join(text.partition("/")[1:]), len(text), i, text, what) for i, (what, text) in enumerate(rules)]
    known = placed.sparkSession.createDataFrame(rows, "__name string, __start string, __size int, __order int, __rule string, __by_rule string")
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spots = placed.select("__host", "__path").distinct().withColumn("__name", F.explode(suffixes))
    fits = spots.join(known, "__name").where(F.col("__path").startswith(F.col("__start")))
    best = fits.groupBy("__host", "__path").agg(F.max(F.struct("__size", "__order", "__rule", "__by_rule")).alias("__best"))
    return placed.join(best, ["__host", "__path"], "left").select(*placed.columns, "__best.__rule", "__best.__by_rule")


def host_edges(pages: DataFrame, host: Column, html_col: str) -> DataFrame:
    """``(src, dst, n)``: links between different hosts, counted once a page and target."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1), lambda x: F.translate(x, UPPER, LOWER)))
    return (
        pages.select(host.alias("src"), F.explode(targets).alias("dst"))
        .where("src != '' AND dst != '' AND src != dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def _dealt(edges: DataFrame, now: DataFrame, damping: float) -> DataFrame:
    """What hosts receive over their links in a round."""

    def over(come: str, go: str, part: str, kinds: tuple[str, ...]) -> DataFrame:
        given = [(damping * F.col(c) * F.col(part) if c in kinds else F.lit(0.0)).alias(c) for c in SCORES]
        return edges.join(now, edges[come] == now["host"]).select(F.col(go).alias("host"), *given)

    return over("src", "dst", "fwd", SCORES[::2]).union(over("dst", "src", "back", SCORES[1::2]))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """``(host, *SCORES)``: what every host receives from others, from ``seeds(host, trusted, blocked)`` of zeros and ones.

    Every seed starts with mass ``1 - damping`` and gets it again each round. Trust is dealt along a host's links in
    proportion to their counts, distrust against the links that reach a host. Rounds go on until no score changes by
    more than ``tolerance`` of what the host would have if every host were a seed; as changes shrink by ``damping`` a
    round, no share is then off by more than about ``tolerance / (1 - damping)``.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    edges = written(
        edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("fwd"), (F.col("n") / F.col("into")).alias("back")),
        "host-edges",
    )
    spark = edges.sparkSession
    every = seeds.select("host", "trusted", "blocked").union(edges.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0), F.lit(0)))
    every = every.groupBy("host").agg(F.max("trusted").alias("trusted"), F.max("blocked").alias("blocked"))
    start = (F.col("trusted"), F.col("blocked"), F.lit(1), F.lit(1))
    base = written(every.select("host", *[((1 - damping) * c).alias(n) for n, c in zip(SCORES, start)]), "host-base")
    none = [F.lit(0.0).alias(f"was_{c}") for c in SCORES]
    path, now = None, base
    while True:
        was = now.select("host", *[F.lit(0.0).alias(c) for c in SCORES], *[F.col(c).alias(f"was_{c}") for c in SCORES])
        new = base.union(_dealt(edges, now, damping)).select("host", *SCORES, *none).union(was)
        summed = new.groupBy("host").agg(*[F.sum(c).alias(c) for c in (*SCORES, *[f"was_{c}" for c in SCORES])])
        before, path = path, stored(summed, "host-scores")
        now = spark.read.schema(summed.schema).parquet(path)
        change = F.greatest(*[F.abs(F.col(c) - F.col(f"was_{c}")) / F.col(SCORES[2 + i % 2]) for i, c in enumerate(SCORES)])
        if before:
            discard(spark, before)
        if (now.agg(F.max(change)).first()[0] or 0.0) <= tolerance:
            break
    return _dealt(edges, now.select("host", *SCORES), damping).groupBy("host").agg(*[F.sum(c).alias(c) for c in SCORES])


def shares(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """``(host, trust, distrust)`` from 0 to 1: what a host receives from seeds over what it receives when every host
    is a seed. A seed has 1 of its own kind."""
    own = seeds.select("host", F.col("trusted").cast("double").alias("own_trust"), F.col("blocked").cast("double").alias("own_distrust"))
    edges = written(edges, "host-edges")
    if edges.isEmpty():
        return own.select("host", F.col("own_trust").alias("trust"), F.col("own_distrust").alias("distrust"))
    met = propagate(seeds, edges, damping, tolerance).join(own, "host", "full")
    share = lambda c: F.when(F.col(f"own_{c}") == 1, 1.0).when(F.col(c) > 0, F.col(c) / F.col(f"most_{c}")).otherwise(0.0).alias(c)
    return met.select("host", share("trust"), share("distrust"))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    url_col: str = "url",
    html_col: str = "html",
    threshold: float = 0.05,
    damping: float = 0.85,
    tolerance: float = 1e-3,
) -> DataFrame:
    """``pages`` with columns ``__host, __path, __rule, __verdict``.

    Null urls and urls without ``://`` have an empty host and path, fit no rule, take part in no graph and are
    allowed. Null or empty html has no links. Repeated pages count repeatedly. Hosts without seeds in reach are
    allowed. ``threshold`` is on the share of distrust less that of trust; a seed has 1.
    """
    host, path = host_and_path(F.col(url_col))
    placed = pages.withColumns({"__host": host, "__path": path})
    placed = with_rules(placed, rules)
    more_than_half = lambda v: (2 * F.count_if(F.col("__by_rule") == v) > F.count("*")).cast("int")
    seeds = (
        placed.where("__host != ''")
        .groupBy(F.col("__host").alias("host"))
        .agg(more_than_half("allow").alias("trusted"), more_than_half("block").alias("blocked"))
    )
    scores = shares(written(seeds, "host-seeds"), host_edges(placed, F.col("__host"), html_col), damping, tolerance)
    bad = written(scores.where(F.col("distrust") - F.col("trust") >= threshold).select(F.col("host").alias("__host"), F.lit("block").alias("__by_host")), "hosts-blocked")
    return placed.join(bad, "__host", "left").select(
        *[F.col(c) for c in pages.columns], "__host", "__path", "__rule",
        F.coalesce("__by_rule", "__by_host", F.lit("allow")).alias("__verdict"),
    )
