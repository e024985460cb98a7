"""A corpus pipeline of five stages, each over all that its predecessor kept.

Quality rules drop documents; line dedup cuts repeated runs of lines; SimHash near-dedup keeps the document with the
smallest id of each group (five-word shingles, fingerprints at most three bits apart); suffix dedup cuts repeated
strings of 50 bytes and drops documents of which nothing but white space is left; best-fit packing places the tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm import lines, packing, quality, simhash, suffixes
from pulseloom.llm.tables import written

SHINGLE = 5
CAPACITY, END_ID = 4096, 1


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars``, where the documents have it, counts the text as it is now."""
    kind = dict(docs.dtypes).get("n_chars")
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind)) if kind else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(lines.deduplicated(docs).select(*docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(docs, shingle=SHINGLE)
    later = written(found.where("component_id < doc_id").select("doc_id").distinct(), "near-copies")
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(suffixes.deduplicated(docs).where(F.col("text").rlike(lines.FULL)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY, END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: Calibrated cutoffs, components and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
