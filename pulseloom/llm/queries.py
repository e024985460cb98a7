"""Thin queries over the given tables, one for each operator, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, language, lines, packing, periodic, phrases, pieces, quality, simhash, suffixes, suffixtree, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recordings are the vectors played as tunes."""
    tunes = audio.melody(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return audio.search(tunes, F.col("id") % 50 == 0, "vec_id", "audio")


def op3_suffixtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return suffixtree.scored(table(spark, sf_dir, "documents"), held_out)


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removals(table(spark, sf_dir, "documents"))


#: The rules of the query: (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(table(spark, sf_dir, "pages"), RULES)
    return found.select("page_id", *[F.col(f"__{c}").alias(c) for c in ("host", "path", "rule", "verdict")])


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, looked up by its url."""
    pages = table(spark, sf_dir, "pages")
    stored = warc.archives(pages)
    found = warc.look_up(pages, stored, warc.index(stored))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), then=pieces.DIGEST)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text gets the nearest language; the score of a text that is rejected is zero."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out)
    found = language.predicted(docs, ~F.col("held_out"))
    return found.select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.when(F.col("__rejected"), 0.0).otherwise(F.col("__cosine")).alias("score"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the texts repeat a stretch of theirs, by the query's rule."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digest(periodic.repeated(periodic.with_planted_runs(docs)))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lines": op1_lines,
        "op2_audio": op2_audio,
        "op3_suffixtree": op3_suffixtree,
        "op4_suffixes": op4_suffixes,
        "op5_urls": op5_urls,
        "op6_warc": op6_warc,
        "op7_packing": op7_packing,
        "op8_simhash": op8_simhash,
        "op9_pieces": op9_pieces,
        "op10_quality": op10_quality,
        "op11_language": op11_language,
        "op12_runs": op12_runs,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_lines": lines.ORACLE, "op6_warc": warc.ORACLE, "op13_phrases": phrases.ORACLE}
