"""The corpus queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khamkit.llm import licenses, oracles, sketches, toxicity, urls, wrappers
from khamkit.llm.common import table
from khamkit.llm.mixing import Mixture
from khamkit.llm.packing import packed, tokenizer_path
from khamkit.llm.quality import quality_rules
from khamkit.llm.simhash import near_duplicates
from khamkit.llm.substring import substring_dedup


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Mixture(table(spark, sf_dir, "documents")).plan()
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = sketches.likeness_to_next(table(spark, sf_dir, "documents"))
    return near.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        sketches.printed("sketch").alias("fingerprint"),
        sketches.printed("edited_sketch").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "in_edited",
        "distinct_shingles",
    )


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, urls.listed(pages)).select("page_id", "host", "path", "rule", "verdict")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "by_wrapper")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring": op1_substring,
        "op2_licenses": op2_licenses,
        "op3_packing": op3_packing,
        "op4_simhash": op4_simhash,
        "op5_mixing": op5_mixing,
        "op6_fingerprints": op6_fingerprints,
        "op7_urls": op7_urls,
        "op8_toxicity": op8_toxicity,
        "op9_html": op9_html,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLE)
