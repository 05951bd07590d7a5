"""Documents through the corpus operators: quality, near-duplicates, passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. All but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khamkit.llm.common import shared_folder, table
from khamkit.llm.mixing import Mixture
from khamkit.llm.packing import packed, tokenizer_path
from khamkit.llm.quality import quality_rules
from khamkit.llm.simhash import near_duplicates
from khamkit.llm.substring import substring_dedup

#: Fingerprints of a text in the near-duplicate stage, of all its five-word shingles and of samples of them.
LANES, SAMPLES = 4, 16
WIDTH = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, unchanged."""
    return quality_rules(docs).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; of rows of that id the first by text.

    Pairs whose fingerprints are within the radius or share a sample pass the tables of distances to references,
    then the comparison of bits, then that of shingles. Documents without id can't be told apart and stay.
    """
    found = near_duplicates(docs, width=WIDTH, lanes=LANES, samples=SAMPLES)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    twice = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    alike = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(alike.select(*docs.columns))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document holds; documents nothing is left of go."""
    cut = substring_dedup(docs)
    n_chars = [F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]).alias("n_chars")] if "n_chars" in docs.columns else []
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")).alias("text")
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_words") > F.col("n_removed")))
    others = {"text": text} | ({"n_chars": n_chars[0]} if n_chars else {})
    return left.select(*[others.get(c, F.col(c)) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, in the order it sends them."""
    return Mixture(docs).rows()


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences."""
    return packed(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substrings", substrings),
    ("mixing", mixing),
    ("packing", packing),
]

#: Fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is kept in the shared folder for the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
