"""Streams of text: tokens as they come, and counts of words by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khamkit.functions.text import TextFunctions
from khamkit.sources.lexicons import model_lexicon, packaged


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder, a row a line."""
    return spark.readStream.text(path)


def joined_tokens(lines: DataFrame, functions: TextFunctions, separator: str = "|") -> DataFrame:
    return lines.select(functions.join("value", separator).alias("value"))


def windowed_counts(stream: DataFrame, time: str, text: str, window: str = "5 minutes", late: str = "10 minutes", functions: TextFunctions | None = None) -> DataFrame:
    """(start, token, n) of words by window of event time, Thai ones by ``functions`` (the packaged lexicon if none); rows later than ``late`` are left out."""
    functions = functions or TextFunctions(model_lexicon(packaged(stream.sparkSession)))
    words = stream.withWatermark(time, late).select(F.col(time), F.explode(functions.tokens(text)).alias("token"))
    counts = words.groupBy(F.window(time, window), "token").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), "token", "n")
