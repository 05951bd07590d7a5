"""Lexicon operators on tables (word, weight)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khamkit.sources.lexicons import apply_weights, merge_highest


def add(lexicon: DataFrame, words: DataFrame) -> DataFrame:
    """``lexicon`` with further words; a word that is there keeps the higher weight."""
    return merge_highest(lexicon.unionByName(words.select("word", "weight")))


def set_weights(lexicon: DataFrame, weights: DataFrame) -> DataFrame:
    """``lexicon`` with new weights, also lower ones, for words it has."""
    return apply_weights(lexicon, weights)


def contains(df: DataFrame, lexicon: DataFrame, column: str = "token") -> DataFrame:
    """Rows of ``df`` whose ``column`` is a word."""
    return df.join(lexicon.select(F.col("word").alias(column)), column, "left_semi")


def missing(df: DataFrame, lexicon: DataFrame, column: str = "token") -> DataFrame:
    return df.join(lexicon.select(F.col("word").alias(column)), column, "left_anti")


def with_weight(df: DataFrame, lexicon: DataFrame, column: str = "token", into: str = "weight") -> DataFrame:
    """``df`` with each word's weight, 0 for others."""
    own = lexicon.select(F.col("word").alias(column), F.col("weight").alias("__weight"))
    return df.join(own, column, "left").withColumn(into, F.coalesce("__weight", F.lit(0.0))).drop("__weight")


def stats(lexicon: DataFrame) -> DataFrame:
    """One row: words, total_weight, max_weight (1 at least)."""
    return lexicon.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"), F.greatest(F.coalesce(F.max("weight"), F.lit(1.0)), F.lit(1.0)).alias("max_weight"))


def word_cost(weight: Column, max_weight: Column) -> Column:
    """-ln of the share of the largest weight, at least 1e-9; 10 for weights of 0 or less."""
    share = F.least(F.greatest(weight / max_weight, F.lit(1e-9)), F.lit(1.0))
    return F.when(weight <= 0, F.lit(10.0)).otherwise(-F.ln(share))


def prefix_table(lexicon: DataFrame) -> DataFrame:
    """(prefix, weight): every beginning of a word, with weight 0 unless it is a word."""
    starts = lexicon.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.struct(F.substring("word", 1, n).alias("prefix"), F.when(n == F.length("word"), F.col("weight")).otherwise(0.0).alias("weight")))).alias("p"))
    return starts.select("p.*").groupBy("prefix").agg(F.max("weight").alias("weight"))


#: A lexicon of at most so many words is sent to the tasks that look them up.
SENT_WORDS = 200_000


def prefixes_in(df: DataFrame, lexicon: DataFrame, text: str = "text", most: int = 40) -> DataFrame:
    """``df`` with one row for each place and word that begins there: start, word, weight.

    Only beginnings of the lengths that words have meet the lexicon, in an
    equi-join; a small lexicon, counted first, is broadcast.
    """
    words = lexicon.where(F.length("word") <= most).select("word", "weight")
    sizes = words.select(F.length("word").alias("size")).distinct()
    lengths = sorted(r["size"] for r in sizes.collect())  # at most ``most`` of them
    if not lengths:
        return df.where("false").select("*", F.lit(0).alias("start"), F.lit("").alias("word"), F.lit(0.0).alias("weight"))
    n = F.length(text)
    places = df.where(n > 0).withColumn("start", F.explode(F.sequence(F.lit(0), n - 1)))
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda size: size <= n - F.col("start"))
    begun = places.withColumn("word", F.explode(F.transform(fitting, lambda size: F.substring(F.col(text), F.col("start") + 1, size))))
    few = words.limit(SENT_WORDS + 1).count() <= SENT_WORDS
    return begun.join(F.broadcast(words) if few else words, "word").select(*df.columns, "start", "word", "weight")


def ranked(sources: list[DataFrame], last_wins: bool) -> DataFrame:
    """One row a word, from the first (or last) source that has it; within one, from its largest weight."""
    rows = reduce(DataFrame.unionByName, [s.select("word", "weight", F.lit(k).alias("source")) for k, s in enumerate(sources)])
    order = F.desc("source") if last_wins else F.asc("source")
    best = Window.partitionBy("word").orderBy(order, F.desc("weight"))
    return rows.withColumn("place", F.row_number().over(best)).where("place = 1").select("word", "weight")


def merge_later_wins(*sources: DataFrame) -> DataFrame:
    return ranked(list(sources), True).withColumn("weight", F.round("weight", 2))


def merge_first_wins(*sources: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    out = ranked(list(sources), False)
    return out if weights is None else apply_weights(out, weights)


def bigrams_of(tokens: DataFrame, by: str, position: str = "pos", token: str = "token") -> DataFrame:
    """(prev, next, count) of neighbouring tokens, of a table with a row a token."""
    order = Window.partitionBy(by).orderBy(position)
    pairs = tokens.select(F.col(token).alias("prev"), F.lead(token).over(order).alias("next")).where(F.col("next").isNotNull())
    return pairs.groupBy("prev", "next").agg(F.count(F.lit(1)).cast("double").alias("count"))


def bigrams_in(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(prev, next, count) of neighbouring tokens, of a table with an array of them a row.

    Neighbours are paired inside the array, so only counts are shuffled.
    """
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(tokens, 1, n).alias("prev"), F.slice(tokens, 2, n).alias("next"))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.prev", "p.next").agg(F.count(F.lit(1)).cast("double").alias("count"))


def add_bigrams(bigrams: DataFrame, more: DataFrame) -> DataFrame:
    """``bigrams`` with further pairs; counts of pairs that are there are replaced."""
    kept = bigrams.select("prev", "next", "count").join(more.select("prev", "next"), ["prev", "next"], "left_anti")
    return kept.unionByName(more.select("prev", "next", "count"))


def bigram_counts(pairs: DataFrame, bigrams: DataFrame) -> DataFrame:
    """``pairs`` (prev, next) with ``has`` and ``count`` (0 if there is none)."""
    own = bigrams.select("prev", "next", F.col("count").alias("found"))
    return pairs.join(own, ["prev", "next"], "left").withColumns({"has": F.col("found").isNotNull(), "count": F.coalesce("found", F.lit(0.0))}).drop("found")


def bigram_bonuses(bigrams: DataFrame, alpha: float = 0.15, formula: str = "count") -> DataFrame:
    """``bigrams`` with ``bonus``, what a pair takes off the cost of its second word, by one of the three formulas."""
    firsts = bigrams.groupBy("prev").agg(F.sum("count").alias("first"))
    rows = bigrams.join(firsts, "prev")
    n = F.col("count")
    ways = {"count": F.ln(1 + n) / F.length("next"), "pmi": F.ln(1 + n) / F.ln(1 + F.col("first")), "probability": F.ln(1 + n / F.col("first")) / F.length("next")}
    if formula not in ways:
        raise ValueError(f"no bigram formula {formula!r}")
    bonus = F.lit(float(alpha)) * ways[formula] if alpha > 0 else F.lit(0.0)
    return rows.select("prev", "next", "count", bonus.alias("bonus"))


def set_weights_told(lexicon: DataFrame, weights: DataFrame) -> DataFrame:
    """(word, applied) for each word of ``weights``: whether the lexicon has it, so that its weight was set."""
    own = lexicon.select("word", F.lit(True).alias("own"))
    return weights.select("word").distinct().join(own, "word", "left").select("word", F.coalesce("own", F.lit(False)).alias("applied"))


def overlaid(base: DataFrame, overlay: DataFrame, df: DataFrame, column: str = "token", into: str = "weight") -> DataFrame:
    """``df`` with each word's weight: the overlay's, else the base's, else 0. Neither lexicon is merged or changed."""
    top = with_weight(df, overlay, column, "__overlay")
    return with_weight(top, base, column, "__base").withColumn(into, F.when(F.col("__overlay") > 0, F.col("__overlay")).otherwise(F.col("__base"))).drop("__overlay", "__base")
