"""Corpus statistics and scoring of segmentations."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from khamkit.functions.chars import WHITE_SPACE


def word_counts(tokens: DataFrame, lexicon: DataFrame | None = None, token: str = "token") -> DataFrame:
    """(word, n) of tokens, of those the lexicon has if one is given.

    Tokens are counted before the lexicon is met, so what is joined is one row
    a different token.
    """
    counts = tokens.groupBy(F.col(token).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counts if lexicon is None else counts.join(lexicon.select("word"), "word", "left_semi")


def top(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), "word").limit(n)


def word_weights(counts: DataFrame, n: int, exponent: float = 0.5) -> DataFrame:
    """(word, weight) of the ``n`` most frequent words: their counts by the last one's, to a power, to four places."""
    best = top(counts, n)
    least = best.agg(F.min("n").alias("least")).first()["least"]
    return best.select("word", F.round(F.pow(F.col("n") / F.lit(least or 1), F.lit(exponent)), 4).alias("weight"))


def solid(words: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The words of a batch of rows without white space, none of them empty, and their number in each row."""
    flat = pc.replace_substring_regex(pc.fill_null(words.flatten(), ""), f"[{WHITE_SPACE}]", "")
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(full)), np.bincount(np.repeat(np.arange(len(words)), sizes)[full], minlength=len(words))


def rows_of(flat: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)


def comparable(gold: pa.ListArray, pred: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
    """Gold and predicted words without white space; rows whose texts differ beyond that have none."""
    both = solid(gold), solid(pred)
    same = pc.equal(*(pc.binary_join(rows_of(*x), "") for x in both)).to_numpy(zero_copy_only=False)
    return tuple(rows_of(flat.filter(pa.array(np.repeat(same, sizes))), sizes * same) for flat, sizes in both)


def rates(hits: str, gold: str, pred: str) -> list:
    p, r = F.col(hits) / F.nullif(F.col(pred), F.lit(0)), F.col(hits) / F.nullif(F.col(gold), F.lit(0))
    p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1")]


def placed(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a batch's words in the text of all its rows, one after another."""
    sizes = pc.utf8_length(words.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def found_in(places: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each place, where the ascending ``others`` have it; -1 if nowhere."""
    at = np.searchsorted(others, places)
    there = at < len(others)
    there[there] = others[at[there]] == places[there]
    return np.where(there, at, -1)


def right(gold: pa.ListArray, pred: pa.ListArray) -> np.ndarray:
    """Whether each gold word's span is one of the prediction's.

    The rows' texts agree and no word is empty, so places in all the batch's
    text compare, and an end belongs to one word.
    """
    (gold_starts, gold_ends), (pred_starts, pred_ends) = placed(gold), placed(pred)
    at = found_in(gold_ends, pred_ends)
    out = at >= 0
    out[out] = pred_starts[at[out]] == gold_starts[out]
    return out


def parts(words: pa.ListArray) -> np.ndarray:
    """Where the rows' words begin in the flat array, and its size."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))])


def sums(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of each row's words are marked."""
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[bounds[1:]] - total[bounds[:-1]]


COUNTED = ("word_gold", "word_pred", "word_hits", "boundary_gold", "boundary_pred", "boundary_hits")


def counted(gold: pa.Array, pred: pa.Array) -> pa.Array:
    """Words, boundaries and hits of each row."""
    gold, pred = comparable(gold, pred)
    of_gold, of_pred = parts(gold), parts(pred)
    n_gold, n_pred = np.diff(of_gold), np.diff(of_pred)
    inside = np.ones(of_gold[-1], dtype=bool)
    inside[of_gold[:-1][n_gold > 0]] = False
    also = inside & (found_in(placed(gold)[0], placed(pred)[0]) >= 0)
    columns = [n_gold, n_pred, sums(right(gold, pred), of_gold), n_gold - (n_gold > 0), n_pred - (n_pred > 0), sums(also, of_gold)]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], COUNTED)


def wrong(gold: pa.Array, pred: pa.Array) -> pa.Array:
    """The gold words of each row whose spans the prediction lacks."""
    gold, pred = comparable(gold, pred)
    bad = ~right(gold, pred)
    return rows_of(gold.flatten().filter(pa.array(bad)), sums(bad, parts(gold)))


def compared(gold: DataFrame, pred: DataFrame, function: Callable, kind: str) -> DataFrame:
    """(chunk_id, found): ``function`` over Arrow batches of the words of each chunk, which it compares inside the row."""
    call = lambda gold, pred: function(gold, pred)
    call.__annotations__ = {"gold": pa.Array, "pred": pa.Array, "return": pa.Array}
    both = gold.select("chunk_id", F.col("words").alias("gold")).join(pred.select("chunk_id", F.col("words").alias("pred")), "chunk_id")
    return both.select("chunk_id", F.arrow_udf(call, kind)("gold", "pred").alias("found"))


def score(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Two rows, of words and of boundaries: kind, n_gold, n_pred, hits, precision, recall, f1.

    A word is right if its span is; boundaries are the ends inside a chunk.
    Chunks whose texts differ, but for white space, don't count.
    """
    rows = compared(gold, pred, counted, f"struct<{', '.join(f'{c}: long' for c in COUNTED)}>")
    total = rows.agg(*[F.sum(f"found.{c}").alias(c) for c in COUNTED])
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_gold").alias("n_gold"), F.col(f"{k}_pred").alias("n_pred"), F.col(f"{k}_hits").alias("hits")) for k in ("word", "boundary")])
    both = total.select(F.explode(kinds).alias("k")).select("k.*").where("n_gold + n_pred > 0")
    return both.select("kind", "n_gold", "n_pred", "hits", *rates("hits", "n_gold", "n_pred"))


def missed(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold words whose spans the prediction lacks: chunk_id, word."""
    return compared(gold, pred, wrong, "array<string>").select("chunk_id", F.explode("found").alias("word"))


def missed_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(word, n) of missed words; they are counted before they meet a lexicon."""
    return missed(gold, pred).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def error_causes(gold: DataFrame, pred: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(cause, n) of missed words: not Thai, in the lexicon, or not in it."""
    rows = missed_counts(gold, pred).join(lexicon.select("word", F.lit(True).alias("listed")), "word", "left")
    cause = F.when(~F.col("word").rlike(r"[฀-๿]"), "non_thai").when(F.col("listed"), "in_lexicon").otherwise("not_in_lexicon")
    return rows.groupBy(cause.alias("cause")).agg(F.sum("n").alias("n"))


def unknown_words(gold: DataFrame, pred: DataFrame, lexicon: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` most frequent missed words that the lexicon lacks, ties by word."""
    rows = missed_counts(gold, pred).join(lexicon.select("word"), "word", "left_anti").where(F.col("word").rlike(r"[฀-๿]"))
    return top(rows, n)


def without_overlap(chunks: DataFrame, seen: DataFrame) -> DataFrame:
    """Chunks whose text no chunk of ``seen`` has."""
    text = F.array_join("words", "")
    return chunks.withColumn("__text", text).join(seen.select(text.alias("__text")).distinct(), "__text", "left_anti").drop("__text")


def first_chunks(chunks: DataFrame, n: int) -> DataFrame:
    return chunks.orderBy("chunk_id").limit(n)


QUANTILES = (50, 90, 95, 99)
#: The accuracy of the sketch that proposes where to cut, and how far from a percentile its cuts stand.
ACCURACY, ASIDE = 2_000, 0.002


def latency(df: DataFrame, seconds: str = "seconds") -> DataFrame:
    """One row of exact percentiles of a column, between neighbouring values in proportion; nulls don't count.

    A sketch proposes cuts around each percentile. Rows are counted between
    cuts, and only ranges that hold a wanted rank are counted by value, so
    no task holds all values. Poor cuts make ranges larger, never wrong.
    """
    spark = df.sparkSession
    values = df.select(F.col(seconds).alias("v")).where("v IS NOT NULL")
    kind = dict(values.dtypes)["v"]
    at = sorted({min(max(q / 100 + d, 0.0), 1.0) for q in QUANTILES for d in (-ASIDE, ASIDE)})
    cuts = values.agg(F.percentile_approx("v", at, ACCURACY).alias("c")).first()["c"] or []
    # A value's range is the number of cuts it isn't below.
    part = reduce(lambda a, b: a + b, [(F.col("v") >= F.lit(c).cast(kind)).cast("int") for c in sorted(set(cuts))], F.lit(0))
    placed = values.select("v", part.alias("part"))
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, before, seen = sum(counts.values()), {}, 0
    for k in sorted(counts):
        before[k] = seen
        seen += counts[k]
    places = {q: (n - 1) * (q / 100) for q in QUANTILES}
    ranks = sorted({r for p in places.values() for r in (math.floor(p), math.ceil(p))}) if n else []
    wanted = sorted({max(k for k in before if before[k] <= r) for r in ranks})
    by_value = placed.where(F.col("part").isin(wanted)).groupBy("part", "v").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    first = reduce(lambda c, k: c.when(F.col("part") == k, before[k]), wanted, F.when(F.lit(False), 0)).cast("long")
    ends = by_value.select("v", "n", (first + F.sum("n").over(order)).alias("end"))
    hit = reduce(lambda a, r: a | ((F.col("end") > r) & (F.col("end") - F.col("n") <= r)), ranks, F.lit(False))
    found = [(r["end"] - r["n"], r["end"], float(r["v"])) for r in ends.where(hit).collect()]
    value = lambda rank: next(v for start, end, v in found if start <= rank < end)

    def between(p: float) -> float:
        low, high = value(math.floor(p)), value(math.ceil(p))
        return low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high

    row = tuple(between(places[q]) if n else None for q in QUANTILES)
    return spark.createDataFrame([row], ", ".join(f"p{q} double" for q in QUANTILES))
