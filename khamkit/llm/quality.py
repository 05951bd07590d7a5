"""Quality rules as a short-circuit cascade, native expressions only.

Base counts are columns of every document. The further rules of the cascade
decide only whether a document is kept. Some compare base counts; others work
out counts of their own, over the whole text, and do so only for documents that
no rule before them has rejected. Their cost and selectivity are estimated on
a random sample, and they are tried in the order of rejections per cost. The
order never changes a verdict, only how soon it falls.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from khamkit.llm.common import BLANKS, WORD

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a boolean column over the counts and ``text``; ``fixed_cost`` replaces the timed cost."""

    name: str
    rejects: Column
    fixed_cost: float | None = field(default=None)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Null text counts as empty. Windows of three words are compared by a 64-bit
    hash of the three; only documents in which two windows agree sort them.
    """
    own = "__quality_"
    names = [c for c in docs.columns if c not in COUNTS]
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns(
        {
            f"{own}words": F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)),
            f"{own}lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "word_chars": F.length(F.translate(whole, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        }
    )
    words = F.col(f"{own}words")
    lines = F.col(f"{own}lines")
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            f"{own}grams": F.transform(
                F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
            ),
        }
    )
    grams = F.col(f"{own}grams")
    places = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeated = F.size(F.array_distinct(grams)) < F.size(grams)
    out = out.withColumn(f"{own}sorted", F.when(repeated, F.sort_array(places)))
    ranked = F.col(f"{own}sorted")
    twice = F.filter(
        ranked,
        lambda e, i: F.coalesce(e["h"] == F.get(ranked, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(ranked, i + 1)["h"], F.lit(False)),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))
    out = out.withColumn("n_repeat_words", F.when(ranked.isNull(), F.lit(0)).otherwise(covered).cast("long"))
    # A generated row keeps filters on the counts above the expressions they come from: pushed below, they would
    # repeat them, and within the lambdas once for each word.
    return out.select(*names, F.explode_outer(F.array(F.struct(*COUNTS))).alias(own)).select(*names, f"{own}.*")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules(text: str = "text") -> list[Rule]:
    """Thresholds are far from prose: they name junk, not style. The last four read the text anew, each for itself."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    whole = F.coalesce(F.col(text), F.lit(""))
    letters = F.length(F.regexp_replace(whole, r"[^\p{L}\p{M}]+", ""))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > 3 * words),
        Rule("long_words", F.col("word_chars") > 15 * words),
        Rule("short_words", 10 * F.col("word_chars") < 20 * words),
        Rule("repeated_lines", (F.col("n_dup_lines") >= 3) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))),
        Rule("few_letters", 100 * letters < 40 * F.col("word_chars")),
        Rule("few_different_words", (F.col("n_words") >= 200) & (50 * F.size(F.array_distinct(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)))) < F.col("n_words"))),
        Rule("bulleted_lines", (F.col("n_lines") >= 5) & (10 * F.regexp_count(whole, F.lit(r"(?md)^[ \t]*[\x{2022}\x{2023}\x{25E6}*+-][ \t]")) > 9 * lines)),
        Rule("broken_off_lines", (F.col("n_lines") >= 5) & (10 * F.regexp_count(whole, F.lit(r"(?md)(?:\.\.\.|\x{2026})[ \t\r]*$")) > 5 * lines)),
    ]


def ordered(rules: list[Rule], counted: DataFrame) -> list[Rule]:
    """``rules`` by estimated rejections per cost, best first.

    Selectivity is the share of the sample a rule rejects; cost is its fixed
    cost, or what a pass over the sample takes longer than one without rules, the
    quicker of two. ``counted`` must be a bounded sample; an empty one keeps the
    given order.
    """
    sample = counted.collect()
    if not sample:
        return rules
    rows = counted.sparkSession.createDataFrame(sample, counted.schema)

    def timed(hit: Column) -> tuple[float, int]:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            n = rows.agg(F.count_if(hit).alias("n")).first()["n"]
            runs.append(time.perf_counter() - began)
        return min(runs), n

    bare, _ = timed(F.col("n_words") < 0)
    rank = []
    for k, rule in enumerate(rules):
        seconds, hit = timed(rule.rejects)
        cost = rule.fixed_cost or max(seconds - bare, bare / 100)
        rank.append((-(hit / len(sample)) / cost, k, rule))
    return [rule for _, _, rule in sorted(rank, key=lambda x: x[:2])]


def cascade(rules: list[Rule]) -> Column:
    """False at the first rule that rejects; CASE leaves the rest untried."""
    out: Column | None = None
    for rule in rules:
        hit = F.coalesce(rule.rejects, F.lit(False))
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = 500) -> DataFrame:
    """``docs`` with the base counts, base_failed and kept.

    Nulls in ``text`` count as empty texts, which fail the base rule. Other
    columns pass through; columns named like the counts are replaced. Repeated
    rows are judged each on its own; an empty table gives an empty result. The
    sample (about ``sample_rows`` rows of the whole table, twice as many at most)
    serves the order of the rules alone.
    """
    rules = default_rules(text) if rules is None else rules
    docs = docs.drop(*(c for c in docs.columns if c in (*COUNTS, "base_failed", "kept") and c != text))
    share = min(1.0, sample_rows / max(1, docs.count()))
    # Collected as it is: a limit below further operators would be run by every task.
    few = docs.select(F.col(text).cast("string").alias(text)).sample(share, seed=10).limit(2 * sample_rows).collect()
    order = ordered(rules, counts(docs.sparkSession.createDataFrame(few, StructType([StructField(text, StringType())])), text))
    counted = counts(docs, text).withColumn("base_failed", base_failed())
    return counted.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order)))
