"""The text functions for SQL: scalar functions and a table function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khamkit.functions import linebreak, markup, normalize, segment
from khamkit.functions.text import TextFunctions, batched


def register(spark: SparkSession, functions: TextFunctions, prefix: str = "kham_") -> list[str]:
    """Registers ``kham_words``, ``kham_lines`` and so on, and the table function ``kham_tokens(text)``; gives their names.

    Null in, null out (no rows from the table function).
    """
    model, line_model, table = functions.model, functions.line_model, functions.table
    sep = "|"
    plain = {
        "words": ("array<string>", lambda t: segment.words(t, model)),
        "join": ("string", lambda t: sep.join(segment.words(t, model))),
        "lines": ("string", lambda t: linebreak.lines(t, line_model, table)),
        "segments": ("array<string>", lambda t: linebreak.segments(t, line_model, table)),
        "normalize": ("string", lambda t: normalize.normalized(t)),
        "without_markup": ("string", markup.without_markup),
    }
    # What needs no Python is a SQL expression, which the optimizer puts in place of the call.
    native = {
        "display_width": ("INT", r"length(regexp_replace(t, '[\\x{0E31}\\x{0E34}-\\x{0E3A}\\x{0E47}-\\x{0E4E}\\x{200B}]', '')) + length(regexp_replace(t, '[^\\x{2E80}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}]', ''))"),
        "without_zero_width": ("STRING", r"regexp_replace(t, '[\\x{200B}-\\x{200F}\\x{FEFF}]', '')"),
        "is_markup": ("BOOLEAN", r"t RLIKE '<[a-zA-Z/!?][^>]*>'"),
    }
    for name, (kind, expression) in native.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(t STRING) RETURNS {kind} RETURN {expression}")

    for name, (kind, function) in plain.items():
        spark.udf.register(prefix + name, batched(function, kind))
    spark.udf.register(f"{prefix}wrap", batched(lambda t, width: linebreak.wrap(t, width, line_model, table), "string", 2))

    class Tokens:
        def eval(self, text: str):
            for k, s in enumerate(segment.spans(text, model) if text else []):
                yield k, s.start, s.end, text[s.start : s.end], s.unknown

    spark.udtf.register(f"{prefix}tokens", F.udtf(Tokens, returnType="pos: int, start: int, end: int, token: string, is_oov: boolean"))
    return [prefix + n for n in (*plain, *native, "wrap", "tokens")]


def model_info(spark: SparkSession, functions: TextFunctions) -> DataFrame:
    """One row about the model: words, total_weight, bigrams, status."""
    bigrams = functions.model.bigrams
    row = (len(functions.model.lexicon.weights), functions.model.lexicon.total, len(bigrams.counts) if bigrams else 0, "ok")
    return spark.createDataFrame([row], "words long, total_weight double, bigrams long, status string")
