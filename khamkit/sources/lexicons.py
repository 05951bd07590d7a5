"""Lexicons, weights and bigrams as DataFrames, read from text, parquet or Python values.

The table (word, weight) is the source of truth; a model for the text functions
is collected from it once, checked against a bound on its size.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khamkit.functions.segment import Bigrams, Lexicon

LEXICON = T.StructType([T.StructField("word", T.StringType()), T.StructField("weight", T.DoubleType())])
#: The most words (or word pairs), and the most bytes of them, that are sent to executors with a model.
MOST_WORDS, MOST_BYTES = 5_000_000, 100_000_000
#: The setting that names the default lexicon; beside it, weights.tsv and bigrams.tsv are read if they are there.
DEFAULT_KEY = "spark.khamkit.lexicon.path"
PACKAGED = Path(__file__).with_name("basic_words.txt")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments, as ``value``, in no order."""
    rows = spark.read.text(path).select(trimmed(F.col("value")).alias("value"))
    return rows.where((F.col("value") != "") & ~F.col("value").startswith("#"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(word, weight) of lines ``word[<tab>weight]``; a weight that is missing or no number is 1.

    Equal words keep the largest weight. Weights of 0 or less raise.
    """
    parts = F.split("value", "\t")
    rows = listed(spark, path).select(F.get(parts, F.lit(0)).alias("word"), F.coalesce(F.trim(F.get(parts, F.lit(1))).try_cast("double"), F.lit(1.0)).alias("weight"))
    return checked(merge_highest(rows))


def read_plain(spark: SparkSession, path: str, weight: float = 1.0) -> DataFrame:
    """(word, weight) of a list whose whole lines are words."""
    return listed(spark, path).select(F.col("value").alias("word"), F.lit(float(weight)).alias("weight")).distinct()


def read_lexicon(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """A lexicon by its format: parquet, tsv, txt (read as tsv) or plain; else by the ending of its path or what its files begin with."""
    kind = format or Path(path.rstrip("/")).suffix.removeprefix(".").lower()
    if not format and kind not in ("parquet", "plain"):
        kind = "parquet" if begins_as_parquet(spark, path) else "tsv"
    if kind == "parquet":
        return checked(spark.read.parquet(path).select("word", F.col("weight").cast("double").alias("weight")))
    if kind == "plain":
        return read_plain(spark, path)
    if kind in ("tsv", "txt", ""):
        return read_tsv(spark, path)
    raise ValueError(f"no lexicon format {kind!r}")


def begins_as_parquet(spark: SparkSession, path: str) -> bool:
    """Whether the first file at ``path`` begins as parquet files do; a path that isn't there doesn't."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return False
    found = [x.getPath() for x in system.listStatus(where) if x.isFile() and x.getLen() and not x.getPath().getName().startswith(("_", "."))]
    if not found:
        return False
    stream = system.open(found[0])
    try:
        return [stream.read() for _ in range(4)] == list(b"PAR1")
    finally:
        stream.close()


def from_words(spark: SparkSession, words: list[str] | dict[str, float]) -> DataFrame:
    """(word, weight) of a list (weight 1) or a mapping; empty words are left out."""
    rows = [(w, float(x)) for w, x in (words.items() if isinstance(words, dict) else ((w, 1.0) for w in words)) if w]
    return checked(merge_highest(spark.createDataFrame(rows, LEXICON)))


def packaged(spark: SparkSession) -> DataFrame:
    """The small lexicon that comes with the library."""
    lines = [x for x in PACKAGED.read_text(encoding="utf-8").split() if not x.startswith("#")]
    return from_words(spark, lines)


def default_lexicon(spark: SparkSession) -> DataFrame:
    """The lexicon the session's setting names, which must be readable, with weights beside it; else the packaged one."""
    path = spark.conf.get(DEFAULT_KEY, None)
    if not path:
        return packaged(spark)
    words = read_lexicon(spark, path)
    beside = path.rsplit("/", 1)[0] + "/weights.tsv"
    return apply_weights(words, read_weights(spark, beside)) if exists(spark, beside) else words


def default_bigrams(spark: SparkSession) -> DataFrame | None:
    path = spark.conf.get(DEFAULT_KEY, None)
    beside = path.rsplit("/", 1)[0] + "/bigrams.tsv" if path else ""
    return read_bigrams(spark, beside) if beside and exists(spark, beside) else None


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def checked(lexicon: DataFrame) -> DataFrame:
    """``lexicon``; reading a weight of 0 or less raises."""
    bad = F.raise_error(F.concat(F.lit("weight must be above 0: "), F.col("word"))).cast("double")
    return lexicon.select("word", F.when(F.col("weight") > 0, F.col("weight")).otherwise(bad).alias("weight"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(word, weight) of a weights file; a line without a weight above 0 raises."""
    parts = F.split("value", "\t")
    weight = F.trim(F.get(parts, F.lit(1))).try_cast("double")
    bad = F.raise_error(F.concat(F.lit("no weight above 0 in: "), F.col("value"))).cast("double")
    return listed(spark, path).select(F.get(parts, F.lit(0)).alias("word"), F.when(weight > 0, weight).otherwise(bad).alias("weight"))


def apply_weights(lexicon: DataFrame, weights: DataFrame) -> DataFrame:
    """``lexicon`` with the weights of the words it has; other words of ``weights`` are left out."""
    own = weights.groupBy("word").agg(F.max("weight").alias("own"))
    return lexicon.join(own, "word", "left").select("word", F.coalesce("own", "weight").alias("weight"))


def applied(lexicon: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: how many words of ``weights`` the lexicon has."""
    return weights.select("word").distinct().join(lexicon.select("word"), "word", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def merge_highest(lexicon: DataFrame) -> DataFrame:
    """One row a word, with its largest weight; empty words go."""
    return lexicon.where(F.coalesce(F.col("word"), F.lit("")) != "").groupBy("word").agg(F.max("weight").alias("weight"))


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """The lexicon as parquet, sorted, a word once."""
    merge_highest(lexicon).orderBy("word").write.mode("overwrite").parquet(path)


def read_bigrams(spark: SparkSession, path: str) -> DataFrame:
    """(prev, next, count) of lines with three parts whose count is a number above 0, in the order of files and lines by ``seq``."""
    parts = F.split("value", "\t")
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    rows = whole.select("file", "line_no", trimmed(F.col("value")).alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    rows = rows.select(F.struct("file", "line_no").alias("seq"), F.get(parts, F.lit(0)).alias("prev"), F.get(parts, F.lit(1)).alias("next"), F.get(parts, F.lit(2)).try_cast("double").alias("count"))
    return rows.where("count > 0").select("prev", "next", "count", "seq")


def bounded(rows: DataFrame, what: str) -> list:
    """The rows, after a check that they are few and short enough to travel with a model."""
    sizes = [F.octet_length(c) for c, kind in rows.dtypes if kind == "string"]
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(sizes, F.lit(0))), F.lit(0))).first()
    if n > MOST_WORDS or size > MOST_BYTES:
        raise ValueError(f"{n} {what} of {size} bytes are more than the {MOST_WORDS} of {MOST_BYTES} bytes that a model may hold")
    return rows.collect()


def model_lexicon(lexicon: DataFrame) -> Lexicon:
    return Lexicon.of({r["word"]: r["weight"] for r in bounded(merge_highest(lexicon), "words")})


def model_bigrams(bigrams: DataFrame, alpha: float = 0.15, formula: str = "count") -> Bigrams:
    order = ["seq"] if "seq" in bigrams.columns else []
    rows = sorted(bounded(bigrams, "word pairs"), key=lambda r: r["seq"]) if order else bounded(bigrams, "word pairs")
    return Bigrams.of([(r["prev"], r["next"], r["count"]) for r in rows], alpha, formula)
