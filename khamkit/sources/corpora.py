"""Gold corpora as tables of chunks, and text streams in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Lines of a file that are ordered in one task.
PIECE = 65_536


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of every line; a file is numbered by itself. A line end after the last line makes no further one.

    Files are read in blocks, in which lines come in order; what is counted
    before a block numbers its lines, so no task holds a file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return lines.join(F.broadcast(begun), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("line_no"), "value")


def chunked(rows: DataFrame, word: Column, parts_chunk: Column) -> DataFrame:
    """(file, chunk_no, words): runs of lines between those that part chunks.

    ``rows`` has file, line_no and value; the running count of parting lines
    numbers a file's chunks. It is kept within pieces of a file, to which the
    counts of the pieces before are added.
    """
    marked = rows.select("file", F.floor(F.col("line_no") / PIECE).alias("piece"), "line_no", word.alias("word"), parts_chunk.alias("parts"))
    pieces = marked.groupBy("file", "piece").agg(F.sum(F.col("parts").cast("int")).alias("n"))
    earlier = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    begun = pieces.select("file", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("file", "piece").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.withColumn("inside", F.sum(F.col("parts").cast("int")).over(order)).where(~F.col("parts") & (F.col("word") != ""))
    kept = inside.join(F.broadcast(begun), ["file", "piece"]).withColumn("chunk_no", F.col("before") + F.col("inside"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "word"))), lambda x: x["word"])
    return kept.groupBy("file", "chunk_no").agg(words.alias("words"))


def lst20_chunks(rows: DataFrame) -> DataFrame:
    """Chunks of lines ``word<tab>tag<tab>...``; _ is a space, a blank line ends a sentence, both part chunks."""
    word = F.get(F.split("value", "\t"), F.lit(0))
    return chunked(rows, word, (F.trim("value") == "") | (word == "_") | (F.trim(word) == ""))


def blackboard_chunks(rows: DataFrame) -> DataFrame:
    """Chunks of CoNLL lines whose second column is the word; | marks its inner parts, _ and $$ part chunks."""
    word = F.coalesce(F.get(F.split("value", "\t"), F.lit(1)), F.lit(""))
    comment = F.col("value").startswith("#")
    return chunked(rows.where(~comment), F.replace(word, F.lit("|"), F.lit("")), (F.trim("value") == "") | word.isin("_", "$$") | (F.trim(word) == ""))


def conformance_cases(rows: DataFrame) -> DataFrame:
    """(text, breaks) of the lines of a line break test: hex code points between signs for break and no break."""
    line = F.trim(F.split("value", "#")[0])
    fields = F.filter(F.split(line, r"\s+"), lambda x: x != "")
    hexes = F.filter(fields, lambda x: x.rlike("^[0-9A-F]+$"))
    signs = F.filter(fields, lambda x: ~x.rlike("^[0-9A-F]+$"))
    chars = F.transform(hexes, lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32"))
    return rows.where(line != "").select(F.array_join(chars, "").alias("text"), F.transform(signs, lambda s: s == "÷").alias("breaks"))


def segment_lines(spark: SparkSession, functions, source: str, target: str, separator: str = "|") -> None:
    """Each line of ``source`` as its tokens, joined, in ``target``."""
    spark.read.text(source).select(functions.join("value", separator).alias("value")).write.mode("overwrite").text(target)
