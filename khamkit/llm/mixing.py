"""Mixing sources to target weights by weighted fair queueing.

Each source gets a target number of words: its share of the budget by weight,
but at most ``repeats`` times what it has; what a capped source leaves goes to
the others by weight. A document's virtual finish time is the number of words
its source has sent up to and with it, in a shuffled order, over the source's
target. All documents, and their second copies after a whole round of the
source, are ordered by that time, and the order is cut where the words reach
the budget.

A source's order is dealt into buckets of some thousand rows by hash. Buckets
are summed first, and only the small table of sums is accumulated, so the rows
of a large source are spread over all tasks. The cut is found the same way:
ranges of time (of turns, where times are equal) are summed, and the range that crosses the budget is dealt into
finer ranges until few rows are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khamkit.llm.common import WORD, checkpointed, partitions

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
REPEATS = 2
BUCKET_ROWS = 5000
RANGES = 1024
SEED = 17


def sized(text: str) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: str) -> Column:
    """A key that is never null: a null source is one of its own."""
    return F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """(key, source_size, target) from one row (key, source, source_size) for each source.

    Sources fill like vessels to one level: target = min(cap, level * weight).
    Ordered by cap / weight, the first source that stays below its cap when it
    and all after it share what the earlier ones leave sets the level.
    """
    every = Window.partitionBy()
    place = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = reduce(lambda c, k: c.when(F.col("place") == k, F.lit(float(weights[k]))), range(1, len(weights)), F.when(F.col("place") == 0, F.lit(float(weights[0]))))
    rows = sizes.withColumn("place", place).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeats))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("level", level)
    below = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("rank", "level"))
    rows = rows.withColumn("level", F.min(below).over(every)["level"])
    return rows.select("key", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def timed(rows: DataFrame, sums: DataFrame, buckets: int) -> DataFrame:
    """``rows`` (key, turn, size, ...) with source_size, target and finish, the virtual finish time of the first copy."""
    own = Window.partitionBy("key", "bucket").orderBy("turn", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("bucket", bucket_of(buckets)).withColumn("sent", F.sum("size").over(own))
    rows = rows.join(sums, ["key", "bucket"])
    return rows.withColumn("finish", F.when(F.col("target") > 0, (F.col("sent") + F.col("ahead")) / F.col("target")).otherwise(F.lit(0.0))).drop("bucket", "sent", "ahead")


def bucket_of(buckets: int) -> Column:
    """Buckets in the order of ``turn``, which is spread evenly over all longs."""
    return F.floor((F.col("turn") / float(1 << 63) + 1) / 2 * buckets * 0.9999999).cast("int")


def copy_finish(copy: int) -> Column:
    return F.col("finish") + F.when(F.col("target") > 0, copy * F.col("source_size") / F.col("target")).otherwise(F.lit(0.0))


def last_taken(rows: DataFrame, budget: float, few: int = 5000) -> tuple[float, int] | None:
    """The last (finish, turn) up to which ``size`` sums to ``budget`` or less; None if even the first row is too much.

    Rows of one finish time are dealt by turn. Rows alike in both are taken or
    left together: they are copies, for turn is a hash of id and text.
    """
    last: tuple[float, int] | None = None
    while True:
        ends = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("finish", "turn") for f in (F.min, F.max)], F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).first()
        by = "finish" if ends["n"] and ends["max_finish"] > ends["min_finish"] else "turn"
        low, high = ends[f"min_{by}"], ends[f"max_{by}"]
        if ends["n"] <= few or high == low:
            break
        width = (float(high) - float(low)) / RANGES
        if not width:
            break
        part = F.least(F.floor((F.col(by).cast("double") - F.lit(float(low))) / F.lit(width)), F.lit(RANGES - 1)).cast("int")
        rows = rows.withColumn("part", part)
        sums = rows.groupBy("part").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.max(F.struct("finish", "turn")).alias("last"))
        for r in sorted(sums.collect(), key=lambda r: r["part"]):
            if r["words"] > budget:
                break
            budget -= r["words"]
            last = (r["last"]["finish"], r["last"]["turn"])
        else:
            return last
        crossing = rows.where(F.col("part") == r["part"]).drop("part")
        if r["n"] == ends["n"] and by == "turn":
            # Doubles part the longs no further; what is left is a few values.
            rows = crossing
            break
        rows = crossing
    # One row for each place in the order, so that copies are one.
    places = rows.groupBy("finish", "turn").agg(F.sum("size").alias("size"))
    upto = places.withColumn("upto", F.sum("size").over(Window.orderBy("finish", "turn")))
    found = upto.where(F.col("upto") <= budget).agg(F.max(F.struct("finish", "turn")).alias("last")).first()["last"]
    return (found["finish"], found["turn"]) if found else last


class Mixture:
    """The plan for one table: targets, the order, and where it is cut.

    Null sources are one source, the last; null texts have size 0. Rows that
    agree in id, text and source are alike, so their order among themselves
    doesn't matter. The order depends on ids and texts alone: reruns agree.
    """

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> None:
        self.docs, self.repeats = docs, repeats
        self.keyed = {
            "key": source_key(source),
            "turn": F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")), F.lit(SEED)),
            "size": sized(text),
        }
        slim = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), *[c.alias(n) for n, c in self.keyed.items()]))
        by_source = slim.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
        target = targets(by_source, weights, share, repeats)
        self.buckets = max(1, slim.count() // BUCKET_ROWS)
        ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = slim.groupBy("key", bucket_of(self.buckets).alias("bucket")).agg(F.sum("size").alias("words"))
        sums = sums.select("key", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
        self.sums = checkpointed(sums.join(target, "key"))
        self.timed = checkpointed(timed(slim, self.sums, self.buckets))
        budget = (slim.agg(F.sum("size")).first()[0] or 0) * float(share)
        order = self.timed.select("turn", "size", F.explode(F.array(*[copy_finish(c) for c in range(repeats)])).alias("finish"))
        self.last = last_taken(order, budget)

    def fits(self, copy: int) -> Column:
        if self.last is None:
            return F.lit(False)
        finish, turn = self.last
        mine = copy_finish(copy)
        return (mine < F.lit(finish)) | ((mine == F.lit(finish)) & (F.col("turn") <= F.lit(turn)))

    def plan(self) -> DataFrame:
        """(doc_id, source, size, source_size, target, finish, taken) for each row; taken counts its words once a copy."""
        copies = reduce(lambda a, b: a + b, [self.fits(c).cast("long") for c in range(self.repeats)])
        return self.timed.select("doc_id", "source", "size", "source_size", "target", "finish", (F.col("size") * copies).alias("taken"))

    def rows(self) -> DataFrame:
        """The rows of the table that the mixture takes, once a copy, range-sorted by virtual finish time."""
        names = self.docs.columns
        held = [F.col(c).alias(f"c{i}") for i, c in enumerate(names)]
        rows = timed(self.docs.select(*held, *[c.alias(n) for n, c in self.keyed.items()]), self.sums, self.buckets)
        copies = F.array(*[F.when(self.fits(c), copy_finish(c)) for c in range(self.repeats)])
        rows = rows.select("turn", *[f"c{i}" for i in range(len(names))], F.explode(F.filter(copies, lambda x: x.isNotNull())).alias("finish"))
        rows = rows.repartitionByRange(partitions(self.docs.sparkSession), "finish", "turn").sortWithinPartitions("finish", "turn")
        return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
