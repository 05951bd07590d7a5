"""What the corpus operators share: words, hashes, the checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words: space and U+0009 to U+000D; bytes.split() parts at the same six.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the cluster's spark.checkpoint.dir, or what the session has set.

    Only a local master, where all are one machine, may have none and gets a
    temporary one; anywhere else that would be a folder of its own on each
    machine, so it raises.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    folder = context.getConf().get("spark.checkpoint.dir") or (known.get() if known.isDefined() else None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="khamkit-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Tables:
    """Tables in a folder of their own in the shared folder, for loops.

    Read again, a table has the size of its files; what checkpoint() gives back
    keeps the estimate of its plan, and the products of joins that a loop piles
    up make such estimates too long to multiply.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"

    def held(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key of more rows than HOT_ROWS, and than one in HOT_SHARE of all rows, is hot; so at most HOT_SHARE keys are.
HOT_ROWS, HOT_SHARE = 256, 100_000


def hot_joined(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has a row a key and in ``n`` how many rows of ``left`` have it.

    ``total`` is the number of rows of ``left``. Hot keys, of which there are few
    by their definition, are broadcast, so their rows stay where they are; the
    rest meet in a shuffle. Both tables are read more than once.
    """
    most = max(HOT_ROWS, total // HOT_SHARE)
    hot = right.where(F.col(n) > most).drop(n)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(n) <= most).drop(n), key)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def map_batches(df: DataFrame, columns: list[str], call: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``call`` over the Arrow batches of these columns only."""
    return df.select(*columns).mapInArrow(call, schema)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed copy of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit factors."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) | np.uint64(1)


def rolled(words: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One hash for each run of len(factors) consecutive word hashes."""
    m = len(words) - len(factors) + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:m] * factors[0]
    for k in range(1, len(factors)):
        out += words[k : k + m] * factors[k]
    return mixed(out)
