"""URL filters: a blocked Bloom filter, then an exact hash join.

A list holds canonical entries, host and path without scheme, query or
fragment. An entry fits a URL whose host is the entry's or a subdomain of it
and whose path starts with the entry's. The keys of a URL under which an entry
could be listed are its host's suffixes with its path cut to the lengths that
occur in the list. The Bloom filter passes the keys that may be listed; those
go to a hash join with the list, which removes false positives.

The filter's blocks have 512 bits, so a test touches one cache line. It is
merged from the parts of the list by shards and is bounded: a list too long
for it only lets more keys through to the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khamkit.llm.common import checkpointed, partitions

#: Bits set for a key in its block of 512, bits of the filter for a key, and the most blocks (64 MB).
BITS, PER_KEY, MOST_BLOCKS = 6, 16, 1 << 20
SHARDS = 16
#: What the list says of the pages' sets of keys is broadcast up to so many bytes, else joined, each set in so many parts.
BROADCAST_BYTES, SALTS = 16_000_000, 64
#: The list that comes with the library: host, path and verdict of canonical URLs.
LISTED = Path(__file__).with_name("listed_urls.tsv")


def host(url: str) -> Column:
    raw = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def places(key: bytes, blocks: int) -> tuple[int, list[int]]:
    """The block of a key and its bits there."""
    h = xxhash.xxh3_128_intdigest(key)
    return (h & 0xFFFFFFFF) % blocks, [(h >> (32 + 9 * i)) & 511 for i in range(BITS)]


def bloom(keys: DataFrame) -> tuple[bytes, int]:
    """The filter of the string column ``key`` and its number of blocks."""
    n = keys.count()
    blocks = min(MOST_BLOCKS, 1 << max(4, (n * PER_KEY // 512).bit_length()))
    per_shard = blocks // SHARDS

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[int]] = [[] for _ in range(SHARDS)]
            for key in batch.column(0).to_pylist():
                if key is not None:
                    block, bits = places(key.encode(), blocks)
                    found[block // per_shard] += [block % per_shard * 512 + b for b in bits]
            rows = [(s, np.unique(np.array(at, dtype="<u4")).tobytes()) for s, at in enumerate(found) if at]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, have = None, None
        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != shard:
                    if have is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([have.tobytes()], pa.binary())], names=["shard", "bits"])
                    shard, have = s, np.zeros(per_shard * 64, dtype=np.uint8)
                at = np.frombuffer(data, dtype="<u4")
                np.bitwise_or.at(have, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if have is not None:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([have.tobytes()], pa.binary())], names=["shard", "bits"])

    schema = "shard int, bits binary"
    n_parts = min(SHARDS, partitions(keys.sparkSession))
    dealt = keys.select("key").mapInArrow(parts, schema).repartition(n_parts, "shard").sortWithinPartitions("shard")
    out = bytearray(blocks * 64)
    for r in dealt.mapInArrow(joined, schema).toLocalIterator():
        out[r["shard"] * per_shard * 64 : (r["shard"] + 1) * per_shard * 64] = r["bits"]
    return bytes(out), blocks


def candidate_keys(filter_: object, blocks: int, lengths: list[int], column: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``may``, the keys of each row (host in ``column``, path in the next) that pass the filter, sorted."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = filter_.value
        seen: dict[bytes, bool] = {}

        def passes(key: bytes) -> bool:
            block, bits = places(key, blocks)
            return all(data[block * 64 + (b >> 3)] >> (b & 7) & 1 for b in bits)

        for batch in batches:
            out = []
            for name, way in zip(batch.column(column).to_pylist(), batch.column(column + 1).to_pylist(), strict=True):
                labels = name.split(".")
                may = []
                for i in range(len(labels) if name else 0):
                    suffix = ".".join(labels[i:])
                    for n in lengths:
                        if n > len(way):
                            break
                        key = (suffix + way[:n]).encode()
                        hit = seen.get(key)
                        if hit is None:
                            if len(seen) > 200_000:
                                seen.clear()
                            hit = seen[key] = passes(key)
                        if hit:
                            may.append(key.decode())
                out.append(sorted(may))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], names=[*batch.schema.names, "may"])

    return call


def answered(rows: DataFrame, found: DataFrame, most_bytes: int) -> DataFrame:
    """``rows`` with the answer to their set of keys: a broadcast join within the bound, else a salted hash join.

    Most pages have no key. They have a salt of their own each, so that they part
    evenly; pages of one set, as those of a large listed host, part by salt.
    """
    size = found.agg(F.sum(F.length(F.array_join("may", "")) + F.length("best.key") + F.length("best.verdict") + 16)).first()[0] or 0
    if size <= most_bytes:
        return rows.join(F.broadcast(found), "may", "left")
    place = F.monotonically_increasing_id()
    salted = rows.withColumn("salt", F.when(F.size("may") > 0, place % SALTS).otherwise(place + SALTS))
    parts = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(parts, ["may", "salt"], "left")


def judged(pages: DataFrame, entries: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` (without its texts) with host, path, rule and verdict, and listed: the same for the method's own entries.

    ``entries`` has host, path, verdict and ranked (true for rules, false for
    the method's own list). Of the rules that fit the longest gives rule and
    verdict; if none does, the longest own entry gives the verdict; else it is
    ``default``. Null urls and urls without :// have an empty host and path and
    fit nothing. Repeated rows are judged alike. Columns named like the results
    are replaced; empty pages or entries give what follows from them.
    """
    made = {"host", "path", "rule", "verdict"}
    rest = [c for c in pages.columns if c not in made]
    keyed = entries.select(F.concat("host", "path").alias("key"), "verdict", "ranked", F.length("path").alias("n"))
    keyed = keyed.groupBy("key").agg(F.max_by("verdict", F.col("ranked").cast("int")).alias("verdict"), F.max("ranked").alias("ranked"), F.first("n").alias("n"))
    lengths = sorted(r["n"] for r in keyed.select("n").distinct().collect())
    data, blocks = bloom(keyed)
    spark = pages.sparkSession
    held = [F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]
    kinds = dict(pages.dtypes)
    rows = pages.select(*held, host(url).alias("host"), path(url).alias("path"))
    schema = ", ".join([*[f"c{i} {kinds[c]}" for i, c in enumerate(rest)], "host string, path string, may array<string>"])
    rows = rows.mapInArrow(candidate_keys(spark.sparkContext.broadcast(data), blocks, lengths, len(rest)), schema)
    # One row for each set of keys that passed, however many pages have it.
    sets = rows.select("may").where(F.size("may") > 0).distinct()
    exact = sets.select("may", F.explode("may").alias("key")).join(keyed, "key")
    best = F.max(F.struct("ranked", F.length("key").alias("n"), "key", "verdict"))
    found = checkpointed(exact.groupBy("may").agg(best.alias("best")))
    rows = answered(rows, found, BROADCAST_BYTES)
    return rows.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)],
        "host",
        "path",
        F.when(F.col("best.ranked"), F.col("best.key")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


#: The rules of the query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def listed_rows(path: Path = LISTED) -> list[tuple[str, str, str]]:
    """(host, path, verdict) of a list's lines; lines that begin with # don't count."""
    lines = [x.split("\t") for x in path.read_text(encoding="utf-8").splitlines() if x and not x.startswith("#")]
    return [(host, path, verdict) for host, path, verdict in lines]


def listed(pages: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """The rules and the method's own list (host, path, verdict), by default the one that comes with the library."""
    spark = pages.sparkSession
    own = spark.createDataFrame(listed_rows(), "host string, path string, verdict string") if own is None else own.select("host", "path", "verdict")
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return rules.withColumn("ranked", F.lit(True)).unionByName(own.withColumn("ranked", F.lit(False)))
