"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's shingles,
ascending, as big-endian bytes. The sketch of a union is the bottom k of the
sketches' union, so parts merge in any order. From sketches alone follow
resemblance, containment and the number of distinct shingles; with fewer than
k shingles all three are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khamkit.llm.common import map_batches, multipliers, partitions, rolled, texts

K = 128
WIDTH = 5


def sketch(words: list[bytes], width: int = WIDTH, k: int = K) -> np.ndarray:
    """The k smallest distinct shingle hashes; fewer words than ``width`` are one shingle, none give none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=np.uint64)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype="<u8")
    return np.unique(rolled(hashes, multipliers(width, 5)))[:k]


def united(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate([a, b]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated shared share of the shingles of both; 1 for two empty sketches, 0 if one is empty."""
    both = united(a, b, k)
    if not len(both):
        return 1.0
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(shared <= both[-1])) / len(both)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` holds too; 1 for an empty ``a``."""
    if not len(a):
        return 1.0
    union = distinct(united(a, b, k), k)
    return min(1.0, max(0.0, resemblance(a, b, k) * union / distinct(a, k)))


def stored(a: np.ndarray) -> bytes:
    return a.astype(">u8").tobytes()


def loaded(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=">u8").astype(np.uint64)


def sketched(docs: DataFrame, width: int = WIDTH, k: int = K, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sketch, distinct_shingles) of every row; null text is empty."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sketch(t.split(), width, k) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stored(a) for a in own], pa.binary()), pa.array([distinct(a, k) for a in own], pa.float64())], names=["doc_id", "sketch", "distinct_shingles"])

    return map_batches(docs, [doc_id, text], call, f"doc_id {dict(docs.dtypes)[doc_id]}, sketch binary, distinct_shingles double")


def merged(sketches: DataFrame, by: str, k: int = K) -> DataFrame:
    """(by, sketch) of each group of a table with ``by`` and ``sketch``.

    Each task first merges what it reads, so a large group arrives as one
    sketch from each task.
    """

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([stored(a) for a in held.values()], pa.binary())], names=[by, "sketch"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[key] = united(held.get(key, loaded(b"")), loaded(data or b""), k)
            if len(held) > 20_000:
                yield out()
                held.clear()
        if held:
            yield out()

    schema = f"`{by}` {dict(sketches.dtypes)[by]}, sketch binary"
    parts = sketches.select(by, "sketch").mapInArrow(call, schema)
    dealt = parts.repartition(partitions(sketches.sparkSession), by).sortWithinPartitions(by)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, have, kind = None, None, None
        for batch in batches:
            kind = batch.column(0).type
            keys, found = [], []
            for now, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if have is not None and now != key:
                    keys.append(key)
                    found.append(stored(have))
                    have = None
                key, have = now, united(have if have is not None else loaded(b""), loaded(data), k)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(found, pa.binary())], names=[by, "sketch"])
        if have is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([stored(have)], pa.binary())], names=[by, "sketch"])

    return dealt.mapInArrow(last, schema)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def likeness(width: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams rows in order; a row is answered once the next has come. Guests only serve as the next."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "near_edited", "near_next", "in_edited", "distinct_shingles"]
        kind = None
        held: tuple | None = None

        def answer(now: tuple, after: tuple) -> tuple:
            doc_id, text, own = now
            new = edited(text, after[1]).encode()
            other = sketch(new.split(), width, k)
            return doc_id, len(text), hashlib.sha256(new).hexdigest(), stored(own), stored(other), resemblance(own, other, k), resemblance(own, after[2], k), containment(own, other, k), distinct(own, k)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

        for batch in batches:
            kind = batch.column(0).type
            rows = []
            for doc_id, text, guest in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if guest.as_py() and held is None:
                    continue
                whole = text.as_py() or ""
                now = (doc_id.as_py(), whole, sketch(whole.encode().split(), width, k))
                if held is not None:
                    rows.append(answer(held, now))
                held = None if guest.as_py() else now
                if len(rows) >= 500:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    return call


def likeness_to_next(docs: DataFrame, width: int = WIDTH, k: int = K, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sketches of each text and of its edited text, and their likeness, also to the next document's.

    ``in_edited`` is the share of the text's shingles that the edited text holds,
    ``distinct_shingles`` their number, both estimated.

    The next document has the next smaller id; after the last comes the first.
    Null ids come last, rows of one id by a hash of their texts. Null text is
    empty. Every row gives a row; an empty table gives none.

    Rows are dealt once, into ranges of (id, hash of the text) of about equal
    counts, so neither null ids nor many rows of one id meet in one task unless
    their texts are equal too. The first row of each range also goes to the range
    before it as a guest, for the last row there. What the driver holds is some
    ``SAMPLE`` ids and hashes for each range. Ids must be integers.
    """
    if dict(docs.dtypes)[doc_id] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{doc_id} must be an integer")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_hash(text).alias("tie"))
    marks = spark.sparkContext.broadcast(range_marks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), max(1, partitions(spark))))
    slim = rows.select("doc_id", "tie", ranges(marks)("doc_id", "tie").alias("part"))
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("head")
    heads = sorted(slim.groupBy("part").agg(first).collect(), key=lambda r: r["part"])
    guests = {(h["head"]["doc_id"], h["head"]["tie"]): heads[(i + 1) % len(heads)]["part"] for i, h in enumerate(heads)}
    to = places(marks, spark.sparkContext.broadcast(guests))("doc_id", "tie")
    # A row of its own for the guest; of equal rows at a range's start one is enough.
    dealt = rows.select("doc_id", "text", "tie", F.explode(to).alias("to")).select("doc_id", "text", "tie", "to.part", "to.guest")
    dealt = dealt.repartitionById(len(marks.value[0]) + 1, F.col("part")).sortWithinPartitions("guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, sketch binary, edited_sketch binary, near_edited double, near_next double, in_edited double, distinct_shingles double"
    return dealt.select("doc_id", "text", "guest").mapInArrow(likeness(width, k), schema)


#: Sampled rows for each range.
SAMPLE = 40


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def range_marks(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and hashes that part the rows (doc_id, tie) into ``n`` ranges of about equal counts, ascending; null ids first."""
    count = docs.count()
    if n < 2 or not count:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    sampled = docs.sample(min(1.0, SAMPLE * n / count), seed=6).select("doc_id", text_hash("text").alias("tie")).collect()
    found = sorted(((r["doc_id"] if r["doc_id"] is not None else LEAST_ID, r["tie"]) for r in sampled))
    marks = sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []
    return np.array([m[0] for m in marks], dtype=np.int64), np.array([m[1] for m in marks], dtype=np.int64)


#: Null ids stand below all others.
LEAST_ID = -(1 << 63)


def numbered(ids: pa.Array, ties: pa.Array, marks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The number of marks at or below (id, tie)."""
    own = ids.cast(pa.int64()).fill_null(LEAST_ID).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(marks[0], own, side="left"), np.searchsorted(marks[0], own, side="right")
    out = high.copy()
    # Only an id that is a mark itself asks for the hash.
    hashes = ties.to_numpy(zero_copy_only=False)
    for at in np.unique(low[low < high]).tolist():
        here = np.flatnonzero((low == at) & (low < high))
        stop = int(high[here[0]])
        out[here] = at + np.searchsorted(marks[1][at:stop], hashes[here], side="right")
    return out.astype(np.int32)


def ranges(marks: object) -> Callable[..., Column]:
    @F.arrow_udf("int")
    def part(ids: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array(numbered(ids, ties, marks.value))

    return part


def places(marks: object, known: object) -> Callable[..., Column]:
    """Where a row goes: its own range, and as a guest the range that it stands at the end of."""
    kind = pa.list_(pa.struct([("part", pa.int32()), ("guest", pa.bool_())]))

    @F.arrow_udf("array<struct<part: int, guest: boolean>>")
    def to(ids: pa.Array, ties: pa.Array) -> pa.Array:
        guests = known.value
        out = []
        for key, part in zip(zip(ids.to_pylist(), ties.to_pylist(), strict=True), numbered(ids, ties, marks.value).tolist(), strict=True):
            own = [{"part": part, "guest": False}]
            if key in guests:
                own.append({"part": guests[key], "guest": True})
            out.append(own)
        return pa.array(out, kind)

    return to


def printed(sketch_column: str) -> Column:
    return F.base64(F.col(sketch_column))


def text_of(data: bytes) -> str:
    """The printed form of a stored sketch, as ``printed`` gives it."""
    return base64.b64encode(data).decode()
