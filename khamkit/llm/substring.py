"""Substring dedup: a count-min prefilter, then exact grouping of what may repeat.

A window is ``width`` consecutive words of one document. A word goes if a
window over it also starts in a document with a smaller id.

First pass: each document adds its windows, once each, to count-min sketches
of its part of the table, and the sketches of all parts are merged. To keep
them small a window is counted under the smallest hash of its eight-word runs:
all documents that hold the window count under that one, so the estimate is
never below the window's own count. What travels of a part's sketch is the
sorted list of its cells, and of the merged one a bit for each cell: "two or
more". A second, small sketch counts windows for their size alone.

Second pass: only windows estimated to be in two documents or more are
shuffled, under a 128-bit hash of their words, and grouped exactly in sorted
streams. Windows whose estimate is large are salted by document: each salt
finds the smallest id it has seen, and the few rows at those are compared in a
second small shuffle. Nothing is lost: a sketch too small for its input only
lets more windows pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khamkit.llm.common import Tables, map_batches, mixed, multipliers, partitions, rolled, texts

WIDTH = 13
RUN = 8
ROWS = 2
#: Cells of each sketch row: four for each expected item, within these bounds (64 MB a row, as bits).
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 29
#: A row's cells are merged in this many slices.
SLICES = 64
#: Cells of a row of the sketch that finds frequent windows.
HEAVY_CELLS = 1 << 14
SALTS = 64
#: Ids of documents that lose words are broadcast up to so many (64 MB).
MOST_IDS = 8_000_000


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype="<u8").reshape(-1, 2)


class Windows:
    """The hashes of a document's windows: two halves of the exact key, and the key it is counted by."""

    def __init__(self, words: list[bytes], width: int) -> None:
        run = min(RUN, width)
        hashes = word_hashes(words)
        self.first = rolled(np.ascontiguousarray(hashes[:, 0]), multipliers(width, 1))
        self.second = rolled(np.ascontiguousarray(hashes[:, 1]), multipliers(width, 2))
        low = rolled(np.ascontiguousarray(hashes[:, 0]), multipliers(run, 3))
        span, have = width - run + 1, 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        self.counted = low


def cells(keys: np.ndarray, row: int, shift: int) -> np.ndarray:
    """The cell of each key in a sketch row of 2 ** (32 - shift) cells."""
    return (mixed(keys ^ np.uint64(0xA5A5A5A5 * (row + 1))) >> np.uint64(32 + shift)).astype(np.uint32)


def partial_sketches(width: int, shift: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each batch of documents, the sorted cells of each slice, and counts for the frequent windows."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = np.zeros(HEAVY_CELLS, dtype=np.int64)
        pack = zstandard.ZstdCompressor(level=1)
        size = (1 << (32 - shift)) // SLICES

        def out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                names=["sketch_row", "slice", "cells"],
            )

        def flush(items: list[np.ndarray]) -> pa.RecordBatch:
            found = np.concatenate(items)
            rows = []
            for row in range(ROWS):
                at = np.sort(cells(found, row, shift))
                cut = np.searchsorted(at, np.arange(SLICES + 1, dtype=np.int64) * size)
                for s in range(SLICES):
                    own = at[cut[s] : cut[s + 1]]
                    if len(own):
                        gaps = np.diff(own, prepend=np.uint32(s * size))
                        small = gaps.astype("<u2") if gaps.max() < 65536 else gaps.astype("<u4")
                        rows.append((row, s, bytes([small.itemsize]) + pack.compress(small.tobytes())))
            return out(rows)

        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for text in texts(batch.column(0)):
                words = text.split()
                if len(words) >= width:
                    windows = Windows(words, width)
                    held.append(np.unique(windows.counted))
                    n += len(held[-1])
                    heavy += np.bincount((windows.first >> np.uint64(50)).astype(np.int64), minlength=HEAVY_CELLS)
                    if n > 4_000_000:
                        yield flush(held)
                        held, n = [], 0
        if held:
            yield flush(held)
        if heavy.any():
            yield out([(-1, 0, pack.compress(heavy.astype("<i8").tobytes()))])

    return call


def merged_slices(shift: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams partial sketches sorted by (sketch_row, slice); gives a bit for each cell: two or more."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << (32 - shift)) // SLICES
        unpack = zstandard.ZstdDecompressor()
        key: tuple[int, int] | None = None
        counts = np.zeros(0)

        def out() -> pa.RecordBatch:
            data = counts.astype("<i8").tobytes() if key[0] < 0 else np.packbits(counts >= 2, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([data], pa.binary())], names=["sketch_row", "slice", "cells"])

        for batch in batches:
            for row, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row, part) != key:
                    if key is not None:
                        yield out()
                    key = (row, part)
                    counts = np.zeros(HEAVY_CELLS, dtype=np.int64) if row < 0 else np.zeros(size, dtype=np.uint8)
                if row < 0:
                    counts += np.frombuffer(unpack.decompress(data), dtype="<i8")
                else:
                    gaps = np.frombuffer(unpack.decompress(data[1:]), dtype="<u2" if data[0] == 2 else "<u4")
                    at = np.cumsum(gaps, dtype=np.int64)
                    again = at[1:][at[1:] == at[:-1]]
                    counts[at] = np.minimum(counts[at], 2) + 1
                    counts[again] = 2
        if key is not None:
            yield out()

    return call


def candidates(sketch: object, width: int, shift: int, tagged: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(h1, h2, salt, doc_id, place) of the windows estimated to be in two documents; place holds a tag of the text if ids repeat."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, heavy, least = sketch.value
        rows = [np.frombuffer(b, dtype=np.uint8) for b in bits]
        for batch in batches:
            first, second, salt, ids, place = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                words = text.split()
                if doc_id is None or len(words) < width:
                    continue
                windows = Windows(words, width)
                may = np.arange(len(windows.counted))
                for row in range(ROWS):
                    at = cells(windows.counted[may], row, shift)
                    may = may[(rows[row][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                if not len(may):
                    continue
                h1 = windows.first[may]
                hot = heavy[(h1 >> np.uint64(50)).astype(np.int64)] >= least
                first.append(h1)
                second.append(windows.second[may])
                salt.append(np.where(hot, 1 + xxhash.xxh3_64_intdigest(str(doc_id).encode()) % SALTS, 0))
                ids.append(np.full(len(may), doc_id, dtype=np.int64))
                place.append(may + tag(text, tagged))
            if first:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(t, copy=False).view(v)) for x, t, v in ((first, np.uint64, np.int64), (second, np.uint64, np.int64), (salt, np.int16, np.int16), (ids, np.int64, np.int64), (place, np.int64, np.int64))],
                    names=["h1", "h2", "salt", "doc_id", "place"],
                )

    return call


def later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by (h1, h2, salt, doc_id): those after a smaller id, and a salt's rows at its smallest id.

    The former have settled true. The latter are final too where the salt is 0,
    and are left out; with another salt they come as settled false.
    """
    last: tuple[int, int, int] | None = None
    low = 0
    for batch in batches:
        h1, h2, salt, ids, place = (np.asarray(c) for c in batch.columns)
        n = len(h1)
        if not n:
            continue
        new = np.ones(n, dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (salt[1:] != salt[:-1])
        new[0] = (int(h1[0]), int(h2[0]), int(salt[0])) != last
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        lowest = np.where(start >= 0, ids[np.maximum(start, 0)], low)
        last, low = (int(h1[-1]), int(h2[-1]), int(salt[-1])), int(lowest[-1])
        after = ids > lowest
        keep = after | (salt > 0)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h1, h2, ids, place, after)], names=["h1", "h2", "doc_id", "place", "settled"])


def tag(text: bytes, tagged: bool) -> int:
    """Tells the rows of one id apart, in the upper half of a place."""
    return zlib.crc32(text) >> 1 << 32 if tagged else 0


def stretches(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The places of windows as stretches of words: starts and ends, unsigned 32-bit numbers by turns."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column(2):
                at = np.sort(np.asarray(places.values))
                first = np.flatnonzero(np.diff(at, prepend=at[0] - width - 1) > width)
                last = np.append(first[1:] - 1, len(at) - 1)
                out.append(np.stack([at[first], at[last] + width], axis=1).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["gone_id", "gone_tag", "gone"])

    return call


def with_stretches(rows: DataFrame, gone: DataFrame, most: int) -> DataFrame:
    """``rows`` (id, tag) with ``gone``, null where nothing goes.

    Where at most ``most`` texts lose words, only these are shuffled: their ids
    are broadcast, and all other rows stay where they are. Beyond that every row
    with an id is shuffled; rows without lose nothing and would meet in one task.
    """
    on = (F.col("id") == F.col("gone_id")) & (F.col("tag") == F.col("gone_tag"))
    if gone.count() <= most:
        ids = F.broadcast(gone.select(F.col("gone_id").alias("id")).distinct())
        some, others = rows.join(ids, "id", "left_semi"), rows.join(ids, "id", "left_anti")
    else:
        some, others = rows.where("id IS NOT NULL"), rows.where("id IS NULL")
    return some.join(gone, on, "left").select(*rows.columns, "gone").unionByName(others.withColumn("gone", F.lit(None).cast("binary")))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts and the words left, of rows (text, gone, ...)."""
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, gone in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            words = text.split()
            left = np.ones(len(words), dtype=bool)
            for start, stop in np.frombuffer(gone or b"", dtype="<u4").reshape(-1, 2).tolist():
                left[start:stop] = False
            n_words.append(len(words))
            n_removed.append(len(words) - int(left.sum()))
            kept.append(b" ".join(words if left.all() else [words[k] for k in np.flatnonzero(left).tolist()]))
        rest = [batch.column(k) for k in range(2, batch.num_columns)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), batch.column(0), *rest],
            names=["n_words", "n_removed", "kept_text", "text", *batch.schema.names[2:]],
        )


def merged_sketch(docs: DataFrame, width: int, text: str) -> tuple[list[bytes], np.ndarray, int, int]:
    """Bits of the merged sketch's rows, counts of frequent windows, the count that makes one hot, and the shift."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    wanted = min(max(4 * size // 21, MIN_CELLS), MAX_CELLS)  # about six bytes a word, two counted items for seven words
    shift = 32 - (int(wanted) - 1).bit_length()
    schema = "sketch_row int, slice int, cells binary"
    parts = map_batches(docs, [text], partial_sketches(width, shift), schema)
    n = min(partitions(spark), ROWS * SLICES + 1)
    merged = parts.repartition(n, "sketch_row", "slice").sortWithinPartitions("sketch_row", "slice").mapInArrow(merged_slices(shift), schema)
    rows = [bytearray((1 << (32 - shift)) // 8) for _ in range(ROWS)]
    heavy = np.zeros(HEAVY_CELLS, dtype=np.int64)
    part = len(rows[0]) // SLICES
    for r in merged.toLocalIterator():
        if r["sketch_row"] < 0:
            heavy = np.frombuffer(bytes(r["cells"]), dtype="<i8")
        else:
            rows[r["sketch_row"]][r["slice"] * part : (r["slice"] + 1) * part] = r["cells"]
    least = max(4096, 4 * int(heavy.sum()) // HEAVY_CELLS)
    return [bytes(r) for r in rows], heavy, least, shift


def substring_dedup(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (the words left, joined by one space).

    Ids are integers. Null text has no words and stays null. A document without
    id keeps all and takes nothing from others. Rows with the same id never cut one another;
    each is cut by smaller ids alone. Other columns pass through, those named
    like the results are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    made = {"n_words", "n_removed", "kept_text"}
    if dict(docs.dtypes)[doc_id] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{doc_id} must be an integer")
    rest = [c for c in docs.columns if c not in {doc_id, text, *made}]
    bits, heavy, least, shift = merged_sketch(docs, width, text)
    sketch = spark.sparkContext.broadcast((bits, heavy, least))
    tagged = not docs.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    schema = "h1 long, h2 long, salt short, doc_id long, place long"
    rows = map_batches(docs, [doc_id, text], candidates(sketch, width, shift, tagged), schema)
    dealt = rows.repartition(n, "h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "doc_id")
    found = dealt.mapInArrow(later_windows, "h1 long, h2 long, doc_id long, place long, settled boolean")
    gone = found.where("settled").select("doc_id", "place")
    if (heavy >= least).any():
        ends = found.where(~F.col("settled"))
        lows = ends.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"))
        late = ends.join(lows, ["h1", "h2"]).where("doc_id > low")
        gone = gone.union(late.select("doc_id", "place"))
    # The places of one text: rows of an id with other texts have places of their own.
    part = F.shiftright(F.col("place"), 32).alias("gone_tag")
    gone = gone.groupBy(F.col("doc_id").alias("gone_id"), part).agg(F.collect_set(F.col("place").bitwiseAND(0xFFFFFFFF)).alias("places"))
    gone = Tables(spark).held(gone.mapInArrow(stretches(width), "gone_id long, gone_tag long, gone binary"), "gone")
    kinds = dict(docs.dtypes)
    held = [F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]
    own = F.shiftright(F.crc32(F.coalesce(F.col(text), F.lit(""))), 1) if tagged else F.lit(0)
    rows = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("id"), *held, own.cast("long").alias("tag"))
    columns = ["text", "gone", "id", *(f"c{i}" for i in range(len(rest)))]
    joined = with_stretches(rows, gone, MOST_IDS).select(columns)
    schema = f"n_words long, n_removed long, kept_text string, text string, id {kinds[doc_id]}" + "".join(f", c{i} {kinds[c]}" for i, c in enumerate(rest))
    cut_rows = joined.mapInArrow(cut, schema)
    back = {doc_id: F.col("id"), text: F.col("text")} | {c: F.col(f"c{i}") for i, c in enumerate(rest)}
    return cut_rows.select(*[back[c].alias(c) for c in docs.columns if c not in made], "n_words", "n_removed", "kept_text")
