"""SimHash near-duplicates by pivot distance tables.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's word
shingles. Two fingerprints link if at most ``radius`` bits differ. Only
distinct fingerprints are compared, so copies cost nothing.

A table of Hamming distances to fixed reference fingerprints (pivots) is
computed for each fingerprint. By the triangle inequality a pair whose
distances to any pivot differ by more than ``radius`` can't link: it is
discarded without being compared, and the survivors are verified bit by bit.

Pairs come from buckets, for a table alone would need every pair: of b blocks
of bits, a pair within the radius agrees on at least b - radius. Sixteen-bit
blocks give buckets that agree on 32 bits; a bucket too large to hold is dealt
again by four-bit blocks, which bounds it at 256 distinct fingerprints.
A bucket yields the edges of a spanning forest of its links, not its pairs.

One fingerprint finds texts that are all but equal. Where near copies of a
similarity of 0.8 or more matter, a text gets a few independent fingerprints
(lanes) from remixed hashes of its different shingles, and sampled ones: each
is the fingerprint of the few shingles that come first in an order of its own.
Pairs come from first lanes within the radius, as above, and from sampled
fingerprints that agree. Tables of distances discard those whose lanes differ in
far more bits than that similarity means, survivors are compared bit by bit, and
what is left is verified by the different shingles that both texts have. Only
verified pairs link. At so wide a radius distances of whole fingerprints to
references discard nothing; those of their bytes, added up, discard nearly all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khamkit.llm.common import checkpointed, hot_joined, map_batches, mixed, partitions, texts
from khamkit.llm.components import components

SEED = 42
RADIUS = 2
#: The largest bucket whose pairs one task compares; the second dealing can't exceed it.
BUCKET = 256
#: Shingles in a sample, and the share of differing bits up to which texts that share a sample are verified: at a cosine c
#: two fingerprints differ in acos(c) / pi of their bits. A similarity of 0.8 (a cosine of 0.89) means 0.15, 39 of four
#: lanes' 256 bits with a deviation of 6; 76 are let through. Sixteen samples miss (1 - 0.8^3)^16 or 0.00001 of such pairs.
SAMPLE = 3
DIFFERING = 0.30
#: Texts are near copies if they share so many parts of so many of the different shingles that either has.
SIMILAR = (4, 5)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: References of the distance tables.
PIVOTS = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: References of the tables for lanes: fingerprints that repeat a byte, all of which differ from each other in four bits.
REFERENCES = np.array([0x00, 0x55, 0x33, 0x66, 0x0F, 0x5A, 0x3C, 0x69], dtype=np.uint8)
#: The distance of each byte to each reference, and for two bytes (the first times 256, and the second) how far theirs are apart at most.
DISTANCES = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ REFERENCES).astype(np.int8)
APART = np.abs(DISTANCES[:, None] - DISTANCES).max(axis=2).astype(np.uint8).ravel()
#: Pairs whose bytes are looked up at once.
PAIRS = 4096
SAMPLE_ORDERS = mixed(np.arange(101, 133, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def lane_hashes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """One row a shingle: its hash, and remixed hashes for the further lanes."""
    more = [mixed(hashes + PIVOTS[lane]) for lane in range(1, lanes)]
    return np.stack([hashes, *more], axis=1)


def bit_votes(hashes: np.ndarray) -> np.ndarray:
    """For each bit of each column how many rows have it set."""
    votes = np.zeros(64 * hashes.shape[1], dtype=np.int64)
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8), axis=1, bitorder="little")
    for j in range(0, len(bits), 255):
        votes += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return votes


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """The hash of every shingle of ``width`` words, repeats included; fewer words are one shingle."""
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    stops = (ends[width - 1 :] - 1).tolist()
    starts = [0, *ends[: len(words) - width].tolist()]
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=len(stops))


def fingerprint(text: bytes, width: int, lanes: int = 1, samples: int = 0) -> list[int]:
    """For each lane the majority of each bit over the shingles, then for each sample over its own; 0 without words.

    With samples, lanes count each different shingle once, as the similarity does.
    """
    words = text.translate(LOWER).split()
    if not words:
        return [0] * (lanes + samples)
    hashes = shingle_hashes(words, width)
    if samples:
        hashes = np.unique(hashes)
    votes = np.zeros(64 * lanes, dtype=np.int64)
    for k in range(0, len(hashes), 2048):
        votes += bit_votes(lane_hashes(hashes[k : k + 2048], lanes))
    out = np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8").tolist()
    if samples:
        first = [np.sort(np.partition(order, SAMPLE - 1)[:SAMPLE]) if len(hashes) > SAMPLE else np.sort(order) for order in (mixed(hashes ^ c) for c in SAMPLE_ORDERS[:samples])]
        chosen = np.stack(first, axis=1)
        out += np.packbits(2 * bit_votes(chosen) > len(chosen), bitorder="little").view("<u8").tolist()
    return out


def fingerprints(docs: DataFrame, width: int = 5, lanes: int = 1, samples: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fps, text_key) of every row; fps lists the fingerprints of lanes, then of samples, as signed longs.

    text_key is Spark's xxhash64 of the text.
    """

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = texts(batch.column(1))
            fps = np.array([fingerprint(t, width, lanes, samples) for t in own], dtype=np.uint64).reshape(-1, lanes + samples)
            keys = np.array([xxhash.xxh64_intdigest(t, SEED) for t in own], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(fps.view(np.int64)), pa.list_(pa.int64())), pa.array(keys.view(np.int64))], names=["doc_id", "fps", "text_key"])

    kind = dict(docs.dtypes)[doc_id]
    return map_batches(docs, [doc_id, text], call, f"doc_id {kind}, fps array<long>, text_key long")


#: Two of the four 16-bit blocks of a fingerprint, for each of the six choices.
CHOICES = list(combinations(range(4), 2))
#: Numbers of the choices of the second dealing start here.
AGAIN = 1 << 12


def dealt_keys() -> str:
    """SQL for an array of a fingerprint's six keys: ``lane`` and the choice in one number, and the chosen blocks."""
    keys = []
    for k, chosen in enumerate(CHOICES):
        mask = sum(0xFFFF << (16 * b) for b in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(f"struct(cast(lane * {len(CHOICES)} + {k} as int) as choice, fp & ({signed}L) as part)")
    return f"array({', '.join(keys)})"


def lane_of(choice: np.ndarray) -> np.ndarray:
    return np.where(choice < AGAIN, choice, (choice - AGAIN) // 28) // len(CHOICES)


def dealt_again(fps: np.ndarray, choice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a large bucket under 28 keys each: of the bits its choice left open, eight blocks of four, six agree."""
    out = []
    for c in np.unique(choice).tolist():
        own = fps[choice == c]
        chosen = CHOICES[c % len(CHOICES)]
        fixed = sum(0xFFFF << (16 * b) for b in chosen)
        free = [b * 4 for b in range(16) if b // 4 not in chosen]
        for k, equal in enumerate(combinations(free, len(free) - RADIUS)):
            mask = fixed | sum(0xF << s for s in equal)
            out.append((own, np.full(len(own), AGAIN + c * 28 + k, dtype=np.int32), own & np.uint64(mask)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (fps[:0], choice[:0], fps[:0])


def linked(fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, first member reached), as places in ``fps``, of the links inside buckets; ``bucket`` is sorted."""
    n = len(fps)
    tables = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    left, right = [], []
    step = 1
    open_at = np.arange(max(n - 1, 0))
    while True:
        open_at = open_at[open_at + step < n]
        open_at = open_at[bucket[open_at] == bucket[open_at + step]]
        if not len(open_at):
            break
        i, j = open_at, open_at + step
        for p in range(tables.shape[1]):
            near = np.abs(tables[i, p] - tables[j, p]) <= radius
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        left.append(i[near])
        right.append(j[near])
        step += 1
    if not left:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def bucket_edges(limit: int, radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams rows sorted by (choice, part, fp): edges of small buckets, new keys for large ones."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, choice: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(fp), kind, dtype=np.int16)), pa.array(choice.astype(np.int32)), pa.array(part.view(np.int64)), pa.array(fp.view(np.int64))],
                names=["kind", "choice", "part", "fp"],
            )

        def settle(choice: np.ndarray, part: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.ones(len(fp), dtype=bool)
            new[1:] = (choice[1:] != choice[:-1]) | (part[1:] != part[:-1])
            bucket = np.cumsum(new) - 1
            size = np.bincount(bucket)[bucket] if len(fp) else bucket
            large = size > limit
            if large.any():
                again, key, masked = dealt_again(fp[large], choice[large])
                if len(again):
                    yield rows(1, key, masked, again)
            small = (size > 1) & ~large
            own, lane = fp[small], lane_of(choice[small])
            a, b = linked(own, bucket[small], radius)
            if len(a):
                yield rows(0, lane[a], own[b], own[a])

        held: list[np.ndarray] | None = None
        last_over = None
        for batch in batches:
            now = [np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64), np.asarray(batch.column(2)).view(np.uint64)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            # A bucket that already overflowed is passed on as it comes.
            open_from = int(np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[-1]) + 1 if ((now[0] != now[0][-1]) | (now[1] != now[1][-1])).any() else 0
            if last_over is not None:
                same = (now[0] == last_over[0]) & (now[1] == last_over[1])
                if same.any():
                    again, key, masked = dealt_again(now[2][same], now[0][same])
                    yield rows(1, key, masked, again)
                    now = [x[~same] for x in now]
                    open_from -= int(same.sum())
                    if not len(now[0]):
                        held = None
                        continue
                    open_from = max(open_from, 0)
                last_over = None
            done, held = [x[:open_from] for x in now], [x[open_from:] for x in now]
            yield from settle(*done)
            if len(held[0]) > limit:
                last_over = (held[0][0], held[1][0])
                again, key, masked = dealt_again(held[2], held[0])
                yield rows(1, key, masked, again)
                held = None
        if held is not None and len(held[0]):
            yield from settle(*held)

    return call


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (lane, a, b) that join the distinct rows (lane, fp) of a lane within ``radius`` into their components."""
    if radius != RADIUS:
        raise ValueError("the block choices are laid out for a radius of 2")
    n = partitions(fps.sparkSession)
    schema = "kind short, choice int, part long, fp long"
    keyed = fps.select("fp", F.explode(F.expr(dealt_keys())).alias("key")).select("key.choice", "key.part", "fp")
    first = keyed.repartition(n, "choice", "part").sortWithinPartitions("choice", "part", "fp").mapInArrow(bucket_edges(BUCKET, radius), schema)
    first = checkpointed(first)
    again = first.where("kind = 1").select("choice", "part", "fp")
    second = again.repartition(n, "choice", "part").sortWithinPartitions("choice", "part", "fp").mapInArrow(bucket_edges(1 << 30, radius), schema)
    return first.where("kind = 0").union(second).select(F.col("choice").alias("lane"), F.col("fp").alias("a"), F.col("part").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 5, lanes: int = 1, samples: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id of the group, fp the first lane's.

    Null and blank texts have fingerprint zero and link like any other. Null
    ids are never smallest; a group of null ids only has a null component.
    Repeated rows give repeated rows. An empty table gives an empty result.
    """
    prints = checkpointed(fingerprints(docs, width, lanes, samples, doc_id, text))
    rep = F.min(F.struct("doc_id", "text_key")).alias("rep")
    distinct = checkpointed(prints.groupBy("fps").agg(F.min("doc_id").alias("first"), rep, F.count(F.lit(1)).alias("n")).withColumn("node", node()))
    spread = distinct.select("node", F.posexplode("fps").alias("lane", "fp"))
    if samples:
        proposed = lane_edges(spread.where("lane = 0"), several=True).union(sampled_edges(spread, distinct, lanes))
        reached = checkpointed(verified(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), distinct, proposed, width, lanes))
    else:
        reached = components(lane_edges(spread, several=lanes > 1))
    # Only linked nodes ask for the smallest id of their component; of the others each is its own.
    own = distinct.select("node", "first", "n")
    linked_ = checkpointed(own.join(reached, "node"))
    lowest = checkpointed(linked_.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("m")))
    named = hot_joined(linked_, lowest, "root", "m", linked_.count()).select("node", "n", "component_id")
    alone = own.join(linked_.select("node"), "node", "left_anti").select("node", "n", F.col("first").alias("component_id"))
    members = checkpointed(named.unionByName(alone))
    found = hot_joined(prints.select("doc_id", "fps", node().alias("node")), members, "node", "n", prints.count())
    return found.select("doc_id", F.element_at("fps", 1).alias("fp"), "component_id")


def lane_edges(spread: DataFrame, several: bool) -> DataFrame:
    """Edges (a, b) that join the nodes (node, lane, fp) within the radius in any lane into their components.

    ``several`` tells that a node has further fingerprints, so nodes may share one.
    """
    # The first node of each fingerprint stands for all that share it.
    held = checkpointed(spread.groupBy("lane", "fp").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")))
    found = links(held.select("lane", "fp"))
    for end in ("a", "b"):
        rep = held.select("lane", F.col("fp").alias(end), F.col("rep").alias(f"rep_{end}"))
        found = found.join(rep, ["lane", end])
    edges = found.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    if several:
        key = F.struct("lane", "fp").alias("key")
        shared = hot_joined(spread.select("node", key), held.where("n > 1").select(key, "rep", "n"), "key", "n", spread.count())
        edges = edges.union(shared.where("node <> rep").select("node", "rep"))
    return edges


def sampled_edges(spread: DataFrame, distinct: DataFrame, lanes: int) -> DataFrame:
    """Edges (a, b) that join the nodes of a sample whose lanes differ in a small enough share of bits into their components."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bucket in whole_groups(batches, 2):
            nodes, prints = rows.column(2).to_numpy(), lane_bits(rows.column(3), lanes)
            root = joined(bucket, lambda i, j, prints=prints: lanes_agree(prints, i, j))
            at = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[root[at]])], names=["a", "b"])

    samples = spread.where(F.col("lane") >= lanes)
    several = samples.groupBy("lane", "fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("lane", "fp")
    own = distinct.select("node", F.slice("fps", 1, lanes).alias("prints"))
    rows = samples.join(several, ["lane", "fp"]).join(own, "node").select("lane", "fp", "node", "prints")
    rows = rows.repartition(partitions(spread.sparkSession), "lane", "fp").sortWithinPartitions("lane", "fp", "node")
    return rows.mapInArrow(call, "a long, b long").distinct()


def verified(docs: DataFrame, distinct: DataFrame, proposed: DataFrame, width: int, lanes: int) -> DataFrame:
    """(node, root) for the nodes of ``proposed``; root is the smallest node reachable over pairs that share ``SIMILAR`` of their shingles.

    One text of each node goes to the task of its proposed component, which
    holds the shingles of one component at a time and tries all of its pairs
    but those that sizes, tables or lanes discard or that are already joined.
    """
    share, of = SIMILAR

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shingled() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [np.unique(shingle_hashes(t.translate(LOWER).split(), width)).tobytes() for t in texts(batch.column(3))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.large_binary())], names=["part", "node", "prints", "shingles"])

        for rows, bucket in whole_groups(shingled(), 1):
            nodes, prints = rows.column(1).to_numpy(), lane_bits(rows.column(2), lanes)
            sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in rows.column(3)]
            size = np.array([len(x) for x in sets], dtype=np.int64)

            def near(i: np.ndarray, j: np.ndarray, prints: np.ndarray = prints, sets: list[np.ndarray] = sets, size: np.ndarray = size) -> np.ndarray:
                may = of * np.minimum(size[i], size[j]) >= share * np.maximum(size[i], size[j])
                may[may] = lanes_agree(prints, i[may], j[may])
                for k in np.flatnonzero(may).tolist():
                    both = len(np.intersect1d(sets[i[k]], sets[j[k]], assume_unique=True))
                    may[k] = of * both >= share * (size[i[k]] + size[j[k]] - both)
                return may

            root = joined(bucket, near)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])

    parts = components(proposed).select("node", F.col("root").alias("part"))
    key = F.xxhash64("rep.doc_id", "rep.text_key").alias("rep_key")
    wanted = parts.join(distinct.select("node", key, F.slice("fps", 1, lanes).alias("prints")), "node")
    # One text of a node, by its id and hash, so that copies of a text don't meet; repeated rows may.
    hashed = docs.select(F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).alias("rep_key"), "text")
    rows = hashed.join(wanted, "rep_key").dropDuplicates(["rep_key"])
    rows = rows.select("part", "node", "prints", "text").repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part", "node")
    return rows.mapInArrow(call, "node long, root long")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by their first ``keys`` columns, as tables that part no group, with the number of each row's group."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([held, now]) if held is not None else now
        starts = group_starts(now, keys)
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield now.slice(0, last), numbered(starts[:-1], last)
        held = now.slice(last)
    if held is not None and held.num_rows:
        yield held, np.zeros(held.num_rows, dtype=np.int64)


def group_starts(rows: pa.Table, keys: int) -> np.ndarray:
    new = np.ones(rows.num_rows, dtype=bool)
    if len(new):
        own = [rows.column(k).to_numpy() for k in range(keys)]
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in own])
    return np.flatnonzero(new)


def numbered(starts: np.ndarray, n: int) -> np.ndarray:
    new = np.zeros(n, dtype=np.int64)
    new[starts] = 1
    return np.cumsum(new) - 1


def lane_bits(column: pa.ChunkedArray, lanes: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, lanes)


def undiscarded(prints: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs at places ``i`` and ``j`` the tables of distances can't discard.

    By the triangle inequality two bytes differ in no fewer bits than their
    distances to any reference do, so the sum over the bytes is never too much.
    """
    own = np.ascontiguousarray(prints).view(np.uint8)
    left = [np.zeros(0, dtype=np.int64)]
    for k in range(0, len(i), PAIRS):
        both = own[i[k : k + PAIRS]].astype(np.uint16) << 8 | own[j[k : k + PAIRS]]
        left.append(np.flatnonzero(APART.take(both).sum(axis=1, dtype=np.int64) <= radius) + k)
    return np.concatenate(left)


def lanes_agree(prints: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the lanes at places ``i`` and ``j`` together differ in few enough bits; only what the tables leave is compared."""
    radius = int(DIFFERING * 64 * prints.shape[1])
    agree = np.zeros(len(i), dtype=bool)
    left = undiscarded(prints, i, j, radius)
    agree[left] = np.bitwise_count(prints[i[left]] ^ prints[j[left]]).sum(axis=1, dtype=np.int64) <= radius
    return agree


def joined(bucket: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first place of each place's component, of all pairs inside buckets that are ``near``; ``bucket`` is sorted.

    Every pair is tried but those already joined, so a large group of near copies costs few tests.
    """
    root = np.arange(len(bucket))
    open_at, step = np.arange(len(bucket)), 1
    while True:
        open_at = open_at[open_at + step < len(bucket)]
        open_at = open_at[bucket[open_at] == bucket[open_at + step]]
        if not len(open_at):
            return root
        i = open_at[root[open_at] != root[open_at + step]]
        if len(i):
            hit = near(i, i + step)
            for k in i[hit].tolist():
                a, b = k, k + step
                while root[a] != a:
                    a = int(root[a])
                while root[b] != b:
                    b = int(root[b])
                root[max(a, b)] = min(a, b)
            if hit.any():
                while not np.array_equal(root, root[root]):
                    root = root[root]
        step += 1


def node() -> Column:
    """One long for the fingerprints of a row: the fingerprint itself where there is one lane."""
    return F.when(F.size("fps") == 1, F.element_at("fps", 1)).otherwise(F.xxhash64("fps"))
