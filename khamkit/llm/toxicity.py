"""Toxicity by the votes of the nearest labelled examples.

Examples are a bounded sample of labelled documents. A text's features are its
words and word beginnings; all that tell the classes of the sample apart are
kept (by chi-square, with no limit on their number), weighted by term frequency
and by inverse document frequency over all documents, and scaled to length one. The nearest examples by cosine are found
exactly in an inverted index whose postings are cut into blocks of examples
with the largest weight of each: blocks are visited by the bound this puts on
their cosines, until no block left can hold a nearer example.

Votes weigh by similarity and by how far the example's class is thinned out in
the sample, and lean on the class shares, so a score estimates how often such
texts are toxic. The nearest examples are the evidence.

Fixed by parameters: examples of a class, the least chi-square, neighbours; a
least chi-square of 0 keeps every word of the sample. Document frequencies come
from all documents, and every document is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khamkit.llm.common import checkpointed, map_batches, texts

#: The most examples of each class, neighbours that vote, examples in a block.
TOXIC, CLEAN, NEAREST, BLOCK = 2000, 4000, 15, 64
#: The least chi-square of a feature against the classes, and the least examples that have it.
LEAST_CHI, LEAST_COUNT = 30.0, 4
BEGINNINGS = (4, 5, 6)
#: Tokens of more bytes are taken for several words without blanks.
LONG = 40
#: Cosines closer than this are equal.
TIE = 1e-12
#: The weight of the class shares beside the votes.
LEAN = 0.25
REMEMBERED = 400_000
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_features(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked by a blank; of a long token every piece counts as a beginning, so all of it does."""
    out = [word, *(b" " + word[:n] for n in BEGINNINGS if len(word) > n)]
    if len(word) > LONG:
        out += [b" " + word[k : k + n] for n in BEGINNINGS for k in range(1, len(word) - n + 1) if word[k] & 0xC0 != 0x80]
    return out


class Features(dict):
    """Known features of a word, as a tuple of their numbers; words are remembered up to a bound."""

    def __init__(self, numbers: dict[bytes, int]) -> None:
        self.numbers = numbers

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = tuple(self.numbers[f] for f in word_features(word) if f in self.numbers)
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found
        return found

    def counts(self, text: bytes) -> dict[int, int]:
        hits = filter(None, map(self.__getitem__, text.translate(FOLD).split()))
        return Counter(n for hit in hits for n in hit)


def weights(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of a text's features, of length one."""
    at = np.fromiter(sorted(counts), dtype=np.int64, count=len(counts))
    w = (1 + np.log(np.array([counts[i] for i in at.tolist()], dtype=np.float64))) * idf[at] if len(at) else np.zeros(0)
    norm = float(np.sqrt((w * w).sum()))
    return at, w / norm if norm else w


@dataclass
class BlockMaxIndex:
    """Postings of feature weights by block of examples, with each block's largest weight."""

    n: int
    blocks: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    postings: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)

    @staticmethod
    def of(vectors: list[tuple[np.ndarray, np.ndarray]]) -> BlockMaxIndex:
        index = BlockMaxIndex(len(vectors))
        lists: dict[int, list[tuple[int, float]]] = {}
        for k, (at, w) in enumerate(vectors):
            for f, x in zip(at.tolist(), w.tolist(), strict=True):
                lists.setdefault(f, []).append((k, x))
        for f, found in lists.items():
            ids, w = np.array([k for k, _ in found]), np.array([x for _, x in found])
            own = {b: (ids[ids // BLOCK == b] % BLOCK, w[ids // BLOCK == b]) for b in np.unique(ids // BLOCK).tolist()}
            index.postings[f] = own
            index.blocks[f] = (np.array(list(own)), np.array([x.max() for _, x in own.values()]))
        return index

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The ``k`` examples with the largest cosines above 0, best first; of equal ones the first examples."""
        known = [(f, x) for f, x in zip(at.tolist(), w.tolist(), strict=True) if f in self.postings]
        if not known:
            return []
        bound = np.zeros(self.n // BLOCK + 1)
        for f, x in known:
            blocks, most = self.blocks[f]
            bound[blocks] += x * most
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) == k and bound[b] < best[-1][0] - TIE):
                break
            cosines = np.zeros(BLOCK)
            for f, x in known:
                found = self.postings[f].get(b)
                if found is not None:
                    cosines[found[0]] += x * found[1]
            floor = best[-1][0] - TIE if len(best) == k else TIE
            for i in np.flatnonzero(cosines > floor).tolist():
                best.append((round(float(cosines[i]), 12), b * BLOCK + i))
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
        return best


@dataclass
class Model:
    """What the executors need: features, idf, the index, and the examples' labels and votes."""

    numbers: dict[bytes, int]
    idf: np.ndarray
    index: BlockMaxIndex
    ids: list
    labels: np.ndarray
    votes: np.ndarray
    share: float
    bare: float

    def scored(self, counts: dict[int, int]) -> tuple[float, list[tuple[float, int]]]:
        """A score between 0 and 1, and the nearest examples; without known features the share of such examples."""
        if not counts:
            return self.bare, []
        found = self.index.nearest(*weights(counts, self.idf), NEAREST)
        if not found:
            return self.bare, []
        own = np.array([k for _, k in found])
        vote = np.array([c for c, _ in found]) ** 2 * self.votes[own]
        return float(((vote * self.labels[own]).sum() + LEAN * self.share) / (vote.sum() + LEAN)), found


def examples(docs: DataFrame, labels: DataFrame, toxic: int, clean: int, doc_id: str, text: str, label: str) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, text) of at most so many labelled documents of each class, and how many there are of each.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are seen. Which ones
    is settled by a hash, so reruns agree. An id that documents repeat gives one
    example, its first text by hash.
    """
    rows = labels.where(F.col(label).isin(0, 1) & (F.crc32(F.col(doc_id).cast("string")) % 5 != 0))
    rows = rows.groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
    have = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.col(doc_id), F.lit(8))
    chosen = [rows.where(F.col("label") == y).orderBy(order, doc_id).limit(most) for y, most in ((0, clean), (1, toxic))]
    sample = chosen[0].union(chosen[1]).select(F.col(doc_id).alias("example"), "label")
    # At most ``toxic + clean`` rows, so the broadcast is bounded.
    found = docs.select(doc_id, text).join(F.broadcast(sample), F.col(doc_id) == F.col("example"))
    found = found.groupBy("example", "label").agg(F.min_by(F.coalesce(text, F.lit("")), F.xxhash64(F.coalesce(text, F.lit("")))).alias("text"))
    return found, have


def fitted(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", least_chi: float = LEAST_CHI, least_count: int = LEAST_COUNT) -> Model:
    """The model; with labels of one class or none it scores every text alike, 1 or 0.

    What is collected is bounded by the sample: its features and vectors.
    Labels that are null or neither 0 nor 1 don't count; of labels that differ
    for one id the larger does.
    """
    spark = docs.sparkSession
    sample, have = examples(docs, labels, toxic, clean, doc_id, text, label)
    sample = checkpointed(sample)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                found = {f for w in set(t.translate(FOLD).split()) for f in word_features(w)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([y] * len(found), pa.int32())], names=["feature", "label"])

    n = dict.fromkeys((0, 1), 0) | {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = n[0] + n[1]
    if not n[0] or not n[1]:
        only = 1.0 if n[1] else 0.0
        return Model({}, np.zeros(0), BlockMaxIndex(0), [], np.zeros(0), np.zeros(0), only, only)
    seen = map_batches(sample, ["label", "text"], spread, "feature binary, label int").groupBy("feature").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    a, b, c, d = F.col("a"), F.col("b"), n[1] - F.col("a"), n[0] - F.col("b")
    chi = total * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d + 1e-9) * float(n[1]) * float(n[0]))
    best = seen.where(a + b >= least_count).select("feature", chi.cast("double").alias("chi")).where(F.col("chi") >= least_chi)
    kept = sorted(bytes(r["feature"]) for r in best.select("feature").collect())
    numbers = {f: i for i, f in enumerate(kept)}
    shared = spark.sparkContext.broadcast(numbers)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, df, rows = Features(shared.value), np.zeros(len(shared.value) + 1, dtype=np.int64), 0
        for batch in batches:
            for t in texts(batch.column(0)):
                at = list(features.counts(t))
                df[at] += 1
                rows += 1
        df[-1] = rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["number", "n"])

    counted = map_batches(docs, [text], frequencies, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(numbers) + 1)
    for r in counted:
        df[r["number"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value)
        for batch in batches:
            found = [sorted(features.counts(t).items()) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[k for _, k in f] for f in found], pa.list_(pa.int32()))], names=["example", "label", "numbers", "counts"])

    kind = dict(sample.dtypes)["example"]
    rows = map_batches(sample, ["example", "label", "text"], vectors, f"example {kind}, label int, numbers array<int>, counts array<int>").collect()
    rows = sorted(rows, key=lambda r: (r["example"], r["label"], r["numbers"]))
    labels_of = np.array([r["label"] for r in rows], dtype=np.float64)
    thinned = {y: max(1.0, have[y] / n[y]) for y in (0, 1)}
    votes = np.array([thinned[r["label"]] for r in rows])
    share = float((votes * labels_of).sum() / votes.sum())
    empty = np.array([not r["numbers"] for r in rows])
    bare = float((votes * labels_of)[empty].sum() + share) / float(votes[empty].sum() + 1)
    index = BlockMaxIndex.of([weights(dict(zip(r["numbers"], r["counts"], strict=True)), idf) for r in rows])
    return Model(numbers, idf, index, [r["example"] for r in rows], labels_of, votes, share, bare)


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, evidence) of every row; evidence lists (doc_id, label, cosine) of the examples that voted.

    Null text is empty and scores as texts without known features do. Repeated
    rows are scored each; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        features = Features(own.numbers)
        for batch in batches:
            kind = batch.column(0).type
            found = [own.scored(features.counts(t)) for t in texts(batch.column(1))]
            evidence = pa.list_(pa.struct([("doc_id", kind), ("label", pa.int32()), ("cosine", pa.float64())]))
            listed = [[{"doc_id": own.ids[k], "label": int(own.labels[k]), "cosine": c} for c, k in near] for _, near in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(listed, evidence)], names=["doc_id", "score", "evidence"])

    kind = dict(docs.dtypes)[doc_id]
    return map_batches(docs, [doc_id, text], call, f"doc_id {kind}, score double, evidence array<struct<doc_id: {kind}, label: int, cosine: double>>")
