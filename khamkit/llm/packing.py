"""Packing documents into fixed windows by best fit decreasing.

A document's tokens are its text's ids and one end id. An overlong document is
first cut into full windows; what is left of it, or a shorter document whole,
is a piece to be placed. Pieces go, longest first, into the open window with
the least room that still holds them. Room is an integer of 0 to the window,
so a segment tree over room finds that window in log(window) steps, however
many are open.

Every task packs the rows it reads, in runs of a bounded number of tokens, so
nothing is shuffled and memory doesn't grow with the input. Windows are padded
at their ends; a run leaves few of them with much room.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from khamkit.llm.common import map_batches

WINDOW = 2048
END = 1
#: Tokens packed together by a task.
RUN_TOKENS = 12_000_000
#: Words whose ids a worker remembers.
REMEMBERED = 700_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A file of the public tokenizers; KHAMKIT_TOKENIZERS names another folder."""
    folder = os.environ.get("KHAMKIT_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordIds(dict):
    """Ids of blank-separated words, as little-endian bytes.

    The tokenizer's rules never join characters across blanks, so the ids of a
    text are those of its words in order.
    """

    def __init__(self, data: bytes) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.plain = self.letters_apart()

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(b".,")
        if len(core) < len(word) and self.plain and core.isalpha():
            # Letters and what follows them are tokens apart.
            ids = self[core.lower()] + self[word[len(core) :]]
        elif self.plain and word.isalpha():
            low = word.lower()
            ids = self[low] if low != word else self.packed([t.id for t in self.tokenizer.model.tokenize(low.decode())])
        else:
            ids = self.packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        if len(word) <= 32:
            self[word] = ids
        return ids

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def letters_apart(self) -> bool:
        """Whether runs of ASCII letters, in lower case, go to the model as they are and apart from full stops and commas."""
        probe = ["Thanedble", "thanedble", "thanedble,", "thanedble..,"]
        whole = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in probe]
        model = [t.id for t in self.tokenizer.model.tokenize("thanedble")]
        stops = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in (",", "..,")]
        return whole == [model, model, model + stops[0], model + stops[1]]

    def of(self, text: bytes) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(key: str, data: Callable[[], bytes]) -> WordIds:
    """One of each tokenizer per worker process, kept from task to task."""
    if key not in _WORD_IDS:
        _WORD_IDS[key] = WordIds(data())
    return _WORD_IDS[key]


class Rooms:
    """Open windows by room left; a segment tree over room holds how many windows have it."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, sequence: int, room: int) -> None:
        self.open[room].append(sequence)
        at = self.leaves + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The sequence with the least room of ``size`` or more, and that room."""
        count = self.count
        at = self.leaves + size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return self.open[room].pop(), room


def best_fit(lengths: list[int], window: int, first: int) -> tuple[list[int], list[int], int]:
    """The sequence and offset of each piece, and the next free sequence number."""
    rooms = Rooms(window)
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = rooms.take(lengths[k])
        if found is None:
            found = (first, window)
            first += 1
        sequence[k], room = found
        offset[k] = window - room
        if room > lengths[k]:
            rooms.put(sequence[k], room - lengths[k])
    return sequence, offset, first


def packer(tokenizer: object, key: str, window: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(key, lambda: tokenizer.value)
        tail = np.array([end], dtype="<u4").tobytes()
        step = 4 * window
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        held: list[tuple] = []
        tokens = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            sequence, offset, number = best_fit([len(x[2]) // 4 for x in held], window, number)
            for k in range(0, len(held), 2000):
                own = held[k : k + 2000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in own], kind),
                        pa.array([x[1] for x in own], pa.int64()),
                        pa.array([len(x[2]) // 4 for x in own], pa.int64()),
                        pa.array([x[2] for x in own], pa.binary()),
                        pa.array([x[3] for x in own], pa.int64()),
                        pa.array(sequence[k : k + 2000], pa.int64()),
                        pa.array(offset[k : k + 2000], pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids = ids_of.of(text.as_py() or b"") + tail
                for at in range(0, len(ids), step):
                    held.append((doc_id, at // 4, ids[at : at + step], len(ids) // 4))
                tokens += len(ids) // 4
                if tokens >= RUN_TOKENS:
                    yield from packed()
                    held.clear()
                    tokens = 0
        if held:
            yield from packed()

    return call


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned 32 bits), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizers file; the driver reads it and sends it to the workers.
    Null text is empty: its document is the end id alone. Repeated rows are
    packed each. Sequence ids are unique, not gapless; pieces of a sequence lie
    at offsets without gaps from 0. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    data = Path(tokenizer).read_bytes()
    shared = docs.sparkSession.sparkContext.broadcast(data)
    return map_batches(docs, [doc_id, text], packer(shared, hashlib.sha256(data).hexdigest(), window, end), schema)
