"""License scans: matching statistics against a generalised suffix automaton.

The automaton holds every run of words of every template. A text is streamed
through it once: after each word it stands at the longest run that ends there
and occurs in some template. Long maximal runs are chained, template by
template, while they advance in both the text and the template; a chain is a
span of the text with the share of the template's words it covers. Of spans
that overlap the one that covers most words of its template stays.

The automaton is built from a fixed template list, so what is sent to the
executors doesn't grow with the input, and every row is scanned on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khamkit.llm.common import map_batches, texts

#: Phrases whose places are counted, and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: The texts that come with the library: label and text a line.
TEXTS = Path(__file__).with_name("license_texts.tsv")
#: The least run that is chained, the most words skipped between runs, and the least share of a template that makes a span.
LEAST, GAP, SHARE = 3, 6, 0.6
#: The words that a span covers at least (a template that is shorter must be there whole), and how many always do.
COVERED, DECISIVE = 8, 30
#: Letters and digits of ASCII and every byte beyond it stay (upper case lowered), all else parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def license_texts(path: Path = TEXTS) -> tuple[tuple[str, str], ...]:
    """(words, label) of the lines of a list; lines that begin with # don't count."""
    lines = [x.split("\t") for x in path.read_text(encoding="utf-8").splitlines() if x and not x.startswith("#")]
    return tuple((b" ".join(text.encode().translate(FOLD).split()).decode(), label) for label, text in lines)


class SuffixAutomaton:
    """A generalised suffix automaton of word sequences (ids from 0)."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self.extended(last, word)
                self.ends[last].add((k, at + 1))
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]

    def extended(self, last: int, word: int) -> int:
        """The state of the run at ``last`` followed by ``word``, made where it is missing."""
        if word in self.next[last]:
            have = self.next[last][word]
            return have if self.length[have] == self.length[last] + 1 else self.split(last, word, have)
        new = self.state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            have = self.next[at][word]
            self.link[new] = have if self.length[have] == self.length[at] + 1 else self.split(at, word, have)
        return new

    def split(self, at: int, word: int, have: int) -> int:
        """A copy of ``have`` for its runs of one word more than ``at`` and fewer."""
        copy = self.state(self.length[at] + 1, dict(self.next[have]), self.link[have])
        self.link[have] = copy
        while at >= 0 and self.next[at].get(word) == have:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.length) - 1

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """After each word, the state and the length of the longest run that ends there."""
        state, length = 0, 0
        for word in ids:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield state, length


class Scanner:
    """Phrases and templates compiled for streaming."""

    def __init__(self, phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] | None = None) -> None:
        every = [*phrases, *(license_texts() if templates is None else templates)]
        words = [p.encode().split() for p, _ in every]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        self.sequences = [[self.vocabulary[w] for w in ws] for ws in words]
        self.labels = [label for _, label in every]
        self.n_phrases = len(phrases)
        self.automaton = SuffixAutomaton(self.sequences)
        self.shortest = min((len(s) for s in self.sequences[: self.n_phrases]), default=LEAST)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Places (phrase, start) of phrases, and spans (template, start, stop, share)."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        known = np.concatenate([[0], (ids >= 0).view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(known))
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= min(self.shortest, LEAST)
        places: list[tuple[int, int]] = []
        runs: list[tuple[int, int, int]] = []
        for start, stop in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            self.stream(ids[start:stop].tolist(), start, places, runs)
        return places, self.chained(runs)

    def stream(self, ids: list[int], start: int, places: list[tuple[int, int]], runs: list[tuple[int, int, int]]) -> None:
        """Adds the phrases of one stretch of known words, and its maximal runs (state, start, length)."""
        held = (0, 0)
        for at, (state, length) in enumerate(self.automaton.statistics(ids)):
            if length >= self.shortest:
                for k in range(self.n_phrases):
                    n = len(self.sequences[k])
                    if length >= n and ids[at - n + 1 : at + 1] == self.sequences[k]:
                        places.append((k, start + at - n + 1))
            if length <= held[1] and held[1] >= LEAST:
                runs.append((held[0], start + at - held[1], held[1]))
            held = (state, length)
        if held[1] >= LEAST:
            runs.append((held[0], start + len(ids) - held[1], held[1]))

    def chained(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Chains of runs in one template, each as its span and the share of the template it covers."""
        open_at: dict[int, list[list[int]]] = {}
        spans: list[tuple[int, int, int, float]] = []

        def close(k: int, chain: list[int]) -> None:
            n = len(self.sequences[k])
            if chain[3] >= max(min(SHARE * n, DECISIVE), min(n, COVERED)):
                spans.append((k, chain[0], chain[1], min(1.0, chain[3] / n)))

        for state, start, length in runs:
            by_template: dict[int, list[int]] = {}
            for k, end in self.automaton.ends[state]:
                if k >= self.n_phrases:
                    by_template.setdefault(k, []).append(end)
            for k, ends in by_template.items():
                chains = open_at.setdefault(k, [])
                for chain in [c for c in chains if start - c[1] > GAP]:
                    chains.remove(chain)
                    close(k, chain)
                grown = False
                for chain in chains:
                    later = [e for e in ends if e > chain[2] and e - length - chain[2] <= GAP]
                    if later and start + length > chain[1]:
                        end = min(later)
                        chain[3] += min(length, end - chain[2], start + length - chain[1])
                        chain[1], chain[2] = start + length, end
                        grown = True
                if not grown:
                    chains.append([start, start + length, min(ends), length])
        for k, chains in open_at.items():
            for chain in chains:
                close(k, chain)
        return self.foremost(spans)

    def foremost(self, spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """Spans in order, without those half of whose words lie in a span that covers more of its template.

        Licenses share sentences; of the templates that a passage covers the one
        with the most words there counts, of equal ones the one it covers best.
        """
        kept: list[tuple[int, int, int, float]] = []
        for s in sorted(spans, key=lambda s: (-round(s[3] * len(self.sequences[s[0]])), -s[3], s[1], s[0])):
            if all(2 * (min(s[2], t[2]) - max(s[1], t[1])) <= s[2] - s[1] for t in kept):
                kept.append(s)
        return sorted(kept, key=lambda s: (s[1], s[2], s[0]))


def scanned(docs: DataFrame, scanner: Scanner | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, phrases and spans.

    ``phrases`` lists (label, start) of every place of a phrase, ``spans``
    (label, start, stop, share) of every chain that covers enough of a
    template; words count from 0. Null text is empty. Repeated rows are
    scanned each. An empty table gives an empty result.
    """
    scanner = scanner or Scanner()

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrase = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())]))
        labels = scanner.labels
        for batch in batches:
            n, phrases, spans = [], [], []
            for text in texts(batch.column(1)):
                words = text.translate(FOLD).split()
                places, found = scanner.scan(words) if words else ([], [])
                n.append(len(words))
                phrases.append([{"label": labels[k], "start": at} for k, at in places])
                spans.append([{"label": labels[k], "start": a, "stop": b, "share": share} for k, a, b, share in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(phrases, phrase), pa.array(spans, span)], names=["doc_id", "n_words", "phrases", "spans"])

    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, n_words long, phrases array<struct<label: string, start: long>>, spans array<struct<label: string, start: long, stop: long, share: double>>"
    return map_batches(docs, [doc_id, text], call, schema)


def labelled(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """The scan's digest: counts and places of phrases, labels of phrases and of all, and the best share."""
    own = F.transform("phrases", lambda p: p["label"])
    further = F.transform("spans", lambda s: s["label"])
    best = F.array_max(F.transform("spans", lambda s: s["share"]))
    return scanned(docs, scanner).select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(F.transform("phrases", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("phrases", lambda p: p["start"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, further))), ",").alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.least(F.coalesce(best, F.lit(0.0)), F.lit(1.0))).alias("score"),
    )
