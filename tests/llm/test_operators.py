"""Each corpus operator against brute force, and at its edges."""

from __future__ import annotations

import hashlib
import json
import random
import re
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from samples import SCHEMA, WORDS, clashed, sentence
from pyspark.sql import functions as F

from khamkit.llm import common, components, licenses, mixing, packing, quality, simhash, sketches, substring, toxicity, urls, wrappers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# Quality rules.


def counted(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def junk(text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words):
    """The further rules, by themselves."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    letters = sum(unicodedata.category(c)[0] in "LM" for c in text)
    bulleted = sum(bool(re.match(r"[ \t]*[\u2022\u2023\u25E6*+-][ \t]", x)) for x in lines)
    broken = sum(bool(re.search(r"(\.\.\.|\u2026)[ \t\r]*\Z", x)) for x in lines)
    return (
        10 * n_symbols > 3 * n_words
        or word_chars > 15 * n_words
        or 10 * word_chars < 20 * n_words
        or (n_dup_lines >= 3 and 100 * n_dup_lines > 30 * len(lines))
        or 100 * letters < 40 * word_chars
        or (n_words >= 200 and 50 * len(set(WORD.findall(text))) < n_words)
        or (len(lines) >= 5 and (10 * bulleted > 9 * len(lines) or 10 * broken > 5 * len(lines)))
    )


def test_quality(spark, docs, rows, empty):
    pick = random.Random(51)
    prose = [sentence(pick, 12) for _ in range(30)]
    more = [(900, "a\na\nb\n \n \na", "en", "a", 0), (901, "x # y ## z " * 30, "en", "a", 0)]
    more += [(902, "\n".join(prose), "en", "a", 0), (903, "\n".join(f" \u2022 {x}" for x in prose), "en", "a", 0), (904, "\n".join(f"{x}... \r" for x in prose), "en", "a", 0)]
    more += [(905, " ".join(str(pick.random()) for _ in range(300)), "en", "a", 0), (906, " ".join(pick.choice("ab") * pick.randint(1, 2) for _ in range(400)), "en", "a", 0), (907, "\n".join(f"{x}\u2026" if k < 14 else x for k, x in enumerate(prose)), "en", "a", 0)]
    every = docs.union(spark.createDataFrame(more, SCHEMA))
    found = by_id(quality.quality_rules(every), *COUNTS, "base_failed", "kept")
    for doc_id, text, *_ in rows + more:
        n = counted(text)
        assert found[doc_id][:5] == n
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert found[doc_id][5] == failed and found[doc_id][6] == (not failed and not junk(text or "", *n))
    assert [found[i][6] for i in range(902, 908)] == [True, False, False, False, False, True]
    assert by_id(quality.quality_rules(clashed(docs)), *COUNTS, "kept") == {i: (*found[i][:5], found[i][6]) for i, *_ in rows}
    assert quality.quality_rules(empty).count() == 0


def test_quality_order_keeps_verdicts(docs):
    rules = quality.default_rules()
    first = by_id(quality.quality_rules(docs, rules), "kept")
    assert by_id(quality.quality_rules(docs, rules[::-1]), "kept") == first
    costly = [quality.Rule("dear", F.col("n_words") > 100, 9.0), quality.Rule("cheap", F.col("n_words") > 100, 1.0), quality.Rule("idle", F.lit(False), 1.0)]
    assert [r.name for r in quality.ordered(costly, quality.counts(docs.select("text")))] == ["cheap", "dear", "idle"]


# SimHash.


def fingerprint(text, width):
    w = (text or "").encode().translate(simhash.LOWER).split()
    shingles = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    if not shingles:
        return 0
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def reached(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_simhash(docs, rows, empty):
    prints = {i: fingerprint(t, 3) for i, t, *_ in rows}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = reached(prints, pairs)
    found = by_id(simhash.near_duplicates(docs, 3), "fp", "component_id")
    assert {i: (fp % 2**64, c) for i, (fp, c) in found.items()} == {i: (prints[i], roots[i]) for i in prints}
    assert by_id(simhash.near_duplicates(clashed(docs), 3), "component_id") == {i: (c,) for i, c in roots.items()}
    assert simhash.near_duplicates(empty, 3).count() == 0


def test_simhash_repeated_and_null_ids(spark):
    rows = [(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "q r s t u"), (3, None)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in found) == [("3", "3"), ("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]


def test_simhash_large_buckets(spark):
    """Hundreds of fingerprints that agree on most bits, over several batches."""
    pick = random.Random(3)
    base = pick.getrandbits(64)
    prints = {base}
    while len(prints) < 900:
        prints.add(base ^ sum(1 << b for b in pick.sample(range(40), pick.randrange(1, 6))))
    prints |= {pick.getrandbits(64) for _ in range(300)}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        edges = simhash.links(spark.createDataFrame([(0, p) for p in signed], "lane int, fp long"))
        found = {r["node"]: r["root"] for r in components.components(edges.select("a", "b")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    values = np.array(signed, dtype=np.int64)
    pairs = [(signed[i], signed[j]) for i in range(len(signed)) for j in (np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 2) + i + 1)]
    roots = reached(signed, pairs)
    assert {n: found.get(n, n) for n in signed} == roots


def test_simhash_samples_find_near_copies(spark, docs, rows):
    found = by_id(simhash.near_duplicates(docs, 5, lanes=4, samples=16), "component_id")
    first = next(i for i, t, *_ in rows if t and len(t.split()) == 300)
    near = [i for i, t, *_ in rows if t and len(t.split()) == 300]
    assert all(found[i] == (first,) for i in near)
    assert len({found[i] for i, t, *_ in rows if t and 40 <= len(t.split()) < 300}) >= len({t for _, t, *_ in rows if t and 40 <= len(t.split()) < 300}) - 1
    # Pairs of a similarity of 0.8 to 0.9, and of 0.5 and less.
    pick = random.Random(21)
    pairs = []
    for k in range(60):
        words = sentence(pick, 300).split()
        other = list(words)
        for at in range(3, 300, 60 if k < 30 else 12):
            other[at] = "changed"
        pairs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    linked = by_id(simhash.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string"), 5, lanes=4, samples=16), "component_id")
    assert sum(linked[2 * k + 1] == (2 * k,) for k in range(30)) >= 28
    assert all(linked[2 * k + 1] == (2 * k + 1,) for k in range(30, 60))


def test_simhash_samples_try_all_of_a_bucket(spark):
    """Pairs of near copies around one passage: a sample out of it has all pairs, and its first node is mostly of another."""
    pick = random.Random(31)
    passage = sentence(pick, 160)
    rows = []
    for k in range(80):
        own = sentence(pick, 40).split()
        rows += [(2 * k, f"{passage} {' '.join(own)}"), (2 * k + 1, f"{passage} {' '.join([*own[:20], 'changed', *own[21:]])}")]
    prints = {i: simhash.fingerprint(t.encode(), 5, 4, 1) for i, t in rows}
    differing = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(prints[a][:4], prints[b][:4], strict=True))
    near = [k for k in range(0, 160, 2) if prints[k][4] == prints[k + 1][4] and differing(k, k + 1) <= 0.18 * 256]
    found = by_id(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, lanes=4, samples=1), "component_id")
    assert len(near) > 40 and all(found[k] == found[k + 1] for k in near)


def test_simhash_samples_link_by_similarity(spark):
    """Pairs link from a real similarity of 0.8 on and not below, and so do groups of them."""
    pick = random.Random(41)
    rows = []
    for k in range(160):
        words = sentence(pick, 200).split()
        other = list(words)
        for at in pick.sample(range(3, 195, 6), 3 + k % 8):
            other[at] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    # One group edited further and further, and one pair that differs in how often a line is repeated.
    words = sentence(pick, 300).split()
    for k in range(20):
        words[11 * k + 5] = "edited"
        rows.append((1000 + k, " ".join(words)))
    rows += [(2000, " ".join(words[:80])), (2001, " ".join(words[:80] + words[70:80] * 40))]
    sets = {i: {" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert 20 < len([a for a, b in pairs if a < 320]) < 140
    found = by_id(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, lanes=4, samples=16), "component_id")
    assert {i: c for i, (c,) in found.items()} == reached(sets, pairs)


def test_simhash_tables_for_lanes(spark):
    """The tables discard no pair within the radius and most pairs beyond; lanes_agree is the comparison of all bits."""
    pick = np.random.default_rng(51)
    first = pick.integers(0, 2**64, 3000, dtype=np.uint64, endpoint=False).reshape(-1, 4)
    flips = np.packbits(pick.random((750, 256)) < np.linspace(0.0, 0.5, 750)[:, None], axis=1).view(np.uint64)
    prints = np.concatenate([first, first ^ flips])
    i = np.arange(750)
    bits = np.array([sum((int(x) ^ int(y)).bit_count() for x, y in zip(a, b, strict=True)) for a, b in zip(prints[i], prints[i + 750], strict=True)])
    assert simhash.lanes_agree(prints, i, i + 750).tolist() == (bits <= 76).tolist()
    left = set(simhash.undiscarded(prints, i, i + 750, 76).tolist())
    assert left >= set(np.flatnonzero(bits <= 76).tolist())
    assert not left & set(np.flatnonzero(bits > 110).tolist())
    # Unrelated fingerprints.
    a, b = np.triu_indices(400, 1)
    assert len(simhash.undiscarded(prints, a, b, 76)) < len(a) / 1000


def test_hot_joined(spark):
    """Keys of very many rows are broadcast, the others shuffled; no row is lost or doubled."""
    left = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("most")).where("k % 2 = 1")
    found = common.hot_joined(left, right, "k", "n", 3000)
    assert sorted(tuple(r) for r in found.select("id", "k", "most").collect()) == sorted((i, k, 999 if k == 7 else i) for i in range(3000) for k in [7 if i < 1000 else i] if k % 2)


def test_components_large(spark, monkeypatch):
    """Without broadcast labels: stars, paths and a clique, against union-find."""
    monkeypatch.setattr(components, "FEW", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    pick = random.Random(5)
    edges = [(1000, 1001 + i) for i in range(60)] + [(i, i + 1) for i in range(12)] + [(pick.randrange(2000, 2040), pick.randrange(2000, 2040)) for _ in range(30)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    assert found == reached({x for e in edges for x in e}, edges)


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200, 0, -1)], "a long, b long")
    assert {r["root"] for r in components.components(path).collect()} == {1}


# Substring dedup.


def cut(rows, width=13):
    first = {}
    for i, t in sorted((i, t) for i, t in rows):
        w = t.split()
        for p in range(len(w) - width + 1):
            first.setdefault(tuple(w[p : p + width]), i)
    out = []
    for i, t in rows:
        w = t.split()
        keep = [True] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < i:
                keep[p : p + width] = [False] * width
        out.append((i, len(w), keep.count(False), b" ".join(x for x, k in zip(w, keep, strict=True) if k)))
    return out


def cut_rows(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"].encode()) for r in df.collect())


def test_substring(docs, rows, empty):
    expected = sorted(cut([(i, (t or "").encode()) for i, t, *_ in rows]))
    assert sum(x[2] for x in expected) > 500
    assert cut_rows(substring.substring_dedup(docs)) == expected
    out = substring.substring_dedup(clashed(docs))
    assert cut_rows(out) == expected and "fp" in out.columns
    assert substring.substring_dedup(empty).count() == 0


def test_substring_salts_frequent_windows(spark, docs, rows, monkeypatch):
    expected = sorted(cut([(i, (t or "").encode()) for i, t, *_ in rows]))
    real = substring.merged_sketch

    def hot(*args):
        bits, heavy, _, shift = real(*args)
        return bits, heavy, 1, shift

    monkeypatch.setattr(substring, "merged_sketch", hot)
    assert cut_rows(substring.substring_dedup(docs)) == expected


def test_substring_sketch_too_small(docs, rows, monkeypatch):
    """Every cell is full: all windows pass, and the result is the same."""
    monkeypatch.setattr(substring, "MIN_CELLS", 512)
    monkeypatch.setattr(substring, "MAX_CELLS", 512)
    assert cut_rows(substring.substring_dedup(docs)) == sorted(cut([(i, (t or "").encode()) for i, t, *_ in rows]))


def test_substring_shuffles_all_beyond_the_bound(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(substring, "MOST_IDS", 0)
    assert cut_rows(substring.substring_dedup(docs)) == sorted(cut([(i, (t or "").encode()) for i, t, *_ in rows]))


def test_substring_odd_names_and_ids(spark, docs):
    rows = docs.withColumns({"gone": F.lit(1), "id": F.lit("x"), "tag": F.lit(2), "__gone": F.lit(3)})
    found = substring.substring_dedup(rows)
    assert found.columns == [*rows.columns, "n_words", "n_removed", "kept_text"]
    assert cut_rows(found) == cut_rows(substring.substring_dedup(docs))
    with pytest.raises(ValueError, match="integer"):
        substring.substring_dedup(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    """Beyond one machine a temporary folder would be another one on each; so there is none."""

    class Session:
        def __init__(self, master, conf=None):
            self.sparkContext = self
            self.master, self.conf, self.made = master, conf, None
            self._jsc = self

        sc = getConf = lambda self: self
        get = lambda self, key=None: self.conf if key else self.made
        getCheckpointDir = lambda self: self
        isDefined = lambda self: self.made is not None

        def setCheckpointDir(self, folder):
            self.made = folder

    assert common.shared_folder(Session("yarn", "hdfs://a/b/")) == "hdfs://a/b"
    assert common.shared_folder(Session("local[4]"))
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="share"):
            common.shared_folder(Session(master))


def test_substring_equal_and_null_ids(spark):
    text = " ".join(WORDS[:20])
    rows = [(7, text), (7, text), (7, "x " + text), (None, text), (9, text)]
    out = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in out) == [("7", 20, 0), ("7", 20, 0), ("7", 21, 0), ("9", 20, 20), ("None", 20, 0)]


# Licenses.

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_licenses(spark, docs, empty):
    texts = [
        "All Rights Reserved. all rights-reserved",
        "CC BY cc by CC-BY",
        "Released under the MIT License.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this nice software and associated documentation files, to deal in the Software without restriction, including without limitation",
        "the license of this work is a secret of mine",
        "ÉCC by",
        None,
        "",
    ]
    found = by_id(licenses.labelled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for i, t in enumerate(texts):
        w = TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted((k, label) for p, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        ends = (places[0][0], places[-1][0]) if places else (None, None)
        assert found[i][:5] == (len(w), len(places), *ends, ",".join(sorted({x for _, x in places})))
        assert 0 <= found[i][6] <= 1
    assert [found[i][5] for i in (2, 3, 4, 5, 7)] == ["mit", "gpl", "mit", "", ""] and found[5][6] == 0
    assert by_id(licenses.labelled(clashed(docs)), "labels") == by_id(licenses.labelled(docs), "labels")
    assert licenses.labelled(empty).count() == 0


def test_license_labels_by_construction(spark):
    """Each text in prose, whole, with words put in, and with words left out, has its label and span; what only resembles one has none."""
    pick = random.Random(17)
    scanner = licenses.Scanner()
    given, expected = [], []
    for text, label in licenses.license_texts():
        words = text.split()
        more = [w for k, w in enumerate(words) for w in ([w, "whatsoever"] if k % 9 == 5 and len(words) > 40 else [w])]
        fewer = [w for k, w in enumerate(words) if len(words) < 40 or k % 12 != 7 or w in ("affero", "lesser")]
        for now in (words, more, fewer):
            head = sentence(pick, 30)
            given.append(f"{head} {' '.join(now)} {sentence(pick, 30)}")
            expected.append((label, len(head.split()), len(now)))
    never = ["She studied under the MIT professor of law.", "We went under the terms of the deal and the use of software in the end.", "Permission is hereby granted to leave.", "a license of the public", "general license public", "The Apache people licensed the land, version 2 0 of it."]
    rows = spark.createDataFrame(list(enumerate(given + never)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scanned(rows, scanner).collect()}
    for i, (label, start, size) in enumerate(expected):
        spans = found[i]["spans"]
        assert {s["label"] for s in spans} == {label}, given[i]
        assert all(start <= s["start"] < s["stop"] <= start + size and 0 < s["share"] <= 1 for s in spans)
    assert all(not found[len(given) + k]["spans"] and not found[len(given) + k]["phrases"] for k in range(len(never)))
    assert [x["labels"] for x in licenses.labelled(rows).where(F.col("doc_id") >= len(given)).collect()] == [""] * len(never)


def test_chains_cover_what_runs_do():
    """The share of a span is that of the template's words which the text holds in order, in runs of three and more."""
    template = " ".join(f"w{k}" for k in range(40))
    scanner = licenses.Scanner(phrases=(), templates=((template, "x"),))
    pick = random.Random(23)
    for _ in range(200):
        words = [f"w{k}" for k in range(40)]
        for _ in range(pick.randrange(3)):
            at = pick.randrange(len(words))
            words[at : at + pick.randrange(3)] = ["other"] * pick.randrange(3)
        held, covered = [], 0
        for w in [*words, "end"]:
            k = int(w[1:]) if w[1:].isdigit() else None
            if held and k != held[-1] + 1:
                covered += len(held) if len(held) >= 3 else 0
                held = []
            if k is not None:
                held.append(k)
        spans = scanner.scan([w.encode() for w in ["before", *words]])[1]
        assert [round(s[3] * 40) for s in spans] == ([covered] if covered >= 24 else [])


def test_matching_statistics():
    scanner = licenses.Scanner()
    runs = {tuple(s[i:j]) for s in scanner.sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    pick = random.Random(2)
    for _ in range(100):
        ids = [x for _ in range(8) for s in [pick.choice(scanner.sequences)] for a in [pick.randrange(len(s))] for x in s[a : a + pick.randrange(1, 7)]]
        longest = [max(k for k in range(i + 2) if not k or tuple(ids[i + 1 - k : i + 1]) in runs) for i in range(len(ids))]
        assert [n for _, n in scanner.automaton.statistics(ids)] == longest


# Packing.


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    pieces = sorted((r["doc_id"], r["start"], r) for r in packing.packed(docs, path).collect())
    ids = {}
    for doc_id, start, r in pieces:
        own = ids.setdefault(doc_id, [])
        assert start == len(own) and r["length"] == len(r["ids"]) // 4
        own += np.frombuffer(bytes(r["ids"]), "<u4").tolist()
    for doc_id, text, *_ in rows:
        assert ids[doc_id] == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    assert all(len(ids[d]) == r["doc_tokens"] for d, _, r in pieces)
    sequences = {}
    for _, _, r in pieces:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(empty, path).count() == 0
    assert packing.packed(clashed(docs), path).count() == len(pieces)


def test_words_apart_are_the_text():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer, words = Tokenizer.from_file(path), packing.word_ids(path, lambda: Path(path).read_bytes())
    pick = random.Random(4)
    pool = ["it's", "don't", "Ünïcode", "İstanbul", "ΣΑΣ", "a.b.", "...", "12,3", "<|endoftext|>", "é", "ﬁ", "x\x1cy", " ", "THE,", "we'll.", "'s", "日本語", "😀👍🏽", "end.,", "Ab"]
    for _ in range(200):
        text = pick.choice([" ", "\n", "  "]).join(pick.choice(pool) for _ in range(12))
        assert np.frombuffer(words.of(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_window():
    pick = random.Random(6)
    for window in (8, 100, 2048):
        lengths = [pick.randrange(1, window + 1) for _ in range(400)]
        sequence, offset, _ = packing.best_fit(lengths, window, 0)
        room, plain = {}, 0
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            fits = [r for r in room.values() if r >= lengths[k]]
            before = room.get(sequence[k], window)
            assert before == (min(fits) if fits else window) and offset[k] == window - before
            room[sequence[k]] = before - lengths[k]
            plain += 1
        assert plain == len(lengths)


# Mixing.


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        for s in over or list(open_):
            target[s] = most * sizes[s] if over else level * weight[s]
            open_.discard(s)
    return target


def test_mixing(docs, rows, empty, spark):
    plan = mixing.Mixture(docs).plan()
    found = plan.collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target = filled(sizes)
    taken = Counter()
    for r in found:
        assert r["size"] == len(WORD.findall(rows[r["doc_id"]][1] or "")) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    largest = max(r["size"] for r in found)
    assert all(abs(taken[s] - target[s]) <= largest for s in sizes) and sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = mixing.Mixture(clashed(docs.repartition(5))).plan()
    assert sorted(map(tuple, again.select(plan.columns).collect()), key=str) == sorted(map(tuple, found), key=str)
    sent = mixing.Mixture(docs).rows()
    assert sent.columns == docs.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in sent.collect()) == sum(taken.values())
    assert mixing.Mixture(empty).plan().count() == 0 and mixing.Mixture(empty).rows().count() == 0
    blank = spark.createDataFrame([(1, None, "en", None, 0), (1, None, "en", None, 0)], SCHEMA)
    assert [r["taken"] for r in mixing.Mixture(blank).plan().collect()] == [0, 0]


def test_the_cut_among_equal_times(spark):
    """Rows of one finish time are dealt by turn, copies of one row taken or left together."""
    pick = random.Random(71)
    rows = [(0.0, pick.getrandbits(64) - (1 << 63), 1) for _ in range(400)] + [(0.0, 12345, 1)] * 300
    frame = spark.createDataFrame(rows, "finish double, turn long, size long")
    for budget in (0.5, 1, 150, 420, 699, 700, 900):
        found = mixing.last_taken(frame, budget, few=20)
        taken = [r for r in rows if found and (r[0], r[1]) <= found]
        assert sum(r[2] for r in taken) <= budget
        following = [r for r in rows if not found or (r[0], r[1]) > found]
        assert not following or sum(r[2] for r in taken) + sum(r[1] == min(f[1] for f in following) for r in rows) > budget
    docs = spark.createDataFrame([(i, None, "s") for i in range(300)], "doc_id long, text string, source string")
    assert mixing.Mixture(docs).plan().where("taken = 0").count() == 300


def test_the_cut(spark):
    pick = random.Random(9)
    rows = [(pick.random(), pick.getrandbits(60), pick.randrange(20)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "finish double, turn long, size long")
    for budget in (-1, 0, 777, 20_000, 10**9):
        total, last = 0, None
        for finish, turn, size in sorted(rows):
            total += size
            if total > budget:
                break
            last = (finish, turn)
        assert mixing.last_taken(df, budget, few=50) == last


# Sketches.


def shingles(text):
    w = text.encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches(spark, docs, rows, empty):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        found = {r["doc_id"]: r for r in sketches.likeness_to_next(clashed(docs)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    texts = {i: t or "" for i, t, *_ in rows}
    order = sorted(texts, reverse=True)
    assert set(found) == set(texts)
    for k, i in enumerate(order):
        following = texts[order[(k + 1) % len(order)]]
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + following[:half]
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        own, other = shingles(texts[i]), shingles(edited)
        assert abs(r["in_edited"] - (len(own & other) / len(own) if own else 1)) < 0.25 and abs(r["distinct_shingles"] - len(own)) <= 0.3 * len(own)
        assert abs(r["near_edited"] - alike(texts[i], edited)) < 0.2 and abs(r["near_next"] - alike(texts[i], following)) < 0.2
    assert sketches.likeness_to_next(empty).count() == 0


def test_sketches_at_ties(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, None)]
    found = sketches.likeness_to_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 5 and sorted(str(r["doc_id"]) for r in found) == ["1", "1", "1", "None", "None"]
    one = sketches.likeness_to_next(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_sketches_of_hot_and_null_ids(spark):
    """Ranges cut through rows of one id and of none; each row's next is the one that follows by id and hash."""
    pick = random.Random(61)
    rows = [(None, sentence(pick, 20)) for _ in range(300)] + [(5, sentence(pick, 20)) for _ in range(200)] + [(i, sentence(pick, 20)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = sketches.range_marks(docs, 12)
    assert len(set(marks[0].tolist())) < len(marks[0]) >= 9
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        found = sketches.likeness_to_next(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    tie = {r["text"]: r["tie"] for r in docs.select("text", sketches.text_hash("text").alias("tie")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]), reverse=True)
    expected = Counter()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        expected[i, hashlib.sha256(sketches.edited(t, after).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in found) == expected
    with pytest.raises(ValueError, match="integer"):
        sketches.likeness_to_next(docs.withColumn("doc_id", F.lit("a")))


def test_sketches_estimate_and_merge(spark):
    pick = random.Random(1)
    a, b = sentence(pick, 3000).split(), sentence(pick, 3000).split()
    a, b = [w.encode() for w in a], [w.encode() for w in b]
    both = sketches.united(sketches.sketch(a), sketches.sketch(b))
    assert abs(sketches.distinct(sketches.sketch(a)) / 2996 - 1) < 0.35
    half = a + b
    assert abs(sketches.containment(sketches.sketch(a), sketches.sketch(half)) - 1) < 0.25
    assert abs(sketches.resemblance(sketches.sketch(a), sketches.sketch(half)) - 0.5) < 0.15
    rows = [("x", sketches.stored(sketches.sketch(a))), ("x", sketches.stored(sketches.sketch(b))), ("y", sketches.stored(sketches.sketch(b))), (None, None)]
    found = {r["g"]: bytes(r["sketch"]) for r in sketches.merged(spark.createDataFrame(rows, "g string, sketch binary"), "g").collect()}
    assert found == {"x": sketches.stored(both), "y": sketches.stored(sketches.sketch(b)), None: b""}


# URLs.


@pytest.mark.parametrize("most_bytes", [0, urls.BROADCAST_BYTES])
def test_urls(spark, monkeypatch, most_bytes):
    """By a broadcast and by a salted join."""
    monkeypatch.setattr(urls, "BROADCAST_BYTES", most_bytes)
    given = ["http://A.Example.ORG/es/x?y", "https://example.org/en/123", "http://x.com/fr/", "http://x.com/de/1#a", "http://xcom/fr/", "no scheme", None, "http://org", "ftp://spam-farm.example.net/q", "http://spam-farm.example.com/fr/1", "http://notexample.org/es/", "http://a.org/\nb", "http://é.org/é?", "http://x.com/fr", "://org/", "http://x.com?/fr/"]
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(given)] * 2, "page_id long, url string, html string")
    found = urls.judged(clashed(pages), urls.listed(pages)).collect()
    assert len(found) == 2 * len(given)
    for r in found:
        u = given[r["page_id"]] or ""
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u)
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        own = any((host == h or host.endswith(f".{h}")) and path.startswith(p) for h, p, _ in urls.listed_rows())
        rule, verdict = max(fits)[1:] if fits else (None, "block" if own else "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), u
    none = spark.createDataFrame([], pages.schema)
    assert urls.judged(none, urls.listed(pages)).count() == 0
    deep = spark.createDataFrame([(0, "http://" + "a." * 3000 + "spam-farm.example.com/" + "x" * 50_000)], "page_id long, url string")
    assert urls.judged(deep, urls.listed(pages)).first()["verdict"] == "block"
    mine = urls.listed(pages, spark.createDataFrame([("x.com", "/", "block", 1)], "host string, path string, verdict string, more int"))
    assert {r["verdict"] for r in urls.judged(pages, mine).where("host = 'x.com' AND path = '/fr'").collect()} == {"block"}
    assert urls.judged(pages, spark.createDataFrame([], "host string, path string, verdict string, ranked boolean")).where("verdict = 'allow'").count() == 2 * len(given)


def test_bloom_loses_nothing(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    data, blocks = urls.bloom(keys)

    def passes(key):
        block, bits = urls.places(key.encode(), blocks)
        return all(data[block * 64 + (b >> 3)] >> (b & 7) & 1 for b in bits)

    assert all(passes(f"k{i}") for i in range(5000))
    assert sum(passes(f"q{i}") for i in range(5000)) < 250


# Toxicity.


def test_toxicity(spark, empty):
    pick = random.Random(13)
    texts = [(i, sentence(pick, 60) + (" vilefoe " + pick.choice(["rotgut", "scumlord"]) if i % 4 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame([*texts, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in texts if i % 2 == 0] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(clashed(docs), labels)
    out = toxicity.scored(clashed(docs), model).collect()
    score = {r["doc_id"]: r["score"] for r in out}
    held = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(0 <= s <= 1 for s in score.values()) and len(score) == 602
    assert np.mean([(score[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    learned = {e["doc_id"] for r in out for e in r["evidence"]}
    assert learned and not learned & set(held)
    assert score[5000] == score[5001] < 0.5
    assert toxicity.scored(empty, model).count() == 0
    bare = toxicity.fitted(docs, labels.where("doc_id < 0"))
    assert {r["score"] for r in toxicity.scored(docs, bare).collect()} == {0.0}


def brute_scores(docs, labels, least_chi):
    """The scores of ``docs`` (id, text), from dense TF-IDF vectors."""
    fold = lambda t: (t or "").encode().translate(toxicity.FOLD).split()
    features = {i: Counter(f for w in fold(t) for f in toxicity.word_features(w)) for i, t in docs}
    seen = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5}
    n = [sum(y == c for y in seen.values()) for c in (0, 1)]
    kept = []
    for f in sorted({f for i in seen for f in features[i]}):
        a, b = (sum(f in features[i] for i in seen if seen[i] == c) for c in (1, 0))
        chi = sum(n) * (a * (n[0] - b) - b * (n[1] - a)) ** 2 / ((a + b) * (sum(n) - a - b + 1e-9) * n[0] * n[1])
        if a + b >= 4 and chi >= least_chi:
            kept.append(f)
    idf = {f: np.log((1 + len(docs)) / (1 + sum(f in c for c in features.values()))) + 1 for f in kept}
    vectors = {i: np.array([(1 + np.log(c[f])) * idf[f] if c[f] else 0.0 for f in kept]) for i, c in features.items()}
    vectors = {i: v / np.linalg.norm(v) if v.any() else v for i, v in vectors.items()}
    own = sorted(seen)
    share = sum(seen.values()) / len(seen)
    bare = [seen[i] for i in own if not vectors[i].any()]
    out = {}
    for i, v in vectors.items():
        near = sorted(((round(float(v @ vectors[e]), 9), e) for e in own), key=lambda x: (-x[0], x[1]))[:15]
        near = [(c, e) for c, e in near if c > 0]
        vote = sum(c * c for c, _ in near)
        out[i] = (sum(c * c * seen[e] for c, e in near) + 0.25 * share) / (vote + 0.25) if near else (sum(bare) + share) / (len(bare) + 1)
    return out


@pytest.mark.parametrize("least_chi", [0.0, 5.0])
def test_toxicity_scores_by_brute_force(spark, least_chi):
    """Scores of all documents, over all words and over those that tell the classes apart."""
    pick = random.Random(29)
    docs = [(i, sentence(pick, pick.randint(5, 60)) + (" vilefoe" * pick.randrange(1, 4) + " rotgut" if pick.random() < (0.8 if i % 3 == 0 else 0.05) else "")) for i in range(260)]
    docs += [(900, None), (901, "   ")]
    labels = {i: int(i % 3 == 0) for i in range(200)}
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    model = toxicity.fitted(*tables, least_chi=least_chi)
    found = {r["doc_id"]: r["score"] for r in toxicity.scored(tables[0], model).collect()}
    expected = brute_scores(docs, labels, least_chi)
    assert all(found[i] == pytest.approx(expected[i], abs=1e-6) for i in expected)


def test_toxicity_scores_are_calibrated(spark):
    """On rows held out: of texts with scores in a fifth of 0 to 1, about as many are toxic as the scores say."""
    pick = random.Random(37)
    docs, labels = [], []
    for i in range(3000):
        strength = pick.random()
        toxic = int(pick.random() < strength)
        words = sentence(pick, 40).split() + [pick.choice(["vilefoe", "rotgut", "scumlord", "kind", "mild", "calm"]) if pick.random() < 0.3 else ("vilefoe" if pick.random() < strength else "kind") for _ in range(6)]
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r["doc_id"]: r["score"] for r in toxicity.scored(tables[0], toxicity.fitted(*tables)).collect()}
    held = [(found[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    bins = [[(s, y) for s, y in held if k <= 5 * s < k + 1] for k in range(5)]
    gaps = [abs(sum(s for s, _ in b) - sum(y for _, y in b)) for b in bins]
    assert sum(gaps) / len(held) < 0.1
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.65


def test_toxicity_takes_one_example_of_an_id(spark):
    """Rows of one id give one example, so what is collected follows the labels."""
    docs = spark.createDataFrame([(i % 40, f"text number {i} {'vilefoe' if i % 2 else 'kind'}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    assert len(model.ids) == len(set(model.ids)) <= 40
    assert toxicity.scored(docs, model).count() == 4000


def test_toxicity_reads_long_tokens_whole(spark):
    pick = random.Random(17)
    join = lambda *words: "–".join(words)
    texts = [(i, sentence(pick, 60) + " " + (join(*[pick.choice(WORDS) for _ in range(12)], "vilefoe") if i % 2 else join(*[pick.choice(WORDS) for _ in range(12)]))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in texts], "doc_id long, quality int, toxic int")
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()}
    held = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(score[i] >= 0.5) == (i % 2 == 1) for i in held]) > 0.9


def test_block_max_index_is_exact():
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(500):
        at = np.sort(rng.choice(40, rng.integers(0, 9), replace=False))
        w = rng.random(len(at))
        vectors.append((at, w / np.sqrt((w * w).sum()) if len(at) else w))
    index = toxicity.BlockMaxIndex.of(vectors)
    dense = np.zeros((500, 40))
    for k, (at, w) in enumerate(vectors):
        dense[k, at] = w
    for at, w in vectors[:100]:
        q = np.zeros(40)
        q[at] = w
        best = sorted((dense @ q).tolist(), reverse=True)[:15]
        got = [c for c, _ in index.nearest(at, w, 15)]
        assert got == pytest.approx([c for c in best if c > 0])


# HTML.

PAGE = '<!DOCTYPE html><html><head><title>T{0}</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="x"><header><h2>Site</h2></header><nav><ul>{1}</ul></nav><!-- ad --><div class="cookie-notice">We use cookies &amp; more</div><main><article id="a{0}"><h1>Title {0}</h1><p>First&nbsp;  para {0} &eacute; <b>bold</b>text<br>next</p><p>Read our newsletter every day</p><div class="ad">Buy</div><ul><li>one {0}<li>two {0}</ul><form><input><button>Go</button></form></article><section id="comments"><article class="comment"><p>Nice {0}</p></article></section></main><aside>Side {0}</aside><footer>&copy; {0}</footer></body></html>'


def page(k):
    return PAGE.format(k, "".join(f'<li><a href="/{i}">m{i}</a></li>' for i in range(k % 4 + 1)))


def test_main_text(spark):
    given = [(k, f"http://h.example/{k}", page(k)) for k in range(8)]
    given += [(100, "http://h.example/cut", page(9)[: page(9).index("two 9") + 3]), (101, None, None), (102, "x", ""), (103, "http://z/", "plain &lt; text"), (104, "http://h.example/0", page(0))]
    pages = spark.createDataFrame(given, "page_id long, url string, html string")
    out = wrappers.main_text(clashed(pages))
    found = {r["page_id"]: r for r in out.collect()}
    assert len(found) == len(given)
    for k in range(8):
        assert found[k]["text"] == f"Title {k}\nFirst para {k} é boldtext next\none {k}\ntwo {k}", "the sentence that all pages share is template"
    assert found[100]["text"] == "Title 9\nFirst para 9 é boldtext next\none 9\ntwo"
    assert (found[101]["text"], found[102]["text"], found[103]["text"]) == ("", "", "plain < text")
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())
    none = spark.createDataFrame([], pages.schema)
    assert wrappers.main_text(none).count() == 0


def test_wrappers_hang_on_pages_alone(spark):
    """A host in one batch and the same host in many partitions: the shared sentence is template in both."""
    given = [(k, f"http://h.example/{k}", page(k)) for k in range(40)]
    pages = spark.createDataFrame(given, "page_id long, url string, html string")
    one, many = (by_id_of_page(wrappers.main_text(p)) for p in (pages.coalesce(1), pages.repartition(20)))
    assert one == many and one[30] == "Title 30\nFirst para 30 é boldtext next\none 30\ntwo 30"


def test_pages_of_two_templates_and_of_no_host(spark):
    """Pages without a main part keep their text where others of the host have one, and foreign pages without host too."""
    given = [(k, f"http://h.example/{k}", f"<article><p>Article text {k}</p></article><div><p>Side {k}</p></div>" if k % 2 else f"<div><p>Plain text {k}</p></div>") for k in range(12)]
    given += [(100 + k, None if k % 2 else "no url", f"<div><p>Own text {k}</p><p>Same sentence</p></div>") for k in range(8)]
    found = by_id_of_page(wrappers.main_text(spark.createDataFrame(given, "page_id long, url string, html string")))
    assert all(found[k] == (f"Article text {k}" if k % 2 else f"Plain text {k}") for k in range(12))
    assert all(found[100 + k] == f"Own text {k}\nSame sentence" for k in range(8))


def by_id_of_page(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def test_long_lists_are_aligned_whole():
    pick = random.Random(8)
    nodes = lambda n, last: [["e", f"div[class={pick.choice(WORDS)}]", [], False, False] for _ in range(n)] + [["e", f"p[class={last}]", [], False, False]]
    for a, b in ((nodes(400, "end"), nodes(500, "end")), (nodes(5, "end"), nodes(9000, "end")), (nodes(700, "end"), nodes(600, "other")), (nodes(0, "end"), nodes(50_000, "other"))):
        both = wrappers.joined(a, b)
        assert {n[1] for n in both} == {n[1] for n in a + b}
        assert max(len(a), len(b)) * 0.8 <= len(both) <= len(a) + len(b)
        if a[-1] == b[-1]:
            assert both[-1][1] == "p[class=end]" and not both[-1][3]


def test_wrappers_are_union_free():
    a, b = (wrappers.tree(wrappers.stream(page(k))) for k in (0, 3))
    shown = wrappers.expression(wrappers.joined(a, b))
    assert "(<li>#text</li>)+" in shown and "#constant" in shown and "|" not in shown
    assert wrappers.expression(wrappers.joined(wrappers.tree(wrappers.stream("<div><p>a</p></div>")), wrappers.tree(wrappers.stream("<div><h2>t</h2><p>b</p></div>")))) == "<div>(<h2>#constant</h2>)? <p>#text</p></div>"


#: Templates of hosts with nothing in their names to go by; {0} is a text that differs on every page.
NAMELESS = (
    '<body><div class="a1"><div><a href="/">{0}</a></div></div><div class="b2"><h1>{title}</h1>{paragraphs}</div><div class="c3">{0}</div></body>',
    '<body><table><tr><td class="x">{0}</td><td class="y">{paragraphs}<p>The same on all pages</p><ul><li><a>{0}</a><li><a>{0}</a></ul></td></tr></table>',
    '<body><div class="t"><h1>{title}</h1></div><div class="u"><div class="v">{paragraphs}</div><div class="w">{0}</div></div><div class="z"><p>{0}</p></div></body>',
    "<body><main><nav>{0}</nav><section class='legal notice'>{paragraphs}</section><section class='comments'><h1>{0}</h1><p>{0}{0}{0}</p></section></main><div>{0}</div></body>",
)


def nameless(template, k, pick):
    """A page and its main text, known from how it is made."""
    blocks = [f"{sentence(pick, pick.randint(20, 60))} {k}" for _ in range(pick.randint(2, 5))]
    title = f"{sentence(pick, 4)} {k}"
    html = template.replace("{title}", title).replace("{paragraphs}", "".join(f"<p>{b}</p>" for b in blocks))
    while "{0}" in html:
        html = html.replace("{0}", sentence(pick, 3), 1)
    return html, "\n".join([title] * ("{title}" in template) + blocks)


def test_wrappers_decide_where_names_say_nothing(spark):
    """Against texts known by construction: slots find articles, titles beside them, menus and template texts; without wrapper they differ."""
    pick = random.Random(11)
    given = [(100 * t + k, f"https://site{t}.example/{k}", *nameless(template, k, pick)) for t, template in enumerate(NAMELESS) for k in range(30)]
    pages = spark.createDataFrame([r[:3] for r in given], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in wrappers.main_text(pages).collect()}
    for i, _, html, text in given:
        assert found[i]["text"] == text and found[i]["by_wrapper"]
        if i < 300:
            assert wrappers.extracted(html, None)[0] != text, "by names alone the text is another"


def test_sections_of_an_article_stay():
    for name in ("legal", "related", "search", "widget", "notice", "reply", "footer"):
        assert wrappers.extracted(f'<article><p>One</p><section class="{name}"><p>The court ruled today.</p></section></article><div>x</div>', None) == ("One\nThe court ruled today.", False)
    for name in ("comments", "ad", "sidebar"):
        assert wrappers.extracted(f'<article><p>One</p><div class="{name}"><p>Buy</p></div></article>', None) == ("One", False)


def test_deep_pages(spark):
    """Nesting has no limit, in wrappers and in texts; expressions and trees are kept whole."""
    deep = lambda k, n: (k, "http://deep.example/", "<div>" * n + f"<p>Text {k} of a deep page</p>" + "</div>" * n)
    given = [deep(k, 5_000) for k in range(3)] + [deep(10 + k, 600) for k in range(3)] + [(20, "http://deep.example/", "<ul><li>" * 20_000 + "end")]
    found = by_id_of_page(wrappers.main_text(spark.createDataFrame(given, "page_id long, url string, html string")))
    assert all(found[k] == f"Text {k} of a deep page" for k in (0, 1, 2, 10, 11, 12)) and found[20] == "end"
    nodes = wrappers.tree(wrappers.stream(given[0][2]))
    assert wrappers.unflat(json.loads(json.dumps(wrappers.flat(nodes)))) is not None
    assert wrappers.expression(wrappers.joined(nodes, wrappers.tree(wrappers.stream(given[1][2])))).count("<div>") == 5_000


def test_hostile_html_is_linear():
    import time

    began = time.perf_counter()
    for text in ("<div" * 50_000, "<!--" * 50_000, "<b>" * 50_000, '<a "' * 20_000, "<div>" * 50_000, "<svg/>" * 50_000, "<blockquote>" * 50_000 + "</p>" * 50_000, "<p>x" * 50_000):
        wrappers.extracted(text, None)
    assert time.perf_counter() - began < 20
