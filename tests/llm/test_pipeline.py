"""What the pipeline's stages must leave and take, and the corpus queries against their SQL."""

from __future__ import annotations

import os
import random

import duckdb
import numpy as np
import pytest
from samples import clashed, sentence

import __spark_entry__
import corpus_pipeline as pipeline
from khamkit.llm import queries, simhash


def test_stages(spark, docs, rows, tmp_path):
    """Each stage on what the one before kept."""
    now, kept = docs, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = now.collect()
    texts = {i: t for i, t, *_ in rows}
    quality = {r["doc_id"]: r["text"] for r in kept["quality"]}
    assert quality and all(texts[i] == t and len(t.split()) >= 50 for i, t in quality.items())
    near = {r["doc_id"]: r["text"] for r in kept["near_dedup"]}
    assert set(near) < set(quality) and len(set(near.values())) == len(near)
    copies = [i for i, t in quality.items() if len(t.split()) == 300]
    assert min(copies) in near and len([i for i in copies if i in near]) <= 2
    cut = {r["doc_id"]: r for r in kept["substrings"]}
    assert set(cut) <= set(near) and all(r["n_chars"] == len(r["text"]) for r in cut.values())
    sent = kept["mixing"]
    assert {r["doc_id"] for r in sent} <= set(cut) and len(sent) >= len(cut)
    windows = {}
    for r in kept["packing"]:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["length"] for r in kept["packing"] if r["start"] == 0) + sum(r["length"] for r in kept["packing"] if r["start"]) == sum({r["doc_id"]: r["doc_tokens"] for r in kept["packing"]}[d["doc_id"]] for d in sent)
    ends = [np.frombuffer(bytes(r["ids"]), "<u4")[-1] for r in kept["packing"] if r["start"] + r["length"] == r["doc_tokens"]]
    assert len(ends) == len(sent) and set(ends) == {1}


def test_stages_on_nothing_and_clashes(spark, docs, tmp_path):
    now = docs.where("false")
    for _, stage in pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        assert out.count() == 0
        now = now.limit(0)
    wide = clashed(docs)
    assert pipeline.near_dedup(spark, wide, "").columns == wide.columns


def test_near_dedup_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(80))
    rows = [(1, text), (1, text), (2, text), (3, other), (None, text)]
    out = pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "None"]


def test_near_dedup_by_fingerprints(spark, monkeypatch):
    """Near copies whose fingerprints are within the radius are found though no sample proposes them."""
    monkeypatch.setattr(pipeline, "SAMPLES", 1)
    pick = random.Random(61)
    rows = []
    for k in range(150):
        words = sentence(pick, 300).split()
        rows.append((2 * k, " ".join(words)))
        words[7 + k] = "edited"
        rows.append((2 * k + 1, " ".join(words)))
    prints = {i: simhash.fingerprint(t.encode(), pipeline.WIDTH, pipeline.LANES, 1) for i, t in rows}
    near = [i for i in range(0, 300, 2) if (prints[i][0] ^ prints[i + 1][0]).bit_count() <= 2]
    apart = [i for i in near if prints[i][-1] != prints[i + 1][-1]]
    assert apart
    kept = {r["doc_id"] for r in pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert all(i in kept and i + 1 not in kept for i in near)


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", [*queries.queries(), "pipeline"])
def test_queries(spark, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
        sql = con.sql(queries.oracle_sql()[name])
        assert sorted(sql.columns) == sorted(df.columns)
        assert sorted(sql.project(", ".join(df.columns)).fetchall(), key=str) == sorted(map(tuple, rows), key=str)
    if name != "pipeline":
        table = "pages" if name in ("op7_urls", "op9_html") else "documents"
        key = "page_id" if table == "pages" else "doc_id"
        ids = {r[key] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()}
        assert {r[key] for r in rows} == ids
