"""Queries against their SQL on the smallest tables, sources, operators, SQL functions and a stream."""

from __future__ import annotations

import collections
import itertools
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from khamkit.functions import amounts, text
from khamkit.functions.segment import Lexicon
from khamkit.functions.sql import model_info, register
from khamkit.functions.text import TextFunctions
from khamkit.operators import corpus
from khamkit.operators import lexicon as lexicons
from khamkit.plans.catalog import ORACLE, QUERIES
from khamkit.sources import corpora
from khamkit.sources import lexicons as sources
from khamkit.streaming import text as streams

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        return round(float(x), 6) if isinstance(x, float) else x

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE:
        sql = duck.sql(ORACLE[name])
        assert sorted(sql.columns) == sorted(df.columns)
        assert found == rows_of(sql.columns, sql.fetchall())
    else:
        assert found


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_text_functions_take_nulls_and_empties(spark):
    t = TextFunctions(Lexicon.of(["ไป"]))
    rows = spark.createDataFrame([(None,), ("",)], "text string")
    made = rows.select(t.tokens("text"), t.boundaries("text"), t.lines("text"), t.wrap("text", 5), t.normalize("text"), text.display_width("text"), text.markup_spans("text")).collect()
    assert all(x is None for x in made[0])
    assert list(made[1]) == [[], [0], "", "", "", 0, []]
    with pytest.raises(ValueError):
        t.process(rows, "nothing")
    assert t.process(rows, "join").count() == 2


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "words.tsv").write_text("# comment\nแมว\nแมวน้ำ\t2\nหมา\tx\n\nแมว\t3\n", encoding="utf-8")
    (tmp_path / "weights.tsv").write_text("หมา\t3.5\nปลา\t2\n", encoding="utf-8")
    (tmp_path / "bigrams.tsv").write_text("a\tb\t2\na\tb\t0\na\tc\tx\na\tb\t3\n", encoding="utf-8")
    (tmp_path / "bad.tsv").write_text("หมา\tx\n", encoding="utf-8")
    words = sources.read_lexicon(spark, str(tmp_path / "words.tsv"))
    as_dict = lambda df: {r["word"]: r["weight"] for r in df.collect()}
    assert as_dict(words) == {"แมว": 3.0, "แมวน้ำ": 2.0, "หมา": 1.0}
    weights = sources.read_weights(spark, str(tmp_path / "weights.tsv"))
    assert as_dict(sources.apply_weights(words, weights)) == {"แมว": 3.0, "แมวน้ำ": 2.0, "หมา": 3.5}
    assert sources.applied(words, weights).first()["n"] == 1
    with pytest.raises(Exception, match="no weight above 0"):
        sources.read_weights(spark, str(tmp_path / "bad.tsv")).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        sources.read_lexicon(spark, str(tmp_path / "none.tsv")).collect()
    pairs = sources.model_bigrams(sources.read_bigrams(spark, str(tmp_path / "bigrams.tsv")))
    assert pairs.counts == {("a", "b"): 3.0} and pairs.firsts == {"a": 5.0}
    sources.write_lexicon(words, str(tmp_path / "words.parquet"))
    assert as_dict(sources.read_lexicon(spark, str(tmp_path / "words.parquet"))) == as_dict(words)
    spark.conf.set(sources.DEFAULT_KEY, str(tmp_path / "words.tsv"))
    try:
        assert as_dict(sources.default_lexicon(spark))["หมา"] == 3.5
        assert sources.default_bigrams(spark).count() == 2
    finally:
        spark.conf.unset(sources.DEFAULT_KEY)
    assert "ไทย" in sources.model_lexicon(sources.default_lexicon(spark))


def test_streams_and_counts_keep_thai_words(spark, tmp_path):
    """Words of both scripts in a stream's windows and in counts, also in one text."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ไปกินข้าว 10 abc\nplain words abc\n", encoding="utf-8")
    t = TextFunctions(Lexicon.of(["ไป", "กิน", "ข้าว"]))
    lines = streams.read_lines(spark, str(tmp_path / "in")).withColumn("time", F.lit("2026-01-01").cast("timestamp"))
    out = streams.windowed_counts(lines, "time", "value", functions=t)
    running = out.writeStream.format("memory").queryName("thai_counts").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    found = {r["token"]: r["n"] for r in spark.table("thai_counts").collect()}
    assert found == {"ไป": 1, "กิน": 1, "ข้าว": 1, "10": 1, "abc": 2, "plain": 1, "words": 1}
    rows = spark.createDataFrame([("ไปกิน abc",), ("a\rb  c",), (None,), ("",)], "text string")
    assert [r["tokens"] for r in t.tokens_of(rows).collect()] == [["ไป", "กิน", "abc"], ["a", "b", "c"], None, []]
    assert [r[0] for r in rows.select(t.tokens("text", keep_whitespace=True)).collect()] == [["ไป", "กิน", " ", "abc"], ["a", "\r", "b", "  ", "c"], None, []]
    assert [r[0] for r in rows.select(F.array_join(t.lattice_tokens("text"), "|")).collect()] == ["ไป|กิน|abc", "a|b|c", None, ""]
    assert lexicons.bigrams_in(t.tokens_of(rows)).count() == 4


def test_formats_overlays_and_limits(spark, tmp_path):
    words = sources.from_words(spark, {"ไป": 2.0, "กิน": 3.0})
    sources.write_lexicon(words, str(tmp_path / "bare"))
    (tmp_path / "list").write_text("ไป\t5\n", encoding="utf-8")
    assert sources.read_lexicon(spark, str(tmp_path / "bare")).count() == 2 and sources.read_lexicon(spark, str(tmp_path / "list")).first()["weight"] == 5.0
    asked = spark.createDataFrame([("ไป",), ("กิน",), ("ปลา",)], "token string")
    found = lexicons.overlaid(words, sources.from_words(spark, {"ไป": 1.0}), asked).collect()
    assert {r["token"]: r["weight"] for r in found} == {"ไป": 1.0, "กิน": 3.0, "ปลา": 0.0}
    told = lexicons.set_weights_told(words, sources.from_words(spark, {"ไป": 9.0, "ปลา": 1.0})).collect()
    assert {r["word"]: r["applied"] for r in told} == {"ไป": True, "ปลา": False}
    with pytest.raises(ValueError, match="items"):
        TextFunctions(Lexicon.of(["ไป"])).process(spark.range(1001).select(F.lit("a").alias("text")), limited=True)
    b = F.array(F.lit(0), F.lit(2), F.lit(5))
    steps = spark.range(1).select(text.next_boundary(b, 2).alias("a"), text.previous_boundary(b, 2).alias("b"), text.next_boundary(b, 5).alias("c"), text.moved(b, 1, 1).alias("d"), text.current_boundary(b, 5).alias("e")).first()
    assert tuple(steps) == (5, 0, None, None, 5)
    (tmp_path / "pairs").mkdir()
    for name, n in (("b.tsv", 7), ("a.tsv", 2)):
        (tmp_path / "pairs" / name).write_text(f"x\ty\t{n}\n", encoding="utf-8")
    assert sources.model_bigrams(sources.read_bigrams(spark, str(tmp_path / "pairs"))).counts == {("x", "y"): 7.0}


def test_a_long_prefix_lexicon_is_joined(spark, monkeypatch):
    monkeypatch.setattr(lexicons, "SENT_WORDS", 0)
    rows = spark.createDataFrame([("การบ้าน",), ("",), (None,)], "text string")
    found = lexicons.prefixes_in(rows, sources.from_words(spark, {"การ": 1.0, "บ้าน": 2.0, "การบ้าน": 3.0}))
    assert sorted((r["start"], r["word"]) for r in found.collect()) == [(0, "การ"), (0, "การบ้าน"), (3, "บ้าน")]
    assert lexicons.prefixes_in(rows, sources.from_words(spark, [])).count() == 0


def test_lexicon_operators(spark):
    words = sources.from_words(spark, ["แมว", "แมวน้ำ", "หมา"])
    set_to = lambda w, x: {r["word"]: r["weight"] for r in lexicons.set_weights(words, sources.from_words(spark, {w: x})).collect()}
    assert sum(set_to("แมว", 5.0).values()) == 7 and sum(set_to("ปลา", 9.0).values()) == 3
    assert lexicons.stats(words).first()["max_weight"] == 1.0
    found = Lexicon.of({"กงการ": 1, "กฎหมาย": 2.5, "การ": 1, "การบ้าน": 1.8, "สวัสดี": 3}).beginning("การบ้านของฉันตามกฎหมาย", 0, 10)
    assert list(found) == [(3, 1.0), (7, 1.8)]
    costs = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "w double").select(lexicons.word_cost(F.col("w"), F.lit(2.0)).alias("c")).collect()
    assert [round(r["c"], 6) for r in costs] == [10.0, round(math.log(2), 6), 0.0]
    assert lexicons.add_bigrams(spark.createDataFrame([("a", "b", 1.0)], "prev string, next string, count double"), spark.createDataFrame([("a", "b", 4.0)], "prev string, next string, count double")).collect()[0]["count"] == 4.0


def test_corpora(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ฉัน\tPR\tO\nรัก\tVV\tO\n_\tPU\tO\nไทย\tNN\tO\n\nเขา\tPR\tO\nมา\tVV\tO\n", encoding="utf-8")
    chunks = corpora.lst20_chunks(corpora.numbered(spark, str(tmp_path / "a.txt")))
    assert [r["words"] for r in chunks.orderBy("chunk_no").collect()] == [["ฉัน", "รัก"], ["ไทย"], ["เขา", "มา"]]
    (tmp_path / "b.txt").write_text("# c\n1\tบ้าน|เมือง\n2\t_\n3\tดี\n", encoding="utf-8")
    chunks = corpora.blackboard_chunks(corpora.numbered(spark, str(tmp_path / "b.txt")))
    assert [r["words"] for r in chunks.orderBy("chunk_no").collect()] == [["บ้านเมือง"], ["ดี"]]
    rows = spark.createDataFrame([("× 0061 × 0020 ÷ 0E01 ÷ # x",), ("# only a comment",)], "value string")
    assert [tuple(r) for r in corpora.conformance_cases(rows).collect()] == [("a ก", [False, False, True, True])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.txt").write_text("ไปไหน\n", encoding="utf-8")
    corpora.segment_lines(spark, TextFunctions(Lexicon.of(["ไป", "ไหน"])), str(tmp_path / "in"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).collect()[0]["value"] == "ไป|ไหน"


def test_scores(spark):
    schema = "chunk_id int, words array<string>"
    gold = spark.createDataFrame([(1, ["ประจำ", "ปี"]), (2, ["ต่อมา"]), (3, ["อื่น"])], schema)
    pred = spark.createDataFrame([(1, ["ประ", "จำปี"]), (2, ["ต่อ", "มา"]), (3, ["ผิด"])], schema)
    lexicon = sources.from_words(spark, ["ประจำ", "ปี", "ต่อ", "มา"])
    score = {r["kind"]: r for r in corpus.score(gold, pred).collect()}
    assert (score["word"]["n_gold"], score["word"]["recall"]) == (3, 0.0)
    assert {r["cause"]: r["n"] for r in corpus.error_causes(gold, pred, lexicon).collect()} == {"in_lexicon": 2, "not_in_lexicon": 1}
    assert [r["word"] for r in corpus.unknown_words(gold, pred, lexicon).collect()] == ["ต่อมา"]
    assert corpus.latency(spark.range(101).selectExpr("cast(id as double) as seconds")).first()["p95"] == 95.0


@pytest.mark.parametrize(
    ("amount", "expected"),
    [
        (21.0, "ยี่สิบเอ็ดบาทถ้วน"),
        (1001.0, "หนึ่งพันเอ็ดบาทถ้วน"),
        (1000001.0, "หนึ่งล้านเอ็ดบาทถ้วน"),
        (-50.0, "ลบห้าสิบบาทถ้วน"),
        (0.25, "ยี่สิบห้าสตางค์"),
        (-0.001, "ศูนย์บาทถ้วน"),
        (float("nan"), ""),
        (None, None),
    ],
)
def test_bahttext(spark, amount, expected):
    assert spark.createDataFrame([(amount,)], "a double").select(amounts.bahttext("a")).first()[0] == expected


def test_written_amounts_and_ids(spark):
    given = ["0.995", "9223372036854775807.995", "abc", "1.2.3", "", "1,000", None]
    rows = spark.createDataFrame([(x,) for x in given], "a string").select(amounts.bahttext_str("a").alias("r")).collect()
    assert [r["r"] and (r["r"]["value"], r["r"]["error"] is not None) for r in rows] == [("หนึ่งบาทถ้วน", False), (None, True), (None, True), (None, True), (None, True), ("หนึ่งพันบาทถ้วน", False), None]
    ids = spark.createDataFrame([("1-2345-67890-12-1",), ("1234567890120",), ("12345",)], "a string").select(amounts.validate_id("a").alias("r")).collect()
    assert [(r["r"]["is_valid"], r["r"]["formatted"]) for r in ids] == [(True, "1-2345-67890-12-1"), (False, "1-2345-67890-12-0"), (False, None)]


def test_sql_functions(spark):
    t = TextFunctions(Lexicon.of(["ไป", "เขา"]))
    register(spark, t)
    row = spark.sql("SELECT kham_words('เขาไป home') AS w, kham_wrap('the quick brown', 10) AS l, kham_display_width('ก็') AS n").first()
    assert (row["w"], row["l"], row["n"]) == (["เขา", "ไป", "home"], "the quick\nbrown", 1)
    tokens = spark.sql("SELECT x.id, t.token FROM VALUES (1, 'เขาไป') AS x(id, s), LATERAL kham_tokens(x.s) t ORDER BY t.pos").collect()
    assert [r["token"] for r in tokens] == ["เขา", "ไป"]
    assert model_info(spark, t).first()["words"] == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.txt").write_text("เขาไป\nhome\n", encoding="utf-8")
    lines = streams.joined_tokens(streams.read_lines(spark, str(tmp_path / "in")), TextFunctions(Lexicon.of(["ไป", "เขา"])))
    q = lines.writeStream.format("memory").queryName("joined_lines").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["value"] for r in spark.sql("SELECT * FROM joined_lines").collect()) == ["home", "เขา|ไป"]


def test_scores_stay_in_rows(spark):
    """Scoring against sets of spans by brute force, over random splits; words aren't shuffled before they are counted."""
    rng = random.Random(5)

    def split(t):
        cuts = sorted({0, len(t), *(rng.randrange(len(t) + 1) for _ in range(3))})
        return [t[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] or []

    texts = ["".join(rng.choice("กขa😀 ") for _ in range(rng.randrange(9))) for _ in range(300)]
    rows = [(k, split(t), split(t if rng.random() < 0.9 else t + "x")) for k, t in enumerate(texts)]
    rows.append((len(rows), ["ก", None, ""], ["ก"]))
    df = spark.createDataFrame(rows, "chunk_id long, gold array<string>, pred array<string>")
    gold, pred = df.selectExpr("chunk_id", "gold AS words"), df.selectExpr("chunk_id", "pred AS words")

    def places(ws):
        ws = [w for w in ("".join((w or "").split()) for w in ws) if w]
        ends = list(itertools.accumulate(map(len, ws)))
        return [(e - len(w), e, w) for e, w in zip(ends, ws, strict=True)]

    want, bad = collections.Counter(), collections.Counter()
    for _, g, p in rows:
        g, p = places(g), places(p)
        if "".join(w for *_, w in g) != "".join(w for *_, w in p):
            continue
        inner = [{a for a, *_ in x if a} for x in (g, p)]
        want.update({"word": len(set(g) & set(p)), "n_word": len(g), "boundary": len(inner[0] & inner[1]), "n_boundary": len(inner[0]), "p_boundary": len(inner[1])})
        bad.update(w for a, b, w in g if (a, b, w) not in p)
    score = {r["kind"]: r for r in corpus.score(gold, pred).collect()}
    assert (score["word"]["hits"], score["word"]["n_gold"]) == (want["word"], want["n_word"])
    assert (score["boundary"]["hits"], score["boundary"]["n_gold"], score["boundary"]["n_pred"]) == (want["boundary"], want["n_boundary"], want["p_boundary"])
    missed = corpus.missed(gold, pred)
    assert collections.Counter(r["word"] for r in missed.collect()) == bad
    assert "Window" not in missed._jdf.queryExecution().toString()
    assert corpus.score(gold.limit(0), pred).count() == 0


def test_percentiles_are_exact_and_spread(spark):
    """As Spark's exact aggregate gives them, over ties, negatives, infinities and few rows; not all values meet in a task."""
    rng = random.Random(9)
    columns = [
        [rng.expovariate(1) for _ in range(20_000)],
        [float(rng.randrange(3)) for _ in range(5_000)],
        [-rng.random() * 1e300 for _ in range(999)] + [math.inf, -math.inf, None],
        [7.0],
        [1.0, 2.0],
        [],
    ]
    for column in columns:
        df = spark.createDataFrame([(x,) for x in column], "seconds double").repartition(4)
        want = df.agg(*[F.percentile("seconds", q / 100).alias(f"p{q}") for q in (50, 90, 95, 99)])
        assert corpus.latency(df).collect() == want.collect()
    whole = corpus.latency(spark.range(1001).selectExpr("cast(id as decimal(10, 2)) as seconds")).first()
    assert tuple(whole) == (500.0, 900.0, 950.0, 990.0)
    assert "percentile(" not in corpus.latency(spark.range(9).selectExpr("id as seconds"))._jdf.queryExecution().toString()


def test_files_are_read_in_blocks(spark, tmp_path, monkeypatch):
    """Lines of files that are read in many blocks have their numbers, and chunks go on across blocks and pieces."""
    monkeypatch.setattr(corpora, "PIECE", 7)
    lines = {f: [("" if k % 5 == f % 5 else f"w{f}-{k}") for k in range(300 + f)] for f in (1, 2)}
    for f, own in lines.items():
        (tmp_path / f"{f}.txt").write_bytes("".join(f"{w}\tNN{chr(13) if k % 3 else ''}\n" if w else "\n" for k, w in enumerate(own)).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        rows = corpora.numbered(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 2
        got = {}
        for r in rows.collect():
            got.setdefault(int(r["file"][-5]), {})[r["line_no"]] = r["value"].split("\t")[0]
        assert got == {f: dict(enumerate(own)) for f, own in lines.items()}
        chunks = [tuple(r["words"]) for r in corpora.lst20_chunks(rows).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [tuple(g) for own in lines.values() for solid, g in itertools.groupby(own, bool) if solid]
    assert sorted(chunks) == sorted(want)
    assert "wholetext" not in rows._jdf.queryExecution().toString()
