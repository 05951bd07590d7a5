"""Queries over the engine's own operators, and the SQL that must agree with them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khamkit.functions import amounts, sql, text
from khamkit.functions.segment import Bigrams, Lexicon
from khamkit.functions.text import TextFunctions
from khamkit.functions.tokens import BLANK, plain_tokens, plain_words
from khamkit.operators import corpus
from khamkit.operators import lexicon as lexicons
from khamkit.sources import corpora
from khamkit.sources.lexicons import apply_weights, from_words, model_lexicon, packaged, read_bigrams, read_lexicon, read_weights, write_lexicon
from khamkit.sources.tables import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The token pattern for text outside the Thai block, white space, and markup, as DuckDB reads them.
SQL_TOKEN = (
    r"(?:[a-zA-Z]+(?:[-_''][a-zA-Z0-9]+)*|\p{Nd}+(?:,\p{Nd}+)*(?:\.\p{Nd}+)?%?"
    r"|[ \t]+|\r?\n|[^\x{0E00}-\x{0E7F}a-zA-Z0-9 \t\r\n])"
)
SQL_BLANK = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*"
SQL_MARKUP = r"(?si:<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<[a-zA-Z/!?][^>]*>|&[a-zA-Z0-9#]+;)"


def sql_tokens(column: str) -> str:
    return f"regexp_extract_all({column}, '{SQL_TOKEN}')"


def sql_words(column: str) -> str:
    return f"list_filter({sql_tokens(column)}, lambda t: NOT regexp_full_match(t, '{SQL_BLANK}'))"


def query(name: str, sql: str | None = None) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def functions(spark: SparkSession) -> TextFunctions:
    """The text functions over the packaged lexicon."""
    return TextFunctions(model_lexicon(packaged(spark)))


def exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, token) of documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(functions(spark).tokens("text")).alias("pos", "token"))


# Segmentation.


@query("word_counts_topk", f"""
    WITH t AS (SELECT unnest({sql_words("text")}) AS token FROM documents)
    SELECT token, count(*) AS n FROM t GROUP BY token ORDER BY n DESC, token LIMIT 100""")
def word_counts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent tokens, ties by token."""
    counts = corpus.word_counts(exploded(spark, sf_dir)).withColumnRenamed("word", "token")
    return counts.orderBy(F.desc("n"), "token").limit(100)


@query("tokens_per_doc", f"SELECT doc_id, len({sql_tokens('text')}) AS n_tokens, len({sql_words('text')}) AS n_words FROM documents")
def tokens_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    solid = lambda t: F.size(F.filter(t, lambda x: ~x.rlike(BLANK)))
    both = amounts.bound(plain_tokens("text"), lambda t: F.struct(F.size(t).cast("long").alias("n_tokens"), solid(t).cast("long").alias("n_words")))
    return table(spark, sf_dir, "documents").select("doc_id", both.alias("n")).select("doc_id", "n.*")


@query("tokens_exploded", f"""
    WITH t AS (SELECT conv_id, turn, {sql_words("text")} AS w FROM conversations)
    SELECT conv_id, turn, unnest(range(len(w))) AS pos, unnest(w) AS token FROM t""")
def tokens_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.posexplode(plain_words("text")).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


@query("tokens_lattice", f"SELECT item_id, array_to_string({sql_words('text')}, ' ') AS tokens FROM benchmark")
def tokens_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segmenter itself, which outside Thai must find the pattern's tokens."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(functions(spark).lattice_tokens("text"), " ").alias("tokens"))


@query("tokens_fast_path", f"SELECT doc_id, array_to_string({sql_words('text')}, ' ') AS tokens FROM documents")
def tokens_fast_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without Thai letters stay in the JVM."""
    rows = functions(spark).tokens_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("tokenize_roundtrip", f"SELECT doc_id, array_to_string({sql_tokens('text')}, '') = text AS same FROM documents")
def tokenize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.array_join(plain_tokens("text"), "") == F.col("text")).alias("same"))


@query("spans_per_item", f"SELECT item_id, len({sql_tokens('text')}) AS n_spans, length(text) AS covered, 0 AS n_oov FROM benchmark")
def spans_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = functions(spark).spans("text")
    rows = table(spark, sf_dir, "benchmark").select("item_id", spans.alias("s"))
    return rows.select("item_id", F.size("s").cast("long").alias("n_spans"), F.element_at("s", -1)["end"].cast("long").alias("covered"), F.size(F.filter("s", lambda x: x["is_oov"])).cast("int").alias("n_oov"))


@query("join_tokens", f"SELECT item_id, array_to_string({sql_words('text')}, '|') AS joined FROM benchmark")
def join_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", functions(spark).join("text", "|").alias("joined"))


def boundary_sql(unit: str) -> str:
    return f"""
    WITH t AS (SELECT item_id, list_transform({sql_tokens("text")}, lambda x: {unit}) AS sizes FROM benchmark),
    u AS (SELECT item_id, 0 AS pos, 0 AS size FROM t UNION ALL SELECT item_id, unnest(range(1, len(sizes) + 1)), unnest(sizes) FROM t)
    SELECT item_id, pos, sum(size) OVER (PARTITION BY item_id ORDER BY pos)::BIGINT AS at FROM u"""


def boundaries(unit: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(functions(spark).boundaries("text", unit)).alias("pos", "at"))
        return rows.select("item_id", F.col("pos").cast("long").alias("pos"), F.col("at").cast("long").alias("at"))

    return run


query("boundaries_char", boundary_sql("length(x)"))(boundaries("char"))
query("boundaries_byte", boundary_sql("strlen(x)"))(boundaries("byte"))
query("boundaries_utf16", boundary_sql(r"length(x) + length(regexp_replace(x, '[^\x{10000}-\x{10FFFF}]', '', 'g'))"))(boundaries("utf16"))


@query("boundary_lookup", f"""
    WITH t AS (SELECT item_id, list_prepend(0, list_transform({sql_tokens("text")}, lambda x: length(x))) AS s FROM benchmark),
    b AS (SELECT item_id, list_transform(range(1, len(s) + 1), lambda i: list_sum(s[1:i])::BIGINT) AS b FROM t)
    SELECT item_id, list_min(list_filter(b, lambda x: x > 40)) AS following, list_max(list_filter(b, lambda x: x < 40)) AS preceding,
           list_contains(b, 40) AS is_boundary, b[1] AS first, b[-1] AS last FROM b""")
def boundary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundaries around offset 40, and the ends."""
    b = F.col("b")
    rows = table(spark, sf_dir, "benchmark").select("item_id", functions(spark).boundaries("text").alias("b"))
    found = {"following": text.following(b, 40), "preceding": text.preceding(b, 40), "first": text.first(b), "last": text.last(b)}
    return rows.select("item_id", *[c.cast("long").alias(n) for n, c in found.items()], text.is_boundary(b, 40).alias("is_boundary"))


# Width, normalization, markup.


@query("display_width", r"""
    WITH t AS (SELECT doc_id, regexp_replace(text, '[\x{0E31}\x{0E34}-\x{0E3A}\x{0E47}-\x{0E4E}\x{200B}]', '', 'g') AS s FROM documents)
    SELECT doc_id, length(s) + length(regexp_replace(s, '[^\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]', '', 'g')) AS width FROM t""")
def display_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.display_width("text").cast("long").alias("width"))


@query("normalize_text", r"SELECT doc_id, md5(regexp_replace(text, '[\x{200B}-\x{200F}\x{FEFF}]', '', 'g')) AS digest FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without Thai letters all that changes is characters without width."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(functions(spark).normalize("text")).alias("digest"))


@query("zero_width_removed", r"SELECT page_id, md5(regexp_replace(html, '[\x{200B}-\x{200F}\x{FEFF}]', '', 'g')) AS digest FROM pages")
def zero_width_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.without_zero_width("html")).alias("digest"))


@query("html_detect", "SELECT page_id, regexp_matches(html, '<[a-zA-Z/!?][^>]*>') AS is_markup FROM pages")
def html_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.is_markup("html").alias("is_markup"))


@query("markup_stripped", f"SELECT page_id, md5(regexp_replace(html, '{SQL_MARKUP}', '', 'g')) AS digest FROM pages")
def markup_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.without_markup("html")).alias("digest"))


@query("markup_span_counts", f"SELECT page_id, len(regexp_extract_all(html, '{SQL_MARKUP}')) AS n FROM pages")
def markup_span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(text.markup_spans("html")).cast("long").alias("n"))


@query("html_text_tokens", f"""
    WITH t AS (SELECT page_id, unnest(regexp_split_to_array(html, '{SQL_MARKUP}')) AS part FROM pages)
    SELECT page_id, sum(len({sql_words("part")}))::BIGINT AS n FROM t GROUP BY page_id""")
def html_text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(functions(spark).html_words("html")).cast("long").alias("n"))


# Line breaking.


@query("lines_roundtrip", "SELECT doc_id, md5(text) AS digest FROM documents")
def lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With its markers taken out a text is what it was."""
    marked = functions(spark).lines("text", "\u0001")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.replace(marked, F.lit("\u0001"), F.lit(""))).alias("digest"))


@query("lines_no_marker_by_space", "SELECT doc_id, false AS beside FROM documents")
def lines_no_marker_by_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = functions(spark).lines("text", "\u0001")
    return table(spark, sf_dir, "documents").select("doc_id", marked.rlike("[\\s​]\u0001").alias("beside"))


@query("break_segments")
def break_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(functions(spark).segments("text")).alias("pos", "segment"))


@query("break_action_counts")
def break_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = table(spark, sf_dir, "benchmark").select(F.explode(functions(spark).break_actions("text", dictionary=False)).alias("action"))
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("line_classes", """
    WITH t AS (SELECT unnest(string_split(text, '')) AS c FROM benchmark)
    SELECT count(*) FILTER (c BETWEEN 'a' AND 'z' OR c BETWEEN 'A' AND 'Z') AS letters, count(*) FILTER (c = ' ') AS blanks FROM t""")
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII letters and blanks of benchmark texts, by class."""
    rows = table(spark, sf_dir, "benchmark").select(F.explode(F.arrays_zip(F.split("text", "").alias("c"), functions(spark).line_classes("text").alias("k"))).alias("x"))
    letters = F.col("x.c").rlike("^[a-zA-Z]$") & (F.col("x.k") == "AL")
    return rows.agg(F.count_if(letters).alias("letters"), F.count_if(F.col("x.k") == "SP").alias("blanks"))


@query("wrap_lines")
def wrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", functions(spark).wrap("text", 40).alias("wrapped"))
    return text.wrapped_lines(rows, "wrapped")


@query("wrap_fits", "SELECT item_id, true AS fits FROM benchmark")
def wrap_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No line is wider than asked for, as no word here is."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.split(functions(spark).wrap("text", 60), "\n").alias("lines"))
    return rows.select("item_id", F.forall("lines", lambda x: text.display_width(x) <= 60).alias("fits"))


@query("wrap_html")
def wrap_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(functions(spark).wrap("html", 72, is_html=True)).alias("digest"))


@query("escape_then_break", "SELECT item_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')) AS digest FROM benchmark")
def escape_then_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = functions(spark).lines(text.escaped("text"), "\u0001", is_html=True)
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.replace(marked, F.lit("\u0001"), F.lit(""))).alias("digest"))


@query("can_break_between")
def can_break_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between neighbouring tokens of benchmark texts."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", plain_tokens("text").alias("t"))
    pairs = rows.select("item_id", F.posexplode(F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("left"), F.slice("t", 2, F.size("t") - 1).alias("right"))).alias("pos", "p"))
    return pairs.select("item_id", "pos", functions(spark).can_break_between("p.left", "p.right").alias("can"))


@query("compare_modes")
def compare_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions(spark).compare(table(spark, sf_dir, "benchmark")).select("item_id", "words", "lines")


# Lexicons.


def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, weight): words of part names, weighted by how often they occur."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def type_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_type", F.substring_index("p_name", " ", 1))), " ")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg((F.count(F.lit(1)) + 0.5).cast("double").alias("weight"))


SQL_PARTS = "p AS (SELECT word, count(*)::DOUBLE AS weight FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> '' GROUP BY word)"
SQL_TYPES = "t AS (SELECT word, count(*) + 0.5::DOUBLE AS weight FROM (SELECT unnest(string_split(lower(concat_ws(' ', p_type, split_part(p_name, ' ', 1))), ' ')) AS word FROM part) WHERE word <> '' GROUP BY word)"
SQL_BOTH = f"WITH {SQL_PARTS}, {SQL_TYPES}"


@query("lexicon_add", f"{SQL_BOTH} SELECT word, max(weight) AS weight FROM (SELECT * FROM p UNION ALL SELECT * FROM t) GROUP BY word")
def lexicon_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.add(part_words(spark, sf_dir), type_words(spark, sf_dir))


@query("lexicon_set_weights", f"{SQL_BOTH} SELECT p.word, coalesce(t.weight, p.weight) AS weight FROM p LEFT JOIN t ON p.word = t.word")
def lexicon_set_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.set_weights(part_words(spark, sf_dir), type_words(spark, sf_dir))


@query("lexicon_merge_first_wins", f"{SQL_BOTH} SELECT * FROM p UNION ALL SELECT * FROM t WHERE word NOT IN (SELECT word FROM p)")
def lexicon_merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.merge_first_wins(part_words(spark, sf_dir), type_words(spark, sf_dir))


@query("lexicon_merge_later_wins", f"{SQL_BOTH} SELECT * FROM t UNION ALL SELECT * FROM p WHERE word NOT IN (SELECT word FROM t)")
def lexicon_merge_later_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.merge_later_wins(part_words(spark, sf_dir), type_words(spark, sf_dir))


@query("lexicon_stats", f"WITH {SQL_PARTS} SELECT count(*) AS words, sum(weight) AS total_weight, greatest(max(weight), 1.0) AS max_weight FROM p")
def lexicon_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.stats(part_words(spark, sf_dir))


@query("lexicon_contains", f"{SQL_BOTH} SELECT word FROM t WHERE word IN (SELECT word FROM p)")
def lexicon_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.contains(type_words(spark, sf_dir).select("word"), part_words(spark, sf_dir), "word")


@query("lexicon_weight", f"{SQL_BOTH} SELECT t.word, coalesce(p.weight, 0.0) AS weight FROM t LEFT JOIN p ON p.word = t.word")
def lexicon_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.with_weight(type_words(spark, sf_dir).select("word"), part_words(spark, sf_dir), "word")


@query("lexicon_cost", f"WITH {SQL_PARTS} SELECT word, round(-ln(least(greatest(weight / (SELECT max(weight) FROM p), 1e-9), 1.0)), 6) + 0.0 AS cost FROM p")
def lexicon_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = part_words(spark, sf_dir)
    most = lexicons.stats(words).first()["max_weight"]
    return words.select("word", (F.round(lexicons.word_cost(F.col("weight"), F.lit(most)), 6) + F.lit(0.0)).alias("cost"))


@query("prefix_table", f"""WITH {SQL_PARTS}, x AS (SELECT word, weight, unnest(range(1, length(word) + 1)) AS n FROM p)
    SELECT word[1:n] AS prefix, max(CASE WHEN n = length(word) THEN weight ELSE 0.0 END) AS weight FROM x GROUP BY word[1:n]""")
def prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.prefix_table(part_words(spark, sf_dir))


@query("prefixes_in_text", f"""WITH {SQL_PARTS}, s AS (SELECT p_partkey, p_name, unnest(range(0, length(p_name))) AS start FROM part)
    SELECT p_partkey, start, word, weight FROM s JOIN p ON substr(p_name, start + 1, length(word)) = word""")
def prefixes_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon words at every place of part names."""
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    found = lexicons.prefixes_in(names, part_words(spark, sf_dir), "p_name")
    return found.select("p_partkey", F.col("start").cast("long").alias("start"), "word", "weight")


@query("bigram_counts", f"""
    WITH t AS (SELECT doc_id, {sql_words("text")} AS w FROM documents),
    e AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM t),
    b AS (SELECT token AS prev, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM e)
    SELECT prev, next, count(*)::DOUBLE AS count FROM b WHERE next IS NOT NULL GROUP BY prev, next""")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.bigrams_in(functions(spark).tokens_of(table(spark, sf_dir, "documents").select("text")))


# Corpus statistics.


@query("word_counts_in_lexicon", f"""
    WITH {SQL_PARTS}, t AS (SELECT unnest({sql_words("p_name")}) AS word FROM part)
    SELECT word, count(*) AS n FROM t WHERE word IN (SELECT word FROM p) GROUP BY word""")
def word_counts_in_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "part").select(F.explode(plain_words("p_name")).alias("token"))
    return corpus.word_counts(tokens, part_words(spark, sf_dir))


@query("word_weights_top_n", f"""
    WITH t AS (SELECT unnest({sql_words("text")}) AS word FROM documents),
    c AS (SELECT word, count(*) AS n FROM t GROUP BY word ORDER BY n DESC, word LIMIT 500)
    SELECT word, round(pow(n / (SELECT min(n) FROM c), 0.5), 4) AS weight FROM c""")
def word_weights_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.word_weights(corpus.word_counts(exploded(spark, sf_dir)), 500)


def gold_and_pred(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tokens as gold, words between blanks as a prediction."""
    rows = table(spark, sf_dir, "benchmark")
    gold = rows.select(F.col("item_id").alias("chunk_id"), plain_words("text").alias("words"))
    pred = rows.select(F.col("item_id").alias("chunk_id"), F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != "").alias("words"))
    return gold, pred


SQL_SPANS = f"""
    g0 AS (SELECT item_id AS c, {sql_words("text")} AS w FROM benchmark),
    p0 AS (SELECT item_id AS c, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM benchmark),
    ge AS (SELECT c, unnest(w) AS word, unnest(range(len(w))) AS pos FROM g0), pe AS (SELECT c, unnest(w) AS word, unnest(range(len(w))) AS pos FROM p0),
    g AS (SELECT c, word, sum(length(word)) OVER (PARTITION BY c ORDER BY pos) AS e FROM ge), p AS (SELECT c, word, sum(length(word)) OVER (PARTITION BY c ORDER BY pos) AS e FROM pe),
    ok AS (SELECT (SELECT count(*) FROM g JOIN p ON g.c = p.c AND g.e = p.e AND g.word = p.word) AS w_hits)"""
SQL_PRF = "hits / n_pred AS precision, hits / n_gold AS recall, CASE WHEN hits = 0 THEN 0.0 ELSE 2 * (hits / n_pred) * (hits / n_gold) / (hits / n_pred + hits / n_gold) END AS f1"


@query("segmentation_scores", f"""
    WITH {SQL_SPANS},
    gb AS (SELECT c, e FROM g EXCEPT SELECT c, max(e) FROM g GROUP BY c), pb AS (SELECT c, e FROM p EXCEPT SELECT c, max(e) FROM p GROUP BY c),
    s AS (SELECT 'word' AS kind, (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM p) AS n_pred, (SELECT w_hits FROM ok) AS hits
          UNION ALL SELECT 'boundary', (SELECT count(*) FROM gb), (SELECT count(*) FROM pb), (SELECT count(*) FROM gb JOIN pb USING (c, e)))
    SELECT kind, n_gold, n_pred, hits, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1
    FROM (SELECT kind, n_gold, n_pred, hits, {SQL_PRF} FROM s)""")
def segmentation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = corpus.score(*gold_and_pred(spark, sf_dir))
    return scores.select("kind", "n_gold", "n_pred", "hits", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("segmentation_errors", f"""
    WITH {SQL_SPANS}, m AS (SELECT g.word FROM g LEFT JOIN p ON g.c = p.c AND g.e = p.e AND g.word = p.word WHERE p.word IS NULL)
    SELECT 'non_thai' AS cause, count(*) AS n FROM m""")
def segmentation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.error_causes(*gold_and_pred(spark, sf_dir), part_words(spark, sf_dir))


@query("without_overlap", """
    SELECT conv_id, turn, text FROM conversations
    WHERE trim(text) NOT IN (SELECT trim(text) FROM documents WHERE text IS NOT NULL)""")
def without_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations that no document equals."""
    chunks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.array(F.trim("text")).alias("words"))
    seen = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.array(F.trim("text")).alias("words"))
    return corpus.without_overlap(chunks, seen).select("conv_id", "turn", "text")


@query("overlap_found", """
    SELECT item_id FROM benchmark WHERE text NOT IN (SELECT text FROM benchmark WHERE length(text) > (SELECT median(length(text)) FROM benchmark))""")
def overlap_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items left when the longer half counts as seen."""
    chunks = table(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("size"), F.array("text").alias("words"))
    middle = chunks.agg(F.median("size")).first()[0]
    return corpus.without_overlap(chunks, chunks.where(F.col("size") > middle)).select("item_id")


# Utilities.


def sql_group(v: str, higher: str) -> str:
    """SQL for the words of 0 to 999,999, as ``amounts.group_words`` says them."""
    digits = "[" + ", ".join(f"'{d}'" for d in amounts.DIGITS) + "]"
    digit = lambda k: f"(({v}) // {10**k}) % 10"
    out = [f"CASE WHEN {digit(k)} > 0 THEN {digits}[{digit(k)} + 1] || '{amounts.PLACES[k]}' ELSE '' END" for k in range(5, 1, -1)]
    out.append(f"CASE {digit(1)} WHEN 0 THEN '' WHEN 1 THEN '{amounts.PLACES[1]}' WHEN 2 THEN '{amounts.TWENTY}' ELSE {digits}[{digit(1)} + 1] || '{amounts.PLACES[1]}' END")
    out.append(f"CASE WHEN {digit(0)} = 1 AND (({v}) >= 10 OR {higher}) THEN '{amounts.ONE_LAST}' ELSE {digits}[{digit(0)} + 1] END")
    return " || ".join(f"({x})" for x in out)


SQL_NUMBER = f"""(CASE WHEN b >= 1000000 THEN {sql_group("b // 1000000", "false")} || '{amounts.MILLION}' ELSE '' END) || (CASE WHEN b % 1000000 > 0 THEN {sql_group("b % 1000000", "b >= 1000000")} ELSE '' END)"""


@query("bahttext", f"""
    WITH t AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders), u AS (SELECT o_orderkey, c // 100 AS b, c % 100 AS s FROM t)
    SELECT o_orderkey, CASE WHEN b = 0 AND s = 0 THEN '{amounts.ZERO}{amounts.BAHT}{amounts.EXACTLY}' ELSE
        (CASE WHEN b > 0 THEN {SQL_NUMBER} || '{amounts.BAHT}' ELSE '' END) ||
        (CASE WHEN s > 0 THEN {sql_group("s", "false")} || '{amounts.SATANG}' ELSE '{amounts.EXACTLY}' END) END AS words FROM u""")
def bahttext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", amounts.bahttext("o_totalprice").alias("words"))


@query("bahttext_str", f"""
    WITH t AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders), u AS (SELECT o_orderkey, c // 100 AS b FROM t)
    SELECT o_orderkey, CASE WHEN b = 0 THEN '{amounts.ZERO}{amounts.BAHT}{amounts.EXACTLY}' ELSE {SQL_NUMBER} || '{amounts.BAHT}{amounts.EXACTLY}' END AS words, NULL::VARCHAR AS error FROM u""")
def bahttext_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole baht, written with thousands commas."""
    whole = F.call_function("div", F.round(F.col("o_totalprice") * 100).cast("long"), F.lit(100).cast("long"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", amounts.bahttext_str(F.format_number(whole, 0)).alias("r"))
    return rows.select("o_orderkey", F.col("r.value").alias("words"), F.col("r.error").alias("error"))


SQL_ID_SUM = " + ".join(f"substr(id, {k + 1}, 1)::INT * {13 - k}" for k in range(12))


@query("validate_id", f"""
    WITH t AS (SELECT o_orderkey, lpad((o_orderkey * 7919 + 1000000000000)::VARCHAR, 13, '0') AS id FROM orders), u AS (SELECT o_orderkey, id, (11 - ({SQL_ID_SUM}) % 11) % 10 AS k FROM t)
    SELECT o_orderkey, k = substr(id, 13, 1)::INT AS is_valid, id,
           concat_ws('-', substr(id, 1, 1), substr(id, 2, 4), substr(id, 6, 5), substr(id, 11, 2), substr(id, 13, 1)) AS formatted,
           CASE WHEN k <> substr(id, 13, 1)::INT THEN 'Invalid checksum: expected check digit ' || k || ', got ' || substr(id, 13, 1) END AS error FROM u""")
def validate_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.lpad((F.col("o_orderkey") * 7919 + 1_000_000_000_000).cast("string"), 13, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", amounts.validate_id(number).alias("r")).select("o_orderkey", "r.*")


# Texts whose results are known by how they are made.


def cases_sql(cases: list[tuple[str, str]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in cases) + ") t(text, result)"


def cases(name: str, expected: list[tuple[str, str]], run: Callable[[SparkSession], Callable]) -> None:
    def answer(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.createDataFrame([(t,) for t, _ in expected], "text string")
        return rows.select("text", run(spark)("text").alias("result"))

    query(name, cases_sql(expected))(answer)


def drawn_sql(slots: list[list[str]], key: str) -> list[str]:
    """SQL for the choice of each slot, which the row's key draws."""
    return [f"[{', '.join(repr(x) for x in slot)}][({key} // {5**k} + {3 * k}) % {len(slot)} + 1]" for k, slot in enumerate(slots)]


def drawn(slots: list[list[str]], key: str) -> list:
    at = lambda k, n: (F.call_function("div", F.col(key), F.lit(5**k).cast("long")) + 3 * k) % n + 1
    return [F.element_at(F.array(*map(F.lit, slot)), at(k, len(slot)).cast("int")) for k, slot in enumerate(slots)]


def made(name: str, slots: list[list[tuple[str, str]]], run: Callable[[SparkSession], Callable], separator: str = "|", glue: str = "", sql: str | None = None) -> None:
    """A query over a made text for each order: a choice (text, result) of each slot, drawn by the order's key.

    The result must be the choices' results, joined; ``sql`` works it out of
    them (as the list ``g``) in another way.
    """
    results = ", ".join(drawn_sql([[r for _, r in slot] for slot in slots], "o_orderkey"))
    kept = f"list_filter([{results}], lambda x: x <> '')"
    whole = sql or f"array_to_string(g, '{separator}')"

    def answer(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = F.concat_ws(glue, *drawn([[t for t, _ in slot] for slot in slots], "o_orderkey"))
        return table(spark, sf_dir, "orders").select("o_orderkey", texts.alias("text")).select("o_orderkey", run(spark)("text").cast("string").alias("result"))

    query(name, f"WITH t AS (SELECT o_orderkey, {kept} AS g FROM orders) SELECT o_orderkey, {whole} AS result FROM t")(answer)


#: A lexicon of words that can be put together in any order and read in one way only.
APART = dict(zip("กิน ข้าว ไป ตลาด บ้าน สวย แมว หมา เดิน น้ำ ปลา ใหญ่".split(), (30.0, 20.0, 50.0, 40.0, 20.0, 30.0, 30.0, 50.0, 60.0, 40.0, 30.0, 20.0), strict=True))
LISTED = [(w, w) for w in APART]
apart = lambda spark: TextFunctions(Lexicon.of(APART))

made("thai_segmentation", [LISTED] * 8, lambda spark: apart(spark).join)
made("thai_unknown_words", [LISTED, [(w, w) for w in ("ชวรัตน์", "กษิต", "เฌอฏา")], LISTED, [("ฟหฬ", "ฟหฬ"), ("", "")], LISTED], lambda spark: apart(spark).join)
made("thai_abbreviations", [LISTED, [(x, x.strip()) for x in (" มิ.ย. ", "ก.ค.", " พ.ศ. ", "ส.ส.", "พ.ต.ท.")], LISTED, LISTED], lambda spark: apart(spark).join)
made("thai_full_stops", [LISTED, [(f"{w}.", f"{w}|.") for w in ("ข้าว", "บ้าน", "น้ำ", "ใหญ่")]], lambda spark: apart(spark).join)
made("thai_letter_names", [LISTED, [("เอทีเอ็ม", "เอทีเอ็ม"), ("บีบีซี", "บีบีซี")], LISTED], lambda spark: apart(spark).join)
made("thai_respelled", [LISTED, [("เเมว", "เเมว"), ("นํ้า", "นํ้า")], LISTED, [("เเมว", "เเมว"), ("กิน", "กิน")]], lambda spark: apart(spark).join)
made("thai_and_others", [LISTED, [(x, x) for x in ("25%", "ABC-1", "1,000.5", "😀", "é")], LISTED, [(" ", ""), ("\n", ""), ("!", "!")], LISTED], lambda spark: apart(spark).join)
made("thai_lines", [LISTED] * 6, lambda spark: lambda c: apart(spark).lines(c, "|"))
made("thai_line_markers", [LISTED, [(" ", " "), ("abc", "abc"), (") ", ") ")], LISTED], lambda spark: lambda c: F.replace(apart(spark).lines(c, "|"), F.lit("|"), F.lit("")), separator="")
for unit, size in (("char", "length(x)"), ("byte", "strlen(x)"), ("utf16", "length(x)")):
    ends = f"list_transform(range(0, len(g) + 1), lambda i: coalesce(list_sum(list_transform(g[1:i], lambda x: {size})), 0)::BIGINT)"
    made(f"thai_boundaries_{unit}", [LISTED] * 5, lambda spark, unit=unit: lambda c: F.array_join(apart(spark).boundaries(c, unit).cast("array<string>"), ","), sql=f"array_to_string({ends}, ',')")
made("thai_counts", [LISTED] * 8, lambda spark: lambda c: F.size(apart(spark).tokens(c)), sql="len(g)::VARCHAR")
SYLLABLES = [(w, w) for w in "กา ปี ดี ไป มา เขา นำ ที่ ยัง เดิน เสีย".split()]
made("thai_cluster_edges", [SYLLABLES] * 6, lambda spark: lambda c: F.array_join(F.filter(F.transform(text.cluster_edges(c), lambda e, i: F.when(e, i.cast("string"))), lambda x: x.isNotNull()), ","), sql="array_to_string(list_transform(range(0, len(g) + 1), lambda i: coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)::BIGINT), ',')")
#: Misspelled words and their normal spelling; among them every order of tone and vowel that is put right.
MISSPELLED = [("เเมว", "แมว"), ("นํ้า", "น้ำ"), ("ปลาๆๆๆ", "ปลาๆ"), ("มากกก", "มาก"), ("ท่ี", "ที่"), ("กาาา", "กา"), ("กา่", "ก่า"), ("มๅ", "มา"), ("ฤๅ", "ฤๅ"), ("ข้\u200bาว", "ข้าว"), ("ส้ัน", "สั้น"), ("แมว ่", "แมว่")]
made("thai_normalize_table", [MISSPELLED] * 4, lambda spark: apart(spark).normalize, separator="-", glue="-")

#: How a line fills up: each piece, if it fits beside what is there, else on the next line.
FILL = """
    WITH RECURSIVE t AS ({pieces}),
    r AS (SELECT k, g, 1 AS i, '' AS done, '' AS line FROM t UNION ALL
          SELECT k, g, i + 1, CASE WHEN {full} THEN done || rtrim(line) || '/' ELSE done END, CASE WHEN {full} THEN g[i] ELSE line || g[i] END FROM r WHERE i <= len(g))
    SELECT k AS {key}, done || rtrim(line) AS result FROM r WHERE i = len(g) + 1"""
SQL_WIDTH = "length(regexp_replace({}, '[\\x{{0E31}}\\x{{0E34}}-\\x{{0E3A}}\\x{{0E47}}-\\x{{0E4E}}]', '', 'g'))"


def full(width: int) -> str:
    return f"line <> '' AND {SQL_WIDTH.format('line')} + {SQL_WIDTH.format('rtrim(g[i])')} > {width}"


made("thai_wrap", [LISTED] * 8, lambda spark: lambda c: apart(spark).wrap(c, 11, separator="/"))
ORACLE["thai_wrap"] = FILL.format(key="o_orderkey", full=full(11), pieces=f"SELECT o_orderkey AS k, [{', '.join(drawn_sql([[w for w, _ in LISTED]] * 8, 'o_orderkey'))}] AS g FROM orders")


@query("wrap_names", FILL.format(key="p_partkey", full=full(12), pieces="SELECT p_partkey AS k, regexp_extract_all(p_name, '[^ ]+ *') AS g FROM part"))
def wrap_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names on lines of 12 columns."""
    return table(spark, sf_dir, "part").select("p_partkey", functions(spark).wrap("p_name", 12, separator="/").alias("result"))


@query("segments_of_names", "WITH t AS (SELECT p_partkey, regexp_extract_all(p_name, '[^ ]+ *') AS g FROM part) SELECT p_partkey, unnest(range(len(g))) AS pos, unnest(g) AS segment FROM t")
def segments_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of letters and blanks break after their blanks only."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(functions(spark).segments("p_name")).alias("pos", "segment"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query("lines_of_priorities", "SELECT o_orderkey, replace(o_orderpriority, '-', '-|') AS result FROM orders")
def lines_of_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line may break after the hyphen of 1-URGENT, and after blanks, which need no marker."""
    return table(spark, sf_dir, "orders").select("o_orderkey", functions(spark).lines("o_orderpriority", "|").alias("result"))


@query("break_actions_of_names", """
    WITH t AS (SELECT p_partkey, string_split(p_name, '') AS c FROM part)
    SELECT p_partkey, array_to_string(list_transform(range(0, len(c) + 1), lambda i: CASE WHEN i = len(c) THEN '2' WHEN i > 0 AND c[i] = ' ' AND c[i + 1] <> ' ' THEN '1' ELSE '0' END), '') AS actions FROM t""")
def break_actions_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action before each place: a break after blanks, and the end."""
    actions = functions(spark).break_actions("p_name", dictionary=False)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(actions.cast("array<string>"), "").alias("actions"))


@query("compare_names", "SELECT p_partkey, replace(p_name, ' ', '|') AS words, p_name AS lines FROM part")
def compare_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions(spark).compare(table(spark, sf_dir, "part"), "p_name").select("p_partkey", "words", "lines")


@query("boundary_steps", f"""
    WITH t AS (SELECT item_id, list_prepend(0, list_transform({sql_tokens("text")}, lambda x: length(x))) AS s FROM benchmark),
    b AS (SELECT item_id, list_transform(range(1, len(s) + 1), lambda i: list_sum(s[1:i])::BIGINT) AS b FROM t)
    SELECT item_id, b[2] AS after_first, b[-2] AS before_last, b[1] AS back, NULL::BIGINT AS before_first, NULL::BIGINT AS after_last, b[6] AS fifth, b[6] AS here FROM b""")
def boundary_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The iterator's steps from the first, the last and the sixth boundary."""
    b = F.col("b")
    rows = table(spark, sf_dir, "benchmark").select("item_id", functions(spark).boundaries("text").alias("b"))
    steps = {
        "after_first": text.next_boundary(b, text.first(b)),
        "before_last": text.previous_boundary(b, text.last(b)),
        "back": text.previous_boundary(b, text.next_boundary(b, text.first(b))),
        "before_first": text.previous_boundary(b, text.first(b)),
        "after_last": text.next_boundary(b, text.last(b)),
        "fifth": text.moved(b, text.first(b), 5),
        "here": text.current_boundary(b, F.element_at(b, 6)),
    }
    return rows.select("item_id", *[c.cast("long").alias(n) for n, c in steps.items()])


cases(
    "line_break_cases",
    [("state-of-the-art", "state-|of-|the-|art"), ("https://example.com/a-b?x=1", "https://|example.com/|a-|b?|x=1"), ("ISO/IEC 29110", "ISO/|IEC |29110"), ("🇹🇭🇯🇵", "🇹🇭|🇯🇵"), ("A\\B", "A\\B"), ("a\r\nb", "a\r\nb"), ("1,234.56 $5 50%", "1,234.56 |$5 |50%"), ("中国 日本", "中|国 |日|本"), ("(a) b!", "(a) |b!")],
    lambda spark: lambda c: F.array_join(functions(spark).segments(c), "|"),
)
#: Two tokens, with a tab between, and whether a line may break there.
BETWEEN = [("ไป\tกิน", "true"), ("a\tb", "false"), ("ISO/\tIEC", "true"), ("state-\tof", "true"), ("ไป\t ", "false"), ("\tx", "false"), ("กิน\tๆ", "false"), ("(\tไป", "false"), ("ไป\t)", "false"), ("100\t%", "false"), ("中\t国", "true"), ("a \tb", "false")]
cases("can_break_cases", BETWEEN, lambda spark: lambda c: functions(spark).can_break_between(F.split_part(F.col(c), F.lit("\t"), F.lit(1)), F.split_part(F.col(c), F.lit("\t"), F.lit(2))).cast("string"))
cases("wrap_html_cases", [("<b>the quick</b> brown fox", "<b>the/quick</b>/brown fox"), ("<p>ไปกินข้าว</p>", "<p>ไปกิน/ข้าว</p>")], lambda spark: lambda c: apart(spark).wrap(c, 10, is_html=True, separator="/"))
cases("trusted_html_lines", [("<b>ไปกิน</b>&nbsp;ปลา", "<b>ไป|กิน</b>&nbsp;ปลา"), ("ไป<br>กินปลา", "ไป<br>กิน|ปลา")], lambda spark: lambda c: apart(spark).lines(c, "|", is_html=True))

#: Each step of normalization, a text that it changes, and what becomes of it.
STEPS = [
    ("remove_zero_width", "ก\u200bา", "กา"),
    ("normalize_sara_ae", "เเก", "แก"),
    ("remove_spaces_before_marks", "ก ่า", "ก่า"),
    ("normalize_sara_am", "นํา", "นำ"),
    ("reorder_vowels_tone", "ท่ี", "ที่"),
    ("remove_dangling", "ก ่", "ก "),
    ("remove_repeat_vowels", "กาา", "กา"),
    ("remove_repeat_consonants", "กกก", "ก"),
]


@query("normalize_steps", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{t}', '{on}')" for s, t, on in STEPS) + ") t(step, text, changed)")
def normalize_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step alone, all others switched off."""
    t = functions(spark)
    names = [s for s, *_ in STEPS]
    one = lambda step, given: spark.createDataFrame([(step, given)], "step string, text string").select("step", "text", t.normalize("text", **{n: n == step for n in names}).alias("changed"))
    return reduce(DataFrame.unionByName, [one(step, given) for step, given, _ in STEPS])


PAIRED = {w: 1.0 for w in ("ตา", "กลม", "ตาก", "ลม")}
for formula in ("count", "pmi", "probability"):
    for first, second in (("ตา", "กลม"), ("ตาก", "ลม")):
        pairs = Bigrams.of([(first, second, 50.0), (first, "อื่น", 3.0)], 2.0, formula)
        cases(f"bigram_{formula}_{len(first)}", [("ตากลม", f"{first}|{second}")], lambda spark, pairs=pairs: TextFunctions(Lexicon.of(PAIRED), bigrams=pairs).join)

SQL_PAIRS = f"""
    t AS (SELECT {sql_words("text")} AS w FROM benchmark), b AS (SELECT unnest(w[1:len(w) - 1]) AS prev, unnest(w[2:]) AS next FROM t WHERE len(w) > 1),
    c AS (SELECT prev, next, count(*)::DOUBLE AS n FROM b GROUP BY prev, next), f AS (SELECT prev, sum(n) AS u FROM c GROUP BY prev)"""


@query("bigram_bonuses", f"WITH {SQL_PAIRS} SELECT c.prev, next, n AS count, round(0.15 * ln(1 + n) / length(next), 9) AS by_count, round(0.15 * ln(1 + n) / ln(1 + u), 9) AS by_pmi, round(0.15 * ln(1 + n / u) / length(next), 9) AS by_probability FROM c JOIN f ON c.prev = f.prev")
def bigram_bonuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pairs of benchmark words take off, by each formula."""
    pairs = lexicons.bigrams_in(functions(spark).tokens_of(table(spark, sf_dir, "benchmark").select("text")))
    by = [lexicons.bigram_bonuses(pairs, formula=f).select("prev", "next", "count", F.round("bonus", 9).alias(f"by_{f}")) for f in ("count", "pmi", "probability")]
    return reduce(lambda a, b: a.join(b, ["prev", "next", "count"]), by)


@query("bigram_lookup", f"WITH {SQL_PAIRS}, q AS (SELECT DISTINCT next AS prev, prev AS next FROM c) SELECT q.prev, q.next, n IS NOT NULL AS has, coalesce(n, 0.0) AS count FROM q LEFT JOIN c ON q.prev = c.prev AND q.next = c.next")
def bigram_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pairs occur the other way round, and how often."""
    pairs = lexicons.bigrams_in(functions(spark).tokens_of(table(spark, sf_dir, "benchmark").select("text")))
    return lexicons.bigram_counts(pairs.select(F.col("next").alias("prev"), F.col("prev").alias("next")).distinct(), pairs)


@query("weights_applied", f"{SQL_BOTH} SELECT word, word IN (SELECT word FROM p) AS applied FROM t")
def weights_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.set_weights_told(part_words(spark, sf_dir), type_words(spark, sf_dir))


@query("lexicon_overlaid", f"{SQL_BOTH} SELECT word, coalesce(t.weight, p.weight, 0.0) AS weight FROM (SELECT word FROM p UNION SELECT word FROM t) JOIN (SELECT word AS tw, weight FROM t) t ON word = tw LEFT JOIN (SELECT word AS pw, weight FROM p) p ON word = pw UNION ALL SELECT word, weight FROM p WHERE word NOT IN (SELECT word FROM t)")
def lexicon_overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all words through an overlay of type words on part words."""
    base, overlay = part_words(spark, sf_dir), type_words(spark, sf_dir)
    every = base.select("word").union(overlay.select("word")).distinct()
    return lexicons.overlaid(base, overlay, every, "word")


# Files written by one query and read by another's source.


@query("lexicon_files", f"WITH {SQL_PARTS} SELECT 'tsv' AS kind, word, weight FROM p UNION ALL SELECT 'sniffed', word, weight FROM p UNION ALL SELECT 'plain', word, 1.0 FROM p")
def lexicon_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part words written as a text with weights, as parquet without an ending, and as a plain list, and read again."""
    folder = scratch(spark)
    words = part_words(spark, sf_dir)
    words.select(F.concat_ws("\t", "word", F.col("weight").cast("string")).alias("value")).write.text(f"{folder}/tsv")
    write_lexicon(words, f"{folder}/sniffed")
    words.select("word").write.text(f"{folder}/plain")
    read = {"tsv": read_lexicon(spark, f"{folder}/tsv"), "sniffed": read_lexicon(spark, f"{folder}/sniffed"), "plain": read_lexicon(spark, f"{folder}/plain", "plain")}
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "word", "weight") for kind, df in read.items()])


@query("weight_files", f"{SQL_BOTH} SELECT p.word, coalesce(t.weight, p.weight) AS weight FROM p LEFT JOIN t ON p.word = t.word")
def weight_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    type_words(spark, sf_dir).select(F.concat_ws("\t", "word", F.col("weight").cast("string")).alias("value")).write.text(folder)
    return apply_weights(part_words(spark, sf_dir), read_weights(spark, folder))


@query("bigram_files", f"WITH {SQL_PAIRS} SELECT prev, next, n AS count FROM c")
def bigram_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    pairs = lexicons.bigrams_in(functions(spark).tokens_of(table(spark, sf_dir, "benchmark").select("text")))
    # A comment sign at a line's start would hide the pair.
    pairs.select(F.concat_ws("\t", "prev", "next", F.col("count").cast("string")).alias("value")).write.text(folder)
    return read_bigrams(spark, folder).select("prev", "next", "count")


@query("gold_chunks", """
    WITH t AS (SELECT string_split(p_name, ' ') AS w, p_partkey FROM part)
    SELECT array_to_string(list_filter(w, lambda x: x <> ''), '|') AS words, count(*) AS n FROM t GROUP BY 1""")
def gold_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names written as a gold corpus, a word a line and a blank line after each, and read as chunks."""
    folder = scratch(spark)
    line = lambda w: F.concat(w, F.lit("\tNN\tO\tO"))
    names = table(spark, sf_dir, "part").select(F.explode(F.concat(F.transform(F.split("p_name", " "), line), F.array(F.lit("")))).alias("value"))
    names.write.text(folder)
    chunks = corpora.lst20_chunks(corpora.numbered(spark, folder))
    return chunks.groupBy(F.array_join("words", "|").alias("words")).agg(F.count(F.lit(1)).alias("n"))


@query("oov_top30", f"""
    WITH t AS (SELECT [{", ".join(drawn_sql([["ชวรัตน์", "กษิต", "เฌอฏา"], [w for w, _ in LISTED]], "o_orderkey"))}] AS g FROM orders)
    SELECT g[1] AS word, count(*) AS n FROM t GROUP BY g[1] ORDER BY n DESC, word LIMIT 30""")
def oov_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missed words that the lexicon lacks, where the prediction joins each to the word after it."""
    words = F.array(*drawn([["ชวรัตน์", "กษิต", "เฌอฏา"], [w for w, _ in LISTED]], "o_orderkey"))
    gold = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), words.alias("words"))
    pred = gold.select("chunk_id", F.array(F.array_join("words", "")).alias("words"))
    return corpus.unknown_words(gold, pred, from_words(spark, APART), 30)


@query("error_causes_thai", """
    SELECT 'not_in_lexicon' AS cause, count(*) AS n FROM orders UNION ALL SELECT 'in_lexicon', count(*) FROM orders UNION ALL SELECT 'non_thai', count(*) FROM orders""")
def error_causes_thai(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One missed word of each cause an order; chunks whose texts differ don't count."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"))
    gold = rows.withColumn("words", F.array(F.lit("กษิต"), F.lit("กิน"), F.lit("abc")))
    pred = rows.withColumn("words", F.array(F.lit("กษิตกินabc")))
    other = rows.select((-F.col("chunk_id") - 1).alias("chunk_id"))
    gold = gold.unionByName(other.withColumn("words", F.array(F.lit("กิน"))))
    pred = pred.unionByName(other.withColumn("words", F.array(F.lit("ปลา"))))
    return corpus.error_causes(gold, pred, from_words(spark, APART))


@query("first_chunks", "SELECT item_id AS chunk_id FROM benchmark ORDER BY item_id LIMIT 10")
def first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_chunks(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id")), 10)


@query("latency_percentiles", "SELECT round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, round(quantile_cont(o_totalprice, 0.95), 6) AS p95, round(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.latency(table(spark, sf_dir, "orders"), "o_totalprice")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("process_modes", "SELECT p_partkey, replace(p_name, ' ', '|') AS words, p_name AS lines, replace(p_name, ' ', '+') AS joined, p_name AS wrapped FROM part")
def process_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names through every mode of the dispatcher."""
    t, rows = functions(spark), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    of = lambda mode, **more: t.process(rows, mode, "p_name", **more)
    out = of("words").select("p_partkey", F.array_join("result", "|").alias("words"))
    for name, df in (("lines", of("lines", marker="|")), ("joined", of("join", delimiter="+")), ("wrapped", of("wrap", width=500))):
        out = out.join(df.select("p_partkey", F.col("result").alias(name)), "p_partkey")
    return out


@query("model_info", f"SELECT {len(APART)}::BIGINT AS words, {sum(APART.values())}::DOUBLE AS total_weight, 1::BIGINT AS bigrams, 'ok' AS status")
def model_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql.model_info(spark, TextFunctions(Lexicon.of(APART), bigrams=Bigrams.of([("กิน", "ข้าว", 3.0)])))


@query("sql_functions", "SELECT p_partkey, replace(p_name, ' ', '|') AS joined, length(p_name) AS width, len(string_split(p_name, ' '))::BIGINT AS n FROM part")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL functions and the table function, from SQL."""
    sql.register(spark, functions(spark), "cat_")
    view = f"part_{uuid.uuid4().hex}"
    table(spark, sf_dir, "part").createOrReplaceTempView(view)
    return spark.sql(f"""
        SELECT p_partkey, cat_join(p_name) AS joined, cat_display_width(p_name) AS width, n
        FROM {view} JOIN (SELECT p_partkey AS k, count(*) AS n FROM {view}, LATERAL cat_tokens(p_name) WHERE trim(token) <> '' GROUP BY p_partkey) ON p_partkey = k""")


WEIGHTED = {"ตา": 3000.0, "กลม": 3000.0, "ตากลม": 9000.0, "ของ": 9000.0, "ดี": 9000.0, "ของดี": 100.0, "ไป": 1.0, "กรมการกงสุล": 1.0}
cases("thai_words", [("ตากลม", "ตากลม"), ("ของดี", "ของ|ดี"), ("ไปกรมการกงสุล", "ไป|กรมการกงสุล")], lambda spark: TextFunctions(Lexicon.of(WEIGHTED)).join)
cases("thai_dual_lexicon_lines", [("ไปกรมการกงสุล", "ไป|กรม|การ|กงสุล")], lambda spark: lambda c: TextFunctions(Lexicon.of(["ไป", "กรมการกงสุล"]), Lexicon.of(["ไป", "กรม", "การ", "กงสุล"])).lines(c, "|"))
cases("thai_normalize", [("เเปลก", "แปลก"), ("นํ้า", "น้ำ"), ("นานาาา", "นานา"), ("มากๆๆๆ", "มากๆ"), ("คำ ่ที่สอง", "คำ ที่สอง"), ("ดีมากกกก", "ดีมาก")], lambda spark: functions(spark).normalize)
cases("thai_double_consonant", [("ดีมากก", "ดีมาก"), ("ต้นกก", "ต้นกก")], lambda spark: lambda c: TextFunctions(Lexicon.of(["มาก", "ดีมาก", "กก"])).normalize(c, check_lexicon=True))
cases("thai_cut_long_words", [("กรุงเทพมหานคร", "กรุง/เทพม/หานค/ร")], lambda spark: lambda c: TextFunctions(Lexicon.of(["กรุงเทพมหานคร"])).wrap(c, 4, cut_long_words=True, separator="/"))
cases("thai_clusters", [("เมื่อ", "6"), ("ยัง", "4"), ("ต้น", "4")], lambda spark: lambda c: (F.size(text.cluster_edges(c))).cast("string"))
cases("thai_bahttext", [("1001", "หนึ่งพันเอ็ดบาทถ้วน"), ("1234567.89", "หนึ่งล้านสองแสนสามหมื่นสี่พันห้าร้อยหกสิบเจ็ดบาทแปดสิบเก้าสตางค์")], lambda spark: lambda c: amounts.bahttext(F.col(c).cast("double")))
