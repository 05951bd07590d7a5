"""Connected components of an edge list, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khamkit.llm.common import Tables, hot_joined

#: Labels of a graph with at most so many ends of edges are broadcast (16 bytes each).
FEW = 400_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Each round takes the smallest label of the neighbours, then follows labels
    twice, so a path of n nodes needs about log n rounds. Labels are cut from
    their lineage by a table each round; the driver sees only counts. Nodes with
    very many edges, and roots with very many nodes, are not shuffled.
    """
    tables = Tables(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = tables.held(both.where("a <> b").distinct(), "both")
    total = both.count()
    labels = tables.held(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"), F.count(F.lit(1)).alias("n")), "0")
    turn = 0
    while True:
        known = labels.select(F.col("node").alias("b"), "root", "n")
        told = both.join(F.broadcast(known), "b") if total <= FEW else hot_joined(both, known, "b", "n", total)
        heard = told.groupBy("a").agg(F.min("root").alias("heard"))
        best = labels.join(heard, labels.node == heard.a).select("node", "n", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        for hop in "ab":
            best = followed(best, labels, total, tables, f"{turn}{hop}")
        turn += 1
        # A small graph needs few files.
        now = tables.held(best.coalesce(1 + total // 50_000) if total <= FEW else best, str(turn))
        settled = now.where("old <> root").isEmpty()
        for done in (str(turn - 1), *(f"{turn - 1}{hop}{part}" for hop in "ab" for part in ("", "hop"))):
            tables.drop(done)
        if settled:
            tables.drop("both")
            return now.select("node", "root")
        labels = now.select("node", "root", "n")


def followed(best: DataFrame, labels: DataFrame, total: int, tables: Tables, name: str) -> DataFrame:
    """``best`` with the label of each root for the root."""
    hop = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
    if total <= FEW:
        both = best.join(F.broadcast(hop), "root")
    else:
        best = tables.held(best, name)
        hop = tables.held(best.groupBy("root").agg(F.count(F.lit(1)).alias("m")).join(hop, "root"), f"{name}hop")
        both = hot_joined(best, hop, "root", "m", total)
    return both.select("node", "n", "old", F.least("root", "next").alias("root"))
