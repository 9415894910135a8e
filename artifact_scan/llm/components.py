"""Distributed connected components by alternating stars.

Every round links each node's larger neighbours to the least node around it, then the
smaller ones (large-star and small-star of Kiveris et al., 2014), with aggregations and
joins only: no adjacency list is ever gathered.  Hubs are ordinary join keys: the least
neighbours are written before they are joined, as adaptive execution splits hot keys of a
join of plain shuffles only.  Each half round is written to the shared folder, so the plan
of a round never contains the rounds before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artifact_scan.llm.store import written


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node, loops and nulls dropped."""
    a, b = F.col("a"), F.col("b")
    return edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return _oriented(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.union(least))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node of its component.

    Nodes may be of any ordered type.  Loops, repeated edges and edges with a null end add
    nothing; an empty table gives an empty table.
    """
    edges = written(_oriented(edges.select("a", "b")), "edges")
    state = _state(edges)
    while state[0]:
        edges = written(_small_star(written(_large_star(edges), "large")), "small")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
