"""Connected components of a graph of edges, by alternating star contractions.

Each round joins every edge with the smallest neighbour of its ends: a map-side aggregated minimum,
written as a table of its own, so that in the join Spark can split a node with very many edges. The
edges of a round are written to the shared folder, those of the round before are deleted; lineage
stays short and no edge list reaches the driver. Edges shrink to one star per component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.shared import fresh_path, remove, written, written_small

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the node's smallest neighbour, or itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written_small(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    least = written_small(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """``u, root``: for every node with an edge but the smallest of its component, that smallest node.

    ``edges`` has the columns ``u`` and ``v``, in any direction and any number of times.
    """
    spark, path = edges.sparkSession, fresh_path(edges.sparkSession, "edges")
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", path)
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        before, path = path, fresh_path(spark, "edges")
        large = written(_large_star(edges), "large-star")
        edges = written(_small_star(large), "edges", path)
        remove(spark, before)
        previous, state = state, _state(edges)
        if state == previous:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select("u", F.col("v").alias("root"))
