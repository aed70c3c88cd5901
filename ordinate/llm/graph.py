"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinate.llm.shared import removed, small_or_shuffled, stored


EDGES_OF_A_FILE = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of edges (u, v), the component being its smallest node.

    Each round ties every node's larger neighbours to its smallest one, then the smaller ones too, until nothing changes.
    Neighbourhoods are only ever reduced to their minimum, never gathered; each round's edges are written to the shared folder
    and those of the round before deleted. Null ends and edges of a node to itself are none; repeated edges change nothing.
    """
    now, was = stored(_oriented(edges), "edges"), None
    files = max(1, now.count() // EDGES_OF_A_FILE)  # later rounds have no more edges
    while True:
        n = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if (n["n"], n["sum"]) == was or n["n"] == 0:
            break
        was = n["n"], n["sum"]
        larger = _round(_large, now, files)
        now = _round(_small, larger, files)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """u the larger node, v the smaller."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _round(star, edges: DataFrame, files: int) -> DataFrame:
    tied, least = star(edges, files)
    out = stored(tied.coalesce(files), "edges")
    removed(edges, least)
    return out


def _large(edges: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least")).coalesce(files), "least")
    tied = _oriented(both.where("v > u").join(small_or_shuffled(least), "u").select(F.col("v").alias("u"), F.col("least").alias("v")))
    return tied, least


def _small(edges: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    least = stored(edges.groupBy("u").agg(F.min("v").alias("least")).coalesce(files), "least")
    tied = edges.join(small_or_shuffled(least), "u")
    return _oriented(tied.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))), least
