"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorikeet.llm.common import drop_path, scratch_path


def _min_neighbour(both: DataFrame, used: list[str]) -> DataFrame:
    """(w, m): of each node the least of itself and its neighbours. Written, so that
    the join with the edges shuffles both sides and adaptive execution can split
    the rows of a hub; behind an aggregate they would stay in one task."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    path = scratch_path(both.sparkSession, "stars")
    least.write.parquet(path)
    used.append(path)
    return both.sparkSession.read.parquet(path)


def _large_star(edges: DataFrame, used: list[str]) -> DataFrame:
    """Every larger neighbour of u is hung on u's least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_min_neighbour(both, used), F.col("u") == F.col("w"))
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, used: list[str]) -> DataFrame:
    """u and its smaller neighbours are hung on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_min_neighbour(down, used), F.col("u") == F.col("w"))
    hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        joined.select("u", F.col("m").alias("v"))
    )
    return hung.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node
    that it reaches.

    Each round writes its edges to the shared scratch folder and drops the round
    before, so lineage stays short and nothing of the graph reaches the driver
    but a count and a checksum. The graph has settled when a round changes
    nothing: it is then a set of stars on the least nodes. Null ends and loops
    are ignored; an empty table gives an empty table.
    """
    spark = edges.sparkSession
    old = scratch_path(spark, "components")  # written first, or the edges would be made again at each use
    edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct().write.parquet(old)
    current, before = spark.read.parquet(old), None
    while True:
        path = scratch_path(spark, "components")
        used = [old]
        _small_star(_large_star(current, used), used).write.parquet(path)
        current = spark.read.parquet(path)
        state = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.hash("v", "u").cast("long"))
        ).first()
        for done in used:
            drop_path(spark, done)
        if state == before:
            break
        before, old = state, path
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)
