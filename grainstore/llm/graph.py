"""Connected components by alternating star contractions, with lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainstore.session import written


def components(pairs: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the component is its least node. ``pairs`` holds undirected edges; loops are ignored.

    Each round links every node's larger neighbours to its least neighbour (large star), then its smaller ones to the
    least (small star); rounds are logarithmic in the size of a component. Edges are minima per node, aggregated
    before the shuffle, so a hub's neighbours are never gathered.
    """
    edges = written(
        pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "components"
    )
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        fresh = written(small, "components")
        same = fresh.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(fresh, ["u", "v"], "left_anti").isEmpty()
        edges = fresh
        if same:
            break
    else:
        raise RuntimeError(f"no fixpoint within {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
