"""Connected components by alternating large-star and small-star passes.

Every pass is a minimum per node, combined before its shuffle, and a join that adaptive execution may
split when one node has most of the edges. Nothing is gathered per node or sent to the driver. Passes end
when the edges are stars around the smallest nodes, which takes no further pass to see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import cut, shuffles_dropped, with_totals


def _settled(e: DataFrame) -> bool:
    """Whether each node is the larger end of one edge or the smaller end of all its edges."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return not nodes.agg(F.count_if(F.expr("up > 1 or (up > 0 and least = 0)"))).first()[0]


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of it and its neighbours: no more rows than edges."""
    both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
    return with_totals(e, least, "v").select("u", F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of these."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    ends = with_totals(e, least, "u").select(F.explode(F.array(
        F.struct(F.col("u"), F.col("m").alias("v")),
        F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
    )).alias("e")).select("e.*")
    return ends.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node of its component.

    Edges with a null end and loops are dropped; repeated edges count once; no edges give no rows."""
    with shuffles_dropped(edges.sparkSession):
        e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
        e = cut(e.where("x <> y").select("u", "v").distinct())
        while not _settled(e):
            e = cut(_small_star(_large_star(e)))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
