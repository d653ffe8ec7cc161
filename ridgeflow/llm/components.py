"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, remove, scratch


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``(vertex, component)`` for the vertices of ``edges(a, b)``; a component is named by its smallest vertex.

    In each round every vertex points to its smallest neighbour or itself, two
    pointer jumps follow, and both edge ends are replaced by what they point
    to.  An edge to the own parent becomes an edge between two labels of the
    same component, so none is lost before all labels agree.  Each round is
    written to the shared scratch folder: a lost executor costs one round, and
    what is no longer read is deleted.

    Vertices are of any type with an order.  Defined results: an edge with a null
    end, or with equal ends, counts as none; repeated edges count once; an empty
    table gives an empty table.
    """

    paths: dict[str, list[str]] = {}

    def kept(df: DataFrame, what: str) -> DataFrame:
        path = scratch(spark, f"components-{what}")
        df.write.parquet(path)
        own = paths.setdefault(what, [])
        for old in own:  # the new table is written, so what it was made of is done with
            remove(spark, old)
        paths[what] = [path]
        if what == "edges":
            release(spark)
        return spark.read.parquet(path)

    edges = kept(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        ends = edges.union(edges.select("b", "a"))
        near = kept(ends.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), F.least("a", "p").alias("p")), "near")
        parent = near
        for _ in range(2):
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("v", F.col("pp").alias("p"))
        parent = kept(parent, "parent")
        if labels is None:
            labels = kept(parent.select(F.col("v").alias("vertex"), F.col("p").alias("component")), "labels")
        else:
            step = parent.select(F.col("v").alias("component"), "p")
            labels = kept(labels.join(step, "component", "left").select("vertex", F.coalesce("p", "component").alias("component")), "labels")
        to_a, to_b = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        moved = edges.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        edges = kept(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.toDF("vertex", "component")
    for what in ("edges", "near", "parent"):
        remove(spark, paths[what][0])
    return labels
