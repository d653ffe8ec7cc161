"""Order-dependent selection as rounds over edge tables.

A greedy pass in a strict order equals the unique fixed point of: keep a row
when all better rows that conflict with it are dropped, drop it when one of
them is kept.  Each round decides at least every best undecided row; rounds
are written to the shared scratch folder, so that plans stay short and a lost
executor costs one round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``; on a local master that may be unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ridgeflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame, label: str) -> DataFrame:
    """Write to a scratch path and read again."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)


def replaced(df: DataFrame, label: str, old: DataFrame) -> DataFrame:
    """``kept_table`` of a round, after which the table ``old`` of the round before is deleted."""
    new = kept_table(df, label)
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in old.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    return new


def first_of_equal(rows: DataFrame, rank: Column, *same: str) -> DataFrame:
    """The best row by ``rank`` of those with equal values ``same``; rows with a null among these all stay.

    Where equal rows conflict with each other and with the same others, a greedy
    pass never keeps another of them: the best one, or what drops it, drops all.
    """
    known = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in same))
    best = rows.where(known).groupBy(*(F.col(c).alias(f"ridgeflow_{c}") for c in same)).agg(F.min_by(F.struct(*rows.columns), rank).alias("r")).select("r.*")
    return best.union(rows.where(~known))


def greedy_keep(rows: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The identifiers of ``rows(id)`` that a greedy pass keeps.

    ``conflicts(better, worse)``: keeping the better one drops the worse one.
    """
    undecided = kept_table(rows.select("id").distinct(), "undecided")
    edges = kept_table(conflicts.select("better", "worse").distinct(), "conflicts")
    kept = undecided.limit(0)
    while not undecided.isEmpty():
        blocked = edges.select(F.col("worse").alias("id")).distinct()
        keep = kept_table(undecided.join(blocked, "id", "left_anti"), "keep")
        drop = edges.join(keep.withColumnRenamed("id", "better"), "better", "left_semi").select(F.col("worse").alias("id")).distinct()
        drop = kept_table(drop.join(keep, "id", "left_anti"), "drop")
        gone = keep.union(drop)
        undecided = kept_table(undecided.join(gone, "id", "left_anti"), "undecided")
        # A dropped row blocks no other; a kept one has dropped its conflicts.
        edges = edges.join(gone.withColumnRenamed("id", "better"), "better", "left_anti").join(gone.withColumnRenamed("id", "worse"), "worse", "left_anti")
        edges = kept_table(edges, "conflicts")
        kept = kept.union(keep)
    return kept


def greedy_match(pairs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of ``pairs(a, b, rank)`` that a best-first one-to-one pass takes; ranks differ.

    A pair that is the best of both its ends is taken in any order; taking all
    such pairs and removing their ends, again and again, gives the same.
    """
    open_pairs = kept_table(pairs.select("a", "b", "rank"), "pairs")
    taken = open_pairs.limit(0)
    while not open_pairs.isEmpty():
        best_a = F.min("rank").over(Window.partitionBy("a"))
        best_b = F.min("rank").over(Window.partitionBy("b"))
        found = kept_table(open_pairs.withColumn("x", best_a).withColumn("y", best_b).where("rank = x AND rank = y").select("a", "b", "rank"), "matched")
        taken = taken.union(found)
        open_pairs = open_pairs.join(found.select("a"), "a", "left_anti").join(found.select("b"), "b", "left_anti").select("a", "b", "rank")
        open_pairs = kept_table(open_pairs, "pairs")
    return taken.select("a", "b")
