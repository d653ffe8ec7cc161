"""Reports: weighted summaries, histograms, samples, identifiers, pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summarize_parts(df: DataFrame, key: str = "stroke_id") -> DataFrame:
    """Dominant surface and name, lighting and ways of each stroke from its parts by length.

    Two levels: lengths by value are summed before the shuffle, then the best
    value of each stroke is a plain aggregate.
    """
    def best(column: str) -> DataFrame:
        sums = df.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.sum("length").alias("w"))
        return sums.groupBy(key).agg(F.min_by(column, F.struct(-F.col("w"), column)).alias(column), F.max("w").alias(f"{column}_w"))

    whole = df.groupBy(key).agg(
        F.sum("length").alias("total"),
        F.coalesce(F.sum(F.when(F.col("lit") == "yes", F.col("length"))), F.lit(0.0)).alias("yes"),
        F.coalesce(F.sum(F.when(F.col("lit") == "no", F.col("length"))), F.lit(0.0)).alias("no"),
        F.collect_set("way_id").alias("way_ids"),
    )
    lit = F.when(F.col("yes") / F.col("total") >= 0.9, "yes").when(F.col("yes") > 0, "partial").when(F.col("no") / F.col("total") >= 0.5, "no").otherwise("unknown")
    rows = whole.join(best("surface"), key, "left").join(best("name"), key, "left")
    name = F.when(F.col("name_w") / F.col("total") >= 0.5, F.col("name"))
    return rows.select(key, F.coalesce("surface", F.lit("unknown")).alias("surface"), name.alias("name"), lit.alias("lit"), "way_ids")


def report(df: DataFrame) -> DataFrame:
    """Count, kilometres and medians by kind."""
    return df.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.round(F.sum("length_m") / 1000, 6).alias("km"),
        F.median("length_m").alias("median_length_m"),
        F.median("score").alias("median_score"),
    )


def histograms(df: DataFrame) -> DataFrame:
    """Counts by kind of surfaces and of 0, 1, or 2 and more crossings, in one pass."""
    pairs = F.array(
        F.struct(F.lit("surface").alias("what"), F.col("surface").alias("value")),
        F.struct(F.lit("crossings").alias("what"), F.least(F.col("n_crossings"), F.lit(2)).cast("string").alias("value")),
    )
    return df.select("kind", F.explode(pairs).alias("x")).groupBy("kind", "x.what", "x.value").agg(F.count("*").alias("n"))


def stratified_sample(df: DataFrame, quota: int, stratum: str = "kind") -> DataFrame:
    """``quota`` rows of each stratum: the best flagged one, the best other with crossings, the rest evenly spread over the ranks.

    Ranks are a window by stratum; only the few picked ranks are joined back.
    """
    order = Window.partitionBy(stratum).orderBy(F.desc("score"), "id")
    ranked = df.withColumn("r", F.row_number().over(order))
    flagged = ranked.groupBy(stratum).agg(F.min(F.when(F.col("flagged"), F.col("r"))).alias("x"))
    ranked = ranked.join(flagged, stratum)
    not_x = F.col("r") != F.coalesce("x", F.lit(-1))
    crossing = ranked.groupBy(stratum).agg(F.min(F.when((F.col("n_crossings") > 0) & not_x, F.col("r"))).alias("y"))
    ranked = ranked.join(crossing, stratum)
    picked = ~not_x | (F.col("r") == F.coalesce("y", F.lit(-1)))
    rest = ranked.where(~picked).withColumn("k", F.row_number().over(order) - 1)
    rest = rest.withColumn("n", F.count("*").over(Window.partitionBy(stratum)))
    need = F.lit(quota) - F.col("x").isNotNull().cast("int") - F.col("y").isNotNull().cast("int")
    rest = rest.withColumn("need", need)
    # Rank k is the rounded image of j * (n - 1) / (need - 1) for some j in 0 ... need - 1.
    j = F.rint(F.col("k") * (F.col("need") - 1) / F.greatest(F.col("n") - 1, F.lit(1)))

    def image(v: Column) -> Column:
        return F.rint(v * (F.col("n") - 1) / F.greatest(F.col("need") - 1, F.lit(1)))

    near = reduce(lambda a, b: a | b, ((j + d).between(0, F.col("need") - 1) & (image(j + d) == F.col("k")) for d in (-1, 0, 1)))
    even = rest.where((F.col("need") > 0) & near)
    columns = df.columns
    return ranked.where(picked).select(columns).union(even.select(columns))


def assign_unique_ids(df: DataFrame, tie: str, column: str = "segment_id") -> DataFrame:
    """Colliding identifiers get the suffixes -2, -3, ... by falling score."""
    n = F.row_number().over(Window.partitionBy(column).orderBy(F.desc("score"), tie))
    return df.withColumn("_n", n).withColumn(column, F.when(F.col("_n") == 1, F.col(column)).otherwise(F.concat_ws("-", column, "_n"))).drop("_n")


def prune(df: DataFrame, removed: DataFrame, key: str = "stroke_id", way: str = "way_id") -> DataFrame:
    """Keys of which no way is removed."""
    gone = df.join(removed, way, "left_semi").select(key).distinct()
    return df.select(key).distinct().join(gone, key, "left_anti")


def compare(a: DataFrame, b: DataFrame, share: str = "share") -> DataFrame:
    """Length-weighted overlap of two runs (rows with ``length_m`` and ``share``), each way; 1 if a side is empty."""
    columns = (F.col("length_m"), F.col(share).alias("share"))
    rows = a.select(F.lit("kept").alias("side"), *columns).union(b.select(F.lit("found"), *columns))

    def side(name: str) -> Column:
        own = F.col("side") == name
        total = F.sum(F.when(own, F.col("length_m")))
        return F.coalesce(F.sum(F.when(own, F.col("length_m") * F.col("share"))) / F.when(total > 0, total), F.lit(1.0)).alias(name)

    return rows.agg(side("kept"), side("found"))
