"""Stable identifiers between two published versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spatial import coverage
from .suppress import greedy_match


def pairs(current: DataFrame, previous: DataFrame, buffer_m: float = 10.0, step: float = 5.0) -> DataFrame:
    """``(cur, prev, cur_share, prev_share)`` of lines of the same kind that cover each other in part."""
    there = coverage(current, previous, buffer_m, step).toDF("cur", "prev", "cur_share")
    back = coverage(previous, current, buffer_m, step).toDF("prev", "cur", "prev_share")
    return there.join(back, ["cur", "prev"])


def match(found: DataFrame, match_min: float = 0.8) -> DataFrame:
    """``(cur, prev)``: best first, one to one, by the smaller share, then the larger, then identifiers."""
    low, high = F.least("cur_share", "prev_share"), F.greatest("cur_share", "prev_share")
    # A struct as rank: no global numbering, so no single task.
    rank = F.struct((-low).alias("l"), (-high).alias("h"), "cur", "prev")
    good = found.where(low >= match_min).select(F.col("cur").alias("a"), F.col("prev").alias("b"), rank.alias("rank"))
    return greedy_match(good).toDF("cur", "prev")


def aliases(found: DataFrame, matched: DataFrame, alias_min: float = 0.3) -> DataFrame:
    """``(prev, cur)``: where an identifier that isn't kept leads; the best covering line, the first on ties."""
    lost = found.where(F.col("prev_share") >= alias_min).join(matched, "prev", "left_anti")
    return lost.groupBy("prev").agg(F.min_by("cur", F.struct(-F.col("prev_share"), "cur")).alias("cur"))


def redirects(previous: DataFrame, matched: DataFrame, alias: DataFrame, earlier: DataFrame) -> DataFrame:
    """``(id, target)``: of identifiers not kept (null: retired), and of earlier redirects ``(id, target)``, followed one step."""
    lost = previous.select("id").join(matched.select(F.col("prev").alias("id")), "id", "left_anti")
    now = lost.join(alias.select(F.col("prev").alias("id"), F.col("cur").alias("target")), "id", "left")
    kept = matched.select(F.col("prev").alias("target"), F.col("cur").alias("kept_as"))
    again = now.select(F.col("id").alias("target"), F.col("target").alias("next"))
    old = earlier.join(kept, "target", "left").join(again, "target", "left")
    return now.union(old.select("id", F.coalesce("kept_as", "next").alias("target")))


def resolve(index: DataFrame) -> DataFrame:
    """``(id, status, target)`` of index entries ``(id, live, target)``."""
    status = F.when(F.col("live"), "live").when(F.col("target").isNotNull(), "moved").otherwise("retired")
    return index.select("id", status.alias("status"), F.when(F.col("live"), F.col("id")).otherwise(F.col("target")).alias("target"))


def free_suffix(new: DataFrame, taken: DataFrame) -> DataFrame:
    """``(row, id)``: wanted identifiers ``(row, id)`` with the smallest suffix -2, -3, ... that nobody has.

    Taken suffixes are numbers of the base identifier, so the free ones are
    found by rank among the numbers that are left, without trying.
    """
    base = lambda c: F.regexp_extract(c, r"^([a-z_]+-[0-9a-f]+)", 1)
    number = F.coalesce(F.regexp_extract("id", r"^[a-z_]+-[0-9a-f]+-([0-9]+)$", 1).try_cast("int"), F.lit(1))
    used = taken.select(base(F.col("id")).alias("base"), number.alias("n")).distinct().groupBy("base").agg(F.array_sort(F.collect_set("n")).alias("used"))
    order = F.row_number().over(Window.partitionBy("base").orderBy("row"))
    rows = new.select("row", base(F.col("id")).alias("base")).withColumn("k", order).join(used, "base", "left")
    used_here = F.coalesce("used", F.array().cast("array<int>"))
    free = F.array_except(F.sequence(F.lit(1), F.col("k") + F.size(used_here)), used_here)
    n = F.element_at(free, F.col("k"))
    return rows.select("row", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n)).alias("id"))
