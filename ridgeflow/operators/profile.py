"""Operators on long tables of samples ``(stroke_id, i, d, z, ...)``.

Every stroke is one window partition; all steps of a profile share that
partitioning, so Spark shuffles the samples once.  Missing heights are null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along() -> WindowSpec:
    """The samples of a stroke in order."""
    return Window.partitionBy("stroke_id").orderBy("i")


def whole() -> WindowSpec:
    return Window.partitionBy("stroke_id")


def runs(df: DataFrame, flag: Column, name: str = "run") -> DataFrame:
    """Number the maximal runs of rows with equal ``flag`` along each stroke."""
    changed = F.coalesce((flag != F.lag(flag).over(along())).cast("int"), F.lit(0))
    return df.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(along())).drop("_changed")


def fill_profile(df: DataFrame, max_gap_m: float = 20.0, margin_samples: int = 0) -> DataFrame:
    """Interpolate masked heights: ``structure`` names what masks a sample, else null.

    ``margin_samples`` samples on either side of a structure are masked with it.

    A run of missing samples that touches no end is filled if it crosses a
    structure or its neighbours are at most ``max_gap_m`` apart.
    """
    if margin_samples:
        frame = along().rowsBetween(-margin_samples, margin_samples)
        df = df.withColumn("structure", F.coalesce("structure", F.min("structure").over(frame)))
    masked = df.withColumn("z_in", F.when(F.col("structure").isNull(), F.col("z")))
    masked = runs(masked, F.col("z_in").isNull())
    run = Window.partitionBy("stroke_id", "run")
    before = along().rowsBetween(Window.unboundedPreceding, 0)
    after = along().rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("z_in").isNotNull(), F.struct("d", "z_in"))
    masked = masked.withColumn("_l", F.last(known, True).over(before)).withColumn("_r", F.first(known, True).over(after))
    masked = masked.withColumn("_on", F.max(F.col("structure").isNotNull()).over(run))
    share = (F.col("d") - F.col("_l.d")) / (F.col("_r.d") - F.col("_l.d"))
    fill = F.col("z_in").isNull() & (F.col("_on") | (F.col("_r.d") - F.col("_l.d") <= max_gap_m))
    value = F.col("_l.z_in") + (F.col("_r.z_in") - F.col("_l.z_in")) * share
    out = masked.withColumn("z_filled", F.when(fill, value).otherwise(F.col("z_in")))
    filled = F.col("z_in").isNull() & F.col("z_filled").isNotNull()
    out = out.withColumn("bridge_mask", filled & F.coalesce(F.col("structure") == "bridge", F.lit(False)))
    out = out.withColumn("tunnel_mask", filled & F.coalesce(F.col("structure") == "tunnel", F.lit(False)))
    out = out.withColumn("gap_mask", filled & F.col("structure").isNull())
    return out.drop("z_in", "run", "_l", "_r", "_on")


def reflected(df: DataFrame, pad: int, value: str = "z") -> DataFrame:
    """The samples and ``pad`` odd reflections ``2 z(end) - z`` on either side of each stroke, as ``(stroke_id, n, i, v, own)``.

    A stroke shorter than the pad is reflected again and again: seen from
    outside, it repeats every ``2 n`` samples, each time higher by twice the
    rise from its first to its last sample.  ``own`` marks real samples that
    are not missing; a single sample goes on as a constant.
    """
    ends = along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.withColumn("n", F.max("i").over(whole()).cast("int")).withColumn("z0", F.first(value).over(ends)).withColumn("z1", F.last(value).over(ends))
    rows = rows.select("stroke_id", "n", F.col("i").cast("int").alias("i"), F.col(value).alias("z"), "z0", "z1")
    rows = rows.withColumn("period", F.greatest(2 * F.col("n"), F.lit(1)))
    turns = F.ceil((F.lit(pad) + F.col("n")) / F.col("period")).cast("int")
    rise = 2 * (F.col("z1") - F.col("z0"))

    def same(m: Column) -> Column:
        return F.struct((F.col("i") + m * F.col("period")).alias("i"), F.when(m == 0, F.col("z")).otherwise(F.col("z") + m * rise).alias("v"), ((m == 0) & F.col("z").isNotNull()).alias("own"))

    def mirrored(m: Column) -> Column:
        return F.struct((m * F.col("period") - F.col("i")).alias("i"), (2 * F.col("z0") - F.col("z") + m * rise).alias("v"), F.lit(False).alias("own"))

    every = F.sequence(-turns, turns)
    inner = (F.col("i") > 0) & (F.col("i") < F.col("n"))
    copies = F.concat(F.transform(every, same), F.when(inner, F.transform(every, mirrored)).otherwise(F.array().cast("array<struct<i:int,v:double,own:boolean>>")))
    near = F.filter(copies, lambda x: (x["i"] >= -pad) & (x["i"] <= F.col("n") + pad))
    # Samples far from both ends have no copy, and build no array.
    far = (F.col("i") > pad) & (F.col("i") < F.col("n") - pad)
    return rows.select("stroke_id", "n", F.explode(F.when(far, F.array(same(F.lit(0)))).otherwise(near)).alias("x")).select("stroke_id", "n", "x.*")


def rolling_median(df: DataFrame, window: int) -> DataFrame:
    """``(stroke_id, i, z_median)``: median of an odd window of samples, missing ones left out; a missing sample stays missing."""
    half = (window | 1) // 2
    frame = along().rowsBetween(-half, half)
    out = reflected(df, half).withColumn("z_median", F.percentile("v", F.lit(0.5)).over(frame))
    return out.where("i BETWEEN 0 AND n").select("stroke_id", "i", F.when(F.col("own"), F.col("z_median")).alias("z_median"))


def gaussian_smooth(df: DataFrame, sigma: float) -> DataFrame:
    """``(stroke_id, i, z_smooth)``: weights ``exp(-(k / sigma)^2 / 2)`` up to three sigma, renormalised on present samples; a missing sample stays missing."""
    radius = math.ceil(3 * sigma)
    padded = reflected(df, radius)
    value = weight = F.lit(0.0)
    for k in range(-radius, radius + 1):
        w = math.exp(-0.5 * (k / sigma) ** 2)
        v = F.col("v") if k == 0 else F.lead("v", k).over(along()) if k > 0 else F.lag("v", -k).over(along())
        value = value + F.coalesce(v, F.lit(0.0)) * w
        weight = weight + F.when(v.isNotNull(), w).otherwise(0.0)
    out = padded.withColumn("_v", value).withColumn("_w", weight)
    return out.where("i BETWEEN 0 AND n").select("stroke_id", "i", F.when(F.col("own"), F.col("_v") / F.col("_w")).alias("z_smooth"))


def local_grade(df: DataFrame, half: int = 2, value: str = "z") -> DataFrame:
    """Add ``grade``: centred difference in percent, clipped at the ends."""
    frame = along().rowsBetween(-half, half)
    rise = F.last(value).over(frame) - F.first(value).over(frame)
    run = F.last("d").over(frame) - F.first("d").over(frame)
    return df.withColumn("grade", F.when(run > 0, 100 * rise / run))


def sliding_windows(df: DataFrame, n: int, value: str = "z") -> DataFrame:
    """``(stroke_id, start, end, mean_grade, max_grade)`` of all full windows of n intervals without missing samples."""
    frame = along().rowsBetween(0, n)
    rows = df.select(
        "stroke_id",
        F.col("i").alias("start"),
        (F.col("i") + n).alias("end"),
        (100 * (F.last(value).over(frame) - F.col(value)) / (F.last("d").over(frame) - F.col("d"))).alias("mean_grade"),
        F.max(F.abs("grade")).over(frame).alias("max_grade"),
        F.count("grade").over(frame).alias("_n"),
    )
    return rows.where(F.col("_n") == n + 1).drop("_n")


def strided(df: DataFrame, stride: int) -> DataFrame:
    """Windows at every ``stride``-th start; the last window of a stroke always counts."""
    last = F.max("start").over(whole())
    return df.withColumn("_last", last).where((F.col("start") % stride == 0) | (F.col("start") == F.col("_last"))).drop("_last")


def merge_intervals(df: DataFrame, *keys: str) -> DataFrame:
    """Union of closed intervals ``(start, end)`` by key; touching ones merge."""
    keys = keys or ("stroke_id",)
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def true_runs(df: DataFrame, flag: Column, *keys: str) -> DataFrame:
    """``(keys, run_start, run_stop)`` of maximal stretches where ``flag`` holds; the stop is exclusive."""
    keys = keys or ("stroke_id",)
    order = Window.partitionBy(*keys).orderBy("i")
    rows = df.where(flag).select(*keys, "i", (F.col("i") - F.row_number().over(order)).alias("_island"))
    return rows.groupBy(*keys, "_island").agg(F.min("i").alias("run_start"), (F.max("i") + 1).alias("run_stop")).drop("_island")


def longest_run_in_windows(windows: DataFrame, stretches: DataFrame, *keys: str) -> DataFrame:
    """Windows with ``longest``: samples of the longest stretch inside ``[start, end]``, by key and overlap."""
    keys = keys or ("stroke_id",)
    ids = [*keys, "start", "end"]
    overlap = F.least(F.col("run_stop"), F.col("end") + 1) - F.greatest(F.col("run_start"), F.col("start"))
    inside = windows.select(*ids).join(stretches, list(keys)).where((F.col("run_start") <= F.col("end")) & (F.col("run_stop") > F.col("start")))
    found = inside.groupBy(*ids).agg(F.max(overlap).alias("longest"))
    return windows.join(found, ids, "left").withColumn("longest", F.coalesce("longest", F.lit(0)))


def split_at_long_runs(stretches: DataFrame, flat_runs: DataFrame, max_samples: int, *keys: str) -> DataFrame:
    """Cut stretches ``(start, end)`` around flat runs longer than ``max_samples``; one-sample pieces go."""
    keys = keys or ("stroke_id",)
    ids = [*keys, "start", "end"]
    clipped = stretches.join(flat_runs, list(keys)).where((F.col("run_start") <= F.col("end")) & (F.col("run_stop") > F.col("start")))
    clipped = clipped.select(*ids, F.greatest("run_start", "start").alias("a"), F.least(F.col("run_stop"), F.col("end") + 1).alias("b"))
    cuts = clipped.where(F.col("b") - F.col("a") > max_samples).groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("cuts"))
    rows = stretches.join(cuts, ids, "left")
    lows = F.concat(F.array("start"), F.coalesce(F.transform("cuts", lambda c: c["b"]), F.array().cast("array<bigint>")))
    highs = F.concat(F.coalesce(F.transform("cuts", lambda c: c["a"] - 1), F.array().cast("array<bigint>")), F.array("end"))
    pieces = rows.select(*keys, F.explode(F.arrays_zip(lows.alias("lo"), highs.alias("hi"))).alias("p"))
    return pieces.select(*keys, F.col("p.lo").alias("start"), F.col("p.hi").alias("end")).where("end > start")


def trim_flat_ends(pieces: DataFrame, steep: DataFrame, min_samples: int, *keys: str) -> DataFrame:
    """Shrink pieces to their first and last steep sample ``(keys, i)`` and keep those long enough."""
    keys = keys or ("stroke_id",)
    ids = [*keys, "start", "end"]
    inside = pieces.join(steep, list(keys)).where((F.col("i") >= F.col("start")) & (F.col("i") <= F.col("end")))
    out = inside.groupBy(*ids).agg(F.min("i").alias("i0"), F.max("i").alias("i1")).where(F.col("i1") - F.col("i0") >= min_samples)
    return out.select(*keys, F.col("i0").alias("start"), F.col("i1").alias("end"))


def gain_loss(values: Column, hysteresis: float) -> Column:
    """Struct of gain and loss of an array of heights in travel order, counted beyond a threshold."""
    h = F.lit(float(hysteresis))
    present = F.filter(values, lambda v: v.isNotNull())
    zero = F.struct(F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"), F.get(present, F.lit(0)).alias("ref"))

    def step(s: Column, v: Column) -> Column:
        diff = v - s["ref"]
        return F.struct(
            F.when(diff >= h, s["gain"] + diff).otherwise(s["gain"]).alias("gain"),
            F.when(diff <= -h, s["loss"] - diff).otherwise(s["loss"]).alias("loss"),
            F.when(F.abs(diff) >= h, v).otherwise(s["ref"]).alias("ref"),
        )

    def end(s: Column) -> Column:
        rest = F.coalesce(F.get(present, F.size(present) - 1) - s["ref"], F.lit(0.0))
        return F.struct(
            (s["gain"] + F.greatest(rest, F.lit(0.0))).alias("gain"),
            (s["loss"] + F.greatest(-rest, F.lit(0.0))).alias("loss"),
        )

    return F.aggregate(present, zero, step, end)


def steepest(df: DataFrame, lengths: tuple[int, ...], step_m: float = 5.0) -> DataFrame:
    """``(stroke_id, steep_<length>_pct)``: largest mean grade over each length; null if the stroke is shorter."""
    rows = df
    for length in lengths:
        n = max(1, round(length / step_m))
        rows = rows.withColumn(f"_s{length}", (F.lead("z", n).over(along()) - F.col("z")) * 100.0 / (n * step_m))
    return rows.groupBy("stroke_id").agg(*(F.max(f"_s{length}").alias(f"steep_{length}_pct") for length in lengths))
