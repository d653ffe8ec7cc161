"""Detection as one operator: from raw samples to scored, unique, ordered stretches.

Whether a window is valid is decided once for every sample and target length,
in window expressions over the stroke: its length in samples is a column, since
the step of a stroke is its own, so the frame is a range of ``i / n`` one wide.
A window has no flat run that is too long if the last sample at which such a
run is complete lies before the window's own first possible one; that is a
running value, not a join.  Merging, cutting, trimming and all attributes then
take one join of stretches and samples by stroke.

Inputs: samples ``(stroke_id, i, d, x, y, z, structure)`` on a uniform grid,
parts ``(stroke_id, part, way_id, start_m, end_m, surface, lit, name, highway,
structure)`` and events ``(stroke_id, offset_m, kind)``.  Strokes without
samples have no stretches; strokes without parts or events keep theirs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scores import score_climb, score_flat
from ..params import ClimbParams, FlatParams, Params, ProfileParams, samples_for
from . import profile as P
from .reports import assign_unique_ids, summarize_parts
from .spatial import line_cells
from .suppress import greedy_keep, kept_table

_KEY = ["stroke_id", "kind", "sign", "start", "end"]
#: Lengths in metres of the steepest stretches.
STEEPEST_M = (100, 200, 400, 800, 1000)


@dataclass(frozen=True)
class Kind:
    """A kind of stretch in one direction."""

    name: str
    sign: int
    rules: FlatParams | ClimbParams

    @property
    def key(self) -> str:
        return f"{self.name}_{'up' if self.sign > 0 else 'down'}"


def kinds(params: Params) -> list[Kind]:
    return [Kind("flat", 1, params.flat), *(Kind(n, s, r) for n, r in (("climb", params.climb), ("long_climb", params.long_climb)) for s in (1, -1))]


def build_profile(samples: DataFrame, params: ProfileParams | None = None) -> DataFrame:
    """Samples with ``z`` filled and smoothed, ``grade`` and the masks of what was filled.

    Windows count in nominal steps; that of a stroke is shorter by less than
    one part in its number of samples.
    """
    params = params or ProfileParams()
    step = params.step_m
    rows = P.fill_profile(samples, params.max_gap_fill_m, math.floor(params.structure_margin_m / step + 1e-9)).drop("z")
    median = P.rolling_median(rows.withColumnRenamed("z_filled", "z"), samples_for(params.median_window_m, step))
    smooth = P.gaussian_smooth(median.withColumnRenamed("z_median", "z"), params.gaussian_sigma_m / step)
    rows = rows.drop("z_filled").join(smooth.withColumnRenamed("z_smooth", "z"), ["stroke_id", "i"])
    return P.local_grade(rows, samples_for(params.grade_base_m / 2, step))


def count_of(length_m: float) -> Column:
    """Intervals of a length on a stroke's own step, half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(F.lit(float(length_m)) / F.col("step"))).cast("long")


def with_steps(profile: DataFrame) -> DataFrame:
    """Samples with ``step`` and the last number ``hi`` of their stroke; single samples go."""
    rows = profile.withColumn("step", F.max(F.when(F.col("i") == 1, F.col("d"))).over(P.whole())).withColumn("hi", F.max("i").over(P.whole()))
    return rows.where("hi >= 1 AND step > 0")


def window_of(rows: DataFrame, length_m: float, *carried: str) -> DataFrame:
    """Samples with ``w``: mean and largest grade, sinuosity, whether a height or grade is missing, and ``carried`` at the end, of the window that starts there.

    ``w`` is null where the stroke ends before the window.
    """
    over = "OVER (PARTITION BY stroke_id ORDER BY i / _n RANGE BETWEEN CURRENT ROW AND 1.0000001D FOLLOWING)"
    ends = ("i", "d", "x", "y", "z", *carried)
    rows = rows.withColumn("_n", count_of(length_m))
    rows = rows.withColumns(
        {f"_e_{c}": F.expr(f"last({c}) {over}") for c in ends}
        | {"_most": F.expr(f"max(abs(grade)) {over}"), "_heights": F.expr(f"count(z) {over}"), "_grades": F.expr(f"count(grade) {over}")}
    )
    span, chord = F.col("_e_d") - F.col("d"), geo.hypot(F.col("_e_x") - F.col("x"), F.col("_e_y") - F.col("y"))
    w = F.struct(
        F.col("_n").alias("n"),
        (100 * (F.col("_e_z") - F.col("z")) / span).alias("mean"),
        F.col("_most").alias("most"),
        F.when(chord > 0, span / F.when(chord > 0, chord)).otherwise(F.lit(float("inf"))).alias("sinuosity"),
        (F.col("_heights") <= F.col("_n")).alias("no_height"),
        (F.col("_grades") <= F.col("_n")).alias("no_grade"),
        *(F.col(f"_e_{c}").alias(c) for c in carried),
    )
    rows = rows.withColumn("w", F.when(F.col("_e_i") - F.col("i") == F.col("_n"), w))
    return rows.drop("_n", "_most", "_heights", "_grades", *(f"_e_{c}" for c in ends))


def _too_flat(kind: Kind) -> Column:
    """A sample that doesn't climb enough; a missing grade doesn't."""
    return ~F.coalesce(kind.sign * F.col("grade") >= kind.rules.min_local_grade_pct, F.lit(False))


def _most_flat(kind: Kind) -> Column:
    """Samples that a flat run may have."""
    return F.floor((kind.rules.max_flat_stretch_m + 1e-9) / F.col("step"))


def _valid(kind: Kind) -> Column:
    rules, w = kind.rules, F.col("w")
    fine = ~w["no_height"] & (w["sinuosity"] <= rules.max_sinuosity)
    if isinstance(rules, FlatParams):
        fine = fine & ~w["no_grade"] & (F.abs(w["mean"]) <= rules.max_mean_grade_pct) & (w["most"] <= rules.max_local_grade_pct)
    else:
        late = F.coalesce(w[f"late_{kind.key}"] - F.col("i") < _most_flat(kind), F.lit(True))
        fine = fine & (kind.sign * w["mean"]).between(rules.min_mean_grade_pct, rules.max_mean_grade_pct) & late
    return F.coalesce(fine, F.lit(False))


def evaluated(profile: DataFrame, params: Params) -> DataFrame:
    """Samples with ``n_<target>`` and, for each kind and target, ``v_<kind>_<target>``: the window that starts here is valid."""
    rows, every = with_steps(profile), kinds(params)
    back = P.along().rowsBetween(Window.unboundedPreceding, 0)
    climbs = [k for k in every if k.name != "flat"]
    for kind in climbs:
        run = F.col("i") - F.coalesce(F.last(F.when(~_too_flat(kind), F.col("i")), True).over(back), F.lit(-1))
        rows = rows.withColumn("_run", run)
        rows = rows.withColumn(f"late_{kind.key}", F.last(F.when(F.col("_run") > _most_flat(kind), F.col("i")), True).over(back)).drop("_run")
    late = [f"late_{k.key}" for k in climbs]
    for target in sorted({t for k in every for t in k.rules.target_lengths_m}):
        rows = window_of(rows, target, *late)
        valid = {f"v_{k.key}_{target:.0f}": _valid(k) for k in every if target in k.rules.target_lengths_m}
        rows = rows.withColumns({f"n_{target:.0f}": count_of(target)} | valid).drop("w")
    return rows.drop(*late)


def stretches(samples: DataFrame, params: Params) -> DataFrame:
    """``(stroke_id, kind, sign, start, end)`` of ``evaluated`` samples: merged windows, climbs cut at flat runs and trimmed."""
    every = kinds(params)
    stride = count_of(params.window_step_m)

    def base(kind: Kind) -> Column:
        least = f"{min(kind.rules.target_lengths_m):.0f}"
        end = F.col("i") + F.col(f"n_{least}")
        counts = F.col(f"v_{kind.key}_{least}") & ((F.col("i") % stride == 0) | (end == F.col("hi")))
        return F.when(counts, F.struct(F.lit(kind.name).alias("kind"), F.lit(kind.sign).alias("sign"), F.col("i").alias("start"), end.alias("end")))

    windows = samples.select("stroke_id", F.explode(F.array_compact(F.array(*map(base, every)))).alias("w")).select("stroke_id", "w.*")
    merged = P.merge_intervals(windows, "stroke_id", "kind", "sign").select(*_KEY)
    flats = merged.where("kind = 'flat'")

    def by_kind(make) -> Column:
        value = F.lit(None)
        for k in every[1:]:
            value = F.when((F.col("kind") == k.name) & (F.col("sign") == k.sign), make(k)).otherwise(value)
        return value

    inside = merged.where("kind <> 'flat'").join(samples, "stroke_id").where("i BETWEEN start AND end")
    inside = inside.select(
        *_KEY, "i", by_kind(_too_flat).alias("flat"), by_kind(_most_flat).alias("most"), by_kind(lambda k: F.col(f"n_{min(k.rules.target_lengths_m):.0f}")).alias("least")
    )
    own = Window.partitionBy("stroke_id", "kind", "sign", "start")
    back = own.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = inside.withColumn("run", F.count_if(~F.col("flat")).over(back))
    length = F.count_if("flat").over(Window.partitionBy("stroke_id", "kind", "sign", "start", "run"))
    rows = rows.withColumn("cut", F.col("flat") & (length > F.col("most")))
    rows = rows.withColumn("piece", F.count_if("cut").over(back)).where("NOT cut AND NOT flat")
    pieces = rows.groupBy("stroke_id", "kind", "sign", "start", "piece").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.first("least").alias("least"))
    climbs = pieces.where("i1 - i0 >= least").select("stroke_id", "kind", "sign", F.col("i0").alias("start"), F.col("i1").alias("end"))
    return flats.union(climbs)


def steepest_of(heights: Column, step: Column, length_m: float) -> Column:
    """The largest mean grade over a length of heights in travel order; null if they are shorter."""
    n = F.greatest(F.lit(1), F.bround(F.lit(float(length_m)) / step)).cast("int")
    rest = F.size(heights) - n
    low, high = F.slice(heights, F.lit(1), F.greatest(rest, F.lit(0))), F.slice(heights, n + 1, F.greatest(rest, F.lit(0)))
    return F.when(rest > 0, F.array_max(F.zip_with(low, high, lambda a, b: 100 * (b - a) / (n * step))))


def _of_samples(found: DataFrame, samples: DataFrame, params: Params) -> DataFrame:
    """The attributes of stretches that come from their samples, in travel order."""
    inside = found.join(samples, "stroke_id").where("i BETWEEN start AND end")
    place = F.col("sign") * F.col("i")
    fits = {
        t: F.max(F.coalesce(sum_or((F.col("kind") == k.name) & (F.col("sign") == k.sign) & F.col(f"v_{k.key}_{t:.0f}") for k in kinds(params) if t in k.rules.target_lengths_m), F.lit(False)) & (F.col("i") + F.col(f"n_{t:.0f}") <= F.col("end")))
        for t in sorted({t for k in kinds(params) for t in k.rules.target_lengths_m})
    }
    at = {f"{c}{n}": by(c, place) for c in ("x", "y", "z") for n, by in ((0, F.min_by), (1, F.max_by))}
    rows = inside.groupBy(*_KEY).agg(
        F.min("d").alias("stroke_start_m"),
        F.max("d").alias("stroke_end_m"),
        F.first("step").alias("step"),
        *(c.alias(n) for n, c in at.items()),
        F.max(F.abs("grade")).alias("grade_max_pct"),
        F.stddev_pop("grade").alias("grade_std"),
        F.array_sort(F.collect_list(F.struct(place.alias("p"), "z"))).alias("heights"),
        *(F.bool_or(f"{m}_mask").alias(m) for m in ("bridge", "tunnel", "gap")),
        F.array_compact(F.array(*(F.when(c, F.lit(round(t))) for t, c in fits.items()))).alias("fits_targets_m"),
    )
    rows = rows.withColumn("heights", F.col("heights.z")).withColumn("length_m", F.col("stroke_end_m") - F.col("stroke_start_m"))
    chord = geo.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    gain = P.gain_loss(F.col("heights"), params.profile.gain_hysteresis_m)
    flags = (("bridge", "bridge_interpolated"), ("tunnel", "tunnel_interpolated"), ("gap", "gap_filled"))
    return rows.withColumns(
        {
            "elev_start_m": F.col("z0"),
            "elev_end_m": F.col("z1"),
            "elev_gain_m": gain["gain"],
            "elev_loss_m": gain["loss"],
            "grade_mean_pct": 100 * (F.col("z1") - F.col("z0")) / F.col("length_m"),
            "sinuosity": F.when(chord > 1e-9, F.col("length_m") / F.when(chord > 1e-9, chord)).otherwise(F.lit(float("inf"))),
            "quality_flags": F.array_compact(F.array(*(F.when(F.col(c), F.lit(name)) for c, name in flags))),
        }
        | {f"steep_{n}_pct": F.when(F.col("kind") != "flat", steepest_of(F.col("heights"), F.col("step"), n)) for n in STEEPEST_M}
    ).drop("heights", "bridge", "tunnel", "gap", "z0", "z1")


def sum_or(conditions) -> Column:
    """Any of some conditions."""
    found = F.lit(False)
    for c in conditions:
        found = found | c
    return found


def _of_parts(found: DataFrame, parts: DataFrame) -> DataFrame:
    """Dominant attributes by overlap, roads by falling length and ways in travel order."""
    overlap = F.least("end_m", "stroke_end_m") - F.greatest("start_m", "stroke_start_m")
    rows = found.select("uid", "stroke_id", "sign", "stroke_start_m", "stroke_end_m").join(parts, "stroke_id").withColumn("length", overlap).where("length > 0")
    main = summarize_parts(rows, "uid").drop("way_ids")
    roads = rows.where("highway IS NOT NULL").groupBy("uid", "highway").agg(F.sum("length").alias("w"))
    roads = roads.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "highway"))).alias("r"))
    ways = rows.groupBy("uid", "sign", "way_id").agg(F.min("part").alias("part"))
    ways = ways.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct((F.col("part") * F.col("sign")).alias("p"), "way_id"))).alias("w"))
    built = rows.groupBy("uid").agg(F.bool_or(F.col("structure").isNotNull()).alias("on_structure"))
    out = main.join(built, "uid").join(ways, "uid").join(roads, "uid", "left")
    return out.select("uid", "surface", "lit", "name", F.coalesce(F.col("r.highway"), F.array().cast("array<string>")).alias("highways"), F.col("w.way_id").alias("osm_way_ids"), "on_structure")


def segments(found: DataFrame, samples: DataFrame, parts: DataFrame, events: DataFrame, params: Params) -> DataFrame:
    """Stretches with all attributes, scores and identifiers; descending climbs are turned round."""
    rows = _of_samples(found, samples, params).withColumn("uid", F.concat_ws("|", "kind", "stroke_id", "sign", "start"))
    rows = kept_table(rows, "stretches")
    inside = rows.select("uid", "stroke_id", "stroke_start_m", "stroke_end_m").join(events.withColumnRenamed("kind", "event"), "stroke_id")
    inside = inside.where("offset_m > stroke_start_m AND offset_m < stroke_end_m")
    met = inside.groupBy("uid").agg(F.count_if(F.col("event") == "crossing").alias("n_crossings"), F.count_if(F.col("event") == "junction").alias("n_junctions"))
    rows = rows.join(_of_parts(rows, parts), "uid", "left").join(met, "uid", "left")
    rows = rows.fillna({"n_crossings": 0, "n_junctions": 0, "surface": "unknown", "lit": "unknown", "on_structure": False})
    none = F.array()
    rows = rows.withColumns({"highways": F.coalesce("highways", none.cast("array<string>")), "osm_way_ids": F.coalesce("osm_way_ids", none.cast("array<long>"))})
    shared = (F.col("sinuosity"), F.col("n_crossings"), F.col("length_m"), F.col("surface"), F.col("lit"), F.size("fits_targets_m"))
    flat = score_flat(F.col("grade_mean_pct"), F.col("grade_max_pct"), *shared, params.flat)
    climb, long = (score_climb(F.col("grade_mean_pct"), F.col("grade_std"), *shared, p) for p in (params.climb, params.long_climb))
    score = F.when(F.col("kind") == "flat", flat).when(F.col("kind") == "climb", climb).otherwise(long)
    named = geo.stable_id(F.col("kind"), *(F.col(c) for c in ("x0", "y0", "x1", "y1", "length_m")))
    return rows.withColumn("score", score).withColumn("segment_id", named)


def suppressed(found: DataFrame, samples: DataFrame, params: Params) -> DataFrame:
    """Without stretches of which a better one of the same kind, which itself stays, covers more than the allowed share."""
    buffer = params.dedup.buffer_m
    cell = max(buffer, 100.0)
    rank = F.struct((-F.col("score")).alias("s"), "stroke_id", (-F.col("sign")).alias("t"), "start")
    points = found.select("uid", "kind", "stroke_id", "start", "end", rank.alias("rank")).join(samples.select("stroke_id", "i", "x", "y"), "stroke_id").where("i BETWEEN start AND end")
    order = Window.partitionBy("uid").orderBy("i")
    pieces = points.withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.lead("x").over(order), "y1": F.lead("y").over(order)}).where("x1 IS NOT NULL")
    pieces = line_cells(pieces, cell, buffer).select(F.col("uid").alias("better"), F.col("rank").alias("best"), "kind", "x0", "y0", "x1", "y1", "cx", "cy")
    asked = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    near = asked.join(pieces, ["kind", "cx", "cy"]).where("best < rank")
    near = near.where(geo.point_segment_distance(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) <= buffer)
    covered = near.select(F.col("uid").alias("worse"), "better", "i", "start", "end").distinct().groupBy("worse", "better").agg(F.count("*").alias("c"), F.first(F.col("end") - F.col("start") + 1).alias("n"))
    conflicts = covered.where(F.col("c") > params.dedup.max_overlap * F.col("n")).select("better", "worse")
    kept = greedy_keep(found.select(F.col("uid").alias("id")), conflicts)
    return found.join(kept.withColumnRenamed("id", "uid"), "uid", "left_semi")


def detect_all(samples: DataFrame, parts: DataFrame, events: DataFrame, params: Params | None = None) -> DataFrame:
    """All flat stretches, climbs and long climbs, suppressed, uniquely named and ordered by kind, falling score and identifier."""
    params = params or Params()
    profile = kept_table(build_profile(samples, params.profile), "profile")
    known = kept_table(evaluated(profile, params), "windows")
    found = kept_table(segments(stretches(known, params), known, parts, events, params), "segments")
    unique = assign_unique_ids(suppressed(found, known, params), "uid")
    return unique.drop("uid", "grade_std", "step", "x0", "y0", "x1", "y1").orderBy("kind", F.desc("score"), "segment_id")
