"""Operators on lines: grids, resampling, cutting, joining, tracks and circuits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import tags as T


def grid_size(length: Column, step: float) -> Column:
    """Intervals of a uniform grid whose step is no longer than asked."""
    return F.greatest(F.ceil(length / step - 1e-9), F.lit(1)).cast("int")


def vertices(df: DataFrame, *keys: str) -> DataFrame:
    """``(keys, pos, x, y, d)``: vertices of a ``line`` with the distance from its start."""
    rows = df.select(*keys, F.posexplode("line").alias("pos", "p")).select(*keys, "pos", "p.x", "p.y")
    order = Window.partitionBy(*keys).orderBy("pos")
    step = geo.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order))
    return rows.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("d", F.sum("_s").over(order)).drop("_s")


def _pieces(rows: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("pos")
    nxt = {f"{c}1": F.lead(c).over(order) for c in ("x", "y", "d")}
    return rows.withColumns(nxt).where("d1 > d")


def resample(df: DataFrame, step: float, *keys: str) -> DataFrame:
    """``(keys, k, n, d, x, y)``: points of the uniform grid along each line, ends included.

    A grid point finds its piece by the piece's own range of grid numbers, so
    nothing is compared pair by pair.
    """
    rows = vertices(df, *keys)
    total = F.max("d").over(Window.partitionBy(*keys))
    rows = _pieces(rows.withColumn("length", total).withColumn("n", grid_size(F.col("length"), step)), *keys)
    width = F.col("length") / F.col("n")
    # A point on a vertex belongs to the piece that starts there, the last one to the last piece.
    first = F.ceil(F.col("d") / width - 1e-9)
    last = F.when(F.col("d1") >= F.col("length") - 1e-9, F.col("n")).otherwise(F.ceil(F.col("d1") / width - 1e-9) - 1)
    rows = rows.withColumn("first", first.cast("int")).withColumn("last", last.cast("int")).where("first <= last")
    rows = rows.withColumn("k", F.explode(F.sequence("first", "last")))
    at = F.col("k") * F.col("length") / F.col("n")
    share = (at - F.col("d")) / (F.col("d1") - F.col("d"))
    x, y = (F.col(c) + (F.col(f"{c}1") - F.col(c)) * share for c in "xy")
    return rows.select(*keys, "k", "n", at.alias("d"), x.alias("x"), y.alias("y"))


def substring(df: DataFrame, start: Column, stop: Column, *keys: str) -> DataFrame:
    """``(keys, line)``: the part of each line between two distances, inner vertices kept."""
    rows = _pieces(vertices(df.withColumn("_a", start).withColumn("_b", stop), *keys, "_a", "_b"), *keys)
    rows = rows.where("d1 > _a AND d < _b")

    def at(v: Column) -> Column:
        share = (v - F.col("d")) / (F.col("d1") - F.col("d"))
        return F.struct(v.alias("d"), (F.col("x") + (F.col("x1") - F.col("x")) * share).alias("x"), (F.col("y") + (F.col("y1") - F.col("y")) * share).alias("y"))

    ends = F.array(at(F.greatest("d", "_a")), at(F.least("d1", "_b")))
    points = rows.select(*keys, F.explode(ends).alias("p")).groupBy(*keys).agg(F.collect_list("p").alias("ps"))
    by_place = F.array_sort("ps")
    apart = F.filter(by_place, lambda p, i: (i == 0) | (p["d"] - F.coalesce(F.get(by_place, i - 1)["d"], F.lit(-1.0)) > 1e-9))
    return points.select(*keys, F.transform(apart, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


def normals(points: DataFrame, *keys: str) -> DataFrame:
    """Points with unit normals ``nx, ny`` from centred differences, one-sided at the ends."""
    frame = Window.partitionBy(*keys).orderBy("k").rowsBetween(-1, 1)
    dx, dy = (F.last(c).over(frame) - F.first(c).over(frame) for c in "xy")
    norm = geo.hypot(F.col("_dx"), F.col("_dy"))
    rows = points.withColumn("_dx", dx).withColumn("_dy", dy).withColumn("_n", norm)
    unit = F.when(F.col("_n") > 0, F.col("_n"))
    return rows.withColumn("nx", -F.col("_dy") / unit).withColumn("ny", F.col("_dx") / unit).drop("_dx", "_dy", "_n")


def drop_inside(ways: DataFrame, inside: DataFrame, most: float = 0.5) -> DataFrame:
    """Ways ``(way_id, road_class, length)`` without those of which one area holds more than a share; major ways stay.

    ``inside`` is ``(way_id, area_id, length)``: what lies in each area, areas not added up.
    """
    share = inside.groupBy("way_id", "area_id").agg(F.sum("length").alias("in_m")).groupBy("way_id").agg(F.max("in_m").alias("in_m"))
    gone = ways.join(share, "way_id").where((F.col("road_class") != "major") & (F.col("in_m") > most * F.col("length"))).select("way_id")
    return ways.join(gone, "way_id", "left_anti")


def choose_source(main: DataFrame, fallback: DataFrame) -> DataFrame:
    """``(stroke_id, source)``: the fallback profile only where it leaves strictly fewer samples unfilled.

    Both are ``(stroke_id, z)``; strokes that the main one fills are not looked up in the other.
    """
    missing = lambda df, name: df.groupBy("stroke_id").agg(F.count_if(F.col("z").isNull()).alias(name))
    own = missing(main, "a")
    open_strokes = own.where("a > 0").select("stroke_id")
    other = missing(fallback.join(open_strokes, "stroke_id", "left_semi"), "b")
    better = F.coalesce(F.col("b") < F.col("a"), F.lit(False))
    return own.join(other, "stroke_id", "left").select("stroke_id", F.when(better, "fallback").otherwise("main").alias("source"))


def lateral_median(points: DataFrame) -> DataFrame:
    """``(id, z)``: the median of a sample and its two neighbours aside ``(id, side, z)``, missing ones left out."""
    return points.groupBy("id").agg(F.percentile("z", F.lit(0.5)).alias("z"))


def assemble(chain: DataFrame, edges: DataFrame, degrees: DataFrame, minor_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts and events of strokes from their edges in order.

    ``chain``: ``(e, stroke, pos, forward)``; ``edges``: ``(e, way_id, start_node, end_node, length)``.
    Consecutive edges of a way are one part; inner nodes of degree three and
    more are events, crossings if another edge there is minor.
    """
    order = Window.partitionBy("stroke").orderBy("pos")
    rows = chain.join(edges, "e")
    rows = rows.withColumn("out_node", F.when(F.col("forward"), F.col("end_node")).otherwise(F.col("start_node")))
    rows = rows.withColumn("stop", F.sum("length").over(order)).withColumn("start", F.col("stop") - F.col("length"))
    new = F.coalesce((F.col("way_id") != F.lag("way_id").over(order)).cast("int"), F.lit(1))
    rows = rows.withColumn("_new", new).withColumn("part", F.sum("_new").over(order) - 1)
    rows = rows.withColumn("_last", F.lead("e").over(order).isNull())
    parts = rows.groupBy("stroke", "part", "way_id").agg(F.min("start").alias("start_m"), F.max("stop").alias("end_m"))
    inner = rows.where("NOT _last").select("stroke", F.col("stop").alias("offset_m"), F.col("out_node").alias("node_id"))
    events = inner.join(degrees.where("degree >= 3"), "node_id").join(minor_nodes.select("node_id", F.lit(True).alias("minor")), "node_id", "left")
    kind = F.when(F.col("minor"), "crossing").otherwise("junction")
    return parts, events.select("stroke", "offset_m", "node_id", kind.alias("kind"))


def circuit_candidates(walks: DataFrame, least_m: float = 200.0, most_m: float = 2000.0) -> DataFrame:
    """Walks ``(walk, length, area, car_free)`` that can be circuits: length, compactness and car-free share in range."""
    compact = F.when(F.col("length") > 0, 4 * 3.141592653589793 * F.abs("area") / (F.col("length") * F.col("length"))).otherwise(0.0)
    rows = walks.withColumn("compactness", compact)
    return rows.where(F.col("length").between(least_m, most_m) & (F.col("compactness") >= 0.3) & (F.col("car_free") >= 0.6 * F.col("length")))


def max_local_grade(ring: DataFrame) -> DataFrame:
    """``(stroke_id, grade_max)``: the largest local grade on the middle lap of two; null if a height is missing.

    ``ring`` is a closed ring as samples ``(stroke_id, i, d, z)``, the last equal to the first.
    """
    from .profile import local_grade, whole

    size = F.max("i").over(whole())
    rows = ring.withColumn("n", size).withColumn("lap", F.max("d").over(whole()))
    again = rows.where("i > 0").select("stroke_id", (F.col("i") + F.col("n")).alias("i"), (F.col("d") + F.col("lap")).alias("d"), "z", "n", "lap")
    double = local_grade(rows.select("stroke_id", "i", "d", "z", "n", "lap").union(again))
    middle = double.where((F.col("d") >= F.col("lap") / 2) & (F.col("d") <= 1.5 * F.col("lap")))
    grade = F.when(F.count_if(F.col("z").isNull()) == 0, F.max(F.abs("grade")))
    return middle.groupBy("stroke_id").agg(grade.alias("grade_max"))


def tracks(areas: DataFrame, facilities: DataFrame) -> DataFrame:
    """Running tracks ``(id, tags, length_m)`` with lap, access and the tags they inherit from ``(id, facility_tags)``."""
    rows = areas.where(T.is_running_track(F.col("tags")) & F.col("length_m").between(100, 5000)).join(facilities, "id", "left")
    none = F.create_map().cast("map<string,string>")
    facility = F.coalesce("facility_tags", none)
    own = T.access_category(F.col("tags"))
    return rows.select(
        "id",
        T.lap_length(F.col("length_m")).alias("lap_m"),
        F.when(own == "unknown", T.access_category(facility)).otherwise(own).alias("access"),
        F.coalesce(T.tag(F.col("tags"), "name"), T.tag(facility, "name")).alias("name"),
        T.is_indoor(F.col("tags"), facility).alias("indoor"),
    )


def merge_pieces(pieces: DataFrame) -> DataFrame:
    """Features of tile pieces ``(id, tile, props, line)``: the first properties win, the lines are collected in tile order."""
    found = pieces.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("tile", "props", "line"))).alias("ps"))
    return found.select("id", F.get("ps.props", F.lit(0)).alias("props"), F.col("ps.line").alias("lines"))


def renumbered(df: DataFrame, column: str) -> DataFrame:
    """Identifiers as small numbers from 1 in their own order."""
    ids = df.select(column).distinct()
    return df.join(ids.withColumn("number", F.row_number().over(Window.orderBy(column))), column)


def tile_index(bounds: tuple[float, float, float, float], size: float) -> list[tuple[int, int]]:
    """Raster tiles that touch a box."""
    import math

    x0, y0, x1, y1 = (math.floor(v / size) for v in bounds)
    return [(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]
