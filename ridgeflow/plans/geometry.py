"""Queries of geometry functions on straight lines, rings and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..registry import query
from ..sources.tables import LINES_SQL, POSITIONS_SQL, lines, positions

_L = f"WITH {LINES_SQL}"
_D = "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"


def bent(spark, sf_dir):
    """``lines`` with a three-point ``line`` and a closed four-sided ``ring``."""
    p = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = lines(spark, sf_dir)
    rows = rows.withColumn("line", F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1")))
    corners = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0"))
    return rows.withColumn("ring", corners)


@query("g2_polyline", f"{_L} SELECT id, round((abs(x1 - x0) + abs(y1 - y0))::DOUBLE, 6) AS length_m, round({_D}, 6) AS chord_m, CASE WHEN {_D} > 1e-9 THEN round((abs(x1 - x0) + abs(y1 - y0)) / {_D}, 6) END AS sinuosity FROM lines")
def g2_polyline(spark, sf_dir):
    s = G.sinuosity(F.col("line"))
    return bent(spark, sf_dir).select(
        "id",
        F.round(G.length(F.col("line")), 6).alias("length_m"),
        F.round(G.chord(F.col("line")), 6).alias("chord_m"),
        F.when(s != float("inf"), F.round(s, 6)).alias("sinuosity"),
    )


@query("g1_dedupe_vertices", f"{_L} SELECT id, 1 + (x1 != x0)::INT + (y1 != y0)::INT AS n_vertices FROM lines")
def g1_dedupe_vertices(spark, sf_dir):
    return bent(spark, sf_dir).select("id", F.size(G.dedupe_vertices(F.col("line"))).alias("n_vertices"))


@query(
    "g5_bearing",
    f"{_L}, b AS (SELECT id, degrees(atan2((x1 - x0)::DOUBLE, (y1 - y0)::DOUBLE)) AS a FROM lines WHERE x0 != x1 OR y0 != y1), "
    "c AS (SELECT id, CASE WHEN a < 0 THEN a + 360 ELSE a END AS b FROM b) "
    "SELECT id, round(b, 6) AS bearing_deg, round(180 - abs(CASE WHEN b - 90 + 180 < 0 THEN b + 450 WHEN b + 90 >= 360 THEN b - 270 ELSE b + 90 END - 180), 6) AS deflection_deg FROM c",
)
def g5_bearing(spark, sf_dir):
    rows = lines(spark, sf_dir).where("x0 <> x1 OR y0 <> y1")
    b = G.bearing((F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double"))
    return rows.select("id", F.round(b, 6).alias("bearing_deg"), F.round(G.deflection(b, F.lit(90.0)), 6).alias("deflection_deg"))


@query("g8_bbox", f"{_L} SELECT id, least(x0, x1) AS min_x, least(y0, y1) AS min_y, greatest(x0, x1) AS max_x, greatest(y0, y1) AS max_y FROM lines")
def g8_bbox(spark, sf_dir):
    xs, ys = F.col("line.x"), F.col("line.y")
    return bent(spark, sf_dir).select("id", *(f(v).cast("bigint").alias(n) for f, v, n in ((F.array_min, xs, "min_x"), (F.array_min, ys, "min_y"), (F.array_max, xs, "max_x"), (F.array_max, ys, "max_y"))))


_SNAP = lambda v: f"round_even({v} / 10.0::DOUBLE, 0)::BIGINT"


@query(
    "g9_stable_id",
    f"{_L}, s AS (SELECT *, {_SNAP('x0')} AS a, {_SNAP('y0')} AS b, {_SNAP('x1')} AS c, {_SNAP('y1')} AS d, {_SNAP(_D)} AS n FROM lines) "
    "SELECT id, 'flat-' || substr(sha1('flat|' || CASE WHEN (a, b) <= (c, d) THEN a || '|' || b || '|' || c || '|' || d ELSE c || '|' || d || '|' || a || '|' || b END || '|' || n), 1, 12) AS stable_id FROM s",
)
def g9_stable_id(spark, sf_dir):
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    return lines(spark, sf_dir).select("id", G.stable_id(F.lit("flat"), x0, y0, x1, y1, G.hypot(x1 - x0, y1 - y0)).alias("stable_id"))


_E = G._E
_T = f"tan(pi() / 4 - radians(lat) / 2) / pow((1 - {_E} * sin(radians(lat))) / (1 + {_E} * sin(radians(lat))), {_E / 2})"


@query(
    "g10_l93",
    f"WITH {POSITIONS_SQL}, t AS (SELECT id, lon, {G._C} * pow({_T}, {G._N}) AS r FROM positions) "
    f"SELECT id, round(700000 + r * sin({G._N} * radians(lon - 3)), 3) AS x, round(6600000 + {G._R0} - r * cos({G._N} * radians(lon - 3)), 3) AS y FROM t",
)
def g10_l93(spark, sf_dir):
    rows = positions(spark, sf_dir).select("id", G.lambert93(F.col("lon"), F.col("lat")).alias("p"))
    return rows.select("id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query("g10_l93_inverse", f"WITH {POSITIONS_SQL} SELECT id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM positions")
def g10_l93_inverse(spark, sf_dir):
    """Round trip through the plane."""
    rows = positions(spark, sf_dir).select("id", G.lambert93(F.col("lon"), F.col("lat")).alias("p"))
    rows = rows.select("id", G.lambert93_inverse(F.col("p.x"), F.col("p.y")).alias("q"))
    return rows.select("id", F.round("q.lon", 7).alias("lon"), F.round("q.lat", 7).alias("lat"))


@query(
    "g12_ring_measures",
    f"{_L} SELECT id, abs(x1 - x0)::DOUBLE * abs(y1 - y0) AS area_m2, "
    "round(4 * pi() * abs(x1 - x0) * abs(y1 - y0) / pow(2.0::DOUBLE * (abs(x1 - x0) + abs(y1 - y0)), 2), 6) AS compactness, "
    "round((x0 + x1) / 2.0::DOUBLE, 4) AS cx, round((y0 + y1) / 2.0::DOUBLE, 4) AS cy, (0 > least(x0, x1) OR false) AND (0 < greatest(x0, x1)) AND ((y0 > 0) != (y1 > 0)) AS holds_origin FROM lines WHERE x0 != x1 AND y0 != y1 AND x0 != 0 AND x1 != 0",
)
def g12_ring_measures(spark, sf_dir):
    ring = F.col("ring")
    rows = bent(spark, sf_dir).where("x0 <> x1 AND y0 <> y1 AND x0 <> 0 AND x1 <> 0")
    return rows.select(
        "id",
        G.ring_area(ring).alias("area_m2"),
        F.round(G.compactness(ring), 6).alias("compactness"),
        F.round(G.ring_centroid(ring)["x"], 4).alias("cx"),
        F.round(G.ring_centroid(ring)["y"], 4).alias("cy"),
        G.point_in_ring(F.lit(0.0), F.lit(0.0), ring).alias("holds_origin"),
    )


@query(
    "g6_point_distance",
    f"{_L}, q AS (SELECT *, (x1 - x0)::DOUBLE AS dx, (y1 - y0)::DOUBLE AS dy FROM lines), t AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, (-x0 * dx - y0 * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM q) "
    "SELECT id, round(sqrt(pow(x0 + t * dx, 2) + pow(y0 + t * dy, 2)), 6) AS distance_m FROM t",
)
def g6_point_distance(spark, sf_dir):
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    return lines(spark, sf_dir).select("id", F.round(G.point_segment_distance(F.lit(0.0), F.lit(0.0), x0, y0, x1, y1), 6).alias("distance_m"))


_HAV = "2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(lat - 43.6) / 2), 2) + cos(radians(43.6)) * cos(radians(lat)) * pow(sin(radians(lon - 1.44) / 2), 2))))"


@query("g14_haversine", f"WITH {POSITIONS_SQL} SELECT id, round({_HAV}, 3) AS distance_m FROM positions")
def g14_haversine(spark, sf_dir):
    return positions(spark, sf_dir).select("id", F.round(G.haversine(F.lit(1.44), F.lit(43.6), F.col("lon"), F.col("lat")), 3).alias("distance_m"))


@query(
    "g16_circle",
    f"WITH {POSITIONS_SQL}, c AS (SELECT id, radians(lon) AS lo, radians(lat) AS la, 1000 / 6371008.8 AS ang, k, 2 * pi() * (k % 64) / 64 AS b FROM positions, range(65) AS t(k)), "
    "d AS (SELECT *, asin(sin(la) * cos(ang) + cos(la) * sin(ang) * cos(b)) AS la2 FROM c) "
    "SELECT id, k::INT AS corner, round(degrees(lo + atan2(sin(b) * sin(ang) * cos(la), cos(ang) - sin(la) * sin(la2))), 7) AS lon, round(degrees(la2), 7) AS lat FROM d",
)
def g16_circle(spark, sf_dir):
    rows = positions(spark, sf_dir).select("id", F.posexplode(G.circle_polygon(F.col("lon"), F.col("lat"), 1000.0)).alias("corner", "p"))
    return rows.select("id", "corner", F.round("p.lon", 7).alias("lon"), F.round("p.lat", 7).alias("lat"))


def _tile_sql(lon: str, lat: str, z: int = 12) -> tuple[str, str]:
    n = 2**z
    return f"least({n - 1}, greatest(0, floor(({lon} + 180) / 360 * {n})))::INT", f"least({n - 1}, greatest(0, floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * {n})))::INT"


@query("g17_tiles", "WITH {}, t AS (SELECT id, {} AS x, {} AS y FROM positions) SELECT id, x, y, round(x / 4096.0 * 360 - 180, 7) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * y / 4096.0)))), 7) AS north FROM t".format(POSITIONS_SQL, *_tile_sql("lon", "lat")))
def g17_tiles(spark, sf_dir):
    rows = positions(spark, sf_dir).select("id", G.tile(F.col("lon"), F.col("lat"), 12).alias("t")).select("id", "t.x", "t.y")
    rows = rows.withColumn("p", G.tile_point(12, F.col("x"), F.col("y")))
    return rows.select("id", "x", "y", F.round("p.lon", 7).alias("west"), F.round("p.lat", 7).alias("north"))


_R = 5000 / 111_320
_W, _NN = _tile_sql(f"(lon - {_R} / cos(radians(lat)))", f"(lat + {_R})")
_EE, _S = _tile_sql(f"(lon + {_R} / cos(radians(lat)))", f"(lat - {_R})")


@query("j11_tile_cover", f"WITH {POSITIONS_SQL}, b AS (SELECT id, {_W} AS w, {_NN} AS n, {_EE} AS e, {_S} AS s FROM positions) SELECT id, unnest(range(w, e + 1))::INT AS x, y FROM (SELECT id, w, e, unnest(range(n, s + 1))::INT AS y FROM b)")
def j11_tile_cover(spark, sf_dir):
    rows = positions(spark, sf_dir).select("id", F.explode(G.circle_cover(F.col("lon"), F.col("lat"), 5000.0, 12)).alias("t"))
    return rows.select("id", "t.x", "t.y")


@query(
    "g21_classes",
    f"WITH {POSITIONS_SQL} SELECT id, greatest(0, ceil(round((grade_max_pct - 2.0) / 0.5, 9)))::INT AS grade_band, (length_m > 500)::INT + (length_m > 1000)::INT AS size_class, "
    "substr(split_part('flat-' || substr(sha1(id::VARCHAR), 1, 12), '-', 2), 1, 2) AS index_key FROM positions",
)
def g21_classes(spark, sf_dir):
    sid = F.concat(F.lit("flat-"), F.substring(F.sha1(F.col("id").cast("string")), 1, 12))
    return positions(spark, sf_dir).select("id", G.grade_band(F.col("grade_max_pct")).alias("grade_band"), G.size_class(F.col("length_m")).alias("size_class"), G.index_key(sid).alias("index_key"))


@query("a10_bounds", f"WITH {POSITIONS_SQL} SELECT kind, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat, count(*) AS n FROM positions GROUP BY kind")
def a10_bounds(spark, sf_dir):
    return positions(spark, sf_dir).groupBy("kind").agg(
        F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"), F.count("*").alias("n")
    )


