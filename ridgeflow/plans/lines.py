"""Queries of line operators, tracks, circuits, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lines as L
from ..operators import network as N
from ..operators import profile as P
from ..registry import query
from ..sources.tables import LINES_SQL, POSITIONS_SQL, positions, read, samples, samples_sql
from .geometry import bent
from .network import barriers, ends, graph
from .tags import _CLASS, _SQL, tagged

_L = f"WITH RECURSIVE {LINES_SQL}"
#: The three-point lines by distance: a along x, then b along y.
_B = "q AS (SELECT *, abs(x1 - x0)::DOUBLE AS a, abs(y1 - y0)::DOUBLE AS b, sign(x1 - x0)::DOUBLE AS sx, sign(y1 - y0)::DOUBLE AS sy FROM lines WHERE x0 != x1 AND y0 != y1)"
_AT = "x0 + sx * least(d, a) AS x, y0 + sy * greatest(d - a, 0) AS y"


def _bent(spark, sf_dir):
    return bent(spark, sf_dir).where("x0 <> x1 AND y0 <> y1")


@query("g3_resample", f"{_L}, {_B}, n AS (SELECT *, greatest(1, ceil((a + b) / 50 - 1e-9))::INT AS n FROM q), p AS (SELECT *, k * (a + b) / n AS d FROM (SELECT *, unnest(range(0, n + 1))::INT AS k FROM n)) SELECT id, k, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT id, k, {_AT} FROM p)")
def g3_resample(spark, sf_dir):
    return L.resample(_bent(spark, sf_dir), 50.0, "id").select("id", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("g4_substring", f"{_L}, {_B}, p AS (SELECT *, (a + b) * 0.25::DOUBLE AS s, (a + b) * 0.75::DOUBLE AS e FROM q), v AS (SELECT id, s AS d, x0, y0, sx, sy, a FROM p UNION SELECT id, e, x0, y0, sx, sy, a FROM p UNION SELECT id, a, x0, y0, sx, sy, a FROM p WHERE a > s AND a < e) SELECT id, count(*)::INT AS n_points, round(sum(x), 4) AS sum_x, round(sum(y), 4) AS sum_y FROM (SELECT id, {_AT} FROM v) GROUP BY id")
def g4_substring(spark, sf_dir):
    from ..functions import geo

    rows = _bent(spark, sf_dir)
    total = geo.length(F.col("line"))
    cut = L.substring(rows, total * 0.25, total * 0.75, "id")
    add = lambda axis: F.round(F.aggregate(F.col(f"line.{axis}"), F.lit(0.0), lambda s, v: s + v), 4)
    return cut.select("id", F.size("line").alias("n_points"), add("x").alias("sum_x"), add("y").alias("sum_y"))


@query("g7_unit_normals", f"{_L}, {_B}, p AS (SELECT id, 0 AS k, 0.0::DOUBLE AS d, x0, y0, sx, sy, a FROM q UNION ALL SELECT id, 1, a, x0, y0, sx, sy, a FROM q UNION ALL SELECT id, 2, a + b, x0, y0, sx, sy, a FROM q), c AS (SELECT id, k, {_AT} FROM p), g AS (SELECT *, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM c WINDOW w AS (PARTITION BY id ORDER BY k)) SELECT id, k, round(-dy / sqrt(dx * dx + dy * dy), 6) + 0.0 AS nx, round(dx / sqrt(dx * dx + dy * dy), 6) + 0.0 AS ny FROM g")
def g7_unit_normals(spark, sf_dir):
    points = L.vertices(_bent(spark, sf_dir), "id").withColumnRenamed("pos", "k")
    rows = L.normals(points, "id")
    return rows.select("id", "k", (F.round("nx", 6) + F.lit(0.0)).alias("nx"), (F.round("ny", 6) + F.lit(0.0)).alias("ny"))


@query("g15_line_distance", f"WITH {POSITIONS_SQL}, k AS (SELECT id, (lon - 1.5) * radians(1) * 6371008.8 * cos(radians(43.5)) AS ax, (lat - 43.5) * radians(1) * 6371008.8 AS ay, 0.01 * radians(1) * 6371008.8 * cos(radians(43.5)) AS dx FROM positions), t AS (SELECT *, greatest(0, least(1, -ax / dx)) AS t FROM k) SELECT id, round(sqrt(pow(ax + t * dx, 2) + ay * ay), 3) AS distance_m FROM t")
def g15_line_distance(spark, sf_dir):
    """Metres from a place to a short west-east line at each position, in local plane coordinates."""
    import math

    from ..functions import geo

    kx, ky = math.radians(1) * geo.EARTH_M * math.cos(math.radians(43.5)), math.radians(1) * geo.EARTH_M
    ax, ay = (F.col("lon") - 1.5) * kx, (F.col("lat") - 43.5) * ky
    d = geo.point_segment_distance(F.lit(0.0), F.lit(0.0), ax, ay, ax + 0.01 * kx, ay)
    return positions(spark, sf_dir).select("id", F.round(d, 3).alias("distance_m"))


@query("g20_raster_tiles", f"{_L} SELECT tx::BIGINT AS tx, ty::BIGINT AS ty, count(DISTINCT id) AS n FROM (SELECT id, tx, unnest(range(floor(least(y0, y1) / 100.0)::BIGINT, floor(greatest(y0, y1) / 100.0)::BIGINT + 1)) AS ty FROM (SELECT *, unnest(range(floor(least(x0, x1) / 100.0)::BIGINT, floor(greatest(x0, x1) / 100.0)::BIGINT + 1)) AS tx FROM lines)) GROUP BY ALL")
def g20_raster_tiles(spark, sf_dir):
    """Tiles of 100 that the boxes of lines touch, with how many."""
    from ..sources.tables import lines

    span = lambda c: F.sequence(F.floor(F.least(f"{c}0", f"{c}1") / F.lit(100.0)), F.floor(F.greatest(f"{c}0", f"{c}1") / F.lit(100.0)))
    rows = lines(spark, sf_dir).withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))
    return rows.groupBy("tx", "ty").agg(F.count_distinct("id").alias("n"))


@query("j2_drop_inside", f"WITH {_SQL}, w AS (SELECT id AS way_id, ({_CLASS}) AS road_class, 100 + length_m AS length FROM t), i AS (SELECT l_partkey AS way_id, max(m) AS in_m FROM (SELECT l_partkey, l_suppkey % 4 AS area_id, sum(l_quantity)::DOUBLE AS m FROM lineitem GROUP BY ALL) GROUP BY l_partkey) SELECT way_id, road_class FROM w LEFT JOIN i USING (way_id) WHERE NOT coalesce(road_class != 'major' AND in_m > 0.5 * length, false)")
def j2_drop_inside(spark, sf_dir):
    from ..functions import tags as T

    ways = tagged(spark, sf_dir).select(F.col("id").alias("way_id"), T.classify_way(F.col("tags")).alias("road_class"), (100 + F.col("length_m")).alias("length"))
    inside = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("way_id"), (F.col("l_suppkey") % 4).alias("area_id"), F.col("l_quantity").cast("double").alias("length"))
    return L.drop_inside(ways, inside).select("way_id", "road_class")


_CTE = samples_sql()


@query("c5_lateral_median", f"WITH {_CTE}, p AS (SELECT stroke_id * 1000 + i AS id, z FROM samples UNION ALL SELECT stroke_id * 1000 + i, CASE WHEN i % 3 != 0 THEN z + 1 END FROM samples UNION ALL SELECT stroke_id * 1000 + i, CASE WHEN i % 2 != 0 THEN z - 2 END FROM samples) SELECT id, round(median(z), 9) AS z FROM p GROUP BY id")
def c5_lateral_median(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("id", F.col("stroke_id") * 1000 + F.col("i"))
    sides = rows.select("id", F.posexplode(F.array("z", F.when(F.col("i") % 3 != 0, F.col("z") + 1), F.when(F.col("i") % 2 != 0, F.col("z") - 2))).alias("side", "z"))
    return L.lateral_median(sides).select("id", F.round("z", 9).alias("z"))


@query("c6_choose_source", f"WITH {_CTE}, c AS (SELECT stroke_id, count(*) FILTER (event_type = 'error') AS a, count(*) FILTER (event_type = 'signup') AS b FROM samples GROUP BY stroke_id) SELECT stroke_id, CASE WHEN a > 0 AND b < a THEN 'fallback' ELSE 'main' END AS source FROM c")
def c6_choose_source(spark, sf_dir):
    rows = samples(spark, sf_dir)
    holes = lambda kind: rows.select("stroke_id", F.when(F.col("event_type") != kind, F.col("z")).alias("z"))
    return L.choose_source(holes("error"), holes("signup"))


@query("c7_fallback_value", f"WITH {POSITIONS_SQL} SELECT id, coalesce(steep_200_pct, grade_mean_pct) AS grade FROM positions")
def c7_fallback_value(spark, sf_dir):
    df = positions(spark, sf_dir)
    other = df.where(F.col("steep_200_pct").isNull()).select("id", F.col("grade_mean_pct").alias("fallback"))
    return df.join(other, "id", "left").select("id", F.coalesce("steep_200_pct", "fallback").alias("grade"))


@query("h13_ring_grade", f"WITH {_CTE}, n AS (SELECT stroke_id, max(i) AS n FROM samples GROUP BY stroke_id), r AS (SELECT s.stroke_id, s.i, s.d, CASE WHEN s.i = n THEN f.z ELSE s.z END AS z, n FROM samples s JOIN n USING (stroke_id) JOIN samples f ON f.stroke_id = s.stroke_id AND f.i = 0), k AS (SELECT a.stroke_id, a.i, abs(h.z - l.z) / 20.0 * 100 AS g FROM (SELECT stroke_id, i, n, unnest([i, i + n]) AS ii FROM r WHERE i > 0) a JOIN r h ON h.stroke_id = a.stroke_id AND h.i = ((a.ii + 2 - 1) % a.n) + 1 JOIN r l ON l.stroke_id = a.stroke_id AND l.i = ((a.ii - 2 - 1 + a.n) % a.n) + 1) SELECT stroke_id, round(max(g), 9) AS grade_max FROM k GROUP BY stroke_id")
def h13_ring_grade(spark, sf_dir):
    rows = samples(spark, sf_dir)
    first = F.first("z").over(P.along().rowsBetween(Window.unboundedPreceding, 0))
    last = F.max("i").over(P.whole())
    ring = rows.withColumn("z", F.when(F.col("i") == last, first).otherwise(F.col("z")))
    return L.max_local_grade(ring).select("stroke_id", F.round("grade_max", 9).alias("grade_max"))


@query("h5_assemble_parts")
def h5_assemble_parts(spark, sf_dir):
    """Parts of strokes; a test checks that they tile each stroke."""
    chain = N.chains(graph(spark, sf_dir), N.pair_ends(ends(spark, sf_dir), barriers(spark)))
    edges = graph(spark, sf_dir).select("e", F.floor(F.col("e") / 4).alias("way_id"), "start_node", "end_node", (10.0 + F.col("e") % 7).alias("length"))
    return L.assemble(chain, edges, N.degrees(graph(spark, sf_dir)), barriers(spark))[0]


@query("h10_candidates", f"WITH {LINES_SQL}, w AS (SELECT id AS walk, 2.0::DOUBLE * (abs(x1 - x0) + abs(y1 - y0)) AS length, abs(x1 - x0)::DOUBLE * abs(y1 - y0) AS area, (kind * 30)::DOUBLE AS car_free FROM lines) SELECT walk, length FROM w WHERE length BETWEEN 200 AND 2000 AND 4 * pi() * area / (length * length) >= 0.3 AND car_free >= 0.6 * length")
def h10_candidates(spark, sf_dir):
    from ..functions import geo

    rows = bent(spark, sf_dir).select(F.col("id").alias("walk"), geo.length(F.col("ring")).alias("length"), geo.ring_area(F.col("ring")).alias("area"), (F.col("kind") * 30).cast("double").alias("car_free"))
    return L.circuit_candidates(rows).select("walk", "length")


@query("h14_tracks", f"WITH {_SQL}, t2 AS (SELECT *, coalesce(leisure = 'track', false) AND CASE WHEN trim(replace(coalesce(sport, ''), ';', '')) != '' THEN sport LIKE '%athletics%' OR sport LIKE '%running%' ELSE surface = 'tartan' END AS tr FROM t) SELECT id, CASE WHEN id % 2 = 0 THEN 'Stadium' END AS name, coalesce(indoor = 'yes', false) OR coalesce(building != 'no', false) OR id % 2 = 0 AS indoor FROM t2 WHERE tr AND length_m BETWEEN 100 AND 5000")
def h14_tracks(spark, sf_dir):
    areas = tagged(spark, sf_dir)
    hall = F.create_map(F.lit("leisure"), F.lit("sports_hall"), F.lit("name"), F.lit("Stadium"))
    facilities = areas.where("id % 2 = 0").select("id", hall.alias("facility_tags"))
    return L.tracks(areas, facilities).select("id", "name", "indoor")


@query("c20_merge_pieces", "SELECT l_orderkey AS id, arg_min(l_returnflag, (l_linenumber, l_returnflag, l_partkey)) AS props, count(*)::INT AS n_lines FROM lineitem GROUP BY l_orderkey")
def c20_merge_pieces(spark, sf_dir):
    pieces = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("tile"), F.col("l_returnflag").alias("props"), F.col("l_partkey").alias("line"))
    return L.merge_pieces(pieces).select("id", "props", F.size("lines").alias("n_lines"))


@query("k11_renumber", "SELECT p_partkey * 7919 % 104729 AS node_id, dense_rank() OVER (ORDER BY p_partkey * 7919 % 104729)::INT AS number FROM part")
def k11_renumber(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select((F.col("p_partkey") * 7919 % 104729).alias("node_id"))
    return L.renumbered(rows, "node_id")


@query("p10_any_vertex", f"{_L} SELECT id FROM lines WHERE (x0 BETWEEN -50 AND 50 AND y0 BETWEEN -50 AND 50) OR (x1 BETWEEN -50 AND 50 AND y0 BETWEEN -50 AND 50) OR (x1 BETWEEN -50 AND 50 AND y1 BETWEEN -50 AND 50)")
def p10_any_vertex(spark, sf_dir):
    inside = F.exists("line", lambda p: p["x"].between(-50, 50) & p["y"].between(-50, 50))
    return bent(spark, sf_dir).where(inside).select("id")


@query("t3_final_order", f"WITH {POSITIONS_SQL} SELECT id, (row_number() OVER (ORDER BY kind, coalesce(score, 0) DESC, id))::INT AS place FROM positions")
def t3_final_order(spark, sf_dir):
    order = Window.orderBy("kind", F.coalesce("score", F.lit(0.0)).desc(), "id")
    return positions(spark, sf_dir).select("id", F.row_number().over(order).alias("place"))


@query("a9_counts", f"WITH {POSITIONS_SQL} SELECT kind, count(*) AS n, min(lon) AS west, max(lat) AS north, string_agg(DISTINCT surface, ',' ORDER BY surface) AS surfaces FROM positions GROUP BY kind")
def a9_counts(spark, sf_dir):
    return positions(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.array_join(F.array_sort(F.collect_set("surface")), ",").alias("surfaces"))


@query("a12_coverage_ratio", f"WITH {POSITIONS_SQL} SELECT kind, round(avg((grade_max_pct <= 2)::INT::DOUBLE), 9) AS ratio FROM positions GROUP BY kind")
def a12_coverage_ratio(spark, sf_dir):
    return positions(spark, sf_dir).groupBy("kind").agg(F.round(F.avg((F.col("grade_max_pct") <= 2).cast("double")), 9).alias("ratio"))


@query("j13_semi_anti", "SELECT c_custkey AS id, c_custkey IN (SELECT o_custkey FROM orders) AS used FROM customer")
def j13_semi_anti(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    used = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    there = customers.join(used, "id", "left_semi").withColumn("used", F.lit(True))
    return there.union(customers.join(used, "id", "left_anti").withColumn("used", F.lit(False)))


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    from ..streaming.sessions import sessions

    return sessions(read(spark, sf_dir, "events")).select("user_id", "n", "total")
