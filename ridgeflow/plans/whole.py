"""Queries of detection as a whole, of circuits and of published files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import text as X
from ..operators import circuits as C
from ..operators import detect as D
from ..operators.suppress import scratch_path
from ..params import Params
from ..registry import query
from ..sinks.profiles import write_profiles
from ..sources import answers as A
from ..sources.profiles import read_profiles
from ..sources.tables import LINES_SQL, POSITIONS_SQL, gapped, lines, positions, read, samples, samples_sql
from . import geometry as GEO

_P = Params()
_SCALE = 10_000
#: Where a stroke lies: its samples along x with a slow bend, strokes in rows of their own.
_X, _Y = "d", "500.0 * stroke_id + 0.0001 * d * d"


def terrain(spark, sf_dir, divisor: int = _SCALE):
    """Samples with places, structures and missing heights."""
    return gapped(spark, sf_dir, divisor).withColumn("x", F.expr(_X)).withColumn("y", F.expr(_Y).cast("double"))


def stroke_parts(spark, sf_dir):
    """Parts of 250 m for each stroke, from its samples."""
    rows = samples(spark, sf_dir).groupBy("stroke_id").agg(F.max("d").alias("length"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / 250).cast("int"))))
    of = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col("stroke_id") + F.col("part"), F.lit(len(values))) + 1).cast("int"))
    return rows.select(
        "stroke_id",
        "part",
        (F.col("stroke_id") * 1000 + F.col("part")).cast("long").alias("way_id"),
        (F.col("part") * 250.0).alias("start_m"),
        F.least(F.col("part") * 250.0 + 250.0, F.col("length")).alias("end_m"),
        of("paved", "gravel", "unpaved").alias("surface"),
        of("yes", "no", "yes", "unknown").alias("lit"),
        of("Quay", None).alias("name"),
        of("footway", "path", "cycleway", "track").alias("highway"),
        of(None, None, None, None, "bridge").alias("structure"),
    )


def stroke_events(spark, sf_dir):
    """An event on every 60th sample."""
    rows = samples(spark, sf_dir).where("i % 60 = 30")
    return rows.select("stroke_id", F.col("d").alias("offset_m"), F.when(F.col("i") % 120 == 30, "crossing").otherwise("junction").alias("kind"))


@query("c3_detect_all")
def c3_detect_all(spark, sf_dir):
    """All kinds of stretches of all strokes, with attributes, after suppression, in final order."""
    found = D.detect_all(terrain(spark, sf_dir), stroke_parts(spark, sf_dir), stroke_events(spark, sf_dir), _P)
    floats = [f.name for f in found.schema if f.dataType.simpleString() == "double"]
    return found.withColumns({c: F.round(c, 6) for c in floats})


_PLACED = f"WITH {samples_sql(_SCALE)}, p AS (SELECT *, {_X} AS x, {_Y} AS y, max(i) OVER (PARTITION BY stroke_id) AS hi FROM samples)"
_OWN = "o AS (SELECT p.*, CASE WHEN hi = 0 THEN NULL ELSE 4.0::DOUBLE + (stroke_id % 5) / 4.0::DOUBLE END AS step FROM p), e AS (SELECT *, greatest(1, round_even(200 / step, 0)::BIGINT) AS n FROM o WHERE hi > 0)"


@query(
    "w2b_own_windows",
    f"{_PLACED}, {_OWN} SELECT a.stroke_id, a.i AS \"start\", a.n AS n, round(100 * (b.z - a.z) / (b.i * b.step - a.i * a.step), 6) AS mean_grade, "
    "round((b.i - a.i) * a.step / sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 6) AS sinuosity FROM e a JOIN e b ON b.stroke_id = a.stroke_id AND b.i = a.i + a.n",
)
def w2b_own_windows(spark, sf_dir):
    """Windows of 200 m where each stroke has its own step (4 to 5 m), with mean grade and sinuosity."""
    rows = samples(spark, sf_dir, _SCALE).withColumn("x", F.expr(_X)).withColumn("y", F.expr(_Y).cast("double"))
    rows = rows.withColumn("d", F.col("i") * (4.0 + (F.col("stroke_id") % 5) / 4.0)).withColumn("grade", F.lit(0.0))
    rows = D.window_of(D.with_steps(rows), 200.0).where("w IS NOT NULL")
    return rows.select("stroke_id", F.col("i").alias("start"), F.col("w.n").alias("n"), F.round("w.mean", 6).alias("mean_grade"), F.round("w.sinuosity", 6).alias("sinuosity"))


#: Small upright rectangles as rings, two families of them.
_BOXES = f"""WITH {LINES_SQL}, r AS (SELECT id, kind, x0 AS a, y0 AS b, x0 + 8 + abs(score) % 17 AS c, y0 + 8 + abs(score) % 13 AS d FROM lines),
q AS (SELECT id AS area_id, CASE id % 4 WHEN 0 THEN 'water' WHEN 1 THEN 'park' WHEN 2 THEN 'green' ELSE 'other' END AS kind, x1 AS a, y1 AS b, x1 + 40 AS c, y1 + 30 AS d FROM lines),
o AS (SELECT r.id, q.area_id, q.kind, (least(r.c, q.c) - greatest(r.a, q.a)) * (least(r.d, q.d) - greatest(r.b, q.b)) AS shared, (r.c - r.a) * (r.d - r.b) AS size
    FROM r JOIN q ON r.a < q.c AND q.a < r.c AND r.b < q.d AND q.b < r.d)"""


def _ring(a, b, c, d):
    return F.array(*(F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")) for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))))


def boxes(spark, sf_dir):
    rows = lines(spark, sf_dir)
    rings = rows.select("id", _ring("x0", "y0", "x0 + 8 + abs(score) % 17", "y0 + 8 + abs(score) % 13").alias("ring"))
    kind = F.element_at(F.array(*map(F.lit, ("water", "park", "green", "other"))), (F.col("id") % 4 + 1).cast("int"))
    areas = rows.select(F.col("id").alias("area_id"), kind.alias("kind"), F.concat(F.lit("area "), F.col("id")).alias("name"), _ring("x1", "y1", "x1 + 40", "y1 + 30").alias("ring"))
    return rings, areas


@query("j10_overlap", f"{_BOXES} SELECT id, area_id, round(shared::DOUBLE, 6) AS shared FROM o")
def j10_overlap(spark, sf_dir):
    rings, areas = boxes(spark, sf_dir)
    return C.overlaps(rings, areas, 100.0).select("id", "area_id", F.round("shared", 6).alias("shared"))


@query(
    "h12_settings",
    f"""{_BOXES}, s AS (SELECT id, any_value(size) AS size, coalesce(sum(shared) FILTER (kind = 'water'), 0) AS wet, coalesce(sum(shared) FILTER (kind IN ('park', 'green')), 0) AS green FROM o GROUP BY id),
    n AS (SELECT id, 'area ' || area_id AS name FROM o WHERE 5 * shared > size QUALIFY row_number() OVER (PARTITION BY id ORDER BY shared DESC, 'area ' || area_id) = 1)
    SELECT r.id, n.name, CASE WHEN 100 * coalesce(wet, 0) >= 15 * (r.c - r.a) * (r.d - r.b) THEN 'water' WHEN 10 * coalesce(green, 0) >= 4 * (r.c - r.a) * (r.d - r.b) THEN 'park' WHEN r.id % 3 = 0 THEN 'countryside' ELSE 'neighbourhood' END AS setting
    FROM r LEFT JOIN s ON s.id = r.id LEFT JOIN n ON n.id = r.id""",
)
def h12_settings(spark, sf_dir):
    """The setting and name of each ring from the areas that cover it."""
    rings, areas = boxes(spark, sf_dir)
    share = F.when(F.col("id") % 3 == 0, 0.5).otherwise(0.0)
    rows = rings.withColumn("name", F.lit(None).cast("string")).withColumn("track_share", share)
    return C.settings(rows, areas, 100.0).select("id", "name", "setting")


_T = GEO._T.replace("lat", "la")
_L93 = f"SELECT *, {G._C} * pow({_T}, {G._N}) AS r FROM"


@query(
    "g11_box",
    f"""WITH {POSITIONS_SQL}, k AS (SELECT unnest(range(0, 23)) / 22.0::DOUBLE AS s),
    e AS (SELECT id, lon + 0.05 * s AS lo, lat AS la FROM positions, k UNION ALL SELECT id, lon + 0.05 * s, lat + 0.04 FROM positions, k
        UNION ALL SELECT id, lon, lat + 0.04 * s FROM positions, k UNION ALL SELECT id, lon + 0.05, lat + 0.04 * s FROM positions, k),
    t AS ({_L93} e), p AS (SELECT id, 700000 + r * sin({G._N} * radians(lo - 3)) AS x, 6600000 + {G._R0} - r * cos({G._N} * radians(lo - 3)) AS y FROM t)
    SELECT id, floor(min(x) / 1000) * 1000 AS min_x, floor(min(y) / 1000) * 1000 AS min_y, ceil(max(x) / 1000) * 1000 AS max_x, ceil(max(y) / 1000) * 1000 AS max_y FROM p GROUP BY id""",
)
def g11_box(spark, sf_dir):
    """The plane box of a small box at each position."""
    lon, lat = F.col("lon"), F.col("lat")
    box = G.box_to_lambert93(lon, lat, lon + 0.05, lat + 0.04)
    return positions(spark, sf_dir).select("id", box.alias("b")).select("id", "b.*")


@query("g10_web", f"WITH {POSITIONS_SQL} SELECT id, round(radians(lon) * 6378137.0, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) AS y, round(lon, 7) AS lon, round(lat, 7) AS lat FROM positions")
def g10_web(spark, sf_dir):
    """Web-map metres and back."""
    rows = positions(spark, sf_dir).select("id", G.web_mercator(F.col("lon"), F.col("lat")).alias("p"))
    rows = rows.select("id", "p.*", G.web_mercator_inverse(F.col("p.x"), F.col("p.y")).alias("q"))
    return rows.select("id", *(F.round(c, 3).alias(c) for c in "xy"), *(F.round(f"q.{c}", 7).alias(c) for c in ("lon", "lat")))


_NOW = "1998-08-05"
_MONTHS = "[" + ", ".join(f"'{m}'" for m in X.MONTHS) + "]"


@query(
    "date_relative",
    f"""WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS w, DATE '{_NOW}' - o_orderdate::DATE AS n FROM orders)
    SELECT o_orderkey, CASE WHEN n <= 0 THEN 'aujourd''hui' WHEN n = 1 THEN 'hier' WHEN n < 7 THEN 'il y a ' || n || ' jours' ELSE day(w) || ' ' || {_MONTHS}[month(w)] || ' ' || year(w) END AS written FROM d""",
)
def date_relative(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    return rows.select("o_orderkey", X.relative_date(F.to_date("o_orderdate"), F.lit(_NOW).cast("date")).alias("written"))


@query(
    "s19_route",
    f"WITH {POSITIONS_SQL} SELECT id, CASE WHEN id % 5 != 0 THEN round(length_m, 3) END AS distance_m, CASE WHEN id % 5 != 0 THEN 2 END AS n_points, CASE WHEN id % 3 != 0 THEN 4 END AS n_samples, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS n_places FROM positions",
)
def s19_route(spark, sf_dir):
    """Answers of services, written as JSON and parsed: routes without a distance, heights with gaps, places without a label."""
    point = F.concat(F.lit("["), F.col("lon"), F.lit(","), F.col("lat"), F.lit("]"))
    route = F.concat(F.lit('{"geometry":{"coordinates":['), point, F.lit(","), point, F.lit(']},"duration":5'), F.when(F.col("id") % 5 != 0, F.concat(F.lit(',"distance":'), F.col("length_m"))).otherwise(""), F.lit("}"))
    sample = lambda z: F.concat(F.lit('{"lon":'), F.col("lon"), F.lit(',"lat":'), F.col("lat"), F.lit(',"z":'), z, F.lit("}"))
    last = F.when(F.col("id") % 3 == 0, "-99999").otherwise("7.5")
    heights = F.concat(F.lit('{"elevations":['), F.concat_ws(",", *(sample(F.lit("1.0")) for _ in range(3)), sample(last)), F.lit("]}"))
    place = F.concat(F.lit('{"features":[{"geometry":{"coordinates":'), point, F.lit('},"properties":{'), F.when(F.col("id") % 2 == 0, '"label":"Quay"').otherwise(""), F.lit("}}]}"))
    rows = positions(spark, sf_dir).select("id", A.route(route).alias("r"), A.elevations(heights).alias("e"), A.places(place).alias("p"))
    return rows.select("id", F.round("r.distance_m", 3).alias("distance_m"), F.size("r.coordinates").alias("n"), F.col("e"), F.size("p").alias("n_places")).select(
        "id", "distance_m", F.when(F.col("n") >= 0, F.col("n")).alias("n_points"), F.when(F.col("e").isNotNull(), F.size("e")).alias("n_samples"), "n_places"
    )


@query("k2_profiles", f"WITH {samples_sql(_SCALE)} SELECT stroke_id, count(*) AS n, round(sum(CASE WHEN event_type != 'error' THEN z END), 6) AS sum_z, 5.0::DOUBLE AS step_m, max(CASE WHEN stroke_id % 3 = 0 THEN 'coarse' ELSE 'fine' END) AS elevation_source, 'fine' AS main_source FROM samples GROUP BY stroke_id")
def k2_profiles(spark, sf_dir):
    """Raw profiles written, then read back."""
    path = scratch_path(spark, "profiles")
    source = F.when(F.col("stroke_id") % 3 == 0, "coarse").otherwise("fine")
    write_profiles(gapped(spark, sf_dir, _SCALE).withColumn("elevation_source", source), path, 5.0)
    rows, step, main = read_profiles(spark, path)
    found = rows.groupBy("stroke_id").agg(F.count("*").alias("n"), F.round(F.sum("z"), 6).alias("sum_z"), F.min("elevation_source").alias("elevation_source"))
    return found.withColumn("step_m", F.lit(step)).withColumn("main_source", F.lit(main))
