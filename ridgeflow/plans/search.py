"""Queries of the search over features with a position."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import search as S
from ..registry import query
from ..sources.tables import POSITIONS_SQL, positions

_AT = (1.44, 43.6)
_HAV = "2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(lat - 43.6) / 2), 2) + cos(radians(43.6)) * cos(radians(lat)) * pow(sin(radians(lon - 1.44) / 2), 2))))"
_P = f"WITH {POSITIONS_SQL}, p AS (SELECT *, {_HAV} AS dist FROM positions)"
_FLAT = "kind = 'flat' AND length_m >= 400 AND surface IN ('compacted', 'gravel', 'unpaved') AND grade_max_pct <= 4"
_CLIMB = "kind = 'climb' AND length_m >= 200 AND coalesce(steep_200_pct, grade_mean_pct) >= 3 AND grade_mean_pct <= 50"
_LOOP = "kind = 'loop' AND CASE WHEN loop_type = 'circuit' THEN setting ELSE 'track' END IN ('track', 'water', 'park', 'neighbourhood') AND access = 'public' AND (loop_type != 'circuit' OR grade_max_pct <= 5)"
FLAT = S.Criteria(min_length_m=400, surface="unpaved", max_local_grade_pct=4.0)
CLIMB = S.Criteria(kind="climb")
LOOP = S.Criteria(kind="loop", public_only=True)
WIDE = S.Criteria(kind="climb", max_distance_m=60_000.0)


def _found(df):
    return df.select("id", F.round("distance_m", 3).alias("distance_m"))


@query("p11_search_flat", f"{_P} SELECT id, round(dist, 3) AS distance_m FROM p WHERE {_FLAT} AND dist <= 80000")
def p11_search_flat(spark, sf_dir):
    from dataclasses import replace

    return _found(S.search(positions(spark, sf_dir), replace(FLAT, max_distance_m=80_000.0), _AT))


@query("p11_search_climb", f"{_P} SELECT id, round(dist, 3) AS distance_m FROM p WHERE {_CLIMB} AND dist <= 60000")
def p11_search_climb(spark, sf_dir):
    return _found(S.search(positions(spark, sf_dir), WIDE, _AT))


@query("p11_search_loop", f"{_P} SELECT id FROM p WHERE {_LOOP}")
def p11_search_loop(spark, sf_dir):
    return S.search(positions(spark, sf_dir), LOOP).select("id")


@query("p12_map_filter", f"{_P} SELECT id, 'flat' AS filter FROM p WHERE {_FLAT} UNION ALL SELECT id, 'climb' FROM p WHERE {_CLIMB} UNION ALL SELECT id, 'loop' FROM p WHERE {_LOOP}")
def p12_map_filter(spark, sf_dir):
    """The nested expressions of three criteria, compiled to columns."""
    df = positions(spark, sf_dir)
    named = [(c.kind, S.compile_expression(S.map_filter(c), df.columns)) for c in (FLAT, CLIMB, LOOP)]
    kinds = F.filter(F.array(*(F.when(test, F.lit(kind)) for kind, test in named)), lambda x: x.isNotNull())
    return df.select("id", F.explode(kinds).alias("filter"))


@query("p12_overview_filter", f"{_P} SELECT id FROM p WHERE kind = 'flat' AND length_m >= 400")
def p12_overview_filter(spark, sf_dir):
    df = positions(spark, sf_dir)
    return df.where(S.compile_expression(S.overview_filter(FLAT), df.columns)).select("id")


@query("p13_pinned", f"{_P} SELECT id, round(dist, 3) AS distance_m FROM p WHERE id = 7 OR ({_CLIMB} AND dist <= 60000)")
def p13_pinned(spark, sf_dir):
    return _found(S.search(positions(spark, sf_dir), WIDE, _AT, pinned=7))


@query(
    "p14_p15_scalars",
    f"{_P} SELECT id, (floor((n_crossings + 6) * 60 * 1000.0 / (300 + id % 60) / 10 + 0.5) * 10)::BIGINT AS effort_m, steep_200_pct IS NULL OR steep_200_pct > 3 AS is_loop FROM p",
)
def p14_p15_scalars(spark, sf_dir):
    effort = S.effort_length_m(F.col("n_crossings") + 6.0, 300 + F.col("id") % 60)
    return positions(spark, sf_dir).select("id", effort.cast("bigint").alias("effort_m"), S.is_loop(F.col("steep_200_pct")).alias("is_loop"))


def _ranked(spark, sf_dir, sort_by):
    rows = S.search(positions(spark, sf_dir), WIDE, _AT)
    return rows.select("id", F.row_number().over(Window.orderBy(*S.order_of(sort_by))).alias("rank"))


_ORDERS = {
    "distance": "dist, coalesce(score, 0) DESC, id",
    "gain": "coalesce(elev_gain_m, 0) DESC, dist, id",
    "score": "coalesce(score, 0) DESC, dist, id",
}
for _name, _order in _ORDERS.items():
    query(f"t1_sort_{_name}", f"{_P} SELECT id, (row_number() OVER (ORDER BY {_order}))::INT AS rank FROM p WHERE {_CLIMB} AND dist <= 60000")(lambda spark, sf_dir, by=_name: _ranked(spark, sf_dir, by))


@query("t2_top50", f"{_P} SELECT id, score FROM p ORDER BY coalesce(score, 0) DESC, dist, id LIMIT 50")
def t2_top50(spark, sf_dir):
    """The first 50: each task keeps its own 50, no full sort."""
    from ..functions import geo

    rows = positions(spark, sf_dir).withColumn("distance_m", geo.haversine(F.lit(_AT[0]), F.lit(_AT[1]), F.col("lon"), F.col("lat")))
    return rows.orderBy(*S.order_of("score")).limit(S.SHOWN).select("id", "score")


@query(
    "search_texts",
    f"{_P} SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE round(lon, 5) END AS lon, CASE WHEN id % 3 = 0 THEN NULL ELSE round(lat, 5) END AS lat, "
    "'?id=flat-' || id || CASE WHEN kind = 'flat' THEN '' ELSE '&kind=' || kind END AS url, CASE WHEN kind IN ('flat', 'climb', 'long_climb', 'loop') THEN kind END AS url_kind FROM p",
)
def search_texts(spark, sf_dir):
    """Positions typed as text, and the page state written to a link and read back."""
    from ..functions import text as X

    df = positions(spark, sf_dir)
    typed = F.when(F.col("id") % 3 == 0, F.lit("95, 10")).otherwise(F.format_string(" %.5f, %.5f", "lat", "lon"))
    rows = df.select("id", "kind", X.parse_lat_lon(typed).alias("p"), X.url_search(F.concat(F.lit("flat-"), F.col("id").cast("string")), F.col("kind")).alias("url"))
    return rows.select("id", "p.lon", "p.lat", "url", F.coalesce(X.url_kind(F.col("url")), F.lit("flat")).alias("url_kind"))
