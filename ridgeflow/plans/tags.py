"""Queries of tag classification over a decision table built from the parts of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags as T
from ..registry import query
from ..sources.tables import read

#: Values that the table draws from; a blank leaves the tag out.
_CHOICES = {
    "highway": ("motorway", "residential", "footway", "service", "path", "tertiary", "track", "steps", "cycleway"),
    "foot": ("", "yes", "no", "designated", "private"),
    "access": ("", "private", "yes", "no", "customers", "permissive"),
    "service": ("", "", "driveway", "alley"),
    "surface": ("", "asphalt", "gravel", "compacted", "sett", "dirt", "jelly", "tartan"),
    "tracktype": ("", "grade1", "grade2", "grade5", "grade9"),
    "lit": ("", "yes", "no", "24/7", "maybe"),
    "bridge": ("", "", "yes", "no"),
    "tunnel": ("", "no", "", "building_passage", ""),
    "layer": ("", "-1", "1", "-2;0", "x", "0"),
    "railway": ("", "", "", "platform", "", ""),
    "leisure": ("", "track", "park", "sports_centre", "pitch"),
    "sport": ("", "athletics", "tennis; running", "motor", " ; "),
    "natural": ("", "water", "wood", "cliff"),
    "landuse": ("", "forest", "basin", "residential", "grass"),
    "amenity": ("", "school", "university", "parking"),
    "indoor": ("", "", "yes"),
    "building": ("", "no", "yes", ""),
}


def tagged(spark, sf_dir):
    """``(id, tags)``: parts with a map of tags chosen by key."""
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(key.alias("id"), (key * 7919 % 104729).alias("h"))
    pairs = []
    for i, (name, values) in enumerate(_CHOICES.items()):
        at = (F.floor(F.col("h") / (i + 1)) % len(values) + 1).cast("int")
        pairs.append(F.struct(F.lit(name).alias("key"), F.element_at(F.array(*map(F.lit, values)), at).alias("value")))
    tags = F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"] != ""))
    return rows.select("id", tags.alias("tags"), (F.col("h") % 900).cast("double").alias("length_m"))


def _pick(i: int, values: tuple[str, ...]) -> str:
    return f"nullif({list(values)!r}[(floor(h / {i + 1}.0)::BIGINT % {len(values)}) + 1], '')"


_SQL = "t AS (SELECT id, (h % 900)::DOUBLE AS length_m, " + ", ".join(f"{_pick(i, v)} AS {k}" for i, (k, v) in enumerate(_CHOICES.items())) + " FROM (SELECT p_partkey AS id, p_partkey * 7919 % 104729 AS h FROM part))"


def _in(column: str, values: tuple[str, ...]) -> str:
    return f"coalesce({column} IN ({', '.join(repr(v) for v in values)}), false)"


_CLOSED = f"({_in('service', T.EXCLUDED_SERVICES)} OR {_in('foot', T.NO_FOOT)} OR ({_in('access', T.NO_ACCESS)} AND NOT {_in('foot', T.FOOT_ALLOWED)}) OR coalesce(railway = 'platform', false))"
_CLASS = f"CASE WHEN {_in('highway', T.MAJOR)} THEN 'major' WHEN {_CLOSED} THEN NULL WHEN {_in('highway', T.MINOR)} THEN 'minor' WHEN {_in('highway', T.PATH)} THEN 'path' END"


@query("p1_classify_way", f"WITH {_SQL} SELECT id, {_CLASS} AS road_class FROM t")
def p1_classify_way(spark, sf_dir):
    return tagged(spark, sf_dir).select("id", T.classify_way(F.col("tags")).alias("road_class"))


@query(
    "p2_p4_structure",
    f"WITH {_SQL} SELECT id, coalesce(try_cast(split_part(layer, ';', 1) AS DOUBLE) < 0, false) OR coalesce(tunnel != 'no', false) AS underground, "
    "coalesce(railway = 'platform', false) AS rail_platform, CASE WHEN bridge != 'no' THEN 'bridge' WHEN tunnel != 'no' THEN 'tunnel' END AS structure FROM t",
)
def p2_p4_structure(spark, sf_dir):
    tags = F.col("tags")
    return tagged(spark, sf_dir).select("id", T.is_underground(tags).alias("underground"), T.is_rail_platform(tags).alias("rail_platform"), T.structure_of(tags).alias("structure"))


_KNOWN = " ".join(f"WHEN {_in('surface', v)} THEN '{k}'" for k, v in T.SURFACES.items())
_TYPE = " ".join(f"WHEN tracktype = '{k}' THEN '{v}'" for k, v in T.TRACKTYPES.items())


@query(
    "p5_surface_category",
    f"WITH {_SQL} SELECT id, CASE WHEN surface IS NOT NULL THEN CASE {_KNOWN} ELSE 'unknown' END {_TYPE} WHEN ({_CLASS}) = 'minor' THEN 'paved' ELSE 'unknown' END AS surface_category FROM t",
)
def p5_surface_category(spark, sf_dir):
    tags = F.col("tags")
    category = T.surface_category(T.tag(tags, "surface"), T.tag(tags, "tracktype"), T.classify_way(tags))
    return tagged(spark, sf_dir).select("id", category.alias("surface_category"))


@query("p6_lit_category", f"WITH {_SQL} SELECT id, CASE WHEN {_in('lit', T.LIT_YES)} THEN 'yes' WHEN {_in('lit', T.LIT_NO)} THEN 'no' ELSE 'unknown' END AS lit_category FROM t")
def p6_lit_category(spark, sf_dir):
    return tagged(spark, sf_dir).select("id", T.lit_category(T.tag(F.col("tags"), "lit")).alias("lit_category"))


@query(
    "p7_setting_kind",
    f'WITH {_SQL} SELECT id, CASE WHEN "natural" = \'water\' OR {_in("landuse", T.WATER_LANDUSE)} THEN \'water\' WHEN {_in("leisure", T.PARK_LEISURE)} THEN \'park\' '
    f'WHEN {_in("landuse", T.GREEN_LANDUSE)} OR "natural" = \'wood\' THEN \'green\' END AS setting FROM t'.replace(" natural,", ' "natural",'),
)
def p7_setting_kind(spark, sf_dir):
    return tagged(spark, sf_dir).select("id", T.setting_kind(F.col("tags")).alias("setting"))


@query(
    "p8_tracks",
    f"WITH {_SQL} SELECT id, coalesce(leisure = 'track', false) AND CASE WHEN trim(replace(coalesce(sport, ''), ';', '')) != '' THEN sport LIKE '%athletics%' OR sport LIKE '%running%' "
    f"ELSE {_in('surface', T.TRACK_SURFACES)} END AS running_track, {_in('leisure', T.FACILITY_LEISURE)} OR {_in('amenity', T.FACILITY_AMENITY)} AS facility, "
    f"CASE WHEN {_in('foot', T.PUBLIC_ACCESS)} THEN 'public' WHEN {_in('foot', T.RESTRICTED_ACCESS)} THEN 'restricted' WHEN {_in('access', T.PUBLIC_ACCESS)} THEN 'public' "
    f"WHEN {_in('access', T.RESTRICTED_ACCESS)} THEN 'restricted' WHEN amenity = 'school' THEN 'restricted' ELSE 'unknown' END AS access, "
    "coalesce(indoor = 'yes', false) OR coalesce(building != 'no', false) AS indoor FROM t",
)
def p8_tracks(spark, sf_dir):
    tags = F.col("tags")
    return tagged(spark, sf_dir).select(
        "id",
        T.is_running_track(tags).alias("running_track"),
        T.is_facility(tags).alias("facility"),
        T.access_category(tags).alias("access"),
        T.is_indoor(tags, F.create_map(F.lit("leisure"), F.lit("pitch"))).alias("indoor"),
    )


@query(
    "p9_lap_length",
    f"WITH {_SQL}, l(k, lap) AS (VALUES (0, 200.0::DOUBLE), (1, 250.0::DOUBLE), (2, 300.0::DOUBLE), (3, 1000.0::DOUBLE / 3), (4, 400.0::DOUBLE)), "
    "r AS (SELECT id, lap, abs(length_m - lap) / lap AS gap, row_number() OVER (PARTITION BY id ORDER BY abs(length_m - lap) / lap, k) AS n FROM t, l) "
    "SELECT id, CASE WHEN gap <= 0.2::DOUBLE THEN round(lap, 9) END AS lap_m FROM r WHERE n = 1",
)
def p9_lap_length(spark, sf_dir):
    return tagged(spark, sf_dir).select("id", F.round(T.lap_length(F.col("length_m")), 9).alias("lap_m"))


@query("s2_way_ids", f"WITH {_SQL} SELECT id FROM t WHERE highway IS NOT NULL")
def s2_way_ids(spark, sf_dir):
    return tagged(spark, sf_dir).where(F.map_contains_key("tags", F.lit("highway"))).select("id")


@query("h2_barriers", f"WITH {_SQL}, w AS (SELECT id, ({_CLASS}) AS c FROM t) SELECT DISTINCT ps_suppkey AS node_id FROM w JOIN (SELECT DISTINCT l_partkey, l_suppkey AS ps_suppkey FROM lineitem) p ON p.l_partkey = w.id WHERE c = 'major'")
def h2_barriers(spark, sf_dir):
    """Nodes of major ways; a way's nodes are the suppliers of a part."""
    ways = tagged(spark, sf_dir).where(T.classify_way(F.col("tags")) == "major").select("id")
    nodes = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("node_id"))
    return nodes.join(ways, "id", "left_semi").select("node_id").distinct()
