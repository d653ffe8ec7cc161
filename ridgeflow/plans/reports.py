"""Queries of reports: weighted summaries, histograms, comparisons, samples, sinks, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import reports as R
from ..registry import query
from ..sources.tables import POSITIONS_SQL, parts, positions

_P = f"WITH {POSITIONS_SQL}"
_PARTS = "WITH p AS (SELECT l_orderkey AS stroke_id, l_partkey AS way_id, l_quantity::DOUBLE AS length, l_returnflag AS surface, l_linestatus AS lit FROM lineitem), t AS (SELECT stroke_id, sum(length) AS total FROM p GROUP BY stroke_id)"


@query(
    "a1_summarize_parts",
    _PARTS + ", v AS (SELECT stroke_id, surface, sum(length) AS w FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY stroke_id ORDER BY w DESC, surface) AS n FROM v), "
    "l AS (SELECT stroke_id, sum(length) FILTER (lit = 'F') AS yes, sum(length) FILTER (lit = 'O') AS no, string_agg(DISTINCT way_id::VARCHAR, ',' ORDER BY way_id::VARCHAR) AS ways FROM p GROUP BY stroke_id) "
    "SELECT r.stroke_id, r.surface, CASE WHEN w / total >= 0.5 THEN r.surface END AS name, CASE WHEN coalesce(yes, 0) / total >= 0.9 THEN 'yes' WHEN coalesce(yes, 0) > 0 THEN 'partial' WHEN coalesce(no, 0) / total >= 0.5 THEN 'no' ELSE 'unknown' END AS lit, ways "
    "FROM r JOIN t USING (stroke_id) JOIN l USING (stroke_id) WHERE n = 1",
)
def a1_summarize_parts(spark, sf_dir):
    rows = parts(spark, sf_dir).withColumn("lit", F.when(F.col("lit") == "F", "yes").when(F.col("lit") == "O", "no"))
    out = R.summarize_parts(rows.withColumn("name", F.col("surface")))
    return out.select("stroke_id", "surface", "name", "lit", F.array_join(F.array_sort(F.transform("way_ids", lambda w: w.cast("string"))), ",").alias("ways"))


@query("a2_by_length", _PARTS + ", v AS (SELECT stroke_id, way_id, sum(length) AS w FROM p GROUP BY ALL) SELECT stroke_id, arg_min(way_id, (-w, way_id)) AS longest_way, max(w) AS length_m FROM v GROUP BY stroke_id")
def a2_by_length(spark, sf_dir):
    """The longest way, the smallest identifier on ties."""
    ways = parts(spark, sf_dir).groupBy("stroke_id", "way_id").agg(F.sum("length").alias("w"))
    return ways.groupBy("stroke_id").agg(F.min_by("way_id", F.struct(-F.col("w"), "way_id")).alias("longest_way"), F.max("w").alias("length_m"))


@query("a6_report", f"{_P} SELECT kind, count(*) AS n, round(sum(length_m) / 1000, 6) AS km, median(length_m) AS median_length_m, median(score) AS median_score FROM positions GROUP BY kind")
def a6_report(spark, sf_dir):
    return R.report(positions(spark, sf_dir))


@query("a6_histograms", f"{_P} SELECT kind, 'surface' AS what, surface AS value, count(*) AS n FROM positions GROUP BY ALL UNION ALL SELECT kind, 'crossings', least(n_crossings, 2)::VARCHAR, count(*) FROM positions GROUP BY ALL")
def a6_histograms(spark, sf_dir):
    return R.histograms(positions(spark, sf_dir))


@query("a8_summary", f"{_P} SELECT access AS area, count(*) FILTER (kind = 'flat') AS flat, count(*) FILTER (kind = 'climb') AS climb, count(*) FILTER (kind = 'long_climb') AS long_climb, count(*) FILTER (kind = 'loop') AS loop, round(sum(length_m) / 1000, 6) AS km FROM positions GROUP BY access")
def a8_summary(spark, sf_dir):
    rows = positions(spark, sf_dir).groupBy(F.col("access").alias("area"))
    return rows.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("flat", "climb", "long_climb", "loop")), F.round(F.sum("length_m") / 1000, 6).alias("km"))


@query(
    "a13_mode",
    f"{_P}, c AS (SELECT kind, surface, count(*) AS n, min(id) AS first FROM positions GROUP BY ALL) SELECT kind, arg_min(surface, (-n, first)) AS main_surface FROM c GROUP BY kind",
)
def a13_mode(spark, sf_dir):
    """The most frequent value, the first seen on ties."""
    counts = positions(spark, sf_dir).groupBy("kind", "surface").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return counts.groupBy("kind").agg(F.min_by("surface", F.struct(-F.col("n"), "first")).alias("main_surface"))


_SEL = f"{_P}, s AS (SELECT id, kind, coalesce(score, 0) AS score, n_crossings, steep_200_pct IS NULL AS flagged FROM positions WHERE kind IN ('flat', 'climb')), "


@query(
    "t9_sample",
    _SEL + "o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS r FROM s), "
    "f AS (SELECT kind, min(r) FILTER (flagged) AS x FROM o GROUP BY kind), c AS (SELECT o.kind, min(r) FILTER (n_crossings > 0 AND r != coalesce(x, -1)) AS y FROM o JOIN f USING (kind) GROUP BY o.kind), "
    "e AS (SELECT o.*, x, y, row_number() OVER (PARTITION BY o.kind ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY o.kind) AS n FROM o JOIN f USING (kind) JOIN c USING (kind) WHERE r != coalesce(x, -1) AND r != coalesce(y, -1)), "
    "i AS (SELECT DISTINCT kind, round_even((n - 1) * j / (10 - 1 - (x IS NOT NULL)::INT - (y IS NOT NULL)::INT)::DOUBLE, 0)::BIGINT AS k FROM (SELECT DISTINCT kind, n, x, y FROM e), range(10) AS t(j) WHERE j < 10 - (x IS NOT NULL)::INT - (y IS NOT NULL)::INT) "
    "SELECT id, kind FROM e JOIN i USING (kind, k) UNION ALL SELECT id, o.kind FROM o JOIN f ON f.kind = o.kind AND r = x UNION ALL SELECT id, o.kind FROM o JOIN c ON c.kind = o.kind AND r = y",
)
def t9_sample(spark, sf_dir):
    """Ten flats and ten climbs: one flagged, one with crossings, the rest evenly over the ranks."""
    rows = positions(spark, sf_dir).where("kind IN ('flat', 'climb')")
    rows = rows.select("id", "kind", F.coalesce("score", F.lit(0.0)).alias("score"), "n_crossings", F.col("steep_200_pct").isNull().alias("flagged"))
    return R.stratified_sample(rows, 10).select("id", "kind")


@query(
    "w15_unique_ids",
    f"{_P}, b AS (SELECT id, 'flat-' || substr(sha1((id % 40)::VARCHAR), 1, 12) AS base, coalesce(score, 0) AS score FROM positions), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY score DESC, id) AS n FROM b) "
    "SELECT id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS segment_id FROM r",
)
def w15_unique_ids(spark, sf_dir):
    rows = positions(spark, sf_dir).select("id", F.concat(F.lit("flat-"), F.substring(F.sha1((F.col("id") % 40).cast("string")), 1, 12)).alias("segment_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return R.assign_unique_ids(rows, "id").select("id", "segment_id")


@query("w16_repeated_loops", f"{_P} SELECT min(id) AS id, setting FROM positions WHERE kind = 'loop' GROUP BY setting, access")
def w16_repeated_loops(spark, sf_dir):
    first = Window.partitionBy("setting", "access").orderBy("id")
    return positions(spark, sf_dir).where("kind = 'loop'").withColumn("n", F.row_number().over(first)).where("n = 1").select("id", "setting")


@query("u1_union_published", f"{_P} SELECT id, kind, score, NULL::VARCHAR AS setting FROM positions WHERE kind != 'loop' UNION ALL SELECT id, kind, NULL, setting FROM positions WHERE kind = 'loop'")
def u1_union_published(spark, sf_dir):
    df = positions(spark, sf_dir)
    segments = df.where("kind <> 'loop'").select("id", "kind", "score")
    return segments.unionByName(df.where("kind = 'loop'").select("id", "kind", "setting"), allowMissingColumns=True)


@query("u3_difference", "SELECT DISTINCT l_partkey AS way_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 != 0)")
def u3_difference(spark, sf_dir):
    used = parts(spark, sf_dir).select("way_id").distinct()
    from ..sources.tables import read

    kept = read(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("way_id"))
    return used.join(kept, "way_id", "left_anti")


@query("u4_keyed_upsert", f"{_P} SELECT setting, surface, max_by(id, (CASE WHEN loop_type = 'circuit' THEN 1 ELSE 0 END, -id)) AS id FROM positions GROUP BY ALL")
def u4_keyed_upsert(spark, sf_dir):
    """One row for each key: a circuit replaces a track, the smallest identifier stays."""
    order = Window.partitionBy("setting", "surface").orderBy((F.col("loop_type") == "circuit").desc(), "id")
    return positions(spark, sf_dir).withColumn("n", F.row_number().over(order)).where("n = 1").select("setting", "surface", "id")


@query("p18_prune", "SELECT l_orderkey AS stroke_id FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_partkey % 50 != 0)")
def p18_prune(spark, sf_dir):
    from ..sources.tables import read

    removed = read(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("way_id"))
    return R.prune(parts(spark, sf_dir), removed)


@query(
    "k3_geojson",
    f"""{_P} SELECT id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || (round(lon * 1000)::BIGINT) || ',' || (round(lat * 1000)::BIGINT) || ']}},"properties":{{"kind":"' || kind || '"' || CASE WHEN score IS NOT NULL THEN ',"score":' || score::BIGINT ELSE '' END || '}}}}' AS feature FROM positions""",
)
def k3_geojson(spark, sf_dir):
    from ..sinks.features import geojson_feature

    rows = positions(spark, sf_dir).withColumn("score", F.col("score").cast("bigint"))
    point = F.array(F.round(F.col("lon") * 1000).cast("bigint"), F.round(F.col("lat") * 1000).cast("bigint"))
    return rows.select("id", geojson_feature("Point", point, F.struct("kind", "score")).alias("feature"))


@query("k5_id_index", f"{_P}, s AS (SELECT 'flat-' || substr(sha1(id::VARCHAR), 1, 12) AS sid, lon, lat FROM positions) SELECT substr(split_part(sid, '-', 2), 1, 2) AS index_key, count(*) AS n, min(sid) AS first_id, round(sum(lon), 6) AS lon_sum FROM s GROUP BY ALL")
def k5_id_index(spark, sf_dir):
    from ..sinks.features import id_index

    rows = positions(spark, sf_dir).select(F.concat(F.lit("flat-"), F.substring(F.sha1(F.col("id").cast("string")), 1, 12)).alias("id"), "lon", "lat")
    index = id_index(rows, 2)
    return index.groupBy("index_key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.round(F.sum(F.get("entry", F.lit(0))), 6).alias("lon_sum"))


@query("k6_metadata", f"{_P} SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat, count(*) FILTER (kind = 'flat') AS flat, count(*) FILTER (kind = 'loop') AS loop, string_agg(DISTINCT access, ',' ORDER BY access) AS sources FROM positions")
def k6_metadata(spark, sf_dir):
    from ..sinks.features import metadata

    return metadata(positions(spark, sf_dir).withColumnRenamed("access", "source"), ("flat", "loop"))


@query("k8_mismatches", f"{_P} SELECT id, CASE WHEN id % 11 = 0 THEN 'missing' WHEN id % 13 = 0 THEN 'differs' END AS problem FROM positions WHERE id % 11 = 0 OR id % 13 = 0 UNION ALL SELECT -1, 'unknown'")
def k8_mismatches(spark, sf_dir):
    from ..sinks.features import mismatches

    df = positions(spark, sf_dir).select("id", "kind", "length_m", "score")
    found = df.where("id % 11 <> 0").withColumn("length_m", F.when(F.col("id") % 13 == 0, F.col("length_m") + 1).otherwise(F.col("length_m") * (1 + 1e-12)))
    stray = df.limit(1).select(F.lit(-1).cast("bigint").alias("id"), "kind", "length_m", "score")
    return mismatches(df, found.union(stray))


@query("p16_export_props", f"{_P} SELECT id, round(length_m, 1) AS length_m, round(grade_max_pct, 2) AS grade_max_pct, CASE WHEN score IS NULL THEN '{{}}' ELSE '{{\"score\":' || score::BIGINT || '}}' END AS props FROM positions")
def p16_export_props(spark, sf_dir):
    from ..sinks.features import rounded

    rows = positions(spark, sf_dir)
    return rows.select("id", rounded(F.col("length_m"), 1).alias("length_m"), rounded(F.col("grade_max_pct"), 2).alias("grade_max_pct"), F.to_json(F.struct(F.col("score").cast("bigint").alias("score"))).alias("props"))
