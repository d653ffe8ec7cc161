"""Queries of suppression, spatial joins and version lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import lineage as V
from ..operators import spatial as X
from ..operators import suppress as U
from ..registry import query
from ..sources.tables import LINES_SQL, lines, read, samples, samples_sql

_L = f"WITH RECURSIVE {LINES_SQL}"
#: Sample points of straight lines every 20 units, and the share within a buffer of another line.
_PTS = """pt AS (SELECT id, kind, n, k, x0 + (x1 - x0) * (k / n::DOUBLE) AS px, y0 + (y1 - y0) * (k / n::DOUBLE) AS py FROM
  (SELECT *, unnest(range(0, n + 1)) AS k FROM (SELECT *, greatest(1, ceil(sqrt(pow((x1 - x0)::DOUBLE, 2) + pow((y1 - y0)::DOUBLE, 2)) / 20 - 1e-9))::BIGINT AS n FROM {src})))"""
_TT = "greatest(0, least(1, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / nullif(pow((x1 - x0)::DOUBLE, 2) + pow((y1 - y0)::DOUBLE, 2), 0)))"
_COV = """{out} AS (SELECT a, b, count(*) / (n + 1)::DOUBLE AS share FROM (SELECT pt.id AS a, l.id AS b, n, px, py, x0, y0, x1, y1, coalesce(""" + _TT + """, 0) AS t FROM {pt} pt JOIN {lines} l ON l.kind = pt.kind)
  WHERE pow(px - x0 - t * (x1 - x0), 2) + pow(py - y0 - t * (y1 - y0), 2) <= {b2} GROUP BY a, b, n)"""
_SELF = _PTS.format(src="lines") + ", " + _COV.format(out="cov", pt="pt", lines="lines", b2=3600)


@query("j5_coverage", f"{_L}, {_SELF} SELECT a, b, round(share, 9) AS share FROM cov")
def j5_coverage(spark, sf_dir):
    rows = lines(spark, sf_dir)
    # As DuckDB rounds; F.round goes through decimal text, which is slow for so many rows.
    return X.coverage(rows, rows, 60.0, 20.0).select("a", "b", (F.floor(F.col("share") * 1e9 + 0.5) / 1e9).alias("share"))


_DEDUP = f"""{_L}, {_SELF}, e AS (SELECT l1.id AS better, l2.id AS worse FROM cov JOIN lines l2 ON l2.id = cov.a JOIN lines l1 ON l1.id = cov.b WHERE share > 0.5 AND (-l1.score, l1.id) < (-l2.score, l2.id)),
o AS (SELECT id, row_number() OVER (ORDER BY -score, id) AS r FROM lines),
g AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL
  SELECT o.r, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.worse = o.id AND list_contains(g.kept, e.better)) THEN g.kept ELSE list_append(g.kept, o.id) END FROM g JOIN o ON o.r = g.r + 1)
SELECT unnest(kept) AS id FROM g WHERE r = (SELECT count(*) FROM lines)"""


@query("t4_dedup_segments", _DEDUP)
def t4_dedup_segments(spark, sf_dir):
    """Best score first; a line more than half covered by a kept one of its kind goes."""
    rows = U.first_of_equal(lines(spark, sf_dir), F.struct((-F.col("score")).alias("s"), "id"), "kind", "x0", "y0", "x1", "y1")
    rows = U.kept_table(rows, "lines")
    rank = rows.select("id", F.struct((-F.col("score")).alias("s"), "id").alias("rank"))
    covered = X.coverage(rows, rows, 60.0, 20.0).where("share > 0.5 AND a <> b")
    edges = covered.join(rank.toDF("a", "ra"), "a").join(rank.toDF("b", "rb"), "b").where("rb < ra")
    return U.greedy_keep(rows, edges.select(F.col("b").alias("better"), F.col("a").alias("worse")))


_TRACKS = f"""{_L}, e AS (SELECT p.id AS better, q.id AS worse FROM lines p JOIN lines q ON (p.score, p.id) < (q.score, q.id) AND pow(p.x0 - q.x0, 2) + pow(p.y0 - q.y0, 2) < 625),
o AS (SELECT id, row_number() OVER (ORDER BY score, id) AS r FROM lines),
g AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL
  SELECT o.r, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.worse = o.id AND list_contains(g.kept, e.better)) THEN g.kept ELSE list_append(g.kept, o.id) END FROM g JOIN o ON o.r = g.r + 1)
SELECT unnest(kept) AS id FROM g WHERE r = (SELECT count(*) FROM lines)"""


def close_points(rows, distance: float):
    """``(p, q)``: pairs of points ``(id, px, py, rank)`` nearer than a distance, the better first."""
    cell = distance
    here = rows.withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    there = here.withColumn("dx", around).withColumn("dy", around)
    there = there.withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cy", F.col("cy") + F.col("dy")).drop("dx", "dy")
    a, b = here.alias("a"), there.alias("b")
    square = F.pow(F.col("a.px") - F.col("b.px"), 2) + F.pow(F.col("a.py") - F.col("b.py"), 2)
    both = a.join(b, (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")))
    return both.where((F.col("a.rank") < F.col("b.rank")) & (square < distance * distance)).select(F.col("a.id").alias("better"), F.col("b.id").alias("worse"))


@query("t5_track_duplicates", _TRACKS)
def t5_track_duplicates(spark, sf_dir):
    """Of points nearer than 25 the one with the smallest gap stays."""
    rows = lines(spark, sf_dir).select("id", F.col("x0").alias("px"), F.col("y0").alias("py"), F.struct("score", "id").alias("rank"))
    return U.greedy_keep(rows, close_points(rows, 25.0))


@query("t6_circuit_spacing", _TRACKS.replace("(p.score, p.id) < (q.score, q.id) AND", "p.kind % 3 = q.kind % 3 AND (greatest(0, ceil((p.score - 20) / 50.0)), -abs(p.x1), p.id) < (greatest(0, ceil((q.score - 20) / 50.0)), -abs(q.x1), q.id) AND").replace("< 625", "< 10000").replace("ORDER BY score, id", "ORDER BY greatest(0, ceil((score - 20) / 50.0)), -abs(x1), id"))
def t6_circuit_spacing(spark, sf_dir):
    """One circuit of a size class within 100, by grade band, then length, then identifier."""
    band = F.greatest(F.lit(0), F.ceil((F.col("score") - 20) / 50.0))
    rows = lines(spark, sf_dir).select("id", F.col("x0").alias("px"), F.col("y0").alias("py"), (F.col("kind") % 3).alias("size"), F.struct(band.alias("band"), (-F.abs("x1")).alias("l"), "id").alias("rank"))
    near = close_points(rows, 100.0).join(rows.select(F.col("id").alias("better"), F.col("size").alias("s1")), "better").join(rows.select(F.col("id").alias("worse"), F.col("size").alias("s2")), "worse")
    return U.greedy_keep(rows, near.where("s1 = s2"))


#: The next version: every line moved a little, some cut to three quarters, some gone.
_NEXT = """cur AS (SELECT id + 1000000 AS id, kind, x0 + 3 AS x0, y0 - 2 AS y0, CASE WHEN id % 4 = 0 THEN x0 + floor((x1 - x0) * 3 / 4.0)::BIGINT ELSE x1 END + 3 AS x1,
  CASE WHEN id % 4 = 0 THEN y0 + floor((y1 - y0) * 3 / 4.0)::BIGINT ELSE y1 END - 2 AS y1 FROM lines WHERE id % 7 != 0)"""


def next_version(rows):
    cut = lambda c: F.when(F.col("id") % 4 == 0, F.col(f"{c}0") + F.floor((F.col(f"{c}1") - F.col(f"{c}0")) * 3 / F.lit(4.0))).otherwise(F.col(f"{c}1"))
    out = rows.where("id % 7 <> 0").select((F.col("id") + 1_000_000).alias("id"), "kind", (F.col("x0") + 3).alias("x0"), (F.col("y0") - 2).alias("y0"), (cut("x") + 3).alias("x1"), (cut("y") - 2).alias("y1"))
    return out


_VP = f"{_L}, {_NEXT}, " + _PTS.format(src="cur").replace("pt AS", "pc AS", 1) + ", " + _PTS.format(src="lines").replace("pt AS", "pp AS", 1) + ", " + _COV.format(out="there", pt="pc", lines="lines", b2=225) + ", " + _COV.format(out="back", pt="pp", lines="cur", b2=225) + ", v AS (SELECT there.a AS cur, there.b AS prev, there.share AS cs, back.share AS ps FROM there JOIN back ON back.a = there.b AND back.b = there.a)"


def version_pairs(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return V.pairs(next_version(rows), rows, 15.0, 20.0)


@query("v1_pairs", f"{_VP} SELECT cur, prev, round(cs, 9) AS cur_share, round(ps, 9) AS prev_share FROM v")
def v1_pairs(spark, sf_dir):
    return version_pairs(spark, sf_dir).select("cur", "prev", F.round("cur_share", 9).alias("cur_share"), F.round("prev_share", 9).alias("prev_share"))


_MATCH = f"""{_VP}, o AS (SELECT cur, prev, row_number() OVER (ORDER BY -least(cs, ps), -greatest(cs, ps), cur, prev) AS r FROM v WHERE least(cs, ps) >= 0.8),
g AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS cs, []::BIGINT[] AS ps UNION ALL
  SELECT o.r, CASE WHEN list_contains(g.cs, o.cur) OR list_contains(g.ps, o.prev) THEN g.cs ELSE list_append(g.cs, o.cur) END,
    CASE WHEN list_contains(g.cs, o.cur) OR list_contains(g.ps, o.prev) THEN g.ps ELSE list_append(g.ps, o.prev) END FROM g JOIN o ON o.r = g.r + 1),
m AS (SELECT unnest(cs) AS cur, unnest(ps) AS prev FROM g WHERE r = (SELECT count(*) FROM o))"""


@query("t7_lineage_match", f"{_MATCH} SELECT * FROM m")
def t7_lineage_match(spark, sf_dir):
    return V.match(version_pairs(spark, sf_dir))


_ALIAS = f"{_MATCH}, al AS (SELECT prev, arg_min(cur, (-ps, cur)) AS cur FROM v WHERE ps >= 0.3 AND prev NOT IN (SELECT prev FROM m) GROUP BY prev)"


@query("v3_alias", f"{_ALIAS} SELECT * FROM al")
def v3_alias(spark, sf_dir):
    found = U.kept_table(version_pairs(spark, sf_dir), "pairs")
    return V.aliases(found, V.match(found))


_REDIRECT = f"{_ALIAS}, ls AS (SELECT id, al.cur AS target FROM lines LEFT JOIN al ON al.prev = id WHERE id NOT IN (SELECT prev FROM m)), old AS (SELECT -id AS id, id AS target FROM lines WHERE id % 5 = 0), rd AS (SELECT * FROM ls UNION ALL SELECT old.id, coalesce(m.cur, ls.target) FROM old LEFT JOIN m ON m.prev = old.target LEFT JOIN ls ON ls.id = old.target)"


def version_redirects(spark, sf_dir):
    rows = lines(spark, sf_dir)
    found = U.kept_table(version_pairs(spark, sf_dir), "pairs")
    matched = U.kept_table(V.match(found), "matched")
    earlier = rows.where("id % 5 = 0").select((-F.col("id")).alias("id"), F.col("id").alias("target"))
    return V.redirects(rows, matched, V.aliases(found, matched), earlier), matched


@query("v5_redirects", f"{_REDIRECT} SELECT * FROM rd")
def v5_redirects(spark, sf_dir):
    return version_redirects(spark, sf_dir)[0]


@query("v6_resolve", f"{_REDIRECT} SELECT cur AS id, 'live' AS status, cur AS target FROM m UNION ALL SELECT id, CASE WHEN target IS NULL THEN 'retired' ELSE 'moved' END, target FROM rd")
def v6_resolve(spark, sf_dir):
    redirect, matched = version_redirects(spark, sf_dir)
    live = matched.select(F.col("cur").alias("id"), F.lit(True).alias("live"), F.lit(None).cast("bigint").alias("target"))
    return V.resolve(live.union(redirect.select("id", F.lit(False), "target")))


@query("v4_free_suffix", "WITH w AS (SELECT c_custkey AS r, 'flat-' || substr(sha1((c_custkey % 50)::VARCHAR), 1, 12) AS base FROM customer), u AS (SELECT DISTINCT base, 1 AS n FROM w UNION SELECT DISTINCT base, 3 FROM w), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY r) AS k FROM w) SELECT r AS \"row\", base || '-' || CASE WHEN k = 1 THEN 2 ELSE k + 2 END AS id FROM k")
def v4_free_suffix(spark, sf_dir):
    key = F.concat(F.lit("flat-"), F.substring(F.sha1((F.col("c_custkey") % 50).cast("string")), 1, 12))
    new = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), key.alias("id"))
    taken = new.select("id").distinct()
    taken = taken.union(taken.select(F.concat("id", F.lit("-3"))))
    return V.free_suffix(new, taken)


@query(
    "j3_j4_containing",
    f"{_L}, r AS (SELECT id AS ring_id, least(x0, x1) AS a, greatest(x0, x1) AS b, least(y0, y1) AS c, greatest(y0, y1) AS d FROM lines WHERE x0 != x1 AND y0 != y1), p AS (SELECT id, x0 + 0.25 AS px, y0 + 0.25 AS py FROM lines) "
    "SELECT id, arg_min(ring_id, ((b - a) * (d - c), ring_id)) AS ring_id FROM p JOIN r ON px > a AND px < b AND py > c AND py < d GROUP BY id",
)
def j3_j4_containing(spark, sf_dir):
    """The smallest rectangle around each point."""
    from .geometry import bent

    rows = bent(spark, sf_dir)
    points = rows.select("id", (F.col("x0") + 0.25).alias("px"), (F.col("y0") + 0.25).alias("py"))
    rings = rows.where("x0 <> x1 AND y0 <> y1").select(F.col("id").alias("ring_id"), "ring", geo.ring_area(F.col("ring")).alias("area"))
    return X.smallest_containing(points, rings, 200.0)


@query(
    "j6_bilinear",
    "WITH g AS (SELECT r, c, 2 * c + 3 * r + 5 + CASE WHEN r = 7 AND c = 7 THEN NULL ELSE 0 END AS z FROM range(40) AS a(r), range(40) AS b(c)), p AS (SELECT c_custkey AS id, (c_custkey * 7 % 380) / 10.0::DOUBLE AS cx, (c_custkey * 11 % 380) / 10.0::DOUBLE AS ry FROM customer) "
    "SELECT id, CASE WHEN floor(cx)::INT IN (6, 7) AND floor(ry)::INT IN (6, 7) THEN NULL ELSE round(2 * cx + 3 * ry + 5, 6) END AS z FROM p",
)
def j6_bilinear(spark, sf_dir):
    """Heights of a plane with one missing pixel; bilinear sampling is exact on it."""
    cell = spark.range(1600).select(F.floor(F.col("id") / 40).alias("row"), (F.col("id") % 40).alias("col"))
    cells = cell.withColumn("z", F.when(~((F.col("row") == 7) & (F.col("col") == 7)), 2 * F.col("col") + 3 * F.col("row") + 5).cast("double"))
    key = F.col("c_custkey")
    points = read(spark, sf_dir, "customer").select(key.alias("id"), (key * 7 % 380 / F.lit(10.0)).alias("col"), (key * 11 % 380 / F.lit(10.0)).alias("row"))
    return X.bilinear(points, cells).select("id", F.round("z", 6).alias("z"))


_CTE = samples_sql()


@query("j7_parts_overlap", f"WITH {_CTE}, s AS (SELECT stroke_id, max(d) * 0.2::DOUBLE AS a, max(d) * 0.7::DOUBLE AS b FROM samples GROUP BY stroke_id) SELECT s.stroke_id, count(*) AS n_parts, round(sum(least(d + 5, b) - greatest(d, a)), 6) AS overlap_m FROM s JOIN samples USING (stroke_id) WHERE least(d + 5, b) - greatest(d, a) > 0 GROUP BY s.stroke_id")
def j7_parts_overlap(spark, sf_dir):
    rows = samples(spark, sf_dir)
    spans = rows.groupBy("stroke_id").agg((F.max("d") * F.lit(0.2)).alias("a"), (F.max("d") * F.lit(0.7)).alias("b"))
    overlap = F.least(F.col("d") + 5, F.col("b")) - F.greatest(F.col("d"), F.col("a"))
    return rows.join(spans, "stroke_id").where(overlap > 0).groupBy("stroke_id").agg(F.count("*").alias("n_parts"), F.round(F.sum(overlap), 6).alias("overlap_m"))


@query("j8_events_inside", f"WITH {_CTE}, s AS (SELECT stroke_id, 50.0::DOUBLE AS a, max(d) - 50 AS b FROM samples GROUP BY stroke_id) SELECT s.stroke_id, count(*) FILTER (event_type = 'purchase') AS n_crossings, count(*) FILTER (event_type = 'click') AS n_junctions FROM s JOIN samples USING (stroke_id) WHERE d > a AND d < b GROUP BY s.stroke_id")
def j8_events_inside(spark, sf_dir):
    """Events strictly inside; one on an end isn't counted."""
    rows = samples(spark, sf_dir)
    spans = rows.groupBy("stroke_id").agg(F.lit(50.0).alias("a"), (F.max("d") - 50).alias("b"))
    inside = rows.join(spans, "stroke_id").where("d > a AND d < b")
    return inside.groupBy("stroke_id").agg(F.count_if(F.col("event_type") == "purchase").alias("n_crossings"), F.count_if(F.col("event_type") == "click").alias("n_junctions"))


@query("a7_compare", f"{_VP}, c AS (SELECT id, abs(x1 - x0) + abs(y1 - y0) AS len, coalesce(max(cs), 0) AS s FROM cur LEFT JOIN v ON v.cur = id GROUP BY ALL), p AS (SELECT id, abs(x1 - x0) + abs(y1 - y0) AS len, coalesce(max(ps), 0) AS s FROM lines LEFT JOIN v ON v.prev = id GROUP BY ALL) SELECT (SELECT round(sum(len * s) / sum(len), 9) FROM p) AS kept, (SELECT round(sum(len * s) / sum(len), 9) FROM c) AS found")
def a7_compare(spark, sf_dir):
    from ..operators.reports import compare

    rows = lines(spark, sf_dir)
    found = U.kept_table(version_pairs(spark, sf_dir), "pairs")
    length = (F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0"))).cast("double").alias("length_m")

    def side(df, key, share):
        best = found.groupBy(F.col(key).alias("id")).agg(F.max(share).alias("share"))
        return df.select("id", length).join(best, "id", "left").select("length_m", F.coalesce("share", F.lit(0.0)).alias("share"))

    both = compare(side(rows, "prev", "prev_share"), side(next_version(rows), "cur", "cur_share"))
    return both.select(F.round("kept", 9).alias("kept"), F.round("found", 9).alias("found"))
