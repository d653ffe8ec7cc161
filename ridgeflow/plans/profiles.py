"""Queries on elevation profiles: filling, smoothing, grades, gain."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import profile as P
from ..registry import query
from ..sources.tables import gapped, samples, samples_sql

_CTE = samples_sql()
_PAD = """n AS (SELECT *, max(i) OVER (PARTITION BY stroke_id) AS n, first(z) OVER (PARTITION BY stroke_id ORDER BY i) AS z0,
    last(z) OVER (PARTITION BY stroke_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z1 FROM {source}),
t AS (SELECT *, greatest(2 * n, 1) AS period, unnest(range(-8, 9)) AS m FROM n),
pad AS (SELECT * FROM (SELECT stroke_id, n, i + m * period AS i, CASE WHEN m = 0 THEN z ELSE z + 2 * m * (z1 - z0) END AS v, m = 0 AND z IS NOT NULL AS own FROM t
    UNION ALL SELECT stroke_id, n, m * period - i, 2 * z0 - z + 2 * m * (z1 - z0), false FROM t WHERE i > 0 AND i < n) WHERE i BETWEEN -{p} AND n + {p})"""
#: Samples with gaps, and the same cut into strokes of one to four samples.
_GAPPED = "gapped AS (SELECT stroke_id, i, d, CASE WHEN event_type != 'error' THEN z END AS z FROM samples)"
_SHORT = "short AS (SELECT stroke_id * 1000 + i // 4 AS stroke_id, i % 4 AS i, 5.0::DOUBLE * (i % 4) AS d, z FROM samples)"


def short(spark, sf_dir):
    rows = samples(spark, sf_dir)
    return rows.select((F.col("stroke_id") * 1000 + F.floor(F.col("i") / 4)).alias("stroke_id"), (F.col("i") % 4).alias("i"), (5.0 * (F.col("i") % 4)).alias("d"), "z")


@query("c4_samples", f"WITH {_CTE} SELECT stroke_id, i, d, round(z, 9) AS z FROM samples")
def c4_samples(spark, sf_dir):
    return samples(spark, sf_dir).select("stroke_id", "i", "d", F.round("z", 9).alias("z"))


_FILL = f"""WITH {_CTE}, g AS (SELECT stroke_id, i, d, CASE WHEN event_type != 'error' THEN z END AS z,
    CASE event_type WHEN 'signup' THEN 'bridge' WHEN 'logout' THEN 'tunnel' END AS structure FROM samples),
m AS (SELECT *, CASE WHEN structure IS NULL THEN z END AS zi FROM g),
k AS (SELECT *, max(CASE WHEN zi IS NOT NULL THEN i END) OVER (PARTITION BY stroke_id ORDER BY i) AS li,
    min(CASE WHEN zi IS NOT NULL THEN i END) OVER (PARTITION BY stroke_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri FROM m),
o AS (SELECT *, bool_or(structure IS NOT NULL) OVER (PARTITION BY stroke_id, li, ri, zi IS NULL) AS on_s FROM k),
f AS (SELECT o.*, l.d AS ld, r.d AS rd, l.zi AS lz, r.zi AS rz FROM o
    LEFT JOIN m l ON l.stroke_id = o.stroke_id AND l.i = o.li LEFT JOIN m r ON r.stroke_id = o.stroke_id AND r.i = o.ri),
v AS (SELECT *, CASE WHEN zi IS NULL AND (on_s OR rd - ld <= 20) THEN lz + (rz - lz) * ((d - ld) / (rd - ld)) ELSE zi END AS zf FROM f)
SELECT stroke_id, i, round(zf, 9) AS z_filled, zi IS NULL AND zf IS NOT NULL AND coalesce(structure = 'bridge', false) AS bridge_mask,
    zi IS NULL AND zf IS NOT NULL AND coalesce(structure = 'tunnel', false) AS tunnel_mask,
    zi IS NULL AND zf IS NOT NULL AND structure IS NULL AS gap_mask FROM v"""


@query("w11_fill_profile", _FILL)
def w11_fill_profile(spark, sf_dir):
    filled = P.fill_profile(gapped(spark, sf_dir))
    return filled.select("stroke_id", "i", F.round("z_filled", 9).alias("z_filled"), "bridge_mask", "tunnel_mask", "gap_mask")


def _median_sql(cte: str, source: str) -> str:
    return (
        f"WITH {_CTE}, {cte}, {_PAD.format(source=source, p=1)}, q AS (SELECT *, median(v) OVER (PARTITION BY stroke_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM pad) "
        "SELECT stroke_id, i, CASE WHEN own THEN round(m, 9) END AS z_median FROM q WHERE i BETWEEN 0 AND n"
    )


_KERNEL = ", ".join(f"({k}, {math.exp(-0.5 * (k / 2.0) ** 2)!r}::DOUBLE)" for k in range(-6, 7))


def _gaussian_sql(cte: str, source: str) -> str:
    return (
        f"WITH {_CTE}, {cte}, {_PAD.format(source=source, p=6)}, k(o, w) AS (VALUES {_KERNEL}) "
        "SELECT a.stroke_id, a.i, CASE WHEN a.own THEN round(sum(w * b.v) / sum(w) FILTER (b.v IS NOT NULL), 9) END AS z_smooth FROM pad a, k, pad b "
        "WHERE a.i BETWEEN 0 AND a.n AND b.stroke_id = a.stroke_id AND b.i = a.i + k.o GROUP BY a.stroke_id, a.i, a.own"
    )


def _median(df):
    return P.rolling_median(df, 3).select("stroke_id", F.col("i").cast("bigint").alias("i"), F.round("z_median", 9).alias("z_median"))


def _gaussian(df):
    return P.gaussian_smooth(df, 2.0).select("stroke_id", F.col("i").cast("bigint").alias("i"), F.round("z_smooth", 9).alias("z_smooth"))


@query("w12_rolling_median", _median_sql(_GAPPED, "gapped"))
def w12_rolling_median(spark, sf_dir):
    """Strokes with missing samples, which stay missing."""
    return _median(gapped(spark, sf_dir))


@query("w12_short_strokes", _median_sql(_SHORT, "short"))
def w12_short_strokes(spark, sf_dir):
    return _median(short(spark, sf_dir))


@query("w13_gaussian", _gaussian_sql(_GAPPED, "gapped"))
def w13_gaussian(spark, sf_dir):
    """Strokes with missing samples, which stay missing."""
    return _gaussian(gapped(spark, sf_dir))


@query("w13_short_strokes", _gaussian_sql(_SHORT, "short"))
def w13_short_strokes(spark, sf_dir):
    """Strokes shorter than the pad, reflected again and again."""
    return _gaussian(short(spark, sf_dir))


_GRADE = """g AS (SELECT a.stroke_id, a.i, a.d, a.z, 100 * (h.z - l.z) / (h.d - l.d) AS grade FROM
    (SELECT *, max(i) OVER (PARTITION BY stroke_id) AS n FROM samples) a
    JOIN samples l ON l.stroke_id = a.stroke_id AND l.i = greatest(a.i - 2, 0)
    JOIN samples h ON h.stroke_id = a.stroke_id AND h.i = least(a.i + 2, a.n))"""


@query("w14_local_grade", f"WITH {_CTE}, {_GRADE} SELECT stroke_id, i, round(grade, 9) AS grade FROM g")
def w14_local_grade(spark, sf_dir):
    return P.local_grade(samples(spark, sf_dir)).select("stroke_id", "i", F.round("grade", 9).alias("grade"))


_GAIN = f"""WITH RECURSIVE {_CTE}, m AS (SELECT stroke_id, max(i) AS n FROM samples GROUP BY stroke_id),
r AS (SELECT stroke_id, i, z AS ref, 0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss FROM samples WHERE i = 0
  UNION ALL SELECT s.stroke_id, s.i, CASE WHEN abs(s.z - r.ref) >= 0.5 THEN s.z ELSE r.ref END,
    r.gain + CASE WHEN s.z - r.ref >= 0.5 THEN s.z - r.ref ELSE 0 END, r.loss + CASE WHEN s.z - r.ref <= -0.5 THEN r.ref - s.z ELSE 0 END
  FROM r JOIN samples s ON s.stroke_id = r.stroke_id AND s.i = r.i + 1)
SELECT r.stroke_id, round(gain + greatest(s.z - ref, 0), 9) AS gain, round(loss + greatest(ref - s.z, 0), 9) AS loss
FROM r JOIN m ON m.stroke_id = r.stroke_id AND m.n = r.i JOIN samples s ON s.stroke_id = r.stroke_id AND s.i = r.i"""


@query("a3_gain_loss", _GAIN)
def a3_gain_loss(spark, sf_dir):
    rows = samples(spark, sf_dir).groupBy("stroke_id").agg(F.array_sort(F.collect_list(F.struct("i", "z"))).alias("s"))
    rows = rows.select("stroke_id", P.gain_loss(F.col("s.z"), 0.5).alias("x"))
    return rows.select("stroke_id", F.round("x.gain", 9).alias("gain"), F.round("x.loss", 9).alias("loss"))


@query(
    "a4_steepest",
    f"WITH {_CTE} SELECT a.stroke_id, " + ", ".join(f"round(max((SELECT max((b.z - c.z) * 100.0 / {n * 5}.0) FROM samples b JOIN samples c ON c.stroke_id = b.stroke_id AND c.i = b.i - {n} WHERE b.stroke_id = a.stroke_id)), 9) AS steep_{n * 5}_pct" for n in (20, 40, 80)) + " FROM samples a GROUP BY a.stroke_id",
)
def a4_steepest(spark, sf_dir):
    rows = P.steepest(samples(spark, sf_dir), (100, 200, 400))
    return rows.select("stroke_id", *(F.round(c, 9).alias(c) for c in rows.columns[1:]))


@query(
    "a5_grade_stats",
    f"WITH {_CTE}, {_GRADE} SELECT stroke_id, round(avg(grade), 9) AS grade_mean, round(max(abs(grade)), 9) AS grade_max, round(stddev_pop(grade), 9) AS grade_std FROM g GROUP BY stroke_id",
)
def a5_grade_stats(spark, sf_dir):
    rows = P.local_grade(samples(spark, sf_dir))
    return rows.groupBy("stroke_id").agg(
        F.round(F.avg("grade"), 9).alias("grade_mean"),
        F.round(F.max(F.abs("grade")), 9).alias("grade_max"),
        F.round(F.stddev_pop("grade"), 9).alias("grade_std"),
    )


@query(
    "j12_nearest_sample",
    f"WITH {_CTE}, t AS (SELECT stroke_id, max(d) * 0.37::DOUBLE AS x FROM samples GROUP BY stroke_id), "
    "b AS (SELECT t.stroke_id, x, max(d) FILTER (d <= x) AS lo, min(d) FILTER (d >= x) AS hi FROM t JOIN samples USING (stroke_id) GROUP BY ALL) "
    "SELECT b.stroke_id, round(x, 9) AS x, round(CASE WHEN hi = lo THEN l.z ELSE l.z + (h.z - l.z) * (x - lo) / (hi - lo) END, 9) AS z_at "
    "FROM b JOIN samples l ON l.stroke_id = b.stroke_id AND l.d = lo JOIN samples h ON h.stroke_id = b.stroke_id AND h.d = hi",
)
def j12_nearest_sample(spark, sf_dir):
    rows = samples(spark, sf_dir)
    at = rows.groupBy("stroke_id").agg((F.max("d") * F.lit(0.37)).alias("x"))
    both = rows.join(at, "stroke_id").groupBy("stroke_id", "x").agg(
        F.max_by(F.struct("d", "z"), F.when(F.col("d") <= F.col("x"), F.col("d"))).alias("l"),
        F.min_by(F.struct("d", "z"), F.when(F.col("d") >= F.col("x"), F.col("d"))).alias("h"),
    )
    slope = (F.col("h.z") - F.col("l.z")) * (F.col("x") - F.col("l.d")) / (F.col("h.d") - F.col("l.d"))
    z = F.when(F.col("h.d") == F.col("l.d"), F.col("l.z")).otherwise(F.col("l.z") + slope)
    return both.select("stroke_id", F.round("x", 9).alias("x"), F.round(z, 9).alias("z_at"))


@query(
    "w17_profile_bands",
    f"WITH {_CTE}, b AS (SELECT stroke_id, floor(d / 50)::BIGINT AS band, min(d) AS d0, max(d) AS d1, arg_min(z, d) AS z0, arg_max(z, d) AS z1 FROM samples GROUP BY ALL), "
    "c AS (SELECT *, CASE WHEN d1 > d0 THEN 100 * (z1 - z0) / (d1 - d0) ELSE 0 END AS g FROM b) "
    "SELECT stroke_id, band, round(g, 9) AS band_grade, CASE WHEN abs(g) < 1 THEN 0 WHEN abs(g) < 3 THEN 1 WHEN abs(g) < 6 THEN 2 ELSE 3 END AS grade_class FROM c",
)
def w17_profile_bands(spark, sf_dir):
    rows = samples(spark, sf_dir).groupBy("stroke_id", F.floor(F.col("d") / 50).alias("band"))
    rows = rows.agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.min_by("z", "d").alias("z0"), F.max_by("z", "d").alias("z1"))
    g = F.when(F.col("d1") > F.col("d0"), 100 * (F.col("z1") - F.col("z0")) / (F.col("d1") - F.col("d0"))).otherwise(0.0)
    kind = F.when(F.abs(F.col("g")) < 1, 0).when(F.abs(F.col("g")) < 3, 1).when(F.abs(F.col("g")) < 6, 2).otherwise(3)
    return rows.withColumn("g", g).select("stroke_id", "band", F.round("g", 9).alias("band_grade"), kind.alias("grade_class"))
