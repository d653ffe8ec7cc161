"""Queries of stretch detection: windows, masks, intervals, targets, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.scores import score_climb, score_flat
from ..operators import profile as P
from ..params import Params, samples_for
from ..registry import query
from ..sources.tables import samples, samples_sql
from .profiles import _GRADE

_P = Params()
_N = samples_for(_P.flat.target_lengths_m[0], 5.0)
_STRIDE = samples_for(_P.window_step_m, 5.0)
#: Heights are scaled so that the default thresholds find stretches of the kind.
_FLAT_SCALE, _CLIMB_SCALE = 80_000, 10_000
_CTE = f"WITH RECURSIVE {samples_sql(_FLAT_SCALE)}, {_GRADE}"
_CTEC = f"WITH RECURSIVE {samples_sql(_CLIMB_SCALE)}, {_GRADE}"


def _win(n: int) -> str:
    return f"""w{n} AS (SELECT a.stroke_id, a.i AS "start", a.i + {n} AS "end", 100 * (b.z - a.z) / (b.d - a.d) AS mean_grade, a.mx AS max_grade FROM
    (SELECT *, max(abs(grade)) OVER (PARTITION BY stroke_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n} FOLLOWING) AS mx FROM g) a
    JOIN g b ON b.stroke_id = a.stroke_id AND b.i = a.i + {n})"""


_STRIDED = f"""st AS (SELECT * FROM (SELECT *, max("start") OVER (PARTITION BY stroke_id) AS lst FROM w{_N}) WHERE "start" % {_STRIDE} = 0 OR "start" = lst)"""
_FLAT = """fm AS (SELECT stroke_id, "start", "end" FROM st WHERE abs(mean_grade) <= 1 AND max_grade <= 2)"""
_MERGED = """mk AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY stroke_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM fm),
mi AS (SELECT *, sum(nw) OVER (PARTITION BY stroke_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS isl FROM mk),
flats AS (SELECT stroke_id, min("start") AS "start", max("end") AS "end" FROM mi GROUP BY stroke_id, isl)"""


def graded(spark, sf_dir, scale=_FLAT_SCALE):
    return P.local_grade(samples(spark, sf_dir, scale))


def flat_windows(df, n: int):
    """Windows of ``n`` intervals that meet the flat criteria; strokes here are straight."""
    windows = P.sliding_windows(df, n)
    return windows.where((F.abs("mean_grade") <= _P.flat.max_mean_grade_pct) & (F.col("max_grade") <= _P.flat.max_local_grade_pct))


def flat_stretches(df):
    """Maximal flat stretches of every stroke."""
    windows = P.strided(P.sliding_windows(df, _N), _STRIDE)
    mask = (F.abs("mean_grade") <= _P.flat.max_mean_grade_pct) & (F.col("max_grade") <= _P.flat.max_local_grade_pct)
    return P.merge_intervals(windows.where(mask))


@query("w1_window_starts", f"{_CTE}, {_win(_N)}, {_STRIDED} SELECT stroke_id, \"start\" FROM st")
def w1_window_starts(spark, sf_dir):
    ends = samples(spark, sf_dir, _FLAT_SCALE).groupBy("stroke_id").agg(F.max("i").alias("hi")).where(F.col("hi") >= _N)
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), F.col("hi") - _N, F.lit(_STRIDE).cast("bigint")), F.array(F.col("hi") - _N)))
    return ends.select("stroke_id", F.explode(starts).alias("start"))


@query("w2_sliding_windows", f"{_CTE}, {_win(_N)} SELECT stroke_id, \"start\", \"end\", round(mean_grade, 9) AS mean_grade, round(max_grade, 9) AS max_grade FROM w{_N}")
def w2_sliding_windows(spark, sf_dir):
    rows = P.sliding_windows(graded(spark, sf_dir), _N)
    return rows.select("stroke_id", "start", "end", F.round("mean_grade", 9).alias("mean_grade"), F.round("max_grade", 9).alias("max_grade"))


@query("w3_flat_mask", f"{_CTE}, {_win(_N)}, {_STRIDED}, {_FLAT} SELECT * FROM fm")
def w3_flat_mask(spark, sf_dir):
    windows = P.strided(P.sliding_windows(graded(spark, sf_dir), _N), _STRIDE)
    return windows.where("abs(mean_grade) <= 1 AND max_grade <= 2").select("stroke_id", "start", "end")


@query("w6_merge_intervals", f"{_CTE}, {_win(_N)}, {_STRIDED}, {_FLAT}, {_MERGED} SELECT * FROM flats")
def w6_merge_intervals(spark, sf_dir):
    return flat_stretches(graded(spark, sf_dir))


_TARGETS = [samples_for(t, 5.0) for t in _P.flat.target_lengths_m]
_FITS = " UNION ALL ".join(f'SELECT f.stroke_id, f."start", f."end", {n * 5} AS t FROM flats f JOIN w{n} w ON w.stroke_id = f.stroke_id AND w."start" >= f."start" AND w."end" <= f."end" WHERE abs(mean_grade) <= 1 AND max_grade <= 2' for n in _TARGETS)
_ALL = ", ".join(_win(n) for n in _TARGETS)


def fits_targets(df, stretches):
    """Stretches with ``fits``: the target lengths of which a valid window lies inside."""
    ids = ["stroke_id", "start", "end"]
    found = []
    for n in _TARGETS:
        windows = flat_windows(df, n).select("stroke_id", F.col("start").alias("a"), F.col("end").alias("b"))
        inside = stretches.join(windows, "stroke_id").where("a >= start AND b <= end")
        found.append(inside.select(*ids, F.lit(n * 5).alias("target")).distinct())
    fits = reduce(lambda x, y: x.union(y), found).groupBy(*ids).agg(F.array_sort(F.collect_list("target")).alias("fits"))
    return stretches.join(fits, ids, "left").withColumn("fits", F.coalesce("fits", F.array().cast("array<int>")))


@query("w10_fits_targets", f"{_CTE}, {_ALL}, {_STRIDED}, {_FLAT}, {_MERGED}, ft AS ({_FITS}) SELECT stroke_id, \"start\", \"end\", string_agg(DISTINCT t::VARCHAR, ',' ORDER BY t::VARCHAR) AS fits FROM ft GROUP BY ALL")
def w10_fits_targets(spark, sf_dir):
    df = graded(spark, sf_dir)
    rows = fits_targets(df, flat_stretches(df)).where(F.size("fits") > 0)
    return rows.select("stroke_id", "start", "end", F.concat_ws(",", F.array_sort(F.transform("fits", lambda t: t.cast("string")))).alias("fits"))


@query(
    "c1_detect_flats",
    f"{_CTE}, {_ALL}, {_STRIDED}, {_FLAT}, {_MERGED}, ft AS ({_FITS}), "
    """nf AS (SELECT stroke_id, "start", "end", count(DISTINCT t) AS n_fits FROM ft GROUP BY ALL),
    a AS (SELECT f.stroke_id, f."start", f."end", coalesce(max(n_fits), 0) AS n_fits, max(g.d) - min(g.d) AS length_m,
        100 * (arg_max(g.z, g.i) - arg_min(g.z, g.i)) / (max(g.d) - min(g.d)) AS gm, max(abs(grade)) AS gx
        FROM flats f LEFT JOIN nf ON nf.stroke_id = f.stroke_id AND nf."start" = f."start" AND nf."end" = f."end"
        JOIN g ON g.stroke_id = f.stroke_id AND g.i BETWEEN f."start" AND f."end" GROUP BY f.stroke_id, f."start", f."end")
    SELECT stroke_id, "start", "end", length_m, n_fits, round(gm, 9) AS grade_mean_pct, round(gx, 9) AS grade_max_pct,
        round(100 * (0.35 * least(1, greatest(0, 1 - 0.5 * abs(gm) - 0.25 * gx)) + 0.20 + 0.25 + 0.10 * 0.5 + 0.05 * 0.3 + 0.05 * n_fits / 3.0::DOUBLE), 4) AS score FROM a""",
)
def c1_detect_flats(spark, sf_dir):
    """All flat stretches with length, grades, fitting targets and score."""
    df = graded(spark, sf_dir)
    stretches = fits_targets(df, flat_stretches(df))
    inside = stretches.join(df, "stroke_id").where("i BETWEEN start AND end")
    rows = inside.groupBy("stroke_id", "start", "end", F.size("fits").cast("bigint").alias("n_fits")).agg(
        (F.max("d") - F.min("d")).alias("length_m"),
        (100 * (F.max_by("z", "i") - F.min_by("z", "i")) / (F.max("d") - F.min("d"))).alias("gm"),
        F.max(F.abs("grade")).alias("gx"),
    )
    score = score_flat(F.col("gm"), F.col("gx"), F.lit(1.0), F.lit(0), F.col("length_m"), F.lit("unknown"), F.lit("unknown"), F.col("n_fits"), _P.flat)
    return rows.select("stroke_id", "start", "end", "length_m", "n_fits", F.round("gm", 9).alias("grade_mean_pct"), F.round("gx", 9).alias("grade_max_pct"), F.round(score, 4).alias("score"))


_CN = samples_for(_P.climb.target_lengths_m[0], 5.0)
_SIGNS = """sg AS (SELECT stroke_id, sign, i, z, d, sign * grade AS g, NOT coalesce(sign * grade >= 1, false) AS flat FROM g, (VALUES (1), (-1)) AS t(sign)),
fr AS (SELECT stroke_id, sign, min(i) AS a, max(i) + 1 AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY stroke_id, sign ORDER BY i) AS isl FROM sg WHERE flat) GROUP BY stroke_id, sign, isl)"""
_CW = f"""cw AS (SELECT s.*, sign FROM (SELECT * FROM (SELECT *, max("start") OVER (PARTITION BY stroke_id) AS lst FROM w{_CN}) WHERE "start" % {_STRIDE} = 0 OR "start" = lst) s, (VALUES (1), (-1)) AS t(sign)),
lw AS (SELECT cw.stroke_id, cw.sign, cw."start", cw."end", any_value(mean_grade) AS mean_grade, coalesce(max(least(b, "end" + 1) - greatest(a, "start")) FILTER (a <= "end" AND b > "start"), 0) AS longest
    FROM cw LEFT JOIN fr ON fr.stroke_id = cw.stroke_id AND fr.sign = cw.sign GROUP BY cw.stroke_id, cw.sign, cw."start", cw."end"),
cm AS (SELECT stroke_id, sign, "start", "end" FROM lw WHERE sign * mean_grade >= 3 AND sign * mean_grade <= 50 AND longest * 5 <= 20)"""
_CM = """ck AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY stroke_id, sign ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM cm),
ci AS (SELECT *, sum(nw) OVER (PARTITION BY stroke_id, sign ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS isl FROM ck),
cs AS (SELECT stroke_id, sign, min("start") AS "start", max("end") AS "end" FROM ci GROUP BY stroke_id, sign, isl)"""
_CUT = """cc AS (SELECT cs.stroke_id, cs.sign, cs."start", cs."end", greatest(a, cs."start") AS a, least(b, cs."end" + 1) AS b FROM cs JOIN fr ON fr.stroke_id = cs.stroke_id AND fr.sign = cs.sign AND fr.a <= cs."end" AND fr.b > cs."start"
    WHERE least(b, cs."end" + 1) - greatest(a, cs."start") > 4),
e0 AS (SELECT stroke_id, sign, "start", "end", "start" AS lo FROM cs UNION ALL SELECT stroke_id, sign, "start", "end", b FROM cc),
e1 AS (SELECT e0.*, coalesce((SELECT min(a) - 1 FROM cc WHERE cc.stroke_id = e0.stroke_id AND cc.sign = e0.sign AND cc."start" = e0."start" AND cc.a >= e0.lo), e0."end") AS hi FROM e0),
pc AS (SELECT stroke_id, sign, lo AS "start", hi AS "end" FROM e1 WHERE hi > lo)"""
_TRIM = f"""tr AS (SELECT pc.stroke_id, pc.sign, min(i) AS "start", max(i) AS "end" FROM pc JOIN sg ON sg.stroke_id = pc.stroke_id AND sg.sign = pc.sign AND NOT flat AND i BETWEEN pc."start" AND pc."end"
    GROUP BY pc.stroke_id, pc.sign, pc."start", pc."end" HAVING max(i) - min(i) >= {_CN})"""


def signed(df):
    """The samples once a direction, with ``flat``: not climbing enough; a missing grade is flat."""
    rows = df.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    rows = rows.withColumn("g", F.col("sign") * F.col("grade"))
    return rows.withColumn("flat", ~F.coalesce(F.col("g") >= _P.climb.min_local_grade_pct, F.lit(False)))


def climb_windows(df):
    both = signed(df)
    flats = P.true_runs(both, F.col("flat"), "stroke_id", "sign")
    windows = P.strided(P.sliding_windows(df, _CN), _STRIDE).withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    windows = P.longest_run_in_windows(windows, flats, "stroke_id", "sign")
    mean = F.col("sign") * F.col("mean_grade")
    valid = mean.between(_P.climb.min_mean_grade_pct, _P.climb.max_mean_grade_pct) & (F.col("longest") * 5 <= _P.climb.max_flat_stretch_m + 1e-9)
    return both, flats, windows, windows.where(valid)


def climb_pieces(df):
    both, flats, _, valid = climb_windows(df)
    merged = P.merge_intervals(valid, "stroke_id", "sign")
    return both, P.split_at_long_runs(merged, flats, int(_P.climb.max_flat_stretch_m / 5.0 + 1e-9), "stroke_id", "sign")


@query("w7_true_runs", f"{_CTEC}, {_SIGNS} SELECT stroke_id, sign, a AS run_start, b AS run_stop FROM fr")
def w7_true_runs(spark, sf_dir):
    return P.true_runs(signed(graded(spark, sf_dir, _CLIMB_SCALE)), F.col("flat"), "stroke_id", "sign")


@query("w5_longest_run", f"{_CTEC}, {_win(_CN)}, {_SIGNS}, {_CW} SELECT stroke_id, sign, \"start\", \"end\", longest FROM lw")
def w5_longest_run(spark, sf_dir):
    return climb_windows(graded(spark, sf_dir, _CLIMB_SCALE))[2].select("stroke_id", "sign", "start", "end", "longest")


@query("w4_climb_mask", f"{_CTEC}, {_win(_CN)}, {_SIGNS}, {_CW} SELECT * FROM cm")
def w4_climb_mask(spark, sf_dir):
    return climb_windows(graded(spark, sf_dir, _CLIMB_SCALE))[3].select("stroke_id", "sign", "start", "end")


@query("w8_split_long_runs", f"{_CTEC}, {_win(_CN)}, {_SIGNS}, {_CW}, {_CM}, {_CUT} SELECT * FROM pc")
def w8_split_long_runs(spark, sf_dir):
    return climb_pieces(graded(spark, sf_dir, _CLIMB_SCALE))[1]


@query("w9_trim", f"{_CTEC}, {_win(_CN)}, {_SIGNS}, {_CW}, {_CM}, {_CUT}, {_TRIM} SELECT * FROM tr")
def w9_trim(spark, sf_dir):
    both, pieces = climb_pieces(graded(spark, sf_dir, _CLIMB_SCALE))
    return P.trim_flat_ends(pieces, both.where("NOT flat").select("stroke_id", "sign", "i"), _CN, "stroke_id", "sign")


@query(
    "c2_detect_climbs",
    f"{_CTEC}, {_win(_CN)}, {_SIGNS}, {_CW}, {_CM}, {_CUT}, {_TRIM}, "
    """a AS (SELECT tr.stroke_id, tr.sign, tr."start", tr."end", max(d) - min(d) AS length_m, tr.sign * 100 * (arg_max(z, i) - arg_min(z, i)) / (max(d) - min(d)) AS gm, stddev_pop(g) AS sd
        FROM tr JOIN sg ON sg.stroke_id = tr.stroke_id AND sg.sign = tr.sign AND i BETWEEN tr."start" AND tr."end" GROUP BY tr.stroke_id, tr.sign, tr."start", tr."end")
    SELECT stroke_id, sign, "start", "end", length_m, round(gm, 9) AS grade_mean_pct, round(sd, 9) AS grade_std_pct,
        round(100 * (0.35 * CASE WHEN gm > 0 THEN least(1, greatest(0, 1 - sd / gm)) ELSE 0 END + 0.30 + 0.10 + 0.15 * 0.5 + 0.05 * 0.3 + 0.05 * 0.25), 4) AS score FROM a""",
)
def c2_detect_climbs(spark, sf_dir):
    """All climbs in both directions with grades and score (one fitting target assumed)."""
    both, pieces = climb_pieces(graded(spark, sf_dir, _CLIMB_SCALE))
    climbs = P.trim_flat_ends(pieces, both.where("NOT flat").select("stroke_id", "sign", "i"), _CN, "stroke_id", "sign")
    rows = climbs.join(both, ["stroke_id", "sign"]).where("i BETWEEN start AND end").groupBy("stroke_id", "sign", "start", "end")
    rows = rows.agg(
        (F.max("d") - F.min("d")).alias("length_m"),
        (F.col("sign") * 100 * (F.max_by("z", "i") - F.min_by("z", "i")) / (F.max("d") - F.min("d"))).alias("gm"),
        F.stddev_pop("g").alias("sd"),
    )
    score = score_climb(F.col("gm"), F.col("sd"), F.lit(1.0), F.lit(0), F.col("length_m"), F.lit("unknown"), F.lit("unknown"), F.lit(1), _P.climb)
    return rows.select("stroke_id", "sign", "start", "end", "length_m", F.round("gm", 9).alias("grade_mean_pct"), F.round("sd", 9).alias("grade_std_pct"), F.round(score, 4).alias("score"))


@query(
    "j15_sweep",
    f"{_CTE}, {_win(_N)}, {_STRIDED}, v AS (SELECT limit_pct, stroke_id, \"start\", \"end\" FROM st, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) AS t(limit_pct) WHERE abs(mean_grade) <= limit_pct AND max_grade <= 2 * limit_pct) "
    "SELECT limit_pct, count(*) AS n_windows, count(DISTINCT stroke_id) AS n_strokes FROM v GROUP BY limit_pct",
)
def j15_sweep(spark, sf_dir):
    """A parameter sweep: windows are made once, the few parameter rows are joined to them."""
    limits = spark.createDataFrame([(0.5,), (1.0,), (2.0,)], "limit_pct double")
    windows = P.strided(P.sliding_windows(graded(spark, sf_dir), _N), _STRIDE)
    rows = windows.join(F.broadcast(limits), F.expr("abs(mean_grade) <= limit_pct AND max_grade <= 2 * limit_pct"))
    return rows.groupBy("limit_pct").agg(F.count("*").alias("n_windows"), F.countDistinct("stroke_id").alias("n_strokes"))
