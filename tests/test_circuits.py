"""Cycles, shared areas, settings, pruning, answers and profile tables on small cases."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ridgeflow.functions import geo
from ridgeflow.functions import text as X
from ridgeflow.operators import circuits as C
from ridgeflow.operators import spatial, suppress
from ridgeflow.sinks.profiles import markdown_table, write_profiles
from ridgeflow.sources import answers as A
from ridgeflow.sources.profiles import read_profiles

_RING = "array<struct<x: double, y: double>>"


def square(x, y, w, h=None):
    h = w if h is None else h
    return [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]


def points(ring):
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def test_cycles_split_at_repeated_nodes(spark):
    # A figure of eight through node 1 with a dead end at node 3, and a walk that is simple.
    eight = [(10, 1), (12, 2), (14, 3), (16, 9), (17, 3), (18, 1), (20, 4), (22, 5)]
    rows = [(1, k, h, t) for k, (h, t) in enumerate(eight)] + [(2, k, 50 + 2 * k, k) for k in range(3)]
    found = C.simple_cycles(spark.createDataFrame(rows, "walk long, pos int, half long, tail long")).collect()
    cycles = {}
    for r in sorted(found, key=lambda r: (r.walk, r.cycle, r.pos)):
        cycles.setdefault((r.walk, r.cycle), []).append(r.half)
    assert sorted(cycles.values()) == [[10, 12, 17], [14, 16], [18, 20, 22], [50, 52, 54]]
    nodes = dict(eight)
    for (walk, _), halves in cycles.items():
        if walk == 1:
            assert len({nodes[h] for h in halves}) == len(halves)


def test_shared_area_is_exact():
    corner = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)]
    assert C.shared_area(points(corner), points(square(0, 0, 2))) == pytest.approx(3.0)
    assert C.shared_area(points(square(0, 0, 2)), points([(1, -1), (3, 1), (1, 3), (-1, 1), (1, -1)])) == pytest.approx(4.0)
    assert C.shared_area(points(square(0, 0, 1)), points(square(1, 0, 1))) == 0.0
    assert C.shared_area(points([(0, 0), (1, 1)]), points(square(0, 0, 9))) == 0.0


def test_shared_area_against_drawn_points():
    rng = random.Random(3)

    def inside(p, ring):
        found = False
        for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
            if (y0 > p[1]) != (y1 > p[1]) and p[0] < x0 + (p[1] - y0) * (x1 - x0) / (y1 - y0):
                found = not found
        return found

    def star():
        import math

        corners = [(5 + rng.uniform(1, 5) * math.cos(k * 0.7), 5 + rng.uniform(1, 5) * math.sin(k * 0.7)) for k in range(9)]
        return [*corners, corners[0]]

    for _ in range(4):
        a, b = star(), star()
        drawn = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(20_000)]
        share = 100 * sum(inside(p, a) and inside(p, b) for p in drawn) / len(drawn)
        assert C.shared_area(points(a), points(b)) == pytest.approx(share, abs=1.5)


def test_settings_and_kept(spark):
    rows = [(1, square(0, 0, 10), None, 0.0), (2, square(100, 0, 10), "own", 0.0), (3, square(200, 0, 10), None, 0.6), (4, square(300, 0, 10), None, 0.1)]
    candidates = spark.createDataFrame(rows, f"id long, ring {_RING}, name string, track_share double")
    areas = spark.createDataFrame([(1, "water", "lake", square(0, 0, 10, 1.6)), (2, "park", "garden", square(100, 0, 10, 3)), (3, "green", None, square(100, 5, 10, 1.5))], f"area_id long, kind string, name string, ring {_RING}")
    found = {r.id: (r.setting, r.name) for r in C.settings(candidates, areas, 50.0).collect()}
    assert found == {1: ("water", None), 2: ("park", "own"), 3: ("countryside", None), 4: ("neighbourhood", None)}
    measured = spark.createDataFrame([(1, "face", "water", 0.0, 9, 1.0, 0.0), (2, "lap", "park", 0.0, 9, 1.0, 0.0), (3, "face", "neighbourhood", 0.9, 1, 500.0, 0.5), (4, "face", "neighbourhood", 0.9, 2, 500.0, 0.5), (5, "face", "park", 1.0, 0, 500.0, 0.5)], "id long, source string, setting string, car_free double, n_crossings int, length_m double, compactness double")
    assert sorted(r.id for r in C.kept_circuits(measured).collect()) == [1, 2, 3]


def test_equal_rings_are_measured_once(spark, monkeypatch):
    """4,000 copies of a candidate and of an area: their 16 million pairs are never made for a setting; each pair of shapes is measured once."""
    ring = F.lit(None).cast(_RING)
    make = lambda n, r: spark.range(n).withColumn("ring", F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in r)) if r else ring)
    many = make(4000, square(0, 0, 10)).select("id", "ring", F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("track_share"))
    areas = make(4000, square(0, 0, 10, 0.001)).select(F.col("id").alias("area_id"), F.lit("water").alias("kind"), F.lit("lake").alias("name"), "ring")
    found = C.settings(many, areas, 3.0)
    assert found.count() == found.where("setting = 'water' AND name IS NULL").count() == 4000
    assert C.settings(make(1, None).select("id", "ring", F.lit("own").alias("name"), F.lit(0.6).alias("track_share")), areas).first().setting == "countryside"


def test_overlaps_of_any_shapes(spark):
    rng = random.Random(4)
    some = [square(rng.randrange(20), rng.randrange(20), rng.randrange(1, 9), rng.randrange(1, 9)) for _ in range(12)]
    some += [[(float(x), float(y)) for x, y in ((a, b), (a + 5, b + 1), (a + 3, b + 6), (a, b))] for a, b in ((1, 1), (9, 4), (12, 12))]
    some += [list(reversed(some[0])), some[1], [(0.0, 0.0), (5.0, 5.0), (5.0, 0.0), (0.0, 5.0), (0.0, 0.0)], [(0.0, 0.0), (4.0, 0.0), (4.0, 0.0), (0.0, 0.0), (0.0, 0.0)]]
    df = spark.createDataFrame(list(enumerate(some)), f"id long, ring {_RING}")
    found = {(r.id, r.area_id): r.shared for r in C.overlaps(df, df.withColumnRenamed("id", "area_id"), 4.0).collect()}
    expected = {(i, j): share for i, a in enumerate(some) for j, b in enumerate(some) if (share := C.shared_area(points(a), points(b))) > 0}
    assert found.keys() == expected.keys() and all(found[k] == pytest.approx(v) for k, v in expected.items())


def test_smallest_containing_of_any_shapes(spark):
    rng = random.Random(6)
    some = [square(rng.randrange(30), rng.randrange(30), rng.randrange(1, 30), rng.randrange(1, 30)) for _ in range(40)]
    some += [[(float(x), float(y)) for x, y in ((a, b), (a + 9, b + 1), (a + 3, b + 8), (a, b))] for a, b in ((1, 1), (9, 4), (12, 12))] + some[:3]
    where = [(i, rng.randrange(40) + 0.25, rng.randrange(40) + 0.75) for i in range(300)]
    rings = spark.createDataFrame(list(enumerate(some)), f"ring_id long, ring {_RING}").withColumn("area", geo.ring_area(F.col("ring")))
    found = {r.id: r.ring_id for r in spatial.smallest_containing(spark.createDataFrame(where, "id long, px double, py double"), rings, 10.0).collect()}
    size = {r.ring_id: (r.area, r.ring_id) for r in rings.collect()}

    def inside(x, y, ring):
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:])) % 2 == 1

    held = {i: [size[k] for k, ring in enumerate(some) if inside(x, y, ring)] for i, x, y in where}
    assert found == {i: min(v)[1] for i, v in held.items() if v}


def test_smallest_containing_of_nested_rings(spark):
    """30,000 points in 30,000 nested squares: the 900 million pairs are never made."""
    r = F.col("id") / 1000.0 + 100.0
    corner = lambda a, b: F.struct((r * a).alias("x"), (r * b).alias("y"))
    rings = spark.range(30_000).select(F.col("id").alias("ring_id"), F.array(*(corner(a, b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)))).alias("ring")).withColumn("area", geo.ring_area(F.col("ring")))
    points = spark.range(30_000).select("id", (F.col("id") % 90 + 0.5).alias("px"), (F.col("id") % 70 + 0.5).alias("py"))
    found = spatial.smallest_containing(points, rings, 100.0)
    assert found.where("ring_id = 0").count() == found.count() == 30_000


def test_coverage_counts_points(spark):
    rng = random.Random(9)
    rows = [(f"l{i:02}", rng.randrange(2), *(rng.randrange(-150, 150) for _ in range(4))) for i in range(40)]
    rows += [("p", 0, 5, 5, 5, 5), ("q", 0, 5, 5, 5, 5), ("r", None, 1, 1, 9, 9), ("s", 1, *rows[0][2:])]
    df = spark.createDataFrame(rows, "id string, kind int, x0 long, y0 long, x1 long, y1 long")
    expected = {}
    for a, kind, x0, y0, x1, y1 in rows:
        n = max(1, math.ceil(math.hypot(x1 - x0, y1 - y0) / 20 - 1e-9))
        for b, other, u0, v0, u1, v1 in rows:
            dx, dy, c = u1 - u0, v1 - v0, 0
            for k in range(n + 1):
                px, py = x0 + (x1 - x0) * (k / n), y0 + (y1 - y0) * (k / n)
                t = min(1, max(0, ((px - u0) * dx + (py - v0) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
                c += math.hypot(px - u0 - t * dx, py - v0 - t * dy) <= 30
            if c and kind == other and kind is not None:
                expected[a, b] = c / (n + 1)
    for cell in (None, 17.0):
        assert {(r.a, r.b): r.share for r in spatial.coverage(df, df, 30.0, 20.0, cell).collect()} == expected


def test_copies_of_a_long_line_are_compared_once(spark):
    """2,000 copies of a line of 20 km: four million rows, from one pair of shapes and not from four billion points."""
    copies = spark.range(2000).selectExpr("id", "1 AS kind", "0D AS x0", "0D AS y0", "20000D AS x1", "100D AS y1")
    found = spatial.coverage(copies, copies, 60.0, 20.0)
    assert found.where("share = 1").count() == found.count() == 4_000_000


def test_first_of_equal_rows(spark):
    rows = [(1, 5, 0), (2, 7, 0), (3, 7, 0), (4, 1, 1), (5, 9, None), (6, 9, None)]
    df = spark.createDataFrame(rows, "id long, score long, k int")
    assert sorted(r.id for r in suppress.first_of_equal(df, F.struct(-F.col("score"), "id"), "k").collect()) == [2, 4, 5, 6]


def test_circuits_along_removed_stretches_go(spark):
    parts = spark.createDataFrame([("a", 0, 7, 0.0, 40.0), ("a", 1, 8, 40.0, 60.0), ("b", 0, 7, 0.0, 0.0)], "stroke_id string, part int, way_id long, start_m double, end_m double")
    gone = C.removed_stretches(parts, spark.createDataFrame([(8,)], "way_id long")).collect()
    assert [(r.stroke_id, r.start_m, r.end_m) for r in gone] == [("a", 0.0, 40.0)]
    loops = spark.createDataFrame([(1, "circuit", square(0, 0, 100)), (2, "track", square(0, 0, 100)), (3, "circuit", square(0, 50, 100))], f"id long, loop_type string, line {_RING}")
    stretches = spark.createDataFrame([(1, [(10.0, 1.0), (60.0, 1.0)]), (2, [(20.0, 40.0), (20.0, 56.0)])], f"stretch_id long, line {_RING}")
    assert sorted(r.id for r in C.prune_circuits(loops, stretches).collect()) == [2, 3]


def test_answers(spark):
    heights = [json.dumps({"elevations": [{"lon": 1.0, "lat": 2.0, "z": z} for z in zs]}) for zs in ([1.0, 2.0, 3.0, 4.0, -99999.0], [1.0, -99999.0], [1.0])]
    texts = [*heights, "no json", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.e for r in df.select("id", A.elevations(F.col("t")).alias("e")).collect()}
    assert [p.z for p in got[0]] == [1.0, 2.0, 3.0, 4.0, None] and [got[i] for i in (1, 2, 3, 4)] == [None] * 4
    assert all(r.r is None and r.p == [] for r in df.select(A.route(F.col("t")).alias("r"), A.places(F.col("t")).alias("p")).collect())


def test_profiles_and_reports(spark, tmp_path):
    rows = [("a", 0, 1.0, "fine"), ("a", 1, None, "fine"), ("b", 0, 5.0, "coarse"), ("c", 0, 2.0, "fine")]
    df = spark.createDataFrame(rows, "stroke_id string, i long, z double, elevation_source string")
    path = f"file://{tmp_path}/p"
    write_profiles(df, path, 5.0)
    found, step, main = read_profiles(spark, path)
    assert sorted(map(tuple, found.select(df.columns).collect()), key=str) == sorted(rows, key=str) and (step, main) == (5.0, "fine")
    spark.read.parquet(path).withColumn("step_m", F.lit(4.0)).limit(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="mixed steps"):
        read_profiles(spark, path)
    assert markdown_table(spark.createDataFrame([(1, "x")], "a int, b string")) == "| a | b |\n|---|---|\n| 1 | x |"


def test_dates(spark):
    days = ["2026-10-12", "2026-10-11", "2026-10-08", "2026-02-03", None]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(X.relative_date(F.to_date("d"), F.lit("2026-10-12").cast("date")).alias("x"))
    assert [r.x for r in df.collect()] == ["aujourd'hui", "hier", "il y a 4 jours", "3 févr. 2026", ""]


@pytest.mark.parametrize("odd", (False, True))
def test_settings_sum_pairs_where_they_are_found(spark, odd):
    """Names of one shape and of several, copies, null names and null rings, against a plain sum over all pairs."""
    rng = random.Random(9)
    box = lambda: tuple(rng.randrange(0, 40) for _ in range(2)) + (rng.randrange(4, 9), rng.choice((1, 2)))
    left = [(i, box()) for i in range(40)]
    left += [(100 + i, left[i][1]) for i in range(5)]
    right = [(i, rng.choice(("water", "park", "green", "other")), rng.choice((None, "n1", "n2", f"own {i}", f"own {i % 3} x")), box()) for i in range(40)]
    right += [(100 + i, kind, rng.choice((name, "copy")), r) for i, kind, name, r in right[:15]]
    expected = {}
    for i, (x, y, a, h) in left:
        sums, names = {"water": 0.0, "green": 0.0}, {}
        for _, kind, name, (p, q, c, k) in right:
            w, v = min(x + a, p + c) - max(x, p), min(y + a * h, q + c * k) - max(y, q)
            if w > 0 and v > 0:
                kind = "green" if kind == "park" else kind
                sums[kind] = sums.get(kind, 0) + w * v
                if name and 5 * w * v > a * a * h:
                    names[name] = names.get(name, 0) + w * v
        size = a * a * h
        setting = "water" if 100 * sums["water"] >= 15 * size else "park" if 10 * sums["green"] >= 4 * size else "neighbourhood"
        expected[i] = (setting, min(names, key=lambda n: (-names[n], n)) if names else None)
    ring = lambda x, y, a, h: square(x, y, a, a * h)
    one = [(i, ring(*r), None, 0.0) for i, r in left] + [(900, None, None, 0.6)]
    two = [(i, kind, name, ring(*r)) for i, kind, name, r in right] + [(900, "water", "nowhere", None)]
    if odd:  # a triangle far away: shapes other than rectangles go corner by corner
        two.append((901, "water", "far", [(900.0, 900.0), (901.0, 900.0), (900.0, 901.0), (900.0, 900.0)]))
    candidates, areas = spark.createDataFrame(one, f"id long, ring {_RING}, name string, track_share double"), spark.createDataFrame(two, f"area_id long, kind string, name string, ring {_RING}")
    found = C.settings(candidates, areas, 10.0)
    rows = found.collect()
    assert {r.id: (r.setting, r.name) for r in rows} == {**expected, 900: ("countryside", None)}
    assert len(rows) == 46 and set(rows[0].asDict()) == {"id", "ring", "name", "track_share", "setting"}
    assert ("area(" in found._jdf.queryExecution().optimizedPlan().toString()) == odd  # rectangles have no pairs for Python
