"""Detection as one operator against a plain model that looks at every window by itself."""

from __future__ import annotations

import math
import random

import pytest

from ridgeflow.operators import detect as D
from ridgeflow.params import Params


@pytest.fixture(scope="module")
def rows():
    """Strokes of their own steps with flats, climbs, gaps and a bridge; one stroke has one sample."""
    rng = random.Random(5)
    out = [("one", 0, 0.0, 0.0, 0.0, 5.0, None)]
    for name, step, n in (("a", 5.0, 420), ("b", 4.6, 460), ("c", 4.9, 300)):
        z, grade = 100.0, 0.0
        for i in range(n):
            if i % 45 == 0:
                grade = rng.choice((0.0, 0.2, 4.0, -5.0, 6.0, 0.0, -4.0))
            z += step * grade / 100
            bend = 40 * math.sin(i / 9) if 200 < i < 260 else 0.0
            missing = i in (50, 51, 52) or name == "c" and 100 <= i < 120
            out.append((name, i, i * step, i * step, bend + {"a": 0.0, "b": 9.0, "c": 900.0}[name], None if missing else z, "bridge" if 150 <= i < 153 else None))
    return out


@pytest.fixture(scope="module")
def profile(spark, rows):
    df = spark.createDataFrame(rows, "stroke_id string, i bigint, d double, x double, y double, z double, structure string")
    return D.kept_table(D.build_profile(df), "profile")


def model(rows, params):
    """Stretches of one stroke's profile, each window judged from its own samples."""
    rows = sorted(rows, key=lambda r: r.i)
    step, last = rows[1].d, len(rows) - 1
    count = lambda length: max(1, round(length / step))
    grade = [r.grade for r in rows]

    def longest(flags):
        best = run = 0
        for f in flags:
            run = run + 1 if f else 0
            best = max(best, run)
        return best

    def valid(kind, a, n):
        rules, inside = kind.rules, range(a, a + n + 1)
        if any(rows[j].z is None for j in inside):
            return False
        p, q = rows[a], rows[a + n]
        chord = math.hypot(q.x - p.x, q.y - p.y)
        if chord == 0 or (q.d - p.d) / chord > rules.max_sinuosity:
            return False
        mean = kind.sign * 100 * (q.z - p.z) / (q.d - p.d)
        if kind.name == "flat":
            return all(grade[j] is not None and abs(grade[j]) <= rules.max_local_grade_pct for j in inside) and abs(mean) <= rules.max_mean_grade_pct
        run = longest(flat(kind, j) for j in inside)
        return rules.min_mean_grade_pct <= mean <= rules.max_mean_grade_pct and run * step <= rules.max_flat_stretch_m + 1e-9

    def flat(kind, j):
        return grade[j] is None or kind.sign * grade[j] < kind.rules.min_local_grade_pct

    found = {}
    for kind in D.kinds(params):
        n = count(min(kind.rules.target_lengths_m))
        stride = count(params.window_step_m)
        starts = [a for a in range(last - n + 1) if (a % stride == 0 or a == last - n) and valid(kind, a, n)]
        covered = set()
        for a in starts:
            covered.update((j, j + 1) for j in range(a, a + n))
        edges = sorted(covered)
        groups = []
        for e in edges:
            if groups and groups[-1][1] == e[0]:
                groups[-1][1] = e[1]
            else:
                groups.append([*e])
        for lo, hi in groups:
            pieces = [(lo, hi)]
            if kind.name != "flat":
                most = math.floor((kind.rules.max_flat_stretch_m + 1e-9) / step)
                keep, j = [True] * (hi + 1), lo
                while j <= hi:
                    k = j
                    while k <= hi and flat(kind, k):
                        k += 1
                    if k - j > most:
                        keep[j:k] = [False] * (k - j)
                    j = max(k, j + 1)
                pieces, j = [], lo
                while j <= hi:
                    k = j
                    while k <= hi and keep[k]:
                        k += 1
                    steep = [m for m in range(j, k) if not flat(kind, m)]
                    if steep and steep[-1] - steep[0] >= n:
                        pieces.append((steep[0], steep[-1]))
                    j = max(k, j + 1)
            for a, b in pieces:
                fits = [round(t) for t in kind.rules.target_lengths_m if any(valid(kind, s, count(t)) for s in range(a, b - count(t) + 1))]
                found[kind.name, kind.sign, a, b] = sorted(fits)
    return found


def test_stretches_and_targets(spark, profile):
    params = Params()
    known = D.kept_table(D.evaluated(profile, params), "windows")
    parts = spark.createDataFrame([("a", 0, 7, 0.0, 900.0, "paved", "yes", "Quay", "path", None), ("a", 1, 8, 900.0, 5000.0, "gravel", "no", None, "track", "bridge")], "stroke_id string, part int, way_id long, start_m double, end_m double, surface string, lit string, name string, highway string, structure string")
    events = spark.createDataFrame([("a", 400.0, "crossing"), ("a", 410.0, "junction")], "stroke_id string, offset_m double, kind string")
    got = D.segments(D.stretches(known, params), known, parts, events, params).collect()
    by_stroke = {}
    for r in profile.collect():
        by_stroke.setdefault(r.stroke_id, []).append(r)
    want = {(s, *k): v for s, rows in by_stroke.items() if len(rows) > 1 for k, v in model(rows, params).items()}
    assert {(r.stroke_id, r.kind, r.sign, r.start, r.end): r.fits_targets_m for r in got} == want
    assert {k[1] for k in want} >= {"flat", "climb"} and any(v for v in want.values())
    for r in got:
        rows = sorted(by_stroke[r.stroke_id], key=lambda x: x.i)[r.start : r.end + 1][:: r.sign]
        assert r.elev_start_m == rows[0].z and r.elev_end_m == rows[-1].z
        assert (r.grade_mean_pct > 0) or r.kind == "flat"
        assert ("bridge_interpolated" in r.quality_flags) == any(x.bridge_mask for x in rows)
        assert r.n_crossings == (r.stroke_id == "a" and r.stroke_start_m < 400 < r.stroke_end_m)
        if r.stroke_id != "a":
            assert (r.surface, r.osm_way_ids, r.on_structure) == ("unknown", [], False)
        elif r.stroke_start_m < 900 < r.stroke_end_m:
            assert r.osm_way_ids == [7, 8][:: r.sign] and r.on_structure


def test_suppression_takes_the_best_of_neighbours(spark, profile):
    params = Params()
    known = D.kept_table(D.evaluated(profile, params), "windows")
    empty = lambda schema: spark.createDataFrame([], schema)
    parts = empty("stroke_id string, part int, way_id long, start_m double, end_m double, surface string, lit string, name string, highway string, structure string")
    found = D.kept_table(D.segments(D.stretches(known, params), known, parts, empty("stroke_id string, offset_m double, kind string"), params), "segments")
    places = {(r.stroke_id, r.i): (r.x, r.y) for r in profile.collect()}
    kept = []
    for r in sorted(found.collect(), key=lambda r: (-r.score, r.stroke_id, -r.sign, r.start)):
        points = [places[r.stroke_id, i] for i in range(r.start, r.end + 1)]
        if not any(k == r.kind and share(points, line) > 0.5 for k, line, _ in kept):
            kept.append((r.kind, points, r.uid))
    got = {r.uid for r in D.suppressed(found, known, params).collect()}
    assert got == {u for *_, u in kept} and len(got) < found.count()


def share(points, line, buffer=20.0):
    def distance(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    return sum(any(distance(p, a, b) <= buffer for a, b in zip(line, line[1:], strict=False)) for p in points) / len(points)
