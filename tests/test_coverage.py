"""Shares of lines near others: by blocks, without joins of the pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa

from ridgeflow.operators import spatial

_LINE = "id string, kind int, x0 double, y0 double, x1 double, y1 double"


def some_lines(rng, n, most=150):
    rows = [(f"l{i:03}", rng.randrange(2), *(float(rng.randrange(-most, most)) for _ in range(4))) for i in range(n)]
    rows += [(f"c{i}", *rows[0][1:]) for i in range(9)] + [(f"p{i}", 1, 5.0, 5.0, 5.0, 5.0) for i in range(5)]
    return rows


def model(one, two, buffer_m, step):
    """As in the SQL: squares are compared, null or odd values meet nothing."""
    found = {}
    for a, kind, x0, y0, x1, y1 in one:
        for b, other, u0, v0, u1, v1 in two:
            if kind is None or kind != other or any(v is None or math.isnan(v) for v in (x0, y0, x1, y1, u0, v0, u1, v1)):
                continue
            n = max(1, math.ceil(math.sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / step - 1e-9))
            dx, dy, c = u1 - u0, v1 - v0, 0
            for k in range(n + 1):
                px, py = x0 + (x1 - x0) * (k / n), y0 + (y1 - y0) * (k / n)
                t = min(1.0, max(0.0, ((px - u0) * dx + (py - v0) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                ex, ey = px - u0 - t * dx, py - v0 - t * dy
                c += ex * ex + ey * ey <= buffer_m * buffer_m
            if c:
                found[a, b] = c / (n + 1)
    return found


def test_pairs_are_neither_joined_nor_shuffled(spark):
    df = spark.createDataFrame(some_lines(random.Random(1), 10), _LINE)
    plan = spatial.coverage(df, df, 30.0, 20.0)._jdf.queryExecution().optimizedPlan().toString()
    made, _, below = plan.partition("MapInArrow")
    assert below and not any(k in made for k in ("Join", "Repartition", "Aggregate"))


def test_coverage_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LINES", 7)
    rng = random.Random(2)
    one = [*some_lines(rng, 50), ("n", None, 1.0, 1.0, 9.0, 9.0), ("m", 1, None, 5.0, 5.0, 5.0), ("o", 1, float("nan"), 5.0, 5.0, 5.0), ("far", 0, 9000.0, 0.0, 0.0, 9000.0)]
    two = [(f"b{r[0]}", *r[1:]) for r in some_lines(rng, 40)] + one[-4:]
    a, b = (spark.createDataFrame(rows, _LINE) for rows in (one, two))
    for cell in (None, 60.0):
        found = spatial.coverage(a, b, 30.0, 20.0, cell).collect()
        assert {(r.a, r.b): r.share for r in found} == model(one, two, 30.0, 20.0) and len({(r.a, r.b) for r in found}) == len(found)


def test_few_pairs_at_once(monkeypatch):
    rows = sorted(some_lines(random.Random(3), 40), key=lambda r: r[2:])
    block = pa.array([[dict(zip(("id", "x0", "y0", "x1", "y1"), (r[0], *r[2:]), strict=True)) for r in rows[s:e]] for s, e in ((0, 30), (30, len(rows)))])
    one, two = spatial._Lines(block, 0.0), spatial._Lines(block, 31.0)
    both = lambda: {(rows[i][0], rows[j][0]): s for found in spatial._shares(one, two, 30.0, 20.0) for i, j, s in zip(*found, strict=True)}
    of = [(r[0], int(k >= 30), *r[2:]) for k, r in enumerate(rows)]
    expected = model(of, of, 30.0, 20.0)
    assert both() == expected
    monkeypatch.setattr(spatial, "PAIRS", 9)
    assert both() == expected


def test_points_by_stretches_are_those_point_by_point():
    """Any scale, also on whole numbers where many points lie on the rim, and lines without length."""
    rng = np.random.default_rng(5)
    for size, most, step in ((9, 3.0, 1.0), (30, 5.0, 2.0), (400, 60.0, 20.0), (5000, 60.0, 20.0), (40, 0.0, 1.0)):
        for shift, whole in ((0.0, True), (5e6, True), (5e6, False)):
            ends = [rng.uniform(-size, size, (4, 3000)) + shift for _ in range(2)]
            ends = [np.floor(v) if whole else v for v in ends]
            ends[0][2:, :50] = ends[0][:2, :50]
            ends[1][2:, 30:80] = ends[1][:2, 30:80]
            ends[1][3, 100:900], ends[0][3, 100:900] = ends[1][1, 100:900], ends[0][1, 100:900]
            one, two = (spatial._Lines(pa.array([[dict(zip(("x0", "y0", "x1", "y1", "id"), (*v, 0), strict=True))] for v in e.T.tolist()]), 0.0) for e in ends)
            n = np.maximum(1, np.ceil(one.values[4] / step - 1e-9)).astype(np.int64)
            at = np.arange(3000)
            assert (spatial._near_points(one, at, two, at, n, most) == spatial._each_point(n, one.ends, two.ends, most)).all()


def test_parallel_lines_at_the_distance(spark):
    """Rounding decides of each point alone, as it does in the SQL."""
    rng, rows = random.Random(4), []
    for i in range(150):
        p, q, r = rng.choice([(3, 4, 5), (5, 12, 13), (8, 15, 17), (20, 21, 29)])
        x, y, k = (rng.randrange(-200, 200) for _ in range(3))
        u, v = x - q * 60.0 / r, y + p * 60.0 / r
        rows += [(f"a{i}", i % 9, float(x), float(y), float(x + k % 30 * p), float(y + k % 30 * q)), (f"b{i}", i % 9, u, v, u + 12 * p, v + 12 * q)]
    df = spark.createDataFrame(rows, _LINE)
    assert {(r.a, r.b): r.share for r in spatial.coverage(df, df, 60.0, 20.0).collect()} == model(rows, rows, 60.0, 20.0)


def test_no_lines(spark):
    df = spark.createDataFrame([], _LINE)
    assert spatial.coverage(df, df, 60.0, 20.0).collect() == []
