"""Small scenarios and sequential models of the order-dependent operators."""

from __future__ import annotations

import os
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeflow.functions import geo, scores
from ridgeflow.functions import text as X
from ridgeflow.operators import lineage, network, profile, suppress
from ridgeflow.operators.reports import compare
from ridgeflow.params import Params, load_params, samples_for


def stroke(spark, pieces, step=5.0):
    """Samples of a terrain of (length, grade percent) pieces."""
    z, heights = 150.0, [150.0]
    for length, grade in pieces:
        for _ in range(int(length / step)):
            z += step * grade / 100
            heights.append(z)
    rows = [("a", i, i * step, h) for i, h in enumerate(heights)]
    return spark.createDataFrame(rows, "stroke_id string, i bigint, d double, z double")


def test_flat_kilometre_and_bump(spark):
    from ridgeflow.plans.detection import flat_stretches

    flat = flat_stretches(profile.local_grade(stroke(spark, [(1000, 0)]))).collect()
    assert [(r.start, r.end) for r in flat] == [(0, 200)]
    bump = sorted((r.start * 5, r.end * 5) for r in flat_stretches(profile.local_grade(stroke(spark, [(300, 0), (100, 5), (600, 0)]))).collect())
    assert len(bump) == 2
    assert bump[0][0] == 0 and bump[0][1] <= 310 and bump[1][1] == 1000


def test_fill_leaves_ends_and_long_gaps(spark):
    rows = [("a", i, 5.0 * i, None if i in (0, 3, 8, 9, 10, 11, 12) else float(i), "bridge" if i == 5 else None) for i in range(16)]
    df = spark.createDataFrame(rows, "stroke_id string, i bigint, d double, z double, structure string")
    z = {r.i: r for r in profile.fill_profile(df).collect()}
    assert z[0].z_filled is None and z[9].z_filled is None
    assert z[3].z_filled == pytest.approx(3.0) and z[3].gap_mask
    assert z[5].z_filled == pytest.approx(5.0) and z[5].bridge_mask


def test_smoothing_keeps_a_line_straight(spark):
    df = stroke(spark, [(500, 4)])
    for out, name in ((profile.rolling_median(df, 3), "z_median"), (profile.gaussian_smooth(df, 2.0), "z_smooth")):
        both = out.join(df, ["stroke_id", "i"]).select(F.max(F.abs(F.col(name) - F.col("z")))).first()[0]
        assert both < 1e-9


def test_gain_loss_ignores_ripples(spark):
    df = spark.createDataFrame([([0.0, 0.3, 0.1, 2.0, None, 1.8, 0.0, 0.2],), ([],), ([5.0],)], "z array<double>")
    got = [tuple(r.x) for r in df.select(profile.gain_loss(F.col("z"), 0.5).alias("x")).collect()]
    assert got[0] == pytest.approx((2.2, 2.0))
    assert got[1] == got[2] == (0.0, 0.0)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_keep_is_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.08}
    kept = []
    for j in range(n):
        if not any((i, j) in edges for i in kept):
            kept.append(j)
    rows = spark.createDataFrame([(i,) for i in range(n)], "id bigint")
    pairs = spark.createDataFrame(sorted(edges), "better bigint, worse bigint")
    assert sorted(r.id for r in suppress.greedy_keep(rows, pairs).collect()) == kept


@pytest.mark.parametrize("seed", range(3))
def test_greedy_match_is_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(15), rng.randrange(15)) for _ in range(60)]
    pairs = list(dict.fromkeys(pairs))
    used_a, used_b, taken = set(), set(), []
    for a, b in pairs:
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            taken.append((a, b))
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "a bigint, b bigint, rank bigint")
    assert sorted(tuple(r) for r in suppress.greedy_match(df).collect()) == sorted(taken)


@pytest.mark.parametrize("seed", range(3))
def test_chains_are_the_sequential_walk(spark, seed):
    rng = random.Random(seed)
    n = 24
    halves = list(range(2 * n))
    rng.shuffle(halves)
    partner = {}
    while len(halves) > 9:
        a, b = halves.pop(), halves.pop()
        if a >> 1 == b >> 1:
            continue
        partner[a], partner[b] = b, a
    expected, seen = {}, set()
    for e in range(n):
        if e in seen:
            continue
        chain, h = [], 2 * e
        while h is not None and h >> 1 not in {x >> 1 for x in chain}:
            chain.append(h)
            h = partner.get(h ^ 1)
        ring = h is not None
        if not ring:  # what comes before the smallest edge
            h = partner.get(2 * e)
            while h is not None:
                chain.insert(0, h ^ 1)
                h = partner.get(h ^ 1)
        for pos, h in enumerate(chain):
            expected[h >> 1] = (e, pos, h % 2 == 0, ring)
            seen.add(h >> 1)
    edges = spark.createDataFrame([(e,) for e in range(n)], "e bigint")
    pairs = spark.createDataFrame([(a, b) for a, b in partner.items() if a < b], "a bigint, b bigint")
    got = {r.e: (r.stroke, r.pos, r.forward, r.ring) for r in network.chains(edges, pairs).collect()}
    assert got == expected


def test_rounds_of_a_chain_leave_one_table(spark):
    """A line of 600 edges takes ten rounds; only the last one's table stays."""
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    lists = lambda: {x for x in os.listdir(root) if x.startswith("list-")}
    before = lists()
    e = F.col("id")
    chain = network.chains(spark.range(600).select(e.alias("e")), spark.range(599).select((e * 2 + 1).alias("a"), (e * 2 + 2).alias("b")))
    assert [(r.e, r.stroke, r.pos) for r in chain.orderBy("e").collect()] == [(i, 0, i) for i in range(600)]
    assert len(lists() - before) == 1


def test_chains_find_pairs_once_and_need_no_rounds(spark, monkeypatch):
    """A line of 600 edges: each pair is made once, and no round of pointer doubling is written."""
    made, written, replaced = spark.sparkContext.accumulator(0), [], network.replaced
    monkeypatch.setattr(network, "replaced", lambda *a: written.append(a[1]) or replaced(*a))

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    e = F.col("id")
    pairs = spark.range(599).select((e * 2 + 1).alias("a"), (e * 2 + 2).alias("b")).mapInArrow(counted, "a long, b long")
    chain = network.chains(spark.range(600).select(e.alias("e")), pairs)
    assert [(r.e, r.stroke, r.pos, r.forward, r.ring) for r in chain.orderBy("e").collect()] == [(i, 0, i, True, False) for i in range(600)]
    assert made.value == 599 and len(written) <= 1


def test_chains_at_once_are_those_of_rounds(spark, monkeypatch):
    """Lines, rings of one edge and more, an end paired with an edge that isn't there."""
    rng = random.Random(3)
    halves = [h for h in range(2, 400) if h % 17]
    rng.shuffle(halves)
    pairs = [*zip(halves[:300:2], halves[1:300:2], strict=True), (0, 1), (17, 9999)]
    pairs = spark.createDataFrame(pairs, "a long, b long")
    edges = spark.range(200).select(F.col("id").alias("e"))
    found = []
    for most in (network.AT_ONCE, 0):
        monkeypatch.setattr(network, "AT_ONCE", most)
        found.append(sorted(network.chains(edges, pairs).collect()))
    assert found[0] == found[1] and len(found[0]) > 150 and any(r.ring for r in found[0])
    monkeypatch.undo()
    assert network.chains(edges.limit(0), pairs.limit(0)).count() == 0


def test_strokes_of_repeated_edges(spark, monkeypatch):
    """Edges given twice are paired and chained once, and the half-edges of a line are joined with nothing on the way."""
    line = [(i, i, i + 1) for i in range(30)] + [(100 + i, 10, 100 + i) for i in range(4)]
    bearing = {10: {19: 180.0, 20: 0.0, 200: 90.0, 202: 270.0, 204: 45.0, 206: 230.0}}
    found = []
    for rows in (line, line + line[5:15] + line[-4:]):
        edges = spark.createDataFrame(rows, "e long, start_node long, end_node long")
        ends = [(r.half, r.tail, bearing.get(r.tail, {}).get(r.half, 0.0)) for r in network.half_edges(edges).collect()]
        pairs = network.pair_ends(spark.createDataFrame(ends, "half long, tail long, bearing double"), spark.createDataFrame([(3,)], "node_id long"))
        for most in (network.AT_ONCE, 0):
            with monkeypatch.context() as m:
                m.setattr(network, "AT_ONCE", most)
                joins = []
                m.setattr(network, "kept_table", lambda df, label, kept=network.kept_table: joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")) or kept(df, label))
                found.append(sorted(network.chains(edges, pairs).collect()))
                assert most == 0 or joins == [0]
    assert len(found[0]) == 34 and all(f == found[0] for f in found)
    assert {r.stroke for r in found[0]} == {0, 3, 100, 102}


def test_pair_ends_is_the_sequential_greedy(spark):
    rng = random.Random(5)
    ends = [(h, h % 5, float(rng.randrange(0, 360, 5))) for h in range(30)]
    taken = []
    for node in range(5):
        if node == 3:
            continue
        own = [x for x in ends if x[1] == node]
        options = []
        for i, (h, _, b1) in enumerate(own):
            for k, _, b2 in own[i + 1 :]:
                turn = 180 - abs((b1 - b2 + 180) % 360 - 180)
                options.append((abs(turn), h, k))
        used = set()
        for turn, h, k in sorted(options):
            if turn <= 35 and not {h, k} & used:
                used |= {h, k}
                taken.append((h, k))
    df = spark.createDataFrame(ends, "half bigint, tail bigint, bearing double")
    barriers = spark.createDataFrame([(3,)], "node_id bigint")
    assert sorted(tuple(r) for r in network.pair_ends(df, barriers).collect()) == sorted(taken)


def test_pair_ends_of_a_crowded_node(spark):
    """A node of 60,000 ends: its 1.8 billion pairs are never made."""
    half = F.col("id")
    ends = spark.range(60_000).select(half.alias("half"), (half * 0).alias("tail"), F.when(half % 2 == 0, 0.0).otherwise(180.0).alias("bearing"))
    pairs = network.pair_ends(ends, spark.createDataFrame([(3,)], "node_id bigint"))
    assert pairs.where("a % 2 = 0 AND b = a + 1").count() == pairs.count() == 30_000


def test_best_first_ends_is_the_sequential_greedy():
    rng = random.Random(8)
    kinds = [lambda: float(rng.randrange(0, 360, 30)), lambda: rng.random() * 360, lambda: rng.choice([0, 90, 180, 270]) + rng.random() * 2e-9]
    for trial in range(300):
        ends = [(h, kinds[trial % 3]()) for h in rng.sample(range(200), rng.randrange(1, 30))]
        most = rng.choice([35.0, 180.0, -1.0, 0.0])
        options = []
        for h, b1 in ends:
            for k, b2 in ends:
                turn = abs(180 - abs((b1 - b2 + 180) % 360 - 180))
                if h < k and turn <= most:
                    options.append((Decimal(repr(turn)).quantize(Decimal("1e-9"), ROUND_HALF_UP), h, k))
        used, taken = set(), []
        for _, h, k in sorted(options):
            if not {h, k} & used:
                used |= {h, k}
                taken.append((h, k))
        found = network.best_first_ends(np.array([h for h, _ in ends]), np.array([b for _, b in ends]), most)
        assert found == taken


def test_faces_of_a_square_with_a_diagonal(spark):
    import math

    points = {0: (0, 0), 1: (1, 0), 2: (1, 1), 3: (0, 1)}
    edges = [(0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 3, 0), (4, 0, 2)]
    half = []
    for e, a, b in edges:
        for h, s, t in ((2 * e, a, b), (2 * e + 1, b, a)):
            (x0, y0), (x1, y1) = points[s], points[t]
            half.append((h, s, math.atan2(y1 - y0, x1 - x0)))
    df = spark.createDataFrame(half, "half bigint, tail bigint, angle double")
    faces = {}
    for r in network.faces(df).collect():
        faces.setdefault(r.face, set()).add(r.half)
    assert sorted(len(f) for f in faces.values()) == [3, 3, 4]
    assert {0, 2, 9} in faces.values()


def test_two_core_peels_to_the_ring(spark):
    rows = [(0, 0, 1), (1, 1, 2), (2, 2, 0), (3, 2, 3), (4, 3, 4), (5, 9, 9)]
    df = spark.createDataFrame(rows, "e bigint, start_node bigint, end_node bigint")
    assert sorted(r.e for r in network.two_core(df).collect()) == [0, 1, 2, 5]


def test_lineage_of_a_moved_and_a_split_line(spark):
    schema = "id string, kind string, x0 double, y0 double, x1 double, y1 double"
    old = spark.createDataFrame([("p", "flat", 0.0, 0.0, 500.0, 0.0), ("q", "flat", 0.0, 100.0, 1200.0, 100.0)], schema)
    new = spark.createDataFrame([("a", "flat", 3.0, 2.0, 490.0, 2.0), ("b", "flat", 0.0, 100.0, 350.0, 100.0), ("c", "flat", 400.0, 100.0, 850.0, 100.0)], schema)
    found = lineage.pairs(new, old)
    matched = lineage.match(found)
    assert [tuple(r) for r in matched.collect()] == [("a", "p")]
    assert [tuple(r) for r in lineage.aliases(found, matched).collect()] == [("q", "c")]


def test_compare_of_empty_runs_is_one(spark):
    empty = spark.createDataFrame([], "length_m double, share double")
    assert tuple(compare(empty, empty).first()) == (1.0, 1.0)


def test_geometry(spark):
    row = spark.range(1).select(
        geo.lambert93(F.lit(1.54502), F.lit(43.532791)).alias("p"),
        geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"),
        geo.deflection(F.lit(10.0), F.lit(190.0)).alias("straight"),
        scores.unit(F.lit(float("nan"))).alias("nan"),
    ).first()
    assert (row.p.x, row.p.y) == pytest.approx((582351.559, 6271496.945), abs=0.01)
    assert row.d == pytest.approx(111195.08, abs=1)
    assert row.straight == 0 and row.nan == 0


def test_text(spark):
    row = spark.createDataFrame([("  é \t x\r\n\r\n\r\n\r\ny ", "43.5; 1.25", "1,2,3,4")], "t string, p string, b string").select(
        X.clean_text(F.col("t"), True, compose=True).alias("t"), X.parse_lat_lon(F.col("p")).alias("p"), X.parse_bbox(F.col("b")).alias("b")
    ).first()
    assert row.t == "é x\n\ny"
    assert (row.p.lon, row.p.lat) == (1.25, 43.5)
    assert tuple(row.b) == (1.0, 2.0, 3.0, 4.0)


def test_params():
    assert load_params("[flat]\nmax_mean_grade_pct = 2\n", ("climb.target_lengths_m=[50, 100]",)).climb.target_lengths_m == (50.0, 100.0)
    with pytest.raises(ValueError):
        load_params("[flat]\nnope = 1\n")
    assert Params().long_climb.min_mean_grade_pct == 2.5
    assert [samples_for(x, 5.0) for x in (1, 12.5, 17.5, 200)] == [1, 2, 4, 40]


def test_assembled_parts_tile_each_stroke(spark):
    from ridgeflow.operators import lines

    chain = spark.createDataFrame([(0, 0, 0, True), (1, 0, 1, False), (2, 0, 2, True)], "e bigint, stroke bigint, pos bigint, forward boolean")
    edges = spark.createDataFrame([(0, 7, 1, 2, 10.0), (1, 7, 3, 2, 5.0), (2, 8, 3, 4, 20.0)], "e bigint, way_id bigint, start_node bigint, end_node bigint, length double")
    degrees = spark.createDataFrame([(2, 2), (3, 4)], "node_id bigint, degree bigint")
    minor = spark.createDataFrame([(3,)], "node_id bigint")
    parts, events = lines.assemble(chain, edges, degrees, minor)
    assert sorted((r.way_id, r.start_m, r.end_m) for r in parts.collect()) == [(7, 0.0, 15.0), (8, 15.0, 35.0)]
    assert [(r.offset_m, r.node_id, r.kind) for r in events.collect()] == [(15.0, 3, "crossing")]


def test_resample_and_substring(spark):
    from ridgeflow.operators import lines

    df = spark.createDataFrame([("a", [(0.0, 0.0), (30.0, 0.0), (30.0, 40.0)])], "id string, line array<struct<x: double, y: double>>")
    points = sorted((r.k, r.x, r.y) for r in lines.resample(df, 10.0, "id").collect())
    assert points == [(0, 0, 0), (1, 10, 0), (2, 20, 0), (3, 30, 0), (4, 30, 10), (5, 30, 20), (6, 30, 30), (7, 30, 40)]
    cut = lines.substring(df, F.lit(20.0), F.lit(45.0), "id").first().line
    assert [(p.x, p.y) for p in cut] == [(20, 0), (30, 0), (30, 15)]
