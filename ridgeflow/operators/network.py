"""Graph operators on ways, edges and half-edges.

Half-edge ``2 e`` leaves the start node of edge e, ``2 e + 1`` its end node;
twins differ in the last bit.  Chains of more than ``AT_ONCE`` half-edges,
faces and cores are found in rounds whose tables are written to the shared scratch folder; pointer doubling stops
after as many rounds as the logarithm of the longest chain or orbit, when a
round changes nothing.  Peeling takes a round for each layer of leaves.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .suppress import kept_table, replaced

#: Up to so many half-edges (about 100 bytes each) are chained in one task, without rounds.
AT_ONCE = 4_000_000


def node_usage(nodes: DataFrame) -> DataFrame:
    """``(node_id, n)`` of way nodes ``(way_id, pos, node_id)``."""
    return nodes.groupBy("node_id").agg(F.count("*").alias("n"))


def split_ways(nodes: DataFrame, barriers: DataFrame, shared: int = 2) -> DataFrame:
    """``(way_id, piece, start_node, end_node, n_nodes)``: ways cut at inner nodes that are used ``shared`` times or barriers.

    A piece's number is the running count of cuts before it.
    """
    cuts = node_usage(nodes).where(F.col("n") >= shared).select("node_id").union(barriers.select("node_id")).distinct().withColumn("cut", F.lit(True))
    order = Window.partitionBy("way_id").orderBy("pos")
    rows = nodes.join(cuts, "node_id", "left")
    rows = rows.withColumn("last", F.max("pos").over(Window.partitionBy("way_id")))
    inner = (F.col("pos") > 0) & (F.col("pos") < F.col("last")) & F.coalesce("cut", F.lit(False))
    rows = rows.withColumn("before", F.sum(inner.cast("int")).over(order)).withColumn("inner", inner)
    # A cut node ends one piece and starts the next.
    pieces = rows.withColumn("piece", F.explode(F.when(F.col("inner"), F.array(F.col("before") - 1, F.col("before"))).otherwise(F.array("before"))))
    out = pieces.groupBy("way_id", "piece").agg(F.min_by("node_id", "pos").alias("start_node"), F.max_by("node_id", "pos").alias("end_node"), F.count("*").alias("n_nodes"))
    return out.where("n_nodes >= 2")


def half_edges(edges: DataFrame) -> DataFrame:
    """``(half, tail, head)`` of edges ``(e, start_node, end_node)``."""
    one = F.struct((F.col("e") * 2).alias("half"), F.col("start_node").alias("tail"), F.col("end_node").alias("head"))
    two = F.struct((F.col("e") * 2 + 1).alias("half"), F.col("end_node").alias("tail"), F.col("start_node").alias("head"))
    return edges.select(F.explode(F.array(one, two)).alias("h")).select("h.*")


def degrees(edges: DataFrame) -> DataFrame:
    """``(node_id, degree)``; a self-loop counts twice."""
    return half_edges(edges).groupBy(F.col("tail").alias("node_id")).agg(F.count("*").alias("degree"))


def two_core(edges: DataFrame) -> DataFrame:
    """Edges ``(e, start_node, end_node)`` left after leaves are peeled until there is none."""
    edges = kept_table(edges.select("e", "start_node", "end_node"), "core")
    while True:
        leaves = degrees(edges).where("degree = 1").select("node_id")
        leaves = kept_table(leaves, "leaves")
        if leaves.isEmpty():
            return edges
        edges = edges.join(leaves.withColumnRenamed("node_id", "start_node"), "start_node", "left_anti")
        edges = kept_table(edges.join(leaves.withColumnRenamed("node_id", "end_node"), "end_node", "left_anti").select("e", "start_node", "end_node"), "core")


def _in_billionths(turn: float) -> int:
    """A turn rounded half up to nine decimals, in units of the last."""
    scaled = turn * 1e9
    whole = math.floor(scaled)
    if abs(scaled - whole - 0.5) > 1e-3:
        return round(scaled)
    return int(Decimal(repr(turn)).scaleb(9).to_integral_value(ROUND_HALF_UP))


def best_first_ends(halves: np.ndarray, bearings: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Best-first pairs of the ends of one node, by rounded deflection and half-edge numbers.

    Ends of one bearing are a queue by number.  A queue looks for its partner
    from the opposite bearing in both directions, where deflections grow; of
    equal ones the smallest number wins.  What a queue found earlier bounds
    what it can find later, so a heap of these gives the best pair of all, and
    the ends are never compared pair by pair.
    """
    angles, of = np.unique(np.mod(bearings, 360.0), return_inverse=True)
    order = np.lexsort((halves, of))
    n = len(angles)
    first = np.searchsorted(of[order], np.arange(n + 1)).tolist()
    queue, head, stop = halves[order].tolist(), first[:-1], first[1:]
    round_thrice = np.concatenate((angles - 360.0, angles, angles + 360.0))
    opposite = np.searchsorted(round_thrice, angles + 180.0).tolist()
    angle = angles.tolist()
    # The next queue with ends at or after a place, and at or before it.
    after, before = list(range(3 * n + 1)), list(range(-1, 3 * n))

    def found(links: list[int], at: int, shift: int) -> int:
        root = at
        while links[root + shift] != root:
            root = links[root + shift]
        while links[at + shift] != root:
            links[at + shift], at = root, links[at + shift]
        return root

    def best(g: int, up: bool) -> tuple[int, int, int, int, bool] | None:
        x = queue[head[g]]
        links, shift, step = (after, 0, 1) if up else (before, 1, -1)
        at, key, y = opposite[g] - (not up), None, None
        while True:
            at = found(links, at, shift)
            if not 0 <= at < 3 * n or abs(round_thrice[at] - angle[g] - 180.0) > 180.0:
                break
            h = at % n
            mine = head[h] + (h == g)
            if mine < stop[h]:
                z = queue[mine]
                one, two = (angle[g], angle[h]) if x < z else (angle[h], angle[g])
                turn = abs(180 - abs((one - two + 180) % 360.0 - 180))
                if turn > most:
                    break
                turn = _in_billionths(turn)
                if key is not None and turn != key:
                    break
                key, y = turn, z if y is None else min(y, z)
            at += step
        return None if key is None else (key, min(x, y), max(x, y), g, up)

    heap = [e for g in range(n) for up in (True, False) if (e := best(g, up))]
    heapq.heapify(heap)
    home = dict(zip(queue, of[order].tolist(), strict=True))
    taken = []
    while heap:
        _, p, q, g, up = heapq.heappop(heap)
        if p in home and q in home:
            taken.append((p, q))
            for end in (p, q):
                h = home.pop(end)
                head[h] += 1
                if head[h] == stop[h]:
                    for at in (h, h + n, h + 2 * n):
                        after[at], before[at + 1] = at + 1, at - 1
        if head[g] < stop[g] and (again := best(g, up)):
            heapq.heappush(heap, again)
    return taken


def _paired(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[pa.RecordBatch]:
    """``(a, b)`` of the ends ``(half, tail, bearing)`` of whole nodes, which follow one another."""
    held: list[pa.RecordBatch] = []

    def ends_of(rows: pa.Table) -> pa.RecordBatch:
        tails = rows.column("tail").to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], tails[1:] != tails[:-1], [True])))
        half, bearing = rows.column("half").to_numpy(), rows.column("bearing").to_numpy()
        size = np.diff(edge)
        two = edge[:-1][size == 2]
        a, b = np.minimum(half[two], half[two + 1]), np.maximum(half[two], half[two + 1])
        pairs = [np.stack((a, b), axis=1)[a < b]]
        for i in np.flatnonzero(size > 2):
            # A half-edge given twice would wait for a partner without end.
            own = edge[i] + np.unique(half[edge[i] : edge[i + 1]], return_index=True)[1]
            if len(own) == 2:
                pairs.append(half[own].reshape(1, 2))
                continue
            own = own[np.isfinite(bearing[own])]
            pairs.append(np.array(best_first_ends(half[own], bearing[own], most), dtype=np.int64).reshape(-1, 2))
        every = np.concatenate(pairs)
        return pa.RecordBatch.from_arrays([pa.array(every[:, 0].copy(), pa.int64()), pa.array(every[:, 1].copy(), pa.int64())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = batch.column(1)[-1]
        if held[0].column(1)[0] == last:
            continue
        rows = pa.Table.from_batches(held)
        begin = rows.num_rows - batch.num_rows + int(np.argmax(batch.column(1).to_numpy(zero_copy_only=False) == last.as_py()))
        yield ends_of(rows.slice(0, begin))
        held = rows.slice(begin).to_batches()
    if held:
        yield ends_of(pa.Table.from_batches(held))


def pair_ends(ends: DataFrame, barriers: DataFrame, max_deflection: float = 35.0) -> DataFrame:
    """``(a, b)``: half-edges that go straight on at their tail node; ends are ``(half, tail, bearing)``, one row a half-edge.

    No pair at barriers and dead ends; the two ends of a degree-two node
    always pair; elsewhere best first by deflection, then half-edge numbers.
    Repeated rows count once.  The ends of a node are matched in one task without its pairs, so a node of
    n ends takes about n log n steps.
    """
    rows = ends.where("half IS NOT NULL AND tail IS NOT NULL").join(barriers.select(F.col("node_id").alias("tail")), "tail", "left_anti")
    rows = rows.select(F.col("half").cast("long").alias("half"), "tail", F.col("bearing").cast("double").alias("bearing"))
    rows = rows.repartition("tail").sortWithinPartitions("tail")
    return rows.mapInArrow(lambda batches: _paired(batches, max_deflection), "a long, b long")


def _ranked(step: DataFrame) -> DataFrame:
    """``(h, end, dist, low, ends)`` of successor rows ``(h, next)``: where the list of h ends, how far, and its smallest edge.

    ``ends`` is false on a cycle, where ``low`` is the smallest edge all the same.
    """
    last = F.col("next").isNull()
    state = step.select("h", F.coalesce("next", "h").alias("end"), F.when(last, 0).otherwise(1).cast("bigint").alias("dist"), F.shiftright("h", 1).alias("low"), last.alias("ends"))
    state, moved = kept_table(state, "list"), True
    while moved:
        ahead = state.toDF("end", "end2", "dist2", "low2", "ends2")
        low = F.least("low", "low2")
        # On a cycle the smallest edge of ever longer stretches: once none changes, all rows have that of the cycle.
        changed = F.when(F.col("ends2"), (F.col("dist2") != 0) | (low != F.col("low"))).otherwise(low != F.col("low"))
        both = state.join(ahead, "end").select(
            "h", F.col("end2").alias("end"), (F.col("dist") + F.col("dist2")).alias("dist"), low.alias("low"), F.col("ends2").alias("ends"), changed.alias("changed")
        )
        both = replaced(both, "list", state)
        state, moved = both.drop("changed"), not both.where("changed").isEmpty()
    return state


def _ranked_at_once(succ: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_ranked`` finds, of successors by place: ``(end, dist, low)``, ``low`` on cycles alone; the last of a list is its own successor."""
    end, low = succ.copy(), low.copy()
    last = succ == np.arange(len(succ))
    dist = (~last).astype(np.int64)
    # Only what has not reached the end of its list moves on.
    on = np.flatnonzero(~last[end])
    while len(on):
        ahead = end[on]
        end2, least = end[ahead], np.minimum(low[on], low[ahead])
        done, moved = last[end2], bool((least != low[on]).any())
        end[on], dist[on], low[on] = end2, dist[on] + dist[ahead], least
        if not moved and not done.any():
            break
        on = on[~done]
    return end, dist, low


def _followed(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The half-edges of edges, what follows each by the pairs ``(a, b)``, and whether anything does."""
    half = np.repeat(np.unique(e) * 2, 2)
    half[1::2] += 1
    twin, following = np.concatenate((a, b)) ^ 1, np.concatenate((b, a))
    order = np.lexsort((following, twin))
    twin, following = np.append(twin[order], np.iinfo(np.int64).max), np.append(following[order], -1)
    at = np.searchsorted(twin[:-1], half)
    known = twin[at] == half
    return half, np.where(known, following[at], -1), known


def _chained_at_once(half: np.ndarray, following: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(e, stroke, pos, forward, ring)`` of half-edges and what follows them, if ``known``."""
    order = np.argsort(half, kind="stable")
    half, following, known = half[order], following[order], known[order]
    n = len(half)
    # Place n stands for half-edges that aren't there: what leads to them drops out.
    place = np.searchsorted(half, following)
    there = half[np.minimum(place, max(n - 1, 0))] == following
    own = np.arange(n + 1)
    succ = np.append(np.where(known, np.where(there, place, n), own[:-1]), n)
    edge = np.append(half >> 1, np.iinfo(np.int64).max)
    end, dist, low = _ranked_at_once(succ, edge)
    ring = (succ[end] != end) | np.append(known & (succ[:-1] == own[:-1]), False)
    if ring.any():
        first = np.append(half, -1)[succ] == low * 2
        succ = np.where(ring & first, own, succ)
        end, dist, _ = _ranked_at_once(succ, edge)
    row = np.flatnonzero((succ[end] == end) & (end != n))
    by_end = row[np.argsort(end[row], kind="stable")]
    begin = np.flatnonzero(np.diff(end[by_end], prepend=-1))
    count = np.diff(np.append(begin, len(by_end)))
    stroke = np.repeat(np.minimum.reduceat(edge[by_end], begin), count) if len(by_end) else edge[by_end]
    kept = np.zeros(n + 1, dtype=bool)
    kept[end[by_end[half[by_end] == stroke * 2]]] = True
    stay = kept[end[by_end]]
    at = by_end[stay]
    return edge[at], stroke[stay], np.repeat(count, count)[stay] - 1 - dist[at], half[at] % 2 == 0, ring[at]


def chains(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(e, stroke, pos, forward, ring)``: edges ``(e)`` chained through paired half-edges ``(a, b)``.

    Entering an edge by a half-edge one leaves it by the twin, whose partner
    enters the next.  A stroke is named by its smallest edge and runs in the
    direction in which that edge is forward; a ring starts there.  Up to
    ``AT_ONCE`` half-edges are chained in one task, more of them in rounds.
    """
    kind, twin = edges.schema["e"].dataType, F.lit(1).cast("bigint")
    e = F.col("e").cast("bigint")
    edges = edges.where("e IS NOT NULL")
    if 2 * edges.count() <= AT_ONCE:
        names = ["e", "stroke", "pos", "forward", "ring"]
        # Edges and pairs go to the task as they are; it finds what follows what.
        rows = edges.select(e.alias("a"), F.lit(None).cast("bigint").alias("b")).union(pairs.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("bigint"), F.col("b").cast("bigint")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            rows = pa.Table.from_batches(held, held[0].schema if held else pa.schema([("a", pa.int64()), ("b", pa.int64())]))
            paired = rows.column("b").is_valid().to_numpy()
            one, two = rows.column("a").to_numpy(), rows.column("b").fill_null(-1).to_numpy()
            found = _chained_at_once(*_followed(one[~paired], one[paired], two[paired]))
            yield from pa.table([pa.array(c) for c in found], names).to_batches(100_000)

        found = kept_table(rows.repartition(1).mapInArrow(run, "e long, stroke long, pos long, forward boolean, ring boolean"), "list")
        return found.select(F.col("e").cast(kind).alias("e"), F.col("stroke").cast(kind).alias("stroke"), "pos", "forward", "ring")
    # Both directions of a pair from one row: pairs are not found twice.
    both = F.array(F.struct(F.col("a").alias("t"), F.col("b").alias("next")), F.struct(F.col("b").alias("t"), F.col("a").alias("next")))
    partner = pairs.select(F.explode(both).alias("p")).select(F.col("p.t").bitwiseXOR(twin).alias("h"), "p.next")
    half = edges.select(F.explode(F.array(e * 2, e * 2 + 1)).alias("h")).distinct()
    step = kept_table(half.join(partner, "h", "left").select("h", F.col("next").cast("bigint").alias("next")), "step")
    first = _ranked(step)
    rings = first.where("NOT ends").select("h", "low")
    # A ring is cut before its smallest edge; the opposite direction stays uncut and drops out.
    cut = step.join(rings, "h").select("h", F.when(F.col("next") != F.col("low") * 2, F.col("next")).alias("next"))
    paths = first.where("ends").select("h", "end", "dist", F.lit(False).alias("ring"))
    if not rings.isEmpty():
        paths = paths.union(_ranked(kept_table(cut, "cut")).where("ends").select("h", "end", "dist", F.lit(True)))
    named = paths.groupBy("end").agg(F.min(F.shiftright("h", 1)).alias("stroke"), F.count("*").alias("n"))
    rows = paths.join(named, "end")
    kept = rows.where("h = stroke * 2").select("end")
    rows = rows.join(kept, "end", "left_semi")
    e, stroke = F.shiftright("h", 1).cast(kind).alias("e"), F.col("stroke").cast(kind).alias("stroke")
    return rows.select(e, stroke, (F.col("n") - 1 - F.col("dist")).alias("pos"), (F.col("h") % 2 == 0).alias("forward"), "ring")


def faces(half: DataFrame) -> DataFrame:
    """``(half, face)`` of planar half-edges ``(half, tail, angle)``; a face is named by its smallest half-edge.

    The successor of h is the half-edge before its twin in counter-clockwise
    order around the head, cyclic; orbits come from pointer doubling.
    """
    order = Window.partitionBy("tail").orderBy("angle", "half")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = half.select("half", F.coalesce(F.lag("half").over(order), F.last("half").over(whole)).alias("before"))
    twin = turn.select(F.col("half").bitwiseXOR(F.lit(1).cast("bigint")).alias("half"), F.col("before").alias("next"))
    state, moved = kept_table(twin.select("half", "next", F.col("half").alias("face")), "faces"), True
    while moved:
        ahead = state.select(F.col("half").alias("next"), F.col("next").alias("next2"), F.col("face").alias("face2"))
        low = F.least("face", "face2")
        both = state.join(ahead, "next").select("half", F.col("next2").alias("next"), low.alias("face"), (low != F.col("face")).alias("changed"))
        both = replaced(both, "faces", state)
        state, moved = both.drop("changed"), not both.where("changed").isEmpty()
    return state.select("half", "face")
