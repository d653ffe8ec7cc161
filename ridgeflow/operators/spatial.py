"""Distance and containment joins by grid cells.

Points, lines and rings go to the square cells that they touch, and cells are
joined by equality: a hash join whatever the size, never a nested loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo

#: Lines of a block, pairs of blocks that are read at once, and pairs of lines that are measured at once.
LINES, BLOCKS, PAIRS = 1024, 64, 1 << 15
#: The sine of an angle below which lines count as nearly parallel.
SLOPE = 1e-4


def line_cells(lines: DataFrame, cell: float, margin: float) -> DataFrame:
    """Cells of the box around each line and a margin."""
    def span(c: str):
        low = F.floor((F.least(f"{c}0", f"{c}1") - margin) / cell)
        high = F.floor((F.greatest(f"{c}0", f"{c}1") + margin) / cell)
        return F.sequence(low, high)

    return lines.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))


def met(left: DataFrame, right: DataFrame, cell: float, *keys: str) -> DataFrame:
    """Pairs of rows with equal keys whose boxes ``(x0, x1, y0, y1)`` meet, each from the one cell where both begin; columns get ``a_`` and ``b_``."""

    def cells(df: DataFrame, side: str) -> DataFrame:
        spans = {c: F.sequence(F.floor(F.col(f"{c}0") / cell), F.floor(F.col(f"{c}1") / cell)) for c in "xy"}
        rows = df.withColumn("cx", F.explode(spans["x"])).withColumn("cy", F.explode(spans["y"]))
        return rows.select(*keys, "cx", "cy", *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys))

    both = cells(left, "a").join(cells(right, "b"), [*keys, "cx", "cy"])
    for c in "xy":
        both = both.where(F.col(f"c{c}") == F.floor(F.greatest(f"a_{c}0", f"b_{c}0") / cell)).where(f"a_{c}0 <= b_{c}1 AND b_{c}0 <= a_{c}1")
    return both


def _blocks(lines: DataFrame, name: str, cell: float, margin: float) -> DataFrame:
    """Lines as arrays ``name`` of at most ``LINES``, in order of their ends, by kind, by cell of the box around a line and a margin, and by whether the box begins there."""
    ends, keys = ["x0", "y0", "x1", "y1"], ["kind", "cx", "cy", f"{name}_x", f"{name}_y"]
    rows = lines.select("id", "kind", *(F.col(c).cast("double").alias(c) for c in ends)).where("kind IS NOT NULL").dropna(subset=ends)
    rows = line_cells(rows, cell, margin)
    for c in "xy":
        rows = rows.withColumn(f"{name}_{c}", F.col(f"c{c}") == F.floor((F.least(f"{c}0", f"{c}1") - margin) / cell))
    rows = rows.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*ends)) - 1) / LINES))
    return rows.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct(*ends, "id"))).alias(name)).drop("block")


class _Lines:
    """The different lines of blocks: ``values`` are x, y, direction and length; ``first`` and ``times`` are the rows of a line, ``starts`` the lines of a block."""

    def __init__(self, blocks: pa.ListArray, margin: float):
        rows, self.sizes = blocks.flatten(), blocks.value_lengths().to_numpy().astype(np.int64)
        self.ids = rows.field("id")
        ends = np.stack([rows.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")])
        new = np.concatenate(([True], (ends[:, 1:] != ends[:, :-1]).any(axis=0)))
        new[np.cumsum(self.sizes) - self.sizes] = True
        self.first = np.flatnonzero(new)
        self.times = np.diff(self.first, append=len(new))
        self.block = np.repeat(np.arange(len(self.sizes)), self.sizes)[new]
        self.starts = np.searchsorted(self.block, np.arange(len(self.sizes) + 1))
        x, y, x1, y1 = self.ends = ends[:, new]
        length = np.sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y))
        some = length > 0
        unit = [np.divide(d, length, out=np.full(len(x), other), where=some) for d, other in ((x1 - x, 1.0), (y1 - y, 0.0))]
        self.values = np.stack([x, y, *unit, length])
        self.boxes = np.stack([np.minimum(x, x1) - margin, np.maximum(x, x1) + margin, np.minimum(y, y1) - margin, np.maximum(y, y1) + margin])


def _each_point(n: np.ndarray, a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """For each pair of straight lines ``x0 y0 x1 y1`` how many of the ``n + 1`` points along the first lie near the second, point by point."""
    found = np.zeros(len(n), np.int64)
    part = np.cumsum(n + 1) // PAIRS
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for i, j in zip(edges, edges[1:], strict=False):
        size = n[i:j] + 1
        of = np.repeat(np.arange(i, j), size)
        k = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        share = k / n[of]
        px, py = (a[c][of] + (a[c + 2] - a[c])[of] * share for c in (0, 1))
        x, y, dx, dy = (v[of] for v in (b[0], b[1], b[2] - b[0], b[3] - b[1]))
        square = dx * dx + dy * dy
        t = np.clip(((px - x) * dx + (py - y) * dy) / np.where(square > 0, square, 1.0), 0.0, 1.0)
        dx, dy = px - x - t * dx, py - y - t * dy
        found[i:j] = np.bincount((of - i)[dx * dx + dy * dy <= most * most], minlength=j - i)
    return found


def _near_points(one: _Lines, i: np.ndarray, two: _Lines, j: np.ndarray, n: np.ndarray, most: float) -> np.ndarray:
    """For each pair of lines how many of the ``n + 1`` points along the first lie near the second.

    The points near a line are one stretch: from the first to the last end of those within two circles and a
    rectangle.  It is taken for a distance a little more and, where an end is close to a point, a little less too;
    where the counts differ, rounding could decide, and these pairs go point by point.
    """
    ax, ay, ux, uy, whole = (v[i] for v in one.values)
    bx, by, ex, ey, length = (v[j] for v in two.values)
    px, py = ax - bx, ay - by
    sin, cos = ex * uy - ey * ux, ex * ux + ey * uy
    z1, o1 = -(px * ux + py * uy), px * uy - py * ux
    z2, o2 = z1 + length * cos, o1 - length * sin
    o1 *= o1
    o2 *= o2
    # Parallel or upright lines: all or nothing lies between the sides.
    sin[np.abs(sin) < 1e-200] = 1e-200
    cos[np.abs(cos) < 1e-200] = 1e-200
    middle, along = (ey * px - ex * py) / sin, ex * px + ey * py
    np.abs(sin, out=sin)
    from_, to = -along / cos, (length - along) / cos
    from_, to = np.minimum(from_, to), np.maximum(from_, to)
    with np.errstate(divide="ignore"):  # a line without length has all its points in one place
        last = n.astype(float)
        per = np.where(whole > 0, last / whole, 0.0)

    parts = (middle, sin, from_, to, z1, o1, z2, o2, per)
    rim = 1e-9 * most + 1e-12 * max(np.abs(v).max(initial=0.0) for v in (one.ends, two.ends))
    low, high = _stretch(most + rim, *parts)
    count = lambda low, high, last: np.fmax(np.minimum(np.floor(high), last) - np.maximum(np.ceil(low), 0.0) + 1.0, 0.0)
    found = count(low, high, last)
    # So far the ends move at most between the two distances, unless the lines are nearly parallel.
    least = max(most - rim, 0.0)
    shift = (np.sqrt((most + rim) ** 2 - least**2) + 2 * rim / SLOPE) * per
    close = (np.abs(low - np.rint(low)) <= shift) | (np.abs(high - np.rint(high)) <= shift)
    close = np.flatnonzero((close | (sin < SLOPE) | (whole == 0)) & (found > 0))
    sure = count(*_stretch(least, *(v[close] for v in parts)), last[close]) if most > rim else np.zeros(len(close))
    odd = close[(found[close] != sure) | (whole[close] == 0)]
    found = found.astype(np.int64)
    found[odd] = _each_point(n[odd], one.ends[:, i[odd]], two.ends[:, j[odd]], most)
    return found


def _stretch(most: float, middle, sin, from_, to, z1, o1, z2, o2, per) -> tuple[np.ndarray, np.ndarray]:
    """Where a line comes near another and where it leaves it, counted in its points."""
    half = most / sin
    low, high = np.maximum(middle - half, from_), np.minimum(middle + half, to)
    # What is empty is no number; fmin and fmax take the other.
    some = low <= high
    low, high = np.where(some, low, np.nan), np.where(some, high, np.nan)
    with np.errstate(invalid="ignore"):
        for z, o in ((z1, o1), (z2, o2)):
            half = np.sqrt(most * most - o)
            low, high = np.fmin(low, z - half), np.fmax(high, z + half)
        return low * per, high * per


def _shares(one: _Lines, two: _Lines, buffer_m: float, step: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows of one, rows of two, shares)`` above 0, of blocks side by side."""
    n = np.maximum(1, np.ceil(one.values[4] / step - 1e-9)).astype(np.int64)
    others, begins = np.diff(two.starts)[one.block], two.starts[one.block]
    # So many lines at once that their pairs, copies included, are few.
    part = np.cumsum(one.times * two.sizes[one.block]) // PAIRS
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for s, e in zip(edges, edges[1:], strict=False):
        many = others[s:e]
        i = np.repeat(np.arange(s, e), many)
        j = np.arange(len(i)) + np.repeat(begins[s:e] - np.cumsum(many) + many, many)
        for c in (0, 2):
            meet = np.flatnonzero((one.boxes[c][i] <= two.boxes[c + 1][j]) & (two.boxes[c][j] <= one.boxes[c + 1][i]))
            i, j = i[meet], j[meet]
        count = _near_points(one, i, two, j, n[i], buffer_m)
        hit = np.flatnonzero(count)
        i, j, share = i[hit], j[hit], count[hit] / (n[i[hit]] + 1.0)
        times = one.times[i] * two.times[j]
        a, b = one.first[i], two.first[j]
        if len(times) and times.max() > 1:
            k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            copies = np.repeat(two.times[j], times)
            a, b, share = np.repeat(a, times) + k // copies, np.repeat(b, times) + k % copies, np.repeat(share, times)
        yield a, b, share


def coverage(a: DataFrame, b: DataFrame, buffer_m: float, step: float, cell: float | None = None) -> DataFrame:
    """``(a, b, share)``: the share of sample points of each line of ``a`` within the buffer of a line of ``b`` of the same kind.

    Only pairs with a share above 0 are returned.  Both are ``(id, kind, x0, y0, x1, y1)``, one row a line.
    Lines are compared block by block, as arrays: a pair becomes a row only as a result, in one cell, and is never shuffled or joined.
    Pairs of blocks are dealt to the tasks one by one, whatever their kind and cell.  Equal lines of a block are compared once.
    """
    cell = cell or max(4 * buffer_m, 400.0)
    # A box a little wider than the buffer: rounding must not lose a point on its rim.
    margin = buffer_m + 1e-6 * buffer_m + 1e-6
    pairs = _blocks(a, "one", cell, 0.0).join(_blocks(b, "two", cell, margin), ["kind", "cx", "cy"])
    # A pair of boxes counts in the one cell where both begin.
    pairs = pairs.where("(one_x OR two_x) AND (one_y OR two_y)").select("one", "two")
    pairs = pairs.repartition(8 * a.sparkSession.sparkContext.defaultParallelism)
    schema = T.StructType([T.StructField("a", a.schema["id"].dataType), T.StructField("b", b.schema["id"].dataType), T.StructField("share", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Some blocks at once, so that their copies for work are few.
            for at in range(0, batch.num_rows, BLOCKS):
                one, two = (_Lines(batch.column(c).slice(at, BLOCKS), m) for c, m in ((0, 0.0), (1, margin)))
                for i, j, share in _shares(one, two, buffer_m, step):
                    yield pa.RecordBatch.from_arrays([one.ids.take(pa.array(i)), two.ids.take(pa.array(j)), pa.array(share)], schema.names)

    return pairs.mapInArrow(run, schema)


def inside_ring(points: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """``(id, ring_id, area)``: rings ``(ring_id, ring, area)`` that hold points ``(id, px, py)``."""
    xs, ys = F.col("ring.x"), F.col("ring.y")
    boxes = rings.withColumn("cx", F.explode(F.sequence(F.floor(F.array_min(xs) / cell), F.floor(F.array_max(xs) / cell))))
    boxes = boxes.withColumn("cy", F.explode(F.sequence(F.floor(F.array_min(ys) / cell), F.floor(F.array_max(ys) / cell))))
    rows = points.withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))
    rows = rows.join(boxes, ["cx", "cy"]).where(geo.point_in_ring(F.col("px"), F.col("py"), F.col("ring")))
    return rows.select("id", "ring_id", "area")


def smallest_containing(points: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """``(id, ring_id)``: the smallest ring around each point, the first identifier on ties.

    Of equal rings the first counts, and equal points are looked up once.  A
    rectangle over a whole cell holds all its points, so the smallest of those
    bounds the cell: larger rings that only reach into it never meet a point.
    The cells here are a fifth of ``cell`` wide.
    """
    cell = cell / 5
    places = points.select("px", "py").where("px IS NOT NULL AND py IS NOT NULL").distinct()
    rings = rings.groupBy("ring", "area").agg(F.min("ring_id").alias("ring_id")).withColumn("rank", F.struct("area", "ring_id"))
    for c in "xy":
        values = F.col(f"ring.{c}")
        rings = rings.withColumn(f"{c}0", F.array_min(values)).withColumn(f"{c}1", F.array_max(values))
        rings = rings.withColumn(f"c{c}", F.sequence(F.floor(F.col(f"{c}0") / cell), F.floor(F.col(f"{c}1") / cell)))
    corners = F.forall("ring", lambda p: p["x"].isin(F.col("x0"), F.col("x1")) & p["y"].isin(F.col("y0"), F.col("y1")))
    whole = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    box = (F.size("ring") == 5) & (F.get("ring", F.lit(0)) == F.get("ring", F.lit(4))) & corners & (F.abs(geo.ring_area(F.col("ring")) - whole) <= 1e-9 * whole)
    cells = rings.withColumn("box", F.coalesce(box, F.lit(False))).withColumn("cx", F.explode("cx")).withColumn("cy", F.explode("cy"))
    over = F.col("box")
    for c in "xy":
        over = over & (F.col(f"{c}0") < F.col(f"c{c}") * cell) & (F.col(f"{c}1") > (F.col(f"c{c}") + 1) * cell)
    bounds = cells.where(over).groupBy("cx", "cy").agg(F.min("rank").alias("bound"))
    edges = cells.where(~over).select("cx", "cy", "ring", "rank").join(bounds, ["cx", "cy"], "left").where("bound IS NULL OR rank < bound").drop("bound")
    places = places.withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))
    found = places.join(edges, ["cx", "cy"]).where(geo.point_in_ring(F.col("px"), F.col("py"), F.col("ring"))).select("px", "py", "rank")
    found = found.union(places.join(bounds, ["cx", "cy"]).select("px", "py", "bound")).groupBy("px", "py").agg(F.min("rank").alias("rank"))
    return points.select("id", "px", "py").join(found, ["px", "py"]).groupBy("id").agg(F.min("rank").alias("rank")).select("id", F.col("rank.ring_id").alias("ring_id"))


def bilinear(points: DataFrame, cells: DataFrame) -> DataFrame:
    """``(id, z)``: heights of points ``(id, col, row)`` in fractional pixels of a raster ``(row, col, z)``.

    Null if one of the four pixels is missing.  One join: each point asks for
    its four pixels and the weighted heights are summed.
    """
    r0, c0 = F.floor("row"), F.floor("col")
    fr, fc = F.col("row") - r0, F.col("col") - c0
    corner = lambda r, c, w: F.struct((r0 + r).alias("row"), (c0 + c).alias("col"), w.alias("w"))
    asks = points.select("id", F.explode(F.array(corner(0, 0, (1 - fr) * (1 - fc)), corner(0, 1, (1 - fr) * fc), corner(1, 0, fr * (1 - fc)), corner(1, 1, fr * fc))).alias("p"))
    got = asks.select("id", "p.*").join(cells, ["row", "col"], "left")
    z = F.when(F.count("z") == 4, F.sum(F.col("w") * F.col("z")))
    return got.groupBy("id").agg(z.alias("z"))
