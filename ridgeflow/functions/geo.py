"""Plane and spherical geometry as column expressions.

A line is an array of ``struct<x, y>``; a ring repeats its first point.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius, and the constants of the Lambert-93 projection.
EARTH_M = 6371008.8
_N, _C, _R0 = 0.7256077650532695, 1.8428979224021065 * 6378137.0, 6055612.049875985
_X0, _Y0, _LON0 = 700000.0, 6600000.0, 3.0
_F = 1 / 298.257222101
_E = math.sqrt(2 * _F - _F * _F)


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def steps(line: Column) -> Column:
    """Lengths of the pieces of a line."""
    nxt = F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0)))
    now = F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0)))
    return F.zip_with(now, nxt, lambda a, b: hypot(b["x"] - a["x"], b["y"] - a["y"]))


def length(line: Column) -> Column:
    return F.aggregate(steps(line), F.lit(0.0), lambda s, v: s + v)


def chord(line: Column) -> Column:
    a, b = F.get(line, F.lit(0)), F.get(line, F.size(line) - 1)
    return hypot(b["x"] - a["x"], b["y"] - a["y"])


def sinuosity(line: Column) -> Column:
    """Length over chord, infinite if closed."""
    c = chord(line)
    return F.when(c > 1e-9, length(line) / F.when(c > 1e-9, c)).otherwise(F.lit(float("inf")))


def dedupe_vertices(line: Column) -> Column:
    """Without vertices that repeat the one before."""
    same = lambda i: hypot(F.get(line, i)["x"] - F.get(line, i - 1)["x"], F.get(line, i)["y"] - F.get(line, i - 1)["y"]) <= 1e-9
    return F.filter(line, lambda _, i: (i == 0) | ~F.coalesce(same(i), F.lit(False)))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def deflection(a: Column, b: Column) -> Column:
    """Degrees by which two outgoing directions miss being opposite."""
    return 180 - F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def cross_sum(ring: Column) -> Column:
    """Twice the signed area of a closed ring."""
    now = F.slice(ring, F.lit(1), F.size(ring) - 1)
    nxt = F.slice(ring, F.lit(2), F.size(ring) - 1)
    return F.aggregate(F.zip_with(now, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)


def ring_area(ring: Column) -> Column:
    return F.abs(cross_sum(ring)) / 2


def compactness(ring: Column) -> Column:
    """1 for a circle, near 0 for a thin strip."""
    p = length(ring)
    return F.when(p > 0, 4 * math.pi * ring_area(ring) / F.when(p > 0, p * p)).otherwise(0.0)


def ring_centroid(ring: Column) -> Column:
    """Centroid of a closed ring that has an area."""
    now = F.slice(ring, F.lit(1), F.size(ring) - 1)
    nxt = F.slice(ring, F.lit(2), F.size(ring) - 1)

    def moment(axis: str) -> Column:
        each = F.zip_with(now, nxt, lambda a, b: (a[axis] + b[axis]) * (a["x"] * b["y"] - b["x"] * a["y"]))
        return F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / (3 * cross_sum(ring))

    return F.struct(moment("x").alias("x"), moment("y").alias("y"))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule."""
    now = F.slice(ring, F.lit(1), F.size(ring) - 1)
    nxt = F.slice(ring, F.lit(2), F.size(ring) - 1)

    def crosses(a: Column, b: Column) -> Column:
        straddles = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.when(straddles, b["y"] - a["y"])
        return F.when(straddles & (x < at), 1).otherwise(0)

    return F.aggregate(F.zip_with(now, nxt, crosses), F.lit(0), lambda s, v: s + v) % 2 == 1


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(square > 0, square)))).otherwise(0.0)
    return hypot(px - ax - t * dx, py - ay - t * dy)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def lambert93(lon: Column, lat: Column) -> Column:
    """Plane metres of longitude and latitude."""
    s = _E * F.sin(F.radians(lat))
    t = F.tan(math.pi / 4 - F.radians(lat) / 2) / F.pow((1 - s) / (1 + s), F.lit(_E / 2))
    r, g = _C * F.pow(t, F.lit(_N)), _N * F.radians(lon - _LON0)
    return F.struct((_X0 + r * F.sin(g)).alias("x"), (_Y0 + _R0 - r * F.cos(g)).alias("y"))


def lambert93_inverse(x: Column, y: Column, rounds: int = 8) -> Column:
    """Longitude and latitude of plane metres, by fixed-point rounds."""
    dx, dy = x - _X0, _R0 - (y - _Y0)
    t = F.pow(hypot(dx, dy) / _C, F.lit(1 / _N))
    lat = math.pi / 2 - 2 * F.atan(t)
    for _ in range(rounds):
        s = _E * F.sin(lat)
        lat = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(_E / 2)))
    return F.struct((_LON0 + F.degrees(F.atan2(dx, dy)) / _N).alias("lon"), F.degrees(lat).alias("lat"))


def tile(lon: Column, lat: Column, zoom: int) -> Column:
    """Web-Mercator tile that holds a position, kept inside the map."""
    n = 2**zoom
    rad = F.radians(lat)
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n)
    inside = lambda v: F.least(F.lit(n - 1), F.greatest(F.lit(0), v)).cast("int")
    return F.struct(inside(x).alias("x"), inside(y).alias("y"))


def tile_point(zoom: int, x: Column, y: Column) -> Column:
    """Longitude and latitude of a (fractional) tile position."""
    n = 2.0**zoom
    merc = math.pi * (1 - 2 * y / n)
    return F.struct((x / n * 360 - 180).alias("lon"), F.degrees(F.atan(F.sinh(merc))).alias("lat"))


def circle_cover(lon: Column, lat: Column, radius_m: float, zoom: int) -> Column:
    """All tiles that a circle can touch, as an array."""
    d_lat = radius_m / 111_320
    d_lon = radius_m / (111_320 * F.cos(F.radians(lat)))
    low, high = tile(lon - d_lon, lat + d_lat, zoom), tile(lon + d_lon, lat - d_lat, zoom)
    columns = F.sequence(low["x"], high["x"])
    return F.flatten(F.transform(columns, lambda x: F.transform(F.sequence(low["y"], high["y"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def circle_polygon(lon: Column, lat: Column, radius_m: float, sides: int = 64) -> Column:
    """Closed ring of points at the exact great-circle distance."""
    angle, la = radius_m / EARTH_M, F.radians(lat)

    def corner(i: Column) -> Column:
        b = 2 * math.pi * (i % sides) / sides
        la2 = F.asin(F.sin(la) * math.cos(angle) + F.cos(la) * math.sin(angle) * F.cos(b))
        lo2 = F.radians(lon) + F.atan2(F.sin(b) * math.sin(angle) * F.cos(la), math.cos(angle) - F.sin(la) * F.sin(la2))
        return F.struct(F.degrees(lo2).alias("lon"), F.degrees(la2).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(sides)), corner)


def stable_id(kind: Column, x0: Column, y0: Column, x1: Column, y1: Column, line_length: Column, grid_m: float = 10.0) -> Column:
    """Identifier that does not depend on direction: ends and length snapped to a grid."""
    snap = lambda v: F.rint(v / grid_m).cast("bigint")
    ends = F.array_sort(F.array(F.struct(snap(x0).alias("x"), snap(y0).alias("y")), F.struct(snap(x1).alias("x"), snap(y1).alias("y"))))
    a, b = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    key = F.concat_ws("|", kind, a["x"], a["y"], b["x"], b["y"], snap(line_length))
    return F.concat(kind, F.lit("-"), F.substring(F.sha1(key), 1, 12))


def grade_band(grade: Column, flat: float = 2.0, width: float = 0.5) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.round((grade - flat) / width, 9))).cast("int")


def size_class(length_m: Column, bounds: tuple[float, ...] = (500.0, 1000.0)) -> Column:
    return sum((F.when(length_m > b, 1).otherwise(0) for b in bounds), F.lit(0))


def index_key(segment_id: Column, prefix: int = 2) -> Column:
    return F.substring(F.split_part(segment_id, F.lit("-"), F.lit(2)), 1, prefix)


def index_prefix_length(entries: int, per_file: int = 2_000, least: int = 2) -> int:
    """Digits of the index key that keep files small on average."""
    length = least
    while entries > per_file * 16**length:
        length += 1
    return length


def box_to_lambert93(west: Column, south: Column, east: Column, north: Column, round_m: float = 1000.0, pieces: int = 22) -> Column:
    """The plane box around a box of degrees, its sides cut into pieces since they are bent in the plane, rounded outward."""
    at = F.transform(F.sequence(F.lit(0), F.lit(pieces)), lambda k: k / F.lit(float(pieces)))
    points = F.concat(
        F.transform(at, lambda s: lambert93(west + (east - west) * s, south)),
        F.transform(at, lambda s: lambert93(west + (east - west) * s, north)),
        F.transform(at, lambda s: lambert93(west, south + (north - south) * s)),
        F.transform(at, lambda s: lambert93(east, south + (north - south) * s)),
    )
    low = lambda axis: F.floor(F.array_min(F.transform(points, lambda p: p[axis])) / round_m) * round_m
    high = lambda axis: F.ceil(F.array_max(F.transform(points, lambda p: p[axis])) / round_m) * round_m
    return F.struct(low("x").alias("min_x"), low("y").alias("min_y"), high("x").alias("max_x"), high("y").alias("max_y"))


#: Fixed value: the radius in metres of the sphere of web maps.
_WEB_M = 6_378_137.0


def web_mercator(lon: Column, lat: Column) -> Column:
    """Plane metres of web maps."""
    return F.struct((F.radians(lon) * _WEB_M).alias("x"), (F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * _WEB_M).alias("y"))


def web_mercator_inverse(x: Column, y: Column) -> Column:
    return F.struct(F.degrees(x / _WEB_M).alias("lon"), F.degrees(2 * F.atan(F.exp(y / _WEB_M)) - math.pi / 2).alias("lat"))
