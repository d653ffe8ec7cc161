"""Search over published features: filters, distances, order.

The criteria are one table of rules: a property, an operator, a value, and the
kinds that it holds for.  ``matches`` folds the rules into a column;
``map_filter`` writes them as the nested lists that map clients use, which
``compile_expression`` turns into a column again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

#: Surfaces of each choice of the surface filter.
SURFACE_GROUPS = {"paved": ("paved",), "unpaved": ("compacted", "gravel", "unpaved")}
LOOP_SINUOSITY = 3.0
SHOWN = 50


@dataclass(frozen=True)
class Criteria:
    kind: str = "flat"
    min_length_m: int = 200
    max_local_grade_pct: float = 2.0
    max_loop_grade_pct: float = 5.0
    min_mean_grade_pct: float = 3.0
    max_mean_grade_pct: float = 50.0
    max_distance_m: float = 5000.0
    no_crossing: bool = False
    surface: str = "any"
    public_only: bool = False
    loop_types: tuple[str, ...] = ("track", "water", "park", "neighbourhood")


def loop_type(loop: Column, setting: Column) -> Column:
    return F.when(loop == "circuit", setting).otherwise("track")


def effort_length_m(minutes: Column, pace_s_per_km: Column) -> Column:
    """Length of an effort, to 10 m, halves up."""
    return F.floor(minutes * 60 * 1000 / pace_s_per_km / 10 + 0.5) * 10


def is_loop(sinuosity: Column) -> Column:
    return sinuosity.isNull() | (sinuosity > LOOP_SINUOSITY)


@dataclass(frozen=True)
class Rule:
    """``prop op value``; of several properties the first that is there counts, ``unless`` names a value of ``loop_type`` that is exempt."""

    props: tuple[str, ...]
    op: str
    value: Any
    unless: str | None = None


#: Which rules hold: the kinds, the rule of some criteria, and when it applies.
_SHAPED = ("flat", "climb", "long_climb")
_RULES = (
    ((*_SHAPED, "loop"), lambda c: Rule(("kind",), "==", c.kind), lambda c: True),
    (_SHAPED, lambda c: Rule(("length_m",), ">=", c.min_length_m), lambda c: True),
    (_SHAPED, lambda c: Rule(("n_crossings",), "<=", 0), lambda c: c.no_crossing),
    (_SHAPED, lambda c: Rule(("surface",), "in", SURFACE_GROUPS[c.surface]), lambda c: c.surface in SURFACE_GROUPS),
    (("flat",), lambda c: Rule(("grade_max_pct",), "<=", c.max_local_grade_pct), lambda c: True),
    (("climb", "long_climb"), lambda c: Rule((f"steep_{c.min_length_m}_pct", "grade_mean_pct"), ">=", c.min_mean_grade_pct), lambda c: True),
    (("climb", "long_climb"), lambda c: Rule(("grade_mean_pct",), "<=", c.max_mean_grade_pct), lambda c: True),
    (("loop",), lambda c: Rule(("type",), "in", c.loop_types), lambda c: True),
    (("loop",), lambda c: Rule(("access",), "==", "public"), lambda c: c.public_only),
    (("loop",), lambda c: Rule(("grade_max_pct",), "<=", c.max_loop_grade_pct, unless="track"), lambda c: True),
)


def rules(c: Criteria) -> list[Rule]:
    return [make(c) for kinds, make, applies in _RULES if c.kind in kinds and applies(c)]


def _as_column(rule: Rule, columns: list[str]) -> Column:
    """A rule as a test that is never null; ``in`` nothing holds for nothing."""
    if rule.props == ("type",):
        value = loop_type(F.col("loop_type"), F.col("setting"))
    else:
        value = F.coalesce(*(F.col(p) for p in rule.props if p in columns), F.lit(None))
    test = {
        "==": lambda: value == rule.value,
        "<=": lambda: value <= rule.value,
        ">=": lambda: value >= rule.value,
        "in": lambda: value.isin(*rule.value) if rule.value else F.lit(False),
    }[rule.op]()
    if rule.unless:
        test = (F.col("loop_type") != "circuit") | test
    return F.coalesce(test, F.lit(False))


def _as_expression(rule: Rule) -> list:
    gets: list = [["get", p] for p in rule.props]
    if rule.props == ("type",):
        gets = [["case", ["==", ["get", "loop_type"], "circuit"], ["get", "setting"], "track"]]
    value = gets[0] if len(gets) == 1 else ["coalesce", *gets]
    test = ["match", value, list(rule.value), True, False] if rule.op == "in" else [rule.op, value, rule.value]
    return ["any", ["!=", ["get", "loop_type"], "circuit"], test] if rule.unless else test


def matches(c: Criteria, columns: list[str]) -> Column:
    """The filter of results, distance left aside; a missing value never matches."""
    return reduce(lambda x, y: x & y, (_as_column(r, columns) for r in rules(c)))


def map_filter(c: Criteria, ids: list[str] | None = None, pinned: Any = None) -> list:
    """The criteria as a nested expression."""
    whole = ["all", *map(_as_expression, rules(c))]
    if ids is not None:
        whole.append(["match", ["get", "id"], ids, True, False])
    return whole if pinned is None else ["any", ["==", ["get", "id"], pinned], whole]


def overview_filter(c: Criteria) -> list:
    """The rules that the thinned layer, which has kind and length only, can answer."""
    return ["all", *(_as_expression(r) for r in rules(c) if r.props[0] in ("kind", "length_m"))]


def compile_expression(e: Any, columns: list[str]) -> Column:
    """A column from a nested expression; unknown properties are null."""
    if not isinstance(e, list):
        return F.lit(e)
    op, args = e[0], e[1:]
    if op == "get":
        return F.col(args[0]) if args[0] in columns else F.lit(None)
    if op == "literal":
        return F.lit(args[0])
    if op == "match":
        value = compile_expression(args[0], columns)
        return F.when(value.isin(*args[1]) if args[1] else F.lit(False), F.lit(args[2])).otherwise(F.lit(args[3]))
    x = [compile_expression(a, columns) for a in args]
    if op in ("all", "any"):
        out = F.coalesce(x[0], F.lit(False))
        for v in x[1:]:
            v = F.coalesce(v, F.lit(False))
            out = out & v if op == "all" else out | v
        return out
    if op == "coalesce":
        return F.coalesce(*x)
    if op == "case":
        out = F.when(x[0], x[1])
        for i in range(2, len(x) - 1, 2):
            out = out.when(x[i], x[i + 1])
        return out.otherwise(x[-1])
    compare = {"==": x[0] == x[1], "!=": x[0] != x[1], "<=": x[0] <= x[1], ">=": x[0] >= x[1], "<": x[0] < x[1], ">": x[0] > x[1]}
    if op not in compare:
        raise ValueError(f"unknown operator {op!r}")
    return compare[op]


def search(df: DataFrame, c: Criteria, position: tuple[float, float] | None = None, pinned: Any = None) -> DataFrame:
    """Matching features with ``distance_m``; a pinned one is kept whatever the criteria.

    With a position, a rectangle on ``lon`` and ``lat`` goes to the scan before
    the exact distance is computed.
    """
    keep = matches(c, df.columns)
    is_pinned = F.lit(False) if pinned is None else F.col("id") == pinned
    if position is None:
        return df.where(is_pinned | keep).withColumn("distance_m", F.lit(None).cast("double"))
    lon, lat = position
    d_lat = c.max_distance_m / 111_000
    d_lon = d_lat / max(0.01, math.cos(math.radians(min(89.0, abs(lat) + d_lat))))
    near = F.col("lon").between(lon - d_lon, lon + d_lon) & F.col("lat").between(lat - d_lat, lat + d_lat)
    rows = df.where(is_pinned | (near & keep))
    rows = rows.withColumn("distance_m", geo.haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")))
    return rows.where(is_pinned | (F.col("distance_m") <= c.max_distance_m))


def order_of(sort_by: str) -> list[Column]:
    """Sort columns; a missing distance is infinite, missing score and gain are 0, the identifier ends ties."""
    distance = F.coalesce("distance_m", F.lit(float("inf"))).asc()
    score, gain = F.coalesce("score", F.lit(0.0)).desc(), F.coalesce("elev_gain_m", F.lit(0.0)).desc()
    keys = {"distance": [distance, score], "gain": [gain, distance], "score": [score, distance]}
    return [*keys[sort_by], F.col("id").asc()]
