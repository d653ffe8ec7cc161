"""Scores of stretches as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import ClimbParams, FlatParams

#: Scores of surfaces and lighting, and the weights of the components.
SURFACE_SCORES = {"paved": 1.0, "compacted": 0.8, "gravel": 0.6, "unknown": 0.5, "cobbles": 0.4, "unpaved": 0.4}
LIT_SCORES = {"yes": 1.0, "partial": 0.5, "unknown": 0.3, "no": 0.0}
FLAT_WEIGHTS = {"flatness": 0.35, "straightness": 0.20, "crossings": 0.25, "surface": 0.10, "lighting": 0.05, "length": 0.05}
CLIMB_WEIGHTS = {"regularity": 0.35, "crossings": 0.30, "straightness": 0.10, "surface": 0.15, "lighting": 0.05, "length": 0.05}


def unit(x: Column) -> Column:
    """Clipped to 0 to 1; not a number, infinite or null counts 0."""
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(fine, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(0.0)


def lookup(key: Column, values: dict[str, float], default: float) -> Column:
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def crossings(n: Column, length_m: Column) -> Column:
    return 1 / (1 + n / F.greatest(length_m / 1000.0, F.lit(1e-9)))


def straightness(sinuosity: Column, most: float) -> Column:
    return unit(1 - (sinuosity - 1) / (most - 1))


def weighted(components: dict[str, Column], weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + unit(components[name]) * weight
    return total * 100 / sum(weights.values())


def _common(sinuosity: Column, n_crossings: Column, length_m: Column, surface: Column, lit: Column, n_fits: Column, params: FlatParams | ClimbParams) -> dict[str, Column]:
    return {
        "straightness": straightness(sinuosity, params.max_sinuosity),
        "crossings": crossings(n_crossings, length_m),
        "surface": lookup(surface, SURFACE_SCORES, 0.5),
        "lighting": lookup(lit, LIT_SCORES, 0.3),
        "length": n_fits / float(len(params.target_lengths_m)),
    }


def score_flat(grade_mean: Column, grade_max: Column, sinuosity: Column, n_crossings: Column, length_m: Column, surface: Column, lit: Column, n_fits: Column, params: FlatParams) -> Column:
    flatness = 1 - F.abs(grade_mean) / params.max_mean_grade_pct * 0.5 - grade_max / params.max_local_grade_pct * 0.5
    return weighted({"flatness": flatness, **_common(sinuosity, n_crossings, length_m, surface, lit, n_fits, params)}, FLAT_WEIGHTS)


def score_climb(grade_mean: Column, grade_std: Column, sinuosity: Column, n_crossings: Column, length_m: Column, surface: Column, lit: Column, n_fits: Column, params: ClimbParams) -> Column:
    regularity = F.when(grade_mean > 0, 1 - grade_std / grade_mean).otherwise(0.0)
    return weighted({"regularity": regularity, **_common(sinuosity, n_crossings, length_m, surface, lit, n_fits, params)}, CLIMB_WEIGHTS)
