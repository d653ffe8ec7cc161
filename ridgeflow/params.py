"""Parameters with their defaults, read from TOML with overrides."""

from __future__ import annotations

import dataclasses
import tomllib
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class NetworkParams:
    max_deflection_deg: float = 35.0
    bearing_probe_m: float = 15.0


@dataclass(frozen=True)
class ProfileParams:
    step_m: float = 5.0
    lateral_offset_m: float = 0.0
    structure_margin_m: float = 5.0
    max_gap_fill_m: float = 20.0
    median_window_m: float = 15.0
    gaussian_sigma_m: float = 10.0
    grade_base_m: float = 20.0
    gain_hysteresis_m: float = 0.5


@dataclass(frozen=True)
class FlatParams:
    target_lengths_m: tuple[float, ...] = (200.0, 400.0, 1000.0)
    max_mean_grade_pct: float = 1.0
    max_local_grade_pct: float = 2.0
    max_sinuosity: float = 1.2


@dataclass(frozen=True)
class ClimbParams:
    target_lengths_m: tuple[float, ...] = (100.0, 200.0, 400.0, 800.0)
    min_mean_grade_pct: float = 3.0
    max_mean_grade_pct: float = 50.0
    min_local_grade_pct: float = 1.0
    max_flat_stretch_m: float = 20.0
    max_sinuosity: float = 1.5


@dataclass(frozen=True)
class DedupParams:
    buffer_m: float = 20.0
    max_overlap: float = 0.5


@dataclass(frozen=True)
class Params:
    """All groups; unknown names in a file or an override are errors."""

    network: NetworkParams = field(default_factory=NetworkParams)
    profile: ProfileParams = field(default_factory=ProfileParams)
    flat: FlatParams = field(default_factory=FlatParams)
    climb: ClimbParams = field(default_factory=ClimbParams)
    long_climb: ClimbParams = field(
        default_factory=lambda: ClimbParams((1000.0, 1500.0, 2000.0, 3000.0), min_mean_grade_pct=2.5, max_flat_stretch_m=150.0, max_sinuosity=3.0)
    )
    dedup: DedupParams = field(default_factory=DedupParams)
    window_step_m: float = 10.0


def _replaced(params: Any, values: dict[str, Any]) -> Any:
    known = {f.name for f in dataclasses.fields(params)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown parameters {unknown}")
    new = {}
    for name, value in values.items():
        old = getattr(params, name)
        if dataclasses.is_dataclass(old):
            new[name] = _replaced(old, value)
        elif isinstance(old, tuple):
            new[name] = tuple(map(float, value))
        else:
            new[name] = type(old)(value)
    return dataclasses.replace(params, **new)


def load_params(toml: str = "", overrides: tuple[str, ...] = ()) -> Params:
    """Defaults, then a TOML document, then overrides ``group.name=value``."""
    params = _replaced(Params(), tomllib.loads(toml))
    for item in overrides:
        path, _, value = item.partition("=")
        nested: Any = tomllib.loads(f"x = {value}")["x"]
        for name in reversed(path.split(".")):
            nested = {name: nested}
        params = _replaced(params, nested)
    return params


def samples_for(length_m: float, step_m: float) -> int:
    """Samples of a length, half to even, one at least."""
    return max(1, round(length_m / step_m))
