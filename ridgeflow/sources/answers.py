"""Answers of web services, as JSON text columns; what can't be used is null or left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Heights at or below this are missing, and the share of missing samples that is too many.
NODATA_BELOW, MAX_MISSING_SHARE = -1000.0, 0.2
_ELEVATIONS = "elevations array<struct<lon: double, lat: double, z: double>>"
_ROUTE = "geometry struct<coordinates: array<array<double>>>, distance double, duration double"
_PLACES = "features array<struct<geometry: struct<coordinates: array<double>>, properties: struct<label: string>>>"


def elevations(text: Column) -> Column:
    """Samples ``(lon, lat, z)`` of an elevation answer; null with fewer than two, a place missing, or too many heights missing."""
    points = F.transform(F.from_json(text, _ELEVATIONS)["elevations"], lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), F.when(p["z"] > NODATA_BELOW, p["z"]).alias("z")))
    placed = F.forall(points, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    missing = F.size(F.filter(points, lambda p: p["z"].isNull()))
    return F.when((F.size(points) >= 2) & placed & (missing <= MAX_MISSING_SHARE * F.size(points)), points)


def route(text: Column) -> Column:
    """``(coordinates, distance_m, duration_s)`` of a route answer; null without a line, a distance or a duration."""
    found = F.from_json(text, _ROUTE)
    line = found["geometry"]["coordinates"]
    fine = (F.size(line) >= 2) & found["distance"].isNotNull() & found["duration"].isNotNull()
    return F.when(fine, F.struct(line.alias("coordinates"), found["distance"].alias("distance_m"), found["duration"].alias("duration_s")))


def places(text: Column) -> Column:
    """``(label, lon, lat)`` of each address of a geocoder answer that has a label and a position."""
    rows = F.transform(F.from_json(text, _PLACES)["features"], lambda f: F.struct(f["properties"]["label"].alias("label"), F.get(f["geometry"]["coordinates"], F.lit(0)).alias("lon"), F.get(f["geometry"]["coordinates"], F.lit(1)).alias("lat")))
    fine = F.filter(rows, lambda r: (F.length(r["label"]) > 0) & r["lon"].isNotNull() & r["lat"].isNotNull())
    return F.coalesce(fine, F.array().cast("array<struct<label: string, lon: double, lat: double>>"))
