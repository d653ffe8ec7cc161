"""Sinks of published features: GeoJSON, identifier index, metadata, WKB, verification."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def rounded(x: Column, digits: int) -> Column:
    """Rounded for export; not a number, infinite and missing are null, and no negative zero."""
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(fine, F.round(x, digits) + F.lit(0.0))


def geojson_feature(kind: str, coordinates: Column, properties: Column) -> Column:
    """One feature as JSON text; null properties are left out."""
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def write_geojson_lines(df: DataFrame, path: str, column: str = "feature") -> None:
    """Features as newline-delimited GeoJSON, one part a task."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def id_index(df: DataFrame, prefix: int) -> DataFrame:
    """``(index_key, id, entry)``: the entry is a position, with the target if a redirect has one."""
    key = F.substring(F.split_part("id", F.lit("-"), F.lit(2)), 1, prefix)
    return df.select(key.alias("index_key"), "id", F.array(F.round("lon", 6), F.round("lat", 6)).alias("entry"))


def write_id_index(df: DataFrame, path: str, prefix: int) -> None:
    """The index as JSON in one folder a key."""
    id_index(df, prefix).write.mode("overwrite").partitionBy("index_key").json(path)


def metadata(df: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Bounds, counts by kind and sources, as one row of one aggregate."""
    return df.agg(
        F.min("lon").alias("min_lon"),
        F.min("lat").alias("min_lat"),
        F.max("lon").alias("max_lon"),
        F.max("lat").alias("max_lat"),
        *(F.count_if(F.col("kind") == k).alias(k) for k in kinds),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )


def mismatches(expected: DataFrame, found: DataFrame, key: str = "id", tolerance: float = 1e-9) -> DataFrame:
    """``(id, problem)``: missing, unknown and differing rows; numbers agree within a tolerance."""
    a, b = expected.alias("a"), found.alias("b")
    rows = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    same = F.lit(True)
    for name, kind in expected.dtypes:
        if name == key:
            continue
        x, y = F.col(f"a.{name}"), F.col(f"b.{name}")
        if kind in ("double", "float"):
            close = F.abs(x - y) <= F.greatest(F.greatest(F.abs(x), F.abs(y)) * tolerance, F.lit(tolerance))
            same = same & F.coalesce(close, x.isNull() & y.isNull())
        else:
            same = same & x.eqNullSafe(y)
    problem = F.when(F.col(f"b.{key}").isNull(), "missing").when(F.col(f"a.{key}").isNull(), "unknown").when(~same, "differs")
    return rows.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), problem.alias("problem")).where("problem IS NOT NULL")


@F.pandas_udf(BinaryType())
def wkb_line(lines: pd.Series) -> pd.Series:
    """Well-known binary of lines, arrays of ``(x, y)``."""

    def one(line: list) -> bytes:
        flat = [v for p in line for v in (p["x"], p["y"])]
        return struct.pack("<BII", 1, 2, len(line)) + struct.pack(f"<{len(flat)}d", *flat)

    return lines.map(one, na_action="ignore")


def tiles_table(df: DataFrame, path: str, zoom: int) -> None:
    """Features partitioned by the column of their tile, so that a search reads few folders."""
    from ..functions import geo

    rows = df.withColumn("t", geo.tile(F.col("lon"), F.col("lat"), zoom)).withColumn("z", F.lit(zoom))
    rows.withColumn("x", F.col("t.x")).withColumn("y", F.col("t.y")).drop("t").write.mode("overwrite").partitionBy("z", "x").parquet(path)
