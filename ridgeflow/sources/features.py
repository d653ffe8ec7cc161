"""Readers of network extracts, outlines, published indexes and raster tiles."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import classify_way
from ..functions.text import is_segment_id

#: Tags that the library looks at.
USED_TAGS = (
    "highway", "footway", "service", "area", "access", "foot", "oneway:foot", "surface", "tracktype", "lit", "bridge", "tunnel",
    "covered", "layer", "name", "aeroway", "railway", "public_transport", "train", "subway", "light_rail", "tram", "monorail",
)


def osm_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``(node_id, lon, lat)`` of an OSM XML extract."""
    schema = "_id long, _lat double, _lon double"
    rows = spark.read.format("xml").option("rowTag", "node").schema(schema).load(path)
    return rows.select(F.col("_id").alias("node_id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))


def osm_way_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``(way_id, pos, node_id, tags)`` of an OSM XML extract, used tags only."""
    schema = "_id long, nd array<struct<_ref: long>>, tag array<struct<_k: string, _v: string>>"
    rows = spark.read.format("xml").option("rowTag", "way").schema(schema).load(path)
    tags = F.map_from_entries(F.coalesce("tag", F.array().cast("array<struct<_k: string, _v: string>>")))
    tags = F.map_filter(tags, lambda k, _: k.isin(*USED_TAGS))
    rows = rows.select(F.col("_id").alias("way_id"), tags.alias("tags"), F.posexplode("nd").alias("pos", "nd"))
    return rows.select("way_id", "pos", F.col("nd._ref").alias("node_id"), "tags")


def read_ways(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``(way_id, road_class, tags, node_ids, lons, lats)``: relevant ways with a node in the box, kept whole."""
    way_nodes = osm_way_nodes(spark, path)
    way_nodes = way_nodes.where(F.map_contains_key("tags", F.lit("highway"))).withColumn("road_class", classify_way(F.col("tags"))).where("road_class IS NOT NULL")
    rows = way_nodes.join(osm_nodes(spark, path), "node_id")
    inside = F.lit(True)
    if bbox:
        inside = F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3])
    found = rows.groupBy("way_id", "road_class").agg(
        F.first("tags").alias("tags"), F.bool_or(inside).alias("inside"), F.array_sort(F.collect_list(F.struct("pos", "node_id", "lon", "lat"))).alias("p")
    )
    found = found.where(F.col("inside") & (F.size("p") >= 2))
    return found.select("way_id", "road_class", "tags", F.col("p.node_id").alias("node_ids"), F.col("p.lon").alias("lons"), F.col("p.lat").alias("lats"))


def clip(way_nodes: DataFrame, nodes: DataFrame, bbox: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Way nodes of the ways that touch a box, and all their nodes."""
    inside = nodes.where(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3])).select("node_id")
    ways = way_nodes.join(inside, "node_id", "left_semi").select("way_id").distinct()
    kept = way_nodes.join(ways, "way_id", "left_semi")
    return kept, nodes.join(kept.select("node_id").distinct(), "node_id", "left_semi")


def outlines(spark: SparkSession, path: str, overseas: bool = False) -> DataFrame:
    """``(code, name, ring)`` of the polygons of a GeoJSON collection; overseas codes are left out by default."""
    schema = "features array<struct<properties: struct<code_insee: string, nom_officiel: string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    rows = rows.where(F.col("f.geometry.type") == "Polygon")
    ring = F.transform(F.get("f.geometry.coordinates", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    rows = rows.select(F.col("f.properties.code_insee").alias("code"), F.col("f.properties.nom_officiel").alias("name"), ring.alias("ring"))
    return rows if overseas else rows.where(~F.startswith("code", F.lit("97")))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(id, lon, lat, live, target)`` of id index files; entries of three parts are redirects, bad identifiers go."""
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("id", "entry")).where(is_segment_id(F.col("id")) & (F.size("entry") >= 2))
    at = lambda i: F.get("entry", F.lit(i))
    return rows.select("id", at(0).cast("double").alias("lon"), at(1).cast("double").alias("lat"), (F.size("entry") == 2).alias("live"), at(2).alias("target"))


def raster_cells(spark: SparkSession, path: str, columns: int, nodata_below: float = -1000.0) -> DataFrame:
    """``(tile, row, col, z)`` of raw little-endian float tiles, one file a tile; low values are null."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("tile"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tile, content in zip(batch["tile"], batch["content"], strict=True):
                z = [v[0] for v in struct.iter_unpack("<f", content)]
                out = pd.DataFrame({"tile": tile, "row": [i // columns for i in range(len(z))], "col": [i % columns for i in range(len(z))], "z": z})
                out["z"] = out["z"].where(out["z"] >= nodata_below)
                yield out

    cells = files.mapInPandas(run, "tile string, row long, col long, z double")
    return cells.withColumn("z", F.when(~F.isnan("z"), F.col("z")))


def analytic_cells(spark: SparkSession, rows: int, columns: int, height: str) -> DataFrame:
    """A raster whose heights are a SQL expression of ``row`` and ``col``."""
    cells = spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("row"), (F.col("id") % columns).alias("col"))
    return cells.withColumn("z", F.expr(height).cast("double"))
