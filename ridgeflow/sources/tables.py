"""The driver's tables as model objects: samples, parts, lines and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, divisor: int = 20_000) -> DataFrame:
    """Elevation samples every 5 m: a stroke is a user's events in time order, heights are running integer sums."""
    events = read(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select(
        F.col("user_id").alias("stroke_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("i"),
        (F.round(F.col("value") * 100).cast("bigint") - 5000).alias("dz"),
        "event_type",
    )
    height = F.sum("dz").over(Window.partitionBy("stroke_id").orderBy("i")).cast("double") / float(divisor)
    return rows.select("stroke_id", "i", (F.col("i") * F.lit(5.0)).alias("d"), height.alias("z"), "event_type")


def samples_sql(divisor: int = 20_000) -> str:
    """The same in DuckDB, as the common table expression ``samples``."""
    return f"""s0 AS (SELECT user_id AS stroke_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
        round(value * 100)::BIGINT - 5000 AS dz, event_type FROM events),
    samples AS (SELECT stroke_id, i, 5.0::DOUBLE * i AS d, (sum(dz) OVER (PARTITION BY stroke_id ORDER BY i))::DOUBLE / {divisor}.0::DOUBLE AS z, event_type FROM s0)"""


def gapped(spark: SparkSession, sf_dir: str, divisor: int = 20_000) -> DataFrame:
    """``samples`` with ``structure`` (bridge or tunnel) and missing heights."""
    kind = F.when(F.col("event_type") == "signup", "bridge").when(F.col("event_type") == "logout", "tunnel")
    z = F.when(F.col("event_type") != "error", F.col("z"))
    return samples(spark, sf_dir, divisor).withColumn("structure", kind).withColumn("z", z)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Way parts: the lines of an order, with length, surface, lighting and way."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("stroke_id"),
        F.col("l_partkey").alias("way_id"),
        F.col("l_quantity").cast("double").alias("length"),
        F.col("l_returnflag").alias("surface"),
        F.col("l_linestatus").alias("lit"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight lines with kind and score, from the first numbers of the embeddings."""
    e = read(spark, sf_dir, "embeddings")
    at = [F.floor(F.element_at("embedding", k + 1).cast("double") * 1000) for k in range(5)]
    return e.select(
        F.col(e.columns[0]).alias("id"),
        F.col("label").alias("kind"),
        *(a.cast("bigint").alias(n) for a, n in zip(at, ("x0", "y0", "x1", "y1", "score"), strict=True)),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as result features with a position, length, kind and score."""
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("id"),
        (1 + (key % 1000) / F.lit(500.0)).alias("lon"),
        (43 + F.col("c_nationkey") / F.lit(50.0)).alias("lat"),
        F.element_at(F.array(*map(F.lit, ("flat", "climb", "long_climb", "loop"))), (key % 4 + 1).cast("int")).alias("kind"),
        ((key * 37) % 3000).cast("double").alias("length_m"),
        (key % 3).cast("int").alias("n_crossings"),
        F.element_at(F.array(*map(F.lit, ("paved", "compacted", "gravel", "unpaved", "cobbles", "unknown"))), (key % 6 + 1).cast("int")).alias("surface"),
        ((key * 13) % 700 / F.lit(100.0)).alias("grade_max_pct"),
        ((key * 17) % 900 / F.lit(100.0)).alias("grade_mean_pct"),
        F.when(key % 5 != 0, (key * 19) % 1200 / F.lit(100.0)).alias("steep_200_pct"),
        F.when(key % 4 != 3, F.round(F.col("c_acctbal")).cast("double")).alias("score"),
        F.when(key % 4 != 0, (key * 7) % 97).cast("double").alias("elev_gain_m"),
        F.element_at(F.array(*map(F.lit, ("track", "circuit"))), (key % 2 + 1).cast("int")).alias("loop_type"),
        F.element_at(F.array(*map(F.lit, ("water", "park", "neighbourhood", "countryside", "water"))), (key % 5 + 1).cast("int")).alias("setting"),
        F.element_at(F.array(*map(F.lit, ("public", "restricted", "unknown"))), (key % 3 + 1).cast("int")).alias("access"),
    )


POSITIONS_SQL = """positions AS (SELECT c_custkey AS id, 1 + (c_custkey % 1000) / 500.0::DOUBLE AS lon, 43 + c_nationkey / 50.0::DOUBLE AS lat,
    ['flat', 'climb', 'long_climb', 'loop'][c_custkey % 4 + 1] AS kind, ((c_custkey * 37) % 3000)::DOUBLE AS length_m,
    (c_custkey % 3)::INT AS n_crossings, ['paved', 'compacted', 'gravel', 'unpaved', 'cobbles', 'unknown'][c_custkey % 6 + 1] AS surface,
    ((c_custkey * 13) % 700) / 100.0::DOUBLE AS grade_max_pct, ((c_custkey * 17) % 900) / 100.0::DOUBLE AS grade_mean_pct,
    CASE WHEN c_custkey % 5 != 0 THEN ((c_custkey * 19) % 1200) / 100.0::DOUBLE END AS steep_200_pct,
    CASE WHEN c_custkey % 4 != 3 THEN round(c_acctbal)::DOUBLE END AS score,
    CASE WHEN c_custkey % 4 != 0 THEN ((c_custkey * 7) % 97)::DOUBLE END AS elev_gain_m,
    ['track', 'circuit'][c_custkey % 2 + 1] AS loop_type, ['water', 'park', 'neighbourhood', 'countryside', 'water'][c_custkey % 5 + 1] AS setting,
    ['public', 'restricted', 'unknown'][c_custkey % 3 + 1] AS access FROM customer)"""

LINES_SQL = """lines AS (SELECT vec_id AS id, label AS kind, floor(embedding[1]::DOUBLE * 1000)::BIGINT AS x0, floor(embedding[2]::DOUBLE * 1000)::BIGINT AS y0,
    floor(embedding[3]::DOUBLE * 1000)::BIGINT AS x1, floor(embedding[4]::DOUBLE * 1000)::BIGINT AS y1, floor(embedding[5]::DOUBLE * 1000)::BIGINT AS score FROM embeddings)"""
