"""Raw profiles from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, float, str]:
    """Samples ``(stroke_id, i, z, elevation_source)``, their one step and the most frequent source.

    Different steps in one table are an error; an empty table has step 0 and the source ``unknown``.
    """
    rows = spark.read.parquet(path)
    steps = rows.agg(F.min("step_m"), F.max("step_m")).first()
    if steps[0] != steps[1]:
        raise ValueError(f"{path}: mixed steps {steps[0]} and {steps[1]}")
    main = rows.groupBy("elevation_source").count().orderBy(F.desc("count"), "elevation_source").first()
    samples = rows.select("stroke_id", "elevation_source", F.posexplode("z_raw").alias("i", "z"))
    return samples.select("stroke_id", F.col("i").cast("long").alias("i"), "z", "elevation_source"), steps[0] or 0.0, main[0] if main else "unknown"
