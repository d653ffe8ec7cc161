"""Raw profiles as Parquet, one row a stroke, and tables as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_profiles(samples: DataFrame, path: str, step_m: float) -> None:
    """Samples ``(stroke_id, i, z, elevation_source)`` as ``(stroke_id, step_m, z_raw, elevation_source)``.

    A stroke is one row, as its readers expect; missing heights stay null.
    """
    heights = F.array_sort(F.collect_list(F.struct("i", "z")))
    rows = samples.groupBy("stroke_id").agg(heights.alias("p"), F.min("elevation_source").alias("elevation_source"))
    rows.select("stroke_id", F.lit(float(step_m)).alias("step_m"), F.col("p.z").alias("z_raw"), "elevation_source").write.mode("overwrite").parquet(path)


def markdown_table(df: DataFrame, most: int = 1_000) -> str:
    """A report as a Markdown table, for people to read: at most ``most`` rows, more are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    cells = [df.columns, *([str(v) for v in r] for r in rows)]
    lines = ["| " + " | ".join(c) + " |" for c in cells]
    return "\n".join([lines[0], "|" + "---|" * len(df.columns), *lines[1:]])
