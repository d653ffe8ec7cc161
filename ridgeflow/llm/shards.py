"""Sharding by a two-pass external shuffle.

Pass one scatters the records by a seeded hash into as many buckets as make
each fit in memory.  Pass two takes one bucket a task, puts it into a fixed
order, permutes it by Fisher-Yates (what ``shuffle`` of an array does) and
writes it.  A bucket's offset is the number of records in the buckets before,
so every record has a place in one global permutation; shards are equal ranges
of places, and their counts are at most one apart (law ``rows``).  All of it
is DataFrame expressions.  The result depends on the records and the seed, not
on file layout, partition sizes, levels or retries.

Beyond ``MAX_BUCKETS`` buckets the scatter has two levels: records are first
written into cells of that many buckets, then every cell is shuffled by
itself, so no shuffle has more reducers and nothing that is broadcast more
rows.

Records that agree in all columns would fall into one bucket.  They are
counted first, by a digest; where there are any, each distinct one is counted
with partial sums and its copies get numbers, which scatter them like others.

Defined results: a null text counts no bytes.  Fewer records than shards leave
shards empty; an empty table leaves all empty.  All columns are written, and
the names ``shard`` and ``slot`` are refused if taken.  Columns must be
comparable (no maps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, scratch, table

SHARDS = 16
SEED = 20_240_229
#: Text bytes of a bucket, on average: what a task of a small executor can hold some times over.
BUCKET_BYTES = 16 << 20
#: Buckets of one shuffle, and rows of what is broadcast.
MAX_BUCKETS = 4_096
#: Tasks that write one cell.
CELL_TASKS = 32
#: Digests of repeated records (8 bytes each) up to which they are broadcast; beyond, the join is shuffled.
MAX_BROADCAST_ROWS = 250_000


def _spread(df: DataFrame) -> DataFrame:
    """``(record, copy)``: all columns of each record, and a number that tells equal records apart."""
    record = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    # Different records may have one digest: they are counted as records then, so nothing is mixed up.
    rows = df.select(record.alias("record"), F.xxhash64(record).alias("digest"))
    path = scratch(df.sparkSession, "repeated")
    rows.groupBy("digest").count().where("count > 1").select("digest").write.parquet(path)
    again = df.sparkSession.read.parquet(path)
    n = again.count()
    single = rows.select("record", F.lit(0).cast("long").alias("copy"), "digest")
    if not n:
        return single.drop("digest")
    again = F.broadcast(again) if n <= MAX_BROADCAST_ROWS else again
    # Partial sums before the exchange: a record that is a third of all rows becomes one row a task.
    counted = rows.join(again, "digest", "left_semi").groupBy("record").agg(F.count("*").alias("n"))
    copies = counted.select("record", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return single.join(again, "digest", "left_anti").drop("digest").union(copies)


def bucket_of(seed: int, id_column: Column, text: Column, copy: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), id_column, text, copy), F.lit(buckets)).cast("int")


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_column: str = "doc_id", text_column: str = "text", max_buckets: int = MAX_BUCKETS) -> None:
    """Write all records with ``shard`` and ``slot``, partitioned by shard, below ``path``."""
    if taken := {"shard", "slot"} & {x.lower() for x in df.columns}:
        raise ValueError(f"columns {sorted(taken)} are taken")
    spark = df.sparkSession
    total, rows = df.agg(F.sum(F.coalesce(F.octet_length(text_column), F.lit(0)) + 1), F.count("*")).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    cells = -(-buckets // max_buckets)
    key = [F.col("record").getField(c) for c in (id_column, text_column)]
    scattered = _spread(df.select(id_column, text_column, *(c for c in df.columns if c not in (id_column, text_column))))
    scattered = scattered.select(bucket_of(seed, *key, F.col("copy"), buckets).alias("bucket"), "record", "copy")
    sizes = scratch(spark, "bucket-sizes")
    cell_path = scratch(spark, "cells")
    if cells > 1:
        cell = F.floor(F.col("bucket") / max_buckets).cast("int")
        scattered.withColumn("cell", cell).repartition(cells * CELL_TASKS, "cell", F.pmod("bucket", F.lit(CELL_TASKS))).write.partitionBy("cell").parquet(cell_path)
        scattered = spark.read.schema(scattered.schema.add("cell", "integer")).parquet(cell_path)
    scattered.groupBy("bucket").count().write.parquet(sizes)
    counts = spark.read.parquet(sizes).withColumn("cell", F.floor(F.col("bucket") / max_buckets).cast("int"))
    # A cell has ``max_buckets`` buckets at most, so has each window; there is a row for each cell on the driver.
    of_cells = dict(counts.groupBy("cell").agg(F.sum("count")).collect())
    within = F.sum("count").over(Window.partitionBy("cell").orderBy("bucket")) - F.col("count")
    before = 0
    for cell in range(cells):
        first, last = cell * max_buckets, min(buckets, (cell + 1) * max_buckets)
        part = scattered.where(F.col("cell") == cell).drop("cell") if cells > 1 else scattered
        offsets = counts.where(F.col("cell") == cell).select("bucket", (F.lit(before) + within).alias("offset"))
        _fill(part, offsets, first, last, shards, seed, rows).write.mode("append").partitionBy("shard").parquet(path)
        before += of_cells.get(cell, 0)
    remove(spark, cell_path)
    remove(spark, sizes)


def _fill(scattered: DataFrame, offsets: DataFrame, first: int, last: int, shards: int, seed: int, rows: int) -> DataFrame:
    """The records of buckets ``first`` to ``last - 1`` with their shards and slots."""
    # One bucket a partition, by number, so that the permutation's seed is the bucket's own.
    filled = scattered.select((F.col("bucket") - first).alias("part"), "record", "copy").repartitionById(last - first, F.col("part"))
    filled = filled.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("record", "copy"))).alias("records"))
    filled = filled.select((F.col("part") + first).alias("bucket"), F.posexplode(F.shuffle("records", seed + first)).alias("at", "x"))
    placed = filled.join(F.broadcast(offsets), "bucket").select("x.record.*", (F.col("offset") + F.col("at")).alias("place"))
    shard = F.expr(f"({shards} * (place + 1) + {rows - 1}) div {max(rows, 1)} - 1")
    placed = placed.withColumn("shard", shard.cast("int"))
    return placed.withColumn("slot", F.expr(f"place - cast(shard AS bigint) * {rows} div {shards}")).drop("place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op5_two_pass_shuffle``: all documents in 16 shards, read back from the written shards."""
    docs = table(spark, sf_dir, "documents")
    path = scratch(spark, "shards")
    write_shards(docs.select("doc_id", "text"), path)
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    schema = docs.select("doc_id", "text").schema.add("slot", "long").add("shard", "integer")
    return spark.read.schema(schema).parquet(path).select(
        "doc_id",
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
