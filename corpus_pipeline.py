"""A training-corpus pipeline over ``documents``.

Each stage calls one operator of ``ridgeflow.llm`` on all that the stage before
kept.  The driver of a run writes each stage's rows and reads them again, so a
lost executor costs part of one stage.

Defined results, for every stage: all columns of the input come back, whatever
further ones it has; only ``doc_id``, ``text`` and ``n_chars`` (set anew where
a text changes) are looked at.  An empty table gives an empty table.

* Quality rules reject null, empty and short texts, and judge repeated rows one
  by one.
* Near duplicates: of rows with equal ``doc_id`` and shingles one stays; rows
  without ``doc_id`` or words all stay; on ties the smallest ``doc_id`` stays.
* Decontamination judges every row by its own text; null has no words.
* Personal data: null stays null, unchanged texts keep their ``n_chars``.
* Tokens: null counts as empty; an input column named like a result goes on as
  ``<name>_input``.

Very long texts are treated whole everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeflow.llm import bpe, jaccard, pii, quality, winnow
from ridgeflow.llm.common import remove, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are cut out, rejected documents go."""
    return quality.clean(docs, length_column="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones stays: 80 percent of the shingles of five words or more are the same."""
    return jaccard.deduplicate(spark, docs, percent=80, width=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return pii.redact(spark, docs, pii.learn(docs), length_column="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers are added."""
    return bpe.encode_onto(docs, bpe.default_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("BPE encoding and decoding", tokens),
]

#: SQL can express neither the random field nor the encoder; a test compares the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is deleted when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        path = scratch(spark, name.replace(" ", "-"))
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
