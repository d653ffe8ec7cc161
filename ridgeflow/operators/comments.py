"""A moderated comments store as table transformations.

Mutations are new versions of the table: a writer replaces the snapshot it
read, as a merge would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, is_segment_id, link_count

#: Limits of the store.
LIST_MAX, REPORTS_TO_HIDE = 200, 3
AUTHOR_MAX, BODY_MIN, BODY_MAX, LINKS_MAX = 40, 3, 1000, 2
STATUSES = ("visible", "hidden", "approved")


def _newest() -> tuple[Column, Column]:
    return F.desc("created_at"), F.desc("id")


def list_visible(df: DataFrame, spot: str, most: int = LIST_MAX) -> DataFrame:
    """The newest comments of a spot that aren't hidden."""
    rows = df.where((F.col("spot_id") == spot) & (F.col("status") != "hidden"))
    return rows.orderBy(*_newest()).limit(most).select("id", "author", "body", "created_at")


def insert(df: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows ``(id, spot_id, author, body, created_at)`` as visible and unreported."""
    return df.unionByName(new.withColumn("status", F.lit("visible")).withColumn("reports", F.lit(0).cast("int")))


def report(df: DataFrame, events: DataFrame) -> DataFrame:
    """Count reports ``(id)``; a visible comment with enough of them is hidden, an approved one stays."""
    counts = events.groupBy("id").agg(F.count("*").cast("int").alias("_new"))
    rows = df.join(counts, "id", "left").withColumn("reports", F.col("reports") + F.coalesce("_new", F.lit(0)))
    hide = (F.col("status") == "visible") & F.col("_new").isNotNull() & (F.col("reports") >= REPORTS_TO_HIDE)
    return rows.withColumn("status", F.when(hide, "hidden").otherwise(F.col("status"))).drop("_new")


def view(df: DataFrame, name: str, most: int = LIST_MAX) -> DataFrame:
    """A moderator's view: recent, reported or hidden."""
    tests = {"recent": F.lit(True), "reported": (F.col("reports") > 0) & (F.col("status") != "approved"), "hidden": F.col("status") == "hidden"}
    if name not in tests:
        raise ValueError(f"unknown view {name!r}")
    return df.where(tests[name]).orderBy(*_newest()).limit(most)


def set_status(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``(id, status)``; other statuses than the known ones are ignored."""
    new = changes.where(F.col("status").isin(*STATUSES)).select("id", F.col("status").alias("_status"))
    return df.join(new, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def delete(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_anti")


def error_code(spot: Column, author: Column, body: Column) -> Column:
    """The first rule that a new comment breaks, or null."""
    who, text = clean_text(author, False), clean_text(body, True)
    return (
        F.when(~F.coalesce(is_segment_id(spot), F.lit(False)), "unknown_spot")
        .when(who == "", "no_author")
        .when(F.char_length(who) > AUTHOR_MAX, "long_author")
        .when(F.char_length(text) < BODY_MIN, "short_body")
        .when(F.char_length(text) > BODY_MAX, "long_body")
        .when(link_count(text) > LINKS_MAX, "many_links")
    )
