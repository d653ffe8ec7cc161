"""Queries of the comments store; a conversation is a spot, its turns are comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import comments as C
from ..registry import query
from ..sources.tables import read

_C = """WITH c AS (SELECT conv_id * 1000 + turn AS id, 'flat-' || substr(sha1((conv_id % 20)::VARCHAR), 1, 12) AS spot_id, role AS author, text AS body,
    conv_id * 7 % 101 + turn AS created_at, CASE conv_id % 6 WHEN 0 THEN 'hidden' WHEN 1 THEN 'approved' ELSE 'visible' END AS status, (conv_id % 4)::INT AS reports FROM conversations)"""
_NEWEST = "ORDER BY created_at DESC, id DESC LIMIT 200"


def store(spark, sf_dir):
    key = F.col("conv_id")
    return read(spark, sf_dir, "conversations").select(
        (key * 1000 + F.col("turn")).alias("id"),
        F.concat(F.lit("flat-"), F.substring(F.sha1((key % 20).cast("string")), 1, 12)).alias("spot_id"),
        F.col("role").alias("author"),
        F.col("text").alias("body"),
        (key * 7 % 101 + F.col("turn")).alias("created_at"),
        F.when(key % 6 == 0, "hidden").when(key % 6 == 1, "approved").otherwise("visible").alias("status"),
        (key % 4).cast("int").alias("reports"),
    )


_SPOT = "flat-356a192b7913"  # the spot of 1


@query("q1_list", f"{_C} SELECT id, author, body, created_at FROM c WHERE spot_id = '{_SPOT}' AND status != 'hidden' {_NEWEST}")
def q1_list(spark, sf_dir):
    return C.list_visible(store(spark, sf_dir), _SPOT)


@query("q2_insert", f"{_C} SELECT id, spot_id, status, reports FROM c UNION ALL SELECT -id, spot_id, 'visible', 0 FROM c WHERE id % 50 = 0")
def q2_insert(spark, sf_dir):
    df = store(spark, sf_dir)
    new = df.where("id % 50 = 0").select((-F.col("id")).alias("id"), "spot_id", "author", "body", "created_at")
    return C.insert(df, new).select("id", "spot_id", "status", "reports")


@query("q3_report", f"{_C}, e AS (SELECT id, count(*)::INT AS n FROM (SELECT id FROM c WHERE id % 2 = 0 UNION ALL SELECT id FROM c WHERE id % 4 = 0) GROUP BY id) SELECT id, (reports + coalesce(n, 0))::INT AS reports, CASE WHEN n IS NOT NULL AND status = 'visible' AND reports + n >= 3 THEN 'hidden' ELSE status END AS status FROM c LEFT JOIN e USING (id)")
def q3_report(spark, sf_dir):
    df = store(spark, sf_dir)
    events = df.where("id % 2 = 0").select("id").union(df.where("id % 4 = 0").select("id"))
    return C.report(df, events).select("id", "reports", "status")


for _name, _test in (("recent", "true"), ("reported", "reports > 0 AND status != 'approved'"), ("hidden", "status = 'hidden'")):
    query(f"q4_{_name}", f"{_C} SELECT id, status, reports FROM c WHERE {_test} {_NEWEST}")(lambda spark, sf_dir, name=_name: C.view(store(spark, sf_dir), name).select("id", "status", "reports"))


@query("q5_moderate", f"{_C} SELECT id, CASE WHEN id % 10 = 3 THEN 'approved' ELSE status END AS status FROM c WHERE id % 9 != 0")
def q5_moderate(spark, sf_dir):
    df = store(spark, sf_dir)
    changes = df.where("id % 10 IN (3, 4)").select("id", F.when(F.col("id") % 10 == 3, "approved").otherwise("gone").alias("status"))
    return C.delete(C.set_status(df, changes), df.where("id % 9 = 0")).select("id", "status")


@query("q6_validate", f"{_C} SELECT id, CASE WHEN id % 8 = 0 THEN 'unknown_spot' WHEN id % 8 = 1 THEN 'no_author' WHEN id % 8 = 2 THEN 'long_author' WHEN id % 8 = 3 THEN 'short_body' WHEN length(body) > 1000 THEN 'long_body' WHEN id % 8 = 4 AND length(body) <= 950 THEN 'many_links' END AS error FROM c WHERE length(body) BETWEEN 20 AND 950 OR length(body) > 1050")
def q6_validate(spark, sf_dir):
    """Comments made wrong by rule, each with the first error."""
    df = store(spark, sf_dir).where("char_length(body) BETWEEN 20 AND 950 OR char_length(body) > 1050")
    case = F.col("id") % 8
    spot = F.when(case == 0, F.lit("flat-xyz")).otherwise(F.col("spot_id"))
    author = F.when(case == 1, F.lit(" \t\n ")).when(case == 2, F.repeat(F.lit("a"), 41)).otherwise(F.col("author"))
    body = F.when(case == 3, F.lit("  a \r\n")).when(case == 4, F.concat("body", F.lit(" http://a https://b www.c"))).otherwise(F.col("body"))
    return df.select("id", C.error_code(spot, author, body).alias("error"))


@query("text_clean", f"{_C} SELECT id, regexp_replace(body, '[ \\t]+', ' ', 'g') AS cleaned, 'a b c' AS line FROM c WHERE body NOT LIKE '% ' AND body NOT LIKE ' %'")
def text_clean(spark, sf_dir):
    df = store(spark, sf_dir).where("body NOT LIKE '% ' AND body NOT LIKE ' %'")
    noisy = F.concat(F.lit(" \t\x07"), F.replace("body", F.lit(" "), F.lit("\t  ")), F.lit("\r\n\r\n"))
    return df.select("id", X.clean_text(noisy, True).alias("cleaned"), X.clean_text(F.lit("\x00 a\n\nb  c "), False).alias("line"))
