"""Benchmark decontamination by winnowing.

Of every run of ``t - k + 1`` consecutive word k-grams the smallest hash is
kept with its position, the leftmost on ties, on both sides.  A shared span of
t words contains such a run, so both sides keep the same k-gram of it: no
shared span of t words is missed.  Kept fingerprints are joined; each hit is
extended by at most ``t - k`` words on either side, and every stretch of t or
more equal words is a hit.  Items of fewer than t words are matched whole: the
hash of all their words is their fingerprint, and documents keep every n-gram
of those lengths.  Hashes only find candidates, words decide.  All of it is
DataFrame expressions.

Defined results: null has no words; an item without words is ignored, a
document without words is clean.  Items with the same identifier count once.
Every row is judged by its own text, whatever other rows share its identifier
or have none; repeated rows have equal results.  Empty tables give an empty or
an all-clean result.  Only the named columns are read, so others never clash.

A pass over the texts finds both a row's matches and its number of words: a row
without a match besides them, led to the join by a fingerprint that no n-gram has, stands for the row itself.

Arrays are exploded by the outer form: for the inner one the optimiser infers
a filter on the array's size and pushes it, with all that computes the array,
into lambdas that then run once an element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

#: Words of a window (t) and of a k-gram (k).
SPAN = 10
GRAM = 5
#: Rows of the benchmark's fingerprints up to which they are broadcast; beyond, the join is shuffled.
MAX_BROADCAST_ROWS = 200_000
#: Contaminated rows (32 bytes each) up to which they are broadcast; beyond, the join is shuffled.
MAX_BROADCAST_IDS = 250_000
#: Parts of a frequent fingerprint in the shuffled join.
SALTS = 8
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The low bits of a fingerprint are its position, the others the hash.
_POSITION_BITS = 31
#: Stands for a row itself; the hashes of n-grams have ``64 - _POSITION_BITS`` bits.
_ROW = 1 << 40


def words_of(text: Column) -> Column:
    """Words of a text: runs of digits, a to z, and all from U+0080 on, after lower-casing A to Z."""
    plain = F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _CAPITALS.lower())
    return F.filter(F.split(plain, _BREAK), lambda w: w != "")


def row_key(id_column: Column, text: Column) -> Column:
    """What tells rows apart: 32 bytes of identifier and text."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.concat(id_column.cast("string"), F.lit("=")), F.lit("-")), F.coalesce(text, F.lit(""))), 256))


def _grams(words: str, k: int) -> str:
    """SQL of the hashes of all k-grams of an array of words, each with its position in the low bits."""
    parts = ", ".join(f"{words}[i + {j}]" for j in range(k))
    packed = f"shiftleft(shiftright(xxhash64({k}, {parts}), {_POSITION_BITS}), {_POSITION_BITS}) | i"
    return f"IF(size({words}) >= {k}, transform(sequence(0, size({words}) - {k}), i -> {packed}), array())"


def _smallest(grams: str, run: int) -> str:
    """SQL of the smallest value of every run, each once."""
    return f"IF(size({grams}) >= {run}, array_distinct(transform(sequence(1, size({grams}) - {run - 1}), j -> array_min(slice({grams}, j, {run})))), array())"


def _unpacked(df: DataFrame, prints: str) -> DataFrame:
    """A row for each fingerprint of an array, with its hash ``print`` and position ``p``."""
    rows = df.withColumn("packed", F.explode_outer(prints)).where("packed IS NOT NULL")
    return rows.withColumns({"print": F.shiftright("packed", _POSITION_BITS), "p": F.expr(f"cast(packed & {(1 << _POSITION_BITS) - 1}L AS int)")}).drop("packed")


def _count_true(size: str, test: str) -> str:
    """SQL of how many of the tests o = 1, 2, ... up to size hold before the first that doesn't."""
    return f"IF({size} < 1, 0, coalesce(nullif(array_position(transform(sequence(1, greatest({size}, 1)), o -> {test}), false), 0) - 1, {size}))"


def item_fingerprints(items: DataFrame, span: int = SPAN, k: int = GRAM, short: tuple[int, ...] = ()) -> DataFrame:
    """``(print, item, near, lead, n, least)`` of items ``(item, words)``; ``short`` lists the sizes below ``span``.

    ``near`` holds the words from ``lead`` before the n-gram to ``span - n``
    behind it; ``least`` is how many words a hit must have.
    """
    reach = span - k
    rows = items.where(F.size("words") >= span).withColumn("grams", F.expr(_grams("words", k)))
    rows = _unpacked(rows.withColumn("prints", F.expr(_smallest("grams", reach + 1))), "prints")
    found = rows.selectExpr(
        "print",
        "item",
        f"slice(words, greatest(p - {reach}, 0) + 1, least(p, {reach}) + {k + reach}) AS near",
        f"least(p, {reach}) AS lead",
        f"{k} AS n",
        f"{span} AS least",
    )
    for n in short:
        rows = _unpacked(items.where(F.size("words") == n).withColumn("prints", F.expr(_grams("words", n))), "prints")
        found = found.union(rows.selectExpr("print", "item", "words AS near", "0 AS lead", f"{n} AS n", f"{n} AS least"))
    return found.distinct()


def _matched(docs: DataFrame, prints: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """``(key, words, p)`` of ``docs`` with the columns of ``prints`` for each fingerprint that has one.

    With columns ``kept`` these too, and one more row for each row of ``docs``, without ``p`` and what ``prints`` has.
    """
    if prints.count() <= MAX_BROADCAST_ROWS:
        if not kept:
            return _unpacked(docs, "prints").join(F.broadcast(prints), "print")
        rows = docs.withColumn("packed", F.explode_outer(F.expr("concat(prints, array(cast(null AS bigint)))"))).drop("prints")
        # A null stays null in the position.
        rows = rows.withColumns({"print": F.coalesce(F.shiftright("packed", _POSITION_BITS), F.lit(_ROW)), "p": F.expr(f"cast(packed & {(1 << _POSITION_BITS) - 1}L AS int)")})
        own = prints.sparkSession.range(1).select(F.lit(_ROW).alias("print"))
        return rows.drop("packed").join(F.broadcast(prints.unionByName(own, allowMissingColumns=True)), "print")
    slim = _unpacked(docs.select("key", "prints"), "prints").drop("prints")
    slim = slim.withColumn("salt", F.pmod(F.xxhash64("key", "p"), F.lit(SALTS)))
    salted = prints.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    found = slim.join(salted, ["print", "salt"]).drop("print", "salt").distinct()
    found = docs.select("key", "words", *kept).join(found, "key")
    return found.unionByName(docs.select("key", *kept), allowMissingColumns=True) if kept else found


def hits(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = GRAM, kept: tuple[str, ...] = ()) -> DataFrame:
    """``(key, item, start, stop)``: stretches of words of ``docs(key, words)`` that lie in windows of ``items(item, words)``.

    With columns ``kept`` of ``docs`` these too, and one more row for each row of ``docs``, without a stretch.
    """
    sizes = items.select(F.size("words").alias("n")).where(f"n BETWEEN 1 AND {span - 1}").distinct()
    short = tuple(sorted(n for (n,) in sizes.collect()))  # at most span - 1 values
    docs = docs.withColumn("grams", F.expr(_grams("words", k)))
    every = ", ".join([_smallest("grams", span - k + 1), *(_grams("words", n) for n in short)])
    docs = docs.withColumn("prints", F.expr(f"concat({every})")).drop("grams")
    found = _matched(docs, item_fingerprints(items, span, k, short), kept)
    row = "p IS NULL OR " if kept else ""
    # From here on a row has the words around its hit only, however long its text.
    reach = span - k
    found = found.selectExpr(
        "key", *kept, "item", "near", "lead", "n", "least", "p",
        f"slice(words, greatest(p - {reach}, 0) + 1, least(p, {reach}) + n + {reach}) AS around",
        f"least(p, {reach}) AS own",
    )
    found = found.where(f"{row}slice(around, own + 1, n) = slice(near, lead + 1, n)")
    left = _count_true("least(lead, own)", "near[lead - o] = around[own - o]")
    right = _count_true("least(size(near) - lead, size(around) - own) - n", "near[lead + n - 1 + o] = around[own + n - 1 + o]")
    # Exploding keeps the test on what is computed here, with its lambdas, out of the join's condition.
    found = found.select("key", *kept, "item", "least", F.explode_outer(F.expr(f"array(struct(p - {left} AS start, p + n + {right} AS stop))")).alias("x"))
    row = "least IS NULL OR " if kept else ""
    return found.select("key", *kept, "item", "x.start", "x.stop", "least").where(f"{row}stop - start >= least").drop("least")


def contamination(df: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", span: int = SPAN, k: int = GRAM) -> DataFrame:
    """For each row of ``df``: identifier, ``n_words``, ``n_hit``, ``n_items``, ``items`` (strings in order), ``contaminated``."""
    own, text = df[id_column], df[text_column]
    docs = df.select(own.alias("id"), row_key(own, text).alias("key"), words_of(text).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    found = hits(docs, _items(benchmark, item_column, item_text_column), span, k, ("id", "n_words")).groupBy("key").agg(
        F.any_value("id").alias("id"),
        F.any_value("n_words").alias("n_words"),
        F.count_if(F.col("start").isNull()).alias("rows"),
        F.collect_set("item").alias("items"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "stop"))).alias("spans"),
    )
    # Rows of one key are equal in identifier and text.
    found = found.withColumn("row", F.explode_outer(F.sequence(F.lit(1), F.col("rows"))))
    n_hit = F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.stop - 1)))))").cast("long")
    return found.select(
        F.col("id").alias(id_column),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.array_sort("items").alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def _items(benchmark: DataFrame, item_column: str, item_text_column: str) -> DataFrame:
    return benchmark.select(benchmark[item_column].cast("string").alias("item"), words_of(benchmark[item_text_column]).alias("words"))


def _spans(docs: DataFrame, benchmark: DataFrame, item_column: str, item_text_column: str, span: int, k: int) -> DataFrame:
    """``(key, items, spans)`` of the rows of ``docs(key, words)`` with a hit."""
    return hits(docs, _items(benchmark, item_column, item_text_column), span, k).groupBy("key").agg(F.collect_set("item").alias("items"), F.collect_set(F.struct("start", "stop")).alias("spans"))


def decontaminate(df: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", span: int = SPAN, k: int = GRAM) -> DataFrame:
    """The rows of ``df``, with all columns, that no benchmark item contaminates."""
    own, text = df[id_column], df[text_column]
    found = _spans(df.select(row_key(own, text).alias("key"), words_of(text).alias("words")), benchmark, item_column, item_text_column, span, k)
    path = scratch(df.sparkSession, "contaminated")
    found.select(F.col("key").alias("ridgeflow_hit_key")).write.parquet(path)
    found = df.sparkSession.read.parquet(path)
    found = F.broadcast(found) if found.count() <= MAX_BROADCAST_IDS else found
    return df.join(found, row_key(own, text) == F.col("ridgeflow_hit_key"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op6_winnowing``: contamination of every document by all benchmark items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
n AS (SELECT DISTINCT least(len(ws), 10) AS n FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS g
       FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, n WHERE len(ws) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
