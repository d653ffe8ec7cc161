"""Queries of graph operators; parts are edges between a few hundred nodes, orders are ways."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import network as N
from ..registry import query
from ..sources.tables import read

_G = "WITH g AS (SELECT p_partkey AS e, p_partkey % 701 AS a, p_partkey * 3 % 811 AS b FROM part)"


def graph(spark, sf_dir):
    """``(e, start_node, end_node)``."""
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(key.alias("e"), (key % 701).alias("start_node"), (key * 3 % 811).alias("end_node"))


def ends(spark, sf_dir):
    """``(half, tail, bearing)`` with a made-up whole-degree bearing."""
    return N.half_edges(graph(spark, sf_dir)).select("half", "tail", (F.col("half") * 97 % 360).cast("double").alias("bearing"))


def barriers(spark):
    return spark.range(0, 900, 37).select(F.col("id").alias("node_id"))


_NODES = "n AS (SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos, l_partkey AS node_id FROM lineitem)"


def way_nodes(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), (F.row_number().over(order) - 1).alias("pos"), F.col("l_partkey").alias("node_id"))
    return rows


@query("a11_degree", f"{_G} SELECT node_id, count(*) AS degree FROM (SELECT a AS node_id FROM g UNION ALL SELECT b FROM g) GROUP BY node_id")
def a11_degree(spark, sf_dir):
    return N.degrees(graph(spark, sf_dir))


@query(
    "h1_split_ways",
    f"WITH {_NODES}, u AS (SELECT node_id FROM n GROUP BY node_id HAVING count(*) >= 34 UNION SELECT * FROM range(0, 900, 37)), "
    "r AS (SELECT n.*, (u.node_id IS NOT NULL AND pos > 0 AND pos < max(pos) OVER (PARTITION BY way_id))::INT AS c FROM n LEFT JOIN u USING (node_id)), "
    "k AS (SELECT *, sum(c) OVER (PARTITION BY way_id ORDER BY pos) AS s FROM r), p AS (SELECT way_id, pos, node_id, s AS piece FROM k UNION ALL SELECT way_id, pos, node_id, s - 1 FROM k WHERE c = 1) "
    "SELECT way_id, piece::BIGINT AS piece, arg_min(node_id, pos) AS start_node, arg_max(node_id, pos) AS end_node, count(*) AS n_nodes FROM p GROUP BY ALL HAVING count(*) >= 2",
)
def h1_split_ways(spark, sf_dir):
    return N.split_ways(way_nodes(spark, sf_dir), barriers(spark), shared=34)


@query(
    "h3_straight_pairs",
    f"{_G}, h AS (SELECT 2 * e AS half, a AS tail FROM g UNION ALL SELECT 2 * e + 1, b FROM g), d AS (SELECT *, count(*) OVER (PARTITION BY tail) AS deg FROM h) "
    "SELECT min(half) AS a, max(half) AS b FROM d WHERE deg = 2 AND tail NOT IN (SELECT * FROM range(0, 900, 37)) GROUP BY tail",
)
def h3_straight_pairs(spark, sf_dir):
    """The pairs of degree-two nodes, which hold whatever the bearing."""
    return N.pair_ends(ends(spark, sf_dir), barriers(spark), max_deflection=-1.0)


@query("h3_pair_ends")
def h3_pair_ends(spark, sf_dir):
    return N.pair_ends(ends(spark, sf_dir), barriers(spark))


@query("h4_strokes")
def h4_strokes(spark, sf_dir):
    """Edges by stroke and position; a test compares with a sequential walk."""
    return N.chains(graph(spark, sf_dir), N.pair_ends(ends(spark, sf_dir), barriers(spark)))


@query("h6_stroke_ids")
def h6_stroke_ids(spark, sf_dir):
    """Strokes with their number among all, by smallest edge."""
    strokes = N.chains(graph(spark, sf_dir), N.pair_ends(ends(spark, sf_dir), barriers(spark))).groupBy("stroke").agg(F.count("*").alias("n_edges"))
    return strokes.select(F.format_string("s%06d", F.dense_rank().over(Window.orderBy("stroke")) - 1).alias("stroke_id"), "stroke", "n_edges")


@query(
    "h7_two_core",
    f"WITH RECURSIVE {_G.removeprefix('WITH ')}, p AS (SELECT 0 AS r, list(e) AS es, count(*) + 1 AS was FROM g UNION ALL SELECT r + 1, (SELECT list(e) FROM g WHERE list_contains(p.es, e) "
    "AND a NOT IN (SELECT v FROM (SELECT a AS v FROM g WHERE list_contains(p.es, e) UNION ALL SELECT b FROM g WHERE list_contains(p.es, e)) GROUP BY v HAVING count(*) = 1) "
    "AND b NOT IN (SELECT v FROM (SELECT a AS v FROM g WHERE list_contains(p.es, e) UNION ALL SELECT b FROM g WHERE list_contains(p.es, e)) GROUP BY v HAVING count(*) = 1)), len(es) FROM p WHERE len(es) < was) "
    "SELECT unnest(es) AS e FROM (SELECT es FROM p ORDER BY r DESC LIMIT 1)",
)
def h7_two_core(spark, sf_dir):
    """The two-core of all edges."""
    return N.two_core(graph(spark, sf_dir)).select("e")


@query("h8_faces")
def h8_faces(spark, sf_dir):
    """Half-edges by face; a test compares with walking the orbits."""
    half = N.half_edges(graph(spark, sf_dir)).select("half", "tail", (F.col("half") * 97 % 360).cast("double").alias("angle"))
    return N.faces(half)
