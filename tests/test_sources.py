"""Readers, sinks and streams on small files."""

from __future__ import annotations

import json
import struct

from pyspark.sql import functions as F

from ridgeflow.sinks import features as sinks
from ridgeflow.sources import features as sources
from ridgeflow.streaming import sessions

#: A lane along the north of the box, a road that leaves it, a path outside, a pond, a proposed road and a closed ring.
NODES = {101: (0.2, 0.9), 102: (0.5, 0.9), 103: (0.8, 0.9), 104: (0.5, 0.4), 105: (0.5, -2.0), 106: (3.0, 3.0), 107: (3.5, 3.1), 108: (0.1, 0.1), 109: (0.2, 0.1), 110: (0.2, 0.2)}
WAYS = {
    901: ([101, 102, 103], {"highway": "track", "tracktype": "grade1", "source": "survey"}),
    902: ([102, 104, 105], {"highway": "secondary", "lit": "yes"}),
    903: ([106, 107], {"highway": "path"}),
    904: ([108, 109, 110, 108], {"natural": "water"}),
    905: ([101, 104], {"highway": "proposed"}),
    906: ([108, 110], {"highway": "path", "foot": "no"}),
    907: ([105, 106], {"highway": "footway"}),
    908: ([103, 103], {"highway": "pedestrian", "area": "yes"}),
}
BOX = (0.0, 0.0, 1.0, 1.0)


def osm_text():
    lines = ["<osm>"] + [f'<node id="{i}" lat="{y}" lon="{x}"/>' for i, (x, y) in NODES.items()]
    for i, (refs, tags) in WAYS.items():
        inner = "".join(f'<nd ref="{r}"/>' for r in refs) + "".join(f'<tag k="{k}" v="{v}"/>' for k, v in tags.items())
        lines.append(f'<way id="{i}">{inner}</way>')
    return "\n".join([*lines, "</osm>"])


def test_osm_ways(spark, tmp_path):
    path = f"file://{tmp_path}/net.osm"
    (tmp_path / "net.osm").write_text(osm_text())
    rows = {r.way_id: r for r in sources.read_ways(spark, path, BOX).collect()}
    assert {i: (r.road_class, r.node_ids) for i, r in rows.items()} == {901: ("path", [101, 102, 103]), 902: ("major", [102, 104, 105])}
    assert rows[901].tags == {"highway": "track", "tracktype": "grade1"}
    ways, nodes = sources.clip(sources.osm_way_nodes(spark, path), sources.osm_nodes(spark, path), BOX)
    touching = {i for i, (refs, _) in WAYS.items() if any(0 <= c <= 1 for r in refs for c in [max(NODES[r])] if min(NODES[r]) >= 0)}
    assert {r.way_id for r in ways.collect()} == touching == {901, 902, 904, 905, 906, 908}
    assert {r.node_id for r in nodes.collect()} == {n for i in touching for n in WAYS[i][0]}


def test_outlines_and_index(spark, tmp_path):
    square = [[[1.48, 43.48], [1.58, 43.48], [1.58, 43.58], [1.48, 43.58], [1.48, 43.48]]]
    features = [{"type": "Feature", "properties": {"code_insee": c, "nom_officiel": "N"}, "geometry": {"type": "Polygon", "coordinates": square}} for c in ("31", "974")]
    (tmp_path / "o.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    assert [r.code for r in sources.outlines(spark, f"file://{tmp_path}/o.json").collect()] == ["31"]
    (tmp_path / "i.json").write_text(json.dumps({"flat-0123456789ab": [1.5, 43.5], "flat-0123456789ac": [1.5, 43.5, "flat-0123456789ab"], "bad": [1, 2]}))
    rows = {r.id: (r.live, r.target) for r in sources.read_index(spark, f"file://{tmp_path}/i.json").collect()}
    assert rows == {"flat-0123456789ab": (True, None), "flat-0123456789ac": (False, "flat-0123456789ab")}


def test_raster(spark, tmp_path):
    (tmp_path / "t.bin").write_bytes(struct.pack("<6f", 1, 2, 3, -9999, 5, 6))
    rows = {(r.row, r.col): r.z for r in sources.raster_cells(spark, f"file://{tmp_path}/t.bin", 3).collect()}
    assert rows == {(0, 0): 1, (0, 1): 2, (0, 2): 3, (1, 0): None, (1, 1): 5, (1, 2): 6}
    assert sources.analytic_cells(spark, 2, 2, "2 * col + row").agg(F.sum("z")).first()[0] == 6


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("flat-0123456789ab", 1.5, 43.5), ("flat-ff23456789ab", 1.6, 43.6)], "id string, lon double, lat double")
    sinks.write_id_index(df, f"file://{tmp_path}/index", 2)
    assert sorted(p.name for p in (tmp_path / "index").iterdir() if p.is_dir()) == ["index_key=01", "index_key=ff"]
    sinks.tiles_table(df, f"file://{tmp_path}/tiles", 12)
    assert spark.read.parquet(f"file://{tmp_path}/tiles").where("z = 12").count() == 2
    line = spark.createDataFrame([([(0.0, 1.0), (2.0, 3.0)],)], "line array<struct<x: double, y: double>>")
    assert bytes(line.select(sinks.wkb_line("line")).first()[0]) == struct.pack("<BII4d", 1, 2, 2, 0, 1, 2, 3)
    point = df.select(sinks.geojson_feature("Point", F.array("lon", "lat"), F.struct(F.lit(None).cast("string").alias("a"), F.lit(1).alias("b"))).alias("feature"))
    sinks.write_geojson_lines(point, f"file://{tmp_path}/geo")
    assert json.loads(spark.read.text(f"file://{tmp_path}/geo").orderBy("value").first()[0])["properties"] == {"b": 1}


def test_sessions_stream_is_the_batch(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{m:02d}:00", "click", 1.0) for m in (0, 5, 50)] + [(2, "2024-01-01 05:00:00", "view", 2.0), (9, "2024-01-02 00:00:00", "view", 0.0)]
    df = spark.createDataFrame(rows, "user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    batch = sorted(map(tuple, sessions.sessions(df).collect()))
    stream = sessions.sessions(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("sessions").collect()))
    assert got == [r for r in batch if r[0] != 9]
    assert sessions.tumbling(df).count() == 3
