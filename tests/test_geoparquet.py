"""Geometries of all kinds through GeoJSON, WKB and GeoParquet."""

import glob
import json
import struct

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillmere.sources import geoparquet as g

POINT, LINE, RING, HOLE = [1.5, 2.0], [[0, 0], [3, 4]], [[0, 0], [9, 0], [9, 9], [0, 0]], [[5, 1], [6, 1], [6, 2], [5, 1]]
SHAPES = {"Point": POINT, "LineString": LINE, "Polygon": [RING, HOLE], "MultiPoint": [POINT, [7, 8]], "MultiLineString": [LINE, [[9, 9], [8, 8], [7, 9]]], "MultiPolygon": [[RING, HOLE], [HOLE]]}
xy = lambda points: [{"x": float(p[0]), "y": float(p[1])} for p in points]
PARTS = {"Point": [[xy([POINT])]], "LineString": [[xy(LINE)]], "Polygon": [[xy(RING), xy(HOLE)]], "MultiPoint": [[xy([POINT])], [xy([[7, 8]])]], "MultiLineString": [[xy(LINE)], [xy([[9, 9], [8, 8], [7, 9]])]], "MultiPolygon": [[xy(RING), xy(HOLE)], [xy(HOLE)]]}


def table(spark):
    told = [{"properties": {"id": k}, "geometry": {"type": k, "coordinates": c}} for k, c in SHAPES.items()]
    told += [{"properties": {"id": "none"}, "geometry": None}, {"properties": {"id": "other"}, "geometry": {"type": "GeometryCollection", "geometries": []}}, {"properties": {"id": "empty"}, "geometry": {"type": "Polygon", "coordinates": []}}, {"properties": {"id": "high"}, "geometry": {"type": "LineString", "coordinates": [[1, 2, 99], [3, 4, 99]]}}]
    texts = spark.createDataFrame([(json.dumps({"features": told}),), ("no json",), (None,)], "text string")
    return g.geometries(texts, "text", "id string")


def told(df):
    return {r["id"]: (r["kind"], [[[p.asDict() for p in line] for line in part] for part in r["parts"]] if r["parts"] is not None else None) for r in df.select("id", "kind", "parts").collect()}


WANT = {k: (k, v) for k, v in PARTS.items()} | {"none": (None, None), "other": ("GeometryCollection", None), "empty": ("Polygon", [[]]), "high": ("LineString", [[xy([[1, 2], [3, 4]])]])}


def test_all_kinds_are_read(spark):
    assert told(table(spark)) == WANT


def test_wkb_is_the_standard_s(spark):
    rows = {r["id"]: r["w"] for r in table(spark).select("id", g.wkb("kind", "parts").alias("w")).collect()}
    assert rows["Point"] == struct.pack("<BI2d", 1, 1, 1.5, 2.0) and rows["none"] is rows["other"] is None
    ring = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r)
    polygon = struct.pack("<BII", 1, 3, 2) + ring(RING) + ring(HOLE)
    assert rows["Polygon"] == polygon and rows["MultiPolygon"] == struct.pack("<BII", 1, 6, 2) + polygon + struct.pack("<BII", 1, 3, 1) + ring(HOLE)
    big = struct.pack(">BII4d", 0, 2, 2, 0, 0, 3, 4)
    out = spark.createDataFrame([(1, big), (2, big[:-3]), (3, b""), (4, None), (5, b"\x01\x63\x00\x00\x00\x01\x00\x00\x00")], "k int, w binary").select("k", g.read_wkb("w").alias("g")).select("k", "g.*")
    got = {r["k"]: (r["kind"], r["parts"]) for r in out.collect()}
    assert got[1][0] == "LineString" and [p.asDict() for p in got[1][1][0][0]] == xy(LINE) and all(got[k] == (None, None) for k in (2, 3, 4, 5))


def test_geoparquet_round_trip_and_metadata(spark, tmp_path):
    path = f"file://{tmp_path}/geo"
    manifest = g.write_geoparquet(table(spark).withColumn("a.b", F.lit(1)).repartition(2), path, {"type": "GeographicCRS", "name": "x"})
    assert manifest.agg(F.sum("n_rows")).first()[0] == len(WANT)
    back = g.read_geoparquet(spark, path)
    assert told(back) == WANT | {"other": (None, None)} and "a.b" in back.columns
    found, boxes = set(), []
    for file in glob.glob(f"{tmp_path}/geo/*.parquet"):
        geo = json.loads(pq.read_metadata(file).metadata[b"geo"])
        column = geo["columns"][geo["primary_column"]]
        assert (geo["version"], column["encoding"], column["crs"]["name"]) == ("1.1.0", "WKB", "x")
        found |= set(column["geometry_types"])
        boxes += [column["bbox"]] if "bbox" in column else []
    assert found == set(SHAPES) and [f(c) for f, c in zip((min, min, max, max), zip(*boxes, strict=True), strict=True)] == [0, 0, 9, 9]
    assert g.write_geoparquet(table(spark).limit(0), f"file://{tmp_path}/none").count() == 0
