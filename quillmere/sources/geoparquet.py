"""Geometries of all kinds: from GeoJSON, as WKB, and in GeoParquet files.

A geometry is `kind` and `parts`: an array of parts, each an array of rings or lines, each an array of (x, y). A point or a line is one part of one
array; the points or lines of a multiple geometry are a part each; a polygon's part has its rings.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StringType, StructField, StructType

# The codes of well-known binary.
CODES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}
POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
GEOMETRY = StructType([StructField("kind", StringType()), StructField("parts", ArrayType(ArrayType(ArrayType(POINT))))])


def geometries(texts: DataFrame, column: str, properties: str) -> DataFrame:
    """One row for each feature of the GeoJSON texts in `column`: the properties (a DDL schema), kind and parts.

    A feature without geometry has null in both, one of a kind that is not in CODES null parts. Further coordinates (heights) are left out. A text that can't be parsed has no rows.
    """
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    rows = texts.select(F.explode(F.from_json(F.col(column), schema)["features"]).alias("f"))
    at, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    xy = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    line = lambda points: F.transform(points, xy)
    read = lambda depth: F.from_json(at, "array<" * depth + "double" + ">" * depth)
    parts = (
        F.when(kind == "Point", F.array(F.array(line(F.filter(F.array(read(1)), lambda p: F.size(p) > 1)))))
        .when(kind == "LineString", F.array(F.array(line(read(2)))))
        .when(kind == "Polygon", F.array(F.transform(read(3), line)))
        .when(kind == "MultiPoint", F.transform(read(2), lambda p: F.array(F.array(xy(p)))))
        .when(kind == "MultiLineString", F.transform(read(3), lambda x: F.array(line(x))))
        .when(kind == "MultiPolygon", F.transform(read(4), lambda p: F.transform(p, line)))
    )
    return rows.select("f.properties.*", kind.alias("kind"), parts.alias("parts"))


def _points(points: list) -> bytes:
    return np.array([(p["x"], p["y"]) for p in points], "<f8").tobytes()


def _head(code: int, *n: int) -> bytes:
    return struct.pack(f"<BI{len(n)}I", 1, code, *n)


def _written(kind: str | None, parts) -> bytes | None:
    if kind not in CODES or parts is None:
        return None
    code = CODES[kind]
    if code == 1:
        points = [p for part in parts for line in part for p in line]
        return _head(1) + (_points(points[:1]) if points else np.full(2, np.nan).tobytes())
    if code == 2:
        points = [p for part in parts for line in part for p in line]
        return _head(2, len(points)) + _points(points)
    polygon = lambda part: _head(3, len(part)) + b"".join(struct.pack("<I", len(r)) + _points(r) for r in part)
    if code == 3:
        return polygon(parts[0] if len(parts) else [])
    one = {4: lambda part: _head(1) + _points(part[0][:1]), 5: lambda part: _head(2, len(part[0])) + _points(part[0]), 6: polygon}[code]
    return _head(code, len(parts)) + b"".join(map(one, parts))


@arrow_udf(BinaryType())
def wkb(kind: pa.Array, parts: pa.Array) -> pa.Array:
    """Well-known binary, little endian, in Arrow batches; null for a null geometry or another kind."""
    return pa.array(map(_written, kind.to_pylist(), parts.to_pylist()), pa.binary())


def _read(data: bytes) -> tuple[str, list] | None:
    names = {v: k for k, v in CODES.items()}

    def one(at: int) -> tuple[int, list, int]:
        end = "<" if data[at] == 1 else ">"
        code = struct.unpack_from(end + "I", data, at + 1)[0]
        at += 5

        def line(at: int, n: int) -> tuple[list, int]:
            flat = np.frombuffer(data, end + "f8", 2 * n, at).tolist()
            return [{"x": x, "y": y} for x, y in zip(flat[::2], flat[1::2], strict=True)], at + 16 * n

        def count(at: int) -> int:
            return struct.unpack_from(end + "I", data, at)[0]

        if code == 1:
            points, at = line(at, 1)
            return code, [[[p for p in points if p["x"] == p["x"]]]], at
        n, at = count(at), at + 4
        if code == 2:
            points, at = line(at, n)
            return code, [[points]], at
        if code == 3:
            rings = []
            for _ in range(n):
                ring, at = line(at + 4, count(at))
                rings.append(ring)
            return code, [rings], at
        if code not in names:
            raise ValueError(code)
        parts = []
        for _ in range(n):
            _, part, at = one(at)
            parts += part
        return code, parts, at

    try:
        code, parts, _ = one(0)
        return names[code], parts
    except (ValueError, KeyError, IndexError, struct.error):
        return None


@arrow_udf(GEOMETRY)
def read_wkb(data: pa.Array) -> pa.Array:
    """kind and parts of well-known binary, of either byte order; null where it is none, or cut short."""
    found = [_read(d) if d is not None else None for d in data.to_pylist()]
    lines = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    return pa.array([{"kind": f and f[0], "parts": f and f[1]} for f in found], pa.struct([("kind", pa.string()), ("parts", lines)]))


def _file_writer(path: str, names: list[str], crs: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pfs
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        store, base = pfs.FileSystem.from_uri(path)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.parquet"
        draft, writer, n, kinds, box = f"{base}/.{name}.{context.taskAttemptId()}", None, 0, set(), []
        for batch in batches:
            table = pa.Table.from_batches([batch]).drop_columns(["_kind", "_box"]).rename_columns(names)
            if writer is None:
                store.create_dir(base, recursive=True)
                writer = pq.ParquetWriter(draft, table.schema, filesystem=store, compression="zstd")
            writer.write_table(table)
            n += len(table)
            kinds |= set(batch.column("_kind").to_pylist()) - {None}
            box += [b for b in batch.column("_box").to_pylist() if b is not None and None not in b]
            box = [[f(c) for f, c in zip((min, min, max, max), zip(*box, strict=True), strict=True)]] if box else []
        if writer is not None:
            told = {"encoding": "WKB", "geometry_types": sorted(kinds), "crs": crs} | ({"bbox": box[0]} if box else {})
            writer.add_key_value_metadata({"geo": json.dumps({"version": "1.1.0", "primary_column": names[-1], "columns": {names[-1]: told}})})
            writer.close()
            store.move(draft, f"{base}/{name}")  # a task that runs again puts the same file in its place
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "n_rows"])

    return run


def write_geoparquet(df: DataFrame, path: str, crs: dict | None = None, column: str = "geometry") -> DataFrame:
    """Writes df (kind, parts and others) as GeoParquet 1.1 below `path`, a folder that all executors see, and returns the manifest (file, n_rows).

    The geometry becomes the WKB column `column`; each file's `geo` metadata has its kinds, bounds and the coordinate system (PROJJSON; null where it is unknown). Files appear whole, by a rename. An empty table writes none.
    """
    points = F.flatten(F.flatten("parts"))
    bound = lambda f, c: f(F.transform(points, lambda p: p[c]))
    box = F.when(F.size(points) > 0, F.array(bound(F.array_min, "x"), bound(F.array_min, "y"), bound(F.array_max, "x"), bound(F.array_max, "y")))
    names = [c for c in df.columns if c not in ("kind", "parts")]
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], wkb("kind", "parts").alias("geometry"), F.when(F.col("parts").isNotNull(), F.col("kind")).alias("_kind"), box.alias("_box"))
    found = rows.mapInArrow(_file_writer(path, [*names, column], crs), "file string, n_rows long").collect()  # one row for each file
    return df.sparkSession.createDataFrame(found, "file string, n_rows long")


def read_geoparquet(spark: SparkSession, path: str, column: str = "geometry") -> DataFrame:
    """What write_geoparquet wrote, or any Parquet with a WKB column: its other columns, kind and parts."""
    rows = spark.read.parquet(path)
    return rows.withColumn("_g", read_wkb(F.col(f"`{column}`"))).select(*[F.col(f"`{c}`") for c in rows.columns if c != column], "_g.kind", "_g.parts")
