"""Writers, each with the check that what was written is what was meant; and scans of what they wrote."""

from __future__ import annotations

import struct
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StringType, StructField, StructType

from quillmere.operators.tables import fingerprint
from quillmere.sources.files import read_csv

LINE = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); where that is unset, on a local master only, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def round_trip(df: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Writes df and reads it again: one row of rows_in, rows_out, same_columns and same_content (by an order-free fingerprint)."""
    df.write.parquet(path)
    back = df.sparkSession.read.parquet(path)
    a, b = (fingerprint(d, [], columns).select(F.struct("*").alias(n)) for d, n in ((df, "a"), (back, "b")))
    same = [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in back.schema]
    return a.crossJoin(b).select(F.col("a.n_rows").alias("rows_in"), F.col("b.n_rows").alias("rows_out"), F.lit(same).alias("same_columns"), (F.col("a") == F.col("b")).alias("same_content"))


def write_partitions(df: DataFrame, path: str, by: list[str], order: list[str]) -> None:
    """df in a folder for each value of `by`, sorted, in place of those folders and no others. Spark commits them at the end of the job: a failed one changes nothing."""
    df.repartition(*by).sortWithinPartitions(*by, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def invalid_partitions(spark: SparkSession, path: str, manifest: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The partitions (by) whose fingerprint is not that of the manifest (by, n_rows, total, parity), or which are not there at all."""
    found = fingerprint(spark.read.parquet(path), by, columns)
    same = [*by, "n_rows", "total", "parity"]
    types = {f.name: f.dataType for f in manifest.schema}
    return manifest.select(*same).join(found.select(*[F.col(c).cast(types[c]).alias(c) for c in same]), same, "left_anti").select(*by)


def resume(df: DataFrame, path: str, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Writes anew the partitions at `path` that differ from df, and returns (by) which they were."""
    bad = invalid_partitions(df.sparkSession, path, fingerprint(df, by, columns), by, columns).collect()  # partitions, not rows
    again = df.sparkSession.createDataFrame(bad, df.select(*by).schema)
    if bad:
        write_partitions(df.join(F.broadcast(again), by, "left_semi"), path, by, order)
    return again


def write_features(df: DataFrame, path: str, key: str, line: str, properties: list[str]) -> None:
    """A GeoJSON feature a line, sorted by key over all files; one point is a Point, more are a LineString."""
    at = F.transform(line, lambda p: F.array(p["x"], p["y"]))
    kind = F.when(F.size(line) == 1, "Point").otherwise("LineString")
    where = F.when(F.size(line) == 1, F.to_json(at[0])).otherwise(F.to_json(at))
    props = F.to_json(F.struct(*properties))
    text = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), where, F.lit('},"properties":'), props, F.lit("}"))
    df.orderBy(key).select(text.alias("value")).write.text(path)


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """What write_features wrote: the properties (a DDL schema), geometry_type and line."""
    schema = f"properties struct<{properties}>, geometry struct<type: string, coordinates: string>"
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("f"))
    xy = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    at = F.col("f.geometry.coordinates")
    line = F.when(F.col("f.geometry.type") == "Point", F.array(xy(F.from_json(at, "array<double>")))).otherwise(F.transform(F.from_json(at, "array<array<double>>"), xy))
    return rows.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), line.alias("line"))


def write_geometries(df: DataFrame, path: str, crs: str) -> None:
    """A table with a nested geometry column, and the name of its coordinate system in each row (one value, which Parquet stores once)."""
    df.withColumn("working_crs", F.lit(crs)).write.parquet(path)


def station_days(spark: SparkSession, path: str, names: dict[str, str], numbers: list[str], label: str) -> DataFrame:
    """The yearly CSV files of a station under `path` with canonical names, by each file's own header: numbers as doubles (what is none becomes null), absent columns null, `station` the label."""
    rows = read_csv(spark, path, StructType([StructField(a, StringType()) for a in names]))
    return rows.select(F.lit(label).alias("station"), *[(F.col(f"`{a}`").try_cast("double") if b in numbers else F.col(f"`{a}`")).alias(b) for a, b in names.items()])


def anchor_partition(spark: SparkSession, path: str, columns: list[str], **values: int) -> DataFrame:
    """Some columns of the partitions with these values; no other folder is read."""
    rows = spark.read.parquet(path)
    for c, v in values.items():
        rows = rows.filter(F.col(c) == v)
    return rows.select(*columns)


def wkb_of(blob: Column) -> Column:
    """The WKB in a packed geometry blob, whose header has 8 bytes and an envelope of the size that bits 1 to 3 of the fourth byte say; null where it is none."""
    envelope = F.conv(F.hex(F.substring(blob, 4, 1)), 16, 10).cast("int").bitwiseAND(F.lit(14))
    size = F.when(envelope == 0, 8).when(envelope == 2, 40).when(envelope.isin(4, 6), 56).when(envelope == 8, 72)
    body = F.substring(blob, size + 1, F.octet_length(blob))
    return F.when((F.substring(blob, 1, 2) == F.lit(b"GP")) & size.isNotNull(), body)


def _line(data: bytes | None) -> list[dict] | None:
    if data is None or len(data) < 5:
        return None
    end = "<" if data[0] == 1 else ">"
    kind = struct.unpack_from(end + "I", data, 1)[0]
    if kind == 1:
        return [dict(zip("xy", struct.unpack_from(end + "2d", data, 5), strict=True))]
    if kind != 2:
        return None
    n = struct.unpack_from(end + "I", data, 5)[0]
    flat = struct.unpack_from(f"{end}{2 * n}d", data, 9)
    return [{"x": x, "y": y} for x, y in zip(flat[::2], flat[1::2], strict=True)]


@pandas_udf(LINE)
def decoded(wkb: pd.Series) -> pd.Series:
    """The points of WKB points and lines, in Arrow batches; other kinds are null."""
    return wkb.map(_line)


def packed(lines: pd.Series) -> pd.Series:
    def one(line: list) -> bytes:
        xy = [v for p in line for v in (p["x"], p["y"])]
        body = struct.pack("<BI2d", 1, 1, *xy) if len(line) == 1 else struct.pack(f"<BII{len(xy)}d", 1, 2, len(line), *xy)
        return b"GP\x00\x01" + struct.pack("<i", 0) + body

    return lines.map(one)


encoded = pandas_udf(packed, BinaryType())
