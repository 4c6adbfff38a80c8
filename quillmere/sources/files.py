"""Readers of delivered files: CSV of unsure encoding, GeoJSON, and one file for each year."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Spark reads ISO-8859-1 but not windows-1252, which differs from it in the bytes 80 to 9F alone.
PLACES = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
LATIN, WINDOWS = "".join(k for k, v in PLACES.items() if v), "".join(PLACES.values())


def headers(spark: SparkSession, path: str) -> list[tuple[list[str], list[str], bool]]:
    """(columns, files, utf8) for each header among the CSV files at `path`, and for each of both encodings: files whose columns stand in one order can be read together.

    One pass over all lines, with a row for each file to the driver. Empty files are left out.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    first = F.min_by(F.when(F.col("block") == 0, F.col("value")), F.when(F.col("block") == 0, F.col("at")))
    files = lines.groupBy("file").agg(F.decode(first.cast("binary"), "ISO-8859-1").alias("header"), F.every(F.is_valid_utf8("value")).alias("utf8")).collect()
    groups: dict[tuple[str, bool], list[str]] = {}
    for r in sorted(files, key=lambda r: r["file"]):
        if r["header"] is not None:
            groups.setdefault((r["header"], r["utf8"]), []).append(unquote(r["file"]))
    named = lambda header, utf8: next(csv.reader([header.encode("latin-1").decode("utf-8-sig" if utf8 else "cp1252")]))
    return [(named(header, utf8), paths, utf8) for (header, utf8), paths in groups.items()]


def read_csv(spark: SparkSession, path: str, schema: StructType | str, **options: str) -> DataFrame:
    """CSV files with headers, as the columns of `schema`: by name, so that files may have them in any order, lack some (null) or have others (left out).

    Each file is read as UTF-8 (a byte-order mark is dropped) or, where it holds what UTF-8 can't be, as windows-1252. No file at all gives an empty table.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parts = [spark.createDataFrame([], wanted)]
    for columns, paths, utf8 in headers(spark, path):
        kinds = {f.name: f.dataType for f in wanted}
        held = StructType([StructField(f"_{i}", kinds.get(c, StringType())) for i, c in enumerate(columns)])
        rows = spark.read.option("header", True).option("enforceSchema", True).options(**options).option("encoding", "UTF-8" if utf8 else "ISO-8859-1").csv(paths, schema=held)
        text = lambda i, kind, utf8=utf8: F.col(f"_{i}") if utf8 or kind != StringType() else F.translate(f"_{i}", LATIN, WINDOWS)
        parts.append(rows.select(*[(text(columns.index(f.name), f.dataType) if f.name in columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted]))
    return reduce(DataFrame.unionByName, parts)


def placed(rows: DataFrame) -> DataFrame:
    """The rows of files with `place`: a number in the order of the files' names and, within a file, of its rows. The names come to the driver.

    Names and row numbers themselves are longer, and sums by key can't be kept in a hash table with them.
    """
    names = sorted(r["file"] for r in rows.select(F.col("_metadata.file_path").alias("file")).distinct().collect())
    numbers = rows.sparkSession.createDataFrame([(name, i << 40) for i, name in enumerate(names)], "_file string, _before long")
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return rows.join(F.broadcast(numbers), "_file").withColumn("place", F.col("_before") + F.col("_at")).drop("_file", "_before", "_at")


def features(texts: DataFrame, column: str, properties: str) -> DataFrame:
    """One row for each feature of the GeoJSON texts in `column`: the properties (a DDL schema), geometry_type and line (array of x, y).

    Points and lines are read; other geometries have a null line. A text that can't be parsed has no rows.
    """
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    rows = texts.select(F.explode(F.from_json(F.col(column), schema)["features"]).alias("f"))
    xy = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    at = F.col("f.geometry.coordinates")
    point = F.array(xy(F.from_json(at, "array<double>")))
    line = F.transform(F.from_json(at, "array<array<double>>"), xy)
    kind = F.col("f.geometry.type")
    return rows.select("f.properties.*", kind.alias("geometry_type"), F.when(kind == "Point", point).when(kind == "LineString", line).alias("line"))


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    return features(spark.read.text(path, wholetext=True), "value", properties)


def yearly_files(spark: SparkSession, pattern: str, years: range) -> DataFrame:
    """The Parquet files that `pattern` (with {year}) names, as one table in the order of years, with source_year and source_file; years without a file are left out."""
    jvm = spark.sparkContext._jvm
    there = [y for y in years if (p := jvm.org.apache.hadoop.fs.Path(pattern.format(year=y))).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)]
    return yearly({y: (d := spark.read.parquet(pattern.format(year=y))).select("*", d["_metadata.file_name"].alias("source_file")) for y in there})


def yearly(parts: dict[int, DataFrame]) -> DataFrame:
    """The tables of all years as one, with `source_year`; columns that a year lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [parts[y].withColumn("source_year", F.lit(y)) for y in sorted(parts)])
