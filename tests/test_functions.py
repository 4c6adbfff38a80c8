import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillmere.functions import dates, geometry, text
from quillmere.operators import ordering, spatial, survival, tables
from quillmere.sources import files


def test_csv_of_either_encoding(spark, tmp_path):
    for name, encoding in (("a.csv", "utf-8-sig"), ("b.csv", "cp1252")):
        (tmp_path / name).write_bytes("nom,n\nÉté,1\nœuvre,2\n".encode(encoding))
        rows = files.read_csv(spark, f"file://{tmp_path}/{name}", "nom string, n int").collect()
        assert [tuple(r) for r in rows] == [("Été", 1), ("œuvre", 2)]


def test_geojson_points_and_lines(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"features": [{"properties": {"id": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"properties": {"id": 2}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}}, {"properties": {"id": 3}, "geometry": null}]}')
    rows = files.read_geojson(spark, f"file://{tmp_path}/g.json", "id: int").select("id", F.size("line").alias("n"), geometry.length(F.col("line")).alias("length")).orderBy("id").collect()
    assert [(r["id"], r["n"], r["length"]) for r in rows] == [(1, 1, 0.0), (2, 2, 5.0), (3, None, None)]


def test_identifiers_and_categories(spark):
    rows = spark.createDataFrame([("1010191.0",), (" 12 ",), ("1.5",), ("x",), ("",), (None,)], "raw string")
    assert [r[0] for r in rows.select(text.whole_number_id(F.col("raw"))).collect()] == ["1010191", "12", None, None, None, None]
    assert spark.createDataFrame([("  Île  des Sœurs",)], "c string").select(text.cleaned(F.col("c"))).first()[0] == "ile des sœurs"
    assert text.plain_names(spark.range(1).toDF(" Année  de pose")).columns == ["Annee_de_pose"]


def test_local_times_at_the_change_of_clocks(spark):
    rows = spark.createDataFrame([("2023-03-12 02:30:00",), ("2023-11-05 01:30:00",), ("2023-07-01 12:00:00",), (None,)], "raw string").select(F.col("raw").cast("timestamp_ntz").alias("at"))
    out = rows.select(dates.localised(F.col("at"), "America/Toronto").alias("l")).select("l.*").collect()
    assert [r["status"] for r in out] == ["nonexistent_dst", "ambiguous_dst", "successfully_localized", "missing"] and out[2]["utc"].hour == 16


def test_prefix_sums_and_row_numbers_equal_a_plain_loop(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("ab") if i % 9 else None, float(rng.randrange(40)), rng.randrange(5)) for i in range(500)]
    rows = spark.createDataFrame(data, "id long, g string, s double, n long")
    out = ordering.prefix_sum(rows, ["g"], "s", ["n"], ranges=7).collect()
    assert len(out) == 500 and all(r["n_to"] == sum(n for _, g, s, n in data if g == r["g"] and s >= r["s"]) for r in out)
    assert sorted(r["place"] for r in ordering.row_numbers(rows, "id", 3, ranges=16).collect()) == list(range(500))
    assert ordering.prefix_sum(rows.limit(0), ["g"], "s", ["n"]).count() == 0
    sample = ordering.stratified(rows, "g", "id", 30, 1, ranges=8).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in sample} == {"a": 30, "b": 30}


def test_concordance_equals_all_pairs(spark):
    rng = random.Random(4)
    data = [(rng.randrange(1, 30), rng.randrange(2), rng.randrange(6)) for _ in range(120)]
    n = good = tied = 0
    for (d1, e1, s1), (d2, e2, s2) in itertools.permutations(data, 2):
        if e1 and (d1 < d2 or (d1 == d2 and not e2)):
            n, good, tied = n + 1, good + (s1 > s2), tied + (s1 == s2)
    r = survival.concordance(spark.createDataFrame(data, "d int, e int, s int"), "d", "e", "s", bits=8).first()
    assert (r["pairs"], r["concordant"], r["tied"]) == (n, good, tied)


def test_pieces_keep_the_length_and_overlap_of_a_line(spark):
    edges = spark.createDataFrame([(1, 0.0, 5.0, 100.0, 5.0), (2, 5.0, 0.0, 5.0, 0.0)], "line int, x1 double, y1 double, x2 double, y2 double")
    square = spark.createDataFrame([(9, [(10.0, 0.0), (40.0, 0.0), (40.0, 10.0), (10.0, 10.0)])], "polygon int, corners array<struct<x: double, y: double>>")
    cut = spatial.pieces(edges, 7.0)
    assert cut.filter("line = 1").count() == 15
    for e in (edges, cut):
        got = spatial.overlaps(e, square, "line", "polygon", 10.0).collect()
        assert [(r["line"], round(r["overlap"], 9)) for r in got] == [(1, 30.0)]


def test_guards(spark):
    df = spark.createDataFrame([(1, None, None)], "a int, target_90d int, c string")
    with pytest.raises(ValueError):
        tables.without_forbidden(df)
    with pytest.raises(ValueError):
        tables.exactly(df, ["a"])
    assert tables.without_forbidden(df, allowed=("target_90d",)) is df
    assert tuple(tables.filled(df, ["target_90d"], ["c"]).first()) == (1, -1, "missing")
