"""Steps whose cost must not outgrow the input: the same results by steps of bounded width."""

from pyspark.sql import functions as F

from quillmere.operators import evaluation, polygons, scoring, shapes


def test_ranking_by_ranges_equals_ranking(spark):
    rows = spark.range(3000).select((F.col("id") % 3).cast("int").alias("g"), (F.col("id") * 37 % 1009 - 500).alias("s"), (F.col("id") % 7 < 2).cast("int").alias("label"))
    rows = rows.union(spark.sql("select 9, 5L, 1")).union(spark.sql("select 8, -5L, 0"))  # groups of one label only
    want = sorted(evaluation.ranking(rows, ["g"], "s", "label").collect())
    for width in (1, 40, 100_000):
        got = evaluation.ranking_by_ranges(rows, "g", "s", "label", F.floor(F.col("s") / width))
        assert sorted(got.collect()) == want


def test_null_distribution_makes_no_cell_for_each_random_score(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 50).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    out = scoring.null_distribution(rows, "id", "p", "label", 4)
    assert out.count() == 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "random_score" in line.split("], [")[0]]
    assert plan.count("Generate explode") <= 2  # the replicates are made for their sums and for their ranks, once each


def test_cutting_and_crossing_run_no_function_of_arrays_for_each_side(spark):
    edges = spark.createDataFrame([(1, 0.0, 0.0, 25.0, 5.0), (2, 3.0, 3.0, 3.0, 3.5), (3, None, 1.0, 2.0, 2.0), (4, -30.0, 8.0, -30.0, -8.0)], "id int, x1 double, y1 double, x2 double, y2 double")
    rows = polygons.cut_at_cells(edges, 10.0).collect()
    for r in rows:
        if r["id"] != 3:
            middle = (r["t0"] + r["t1"]) / 2
            for low, high, cell in ((r["x1"], r["x2"], r["cx"]), (r["y1"], r["y2"], r["cy"])):
                assert cell <= (low + middle * (high - low)) / 10 - polygons.OFFSET < cell + 1
    lengths = {i: sum(r["t1"] - r["t0"] for r in rows if r["id"] == i) for i in (1, 2, 3, 4)}
    assert all(abs(v - 1) < 1e-12 for v in lengths.values())
    assert [r["cx"] for r in rows if r["id"] == 3] == [None]
    assert sum(r["id"] == 1 for r in rows) == 5  # three borders of x, one of y
    shapes_ = spark.sql("select 1 as id, array(array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 4D), named_struct('x', 4D, 'y', 0D), named_struct('x', 0D, 'y', 4D)))) as parts")
    found = shapes.crossing_rings(shapes_, "id")
    assert [r["id"] for r in found.collect()] == [1]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan and "array_sort" not in plan


def test_spans_run_no_function_of_arrays_for_each_piece(spark):
    box = "array(array(array(named_struct('x', {x}, 'y', 0D), named_struct('x', {x} + 9D, 'y', 0D), named_struct('x', {x} + 9D, 'y', 9D), named_struct('x', {x}, 'y', 9D))))"
    table = spark.sql(f"select 1 as id, {box.format(x='0D')} as parts union all select 2, {box.format(x='6D')} union all select 3, {box.format(x='6D')}")
    areas = polygons.overlap_areas(table, "id", 2.0)
    assert {(r["a"], r["b"]): round(r["area"], 9) for r in areas.collect()} == {(1, 2): 27.0, (1, 3): 27.0, (2, 3): 81.0}
    edges = spark.sql("select 7 as line, -1D as x1, 0D as y1, 30D as x2, 0D as y2")  # along the borders, then beyond
    assert {(r["line"], r["id"]): round(r["overlap"], 9) for r in polygons.overlaps(edges, table, "line", "id", 2.0).collect()} == {(7, 1): 9.0, (7, 2): 9.0, (7, 3): 9.0}
    assert "aggregate(" not in polygons.spans(edges, polygons.polygon_cells(table, "id", 2.0), 2.0)._jdf.queryExecution().optimizedPlan().toString()
