"""Polygons of any shape, linkage, geometry quality and simplification, against brute force and closed forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.operators import linkage, polygons, shapes

POLYGONS = "polygon int, parts array<array<array<struct<x: double, y: double>>>>"
EDGES = "line int, x1 double, y1 double, x2 double, y2 double"


def ring(*corners):
    return [{"x": float(x), "y": float(y)} for x, y in corners]


def crossings(edge, parts):
    (x, y), (dx, dy) = edge[:2], (edge[2] - edge[0], edge[3] - edge[1])
    out = []
    for r in (r for p in parts for r in p):
        for a, b in zip(r, r[1:] + r[:1], strict=True):
            ex, ey = b["x"] - a["x"], b["y"] - a["y"]
            turn = dx * ey - dy * ex
            if turn:
                t, u = ((a["x"] - x) * ey - (a["y"] - y) * ex) / turn, ((a["x"] - x) * dy - (a["y"] - y) * dx) / turn
                out += [t] if 0 <= u <= 1 and 0 < t < 1 else []
    return sorted([0.0, *out, 1.0])


def inside(x, y, parts):
    hit = False
    for r in (r for p in parts for r in p):
        for a, b in zip(r, r[1:] + r[:1], strict=True):
            if (a["y"] > y) != (b["y"] > y) and x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]):
                hit = not hit
    return hit


def star(rng, x, y, low, high, n):
    return ring(*[(x + r * math.cos(t), y + r * math.sin(t)) for t, r in ((2 * math.pi * i / n, rng.uniform(low, high)) for i in range(n))])


@pytest.mark.parametrize("size", [3.0, 40.0])
def test_overlaps_equal_brute_force(spark, size):
    rng = random.Random(2)
    shapes_ = [(i, [[star(rng, x, y, 8, 20, 17), star(rng, x, y, 2, 6, 9)], [star(rng, x + 60, y, 2, 9, 5)]]) for i, (x, y) in enumerate((rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(6))]
    edges = [(i // 2, *(rng.uniform(-20, 120) for _ in range(4))) for i in range(30)] + [(99, 5.0, 5.0, 5.0, 5.0), (98, None, 1.0, 2.0, 3.0)]
    want = {}
    for line, *e in edges[:30]:
        for polygon, parts in shapes_:
            cuts = crossings(e, parts)
            step = sum(b - a for a, b in zip(cuts, cuts[1:], strict=False) if inside(e[0] + (a + b) / 2 * (e[2] - e[0]), e[1] + (a + b) / 2 * (e[3] - e[1]), parts))
            if step > 1e-9:
                want[line, polygon] = want.get((line, polygon), 0) + step * math.hypot(e[2] - e[0], e[3] - e[1])
    table = spark.createDataFrame(shapes_, POLYGONS)
    out = {(r[0], r[1]): r[2] for r in polygons.overlaps(spark.createDataFrame(edges, EDGES), table, "line", "polygon", size, 1e-9).collect()}
    assert out.keys() == want.keys() and all(out[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert polygons.overlaps(spark.createDataFrame([], EDGES), table, "line", "polygon", size).count() == 0


def test_borders_holes_and_shared_sides(spark):
    angle = [[ring((0, 0), (20, 0), (20, 10), (10, 10), (10, 20), (0, 20)), ring((2, 2), (6, 2), (6, 6), (2, 6), (2, 2))]]
    table = spark.createDataFrame([(1, angle), (2, [[ring((15, 5), (15, 15), (25, 15), (25, 5))]]), (3, [[ring((20, 0), (40, 0), (40, 10), (20, 10))]]), (4, [[ring((0, 0), (10, 0), (10, 10), (0, 10))]]), (5, []), (6, None)], POLYGONS)
    edges = spark.createDataFrame([(1, -5.0, 5.0, 30.0, 5.0), (2, 0.0, 20.0, 0.0, 0.0), (3, 4.0, 4.0, 4.0, 5.0), (4, 20.0, 0.0, 20.0, 30.0)], EDGES)
    out = {(r[0], r[1]): round(r[2], 6) for r in polygons.overlaps(edges, table, "line", "polygon", 7.0).collect()}
    assert out == {(1, 1): 16, (1, 2): 10, (1, 3): 10, (1, 4): 10, (2, 1): 20, (2, 4): 10, (3, 4): 1, (4, 1): 10, (4, 2): 10, (4, 3): 10}
    areas = sorted((r["a"], r["b"], round(r["area"], 6)) for r in polygons.overlap_areas(table, "polygon", 7.0).collect())
    assert areas == [(1, 2, 25.0), (1, 4, 84.0), (2, 3, 25.0)]  # 1 and 3 share a side, and no area


def test_cells_and_not_whole_tables_are_joined(spark):
    table = spark.createDataFrame([(1, [[ring((0, 0), (9, 0), (9, 9))]])], POLYGONS)
    plan = polygons.overlaps(spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0)], EDGES), table, "line", "polygon", 3.0)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_linked_tells_ties_and_low_shares(spark):
    pairs = spark.createDataFrame([(1, 7, 5.0), (1, 3, 5.0), (2, 4, 0.5), (3, 4, 9.0), (3, 5, 8.95), (4, 6, 1.0)], "line int, polygon int, overlap double")
    lengths = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 10.0), (4, 0.0), (5, 3.0)], "line int, length double")
    out = {r["line"]: (r["polygon"], r["n_candidates"], r["ambiguous"], r["status"]) for r in polygons.linked(pairs, lengths, "line", "polygon", 0.1).collect()}
    assert out == {1: (3, 2, 1, "review_required"), 2: (4, 1, 0, "low_overlap"), 3: (4, 2, 1, "review_required"), 4: (6, 1, 0, "accepted"), 5: (None, 0, 0, "unmatched")}


def test_lengths_near_a_record_equal_sampling(spark):
    rng = random.Random(3)
    at = lambda: rng.uniform(0, 40)
    records = [(i // 3, *(at() for _ in range(4))) for i in range(18)] + [(50, 12.0, 9.0, 12.0, 9.0)]
    lines = [(i // 2, i % 2, *(at() for _ in range(4))) for i in range(16)]
    out = linkage.near_lengths(spark.createDataFrame(records, EDGES.replace("line", "record")), spark.createDataFrame(lines, "line int, edge int, x1 double, y1 double, x2 double, y2 double"), "record", "line", 5.0, 11.0)
    got = {(r["record"], r["line"]): (r["near"], r["distance"]) for r in out.collect()}

    def distance(px, py, e):
        dx, dy = e[2] - e[0], e[3] - e[1]
        t = np.clip(((px - e[0]) * dx + (py - e[1]) * dy) / ((dx * dx + dy * dy) or 1), 0, 1)
        return np.hypot(px - e[0] - t * dx, py - e[1] - t * dy)

    t = (np.arange(20_000) + 0.5) / 20_000
    for record in {r[0] for r in records}:
        for line in {x[0] for x in lines}:
            near, far = 0.0, math.inf
            for _, _, *e in (x for x in lines if x[0] == line):
                d = np.min([distance(e[0] + t * (e[2] - e[0]), e[1] + t * (e[3] - e[1]), r[1:]) for r in records if r[0] == record], axis=0)
                near, far = near + (d <= 5).mean() * math.hypot(e[2] - e[0], e[3] - e[1]), min(far, d.min())
            assert got.get((record, line), (0.0, far))[0] == pytest.approx(near, abs=0.02)
            if (record, line) in got:
                assert got[record, line][1] == pytest.approx(far, abs=0.02)


def test_direct_spatial_ambiguous_and_unmatched(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 0.0), (2, 0, 0.0, 6.0, 100.0, 6.0), (3, 0, 0.0, 60.0, 100.0, 60.0)], "line int, edge int, x1 double, y1 double, x2 double, y2 double")
    records = spark.createDataFrame([(1, 3), (2, None), (3, None), (4, 77), (5, None), (6, None)], "record int, source int")
    edges = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 0.0), (2, 10.0, 61.0, 40.0, 61.0), (3, 10.0, 3.0, 40.0, 3.0), (4, 50.0, 300.0, 60.0, 300.0), (6, 20.0, 64.9, 20.0, 64.9)], EDGES.replace("line", "record"))
    out = {r["record"]: (r["line"], r["method"], r["status"], r["distance"], r["ambiguous"], r["n_candidates"]) for r in linkage.linked_records(records, edges, lines, "record", "source", "line").collect()}
    assert out == {
        1: (3, "direct_id", "direct_id", 0.0, 0, 0), 2: (3, "spatial_fallback", "spatial_fallback", 1.0, 0, 1), 3: (1, "spatial_fallback", "ambiguous", None, 1, 2),
        4: (None, "unmatched", "unmatched", None, 0, 0), 5: (None, "unmatched", "unmatched", None, 0, 0), 6: (None, "unmatched", "unmatched", None, 0, 0),
    }


def test_quality_of_an_empty_table_and_of_touching_rings(spark):
    schema = "id int, asset int, kind string, parts array<array<array<struct<x: double, y: double>>>>"
    touching = [[ring((0, 0), (9, 0), (9, 9), (0, 9), (0, 0)), ring((0, 4), (3, 3), (3, 5), (0, 4))]]  # a hole that touches the outer ring is no fault
    eight = [[ring((0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2), (0, 0))]]  # a ring that touches itself is
    hole_out = [[ring((0, 0), (9, 0), (9, 9), (0, 9), (0, 0)), ring((5, 5), (12, 5), (12, 7), (5, 5))]]
    rows = spark.createDataFrame([(1, 1, "Polygon", touching), (2, 1, "Polygon", eight), (3, 1, "Polygon", hole_out)], schema)
    assert {r["id"] for r in shapes.crossing_rings(rows, "id").collect()} == {2, 3}
    out = shapes.geometry_quality(rows, "id", "asset").first()
    assert (out["n_valid"], out["n_invalid"], out["n_repeated"]) == (1, 2, 0)
    none = shapes.geometry_quality(rows.limit(0), "id", "asset").first()
    assert none["n"] == none["n_repeated"] == none["n_odd_points"] == 0 and none["min_x"] is None


def test_lines_that_meet_do_not_come_apart(spark):
    rng = random.Random(7)
    rows = []
    for i in range(40):  # a street grid with crooked streets; each crossing is a point of both
        ends = sorted(rng.sample(range(10), 5))
        rows.append((i, [{"x": 100.0 * (i % 20 if i < 20 else x) + (rng.uniform(-8, 8) if k % 2 else 0), "y": 100.0 * (x if i < 20 else i % 20)} for x in ends for k in (0, 1)]))
    rows += [(90, [{"x": 1.0, "y": 1.0}]), (91, []), (92, None), (93, [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 50.0}, {"x": 0.0, "y": 0.0}])]
    lines = spark.createDataFrame(rows, "line int, points array<struct<x: double, y: double>>")
    before = {i: [(p["x"], p["y"]) for p in ps or []] for i, ps in rows}
    after = {r["line"]: [(p["x"], p["y"]) for p in r["points"] or []] for r in shapes.simplified(lines, "line", 10.0).collect()}
    assert after.keys() == before.keys() and sum(map(len, after.values())) < sum(map(len, before.values()))
    shared = {p for i in before for p in before[i] if any(p in before[j] for j in before if j != i)}
    for i, points in before.items():
        assert [p for p in points if p in shared] == [p for p in after[i] if p in shared]
        assert after[i][:1] == points[:1] and after[i][-1:] == points[-1:]
    assert len(after[93]) == 3


def test_points_left_out_are_near_what_stays():
    rng = np.random.default_rng(4)
    x, y = np.arange(400.0), np.cumsum(rng.normal(0, 2, 400))
    keep = shapes.kept_points(x, y, np.zeros(400, bool), 5.0)
    at = np.flatnonzero(keep)
    for a, b in zip(at, at[1:], strict=False):
        dx, dy = x[b] - x[a], y[b] - y[a]
        t = np.clip(((x[a:b] - x[a]) * dx + (y[a:b] - y[a]) * dy) / (dx * dx + dy * dy), 0, 1)
        assert np.hypot(x[a:b] - x[a] - t * dx, y[a:b] - y[a] - t * dy).max() <= 5.0
    assert keep.sum() < 200


def test_normal_form_knows_no_start_or_direction(spark):
    same = [ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((4, 4), (0, 4), (0, 0), (4, 0), (4, 4)), ring((0, 4), (4, 4), (4, 0), (0, 0))]
    rows = spark.createDataFrame([(i, [[r]]) for i, r in enumerate(same)], POLYGONS)
    assert rows.select(F.to_json(shapes.normal_form(F.col("parts")))).distinct().count() == 1
