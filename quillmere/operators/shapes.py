"""Quality of geometries, and lines made simpler without parting from one another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.operators.polygons import ENDS, _bound, _turned, cut_at_cells, numbers, ring_sides


def _open(ring: Column) -> Column:
    """A ring without the repeat of its first point."""
    return F.when((F.size(ring) > 1) & (F.element_at(ring, -1) == ring[0]), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def _area(ring: Column) -> Column:
    """Signed area, from the first point."""


    def of(r: Column) -> Column:
        steps = F.coalesce(_turned(F.concat(r, F.slice(r, 1, 1))), F.array())
        return F.aggregate(steps, F.lit(0.0), lambda s, e: s + ((e["a"]["x"] - r[0]["x"]) * (e["b"]["y"] - r[0]["y"]) - (e["b"]["x"] - r[0]["x"]) * (e["a"]["y"] - r[0]["y"])) / 2)

    return _bound(ring, of)


def normal_form(parts: Column) -> Column:
    """parts with rings opened, counterclockwise, from their smallest point on, holes and parts in order: equal for polygons that differ only in how they are written down."""

    def ring(r: Column) -> Column:
        way = _bound(_open(r), lambda o: F.when(_area(o) < 0, F.reverse(o)).otherwise(o))
        turned = lambda w, at: F.concat(F.slice(w, at, F.size(w)), F.slice(w, F.lit(1), at - 1))
        return _bound(way, lambda w: _bound(F.array_position(w, F.array_min(w)), lambda at: turned(w, at)))

    some = F.filter(parts, lambda p: F.size(p) > 0)
    return F.array_sort(F.transform(some, lambda p: F.concat(F.array(ring(p[0])), F.array_sort(F.transform(F.slice(p, F.lit(2), F.size(p)), ring)))))


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The polygons (first column) of pairs of sides that ought not to meet as they do."""
    for batch in batches:
        a, b = (dict(zip(ENDS, numbers(batch, [f"{s}_{c}" for c in ENDS]), strict=True)) for s in "ab")
        gap, last = (batch[c].to_numpy(zero_copy_only=False) for c in ("gap", "last"))
        same = batch["same"].to_numpy(zero_copy_only=False)
        turn = lambda s, x, y: (s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"])
        within = lambda s, o, x, y: (o == 0) & (x >= np.minimum(s["x1"], s["x2"])) & (x <= np.maximum(s["x1"], s["x2"])) & (y >= np.minimum(s["y1"], s["y2"])) & (y <= np.maximum(s["y1"], s["y2"]))
        o1, o2, o3, o4 = turn(a, b["x1"], b["y1"]), turn(a, b["x2"], b["y2"]), turn(b, a["x1"], a["y1"]), turn(b, a["x2"], a["y2"])
        proper = (np.sign(o1) * np.sign(o2) < 0) & (np.sign(o3) * np.sign(o4) < 0)
        dx, dy = a["x2"] - a["x1"], a["y2"] - a["y1"]
        t, u = (((x - a["x1"]) * dx + (y - a["y1"]) * dy) / (dx * dx + dy * dy) for x, y in ((b["x1"], b["y1"]), (b["x2"], b["y2"])))
        shared = (o1 == 0) & (o2 == 0) & (np.minimum(np.maximum(t, u), 1.0) > np.maximum(np.minimum(t, u), 0.0))
        touch = within(a, o1, b["x1"], b["y1"]) | within(a, o2, b["x2"], b["y2"]) | within(b, o3, a["x1"], a["y1"]) | within(b, o4, a["x2"], a["y2"])
        yield batch.select([0]).filter(pa.array(proper | shared | same & (gap > 1) & (gap < last) & touch))


def crossing_rings(polygons: DataFrame, polygon: str) -> DataFrame:
    """(polygon): those of which two sides cross, run along each other or, in one ring, touch where they are not neighbours.

    Sides are compared within the cells of a grid of the polygon's own, about as many as it has sides.
    """
    sides = ring_sides(polygons, polygon).filter(" and ".join(f"abs({c}) < 1e300" for c in ENDS))
    box = sides.groupBy(polygon).agg((F.greatest(F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2")), F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))) / F.sqrt(F.count("*")) * 1.01).alias("_size"))
    last = sides.groupBy(polygon, "part", "ring").agg(F.max("side").alias("_last"))
    cells = cut_at_cells(sides.join(box.withColumnRenamed("_size", "_cell"), polygon).join(last, [polygon, "part", "ring"]), F.col("_cell"))
    one = F.struct("part", "ring", "side", "_last", *ENDS)
    groups = cells.groupBy(polygon, "cx", "cy").agg(F.collect_list(one).alias("_sides")).filter(F.size("_sides") > 1)
    pairs = groups.select(polygon, "_sides", F.explode("_sides").alias("a")).select(polygon, "a", F.explode("_sides").alias("b"))
    before = F.struct("a.ring", "a.side") < F.struct("b.ring", "b.side")
    told = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ENDS] + [(F.col("a.ring") == F.col("b.ring")).alias("same"), F.abs(F.col("a.side") - F.col("b.side")).alias("gap"), F.col("a._last").alias("last")]
    pairs = pairs.filter((F.col("a.part") == F.col("b.part")) & before).select(polygon, *told)
    return pairs.mapInArrow(_crossing, pairs.select(polygon).schema).distinct()


FACTS = "_unclosed long, _short long, _odd long, _area double, _min_x double, _min_y double, _max_x double, _max_y double"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with `parts` replaced by FACTS: rings that do not close, rings of fewer than four points, points that are not finite, the area (holes less) and the bounds of finite points."""
    for batch in batches:
        nested, levels = batch["parts"], []
        for _ in range(3):
            n = pc.fill_null(pc.list_value_length(nested), 0).to_numpy(zero_copy_only=False)
            levels.append(np.repeat(np.arange(len(n)), n))
            nested = nested.flatten()
        part_row, ring_part, point_ring = levels
        x, y = (pc.cast(pc.struct_field(nested, c), pa.float64()).to_numpy(zero_copy_only=False) for c in "xy")
        ring_row = part_row[ring_part]
        point_row, rings, rows = ring_row[point_ring], len(ring_part), batch.num_rows
        n = np.bincount(point_ring, minlength=rings)
        first, some = np.cumsum(n) - n, n > 0
        f, last = first[some], (first + n - 1)[some]
        apart = lambda v: (v[f] != v[last]) & ~(np.isnan(v[f]) & np.isnan(v[last]))
        unclosed = np.bincount(ring_row[some], apart(x) | apart(y), rows)
        to = np.arange(1, len(x) + 1)
        to[last] = f
        x0, y0 = x[first[point_ring]], y[first[point_ring]]
        with np.errstate(invalid="ignore", over="ignore"):
            area = np.abs(np.bincount(point_ring, ((x - x0) * (y[to] - y0) - (x[to] - x0) * (y - y0)) / 2, rings))
        outer = np.append(True, ring_part[1:] != ring_part[:-1])[:rings]
        area = np.bincount(part_row, np.bincount(ring_part, np.where(outer, area, -area), len(part_row)), rows)
        finite = np.isfinite(x) & np.isfinite(y)
        here = batch["_here"].to_numpy(zero_copy_only=False)
        out = [pa.array(v.astype(np.int64)) for v in (unclosed, np.bincount(ring_row, n < 4, rows), np.bincount(point_row, ~finite, rows))] + [pa.array(area.astype(np.float64))]
        for pick, start in ((np.minimum, np.inf), (np.maximum, -np.inf)):
            for v in (x, y):
                found = np.full(rows, start)
                pick.at(found, point_row[finite], v[finite])
                out.append(pa.array(found, mask=np.isinf(found) | ~here))
        kept = batch.drop_columns(["parts"])
        yield pa.RecordBatch.from_arrays([*kept.columns, *out], names=[*kept.schema.names, *[c.split()[0] for c in FACTS.split(", ")]])


def geometry_quality(polygons: DataFrame, polygon: str, asset: str, least_area: float = 1e-7) -> DataFrame:
    """One row of counts over polygons (polygon, asset, kind, parts), `polygon` unique: nulls, empties, kinds, faults of rings, valid and invalid, areas below `least_area`, repeats of a geometry and of (asset, geometry), and the bounds of all finite points.

    A null geometry has null parts. Repeats are told by a hash of the normal form. All but an empty table's counts are numbers; its bounds are null.
    """
    points = F.flatten(F.flatten("parts"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    here = F.coalesce(F.size(points), F.lit(0)) > 0
    told = polygons.select(polygon, "kind", F.col("parts").isNull().alias("_null"), here.alias("_here"), "parts")
    rows = told.mapInArrow(_facts, T.StructType([*told.drop("parts").schema.fields, *T.StructType.fromDDL(FACTS).fields]))
    plain = polygons.select(polygon, "parts").filter(here & ~F.exists(points, lambda p: ~(finite(p["x"]) & finite(p["y"]))))
    crossed = crossing_rings(plain, polygon).withColumn("_crossed", F.lit(True))
    rows = rows.join(crossed, polygon, "left").withColumn("_bad", F.col("_here") & (F.coalesce("_crossed", F.lit(False)) | (F.col("_unclosed") > 0) | (F.col("_short") > 0) | (F.col("_odd") > 0) | (F.col("_area") <= 0)))
    of_here = lambda c: F.coalesce(F.sum(F.when(F.col("_here"), F.col(c))), F.lit(0))
    counts = rows.agg(
        F.count("*").alias("n"), F.count_if("_null").alias("n_null"), F.count_if(~F.col("_null") & ~F.col("_here")).alias("n_empty"), F.count_if(F.col("_here") & (F.col("kind") == "Polygon")).alias("n_polygon"), F.count_if(F.col("_here") & (F.col("kind") == "MultiPolygon")).alias("n_multipolygon"),
        F.count_if("_bad").alias("n_invalid"), F.count_if(F.col("_here") & ~F.col("_bad")).alias("n_valid"), F.count_if("_crossed").alias("n_self_crossing"), of_here("_unclosed").alias("n_unclosed_rings"), of_here("_short").alias("n_short_rings"), of_here("_odd").alias("n_odd_points"),
        F.count_if(F.col("_here") & (F.col("_area") < least_area)).alias("n_zero_area"), F.min("_min_x").alias("min_x"), F.min("_min_y").alias("min_y"), F.max("_max_x").alias("max_x"), F.max("_max_y").alias("max_y"),
    )
    hashed = polygons.filter(here).select(asset, F.md5(F.to_json(normal_form(F.col("parts")))).alias("_hash"))
    shapes = hashed.groupBy("_hash", asset).count().groupBy("_hash").agg(F.sum("count").alias("n"), F.sum(F.col("count") - 1).alias("same"))
    repeats = shapes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated"), F.coalesce(F.sum("same"), F.lit(0)).alias("n_repeated_asset"))
    return counts.crossJoin(repeats)  # one row each


def kept_points(x: np.ndarray, y: np.ndarray, fixed: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay: both ends, fixed ones, and between those the ones that Douglas and Peucker's rule keeps. A line whose ends are one point keeps the point farthest from it."""
    keep = fixed.copy()
    keep[[0, -1]] = True
    stops = np.flatnonzero(keep)
    left = list(zip(stops, stops[1:], strict=False))
    while left:
        a, b = left.pop()
        if b - a < 2:
            continue
        px, py, dx, dy = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a], x[b] - x[a], y[b] - y[a]
        norm = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / norm, 0, 1) if norm else np.zeros(len(px))
        far = np.hypot(px - t * dx, py - t * dy)
        at = int(far.argmax())
        if far[at] > tolerance or not norm:
            keep[a + 1 + at] = True
            left += [(a, a + 1 + at), (a + 1 + at, b)]
    return keep


def _simpler(tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for points in batch.column(1).to_pylist():
                x, y = (np.array([p[c] for p in points], float) for c in "xy")
                keep = kept_points(x, y, np.array([p["fixed"] for p in points], bool), tolerance)
                out.append([{"x": a, "y": b} for a, b in zip(x[keep], y[keep], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))], batch.schema.names[:1] + ["points"])

    return run


def simplified(lines: DataFrame, line: str, tolerance: float) -> DataFrame:
    """(line, points) of lines (line, points: array of x, y), with points left out that are within `tolerance` of what stays.

    A point that several lines have stays in all of them, so lines that meet still do, as do both ends of each. line is unique; lines with fewer than two points stay as they are.
    """
    points = lines.select(line, F.posexplode("points").alias("_at", "_p")).select(line, "_at", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    shared = points.groupBy("x", "y").agg(F.min(line).alias("_a"), F.max(line).alias("_b")).filter("_a <> _b").select("x", "y", F.lit(True).alias("fixed"))
    told = points.join(shared, ["x", "y"], "left").groupBy(line).agg(F.sort_array(F.collect_list(F.struct("_at", "x", "y", F.coalesce("fixed", F.lit(False)).alias("fixed")))).alias("points"))
    kind = dict(lines.dtypes)[line]
    done = told.filter(F.size("points") > 1).select(line, F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["fixed"].alias("fixed"))).alias("points"))
    short = lines.filter(F.coalesce(F.size("points"), F.lit(0)) < 2).select(line, F.transform("points", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("points"))
    return done.mapInArrow(_simpler(tolerance), f"`{line}` {kind}, points array<struct<x: double, y: double>>").unionByName(short)
