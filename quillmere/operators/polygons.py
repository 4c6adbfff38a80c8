"""Lines and polygons of any shape against polygons: concave ones, holes and several parts, by grid cells.

A polygon is `parts`, an array of parts, each an array of rings (the outer one first, then holes), each
an array of structs (x, y); whether a ring repeats its first point at its end does not matter. What is inside follows from even-odd
parity. Every cell that a polygon touches gets the sides that pass through it and the parity at its lower
left corner; lines are cut at cell borders, so that each piece meets one cell of a polygon, by an
equality join, and all that is computed of it needs only that cell's sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OFFSET = 0.3819660112501051  # cells begin off round coordinates, so borders of polygons seldom lie on borders of cells
NEAR = 1e-7  # what lies so near to a side and runs along it lies on it
ENDS = ("x1", "y1", "x2", "y2")
OUT, IN, ALONG, AGAINST = 0, 2, 1, -1


def _place(v: Column, size) -> Column:
    return v / size - OFFSET


def _border(c: Column, size) -> Column:
    return (c + OFFSET) * size


def _steps(a: Column, b: Column) -> Column:
    """The whole numbers from ceil(a) to below b."""
    first, last = F.ceil(a).cast("long"), (F.ceil(b) - 1).cast("long")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), c being computed once, however often f names it: inside the functions of arrays Spark computes a column again wherever it stands."""
    return F.transform(F.array(c), f)[0]


def _turned(array: Column) -> Column:
    """Each element of an array with the next one, as structs a, b; none of fewer than two."""
    pairs = lambda c, n: F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return _bound(array, lambda c: F.when(F.size(c) > 1, pairs(c, F.size(c) - 1)))


def ring_sides(polygons: DataFrame, polygon: str) -> DataFrame:
    """(polygon, part, ring, side, x1, y1, x2, y2): the sides of all rings; points that repeat make none."""
    rings = polygons.select(polygon, F.posexplode("parts").alias("part", "_rings")).select(polygon, "part", F.posexplode("_rings").alias("ring", "_points"))
    closed = rings.filter(F.size("_points") > 1).withColumn("_points", F.concat("_points", F.slice("_points", 1, 1)))
    sides = closed.select(polygon, "part", "ring", F.posexplode(_turned(F.col("_points"))).alias("side", "_s"))
    return sides.select(polygon, "part", "ring", "side", F.col("_s.a.x").alias("x1"), F.col("_s.a.y").alias("y1"), F.col("_s.b.x").alias("x2"), F.col("_s.b.y").alias("y2")).filter("x1 <> x2 or y1 <> y2")


PIECES = 1_000_000  # pieces that are cut at once, but for one edge with more


def numbers(batch: pa.RecordBatch, names: Iterable[str]) -> list[np.ndarray]:
    """Columns of a batch as doubles; a null is NaN."""
    return [pc.cast(batch[n], pa.float64()).to_numpy(zero_copy_only=False) for n in names]


def counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i n[i] times: i, and how often it was there before."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - (np.cumsum(n) - n)[of]


def slices(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of n whose sums are at most `most`, or of single values above it."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def intervals(i: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, a, b) of neighbours a < b among the values t of each i."""
    order = np.lexsort((t, i))
    i, t = i[order], t[order]
    new = np.append(True, (i[1:] != i[:-1]) | (t[1:] != t[:-1])) if len(i) else np.zeros(0, bool)
    i, t = i[new], t[new]
    same = i[1:] == i[:-1]
    return i[:-1][same], t[:-1][same], t[1:][same]


def _steps_of(a: np.ndarray, b: np.ndarray, size: np.ndarray, finite: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, end = (np.ceil(np.where(finite, f(a, b), 0.0) / size - OFFSET).astype(np.int64) for f in (np.minimum, np.maximum))
    return first, np.maximum(end - first, 0)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        *ends, size = numbers(whole, (*ENDS, "_size"))
        known = np.logical_and.reduce([whole[c].is_valid().to_numpy(zero_copy_only=False) for c in (*ENDS, "_size")])
        finite = np.isfinite(np.stack([*ends, size])).all(axis=0)
        size = np.where(finite, size, 1.0)
        (gx, nx), (gy, ny) = (_steps_of(a, b, size, finite) for a, b in (ends[0::2], ends[1::2]))
        for low, high in slices(nx + ny + 1, PIECES):
            x1, y1, x2, y2, w = (v[low:high] for v in (*ends, size))
            every, at, t = np.arange(high - low), [], []
            for first, n, a, b in ((gx, nx, x1, x2), (gy, ny, y1, y2)):
                i, k = counted(n[low:high])
                found = ((first[low:high][i] + k + OFFSET) * w[i] - a[i]) / (b[i] - a[i])
                inner = (found > 0) & (found < 1)
                at, t = [*at, i[inner]], [*t, found[inner]]
            i, t0, t1 = intervals(np.concatenate([every, every, *at]), np.concatenate([np.zeros(len(every)), np.ones(len(every)), *t]))
            middle = (t0 + t1) / 2
            cells = [np.floor(np.where(finite[low + i], a[i] + middle * (b[i] - a[i]), 0.0) / w[i] - OFFSET).astype(np.int64) for a, b in ((x1, x2), (y1, y2))]
            rows = whole.drop_columns(["_size"]).take(pa.array(low + i))
            more = {"t0": pa.array(t0), "t1": pa.array(t1)} | {c: pa.array(v, mask=~known[low + i]) for c, v in zip(("cx", "cy"), cells, strict=True)}
            yield pa.RecordBatch.from_arrays([*rows.columns, *more.values()], names=[*rows.schema.names, *more])


def cut_at_cells(edges: DataFrame, size) -> DataFrame:
    """edges (x1, y1, x2, y2 and others) with t0, t1, cx and cy: a row for each part of an edge within one cell."""
    kinds = [T.StructField(c, T.DoubleType()) for c in ("t0", "t1")] + [T.StructField(c, T.LongType()) for c in ("cx", "cy")]
    sized = edges.withColumn("_size", (size if isinstance(size, Column) else F.lit(size)).cast("double"))
    return sized.drop("t0", "t1", "cx", "cy").mapInArrow(_cut, T.StructType([f for f in edges.schema.fields if f.name not in ("t0", "t1", "cx", "cy")] + kinds))


def polygon_cells(polygons: DataFrame, polygon: str, size: float) -> DataFrame:
    """(polygon, cx, cy, odd, sides): the cells that a polygon touches, whether their lower left corner is inside, and the sides in them. Cells far inside have none."""
    sides = ring_sides(polygons, polygon)
    touched = cut_at_cells(sides, size).groupBy(polygon, "cx", "cy").agg(F.collect_set(F.struct(*ENDS, "part", "ring", "side")).alias("sides"))
    x1, y1, x2, y2 = map(F.col, ENDS)
    rows = sides.select(polygon, *ENDS, F.explode(_steps(_place(F.least(y1, y2), size), _place(F.greatest(y1, y2), size))).alias("cy"))
    where = x1 + (_border(F.col("cy"), size) - y1) * (x2 - x1) / (y2 - y1)
    passed = rows.groupBy(polygon, "cy", F.ceil(_place(where, size)).cast("long").alias("from")).count()
    along = Window.partitionBy(polygon, "cy").orderBy("from")
    runs = passed.withColumns({"_n": F.sum("count").over(along), "_to": F.lead("from").over(along)}).filter("_n % 2 = 1 and _to > from")
    inside = runs.select(polygon, "cy", F.explode(F.sequence(F.col("from"), F.col("_to") - 1)).alias("cx"), F.lit(True).alias("odd"))
    cells = touched.join(inside, [polygon, "cx", "cy"], "full")
    return cells.select(polygon, "cx", "cy", F.coalesce("odd", F.lit(False)).alias("odd"), F.coalesce("sides", F.array().cast(touched.schema["sides"].dataType)).alias("sides"))


def _states(rows: list[np.ndarray], odd: np.ndarray, sides: list[np.ndarray], n: np.ndarray, size: float) -> tuple[np.ndarray, ...]:
    """(i, a, b, state) of the parts of pieces (x1, y1, x2, y2, t0, t1, cx, cy) that are not OUT; the first n[0] of `sides` are those of the first piece's cell, and so on."""
    x1, y1, x2, y2, t0, t1, cx, cy = rows
    sx, sy, ex, ey = sides[0], sides[1], sides[2] - sides[0], sides[3] - sides[1]
    dx, dy, corner_x, corner_y = x2 - x1, y2 - y1, (cx + OFFSET) * size, (cy + OFFSET) * size
    norm, length, first = dx * dx + dy * dy, ex * ex + ey * ey, np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    px, py, ax, ay = dx[of], dy[of], sx - x1[of], sy - y1[of]
    turn = px * ey - py * ex
    parallel = turn * turn <= 1e-24 * norm[of] * length
    u = (ax * py - ay * px) / turn
    cuts = [(parallel, (ax * px + ay * py) / norm[of]), (parallel, ((ax + ex) * px + (ay + ey) * py) / norm[of]), (~parallel & (u >= 0) & (u <= 1), (ax * ey - ay * ex) / turn)]
    cuts = [(of[k], t[k]) for k, t in ((k & (t > t0[of]) & (t < t1[of]), t) for k, t in cuts)]
    every = np.arange(len(n))
    i, a, b = intervals(np.concatenate([every, every, *[k for k, _ in cuts]]), np.concatenate([t0, t1, *[t for _, t in cuts]]))
    state = np.zeros(len(i), np.int32)
    for low, high in slices(n[i] + 1, PIECES):
        at = i[low:high]
        x, y = (c[at] + (a[low:high] + b[low:high]) / 2 * d[at] for c, d in ((x1, dx), (y1, dy)))
        k, nth = counted(n[at])
        s = first[at][k] + nth  # a part against each side of its cell
        fx, fy, gx, gy, qx, qy = sx[s], sy[s], ex[s], ey[s], x[k] - sx[s], y[k] - sy[s]
        off, along = qx * gy - qy * gx, qx * gx + qy * gy
        same = parallel[s] & (off * off <= NEAR * NEAR * length[s]) & (along >= 0) & (along <= length[s])
        left, bottom = corner_x[at][k], corner_y[at][k]
        up = (fx <= left) != (sides[2][s] <= left)  # the way from the corner goes up and then right
        up_at = fy + (left - fx) * gy / gx
        right = (fy <= y[k]) != (sides[3][s] <= y[k])
        right_at = fx + (y[k] - fy) * gx / gy
        crossed = (up & (up_at > bottom) & (up_at <= y[k])).astype(np.int64) + (right & (right_at > left) & (right_at <= x[k]))
        times = odd[at] + np.bincount(k, crossed, len(at)).astype(np.int64)
        found = np.where((times % 2 == 1) | (n[at] == 0), IN, OUT)
        on, place = np.unique(k[same], return_index=True)
        side = s[same][place]
        found[on] = np.where(dx[at[on]] * ex[side] + dy[at[on]] * ey[side] > 0, ALONG, AGAINST)
        state[low:high] = found
    kept = state != OUT
    return i[kept], a[kept], b[kept], state[kept]


def _spans(size: float, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = numbers(batch, (*ENDS, "t0", "t1", "cx", "cy"))
            odd = batch["odd"].to_numpy(zero_copy_only=False).astype(np.int64)
            n, flat = pc.list_value_length(batch["sides"]).to_numpy(zero_copy_only=False).astype(np.int64), batch["sides"].flatten()
            sides = [pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ENDS]
            ends = np.append(0, np.cumsum(n))
            for low, high in slices(n + 1, PIECES):
                with np.errstate(divide="ignore", invalid="ignore"):
                    i, a, b, state = _states([v[low:high] for v in rows], odd[low:high], [v[ends[low] : ends[high]] for v in sides], n[low:high], size)
                kept = batch.select(names).take(pa.array(low + i))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(a), pa.array(b), pa.array(state)], names=[*names, "a", "b", "state"])

    return run


def spans(edges: DataFrame, cells: DataFrame, size: float, only: Column | None = None) -> DataFrame:
    """The columns of edges and of cells (but cx, cy, odd and sides) with a, b and state: the parts of each edge that are in a polygon (IN) or run along its border, in the direction of the side (ALONG) or not (AGAINST). `only` says which edges meet which polygons."""
    pieces = cut_at_cells(edges, size).join(cells, ["cx", "cy"])
    pieces = pieces if only is None else pieces.filter(only)
    names = [*edges.columns, *[c for c in cells.columns if c not in ("cx", "cy", "odd", "sides")]]
    kinds = [T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType()), T.StructField("state", T.IntegerType())]
    return pieces.mapInArrow(_spans(size, names), T.StructType([*pieces.select(*names).schema.fields, *kinds]))


def overlaps(edges: DataFrame, polygons: DataFrame, line: str, polygon: str, size: float, least: float = 0.0) -> DataFrame:
    """(line, polygon, overlap): the length of each line (edges line, x1, y1, x2, y2) in each polygon (polygon, parts), borders included, where it is above `least`.

    Null coordinates and edges of no length add nothing; an edge that is there twice counts twice. An empty table gives none.
    """
    rows = spans(edges.select(line, *ENDS).filter("x1 <> x2 or y1 <> y2"), polygon_cells(polygons.select(polygon, "parts"), polygon, size), size)
    step = (F.col("b") - F.col("a")) * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return rows.groupBy(line, polygon).agg(F.sum(step).alias("overlap")).filter(F.col("overlap") > least)


def linked(pairs: DataFrame, lengths: DataFrame, line: str, polygon: str, least_fraction: float = 0.0, tie: float = 0.1) -> DataFrame:
    """line, polygon, overlap, fraction, n_candidates, ambiguous and status of each line of `lengths` (line, length): the polygon with most of it, the smallest id among equals.

    status: unmatched, low_overlap (a smaller share than `least_fraction`), review_required (another polygon within `tie` of it) or accepted.
    """
    best = pairs.groupBy(line).agg(F.max("overlap").alias("_most"), F.count("*").alias("n_candidates"))
    near = pairs.join(best, line).filter(F.col("overlap") >= F.col("_most") - tie)
    first = near.groupBy(line, "_most", "n_candidates").agg(F.count("*").alias("_near"), F.min(F.when(F.col("overlap") == F.col("_most"), F.col(polygon))).alias(polygon))
    rows = lengths.join(first, line, "left").withColumn("fraction", F.try_divide("_most", "length"))
    status = F.when(F.col("_most").isNull(), "unmatched").when(F.col("fraction") < least_fraction, "low_overlap").when(F.col("_near") > 1, "review_required").otherwise("accepted")
    return rows.select(line, polygon, F.col("_most").alias("overlap"), "fraction", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), (F.coalesce("_near", F.lit(0)) > 1).cast("int").alias("ambiguous"), status.alias("status"))


def oriented(polygons: DataFrame, polygon: str) -> DataFrame:
    """polygons (polygon, parts) with the inside to the left of all sides: outer rings counterclockwise, holes clockwise."""
    area = lambda ring: F.aggregate(F.coalesce(_turned(F.concat(ring, F.slice(ring, 1, 1))), F.array()), F.lit(0.0), lambda s, e: s + (e["a"]["x"] - ring[0]["x"]) * (e["b"]["y"] - ring[0]["y"]) - (e["b"]["x"] - ring[0]["x"]) * (e["a"]["y"] - ring[0]["y"]))
    turned = F.transform("parts", lambda part: F.transform(part, lambda ring, i: F.when((area(ring) > 0) == (i == 0), ring).otherwise(F.reverse(ring))))
    return polygons.select(polygon, turned.alias("parts"))


def overlap_areas(polygons: DataFrame, polygon: str, size: float, least: float = 1e-3) -> DataFrame:
    """(a, b, area) of all pairs a < b of polygons (polygon, parts) that share more than `least`: the integral of x dy along the border of what they share.

    That border is what of a's sides lies in b, what of b's lies in a, and what both have and pass in the same direction. polygon is unique, and a
    polygon's parts do not overlap.
    """
    whole = oriented(polygons, polygon)
    origin = ring_sides(whole, polygon).agg(F.min("x1"), F.min("y1")).first()
    x0, y0 = (v or 0.0 for v in origin)
    edges = ring_sides(whole, polygon).select(F.col(polygon).alias("_own"), *ENDS)
    rows = spans(edges, polygon_cells(whole, polygon, size), size, F.col("_own") != F.col(polygon))
    rows = rows.filter((F.col("state") == IN) | (F.col("state") == ALONG) & (F.col("_own") < F.col(polygon)))
    x = lambda t: F.col("x1") - x0 + F.col(t) * (F.col("x2") - F.col("x1"))
    y = lambda t: F.col("y1") - y0 + F.col(t) * (F.col("y2") - F.col("y1"))
    step = (x("a") * y("b") - x("b") * y("a")) / 2
    pairs = rows.groupBy(F.least("_own", polygon).alias("a"), F.greatest("_own", polygon).alias("b")).agg(F.sum(step).alias("area"))
    return pairs.filter(F.col("area") > least)
