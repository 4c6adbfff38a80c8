"""Records linked to lines by a direct id, and where that fails by how much of a line runs within a distance of the record's geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions.geometry import edge_distance
from quillmere.operators.polygons import ENDS, OFFSET, cut_at_cells
from quillmere.operators.spatial import pieces


def _between(f0: Column, f1: Column, low: Column, high: Column) -> Column:
    """The (a, b) of t for which f0 + f1 * t is from low to high; null if there is none."""
    a, b = (low - f0) / F.nullif(f1, F.lit(0.0)), (high - f0) / F.nullif(f1, F.lit(0.0))
    all_ = F.when((f0 >= low) & (f0 <= high), F.struct(F.lit(float("-inf")).alias("a"), F.lit(float("inf")).alias("b")))
    return F.when(f1 == 0, all_).otherwise(F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))


def _disc(x: Column, y: Column, dx: Column, dy: Column, radius: float) -> Column:
    """The same for a disc about the origin, of the points (x, y) + t (dx, dy)."""
    norm, half = dx * dx + dy * dy, x * dx + y * dy
    under = half * half - norm * (x * x + y * y - radius * radius)
    return F.when(under >= 0, F.struct(((-half - F.sqrt(under)) / norm).alias("a"), ((-half + F.sqrt(under)) / norm).alias("b")))


def within_capsule(pairs: DataFrame, radius: float) -> DataFrame:
    """pairs with a and b: from which t to which, of t0 to t1, an edge x1, y1, x2, y2 is within `radius` of the edge sx1, sy1, sx2, sy2; those that nowhere are go.

    All points within a distance of an edge are a convex set, so it is one interval: from where a disc about an end or the strip between them is entered first, to where one is left last.
    """
    c = F.col
    # step by step, since each is used more than once
    rows = pairs.withColumns({"_dx": c("x2") - c("x1"), "_dy": c("y2") - c("y1"), "_ex": c("sx2") - c("sx1"), "_ey": c("sy2") - c("sy1"), "_x": c("x1") - c("sx1"), "_y": c("y1") - c("sy1")})
    dx, dy, ex, ey, x, y, length = map(c, ("_dx", "_dy", "_ex", "_ey", "_x", "_y", "_length"))
    rows = rows.withColumn("_length", F.nullif(F.hypot(ex, ey), F.lit(0.0)))
    discs = {"_from": _disc(x, y, dx, dy, radius), "_to": _disc(x - ex, y - ey, dx, dy, radius)}
    rows = rows.withColumns(discs | {"_side": _between((x * ey - y * ex) / length, (dx * ey - dy * ex) / length, F.lit(-radius), F.lit(radius)), "_along": _between(x * ex + y * ey, dx * ex + dy * ey, F.lit(0.0), length * length)})
    low, high = F.greatest("_side.a", "_along.a"), F.least("_side.b", "_along.b")
    both = c("_side").isNotNull() & c("_along").isNotNull() & c("_length").isNotNull() & (low <= high)
    rows = rows.withColumn("_strip", F.when(both, F.struct(low.alias("a"), high.alias("b"))))
    span = F.struct(F.least("_from.a", "_to.a", "_strip.a").alias("a"), F.greatest("_from.b", "_to.b", "_strip.b").alias("b"))
    cut = F.transform(F.filter(F.array(span), lambda w: w["a"].isNotNull()), lambda w: F.struct(F.greatest(w["a"], c("t0")).alias("a"), F.least(w["b"], c("t1")).alias("b")))
    # a filter on a and b would be moved into the join, with all of the above for each time they are named
    return rows.select(*pairs.columns, F.inline(F.filter(cut, lambda w: w["a"] < w["b"])))


def _edge_to_edge() -> Column:
    """The distance of the edges x1, y1, x2, y2 and sx1, sy1, sx2, sy2."""
    x1, y1, x2, y2, sx1, sy1, sx2, sy2 = map(F.col, (*ENDS, "sx1", "sy1", "sx2", "sy2"))
    cross = lambda ax, ay, bx, by, cx, cy: (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    apart = lambda p, q: (p < 0) & (q > 0) | (p > 0) & (q < 0)
    meet = apart(cross(x1, y1, x2, y2, sx1, sy1), cross(x1, y1, x2, y2, sx2, sy2)) & apart(cross(sx1, sy1, sx2, sy2, x1, y1), cross(sx1, sy1, sx2, sy2, x2, y2))
    one, two = (x1, y1, x2, y2), (sx1, sy1, sx2, sy2)
    ends = F.array(*[F.struct(*[v.alias(n) for n, v in zip(("x", "y", *ENDS), (*p, *e), strict=True)]) for e, p in ((one, two[:2]), (one, two[2:]), (two, one[:2]), (two, one[2:]))])
    least = F.array_min(F.transform(ends, lambda e: edge_distance(e["x"], e["y"], *[e[c] for c in ENDS])))
    return F.when(meet, 0.0).otherwise(least)


def near_lengths(records: DataFrame, lines: DataFrame, record: str, line: str, radius: float, size: float) -> DataFrame:
    """(record, line, near, distance): how much of a line runs within `radius` of a record's geometry, overlapping stretches once, and how far they are apart.

    records (record, x1, y1, x2, y2) and lines (line, edge, x1, y1, x2, y2) have a row for each edge; a point is an edge without length. A line's
    pieces meet, by an equality join on cells, the edges whose surroundings reach into their cell.
    """
    margin = lambda a, b, low: (F.floor((F.least(a, b) - radius) / size - OFFSET) if low else F.floor((F.greatest(a, b) + radius) / size - OFFSET)).cast("long")
    span = lambda a, b: F.sequence(margin(F.col(a), F.col(b), True), margin(F.col(a), F.col(b), False))
    around = pieces(records.select(record, *ENDS), size).select(record, *[F.col(c).alias(f"s{c}") for c in ENDS])
    around = around.withColumn("cx", F.explode(span("sx1", "sx2"))).withColumn("cy", F.explode(span("sy1", "sy2")))
    parts = cut_at_cells(lines.select(line, "edge", *ENDS).filter("x1 <> x2 or y1 <> y2"), size)
    pairs = within_capsule(parts.join(around, ["cx", "cy"]), radius).withColumn("distance", _edge_to_edge())
    each = pairs.groupBy(record, line, "edge", *ENDS).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_spans"), F.min("distance").alias("distance"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("to"))
    joined = F.aggregate("_spans", start, lambda s, p: F.struct((s["sum"] + F.greatest(p["b"] - F.greatest(p["a"], s["to"]), F.lit(0.0))).alias("sum"), F.greatest(s["to"], p["b"]).alias("to")), lambda s: s["sum"])
    each = each.withColumn("near", joined * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    return each.groupBy(record, line).agg(F.sum("near").alias("near"), F.min("distance").alias("distance"))


def linked_records(records: DataFrame, edges: DataFrame, lines: DataFrame, record: str, source: str, line: str, radius: float = 5.0, least: float = 5.0, tie: float = 1.0, size: float = 100.0) -> DataFrame:
    """record, line, method, status, distance, ambiguous and n_candidates of each of `records` (record, source).

    A record whose source id is a line's is linked to it (direct_id, distance 0). The others, and only they, are linked to the line with most length within
    `radius` of their edges (record, x1, y1, x2, y2), of those with at least `least` (the smallest id among equals): spatial_fallback, or ambiguous, without a
    distance, where another one is within `tie` of it. What is left is unmatched, as are null sources without edges. record is unique.
    """
    known = lines.select(F.col(line).alias(source)).distinct()
    direct = records.join(known, source, "left_semi").select(record, F.col(source).alias(line), F.lit("direct_id").alias("method"), F.lit("direct_id").alias("status"), F.lit(0.0).alias("distance"), F.lit(0).alias("ambiguous"), F.lit(0).cast("long").alias("n_candidates"))
    rest = records.join(known, source, "left_anti").select(record)
    found = near_lengths(edges.join(rest, record, "left_semi"), lines, record, line, radius, size).filter(F.col("near") >= least)
    own = Window.partitionBy(record)
    found = found.withColumns({"_most": F.max("near").over(own), "n_candidates": F.count("*").over(own)}).filter(F.col("near") >= F.col("_most") - tie)
    best = found.groupBy(record, "n_candidates").agg(F.count("*").alias("_near"), F.min(F.when(F.col("near") == F.col("_most"), F.struct(line, "distance"))).alias("_best"))
    rows, alone = rest.join(best, record, "left"), F.col("_near") == 1
    method = F.when(F.col("_best").isNull(), "unmatched").otherwise("spatial_fallback")
    rows = rows.select(record, F.col(f"_best.{line}").alias(line), method.alias("method"), F.when(F.col("_near") > 1, "ambiguous").otherwise(method).alias("status"), F.when(alone, F.col("_best.distance")).alias("distance"), (F.coalesce("_near", F.lit(0)) > 1).cast("int").alias("ambiguous"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))
    return direct.unionByName(rows)
