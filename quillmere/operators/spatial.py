"""Spatial joins as equality joins on grid cells.

An edge goes to the cells its surroundings cover, a point to its own cell, so no pair of rows is
tried that is not near. Long edges ought to be split before (`pieces`), so that a cell list stays short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions.geometry import clipped_length, edge_distance


def _cells(x1: Column, y1: Column, x2: Column, y2: Column, size: float, margin: float) -> Column:
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - margin) / size), F.floor((F.greatest(a, b) + margin) / size))
    return F.flatten(F.transform(span(x1, x2), lambda cx: F.transform(span(y1, y2), lambda cy: F.struct(cx.alias("x"), cy.alias("y")))))


def pieces(edges: DataFrame, size: float) -> DataFrame:
    """edges (x1, y1, x2, y2 and others) cut into equal parts of at most `size`."""
    n = F.greatest(F.ceil(F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)) / size), F.lit(1))
    others = [c for c in edges.columns if c not in ("x1", "y1", "x2", "y2")]
    rows = edges.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1)))
    at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * i / F.col("_n")
    i = F.col("_i")
    return rows.select(*others, at("x1", "x2", i).alias("x1"), at("y1", "y2", i).alias("y1"), at("x1", "x2", i + 1).alias("x2"), at("y1", "y2", i + 1).alias("y2"))


def _near_places(points: DataFrame, edges: DataFrame, line: str, radius: float) -> DataFrame:
    """(_cell, x, y, line, distance) of each place that points have and each line within `radius` of it, dealt by places or their cells, so grouping by place needs no shuffle of pairs."""
    cells = edges.select(line, "x1", "y1", "x2", "y2", F.explode(_cells(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), radius, radius)).alias("_cell"))
    at = points.select("x", "y").distinct().withColumn("_cell", F.struct(F.floor(F.col("x") / radius).alias("x"), F.floor(F.col("y") / radius).alias("y")))
    far = edge_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return at.join(cells, "_cell").withColumn("distance", far).filter(F.col("distance") <= radius).groupBy("_cell", "x", "y", line).agg(F.min("distance").alias("distance"))


def near_pairs(points: DataFrame, edges: DataFrame, point: str, line: str, radius: float) -> DataFrame:
    """(point, line, distance) of all pairs within `radius`: points (point, x, y), edges (line, x1, y1, x2, y2), several edges to a line."""
    return points.select(point, "x", "y").distinct().join(_near_places(points, edges, line, radius), ["x", "y"]).groupBy(point, line).agg(F.min("distance").alias("distance"))


def nearest(points: DataFrame, edges: DataFrame, point: str, line: str, radius: float, tie: float) -> DataFrame:
    """point, line, distance and status of each point: the nearest line within `radius` (accepted, or review_required where another is within `tie` of it), or unmatched. Points of one place are searched for once."""
    place = ["_cell", "x", "y"]
    best = F.min(F.struct("distance", line)).over(Window.partitionBy(*place))
    pairs = _near_places(points, edges, line, radius).withColumn("_best", best)
    ranked = pairs.groupBy(*place).agg(F.first("_best").alias("_best"), F.count_if(F.col("distance") <= F.col("_best.distance") + tie).alias("count"))
    found = ranked.select("x", "y", F.col(f"_best.{line}").alias(line), F.col("_best.distance").alias("distance"), F.when(F.col("count") > 1, "review_required").otherwise("accepted").alias("status"))
    return points.select(point, "x", "y").join(found, ["x", "y"], "left").withColumn("status", F.coalesce("status", F.lit("unmatched"))).drop("x", "y")


def band_counts(points: DataFrame, edges: DataFrame, point: str, line: str, bands: tuple[int, ...]) -> DataFrame:
    """point and n_<band>: the number of lines within each distance. Points of one place are searched for once."""
    pairs = _near_places(points, edges, line, float(max(bands)))
    counts = pairs.groupBy("_cell", "x", "y").agg(*[F.count_if(F.col("distance") <= b).alias(f"n_{b}") for b in bands]).drop("_cell")
    return points.select(point, "x", "y").join(counts, ["x", "y"], "left").na.fill(0, [f"n_{b}" for b in bands]).drop("x", "y")


def overlaps(edges: DataFrame, polygons: DataFrame, line: str, polygon: str, cell: float, least: float = 0.0) -> DataFrame:
    """(line, polygon, overlap): the length of each line in each convex polygon (polygon, corners counterclockwise), where it is above `least`."""
    xs, ys = F.transform("corners", lambda c: c["x"]), F.transform("corners", lambda c: c["y"])
    areas = polygons.select(polygon, "corners", F.explode(_cells(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), cell, 0.0)).alias("_cell"))
    ends = ["x1", "y1", "x2", "y2"]
    rows = edges.groupBy(line, *ends).agg(F.count("*").alias("_times"))  # an edge is known by its ends; one drawn twice counts twice
    parts = rows.select("*", F.explode(_cells(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), cell, 0.0)).alias("_cell"))
    inside = clipped_length(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("corners"))
    pairs = parts.join(areas, "_cell").groupBy(line, polygon, *ends).agg((F.first(inside) * F.first("_times")).alias("inside"))
    return pairs.groupBy(line, polygon).agg(F.sum("inside").alias("overlap")).filter(F.col("overlap") > least)


def primary_polygon(pairs: DataFrame, lengths: DataFrame, line: str, polygon: str, tie: float = 0.1) -> DataFrame:
    """line, polygon, overlap, fraction, n_candidates and status of each line of `lengths` (line, length): the polygon with most of it (the smaller id among equals), accepted, ambiguous (another within `tie`) or none."""
    best = F.max(F.struct("overlap", (-F.col(polygon)).alias("_id"))).over(Window.partitionBy(line))
    ranked = pairs.withColumn("_best", best).groupBy(line, "_best").agg(F.count("*").alias("n_candidates"), F.count_if(F.col("overlap") >= F.col("_best.overlap") - tie).alias("_ties"))
    rows = lengths.join(ranked, line, "left")
    status = F.when(F.col("_best").isNull(), "none").when(F.col("_ties") > 1, "ambiguous").otherwise("accepted")
    return rows.select(line, (-F.col("_best._id")).alias(polygon), F.col("_best.overlap").alias("overlap"), F.try_divide("_best.overlap", "length").alias("fraction"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), status.alias("status"))
