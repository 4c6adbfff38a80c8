"""Planar geometry and a transverse Mercator projection as column expressions.

A line is an array of structs (x, y); an edge four columns; a polygon the array of its corners.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import radians

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Projection:
    """A transverse Mercator projection by third-order series in the third flattening."""

    meridian: float = -73.5
    scale: float = 0.9999
    easting: float = 304_800.0
    axis: float = 6_378_137.0
    flattening: float = 1 / 298.257222101

    @property
    def n(self) -> float:
        return self.flattening / (2 - self.flattening)

    @property
    def radius(self) -> float:
        return self.scale * self.axis / (1 + self.n) * (1 + self.n**2 / 4 + self.n**4 / 64)

    @property
    def eccentricity(self) -> float:
        return 2 * self.n**0.5 / (1 + self.n)

    @property
    def ahead(self) -> tuple[float, ...]:
        n = self.n
        return n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240

    @property
    def behind(self) -> tuple[float, ...]:
        n = self.n
        return n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480

    @property
    def latitudes(self) -> tuple[float, ...]:
        n = self.n
        return 2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Easting and northing in metres of degrees."""
        s, e, away = F.sin(F.radians(lat)), self.eccentricity, F.radians(lon) - radians(self.meridian)
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
        x = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(self.ahead, 1)), F.lit(0.0))
        y = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(self.ahead, 1)), F.lit(0.0))
        return self.easting + self.radius * x, self.radius * y

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude in degrees of metres."""
        xi, eta = y / self.radius, (x - self.easting) / self.radius
        u = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(self.behind, 1)), F.lit(0.0))
        v = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(self.behind, 1)), F.lit(0.0))
        chi = F.asin(F.sin(u) / F.cosh(v))
        lat = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(self.latitudes, 1)), F.lit(0.0))
        return self.meridian + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(lat)


def length(line: Column) -> Column:
    """Length of a line; 0 for one point or none."""
    tail = F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0)))
    steps = F.zip_with(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), tail, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def edge_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from an edge."""
    dx, dy = x2 - x1, y2 - y1
    along = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def clipped_length(x1: Column, y1: Column, x2: Column, y2: Column, corners: Column) -> Column:
    """Length of the part of an edge within a convex polygon, its corners given counterclockwise."""
    dx, dy = x2 - x1, y2 - y1
    turned = F.concat(F.slice(corners, F.lit(2), F.size(corners) - 1), F.slice(corners, 1, 1))
    sides = F.zip_with(corners, turned, lambda a, b: F.struct(((b["x"] - a["x"]) * (y1 - a["y"]) - (b["y"] - a["y"]) * (x1 - a["x"])).alias("at"), ((b["x"] - a["x"]) * dy - (b["y"] - a["y"]) * dx).alias("slope")))
    start = F.array_max(F.transform(sides, lambda s: F.when(s["slope"] > 0, -s["at"] / s["slope"]).when((s["slope"] == 0) & (s["at"] < 0), 2.0).otherwise(0.0)))
    end = F.array_min(F.transform(sides, lambda s: F.when(s["slope"] < 0, -s["at"] / s["slope"]).otherwise(1.0)))
    return F.greatest(F.least(end, F.lit(1.0)) - F.greatest(start, F.lit(0.0)), F.lit(0.0)) * F.sqrt(dx * dx + dy * dy)
