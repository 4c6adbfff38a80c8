"""Queries on geometries of any shape, held against areas and lengths in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.geometry import length
from quillmere.operators import linkage, polygons, shapes
from quillmere.plans.registry import Tables, query
from quillmere.plans.wider import LINES, lines
from quillmere.sources import geoparquet
from quillmere.sources.sinks import scratch


def ring(*corners: tuple) -> Column:
    one = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.array(*[F.struct(one(x).alias("x"), one(y).alias("y")) for x, y in corners])


def angles(t: Tables) -> DataFrame:
    """An L with a hole for each nation: the square [a, a + 210]**2 without its upper right quarter and without [a + 20, a + 60]**2."""
    k = F.col("n_nationkey")
    a, b = k % 5 * 210, F.floor(k / 5) * 210
    outer = ring((a, b), (a + 210, b), (a + 210, b + 105), (a + 105, b + 105), (a + 105, b + 210), (a, b + 210))
    hole = ring((a + 20, b + 20), (a + 60, b + 20), (a + 60, b + 60), (a + 20, b + 60), (a + 20, b + 20))
    return t("nation").select(k.alias("polygon"), F.array(F.array(outer, hole)).alias("parts"))


def _clip(xa: str, ya: str, xb: str, yb: str) -> str:
    return f"greatest(0, least(1, ({xb} - x1) / (x2 - x1), ({yb} - y1) / (y2 - y1)) - greatest(0, ({xa} - x1) / (x2 - x1), ({ya} - y1) / (y2 - y1)))"


ANGLES = f"""{LINES}, sq as (select n_nationkey as polygon, 210.0 * (n_nationkey % 5) as a, 210.0 * (n_nationkey // 5) as b from nation),
u as (select line, polygon, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) as len, {_clip('a', 'b', 'a + 210', 'b + 210')} - {_clip('a + 105', 'b + 105', 'a + 210', 'b + 210')} - {_clip('a + 20', 'b + 20', 'a + 60', 'b + 60')} as part from ln, sq),
o as (select line, polygon, len, round(part * len, 6) as overlap from u where part * len > 1e-6), m as (select line, max(overlap) as overlap, arg_min(polygon, (-overlap, polygon)) as polygon, count(*) as n_candidates from o group by 1),
k as (select m.line, count(*) as c from m join o on o.line = m.line and o.overlap >= m.overlap - 0.1 group by 1), r as (select ln.line, m.polygon, overlap, overlap / sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) as fraction, coalesce(n_candidates, 0) as n_candidates, coalesce(c, 0) > 1 as tied from ln left join m using (line) left join k using (line))
select line, polygon, overlap, round(fraction, 6) as fraction, n_candidates, tied::int as ambiguous, case when polygon is null then 'unmatched' when fraction < LEAST then 'low_overlap' when tied then 'review_required' else 'accepted' end as status from r"""


def angled(t: Tables, least: float) -> DataFrame:
    edges = lines(t)
    whole = edges.select("line", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("length"))
    pairs = polygons.overlaps(edges, angles(t), "line", "polygon", 100.0, 1e-6).withColumn("overlap", F.round("overlap", 6))
    return polygons.linked(pairs, whole, "line", "polygon", least).withColumn("fraction", F.round("fraction", 6))


@query("c12_concave_overlap", f"with {ANGLES.replace('LEAST', '0.1')}")
def concave_overlap(t: Tables) -> DataFrame:
    return angled(t, 0.1)


@query("c13_any_overlap", f"with {ANGLES.replace('LEAST', '0.0')}")
def any_overlap(t: Tables) -> DataFrame:
    return angled(t, 0.0)


@query("c11_linked_records", """with ln as (select s_suppkey as line, 40.0 * (s_suppkey // 2) + 6 * (s_suppkey % 2) as ly from supplier), r as (select o_orderkey as record, case when o_orderkey % 4 = 0 then 1 + o_orderkey % 2000 end as source, o_orderkey % 7 <> 0 as here, (o_orderkey % 70)::double as u, o_orderkey % 70 + case when o_orderkey % 5 = 0 then 0.0 else 25.0 end as v, 40.0 * (o_orderkey % 50) + o_orderkey % 11 - 2 as y from orders),
d as (select record, source as line from r where source in (select line from ln)), c as (select record, line, abs(y - ly) as h, least(100, v + sqrt(25 - (y - ly) ** 2)) - greatest(0, u - sqrt(25 - (y - ly) ** 2)) as near from r join ln on abs(y - ly) <= 5 where here and record not in (select record from d)),
g as (select * from c where near >= 5), m as (select record, max(near) as most, count(*) as n from g group by 1), k as (select record, n, count(*) as ties, arg_min(line, (-near, line)) as line, arg_min(h, (-near, line)) as h from g join m using (record) where near >= most - 1 group by 1, 2)
select r.record, coalesce(d.line, k.line) as line, case when d.line is not null then 'direct_id' when k.line is null then 'unmatched' else 'spatial_fallback' end as method, case when d.line is not null then 'direct_id' when k.line is null then 'unmatched' when ties > 1 then 'ambiguous' else 'spatial_fallback' end as status,
 case when d.line is not null then 0.0 when ties = 1 then h end::double as distance, (d.line is null and coalesce(ties, 0) > 1)::int as ambiguous, coalesce(k.n, 0) as n_candidates from r left join d using (record) left join k using (record)""")
def linked_records(t: Tables) -> DataFrame:
    s, o = F.col("s_suppkey"), F.col("o_orderkey")
    y = (F.floor(s / 2) * 40 + s % 2 * 6).cast("double")
    halves = F.array(*[F.struct(F.lit(i).alias("edge"), F.lit(a).alias("x1"), y.alias("y1"), F.lit(b).alias("x2"), y.alias("y2")) for i, (a, b) in enumerate(((0.0, 60.0), (60.0, 100.0)))])
    roads = t("supplier").select(s.alias("line"), F.inline(halves))
    orders = t("orders").select(o.alias("record"), F.when(o % 4 == 0, 1 + o % 2000).alias("source"), (o % 70).cast("double").alias("x1"), (o % 70 + F.when(o % 5 == 0, 0.0).otherwise(25.0)).alias("x2"), (o % 50 * 40 + o % 11 - 2).cast("double").alias("y1"))
    edges = orders.filter("record % 7 <> 0").select("record", "x1", "y1", "x2", F.col("y1").alias("y2"))
    return linkage.linked_records(orders.select("record", "source"), edges, roads, "record", "source", "line", size=20.0).withColumn("distance", F.round("distance", 6))


@query("c22_overlap_areas", """with p as (select s_suppkey as id, s_suppkey * 53 % 400 + 400.0 * (s_suppkey // 800) as x, (s_suppkey * 71 % 400)::double as y, 15.0 + s_suppkey % 7 as w from supplier),
q as (select id, unnest([{'s': 1, 'xa': x, 'ya': y, 'xb': x + 2 * w, 'yb': y + w}, {'s': 1, 'xa': x, 'ya': y + w, 'xb': x + w, 'yb': y + 2 * w}, {'s': -1, 'xa': x + 3, 'ya': y + 3, 'xb': x + 8, 'yb': y + 8}]) as r from p)
select a.id as a, b.id as b, round(sum(a.r.s * b.r.s * greatest(0, least(a.r.xb, b.r.xb) - greatest(a.r.xa, b.r.xa)) * greatest(0, least(a.r.yb, b.r.yb) - greatest(a.r.ya, b.r.ya))), 4) as area from q a join q b on a.id < b.id group by 1, 2 having sum(a.r.s * b.r.s * greatest(0, least(a.r.xb, b.r.xb) - greatest(a.r.xa, b.r.xa)) * greatest(0, least(a.r.yb, b.r.yb) - greatest(a.r.ya, b.r.ya))) > 1e-3""")
def overlap_areas(t: Tables) -> DataFrame:
    s = F.col("s_suppkey")
    x, y, w = s * 53 % 400 + F.floor(s / 800) * 400, s * 71 % 400, 15 + s % 7
    outer = ring((x, y), (x, y + 2 * w), (x + w, y + 2 * w), (x + w, y + w), (x + 2 * w, y + w), (x + 2 * w, y))
    hole = ring((x + 3, y + 3), (x + 8, y + 3), (x + 8, y + 8), (x + 3, y + 8))
    return polygons.overlap_areas(t("supplier").select(s.alias("id"), F.array(F.array(outer, hole)).alias("parts")), "id", 20.0).withColumn("area", F.round("area", 4))


@query("d32_geometry_quality", """with g as (select c_custkey as c, c_custkey % 20 as k, 10.0 * (c_custkey % 1000) as x, 10.0 * (c_custkey // 1000) as y from customer), n as (select *, k > 1 as here from g)
select count(*) as n, count(*) filter (where k = 0) as n_null, count(*) filter (where k = 1) as n_empty, count(*) filter (where here and k <> 6) as n_polygon, count(*) filter (where k = 6) as n_multipolygon, count(*) filter (where k in (2, 3, 4, 7, 8)) as n_invalid, count(*) filter (where here and k not in (2, 3, 4, 7, 8)) as n_valid,
 count(*) filter (where k in (2, 4, 7)) as n_self_crossing, count(*) filter (where k = 3) as n_unclosed_rings, count(*) filter (where k = 7) as n_short_rings, count(*) filter (where k = 8) as n_odd_points, count(*) filter (where k in (2, 4, 7)) as n_zero_area, min(case when k = 5 then -10.0 when here then x end) as min_x, min(case when k = 5 then -10.0 when here then y end) as min_y,
 max(case when k = 5 then -6.0 when k = 6 then x + 9 when here then x + 4 end) as max_x, max(case when k = 5 then -6.0 when k in (4, 7) then y when here then y + 4 end) as max_y, greatest(count(*) filter (where k = 5) - 1, 0) as n_repeated, count(*) filter (where k = 5) - count(distinct c % 50) filter (where k = 5) as n_repeated_asset from n""")
def geometry_quality(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    x, y, k = c % 1000 * 10, F.floor(c / 1000) * 10, c % 20
    square = lambda a, b: ring((a, b), (a + 4, b), (a + 4, b + 4), (a, b + 4), (a, b))
    again = F.when(c % 3 == 0, square(-10, -10)).when(c % 3 == 1, ring((-6, -6), (-10, -6), (-10, -10), (-6, -10), (-6, -6))).otherwise(ring((-10, -6), (-6, -6), (-6, -10), (-10, -10), (-10, -6)))
    odd = {
        2: ring((x, y), (x + 4, y + 4), (x + 4, y), (x, y + 4), (x, y)), 3: ring((x, y), (x + 4, y), (x + 4, y + 4), (x, y + 4)), 4: ring((x, y), (x + 4, y), (x + 2, y), (x, y)),
        5: again, 7: ring((x, y), (x + 4, y), (x, y)), 8: ring((x, y), (float("nan"), y), (x + 4, y + 4), (x, y)),
    }
    parts = F.when(k == 6, F.array(F.array(square(x, y)), F.array(square(x + 5, y))))
    for i, shape in odd.items():
        parts = parts.when(k == i, F.array(F.array(shape)))
    parts = parts.when(k == 1, F.array().cast("array<array<array<struct<x: double, y: double>>>>")).when(k > 0, F.array(F.array(square(x, y))))
    rows = t("customer").select(c.alias("id"), (c % 50).alias("asset"), F.when(k == 6, "MultiPolygon").otherwise("Polygon").alias("kind"), parts.alias("parts"))
    return shapes.geometry_quality(rows, "id", "asset")


@query("h30_simplified_lines", """with s as (select s_suppkey as s, s_suppkey % 15 as e from supplier), l as (select s as line, s % 4 <> 0 and e <= 10 as cut, 2 * sqrt(100 + e * e) as length from s union all select s + 10000000, false, 50.0 from s where s % 4 = 0)
select line, case when line >= 10000000 or cut then 2 else 3 end::int as n_points, round(length, 6) as length, round(case when cut then length - 20 else 0 end, 6) as change from l""")
def simplified_lines(t: Tables) -> DataFrame:
    s = F.col("s_suppkey").cast("long")
    x, e = s * 100, s % 15
    roads = t("supplier").select(s.alias("line"), ring((x, 0), (x + 10, e), (x + 20, 0)).alias("points"))
    side = t("supplier").filter("s_suppkey % 4 = 0").select((s + 10_000_000).alias("line"), ring((x + 10, e), (x + 10, e + 50)).alias("points"))
    rows = roads.unionByName(side)
    less = shapes.simplified(rows, "line", 10.0).select("line", F.col("points").alias("less"))
    both = rows.join(less, "line")
    return both.select("line", F.size("less").alias("n_points"), F.round(length(F.col("points")), 6).alias("length"), F.round(length(F.col("points")) - length(F.col("less")), 6).alias("change"))


KINDS = """k as (select c_custkey as id, (array['Point', 'LineString', 'Polygon', 'MultiPoint', 'MultiLineString', 'MultiPolygon'])[(c_custkey % 7 + 1)::int] as kind, [1, 3, 10, 2, 4, 10][(c_custkey % 7 + 1)::int] as n_points, [0.0, 2.0, 5.0, 3.0, 4.0, 5.0][(c_custkey % 7 + 1)::int] as wide, (c_custkey % 1000)::double as x from customer)"""


def all_kinds(t: Tables) -> DataFrame:
    """A GeoJSON text for each customer, with one feature of each kind in turn, or without geometry."""
    c = F.col("c_custkey")
    x = (c % 1000).cast("double")
    p = lambda dx, dy: F.array(x + float(dx), F.lit(float(dy)))
    box = lambda a, n: F.array(p(a, 0), p(a + n, 0), p(a + n, n), p(a, n), p(a, 0))
    coordinates = [
        p(0, 1), F.array(p(0, 0), p(1, 1), p(2, 0)), F.array(box(0, 5), F.reverse(box(1, 2))), F.array(p(0, 0), p(3, 3)),
        F.array(F.array(p(0, 0), p(1, 1)), F.array(p(3, 0), p(4, 1))), F.array(F.array(box(0, 2)), F.array(box(3, 2))),
    ]
    text = F.lit("null")
    for i, (kind, at) in enumerate(zip(("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon"), coordinates, strict=True)):
        text = F.when(c % 7 == i, F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.to_json(at), F.lit("}"))).otherwise(text)
    return t("customer").select(F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":'), c.cast("string"), F.lit('},"geometry":'), text, F.lit("}]}")).alias("text"))


def extent(rows: DataFrame) -> DataFrame:
    points = F.flatten(F.flatten("parts"))
    xs = F.transform(points, lambda p: p["x"])
    return rows.select("id", "kind", F.size(points).alias("n_points"), F.array_min(xs).alias("x"), (F.array_max(xs) - F.array_min(xs)).alias("wide"))


EXTENT = f"with {KINDS} select id, kind, case when kind is null then null else n_points end::int as n_points, case when kind is null then null else x end as x, case when kind is null then null else wide end::double as wide from k"


@query("a02_all_geometry_kinds", EXTENT)
def all_geometry_kinds(t: Tables) -> DataFrame:
    return extent(geoparquet.geometries(all_kinds(t), "text", "id long"))


@query("a09_geoparquet", EXTENT)
def written_geoparquet(t: Tables) -> DataFrame:
    rows = geoparquet.geometries(all_kinds(t), "text", "id long")
    path = scratch(rows.sparkSession, "geoparquet")
    geoparquet.write_geoparquet(rows, path)
    return extent(geoparquet.read_geoparquet(rows.sparkSession, path))
