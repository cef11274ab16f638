"""Planar polygons as nested arrays, by native expressions.

A ring is ``array<struct<x:double,y:double>>`` without a closing point; a polygon is
``struct<exterior:ring,holes:array<ring>>``; a geometry is an array of polygons.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"
POLYGON = f"struct<exterior:{RING},holes:array<{RING}>>"


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(*points) -> Column:
    return F.array(*[point(x, y) for x, y in points])


def neighbours(pts: Column, f) -> Column:
    """``f(previous, this, next)`` for each vertex, cyclically."""
    n = F.size(pts)
    at = lambda i: F.element_at(pts, (F.pmod(i, n) + 1).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: f(at(i - 1), at(i), at(i + 1)))).otherwise(F.slice(F.transform(pts, lambda p: f(p, p, p)), 1, 0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def signed_area(pts: Column) -> Column:
    return total(neighbours(pts, lambda _, p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def ring_area(pts: Column) -> Column:
    return F.abs(signed_area(pts))


def perimeter(pts: Column) -> Column:
    return total(neighbours(pts, lambda _, p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])))


def centroid(pts: Column) -> Column:
    a = signed_area(pts)
    part = lambda k: total(neighbours(pts, lambda _, p, q: (p[k] + q[k]) * (p["x"] * q["y"] - q["x"] * p["y"])))
    mean = lambda k: F.aggregate(pts, F.lit(0.0), lambda s, p: s + p[k]) / F.size(pts)
    return F.struct(F.coalesce(F.try_divide(part("x"), 6 * a), mean("x")).alias("x"), F.coalesce(F.try_divide(part("y"), 6 * a), mean("y")).alias("y"))


def polygon_area(poly: Column) -> Column:
    return ring_area(poly["exterior"]) - total(F.transform(poly["holes"], ring_area))


def polygon_perimeter(poly: Column) -> Column:
    return perimeter(poly["exterior"]) + total(F.transform(poly["holes"], perimeter))


def parts(geom: Column, least: float = 0.0) -> Column:
    """Polygons of more than ``least`` area."""
    return F.filter(geom, lambda p: polygon_area(p) > least)


def compactness(area: Column, length: Column) -> Column:
    """Isoperimetric ratio; zero for no perimeter."""
    return F.coalesce(F.try_divide(4 * F.pi() * area, length * length), F.lit(0.0))


def aspect_ratio(short: Column, long: Column) -> Column:
    return F.when(short <= 1e-9, F.lit(float("inf"))).otherwise(long / short)


def vertex_count(geom: Column) -> Column:
    return F.aggregate(geom, F.lit(0), lambda a, p: a + F.size(p["exterior"]))


def hole_count(geom: Column) -> Column:
    return F.aggregate(geom, F.lit(0), lambda a, p: a + F.size(p["holes"]))


def edges(pts: Column) -> Column:
    """Array of (edge, x1, y1, x2, y2, length)."""
    n = F.size(pts)
    at = lambda i: F.element_at(pts, (F.pmod(i, n) + 1).cast("int"))

    def one(i):
        p, q = at(i), at(i + 1)
        return F.struct(i.cast("int").alias("edge"), p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"), F.hypot(q["x"] - p["x"], q["y"] - p["y"]).alias("length"))

    return F.transform(F.sequence(F.lit(0), n - 1), one)


def trim_segment(e: Column, by: float) -> Column:
    """The segment without ``by`` at both ends; null where nothing is left."""
    t = by / e["length"]
    cut = lambda a, b, k: a + (b - a) * k
    x1, x2 = cut(e["x1"], e["x2"], t), cut(e["x1"], e["x2"], 1 - t)
    y1, y2 = cut(e["y1"], e["y2"], t), cut(e["y1"], e["y2"], 1 - t)
    return F.when(e["length"] > 2 * by, F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), (e["length"] - 2 * by).alias("length")))


def sample_points(e: Column, step: float) -> Column:
    """Evenly spaced points of a segment, both ends included."""
    n = F.greatest(F.lit(1), F.ceil(e["length"] / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((e["x1"] + (e["x2"] - e["x1"]) * i / n).alias("x"), (e["y1"] + (e["y2"] - e["y1"]) * i / n).alias("y")))


def turns(pts: Column) -> Column:
    """Cross product at each vertex; positive is a left turn."""
    return neighbours(pts, lambda o, p, q: (p["x"] - o["x"]) * (q["y"] - p["y"]) - (p["y"] - o["y"]) * (q["x"] - p["x"]))


def is_convex(pts: Column, tolerance: float = 1e-9) -> Column:
    t = turns(pts)
    return F.forall(t, lambda v: v >= -tolerance) | F.forall(t, lambda v: v <= tolerance)


def reflex_count(pts: Column) -> Column:
    sign = F.signum(signed_area(pts))
    return F.size(F.filter(turns(pts), lambda v: v * sign < -1e-9))


def facing_score(e: Column, target: Column, counter_clockwise: Column) -> Column:
    """How far an edge's outward normal looks at a target point, -1 to 1."""
    mx, my = (e["x1"] + e["x2"]) / 2, (e["y1"] + e["y2"]) / 2
    sign = F.when(counter_clockwise, 1.0).otherwise(-1.0)
    nx, ny = sign * (e["y2"] - e["y1"]), sign * -(e["x2"] - e["x1"])
    dx, dy = target["x"] - mx, target["y"] - my
    return F.coalesce(F.try_divide(nx * dx + ny * dy, F.hypot(nx, ny) * F.hypot(dx, dy)), F.lit(0.0))


def bounds(pts: Column) -> Column:
    low, high = (lambda k: F.array_min(F.transform(pts, lambda p: p[k]))), (lambda k: F.array_max(F.transform(pts, lambda p: p[k])))
    return F.struct(low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))


def shift(pts: Column, dx: Column, dy: Column) -> Column:
    return F.transform(pts, lambda p: F.struct((p["x"] - dx).alias("x"), (p["y"] - dy).alias("y")))


def to_local(pts: Column, frame: Column | None = None) -> Column:
    """A ring with the middle of its own (or another's) bounds as origin."""
    b = bounds(pts if frame is None else frame)
    return shift(pts, (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2)


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def svg_path(pts: Column) -> Column:
    """Path data with up to two decimals."""
    short = lambda v: F.regexp_replace(F.format_string("%.2f", v), r"\.?0+$", "")
    return F.concat(F.lit("M "), F.array_join(F.transform(pts, lambda p: F.concat_ws(" ", short(p["x"]), short(p["y"]))), " L "), F.lit(" Z"))
