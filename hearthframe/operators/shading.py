"""Neighbours as shades: facing edges, rays, visibility, and windows on walls that look out.

Distance and sight distribute over a union (a minimum, an any), so they need no dissolved
neighbourhood; ``zones.dissolve`` makes one. Kernels run inside a row: a building with its own neighbours.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import kernels as k
from . import overlay

EDGE = "struct<edge:int,x1:double,y1:double,x2:double,y2:double,length:double>"


def gather_neighbours(buildings: DataFrame, neighbours: DataFrame, key: str, ring: str, other: str) -> DataFrame:
    """Buildings with ``neighbours``: the rings around each, in order of their id (a bounded few, by radius). Both sides may be long: nothing is broadcast."""
    rings = neighbours.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(other, F.col(ring).alias("r")))), lambda x: x["r"]).alias("neighbours"))
    return buildings.join(rings.hint("merge"), key, "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast(f"array<{g.RING}>")))


def nearby(buildings: DataFrame, candidates: DataFrame, key: str, other: str, ring: str, radius: float = 20.0, overlap: float = 0.5) -> DataFrame:
    """(key, other, ring of the other): footprints with a vertex within ``radius`` of a vertex of the building.

    Footprints meet in grid cells as wide as the radius, each cell once a footprint; the vertices of those that
    met are compared. A candidate that overlaps the building by more than ``overlap`` square metres is the same
    one drawn twice and leaves; of equal outlines the least id stays. Both sides may be long: nothing is broadcast.
    """
    cell = lambda c: F.floor(c / radius).cast("long")
    at = lambda p, i, j: F.struct((cell(p["x"]) + i).alias("i"), (cell(p["y"]) + j).alias("j"))
    near = F.array_distinct(F.flatten(F.transform(ring, lambda p: F.array(*[at(p, i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]))))
    own = buildings.select(key, F.explode(near).alias("c")).select(key, "c.i", "c.j")
    there = candidates.select(F.col(other).alias("__other"), F.explode(F.array_distinct(F.transform(ring, lambda q: at(q, 0, 0)))).alias("c")).select("__other", "c.i", "c.j")
    pairs = own.join(there.hint("merge"), ["i", "j"]).select(key, "__other").distinct()
    rings = candidates.select(F.col(other).alias("__other"), F.col(ring).alias("__ring"))
    both = pairs.join(buildings.select(key, ring).hint("merge"), key).join(rings.hint("merge"), "__other")
    both = both.filter((F.col(ring) != F.col("__ring")) | (g.ring_area(F.col(ring)) <= overlap))  # the same outline overlaps by all of it
    both = both.filter(F.exists(ring, lambda p: F.exists("__ring", lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]) <= radius)))

    def common(one, two):
        return {"__common": overlay.size(overlay.intersection([(k.points(one), [])], [(k.points(two), [])]))}

    apart = k.ring_pass(both, [ring, "__ring"], common, "__common double").filter(F.col("__common") <= overlap)
    return apart.groupBy(key, "__ring").agg(F.min("__other").alias(other)).select(key, other, F.col("__ring").alias("neighbour"))


def shading_edges(df: DataFrame, key: str, ring: str, gap: float = 0.2) -> DataFrame:
    """(key, neighbour, edge, facing_score, distance): edges of neighbours that face the building, or touch it.

    The score is the native ``facing_score`` towards the building's centroid; the distance is
    from the edge to the building.
    """

    def distances(own, others):
        own, found = k.points(own), []
        for o in others or []:
            r = k.points(o)
            found.append([min(min(k.point_segment(p, a, b) for p in own), min(k.point_segment(q, c, d) for q in (a, b) for c, d in zip(own, own[1:] + own[:1]))) for a, b in zip(r, r[1:] + r[:1])])
        return {"__d": found}

    out = k.ring_pass(df.select(key, ring, "neighbours"), [ring, "neighbours"], distances, "__d array<array<double>>")
    out = out.withColumn("__c", g.centroid(F.col(ring))).select(key, "__c", F.posexplode(F.arrays_zip("neighbours", "__d")).alias("neighbour", "z"))
    out = out.withColumn("__ccw", g.signed_area(F.col("z.neighbours")) > 0)
    out = out.select(key, "__c", "__ccw", "neighbour", F.explode(F.arrays_zip(g.edges(F.col("z.neighbours")).alias("e"), F.col("z.__d").alias("d"))).alias("p"))
    out = out.select(key, "neighbour", F.col("p.e").alias("e"), g.facing_score(F.col("p.e"), F.col("__c"), F.col("__ccw")).alias("facing_score"), F.col("p.d").alias("distance"))
    return out.filter((F.col("facing_score") > 0) | (F.col("distance") <= gap))


def rays(df: DataFrame, edges: str, ring: str, step: float = 2.0) -> DataFrame:
    """(other columns, edge, point, x1, y1, x2, y2): from evenly spaced points of each edge to the nearest point of the ring."""
    others = [c for c in df.columns if c not in (edges, ring)]
    pts = df.select(*others, ring, F.posexplode(edges).alias("edge", "e")).select(*others, ring, "edge", F.posexplode(g.sample_points(F.col("e"), step)).alias("point", "p"))

    def foot(e):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        t = F.coalesce(F.try_divide((F.col("p.x") - e["x1"]) * dx + (F.col("p.y") - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        x, y = e["x1"] + t * dx, e["y1"] + t * dy
        return F.struct(F.hypot(x - F.col("p.x"), y - F.col("p.y")).alias("d"), x.alias("x"), y.alias("y"))

    near = F.array_min(F.transform(g.edges(F.col(ring)), foot))
    return pts.withColumn("__n", near).select(*others, "edge", "point", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("__n.x").alias("x2"), F.col("__n.y").alias("y2"))


def visible_edges(rays_: DataFrame, masks: DataFrame, key: str, edge: list[str], trim: float = 0.05) -> DataFrame:
    """Edges kept: those with a clear ray, and those of buildings without masks.

    ``masks``: one row a building with ``masks``, an array of rings. Rays too short to trim are clear. A building's
    rays meet its masks as one array, so the masks are copied once a building and not once a ray. Both sides may
    be long: neither is broadcast.
    """
    ray = F.struct(*edge, "x1", "y1", "x2", "y2")
    lines = rays_.groupBy(key).agg(F.collect_list(ray).alias("__rays"))
    joined = lines.join(masks.select(key, "masks").hint("merge"), key, "left")

    def sight(rays, rings):
        rings = [k.points(r) for r in rings or []]
        return {"__clear": [not k.blocked((r["x1"], r["y1"]), (r["x2"], r["y2"]), rings, trim) for r in rays]}

    seen = k.ring_pass(joined, ["__rays", "masks"], sight, "__clear array<boolean>")
    each = seen.select(key, F.explode(F.arrays_zip("__rays", "__clear")).alias("z")).select(key, *[F.col(f"z.__rays.{e}").alias(e) for e in edge], F.col("z.__clear").alias("__c"))
    return each.groupBy(key, *edge).agg(F.bool_or("__c").alias("keep")).filter("keep").drop("keep")


def window_candidates(df: DataFrame, key: str, ring: str, gap: float = 0.5) -> DataFrame:
    """(key, edge, length, distance, touch) of a building's walls against its neighbours."""

    def measure(own, others):
        own, others = k.points(own), [k.points(o) for o in others or []]
        out = []
        for a, b in zip(own, own[1:] + own[:1]):
            size = math.dist(a, b)
            at = lambda t, a=a, b=b: (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)
            near = [[min(k.point_segment(at(t), c, d) for c, d in zip(r, r[1:] + r[:1])) for r in others] for t in (0.0, 0.25, 0.5, 0.75, 1.0)]
            low = [min(d, default=math.inf) for d in near]
            out.append({"edge": len(out), "length": size, "distance": min(low) if others else None, "mid_clear": low[2] > gap, "any_clear": low[1] > gap and low[3] > gap, "corner": min(low[1:4]) > gap >= min(low[0], low[4])})
        return {"__m": out}

    kind = "array<struct<edge:int,length:double,distance:double,mid_clear:boolean,any_clear:boolean,corner:boolean>>"
    from .zones import touch_type

    out = k.ring_pass(df.select(key, ring, "neighbours"), [ring, "neighbours"], measure, f"__m {kind}").select(key, F.explode("__m").alias("m")).select(key, "m.*")
    touch = touch_type(F.col("mid_clear"), F.col("any_clear"), F.coalesce("distance", F.lit(float("inf"))), gap, F.col("corner"))
    return out.withColumn("touch", touch).select(key, "edge", "length", "distance", "touch")


def select_windows(candidates: DataFrame, key: str, share: float = 0.6, shortest: float = 1.0) -> DataFrame:
    """The longest usable walls of each building: those without contact or clear in the middle, floor(share * usable)."""
    from .zones import longest_share

    usable = candidates.filter(F.col("touch").isin("none", "corner_only", "mid_clear", "interior_clear") & (F.col("length") >= shortest))
    return longest_share(usable, key, "length", ["edge"], share)


def walls_of_windows(windows: DataFrame, walls: DataFrame, key: str, angle: float = 5.0, apart: float = 0.1, overlap: float = 0.5) -> DataFrame:
    """Walls (columns of ``walls``) that lie along some window edge of their building: a semi-join.

    Both sides have ``e`` edge structs. The window must run parallel, close by, and over at
    least ``overlap`` metres of the wall.
    """
    w, v = F.col("e"), F.col("__w")
    direction = lambda e: F.degrees(F.atan2(e["y2"] - e["y1"], e["x2"] - e["x1"]))
    turned = F.pmod(direction(w) - direction(v), F.lit(180.0))
    ux, uy = (w["x2"] - w["x1"]) / w["length"], (w["y2"] - w["y1"]) / w["length"]
    along = lambda x, y: (x - w["x1"]) * ux + (y - w["y1"]) * uy
    a, b = along(v["x1"], v["y1"]), along(v["x2"], v["y2"])
    off = F.abs((v["x1"] - w["x1"]) * -uy + (v["y1"] - w["y1"]) * ux)
    common = F.least(F.greatest(a, b), w["length"]) - F.greatest(F.least(a, b), F.lit(0.0))
    right = windows.select(F.col(key).alias("__key"), F.col("e").alias("__w"))
    near = (F.least(turned, 180 - turned) <= angle) & (off <= apart) & (common >= overlap)
    return walls.filter("e.length > 0").join(right, (F.col(key) == F.col("__key")) & near, "left_semi")


def contact_runs(touching: F.Column) -> F.Column:
    """Number of maximal runs of true values around a ring; all true is one run."""
    n = F.size(touching)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(touching, i + 1) & ~F.element_at(touching, (F.pmod(i - 1, n) + 1).cast("int")))
    return F.when(n == 0, F.lit(0)).when(F.forall(touching, lambda x: x), F.lit(1)).otherwise(F.size(starts))


#: Limits of footprints (fixed values): sliver width and aspect, holes, vertices, areas in square metres.
LIMITS = {"width": 2.0, "aspect": 12.0, "holes": 2, "vertices": 60, "least": 20.0, "most": 20_000.0}


def filter_footprints(df: DataFrame, key: str, polygons: str, order: list, limits: dict | None = None) -> DataFrame:
    """Usable footprints: one row an id, one polygon, no sliver, few holes and vertices, area in bounds.

    Adds ``area``, ``n_holes``, ``n_vertices``, ``short``, ``long``. A missing width keeps the row.
    """
    from .incremental import keep_one
    from .zones import rectangle

    lim = LIMITS | (limits or {})
    one = keep_one(df, [key], order).withColumn("__p", g.parts(F.col(polygons))).filter(F.size("__p") == 1)
    one = one.withColumns({"__ring": F.col("__p")[0]["exterior"], "area": g.polygon_area(F.col("__p")[0]), "n_holes": g.hole_count(F.col("__p")), "n_vertices": g.vertex_count(F.col("__p"))})
    one = one.filter((F.col("n_holes") <= lim["holes"]) & (F.col("n_vertices") <= lim["vertices"]) & F.col("area").between(lim["least"], lim["most"]))
    out = rectangle(one, "__ring")
    hard, _ = linear_artifact(F.col("short"), F.col("long"), lim["width"], lim["aspect"])
    return out.filter(~F.coalesce(hard, F.lit(False))).drop("__p", "__ring")


def linear_artifact(short, long, width: float = 2.0, aspect: float = 12.0) -> tuple[F.Column, F.Column]:
    """(hard, review): narrow and long; or nearly so (one and a half times the width, two thirds of the aspect) and not hard."""
    ratio = g.aspect_ratio(short, long)
    hard = (short < width) & (ratio > aspect)
    return hard, (short < 1.5 * width) & (ratio > aspect * 2 / 3) & ~hard


def first_geometry(df: DataFrame, names: list[str]) -> F.Column:
    """The first of the named columns that exists and is not null."""
    return F.coalesce(*[F.col(n) for n in names if n in df.columns])


def decomposition_input(seeds, perimeter, whole) -> F.Column:
    """Which geometry a decomposition starts from: seeds, else perimeter parts, else the whole."""
    return F.when(F.size(F.coalesce(seeds, F.array())) > 0, "seeds").when(F.size(F.coalesce(perimeter, F.array())) > 0, "perimeter").when(whole.isNotNull(), "whole")


def has_full_hvac(zones, systems, thermostats) -> F.Column:
    """Whether every zone has a system and a thermostat."""
    return (zones > 0) & (systems >= zones) & (thermostats >= zones)
