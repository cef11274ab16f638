"""Zones of buildings: decomposition, quality, fallback, connectivity."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import geometry as g
from ..session import ship
from . import kernels as k
from . import overlay as o
from . import perimeter, regularise

#: Limits of zone shapes in metres and ratios (fixed values).
HARD_WIDTH, HARD_ASPECT, HARD_COMPACT = 1.0, 8.0, 0.25
AWKWARD_WIDTH, AWKWARD_ASPECT, AWKWARD_COMPACT = 2.0, 6.0, 0.35


def decompose(df: DataFrame, ring: str) -> DataFrame:
    """Adds ``zones`` (convex rings), ``zone_area`` and ``convex``."""

    def one(value):
        pieces = k.convex_pieces(k.points(value)) if value and len(value) > 2 else []
        return {"zones": [k.structs(p) for p in pieces], "zone_area": sum(abs(k.area(p)) for p in pieces), "convex": all(map(k.is_convex, pieces))}

    return k.ring_pass(df, [ring], one, f"zones array<{g.RING}>, zone_area double, convex boolean")


def perimeter_core(df: DataFrame, polygon: str, depth: float = perimeter.DEPTH) -> DataFrame:
    """Adds ``zones_core``, ``zones_perimeter``, ``how`` the core came about and the subdivision's ``reason``.

    ``polygon`` is a ring, or a struct of exterior and holes.
    """

    def one(value):
        made = perimeter.zones(outline(value), depth) if value else {"core": [], "perimeter": [], "how": "input_too_small", "reason": "no_perimeter_geom"}
        return {"zones_core": [k.structs(p) for p in made["core"]], "zones_perimeter": [k.structs(p) for p in made["perimeter"]], "how": made["how"], "reason": made["reason"]}

    return k.ring_pass(df, [polygon], one, f"zones_core array<{g.RING}>, zones_perimeter array<{g.RING}>, how string, reason string")


def outline(value) -> o.Polygon:
    """A polygon from a column's ring or struct of exterior and holes."""
    if isinstance(value, dict):
        return k.points(value["exterior"]), [k.points(h) for h in value["holes"] or []]
    return k.points(value), []


def split_holes(df: DataFrame, polygon: str) -> DataFrame:
    """Adds ``pieces``: rings that cover a polygon without its holes, cut along the holes' own walls."""

    def one(p):
        return {"pieces": [k.structs(ext) for ext, _ in o.without_holes(outline(p))] if p else []}

    return k.ring_pass(df, [polygon], one, f"pieces array<{g.RING}>")


def valid_parts(df: DataFrame, ring: str, least: float = 1e-6) -> DataFrame:
    """Adds ``parts``: all polygons that a ring encloses, also where it crosses itself."""

    def one(value):
        return {"parts": [{"exterior": k.structs(e), "holes": [k.structs(h) for h in hs]} for e, hs in o.made_valid(k.points(value), least)]}

    return k.ring_pass(df, [ring], one, f"parts array<{g.POLYGON}>")


def dissolve(df: DataFrame, rings: str, gap: float = 0.1, least: float = 1.0) -> DataFrame:
    """Adds ``dissolved``: one region of an array of rings, hairline gaps closed, small parts left out."""

    def one(value):
        region = o.dissolve([(k.points(r), []) for r in value or [] if r], gap, least)
        return {"dissolved": [{"exterior": k.structs(e), "holes": [k.structs(h) for h in hs]} for e, hs in region]}

    return k.ring_pass(df, [rings], one, f"dissolved array<{g.POLYGON}>")


def normalise(df: DataFrame, ring: str) -> DataFrame:
    """Adds ``normal``: the simplified ring (of a ring that crosses itself its largest part), and ``aligned``: its walls on common lines, with ``turned``."""

    def one(value):
        r = k.points(value)
        if len(r) > 2 and k.crosses_itself(r):
            r = max((p[0] for p in o.made_valid(r)), key=lambda x: abs(k.area(x)), default=r)
        r = k.normalise(r) if len(r) > 2 else r
        a, turned = regularise.aligned(r) if len(r) > 2 else (r, False)
        return {"normal": k.structs(r), "aligned": k.structs(a), "turned": turned}

    return k.ring_pass(df, [ring], one, f"normal {g.RING}, aligned {g.RING}, turned boolean")


def fit_neighbours(df: DataFrame, ring: str, neighbours: str) -> DataFrame:
    """Adds ``fitted``: each neighbour on the building's wall lines, moved onto shared walls, and without overlap."""

    def one(main, others):
        main, out = k.counter_clockwise(k.points(main)), []
        for value in others or []:
            r = regularise.aligned(k.points(value), main)[0]
            out.append(k.structs(regularise.without_overlap(regularise.on_shared_walls(r, main), main)))
        return {"fitted": out}

    return k.ring_pass(df, [ring, neighbours], one, f"fitted array<{g.RING}>")


def rectangle(df: DataFrame, ring: str) -> DataFrame:
    """Adds ``short`` and ``long`` sides of the least rectangle; zeros for no ring. Whole batches at a time."""
    ship(df.sparkSession)
    at = df.columns.index(ring)
    out = StructType([*df.schema.fields, StructField("short", DoubleType()), StructField("long", DoubleType())])

    def run(batches):
        for batch in batches:
            short, long = k.rectangles(*k.ring_arrays(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(short), pa.array(long)], names=out.names)

    return df.mapInArrow(run, out)


def connectivity(df: DataFrame, zones: str) -> DataFrame:
    """Adds ``zone_groups`` (a number for each zone) and ``n_groups``; buildings of one group survive."""

    def one(value):
        groups = k.zone_groups([k.points(z) for z in value or []])
        return {"zone_groups": groups, "n_groups": len(set(groups))}

    return k.ring_pass(df, [zones], one, "zone_groups array<int>, n_groups int")


def shape_flags(width, aspect, compact) -> tuple[F.Column, F.Column]:
    """(hard failure, awkward): narrow and long or ragged; or merely narrow, long or ragged."""
    hard = (width < HARD_WIDTH) & ((aspect > HARD_ASPECT) | (compact < HARD_COMPACT))
    return hard, hard | (width < AWKWARD_WIDTH) | (aspect > AWKWARD_ASPECT) | (compact < AWKWARD_COMPACT)


def quality(zones: DataFrame, key: str, area: str, width: str, aspect: str, compact: str) -> DataFrame:
    """One row a building over its zones, with the failure counts and the score (higher is better)."""
    hard, awkward = shape_flags(F.col(width), F.col(aspect), F.col(compact))
    out = zones.groupBy(key).agg(
        F.count("*").alias("zone_count"),
        F.min(area).alias("zone_area_min"),
        F.min(width).alias("zone_width_min"),
        F.max(aspect).alias("zone_aspect_max"),
        F.min(compact).alias("zone_compactness_min"),
        F.count_if(hard).alias("n_hard"),
        F.count_if(awkward).alias("n_awkward"),
    )
    return out.withColumn("hard_fail", F.col("n_hard") > 0)


def score() -> F.Column:
    """Order of zonings, best last: counts of bad zones first, then of zones, then the worst shapes."""
    low = F.lit(float("-inf"))
    return F.struct(
        (-F.col("n_hard")).alias("a"),
        (-F.col("n_awkward")).alias("b"),
        (-F.col("zone_count")).alias("c"),
        F.coalesce("zone_width_min", low).alias("d"),
        F.coalesce("zone_compactness_min", low).alias("e"),
        F.coalesce(-F.col("zone_aspect_max"), low).alias("f"),
        F.coalesce("zone_area_min", low).alias("g"),
    )


def choose_fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, chosen): the second zoning only where the first fails and the second scores strictly better."""
    a, b = first.select(key, "hard_fail", score().alias("s1")), second.select(key, score().alias("s2"))
    better = F.col("hard_fail") & (F.col("s2") > F.col("s1"))
    return a.join(b, key, "left").select(key, F.when(better, "second").otherwise("first").alias("chosen"))


def longest_share(edges: DataFrame, group: str, length: str, order: list, share: float) -> DataFrame:
    """The longest edges of each group, floor(share * edges) of them."""
    w = Window.partitionBy(group)
    ranked = edges.withColumns({"__n": F.count("*").over(w), "place": F.row_number().over(w.orderBy(F.desc(length), *order))})
    return ranked.filter(F.col("place") <= F.floor(F.lit(share) * F.col("__n"))).drop("__n")


def touch_type(clear_mid, clear_any, distance, gap: float, at_corner) -> F.Column:
    """How a wall segment touches its neighbours."""
    return F.when(distance > gap, "none").when(at_corner, "corner_only").when(clear_mid & clear_any, "interior_clear").when(clear_mid, "mid_clear").otherwise("partial_clear")
