"""Models from zones: rooms, faces, windows, shades, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import geometry as g
from ..functions.text import as_json


def rooms(buildings: DataFrame, key: str, levels: str, height: str, zones: str) -> DataFrame:
    """One row a building, level, zone and part: ``room_id``, ``level``, ``zone``, ``part``, ``ring``, ``floor_z``, ``ceiling_z``, area and volume.

    ``zones`` is an array of rings, or of arrays of rings where zones have parts; only zones of several parts
    name them in the id (``<key>_z<i>[_p<j>]_L<l>``).
    """
    several = isinstance(buildings.schema[zones].dataType.elementType.elementType, ArrayType)
    parts = F.col(zones) if several else F.transform(zones, lambda r: F.array(r))
    out = buildings.select(key, height, F.explode(F.sequence(F.lit(0), F.col(levels) - 1)).alias("level"), parts.alias("__z")).filter(F.size("__z") > 0)
    out = out.select(key, height, "level", F.posexplode("__z").alias("zone", "__p")).select(key, height, "level", "zone", F.size("__p").alias("__n"), F.posexplode("__p").alias("part", "ring"))
    part = F.when(F.col("__n") > 1, F.concat(F.lit("_p"), F.col("part").cast("string"))).otherwise(F.lit(""))
    name = F.concat(F.col(key).cast("string"), F.lit("_z"), F.col("zone").cast("string"), part, F.lit("_L"), F.col("level").cast("string"))
    area = g.ring_area(F.col("ring"))
    return out.select(key, name.alias("room_id"), "level", "zone", "part", "ring", (F.col("level") * F.col(height)).alias("floor_z"), ((F.col("level") + 1) * F.col(height)).alias("ceiling_z"), area.alias("area"), (area * F.col(height)).alias("volume"))


def faces(room: DataFrame) -> DataFrame:
    """One row a face: floor, roof and a wall an edge, with its area and its ``boundary`` (x, y, z).

    Boundaries turn counter-clockwise seen from outside: floors look down, roofs up, walls away from the room.
    """
    turned = F.when(g.signed_area(F.col("ring")) >= 0, F.col("ring")).otherwise(F.reverse("ring"))
    base = room.withColumn("ring", turned)
    spot = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    level = lambda z: F.transform("ring", lambda p: spot(p["x"], p["y"], z.cast("double")))
    low, high = F.col("floor_z").cast("double"), F.col("ceiling_z").cast("double")
    walls = base.select("room_id", low.alias("lo"), high.alias("hi"), F.explode(g.edges(F.col("ring"))).alias("e"))
    corners = F.array(spot(F.col("e.x1"), F.col("e.y1"), F.col("lo")), spot(F.col("e.x2"), F.col("e.y2"), F.col("lo")), spot(F.col("e.x2"), F.col("e.y2"), F.col("hi")), spot(F.col("e.x1"), F.col("e.y1"), F.col("hi")))
    walls = walls.select("room_id", F.concat(F.lit("wall_"), F.col("e.edge").cast("string")).alias("face"), F.lit("wall").alias("kind"), (F.col("e.length") * (F.col("hi") - F.col("lo"))).alias("area"), corners.alias("boundary"))
    flat = F.array(F.struct(F.lit("floor").alias("face"), F.reverse(level(low)).alias("boundary")), F.struct(F.lit("roof").alias("face"), level(high).alias("boundary")))
    flat = base.select("room_id", "area", F.explode(flat).alias("f")).select("room_id", "f.face", F.col("f.face").alias("kind"), "area", "f.boundary")
    return walls.unionByName(flat)


def adjacent_floors(room: DataFrame, key: str) -> DataFrame:
    """(lower, upper) rooms of the same zone and part on neighbouring levels."""
    lower = room.select(key, "zone", "part", F.col("level"), F.col("room_id").alias("lower"))
    upper = room.select(key, "zone", "part", (F.col("level") - 1).alias("level"), F.col("room_id").alias("upper"))
    return lower.join(upper, [key, "zone", "part", "level"]).select(key, "lower", "upper")


def adjacent_walls(room: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """(key, one, other): rooms of one level whose walls have the same ends, to ``digits``.

    Rooms gather by ends, a few a wall, so walls are dealt once and never broadcast, whatever their size is taken for.
    """
    e = room.filter(F.col(key).isNotNull() & F.col("level").isNotNull()).select(key, "level", "room_id", F.explode(g.edges(F.col("ring"))).alias("e"))
    end = lambda k: F.struct(F.round(f"e.x{k}", digits).alias("x"), F.round(f"e.y{k}", digits).alias("y"))
    at = e.groupBy(key, "level", F.least(end(1), end(2)).alias("a"), F.greatest(end(1), end(2)).alias("b")).agg(F.collect_set("room_id").alias("__all"))
    one = at.filter(F.size("__all") > 1).select(key, "__all", F.explode("__all").alias("one"))
    return one.select(key, "one", F.explode(F.filter("__all", lambda x: x > F.col("one"))).alias("other")).distinct()


def windows(walls: DataFrame, ratio: Column, least: float = 0.1) -> DataFrame:
    """Window areas on outdoor walls by ratio; walls whose window would be under ``least`` have none."""
    return walls.filter("kind = 'wall'").withColumn("window_area", F.col("area") * ratio).filter(F.col("window_area") >= least)


def shades(edges: DataFrame, length: str, levels: str, height: str) -> DataFrame:
    """Edges raised to the building's height; edges without length leave."""
    return edges.filter(F.col(length) >= 1e-6).withColumn("shade_area", F.col(length) * F.col(levels) * F.col(height))


def export_reasons(zones: Column, windows_: Column, valid: Column, most_zones: int = 64, least_windows: int = 1) -> Column:
    """Why a model is removed, in order; empty for a good one."""
    rules = [(~valid, "validation_failed"), (zones < 1, "no_zones"), (zones > most_zones, f"zones_above_{most_zones}"), (windows_ < least_windows, "no_windows")]
    return F.array_distinct(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules])))


#: Window parameters fall back to these building types (fixed values): residential and service.
FALLBACK_TYPES = (3, 4)


def window_parameters(buildings: DataFrame, parameters: DataFrame, kind: str, residential: Column, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(buildings with the window fields of their type, or else of the fallback type; buildings with neither).

    ``parameters``: one row a type; a type that lacks any field counts as absent.
    """
    whole = parameters.dropna(subset=[kind, *fields])
    fallback = F.when(residential, F.lit(FALLBACK_TYPES[0])).otherwise(F.lit(FALLBACK_TYPES[1]))
    own = whole.select(F.col(kind).alias("__own"), *[F.col(f).alias(f"__o_{f}") for f in fields])
    other = whole.select(F.col(kind).alias("__other"), *[F.col(f).alias(f"__f_{f}") for f in fields])
    rows = buildings.withColumn("__fallback", fallback)
    rows = rows.join(own, F.col(kind) == F.col("__own"), "left").join(other, F.col("__fallback") == F.col("__other"), "left")
    out = rows.select(*buildings.columns, *[F.coalesce(f"__o_{f}", f"__f_{f}").alias(f) for f in fields])
    return out.dropna(subset=fields), out.filter(F.col(fields[0]).isNull()).select(*buildings.columns)


#: Opaque parts of a construction set and the columns that hold them.
OPAQUE = ("wall", "roof", "floor")


def construction_sets(buildings: DataFrame, key: str, materials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key with its set as JSON, excluded keys with reason and error).

    Columns ``<part>_construction`` and ``<part>_material`` hold JSON (or a literal) for wall, roof, floor and window.
    An opaque construction must name its own generated material, and only materials known otherwise; the
    window's glazing serves apertures, skylights and operable panes. The first error found is kept.
    """
    read = lambda c, schema: F.from_json(as_json(F.col(c)), schema)
    parts = [*OPAQUE, "window"]
    rows = buildings.withColumns({f"__c_{p}": read(f"{p}_construction", "identifier string, materials array<string>") for p in parts} | {f"__m_{p}": read(f"{p}_material", "identifier string") for p in parts})
    others = F.array_distinct(F.flatten(F.array(*[F.array_except(F.coalesce(F.col(f"__c_{p}.materials"), F.array().cast("array<string>")), F.array(F.coalesce(F.col(f"__m_{p}.identifier"), F.lit("")))) for p in OPAQUE])))
    wanted = rows.select(F.col(key).alias("__key"), F.explode(others).alias("material"))
    strange = wanted.join(materials.select("material").distinct(), "material", "left_anti").groupBy("__key").agg(F.min("material").alias("__strange"))
    rows = rows.join(strange, F.col(key) == F.col("__key"), "left")
    error = F.lit(None).cast("string")
    for p in reversed(parts):
        unread = F.col(f"__m_{p}.identifier").isNull() | F.get_json_object(as_json(F.col(f"{p}_construction")), "$").isNull()
        check = F.when(unread, F.lit(f"invalid {p} construction or material"))
        if p in OPAQUE:
            names = F.coalesce(F.col(f"__c_{p}.materials"), F.array().cast("array<string>"))
            check = check.when(~F.array_contains(names, F.col(f"__m_{p}.identifier")), F.lit(f"{p} construction lacks its generated material")).when(F.array_contains(names, F.col("__strange")), F.concat(F.lit(f"unknown {p} material "), F.col("__strange")))
        error = F.coalesce(check, error)
    rows = rows.withColumn("construction_error", error)
    name = lambda p: F.coalesce(F.col(f"__c_{p}.identifier"), F.concat(F.col(key).cast("string"), F.lit(f"_{p}")))
    last = F.element_at(F.split(F.col(key).cast("string"), "_"), -1)
    opaque = {"wall_set": ("exterior_construction", "wall"), "roof_ceiling_set": ("exterior_construction", "roof"), "floor_set": ("ground_construction", "floor")}
    panes = F.struct(*[name("window").alias(f"{k}_construction") for k in ("window", "skylight", "operable")])
    made = F.to_json(F.struct(F.concat(F.lit("cs_"), last).alias("identifier"), *[F.struct(name(p).alias(c)).alias(k) for k, (c, p) in opaque.items()], panes.alias("aperture_set")))
    good = rows.filter("construction_error IS NULL").select(key, made.alias("construction_set"))
    return good, rows.filter("construction_error IS NOT NULL").select(key, F.lit("invalid_construction").alias("reason"), "construction_error")


def split_valid(models: DataFrame, reasons: str) -> tuple[DataFrame, DataFrame]:
    """(models without removal reasons, index of the others with reasons joined)."""
    return models.filter(F.size(reasons) == 0), models.filter(F.size(reasons) > 0).withColumn(reasons, F.array_join(reasons, "; "))
