"""Joins by place: nearest, within a radius, raster cells, best-matching edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import haversine_m, parallel_difference
from ..session import checkpoint_ready

#: Nearest joins: a cell is split in ``SPLIT`` a dimension until none holds more than ``LEAF`` places, ``DEPTH`` times at most.
SPLIT, LEAF, DEPTH = 4, 256, 12


def nearest(left: DataFrame, right: DataFrame, key: str, lat: str, lon: str, right_key: str, right_lat: str, right_lon: str) -> DataFrame:
    """(left columns, right_key, distance_m): the nearest right row by great circle, ties to the smaller key.

    Every left row comes out once, repeated ones too; without coordinates, or without any right row, with nulls.
    ``key`` need not be unique. Right rows without coordinates or key are no candidates.
    """
    space = lambda la, lo: (F.cos(F.radians(la)) * F.cos(F.radians(lo)), F.cos(F.radians(la)) * F.sin(F.radians(lo)), F.sin(F.radians(la)))
    metres = haversine_m(F.col("__a"), F.col("__b"), F.col("__ra"), F.col("__rb"))
    return _nearest(left, right, (lat, lon), (right_lat, right_lon), right_key, space, metres, right_key, "distance_m")


def _nearest(left, right, at, right_at, right_key, space, distance, key_out, distance_out) -> DataFrame:
    """Branch and bound down a grid pyramid over the right side, all left rows at once.

    ``space`` maps two coordinates to points in which straight distance orders like ``distance``. Each level
    holds the occupied cells with the bounds of what they hold. A left row keeps, level by level, the
    cells whose least distance does not exceed the least of all cells' greatest distances, and meets the rows of the
    last level's cells only. So the work a row is a few cells a level at any size and density; places of
    the right side are distinct (the least key stays), so a hot place is one row.
    """
    checkpoint_ready(left.sparkSession)
    names = left.columns
    rows = left.withColumn("__id", F.monotonically_increasing_id()).checkpoint()  # ids must not change
    points = rows.select("__id", F.col(at[0]).cast("double").alias("__a"), F.col(at[1]).cast("double").alias("__b")).filter("__a IS NOT NULL AND __b IS NOT NULL AND NOT isnan(__a) AND NOT isnan(__b)")
    places = right.select(F.col(right_key).alias("__key"), F.col(right_at[0]).cast("double").alias("__ra"), F.col(right_at[1]).cast("double").alias("__rb"))
    places = places.filter("__key IS NOT NULL AND __ra IS NOT NULL AND __rb IS NOT NULL AND NOT isnan(__ra) AND NOT isnan(__rb)").groupBy("__ra", "__rb").agg(F.min("__key").alias("__key"))
    p, r = space(F.col("__a"), F.col("__b")), space(F.col("__ra"), F.col("__rb"))
    dims = range(len(p))
    points = points.withColumns({f"__p{i}": x for i, x in enumerate(p)})
    places = places.withColumns({f"__r{i}": x for i, x in enumerate(r)})
    found = places.agg(*[f(f"__r{i}") for i in dims for f in (F.min, F.max)], F.count("*")).first()
    nothing = F.lit(None).cast(right.schema[right_key].dataType).alias(key_out), F.lit(None).cast("double").alias(distance_out)
    if not found[-1]:
        return rows.select(*names, *nothing)
    low = [found[2 * i] for i in dims]
    size = max(found[2 * i + 1] - found[2 * i] for i in dims) or 1.0
    cell = lambda i, n: F.least(F.floor((F.col(f"__r{i}") - low[i]) / size * n).cast("long"), F.lit(n - 1).cast("long"))
    cells = [f"__c{i}" for i in dims]
    frontier, depth = None, 0
    while True:
        depth += 1
        level = places.withColumns({c: cell(i, SPLIT**depth) for i, c in enumerate(cells)})
        held = level.groupBy(*cells).agg(F.count("*").alias("__n"), *[f(f"__r{i}").alias(f"__{w}{i}") for i in dims for w, f in (("lo", F.min), ("hi", F.max))]).checkpoint()
        if frontier is None:
            frontier = points.crossJoin(F.broadcast(held.drop("__n")))  # at most SPLIT ** dimensions cells
        else:
            up = [F.floor(F.col(c) / SPLIT).cast("long").alias(f"__u{i}") for i, c in enumerate(cells)]
            kids = held.drop("__n").select("*", *up)
            above = frontier.select("__id", "__a", "__b", *[f"__p{i}" for i in dims], *[F.col(c).alias(f"__u{i}") for i, c in enumerate(cells)])
            frontier = above.join(kids, [f"__u{i}" for i in dims]).drop(*[f"__u{i}" for i in dims])
        out_by = [F.greatest(F.col(f"__lo{i}") - F.col(f"__p{i}"), F.col(f"__p{i}") - F.col(f"__hi{i}"), F.lit(0.0)) for i in dims]
        at_most = [F.greatest(F.abs(F.col(f"__p{i}") - F.col(f"__lo{i}")), F.abs(F.col(f"__p{i}") - F.col(f"__hi{i}"))) for i in dims]
        length = lambda xs: F.sqrt(sum((x * x for x in xs[1:]), xs[0] * xs[0]))
        bound = F.min(length(at_most)).over(Window.partitionBy("__id"))
        frontier = frontier.withColumn("__bound", bound).filter(length(out_by) <= F.col("__bound") + 1e-9 * size).drop("__bound", *[f"__{w}{i}" for i in dims for w in ("lo", "hi")])
        if depth == DEPTH or held.agg(F.max("__n")).first()[0] <= LEAF:
            break
    near = frontier.join(level, cells).groupBy("__id").agg(F.min(F.struct(distance.alias("d"), F.col("__key").alias("k"))).alias("__m"))
    return rows.join(near, "__id", "left").select(*names, F.col("__m.k").alias(key_out), F.col("__m.d").alias(distance_out))


def within_radius(df: DataFrame, key: str, x: str, y: str, radius: float, groups: list[str] | None = None) -> DataFrame:
    """(key, other, distance) of pairs of different rows within ``radius``, both ways.

    An equi-join on grid cells as wide as the radius; each row asks its nine cells.
    """
    groups = groups or []
    cell = lambda c: F.floor(c / radius).cast("long")
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    asked = df.select(*groups, F.col(key), F.col(x).alias("__x"), F.col(y).alias("__y")).withColumn("__di", F.explode(near)).withColumn("__dj", F.explode(near))
    asked = asked.withColumns({"__i": cell(F.col("__x")) + F.col("__di"), "__j": cell(F.col("__y")) + F.col("__dj")})
    there = df.select(*groups, F.col(key).alias("other"), F.col(x).alias("__ox"), F.col(y).alias("__oy"), cell(F.col(x)).alias("__i"), cell(F.col(y)).alias("__j"))
    distance = F.hypot(F.col("__x") - F.col("__ox"), F.col("__y") - F.col("__oy"))
    return asked.join(there, [*groups, "__i", "__j"]).filter(F.col(key) != F.col("other")).withColumn("distance", distance).filter(F.col("distance") <= radius).select(*groups, key, "other", "distance")


def match_or_nearest(left: DataFrame, right: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Rows joined by id; those without a partner take the nearest right row (ties: smaller id), null without a place."""
    partners = right.select(F.col(key).alias("matched")).filter("matched IS NOT NULL").distinct()
    both = left.join(partners, F.col(key) == F.col("matched"), "left")
    by_id = both.filter("matched IS NOT NULL").withColumn("how", F.lit("id"))
    flat = lambda a, b: (a, b)
    planar = F.hypot(F.col("__a") - F.col("__ra"), F.col("__b") - F.col("__rb"))
    near = _nearest(both.filter("matched IS NULL").drop("matched"), right, (x, y), (x, y), key, flat, planar, "matched", "__d")
    return by_id.unionByName(near.drop("__d").withColumn("how", F.lit("nearest")))


def sample_raster(points: DataFrame, x: str, y: str, pixels: DataFrame, x0: float, y0: float, size: float, nodata: float | None, out: str, required: bool) -> DataFrame:
    """Pixel value under each point; rows run down from ``y0``. Points without a value leave if ``required``."""
    at = points.withColumns({"__row": F.floor((F.lit(y0) - F.col(y)) / size).cast("int"), "__col": F.floor((F.col(x) - F.lit(x0)) / size).cast("int")})
    value = F.col("value") if nodata is None else F.nullif(F.col("value"), F.lit(nodata))
    cells = pixels.select(F.col("row").alias("__row"), F.col("col").alias("__col"), F.nanvl(value, F.lit(None).cast("double")).alias(out))
    cells = cells.filter(F.col(out).isNotNull())
    return at.join(cells, ["__row", "__col"], "inner" if required else "left").drop("__row", "__col")


def mosaic(pixels: DataFrame, tile_order: str) -> DataFrame:
    """One value a cell: that of the first tile."""
    return pixels.groupBy("row", "col").agg(F.min_by("value", tile_order).alias("value"))


def resample(pixels: DataFrame, factor: float) -> DataFrame:
    """Nearest values of a grid ``factor`` times as fine (or coarse, below one)."""
    if factor >= 1:
        k = int(factor)
        steps = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        fine = pixels.withColumn("__a", steps).withColumn("__b", steps)
        return fine.select((F.col("row") * k + F.col("__a")).alias("row"), (F.col("col") * k + F.col("__b")).alias("col"), "value")
    k = int(round(1 / factor))
    middle = k // 2
    return pixels.filter((F.col("row") % k == middle) & (F.col("col") % k == middle)).select(F.floor(F.col("row") / k).cast("int").alias("row"), F.floor(F.col("col") / k).cast("int").alias("col"), "value")


def best_edges(edges: DataFrame, lines: DataFrame, groups: list[str], edge: str, line: str, angle: float, offset: float) -> DataFrame:
    """The line of each edge within an angle and an offset, least angle first, then offset, then id.

    Both sides hold ``alpha`` and ``rho``; they meet in (group, angle band, offset band).
    """
    band = lambda c, w: F.floor(F.col(c) / w).cast("int")
    bands = int(180 // angle) or 1
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    asked = edges.withColumn("__da", F.explode(steps)).withColumn("__dr", F.explode(steps))
    asked = asked.withColumns({"__a": F.pmod(F.least(band("alpha", angle), F.lit(bands - 1)) + F.col("__da"), F.lit(bands))})
    asked = asked.withColumn("__b", band("rho", offset) + F.col("__dr")).select(*groups, edge, F.col("alpha").alias("ea"), F.col("rho").alias("er"), "__a", "__b").distinct()
    there = lines.withColumns({"__a": F.least(band("alpha", angle), F.lit(bands - 1)), "__b": band("rho", offset)}).select(*groups, line, F.col("alpha").alias("la"), F.col("rho").alias("lr"), "__a", "__b")
    da, dr = parallel_difference(F.col("ea"), F.col("la")), F.abs(F.col("er") - F.col("lr"))
    found = asked.join(there, [*groups, "__a", "__b"]).withColumns({"da": da, "dr": dr}).filter((F.col("da") <= angle) & (F.col("dr") <= offset))
    return found.groupBy(*groups, edge).agg(F.min(F.struct("da", "dr", line)).alias("m")).select(*groups, edge, F.col(f"m.{line}").alias(line), F.col("m.da").alias("angle"), F.col("m.dr").alias("offset"))
