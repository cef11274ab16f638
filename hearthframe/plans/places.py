"""Footprints in a row, their neighbours and zones; places, frames and directions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scalars
from ..operators import assembly, shading, spatial, zones
from .registry import query, table
from .space import CUS, FOOT, SUP, cities, dealt, footprints, stations

MANY = "o AS (SELECT o_orderkey, 35.0 + (o_orderkey * 37 % 3109) / 100.0 AS slat, -10.0 + (o_orderkey * 53 % 5003) / 100.0 AS slon FROM orders)"


@query(
    "many_stations",
    f"""WITH {CUS}, {MANY}, x AS (SELECT c_custkey, min(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(slat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2))))) AS m FROM c, o GROUP BY 1)
    SELECT c_custkey, round(m, 3) AS distance_m FROM x""",
)
def many_stations(spark, d):
    k = F.col("o_orderkey")
    right = table(spark, d, "orders").select("o_orderkey", (35.0 + (k * 37 % 3109) / 100.0).alias("slat"), (-10.0 + (k * 53 % 5003) / 100.0).alias("slon"))
    return spatial.nearest(cities(spark, d), right, "c_custkey", "lat", "lon", "o_orderkey", "slat", "slon").select("c_custkey", F.round("distance_m", 3).alias("distance_m"))


@query(
    "id_or_nearest",
    f"""WITH {SUP}, {CUS}, x AS (SELECT c_custkey, min(sqrt((lat - slat) * (lat - slat) + (lon - slon) * (lon - slon))) AS m FROM c, s WHERE c_custkey NOT IN (SELECT s_suppkey FROM s) GROUP BY 1)
    SELECT c_custkey, CASE WHEN m IS NULL THEN 'id' ELSE 'nearest' END AS how, round(m, 6) AS distance FROM c LEFT JOIN x USING (c_custkey)""",
)
def id_or_nearest(spark, d):
    right = stations(spark, d).select(F.col("s_suppkey").alias("k"), F.col("slat").alias("lat"), F.col("slon").alias("lon"))
    out = spatial.match_or_nearest(cities(spark, d).withColumnRenamed("c_custkey", "k"), right, "k", "lat", "lon")
    there = right.select(F.col("k").alias("matched"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    distance = F.when(F.col("how") == "nearest", F.round(F.hypot(F.col("lat") - F.col("slat"), F.col("lon") - F.col("slon")), 6))
    return out.join(there, "matched").select(F.col("k").alias("c_custkey"), "how", distance.alias("distance"))


def street(spark, d):
    """Footprints side by side, sixty metres from start to start."""
    f = footprints(spark, d)
    return f.withColumn("ring", g.shift(F.col("ring"), F.lit(-60.0) * F.col("p_partkey"), F.lit(0.0)))


@query(
    "vertex_neighbours",
    f"WITH {FOOT}, p AS (SELECT a.p_partkey AS l, b.p_partkey AS r FROM f a JOIN f b ON b.p_partkey = a.p_partkey + 1 WHERE 60 - a.w <= 20) SELECT l AS p_partkey, r AS other FROM p UNION ALL SELECT r, l FROM p",
)
def vertex_neighbours(spark, d):
    s = street(spark, d)
    others = s.select(F.col("p_partkey").alias("other"), "ring")
    return shading.nearby(s.select("p_partkey", "ring"), others, "p_partkey", "other", "ring").select("p_partkey", "other")


@query("window_walls", f"WITH {FOOT} SELECT p_partkey, 0 AS edge FROM f")
def window_walls(spark, d):
    walls = footprints(spark, d).select("p_partkey", F.explode(g.edges(F.col("ring"))).alias("e"))
    near = F.struct(F.lit(0).alias("edge"), F.lit(0.5).alias("x1"), F.lit(0.05).alias("y1"), F.lit(2.5).alias("x2"), F.lit(0.05).alias("y2"), F.lit(2.0).alias("length"))
    windows = table(spark, d, "part").select("p_partkey", near.alias("e"))
    return shading.walls_of_windows(windows, walls, "p_partkey").select("p_partkey", "e.edge")


@query(
    "contact_runs",
    """WITH b AS (SELECT p_partkey, p_partkey % 64 AS k FROM part), r AS (SELECT p_partkey, k, sum(CASE WHEN (k >> i) & 1 = 1 AND (k >> ((i + 5) % 6)) & 1 = 0 THEN 1 ELSE 0 END) AS n FROM b, (SELECT unnest(range(0, 6)) AS i) GROUP BY 1, 2)
    SELECT p_partkey, CAST(CASE WHEN k = 63 THEN 1 ELSE n END AS INTEGER) AS n_runs FROM r""",
)
def contact_runs(spark, d):
    bits = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.pmod(F.floor(F.col("p_partkey") / F.pow(F.lit(2), i)), F.lit(2)) == 1)
    return table(spark, d, "part").select("p_partkey", shading.contact_runs(bits).cast("int").alias("n_runs"))


@query("rays_to_walls", f"WITH {FOOT}, n AS (SELECT *, CAST(greatest(1, ceil(h / 2 / 5.0)) AS INTEGER) AS n FROM f) SELECT p_partkey, CAST(i AS INTEGER) AS point, round(h / 2 * i / n, 6) AS y, round(w, 6) AS x2, CAST(8.0 AS DOUBLE) AS distance FROM n, LATERAL (SELECT unnest(range(0, n + 1)) AS i)")
def rays_to_walls(spark, d):
    f = footprints(spark, d)
    x, top = F.col("w") + 8.0, F.col("h") / 2
    edge = F.struct(F.lit(0).alias("edge"), x.alias("x1"), F.lit(0.0).alias("y1"), x.alias("x2"), top.alias("y2"), top.alias("length"))
    lines = shading.rays(f.select("p_partkey", F.array(edge).alias("edges"), "ring"), "edges", "ring", 5.0)
    return lines.select("p_partkey", "point", F.round("y1", 6).alias("y"), F.round("x2", 6).alias("x2"), F.round(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 6).alias("distance"))


@query("trimmed_segments", f"WITH {FOOT} SELECT p_partkey, CASE WHEN w > 12 THEN round(w - 12, 6) END AS length, CASE WHEN w > 12 THEN CAST(6.0 AS DOUBLE) END AS x1, CASE WHEN w > 12 THEN round(w - 6, 6) END AS x2 FROM f")
def trimmed_segments(spark, d):
    t = g.trim_segment(g.edges(F.col("ring"))[0], 6.0)
    return footprints(spark, d).select("p_partkey", t.alias("t")).select("p_partkey", *[F.round(f"t.{c}", 6).alias(c) for c in ("length", "x1", "x2")])


@query("local_frames", f"WITH {FOOT} SELECT p_partkey, round(-w / 2, 6) AS x0, round(-h / 2, 6) AS y0, round(w / 2, 6) AS x1, round(h / 2, 6) AS y1 FROM f")
def local_frames(spark, d):
    b = g.bounds(g.to_local(F.col("ring")))
    return street(spark, d).select("p_partkey", b.alias("b")).select("p_partkey", *[F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("svg_paths", "SELECT p_partkey, 'M 0 0 L ' || CAST(p_size AS VARCHAR) || ' 0 L ' || CAST(p_size AS VARCHAR) || ' ' || regexp_replace(printf('%.2f', p_size / 4.0), '\\.?0+$', '') || ' Z' AS path FROM part WHERE p_size % 40 <> 0 UNION ALL SELECT p_partkey, 'M 0 0 L ' || CAST(p_size AS VARCHAR) || ' 0 L ' || CAST(p_size AS VARCHAR) || ' ' || CAST(p_size // 4 AS VARCHAR) || ' Z' FROM part WHERE p_size % 40 = 0")
def svg_paths(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", g.svg_path(g.ring((F.lit(0), F.lit(0)), (s, F.lit(0)), (s, s / 4.0))).alias("path"))


@query("place_boxes", f"WITH {CUS} SELECT c_custkey, round(lat - 500 / 111000.0, 8) AS south, round(lon - 500 / (111000.0 * greatest(cos(radians(lat)), 1e-6)), 8) AS west, round(lat + 500 / 111000.0, 8) AS north, round(lon + 500 / (111000.0 * greatest(cos(radians(lat)), 1e-6)), 8) AS east FROM c")
def place_boxes(spark, d):
    b = scalars.bbox_around(F.col("lat"), F.col("lon"), 500.0)
    return cities(spark, d).select("c_custkey", b.alias("b")).select("c_custkey", *[F.round(f"b.{c}", 8).alias(c) for c in ("south", "west", "north", "east")])


@query("metric_systems", f"WITH {CUS} SELECT c_custkey, CAST(CASE c_custkey % 3 WHEN 0 THEN 32600 + floor((lon + 180) / 6) + 1 WHEN 1 THEN 32700 + floor((lon + 180) / 6) + 1 ELSE 32633 END AS INTEGER) AS epsg FROM c")
def metric_systems(spark, d):
    k = F.col("c_custkey") % 3
    own = F.when(k == 0, F.col("lat")), F.when(k == 0, F.col("lon"))
    other = F.when(k == 1, -F.col("lat")), F.when(k < 2, F.col("lon"))
    return cities(spark, d).select("c_custkey", scalars.metric_epsg([own, other]).alias("epsg"))


@query(
    "wall_directions",
    f"""WITH {FOOT}, v AS (SELECT p_partkey, w, h, sqrt(w * w + h * h) AS d, degrees(atan2(h, w)) AS a FROM f)
    SELECT p_partkey, round(d, 6) AS length, round(a, 6) AS azimuth, round(a + 180, 6) AS back, round(a, 6) AS turn, CAST(180.0 AS DOUBLE) AS none, round(a, 6) AS alpha, CAST(0.0 AS DOUBLE) AS rho, round(w * h / d, 6) AS far FROM v""",
)
def wall_directions(spark, d):
    w, h, zero = F.col("w"), F.col("h"), F.lit(0.0)
    form, other = scalars.edge_normal_form(zero, zero, w, h), scalars.edge_normal_form(w, zero, 2 * w, h)
    return footprints(spark, d).select(
        "p_partkey",
        F.round(scalars.segment_length(zero, zero, w, h), 6).alias("length"),
        F.round(scalars.azimuth(zero, zero, w, h), 6).alias("azimuth"),
        F.round(scalars.azimuth(w, h, zero, zero), 6).alias("back"),
        F.round(scalars.angle_between(w, zero, w, h), 6).alias("turn"),
        scalars.angle_between(zero, zero, w, h).alias("none"),
        F.round(form["alpha"], 6).alias("alpha"),
        F.abs(F.round(form["rho"], 6)).alias("rho"),
        F.abs(F.round(other["rho"], 6)).alias("far"),
    )


@query("wall_distances", f"WITH {FOOT} SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN 3 ELSE 5 END AS DOUBLE) AS distance FROM f")
def wall_distances(spark, d):
    beside = F.when(F.col("p_size") % 2 == 0, F.col("w") / 2).otherwise(F.col("w") + 4.0)
    return footprints(spark, d).select("p_partkey", F.round(g.point_segment_distance(beside, F.lit(3.0), F.lit(0.0), F.lit(0.0), F.col("w"), F.lit(0.0)), 6).alias("distance"))


@query("floor_adjacency", "SELECT p_partkey, CAST(p_size % 4 AS BIGINT) AS n FROM part WHERE p_size % 4 > 0")
def floor_adjacency(spark, d):
    b = footprints(spark, d).select("p_partkey", (1 + F.col("p_size") % 4).alias("levels"), F.lit(3.0).alias("height"), F.array("ring").alias("zones"))
    return assembly.adjacent_floors(assembly.rooms(b, "p_partkey", "levels", "height", "zones"), "p_partkey").groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("window_areas", f"WITH {FOOT} SELECT p_partkey, count(*) AS n, round(sum(a) * 0.1, 4) AS area FROM (SELECT p_partkey, unnest(CASE WHEN ell THEN [w, h / 2, w / 2, h / 2, w / 2, h] ELSE [w, h, w, h] END) * 3.0 AS a FROM f) WHERE a * 0.1 >= 1.0 GROUP BY 1")
def window_areas(spark, d):
    b = footprints(spark, d).select("p_partkey", F.lit(1).alias("levels"), F.lit(3.0).alias("height"), F.array("ring").alias("zones"))
    walls = assembly.faces(assembly.rooms(b, "p_partkey", "levels", "height", "zones"))
    key = F.split_part("room_id", F.lit("_"), F.lit(1)).cast("long").alias("p_partkey")
    return assembly.windows(walls, F.lit(0.1), 1.0).groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum("window_area"), 4).alias("area"))


# Polygon kernels whose results have a closed form on blocks of whole metres


BLOCK = "f AS (SELECT p_partkey, CAST(p_size + 4 AS DOUBLE) AS w, CAST(p_partkey % 9 + 6 AS DOUBLE) AS h, p_size % 3 AS k FROM part)"


def blocks(spark, d):
    """Boxes of whole metres, ``w`` by ``h``."""
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") + 4.0).alias("w"), (F.col("p_partkey") % 9 + 6.0).alias("h"), (F.col("p_size") % 3).alias("k"))


def box(x, y, w, h):
    return g.ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


@query(
    "polygon_parts",
    f"""WITH {BLOCK} SELECT p_partkey, 1 AS n_large, CAST(CASE WHEN k = 1 THEN 10 ELSE 8 END AS INTEGER) AS n_vertices, 1 AS n_holes, round(w * h * (CASE WHEN k = 1 THEN 0.75 ELSE 1 END) - w * h / 16, 6) AS area, round(2 * (w + h) + w / 2 + h / 2, 6) AS length FROM f""",
)
def polygon_parts(spark, d):
    """Two parts a building: a footprint with a hole, and a hut of one square metre; the plain part's vertices count too."""
    w, h, zero = F.col("w"), F.col("h"), F.lit(0.0)
    ell = g.ring((zero, zero), (w, zero), (w, h / 2), (w / 2, h / 2), (w / 2, h), (zero, h))
    poly = lambda ext, holes: F.struct(ext.alias("exterior"), holes.alias("holes"))
    main = poly(F.when(F.col("k") == 1, ell).otherwise(box(zero, zero, w, h)), F.array(box(w / 4, h / 4, w / 4, h / 4)))
    hut = poly(box(F.lit(100.0), zero, F.lit(1.0), F.lit(1.0)), F.array().cast(f"array<{g.RING}>"))
    geom, first = F.col("geom"), F.col("geom")[0]
    large = F.size(g.parts(geom, 2.0)).alias("n_large")
    rows = blocks(spark, d).select("p_partkey", F.array(main, hut).alias("geom"))
    return rows.select("p_partkey", large, g.vertex_count(geom).alias("n_vertices"), g.hole_count(geom).alias("n_holes"), F.round(g.polygon_area(first), 6).alias("area"), F.round(g.polygon_perimeter(first), 6).alias("length"))


@query("dissolved_neighbours", f"WITH {BLOCK} SELECT p_partkey, 1 AS n_parts, round(2 * w * h + 0.1 * h, 3) AS area FROM f")
def dissolved_neighbours(spark, d):
    """Two equal boxes ten centimetres apart become one, the gap filled."""
    w, h, zero = F.col("w"), F.col("h"), F.lit(0.0)
    out = zones.dissolve(dealt(blocks(spark, d).select("p_partkey", F.array(box(zero, zero, w, h), box(w + 0.1, zero, w, h)).alias("rings"))), "rings")
    return out.select("p_partkey", F.size("dissolved").alias("n_parts"), F.round(g.total(F.transform("dissolved", g.polygon_area)), 3).alias("area"))


@query("valid_parts", f"WITH {BLOCK} SELECT p_partkey, 2 AS n_parts, round(w * h / 2, 3) AS area FROM f")
def valid_parts(spark, d):
    """A bow tie has two triangles."""
    w, h = F.col("w"), F.col("h")
    bow = g.ring((F.lit(0), F.lit(0)), (w, h), (w, F.lit(0)), (F.lit(0), h))
    out = zones.valid_parts(dealt(blocks(spark, d).select("p_partkey", bow.alias("ring"))), "ring")
    return out.select("p_partkey", F.size("parts").alias("n_parts"), F.round(g.total(F.transform("parts", g.polygon_area)), 3).alias("area"))


@query("fitted_neighbours", f"WITH {BLOCK} SELECT p_partkey, round((w - 0.5) * h, 3) AS area, round(w, 3) AS x FROM f")
def fitted_neighbours(spark, d):
    """A neighbour drawn half a metre into the building loses the overlap."""
    w, h, zero = F.col("w"), F.col("h"), F.lit(0.0)
    f = blocks(spark, d).select("p_partkey", box(zero, zero, w, h).alias("ring"), F.array(box(w - 0.5, zero, w, h)).alias("near"))
    out = zones.fit_neighbours(dealt(f), "ring", "near").withColumn("r", F.col("fitted")[0])
    return out.select("p_partkey", F.round(g.ring_area(F.col("r")), 3).alias("area"), F.round(g.bounds(F.col("r"))["x0"], 3).alias("x"))


@query(
    "zones_of_squares",
    """WITH s AS (SELECT p_partkey, CAST(p_size + 5 AS DOUBLE) AS a FROM part) SELECT p_partkey, CASE WHEN a - 9 >= 2 THEN 'perimeter_with_interior' WHEN a - 9 > 1 THEN 'perimeter_only_all_interiors_absorbed' ELSE 'perimeter_only_no_nominal_interior' END AS how,
    CASE WHEN a - 9 >= 2 THEN 'matched_trapezoids' WHEN a - 9 > 1 THEN 'discarded_small_interior_kept_as_single_zone' ELSE 'insufficient_exact_vertex_matches' END AS reason, CAST(CASE WHEN a - 9 >= 2 THEN 1 ELSE 0 END AS INTEGER) AS n_core, CAST(CASE WHEN a - 9 >= 2 THEN 4 ELSE 1 END AS INTEGER) AS n_perimeter,
    round(a * a, 3) AS area, round(CASE WHEN a - 9 >= 2 THEN (a - 9) * (a - 9) ELSE 0 END, 3) AS core FROM s""",
)
def zones_of_squares(spark, d):
    a = F.col("p_size") + 5.0
    f = table(spark, d, "part").select("p_partkey", g.ring((F.lit(0), F.lit(0)), (a, F.lit(0)), (a, a), (F.lit(0), a)).alias("ring"))
    out = zones.perimeter_core(dealt(f), "ring")
    areas = lambda c: g.total(F.transform(c, g.ring_area))
    return out.select("p_partkey", "how", "reason", F.size("zones_core").alias("n_core"), F.size("zones_perimeter").alias("n_perimeter"), F.round(areas("zones_core") + areas("zones_perimeter"), 3).alias("area"), F.round(areas("zones_core"), 3).alias("core"))


@query("convex_parts_of_ells", f"WITH {BLOCK} SELECT p_partkey, 2 AS n, round(0.75 * w * h, 3) AS area FROM f")
def convex_parts_of_ells(spark, d):
    """An L has two convex parts, whichever way it is cut."""
    w, h, zero = F.col("w"), F.col("h"), F.lit(0.0)
    ell = g.ring((zero, zero), (w, zero), (w, h / 2), (w / 2, h / 2), (w / 2, h), (zero, h))
    out = zones.decompose(dealt(blocks(spark, d).select("p_partkey", ell.alias("ring"))), "ring")
    return out.select("p_partkey", F.size("zones").alias("n"), F.round(g.total(F.transform("zones", g.ring_area)), 3).alias("area"))


@query("connected_zones", f"WITH {BLOCK} SELECT p_partkey, CAST(CASE WHEN k = 0 THEN 2 ELSE 1 END AS INTEGER) AS n_groups FROM f")
def connected_zones(spark, d):
    """Two boxes that stand three metres apart, share a wall, or meet at a corner."""
    w, h, k, zero = F.col("w"), F.col("h"), F.col("k"), F.lit(0.0)
    other = F.when(k == 0, box(w + 3.0, zero, w, h)).when(k == 1, box(w, zero, w, h)).otherwise(box(w, h, w, h))
    f = blocks(spark, d).select("p_partkey", F.array(box(zero, zero, w, h), other).alias("zones"))
    return zones.connectivity(f, "zones").select("p_partkey", "n_groups")


@query("split_rings", f"WITH {BLOCK} SELECT p_partkey, 2 AS n, round(w * h - 4, 3) AS area FROM f")
def split_rings(spark, d):
    """A box with a hole: the shortest cut along the hole leaves two pieces."""
    w, h, zero = F.col("w"), F.col("h"), F.lit(0.0)
    f = blocks(spark, d).select("p_partkey", F.struct(box(zero, zero, w, h).alias("exterior"), F.array(box(F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(2.0))).alias("holes")).alias("poly"))
    out = zones.split_holes(dealt(f), "poly")
    return out.select("p_partkey", F.size("pieces").alias("n"), F.round(g.total(F.transform("pieces", g.ring_area)), 3).alias("area"))


@query(
    "footprint_rejects",
    f"WITH {BLOCK} SELECT p_partkey, round(w * h - CASE WHEN k = 1 THEN 1 ELSE 0 END, 6) AS area, CAST(CASE WHEN k = 1 THEN 1 ELSE 0 END AS INTEGER) AS n_holes, round(least(w, h), 4) AS short FROM f WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND w * h - CASE WHEN k = 1 THEN 1 ELSE 0 END BETWEEN 60 AND 400",
)
def footprint_rejects(spark, d):
    """Slivers, footprints of two parts and of three holes, and areas out of bounds leave; of repeated ids one row stays."""
    w, h, key, one = F.col("w"), F.col("h"), F.col("p_partkey"), F.lit(1.0)
    poly = lambda ext, *holes: F.struct(ext.alias("exterior"), F.array(*holes).cast(f"array<{g.RING}>").alias("holes"))
    plain, holed = poly(box(F.lit(0.0), F.lit(0.0), w, h)), poly(box(F.lit(0.0), F.lit(0.0), w, h), box(one, one, one, one))
    holes3 = poly(box(F.lit(0.0), F.lit(0.0), w, h), *[box(F.lit(0.5), F.lit(y), F.lit(0.5), F.lit(0.5)) for y in (0.5, 1.5, 2.5)])
    sliver = poly(box(F.lit(0.0), F.lit(0.0), F.lit(60.0), F.lit(1.5)))
    shapes = F.when(key % 5 == 0, F.array(sliver)).when(key % 7 == 0, F.array(plain, plain)).when(key % 11 == 0, F.array(holes3)).when(F.col("k") == 1, F.array(holed)).otherwise(F.array(plain))
    f = blocks(spark, d).select("p_partkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"), shapes.alias("polygons"))
    out = shading.filter_footprints(f, "p_partkey", "polygons", ["copy"], {"least": 60.0, "most": 400.0})
    return out.select("p_partkey", F.round("area", 6).alias("area"), "n_holes", F.round("short", 4).alias("short"))


@query("room_parts", "SELECT p_partkey, CAST(2 * (1 + p_size % 3) AS BIGINT) AS n_rooms, CAST(1 + p_size % 3 AS BIGINT) AS n_pairs, CAST(p_partkey AS VARCHAR) || '_z0_p1_L' || CAST(p_size % 3 AS VARCHAR) AS last FROM part")
def room_parts(spark, d):
    """One zone of two boxes side by side: rooms by part, joined by their common wall on each level."""
    w, h, zero = F.col("w"), F.col("h"), F.lit(0.0)
    two = F.array(F.array(box(zero, zero, w, h), box(w, zero, w, h)))
    b = blocks(spark, d).select("p_partkey", (F.col("k") + 1).alias("levels"), F.lit(3.0).alias("height"), two.alias("zones"))
    room = assembly.rooms(b, "p_partkey", "levels", "height", "zones")
    pairs = assembly.adjacent_walls(room, "p_partkey").groupBy("p_partkey").agg(F.count("*").alias("n_pairs"))
    return room.groupBy("p_partkey").agg(F.count("*").alias("n_rooms"), F.max("room_id").alias("last")).join(pairs.hint("merge"), "p_partkey")  # both as long as the table
