"""Places, polygons, zones and models. The driver's tables hold none, so these are derived from keys and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scalars
from ..operators import assembly, spatial, zones
from .registry import query, table

SUP = "s AS (SELECT s_suppkey, 35.0 + (s_suppkey * 37 % 310) / 10.0 AS slat, -10.0 + (s_suppkey * 53 % 500) / 10.0 AS slon FROM supplier)"
CUS = "c AS (SELECT c_custkey, 35.0 + (c_custkey * 41 % 313) / 10.0 AS lat, -10.0 + (c_custkey * 59 % 503) / 10.0 AS lon FROM customer)"


def stations(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", (35.0 + (k * 37 % 310) / 10.0).alias("slat"), (-10.0 + (k * 53 % 500) / 10.0).alias("slon"))


def cities(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", (35.0 + (k * 41 % 313) / 10.0).alias("lat"), (-10.0 + (k * 59 % 503) / 10.0).alias("lon"))


@query(
    "nearest_station",
    f"""WITH {SUP}, {CUS}, x AS (SELECT c_custkey, s_suppkey, round(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(slat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2)))), 3) AS m FROM c, s)
    SELECT c_custkey, min(m) AS distance_m FROM x GROUP BY 1""",
)
def nearest_station(spark, d):
    out = spatial.nearest(cities(spark, d), stations(spark, d), "c_custkey", "lat", "lon", "s_suppkey", "slat", "slon")
    return out.select("c_custkey", F.round("distance_m", 3).alias("distance_m"))


@query("bbox_filter", f"WITH {CUS} SELECT c_custkey, lat, lon FROM c WHERE lat BETWEEN 40 AND 50 AND lon BETWEEN 0 AND 20")
def bbox_filter(spark, d):
    return cities(spark, d).filter(F.col("lat").between(40, 50) & F.col("lon").between(0, 20))


@query(
    "radius_neighbours",
    """WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
    SELECT a.vec_id, b.vec_id AS other, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM p a JOIN p b ON a.vec_id <> b.vec_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02""",
)
def radius_neighbours(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return spatial.within_radius(p, "vec_id", "x", "y", 0.02).withColumn("distance", F.round("distance", 6))


@query(
    "grid_raster_sample",
    """WITH px AS (SELECT l_linenumber AS r, CAST(l_orderkey % 10 AS INTEGER) AS c, nullif(max(l_quantity), 50.0) AS v FROM lineitem GROUP BY 1, 2), pt AS (SELECT p_partkey, (p_size % 10) + 0.5 AS x, 10.0 - (p_partkey % 9) - 0.25 AS y FROM part)
    SELECT p_partkey, v AS sampled FROM pt LEFT JOIN px ON r = floor(10.0 - y) AND c = floor(x) AND v IS NOT NULL""",
)
def grid_raster_sample(spark, d):
    cell = (F.col("l_orderkey") % 10).cast("int")
    pixels = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("row"), cell.alias("col")).agg(F.max("l_quantity").alias("value"))
    points = table(spark, d, "part").select("p_partkey", ((F.col("p_size") % 10) + 0.5).alias("x"), (10.0 - (F.col("p_partkey") % 9) - 0.25).alias("y"))
    return spatial.sample_raster(points, "x", "y", pixels, 0.0, 10.0, 1.0, 50.0, "sampled", False).select("p_partkey", "sampled")


@query(
    "utm_zones",
    f"WITH {CUS} SELECT c_custkey, CAST(least(greatest(floor((lon + 180) / 6) + 1, 1), 60) AS INTEGER) AS zone, CAST(32600 + least(greatest(floor((lon + 180) / 6) + 1, 1), 60) AS INTEGER) AS epsg FROM c",
)
def utm_zones(spark, d):
    return cities(spark, d).select("c_custkey", scalars.utm_zone(F.col("lon")).alias("zone"), scalars.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"))


def dealt(df, key="p_partkey"):
    """Rows of a small table dealt to many tasks, in a stated number that adaptive execution leaves alone: the work is in the rows."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def footprints(spark, d):
    """An L for odd sizes, a rectangle for even ones: ``ring`` with sides from size and price.

    Kernels that search or overlay polygons take them ``dealt``: a small table comes as one partition.
    """
    w, h = (F.col("p_size") + 4).cast("double"), F.col("p_retailprice") / 100.0
    ell = g.ring((F.lit(0), F.lit(0)), (w, F.lit(0)), (w, h / 2), (w / 2, h / 2), (w / 2, h), (F.lit(0), h))
    box = g.ring((F.lit(0), F.lit(0)), (w, F.lit(0)), (w, h), (F.lit(0), h))
    return table(spark, d, "part").select("p_partkey", "p_size", w.alias("w"), h.alias("h"), F.when(F.col("p_size") % 2 == 1, ell).otherwise(box).alias("ring"))


FOOT = "f AS (SELECT p_partkey, p_size, CAST(p_size + 4 AS DOUBLE) AS w, p_retailprice / 100.0 AS h, p_size % 2 = 1 AS ell FROM part)"


@query(
    "polygon_metrics",
    f"""WITH {FOOT} SELECT p_partkey, round(CASE WHEN ell THEN w * h * 0.75 ELSE w * h END, 8) AS area, round(2 * (w + h), 8) AS perimeter, round(4 * pi() * CASE WHEN ell THEN w * h * 0.75 ELSE w * h END / pow(2 * (w + h), 2), 6) AS compactness,
    CAST(CASE WHEN ell THEN 1 ELSE 0 END AS INTEGER) AS n_reflex, NOT ell AS convex, round(CASE WHEN ell THEN w * 5 / 12 ELSE w / 2 END, 8) AS cx FROM f""",
)
def polygon_metrics(spark, d):
    r = F.col("ring")
    a, p = g.ring_area(r), g.perimeter(r)
    return footprints(spark, d).select("p_partkey", F.round(a, 8).alias("area"), F.round(p, 8).alias("perimeter"), F.round(g.compactness(a, p), 6).alias("compactness"), g.reflex_count(r).alias("n_reflex"), g.is_convex(r).alias("convex"), F.round(g.centroid(r)["x"], 8).alias("cx"))


@query(
    "edge_explode_lengths",
    f"""WITH {FOOT}, e AS (SELECT p_partkey, unnest(range(0, CASE WHEN ell THEN 6 ELSE 4 END)) AS edge, w, h, ell FROM f)
    SELECT p_partkey, CAST(edge AS INTEGER) AS edge, round(CASE WHEN ell THEN CASE edge WHEN 0 THEN w WHEN 1 THEN h / 2 WHEN 2 THEN w / 2 WHEN 3 THEN h / 2 WHEN 4 THEN w / 2 ELSE h END ELSE CASE WHEN edge % 2 = 0 THEN w ELSE h END END, 6) AS length FROM e""",
)
def edge_explode_lengths(spark, d):
    return footprints(spark, d).select("p_partkey", F.explode(g.edges(F.col("ring"))).alias("e")).select("p_partkey", "e.edge", F.round("e.length", 6).alias("length"))


@query("sample_points", f"WITH {FOOT}, n AS (SELECT p_partkey, w, CAST(greatest(1, ceil(w / 5.0)) AS INTEGER) AS n FROM f), p AS (SELECT *, unnest(range(0, n + 1)) AS i FROM n) SELECT p_partkey, round(w * i / n, 6) AS x FROM p")
def sample_points(spark, d):
    first = footprints(spark, d).select("p_partkey", g.edges(F.col("ring"))[0].alias("e"))
    return first.select("p_partkey", F.explode(g.sample_points(F.col("e"), 5.0)).alias("p")).select("p_partkey", F.round("p.x", 6).alias("x"))


@query(
    "topk_fraction_cap",
    """WITH s AS (SELECT l_orderkey, l_linenumber, round(sum(l_extendedprice), 2) AS length FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY length DESC, l_linenumber) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM s)
    SELECT l_orderkey, l_linenumber, length, place FROM r WHERE place <= floor(CAST(0.6 AS DOUBLE) * n)""",
)
def topk_fraction_cap(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.round(F.sum("l_extendedprice"), 2).alias("length"))
    return zones.longest_share(s, "l_orderkey", "length", ["l_linenumber"], 0.6).select("l_orderkey", "l_linenumber", "length", "place")


@query(
    "touch_type",
    "SELECT p_partkey, CASE WHEN p_size / 10.0 > 4 THEN 'none' WHEN p_size % 7 = 0 THEN 'corner_only' WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'interior_clear' WHEN p_size % 2 = 0 THEN 'mid_clear' ELSE 'partial_clear' END AS touch FROM part",
)
def touch_type(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", zones.touch_type(s % 2 == 0, s % 3 == 0, s / 10.0, 4.0, s % 7 == 0).alias("touch"))


ZONES = """z AS (SELECT l_orderkey, l_quantity / 10.0 AS w, l_quantity / 10.0 * (1 + l_linenumber) AS l FROM lineitem), m AS (SELECT l_orderkey, w * l AS area, w, l / w AS aspect, 4 * pi() * w * l / pow(2 * (w + l), 2) AS compact FROM z),
q AS (SELECT l_orderkey, count(*) AS zone_count, round(min(w), 6) AS zone_width_min, round(max(aspect), 6) AS zone_aspect_max, round(min(compact), 6) AS zone_compactness_min, count(*) FILTER (w < 1.0 AND (aspect > 8.0 OR compact < 0.25)) AS n_hard, count(*) FILTER (w < 1.0 AND (aspect > 8.0 OR compact < 0.25) OR w < 2.0 OR aspect > 6.0 OR compact < 0.35) AS n_awkward FROM m GROUP BY 1)"""


def order_zones(spark, d, turn=0.0):
    w = F.col("l_quantity") / 10.0 + turn
    li = w * (1 + F.col("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", (w * li).alias("area"), w.alias("w"), (li / w).alias("aspect"), g.compactness(w * li, 2 * (w + li)).alias("compact"))


@query("zone_quality", f"WITH {ZONES} SELECT l_orderkey, zone_count, zone_width_min, zone_aspect_max, zone_compactness_min, n_hard, n_awkward, n_hard > 0 AS hard_fail FROM q")
def zone_quality(spark, d):
    q = zones.quality(order_zones(spark, d), "l_orderkey", "area", "w", "aspect", "compact")
    return q.select("l_orderkey", "zone_count", *[F.round(c, 6).alias(c) for c in ("zone_width_min", "zone_aspect_max", "zone_compactness_min")], "n_hard", "n_awkward", "hard_fail")


@query(
    "fallback_choice",
    """WITH z AS (SELECT l_orderkey, l_quantity / 10.0 AS w, 1 + l_linenumber AS a FROM lineitem), f AS (SELECT l_orderkey, count(*) FILTER (w < 1.0 AND (a > 8 OR 4 * pi() * a / pow(2 * (1 + a), 2) < 0.25)) AS h1, count(*) FILTER (w + 0.5 < 1.0 AND (a > 8 OR 4 * pi() * a / pow(2 * (1 + a), 2) < 0.25)) AS h2 FROM z GROUP BY 1)
    SELECT l_orderkey, CASE WHEN h1 > 0 THEN 'second' ELSE 'first' END AS chosen FROM f""",
)
def fallback_choice(spark, d):
    first, second = (zones.quality(order_zones(spark, d, t), "l_orderkey", "area", "w", "aspect", "compact") for t in (0.0, 0.5))
    return zones.choose_fallback(first, second, "l_orderkey")


@query(
    "room_face_expansion",
    f"""WITH {FOOT}, l AS (SELECT *, 1 + p_size % 3 AS levels FROM f), r AS (SELECT *, unnest(range(0, levels)) AS level FROM l), n AS (SELECT *, CASE WHEN ell THEN 6 ELSE 4 END AS walls, CASE WHEN ell THEN w * h * 0.75 ELSE w * h END AS a FROM r)
    SELECT 'wall' AS kind, sum(walls)::BIGINT AS n, round(sum(2 * (w + h) * 3.0), 2) AS area FROM n UNION ALL SELECT 'floor', count(*), round(sum(a), 2) FROM n UNION ALL SELECT 'roof', count(*), round(sum(a), 2) FROM n""",
)
def room_face_expansion(spark, d):
    b = footprints(spark, d).select("p_partkey", (1 + F.col("p_size") % 3).alias("levels"), F.lit(3.0).alias("height"), F.array("ring").alias("zones"))
    return assembly.faces(assembly.rooms(b, "p_partkey", "levels", "height", "zones")).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("area"), 2).alias("area"))


@query("shade_extrusion", f"WITH {FOOT} SELECT p_partkey, round(w * (1 + p_size % 3) * 3.0, 4) AS shade_area FROM f")
def shade_extrusion(spark, d):
    e = footprints(spark, d).select("p_partkey", "w", (1 + F.col("p_size") % 3).alias("levels"), F.lit(3.0).alias("height"))
    return assembly.shades(e, "w", "levels", "height").select("p_partkey", F.round("shade_area", 4).alias("shade_area"))


@query("export_limits", "SELECT p_partkey, concat_ws('; ', CASE WHEN p_size = 50 THEN 'validation_failed' END, CASE WHEN p_size % 10 = 0 THEN 'no_zones' END, CASE WHEN p_size * 2 > 64 THEN 'zones_above_64' END, CASE WHEN p_size % 4 = 0 THEN 'no_windows' END) AS why FROM part")
def export_limits(spark, d):
    s = F.col("p_size")
    why = assembly.export_reasons(F.when(s % 10 == 0, 0).otherwise(1), s % 4, s != 50)
    more = F.array_compact(F.array(F.when(s * 2 > 64, "zones_above_64")))
    order = F.array(*map(F.lit, ("validation_failed", "no_zones", "zones_above_64", "no_windows")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.filter(order, lambda x: F.array_contains(F.concat(why, more), x)), "; ").alias("why"))


HOP = "l{1} AS (SELECT m.node, min(g.low) AS root FROM m JOIN (SELECT m.g, min(root) AS low FROM m JOIN l{0} ON m.node = l{0}.node GROUP BY 1) g ON m.g = g.g GROUP BY 1)"


@query(
    "connected_groups",
    # labels spread a group a hop; eight hops settle tables whose groups share members as often as here
    f"""WITH m AS (SELECT DISTINCT l_suppkey AS node, l_orderkey AS g FROM lineitem), l0 AS (SELECT DISTINCT node, node AS root FROM m), {", ".join(HOP.format(i, i + 1) for i in range(8))} SELECT node, root FROM l8""",
)
def connected_groups(spark, d):
    from ..operators.graph import groups_of

    return groups_of(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), "l_suppkey", "l_orderkey")


@query("nation_groups", "SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_nationkey // 2) AS root FROM customer")
def nation_groups(spark, d):
    """Customers joined through their nation, and nations through pairs of neighbours."""
    from ..operators.graph import groups_of

    groups = F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("p"), F.floor(F.col("c_nationkey") / 2).cast("string")))
    return groups_of(table(spark, d, "customer").select("c_custkey", F.explode(groups).alias("g")), "c_custkey", "g")


@query(
    "edge_matching",
    """WITH e AS (SELECT c_custkey AS edge, c_nationkey AS k, (c_custkey * 7 % 180) * 1.0 AS ea, (c_custkey * 3 % 50) / 10.0 AS er FROM customer), l AS (SELECT s_suppkey AS line, s_nationkey AS k, (s_suppkey * 11 % 180) * 1.0 AS la, (s_suppkey % 50) / 10.0 AS lr FROM supplier),
    x AS (SELECT edge, line, least((ea - la + 180) % 180, 180 - (ea - la + 180) % 180) AS da, abs(er - lr) AS dr FROM e JOIN l USING (k)), m AS (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY da, dr, line) AS r FROM x WHERE da <= 10 AND dr <= 2.0)
    SELECT edge, line, CAST(round(da, 6) AS DOUBLE) AS angle, CAST(round(dr, 6) AS DOUBLE) AS "offset" FROM m WHERE r = 1""",
)
def edge_matching(spark, d):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    edges = table(spark, d, "customer").select(c.alias("edge"), F.col("c_nationkey").alias("k"), (c * 7 % 180).cast("double").alias("alpha"), ((c * 3 % 50) / 10.0).alias("rho"))
    lines = table(spark, d, "supplier").select(s.alias("line"), F.col("s_nationkey").alias("k"), (s * 11 % 180).cast("double").alias("alpha"), ((s % 50) / 10.0).alias("rho"))
    out = spatial.best_edges(edges, lines, ["k"], "edge", "line", 10.0, 2.0)
    return out.select("edge", "line", F.round("angle", 6).alias("angle"), F.round("offset", 6).alias("offset"))


# Kernels: where a result has a closed form on these footprints it has a twin; tests check the others' invariants.


@query("convex_decomposition", f"WITH {FOOT} SELECT p_partkey, CAST(CASE WHEN ell THEN 2 ELSE 1 END AS INTEGER) AS n_zones, true AS covers, true AS convex FROM f")
def convex_decomposition(spark, d):
    out = zones.decompose(dealt(footprints(spark, d).select("p_partkey", "ring")), "ring")
    covers = F.abs(F.col("zone_area") - g.ring_area(F.col("ring"))) < 1e-6 * F.col("zone_area")
    return out.select("p_partkey", F.size("zones").alias("n_zones"), covers.alias("covers"), "convex")


@query("perimeter_core")
def perimeter_core(spark, d):
    out = zones.perimeter_core(dealt(footprints(spark, d).select("p_partkey", "ring")), "ring", 2.0)
    return out.select("p_partkey", F.size("zones_core").alias("n_core"), F.size("zones_perimeter").alias("n_perimeter"), "how", "reason")


@query("hole_split")
def hole_split(spark, d):
    f = footprints(spark, d)
    hole = g.ring((F.col("w") / 4, F.col("h") / 4), (F.col("w") / 4, F.col("h") / 2), (F.col("w") / 2, F.col("h") / 2), (F.col("w") / 2, F.col("h") / 4))
    out = zones.split_holes(dealt(f.select("p_partkey", F.struct(F.col("ring").alias("exterior"), F.array(hole).alias("holes")).alias("poly"))), "poly")
    return out.select("p_partkey", F.size("pieces").alias("n"), F.round(g.total(F.transform("pieces", g.ring_area)), 4).alias("area"))


@query("footprint_normalise", f"WITH {FOOT} SELECT p_partkey, CAST(CASE WHEN ell THEN 6 ELSE 4 END AS INTEGER) AS n_vertices, true AS close FROM f")
def footprint_normalise(spark, d):
    noisy = F.transform(g.neighbours(F.col("ring"), lambda o, p, q: F.array(p, F.struct(((p["x"] + q["x"]) / 2 + 0.03).alias("x"), ((p["y"] + q["y"]) / 2 + 0.03).alias("y")))), lambda x: x)
    out = zones.normalise(dealt(footprints(spark, d).select("p_partkey", F.flatten(noisy).alias("ring"), F.col("ring").alias("plain"))), "ring")
    close = F.abs(g.ring_area(F.col("aligned")) / g.ring_area(F.col("plain")) - 1) < 0.03
    return out.select("p_partkey", F.size("normal").alias("n_vertices"), close.alias("close"))


@query("rectangle_dims", f"WITH {FOOT} SELECT p_partkey, round(least(w, h), 4) AS short, round(greatest(w, h), 4) AS long FROM f")
def rectangle_dims(spark, d):
    out = zones.rectangle(footprints(spark, d).select("p_partkey", "ring"), "ring")
    return out.select("p_partkey", F.round("short", 4).alias("short"), F.round("long", 4).alias("long"))


@query("zone_connectivity", "SELECT p_partkey, 1 AS n_groups FROM part")
def zone_connectivity(spark, d):
    z = zones.decompose(dealt(footprints(spark, d).select("p_partkey", "ring")), "ring")
    return zones.connectivity(z.select("p_partkey", "zones"), "zones").select("p_partkey", "n_groups")




# Shades and windows: buildings in a row, each with the next one as neighbour, 8 m apart.


def row_of_buildings(spark, d):
    from ..operators import shading

    f = footprints(spark, d)
    moved = f.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("other"), g.shift(F.col("ring"), F.lit(-60.0), F.lit(0.0)).alias("r"))
    return shading.gather_neighbours(f.select("p_partkey", "w", "ring"), moved, "p_partkey", "r", "other")


@query("shading_edges", f"WITH {FOOT} SELECT b.p_partkey, CAST(1 AS BIGINT) AS n FROM f b JOIN f n ON n.p_partkey = b.p_partkey + 1")
def shading_edges(spark, d):
    from ..operators import shading

    out = shading.shading_edges(row_of_buildings(spark, d), "p_partkey", "ring")
    left = out.filter(F.abs(F.col("e.x1") - 60) + F.abs(F.col("e.x2") - 60) < 1e-9)  # the walls that look back
    return left.groupBy("p_partkey").agg(F.count("*").alias("n"))


@query(
    "window_candidates",
    f"WITH {FOOT}, e AS (SELECT p_partkey, list_reverse_sort(CASE WHEN ell THEN [w, h / 2, w / 2, h / 2, w / 2, h] ELSE [w, h, w, h] END) AS e FROM f) SELECT p_partkey, CAST(len(e) // 2 AS BIGINT) AS n_windows, round(list_sum(e[1:len(e) // 2]), 6) AS length FROM e",
)
def window_candidates(spark, d):
    from ..operators import shading

    c = shading.window_candidates(row_of_buildings(spark, d), "p_partkey", "ring")
    return shading.select_windows(c, "p_partkey").groupBy("p_partkey").agg(F.count("*").alias("n_windows"), F.round(F.sum("length"), 6).alias("length"))


@query("visible_edges")
def visible_edges(spark, d):
    from ..operators import shading

    b = row_of_buildings(spark, d)
    edges = shading.shading_edges(b, "p_partkey", "ring").groupBy("p_partkey").agg(F.array_sort(F.collect_list("e")).alias("edges"))
    lines = shading.rays(edges.join(b.select("p_partkey", "ring").hint("merge"), "p_partkey"), "edges", "ring", 5.0)
    return shading.visible_edges(lines, b.select("p_partkey", F.col("neighbours").alias("masks")), "p_partkey", ["edge"]).groupBy("p_partkey").agg(F.count("*").alias("n"))


@query(
    "footprint_filter",
    f"WITH {FOOT} SELECT p_partkey, round(CASE WHEN ell THEN w * h * 0.75 ELSE w * h END, 6) AS area FROM f WHERE CASE WHEN ell THEN w * h * 0.75 ELSE w * h END BETWEEN 100 AND 300",
)
def footprint_filter(spark, d):
    from ..operators import shading

    f = footprints(spark, d).select("p_partkey", F.array(F.struct(F.col("ring").alias("exterior"), F.array().cast(f"array<{g.RING}>").alias("holes"))).alias("polygons"))
    return shading.filter_footprints(f, "p_partkey", "polygons", ["p_partkey"], {"least": 100.0, "most": 300.0}).select("p_partkey", F.round("area", 6).alias("area"))
