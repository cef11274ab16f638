import datetime
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from hearthframe.operators import assembly, dims, graph, incremental, kernels, quality, rules, sampling, spatial, zones
from hearthframe.sources import sinks, tables
from hearthframe.streaming import hourly

RECT = [(0, 0), (20, 0), (20, 10), (0, 10)]
ELL = [(0, 0), (20, 0), (20, 8), (8, 8), (8, 20), (0, 20)]
U = [(0, 0), (20, 0), (20, 20), (16, 20), (16, 4), (4, 4), (4, 20), (0, 20)]
SLIVER = [(0, 0), (40, 0), (40, 1.5), (0, 1.5)]


@pytest.mark.parametrize("ring", [RECT, ELL, U, SLIVER])
def test_decomposition_covers_the_ring_with_convex_pieces(ring):
    pieces = kernels.convex_pieces(ring)
    assert all(map(kernels.is_convex, pieces))
    assert sum(map(kernels.area, pieces)) == pytest.approx(kernels.area(ring))


def test_kernels():
    hole = [(6, 6), (6, 14), (14, 14), (14, 6)]
    pieces = kernels.slabs([[(0, 0), (20, 0), (20, 20), (0, 20)], hole])
    assert sum(map(kernels.area, pieces)) == pytest.approx(400 - 64) and all(map(kernels.is_convex, pieces))
    noisy = [(0, 0), (10, 0.03), (20, 0), (20, 10), (10, 9.97), (0, 10)]
    assert len(kernels.normalise(noisy)) == 4
    assert kernels.distance(RECT, [(20.05, 0), (30, 0), (30, 10), (20.05, 10)]) == pytest.approx(0.05)
    assert kernels.distance(RECT, [(5, 5), (6, 5), (6, 6)]) == 0
    assert kernels.blocked((-5, 5), (25, 5), [RECT]) and not kernels.blocked((-5, 15), (25, 15), [RECT])
    assert kernels.zone_groups([RECT, [(20, 0), (30, 0), (30, 10), (20, 10)], [(50, 0), (60, 0), (60, 9)]]) == [0, 0, 1]
    corner = [RECT, [(20, 10), (30, 10), (30, 20), (20, 20)]]
    assert kernels.zone_groups(corner) == [0, 0] and kernels.zone_groups(corner, corners=False) == [0, 1]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_quality(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 10)], "k int, w int")
    with pytest.raises(quality.CheckFailed):
        quality.join_validated(b, a, ["k"])
    assert quality.join_validated(a, b, ["k"]).count() == 3
    assert rows(quality.orphans(a, "k", b, "k")) == [(2, 1)]
    assert rows(quality.outside_domain(a, "v", ["x", "y"])) == [(2, "z")]


def test_dims(spark):
    fact = spark.createDataFrame([("Holland", 1.0), ("FRANCE", 2.0), ("Mars", 3.0)], "c string, v double")
    dim = spark.createDataFrame([(1, "netherlands"), (2, "France")], "id int, name string")
    good, bad = dims.resolve_folded(fact, dim, "c", {"Holland": "Netherlands"}, "name", "cid")
    assert rows(good.select("v", "cid")) == [(1.0, 1), (2.0, 2)] and rows(bad.select("c")) == [("Mars",)]
    base = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k int, v double")
    assert rows(dims.update(base, spark.createDataFrame([(2, 9.0)], "k int, v double"), ["k"], ["v"])) == [(1, 5.0), (2, 9.0)]
    with pytest.raises(quality.CheckFailed):
        dims.update(base, spark.createDataFrame([(3, 9.0)], "k int, v double"), ["k"], ["v"])


def test_sampling(spark):
    w = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n bigint")
    assert rows(sampling.apportion(w, "k", "n", 4).select("k", "slots")) == [("a", 2), ("b", 1), ("c", 1)]
    pool = spark.range(30).select(F.col("id"), (F.col("id") % 2).alias("g"))
    targets = spark.createDataFrame([(0, 4), (1, 20)], "g bigint, target int")

    def draw(short, used):
        some = pool.join(used, "id", "left_anti").filter(F.col("id") % 3 != 2)
        return sampling.quota_sample(some, ["g"], ["id"], short).select("id", "g")

    found = sampling.retry(draw, targets, ["g"], pool.limit(0), "id")
    assert rows(found.groupBy("g").count()) == [(0, 4), (1, 10)]
    assert [r.id for r in sampling.page(pool, ["id"], 2, 5).collect()] == [5, 6, 7, 8, 9]
    assert sampling.seeded_subset(pool, "id", 5).count() == 5


def test_rules(spark):
    own = lambda **k: {f: F.lit(float(k.get(f, 0))) for f in ("mass", "wood", "steel", "metal")}
    pick = lambda e, m, h=None: spark.range(1).select(rules.template_family(F.lit(e), m, h or own())).first()[0]
    assert pick("FLOOR", own(metal=1)) == "mass"
    assert pick("WALL", own(mass=9, steel=0.1)) == "steel"
    assert pick("ROOF", own(mass=1, wood=1)) == "wood" and pick("WALL", own(mass=1, wood=1)) == "mass"
    assert pick("WALL", own(), own(metal=1)) == "metal"
    assert spark.range(1).select(rules.insulation(F.lit(0.5), F.lit(3.0)).alias("s")).first().s.clamped is True


def test_incremental(spark):
    names = spark.createDataFrame([(x,) for x in "abcd"], "k string")
    done = lambda s: spark.createDataFrame([(x,) for x in s], "k string")
    assert rows(incremental.resume_prefix(names, [done("abd"), done("abcd")], "k")) == [("a",), ("b",)]
    assert rows(incremental.resume_prefix(names, [done("abcd")], "k")) == [(x,) for x in "abcd"]
    assert rows(incremental.pending(names, done("abc"), done("ab"), done("a"), "k")) == [("a",), ("c",), ("d",)]
    kept, gone = incremental.exclude({"t": names}, done("bz"), "k")
    again, _ = incremental.exclude(kept, done("bz"), "k")
    assert rows(kept["t"]) == rows(again["t"]) == [("a",), ("c",), ("d",)] and rows(gone["t"]) == [("b",)]
    assert rows(incremental.unknown_selection(done("bz"), names, "k")) == [("z",)]
    assert rows(incremental.archive(done("b"), done("bc"), ["k"])) == [("b",), ("c",)]


def test_nearest_against_all_pairs(spark, monkeypatch):
    """Every left row once, repeated ones too; nulls, far rows, repeated places and equal distances."""
    import math
    import random

    rng = random.Random(3)
    cities = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(60)] + [(1, 50.0, 5.0), (1, 50.0, 5.0), (2, -30.0, 179.9), (3, None, 1.0), (4, 1.0, None), (None, 0.0, 0.0), (5, float("nan"), 1.0), (6, 90.0, 7.0)]
    dense = [(10_000 + k, 48 + rng.uniform(0, 0.5), 11 + rng.uniform(0, 0.5)) for k in range(700)]
    stations = dense + [(10, 51.0, 5.0), (9, 49.0, 5.0), (12, -30.0, -179.9), (13, None, 1.0), (None, 50.0, 5.0), (8, 48.2, 11.2), (7, 48.2, 11.2)]
    left = spark.createDataFrame(cities, "c int, lat double, lon double")
    right = spark.createDataFrame(stations, "s int, slat double, slon double")

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(h)))

    want = []
    for c, la, lo in cities:
        known = la is not None and lo is not None and not math.isnan(la)
        want.append((c, la, lo, *(min((metres(la, lo, y, x), s) for s, y, x in stations if s and y is not None) if known else (None, None))))
    for leaf in (1, 256, 100_000):
        monkeypatch.setattr(spatial, "LEAF", leaf)
        out = spatial.nearest(left, right, "c", "lat", "lon", "s", "slat", "slon")
        assert out.columns == ["c", "lat", "lon", "s", "distance_m"]
        got = sorted(map(tuple, out.collect()), key=repr)
        for g, w in zip(got, sorted(((c, la, lo, s, d) for c, la, lo, d, s in want), key=repr)):
            assert repr(g[:4]) == repr(w[:4]) and (g[4] is w[4] or g[4] == pytest.approx(w[4], abs=1e-3))
    assert all(r.s is None for r in spatial.nearest(left, right.limit(0), "c", "lat", "lon", "s", "slat", "slon").collect())
    assert spatial.nearest(left.limit(0), right, "c", "lat", "lon", "s", "slat", "slon").count() == 0


def test_match_or_nearest_has_no_limit(spark):
    left = spark.createDataFrame([(k, float(k % 70), float(k // 70)) for k in range(0, 6000, 7)] + [(None, 3.2, 4.1), (9_999, None, 1.0)], "k int, x double, y double")
    right = spark.createDataFrame([(k, float(k % 70), float(k // 70)) for k in range(0, 6000, 2)], "k int, x double, y double")
    out = {(r.k, r.how): r for r in spatial.match_or_nearest(left, right, "k", "x", "y").collect()}
    assert len(out) == left.count()
    assert all(r.matched == r.k for (k, how), r in out.items() if how == "id")
    for (k, how), r in out.items():
        if how == "nearest" and r.x is not None:
            near = min((((r.x - j % 70) ** 2 + (r.y - j // 70) ** 2), j) for j in range(0, 6000, 2))
            assert r.matched == near[1], k
    assert out[9_999, "nearest"].matched is None


def test_groups_over_long_chains(spark):
    members = spark.createDataFrame([(k + d, f"g{k}") for k in range(0, 700) for d in (0, 1)] + [(5000, "x"), (5001, "y"), (5002, "y"), (None, "y"), (7, None)], "n int, g string")
    got = {r.node: r.root for r in graph.groups_of(members, "n", "g").collect()}
    assert got == {k: 0 for k in range(701)} | {5000: 5000, 5001: 5001, 5002: 5001}
    assert graph.groups_of(members.limit(0), "n", "g").count() == 0


def test_spatial(spark):
    px = spark.createDataFrame([(0, 0, 1.0), (0, 1, -9.0)], "row int, col int, value double")
    pt = spark.createDataFrame([(1, 0.5, 9.5), (2, 1.5, 9.5), (3, 50.0, 9.5)], "k int, x double, y double")
    assert rows(spatial.sample_raster(pt, "x", "y", px, 0.0, 10.0, 1.0, -9.0, "v", True).select("k", "v")) == [(1, 1.0)]
    assert spatial.sample_raster(pt, "x", "y", px, 0.0, 10.0, 1.0, -9.0, "v", False).count() == 3
    fine = spatial.resample(px, 2)
    assert fine.count() == 8 and rows(spatial.resample(fine, 0.5)) == rows(px)
    tiles = spark.createDataFrame([(0, 0, 5.0, 2), (0, 0, 7.0, 1)], "row int, col int, value double, tile int")
    assert rows(spatial.mosaic(tiles, "tile")) == [(0, 0, 7.0)]
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 5.0, 5.0), (7, 9.0, 8.0)], "k int, x double, y double")
    assert rows(spatial.match_or_nearest(a, b, "k", "x", "y").select("k", "matched", "how")) == [(1, 1, "id"), (2, 7, "nearest")]


def test_models(spark):
    ring = [{"x": float(x), "y": float(y)} for x, y in RECT]
    b = spark.createDataFrame([("b1", 2, 3.0, [ring])], "k string, levels int, h double, zones array<array<struct<x:double,y:double>>>")
    rooms = assembly.rooms(b, "k", "levels", "h", "zones")
    assert rows(rooms.select("room_id", "area", "volume")) == [("b1_z0_L0", 200.0, 600.0), ("b1_z0_L1", 200.0, 600.0)]
    assert rows(assembly.adjacent_floors(rooms, "k")) == [("b1", "b1_z0_L0", "b1_z0_L1")]
    walls = assembly.faces(rooms)
    assert walls.filter("kind = 'wall'").agg(F.sum("area")).first()[0] == 2 * 60 * 3.0
    assert assembly.windows(walls, F.lit(0.2)).agg(F.sum("window_area")).first()[0] == pytest.approx(72)
    q = zones.quality(spark.createDataFrame([("a", 1.0, 0.5, 9.0, 0.2)], "k string, area double, w double, asp double, c double"), "k", "area", "w", "asp", "c")
    assert q.first().hard_fail is True
    members = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "y"), (9, "z")], "n int, g string")
    assert rows(graph.groups_of(members, "n", "g")) == [(1, 1), (2, 1), (3, 1), (9, 9)]


def test_faces_look_outside(spark):
    ring = lambda pts: [{"x": float(x), "y": float(y)} for x, y in pts]
    other = [(20, 0), (30, 0), (30, 10), (20, 10)]
    zones_ = [[ring(RECT)], [ring(list(reversed(other))), ring([(50, 0), (60, 0), (60, 10)])]]
    b = spark.createDataFrame([("t_1", 2, 3.0, zones_)], "k string, levels int, h double, zones array<array<array<struct<x:double,y:double>>>>")
    room = assembly.rooms(b, "k", "levels", "h", "zones")
    assert sorted(r.room_id for r in room.filter("level = 1").collect()) == ["t_1_z0_L1", "t_1_z1_p0_L1", "t_1_z1_p1_L1"]
    assert rows(assembly.adjacent_walls(room, "k")) == [("t_1", f"t_1_z0_L{i}", f"t_1_z1_p0_L{i}") for i in (0, 1)]
    assert assembly.adjacent_floors(room, "k").count() == 3
    centre = {r.room_id: (sum(p.x for p in r.ring) / len(r.ring), sum(p.y for p in r.ring) / len(r.ring), (r.floor_z + r.ceiling_z) / 2) for r in room.collect()}
    for f in assembly.faces(room).collect():
        a, c, d = (tuple(f.boundary[i]) for i in (0, 1, 2))
        u, v = [q - p for p, q in zip(a, c)], [q - p for p, q in zip(c, d)]
        normal = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
        out = [p - q for p, q in zip(a, centre[f.room_id])]
        assert sum(x * y for x, y in zip(normal, out)) > 0, f
        assert (f.kind == "floor") == (normal[2] < 0) and (f.kind == "roof") == (normal[2] > 0)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k|v|w\n1|x|q\n2||q\n")
    df = tables.read_delimited(spark, str(tmp_path / "a.csv"), "k int, v string, w string", "|", ["k", "v"])
    assert rows(df) == [(1, "x"), (2, None)]
    sheets, absent = tables.read_sheets(spark, {"one": str(tmp_path / "a.csv")}, "k int", ["one", "two"])
    assert absent == ["two"] and sheets.count() == 2
    assert tables.find_column(["Country", "Building type"], ["type"]) == "Building type"
    assert tables.project_existing(df, ["v", "none", "v", "k"]).columns == ["v", "k"]
    assert tables.read_if_exists(spark, str(tmp_path / "none"), "k int").count() == 0
    con = sqlite3.connect(tmp_path / "b1out.sql")
    con.executescript("CREATE TABLE t (n TEXT, v REAL); INSERT INTO t VALUES ('a', 1.5), ('b', 2.5);")
    con.commit(), con.close()
    (tmp_path / "bad.sql").write_bytes(b"not a database")
    found, errors = tables.sqlite_query(spark, str(tmp_path), "*.sql", "SELECT n, v FROM t", "n string, v double")
    assert rows(found.select("n", "v")) == [("a", 1.5), ("b", 2.5)] and errors.count() == 1
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("w.epw", "LOCATION,Town,-,X,SRC,1,50.5,4.25,1.0,100\n"), z.writestr("x.epw", "y")
    members = tables.zip_members(spark, str(tmp_path))
    assert members.select(tables.choose_member(F.col("names"), F.col("path"), ".epw")).first()[0] == "w.epw"
    head = tables.weather_header(spark.createDataFrame([("LOCATION,Town,-,X,SRC,1,50.5,4.25,1.0,100",), ("DESIGN,1",)], "value string")).first()
    assert (head.site, head.lat, head.lon, head.elevation) == ("Town", 50.5, 4.25, 100.0)
    objects = tables.model_objects(spark.createDataFrame([("m", "Zone, a; ! x;\nZone, b;\nWall,\n c;")], "id string, text string"), "text")
    assert rows(tables.object_counts(objects, ["id"])) == [("m", "wall", 1), ("m", "zone", 2)]
    js = spark.createDataFrame([("m", json.dumps({"Zone": {"a": {}, "b": {}}}))], "id string, text string")
    assert rows(tables.json_object_counts(js, "text")) == [("m", "Zone", 2)]
    files = tables.file_listing(spark, str(tmp_path), "*.sql")
    assert sorted(r.stem for r in files.collect()) == ["b1out", "bad"]
    path = str(tmp_path / "bundle")
    sinks.write_bundle({"a": spark.range(2), "b": spark.range(3)}, path)
    with pytest.raises(quality.CheckFailed):
        sinks.write_bundle({"a": spark.range(9)}, path, {"never": spark.range(1)})
    sinks.append_bundle({"a": spark.range(4)}, path, "id")
    assert sinks.read_bundle(spark, path, ["a"])["a"].count() == 4
    with pytest.raises(FileNotFoundError):
        sinks.read_bundle(spark, path, ["zzz"])
    assert sinks.resume_mode(False, "error") == "overwrite"
    with pytest.raises(FileExistsError):
        sinks.resume_mode(True, "error")


def test_streaming(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    data = [(k, t0 + datetime.timedelta(minutes=20 * k), k % 2, float(k)) for k in range(12)]
    spark.createDataFrame(data, "id bigint, ts timestamp, g bigint, value double").write.parquet(str(tmp_path / "in"))
    stream = hourly.event_stream(spark, str(tmp_path / "in"), "id bigint, ts timestamp, g bigint, value double")
    q = hourly.hourly_totals(stream, "ts", ["g"], "value", "0 seconds").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("hours").agg(F.sum("n")).first()[0] == 12
    write = hourly.upsert_sink(str(tmp_path / "log"), ["g"])
    one = spark.createDataFrame([(1, "failed"), (2, "ok")], "g int, status string")
    assert hourly.upserted(spark, str(tmp_path / "log"), ["g"], one.schema).count() == 0
    write(one, 0), write(spark.createDataFrame([(1, "success")], "g int, status string"), 1)
    assert rows(spark.read.parquet(str(tmp_path / "log" / "v=1"))) == [(1, "success")]  # a batch writes its own rows only
    want = [(1, "success"), (2, "ok")]
    assert rows(hourly.upserted(spark, str(tmp_path / "log"), ["g"], one.schema)) == want
    write(spark.createDataFrame([(1, "success")], "g int, status string"), 1)
    assert rows(hourly.upserted(spark, str(tmp_path / "log"), ["g"], one.schema)) == want
    hourly.compact(spark, str(tmp_path / "log"), ["g"], 1)
    assert rows(hourly.upserted(spark, str(tmp_path / "log"), ["g"], one.schema)) == want and not (tmp_path / "log" / "v=0").exists()


def ring_of(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_shading(spark):
    from hearthframe.functions import geometry as g
    from hearthframe.operators import shading

    far = [(28, 0), (38, 0), (38, 10), (28, 10)]
    b = spark.createDataFrame([(1, ring_of(RECT)), (2, ring_of(RECT))], f"k int, ring {g.RING}")
    n = spark.createDataFrame([(1, 7, ring_of(far))], f"k int, other int, r {g.RING}")
    rows_ = shading.gather_neighbours(b, n, "k", "r", "other")
    edges = shading.shading_edges(rows_, "k", "ring").collect()
    back = [e for e in edges if e.e.x1 == e.e.x2 == 28]
    assert len(back) == 1 and back[0].distance == pytest.approx(8) and back[0].facing_score > 0.9
    assert not any(e.e.x1 == e.e.x2 == 38 for e in edges)
    sight = spark.createDataFrame([(1, [tuple(map(float, (0, 28, 0, 28, 10, 10)))], ring_of(RECT))], "k int, edges array<struct<edge:int,x1:double,y1:double,x2:double,y2:double,length:double>>, ring array<struct<x:double,y:double>>".replace("edge:int", "edge:double"))
    lines = shading.rays(sight, "edges", "ring", 5.0)
    assert lines.count() == 3 and all(r.x2 == pytest.approx(20) for r in lines.collect())
    wall = [[(22, -5), (24, -5), (24, 30), (22, 30)]]
    mask = lambda m: spark.createDataFrame([(1, [ring_of(r) for r in m])], f"k int, masks array<{g.RING}>")
    assert shading.visible_edges(lines, mask(wall), "k", ["edge"]).count() == 0
    assert shading.visible_edges(lines, mask([]), "k", ["edge"]).count() == 1
    touching = shading.gather_neighbours(b.filter("k = 1"), spark.createDataFrame([(1, 7, ring_of([(20, 0), (30, 0), (30, 10), (20, 10)]))], f"k int, other int, r {g.RING}"), "k", "r", "other")
    touch = {r.edge: r.touch for r in shading.window_candidates(touching, "k", "ring").collect()}
    assert touch[1] == "partial_clear" and touch[3] == "none" and touch[0] == "corner_only"
    assert {r.edge for r in shading.select_windows(shading.window_candidates(touching, "k", "ring"), "k", 1.0).collect()} == {0, 2, 3}
    e = lambda x1, y1, x2, y2: {"edge": 0, "x1": float(x1), "y1": float(y1), "x2": float(x2), "y2": float(y2), "length": float(abs(x2 - x1) + abs(y2 - y1))}
    walls = spark.createDataFrame([(1, e(0, 0, 10, 0)), (1, e(0, 5, 10, 5)), (2, e(0, 0, 10, 0))], f"k int, e {shading.EDGE}")
    windows = spark.createDataFrame([(1, e(2, 0.05, 6, 0.05))], f"k int, e {shading.EDGE}")
    assert [(r.k, r.e.y1) for r in shading.walls_of_windows(windows, walls, "k").collect()] == [(1, 0.0)]
    runs = spark.createDataFrame([([True, False, True, True],), ([True] * 3,), ([False] * 3,), ([True, False, True, False],)], "t array<boolean>").select(shading.contact_runs(F.col("t")))
    assert [r[0] for r in runs.collect()] == [1, 1, 0, 2]
    assert spark.range(1).select(shading.decomposition_input(F.array(), F.array(F.lit(1)), F.lit(1))).first()[0] == "perimeter"


def test_weather_models_and_reviews(spark):
    from hearthframe.operators import weather

    cat = spark.createDataFrame([("A", "1", "2", "http://h/a.2007-2021.zip"), ("A", "1", "2", "http://h/a.zip"), ("B", "x", "2", "http://h/b.zip"), ("C", "1", "1", " ")], "n string, la string, lo string, u string")
    assert rows(weather.stations(cat, "n", "la", "lo", "u")) == [("A", 1.0, 2.0, "http://h/a.zip")]
    assert weather.bad_links(spark.createDataFrame([("x.zip",), ("x.ZIP ",), ("x.html",), (None,)], "u string"), "u").count() == 2
    archives = spark.createDataFrame([("d/a.zip", ["a.epw", "b.epw", "a.ddy"]), ("d/b.zip", ["x.epw", "y.epw", "y.ddy"])], "path string, names array<string>")
    good, bad = weather.preflight(archives, spark.createDataFrame([("d/a.zip",), ("d/b.zip",), ("d/c.zip",)], "path string"))
    assert rows(good) == [("d/a.zip", "a.epw", "a.ddy")]
    assert rows(bad) == [("d/b.zip", "no_single_epw"), ("d/c.zip", "archive_missing")]
    assert weather.city_files(spark.createDataFrame([("x", "d/a.zip"), ("y", "d/a.zip")], "city string, path string"), good).count() == 2
    chosen = spark.createDataFrame([("a", 1), ("b", 2)], "k string, place int")
    new = spark.createDataFrame([("b", 1), ("c", 2), ("c", 3)], "k string, place int")
    assert rows(incremental.select_more(chosen, new, "k")) == [("a", 1), ("b", 2), ("c", 4)]
    assert rows(incremental.select_less(chosen, new, "k")) == [("a", 1)]
    assert incremental.concat([], "k int", spark).count() == 0 and incremental.concat([chosen, new], chosen.schema, spark).count() == 5


STATUSES = {
    "missing_hbjson": {}, "missing_epw": {"model"}, "missing_ddy": {"model", "weather"},
    "skipped_existing": {"idf", "epjson"}, "validated_existing": {"idf", "epjson", "validate", "idf_valid", "epjson_valid"}, "invalid_existing": {"idf", "epjson", "validate", "idf_valid"},
    "idf_validation_failed": {"idf"}, "epjson_not_generated": {"idf", "idf_valid"}, "epjson_structure_failed": {"idf", "idf_valid", "made_epjson", "need_hvac", "idf_hvac"}, "restored_missing_epjson": {"idf", "idf_valid", "made_epjson"},
    "epjson_validation_failed": {"epjson"}, "idf_not_generated": {"epjson", "epjson_valid"}, "idf_structure_failed": {"epjson", "epjson_valid", "made_idf", "need_hvac", "epjson_hvac"}, "restored_missing_idf": {"epjson", "epjson_valid", "made_idf"},
    "converted": {"made_idf", "idf_valid", "made_epjson", "epjson_valid"}, "conversion_failed": {"failed", "made_idf"},
}


def test_conversion_statuses(spark):
    names = "model weather design idf epjson overwrite need_hvac validate idf_hvac idf_valid epjson_hvac epjson_valid made_idf made_epjson failed".split()
    there = {"model", "weather", "design"}
    data = [(want, *[n in (on if want.startswith("missing_") else on | there) for n in names]) for want, on in STATUSES.items()]
    # files without a needed air system are not reused, nor are any when overwriting
    data += [("converted", *[n in there | {"idf", "epjson", "need_hvac", "made_idf", "idf_hvac", "idf_valid", "made_epjson", "epjson_hvac", "epjson_valid", "overwrite"} for n in names])]
    data += [("idf_structure_failed", *[n in there | {"idf", "epjson", "need_hvac", "made_idf"} for n in names]), ("unknown", *[None] * len(names))]
    df = spark.createDataFrame(data, "want string, " + ", ".join(f"{n} boolean" for n in names))
    for r in df.select("want", incremental.conversion_status(**{n: F.col(n) for n in names}).alias("got")).collect():
        assert r.want == r.got


def test_opaque_constructions(spark):
    layers = [("wall", 0, "Brick", 0.2), ("wall", 1, "Typical Insulation R1", 2.0), ("wall", 2, "Gypsum", 0.1), ("bare", 0, "Brick", 0.2), ("bare", 1, "Wood", 0.5), ("two", 0, "Typical Insulation A", 1.0), ("two", 1, "Typical Insulation B", 1.0), ("dark", 0, "Stone", None)]
    layers = spark.createDataFrame(layers, "construction string, position int, material string, r double")
    materials = spark.createDataFrame([("Typical Insulation",), ("Typical Insulation R1",), ("Typical Insulation A",), ("Foam",)], "material string")
    targets = [(1, "wall", 0.5, "replace", None, None), (2, "bare", 0.5, "insert", "Foam", 0), (3, "bare", 0.5, "insert", None, None), (4, "wall", 9.0, "replace", None, None), (5, "two", 0.5, "replace", None, None), (6, "none", 0.5, "replace", None, None), (7, "bare", 0.5, "insert", "Straw", None), (8, "dark", 0.5, "insert", "Foam", None), (9, "wall", 0.5, "stack", None, None), (10, "wall", None, "replace", None, None), (11, "bare", 0.5, "replace", None, None)]
    targets = spark.createDataFrame(targets, "k int, construction string, u_target double, mode string, donor string, insert_after int")
    good, bad = rules.opaque_constructions(targets, layers, materials, "k")
    got = {r.k: r for r in good.collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1].layers == ["Brick", "insulation 1", "Gypsum"] and got[1].r_insulation == pytest.approx(1.7) and got[1].u_value == pytest.approx(0.5) and not got[1].clamped
    assert got[2].layers == ["Brick", "insulation 2", "Wood"] and got[3].layers == ["Brick", "Wood", "insulation 3"] and got[2].r_fixed == pytest.approx(0.7)
    assert got[4].clamped and got[4].r_insulation == 1e-4 and got[4].u_diff == pytest.approx(9 - 1 / 0.3001)
    assert {r.k: r.error for r in bad.collect()} == {5: "expected one insulation layer, found 2", 6: "unknown construction", 7: "unknown donor", 8: "unknown resistance", 9: "unsupported mode stack", 10: "no target", 11: "expected one insulation layer, found 0"}


def test_construction_sets(spark):
    parts = ("wall", "roof", "floor", "window")
    good = {p: (json.dumps({"identifier": f"c_{p}", "materials": ["Brick", f"ins_{p}"]}), json.dumps({"identifier": f"ins_{p}"})) for p in parts}
    as_row = lambda key, parts_: (key, *[x for p in parts for x in parts_[p]])
    rows_ = [
        as_row("town_1", good),
        as_row("town_2", good | {"roof": (str({"identifier": "c", "materials": ["Brick", "ins_roof"], "x": None}), str({"identifier": "ins_roof", "it's": True}))}),
        as_row("town_3", good | {"wall": ("{", good["wall"][1])}),
        as_row("town_4", good | {"floor": (json.dumps({"materials": ["Brick"]}), good["floor"][1])}),
        as_row("town_5", good | {"floor": (json.dumps({"materials": ["Straw", "ins_floor"]}), good["floor"][1])}),
        as_row("town_6", good | {"window": (None, None)}),
    ]
    df = spark.createDataFrame(rows_, "k string, " + ", ".join(f"{p}_construction string, {p}_material string" for p in parts))
    made, bad = assembly.construction_sets(df, "k", spark.createDataFrame([("Brick",)], "material string"))
    sets = {r.k: json.loads(r.construction_set) for r in made.collect()}
    assert sorted(sets) == ["town_1", "town_2"] and sets["town_1"]["identifier"] == "cs_1"
    assert sets["town_1"]["roof_ceiling_set"] == {"exterior_construction": "c_roof"} and sets["town_1"]["aperture_set"]["skylight_construction"] == "c_window"
    assert {r.k: r.construction_error for r in bad.collect()} == {"town_3": "invalid wall construction or material", "town_4": "floor construction lacks its generated material", "town_5": "unknown floor material Straw", "town_6": "invalid window construction or material"}


def test_programs_and_windows(spark):
    b = spark.createDataFrame([(1, ["a::X::S", "b::Y::S"]), (2, ["z::Z::S", "b::Y::S"]), (3, ["q::Q::S"]), (3, ["q::Q::S"])], "k int, c array<string>")
    named, unnamed = rules.programs(b, F.col("c"), spark.createDataFrame([("a::X::S",), ("b::Y::S",), ("b::Y::S",)], "program string"))
    assert rows(named.select("k", "program", "program_type", "fallback", "heating_air_c")) == [(1, "a::X::S", "X", False, 50.0), (2, "b::Y::S", "Y", True, 50.0)]
    assert rows(unnamed.select("k", "candidates")) == [(3, "q::Q::S")] * 2
    kinds = spark.createDataFrame([(1, 0.3, 1.5), (3, 0.2, 1.0), (5, None, 1.0)], "t int, ratio double, height double")
    b = spark.createDataFrame([(1, 1, True), (2, 9, True), (3, 9, False), (4, 5, True), (5, None, True)], "k int, t int, res boolean")
    found, lost = assembly.window_parameters(b, kinds, "t", F.col("res"), ["ratio", "height"])
    assert rows(found.select("k", "ratio")) == [(1, 0.3), (2, 0.2), (4, 0.2), (5, 0.2)] and [r.k for r in lost.collect()] == [3]


def test_neighbours_by_vertices(spark):
    from hearthframe.functions import geometry as g
    from hearthframe.operators import shading

    move = lambda dx, dy=0: ring_of([(x + dx, y + dy) for x, y in RECT])
    b = spark.createDataFrame([(1, move(0))], f"k int, ring {g.RING}")
    others = spark.createDataFrame([(11, move(30)), (12, move(30)), (13, move(45)), (14, move(0.5)), (15, move(20)), (16, move(0)), (17, move(0, -29))], f"o int, ring {g.RING}")
    out = shading.nearby(b, others, "k", "o", "ring")
    assert sorted(r.o for r in out.collect()) == [11, 15, 17]


def test_weather_archives_are_sniffed(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.epw", "\ufeffLOCATION,Town\n"), z.writestr("b.epw", "not weather"), z.writestr("a.ddy", "x\nSizingPeriod:DesignDay,"), z.writestr("c.ddy", "none")
    (tmp_path / "b.zip").write_bytes(b"PK nothing")
    out = {r.path.rpartition("/")[2]: r for r in tables.zip_members(spark, str(tmp_path)).collect()}
    assert (out["a.zip"].epw, out["a.zip"].ddy) == (["a.epw"], ["a.ddy"]) and out["b.zip"].error
    tables.put_bytes(spark, str(tmp_path / "c.json"), b'{"a": 1, "b": [2]}')
    assert tables.read_json_config(spark, str(tmp_path / "c.json"), {"a": int})["b"] == [2]
    with pytest.raises(ValueError):
        tables.read_json_config(spark, str(tmp_path / "c.json"), {"b": dict})


def test_resume_modes():
    assert sinks.resume_mode(True, "ask") == "continue" and sinks.resume_mode(True, "ask", " Yes") == "continue" and sinks.resume_mode(True, "ask", "n") == "overwrite"
    assert sinks.resume_mode(False, "ask") == "overwrite"
    with pytest.raises(ValueError):
        sinks.resume_mode(True, "what")
