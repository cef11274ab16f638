"""Joins of tables whose size Spark takes for less than it is (arrays count as one element, exploded rows as one): none is broadcast."""

from hearthframe import catalog
from hearthframe.functions import geometry as g
from hearthframe.operators import assembly, shading


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_room_parts_broadcasts_nothing(spark, sf):
    assert "Broadcast" not in plan(catalog.QUERIES["room_parts"](spark, sf))


def test_adjacent_walls_pairs_every_room_at_a_wall_and_no_null_keys(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    rows = [(1, 0, "a", ring), (1, 0, "b", ring[::-1]), (1, 0, "c", [(x + 4, y) for x, y in ring]), (1, 1, "d", ring), (1, 0, None, ring), (2, 0, "e", ring), (None, 0, "f", ring), (None, 0, "g", ring), (1, None, "h", ring), (1, None, "i", ring)]
    out = assembly.adjacent_walls(spark.createDataFrame(rows, f"k int, level int, room_id string, ring {g.RING}"), "k")
    assert sorted(map(tuple, out.collect())) == [(1, "a", "b"), (1, "a", "c"), (1, "b", "c")]


def test_vertex_neighbours_broadcasts_nothing(spark, sf):
    assert "Broadcast" not in plan(catalog.QUERIES["vertex_neighbours"](spark, sf))


def test_nearby_meets_across_cells_at_the_very_radius(spark):
    box = lambda x, y: [(x, y), (x + 10.0, y), (x + 10.0, y + 10.0), (x, y + 10.0)]
    own = spark.createDataFrame([(1, box(-5.0, -5.0)), (None, box(-5.0, 20.0))], f"k int, ring {g.RING}")
    others = spark.createDataFrame([(2, box(25.0, 5.0)), (3, box(25.1, -5.0)), (4, box(-31.0, -31.0)), (5, box(17.0, 21.0)), (6, box(17.0, 21.1)), (7, box(-5.0, -5.0)), (8, box(0.0, 0.0))], f"o int, ring {g.RING}")
    found = {r.o for r in shading.nearby(own, others, "k", "o", "ring").collect()}
    assert found == {2, 5}  # 2 at 20 m, 5 at 12 and 16 m; 3, 4 and 6 farther, 7 and 8 lie over the building


def test_visible_edges_broadcasts_nothing(spark, sf):
    assert "Broadcast" not in plan(catalog.QUERIES["visible_edges"](spark, sf))
