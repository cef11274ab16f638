"""Polygons: overlays against areas, zones of the fixture footprints, squaring up, neighbours."""

import math
import random

import pytest

from hearthframe.operators import kernels as k
from hearthframe.operators import overlay as o
from hearthframe.operators import perimeter, regularise, zones


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


ELL = [(0, 0), (20, 0), (20, 8), (8, 8), (8, 20), (0, 20)]
U = [(0, 0), (20, 0), (20, 20), (16, 20), (16, 4), (4, 4), (4, 20), (0, 20)]
RING = (box(0, 0, 20, 20), [box(6, 6, 8, 8)])
NOISY = [(0, 0.02), (10, -0.03), (20, 0.01), (20.03, 5), (19.98, 10), (10, 10.02), (0.02, 10), (-0.01, 5)]


def star(rng):
    cx, cy, n = rng.uniform(0, 20), rng.uniform(0, 20), rng.randint(3, 11)
    reach = [rng.uniform(2, 9) for _ in range(n)]
    return [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i, r in enumerate(reach)]


@pytest.mark.parametrize("seed", range(40))
def test_overlay_areas_agree(seed):
    rng = random.Random(seed)
    one, two, three = ([(star(rng), [])] for _ in range(3))
    both, all_, left = o.intersection(one, two), o.union(one, two), o.difference(one, two)
    assert o.size(both) + o.size(all_) == pytest.approx(o.size(one) + o.size(two), abs=1e-3)
    assert o.size(left) == pytest.approx(o.size(one) - o.size(both), abs=1e-3)
    assert o.size(o.union(all_, three)) == pytest.approx(o.size(o.union(one, o.union(two, three))), abs=1e-3)
    spots = [(rng.uniform(-5, 25), rng.uniform(-5, 25)) for _ in range(200)]
    import numpy as np

    inside = [o.contains(r, np.array(spots)) for r in (one, two, both, all_, left)]
    assert ((inside[0] & inside[1]) == inside[2]).all() and ((inside[0] | inside[1]) == inside[3]).all() and ((inside[0] & ~inside[1]) == inside[4]).all()


def test_overlay_of_touching_walls():
    assert o.union([(box(0, 0, 20, 20), [])], [(box(20, 0, 10, 20), [])]) == [(box(0, 0, 30, 20), [])]
    assert len(o.union([(box(0, 0, 20, 20), [])], [(box(20, 20, 10, 10), [])])) == 2
    hole = o.difference([(box(0, 0, 20, 20), [])], [(box(5, 5, 5, 5), [])])
    assert len(hole) == 1 and len(hole[0][1]) == 1 and o.size(hole) == pytest.approx(375)
    assert o.size(o.intersection([RING], [(box(0, 0, 10, 20), [])])) == pytest.approx(168)
    bow = o.made_valid([(0, 0), (10, 10), (10, 0), (0, 10)])
    assert len(bow) == 2 and o.size(bow) == pytest.approx(50)
    assert o.difference(hole, hole) == [] and o.union([]) == []


def test_offsets():
    assert o.size(o.offset([(ELL, [])], 2)) == pytest.approx(112)
    assert o.size(o.offset([(ELL, [])], -1)) == pytest.approx(340)
    assert o.size(o.offset([RING], 1)) == pytest.approx(18 * 18 - 100)
    assert o.offset([(box(0, 0, 20, 8), [])], 4.5) == []
    assert len(o.offset([(U, [])], 1.9)) == 1 and o.offset([(U, [])], 2.1) == []
    dumb = o.union([(box(0, 0, 10, 10), [])], o.union([(box(10, 4, 10, 2), [])], [(box(20, 0, 10, 10), [])]))
    assert len(o.offset(dumb, 1.5)) == 2 and o.size(o.opening(dumb, 1.5)) == pytest.approx(200)


def test_dissolve_closes_hairline_gaps():
    pair = [(box(0, 0, 20, 10), []), (box(20.05, 0, 10, 10), []), (box(60, 0, 0.5, 0.5), [])]
    out = o.dissolve(pair, 0.1, 1.0)
    assert len(out) == 1 and o.size(out) == pytest.approx(300.5)
    assert len(o.dissolve(pair, 0.0)) == 3


def test_holes_go_by_cuts_along_their_walls():
    for polygon in (RING, (box(0, 0, 30, 20), [box(4, 6, 6, 6), box(16, 8, 6, 6)]), (box(0, 0, 20, 20), [[(10, 4), (16, 10), (10, 16), (4, 10)]])):
        out = o.without_holes(polygon)
        assert all(not holes for _, holes in out) and o.size(out) == pytest.approx(o.size([polygon]), abs=1e-3)
    # the two shortest cuts of a centred square: both along a wall, so one cut splits it in two
    assert len(o.without_holes(RING)) == 2


def covered(polygon):
    made = perimeter.zones(polygon)
    rings = made["core"] + made["perimeter"]
    assert sum(abs(k.area(r)) for r in rings) == pytest.approx(o.size([polygon]), abs=1e-2)
    assert all(map(k.is_convex, made["core"]))
    return made


def test_zones_of_the_fixture_footprints():
    rect = covered((box(0, 0, 20, 8), []))
    assert (rect["how"], rect["reason"], rect["core"]) == ("perimeter_only_no_nominal_interior", "insufficient_exact_vertex_matches", [])
    square = covered((box(0, 0, 30, 30), []))
    assert (square["how"], square["reason"], len(square["core"]), len(square["perimeter"])) == ("perimeter_with_interior", "matched_trapezoids", 1, 4)
    ell = covered(([(2 * x, 2 * y) for x, y in ELL], []))
    assert (ell["reason"], len(ell["perimeter"])) == ("matched_trapezoids", 6)
    ring = covered((box(0, 0, 50, 50), [box(20, 20, 10, 10)]))
    assert (ring["reason"], len(ring["perimeter"])) == ("matched_trapezoids", 8)
    chamfer = covered(([(2, 0), (30, 0), (30, 30), (0, 30), (0, 2)], []))
    assert chamfer["reason"] == "matched_trapezoids_and_corners"
    for thin in (U, ELL, box(0, 0, 40, 1.5)):
        assert covered((thin, []))["how"] == "perimeter_only_no_nominal_interior"
    assert perimeter.zones((box(0, 0, 1, 1), []))["reason"] == "no_perimeter_geom"
    assert covered((box(0, 0, 10.9, 10.8), []))["reason"] == "discarded_small_interior_kept_as_single_zone"


def test_reason_codes(monkeypatch):
    square = (box(0, 0, 30, 30), [])
    made = perimeter.plan(square)
    none = perimeter.Plan("perimeter_only_no_nominal_interior")
    assert perimeter.subdivide(square, none)["reason"] == "insufficient_exact_vertex_matches"
    small = perimeter.Plan("perimeter_only_all_interiors_absorbed", [], made.nominal, ["interior_too_small"])
    assert perimeter.subdivide(square, small)["reason"] == "discarded_small_interior_kept_as_single_zone"
    with monkeypatch.context() as m:
        m.setattr(perimeter, "matched_corners", lambda *a: {})
        assert perimeter.subdivide(square, made)["reason"] == "insufficient_consecutive_matches"
        chamfer = ([(2, 0), (30, 0), (30, 30), (0, 30), (0, 2)], [])
        assert perimeter.subdivide(chamfer, perimeter.plan(chamfer))["reason"] == "collapsed_corner_parts"

    def broken(*_):
        raise ValueError("no")

    monkeypatch.setattr(perimeter, "subdivide", broken)
    failed = perimeter.zones(square)
    assert failed["reason"] == "subdivision_failed_fallback_to_unsplit_perimeter"
    assert sum(abs(k.area(r)) for r in failed["core"] + failed["perimeter"]) == pytest.approx(900)


def test_component_decisions():
    square = (box(0, 0, 30, 30), [])
    assert perimeter.decision((box(14, 14, 1, 1), []), square, 4.5) == "interior_too_small"
    assert perimeter.decision((box(5, 5, 20, 0.6), []), square, 4.5) == "interior_probe_disappeared"
    assert perimeter.decision((box(10, 10, 10, 10), []), square, 4.5) == "insufficient_boundary_contact_groups"
    assert perimeter.decision((box(4.5, 4.5, 21, 21), []), square, 4.5) == "kept"


@pytest.mark.parametrize("ring", [box(0, 0, 20, 10), ELL, U, box(0, 0, 40, 1.5)])
def test_convex_pieces_of_fixtures(ring):
    pieces = k.convex_pieces(ring)
    assert all(map(k.is_convex, pieces)) and sum(map(k.area, pieces)) == pytest.approx(k.area(ring))
    assert len(pieces) == {4: 1, 6: 2, 8: 3}[len(ring)]


@pytest.mark.parametrize("seed", range(25))
def test_convex_pieces_of_random_rings(seed):
    ring = k.counter_clockwise(star(random.Random(seed)))
    pieces = k.convex_pieces(ring)
    assert all(map(k.is_convex, pieces)) and sum(map(k.area, pieces)) == pytest.approx(k.area(k.clean(ring)), rel=0.01)


def test_search_pools():
    """A comb needs more cuts than the first depth allows; a search without patience ends in slabs."""
    comb = [(0, 0), (26, 0), (26, 10)]
    for x in range(24, 0, -4):
        comb += [(x, 10), (x, 4), (x - 2, 4), (x - 2, 10)]
    comb += [(0, 10)]
    pieces = k.convex_pieces(comb)
    assert all(map(k.is_convex, pieces)) and sum(map(k.area, pieces)) == pytest.approx(k.area(comb))
    slabs = k.convex_pieces(comb, most_failed=0)
    assert sum(map(k.area, slabs)) == pytest.approx(k.area(comb)) and len(pieces) <= len(slabs)


def test_walls_share_directions_and_lines():
    out, changed = regularise.aligned(k.normalise(NOISY))
    assert len(out) == 4 and k.area(out) == pytest.approx(200, rel=0.03)
    skew = [(0, 0), (20, 0.2), (20, 10), (0, 10)]
    out, changed = regularise.aligned(skew)
    assert changed and len({round(x, 6) for x in regularise.directions([regularise.normal_form(a, b)[::2] for a, b in zip(out, out[1:] + out[:1])])}) <= 2
    assert regularise.hausdorff(skew, out) <= 0.5
    far = [(0, 0), (20, 3), (20, 10), (0, 10)]  # nine degrees are another direction
    assert regularise.aligned(far) == (far, False)
    step = [(0, 0), (10, 0), (10, 0.15), (20, 0.15), (20, 10), (0, 10)]
    assert len(regularise.aligned(step)[0]) == 4  # both halves of the wall are one line
    assert regularise.directions([(179.5, 1.0), (0.5, 1.0), (90.0, 1.0)])[0] == pytest.approx(0.0, abs=1e-6)


def test_neighbours_fit_the_main_building():
    main = box(0, 0, 20, 10)
    terrace = regularise.on_shared_walls(box(20.05, 0, 10, 10), main)
    assert terrace[0] == pytest.approx((20, 0)) and terrace[3] == pytest.approx((20, 10))
    assert regularise.on_shared_walls(box(25, 0, 10, 10), main) == box(25, 0, 10, 10)
    assert regularise.without_overlap(box(19, 0, 10, 10), main) == box(20, 0, 9, 10)
    assert regularise.without_overlap(box(21, 0, 10, 10), main) == box(21, 0, 10, 10)
    near = [(20.3, 0.05), (50, 0.05), (50, 9.9), (20.3, 9.9)]
    aligned, changed = regularise.aligned(near, main)
    assert changed and aligned[0][0] == pytest.approx(20) and aligned[0][1] == pytest.approx(0)


def plain_rectangles(ring):
    """Boxes around the ring turned by every hull wall, the least first."""
    import numpy as np

    hull, found = k.hull(ring), []
    for a, b in zip(hull, hull[1:] + hull[:1]):
        t = math.atan2(b[1] - a[1], b[0] - a[0])
        p = np.array([(x * math.cos(t) + y * math.sin(t), y * math.cos(t) - x * math.sin(t)) for x, y in hull])
        w, h = np.ptp(p, axis=0)
        found.append((w * h, min(w, h), max(w, h)))
    return sorted(found)


def test_least_rectangles(spark):
    rng = random.Random(5)
    rings = [star(rng) for _ in range(200)] + [box(0, 0, 20, 10), [(0, 0), (10, 10), (5, 15), (-5, 5)]]
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in r]) for i, r in enumerate(rings)] + [(900, None), (901, []), (902, [{"x": 1.0, "y": 1.0}] * 3), (903, [{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 4.0}])], "i int, ring array<struct<x:double,y:double>>")
    out = {r.i: (r.short, r.long) for r in zones.rectangle(df, "ring").collect()}
    for i, r in enumerate(rings):
        boxes = plain_rectangles(r)
        area = boxes[0][0]
        assert out[i][0] * out[i][1] == pytest.approx(area) and out[i][0] <= out[i][1]
        assert any(out[i] == pytest.approx(b[1:], rel=1e-6) for b in boxes if b[0] <= area * (1 + 1e-9))
    assert out[900] == out[901] == out[902] == (0.0, 0.0) and out[903] == pytest.approx((0, 5))


def test_columns(spark):
    ring = "array<struct<x:double,y:double>>"
    as_rows = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    df = spark.createDataFrame([(1, as_rows(box(0, 0, 20, 10)), [as_rows(box(20.05, 0, 10, 10)), as_rows(box(19, 2, 5, 5))]), (2, None, None), (3, as_rows([(0, 0), (10, 10), (10, 0), (0, 10)]), [])], f"k int, ring {ring}, near array<{ring}>")
    fitted = {r.k: r.fitted for r in zones.fit_neighbours(df, "ring", "near").collect()}
    assert len(fitted[1]) == 2 and fitted[2] == [] and min(p.x for p in fitted[1][0]) == pytest.approx(20)
    parts = {r.k: r.parts for r in zones.valid_parts(df, "ring").collect()}
    assert [len(parts[j]) for j in (1, 2, 3)] == [1, 0, 2]
    assert {r.k: len(r.dissolved) for r in zones.dissolve(df, "near").collect()} == {1: 1, 2: 0, 3: 0}
    core = {r.k: r for r in zones.perimeter_core(df.filter("k < 3"), "ring").collect()}
    assert core[1].how == "perimeter_with_interior" or core[1].zones_perimeter
    assert core[2].how == "input_too_small" and core[2].zones_core == []
