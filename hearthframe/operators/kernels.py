"""Ring kernels in NumPy, for steps that loop over a ring in ways column expressions can't.

A ring is a list of (x, y) without a closing point; zones are lists of rings. The column
wrapper ``ring_pass`` runs a kernel in one Arrow pass, row by row and without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..session import ship

Ring = list[tuple[float, float]]
EPS = 1e-9


def area(ring: Ring) -> float:
    """Signed; positive is counter-clockwise."""
    if len(ring) < 3:
        return 0.0
    return sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])) / 2


def length(ring: Ring) -> float:
    return sum(math.dist(a, b) for a, b in zip(ring, ring[1:] + ring[:1]))


def counter_clockwise(ring: Ring) -> Ring:
    return list(ring) if area(ring) >= 0 else list(reversed(ring))


def cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull(points) -> Ring:
    pts = sorted(set(map(tuple, points)))
    if len(pts) < 3:
        return pts
    half = []
    for seq in (pts, pts[::-1]):
        chain: Ring = []
        for p in seq:
            while len(chain) > 1 and cross(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        half.append(chain[:-1])
    return half[0] + half[1]


def compact(ring: Ring) -> float:
    size = length(ring)
    return 4 * math.pi * abs(area(ring)) / size**2 if size else 0.0


def clean(ring: Ring, shortest: float = 0.01, straight_deg: float = 1.0) -> Ring:
    """Without edges under ``shortest`` and vertices within ``straight_deg`` of a straight line; three vertices always stay."""
    out, k, kept = list(ring), 0, 0  # kept: vertices in a row that stayed
    sine = math.sin(math.radians(straight_deg))
    while len(out) > 3 and kept < len(out):
        k %= len(out)
        a, b, c = out[k - 1], out[k], out[(k + 1) % len(out)]
        first, second = math.dist(a, b), math.dist(b, c)
        ahead = (b[0] - a[0]) * (c[0] - b[0]) + (b[1] - a[1]) * (c[1] - b[1]) > 0
        if first < shortest or (ahead and abs(cross(a, b, c)) < sine * first * second):
            del out[k]
            k, kept = max(k - 1, 0), 0
        else:
            k, kept = k + 1, kept + 1
    return out


def simplify(ring: Ring, tolerance: float) -> Ring:
    """Douglas and Peucker's rule on a ring, from its two farthest vertices."""
    if len(ring) < 4:
        return list(ring)
    start = max(range(len(ring)), key=lambda k: math.dist(ring[0], ring[k]))
    halves = ring[: start + 1], ring[start:] + ring[:1]

    def line(pts):
        if len(pts) < 3:
            return pts
        a, b = pts[0], pts[-1]
        base = math.dist(a, b)
        off = [abs(cross(a, b, p)) / base if base > EPS else math.dist(a, p) for p in pts[1:-1]]
        k = max(range(len(off)), key=off.__getitem__)
        return [a, b] if off[k] <= tolerance else line(pts[: k + 2])[:-1] + line(pts[k + 1 :])

    out = line(halves[0])[:-1] + line(halves[1])[:-1]
    return out if len(out) >= 3 else list(ring)


def crosses_itself(ring: Ring) -> bool:
    n = len(ring)
    for i in range(n):
        a, b = ring[i], ring[(i + 1) % n]
        for j in range(i + 2, n - (i == 0)):
            c, d = ring[j], ring[(j + 1) % n]
            if cross(a, b, c) * cross(a, b, d) < -EPS and cross(c, d, a) * cross(c, d, b) < -EPS:
                return True
    return False


def normalise(ring: Ring, tolerance: float = 0.2, most_m2: float = 3.0, most_share: float = 0.03) -> Ring:
    """Simplified and cleaned, unless the area changes by more than the larger of the two limits."""
    size = abs(area(ring))
    best = list(ring)
    for _ in range(8):
        new = clean(simplify(best, tolerance), tolerance)
        if abs(abs(area(new)) - size) > max(most_m2, most_share * size) or crosses_itself(new):
            break
        if len(new) == len(best):
            return new
        best = new
    return best


def is_convex(ring: Ring, tolerance: float = 1e-6) -> bool:
    r = counter_clockwise(ring)
    return all(cross(r[k - 1], r[k], r[(k + 1) % len(r)]) >= -tolerance for k in range(len(r)))


def reflex(ring: Ring) -> list[int]:
    """Reflex vertices of a counter-clockwise ring, those nearest to a right angle first."""
    found = []
    for k in range(len(ring)):
        o, p, q = ring[k - 1], ring[k], ring[(k + 1) % len(ring)]
        if cross(o, p, q) < -1e-6:
            turn = math.degrees(math.atan2(-cross(o, p, q), (p[0] - o[0]) * (q[0] - p[0]) + (p[1] - o[1]) * (q[1] - p[1])))
            found.append((abs(turn - 90), k))
    return [k for _, k in sorted(found)]


def cut_from(ring: Ring, k: int, direction: tuple[float, float], snap: float = 0.1) -> tuple[Ring, Ring] | None:
    """Two rings from the chord that leaves vertex ``k`` in a direction inside the ring, up to the first wall."""
    p, n, best = ring[k], len(ring), None
    for j in range(n):
        if j in (k, (k - 1) % n):
            continue
        a, b = ring[j], ring[(j + 1) % n]
        ex, ey = b[0] - a[0], b[1] - a[1]
        det = direction[0] * -ey + direction[1] * ex
        if abs(det) < EPS:
            continue
        t = ((a[0] - p[0]) * -ey + (a[1] - p[1]) * ex) / det
        s = (direction[0] * (a[1] - p[1]) - direction[1] * (a[0] - p[0])) / det
        if t > 1e-6 and -1e-9 <= s <= 1 + 1e-9 and (best is None or t < best[0]):
            best = (t, j, s)
    if best is None:
        return None
    t, j, s = best
    a, b = ring[j], ring[(j + 1) % n]
    hit = (p[0] + t * direction[0], p[1] + t * direction[1])
    after = (j + 1) % n
    if math.dist(hit, b) <= snap:
        hit, first = b, after
    elif math.dist(hit, a) <= snap:
        hit, first = a, j
    else:
        first = None
    walk = lambda i, stop: [ring[(i + m) % n] for m in range((stop - i) % n + 1)]
    if first is None:
        one, two = walk(k, j) + [hit], [hit] + walk(after, k)
    else:
        if first in (k, (k + 1) % n, (k - 1) % n):
            return None
        one, two = walk(k, first), walk(first, k)
    if min(abs(area(one)), abs(area(two))) < 1e-6 or area(one) < 0 or area(two) < 0:
        return None
    return one, two


def inside_directions(ring: Ring, k: int) -> list[tuple[float, float]]:
    """Cut directions from a reflex vertex: both walls prolonged, their bisector, and sight lines to other vertices."""
    n = len(ring)
    o, p, q = ring[k - 1], ring[k], ring[(k + 1) % n]
    unit = lambda dx, dy: (dx / (math.hypot(dx, dy) or 1), dy / (math.hypot(dx, dy) or 1))
    a, b = unit(p[0] - o[0], p[1] - o[1]), unit(p[0] - q[0], p[1] - q[1])
    out = [a, b, unit(a[0] + b[0], a[1] + b[1])]
    for j in range(n):
        d = unit(ring[j][0] - p[0], ring[j][1] - p[1])
        # inside the reflex corner: left of the incoming wall or left of the outgoing one
        if j not in (k, (k - 1) % n, (k + 1) % n) and (a[0] * d[1] - a[1] * d[0] >= -EPS or -b[0] * d[1] + b[1] * d[0] >= -EPS):
            out.append(d)
    return out


def partition_score(pieces: list[Ring]) -> float:
    """Lower is better: a point a piece and 20 for what area-weighted compactness lacks to one."""
    sizes = [abs(area(r)) for r in pieces]
    whole = sum(sizes) or 1.0
    return len(pieces) + 20 * (1 - sum(s * compact(r) for s, r in zip(sizes, pieces)) / whole)


def grown(state: list[Ring], most_reflex: int, variants: int) -> list[list[Ring]]:
    """States in which the first piece that is not convex has been cut once."""
    bad = next(i for i, r in enumerate(state) if not is_convex(r))
    piece, out = state[bad], []
    for j in reflex(piece)[:most_reflex]:
        for d in inside_directions(piece, j):
            if made := cut_from(piece, j, d):
                out.append(state[:bad] + [counter_clockwise(clean(r)) for r in made] + state[bad + 1 :])
    out.sort(key=promise)
    return out[:variants]


def promise(state: list[Ring]) -> float:
    """Lower is better: what a state scores, and two points a reflex vertex that is left."""
    return 2 * sum(len(reflex(r)) for r in state) + partition_score(state)


def convex_pieces(ring: Ring, depths: tuple[int, int] = (4, 24), widths: tuple[int, int] = (3, 4), variants: int = 32, most_reflex: int = 8, most_failed: int = 500) -> list[Ring]:
    """Convex pieces by an adaptive beam over cuts from reflex vertices; slabs where the search fails.

    ``width`` states go on at a time. Those beyond it overflow and have their turn once the beam is empty;
    those beyond ``depth`` cuts are deferred until nothing else is left: then depth and width grow by one. The
    search ends with the first beam that completes a partition, or after ``most_failed`` states without a cut.
    """
    whole = counter_clockwise(clean(ring))
    if len(whole) < 3:
        return []
    depth, width, failed, best = depths[0], widths[0], 0, None
    active: list[tuple[int, list[Ring]]] = [(0, [whole])]
    overflow: list[tuple[int, list[Ring]]] = []
    deferred: list[tuple[int, list[Ring]]] = []
    seen = set()
    while failed < most_failed:
        if not active:
            if best is not None:
                break
            source = overflow or deferred
            if not source:
                break
            if source is deferred:
                if depth >= depths[1]:
                    break
                depth, width = depth + 1, min(widths[1], width + 1)
            source.sort(key=lambda s: promise(s[1]))
            active, source[:] = source[:width], source[width:]
        fresh = []
        for cuts, state in active:
            if all(map(is_convex, state)):
                if best is None or partition_score(state) < partition_score(best):
                    best = state
                continue
            if cuts >= depth:
                deferred.append((cuts, state))
                continue
            made = grown(state, most_reflex, variants)
            failed += not made
            for new in made:
                key = tuple(sorted((round(abs(area(r)), 4), round(length(r), 4)) for r in new))
                if key not in seen:
                    seen.add(key)
                    fresh.append((cuts + 1, new))
        fresh.sort(key=lambda s: promise(s[1]))
        active = fresh[:width]
        overflow += fresh[width:]
    if best is None or abs(sum(map(area, best)) - area(whole)) > 0.01 * area(whole):
        best = slabs([whole])
    return best


def slabs(rings: list[Ring]) -> list[Ring]:
    """Convex pieces of a polygon with holes (even-odd): trapezoids between all vertices' x, merged across unbroken walls."""
    segs = [(a, b) if a[0] <= b[0] else (b, a) for r in rings for a, b in zip(r, r[1:] + r[:1]) if abs(a[0] - b[0]) > EPS]
    xs = sorted({p[0] for r in rings for p in r} | {x for i, (a, b) in enumerate(segs) for c, d in segs[:i] if (x := crossing_x(a, b, c, d)) is not None})
    at = lambda s, x: s[0][1] + (s[1][1] - s[0][1]) * (x - s[0][0]) / (s[1][0] - s[0][0])
    open_: dict[tuple[int, int], list] = {}
    out = []
    for x0, x1 in zip(xs, xs[1:]):
        if x1 - x0 < EPS:
            continue
        mid = (x0 + x1) / 2
        here = sorted((at(s, mid), i) for i, s in enumerate(segs) if s[0][0] <= x0 + EPS and s[1][0] >= x1 - EPS)
        pairs = {(here[k][1], here[k + 1][1]) for k in range(0, len(here) - 1, 2)}
        for pair in list(open_):
            if pair not in pairs:
                out.append(open_.pop(pair))
        for pair in pairs:
            if pair in open_:
                open_[pair][1] = x1
            else:
                open_[pair] = [x0, x1, segs[pair[0]], segs[pair[1]]]
    out += open_.values()
    pieces = [[(x0, at(lo, x0)), (x1, at(lo, x1)), (x1, at(hi, x1)), (x0, at(hi, x0))] for x0, x1, lo, hi in out]
    pieces = [[p for k, p in enumerate(r) if math.dist(p, r[k - 1]) > EPS] for r in pieces]
    return [counter_clockwise(r) for r in pieces if abs(area(r)) > 1e-9]


def crossing_x(a, b, c, d):
    if cross(a, b, c) * cross(a, b, d) < -EPS and cross(c, d, a) * cross(c, d, b) < -EPS:
        s = cross(c, d, a) / (cross(c, d, a) - cross(c, d, b))
        return a[0] + s * (b[0] - a[0])
    return None


def inset(ring: Ring, depth: float) -> Ring:
    """The ring moved inward with mitred corners, one vertex a vertex; empty where it folds."""
    r = counter_clockwise(ring)
    n = len(r)
    moved = []
    for k in range(n):
        a, b = r[k], r[(k + 1) % n]
        size = math.dist(a, b)
        if size < EPS:
            return []
        nx, ny = -(b[1] - a[1]) / size * depth, (b[0] - a[0]) / size * depth
        moved.append(((a[0] + nx, a[1] + ny), (b[0] + nx, b[1] + ny)))
    out = []
    for k in range(n):
        (a, b), (c, d) = moved[k - 1], moved[k]
        det = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
        if abs(det) < EPS:
            out.append(c)
            continue
        t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / det
        out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    for k in range(n):  # an edge that turned round has been swallowed
        a, b, c, d = r[k], r[(k + 1) % n], out[k], out[(k + 1) % n]
        if (b[0] - a[0]) * (d[0] - c[0]) + (b[1] - a[1]) * (d[1] - c[1]) <= 0:
            return []
    return out if area(out) > EPS and not crosses_itself(out) else []


def point_segment(p, a, b) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    s = dx * dx + dy * dy
    t = 0.0 if s < EPS else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / s))
    return math.dist(p, (a[0] + t * dx, a[1] + t * dy))


def inside(p, ring: Ring) -> bool:
    hit = False
    for a, b in zip(ring, ring[1:] + ring[:1]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) / (b[1] - a[1]) * (b[0] - a[0]):
            hit = not hit
    return hit


def distance(one: Ring, two: Ring) -> float:
    """Between two filled polygons; zero where they meet."""
    if inside(one[0], two) or inside(two[0], one):
        return 0.0
    ea, eb = list(zip(one, one[1:] + one[:1])), list(zip(two, two[1:] + two[:1]))
    if any(cross(a, b, c) * cross(a, b, d) <= 0 and cross(c, d, a) * cross(c, d, b) <= 0 and (cross(a, b, c) or cross(a, b, d)) for a, b in ea for c, d in eb):
        return 0.0
    return min(min(point_segment(p, *e) for p in one for e in eb), min(point_segment(p, *e) for p in two for e in ea))


def blocked(a, b, rings: list[Ring], trim: float = 0.05) -> bool:
    """Whether a sight line, shortened at both ends, crosses or lies in any ring."""
    size = math.dist(a, b)
    if size <= 2 * trim:
        return False
    cut = lambda t: (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)
    a, b = cut(trim / size), cut(1 - trim / size)
    for r in rings:
        if inside(((a[0] + b[0]) / 2, (a[1] + b[1]) / 2), r):
            return True
        if any(cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0 for c, d in zip(r, r[1:] + r[:1])):
            return True
    return False


def shared_length(one: Ring, two: Ring, gap: float = 0.05) -> float:
    """Length along which the walls of two rings lie within ``gap``."""
    total = 0.0
    for a, b in zip(one, one[1:] + one[:1]):
        size = math.dist(a, b)
        if size < EPS:
            continue
        u = ((b[0] - a[0]) / size, (b[1] - a[1]) / size)
        for c, d in zip(two, two[1:] + two[:1]):
            off = lambda p: abs((p[0] - a[0]) * -u[1] + (p[1] - a[1]) * u[0])
            if off(c) <= gap and off(d) <= gap:
                s, t = sorted((p[0] - a[0]) * u[0] + (p[1] - a[1]) * u[1] for p in (c, d))
                total += max(0.0, min(size, t) - max(0.0, s))
    return total


def zone_groups(zones: list[Ring], least: float = 0.1, corners: bool = True) -> list[int]:
    """Group number of each zone; zones join by a shared wall, and at corners too unless ``corners`` is false."""
    up = list(range(len(zones)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(zones)):
        for j in range(i):
            if shared_length(zones[i], zones[j]) >= least or (corners and distance(zones[i], zones[j]) <= 0.1):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    names = {r: k for k, r in enumerate(dict.fromkeys(map(find, range(len(zones)))))}
    return [names[find(k)] for k in range(len(zones))]


def points(value) -> Ring:
    """A ring from a column's list of structs."""
    return [(p["x"], p["y"]) for p in value or []]


def structs(ring: Ring) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def ring_arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All points of a ring column and each ring's border among them; null rings are empty. No Python object a point."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = np.nan_to_num(np.asarray(pc.list_value_length(col).cast(pa.float64()))).astype(np.int64)
    flat = col.flatten()
    points = np.stack([np.asarray(flat.field(i).cast(pa.float64())) for i in (flat.type.get_field_index("x"), flat.type.get_field_index("y"))], axis=1)
    return points, np.append(0, np.cumsum(sizes))


def rectangles(points: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(short, long) sides of the least rectangles around many rings, rings of one length at a time.

    A least rectangle lies along a line through two vertices, so all these directions are tried.
    """
    sizes = np.diff(borders)
    short, long = np.zeros(len(sizes)), np.zeros(len(sizes))
    for n in np.unique(sizes[sizes > 1]).tolist():
        rows = np.flatnonzero(sizes == n)
        i, j = np.triu_indices(n, 1)
        step = max(1, (1 << 20) // (len(i) * n))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            p = points[borders[part][:, None] + np.arange(n)]
            d = p[:, j] - p[:, i]
            length = np.hypot(d[..., 0], d[..., 1])
            ok = length > EPS
            u = d / np.where(ok, length, 1.0)[..., None]
            along = np.ptp(np.einsum("rnc,rkc->rkn", p, u), axis=2)
            across = np.ptp(np.einsum("rnc,rkc->rkn", p, np.stack((-u[..., 1], u[..., 0]), axis=-1)), axis=2)
            best = np.where(ok, along * across, np.inf).argmin(axis=1)
            pick = np.arange(len(part))
            a, b = np.where(ok.any(axis=1), along[pick, best], 0.0), np.where(ok.any(axis=1), across[pick, best], 0.0)
            short[part], long[part] = np.minimum(a, b), np.maximum(a, b)
    return short, long


def ring_pass(df: DataFrame, columns: list[str], kernel: Callable[..., dict], added: str) -> DataFrame:
    """``df`` with the fields that ``kernel(*values)`` returns for each row; ``added`` is their DDL."""
    ship(df.sparkSession)
    new = df.sparkSession.createDataFrame([], added).schema
    out = StructType([*df.schema.fields, *new.fields])
    at = [df.columns.index(c) for c in columns]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in new]
    names = [f.name for f in out]

    def run(batches):
        for batch in batches:
            made = [kernel(*row) for row in zip(*[batch.column(i).to_pylist() for i in at])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([m[f] for m in made], k) for f, k in zip(new.names, kinds)]], names=names)

    return df.mapInArrow(run, out)
