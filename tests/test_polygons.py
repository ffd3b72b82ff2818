"""Points in polygons and clipped cells against plain versions, for concave shapes with holes."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from marlstone.operators import polygons as P

VERTICES = "polygon long, ring int, seq int, x double, y double"


def star(cx, cy, points, far, near, turn=0.3):
    return [(cx + (near if k % 2 else far) * math.cos(turn + k * math.pi / points), cy + (near if k % 2 else far) * math.sin(turn + k * math.pi / points)) for k in range(2 * points)]


SHAPES = {
    1: [star(3.0, 2.0, 5, 9.0, 3.0), star(3.0, 2.0, 3, 2.0, 1.0)],
    2: [[(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (10.0, 4.0), (0.0, 20.0)]],  # a bay that reaches deep in
    3: [[(-6.0, -6.0), (-2.0, -6.0), (-2.0, -2.0), (-6.0, -2.0)]],  # on grid lines
    4: [[(7.0, 7.0), (7.5, 7.0), (7.2, 7.4)]],  # within one cell
}


def rows(shapes=None):
    return [(p, r, k, x, y) for p, rings in (shapes or SHAPES).items() for r, ring in enumerate(rings) for k, (x, y) in enumerate(ring)]


def within(px, py, rings):
    right = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            side = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
            if side == 0 and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
                return False
            right += (y1 <= py < y2 and side > 0) or (y2 <= py < y1 and side < 0)
    return right % 2 == 1


def test_points_in_polygons(spark):
    rng = random.Random(6)
    points = [(i, rng.uniform(-8, 22), rng.uniform(-8, 22), "clash") for i in range(600)] + [(700 + i, float(a), float(b), None) for i, (a, b) in enumerate((a, b) for a in range(-7, 21, 3) for b in range(-7, 21, 2))]
    points += [(900, 0.0, 0.0, "corner"), (901, -4.0, -6.0, "edge"), (902, 10.0, 4.0, "vertex of the bay"), (903, None, 1.0, "x"), (904, float("inf"), 1.0, "x"), (905, float("nan"), 1.0, "x"), (906, 1e9, 1e9, "far"), (5, -4.0, -4.0, "same id")]
    points += [points[0]] * 40 + [(950, -4.0, -4.0, "q")] * 3
    df = spark.createDataFrame(points, "place long, x double, y double, ring string")
    want = Counter()
    for i, x, y, _ in points:
        hits = [p for p, rings in SHAPES.items() if x is not None and math.isfinite(x) and within(x, y, rings)]
        for p in hits or [None]:
            want[i, p] += 1
    for size in (1.0, 6.0):
        found = P.points_in_polygons(df, spark.createDataFrame(rows(), VERTICES), size)
        assert found.columns == ["place", "x", "y", "ring", "polygon"]
        assert Counter((r.place, r.polygon) for r in found.collect()) == want


def test_no_points_or_polygons(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5)], "place long, x double, y double")
    none = spark.createDataFrame([(1, 0, 0, None, 1.0)], VERTICES)
    assert [r.polygon for r in P.points_in_polygons(points, none, 1.0).collect()] == [None]
    assert P.points_in_polygons(points.limit(0), spark.createDataFrame(rows(), VERTICES), 1.0).isEmpty()
    assert P.cell_areas(none, 1.0).isEmpty()


def clip(ring, axis, bound, above):
    out = []
    for a, b in zip(ring[-1:] + ring[:-1], ring, strict=True):
        ins = [p[axis] >= bound if above else p[axis] <= bound for p in (a, b)]
        if ins[0] != ins[1]:
            t = (bound - a[axis]) / (b[axis] - a[axis])
            out.append(tuple(bound if k == axis else a[k] + t * (b[k] - a[k]) for k in (0, 1)))
        if ins[1]:
            out.append(b)
    return out


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring[-1:] + ring[:-1], ring, strict=True))) / 2 if ring else 0.0


@pytest.mark.parametrize("size", [1.5, 4.0])
def test_cell_areas(spark, size):
    got = {(r.polygon, r.cx, r.cy): r.area for r in P.cell_areas(spark.createDataFrame(rows(), VERTICES), size).collect()}
    for p, rings in SHAPES.items():
        whole = area(rings[0]) - sum(area(r) for r in rings[1:])
        assert sum(a for (q, *_), a in got.items() if q == p) == pytest.approx(whole)
        for cx in range(-7, 16):
            for cy in range(-7, 16):
                want = 0.0
                for k, ring in enumerate(rings):
                    for axis, c in ((1, cy), (0, cx)):
                        ring = clip(clip(ring, axis, c * size, True), axis, (c + 1) * size, False) if ring else ring
                    want += -area(ring) if k else area(ring)
                assert got.get((p, cx, cy), 0.0) == pytest.approx(want, abs=1e-9)
    covered = P.cell_coverage(spark.createDataFrame(rows(), VERTICES), size, 0.5).collect()
    assert {(r.polygon, r.cx, r.cy) for r in covered} == {k for k, a in got.items() if a / size**2 >= 0.5}
