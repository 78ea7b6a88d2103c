"""Unions of buffered areas and lines against them, by brute force in plain Python."""

import math

import numpy as np
import pytest

from velograph.operators import areas, hulls
from velograph.runtime import materialise

U = areas.UNIT_M


def seg(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = 0 if dx == dy == 0 else max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def side(p, a, b):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def edges(ring):
    return [(ring[i], ring[(i + 1) % len(ring)]) for i in range(len(ring))]


def apart(p, q, k):
    """Metres between two convex shapes (points, lines or rings), longitudes scaled by k."""
    p, q = ([(x * k, y) for x, y in r] for r in (p, q))
    for r, s in ((p, q), (q, p)):
        if len(s) > 2 and any(all(side(v, a, b) >= 0 for a, b in edges(s)) for v in r):
            return 0.0
    best = math.inf
    for a, b in edges(p):
        for c, d in edges(q):
            if side(c, a, b) * side(d, a, b) < 0 and side(a, c, d) * side(b, c, d) < 0:
                return 0.0
            best = min(best, seg(a, c, d), seg(b, c, d), seg(c, a, b), seg(d, a, b))
    return best * U


def union_parts(shapes, metres):
    label = {i: i for i in shapes}
    for i in shapes:
        for j in shapes:
            if i < j and apart(shapes[i], shapes[j], math.cos(math.radians((shapes[i][0][1] + shapes[j][0][1]) / 2 / 1e7))) <= 2 * metres:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {n: new if c == old else c for n, c in label.items()}
    return label


@pytest.fixture(scope="module")
def shapes():
    """Scattered areas of one to nine points, one that holds others, thin ones that cross, repeats and a far one."""
    rng = np.random.default_rng(11)
    out = {}
    for i in range(40):
        centre = np.array([1_450_000_000, -378_000_000]) + rng.integers(0, 1_500_000, 2)
        out[i] = centre + rng.integers(0, [60_000, 50_000], (1 + i % 9, 2))
    out[50] = np.array([[1_460_000_000, -378_000_000], [1_461_500_000, -378_000_000], [1_461_500_000, -376_500_000], [1_460_000_000, -376_500_000]])
    out[51] = np.array([[1_460_700_000, -377_300_000], [1_460_700_100, -377_300_000], [1_460_700_000, -377_299_900]])
    out[52] = np.array([[1_459_000_000, -377_400_000], [1_463_000_000, -377_400_100], [1_461_000_000, -377_400_500]])
    out[53] = out[52]
    out[60] = np.array([[1_409_000_000, -339_000_001]])
    return {i: [tuple(int(c) for c in p) for p in hulls.monotone_chain(v)] for i, v in out.items()}


def frame(spark, shapes):
    return materialise(spark.createDataFrame([(i, [{"lng_e7": x, "lat_e7": y} for x, y in r]) for i, r in shapes.items()], "area long, ring array<struct<lng_e7:long,lat_e7:long>>").repartition(3))


def test_union_equals_brute_force(spark, shapes, monkeypatch):
    got = {r["area"]: r["part"] for r in areas.united(frame(spark, shapes), 1000.0).collect()}
    want = union_parts(shapes, 1000.0)
    assert got == want and 3 < len(set(want.values())) < len(want)
    monkeypatch.setattr(areas, "HELD", 50)  # several blocks of combinations
    assert {r["area"]: r["part"] for r in areas.united(frame(spark, shapes), 1000.0).coalesce(1).collect()} == want
    assert areas.united(frame(spark, {}), 1000.0).count() == 0


def test_many_areas_in_one_place_make_a_star(spark):
    many = {i: [(1_450_000_000 + i, -378_000_000)] for i in range(3000)} | {5000: [(1_452_000_000, -378_000_000)]}
    got = {r["area"]: r["part"] for r in areas.united(frame(spark, many), 1000.0).collect()}
    assert got == dict.fromkeys(range(3000), 0) | {5000: 5000}


@pytest.mark.parametrize("size", [areas.CELL, 35_000])
def test_lines_equal_brute_force(spark, shapes, size, monkeypatch):
    monkeypatch.setattr(areas, "HELD", 200)
    rng = np.random.default_rng(12)
    lines = {}
    for i in range(300):
        at = np.array([1_449_500_000, -378_500_000]) + rng.integers(0, 2_500_000, 2)
        lines[i] = [tuple(int(c) for c in at + d) for d in np.cumsum(rng.integers(-40_000, 40_000, (int(rng.integers(1, 5)), 2)), axis=0)]
    lines[400] = [(1_460_600_000, -377_250_000), (1_460_600_500, -377_250_000)]  # deep inside a ring
    lines[401] = [(1_459_500_000, -377_000_000), (1_462_500_000, -377_000_000)]  # through it, both ends outside
    lines[402] = [(1_460_600_000, -377_250_000)] * 2
    made = spark.createDataFrame([(i, [{"lng_e7": x, "lat_e7": y} for x, y in c]) for i, c in lines.items()], "id long, coordinates array<struct<lng_e7:long,lat_e7:long>>").repartition(3)
    want = set()
    for i, c in lines.items():
        for a, b in zip(c[:-1], c[1:], strict=True):
            k = math.cos(math.radians(a[1] / 1e7))
            if any(apart([a, b] if a != b else [a], r, k) <= 1000 for r in shapes.values()):
                want.add(i)
    from velograph.operators import polylines

    got = [r["id"] for r in areas.meeting(polylines.pieces(made), frame(spark, shapes), 1000.0, size).collect()]
    assert sorted(got) == sorted(want) and {400, 401, 402} <= want and len(want) < 250
    assert {r["id"] for r in areas.lines_within(made, frame(spark, shapes), 1000.0).collect()} == want
    assert areas.lines_within(made, frame(spark, {}), 1000.0).count() == 0


def test_a_cell_within_areas_stands_once(spark):
    """However many areas hold a cell, its lines meet one row; cells at the border keep every area's edges."""
    x, y = 1_450_000_000, -380_000_000
    shapes = {i: [(x, y), (x + 900_000, y), (x + 900_000, y + 900_000), (x, y + 900_000)] for i in range(30)}
    cells = areas._once(areas.prepared(frame(spark, shapes), 1000.0, 100_000)).groupBy("cx", "cy").count().collect()
    per = {(r["cx"], r["cy"]): r["count"] for r in cells}
    assert per[14504, -3796] == 1 and set(per.values()) == {1, 30}
