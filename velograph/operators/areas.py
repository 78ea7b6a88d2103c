"""Areas: convex rings, the buffer around them, their union, and lines that meet them.

A buffer is never drawn: "meets the buffer" is "comes as near as the buffer is wide", and two buffers meet where their rings
come as near as both are wide. Distances are taken on a plane whose longitudes are scaled at a place nearby: at the first vertex of
a line's piece, or midway between the first vertices of two rings.

Lines meet areas by cells of a grid. A cell lists, for each area that reaches it, the edges that matter there: those whose inner
side doesn't hold the whole cell. Within the cell a point lies in the ring when it is inside of these, and the edge that is
nearest to a point outside is one of them. A cell without such edges lies in the ring, so its lines are in without a test.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..runtime import materialise
from . import polylines
from .components import connected_components

#: Metres of a unit of fixed-point latitude; cells in such units; how many times as narrow are those that areas are tested in;
#: combinations that a kernel holds at once.
UNIT_M = geo.METRES_PER_DEGREE / geo.FIXED
CELL, FINER, HELD = 200_000, 16, 1 << 20
C = F.col


def rings(hull: DataFrame, group: str = "cluster") -> DataFrame:
    """(area, ring) of hulls given as (group, pos, lng_e7, lat_e7)."""
    point = lambda v: F.struct(v["lng_e7"].alias("lng_e7"), v["lat_e7"].alias("lat_e7"))
    return hull.groupBy(C(group).alias("area")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lng_e7", "lat_e7"))), point).alias("ring"))


def _boxes(areas: DataFrame, metres: float) -> DataFrame:
    """Adds corners a and b of each ring's box, padded by a little more than the distance."""
    lat = F.greatest(F.abs(F.array_min("ring.lat_e7")), F.abs(F.array_max("ring.lat_e7")))
    pad_lat = math.ceil(metres * 1.01 / UNIT_M)
    pad_lng = F.ceil(F.lit(float(pad_lat)) / F.greatest(F.cos(F.radians(geo.degrees(lat + pad_lat))), F.lit(0.01)))
    corner = lambda f, s: F.struct((f("ring.lng_e7") + s * pad_lng).alias("lng_e7"), (f("ring.lat_e7") + s * pad_lat).alias("lat_e7"))
    return areas.withColumns({"a": corner(F.array_min, -1), "b": corner(F.array_max, 1)})


def combined(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, i, j): every i < na and j < nb of each pair, i by i."""
    n = na * nb
    pair = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return pair, k // nb[pair], k % nb[pair]


def least(values: np.ndarray, groups: np.ndarray, n: int, otherwise: float) -> np.ndarray:
    """Minimum of each group of neighbouring values."""
    out = np.full(n, otherwise)
    if len(values):
        starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
        out[groups[starts]] = np.minimum.reduceat(values, starts)
    return out


def point_to_segment(px, py, ax, ay, bx, by) -> np.ndarray:
    dx, dy = bx - ax, by - ay
    t = np.clip(((px - ax) * dx + (py - ay) * dy) / np.maximum(dx * dx + dy * dy, 1e-30), 0, 1)
    return np.hypot(px - ax - t * dx, py - ay - t * dy)


def side(px, py, ax, ay, bx, by) -> np.ndarray:
    """Positive to the left of the way from a to b."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def crossing(ax, ay, bx, by, cx, cy, dx, dy) -> np.ndarray:
    """Whether segments cross at a point within both."""
    return (side(cx, cy, ax, ay, bx, by) * side(dx, dy, ax, ay, bx, by) < 0) & (side(ax, ay, cx, cy, dx, dy) * side(bx, by, cx, cy, dx, dy) < 0)


class Rings:
    """A column of rings on flat values."""

    def __init__(self, column: pa.Array):
        offsets = column.offsets.to_numpy()
        self.start, self.n = offsets[:-1] - offsets[0], np.diff(offsets)
        flat = column.flatten()
        self.x, self.y = (flat.field(i).to_numpy().astype(float) for i in (0, 1))

    def after(self, pair: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.start[pair] + (i + 1) % self.n[pair]


def ring_distances(p: Rings, q: Rings, scale: np.ndarray) -> np.ndarray:
    """Metres between the rings of each pair, 0 where one holds a vertex of the other or their edges cross."""
    out = np.full(len(scale), np.inf)
    total = np.cumsum(p.n * q.n)
    first = 0
    while first < len(scale):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + HELD, "right")))
        some = np.arange(first, last)
        pair, i, j = combined(p.n[some], q.n[some])
        pair += first
        a, b, c, d = p.start[pair] + i, p.after(pair, i), q.start[pair] + j, q.after(pair, j)
        k = scale[pair]
        args = [(p.x[a] * k, p.y[a]), (p.x[b] * k, p.y[b]), (q.x[c] * k, q.y[c]), (q.x[d] * k, q.y[d])]
        (ax, ay), (bx, by), (cx, cy), (dx, dy) = args
        apart = np.minimum(point_to_segment(ax, ay, cx, cy, dx, dy), point_to_segment(cx, cy, ax, ay, bx, by))
        apart[crossing(ax, ay, bx, by, cx, cy, dx, dy)] = 0
        near = least(apart, pair - first, len(some), np.inf)
        # a vertex of p within q: q's edges stand next to each other for each vertex; of q within p: sort them so
        for own, inner, other in ((side(ax, ay, cx, cy, dx, dy), i, q), (side(cx, cy, ax, ay, bx, by), j, p)):
            vertex = (pair - first) * (1 << 32) + inner
            order = np.argsort(vertex, kind="stable")
            heads = np.flatnonzero(np.append(True, vertex[order][1:] != vertex[order][:-1]))
            within = np.minimum.reduceat(own[order], heads) >= 0
            hit = pair[order][heads][within]
            near[hit[other.n[hit] > 2] - first] = 0
        out[first:last] = near * UNIT_M
        first = last
    return out


def _near_pairs(within: float):
    def run(batches):
        for batch in batches:
            p, q = Rings(batch.column("ring")), Rings(batch.column("other_ring"))
            scale = np.cos(np.radians((p.y[p.start] + q.y[q.start]) / 2 / geo.FIXED)) if len(batch) else np.empty(0)
            ok = pa.array(ring_distances(p, q, scale) <= within)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("area", "other")], ["a", "b"])

    return run


def united(areas: DataFrame, metres: float) -> DataFrame:
    """(area, part): areas (area long, ring) whose buffers touch are one part of the union, named by its least area.

    Areas with a vertex in the same small cell are near each other without a test, so many areas in one place make a star, not
    pairs; rings are only compared between areas that such stars don't link already and whose boxes meet.
    """
    small = int(2 * metres / math.sqrt(2) / UNIT_M)  # the cell's diagonal is at most both buffers wide
    vertex = areas.select("area", F.explode("ring").alias("v")).select("area", F.floor(C("v.lng_e7") / small).alias("cx"), F.floor(C("v.lat_e7") / small).alias("cy"))
    stars = vertex.join(vertex.groupBy("cx", "cy").agg(F.min("area").alias("b")), ["cx", "cy"]).where("area <> b").select(C("area").alias("a"), "b").distinct()
    known = connected_components(stars, near=True)
    named = areas.join(known.select(C("node").alias("area"), C("component").alias("star")), "area", "left").withColumn("star", F.coalesce("star", "area"))
    cells = polylines.gridded(_boxes(named, metres), CELL)
    box = ["area", "star", "cx", "cy", *(F.floor(C(f"{p}.{c}") / s).alias(f"{n}{p}") for p in "ab" for c, n, s in (("lng_e7", "x", CELL), ("lat_e7", "y", CELL)))]
    one, two = cells.select(*box), cells.select(*box).toDF("other", "other_star", "cx", "cy", "oxa", "oya", "oxb", "oyb")
    # a pair of boxes is taken in one of the cells that they share: that of their common lower corner
    corner = (C("cx") == F.greatest("xa", "oxa")) & (C("cy") == F.greatest("ya", "oya"))
    pairs = one.join(two, ["cx", "cy"]).where((C("area") < C("other")) & (C("star") != C("other_star")) & corner).select("area", "other")
    rings_of = lambda name, ring: areas.select(C("area").alias(name), C("ring").alias(ring))
    both = pairs.join(rings_of("area", "ring"), "area").join(rings_of("other", "other_ring"), "other").select("area", "other", "ring", "other_ring")
    links = stars.unionByName(both.mapInArrow(_near_pairs(2 * metres), "a long, b long"))
    parts = connected_components(links, near=True)
    return areas.select("area").join(parts.select(C("node").alias("area"), C("component").alias("part")), "area", "left").select("area", F.coalesce("part", "area").alias("part"))


def prepared(areas: DataFrame, metres: float, size: int = CELL) -> DataFrame:
    """(area, cx, cy, solid, edges): for every cell that an area's buffer may reach, the ring's edges that matter there."""
    n = F.size("ring")
    edge = lambda i: F.struct(*(F.element_at("ring", k)[c].alias(f"{p}{c[:3]}") for p, k in (("a", i), ("b", (i % n) + 1)) for c in ("lng_e7", "lat_e7")))
    cells = polylines.gridded(_boxes(areas.where(n > 0).withColumn("edges", F.transform(F.sequence(F.lit(1), n), edge)), metres), size)
    x0, y0 = (C(c) * size for c in ("cx", "cy"))
    scale = F.cos(F.radians(geo.degrees(F.greatest(*(F.abs(C(f"{p}.lat_e7")) for p in "ab")))))

    def extreme(e: Column, most: bool) -> Column:
        """The least or largest side value of the cell's corners."""
        dx, dy = e["blng"] - e["alng"], e["blat"] - e["alat"]
        up, right = (dx >= 0, dy < 0) if most else (dx < 0, dy >= 0)
        return dx * (F.when(up, y0 + size).otherwise(y0) - e["alat"]) - dy * (F.when(right, x0 + size).otherwise(x0) - e["alng"])

    length = lambda e: F.hypot((e["blng"] - e["alng"]).cast("double"), (e["blat"] - e["alat"]).cast("double"))
    beyond = F.exists("edges", lambda e: -extreme(e, True) * scale * UNIT_M > metres * 1.01 * length(e))
    solid = n > 2
    return cells.where(~(solid & beyond)).select("area", "cx", "cy", solid.alias("solid"), F.when(solid, F.filter("edges", lambda e: extreme(e, False) < 0)).otherwise(C("edges")).alias("edges"))


def clipped(ax, ay, bx, by, x0, y0, size: int):
    """(there, ax, ay, bx, by): the part of each segment within its cell, by Liang-Barsky."""
    dx, dy = bx - ax, by - ay
    lo, hi = np.zeros(len(ax)), np.ones(len(ax))
    for p, q in ((-dx, ax - x0), (dx, x0 + size - ax), (-dy, ay - y0), (dy, y0 + size - ay)):
        t = q / np.where(p == 0, 1, p)
        lo = np.where(p < 0, np.maximum(lo, t), np.where((p == 0) & (q < 0), 2, lo))
        hi = np.where(p > 0, np.minimum(hi, t), hi)
    return lo <= hi, ax + lo * dx, ay + lo * dy, ax + hi * dx, ay + hi * dy


def _meeting(metres: float, size: int):
    def run(batches):
        for batch in batches:
            ax, ay, bx, by, x0, y0 = (batch.column(c).to_numpy().astype(float) for c in ("alng", "alat", "blng", "blat", "cx", "cy"))
            scale, solid = np.cos(np.radians(ay / geo.FIXED)), batch.column("solid").to_numpy(zero_copy_only=False)
            there, ax, ay, bx, by = clipped(ax, ay, bx, by, x0 * size, y0 * size, size)
            lists = batch.column("edges")
            offsets = lists.offsets.to_numpy()
            n = np.where(there, np.diff(offsets), 0)
            flat = [lists.flatten().field(i).to_numpy().astype(float) for i in range(4)]
            ok = there & solid & (n == 0)
            first = 0
            total = np.cumsum(n)
            while first < len(n):
                last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + HELD, "right")))
                mine = np.arange(first, last)
                row = np.repeat(mine, n[mine])
                edge = np.arange(len(row)) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine]) + np.repeat(offsets[:-1][mine] - offsets[0], n[mine])
                cx, cy, dx, dy = (f[edge] for f in flat)
                inside = np.zeros(last - first, bool)
                for px, py in ((ax, ay), (bx, by)):
                    inside |= least(side(px[row], py[row], cx, cy, dx, dy), row - first, last - first, -1) >= 0
                k = scale[row]
                p, q, c, d = (ax[row] * k, ay[row]), (bx[row] * k, by[row]), (cx * k, cy), (dx * k, dy)
                apart = np.minimum.reduce([point_to_segment(*p, *c, *d), point_to_segment(*q, *c, *d), point_to_segment(*c, *p, *q), point_to_segment(*d, *p, *q)])
                apart[crossing(*p, *q, *c, *d)] = 0
                ok[first:last] |= inside & solid[mine] | (least(apart, row - first, last - first, np.inf) * UNIT_M <= metres)
                first = last
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(ok))], ["id"])

    return run


def _once(cells: DataFrame) -> DataFrame:
    """(cx, cy, solid, edges) of prepared cells: one that lies wholly in an area stands once, for all areas that reach it."""
    cells = materialise(cells.select("cx", "cy", "solid", "edges"))
    full = cells.where(C("solid") & (F.size("edges") == 0)).select("cx", "cy").distinct()
    none = F.array().cast(cells.schema["edges"].dataType)
    return cells.join(full, ["cx", "cy"], "left_anti").unionByName(full.select("cx", "cy", F.lit(True).alias("solid"), none.alias("edges")))


def meeting(pieces: DataFrame, areas: DataFrame, metres: float, size: int = CELL) -> DataFrame:
    """(id): once each, the ids of pieces (id, a, b) that come within the distance of an area (area, ring).

    The join's key is a cell; adaptive execution splits a cell that holds very many pieces, and each match is tested where it is made.
    Areas far from all pieces go first, by cells of ``size``. The join's own cells are FINER times as narrow, so that many lie
    wholly in an area: what has a part in such a cell is within, and no other area is looked at there.
    """
    kind, fine = dict(pieces.dtypes)["id"], max(1, size // FINER)
    used = polylines.gridded(pieces, size).select("cx", "cy").distinct()
    near = polylines.gridded(_boxes(areas.where(F.size("ring") > 0), metres), size).join(used, ["cx", "cy"], "left_semi").select("area").distinct()
    cells = _once(prepared(areas.join(near, "area", "left_semi"), metres, fine))
    flat = polylines.gridded(pieces, fine).select("id", "cx", "cy", *(C(f"{p}.{c}").alias(f"{p}{c[:3]}") for p in "ab" for c in ("lng_e7", "lat_e7")))
    met = flat.join(cells, ["cx", "cy"])
    return met.select("id", "alng", "alat", "blng", "blat", "cx", "cy", "solid", "edges").mapInArrow(_meeting(metres, fine), f"id {kind}").distinct()


def lines_within(lines: DataFrame, areas: DataFrame, metres: float) -> DataFrame:
    """Lines (id, coordinates) that come within the distance of some area: a semi-join."""
    return lines.join(meeting(polylines.pieces(lines), areas, metres), "id", "left_semi")
