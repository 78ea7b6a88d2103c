"""Nearest-segment search within a radius, on an equi-join of grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..runtime import materialise
from . import polylines

#: Metres within which a snap moves to the end of its edge; extra reach for a surface that isn't avoided.
JUNCTION_M, EXTRA_M, MAX_SNAP_M = 0.5, 75.0, 500.0
#: Least width of a search's cells, about as long as a piece: narrower ones would have each piece several times in the shuffle.
LEAST_CELL_E7 = 10_000
#: Radius that a wider search begins with: where lines are dense, most points find their nearest one within it, among few pieces.
NEAR_M = 50.0


def cell_e7(max_m: float) -> int:
    """A cell about as wide as the radius at the equator: a search touches few cells, a piece lies in few."""
    return max(2_000, int(max_m / geo.METRES_PER_DEGREE * geo.FIXED))


def lng_reach(e7: float, lat_e7: Column) -> Column:
    """How far a radius reaches along a parallel. Beyond a pole the cosine is negative, but parallels are as long as on this side."""
    return F.lit(e7) / F.greatest(F.lit(0.01), F.abs(F.cos(F.radians(geo.degrees(lat_e7)))))


def nearest(points: DataFrame, pieces: DataFrame, max_m: float, accept: Column | None = None, reach: Column | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """(point_id, id, piece, t, lng, lat, distance_m, a, b) of the nearest accepted piece within max_m of each point.

    Points: point_id, lng_e7, lat_e7 and what ``accept`` needs. ``reach`` is a radius of each point's own, at most max_m. ``on``: columns
    in which a point and its piece agree; they are joined on them, so a point doesn't meet any other pieces.
    Distances that agree to the micrometre go to the smaller (id, piece). Ranking stands before the radius test, so the
    trigonometry isn't copied into the join condition. A wide search begins with a narrow one: what that finds well within
    its radius is the nearest of all, and only the other points meet all pieces of their radius.
    """
    if max_m <= 2 * NEAR_M:
        return _ranked(points, pieces, max_m, accept, reach, on).where("distance_m <= reach").drop("reach")
    # distances are ranked to the micrometre, so a millimetre decides
    near = materialise(_ranked(points, pieces, NEAR_M, accept, F.lit(max_m) if reach is None else reach, on).where(F.col("distance_m") <= NEAR_M - 0.001))
    found, rest = near, materialise(points.join(near.select("point_id"), "point_id", "left_anti"))
    if not rest.isEmpty():
        found = near.unionByName(_ranked(rest, pieces, max_m, accept, reach, on))
    return found.where("distance_m <= reach").drop("reach")


def _met(points: DataFrame, pieces: DataFrame, max_m: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Points and the pieces whose boxes meet their radius."""
    size = max(LEAST_CELL_E7, cell_e7(max_m))
    # of the sphere that distances are measured on, and a little more: a box must not miss what the radius takes
    degrees = max_m / geo.SPHERE_DEGREE_M * geo.FIXED * 1.00001
    spread = points.withColumn("rx", lng_reach(degrees, F.col("lat_e7")))
    for axis, v, r in (("cx", "lng_e7", F.col("rx")), ("cy", "lat_e7", F.lit(degrees))):
        spread = spread.withColumn(axis, F.explode(F.sequence(F.floor((F.col(v) - r) / size).cast("long"), F.floor((F.col(v) + r) / size).cast("long"))))
    grid = polylines.gridded(pieces, size)
    near = (
        (F.greatest("a.lng_e7", "b.lng_e7") >= F.col("lng_e7") - F.col("rx")) & (F.least("a.lng_e7", "b.lng_e7") <= F.col("lng_e7") + F.col("rx"))
        & (F.greatest("a.lat_e7", "b.lat_e7") >= F.col("lat_e7") - degrees) & (F.least("a.lat_e7", "b.lat_e7") <= F.col("lat_e7") + degrees)
    )
    return spread.join(grid, ["cx", "cy", *on]).where(near)


def _measured(both: DataFrame, *keep: Column) -> DataFrame:
    """Where each point meets each of its pieces, and how far that is."""
    hit = geo.project(geo.degrees(F.col("lng_e7")), geo.degrees(F.col("lat_e7")), *(geo.degrees(F.col(f"{x}.{c}")) for x in "ab" for c in ("lng_e7", "lat_e7")))
    return both.select("point_id", "id", "piece", "a", "b", *keep, hit["t"].alias("t"), hit["lng"].alias("lng"), hit["lat"].alias("lat"), geo.haversine(geo.degrees(F.col("lng_e7")), geo.degrees(F.col("lat_e7")), hit["lng"], hit["lat"]).alias("distance_m"))


def _order() -> Column:
    return F.struct(F.round("distance_m", 6), "id", "piece")


def _ranked(points: DataFrame, pieces: DataFrame, max_m: float, accept: Column | None, reach: Column | None, on: tuple[str, ...] = ()) -> DataFrame:
    """The nearest accepted piece among those whose boxes meet the radius, whatever its distance, and each point's own ``reach``."""
    both = _met(points, pieces, max_m, on)
    if accept is not None:
        both = both.where(accept)
    placed = _measured(both, (F.lit(max_m) if reach is None else reach).alias("reach"))
    best = placed.groupBy("point_id").agg(F.min_by(F.struct("id", "piece", "t", "lng", "lat", "distance_m", "a", "b", "reach"), _order()).alias("h"))
    return best.select("point_id", "h.*")


def _along(hits: DataFrame, edges: DataFrame, *keep: str) -> DataFrame:
    """Hits (point_id, id, piece, t, lng, lat, distance_m) with how far along its edge each lies. Only edges that are hit are measured."""
    at = hits.join(edges.select(F.col("edge_id").alias("id"), "length_m", "coordinates"), "id").withColumn("cum", geo.lengths(F.col("coordinates")))
    start, end = F.element_at("cum", F.col("piece") + 1), F.element_at("cum", F.col("piece") + 2)
    along = F.least(F.col("length_m"), start + (end - start) * F.col("t"))
    along = F.when(along < JUNCTION_M, 0.0).when(F.col("length_m") - along < JUNCTION_M, F.col("length_m")).otherwise(along)
    return at.select("point_id", *keep, F.col("id").alias("edge_id"), along.alias("along_m"), "lng", "lat", "distance_m", "length_m")


def snap(points: DataFrame, edges: DataFrame, max_m: float = MAX_SNAP_M, accept: Column | None = None, reach: Column | None = None, keep: tuple[str, ...] = (), on: tuple[str, ...] = ()) -> DataFrame:
    """(point_id, edge_id, along_m, lng, lat, distance_m, length_m): where each point meets the network."""
    pieces = polylines.pieces(edges.withColumn("id", F.col("edge_id")), *keep, *on)
    return _along(nearest(points, pieces, max_m, accept, reach, on), edges)


_HIT = ("id", "piece", "t", "lng", "lat", "distance_m", "bad")


def _two(points: DataFrame, pieces: DataFrame, max_m: float) -> DataFrame:
    """(point_id, any, fine): the nearest piece, and the nearest one whose surface the point doesn't avoid, whatever their distances."""
    bad = F.expr("array_contains(avoid, surface_class)")
    placed = _measured(_met(points, pieces, max_m), F.coalesce(bad, F.lit(False)).alias("bad"), (~bad).alias("fine"))
    return placed.groupBy("point_id").agg(F.min_by(F.struct(*_HIT), _order()).alias("any"), F.min_by(F.struct(*_HIT), F.when(F.col("fine"), _order())).alias("fine"))


def snap_preferring(points: DataFrame, edges: DataFrame, max_m: float = MAX_SNAP_M) -> DataFrame:
    """Like ``snap``, but a point whose nearest edge has one of its ``avoid`` surfaces goes to another edge, if one lies
    at most max(75 m, the way out of that edge) farther. Both are found at once, so points meet the pieces around them once."""
    pieces = polylines.pieces(edges.withColumn("id", F.col("edge_id")), "surface_class")
    wide = max_m > 2 * NEAR_M
    found = materialise(_two(points, pieces, NEAR_M if wide else max_m))
    if wide:
        # distances are ranked to the micrometre, so a millimetre decides
        within = lambda h: F.coalesce(F.col(f"{h}.distance_m") <= NEAR_M - 0.001, F.lit(False))
        found = found.where(within("any") & (~F.col("any.bad") | within("fine")))
        rest = materialise(points.join(found.select("point_id"), "point_id", "left_anti"))
        if not rest.isEmpty():
            found = found.unionByName(_two(rest, pieces, max_m))
    choices = [F.struct(F.lit(other).alias("other"), *(F.col(f"{h}.{c}").alias(c) for c in _HIT)) for other, h in ((False, "any"), (True, "fine"))]
    hits = found.where(F.col("any.distance_m") <= max_m).select("point_id", F.explode(F.when(F.col("any.bad") & F.col("fine").isNotNull(), F.array(*choices)).otherwise(F.array(choices[0]))).alias("c")).select("point_id", "c.*")
    own = F.struct("edge_id", "along_m", "lng", "lat", "distance_m", "length_m")
    both = _along(hits, edges, "other").groupBy("point_id").agg(F.max(F.when(~F.col("other"), own)).alias("a"), F.max(F.when(F.col("other"), own)).alias("b"))
    exit_m = F.least("a.along_m", F.col("a.length_m") - F.col("a.along_m"))
    reach = F.least(F.lit(max_m), F.col("a.distance_m") + F.greatest(F.lit(EXTRA_M), exit_m))
    return both.select("point_id", F.when(F.col("b.distance_m") <= reach, F.col("b")).otherwise(F.col("a")).alias("s")).select("point_id", "s.*")
