"""Vertex-level operators on polylines kept as arrays of fixed-point points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo


def explode_parts(df: DataFrame, parts: str = "parts", coordinates: str = "coordinates") -> DataFrame:
    """One row per part of a multi-line; parts with fewer than two points go. Heights of 3D points are not read."""
    return df.select("*", F.posexplode(parts).alias("part", coordinates)).drop(parts).where(F.size(coordinates) >= 2)


def vertices(segments: DataFrame, *keep: str) -> DataFrame:
    """(id, pos, lng_e7, lat_e7)"""
    v = segments.select("id", *keep, F.posexplode("coordinates").alias("pos", "p"))
    return v.select("id", *keep, "pos", "p.lng_e7", "p.lat_e7")


def pieces(segments: DataFrame, *keep: str) -> DataFrame:
    """(id, piece, a, b): neighbouring vertices."""
    n = F.size("coordinates")
    each = F.posexplode(F.arrays_zip(F.slice("coordinates", F.lit(1), n - 1).alias("a"), F.slice("coordinates", F.lit(2), n - 1).alias("b"))).alias("piece", "ab")
    return segments.where(n >= 2).select("id", *keep, each).select("id", *keep, "piece", "ab.a", "ab.b")


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def point_at(coords: Column, cum: Column, metres: Column) -> Column:
    """Point at a distance along a polyline as a struct of degrees; clamped to the ends."""
    at = F.least(F.size(F.filter(cum, lambda c: c < metres)) + 1, F.size(coords))

    def piece(i: Column) -> Column:
        before = F.greatest(i - 1, F.lit(1))
        return F.struct(*(F.element_at(x, j).alias(n) for n, x, j in (("a", coords, before), ("b", coords, i), ("s", cum, before), ("e", cum, i))), metres.alias("d"))

    def share(p: Column) -> Column:
        t = F.when(p["e"] > p["s"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), (p["d"] - p["s"]) / F.when(p["e"] > p["s"], p["e"] - p["s"])))).otherwise(F.lit(0.0))
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), t.alias("t"))

    def place(p: Column) -> Column:
        return F.struct(*((geo.degrees(p["a"][c]) + (geo.degrees(p["b"][c]) - geo.degrees(p["a"][c])) * p["t"]).alias(n) for n, c in (("lng", "lng_e7"), ("lat", "lat_e7"))))

    return bind(bind(bind(at, piece), share), place)


def between(coords: Column, cum: Column, from_m: Column, to_m: Column) -> Column:
    """The polyline between two distances in degrees: ends interpolated, vertices strictly between kept; backwards if from > to."""
    lo, hi = F.least(from_m, to_m), F.greatest(from_m, to_m)
    inner = F.filter(F.arrays_zip(coords.alias("p"), cum.alias("c")), lambda v: (v["c"] > lo) & (v["c"] < hi))
    whole = F.concat(F.array(point_at(coords, cum, lo)), F.transform(inner, lambda v: F.struct(geo.degrees(v["p"]["lng_e7"]).alias("lng"), geo.degrees(v["p"]["lat_e7"]).alias("lat"))), F.array(point_at(coords, cum, hi)))
    return F.when(from_m > to_m, F.reverse(whole)).otherwise(whole)


def sliced(df: DataFrame) -> DataFrame:
    """(id, pos, lng, lat) of each line (id, coordinates, cum) between from_m and to_m."""
    line = between(F.col("coordinates"), F.col("cum"), F.col("from_m"), F.col("to_m"))
    return df.select("id", F.posexplode(line).alias("pos", "p")).select("id", "pos", "p.lng", "p.lat")


def cells(a: Column, b: Column, size_e7: int) -> list[Column]:
    """Generators of the grid cells (cx, cy) that a piece's bounding box touches."""
    def cell(v: Column) -> Column:
        return F.floor(v / size_e7).cast("long")

    return [F.sequence(cell(F.least(a[c], b[c])), cell(F.greatest(a[c], b[c]))) for c in ("lng_e7", "lat_e7")]


def gridded(pieces_: DataFrame, size_e7: int) -> DataFrame:
    """Each piece in every cell that its box touches."""
    xs, ys = cells(F.col("a"), F.col("b"), size_e7)
    return pieces_.select("*", F.explode(xs).alias("cx")).select("*", F.explode(ys).alias("cy"))


def islands(rows: DataFrame, group: str, order: str, keys: list[str]) -> DataFrame:
    """Adds ``island``: runs of neighbouring rows of a group that agree (nulls included) on all keys."""
    w = W.partitionBy(group).orderBy(order)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    started = rows.withColumn("new", F.when(same & F.lag(order).over(w).isNotNull(), 0).otherwise(1))
    return started.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("new")
