"""Scalar geometry on degrees and on fixed-point (1e-7 degree) coordinates, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M, MERCATOR_R, FIXED, WORLD_M = 6_371_008.8, 6_378_137.0, 10_000_000, 40_075_016.686
#: WGS 84 flattening; metres of a degree as the grid takes it.
FLATTENING, METRES_PER_DEGREE = 1 / 298.257223563, 111_320.0
#: Metres of a degree of latitude on the sphere.
SPHERE_DEGREE_M = RADIUS_M * math.pi / 180
POINT = "struct<lng_e7:long,lat_e7:long>"


def degrees(e7: Column) -> Column:
    return e7 / F.lit(float(FIXED))


def to_e7(deg: Column) -> Column:
    return F.floor(deg * F.lit(float(FIXED)) + F.lit(0.5)).cast("long")


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    s, t = F.sin(dlat / 2), F.sin(dlng / 2)
    h = s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (t * t)
    return F.lit(2 * RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine_e7(a: Column, b: Column) -> Column:
    """Metres between two fixed-point points (structs)."""
    return haversine(degrees(a["lng_e7"]), degrees(a["lat_e7"]), degrees(b["lng_e7"]), degrees(b["lat_e7"]))


def project(plng: Column, plat: Column, alng: Column, alat: Column, blng: Column, blat: Column) -> dict[str, Column]:
    """Nearest point of a piece to P: its share t of the piece, and where it is. Longitudes are scaled at P's latitude."""
    kx = F.cos(F.radians(plat))
    dx, dy = (blng - alng) * kx, blat - alat
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(((plng - alng) * kx * dx + (plat - alat) * dy) / F.when(square != 0, square))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return {"t": t, "lng": alng + (blng - alng) * t, "lat": alat + (blat - alat) * t}


def lengths(coords: Column) -> Column:
    """Metres from the first vertex to each vertex."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("at"), F.lit(None).cast(POINT).alias("last"))

    def step(acc: Column, p: Column) -> Column:
        at = F.when(acc["last"].isNull(), F.lit(0.0)).otherwise(acc["at"] + haversine_e7(acc["last"], p))
        return F.struct(F.concat(acc["out"], F.array(at)).alias("out"), at.alias("at"), p.alias("last"))

    return F.aggregate(coords, start, step)["out"]


def length(coords: Column) -> Column:
    """Metres along the line: the last of ``lengths``, each piece measured once."""
    start = F.struct(F.lit(0.0).alias("at"), F.lit(None).cast(POINT).alias("last"))
    step = lambda acc, p: F.struct(F.when(acc["last"].isNull(), F.lit(0.0)).otherwise(acc["at"] + haversine_e7(acc["last"], p)).alias("at"), p.alias("last"))
    return F.aggregate(coords, start, step)["at"]


def mercator(lng: Column, lat: Column) -> tuple[Column, Column]:
    return F.lit(MERCATOR_R) * F.radians(lng), F.lit(MERCATOR_R) * F.ln(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))


def tile_bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    side = F.lit(WORLD_M) / F.pow(F.lit(2.0), z)
    half = F.lit(WORLD_M / 2)
    return {"min_x": x * side - half, "max_x": (x + 1) * side - half, "max_y": half - y * side, "min_y": half - (y + 1) * side}


def spheroid_metres(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Andoyer-Lambert length on the WGS 84 ellipsoid: the sphere's angle on reduced latitudes, corrected to first order."""
    b1, b2 = (F.atan(F.lit(1 - FLATTENING) * F.tan(F.radians(x))) for x in (lat1, lat2))
    s, t = F.sin((b2 - b1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    h = s * s + F.cos(b1) * F.cos(b2) * (t * t)
    angle = F.lit(2.0) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    sin_half, cos_half = F.sin(angle / 2), F.cos(angle / 2)
    x = (angle - F.sin(angle)) * F.pow(F.sin(p) * F.cos(q) / cos_half, F.lit(2.0))
    y = (angle + F.sin(angle)) * F.pow(F.cos(p) * F.sin(q) / F.when(sin_half != 0, sin_half), F.lit(2.0))
    return F.when(angle == 0, F.lit(0.0)).otherwise(F.lit(MERCATOR_R) * (angle - F.lit(FLATTENING / 2) * (x + y)))
