"""Attribute rules: cleaning, categories, access, direction, width, surface, smoothness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .exprs import lookup


def clean(x: Column) -> Column:
    """Trimmed; null for an empty string or the word null in any case."""
    t = F.trim(x)
    return F.when(~F.lower(t).isin("", "null"), t)


def direction(x: Column) -> Column:
    return F.when(x.isin(*V.DIRECTIONS), x).otherwise("both")


def infra_category(label: Column) -> Column:
    return F.coalesce(lookup(F.trim(label), V.INFRA_LABELS), F.lit("unknown"))


def hazards(raw: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.transform(parts, lambda x: F.coalesce(lookup(x, V.HAZARDS), F.regexp_replace(x, "[^a-z0-9]+", "_")))


def _is(x: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(x.isin(*values), F.lit(False))


def accessible(access: Column, foot: Column, bicycle: Column) -> Column:
    both_denied = _is(foot, V.DENIED) & _is(bicycle, V.DENIED)
    return ~both_denied & (~_is(access, V.DENIED) | _is(foot, V.ALLOWED) | _is(bicycle, V.ALLOWED))


def width(raw: Column) -> Column:
    """Metres, of a number alone or one with its unit; null for any other text and beyond what a path can have."""
    text = F.lower(F.btrim(raw, F.lit(" \t\n\r\x0b\x0c")))
    number = F.regexp_substr(text, F.lit("^[0-9]+([.][0-9]+)?"))
    unit = F.ltrim(F.substr(text, F.length(number) + 1))
    value = F.when(unit.isin(*V.WIDTH_UNITS), number.try_cast("double"))
    return F.when((value > 0) & (value < 100), value)


def bicycle_direction(oneway: Column, oneway_bicycle: Column) -> Column:
    rule = F.coalesce(oneway_bicycle, oneway)
    return F.when(oneway_bicycle == "no", "both").when(rule.isin(*V.ONE_WAY["forward"]), "forward").when(rule.isin(*V.ONE_WAY["reverse"]), "reverse").otherwise("both")


def way_category(highway: Column, bicycle: Column, footway: Column, surface: Column) -> Column:
    designated = _is(bicycle, ("designated",))
    return (
        F.when(highway == "cycleway", "shared_use_path")
        .when(highway.isin(*V.FOOT_WAYS), F.when(designated & ~_is(footway, ("sidewalk",)), "shared_use_path").otherwise("footpath"))
        .when(highway == "path", F.when(designated, "shared_use_path").when(_is(surface, V.SEALED_PATHS), "footpath").otherwise("trail"))
        .when(highway.isin(*V.TRACKS), "track")
        .when(highway == "steps", "steps")
        .when(highway.isin(*V.QUIET_STREETS), "quiet_street")
        .when(highway.isin(*V.ROADS), "road")
        .when(highway.isin(*V.BUSY_ROADS), "busy_road")
    )


def candidate(highway: Column, area: Column) -> Column:
    return _is(highway, V.CANDIDATES) & ~_is(area, ("yes",))


def routable(highway: Column, access: Column, foot: Column, bicycle: Column, service: Column, indoor: Column) -> Column:
    """Whether a way's tags let it into the network, its category aside."""
    return accessible(access, foot, bicycle) & ~(_is(highway, ("service",)) & _is(service, V.EXCLUDED_SERVICE)) & ~_is(indoor, ("yes",))


def surface_class(raw: Column) -> Column:
    """The worst known class among the values of a tag, or unknown."""
    rank = {r: V.SURFACES.index(c) for r, c in V.raw_to_class().items()}
    worst = F.array_max(F.transform(F.split(F.lower(raw), "[;/]"), lambda x: lookup(F.trim(x), rank)))
    return F.coalesce(F.element_at(F.array(*map(F.lit, V.SURFACES)), worst + 1), F.lit("unknown"))


def sealed(category: Column, sidewalk: Column) -> Column:
    return F.coalesce(sidewalk, F.lit(False)) | _is(category, V.SEALED)


def effective_surface(category: Column, raw: Column, sidewalk: Column) -> tuple[Column, Column]:
    """Class and whether it is inferred: sealed categories and sidewalks count as paved unless tagged."""
    tagged = surface_class(raw)
    infer = (tagged == "unknown") & sealed(category, sidewalk)
    return F.when(infer, "paved").otherwise(tagged), infer


def tile_surface(category: Column, raw: Column, sidewalk: Column) -> tuple[Column, Column]:
    """What map tiles show. Unlike the router it looks at the whole tag and infers only where there is none."""
    infer = raw.isNull() & sealed(category, sidewalk)
    cls = F.coalesce(lookup(F.lower(raw), V.raw_to_class()), F.lit("unknown"))
    return F.when(infer, "paved").otherwise(cls), infer


def smoothness(raw: Column) -> Column:
    value = F.lower(F.trim(raw))
    return F.when(value.isin(*V.SMOOTHNESS), value)


def in_region(lng: Column, lat: Column) -> Column:
    return lng.between(V.REGION["min_lng"], V.REGION["max_lng"]) & lat.between(V.REGION["min_lat"], V.REGION["max_lat"])
