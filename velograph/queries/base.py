"""Registry of queries, and SQL pieces that the checking statements share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import vocab as V
from ..sources import network

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def cte(sql: str) -> str:
    return sql.replace("{div}", "//")


def strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def case(key: str, table: dict, otherwise: str = "NULL") -> str:
    def show(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{float(v)!r}::DOUBLE"

    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in table.items()) + f" ELSE {otherwise} END" if table else otherwise


def half_up(x: str, digits: int) -> str:
    return f"(floor(({x}) * {10**digits}::DOUBLE + 0.5::DOUBLE) / {10**digits}::DOUBLE)"


def deg(x: str) -> str:
    return f"({x} / 10000000::DOUBLE)"


def haversine(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    return (
        f"(2 * 6371008.8::DOUBLE * asin(least(1::DOUBLE, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2)))))"
    )


def haversine_e7(p: str, q: str) -> str:
    """Between columns p_lng, p_lat and q_lng, q_lat."""
    return haversine(deg(f"{p}_lng"), deg(f"{p}_lat"), deg(f"{q}_lng"), deg(f"{q}_lat"))


RAW = V.raw_to_class()


def hazards(x: str) -> str:
    label = case("h", V.HAZARDS, "regexp_replace(h, '[^a-z0-9]+', '_', 'g')")
    return f"list_transform(list_filter(list_transform(string_split(coalesce({x}, ''), ','), lambda h: lower(trim(h))), lambda h: h <> ''), lambda h: {label})"


def surface_class(x: str) -> str:
    rank = "CASE trim(s) " + " ".join(f"WHEN '{r}' THEN {V.SURFACES.index(c)}" for r, c in RAW.items()) + " END"
    return f"coalesce(list_extract([{strings(V.SURFACES)}], list_max(list_filter(list_transform(string_split_regex(lower({x}), '[;/]'), lambda s: {rank}), lambda r: r IS NOT NULL)) + 1), 'unknown')"


def sealed(category: str, sidewalk: str) -> str:
    return f"({category} IN ({strings(V.SEALED)}) OR coalesce({sidewalk}, false))"


CATEGORY = f"list_extract([{strings(V.CATEGORIES)}], CAST(kind_ix AS INTEGER) + 1)"
SEG = "raw AS (" + cte(network.SEGMENTS) + "), seg AS (SELECT * EXCLUDE (hazards, smoothness, surface), " + (
    f"{CATEGORY} AS category, {hazards('hazards')} AS hazards, surface AS raw_surface, {surface_class('surface')} AS tagged, "
    f"CASE WHEN lower(trim(smoothness)) IN ({strings(V.SMOOTHNESS)}) THEN lower(trim(smoothness)) END AS smoothness FROM raw)"
) + f", net AS (SELECT *, CASE WHEN tagged = 'unknown' AND {sealed('category', 'sidewalk')} THEN 'paved' ELSE tagged END AS surface_class, tagged = 'unknown' AND {sealed('category', 'sidewalk')} AS surface_inferred FROM seg)"
VERTICES = "vtx AS (SELECT id, 0 AS pos, a_lng AS lng, a_lat AS lat FROM raw UNION ALL SELECT id, 1, m_lng, m_lat FROM raw UNION ALL SELECT id, 2, b_lng, b_lat FROM raw)"
LENGTH = f"{haversine_e7('a', 'm')} + {haversine_e7('m', 'b')}"
POINTS = "pts AS (" + network.POINTS + ")"
REQUESTS = "req AS (" + cte(network.REQUESTS) + ")"
WAYS = "way AS (" + cte(network.WAYS) + ")"
FEATURES = "feat AS (" + cte(network.FEATURES) + ")"
PLACES = "place AS (" + cte(network.PLACES) + ")"
#: Lattice routes with what their segments carry; lengths to the millimetre.
ROUTES = (
    f"{REQUESTS}, {SEG}, leg AS (SELECT request_id, i AS seq, (src + i) * 3 AS id FROM req, (SELECT unnest(range(100)) AS i) WHERE i < dx UNION ALL "
    "SELECT request_id, dx + i, (src + dx + i * 100) * 3 + 1 FROM req, (SELECT unnest(range(100)) AS i) WHERE i < dy), "
    f"redge AS (SELECT request_id, CAST(seq AS INTEGER) AS seq, id, category AS kind, name, surface_class, surface_inferred, smoothness, hazards, {half_up(LENGTH, 3)} AS length_m FROM leg JOIN net USING (id))"
)
