"""Scalar and per-line geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.exprs import half_up
from ..operators import hulls, polylines
from ..sources import network
from . import base
from .base import LENGTH, POINTS, SEG, VERTICES, query

C = F.col
RAW = base.SEG.split(", seg AS (")[0]
CELL = 20_000


def _line(spark, sf_dir):
    return network.paths(spark, sf_dir).withColumn("cum", geo.lengths(C("coordinates")))


@query(f"WITH {RAW} SELECT id, {base.half_up(LENGTH, 3)} AS length_m FROM raw")
def haversine(spark, sf_dir):
    return _line(spark, sf_dir).select("id", half_up(F.element_at("cum", -1), 3).alias("length_m"))


@query(f"WITH {RAW} SELECT id, CAST(pos AS INTEGER) AS pos, {base.half_up('m', 3)} AS metres FROM (SELECT id, 0 AS pos, 0::DOUBLE AS m FROM raw UNION ALL SELECT id, 1, {base.haversine_e7('a', 'm')} FROM raw UNION ALL SELECT id, 2, {LENGTH} FROM raw)")
def cumulative_length(spark, sf_dir):
    return _line(spark, sf_dir).select("id", F.posexplode("cum").alias("pos", "m")).select("id", "pos", half_up(C("m"), 3).alias("metres"))


#: A click near each segment's start, for projections.
NEAR = "a_lng + (id % 17) * 700 - 2000 AS p_lng, a_lat + (id % 13) * 500 - 1500 AS p_lat"


def _project_sql(p: str, a: str, b: str) -> str:
    kx = f"cos(radians({base.deg(p + '_lat')}))"
    dx, dy = f"(({base.deg(b + '_lng')} - {base.deg(a + '_lng')}) * {kx})", f"({base.deg(b + '_lat')} - {base.deg(a + '_lat')})"
    px, py = f"(({base.deg(p + '_lng')} - {base.deg(a + '_lng')}) * {kx})", f"({base.deg(p + '_lat')} - {base.deg(a + '_lat')})"
    square = f"({dx} * {dx} + {dy} * {dy})"
    return f"CASE WHEN {square} = 0 THEN 0::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, ({px} * {dx} + {py} * {dy}) / {square})) END"


@query(
    f"WITH {RAW}, c AS (SELECT id, a_lng, a_lat, m_lng, m_lat, {NEAR} FROM raw), t AS (SELECT *, {_project_sql('p', 'a', 'm')} AS t FROM c), "
    f"q AS (SELECT *, {base.deg('a_lng')} + ({base.deg('m_lng')} - {base.deg('a_lng')}) * t AS lng, {base.deg('a_lat')} + ({base.deg('m_lat')} - {base.deg('a_lat')}) * t AS lat FROM t) "
    f"SELECT id, {base.half_up('t', 6)} AS t, {base.half_up('lng', 7)} AS lng, {base.half_up('lat', 7)} AS lat, {base.half_up(base.haversine(base.deg('p_lng'), base.deg('p_lat'), 'lng', 'lat'), 3)} AS distance_m FROM q"
)
def project_point(spark, sf_dir):
    p = network.paths(spark, sf_dir).select("id", C("coordinates")[0].alias("a"), C("coordinates")[1].alias("b"))
    plng, plat = (geo.degrees(C(f"a.{c}") + (C("id") % k) * s - o) for c, k, s, o in (("lng_e7", 17, 700, 2000), ("lat_e7", 13, 500, 1500)))
    hit = geo.project(plng, plat, *(geo.degrees(C(f"{x}.{c}")) for x in "ab" for c in ("lng_e7", "lat_e7")))
    d = geo.haversine(plng, plat, hit["lng"], hit["lat"])
    return p.select("id", half_up(hit["t"], 6).alias("t"), half_up(hit["lng"], 7).alias("lng"), half_up(hit["lat"], 7).alias("lat"), half_up(d, 3).alias("distance_m"))


CUM = f"cum AS (SELECT *, {base.haversine_e7('a', 'm')} AS c1, {LENGTH} AS c2 FROM raw)"


def _at(d: str, c: str) -> str:
    """Coordinate of the point at distance d on a three-vertex line."""
    a, m, b = (base.deg(f"{p}_{c}") for p in "amb")
    return f"CASE WHEN {d} <= 0 THEN {a} WHEN {d} <= c1 THEN {a} + ({m} - {a}) * ({d} / c1) WHEN {d} <= c2 THEN {m} + ({b} - {m}) * (({d} - c1) / (c2 - c1)) ELSE {b} END"


@query(f"WITH {RAW}, {CUM}, d AS (SELECT *, (id % 150)::DOUBLE - 10 AS d FROM cum) SELECT id, {base.half_up(_at('d', 'lng'), 6)} AS lng, {base.half_up(_at('d', 'lat'), 6)} AS lat FROM d")
def point_at_distance(spark, sf_dir):
    p = _line(spark, sf_dir).withColumn("p", polylines.point_at(C("coordinates"), C("cum"), (C("id") % 150).cast("double") - 10))
    return p.select("id", half_up(C("p.lng"), 6).alias("lng"), half_up(C("p.lat"), 6).alias("lat"))


@query(
    f"WITH {RAW}, {CUM}, d AS (SELECT *, (id % 60)::DOUBLE AS lo, (id % 60 + 35)::DOUBLE AS hi FROM cum), "
    f"p AS (SELECT id, lo AS o, {_at('lo', 'lng')} AS lng, {_at('lo', 'lat')} AS lat FROM d UNION ALL SELECT id, c1, {base.deg('m_lng')}, {base.deg('m_lat')} FROM d WHERE c1 > lo AND c1 < hi UNION ALL SELECT id, c2, {base.deg('b_lng')}, {base.deg('b_lat')} FROM d WHERE c2 > lo AND c2 < hi UNION ALL SELECT id, hi, {_at('hi', 'lng')}, {_at('hi', 'lat')} FROM d) "
    f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY CASE WHEN id % 2 = 0 THEN -o ELSE o END) - 1 AS INTEGER) AS pos, {base.half_up('lng', 6)} AS lng, {base.half_up('lat', 6)} AS lat FROM p"
)
def slice_polyline(spark, sf_dir):
    lo, hi = (C("id") % 60).cast("double"), (C("id") % 60 + 35).cast("double")
    even = C("id") % 2 == 0
    ends = {"from_m": F.when(even, hi).otherwise(lo), "to_m": F.when(even, lo).otherwise(hi)}
    return polylines.sliced(_line(spark, sf_dir).withColumns(ends)).select("id", "pos", half_up(C("lng"), 6).alias("lng"), half_up(C("lat"), 6).alias("lat"))


@query("SELECT event_id, CAST(floor((value - 50) * 10000000::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS e7 FROM events")
def quantise(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", geo.to_e7(C("value") - 50).alias("e7"))


def _pieces_sql(p: str, q: str, n: int) -> str:
    return f"SELECT id, {n} AS piece, least({p}_lng, {q}_lng) AS x0, greatest({p}_lng, {q}_lng) AS x1, least({p}_lat, {q}_lat) AS y0, greatest({p}_lat, {q}_lat) AS y1 FROM raw"


@query(
    f"WITH {RAW}, p AS ({_pieces_sql('a', 'm', 0)} UNION ALL {_pieces_sql('m', 'b', 1)}), "
    f"x AS (SELECT *, unnest(range(CAST(floor(x0 / {CELL}) AS BIGINT), CAST(floor(x1 / {CELL}) AS BIGINT) + 1)) AS cx FROM p) SELECT id, CAST(piece AS INTEGER) AS piece, cx, unnest(range(CAST(floor(y0 / {CELL}) AS BIGINT), CAST(floor(y1 / {CELL}) AS BIGINT) + 1)) AS cy FROM x"
)
def grid_cells(spark, sf_dir):
    return polylines.gridded(polylines.pieces(network.paths(spark, sf_dir)), CELL).select("id", "piece", "cx", "cy")


def _spheroid_sql(p: str, q: str) -> str:
    lng1, lat1, lng2, lat2 = (base.deg(f"{x}_{c}") for x in (p, q) for c in ("lng", "lat"))
    f = repr(geo.FLATTENING)
    b1, b2 = (f"atan((1 - {f}::DOUBLE) * tan(radians({x})))" for x in (lat1, lat2))
    angle = f"(2 * asin(least(1::DOUBLE, sqrt(pow(sin(({b2} - {b1}) / 2), 2) + cos({b1}) * cos({b2}) * pow(sin(radians({lng2} - {lng1}) / 2), 2)))))"
    x = f"(({angle} - sin({angle})) * pow(sin(({b1} + {b2}) / 2) * cos(({b2} - {b1}) / 2) / cos({angle} / 2), 2))"
    y = f"(({angle} + sin({angle})) * pow(cos(({b1} + {b2}) / 2) * sin(({b2} - {b1}) / 2) / sin({angle} / 2), 2))"
    return f"(6378137::DOUBLE * ({angle} - {f}::DOUBLE / 2 * ({x} + {y})))"


@query(f"WITH {RAW} SELECT id, {base.half_up(_spheroid_sql('a', 'm') + ' + ' + _spheroid_sql('m', 'b'), 3)} AS length_m FROM raw")
def spheroid_length(spark, sf_dir):
    p = polylines.pieces(network.paths(spark, sf_dir))
    m = geo.spheroid_metres(*(geo.degrees(C(f"{x}.{c}")) for x in "ab" for c in ("lng_e7", "lat_e7")))
    return p.groupBy("id").agg(half_up(F.sum(m), 3).alias("length_m"))


@query(f"WITH {POINTS} SELECT id, {base.half_up('6378137::DOUBLE * radians(' + base.deg('lng_e7') + ')', 3)} AS x, {base.half_up('6378137::DOUBLE * ln(tan(0.7853981633974483::DOUBLE + radians(' + base.deg('lat_e7') + ') / 2))', 3)} AS y FROM pts")
def web_mercator(spark, sf_dir):
    x, y = geo.mercator(geo.degrees(C("lng_e7")), geo.degrees(C("lat_e7")))
    return network.points(spark, sf_dir).select("id", half_up(x, 3).alias("x"), half_up(y, 3).alias("y"))


TILES = "tile AS (SELECT p_partkey AS id, p_partkey % 25 - 1 AS z, (p_partkey * 13) % 300 AS x, (p_partkey * 7) % 250 AS y FROM part)"
SIDE = "40075016.686::DOUBLE / pow(2::DOUBLE, z)"


def _tiles(spark, sf_dir):
    k = C("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), (k % 25 - 1).alias("z"), ((k * 13) % 300).alias("x"), ((k * 7) % 250).alias("y"))


@query(f"WITH {TILES} SELECT id, " + ", ".join(f"{base.half_up(v, 3)} AS {n}" for n, v in (("min_x", f"x * ({SIDE}) - 20037508.343::DOUBLE"), ("max_x", f"(x + 1) * ({SIDE}) - 20037508.343::DOUBLE"), ("min_y", f"20037508.343::DOUBLE - (y + 1) * ({SIDE})"), ("max_y", f"20037508.343::DOUBLE - y * ({SIDE})"))) + " FROM tile WHERE z >= 0")
def tile_envelope(spark, sf_dir):
    b = geo.tile_bounds(C("z"), C("x"), C("y"))
    return _tiles(spark, sf_dir).where("z >= 0").select("id", *(half_up(v, 3).alias(n) for n, v in b.items()))


@query(f"WITH {TILES} SELECT id, CASE WHEN z NOT BETWEEN 0 AND 22 OR x >= pow(2::DOUBLE, z) OR y >= pow(2::DOUBLE, z) THEN 'BAD_REQUEST' WHEN z < 8 THEN 'ZOOM_TOO_LOW' ELSE 'OK' END AS status FROM tile")
def tile_status(spark, sf_dir):
    side = F.pow(F.lit(2.0), C("z"))
    bad = ~C("z").between(0, 22) | (C("x") < 0) | (C("y") < 0) | (C("x") >= side) | (C("y") >= side)
    return _tiles(spark, sf_dir).select("id", F.when(bad, "BAD_REQUEST").when(C("z") < 8, "ZOOM_TOO_LOW").otherwise("OK").alias("status"))


def _plane(p: str) -> tuple[str, str]:
    return f"(6378137::DOUBLE * radians({base.deg(p + '_lng')}))", f"(6378137::DOUBLE * ln(tan(0.7853981633974483::DOUBLE + radians({base.deg(p + '_lat')}) / 2)))"


def _off_line() -> str:
    """Map-plane distance of the middle vertex from the line between the ends."""
    (ax, ay), (mx, my), (bx, by) = map(_plane, "amb")
    t = f"greatest(0, least(1, (({mx} - {ax}) * ({bx} - {ax}) + ({my} - {ay}) * ({by} - {ay})) / (pow({bx} - {ax}, 2) + pow({by} - {ay}, 2))))"
    return f"sqrt(pow({mx} - {ax} - {t} * ({bx} - {ax}), 2) + pow({my} - {ay} - {t} * ({by} - {ay}), 2))"


@query(
    f"WITH {RAW}, k AS (SELECT *, {_off_line()} > 5 AS bent FROM raw) SELECT id, 0 AS pos, a_lng AS lng_e7, a_lat AS lat_e7 FROM k UNION ALL SELECT id, 1, m_lng, m_lat FROM k WHERE bent UNION ALL SELECT id, CASE WHEN bent THEN 2 ELSE 1 END, b_lng, b_lat FROM k"
)
def simplify(spark, sf_dir):
    """Vertices left of each line: those at most five metres of the map plane off it go."""
    return polylines.vertices(hulls.simplified(network.paths(spark, sf_dir).select("id", "coordinates"), tolerance_m=5.0))


#: Gift wrapping: the next corner has no point to the right of the way to it, and none farther on it.
_TURN = "(q.lng_e7 - h.lng_e7) * (z.lat_e7 - h.lat_e7) - (q.lat_e7 - h.lat_e7) * (z.lng_e7 - h.lng_e7)"
_FARTHER = "abs(z.lng_e7 - h.lng_e7) + abs(z.lat_e7 - h.lat_e7) > abs(q.lng_e7 - h.lng_e7) + abs(q.lat_e7 - h.lat_e7)"


def hull_sql(points: str) -> str:
    """Recursive CTEs from distinct points (grp, lng_e7, lat_e7) to corners h (grp, pos, lng_e7, lat_e7)."""
    return (
        f"first AS (SELECT grp, lng_e7, lat_e7 FROM {points} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY lng_e7, lat_e7) = 1), "
        f"h AS (SELECT grp, 0 AS pos, lng_e7, lat_e7 FROM first UNION ALL SELECT n.grp, n.pos, n.lng_e7, n.lat_e7 FROM (SELECT h.grp, h.pos + 1 AS pos, q.lng_e7, q.lat_e7 FROM h JOIN {points} q ON q.grp = h.grp AND (q.lng_e7 <> h.lng_e7 OR q.lat_e7 <> h.lat_e7) "
        f"JOIN {points} z ON z.grp = h.grp GROUP BY h.grp, h.pos, q.lng_e7, q.lat_e7 HAVING NOT bool_or({_TURN} < 0 OR {_TURN} = 0 AND {_FARTHER})) n ANTI JOIN first f ON f.grp = n.grp AND f.lng_e7 = n.lng_e7 AND f.lat_e7 = n.lat_e7)"
    )


@query(f"WITH RECURSIVE {POINTS}, g AS (SELECT DISTINCT id % 16 AS grp, lng_e7, lat_e7 FROM pts), {hull_sql('g')} SELECT grp, pos, lng_e7, lat_e7 FROM h")
def convex_hull(spark, sf_dir):
    return hulls.group_hulls(network.points(spark, sf_dir).select((C("id") % 16).alias("grp"), "lng_e7", "lat_e7"), "grp")


@query(f"WITH {RAW}, {VERTICES} SELECT min(lng) AS min_lng, max(lng) AS max_lng, min(lat) AS min_lat, max(lat) AS max_lat FROM vtx")
def extent(spark, sf_dir):
    return polylines.vertices(network.paths(spark, sf_dir)).agg(*(f(f"{c}_e7").alias(f"{n}_{c}") for c in ("lng", "lat") for n, f in (("min", F.min), ("max", F.max))))


PIECES = "piece AS (SELECT a.id, a.pos AS piece, a.lng AS a_lng, a.lat AS a_lat, b.lng AS b_lng, b.lat AS b_lat FROM vtx a JOIN vtx b ON a.id = b.id AND b.pos = a.pos + 1)"


@query(
    f"WITH {SEG}, {VERTICES}, {PIECES}, p AS (SELECT DISTINCT osm_id, CASE WHEN a_lng < b_lng OR a_lng = b_lng AND a_lat <= b_lat THEN row(a_lng, a_lat, b_lng, b_lat) ELSE row(b_lng, b_lat, a_lng, a_lat) END AS k FROM piece JOIN (SELECT id, osm_id FROM raw) USING (id)), "
    f"q AS (SELECT osm_id, k[1] AS a_lng, k[2] AS a_lat, k[3] AS b_lng, k[4] AS b_lat FROM p) SELECT osm_id, {base.half_up('sum(' + base.haversine_e7('a', 'b') + ')', 3)} AS covered_m FROM q GROUP BY osm_id"
)
def dissolved_length(spark, sf_dir):
    p = polylines.pieces(network.paths(spark, sf_dir), "osm_id")
    return hulls.dissolved(p, "osm_id").select("osm_id", half_up(C("metres"), 3).alias("covered_m"))


