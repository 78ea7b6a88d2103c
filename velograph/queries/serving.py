"""Tiles, coverage, places, request checks and client-side values."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import vocab as V
from ..functions.exprs import half_up
from ..operators import areas, graph, hulls, polylines, serving, snap, tiles
from ..runtime import materialise, shared_folder
from ..sources import named, network
from . import base, routes  # noqa: F401  route statuses are answered here
from .base import PLACES, POINTS, QUERIES, SEG, SQL, query, strings
from .domain import TILE_CLASS
from .geometry import PIECES, RAW, VERTICES, hull_sql
from .graph import CLICKS, EDGES, components_sql, nearest_sql

C = F.col
ZOOM, OVERVIEW = 14, 10


def _merc(p: str) -> tuple[str, str]:
    return f"6378137::DOUBLE * radians({base.deg(p + '_lng')})", f"6378137::DOUBLE * ln(tan(0.7853981633974483::DOUBLE + radians({base.deg(p + '_lat')}) / 2))"


def _tiles_sql(zoom: int, where: str) -> str:
    side, half = f"({geo.WORLD_M!r}::DOUBLE / {2**zoom})", f"{geo.WORLD_M / 2!r}::DOUBLE"
    xs, ys = (", ".join(_merc(p)[i] for p in "amb") for i in (0, 1))
    cell = lambda e: f"CAST(floor({e} / {side}) AS BIGINT)"
    return (
        f"bx AS (SELECT *, least({xs}) AS min_x, greatest({xs}) AS max_x, least({ys}) AS min_y, greatest({ys}) AS max_y FROM seg WHERE {where}), "
        f"tx AS (SELECT *, unnest(range({cell(f'(min_x + {half})')}, {cell(f'(max_x + {half})')} + 1)) AS tx FROM bx), txy AS (SELECT *, unnest(range({cell(f'({half} - max_y)')}, {cell(f'({half} - min_y)')} + 1)) AS ty FROM tx)"
    )


@query(
    f"WITH {SEG}, {_tiles_sql(ZOOM, 'true')} SELECT {ZOOM} AS z, tx, ty, id, osm_id, source, name, category, raw_surface AS surface, array_to_string(hazards, ',') AS hazards, {TILE_CLASS} AS surface_class, "
    f"raw_surface IS NULL AND {base.sealed('category', 'sidewalk')} AS surface_inferred FROM txy"
)
def detail_tile(spark, sf_dir):
    return serving.detail_features(network.paths(spark, sf_dir), ZOOM).drop("xy")


@query(f"WITH {SEG}, {_tiles_sql(OVERVIEW, chr(115) + 'ource = ' + chr(39) + 'vic_dtp_bin' + chr(39))} SELECT {OVERVIEW} AS z, tx, ty, category, {TILE_CLASS} AS surface_class, count(*) AS paths FROM txy GROUP BY ALL")
def overview_tile(spark, sf_dir):
    return serving.overview_features(network.paths(spark, sf_dir), OVERVIEW)


@query(f"WITH {SEG}, {_tiles_sql(12, 'true')} SELECT tx, ty, count(*) AS paths FROM txy GROUP BY tx, ty")
def tile_bbox_join(spark, sf_dir):
    return serving.in_tiles(serving.tile_boxes(network.paths(spark, sf_dir)), 12).groupBy("tx", "ty").agg(F.count("*").alias("paths"))


def _in_units(p: str) -> tuple[str, str]:
    """A vertex in the tile's units."""
    side, half, (x, y) = f"({geo.WORLD_M!r}::DOUBLE / {2**ZOOM})", f"{geo.WORLD_M / 2!r}::DOUBLE", _merc(p)
    return f"(({x} + {half} - tx * {side}) / {side} * 4096)", f"(({half} - ty * {side} - {y}) / {side} * 4096)"


def _clip(x: str, y: str, dx: str, dy: str) -> tuple[str, str]:
    """The shares of a piece at which it enters and leaves the tile with its buffer, from -64 to 4160."""
    enter = [f"CASE WHEN {d} > 0 THEN (-64 - {v}) / {d} WHEN {d} < 0 THEN (4160 - {v}) / {d} WHEN {v} < -64 OR {v} > 4160 THEN 2 ELSE 0 END" for v, d in ((x, dx), (y, dy))]
    leave = [f"CASE WHEN {d} > 0 THEN (4160 - {v}) / {d} WHEN {d} < 0 THEN (-64 - {v}) / {d} ELSE 1 END" for v, d in ((x, dx), (y, dy))]
    return f"greatest(0::DOUBLE, {enter[0]}, {enter[1]})", f"least(1::DOUBLE, {leave[0]}, {leave[1]})"


_ROUND = lambda x, y: f"[CAST(round_even({x}, 0) AS BIGINT), CAST(round_even({y}, 0) AS BIGINT)]"
_AT = lambda p, t, n: _ROUND(f"({p}_x + {t} * dx{n})", f"({p}_y + {t} * dy{n})")
_LEFT = lambda q, p, n: f"CASE WHEN o{n} = 1 THEN {_ROUND(q + '_x', q + '_y')} ELSE {_AT(p, f'o{n}', n)} END"
TILE_GEOM = (
    f"WITH {SEG}, {_tiles_sql(ZOOM, 'true')}, u AS (SELECT tx, ty, id, " + ", ".join(f"{v} AS {p}_{c}" for p in "amb" for c, v in zip("xy", _in_units(p), strict=True)) + " FROM txy), "
    "d AS (SELECT *, m_x - a_x AS dx1, m_y - a_y AS dy1, b_x - m_x AS dx2, b_y - m_y AS dy2 FROM u), "
    f"t AS (SELECT *, {_clip('a_x', 'a_y', 'dx1', 'dy1')[0]} AS i1, {_clip('a_x', 'a_y', 'dx1', 'dy1')[1]} AS o1, {_clip('m_x', 'm_y', 'dx2', 'dy2')[0]} AS i2, {_clip('m_x', 'm_y', 'dx2', 'dy2')[1]} AS o2 FROM d), "
    f"l AS (SELECT tx, ty, id, CASE WHEN i1 <= o1 AND i2 <= o2 AND o1 = 1 AND i2 = 0 THEN [[{_AT('a', 'i1', 1)}, {_ROUND('m_x', 'm_y')}, {_LEFT('b', 'm', 2)}]] "
    f"ELSE list_concat(CASE WHEN i1 <= o1 THEN [[{_AT('a', 'i1', 1)}, {_LEFT('m', 'a', 1)}]] ELSE [] END, CASE WHEN i2 <= o2 THEN [[{_AT('m', 'i2', 2)}, {_LEFT('b', 'm', 2)}]] ELSE [] END) END AS parts FROM t), "
    "k AS (SELECT tx, ty, id, list_filter(list_transform(parts, lambda q: list_filter(q, lambda x, i: i = 1 OR x <> q[i - 1])), lambda q: len(q) > 1) AS parts FROM l), "
    "e AS (SELECT tx, ty, id, generate_subscripts(parts, 1) - 1 AS part, unnest(parts) AS line FROM k), v AS (SELECT tx, ty, id, part, generate_subscripts(line, 1) - 1 AS pos, unnest(line) AS p FROM e) "
    f"SELECT {ZOOM} AS z, tx, ty, id, CAST(part AS INTEGER) AS part, CAST(pos AS INTEGER) AS pos, CAST(p[1] AS INTEGER) AS px, CAST(p[2] AS INTEGER) AS py FROM v"
)


@query(TILE_GEOM)
def tile_geom(spark, sf_dir):
    return serving.tile_geometry(serving.detail_features(network.paths(spark, sf_dir), ZOOM))


@query()
def overview_lines(spark, sf_dir):
    """Merged and simplified lines of each tile, category and class."""
    u = tiles.merged(tiles.in_units(serving.overview_paths(network.paths(spark, sf_dir), OVERVIEW), simplify=True), "category", "surface_class")
    return u.select("z", "tx", "ty", "category", "surface_class", F.size("parts").alias("lines"), F.to_json("parts").alias("parts"))


@query()
def tile_bytes(spark, sf_dir):
    """Vector tiles of one overview and one detail level: status, features and bytes of every tile asked for."""
    p = network.paths(spark, sf_dir)
    made = materialise(serving.overview_tiles(p, OVERVIEW).unionByName(serving.detail_tiles(p, ZOOM)))
    wanted = made.select("z", "tx", "ty").unionByName(made.select("z", (C("tx") + 100_000).alias("tx"), "ty").limit(1))
    return tiles.asked(made, wanted)


@query()
def tile_files(spark, sf_dir):
    """The tiles of a detail level as files by z, x and y, read back; empty ones are no file."""
    path = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    made = materialise(serving.detail_tiles(network.paths(spark, sf_dir), ZOOM))
    empty = made.select("z", (C("tx") + 100_000).alias("tx"), "ty", F.lit(None).cast("binary").alias("mvt"))
    named.write_tiles(made.select("z", "tx", "ty", "mvt").unionByName(empty), path)
    return named.read_tiles(spark, path).select("z", "tx", "ty", F.length("mvt").alias("bytes"), F.md5("mvt").alias("digest"))


#: Points in loose groups, so that clusters are many.
SPREAD = "sp AS (SELECT id, lng_e7 + (id % 23) * 2000000 AS p_lng, lat_e7 + (id % 7) * 3000000 AS p_lat FROM pts)"


def _spread(spark, sf_dir):
    return network.points(spark, sf_dir).select("id", (C("lng_e7") + (C("id") % 23) * 2_000_000).alias("lng_e7"), (C("lat_e7") + (C("id") % 7) * 3_000_000).alias("lat_e7"))


_LINK = base.haversine("a.p_lng / 1e7", "a.p_lat / 1e7", "b.p_lng / 1e7", "b.p_lat / 1e7")


CLUSTERS = (
    f"WITH RECURSIVE {POINTS}, {SPREAD}, c AS (SELECT *, p_lng // 1000000 AS cx, CAST(floor(p_lat / 1000000) AS BIGINT) AS cy FROM sp), n AS (SELECT *, cx + unnest([-1, 0, 1]) AS nx FROM c), nn AS (SELECT *, cy + unnest([-1, 0, 1]) AS ny FROM n), "
    f"l AS (SELECT a.id AS a, b.id AS b FROM nn a JOIN c b ON a.nx = b.cx AND a.ny = b.cy WHERE a.id < b.id AND {_LINK} <= 3000), {components_sql('l')} SELECT id, coalesce(label, id) AS cluster FROM sp LEFT JOIN spread ON node = id"
)


@query(CLUSTERS)
def cluster_dbscan(spark, sf_dir):
    return serving.clusters(_spread(spark, sf_dir), 3000.0)


_MM = [f"CAST(floor({v} * 1000 + 0.5::DOUBLE) AS BIGINT)" for v in _merc("p")]


@query(
    f"WITH RECURSIVE {POINTS}, {SPREAD}, m AS (SELECT id, {_MM[0]} AS x, {_MM[1]} AS y FROM sp), c AS (SELECT *, CAST(floor(x / 4000000) AS BIGINT) AS cx, CAST(floor(y / 4000000) AS BIGINT) AS cy FROM m), n AS (SELECT *, cx + unnest([-1, 0, 1]) AS nx FROM c), nn AS (SELECT *, cy + unnest([-1, 0, 1]) AS ny FROM n), "
    f"l AS (SELECT a.id AS a, b.id AS b FROM nn a JOIN c b ON a.nx = b.cx AND a.ny = b.cy WHERE a.id < b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 3000000), {components_sql('l')} SELECT id, coalesce(label, id) AS cluster FROM sp LEFT JOIN spread ON node = id"
)
def cluster_dbscan_all(spark, sf_dir):
    """All points clustered in the map plane's units."""
    return serving.clusters(_spread(spark, sf_dir), 3000.0, mercator=True)


def _hulls(spark, sf_dir):
    return areas.rings(hulls.group_hulls(network.area_points(spark, sf_dir), "area"), "area")


UNIT = repr(areas.UNIT_M) + "::DOUBLE"
#: Corners, edges and boxes of the small areas.
AREAS = (
    "ap AS (" + base.cte(network.AREA_POINTS) + f"), g AS (SELECT DISTINCT area AS grp, lng_e7, lat_e7 FROM ap), {hull_sql('g')}, "
    "v AS (SELECT grp, pos, lng_e7::DOUBLE AS x, lat_e7::DOUBLE AS y, count(*) OVER (PARTITION BY grp) AS n, first(lat_e7) OVER (PARTITION BY grp ORDER BY pos) AS y0 FROM h), "
    "e AS (SELECT grp, pos, n, y0, x AS ax, y AS ay, coalesce(lead(x) OVER w, first(x) OVER w) AS bx, coalesce(lead(y) OVER w, first(y) OVER w) AS by_ FROM v WINDOW w AS (PARTITION BY grp ORDER BY pos))"
)


def _segment_m(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Metres from a point to a segment; longitudes are scaled by k already."""
    t = f"greatest(0::DOUBLE, least(1::DOUBLE, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / greatest(pow({bx} - {ax}, 2) + pow({by} - {ay}, 2), 1e-30)))"
    return f"sqrt(pow({px} - {ax} - {t} * ({bx} - {ax}), 2) + pow({py} - {ay} - {t} * ({by} - {ay}), 2)) * {UNIT}"


def _side(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    return f"(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"


def _cross(a: str, b: str, c: str, d: str) -> str:
    """Whether two segments cross, of 'x, y' pairs."""
    return f"{_side(*c.split(), *a.split(), *b.split())} * {_side(*d.split(), *a.split(), *b.split())} < 0 AND {_side(*a.split(), *c.split(), *d.split())} * {_side(*b.split(), *c.split(), *d.split())} < 0"


_PARTS_SQL = (
    f"pq AS (SELECT p.grp AS a, q.grp AS b, p.pos, q.n, p.ax, p.ay, p.bx, p.by_, q.ax AS cx, q.ay AS cy, q.bx AS dx, q.by_ AS dy, cos(radians((p.y0::DOUBLE + q.y0) / 2 / 1e7)) AS k FROM e p JOIN e q ON p.grp <> q.grp), "
    f"pd AS (SELECT least(a, b) AS a, greatest(a, b) AS b, a AS own, pos, n, min({_segment_m('ax * k', 'ay', 'cx * k', 'cy', 'dx * k', 'dy')}) AS d, min({_side('ax', 'ay', 'cx', 'cy', 'dx', 'dy')}) AS s, bool_or({_cross('ax ay', 'bx by_', 'cx cy', 'dx dy')}) AS crossed FROM pq GROUP BY ALL), "
    "l AS (SELECT a, b FROM pd GROUP BY a, b HAVING min(d) <= 2000 OR bool_or(n > 2 AND s >= 0) OR bool_or(crossed))"
)


@query(f"WITH RECURSIVE {AREAS}, {_PARTS_SQL}, {components_sql('l')} SELECT grp AS area, coalesce(label, grp) AS part FROM (SELECT DISTINCT grp FROM v) z LEFT JOIN spread ON node = grp")
def area_parts(spark, sf_dir):
    """Which part of the union of all buffers each area belongs to."""
    return areas.united(_hulls(spark, sf_dir), serving.COVER_M)


@query(f"WITH RECURSIVE {AREAS}, {_PARTS_SQL}, {components_sql('l')} SELECT count(DISTINCT coalesce(label, grp)) AS parts, count(*) AS areas FROM (SELECT DISTINCT grp FROM v) z LEFT JOIN spread ON node = grp")
def area_count(spark, sf_dir):
    return areas.united(_hulls(spark, sf_dir), serving.COVER_M).agg(F.countDistinct("part").alias("parts"), F.count("*").alias("areas"))


def _meets_sql(pieces: str) -> str:
    """Ids of pieces (id, a_lng, a_lat, b_lng, b_lat) within 1000 m of an area."""
    box = "bx AS (SELECT grp, min(x) - 200000 AS x0, max(x) + 200000 AS x1, min(y) - 200000 AS y0, max(y) + 200000 AS y1 FROM v GROUP BY grp)"
    d = ", ".join(_segment_m(*x.split(",")) for x in ("px * k,py,ax * k,ay,bx * k,by_", "qx * k,qy,ax * k,ay,bx * k,by_", "ax * k,ay,px * k,py,qx * k,qy", "bx * k,by_,px * k,py,qx * k,qy"))
    return (
        f"{box}, pc AS (SELECT id, piece, a_lng::DOUBLE AS px, a_lat::DOUBLE AS py, b_lng::DOUBLE AS qx, b_lat::DOUBLE AS qy, cos(radians(a_lat / 1e7)) AS k FROM {pieces}), "
        "cand AS (SELECT pc.*, e.* FROM pc JOIN bx ON least(px, qx) <= x1 AND greatest(px, qx) >= x0 AND least(py, qy) <= y1 AND greatest(py, qy) >= y0 JOIN e ON e.grp = bx.grp), "
        f"hit AS (SELECT id, piece, grp, min(least({d})) AS d, min({_side('px', 'py', 'ax', 'ay', 'bx', 'by_')}) AS s, min({_side('qx', 'qy', 'ax', 'ay', 'bx', 'by_')}) AS t, bool_or({_cross('px py', 'qx qy', 'ax ay', 'bx by_')}) AS crossed, max(n) AS n FROM cand GROUP BY id, piece, grp), "
        "ok AS (SELECT DISTINCT id FROM hit WHERE d <= 1000 OR crossed OR n > 2 AND (s >= 0 OR t >= 0))"
    )


@query(f"WITH RECURSIVE {SEG}, {VERTICES}, {PIECES}, {AREAS}, {_meets_sql('piece')} SELECT id, osm_id, source FROM raw SEMI JOIN ok USING (id)")
def ways_in_areas(spark, sf_dir):
    """Lines that meet the buffer of an area."""
    p = network.paths(spark, sf_dir).select("id", "osm_id", "source", "coordinates")
    return areas.lines_within(p, _hulls(spark, sf_dir), serving.COVER_M).select("id", "osm_id", "source")


@query(f"WITH RECURSIVE {POINTS}, {AREAS}, {_meets_sql('(SELECT id, 0 AS piece, lng_e7 AS a_lng, lat_e7 AS a_lat, lng_e7 AS b_lng, lat_e7 AS b_lat FROM pts)')} SELECT id FROM ok")
def points_in_areas(spark, sf_dir):
    return serving.within_coverage(network.points(spark, sf_dir), _hulls(spark, sf_dir))


@query()
def coverage_areas(spark, sf_dir):
    """Hulls of all clusters, with the part of the union of their buffers that each belongs to."""
    hull = serving.coverage(_spread(spark, sf_dir), 3000.0)
    parts = areas.united(areas.rings(hull), serving.COVER_M)
    return hull.join(parts.withColumnRenamed("area", "cluster"), "cluster").select("cluster", "part", "pos", "lng_e7", "lat_e7")


@query()
def within_coverage(spark, sf_dir):
    hull = serving.coverage(_spread(spark, sf_dir), 3000.0)
    return serving.within_coverage(network.points(spark, sf_dir), areas.rings(hull))


ADDRESS = "CASE WHEN nullif(street, '') IS NOT NULL THEN concat_ws(' ', nullif(housenumber, ''), street) END"
PLACE = (
    f"pl AS (SELECT place_id, CASE WHEN named THEN name END AS own, {ADDRESS} AS address, coalesce(locality, district, city) AS suburb, postcode, osm_key, osm_value, lng_e7, lat_e7 FROM place WHERE state = 'Victoria'), "
    "pn AS (SELECT *, coalesce(own, address, suburb) AS label FROM pl), pd AS (SELECT *, concat_ws(', ', CASE WHEN own IS NOT NULL THEN address END, CASE WHEN suburb <> label THEN suburb END) AS parts FROM pn), "
    "pf AS (SELECT place_id, label AS name, nullif(concat_ws(' ', nullif(parts, ''), postcode), '') AS detail, coalesce(osm_key, '?') || '=' || coalesce(osm_value, '?') AS category, lng_e7, lat_e7 FROM pd WHERE label IS NOT NULL)"
)


@query(f"WITH {PLACES}, {PLACE} SELECT * FROM pf")
def place_from_feature(spark, sf_dir):
    return serving.place_of(network.places(spark, sf_dir))


_WORDS = lambda x: f"list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''))"
SEARCH = (
    f"WITH src AS ({base.cte(network.PLACES)}), place AS (SELECT * REPLACE (lng_e7 + CASE WHEN place_id % 13 = 0 THEN 100000000 ELSE 0 END AS lng_e7) FROM src), {PLACE}, ask AS ({base.cte(network.SEARCHES)}), "
    f"q AS (SELECT query_id, near_lng_e7, near_lat_e7, {_WORDS('text')} AS terms FROM ask), "
    f"p AS (SELECT *, {_WORDS(chr(99) + 'oncat_ws(' + chr(39) + ' ' + chr(39) + ', CASE WHEN named THEN name END, housenumber, street, locality, district, city, postcode)')} AS words FROM place WHERE lng_e7 BETWEEN 1409000000 AND 1501000000 AND lat_e7 BETWEEN -393000000 AND -339000000 "
    f"AND coalesce(osm_key || '=' || osm_value NOT IN ({strings(V.EXCLUDED_PLACES)}) AND osm_key <> 'public_transport', true)), "
    f"m AS (SELECT query_id, place_id, round({base.haversine('floor((near_lng_e7 + 500) / 1000) * 1000 / 1e7', 'floor((near_lat_e7 + 500) / 1000) * 1000 / 1e7', 'lng_e7 / 1e7', 'lat_e7 / 1e7')}, 3) AS apart, near_lng_e7 IS NULL AS nowhere FROM q JOIN p ON len(terms) > 0 AND len(list_filter(terms, lambda t: len(list_filter(words, lambda w: starts_with(w, t))) = 0)) = 0), "
    "f AS (SELECT query_id, place_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN nowhere THEN 0 ELSE apart END, place_id) AS fetched FROM m QUALIFY fetched <= 12), "
    "o AS (SELECT query_id, fetched, pf.*, row_number() OVER (PARTITION BY query_id, name, detail ORDER BY fetched) AS n FROM f JOIN pf USING (place_id)) "
    "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fetched) AS INTEGER) AS rank, place_id, name, detail FROM o WHERE n = 1 QUALIFY rank <= 6"
)


@query(SEARCH)
def geocode_search(spark, sf_dir):
    """Searches with and without a place of their own, against all places; some places lie outside the region."""
    p = network.places(spark, sf_dir).withColumn("lng_e7", C("lng_e7") + F.when(C("place_id") % 13 == 0, 100_000_000).otherwise(0))
    return serving.search_places(p, network.searches(spark, sf_dir))


@query(f"WITH {PLACES}, {PLACE} SELECT place_id, name, detail, {base.deg('lng_e7')} AS lng, {base.deg('lat_e7')} AS lat FROM pf")
def place_files(spark, sf_dir):
    """Each place as a GeoJSON Feature in a file of its own, read back and parsed."""
    path = f"{shared_folder(spark)}/places-{uuid.uuid4().hex}"
    p = serving.place_of(network.places(spark, sf_dir))
    point = F.struct(F.lit("Point").alias("type"), F.array(geo.degrees(C("lng_e7")), geo.degrees(C("lat_e7"))).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("place_id", "name", "detail").alias("properties")))
    named.write_files(p.select(F.concat(F.lit("places/"), C("place_id").cast("string"), F.lit(".geojson")).alias("name"), F.encode(feature, "UTF-8").alias("content")), path)
    back = named.read_files(spark, path).select(F.from_json(F.decode("content", "UTF-8"), "geometry struct<coordinates:array<double>>, properties struct<place_id:long,name:string,detail:string>").alias("f"))
    return back.select("f.properties.*", C("f.geometry.coordinates")[0].alias("lng"), C("f.geometry.coordinates")[1].alias("lat"))


@query(f"WITH {PLACES}, {PLACE}, o AS (SELECT *, row_number() OVER (PARTITION BY place_id % 10, name, detail ORDER BY place_id) AS n FROM pf) SELECT place_id % 10 AS query_id, CAST(row_number() OVER (PARTITION BY place_id % 10 ORDER BY place_id) AS INTEGER) AS rank, place_id FROM o WHERE n = 1 QUALIFY rank <= 6")
def dedupe_places(spark, sf_dir):
    p = serving.place_of(network.places(spark, sf_dir)).withColumn("query_id", C("place_id") % 10)
    return serving.first_by_label(p, "query_id", [C("place_id")], 6).select("query_id", "rank", "place_id")


NAMED = PIECES.replace("SELECT a.id,", "SELECT a.id, raw.name,").replace("AND b.pos = a.pos + 1", "AND b.pos = a.pos + 1 JOIN raw ON raw.id = a.id WHERE raw.name IS NOT NULL").replace("FROM vtx a JOIN", "FROM vtx a JOIN")


@query(f"WITH {RAW}, {VERTICES}, {NAMED}, {POINTS}, {CLICKS}, {nearest_sql('clicks', 100).replace('p_lat, id, piece,', 'p_lat, id, name, piece,')} SELECT pid AS point_id, name, {base.half_up('d', 2)} AS distance_m FROM best")
def geocode_reverse(spark, sf_dir):
    p = network.points(spark, sf_dir).select(C("id").alias("point_id"), "lng_e7", "lat_e7")
    paths = network.paths(spark, sf_dir).where("name IS NOT NULL")
    n = snap.nearest(p, polylines.pieces(paths), 100.0)
    return n.join(paths.select("id", "name"), "id").select("point_id", "name", half_up(C("distance_m"), 2).alias("distance_m"))


@query("SELECT item_id, CASE WHEN length(trim(substr(text, 1, CAST(item_id % 140 AS INTEGER)))) BETWEEN 2 AND 120 THEN 'OK' ELSE 'VALIDATION_ERROR' END AS status FROM benchmark")
def geocode_status(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    q = F.length(F.trim(F.substring(C("text"), F.lit(1), (C("item_id") % 140).cast("int"))))
    return b.select("item_id", F.when(q.between(2, 120), "OK").otherwise("VALIDATION_ERROR").alias("status"))


@query(
    f"WITH {POINTS}, p AS (SELECT id, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 5 = 0 THEN {base.deg('lat_e7')} ELSE {base.deg('lng_e7')} END AS lng, CASE WHEN id % 5 = 0 THEN {base.deg('lng_e7')} WHEN id % 7 = 0 THEN {base.deg('lat_e7')} + 10 ELSE {base.deg('lat_e7')} END AS lat FROM pts) "
    "SELECT id, CASE WHEN lng IS NULL OR lat IS NULL THEN 'INVALID_REQUEST' WHEN lng BETWEEN 140.9::DOUBLE AND 150.1::DOUBLE AND lat BETWEEN -39.3::DOUBLE AND -33.9::DOUBLE THEN 'OK' WHEN lat BETWEEN 140.9::DOUBLE AND 150.1::DOUBLE AND lng BETWEEN -39.3::DOUBLE AND -33.9::DOUBLE THEN 'SWAPPED' ELSE 'OUTSIDE_REGION' END AS status FROM p"
)
def validate_request(spark, sf_dir):
    lng, lat = geo.degrees(C("lng_e7")), geo.degrees(C("lat_e7"))
    p = network.points(spark, sf_dir).select("id", F.when(C("id") % 11 == 0, None).when(C("id") % 5 == 0, lat).otherwise(lng).alias("lng"), F.when(C("id") % 5 == 0, lng).when(C("id") % 7 == 0, lat + 10).otherwise(lat).alias("lat"))
    return p.select("id", serving.request_status(C("lng"), C("lat")).alias("status"))


@query(
    f"WITH v AS ({SQL['validate_request']}), t AS ({SQL['tile_status']}), g AS ({SQL['geocode_status']}), p AS ({SQL['plan_status']}), s AS (SELECT 'request' AS source, CASE WHEN status = 'OK' THEN 'OK' ELSE 'VALIDATION_ERROR' END AS code, 1 AS n FROM v "
    "UNION ALL SELECT 'tile', CASE WHEN status = 'BAD_REQUEST' THEN 'VALIDATION_ERROR' ELSE status END, 1 FROM t UNION ALL SELECT 'place', status, 1 FROM g UNION ALL SELECT 'route', status, n FROM p) "
    "SELECT source, code, CAST(CASE code WHEN 'OK' THEN 200 WHEN 'VALIDATION_ERROR' THEN 400 WHEN 'ZOOM_TOO_LOW' THEN 400 WHEN 'START_NOT_NEAR_NETWORK' THEN 422 WHEN 'END_NOT_NEAR_NETWORK' THEN 422 WHEN 'NO_ROUTE' THEN 422 END AS INTEGER) AS status, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY ALL"
)
def error_status(spark, sf_dir):
    """What all requests, tiles, place searches and routes are answered with: code and HTTP status of each."""
    bad = F.when(C("status") == "OK", "OK").otherwise("VALIDATION_ERROR")
    asked = [("request", validate_request, bad, F.lit(1)), ("tile", QUERIES["tile_status"], F.when(C("status") == "BAD_REQUEST", "VALIDATION_ERROR").otherwise(C("status")), F.lit(1)), ("place", geocode_status, C("status"), F.lit(1)), ("route", QUERIES["plan_status"], C("status"), C("n"))]
    every = None
    for source, f, code, n in asked:
        each = f(spark, sf_dir).select(F.lit(source).alias("source"), code.alias("code"), n.cast("long").alias("n"))
        every = each if every is None else every.unionByName(each)
    return every.groupBy("source", "code").agg(F.sum("n").alias("n")).select("source", "code", serving.http_status(C("code")).alias("status"), "n")


@query(f"WITH {RAW}, {EDGES} SELECT (SELECT max(o_orderkey) FROM orders) AS import_id, (SELECT count(*) FROM raw) AS segments, (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM edge) AS edges, 'ready' AS status")
def network_info(spark, sf_dir):
    g = graph.build(network.segments(network.paths(spark, sf_dir)), tolerance_m=0, keep=("category",), bare=True)
    latest = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.max("o_orderkey").alias("import_id"))
    s = latest.join(graph.counts(g).select("segments", "nodes", "edges"))
    return s.withColumn("status", F.when(C("segments") > 0, "ready").otherwise("empty"))


@query(f"WITH {PLACES}, {PLACE} SELECT place_id, regexp_replace(coalesce(detail, ''), '\\s*\\d{{4}}$', '') AS detail, 'Near ' || name || CASE WHEN detail IS NOT NULL THEN ', ' || detail ELSE '' END AS near FROM pf")
def place_labels(spark, sf_dir):
    p = serving.place_of(network.places(spark, sf_dir))
    near = F.concat(F.lit("Near "), "name", F.when(C("detail").isNotNull(), F.concat(F.lit(", "), "detail")).otherwise(""))
    return p.select("place_id", F.regexp_replace(F.coalesce("detail", F.lit("")), r"\s*\d{4}$", "").alias("detail"), near.alias("near"))


STORED = "CASE event_id % 6 WHEN 0 THEN '{\"surface\":\"avoid_loose\",\"avoidSteps\":true}' WHEN 1 THEN '{\"surface\":\"velvet\",\"avoidBusyRoads\":true}' WHEN 2 THEN 'not json' WHEN 3 THEN '{\"surface\":\"smooth_only\"}' WHEN 4 THEN '{}' END"


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'avoid_loose' WHEN 3 THEN 'smooth_only' ELSE 'any' END AS surface, event_id % 6 = 0 AS avoid_steps, event_id % 6 = 1 AS avoid_busy FROM events")
def sanitise_preferences(spark, sf_dir):
    p = F.from_json("stored", "surface string, avoidSteps boolean, avoidBusyRoads boolean")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(STORED).alias("stored")).select("event_id", p.alias("p"))
    known = F.when(C("p.surface").isin(*V.SURFACE_PENALTIES), C("p.surface")).otherwise("any")
    return e.select("event_id", known.alias("surface"), F.coalesce("p.avoidSteps", F.lit(False)).alias("avoid_steps"), F.coalesce("p.avoidBusyRoads", F.lit(False)).alias("avoid_busy"))


