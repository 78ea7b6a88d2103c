"""Map tiles, coverage areas, places, and the checks of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, tags
from ..functions import vocab as V
from ..functions.exprs import lookup
from ..runtime import materialise, release
from . import areas, hulls, tiles
from .components import connected_components

DETAIL_ZOOM, OSM_ZOOM, LEAST_ZOOM = 12, 14, 8
CLUSTER_M, COVER_M = 3000.0, 1000.0
C = F.col


def tile_boxes(paths: DataFrame) -> DataFrame:
    """Adds the Mercator box and the vertices in Mercator metres."""
    xy = F.transform("coordinates", lambda p: F.struct(*(v.alias(n) for n, v in zip(("x", "y"), geo.mercator(geo.degrees(p["lng_e7"]), geo.degrees(p["lat_e7"])), strict=True))))
    d = paths.withColumn("xy", xy)
    return d.withColumns({"min_x": F.array_min("xy.x"), "max_x": F.array_max("xy.x"), "min_y": F.array_min("xy.y"), "max_y": F.array_max("xy.y")})


def in_tiles(boxes: DataFrame, zoom: int) -> DataFrame:
    """Each path in every tile of a zoom level that its box touches: an explode, so whole levels are made in one job."""
    side = geo.WORLD_M / 2**zoom
    half = geo.WORLD_M / 2
    tx = F.sequence(F.floor((C("min_x") + half) / side).cast("long"), F.floor((C("max_x") + half) / side).cast("long"))
    ty = F.sequence(F.floor((half - C("max_y")) / side).cast("long"), F.floor((half - C("min_y")) / side).cast("long"))
    return boxes.withColumn("tx", F.explode(tx)).withColumn("ty", F.explode(ty)).withColumn("z", F.lit(zoom))


def detail_features(paths: DataFrame, zoom: int) -> DataFrame:
    """Attributes of every path by tile; community paths only from street level."""
    shown = paths.where((C("source") == V.OFFICIAL) | F.lit(zoom >= OSM_ZOOM))
    cls, inferred = tags.tile_surface(C("category"), C("surface"), C("sidewalk"))
    t = in_tiles(tile_boxes(shown), zoom)
    return t.select("z", "tx", "ty", "id", "osm_id", "source", "name", "category", "surface", F.array_join(tags.hazards(C("hazards")), ",").alias("hazards"), cls.alias("surface_class"), inferred.alias("surface_inferred"), "xy")


def overview_paths(paths: DataFrame, zoom: int) -> DataFrame:
    """Official paths by tile: (z, tx, ty, category, surface_class, source, xy)."""
    cls, _ = tags.tile_surface(C("category"), C("surface"), C("sidewalk"))
    t = in_tiles(tile_boxes(paths.where(C("source") == V.OFFICIAL)), zoom)
    return t.select("z", "tx", "ty", "category", cls.alias("surface_class"), "source", "xy")


def overview_features(paths: DataFrame, zoom: int) -> DataFrame:
    """Official paths counted by tile, category and class: (z, tx, ty, category, surface_class, paths)."""
    return overview_paths(paths, zoom).groupBy("z", "tx", "ty", "category", "surface_class").agg(F.count("*").alias("paths"))


def overview_tiles(paths: DataFrame, zoom: int) -> DataFrame:
    """Low zooms: official paths simplified to a pixel and merged by category and class, as vector tiles."""
    return tiles.tiles(tiles.merged(tiles.in_units(overview_paths(paths, zoom), simplify=True), "category", "surface_class", "source"))


def detail_tiles(paths: DataFrame, zoom: int) -> DataFrame:
    """High zooms: every path with its attributes, as vector tiles."""
    return tiles.tiles(tiles.in_units(detail_features(paths, zoom)), "id")


def tile_geometry(features: DataFrame) -> DataFrame:
    """(z, tx, ty, id, part, pos, px, py): lines in tile units, clipped to the tile and its buffer."""
    units = tiles.in_units(features.select("z", "tx", "ty", "id", "xy"))
    each = units.select("z", "tx", "ty", "id", F.posexplode("parts").alias("part", "line"))
    points = F.transform(F.sequence(F.lit(1), F.size("line") - 1, F.lit(2)), lambda i: F.struct(*(F.element_at("line", i + k).cast("int").alias(n) for k, n in enumerate(("px", "py")))))
    return each.select("z", "tx", "ty", "id", "part", F.posexplode(points).alias("pos", "p")).select("z", "tx", "ty", "id", "part", "pos", "p.px", "p.py")


def _sphere(boxes: bool):
    """Metres between fixed-point places, or the least and most between boxes (x0, x1, y0, y1, with b before the other's)."""
    unit = geo.SPHERE_DEGREE_M / geo.FIXED
    if not boxes:
        return geo.haversine(*(geo.degrees(C(x)) for x in ("x", "y", "bx", "by")))
    low, high = _gaps()
    lat = [F.radians(geo.degrees(C(c))) for c in ("y0", "y1", "by0", "by1")]
    least = F.least(*(F.cos(v) for v in lat))
    most = F.when((F.least("y0", "by0") <= 0) & (F.greatest("y1", "by1") >= 0), 1.0).otherwise(F.greatest(*(F.cos(v) for v in lat)))
    # at a few kilometres the plane and the sphere agree to a millionth; the bounds leave ten times that
    return F.hypot(low[0] * least, low[1]) * unit * (1 - 1e-5), F.hypot(high[0] * most, high[1]) * unit * (1 + 1e-5)


def _plane(boxes: bool):
    if not boxes:
        return F.hypot((C("x") - C("bx")).cast("double"), (C("y") - C("by")).cast("double"))
    low, high = _gaps()
    return F.hypot(*low), F.hypot(*high)


def _gaps() -> tuple[list[Column], list[Column]]:
    """Least and most difference of two boxes along each axis."""
    ends = [[C(f"{p}{a}{i}").cast("double") for p in ("", "b") for i in (0, 1)] for a in "xy"]
    return [F.greatest(F.lit(0.0), q0 - p1, p0 - q1) for p0, p1, q0, q1 in ends], [F.greatest(F.abs(p1 - q0), F.abs(q1 - p0)) for p0, p1, q0, q1 in ends]


#: Comparisons of points, for each point, below which refining cells isn't worth a round.
COMPARED = 8


def _near(pairs: DataFrame, points: DataFrame, size: int, within: float, distance) -> DataFrame:
    """(head, other) of those pairs of cells (head, other, cx, cy, nx, ny) of which some points are within the distance.

    Cells are halved again and again, occupied parts only, each with the box of its points: a pair of parts that lies within the distance
    altogether links its cells, one that lies beyond is dropped, and only the others go on. Points are compared once few
    comparisons are left; parts of one point each decide themselves.
    """
    here = pairs.select(C("cx").alias("px"), C("cy").alias("py")).unionByName(pairs.select(C("nx").alias("px"), C("ny").alias("py"))).distinct()
    cell = [F.floor(C(c) / size).alias(p) for c, p in (("x", "px"), ("y", "py"))]
    held = materialise(points.select("x", "y").distinct().select("x", "y", *cell).join(here, ["px", "py"]).select("x", "y"))
    most = COMPARED * held.count() + 1_000_000
    open_, step, links = pairs.select("head", "other", *(C(c).alias(n) for c, n in (("cx", "ax"), ("cy", "ay"), ("nx", "ox"), ("ny", "oy")))), size, None
    while True:
        at = held.select(F.floor(C("x") / step).alias("i"), F.floor(C("y") / step).alias("j"), "x", "y")
        part = at.groupBy("i", "j").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))))
        other = part.select(C("i").alias("ox"), C("j").alias("oy"), *(C(c).alias(f"b{c}") for c in ("n", "x0", "x1", "y0", "y1")))
        low, high = distance(True)
        judged = materialise(open_.join(part.withColumnsRenamed({"i": "ax", "j": "ay"}), ["ax", "ay"]).join(other, ["ox", "oy"]).select("head", "other", "ax", "ay", "ox", "oy", (C("n") * C("bn")).alias("pairs"), low.alias("low"), high.alias("high")).where(C("low") <= within))
        sure = judged.where(C("high") <= within).select("head", "other").distinct()
        links = sure if links is None else links.unionByName(sure)
        rest = judged.join(sure, ["head", "other"], "left_anti")
        left = rest.agg(F.sum("pairs").alias("n")).first()["n"]
        if not left:
            return links
        if left <= most or step == 1:
            a = at.select(C("i").alias("ax"), C("j").alias("ay"), "x", "y")
            b = at.select(C("i").alias("ox"), C("j").alias("oy"), C("x").alias("bx"), C("y").alias("by"))
            met = rest.join(a, ["ax", "ay"]).join(b, ["ox", "oy"]).groupBy("head", "other").agg(F.min(distance(False)).alias("d"))
            return links.unionByName(met.where(C("d") <= within).select("head", "other"))
        half = max(1, step // 2)
        # the finer cells that a cell overlaps
        for c in ("ax", "ay", "ox", "oy"):
            rest = rest.withColumn(c, F.explode(F.sequence(F.floor(C(c) * step / half), F.floor(((C(c) + 1) * step - 1) / half))))
        open_, step = materialise(rest.select("head", "other", "ax", "ay", "ox", "oy").distinct()), half


def clusters(points: DataFrame, within_m: float = CLUSTER_M, mercator: bool = False) -> DataFrame:
    """(id, cluster): points linked when within the distance; with one point enough for a cluster, that is components.
    Distances are metres on the sphere, or with ``mercator`` units of the map plane, taken to a thousandth.

    Cells are a third of the distance wide, so all points of a cell are linked and a cell is one node. Only cells two to
    five apart that adjoining cells don't link already have their points compared, by ever smaller parts of both.
    """
    if mercator:
        x, y = (F.floor(v * 1000 + 0.5).cast("long") for v in geo.mercator(geo.degrees(C("lng_e7")), geo.degrees(C("lat_e7"))))
        p, within, size, distance = points.select("id", x.alias("x"), y.alias("y")), within_m * 1000, int(within_m * 1000 / 3), _plane
    else:
        p, within, size, distance = points.select("id", C("lng_e7").alias("x"), C("lat_e7").alias("y")), within_m, int(within_m / geo.METRES_PER_DEGREE * geo.FIXED / 3), _sphere
    p = p.withColumns({"cx": F.floor(C("x") / size), "cy": F.floor(C("y") / size)})
    cell = p.groupBy("cx", "cy").agg(F.min("id").alias("head"))
    reach = 5
    around = cell.select("cx", "cy", "head").withColumn("nx", F.explode(F.sequence(C("cx") - reach, C("cx") + reach))).withColumn("ny", F.explode(F.sequence(C("cy") - reach, C("cy") + reach)))
    other = cell.select(C("cx").alias("nx"), C("cy").alias("ny"), C("head").alias("other"))
    near_cells = materialise(around.join(other, ["nx", "ny"]).where("head < other").select("cx", "cy", "nx", "ny", "head", "other"))
    # points of adjoining cells are at most 0.95 of the distance apart, so these cells are linked unseen
    close = (F.abs(C("nx") - C("cx")) <= 1) & (F.abs(C("ny") - C("cy")) <= 1)
    sure, open_cells = near_cells.where(close), near_cells.where(~close)
    near_labels = materialise(connected_components(sure.select(C("head").alias("a"), C("other").alias("b")), near=True))
    for end in ("head", "other"):
        open_cells = open_cells.join(near_labels.select(C("node").alias(end), C("component").alias(f"{end}_part")), end, "left")
    open_cells = materialise(open_cells.where(F.coalesce("head_part", "head") != F.coalesce("other_part", "other")).drop("head_part", "other_part"))
    links = _near(open_cells, p, size, within, distance).select(C("head").alias("a"), C("other").alias("b"))
    # cells that adjoin are known by their parts already
    links = links.unionByName(near_labels.select(C("node").alias("a"), C("component").alias("b")))
    labels = connected_components(links, near=True)
    heads = cell.join(labels.withColumnRenamed("node", "head"), "head", "left").select("cx", "cy", F.coalesce("component", "head").alias("c"))
    named = p.join(heads, ["cx", "cy"])
    least = named.groupBy("c").agg(F.min("id").alias("cluster"))
    return named.join(least, "c").select("id", "cluster")


def coverage(points: DataFrame, within_m: float = CLUSTER_M) -> DataFrame:
    """(cluster, pos, lng_e7, lat_e7): hull of each cluster."""
    return hulls.group_hulls(points.join(clusters(points, within_m), "id").select("cluster", "lng_e7", "lat_e7"), "cluster")


def within_coverage(points: DataFrame, rings: DataFrame, metres: float = COVER_M) -> DataFrame:
    """(id): points (id, lng_e7, lat_e7) in an area (area, ring) or at most so far from one."""
    at = F.struct("lng_e7", "lat_e7")
    return areas.meeting(points.select("id", at.alias("a"), at.alias("b")), rings, metres)


def place_of(p: DataFrame, *keep: str) -> DataFrame:
    """Places of provider features in the state: name, detail, category, and the columns to keep."""
    blank = lambda c: F.when(C(c) != "", C(c))
    address = F.when(blank("street").isNotNull(), F.concat_ws(" ", blank("housenumber"), "street"))
    suburb = F.coalesce("locality", "district", "city")
    own = F.when(C("named"), C("name"))
    name = F.coalesce(own, address, suburb)
    parts = F.concat_ws(", ", F.when(own.isNotNull(), address), F.when(suburb != name, suburb))
    detail = F.concat_ws(" ", F.when(parts != "", parts), "postcode")
    return p.where((C("state") == "Victoria") & name.isNotNull()).select(
        "place_id", name.alias("name"), F.when(detail != "", detail).alias("detail"), F.concat(F.coalesce("osm_key", F.lit("?")), F.lit("="), F.coalesce("osm_value", F.lit("?"))).alias("category"), "lng_e7", "lat_e7", *keep
    )


#: Results of a search; letters of a word's beginning by which places are found.
LIMIT, PREFIX = 6, 3


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def search_places(features: DataFrame, searches: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(query_id, rank, place_id, name, detail): the first places of searches (query_id, text, near_lng_e7, near_lat_e7).

    Every word of a search begins a word of the place's name or address. Of the matches in the region that aren't stops, the
    nearest to the search's own place (to four digits of a degree; without one, those of the smallest id) are fetched, twice as many as asked for;
    of these the ones in the state are kept, once each by name and detail.

    Places are posted under the beginnings of their words. A text, however often it is asked for, meets the postings of one
    word only, the one with the fewest, by an equi-join; its other words are looked for in the places found. Searches then
    take the nearest of their text's places (``_nearest_places``).
    """
    shown = features.where(tags.in_region(geo.degrees(C("lng_e7")), geo.degrees(C("lat_e7"))) & ~excluded_place(C("osm_key"), C("osm_value")))
    label = F.concat_ws(" ", F.when(C("named"), C("name")), "housenumber", "street", "locality", "district", "city", "postcode")
    shown = materialise(shown.withColumn("words", F.array_distinct(words(label))))
    beginnings = lambda w: F.array(*(F.substring(w, 1, i) for i in range(1, PREFIX + 1)))
    posted = shown.select("place_id", F.explode(F.array_distinct(F.flatten(F.transform("words", beginnings)))).alias("key"))
    near = [F.floor((C(f"near_{c}_e7") + 500) / 1000) * 1000 for c in ("lng", "lat")]
    asked = searches.select("query_id", near[0].alias("lng"), near[1].alias("lat"), F.array_sort(F.array_distinct(words(C("text")))).alias("terms")).where(F.size("terms") > 0)
    texts = materialise(asked.select("terms").distinct().withColumn("text_id", F.monotonically_increasing_id()))
    asked = materialise(asked.join(texts, "terms").drop("terms"))
    keys = texts.select("text_id", F.explode("terms").alias("term")).withColumn("key", F.substring("term", 1, PREFIX))
    # a word that no place has leaves its text without any
    rarest = keys.join(posted.groupBy("key").agg(F.count("*").alias("n")), "key", "left").groupBy("text_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "key")).alias("k")).select("text_id", "k.key")
    met = rarest.join(posted, "key").select("text_id", "place_id").join(texts, "text_id").join(shown.select("place_id", "words", "lng_e7", "lat_e7"), "place_id")
    hits = materialise(met.where(F.forall("terms", lambda t: F.exists("words", lambda w: F.startswith(w, t)))).select("text_id", "place_id", "lng_e7", "lat_e7"))
    somewhere = C("lng").isNotNull() & C("lat").isNotNull()
    least = hits.withColumn("fetched", F.row_number().over(W.partitionBy("text_id").orderBy("place_id"))).where(C("fetched") <= 2 * limit)
    first = asked.where(~somewhere).join(least, "text_id").select("query_id", "place_id", "fetched")
    first = first.unionByName(_nearest_places(asked.where(somewhere), hits, 2 * limit))
    return first_by_label(place_of(first.join(shown, "place_id"), "query_id", "fetched"), "query_id", [C("fetched")], limit).select("query_id", "rank", "place_id", "name", "detail")


#: Places of a text that a cell holds to begin with, if they lie evenly; cells' least and most width.
HELD, LEAST_E7, MOST_E7 = 6, 1_000, 100_000_000


def _nearest_places(asked: DataFrame, hits: DataFrame, keep: int) -> DataFrame:
    """(query_id, place_id, fetched): of the places (text_id, place_id, lng_e7, lat_e7) of each search's text, the nearest few to
    its own place (query_id, text_id, lng, lat), to the millimetre, ties to the smaller id.

    Places lie in cells, as wide as the text's places are sparse, and a search meets those of nine cells. Nothing outside them
    is nearer than a cell's width; a search that finds enough within it is done, any other goes on with cells twice as
    wide. Texts of few places, and searches far from the region, meet all their places.
    """
    size = [F.max(c) - F.min(c) + 1 for c in ("lng_e7", "lat_e7")]
    per = hits.groupBy("text_id").agg(F.count("*").alias("n"), F.sqrt(size[0].cast("double") * size[1] * HELD / F.count("*")).alias("side"))
    per = per.select("text_id", (C("n") <= 9 * HELD).alias("few"), F.greatest(F.lit(LEAST_E7), F.ceil("side")).cast("long").alias("side"))
    whole = C("few") | (C("side") >= MOST_E7)
    cell = lambda v: F.when(whole, 0).otherwise(F.floor(C(v) / C("side"))).cast("long")
    around = lambda v: F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(cell(v) - 1, cell(v) + 1))
    apart = F.round(geo.haversine(*(geo.degrees(C(c)) for c in ("lng", "lat", "lng_e7", "lat_e7"))), 3)
    # to the parallel, and to the meridian, a cell's width away
    width = geo.degrees(C("side"))
    out_m = F.least(width * geo.SPHERE_DEGREE_M, F.asin(F.cos(F.radians(geo.degrees(C("lat")))) * F.sin(F.radians(width))) * geo.RADIUS_M) * (1 - 1e-6) - 0.001
    pending, done = materialise(asked.join(per, "text_id")), None
    while not pending.isEmpty():
        sides = pending.select("text_id", "few", "side").distinct()
        grid = hits.join(sides, "text_id").select("text_id", "place_id", "lng_e7", "lat_e7", cell("lng_e7").alias("cx"), cell("lat_e7").alias("cy"))
        spread = pending.withColumn("cx", F.explode(around("lng"))).withColumn("cy", F.explode(around("lat"))).withColumn("out_m", out_m)
        near = spread.join(grid, ["text_id", "cx", "cy"]).select("query_id", "place_id", whole.alias("whole"), apart.alias("apart"), "out_m").where(C("whole") | (C("apart") < C("out_m")))
        ranked = near.withColumn("fetched", F.row_number().over(W.partitionBy("query_id").orderBy("apart", "place_id"))).where(C("fetched") <= keep)
        ranked = materialise(ranked.select("query_id", "place_id", "fetched", "whole"))
        full = ranked.where(C("whole") | (C("fetched") == keep)).select("query_id").distinct()
        some = ranked.join(full, "query_id", "left_semi").select("query_id", "place_id", "fetched")
        done = some if done is None else done.unionByName(some)
        old, pending = pending, materialise(pending.where(~whole).join(full, "query_id", "left_anti").withColumn("side", C("side") * 2))
        release(old)
    return done if done is not None else hits.select(F.lit(None).cast("long").alias("query_id"), "place_id", F.lit(0).alias("fetched")).limit(0)


def excluded_place(key: Column, value: Column) -> Column:
    """Stops and platforms."""
    return F.coalesce(F.concat(key, F.lit("="), value).isin(*V.EXCLUDED_PLACES) | (key == "public_transport"), F.lit(False))


def first_by_label(found: DataFrame, query: str, order: list[Column], limit: int) -> DataFrame:
    """The first place of each name and detail, and of these the first few of each query."""
    once = found.withColumn("_n", F.row_number().over(W.partitionBy(query, "name", "detail").orderBy(*order))).where("_n = 1")
    return once.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(*order))).where(C("rank") <= limit).drop("_n")


def request_status(lng: Column, lat: Column) -> Column:
    """Outside the region is refused; a swapped pair is said to be one."""
    return F.when(lng.isNull() | lat.isNull(), "INVALID_REQUEST").when(tags.in_region(lng, lat), "OK").when(tags.in_region(lat, lng), "SWAPPED").otherwise("OUTSIDE_REGION")


# Statuses of error codes.
HTTP_STATUS = {
    "VALIDATION_ERROR": 400, "INVALID_JSON": 400, "ZOOM_TOO_LOW": 400, "NOT_FOUND": 404, "START_NOT_NEAR_NETWORK": 422, "END_NOT_NEAR_NETWORK": 422,
    "NO_ROUTE": 422, "INTERNAL_ERROR": 500, "GEOCODER_UNAVAILABLE": 502, "NETWORK_LOADING": 503, "NETWORK_EMPTY": 503, "NETWORK_UNAVAILABLE": 503,
}


def http_status(code: Column) -> Column:
    return F.when(code == "OK", 200).otherwise(lookup(code, HTTP_STATUS)).cast("int")
