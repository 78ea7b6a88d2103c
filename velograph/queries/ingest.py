"""Scans, sinks and the joins of an import."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo, tags
from ..functions import vocab as V
from ..functions.exprs import half_up
from ..operators import hulls, polylines
from ..runtime import shared_folder
from ..sources import ingest, network, pbf, versions
from . import base
from .base import LENGTH, SEG, WAYS, query
from .domain import ROUTABLE, WAY_CATEGORY, classified
from .geometry import PIECES, RAW, VERTICES

C = F.col


def _batches(e):
    return e.groupBy(F.expr("event_id div 2000").alias("b")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.concat(F.lit('{"id":'), C("event_id").cast("string"), F.lit(',"props":'), "props", F.lit("}"))), ","), F.lit("]")).alias("json"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_recordset(spark, sf_dir):
    """Batches of JSON arrays of at most 2000 ids, parsed and expanded."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _batches(e).select(F.inline(F.from_json("json", "array<struct<id:long,props:struct<k:long>>>"))).select(C("id").alias("event_id"), C("props.k").alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(f"WITH {RAW} SELECT id, CAST(0 AS INTEGER) AS part, 2 AS points FROM raw UNION ALL SELECT id, 2, 2 FROM raw WHERE id % 3 = 0")
def explode_multiline(spark, sf_dir):
    """Parts of multi-lines; parts of one point go."""
    c = C("coordinates")
    parts = F.concat(F.array(F.slice(c, 1, 2), F.slice(c, 1, 1)), F.when(C("id") % 3 == 0, F.array(F.slice(c, 2, 2))).otherwise(F.array(F.slice(c, 3, 1))))
    p = network.paths(spark, sf_dir).select("id", parts.alias("parts"))
    return polylines.explode_parts(p).select("id", "part", F.size("coordinates").alias("points"))


@query(f"WITH {RAW} SELECT id, CASE WHEN id % 10 <> 3 THEN 'LineString' ELSE 'Point' END AS kind, id % 10 <> 3 AS valid FROM raw")
def scan_geojson(spark, sf_dir):
    p = network.paths(spark, sf_dir)
    point = lambda q: F.concat(F.lit("["), geo.degrees(q["lng_e7"]).cast("string"), F.lit(","), geo.degrees(q["lat_e7"]).cast("string"), F.lit("]"))
    line = F.concat(F.lit("["), F.array_join(F.transform("coordinates", point), ","), F.lit("]"))
    bad = C("id") % 10 == 3
    js = F.concat(F.lit('{"type":"Feature","properties":{"OsmID":"'), C("id").cast("string"), F.lit('"},"geometry":{"type":"'), F.when(bad, "Point").otherwise("LineString"), F.lit('","coordinates":'), F.when(bad, point(C("coordinates")[0])).otherwise(line), F.lit("}}"))
    f = ingest.parse_features(p.select(js.alias("json")))
    return f.select(F.element_at("properties", "OsmID").cast("long").alias("id"), "kind", "valid")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_content(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def md5_content(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5("text").alias("digest"))


@query(f"WITH {SEG} SELECT id, source, osm_id, category, name, raw_surface AS surface, direction FROM seg ORDER BY id")
def scan_segments(spark, sf_dir):
    return network.paths(spark, sf_dir).select("id", "source", "osm_id", "category", "name", "surface", "direction").orderBy("id")


@query(f"WITH {WAYS} SELECT way_id, highway, surface FROM way")
def scan_ways(spark, sf_dir):
    """Ways with a map of their tags; a missing tag is no entry."""
    names = ("highway", "surface", "access", "bicycle", "foot", "footway", "service", "oneway", "width", "smoothness")
    entries = F.filter(F.array(*(F.struct(F.lit(n).alias("k"), C(n).alias("v")) for n in names)), lambda e: e["v"].isNotNull())
    w = network.ways(spark, sf_dir).select("way_id", F.map_from_entries(entries).alias("tags"))
    return w.select("way_id", *(F.try_element_at("tags", F.lit(n)).alias(n) for n in ("highway", "surface")))


def _extract(spark, sf_dir) -> str:
    """A map extract of the nodes and ways, in the shared folder."""
    path = f"{shared_folder(spark)}/extract-{uuid.uuid4().hex}"
    pbf.write_pbf(network.nodes(spark, sf_dir).withColumn("tags", F.when(C("crossing").isNotNull(), F.create_map(F.lit("crossing"), "crossing"))), path, "node", entities=2000)
    pbf.write_pbf(network.referring_ways(spark, sf_dir), path, "way", entities=500)
    return path


NODES = "nd AS (" + base.cte(network.NODES) + ")"
_REFS = "CASE WHEN way_id % 10 = 9 THEN [s, s] ELSE [s, s + 1, s + 1, s + 100 + way_id % 3, way_id + 100000000] END"
PBF_WAYS = (
    f"WITH {WAYS}, {NODES}, st AS ({network.STARTS}), rl AS (SELECT way_id, {_REFS} AS r FROM st), rf AS (SELECT way_id, unnest(r) AS node, generate_subscripts(r, 1) AS pos FROM rl), "
    "pt AS (SELECT way_id, pos, lng_e7 AS q_lng, lat_e7 AS q_lat, lag(lng_e7) OVER w AS p_lng, lag(lat_e7) OVER w AS p_lat FROM rf JOIN nd ON nd.id = node WINDOW w AS (PARTITION BY way_id ORDER BY pos)), "
    f"ln AS (SELECT way_id, count(*) AS points, CAST(sum(q_lng) AS BIGINT) AS lng_sum, CAST(sum(q_lat) AS BIGINT) AS lat_sum, {base.half_up('sum(CASE WHEN p_lng IS NULL THEN 0 ELSE ' + base.haversine_e7('p', 'q') + ' END)', 3)} AS length_m "
    "FROM pt WHERE p_lng IS DISTINCT FROM q_lng OR p_lat IS DISTINCT FROM q_lat GROUP BY way_id HAVING count(*) >= 2) "
    f"SELECT way_id, highway, surface, oneway_bicycle, name, points, lng_sum, lat_sum, length_m FROM way JOIN ln USING (way_id) WHERE highway IN ({base.strings(V.CANDIDATES)}) AND area IS DISTINCT FROM 'yes'"
)


@query(PBF_WAYS)
def pbf_ways(spark, sf_dir):
    """Candidate ways of a binary map extract with their lines: written, read back in ranges smaller than a file, joined with their nodes."""
    path = _extract(spark, sf_dir)
    ways = pbf.read_pbf(spark, path, "way", having="highway", split=20_000)
    t = lambda k: F.try_element_at("tags", F.lit(k))
    lines = pbf.with_lines(ways.where(tags.candidate(t("highway"), t("area"))), pbf.read_pbf(spark, path, "node", split=20_000))
    total = lambda c: F.aggregate(F.transform("coordinates", lambda p: p[c]), F.lit(0).cast("long"), lambda a, x: a + x)
    return lines.select(
        C("id").alias("way_id"), t("highway").alias("highway"), t("surface").alias("surface"), t("oneway:bicycle").alias("oneway_bicycle"), t("name").alias("name"), F.size("coordinates").cast("long").alias("points"),
        total("lng_e7").alias("lng_sum"), total("lat_e7").alias("lat_sum"), half_up(F.element_at(geo.lengths(C("coordinates")), -1), 3).alias("length_m"),
    )


@query(f"WITH {NODES} SELECT id, lng_e7, lat_e7, crossing FROM nd")
def pbf_nodes(spark, sf_dir):
    """Nodes of the extract with their places and tags."""
    n = pbf.read_pbf(spark, _extract(spark, sf_dir), "node", split=20_000)
    return n.select("id", "lng_e7", "lat_e7", F.try_element_at("tags", F.lit("crossing")).alias("crossing"))


@query(f"WITH {RAW}, {VERTICES} SELECT id, CAST(pos AS INTEGER) AS pos, {base.deg('lng')} AS lng, {base.deg('lat')} AS lat FROM vtx")
def wkb_decode(spark, sf_dir):
    lines = ingest.wkb_lines(ingest.with_wkb(network.paths(spark, sf_dir)))
    return lines.select("id", F.posexplode("coordinates").alias("pos", "p")).select("id", "pos", "p.lng", "p.lat")


@query(f"WITH {RAW} SELECT source, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT source, id FROM raw WHERE source <> 'osm' UNION ALL SELECT 'osm', id + 1000000 FROM raw WHERE source = 'osm' AND id % 2 = 0) GROUP BY source")
def replace_by_source(spark, sf_dir):
    """The table after the community's paths were replaced by half of them under new ids: two imports, read through the manifest."""
    path, p = f"{shared_folder(spark)}/paths-{uuid.uuid4().hex}", network.paths(spark, sf_dir).select("source", "id")
    versions.replace(p, path, "first")
    new = p.where((C("source") == V.COMMUNITY) & (C("id") % 2 == 0)).withColumn("id", C("id") + 1_000_000)
    versions.replace(new, path, "second")
    return versions.read(spark, path).groupBy("source").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"WITH {RAW}, {WAYS} SELECT 'vic_dtp_bin' AS source, 'official' AS dataset, count(*) AS feature_count FROM raw WHERE source = 'vic_dtp_bin' UNION ALL SELECT 'osm', 'ways', count(*) FROM way")
def import_provenance(spark, sf_dir):
    dtp = ingest.provenance(network.paths(spark, sf_dir).where(C("source") == V.OFFICIAL), V.OFFICIAL, "official")
    return dtp.unionByName(ingest.provenance(network.ways(spark, sf_dir), V.COMMUNITY, "ways"))


@query(
    f"WITH {RAW}, {WAYS} SELECT CAST(1 AS BIGINT) AS import_id, 'osm' AS source, 'paths' AS dataset, count(*) AS feature_count, count(*) AS path_count FROM raw WHERE source = 'osm' UNION ALL "
    f"SELECT 2, 'vic_dtp_bin', 'paths', count(*), count(*) FROM raw WHERE source = 'vic_dtp_bin' UNION ALL SELECT 3, 'osm', 'ways', (SELECT count(*) FROM way), count(*) FROM way WHERE {ROUTABLE} AND {WAY_CATEGORY} IS NOT NULL"
)
def import_counts(spark, sf_dir):
    """Provenance that changes with the rows: candidates and accepted ways of an import that replaces the community's paths."""
    path, p = f"{shared_folder(spark)}/paths-{uuid.uuid4().hex}", network.paths(spark, sf_dir).select("source", "id")
    versions.replace(p, path, "paths")
    ways = network.ways(spark, sf_dir)
    accepted = classified(ways).select(F.lit(V.COMMUNITY).alias("source"), C("way_id").alias("id"))
    versions.replace(accepted, path, "ways", {V.COMMUNITY: ways.count()})
    return versions.imports(spark, path)


@query("SELECT import_id, name, feature_count FROM (SELECT o_orderkey AS import_id, o_orderstatus AS name, o_custkey AS feature_count FROM orders) ORDER BY import_id DESC LIMIT 1")
def latest_import(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(C("o_orderkey").alias("import_id"), C("o_orderstatus").alias("name"), C("o_custkey").alias("feature_count"))
    return o.orderBy(C("import_id").desc()).limit(1)


@query("SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_quantity * 2 - 20 <= 0 THEN 'width' WHEN l_linestatus NOT IN ('F') THEN 'vocabulary' ELSE 'import' END AS broken FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 2 WHERE l_quantity * 2 - 20 <= 0 OR l_linestatus NOT IN ('F') OR p_partkey IS NULL")
def constraint_violations(spark, sf_dir):
    """Rows that break a width check, a closed vocabulary or a foreign key; the first that is broken."""
    keys = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lit(True).alias("known"))
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((C("l_orderkey") * 10 + C("l_linenumber")).alias("id"), (C("l_quantity") * 2 - 20).alias("width"), "l_linestatus", (C("l_partkey") * 2).alias("p_partkey"))  # noqa: E741
    broken = F.when(C("width") <= 0, "width").when(~C("l_linestatus").isin("F"), "vocabulary").when(C("known").isNull(), "import")
    return l.join(keys, "p_partkey", "left").select("id", broken.alias("broken")).where("broken IS NOT NULL")


@query("SELECT name FROM (SELECT DISTINCT printf('%03d_%s.sql', CAST(p_size AS INTEGER), p_brand) AS name FROM part) WHERE name NOT IN (SELECT printf('%03d_%s.sql', CAST(p_size AS INTEGER), p_brand) FROM part WHERE p_partkey % 3 = 0) ORDER BY name")
def pending_migrations(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat(F.lpad(C("p_size").cast("string"), 3, "0"), F.lit("_"), "p_brand", F.lit(".sql"))
    return ingest.pending(p.select(name.alias("name")).distinct(), p.where("p_partkey % 3 = 0").select(name.alias("name")).distinct())


@query(f"WITH {SEG}, {WAYS} SELECT id, seg.osm_id, category, w.highway FROM seg JOIN way w ON w.way_id = seg.osm_id")
def join_inner(spark, sf_dir):
    w = network.ways(spark, sf_dir).select(C("way_id").alias("osm_id"), "highway")
    return network.paths(spark, sf_dir).select("id", "osm_id", "category").join(w, "osm_id").select("id", "osm_id", "category", "highway")


BOX = "box AS (SELECT s_suppkey AS area, 1449000000 + (s_suppkey * 7919) % 900000 AS x0, -385000000 + (s_suppkey * 104729) % 1300000 AS y0 FROM supplier)"


@query(f"WITH {RAW}, {BOX} SELECT id FROM raw WHERE EXISTS (SELECT 1 FROM box WHERE greatest(a_lng, m_lng, b_lng) >= x0 AND least(a_lng, m_lng, b_lng) <= x0 + 20000 AND greatest(a_lat, m_lat, b_lat) >= y0 AND least(a_lat, m_lat, b_lat) <= y0 + 20000)")
def semi_join_bbox(spark, sf_dir):
    """Segments whose box meets an area's box, by cells."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((1449000000 + (C("s_suppkey") * 7919) % 900000).alias("x0"), (-385000000 + (C("s_suppkey") * 104729) % 1300000).alias("y0"))
    corner = lambda dx: F.struct((C("x0") + dx).alias("lng_e7"), (C("y0") + dx).alias("lat_e7"))
    areas = polylines.gridded(s.withColumns({"a": corner(0), "b": corner(20_000)}), 20_000).select("cx", "cy", "x0", "y0")
    lng, lat = C("coordinates.lng_e7"), C("coordinates.lat_e7")
    low, high = F.struct(F.array_min(lng).alias("lng_e7"), F.array_min(lat).alias("lat_e7")), F.struct(F.array_max(lng).alias("lng_e7"), F.array_max(lat).alias("lat_e7"))
    boxes = polylines.gridded(network.paths(spark, sf_dir).select("id", low.alias("a"), high.alias("b")), 20_000)
    meets = (C("b.lng_e7") >= C("x0")) & (C("a.lng_e7") <= C("x0") + 20_000) & (C("b.lat_e7") >= C("y0")) & (C("a.lat_e7") <= C("y0") + 20_000)
    return boxes.join(areas, ["cx", "cy"]).where(meets).select("id").distinct()


UNCOVERED = (
    f"WITH {SEG}, {VERTICES}, {PIECES}, p AS (SELECT DISTINCT osm_id, CASE WHEN a_lng < b_lng OR a_lng = b_lng AND a_lat <= b_lat THEN row(a_lng, a_lat, b_lng, b_lat) ELSE row(b_lng, b_lat, a_lng, a_lat) END AS k FROM piece JOIN (SELECT id, osm_id FROM raw WHERE dir = 1) USING (id)), "
    f"q AS (SELECT osm_id, k[1] AS a_lng, k[2] AS a_lat, k[3] AS b_lng, k[4] AS b_lat FROM p), cov AS (SELECT osm_id, sum({base.haversine_e7('a', 'b')}) AS covered_m FROM q GROUP BY osm_id), "
    f"w AS (SELECT osm_id AS way_id, {base.half_up('sum(' + LENGTH + ')', 3)} AS length_m FROM raw WHERE dir < 2 GROUP BY osm_id) SELECT way_id, length_m FROM w WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.osm_id = way_id AND covered_m >= 0.56::DOUBLE * length_m)"
)


@query(UNCOVERED)
def anti_join_coverage(spark, sf_dir):
    """Ways of the east and north segments that official paths cover by less than 0.56 of their length."""
    p = network.paths(spark, sf_dir)
    cover = hulls.dissolved(polylines.pieces(p.where("dir = 1"), "osm_id"), "osm_id").withColumnRenamed("metres", "covered_m")
    w = p.where("dir < 2").groupBy(C("osm_id").alias("way_id")).agg(half_up(F.sum(F.element_at(geo.lengths(C("coordinates")), -1)), 3).alias("length_m"))
    return ingest.uncovered(w, cover, 0.56)


@query(f"WITH {RAW}, w AS (SELECT id AS way_id, {LENGTH} AS covered_m, ({LENGTH}) * (1 + (k % 7) * 0.03::DOUBLE) AS length_m FROM raw WHERE dir = 1) SELECT way_id, {base.half_up('length_m', 3)} AS length_m FROM w WHERE covered_m < 0.9::DOUBLE * length_m")
def anti_join_coverage_all(spark, sf_dir):
    """Each official path against the way that it follows and that goes on for up to 18 % beyond it, at a share of 0.9."""
    p = network.paths(spark, sf_dir).where("dir = 1")
    there_and_back = p.unionByName(p.withColumn("coordinates", F.reverse("coordinates")))
    cover = hulls.dissolved(polylines.pieces(there_and_back), "id").select(C("id").alias("osm_id"), C("metres").alias("covered_m"))
    w = p.select(C("id").alias("way_id"), (F.element_at(geo.lengths(C("coordinates")), -1) * (1 + (C("k") % 7) * F.lit(0.03))).alias("length_m"))
    return ingest.uncovered(w, cover).select("way_id", half_up(C("length_m"), 3).alias("length_m"))


@query(f"WITH {RAW}, {WAYS} SELECT id, source, CASE WHEN way_id IS NOT NULL AND source = 'vic_dtp_bin' THEN w.surface ELSE raw.surface END AS surface, CASE WHEN way_id IS NOT NULL AND source = 'vic_dtp_bin' THEN w.smoothness ELSE raw.smoothness END AS smoothness FROM raw LEFT JOIN way w ON way_id = osm_id")
def enrich_update(spark, sf_dir):
    return ingest.enriched(network.paths(spark, sf_dir), network.ways(spark, sf_dir)).select("id", "source", "surface", "smoothness")
