"""A path network, requests, ways and places derived from the relational test tables, which hold no geometry.

The SELECTs run in any engine: ``{div}`` stands for integer division, tables go by their own names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags
from ..functions import vocab as V

#: A 100 wide lattice: east (0), north (1) and stub (2) segments of three vertices; some north ones end a few metres short.
SEGMENTS = """
SELECT k * 3 + dir AS id, k, dir, x, y,
  CASE dir WHEN 2 THEN px + 5000 ELSE px END AS a_lng, CASE dir WHEN 2 THEN py + j ELSE py END AS a_lat,
  CASE dir WHEN 0 THEN px + 5000 WHEN 1 THEN px + j ELSE px + 5150 END AS m_lng, CASE dir WHEN 0 THEN py + j WHEN 1 THEN py + 5000 ELSE py + j + 1000 END AS m_lat,
  CASE dir WHEN 0 THEN px + 10000 WHEN 1 THEN px ELSE px + 5300 END AS b_lng, CASE dir WHEN 0 THEN py WHEN 1 THEN py + 10000 - CASE WHEN k % 50 = 7 THEN 600 ELSE 0 END ELSE py + j + 2000 END AS b_lat,
  CASE WHEN dir = 1 THEN 'vic_dtp_bin' ELSE 'osm' END AS source, k % 5000 AS osm_id, (k * 7 + dir * 3) % 16 AS kind_ix,
  CASE WHEN c % 97 = 0 THEN NULL ELSE concat('Path ', CAST(c % 97 AS VARCHAR(10))) END AS name,
  CASE (k * 13 + dir * 5) % 12 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'concrete' WHEN 2 THEN 'paved' WHEN 3 THEN 'asphalt;gravel' WHEN 4 THEN 'dirt/sand' WHEN 5 THEN 'compacted'
    WHEN 6 THEN 'gravel' WHEN 7 THEN 'wood' WHEN 8 THEN 'Asphalt' WHEN 9 THEN 'moon_dust' WHEN 10 THEN '' END AS surface,
  CASE (k * 11) % 9 WHEN 0 THEN 'excellent' WHEN 1 THEN 'good' WHEN 2 THEN ' Bad ' WHEN 3 THEN 'very_bad' WHEN 4 THEN 'intermediate' WHEN 5 THEN 'silly' END AS smoothness,
  CASE k % 7 WHEN 0 THEN 'parking' WHEN 1 THEN 'Tram Line, parking' WHEN 2 THEN 'traffic merging' WHEN 3 THEN '' WHEN 4 THEN 'Loose Dogs!,' END AS hazards,
  CASE c % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'forward' ELSE 'reverse' END AS direction, k % 13 = 0 AS sidewalk, dir = 1 AS bridge_gaps
FROM (SELECT o_orderkey AS k, o_custkey AS c, dir, o_orderkey % 100 AS x, o_orderkey {div} 100 AS y, 1449000000 + (o_orderkey % 100) * 10000 AS px,
    -385000000 + (o_orderkey {div} 100) * 10000 AS py, (o_custkey % 7 - 3) * 100 AS j FROM orders CROSS JOIN (SELECT 0 AS dir UNION ALL SELECT 1 UNION ALL SELECT 2) d) z
WHERE NOT (dir <> 1 AND x = 99) AND NOT (dir = 2 AND k % 11 <> 0)
"""
POINTS = "SELECT event_id AS id, 1449000000 + (event_id * 7919) % 1000000 AS lng_e7, -385000000 + (event_id * 104729) % 1500000 AS lat_e7 FROM events"
#: Routes over the lattice: dx segments east and then dy north.
REQUESTS = """
SELECT request_id, src, x0, y0, CASE WHEN dx > 99 - x0 THEN 99 - x0 ELSE dx END AS dx, CASE WHEN dy > (n {div} 100) - 1 - y0 THEN (n {div} 100) - 1 - y0 ELSE dy END AS dy,
  CASE request_id % 3 WHEN 0 THEN 'any' WHEN 1 THEN 'avoid_loose' ELSE 'smooth_only' END AS pref_surface, (request_id {div} 3) % 2 = 0 AS avoid_steps, (request_id {div} 6) % 2 = 0 AS avoid_busy
FROM (SELECT c_custkey AS request_id, (c_custkey * 37) % n AS src, ((c_custkey * 37) % n) % 100 AS x0, ((c_custkey * 37) % n) {div} 100 AS y0, c_custkey % 15 AS dx, c_custkey % 20 AS dy, n
  FROM customer CROSS JOIN (SELECT count(*) AS n FROM orders) o) r
"""
WAYS = """
SELECT p_partkey AS way_id,
  CASE p_partkey % 16 WHEN 0 THEN 'cycleway' WHEN 1 THEN 'footway' WHEN 2 THEN 'pedestrian' WHEN 3 THEN 'path' WHEN 4 THEN 'track' WHEN 5 THEN 'bridleway' WHEN 6 THEN 'steps' WHEN 7 THEN 'residential'
    WHEN 8 THEN 'living_street' WHEN 9 THEN 'service' WHEN 10 THEN 'unclassified' WHEN 11 THEN 'tertiary' WHEN 12 THEN 'secondary' WHEN 13 THEN 'primary_link' WHEN 14 THEN 'trunk' ELSE 'motorway' END AS highway,
  CASE (p_partkey {div} 16) % 15 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'concrete' WHEN 2 THEN 'paved' WHEN 3 THEN 'brick' WHEN 4 THEN 'wood' WHEN 5 THEN 'compacted' WHEN 6 THEN 'fine_gravel' WHEN 7 THEN 'gravel'
    WHEN 8 THEN 'dirt' WHEN 9 THEN 'grass' WHEN 10 THEN 'asphalt;gravel' WHEN 11 THEN 'dirt/sand' WHEN 12 THEN 'Asphalt' WHEN 13 THEN 'moon_dust' END AS surface,
  CASE p_size % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'no' END AS access, CASE p_size % 7 WHEN 0 THEN 'designated' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' END AS bicycle,
  CASE p_size % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS foot, CASE p_size % 11 WHEN 0 THEN 'sidewalk' END AS footway, CASE p_size % 6 WHEN 0 THEN 'driveway' WHEN 1 THEN 'alley' END AS service,
  CASE p_size % 4 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' END AS oneway, CASE p_size % 10 WHEN 3 THEN 'no' WHEN 5 THEN 'yes' END AS oneway_bicycle,
  CASE p_size % 8 WHEN 0 THEN '3 m' WHEN 1 THEN '2.5' WHEN 2 THEN 'narrow' WHEN 3 THEN '250' WHEN 4 THEN '1.5 metres' END AS width,
  CASE p_size % 9 WHEN 0 THEN 'excellent' WHEN 1 THEN ' Very_Bad ' WHEN 2 THEN 'smooth' END AS smoothness, CASE WHEN p_size % 13 = 0 THEN 'yes' END AS area, CASE WHEN p_size % 17 = 0 THEN 'yes' END AS indoor, p_name AS name
FROM part
"""
#: Nodes of a map extract (the lattice's crossings), and where each way of the extract begins among them.
NODES = """
SELECT o_orderkey AS id, 1449000000 + (o_orderkey % 100) * 10000 AS lng_e7, -385000000 + (o_orderkey {div} 100) * 10000 + (o_custkey % 7 - 3) * 100 AS lat_e7, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS crossing FROM orders
"""
STARTS = "SELECT p_partkey AS way_id, (p_partkey * 37) % n AS s FROM part CROSS JOIN (SELECT count(*) AS n FROM orders) o"
#: Eight points each of many small areas, some of them near each other, some over the lattice.
AREA_POINTS = """
SELECT c_custkey {div} 8 AS area, 1445000000 + ((c_custkey {div} 8) * 2654435) % 9000000 + (c_custkey * 7919) % 90000 AS lng_e7,
  -390000000 + ((c_custkey {div} 8) * 9973391) % 12000000 + (c_custkey * 104729) % 80000 AS lat_e7 FROM customer
"""
#: Four short lines around each crossing that end a few metres from it: gaps that touch each other.
SPOKES = """
SELECT k * 4 + s AS id, k, s, px + dx * o AS a_lng, py + dy * o AS a_lat, px + dx * 4000 AS b_lng, py + dy * 4000 AS b_lat
FROM (SELECT o_orderkey AS k, s, 1449000000 + (o_orderkey % 100) * 10000 AS px, -385000000 + (o_orderkey {div} 100) * 10000 AS py, ((o_orderkey * 7 + s * 13 + o_custkey) % 60) * 10 + 50 AS o,
  CASE s WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS dx, CASE s WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS dy
  FROM orders CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) d) z
"""
#: Official features as they come: labels to clean, counts in strings.
FEATURES = """
SELECT l_orderkey * 10 + l_linenumber AS feature_id, CAST(l_partkey AS VARCHAR(20)) AS osm_id,
  CASE l_suppkey % 10 WHEN 0 THEN 'Shared use path (off-road)' WHEN 1 THEN ' Separated path (off-road) ' WHEN 2 THEN 'Protected bike lane (on-road)' WHEN 3 THEN 'Buffered painted lane' WHEN 4 THEN 'Basic painted lane'
    WHEN 5 THEN 'Shared bike/parking lane' WHEN 6 THEN 'Shared street (sharrows)' WHEN 7 THEN 'Intermittent/informal (on-road)' WHEN 8 THEN 'Mystery lane' ELSE 'Hover lane' END AS infra_type,
  CASE l_partkey % 6 WHEN 0 THEN ' Creek Trail ' WHEN 1 THEN 'NULL' WHEN 2 THEN '' WHEN 3 THEN ' null' WHEN 4 THEN concat('Street ', CAST(l_partkey % 50 AS VARCHAR(10))) END AS name,
  CASE l_linenumber % 4 WHEN 0 THEN 'Residential' WHEN 1 THEN 'CYCLEWAY' WHEN 2 THEN ' ' END AS hwy_type, CAST(l_quantity AS DOUBLE) - 5 AS width,
  CASE l_suppkey % 5 WHEN 0 THEN 'Parking' WHEN 1 THEN 'Tram Line,Traffic Merging' WHEN 2 THEN 'Wet leaves / moss,, parking' WHEN 3 THEN '' END AS hazards,
  CASE l_partkey % 5 WHEN 0 THEN 'both' WHEN 1 THEN 'forward' WHEN 2 THEN 'reverse' WHEN 3 THEN 'Both' END AS direction
FROM lineitem
"""
PLACES = """
SELECT s_suppkey AS place_id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat('Street ', CAST(s_suppkey % 9 AS VARCHAR(10))) END AS street, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS VARCHAR(10)) END AS housenumber,
  CASE WHEN s_suppkey % 5 = 0 THEN concat('Suburb ', CAST(s_nationkey AS VARCHAR(10))) END AS locality, CASE WHEN s_suppkey % 2 = 0 THEN concat('District ', CAST(s_nationkey AS VARCHAR(10))) END AS district, n_name AS city,
  CASE WHEN s_suppkey % 6 = 1 THEN NULL ELSE CAST(3000 + s_nationkey AS VARCHAR(10)) END AS postcode, CASE WHEN s_suppkey % 10 = 9 THEN 'Tasmania' ELSE 'Victoria' END AS state,
  CASE s_suppkey % 7 WHEN 0 THEN 'highway' WHEN 1 THEN 'shop' WHEN 2 THEN 'railway' WHEN 3 THEN 'public_transport' ELSE 'amenity' END AS osm_key, CASE s_suppkey % 7 WHEN 0 THEN 'bus_stop' WHEN 2 THEN 'tram_stop' ELSE 'cafe' END AS osm_value,
  s_suppkey % 8 <> 5 AS named, 1449000000 + (s_suppkey * 7919) % 1000000 AS lng_e7, -385000000 + (s_suppkey * 104729) % 1500000 AS lat_e7
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

#: Place searches as they are typed, two thirds of them from somewhere; and places, a few of them outside the region.
SEARCHES = """
SELECT c_custkey AS query_id, CASE c_custkey % 5 WHEN 0 THEN substr(n_name, 1, 3) WHEN 1 THEN concat('street ', CAST(c_custkey % 9 AS VARCHAR(10))) WHEN 2 THEN concat('dis ', n_name) WHEN 3 THEN concat('  Suburb, ', CAST(c_nationkey AS VARCHAR(10)))
    ELSE concat(substr(n_name, 1, 2), ' 30') END AS text, CASE WHEN c_custkey % 3 > 0 THEN 1449000000 + (c_custkey * 7919) % 1000000 END AS near_lng_e7, CASE WHEN c_custkey % 3 > 0 THEN -385000000 + (c_custkey * 104729) % 1500000 END AS near_lat_e7
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""


def _table(spark: SparkSession, path: str) -> DataFrame:
    """A table in as many partitions as there are cores: a small file would be one task's, and what is derived from a row is much more."""
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _select(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run a portable SELECT; its tables are bound for this call only."""
    text = sql.replace("{div}", "DIV").replace("{", "{{").replace("}", "}}")
    for t in tables:
        for before in ("FROM ", "JOIN "):
            text = text.replace(f"{before}{t}", f"{before}{{{t}}}")
    return spark.sql(text, **{t: _table(spark, f"{sf_dir}/{t}.parquet") for t in tables})


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored path rows: raw attributes and coordinates."""
    ends = [F.struct(F.col(f"{p}_lng").cast("long").alias("lng_e7"), F.col(f"{p}_lat").cast("long").alias("lat_e7")) for p in "amb"]
    raw = _select(spark, sf_dir, SEGMENTS, "orders")
    category = F.element_at(F.array(*map(F.lit, V.CATEGORIES)), (F.col("kind_ix") + 1).cast("int"))
    return raw.withColumn("coordinates", F.array(*ends)).withColumn("category", category).drop(*(f"{p}_{c}" for p in "amb" for c in ("lng", "lat")), "kind_ix")


def segments(stored: DataFrame) -> DataFrame:
    """Graph input: effective surface, known smoothness, parsed hazards."""
    cls, inferred = tags.effective_surface(F.col("category"), F.col("surface"), F.col("sidewalk"))
    category = F.when(F.col("category").isin(*V.CATEGORIES), F.col("category")).otherwise("unknown")
    return stored.select(
        "id", "coordinates", category.alias("category"), "name", tags.hazards(F.col("hazards")).alias("hazards"), cls.alias("surface_class"), inferred.alias("surface_inferred"),
        tags.smoothness(F.col("smoothness")).alias("smoothness"), "direction", (F.col("source") == V.OFFICIAL).alias("bridge_gaps"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, POINTS, "events")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, REQUESTS, "customer", "orders")


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, WAYS, "part")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, NODES, "orders")


def referring_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways with their tags as a map and the nodes they name: one twice, one that may be missing and one that is; some name one place only."""
    names = {"oneway:bicycle": "oneway_bicycle"} | {n: n for n in ("highway", "surface", "access", "bicycle", "foot", "footway", "service", "oneway", "width", "smoothness", "area", "indoor", "name")}
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in names.items())), lambda e: e["v"].isNotNull())
    starts, s, i = _select(spark, sf_dir, STARTS, "part", "orders"), F.col("s"), F.col("way_id")
    refs = F.when(i % 10 == 9, F.array(s, s)).otherwise(F.array(s, s + 1, s + 1, s + 100 + i % 3, i + 100_000_000))
    return ways(spark, sf_dir).join(starts, "way_id").select(i.alias("id"), F.map_from_entries(entries).alias("tags"), refs.alias("refs"))


def area_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, AREA_POINTS, "customer")


def spokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [F.struct(F.col(f"{p}_lng").cast("long").alias("lng_e7"), F.col(f"{p}_lat").cast("long").alias("lat_e7")) for p in "ab"]
    return _select(spark, sf_dir, SPOKES, "orders").select("id", F.array(*ends).alias("coordinates"), F.lit(True).alias("bridge_gaps"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, FEATURES, "lineitem")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, PLACES, "supplier", "nation")


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, SEARCHES, "customer", "nation")


def lattice_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, seq, id): the lattice segments of every request in travel order."""
    r = requests(spark, sf_dir)
    east = F.transform(F.sequence(F.lit(0), F.col("dx").cast("int") - 1), lambda i: (F.col("src") + i) * 3)
    north = F.transform(F.sequence(F.lit(0), F.col("dy").cast("int") - 1), lambda i: (F.col("src") + F.col("dx") + i * 100) * 3 + 1)
    none = F.array().cast("array<long>")
    parts = F.concat(F.when(F.col("dx") > 0, east).otherwise(none), F.when(F.col("dy") > 0, north).otherwise(none))
    return r.select("request_id", F.posexplode(parts).alias("seq", "id"))
