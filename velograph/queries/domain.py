"""Attribute rules over features, ways and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags
from ..functions import vocab as V
from ..functions.geo import degrees
from ..sources import network
from . import base
from .base import FEATURES, POINTS, SEG, WAYS, case, query, sealed, strings

C = F.col
CLEAN = "CASE WHEN lower(trim({0})) NOT IN ('', 'null') THEN trim({0}) END"


@query(f"WITH {FEATURES} SELECT feature_id, {CLEAN.format('name')} AS name FROM feat")
def clean_nulls(spark, sf_dir):
    return network.features(spark, sf_dir).select("feature_id", tags.clean(C("name")).alias("name"))


@query(f"WITH {FEATURES} SELECT direction AS raw, CASE WHEN direction IN ('both', 'forward', 'reverse') THEN direction ELSE 'both' END AS direction, count(*) AS n FROM feat GROUP BY ALL")
def dtp_direction(spark, sf_dir):
    return network.features(spark, sf_dir).groupBy(C("direction").alias("raw"), tags.direction(C("direction")).alias("direction_")).agg(F.count("*").alias("n")).withColumnRenamed("direction_", "direction")


@query(f"WITH {FEATURES} SELECT infra_type, {case('trim(infra_type)', V.INFRA_LABELS, chr(39) + 'unknown' + chr(39))} AS category, count(*) AS n FROM feat GROUP BY ALL")
def categorise_infra(spark, sf_dir):
    return network.features(spark, sf_dir).groupBy("infra_type", tags.infra_category(C("infra_type")).alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {FEATURES} SELECT feature_id, array_to_string({base.hazards('hazards')}, ',') AS hazards FROM feat")
def parse_hazards(spark, sf_dir):
    return network.features(spark, sf_dir).select("feature_id", F.array_join(tags.hazards(C("hazards")), ",").alias("hazards"))


@query(
    f"WITH {FEATURES} SELECT feature_id, osm_id, {case('trim(infra_type)', V.INFRA_LABELS, chr(39) + 'unknown' + chr(39))} AS category, {CLEAN.format('name')} AS name, "
    f"lower({CLEAN.format('hwy_type')}) AS highway, CASE WHEN width > 0 THEN width END AS width_m, array_to_string({base.hazards(CLEAN.format('hazards'))}, ',') AS hazards, "
    "CASE WHEN direction IN ('both', 'forward', 'reverse') THEN direction ELSE 'both' END AS direction FROM feat"
)
def project_record(spark, sf_dir):
    return network.features(spark, sf_dir).select(
        "feature_id", "osm_id", tags.infra_category(C("infra_type")).alias("category"), tags.clean(C("name")).alias("name"), F.lower(tags.clean(C("hwy_type"))).alias("highway"),
        F.when(C("width") > 0, C("width")).alias("width_m"), F.array_join(tags.hazards(tags.clean(C("hazards"))), ",").alias("hazards"), tags.direction(C("direction")).alias("direction"),
    )


@query(f"WITH {FEATURES} SELECT DISTINCT trim(infra_type) AS infra_type FROM feat WHERE trim(infra_type) NOT IN ({strings(V.INFRA_LABELS)})")
def unknown_types(spark, sf_dir):
    return network.features(spark, sf_dir).where(tags.infra_category(C("infra_type")) == "unknown").select(F.trim("infra_type").alias("infra_type")).distinct()


ACCESS = (
    f"(NOT (coalesce(foot IN ({strings(V.DENIED)}), false) AND coalesce(bicycle IN ({strings(V.DENIED)}), false)) AND CASE WHEN access IN ({strings(V.DENIED)}) "
    f"THEN coalesce(foot IN ({strings(V.ALLOWED)}), false) OR coalesce(bicycle IN ({strings(V.ALLOWED)}), false) ELSE true END)"
)
WAY_CATEGORY = (
    "CASE WHEN highway = 'cycleway' THEN 'shared_use_path' WHEN highway IN ('footway', 'pedestrian') THEN CASE WHEN bicycle = 'designated' AND footway IS DISTINCT FROM 'sidewalk' THEN 'shared_use_path' ELSE 'footpath' END "
    "WHEN highway = 'path' THEN CASE WHEN bicycle = 'designated' THEN 'shared_use_path' WHEN surface IN ('asphalt', 'concrete', 'paved') THEN 'footpath' ELSE 'trail' END "
    f"WHEN highway IN ('track', 'bridleway') THEN 'track' WHEN highway = 'steps' THEN 'steps' WHEN highway IN ({strings(V.QUIET_STREETS)}) THEN 'quiet_street' "
    f"WHEN highway IN ({strings(V.ROADS)}) THEN 'road' WHEN highway IN ({strings(V.BUSY_ROADS)}) THEN 'busy_road' END"
)
WIDTH = "CASE WHEN TRY_CAST(nullif(regexp_extract(width, '^\\s*(\\d+(?:\\.\\d+)?)\\s*(m|metres?|meters?)?\\s*$', 1, 'i'), '') AS DOUBLE) BETWEEN 0.000001 AND 99.999999 THEN CAST(regexp_extract(width, '^\\s*(\\d+(?:\\.\\d+)?)\\s*(m|metres?|meters?)?\\s*$', 1, 'i') AS DOUBLE) END"
ONEWAY = "CASE WHEN oneway_bicycle = 'no' THEN 'both' WHEN coalesce(oneway_bicycle, oneway) IN ('yes', '1', 'true') THEN 'forward' WHEN coalesce(oneway_bicycle, oneway) IN ('-1', 'reverse') THEN 'reverse' ELSE 'both' END"
ROUTABLE = f"{ACCESS} AND NOT (highway = 'service' AND coalesce(service IN ({strings(V.EXCLUDED_SERVICE)}), false)) AND indoor IS DISTINCT FROM 'yes'"


@query(f"WITH {WAYS} SELECT way_id, {ACCESS} AS accessible FROM way")
def osm_access(spark, sf_dir):
    return network.ways(spark, sf_dir).select("way_id", tags.accessible(C("access"), C("foot"), C("bicycle")).alias("accessible"))


@query(f"WITH {WAYS} SELECT way_id, {WIDTH} AS width_m FROM way")
def parse_width(spark, sf_dir):
    return network.ways(spark, sf_dir).select("way_id", tags.width(C("width")).alias("width_m"))


@query(f"WITH {WAYS} SELECT way_id, {ONEWAY} AS direction FROM way")
def osm_direction(spark, sf_dir):
    return network.ways(spark, sf_dir).select("way_id", tags.bicycle_direction(C("oneway"), C("oneway_bicycle")).alias("direction"))


@query(f"WITH {WAYS} SELECT way_id, {WAY_CATEGORY} AS category FROM way")
def osm_category(spark, sf_dir):
    return network.ways(spark, sf_dir).select("way_id", tags.way_category(C("highway"), C("bicycle"), C("footway"), C("surface")).alias("category"))


@query(f"WITH {WAYS} SELECT way_id, highway FROM way WHERE highway IN ({strings(V.CANDIDATES)}) AND area IS DISTINCT FROM 'yes'")
def candidate_highways(spark, sf_dir):
    return network.ways(spark, sf_dir).where(tags.candidate(C("highway"), C("area"))).select("way_id", "highway")


def classified(ways):
    """Ways that enter the network, with their derived attributes."""
    category = tags.way_category(C("highway"), C("bicycle"), C("footway"), C("surface"))
    ok = tags.routable(*map(C, ("highway", "access", "foot", "bicycle", "service", "indoor")))
    return ways.where(ok & category.isNotNull()).select(
        "way_id", category.alias("category"), F.when(F.trim("name") != "", F.trim("name")).alias("name"), F.when(F.trim("surface") != "", F.trim("surface")).alias("surface"),
        F.when(F.trim("smoothness") != "", F.trim("smoothness")).alias("smoothness"), tags.width(C("width")).alias("width_m"), tags.bicycle_direction(C("oneway"), C("oneway_bicycle")).alias("direction"),
        F.coalesce(C("footway") == "sidewalk", F.lit(False)).alias("sealed_by_default"),
    )


@query(
    f"WITH {WAYS} SELECT way_id, {WAY_CATEGORY} AS category, nullif(trim(name), '') AS name, nullif(trim(surface), '') AS surface, nullif(trim(smoothness), '') AS smoothness, {WIDTH} AS width_m, {ONEWAY} AS direction, "
    f"coalesce(footway = 'sidewalk', false) AS sealed_by_default FROM way WHERE {ROUTABLE} AND {WAY_CATEGORY} IS NOT NULL"
)
def classify_way(spark, sf_dir):
    return classified(network.ways(spark, sf_dir))


@query(f"WITH {WAYS} SELECT highway, count(*) AS n FROM way WHERE NOT ({ROUTABLE} AND {WAY_CATEGORY} IS NOT NULL) GROUP BY highway ORDER BY n DESC, highway")
def skipped_counts(spark, sf_dir):
    w = network.ways(spark, sf_dir)
    return w.join(classified(w), "way_id", "left_anti").groupBy("highway").agg(F.count("*").alias("n")).orderBy(C("n").desc(), "highway")


@query(f"WITH {WAYS} SELECT surface, {base.surface_class('surface')} AS surface_class, count(*) AS n FROM way GROUP BY ALL")
def classify_surface(spark, sf_dir):
    return network.ways(spark, sf_dir).groupBy("surface", tags.surface_class(C("surface")).alias("surface_class")).agg(F.count("*").alias("n"))


@query(f"WITH {SEG} SELECT id, surface_class, surface_inferred FROM net")
def effective_surface(spark, sf_dir):
    cls, inferred = tags.effective_surface(C("category"), C("surface"), C("sidewalk"))
    return network.paths(spark, sf_dir).select("id", cls.alias("surface_class"), inferred.alias("surface_inferred"))


TILE_CLASS = f"CASE WHEN raw_surface IS NULL THEN CASE WHEN {sealed('category', 'sidewalk')} THEN 'paved' ELSE 'unknown' END ELSE {case('lower(raw_surface)', base.RAW, chr(39) + 'unknown' + chr(39))} END"


@query(f"WITH {SEG} SELECT id, {TILE_CLASS} AS surface_class, raw_surface IS NULL AND {sealed('category', 'sidewalk')} AS surface_inferred FROM seg")
def tile_surface_case(spark, sf_dir):
    cls, inferred = tags.tile_surface(C("category"), C("surface"), C("sidewalk"))
    return network.paths(spark, sf_dir).select("id", cls.alias("surface_class"), inferred.alias("surface_inferred"))


@query(f"WITH {WAYS} SELECT way_id, CASE WHEN lower(trim(smoothness)) IN ({strings(V.SMOOTHNESS)}) THEN lower(trim(smoothness)) END AS smoothness FROM way")
def parse_smoothness(spark, sf_dir):
    return network.ways(spark, sf_dir).select("way_id", tags.smoothness(C("smoothness")).alias("smoothness"))


@query(f"WITH {POINTS} SELECT id, {base.deg('lng_e7')} BETWEEN 140.9::DOUBLE AND 150.1::DOUBLE AND {base.deg('lat_e7 * (1 + id % 3)')} BETWEEN -39.3::DOUBLE AND -33.9::DOUBLE AS inside FROM pts")
def in_region(spark, sf_dir):
    p = network.points(spark, sf_dir)
    return p.select("id", tags.in_region(degrees(C("lng_e7")), degrees(C("lat_e7") * (1 + C("id") % 3))).alias("inside"))


@query(f"WITH {SEG} SELECT id, category, name, array_to_string(hazards, ',') AS hazards, surface_class, surface_inferred, smoothness, direction, source = 'vic_dtp_bin' AS bridge_gaps FROM net")
def load_segments(spark, sf_dir):
    return network.segments(network.paths(spark, sf_dir)).withColumn("hazards", F.array_join("hazards", ",")).drop("coordinates")
