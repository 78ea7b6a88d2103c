"""Costs, preferences, and what routes are made of."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import vocab as V
from ..functions.exprs import half_up, sum_in_order
from ..operators import cost, graph, planning
from ..sources import network
from . import base
from .base import LENGTH, REQUESTS, ROUTES, SEG, VERTICES, case, query, strings
from .geometry import PIECES, RAW
from .graph import EDGES, nearest_sql

C = F.col
PROFILES = (V.PREFER_PATHS, V.SHORTEST)
COMBINATIONS = [(p, s, a, b) for p in PROFILES for s in V.SURFACE_PENALTIES for a in (False, True) for b in (False, True)]


def _priced(tables: dict) -> str:
    h = f"list_reduce(list_prepend(1::DOUBLE, list_transform(hazards, lambda h: {case('h', tables['hazard'], '1::DOUBLE')})), lambda a, b: a * b)" if tables["hazard"] else "1::DOUBLE"
    return f"({LENGTH}) * {case('category', tables['kind'])} * {h} * {case('surface_class', tables['surface'])}"


def _segments(spark, sf_dir):
    return network.segments(network.paths(spark, sf_dir)).withColumn("length_m", F.element_at(geo.lengths(C("coordinates")), -1))


@query(f"WITH {SEG} SELECT id, {base.half_up(_priced(cost.effective(V.PREFER_PATHS)), 3)} AS prefer_paths, {base.half_up(_priced(cost.effective(V.SHORTEST)), 3)} AS shortest, {base.half_up(_priced(cost.effective(V.PREFER_PATHS, 'smooth_only', True, True)), 3)} AS smooth_quiet FROM net")
def edge_cost(spark, sf_dir):
    s = _segments(spark, sf_dir)
    of = lambda *a: half_up(cost.edge_cost(C("length_m"), C("category"), C("hazards"), C("surface_class"), cost.effective(*a)), 3)
    return s.select("id", of(V.PREFER_PATHS).alias("prefer_paths"), of(V.SHORTEST).alias("shortest"), of(V.PREFER_PATHS, "smooth_only", True, True).alias("smooth_quiet"))


#: Fixed values of the checking statements, written out here and not taken from the code that they check.
HAND = """
kind_cost AS (SELECT * FROM (VALUES ('shared_use_path', 1.0::DOUBLE), ('separated_path', 1.0), ('protected_lane', 1.2), ('buffered_lane', 1.5), ('painted_lane', 1.8), ('shared_parking_lane', 2.0), ('shared_street', 2.0), ('informal', 2.5),
  ('footpath', 1.5), ('trail', 1.3), ('track', 1.8), ('steps', 6.0), ('quiet_street', 1.6), ('road', 2.5), ('busy_road', 4.0), ('unknown', 2.0), ('connector', 3.0)) t(name, multiplier)),
surface_cost AS (SELECT * FROM (VALUES ('smooth', 1.0::DOUBLE), ('paved', 1.05), ('rough_paved', 1.2), ('compacted', 1.3), ('gravel', 1.7), ('unpaved', 2.0), ('unknown', 1.1)) t(name, multiplier)),
hazard_cost AS (SELECT * FROM (VALUES ('parking', 1.1::DOUBLE), ('traffic_merging', 1.3), ('tram_line', 1.5)) t(name, multiplier)),
surface_penalty AS (SELECT * FROM (VALUES ('avoid_loose', 'compacted', 3.0::DOUBLE), ('avoid_loose', 'gravel', 10.0), ('avoid_loose', 'unpaved', 10.0), ('avoid_loose', 'unknown', 1.5),
  ('smooth_only', 'paved', 1.2), ('smooth_only', 'rough_paved', 4.0), ('smooth_only', 'compacted', 10.0), ('smooth_only', 'gravel', 15.0), ('smooth_only', 'unpaved', 15.0), ('smooth_only', 'unknown', 2.0)) t(surface, name, factor)),
base_cost AS (SELECT 'prefer_paths' AS profile, 'kind' AS what, * FROM kind_cost UNION ALL SELECT 'prefer_paths', 'surface', * FROM surface_cost UNION ALL SELECT 'prefer_paths', 'hazard', * FROM hazard_cost
  UNION ALL SELECT 'shortest', 'kind', name, 1.0 FROM kind_cost UNION ALL SELECT 'shortest', 'surface', name, 1.0 FROM surface_cost)
"""


def _catalogue(spark):
    """(profile, what, name, multiplier): fixed and small."""
    return spark.createDataFrame([(p, what, k, v) for p in PROFILES for what, table in cost.effective(p).items() for k, v in table.items()], "profile string, what string, name string, multiplier double")


@query(
    f"WITH {SEG}, {HAND}, l AS (SELECT category, surface_class, hazards, {LENGTH} AS m FROM net), met AS (SELECT 'kind' AS what, category AS name, m FROM l UNION ALL SELECT 'surface', surface_class, m FROM l UNION ALL SELECT 'hazard', unnest(hazards), m FROM l) "
    f"SELECT profile, b.what, b.name, multiplier, count(m) AS segments, {base.half_up('coalesce(sum(m), 0)', 2)} AS metres FROM base_cost b LEFT JOIN met ON met.what = b.what AND met.name = b.name GROUP BY ALL"
)
def profiles_table(spark, sf_dir):
    """Each profile's multipliers, with the segments and metres of the network that each applies to."""
    s = _segments(spark, sf_dir).select(C("length_m").alias("m"), "category", "surface_class", "hazards")
    each = F.concat(F.array(F.struct(F.lit("kind").alias("what"), C("category").alias("name")), F.struct(F.lit("surface").alias("what"), C("surface_class").alias("name"))), F.transform("hazards", lambda h: F.struct(F.lit("hazard").alias("what"), h.alias("name"))))
    met = s.select("m", F.explode(each).alias("e")).groupBy("e.what", "e.name").agg(F.count("*").alias("segments"), F.sum("m").alias("metres"))
    return _catalogue(spark).join(met, ["what", "name"], "left").select("profile", "what", "name", "multiplier", F.coalesce("segments", F.lit(0)).alias("segments"), half_up(F.coalesce("metres", F.lit(0.0)), 2).alias("metres"))


EFFECTIVE = (
    "want AS (SELECT pref_surface, avoid_steps, avoid_busy, count(*) AS requests FROM req GROUP BY ALL), eff AS (SELECT profile, pref_surface, avoid_steps, avoid_busy, requests, what, b.name, multiplier * "
    "CASE WHEN what = 'kind' AND avoid_steps AND b.name = 'steps' THEN 20 ELSE 1 END * CASE WHEN what = 'kind' AND avoid_busy AND b.name = 'busy_road' THEN 3 WHEN what = 'kind' AND avoid_busy AND b.name = 'road' THEN 1.5::DOUBLE ELSE 1 END * "
    "CASE WHEN what = 'surface' THEN coalesce(factor, 1) ELSE 1 END AS multiplier FROM base_cost b CROSS JOIN want LEFT JOIN surface_penalty p ON p.surface = pref_surface AND p.name = b.name)"
)


def _wanted(spark, sf_dir):
    """(pref_surface, avoid_steps, avoid_busy, requests): the preferences that requests ask for, at most twelve."""
    return network.requests(spark, sf_dir).groupBy("pref_surface", "avoid_steps", "avoid_busy").agg(F.count("*").alias("requests"))


@query(f"WITH {REQUESTS}, {HAND}, {EFFECTIVE} SELECT profile, pref_surface, avoid_steps, avoid_busy, requests, what, name, {base.half_up('multiplier', 6)} AS multiplier FROM eff")
def effective_multipliers(spark, sf_dir):
    """Multipliers under the preferences that requests ask for."""
    t = [(p, s, a, b, what, k, v) for p, s, a, b in COMBINATIONS for what, table in cost.effective(p, s, a, b).items() for k, v in table.items()]
    d = spark.createDataFrame(t, "profile string, pref_surface string, avoid_steps boolean, avoid_busy boolean, what string, name string, multiplier double")
    return _wanted(spark, sf_dir).join(F.broadcast(d), ["pref_surface", "avoid_steps", "avoid_busy"]).select("profile", "pref_surface", "avoid_steps", "avoid_busy", "requests", "what", "name", half_up(C("multiplier"), 6).alias("multiplier"))


@query(
    f"WITH {REQUESTS}, {SEG}, {HAND}, {EFFECTIVE}, shape AS (SELECT DISTINCT category, surface_class, hazards FROM net), k AS (SELECT * FROM eff WHERE what = 'kind'), s AS (SELECT * FROM eff WHERE what = 'surface'), "
    "risk AS (SELECT hazards, exp(sum(ln(coalesce(multiplier, 1)))) AS m FROM (SELECT hazards, unnest(CASE WHEN len(hazards) = 0 THEN ['none'] ELSE hazards END) AS h FROM (SELECT DISTINCT hazards FROM shape)) LEFT JOIN hazard_cost ON name = h GROUP BY hazards), "
    "bound AS (SELECT profile, pref_surface, avoid_steps, avoid_busy, min(k.multiplier) AS km FROM k GROUP BY ALL), sb AS (SELECT profile, pref_surface, avoid_steps, avoid_busy, min(s.multiplier) AS sm FROM s GROUP BY ALL), "
    "seen AS (SELECT profile, pref_surface, avoid_steps, avoid_busy, min(k.multiplier * s.multiplier * CASE WHEN profile = 'shortest' THEN 1 ELSE risk.m END) AS m FROM k JOIN s USING (profile, pref_surface, avoid_steps, avoid_busy) JOIN shape ON k.name = category AND s.name = surface_class JOIN risk USING (hazards) GROUP BY ALL) "
    f"SELECT profile, pref_surface, avoid_steps, avoid_busy, {base.half_up('km * sm', 6)} AS bound, {base.half_up('m', 6)} AS least, m >= km * sm - 1e-9 AS holds FROM bound JOIN sb USING (profile, pref_surface, avoid_steps, avoid_busy) JOIN seen USING (profile, pref_surface, avoid_steps, avoid_busy)"
)
def min_cost_per_meter(spark, sf_dir):
    """For the preferences that requests ask for, the search's bound on an edge's cost a metre and the least of all segments."""
    s = _segments(spark, sf_dir).select("category", "hazards", "surface_class").distinct()
    per = [F.min(cost.edge_cost(F.lit(1.0), C("category"), C("hazards"), C("surface_class"), cost.effective(*c))).alias(f"c{i}") for i, c in enumerate(COMBINATIONS)]
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("profile", "pref_surface", "avoid_steps", "avoid_busy"), c, strict=True)), F.lit(cost.least_per_metre(cost.effective(*c))).alias("bound"), C(f"c{i}").alias("least")) for i, c in enumerate(COMBINATIONS)))
    seen = s.agg(*per).select(F.inline(rows))
    return seen.join(_wanted(spark, sf_dir), ["pref_surface", "avoid_steps", "avoid_busy"], "left_semi").select("profile", "pref_surface", "avoid_steps", "avoid_busy", half_up(C("bound"), 6).alias("bound"), half_up(C("least"), 6).alias("least"), (C("least") >= C("bound") - 1e-9).alias("holds"))


@query(f"WITH {REQUESTS} SELECT request_id, 'surface=' || pref_surface || CASE WHEN avoid_steps THEN ',steps' ELSE '' END || CASE WHEN avoid_busy THEN ',busy_roads' ELSE '' END AS preferences FROM req")
def preferences_key(spark, sf_dir):
    return network.requests(spark, sf_dir).select("request_id", cost.preferences_key(C("pref_surface"), C("avoid_steps"), C("avoid_busy")).alias("preferences"))


def travelled(spark, sf_dir):
    """Lattice routes with attributes; lengths to the millimetre."""
    s = _segments(spark, sf_dir).select("id", C("category").alias("kind"), "name", "surface_class", "surface_inferred", "smoothness", "hazards", half_up(C("length_m"), 3).alias("length_m"))
    return network.lattice_routes(spark, sf_dir).join(s, "id")


SUM = base.half_up("sum(length_m)", 3)


def _sum(x=None):
    return half_up(F.sum(C("length_m") if x is None else x), 3)


@query(f"WITH {ROUTES} SELECT request_id, kind, {SUM} AS metres FROM redge GROUP BY ALL")
def distance_by_kind(spark, sf_dir):
    return travelled(spark, sf_dir).groupBy("request_id", "kind").agg(_sum().alias("metres"))


@query(f"WITH {ROUTES} SELECT request_id, surface_class, {SUM} AS metres FROM redge GROUP BY ALL")
def distance_by_surface(spark, sf_dir):
    return travelled(spark, sf_dir).groupBy("request_id", "surface_class").agg(_sum().alias("metres"))


@query(f"WITH {ROUTES} SELECT request_id, {base.half_up('sum(CASE WHEN surface_inferred THEN length_m ELSE 0 END)', 3)} AS metres FROM redge GROUP BY ALL")
def inferred_surface_m(spark, sf_dir):
    return travelled(spark, sf_dir).groupBy("request_id").agg(_sum(F.when(C("surface_inferred"), C("length_m")).otherwise(0.0)).alias("metres"))


AVOIDED = {s: [k for k, f in t.items() if f >= 3 and k != "unknown"] for s, t in V.SURFACE_PENALTIES.items()}
AVOIDED_SQL = "CASE pref_surface " + " ".join(f"WHEN '{s}' THEN surface_class IN ({strings(a)})" for s, a in AVOIDED.items() if a) + " ELSE false END"


@query(f"WITH {ROUTES} SELECT request_id, {base.half_up('sum(CASE WHEN ' + AVOIDED_SQL + ' THEN length_m ELSE 0 END)', 3)} AS metres FROM redge JOIN req USING (request_id) GROUP BY ALL")
def avoided_surface_m(spark, sf_dir):
    r = travelled(spark, sf_dir).join(network.requests(spark, sf_dir).select("request_id", "pref_surface"), "request_id")
    bad = F.lit(False)
    for s in V.SURFACE_PENALTIES:
        if names := cost.avoided(s):
            bad = bad | ((C("pref_surface") == s) & C("surface_class").isin(*names))
    return r.groupBy("request_id").agg(_sum(F.when(bad, C("length_m")).otherwise(0.0)).alias("metres"))


def islands_sql(keys: list[str]) -> str:
    same = " AND ".join(f"{k} IS NOT DISTINCT FROM lag({k}) OVER w" for k in keys)
    return f"isl AS (SELECT *, CAST(sum(new) OVER (PARTITION BY request_id ORDER BY seq) AS BIGINT) AS island FROM (SELECT *, CASE WHEN {same} AND lag(seq) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM redge WINDOW w AS (PARTITION BY request_id ORDER BY seq)))"


@query(f"WITH {ROUTES}, {islands_sql(['kind', 'name'])} SELECT request_id, island, any_value(kind) AS kind, max(name) AS name, {SUM} AS length_m FROM isl GROUP BY request_id, island")
def route_legs(spark, sf_dir):
    return planning.legs(travelled(spark, sf_dir)).withColumn("length_m", half_up(C("length_m"), 3))


STRETCHES = f"{ROUTES}, {islands_sql(planning.STRETCH)}, stretch AS (SELECT request_id, island, any_value(kind) AS kind, any_value(surface_class) AS surface_class, any_value(surface_inferred) AS surface_inferred, max(smoothness) AS smoothness, any_value(hazards) AS hazards, sum(length_m) AS length_m FROM isl GROUP BY request_id, island)"


@query(f"WITH {STRETCHES} SELECT request_id, island, kind, surface_class, surface_inferred, smoothness, array_to_string(hazards, ',') AS hazards, {base.half_up('length_m', 3)} AS length_m FROM stretch")
def route_stretches(spark, sf_dir):
    return planning.stretches(travelled(spark, sf_dir)).withColumns({"length_m": half_up(C("length_m"), 3), "hazards": F.array_join("hazards", ",")})


@query(f"WITH {ROUTES}, k AS (SELECT request_id, kind, sum(length_m) AS m FROM redge GROUP BY ALL) SELECT request_id, kind, {base.half_up('m', 3)} AS metres, {base.half_up('100 * m / sum(m) OVER (PARTITION BY request_id)', 4)} AS percent, CAST(row_number() OVER (PARTITION BY request_id ORDER BY {base.half_up('m', 3)} DESC, kind) AS INTEGER) AS place FROM k")
def breakdown_share(spark, sf_dir):
    k = travelled(spark, sf_dir).groupBy("request_id", "kind").agg(F.sum("length_m").alias("m"))
    per = W.partitionBy("request_id")
    return k.select("request_id", "kind", half_up(C("m"), 3).alias("metres"), half_up(100 * C("m") / F.sum("m").over(per), 4).alias("percent"), F.row_number().over(per.orderBy(half_up(C("m"), 3).desc(), "kind")).alias("place"))


@query(f"WITH {ROUTES}, k AS (SELECT request_id, kind, sum(length_m) AS m FROM redge GROUP BY ALL), t AS (SELECT request_id, arg_max(kind, round(m, 3) * 100 - list_position([{strings(V.KINDS)}], kind) * 0.0001) AS kind, max(m) / sum(m) AS share FROM k GROUP BY request_id) SELECT request_id, kind, CASE WHEN share >= 0.99 THEN 'All' ELSE 'Mostly' END AS label FROM t")
def dominant_kind(spark, sf_dir):
    k = travelled(spark, sf_dir).groupBy("request_id", "kind").agg(F.sum("length_m").alias("m"))
    place = F.array_position(F.array(*map(F.lit, V.KINDS)), C("kind"))
    t = k.groupBy("request_id").agg(F.max_by("kind", F.struct(F.round("m", 3), -place)).alias("kind"), (F.max("m") / F.sum("m")).alias("share"))
    return t.select("request_id", "kind", F.when(C("share") >= 0.99, "All").otherwise("Mostly").alias("label"))


@query(f"WITH {ROUTES}, t AS (SELECT request_id, sum(length_m) AS m, sum(CASE WHEN {AVOIDED_SQL} THEN length_m ELSE 0 END) AS bad, sum(CASE WHEN surface_inferred THEN length_m ELSE 0 END) AS inf, any_value(pref_surface) AS p FROM redge JOIN req USING (request_id) GROUP BY request_id) SELECT request_id, bad >= 10 AS avoided_surface, inf / m >= 0.05 AS inferred_surface, request_id % 60 > 25 AS far_snap, p = 'any' AND request_id % 2 = 0 AS suggest_smooth FROM t")
def route_alerts(spark, sf_dir):
    r = travelled(spark, sf_dir).join(network.requests(spark, sf_dir).select("request_id", "pref_surface"), "request_id")
    bad = F.lit(False)
    for s in V.SURFACE_PENALTIES:
        if names := cost.avoided(s):
            bad = bad | ((C("pref_surface") == s) & C("surface_class").isin(*names))
    m = lambda x: sum_in_order("seq", x)
    t = r.groupBy("request_id").agg(m(C("length_m")).alias("m"), m(F.when(bad, C("length_m")).otherwise(0.0)).alias("bad"), m(F.when(C("surface_inferred"), C("length_m")).otherwise(0.0)).alias("inf"), F.first("pref_surface").alias("p"))
    snap_m, walking = C("request_id") % 60, C("request_id") % 2 == 0
    return t.select("request_id", (C("bad") >= 10).alias("avoided_surface"), (C("inf") / C("m") >= 0.05).alias("inferred_surface"), (snap_m > 25).alias("far_snap"), ((C("p") == "any") & walking).alias("suggest_smooth"))


@query(f"WITH {ROUTES} SELECT request_id, printf('%.2f km', floor(sum(length_m) / 10 + 0.5) / 100) AS text FROM redge GROUP BY request_id")
def format_distance(spark, sf_dir):
    t = travelled(spark, sf_dir).groupBy("request_id").agg(F.floor(sum_in_order("seq", C("length_m")) / 10 + 0.5).alias("h"))
    return t.select("request_id", F.concat((F.floor(C("h") / 100)).cast("string"), F.lit("."), F.lpad((C("h") % 100).cast("string"), 2, "0"), F.lit(" km")).alias("text"))


def _ends(spark, sf_dir):
    """Requests as points a little off the lattice."""
    r = network.requests(spark, sf_dir)
    at = lambda v, o: (F.lit(o) + C(v) * 10_000).cast("long")
    return r.select("request_id", "pref_surface", "avoid_steps", "avoid_busy", (at("x0", 1449000000) + 120).alias("s_lng"), (at("y0", -385000000) + 80).alias("s_lat"), (at("x0", 1449000000) + C("dx") * 10_000 - 90).alias("e_lng"), (at("y0", -385000000) + C("dy") * 10_000 + 60).alias("e_lat"))


#: What costs are made of.
PRICED = ("category", "hazards", "surface_class", "direction")


def _plans(spark, sf_dir, keep=PRICED, **options):
    g = graph.build(network.segments(network.paths(spark, sf_dir)), keep=keep)
    return g, planning.plan(g, _ends(spark, sf_dir), **options)


@query()
def plan_routes(spark, sf_dir):
    _, p = _plans(spark, sf_dir)
    return p.select("request_id", "status", half_up(C("cost"), 3).alias("cost"), F.size("edges").alias("edges"))


_ENDS = "ends_ AS (SELECT request_id * 2 AS pid, 1449000000 + x0 * 10000 + 120 AS p_lng, -385000000 + y0 * 10000 + 80 AS p_lat FROM req UNION ALL SELECT request_id * 2 + 1, 1449000000 + (x0 + dx) * 10000 - 90, -385000000 + (y0 + dy) * 10000 + 60 FROM req)"


@query(
    f"WITH {REQUESTS}, {RAW}, {VERTICES}, {PIECES}, {_ENDS}, {nearest_sql('ends_', 0.9)}, s AS (SELECT request_id, bool_or(pid = request_id * 2) AS a, bool_or(pid = request_id * 2 + 1) AS b FROM req LEFT JOIN best ON pid // 2 = request_id GROUP BY request_id) "
    "SELECT CASE WHEN NOT coalesce(a, false) THEN 'START_NOT_NEAR_NETWORK' WHEN NOT b THEN 'END_NOT_NEAR_NETWORK' ELSE 'OK' END AS status, count(*) AS n FROM s GROUP BY 1"
)
def plan_status(spark, sf_dir):
    """Statuses on a network without bridges, with ends at most 0.9 m from it; the lattice hangs together."""
    g = graph.build(network.segments(network.paths(spark, sf_dir)), tolerance_m=0)
    return planning.statuses(g, _ends(spark, sf_dir), max_m=0.9).groupBy("status").agg(F.count("*").alias("n"))


@query(
    f"WITH {REQUESTS}, {RAW} SELECT CAST(request_id AS VARCHAR) AS request_id, 'OK' AS status, {base.half_up(base.haversine_e7('a', 'm') + ' / 2', 3)} AS cost FROM req JOIN raw ON id = src * 3 WHERE dir = 0"
)
def same_edge_route(spark, sf_dir):
    """From the middle of an east segment's first piece to its second vertex: along the edge, by the shortest profile."""
    first = network.paths(spark, sf_dir).where("dir = 0").select("id", C("coordinates")[0].alias("a"), C("coordinates")[1].alias("m"))
    r = network.requests(spark, sf_dir).select("request_id", (C("src") * 3).alias("id")).join(first, "id")
    ask = r.select("request_id", *((F.floor((C(f"a.{c}_e7") + C(f"m.{c}_e7")) / 2)).cast("long").alias(f"s_{c}") for c in ("lng", "lat")), *(C(f"m.{c}_e7").alias(f"e_{c}") for c in ("lng", "lat")))
    g = graph.build(network.segments(network.paths(spark, sf_dir)), tolerance_m=0, keep=PRICED)
    return planning.plan(g, ask, V.SHORTEST).select("request_id", "status", half_up(C("cost"), 3).alias("cost"))


_PRICE = _priced(cost.effective(V.PREFER_PATHS)).replace(f"({LENGTH})", "len")


@query(
    f"WITH RECURSIVE {SEG}, {EDGES}, cost_ AS (SELECT e.*, {_PRICE} AS price FROM ends e JOIN (SELECT id, category, hazards, surface_class FROM net) n ON n.id = e.path_id), "
    "arc AS (SELECT from_node AS node, to_node AS other, price FROM cost_ UNION ALL SELECT to_node, from_node, price FROM cost_ WHERE from_node <> to_node), src AS (SELECT DISTINCT from_node AS node FROM ends WHERE path_id % 30 = 0 AND run = 0), "
    "r(node, cost) USING KEY (node) AS (SELECT node, 0::DOUBLE FROM src UNION SELECT n.node, n.cost FROM (SELECT other AS node, min(r.cost + price) AS cost FROM r JOIN arc ON arc.node = r.node GROUP BY other) n LEFT JOIN recurring.r s ON s.node = n.node WHERE s.cost IS NULL OR n.cost < s.cost) "
    f"SELECT node, {base.half_up('cost', 3)} AS cost FROM r"
)
def shortest_path_cost(spark, sf_dir):
    """Least cost from every tenth crossing to every node."""
    e = graph.build(network.segments(network.paths(spark, sf_dir)), tolerance_m=0, keep=PRICED[:3], bare=True, ends=True).edges
    price = cost.edge_cost(C("length_m"), C("kind"), C("hazards"), C("surface_class"), cost.effective(V.PREFER_PATHS))
    return planning.reach(e, e.where("path_id % 30 = 0 AND run = 0").select(C("from_node").alias("node")), price).select("node", half_up(C("cost"), 3).alias("cost"))


@query()
def snap_preferring(spark, sf_dir):
    g = graph.build(network.segments(network.paths(spark, sf_dir)))
    p = planning.statuses(g, _ends(spark, sf_dir).drop("pref_surface", "avoid_steps", "avoid_busy"), surface="smooth_only")
    return p.select("request_id", "status", half_up(C("start.distance_m"), 2).alias("start_m"), half_up(C("end.distance_m"), 2).alias("end_m"))


def _blocks(spark, sf_dir):
    """All segments, each second block of ten columns and of ten rows moved by 3 m, so that no two blocks meet."""
    east, north = C("x") % 20 >= 10, C("y") % 20 >= 10
    moved = F.transform("coordinates", lambda p: F.struct((p["lng_e7"] + F.when(east, 300).otherwise(0)).alias("lng_e7"), (p["lat_e7"] + F.when(north, 300).otherwise(0)).alias("lat_e7")))
    return network.segments(network.paths(spark, sf_dir).withColumn("coordinates", moved))


@query()
def connected_snap(spark, sf_dir):
    """Snaps on a network of many components; requests that have to move to meet."""
    g = graph.build(_blocks(spark, sf_dir), tolerance_m=0)
    p = planning.statuses(g, _ends(spark, sf_dir))
    return p.select("request_id", "status", C("start.edge_id").alias("start_edge"), C("end.edge_id").alias("end_edge"))


@query()
def route_geojson(spark, sf_dir):
    """Each route's line as a GeoJSON geometry."""
    g, p = _plans(spark, sf_dir)
    line = F.struct(F.lit("LineString").alias("type"), F.transform("coordinates", lambda c: F.array(c["lng"], c["lat"])).alias("coordinates"))
    return planning.route_lines(p, g).select("request_id", F.size("coordinates").alias("points"), F.to_json(line).alias("geometry"))


@query()
def route_query(spark, sf_dir):
    """Whole answers as GeoJSON Features, by each request's own preferences."""
    g, p = _plans(spark, sf_dir, graph.ATTRIBUTES)
    return planning.answers(p, g, _ends(spark, sf_dir))
