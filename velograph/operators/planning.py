"""Routes: reachable snaps, least-cost search in batches, and what a route is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import vocab as V
from ..functions.exprs import half_up, sum_in_order
from ..runtime import materialise, release
from . import cost, frontier, polylines, scoring, search
from .graph import Graph
from .snap import MAX_SNAP_M, snap, snap_preferring

NOTES = "array<struct<tone:string,text:string,metres:double,points:double>>"
OWN = ("pref_surface", "avoid_steps", "avoid_busy")


def _best_pair(g: Graph, points: DataFrame, snaps: DataFrame, max_m: float) -> DataFrame:
    """Start and end snaps in one component: as they are, or the pair of least total distance among three choices."""
    part = g.edges.select("edge_id", "from_node").join(g.components, F.col("from_node") == F.col("node_id")).select("edge_id", "component")
    s = materialise(snaps.join(part, "edge_id"))
    sides = [s.where(F.col("point_id").endswith(t)).select(F.expr("left(point_id, length(point_id) - 2)").alias("request_id"), F.struct("edge_id", "along_m", "lng", "lat", "distance_m", "length_m").alias(n), F.col("component").alias(f"c_{n}")) for t, n in ((":s", "start"), (":e", "end"))]
    both = sides[0].join(sides[1], "request_id")
    fine = both.where("c_start = c_end").select("request_id", "start", "end")
    apart = both.where("c_start <> c_end")
    if apart.isEmpty():
        return fine
    apart = materialise(apart)
    main = g.components.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "component").limit(1).select(F.col("component").alias("main"))
    edges = g.edges.join(part, "edge_id")
    apart = apart.crossJoin(F.broadcast(main))  # one row
    tries = [("end", F.col("c_start"), ":e"), ("start", F.col("c_end"), ":s"), ("both_s", F.col("main"), ":s"), ("both_e", F.col("main"), ":e")]
    wanted = None
    for name, component, suffix in tries:
        w = apart.select(F.concat("request_id", F.lit(suffix)).alias("orig"), F.concat("request_id", F.lit(f":{name}")).alias("point_id"), component.alias("component"))
        wanted = w if wanted is None else wanted.unionByName(w)
    edges = materialise(edges)
    again = points.select(F.col("point_id").alias("orig"), "lng_e7", "lat_e7").join(wanted, "orig").drop("orig")
    hits = snap(again, edges, max_m, on=("component",))
    hit = F.struct("edge_id", "along_m", "lng", "lat", "distance_m", "length_m")
    got = hits.groupBy(F.regexp_extract("point_id", r"^(.*):(\w+)$", 1).alias("request_id")).agg(*(F.max(F.when(F.col("point_id").endswith(f":{n}"), hit)).alias(n) for n, *_ in tries))
    choices = F.filter(
        F.array(
            F.struct(F.lit(0).alias("o"), F.col("start0").alias("start"), F.col("end").alias("end")),
            F.struct(F.lit(1).alias("o"), F.col("start").alias("start"), F.col("end0").alias("end")),
            F.struct(F.lit(2).alias("o"), F.col("both_s").alias("start"), F.col("both_e").alias("end")),
        ),
        lambda c: c["start"].isNotNull() & c["end"].isNotNull(),
    )
    joined = apart.select("request_id", F.col("start").alias("start0"), F.col("end").alias("end0")).join(got, "request_id")
    scored = joined.select("request_id", F.array_min(F.transform(choices, lambda c: F.struct((c["start"]["distance_m"] + c["end"]["distance_m"]).alias("d"), c["o"].alias("o"), c["start"].alias("start"), c["end"].alias("end")))).alias("c"))
    return fine.unionByName(scored.where("c IS NOT NULL").select("request_id", "c.start", "c.end"))


def _placed(g: Graph, requests: DataFrame, preferences: tuple, max_m: float) -> tuple[DataFrame, DataFrame, DataFrame, list[tuple]]:
    """Requests with ``pref`` (which of the combinations of preferences), their snaps, the pairs of snaps in one component, and the combinations."""
    rid = F.col("request_id").cast("string")
    own = dict(zip(("profile", *OWN), preferences, strict=True))
    requests = requests.withColumns({c: F.coalesce(c, F.lit(v)) if c in requests.columns else F.lit(v) for c, v in own.items()})
    # at most as many as there are combinations of profiles and preferences
    combinations = sorted(tuple(r) for r in requests.select(*own).distinct().collect())
    pref = F.lit(0)
    for i, c in enumerate(combinations):
        pref = F.when((F.col("profile") == c[0]) & (cost.preferences_key(*map(F.col, OWN)) == cost.preferences_key(*map(F.lit, c[1:]))), i).otherwise(pref)
    bad = F.array().cast("array<string>")
    for s in {c[1] for c in combinations}:
        bad = F.when(F.col("pref_surface") == s, F.array(*map(F.lit, cost.avoided(s))).cast("array<string>")).otherwise(bad)
    points = requests.select(rid.alias("r"), bad.alias("avoid"), F.explode(F.array(*(F.struct(F.lit(t).alias("side"), F.col(f"{p}_lng").alias("lng_e7"), F.col(f"{p}_lat").alias("lat_e7")) for t, p in ((":s", "s"), (":e", "e"))))).alias("p"))
    points = points.select(F.concat("r", "p.side").alias("point_id"), "p.lng_e7", "p.lat_e7", "avoid")
    # stored step by step: the steps refer to each other many times, and a plan of their copies would be vast
    snaps = materialise(snap_preferring(points, g.edges, max_m))
    pairs = materialise(_best_pair(g, points, snaps, max_m))
    return requests.select(rid.alias("request_id"), pref.cast("int").alias("pref")), snaps, pairs, combinations


def _missing(snaps: DataFrame) -> DataFrame:
    """(request_id, has_start, has_end) of requests with a snap at least."""
    return snaps.select("point_id").groupBy(F.expr("left(point_id, length(point_id) - 2)").alias("request_id")).agg(*(F.max(F.when(F.col("point_id").endswith(t), True)).alias(n) for t, n in ((":s", "has_start"), (":e", "has_end"))))


def _status(without: Column) -> Column:
    return F.when(F.col("has_start").isNull(), "START_NOT_NEAR_NETWORK").when(F.col("has_end").isNull(), "END_NOT_NEAR_NETWORK").when(without, "NO_ROUTE").otherwise("OK").alias("status")


def statuses(g: Graph, requests: DataFrame, profile: str = V.PREFER_PATHS, surface: str = "any", avoid_steps: bool = False, avoid_busy: bool = False, max_m: float = MAX_SNAP_M) -> DataFrame:
    """(request_id, status, start, end): what ``plan`` gives without one-way rules, but not the routes. As every edge leads both
    ways at a finite cost, there is a route if and only if both snaps lie in one component; so none is searched for."""
    asked, snaps, pairs, _ = _placed(g, requests, (profile, surface, avoid_steps, avoid_busy), max_m)
    everything = asked.join(_missing(snaps), "request_id", "left").join(pairs, "request_id", "left")
    return everything.select("request_id", _status(F.col("start").isNull()), "start", "end")


def plan(g: Graph, requests: DataFrame, profile: str = V.PREFER_PATHS, surface: str = "any", avoid_steps: bool = False, avoid_busy: bool = False, max_m: float = MAX_SNAP_M, one_way: bool = False) -> DataFrame:
    """(request_id, status, cost, start, end, edges): one row per request (request_id, s_lng, s_lat, e_lng, e_lat).

    A request's own profile, pref_surface, avoid_steps and avoid_busy, where it has them, stand before the arguments. With
    ``one_way`` edges are travelled in their direction only.

    Edges are (edge_id, from_m, to_m) in travel order; the first and last are parts. Status is OK, START_NOT_NEAR_NETWORK,
    END_NOT_NEAR_NETWORK or NO_ROUTE.
    """
    asked, snaps, pairs, combinations = _placed(g, requests, (profile, surface, avoid_steps, avoid_busy), max_m)
    tables = [cost.effective(*c) for c in combinations]
    sides = [F.col(f"{n}.{c}").alias(f"{n[0]}_{a}") for n in ("start", "end") for c, a in (("edge_id", "edge"), ("along_m", "along"), ("lng", "lng"), ("lat", "lat"))]
    ask = pairs.join(asked, "request_id").select("request_id", "pref", *sides)
    found = search.cheapest(g.edges, ask, tables, [cost.least_per_metre(t) for t in tables], one_way)
    everything = asked.join(_missing(snaps), "request_id", "left").join(pairs, "request_id", "left").join(found, "request_id", "left")
    return everything.select("request_id", _status(F.col("cost").isNull()), "cost", "start", "end", "edges")


def route_edges(plans: DataFrame, g: Graph) -> DataFrame:
    """Travelled parts of edges with their attributes: (request_id, seq, edge_id, length_m, kind, ...)."""
    steps = plans.where("status = 'OK'").select("request_id", F.posexplode("edges").alias("seq", "e")).select("request_id", "seq", "e.*")
    attributes = g.edges.select("edge_id", "kind", "name", "surface_class", "surface_inferred", "smoothness", "hazards")
    return steps.join(attributes, "edge_id").withColumn("length_m", F.abs(F.col("to_m") - F.col("from_m")))


def legs(route: DataFrame) -> DataFrame:
    """Runs of one kind and name."""
    return polylines.islands(route, "request_id", "seq", ["kind", "name"]).groupBy("request_id", "island").agg(F.first("kind").alias("kind"), F.first("name").alias("name"), F.sum("length_m").alias("length_m"))


STRETCH = ["kind", "surface_class", "surface_inferred", "smoothness", "hazards"]


def stretches(route: DataFrame) -> DataFrame:
    """Runs that agree in all that matters for scoring."""
    return polylines.islands(route, "request_id", "seq", STRETCH).groupBy("request_id", "island").agg(*(F.first(c).alias(c) for c in STRETCH), sum_in_order("seq", F.col("length_m")).alias("length_m"))


def route_lines(plans: DataFrame, g: Graph) -> DataFrame:
    """(request_id, coordinates): each route's points in degrees, where parts meet once."""
    steps = plans.where("status = 'OK'").select("request_id", F.posexplode("edges").alias("seq", "e")).select("request_id", "seq", "e.*")
    lines = g.edges.select("edge_id", "coordinates", geo.lengths(F.col("coordinates")).alias("cum"))
    parts = steps.join(lines, "edge_id").select("request_id", F.struct("seq", polylines.between(F.col("coordinates"), F.col("cum"), F.col("from_m"), F.col("to_m")).alias("line")).alias("part"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p, i: F.when(i == 0, p["line"]).otherwise(F.slice(p["line"], F.lit(2), F.greatest(F.size(p["line"]) - 1, F.lit(0))))))
    return parts.groupBy("request_id").agg(joined.alias("coordinates"))


def answers(plans: DataFrame, g: Graph, requests: DataFrame, profile: str = V.PREFER_PATHS) -> DataFrame:
    """(request_id, status, feature): each route as a GeoJSON Feature with its legs, sums, scores and snaps; metres and cost to
    one digit. A request without a route has its status only."""
    route = materialise(route_edges(plans, g))
    one = lambda c: half_up(c, 1)
    own = requests.select(F.col("request_id").cast("string").alias("request_id"), *(F.coalesce(c, F.lit(v)).alias(c) if c in requests.columns else F.lit(v).alias(c) for c, v in (("profile", profile), ("pref_surface", "any"), ("avoid_steps", False), ("avoid_busy", False))))
    bad = F.lit(False)
    for s in V.SURFACE_PENALTIES:
        bad = bad | ((F.col("pref_surface") == s) & F.col("surface_class").isin(*cost.avoided(s)))
    total = route.join(own.select("request_id", "pref_surface"), "request_id").groupBy("request_id").agg(
        one(F.sum("length_m")).alias("distanceM"),
        one(F.sum(F.when(F.col("surface_inferred"), F.col("length_m")).otherwise(0.0))).alias("inferredSurfaceM"),
        one(F.sum(F.when(bad, F.col("length_m")).otherwise(0.0))).alias("avoidedSurfaceM"),
    )

    def sums(by: str, name: str) -> DataFrame:
        each = route.groupBy("request_id", by).agg(one(F.sum("length_m")).alias("m"))
        return each.groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "m")))).alias(name))

    leg = legs(route).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("island", "kind", "name", one(F.col("length_m")).alias("lengthM")))).alias("legs"))
    leg = leg.select("request_id", F.transform("legs", lambda x: F.struct(x["kind"].alias("kind"), x["name"].alias("name"), x["lengthM"].alias("lengthM"))).alias("legs"))
    parts = materialise(stretches(route))
    note = None
    for activity in scoring.ACTIVITIES:
        n = scoring.notes(parts, activity).withColumn("activity", F.lit(activity))
        note = n if note is None else note.unionByName(n)
    note = note.groupBy("request_id", "activity").agg(F.array_sort(F.collect_list(F.struct("place", "tone", "text", "metres", "points"))).alias("notes"))
    told = F.transform("notes", lambda n: F.struct(*(n[c].alias(c) for c in ("tone", "text", "metres", "points"))))
    judged = scoring.scores(parts).join(note, ["request_id", "activity"], "left").select("request_id", "activity", F.struct("score", "rating", "confidence", F.coalesce(told, F.expr(f"cast(array() as {NOTES})")).alias("notes")).alias("s"))
    score = judged.groupBy("request_id").agg(F.struct(*(F.max(F.when(F.col("activity") == a, F.col("s"))).alias(a) for a in scoring.ACTIVITIES)).alias("scores"))
    full = plans.join(own, "request_id")
    for part in (route_lines(plans, g), total, leg, sums("kind", "distanceByKind"), sums("surface_class", "distanceBySurface"), score):
        full = full.join(part, "request_id", "left")
    snapped = lambda n: F.struct(F.array(f"{n}.lng", f"{n}.lat").alias("point"), one(F.col(f"{n}.distance_m")).alias("distanceM")).alias(n)
    # a route without length has the least score of each activity
    none = F.struct(F.lit(0).cast("long").alias("score"), F.lit("poor").alias("rating"), F.lit("low").alias("confidence"), F.expr(f"cast(array() as {NOTES})").alias("notes"))
    nothing = F.struct(*(none.alias(a) for a in scoring.ACTIVITIES))
    properties = F.struct(
        "profile", F.struct(F.col("pref_surface").alias("surface"), F.col("avoid_steps").alias("avoidSteps"), F.col("avoid_busy").alias("avoidBusyRoads")).alias("preferences"), "avoidedSurfaceM", F.coalesce("scores", nothing).alias("scores"),
        F.coalesce("distanceM", F.lit(0.0)).alias("distanceM"), one(F.col("cost")).alias("cost"), "legs", "distanceByKind", "distanceBySurface", "inferredSurfaceM", F.struct(snapped("start"), snapped("end")).alias("snap"),
    )
    line = F.struct(F.lit("LineString").alias("type"), F.transform("coordinates", lambda p: F.array(p["lng"], p["lat"])).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), properties.alias("properties")))
    return full.select("request_id", "status", F.when(F.col("status") == "OK", feature).alias("feature"))


def reach(edges: DataFrame, sources: DataFrame, price: DataFrame | Column, most: int | None = None) -> DataFrame:
    """(node, cost): least cost from any of ``sources`` (node) to every node that can be reached. ``price``: edge_id, price, or of
    the edges' columns. Edges are placed by their lines, or by their point ``from`` if they have none."""
    at = [F.col(f"from.{c}").alias(f"f_{c[:3]}") for c in ("lng_e7", "lat_e7")] if "from" in edges.columns else search.end_places()[:2]
    own = [price.alias("price")] if isinstance(price, Column) else []
    slim = edges.select("edge_id", "from_node", "to_node", *at, *own)
    return frontier.reach(slim if own else slim.join(price, "edge_id"), sources, most or frontier.MOST)
