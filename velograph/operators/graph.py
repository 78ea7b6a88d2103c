"""The routable graph: junctions, gap bridging, edges, nodes, adjacency, components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..runtime import materialise, release
from . import polylines
from .components import connected_components
from .ranking import numbered
from .snap import nearest

BRIDGE_M = 15.0
ATTRIBUTES = ["category", "name", "hazards", "surface_class", "surface_inferred", "smoothness", "direction"]


@dataclass
class Graph:
    edges: DataFrame  # edge_id, from_node, to_node, length_m, kind, path_id, attributes, coordinates (bare: points, how many)
    nodes: DataFrame  # node_id, lng_e7, lat_e7
    segments: int

    @cached_property
    def components(self) -> DataFrame:
        """(node_id, component), made when first asked for."""
        return materialise(label_components(self.edges, self.nodes))


def junctions(vertices: DataFrame) -> DataFrame:
    """Points used more than once, repeats within a segment included."""
    return vertices.groupBy("lng_e7", "lat_e7").agg(F.count("*").alias("uses")).where("uses > 1")


def bridge_candidates(segments: DataFrame, tolerance_m: float = BRIDGE_M) -> DataFrame:
    """Dangling ends of segments that bridge gaps, with the nearest other segment within the tolerance.

    (id, at_end, end, target, piece, t, hit, is_vertex): hit is the point to connect to, an existing vertex if the
    projection lands on one.
    """
    n = F.size("coordinates")
    v = polylines.vertices(segments)
    ends = segments.where(F.col("bridge_gaps") & (n >= 2)).select("id", F.posexplode(F.array(F.col("coordinates")[0], F.element_at("coordinates", -1))).alias("at_end", "end"))
    used = junctions(v).select(F.struct("lng_e7", "lat_e7").alias("end"))
    dangling = ends.join(used, "end", "left_anti").select(F.concat_ws(":", "id", "at_end").alias("key"), "id", "at_end", F.col("end.lng_e7").alias("lng_e7"), F.col("end.lat_e7").alias("lat_e7"))
    dangling = materialise(dangling)
    hits = nearest(dangling.select(F.col("key").alias("point_id"), "lng_e7", "lat_e7", F.col("id").alias("self")), polylines.pieces(segments), tolerance_m, F.col("self") != F.col("id"))
    found = dangling.join(hits.withColumnsRenamed({"point_id": "key", "id": "target"}), "key")
    vertex = F.when(F.col("t") <= 1e-9, F.col("a")).when(F.col("t") >= 1 - 1e-9, F.col("b"))
    projected = F.struct(geo.to_e7(F.col("lng")).alias("lng_e7"), geo.to_e7(F.col("lat")).alias("lat_e7"))
    out = found.select("id", "at_end", F.struct("lng_e7", "lat_e7").alias("end"), "target", "piece", "t", F.coalesce(vertex, projected).alias("hit"), vertex.isNotNull().alias("is_vertex"))
    return out.where("hit <> end")


def accept_bridges(candidates: DataFrame) -> DataFrame:
    """The candidates that hold when taken one after the other by (id, start before end): an end that an earlier accepted
    one touched is no longer dangling, and a pair of points is connected once.

    Of candidates with one end only the first can hold. Any other waits for the earlier ones that touch its end: it holds if
    none of them does. These links are settled in rounds of joins: what waits for nothing is decided and its links are
    resolved, and what waits for one other only hands its link on, so chains halve; the number of rounds grows with the
    logarithm of the longest chain, and no cluster of candidates meets in one task.
    """
    candidates, at = materialise(candidates), F.col("id") * 2 + F.col("at_end")
    keyed = candidates.select(at.alias("c"), F.col("end").alias("p"), F.col("hit").alias("q"))
    first = materialise(keyed.groupBy("p").agg(F.min_by(F.struct("c", "q"), "c").alias("f")).select("f.c", "p", "f.q"))
    touching = first.select(F.col("c").alias("x"), F.col("q").alias("p"))  # no other one has its end
    links = materialise(first.join(touching, "p").where("x < c").select("c", "x", F.lit(False).alias("flip")))
    # decided: (c, holds)
    decided = first.select("c").join(links.select("c").distinct(), "c", "left_anti").withColumn("holds", F.lit(True))
    if links.isEmpty():
        return candidates.join(decided.select("c"), at == F.col("c"), "left_semi")
    decided = materialise(decided)
    fresh = decided
    while not links.isEmpty():
        # a link says "holds" if its target does, or with flip if it doesn't; one that does ends the wait with no, none left with yes
        told = links.join(fresh.select(F.col("c").alias("x"), "holds"), "x", "left").withColumn("says", F.col("holds") != F.col("flip"))
        state = told.groupBy("c").agg(F.coalesce(F.bool_or("says"), F.lit(False)).alias("no"), F.count_if(F.col("says").isNull()).alias("waits"), F.min_by("x", F.when(F.col("says").isNull(), F.col("x"))).alias("x"), F.min_by("flip", F.when(F.col("says").isNull(), F.col("x"))).alias("flip"))
        state = materialise(state)
        fresh = materialise(state.where("no OR waits = 0").select("c", (~F.col("no")).alias("holds")))
        open_ = state.where("NOT no AND waits > 0").select("c", "waits")
        left = told.where("says IS NULL").select("c", "x", "flip").join(open_, "c")
        # c waits for x alone, and x for y alone: then c waits for y
        alone = state.where("NOT no AND waits = 1").select(F.col("c").alias("x"), F.col("x").alias("y"), F.col("flip").alias("flip_x"))
        jumped = left.join(alone, "x", "left")
        jump = (F.col("waits") == 1) & F.col("y").isNotNull()
        new = jumped.select("c", F.when(jump, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(jump, F.col("flip") == F.col("flip_x")).otherwise(F.col("flip")).alias("flip"))
        old, links = links, materialise(new)
        decided = decided.unionByName(fresh)
        release(old, state)
    return candidates.join(decided.where("holds").select("c"), at == F.col("c"), "left_semi")


def splice(segments: DataFrame, accepted: DataFrame) -> DataFrame:
    """Segments with the accepted projections as new vertices, in order along each line."""
    new = accepted.where("NOT is_vertex").select(F.col("target").alias("id"), F.col("piece").alias("pos"), "t", F.col("hit.lng_e7").alias("lng_e7"), F.col("hit.lat_e7").alias("lat_e7"))
    touched = segments.join(new.select("id").distinct(), "id", "left_semi")
    old = polylines.vertices(touched).select("id", "pos", F.lit(0.0).alias("t"), "lng_e7", "lat_e7")
    order = F.array_sort(F.collect_list(F.struct("pos", "t", F.struct("lng_e7", "lat_e7").alias("p"))))
    lines = old.unionByName(new).groupBy("id").agg(order.alias("v")).select("id", F.transform("v", lambda v: v["p"]).alias("spliced"))
    return segments.join(lines, "id", "left").withColumn("coordinates", F.coalesce("spliced", "coordinates")).drop("spliced")


def without_repeats(coords: Column) -> Column:
    """Neighbouring equal vertices once."""
    return F.filter(coords, lambda p, i: (i == 0) | (p != F.element_at(coords, F.greatest(i, F.lit(1)))))


def split_edges(segments: DataFrame, points: DataFrame, keep: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """(path_id, run, coordinates, attributes): segments cut at interior points that are junctions."""
    clean = segments.where(F.size("coordinates") >= 2).withColumn("coordinates", without_repeats(F.col("coordinates"))).where(F.size("coordinates") >= 2)
    # the ends are borders anyway; what lies between two borders is an edge
    inner = clean.select("id", F.posexplode(F.slice("coordinates", F.lit(2), F.size("coordinates") - 2)).alias("pos", "p")).select("id", (F.col("pos") + 1).alias("pos"), "p.lng_e7", "p.lat_e7")
    cuts = inner.join(points.select("lng_e7", "lat_e7"), ["lng_e7", "lat_e7"], "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("pos")).alias("cuts"))
    borders = clean.join(cuts, "id", "left").withColumn("borders", F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.size("coordinates") - 1)))
    runs = F.transform(F.sequence(F.lit(1), F.size("borders") - 1), lambda i: F.struct(F.element_at("borders", i).alias("s"), F.element_at("borders", i + 1).alias("e")))
    cut = borders.withColumn("runs", runs).select(F.col("id").alias("path_id"), "coordinates", *keep, F.posexplode("runs").alias("run", "r"))
    cut = cut.withColumn("run", F.col("run").cast("long"))
    return cut.withColumn("coordinates", F.expr("slice(coordinates, r.s + 1, r.e - r.s + 1)")).drop("r").withColumnRenamed("category", "kind")


def connectors(accepted: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return accepted.select(
        F.lit(None).cast("long").alias("path_id"), (F.col("id") * 2 + F.col("at_end")).alias("run"), F.array("end", "hit").alias("coordinates"), F.lit(None).cast("string").alias("name"),
        none.alias("hazards"), F.lit("unknown").alias("surface_class"), F.lit(False).alias("surface_inferred"), F.lit(None).cast("string").alias("smoothness"), F.lit("both").alias("direction"), F.lit("connector").alias("kind"),
    )


def with_nodes(runs: DataFrame, bare: bool = False, ends: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges with end nodes, and nodes numbered by first appearance along the edges.

    Numbers are made on keys and end points alone; lines and attributes move once, to meet them. Bare edges have no lines, so
    what they carry goes with the keys.
    """
    terminals = F.col("coordinates")[0].alias("from"), F.element_at("coordinates", -1).alias("to")
    length = geo.length(F.col("coordinates")).alias("length_m")
    if bare:
        keyed = runs.select(*(c for c in runs.columns if c != "coordinates"), *terminals, length, F.size("coordinates").alias("points"))
    else:
        runs = materialise(runs)
        keyed = runs.select("path_id", "run", *terminals)
    keys = materialise(numbered(keyed, "edge_id", F.col("path_id").asc_nulls_last(), F.col("run")))
    each = keys.select("edge_id", F.posexplode(F.array("from", "to")).alias("which", "p"))
    first = each.groupBy("p").agg(F.min(F.struct("edge_id", "which")).alias("first"))
    nodes = materialise(numbered(first, "node_id", F.col("first.edge_id"), F.col("first.which")).select("node_id", "p"))
    a, b = (nodes.select(F.col("node_id").alias(f"{n}_node"), F.col("p").alias(n)) for n in ("from", "to"))
    met = keys.join(a, "from").join(b, "to")
    if bare:
        return met if ends else met.drop("from", "to"), nodes.select("node_id", "p.lng_e7", "p.lat_e7")
    named = met.select(F.col("path_id").alias("path_"), F.col("run").alias("run_"), "edge_id", "from_node", "to_node")
    edges = runs.join(named, F.col("path_id").eqNullSafe(F.col("path_")) & (F.col("run") == F.col("run_"))).drop("path_", "run_")
    return edges.withColumn("length_m", length), nodes.select("node_id", "p.lng_e7", "p.lat_e7")


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, edge_id, other, forward): each edge from both its ends, a loop once."""
    out = edges.select(F.col("from_node").alias("node"), "edge_id", F.col("to_node").alias("other"), F.lit(True).alias("forward"))
    back = edges.where("from_node <> to_node").select(F.col("to_node").alias("node"), "edge_id", F.col("from_node").alias("other"), F.lit(False).alias("forward"))
    return out.unionByName(back)


def label_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, component): the component's smallest node."""
    linked = connected_components(edges.select(F.col("from_node").alias("a"), F.col("to_node").alias("b")), near=True)
    return nodes.select("node_id").join(linked.withColumnRenamed("node", "node_id"), "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))


def build(segments: DataFrame, tolerance_m: float = BRIDGE_M, keep: Sequence[str] = ATTRIBUTES, bare: bool = False, ends: bool = False) -> Graph:
    """``keep``: the attributes that edges carry (category as kind). ``bare`` edges have no coordinates but their number, so lines are neither dealt nor stored;
    with ``ends`` they keep their first and last points (from, to)."""
    # stored, for what coordinates and attributes are made of would be worked out again in each use, and within lambdas for each vertex
    lines = stored = materialise(segments.where(F.size("coordinates") >= 2).select("id", "coordinates", "bridge_gaps", *keep))
    points = junctions(polylines.vertices(lines)).select("lng_e7", "lat_e7")
    runs = None
    if tolerance_m > 0:
        accepted = materialise(accept_bridges(bridge_candidates(lines, tolerance_m)))
        new = accepted.select(F.explode(F.array("end", "hit")).alias("p")).select("p.lng_e7", "p.lat_e7")
        points, lines, runs = points.unionByName(new).distinct(), splice(lines, accepted), connectors(accepted)
    split = split_edges(lines, points, keep)
    edges, nodes = with_nodes(split if runs is None else split.unionByName(runs.select(*split.columns)), bare, ends)
    g = Graph(materialise(edges), nodes, stored.count())
    release(stored)
    return g


def counts(g: Graph) -> DataFrame:
    """Segments, nodes, edges and connectors: what is known without components."""
    e = g.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "connector").alias("connectors"))
    return e.join(g.nodes.agg(F.count("*").alias("nodes"))).withColumn("segments", F.lit(g.segments).cast("long"))


def stats(g: Graph) -> DataFrame:
    sizes = g.components.groupBy("component").agg(F.count("*").alias("n"))
    return counts(g).join(sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest_component_nodes")))
