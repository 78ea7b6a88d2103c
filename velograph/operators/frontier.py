"""Least costs over a network of any size, tile by tile: no task ever holds more than MOST edges.

The edges are cut into tiles: square cells that are halved until each holds few enough. Most nodes lie within one tile; those that
tiles share carry labels, the least cost known so far. A round sends each tile the labels that got cheaper, finds from all of
them the least costs within the tile, and hands on what got cheaper at shared nodes. So a round crosses a whole tile, where a
frontier of single edges would cross one edge; it ends when nothing gets cheaper. Only labels of shared nodes are kept and
rewritten; each tile is stored once, as one row of arrays.

Searches for many requests run side by side, each with its own labels. A label that can't lead to a way cheaper than the best one
known (what is to come costs at least ``least`` a metre of the straight distance) is dropped.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..runtime import materialise, release
from .arcs import SHORT, Arcs

#: Edges of a tile at most; widths of tiles, from the widest; requests that a task searches for within a tile.
MOST, WIDTHS, REQUESTS = 20_000, (4_096_000, 1_024_000, 256_000, 64_000, 16_000), 200
C = F.col
_LABEL = "key string, node long, cost double, via long, tile string"


def tiled(edges: DataFrame, most: int = MOST) -> DataFrame:
    """Adds ``tile`` to edges (edge_id, f_lng, f_lat, ...). A cell of the least width that still holds too many edges is cut by their ids."""
    finest = WIDTHS[-1]
    at = edges.withColumns({"_x": F.floor(C("f_lng") / finest), "_y": F.floor(C("f_lat") / finest)})
    cells = at.groupBy("_x", "_y").agg(F.count("*").alias("n"))
    named = F.lit(None).cast("string")
    for i, width in reversed(list(enumerate(WIDTHS))):
        x, y = (F.floor(C(c) * finest / width).cast("long") for c in ("_x", "_y"))
        cells = cells.withColumn(f"n{i}", F.sum("n").over(W.partitionBy(x, y)))
        label = F.concat_ws(":", F.lit(str(i)), x.cast("string"), y.cast("string"))
        named = label if i == len(WIDTHS) - 1 else F.when(C(f"n{i}") <= most, label).otherwise(named)
    cells = cells.select("_x", "_y", named.alias("tile"), F.ceil(C(f"n{len(WIDTHS) - 1}") / most).cast("int").alias("_parts"))
    part = F.when(C("_parts") > 1, F.concat(F.lit("/"), F.pmod(F.xxhash64("edge_id"), "_parts").cast("string"))).otherwise("")
    return at.join(cells, ["_x", "_y"]).withColumn("tile", F.concat("tile", part)).drop("_x", "_y", "_parts")


class Tiles:
    """A network's tiles as stored rows of arrays, and which nodes they share."""

    def __init__(self, edges: DataFrame, most: int = MOST, keep: list[str] | None = None):
        """``edges``: edge_id, from_node, to_node, f_lng, f_lat, t_lng, t_lat, length_m, ways and what a price is made of, all numbers.
        With ``keep`` rows hold these columns only."""
        cut = materialise(tiled(edges, most).select("tile", *(keep or edges.columns)))
        ends = cut.select("tile", F.explode(F.array("from_node", "to_node")).alias("node")).groupBy("node").agg(F.collect_set("tile").alias("tiles"))
        self.places = materialise(ends.select("node", F.explode("tiles").alias("tile"), (F.size("tiles") > 1).alias("shared")))
        self.shared = materialise(self.places.where("shared").select("node", "tile"))
        marks = self.places.where("shared").groupBy("tile").agg(F.collect_list("node").alias("shared"))
        columns = self.columns = [c for c in cut.columns if c != "tile"]
        kinds = dict(cut.dtypes)
        schema = "tile string, " + ", ".join(f"{c} array<{kinds[c]}>" for c in columns)

        def packed(table: pa.Table) -> pa.Table:
            lists = [pa.array([table[c].combine_chunks()], pa.list_(table[c].type)) for c in columns]
            return pa.Table.from_arrays([table["tile"][:1].combine_chunks(), *lists], ["tile", *columns])

        rows = cut.select("tile", *columns).groupBy("tile").applyInArrow(packed, schema)
        self.rows = materialise(rows.join(marks, "tile", "left"))
        release(cut)

    def release(self) -> None:
        release(self.places, self.shared, self.rows)


class Tile(Arcs):
    """One tile's arcs; nodes by their own numbers outside, by their places in ``names`` inside."""

    def __init__(self, row: pa.Table, columns: list[str], one_way: bool):
        self.table = pd.DataFrame({c: row[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in columns})
        super().__init__(self.table, one_way)
        self.local = {n: i for i, n in enumerate(self.names.tolist())}
        shared = row["shared"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if row["shared"].null_count == 0 else []
        self.shared = [self.local[n] for n in shared]

    def spread(self, price: list[float], starts: dict[int, float], bound: float = math.inf, ahead=None):
        return spread(self.offset, self.head, price, starts, bound, ahead)


def spread(offset: list[int], head: list[int], price: list[float], starts: dict[int, float], bound: float = math.inf, ahead=None):
    """(cost, via) of the nodes reached: least cost and the start that it comes from."""
    best, via, done = dict(starts), {n: n for n in starts}, set()
    heap = [(c, n) for n, c in starts.items()]
    heapq.heapify(heap)
    while heap:
        c, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        if ahead is not None and c + ahead(node) > bound:
            continue
        for i in range(offset[node], offset[node + 1]):
            other, reach = head[i], c + price[i]
            if reach < best.get(other, math.inf):
                best[other], via[other] = reach, via[node]
                heapq.heappush(heap, (reach, other))
    return best, via


def _bridged(left: DataFrame, right: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def reach(edges: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """(node, cost): least cost from any of ``sources`` (node) to every node that can be reached over edges of ``price``."""
    # costs need nothing but the ends and the price
    tiles = Tiles(edges, most, ["from_node", "to_node", "price"])
    places = tiles.places

    def relaxed(everything: bool):
        def run(fresh: pa.Table, row: pa.Table) -> pa.Table:
            if not len(fresh) or not len(row):
                return pa.table({"node": pa.array([], pa.int64()), "cost": pa.array([], pa.float64())})
            flat = lambda c: row[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            names, node = np.unique(np.concatenate([flat("from_node"), flat("to_node")]), return_inverse=True)
            frm, to = np.split(node, 2)
            tail = np.concatenate([frm, to])
            order = np.argsort(tail, kind="stable")
            offset = np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=len(names)))]).tolist()
            local = lambda column: np.searchsorted(names, column.combine_chunks().to_numpy(zero_copy_only=False)).tolist()
            begin = dict(zip(local(fresh["node"]), fresh["cost"].to_pylist(), strict=True))
            best, _ = spread(offset, np.concatenate([to, frm])[order].tolist(), np.tile(flat("price"), 2)[order].tolist(), begin)
            shared = np.searchsorted(names, flat("shared")).tolist() if not everything and row["shared"].null_count == 0 else []
            out = [(n, best[n]) for n in (best if everything else shared) if n in best]
            nodes, costs = np.array([n for n, _ in out], np.int64), np.array([c for _, c in out], np.float64)
            return pa.table({"node": pa.array(names[nodes] if len(nodes) else nodes, pa.int64()), "cost": pa.array(costs)})

        return run

    started = materialise(sources.select("node", F.lit(0.0).alias("cost")).distinct())
    known = materialise(started.join(tiles.shared.select("node").distinct(), "node", "left_semi"))
    fresh = started.join(places.select("node", "tile"), "node")
    while True:
        offers = _bridged(fresh.select("tile", "node", "cost"), tiles.rows, ["tile"], relaxed(False), "node long, cost double").groupBy("node").agg(F.min("cost").alias("offer"))
        better = materialise(offers.join(known, "node", "left").where("cost IS NULL OR offer < cost").select("node", C("offer").alias("cost")))
        if better.isEmpty():
            break
        old, known = known, materialise(known.join(better.select("node"), "node", "left_anti").unionByName(better))
        release(old)
        fresh = better.join(tiles.shared, "node")
    # what lies within the tiles comes from all labels at once
    all_ = started.unionByName(known).groupBy("node").agg(F.min("cost").alias("cost")).join(places.select("node", "tile"), "node")
    return _bridged(all_.select("tile", "node", "cost"), tiles.rows, ["tile"], relaxed(True), "node long, cost double").groupBy("node").agg(F.min("cost").alias("cost"))


def _ends(price: Column, one_way: bool) -> dict[str, Column]:
    """Where a request can leave its first edge and enter its last: arrays of (node, cost, at), of asks joined with both edges."""
    none = F.array().cast("array<struct<node:long,cost:double,at:double>>")
    onward = (C("ways") != 2) if one_way else F.lit(True)
    back = (C("ways") != 1) if one_way else F.lit(True)
    per = F.when(C("length_m") > 0, price / F.when(C("length_m") > 0, C("length_m"))).otherwise(0.0)

    def choices(along: Column, to_from: Column, to_to: Column) -> Column:
        end = lambda node, at: F.array(F.struct(C(node).alias("node"), (F.abs(at - along) * per).alias("cost"), at.alias("at")))
        zero, whole = F.lit(0.0), C("length_m")
        return F.concat(F.when(to_from | (along == zero), end("from_node", zero)).otherwise(none), F.when(to_to | (along == whole), end("to_node", whole)).otherwise(none))

    return {"start": choices(C("along"), back, onward), "goal": choices(C("along"), onward, back), "per": per, "onward": onward, "back": back}


def priced(factors: list[tuple[list[float], list[float]]]) -> Column:
    """An edge's price by the preference ``pref``."""
    pick = lambda which: F.element_at(F.element_at(F.array(*(F.array(*map(F.lit, f[which])) for f in factors)), C("pref") + 1), C("kind" if which == 0 else "surface") + 1)
    return C("length_m") * pick(0) * C("risk") * pick(1)


def along(edges: DataFrame, asks: DataFrame, factors: list[tuple[list[float], list[float]]], leasts: list[float], one_way: bool) -> DataFrame:
    """(request_id, cost, edges) of asks from and to one edge whose way along it is surely the best. Any other leaves the edge by one
    end and comes back by the other, and costs at least ``least`` a metre of the straight distance between these."""
    e = _ends(priced(factors), one_way)
    at = asks.where("s_edge = e_edge").select("request_id", "pref", C("s_edge").alias("edge_id"), "s_along", "e_along").join(edges, "edge_id")
    may = (C("s_along") == C("e_along")) | F.when(C("e_along") > C("s_along"), e["onward"]).otherwise(e["back"])
    ky = geo.SPHERE_DEGREE_M * SHORT / geo.FIXED
    kx = F.cos(F.radians(F.least(F.lit(89.0), F.greatest(*(F.abs(geo.degrees(C(f"{s}_lat"))) for s in "ft")))))
    least = F.element_at(F.array(*map(F.lit, leasts)), C("pref") + 1)
    outer = (C("length_m") - F.abs(C("e_along") - C("s_along"))) * e["per"] + F.hypot((C("f_lng") - C("t_lng")) * kx, (C("f_lat") - C("t_lat")).cast("double")) * ky * least
    direct = F.abs(C("e_along") - C("s_along")) * e["per"]
    part = F.array(F.struct("edge_id", C("s_along").alias("from_m"), C("e_along").alias("to_m")))
    return at.where(may & (direct <= outer)).select("request_id", direct.alias("cost"), part.alias("edges"))


def cheapest(edges: DataFrame, asks: DataFrame, factors: list[tuple[list[float], list[float]]], leasts: list[float], one_way: bool = False, most: int = MOST) -> DataFrame:
    """(request_id, cost, edges) of the cheapest routes of asks (request_id, pref, s_edge, s_along, e_edge, e_along, e_lng, e_lat, limit),
    where there is one; ``limit`` is a cost that some way is known to have, or null. ``edges``: as for ``Tiles``, with kind, surface (indices into a preference's factors) and risk.
    """
    tiles = Tiles(edges, most)
    columns = tiles.columns
    price = priced(factors)
    slim = edges.select("edge_id", "from_node", "to_node", "length_m", "ways", "kind", "surface", "risk")
    at = lambda p: asks.select("request_id", "pref", C(f"{p}_edge").alias("edge_id"), C(f"{p}_along").alias("along")).join(slim, "edge_id")
    e = _ends(price, one_way)
    starts = at("s").select("request_id", e["start"].alias("starts"), C("from_node").alias("_f"))
    goals = at("e").select("request_id", e["goal"].alias("goals"))
    same = asks.where("s_edge = e_edge").select("request_id", "pref", C("s_edge").alias("edge_id"), "s_along", "e_along").join(slim, "edge_id")
    may = (C("s_along") == C("e_along")) | F.when(C("e_along") > C("s_along"), e["onward"]).otherwise(e["back"])
    direct = same.where(may).select("request_id", (F.abs(C("e_along") - C("s_along")) * e["per"]).alias("direct"))
    asked = materialise(asks.join(starts.drop("_f"), "request_id").join(goals, "request_id").join(direct, "request_id", "left").select(C("request_id").alias("key"), "pref", "s_edge", "s_along", "e_edge", "e_along", "e_lng", "e_lat", "starts", "goals", "direct", F.least("direct", C("limit") * (1 + 1e-9) + 1e-6).alias("bound")))

    def relaxed(fresh: pa.Table, row: pa.Table) -> pa.Table:
        out = {n: [] for n in ("key", "node", "cost", "via", "tile")}
        if len(fresh) and len(row):
            tile, name = Tile(row, columns, one_way), row["tile"][0].as_py()
            wanted, prices = {}, {}
            for r in fresh.to_pylist():
                wanted.setdefault(r["key"], (r, {}))[1][tile.local[r["node"]]] = r["cost"]
            for key, (r, begin) in wanted.items():
                if r["pref"] not in prices:
                    prices[r["pref"]] = _prices(tile, factors[r["pref"]])
                ahead = _ahead(tile, r["e_lng"], r["e_lat"], leasts[r["pref"]])
                bound = math.inf if r["bound"] is None else r["bound"]
                best, via = tile.spread(prices[r["pref"]], begin, bound, ahead)
                mine = {tile.local[g["node"]] for g in r["goals"] if g["node"] in tile.local}
                for n in [*tile.shared, *(mine - set(tile.shared))]:
                    if n in best and via[n] != n and best[n] + ahead(n) <= bound:
                        for c, v in zip(out, (key, int(tile.names[n]), best[n], int(tile.names[via[n]]), name), strict=True):
                            out[c].append(v)
        return pa.table(out, pa.schema([("key", pa.string()), ("node", pa.int64()), ("cost", pa.float64()), ("via", pa.int64()), ("tile", pa.string())]))

    first = asked.select("key", F.explode("starts").alias("s")).groupBy("key", C("s.node").alias("node")).agg(F.min("s.cost").alias("cost"))
    known = materialise(first.select("key", "node", "cost", F.lit(None).cast("long").alias("via"), F.lit(None).cast("string").alias("tile")))
    bound = materialise(asked.select("key", "bound"))
    goal = materialise(asked.select("key", F.explode("goals").alias("g")).groupBy("key", C("g.node").alias("node")).agg(F.min("g.cost").alias("more")))
    fresh, place = known, tiles.places
    while not fresh.isEmpty():
        # the best way so far: what is known at a goal and what is to come from there
        ways = fresh.join(goal, ["key", "node"]).groupBy("key").agg(F.min(C("cost") + C("more")).alias("new"))
        old, bound = bound, materialise(bound.join(ways, "key", "left").select("key", F.least("bound", "new").alias("bound")))
        release(old)
        sent = fresh.select("key", "node", "cost").join(place.select("node", "tile"), "node").join(asked.select("key", "pref", "e_lng", "e_lat", "goals"), "key").join(bound, "key")
        sent = materialise(sent)
        crowd = sent.groupBy("tile").agg(F.ceil(F.count_distinct("key") / REQUESTS).cast("int").alias("salts"))
        dealt = sent.join(crowd, "tile").withColumn("salt", F.pmod(F.xxhash64("key"), "salts").cast("int")).drop("salts")
        held = tiles.rows.join(crowd.withColumn("salt", F.explode(F.sequence(F.lit(0), C("salts") - 1))).drop("salts"), "tile")
        offers = _bridged(dealt, held, ["tile", "salt"], relaxed, _LABEL).groupBy("key", "node").agg(F.min(F.struct("cost", "via", "tile")).alias("o"))
        better = materialise(offers.join(known.select("key", "node", C("cost").alias("had")), ["key", "node"], "left").where("had IS NULL OR o.cost < had").select("key", "node", "o.cost", "o.via", "o.tile"))
        old, known = known, materialise(known.join(better.select("key", "node"), ["key", "node"], "left_anti").unionByName(better))
        release(sent, old)
        fresh, place = better, tiles.shared
    return _unpacked(tiles, asked, known, goal, factors, one_way)


def _prices(tile: Tile, factors: tuple[list[float], list[float]]) -> list[float]:
    t = tile.table
    price = t["length_m"].to_numpy() * np.array(factors[0])[t["kind"].to_numpy()] * t["risk"].to_numpy() * np.array(factors[1])[t["surface"].to_numpy()]
    return price[tile.edge].tolist() if len(tile.edge) else []


def _ahead(tile: Tile, lng: float, lat: float, least: float):
    """A bound that the cost from a node to a place doesn't fall below."""
    ky = geo.SPHERE_DEGREE_M * SHORT * least
    kx = ky * math.cos(math.radians(min(89.0, max(abs(lat), float(np.abs(tile.lat).max())))))
    return lambda n: math.hypot((tile.lng[n] - lng) * kx, (tile.lat[n] - lat) * ky)


def _unpacked(tiles: Tiles, asked: DataFrame, known: DataFrame, goal: DataFrame, factors, one_way: bool) -> DataFrame:
    """Routes of the labels: from the best goal back to the start, tile by tile, and then the edges within each tile."""
    ends = known.join(goal, ["key", "node"]).groupBy("key").agg(F.min(F.struct((C("cost") + C("more")).alias("cost"), "node")).alias("best")).select("key", "best.cost", "best.node")
    best = asked.join(ends, "key", "left").where("cost IS NOT NULL OR direct IS NOT NULL")
    best = materialise(best.withColumn("straight", F.coalesce(C("direct") <= C("cost"), C("direct").isNotNull())))
    steps = None
    at = best.where("NOT straight").select("key", "node", F.lit(0).alias("seq"))
    heads = None
    # a step back for all routes at once, as many as the tiles that the longest one crosses
    while True:
        here = materialise(at.join(known.select("key", "node", "via", "tile"), ["key", "node"]))
        done = here.where("via IS NULL").select("key", C("node").alias("first"))
        heads = done if heads is None else heads.unionByName(done)
        back = here.where("via IS NOT NULL").select("key", "seq", "tile", C("via").alias("a"), C("node").alias("b"))
        if back.isEmpty():
            break
        steps = back if steps is None else steps.unionByName(back)
        at = back.select("key", C("a").alias("node"), (C("seq") - 1).alias("seq"))
    part = "array<struct<edge_id:long,from_m:double,to_m:double>>"
    kinds = pa.schema([("key", pa.string()), ("seq", pa.int32()), ("edges", pa.list_(pa.struct([("edge_id", pa.int64()), ("from_m", pa.float64()), ("to_m", pa.float64())])))])
    columns = tiles.columns

    def walked(asks: pa.Table, row: pa.Table) -> pa.Table:
        out = {"key": [], "seq": [], "edges": []}
        if len(asks) and len(row):
            tile, prices = Tile(row, columns, one_way), {}
            for r in asks.to_pylist():
                if r["pref"] not in prices:
                    prices[r["pref"]] = _prices(tile, factors[r["pref"]])
                a, b = tile.local[r["a"]], tile.local[r["b"]]
                _, _, path, _ = tile.cheapest(prices[r["pref"]], 0.0, {a: 0.0}, {b: 0.0}, (0.0, 0.0))
                edges = []
                for x, before in path:
                    ahead = tile.frm[x] == before and tile.onward[x]
                    edges.append({"edge_id": int(tile.ids[x]), "from_m": 0.0 if ahead else float(tile.length[x]), "to_m": float(tile.length[x]) if ahead else 0.0})
                for c, v in zip(out, (r["key"], r["seq"], edges), strict=True):
                    out[c].append(v)
        return pa.table(out, kinds)

    chosen = lambda side, node: F.array_min(F.filter(F.transform(side, lambda s: F.struct(s["cost"].alias("cost"), s["node"].alias("node"), s["at"].alias("at"))), lambda s: s["node"] == C(node)))["at"]
    one = lambda edge, a, b: F.array(F.struct(C(edge).alias("edge_id"), a.alias("from_m"), b.alias("to_m")))
    straight = best.where("straight").select("key", C("direct").alias("cost"), one("s_edge", C("s_along"), C("e_along")).alias("edges"))
    found = best.where("NOT straight").join(heads, "key")
    inner = F.array().cast(part)
    if steps is not None:
        each = _bridged(steps.join(best.select("key", "pref"), "key"), tiles.rows, ["tile"], walked, f"key string, seq int, edges {part}")
        joined = each.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "edges"))), lambda s: s["edges"])).alias("inner"))
        found, inner = found.join(joined, "key", "left"), F.coalesce("inner", inner)
    whole = F.concat(one("s_edge", C("s_along"), chosen("starts", "first")), inner, one("e_edge", chosen("goals", "node"), C("e_along")))
    routed = found.select("key", "cost", whole.alias("edges")).unionByName(straight)
    return routed.select(C("key").alias("request_id"), "cost", F.filter("edges", lambda p: p["from_m"] != p["to_m"]).alias("edges"))
