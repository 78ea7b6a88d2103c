"""Least-cost search for many requests at once, in windows of the network.

A request is searched for within a window of four tiles that hold its ends and what lies around them, of which a task has the
edges as arrays. What it finds is the best route of all if the search went through no node beyond the window: a better way would
leave the window's edges at such a node, and the search goes through every node that a better way can begin with. Other
requests, and those that are too long for a window, are searched for in tiles four times as wide, and so on. Where a window holds
more than MOST edges, its requests go through the network tile by tile instead (``frontier``); so no task ever holds more than
that. A window of very many requests is dealt to several tasks. Ways along one edge are often known to be the best unseen.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.exprs import lookup
from ..runtime import materialise, release
from . import frontier
from .arcs import Arcs

#: Width of the first tiles (about 5 km); how much wider each round's are; requests that one task searches for.
TILE_E7, WIDER, REQUESTS = 500_000, 4, 1000
#: Edges of a window beyond which its requests are searched for tile by tile.
MOST = 150_000
#: Room that a window leaves around a request's ends, to begin with: a share of their distance apart, and a little more.
ROOM, ROOM_E7 = 0.6, 5_000
FOUND = "request_id string, settled boolean, cost double, edges array<struct<edge_id:long,from_m:double,to_m:double>>"


def _searched(tables: list[Mapping], leasts: list[float], size: int, whole: bool, one_way: bool):
    kinds, surfaces = (sorted(tables[0][n]) for n in ("kind", "surface"))
    factors = [[np.array([t[n][x] for x in names]) for n, names in (("kind", kinds), ("surface", surfaces))] for t in tables]

    def run(key: tuple, asks: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if not len(asks):
            return pd.DataFrame(columns=["request_id", "settled", "cost", "edges"])
        arcs = Arcs(edges, one_way)
        kind, surface = edges["kind"].to_numpy(), edges["surface"].to_numpy()
        prices, lists = {}, {}
        arcs.enclose(*(k * size / geo.FIXED for k in (key[0], key[1], key[0] + 2, key[1] + 2)))
        rows = []
        for r in asks.itertuples():
            if r.pref not in prices:
                k, s = factors[r.pref]
                price = arcs.length * k[kind] * edges["risk"].to_numpy() * s[surface]
                prices[r.pref], lists[r.pref] = price, price[arcs.edge].tolist() if len(arcs.edge) else []
            s, e = arcs.place.get(r.s_edge), arcs.place.get(r.e_edge)
            got = None
            if s is not None and e is not None:
                got = arcs.route(prices[r.pref], lists[r.pref], leasts[r.pref], s, r.s_along, e, r.e_along, (r.e_lng, r.e_lat))
            sure = whole or (s is not None and e is not None and not arcs.left)
            rows.append((r.request_id, sure, None if got is None else float(got[0]), [] if got is None else got[1]))
        return pd.DataFrame(rows, columns=["request_id", "settled", "cost", "edges"])

    return run


def end_places() -> list[Column]:
    """Places of an edge's first and last point, of its line."""
    return [p[c].alias(f"{n}_{c[:3]}") for n, p in (("f", F.col("coordinates")[0]), ("t", F.element_at("coordinates", -1))) for c in ("lng_e7", "lat_e7")]


def cheapest(edges: DataFrame, asks: DataFrame, tables: list[Mapping], leasts: list[float], one_way: bool = False, tile_e7: int | None = None, most: int | None = None, tile_edges: int | None = None) -> DataFrame:
    """(request_id, cost, edges) of the cheapest routes; requests without any route are left out.

    ``asks``: request_id, pref (which of ``tables``), s_edge, s_along, s_lng, s_lat and the same for e; places in degrees.
    """
    one = F.lit(1.0)
    hazard = tables[0]["hazard"]
    risk = F.aggregate("hazards", one, lambda a, h: a * F.coalesce(lookup(h, hazard).cast("double"), one)) if hazard else one
    number = {n: {x: i for i, x in enumerate(sorted(tables[0][n]))} for n in ("kind", "surface")}
    ways = F.when(F.col("direction") == "both", 0).when(F.col("direction") == "forward", 1).otherwise(2)
    slim = edges.select("edge_id", "from_node", "to_node", "length_m", lookup(F.col("kind"), number["kind"]).cast("int").alias("kind"), lookup(F.col("surface_class"), number["surface"]).cast("int").alias("surface"), risk.alias("risk"), ways.alias("ways"), *end_places())
    slim = materialise(slim)
    extent = edges.agg(*(f(g(f"coordinates.{c}")).alias(f"{n}_{c}") for c in ("lng_e7", "lat_e7") for f, g, n in ((F.min, F.array_min, "lo"), (F.max, F.array_max, "hi")))).first()
    factors = [tuple([t[n][x] for x in sorted(t[n])] for n in ("kind", "surface")) for t in tables]
    most = MOST if most is None else most
    done = materialise(frontier.along(slim, asks, factors, leasts, one_way))
    # how wide a window must be for a request, and where it begins
    pending = asks.join(done.select("request_id"), "request_id", "left_anti").withColumn("limit", F.lit(None).cast("double"))
    apart = F.greatest(*(F.abs(F.col(f"s_{c}") - F.col(f"e_{c}")) for c in ("lng", "lat"))) * geo.FIXED
    pending = materialise(pending.select("*", apart.alias("apart"), (apart * ROOM + ROOM_E7).alias("room")))
    size, far = tile_e7 or TILE_E7, None
    before = lambda v: F.sequence(F.col(v) - 1, F.col(v))
    while not pending.isEmpty():
        cell = lambda v, s=size: F.floor(v / s).cast("long")
        ends = {c: [extent[f"{n}_{c}"] // size for n in ("lo", "hi")] if extent["lo_lng_e7"] is not None else [0, 0] for c in ("lng_e7", "lat_e7")}
        whole = all(hi - lo <= 1 for lo, hi in ends.values())
        # a window beyond the network moves back over it, so in the end it holds all of it
        first = [F.greatest(F.lit(lo), F.least(F.lit(hi - 1), cell(F.least(f"s_{c[:3]}", f"e_{c[:3]}") * geo.FIXED - F.col("room")))) for c, (lo, hi) in ends.items()]
        fits = F.lit(whole) | (F.col("apart") + 2 * F.col("room") <= size)
        here, later = pending.where(fits).withColumns({"tx": first[0], "ty": first[1]}), pending.where(~fits)
        if not here.isEmpty():
            # edges by the tile that they begin in, and so how many a window holds
            load = slim.groupBy(cell(F.col("f_lng")).alias("tx"), cell(F.col("f_lat")).alias("ty")).agg(F.count("*").alias("n")).withColumn("tx", F.explode(before("tx"))).withColumn("ty", F.explode(before("ty")))
            heavy = load.groupBy("tx", "ty").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("tx", "ty")
            crossing = here.join(heavy, ["tx", "ty"], "left_semi").drop("tx", "ty")
            far = materialise(crossing if far is None else far.unionByName(crossing))
            here = materialise(here.join(heavy, ["tx", "ty"], "left_anti"))
            crowd = here.groupBy("tx", "ty").agg(F.ceil(F.count("*") / REQUESTS).cast("int").alias("salts"))
            dealt = here.join(crowd, ["tx", "ty"]).withColumn("salt", F.pmod(F.xxhash64("request_id"), "salts").cast("int")).drop("salts")
            places = F.array_distinct(F.array(*(F.struct(cell(F.col(f"{s}_lng")).alias("x"), cell(F.col(f"{s}_lat")).alias("y")) for s in "ft")))
            around = F.flatten(F.transform(places, lambda c: F.array(*(F.struct((c["x"] - i).alias("tx"), (c["y"] - j).alias("ty")) for i in (0, 1) for j in (0, 1)))))
            spread = slim.withColumn("t", F.explode(F.array_distinct(around))).select("t.tx", "t.ty", *slim.columns)
            part = spread.join(crowd.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"), ["tx", "ty"])
            run = _searched(tables, leasts, size, whole, one_way)
            found = materialise(dealt.groupBy("tx", "ty", "salt").cogroup(part.groupBy("tx", "ty", "salt")).applyInPandas(run, FOUND))
            done = done.unionByName(found.where("settled AND cost IS NOT NULL").select("request_id", "cost", "edges"))
            open_ = found.where("NOT settled").select("request_id", F.col("cost").alias("reached"))
            left = here.drop("tx", "ty").join(open_, "request_id").withColumns({"limit": F.least("limit", "reached"), "room": F.col("room") * WIDER}).drop("reached")
            old, pending = pending, materialise(later.unionByName(left))
            release(old, here)
        size *= WIDER
    if far is not None and not far.isEmpty():
        done = done.unionByName(materialise(frontier.cheapest(slim, far.drop("apart", "room"), factors, leasts, one_way, tile_edges or frontier.MOST)))
    return done
