"""Graph, planning, scoring and geometry on small networks laid out in metres."""

import json
import math
import os
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from velograph import catalog, runtime
from velograph.functions import geo
from velograph.operators import components, cost, frontier, graph, hulls, planning, polylines, scoring, search, serving, skew, snap, tiles
from velograph.queries import ingest as imports
from velograph.queries import routes
from velograph.sources import ingest
from velograph.sources import network as sources

FOLDER, QUERIES = "/root/testdata/sf0.001", catalog.queries()

PER_DEGREE = math.pi / 180 * geo.RADIUS_M


def e7(east, north):
    return Row(lng_e7=round((145 + east / (PER_DEGREE * math.cos(math.radians(-37.8)))) * 1e7), lat_e7=round((-37.8 + north / PER_DEGREE) * 1e7))


SCHEMA = "id long, coordinates array<struct<lng_e7:long,lat_e7:long>>, category string, name string, hazards array<string>, surface_class string, surface_inferred boolean, smoothness string, direction string, bridge_gaps boolean"


def network(spark, *lines):
    rows = []
    for i, line in enumerate(lines, 1):
        points, over = line if isinstance(line, tuple) else (line, {})
        d = {"category": "shared_use_path", "name": None, "hazards": [], "surface_class": "smooth", "surface_inferred": False, "smoothness": None, "direction": "both", "bridge_gaps": True} | over
        rows.append((i, [e7(*p) for p in points], *(d[c] for c in ("category", "name", "hazards", "surface_class", "surface_inferred", "smoothness", "direction", "bridge_gaps"))))
    return spark.createDataFrame(rows, SCHEMA)


def stats(g):
    return graph.stats(g).first().asDict()


def test_single_line(spark):
    g = graph.build(network(spark, [(0, 0), (50, 0), (100, 0)]))
    assert (stats(g)["nodes"], stats(g)["edges"]) == (2, 1)
    assert g.edges.first()["length_m"] == pytest.approx(100, abs=0.1)


def test_crossroads(spark):
    g = graph.build(network(spark, [(-100, 0), (0, 0), (100, 0)], [(0, -100), (0, 0), (0, 100)]))
    assert (stats(g)["nodes"], stats(g)["edges"]) == (5, 4)
    degrees = sorted(r["count"] for r in graph.adjacency(g.edges).groupBy("node").count().collect())
    assert degrees == [1, 1, 1, 1, 4]


def test_lines_that_only_cross_are_not_joined(spark):
    g = graph.build(network(spark, [(-100, 0), (100, 0)], [(0, -100), (0, 100)]), tolerance_m=0)
    assert (stats(g)["nodes"], stats(g)["edges"], stats(g)["components"]) == (4, 2, 2)


def test_gap_gets_one_connector(spark):
    g = graph.build(network(spark, [(0, 0), (100, 0)], [(108, 0), (200, 0)]))
    assert stats(g)["connectors"] == 1
    assert g.edges.where("kind = 'connector'").first()["length_m"] == pytest.approx(8, abs=0.1)


def test_t_junction_splits_the_line(spark):
    g = graph.build(network(spark, ([(0, 0), (200, 0)], {"category": "painted_lane"}), [(100, 5), (100, 100)]))
    assert stats(g)["connectors"] == 1
    assert sorted(r["length_m"] for r in g.edges.where("kind = 'painted_lane'").collect()) == pytest.approx([100, 100], abs=0.5)


def test_wide_gap_stays(spark):
    s = stats(graph.build(network(spark, [(0, 0), (100, 0)], [(150, 0), (250, 0)])))
    assert (s["connectors"], s["components"]) == (0, 2)


def test_degenerate_lines(spark):
    s = stats(graph.build(network(spark, [(0, 0)], [(0, 0), (0, 0), (50, 0)])))
    assert (s["segments"], s["edges"]) == (1, 1)


def plan(spark, g, start, end, **options):
    a, b = e7(*start), e7(*end)
    ask = spark.createDataFrame([(1, a.lng_e7, a.lat_e7, b.lng_e7, b.lat_e7)], "request_id long, s_lng long, s_lat long, e_lng long, e_lat long")
    return planning.plan(g, ask, **options).first()


def test_detour_is_worth_it_for_a_path_only(spark):
    g = graph.build(network(spark, ([(0, 0), (1000, 0)], {"category": "painted_lane"}), [(0, 0), (500, 300), (1000, 0)]))
    length = lambda p: sum(abs(e["to_m"] - e["from_m"]) for e in p["edges"])
    assert length(plan(spark, g, (0, 0), (1000, 0), profile="shortest")) == pytest.approx(1000, abs=1)
    assert length(plan(spark, g, (0, 0), (1000, 0))) > 1150


def test_each_request_has_its_own_preferences(spark):
    way = lambda y, **over: ([(0, 0), (500, y), (1000, 0)], over)
    g = graph.build(network(spark, way(0, category="busy_road"), way(150, surface_class="gravel"), way(1200)), tolerance_m=0)
    a, b = e7(0, 0), e7(1000, 0)
    asks = [(i, a.lng_e7, a.lat_e7, b.lng_e7, b.lat_e7, s, False, busy) for i, (s, busy) in enumerate([("any", False), ("avoid_loose", False), ("smooth_only", True), ("any", True), (None, None)])]
    ask = spark.createDataFrame(asks, "request_id long, s_lng long, s_lat long, e_lng long, e_lat long, pref_surface string, avoid_steps boolean, avoid_busy boolean")
    got = {int(r["request_id"]): r["cost"] for r in planning.plan(g, ask).collect()}
    for i, *_, s, steps, busy in asks:
        assert got[i] == pytest.approx(plan(spark, g, (0, 0), (1000, 0), surface=s or "any", avoid_steps=steps, avoid_busy=bool(busy))["cost"])
    assert len({round(c, 3) for c in got.values()}) > 1
    assert {"pref_surface", "avoid_steps", "avoid_busy"} <= set(routes._ends(spark, FOLDER).columns)


def test_far_points_and_unconnected_ends(spark):
    g = graph.build(network(spark, [(0, 0), (1000, 0)], [(-20, 60), (20, 60)]), tolerance_m=0)
    assert plan(spark, g, (0, 5000), (1000, 0))["status"] == "START_NOT_NEAR_NETWORK"
    assert plan(spark, g, (0, 0), (1000, 5000))["status"] == "END_NOT_NEAR_NETWORK"
    moved = plan(spark, g, (0, 50), (1000, 0))
    assert moved["status"] == "OK"
    assert moved["start"]["distance_m"] == pytest.approx(50, abs=0.5)


def test_search_equals_brute_force(spark):
    rng, n = np.random.default_rng(3), 5
    kinds = ["shared_use_path", "painted_lane", "quiet_street", "busy_road"]
    lines = [([(i * 100, j * 100), (i * 100 + d * 100, j * 100 + (1 - d) * 100)], {"category": kinds[(7 * i + 3 * j) % 4]}) for i in range(n) for j in range(n) for d in (0, 1)]
    g = graph.build(network(spark, *lines), tolerance_m=0)
    edges, nodes = g.edges.toPandas(), g.nodes.toPandas().set_index("node_id")
    price = [r.length_m * cost.effective("prefer_paths")["kind"][r.kind] for r in edges.itertuples()]
    best = np.full((len(nodes), len(nodes)), np.inf)
    np.fill_diagonal(best, 0)
    for r, p in zip(edges.itertuples(), price, strict=True):
        best[r.from_node, r.to_node] = best[r.to_node, r.from_node] = min(p, best[r.from_node, r.to_node])
    for k in range(len(nodes)):
        best = np.minimum(best, best[:, k, None] + best[None, k])
    picks = [tuple(rng.choice(len(nodes), 2, replace=False)) for _ in range(10)]
    at = lambda v: (int(nodes.loc[v, "lng_e7"]), int(nodes.loc[v, "lat_e7"]))
    ask = spark.createDataFrame([(i, *at(a), *at(b)) for i, (a, b) in enumerate(picks)], "request_id long, s_lng long, s_lat long, e_lng long, e_lat long")
    got = {int(r["request_id"]): r["cost"] for r in planning.plan(g, ask).collect()}
    for i, (a, b) in enumerate(picks):
        assert got[i] == pytest.approx(best[a, b], abs=1e-6)


def test_small_tiles_find_the_same_routes(spark, monkeypatch):
    """From tiles of some 60 m on: a route is only final when no way around can be cheaper."""
    rng, n = np.random.default_rng(5), 6
    kinds = ["shared_use_path", "busy_road", "steps", "quiet_street"]
    lines = [([(i * 100, j * 100), (i * 100 + d * 100, j * 100 + (1 - d) * 100)], {"category": kinds[int(rng.integers(4))]}) for i in range(n) for j in range(n) for d in (0, 1)]
    g = graph.build(network(spark, *lines), tolerance_m=0)
    asks = []
    for i in range(25):
        (a, b), (c, d) = rng.uniform(0, 600, (2, 2))
        p, q = e7(a, b), e7(c, d)
        asks.append((i, p.lng_e7, p.lat_e7, q.lng_e7, q.lat_e7))
    ask = spark.createDataFrame(asks, "request_id long, s_lng long, s_lat long, e_lng long, e_lat long")
    whole = {r["request_id"]: r["cost"] for r in planning.plan(g, ask).collect()}
    monkeypatch.setattr(search, "TILE_E7", 6000)
    monkeypatch.setattr(search, "REQUESTS", 3)
    tiled = {r["request_id"]: r["cost"] for r in planning.plan(g, ask).collect()}
    assert len(whole) == 25 and all(tiled[i] == pytest.approx(c) for i, c in whole.items())


def floyd(edges, price, n, one_way=False):
    best = np.full((n, n), np.inf)
    np.fill_diagonal(best, 0)
    for r, p in zip(edges.itertuples(), price, strict=True):
        if not one_way or r.direction != "reverse":
            best[r.from_node, r.to_node] = min(p, best[r.from_node, r.to_node])
        if not one_way or r.direction != "forward":
            best[r.to_node, r.from_node] = min(p, best[r.to_node, r.from_node])
    for k in range(n):
        best = np.minimum(best, best[:, k, None] + best[None, k])
    return best


@pytest.fixture(scope="module")
def town(spark):
    """A lattice of mixed kinds and directions, some streets missing, one of which leads nowhere."""
    rng, n = np.random.default_rng(6), 7
    kinds = ["shared_use_path", "busy_road", "steps", "quiet_street"]
    lines = [
        ([(i * 100, j * 100), (i * 100 + d * 100, j * 100 + (1 - d) * 100)], {"category": kinds[int(rng.integers(4))], "direction": ["both", "both", "forward", "reverse"][int(rng.integers(4))], "surface_class": ["smooth", "gravel"][int(rng.integers(2))]})
        for i in range(n) for j in range(n) for d in (0, 1) if rng.random() < 0.9
    ]
    g = graph.build(network(spark, *lines, [(5000, 5000), (5100, 5000)]), tolerance_m=0)
    return g, g.edges.toPandas(), g.nodes.toPandas().set_index("node_id")


@pytest.mark.parametrize("most", [6, 25, 10_000])
def test_least_costs_tile_by_tile(spark, town, most):
    g, edges, nodes = town
    price = [r.length_m * cost.effective("prefer_paths")["kind"][r.kind] for r in edges.itertuples()]
    best = floyd(edges, price, len(nodes))
    sources = [0, 40]
    asked = spark.createDataFrame([(int(s),) for s in sources] * 2, "node long")
    got = {r["node"]: r["cost"] for r in planning.reach(g.edges, asked, spark.createDataFrame(list(zip(edges["edge_id"].tolist(), price, strict=True)), "edge_id long, price double"), most).collect()}
    want = {i: c for i, c in enumerate(best[sources].min(0)) if np.isfinite(c)}
    assert got == pytest.approx(want) and len(want) < len(nodes)
    slim = g.edges.select("edge_id", "from_node", "to_node", "length_m", F.lit(0).alias("ways"), *search.end_places())
    sizes = [r["n"] for r in frontier.Tiles(slim, most).rows.selectExpr("size(edge_id) AS n").collect()]
    assert sum(sizes) == len(edges) and (max(sizes) <= most or most == 6) and max(sizes) <= 2 * most


@pytest.mark.parametrize("one_way", [False, True])
def test_routes_that_cross_many_tiles(spark, town, one_way, monkeypatch):
    """All requests go through tiles of a few edges: costs as by Floyd-Warshall, parts that hang together and add up to them."""
    g, edges, nodes = town
    rng = np.random.default_rng(9)
    picks = [tuple(int(x) for x in rng.choice(len(nodes) - 2, 2, replace=False)) for _ in range(25)]
    asks = []
    for i, (a, b) in enumerate(picks):
        asks.append((i, *(int(nodes.loc[v, c]) for v in (a, b) for c in ("lng_e7", "lat_e7")), ["any", "avoid_loose"][i % 2]))
    p, q = e7(130, 2), e7(170, -3)  # on one street, there and back
    asks += [(100, p.lng_e7, p.lat_e7, q.lng_e7, q.lat_e7, "any"), (101, q.lng_e7, q.lat_e7, p.lng_e7, p.lat_e7, "any")]
    ask = spark.createDataFrame(asks, "request_id long, s_lng long, s_lat long, e_lng long, e_lat long, pref_surface string")
    whole = {r["request_id"]: r for r in planning.plan(g, ask, one_way=one_way).collect()}
    monkeypatch.setattr(search, "MOST", 0)
    monkeypatch.setattr(frontier, "MOST", 9)
    monkeypatch.setattr(frontier, "REQUESTS", 4)
    far = {r["request_id"]: r for r in planning.plan(g, ask, one_way=one_way).collect()}
    by = edges.set_index("edge_id")
    best = {s: floyd(edges, [r.length_m * t["kind"][r.kind] * t["surface"][r.surface_class] for r in edges.itertuples()], len(nodes), one_way) for s in ("any", "avoid_loose") for t in [cost.effective("prefer_paths", s)]}
    for i, *_, s in asks:
        r = far[str(i)]
        assert (r["status"], r["cost"] is None) == (whole[str(i)]["status"], whole[str(i)]["cost"] is None)
        if r["cost"] is None:
            continue
        assert r["cost"] == pytest.approx(whole[str(i)]["cost"], abs=1e-6)
        if i < 100 and np.isfinite(best[s][picks[i]]):
            assert r["cost"] == pytest.approx(best[s][picks[i]], abs=1e-3)
        t, total, node = cost.effective("prefer_paths", s), 0.0, None
        for e in r["edges"]:
            x = by.loc[e["edge_id"]]
            total += abs(e["to_m"] - e["from_m"]) * t["kind"][x.kind] * t["surface"][x.surface_class]
            onward = e["to_m"] > e["from_m"]
            assert not one_way or x.direction in ("both", "forward" if onward else "reverse")
            start, end = (x.from_node, x.to_node) if onward else (x.to_node, x.from_node)
            assert node is None or node == start
            node = end if e["to_m"] in (0.0, x.length_m) else None
        assert total == pytest.approx(r["cost"], abs=1e-6)


def test_one_way_edges_and_ends_on_one_edge(spark):
    g = graph.build(network(spark, ([(0, 0), (1000, 0)], {"direction": "forward"}), ([(0, 0), (500, 400), (1000, 0)], {"category": "busy_road"})), tolerance_m=0)
    there, back = plan(spark, g, (100, 0), (900, 0), one_way=True), plan(spark, g, (900, 0), (100, 0), one_way=True)
    assert len(there["edges"]) == 1 and abs(there["edges"][0]["to_m"] - there["edges"][0]["from_m"]) == pytest.approx(800, abs=1)
    assert len(back["edges"]) == 3 and [e["to_m"] > e["from_m"] for e in back["edges"]] == [True, False, True]
    assert len(plan(spark, g, (900, 0), (100, 0))["edges"]) == 1


def test_answer_is_a_feature(spark):
    g = graph.build(network(spark, ([(0, 0), (100, 0), (300, 0)], {"name": "A"}), ([(300, 0), (300, 200)], {"surface_class": "gravel", "name": None})), tolerance_m=0)
    a, b = e7(50, 3), e7(300, 150)
    ask = spark.createDataFrame([(1, a.lng_e7, a.lat_e7, b.lng_e7, b.lat_e7, "avoid_loose", True, False), (2, a.lng_e7, a.lat_e7 + 10_000_000, b.lng_e7, b.lat_e7, "any", False, False)], "request_id long, s_lng long, s_lat long, e_lng long, e_lat long, pref_surface string, avoid_steps boolean, avoid_busy boolean")
    got = {r["request_id"]: r for r in planning.answers(planning.plan(g, ask), g, ask).collect()}
    assert got["2"]["status"] == "START_NOT_NEAR_NETWORK" and got["2"]["feature"] is None
    f = json.loads(got["1"]["feature"])
    points = f["geometry"]["coordinates"]
    want = [e7(50, 0), e7(100, 0), e7(300, 0), e7(300, 150)]
    assert f["type"] == "Feature" and len(points) == 4
    assert np.allclose(points, [[p.lng_e7 / 1e7, p.lat_e7 / 1e7] for p in want], atol=2e-7)
    q = f["properties"]
    assert q["distanceM"] == pytest.approx(400, abs=0.5) and q["avoidedSurfaceM"] == pytest.approx(150, abs=0.5)
    assert [(x["kind"], x.get("name")) for x in q["legs"]] == [("shared_use_path", "A"), ("shared_use_path", None)]
    assert q["distanceBySurface"] == pytest.approx({"smooth": 250, "gravel": 150}, abs=0.5)
    assert q["preferences"] == {"surface": "avoid_loose", "avoidSteps": True, "avoidBusyRoads": False} and set(q["scores"]) == {"skate", "run"}
    skate = q["scores"]["skate"]
    assert set(skate) == {"score", "rating", "confidence", "notes"} and [n["tone"] for n in skate["notes"]] == ["negative"] * (len(skate["notes"]) - 1) + ["positive"]
    points = [n["points"] for n in skate["notes"] if n["text"].endswith("loose gravel") or "walk" in n["text"] and "caps" not in n["text"]]
    assert points == sorted(points, reverse=True) and any("of loose gravel" in n["text"] for n in skate["notes"])
    # 250 of 400 m, on places that are rounded to 1e-7 degrees: just below or above a half
    assert skate["notes"][-1]["text"] in ("62% smooth asphalt or concrete", "63% smooth asphalt or concrete") and skate["notes"][-1]["metres"] == pytest.approx(250, abs=0.5)
    assert q["snap"]["start"]["distanceM"] == pytest.approx(3, abs=0.1)


STRETCH = "request_id long, island long, kind string, surface_class string, surface_inferred boolean, smoothness string, hazards array<string>, length_m double"


def test_notes_sum_to_the_shortfall(spark):
    s = spark.createDataFrame([(1, 1, "painted_lane", "smooth", False, None, ["parking"], 600.0), (1, 2, "shared_use_path", "paved", False, None, [], 400.0)], STRETCH)
    score = {r["activity"]: r["score"] for r in scoring.scores(s).collect()}
    lost = scoring.losses(s, "skate").agg({"loss": "sum"}).first()[0] / 1000 * 100
    assert score["skate"] == pytest.approx(100 - lost, abs=0.5)


def test_steps_cap_the_score(spark):
    s = spark.createDataFrame([(1, 1, "shared_use_path", "smooth", False, None, [], 5000.0), (1, 2, "steps", "smooth", False, None, [], 3.0), (1, 3, "shared_use_path", "smooth", False, None, [], 5000.0)], STRETCH)
    r = scoring.scores(s).where("activity = 'skate'").first()
    assert (r["score"], r["rating"]) == (84, "good")


def test_preferences_multiply():
    t = cost.effective("prefer_paths", "avoid_loose", True, True)
    assert t["kind"]["steps"] == 120 and t["kind"]["busy_road"] == 12 and t["surface"]["gravel"] == 17
    assert cost.avoided("avoid_loose") == ["compacted", "gravel", "unpaved"]
    with pytest.raises(ValueError):
        cost.validate({"a": 0.0})


def test_slice_and_hull(spark):
    line = [Row(lng_e7=i * 10_000_000, lat_e7=0) for i in range(3)]
    d = spark.createDataFrame([(1, line, [0.0, 10.0, 20.0], 15.0, 5.0), (2, line, [0.0, 10.0, 20.0], 10.0, 30.0)], "id long, coordinates array<struct<lng_e7:long,lat_e7:long>>, cum array<double>, from_m double, to_m double")
    got = {}
    for r in polylines.sliced(d).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append(r["lng"])
    assert got == {1: [1.5, 1, 0.5], 2: [1, 2, 2]}  # beyond the end the last point again
    hull = hulls.monotone_chain(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0]]))
    assert len(hull) == 4


def test_clip_leaves_and_enters_again():
    parts = hulls.clip_to_box(np.array([-5.0, 5, 5, 15, 15, 5]), np.array([5.0, 5, 15, 15, 5, 5]), 0, 10)
    assert [p.tolist() for p in parts] == [[[0, 5], [5, 5], [5, 10]], [[10, 5], [5, 5]]]


def fields(data):
    """(number, value) of a protobuf message."""
    def varint(i):
        n, shift = 0, 0
        while True:
            n |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return n, i

    i, out = 0, []
    while i < len(data):
        key, i = varint(i)
        n, i = varint(i)
        if key & 7 == 2:
            n, i = data[i : i + n], i + n
        out.append((key >> 3, n))
    return out


def varints(data):
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n, shift = 0, 0
    return out


def test_vector_tile_can_be_read_back():
    pdf = pd.DataFrame({"id": [7, 9], "name": ["é", None], "ok": [True, False], "parts": [[[0, 0, 10, -5], [4096, 3, 4096, 9, 1, 1]], [[2, 2, 3, 3]]]})
    ((number, layer),) = fields(tiles.encode(pdf, ["id", "name", "ok"], "id"))
    assert number == 3
    got = fields(layer)
    keys, values = [v.decode() for n, v in got if n == 3], [fields(v)[0] for n, v in got if n == 4]
    assert (15, 2) in got and (1, b"paths") in got and (5, 4096) in got and keys == ["id", "name", "ok"]
    lines, tags = [], []
    for f in (fields(v) for n, v in got if n == 2):
        f = dict(f)
        assert f[3] == 2
        t = varints(f[2])
        tags.append({keys[k]: values[v] for k, v in zip(t[::2], t[1::2], strict=True)})
        x = y = 0
        parts, ops, i = [], varints(f[4]), 0
        while i < len(ops):
            op, count, i = ops[i] & 7, ops[i] >> 3, i + 1
            if op == 1:
                parts.append([])
            for _ in range(count):
                dx, dy = ((n >> 1) ^ -(n & 1) for n in ops[i : i + 2])
                x, y, i = x + dx, y + dy, i + 2
                parts[-1] += [x, y]
        lines.append((f[1], parts))
    assert lines == [(7, [[0, 0, 10, -5], [4096, 3, 4096, 9, 1, 1]]), (9, [[2, 2, 3, 3]])]
    assert tags == [{"id": (6, 14), "name": (1, "é".encode()), "ok": (7, 1)}, {"id": (6, 18), "ok": (7, 0)}]


def test_overview_is_simplified_and_merged(spark):
    side = geo.WORLD_M / 2**10
    pixel, left, top = side / 512, 900 * side - geo.WORLD_M / 2, geo.WORLD_M / 2 - 600 * side
    line = lambda *p: [Row(x=left + x * pixel, y=top - y * pixel) for x, y in p]
    rows = [(10, 900, 600, "trail", line((0, 0), (10, 0.4), (20, 0))), (10, 900, 600, "trail", line((0, 100), (10, 105), (20, 100))), (10, 900, 600, "road", line((-50, 10), (-40, 10))), (10, 900, 600, "road", line((3, 3), (3.01, 3.01)))]
    d = spark.createDataFrame(rows, "z int, tx long, ty long, category string, xy array<struct<x:double,y:double>>")
    got = tiles.merged(tiles.in_units(d, simplify=True), "category").collect()
    assert [(r["category"], r["parts"]) for r in got] == [("trail", [[0, 0, 160, 0], [0, 800, 80, 840, 160, 800]])]
    made = tiles.tiles(tiles.merged(tiles.in_units(d, simplify=True), "category"))
    wanted = spark.createDataFrame([(10, 900, 600), (10, 0, 0)], "z int, tx long, ty long")
    assert {r["tx"]: (r["status"], r["mvt"] is None) for r in tiles.asked(made, wanted).collect()} == {900: (200, False), 0: (204, True)}


def test_wkb_and_metadata(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(ingest.encode_wkb([(1.5, 2.5), (3, 4)], little)),) for little in (True, False)], "wkb binary")
    assert {tuple((p["lng"], p["lat"]) for p in r["coordinates"]) for r in ingest.wkb_lines(df).collect()} == {((1.5, 2.5), (3.0, 4.0))}
    path = str(tmp_path / "m.json")
    assert ingest.read_metadata(path) is None
    ingest.write_metadata(path, {"a": 1})
    assert ingest.read_metadata(path) == {"a": 1}


def test_replace_by_source_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "paths")
    a, b = spark.createDataFrame([(1, "osm"), (2, "vic_dtp_bin")], "id long, source string"), spark.createDataFrame([(3, "osm")], "id long, source string")
    ingest.write_by_source(a, path)
    for _ in range(2):
        ingest.write_by_source(b, path)
        assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 3]


def test_geojson_skips_and_counts(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"OsmID":"7","Extra":"kept"},"geometry":{"type":"LineString","coordinates":[[145.0,-37.8,12.0],[145.1,-37.8]]}},{"type":"Feature","properties":null,"geometry":null},{"type":"Feature","properties":{},"geometry":{"type":"MultiLineString","coordinates":[[[145,-37],[146,-37]],[[145,-38]]]}}]}')
    f = ingest.read_geojson(spark, str(tmp_path / "x.json"))
    assert sorted(r["valid"] for r in f.collect()) == [False, True, True]
    assert f.where("valid").select("properties").collect()[0]["properties"]["Extra"] == "kept"
    parts = polylines.explode_parts(ingest.to_records(f.where("valid"))).collect()
    assert len(parts) == 2


def brute_clusters(ids, lng, lat, within_m=3000.0):
    x, y = np.radians(lng / 1e7), np.radians(lat / 1e7)
    h = np.sin((y[:, None] - y) / 2) ** 2 + np.cos(y[:, None]) * np.cos(y) * np.sin((x[:, None] - x) / 2) ** 2
    near = 2 * geo.RADIUS_M * np.arcsin(np.sqrt(h)) <= within_m
    label = np.asarray(ids)
    while True:
        least = np.where(near, label, np.iinfo(np.int64).max).min(1)
        if (least == label).all():
            return label
        label = least


def test_coverage_takes_all_points(spark):
    p = sources.points(spark, FOLDER).toPandas()
    lng, lat = (p["lng_e7"] + p["id"] % 23 * 2_000_000).to_numpy(), (p["lat_e7"] + p["id"] % 7 * 3_000_000).to_numpy()
    label = brute_clusters(p["id"].to_numpy(), lng, lat)
    want = {(c, lng[label == c].min(), lng[label == c].max(), lat[label == c].min(), lat[label == c].max()) for c in np.unique(label)}
    hull = QUERIES["coverage_areas"](spark, FOLDER).toPandas().groupby("cluster").agg({"lng_e7": ["min", "max"], "lat_e7": ["min", "max"]})
    assert {(i, *r) for i, *r in hull.itertuples()} == want
    assert dict(map(tuple, QUERIES["cluster_dbscan"](spark, FOLDER).collect())) == dict(zip(p["id"], label, strict=True))


def test_blocks_keep_all_segments(spark):
    s = stats(graph.build(routes._blocks(spark, FOLDER), tolerance_m=0))
    assert s["segments"] == sources.paths(spark, FOLDER).count() and s["components"] > 10
    links = sources.paths(spark, FOLDER).where("dir < 2").selectExpr("explode(array(k, IF(dir = 0, k + 1, k + 100))) AS n")
    assert QUERIES["components_all"](spark, FOLDER).count() == links.distinct().count()


def test_edges_and_ways_by_whole_tables(spark):
    n = graph.build(sources.segments(sources.paths(spark, FOLDER)), tolerance_m=0).edges.count()
    wanted = spark.read.parquet(f"{FOLDER}/customer.parquet").where(f"c_custkey < {n}").count()
    assert QUERIES["get_edge"](spark, FOLDER).count() == wanted and QUERIES["get_edge_all"](spark, FOLDER).count() == n
    official = sources.paths(spark, FOLDER).where("dir = 1").count()
    assert 0 < QUERIES["anti_join_coverage_all"](spark, FOLDER).count() < official


@pytest.mark.parametrize("mercator", [False, True])
@pytest.mark.parametrize("compared", [8, -100_000])
def test_dense_cells_cluster_without_all_pairs(spark, compared, mercator, monkeypatch):
    """Cells of thousands of points just within and just beyond the distance; parts are halved down to single points if need be."""
    monkeypatch.setattr(serving, "COMPARED", compared)
    rng = np.random.default_rng(14)
    heap = lambda lng, lat, n=1500: np.stack([lng + rng.integers(0, 900, n), lat + rng.integers(0, 900, n)], 1)
    metre = 1e7 / PER_DEGREE
    at = lambda east, north=0.0: (round(1_450_000_000 + east * metre / math.cos(math.radians(37.8))), round(-378_000_000 + north * metre))
    points = np.concatenate([heap(*at(0)), heap(*at(3005)), heap(*at(9000)), heap(*at(12_030)), heap(*at(0, 9000), 1), heap(*at(2999, 9000), 1), heap(*at(0, 9000), 1)])
    d = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(points)], "id long, lng_e7 long, lat_e7 long").repartition(4)
    got = dict(map(tuple, serving.clusters(d, 3000.0, mercator).collect()))
    x, y = points[:, 0], points[:, 1]
    if mercator:
        mx = np.floor(geo.MERCATOR_R * np.radians(x / 1e7) * 1000 + 0.5)
        my = np.floor(geo.MERCATOR_R * np.log(np.tan(np.pi / 4 + np.radians(y / 1e7) / 2)) * 1000 + 0.5)
        near = np.hypot(mx[:, None] - mx, my[:, None] - my) <= 3_000_000
        label = np.arange(len(points))
        while ((least := np.where(near, label, len(points)).min(1)) != label).any():
            label = least
    else:
        label = brute_clusters(np.arange(len(points)), x, y)
    assert got == dict(enumerate(label.tolist())) and len(set(got.values())) >= 3


def test_hot_keys_are_dealt(spark):
    """Half of the rows under one key, nulls, keys without partner: the same rows as a plain join, in several tasks."""
    rows = spark.range(2000).selectExpr("IF(id % 2 = 0, 7, IF(id % 10 = 1, NULL, id % 40)) AS k", "id AS v")
    counted = rows.groupBy("k").count().selectExpr("k", "count AS places", "k * 10 AS more").where("k IS NOT NULL AND k <> 11")
    plain = lambda how: sorted(map(str, rows.join(counted, "k", how).select("k", "v", "more").collect()))
    for how in ("inner", "left"):
        assert sorted(map(str, skew.salted_join(rows, counted, ["k"], ["v"], 2000, how=how).select("k", "v", "more").collect())) == plain(how)
    some = skew.salted_join(rows, counted, ["k"], ["v"], 2000, only=F.col("k") > 7).select("k", "v", "more").collect()
    assert sorted(map(str, some)) == sorted(map(str, rows.join(counted.where("k > 7"), "k").select("k", "v", "more").collect()))


@pytest.mark.parametrize("near", [False, True])
def test_components_of_a_hub_and_a_chain(spark, near):
    edges = [(1000 + i, 5) for i in range(500)] + [(i, i + 1) for i in range(2000, 2060)] + [(9, 9)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), near=near).collect()}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), near=near).count() == 0
    assert got == {5: 5, **{1000 + i: 5 for i in range(500)}, **{i: 2000 for i in range(2000, 2061)}}


def test_forests_keep_components():
    rng = np.random.default_rng(51)
    for n, m in ((1, 0), (2, 1), (50, 30), (300, 250), (300, 900)):
        u, v = rng.integers(0, n, (2, m)) * 7
        label = {int(x): int(x) for x in np.concatenate([u, v])}
        for _ in range(n):
            for p, q in zip(u.tolist(), v.tolist(), strict=True):
                label[p] = label[q] = min(label[p], label[q])
        nodes, roots = components.forest(u, v)
        assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {k: c for k, c in label.items() if k != c}


def test_shared_folder_must_be_named_on_a_cluster():
    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))
    assert runtime.shared_folder(session("local[4]", None)) == runtime.LOCAL_CHECKPOINTS
    assert runtime.shared_folder(session("spark://host:7077", "hdfs:///c")) == "hdfs:///c"
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            runtime.shared_folder(session(master, None))


def test_materialised_tables_go_with_their_scratch(spark):
    with runtime.scratch():
        t = runtime.materialise(spark.range(5))
        assert t.count() == 5
    assert not os.path.exists(t._table)


def test_json_batches_stay_small(spark):
    e = spark.range(1_100_000).selectExpr("id AS event_id", "'{}' AS props")
    assert imports._batches(e).selectExpr("max(length(json) - length(replace(json, 'props', 'prop')))").first()[0] <= 2000


def greedy(candidates):
    touched, kept = set(), []
    for i, at_end, p, q in sorted(candidates):
        if p not in touched:
            touched |= {p, q}
            kept.append((i, at_end))
    return kept


@pytest.mark.parametrize("kind", ["chain", "backward chain", "hub", "random", "repeated ends"])
def test_bridges_that_touch_hold_in_order(spark, kind, monkeypatch):
    rng = np.random.default_rng(31)
    n = 3000 if kind == "chain" else 400
    spot = lambda x: Row(lng_e7=int(x), lat_e7=-int(x))
    if kind == "chain":  # each one's hit is the next one's end
        rows = [(i, 0, i, i + 1) for i in range(n)]
    elif kind == "backward chain":
        rows = [(i, 0, i, i - 1) for i in range(n)]
    elif kind == "hub":
        rows = [(i, i % 2, i, 200) for i in range(n)]
    elif kind == "random":
        order = rng.permutation(n)
        rows = [(int(order[i]), int(rng.integers(2)), i, int(rng.integers(n * 5 // 4))) for i in range(n)]
    else:
        rows = [(i, 0, int(rng.integers(60)), int(rng.integers(60))) for i in range(n)]
    rounds = []
    count = graph.release
    monkeypatch.setattr(graph, "release", lambda *t: (rounds.append(1), count(*t)))
    d = spark.createDataFrame([(i, a, spot(p), spot(q), 7) for i, a, p, q in rows], "id long, at_end int, end struct<lng_e7:long,lat_e7:long>, hit struct<lng_e7:long,lat_e7:long>, target long")
    got = sorted((r["id"], r["at_end"]) for r in graph.accept_bridges(d).collect())
    assert got == greedy([(i, a, (p, -p), (q, -q)) for i, a, p, q in rows])
    assert len(rounds) <= 15


def test_components_step_over_links_between_ranges_only(spark, monkeypatch):
    """A long chain in several ranges is contracted within them; what is left fits one task, so no step over all links is taken."""
    monkeypatch.setattr(components, "SMALL", 200)
    chain = spark.range(3000).selectExpr("id AS a", "id + IF(id % 1000 = 999, 0, 1) AS b")
    hub = spark.range(1000).selectExpr("7000L AS a", "5000 + id AS b")
    settled = components._settled
    monkeypatch.setattr(components, "_settled", lambda e: pytest.fail("a step over all links"))
    got = {r["node"]: r["component"] for r in components.connected_components(chain.unionByName(hub), near=True).collect()}
    assert got == {i: i // 1000 * 1000 for i in range(3000)} | {5000 + i: 5000 for i in range(1000)} | {7000: 5000}
    # links of no order: steps over all of them, and the same components
    monkeypatch.setattr(components, "_settled", settled)
    r = random.Random(5)
    pairs = [(r.randrange(2000), r.randrange(2000)) for _ in range(1200)]
    parent = list(range(2000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = [tuple(x) for x in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), near=True).collect()]
    assert sorted(got) == sorted({(x, find(x)) for a, b in pairs for x in (a, b) if a != b})


def test_statuses_are_those_of_plans_without_a_search(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    g = graph.build(routes._blocks(spark, folder), tolerance_m=0)
    asks = routes._ends(spark, folder).where("request_id % 4 = 0")
    far = asks.limit(3).withColumns({"request_id": F.col("request_id") + 1_000_000, "s_lng": F.col("s_lng") - 300_000_000})
    asks = asks.unionByName(far)
    want = sorted(map(repr, planning.plan(g, asks).select("request_id", "status", "start", "end").collect()))
    monkeypatch.setattr(search, "cheapest", lambda *a, **k: pytest.fail("a search"))
    assert sorted(map(repr, planning.statuses(g, asks).collect())) == want
    assert {r["status"] for r in routes.connected_snap(spark, folder).collect()} <= {"OK", "NO_ROUTE", "START_NOT_NEAR_NETWORK"}


def test_nearest_reaches_to_the_radius_in_every_direction(spark):
    """99.95 m on the sphere from the only piece, north, south, east and west of it, and 100.05 m."""
    from velograph.operators import snap

    lat = math.radians(-38.0)
    pieces = spark.createDataFrame([Row(id=1, piece=0, a=Row(lng_e7=1450000000, lat_e7=-380000000), b=Row(lng_e7=1450000000, lat_e7=-380000000))])
    rows = []
    for m in (99.95, 100.05):
        d = m / geo.SPHERE_DEGREE_M * geo.FIXED
        rows += [(f"{m} {x} {y}", round(1450000000 + x * d / math.cos(lat)), round(-380000000 + y * d)) for x, y in ((0, 1), (0, -1), (1, 0), (-1, 0))]
    got = {r["point_id"] for r in snap.nearest(spark.createDataFrame(rows, "point_id string, lng_e7 long, lat_e7 long"), pieces, 100.0).collect()}
    assert got == {p for p, *_ in rows if p.startswith("99.95")}


def test_sums_in_travel_order(spark):
    """A total at a limit is the same however its rows are dealt."""
    steps = [(0, 1e16, False, "paved"), (1, 1.0, False, "paved"), (2, -1e16, False, "paved"), (3, 4.0, False, "paved")]
    for order in ([0, 1, 2, 3], [2, 0, 3, 1], [3, 1, 0, 2]):
        s = spark.createDataFrame([(1, i, m, x, c) for i, m, x, c in (steps[j] for j in order)], "request_id long, seq int, length_m double, surface_inferred boolean, surface_class string")
        s = s.withColumns({"kind": F.lit("road"), "smoothness": F.lit(None).cast("string"), "hazards": F.array().cast("array<string>")}).repartition(3, "seq")
        assert planning.stretches(s).first()["length_m"] == 4.0


def test_bare_graph_is_the_graph_without_lines(spark):
    segments = sources.segments(sources.paths(spark, "/root/testdata/sf0.001"))
    full, bare = graph.build(segments, keep=("category",)), graph.build(segments, keep=("category",), bare=True)
    assert "coordinates" not in bare.edges.columns
    columns = ["edge_id", "path_id", "run", "from_node", "to_node", "length_m", "kind"]
    want = full.edges.select(*columns, F.size("coordinates").alias("points"))
    assert sorted(map(repr, bare.edges.select(*columns, "points").collect())) == sorted(map(repr, want.collect()))
    assert sorted(map(repr, bare.nodes.collect())) == sorted(map(repr, full.nodes.collect()))


def test_contested_gaps_equal_their_sql_where_meridians_draw_together(spark, tmp_path):
    """At 50 degrees north lines of two crossings end within reach of each other."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, k % 1000) for k in (*range(5, 25), *range(8_850_000, 8_850_040))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["bridge_contested"]).fetchall())
    got = sorted(map(tuple, QUERIES["bridge_contested"](spark, str(tmp_path)).collect()))
    assert got == want and any(i > 35_400_000 for i, *_ in want)


def test_losses_in_travel_order(spark):
    """Metres and points of a cause at a limit are the same however its stretches are dealt."""
    steps = [(1, 1.0), (2, 1.0), (3, 1.0), (4, 1e16)]
    for order in ([0, 1, 2, 3], [2, 0, 3, 1], [3, 1, 0, 2]):
        s = spark.createDataFrame([(1, *steps[j], False, "gravel", "road") for j in order], "request_id long, island long, length_m double, surface_inferred boolean, surface_class string, kind string")
        s = s.withColumns({"smoothness": F.lit(None).cast("string"), "hazards": F.array().cast("array<string>")}).repartition(3, "island")
        got = {r["cause"]: r["metres"] for r in scoring.losses(s, "run").collect()}
        assert set(got.values()) == {1e16 + 4}


def test_nearest_places_over_cells_of_growing_width(spark):
    """Dense and sparse places, ties, and searches inside, beside and far from the region, against all distances."""
    rnd = random.Random(4)
    spots = [(1450000000 + rnd.randrange(40_000), -380000000 + rnd.randrange(40_000)) for _ in range(200)] + [(1410000000 + rnd.randrange(90_000_000), -392000000 + rnd.randrange(50_000_000)) for _ in range(60)]
    spots += spots[:30]  # equal places: the smaller id
    hits = [(t, i, *p) for t in (1, 2) for i, p in enumerate(spots) if t == 1 or i < 5]
    asks = [(1450000000 + rnd.randrange(-9, 50) * 1000, -380000000 + rnd.randrange(-9, 50) * 1000) for _ in range(40)] + [(1410000000 + rnd.randrange(90_000) * 1000, -392000000 + rnd.randrange(50_000) * 1000) for _ in range(40)]
    asks += [(20000000, 510000000), (-1790000000, -380000000), (1455000000, 890000000)]
    asked = [(q, q % 2 + 1, *a) for q, a in enumerate(asks * 2)]
    at = lambda c: [x / 1e7 for x in c]

    def metres(p, q):
        (x, y), (u, v) = at(p), at(q)
        h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
        return round(2 * geo.RADIUS_M * math.asin(min(1, math.sqrt(h))), 3)

    want = {(q, i, n) for q, t, *a in asked for n, (_, i) in enumerate(sorted((metres(a, p), i) for x, i, *p in hits if x == t)[:12], 1)}
    got = serving._nearest_places(spark.createDataFrame(asked, "query_id long, text_id long, lng long, lat long"), spark.createDataFrame(hits, "text_id long, place_id long, lng_e7 long, lat_e7 long"), 12)
    assert {tuple(r) for r in got.collect()} == want


def test_narrow_searches_do_not_multiply_pieces(spark, monkeypatch):
    """Gaps of 15 m are looked for among pieces of 100 m: each goes into the shuffle at most four times."""
    met, gridded = [], polylines.gridded
    monkeypatch.setattr(polylines, "gridded", lambda p, size: met.append((p.count(), gridded(p, size).count())) or gridded(p, size))
    lines = [[(i * 70, 0), (i * 70 + 70, 70)] for i in range(20)] + [[(300, 310), (307, 305)]]
    assert graph.bridge_candidates(network(spark, *lines)).count() == 0
    assert all(n <= 4 * pieces for pieces, n in met) and met


def test_search_knows_when_no_way_around_is_better():
    """Finding 5: a way is final if the search met no node beyond the window, however costly the way is."""
    from velograph.operators.arcs import Arcs

    xy = [(0, 0), (1, 0), (2, 0), (1, 1), (9, 0)]
    links = [(0, 1), (1, 2), (0, 3), (3, 2), (2, 4)]
    at = lambda i, c: [xy[link[i]][c] * 10_000 for link in links]
    edges = pd.DataFrame({"edge_id": range(5), "from_node": [a for a, _ in links], "to_node": [b for _, b in links], "length_m": [111.0, 111.0, 157.0, 157.0, 778.0], "ways": 0, "f_lng": at(0, 0), "f_lat": at(0, 1), "t_lng": at(1, 0), "t_lat": at(1, 1)})
    arcs = Arcs(edges, False)
    price = [arcs.length[e] * 4 for e in arcs.edge]
    arcs.enclose(0, 0, 0.005, 0.005)
    assert arcs.cheapest(price, 1.0, {0: 0.0}, {2: 0.0}, (0.002, 0.0))[0] == pytest.approx(888) and not arcs.left
    arcs.enclose(0, 0, 0.005, 0.0005)
    assert arcs.cheapest(price, 1.0, {0: 0.0}, {2: 0.0}, (0.002, 0.0))[0] == pytest.approx(888) and arcs.left
    assert arcs.cheapest(price, 1.0, {0: 0.0}, {2: 0.0}, (0.002, 0.0), 888.0) is None


def test_lines_of_routes_over_a_few_attributes(spark):
    """Routes and their lines need no more of the edges than costs are made of."""
    lines = network(spark, [(0, 0), (300, 0)], [(300, 0), (300, 200)])
    ask = spark.createDataFrame([(1, *e7(20, 1), *e7(301, 150))], "request_id long, s_lng long, s_lat long, e_lng long, e_lat long")
    found = []
    for keep in (routes.PRICED, graph.ATTRIBUTES):
        g = graph.build(lines, keep=keep)
        found.append([r["coordinates"] for r in planning.route_lines(planning.plan(g, ask), g).collect()])
    assert "name" not in routes.PRICED and found[0] == found[1] and len(found[0][0]) == 3


def test_ways_along_one_edge_need_no_search(spark, monkeypatch):
    """Finding 18: the way along the edge is taken unseen where any other must cost more, and only there."""
    g = graph.build(network(spark, ([(0, 0), (1000, 0)], {"category": "busy_road"}), [(0, 0), (500, 50), (1000, 0)]), tolerance_m=0)
    through = plan(spark, g, (10, 0), (990, 0))
    assert len(through["edges"]) == 3
    monkeypatch.setattr(search, "_searched", lambda *a, **k: pytest.fail("a search"))
    for a, b in ((100, 300), (300, 100), (300, 300)):
        r = plan(spark, g, (a, 0), (b, 0))
        assert r["status"] == "OK" and sum(abs(e["to_m"] - e["from_m"]) for e in r["edges"]) == pytest.approx(abs(a - b), abs=1)


def test_least_costs_hold_ends_and_prices_only(spark, town, monkeypatch):
    """Finding 23: what a round deals is three numbers an edge; a price of the edges' columns needs no join."""
    held, made = [], frontier.Tiles.__init__

    def spy(self, *a, **k):
        made(self, *a, **k)
        held.append(self.columns)

    monkeypatch.setattr(frontier.Tiles, "__init__", spy)
    g, _, _ = town
    source = spark.createDataFrame([(0,)], "node long")
    price = F.col("length_m") * 2
    bare = g.edges.withColumn("from", F.col("coordinates")[0]).drop("coordinates")
    got = [{r["node"]: r["cost"] for r in planning.reach(e, source, p, 6).collect()} for e, p in ((g.edges, price), (bare, price), (g.edges, g.edges.select("edge_id", price.alias("price"))))]
    assert held == [["from_node", "to_node", "price"]] * 3 and got[0] == got[1] == got[2] and len(got[0]) > 30


@pytest.mark.parametrize("own", [False, True])
def test_wide_searches_begin_with_a_narrow_one(spark, monkeypatch, own):
    """Finding 5: points with a piece close by don't meet all pieces of their radius; the nearest are the same."""
    from velograph.operators import snap

    rng = np.random.default_rng(8)
    lines = network(spark, *([(x, y), (x + 40, y + 30)] for x, y in rng.uniform(0, 900, (40, 2)).tolist()))
    at = [e7(x, y) for x, y in rng.uniform(-300, 1200, (150, 2)).tolist()]
    p = spark.createDataFrame([(i, q.lng_e7, q.lat_e7, 40.0 + i) for i, q in enumerate(at)], "point_id long, lng_e7 long, lat_e7 long, own double")
    asked, ranked = [], snap._ranked

    def spy(points, pieces, max_m, *a):
        asked.append((max_m, points.count()))
        return ranked(points, pieces, max_m, *a)

    monkeypatch.setattr(snap, "_ranked", spy)
    found = lambda: sorted(map(tuple, snap.nearest(p, polylines.pieces(lines), 400.0, F.col("id") % 3 > 0, F.col("own") if own else None).collect()))
    narrow = found()
    monkeypatch.setattr(snap, "NEAR_M", 400.0)
    assert narrow == found() and len(narrow) > 30
    assert [m for m, _ in asked] == [50.0, 400.0, 400.0] and 0 < asked[1][1] < asked[0][1] == asked[2][1] == 150


def test_tiles_are_made_once(spark, monkeypatch):
    """Findings 29 and 36: tiles are stored before they are used twice."""
    from velograph.queries import serving as served

    steps = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in steps(served.tile_bytes(spark, "/root/testdata/sf0.001"))
    written, write = [], served.named.write_tiles
    monkeypatch.setattr(served.named, "write_tiles", lambda d, path: (written.append(steps(d)), write(d, path)))
    served.tile_files(spark, "/root/testdata/sf0.001")
    assert len(written) == 1 and "FlatMapGroupsInPandas" not in written[0]


def test_searches_beyond_a_pole_reach_no_farther_than_on_this_side(spark):
    """Large networks run on past latitude 90, where the cosine is negative."""
    rows = [Row(lat_e7=lat) for lat in (185_000_000, 1_615_000_000, 2_650_000_000, 3_785_000_000)]
    side, far, _, _ = (r["x"] for r in spark.createDataFrame(rows).select(snap.lng_reach(1000.0, F.col("lat_e7")).alias("x")).collect())
    assert far == pytest.approx(side) and far < 1060
    lines = [(i, [Row(lng_e7=1_449_000_000 + i * 2_000, lat_e7=1_615_000_000), Row(lng_e7=1_449_000_000 + i * 2_000, lat_e7=1_615_010_000)]) for i in range(9)]
    pieces = polylines.pieces(spark.createDataFrame(lines, "id long, coordinates array<struct<lng_e7:long,lat_e7:long>>"))
    points = spark.createDataFrame([(f"{i}", 1_449_000_000 + i * 2_000 + 700, 1_615_005_000) for i in range(9)], "point_id string, lng_e7 long, lat_e7 long")
    got = {r["point_id"]: (r["id"], r["distance_m"]) for r in snap.nearest(points, pieces, 15.0).collect()}
    assert {p: i for p, (i, _) in got.items()} == {f"{i}": i for i in range(9)}
    assert all(d == pytest.approx(700 / 1e7 * PER_DEGREE * math.cos(math.radians(18.5)), rel=1e-3) for _, d in got.values())


def test_snaps_join_pieces_of_their_component_only(spark, monkeypatch):
    """A point that wants a component doesn't meet the pieces of others; what it finds is the same."""
    met, both = [], snap._met
    monkeypatch.setattr(snap, "_met", lambda *a: met.append(both(*a)) or met[-1])
    lines = network(spark, *([(0, y), (100, y)] for y in range(0, 300, 10))).withColumns({"edge_id": F.col("id"), "component": F.col("id") % 3, "length_m": geo.length(F.col("coordinates"))})
    at = e7(50, 145)
    p = spark.createDataFrame([(f"{c}", at.lng_e7, at.lat_e7, c) for c in range(3)], "point_id string, lng_e7 long, lat_e7 long, component long")
    joined = {r["point_id"]: r["edge_id"] for r in snap.snap(p, lines, 80.0, on=("component",)).collect()}
    pairs = met[-1].count()
    filtered = {r["point_id"]: r["edge_id"] for r in snap.snap(p.withColumnRenamed("component", "wanted"), lines, 80.0, F.col("component") == F.col("wanted"), keep=("component",)).collect()}
    assert joined == filtered and len(joined) == 3 and pairs * 3 == met[-1].count()


def test_preferring_snaps_meet_the_pieces_once(spark, monkeypatch):
    """The nearest edge and the nearest that isn't avoided come from one search; the result is that of two."""
    asked, both = [], snap._met
    monkeypatch.setattr(snap, "_met", lambda points, pieces, max_m, *a: asked.append(max_m) or both(points, pieces, max_m, *a))
    rng = np.random.default_rng(4)
    kinds = ["smooth", "gravel", "unpaved"]
    lines = network(spark, *(([(x, y), (x + 60, y + 20)], {"surface_class": kinds[i % 3]}) for i, (x, y) in enumerate(rng.uniform(0, 1500, (60, 2)).tolist())))
    edges = lines.select(F.col("id").alias("edge_id"), "coordinates", "surface_class", geo.length(F.col("coordinates")).alias("length_m"))
    at = [e7(x, y) for x, y in rng.uniform(-200, 1700, (120, 2)).tolist()]
    p = spark.createDataFrame([(i, q.lng_e7, q.lat_e7, [[], ["gravel"], ["gravel", "unpaved"]][i % 3]) for i, q in enumerate(at)], "point_id long, lng_e7 long, lat_e7 long, avoid array<string>")
    got = {r["point_id"]: r["edge_id"] for r in snap.snap_preferring(p, edges, 300.0).collect()}
    assert asked == [50.0, 300.0]
    first = {r["point_id"]: r for r in snap.snap(p, edges, 300.0).collect()}
    fine = {r["point_id"]: r for r in snap.snap(p.withColumnRenamed("avoid", "no"), edges, 300.0, ~F.expr("array_contains(no, surface_class)"), keep=("surface_class",)).collect()}
    want = {}
    for i, r in first.items():
        bad = kinds[(r["edge_id"] - 1) % 3] in [[], ["gravel"], ["gravel", "unpaved"]][i % 3]
        reach = min(300.0, r["distance_m"] + max(75.0, min(r["along_m"], r["length_m"] - r["along_m"])))
        want[i] = fine[i]["edge_id"] if bad and i in fine and fine[i]["distance_m"] <= reach else r["edge_id"]
    assert got == want and any(got[i] != first[i]["edge_id"] for i in got)


def test_segments_are_worked_out_once(spark, monkeypatch):
    """The build reads what it stored; the attributes' expressions stand in no later plan."""
    plans, store = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or store(d))
    lines = network(spark, [(-100, 0), (0, 0), (100, 0)], [(0, -100), (0, 0), (0, 100)]).withColumn("name", F.concat(F.lit("the mark "), F.col("id").cast("string")))
    assert stats(graph.build(lines))["edges"] == 4
    assert sum("the mark" in p for p in plans) == 1 and "the mark" in plans[0]
