"""Arrays of a part of the network, and least-cost search on them."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd

from ..functions import geo

#: Straight distances on the plane, taken a little short, so that they bound those on the sphere from below.
SHORT = 0.99


class Arcs:
    """Compressed adjacency of some edges, as lists for the search's inner loop."""

    def __init__(self, edges: pd.DataFrame, one_way: bool):
        self.ids = edges["edge_id"].to_numpy()
        self.place = {e: i for i, e in enumerate(self.ids.tolist())}
        names, local = np.unique(np.concatenate([edges["from_node"], edges["to_node"]]), return_inverse=True)
        self.names, self.frm, self.to = names, local[: len(edges)], local[len(edges) :]
        self.length = edges["length_m"].to_numpy()
        ways = edges["ways"].to_numpy()  # 0 both, 1 forward, 2 backward
        self.onward, self.back = (ways != 2, ways != 1) if one_way else (np.ones(len(edges), bool),) * 2
        self.lng, self.lat = np.empty(len(names)), np.empty(len(names))
        for side, n in (("f", self.frm), ("t", self.to)):
            self.lng[n], self.lat[n] = edges[f"{side}_lng"] / geo.FIXED, edges[f"{side}_lat"] / geo.FIXED
        loop = self.frm == self.to
        a, b = np.flatnonzero(self.onward), np.flatnonzero(self.back & ~(loop & self.onward))
        tail, head, edge = np.concatenate([self.frm[a], self.to[b]]), np.concatenate([self.to[a], self.frm[b]]), np.concatenate([a, b])
        order = np.argsort(tail, kind="stable")
        self.offset = np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=len(names)))]).tolist()
        self.head, self.edge = head[order].tolist(), edge[order].tolist()
        # plain numbers for the inner loop, where numpy's are slow
        self.lngs, self.lats = self.lng.tolist(), self.lat.tolist()
        self.far = float(np.abs(self.lat).max()) if len(names) else 0.0
        #: Nodes of which not all edges may be held, and whether the last search went through one.
        self.open, self.left = frozenset(), False

    def enclose(self, west: float, south: float, east: float, north: float) -> None:
        """All edges with an end in this box (west and south sides included) are held; other nodes may have more than these."""
        out = (self.lng < west) | (self.lng >= east) | (self.lat < south) | (self.lat >= north)
        self.open = frozenset(np.flatnonzero(out).tolist())

    def cheapest(self, price: list[float], least: float, starts: dict, goals: dict, end: tuple[float, float], top: float = math.inf):
        """(cost, nodes' edges from the first start) of the best way from any start (its cost so far) to any goal (its cost to
        come), or None if there is none below ``top``. A*: what is to come costs at least ``least`` a metre of the straight distance
        to ``end``. Every node that a better way could leave the edges by is gone through; so what is found is the best of all
        ways, and no way found means that there is none, unless ``left`` is set."""
        ky = geo.SPHERE_DEGREE_M * SHORT * least
        kx = ky * math.cos(math.radians(min(89.0, max(abs(end[1]), self.far))))
        lng, lat, hypot, gx, gy = self.lngs, self.lats, math.hypot, *end

        def ahead(node: int) -> float:
            return hypot((lng[node] - gx) * kx, (lat[node] - gy) * ky)

        offset, head, edge, push, pop, none = self.offset, self.head, self.edge, heapq.heappush, heapq.heappop, math.inf
        best, via, done, bound = dict(starts), {}, set(), {}
        heap = [(c + ahead(n), n) for n, c in starts.items()]
        heapq.heapify(heap)
        last = None
        while heap and heap[0][0] < top:
            _, node = pop(heap)
            if node in done:
                continue
            done.add(node)
            c = best[node]
            if node in goals and c + goals[node] < top:
                top, last = c + goals[node], node
            for i in range(offset[node], offset[node + 1]):
                other, reach = head[i], c + price[i]
                if reach < best.get(other, none):
                    best[other], via[other] = reach, (node, edge[i])
                    if (more := bound.get(other)) is None:
                        more = bound[other] = hypot((lng[other] - gx) * kx, (lat[other] - gy) * ky)
                    if reach + more < top:
                        push(heap, (reach + more, other))
        self.left = not self.open.isdisjoint(done)
        if last is None:
            return None
        path, node = [], last
        while node in via:
            before, e = via[node]
            path.append((e, before))
            node = before
        return top, node, path[::-1], last

    def route(self, price: np.ndarray, arcs: list[float], least: float, s: int, s_along: float, e: int, e_along: float, end: tuple[float, float]):
        """(cost, parts) between two places along edges; parts are (edge_id, from_m, to_m) in travel order."""
        frm, to, length = self.frm, self.to, self.length
        per = [price[x] / length[x] if length[x] > 0 else 0.0 for x in (s, e)]
        starts, leave, goals, arrive = {}, {}, {}, {}
        for node, at, open_ in ((int(frm[s]), 0.0, self.back[s]), (int(to[s]), float(length[s]), self.onward[s])):
            c = abs(at - s_along) * per[0]
            if (open_ or at == s_along) and c < starts.get(node, math.inf):
                starts[node], leave[node] = c, at
        for node, at, open_ in ((int(frm[e]), 0.0, self.onward[e]), (int(to[e]), float(length[e]), self.back[e])):
            c = abs(at - e_along) * per[1]
            if (open_ or at == e_along) and c < goals.get(node, math.inf):
                goals[node], arrive[node] = c, at
        straight = s == e and (s_along == e_along or (self.onward if e_along > s_along else self.back)[s])
        direct = abs(e_along - s_along) * per[0] if straight else math.inf
        found = self.cheapest(arcs, least, starts, goals, end, direct)
        if direct < math.inf and found is None:
            return direct, [(int(self.ids[s]), s_along, e_along)]
        if found is None:
            return None
        cost, first, path, last = found
        parts = [(int(self.ids[s]), s_along, leave[first])]
        for x, before in path:
            ahead = frm[x] == before and self.onward[x]
            parts.append((int(self.ids[x]), 0.0, float(length[x])) if ahead else (int(self.ids[x]), float(length[x]), 0.0))
        parts.append((int(self.ids[e]), arrive[last], e_along))
        return cost, [p for p in parts if p[1] != p[2]]
