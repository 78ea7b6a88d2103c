"""Approximate nearest neighbours by few stable projections and kd-trees.

Largest inner product becomes least distance when every row x gets one more component sqrt(M**2 - |x|**2), M the largest
norm of all rows. Rows are projected to ``dims`` Gaussian (2-stable) directions; a task indexes each shard of its rows by
a kd-tree over the projections. A query goes through a tree's leaves in order of the least projected distance they allow, and
through their rows by projected distance: those that pass the test below are verified by true inner products.

The ratio of a squared projected distance to the squared true distance is chi-square with ``dims`` degrees of freedom. So a
row whose squared projected distance exceeds the ``confidence`` quantile times the k-th best squared true distance is
nearer than that with a chance of 1 - confidence at most: it isn't verified, and once the next leaf's least distance exceeds
this bound, the search of this tree ends. A first pass over all rows verifies each query's FIRST * k nearest rows by projected
distance of every tree only, which gives all trees a common bound on the k-th best; from there it is carried from one shard of
a task to the next.

The share of the rows that is verified falls with their number, as the k-th best comes nearer while most rows stay where
they are; it is small where vectors have structure. README gives recall and share for vectors without any.

Rows are indexed whole; only the directions are drawn (from a fixed seed), so no sample is fitted.

Results for unusual input: rows whose id or vector is null, or whose vector is zero or holds a null, NaN or infinity, take
no part; with k or fewer candidates all are returned; equal scores go by the smaller id, and scores are summed row by row
in one order, so equal vectors get equal scores; a repeated vec_id counts once (as candidate with its best score, as query
with its least vector) and is never its own query's candidate; vectors of different lengths raise an error; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from .vectors import best, by_waves, keep_top, matrix, usable

K, DIMS, CONFIDENCE, LEAF, SHARD, SEED = 20, 32, 0.88, 256, 65_536, 20_171
#: Pairs of a query and a row that are verified together; projected neighbours that the first pass verifies, over k.
PAIRS, FIRST = 16_384, 4
OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("list", pa.int64())])


def chi_square_cdf(x: float, dims: int) -> float:
    """Lower tail for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 1.0
    while chi_square_cdf(hi, dims) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, dims) < p else (lo, mid)
    return hi


def directions(width: int, dims: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


class Tree:
    """kd-tree: rows in leaf order, and each leaf's box in the projected space."""

    def __init__(self, points: np.ndarray, leaf: int):
        parts, order, bounds = [np.arange(len(points))], [], []
        while parts:
            rows = parts.pop()
            if len(rows) <= leaf:
                order.append(rows)
                bounds.append((points[rows].min(0), points[rows].max(0)))
                continue
            axis = np.argmax(points[rows].max(0) - points[rows].min(0))
            split = np.argpartition(points[rows, axis], len(rows) // 2)
            parts += [rows[split[len(rows) // 2 :]], rows[split[: len(rows) // 2]]]
        self.order = np.concatenate(order)
        self.stops = np.cumsum([len(x) for x in order])
        self.lo, self.hi = (np.array([b[i] for b in bounds]) for i in (0, 1))

    def leaf(self, i: int) -> slice:
        return slice(self.stops[i - 1] if i else 0, self.stops[i])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each leaf's box."""
        out = np.zeros((len(q), len(self.lo)))
        for d in range(q.shape[1]):
            gap = np.maximum(self.lo[:, d] - q[:, d, None], q[:, d, None] - self.hi[:, d])
            out += np.square(np.maximum(gap, 0))
        return out


class Held:
    """The best found so far for some queries: triples (query, id, score) and each query's k-th best score."""

    def __init__(self, bound: np.ndarray, k: int):
        """``bound``: what each query's k-th best is known to reach."""
        self.k, self.triples = k, (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.kth = bound.copy()
        self.verified = 0

    def add(self, new: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.triples = keep_top(*(np.concatenate(c) for c in zip(self.triples, *new, strict=True)), self.k)
        n = np.bincount(self.triples[0], minlength=len(self.kth))
        full = np.flatnonzero(n == self.k)
        self.kth[full] = np.maximum(self.kth[full], self.triples[2][np.cumsum(n)[full] - 1])


def walk(tree: Tree, points: np.ndarray, length: np.ndarray, flat: np.ndarray, limit, take) -> None:
    """Each query's way through the leaves, by the least squared projected distance they allow, while ``limit()`` (one number
    a query) isn't exceeded. ``take`` gets (query, row, squared projected distance) of the rows within the limit."""
    near = tree.distances(flat)
    visit = np.argsort(near, axis=1, kind="stable")
    near = np.take_along_axis(near, visit, axis=1)
    flat_length = np.square(flat).sum(1)
    active, step, stride = np.arange(len(flat)), 0, 1
    while len(active) and step < visit.shape[1]:
        bound = limit()
        active = active[near[active, step] <= bound[active]]
        if not len(active):
            break
        todo = visit[active, step : step + stride]
        who, leaves = np.repeat(active, todo.shape[1]), todo.ravel()
        by = np.argsort(leaves, kind="stable")
        who, leaves = who[by], leaves[by]
        starts = np.flatnonzero(np.append(True, leaves[1:] != leaves[:-1]))
        for s, e in zip(starts, np.append(starts[1:], len(leaves)), strict=True):
            at, mine = tree.leaf(leaves[s]), who[s:e]
            apart = flat_length[mine, None] + length[at] - 2 * (flat[mine] @ points[at].T)
            qi, xi = np.nonzero(apart <= bound[mine, None])
            take(mine[qi], xi + at.start, apart[qi, xi])
        step += todo.shape[1]
        stride = min(8, stride * 2)


def search_shard(ids, x, query_ids, q, held: Held, top: float, dims: int, confidence: float, leaf: int, first: bool = False, block: int = 512) -> None:
    """Add what one shard's tree gives to the best found; with ``first``, only its nearest rows by projected distance."""
    norm2 = np.square(x).sum(1)
    lift = np.sqrt(np.maximum(top * top - norm2, 0))
    g = directions(x.shape[1] + 1, dims)
    points = x @ g[:-1] + lift[:, None] * g[-1]
    tree = Tree(points, leaf)
    ids, x, points = ids[tree.order], x[tree.order], points[tree.order]
    length = np.square(points).sum(1)
    quantile = chi_square_quantile(confidence, dims)
    for b in range(0, len(q), block):
        part = q[b : b + block]
        flat = part @ g[:-1]
        scale = top * top + np.square(part).sum(1)  # squared true distance = scale - 2 * inner product
        kth = held.kth[b : b + block]
        new = []

        def verify(qi, xi, _apart=None):
            for i in range(0, len(qi), PAIRS):
                qj, xj = qi[i : i + PAIRS], xi[i : i + PAIRS]
                score = np.add.reduce(part[qj] * x[xj], axis=1)  # noqa: B023
                keep = (score >= kth[qj]) & (query_ids[b + qj] != ids[xj])  # noqa: B023
                new.append((qj[keep] + b, ids[xj[keep]], score[keep]))  # noqa: B023
            held.verified += len(qi)

        def flush():
            held.add(new)  # noqa: B023
            new.clear()  # noqa: B023

        if first:
            nearest = Held(np.full(len(part), -np.inf), FIRST * held.k + 1)  # one may be the query itself
            some = []

            def limit():
                nearest.add(some)  # noqa: B023
                some.clear()  # noqa: B023
                return -nearest.kth  # noqa: B023

            walk(tree, points, length, flat, limit, lambda qi, xi, apart: some.append((qi, xi, -apart)))  # noqa: B023
            limit()
            verify(*nearest.triples[:2])
        else:

            def limit():
                flush()  # noqa: B023
                return quantile * np.maximum(scale - 2 * kth, 0) + 1e-9 * scale  # noqa: B023

            walk(tree, points, length, flat, limit, verify)
        flush()


def _search(wave, bound, top: float, k: int, dims: int, confidence: float, leaf: int, shard: int, first: bool):
    def run(batches):
        from pyspark import TaskContext

        query_ids, q = wave.value

        def shards():
            ids, rows, n = [], [], 0
            for batch in batches:
                ids.append(batch.column("vec_id").to_numpy())
                rows.append(matrix(batch.column("embedding")))
                n += len(batch)
                if n >= shard:
                    yield np.concatenate(ids), np.concatenate(rows)
                    ids, rows, n = [], [], 0
            if n:
                yield np.concatenate(ids), np.concatenate(rows)

        held = Held(np.full(len(query_ids), -np.inf) if bound is None else bound.value, k)
        for ids, x in shards():
            search_shard(ids, x, query_ids, q, held, top, dims, confidence, leaf, first)
        found = held.triples
        if len(found[0]):
            here = np.full(len(found[0]), TaskContext.get().partitionId())
            yield pa.record_batch([pa.array(query_ids[found[0]]), pa.array(found[1]), pa.array(found[2]), pa.array(here)], OUT)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = K, dims: int = DIMS, confidence: float = CONFIDENCE, leaf: int = LEAF, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for every row where ``is_query`` holds."""
    if dims % 2:
        raise ValueError("dims must be even")
    rows = usable(vectors, allow_zero=False)
    largest = rows.agg(F.max(F.expr("aggregate(embedding, 0D, (a, x) -> a + double(x) * double(x))")).alias("m")).first()["m"] or 0.0
    kinds = "query_id long, vec_id long, score double, list long"

    def tasks(wave):
        """The search of a wave, with the bounds that its first pass gives: one number a query."""
        options = (math.sqrt(largest), k, dims, confidence, leaf, shard)
        near = best(materialise(rows.mapInArrow(_search(wave, None, *options, True), kinds)), k, "score")
        known = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).select("query_id", "least").toArrow()
        bound = np.full(len(wave.value[0]), -np.inf)
        bound[np.searchsorted(wave.value[0], known["query_id"].to_numpy())] = known["least"].to_numpy()
        return _search(wave, rows.sparkSession.sparkContext.broadcast(bound), *options, False)

    found = by_waves(rows, rows.where(is_query), tasks, kinds)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return best(found, k, "score")
