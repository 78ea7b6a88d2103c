"""Exact top-k search by integer inner product.

Every component x becomes floor(scale * x). Queries come in waves of bounded size; each task multiplies a wave with tiles
of its shard of the rows (matrix products), keeps the k best of each query after every tile, and the tasks' lists are
merged in a tree. Products are taken in doubles while every sum is below 2**53, and in Python integers beyond.

Results for unusual input: rows whose id or vector is null, or whose vector holds a null, NaN or infinity, take no part; a
query has fewer rows when there are fewer candidates, and none when there is none; equal scores go by the smaller id; a
repeated vec_id counts once (as candidate with its best score, as query with its least vector) and is never its own
query's candidate; scores beyond a long are cut to its range; vectors of different lengths raise an error; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import best, by_waves, keep_top, matrix, once, usable

K, SCALE, TILE = 10, 1024, 2048
OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("list", pa.int64())])


def _products(q: np.ndarray, x: np.ndarray, bound: float) -> np.ndarray:
    if bound * max(1.0, np.abs(x).max(initial=0)) * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _search(wave, k: int, scale: int, tile: int):
    def run(batches):
        from pyspark import TaskContext

        ids, q = wave.value
        q = np.floor(scale * q)
        bound = max(1.0, np.abs(q).max(initial=0))
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        floor = np.full(len(ids), np.iinfo(np.int64).min)
        for batch in batches:
            for at in range(0, len(batch), tile):
                part = batch.slice(at, tile)
                rows = part.column("vec_id").to_numpy()
                x = np.floor(scale * matrix(part.column("embedding")))
                for b in range(0, len(ids), tile):
                    each, score = once(rows, _products(q[b : b + tile], x, bound))
                    # the query's own row may be among the k best, so one score more is let through
                    cut = np.partition(score, -k - 1, axis=1)[:, -k - 1] if len(each) > k + 1 else floor[b : b + tile]
                    qi, xi = np.nonzero(score >= np.maximum(cut, floor[b : b + tile])[:, None])
                    other = ids[qi + b] != each[xi]
                    qi, xi = qi[other], xi[other]
                    new = keep_top(qi + b, each[xi], score[qi, xi], k)
                    held = tuple(np.concatenate(c) for c in zip(held, new, strict=True))
                held = keep_top(*held, k)
                n = np.bincount(held[0], minlength=len(ids))
                last = np.cumsum(n) - 1
                floor = np.where(n == k, held[2][np.maximum(last, 0)], floor) if len(held[0]) else floor
        if len(held[0]):
            here = np.full(len(held[0]), TaskContext.get().partitionId())
            yield pa.record_batch([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2]), pa.array(here)], OUT)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, tile: int = TILE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for every row where ``is_query`` holds."""
    rows = usable(vectors)
    found = by_waves(rows, rows.where(is_query), lambda wave: _search(wave, k, scale, tile), "query_id long, vec_id long, score long, list long")
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best(found, k, "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
