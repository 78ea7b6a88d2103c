"""What both vector searches share: clean rows, query waves of bounded size, and merging of top lists.

Waves run one after the other: a wave's queries come to the driver, go out as one broadcast, meet all rows, and the tasks'
lists are stored before the next wave is fetched. So neither the driver nor an executor holds more than one wave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialise

#: Queries of one wave come to the driver and go out as one broadcast; more queries make more waves.
WAVE_BYTES = 32 << 20
#: Lists that one merge step brings together for a query.
FAN_IN = 64


def usable(vectors: DataFrame, allow_zero: bool = True) -> DataFrame:
    """(vec_id, embedding) without rows whose id or vector is null or whose vector has a null, NaN or infinity."""
    good = F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    out = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good)
    return out if allow_zero else out.where(F.expr("exists(embedding, x -> x <> 0)"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles; all must have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(flat) % len(column):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def waves(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, some WAVE_BYTES at a time. A repeated id counts once, with its least vector."""
    once = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    size = once.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if not size["n"]:
        return
    n = max(1, -(-size["n"] * size["d"] * 8 // WAVE_BYTES))
    for i in range(n):
        wave = once if n == 1 else once.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i)
        table = wave.toArrow().combine_chunks()
        if len(table):
            order = np.argsort(table["vec_id"].to_numpy())
            yield table["vec_id"].to_numpy()[order], matrix(table["embedding"].combine_chunks())[order]


def by_waves(rows: DataFrame, queries: DataFrame, search: Callable, schema: str) -> DataFrame | None:
    """The lists that the tasks of all waves find; ``search`` makes a task's function of a broadcast wave. None without queries."""
    found = None
    for wave in waves(queries):
        shared = rows.sparkSession.sparkContext.broadcast(wave)
        part = materialise(rows.mapInArrow(search(shared), schema))
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def best(found: DataFrame, k: int, score: str) -> DataFrame:
    """Merge the tasks' lists (query_id, vec_id, score, list) as a tree of FAN_IN lists a step; a repeated vec_id counts once."""
    order = [F.col(score).desc(), F.col("vec_id")]

    def top(x: DataFrame, by: list[str | Column]) -> DataFrame:
        return x.withColumn("rank", F.row_number().over(W.partitionBy("query_id", *by).orderBy(*order))).where(F.col("rank") <= k)

    lists = (found.agg(F.max("list").alias("n")).first()["n"] or 0) + 1
    left = found.groupBy("query_id", "vec_id").agg(F.max(score).alias(score), F.min("list").alias("list"))
    while lists > FAN_IN:
        left = top(left.withColumn("list", F.floor(F.col("list") / FAN_IN)), ["list"]).drop("rank")
        lists = -(-lists // FAN_IN)
    return top(left, []).select("query_id", "rank", "vec_id", score)


def once(ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of a (queries, rows) score matrix with those of a repeated id merged into one, by the best score."""
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1]))
    if len(first) >= len(ids):
        return ids, score
    return ids[order][first], np.maximum.reduceat(score[:, order], first, axis=1)


def keep_top(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, score) triples the k best of each query, higher scores and then smaller ids first, ids once by their best score."""
    down = ~score if score.dtype.kind == "i" else -score  # the least long has no negative
    order = np.lexsort((down, ids, q))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (q[order][1:] != q[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[fresh]
    order = order[np.lexsort((ids[order], down[order], q[order]))]
    q, ids, score = q[order], ids[order], score[order]
    head = np.ones(len(q), bool)
    head[1:] = q[1:] != q[:-1]
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(head, np.arange(len(q)), 0))
    keep = place < k
    return q[keep], ids[keep], score[keep]
