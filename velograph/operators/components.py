"""Connected components by alternating large-star and small-star steps.

Every step is a combinable minimum per node and a join back, in which the rows of a node with very many neighbours are dealt
to several tasks; so neither a hub nor a very large component meets in one task. The number of steps grows with the
logarithm of the longest path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, release
from .skew import salted_join


def _settled(edges: DataFrame) -> bool:
    """Whether every node that points has one target, and no target points: then the targets are the components."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out > 0 AND into > 0").isEmpty()


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node linked with it) of all nodes of some edges but the least ones: hooks roots to smaller ones and halves paths."""
    names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(names))
    while len(a):
        p, q = root[a], root[b]
        apart = p != q
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
    other = np.flatnonzero(root != np.arange(len(names)))
    return names[other], names[root[other]]


def _contracted(batches):
    """A partition's edges as stars around the least node of each part that they make; at most as many as it has nodes."""
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        u, v = forest(np.concatenate([u, batch.column("u").to_numpy()]), np.concatenate([v, batch.column("v").to_numpy()]))
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


#: Edges that one task contracts altogether: two longs each, so some megabytes.
SMALL = 500_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", near: bool = False) -> DataFrame:
    """(node, component): each node that has an edge to another, with the smallest node of its component.

    With ``near`` (long nodes, best numbered so that those linked are close) edges are first dealt by ranges of both ends and each
    partition is contracted on its own; up to SMALL edges are one partition. Only nodes that several partitions name go on to the
    next step, and every other one takes its star's label at the end.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    if near:
        held = materialise(pairs)
        few = held.count() <= SMALL
        stars = materialise((held.repartition(1) if few else held.repartitionByRange("u", "v")).mapInArrow(_contracted, "u long, v long").distinct())
        release(held)
        return _spread(stars) if few else _joined(stars)
    e = materialise(pairs.distinct())
    while not _settled(e):
        total = 2 * e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # each step is stored, for the next one reads it several times
        least = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("places")))
        large = salted_join(both, least, ["u"], ["v"], total).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node keeps its link to the least neighbour as well
        large = materialise(large.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct())
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("places")))
        moved = salted_join(large, low, ["u"], ["v"], total).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        old, e = e, materialise(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        release(old, least, large, low)
    return _spread(e)


def _spread(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _joined(stars: DataFrame) -> DataFrame:
    """Components of stars (u, v) that partitions made each on its own."""
    often = stars.select("u").unionByName(stars.select(F.col("v").alias("u")).distinct()).groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    links = materialise(stars.join(often.select("u"), "u", "left_semi"))
    rows, left = stars.count(), links.count()
    # where ranges don't shrink the graph by half, nodes that are linked aren't close: steps over all links then
    between = materialise(connected_components(links, "u", "v", near=2 * left <= rows or left <= SMALL))
    counted = between.select(F.col("node").alias("v"), "component").join(stars.groupBy("v").agg(F.count("*").alias("places")), "v")
    ends = salted_join(stars, counted, ["v"], ["u"], rows, how="left").select("u", "v", F.coalesce("component", "v").alias("component"))
    return ends.select(F.col("u").alias("node"), "component").unionByName(ends.select(F.col("v").alias("node"), "component")).distinct()
