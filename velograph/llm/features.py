"""Hashed text features shared by the classifiers, and the bounded sample they are fitted on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialise, release
from .text import Chunk

#: Rows whose histograms are held at once.
ROWS = 256


def histograms(c: Chunk, buckets: int, n: int = 3) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, matrix): square roots of the shares of hashed byte ``n``-grams, for some documents at a time."""
    bits = buckets.bit_length() - 1
    for a in range(0, c.n, ROWS):
        b = min(a + ROWS, c.n)
        lo, hi = c.docs[a], c.docs[b]
        data = c.data[lo:hi].astype(np.uint32)
        if len(data) < n:
            yield a, b, np.zeros((b - a, buckets), np.float32)
            continue
        code = np.zeros(len(data) - n + 1, np.uint32)
        for i in range(n):
            code = code * np.uint32(0x9E3779B1) + data[i : len(data) - n + 1 + i] * np.uint32(0x85EBCA77)
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - bits)
        grams = np.maximum(np.diff(c.docs[a : b + 1]) - n + 1, 0)
        first = c.docs[a:b] - lo
        at = np.arange(grams.sum()) + np.repeat(first - (np.cumsum(grams) - grams), grams)
        cell = np.repeat(np.arange(b - a) * buckets, grams) + code[at]
        counts = np.bincount(cell, minlength=(b - a) * buckets).reshape(b - a, buckets)
        yield a, b, np.sqrt(counts / np.maximum(grams, 1)[:, None]).astype(np.float32)


def margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, each row summed on its own: a text's result doesn't depend on the rows that it shares a batch with."""
    out = np.empty((len(x), w.shape[1]), np.float32)
    for i in range(w.shape[1]):
        out[:, i] = (x * w[:, i]).sum(1)
    return out


def sample(rows: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """A stored sample of ``rows`` (hash, text, others): one row a hash (its least), those with the least hashes, at most
    ``most`` and only until their texts reach ``most_bytes`` (the text that does so is the last). The same whatever the partitions."""
    cut = rows.select("hash").distinct().orderBy("hash").limit(most).agg(F.max("hash").alias("cut")).first()["cut"]
    others = [c for c in rows.columns if c != "hash"]
    once = rows.where(F.col("hash") <= F.lit(cut)).groupBy("hash").agg(F.min(F.struct(*others)).alias("r"))
    some = materialise(once.select("hash", "r.*"))
    # the running sum is over ``most`` pairs of numbers at most
    before = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(W.orderBy("hash").rowsBetween(W.unboundedPreceding, -1))
    last = some.select("hash", before.alias("before")).where(F.coalesce("before", F.lit(0)) < most_bytes).agg(F.max("hash").alias("last")).first()["last"]
    out = some.where(F.col("hash") <= F.lit(last))
    out._table = some._table
    return out


def fitted(some: DataFrame, fit: Callable[[pa.Table], pa.Table], schema: str) -> Row | None:
    """What ``fit`` makes of a sample in one task (a row), or None without rows; the sample is released."""
    model = some.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: fit(t.sort_by("hash").combine_chunks()), schema).first()
    release(some)
    return model
