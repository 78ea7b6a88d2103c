"""Whitening of embeddings by hierarchical SVD merging.

Every component c becomes the integer floor(scale * c) + offset. The fit list is each distinct integer vector once. A task
keeps of its rows their number n, the exact sums, and the factor diag(s) Vt of the singular value decomposition of the
centred rows, with all dimensions. Two such summaries merge without loss: their factors are stacked, a mean-correction row
sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2) is appended, and the stack is decomposed anew. Summaries merge as a tree of FAN_IN a
step, so no task and no driver ever holds rows: the result is one summary of dims * dims numbers.

The offset cancels in every centred figure, so the work is done on floor(scale * c) and loses no digits to a large offset.
Means are taken from the exact integer sums, and rows are centred by their block's mean before anything is multiplied.
The covariance of the whitened fit list is measured in a second pass, block by block, merged likewise.

Results for unusual input: rows whose vector is null or holds a null, NaN or infinity take no part; a null vec_id is kept as
null; rows with equal vectors count once in the fit and are all returned; floor(scale * c) is cut to +-2**61; a deviation
beyond a long is null; components whose eigenvalue is zero up to rounding (constant or dependent dimensions, one distinct
vector) have no unit variance and are left out, so there may be fewer than asked for, or none; vectors of different
lengths raise an error; empty vectors and an empty table give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, release
from .vectors import usable

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Rows that are decomposed together; summaries that one merge step brings together.
BLOCK, FAN_IN = 4096, 16
LIMIT = 2**61
_SUMMARY = "list long, n long, sums array<string>, factor binary"
_MOMENTS = "list long, n long, mean binary, moment binary"
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(column: pa.Array) -> np.ndarray:
    """Rows of a list column of longs; all must have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and (len(flat) % len(column) or (np.diff(column.offsets.to_numpy()) != len(flat) // len(column)).any()):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _sums(u: np.ndarray) -> list[int]:
    """Exact column sums, whatever their size."""
    if len(u) * max(1, int(np.abs(u).max(initial=0))) < LIMIT:
        return [int(x) for x in u.sum(0)]
    return [int(hi) * 2**32 + int(lo) for hi, lo in zip((u >> 32).sum(0), (u & 0xFFFFFFFF).sum(0), strict=True)]


def _factor(rows: np.ndarray) -> np.ndarray:
    """diag(s) Vt: what has the same inner products as the rows."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def summarise(u: np.ndarray) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, factor) of some rows."""
    sums = _sums(u)
    about = np.array([s // len(u) for s in sums], np.int64)  # exact differences first, then the fraction of the mean
    return len(u), sums, _factor((u - about).astype(float) - np.array([(s - int(a) * len(u)) / len(u) for s, a in zip(sums, about, strict=True)]))


def merge(a: tuple[int, list[int], np.ndarray], b: tuple[int, list[int], np.ndarray]) -> tuple[int, list[int], np.ndarray]:
    """The summary of the rows of both, with the row that corrects for their means."""
    (n, s, x), (m, t, y) = a, b
    if len(s) != len(t):
        raise ValueError("vectors differ in length")
    apart = np.array([(p * m - q * n) / (n * m) for p, q in zip(s, t, strict=True)])
    row = math.sqrt(n * m / (n + m)) * apart
    return n + m, [p + q for p, q in zip(s, t, strict=True)], _factor(np.concatenate([x, y, row[None]]))


def _rows(batches, column: str):
    """Blocks of rows, at least BLOCK (or four times the dimensions) each but for the last."""
    held, n = [], 0
    for batch in batches:
        u = integers(batch.column(column))
        held.append(u)
        n += len(u)
        if n and n >= max(BLOCK, 4 * u.shape[1]):
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        if len({x.shape[1] for x in held if len(x)}) > 1:
            raise ValueError("vectors differ in length")
        yield np.concatenate([x for x in held if len(x)])


def _list() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _summary_batch(place: int, s: tuple[int, list[int], np.ndarray]) -> pa.RecordBatch:
    n, sums, factor = s
    return pa.RecordBatch.from_arrays(
        [pa.array([place], pa.int64()), pa.array([n], pa.int64()), pa.array([[str(x) for x in sums]], pa.list_(pa.string())), pa.array([factor.astype("<f8").tobytes()], pa.binary())],
        ["list", "n", "sums", "factor"],
    )


def _summaries(batches):
    total = None
    for block in _rows(batches, "u"):
        one = summarise(block)
        total = one if total is None else merge(total, one)
    if total is not None:
        yield _summary_batch(_list(), total)


def _summary(row) -> tuple[int, list[int], np.ndarray]:
    sums = [int(x) for x in row["sums"]]
    return row["n"], sums, np.frombuffer(row["factor"], "<f8").reshape(-1, len(sums)) if sums else np.empty((0, 0))


def _merged(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["list"])
    total = _summary(rows[0])
    for r in rows[1:]:
        total = merge(total, _summary(r))
    return pa.Table.from_batches([_summary_batch(rows[0]["list"] // FAN_IN, total)])


def _tree(parts: DataFrame, merged, schema: str):
    """The one row that is left of the tasks' rows after merging FAN_IN of them a step; None without any."""
    parts = materialise(parts)
    lists = parts.agg(F.max("list").alias("n")).first()["n"]
    left, lists = parts, (-1 if lists is None else lists) + 1
    while lists > 1:
        left = left.withColumn("part", F.expr(f"list div {FAN_IN}")).groupBy("part").applyInArrow(lambda t: merged(t.drop_columns(["part"])), schema)
        lists = -(-lists // FAN_IN)
    row = left.first()
    release(parts)
    return row


def _whitened(u: np.ndarray, n: int, sums: list[int], v: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Projections of u - mean on the components, over sqrt(e)."""
    about = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - int(a) * n) / n for s, a in zip(sums, about, strict=True)])
    # row by row, so that equal vectors get equal values in any batch
    x = (u - about).astype(float) - rest
    out = np.empty((len(u), len(v)))
    for i, axis in enumerate(v):
        out[:, i] = (x * axis).sum(1)
    return out / np.sqrt(e)


def _deviation(u: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n * x - S)**2, exact; null beyond a long."""
    bound = n * int(np.abs(u).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if bound < 2**31 and u.shape[1] * bound * bound < 2**63:
        return pa.array(np.square(n * u - np.array(sums, np.int64)).sum(1))
    if bound < 2**62:
        d = n * u - np.array(sums, np.int64)
        near = np.square(d.astype(float)).sum(1) < 2.0**62  # then no square and no sum of them leaves a long
        exact = np.square(np.where(near[:, None], d, 0)).sum(1)
        others = [None if ok else sum(int(x) ** 2 for x in r) for ok, r in zip(near, d, strict=True)]
    else:
        exact, near = np.zeros(len(u), np.int64), np.zeros(len(u), bool)
        others = [sum((n * int(x) - s) ** 2 for x, s in zip(r, sums, strict=True)) for r in u]
    return pa.array([int(x) if ok else (y if y < 2**63 else None) for ok, x, y in zip(near, exact, others, strict=True)], pa.int64())


def _moments(model):
    def run(batches):
        total = None
        for block in _rows(batches, "u"):
            w = _whitened(block, *model)
            mean = w.mean(0)
            one = len(w), mean, (w - mean).T @ (w - mean)
            total = one if total is None else _add(total, one)
        if total is not None:
            yield _moment_batch(_list(), total)

    return run


def _add(a, b):
    (n, p, x), (m, q, y) = a, b
    d = q - p
    return n + m, p + d * (m / (n + m)), x + y + np.outer(d, d) * (n * m / (n + m))


def _moment_batch(place: int, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([s[0]], pa.int64()), *(pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in s[1:])], ["list", "n", "mean", "moment"])


def _moment(row):
    mean = np.frombuffer(row["mean"], "<f8")
    return row["n"], mean, np.frombuffer(row["moment"], "<f8").reshape(len(mean), len(mean))


def _added(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["list"])
    total = _moment(rows[0])
    for r in rows[1:]:
        total = _add(total, _moment(r))
    return pa.Table.from_batches([_moment_batch(rows[0]["list"] // FAN_IN, total)])


def _transformed(model, explained: np.ndarray, error: float):
    n, sums, v, _ = model
    k = len(v)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                u = integers(part.column("u"))
                if not len(u):
                    continue
                if u.shape[1] != len(sums):
                    raise ValueError("vectors differ in length")
                each = np.repeat(np.arange(len(u)), k)
                columns = [
                    part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(u))), pa.array(np.full(len(each), n)), _deviation(u, n, sums).take(pa.array(each)),
                    pa.array(_whitened(u, *model).ravel()), pa.array(np.tile(explained, len(u))), pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, u): u = floor(scale * component) of all rows that take part."""
    clean = usable_vectors(vectors)
    cut = F.transform("embedding", lambda c: F.greatest(F.least(F.floor(F.lit(float(scale)) * c.cast("double")), F.lit(LIMIT)), F.lit(-LIMIT)).cast("long"))
    return clean.select("vec_id", cut.alias("u"))


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """As ``usable``, but rows without an id stay."""
    kept = usable(vectors.select(F.struct(F.col("vec_id").cast("long").alias("v")).alias("vec_id"), "embedding"))
    return kept.select(F.col("vec_id.v").alias("vec_id"), "embedding")


def fit(fit_list: DataFrame, components: int = COMPONENTS):
    """(n, sums, components as rows, eigenvalues, trace) of the rows of a stored fit list; None without any component."""
    row = _tree(fit_list.mapInArrow(_summaries, _SUMMARY), _merged, _SUMMARY)
    if row is None:
        return None
    n, sums, factor = _summary(row)
    if not sums:
        return None
    _, s, vt = np.linalg.svd(factor, full_matrices=False)
    e = s * s / n
    real = s > s.max(initial=0) * max(len(sums), 1) * np.finfo(float).eps
    k = min(components, int(real.sum()))
    return (n, sums, vt[:k].copy(), e[:k].copy(), float(e.sum())) if k else None


def whiten(vectors: DataFrame, scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and each of its components."""
    rows = scaled(vectors, scale)
    fit_list = materialise(rows.select("u").distinct())
    model = fit(fit_list, components)
    if model is None:
        release(fit_list)
        return vectors.sparkSession.createDataFrame([], _OUT)
    *model, trace = model
    n, _, moment = _moment(_tree(fit_list.mapInArrow(_moments(tuple(model)), _MOMENTS), _added, _MOMENTS))
    release(fit_list)
    error = float(np.abs(moment / n - np.eye(len(moment))).max())
    return rows.mapInArrow(_transformed(tuple(model), model[3] / trace, error), _OUT)
