"""Quality classification by cumulative-link (proportional odds) regression on graded ratings.

Grades: 0 for toxic, 1 for low quality, 2 for good documents. One weight vector over hashed text gives a document's
position s; ordered thresholds t0 < t1 give P(grade <= k) = sigmoid(t_k - s). Features: square roots of the shares of byte
trigrams; which words and which beginnings of words (four bytes) occur, words being runs of letters, lower-cased A-Z; and
the share of words that repeat the one before. From the probabilities come the expected grade and the tail probability
P(grade = 2), by which documents are kept.

The regression is fitted on a bounded sample, in one task: at most ``most`` rated documents, those with the least hash of
doc_id, and only until their texts reach ``most_bytes``. Words get a weight if they are in ``LEAST_DOCUMENTS`` of them and
their chi-square against the grades is at least ``LEAST_CHI_SQUARE`` and ``LEAST_SHARE`` of the sample's size. Every
document is scored, from its whole text.

Results for unusual input: a null or empty text is scored as one without features; ratings without doc_id or quality are
left out, a null toxic counts as 0; several ratings of a document: the lowest grade counts; several texts of a rated
document: the least is learned from; without any rating every document is kept, at the top grade; equal texts get equal
scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import fitted, histograms, margins, sample
from .text import _LOWER, NOT_LETTER, Chunk, U, chunks, mix

MOST, MOST_BYTES, BUCKETS, WORD_BITS, ROUNDS, TAIL = 8000, 64 << 20, 2048, 18, 300, 0.5
LEAST_DOCUMENTS, LEAST_CHI_SQUARE, LEAST_SHARE = 8, 20.0, 0.0125
REPEATS, REPEAT_SCALE, BEGINNING, GRADES = 0, 40.0, 4, 3
_MODEL = "w binary, at binary, u binary, t0 double, t1 double"


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade)"""
    grade = F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).when(F.col("quality") < 1, 1).otherwise(2)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def _words(c: Chunk, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of a chunk's sparse features, each bucket once a document; only ``wanted`` buckets if given."""
    runs = Chunk(c.first, c.data, c.docs, NOT_LETTER)
    start, end, data = runs.start, runs.end, _LOWER[c.data]
    code = np.zeros(len(start), U)
    for i in range(BEGINNING if len(start) else 0):
        code = code * U(257) + np.where(start + i < end, data[np.minimum(start + i, len(data) - 1)], 0).astype(U)
    doc = np.repeat(np.arange(c.n), np.diff(runs.word_offsets))
    bucket = np.concatenate([(h >> U(64 - WORD_BITS)).astype(np.int64) | 1 for h in (runs.word_hashes(lower=True), mix(code, 5))])
    doc = np.concatenate([doc, doc])
    if wanted is not None:
        some = wanted[bucket]
        doc, bucket = doc[some], bucket[some]
    key = np.unique(doc << WORD_BITS | bucket)
    h, o = c.word_hashes(lower=True), c.word_offsets
    first = np.zeros(len(h) + 1, bool)
    first[o] = True
    again = np.concatenate([[0], np.cumsum(np.append(False, h[1:] == h[:-1])[: len(h)] & ~first[: len(h)])])
    share = (again[o[1:]] - again[o[:-1]]) / np.maximum(np.diff(o), 1)
    twice = np.flatnonzero(share)
    value = np.concatenate([np.ones(len(key)), REPEAT_SCALE * share[twice]])
    doc, bucket = np.concatenate([key >> WORD_BITS, twice]), np.concatenate([key & ((1 << WORD_BITS) - 1), np.full(len(twice), REPEATS)])
    order = np.argsort(doc, kind="stable")
    return doc[order], bucket[order], value[order]


def fit(x, owner, index, value, grade, buckets: int, rounds: int = ROUNDS, ridge: float = 1e-5, rate: float = 0.05):
    """Weights of dense and sparse features and the two thresholds, by Adam on the mean negative log likelihood."""
    w, u, t = np.zeros(x.shape[1], np.float32), np.zeros(buckets), np.array([-1.0, 0.5])  # second threshold = first + exp(t[1])
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, u, t)]
    n = len(grade)

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for i in range(1, rounds + 1):
        s = x @ w + np.bincount(owner, value * u[index], n)
        cut = np.array([-np.inf, t[0], t[0] + np.exp(t[1]), np.inf])
        hi, lo = sigmoid(cut[grade + 1] - s), sigmoid(cut[grade] - s)
        hi[grade == GRADES - 1], lo[grade == 0] = 1, 0
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        ds = (dhi - dlo) / n  # of the loss by s
        g0 = -(dhi[grade == 0].sum() + dhi[grade == 1].sum() - dlo[grade == 1].sum() - dlo[grade == 2].sum()) / n
        g1 = -(dhi[grade == 1].sum() - dlo[grade == 2].sum()) / n * np.exp(t[1])
        grads = (x.T @ ds.astype(np.float32) + np.float32(ridge) * w, np.bincount(index, value * ds[owner], buckets) + ridge * u, np.array([g0, g1]))
        for param, grad, (m, v) in zip((w, u, t), grads, state, strict=True):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            param -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-6)
    return w, u, (float(t[0]), float(t[0] + np.exp(t[1])))


def telling(owner: np.ndarray, index: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """Buckets whose occurrence depends on the grade."""
    n, total = len(grade), np.bincount(grade, minlength=GRADES)
    seen = np.stack([np.bincount(index[grade[owner] == k], minlength=1 << WORD_BITS) for k in range(GRADES)])
    docs = seen.sum(0)
    expected = docs * total[:, None] / n
    chi_square = ((seen - expected) ** 2 / np.maximum(expected, 1e-9)).sum(0) / np.maximum(1 - docs / n, 1e-9)
    out = (docs >= LEAST_DOCUMENTS) & (chi_square >= max(LEAST_CHI_SQUARE, LEAST_SHARE * n))
    out[REPEATS] = True
    return np.flatnonzero(out)


def _train(table: pa.Table) -> pa.Table:
    x = np.empty((len(table), BUCKETS), np.float32)
    parts = []
    for c in chunks(table["text"]):
        for a, b, part in histograms(c, BUCKETS):
            x[c.first + a : c.first + b] = part
        doc, bucket, value = _words(c)
        parts.append(((doc + c.first).astype(np.int32), bucket.astype(np.int32), value.astype(np.float32)))
    owner, index, value = (np.concatenate(p) for p in zip(*parts, strict=True))
    grade = table["grade"].to_numpy().astype(int)
    at = telling(owner, index, grade)
    place = np.full(1 << WORD_BITS, -1)
    place[at] = np.arange(len(at))
    keep = place[index] >= 0
    w, u, (t0, t1) = fit(x, owner[keep], place[index[keep]], value[keep], grade, len(at))
    return pa.table({"w": [w.tobytes()], "at": [at.astype(np.int64).tobytes()], "u": [u.tobytes()], "t0": [t0], "t1": [t1]})


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, most_bytes: int = MOST_BYTES):
    """(trigram weights, word weights by bucket, thresholds), or None without ratings."""
    rated = graded(labels).withColumn("hash", F.xxhash64("doc_id")).orderBy("hash").limit(most)
    some = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id").select("hash", "text", "grade")  # ``most`` pairs of numbers
    model = fitted(sample(some, most, most_bytes), _train, _MODEL)
    if model is None:
        return None
    u = np.zeros(1 << WORD_BITS)
    u[np.frombuffer(model["at"], np.int64)] = np.frombuffer(model["u"])
    return np.frombuffer(model["w"], np.float32), u, (model["t0"], model["t1"])


def _scored(model):
    def run(batches):
        fitted = model.value
        for batch in batches:
            for c in chunks(batch.column("text")):
                rows = [batch.column(n).slice(c.first, c.n) for n in batch.schema.names]
                if fitted is None:
                    yield pa.RecordBatch.from_arrays([*rows, pa.array(np.full(c.n, GRADES - 1.0)), pa.array(np.ones(c.n))], [*batch.schema.names, "expected_grade", "tail"])
                    continue
                w, u, (t0, t1) = fitted
                doc, bucket, value = _words(c, u != 0)
                s = np.bincount(doc, value * u[bucket], c.n)
                for a, b, x in histograms(c, BUCKETS):
                    s[a:b] += margins(x, w[:, None])[:, 0]
                above = [1 / (1 + np.exp(np.clip(t - s, -500, 500))) for t in (t0, t1)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(above[0] + above[1]), pa.array(above[1])], [*batch.schema.names, "expected_grade", "tail"])

    return run


def scored(docs: DataFrame, labels: DataFrame, most: int = MOST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents with expected_grade (0 to 2) and tail = P(grade = 2)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most, most_bytes))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scored(model), f"{kinds}, expected_grade double, tail double")


def grade_documents(docs: DataFrame, labels: DataFrame, most: int = MOST, tail: float = TAIL) -> DataFrame:
    """doc_id, expected_grade, tail and kept for every document."""
    return scored(docs.select("doc_id", "text"), labels, most).drop("text").withColumn("kept", F.col("tail") >= tail)


def good_documents(docs: DataFrame, labels: DataFrame, most: int = MOST, tail: float = TAIL) -> DataFrame:
    """The documents that are likely of the top grade, unchanged."""
    clash = [c for c in docs.columns if c.lower() in ("expected_grade", "tail")]
    renamed = docs.withColumnsRenamed({c: f"{c}__own" for c in clash})
    out = scored(renamed, labels, most).where(F.col("tail") >= tail).drop("expected_grade", "tail")
    return out.withColumnsRenamed({f"{c}__own": c for c in clash})
