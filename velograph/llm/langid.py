"""Language identification by error-correcting output codes over byte n-grams.

Every language gets a codeword of bits; for each bit a binary logistic classifier over hashed byte trigrams predicts it.
A text gets the language whose codeword loses least, each bit's loss weighted by the classifier's own margin (log loss of
bit times margin). The score is the share of exp(-loss) among the languages; a text whose two best codewords are closer
than ``ambiguity`` in loss is flagged. Codewords: all distinct splits of the languages while there are five at most,
otherwise random ones drawn to be far apart.

The classifiers are fitted on a bounded sample, in one task: at most ``most`` documents, those with the least hash of doc_id
among the learnable ones (text and language given, and crc32 of doc_id mod 4 not 2), and only until their texts reach
``most_bytes``. All documents are predicted, from their whole texts.

Results for unusual input: a null text or one without letters is ``und`` with score 0 and ambiguous; a null doc_id is never
learned from and not held out; of several rows with one doc_id the least text is learned from; equal texts get equal
results; with one learnable language all texts with letters get it, with none all are ``und``; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import fitted, histograms, margins, sample
from .text import chunks

MOST, MOST_BYTES, BUCKETS, ROUNDS, AMBIGUITY = 4000, 64 << 20, 4096, 150, 0.5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """(languages, bits) of +1 and -1, with no constant bit."""
    if languages < 2:
        return np.zeros((languages, 0))
    if languages <= 5:
        splits = np.arange(1, 1 << (languages - 1))
        return np.where(splits[None, :] >> np.arange(languages)[:, None] & 1, 1.0, -1.0)
    bits = int(np.ceil(10 * np.log2(languages)))
    rng, best = np.random.default_rng(seed), (-1, None)
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (languages, bits))
        apart = (bits - code @ code.T) / 2 + bits * np.eye(languages)
        if (np.abs(code.sum(0)) < languages).all() and apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


def fit(x: np.ndarray, bits: np.ndarray, rounds: int = ROUNDS, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Logistic classifiers for all bits at once, by accelerated gradient steps."""
    scale = 16.0  # the features have unit length, so weights are large
    x = x * np.float32(scale)
    w, v = np.zeros((x.shape[1], bits.shape[1]), np.float32), np.zeros((x.shape[1], bits.shape[1]), np.float32)
    b = bv = np.zeros(bits.shape[1], np.float32)
    step = 4 / (scale * scale + 1)
    for i in range(rounds):
        wait = i / (i + 3)
        lw, lb = w + wait * (w - v), b + wait * (b - bv)
        pull = -bits / (1 + np.exp(np.clip(bits * (x @ lw + lb), -30, 30))) / len(x)
        v, bv = w, b
        w = (lw - step * (x.T @ pull + ridge * lw)).astype(np.float32)
        b = (lb - step * pull.sum(0)).astype(np.float32)
    return w * np.float32(scale), b


def decode(margin: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its score, and how much more the second one loses."""
    loss = np.logaddexp(0, -margin[:, None, :] * code[None]).sum(2)
    order = np.sort(loss, axis=1)
    share = np.exp(order[:, :1] - loss)
    gap = order[:, 1] - order[:, 0] if code.shape[0] > 1 else np.full(len(margin), np.inf)
    return loss.argmin(1), (1 / share.sum(1)), gap


def _train(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        named = table["lang"].to_pylist()
        languages = sorted(set(named))
        code = codewords(len(languages))
        w, b = np.zeros((2, 0), np.float32), np.zeros(0, np.float32)
        if len(languages) > 1:
            x = np.empty((len(table), buckets), np.float32)
            for c in chunks(table["text"]):
                for lo, hi, part in histograms(c, buckets):
                    x[c.first + lo : c.first + hi] = part
            place = {n: i for i, n in enumerate(languages)}
            w, b = fit(x, code[[place[n] for n in named]].astype(np.float32))
        return pa.table({"languages": [languages], "w": [w.tobytes()], "b": [b.astype(np.float32).tobytes()]})

    return run


def _predict(model, ambiguity: float):
    def run(batches):
        languages, code, w, b = model.value
        for batch in batches:
            for c in chunks(batch.column("text")):
                for lo, hi, x in histograms(c, w.shape[0] if len(w) else 2):
                    letters = batch.column("letters").slice(c.first + lo, hi - lo)
                    known = letters.to_numpy(zero_copy_only=False).astype(bool) & bool(languages)
                    best, score, gap = decode(margins(x, w) + b, code) if languages else (np.zeros(hi - lo, int),) * 3
                    names = pa.array(np.where(known, np.array(languages or ["und"], object)[best], "und"), pa.string())
                    yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(c.first + lo, hi - lo) for n in ("doc_id", "held_out")), names, pa.array(np.where(known, score, 0.0)), pa.array(~known | (gap < ambiguity))], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def train(docs: DataFrame, most: int = MOST, most_bytes: int = MOST_BYTES, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, codewords, weights and offsets."""
    rows = docs.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id")))
    some = sample(rows.select(F.xxhash64("doc_id").alias("hash"), "text", "lang"), most, most_bytes)
    model = fitted(some, _train(buckets), "languages array<string>, w binary, b binary")
    languages = list(model["languages"]) if model else []
    b = np.frombuffer(model["b"], np.float32) if model else np.zeros(0, np.float32)
    w = np.frombuffer(model["w"], np.float32).reshape(-1, len(b)) if len(b) else np.zeros((2, 0), np.float32)
    return languages, codewords(len(languages)), w, b


def identify(docs: DataFrame, most: int = MOST, most_bytes: int = MOST_BYTES, buckets: int = BUCKETS, ambiguity: float = AMBIGUITY) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous for every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, most, most_bytes, buckets))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(_predict(model, ambiguity), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
