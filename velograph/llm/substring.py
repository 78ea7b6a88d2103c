"""Substring deduplication on a compacted De Bruijn graph.

The graph's edges are the corpus' k-mers of ``length`` words (windows); its nodes are what neighbouring windows share. A window
is repeated if its edge is traversed at least twice.

1. Neighbouring windows with one *anchor* (the ``k`` words with the least hash in them, leftmost first) form a span: a path of
   edges that can be named by its words. A span whose anchor occurs once holds no repeated window and goes.
2. Spans with the same words are traversals of one path. A path is joined to the one after it where neither end branches:
   its traversals all go on in the same path, and no other path leads there, texts' ends counting as branches. Pointer
   doubling over these links compacts chains of spans to long paths; as nothing branches, every traversal of a chain's head
   is one of the whole chain.
3. Each traversal is verified by its source coordinates: its words are read again and identified by 128 bits that are
   independent of the names. If any chain's traversals differ (a clash of names), the job starts again without chains.
4. Spans whose anchor stands among different words: there the graph branches within the span. One traversal of each such path
   is read again window by window, and windows are counted by 128 bits. Only those of paths traversed once are in doubt.

Anchors, names and windows that very many rows have are dealt to several tasks (``salted_join``). Texts go through shuffles
as zstd frames.

Results for unusual input: null and empty texts have no words and nothing is removed; texts shorter than a window
stay whole; rows with equal doc_id or equal text are different places, so their windows count as repeated; an empty
table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import salted_join
from ..runtime import materialise, release
from .text import Sequences, chunks, packed, sliding_min, unpacked, windows

WINDOW = 35
K = 8


def _anchored(offsets: np.ndarray, seq: Sequences, length: int, k: int):
    """Spans of neighbouring windows with one anchor: first window, windows, document, anchor's hash."""
    first, doc = windows(offsets, length)
    if not len(first):
        return None
    begin = np.arange(len(seq.words) - k + 1)
    grams = seq.first(begin, begin + k)
    order = np.argsort(grams, kind="stable")  # of equal grams the leftmost comes first
    rank = np.empty(len(grams), np.int64)
    rank[order] = begin
    at = order[sliding_min(rank, length - k + 1)[first]]
    new = np.ones(len(first), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(first)))
    return first[head], count, doc[head], grams[at[head]]


def _spans(length: int, k: int):
    """Each text's spans; ``after`` is the next span's name, 0 at the text's end."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("anchor", pa.int64()), ("body", pa.int64()), ("after", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])

    def run(batches):
        for batch in batches:
            row, doc_id = batch.column("row").to_numpy(), batch.column("doc_id")
            for c in chunks(batch.column("text")):
                seq = Sequences(c.word_hashes())
                if (found := _anchored(c.word_offsets, seq, length, k)) is None:
                    continue
                first, count, doc, anchor = found
                # where the anchor stands in the span counts too: equal words give equal anchors, so the words suffice
                body = seq.first(first, first + count + length - 1) | np.uint64(1)
                after = np.where(np.append(doc[1:] == doc[:-1], False), np.roll(body, -1), np.uint64(0))
                here = pa.array(doc + c.first)
                names = [pa.array(x.view(np.int64)) for x in (anchor, body, after)]
                yield pa.record_batch([pa.array(row[doc + c.first]), doc_id.take(here), *names, pa.array((first - c.word_offsets[doc]).astype(np.int32)), pa.array(count.astype(np.int32))], schema)

    return run


def _packed(batches):
    for batch in batches:
        for first in range(0, len(batch), 1024):
            part = batch.slice(first, 1024)
            yield pa.RecordBatch.from_arrays([packed(part.column(n)) if n == "text" else part.column(n) for n in batch.schema.names], batch.schema.names)


def _nested(lists, names: list[str]):
    """The fields of a list column's structs, one after the other, and the row of each."""
    flat = lists.flatten()
    return [flat.field(n).to_numpy(zero_copy_only=False) for n in names], np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy())


def _chunks_with(batch, names: list[str]):
    """Chunks of a batch's packed texts, each with the fields of its spans and the document of each."""
    for first, texts in unpacked(batch.column("text")):
        for c in chunks(texts):
            c.first += first
            yield c, *_nested(batch.column("spans").slice(c.first, c.n), names)


def _reread(length: int):
    """128 bits for every traversal of a chain as a whole, and for the other spans' windows one by one (path 0)."""
    schema = pa.schema([("path", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("doubtful", pa.bool_())])

    def run(batches):
        for batch in batches:
            row, doc_id = batch.column("row").to_numpy(), batch.column("doc_id")
            for c, (path, at, n, doubtful), doc in _chunks_with(batch, ["path", "at", "n", "doubtful"]):
                single = path == 0
                times = np.where(single, n, 1)
                each = np.repeat(np.arange(len(at)), times)
                if not len(each):
                    continue
                inner = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                seq = Sequences(c.word_hashes(), c.other_hashes())
                start = c.word_offsets[doc[each]] + at[each] + inner
                many = np.where(single, 1, n)[each]
                end, here = start + many + length - 1, doc[each] + c.first
                hashes = [pa.array(h(start, end).view(np.int64)) for h in (seq.first, seq.second)]
                yield pa.record_batch([pa.array(path[each]), *hashes, pa.array(row[here]), doc_id.take(pa.array(here)), pa.array((at[each] + inner).astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(doubtful[each])], schema)

    return run


def _cut(length: int, with_text: bool):
    """Remove the words that the repeated windows cover."""

    def run(batches):
        for batch in batches:
            for c, (at, n), doc in _chunks_with(batch, ["at", "n"]):
                at, n = at.astype(np.int64), n.astype(np.int64)
                offsets, words = c.word_offsets, len(c.start)
                cover = np.zeros(words + 1, np.int64)
                begin = offsets[doc] + at
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + n + length - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                keep = ~gone
                edge = np.zeros(len(c.data) + 1, np.int8)
                edge[c.start[keep]] += 1
                # the separator after a kept word becomes its space; at a document's end there is none
                stop = np.minimum(c.end + 1, np.repeat(c.docs[1:], np.diff(offsets)))
                np.subtract.at(edge, stop[keep], 1)
                mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
                data = c.data.copy()
                inside = np.zeros(len(data) + 1, np.int8)
                inside[c.start] += 1
                np.subtract.at(inside, c.end, 1)
                data[np.cumsum(inside[:-1], dtype=np.int8) == 0] = 32
                removed = np.concatenate([[0], np.cumsum(gone)])[offsets]
                texts = [data[s:e][mask[s:e]].tobytes().rstrip(b" ") for s, e in zip(c.docs[:-1], c.docs[1:], strict=True)]
                counts = [pa.array(np.diff(offsets)), pa.array(np.diff(removed))]
                if with_text:
                    own = [x for x in batch.schema.names if x not in ("row", "spans", "text")]
                    # what loses nothing stays as it was, nulls and white space included
                    held = [t if n else o.tobytes() if v else None for t, n, o, v in zip(texts, np.diff(removed), np.split(c.data, c.docs[1:-1]), batch.column("text").slice(c.first, c.n).is_valid().to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(c.first, c.n) for x in own), *counts, pa.array(held, pa.binary()).cast(pa.string())], [*own, "n_words", "n_removed", "text"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.first, c.n), *counts, pa.array([hashlib.sha256(t).hexdigest() for t in texts])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _located(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), *columns)


def chains(paths: DataFrame) -> DataFrame:
    """(body, n, chain, skip, done): each path's chain, named by its first path, and the edges before it there.

    ``paths`` has body, n (edges), places (traversals), lo and hi (the least and the largest name of what comes after).
    """
    # no branch at the end: one successor. None where that begins: one predecessor, with as many traversals
    onward = paths.where("lo = hi AND lo <> 0 AND lo <> body").groupBy(F.col("lo").alias("next")).agg(F.count("*").alias("ways"), F.min("body").alias("before"), F.min("n").alias("skip"), F.min("places").alias("places_"))
    onward = onward.where("ways = 1").select("next", "before", "skip", "places_")
    joined = paths.join(onward, (F.col("body") == F.col("next")) & (F.col("places") == F.col("places_")), "left")
    now = materialise(joined.select("body", "n", F.coalesce("before", "body").alias("chain"), F.coalesce("skip", F.lit(0)).cast("long").alias("skip"), F.col("before").isNull().alias("done")))
    # traversals end with their texts, so there are no cycles; each round doubles the distance covered
    while not now.where("NOT done").isEmpty():
        ahead = now.select(F.col("body").alias("chain"), F.col("chain").alias("chain_"), F.col("skip").alias("skip_"), F.col("done").alias("done_"))
        moved = now.where("NOT done").join(ahead, "chain").select("body", "n", F.col("chain_").alias("chain"), (F.col("skip") + F.col("skip_")).alias("skip"), F.col("done_").alias("done"))
        old, now = now, materialise(now.where("done").unionByName(moved))
        release(old)
    return now


def repeated_spans(docs: DataFrame, length: int = WINDOW, k: int = K, compact: bool = True) -> DataFrame:
    """(row, doc_id, spans): for each document with repeated windows, runs of them as (at, n) in words."""
    base = _located(docs, ["doc_id", "text"])
    spans = materialise(base.mapInArrow(_spans(length, k), "row long, doc_id long, anchor long, body long, after long, at int, n int"))
    anchors = materialise(spans.groupBy("anchor").agg(F.count("*").alias("places")).where("places > 1"))
    found = materialise(salted_join(spans, anchors, ["anchor"], ["row", "at"], _sum(anchors)).drop("places"))
    release(spans, anchors)

    first = F.min(F.struct("row", "doc_id", "at")).alias("rep")
    paths = materialise(found.groupBy("anchor", "body").agg(F.count("*").alias("places"), F.min("n").alias("n"), F.min("after").alias("lo"), F.max("after").alias("hi"), first))
    if compact:
        # chains of paths traversed at least twice: their heads' traversals are read again as a whole
        links = chains(paths.where("places > 1"))
        wholes = links.groupBy(F.col("chain").alias("body")).agg(F.max(F.col("skip") + F.col("n")).cast("int").alias("whole"))
        # one lookup tells every traversal what its path is: a chain's head (how long the chain is), one of those that a head
        # stands for, or one whose anchor stands among different words, where the graph branches within the span
        ways = paths.groupBy("anchor").agg((F.count("*") > 1).alias("branching"), F.sum("places").alias("places"))
        known = salted_join(paths.withColumnRenamed("places", "traversals"), ways, ["anchor"], ["body"], _sum(paths)).drop("places").withColumnRenamed("traversals", "places")
        known = materialise(known.join(wholes, "body", "left").select("anchor", "body", "places", "branching", "rep", F.when(F.col("places") > 1, F.col("whole")).alias("whole")))
        release(links)
        told = salted_join(found.select("anchor", "body", "row", "doc_id", "at", "n"), known, ["anchor", "body"], ["row", "at"], _sum(known))
        here = F.struct("row", "doc_id", "at").eqNullSafe(F.col("rep"))
        chain, one = (F.struct(path.alias("path"), "at", n.alias("n"), doubtful.alias("doubtful")) for path, n, doubtful in ((F.col("body"), F.col("whole"), F.lit(False)), (F.lit(0).cast("long"), F.col("n"), F.col("places") == 1)))
        asked = told.withColumn("a", F.array_compact(F.array(F.when(F.col("whole").isNotNull(), chain), F.when(F.col("branching") & here, one))))
    else:
        asked = found.withColumn("a", F.array(F.struct(F.lit(0).cast("long").alias("path"), "at", "n", F.lit(True).alias("doubtful"))))
    asked = asked.where(F.size("a") > 0).groupBy("row", "doc_id").agg(F.flatten(F.collect_set("a")).alias("spans"))
    kinds = "path long, h1 long, h2 long, row long, doc_id long, at int, n int, doubtful boolean"
    read = materialise(_join(base.mapInArrow(_packed, "row long, doc_id long, text binary"), asked, "inner").mapInArrow(_reread(length), kinds))
    release(found, paths, *([known] if compact else []))

    verified = read.where("path <> 0")
    ends = [f(h).alias(f"{n}_{h}") for h in ("h1", "h2") for n, f in (("min", F.min), ("max", F.max))]
    if compact and not verified.groupBy("path").agg(*ends).where("min_h1 <> max_h1 OR min_h2 <> max_h2").isEmpty():
        return repeated_spans(docs, length, k, compact=False)
    single = read.where("path = 0")
    again = materialise(single.groupBy("h1", "h2").agg(F.count("*").alias("places")).where("places > 1"))
    repeated = salted_join(single.where("doubtful").select("h1", "h2", "row", "doc_id", "at", "n"), again, ["h1", "h2"], ["row", "at"], _sum(again))
    both = repeated.select("row", "doc_id", "at", "n").unionByName(verified.select("row", "doc_id", "at", "n"))
    return both.groupBy("row", "doc_id").agg(F.collect_set(F.struct("at", "n")).alias("spans"))


def _sum(counted: DataFrame) -> int:
    return counted.agg(F.coalesce(F.sum("places"), F.lit(0)).alias("n")).first()["n"]


def _join(base: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    right = spans.withColumnsRenamed({"row": "row_", "doc_id": "doc_id_"})
    return base.join(right, (F.col("row") == F.col("row_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_")), how).drop("row_", "doc_id_")


def remove_repeats(docs: DataFrame, length: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by single spaces."""
    base = _located(docs, ["doc_id", "text"]).mapInArrow(_packed, "row long, doc_id long, text binary")
    return _join(base, repeated_spans(docs, length, k), "left").mapInArrow(_cut(length, False), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def clean_documents(docs: DataFrame, length: int = WINDOW, k: int = K) -> DataFrame:
    """The documents with repeated passages cut out; those of nothing else go. Untouched texts stay as they are; n_chars follows the text."""
    columns = docs.columns
    # the other columns travel as one, so that their names can't meet those used here
    rest = F.struct(*(F.col(c) for c in columns if c != "text")).alias("rest")
    base = _located(docs, ["doc_id", "text", rest])
    kinds = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "text" else f for f in base.schema.fields])
    out = T.StructType([*base.drop("row", "text").schema.fields, *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("text", T.StringType())))])
    cut = _join(base.mapInArrow(_packed, kinds), repeated_spans(docs, length, k), "left").mapInArrow(_cut(length, True), out).where("n_words = 0 OR n_removed < n_words")
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("rest.n_chars")) if "n_chars" in columns else None
    return cut.select(*(F.col("text") if c == "text" else size.alias(c) if c == "n_chars" else F.col("rest")[c].alias(c) for c in columns))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM p),
again AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM h WHERE h IN (SELECT h FROM again))),
u AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, w FROM d),
k AS (SELECT u.r, string_agg(u.w[u.j], ' ' ORDER BY u.j) AS kept, count(*) AS n FROM u LEFT JOIN gone g ON u.r = g.r AND u.j = g.j WHERE g.j IS NULL GROUP BY u.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""
