"""Target-distribution importance resampling over hashed word n-grams.

Texts become a table of word positions; windows over a document's positions give each word those that follow it, and the
words of every order are joined, hashed and counted. A bucket's gain compares its share of the target texts with its share
of the corpus; a document's weight sums the gains of its features, and Gumbel noise made of its id turns the largest sums into
a draw without replacement in proportion to exp(weight / 1000).

A document is cut into segments of SEGMENT words, each with the words that its last features need from the next one, so a
window holds a segment and never a whole document. Segments are shuffled as text, and words are lined up after that, so the
shuffle carries no row per word. The buckets of all positions are stored once (six bytes a word before compression): one
pass counts them, a second one joins the gains, a table of as many rows as there are buckets.

Results for unusual input: a null text, or one without words, has no feature, weight 0 and no part in the draw; a null doc_id
counts as an empty string in the noise and comes last among ties; rows of one doc_id are documents of their own with the same noise, and
equal rows are interchangeable; fewer than 100 / ``percent`` eligible documents may leave none drawn; empty target texts or an empty
corpus give gains from the smoothing alone; other columns are ignored. Rows are told apart by their
place in the input, which one job assigns and stores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from ..runtime import materialise, release

ORDERS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42
#: Words of a window; bytes of text that one task lines up.
SEGMENT, TASK_BYTES = 4096, 64 << 20
#: What stands between words once A-Z count as letters: all other ASCII characters but digits.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; without other letters than ASCII that is what lower does."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def positions(texts: DataFrame, orders: int = ORDERS, segment: int = SEGMENT) -> DataFrame:
    """Of (row, id, text): (row, id, words, segment, place, f1, f2, ...), a row for each word with the features that begin there;
    a text without words has one row without features."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES + 1)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), BETWEEN), lambda w: w != "")
    cut = texts.select("row", "id", words.alias("all")).withColumn("words", F.size("all"))
    cut = cut.withColumn("segment", F.explode(F.sequence(F.lit(0), F.greatest(F.col("words") - 1, F.lit(0)), F.lit(segment))))
    cut = cut.select("row", "id", "words", "segment", F.array_join(F.slice("all", F.col("segment") + 1, segment + orders - 1), " ").alias("text"))
    lined = cut.repartition(tasks, "row", "segment").select("row", "id", "words", "segment", F.posexplode(F.split("text", " ")).alias("place", "word"))
    lined = lined.withColumn("word", F.when(F.col("words") > 0, _lower(F.col("word"))))
    along = W.partitionBy("row", "segment").orderBy("place")
    lined = lined.select("*", *(F.lead("word", i).over(along).alias(f"w{i}") for i in range(1, orders))).where(F.col("place") < segment)
    features = [F.col("word")]
    for i in range(1, orders):
        features.append(F.concat(features[-1], F.lit(" "), F.col(f"w{i}")))  # null where the words end
    return lined.select("row", "id", "words", "segment", "place", *(f.alias(f"f{i + 1}") for i, f in enumerate(features)))


def bucketed(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, segment: int = SEGMENT) -> DataFrame:
    """(row, id, words, b1, b2, ...): each position's features as buckets."""
    at = positions(texts, orders, segment)
    return at.select("row", "id", "words", *(F.pmod(F.crc32(F.col(f"f{i}").cast("binary")), F.lit(buckets)).cast("int").alias(f"b{i}") for i in range(1, orders + 1)))


def _each(at: DataFrame, orders: int) -> DataFrame:
    return at.select("row", "id", "words", F.explode(F.array(*(f"b{i}" for i in range(1, orders + 1)))).alias("bucket"))


def counts(at: DataFrame, orders: int, name: str) -> DataFrame:
    return _each(at, orders).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))


def gains(corpus: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of bucketed corpus and target texts: one row for each of ``buckets``."""
    both = counts(corpus, orders, "s").join(counts(target, orders, "t"), "bucket", "full")
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left").na.fill(0, ["s", "t"])
    # bounded by the number of buckets, so one window over all of them is small
    every = every.withColumns({f"all_{x}": F.sum(x).over(W.partitionBy()).cast("double") for x in ("s", "t")})
    ratio = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets))
    return every.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 2.0**32))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: float = PERCENT, orders: int = ORDERS, buckets: int = BUCKETS, least: int = LEAST_WORDS, seed: int = SEED, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every document; of those with at least ``least`` words the best ``percent`` of 100 are ranked."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    corpus = materialise(bucketed(texts, orders, buckets, segment))
    wanted = bucketed(target.select(F.lit(0).alias("id"), F.monotonically_increasing_id().alias("row"), "text"), orders, buckets, segment)
    gain = materialise(gains(corpus, wanted, orders, buckets))
    # the gains have one row for each bucket: bounded whatever the corpus
    sums = _each(corpus, orders).join(F.broadcast(gain), "bucket", "left").groupBy("row", "id").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"), (F.max("words") >= least).alias("eligible"))
    scored = materialise(sums.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    release(corpus, gain)
    drawn = math.floor(percent * scored.where("eligible").count() / 100)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("row")]
    ranked = numbered(scored.where("eligible"), "rank", *order).withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    out = [F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(scored.where("NOT eligible").withColumn("rank", F.lit(None).cast("long")).select(*out))


#: The remainders of all bytes are made by the rule; every distinct feature is hashed once, byte by byte.
SQL = r"""
WITH RECURSIVE bits(n, k, c) AS (SELECT n, 0, n FROM range(256) t(n) UNION ALL SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY n) AS tab FROM bits WHERE k = 8),
txt AS (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
w AS MATERIALIZED (SELECT side, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM txt),
g AS MATERIALIZED (SELECT side, id, array_to_string(w[i : i + k - 1], ' ') AS f, count(*) AS n FROM (SELECT side, id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
h AS MATERIALIZED (SELECT f, xor(4294967295, list_reduce(list_transform(range(0, octet_length(encode(f))), lambda i: (strpos('0123456789ABCDEF', hex(encode(f))[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', hex(encode(f))[2 * i + 2]) - 1),
  lambda a, b: xor(a // 256, tab[xor(a, b) % 256 + 1]), 4294967295)) % 10000 AS b FROM (SELECT DISTINCT f FROM g), tab),
c AS (SELECT b, sum(n) FILTER (side = 's') AS s, sum(n) FILTER (side = 't') AS t FROM g JOIN h USING (f) GROUP BY b),
a AS (SELECT k AS b, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t, (SELECT coalesce(sum(s), 0) FROM c)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM c)::DOUBLE AS all_t FROM range(10000) r(k) LEFT JOIN c ON c.b = k),
gain AS (SELECT b, CAST(floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM a),
x AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM g JOIN h USING (f) JOIN gain USING (b) WHERE side = 's' GROUP BY id),
y AS (SELECT w.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || w.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score, len(w) >= 20 AS able
  FROM w LEFT JOIN x ON x.id = w.id WHERE side = 's'),
z AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= floor(5 * n / 100) THEN place END AS rank FROM z
"""
