r"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame functions only.

Target of a source: its weight's share of all words, but at most ``cap`` times the words it has; the excess goes to the
others by weight. That is min(cap * size, level * weight) with one common level, which a running sum over the sources in
order of cap * size / weight finds.

A source's documents in shuffled order (by MD5 of doc_id and text) are cut into equal blocks of ``block`` words or, as they
rarely come out even, one less. It wants as many blocks as its target holds. Schedule: slot n = 0, 1, ... takes the
golden-ratio point frac(n * 0.618...), in 32-bit fixed point, and so falls to the source whose stretch of the cumulative wants
holds it. A source's r-th slot takes its (r mod blocks)-th block, going round at most ``cap`` times.
Ranks and running sums are made in steps (within buckets, then over bucket totals), so no source meets in one task.

Results for unusual input: a null or empty text has size 0 and nothing is taken from it; a null source is a source of its
own, last in order; rows with equal doc_id and other text are separate documents, equal rows get equal values up to order; an
empty table gives an empty result; a source without words has target 0; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..runtime import materialise

BLOCK, CAP, WEIGHTS = 32, 3, (1, 2, 3)
#: 2**32 / golden ratio, odd; slots of one chunk are ranked together, and so are the totals of as many chunks.
GOLDEN, CHUNK = 2654435769, 4096
WORDS = r"[^\x20\x09-\x0D]+"


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _shuffle_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")))))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """(source, source_size, target, blocks, base, extra, wanted, lo, hi): the first ``extra`` blocks have base + 1 words, the
    others base; lo and hi bound the source's stretch of [0, 2**32)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    rank = W.orderBy(F.col("source_size") * cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = rank.rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rank.rowsBetween(0, W.unboundedFollowing))
    # with the sources before it capped, does this one still reach its cap? The first that doesn't sets the level.
    leveled = weighed.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= cap * F.col("source_size"))
    common = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") * cap / F.col("weight"), F.col("level").alias("level")))).over(whole)["level"]
    target = leveled.withColumn("target", F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(common * F.col("weight")))
    size, blocks = F.col("source_size"), F.col("blocks")
    target = target.withColumn("blocks", F.ceil(size / block)).withColumns({
        "base": F.when(blocks > 0, F.floor(size / blocks)).otherwise(0),
        "extra": F.when(blocks > 0, size % blocks).otherwise(0),
        "wanted": F.when(blocks > 0, F.floor(F.col("target") * blocks / size + 0.5)).otherwise(0),
    })
    upto = F.sum("wanted").over(order.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("wanted").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    hi = F.when(total > 0, F.floor(upto / total * F.lit(2**32)).cast("long")).otherwise(F.lit(0).cast("long"))
    bounded = target.withColumn("hi", hi)
    return bounded.select("source", "source_size", "target", "blocks", "base", "extra", "wanted", F.coalesce(F.lag("hi").over(order), F.lit(0).cast("long")).alias("lo"), "hi")


def shuffled(docs: DataFrame) -> DataFrame:
    """Adds start: where each document (key, source, size) begins in its source's shuffled words."""
    keyed = docs.withColumn("bucket", F.substring("key", 1, 3))
    within = W.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    totals = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    base = totals.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    local = keyed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    b = base.withColumnsRenamed({"source": "source_", "bucket": "bucket_"})
    return local.join(b, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_"))).withColumn("start", F.col("base") + F.col("inner")).drop("source_", "bucket_", "base", "inner", "bucket")


def schedule(goal: DataFrame) -> DataFrame:
    """(slot, source, rank): which source each slot takes a block from, and the slot's rank within that source."""
    spark = goal.sparkSession
    slots = goal.agg(F.coalesce(F.sum("wanted"), F.lit(0)).alias("n")).first()["n"]
    n = F.col("slot")
    # n * GOLDEN mod 2**32 by 16-bit halves, as a long product would overflow
    point = (n.bitwiseAND(65535) * GOLDEN + F.shiftleft((F.shiftright(n, 16).bitwiseAND(65535) * GOLDEN).bitwiseAND(65535), 16)).bitwiseAND(2**32 - 1)
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.shiftright("point", 22))
    # sources meet a point through the 1024 cells their stretches touch: an equi-join, and each row checks its bounds
    cells = goal.where("hi > lo").select("source", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", 22), F.shiftright(F.col("hi") - 1, 22))).alias("cell"))
    taken = points.join(cells, "cell").where("point >= lo AND point < hi").select("slot", "source", F.floor(n / CHUNK).alias("chunk"))
    inner = F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1
    # the slots before a chunk: those of earlier groups of chunks, and those of earlier chunks of its group
    counts = taken.groupBy("source", "chunk").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("chunk") / CHUNK))
    groups = counts.groupBy("source", "group").agg(F.sum("n").alias("n")).select(F.col("source").alias("source_"), F.col("group").alias("group_"), F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("source", "group").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    c = counts.join(groups, F.col("source").eqNullSafe(F.col("source_")) & (F.col("group") == F.col("group_"))).select(F.col("source").alias("source_"), F.col("chunk").alias("chunk_"), (F.col("base") + F.col("before")).alias("base"))
    return taken.withColumn("inner", inner).join(c, F.col("source").eqNullSafe(F.col("source_")) & (F.col("chunk") == F.col("chunk_"))).select("slot", "source", (F.col("base") + F.col("inner")).alias("rank"))


def _taken(docs: DataFrame, block: int, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, DataFrame]:
    """Documents (key, source, size and others) with their place and targets, and the times that each block of a source is taken."""
    placed = materialise(shuffled(docs))
    goal = materialise(targets(placed, weights, cap, block))
    g = goal.select(F.col("source").alias("source_"), "source_size", "target", "blocks", "base", "extra")
    same = F.col("source").eqNullSafe(F.col("source_"))
    turns = schedule(goal).join(g, same).where(F.col("rank") < cap * F.col("blocks")).groupBy("source", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))
    return placed.join(g, same).drop("source_", "blocks"), turns


def _pieces(placed: DataFrame, turns: DataFrame) -> DataFrame:
    """Rows of ``placed`` cut at block borders, with ``words`` of each piece and ``times`` taken."""
    base, extra = F.col("base"), F.col("extra")

    def block_of(word: Column) -> Column:
        return F.floor(F.when(word < extra * (base + 1), word / (base + 1)).otherwise(extra + (word - extra * (base + 1)) / base)).cast("long")

    def border(block: Column) -> Column:
        return block * base + F.least(block, extra)

    end = F.col("start") + F.col("size")
    cut = placed.withColumn("block", F.explode(F.sequence(block_of(F.col("start")), block_of(end - 1))))
    words = F.least(end, border(F.col("block") + 1)) - F.greatest(F.col("start"), border(F.col("block")))
    t = turns.withColumnsRenamed({"source": "source_", "block": "block_"})
    joined = cut.withColumn("words", words).join(t, F.col("source").eqNullSafe(F.col("source_")) & (F.col("block") == F.col("block_")), "left")
    return joined.drop("source_", "block_").withColumn("times", F.coalesce("times", F.lit(0)))


def mix(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    slim, turns = _taken(docs.select("doc_id", "source", _size(F.col("text")).alias("size"), _shuffle_key(F.col("doc_id"), F.col("text")).alias("key")), block, weights, cap)
    row = ["source", "start", "doc_id", "size", "source_size", "target"]
    # size-0 documents may share a start; each keeps a row of its own
    empty = slim.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    full = _pieces(slim.where("size > 0"), turns).groupBy(*row).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return full.select("doc_id", "size", "source_size", "target", "taken").unionByName(empty)


def mixed_documents(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed corpus: a document comes as often as all its blocks are taken; where the taken words end within a
    document, one more row holds the words before that. n_chars follows the text; documents not taken are left out.

    Only keys and sizes are placed and scheduled; the texts move once, to meet what is taken of them. Equal rows (doc_id, text
    and source) share what is taken of their group.
    """
    columns = docs.columns
    key = _shuffle_key(F.col("doc_id"), F.col("text"))
    row = F.md5(F.concat("key", F.when(F.col("source").isNull(), F.lit("|")).otherwise(F.concat(F.lit("="), "source"))))
    slim, turns = _taken(docs.select("source", _size(F.col("text")).alias("size"), key.alias("key")), block, weights, cap)
    # blocks are taken from a source's first on, so the times fall along a document
    per = _pieces(slim.where("size > 0"), turns).withColumn("row", row).groupBy("row", "start").agg(F.collect_list(F.struct("words", "times")).alias("parts")).where("array_max(parts.times) > 0")
    keeps = F.expr("transform(sequence(1L, array_max(parts.times)), c -> aggregate(parts, 0L, (a, p) -> a + IF(p.times >= c, p.words, 0L)))")
    per = per.groupBy(F.col("row").alias("_row")).agg(F.array_sort(F.collect_list(F.struct("start", keeps.alias("keeps")))).alias("_places"))
    others = [f.name for f in docs.schema.fields if f.name not in ("doc_id", "text", "source") and not isinstance(f.dataType, MapType)]
    own = F.struct(*columns).alias("_doc")
    full = docs.select(own, key.alias("key"), "source", _size(F.col("text")).alias("_size"), F.xxhash64(F.lit(0), *others).alias("_order")).where("_size > 0")
    nth = F.row_number().over(W.partitionBy("_row").orderBy("_order"))
    ranked = full.withColumn("_row", row).withColumn("_nth", nth).join(per, "_row").where(F.col("_nth") <= F.size("_places"))
    out = ranked.select("_doc", "_size", F.explode(F.element_at("_places", F.col("_nth"))["keeps"]).alias("_keep"))
    words = F.slice(F.regexp_extract_all(F.col("_doc.text"), F.lit(WORDS), F.lit(0)), F.lit(1), F.col("_keep").cast("int"))
    text = F.when(F.col("_keep") >= F.col("_size"), F.col("_doc.text")).otherwise(F.array_join(words, " "))
    done = out.select("_doc", text.alias("_text"))
    return done.select(*(F.col("_text").alias(c) if c == "text" else F.length("_text").cast("long").alias(c) if c == "n_chars" else F.col("_doc")[c].alias(c) for c in columns))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size * 3 / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER (ORDER BY source_size * 3 / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
f AS (SELECT *, level * weight >= 3 * source_size AS done FROM l),
c AS (SELECT arg_min(level, source_size * 3 / weight) FILTER (NOT done) AS level FROM f),
t AS (SELECT f.source, f.source_size, CASE WHEN done THEN CAST(3 * source_size AS DOUBLE) ELSE c.level * weight END AS target, CAST(ceil(source_size / 32) AS BIGINT) AS blocks FROM f, c),
v AS (SELECT *, CASE WHEN blocks > 0 THEN source_size // blocks ELSE 0 END AS base, CASE WHEN blocks > 0 THEN source_size % blocks ELSE 0 END AS extra,
  CASE WHEN blocks > 0 THEN CAST(floor(target * blocks / source_size + 0.5::DOUBLE) AS BIGINT) ELSE 0 END AS wanted FROM t),
b AS (SELECT *, CASE WHEN sum(wanted) OVER () > 0 THEN CAST(floor(CAST(sum(wanted) OVER (ORDER BY encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / CAST(sum(wanted) OVER () AS DOUBLE) * 4294967296::DOUBLE) AS BIGINT) ELSE 0 END AS hi FROM v),
g AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY encode(source) NULLS LAST), 0) AS lo FROM b),
n AS (SELECT CAST((n::HUGEINT * 2654435769) % 4294967296 AS BIGINT) AS point, n FROM (SELECT unnest(range((SELECT CAST(sum(wanted) AS BIGINT) FROM g))) AS n)),
r AS (SELECT g.source, row_number() OVER (PARTITION BY g.source ORDER BY n) - 1 AS rank, blocks FROM n JOIN g ON point >= lo AND point < hi),
q AS (SELECT source, rank % blocks AS block, count(*) AS times FROM r WHERE rank < 3 * blocks GROUP BY ALL),
o AS (SELECT *, row_number() OVER () AS id, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
e AS (SELECT o.id, o.source, o.size, o.start, base, extra FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source WHERE size > 0),
x AS (SELECT *, unnest(range(CASE WHEN start < extra * (base + 1) THEN start // (base + 1) ELSE extra + (start - extra * (base + 1)) // base END,
  CASE WHEN start + size - 1 < extra * (base + 1) THEN (start + size - 1) // (base + 1) ELSE extra + (start + size - 1 - extra * (base + 1)) // base END + 1)) AS block FROM e),
y AS (SELECT x.id, sum((least(start + size, (x.block + 1) * base + least(x.block + 1, extra)) - greatest(start, x.block * base + least(x.block, extra))) * coalesce(times, 0)) AS taken
  FROM x LEFT JOIN q ON x.source IS NOT DISTINCT FROM q.source AND x.block = q.block GROUP BY x.id)
SELECT o.doc_id, o.size, g.source_size, g.target, CAST(coalesce(y.taken, 0) AS BIGINT) AS taken FROM o LEFT JOIN y ON o.id = y.id JOIN g ON o.source IS NOT DISTINCT FROM g.source
"""
