"""MinHash near-duplicate detection by a signature-coordinate inverted join.

1. A document's set of word shingles gives ``coordinates`` minima. Documents with one set form a class; only its
   representative goes on.
2. Each class is posted under its coordinate-value pairs. Values that occur once match nothing and are skipped; a class
   with fewer than ``matches`` shared values has no partner. Of the c values left, a partner must share one among the
   c - matches + 1 rarest (prefix merging), so only these are joined on.
3. Every class of a posting list meets a few heads of that list; pairs with enough collisions are confirmed on their full
   sets, and links join classes into components.
4. Lists that still hold several components are gone through in blocks: pairs across components are counted for
   collisions, those with enough are compared by their full sets right there, and a link found joins the two components,
   so that the rest of their pairs is skipped. A pair in several lists is looked at in the first only.

No step writes out the pairs of a group. In step 4 a list of at most ``BLOCK`` members is one task's. A longer one is cut by
set sizes first (a partner's size is within the threshold). Then blocks of the members of its largest component meet blocks
of the other members only, so that a stray document in a list of a million near copies makes some thousand rows more. A list
of n members in many components still makes up to n / BLOCK rows of each member, for every pair of them has to be looked at. Keys that very many rows have are dealt to several tasks (``salted_join``).

Two sets of similarity 0.75 share at least ``matches`` = 17 of 40 coordinates except with a chance of 3e-6 (binomial tail),
more similar ones with less. Classes are told apart by 128 bits, but go by 64-bit hashes as nodes: of n classes about
n * n / 2**65 pairs are taken for one, which is none in 1e9.

Results for unusual input: without words or text n_shingles is 0 and the document is its own component; with fewer words
than a shingle, the whole sequence is the only shingle; a null doc_id gets its group's component but is never ``kept`` (``distinct_documents``
keeps one row of a group without ids); rows with equal doc_id and text get equal results, rows with equal doc_id and other
text are separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import salted_join
from ..runtime import materialise, release
from .text import U, Sequences, chunks, mix, windows

SHINGLE, PERCENT, COORDINATES, MATCHES = 5, 75, 40, 17
#: Heads of a list; members of a list that make a block.
HEADS, BLOCK = 4, 512


def _sets(c, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document of a chunk, one after the other, with offsets."""
    seq, offsets = Sequences(c.word_hashes(lower=True)), c.word_offsets
    first, doc = windows(offsets, shingle)
    size = np.diff(offsets)
    short = np.flatnonzero((size > 0) & (size < shingle))
    hashes = np.concatenate([seq.first(first, first + shingle), seq.first(offsets[:-1][short], offsets[1:][short])])
    doc = np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(c.n + 1))


def _signatures(shingle: int, coordinates: int):
    rng = np.random.default_rng(64)
    factors = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64) * U(2) + U(1)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sig", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column("text")):
                hashes, offsets = _sets(c, shingle)
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                sig = np.zeros((c.n, coordinates), U)
                prints = np.zeros((2, c.n), U)
                if len(full):
                    starts = offsets[:-1][full]
                    for i in range(coordinates):
                        x = hashes * factors[i]
                        sig[full, i] = mix(np.minimum.reduceat(x ^ (x >> U(32)), starts), i)
                    for i in range(2):
                        prints[i, full] = mix(np.add.reduceat(mix(hashes, 101 + i), starts), i)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(c.n + 1, dtype=np.int32) * coordinates), pa.array(sig.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(c.first, c.n), batch.column("doc_id").slice(c.first, c.n), pa.array(n), *(pa.array(p.view(np.int64)) for p in prints), lists], schema=schema)

    return run


def _full_sets(shingle: int):
    """Each text's sorted set."""

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column("text")):
                hashes, offsets = _sets(c, shingle)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(c.first, c.n), pa.array([hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["node", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Side:
    """Members of a posting list: one block of them."""

    def __init__(self, t: pa.Table):
        self.node, self.n, self.after = t["node"].to_numpy(), t["n"].to_numpy(), t["after"].to_numpy()
        self.keys, self.prefix = (t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) for c in ("keys", "prefix"))
        self.brief = (self.keys >> 48).astype(np.int16)
        self.sets = [np.frombuffer(x.as_buffer(), U) for x in t["shingles"]]


def _across(matches: int, percent: int):
    """Links between components of a list, found within one block or between two."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        here = key[1].as_py()
        tables = [table.filter(pc.equal(table["side"], s)) for s in (0, 1)]
        if not len(tables[0]):
            tables.reverse()
        one = not len(tables[1])
        a = _Side(tables[0])
        b = a if one else _Side(tables[1])
        labels, label = np.unique(np.concatenate([t["component"].to_numpy() for t in tables]), return_inverse=True)
        ca, cb = (label, label) if one else (label[: len(a.node)], label[len(a.node) :])
        found = []
        for i in range(len(a.node)):
            open_ = (cb != ca[i]) & (100 * np.minimum(a.n[i], b.n) >= percent * np.maximum(a.n[i], b.n))
            open_ &= ~(b.after & a.after[i])  # both of the next band: that band's list has them
            if one:
                open_[: i + 1] = False
            j = np.flatnonzero(open_)
            # 16 bits of the values first; which list is the pair's first one is told by the values themselves
            j = j[np.count_nonzero(b.brief[j] == a.brief[i], axis=1) >= matches]
            same = b.keys[j] == a.keys[i]
            count = np.count_nonzero(same, axis=1)
            hit = (count >= matches) & (np.argmax(same & a.prefix[i] & b.prefix[j], axis=1) == here)
            j = j[hit][np.argsort(-count[hit], kind="stable")]
            if not len(j):
                continue
            mine, sizes = a.sets[i], np.array([len(b.sets[x]) for x in j])
            theirs = np.concatenate([b.sets[x] for x in j])
            at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            both = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.cumsum(sizes) - sizes)
            for x in j[100 * both >= percent * (len(mine) + sizes - both)]:
                if (old := cb[x]) != ca[i]:
                    found.append((a.node[i], b.node[x]))
                    new = ca[i]
                    ca[ca == old] = new
                    cb[cb == old] = new
        pairs = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those similar enough by their full sets."""
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a long, b long")


def _placed(docs: DataFrame, shingle: int, percent: int, coordinates: int, matches: int) -> DataFrame:
    """(row, doc_id, n, component_id, group, kept): group is the same for all rows of a component; without words both are null."""
    base = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    signed = materialise(base.mapInArrow(_signatures(shingle, coordinates), "row long, doc_id long, n long, f1 long, f2 long, sig array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("rep")
    classes = signed.where("n > 0").groupBy("f1", "f2").agg(first, F.min("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("places"))
    classes = materialise(classes.select("f1", "f2", F.col("rep.row").alias("node"), F.col("rep.doc_id").alias("doc_id"), "n", "sig", "places"))

    groups = _groups(classes, base, shingle, percent, matches)

    ids = classes.select("node", "doc_id")
    smallest = groups.join(ids, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("classes"))
    named = salted_join(groups, smallest, ["component"], ["node"], classes.count(), "classes").select("node", "component", "component_id")
    named = classes.select("f1", "f2", "node", "doc_id", "places").join(named, "node", "left")
    named = materialise(named.select("f1", "f2", "places", F.coalesce("component", "node").alias("group"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))
    slim = signed.drop("sig")
    out = salted_join(slim.where("n > 0"), named, ["f1", "f2"], ["row"], slim.count()).unionByName(slim.where("n = 0"), allowMissingColumns=True)
    # a group without ids goes by its representative's row
    kept = F.when(F.col("n") == 0, F.col("doc_id").isNotNull()).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    some = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("row", "doc_id", "n", some.alias("component_id"), F.when(F.col("n") > 0, F.col("group")).alias("group"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    return _placed(docs, shingle, percent, coordinates, matches).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def _groups(classes: DataFrame, base: DataFrame, shingle: int, percent: int, matches: int) -> DataFrame:
    """(node, component) of every class that is linked to another."""
    posted = classes.select("node", F.posexplode("sig").alias("coordinate", "key"))
    shared = materialise(posted.groupBy("key").agg(F.count("*").alias("places")).where("places > 1"))
    rarest = F.expr("transform(array_sort(collect_list(struct(places, coordinate))), x -> x.coordinate)")
    total = shared.agg(F.coalesce(F.sum("places"), F.lit(0)).alias("n")).first()["n"]
    kept = salted_join(posted, shared, ["key"], ["node"], total).groupBy("node").agg(rarest.alias("order")).where(F.size("order") >= matches)
    prefix = F.expr(f"transform(sig, (x, i) -> array_contains(slice(order, 1, size(order) - {matches} + 1), i))")
    sized = materialise(kept.join(classes, "node").select("node", "n", F.col("sig").alias("keys"), F.expr("transform(sig, x -> smallint(shiftright(x, 48)))").alias("sig"), prefix.alias("prefix")))
    release(shared)
    lists = sized.select("node", F.posexplode(F.arrays_zip("keys", "prefix")).alias("coordinate", "z")).where("z.prefix").select("node", "coordinate", F.col("z.keys").alias("key"))
    texts = base.select(F.col("row").alias("node"), "text").join(sized.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = materialise(texts.mapInArrow(_full_sets(shingle), "node long, shingles binary"))

    links = materialise(_links(_with_heads(lists, sized, percent, matches), sets, percent))
    groups = materialise(connected_components(links))
    more = materialise(_between_groups(lists, sized, sets, groups, percent, matches))
    if more.isEmpty():
        return groups
    stars = groups.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return materialise(connected_components(stars.unionByName(more)))


def _with_heads(lists: DataFrame, sized: DataFrame, percent: int, matches: int) -> DataFrame:
    """Pairs of each list's heads (the members with the least hashes under some salts) with its members, if they collide enough."""
    salted = [F.min(F.struct(F.xxhash64("node", F.lit(h)), "node")).alias(f"h{h}") for h in range(HEADS)]
    heads = lists.groupBy("key").agg(F.count("*").alias("places"), *salted).where("places > 1")
    heads = materialise(heads.select("key", "places", F.array_distinct(F.array(*(F.col(f"h{h}.node") for h in range(HEADS)))).alias("heads")))
    total = heads.agg(F.coalesce(F.sum("places"), F.lit(0)).alias("n")).first()["n"]
    met = salted_join(lists, heads, ["key"], ["node"], total).select("node", F.explode("heads").alias("head"))
    pairs = met.where("node <> head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    p, q = (sized.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"g{x}")) for x in "ab")
    collisions = F.expr("aggregate(zip_with(ga, gb, (x, y) -> IF(x = y, 1, 0)), 0, (s, x) -> s + x)")
    alike = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.join(p, "a").join(q, "b").where(alike).where(collisions >= matches).select("a", "b")


def _between_groups(lists: DataFrame, sized: DataFrame, sets: DataFrame, groups: DataFrame, percent: int, matches: int) -> DataFrame:
    """Links that join the components which a list still holds, confirmed on full sets."""
    placed = lists.join(sized.select("node", "n"), "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("places")).where("lo <> hi").select("key", "places")
    several = materialise(several)
    total = several.agg(F.coalesce(F.sum("places"), F.lit(0)).alias("n")).first()["n"]
    # bands a little wider than the threshold allows sizes to differ: partners are in one band or in neighbouring ones
    band = F.floor(F.log("n") / math.log(100 / percent) / 1.001).cast("int")
    member = salted_join(placed, several, ["key"], ["node"], total).withColumn("own", F.when(F.col("places") > BLOCK, band).otherwise(-1))
    member = member.select("*", F.explode(F.when(F.col("places") > BLOCK, F.array("own", F.col("own") - 1)).otherwise(F.array("own"))).alias("band"))
    member = materialise(member.select("key", "coordinate", "band", (F.col("band") < F.col("own")).alias("after"), "node", "component"))
    # per list and band: its members, and its largest component
    sizes = member.groupBy("key", "band", "component").agg(F.count("*").alias("size"), F.count_if("after").alias("after"))
    sizes = sizes.groupBy("key", "band").agg(F.sum("size").alias("places"), F.sum("after").alias("after_"), F.max(F.struct("size", "component")).alias("top"))
    sizes = materialise(sizes.where("top.size < places AND after_ < places").select("key", "band", "places", F.col("top.size").alias("most"), F.col("top.component").alias("largest")))
    total = sizes.agg(F.coalesce(F.sum("places"), F.lit(0)).alias("n")).first()["n"]
    dealt = salted_join(member, sizes, ["key", "band"], ["node"], total)
    short = F.col("places") <= BLOCK
    mine, rest = (F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int") for n in (F.col("most"), F.col("places") - F.col("most")))
    h = F.xxhash64("node")
    # a place is (which, i, j, side): block i of the largest component is side 0 of (0, i, j) and block j of the other members
    # its side 1; among themselves the others are one side with later blocks and the other with earlier ones
    def place(which: int, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.lit(which).alias("which"), i.alias("i"), j.alias("j"), side.alias("side"))

    zero, one = F.lit(0), F.lit(1)
    block, own = F.pmod(h, mine).cast("int"), F.pmod(h, rest).cast("int")
    whole = F.array(place(0, zero, zero, zero))
    main = F.transform(F.sequence(zero, rest - 1), lambda j: place(0, block, j, zero))
    visits = F.transform(F.sequence(zero, mine - 1), lambda i: place(0, i, own, one))
    among = F.transform(F.sequence(zero, rest - 1), lambda i: place(1, F.least(own, i), F.greatest(own, i), (own > i).cast("int")))
    places = F.when(short, whole).when(F.col("component") == F.col("largest"), main).otherwise(F.concat(visits, among))
    dealt = dealt.select("key", "coordinate", "band", "after", "node", "component", F.explode(places).alias("p")).select("key", "coordinate", "band", "after", "node", "component", "p.*")
    full = sized.select("node", "n", "keys", "prefix").join(sets, "node")
    rows = dealt.join(full, "node").select("key", "coordinate", "band", "which", "i", "j", "side", "after", "node", "component", "n", "keys", "prefix", "shingles")
    return rows.groupBy("key", "coordinate", "band", "which", "i", "j").applyInArrow(_across(matches, percent), "a long, b long").distinct()


def distinct_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """One document of each group, once: that with the smallest doc_id. Of documents without words equal rows stay once."""
    placed = _placed(docs, shingle, percent, coordinates, matches)
    # a group is told by its node; one row of those with the smallest id stays, or of all if none has an id
    stay = placed.where("n > 0 AND (kept OR component_id IS NULL)").groupBy("group").agg(F.min("row").alias("_row")).select("_row")
    stay = stay.unionByName(placed.where("n = 0").select(F.col("row").alias("_row")).distinct())
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    return keyed.join(stay, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.a = d.doc_id
"""
