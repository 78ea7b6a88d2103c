"""Training-data operators against brute force, with the unusual inputs each has to bear."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from velograph.llm import ann, chat, langid, minhash, mixing, packing, quality, substring, topk, vectors, warc
from velograph.llm.queries import word_tokenizer
from velograph.llm.vectors import keep_top

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, sig string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, words=300):
    return " ".join(f"w{rng.integers(words)}" for _ in range(n))


def documents(spark, rows):
    full = [(i, t, lang, source, None if t is None else len(t), "own", "own") for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(1)
    base = [prose(rng, int(rng.integers(20, 200))) for _ in range(40)]
    passage = prose(rng, 60)
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", "s0") for i in range(5)]  # exact copies
    rows += [(200 + i, " ".join("edit" if k == 7 else w for k, w in enumerate(base[i].split())), "en", "s1") for i in range(10)]
    rows += [(300 + i, prose(rng, 30) + " " + passage + "\n" + prose(rng, 20), "en", None) for i in range(4)]
    rows += [(400, None, None, None), (401, "", "en", "s0"), (402, " \t\n", "en", "s1"), (403, "one two", "en", "s2"), (404, "One TWO", "en", "s2"), (405, "same " * 90, "en", "s3")]
    rows += [(406, prose(rng, 30_000), "en", "s0"), (0, base[0], "en", "s0"), (None, base[1], "en", "s1")]
    return rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_topk(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((300, 6)).astype(np.float32)
    v[50:60] = v[40]
    rows = [(i, v[i].tolist()) for i in range(300)] + [(7, v[7].tolist()), (900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (None, v[0].tolist())]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(5)
    got = {}
    for r in topk.search(d, F.col("vec_id") % 10 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = np.floor(1024 * v.astype(float)).astype(int)
    assert set(got) == set(range(0, 300, 10))
    for i, found in got.items():
        want = sorted(((-int(q[i] @ q[j]), j) for j in range(300) if j != i))[:5]
        assert sorted(found) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]
    assert topk.search(d.limit(0), F.lit(True)).count() == 0
    huge = spark.createDataFrame([(1, [3e38]), (2, [3e38]), (3, [-3e38])], "vec_id long, embedding array<float>")
    assert {(r["query_id"], r["vec_id"]) for r in topk.search(huge, F.lit(True), k=1).collect()} == {(1, 2), (2, 1), (3, 1)}


def test_topk_counts_repeated_rows_once(spark):
    rng = np.random.default_rng(12)
    v = rng.integers(-9, 10, (60, 6)).astype(float)
    other = rng.integers(-9, 10, (60, 6)).astype(float)
    rows = [(i, v[i].tolist()) for i in range(60) for _ in range(12)] + [(i, other[i].tolist()) for i in range(1, 60, 2)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = {}
    for r in topk.search(d, F.col("vec_id") % 10 == 0, k=10, scale=1, tile=400).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    near = {}
    for r in ann.search(d, F.col("vec_id") % 10 == 0, k=10, confidence=0.999999, leaf=200).collect():
        near.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], int(r["score"])))
    for i in range(0, 60, 10):
        score = {j: max(int(v[i] @ v[j]), int(v[i] @ other[j]) if j % 2 else -(10**9)) for j in range(60) if j != i}
        want = [(n + 1, j, s) for n, (j, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:10])]
        assert sorted(got[i]) == want and sorted(near[i]) == want


def brute_nearest(rows, is_query, k, score):
    """Of (id, vector) rows the k best other ids of each query; a repeated id counts with its best score."""
    out = {}
    for q in sorted({i for i, _ in rows if is_query(i)}):
        own = min(v for i, v in rows if i == q)
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max(best.get(i, -math.inf), score(own, v))
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return {q: [(n + 1, i, -s) for n, (s, i) in enumerate(x)] for q, x in out.items()}


def test_searches_in_waves_lists_and_shards(spark, monkeypatch):
    """Several waves, more lists than a merge step takes, several shards and leaves; ties, repeats, nulls, clashing columns."""
    monkeypatch.setattr(vectors, "WAVE_BYTES", 300)
    monkeypatch.setattr(vectors, "FAN_IN", 2)
    rng = np.random.default_rng(17)
    rows = [(i, rng.integers(-4, 5, 5).astype(float).tolist()) for i in range(150)]
    rows += [(i, rows[i][1]) for i in range(0, 60, 3)] + [(i, rng.integers(-4, 5, 5).astype(float).tolist()) for i in range(0, 60, 4)] + [(500 + i, rows[7][1]) for i in range(20)]
    rows = [r for r in rows if any(r[1])]
    bad = [(900, None), (905, [1.0, None, 0.0, 0.0, 0.0]), (910, [float("nan")] * 5), (915, [float("inf")] * 5), (None, [1.0] * 5)]
    d = spark.createDataFrame([(*r, 1.0, 1, 1) for r in rows + bad], "vec_id long, embedding array<double>, score double, rank int, list int").repartition(9)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = brute_nearest(rows, lambda i: i % 10 == 0, 7, dot)
    for found in (topk.search(d, F.col("vec_id") % 10 == 0, k=7, scale=1, tile=16), ann.search(d, F.col("vec_id") % 10 == 0, k=7, confidence=0.9999999, leaf=4, shard=16)):
        got = {}
        for r in found.collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert {q: sorted(x) for q, x in got.items()} == want


def test_vectors_of_unequal_length_raise(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "vec_id long, embedding array<double>").coalesce(1)
    for search in (topk.search, ann.search):
        with pytest.raises(Exception, match="differ in length"):
            search(d, F.lit(True)).collect()


def test_ann_with_its_own_parameters(spark):
    """Vectors without structure: the recall stated, from a part of the rows."""
    rng = np.random.default_rng(18)
    x = rng.standard_normal((20_000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    ids, q = np.arange(len(x)), x[:100]
    held = ann.Held(np.full(100, -np.inf), ann.K)
    for first in (True, False):
        held = ann.Held(held.kth, ann.K)
        ann.search_shard(ids, x, ids[:100], q, held, 1.0, ann.DIMS, ann.CONFIDENCE, ann.LEAF, first)
    score = q @ x.T
    score[np.arange(100), np.arange(100)] = -np.inf
    true = np.argsort(-score, axis=1)[:, : ann.K]
    hits = sum(len(set(true[i]) & set(held.triples[1][held.triples[0] == i])) for i in range(100))
    assert hits / (100 * ann.K) >= 0.9 and held.verified <= 0.45 * 100 * len(x)


def test_top_list_holds_an_id_once():
    q, ids, score = keep_top(np.zeros(5, int), np.array([1, 1, 2, 2, 3]), np.array([9, 8, 7, -(2**63), 6]), 3)
    assert (ids.tolist(), score.tolist()) == ([1, 2, 3], [9, 7, 6])


def test_ann_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 32)) * 2
    v = (centres[rng.integers(20, size=3000)] + rng.standard_normal((3000, 32)) * 0.5).astype(np.float32)
    d = spark.createDataFrame([(i, v[i].tolist()) for i in range(3000)] + [(5000, [0.0] * 32), (5001, None)], "vec_id long, embedding array<float>")
    found = {}
    for r in ann.search(d, F.col("vec_id") % 50 == 0, leaf=32).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    x = v.astype(float)
    hits = 0
    for i, got in found.items():
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & set(got))
        assert all(math.isclose(score, x[i] @ x[j], rel_tol=1e-12, abs_tol=1e-9) for j, score in got.items())
    assert hits / (20 * len(found)) >= 0.9
    assert len(found) == 60
    assert ann.search(d.limit(0), F.lit(True)).count() == 0
    assert ann.chi_square_cdf(ann.chi_square_quantile(0.95, 8), 8) == pytest.approx(0.95)


@pytest.mark.parametrize("kind", ["tight clusters", "repeated vectors"])
def test_ann_where_the_test_ends_every_search(spark, kind):
    """Structured vectors through several shards with the registered parameters: all queries of a block stop early."""
    rng = np.random.default_rng(21)
    centres = rng.standard_normal((100, 32))
    v = centres[np.arange(4000) % 100] + (rng.standard_normal((4000, 32)) * 1e-3 if kind == "tight clusters" else 0)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    found = {}
    for r in ann.search(d, F.col("vec_id") % 50 == 0, shard=700).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert len(found) == 80
    hits = 0
    for i, got in found.items():
        s = np.add.reduce(v[i] * v, axis=1)
        s[i] = -np.inf
        worst = np.sort(s)[-20]
        hits += sum(score >= worst - 1e-9 for _, _, score in got)
        assert [r for r, _, _ in sorted(got)] == list(range(1, 21))
    assert hits >= 0.9 * 20 * 80


def brute_components(rows):
    def shingles(t):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(r[0], ids.get(find(i), r[0]))
    return sorted(((r[0] is None, r[0] or 0), len(sets[i]), ids.get(find(i)), r[0] is not None and r[0] == ids.get(find(i))) for i, r in enumerate(rows))


def test_minhash(spark, corpus):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(documents(spark, corpus)).collect())
    assert got == brute_components(corpus)
    assert minhash.near_duplicates(empty(spark)).count() == 0
    stay = minhash.distinct_documents(documents(spark, corpus))
    assert stay.columns == documents(spark, corpus).columns
    assert sorted(r["doc_id"] for r in stay.where("doc_id IS NOT NULL").collect()) == sorted({i for (null, i), _, _, kept in got if kept and not null})


def test_minhash_list_of_a_pair_goes_by_whole_values():
    """The first coordinate agrees in its 16 upper bits only: the pair belongs to the list of the second."""
    import pyarrow as pa

    shingles = np.arange(40, dtype=np.uint64).tobytes()
    keys = np.tile(np.arange(40, dtype=np.int64) << 48, (2, 1))
    keys[1, 0] += 1
    table = {"side": [0, 0], "after": [False, False], "node": [7, 3], "component": [7, 3], "n": [40, 40], "keys": keys.tolist(), "prefix": [[True] * 24 + [False] * 16] * 2, "shingles": [shingles] * 2}
    got = [minhash._across(17, 75)((None, pa.scalar(c)), pa.table(table)).to_pydict() for c in (0, 1, 2)]
    assert got == [{"a": [], "b": []}, {"a": [3], "b": [7]}, {"a": [], "b": []}]


def test_minhash_one_row_of_a_group_stays(spark, corpus):
    rows = [*corpus, (None, corpus[3][1], "en", "s"), (None, "alone " * 20, "en", "s"), (None, "alone " * 20, "en", "t"), (None, "alone " * 19, "en", "t"), (7, "alone again here we go", "en", "s"), (None, None, None, None), (None, None, None, None)]
    stay = [(r["doc_id"], r["text"]) for r in minhash.distinct_documents(documents(spark, rows)).collect()]
    assert len([t for i, t in stay if t and t.startswith("alone alone")]) == 1  # one of a group without ids
    assert (None, corpus[3][1]) not in stay and (None, corpus[1][1]) not in stay  # near copies of documents with ids
    assert stay.count((None, None)) == 1 and (400, None) in stay


def test_minhash_long_lists_are_cut(spark, monkeypatch):
    """Lists of a large group with strays, of many sizes, over many blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(19)
    words, rows = prose(rng, 120).split(), []
    for i in range(60):
        w = list(words)
        for k in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            w[k] = f"x{rng.integers(10**9)}"
        rows.append((i, " ".join(w[: int(rng.integers(50, 121))]), "en", "s"))
    got = sorted(((False, r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == brute_components(rows)


def test_minhash_large_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    words = prose(rng, 150).split()
    rows = []
    for i in range(150):
        w = list(words)
        for k in rng.choice(150, 6, replace=False):
            w[k] = f"x{rng.integers(10**9)}"
        rows.append((i, " ".join(w), "en", "s"))
    got = sorted(((False, r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == brute_components(rows)


def brute_repeats(rows, length=35):
    words = [WORD.findall(r[1] or "") for r in rows]
    seen = {}
    for w in words:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(r[0]), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substring(spark, corpus):
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(documents(spark, corpus)).collect())
    assert got == brute_repeats(corpus)
    assert substring.remove_repeats(empty(spark)).count() == 0
    clean = substring.clean_documents(documents(spark, corpus))
    assert clean.columns == documents(spark, corpus).columns
    left = clean.collect()
    assert not [r for r in brute_repeats([(r["doc_id"], r["text"]) for r in left]) if r[2] and r[0] != "405"]
    assert {r["doc_id"]: r["text"] for r in left if r["doc_id"] in (400, 401, 402)} == {400: None, 401: "", 402: " \t\n"}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in left)


def test_substring_without_chains(spark, corpus):
    plain = substring.repeated_spans(documents(spark, corpus), compact=False).collect()
    chained = substring.repeated_spans(documents(spark, corpus)).collect()

    def words(found):
        return sorted((str(r["doc_id"]), sorted({x for s in r["spans"] for x in range(s["at"], s["at"] + s["n"])})) for r in found)

    assert words(plain) == words(chained)


def test_substring_compacts_chains(spark):
    """a b c are traversed twice, d also after e: the chain ends where the graph branches."""
    paths = spark.createDataFrame([(1, 5, 2, 3, 3), (3, 4, 2, 5, 5), (5, 2, 2, 7, 9), (7, 6, 3, 0, 0), (11, 1, 4, 11, 11)], "body long, n int, places long, lo long, hi long")
    got = {r["body"]: (r["chain"], r["skip"]) for r in substring.chains(paths).collect()}
    assert got == {1: (1, 0), 3: (1, 5), 5: (1, 9), 7: (7, 0), 11: (11, 0)}


def test_substring_many_equal_rows(spark):
    text = prose(np.random.default_rng(3), 120)
    rows = [(1, text, "en", "s")] * 3000 + [(2, text + " more", "en", "s")]
    got = {(r["doc_id"], r["n_words"], r["n_removed"]): r["count"] for r in substring.remove_repeats(documents(spark, rows)).groupBy("doc_id", "n_words", "n_removed").count().collect()}
    assert got == {(1, 120, 120): 3000, (2, 121, 120): 1}


def test_mixing(spark, corpus):
    docs = documents(spark, corpus)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus)
    sizes = {}
    for r in corpus:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    names, capped = sorted(sizes, key=lambda s: (s is None, s or "")), {}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    while True:
        left, free = sum(sizes.values()) - sum(capped.values()), [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    want = capped | share
    assert {round(r["target"], 6) for r in rows} == {round(want[s], 6) for s in {r[3] for r in corpus}}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    by_id = {i: s for i, _, _, s in corpus if i is not None}
    taken = {}
    for r in rows:
        source = by_id[r["doc_id"]] if r["doc_id"] is not None else "s1"
        taken[source] = taken.get(source, 0) + r["taken"]
    for source, goal in want.items():  # one slot more or less, of 32 words at most
        assert abs(taken[source] - goal) <= 64, (source, taken[source], goal)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r["text"])) for r in out.collect()) == sum(r["taken"] for r in rows)
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_small_sources(spark):
    """Sources of few words come near their targets too, and go by code point, null last."""
    rng = np.random.default_rng(15)
    words = {"a": 33, "b": 8, "é": 100, "Z": 5000, None: 70}
    rows = [(i, prose(rng, n), "en", s) for i, (s, n) in enumerate(words.items())]
    got = {r["doc_id"]: r for r in mixing.mix(documents(spark, rows)).collect()}
    order = {s: i % 3 + 1 for i, s in enumerate(["Z", "a", "b", "é", None])}
    for i, (s, n) in enumerate(words.items()):
        goal = min(3 * n, got[i]["target"])
        assert got[i]["target"] == pytest.approx(3 * n if s != "Z" else sum(words.values()) - 3 * (33 + 8 + 100 + 70)), (s, order[s])
        assert abs(got[i]["taken"] - goal) <= 40, s


def test_mixed_documents_share_equal_rows(spark):
    rows = [(1, "one two three four", "en", "s")] * 5 + [(2, "five " * 400, "en", "t"), (None, "six seven", "en", None), (None, "six seven", "fr", None), (3, None, "en", "s"), (4, "", "en", "s")]
    docs = documents(spark, rows)
    taken = sum(r["taken"] for r in mixing.mix(docs).collect())
    out = mixing.mixed_documents(docs).collect()
    assert sum(len(WORD.findall(r["text"])) for r in out) == taken
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed_documents(docs.repartition(5)).collect()))


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    rows = packing.pack_documents(documents(spark, corpus), word_tokenizer()).collect()
    want = sorted((str(r[0]), [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in corpus)
    crc = {}
    for i, ids in want:
        for s in range(0, len(ids), 2048):
            key = (i, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids))
            crc[key] = crc.get(key, 0) + 1
    got = {}
    for r in rows:
        key = (str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
        got[key] = got.get(key, 0) + 1
    assert got == crc
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and len(pieces) <= packing.SEGMENTS
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 2048) + 1  # hardly any padding
    assert packing.pack_documents(empty(spark), word_tokenizer()).count() == 0


def test_packing_of_several_groups(spark, monkeypatch):
    """Equal rows don't meet in one group."""
    monkeypatch.setattr(packing, "GROUP_IDS", 500)
    rows = packing.pack_documents(documents(spark, [(None, "", "en", "s")] * 3000), word_tokenizer()).collect()
    assert len(rows) == 3000
    groups = [r["sequence_id"] >> 32 for r in rows]
    assert len(set(groups)) == 6 and max(groups.count(g) for g in set(groups)) < 700


def test_packing_of_conversations(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    rng = np.random.default_rng(16)
    turns = [(c, i, "assistant" if i % 2 else "user", prose(rng, int(rng.integers(0, 60)))) for c in range(80) for i in range(int(rng.integers(1, 9)))] + [(200, 0, None, None), (201, 0, "assistant", "word " * 700)]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = packing.pack_conversations(d, word_tokenizer(), capacity=256, segments=3, loss=100).collect()
    ids, learned = {}, {}
    for c, _, role, text in turns:
        got = t.encode(text or "", add_special_tokens=False).ids
        ids.setdefault(c, []).extend(got)
        learned.setdefault(c, []).extend([role == "assistant"] * len(got))
    bins, seen = {}, {}
    for r in rows:
        mine = [*ids[r["doc_id"]], 1][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(mine, "<u4").tobytes())
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
        b = bins.setdefault(r["sequence_id"], [0, 0, 0])
        for i, x in enumerate((r["length"], 1, sum(learned[r["doc_id"]][r["start"] : r["start"] + r["length"]]))):
            b[i] += x
    assert seen == {c: len(x) + 1 for c, x in ids.items()}
    assert all(b[0] <= 256 and b[1] <= 3 and b[2] <= 100 for b in bins.values())
    assert any(b[0] > 240 for b in bins.values()) and any(b[1] == 3 for b in bins.values()) and any(b[2] == 100 for b in bins.values())


def test_other_tokenizers_go_text_by_text(tmp_path):
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    from velograph.llm.text import chunks

    parts = json.loads(open(word_tokenizer()).read())
    parts["normalizer"] = None
    (tmp_path / "t.json").write_text(json.dumps(parts))
    own, batch = Tokenizer.from_file(str(tmp_path / "t.json")), packing.BatchTokenizer(str(tmp_path / "t.json"))
    texts = ["Upper CASE", "", "two words"]
    for c in chunks(pa.array(texts)):
        ids, at = batch.encode(c)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [own.encode(x, add_special_tokens=False).ids for x in texts]


def test_tokenizer_equals_its_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from velograph.llm.text import chunks

    own, batch = Tokenizer.from_file(word_tokenizer()), packing.BatchTokenizer(word_tokenizer())
    rng = np.random.default_rng(5)
    letters = list("aBz09'éÈßÿÀ×÷ \t\ńs<|endoftext|>½\x1c_日Σİ-!\xa0\x85")
    texts = ["".join(rng.choice(letters, rng.integers(50))) for _ in range(500)] + ["it's We'LL x<|endoftext|>y", "", "x" * 100]
    for c in chunks(pa.array(texts), 4000):
        ids, offsets = batch.encode(c)
        for i in range(c.n):
            assert own.encode(texts[c.first + i], add_special_tokens=False).ids == ids[offsets[i] : offsets[i + 1]].tolist()


def test_placing_respects_every_limit():
    rng = np.random.default_rng(6)
    demand = np.stack([rng.integers(1, 100, 500), np.ones(500, int), rng.integers(0, 50, 500)], 1)
    limits = np.array([256, 4, 90])
    bins, _ = packing.place(demand, limits)
    for b in np.unique(bins):
        assert (demand[bins == b].sum(0) <= limits).all()


def test_chat(spark):
    turns = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "a", "x"), (1, 2, "user", "more", "x"), (1, 3, "assistant", "b", "x"), (2, 0, "user", "hi", "x"), (2, 1, "assistant", "a", "x"), (2, 2, "user", "less", "x"), (3, 0, "user", "hi", "x"), (4, 0, "user", None, "x"), (None, 0, "user", "hi", "x"), (5, None, "user", "hi", "x"), (2, 1, "assistant", "a", "x")]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, place string")
    got = {(r["chosen_id"], r["rejected_id"]): r for r in chat.preferences(d).collect()}
    assert set(got) == {(1, 2), (1, 3), (4, None)}
    r = got[1, 2]
    assert r["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\na<|end|>\n" and r["prompt_turns"] == 2
    assert r["chosen"] == "<|user|>\nmore<|end|>\n<|assistant|>\nb<|end|>\n" and r["rejected"] == "<|user|>\nless<|end|>\n"
    (span,) = r["chosen_mask"]
    assert r["chosen"][span["start"] : span["end"]] == "b<|end|>\n" and r["rejected_mask"] == []
    assert got[1, 3]["prompt_turns"] == 1 and got[1, 3]["rejected"] == "" and got[4, None]["prompt"] == ""
    assert chat.preferences(d.limit(0)).count() == 0


def brute_preferences(turns):
    convs = {}
    for c, t, role, text, *_ in turns:
        if c is not None and t is not None:
            convs.setdefault(c, set()).add((t, role or "", text or ""))
    convs = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    first = {}
    for c in sorted(convs):
        first.setdefault(convs[c][0], []).append(c)
    out = set()
    for chosen, *others in first.values():
        for o in others or [None]:
            a, b = convs[chosen], convs[o] if o is not None else []
            fork = next((i for i in range(max(len(a), len(b))) if i >= len(a) or i >= len(b) or a[i] != b[i]), len(a))
            text = lambda x: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in x)
            loss = lambda x: sum(len(t) + 8 for r, t in x if r == "assistant")
            sha = lambda x: hashlib.sha256(text(x).encode()).hexdigest()
            out.add((chosen, o, fork, sha(a[:fork]), sha(a[fork:]), sha(b[fork:]), loss(a[fork:]), loss(b[fork:])))
    return out


def test_chat_equals_brute_force(spark):
    rng = np.random.default_rng(14)
    turns = []
    for c in range(120):
        for t in range(int(rng.integers(1, 7))):
            turns.append((c, t if rng.random() < 0.9 else 0, ["user", "assistant", None][rng.integers(3)], ["é", "yes", None, "x" * 50_000][rng.integers(4)] if t else "hi", "own"))
    turns += turns[:40]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, chosen string").repartition(6)
    got = {tuple(r) for r in chat.digests(d).select("chosen_id", "rejected_id", "prompt_turns", "prompt_sha256", "chosen_sha256", "rejected_sha256", "chosen_loss_chars", "rejected_loss_chars").collect()}
    assert got == brute_preferences(turns)


def test_warc(spark, tmp_path):
    trap = "x" * 150 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nX-Page: 666\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "y" * 50
    rows = [(5, "http://a", "é" * 100), (3, "http://b\r\nX: y", "é" * 100), (9, None, "é" * 100), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", trap), (8, "u", trap), (8, "u", trap)]
    d = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(d).collect())
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    first = {3: 3, 5: 3, 9: 3, 7: 7, 8: 7}
    want = sorted((i, len((h or "").encode()), sha(h), "revisit" if first.get(i, i) != i else "response", first[i] if first.get(i, i) != i else None) for i, _, h in rows)
    assert got == want
    warc.write(d, str(tmp_path / "w"))
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, str(tmp_path / "w"), payloads=True).where("kind = 'response'").collect()}
    assert payloads[7] == trap and payloads[3] == "é" * 100
    assert warc.round_trip(d.limit(0)).count() == 0


def test_warc_rolls_files_and_bears_null_ids(spark, tmp_path):
    rows = [(i, "u", f"page {i} " * 40) for i in range(60)] + [(None, "u", "copy " * 30), (None, "u", "copy " * 30), (80, "u", "copy " * 30), (None, "u", "only " * 30), (90, "u", "z" * 20_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(d, str(tmp_path / "w"), file_bytes=8000, task_bytes=30_000)
    assert len(list((tmp_path / "w").glob("part-*"))) > 3
    got = {}
    for r in warc.read(spark, str(tmp_path / "w")).collect():
        assert r["sound"]
        got.setdefault((r["page_id"], r["bytes"]), []).append((r["kind"], r["refers_to"]))
    assert len(got) == 64 - 1 and got[90, 20_000] == [("response", None)]
    assert sorted(map(str, got[None, 150])) == sorted(map(str, [("response", None), ("revisit", 80), ("revisit", 80)]))
    assert got[80, 150] == [("response", None)]


def test_warc_many_imitated_headers(spark):
    """Magic lines cost linear time, whether or not they share a header's end."""
    import time

    lines = "WARC/1.1\r\n" * 100_000
    heads = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 20_000
    rows = [(1, "u", lines), (2, None, heads), (3, "u", "WARC/1.1\r\nContent-Length: " + "9" * 5000 + "\r\n\r\n" + lines), (4, "u", "\r\n" * 1000), (5, "u", "Content-Length: 3\r\n" * 50_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in warc.round_trip(d).collect()}
    assert got == {i: (len(h), hashlib.sha256(h.encode()).hexdigest(), "response") for i, _, h in rows}
    record = lambda body: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    data = record(lines.encode()) + record(heads.encode()) + record(b"")
    began = time.process_time()
    at, after = warc._candidates(data)
    on = warc.reachable(at, after, len(data))
    assert time.process_time() - began < 1
    assert sorted(at[on].tolist()) == [0, len(record(lines.encode())), len(data) - len(record(b""))] and len(at) >= 20_000
    assert [len(x) for x in warc._candidates(b"")] == [0, 0] and [len(x) for x in warc._candidates(b"WARC/1.1\r\n\r\n")] == [0, 0]


def test_broken_chain_is_reported():
    with pytest.raises(ValueError):
        warc.reachable(np.array([0, 10]), np.array([12, 20]), 20)
    assert warc.reachable(np.array([0, 5, 10]), np.array([10, 8, 20]), 20).tolist() == [True, False, True]


def test_quality(spark):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(600):
        grade = i % 3
        text = prose(rng, 60)
        text = " ".join(w.upper() + "!!" for w in text.split()) if grade == 0 else text.replace("w1", "vile", 5) if grade == 1 else text
        rows.append((i, text, "en", "s"))
        labels.append((i, int(grade > 0), int(grade == 1)))
    rows += [(1000, None, None, None), (1001, "", "en", "s"), (None, "w3 w4", "en", "s")]
    d = documents(spark, rows)
    lab = spark.createDataFrame([*labels[:500], (None, 1, 0), (5, None, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.grade_documents(d, lab).collect()}
    assert len(got) == len(rows)
    right = [got[i]["kept"] == (i % 3 == 2) for i in range(500, 600)]
    assert sum(right) / len(right) > 0.9
    assert quality.good_documents(d, lab).columns == d.columns
    assert quality.grade_documents(d, lab.limit(0)).where("NOT kept").count() == 0
    assert quality.grade_documents(empty(spark), lab).count() == 0


def test_classifiers_bear_unusual_rows(spark):
    """Very long and repeated texts, ties, clashing columns; equal texts get equal results whatever the partitions."""
    rng = np.random.default_rng(20)
    long = prose(rng, 60_000)
    rows = [(i, prose(rng, 40) + (" vile" if i % 3 else ""), "aa" if i % 2 else "bb", "s") for i in range(120)]
    rows += [(200, long, "aa", "s"), (201, long, "bb", "s")] + [(202, "same text", "aa", "s")] * 30 + [(203, "same text", "bb", "t")]
    d = documents(spark, rows).withColumns({"tail": F.lit("mine"), "expected_grade": F.lit(7), "hash": F.lit(1), "letters": F.lit("x"), "score": F.lit("y")})
    labels = spark.createDataFrame([(i, 1, int(i % 3 > 0), "x") for i in range(120)] + [(202, 0, 0, "x"), (202, 1, 0, "x"), (7, 0, 0, "x")], "doc_id long, quality int, toxic int, tail string")
    kept = quality.good_documents(d, labels)
    assert kept.columns == d.columns and {(r["tail"], r["expected_grade"]) for r in kept.collect()} == {("mine", 7)}
    for run, columns in ((lambda x: quality.grade_documents(x, labels), ("expected_grade", "kept")), (langid.identify, ("lang_pred", "score"))):
        one, two = run(d).collect(), run(d.repartition(7)).collect()
        assert len(one) == len(rows) and sorted(map(str, one)) == sorted(map(str, two))
        by = {}
        for r in one:
            by.setdefault(r["doc_id"], set()).add(tuple(r[c] for c in columns))
        assert by[200] == by[201] and by[202] == by[203] and len(by[202]) == 1


def test_samples_are_bounded(spark):
    from velograph.llm.features import sample

    rows = spark.range(300).select(F.xxhash64("id").alias("hash"), F.repeat(F.lit("x"), 100).alias("text"), F.col("id").alias("n"))
    assert sample(rows, 50, 10**9).count() == 50
    assert sample(rows.unionByName(rows), 50, 950).count() == 10
    assert sample(rows.limit(0), 50, 10).count() == 0


def test_language(spark):
    rng = np.random.default_rng(8)
    parts = {"aa": ["the", "ing", "and"], "bb": ["que", "eau", "é"], "cc": ["sch", "ung", "ß"], "dd": ["ció", "ñ", "lla"], "ee": ["szy", "rz", "ów"], "ff": ["ij", "een", "oo"]}
    rows = []
    for i in range(400):
        lang = list(parts)[i % 6]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(30)), lang, "s"))
    rows += [(1000, None, "aa", "s"), (1001, "", None, None), (1002, "123 !?", "aa", "s"), (None, "the ing", "aa", "s")]
    d = documents(spark, rows)
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held)
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) / len(held) > 0.95
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and got[1000]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(d.where("lang = 'aa'")).where("doc_id < 400").collect()} == {"aa"}
    assert langid.identify(empty(spark)).count() == 0
    code = langid.codewords(8)
    assert min((code[i] != code[j]).sum() for i in range(8) for j in range(i)) >= 8
