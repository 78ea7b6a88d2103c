"""Whitening, importance resampling and token shards against brute force, with the unusual inputs each has to bear."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from velograph.llm import resample, tokens, whitening
from velograph.llm.packing import END_ID
from velograph.llm.queries import word_tokenizer
from velograph.sources import files

VECTORS = "vec_id long, embedding array<float>, n long, u string, component int"


def plain_whitening(rows, k, scale=64):
    """From the definition: exact integers, an eigendecomposition of the covariance of the distinct vectors."""
    x = {i: np.floor(scale * np.array(v, float)).astype(int) + 1_000_000 for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, s = len(fit), fit.sum(0)
    mean = np.array([float(a % n) / n for a in s]) + s // n
    centred = (fit - s // n).astype(float) - np.array([float(a % n) / n for a in s])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1].T
    return n, {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(y, s, strict=True)) for i, y in x.items()}, {i: v[:k] @ (y - mean) / np.sqrt(e[:k]) for i, y in x.items()}, e[:k] / e.sum()


def test_whitening_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 32)
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((400, 12)) * np.array([2.0**-i for i in range(12)]) * 8 + rng.standard_normal(12) * 30).astype(np.float32)
    rows = [(i, v[i].tolist()) for i in range(400)] + [(1000 + i, v[7].tolist()) for i in range(200)]  # a third are copies
    bad = [(2000, None), (2001, [None] + [1.0] * 11), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12)]
    d = spark.createDataFrame([(*r, 5, "own", 1) for r in rows + bad] + [(None, v[3].tolist(), None, None, None)], VECTORS).repartition(9)
    got = whitening.whiten(d, components=10).collect()
    n, deviation, whitened, explained = plain_whitening(rows, 10)
    assert len(got) == 601 * 10 and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, 11))
    assert all(0 <= r["identity_error"] <= 1e-4 for r in got) and len({r["identity_error"] for r in got}) == 1
    sign = {}
    for r in got:
        i = 3 if r["vec_id"] is None else r["vec_id"]
        assert r["deviation"] == deviation[i]
        assert math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
        want = whitened[i][r["component"] - 1]
        sign.setdefault(r["component"], np.sign(want) * np.sign(r["whitened"]))
        assert abs(r["whitened"] * sign[r["component"]] - want) < 1e-8
    assert len({(r["component"], r["whitened"]) for r in got if r["vec_id"] == 7 or (r["vec_id"] or 0) >= 1000}) == 10


def test_merging_summaries_loses_nothing():
    rng = np.random.default_rng(4)
    u = rng.integers(-900, 900, (300, 7)) + 10**12
    whole = whitening.summarise(u)
    parts = [whitening.summarise(x) for x in np.array_split(u, 11)] + []
    while len(parts) > 1:
        parts = [whitening.merge(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    assert parts[0][:2] == whole[:2] == (300, [int(x) for x in u.sum(0)])
    centred = (u - 10**12).astype(float) - (u - 10**12).mean(0)
    for _, _, f in (whole, parts[0]):
        np.testing.assert_allclose(f.T @ f, centred.T @ centred, rtol=1e-12, atol=1e-3)


def test_whitening_of_few_or_degenerate_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0])] * 5)).count() == 0  # no variance
    assert whitening.whiten(make([(1, []), (2, [])])).count() == 0
    got = whitening.whiten(make([(i, [i / 4, 3.0, i / 2, float(i * i % 5)]) for i in range(9)])).collect()
    assert len(got) == 9 * 2 and {r["component"] for r in got} == {1, 2}  # constant and dependent dimensions have none of their own
    rows = [(i, [i / 4, 3.0]) for i in range(9)] + [(50, [1e9 / 64, 3.0])]
    got = whitening.whiten(make(rows)).collect()
    _, deviation, _, _ = plain_whitening(rows, 1)
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: d if d < 2**63 else None for i, d in deviation.items()} and None in {r["deviation"] for r in got}
    assert {r["deviation"] for r in whitening.whiten(make([*rows, (51, [1e300, 1.0])])).collect()} == {None}
    with pytest.raises(Exception, match="differ in length"):
        whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0]), (3, [2.0])]).coalesce(1)).collect()


def plain_resample(docs, target, percent=5, least=20):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    big_s, big_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for i, text in docs:
        n, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("segment", [5, 4096])
def test_resampling_equals_brute_force(spark, segment):
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(f"w{rng.integers(60)}" for _ in range(n))
    docs = [(i, prose(int(rng.integers(1, 80)))) for i in range(120)]
    docs += [(200 + i, docs[3][1]) for i in range(60)] + [(4, docs[4][1]), (4, docs[5][1]), (None, prose(30)), (None, prose(25))]
    docs += [(300, None), (301, ""), (302, "... \t\n"), (303, "Él Niño ÀÉ straße WoRd-word's x\x00y 漢字"), (304, "one"), (305, "ONE two"), (306, prose(9000)), (307, "x" * 200_000), (308, "İ K KELVIN " * 9)]
    target = [prose(40), None, "", "Niño w1 w2 w3"]
    d = spark.createDataFrame([(i, t, "own", 1, 2) for i, t in docs], "doc_id long, text string, row string, words int, rank int").repartition(6)
    b = spark.createDataFrame([(n, t) for n, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(d, b, segment=segment).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_resample(docs, target)
    assert resample.resample(d.limit(0), b).count() == 0
    none = resample.resample(d.where("doc_id = 5"), b.limit(0)).collect()
    assert [tuple(r) for r in none] == plain_resample([x for x in docs if x[0] == 5], [])


def library_ids(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(word_tokenizer())
    return [own.encode(t or "", add_special_tokens=False).ids + [END_ID] for t in texts]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_shards_round_trip(spark, tmp_path, monkeypatch, planes):
    monkeypatch.setattr(tokens, "LEAST_BYTES", 20_000)
    rng = np.random.default_rng(6)
    prose = lambda n: " ".join(f"word{rng.integers(300)}" for _ in range(n))
    docs = [(int(i), prose(int(rng.integers(0, 90)))) for i in rng.permutation(300)]
    docs += [(7, "again"), (7, None), (None, "no id"), (None, ""), (-5, "first"), (2**62, "last of those with ids"), (1000, prose(20_000)), (1001, "Né ☃ <|endoftext|> a's 42")]
    d = spark.createDataFrame([(i, t, "own", 1) for i, t in docs], "doc_id long, text string, tokens string, place int").coalesce(1)
    path = f"file://{tmp_path}/shards"
    tokens.write(d, word_tokenizer(), path, block=1000, planes=planes)
    want, start = [], 0
    for (i, _), ids in sorted(zip(docs, library_ids([t for _, t in docs]), strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        want.append((i, start, len(ids), ids))
        start += len(ids)
    manifest = files.read_manifest(path)
    assert manifest["tokens"] == start and len(manifest["shards"]) > 2
    got = tokens.register(spark).read.format("plane_tokens").option("ids", "array").option("split", 777).load(path)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == want
    digest = tokens.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("tokens")).collect()
    assert sorted((tuple(r) for r in digest), key=lambda r: r[1]) == [(i, s, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, n, ids in want]


def test_token_files_that_do_not_count(spark, tmp_path):
    """Attempts that no manifest lists are never read; overwriting switches whole; broken files are reported."""
    d = spark.createDataFrame([(i, f"document {i}") for i in range(50)], "doc_id long, text string")
    path = f"{tmp_path}/shards"
    tokens.write(d, word_tokenizer(), path)
    before = files.names(path)
    writer = tokens.TokenWriter(path, True, 1000, "byte")
    files.write_bytes(f"{path}/{writer.job}/000000-lost.tok", b"half a sh")
    assert tokens.read(spark, path).count() == 50
    writer.abort([])
    assert files.names(path) == before
    with pytest.raises(ValueError, match="has tokens already"):
        tokens.TokenWriter(path, False, 1000, "byte")
    tokens.write(d.limit(0), word_tokenizer(), path)
    assert tokens.read(spark, path).count() == 0 and files.names(path) == ["manifest.json"]
    tokens.write(d, word_tokenizer(), path)
    name = files.read_manifest(path)["shards"][0]["file"]
    whole = files.read_bytes(f"{path}/{name}")
    files.write_bytes(f"{path}/{name}", whole[:-3])
    with pytest.raises(Exception, match="is cut"):
        tokens.read(spark, path).collect()
    files.write_bytes(f"{path}/{name}", whole[:8] + bytes([whole[8] ^ 1]) + whole[9:])
    with pytest.raises(Exception, match="checksum|[Zz]std|decompress"):
        tokens.read(spark, path).collect()
    with pytest.raises(Exception, match="no tokens were committed"):
        tokens.read(spark, f"{tmp_path}/nothing").collect()


def test_planes_are_inverse():
    rng = np.random.default_rng(7)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        for kind, count in (("byte", 4), ("bit", 32)):
            planes = tokens.to_planes(ids, kind)
            assert len(planes) == count and (tokens.from_planes(planes, n) == ids).all()
    small = pa.array(np.arange(49408, dtype=np.uint32)).to_numpy()
    assert not any(b"".join(tokens.to_planes(small, "byte")[2:])) and not any(b"".join(tokens.to_planes(small, "bit")[16:]))
