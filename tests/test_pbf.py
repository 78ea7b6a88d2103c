"""Map extracts: the format's variants by hand-made blocks, and files through Spark."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from velograph.sources import files, pbf


def test_varints_and_zigzag():
    x = np.array([0, 1, 127, 128, 300, 2**32, 2**63, 2**64 - 1], np.uint64)
    raw, offsets = pbf.to_varints(x)
    assert (pbf.varints(np.frombuffer(raw, np.uint8)) == x).all() and offsets.tolist() == [0, 1, 2, 3, 5, 7, 12, 22, 32]
    s = np.array([0, -1, 1, -(2**63), 2**63 - 1, 12345, -99999], np.int64)
    assert (pbf.signed(pbf.zigzag(s)) == s).all()
    assert pbf.to_varints(np.empty(0, np.uint64))[0] == b"" and not len(pbf.varints(np.empty(0, np.uint8)))


def pack(x, zig=False):
    x = np.array(x)
    return pbf.to_varints(pbf.zigzag(x) if zig else x)[0]


def test_blocks_of_other_writers():
    """Plain nodes, several groups, granularity and offsets, ways without tags or refs, infos to pass over."""
    m = pbf._message
    table = m(*((1, w.encode()) for w in ["", "highway", "path", "naïve", "雪"]))
    info = m((1, 3), (3, 7))
    nodes = [(1, m((1, int(pbf.zigzag(np.array([-5]))[0])), (2, pack([1, 3])), (3, pack([2, 4])), (4, info), (8, int(pbf.zigzag(np.array([-20]))[0])), (9, int(pbf.zigzag(np.array([30]))[0]))))]
    dense = m((1, pack([10, -3, 4], True)), (5, info), (8, pack([1, 1, 1], True)), (9, pack([-2, 0, 5], True)))
    ways = [(3, m((1, 77), (2, pack([1])), (3, pack([2])), (4, info), (8, pack([10, -3, 4], True)))), (3, m((1, 78))), (3, m((1, 79), (2, pack([3])), (3, pack([4])), (8, pack([7], True))))]
    block = m((1, table), (2, m(*nodes)), (2, m((2, dense))), (2, m(*ways)), (17, 1000), (19, 10_000), (20, (1 << 64) - 50_000))
    got = [r for b in pbf.decoded(block, "node") for r in b.to_pylist()]
    assert [(r["id"], dict(r["tags"]), r["lng_e7"], r["lat_e7"]) for r in got] == [
        (10, {}, -520, 110), (7, {}, -520, 120), (11, {}, -470, 130), (-5, {"highway": "path", "naïve": "雪"}, -200, -100),
    ] or [(r["id"], dict(r["tags"]), r["lng_e7"], r["lat_e7"]) for r in got] == [(-5, {"highway": "path", "naïve": "雪"}, -200, -100), (10, {}, -520, 110), (7, {}, -520, 120), (11, {}, -470, 130)]
    got = [r for b in pbf.decoded(block, "way") for r in b.to_pylist()]
    assert [(r["id"], dict(r["tags"]), r["refs"]) for r in got] == [(77, {"highway": "path"}, [10, 7, 11]), (78, {}, []), (79, {"naïve": "雪"}, [7])]
    assert [r["id"] for b in pbf.decoded(block, "way", "highway") for r in b.to_pylist()] == [77]
    assert list(pbf.decoded(block, "way", "surface")) == []


def test_blobs_and_headers():
    data = b"some block" * 50
    assert pbf.unpacked(pbf._message((1, data))) == data
    assert pbf.unpacked(pbf._message((2, len(data)), (3, zlib.compress(data)))) == data
    assert pbf.unpacked(pbf._message((2, len(data)), (7, zstandard.ZstdCompressor().compress(data)))) == data
    with pytest.raises(ValueError, match="unknown way"):
        pbf.unpacked(pbf._message((2, len(data)), (4, b"lzma")))
    with pytest.raises(ValueError, match="HistoricalInformation"):
        pbf.check_header(pbf._message((4, b"OsmSchema-V0.6"), (4, b"HistoricalInformation")))


def test_files_through_spark(spark, tmp_path):
    rng = np.random.default_rng(8)
    nodes = [(int(i), {"k": f"v{i % 7}"} if i % 3 == 0 else None, int(rng.integers(-1_800_000_000, 1_800_000_000)), int(rng.integers(-900_000_000, 900_000_000))) for i in rng.permutation(5000)]
    ways = [(i, {"highway": "path", "name": f"Way {i} ä"} if i % 2 else {}, [int(x) for x in rng.integers(0, 6000, i % 9)]) for i in range(1000)]
    n = spark.createDataFrame(nodes, pbf.TYPES["node"]).repartition(3)
    w = spark.createDataFrame(ways, pbf.TYPES["way"]).repartition(2)
    path = f"file://{tmp_path}/extract"
    pbf.write_pbf(n, path, "node", entities=300)
    pbf.write_pbf(w, path, "way", entities=100)
    assert len(files.read_manifest(path)["files"]) == 5
    back = pbf.read_pbf(spark, path, "node", split=4000)
    assert back.rdd.getNumPartitions() > 10
    assert sorted((r["id"], r["tags"], r["lng_e7"], r["lat_e7"]) for r in back.collect()) == sorted((i, t or {}, x, y) for i, t, x, y in nodes)
    ways_back = pbf.read_pbf(spark, path, "way", split=4000)
    assert sorted((r["id"], r["tags"], r["refs"]) for r in ways_back.collect()) == sorted((i, t, r) for i, t, r in ways)
    assert {r["id"] for r in pbf.read_pbf(spark, path, "way", having="highway").collect()} == {i for i, t, _ in ways if t}
    at = {i: (x, y) for i, _, x, y in nodes}
    want = {}
    for i, _, refs in ways:
        line = [at[r] for r in refs if r in at]
        line = [p for k, p in enumerate(line) if k == 0 or p != line[k - 1]]
        if len(line) >= 2:
            want[i] = line
    got = {r["id"]: [(p["lng_e7"], p["lat_e7"]) for p in r["coordinates"]] for r in pbf.with_lines(ways_back, back).collect()}
    assert got == want
    # one file alone, a cut one, an empty table, and a replaced extract
    one = f"{tmp_path}/extract/{files.read_manifest(path)['files'][0]}"
    assert 0 < pbf.read_pbf(spark, one, "node").count() < 5000
    with open(one, "rb") as f:
        data = f.read()
    (tmp_path / "cut.osm.pbf").write_bytes(data[:-5])
    with pytest.raises(Exception, match="ends within a blob"):
        pbf.read_pbf(spark, f"{tmp_path}/cut.osm.pbf", "node").collect()
    pbf.write_pbf(w.limit(0), path, "way", mode="overwrite")
    assert pbf.read_pbf(spark, path, "way").count() == 0 and files.names(path) == ["manifest.json"]


def test_empty_columns_keep_their_types():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([None, []], pa.map_(pa.string(), pa.string())), pa.array([None, [5, 6]], pa.list_(pa.int64()))], ["id", "tags", "refs"])
    got = [r for b in pbf.decoded(pbf.encoded(batch, "way"), "way") for r in b.to_pylist()]
    assert [(r["id"], list(r["tags"]), r["refs"]) for r in got] == [(1, [], []), (2, [], [5, 6])]
