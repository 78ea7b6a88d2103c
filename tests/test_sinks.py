"""Sinks that become visible whole, and place search against plain Python."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from velograph.operators import serving
from velograph.sources import files, named, versions


def rows(df):
    return sorted((r["source"], r["id"]) for r in df.collect())


def test_import_replaces_a_source_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/paths"
    make = lambda *x: spark.createDataFrame(list(x), "source string, id long")
    with pytest.raises(ValueError, match="no import"):
        versions.read(spark, path)
    versions.replace(make(("a", 1), ("a", 2), ("b", 3), ("c", 4)), path, "first", {"a": 9})
    old = versions.manifest(path)
    before = versions.read(spark, path, old)
    # the second of two sources fails after the first one's rows were made
    poison = make(*[("a", 10 + i) for i in range(50)], ("b", -1)).withColumn("id", F.when(F.col("id") < 0, F.raise_error(F.lit("injected")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="injected"):
        versions.replace(poison.repartition(2), path, "broken")
    assert versions.manifest(path) == old and rows(versions.read(spark, path)) == [("a", 1), ("a", 2), ("b", 3), ("c", 4)]
    versions.replace(make(("b", 30), ("b", 31)), path, "second", {"b": 5, "c": 0})
    assert rows(versions.read(spark, path)) == [("a", 1), ("a", 2), ("b", 30), ("b", 31)]
    assert rows(before) == [("a", 1), ("a", 2), ("b", 3), ("c", 4)]  # a reader that began before goes on with what it saw
    for _ in range(2):
        versions.replace(make(("b", 30), ("b", 31)), path, "again")
        assert rows(versions.read(spark, path)) == [("a", 1), ("a", 2), ("b", 30), ("b", 31)]
    got = [tuple(r) for r in versions.imports(spark, path).orderBy("import_id").collect()]
    assert got == [(1, "a", "first", 9, 2), (2, "b", "first", 1, 1), (3, "c", "first", 1, 1), (4, "b", "second", 5, 2), (5, "c", "second", 0, 0), (6, "b", "again", 2, 2), (7, "b", "again", 2, 2)]
    many = len(files.names(path))
    versions.vacuum(path)
    assert len(files.names(path)) < many and rows(versions.read(spark, path)) == [("a", 1), ("a", 2), ("b", 30), ("b", 31)]


def test_import_notices_another_one(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "paths")
    d = spark.createDataFrame([("a", 1)], "source string, id long")
    versions.replace(d, path, "first")
    real, calls = versions.manifest, []

    def moved(p):
        calls.append(1)
        return real(p) | ({"version": 99} if len(calls) == 2 else {})

    monkeypatch.setattr(versions, "manifest", moved)
    with pytest.raises(versions.Changed):
        versions.replace(d, path, "late")
    assert real(path)["version"] == 1


def test_named_files(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    tiles = [(14, x, y, None if x == y else (b"" if x == 1 else bytes([x, y]) * 50)) for x in range(6) for y in range(6)]
    d = spark.createDataFrame(tiles, "z int, tx long, ty long, mvt binary").repartition(3)
    named.write_tiles(d, path)
    want = sorted((z, x, y, t) for z, x, y, t in tiles if t)
    read = lambda: sorted((r["z"], r["tx"], r["ty"], bytes(r["mvt"])) for r in named.read_tiles(spark, path).collect())
    assert read() == want
    root = files.read_manifest(path)["root"]
    assert (tmp_path / "out" / root / "14" / "2" / "5.mvt").read_bytes() == bytes([2, 5]) * 50 and not (tmp_path / "out" / root / "14" / "3" / "3.mvt").exists()
    # an attempt that is repeated leaves each file once; one that is lost isn't read
    writer = named.NamedWriter(path)
    batch = named.NamedReader._batch([("a/b.txt", b"1"), ("c.txt", b"2")])
    writer.write(iter([batch]))
    told = writer.write(iter([batch]))
    assert read() == want
    writer.commit([told, None, writer.write(iter([]))])
    assert sorted((r["name"], bytes(r["content"])) for r in named.read_files(spark, path).collect()) == [("a/b.txt", b"1"), ("c.txt", b"2")]
    lost = named.NamedWriter(path)
    lost.write(iter([batch]))
    lost.abort([])
    assert not any(x.startswith(lost.job) or x.startswith(root) for x in files.names(path))
    for bad in ("../up", "/etc/x", "a//b", "", ".hidden", "a/../b"):
        with pytest.raises(ValueError, match="not a file's name"):
            lost.write(iter([named.NamedReader._batch([(bad, b"x")])]))
    failing = d.withColumn("mvt", F.when((F.col("tx") == 4) & (F.col("ty") == 5), F.raise_error(F.lit("injected")).cast("binary")).otherwise(F.col("mvt")))
    with pytest.raises(Exception, match="injected"):
        named.write_tiles(failing, path)
    assert len(named.read_files(spark, path).collect()) == 2
    named.write_features(spark.createDataFrame([("7", '{"type":"Feature"}'), ("8", None)], "request_id string, feature string"), path)
    assert [(r["name"], bytes(r["content"])) for r in named.read_files(spark, path).collect()] == [("routes/7.geojson", b'{"type":"Feature"}')]
    named.write_tiles(d.limit(0), path)
    assert named.read_tiles(spark, path).count() == 0


FEATURES = "place_id long, name string, named boolean, housenumber string, street string, locality string, district string, city string, postcode string, state string, osm_key string, osm_value string, lng_e7 long, lat_e7 long"


def test_place_search_equals_brute_force(spark):
    rng = np.random.default_rng(41)
    names = ["Ärger Lane", "Barassi Way", "bar", "St. Kilda", "Straße 9", "O'Hara", "Main Street", "Street"]
    places = []
    for i in range(300):
        key, value = [("highway", "bus_stop"), ("public_transport", "stop"), ("shop", "x"), (None, None), ("railway", "platform")][int(rng.choice(5, p=[0.1, 0.1, 0.6, 0.1, 0.1]))]
        outside = 100_000_000 if i % 17 == 0 else 0
        places.append((i, names[i % 8], i % 5 > 0, str(i % 12) if i % 3 else None, ["Main Street", None, "Oak Street", ""][i % 4], ["Jolimont", None][i % 2], ["Yarra", None, "Jolimont"][i % 3], "Melbourne", ["3000", None, "3121"][i % 3], "Victoria" if i % 9 else "Tasmania", key, value, 1_450_000_000 + int(rng.integers(9)) * 1000 + outside, -378_000_000))
    texts = ["bar", "STREET", " st main ", "jol 3", "melb  x", "", None, "...", "ärg", "straße", "s", "street street", "oak str melbourne victoria", "9"]
    asks = [(i, t, None if i % 3 == 0 else 1_450_004_321, None if i % 3 == 0 else -378_000_000) for i, t in enumerate(texts * 2)]
    got = {}
    for r in serving.search_places(spark.createDataFrame(places, FEATURES).repartition(3), spark.createDataFrame(asks, "query_id long, text string, near_lng_e7 long, near_lat_e7 long")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["place_id"], r["name"], r["detail"]))
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    made = {r["place_id"]: (r["name"], r["detail"]) for r in serving.place_of(spark.createDataFrame(places, FEATURES)).collect()}
    want = {}
    for q, text, lng, _ in asks:
        hits = []
        for p in places:
            i, name, own, number, street, locality, district, city, postcode, _, key, value, x, _ = p
            label = words(" ".join(s for s in (name if own else None, number, street, locality, district, city, postcode) if s is not None))
            if x > 1_501_000_000 or key == "public_transport" or f"{key}={value}" in ("highway=bus_stop", "railway=tram_stop", "railway=platform"):
                continue
            if words(text) and all(any(w.startswith(t) for w in label) for t in words(text)):
                hits.append((0 if lng is None else abs((lng + 500) // 1000 * 1000 - x), i))
        seen, out = set(), []
        for _, i in sorted(hits)[:12]:
            if i in made and made[i] not in seen:
                seen.add(made[i])
                out.append((len(out) + 1, i, *made[i]))
        if out:
            want[q] = out[:6]
    assert {q: sorted(x) for q, x in got.items()} == want and len(want) > 10
