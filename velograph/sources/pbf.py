"""Protocol-buffer map extracts (.osm.pbf) as a Spark data source, for reading and writing.

A file is a chain of blobs, each behind a header with its size; a data blob holds some thousand nodes or ways with a string
table of their own. Planning walks the headers only (a few dozen bytes a blob; files side by side) and cuts each file into
ranges of whole blobs, so one large file is read by many tasks. A task decodes a blob column by column: all varints of a
column in one vectorised step, delta-coded ids and places by running sums, tags by indices into the string table.

Rows are (id, tags, refs) for ways and (id, tags, lng_e7, lat_e7) for nodes. A way without tags or refs has them empty. A file that is
cut, compressed in an unknown way or that asks for features beyond these raises an error.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..runtime import prepare
from . import files

FORMAT = "osm_pbf"
#: Bytes of a range that one task reads; entities of a blob that is written; files that are walked side by side.
SPLIT, ENTITIES, WALKERS = 16 << 20, 8000, 16
# Limits and names of the format, field numbers in its messages.
HEADER_LIMIT, BLOB_LIMIT = 64 << 10, 32 << 20
SUPPORTED = ("OsmSchema-V0.6", "DenseNodes")
TYPES = {"way": "id long, tags map<string,string>, refs array<long>", "node": "id long, tags map<string,string>, lng_e7 long, lat_e7 long"}


def varints(raw: np.ndarray) -> np.ndarray:
    """All varints of some bytes, as unsigned 64-bit integers."""
    ends = np.flatnonzero(raw < 128)
    if not len(ends):
        return np.empty(0, np.uint64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts + 1
    out = np.zeros(len(ends), np.uint64)
    for k in range(int(size.max())):
        longer = np.flatnonzero(size > k)
        out[longer] |= (raw[starts[longer] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def signed(u: np.ndarray) -> np.ndarray:
    """Zigzag numbers as signed ones."""
    return (u >> np.uint64(1)).astype(np.int64) ^ -(u & np.uint64(1)).astype(np.int64)


def zigzag(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    return ((x << 1) ^ (x >> 63)).astype(np.uint64)


def to_varints(u: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The numbers' varints one after the other, and the offset at which each begins (and the end)."""
    u = u.astype(np.uint64)
    size = np.ones(len(u), np.int64)
    for k in range(1, 10):
        size += (u >> np.uint64(7 * k)) > 0
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(offsets[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        longer = np.flatnonzero(size > k)
        more = (size[longer] > k + 1).astype(np.uint8) << 7
        out[offsets[longer] + k] = ((u[longer] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes(), offsets


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(field, value, 0) of varint fields and (field, first, last) of the bytes of all others, in a message."""
    end = len(data) if end is None else end
    while at < end:
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield key >> 3, value, 0
            continue
        size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
        yield key >> 3, at, at + size
        at += size


def _read(source, n: int, at: int) -> bytes:
    got = source.read_at(n, at)
    if len(got) < n:
        raise ValueError("a map extract ends within a blob")
    return got


def headers(source, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(kind, first, last) of the blobs whose headers begin from ``at`` until ``end``."""
    while at < end:
        size = int.from_bytes(_read(source, 4, at), "big")
        if size > HEADER_LIMIT:
            raise ValueError("a blob's header is longer than the format allows")
        head, kind, length = _read(source, size, at + 4), "", -1
        for field, a, b in fields(head):
            if field == 1:
                kind = head[a:b].decode()
            elif field == 3:
                length = a
        if not 0 <= length <= BLOB_LIMIT:
            raise ValueError("a blob's size is not what the format allows")
        first = at + 4 + size
        yield kind, first, first + length
        at = first + length


def unpacked(blob: bytes) -> bytes:
    for field, a, b in fields(blob):
        if field == 1:
            return blob[a:b]
        if field == 3:
            return zlib.decompress(blob[a:b])
        if field == 7:
            return zstandard.ZstdDecompressor().decompress(blob[a:b], BLOB_LIMIT)
        if field != 2:
            raise ValueError(f"a blob is compressed in an unknown way ({field})")
    return b""


def check_header(block: bytes) -> None:
    needed = [block[a:b].decode() for field, a, b in fields(block) if field == 4]
    if odd := [x for x in needed if x not in SUPPORTED]:
        raise ValueError(f"a map extract needs {', '.join(odd)}")


def _tags(strings: pa.Array, keys: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), strings.take(pa.array(keys.astype(np.int64))), strings.take(pa.array(values.astype(np.int64))))


class _Spans:
    """Byte ranges of one packed column, a range for each entity, decoded together."""

    def __init__(self, data: bytes, spans: list[tuple[int, int]]):
        raw = np.frombuffer(b"".join([data[a:b] for a, b in spans]), np.uint8)
        self.values = varints(raw)
        ends = np.cumsum([0] + [b - a for a, b in spans])
        self.offsets = np.concatenate([[0], np.cumsum(raw < 128)])[ends]


def _runs(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at every offset."""
    total = np.concatenate([[0], np.cumsum(x)])
    return total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets))


def _ways(data: bytes, found: list[tuple[int, int]], strings: pa.Array, having: int | None) -> pa.RecordBatch:
    ids, keys, values, refs = [], [], [], []
    for a, b in found:
        mine = {1: 0, 2: (0, 0), 3: (0, 0), 8: (0, 0)}
        for field, p, q in fields(data, a, b):
            if field in mine:
                mine[field] = p if field == 1 else (p, q)
        ids.append(mine[1])
        keys.append(mine[2])
        values.append(mine[3])
        refs.append(mine[8])
    keys, values, refs = (_Spans(data, x) for x in (keys, values, refs))
    nodes = _runs(signed(refs.values), refs.offsets)
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _tags(strings, keys.values, values.values, keys.offsets), pa.ListArray.from_arrays(pa.array(refs.offsets, pa.int32()), pa.array(nodes))], ["id", "tags", "refs"])
    if having is None:
        return batch
    hits = np.concatenate([[0], np.cumsum(keys.values == having)])
    return batch.filter(pa.array(hits[keys.offsets[1:]] > hits[keys.offsets[:-1]]))


def _e7(x: np.ndarray, granularity: int, offset: int) -> pa.Array:
    """Coordinates come in units of ``granularity`` nanodegrees."""
    return pa.array((x * granularity + offset + 50) // 100)


def _dense(data: bytes, a: int, b: int, strings: pa.Array, granularity: int, lat: int, lng: int) -> pa.RecordBatch:
    column = {field: np.frombuffer(data, np.uint8, q - p, p) for field, p, q in fields(data, a, b) if field in (1, 8, 9, 10)}
    ids, y, x = (np.cumsum(signed(varints(column.get(f, np.empty(0, np.uint8))))) for f in (1, 8, 9))
    pairs = varints(column.get(10, np.empty(0, np.uint8)))
    stops = np.flatnonzero(pairs == 0) if len(pairs) else np.full(len(ids), -1)  # a zero ends a node's pairs
    counts = np.diff(stops, prepend=-1) // 2 if len(pairs) else np.zeros(len(ids), np.int64)
    rest = pairs[pairs != 0]
    return pa.RecordBatch.from_arrays([pa.array(ids), _tags(strings, rest[0::2], rest[1::2], np.concatenate([[0], np.cumsum(counts)])), _e7(x, granularity, lng), _e7(y, granularity, lat)], ["id", "tags", "lng_e7", "lat_e7"])


def _plain(data: bytes, found: list[tuple[int, int]], strings: pa.Array, granularity: int, lat: int, lng: int) -> pa.RecordBatch:
    rows, keys, values = [], [], []
    for a, b in found:
        mine = {1: 0, 8: 0, 9: 0, 2: (0, 0), 3: (0, 0)}
        for field, p, q in fields(data, a, b):
            if field in mine:
                mine[field] = (p, q) if field in (2, 3) else p
        rows.append((mine[1], mine[8], mine[9]))
        keys.append(mine[2])
        values.append(mine[3])
    ids, y, x = signed(np.array(rows, np.uint64)).T
    keys, values = _Spans(data, keys), _Spans(data, values)
    return pa.RecordBatch.from_arrays([pa.array(ids), _tags(strings, keys.values, values.values, keys.offsets), _e7(x, granularity, lng), _e7(y, granularity, lat)], ["id", "tags", "lng_e7", "lat_e7"])


def decoded(data: bytes, entity: str, having: str | None = None) -> Iterator[pa.RecordBatch]:
    """The nodes or ways of a data block."""
    table, groups, granularity, lat, lng = (0, 0), [], 100, 0, 0
    for field, a, b in fields(data):
        if field == 1:
            table = (a, b)
        elif field == 2:
            groups.append((a, b))
        elif field == 17:
            granularity = a
        elif field in (19, 20):  # plain 64-bit numbers, negative ones in two's complement
            value = a - (1 << 64) if a >> 63 else a
            lat, lng = (value, lng) if field == 19 else (lat, value)
    words = [data[a:b] for field, a, b in fields(data, *table) if field == 1]
    key = None
    if having is not None:
        if having.encode() not in words:
            return
        key = words.index(having.encode())
    strings = pa.array(words, pa.binary()).cast(pa.string())
    for a, b in groups:
        parts = list(fields(data, a, b))
        if entity == "way":
            if found := [(p, q) for field, p, q in parts if field == 3]:
                yield _ways(data, found, strings, key)
            continue
        for field, p, q in parts:
            if field == 2:
                yield _dense(data, p, q, strings, granularity, lat, lng)
        if found := [(p, q) for field, p, q in parts if field == 1]:
            yield _plain(data, found, strings, granularity, lat, lng)


def _message(*parts: tuple[int, bytes | int]) -> bytes:
    """A message of (field, bytes or number)."""
    out = []
    for field, value in parts:
        if isinstance(value, int):
            out.append(to_varints(np.array([field << 3, value], np.uint64))[0])
        else:
            out += [to_varints(np.array([field << 3 | 2, len(value)], np.uint64))[0], value]
    return b"".join(out)


def blob(kind: str, data: bytes) -> bytes:
    body = _message((2, len(data)), (3, zlib.compress(data)))
    head = _message((1, kind.encode()), (3, len(body)))
    return len(head).to_bytes(4, "big") + head + body


def encoded(batch: pa.RecordBatch, entity: str) -> bytes:
    """A data block of some nodes or ways; the string table's first entry stays empty."""
    tags = batch.column("tags")
    counts = np.array([len(x) if x else 0 for x in tags.to_pylist()])
    pairs = [(k, v) for x in tags.to_pylist() for k, v in (x or [])]
    place = {w: i for i, w in enumerate(sorted({w for p in pairs for w in p}), 1)}
    keys, values = (np.array([place[p[i]] for p in pairs], np.uint64) for i in (0, 1))
    ends = np.concatenate([[0], np.cumsum(counts)])
    if entity == "way":
        (k, ko), (v, vo) = to_varints(keys), to_varints(values)
        lists = batch.column("refs")
        sizes = np.array([len(x) if x else 0 for x in lists.to_pylist()])
        flat = np.array([r for x in lists.to_pylist() for r in (x or [])], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        steps = np.diff(flat, prepend=0)
        heads = at[:-1][sizes > 0]
        steps[heads] = flat[heads]
        r, ro = to_varints(zigzag(steps))
        ways = []
        for i, way in enumerate(batch.column("id").to_pylist()):
            a, b = ends[i], ends[i + 1]
            ways.append((3, _message((1, way), (2, k[ko[a] : ko[b]]), (3, v[vo[a] : vo[b]]), (8, r[ro[at[i]] : ro[at[i + 1]]]))))
        group = _message(*ways)
    else:
        columns = [(f, to_varints(zigzag(np.diff(batch.column(c).to_numpy(), prepend=0)))[0]) for f, c in ((1, "id"), (8, "lat_e7"), (9, "lng_e7"))]
        mixed = np.zeros(2 * len(keys) + len(counts), np.uint64)
        where = np.repeat(np.arange(len(counts)), counts) + 2 * np.arange(len(keys))
        mixed[where], mixed[where + 1] = keys, values
        group = _message((2, _message(*columns, (10, to_varints(mixed)[0]))))
    table = _message(*((1, w.encode()) for w in ["", *place]))
    return _message((1, table), (2, group))


@dataclass
class Blobs(InputPartition):
    """The blobs of a file whose headers begin from ``first`` until ``last``."""

    file: str
    first: int
    last: int


class MapReader(DataSourceReader):
    def __init__(self, path: str, entity: str, having: str | None, split: int):
        self.path, self.entity, self.having, self.split = path, entity, having, split

    def _ranges(self, file: str) -> list[Blobs]:
        store, path = files.opened(file)
        with store.open_input_file(path) as source:
            size, at, out = source.size(), 0, []
            for kind, first, last in headers(source, 0, size):
                if last > size:
                    raise ValueError("a map extract ends within a blob")
                if kind == "OSMHeader":
                    check_header(unpacked(_read(source, last - first, first)))
                if last - at >= self.split or last == size:
                    out.append(Blobs(file, at, last))
                    at = last
            return out

    def partitions(self) -> list[Blobs]:
        manifest = files.read_manifest(self.path)
        if manifest is not None:
            found = [f"{self.path}/{x}" for x in manifest["files"]]
        else:
            found = [f"{self.path}/{x}".rstrip("/") for x in files.names(self.path) if x.endswith(".pbf")] or [self.path]
        with ThreadPoolExecutor(WALKERS) as pool:
            ranges = [r for each in pool.map(self._ranges, found) for r in each]
        return ranges or [Blobs("", 0, 0)]

    def read(self, part: Blobs) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        store, path = files.opened(part.file)
        with store.open_input_file(path) as source:
            for kind, first, last in headers(source, part.first, part.last):
                if kind == "OSMData":  # other kinds are to be passed over
                    yield from decoded(unpacked(_read(source, last - first, first)), self.entity, self.having)


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class MapWriter(DataSourceArrowWriter):
    """A file for each task; the manifest that lists them is written when all have ended. Appending adds to it."""

    def __init__(self, path: str, entity: str, overwrite: bool, entities: int):
        self.path, self.entity, self.overwrite, self.entities, self.job = path, entity, overwrite, entities, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, stream = f"{self.job}/{uuid.uuid4().hex}.osm.pbf", None
        for batch in iterator:
            for at in range(0, len(batch), self.entities):
                if stream is None:
                    store, folder = files.opened(self.path)
                    store.create_dir(f"{folder}/{self.job}", recursive=True)
                    stream = store.open_output_stream(f"{folder}/{name}")
                    stream.write(blob("OSMHeader", _message(*((4, x.encode()) for x in SUPPORTED))))
                stream.write(blob("OSMData", encoded(batch.slice(at, self.entities), self.entity)))
        if stream is None:
            return Written(None)
        stream.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        before = [] if self.overwrite else (files.read_manifest(self.path) or {"files": []})["files"]
        listed = before + sorted(m.file for m in messages if m and m.file)
        files.write_manifest(self.path, {"files": listed})
        files.discard(self.path, [x for x in files.names(self.path) if x != files.MANIFEST and x not in set(listed)])

    def abort(self, messages: list[Written | None]) -> None:
        files.discard(self.path, [f"{self.job}/{x}" for x in files.names(f"{self.path}/{self.job}")])


class MapExtract(DataSource):
    """Spark's format "osm_pbf". Options: ``entity`` (way or node); to read, ``having`` keeps ways with that tag and ``split`` is the
    size of a task's range; to write, ``entities`` go into a blob."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _entity(self) -> str:
        entity = self.options.get("entity", "way")
        if entity not in TYPES:
            raise ValueError("entity is way or node")
        return entity

    def schema(self) -> str:
        return TYPES[self._entity()]

    def reader(self, schema) -> MapReader:
        return MapReader(self.options["path"], self._entity(), self.options.get("having"), int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> MapWriter:
        return MapWriter(self.options["path"], self._entity(), overwrite, int(self.options.get("entities", ENTITIES)))


def register(spark: SparkSession) -> SparkSession:
    prepare(spark).dataSource.register(MapExtract)
    return spark


def read_pbf(spark: SparkSession, path: str, entity: str = "way", **options) -> DataFrame:
    return register(spark).read.format(FORMAT).options(entity=entity, **options).load(path)


def write_pbf(rows: DataFrame, path: str, entity: str, mode: str = "append", **options) -> None:
    names = [c.split()[0] for c in TYPES[entity].split(", ")]
    register(rows.sparkSession)
    rows.select(*names).write.format(FORMAT).options(entity=entity, **options).mode(mode).save(path)


def with_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds coordinates: the places of a way's nodes in order. Nodes that the extract lacks and repeated places drop out; ways
    that are left with one place or none go. Nodes meet the ways that name them by an equi-join, so only their places move."""
    named = ways.select("id", F.posexplode("refs").alias("pos", "node"))
    placed = named.join(nodes.select(F.col("id").alias("node"), "lng_e7", "lat_e7"), "node")
    point = lambda p: F.struct(p["lng_e7"].alias("lng_e7"), p["lat_e7"].alias("lat_e7"))
    lines = placed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lng_e7", "lat_e7"))), point).alias("line"))
    fresh = F.filter("line", lambda p, i: (i == 0) | (p != F.get("line", i - 1)))
    lines = lines.select("id", fresh.alias("coordinates")).where(F.size("coordinates") >= 2)
    return ways.join(lines, "id")
