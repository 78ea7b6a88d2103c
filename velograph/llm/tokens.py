"""Token ids as binary shards by bit-plane shuffling.

A shard holds the ids of documents one after the other, cut into blocks of a fixed number of ids. A block's ids, as unsigned
32-bit integers, are transposed into planes (their four bytes, or their 32 bits), and each plane is compressed with
zstandard on its own: the planes that ids of a small vocabulary leave empty cost next to nothing. The chunk index at the end of
the file has each block's place, the sizes of its planes and its checksum, and the document index has each document's id
and length; so any range of documents is read from the blocks that hold it.

    magic | planes of block 0 | planes of block 1 | ... | footer (zstd) | length of the footer, 8 bytes | magic
    footer: number of blocks, planes and documents, block size (4 x 8 bytes) | per block: offset, ids, crc32, size of each plane
            (8 bytes each) | doc_id (8 bytes each) | whether it is null (1 byte each) | number of ids (8 bytes each)

Documents are dealt to shards by ranges of doc_id and sorted within each. Every task writes a file of its own name; when all
have ended, one manifest lists the files that count, with the number of ids before each. A lost or repeated task leaves no trace in it.

Results for unusual input: a null or empty text is the end id alone; a null doc_id is kept as null, after all others; rows of one
doc_id follow each other in the input's order and are documents of their own; texts of any length are one document over as many
blocks as it takes; an empty table gives an empty manifest and an empty result; other columns are ignored; a file whose blocks
don't have their checksums, or that was cut, raises an error.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..runtime import prepare, shared_folder
from ..sources import files
from .packing import END_ID, TOKEN_CHUNK, shared_tokenizer
from .text import chunks

MAGIC, LEVEL = b"VGTOKEN1", 3
#: Ids of a block; bytes of text that make a shard, at most and at least; ids that a reading task takes; ids that it holds at once.
BLOCK, SHARD_BYTES, LEAST_BYTES, SPLIT, HELD = 1 << 16, 256 << 20, 8 << 20, 1 << 23, 1 << 20
FORMAT = "plane_tokens"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The ids' bytes or bits, each plane on its own, the least significant first."""
    by_byte = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [p.tobytes() for p in by_byte.T]
    return [np.packbits(p, bitorder="little").tobytes() for p in np.unpackbits(by_byte, axis=1, bitorder="little").T]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    rows = [np.frombuffer(p, np.uint8) for p in planes]
    if len(rows) == 4:
        return np.stack(rows, 1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(r, count=n, bitorder="little") for r in rows], 1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class ShardWriter:
    """Writes documents' ids to a stream, one block at a time; only the indexes and less than a block stay in memory."""

    def __init__(self, out, block: int = BLOCK, planes: str = "byte"):
        self.out, self.block, self.planes = out, block, planes
        self.at, self.chunks, self.doc_ids, self.sizes = len(MAGIC), [], [], []
        self.rest, self.held = [], 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents whose ids stand one after the other in ``ids``."""
        self.doc_ids += doc_ids
        self.sizes.append(sizes)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            flat = np.concatenate(self.rest)
            whole = len(flat) - len(flat) % self.block
            for a in range(0, whole, self.block):
                self._write(flat[a : a + self.block])
            self.rest, self.held = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray) -> None:
        packed = [self.pack(p) for p in to_planes(ids, self.planes)]
        self.chunks.append([self.at, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), *map(len, packed)])
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> tuple[int, int]:
        """(documents, ids) written."""
        if self.held:
            self._write(np.concatenate(self.rest))
        sizes = np.concatenate([np.empty(0, np.int64), *self.sizes]).astype("<i8")
        head = struct.pack("<4q", len(self.chunks), 4 if self.planes == "byte" else 32, len(sizes), self.block)
        nulls = np.array([x is None for x in self.doc_ids], np.uint8)
        footer = self.pack(b"".join([head, np.array(self.chunks, "<i8").tobytes(), np.array([x or 0 for x in self.doc_ids], "<i8").tobytes(), nulls.tobytes(), sizes.tobytes()]))
        self.out.write(footer + struct.pack("<q", len(footer)) + MAGIC)
        return len(sizes), int(sizes.sum())


class Shard:
    """A shard's indexes, and its ids by range."""

    def __init__(self, source):
        self.source, size = source, source.size()
        tail = len(MAGIC) + 8
        end = source.read_at(tail, size - tail) if size >= tail + len(MAGIC) else b""
        if end[8:] != MAGIC:
            raise ValueError("a token shard is cut or isn't one")
        length = struct.unpack("<q", end[:8])[0]
        raw = zstandard.ZstdDecompressor().decompress(source.read_at(length, size - tail - length))
        n, planes, docs, self.block = struct.unpack("<4q", raw[:32])
        at = 32 + 8 * n * (3 + planes)
        self.chunks = np.frombuffer(raw, "<i8", n * (3 + planes), 32).reshape(n, 3 + planes)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.nulls = np.frombuffer(raw, np.uint8, docs, at + 8 * docs).astype(bool)
        self.sizes = np.frombuffer(raw, "<i8", docs, at + 9 * docs)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def blocks(self, a: int, b: int) -> np.ndarray:
        """The ids from place a until place b: the blocks that hold them are read, and no others."""
        if a >= b:
            return np.empty(0, "<u4")
        first, last = a // self.block, (b - 1) // self.block
        unpack, out = zstandard.ZstdDecompressor().decompress, []
        for offset, n, crc, *sizes in self.chunks[first : last + 1].tolist():
            raw = self.source.read_at(sum(sizes), offset)
            cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            ids = from_planes([unpack(raw[p:q]) for p, q in zip(cuts[:-1], cuts[1:], strict=True)], n)
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError("a block of a token shard doesn't have its checksum")
            out.append(ids)
        return np.concatenate(out)[a - first * self.block : b - first * self.block]


@dataclass
class Written(WriterCommitMessage):
    task: int
    file: str | None
    docs: int
    tokens: int


class TokenWriter(DataSourceArrowWriter):
    """Rows (doc_id, tokens), tokens as little-endian unsigned 32-bit integers; the order of partitions and rows is kept."""

    def __init__(self, path: str, overwrite: bool, block: int, planes: str):
        self.path, self.overwrite, self.block, self.planes, self.job = path, overwrite, block, planes, uuid.uuid4().hex
        if planes not in ("byte", "bit"):
            raise ValueError("planes are byte or bit")
        if not overwrite and files.read_manifest(path) is not None:
            raise ValueError(f"{path} has tokens already; mode overwrite replaces them")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        name, shard, stream = f"{self.job}/{task:06d}-{uuid.uuid4().hex}.tok", None, None
        for batch in iterator:
            if not len(batch):
                continue
            if shard is None:
                store, folder = files.opened(self.path)
                store.create_dir(f"{folder}/{self.job}", recursive=True)
                stream = store.open_output_stream(f"{folder}/{name}")
                shard = ShardWriter(stream, self.block, self.planes)
            column = batch.column("tokens").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            shard.add(batch.column("doc_id").to_pylist(), np.frombuffer(flat.tobytes(), "<u4"), np.diff(offsets) // 4)
        if shard is None:
            return Written(task, None, 0, 0)
        docs, tokens = shard.close()
        stream.close()
        return Written(task, name, docs, tokens)

    def commit(self, messages: list[Written | None]) -> None:
        listed, start = [], 0
        for m in sorted((m for m in messages if m and m.file), key=lambda m: m.task):
            listed.append({"file": m.file, "start": start, "docs": m.docs, "tokens": m.tokens})
            start += m.tokens
        files.write_manifest(self.path, {"tokens": start, "shards": listed})
        wanted = {x["file"] for x in listed} | {files.MANIFEST}
        files.discard(self.path, [x for x in files.names(self.path) if x not in wanted])

    def abort(self, messages: list[Written | None]) -> None:
        files.discard(self.path, [f"{self.job}/{x}" for x in files.names(f"{self.path}/{self.job}")])


@dataclass
class Part(InputPartition):
    """Of a shard, the documents that begin at the places from ``first`` until ``last``."""

    file: str
    start: int
    first: int
    last: int


class TokenReader(DataSourceReader):
    def __init__(self, path: str, split: int, ids: str):
        self.path, self.split, self.ids = path, split, ids

    def partitions(self) -> list[Part]:
        manifest = files.read_manifest(self.path)
        if manifest is None:
            raise ValueError(f"no tokens were committed to {self.path}")
        parts = [Part(x["file"], x["start"], a, min(a + self.split, x["tokens"])) for x in manifest["shards"] for a in range(0, x["tokens"], self.split)]
        return parts or [Part("", 0, 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        store, path = files.opened(f"{self.path}/{part.file}")
        with store.open_input_file(path) as source:
            shard = Shard(source)
            first, last = np.searchsorted(shard.starts[:-1], [part.first, part.last]).tolist()
            while first < last:
                stop = min(last, max(first + 1, int(np.searchsorted(shard.starts, shard.starts[first] + HELD, "right")) - 1))
                some = slice(first, stop)
                ids = shard.blocks(int(shard.starts[first]), int(shard.starts[stop]))
                ends = shard.starts[first : stop + 1] - shard.starts[first]
                if self.ids == "array":
                    tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int64)))
                else:
                    tokens = pa.Array.from_buffers(pa.binary(), stop - first, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids.tobytes())])
                doc_ids = pa.array(shard.doc_ids[some], mask=shard.nulls[some])
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(part.start + shard.starts[some]), pa.array(shard.sizes[some].astype(np.int64)), tokens], ["doc_id", "start", "n_tokens", "tokens"])
                first = stop


class TokenShards(DataSource):
    """Spark's format "plane_tokens". Options: ``block`` ids a block and ``planes`` (byte or bit) to write; ``split`` ids a task
    and ``ids`` (binary, or array of longs) to read."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"doc_id long, start long, n_tokens long, tokens {'array<long>' if self.options.get('ids') == 'array' else 'binary'}"

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"], overwrite, int(self.options.get("block", BLOCK)), self.options.get("planes", "byte"))

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options["path"], int(self.options.get("split", SPLIT)), self.options.get("ids", "binary"))


def register(spark: SparkSession) -> SparkSession:
    prepare(spark).dataSource.register(TokenShards)
    return spark


def _encode(path: str, end_id: int):
    def run(batches):
        tokenizer = shared_tokenizer(path)
        for batch in batches:
            for c in chunks(batch.column("text"), TOKEN_CHUNK):
                ids, offsets = tokenizer.encode(c)
                closed = np.insert(ids.astype("<u4"), offsets[1:], end_id)
                ends = (offsets + np.arange(c.n + 1)) * 4
                tokens = pa.Array.from_buffers(pa.large_binary(), c.n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(closed.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.first, c.n), tokens.cast(pa.binary())], ["doc_id", "tokens"])

    return run


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, tokens): each document's ids and the end id, in the order of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(tokenizer, end_id), "doc_id long, tokens binary")


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, block: int = BLOCK, planes: str = "byte") -> None:
    """All documents' ids, by ascending doc_id, as shards in ``path``."""
    spark = register(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    tasks = max(size // SHARD_BYTES, min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // LEAST_BYTES)) + 1
    order = [F.col("doc_id").asc_nulls_last(), F.col("place")]
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    sorted_ = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    encoded(sorted_, tokenizer, end_id).write.format(FORMAT).option("block", block).option("planes", planes).mode("overwrite").save(path)


def read(spark: SparkSession, path: str, ids: str = "binary") -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of all documents: start counts the ids of all documents before."""
    return register(spark).read.format(FORMAT).option("ids", ids).load(path)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents to the shared folder and describe what reading the files gives."""
    path = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, tokenizer, path)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))
