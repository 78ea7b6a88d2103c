"""WARC archives: writing pages with revisit records, and reading them back by boundary-chain verification.

Writing: of pages with equal payloads of at least ``least`` bytes, the one with the smallest page_id becomes a response
record and the others revisit records that refer to it; all smaller payloads are responses. Spark's text writer makes the
files, with a record's closing CR LF CR LF as line separator, so its commit protocol covers lost executors. A task writes some
``task_bytes`` (less, where that makes fewer tasks than shuffle partitions) and rolls its file every ``file_bytes`` (by the mean size of a record), before gzip.

Reading: a payload may hold anything, the record magic included. So a task lists every place in a file where a record could
begin, with the offset at which its successor would begin by its own Content-Length; pointer jumping from the file's start
(each step doubles the distance covered) then keeps the reachable places only, and these alone are parsed. What a payload
imitates isn't on that chain, and costs a few numbers and a binary search. A chain that doesn't end exactly at the file's end is an error. As gzip
can't be read from the middle, a file is one task's, and must fit its memory.

Results for unusual input: a null html is the empty payload; a null url is an empty target; CR and LF in a url are percent-
encoded; a payload longer than a file makes a file of its own; a null page_id is kept as null and is nobody's response unless all equal payloads lack an id; rows with equal
page_id and payload are records of one kind; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..runtime import materialise, prepare, shared_folder

LEAST, FILE_BYTES, TASK_BYTES, HEADER = 100, 16 << 20, 64 << 20, 600
MAGIC = "WARC/1.1\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "page_id long, kind string, digest string, bytes long, refers_to long, sound boolean"


def records(pages: DataFrame, tasks: int, least: int = LEAST) -> DataFrame:
    """(page_id, record): each page's WARC record without its closing separator, dealt to as many partitions as tasks."""
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha2(F.col("html").cast("binary"), 256)})
    base = base.withColumn("place", F.xxhash64("page_id", "digest"))
    # copies are found on digests alone: counted before they are shuffled, and joined so that no digest meets in one task.
    # Only then are the revisits matched with their pages, whose texts move once, to their files.
    slim = materialise(base.where(F.col("bytes") >= least).select("page_id", "digest", "place"))
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("places")).where("places > 1")
    copies = salted_join(slim, first, ["digest"], ["place"], slim.count())
    revisits = copies.where(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))).select("place", "digest", F.col("first").alias("refers")).distinct()
    both = base.repartition(tasks, "place", "digest").join(revisits.repartition(tasks, "place", "digest").hint("shuffle_hash"), ["place", "digest"], "left")

    def uid(page_id) -> F.Column:
        h = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit(""))))
        return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]), F.lit(">"))

    def line(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    revisit = F.col("refers").isNotNull()
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", uid(F.col("page_id"))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", uid(F.col("refers"))), line("X-Refers-To-Page", F.col("refers").cast("string")))).otherwise(F.lit("")),
        line("X-Page", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.lit(len(HTTP)) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n" + HTTP),
        F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )
    return both.select("page_id", head.alias("record"))


def write(pages: DataFrame, path: str, least: int = LEAST, file_bytes: int = FILE_BYTES, task_bytes: int = TASK_BYTES) -> None:
    total = pages.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + HEADER), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    mean = max(1, total["bytes"] // max(1, total["n"]))
    # with fewer tasks than shuffle partitions Spark plans the join for these first, and shuffles the texts a second time
    tasks = max(int(total["bytes"] // task_bytes) + 1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = records(pages, tasks, least).select(F.col("record").alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, file_bytes // mean)).text(path)


_START = re.compile(rb"WARC/1\.[01](?=\r\n)")
#: A length has 18 digits at most; the first such line of a header counts.
_LENGTH = re.compile(rb"\r\nContent-Length: (\d{1,18})(?=\r\n)")


def _header(data: bytes, at: int) -> tuple[dict[bytes, bytes], int]:
    """Fields and end of a record's header; called for records on the chain only."""
    end = data.find(b"\r\n\r\n", at)
    return dict(x.split(b": ", 1) for x in reversed(data[at:end].split(b"\r\n")[1:]) if b": " in x), end + 4


def _number(value: bytes | None) -> int | None:
    return int(value) if value else None


def reachable(at: np.ndarray, successor: np.ndarray, size: int) -> np.ndarray:
    """Which candidate offsets lie on the chain from offset 0, by pointer jumping; it must end at ``size``."""
    order = np.argsort(at)
    n = len(at)
    place = np.searchsorted(at[order], successor)
    hit = (place < n) & (at[order][np.minimum(place, n - 1)] == successor)
    jump = np.where(hit, order[np.minimum(place, n - 1)], n)
    jump = np.append(jump, n)
    on = np.zeros(n + 1, bool)
    start = np.flatnonzero(at == 0)
    on[start] = True
    while True:
        seen = on.sum()
        on[jump[np.flatnonzero(on)]] = True
        on[n] = False
        jump = jump[jump]
        if on.sum() == seen and (jump[:n] == n).all():
            break
    if not len(start) or not n or successor[on[:n]].max() != size:
        raise ValueError("a chain of records doesn't reach the end of its file")
    return on[:n]


def _candidates(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each place where a record could begin, and where its successor would begin.

    The places of magic, of length lines and of blank lines are each listed in one pass and then matched by binary search, so
    headers that a payload imitates cost a few numbers each, however many of them share one end.
    """
    at = np.array([m.start() for m in _START.finditer(data)], np.int64)
    raw = np.frombuffer(data, np.uint8)
    blank = np.flatnonzero(raw[: max(0, len(raw) - 3)] == 13)
    blank = blank[(raw[blank + 1] == 10) & (raw[blank + 2] == 13) & (raw[blank + 3] == 10)]
    found = [(m.start(), int(m[1])) for m in _LENGTH.finditer(data)]
    place, length = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    if not len(blank) or not len(place):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends, own = np.searchsorted(blank, at), np.searchsorted(place, at)
    ok = (ends < len(blank)) & (own < len(place))
    at, end, own = at[ok], blank[ends[ok]], own[ok]
    stop = end + 4 + length[own]
    # its length line must stand before its end, and the blank line that closes a record where the length says
    close = np.minimum(np.searchsorted(blank, stop), len(blank) - 1)
    ok = (place[own] < end) & (blank[close] == stop)
    return at[ok], stop[ok] + 4


def _parsed(data: bytes, at: int) -> tuple:
    fields, body = _header(data, at)
    block = data[body : body + int(fields[b"Content-Length"])]
    payload = block[block.find(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") else block
    kind = fields.get(b"WARC-Type", b"").decode()
    digest = fields.get(b"WARC-Payload-Digest", b"").removeprefix(b"sha256:").decode()
    size = _number(fields.get(b"X-Payload-Length"))
    sound = kind != "response" or (hashlib.sha256(payload).hexdigest() == digest and len(payload) == size)
    return _number(fields.get(b"X-Page")), kind, digest, size, _number(fields.get(b"X-Refers-To-Page")), sound, payload


def _records(payloads: bool):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()] + [pa.binary()] * payloads
    names = ["page_id", "kind", "digest", "bytes", "refers_to", "sound"] + ["payload"] * payloads

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_buffer().to_pybytes()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                if not data:
                    continue
                at, after = _candidates(data)
                chain = np.sort(at[reachable(at, after, len(data))])
                for some in np.array_split(chain, len(chain) // 256 + 1):
                    rows = [_parsed(data, i) for i in some.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[: len(kinds)], kinds, strict=True)], names)

    return run


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """page_id, kind, digest, bytes, refers_to, sound (and payload) of every record on the chains of the archives."""
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("content").where(F.length("content") > 0)
    return files.mapInArrow(_records(payloads), _RECORD + ", payload binary" * payloads)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the pages to archives in the shared folder and describe what reading them gives."""
    spark = prepare(pages.sparkSession)
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least)
    back = read(spark, path)
    checked = F.when(F.col("sound"), F.col("digest")).otherwise(F.raise_error(F.lit("a payload doesn't have its record's digest")))
    return back.select("page_id", F.col("bytes").alias("payload_bytes"), checked.alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f
"""
