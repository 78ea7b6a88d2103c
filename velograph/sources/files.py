"""Files on the storage that driver and executors share, by URI, and outputs that only become visible whole.

A job's tasks write files under names of their own; once all have ended, the driver writes one manifest that lists what counts.
Readers go by the manifest, so files of failed or repeated attempts are never read, and they are removed at the commit.
"""

from __future__ import annotations

import json
import re
import uuid

from pyarrow import fs

MANIFEST = "manifest.json"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it (file:, hdfs:, s3:, ... or none) and the path there."""
    if local := re.match(r"(?:file:/*(?=/))?(/.*)$", uri):
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def names(uri: str, below: str = "") -> list[str]:
    """Paths of all files under a folder, relative to it; none where that is a file or nothing."""
    store, path = opened(uri)
    if store.get_file_info(path).type == fs.FileType.File:
        return []
    found = store.get_file_info(fs.FileSelector(f"{path}/{below}".rstrip("/"), allow_not_found=True, recursive=True))
    return sorted(f.path.removeprefix(path).lstrip("/") for f in found if f.is_file)


def read_bytes(uri: str) -> bytes:
    store, path = opened(uri)
    with store.open_input_stream(path) as f:
        return f.read()


def write_bytes(uri: str, data: bytes) -> None:
    """Write under another name and move, so a reader sees the old or the new file."""
    store, path = opened(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    fresh = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(fresh) as f:
        f.write(data)
    store.move(fresh, path)


def read_manifest(uri: str) -> dict | None:
    store, path = opened(uri)
    if store.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    return json.loads(read_bytes(f"{uri}/{MANIFEST}"))


def write_manifest(uri: str, manifest: dict) -> None:
    write_bytes(f"{uri}/{MANIFEST}", json.dumps(manifest).encode())


def discard(uri: str, files: list[str]) -> None:
    """Remove files of a folder; those that are gone already don't matter."""
    store, path = opened(uri)
    for name in files:
        try:
            store.delete_file(f"{path}/{name}")
        except FileNotFoundError:
            pass
