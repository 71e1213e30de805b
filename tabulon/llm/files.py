"""Files in the shared folder, opened inside tasks by URI: whole writes and ranged reads."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_store(uri: str):
    """(file system, path) of a shared folder's URI; file, s3, gs, hdfs and plain absolute paths."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def new_name(stem: str, suffix: str) -> str:
    """A name no other attempt uses: a lost or repeated task leaves files that no manifest row names."""
    return f"{stem}-{uuid.uuid4().hex}{suffix}"


def write_bytes(uri: str, name: str, parts) -> None:
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        for p in parts:
            out.write(p)


def read_ranges(uri: str, name: str, ranges, gap: int = 65_536):
    """Yield the bytes of each (offset, length), in the given order of offsets; near ranges are read at once."""
    store, path = open_store(uri)
    with store.open_input_file(f"{path}/{name}") as f:
        ranges, k = list(ranges), 0
        while k < len(ranges):
            start, end, j = ranges[k][0], ranges[k][0] + ranges[k][1], k + 1
            while j < len(ranges) and ranges[j][0] - end <= gap and ranges[j][0] + ranges[j][1] - start <= 8_000_000:
                end, j = max(end, ranges[j][0] + ranges[j][1]), j + 1
            block = f.read_at(end - start, start)
            for o, n in ranges[k:j]:
                yield block[o - start:o - start + n]
            k = j
