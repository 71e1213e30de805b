"""WARC archives with a two-level capture index.

``write`` puts one record per page into gzip-member-per-record archives in the
shared folder, payloads equal to an earlier-chosen response as revisits. The
index holds one line per record, sorted by the URL key with reversed host, in
compressed blocks of a few thousand lines; a sparse directory keeps the first
key and the place of each block. A search by key compares with the directory,
then binary-searches the lines of the blocks that can hold the key, then reads
only the records' byte ranges. ``read`` does so for a key range (all keys by
default), ``lookup`` for a table of URLs.

Tasks write files under fresh names and report them in the manifest that Spark
commits, so what lost or repeated tasks leave is never read.

Defined cases: a null payload is empty, a null URL is the empty key, control
characters and spaces of a URL are percent-encoded; rows that repeat a page id
and payload of the response are responses too; an empty table gives no records;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from hashlib import sha1
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.files import new_name, open_store, read_ranges
from tabulon.llm.shared import reachable, stored
from tabulon.session import work_dir

#: Lines of an index block, bytes after which a task starts the next archive, records that one task reads.
BLOCK_LINES, ARCHIVE_BYTES, READ_LINES = 3000, 256_000_000, 50_000
_DATE = "2024-01-01T00:00:00Z"  # pages carry no capture time
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    """folder: URI of the archives and index files; directory(first_key, last_key, file, offset, length, lines)."""

    spark: SparkSession
    folder: str
    directory: DataFrame


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://www.Example.org:80/a?b -> org,example)/a?b."""
    url = (url or "").strip()
    try:
        part = urlsplit(url if "://" in url else f"http://{url}")
        host, port = (part.hostname or "").removeprefix("www."), part.port
    except ValueError:
        return quote(url.lower(), safe="%/:?=&;,@")
    at = f":{port}" if port and port != {"http": 80, "https": 443}.get(part.scheme) else ""
    tail = (part.path or "/") + (f"?{part.query}" if part.query else "")
    return quote(",".join(reversed(host.split("."))) + at + ")" + tail, safe="%/:?=&;,@)(!$'*+~#")


def _record(page_id, url, html, refers_to) -> bytes:
    payload = (html or "").encode()
    digest = base64.b32encode(sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {_DATE}", f"WARC-Target-URI: {quote(url or '', safe=chr(37) + '/:?=&;,@#!$()*+~[]' + chr(39))}",
            f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(member: bytes) -> dict:
    """Headers of a gzip member's record, and its payload (of a response)."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    return {"version": lines[0], "fields": fields, "payload_bytes": size, "payload": payload}


def _page(uri: str | None):
    number = (uri or "")[len("<urn:page:"):-1]
    return int(number) if number else None


_LINE = "key string, page_id long, file string, offset long, length long"


def _write(folder):
    def go(batches):
        part = TaskContext.get().partitionId()
        name, stream, offset, lines = None, None, 0, []
        for b in batches:
            for page, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if stream is None:
                    name = new_name(f"pages-{part:06d}", ".warc.gz")
                    store, path = open_store(folder)
                    store.create_dir(path, recursive=True)
                    stream = store.open_output_stream(f"{path}/{name}", compression=None)
                member = gzip.compress(_record(page, url, html, refers), 4, mtime=0)
                stream.write(member)
                lines.append((url_key(url), page, name, offset, len(member)))
                offset += len(member)
                if offset >= ARCHIVE_BYTES:
                    stream.close()
                    yield _lines(lines)
                    stream, offset, lines = None, 0, []
        if stream is not None:
            stream.close()
            yield _lines(lines)
    return go


def _lines(lines):
    key, page, file, offset, length = zip(*lines, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(page, pa.int64()), pa.array(file), pa.array(offset, pa.int64()),
                                       pa.array(length, pa.int64())], ["key", "page_id", "file", "offset", "length"])


_BLOCK = "first_key string, last_key string, file string, offset long, length long, lines long"


def _write_index(folder, block_lines):
    """Compressed blocks of sorted lines, one index file per task, and their directory rows."""
    def go(batches):
        name, offset, held, out = new_name(f"index-{TaskContext.get().partitionId():06d}", ".cdx.gz"), 0, [], []
        store, path = open_store(folder)
        stream = None

        def flush():
            nonlocal offset, stream
            if stream is None:
                store.create_dir(path, recursive=True)
                stream = store.open_output_stream(f"{path}/{name}", compression=None)
            block = gzip.compress("".join(f"{k} {f} {o} {n}\n" for k, f, o, n in held).encode(), 6, mtime=0)
            stream.write(block)
            out.append((held[0][0], held[-1][0], name, offset, len(block), len(held)))
            offset += len(block)
            held.clear()
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                held.append(row)
                if len(held) >= block_lines:
                    flush()
        if held:
            flush()
        if stream is not None:
            stream.close()
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["first_key", "last_key", "file", "offset", "length", "lines"])
    return go


def _block_lines(member: bytes):
    lines = gzip.decompress(member).decode().split("\n")[:-1]
    return [x.split(" ") for x in lines]


def _open_blocks(folder, first, last):
    """Lines with first <= key <= last of directory rows: a binary search in each block."""
    def go(batches):
        for b in batches:
            for name, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                rows = _block_lines(bytes(next(read_ranges(folder, name, [(offset, length)]))))
                keys = np.array([r[0] for r in rows], object)
                lo = 0 if first is None else int(np.searchsorted(keys, first, side="left"))
                hi = len(rows) if last is None else int(np.searchsorted(keys, last, side="right"))
                if lo < hi:
                    k, f, o, n = zip(*rows[lo:hi], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f), pa.array(list(map(int, o)), pa.int64()),
                                                      pa.array(list(map(int, n)), pa.int64())], ["key", "file", "offset", "length"])
    return go


_FOUND = "key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _records(folder, payloads: bool):
    """Records at the lines' places, read by range file by file."""
    def go(batches):
        for b in (x.slice(k, 1000) for x in batches for k in range(0, x.num_rows, 1000)):
            rows = sorted(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length", "key")), strict=True))
            out, k = [], 0
            while k < len(rows):
                j = k
                while j < len(rows) and rows[j][0] == rows[k][0]:
                    j += 1
                for r, member in zip(rows[k:j], read_ranges(folder, rows[k][0], [x[1:3] for x in rows[k:j]]), strict=True):
                    rec = parse_record(bytes(member))
                    f = rec["fields"]
                    out.append((r[3], _page(f["WARC-Record-ID"]), rec["payload_bytes"], f["WARC-Payload-Digest"].removeprefix("sha1:"),
                                f["WARC-Type"], _page(f.get("WARC-Refers-To")), rec["payload"] if payloads else None))
                k = j
            key, page, size, digest, kind, refers, payload = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(digest), pa.array(kind),
                 pa.array(refers, pa.int64()), pa.array(payload, pa.binary())],
                ["key", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    return go


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
          block_lines: int = BLOCK_LINES) -> Archive:
    """Write the pages as WARC records with their index. Equal payloads of ``min_bytes`` or more are stored once."""
    spark = pages.sparkSession
    reachable(spark)
    folder = work_dir(spark, "warc")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                          F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    # payloads are equal if their SHA-256 is; records carry the SHA-1, for which collisions are known
    marked = source.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).withColumn("size", F.octet_length("html"))
    narrow = stored(marked.where(F.col("size") >= min_bytes).select("page_id", "digest", "size"), "payloads")
    first = stored(narrow.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "shared-payloads")
    again = stored(narrow.join(first, ["digest", "size"]).where("refers_to != page_id or page_id is null and refers_to is not null")
                   .select("page_id", "digest", "refers_to").distinct(), "revisits")
    if again.isEmpty():
        records = source.withColumn("refers_to", F.lit(None).cast("long"))
    else:
        m, a = marked.alias("m"), again.alias("a")
        records = (m.join(a, F.expr("m.page_id <=> a.page_id and m.digest = a.digest"), "left")
                   .select("m.page_id", "m.url", "m.html", "a.refers_to"))
    lines = stored(records.select("page_id", "url", "html", "refers_to").mapInArrow(_write(folder), _LINE), "captures")
    parts = max(1, lines.count() // (block_lines * 8) + 1)
    ordered = lines.repartitionByRange(parts, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return Archive(spark, folder, stored(ordered.mapInArrow(_write_index(folder, block_lines), _BLOCK), "directory"))


def read(archive: Archive, first: str | None = None, last: str | None = None, payloads: bool = False) -> DataFrame:
    """Records with first <= URL key <= last: directory rows that can hold such keys, their blocks, then byte ranges."""
    rows = archive.directory
    if first is not None:
        rows = rows.where(F.col("last_key") >= first)
    if last is not None:
        rows = rows.where(F.col("first_key") <= last)
    n = archive.spark.sparkContext.defaultParallelism
    lines = rows.repartition(n, "file", "offset").mapInArrow(_open_blocks(archive.folder, first, last), "key string, file string, offset long, length long")
    lines = stored(lines, "lines")
    parts = max(n, lines.count() // READ_LINES + 1)
    placed = lines.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(_records(archive.folder, payloads), _FOUND)


def _meet(before):
    """(key, file, offset, length) of the blocks that can hold each asked key. Block starts (kind 0) and asked keys (kind 1) come
    sorted by range and key; ``before`` has for each range the last block that starts in an earlier one."""
    def go(batches):
        now, last, at, at_key = None, None, [], None
        for b in batches:
            out = []
            for key, kind, last_key, file, offset, length, part in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True):
                if part != now:
                    now, last, at, at_key = part, before.value.get(part), [], None
                if kind == 0:
                    if at and at_key != key:
                        last = at[-1]
                        at = []
                    at.append((last_key, file, offset, length))
                    at_key = key
                    continue
                if at and at_key != key:
                    last, at = at[-1], []
                out += [(key, *x[1:]) for x in ([last] if last is not None and last[0] >= key else []) + at]
            if out:
                key, file, offset, length = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key), "file": pa.array(file), "offset": pa.array(offset, pa.int64()), "length": pa.array(length, pa.int64())})
    return go


def _search_blocks(folder):
    """Lines of the asked keys: keys come sorted by block, which is opened once, and each is searched by bisection."""
    def go(batches):
        opened, lines, own = None, [], None
        for b in batches:
            out = []
            for key, file, offset, length in zip(*(b.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                if opened != (file, offset):
                    lines = _block_lines(bytes(next(read_ranges(folder, file, [(offset, length)]))))
                    opened, own = (file, offset), [x[0] for x in lines]
                out += [(k, f, int(o), int(n)) for k, f, o, n in lines[bisect_left(own, key):bisect_right(own, key)]]
            if out:
                key, file, offset, length = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key), "file": pa.array(file), "offset": pa.array(offset, pa.int64()), "length": pa.array(length, pa.int64())})
    return go


def lookup(archive: Archive, urls: DataFrame, url_col: str, payloads: bool = False) -> DataFrame:
    """Records of the given URLs.

    Their keys and the directory's block starts are dealt together by ranges of keys and walked in order, so each key meets the
    blocks that can hold it without a nested loop; of other ranges it needs the last block before its own, one row a range.
    Blocks are then opened once each, searched by bisection, and only the records' byte ranges are read.
    """
    spark = archive.spark
    n = spark.sparkContext.defaultParallelism
    keyed = stored(urls.select(F.col(url_col).cast("string").alias("url")).distinct().mapInArrow(_keys, "key string").distinct(), "keys")
    blocks = archive.directory.select(F.col("first_key").alias("key"), F.lit(0).alias("kind"), "last_key", "file", "offset", "length")
    asked = keyed.select("key", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("last_key"), F.lit(None).cast("string").alias("file"),
                         F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"))
    parts = max(n, (keyed.count() + blocks.count()) // READ_LINES + 1)
    both = stored(blocks.unionByName(asked).repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "asked")
    order = F.struct("key", "last_key", "file", "offset")
    lasts = {r.part: tuple(r.x) for r in both.where("kind = 0").groupBy("part").agg(F.max_by(F.struct("last_key", "file", "offset", "length"), order).alias("x")).collect()}
    before, held = {}, None
    for part in range(parts):
        if held is not None:
            before[part] = held
        held = lasts.get(part, held)
    spread = both.repartition(parts, "part").sortWithinPartitions("part", "key", "kind", "last_key", "file", "offset")
    found = spread.mapInArrow(_meet(spark.sparkContext.broadcast(before)), "key string, file string, offset long, length long")
    opened = found.repartition(parts, "file", "offset").sortWithinPartitions("file", "offset", "key")
    lines = stored(opened.mapInArrow(_search_blocks(archive.folder), "key string, file string, offset long, length long"), "lines")
    count = max(n, lines.count() // READ_LINES + 1)
    placed = lines.repartitionByRange(count, "file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(_records(archive.folder, payloads), _FOUND)


def _keys(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column("url").to_pylist()], pa.string())], ["key"])
