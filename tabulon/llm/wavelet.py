"""Token shards as wavelet matrices: one compressed file answers access, counting and occurrence lookup.

A shard's tokens are stored bit plane by bit plane, the highest first; every
plane lists one bit of each token in the order that the planes above leave
(zeros first, stable). Planes are cut into frames of 2**18 bits that are
compressed one by one, with the ones before each frame, so that a query opens
the frames it needs only. Access, rank (count in a prefix) and select
(position of the k-th occurrence) take one step per plane.

``write`` sorts documents by id, cuts them into shards and returns the manifest
of files; ``read`` decodes every document from the files. Files get fresh names
and are named by the committed manifest only.

Defined cases: null text is an empty document (its end id only); repeated ids
come next to each other; an empty table has no shards; extra columns are
ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from tabulon.llm.files import new_name, open_store, write_bytes
from tabulon.llm.shared import stored, with_text
from tabulon.llm.tokens import encoded
from tabulon.session import work_dir

MAGIC = b"WAVM0001"
#: Tokens after which a task starts the next shard, and bits of a compressed frame.
SHARD_TOKENS, FRAME_BITS = 4_000_000, 1 << 18
#: Words that a worker remembers: words seen once are most of those kept beyond, and cost more memory than they save time.
REMEMBERED = 300_000


def build(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a shard file: magic, header length, header, document table, frames."""
    n = len(ids)
    planes = max(1, int(ids.max()).bit_length() if n else 1)
    pack, frames, places, zeros, ones = ZstdCompressor(level=1).compress, [], [], [], []
    x = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    table = pack(np.stack([doc_ids.astype("<i8"), sizes.astype("<i8")]).tobytes())
    at = len(table)
    for b in range(planes - 1, -1, -1):
        one = (x & x.dtype.type(1 << b)).astype(bool)
        raw = np.packbits(one, bitorder="little")
        place = []
        for k in range(0, len(raw), FRAME_BITS // 8):
            frame = pack(raw[k:k + FRAME_BITS // 8].tobytes())
            frames.append(frame)
            place.append((at, len(frame)))
            at += len(frame)
        places.append(place)
        full = np.add.reduceat(np.bitwise_count(raw), np.arange(0, len(raw), FRAME_BITS // 8), dtype=np.int64) if n else np.zeros(0, np.int64)
        ones.append((np.cumsum(full) - full).tolist())
        high = x[one]
        zeros.append(n - len(high))
        x = np.concatenate([x[~one], high])
    head = json.dumps({"n": n, "docs": len(sizes), "planes": planes, "frame": FRAME_BITS, "table": len(table), "zeros": zeros,
                       "ones": ones, "places": places}).encode()
    return [MAGIC, len(head).to_bytes(8, "little"), head, table, *frames]


class Shard:
    """A shard file. ``read_at(offset, length)`` gives its bytes; frames are opened when a query needs them."""

    def __init__(self, read_at, kept: int = 64):
        assert read_at(0, 8) == MAGIC, "not a token shard"
        size = int.from_bytes(read_at(8, 8), "little")
        h = json.loads(read_at(16, size))
        self._read, self._base, self._kept, self._frames = read_at, 16 + size, kept, {}
        self.n, self.docs, self.planes, self._bits = h["n"], h["docs"], h["planes"], h["frame"]
        self._zeros, self._ones, self._places = h["zeros"], h["ones"], h["places"]
        self._opened = ZstdDecompressor()
        self.doc_ids, self.sizes = np.frombuffer(self._opened.decompress(read_at(self._base, h["table"])), "<i8").reshape(2, -1)

    def _frame(self, plane, k):
        if (plane, k) not in self._frames:
            if len(self._frames) >= self._kept:
                self._frames.pop(next(iter(self._frames)))
            at, size = self._places[plane][k]
            bits = np.unpackbits(np.frombuffer(self._opened.decompress(self._read(self._base + at, size)), np.uint8), bitorder="little")
            self._frames[plane, k] = bits
        return self._frames[plane, k]

    def _rank1(self, plane, i):
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self._zeros[plane]
        k = i // self._bits
        return self._ones[plane][k] + int(self._frame(plane, k)[:i % self._bits].sum())

    def _select(self, plane, bit, k):
        """Position of the k-th (from 0) bit of that value in a plane."""
        before = [o if bit else f * self._bits - o for f, o in enumerate(self._ones[plane])]
        f = int(np.searchsorted(before, k, side="right")) - 1
        return f * self._bits + int(np.flatnonzero(self._frame(plane, f)[:self.n - f * self._bits] == bit)[k - before[f]])

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.planes):
            bit = int(self._frame(p, i // self._bits)[i % self._bits])
            one = self._rank1(p, i)
            i = self._zeros[p] + one if bit else i - one
            out = out << 1 | bit
        return out

    def _range(self, token, end):
        lo, hi = 0, end
        for p in range(self.planes):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            lo, hi = (self._zeros[p] + a, self._zeros[p] + b) if token >> (self.planes - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token among the first ``end`` tokens (all by default)."""
        if token >> self.planes:
            return 0
        lo, hi = self._range(token, self.n if end is None else min(end, self.n))
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            i = self._select(p, bit, i - self._zeros[p] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens in order, plane by plane from the lowest."""
        x = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            raw = b"".join(self._opened.decompress(self._read(self._base + at, size)) for at, size in self._places[p])
            one = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            y = np.empty_like(x)
            y[~one] = x[:self._zeros[p]]
            y[one] = x[self._zeros[p]:] | x.dtype.type(1 << (self.planes - 1 - p))
            x = y
        return x


def open_shard(folder: str, name: str) -> Shard:
    store, path = open_store(folder)
    f = store.open_input_file(f"{path}/{name}")
    return Shard(lambda offset, length: f.read_at(length, offset))


_FILE = "file string, first_id long, last_id long, shard_docs long, shard_tokens long, part int, place int"


def _write(folder, path, spaced, end, limit):
    def go(batches):
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        docs, sizes, ids, held = [], [], [], 0

        def close():
            name = new_name(f"tokens-{part:06d}-{place:04d}", ".wavm")
            d, s, x = (np.concatenate(v) for v in (docs, sizes, ids))
            write_bytes(folder, name, build(d, s, x))
            return pa.RecordBatch.from_pydict({
                "file": pa.array([name]), "first_id": pa.array([int(d[0])], pa.int64()), "last_id": pa.array([int(d[-1])], pa.int64()),
                "shard_docs": pa.array([len(d)], pa.int64()), "shard_tokens": pa.array([len(x)], pa.int64()),
                "part": pa.array([part], pa.int32()), "place": pa.array([place], pa.int32())})
        for b, n, x in encoded(batches, path, spaced, end, remembered=REMEMBERED):
            docs.append(b.column("doc_id").to_numpy(zero_copy_only=False))
            sizes.append(n)
            ids.append(x)
            held += len(x)
            if held >= limit:
                yield close()
                docs, sizes, ids, held, place = [], [], [], 0, place + 1
        if docs:
            yield close()
    return go


def write(docs: DataFrame, tokenizer: str, spaced: bool = False, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
          shard_tokens: int = SHARD_TOKENS) -> tuple[str, DataFrame]:
    """(folder, manifest) of the documents' ids in ascending order of doc_id; a null doc_id is -2**63."""
    spark = docs.sparkSession
    folder = work_dir(spark, "tokens")
    source = with_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(-2**63).cast("long")))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = source.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return folder, stored(ordered.mapInArrow(_write(folder, tokenizer, spaced, end_id, shard_tokens), _FILE), "shards")



def _read(folder, with_ids):
    def go(batches):
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                shard = open_shard(folder, name)
                ids, ends = shard.tokens().astype("<u4"), np.cumsum(shard.sizes)
                crc = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends, shard.sizes, strict=True)]
                cols = {"doc_id": pa.array(shard.doc_ids, pa.int64()), "start": pa.array(base + ends - shard.sizes, pa.int64()),
                        "n_tokens": pa.array(shard.sizes, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array(np.split(ids.astype(np.int64), ends[:-1]), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(cols)
    return go


def read(folder: str, shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the files.

    ``start`` counts the ids of all documents before; only the manifest (a row
    per shard of millions of tokens) is summed in order.
    """
    order = Window.orderBy("part", "place")
    based = stored(shards.select("file", (F.sum("shard_tokens").over(order) - F.col("shard_tokens")).alias("base")), "shard-bases")
    spread = based.repartition(max(1, shards.sparkSession.sparkContext.defaultParallelism), "file")
    return spread.mapInArrow(_read(folder, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
