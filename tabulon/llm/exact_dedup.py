"""Exact dedup by content-defined chunk recipes.

A gear hash of the last 16 bytes cuts every text into chunks, so equal texts
have equal chunks wherever they stand. Each chunk gets an identifier: its
128-bit fingerprint, verified by comparing the bytes of all chunks with that
fingerprint (each distinct chunk moves once per task, then duplicates fall
together), plus an ordinal where different bytes share a fingerprint. A
document's recipe is the ordered list of its verified identifiers; equal
recipes are equal texts, and no document text takes part in the grouping.

Defined cases: null text counts as empty and empty texts are equal; of equal
texts the row with the largest doc_id stays, and of rows that repeat that id
too, one; a null doc_id is smaller than any other; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from tabulon.llm.shared import lean, runs, stored, text_buffers, with_text

#: Chunks hold 1024 bytes on average (a cut where ten bits of the gear hash are zero), 16 KB at most.
CUT_MASK, MAX_CHUNK, WINDOW = np.uint64(0x3FF << 20), 16_384, 16
#: Bytes of sent chunks that a task keeps to compare with; beyond it, it forgets and a chunk may move again.
REMEMBERED_BYTES = 24_000_000

_GEAR = np.random.default_rng(20240502).integers(0, 2**64, 256, dtype=np.uint64)


def chunk_ends(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """End positions of all chunks of the documents, in order; every document end is one."""
    g = _GEAR[raw]
    for k in (1, 2, 4, 8):
        tail = g[:-k] << np.uint64(k)
        g[k:] += tail
    cuts = np.flatnonzero((g & CUT_MASK) == 0) + 1
    starts = offsets[np.searchsorted(offsets, cuts, side="left") - 1] if len(cuts) else cuts
    cuts = cuts[cuts - starts >= WINDOW]
    ends = np.union1d(cuts, offsets[1:])
    gaps = np.diff(np.r_[offsets[0], ends])
    long = np.flatnonzero(gaps > MAX_CHUNK)
    if len(long):
        ends = np.union1d(ends, np.concatenate([np.arange(ends[k] - gaps[k] + MAX_CHUNK, ends[k], MAX_CHUNK) for k in long]))
    return ends[ends > offsets[0]]


def chunks_of(offsets, raw):
    """Yield (document index, [chunk bytes]) of every document."""
    for i, j in runs(offsets):
        part = raw[offsets[i]:offsets[j]]
        own = offsets[i:j + 1] - offsets[i]
        ends = chunk_ends(own, part) if len(part) else np.zeros(0, np.int64)
        data, at, k = part.tobytes(), 0, 0
        for d in range(j - i):
            pieces = []
            while k < len(ends) and ends[k] <= own[d + 1]:
                pieces.append(data[at:ends[k]])
                at, k = int(ends[k]), k + 1
            yield i + d, pieces


def _recipes(fingerprint):
    def go(batches):
        for b in batches:
            offsets, raw = text_buffers(b.column("text"))
            ids, sums = [], []
            for _, pieces in chunks_of(offsets, raw):
                whole = sha256()
                for p in pieces:
                    whole.update(p)
                ids.append(b"".join(map(fingerprint, pieces)))
                sums.append(whole.hexdigest())
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id").cast(pa.int64()), "recipe": pa.array(ids, pa.binary()),
                "text_sha256": pa.array(sums, pa.string())})
    return go


def _chunks(fingerprint):
    def go(batches):
        sent: dict = {}
        held = 0
        for b in batches:
            offsets, raw = text_buffers(b.column("text"))
            marks, parts, size = [], [], 0
            for _, pieces in chunks_of(offsets, raw):
                for p in pieces:
                    f = fingerprint(p)
                    if sent.get(f) != p:
                        if held > REMEMBERED_BYTES:
                            sent.clear()
                            held = 0
                        held += len(p)
                        sent[f] = p
                        marks.append(f)
                        parts.append(p)
                        size += len(p)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pydict({"mark": pa.array(marks, pa.binary()), "chunk": pa.array(parts, pa.binary())})
                    marks, parts, size = [], [], 0
            if marks:
                yield pa.RecordBatch.from_pydict({"mark": pa.array(marks, pa.binary()), "chunk": pa.array(parts, pa.binary())})
    return go


def _occurrences(fingerprint):
    def go(batches):
        for b in batches:
            offsets, raw = text_buffers(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            for d, pieces in chunks_of(offsets, raw):
                n, whole = len(pieces), sha256(b"".join(pieces)).hexdigest()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([ids[d]] * n, pa.int64()), "text_sha256": pa.array([whole] * n, pa.string()),
                    "seq": pa.array(range(n), pa.int32()), "mark": pa.array([fingerprint(p) for p in pieces], pa.binary()),
                    "chunk": pa.array(pieces, pa.binary())})
    return go


def _with_ordinals(source, recipes, shared, fingerprint) -> DataFrame:
    """Recipes with, for documents that hold a fingerprint of several chunks, the ordinals of those chunks by bytes."""
    found = stored(source.mapInArrow(lean(_occurrences(fingerprint)), "doc_id long, text_sha256 string, seq int, mark binary, chunk binary")
                   .join(shared, "mark", "left_semi"), "shared-chunks")
    ordinal = stored(found.select("mark", "chunk").distinct()
                     .withColumn("ordinal", F.row_number().over(Window.partitionBy("mark").orderBy("chunk"))), "ordinals")
    places = found.join(ordinal, ["mark", "chunk"]).select("doc_id", "text_sha256", "seq", "ordinal").distinct()
    lists = (places.groupBy("doc_id", "text_sha256")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "ordinal"))),
                                           lambda x: F.concat_ws(":", x["seq"], x["ordinal"])), ",").alias("more")))
    both = recipes.alias("r").join(lists.alias("l"), F.expr("r.doc_id <=> l.doc_id and r.text_sha256 = l.text_sha256"), "left")
    return (both.select("r.*", "more").withColumn("ids", F.concat("recipe", F.encode(F.coalesce("more", F.lit("")), "UTF-8"))).drop("more"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 fingerprint: Callable[[bytes], bytes] = xxh3_128_digest) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    source = with_text(docs, id_col, text_col)
    recipes = stored(source.mapInArrow(lean(_recipes(fingerprint)), "doc_id long, recipe binary, text_sha256 string")
                     .withColumn("row", F.monotonically_increasing_id()), "recipes")
    distinct = source.mapInArrow(lean(_chunks(fingerprint)), "mark binary, chunk binary").distinct()
    shared = stored(distinct.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), "shared-marks")
    if shared.isEmpty():
        listed = recipes.withColumn("ids", F.col("recipe"))
    else:
        listed = _with_ordinals(source, recipes, shared, fingerprint)
    groups = stored(listed.groupBy("ids").agg(F.max(F.struct("doc_id", "row")).alias("k"), F.count("*").alias("n"))
                    .where("n > 1"), "copies")
    return listed.join(groups, "ids", "left").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("k.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("k.row") == F.col("row"), F.lit(True)).alias("kept"), "text_sha256")
