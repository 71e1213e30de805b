"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. Output is filled window by
window; each window takes from every queue its share of the window's tokens,
and what rounding withholds is a deficit that the next window pays, so the
tokens taken from a queue after w windows are its share of all tokens so far,
within one token, whatever task works on them. Shares are the queues' own
sizes (all end together) or target proportions; with targets, a queue that is
empty leaves the round and the others share its part. Since that sum has a closed form, a
document needs to know only how many tokens of its queue come before it:
partial sums by input partition and source give that, and every task cuts its
own documents without moving their tokens. Windows are whole sequences, so
only the last sequence is padded. Sources of any number are packed: those whose
share of a window is below one token cannot be in every window and make one
queue together, one after another.

Defined cases: null text is an empty document (its end id only), a null source
is the source ''; a queue's documents come in the order of the input's
partitions; repeated rows are separate documents; an empty table gives no
pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.shared import arrow_batches, give_back, stored, with_text
from tabulon.llm.tokens import WORDS, encoded

SEQUENCE, WINDOW_SEQUENCES = 1024, 64
#: Queues of which a task sums up the sizes.
QUEUES_PER_TASK = 10_000
#: Bytes of rows that a Python worker gets at once.
BATCH = "8m"


def places(q: int, count: int, lo: int, hi: int, total: int, size: int, window: int):
    """Yield (number of tokens, output position) of tokens q..q + count of a queue that has the part lo..hi of ``total`` in every
    window; ``size`` tokens go out in all."""
    upto = lambda w: min(w * window, size)
    taken = lambda w: upto(w) * hi // total - upto(w) * lo // total
    end = q + count
    while q < end:
        w = q * total // ((hi - lo) * window)
        while taken(w + 1) <= q:
            w += 1
        while w and taken(w) > q:
            w -= 1
        n = min(taken(w + 1) - q, end - q)
        yield n, upto(w) + (upto(w + 1) * lo // total - upto(w) * lo // total) + q - taken(w)
        q += n


class Plan:
    """Where token p of queue s goes if queues have target proportions. Phases hold the queues that are not empty yet."""

    def __init__(self, totals: dict[str, int], targets: dict[str, float], window: int):
        self.window, self.phases, self.length = window, [], 0
        left = {s: n for s, n in sorted(totals.items()) if n}
        taken = dict.fromkeys(left, 0)
        share = {s: max(1, round(targets.get(s, 0) * 10**9)) for s in left}
        least = 2 * sum(share.values()) // window + 1  # a token of every window at least
        share = {s: max(n, least) for s, n in share.items()}
        self.where: dict[str, tuple[list, list]] = {s: ([], []) for s in left}
        while left:
            names = list(left)
            cum = [0]
            for s in names:
                cum.append(cum[-1] + share[s])
            total = cum[-1]
            size = min((left[s] - 1) * total // share[s] for s in names)
            if size < window:  # a queue is all but empty: the rest of it goes out at once
                s = min(names, key=lambda x: left[x] * total // share[x])
                names, cum, total, size = [s], [0, 1], 1, left[s]
            at = len(self.phases)
            self.phases.append((self.length, size, total))
            self.length += size
            for k, s in enumerate(names):
                n = size * cum[k + 1] // total - size * cum[k] // total
                self.where[s][0].append(taken[s])
                self.where[s][1].append((at, cum[k], cum[k + 1]))
                taken[s] += n
                left[s] -= n
                if not left[s]:
                    del left[s]

    def pieces(self, queue: str, start: int, count: int):
        """Yield (start in the document, length, output position) of tokens start..start+count of a queue."""
        begins, phases = self.where[queue]
        p, end = start, start + count
        while p < end:
            k = bisect_right(begins, p) - 1
            at, lo, hi = phases[k]
            base, size, total = self.phases[at]
            upto = begins[k + 1] if k + 1 < len(begins) else end
            for n, place in places(p - begins[k], min(end, upto) - p, lo, hi, total, size, self.window):
                yield p - start, n, base + place
                p += n


def _shares(sums: DataFrame, window: int) -> tuple[DataFrame, int]:
    """(queue, lo, hi, shift) of every queue, and the number of all tokens.

    lo..hi is the queue's part of all tokens, queues one after another by name. Those whose share of a window is below one token
    come last and are one queue together, in which the tokens of each begin at ``shift``; so at most ``window`` queues have a
    part of their own, and what a window takes from any is never negative. A running sum over ranges of queues: within a range
    by a window function, before it by the ranges' own sums, of which there is one for QUEUES_PER_TASK queues.
    """
    sizes = stored(sums.groupBy("queue").agg(F.sum("n").alias("n")), "queues")
    count, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    marked = sizes.withColumn("small", F.col("n").cast("decimal(38,0)") * window < total)
    ranged = marked.repartitionByRange(count // QUEUES_PER_TASK + 1, "small", "queue").withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "queue-ranges")
    before = ranged.groupBy("range").agg(F.sum("n").alias("own"))
    before = before.select("range", (F.sum("own").over(Window.orderBy("range")) - F.col("own")).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("range").orderBy("small", "queue"))
    whole = ranged.where("not small").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = ranged.withColumn("upto", upto).join(before, "range").withColumn("hi", F.col("before") + F.col("upto"))
    small = lambda a, b: F.when(F.col("small"), a).otherwise(b)
    begin = F.col("hi") - F.col("n")
    return placed.select("queue", small(F.lit(whole), begin).cast("long").alias("lo"), small(F.lit(total), F.col("hi")).cast("long").alias("hi"),
                         small(begin - whole, F.lit(0)).cast("long").alias("shift")), total


_TOKENS = "doc_id long, queue string, n long, part int, before long, ids binary"


def _tokenize(path, spaced, end, remembered):
    def go(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for b, sizes, ids in encoded(batches, path, spaced, end, remembered=remembered):
            queues, before, ends = b.column("queue").to_pylist(), [], np.cumsum(sizes)
            for q, n in zip(queues, sizes.tolist(), strict=True):
                before.append(seen.get(q, 0))
                seen[q] = before[-1] + n
            kind = "<u2" if len(ids) == 0 or ids.max() < 65536 else "<u4"
            raw = [ids[e - n:e].astype(kind).tobytes() for e, n in zip(ends, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(queues, pa.string()), pa.array(sizes, pa.int64()),
                 pa.array([part] * len(raw), pa.int32()), pa.array(before, pa.int64()), pa.array(raw, pa.binary())],
                ["doc_id", "queue", "n", "part", "before", "ids"])
        give_back(collect=False)
    return go


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(plan, total, window, sequence, with_ids):
    """Pieces of the documents, by the plan or, without one, by the parts lo..hi of their queues."""
    def go(batches):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            out, pieces = [], []
            for doc, queue, n, first, raw, lo, hi in zip(*(b.column(c).to_pylist() for c in ("doc_id", "queue", "n", "first", "ids", "lo", "hi")), strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                if plan is None:
                    runs, start = places(first, n, lo, hi, total, total, window), 0
                else:
                    runs, start = ((length, place) for _, length, place in plan.value.pieces(queue, first, n)), 0
                for length, place in runs:
                    while length:
                        k = min(length, sequence - place % sequence)
                        own = ids[start:start + k].tobytes()
                        out.append((doc, start, k, zlib.crc32(own), n, place // sequence, place % sequence))
                        if with_ids:
                            pieces.append(ids[start:start + k])
                        start, length, place = start + k, length - k, place + k
            cols = list(zip(*out, strict=True)) or [[]] * 7
            arrays = [pa.array(c, pa.int64()) for c in cols]
            if with_ids:
                arrays.append(pa.array(pieces, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, [*names, "ids"] if with_ids else names)
    return go


def pack(docs: DataFrame, tokenizer: str, spaced: bool = True, end_id: int = 0, sequence: int = SEQUENCE,
         window_sequences: int = WINDOW_SEQUENCES, targets: dict[str, float] | None = None, with_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", remembered: int = WORDS) -> DataFrame:
    """Pieces of all documents in sequences of ``sequence`` tokens, sources mixed in proportion in every window.

    A worker remembers the ids of about ``remembered`` words: fewer take less memory and more time, results are the same.
    """
    spark = docs.sparkSession
    queue, window = F.coalesce(F.col("queue").cast("string"), F.lit("")), window_sequences * sequence
    if targets is not None:
        queue = F.when(queue.isin(*targets), queue).otherwise(F.lit("\0rest"))
    source = with_text(docs.withColumn("queue", F.col(source_col)) if source_col != "queue" else docs, id_col, text_col, "queue")
    with arrow_batches(spark, BATCH):
        tokens = stored(source.withColumn("queue", queue).mapInArrow(_tokenize(tokenizer, spaced, end_id, remembered), _TOKENS), "tokens")
    sums = stored(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "queue-parts")
    base = sums.select("queue", "part", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("base"))
    if targets is None:
        plan, (shares, total) = None, _shares(sums, window)
        base = base.join(shares, "queue").withColumn("base", F.col("base") + F.col("shift"))
    else:  # at most one queue more than targets
        totals = sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()
        plan, total = spark.sparkContext.broadcast(Plan({r.queue: r.n for r in totals}, targets, window)), 0
        base = base.withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(0).cast("long")})
    placed = tokens.join(stored(base, "queue-bases"), ["queue", "part"]).withColumn("first", F.col("base") + F.col("before"))
    return placed.select("doc_id", "queue", "n", "first", "ids", "lo", "hi").mapInArrow(
        _cut(plan, total, window, sequence, with_ids), _PIECE + (", ids array<long>" if with_ids else ""))
