"""Substring dedup by sliding sentence spans.

A text is cut into sentences (a word that ends in . ! or ?, closing quotes and
brackets after it allowed, or a paragraph's last one; a single line end is no
cut, as passages are wrapped anew), and these into pieces after the word
of least hash of every nine in a row, so that the same words are cut the same
way wherever they stand: pieces have nine words at most, only the first and the
last nine words of a passage can be cut otherwise elsewhere, and any 50 equal
words hold a whole span (33 between cuts that all
occurrences share; a span has at most 24 + 9). Pieces are the sentences of what
follows. Around every sentence lie two spans: the shortest run of two or more sentences with 25 words
that starts with it, and the shortest that ends with it, so a repeated passage
is covered to both ends. All spans of all documents are hashed and meet by
hash; the occurrence with the smallest (doc_id, position) is the first, and
every sentence that another occurrence covers is removed. Words are compared
with A-Z lower-cased, white space is not compared.

A task sends the first occurrence that it has seen of each span and reports its
other occurrences at once, so a span in very many documents is one row per
task batch in the shuffle. Buckets and partitions of that shuffle go by the
bytes of text, and a task holds one bucket at a time.

Defined cases: null text counts as empty; texts of fewer than 25 words have no
spans and stay as they are; unchanged texts stay byte for byte; rows that
repeat an id and text are one document; a null id stays unchanged; extra columns are
carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.shared import arrow_batches, fresh_name, lean, reachable, runs, stored, text_buffers
from tabulon.llm.shingles import _BASE, _INVERSE, _power, mix64, words

SPAN_WORDS, SPAN_SENTENCES = 25, 2
#: Words of a row of which the one of least hash ends a piece: 3 * WINDOW + SPAN_WORDS - 2 words always hold a span.
WINDOW = 9
#: Closing quotes and brackets that may follow a stop.
CLOSING = 8
#: Bytes of text whose spans make one bucket, and one partition, of the span shuffle; buckets for each partition at least.
BUCKET_BYTES, PART_BYTES, BUCKETS = 4_000_000, 64_000_000, 8
#: Bytes of rows that a Python worker gets at once, and rows whose texts it cuts at once.
BATCH, CUT_ROWS = "8m", 1000
_ROW = np.dtype([("h", "<u8"), ("c", "<u2"), ("doc", "<i8"), ("at", "<u4"), ("n", "<u2")])
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[ord(c) for c in "\"')]}"]] = True


def _stops(raw, s, e):
    """Words that end in . ! or ?, or in one of them before closing quotes and brackets."""
    at = e - 1
    k = np.arange(len(at))
    for _ in range(CLOSING):
        last, one, two = raw[at[k]], raw[np.maximum(at[k] - 1, s[k])], raw[np.maximum(at[k] - 2, s[k])]
        back = np.where(_CLOSE[last], 1, np.where((last == 0xBB) & (one == 0xC2), 2,
                        np.where(((last == 0x99) | (last == 0x9D)) & (one == 0x80) & (two == 0xE2), 3, 0)))
        k, back = k[back > 0], back[back > 0]
        if not len(k):
            break
        at[k] = np.maximum(at[k] - back, s[k])
    return _STOP[raw[at]]


def _least(h, end):
    """The word of least hash of every WINDOW words in a row of one sentence, the first of equal ones."""
    out, m = np.zeros(len(h), bool), len(h) - WINDOW + 1
    if m < 1:
        return out
    v = mix64(h) >> np.uint64(20)
    best, at = v[:m].copy(), np.arange(m)
    for k in range(1, WINDOW):
        less = np.flatnonzero(v[k:k + m] < best)
        best[less], at[less] = v[k:k + m][less], less + k
    sentence = np.cumsum(end) - end
    out[at[sentence[:m] == sentence[WINDOW - 1:]]] = True
    return out


class Spans:
    """Sentences and spans of a run of documents."""

    def __init__(self, offsets: np.ndarray, raw: np.ndarray):
        doc, h, s, e = words(offsets, raw)
        n = len(doc)
        self.empty = n == 0
        if self.empty:
            return
        breaks = np.flatnonzero(raw == 10)
        line = np.searchsorted(breaks, s)
        end = _stops(raw, s, e)
        end[:-1] |= (line[1:] > line[:-1] + 1) | (doc[1:] != doc[:-1])
        end[-1] = True
        end |= _least(h, end)
        self.first = np.flatnonzero(np.r_[True, end[:-1]])
        self.last = np.r_[self.first[1:], n]
        self.doc = doc[self.first]
        self.byte = s[self.first]
        self.sentence0 = np.searchsorted(self.doc, self.doc)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * _power(_BASE, n), out=total[1:])
        self._total, self._inverse = total, _power(_INVERSE, n + 1)
        m = len(self.first)
        i = np.arange(m)
        ahead = np.maximum(np.searchsorted(self.last, self.first + SPAN_WORDS, side="left"), i + SPAN_SENTENCES - 1)
        back = np.minimum(np.searchsorted(self.first, self.last - SPAN_WORDS, side="right") - 1, i - SPAN_SENTENCES + 1)
        a, b = np.r_[i, np.maximum(back, 0)], np.r_[np.minimum(ahead, m - 1), i]
        ok = np.r_[ahead < m, back >= 0]
        ok &= self.doc[a] == self.doc[b]
        both = np.unique(a[ok] * np.int64(m) + b[ok])
        self.a, self.b = both // m, both % m
        self.hash = self.hashes(self.a, self.b)

    def hashes(self, a, b):
        s, e = self.first[a], self.last[b]
        return mix64((self._total[e] - self._total[s]) * self._inverse[s] + (e - s).astype(np.uint64))

    def check(self, a, b):
        """Sixteen bits more for each span, from another mix of the same words."""
        s, e = self.first[a], self.last[b]
        return (mix64((self._total[e] - self._total[s]) * self._inverse[s] ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(48)).astype("<u2")


def _first_and_rest(rows):
    """(first occurrence of each span, the other occurrences)."""
    order = np.lexsort((rows["at"], rows["doc"], rows["c"], rows["h"]))
    rows = rows[order]
    same = np.zeros(len(rows), bool)
    same[1:] = (rows["h"][1:] == rows["h"][:-1]) & (rows["c"][1:] == rows["c"][:-1])
    repeat = np.zeros(len(rows), bool)  # the first occurrence itself, from a repeated row
    if len(rows):
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(rows))))
        repeat = same & (rows["doc"] == rows["doc"][head]) & (rows["at"] == rows["at"][head])
    return rows[~same], rows[same & ~repeat]


def _spans(buckets: int):
    """Spans of the documents: kind 0 first occurrences of a batch packed by bucket, kind 1 others, as blobs."""
    def go(batches):
        rng = np.random.default_rng(11)
        for b in batches:
            offsets, raw = text_buffers(b.column("__text"))
            ids = b.column("__id").to_numpy(zero_copy_only=False)
            parts = []
            for i, j in runs(offsets):
                sp = Spans(offsets[i:j + 1] - offsets[i], raw[offsets[i]:offsets[j]])
                if not sp.empty and len(sp.a):
                    rows = np.empty(len(sp.a), _ROW)
                    rows["h"], rows["c"], rows["doc"] = sp.hash, sp.check(sp.a, sp.b), ids[i + sp.doc[sp.a]]
                    rows["at"], rows["n"] = sp.a - sp.sentence0[sp.a], np.minimum(sp.b - sp.a + 1, 65535)
                    parts.append(rows)
            if not parts:
                continue
            first, rest = _first_and_rest(np.concatenate(parts))
            bucket = (first["h"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            first, bucket = first[order], bucket[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            kind, to, blob = [0] * len(cut), bucket[cut].tolist(), [first[s:e].tobytes() for s, e in zip(cut, np.r_[cut[1:], len(first)], strict=True)]
            for k in range(0, len(rest), 2000):
                kind.append(1)
                to.append(int(rng.integers(0, buckets)))
                blob.append(rest[k:k + 2000].tobytes())
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(to, pa.int64()), "kind": pa.array(kind, pa.int32()), "rows": pa.array(blob, pa.binary())})
    return go


def _report(rows):
    for k in range(0, len(rows), 100_000):
        r = rows[k:k + 100_000]
        yield pa.RecordBatch.from_pydict({"doc": pa.array(r["doc"]), "at": pa.array(r["at"].astype(np.int32)),
                                          "n": pa.array(r["n"].astype(np.int32)), "h": pa.array(r["h"].view(np.int64))})


def _repeats(batches):
    """Occurrences that are not the first of their span. Buckets come one after another, and a task holds the rows of one."""
    held, now = [], None
    for b in batches:
        for bucket, kind, blob in zip(b.column("bucket").to_pylist(), b.column("kind").to_pylist(), b.column("rows"), strict=True):
            rows = np.frombuffer(blob.as_buffer(), _ROW)
            if kind:
                yield from _report(rows)
                continue
            if bucket != now and held:
                yield from _report(_first_and_rest(np.concatenate(held))[1])
                held = []
            held.append(rows.copy())
            now = bucket
    if held:
        yield from _report(_first_and_rest(np.concatenate(held))[1])


def _without(data: bytes, spans) -> tuple[bytes, int]:
    """A text without the sentences that the given (at, n, hash) spans cover, and their number."""
    sp = Spans(np.array([0, len(data)]), np.frombuffer(data, np.uint8))
    if sp.empty:
        return data, 0
    m = len(sp.first)
    at, n, h = (np.array([s[k] for s in spans], np.int64) for k in ("at", "n", "h"))
    ok = at + n <= m
    at, n, h = at[ok], n[ok], h[ok]
    same = sp.hashes(at, at + n - 1).view(np.int64) == h  # else the span belongs to another row with this id
    covered = np.zeros(m + 1, np.int64)
    np.add.at(covered, at[same], 1)
    np.add.at(covered, at[same] + n[same], -1)
    gone = np.cumsum(covered)[:m] > 0
    if not gone.any():
        return data, 0
    edges = np.r_[sp.byte, len(data)]
    kept = [data[:edges[0]]] + [data[edges[k]:edges[k + 1]] for k in np.flatnonzero(~gone)]
    return b"".join(kept).rstrip(b" \t\n\r\x0b\x0c"), int(gone.sum())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their repeated passages cut from the text, and n_removed, the sentences cut."""
    reachable(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).where("__id is not null")
    size = source.agg(F.coalesce(F.sum(F.octet_length("__text").cast("long")), F.lit(0))).first()[0]
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    buckets = max(BUCKETS * parts, size // BUCKET_BYTES)
    with arrow_batches(docs.sparkSession, BATCH):
        spread = source.mapInArrow(lean(_spans(buckets)), "bucket long, kind int, rows binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
        repeats = stored(spread.mapInArrow(lean(_repeats), "doc long, at int, n int, h long"), "repeats")
    doc, held = fresh_name("doc", docs), fresh_name("spans", docs)
    own = stored(repeats.groupBy(F.col("doc").alias(doc)).agg(F.collect_set(F.struct("at", "n", "h")).alias(held)), "spans")
    names = [c for c in docs.columns if c != "n_removed"]
    joined = docs.select(*names).join(own, docs[id_col].cast("long") == own[doc], "left").select(*names, held)
    schema = T.StructType([*[f for f in docs.select(*names).schema.fields], T.StructField("n_removed", T.LongType())])

    def go(batches):
        for b in (x.slice(k, CUT_ROWS) for x in batches for k in range(0, x.num_rows, CUT_ROWS)):
            spans, removed = b.column(held), np.zeros(b.num_rows, np.int64)
            text = b.column(text_col)
            hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                values = text.to_pylist()
                for k in hit.tolist():
                    data, n = _without((values[k] or "").encode(), spans[k].as_py())
                    if n:
                        values[k], removed[k] = data.decode(), n
                text = pa.array(values, text.type)
            yield pa.RecordBatch.from_arrays([*[text if c == text_col else b.column(c) for c in names], pa.array(removed)], [*names, "n_removed"])

    return joined.mapInArrow(lean(go), schema)
