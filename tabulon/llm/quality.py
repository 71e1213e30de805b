"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (sizes, character classes, repetition of words,
word pairs and lines) are computed over Arrow batches in numpy. Trees of one
depth are grown on quantile histograms of a bounded labelled sample and kept
as flat arrays, which a task walks for all its documents and trees at once.

Defined cases: null text is empty text and has zeros for statistics; repeated
rows get equal scores; labels other than 0 and 1 and labels of unknown
documents are ignored; without labelled rows of both classes every score is
the share of label 1 among them (0.5 without any); an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.labelled import held_out, training_sample
from tabulon.llm.shared import lean, runs, text_buffers, with_text
from tabulon.llm.shingles import mix64, words

#: Labelled documents of each class that are learnt from, at most.
SAMPLE = 10_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 80, 4, 64, 0.15, 20, 1.0

_CLASS = np.full(256, 9, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 newline, 5 . ! ?, 6 other marks, 7 bar, 8 symbols, 9 not ASCII
_CLASS[:128] = 8
for _group, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".!?", ",;:'\"-()", "|")):
    _CLASS[[ord(c) for c in _chars]] = _group
_CLASSES = 10


def _distinct(doc, value, docs):
    """(distinct values, count of the most frequent value) per document."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])]) if len(d) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(d)])
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, d[first], times)
    return np.bincount(d[first], minlength=docs), top


def statistics(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """A row of statistics for each document of a run."""
    docs = len(offsets) - 1
    size = np.diff(offsets)
    of = np.repeat(np.arange(docs), size)
    kinds = np.bincount(of * _CLASSES + _CLASS[raw], minlength=docs * _CLASSES).reshape(docs, _CLASSES).astype(float)
    symbols = np.bincount(of * 256 + raw, minlength=docs * 256).reshape(docs, 256).astype(float)
    n = np.maximum(size, 1).astype(float)
    p = symbols / n[:, None]
    entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(1)
    doc, h, s, e = words(offsets, raw)
    count = np.bincount(doc, minlength=docs)
    w = np.maximum(count, 1).astype(float)
    length, last, first = e - s, _CLASS[raw[e - 1]], _CLASS[raw[s]]
    per = lambda x: np.bincount(doc, weights=x, minlength=docs) / w
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, doc, length)
    distinct, top = _distinct(doc, h, docs)
    pair = doc[1:] == doc[:-1]
    pairs, top_pair = _distinct(doc[1:][pair], mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[pair], docs)
    breaks = np.flatnonzero(raw == 10)
    line_of_word = np.searchsorted(breaks, s)
    head = np.flatnonzero(np.r_[True, (line_of_word[1:] != line_of_word[:-1]) | ~pair]) if len(doc) else np.zeros(0, np.int64)
    lines = np.bincount(doc[head], minlength=docs)
    total = np.r_[np.uint64(0), np.cumsum(mix64(h + (np.arange(len(h)) - np.repeat(head, np.diff(np.r_[head, len(h)]))).astype(np.uint64)))] if len(h) else np.zeros(1, np.uint64)
    line_hash = total[np.r_[head[1:], len(h)]] - total[head] if len(head) else np.zeros(0, np.uint64)
    own_lines, _ = _distinct(doc[head], line_hash, docs)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    x = np.stack([
        np.log1p(size), np.log1p(count), per(length), kinds[:, 1] / letters, *(kinds[:, k] / n for k in (2, 3, 4, 5, 6, 7, 8, 9)),
        distinct / w, top / w, pairs / np.maximum(count - 1, 1), top_pair / w, lines / w, own_lines / np.maximum(lines, 1),
        np.log1p(longest), per(length <= 2), per((last >= 5) & (last <= 8)), per(last == 8), per(last == 5), per(first == 1), entropy], axis=1)
    return np.where(size[:, None] > 0, x, 0.0)


def _batch_statistics(column) -> np.ndarray:
    offsets, raw = text_buffers(column)
    rows = [statistics(offsets[i:j + 1] - offsets[i], raw[offsets[i]:offsets[j]]) for i, j in runs(offsets)]
    return np.concatenate(rows) if rows else np.zeros((0, 25))


@dataclass
class Trees:
    """Trees of one depth as flat arrays: inner nodes in breadth-first order, then leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k in range(0, len(x), 4096):
            part = x[k:k + 4096]
            rows, trees = np.arange(len(part))[:, None], np.arange(len(self.feature))[None, :]
            at = np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0):
                at = 2 * at + 1 + (part[rows, self.feature[trees, at]] > self.threshold[trees, at])
            if self.leaf.size:
                out[k:k + 4096] += self.leaf[trees, at - self.feature.shape[1]].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees with logistic loss on quantile histograms; split gain by gradients and curvatures."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        flat = np.zeros((0, 0))
        return Trees(flat.astype(np.int64), flat, flat, 30.0 * (2 * share - 1) if len(y) else 0.0)
    inner, features = 2**DEPTH - 1, x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(features)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(features)])
    margin = np.full(len(y), np.log(share / (1 - share)))
    out = Trees(np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1)), float(margin[0]))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            base, nodes = 2**depth - 1, 2**depth
            local = node - base
            best, pick, cut = np.zeros(nodes), np.zeros(nodes, np.int64), np.full(nodes, BINS)
            for f in range(features):
                slot = local * BINS + binned[f]
                sums = [np.bincount(slot, weights=v, minlength=nodes * BINS).reshape(nodes, BINS).cumsum(1) for v in (g, h, np.ones(len(y)))]
                (gl, hl, nl), (ga, ha, na) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + RIDGE) + (ga - gl)**2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
                gain[(nl < LEAST) | (na - nl < LEAST)] = 0
                gain[:, len(edges[f]):] = 0
                b = gain.argmax(1)
                v = gain[np.arange(nodes), b]
                better = v > best + 1e-9
                best[better], pick[better], cut[better] = v[better], f, b[better]
            out.feature[t, base:base + nodes] = pick
            out.threshold[t, base:base + nodes] = [edges[f][c] if c < BINS else np.inf for f, c in zip(pick, cut, strict=True)]
            node = 2 * node + 1 + (binned[pick[local], np.arange(len(y))] > cut[local])
        leaf = node - inner
        value = RATE * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + RIDGE)
        out.leaf[t] = value
        margin = margin + value[leaf]
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees from at most ``sample`` labelled documents of each class, whose statistics come to the driver."""
    chosen = training_sample(docs, labels, "quality", sample, id_col, text_col)

    def describe(batches):
        for b in batches:
            x = _batch_statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = chosen.select("doc_id", "y", "text").mapInArrow(lean(describe), "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id")
    return grow(np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, 25)), rows["y"].to_numpy(float))


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def go(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(model.value.score(_batch_statistics(b.column("text"))))], ["doc_id", "score"])

    return with_text(docs, id_col, text_col).mapInArrow(lean(go), "doc_id long, score double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a score of ``threshold`` or more, all their columns, in one pass without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col))

    def go(batches):
        for b in batches:
            yield b.filter(pa.array(model.value.score(_batch_statistics(b.column(text_col))) >= threshold, pa.bool_()))

    return docs.mapInArrow(lean(go), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **columns) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, train(docs, labels, **columns), **columns)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
