"""Ranked lexical search: item vocabulary tiles times document impact tiles by BLAS in float64.

A document's impact for a term is (10^9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L, an item's weight of a term
is its occurrences times floor(1000 ln((2 N + 2) / (2 df + 1))); a score is the sum of their products over the item's terms.

One pass over the documents keeps, of each, its length and its term counts within the items' vocabulary (postings). A
second pass multiplies: items are cut into blocks, the vocabulary of a block into tiles of columns, documents into tiles of
rows. Impacts and weights are integers, and a tile takes columns only while no item's weights times the greatest impact can
sum beyond 2^53, so every product and partial sum of a multiplication is exact in float64 whatever the order; tiles add up
in 64-bit integers. A weight too large for any tile is split over several columns. Of a tile's scores those that reach the
item's k-th best so far go on, ties included, and are cut by (score, doc_id); every task returns k rows an item at most.

Items are taken in rounds of a bounded number of (item, term) pairs, so what is sent to the tasks is bounded whatever the
number of items; each round reads all documents.

Defined cases: null text has no terms; items and documents without terms get no rows and do not count in N; repeated rows
of an item count once, different texts under one item_id are one item with the terms of all; repeated documents are
documents of their own; a null id is an id, null doc_ids come last among equal scores; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.shared import arrow_batches, reachable, scratch, stored
from tabulon.llm.terms import term_lists

#: Results an item gets.
TOP = 20
#: (item, term) pairs that one round sends to the tasks.
ROUND_PAIRS = 1_000_000
#: Items of a block, columns of a vocabulary tile, rows of a document tile.
ITEMS, COLUMNS, ROWS = 512, 4096, 512
#: Impacts are below this, partial sums stay below EXACT.
GREATEST_IMPACT, EXACT = 10**6, 2**53
#: Bytes of weight tiles that a task keeps; further ones are built again for each document tile.
KEPT_BYTES = 64 << 20
#: Words that are counted at once, and slices in which an item's candidates are cut before the last ranking.
WORDS, SLICES = 500_000, 64
BATCH = "16m"


def _item_terms(batches):
    """(item_id, term, times) of each item's text."""
    for b in batches:
        ids, terms, times = [], [], []
        for item, words in zip(b.column("item_id").to_pylist(), term_lists(b.column("text")), strict=True):
            own = Counter(words)
            ids += [item] * len(own)
            terms += own.keys()
            times += own.values()
        yield pa.RecordBatch.from_pydict({"item_id": pa.array(ids, pa.int64()), "term": pa.array(terms, pa.binary()), "times": pa.array(times, pa.int64())})


def _postings(vocabulary):
    """(doc_id, n, ids, tfs): length of each document that has terms, and its counts of the vocabulary's terms."""
    def rows(docs, sizes, flat):
        found = np.array(flat, np.int64)
        owner = np.repeat(np.arange(len(docs)), sizes)
        owner, found = owner[found >= 0], found[found >= 0]
        order = np.lexsort((found, owner))
        owner, found = owner[order], found[order]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])]) if len(owner) else np.zeros(0, np.int64)
        ends = pa.array(np.r_[0, np.cumsum(np.bincount(owner[first], minlength=len(docs)))], pa.int32())
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(docs, pa.int64()), "n": pa.array(sizes, pa.int64()),
            "ids": pa.ListArray.from_arrays(ends, pa.array(found[first], pa.int32())),
            "tfs": pa.ListArray.from_arrays(ends, pa.array(np.diff(np.r_[first, len(owner)]), pa.int32()))})

    def go(batches):
        get = vocabulary.value.get
        for b in batches:
            docs, sizes, flat = [], [], []
            for doc, words in zip(b.column("doc_id").to_pylist(), term_lists(b.column("text")), strict=True):
                if words:
                    docs.append(doc)
                    sizes.append(len(words))
                    flat += [get(w, -1) for w in words]
                if len(flat) >= WORDS:
                    yield rows(docs, sizes, flat)
                    docs, sizes, flat = [], [], []
            if docs:
                yield rows(docs, sizes, flat)
    return go


def _holders(terms: int):
    """(term, df): documents of a task that hold each term."""
    def go(batches):
        count = np.zeros(terms, np.int64)
        for b in batches:
            count += np.bincount(b.column("ids").flatten().to_numpy(zero_copy_only=False), minlength=terms)
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"term": pa.array(has, pa.int32()), "df": pa.array(count[has])})
    return go


@dataclass
class Tile:
    """Weights of a block's items for some terms: columns are the sorted term numbers, at and col say where values lie."""

    columns: np.ndarray
    at: np.ndarray
    col: np.ndarray
    value: np.ndarray

    def weights(self, items: int) -> np.ndarray:
        out = np.zeros((len(self.columns), items))
        np.add.at(out, (self.col, self.at), self.value)
        return out


def tiles(at: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray) -> list[Tile]:
    """Tiles for (item, term, times) sorted by term: at most COLUMNS columns, and no item's sum of
    weight * GREATEST_IMPACT beyond EXACT. Times that are too many for one tile go on in further ones."""
    out: list[Tile] = []
    parts: tuple[list, list, list] = ([], [], [])
    held: Counter = Counter()
    columns: list[int] = []

    def close():
        nonlocal parts, held, columns
        if columns:
            out.append(Tile(np.array(columns), *(np.array(x, np.int64) for x in parts)))
        parts, held, columns = ([], [], []), Counter(), []

    for i, t, k in zip(at.tolist(), term.tolist(), times.tolist(), strict=True):
        unit = int(weight[t]) * GREATEST_IMPACT
        while k and unit:
            room = (EXACT - held[i]) // unit
            if not room or len(columns) == COLUMNS and columns[-1] != t:
                close()
                continue
            now = min(k, room)
            if not columns or columns[-1] != t:
                columns.append(t)
            for x, v in zip(parts, (i, len(columns) - 1, now * int(weight[t])), strict=True):
                x.append(v)
            held[i] += now * unit
            k -= now
    close()
    return out


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m) of every posting, n being its document's length."""
    wide = n.astype(object) if len(n) and 25 * int(n.max()) * docs >= 2**63 else n
    m = (75 + 25 * wide * docs // total).astype(np.int64) if total else 75 + 0 * n
    return (10**9 * tf) // (1000 * tf + 12 * m)


class _Best:
    """The k best (score, doc) of each item of a block, ties by ascending doc, null docs last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.item, self.score, self.null, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.floor)
        if not len(row):
            return
        item, score = np.r_[self.item, item], np.r_[self.score, scores[row, item]]
        null, doc = np.r_[self.null, null[row]], np.r_[self.doc, doc[row]]
        order = np.lexsort((doc, null, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        last = order[place == self.k - 1]
        self.floor[item[last]] = score[last]
        order = order[place < self.k]
        self.item, self.score, self.null, self.doc = item[order], score[order], null[order], doc[order]


def _search(model, k: int):
    """The task's k best documents of every item."""
    def go(batches):
        m = model.value
        dense: dict[tuple[int, int], np.ndarray] = {}
        room = KEPT_BYTES
        best = [_Best(items, k) for items, _ in m["blocks"]]
        for b in (x.slice(s, ROWS) for x in batches for s in range(0, x.num_rows, ROWS)):
            ids, sizes = b.column("ids"), b.column("ids").value_lengths().to_numpy()
            term, tf = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "tfs"))
            row = np.repeat(np.arange(len(ids)), sizes)
            impact = impacts(tf, b.column("n").to_numpy()[row], m["docs"], m["total"]).astype(float)
            null = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            doc = b.column("doc_id").fill_null(0).to_numpy()
            for x, (items, own) in enumerate(m["blocks"]):
                scores = np.zeros((len(ids), items), np.int64)
                for y, tile in enumerate(own):
                    place = np.minimum(np.searchsorted(tile.columns, term), len(tile.columns) - 1)
                    has = tile.columns[place] == term
                    if not has.any():
                        continue
                    weights = dense.get((x, y))
                    if weights is None:
                        weights = tile.weights(items)
                        if weights.nbytes <= room:
                            room -= weights.nbytes
                            dense[x, y] = weights
                    held = np.zeros((len(ids), len(tile.columns)))
                    held[row[has], place[has]] = impact[has]
                    scores += (held @ weights).astype(np.int64)
                best[x].add(scores, null, doc)
        start = 0
        for (items, _), own in zip(m["blocks"], best, strict=True):
            names = pa.array(m["names"][start:start + items], pa.int64())
            yield pa.RecordBatch.from_pydict({"item_id": names.take(pa.array(own.item)), "doc_id": pa.array(own.doc, pa.int64(), mask=own.null), "score": pa.array(own.score)})
            start += items
    return go


def _rounds(pairs: DataFrame) -> list[DataFrame]:
    """Item terms in rounds of about ROUND_PAIRS rows: whole items by a hash of their id, more rounds while one is too large."""
    seen = pairs.agg(F.count("*").alias("pairs"), F.count_distinct(F.coalesce("item_id", F.lit(0))).alias("items")).first()
    rounds = -(-seen.pairs // ROUND_PAIRS)
    part = lambda n: F.pmod(F.xxhash64("item_id"), F.lit(n))
    while 1 < rounds < seen.items and pairs.groupBy(part(rounds)).count().agg(F.max("count")).first()[0] > 2 * ROUND_PAIRS:
        rounds *= 2
    return [pairs.where(part(rounds) == r) for r in range(rounds)]


def _numbers(known: list, values: list) -> np.ndarray:
    place = {v: j for j, v in enumerate(known)}
    return np.array([place[v] for v in values], np.int64)


def _round(docs: DataFrame, own: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    rows = own.toArrow()
    names = pa.array(sorted(rows.column("item_id").unique().to_pylist(), key=lambda x: (x is None, x)), pa.int64())
    terms = sorted(rows.column("term").unique().to_pylist())
    item = _numbers(names.to_pylist(), rows.column("item_id").to_pylist())
    term = _numbers(terms, rows.column("term").to_pylist())
    times = rows.column("times").to_numpy()
    vocabulary = spark.sparkContext.broadcast({t: j for j, t in enumerate(terms)})
    postings = stored(docs.mapInArrow(_postings(vocabulary), "doc_id long, n long, ids array<int>, tfs array<int>"), "postings")
    total = postings.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    held = postings.select("ids").mapInArrow(_holders(len(terms)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weight = np.zeros(len(terms), np.int64)
    for r in held:
        weight[r.term] = math.floor(1000 * math.log((2 * total.docs + 2) / (2 * r.df + 1)))
    blocks = []
    for start in range(0, len(names), ITEMS):
        sel = np.flatnonzero((item >= start) & (item < start + ITEMS))
        sel = sel[np.lexsort((item[sel], term[sel]))]
        blocks.append((min(ITEMS, len(names) - start), tiles(item[sel] - start, term[sel], times[sel], weight)))
    model = spark.sparkContext.broadcast({"docs": total.docs, "total": total.total, "names": names.to_pylist(), "blocks": blocks})
    found = postings.where(F.size("ids") > 0).mapInArrow(_search(model, k), "item_id long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    few = found.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("item_id", "slice").orderBy(*order))).where(F.col("place") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return stored(ranked.select("item_id", "rank", "doc_id", "score"), "ranked", lasting=True)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for every item."""
    spark = docs.sparkSession
    reachable(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).distinct()
    with scratch(spark), arrow_batches(spark, BATCH):
        pairs = stored(own.mapInArrow(_item_terms, "item_id long, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times")), "item-terms")
        done = [_round(source, r, k) for r in _rounds(pairs) if not r.isEmpty()]
    if not done:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.union, done)
