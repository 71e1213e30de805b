"""Vector code compression: each of four parts of a vector becomes the number of a codebook entry, fitted by dual-tree Lloyd rounds.

Vectors become integers, floor(1024 x), and are cut into four equal consecutive parts. The codebook of a part position starts
as that part of the 256 vectors of smallest id; four rounds assign every part to its nearest entry and replace each entry by
the floor of its parts' mean; a last assignment gives the codes.

Vectors are stored once as blocks: of each part position the points of a block in the order of a median-split tree, whose
nodes are then plain ranges. A task builds a second tree over the entries and walks both level by level, all pairs of nodes
of a level at once. Box distances bound each pair from below and above; a pair goes when its least distance is beyond the
smallest greatest distance of its point node. A point node with a single entry left is assigned as a whole, its sum being a
difference of two running sums; leaves of points with several entries left are settled on exact 64-bit integer distances,
ties to the lower index. Tasks return sums and counts by entry, Spark adds them up, and only codebooks reach the driver.

Defined cases: vectors that are null or hold null or non-finite components are dropped; vectors shorter than the longest, or
of a length that four does not divide, count as filled up with zeros at their end; with fewer than 256 vectors a codebook has
as many entries; repeated ids are separate rows, smaller vectors first, null ids last; so that squared distances fit a long,
integers beyond +-sqrt(2^63 / length) / 2 (1.8e8 at 64 components) count as that bound, and a label's sum beyond the largest
long is that long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.shared import reachable, scratch, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block, points of a leaf.
BLOCK, LEAF = 4096, 16
#: Room for rounding in the bounds, which are float64.
SLACK = 1 - 1e-9
_CODES = "vec_id long, label {}, code string, error long"


def integers(rows: list, width: int) -> np.ndarray:
    """floor(1024 x) of each vector, filled up with zeros to ``width`` components."""
    bound = isqrt((2**63 - 1) // width) // 2
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate([np.asarray(r, float) for r in rows]) if len(rows) else np.zeros(0)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(SCALE * flat), -bound, bound).astype(np.int64)
    out = np.zeros((len(rows), width), np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end."""
    return n * np.arange(2**level + 1) // 2**level


def _depth(n: int, leaf: int) -> int:
    return max(0, (n // leaf).bit_length() - 1)


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the points in which every node of a median-split tree is a range."""
    n, order = len(points), np.arange(len(points))
    for level in range(_depth(n, leaf)):
        start = _bounds(n, level)
        own = points[order]
        spread = np.maximum.reduceat(own, start[:-1]) - np.minimum.reduceat(own, start[:-1])
        node = np.repeat(np.arange(2**level), np.diff(start))
        order = order[np.lexsort((own[np.arange(n), spread.argmax(1)[node]], node))]
    return order


class Tree:
    """Boxes of the nodes of every level, for points in tree order."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.depth = points, _depth(len(points), leaf)
        self.start = [_bounds(len(points), k) for k in range(self.depth + 1)]
        low, high = (f.reduceat(points, self.start[-1][:-1]).astype(float) for f in (np.minimum, np.maximum))
        self.boxes = [(low, high)]
        for _ in range(self.depth):
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.boxes.insert(0, (low, high))


class Entries(Tree):
    """A codebook's tree: ``number`` holds the entries' indexes in tree order."""

    def __init__(self, book: np.ndarray):
        self.book, self.number = book, tree_order(book, 1)
        super().__init__(book[self.number], 1)


def _children(node: np.ndarray, other: np.ndarray):
    return np.stack([2 * node, 2 * node + 1], 1).ravel(), np.repeat(other, 2)


def _near_pairs(tree: Tree, entries: Entries, p: int, e: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs (x, y) of nodes of levels p and e can hold a point and its nearest entry; pairs come sorted by x."""
    low, high = (a[x] for a in tree.boxes[p])
    elow, ehigh = (a[y] for a in entries.boxes[e])
    least = (np.maximum(np.maximum(elow - high, low - ehigh), 0) ** 2).sum(1)
    most = (np.maximum(ehigh - low, high - elow) ** 2).sum(1)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    reach = np.minimum.reduceat(most, first)
    return least * SLACK <= np.repeat(reach, np.diff(np.r_[first, len(x)]))


def assign(tree: Tree, entries: Entries):
    """Nearest entries: (start, end, entry) of the ranges assigned as wholes, and (positions, entries) of all other points."""
    x, y, p, e = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    ranges, spots, codes = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        if len(x):
            near = _near_pairs(tree, entries, p, e, x, y)
            x, y = x[near], y[near]
        if e == entries.depth and len(x):
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            alone = np.diff(np.r_[first, len(x)]) == 1
            alone &= np.diff(entries.start[e])[y[first]] == 1
            whole = first[alone]
            ranges.append(np.stack([tree.start[p][x[whole]], tree.start[p][x[whole] + 1], entries.number[entries.start[e][y[whole]]]], 1))
            rest = np.repeat(~alone, np.diff(np.r_[first, len(x)]))
            x, y = x[rest], y[rest]
        if not len(x) or (p, e) == (tree.depth, entries.depth):
            break
        if e < entries.depth:
            y, x = _children(y, x)
            e += 1
        if p < tree.depth:
            order = np.argsort(x, kind="stable")
            x, y = _children(x[order], y[order])
            order = np.argsort(x, kind="stable")
            x, y, p = x[order], y[order], p + 1
    if len(x):
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        for own, nodes in zip(x[first].tolist(), np.split(y, first[1:]), strict=True):
            s, t = tree.start[p][own], tree.start[p][own + 1]
            few = np.sort(np.concatenate([entries.number[entries.start[e][k]:entries.start[e][k + 1]] for k in nodes]) if np.diff(entries.start[e]).max() > 1
                          else entries.number[entries.start[e][nodes]])
            far = (entries.book[few] ** 2).sum(1) - 2 * (tree.points[s:t] @ entries.book[few].T)
            spots.append(np.arange(s, t))
            codes.append(few[far.argmin(1)])
    return np.concatenate(ranges) if ranges else np.zeros((0, 3), np.int64), np.concatenate(spots), np.concatenate(codes)


def _blocks(width: int):
    """Blocks of vectors: ids, labels, and for each part position the points in tree order with that order."""
    def go(batches):
        for b in (x.slice(k, BLOCK) for x in batches for k in range(0, x.num_rows, BLOCK)):
            n = b.num_rows
            whole = integers(b.column("vector").to_numpy(zero_copy_only=False), width).reshape(n, PARTS, width // PARTS)
            orders = [tree_order(whole[:, p], LEAF) for p in range(PARTS)]
            ends = pa.array([0, n], pa.int32())
            yield pa.RecordBatch.from_pydict({
                "ids": pa.ListArray.from_arrays(ends, b.column("vec_id")), "labels": pa.ListArray.from_arrays(ends, b.column("label")),
                "points": pa.array([b"".join(whole[o, p].astype("<i4").tobytes() for p, o in enumerate(orders))], pa.binary()),
                "orders": pa.array([np.stack(orders).astype("<i4").tobytes()], pa.binary())})
    return go


def _trees(b: pa.RecordBatch, k: int, width: int) -> list[Tree]:
    points = np.frombuffer(b.column("points")[k].as_buffer(), "<i4").reshape(PARTS, -1, width // PARTS)
    return [Tree(own.astype(np.int64), LEAF) for own in points]


def _sums(books, width: int):
    """(part, entry, count, sums) of a task's points by their nearest entries."""
    def go(batches):
        entries = [Entries(book) for book in books.value]
        sums = [np.zeros(book.shape, np.int64) for book in books.value]
        count = [np.zeros(len(book), np.int64) for book in books.value]
        for b in batches:
            for k in range(b.num_rows):
                for p, tree in enumerate(_trees(b, k, width)):
                    ranges, spots, codes = assign(tree, entries[p])
                    running = np.concatenate([np.zeros((1, tree.points.shape[1]), np.int64), np.cumsum(tree.points, 0)])
                    np.add.at(sums[p], ranges[:, 2], running[ranges[:, 1]] - running[ranges[:, 0]])
                    np.add.at(count[p], ranges[:, 2], ranges[:, 1] - ranges[:, 0])
                    np.add.at(sums[p], codes, tree.points[spots])
                    count[p] += np.bincount(codes, minlength=len(count[p]))
        for p in range(PARTS):
            has = np.flatnonzero(count[p])
            yield pa.RecordBatch.from_pydict({"part": pa.array([p] * len(has), pa.int32()), "entry": pa.array(has, pa.int32()), "n": pa.array(count[p][has]),
                                              "sums": pa.array(list(sums[p][has]), pa.list_(pa.int64()))})
    return go


def _codes(books, width: int):
    """(vec_id, label, code, error) of every vector."""
    def go(batches):
        entries = [Entries(book) for book in books.value]
        for b in batches:
            for k in range(b.num_rows):
                ids, labels = (b.column(c).slice(k, 1).flatten() for c in ("ids", "labels"))
                orders = np.frombuffer(b.column("orders")[k].as_buffer(), "<i4").reshape(PARTS, -1)
                code, error = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for p, tree in enumerate(_trees(b, k, width)):
                    ranges, spots, found = assign(tree, entries[p])
                    own = np.zeros(len(ids), np.int64)
                    own[spots] = found
                    for s, t, entry in ranges.tolist():
                        own[s:t] = entry
                    code[orders[p], p] = own
                    error[orders[p]] += ((tree.points - entries[p].book[own]) ** 2).sum(1)
                text = code.tobytes().hex()
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "label": labels, "code": pa.array([text[2 * PARTS * j:2 * PARTS * (j + 1)] for j in range(len(ids))], pa.string()),
                                                  "error": pa.array(error)})
    return go


def usable(rows: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null and has no null or non-finite component."""
    bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(vec_col).isNotNull() & ~F.coalesce(bad, F.lit(False)))


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, as decimal integers with commas between."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error of every usable vector; the four codebooks)."""
    spark = rows.sparkSession
    reachable(spark)
    label = rows.schema[label_col].dataType.simpleString()
    source = usable(rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label")), "vector")
    longest = source.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], _CODES.format(label)), [np.zeros((0, 1), np.int64)] * PARTS
    width = max(PARTS, -(-longest // PARTS) * PARTS)
    with scratch(spark):
        first = integers([r.vector for r in source.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).select("vector").collect()], width)
        books = [first[:, k:k + width // PARTS] for k in range(0, width, width // PARTS)]
        blocks = stored(source.mapInArrow(_blocks(width), f"ids array<long>, labels array<{label}>, points binary, orders binary"), "blocks")
        for _ in range(ROUNDS):
            own = blocks.select("points").mapInArrow(_sums(spark.sparkContext.broadcast(books), width), "part int, entry int, n long, sums array<long>")
            added = (own.select("part", "entry", "n", F.posexplode("sums").alias("place", "sum"))
                     .groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect())
            books = [book.copy() for book in books]
            for r in added:
                books[r.part][r.entry, r.place] = int(r["sum"]) // r.n
        coded = stored(blocks.mapInArrow(_codes(spark.sparkContext.broadcast(books), width), _CODES.format(label)), "codes", lasting=True)
    return coded, books


def codes(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (errors of equal labels added up, nulls together), codebooks_sha256."""
    coded, books = compress(rows, id_col, vec_col, label_col)
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    total = coded.groupBy(F.col("label").alias("own")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    return (coded.join(total, F.col("label").eqNullSafe(F.col("own")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))
