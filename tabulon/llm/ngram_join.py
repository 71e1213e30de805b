"""N-gram Jaccard join: size-banded tiles, parity bitmaps, exact sorted-array intersection.

Every document becomes the set of its five-word shingles. Documents with one
set are one node (their smallest id stands for them). A tile holds the nodes
that share one shingle of their prefixes: a set of n shingles shares at least
ceil(0.8 n) with any partner, so two partners meet in a tile of one of their
first n - ceil(0.8 n) + 1 shingles in any common order. Frequent shingles come
last in that order, so a passage that many documents share makes no tile
unless it is most of a document. Within a tile only nodes of one size band
(sizes within a factor 0.8) are compared; xor counts of parity bitmaps bound
their overlap from above, and what passes is verified on the sorted arrays.

Tiles are searched in rounds. First every node meets the smallest node of its
tiles; then, twice, the node of another group that its bitmap is nearest to;
the verified links join most groups by then. At last all pairs of nodes that
are still in different groups are tested, so that no link between groups is
missed, while a group of very many near copies gives a number of pairs in
proportion to its size, not its square. Tiles of many rows are
cut into blocks, and pairs of blocks go to different tasks.

Every link lies inside one of the components found so, so the links are all
pairs of a component's nodes that pass band, bit bound and the exact count.
Components are cut into blocks too, and pairs of blocks go to different tasks.
A group of m near copies has up to m * m / 2 links; they are stored packed, a
node's partners in one row for each pair of blocks.

Defined cases: null text is empty text; an empty set links with nothing and
is its own component; fewer than five words are one shingle; rows that share an
id (or have none) are documents of their own, each with the links of its own
text, and a component is named by its smallest id, null if it has none; an
empty table gives an empty result. Columns other than the id and the text are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tabulon.llm.components import components, merged
from tabulon.llm.shared import arrow_batches, bucketed, lean, scratch, sized, stored, text_buffers, with_text
from tabulon.llm.shingles import parity_bits, shingle_sets

#: A shingle in one of so many documents counts as frequent. It only moves it to the end of the prefix order;
#: their number is at most HOT_SHARE times the mean set size, whatever the corpus.
HOT_SHARE = 2000
#: The same bound as a plain number of 8-byte keys that are sent to every task (8 MB).
HOT_KEYS = 1 << 20
#: Documents whose shingles a task holds at once to see which are frequent.
DESCRIBED = 4000
#: Prefix rows that one task takes, and rows of a tile's block.
ROWS_PER_TASK, BLOCK = 500_000, 2048
#: Rows without texts or bitmaps, rows with bitmaps, and pairs with both texts that one task of a round takes at least.
SMALL_ROWS, BIT_ROWS, TEXT_PAIRS = 200_000, 20_000, 1000
#: Prefix rows that a task packs at once, and pairs whose repeats it remembers.
PACKED_ROWS, REMEMBERED_PAIRS = 500_000, 100_000
#: Nodes, and shingles, of a component's block.
LINK_BLOCK, LINK_SHINGLES = 256, 500_000
#: Bytes of rows that a Python worker gets at once.
BATCH = "8m"
_ROW = np.dtype([("lo", "<u4"), ("hi", "<u2"), ("n", "<u2"), ("sid", "<u8")])


@dataclass
class Join:
    """sets(doc_id, n_shingles, dig, rep, first, copies): the node of the document's set, the smallest id and the number of the
    set's documents; links(a, b): all links between nodes, a < b; components(node, label) of the linked nodes; linked(node,
    n_links): the documents of other sets that each of them links with. With components only, links are some that span every
    component, linked is None. A node is the smallest id of its set, or a 64-bit hash of it and the set if several rows have that
    id or it is null; odd(doc_id) holds such ids, None if there are none."""

    sets: DataFrame
    links: DataFrame
    components: DataFrame
    linked: DataFrame | None = None
    odd: DataFrame | None = None


def _read(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        offsets, raw = text_buffers(b.column("text"))
        yield b, offsets, raw


def _digests(sizes, flat):
    ends = np.cumsum(sizes)
    return [blake2b(flat[e - n:e].tobytes(), digest_size=16).digest() if n else b"" for n, e in zip(sizes, ends, strict=True)]


def _sids(digests) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] or bytes(8) for d in digests), "<u8")


_SETS = "doc_id long, n long, prefix long, dig binary, hot long, times long"


def _describe(batches):
    """Sizes and digests of the documents' sets, and shingles that are frequent in a batch."""
    for b, offsets, raw in _read(x.slice(k, DESCRIBED) for x in batches for k in range(0, x.num_rows, DESCRIBED)):
        n, dig, flats = [], [], []
        for _, _, sizes, flat in shingle_sets(offsets, raw):
            n.append(sizes)
            dig += _digests(sizes, flat)
            flats.append(flat)
        if not n:
            continue
        n = np.concatenate(n)
        every = np.sort(np.concatenate(flats))
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(every)])
        often = times >= max(8, 2 * len(n) // HOT_SHARE)
        hot, times = every[first[often]] >> np.uint64(16), times[often]
        none = len(hot)
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.concat_arrays([b.column("doc_id").cast(pa.int64()), pa.nulls(none, pa.int64())]),
            "n": pa.concat_arrays([pa.array(n), pa.nulls(none, pa.int64())]),
            "prefix": pa.concat_arrays([pa.array(n - (4 * n + 4) // 5 + (n > 0)), pa.nulls(none, pa.int64())]),
            "dig": pa.concat_arrays([pa.array(dig, pa.binary()), pa.nulls(none, pa.binary())]),
            "hot": pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(hot.astype(np.int64))]),
            "times": pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(times)])})


def _prefixes(hot, buckets: int):
    """Prefix rows of the documents, packed by bucket: kind 0 by shingle, kind 1 (frequent shingles) anywhere."""
    def go(batches):
        common, rank = hot.value
        rng = np.random.default_rng(7)

        def pack(parts):
            rows, late, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
            bucket[late] = rng.integers(0, buckets, late.sum()) // 4 * 4
            order = np.lexsort((rows["hi"], bucket, late))
            rows, late, bucket = rows[order], late[order], bucket[order]
            cut = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (late[1:] != late[:-1])]) if len(rows) else []
            ends = np.r_[cut[1:], len(rows)] if len(rows) else []
            return pa.RecordBatch.from_pydict({
                "bucket": pa.array(bucket[cut] if len(rows) else [], pa.int64()),
                "kind": pa.array(late[cut].astype(np.int32) if len(rows) else [], pa.int32()),
                "rows": pa.array([rows[s:e].tobytes() for s, e in zip(cut, ends, strict=True)], pa.binary())})

        parts: list = []
        for _, offsets, raw in _read(batches):
            seen: set = set()
            for _, _, sizes, flat in shingle_sets(offsets, raw):
                dig = _digests(sizes, flat)
                fresh = np.zeros(len(sizes), bool)
                for k, d in enumerate(dig):
                    if d and d not in seen:
                        seen.add(d)
                        fresh[k] = True
                owner = np.repeat(np.arange(len(sizes)), sizes)
                key = flat >> np.uint64(16)
                if len(common):
                    at = np.minimum(np.searchsorted(common, key), len(common) - 1)
                    late = np.where(common[at] == key, rank[at], 0)
                    order = np.lexsort((late, owner))
                    owner, key, late = owner[order], key[order], late[order]
                else:
                    late = np.zeros(len(key), np.int64)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = (place < (sizes - (4 * sizes + 4) // 5 + 1)[owner]) & fresh[owner]
                owner, key, late = owner[keep], key[keep], late[keep]
                rows = np.empty(len(key), _ROW)
                rows["lo"], rows["hi"] = key & np.uint64(0xFFFFFFFF), key >> np.uint64(32)
                rows["n"], rows["sid"] = np.minimum(sizes, 65535)[owner], _sids(dig)[owner]
                parts.append((rows, late > 0, (key % np.uint64(buckets)).astype(np.int64)))
                if sum(len(r) for r, _, _ in parts) >= PACKED_ROWS:
                    yield pack(parts)
                    parts = []
        if parts:
            yield pack(parts)
    return go


_TILE = "key long, sid long, n int"


def _tile_batch(rows):
    key = rows["lo"].astype(np.uint64) | rows["hi"].astype(np.uint64) << np.uint64(32)
    order = np.lexsort((rows["sid"], key))
    rows, key = rows[order], key[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (rows["sid"][1:] != rows["sid"][:-1])
    return rows[fresh], key[fresh]


def _tile_frame(rows, key):
    return pa.RecordBatch.from_pydict({"key": pa.array(key.astype(np.int64)), "sid": pa.array(rows["sid"].view(np.int64)),
                                       "n": pa.array(rows["n"].astype(np.int32))})


def _tiles(batches):
    """Rows of tiles with two nodes at least; a task holds the rows of its buckets only."""
    cold = []
    for b in batches:
        kinds, blobs = b.column("kind").to_pylist(), b.column("rows")
        warm = [x.as_buffer() for x, k in zip(blobs, kinds, strict=True) if k]
        cold += [np.frombuffer(x.as_py(), _ROW) for x, k in zip(blobs, kinds, strict=True) if not k]
        if warm:
            yield _tile_frame(*_tile_batch(np.concatenate([np.frombuffer(x, _ROW) for x in warm])))
    if cold:
        rows, key = _tile_batch(np.concatenate(cold))
        same = key[1:] == key[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        rows, key = rows[keep], key[keep]
        for i in range(0, len(rows), 100_000):
            yield _tile_frame(rows[i:i + 100_000], key[i:i + 100_000])


_NODES = "sid long, rep long, n long, bits binary, text string"


def _with_bits(batches):
    for b, offsets, raw in _read(batches):
        n, bits = [], []
        for _, _, sizes, flat in shingle_sets(offsets, raw):
            n.append(sizes)
            ends = np.cumsum(sizes)
            bits += [parity_bits(flat[e - k:e]) for k, e in zip(sizes, ends, strict=True)]
        yield pa.RecordBatch.from_pydict({
            "sid": b.column("sid").cast(pa.int64()), "rep": b.column("rep").cast(pa.int64()),
            "n": pa.array(np.concatenate(n) if n else [], pa.int64()), "bits": pa.array(bits, pa.binary()),
            "text": b.column("text").cast(pa.string())})


def _set_digests(batches):
    """Every row with the digest of its text's set (empty without words)."""
    for b, offsets, raw in _read(batches):
        dig = [d for _, _, sizes, flat in shingle_sets(offsets, raw) for d in _digests(sizes, flat)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dig, pa.binary())], [*b.schema.names, "dig"])


class _Bits:
    """Bitmaps of many nodes in one flat array of 64-bit words."""

    def __init__(self, column):
        blobs = column.to_pylist()
        self.width = np.array([len(x) // 8 for x in blobs], np.int64)
        self.start = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(blobs), "<u8")

    def take(self, rows, width):
        own, out = self.width[rows], np.empty((len(rows), width), np.uint64)
        for w in np.unique(own):
            sel = own == w
            block = self.flat[self.start[rows[sel]][:, None] + np.arange(w)]
            while block.shape[1] > width:
                half = block.shape[1] // 2
                block = block[:, :half] ^ block[:, half:]
            out[sel] = block
        return out

    def differ(self, i, j):
        """Bits that differ between the bitmaps of rows i and j: at most the elements in which the sets differ."""
        width, out = np.minimum(self.width[i], self.width[j]), np.zeros(len(i), np.int64)
        for w in np.unique(width):
            sel = np.flatnonzero(width == w)
            for k in range(0, len(sel), max(1, (1 << 20) // int(w))):
                s = sel[k:k + max(1, (1 << 20) // int(w))]
                out[s] = np.bitwise_count(self.take(i[s], w) ^ self.take(j[s], w)).sum(1, dtype=np.int64)
        return out

    def may_link(self, i, j, n):
        """Pairs whose overlap, bounded from above by bit counts, can reach 0.8 of the union."""
        return 9 * self.differ(i, j) <= n[i] + n[j]


def _pairs_of_groups(sizes):
    """Index pairs i < j within consecutive groups of the given sizes, a bounded number at a time."""
    start = np.cumsum(sizes) - sizes
    for m in np.unique(sizes[sizes > 1]):
        groups = start[sizes == m]
        step = max(1, 500_000 // int(m * m))
        for k in range(0, len(groups), step):
            for i0 in range(0, int(m) - 1, 128):
                i = np.arange(i0, min(i0 + 128, int(m) - 1))
                a = np.repeat(i, int(m) - 1 - i)
                b = np.concatenate([np.arange(x + 1, int(m)) for x in i])
                g = groups[k:k + step, None]
                yield (g + a).ravel(), (g + b).ravel()


_PAIR = "a long, b long"


def _search(t: pa.Table, nearest: bool):
    """Pairs of whole tile blocks that are in different groups, in one size band, and pass the bit bound.

    All pairs (a, b), or with ``nearest`` (key, a, b) with one b for every a that has any.
    """
    lo, hi, rep, label, n, block = (t.column(c).to_numpy() for c in ("lo", "hi", "rep", "label", "n", "block"))
    key = np.stack([t.column("key").to_numpy(), lo, hi])
    first = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
    bits = _Bits(t.column("bits"))
    best = np.full(t.num_rows, np.iinfo(np.int64).max)
    mate = np.full(t.num_rows, -1)
    for i, j in _pairs_of_groups(np.diff(np.r_[first, t.num_rows])):
        near = (label[i] != label[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
        near &= (lo[i] == hi[i]) | (block[i] != block[j])
        i, j = i[near], j[near]
        differ = bits.differ(i, j)
        ok = 9 * differ <= n[i] + n[j]
        i, j, differ = i[ok], j[ok], differ[ok]
        if not nearest:
            yield rep[i], rep[j]
            continue
        for x, y in ((i, j), (j, i)):
            order = np.lexsort((differ, x))
            x, y, d = x[order], y[order], differ[order]
            head = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else []
            better = d[head] < best[x[head]] if len(x) else []
            best[x[head][better]], mate[x[head][better]] = d[head][better], y[head][better]
    if nearest:
        has = np.flatnonzero(mate >= 0)
        yield key[0][has], rep[has], rep[mate[has]]


def _whole_groups(batches, names):
    """Tables of whole groups of rows that are equal in ``names``, by which they come sorted; a group that two batches share
    is held back for the next."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
        if not t.num_rows:
            continue
        same = np.logical_and.reduce([t.column(c).to_numpy() == t.column(c)[-1].as_py() for c in names])
        cut = int(np.argmax(same))
        rest = t.slice(cut)
        if cut:
            yield t.slice(0, cut)
    if rest is not None and rest.num_rows:
        yield rest


def _compare_tiles(nearest: bool):
    """The pairs of tile blocks, which come sorted."""
    def go(batches):
        done = set()

        def pairs(t):
            if nearest:
                for k, a, b in _search(t.combine_chunks(), True):
                    yield pa.RecordBatch.from_pydict({"key": pa.array(k), "a": pa.array(a), "b": pa.array(b)})
                return
            for x, y in _search(t.combine_chunks(), False):
                found = set(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True)) - done
                if len(done) > REMEMBERED_PAIRS:
                    done.clear()
                done.update(found)
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for t in _whole_groups(batches, ("key", "lo", "hi")):
            yield from pairs(t)
    return go


def _exact(batches):
    """Pairs with 100 * intersection >= 80 * union, on sorted arrays of both texts."""
    for b in (x.slice(k, 1000) for x in batches for k in range(0, x.num_rows, 1000)):
        sets = []
        for c in ("text_a", "text_b"):
            offsets, raw = text_buffers(b.column(c))
            own = []
            for _, _, sizes, flat in shingle_sets(offsets, raw):
                own += np.split(flat, np.cumsum(sizes)[:-1])
            sets.append(own)
        ok = []
        for x, y in zip(*sets, strict=True):
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            ok.append(100 * common >= 80 * (len(both) - common) > 0)
        yield pa.RecordBatch.from_arrays([b.column("a").cast(pa.int64()), b.column("b").cast(pa.int64())], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _bound(batches):
    for b in batches:
        both = _Bits(pa.concat_arrays([b.column("bits_a"), b.column("bits_b")]))
        m = b.num_rows
        n = np.concatenate([b.column("n_a").to_numpy(), b.column("n_b").to_numpy()])
        ok = both.may_link(np.arange(m), np.arange(m) + m, n)
        yield pa.RecordBatch.from_arrays([b.column("a").cast(pa.int64()), b.column("b").cast(pa.int64())], ["a", "b"]).filter(pa.array(ok))


def _verify(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: texts of both sides meet by two joins on the representative, by which nodes are bucketed,
    so that only texts of pairs move."""
    def side(s, col):
        return nodes.select(F.col("rep").alias(s), F.col(col).alias(f"{col}_{s}"))
    both = pairs.join(side("a", "text"), "a").join(side("b", "text"), "b").select("a", "b", "text_a", "text_b")
    return stored(sized(both, pairs.count(), TEXT_PAIRS).mapInArrow(lean(_exact), _PAIR), "links")


_LINKED = "node long, n_links long, others array<long>"


def _links_of_blocks(batches):
    """All links of pairs of a component's blocks, packed by node: documents linked with, and partners, each link at one end."""
    for t in _whole_groups(batches, ("label", "lo", "hi")):
        lo, hi, block, rep, copies, n = (t.column(c).to_numpy() for c in ("lo", "hi", "block", "rep", "copies", "n"))
        key = np.stack([t.column("label").to_numpy(), lo, hi])
        first = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
        bits = _Bits(t.column("bits"))
        flat = np.concatenate([x for *_, x in shingle_sets(*text_buffers(t.column("text").combine_chunks()))])
        start = np.r_[0, np.cumsum(n)]
        count, others = np.zeros(t.num_rows, np.int64), [np.zeros(0, np.int64)] * t.num_rows
        for s, e in zip(first.tolist(), [*first[1:].tolist(), t.num_rows], strict=True):
            values, ids = np.unique(flat[start[s]:start[e]], return_inverse=True)
            at, mark = start[s:e + 1] - start[s], np.zeros(len(values), np.int64)
            for i in range(s, e) if lo[s] == hi[s] else s + np.flatnonzero(block[s:e] == lo[s]):
                j = np.arange(i + 1, e) if lo[s] == hi[s] else s + np.flatnonzero(block[s:e] == hi[s])
                j = j[5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])]
                j = j[bits.may_link(np.full(len(j), i), j, n)]
                if not len(j):
                    continue
                own = ids[at[i - s]:at[i - s + 1]]
                mark[own] = 1
                theirs = mark[np.concatenate([ids[at[k - s]:at[k - s + 1]] for k in j])]
                mark[own] = 0
                common = np.add.reduceat(theirs, np.cumsum(n[j]) - n[j])
                j = j[100 * common >= 80 * (n[i] + n[j] - common)]
                others[i] = rep[j]
                count[i] += copies[j].sum()
                count[j] += copies[i]
        has = np.flatnonzero(count)
        ends = np.cumsum([0, *(len(others[k]) for k in has)])
        partners = np.concatenate([others[k] for k in has]) if len(has) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_pydict({"node": pa.array(rep[has]), "n_links": pa.array(count[has]),
                                          "others": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(partners))})


def _all_links(labels: DataFrame, copies: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n_links, others) of all links inside the components (node, label); copies: (rep, copies)."""
    members = stored(labels.withColumnRenamed("node", "rep").join(nodes.select("rep", "n"), "rep").join(copies, "rep"), "linked-nodes")
    cut = members.groupBy("label").agg(F.expr(f"cast(ceil(greatest(count(*) / {LINK_BLOCK}, sum(n) / {LINK_SHINGLES})) as int)").alias("blocks"))
    rows = (members.join(stored(cut, "linked-blocks"), "label").withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
            .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            .select("label", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "copies"))
    full = rows.join(nodes.select("rep", "n", "bits", "text"), "rep")
    spread = full.repartition("label", "lo", "hi").sortWithinPartitions("label", "lo", "hi")
    return stored(spread.select("label", "lo", "hi", "block", "rep", "copies", "n", "bits", "text").mapInArrow(lean(_links_of_blocks), _LINKED), "linked")


def _star_pairs(tiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node with the smallest node of each of its tiles, if the size band and the bit bound allow a link."""
    hubs = stored(tiles.groupBy("key").agg(F.min(F.struct("sid", "n")).alias("m"), F.max("sid").alias("x"))
                  .where("m.sid != x").select("key", F.col("m.sid").alias("hub"), F.col("m.n").alias("hub_n")), "hubs")
    near = stored(tiles.join(hubs, "key").where("sid != hub and 5 * least(n, hub_n) >= 4 * greatest(n, hub_n)")
                  .select("sid", "hub").distinct(), "star-mates")
    def side(s, sid):
        return nodes.select(F.col("sid").alias(sid), F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    pairs = near.join(side("a", "sid"), "sid").join(side("b", "hub"), "hub").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return stored(sized(pairs, near.count(), BIT_ROWS).mapInArrow(lean(_bound), _PAIR), "star")


def _mixed(rows: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, rep, label, blocks) of the tiles that hold nodes of two groups at least; rows: (key, rep)."""
    size = rows.count()
    group = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"))
    placed = stored(sized(rows.join(group, "rep"), size, SMALL_ROWS), "placed")
    mixed = (placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c"))
             .where("x != y").select("key", F.expr(f"cast(ceil(c / {BLOCK}) as int)").alias("blocks")))
    return stored(sized(placed.join(mixed, "key").select("key", "rep", "label", "blocks"), size, SMALL_ROWS), "tiles-mixed")


def _cross_pairs(mixed: DataFrame, nodes: DataFrame, nearest: bool) -> DataFrame:
    """Pairs (a, b) of tile mates in different groups that may link; with ``nearest`` (key, a, b): of each node its nearest
    by bitmap. What has no such mate has none in a later round either, as groups only grow."""
    rows = (mixed.withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
            .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            .select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "label"))
    full = rows.join(nodes.select("rep", "n", "bits"), "rep")
    spread = full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").select("key", "lo", "hi", "block", "rep", "label", "n", "bits")
    size = mixed.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    found = sized(spread, size, BIT_ROWS).mapInArrow(lean(_compare_tiles(nearest)), f"key long, {_PAIR}" if nearest else _PAIR)
    return stored(sized(found.distinct(), size, SMALL_ROWS), "cross")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", links: bool = True) -> Join:
    """Components and links of the documents at a Jaccard similarity of 0.8 on five-word shingles.

    Without ``links`` only the components are whole, for those who need nothing else.
    """
    with arrow_batches(docs.sparkSession, BATCH):
        return _join(docs, id_col, text_col, links)


def _join(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> Join:
    spark = docs.sparkSession
    source = with_text(docs, id_col, text_col)
    described = stored(source.mapInArrow(lean(_describe), _SETS), "sets")
    own = described.where("hot is null")
    odd = stored(own.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 or doc_id is null").select("doc_id"), "odd-ids")
    odd = None if odd.isEmpty() else odd
    reps = own.where("n > 0").groupBy("dig").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    if odd is None:
        reps = stored(reps.select("*", F.lit(False).alias("odd"), F.col("first").alias("rep")), "reps")
    else:
        reps = reps.join(odd.select(F.col("doc_id").alias("own"), F.lit(True).alias("odd")), F.col("first").eqNullSafe(F.col("own")), "left").drop("own")
        node = F.when(F.col("odd"), F.xxhash64("first", "dig")).otherwise(F.col("first"))
        reps = stored(reps.select("dig", "first", "copies", F.coalesce("odd", F.lit(False)).alias("odd"), node.alias("rep")), "reps")
    sets = own.join(reps, "dig", "left").select("doc_id", F.col("n").alias("n_shingles"), "dig", "rep", "first", F.coalesce("copies", F.lit(1)).alias("copies"))

    total = own.agg(F.count("*").alias("docs"), F.coalesce(F.sum("prefix"), F.lit(0)).alias("rows")).first()
    tasks = max(spark.sparkContext.defaultParallelism, total.rows // ROWS_PER_TASK + 1)
    frequent = (described.where("hot is not null").groupBy("hot").agg(F.sum("times").alias("times"))
                .where(F.col("times") >= max(16, total.docs // HOT_SHARE)).orderBy(F.desc("times"), "hot").limit(HOT_KEYS).toPandas())
    frequent["rank"] = np.arange(len(frequent), 0, -1)
    frequent = frequent.sort_values("hot")
    hot = spark.sparkContext.broadcast((frequent["hot"].to_numpy(np.uint64), frequent["rank"].to_numpy(np.int64)))
    packed = source.mapInArrow(lean(_prefixes(hot, 8 * tasks)), "bucket long, kind int, rows binary")
    tiles = stored(packed.repartition(tasks, "bucket").mapInArrow(lean(_tiles), _TILE), "tiles")

    wanted = reps.select("rep", "first", "odd", _sid_column("dig").alias("sid")).join(tiles.select("sid").distinct(), "sid")
    texts = source.join(wanted.where("not odd").select(F.col("first").alias("doc_id"), "rep", "sid"), "doc_id").select("rep", "sid", "text")
    if odd is not None:
        # ids that say too little: one text of each set, by the set itself
        theirs = source.join(odd.withColumnRenamed("doc_id", "own"), F.col("doc_id").eqNullSafe(F.col("own")), "left_semi")
        theirs = theirs.mapInArrow(lean(_set_digests), "doc_id long, text string, dig binary").select(_sid_column("dig").alias("sid"), "text").dropDuplicates(["sid"])
        texts = texts.unionByName(theirs.join(wanted.where("odd").select("rep", "sid"), "sid").select("rep", "sid", "text"))
    nodes = bucketed(texts.mapInArrow(lean(_with_bits), _NODES), "nodes", "rep")

    links = _verify(_star_pairs(tiles, nodes), nodes)
    labels = stored(components(links), "groups")
    rows = stored(tiles.join(nodes.select("sid", "rep"), "sid").select("key", "rep").distinct(), "tile-nodes")
    for nearest in (True, True, False):
        mixed = _mixed(rows, nodes.select("rep"), labels)
        found = _cross_pairs(mixed, nodes, nearest)
        size = found.count()
        rows = stored(sized(found.select("key", F.col("a").alias("rep")).distinct(), size, SMALL_ROWS), "tile-nodes") if nearest else None
        pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = _verify(stored(sized(pairs, size, SMALL_ROWS), "pairs"), nodes)
        if not more.isEmpty():
            links = links.union(more)
            labels = stored(merged(labels, more), "groups")
    if not whole:
        return Join(sets, links, labels, odd=odd)
    packed = _all_links(labels, reps.select("rep", "copies"), nodes)
    pairs = packed.select("node", F.explode("others").alias("other")).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    return Join(sets, pairs, labels, packed.groupBy("node").agg(F.sum("n_links").alias("n_links")), odd)


def _sid_column(dig: str):
    """The first eight bytes of a digest as a little-endian long."""
    h = F.hex(F.substring(dig, 1, 8))
    swapped = F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(8)])
    high, low = F.conv(F.substring(swapped, 1, 8), 16, 10).cast("long"), F.conv(F.substring(swapped, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def _members(join: Join) -> DataFrame:
    """doc_id, n_shingles, dig, rep, copies, grp (the component's label, null for empty sets), component_id of every document."""
    labels = join.components.select(F.col("node").alias("rep"), "label")
    members = join.sets.join(labels, "rep", "left").withColumn("grp", F.coalesce("label", "rep"))
    if join.odd is None:
        return members.withColumn("component_id", F.coalesce("label", "first", "doc_id"))
    members = stored(members, "members-odd")
    name = members.where("grp is not null").groupBy(F.col("grp").alias("of")).agg(F.min("first").alias("name"))
    return (members.join(name, F.col("grp") == F.col("of"), "left")
            .withColumn("component_id", F.when(F.col("grp").isNull(), F.col("doc_id")).otherwise(F.col("name"))))


def component_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) of every document; ``links`` as for the join."""
    return _members(ngram_join(docs, id_col, text_col, links)).select("doc_id", "n_shingles", "component_id")


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``component_ids``, and n_links: the other documents that a document links with, those of an equal set included."""
    join = ngram_join(docs, id_col, text_col)
    own = join.linked.withColumnRenamed("node", "rep")
    others = F.when(F.col("n_shingles") > 0, F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).otherwise(0)
    return stored(_members(join), "members").join(own, "rep", "left").select("doc_id", "n_shingles", "component_id", others.alias("n_links"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for near copies: of each component the row of smallest id stays, of rows that share it the one of
    the smallest set digest, of equal sets any one; rows without words all stay."""
    spark = docs.sparkSession
    with scratch(spark):
        join = ngram_join(docs, id_col, text_col, links=False)
        members = stored(_members(join).select("doc_id", "dig", "grp", "component_id"), "members")
        # a component without an id has null ones only, which are odd
        gone = stored(members.where("doc_id != component_id or (doc_id is not null and component_id is null)").select(F.col("doc_id").alias("gone")).distinct(), "gone", lasting=True)
        if join.odd is not None:
            odd = stored(join.odd.select(F.col("doc_id").alias("odd")), "odd", lasting=True)
            first = members.where("grp is not null and doc_id <=> component_id").groupBy("grp").agg(F.first("doc_id").alias("own"), F.min("dig").alias("own_dig"))
            first = stored(first.join(odd, F.col("own").eqNullSafe(F.col("odd")), "left_semi").select("own", "own_dig"), "first", lasting=True)
    key = docs[id_col].cast("long")
    if join.odd is None:
        return docs.join(gone, key == gone["gone"], "left_anti")
    plain = docs.join(odd, key.eqNullSafe(odd["odd"]), "left_anti").join(gone, key == gone["gone"], "left_anti")
    rows = docs.join(odd, key.eqNullSafe(odd["odd"]), "left_semi")
    rows = rows.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), key.alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = rows.mapInArrow(lean(_set_digests), StructType([*rows.schema.fields, StructField("dig", BinaryType())]))
    blank = rows.where(F.length("dig") == 0)
    kept = rows.join(first, rows["doc_id"].eqNullSafe(first["own"]) & (rows["dig"] == first["own_dig"]), "left_semi").dropDuplicates(["doc_id", "dig"])
    return plain.unionByName(blank.unionByName(kept).select("row.*"))
