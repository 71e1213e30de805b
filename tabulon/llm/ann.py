"""Approximate nearest neighbours by inner product on robust-pruned directed graphs.

Equal vectors are one node. Nodes are dealt by hash to shards, 64 at most until
a shard fills a task's memory (some 20 million nodes of 64 components), so the
rows that are repeated by shard are in proportion to the table; each shard's nodes are joined one batch after the other into a directed
graph: a greedy beam search proposes neighbours, relaxed distance pruning keeps
the near ones that no kept one covers by a factor ALPHA, and links back are
pruned the same way. Inner product becomes distance by one more component that
gives all vectors the largest norm. Queries go to every shard in blocks; a beam
search finds candidates, whose exact scores in double precision are merged.

The index covers every vector and is a table (one row per node), so a lost task
builds or searches its shard again.

Defined cases: vectors that are null, zero or hold null or non-finite components
take no part; shorter ones count as filled up with zeros at their end; ties go to the smaller id; a
vector's equals are candidates of each other; rows that repeat an id and vector
are one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.shared import reachable, stored

#: A shard holds a SHARDS-th of the nodes, SHARD_NODES at least and at most what SHARD_BYTES hold in a task; queries of a block.
SHARD_NODES, SHARDS, SHARD_BYTES, QUERY_BLOCK = 4096, 64, 256_000_000, 32_768
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 48, 64, 1.2
_LANES = 512


def beam_search(x, links, start, queries, width):
    """Greedy beam search for many queries at once.

    Returns (nodes, distances) of the nearest ``width`` found, -1 and inf where
    there are fewer.
    """
    n = len(queries)
    nodes = np.full((n, width), -1, np.int32)
    near = np.full((n, width), np.inf, np.float32)
    open_ = np.zeros((n, width), bool)
    nodes[:, 0], open_[:, 0] = start, True
    near[:, 0] = ((queries - x[start])**2).sum(1)
    act = np.arange(n)
    while len(act):
        rows = np.arange(len(act))
        at = open_[act].argmax(1)
        open_[act, at] = False
        nb = links[nodes[act, at]]
        seen = (nb[:, :, None] == nodes[act][:, None, :]).any(2) | (nb < 0)
        d = x[nb] - queries[act][:, None, :]
        d = np.einsum("ijk,ijk->ij", d, d)
        d[seen] = np.inf
        all_d = np.concatenate([near[act], d], 1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        all_n, all_o = np.concatenate([nodes[act], nb], 1), np.concatenate([open_[act], ~seen], 1)
        near[act], nodes[act] = all_d[rows[:, None], keep], all_n[rows[:, None], keep]
        open_[act] = all_o[rows[:, None], keep] & np.isfinite(near[act])
        nodes[act] = np.where(np.isfinite(near[act]), nodes[act], -1)
        act = act[open_[act].any(1)]
    return nodes, near


def robust_prune(x, points, cand, dist):
    """Neighbours of each point among its candidates (-1: none): the nearest, then those not covered by a kept one."""
    order = np.argsort(dist, axis=1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    alive = (cand >= 0) & np.isfinite(dist) & (cand != points[:, None])
    out = np.full((len(points), DEGREE), -1, np.int32)
    rows, vectors = np.arange(len(points)), x[cand]
    for k in range(DEGREE):
        some = alive.any(1)
        if not some.any():
            break
        at = alive.argmax(1)
        out[some, k] = cand[rows, at][some]
        d = vectors - vectors[rows, at][:, None, :]
        d = np.einsum("ijk,ijk->ij", d, d)
        alive &= ~(ALPHA**2 * d <= dist) & some[:, None]
        alive[rows, at] = False
    return out


def build_graph(x: np.ndarray) -> tuple[np.ndarray, int]:
    """(links, start) of a shard: nodes join in batches that double up to ``_LANES``."""
    n = len(x)
    links = np.full((n, DEGREE), -1, np.int32)
    start = int(((x - x.mean(0))**2).sum(1).argmin())
    order = np.random.default_rng(n).permutation(n)
    order = np.r_[start, order[order != start]].astype(np.int32)
    k = 1
    while k < n:
        batch = order[k:k + min(k, _LANES)]
        cand, dist = beam_search(x, links, start, x[batch], BUILD_BEAM)
        links[batch] = robust_prune(x, batch, cand, dist)
        to = links[batch]
        own = np.repeat(batch, DEGREE)[to.ravel() >= 0]
        to = to.ravel()[to.ravel() >= 0]
        by = np.argsort(to, kind="stable")
        to, own = to[by], own[by]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        size = np.diff(np.r_[first, len(to)])
        target = to[first]
        width = int(size.max())
        fresh = np.full((len(target), width), -1, np.int32)
        fresh[np.repeat(np.arange(len(target)), size), np.arange(len(to)) - np.repeat(first, size)] = own
        for s in range(0, len(target), _LANES):
            t = target[s:s + _LANES]
            both = np.concatenate([links[t], fresh[s:s + _LANES]], 1)
            twice = (both[:, :, None] == both[:, None, :]) & (np.arange(both.shape[1])[:, None] > np.arange(both.shape[1])[None, :])
            both[twice.any(2)] = -1
            count = (both >= 0).sum(1)
            few = count <= DEGREE
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
            links[t[few]] = packed[few, :DEGREE]
            if (~few).any():
                p, c = t[~few], packed[~few, :int(count.max())]
                d = x[c] - x[p][:, None, :]
                d = np.where(c >= 0, np.einsum("ijk,ijk->ij", d, d), np.inf)
                links[p] = robust_prune(x, p, c, d)
        k += len(batch)
    return links, start


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    reachable(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    v = v.where("vec_id is not null and vec is not null and forall(vec, x -> x is not null and abs(x) < double('inf'))"
                " and exists(vec, x -> x != 0)")
    longest = v.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0]
    return v.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), longest - F.size("vec")))).distinct()


def shard_count(nodes: int, components: int) -> int:
    """How many shards: see SHARDS."""
    most = max(1, SHARD_BYTES // (12 * components + 8 * DEGREE + 200))
    return max(1, -(-nodes // max(1, min(most, max(SHARD_NODES, -(-nodes // SHARDS))))))


_INDEX = "shard int, node int, vec array<double>, ids array<long>, links array<int>, start int, top double"


def build(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The index: a row per distinct vector with its links in its shard, and the k + 1 smallest ids that have it."""
    usable = _usable(vectors, id_col, vec_col)
    smallest = Window.partitionBy("vec").orderBy("vec_id")
    nodes = stored(usable.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
                   .groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    facts = nodes.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d"), F.max(F.expr("aggregate(vec, 0D, (a, x) -> a + x * x)")).alias("top")).first()
    shards = shard_count(facts.n, facts.d or 0)
    top = float(facts.top or 0.0)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        links, start = build_graph(_lifted(np.stack(pdf["vec"].to_numpy()), top))
        return pd.DataFrame({"shard": pdf["shard"], "node": np.arange(len(pdf)), "vec": pdf["vec"], "ids": pdf["ids"],
                             "links": list(links), "start": start, "top": top})

    dealt = nodes.withColumn("shard", F.expr(f"cast(pmod(xxhash64(vec), {shards}) as int)"))
    return stored(dealt.groupBy("shard").applyInPandas(link, _INDEX), "ann-index")


def _lifted(vecs, top):
    """float32 vectors with a component that lifts each to the largest norm."""
    rest = np.sqrt(np.maximum(top - (vecs * vecs).sum(1), 0))
    return np.c_[vecs, rest].astype(np.float32)


def _search(k, beam):
    def go(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            index = index.sort_values("node")
            vecs, q = np.stack(index["vec"].to_numpy()), np.stack(queries["vec"].to_numpy())
            x, links = _lifted(vecs, float(index["top"].iloc[0])), np.stack(index["links"].to_numpy())
            ids, start = index["ids"].to_numpy(), int(index["start"].iloc[0])
            for s in range(0, len(q), _LANES):
                part = q[s:s + _LANES]
                found, _ = beam_search(x, links, start, np.c_[part, np.zeros(len(part))].astype(np.float32), max(beam, k + 1))
                score = np.einsum("ijk,ik->ij", vecs[found], part)
                for own, row, value in zip(queries["query_id"].iloc[s:s + _LANES], found, score, strict=True):
                    pairs = [(-v, int(i)) for node, v in zip(row, value, strict=True) if node >= 0 for i in ids[node] if i != own]
                    out += [(own, i, -v) for v, i in sorted(pairs)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return go


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (query_id, vec) in all shards, itself left out."""
    shards = index.select("shard").distinct().count()
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    tiles = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = (queries.withColumn("block", F.expr(f"cast(pmod(xxhash64(query_id), {blocks}) as int)"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(shards, 1) - 1)))))
    found = (tiles.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
             .applyInPandas(_search(k, beam), "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def neighbours(vectors: DataFrame, k: int, every: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest found of every vector whose id is divisible by ``every``, among all others."""
    index = build(vectors, k, id_col, vec_col)
    queries = _usable(vectors, id_col, vec_col).where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    return search(index, queries, k)
