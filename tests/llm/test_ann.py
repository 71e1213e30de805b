import numpy as np
import pytest

from tabulon.llm import ann


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[ids.index(q)]
        out[q] = sorted((-v, i) for v, i in zip(s.tolist(), ids, strict=True) if i != q)[:k]
    return out


def table(spark, ids, x):
    return spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int").repartition(4)


@pytest.mark.parametrize("nodes", [900, 250])
def test_recall_scores_and_order(spark, monkeypatch, nodes):
    monkeypatch.setattr(ann, "SHARD_NODES", nodes)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 60)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    x = (centres[rng.integers(0, 40, 3000)] + 0.5 * rng.normal(size=(3000, 24))).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    ids = list(range(3000))
    got = {}
    for r in ann.neighbours(table(spark, ids, x), 20, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(ids, x.astype(float), range(0, 3000, 20), 20)
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21)) and [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        assert np.allclose([s for _, _, s in rows], [float(x[q].astype(float) @ x[i].astype(float)) for _, i, _ in rows], rtol=1e-12)
        hits += len({i for _, i, _ in rows} & {i for _, i in want[q]})
    assert hits / (20 * len(want)) >= 0.95


def test_many_equal_vectors_and_few_candidates(spark):
    x = np.array([[1.0, 0.0]] * 60 + [[0.5, 0.5]] * 3, np.float32)
    ids = list(range(63))
    got = {}
    for r in ann.neighbours(table(spark, ids, x), 20, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = brute(ids, x.astype(float), (0, 20, 40, 60), 20)
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    few = ann.neighbours(table(spark, [0, 1, 2], x[-3:]), 20, 1).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in few) == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 0), (2, 2, 1)]


def test_unusable_vectors_and_empty_table(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [3.0]), (7, [2.0, 1.0]), (7, [2.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as shard", "2 as vec")
    assert [tuple(r) for r in ann.neighbours(df, 20, 20).collect()] == [(0, 1, 7, 4.0), (0, 2, 6, 3.0)]
    assert ann.neighbours(df.where("false"), 20, 20).count() == 0


def test_shards_are_bounded_in_number_and_size():
    assert [ann.shard_count(n, 64) for n in (0, 1, 4096, 4097, 64 * 4096, 10**7)] == [1, 1, 1, 2, 64, 64]
    assert ann.shard_count(10**9, 64) * ann.SHARD_BYTES >= 10**9 * (12 * 64 + 8 * ann.DEGREE + 200)
