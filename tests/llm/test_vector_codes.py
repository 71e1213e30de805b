import hashlib

import numpy as np
import pytest

from tabulon.llm import vector_codes as V


def nearest(parts, book):
    return [min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(x, book[e], strict=True)), e)) for x in parts]


def brute(rows, rounds=4):
    """rows: (vec_id, integer vector, label); plain integers throughout."""
    width = len(rows[0][1]) // 4
    parts = [[r[1][p * width:(p + 1) * width] for r in rows] for p in range(4)]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0], rows[k][1]))[:256]
    books = [[parts[p][k] for k in first] for p in range(4)]
    for _ in range(rounds):
        for p in range(4):
            at = nearest(parts[p], books[p])
            for e in set(at):
                own = [x for x, a in zip(parts[p], at, strict=True) if a == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    at = [nearest(parts[p], books[p]) for p in range(4)]
    error = [sum(sum((a - b) ** 2 for a, b in zip(parts[p][k], books[p][at[p][k]], strict=True)) for p in range(4)) for k in range(len(rows))]
    total = {}
    for r, e in zip(rows, error, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for x in b for v in x).encode()).hexdigest()
    return sorted((r[0], "".join(f"{at[p][k]:02x}" for p in range(4)), error[k], total[r[2]], sha) for k, r in enumerate(rows))


@pytest.mark.parametrize("kind", ["clusters", "grid", "few"])
def test_equals_plain_lloyd(spark, kind):
    rng = np.random.default_rng(3)
    n = {"clusters": 700, "grid": 600, "few": 37}[kind]
    if kind == "clusters":  # far apart, so that whole nodes are assigned
        x = rng.integers(-9, 9, (12, 12))[rng.integers(0, 12, n)] * 50.0 + rng.normal(size=(n, 12))
    else:  # many equal distances
        x = rng.integers(-2, 3, (n, 12)) / 1024
    label = [None if k % 5 == 0 else int(k % 3) for k in range(n)]
    ids = rng.permutation(n).tolist()
    df = spark.createDataFrame([(i, [float(v) for v in r], y) for i, r, y in zip(ids, x, label, strict=True)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(tuple(r) for r in V.codes(df.selectExpr("*", "'c' as code", "1 as error")).collect())
    assert got == brute([(i, np.floor(1024 * r).astype(int).tolist(), y) for i, r, y in zip(ids, x, label, strict=True)])


def test_walk_settles_nodes_and_ties():
    rng = np.random.default_rng(4)
    for n, m, spread in ((1, 1, 5), (5, 3, 2), (500, 256, 3), (3000, 200, 40), (4096, 256, 10**8)):
        points, book = rng.integers(-spread, spread, (n, 6)), rng.integers(-spread, spread, (m, 6))
        book[m // 2] = book[0]
        points = points[V.tree_order(points, V.LEAF)]
        ranges, spots, codes = V.assign(V.Tree(points, V.LEAF), V.Entries(book))
        own = np.full(n, -1)
        own[spots] = codes
        for s, t, e in ranges.tolist():
            assert (own[s:t] == -1).all()
            own[s:t] = e
        far = ((points[:, None, :] - book[None]) ** 2).sum(2)
        assert (own == far.argmin(1)).all()
    far_apart = np.repeat(rng.integers(-10**6, 10**6, (8, 6)), 64, 0) + rng.integers(0, 5, (512, 6))
    far_apart = far_apart[V.tree_order(far_apart, V.LEAF)]
    ranges, spots, _ = V.assign(V.Tree(far_apart, V.LEAF), V.Entries(far_apart[::64]))
    assert (ranges[:, 1] - ranges[:, 0]).sum() == 512 and not len(spots)


def test_unusable_short_wide_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, -0.0001, 2.0, 3.0], "a"), (2, [0.5], "a"), (2, [0.25], None), (3, None, "a"), (4, [None, 1.0], "a"), (5, [nan], "a"), (6, [-inf], "b"),
            (None, [], None), (8, [1e300, -1e300, 1e9, 0.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = V.codes(df).collect()
    assert sorted(((r.vec_id, r.code) for r in got), key=str) == [(1, "00000000"), (2, "01010100"), (2, "02010100"), (8, "03030100"), (None, "04010100")]
    assert {(r.error, r.label_error) for r in got} == {(0, 0)}
    assert V.integers([[0.5, 1.0, -0.0001], []], 4).tolist() == [[512, 1024, -1, 0], [0, 0, 0, 0]]
    assert V.integers([[1e300, -1e300]], 64)[0, :2].tolist() == [189812531, -189812531]
    assert V.codes(df.where("false")).count() == 0 and V.codes(df.where("vec_id = 3")).count() == 0
    wide = spark.createDataFrame([(k, [1e300 * (-1) ** k] * 64, 1) for k in range(300)], "vec_id long, embedding array<double>, label int")
    assert {r.error for r in V.codes(wide).collect()} == {0}
