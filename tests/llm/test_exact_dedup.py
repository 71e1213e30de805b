import random
from hashlib import sha256

from tabulon.llm.exact_dedup import exact_groups


def brute(rows):
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        own = by[t or ""]
        out.append((i, max(own), len(own), i == max(own), sha256((t or "").encode()).hexdigest()))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    texts = ["", "a", "A", "é", "x" * 40000, "x" * 40001, "ab" * 30000]
    texts += ["".join(r.choice("abcdefgh \n") for _ in range(r.choice([10, 300, 3000, 9000]))) for _ in range(40)]
    texts += [t + " tail" for t in texts[5:15]] + [t[:-1] for t in texts[5:15] if t]
    rows = [(i, r.choice(texts)) for i in range(300)]
    return rows + [(1000, None), (1001, "")]


def run(df, **k):
    return sorted(tuple(x) for x in exact_groups(df, **k).collect())


def test_matches_brute_force(spark):
    rows = corpus(3)
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_chunks_that_share_a_fingerprint_are_told_apart(spark):
    rows = corpus(4)
    weak = lambda chunk: bytes([len(chunk) % 3])
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), fingerprint=weak) == brute(rows)


def test_repeated_rows_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "t", "x", 3), (1, "t", "x", 3), (0, "t", None, None)], "doc_id long, text string, recipe string, n long")
    got = run(df)
    assert [g[:3] for g in got] == [(0, 1, 3), (1, 1, 3), (1, 1, 3)] and sorted(g[3] for g in got) == [False, False, True]
    assert run(df.where("false")) == []
