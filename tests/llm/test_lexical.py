import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tabulon.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def brute(docs, items, k=20):
    counts = [(i, c) for i, t in docs if (c := Counter(terms(t)))]
    size, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    wanted = {}
    for i, t in set(items):
        wanted.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in wanted.items():
        rows = []
        for d, c in counts:
            m = 75 + (25 * sum(c.values()) * size) // total
            s = sum(n * math.floor(1000 * math.log((2 * size + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, n in q.items() if w in c)
            if s:
                rows.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=20):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as rank", "'x' as item_id", "0L as n").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' as score")
    return sorted((tuple(r) for r in lexical.search(d, i, k).collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(lexical, "ITEMS", 3)
        monkeypatch.setattr(lexical, "COLUMNS", 4)
        monkeypatch.setattr(lexical, "ROUND_PAIRS", 40)
        monkeypatch.setattr(lexical, "EXACT", 2 * 10**10)
        monkeypatch.setattr(lexical, "SLICES", 2)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)] + ["Été", "été", "naïve9", "X"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", ", ", "\n", "_", "\x00"]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 12))) for k in range(150)]
    docs += [(1000 + k, "w1 w2 tie") for k in range(30)] + [(None, "w1 w2 tie"), (1000, "w1 w2 tie"), (7, None), (8, ""), (9, " .,"), (5000, text(4000))]
    items = [(k, text(rng.randint(0, 8))) for k in range(12)] + [(50, "TIE"), (50, "TIE"), (50, "w1"), (None, "w1 w1 w3"), (51, None), (52, "nowhere"), (53, "w2 " * 3000), (2**60 + 1, "w4")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, 3) == brute(docs, items, 3)


def test_tiles_stay_exact():
    weight = np.array([20_000, 3, 25_000])
    at, term, times = np.array([0, 1, 0, 1]), np.array([0, 0, 1, 2]), np.array([10**6, 5, 7, 1])
    got = lexical.tiles(at, term, times, weight)
    assert len(got) > 2
    total = Counter()
    for t in got:
        dense = t.weights(2)
        assert (dense.sum(0) * lexical.GREATEST_IMPACT <= 2**53).all() and (np.diff(t.columns) > 0).all()
        total.update({(i, t.columns[c]): v for c in range(len(t.columns)) for i, v in enumerate(dense[c].tolist()) if v})
    assert total == {(0, 0): 20_000 * 10**6, (1, 0): 100_000, (0, 1): 21, (1, 2): 25_000}


def test_wide_lengths_and_empty_tables(spark):
    n = np.array([10, 10**9])
    assert lexical.impacts(np.array([1, 5]), n, 10**12, 10**14).tolist() == [
        10**9 * t // (1000 * t + 12 * (75 + 25 * int(x) * 10**12 // 10**14)) for t, x in ((1, 10), (5, 10**9))]
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == [] and run(spark, [(1, None)], [(1, "a")]) == []
