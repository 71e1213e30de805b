import random
import re
from collections import Counter

import numpy as np

from tabulon.llm import quality, toxicity
from tabulon.llm.toxicity import GAP, Landmarks


def brute_kernel(a, b):
    def grams(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + 5)):
                    g = w[i] + w[j] + w[k]
                    out[g] = out.get(g, 0) + GAP ** (k - i + 1)
        return out

    def norm(n):
        return sum(GAP ** (2 * (k - i + 1)) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + 5)))
    x, y = grams(a), grams(b)
    dot = sum(v * y.get(g, 0) for g, v in x.items())
    return dot / max(norm(len(a)) * norm(len(b)), 1e-24) ** 0.5 if dot else 0.0


def test_subsequence_kernel_matches_its_definition():
    marks, words = ["idiot", "loser", "banana"], ["idiot", "idxiot", "ido", "a", "", "lser", "bananas", "stone"]
    got = Landmarks(marks).kernel(words)
    assert np.allclose(got, [[brute_kernel(w, m) for m in marks] for w in words], atol=1e-5)
    assert got[1, 0] > 0.5 > got[7, 0]


def toxic_corpus(n=700):
    r = random.Random(3)
    vocab = ["".join(r.choice("bcdfghklmnprstv") + r.choice("aeiou") for _ in range(r.randrange(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(r.choice(vocab) for _ in range(r.randrange(3, 9))) + "." for _ in range(6)]
        bad = i % 3 == 0
        if bad:
            at = r.randrange(6)
            word = r.choice(["wretchx", "wretchy", "scoundrel", "scoundrels"])
            if r.random() < 0.3:
                word = word[:3] + "x" + word[3:]
            sentences[at] = f"{word} {sentences[at]}"
        docs.append((i, " ".join(sentences)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_machine_is_the_minimum_of_its_loss(spark):
    """Newton steps over the table against the squared-hinge loss on all sentences at once, moved in every direction."""
    rng = np.random.default_rng(8)
    docs = [(k % 2, rng.normal(size=(rng.integers(1, 5), 3)).astype(np.float32) + np.float32(0.8 * (k % 2))) for k in range(60)]
    rows = spark.createDataFrame([(y, x.tobytes()) for y, x in docs], "y int, x binary").repartition(3)

    def loss(w, chosen):
        total = [[], []]
        for y, x in docs:
            x = x.astype(float)
            if y and chosen is not None:
                d = x @ chosen[:-1] + chosen[-1]
                x = x[d >= d.max() - 1e-12]
            total[y] += np.maximum(0, 1 - (2 * y - 1) * (x @ w[:-1] + w[-1])).tolist()
        return (w[:-1] ** 2).sum() + 1e-6 * w[-1] ** 2 + (np.array(total[0]) ** 2).sum() + len(total[0]) / len(total[1]) * (np.array(total[1]) ** 2).sum()

    chosen = None
    for _ in range(3):
        w = toxicity.hinge(rows, 3, chosen)
        least = loss(w, chosen)
        assert all(loss(w + s * e, chosen) >= least - 1e-9 for e in np.eye(4) for s in (-0.05, -1e-3, 1e-3, 0.05))
        chosen = w


def test_calibration_withstands_outliers():
    rng = np.random.default_rng(9)
    m = np.r_[rng.normal(-1, 1, 900), rng.normal(1, 1, 100), 5000.0]
    a, b = toxicity._logistic(m, np.r_[np.zeros(900), np.ones(101)])
    p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
    assert 0.5 < a < 5 and p[:900].mean() < 0.25 < 0.5 < p[900:1000].mean()


def test_toxicity_held_out_accuracy(spark):
    docs, labels = toxic_corpus()
    extra = [(10_000, None), (10_001, ""), (10_002, "s c o u n d r e l you are"), (10_003, "wre-tch.x"), (10_004, "bada " * 30_000)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string").selectExpr("*", "1 as score", "2 as y")
    lab = spark.createDataFrame(labels + [(1, None, None), (99_999, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.classify(df, lab).collect()}
    assert len(out) == len(docs) + len(extra)
    held = [(out[i].predicted, t) for i, _, t in labels if out[i].held_out]
    assert len(held) > 100 and sum(p == t for p, t in held) >= 0.97 * len(held)
    assert out[10_000].score == out[10_001].score and out[10_000].predicted == 0 and out[10_004].predicted == 0
    assert out[10_002].predicted == 1 and out[10_003].predicted == 1


def test_without_labels_or_documents(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.classify(df, none).collect()] == [0, 0]
    assert [r.score for r in quality.classify(df, none).collect()] == [0.5, 0.5]
    assert toxicity.classify(df.where("false"), none).count() == 0 and quality.classify(df.where("false"), none).count() == 0


def brute_statistics(text):
    w = text.split()
    n = len(text.encode())
    return [np.log1p(n), np.log1p(len(w)), sum(len(x.encode()) for x in w) / len(w), len({x.encode().lower() for x in w}) / len(w)]


def test_statistics_match_their_definition():
    import pyarrow as pa
    texts = ["One two  two.\nOne two  two.\nX|9", "a", "Éa é É\n\n#b!"]
    got = quality._batch_statistics(pa.array([*texts, None, ""]))
    for t, row in zip(texts, got, strict=False):
        assert np.allclose([*row[:3], row[12]], brute_statistics(t))
    assert got.shape[1] == 25 and not got[3].any() and not got[4].any()
    assert got[0][17] == 2 / 3  # one of three lines is repeated


def test_quality_held_out_accuracy(spark):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        good = i % 2
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(20, 60))]
        docs.append((i, " ".join(words) + "." if good else " ".join(r.choice(words[:4]).upper() + "!!" for _ in words)))
        labels.append((i, good, 0))
    docs += [(9000, None), (9001, ""), (9002, "ab cd " * 40_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 as score", "0 as y")
    out = {x.doc_id: x for x in quality.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [(out[i].predicted, q) for i, q, _ in labels if out[i].held_out]
    assert len(out) == len(docs) and sum(p == q for p, q in held) >= 0.97 * len(held) and out[9000].score == out[9001].score


def all_statistics(text):
    """The 25 statistics of a text by their definitions, from its characters and words."""
    raw = text.encode()
    n, words = len(raw), [w for w in re.split(rb"[ \t-\r]+", raw) if w]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    lines = [x for x in ([w for w in re.split(rb"[ \t-\r]+", line.lower()) if w] for line in raw.split(b"\n")) if x]
    pairs = list(zip(low, low[1:], strict=False))
    share = lambda chars: sum(c in chars for c in raw) / n
    lower, upper = sum(97 <= c <= 122 for c in raw), sum(65 <= c <= 90 for c in raw)
    other = sum(c < 128 and not (chr(c).isalnum() or c in b" \t\r\x0b\x0c\n.!?,;:'\"-()|") for c in raw) / n
    w, top = len(words), lambda items: max(Counter(items).values(), default=0)
    stop = lambda x: sum(chr(v[-1]) in x for v in words) / w
    freq = [c / n for c in Counter(raw).values()]
    return [np.log1p(n), np.log1p(w), sum(map(len, words)) / w, upper / max(1, lower + upper), share(b"0123456789"), share(b" \t\r\x0b\x0c"), share(b"\n"), share(b".!?"),
            share(b",;:'\"-()"), share(b"|"), other, sum(c >= 128 for c in raw) / n, len(set(low)) / w, top(low) / w, len(set(pairs)) / max(1, w - 1), top(pairs) / w,
            len(lines) / w, len({tuple(x) for x in lines}) / max(1, len(lines)), np.log1p(max(map(len, words))), sum(len(x) <= 2 for x in words) / w,
            stop(".!?,;:'\"-()|") + sum(chr(v[-1]) not in ".!?,;:'\"-()|" and v[-1] < 128 and not chr(v[-1]).isalnum() for v in words) / w,
            sum(v[-1] < 128 and not chr(v[-1]).isalnum() and chr(v[-1]) not in ".!?,;:'\"-()|" for v in words) / w, stop(".!?"), sum(65 <= v[0] <= 90 for v in words) / w,
            -sum(p * np.log(p) for p in freq)]


def test_all_statistics_match_their_definitions():
    import pyarrow as pa
    r = random.Random(6)
    texts = ["".join(r.choice("aabcDEf 12 \n\t.!?,;-|#$éß日") for _ in range(r.randrange(1, 200))) for _ in range(60)]
    texts = [t for t in texts if t.split()]
    got = quality._batch_statistics(pa.array(texts))
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, all_statistics(t)), t


def test_grow_takes_the_best_split_and_its_newton_value():
    """One feature that tells the labels apart: the first tree's root splits there, and its leaves have the ridge Newton values."""
    x = np.c_[np.tile([0.0, 1.0], 200), np.arange(400.0)]
    y = (np.arange(400) >= 150).astype(float)
    trees = quality.grow(x, y)
    cut = trees.threshold[0, 0]
    share = y.mean()
    edges = np.unique(np.quantile(x[:, 1], np.arange(1, quality.BINS) / quality.BINS))
    g, h = y - share, np.full(400, share * (1 - share))
    gain = []
    for e in edges:
        left = x[:, 1] <= e
        gain.append(sum(g[s].sum() ** 2 / (h[s].sum() + quality.RIDGE) for s in (left, ~left)) if min(left.sum(), (~left).sum()) >= quality.LEAST else 0)
    assert trees.feature[0, 0] == 1 and cut == edges[int(np.argmax(gain))]
    at = np.zeros(400, np.int64)
    for _ in range(quality.DEPTH):
        at = 2 * at + 1 + (x[np.arange(400), trees.feature[0, at]] > trees.threshold[0, at])
    leaf = at - trees.feature.shape[1]
    for k in np.unique(leaf):
        own = leaf == k
        assert np.isclose(trees.leaf[0, k], quality.RATE * g[own].sum() / (h[own].sum() + quality.RIDGE))


def test_flat_trees_walk_as_nested_rules():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < 0)).astype(float)
    trees = quality.grow(x, y)

    def walk(row):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += leaf[at - len(f)]
        return total
    assert np.allclose(trees.margin(x[:50]), [walk(row) for row in x[:50]])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
