"""Toxicity: a subsequence string-kernel support vector machine with Nystrom landmarks.

Words are compared by the subsequences of three letters that they share, with
gaps, each weighted down by its span: an inserted or missing letter leaves
most of them in place. The kernel of two sentences sums the cubes of the
normalised kernels of their distinct words. Landmarks are words of the labelled sample
(tellingly frequent in toxic documents, different from each other, and common
ones); the sentences' kernels with them, whitened by the landmarks' own kernel,
are the coordinates in which a support vector machine with squared hinge is
trained on labelled sentences, first on all sentences of toxic documents, then
on the highest-scoring of each. The sentences stay in a table; each Newton step
sums the support vectors' products in tasks, so only sums reach the driver. A sentence's decision is a sum over its words,
so a task scores each distinct word once; a document has the score of its
highest sentence, turned into a probability.

Letters spaced out one by one are read as one word, marks inside a word are
left out. Defined cases: null text is empty text, whose score is that of a
sentence without words; repeated rows get equal scores; labels other than 0 and
1 and labels of unknown documents are ignored; without labelled rows of both
classes every score is the share of label 1 among them (0 without any); an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.labelled import held_out, training_sample
from tabulon.llm.shared import stored, with_text

#: Labelled documents of each class that are learnt from, at most, with all their sentences.
SAMPLE = 2500
#: Documents whose sentences a task holds at once in training.
HELD_DOCS = 200
#: Landmarks: telling words and common words.
TELLING, COMMON = 48, 16
GAP, POWER, RIDGE = 0.6, 3, 1.0
_SPANS = [(a, b) for b in range(2, 5) for a in range(1, b)]
_MARKS = re.compile(r"[\W_]+")
#: Words whose decision a worker keeps.
WORDS = 1_000_000


def clean(word: str) -> str:
    return word if word.isalnum() else _MARKS.sub("", word)


def _letters(word_list):
    """Letters of all words as numbers below 64, and the word of each letter."""
    text = "".join(word_list)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    code = np.where((code >= 97) & (code <= 122), code - 97, 26 + code % 38)
    return code, np.repeat(np.arange(len(word_list)), np.fromiter(map(len, word_list), np.int64, len(word_list)))


def _norm(sizes):
    """Root of a word's own kernel, as for different letters."""
    own = sum(np.maximum(sizes - b, 0) * GAP ** (2 * b + 2) for _, b in _SPANS)
    return np.sqrt(np.maximum(own, 1e-12))


class Landmarks:
    def __init__(self, word_list):
        self.words = list(word_list)
        code, owner = _letters(self.words)
        cells = []
        for a, b in _SPANS:
            ok = owner[b:] == owner[:-b] if len(code) > b else np.zeros(0, bool)
            at = np.flatnonzero(ok)
            cells.append((code[at] * 4096 + code[at + a] * 64 + code[at + b], owner[at], np.full(len(at), GAP ** (b + 1))))
        grams, owners, weights = (np.concatenate(x) for x in zip(*cells, strict=True))
        self.known, row = np.unique(grams, return_inverse=True)
        self.table = np.zeros((len(self.known), len(self.words)), np.float32)
        np.add.at(self.table, (row, owners), weights.astype(np.float32))
        self.table /= _norm(np.array([len(w) for w in self.words]))[None, :]
        self.place = np.full(64**3, -1, np.int32)
        self.place[self.known] = np.arange(len(self.known))

    def kernel(self, word_list) -> np.ndarray:
        """Normalised kernel of each word with each landmark."""
        out = np.zeros((len(word_list), len(self.words)), np.float32)
        for k in range(0, len(word_list), 4000):
            part = word_list[k:k + 4000]
            code, owner = _letters(part)
            for a, b in _SPANS:
                if len(code) <= b:
                    continue
                row = self.place[code[:-b] * 4096 + code[a:len(code) - b + a] * 64 + code[b:]]
                hit = np.flatnonzero((row >= 0) & (owner[b:] == owner[:-b]))
                if len(hit):
                    own = owner[hit]
                    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    out[k + own[first]] += np.float32(GAP ** (b + 1)) * np.add.reduceat(self.table[row[hit]], first, axis=0)
            out[k:k + len(part)] /= _norm(np.fromiter(map(len, part), np.int64, len(part)))[:, None]
        return out


@dataclass
class Machine:
    landmarks: Landmarks | None
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, decision):
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(decision, float) + self.shift, -30, 30)))


class Reader:
    """Sentences of texts as numbers of distinct words; values of the cleaned words come from ``of_words``."""

    def __init__(self, of_words):
        self.of_words = of_words
        self.clear()

    def clear(self):
        self.at, self.cleaned = {}, {}
        self.form, self.ends = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        self.size, self.values = [np.zeros(0, np.int64)], [self.of_words([])]

    def read(self, texts):
        """(values of words, first word of each sentence, document of each sentence)."""
        lists = [[*t.lower().replace("\n", " . ").split(), "."] for t in texts]
        if len(self.at) > WORDS:
            self.clear()
        every = list(chain.from_iterable(lists))
        code = np.fromiter(map(self.at.get, every, repeat(-1)), np.int64, len(every))
        new = np.flatnonzero(code < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(every[k] for k in new)))
            code[new] = np.fromiter(map(self.at.__getitem__, (every[k] for k in new)), np.int64, len(new))
        for name in ("form", "ends", "size", "values"):
            setattr(self, name, [np.concatenate(getattr(self, name))])
        form, stop = self.form[0][code], self.ends[0][code]
        value = self.values[0][form]
        self._spaced_out(every, self.size[0][form], value)
        first = np.flatnonzero(np.r_[True, stop[:-1]])
        sentence = np.cumsum(np.r_[0, stop[:-1]])
        own = np.unique(sentence * np.int64(len(self.cleaned) + 1) + form, return_index=True)[1]
        again = np.ones(len(form), bool)
        again[own] = False
        value[again] = 0  # a word counts once in a sentence
        doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lists), np.int64, len(lists)))[first]
        return value, first, doc

    def _learn(self, new):
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        forms = [clean(w) for w in new]
        fresh = list(dict.fromkeys(w for w in forms if w not in self.cleaned))
        self.cleaned.update(zip(fresh, range(len(self.cleaned), len(self.cleaned) + len(fresh)), strict=True))
        self.values.append(self.of_words(fresh))
        self.size.append(np.fromiter(map(len, fresh), np.int64, len(fresh)))
        self.form.append(np.fromiter(map(self.cleaned.__getitem__, forms), np.int64, len(forms)))
        self.ends.append(np.fromiter((w[-1] in ".!?" for w in new), bool, len(new)))

    def _spaced_out(self, every, size, value):
        """Runs of three or more single letters count as the word they spell."""
        single = size == 1
        if not single.any():
            return
        edge = np.flatnonzero(np.diff(np.r_[False, single, False].astype(np.int8)))
        runs = [(s, e) for s, e in edge.reshape(-1, 2) if e - s >= 3]
        if runs:
            value[[s for s, _ in runs]] += self.of_words(["".join(map(clean, every[s:e])) for s, e in runs])


def _pieces(batches, reader):
    for b in batches:
        texts = b.column("text").to_pylist()
        k = 0
        while k < len(texts):
            j, held = k, 0
            while j < len(texts) and (j == k or held < 2_000_000):
                held += len(texts[j])
                j += 1
            yield b.slice(k, j - k), reader.read(texts[k:j])
            k = j


def _word_counts(batches):
    """Documents of either label that hold a word, batch by batch."""
    for b in batches:
        held: dict = {}
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
            for w in {clean(x) for x in text.lower().split()}:
                if 4 <= len(w) <= 24:
                    held.setdefault(w, [0, 0])[y] += 1
        if held:
            w, n = list(held), np.array(list(held.values()), np.int64)
            yield pa.RecordBatch.from_pydict({"word": pa.array(w), "clean": pa.array(n[:, 0]), "toxic": pa.array(n[:, 1])})


def _choose(counts: DataFrame, toxic: int, clean_docs: int) -> list[str]:
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean_docs + 1.0))
    telling = counts.where("toxic >= 3").withColumn("odds", odds).where("odds > 1").orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "word").limit(2000)
    common = counts.orderBy(F.desc(F.col("toxic") + F.col("clean")), "word").limit(COMMON)
    picked: list[str] = []
    for word in [r.word for r in telling.select("word").collect()]:
        if len(picked) == TELLING:
            break
        if not picked or Landmarks(picked).kernel([word]).max() < 0.75:
            picked.append(word)
    return picked + [r.word for r in common.select("word").collect() if r.word not in picked]


def _sentences_of(batches, width):
    """(sentences, +1 or -1 of each, its document, number of documents) of some rows (y, x) at once."""
    for b in (x.slice(k, HELD_DOCS) for x in batches for k in range(0, x.num_rows, HELD_DOCS)):
        blobs = b.column("x").to_pylist()
        x = np.frombuffer(b"".join(blobs), np.float32).reshape(-1, width).astype(float)
        of = np.repeat(np.arange(len(blobs)), [len(r) // (4 * width) for r in blobs])
        yield x, b.column("y").to_numpy()[of] * 2.0 - 1, of, len(blobs)


def _tops(x, of, docs, w):
    """(decision of each sentence, highest of its document)."""
    decision = x @ w[:-1] + w[-1]
    top = np.full(docs, -np.inf)
    np.maximum.at(top, of, decision)
    return decision, top


def _products(width, chosen, now):
    """Sums over a task's sentences, of either class: how many are used, and of the support vectors at ``now`` the products
    with themselves and with y. Of toxic documents only the sentences that ``chosen`` scores highest are used, if given."""
    def go(batches):
        total = np.zeros((2, 1 + (width + 1) ** 2 + width + 1))
        for x, y, of, docs in _sentences_of(batches, width):
            use = np.ones(len(y), bool)
            if chosen is not None:
                decision, top = _tops(x, of, docs, chosen)
                use = (y < 0) | (decision >= top[of] - 1e-12)
            x = np.c_[x, np.ones(len(x))]
            out = use & (y * (x @ now) < 1)
            for k, sign in enumerate((-1, 1)):
                own = x[out & (y == sign)]
                total[k] += np.r_[(use & (y == sign)).sum(), (own.T @ own).ravel(), sign * own.sum(0)]
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})
    return go


def hinge(rows: DataFrame, width: int, chosen=None, ridge=RIDGE) -> np.ndarray:
    """Weights and, last, bias of a support vector machine with squared hinge, by Newton steps on the support vectors.

    ``rows``: (y 0 or 1, x: a document's sentences, float32). Both classes weigh the same.
    """
    w = np.zeros(width + 1) if chosen is None else chosen
    keep = np.eye(len(w)) * ridge
    keep[-1, -1] = 1e-6
    for _ in range(30):
        total = sum(np.frombuffer(r.sums).reshape(2, -1) for r in rows.mapInArrow(_products(width, chosen, w), "sums binary").collect())
        each = np.array([1.0, total[0, 0] / max(1.0, total[1, 0])])
        products, with_y = np.split((total * each[:, None]).sum(0)[1:], [(width + 1) ** 2])
        new = np.linalg.solve(keep + products.reshape(width + 1, width + 1), with_y)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def _logistic(m, y):
    """Slope and shift of the probability that label is 1 given a decision; toxic documents weigh by the root of the labels' ratio.

    Newton steps, halved while the loss grows.
    """
    weight = np.where(y > 0, np.sqrt((y <= 0).sum() / max(1, (y > 0).sum())), 1.0)

    def loss(a, b):
        return (weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (a * m + b))).sum() + 0.5e-3 * a * a

    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([(weight * (p - y) * m).sum() + 1e-3 * a, (weight * (p - y)).sum()])
        v = weight * (p * (1 - p) + 1e-9)
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum()]])
        step, now = np.linalg.solve(h, g), loss(a, b)
        while np.abs(step).max() >= 1e-10 and not loss(a - step[0], b - step[1]) <= now:
            step = step / 2
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """The machine from at most ``sample`` labelled documents of each class."""
    chosen = training_sample(docs, labels, "toxic", sample, id_col, text_col)
    size = {r.y: r["count"] for r in chosen.groupBy("y").count().collect()}
    counts = (chosen.select("text", "y").mapInArrow(_word_counts, "word string, clean long, toxic long")
              .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    picked = _choose(counts, size.get(1, 0), size.get(0, 0)) if len(size) == 2 else []
    if not picked:
        share = size.get(1, 0) / max(1, sum(size.values()))
        return Machine(None, np.zeros(0), 0.0, 0.0, float(np.clip(np.log((share + 1e-12) / (1 - share + 1e-12)), -30, 30)))
    marks = Landmarks(picked)
    own = marks.kernel(picked).astype(float)**POWER
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    white = vectors / np.sqrt(np.maximum(values, 1e-2))
    sent = chosen.sparkSession.sparkContext.broadcast((marks, white.astype(np.float32)))

    width = len(picked)

    def sentences(batches):
        marks, white = sent.value
        reader = Reader(lambda w: marks.kernel(w)**POWER)
        for b, (value, first, doc) in _pieces(batches, reader):
            x = (np.add.reduceat(value, first, axis=0) @ white).astype(np.float32)
            ends = np.flatnonzero(doc[1:] != doc[:-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([r.tobytes() for r in np.split(x, ends)], pa.binary())], ["y", "x"])

    rows = stored(chosen.select("y", "text").mapInArrow(sentences, "y int, x binary"), "sentences")
    w = None
    for _ in range(4):
        w = hinge(rows, width, w)

    def highest(batches):
        for x, y, of, docs in _sentences_of(batches, width):
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            yield pa.RecordBatch.from_pydict({"y": pa.array(y[first]), "top": pa.array(_tops(x, of, docs, w)[1])})

    tops = rows.mapInArrow(highest, "y double, top double").toPandas().sort_values(["top", "y"])
    return Machine(marks, white @ w[:-1], float(w[-1]), *_logistic(tops["top"].to_numpy(), (tops["y"].to_numpy() > 0).astype(float)))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document: its highest sentence's."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def go(batches):
        m = model.value
        reader = Reader((lambda w: (m.landmarks.kernel(w)**POWER) @ m.weights) if m.landmarks else (lambda w: np.zeros(len(w))))
        for b, (value, first, doc) in _pieces(batches, reader):
            decision = np.add.reduceat(value, first) + m.bias
            top = np.maximum.reduceat(decision, np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(m.probability(top))], ["doc_id", "score"])

    return with_text(docs, id_col, text_col).mapInArrow(go, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **columns) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, train(docs, labels, **columns), **columns)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
