import random
import re

import numpy as np

from tabulon.llm import substring_dedup as S


def sentences(text):
    """[(words, start, end)] by the definition, with the operator's cuts of long sentences."""
    data = (text or "").encode()
    sp = S.Spans(np.array([0, len(data)]), np.frombuffer(data, np.uint8))
    if sp.empty:
        return []
    edges = [*sp.byte.tolist(), len(data)]
    return [data[a:b] for a, b in zip(edges, edges[1:])]


def low(b):
    return tuple(b.lower().split())


def spans(units):
    n, out = [len(low(u)) for u in units], set()
    for i in range(len(units)):
        j = i + 1
        while j < len(units) and sum(n[i:j + 1]) < 25:
            j += 1
        if j < len(units):
            out.add((i, j))
        j = i - 1
        while j >= 0 and sum(n[j:i + 1]) < 25:
            j -= 1
        if j >= 0:
            out.add((j, i))
    return out


def brute(rows):
    units = {i: sentences(t) for i, t in rows}
    first = {}
    for i in sorted(units):
        for a, b in sorted(spans(units[i])):
            key = tuple(w for u in units[i][a:b + 1] for w in low(u))
            first.setdefault(key, (i, a))
    out = {}
    for i, t in rows:
        gone = set()
        for a, b in spans(units[i]):
            key = tuple(w for u in units[i][a:b + 1] for w in low(u))
            if first[key] != (i, a):
                gone |= set(range(a, b + 1))
        data = (t or "").encode()
        lead = data[:data.find(units[i][0])] if units[i] else b""
        out[i] = ((lead + b"".join(u for k, u in enumerate(units[i]) if k not in gone)).rstrip().decode() if gone else t, len(gone))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(4000)]
    sent = lambda: " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 5, 9, 14, 40]))) + r.choice([".", "!", "?", "\n", ""])
    passages = [" ".join(sent() for _ in range(8)) for _ in range(6)]
    rows = []
    for i in range(150):
        body = [sent() for _ in range(r.randrange(0, 12))]
        if r.random() < 0.5:
            body.insert(r.randrange(len(body) + 1), r.choice(passages))
        rows.append((i, r.choice(["", " \n"]) + r.choice([" ", "\n"]).join(body)))
    rows += [(200 + k, r.choice(rows)[1]) for k in range(10)]
    return rows + [(900, None), (901, ""), (902, "one two"), (903, "same words here again. " * 400), (904, "É ñ " * 30_000)]


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return {r.doc_id: (r.text, r.n_removed) for r in S.remove_repeats(df).collect()}


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got, want = run(spark, rows), brute(rows)
        assert got == want
    assert sum(n > 0 for _, n in got.values()) > 30


def test_a_long_passage_goes_and_clean_text_stays(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(30)) + ". " + passage + ". " + " ".join(word() for _ in range(30))) for i in range(5)]
    rows += [(10 + i, " ".join(word() for _ in range(200))) for i in range(5)]
    got = run(spark, rows)
    assert all(got[i] == (t, 0) for i, t in rows if i == 0 or i >= 10)
    left = [len(set(passage.split()) & set(re.findall(r"\w+", got[i][0]))) for i in range(1, 5)]
    assert max(left) <= 6 and all(len(got[i][0].split()) >= 50 for i in range(1, 5))


def test_repeated_rows_extra_columns_and_empty_table(spark):
    text = " ".join(f"word{k}" + ("." if k % 7 == 0 else "") for k in range(60))
    rows = [(1, text, 5, "x"), (1, text, 5, "x"), (2, text, None, "y"), (None, text, 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, at string")
    got = sorted((r.doc_id or 0, r.text, r.at) for r in S.remove_repeats(df).collect())
    assert got == [(0, text, "z"), (1, text, "x"), (1, text, "x"), (2, "", "y")]
    assert S.remove_repeats(df.where("false")).count() == 0


def test_no_50_words_stay_twice_wherever_they_stand(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7)) + r.choice([""] * 14 + [".", '."', "?)"]) * punctuated
    rows = []
    for k in range(150):
        punctuated = k % 2
        passage = [word() for _ in range(51)]
        for side in (0, 1):
            lead, tail = ([word() for _ in range(r.randrange(3, 40))] for _ in range(2))
            rows.append((2 * k + side, " ".join(lead + passage + tail)))

    def windows(texts):
        seen: dict = {}
        for i, t in texts:
            w = t.lower().split()
            for a in range(len(w) - 49):
                seen.setdefault(tuple(w[a:a + 50]), set()).add((i, a))
        return [x for x in seen.values() if len(x) > 1]

    assert len(windows(rows)) == 300
    got = run(spark, rows)
    assert windows([(i, t) for i, (t, _) in got.items()]) == []
    assert all(got[i] == (t, 0) for i, t in rows if i % 2 == 0)


def test_a_stop_before_closing_quotes_ends_a_sentence():
    for word, ends in (('a."', True), ("a.\u201d", True), ("a?')", True), ("a!\u00bb", True), ('a"', False), (')', False), ("a\u2019", False)):
        raw = np.frombuffer(word.encode(), np.uint8)
        assert S._stops(raw, np.array([0]), np.array([len(raw)])).tolist() == [ends]


def test_passages_wrapped_anew_are_found(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 8))) + r.choice(["", "", "", "", "", ".", ","])
    filler = lambda n: [word() for _ in range(n)]
    rows = []
    for k in range(100):
        passage = filler(60)
        wrapped = [w + ("\n" if j % 12 == k % 12 else " ") for j, w in enumerate(passage)]
        rows.append((2 * k, " ".join(filler(r.randrange(5, 40)) + passage + filler(20))))
        rows.append((2 * k + 1, " ".join(filler(r.randrange(5, 40))) + " " + "".join(wrapped) + " ".join(filler(20))))
    got = {x.doc_id: x.n_removed for x in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(got[2 * k] == 0 and got[2 * k + 1] > 0 for k in range(100))


def test_buckets_go_by_the_bytes_of_text(spark, monkeypatch):
    rows = corpus(4)
    want = {x.doc_id: (x.text, x.n_removed) for x in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    monkeypatch.setattr(S, "BUCKET_BYTES", 200)
    monkeypatch.setattr(S, "PART_BYTES", 2000)
    got = {x.doc_id: (x.text, x.n_removed) for x in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
