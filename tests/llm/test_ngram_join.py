import random
import re

from tabulon.llm import ngram_join as J


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {(i, len(s), root(i)) for i, s in sets}


def corpus(seed, n=260):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    passage = [r.choice(vocab) for _ in range(40)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.45 and rows:
            w = words(r.choice(rows)[1])
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
        elif kind < 0.6:
            w = passage + [r.choice(vocab) for _ in range(r.randrange(0, 30))]
        else:
            w = [r.choice(vocab) for _ in range(r.choice([0, 1, 3, 4, 5, 6, 9, 40, 150]))]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(w).upper() if r.random() < 0.2 else " ".join(w)))
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {tuple(r) for r in J.component_ids(df).collect()}


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed) + [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "a"), (1004, "A")]
        assert run(spark, rows) == brute(rows)


def test_blocks_and_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 3)
    rows = corpus(5, 200)
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    assert run(spark, []) == set()
    df = spark.createDataFrame([(1, "a b c d e f", 7, "x"), (2, "a b c d e f", 8, "y")], "doc_id long, text string, n long, sid string")
    assert {tuple(r) for r in J.component_ids(df).collect()} == {(1, 2, 1), (2, 2, 1)}


def test_long_text(spark):
    long = " ".join(f"x{k}" for k in range(30000))
    rows = [(1, long), (2, long + " y"), (3, "z " + long)]
    assert run(spark, rows) == brute(rows)


def brute_links(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    return {(i, j) for k, (j, b) in enumerate(sets) for i, a in sets[:k] if a and b and 100 * len(a & b) >= 80 * len(a | b)}


def test_every_link_inside_a_group_is_returned_and_counted(spark, monkeypatch):
    r = random.Random(9)
    base = [f"v{k}" for k in range(120)]
    near = []
    for i in range(40):
        w = list(base)
        for _ in range(r.choice([1, 1, 2, 3])):
            w[r.randrange(len(w))] = f"u{i}"
        near.append((2000 + i, " ".join(w)))
    for block in (256, 3):
        monkeypatch.setattr(J, "LINK_BLOCK", block)
        rows = corpus(3) + near + [(3000, near[0][1]), (3001, near[0][1]), (3002, None)]
        want = brute_links(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {x.doc_id: x.n_links for x in J.link_counts(df).collect()}
        assert got == {i: sum(i in p for p in want) for i, _ in rows}
        rep = {i: min(j for j, u in rows if shingles(u) == shingles(t)) for i, t in rows if shingles(t)}
        links = [tuple(x) for x in J.ngram_join(df).links.collect()]
        assert len(links) == len(set(links)) and set(links) == {tuple(sorted((rep[i], rep[j]))) for i, j in want if rep[i] != rep[j]}


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    base = [f"v{k}" for k in range(60)]
    near = " ".join([*base[:59], "x"])
    rows = [(1, " ".join(base)), (5, near), (5, "an unrelated text of some words"), (5, "an unrelated text of some words"), (5, ""), (5, None), (None, near + " y"), (None, "p q r s t u"),
            (None, "p q r s t u"), (None, "z"), (7, "an unrelated text of some words"), (8, "unlike all the others here now"), (9, "z z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = lambda x: (x[0] is None, x[0] or 0)
    sets = [shingles(t) for _, t in rows]
    link = lambda a, b: 100 * len(a & b) >= 80 * len(a | b) and bool(a)
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if link(a, b):
                    group[i] = group[j] = min(group[i], group[j])
    name = {g: min((rows[i] for i in range(len(rows)) if group[i] == g), key=key)[0] for g in group}
    want = sorted(((r[0], len(s), name[g], sum(link(s, o) for j, o in enumerate(sets) if j != i)) for i, (r, s, g) in enumerate(zip(rows, sets, group, strict=True))), key=str)
    assert sorted((tuple(r) for r in J.link_counts(df).collect()), key=str) == want
    kept = sorted((tuple(r) for r in J.deduplicate(df.selectExpr("*", "map(1, 2) as row", "'d' as dig")).select("doc_id", "text").collect()), key=str)
    assert kept == sorted([(1, " ".join(base)), (5, "an unrelated text of some words"), (5, ""), (5, None), (None, "p q r s t u"), (None, "z"), (8, "unlike all the others here now"),
                           (9, "z z")], key=str)
