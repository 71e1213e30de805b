import random
import re

import pytest

from tabulon.llm import licenses as L


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(ws, phrase):
    p = phrase.split()
    return [k for k in range(len(ws) - len(p) + 1) if ws[k:k + len(p)] == p]


def brute(doc, text):
    ws = words(text)
    base = [(k, v) for p, v in L.BASE.items() for k in places(ws, p)]
    more = [v for p, v in L.NOTICES.items() if places(ws, p)]
    at = [k for k, _ in base]
    labels = {v for _, v in base} | set(more)
    return (doc, len(ws), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in base})), ",".join(sorted(labels)),
            max([L.burden(v) for v in labels], default=0.0))


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as notices", "'x' as labels", "0 as n_words").repartition(3)
    return sorted((tuple(r) for r in L.summary(L.scan(df)).collect()), key=str)


def test_phrases_equal_brute_force(spark):
    rng = random.Random(2)
    some = [w for p in [*L.BASE, *L.NOTICES] for w in p.split()] + ["é", "The", "x9"]
    gaps = [" ", "  ", "\n", ", ", "-", "_", "\x00", "\"", "\t"]
    rows = [(k, "".join((w.upper() if rng.random() < 0.2 else w) + rng.choice(gaps) for p in rng.choices([*L.BASE, *L.NOTICES, *some], k=rng.randint(0, 30)) for w in p.split()))
            for k in range(200)]
    rows += [(1, None), (2, ""), (2, ""), (None, "CC BY cc-by"), (3, "cc by" * 3), (4, "éAll rights reserved"), (5, "All rights reserved. " * 20_000), (6, "cc byé")]
    assert run(spark, rows) == sorted((brute(*r) for r in rows), key=str)
    assert run(spark, []) == []


def test_base_columns_of_whole_documents(spark, duck):
    from tabulon.llm.queries import op13_license_scan
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in op13_license_scan(spark, "/root/testdata/sf0.01").collect())
    assert got == sorted(brute(*r) for r in duck.sql("select doc_id, text from documents").fetchall())


TRUTH = {"mit": 0.1, "gpl-2.0": 0.7, "apache-2.0": 0.2, "proprietary": 1.0}


def random_expression(rng, depth=0):
    """(text, labels, burden), built with brackets around every operand that needs them."""
    if depth == 3 or rng.random() < 0.3:
        name = rng.choice(sorted(TRUTH))
        if rng.random() < 0.3:
            return f"{name} with exc-1", {f"{name} with exc-1"}, TRUTH[name] / 2, 3
        return name, {name}, TRUTH[name], 4
    op = rng.choice(["and", "or"])
    rank = {"or": 1, "and": 2}[op]
    sides = [random_expression(rng, depth + 1) for _ in range(2)]
    text = f" {op} ".join(f"({t})" if r < rank or rng.random() < 0.2 else t for t, _, _, r in sides)
    return text, sides[0][1] | sides[1][1], (min if op == "or" else max)(sides[0][2], sides[1][2]), rank


def test_expressions(spark):
    rng = random.Random(9)
    made = [random_expression(rng) for _ in range(200)]
    rows = [(k, f"x\n// SPDX-License-Identifier: {t.upper() if k % 2 else t} */ and more\n") for k, (t, *_) in enumerate(made)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.expressions for r in L.scan(df).collect()}
    for k, (_, labels, burden, _) in enumerate(made):
        assert len(got[k]) == 1 and got[k][0].word == 1
        assert got[k][0].labels == sorted(labels) and got[k][0].burden == pytest.approx(burden)


@pytest.mark.parametrize(("tail", "want"), [
    (": mit or", ["mit"]), (": (mit or gpl-3.0+) and apache-2.0", ["(", "mit", "or", "gpl-3.0+", ")", "and", "apache-2.0"]), (": (mit", []), (": mit) or x", ["mit"]),
    (" mit bsd", ["mit"]), (": or mit", []), ("", []), (":\nmit", []), ('" : "MIT"', ["mit"]), (": mit and (bsd or", ["mit"]), (": ((mit))", ["(", "(", "mit", ")", ")"])])
def test_whole_expressions_only(tail, want):
    text = f"spdx-license-identifier{tail}"
    found = L.scan_text([w.encode() for w in words(text)], text.encode())[1]
    assert [x["expression"] for x in found] == ([" ".join(want)] if want else [])


def test_score_joins_notices_and_expressions(spark):
    rows = [(1, "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR MIT"), (2, "Licensed under CC BY-NC 4.0.\nSPDX-License-Identifier: MIT\nSPDX-License-Identifier: odd-1 AND MIT")]
    got = run(spark, rows)
    assert [(r[0], r[6], r[7]) for r in got] == [(1, "gpl-2.0-only with classpath-exception-2.0,mit", 0.1), (2, "cc-by,cc-by-nc,mit,odd-1", 0.8)]
