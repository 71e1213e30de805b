"""Printed Python literals and number texts against Python's own reading of them."""

import ast
import random
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from tabulon.functions import cells as CELLS
from tabulon.functions import responses as R
from tabulon.plans.evaluate import evaluate


def text_of(cell):
    """What a cell's text must be."""
    if cell is None or isinstance(cell, str):
        return cell
    return str(cell).lower() if isinstance(cell, bool) else repr(cell)


def rows_of(value):
    rows = [list(value)] if value and not any(isinstance(x, (list, tuple)) for x in value) else [list(r) for r in value]
    return [[text_of(c) for c in r] for r in rows]


def random_rows(rng):
    letters = ["a", "b", " ", "'", '"', "\\", "\n", "\t", "[", "]", "(", ")", ",", "None", "True", "\x07", "\x00", "é", "日", "​", "\x1b", "{", "#", "1"]

    def cell():
        kind = rng.randrange(7)
        if kind < 3:
            return "".join(rng.choice(letters) for _ in range(rng.randrange(6)))
        return [None, rng.random() < 0.5, rng.randrange(-10**25, 10**25), rng.choice([0.5, -1e-9, 1e22, 3.0, 123456789.25])][kind - 3]

    width = rng.randrange(1, 4)
    rows = [rng.choice([tuple, list])(cell() for _ in range(width)) for _ in range(rng.randrange(0, 4))]
    return rng.choice([rows, tuple(rows) if len(rows) > 1 else rows, list(rows[0]) if rows else rows])


def test_random_literals_agree_with_literal_eval(spark):
    rng = random.Random(11)
    texts = [repr(random_rows(rng)) for _ in range(400)]
    texts = [t if t.startswith("[") else f"[{t[1:-1]}]" for t in texts]
    texts += ["[('x',), ('y',)]", "[('x',)]", "[[],]", "[]", "[(1), (2)]", "[( 'a' , ), ]", "[('a', 1), ('b', 2),]", "[['" + "z" * 20_000 + "\\n" + "']]"]
    want = []
    for t in texts:
        want.append(rows_of(ast.literal_eval(t)))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {r.i: r.r for r in df.select("i", R.rows_from_text("s", span=False).alias("r")).collect()}
    step = {r.i: r.r for r in R.parse_rows(df, "s", "r", span=False).collect()}
    typed = {r.i: r.r for r in df.select("i", R.typed_rows("s", span=False).alias("r")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == want[i] and step[i] == want[i], t
        cells = ast.literal_eval(t)
        flat = cells and not any(isinstance(x, (list, tuple)) for x in cells)
        for row, own in zip(typed[i], [cells] if flat else cells, strict=True):
            assert [(c.text, c.quoted) for c in row] == [(text_of(c), isinstance(c, str)) for c in own], t


def test_what_is_no_literal_gives_null(spark):
    bad = ["not a list", "[[1, 2]", "[1, [2]]", "[[1], 2]", "[f(1)]", "[1 2]", "['a", None, "{'a': 1}"]
    df = spark.createDataFrame([(t,) for t in bad], "s string")
    assert [r.r for r in df.select(R.rows_from_text("s", span=False).alias("r")).collect()] == [None] * len(bad)


def test_digits_is_a_normal_form(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(300):
        whole, part = "".join(rng.choice("0012345") for _ in range(rng.randrange(0, 22))), "".join(rng.choice("0009") for _ in range(rng.randrange(0, 12)))
        if whole or part:
            texts.append(rng.choice(["", "-", "+"]) + whole + rng.choice([f".{part}" if part else "", f".{part}"] if whole else [f".{part}" if part else ".0"]) + rng.choice(["", "", f"e{rng.randint(-30, 30)}"]))
    texts += ["0", "-0", "0.000", "1e-40", "1e40", "123e37", "9" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    form = {r.i: r.k for r in df.select("i", CELLS.digits(F.col("s")).alias("k")).collect()}
    value = [Fraction(t) for t in texts]
    by = {}
    for i, v in enumerate(value):
        by.setdefault(v, set()).add(form[i])
    assert all(len(forms) == 1 for forms in by.values()) and len({next(iter(f)) for f in by.values()}) == len(by)


def test_answers_keep_their_digits(spark):
    cases = [("SELECT 9007199254740993", "[[9007199254740993]]", 1.0), ("SELECT 9007199254740992", "[[9007199254740993]]", 0.0),
             ("SELECT CAST('12345678901234567890.12' AS DECIMAL(38,2))", "[(12345678901234567890.12,)]", 1.0),
             ("SELECT CAST('12345678901234567890.12' AS DECIMAL(38,2))", "[(12345678901234567890.13,)]", 0.0),
             ("SELECT 0.1D", "[(0.1,)]", 1.0), ("SELECT 1.0E23D", "[(1e+23,)]", 1.0), ("SELECT 12345678.5D", "[[12345678.5]]", 1.0), ("SELECT 1", "[(True,)]", 1.0),
             ("SELECT 'x' UNION ALL SELECT 'y'", "[('x',), ('y',)]", 1.0), ("SELECT '1'", "[(1,)]", 0.0), ("SELECT '1'", "[('1',)]", 1.0), ("SELECT CAST('1e-7' AS DECIMAL(20,9))", "[(0.0000001,)]", 1.0)]
    df = spark.createDataFrame(cases, "target string, answer string, want double").withColumn("rows", R.typed_rows("answer"))
    wrong = [(r.target, r.answer) for r in evaluate(spark, df, "target", "rows").collect() if r.execution_accuracy != r.want]
    assert wrong == []


def test_decimals_compare_by_value(spark):
    texts = ["0.10", "12345678.50", "0.00", "-3.00", "12345678901234567890123456.125"]
    df = spark.createDataFrame([(Decimal(t),) for t in texts], "d decimal(38,6)")
    from pyspark.sql import types as T
    got = [r.k for r in df.select(CELLS.cell_key(F.col("d"), T.DecimalType(38, 6)).alias("k")).collect()]
    assert got == ["1:0.1", "1:12345678.5", "1:0", "1:-3", "1:12345678901234567890123456.125"]
