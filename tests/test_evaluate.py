"""Scoring rules that hold whatever the batch, the database or the kind of failure."""

import threading
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabulon.functions import responses as R
from tabulon.functions.cells import cell_key
from tabulon.operators.compare import METRICS, register_metric
from tabulon.plans.evaluate import evaluate, gold_answers
from tabulon.sources import catalog as C
from tabulon.sources.sql import QueryTimeout, with_time_limit

from .conftest import SF_SMALL

SLOW = "SELECT sum(sqrt(id)) AS s FROM range(0, 30000000000)"


def frame(spark, rows):
    return spark.createDataFrame(rows, "test_id bigint, target string, pred string")


def scores(df, metric="execution_accuracy"):
    return {r.test_id: r[metric] for r in df.collect()}


def test_time_limit_is_each_query_s_own(spark):
    rows = [(0, "SELECT 1 AS s", SLOW)] + [(i, f"SELECT {i} AS s", f"SELECT {i} + 0 AS s") for i in range(1, 6)]
    began = time.time()
    got = scores(evaluate(spark, frame(spark, rows), "target", "pred", timeout_s=4.0))
    assert got == {0: 0.0, **{i: 1.0 for i in range(1, 6)}} and time.time() - began < 60


def test_time_limit_cancels_jobs_that_start_late(spark):
    def late():
        time.sleep(0.8)
        return spark.range(0, 30_000_000_000).select(F.sum(F.sqrt("id"))).collect()
    began = time.time()
    with pytest.raises(QueryTimeout):
        with_time_limit(spark, late, 0.2)
    assert time.time() - began < 15 and threading.active_count() < 50


def test_null_and_unparsed_predictions_score_zero(spark):
    got = evaluate(spark, frame(spark, [(1, "SELECT 1 AS a", None), (2, "SELECT 1 AS a WHERE false", "SELECT 1 AS a WHERE 1 = 0")]), "target", "pred")
    assert scores(got) == {1: 0.0, 2: 1.0}
    assert scores(got, "cell_precision")[1] == 0.0
    text = frame(spark, [(1, "SELECT 1 AS a WHERE false", "no rows here"), (2, "SELECT 1 AS a WHERE false", "[]")])
    got = scores(evaluate(spark, text.withColumn("rows", R.typed_rows("pred")), "target", "rows"))
    assert got == {1: 0.0, 2: 1.0}


def test_quoted_digits_are_text_and_numbers_are_numbers(spark):
    rows = [(1, "SELECT '12345' AS a", "[['12345']]"), (2, "SELECT 12345 AS a", "[[12345.0]]"), (3, "SELECT 12345 AS a", "[['12345']]"),
            (4, "SELECT 'None' AS a", '[["None"]]'), (5, "SELECT 'it''s' AS a, null AS b", "[[\"it's\", None]]"), (6, "SELECT 'True' AS a", "[['True']]")]
    df = frame(spark, rows).withColumn("rows", R.typed_rows("pred"))
    assert scores(evaluate(spark, df, "target", "rows")) == {1: 1.0, 2: 1.0, 3: 0.0, 4: 1.0, 5: 1.0, 6: 1.0}


def test_run_time_errors_fail_their_test_only(spark):
    C.driver_database(spark, SF_SMALL, ["nation", "region"])
    rows = [(1, "SELECT 1 AS a", "SELECT (SELECT n_name FROM nation) FROM region"), (2, "SELECT 1 AS a", "SELECT CAST('x' AS INT) AS a"),
            (3, "SELECT 1 AS a", "SELECT 2 - 1 AS a")]
    got = scores(evaluate(spark, frame(spark, rows), "target", "pred"))
    assert got[1] == 0.0 and got[3] == 1.0


def test_databases_do_not_see_each_other(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(3).write.parquet(f"{a}/only_a.parquet")
    spark.range(4).write.parquet(f"{b}/only_b.parquet")
    rows = [(1, "SELECT count(*) AS n FROM only_a", "SELECT 3 AS n", a), (2, "SELECT 4 AS n", "SELECT count(*) AS n FROM only_a", b),
            (3, "SELECT 4 AS n", "SELECT count(*) AS n FROM only_b", f"file://{b}")]
    df = spark.createDataFrame(rows, "test_id bigint, target string, pred string, db string")
    assert scores(evaluate(spark, df, "target", "pred", db_path_col="db")) == {1: 1.0, 2: 0.0, 3: 1.0}
    assert not spark.catalog.tableExists("only_a")
    gone = df.where("test_id = 1").withColumn("db", F.lit(str(tmp_path / "none")))
    with pytest.raises(ValueError, match="no parquet tables"):
        evaluate(spark, gone, "target", "pred", db_path_col="db")
    res, errors = gold_answers(spark, df, "pred", db_path_col="db")
    assert sorted(r.test_id for r in res.collect()) == [1, 3]
    (bad,) = errors.collect()
    assert bad.test_id == 2 and bad.error.startswith("Error: ") and "only_a" in bad.error


def test_caller_s_ids_and_count_of_failing_targets(spark):
    df = spark.createDataFrame([("q1", "SELECT 1 AS a", "SELECT 1 AS b"), ("q2", "SELECT 1 AS a", "SELECT 2 AS b")], "test_id string, target string, pred string")
    assert scores(evaluate(spark, df, "target", "pred")) == {"q1": 1.0, "q2": 0.0}
    with pytest.raises(ValueError, match="fails for 25 tests"):
        evaluate(spark, frame(spark, [(i, f"SELECT nope{i}", "SELECT 1") for i in range(25)]), "target", "pred")


def test_efficiency_score_of_the_evaluator(spark):
    df = spark.createDataFrame([("a", "SELECT 1 AS a", "SELECT 2 - 1 AS a"), ("b", "SELECT 1 AS a", "SELECT 2 AS a")], "test_id string, target string, pred string")
    times = spark.createDataFrame([(i, s, r, v) for i in "ab" for s, v in (("t", 4.0), ("p", 1.0)) for r in range(3)],
                                  "test_id string, side string, run int, seconds double")
    assert scores(evaluate(spark, df, "target", "pred", timings=times), "valid_efficiency_score") == {"a": 2.0, "b": 0.0}
    literal = df.withColumn("rows", F.expr("array(array('1'))"))
    assert scores(evaluate(spark, literal, "target", "rows", timings=times), "valid_efficiency_score") == {"a": 0.0, "b": 0.0}


def test_number_keys_are_exact_at_every_size(spark):
    values = [(Decimal(10**19), 1e19, True), (Decimal(2**70), float(2**70), True), (Decimal(2**70 + 1), float(2**70), False),
              (Decimal(-(2**64)), -(2.0**64), True), (Decimal(3), 3.0, True), (Decimal(10**37), 1e37, 10**37 == int(1e37))]
    df = spark.createDataFrame([(a, b) for a, b, _ in values], "a decimal(38,0), b double")
    got = df.select(*[cell_key(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).collect()
    assert [(r.a == r.b) for r in got] == [same for _, _, same in values]
    df = spark.createDataFrame([(Decimal("1200000000000000000.01"), Decimal("1200000000000000000.00"), Decimal("0.10"), 0.1, Decimal("7.00"), 7)],
                               "a decimal(38,2), b decimal(38,2), c decimal(10,2), d double, e decimal(9,2), f int")
    r = df.select(*[cell_key(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert r.a != r.b and r.c == r.d and r.e == r.f


def test_both_sides_as_text(spark):
    rows = [(1, "SELECT 1 AS a", "SELECT '1' AS a"), (2, "SELECT '7.50' AS a", "SELECT 7.5D AS a"), (3, "SELECT CAST(NULL AS INT) AS a", "SELECT 'None' AS a"), (4, "SELECT 'x' AS a", "SELECT 'y' AS a")]
    typed = scores(evaluate(spark, frame(spark, rows), "target", "pred"))
    text = scores(evaluate(spark, frame(spark, rows), "target", "pred", as_text=True))
    assert typed == {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0} and text == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0}
    literal = frame(spark, [(1, "SELECT 1 AS a, 'b' AS c", "[('1', 'b')]")]).withColumn("rows", R.typed_rows("pred"))
    assert scores(evaluate(spark, literal, "target", "rows", as_text=True)) == {1: 1.0} and scores(evaluate(spark, literal, "target", "rows")) == {1: 0.0}


def test_a_metric_added_by_name(spark):
    register_metric("row_jaccard", {"both": lambda: F.count_if((F.col("a") > 0) & (F.col("b") > 0)), "every": lambda: F.count(F.lit(1))}, lambda p: p["both"] / p["every"])
    try:
        rows = [(1, "SELECT id FROM range(4)", "SELECT id FROM range(1, 5)"), (2, "SELECT 1 AS a WHERE false", "SELECT 2 AS a WHERE 1 = 0"), (3, "SELECT 1 AS a", "SELECT 1 AS a WHERE false"),
                (4, "SELECT 1 AS a", "SELECT nope")]
        got = evaluate(spark, frame(spark, rows), "target", "pred", names=["row_jaccard", "execution_accuracy"])
        assert scores(got, "row_jaccard") == {1: 0.6, 2: 1.0, 3: 0.0, 4: 0.0} and scores(got)[1] == 0.0
    finally:
        del METRICS["row_jaccard"]
    with pytest.raises(ValueError, match="of the library"):
        register_metric("tuple_order", {}, lambda p: F.lit(1.0))


def test_only_the_cells_of_differing_results_are_written(spark, tmp_path):
    spark.range(40).selectExpr("id AS k", "id % 7 AS g", "concat('t', id) AS word").createOrReplaceTempView("forty")
    rows = [(1, "SELECT * FROM forty ORDER BY g ASC, k", "SELECT * FROM forty ORDER BY g DESC, k"), (2, "SELECT * FROM forty ORDER BY g DESC, k", "SELECT * FROM forty ORDER BY g ASC, k"),
            (3, "SELECT k, g FROM forty", "SELECT g, k FROM forty"), (4, "SELECT * FROM forty WHERE k < 0", "SELECT * FROM forty"), (5, "SELECT nope FROM forty", "SELECT word FROM forty"),
            (6, "SELECT g FROM forty WHERE k < 10", "SELECT g FROM forty WHERE k < 9"), (7, "SELECT k FROM forty ORDER BY k", "SELECT k FROM forty WHERE k > 1 ORDER BY -k")]
    work = str(tmp_path / "work")
    got = {r.test_id: r for r in evaluate(spark, frame(spark, rows), "target", "pred", on_target_error="null", work=work).collect()}
    assert got[1].tuple_order == got[2].tuple_order and 0 < got[1].tuple_order < 1 and got[7].tuple_order == 0.0 and got[6].tuple_order is None
    for i in (1, 2, 3):
        assert (got[i].execution_accuracy, got[i].cell_precision, got[i].cell_recall, got[i].tuple_cardinality, got[i].tuple_constraint) == (1.0,) * 5
    assert (got[4].cell_recall, got[4].execution_accuracy) == (0.0, 0.0) and got[5].cell_recall is None
    # g is 0..6, 0, 1, 2 of ten rows and 0..6, 0, 1 of nine: of seven values only that of 2 comes another number of times
    assert (got[6].cell_precision, got[6].tuple_cardinality, got[6].tuple_constraint, got[6].execution_accuracy) == (1.0, 0.9, 0.857, 0.0)
    assert got[7].cell_recall == 0.95 and got[7].cell_precision == 1.0
    written = spark.read.parquet(f"{work}/res")
    assert written.columns[:4] == ["test_id", "side", "pos", "cells"] and written.count() == 10 + 9 + 40 + 38
    assert "cells" not in spark.read.parquet(f"{work}/keys/res").columns


def test_gold_rows_are_written_once(spark, tmp_path):
    base = spark.sparkContext.getCheckpointDir() or ""
    folder = base.partition(":")[2] if base.startswith("file:") else base
    import os
    before = set(os.listdir(folder))
    res, errors = gold_answers(spark, frame(spark, [(1, "SELECT id FROM range(5)", None), (2, "SELECT nope", None), (3, "SELECT id FROM range(5)", None)]), "target", work=str(tmp_path / "gold"))
    assert sorted(r.test_id for r in res.collect()) == [1] * 5 + [3] * 5 and [r.test_id for r in errors.collect()] == [2]
    assert not [f for f in set(os.listdir(folder)) - before if f.startswith("tabulon-gold")]
