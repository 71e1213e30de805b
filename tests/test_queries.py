"""Every registered key runs; keys with SQL match DuckDB on the sf0.001 tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as E
from tabulon.operators.compare import ALL_METRICS
from tabulon.sources.catalog import DRIVER_TABLES

from .conftest import SF_SMALL


def _norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def small_duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


SLOW = {"checklist", "evaluate_checklist", "ambiguity_best"}


@pytest.mark.parametrize("name", sorted(k for k in E.queries() if k in E.oracle_sql()))
def test_oracle(spark, small_duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows, scols = df.collect(), df.columns
    cur = small_duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(scols) == sorted(dcols)
    assert _rows(scols, srows) == _rows(dcols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(k for k in E.queries() if k not in E.oracle_sql()))
def test_rows_only(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = df.collect()
    assert rows and len(df.columns) > 0
    if name in ("checklist", "ambiguity_pipeline"):
        assert len(set(rows)) == len(rows) and all(r["query"] and r["sql_tag"] for r in rows)
    if name in ("evaluate_checklist", "ambiguity_best"):
        scores = [v for r in rows for k, v in r.asDict().items() if k in ALL_METRICS and v is not None]
        assert scores and all(0 <= v <= 1 for v in scores) and 1.0 in scores
        assert (0.0 in scores) == (name == "evaluate_checklist")


def test_entry(spark):
    assert E.entry(spark).count() >= 1


@pytest.mark.parametrize("name", ["checklist", "evaluate_checklist", "ambiguity_pipeline"])
def test_checklist_keys_take_every_table_and_family(spark, monkeypatch, name):
    from tabulon.plans import checklist
    from tabulon.sources.catalog import DRIVER_FOREIGN_KEYS

    class Asked(Exception):
        pass

    def generate(db, families=None, **_):
        raise Asked(set(db.tables), set(families or checklist.DEFAULT_FAMILIES), list(db.foreign_keys))
    monkeypatch.setattr(checklist, "generate", generate)
    with pytest.raises(Asked) as asked:
        E.queries()[name](spark, SF_SMALL)
    assert asked.value.args == (set(DRIVER_TABLES), {*checklist.DEFAULT_FAMILIES, "null"}, DRIVER_FOREIGN_KEYS)


def test_gold_answers_of_all_value_tests(spark):
    tables = {r["query"].split("`")[1] for r in E.queries()["gold_answers_all"](spark, SF_SMALL).collect()}
    assert tables == {"part", "orders", "customer", "lineitem", "events", "conversations", "documents", "nation"}


@pytest.mark.parametrize("name", ["gold_answers", "gold_answers_all"])
def test_a_failing_gold_query_is_no_answer_of_no_rows(spark, monkeypatch, name):
    from pyspark.sql import functions as F

    from tabulon.plans import registry
    spark.range(3).createOrReplaceTempView("three")
    monkeypatch.setattr(registry.C, "driver_database", lambda *_: None)

    def asked(*texts):
        monkeypatch.setattr(registry, "value_tests", lambda *_: spark.createDataFrame([(x,) for x in texts], "query string").withColumn("tbl_name", F.lit("three")))
    asked("SELECT * FROM three WHERE id > 0", "SELECT * FROM three WHERE id > 9")
    assert {r["query"][-1]: r.n_rows for r in E.queries()[name](spark, SF_SMALL).collect()} == {"0": 2, "9": 0}
    asked("SELECT * FROM three WHERE id > 0", "SELECT * FROM three WHERE nope > 0", "SELECT CAST(concat('x', id) AS INT) FROM three")
    with pytest.raises(ValueError, match="2 queries have no answer.*nope"):
        E.queries()[name](spark, SF_SMALL)
