"""Sources and sinks: CSV, JSON records, sub-database, keys, SQL runner."""

import json

import pytest
from pyspark.sql import functions as F

from tabulon.functions import responses as R
from tabulon.plans.evaluate import evaluate
from tabulon.sources import catalog as C
from tabulon.sources import io as IO
from tabulon.sources.sql import QueryTimeout, run_query, with_time_limit

from .conftest import SF_SMALL


def test_csv_sources(spark, tmp_path):
    p = tmp_path / "models.csv"
    p.write_text("name,price\nm1,1.5\nm2,3\n")
    df = IO.read_csv(spark, str(p), price_col="price")
    assert dict(df.dtypes)["price"] == "double"
    assert sorted(r.price for r in df.collect()) == [1.5, 3.0]
    q = tmp_path / "people.csv"
    q.write_text("Name,Age\nAlice,25\nBob,30\n")
    tables = IO.database_from_csv(spark, [str(q)])
    assert run_query(spark, "SELECT Name FROM people WHERE Age > 26") == [["Bob"]]
    assert list(tables) == ["people"]


def test_json_records(spark, tmp_path):
    p = tmp_path / "tests.json"
    p.write_text(json.dumps([{"Query": "SELECT 1", "DB_ID": "x"}, {"Query": "SELECT 2", "DB_ID": "y"}]))
    df = IO.read_json_records(spark, str(p))
    assert sorted(df.columns) == ["db_id", "query"]
    out = tmp_path / "out"
    IO.write_table(df, str(out), "json")
    assert spark.read.json(str(out)).count() == 2


def test_write_renames_repeated_columns(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y")], "k int, v string")
    j = a.join(b, a.k == b.k)
    IO.write_table(j, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "j")).columns == ["k", "v", "k_1", "v_1"]


def test_sub_database_and_insert_lines(spark, tmp_path):
    db = C.driver_database(spark, SF_SMALL, ["nation", "region"])
    written = IO.sub_database(db.tables, str(tmp_path / "sub"), 3, db.primary_keys)
    assert spark.read.parquet(written["nation"]).count() == 3
    lines = [r.line for r in IO.insert_lines(db.tables["region"], "region", 2, ["r_regionkey"]).collect()]
    assert lines[0].startswith('INSERT INTO region ("r_regionkey", "r_name") VALUES (0, ')


def test_primary_key_check_and_orphans(spark):
    db = C.driver_database(spark, SF_SMALL, ["orders", "customer", "lineitem"])
    assert C.check_primary_key(db.tables["orders"], ["o_orderkey"]).count() == 0
    assert C.check_primary_key(db.tables["lineitem"], ["l_orderkey", "l_linenumber"]).count() > 0
    few = db.tables["customer"].where("c_custkey > 10")
    want = db.tables["orders"].where("o_custkey <= 10").count()
    assert want > 0 and C.orphan_rows(db.tables["orders"], few, "o_custkey", "c_custkey").count() == want


def test_sql_wrapper_refuses_statements(spark):
    C.driver_database(spark, SF_SMALL, ["nation"])
    assert len(run_query(spark, "SELECT * FROM nation;")) == 25
    assert run_query(spark, "WITH x AS (SELECT 1 AS a) SELECT a FROM x") == [[1]]
    with pytest.raises(Exception):
        run_query(spark, "DROP TABLE nation")


def test_time_limit(spark):
    slow = spark.range(0, 30_000_000_000).select(F.sum(F.sqrt("id")))
    with pytest.raises(QueryTimeout):
        with_time_limit(spark, slow.collect, 1.0)
    assert with_time_limit(spark, spark.range(3).count, 60.0) == 3


def test_literal_answers_scored_as_text(spark):
    # A text answer parsed into rows is compared with gold rows: numbers by value.
    df = spark.createDataFrame([("SELECT 1 AS a, 'x' AS b", "The answer is [[1.0, 'x']]"),
                                ("SELECT 1 AS a", "garbage")], "target string, text string")
    df = df.withColumn("pred", R.rows_from_text("text"))
    got = evaluate(spark, df.where(F.col("pred").isNotNull()), "target", "pred").first()
    assert got.execution_accuracy == 1.0


def test_cost_summary(spark):
    df = spark.createDataFrame([("m1", 0.5, 2.0, 1.0), ("m1", 0.25, 4.0, 0.0), ("m2", 1.0, 1.0, 1.0)],
                               "model string, cost double, time double, execution_accuracy double")
    got = {r.model: r for r in R.cost_summary(df, ["execution_accuracy"]).collect()}
    assert got["m1"].total_cost == 0.75 and got["m1"].mean_time == 3.0 and got["m1"].mean_execution_accuracy == 0.5


def test_double_quoted_identifiers(spark):
    from tabulon.sources.sql import sql_frame
    C.driver_database(spark, SF_SMALL, ["nation"])
    df = sql_frame(spark, 'SELECT "n_name" FROM nation WHERE "n_nationkey" = 3', double_quoted_identifiers=True)
    assert [r[0] for r in df.collect()] == ["NATION_3"]
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers", "false") == "false"


def test_samples_of_large_columns_are_the_least_by_md5(spark, monkeypatch):
    import hashlib

    df = spark.range(3000).selectExpr("concat('v', id % 2500) AS many", "concat('w', id % 7) AS few", "if(id = 5, 'x', null) AS `one q`", "cast(null as string) AS none")
    least = lambda values: sorted(values, key=lambda v: hashlib.md5(f"2023{v}".encode()).hexdigest())[:5]
    want = {"many": least(f"v{i}" for i in range(2500)), "few": least(f"w{i}" for i in range(7)), "one q": ["x"]}
    asked = []
    real = C._least_md5
    monkeypatch.setattr(C, "_least_md5", lambda d, cols, k, seed, below: asked.append((cols, below)) or real(d, cols, k, seed, below))
    for spare in (16, 0.01):  # with too tight a bound the column is read again
        monkeypatch.setattr(C, "_SPARE", spare)
        asked.clear()
        got = {r.column_name: r.sample_data for r in C.categorical_samples(df, ["many", "few", "one q", "none"], 5).collect()}
        assert got == want and "many" in asked[0][1] and (spare > 1) == (len(asked) == 1)
