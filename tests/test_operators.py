"""Catalog, ranking, top-k, ambiguity and evaluation on small inputs."""

import pytest
from pyspark.sql import functions as F

from tabulon.operators import ambiguity as A
from tabulon.operators.ranking import global_positions, group_positions
from tabulon.operators.topk import top_k_per_group
from tabulon.plans.evaluate import evaluate
from tabulon.sources import catalog as C

from .conftest import SF_SMALL


def test_classify():
    from pyspark.sql import types as T
    assert C.classify(T.StringType()) == "categorical"
    assert C.classify(T.DecimalType(10, 2)) == "numerical"
    assert C.classify(T.TimestampType()) is None


def test_open_database_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        C.open_database(spark, str(tmp_path / "none"), "x")
    import pandas as pd
    db = C.open_database(spark, str(tmp_path / "db"), "x", tables={"table": pd.DataFrame({"id": [1, 2], "n": ["a", "b"]})},
                         primary_keys={"table": "id"})
    assert "my_table" in db.tables and db.primary_keys == {"my_table": ["id"]}
    with pytest.raises(ValueError):
        C.open_database(spark, str(tmp_path / "db"), "x", tables={"t": pd.DataFrame({"a": [1]})})


def test_catalog_samples(spark):
    db = C.driver_database(spark, SF_SMALL, ["part", "lineitem"])
    cat = {(r.tbl_name, r.column_name): r for r in C.build_catalog(spark, db.tables, db.primary_keys).collect()}
    brands = cat[("part", "p_brand")].sample_data
    assert len(brands) == 5 and len(set(brands)) == 5
    sizes = cat[("part", "p_size")].sample_data
    first = [str(r.p_size) for r in db.tables["part"].orderBy("p_partkey").limit(5).collect()]
    assert sizes == first
    assert ("lineitem", "l_shipdate") not in cat  # timestamps are not classified


def test_foreign_keys(spark):
    db = C.driver_database(spark, SF_SMALL, ["documents", "labels", "orders", "customer"])
    fks = {tuple(r) for r in C.infer_foreign_keys(C.schema_rows(spark, db.tables, db.primary_keys),
                                                  db.foreign_keys).collect()}
    assert ("labels", "doc_id", "documents", "doc_id") in fks
    assert ("orders", "o_custkey", "customer", "c_custkey") in fks


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), (F.col("id") * 37 % 1000).alias("v"))
    pos = {(r.g, r.v): r.pos for r in group_positions(df, ["g"], [F.col("v")]).collect()}
    for g in range(7):
        vs = sorted(v for (gg, v) in pos if gg == g)
        assert [pos[(g, v)] for v in vs] == list(range(1, len(vs) + 1))
    glob = global_positions(df, [F.col("v").desc()]).collect()
    assert sorted(r.pos for r in glob) == list(range(1, 1001))
    assert all(r.pos == 1000 - r.v for r in glob)


def test_top_k_hot_group(spark):
    # One group holds most rows; result equals a plain sort per group.
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 3).alias("g"),
                                  F.col("id").alias("v"))
    top = top_k_per_group(df, ["g"], [F.col("v").desc()], 3).collect()
    got = {}
    for r in top:
        got.setdefault(r.g, []).append(r.v)
    expect = {}
    for i in range(5000):
        expect.setdefault(0 if i < 4000 else i % 3, []).append(i)
    assert {g: sorted(v, reverse=True) for g, v in got.items()} == \
        {g: sorted(v, reverse=True)[:3] for g, v in expect.items()}


def _py_inject(tests, matrix, attrs, th):
    """Plain statement of the injection rules on lists."""
    label2attr = {lab: [a for a, s in zip(attrs, sc) if s >= th] for lab, *sc in matrix}
    strong = [a for i, a in enumerate(attrs) if any(row[1 + i] >= th for row in matrix)]
    rows = []
    for q, question in tests:
        if not any(a in q for a in strong):
            continue
        rows.append((q, question, question, None, None, None))
        for i, a in enumerate(attrs):
            if a in question:
                for lab, *sc in matrix:
                    if sc[i] >= th:
                        rows.append((q, question, question.replace(a, lab), a, lab, tuple(label2attr[lab])))
    seen, out = set(), []
    for r in rows:
        if r[2] in seen:
            continue
        seen.add(r[2])
        if r[3] is not None:
            out.append(r)
    return out


def test_ambiguity_against_python(spark):
    attrs = ["amount", "price", "name"]
    matrix = [("cost", 3.0, 2.0, 0.0), ("title", 0.0, 0.0, 2.5), ("value", 2.0, 1.0, 0.0)]
    tests = [("SELECT amount FROM t", "Show the amount"), ("SELECT price FROM t", "Show the price and amount"),
             ("SELECT name FROM t", "Show the name"), ("SELECT x FROM t", "Show x"),
             ("SELECT amount, name FROM t", "Show the amount")]
    m = spark.createDataFrame(matrix, ["label"] + attrs)
    ann = A.long_annotations(m, "db")
    tdf = spark.createDataFrame([("db", f"{i:03d}", q, s) for i, (q, s) in enumerate(tests)],
                                "db_id string, test_id string, query string, question string")
    got = A.ambiguous_tests(tdf, ann, 2.0).collect()
    mine = sorted((r.query, r.question, r.ambiguous_question, r.swapped_attribute, r.ambiguous_label,
                   tuple(r.ambiguous_attributes)) for r in got)
    assert mine == sorted(_py_inject(tests, matrix, attrs, 2.0))
    for r in got:
        assert r.target_queries == [r.query.replace(r.swapped_attribute, a) for a in r.ambiguous_attributes]


def test_best_of_targets(spark):
    rows = [("q1", 0, 1.0, 0.0, None), ("q1", 1, 0.5, 0.5, 1.0), ("q2", 0, None, None, None), ("q2", 1, 0.2, 0.2, 0.2)]
    df = spark.createDataFrame(rows, "k string, target_pos int, cell_precision double, cell_recall double, "
                                     "tuple_order double")
    got = {r.k: (r.cell_precision, r.cell_recall, r.tuple_order) for r in A.best_of_targets(df, ["k"]).collect()}
    assert got == {"q1": (0.5, 0.5, 1.0), "q2": (0.2, 0.2, 0.2)}


def test_evaluate_sql_and_literals(spark):
    C.driver_database(spark, SF_SMALL, ["nation"])
    tests = spark.createDataFrame([
        ("SELECT n_name FROM nation ORDER BY n_name", "SELECT n_name FROM nation ORDER BY n_name DESC"),
        ("SELECT * FROM nation", "select * from nation"),
        ("SELECT n_name FROM nation", "SELECT missing FROM nation"),
        ("SELECT n_name FROM nation WHERE n_nationkey < 0", "SELECT n_name FROM nation WHERE n_nationkey < -5"),
    ], "target string, pred string")
    got = [r.asDict() for r in evaluate(spark, tests, "target", "pred").orderBy("test_id").collect()]
    assert got[0]["tuple_order"] == 0.0 and got[0]["execution_accuracy"] == 1.0
    assert got[1]["cell_precision"] == 1.0 and got[1]["tuple_order"] is None
    assert got[2]["cell_precision"] == 0.0
    assert got[3]["execution_accuracy"] == 1.0
    lit = spark.createDataFrame([("SELECT n_nationkey FROM nation WHERE n_nationkey < 2", [["0"], ["1.0"]])],
                                "target string, pred array<array<string>>")
    r = evaluate(spark, lit, "target", "pred").first()
    assert r.execution_accuracy == 1.0
    with pytest.raises(ValueError):
        evaluate(spark, spark.createDataFrame([("SELECT nope FROM nation", "SELECT 1")], "target string, pred string"),
                 "target", "pred")


def test_evaluate_pair_and_timeout(spark):
    from tabulon.plans.evaluate import evaluate_pair
    C.driver_database(spark, SF_SMALL, ["nation"])
    m = evaluate_pair(spark, "SELECT n_name FROM nation;", "SELECT n_name FROM nation WHERE n_nationkey < 5")
    assert m["cell_recall"] == 0.2 and m["tuple_order"] is None
    slow = "SELECT sum(sqrt(id)) AS s FROM range(0, 3000000000)"
    m = evaluate_pair(spark, "SELECT 1 AS s", slow, timeout_s=1.0)
    assert m["execution_accuracy"] == 0.0


def test_map_db_names(spark):
    df = spark.createDataFrame([("acronyms",), ("full",), ("other",)], "db_id string")
    out = [r.db_id for r in A.map_db_names(df, {"acronyms": "basket_acronyms", "full": "basket_full"}).collect()]
    assert out == ["basket_acronyms", "basket_full", "other"]


def test_checklist_options(spark):
    from tabulon.plans.checklist import QUESTIONS, drop_tags, generate
    db = C.driver_database(spark, SF_SMALL, ["part", "orders", "customer"])
    cl = generate(db, families=["project", "select", "join", "many-to-many"], column_to_include="P_TYPE",
                  tables_to_include="part")
    rows = cl.collect()
    assert {r.tbl_name for r in rows} == {"part"}
    single = [r for r in rows if r.sql_tag == "SELECT-SINGLE-COL"]
    assert len(single) == 5 and any("`p_type`" in r.query for r in single)
    assert "Show all the rows in the table part" in {r.question for r in rows}
    m2m = [r for r in rows if r.sql_tag == "many-to-many"]
    assert len(m2m) >= 1 and all(r.test_category == "many-to-many-generator" for r in m2m)
    assert drop_tags(cl, ["WHERE-CAT"]).where("sql_tag = 'WHERE-CAT'").count() == 0
    joins = generate(db, families=["join"], tables_to_include=["orders"]).collect()
    assert {r.sql_tag for r in joins} == {"JOIN-PROJECT-ALL", "JOIN-PROJECT-CAT"}
    assert QUESTIONS["JOIN-PROJECT-ALL"].format(t="orders", t2="customer", p="o_custkey") in {r.question for r in joins}


def test_checklist_add_col_and_null_families(spark):
    from tabulon.plans.checklist import generate
    db = C.driver_database(spark, SF_SMALL, ["part"])
    rows = generate(db, families=["project", "null"], add_col=True, drop_empty=False).collect()
    add = sorted(r.query for r in rows if r.sql_tag == "SELECT-ADD-COL")
    # part has 6 classified columns: prefixes of length 1..4 in schema order
    assert add[0] == "SELECT `p_partkey` FROM `part`" and len(add) == 4
    assert "SELECT `p_partkey`, `p_name`, `p_brand`, `p_type` FROM `part`" in add
    nulls = [r for r in rows if r.sql_tag == "NOT-NULL-COUNT"]
    assert len(nulls) == 12 and all(r.test_category == "NULL" for r in nulls)
    assert "Count the rows where the values of p_size are not missing in table part" in {r.question for r in nulls}
    rand = [r for r in rows if r.sql_tag == "SELECT-RANDOM-COL"]
    assert sorted(r.query.count("`") // 2 - 1 for r in rand) == [1, 2, 3, 4, 5]


def test_evaluate_across_databases(spark):
    tests = spark.createDataFrame([
        ("SELECT count(*) AS n FROM lineitem", "SELECT count(*) AS n FROM lineitem", "/root/testdata/sf0.001", "x"),
        ("SELECT count(*) AS n FROM lineitem", "SELECT count(*) AS n FROM orders", "/root/testdata/sf0.01", "y"),
    ], "target string, prediction string, db_path string, note string")
    tests = tests.withColumn("prediction", F.concat(F.col("prediction"), F.lit(" ")))
    got = {r.note: r for r in evaluate(spark, tests, "target", "prediction", db_path_col="db_path").collect()}
    assert got["x"].execution_accuracy == 1.0
    assert got["y"].execution_accuracy == 0.0
