"""Query keys: each runs a library operator over the driver's tables.

``QUERIES[key](spark, sf_dir) -> DataFrame`` and ``ORACLE_SQL[key]`` (DuckDB
SQL over the same tables as views) must give the same rows and column
names. Keys without an oracle are checked on row counts only and are
tested against plain Python on small inputs in ``tests/``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shapes as S
from ..operators.ranking import global_positions
from ..sources import catalog as C
from ..sources import keys as K

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def key(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------ projection

@key("project_all", "SELECT * FROM nation")
def project_all(spark, sf):
    return S.project(t(spark, sf, "nation"))


@key("project_single", "SELECT p_brand FROM part")
def project_single(spark, sf):
    return S.project(t(spark, sf, "part"), "p_brand")


@key("project_combo", "SELECT p_type, p_size, p_brand FROM part")
def project_combo(spark, sf):
    return S.project(t(spark, sf, "part"), ["p_type", "p_size", "p_brand"])


# --------------------------------------------------------------- filters

@key("where_cat_eq", "SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'")
def where_cat_eq(spark, sf):
    return S.filter_eq(t(spark, sf, "orders"), "o_orderpriority", "1-URGENT")


@key("where_cat_ne", "SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'")
def where_cat_ne(spark, sf):
    return S.filter_ne(t(spark, sf, "orders"), "o_orderpriority", "1-URGENT")


@key("where_num_lt", "SELECT * FROM part WHERE p_retailprice < 950")
def where_num_lt(spark, sf):
    return S.filter_lt(t(spark, sf, "part"), "p_retailprice", 950)


@key("where_num_gt", "SELECT * FROM part WHERE p_retailprice > 950")
def where_num_gt(spark, sf):
    return S.filter_gt(t(spark, sf, "part"), "p_retailprice", 950)


_NULL_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@key("null_profile", "SELECT " + ", ".join(
    f"count_if({x} IS NULL) AS null_{x}, count({x}) AS not_null_{x}" for x in _NULL_COLS)
    + " FROM (SELECT c_custkey, c_name, c_nationkey, c_acctbal, "
      "nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)")
def null_profile(spark, sf):
    cust = t(spark, sf, "customer").withColumn(
        "c_mktsegment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return S.null_profile(cust.select(*_NULL_COLS))


# ---------------------------------------------------- distinct and order

@key("distinct_values", "SELECT DISTINCT event_type FROM events")
def distinct_values(spark, sf):
    return S.distinct_values(t(spark, sf, "events"), "event_type")


@key("orderby_all", "SELECT *, row_number() OVER (ORDER BY p_brand DESC NULLS LAST, p_partkey) AS pos FROM part")
def orderby_all(spark, sf):
    # The bare sort is S.order_by; the key makes the order visible as `pos`,
    # with the primary key breaking ties.
    part = t(spark, sf, "part")
    return global_positions(part, [F.col("p_brand").desc_nulls_last(), F.col("p_partkey")])


@key("orderby_project", "SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey) AS pos FROM orders")
def orderby_project(spark, sf):
    o = t(spark, sf, "orders").select("o_orderpriority", "o_orderkey")
    return global_positions(o, [F.col("o_orderpriority").desc_nulls_last(), F.col("o_orderkey")]).drop("o_orderkey")


# ------------------------------------------------------------ aggregates

@key("count_distinct", "SELECT count(DISTINCT p_brand) AS count_distinct_p_brand FROM part")
def count_distinct(spark, sf):
    return S.count_distinct(t(spark, sf, "part"), "p_brand")


@key("agg_minmaxavg", "SELECT max(p_retailprice) AS max_p_retailprice, min(p_retailprice) AS min_p_retailprice, "
     "round_even(avg(p_retailprice), 6) AS avg_p_retailprice FROM part")
def agg_minmaxavg(spark, sf):
    r = S.global_agg(t(spark, sf, "part"), "p_retailprice")
    return r.withColumn("avg_p_retailprice", F.bround("avg_p_retailprice", 6))


@key("groupby_count", "SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def groupby_count(spark, sf):
    return S.group_count(t(spark, sf, "events"), "event_type")


@key("groupby_agg", "SELECT event_type, min(value) AS min_value, max(value) AS max_value, "
     "round_even(avg(value), 6) AS avg_value, round_even(sum(value), 6) AS sum_value FROM events GROUP BY event_type")
def groupby_agg(spark, sf):
    r = S.group_agg(t(spark, sf, "events"), "event_type", "value")
    return (r.withColumn("avg_value", F.bround("avg_value", 6))
             .withColumn("sum_value", F.bround("sum_value", 6)))


@key("having_count_ge", "SELECT l_returnflag FROM lineitem GROUP BY l_returnflag HAVING count(*) >= "
     "(SELECT floor(avg(n)) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag))")
def having_count_ge(spark, sf):
    return S.having_count(t(spark, sf, "lineitem"), "l_returnflag", ">=")


@key("having_count_le", "SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) <= "
     "(SELECT floor(avg(n)) FROM (SELECT count(*) AS n FROM part GROUP BY p_brand))")
def having_count_le(spark, sf):
    return S.having_count(t(spark, sf, "part"), "p_brand", "<=")


@key("having_avg", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment HAVING avg(c_acctbal) >= "
     "(SELECT round_even(avg(a), 2) FROM (SELECT avg(c_acctbal) AS a FROM customer GROUP BY c_mktsegment))")
def having_avg(spark, sf):
    return S.having_agg(t(spark, sf, "customer"), "c_mktsegment", "c_acctbal", "avg", ">=")


@key("having_sum", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment HAVING sum(c_acctbal) <= "
     "(SELECT round_even(avg(s), 2) FROM (SELECT sum(c_acctbal) AS s FROM customer GROUP BY c_mktsegment))")
def having_sum(spark, sf):
    return S.having_agg(t(spark, sf, "customer"), "c_mktsegment", "c_acctbal", "sum", "<=")


@key("group_thresholds", "SELECT (SELECT CAST(floor(avg(n)) AS BIGINT) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)) "
     "AS threshold, round_even(avg(s), 2) AS mean_sum, round_even(avg(a), 2) AS mean_avg "
     "FROM (SELECT sum(c_acctbal) AS s, avg(c_acctbal) AS a FROM customer GROUP BY c_mktsegment)")
def group_thresholds(spark, sf):
    cust = t(spark, sf, "customer")
    size = S.average_group_size(cust, "c_mktsegment").scalar()
    return S.average_group_sum_avg(cust, "c_mktsegment", "c_acctbal").select(
        size.alias("threshold"), "mean_sum", "mean_avg")


@key("many_to_many", "SELECT p_brand FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) = "
     "(SELECT count(DISTINCT p_type) FROM part)")
def many_to_many(spark, sf):
    return S.relational_division(t(spark, sf, "part"), "p_brand", "p_type")


@key("many_to_many_events", "SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = "
     "(SELECT count(DISTINCT event_type) FROM events)")
def many_to_many_events(spark, sf):
    return S.relational_division(t(spark, sf, "events"), "user_id", "event_type")


# ------------------------------------------------------------------ joins

@key("join_all", "SELECT * FROM orders AS T1 JOIN customer AS T2 ON T1.o_custkey = T2.c_custkey")
def join_all(spark, sf):
    return S.join_fk(t(spark, sf, "orders"), t(spark, sf, "customer"), "o_custkey", "c_custkey")


@key("join_cat", "SELECT T1.o_orderpriority, T2.c_mktsegment FROM orders AS T1 JOIN customer AS T2 "
     "ON T1.o_custkey = T2.c_custkey")
def join_cat(spark, sf):
    return S.join_fk(t(spark, sf, "orders"), t(spark, sf, "customer"), "o_custkey", "c_custkey",
                     [("T1", "o_orderpriority"), ("T2", "c_mktsegment")])


@key("join_on_list", "SELECT * FROM labels JOIN documents USING (doc_id)")
def join_on_list(spark, sf):
    return S.join_on_list(t(spark, sf, "labels"), t(spark, sf, "documents"), ["doc_id"])


# --------------------------------------------------------------- samples

@key("sample_categorical", "SELECT 'lang' AS column_name, row_number() OVER (ORDER BY md5('2023' || lang), lang) AS rank, "
     "lang AS value FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) "
     "QUALIFY rank <= 5")
def sample_categorical(spark, sf):
    return C.categorical_samples(t(spark, sf, "documents"), ["lang"], long=True)


@key("sample_numeric", "WITH f AS (SELECT row_number() OVER (ORDER BY doc_id) AS rank, doc_id, n_chars "
     "FROM documents ORDER BY doc_id LIMIT 5) "
     "SELECT 'doc_id' AS column_name, rank, CAST(doc_id AS VARCHAR) AS value FROM f "
     "UNION ALL SELECT 'n_chars', rank, CAST(n_chars AS VARCHAR) FROM f")
def sample_numeric(spark, sf):
    return C.numerical_samples(t(spark, sf, "documents"), ["doc_id", "n_chars"], ["doc_id"], long=True)


# ------------------------------------------------------ result comparison
# Results to compare, derived from `customer`: one test per nation. Target:
# (segment, balance band) rows in key order. Prediction: the rows with a
# non-negative balance, by balance descending, columns swapped (kept in
# place for tuple_order, which compares raw rows).

from ..operators import compare as M  # noqa: E402


def customer_results(spark, sf, swap: bool = True) -> DataFrame:
    cust = t(spark, sf, "customer")
    seg, band = F.col("c_mktsegment").alias("seg"), F.floor(F.col("c_acctbal") / 1000).alias("band")
    tgt = cust.orderBy("c_nationkey", "c_custkey").select("c_nationkey", seg, band)
    pred_cols = [band, seg] if swap else [seg, band]
    prd = (cust.where(F.col("c_acctbal") >= 0)
               .orderBy(F.col("c_nationkey"), F.col("c_acctbal").desc(), F.col("c_custkey"))
               .select("c_nationkey", *pred_cols))
    return (M.capture(tgt, None, "t", test_col="c_nationkey")
             .unionByName(M.capture(prd, None, "p", test_col="c_nationkey")))


def _nation_tests(spark, sf):
    return t(spark, sf, "nation").select(F.col("n_nationkey").alias("test_id"))


def _res_sql(swap: bool) -> str:
    """`res` and `tests` from customer, then the metric CTEs (ending in `m`)."""
    seg = "'2:' || c_mktsegment"
    band = "'1:' || CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) AS VARCHAR)"
    pcells = f"[{band}, {seg}]" if swap else f"[{seg}, {band}]"
    return f"""
res AS (
  SELECT c_nationkey AS test_id, 't' AS side,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos,
         [{seg}, {band}] AS cells FROM customer
  UNION ALL
  SELECT c_nationkey, 'p', row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey),
         {pcells} FROM customer WHERE c_acctbal >= 0),
tests AS (SELECT n_nationkey AS test_id FROM nation),""" + _METRIC_CTES


# The metric definitions over `res(test_id, side, pos, cells)` and
# `tests(test_id)` as SQL CTEs, ending in `m` (one row per test).
_METRIC_CTES = """
sizes AS (SELECT test_id, count_if(side = 't') AS n_t, count_if(side = 'p') AS n_p FROM res GROUP BY test_id),
per_cell AS (SELECT test_id, cell, bool_or(side = 't') AS in_t, bool_or(side = 'p') AS in_p
             FROM (SELECT test_id, side, unnest(list_distinct(cells)) AS cell FROM res) GROUP BY test_id, cell),
cells AS (SELECT test_id, count_if(in_t AND in_p) AS inter, count_if(in_t) AS dt, count_if(in_p) AS dp
          FROM per_cell GROUP BY test_id),
per_row AS (SELECT test_id, list_sort(cells) AS canon, count_if(side = 't') AS a, count_if(side = 'p') AS b
            FROM res GROUP BY test_id, list_sort(cells)),
rowsx AS (SELECT test_id, count_if(a > 0) AS rows_t, count_if(a > 0 AND a = b) AS rows_eq,
                 count_if((a > 0) <> (b > 0)) AS rows_xor FROM per_row GROUP BY test_id),
firsts AS (SELECT test_id, cells, min(pos) FILTER (WHERE side = 't') AS ft, min(pos) FILTER (WHERE side = 'p') AS fp
           FROM res GROUP BY test_id, cells),
common AS (SELECT test_id, row_number() OVER (PARTITION BY test_id ORDER BY ft) AS rt,
                  row_number() OVER (PARTITION BY test_id ORDER BY fp) AS rp
           FROM firsts WHERE ft IS NOT NULL AND fp IS NOT NULL),
ord AS (SELECT test_id, count(*) AS n_common, sum((rt - rp) * (rt - rp)) AS d2 FROM common GROUP BY test_id),
m AS (SELECT tests.test_id, coalesce(n_t, 0) AS n_t, coalesce(n_p, 0) AS n_p, inter, dt, dp, rows_t, rows_eq, rows_xor,
             coalesce(n_common, 0) AS n_common, coalesce(d2, 0) AS d2,
             CASE WHEN coalesce(n_common, 0) = 1 THEN 2 ELSE coalesce(n_common, 0) END AS neff
      FROM tests LEFT JOIN sizes USING (test_id) LEFT JOIN cells USING (test_id)
      LEFT JOIN rowsx USING (test_id) LEFT JOIN ord USING (test_id))"""


def _rule(expr: str) -> str:
    return f"CASE WHEN n_t = 0 AND n_p = 0 THEN 1.0::DOUBLE WHEN n_t = 0 OR n_p = 0 THEN 0.0::DOUBLE ELSE {expr} END"


_METRIC_SQL = {
    "cell_precision": _rule("round_even(inter::DOUBLE / dp::DOUBLE, 3)"),
    "cell_recall": _rule("round_even(inter::DOUBLE / dt::DOUBLE, 3)"),
    "tuple_cardinality": _rule("round_even(least(n_t, n_p)::DOUBLE / greatest(n_t, n_p)::DOUBLE, 3)"),
    "tuple_constraint": _rule("round_even(rows_eq::DOUBLE / rows_t::DOUBLE, 3)"),
    "execution_accuracy": "CASE WHEN n_t = 0 AND n_p = 0 THEN 1.0::DOUBLE WHEN n_t <> n_p THEN 0.0::DOUBLE "
                          "WHEN rows_xor = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "tuple_order": _rule("(round_even(CASE WHEN n_common = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - (6 * d2)::DOUBLE "
                         "/ (neff * (neff * neff - 1))::DOUBLE END, 3) + 1.0::DOUBLE) / 2.0::DOUBLE"),
}


def _metric_key(name: str):
    swap = name != "tuple_order"

    def run(spark, sf):
        res = customer_results(spark, sf, swap)
        return M.metrics(res, _nation_tests(spark, sf), [name]).select("test_id", name)

    sql = f"WITH {_res_sql(swap)} SELECT test_id, {_METRIC_SQL[name]} AS {name} FROM m"
    key(f"metric_{name}", sql)(run)


for _m in M.ALL_METRICS:
    _metric_key(_m)


_ALL_BUT_ORDER = [m for m in M.ALL_METRICS if m != "tuple_order"]


@key("compare_all", f"WITH {_res_sql(True)} SELECT test_id, n_t AS n_target, n_p AS n_prediction, "
     + ", ".join(f"{_METRIC_SQL[m]} AS {m}" for m in _ALL_BUT_ORDER) + " FROM m")
def compare_all(spark, sf):
    return M.metrics(customer_results(spark, sf, True), _nation_tests(spark, sf), _ALL_BUT_ORDER)


# Efficiency: per event type (a test), runs before noon are the target's,
# the others the prediction's; `value` is the run time in seconds.

def event_timings(spark, sf) -> DataFrame:
    ev = t(spark, sf, "events")
    return ev.select(F.col("event_type").alias("test_id"),
                     F.when(F.hour("ts") < 12, F.lit("t")).otherwise(F.lit("p")).alias("side"),
                     F.col("event_id").alias("run"), F.col("value").alias("seconds"))


_TIMINGS_SQL = """
tm AS (SELECT event_type AS test_id, CASE WHEN hour(ts) < 12 THEN 't' ELSE 'p' END AS side,
              event_id AS run, value AS seconds FROM events),
st AS (SELECT test_id, side, avg(seconds) AS mu, stddev_pop(seconds) AS sd FROM tm GROUP BY test_id, side),
tr AS (SELECT test_id, side, avg(seconds) AS mean_seconds FROM tm JOIN st USING (test_id, side)
       WHERE seconds >= mu - 3 * sd AND seconds <= mu + 3 * sd GROUP BY test_id, side)"""


@key("trimmed_mean", f"WITH {_TIMINGS_SQL} SELECT test_id, side, round_even(mean_seconds, 6) AS mean_seconds FROM tr")
def trimmed_mean(spark, sf):
    return M.trimmed_means(event_timings(spark, sf)).withColumn(
        "mean_seconds", F.bround("mean_seconds", 6))


@key("efficiency_score", f"WITH {_TIMINGS_SQL} SELECT test_id, "
     "round_even(sqrt(max(mean_seconds) FILTER (WHERE side = 't') / max(mean_seconds) FILTER (WHERE side = 'p')), 6) "
     "AS valid_efficiency_score FROM tr GROUP BY test_id")
def efficiency_score(spark, sf):
    e = M.efficiency(event_timings(spark, sf))
    return e.select("test_id", F.bround("valid_efficiency_score", 6).alias("valid_efficiency_score"))


# -------------------------------------------------------------- ambiguity
# Tests: one WHERE-CAT test per distinct value of four categorical columns
# (grows with the data). Annotations: a small score matrix over their
# attributes, a parameter of the job.

from ..operators import ambiguity as A  # noqa: E402

# Scores of each label for each of _AMB_COLS, in their order.
AMBIGUITY_MATRIX = [
    ("brand", 3.0, 2.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ("kind", 1.0, 3.0, 0.0, 2.5, 2.0, 0.0, 0.0, 2.5, 0.5, 0.0, 0.0),
    ("urgency", 0.0, 0.0, 3.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ("state", 0.0, 0.0, 1.0, 3.0, 0.0, 2.5, 2.0, 0.0, 0.0, 0.0, 1.0),
    ("speaker", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 3.0, 0.5, 0.0),
    ("tongue", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 3.0, 2.5),
]
_AMB_COLS = [("part", "p_brand"), ("part", "p_type"), ("orders", "o_orderpriority"), ("orders", "o_orderstatus"), ("customer", "c_mktsegment"),
             ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("events", "event_type"), ("conversations", "role"), ("documents", "lang"),
             ("nation", "n_name")]


def value_tests(spark, sf) -> DataFrame:
    parts = []
    for tbl, col in _AMB_COLS:
        v = F.col(col)
        lit_v = F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'"))
        parts.append(t(spark, sf, tbl).select(v).where(v.isNotNull()).distinct().select(
            F.lit("tpch").alias("db_id"), F.lit(tbl).alias("tbl_name"),
            F.concat(F.lit(f"SELECT * FROM `{tbl}` WHERE `{col}` == "), lit_v).alias("query"),
            F.concat(F.lit(f"Show the data of the table {tbl} where {col} is equal to "), v).alias("question")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def annotations(spark) -> DataFrame:
    m = spark.createDataFrame(AMBIGUITY_MATRIX, ["label"] + [c for _, c in _AMB_COLS])
    return A.long_annotations(m, "tpch")


def _amb_values_sql() -> str:
    rows = []
    for li, (label, *scores) in enumerate(AMBIGUITY_MATRIX):
        for ai, ((_, col), sc) in enumerate(zip(_AMB_COLS, scores)):
            rows.append(f"('{label}', {li}, '{col}', {ai}, {float(sc)})")
    return ", ".join(rows)


def _value_tests_sql() -> str:
    parts = []
    for tbl, col in _AMB_COLS:
        parts.append(f"SELECT 'tpch' AS db_id, '{tbl}' AS tbl_name, "
                     f"'SELECT * FROM `{tbl}` WHERE `{col}` == ''' || replace({col}, '''', '''''') || '''' AS query, "
                     f"'Show the data of the table {tbl} where {col} is equal to ' || {col} AS question "
                     f"FROM (SELECT DISTINCT {col} FROM {tbl} WHERE {col} IS NOT NULL)")
    return " UNION ALL ".join(parts)


@key("ambiguity_inject", f"""
WITH ann(label, label_ordinal, attribute, attr_ordinal, score) AS (VALUES {_amb_values_sql()}),
tests AS ({_value_tests_sql()}),
strong AS (SELECT * FROM ann WHERE score >= 2.0),
chosen AS (SELECT * FROM tests t WHERE EXISTS (SELECT 1 FROM strong s WHERE contains(t.query, s.attribute))),
meanings AS (SELECT label, list(attribute ORDER BY attr_ordinal) AS attrs FROM strong GROUP BY label),
cand AS (
  SELECT c.*, replace(c.question, s.attribute, s.label) AS aq, s.attribute AS sa, s.label AS al, m.attrs,
         1 AS k, s.attr_ordinal AS ao, s.label_ordinal AS lo
  FROM chosen c JOIN strong s ON contains(c.question, s.attribute) JOIN meanings m ON m.label = s.label
  UNION ALL
  SELECT c.*, c.question, NULL, NULL, NULL, 0, -1, -1 FROM chosen c),
firsts AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY db_id, aq ORDER BY query, k, ao, lo) = 1)
SELECT db_id, tbl_name, query, question, aq AS ambiguous_question, sa AS swapped_attribute, al AS ambiguous_label,
       array_to_string(attrs, '|') AS ambiguous_attributes,
       array_to_string(list_transform(attrs, lambda a: replace(query, sa, a)), ' || ') AS target_queries
FROM firsts WHERE k = 1""")
def ambiguity_inject(spark, sf):
    tests = value_tests(spark, sf).withColumn("test_id", F.col("query"))
    out = A.ambiguous_tests(tests, annotations(spark), 2.0, order_col="test_id")
    return out.select("db_id", "tbl_name", "query", "question", "ambiguous_question", "swapped_attribute",
                      "ambiguous_label", F.array_join("ambiguous_attributes", "|").alias("ambiguous_attributes"),
                      F.array_join("target_queries", " || ").alias("target_queries"))


@key("ambiguity_best")
def ambiguity_best(spark, sf):
    """Score each ambiguous test's prediction (its own query) against every target; keep the best."""
    from .evaluate import evaluate
    C.driver_database(spark, sf)
    tests = value_tests(spark, sf).withColumn("test_id", F.col("query"))
    amb = A.ambiguous_tests(tests, annotations(spark), 2.0, order_col="test_id")
    pairs = amb.select("ambiguous_question", "query",
                       F.posexplode("target_queries").alias("target_pos", "target_query"))
    # A target may name a column of another table and fail: it scores null
    # and never wins.
    scored = evaluate(spark, pairs, "target_query", "query", on_target_error="null")
    return A.best_of_targets(scored, ["ambiguous_question"])


# -------------------------------------------------------------- responses
# Response texts derived from `conversations`: assistant turns carry a
# python block, a runtime line and an <answer> span; user turns only a
# fenced sql block; system turns are plain text.

from ..functions import responses as RSP  # noqa: E402


def conversation_responses(spark, sf) -> DataFrame:
    cv = t(spark, sf, "conversations")
    txt, role = F.col("text"), F.col("role")
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    resp = (F.when(role == "assistant", F.concat(txt, F.lit("\n```python\nprint("), turn, F.lit(")\n```\nRuntime: "),
                                                   conv, F.lit(".5\n<answer>```sql SELECT "), role,
                                                   F.lit(" FROM t ```</answer>")))
             .when(role == "user", F.concat(F.lit("```sql\n SELECT "), turn, F.lit("\n```\n"), txt))
             .otherwise(txt))
    return cv.select("conv_id", "turn", resp.alias("response"))


_RESP_SQL = """
r AS (SELECT conv_id, turn, CASE
        WHEN role = 'assistant' THEN concat(text, chr(10) || '```python' || chr(10) || 'print(', turn, ')' || chr(10) || '```' || chr(10) || 'Runtime: ',
                                            conv_id, '.5' || chr(10) || '<answer>```sql SELECT ', role, ' FROM t ```</answer>')
        WHEN role = 'user' THEN concat('```sql' || chr(10) || ' SELECT ', turn, chr(10) || '```' || chr(10), text)
        ELSE text END AS response FROM conversations)"""


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@key("parse_answers", f"""
WITH {_RESP_SQL}
SELECT conv_id, turn,
  coalesce({_strip_sql("replace(replace(list_extract(regexp_extract_all(response, '(?s)<answer>(.*?)</answer>', 1), -1), '```', ''), 'sql', '')")},
           {_strip_sql("list_extract(regexp_extract_all(response, '(?s)```sql(.*?)```', 1), -1)")}, response) AS answer,
  {_strip_sql("regexp_extract(response, '(?s)```python\\s+(.*?)```', 1)")} AS code,
  CASE WHEN regexp_extract(response, 'Runtime:\\s*([0-9.]+)', 1) <> ''
       THEN TRY_CAST(regexp_extract(response, 'Runtime:\\s*([0-9.]+)', 1) AS DOUBLE) END AS runtime,
  length(replace(response, '\\n', chr(10))) AS unescaped_length
FROM r""")
def parse_answers(spark, sf):
    r = conversation_responses(spark, sf)
    return r.select("conv_id", "turn", RSP.final_answer("response").alias("answer"),
                    RSP.code_block("response").alias("code"), RSP.runtime_seconds("response").alias("runtime"),
                    F.length(RSP.unescape_newlines("response")).cast("bigint").alias("unescaped_length"))


_PRICE = "CAST(o_totalprice AS VARCHAR)"


@key("parse_rows", "SELECT o_orderkey, "
     f"'[(''' || o_orderpriority || ''', ' || {_PRICE} || ', None), (''' || o_orderstatus || ''', True, 1)]' AS span, "
     f"""'[["' || o_orderpriority || '","' || {_PRICE} || '",null],["' || o_orderstatus || '","true","1"]]' """
     "AS rows_json, 0.25::DOUBLE AS runtime FROM orders")
def parse_rows(spark, sf):
    """Tool output printing a result as a Python list, parsed back to rows (orders as the result)."""
    o = t(spark, sf, "orders")
    printed = F.concat(F.lit("result: [('"), F.col("o_orderpriority"), F.lit("', "), F.col("o_totalprice").cast("string"),
                       F.lit(", None), ('"), F.col("o_orderstatus"), F.lit("', True, 1)] Runtime: 0.25"))
    out = o.select("o_orderkey", printed.alias("printed"))
    out = RSP.parse_rows(out.withColumn("span", RSP.balanced_span("printed")), "span", "rows", span=False)
    return out.select("o_orderkey", "span", F.to_json("rows").alias("rows_json"),
                      RSP.runtime_seconds("printed").alias("runtime"))


@key("parse_layouts", r"""
SELECT o_orderkey, 'column' AS layout, '[["' || o_orderpriority || '"],["it''s"]]' AS rows_json FROM orders
UNION ALL SELECT o_orderkey, 'row', '[["' || o_orderkey || '9007199254740993","' || o_orderkey || '.12345678901234567890",null]]' FROM orders
UNION ALL SELECT o_orderkey, 'nested', '[["' || o_orderstatus || '","[\"a\",\"1\"]"],["say \"A\"","\\"]]' FROM orders""")
def parse_layouts(spark, sf):
    """Results printed as one-column tuples, as a single row with long numbers, and as lists with nesting and escapes."""
    o = t(spark, sf, "orders")
    number, text, status = F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.col("o_orderstatus")
    layouts = {"column": F.concat(F.lit("result [('"), text, F.lit("""',), ("it's",)] end""")),
               "row": F.concat(F.lit("["), number, F.lit("9007199254740993, "), number, F.lit(".12345678901234567890, None,]")),
               "nested": F.concat(F.lit("[['"), status, F.lit(r"""', ['a', 1]], ['say "\x41"', '\\'],]"""))}
    out = o.select("o_orderkey", F.explode(F.create_map(*[x for k, v in layouts.items() for x in (F.lit(k), v)])).alias("layout", "printed"))
    return RSP.parse_rows(out, "printed").select("o_orderkey", "layout", F.to_json("rows").alias("rows_json"))


_PREFIX = r"regexp_replace(array_to_string(lines[1:m], ' '), '^\s+|\s+$', '', 'g')"
_PREFIX_WORDS = rf"(CASE WHEN {_PREFIX} = '' THEN 0 ELSE len(regexp_split_to_array({_PREFIX}, '\s+')) END)"


@key("token_crop", f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
chain(doc_id, lines, m, done) AS (
  SELECT doc_id, lines, len(lines), false FROM d
  UNION ALL
  SELECT doc_id, lines, CASE WHEN stop THEN m ELSE CAST(round_even(m / 2.0, 0) AS INTEGER) END, stop
  FROM (SELECT doc_id, lines, m, (m <= 4 OR {_PREFIX_WORDS} <= 2048) AS stop FROM chain WHERE NOT done))
SELECT doc_id, CAST(max(len(lines)) AS INTEGER) AS n_lines, CAST(min(m) AS INTEGER) AS kept_lines
FROM chain GROUP BY doc_id""")
def token_crop(spark, sf):
    """Lines of every document cropped to a 2,048-word budget by halving (whole texts)."""
    d = t(spark, sf, "documents").select("doc_id", F.split(F.col("text"), "\n").alias("lines"))
    kept = RSP.crop_entries(d, "lines", "kept", 2048, 4)
    return kept.select("doc_id", F.size("lines").alias("n_lines"), F.size("kept").alias("kept_lines"))


@key("prompt_table")
def prompt_table(spark, sf):
    """Prompts for the value tests of the tables in _PROMPT_COLS, with their first records."""
    db = C.driver_database(spark, sf, list(_PROMPT_COLS))
    cat = C.schema_rows(spark, db.tables, db.primary_keys)
    samples = RSP.sample_rows(db.tables, 3, db.primary_keys)
    tests = value_tests(spark, sf).where(F.col("tbl_name").isin(*_PROMPT_COLS))
    return RSP.prompt_table(tests, RSP.schema_text(cat), samples, RSP.PROMPTS["text2sql"]).select(
        "tbl_name", "query", "prompt")


@key("clamped_score", "SELECT vec_id, round_even(CASE WHEN coalesce(len(embedding), 0) = 0 THEN 0.0 ELSE "
     "greatest(0.0, least(1.0, (list_reduce(list_transform(embedding, lambda x: x::DOUBLE), lambda a, b: a + b) - 1.0) / 9.0)) END, 6) "
     "AS score FROM embeddings")
def clamped_score(spark, sf):
    # Each row's own list (an embedding vector); no grouping.
    e = t(spark, sf, "embeddings")
    return e.select("vec_id", F.bround(RSP.clamped_score("embedding"), 6).alias("score"))


# ------------------------------------------------------- catalog and keys

_SCHEMAS = {
    "region": [("r_regionkey", "numerical"), ("r_name", "categorical")],
    "nation": [("n_nationkey", "numerical"), ("n_name", "categorical"), ("n_regionkey", "numerical")],
    "customer": [("c_custkey", "numerical"), ("c_name", "categorical"), ("c_nationkey", "numerical"),
                 ("c_acctbal", "numerical"), ("c_mktsegment", "categorical")],
    "supplier": [("s_suppkey", "numerical"), ("s_name", "categorical"), ("s_nationkey", "numerical"),
                 ("s_acctbal", "numerical")],
    "part": [("p_partkey", "numerical"), ("p_name", "categorical"), ("p_brand", "categorical"),
             ("p_type", "categorical"), ("p_size", "numerical"), ("p_retailprice", "numerical")],
    "orders": [("o_orderkey", "numerical"), ("o_custkey", "numerical"), ("o_orderstatus", "categorical"),
               ("o_totalprice", "numerical"), ("o_orderpriority", "categorical")],
    "lineitem": [("l_orderkey", "numerical"), ("l_partkey", "numerical"), ("l_suppkey", "numerical"),
                 ("l_linenumber", "numerical"), ("l_quantity", "numerical"), ("l_extendedprice", "numerical"),
                 ("l_discount", "numerical"), ("l_tax", "numerical"), ("l_returnflag", "categorical"),
                 ("l_linestatus", "categorical")],
    "events": [("event_id", "numerical"), ("user_id", "numerical"), ("event_type", "categorical"),
               ("value", "numerical"), ("props", "categorical")],
    "documents": [("doc_id", "numerical"), ("text", "categorical"), ("lang", "categorical"),
                  ("source", "categorical"), ("n_chars", "numerical")],
    "embeddings": [("vec_id", "numerical"), ("label", "numerical")],
    "pages": [("page_id", "numerical"), ("url", "categorical"), ("html", "categorical")],
    "benchmark": [("item_id", "numerical"), ("text", "categorical")],
    "labels": [("doc_id", "numerical"), ("quality", "numerical"), ("toxic", "numerical")],
    "conversations": [("conv_id", "numerical"), ("turn", "numerical"), ("role", "categorical"),
                      ("text", "categorical")],
}


@key("catalog_profile", " UNION ALL ".join(
    f"SELECT '{tb}' AS tbl_name, '{c}' AS column_name, '{k}' AS column_type, count({c}) AS n_values, "
    f"count(DISTINCT {c}) AS n_distinct FROM {tb}" for tb, cols in _SCHEMAS.items() for c, k in cols))
def catalog_profile(spark, sf):
    return C.profile(C.load_tables(spark, sf, C.DRIVER_TABLES))


_DECLARED_FK_SQL = ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in C.DRIVER_FOREIGN_KEYS)
_PK_SQL = ", ".join(f"('{tb}', '{k[0]}')" for tb, k in C.DRIVER_PRIMARY_KEYS.items() if len(k) == 1)
_NO_KEYS = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value"}
_KEY_COLS = [(tb, c, k[0]) for tb, cols in _SCHEMAS.items() for c, k in cols if c not in _NO_KEYS]

# Every value of every column that can be a key, with its count; per column sums; pairs of columns by common values.
_KEY_CTES = f"""
cols(col, tbl_name, column_name) AS (VALUES {", ".join(f"({i}, '{tb}', '{c}')" for i, (tb, c, _) in enumerate(_KEY_COLS))}),
v AS MATERIALIZED ({" UNION ALL ".join(f"SELECT {i} AS col, '{k}' AS kind, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {tb} WHERE {c} IS NOT NULL GROUP BY {c}"
                          for i, (tb, c, k) in enumerate(_KEY_COLS))}),
per AS (SELECT col, CAST(sum(n) AS BIGINT) AS n_values, count(*) AS n_distinct, count(*) FILTER (n > 1) AS n_repeated FROM v GROUP BY col),
common AS MATERIALIZED (SELECT a.col AS a, b.col AS b, count(*) AS k, CAST(sum(a.n) AS BIGINT) AS n FROM v a JOIN v b ON a.kind = b.kind AND a.value = b.value AND a.col <> b.col GROUP BY ALL),
inside AS (SELECT a, b FROM common JOIN per ON a = col WHERE k = n_distinct)"""


@key("column_keys", f"""
WITH {_KEY_CTES}
SELECT c.tbl_name, c.column_name, coalesce(n_values, 0) AS n_values, coalesce(n_distinct, 0) AS n_distinct, coalesce(n_repeated, 0) AS n_repeated,
       coalesce(n_repeated, 1) = 0 AS is_unique, coalesce(i.included_in, '') AS included_in
FROM cols c LEFT JOIN per USING (col)
LEFT JOIN (SELECT a AS col, string_agg(o.tbl_name || '.' || o.column_name, ',' ORDER BY o.tbl_name || '.' || o.column_name) AS included_in
           FROM inside JOIN cols o ON o.col = b GROUP BY a) i USING (col)""")
def column_keys(spark, sf):
    """Unique columns and inclusion dependencies of all tables, from their rows."""
    got = K.column_keys(C.load_tables(spark, sf, C.DRIVER_TABLES))
    return got.withColumn("included_in", F.array_join("included_in", ","))


@key("foreign_keys", f"""
WITH {_KEY_CTES},
pks(child_table, child_column) AS (VALUES {_PK_SQL}),
declared(tbl_name, parent_column, child_table, child_column) AS (VALUES {_DECLARED_FK_SQL}),
named AS (SELECT c.tbl_name, c.column_name AS parent_column, p.child_table, p.child_column FROM cols c JOIN pks p ON c.column_name = p.child_column
          WHERE c.tbl_name <> p.child_table EXCEPT SELECT * FROM declared),
found AS (SELECT x.tbl_name, x.column_name AS parent_column, y.tbl_name AS child_table, y.column_name AS child_column
          FROM inside JOIN cols x ON x.col = a JOIN cols y ON y.col = b JOIN per ON per.col = b WHERE n_repeated = 0 AND x.tbl_name <> y.tbl_name
          EXCEPT (SELECT * FROM declared UNION ALL SELECT * FROM named)),
pairs AS (SELECT *, 'declared' AS origin FROM declared UNION ALL SELECT *, 'name' FROM named UNION ALL SELECT *, 'data' FROM found)
SELECT p.*, coalesce(x.n_values, 0) AS n_references, coalesce(x.n_values, 0) - coalesce(common.n, 0) AS n_orphans, coalesce(y.n_repeated, 0) AS n_repeated
FROM pairs p JOIN cols a ON a.tbl_name = p.tbl_name AND a.column_name = p.parent_column
JOIN cols b ON b.tbl_name = p.child_table AND b.column_name = p.child_column
LEFT JOIN per x ON x.col = a.col LEFT JOIN per y ON y.col = b.col LEFT JOIN common ON common.a = a.col AND common.b = b.col""")
def foreign_keys(spark, sf):
    """Foreign keys, declared, by name and found in the rows, with referring rows, orphans and repeated referred values."""
    return K.references(C.load_tables(spark, sf, C.DRIVER_TABLES), C.DRIVER_PRIMARY_KEYS, C.DRIVER_FOREIGN_KEYS)


@key("primary_keys", " UNION ALL ".join(
    f"SELECT '{tb}' AS tbl_name, '{','.join(k)}' AS key_columns, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, "
    f"CAST(coalesce(sum(n) FILTER ({' OR '.join(f'{c} IS NULL' for c in k)}), 0) AS BIGINT) AS n_null, "
    f"count(*) FILTER (n > 1 AND {' AND '.join(f'{c} IS NOT NULL' for c in k)}) AS n_repeated "
    f"FROM (SELECT {', '.join(k)}, count(*) AS n FROM {tb} GROUP BY ALL)" for tb, k in C.DRIVER_PRIMARY_KEYS.items()))
def primary_keys(spark, sf):
    """Declared primary keys against the rows: nulls and key values that repeat."""
    return K.primary_key_checks(C.load_tables(spark, sf, list(C.DRIVER_PRIMARY_KEYS)), C.DRIVER_PRIMARY_KEYS)


@key("checklist")
def checklist(spark, sf):
    from .checklist import DEFAULT_FAMILIES, generate
    return generate(C.driver_database(spark, sf), families=[*DEFAULT_FAMILIES, "null"])


@key("evaluate_checklist")
def evaluate_checklist(spark, sf):
    """Score a rewritten prediction (ASC and DESC swapped, >= relaxed to >) for every test of all tables."""
    from .checklist import DEFAULT_FAMILIES, generate
    from .evaluate import evaluate
    tests = generate(C.driver_database(spark, sf), families=[*DEFAULT_FAMILIES, "null"])
    swapped = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        "query", " ASC$", " __D"), " DESC$", " ASC"), " __D$", " DESC")
    pred = F.replace(swapped, F.lit(">="), F.lit(">"))
    return evaluate(spark, tests.withColumn("prediction", pred), "query", "prediction")


def _gold_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT 'SELECT * FROM `{tbl}` WHERE `{col}` == ''' || replace({col}, '''', '''''') || '''' "
        f"AS query, count(*) AS n_rows FROM {tbl} WHERE {col} IS NOT NULL GROUP BY {col}" for tbl, col in _AMB_COLS)


def _gold_counts(spark, tests):
    from .evaluate import gold_answers as gold, with_test_ids
    tests = with_test_ids(tests)
    res, errors = gold(spark, tests, "query")
    # a query that fails has no answer, which is not an answer without rows
    bad = errors.join(tests.select("test_id", "query"), "test_id").orderBy("test_id").limit(20).collect()
    if bad:
        raise ValueError(f"{errors.count()} queries have no answer, the first of them {[(r['query'], r['error']) for r in bad]}")
    counts = res.groupBy("test_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return (tests.join(counts, "test_id", "left")
                 .select("query", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows")))


@key("gold_answers", _gold_sql())
@key("gold_answers_all", _gold_sql())
def gold_answers(spark, sf):
    """Run every data-derived test query of all tables once; rows per answer."""
    C.driver_database(spark, sf)
    return _gold_counts(spark, value_tests(spark, sf))


# ------------------------------------------------------- sources and sinks

from ..sources import io as IO  # noqa: E402

_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@key("insert_lines", "SELECT 'INSERT INTO orders (" + ", ".join(f'"{c}"' for c in _ORDER_COLS) + ") VALUES (' || "
     "o_orderkey || ', ' || o_custkey || ', ''' || replace(o_orderstatus, '''', '''''') || ''', ' || o_totalprice || "
     "', ' || o_orderdate || ', ''' || replace(o_orderpriority, '''', '''''') || ''');' AS line "
     "FROM orders ORDER BY o_orderkey LIMIT 10")
def insert_lines(spark, sf):
    return IO.insert_lines(t(spark, sf, "orders"), "orders", 10, ["o_orderkey"])


_SINGLE_PK = [(tb, k[0]) for tb, k in C.DRIVER_PRIMARY_KEYS.items() if len(k) == 1]


@key("sub_database", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{tb}' AS tbl_name, CAST({k} AS BIGINT) AS key_value FROM {tb} ORDER BY {k} LIMIT 10)"
    for tb, k in _SINGLE_PK))
def sub_database(spark, sf):
    """First 10 rows of every keyed table written as a new database, read back (keys shown)."""
    from ..session import work_dir
    tables = C.load_tables(spark, sf, [tb for tb, _ in _SINGLE_PK], register=False)
    out = work_dir(spark, "subdb")
    written = IO.sub_database(tables, out, 10, dict(C.DRIVER_PRIMARY_KEYS))
    parts = [spark.read.parquet(p).select(F.lit(tb).alias("tbl_name"),
                                          F.col(C.DRIVER_PRIMARY_KEYS[tb][0]).cast("bigint").alias("key_value"))
             for tb, p in written.items()]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


# ------------------------------------------------- more sources and plans

@key("csv_source", "SELECT o_orderpriority, count(*) AS n, round_even(sum(o_totalprice), 2) AS total "
     "FROM orders GROUP BY o_orderpriority")
def csv_source(spark, sf):
    """`orders` written as a CSV file, opened as a database from CSV files, queried with SQL."""
    from ..session import work_dir
    from ..sources.sql import sql_frame
    path = work_dir(spark, "csv") + "/orders_csv"
    t(spark, sf, "orders").write.option("header", True).csv(path)
    IO.database_from_csv(spark, [path])
    return sql_frame(spark, "SELECT o_orderpriority, count(*) AS n, bround(sum(o_totalprice), 2) AS total "
                            "FROM orders_csv GROUP BY o_orderpriority")


@key("json_source", "SELECT role, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY role")
def json_source(spark, sf):
    """`conversations` written as JSON records with upper-case names, read back (names lower-cased)."""
    from ..session import work_dir
    path = work_dir(spark, "json")
    cv = t(spark, sf, "conversations")
    IO.write_table(cv.toDF(*[c.upper() for c in cv.columns]), path, "json")
    back = IO.read_json_records(spark, path)
    return back.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# Tags dropped before injecting ambiguity (fixed values of the original pipeline).
AMBIGUITY_DROP_TAGS = ["HAVING-AGG-SUM-LS", "HAVING-AGG-AVG-LS", "DISTINCT-MULT", "WHERE-CAT-LEAST-FREQUENT",
                       "WHERE-NOT-LEAST-FREQUENT", "WHERE-NOT-MOST-FREQUENT", "HAVING-COUNT-LS", "HAVING-COUNT-GR",
                       "WHERE-NUM-MIN-VALUES", "WHERE-NUM-MAX-VALUES", "HAVING-AGG-AVG-GR"]


@key("ambiguity_pipeline")
def ambiguity_pipeline(spark, sf):
    """End to end: checklist of all tables -> drop tags -> inject ambiguity."""
    from .checklist import DEFAULT_FAMILIES, drop_tags, generate
    db = C.driver_database(spark, sf, db_name="tpch")
    tests = drop_tags(generate(db, families=[*DEFAULT_FAMILIES, "null"]), AMBIGUITY_DROP_TAGS)
    tests = tests.withColumn("test_id", F.xxhash64("tbl_name", "sql_tag", "query", "question"))
    out = A.ambiguous_tests(tests, annotations(spark), 2.0)
    return out.select("tbl_name", "sql_tag", "query", "ambiguous_question", "swapped_attribute", "ambiguous_label",
                      F.array_join("target_queries", " || ").alias("target_queries"))


@key("table_from_json", "SELECT o_orderkey, 0 AS row_pos, CAST(o_orderkey AS VARCHAR) AS key, "
     "o_orderstatus AS status FROM orders")
def table_from_json(spark, sf):
    """Responses holding an order as a one-record JSON table, read back as records."""
    o = t(spark, sf, "orders")
    body = F.concat(F.lit("Table Name: orders.csv\n<json>[{'key': '"), F.col("o_orderkey").cast("string"),
                    F.lit("', 'status': '"), F.col("o_orderstatus"), F.lit("'}]</json>"))
    recs = RSP.table_from_json(o.select("o_orderkey", body.alias("response")), "response", "o_orderkey")
    return recs.select("o_orderkey", "row_pos", F.col("record")["key"].alias("key"),
                       F.col("record")["status"].alias("status"))


@key("cost_summary", "SELECT event_type AS model, round_even(sum(value), 6) AS total_cost, "
     "round_even(avg(value / 10), 6) AS mean_time, count(*) AS n, "
     "round_even(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 6) AS mean_execution_accuracy "
     "FROM events GROUP BY event_type")
def cost_summary(spark, sf):
    """Events read as model calls: type as model, value as cost, value/10 as time, value >= 50 as a pass."""
    ev = t(spark, sf, "events").select(F.col("event_type").alias("model"), F.col("value").alias("cost"),
                                       (F.col("value") / 10).alias("time"),
                                       F.when(F.col("value") >= 50, 1.0).otherwise(0.0).alias("execution_accuracy"))
    s = RSP.cost_summary(ev, ["execution_accuracy"])
    return s.select("model", F.bround("total_cost", 6).alias("total_cost"), F.bround("mean_time", 6).alias("mean_time"),
                    "n", F.bround("mean_execution_accuracy", 6).alias("mean_execution_accuracy"))


_ANSWER_METRICS = ["cell_precision", "cell_recall", "tuple_cardinality", "tuple_constraint", "execution_accuracy"]


@key("evaluate_answers", "WITH per AS (SELECT o_orderstatus AS test_id, count(*) AS n, max(o_orderpriority) AS top "
     "FROM orders GROUP BY o_orderstatus), "
     "res AS (SELECT test_id, 't' AS side, 1 AS pos, ['1:' || n] AS cells FROM per "
     "UNION ALL SELECT test_id, 'p', 1, ['1:' || n, '2:' || top] FROM per), "
     "tests AS (SELECT test_id FROM per)," + _METRIC_CTES
     + " SELECT 'SELECT count(*) AS n FROM orders WHERE o_orderstatus == ''' || test_id || '''' AS target, "
     + ", ".join(f"{_METRIC_SQL[m]} AS {m}" for m in _ANSWER_METRICS)
     + ", NULL::DOUBLE AS tuple_order FROM m")
def evaluate_answers(spark, sf):
    """Text answers scored against SQL targets: per order status, the target counts the
    orders; the printed answer gives that count and the highest priority, parsed into rows."""
    from .evaluate import evaluate
    C.driver_database(spark, sf, ["orders"])
    per = t(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderpriority").alias("top"))
    tests = per.select(
        F.concat(F.lit("SELECT count(*) AS n FROM orders WHERE o_orderstatus == '"), F.col("o_orderstatus"),
                 F.lit("'")).alias("target"),
        F.concat(F.lit("The answer is [["), F.col("n").cast("string"), F.lit(", '"), F.col("top"),
                 F.lit("']] Runtime: 0.1")).alias("response"))
    tests = tests.withColumn("prediction", RSP.rows_from_text("response"))
    scored = evaluate(spark, tests.drop("response"), "target", "prediction")
    return scored.select("target", *_ANSWER_METRICS, "tuple_order")


@key("evaluate_exact_answers", "WITH per AS (SELECT o_orderstatus AS test_id, count(*) + 9007199254740992 AS n FROM orders GROUP BY o_orderstatus), "
     "res AS (SELECT test_id, 't' AS side, 1 AS pos, ['1:' || n] AS cells FROM per "
     "UNION ALL SELECT test_id, 'p', 1, ['1:' || CASE WHEN test_id = 'O' THEN n + 1 ELSE n END] FROM per), "
     "tests AS (SELECT test_id FROM per)," + _METRIC_CTES
     + " SELECT 'SELECT count(*) + 9007199254740992 AS n FROM orders WHERE o_orderstatus == ''' || test_id || '''' AS target, "
     + ", ".join(f"{_METRIC_SQL[m]} AS {m}" for m in _ANSWER_METRICS) + " FROM m")
def evaluate_exact_answers(spark, sf):
    """Printed one-column answers beyond 2^53 against SQL targets; the answer for status O is off by one."""
    from .evaluate import evaluate
    C.driver_database(spark, sf, ["orders"])
    per = t(spark, sf, "orders").groupBy("o_orderstatus").agg((F.count(F.lit(1)) + 9007199254740992).alias("n"))
    given = F.when(F.col("o_orderstatus") == "O", F.col("n") + 1).otherwise(F.col("n"))
    tests = per.select(F.concat(F.lit("SELECT count(*) + 9007199254740992 AS n FROM orders WHERE o_orderstatus == '"), F.col("o_orderstatus"), F.lit("'")).alias("target"),
                       RSP.typed_rows(F.concat(F.lit("[("), given.cast("string"), F.lit(",)]"))).alias("prediction"))
    return evaluate(spark, tests, "target", "prediction", _ANSWER_METRICS).select("target", *_ANSWER_METRICS)


_ORDER_RES = """res AS (
  SELECT n_regionkey AS test_id, 't' AS side, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS pos, ['2:' || n_name] AS cells FROM nation
  UNION ALL
  SELECT n_regionkey, 'p', row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE WHEN n_regionkey % 2 = 0 THEN n_nationkey ELSE -n_nationkey END), ['2:' || n_name]
  FROM nation WHERE n_nationkey % 7 > 0),
tests AS (SELECT r_regionkey AS test_id FROM region),"""


@key("evaluate_ordered", f"WITH {_ORDER_RES} {_METRIC_CTES} "
     "SELECT 'SELECT n_name FROM nation WHERE n_regionkey = ' || test_id || ' ORDER BY n_name' AS target, "
     f"{_METRIC_SQL['tuple_order']} AS tuple_order, {_METRIC_SQL['cell_recall']} AS cell_recall FROM m")
def evaluate_ordered(spark, sf):
    """Targets with ORDER BY: per region its nations by name, predicted by key, up or down, without some."""
    from .evaluate import evaluate
    C.driver_database(spark, sf, ["nation", "region"])
    k = F.col("r_regionkey").cast("string")
    way = F.when(F.col("r_regionkey") % 2 == 0, F.lit("ASC")).otherwise(F.lit("DESC"))
    tests = t(spark, sf, "region").select(
        F.concat(F.lit("SELECT n_name FROM nation WHERE n_regionkey = "), k, F.lit(" ORDER BY n_name")).alias("target"),
        F.concat(F.lit("SELECT n_name FROM nation WHERE n_regionkey = "), k, F.lit(" AND n_nationkey % 7 > 0 ORDER BY n_nationkey "), way).alias("prediction"))
    return evaluate(spark, tests, "target", "prediction", ["tuple_order", "cell_recall"]).select("target", "tuple_order", "cell_recall")


# Columns of the prompt tables, for the oracle's record text ("str" is quoted).
_PROMPT_COLS = {
    "nation": [("n_nationkey", "num"), ("n_name", "str"), ("n_regionkey", "num")],
    "customer": [("c_custkey", "num"), ("c_name", "str"), ("c_nationkey", "num"), ("c_acctbal", "num"), ("c_mktsegment", "str")],
    "part": [("p_partkey", "num"), ("p_name", "str"), ("p_brand", "str"), ("p_type", "str"), ("p_size", "num"),
             ("p_retailprice", "num")],
    "orders": [("o_orderkey", "num"), ("o_custkey", "num"), ("o_orderstatus", "str"), ("o_totalprice", "num"),
               ("o_orderdate", "num"), ("o_orderpriority", "str")],
}


def _record_sql(cols) -> str:
    items = []
    for c, kind in cols:
        v = f"'''' || replace({c}, '''', '\\''') || ''''" if kind == "str" else f"CAST({c} AS VARCHAR)"
        items.append(f"'''{c}'': ' || coalesce({v}, 'None')")
    return "'{' || " + " || ', ' || ".join(items) + " || '}'"


def _prompt_sql() -> str:
    samp = " UNION ALL ".join(
        f"SELECT '{tb}' AS tbl_name, '[' || string_agg(rec, ', ' ORDER BY k) || ']' AS entries FROM "
        f"(SELECT {cols[0][0]} AS k, {_record_sql(cols)} AS rec FROM {tb} ORDER BY {cols[0][0]} LIMIT 3)"
        for tb, cols in _PROMPT_COLS.items())
    sch = " UNION ALL ".join(
        f"SELECT '{tb}' AS tbl_name, 'Table {tb}(" + ", ".join(f"{c} {k}" for c, k in _SCHEMAS[tb]) + ")' AS db_schema"
        for tb in _PROMPT_COLS)
    template = RSP.PROMPTS["text2sql"].replace("'", "''")
    return (f"WITH samp AS ({samp}), sch AS ({sch}), tests AS ({_value_tests_sql()}) "
            f"SELECT t.tbl_name, t.query, replace(replace('{template}', '{{db_schema}}', sch.db_schema), "
            f"'{{question}}', t.question) || ' Some instances: ' || samp.entries AS prompt "
            f"FROM tests t JOIN sch ON sch.tbl_name = t.tbl_name JOIN samp ON samp.tbl_name = t.tbl_name")


# Registered here: the oracle needs the schema table defined above.
ORACLE_SQL["prompt_table"] = _prompt_sql()
