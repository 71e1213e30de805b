"""Result comparison: many (target, prediction) result pairs in one job.

Results live in one long table ``res(test_id, side, pos, cells)``: ``side``
is ``'t'`` (target) or ``'p'`` (prediction), ``pos`` increases along the
result's row order, ``cells`` holds the canonical cell keys of one row
(:mod:`tabulon.functions.cells`). Every metric is an aggregate over that
table keyed by ``test_id``; nothing is collected and no step holds a whole
test in one task:

* cells      -> group by (test_id, cell): in target / in prediction
* rows       -> group by (test_id, sorted cells): multiplicity per side
* order      -> group by (test_id, raw cells): first position per side,
                then dense ranks along a range-partitioned global sort
                (:mod:`tabulon.operators.ranking`)
* sizes      -> summed from the rows aggregate

The per-test results (one row per test) are joined to the tests table,
which also supplies tests whose two results are both empty.

Definitions (``round`` is half-to-even, ``bround``):

* cell_precision  |distinct target cells ∩ distinct predicted cells| / |distinct predicted cells|
* cell_recall     same over the distinct target cells
* tuple_cardinality  min(rows) / max(rows)
* tuple_constraint   share of distinct canonical target rows whose count is equal in both
* execution_accuracy 1 if the row counts are equal and the sets of canonical rows are equal
* tuple_order     Spearman's rho over the common raw rows (first occurrences),
                  n at least 2, 0 when nothing is common, mapped to (rho + 1) / 2
* both results empty -> 1.0; exactly one empty -> 0.0 (all metrics)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import as_text_cells, literal_cell_key, row_cells
from .ranking import group_positions

ALL_METRICS = ["cell_precision", "cell_recall", "tuple_cardinality", "tuple_order",
               "tuple_constraint", "execution_accuracy"]


# ------------------------------------------------------------------ capture

def capture(df: DataFrame, test_id, side: str, test_col: str | None = None) -> DataFrame:
    """One query result as ``res`` rows.

    ``test_id`` is a literal, or ``test_col`` names a column of ``df`` that
    holds it (then the other columns are the result). Columns are renamed by
    position first, so repeated names (``SELECT *`` over a join) are fine.
    ``pos`` is ``monotonically_increasing_id`` taken directly above the
    result's plan: it rises along partitions and within them, so it follows
    a sort's order.
    """
    n = len(df.columns)
    names = [f"c{i}" for i in range(n)]
    renamed = df.toDF(*names)
    if test_col is not None:
        idx = df.columns.index(test_col)
        tid = F.col(names[idx])
        names = names[:idx] + names[idx + 1:]
    else:
        tid = F.lit(test_id)
    return renamed.select(tid.alias("test_id"), F.lit(side).alias("side"),
                          F.monotonically_increasing_id().alias("pos"),
                          row_cells(renamed.schema, names).alias("cells"))


def capture_literal(df: DataFrame, rows_col: str, test_col: str, side: str) -> DataFrame:
    """Literal results (``array<array<string>>`` per test) as ``res`` rows.

    The row order of the literal is kept as ``pos``; cells are text, where
    what reads as a number compares by value, or ``struct<text, quoted>``,
    where quoted cells compare as text.
    """
    kind = df.schema[rows_col].dataType.elementType.elementType
    return (df.select(F.col(test_col).alias("test_id"),
                      F.posexplode(F.col(rows_col)).alias("pos", "row"))
              .select("test_id", F.lit(side).alias("side"), F.col("pos").cast("bigint").alias("pos"),
                      F.transform("row", lambda x: literal_cell_key(x, kind)).alias("cells")))


# ------------------------------------------------------------------ metrics

@dataclass
class Metric:
    """A caller's metric: aggregates over a test's distinct canonical rows, and the value from them.

    ``parts`` name aggregate expressions over ``canon`` (a row's sorted cell keys), ``a`` and ``b`` (how often the target and the
    prediction hold it); ``value`` gets their columns, and ``n_t`` and ``n_p``, the results' row counts. With ``rule`` two empty
    results score 1 and one empty result 0, as for the other metrics.
    """

    parts: dict[str, Callable[[], Column]]
    value: Callable[[dict[str, Column]], Column]
    rule: bool = True


#: Metrics that callers added by name.
METRICS: dict[str, Metric] = {}


def register_metric(name: str, parts: dict[str, Callable[[], Column]], value: Callable[[dict[str, Column]], Column], rule: bool = True) -> None:
    """Offer a metric to ``metrics``, ``compare`` and the evaluator under ``name``; it is computed in the same job as the others."""
    if name in ALL_METRICS:
        raise ValueError(f"{name} is a metric of the library")
    METRICS[name] = Metric(parts, value, rule)


def _ratio(num: Column, den: Column) -> Column:
    return F.bround(num.cast("double") / den.cast("double"), 3)


def metrics(res: DataFrame, tests: DataFrame, names: list[str] | None = None, ordered: DataFrame | None = None) -> DataFrame:
    """Per ``test_id`` of ``tests``: the chosen metrics (doubles) plus n_target, n_prediction.

    Only the sub-aggregates the chosen metrics need are planned. ``ordered(test_id)`` names the tests whose ``tuple_order`` is
    wanted (by default all): the rows of others are not ranked.
    """
    names = list(names or ALL_METRICS)
    tid = tests.select("test_id").distinct()
    # One aggregate by (test, canonical row) gives the multiplicities on both
    # sides; the row counts per test and the set comparisons derive from it.
    per_row = (res.groupBy("test_id", F.array_sort("cells").alias("canon"))
               .agg(F.count_if(F.col("side") == "t").alias("a"),
                    F.count_if(F.col("side") == "p").alias("b")))
    own = {n: METRICS[n] for n in names if n not in ALL_METRICS}
    rows = per_row.groupBy("test_id").agg(
        *[make().alias(f"{n}.{part}") for n, m in own.items() for part, make in m.parts.items()],
        F.sum("a").alias("n_t"), F.sum("b").alias("n_p"),
        F.count_if(F.col("a") > 0).alias("rows_t"),
        F.count_if((F.col("a") > 0) & (F.col("a") == F.col("b"))).alias("rows_eq"),
        F.count_if((F.col("a") > 0) != (F.col("b") > 0)).alias("rows_xor"))
    out = tid.join(rows, "test_id", "left").na.fill(0, ["n_t", "n_p"])

    if {"cell_precision", "cell_recall"} & set(names):
        per_cell = (res.select("test_id", "side", F.explode(F.array_distinct("cells")).alias("cell"))
                    .groupBy("test_id", "cell")
                    .agg(F.bool_or(F.col("side") == "t").alias("in_t"),
                         F.bool_or(F.col("side") == "p").alias("in_p")))
        cells = per_cell.groupBy("test_id").agg(
            F.count_if(F.col("in_t") & F.col("in_p")).alias("inter"),
            F.count_if("in_t").alias("dt"), F.count_if("in_p").alias("dp"))
        out = out.join(cells, "test_id", "left")

    if "tuple_order" in names:
        out = out.join(order_terms(res if ordered is None else res.join(ordered, "test_id", "left_semi")), "test_id", "left")

    both_empty = (F.col("n_t") == 0) & (F.col("n_p") == 0)
    one_empty = (F.col("n_t") == 0) | (F.col("n_p") == 0)

    def rule(expr: Column) -> Column:
        return F.when(both_empty, F.lit(1.0)).when(one_empty, F.lit(0.0)).otherwise(expr)

    exprs = {
        "cell_precision": rule(_ratio(F.col("inter"), F.col("dp"))),
        "cell_recall": rule(_ratio(F.col("inter"), F.col("dt"))),
        "tuple_cardinality": rule(_ratio(F.least("n_t", "n_p"), F.greatest("n_t", "n_p"))),
        "tuple_constraint": rule(_ratio(F.col("rows_eq"), F.col("rows_t"))),
        "execution_accuracy": F.when(both_empty, F.lit(1.0))
                               .when(F.col("n_t") != F.col("n_p"), F.lit(0.0))
                               .when(F.col("rows_xor") == 0, F.lit(1.0)).otherwise(F.lit(0.0)),
        "tuple_order": rule(_spearman(F.col("n_common"), F.col("d2"))),
    }
    for n, m in own.items():
        given = {part: F.col(f"`{n}.{part}`") for part in m.parts} | {"n_t": F.col("n_t"), "n_p": F.col("n_p")}
        exprs[n] = (rule(m.value(given)) if m.rule else m.value(given)).cast("double")
    return out.select("test_id", F.col("n_t").alias("n_target"), F.col("n_p").alias("n_prediction"),
                      *[exprs[n].alias(n) for n in names])


def order_terms(res: DataFrame) -> DataFrame:
    """Per test: number of common raw rows and the sum of squared rank differences."""
    first = (res.groupBy("test_id", "cells")
             .agg(F.min(F.when(F.col("side") == "t", F.col("pos"))).alias("ft"),
                  F.min(F.when(F.col("side") == "p", F.col("pos"))).alias("fp"))
             .where(F.col("ft").isNotNull() & F.col("fp").isNotNull())
             .select("test_id", "ft", "fp"))
    return ranked_terms(first)


def ranked_terms(first: DataFrame) -> DataFrame:
    """``order_terms`` of the common rows' first places ``(test_id, ft, fp)``."""
    ranked = group_positions(first, ["test_id"], [F.col("ft")], "rt")
    ranked = group_positions(ranked, ["test_id"], [F.col("fp")], "rp")
    diff = F.col("rt") - F.col("rp")
    # Exact at any size: a bigint square, summed as decimal(38,0) (a bigint
    # sum would overflow beyond about three million common rows).
    return ranked.groupBy("test_id").agg(
        F.count(F.lit(1)).alias("n_common"),
        F.sum((diff * diff).cast("decimal(38,0)")).alias("d2"))


def _spearman(n: Column, d2: Column) -> Column:
    """1 - 6·d2 / (n(n²-1)) with exact integer numerator and denominator
    (decimal), divided in double: the same value as Python's exact-integer
    division while both fit in 2**53, and no overflow beyond."""
    n = F.coalesce(n, F.lit(0))
    neff = F.when(n == 1, F.lit(2)).otherwise(n).cast("decimal(38,0)")
    num = (F.coalesce(d2, F.lit(0).cast("decimal(38,0)")) * F.lit(6)).cast("double")
    den = (neff * (neff * neff - F.lit(1))).cast("double")
    rho = F.when(n == 0, F.lit(0.0)).otherwise(F.lit(1.0) - num / den)
    return (F.bround(rho, 3) + F.lit(1.0)) / F.lit(2.0)


def compare(target: DataFrame, prediction: DataFrame, ordered: bool = False,
            names: list[str] | None = None) -> DataFrame:
    """Metrics for one pair of results (one row). ``tuple_order`` is null unless ``ordered``.

    Both results are computed once and written under the checkpoint folder;
    the metric branches read that copy (no recomputation of the two
    queries, and a lost executor does not re-run them).
    """
    from ..session import work_dir
    spark = target.sparkSession
    path = work_dir(spark, "pair")
    capture(target, 0, "t").unionByName(capture(prediction, 0, "p")).write.parquet(path)
    res = spark.read.parquet(path)
    tests = spark.range(1).select(F.lit(0).alias("test_id"))
    m = metrics(res, tests, names)
    if "tuple_order" in m.columns and not ordered:
        m = m.withColumn("tuple_order", F.lit(None).cast("double"))
    return m


# --------------------------------------------------------------- efficiency

def trimmed_means(timings: DataFrame, k: float = 3.0) -> DataFrame:
    """Mean seconds per (test_id, side) after dropping runs outside mean ± k·std (population)."""
    stats = timings.groupBy("test_id", "side").agg(F.avg("seconds").alias("_m"),
                                                   F.stddev_pop("seconds").alias("_s"))
    kept = (timings.join(stats, ["test_id", "side"])
            .where((F.col("seconds") >= F.col("_m") - k * F.col("_s"))
                   & (F.col("seconds") <= F.col("_m") + k * F.col("_s"))))
    return kept.groupBy("test_id", "side").agg(F.avg("seconds").alias("mean_seconds"))


def efficiency(timings: DataFrame, accuracy: DataFrame | None = None, k: float = 3.0) -> DataFrame:
    """Valid efficiency score per test: sqrt(mean target time / mean predicted time) * accuracy.

    ``timings(test_id, side, run, seconds)``; a timed-out run should carry
    the time limit as its seconds. ``accuracy(test_id, execution_accuracy)``
    defaults to 1 for every test.
    """
    means = trimmed_means(timings, k)
    wide = means.groupBy("test_id").agg(
        F.max(F.when(F.col("side") == "t", F.col("mean_seconds"))).alias("mean_target"),
        F.max(F.when(F.col("side") == "p", F.col("mean_seconds"))).alias("mean_prediction"))
    if accuracy is not None:
        wide = wide.join(accuracy.select("test_id", "execution_accuracy"), "test_id", "left")
    else:
        wide = wide.withColumn("execution_accuracy", F.lit(1.0))
    return wide.withColumn(
        "valid_efficiency_score",
        F.sqrt(F.col("mean_target") / F.col("mean_prediction")) * F.col("execution_accuracy"))
