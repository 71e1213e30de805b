"""The relational query shapes of a checklist, as DataFrame functions.

Each function takes a DataFrame (and column names / values) and returns a
lazy DataFrame with stable column names, so the plan stays with Catalyst:
projections prune the parquet read schema, literal predicates reach the
scan as ``PushedFilters``, aggregates run partial + final, distinct
aggregates are expanded by Catalyst, and an uncorrelated scalar subquery is
computed once (``DataFrame.scalar()``). Several aggregates over one table
are fused into one ``agg`` so the table is scanned once.

Naming: aggregate columns are ``<fn>_<column>`` (``count`` for a plain row
count); grouping keys keep their names.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import quote

_CMP = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt,
        "=": operator.eq, "==": operator.eq, "!=": operator.ne, "<>": operator.ne}
_AGG = {"min": F.min, "max": F.max, "avg": F.avg, "sum": F.sum, "count": F.count}


def c(name: str) -> Column:
    return F.col(quote(name))


_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def agg_expr(df: DataFrame, fn: str, col: str) -> Column:
    """``fn(col)``; a SUM over an integer column is taken as ``decimal(38,0)``,
    exact where a bigint sum would overflow on very large tables."""
    if fn == "sum" and dict(df.dtypes).get(col) in _INTEGRAL:
        return F.sum(c(col).cast("decimal(38,0)"))
    return _AGG[fn](c(col))


def is_id_column(name: str) -> bool:
    """The checklist's "id" rule: any name containing ``id`` (case-insensitive)."""
    return "id" in name.lower()


# ------------------------------------------------------------- projection

def project(df: DataFrame, cols: list[str] | str | None = None) -> DataFrame:
    """``SELECT *`` (cols None) or ``SELECT c1, c2 ...``."""
    if cols is None:
        return df.select("*")
    if isinstance(cols, str):
        cols = [cols]
    return df.select(*[c(x) for x in cols])


# ---------------------------------------------------------------- filters

def compare(df: DataFrame, col: str, op: str, value) -> DataFrame:
    """``WHERE col <op> value`` with a literal (pushed to the scan)."""
    return df.where(_CMP[op](c(col), F.lit(value)))


def filter_eq(df, col, value):
    return compare(df, col, "==", value)


def filter_ne(df, col, value):
    return compare(df, col, "!=", value)


def filter_gt(df, col, value):
    return compare(df, col, ">", value)


def filter_lt(df, col, value):
    return compare(df, col, "<", value)


def null_profile(df: DataFrame, cols: list[str] | None = None, skip_id: bool = True) -> DataFrame:
    """One row: ``null_<c>`` and ``not_null_<c>`` counts for every column, one scan."""
    cols = cols if cols is not None else [x for x in df.columns if not (skip_id and is_id_column(x))]
    aggs = []
    for x in cols:
        aggs.append(F.count_if(c(x).isNull()).alias(f"null_{x}"))
        aggs.append(F.count(c(x)).alias(f"not_null_{x}"))
    return df.agg(*aggs)


# ---------------------------------------------------- distinct, sort, limit

def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(c(col)).distinct()


def order_by(df: DataFrame, col: str, desc: bool = False, project_only: bool = False) -> DataFrame:
    """``ORDER BY col ASC`` (nulls first) / ``DESC`` (nulls last), whole table or the column."""
    base = df.select(c(col)) if project_only else df
    key = c(col).desc_nulls_last() if desc else c(col).asc_nulls_first()
    return base.orderBy(key)


def first_rows(df: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """``LIMIT n``; with an order it plans as ``TakeOrderedAndProject``."""
    return (df.orderBy(*[c(x) for x in order]) if order else df).limit(n)


# ------------------------------------------------------------- aggregates

def count_distinct(df: DataFrame, cols: list[str] | str) -> DataFrame:
    """One row, ``count_distinct_<c>`` per column (exact)."""
    cols = [cols] if isinstance(cols, str) else cols
    return df.agg(*[F.count_distinct(c(x)).alias(f"count_distinct_{x}") for x in cols])


def global_agg(df: DataFrame, cols: list[str] | str, fns=("max", "min", "avg")) -> DataFrame:
    """One row, ``<fn>_<c>`` for every function and column, one scan."""
    cols = [cols] if isinstance(cols, str) else cols
    return df.agg(*[agg_expr(df, f, x).alias(f"{f}_{x}") for x in cols for f in fns])


def group_count(df: DataFrame, col: str) -> DataFrame:
    """``SELECT col, COUNT(*) GROUP BY col`` -> (col, count)."""
    return df.groupBy(c(col)).agg(F.count(F.lit(1)).alias("count"))


def group_agg(df: DataFrame, by: str, cols: list[str] | str,
              fns=("min", "max", "avg", "sum")) -> DataFrame:
    """``SELECT by, FN(col) GROUP BY by`` for all functions/columns at once."""
    cols = [cols] if isinstance(cols, str) else cols
    return df.groupBy(c(by)).agg(*[agg_expr(df, f, x).alias(f"{f}_{x}") for x in cols for f in fns])


def average_group_size(df: DataFrame, col: str) -> DataFrame:
    """One row ``threshold``: mean rows per group of ``col``, truncated to an integer."""
    sizes = df.groupBy(c(col)).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.avg("n").cast("bigint").alias("threshold"))


def average_group_sum_avg(df: DataFrame, by: str, col: str) -> DataFrame:
    """One row: mean over groups of SUM(col) and of AVG(col), each rounded to 2 places."""
    g = df.groupBy(c(by)).agg(agg_expr(df, "sum", col).alias("s"), F.avg(c(col)).alias("a"))
    return g.agg(F.bround(F.avg(F.col("s").cast("double")), 2).alias("mean_sum"),
                 F.bround(F.avg("a"), 2).alias("mean_avg"))


def having_count(df: DataFrame, col: str, op: str, threshold: int | None = None) -> DataFrame:
    """Groups of ``col`` whose size is ``op`` the threshold (default: mean group size)."""
    sizes = df.groupBy(c(col)).agg(F.count(F.lit(1)).alias("_n"))
    if threshold is None:
        t = sizes.agg(F.avg("_n").cast("bigint")).scalar()
    else:
        t = F.lit(threshold)
    return sizes.where(_CMP[op](F.col("_n"), t)).select(c(col))


def having_agg(df: DataFrame, by: str, col: str, fn: str, op: str, value=None) -> DataFrame:
    """Groups whose ``fn(col)`` (avg or sum) is ``op`` the value (default: rounded mean over groups)."""
    g = df.groupBy(c(by)).agg(agg_expr(df, fn, col).alias("_v"))
    v = F.bround(g.agg(F.avg(F.col("_v").cast("double"))).scalar(), 2) if value is None else F.lit(value)
    return g.where(_CMP[op](F.col("_v"), v)).select(c(by))


def relational_division(df: DataFrame, group_col: str, all_of: str) -> DataFrame:
    """Values of ``group_col`` that occur with *every* value of ``all_of``.

    ``GROUP BY a HAVING COUNT(DISTINCT b) = (SELECT COUNT(DISTINCT b) FROM t)``.
    Catalyst de-duplicates (a, b) with a map-side combine before the shuffle,
    so a hot ``a`` sends at most one row per distinct b per partition.
    """
    total = df.agg(F.count_distinct(c(all_of))).scalar()
    return (df.groupBy(c(group_col)).agg(F.count_distinct(c(all_of)).alias("_n"))
              .where(F.col("_n") == total).select(c(group_col)))


# ------------------------------------------------------------------ joins

def join_fk(left: DataFrame, right: DataFrame, left_col: str, right_col: str,
            cols: list[tuple[str, str]] | None = None) -> DataFrame:
    """Inner equi-join along a foreign key.

    ``cols`` None keeps every column (right-side names that clash get a
    ``_2`` suffix so the result can be written); else a list of
    ``("T1"|"T2", column)`` pairs. The join strategy is Catalyst's: AQE turns
    it into a broadcast join only when the runtime size of a side is under
    ``spark.sql.autoBroadcastJoinThreshold`` and keeps a shuffle join beyond.
    """
    a, b = left.alias("T1"), right.alias("T2")
    j = a.join(b, F.col(f"T1.{quote(left_col)}") == F.col(f"T2.{quote(right_col)}"), "inner")
    if cols is None:
        seen = set(left.columns)
        out = [F.col(f"T1.{quote(x)}") for x in left.columns]
        for x in right.columns:
            out.append(F.col(f"T2.{quote(x)}").alias(x + "_2" if x in seen else x))
        return j.select(*out)
    return j.select(*[F.col(f"{side}.{quote(x)}") for side, x in cols])


def join_on_list(df: DataFrame, other: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Join on equally named columns (``how='left_semi'`` keeps rows without multiplying)."""
    return df.join(other, on=cols, how=how)
