"""Keys from the data: which columns are unique, and which hold only values of another one (inclusion dependencies).

All columns that can be keys are unpivoted to (column, kind, value) pairs, counted by column and value with partial
aggregates, and brought together by value: a value then knows every column that holds it. What is asked of the values depends
on the set of columns that hold them only, so their counts are summed by that set and written as a small table: a row for each
set that occurs and each of its columns. The columns that are in all sets of a column hold all of its values; the counts tell
unique columns, and for a pair of columns the rows without a match. A value that fills a third of a table is one row a task
before anything moves, and a value's row is bounded by the number of columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept
from .catalog import FK_SCHEMA, infer_foreign_keys, quote, schema_rows

#: Longer texts go by their SHA-256.
_PLAIN_TEXT = 64
#: Columns in one bitmap word; the top bit is the sign.
_WORD = 62
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _kind(dtype: T.DataType) -> str | None:
    """What a column's values can be equal to: whole numbers, texts or days; None for what is no key."""
    if isinstance(dtype, _INTEGRAL) or isinstance(dtype, T.DecimalType) and dtype.scale == 0:
        return "n"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "s"
    return "d" if isinstance(dtype, T.DateType) else None


def key_columns(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, kind) of every column that can be a key or refer to one."""
    return [(t, f.name, k) for t, df in tables.items() for f in df.schema.fields if (k := _kind(f.dataType))]


def value_table(tables: dict[str, DataFrame]) -> DataFrame:
    """(held array<int>, col, n_values, n_distinct, n_repeated): of the values that the columns ``held`` hold and no other one
    (columns by their number in ``key_columns``, ascending), the rows, values and repeating values of each of these columns.

    Written to the shared folder, as several results read it.
    """
    spark = next(iter(tables.values())).sparkSession
    columns, parts = key_columns(tables), []
    for t, df in tables.items():
        own = [(i, c, k) for i, (tbl, c, k) in enumerate(columns) if tbl == t]
        if not own:
            continue

        def text(c, k):
            plain = f"CAST({quote(c)} AS STRING)"
            return plain if k != "s" else f"IF(length({plain}) > {_PLAIN_TEXT}, sha2({plain}, 256), {plain})"

        pairs = ", ".join(f"{i}, '{k}', {text(c, k)}" for i, c, k in own)
        parts.append(df.selectExpr(f"stack({len(own)}, {pairs}) AS (col, kind, value)").where("value IS NOT NULL"))
    counted = reduce(DataFrame.unionByName, parts).groupBy("col", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    own = counted.groupBy("kind", "value").agg(F.sort_array(F.collect_list(F.struct("col", "n"))).alias("own"))
    each = own.select(F.col("own.col").alias("held"), F.explode("own").alias("x"))
    return kept(each.groupBy("held", F.col("x.col").alias("col"))
                .agg(F.sum("x.n").alias("n_values"), F.count(F.lit(1)).alias("n_distinct"), F.count(F.when(F.col("x.n") > 1, 1)).alias("n_repeated")), "key-values")


def _names(spark: SparkSession, columns: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(columns)], "col int, tbl_name string, column_name string")


def column_keys(tables: dict[str, DataFrame], values: DataFrame | None = None) -> DataFrame:
    """Per column: non-null rows, distinct values, values that repeat, and the other columns that hold all its values.

    ``tbl_name, column_name, n_values, n_distinct, n_repeated, is_unique, included_in array<string>`` (``table.column``,
    sorted). A column without values is in none.
    """
    columns = key_columns(tables)
    values = value_table(tables) if values is None else values
    spark = values.sparkSession
    words = range(len(columns) // _WORD + 1)

    def bitmap(w):
        own = F.filter("held", lambda x: x.between(w * _WORD, (w + 1) * _WORD - 1))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x - w * _WORD)))

    per = values.groupBy("col").agg(*[F.sum(c).alias(c) for c in ("n_values", "n_distinct", "n_repeated")], *[F.bit_and(bitmap(w)).alias(f"w{w}") for w in words])

    def holds(i):
        return F.col(f"w{i // _WORD}").bitwiseAND(1 << (i % _WORD)) != 0
    others = F.array_sort(F.array_compact(F.array(*[F.when(holds(i) & (F.col("col") != i), F.lit(f"{t}.{c}")) for i, (t, c, _) in enumerate(columns)])))
    return (_names(spark, columns).join(per, "col", "left")
            .select("tbl_name", "column_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_values", "n_distinct", "n_repeated")],
                    (F.coalesce("n_repeated", F.lit(1)) == 0).alias("is_unique"),
                    F.when(F.col("n_values") > 0, others).otherwise(F.array().cast("array<string>")).alias("included_in")))


def references(tables: dict[str, DataFrame], primary_keys: dict[str, list[str]] | None = None,
               declared: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Foreign keys with what the rows say about them.

    ``tbl_name, parent_column`` (the referring side), ``child_table, child_column``, ``origin``, ``n_references`` (non-null
    referring rows), ``n_orphans`` (those without a match), ``n_repeated`` (referred values that occur more than once).
    Origin is ``declared``, else ``name`` (a column named like another table's single-column key), else ``data``: all values of
    the column lie in a unique column of another table, and neither rule before has the pair. Pairs with a column that can be
    no key (``key_columns``) are left out.
    """
    values = value_table(tables)
    spark = values.sparkSession
    names = _names(spark, key_columns(tables))
    known = infer_foreign_keys(schema_rows(spark, tables, primary_keys), declared)
    stated = spark.createDataFrame(declared or [], FK_SCHEMA).distinct()
    named = known.join(stated, known.columns, "left_anti")
    per = column_keys(tables, values)
    unique = per.where("is_unique").select(F.col("tbl_name").alias("child_table"), F.col("column_name").alias("child_column"))
    found = (per.select("tbl_name", F.col("column_name").alias("parent_column"), F.explode("included_in").alias("other"))
             .join(unique, F.col("other") == F.concat_ws(".", "child_table", "child_column")).where("tbl_name != child_table").drop("other")
             .join(known, known.columns, "left_anti"))
    pairs = reduce(DataFrame.unionByName, [df.withColumn("origin", F.lit(o)) for df, o in ((stated, "declared"), (named, "name"), (found, "data"))])
    for out, tbl, col in (("a", "tbl_name", "parent_column"), ("b", "child_table", "child_column")):
        pairs = pairs.join(names.select(F.col("tbl_name").alias(tbl), F.col("column_name").alias(col), F.col("col").alias(out)), [tbl, col])
    sides = values.select("held", F.col("col").alias("a"), "n_values", "n_repeated")
    matched = F.array_contains("held", F.col("b"))
    refs = (sides.join(pairs.select("a", "b").distinct(), "a").groupBy("a", "b")
            .agg(F.sum("n_values").alias("n_references"), F.sum(F.when(matched, 0).otherwise(F.col("n_values"))).alias("n_orphans")))
    repeated = sides.groupBy(F.col("a").alias("b")).agg(F.sum("n_repeated").alias("n_repeated"))
    return (pairs.join(refs, ["a", "b"], "left").join(repeated, "b", "left")
            .select("tbl_name", "parent_column", "child_table", "child_column", "origin",
                    *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_references", "n_orphans", "n_repeated")]))


def primary_key_checks(tables: dict[str, DataFrame], primary_keys: dict[str, list[str]]) -> DataFrame:
    """Per declared key: ``tbl_name, key_columns, n_rows, n_null`` (rows with a null in the key), ``n_repeated`` (key values that
    occur more than once). One two-stage aggregate a table."""
    parts = []
    for t, key in primary_keys.items():
        cols = [F.col(quote(c)) for c in key]
        absent = reduce(lambda a, b: a | b, [c.isNull() for c in cols])
        per = tables[t].groupBy(*[c.alias(f"k{i}") for i, c in enumerate(cols)], absent.alias("absent")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("absent"), F.col("n"))), F.lit(0)).alias("n_null"),
                             F.count(F.when(~F.col("absent") & (F.col("n") > 1), 1)).alias("n_repeated"))
                     .select(F.lit(t).alias("tbl_name"), F.lit(",".join(key)).alias("key_columns"), "n_rows", "n_null", "n_repeated"))
    return reduce(DataFrame.unionByName, parts)
