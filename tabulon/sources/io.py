"""Sources and sinks besides parquet folders: CSV, JSON records, sub-databases.

Readers return DataFrames (registered as views where they form a
database); writers write DataFrames. Nothing is collected.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import quote


def read_csv(spark: SparkSession, path: str, schema=None, price_col: str | None = None) -> DataFrame:
    """A CSV file with a header; ``price_col`` (if given) cast to double."""
    r = spark.read.option("header", True)
    df = r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)
    if price_col and price_col in df.columns:
        df = df.withColumn(price_col, F.col(quote(price_col)).cast("double"))
    return df


def database_from_csv(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """One table per CSV file, named by the file stem, registered as a view."""
    out = {}
    for p in paths:
        name = os.path.splitext(os.path.basename(p))[0]
        out[name] = read_csv(spark, p)
        out[name].createOrReplaceTempView(name)
    return out


def read_json_records(spark: SparkSession, path: str, lower_names: bool = True) -> DataFrame:
    """JSON lines, or a file holding one JSON array of records; column names lower-cased."""
    df = spark.read.json(path)
    if df.columns == ["_corrupt_record"]:  # a pretty-printed array: one value per file
        df = spark.read.json(path, multiLine=True)
    return df.toDF(*[c.lower() for c in df.columns]) if lower_names else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a table as parquet, JSON records or CSV (with header).

    Parquet refuses repeated column names; they get a ``_<n>`` suffix.
    """
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        k = c.lower()
        seen[k] = seen.get(k, 0) + 1
        names.append(c if seen[k] == 1 else f"{c}_{seen[k] - 1}")
    df = df.toDF(*names)
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.format(fmt).save(path)


def first_rows(df: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows by ``order`` (a key), else by an md5 of the row.

    Plans as ``TakeOrderedAndProject``: each task keeps its best ``n``.
    """
    key = [F.col(quote(c)) for c in order] if order else \
        [F.md5(F.to_json(F.struct(*[F.col(quote(c)) for c in df.columns])))]
    return df.orderBy(*key).limit(n)


def sub_database(tables: dict[str, DataFrame], out_path: str, n: int = 10,
                 primary_keys: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Write the first ``n`` rows of every table (schema kept) to ``out_path/<t>.parquet``."""
    written = {}
    for t, df in tables.items():
        p = os.path.join(out_path, f"{t}.parquet")
        first_rows(df, n, (primary_keys or {}).get(t)).write.mode("errorifexists").parquet(p)
        written[t] = p
    return written


def insert_lines(df: DataFrame, table: str, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows as ``INSERT INTO t ("c1", ...) VALUES (...);`` lines.

    Strings are single-quoted with inner quotes doubled, other values as
    text, nulls as ``None``.
    """
    cols = ", ".join(f'"{c}"' for c in df.columns)
    vals = []
    for f in df.schema.fields:
        x = F.col(quote(f.name))
        if f.dataType.typeName() == "string":
            v = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
        else:
            v = x.cast("string")
        vals.append(F.coalesce(v, F.lit("None")))
    body = F.concat_ws(", ", *vals)
    return first_rows(df, n, order).select(
        F.concat(F.lit(f"INSERT INTO {table} ({cols}) VALUES ("), body, F.lit(");")).alias("line"))
