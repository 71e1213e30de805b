"""Tables, column classes, keys and samples (the connector part).

A *database* here is a folder of parquet (or CSV) tables registered as temp
views. Its profile is a ``catalog`` DataFrame with one row per classified
column::

    tbl_name, column_name, ordinal, column_type, is_pk, sample_data array<string>

Samples are computed by Spark: categorical columns are
unpivoted into (column, value) pairs, of which only those of small md5 go on
(a bottom-k sketch whose bound comes from the columns' approximate distinct
counts), are de-duplicated and cut to the first ``k`` values by md5 order, so
the distinct values of large columns are never shuffled; numerical columns take the first ``k`` rows of
the table by primary key (or by an md5 of the row) in one
``TakeOrderedAndProject``.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.topk import top_k_per_group
from ..session import work_dir

DEFAULT_SEED = 2023
SAMPLE_SIZE = 5
#: Tables that are sampled at the same time.
_TABLES_AT_ONCE = 8

CATALOG_SCHEMA = T.StructType([
    T.StructField("tbl_name", T.StringType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("column_type", T.StringType(), False),
    T.StructField("is_pk", T.BooleanType(), False),
])

FK_SCHEMA = T.StructType([
    T.StructField("tbl_name", T.StringType(), False),
    T.StructField("parent_column", T.StringType(), False),
    T.StructField("child_table", T.StringType(), False),
    T.StructField("child_column", T.StringType(), False),
])

# Keys of the driver's TPC-H-like tables. TPC-H column names differ between
# the two sides of a key, so the name rule cannot find these foreign keys;
# they are declared. `lineitem` has no key.
DRIVER_PRIMARY_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "events": ["event_id"], "documents": ["doc_id"], "pages": ["page_id"],
    "benchmark": ["item_id"], "embeddings": ["vec_id"], "conversations": ["conv_id", "turn"],
}
DRIVER_FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
_TEXT = (T.StringType, T.CharType, T.VarcharType)


def classify(dtype: T.DataType) -> str | None:
    """'categorical' for text, 'numerical' for numbers, None for anything else."""
    if isinstance(dtype, _TEXT):
        return "categorical"
    if isinstance(dtype, _NUMERIC):
        return "numerical"
    return None


def quote(name: str) -> str:
    """Backtick-quote an identifier."""
    return "`" + name.replace("`", "``") + "`"


@dataclass
class Database:
    """A set of named tables plus declared keys, all as Spark objects."""

    spark: SparkSession
    name: str
    path: str | None
    tables: dict[str, DataFrame]
    primary_keys: dict[str, list[str]] = field(default_factory=dict)
    foreign_keys: list[tuple[str, str, str, str]] = field(default_factory=list)

    def register(self) -> "Database":
        for t, df in self.tables.items():
            df.createOrReplaceTempView(t)
        return self

    def table(self, name: str) -> DataFrame:
        return self.tables[name]


def _table_files(spark: SparkSession, path: str, fmt: str) -> dict[str, str]:
    """Table name -> path of every ``<path>/<name>.<fmt>``, listed by the path's own Hadoop file system."""
    if not path:
        return {}
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return {}
    found = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(folder)]
    return {name[:-len(fmt) - 1]: full for name, full in sorted(found) if name.endswith(f".{fmt}")}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if fmt == "json":
        return spark.read.json(path, multiLine=True)
    return spark.read.format(fmt).load(path)


def load_tables(spark: SparkSession, path: str, names: list[str] | None = None,
                fmt: str = "parquet", register: bool = True) -> dict[str, DataFrame]:
    """Read every ``<path>/<name>.<fmt>`` (or only ``names``) and register views."""
    files = _table_files(spark, path, fmt)
    if not files:
        raise ValueError(f"no {fmt} tables in {path}")
    if names is not None:
        missing = [n for n in names if n not in files]
        if missing:
            raise ValueError(f"tables not found in {path}: {missing}")
        files = {n: files[n] for n in names}
    tables = {n: read_table(spark, p, fmt) for n, p in files.items()}
    if register:
        for n, df in tables.items():
            df.createOrReplaceTempView(n)
    return tables


def open_database(spark: SparkSession, path: str | None, db_name: str,
                  tables: dict | None = None,
                  primary_keys: dict[str, str | list[str]] | None = None,
                  foreign_keys: list[tuple[str, str, str, str]] | None = None,
                  fmt: str = "parquet") -> Database:
    """Open a folder of tables, or create one from given frames.

    Same two errors as a connector on a database file: tables given for a
    folder that already holds tables, or no tables anywhere. A given table
    named ``table`` is stored as ``my_table``. Given frames (Spark or pandas)
    are written to ``path`` as parquet when a path is given, so the database
    outlives the session; otherwise they are only registered as views.
    """
    existing = _table_files(spark, path, fmt) if path else {}
    if existing and tables:
        raise ValueError("The provided database is not empty, but tables provided")
    if not existing and not tables:
        raise ValueError("The database is empty and no tables provided")
    pks = {t: ([k] if isinstance(k, str) else list(k)) for t, k in (primary_keys or {}).items()}
    if tables:
        frames = {}
        for name, tdf in tables.items():
            name = "my_table" if name == "table" else name
            if not isinstance(tdf, DataFrame):
                tdf = spark.createDataFrame(tdf)
            if path:
                out = f"{path.rstrip('/')}/{name}.parquet"
                tdf.write.mode("errorifexists").parquet(out)
                tdf = spark.read.parquet(out)
            frames[name] = tdf
        pks = {("my_table" if t == "table" else t): k for t, k in pks.items()}
    else:
        frames = {n: read_table(spark, p, fmt) for n, p in existing.items()}
    db = Database(spark, db_name, path, frames, pks, list(foreign_keys or []))
    return db.register()


def driver_database(spark: SparkSession, sf_dir: str, names: list[str] | None = None,
                    db_name: str | None = None) -> Database:
    """The driver's test tables with their declared keys."""
    tables = load_tables(spark, sf_dir, names or DRIVER_TABLES)
    pks = {t: k for t, k in DRIVER_PRIMARY_KEYS.items() if t in tables}
    fks = [fk for fk in DRIVER_FOREIGN_KEYS if fk[0] in tables and fk[2] in tables]
    return Database(spark, db_name or os.path.basename(sf_dir.rstrip("/")), sf_dir,
                    tables, pks, fks)


# ---------------------------------------------------------------- catalog

def schema_rows(spark: SparkSession, tables: dict[str, DataFrame],
                primary_keys: dict[str, list[str]] | None = None) -> DataFrame:
    """Classified columns of every table (schema metadata only, no data read)."""
    primary_keys = primary_keys or {}
    rows = []
    for t, df in tables.items():
        pk = set(primary_keys.get(t) or [])
        for i, f in enumerate(df.schema.fields):
            kind = classify(f.dataType)
            if kind is not None:
                rows.append((t, f.name, i, kind, f.name in pk))
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def _row_key(df: DataFrame, pk: list[str] | None, seed: int):
    """Columns that order the rows of a table: its key, else an md5 of the row."""
    if pk:
        return [F.col(quote(c)) for c in pk]
    return [F.md5(F.concat(F.lit(str(seed)), F.to_json(F.struct(*[F.col(quote(c)) for c in df.columns]))))]


#: Distinct values that the sample's md5 bound lets through, for each that is wanted.
_SPARE = 16


def _least_md5(df: DataFrame, columns: list[str], k: int, seed: int, below: dict[str, str]) -> DataFrame:
    """(column_name, value, rank): the k distinct non-null values of least md5 whose md5 is below the column's bound, if it has one."""
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', CAST({quote(c)} AS STRING), '{below.get(c, 'g')}'" for c in columns)
    unpivoted = df.selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, value, below)")
    order = F.md5(F.concat(F.lit(str(seed)), F.col("value")))
    distinct = unpivoted.where(F.col("value").isNotNull()).where(order < F.col("below")).select("column_name", "value").distinct()
    return top_k_per_group(distinct, ["column_name"], [order, F.col("value")], k).select("column_name", "rank", "value")


def categorical_samples(df: DataFrame, columns: list[str], k: int = SAMPLE_SIZE,
                        seed: int = DEFAULT_SEED, long: bool = False) -> DataFrame:
    """(column_name, sample_data): k distinct non-null values per column, md5 order.

    ``long=True`` returns (column_name, rank, value) rows instead of arrays. Two scans: the first one estimates the columns'
    distinct counts, the second lets through about ``_SPARE * k`` distinct values a column; a column of which fewer than ``k``
    came through is read once more without a bound. The samples (k rows a column) are written to the shared folder.
    """
    if not columns:
        return None
    spark = df.sparkSession
    counts = df.agg(*[F.approx_count_distinct(quote(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    below = {c: f"{int(2**32 * _SPARE * k / n):08x}" for c, n in zip(columns, counts, strict=True) if n > 2 * _SPARE * k}
    path = work_dir(spark, "samples")
    _least_md5(df, columns, k, seed, below).write.parquet(path)
    top = spark.read.schema("column_name string, rank int, value string").parquet(path)
    if below:
        full = {r.column_name for r in top.groupBy("column_name").count().where(F.col("count") >= k).collect()}
        short = [c for c in below if c not in full]
        if short:
            top = top.where(~F.col("column_name").isin(*short)).unionByName(_least_md5(df, short, k, seed, {}))
    if long:
        return top.select("column_name", F.col("rank").cast("bigint").alias("rank"), "value")
    return (top.groupBy("column_name")
               .agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("s"))
               .select("column_name", F.col("s.value").alias("sample_data")))


def numerical_samples(df: DataFrame, columns: list[str], pk: list[str] | None,
                      k: int = SAMPLE_SIZE, seed: int = DEFAULT_SEED, long: bool = False) -> DataFrame:
    """(column_name, sample_data): values of the first k rows (by key), duplicates kept.

    ``long=True`` returns (column_name, rank, value) rows instead of arrays.
    """
    if not columns:
        return None
    key = _row_key(df, pk, seed)
    keyed = df.select(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(key)]).alias("_o"),
                      *[F.col(quote(c)) for c in columns])
    first = keyed.orderBy("_o").limit(k)
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', CAST({quote(c)} AS STRING)" for c in columns)
    long_rows = first.selectExpr("_o", f"stack({len(columns)}, {pairs}) AS (column_name, value)")
    if long:
        # At most k rows per column: a window per column is bounded by k.
        w = Window.partitionBy("column_name").orderBy("_o")
        return long_rows.select("column_name", F.row_number().over(w).cast("bigint").alias("rank"), "value")
    return (long_rows.groupBy("column_name")
                .agg(F.sort_array(F.collect_list(F.struct("_o", "value"))).alias("s"))
                .select("column_name", F.col("s.value").alias("sample_data")))


def build_catalog(spark: SparkSession, tables: dict[str, DataFrame],
                  primary_keys: dict[str, list[str]] | None = None,
                  k: int = SAMPLE_SIZE, seed: int = DEFAULT_SEED) -> DataFrame:
    """One row per classified column with its sample values."""
    primary_keys = primary_keys or {}
    meta = schema_rows(spark, tables, primary_keys)

    def of(table):
        t, df = table
        cats = [f.name for f in df.schema.fields if classify(f.dataType) == "categorical"]
        nums = [f.name for f in df.schema.fields if classify(f.dataType) == "numerical"]
        both = (categorical_samples(df, cats, k, seed), numerical_samples(df, nums, primary_keys.get(t), k, seed))
        return [s.withColumn("tbl_name", F.lit(t)) for s in both if s is not None]

    with ThreadPoolExecutor(_TABLES_AT_ONCE) as pool:  # a table's samples are a few jobs, most of them short
        samples = [s for own in pool.map(of, tables.items()) for s in own]
    if not samples:
        return meta.withColumn("sample_data", F.lit(None).cast("array<string>"))
    allsamples = samples[0]
    for s in samples[1:]:
        allsamples = allsamples.unionByName(s)
    return (meta.join(allsamples, ["tbl_name", "column_name"], "left")
                .withColumn("sample_data", F.coalesce("sample_data", F.array().cast("array<string>")))
                .select("tbl_name", "column_name", "ordinal", "column_type", "is_pk", "sample_data"))


def infer_foreign_keys(catalog: DataFrame,
                       declared: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """A column named like another table's single-column primary key refers to it.

    Result ``(tbl_name, parent_column, child_table, child_column)``; the
    "parent" is the referencing side. Declared pairs are added.
    """
    spark = catalog.sparkSession
    single_pk = (catalog.where("is_pk")
                 .groupBy("tbl_name").agg(F.count("*").alias("n"), F.first("column_name").alias("pk"))
                 .where("n = 1")
                 .select(F.col("tbl_name").alias("child_table"), F.col("pk").alias("child_column")))
    inferred = (catalog.select("tbl_name", "column_name")
                .join(single_pk, F.col("column_name") == F.col("child_column"))
                .where(F.col("tbl_name") != F.col("child_table"))
                .select("tbl_name", F.col("column_name").alias("parent_column"),
                        "child_table", "child_column"))
    if declared:
        inferred = inferred.unionByName(spark.createDataFrame(declared, FK_SCHEMA))
    return inferred.distinct()


def check_primary_key(df: DataFrame, pk: list[str]) -> DataFrame:
    """Key values that occur more than once (empty if the key holds)."""
    return df.groupBy(*[quote(c) for c in pk]).count().where("count > 1")


def orphan_rows(child: DataFrame, parent: DataFrame, child_col: str, parent_col: str) -> DataFrame:
    """Rows of the referencing table whose key has no match (a left-anti join)."""
    return child.join(parent.select(F.col(quote(parent_col)).alias("_k")).distinct(),
                      F.col(quote(child_col)) == F.col("_k"), "left_anti")


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Per classified column: class, non-null count and exact distinct count.

    One small aggregate per column, unioned: each reads only its own parquet
    column (so together they read each column once) and each distinct count
    is a plain two-stage aggregate. Fusing all distinct counts of a table
    into one ``agg`` instead makes Catalyst expand every row once per column
    before the shuffle.
    """
    parts = []
    for t, df in tables.items():
        for f in df.schema.fields:
            kind = classify(f.dataType)
            if kind is None:
                continue
            parts.append(df.agg(F.count(quote(f.name)).alias("n_values"),
                                F.count_distinct(quote(f.name)).alias("n_distinct"))
                         .select(F.lit(t).alias("tbl_name"), F.lit(f.name).alias("column_name"),
                                 F.lit(kind).alias("column_type"), "n_values", "n_distinct"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
