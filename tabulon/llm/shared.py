"""Small helpers shared by the operators: folders, empty inputs, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabulon.session import work_dir

#: Documents are cut into runs of about this many bytes for numpy work inside a task.
RUN_BYTES = 500_000


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a shared or equal path)."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    held = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in held:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, held)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Stores that workers keep from one task of an operator to its next; tasks of other operators empty them.
worker_stores: list[dict] = []


def lean(go):
    """``go`` of a mapInArrow in workers that other operators used before: their stores go first, and what the libraries hold
    of this task's memory goes back when its rows are done."""
    def run(batches):
        for store in worker_stores:
            store.clear()
        yield from go(batches)
        give_back()
    return run


def give_back(collect: bool = True) -> None:
    import ctypes
    import gc

    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


#: Folders that ``scratch`` deletes when its block ends; None outside of one.
_made: ContextVar[list | None] = ContextVar("made", default=None)
#: Spark's default limit on the buckets of a table.
MOST_BUCKETS = 100_000


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what ``stored`` and ``bucketed`` wrote in this block at its end, but for lasting tables.

    For steps that end with a lasting table; what is read after the block must not depend on the others.
    """
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(token)
        jvm = spark.sparkContext._jvm
        for path in made:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """Hand Python workers at most about ``size`` bytes of rows at once in the jobs of this block."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if held is None else spark.conf.set(key, held)


def sized(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """``df`` in a number of tasks that goes by its ``rows``, where shuffle partitions are more: rounds over small tables cost
    what their tasks cost. Never fewer tasks than the cluster runs at once."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // per_task + 1))


def _folder(spark: SparkSession, name: str, lasting: bool) -> str:
    path = work_dir(spark, name)
    if not lasting and _made.get() is not None:
        _made.get().append(path)
    return path


def stored(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = _folder(spark, name, lasting)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``stored``, in hash buckets of ``key``, one for each shuffle partition: joins on it don't move this side.

    The catalog entry goes as soon as the table is read; the files stay in the shared folder.
    """
    spark = df.sparkSession
    path = _folder(spark, name, False)
    entry = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"drop table {entry}")
    return out


def with_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, text, more...) with null text read as empty; other columns of the input are ignored."""
    from pyspark.sql import functions as F

    reachable(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       *[F.col(c) for c in more])


def fresh_name(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores before it as it takes to be no column of the frames (case aside)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_buffers(column: pa.Array):
    """(offsets int64, bytes uint8) of an Arrow string column; nulls are empty."""
    import numpy as np

    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, kind, n + 1, column.offset * width).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0]:offsets[-1]]


def runs(offsets, limit: int = RUN_BYTES):
    """Index ranges of documents whose bytes add up to about ``limit`` (one long document is its own run)."""
    import numpy as np

    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j
