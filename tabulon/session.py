"""Session helpers.

Library code never creates a session on its own; it takes the caller's
``SparkSession``. ``local_session`` is for tests, the bench and the entry
point only. ``work_dir`` returns a folder for intermediate tables: the
cluster's ``spark.checkpoint.dir`` when set, a fresh local folder only when
the session has none (tests on one machine).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders made within a ``scratch`` block of this thread.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)

# Settings every session of this library wants; a cluster sets its own sizes.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tabulon", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (not for cluster use)."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("TABULON_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder (``spark.checkpoint.dir``).

    A local folder is made only for a local-mode session without one (tests,
    the bench). On a cluster the folder must be shared storage the cluster
    names; a missing setting is an error rather than a machine-local path.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder: intermediate tables go there")
        d = tempfile.mkdtemp(prefix="tabulon-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def work_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tabulon-{name}-{uuid.uuid4().hex[:12]}"
    if _made.get() is not None:
        _made.get().append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the folders that ``work_dir`` gave out in this block (and this thread) at its end: no frame that reads them must
    be used after it."""
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(token)
        for path in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def in_one_job(df: DataFrame) -> DataFrame:
    """``df`` planned as a whole: its stages are one job, so that the last does not wait behind jobs that came in between. For
    plans whose stages need no adapting."""
    own = SparkSession(df.sparkSession.sparkContext, jsparkSession=df.sparkSession._jsparkSession.cloneSession())
    own.conf.set("spark.sql.adaptive.enabled", "false")
    return DataFrame(own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().analyzed()), own)


def tidy_session(spark: SparkSession) -> SparkSession:
    """A copy of a session, with its views and settings, whose shuffle files go as soon as the action that wrote them ends.

    A frame of it must not run twice by the same object, as its shuffles are gone.
    """
    own = SparkSession(spark.sparkContext, jsparkSession=spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return own


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table to the shared folder and read it back: cuts lineage, and its size is known to later joins."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
