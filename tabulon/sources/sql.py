"""Running SQL text from a checklist or a prediction.

Text is stripped of ``;`` and wrapped as ``SELECT * FROM (<text>) q``: a
statement that is not a query (``DROP``, ``INSERT``, ``CREATE``, chained
statements) then fails to parse instead of running, ``WITH .. SELECT``
works, and an inner ``ORDER BY`` keeps its order at the top. A newline
before the closing bracket keeps a trailing line comment from swallowing it.

A time limit is enforced by a tag on the action's jobs, which a timer
cancels. Tags belong to the calling thread, so several actions can run at
once, each with its own limit, and the caller's job group stays as it is.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession

SQL_ERRORS: tuple = (AnalysisException, ParseException)

DEFAULT_TIMEOUT_S = 500

# SQLSTATE classes of errors that lie in the query or its data (cardinality, data, constraint, syntax or access,
# unsupported, limits); others, like a lost executor, are not the query's fault.
_QUERY_STATES = ("21", "22", "23", "42", "0A", "54")


def is_query_error(e: BaseException) -> bool:
    """Whether an exception means that the query text itself failed, at analysis or at run time.

    Errors at run time count by their SQLSTATE or that of a cause; without one it is not the query's fault.
    """
    if isinstance(e, SQL_ERRORS):
        return True
    states = [e.getSqlState()] if isinstance(e, PySparkException) else []
    cause = getattr(e, "java_exception", None) or getattr(e, "_origin", None)
    while cause is not None and len(states) < 20:
        try:
            states.append(cause.getSqlState())
        except Exception:  # noqa: BLE001  not a Spark error
            states.append(None)
        cause = cause.getCause()
    return any(s and s[:2] in _QUERY_STATES for s in states)


class QueryTimeout(Exception):
    pass


def clean_sql(text: str) -> str:
    return text.replace(";", "")


_DQ = "spark.sql.ansi.doubleQuotedIdentifiers"
_DQ_LOCK = threading.Lock()


def sql_frame(spark: SparkSession, text: str, double_quoted_identifiers: bool = False) -> DataFrame:
    """Analyse ``text`` as a query; raises a Spark SQL error if it is not one.

    ``double_quoted_identifiers`` reads ``"name"`` as a column name (and so
    forbids ``"text"`` literals); the setting applies while the text is
    analysed only.
    """
    wrapped = f"SELECT * FROM (\n{clean_sql(text)}\n) q"
    if not double_quoted_identifiers:
        return spark.sql(wrapped)
    with _DQ_LOCK:
        old = spark.conf.get(_DQ, "false")
        spark.conf.set(_DQ, "true")
        try:
            return spark.sql(wrapped)
        finally:
            spark.conf.set(_DQ, old)


def run_query(spark: SparkSession, text: str, timeout_s: float = DEFAULT_TIMEOUT_S,
              limit: int | None = None) -> list[list]:
    """Run a query and return its rows (for small results and tests only).

    The job is cancelled after ``timeout_s``; a cancelled run raises ``QueryTimeout``.
    """
    df = sql_frame(spark, text)
    if limit is not None:
        df = df.limit(limit)
    return [list(r) for r in with_time_limit(spark, df.collect, timeout_s)]


_INTERRUPT = "spark.job.interruptOnCancel"


def with_time_limit(spark: SparkSession, action, timeout_s: float | None):
    """Run ``action()`` (a Spark action) and cancel its jobs after ``timeout_s`` (None: never)."""
    if timeout_s is None:
        return action()
    sc = spark.sparkContext
    tag = f"tabulon-{uuid.uuid4().hex}"
    fired, done = threading.Event(), threading.Event()

    def cancel():
        # A cancel that comes before the job starts has no effect, so it is repeated until the action ends.
        if done.wait(timeout_s):
            return
        fired.set()
        while not done.wait(0.1):
            sc.cancelJobsWithTag(tag)

    held = sc.getLocalProperty(_INTERRUPT)
    sc.addJobTag(tag)
    sc.setInterruptOnCancel(True)
    threading.Thread(target=cancel, daemon=True).start()
    try:
        out = action()
    except Exception as e:  # noqa: BLE001
        if fired.is_set():
            raise QueryTimeout(f"query cancelled after {timeout_s}s") from e
        raise
    finally:
        done.set()
        sc.removeJobTag(tag)
        sc.setLocalProperty(_INTERRUPT, held)
    if fired.is_set():
        raise QueryTimeout(f"query ran over {timeout_s}s")
    return out
