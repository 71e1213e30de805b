"""The paged query runner: pages, resuming, equal plans, limits side by side."""

import time

import pytest

from tabulon.plans import runner
from tabulon.plans.evaluate import evaluate
from tabulon.sources.sql import is_query_error, with_time_limit

SLOW = "SELECT sum(sqrt(id + {})) AS s FROM range(0, 30000000000)"


def frame(spark, rows):
    return spark.createDataFrame(rows, "test_id bigint, target string, pred string")


def scores(df):
    return {r.test_id: r.execution_accuracy for r in df.collect()}


class Runs:
    """Records the texts that are run, and stops after a number of pages."""

    def __init__(self, monkeypatch, stop=None):
        self.texts, self.pages, self.stop = [], [], stop
        self.real = runner.capture_queries
        monkeypatch.setattr(runner, "capture_queries", self)

    def __call__(self, spark, pairs, *args):
        if len(self.pages) == self.stop:
            raise RuntimeError("stopped")
        self.texts += [q for _, q in pairs]
        self.pages.append(len(pairs))
        return self.real(spark, pairs, *args)


def test_a_stopped_run_goes_on_where_it_was(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(runner, "PAGE", 4)
    rows = [(i, f"SELECT {i} AS a", f"SELECT {i + (i % 2)} AS a" if i != 5 else "SELECT nope") for i in range(12)]
    work, want = str(tmp_path / "work"), {i: float(i % 2 == 0) for i in range(12)}
    first = Runs(monkeypatch, stop=2)
    with pytest.raises(RuntimeError, match="stopped"):
        evaluate(spark, frame(spark, rows), "target", "pred", work=work)
    again = Runs(monkeypatch)
    again.real = first.real
    assert scores(evaluate(spark, frame(spark, rows), "target", "pred", work=work)) == want
    assert again.texts and first.texts and not set(first.texts) & set(again.texts) and len(first.pages) + len(again.pages) > 2
    assert scores(evaluate(spark, frame(spark, rows), "target", "pred", work=work)) == want
    before = len(again.texts)
    more = [*rows, (12, "SELECT 12 AS a", "SELECT 0 AS a"), (13, "SELECT 1 AS a", "SELECT 3 - 2 AS b")]
    assert scores(evaluate(spark, frame(spark, more), "target", "pred", work=work)) == {**want, 12: 0.0, 13: 1.0}
    assert sorted(again.texts[before:]) == ["SELECT 0 AS a", "SELECT 3 - 2 AS b"]


def test_equal_plans_run_once(spark, monkeypatch):
    spark.range(5).createOrReplaceTempView("five")
    runs = Runs(monkeypatch)
    rows = [(1, "SELECT id FROM five WHERE id > 1", "select  ID as other from FIVE where (id > 1)"), (2, "SELECT id FROM five WHERE id > 1", "SELECT id FROM five WHERE id > 2"),
            (3, "SELECT rand(1) AS r", "SELECT rand(1) AS s")]
    assert scores(evaluate(spark, frame(spark, rows), "target", "pred")) == {1: 1.0, 2: 0.0, 3: 1.0}
    assert len(runs.texts) == 4


def test_slow_queries_are_cut_side_by_side_and_the_caller_s_group_stays(spark):
    sc = spark.sparkContext
    sc.setJobGroup("mine", "my jobs")
    rows = [(i, f"SELECT {i} AS s", SLOW.format(i)) for i in range(4)] + [(9, "SELECT 9 AS s", "SELECT 10 - 1 AS s")]
    began = time.time()
    got = scores(evaluate(spark, frame(spark, rows), "target", "pred", batch=1, timeout_s=4.0))
    assert got == {**dict.fromkeys(range(4), 0.0), 9: 1.0} and time.time() - began < 45
    assert sc.getLocalProperty("spark.jobGroup.id") == "mine" and not sc.getJobTags()
    assert with_time_limit(spark, lambda: spark.range(7).count(), 30) == 7
    assert sc.getLocalProperty("spark.jobGroup.id") == "mine" and sc.getLocalProperty("spark.job.interruptOnCancel") == "false"
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_only_the_query_s_own_errors_count(spark):
    def raised(action):
        with pytest.raises(Exception) as e:
            action()
        return e.value
    assert is_query_error(raised(lambda: spark.sql("SELECT nope")))
    assert is_query_error(raised(lambda: spark.sql("SELECT FROM WHERE")))
    assert is_query_error(raised(lambda: spark.sql("SELECT CAST('x' AS INT) AS a").write.format("noop").mode("overwrite").save()))
    assert is_query_error(raised(lambda: spark.sql("SELECT (SELECT id FROM range(2))").collect()))

    def breaks(batches):
        raise OSError("lost")
        yield
    assert not is_query_error(raised(lambda: spark.range(1).mapInArrow(breaks, "id long").collect()))
    assert not is_query_error(OSError("lost"))
