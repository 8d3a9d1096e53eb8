"""The row store of batches: retries, writers at the same time, holes, pages."""

import tempfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from oreline.sources import batches as bt


@pytest.fixture
def path():
    with tempfile.TemporaryDirectory() as folder:
        yield f"{folder}/store"


def rows(spark, low, high):
    return spark.range(low, high).withColumnRenamed("id", "v")


def held(spark, path):
    return sorted((r._row_idx, r.v) for r in bt.read_batches(spark, path).collect())


def test_a_retry_writes_nothing_twice(spark, path):
    assert bt.append_batch(rows(spark, 0, 10), path, "v", "a") == bt.Batch("a", 0, 10, True)
    bt.append_batch(rows(spark, 10, 15), path, "v", "b")
    assert bt.append_batch(rows(spark, 0, 10), path, "v", "a").start == 0
    assert held(spark, path) == [(i, i) for i in range(15)]
    with pytest.raises(ValueError, match="10 rows, not 3"):
        bt.append_batch(rows(spark, 0, 3), path, "v", "a")
    with pytest.raises(ValueError, match="name"):
        bt.append_batch(rows(spark, 0, 3), path, "v", "../a")


def test_writers_at_the_same_time(spark, path):
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: bt.append_batch(rows(spark, 100 * n, 100 * n + 5 + n), path, "v", f"w{n % 5}"), [0, 1, 2, 3, 4, 0, 1]))
    found = held(spark, path)
    assert [i for i, _ in found] == list(range(35)) and len({v for _, v in found}) == 35
    assert sorted(b.rows for b in bt.batches(spark, path)) == [5, 6, 7, 8, 9]


def test_pages_over_a_hole(spark, path):
    """A writer that took a range and died leaves a hole in the index, not in the pages."""
    bt.append_batch(rows(spark, 0, 10), path, "v", "a")
    assert bt._Files(spark, path).create("log/000000000001.json", '{"id": "dead", "start": 10, "rows": 90}')
    bt.append_batch(rows(spark, 10, 30), path, "v", "c")
    assert [b.written for b in bt.batches(spark, path)] == [True, False, True] and bt.batches(spark, path)[2].start == 100
    page = bt.page_batches(spark, path, 8, 5)
    assert [r.v for r in page.collect()] == [8, 9, 10, 11, 12]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(_row_idx,100)" in plan
    assert len(bt.page_batches(spark, path, 2, 3).inputFiles()) <= len(bt.read_batches(spark, path, bt.batches(spark, path)[:1]).inputFiles())
    assert bt.page_batches(spark, path, 30, 5).collect() == []
    assert bt.append_batch(spark.range(0).withColumn("v", F.col("id")).drop("id"), path, "v", "empty").rows == 0
