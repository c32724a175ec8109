import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from utterlake.streaming import incremental


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_rows_without_a_key_keep_apart(spark, tmp_path):
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = "k string, v int"
    put(spark, [(None, 1), (None, 2), ("a", 3)], schema, source)
    run = lambda: sorted(((r.k, r.v) for r in incremental.run_available(spark, source, lambda df: df, "k", out, state).collect()), key=str)
    assert run() == [("a", 3), (None, 1), (None, 2)]
    shutil.rmtree(tmp_path / "state" / "commits")  # the batch was written, its commit is lost
    assert run() == [("a", 3), (None, 1), (None, 2)]
    put(spark, [(None, 2), ("a", 9), ("b", 4), (None, 5)], schema, source)
    assert run() == [("a", 3), ("b", 4), (None, 1), (None, 2), (None, 5)]
    shutil.rmtree(tmp_path / "state")  # all state is lost, and the first run after it fails before its commit
    assert len(run()) == 5
    shutil.rmtree(tmp_path / "state" / "commits")
    assert len(run()) == 5


def test_a_batch_does_not_read_what_was_written(spark, tmp_path):
    """Keys seen are state: former output can go without a key coming twice."""
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    put(spark, [(1,), (2,)], "k int", source)
    incremental.run_available(spark, source, lambda df: df, "k", out, state)
    for path in (tmp_path / "out").glob("run=*"):
        shutil.rmtree(path)
    put(spark, [(2,), (3,)], "k int", source)
    assert [r.k for r in incremental.run_available(spark, source, lambda df: df, "k", out, state).collect()] == [3]


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def test_late_rows_go_and_old_keys_are_forgotten(spark, tmp_path):
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    run = lambda: sorted(r.k for r in incremental.run_available(spark, source, lambda df: df, "k", out, state, "t", "1 hour").collect())
    put(spark, [("a", at(1)), ("b", at(10))], "k string, t timestamp", source)
    assert run() == ["a", "b"]
    put(spark, [("late", at(2)), ("c", at(9, 30)), ("b", at(9, 40))], "k string, t timestamp", source)
    assert run() == ["a", "b", "c"]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_windows_hold_open_ones_and_leave_late_rows_out(spark, tmp_path, kind):
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    totals = {"n": F.count(F.lit(1)), "total": F.sum("v")}
    run = lambda: sorted(((r.window_start.hour, r.by, r.n, r.total) for r in incremental.windows(spark, source, "t", "1 hour", ["by"], totals, out, state, "30 minutes").collect()), key=str)
    schema = f"t {kind}, by string, v int"
    put(spark, [(at(1), "x", 1), (at(1, 59), "x", 2), (at(2), "y", 4), (None, "x", 100), (at(5), "x", 8)], schema, source)
    first = [(1, "x", 2, 3), (2, "y", 1, 4), (5, "x", 1, 8)]
    assert run() == first
    shutil.rmtree(tmp_path / "state" / "commits")
    assert run() == first
    put(spark, [(at(1, 30), "x", 1000), (at(4, 45), "x", 16), (at(5, 10), "x", 32), (at(5, 20), None, 64)], schema, source)
    assert sorted(run(), key=str) == sorted([(1, "x", 2, 3), (2, "y", 1, 4), (4, "x", 1, 16), (5, "x", 2, 40), (5, None, 1, 64)], key=str)


def test_missing_knows_null_keys(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,)], "k int")
    assert [r.k for r in incremental.missing(rows, rows.where("k IS NULL OR k = 1"), "k").collect()] == [2]
