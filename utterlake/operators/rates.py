"""Rows, errors, seconds and rows a second of named observations, in batch and in streams.

A Rates listens to the session's finished queries and to the progress of its streams; whatever was watched in them, by
name, becomes a row of its table. Watching counts rows as they pass, it reads nothing again.
"""

from __future__ import annotations

import json
import threading
import time
from weakref import WeakKeyDictionary

from pyspark.java_gateway import ensure_callback_server_started
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "name string, kind string, batch long, rows long, errors long, seconds double, rows_per_second double"


def watched(rows: DataFrame, name: str, reason: Column | None = None) -> DataFrame:
    """rows, counted under name whenever they are computed; rows for which reason is not null count as errors too."""
    none = F.lit(None).cast("string")
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), F.count(reason if reason is not None else none).alias("errors"))


class _Finished:
    """What a session calls when a query is done: one for each session, as it cannot be taken back, telling all that listen."""

    def __init__(self) -> None:
        self.open: list[Rates] = []

    def onSuccess(self, action, execution, nanoseconds) -> None:
        if execution.getClass().getSimpleName() == "IncrementalExecution":  # a stream's batch, which its progress tells
            return
        found = execution.observedMetrics()
        names = found.keysIterator()
        while names.hasNext():
            name = names.next()
            for rates in list(self.open):
                rates.add(name, "batch", None, json.loads(found.apply(name).json()), nanoseconds / 1e9)

    def onFailure(self, action, execution, problem) -> None:
        """Nothing is known of a query that failed."""

    class Java:
        implements = ["org.apache.spark.sql.util.QueryExecutionListener"]


_of_session: WeakKeyDictionary[SparkSession, _Finished] = WeakKeyDictionary()


class Rates(StreamingQueryListener):
    """Use as a context: with Rates(spark) as rates: ...; rates.table() then has a row for each query and each batch of a stream."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.lock = spark, [], threading.Lock()

    def __enter__(self) -> Rates:
        if self.spark not in _of_session:
            ensure_callback_server_started(self.spark.sparkContext._gateway)
            _of_session[self.spark] = _Finished()
            self.spark._jsparkSession.listenerManager().register(_of_session[self.spark])
        _of_session[self.spark].open.append(self)
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *problem) -> None:
        self.settle()
        self.spark.streams.removeListener(self)
        _of_session[self.spark].open.remove(self)

    def add(self, name: str, kind: str, batch: int | None, counts: dict, seconds: float) -> None:
        rows, errors = counts.get("rows"), counts.get("errors")
        if rows is not None:
            with self.lock:
                self.rows.append((name, kind, batch, rows, errors, float(seconds), rows / seconds if seconds > 0 else None))

    def onQueryStarted(self, event) -> None:
        """Nothing to count yet."""

    def onQueryIdle(self, event) -> None:
        """Nothing was done."""

    def onQueryTerminated(self, event) -> None:
        """All its progress has been told."""

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        for name, row in (progress.observedMetrics or {}).items():
            self.add(name, "stream", progress.batchId, row.asDict(), progress.batchDuration / 1000)

    def settle(self) -> None:
        """Wait until all events have arrived."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        time.sleep(0.2)  # streams pass theirs on by a bus of their own

    def table(self) -> DataFrame:
        """(name, kind, batch, rows, errors, seconds, rows_per_second)."""
        self.settle()
        with self.lock:
            return self.spark.createDataFrame(list(self.rows), SCHEMA)
