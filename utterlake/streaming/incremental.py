"""Resumable incremental processing: batch anti-join, a file stream that adds each key once, and windows by event time.

Keys and windows are kept in the session's state store; on a cluster name the RocksDB provider in
spark.sql.streaming.stateStore.providerClass, so that they lie on disk.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.runtime import children, exists, is_file, scratch_path


def missing(manifest: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows of manifest not yet in cache. A null key is in it where cache has one."""
    known = cache.select(F.col(key).alias("_known")).distinct()
    return manifest.join(known, manifest[key].eqNullSafe(F.col("_known")), "left_anti")


def identity(key: str, columns: list[str]) -> Column:
    """What tells rows apart: the key, or all columns where it is null, so rows without a key do not stand for each other."""
    whole = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return F.when(F.col(key).isNull(), F.concat(F.lit("row:"), whole)).otherwise(F.concat(F.lit("key:"), F.col(key).cast("string")))


def files_of(spark: SparkSession, source: str) -> DataFrame:
    """A stream of the Parquet files at source: a file, or a folder at any depth."""
    schema = spark.read.option("recursiveFileLookup", True).parquet(source).schema
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if is_file(spark, source):  # a stream reads folders: this one's, and of it that file alone
        folder, name = source.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).option("recursiveFileLookup", False).parquet(folder)
    return reader.option("pathGlobFilter", "*.parquet").parquet(source)


def _run(query_of: Callable[[], object]) -> None:
    query_of().start().awaitTermination()


def run_available(spark: SparkSession, source: str, work: Callable[[DataFrame], DataFrame], key: str, out: str | None = None, state: str | None = None, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Stream the files at source through work into Parquet at out, each file once however often this is called with one state.

    work: a row by row transformation. Of rows with one key one is taken: the keys seen are the stream's state, so a batch
    costs what it holds and not what is in out. Rows with a null key are told apart by all their columns. A batch that is
    run again replaces what it wrote before. With event_time, rows that come later than delay behind the newest of the
    batches before are late and go, and keys older than that are forgotten. Where out has rows and state is lost, the keys in out
    are skipped once more. Returns all rows in out.
    """
    out, state = out or scratch_path(spark, "stream"), state or scratch_path(spark, "stream-state")
    stored = _batches(spark, out)
    runs = sorted({x.rsplit("/", 1)[1].split("-batch=")[0] for x in stored})
    run = runs[-1] if runs and exists(spark, f"{state}/offsets") else f"run={len(runs):06d}"
    before = [x for x in stored if not x.rsplit("/", 1)[1].startswith(run)]  # from runs whose state is lost: what they have must not come twice
    done = work(files_of(spark, source))
    same, columns = "_same", done.columns
    told = done.withColumn(same, identity(key, columns))
    once = told.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([same]) if event_time else told.dropDuplicates([same])

    def write(batch: DataFrame, number: int) -> None:
        new = batch
        if before:
            known = spark.read.schema(done.schema).parquet(*before).select(identity(key, columns).alias("_known")).distinct()
            new = new.join(known, F.col(same) == F.col("_known"), "left_anti")
        new.drop(same).write.mode("overwrite").parquet(f"{out}/{run}-batch={number:09d}")

    _run(lambda: once.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True))
    found = _batches(spark, out)
    return spark.read.parquet(*found) if found else spark.createDataFrame([], done.schema)


def _batches(spark: SparkSession, out: str) -> list[str]:
    return [f"{out}/{name}" for name in children(spark, out) if re.fullmatch(r"run=\d+-batch=\d+", name)]


def windows(spark: SparkSession, source: str, time: str, size: str, by: list[str], totals: dict[str, Column], out: str | None = None, state: str | None = None, delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, *by, *totals) for event-time windows over the stream of files at source, open windows too.

    Each batch writes the windows that it changed, the latest batch of a window counts. Rows whose window ended more than
    delay before the newest time of the batches before are late: they change nothing. Rows without a time are in no window.
    """
    out, state = out or scratch_path(spark, "windows"), state or scratch_path(spark, "windows-state")
    spans = F.window(time, size, slide) if slide else F.window(time, size)
    stream = files_of(spark, source)
    plain = stream.schema[time].dataType.typeName() == "timestamp_ntz"  # counted as UTC, whatever zone the session has
    if plain:
        stream = stream.withColumn(time, F.from_utc_timestamp(F.col(time).cast("timestamp"), F.current_timezone()))
    groups = stream.where(F.col(time).isNotNull()).withWatermark(time, delay).groupBy(spans.alias("_w"), *by)
    changed = groups.agg(*(c.alias(name) for name, c in totals.items())).select(F.col("_w.start").alias("window_start"), *by, *totals)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/run=000000-batch={number:09d}")

    _run(lambda: changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True))
    found = _batches(spark, out)
    if not found:
        return spark.createDataFrame([], changed.schema)
    rows = spark.read.parquet(*found)
    if plain:
        rows = rows.withColumn("window_start", F.to_utc_timestamp("window_start", F.current_timezone()).cast("timestamp_ntz"))
    return rows.groupBy("window_start", *by).agg(F.max_by(F.struct(*totals), "_batch").alias("_last")).select("window_start", *by, "_last.*")
