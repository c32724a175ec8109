"""Where results go: guarded tables, appended shards, a corpus text file, WAV files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.operators.corpus import first_wins
from utterlake.runtime import children, free_names, numbered, read_text, release, rename, write_text


def save_new(df: DataFrame, path: str) -> None:
    """Parquet at path; an error where something stands there already."""
    df.write.mode("errorifexists").parquet(path)


def save_manifest(df: DataFrame, path: str, sample_limit: int | None = None) -> bool:
    """The manifest replaces what is at path, unless it was limited: a partial one must not stand under the key of the whole. True if written."""
    if sample_limit:
        return False
    swap_in(df, path)
    return True


_CURRENT = "_current"


def swap_in(df: DataFrame, path: str) -> None:
    """df becomes the table at path: a version of its own is written beside the one that counts, then the pointer to it is swapped.

    A driver lost at any step leaves the former table or the new one, and the next call clears what it left. df may read
    the former table. Read it with read_swapped.
    """
    spark = df.sparkSession
    old = read_text(spark, f"{path}/{_CURRENT}")
    for left in children(spark, path):
        if re.fullmatch(r"version=\d+", left) and left != old:
            release(spark, f"{path}/{left}")
    new = f"version={int((old or 'version=-1').split('=')[1]) + 1:06d}"
    df.write.mode("errorifexists").parquet(f"{path}/{new}")
    write_text(spark, f"{path}/{_CURRENT}", new)


def read_swapped(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that swap_in left at path, or a plain Parquet folder; None where there is neither."""
    current = read_text(spark, f"{path}/{_CURRENT}")
    if current:
        return spark.read.parquet(f"{path}/{current}")
    return spark.read.parquet(path) if any(not x.startswith(("_", ".", "version=")) for x in children(spark, path)) else None


SHARD_ROWS = 4096


def next_shard(spark: SparkSession, path: str) -> int:
    """One above the highest shard number at path, 0 where there is none."""
    found = [re.fullmatch(r"shard=(\d+)", name) for name in children(spark, path)]
    return max((int(m[1]) + 1 for m in found if m), default=0)


def append_shards(df: DataFrame, path: str, order: list[str], rows: int = SHARD_ROWS, token: str | None = None) -> int:
    """Shards of that many rows, by ascending order, behind those at path, as folders shard=<number>. Returns the next number.

    Rows get their places by a range sort, so many tasks write at once; a shard is written whole by one of them. token
    names the append: shards are written aside and then moved in, a call that is repeated with it goes on where the one
    before stopped, and does nothing once that had ended.
    """
    spark = df.sparkSession
    if token is None:
        _write_shards(df, path, order, rows, next_shard(spark, path))
        return next_shard(spark, path)
    staged, plan = f"{path}/_staged-{token}", f"{path}/_appended-{token}"
    said = read_text(spark, plan)
    if said is None:
        release(spark, staged)
        _write_shards(df, staged, order, rows, 0)
        said = str(next_shard(spark, path))
        write_text(spark, plan, said)
    for name in children(spark, staged):
        if m := re.fullmatch(r"shard=(\d+)", name):
            rename(spark, f"{staged}/{name}", f"{path}/shard={int(said) + int(m[1])}")
    release(spark, staged)
    return next_shard(spark, path)


def _write_shards(df: DataFrame, path: str, order: list[str], rows: int, first: int) -> None:
    (at,) = free_names(df, "_at")
    placed = numbered(df, [], order, at).withColumn("shard", (F.lit(first) + F.floor(F.col(at) / rows)).cast("long")).drop(at)
    placed.repartition("shard").sortWithinPartitions("shard", *order).write.mode("append").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All shards at path, with their number as the column shard."""
    return spark.read.option("basePath", path).parquet(path).withColumn("shard", F.col("shard").cast("long"))


def save_flat_cache(new: DataFrame, path: str, key: str) -> None:
    """Adds the new rows to the flat cache at path, see swap_in; of rows with one key the cached one stays."""
    old = read_swapped(new.sparkSession, path)
    swap_in(first_wins([*([old] if old is not None else []), new], key), path)


def save_corpus(df: DataFrame, text: str, path: str, files: int | None = None) -> None:
    """Sorted lines. With files=1 they are one text file, as a tokenizer's trainer takes; else range-sorted parts whose names keep the order."""
    lines = df.select(F.col(text).alias("value"))
    ordered = lines.repartition(1).sortWithinPartitions("value") if files == 1 else lines.orderBy("value")
    ordered.write.mode("overwrite").text(path)
