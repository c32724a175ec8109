"""Batches of rows of like length under a budget of padded length, from a histogram over all rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.runtime import bucket_of, free_names, numbered

BINS, BUCKETS = 4096, 16


class Bucket(NamedTuple):
    """Lengths up to top, how many rows have them, and how many of these make a batch."""

    top: int
    rows: int
    capacity: int


def _length(column: str) -> Column:
    return F.greatest(F.coalesce(F.col(column).cast("long"), F.lit(0)), F.lit(0))


def buckets_of(rows: DataFrame, length: str, budget: int, buckets: int = BUCKETS) -> list[Bucket]:
    """At most that many buckets of about equal sums of lengths; a histogram of BINS numbers comes to the driver."""
    lengths = rows.select(_length(length).alias("n"))
    top = lengths.agg(F.max("n")).first()[0]
    if top is None:
        return []
    width = max(1, -(-top // BINS))
    bins = sorted(map(tuple, lengths.groupBy(F.ceil(F.col("n") / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("sum")).collect()))
    total, before, out = max(1, sum(s for *_, s in bins)), 0, {}
    for bin_, n, s in bins:
        number = min(buckets - 1, buckets * before // total)
        out[number] = (bin_ * width, out.get(number, (0, 0))[1] + n)
        before += s
    return [Bucket(top, n, max(1, budget // max(1, top))) for top, n in out.values()]


def batched(rows: DataFrame, key: str, length: str, budget: int, name: str = "batch", buckets: int = BUCKETS) -> DataFrame:
    """rows with the number of their batch: those of a bucket of lengths stand by length and key, as many to a batch as fit its largest length into the budget.

    A row longer than the budget has a batch of its own. Null and negative lengths count as 0. A bucket of any size spreads
    over many tasks, so numbers hang on neither tasks nor partitions; rows of equal length and key share their places in
    any order. An empty table gives an empty result.
    """
    found = buckets_of(rows, length, budget, buckets)
    if not found:
        return rows.withColumn(name, F.lit(None).cast("long"))
    starts, at = [], 0
    for b in found:
        starts.append(at)
        at += -(-b.rows // b.capacity)
    bucket, place = free_names(rows, "_bucket", "_at")
    own = bucket_of(_length(length), [b.top for b in found[:-1]])
    of = lambda values: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col(bucket) + 1)
    placed = numbered(rows.withColumn(bucket, own), [bucket], [_length(length), key], place)
    return placed.withColumn(name, of(starts) + F.floor(F.col(place) / of([b.capacity for b in found]))).drop(bucket, place)


def padding(batches: DataFrame, length: str, name: str = "batch") -> DataFrame:
    """One row: batches, rows, and share, what part of the padded length is padding (0 where there is none)."""
    each = batches.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.max(_length(length)).alias("top"), F.sum(_length(length)).alias("sum"))
    whole = each.agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sum(F.col("n") * F.col("top")).alias("padded"), F.sum("sum").alias("own"))
    return whole.select("batches", "rows", F.coalesce(F.when(F.col("padded") > 0, 1 - F.col("own") / F.col("padded")), F.lit(0.0)).alias("share"))
