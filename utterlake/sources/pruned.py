"""Shards with an index: a Bloom filter and the range of the keys of each, so that shards without a wanted key are not opened."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.runtime import children, exists
from utterlake.sources import sinks

#: Bits and hashes of a shard's filter: with 4,096 keys about one wrong hit in 170,000.
BITS, HASHES = 1 << 17, 8
#: Up to so many wanted keys are looked up in the filters; with more, only the ranges of the shards are.
WANTED = 200_000


def _places(key: Column) -> Column:
    """The bits of a key."""
    return F.array(*(F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BITS)).cast("int") for i in range(HASHES)))


def _index(path: str) -> str:
    return f"{path.rstrip('/')}.index"


def append_indexed(df: DataFrame, path: str, order: list[str], key: str, rows: int = sinks.SHARD_ROWS) -> int:
    """sinks.append_shards, and then an index of the new shards beside path. Returns the next number."""
    first = sinks.next_shard(df.sparkSession, path)
    after = sinks.append_shards(df, path, order, rows)
    index_shards(df.sparkSession, path, key, range(first, after))
    return after


def index_shards(spark: SparkSession, path: str, key: str, shards: range) -> None:
    """Write the index of these shards. Null keys are in no index, as none is ever wanted."""
    new = sinks.read_shards(spark, path).where(F.col("shard").between(shards.start, shards.stop - 1) & F.col(key).isNotNull()).select("shard", F.col(key).alias("k"))
    bits = new.select("shard", F.explode(_places(F.col("k"))).alias("b")).groupBy("shard", F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, b & 63)")).alias("word"))
    words = bits.groupBy("shard").agg(F.collect_list(F.struct("at", "word")).alias("words"))  # BITS / 64 at most
    spans = new.groupBy("shard").agg(F.count(F.lit(1)).alias("keys"), F.min("k").alias("low"), F.max("k").alias("high"))
    spans.join(words, "shard").write.mode("append").parquet(_index(path))


def shards_with(spark: SparkSession, path: str, wanted: DataFrame, key: str) -> list[int]:
    """Numbers of the shards that may hold a key of wanted; a shard without an index may hold any."""
    there = {int(name.removeprefix("shard=")) for name in children(spark, path) if name.startswith("shard=")}
    if not exists(spark, _index(path)):
        return sorted(there)
    keys = wanted.select(F.col(key).alias("k")).where(F.col("k").isNotNull()).distinct()
    n, low, high = keys.agg(F.count(F.lit(1)), F.min("k"), F.max("k")).first()
    index = spark.read.parquet(_index(path)).dropDuplicates(["shard"])
    known = {r.shard for r in index.select("shard").collect()}
    if not n:
        return sorted(there - known)
    near = index.where((F.col("low") <= F.lit(high)) & (F.col("high") >= F.lit(low)))
    if n <= WANTED:
        near = _hit(near, np.array([r.p for r in keys.select(_places(F.col("k")).alias("p")).collect()], np.int64))
    return sorted((there - known) | ({r.shard for r in near.select("shard").collect()} & there))


def _hit(index: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(shard) of the index's rows whose filter holds all bits of a wanted key. wanted: (keys, HASHES)."""
    shared = index.sparkSession.sparkContext.broadcast(wanted.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = []
            for shard, words in zip(b.column("shard").to_pylist(), b.column("words").to_pylist(), strict=True):
                packed = np.zeros(BITS // 64, np.int64)
                packed[[w["at"] for w in words]] = [w["word"] for w in words]
                bits = np.unpackbits(packed.astype("<i8").view(np.uint8), bitorder="little")
                if bits[shared.value].all(axis=1).any():
                    hits.append(shard)
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int64())], names=["shard"])

    return index.select(F.col("shard").cast("long").alias("shard"), "words").mapInArrow(run, "shard long")


def read_wanted(spark: SparkSession, path: str, wanted: DataFrame, key: str) -> tuple[DataFrame, list[int]]:
    """(rows of the shards at path whose key is one of wanted's, with shard; the shards that were opened for them)."""
    opened = shards_with(spark, path, wanted, key)
    folders = [f"{path}/shard={i}" for i in opened]
    whole = spark.read.option("basePath", path)
    rows = whole.parquet(*folders) if folders else sinks.read_shards(spark, path).limit(0)
    return rows.withColumn("shard", F.col("shard").cast("long")).join(wanted.select(key).distinct(), key, "left_semi"), opened
