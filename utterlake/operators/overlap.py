"""Waves of one group added up with linear ramps where they overlap, as arrays: no row a sample, no group in one task.

Rows are dealt by range over (group, order), so a group may span many tasks; starts are sums within a task and the sums of
the group's tasks before it. The middle of a wave, which no other one reaches, stays where it is. Heads and tails travel
to the neighbour: they meet by group and block of positions and are added there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterlake.runtime import dealt_by_range, materialize

#: Positions of a group whose heads and tails are added up in one place.
BLOCK = 1 << 16


def _placed(rows: DataFrame, overlap: int) -> DataFrame:
    """(g, part, no, rel, len, w): each wave's place and start among those of its group in its task."""
    keys = ("g", "o", "t")
    dealt = dealt_by_range(rows.withColumn("t", F.xxhash64("w")), *keys).sortWithinPartitions(*keys).select("g", F.spark_partition_id().alias("part"), "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, no, rel = None, 0, 0
        for b in batches:
            sizes = b.column("w").value_lengths().to_pylist()
            places, starts = [], []
            for g, size in zip(b.column("g").to_pylist(), sizes, strict=True):
                if g != group:
                    group, no, rel = g, 0, 0
                places.append(no)
                starts.append(rel)
                no, rel = no + 1, rel + size - overlap
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("part"), pa.array(places, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), b.column("w")], names=["g", "part", "no", "rel", "len", "w"])

    kind = rows.schema["g"].dataType.simpleString()
    return materialize(dealt.mapInArrow(run, f"g {kind}, part int, no long, rel long, len long, w array<double>"), "placed-waves")


def _added(parts: DataFrame, *keys: str) -> DataFrame:
    """(keys, at, v): arrays that start at given positions added up, one row for each run of positions that any of them touches."""

    def run(table: pa.Table) -> pa.Table:
        starts = np.array(table["at"].to_pylist(), np.int64)
        waves = [x.values.to_numpy(zero_copy_only=False) for x in table["v"].combine_chunks()]
        low = int(starts.min())
        size = max(int(s) - low + len(w) for s, w in zip(starts, waves, strict=True))
        total, touched = np.zeros(size), np.zeros(size, bool)
        for s, w in zip(starts, waves, strict=True):
            total[s - low : s - low + len(w)] += w
            touched[s - low : s - low + len(w)] = True
        cuts = np.flatnonzero(np.diff(touched)) + 1
        runs = [(a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), size], strict=True) if touched[a]]
        same = [pa.concat_arrays([table[k].combine_chunks()[:1]] * len(runs)) for k in keys]
        return pa.table([*same, pa.array([low + a for a, _ in runs], pa.int64()), pa.array([total[a:b] for a, b in runs], pa.list_(pa.float64()))], names=[*keys, "at", "v"])

    kinds = ", ".join(f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys)
    return parts.select(*keys, "at", "v").groupBy(*keys).applyInArrow(run, f"{kinds}, at long, v array<double>")


def overlapped(chunks: DataFrame, group: str, order: str, wave: str, overlap: int) -> DataFrame:
    """(group, at, wave): pieces of each group's sum, which do not overlap; at is a piece's first position.

    Null and empty waves go. A wave starts overlap samples before the end of the one before it, at 0 at the least; its
    first overlap samples rise where one is before it, its last fall where one follows. Waves of one group and order stand
    by a hash of their samples. Null groups are one group. A group with a wave shorter than the overlap is added up whole
    by blocks, since such a wave lets others reach further. An empty table gives an empty result.
    """
    rows = chunks.where(F.size(wave) > 0).select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(wave).cast("array<double>").alias("w"))
    placed = _placed(rows, overlap)
    own = placed.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("len") - overlap).alias("sum"), F.count_if(F.col("len") < overlap).alias("short"))
    earlier, whole = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("g")
    starts = own.select(
        F.col("g").alias("_g"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("n_all"), (F.sum("short").over(whole) > 0).alias("short"),
    )
    met = placed.join(starts, F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_part")))
    number = F.col("n_before") + F.col("no")
    known = met.select("g", "part", "len", "w", "short", F.greatest(F.lit(0), F.col("before") + F.col("rel")).alias("start"), (number == 0).alias("first"), (number == F.col("n_all") - 1).alias("last"))
    head, tail = F.when(F.col("first"), 0).otherwise(overlap), F.when(F.col("last"), 0).otherwise(overlap)
    span = lambda at, size: F.struct(F.lit(at).cast("long").alias("from"), F.lit(size).cast("long").alias("size"))
    apart = ~F.col("short") & (F.col("len") >= head + tail)
    middle = known.where(apart & (F.col("len") > head + tail)).select("g", (F.col("start") + head).alias("at"), F.slice("w", head + 1, F.greatest(F.lit(0), (F.col("len") - head - tail).cast("int"))).alias("v"))
    edges = F.when(apart, F.array(span(F.lit(0), head), span(F.col("len") - tail, tail))).otherwise(F.array(span(F.lit(0), F.col("len"))))
    cut = known.select("*", F.explode(F.filter(edges, lambda s: s["size"] > 0)).alias("s")).withColumn("lo", F.col("start") + F.col("s.from"))
    blocks = F.sequence(F.floor(F.col("lo") / BLOCK), F.floor((F.col("lo") + F.col("s.size") - 1) / BLOCK))
    each = cut.withColumn("block", F.explode(blocks)).withColumn("at", F.greatest(F.col("lo"), F.col("block") * BLOCK))
    from_, to = F.col("at") - F.col("start"), F.least(F.col("lo") + F.col("s.size"), (F.col("block") + 1) * BLOCK) - F.col("start")
    each = each.withColumn("i", from_).withColumn("v", F.slice("w", (from_ + 1).cast("int"), F.greatest(F.lit(0), (to - from_).cast("int"))))
    ramp = F.lit(float(max(1, overlap - 1)))

    def weighted(x, k):
        i = F.col("i") + k
        rising = F.when(~F.col("first") & (i < overlap), i / ramp).otherwise(1.0)
        return x * rising * F.when(~F.col("last") & (i >= F.col("len") - overlap), (F.col("len") - 1 - i) / ramp).otherwise(1.0)

    parts = each.select("g", "block", "part", "at", F.transform("v", weighted).alias("v"))
    met_edges = _added(_added(parts, "g", "block", "part"), "g", "block").select("g", "at", "v")  # a task's own first, so many waves at one place are no large group
    return middle.unionByName(met_edges).select(F.col("g").alias(group), F.col("at").alias("at"), F.col("v").alias("wave"))
