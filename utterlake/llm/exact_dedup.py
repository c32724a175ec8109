"""Exact dedup by content sort.

Sampled splitters range-partition the rows by (first characters, digest, id) of the normalised text, an external sort
puts equal texts next to each other, and each row is compared in full with its neighbour. The id is part of the range
key, so one text that holds a third of all rows spreads over as many partitions as its rows need; runs that cross a
partition's edge are joined afterwards: each partition's last text is compared in full with the next one's first.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from utterlake.llm.frames import free_name
from utterlake.runtime import dealt_by_range, materialize, table

PREFIX_CHARS = 32
_TYPES = {"id": pa.int64(), "keep_id": pa.int64(), "group_size": pa.int64(), "last": pa.bool_(), "digest": pa.string(), "edge": pa.int64(), "edge_text": pa.string()}
_RUNS = "id long, keep_id long, group_size long, last boolean, digest string, edge long, edge_text string"


def normalised(text: str | Column) -> Column:
    """A-Z in lower case, nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by text come in; each leaves with its run's last id and size. A partition's first and last run get an edge number."""
    part, runs = TaskContext.get().partitionId(), 0
    ids: list = []  # of the open run
    text = digest = None
    out: list[list] = [[] for _ in _TYPES]

    def close(last: bool) -> None:
        n, edge = len(ids), 2 * part + last if last or runs == 1 else None
        for column, values in zip(out, (ids, [ids[-1]] * n, [n] * n, [False] * (n - 1) + [True], [digest] * n, [edge] * n, [None if edge is None else text] + [None] * (n - 1)), strict=True):
            column += values

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES.values(), strict=True)], names=list(_TYPES))
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        if not batch.num_rows:
            continue
        texts, digests, found = batch.column("norm"), batch.column("digest").to_pylist(), batch.column("id").to_pylist()
        starts = [runs == 0 or texts[0].as_py() != text, *pc.not_equal(texts[1:], texts[:-1]).to_pylist()]
        for i, starts_run in enumerate(starts):
            if starts_run:
                if ids:
                    close(False)
                ids, runs, digest = [], runs + 1, digests[i]
                # only a partition's edges need their text: the first run's from here, the last run's from the end of its batch
                text = texts[i].as_py() if runs == 1 else None
            ids.append(found[i])
        text = texts[len(texts) - 1].as_py()
        if len(out[0]) > 4096:
            yield flush()
    if ids:
        close(True)
        yield flush()


def _linked(edges: DataFrame) -> DataFrame:
    """(edge, chain) of edges(edge, norm): edges whose texts are one run over several partitions share a chain.

    Neighbouring edges meet in a join by number, so no task holds more than single pairs of texts; only the numbers, two at
    most for each partition of the sort, are put in order together.
    """
    ordered = Window.partitionBy(F.lit(0)).orderBy("edge")
    before = materialize(edges.select("edge", F.lag("edge").over(ordered).alias("before")), "edge-order")
    texts = edges.join(before, "edge").select("edge", "before", "norm")
    met = texts.join(edges.select(F.col("edge").alias("before"), F.col("norm").alias("norm_before")), "before", "left")
    starts = materialize(met.select("edge", (~F.coalesce(F.col("norm") == F.col("norm_before"), F.lit(False))).cast("int").alias("starts")), "edge-starts")
    return materialize(starts.select("edge", F.sum("starts").over(ordered).alias("chain")), "edges")


def _last_rows(batches: Iterator[pa.RecordBatch], text: str, digest: str, edge: str) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by text, the last of each run, without the digest and with the edge number of a partition's first and last run."""
    part, runs, held = TaskContext.get().partitionId(), 0, None
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    plain = lambda value: (value.as_py() or "").translate(lower)

    def ends(rows: pa.Table) -> list[bool]:
        """For each row but the last: whether the next one has another text."""
        marks, texts = pc.not_equal(rows[digest][1:], rows[digest][:-1]).to_pylist(), rows[text]
        return [mark or plain(texts[i]) != plain(texts[i + 1]) for i, mark in enumerate(marks)]

    def given(rows: pa.Table, last: bool = False) -> Iterator[pa.RecordBatch]:
        nonlocal runs
        numbers = [2 * part + 1 if last else 2 * part if runs + i == 0 else None for i in range(rows.num_rows)]
        runs += rows.num_rows
        yield from rows.drop_columns([digest]).append_column(edge, pa.array(numbers, pa.int64())).to_batches()

    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            chosen = rows.slice(0, rows.num_rows - 1).filter(pa.array(ends(rows), pa.bool_()))
            held = rows.slice(rows.num_rows - 1)
            if chosen.num_rows:
                yield from given(chosen)
    if held is not None:
        yield from given(held, last=True)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of texts equal after lower-casing A-Z the row with the largest id stays. Null texts are empty texts and form one
    group. Of repeated rows with the same id and text exactly one is kept. A null id sorts below all others, so it is
    kept only where its group has no other. Other columns of the input are ignored; an empty table gives an empty result.
    """
    norm = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("norm"))
    keyed = norm.select("id", "norm", F.sha2("norm", 256).alias("digest"), F.substring("norm", 1, PREFIX_CHARS).alias("prefix"))
    dealt = dealt_by_range(keyed, "prefix", "digest", "id").sortWithinPartitions("prefix", "digest", "norm", "id")
    runs = materialize(dealt.select("id", "norm", "digest").mapInArrow(_runs, _RUNS), "exact-runs")
    linked = _linked(runs.where("edge_text IS NOT NULL").select("edge", F.col("edge_text").alias("norm")))
    same = Window.partitionBy("chain")
    sizes = runs.where("edge_text IS NOT NULL").select("edge", "group_size", "keep_id").join(F.broadcast(linked), "edge")
    edges = sizes.select("edge", F.sum("group_size").over(same).alias("all_size"), F.max_by("keep_id", "edge").over(same).alias("all_keep"), F.max("edge").over(same).alias("all_edge"))
    # two rows of four numbers at most for each partition of the sort: 64 bytes a partition, however large the input
    return runs.join(F.broadcast(edges), "edge", "left").select(
        F.col("id").alias("doc_id"),
        F.coalesce("all_keep", "keep_id").alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"),
        (F.col("last") & (F.col("edge").isNull() | (F.col("edge") == F.col("all_edge")))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: those that exact_groups keeps.

    Whole rows go through one sort; it is the only shuffle of texts, and only the last row of each run is written. Null
    texts are empty; a null doc_id stays only where its text has no other; of repeated rows with one doc_id and text one
    stays; columns may have any name; an empty table gives an empty result.
    """
    digest, prefix, edge = (free_name(docs, x) for x in ("_digest", "_prefix", "_edge"))
    norm = normalised("text")
    keyed = docs.withColumns({digest: F.sha2(norm, 256), prefix: F.substring(norm, 1, PREFIX_CHARS)})
    dealt = dealt_by_range(keyed, prefix, digest, "doc_id").sortWithinPartitions(prefix, digest, norm, "doc_id").drop(prefix)
    schema = StructType([*docs.schema.fields, StructField(edge, LongType())])
    last = materialize(dealt.mapInArrow(lambda batches: _last_rows(batches, "text", digest, edge), schema), "exact-last")
    linked = _linked(last.where(F.col(edge).isNotNull()).select(F.col(edge).alias("edge"), norm.alias("norm")))
    stays = linked.groupBy("chain").agg(F.max("edge").alias(edge), F.lit(True).alias("_stays")).drop("chain")
    rows = docs.columns
    return last.join(F.broadcast(stays.withColumnRenamed("_stays", mark := free_name(docs, "_stays"))), edge, "left").where(F.col(edge).isNull() | F.col(mark)).select(*(F.col(f"`{c}`") for c in rows))


QUERIES = {"op5_exact_dedup": lambda spark, sf_dir: exact_groups(table(spark, sf_dir, "documents"))}

ORACLES = {
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""
}
