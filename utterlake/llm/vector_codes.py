"""Product quantisation: each part of a vector becomes the number of the nearest entry of its part's codebook.

Vectors are cut into integer parts and stored once as columnar numpy blocks. Each round is one RDD treeAggregate over
the blocks: distances accumulate dimension by dimension over tiles of rows, sums and counts of the entries are int64
tensors filled by np.add.at and merged through a tree, so the driver meets a few tensors whatever the number of rows.
All arithmetic is on integers, so results do not hang on the order or the number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.runtime import discard, materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK, TILE = 8192, 256
#: Components up to these bounds are stored in so many bytes; sums of the larger ones stay below 2 ** 63 for 2 ** 38 rows.
_STORED = ((1 << 15, "<i2"), (1 << 25, "<i4"))
#: A label with at least this share of the rows is looked up where the rows are; there are at most 1,000 such labels.
HOT_SHARE = 1 / 1000


def usable(vector: Column) -> Column:
    """Not null, and no component is null, non-finite or beyond a double once it is scaled."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")), F.lit(False))), F.lit(False))


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x): integers where they are small, else floats that hold exactly that integer."""
    whole = np.floor(values.astype(np.float64) * SCALE)
    most = np.abs(whole).max(initial=0)
    return next((whole.astype(kind) for bound, kind in _STORED if most < bound), whole)


def _exact(values: np.ndarray) -> np.ndarray:
    """values as Python's integers where they may leave 64 bits, else as int64."""
    if values.dtype.kind != "f":
        return values
    return np.array([int(x) for x in values.ravel().tolist()], object).reshape(values.shape)


def nearest(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest entry, squared distance) of each vector; ties go to the lower number.

    columns: (dimensions, rows), book: (entries, dimensions), integers of any size.
    """
    dims, n = columns.shape
    columns, entries = _exact(columns), _exact(book)
    most = max((int(np.abs(x).max()) if x.dtype == object else int(np.abs(x.astype(np.int64)).max()) for x in (columns, entries) if x.size), default=0)
    reach = 4 * most * most * max(1, dims)
    kind = np.int32 if reach < 1 << 31 else np.int64 if reach < 1 << 63 else object
    columns, entries = columns.astype(kind), np.ascontiguousarray(entries.T.astype(kind))
    codes, least = np.zeros(n, np.int64), np.zeros(n, object if kind is object else np.int64)
    step = np.empty((min(TILE, n), book.shape[0]), kind)
    total = np.empty_like(step)
    for at in range(0, n, TILE):
        tile = columns[:, at : at + TILE]
        t, acc = step[: tile.shape[1]], total[: tile.shape[1]]
        acc[...] = 0
        for d in range(dims):
            np.subtract(tile[d][:, None], entries[d][None, :], out=t)
            np.multiply(t, t, out=t)
            np.add(acc, t, out=acc)
        best = acc.argmin(axis=1)
        codes[at : at + TILE], least[at : at + TILE] = best, acc[np.arange(len(best)), best]
    return codes, least


def widths(dims: int) -> list[int]:
    """Dimensions of each part; where they cannot be equal, the first parts have one more."""
    return [len(x) for x in np.array_split(np.arange(dims), PARTS)]


def _matrix(lists: pa.Array) -> np.ndarray:
    """(rows, dimensions) of vectors of one length without nulls."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def blocks_of(vectors: DataFrame, vector: str) -> DataFrame:
    """(n, kind, columns): up to BLOCK vectors a row, all values of a dimension side by side. One row of many bytes spares the way to Python a million small ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: list[np.ndarray]) -> pa.RecordBatch:
            whole = scaled(np.concatenate(rows).T)
            return pa.RecordBatch.from_pydict({"n": pa.array([whole.shape[1]], pa.int32()), "kind": [whole.dtype.str], "columns": [np.ascontiguousarray(whole).tobytes()]})

        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(_matrix(b.column(0)))
                n += b.num_rows
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if held:
            yield block(held)

    return vectors.select(F.col(vector).cast("array<double>")).mapInArrow(run, "n int, kind string, columns binary")


def _sums(blocks: DataFrame, books: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part the componentwise sums (dimensions, entries) and the counts of the vectors nearest to each entry."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    cuts = np.cumsum([b.shape[1] for b in books])[:-1]

    def add(acc, row):
        columns = np.frombuffer(row.columns, row.kind).reshape(-1, row.n)
        acc = acc or [(np.zeros((b.shape[1], b.shape[0]), np.int64), np.zeros(b.shape[0], np.int64)) for b in shared.value]
        out = []
        for part, book, (sums, counts) in zip(np.split(columns, cuts), shared.value, acc, strict=True):
            codes, _ = nearest(part, book)
            part = _exact(part)
            sums = sums.astype(object) if part.dtype == object else sums
            for d in range(len(part)):
                np.add.at(sums[d], codes, part[d].astype(sums.dtype))
            np.add.at(counts, codes, 1)
            out.append((sums, counts))
        return out

    def merge(a, b):
        return [(s + t, n + m) for (s, n), (t, m) in zip(a, b, strict=True)] if a and b else a or b

    rows = blocks.rdd
    try:
        return rows.treeAggregate(None, add, merge, depth=2 if rows.getNumPartitions() <= 1024 else 3)
    finally:
        shared.unpersist()


def _moved(book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each entry becomes the floor of its parts' mean; unused ones stay."""
    used = counts > 0
    out = book.astype(object if sums.dtype == object or book.dtype == object else np.int64)
    out[used] = (sums[:, used] // counts[used]).T
    return out


def codebooks(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook (entries, dimensions) of each part after all rounds; none where there are no usable vectors.

    They begin as the parts of the usable vectors with the smallest keys (null keys last; rows of one key by their vectors).
    """
    kept = vectors.where(usable(F.col(vector)))
    first = kept.select(F.col(vector).cast("array<double>").alias("v"), key).orderBy(F.col(key).asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return []
    dims = len(first[0].v)
    whole = _exact(np.floor(np.array([r.v for r in first if len(r.v) == dims], np.float64).reshape(-1, dims) * SCALE))
    whole = whole.astype(np.int64) if max((abs(int(x)) for x in whole.ravel()), default=0) < 1 << 62 else whole
    books = np.split(whole, np.cumsum(widths(dims))[:-1], axis=1)
    blocks = materialize(blocks_of(kept.where(F.size(vector) == dims), vector), "part-blocks")
    for _ in range(rounds):
        books = [_moved(b, s, n) for b, (s, n) in zip(books, _sums(blocks, books), strict=True)]
    discard(blocks)
    return books


def encoded(vectors: DataFrame, books: list[np.ndarray], vector: str = "embedding") -> DataFrame:
    """The rows with a usable vector, and code (two hex digits a part) and error (squared distances summed over the parts).

    A vector of another length than the codebooks' has null code and error, an error beyond 64 bits is null.
    """
    kept = vectors.where(usable(F.col(vector)))
    dims, cuts = sum(b.shape[1] for b in books), np.cumsum([b.shape[1] for b in books])[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            fits = np.array([len(x) == dims for x in lists], bool)
            codes, errors = np.full(len(fits), None, object), np.full(len(fits), None, object)
            if fits.any():
                columns = scaled(_matrix(lists.filter(pa.array(fits))).T)
                found = [nearest(part, book) for part, book in zip(np.split(columns, cuts), books, strict=True)]
                names = np.stack([c.astype(np.uint8) for c, _ in found], axis=1).tobytes().hex()
                width = 2 * len(books)
                codes[fits] = [names[i : i + width] for i in range(0, len(names), width)]
                errors[fits] = [e if e < 1 << 63 else None for e in sum(e for _, e in found).tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[*b.schema.names[:-1], "code", "error"])

    others = [c for c in kept.columns if c != vector]
    schema = ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in others] + ["code string", "error long"])
    return kept.select(*others, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, schema)


def label_errors(coded: DataFrame, key: str, label: str) -> DataFrame:
    """coded with label_error, the errors summed over the rows of its label; null labels count as one.

    Labels that hold many rows are few, so they go to the rows; the rest meet in a join, in which no label is large.
    """
    sums = materialize(coded.groupBy(F.col(label).alias("_of")).agg(F.sum("error").alias("_sum"), F.count(F.lit(1)).alias("_n")), "label-sums")
    rows = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = F.col("_n") >= max(1, rows * HOT_SHARE)
    looked = coded.join(F.broadcast(sums.where(hot).select("_of", F.col("_sum").alias("_hot"), F.lit(True).alias("_is_hot"))), F.col(label).eqNullSafe(F.col("_of")), "left").drop("_of")
    cold = sums.where(~hot)
    if cold.isEmpty():
        return looked.withColumn("label_error", F.col("_hot")).drop("_hot", "_is_hot")
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("?"))
    own = F.when(F.col("_is_hot"), F.concat_ws("", F.lit("!"), F.col(key).cast("string"))).otherwise(name(F.col(label)))
    met = looked.withColumn("_name", own).join(cold.select(name(F.col("_of")).alias("_name"), F.col("_sum").alias("_cold")), "_name", "left")
    return met.withColumn("label_error", F.when(F.col("_is_hot"), F.col("_hot")).otherwise(F.col("_cold"))).drop("_name", "_cold", "_hot", "_is_hot")


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every row with a usable vector; rows without one go.

    Null keys come last among the first entries and stay null, repeated rows are coded each, with fewer rows than entries
    every row makes one. Vectors of another length than that of the smallest key's vector have null code and error. Other
    columns are ignored, an empty table gives an empty result. codebooks_sha256: of all final components in decimal,
    comma-joined by part, entry, position.
    """
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    books = codebooks(rows, "vec_id", "vector", entries, rounds)
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    coded = materialize(encoded(rows, books, "vector"), "codes") if books else encoded(rows, books, "vector")
    return label_errors(coded, "vec_id", "label").select(F.col("vec_id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    dims = 16
    parts = f"p AS MATERIALIZED (SELECT vec_id, label, part, list_transform(embedding[part * {dims} + 1:part * {dims} + {dims}], lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM kept, (SELECT unnest(range({PARTS})) AS part))"
    kept = "kept AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"
    first = f"c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM p QUALIFY e < {ENTRIES})"
    steps = []
    near = "SELECT p.vec_id, any_value(p.label) AS label, p.part, any_value(p.v) AS v, min({{'d': {d}, 'e': c.e}}) AS best FROM p JOIN {c} c ON p.part = c.part GROUP BY p.vec_id, p.part"
    distance = "+".join(f"(p.v[{i}] - c.v[{i}]) * (p.v[{i}] - c.v[{i}])" for i in range(1, dims + 1))
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(d=distance, c=f'c{i}')})")
        if i < ROUNDS:
            mean = "[" + ", ".join(f"CAST(sum(v[{k}]) // count(*) - CASE WHEN sum(v[{k}]) % count(*) < 0 THEN 1 ELSE 0 END AS BIGINT)" for k in range(1, dims + 1)) + "]"
            steps.append(f"m{i} AS (SELECT part, best.e AS e, {mean} AS v FROM a{i} GROUP BY 1, 2)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (part, e))")
    digest = f"(SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) FROM c{ROUNDS})"
    code = f"k AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)"
    return f"WITH {kept}, {parts}, {first}, {', '.join(steps)}, {code} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest} AS codebooks_sha256 FROM k"


QUERIES = {"op13_vector_codes": lambda spark, sf_dir: compressed(table(spark, sf_dir, "embeddings"))}
ORACLES = {"op13_vector_codes": _sql()}
