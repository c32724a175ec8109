import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from utterlake.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, entries=256, rounds=4):
    """{(vec_id, vector): (code, error, label)} and the digest, one vector and entry at a time."""
    kept = [(i, [math.floor(1024 * x) for x in v], t) for i, v, t in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // 4
    cut = [[v[p * size : p * size + size] for p in range(4)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(4)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(4)] for c in cut]
    coded = [(r[0], "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f), r[2]) for r, f in zip(kept, found, strict=True)]
    by_label = {}
    for _, _, e, t in coded:
        by_label[t] = by_label.get(t, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((repr(i), c, e, by_label[t]) for i, c, e, t in coded), digest


def same(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = V.compressed(df, **options).collect()
    want, digest = plain(rows, options.get("entries", 256), options.get("rounds", 4))
    assert sorted((repr(r.vec_id), r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def _rows(n, dims, seed, spread=0.3):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(dims)], rng.choice([None, 1, 2, 3])) for i in rng.sample(range(10 * n), n)]


def test_equals_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 50)
    same(spark, _rows(400, 8, 1), entries=16, rounds=3)


def test_fewer_rows_than_entries_and_equal_vectors(spark):
    rows = _rows(20, 8, 2)
    same(spark, rows + [(i + 1000, rows[0][1], 1) for i in range(30)] + [rows[3], rows[3]])


def test_ties_go_to_the_lower_entry(spark):
    same(spark, [(i, [float(i % 2)] * 4, 0) for i in range(9)], entries=4, rounds=1)


def test_odd_rows(spark):
    rows = _rows(30, 8, 3) + [(5, None, 1), (6, [None] * 8, 1), (7, [float("nan")] + [0.0] * 7, 1), (8, [0.0] * 7 + [float("-inf")], None), (None, [0.5] * 8, None), (None, [0.25] * 8, 4)]
    same(spark, rows, entries=8)
    named = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("code", "error", "vector", "n", "kind", "_sum", "_of", "_name", "_hot")})
    assert V.compressed(named).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and V.compressed(named).count() == 32
    assert V.compressed(spark.createDataFrame([], SCHEMA)).collect() == []
    assert V.compressed(spark.createDataFrame(rows[30:34], SCHEMA)).collect() == []


def test_lengths_that_do_not_fit(spark):
    rows = _rows(20, 8, 4)
    got = {r.vec_id: r for r in V.compressed(spark.createDataFrame([*rows, (10**6, [1.0] * 7, 9), (10**6 + 1, [], 9)], SCHEMA)).collect()}
    assert len(got) == 22 and got[10**6].code is None and got[10**6 + 1].error is None and got[10**6].label_error is None
    assert {r.codebooks_sha256 for r in got.values()} == {plain(rows)[1]}
    uneven = V.compressed(spark.createDataFrame([(i, [float(i)] * 6, 1) for i in range(3)], SCHEMA)).collect()
    assert V.widths(6) == [2, 2, 1, 1] and [r.error for r in uneven] == [0, 0, 0]


def test_values_of_any_size(spark):
    """Small, middle and huge components: sums of squares beyond 32 and 64 bits stay exact."""
    same(spark, _rows(60, 8, 5, 3000.0), entries=8, rounds=2)
    same(spark, _rows(60, 8, 6, 1e5), "vec_id long, embedding array<double>, label int", entries=8, rounds=2)
    big = [(i, [float(x) * 1e12 for x in v], t) for i, v, t in _rows(40, 4, 7, 1.0)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")
    want, digest = plain(big, 4, 2)
    got = V.compressed(df, entries=4, rounds=2).collect()
    assert {r.codebooks_sha256 for r in got} == {digest} and sorted(r.code for r in got) == sorted(c for _, c, _, _ in want)
    assert all(r.error is None or r.error < 1 << 63 for r in got)


def test_labels_with_few_rows_and_many_alike(spark, monkeypatch):
    monkeypatch.setattr(V, "HOT_SHARE", 0.2)
    rows = [(i, v, 1 if i % 3 == 0 else None if i % 3 == 1 else i) for i, v, _ in _rows(90, 4, 8)]
    same(spark, rows, entries=4, rounds=1)
    monkeypatch.setattr(V, "HOT_SHARE", 2.0)
    same(spark, rows, entries=4, rounds=1)


def test_deeper_trees_give_the_same(spark):
    df = V.blocks_of(spark.createDataFrame(_rows(300, 8, 9), SCHEMA).repartition(9), "embedding")
    book = [np.arange(8).reshape(4, 2) for _ in range(4)]
    one = V._sums(df, book)
    assert sum(n.sum() for _, n in one) == 4 * 300 and all((a == b).all() and (n == m).all() for (a, n), (b, m) in zip(one, V._sums(df.coalesce(1), book), strict=True))
