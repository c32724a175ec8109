import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlake.operators import corpus, overlap


def plain(rows, size):
    """{group: {position: sample}} one wave after the other."""
    groups, out = {}, {}
    for g, o, w in rows:
        if w:
            groups.setdefault(g, []).append((o, w))
    for g, own in groups.items():
        own.sort()
        at, total = 0, {}
        for i, (_, w) in enumerate(own):
            start = max(0, at)
            for k, x in enumerate(w):
                if i and k < size:
                    x = x * k / max(1, size - 1)
                if i + 1 < len(own) and k >= len(w) - size:
                    x = x * (len(w) - 1 - k) / max(1, size - 1)
                total[start + k] = total.get(start + k, 0.0) + x
            at += len(w) - size
        out[g] = total
    return out


def check(spark, rows, size, tasks=4):
    df = spark.createDataFrame(rows, "g string, o int, w array<double>").repartition(tasks)
    got = {}
    for r in corpus.crossfaded(df, "g", "o", "w", size).collect():
        assert r.pos not in got.setdefault(r.g, {})
        got[r.g][r.pos] = r["sample"]
    want = plain(rows, size)
    assert got.keys() == want.keys()
    for g in want:
        assert got[g].keys() == want[g].keys() and all(got[g][p] == pytest.approx(want[g][p], abs=1e-9) for p in want[g]), g


def waves(seed, least, most, groups):
    rng = random.Random(seed)
    return [(g, i, [rng.uniform(-1, 1) for _ in range(rng.randint(least, most))]) for g, n in groups.items() for i in range(n)]


@pytest.mark.parametrize(("least", "most", "size"), [(20, 60, 8), (8, 20, 8), (1, 20, 8), (1, 5, 8), (1, 9, 0), (1, 9, 1)])
def test_any_lengths_equal_a_plain_sum(spark, monkeypatch, least, most, size):
    monkeypatch.setattr(overlap, "BLOCK", 16)
    check(spark, waves(size, least, most, {"a": 30, "b": 1, None: 7, "c": 2}) + [("d", 0, []), ("d", 1, None), ("e", 0, [0.5])], size)


def test_one_group_spans_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = waves(3, 20, 40, {"hot": 300, "b": 3})
        df = spark.createDataFrame(rows, "g string, o int, w array<double>").repartition(6)
        assert overlap._placed(df, 8).where("g = 'hot'").select("part").distinct().count() >= 3
        check(spark, rows, 8, 6)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_middles_are_not_shuffled(spark):
    """Of long waves only heads and tails reach the addition."""
    rows = [("a", i, [1.0] * 1000) for i in range(10)]
    pieces = overlap.overlapped(spark.createDataFrame(rows, "g string, o int, w array<double>"), "g", "o", "w", 8).collect()
    assert sorted(len(r.wave) for r in pieces) == [8] * 9 + [984] * 8 + [992] * 2
    assert sum(map(np.sum, (r.wave for r in pieces))) == pytest.approx(10 * 1000 - 9 * 8)


def test_no_rows_and_clashing_columns(spark):
    schema = "g string, o int, w array<double>"
    assert overlap.overlapped(spark.createDataFrame([], schema), "g", "o", "w", 8).collect() == []
    named = spark.createDataFrame([("a", 0, [1.0])], schema).withColumns({c: F.lit("clash") for c in ("part", "no", "rel", "len", "at", "v", "t", "block", "wave")})
    assert [tuple(r) for r in overlap.overlapped(named, "g", "o", "w", 8).collect()] == [("a", 0, [1.0])]
