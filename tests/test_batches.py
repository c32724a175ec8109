import random

import pytest
from pyspark.sql import functions as F

from utterlake.operators import batches
from utterlake.operators import corpus as C
from utterlake.runtime import numbered
from utterlake.sources import pruned, sinks


def test_batches_keep_the_budget(spark):
    rng = random.Random(1)
    rows = [(i, int(rng.lognormvariate(5, 1))) for i in range(3000)] + [(9001, None), (9002, -5), (9003, 10**6), (9004, 0)]
    df = spark.createDataFrame(rows, "id long, n long").repartition(5)
    got = batches.batched(df, "id", "n", 5000)
    sizes = {}
    for r in got.collect():
        sizes.setdefault(r.batch, []).append(max(0, r.n or 0))
    assert sorted(sizes) == list(range(len(sizes))) and sum(map(len, sizes.values())) == len(rows)
    assert all(len(v) * max(v) <= 5000 or len(v) == 1 for v in sizes.values())
    plain = numbered(df, [], ["id"], "at").withColumn("batch", F.floor(F.col("at") / 16))
    assert batches.padding(got, "n").first().share < batches.padding(plain, "n").first().share / 2


def test_batches_do_not_hang_on_tasks(spark):
    df = spark.range(500).select("id", (F.col("id") * 37 % 101).alias("n"))
    one, many = ({(r.id, r.batch) for r in batches.batched(df.repartition(k), "id", "n", 700).collect()} for k in (1, 7))
    assert one == many


def test_no_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 5, "a", "b", "c")], "id int, n int, _bucket string, _at string, _row string")
    assert batches.batched(df.limit(0), "id", "n", 10).collect() == [] and batches.padding(batches.batched(df.limit(0), "id", "n", 10), "n").first().share == 0
    assert [tuple(r) for r in batches.batched(df, "id", "n", 10).collect()] == [(1, 5, "a", "b", "c", 0)]


def test_only_shards_that_may_hold_a_key_are_opened(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    rows = spark.range(5000).select("id", F.md5(F.col("id").cast("string")).alias("h"))
    pruned.append_indexed(rows.where("id < 4000"), path, ["h"], "id", 100)
    pruned.append_indexed(rows.where("id >= 4000"), path, ["h"], "id", 100)
    keys = [3, 1999, 4500, 10**9, None]
    wanted = spark.createDataFrame([(k,) for k in [*keys, 3]], "id long")
    got, opened = pruned.read_wanted(spark, path, wanted, "id")
    whole = sinks.read_shards(spark, path).join(wanted, "id", "left_semi")
    assert sorted(map(tuple, got.select("id", "h", "shard").collect())) == sorted(map(tuple, whole.select("id", "h", "shard").collect()))
    assert len(got.collect()) == 3 <= len(opened) <= 5
    shards = {r.shard for r in whole.collect()}
    assert shards <= set(opened)
    read = {p.split("shard=")[1].split("/")[0] for p in got.inputFiles()}
    assert read == {str(i) for i in opened}
    assert pruned.read_wanted(spark, path, wanted.where("id > 10000"), "id")[1] == []
    assert pruned.read_wanted(spark, path, wanted.limit(0), "id")[0].collect() == []


def test_shards_without_an_index_are_opened(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/cache"
    rows = spark.range(300).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    wanted = spark.createDataFrame([("k7",), ("k205",)], "k string")
    sinks.append_shards(rows.where("k < 'k2'"), path, ["k"], 20)
    assert len(pruned.read_wanted(spark, path, wanted, "k")[1]) == sinks.next_shard(spark, path)
    old = sinks.next_shard(spark, path)
    pruned.append_indexed(rows.where("k >= 'k2'"), path, ["k"], "k", 20)
    got, opened = pruned.read_wanted(spark, path, wanted, "k")
    assert sorted(r.k for r in got.collect()) == ["k205", "k7"] and set(range(old)) <= set(opened) and len(opened) <= old + 2
    monkeypatch.setattr(pruned, "WANTED", 1)  # too many keys for the filters: ranges alone
    assert sorted(r.k for r in pruned.read_wanted(spark, path, wanted, "k")[0].collect()) == ["k205", "k7"]


NAMES = ("_n", "_known", "_hit", "_reason", "_part", "_row", "_at", "_k0", "_g0", "_of", "_shift", "_first")


@pytest.fixture()
def clashing(spark):
    df = spark.createDataFrame([(i, "en" if i % 2 else "hi", "words", 1.0, ["a", "b"]) for i in range(6)], "doc_id long, lang string, text string, duration double, words array<string>")
    return df.withColumns({c: F.concat(F.lit(f"{c} of "), "doc_id") for c in NAMES})


def test_core_operators_leave_other_columns_alone(spark, clashing):
    ids, given = clashing.select("doc_id"), {tuple(r) for r in clashing.select("doc_id", *NAMES).collect()}
    vocabulary = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "piece string, id long")
    tables = [
        C.capped(clashing, "lang", 9), C.pool(clashing, "lang", "doc_id", 9), C.balanced(clashing, ["en"], 0.9), C.split_validation(clashing, 0.3), C.classified(clashing, ids), C.cached(clashing, ids, "doc_id")[0],
        C.tolerant(clashing, F.lit(None).cast("string"))[0], C.tolerant(clashing, F.lit("bad"))[1], numbered(clashing, ["lang"], ["doc_id"], "at"), C.token_ids(clashing, "words", vocabulary),
    ]
    for t in tables:
        assert {tuple(r) for r in t.select("doc_id", *NAMES).collect()} == given
    assert C.cached(ids.withColumn("_hit", F.lit(1)), clashing, "doc_id")[0].count() == 6


@pytest.mark.parametrize("shipped", [C.SHIPPED_PIECES, 1])
def test_repeated_pieces_have_one_id_at_every_size(spark, monkeypatch, shipped):
    monkeypatch.setattr(C, "SHIPPED_PIECES", shipped)
    vocabulary = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 4)], "piece string, id long")
    rows = spark.createDataFrame([(1, ["a", "b"], "x"), (2, ["a", "c"], "y"), (3, None, "z"), (4, [], "w")], "n int, words array<string>, ids string")
    got = {r.n: (r.ids, r.unknown) for r in C.token_ids(rows, "words", vocabulary).collect()}
    assert got[1] == ([1, 3], []) and got[2] == (None, ["c"]) and got[4] == ([], [])


