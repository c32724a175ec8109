import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from utterlake.functions import text as T
from utterlake.operators import corpus as C
from utterlake.operators import cutting


def masked(spark, scores, allowed):
    got = spark.createDataFrame([(scores,)], "s array<double>").select(T.allowed_scores(F.col("s"), allowed).alias("m")).first().m
    return [None if x is None else x for x in got]


def test_mask_keeps_allowed_places(spark):
    inf = float("-inf")
    assert masked(spark, [1.0, 2.0, None, 4.0], [0, 2, 3]) == [1.0, inf, None, 4.0]
    assert masked(spark, [1.0, 2.0], []) == [inf, inf] and masked(spark, [], [1]) == []
    scores = [float(i) for i in range(200)]
    for ids in ([63], [62, 63, 64], [127, 128, 199], [500], range(64)):
        assert masked(spark, scores, ids) == [x if x in set(ids) else inf for x in scores]


def test_ids_come_from_the_vocabulary(spark):
    vocabulary = spark.createDataFrame([("<a1>", 5), ("<a2>", 63), ("b", 7), (None, 9), ("<a3>", None), ("<a4>", -3), ("<a5>", 130)], "piece string, id long")
    words = C.allowed_ids(vocabulary, F.startswith("piece", F.lit("<a")))
    assert words == T.packed([5, 63, 130]) and len(words) == 3
    assert masked(spark, [1.0] * 140, T.bitmap(words)) == [1.0 if i in (5, 63, 130) else float("-inf") for i in range(140)]
    assert C.allowed_ids(vocabulary, F.col("piece") == "none") == []
    with pytest.raises(ValueError):
        C.allowed_ids(spark.createDataFrame([("x", C.MOST_IDS)], "piece string, id long"), F.lit(True))


def test_time_of_a_mask_does_not_hang_on_its_ids(spark):
    rows = spark.range(40).select(F.expr("transform(sequence(1, 20000), x -> cast(x as double))").alias("s")).cache()
    rows.count()

    def seconds(ids):
        began = time.time()
        rows.select(F.size(F.filter(T.allowed_scores(F.col("s"), ids), lambda x: x > 0)).alias("n")).agg(F.sum("n")).collect()
        return time.time() - began

    seconds([1])
    few, many = min(seconds([1, 19999]) for _ in range(3)), min(seconds(range(0, 20000, 2)) for _ in range(3))
    rows.unpersist()
    assert many < 3 * few + 1


def plain_cut(word, vocabulary):
    out, at = [], 0
    while at < len(word):
        best = next((word[at : at + n] for n in range(len(word) - at, 0, -1) if word[at : at + n] in vocabulary), None)
        out.append((best or word[at], vocabulary.get(best)))
        at += len(best or word[at])
    return out


def test_cuts_are_the_longest_pieces():
    rng = random.Random(1)
    pieces = {"".join(rng.choices("abcé漢😀", k=rng.randint(1, 5))) for _ in range(60)}
    vocabulary = {p: i for i, p in enumerate(sorted(pieces))}
    trie = cutting.Trie(list(vocabulary), list(vocabulary.values()))
    words = ["".join(rng.choices("abcé漢😀x", k=rng.randint(0, 12))) for _ in range(500)]
    assert [list(zip(p, i, strict=True)) for p, i in trie.cut(words)] == [plain_cut(w, vocabulary) for w in words]
    assert cutting.Trie([], []).cut(["ab", ""]) == [(["a", "b"], [None, None]), ([], [])]
    assert cutting.Trie(["a", "a", ""], [5, 3, 1]).cut(["a"]) == [(["a"], [3])]


def test_texts_are_cut_within_words(spark):
    vocabulary = spark.createDataFrame([("ab", 0), ("abc", 1), ("c", 2), ("b c", 9), (None, 4), ("d", None)], "piece string, id int")
    rows = spark.createDataFrame([(1, "abcab  c\td"), (2, None), (3, " \n"), (4, "abcabcd" * 3000)], "n int, text string").withColumns({c: F.lit("clash") for c in ("ids", "w", "piece")})
    got = {r.n: r for r in cutting.cut_texts(rows, "text", vocabulary).collect()}
    assert got[1].pieces == ["abc", "ab", "c", "d"] and got[1].ids == [1, 0, 2, None] and got[1].w == "clash"
    assert (got[2].pieces, got[2].ids) == (None, None) and got[3].pieces == [] and len(got[4].pieces) == 9000
    assert cutting.cut_texts(rows.limit(0), "text", vocabulary).collect() == []


def test_large_vocabularies_are_refused(spark, monkeypatch):
    monkeypatch.setattr(cutting, "SHIPPED_BYTES", 30)
    with pytest.raises(ValueError):
        cutting.cut_texts(spark.createDataFrame([("x",)], "text string"), "text", spark.range(9).select(F.col("id").cast("string").alias("piece"), "id"))


def test_all_places_at_once_agree_with_single_ones():
    trie = cutting.Trie(["a", "ab", "abc", "bc"], [0, 1, 2, 3])
    code = np.array([ord(c) for c in "abcab"], np.int64)
    size, ids = trie.longest(code, 5 - np.arange(5))
    assert size.tolist() == [3, 2, 0, 2, 0] and ids.tolist() == [2, 3, -1, 1, -1]


def test_workers_cut_slices_of_a_batch(spark, monkeypatch):
    """A batch is cut a slice at a time, whatever it holds, and gives all its rows in order."""
    texts = ["ab " * 1000, None, "", "abc", "é😀 " * 500, "ab " * 5000, "c"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["n", "text"])
    monkeypatch.setattr(cutting, "SLICE_BYTES", 4000)
    parts = list(cutting._slices(batch, 1))
    assert len(parts) > 6 and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(p.num_rows and sum(len((t or "").encode()) for t in p.column(1).to_pylist()[1:]) <= 4000 for p in parts)
    assert [p.num_rows for p in cutting._slices(batch.slice(0, 0), 1)] in ([], [0])
    counts = spark.createDataFrame([(2, [1, 2, 3]), (None, None), (4, [])], "b int, a array<int>")
    assert C.token_ratio(counts, F.col("b"), F.col("a")).first() == (3, 6, 3, 2.0)


def test_columns_are_the_cuts():
    rng = random.Random(2)
    trie = cutting.Trie(["a", "ab", "é漢", "漢😀b", "abcab"], [7, 1, 2, 3, 4])
    for words in ([], [""], ["".join(rng.choices("abcé漢😀x", k=rng.randint(0, 12))) for _ in range(500)], ["abcé" * 5000, "x"]):
        pieces, ids = trie.columns(words)
        assert list(zip(pieces.to_pylist(), ids.to_pylist(), strict=True)) == trie.cut(words)
