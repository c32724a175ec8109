import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.cases import ODD, none, odd
from utterlake.llm import exact_dedup, simhash
from utterlake.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fps = [plain_fingerprint(t) for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            root[find(j)] = find(i)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return sorted(((-1 if d is None else d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def near_rows(n=160):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            own = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
        else:
            own = rng.choices(words, k=rng.randint(3, 300))
        rows.append((i, " ".join(own)))
    return rows


def test_simhash_groups_match_all_pairs(spark):
    rows = near_rows()
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == plain_components(rows)


@pytest.mark.parametrize("parts", [simhash.PARTS, (2,), (3,), (4,), (5,)])
def test_near_pairs_lose_no_link(spark, monkeypatch, parts):
    monkeypatch.setattr(simhash, "PARTS", parts)
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for d in range(1, 6):
            x = f
            for b in rng.sample(range(64), d):
                x ^= 1 << b
            fps.add(x)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = {(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}


def test_simhash_odd_rows(spark):
    got = simhash.near_groups(odd(spark)).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == plain_components([(r[0], r[1]) for r in ODD])
    assert simhash.near_groups(none(spark)).collect() == []
    kept = simhash.drop_near_copies(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == [1, 3, 6, 7, 8]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(components(edges).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def plain_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    return groups


def test_exact_groups(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Same Text", "same text", None, "", "ÄB", "äb", f"own {i}"])) for i in range(500)]
    rows += [(1000 + i, "hot " * 40) for i in range(1500)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    groups, texts = plain_exact(rows), dict(rows)
    assert len(got) == len(rows)
    for r in got:
        own = groups[(texts[r.doc_id] or "").translate(LOWER)]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))


def test_exact_odd_rows(spark):
    got = exact_dedup.exact_groups(odd(spark)).collect()
    assert len(got) == len(ODD)
    assert sum(r.kept for r in got) == len(plain_exact([(r[0], r[1]) for r in ODD]))
    assert {r.keep_id for r in got if r.group_size == 3} == {10}
    assert exact_dedup.exact_groups(none(spark)).collect() == []
    kept = exact_dedup.drop_exact_copies(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted((r.doc_id or -1) for r in kept.select("doc_id").collect()) == [-1, 4, 5, 6, 7, 8, 10]


def test_text_over_many_partitions_is_one_group(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = exact_dedup.exact_groups(rows).where("group_size > 1").groupBy("keep_id", "group_size").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [tuple(r) for r in got] == [(5997, 2000, 2000, 1)]


def test_wide_groups_are_chosen_where_fingerprints_are_many():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 4096, dtype=np.int64).view(np.uint64)
    together = simhash._together(fps).reshape(64, 64)

    def cost(parts, n):
        groups = simhash.bit_groups(together, len(fps), parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        share = [np.bincount(simhash._values(fps, b), minlength=256) for g in groups for b in simhash._blocks(g)]
        within = simhash._within(groups, [h * (n / len(fps)) for h in share], n, 4)
        chosen, costs = simhash.thresholds(fps[:200], groups, within, n)
        assert (chosen.sum(1) == 4 - parts + 1).all()
        return costs.mean()

    assert [min((2, 3, 4), key=lambda p: cost(p, n)) for n in (1_000, 1_000_000, 10**9)] == [4, 3, 2]


@pytest.mark.parametrize("tasks", [1, 7])
def test_the_rows_that_stay_are_those_of_the_groups(spark, tasks):
    """One hot text over many partitions, runs at their edges, repeated rows, nulls and columns of the operator's own names."""
    rng = random.Random(8)
    texts = ["Hot text here", "hot TEXT here", None, "", "b", "B", *(f"text {i % 40}" for i in range(200))]
    rows = [(rng.choice([None, *range(300)]), rng.choice(texts[:2]) if rng.random() < 0.4 else rng.choice(texts), i) for i in range(900)]
    docs = spark.createDataFrame([*rows, *rows[:50]], "doc_id long, text string, n int").withColumns({c: F.lit("clash") for c in ("_digest", "_edge", "_stays", "edge", "norm", "chain")})
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        kept = exact_dedup.drop_exact_copies(docs).collect()
        told = exact_dedup.exact_groups(docs).where("kept").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    name = lambda r: (r.doc_id, (r.text or "").translate(LOWER))
    best = {}
    for d, t, _ in rows:
        key = (t or "").translate(LOWER)
        best[key] = max(best.get(key, -1), -1 if d is None else d)
    assert sorted((t, -1 if d is None else d) for d, t in map(name, kept)) == sorted(best.items()) and len(told) == len(best)
    assert kept[0].asDict().keys() == set(docs.columns)
    assert exact_dedup.drop_exact_copies(none(spark)).collect() == []
