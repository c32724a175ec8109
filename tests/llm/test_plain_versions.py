"""Operators against plain versions of themselves, and classifiers against labels that they did not learn from."""

import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import odd
from utterlake.llm import licences, mixing, quality, syncmers, toxicity

SF = "/root/testdata/sf0.01"
WORDS = [w + s for w in ("tree", "river", "stone", "cloud", "light", "house", "north") for s in ("", "s", "ing", "ed", "ly", "er")]


def plain_rake(cells):
    """cells: {(source, lang, topic): tokens} -> weights."""
    targets = []
    for i in range(3):
        own = defaultdict(float)
        for k, n in cells.items():
            own[k[i]] += n
        power = {v: n**mixing.TEMPER for v, n in own.items()}
        targets.append({v: p / sum(power.values()) * sum(own.values()) for v, p in power.items()})
    weights = {k: float(n) for k, n in cells.items()}
    for _ in range(mixing.SWEEPS):
        for i, target in enumerate(targets):
            now = defaultdict(float)
            for k, w in weights.items():
                now[k[i]] += w
            weights = {k: w * target[k[i]] / now[k[i]] if now[k[i]] else 0.0 for k, w in weights.items()}
    return weights


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_raking(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", broadcast)
    monkeypatch.setattr(mixing, "CHECKS", 1)
    monkeypatch.setattr(mixing, "SWEEPS", sweeps := 4 if not broadcast else 12)
    rng = random.Random(1)
    cells = {(f"s{i}", lang, topic): rng.randint(0, 10 ** rng.randint(1, 5)) for i in range(6) for lang in ("en", "de") for topic in ("short", "long") if rng.random() < 0.8}
    cells["s0", "en", "long"] = 10**6
    table = spark.createDataFrame([(*k, n) for k, n in cells.items()], "source string, lang string, topic string, tokens long")
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(table, sweeps).collect()}
    assert got == pytest.approx(plain_rake(cells))


def test_mixing_is_the_same_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHECKS", 1)
    monkeypatch.setattr(mixing.rake, "__defaults__", (2, None))
    few = sorted(map(str, mixing.mix(odd(spark)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert sorted(map(str, mixing.mix(odd(spark)).collect())) == few


def test_sampled_tokens_meet_the_raked_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice((20, 20, 60, 150)), *rng.choice([("en", "hot")] * 20 + [("de", "hot"), ("en", "a"), ("de", "a"), ("fr", "b")]), 0) for i in range(12_000)]
    cells = defaultdict(int)
    for _, text, lang, source, _ in rows:
        n = len(text.split())
        cells[source, lang, "short" if n < 100 else "article"] += n
    weights = plain_rake(cells)
    assert max(mixing.KEEP * weights[k] / n for k, n in cells.items()) > 1.25  # some cells must grow
    docs, got = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), defaultdict(int)
    for r in mixing.sample_mix(docs).collect():
        n = len(r.text.split())
        got[r.source, r.lang, "short" if n < 100 else "article"] += n
    assert sum(got.values()) == pytest.approx(mixing.KEEP * sum(cells.values()), rel=0.02)
    told = defaultdict(int)
    for r in mixing.mix(docs).collect():
        told[r.source, r.lang, r.topic] += r.n_tokens * r.copies
    assert told == got
    for i in range(3):
        for v in {k[i] for k in cells}:
            target, share = (sum(n for k, n in x.items() if k[i] == v) / sum(x.values()) for x in (weights, got))
            assert share == pytest.approx(target, rel=0.05), v


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
def test_expected_shares_of_real_documents_meet_every_target(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = spark.createDataFrame([("en", 5.0), ("de", 3.0), ("fr", 1.0), ("es", 1.0), ("none", 4.0)], "value string, share double")
    for given in (None, {"lang": lang}):
        got = mixing.mix(docs, given).collect()
        for by in mixing.BY:
            own, expected, target = defaultdict(int), defaultdict(float), {}
            for r in got:
                own[r[by]] += r.n_tokens
                expected[r[by]] += r.n_tokens * r.expected
            target = {v: n**mixing.TEMPER for v, n in own.items()} if not (given and by in given) else {"en": 5, "de": 3, "fr": 1, "es": 1}
            for v in own:
                assert expected[v] / sum(expected.values()) == pytest.approx(target[v] / sum(target.values()), rel=0.01), (by, v)


def test_anchors_match_a_plain_search(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(WORDS[: rng.choice((2, 10, 42))], k=rng.choice((0, 1, 4, 5, 6, 9, 80))))) for i in range(60)]
    hashed = {tuple(r.p): r.h for r in spark.createDataFrame([([a, b],) for a in WORDS for b in WORDS], "p array<string>").select("p", F.xxhash64(F.xxhash64(F.get("p", 0)), F.xxhash64(F.get("p", 1))).alias("h")).collect()}
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", syncmers.anchors(F.col("text")).alias("a")).collect()
    for r in got:
        words, k = r.text.split(), syncmers.WORDS
        inner = [hashed[p] for p in zip(words, words[1:], strict=False)]
        want = [i for i in range(len(words) - k + 1) if min(inner[i : i + k - 1]) in (inner[i], inner[i + k - 2])] if len(words) >= k else [0] * bool(words)
        assert [a.place for a in r.a] == want


def test_a_moved_passage_keeps_its_anchors(spark):
    rng = random.Random(3)
    passage, before, after = (rng.choices([f"{w}{i}" for w in WORDS for i in range(50)], k=n) for n in (200, 37, 90))
    rows = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(before + passage + after))], "doc_id long, text string")
    one, two = ({(a.place, a.hash) for a in r.a} for r in rows.orderBy("doc_id").select(syncmers.anchors(F.col("text")).alias("a")).collect())
    assert len(one) > 60 and {(p + 37, h) for p, h in one} <= two


def test_likeness_is_the_jaccard_index_of_short_texts(spark):
    rows = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([1], []), ([5, 6], [5, 6])], "a array<int>, b array<int>")
    assert [r.x for r in rows.select(syncmers.likeness(F.col("a"), F.col("b")).alias("x")).collect()] == [0.5, 1.0, 0.0, 1.0]


def test_fingerprints_hold_every_anchor_and_its_place(spark):
    rng = random.Random(8)
    long, other, passage = ([f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(n)] for n in (20_000, 3_000, 60))
    altered = [*long[:9_000], *rng.choices(WORDS, k=30), *long[9_030:]]
    texts = [long, altered, long[:12_000] + passage + long[12_000:], other[:500] + passage + other[500:], other, ["word"] * 300, ["word"] * 150, long[10_000:] + long[:10_000], ["a"], []]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id int, text string")
    made = rows.select("doc_id", syncmers.anchors(F.col("text")).alias("anchors"), syncmers.packed(F.col("text")).alias("own")).select("*", syncmers.links(F.col("own")).alias("links"), syncmers.as_string(F.col("own")).alias("string"))
    links = {}
    for r in made.collect():
        got, place = [], 0
        for i in range(0, len(r.string), 9):
            place += int(r.string[i + 8], 16)
            got.append((int(r.string[i : i + 8], 16), place))
        assert got == [((a.hash & (1 << 64) - 1) >> 32, a.place) for a in r.anchors]
        after = [*((h, p - q) for (_, q), (h, p) in zip(got, got[1:], strict=False)), None]
        links[r.doc_id] = Counter((h, n) for (h, _), n in zip(got, after, strict=False))
    pairs = [(0, 0), (0, 1), (2, 3), (0, 4), (5, 6), (0, 7), (8, 8), (9, 9), (8, 9), (0, 2)]
    both = made.select(F.col("doc_id").alias("i"), F.col("links").alias("a")).crossJoin(made.select(F.col("doc_id").alias("j"), F.col("links").alias("b")))
    near = {(r.i, r.j): r.x for r in both.where(" OR ".join(f"i = {i} AND j = {j}" for i, j in pairs)).select("i", "j", syncmers.likeness(F.col("a"), F.col("b")).alias("x")).collect()}
    for i, j in pairs:
        union = (links[i] | links[j]).total()
        assert near[i, j] == pytest.approx((links[i] & links[j]).total() / union if union else 1.0), (i, j)
    assert 0.99 < near[0, 1] < 1 and near[2, 3] > 0 == near[0, 4] and near[5, 6] < 0.6 and near[0, 7] > 0.99


def test_licence_templates(spark):
    rows = [(i, "Some words first. " * (i % 9) + wording.upper() + ", and then some more.") for i, (_, wording, _) in enumerate(licences.TEMPLATES)]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, *_) in enumerate(licences.TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score == 1.0, label
    assert got[[t[0] for t in licences.TEMPLATES].index("gpl-2.0")].labels == "gpl,gpl-2.0"
    near = spark.createDataFrame([(0, "permission was granted to use the software, free of charge, by any person"), (1, "The general license of the public"), (2, "the zlib code, and identifier of a license")], "doc_id long, text string")
    assert {(r.labels, r.score) for r in licences.scan_licences(near).collect()} == {("", 0.0)}


def test_real_notices_are_labelled(spark):
    notices = {
        "gpl-3.0": "This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
        "apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "mpl-2.0": "// SPDX-License-Identifier: MPL-2.0", "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above copyright notice",
        "cc0-1.0": "Creative Commons Legal Code\n\nCC0 1.0 Universal", "unlicense": "This is free and unencumbered software released into the public domain.",
        "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "mit": "/* SPDX-License-Identifier: MIT */",
        "mit-text": "Permission is hereby granted, free of charge, to any natural or legal person obtaining a copy of this software and all associated documentation files",
    }
    rows = spark.createDataFrame([(i, f"Intro words.\n{t}\nmore of them") for i, t in enumerate(notices.values())], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in licences.scan_licences(rows).collect()}
    for i, label in enumerate(notices):
        assert label in got[i], (label, got[i])


def plain_scan(text):
    """Every template at every start, all cells of the band in order."""
    own, base = text.split(), {label for phrase, label in licences.BASE.items() if f" {phrase} " in f" {' '.join(text.split())} "}
    want, best = set(base), 1.0 if base else 0.0
    for label, wording, phrases in licences.TEMPLATES + licences._spdx():
        t = wording.split()
        for start in range(-len(t) - licences.SLACK, len(own)):
            length = defaultdict(int)
            for i in range(len(t)):
                for p in range(start + i, start + i + licences.SLACK + 1):
                    shift = lambda a, b: length[a, b] if start <= b - a <= start + licences.SLACK else 0
                    length[i, p] = max(shift(i - 1, p), shift(i, p - 1), shift(i - 1, p - 1) + (p >= 0 and own[p : p + 1] == [t[i]]))
            alike = max(length.values()) / len(t)
            window = f" {' '.join(own[max(0, start) : max(0, start + len(t) + licences.SLACK)])} "
            if alike >= licences.ALIKE and all(f" {p} " in window for p in phrases):
                want.add(label)
                best = max(best, alike)
    return ",".join(sorted(want)), best


def test_scans_match_a_comparison_at_every_place(spark):
    passage = next(w for label, w, _ in licences.TEMPLATES if label == "mit-text").replace("any", "every").replace("associated", "related")
    rng = random.Random(6)
    words = [w for _, wording, _ in licences.TEMPLATES for w in wording.split()]
    texts = [passage, f"any associated persons obtaining files with any person {'x ' * 40} {passage}"]
    for _ in range(40):
        inner = [w if rng.random() < 0.92 else rng.choice(words) for w in rng.choice(licences.TEMPLATES)[1].split()]
        for _ in range(rng.randint(0, 3)):
            inner.insert(rng.randrange(len(inner)), rng.choice(["inserted", rng.choice(words)]))
        for _ in range(rng.randint(0, 1)):
            inner.pop(rng.randrange(len(inner)))
        texts.append(" ".join([*rng.choices(words, k=rng.randint(0, 12)), *inner, *rng.choices(words, k=5)]))
    few, got = ({r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).collect()} for t in (texts[:2], texts))
    assert [(x[i].labels, x[i].score) for x in (few, got) for i in (0, 1)] == [("mit-text", 0.9)] * 4
    found = [plain_scan(text) for text in texts]
    assert sum(0.8 <= score < 1 for _, score in found) > 8
    for i, (text, (labels, score)) in enumerate(zip(texts, found, strict=True)):
        assert (got[i].labels, got[i].score) == (labels, pytest.approx(score)), text


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
@pytest.mark.parametrize(("score", "label", "parts", "held", "least"), [(quality.score_quality, "quality", 5, 0, 0.95), (toxicity.score_toxicity, "toxic", 4, 2, 0.9)])
def test_held_out_accuracy(spark, score, label, parts, held, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r[label] for r in labels.collect()}
    got = [r for r in score(docs, labels).collect() if r.doc_id in truth]
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held)
    own = [r for r in got if r.held_out]
    right = sum(r.predicted == truth[r.doc_id] for r in own) / len(own)
    assert len(own) > 30 and right >= least, right


def plain_tree_scores(trees, row):
    """One row through every tree, node by node."""
    total = trees.start
    for root in trees.roots:
        at = root
        while trees.feature[at] >= 0:
            at = trees.left[at] + int(row[trees.feature[at]] > trees.threshold[at])
        total += trees.value[at]
    return 1 / (1 + math.exp(-total))


def plain_first_split(rows, labels, cuts):
    """The best gain of one split over all features and cuts, by trying each."""
    p = (sum(labels) + 1) / (len(labels) + 2)
    grad, hess = [y - p for y in labels], p * (1 - p)
    score = lambda own: sum(grad[i] for i in own) ** 2 / (hess * len(own) + quality.RIDGE)
    best = (0.0, None, None)
    for f in range(len(rows[0])):
        for cut in cuts[f]:
            left, right = [i for i, r in enumerate(rows) if r[f] <= cut], [i for i, r in enumerate(rows) if r[f] > cut]
            if min(len(left), len(right)) >= quality.LEAST_ROWS:
                best = max(best, (score(left) + score(right) - score(range(len(rows))), -f, -cut))
    return -best[1], -best[2]


def test_trees_split_best_and_are_walked_right():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(300, 5)).round(2)
    labels = ((rows[:, 2] > 0.3) ^ (rng.random(300) < 0.1)).astype(float)
    trees = quality.grow(rows, labels)
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for f in range(5)]
    root = trees.roots[0]
    assert (trees.feature[root], trees.threshold[root]) == plain_first_split(rows.tolist(), labels.tolist(), cuts)
    own = trees.left[root]
    sides = [labels[rows[:, 2] <= trees.threshold[root]], labels[rows[:, 2] > trees.threshold[root]]]
    assert len(trees.roots) == quality.TREES and own == root + 1 and abs(sides[0].mean() - sides[1].mean()) > 0.5
    assert trees.score(rows) == pytest.approx([plain_tree_scores(trees, r) for r in rows])
    loss = lambda p: -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))
    assert loss(trees.score(rows)) < 0.6 * loss(np.full(300, labels.mean()))


def plain_statistics(text):
    """Some of the statistics, counted sign by sign."""
    raw = text.encode()
    words = raw.split()
    share = lambda test: sum(test(b) for b in raw) / len(raw)
    counts = Counter(raw)
    return {
        "mean_word": sum(map(len, words)) / len(words), "top_word": max(Counter(words).values()) / len(words), "distinct_pairs": len({*zip(words, words[1:])}) / max(1, len(words) - 1),
        "same_as_last": sum(a == b for a, b in zip(words, words[1:])) / len(words), "upper": share(lambda b: 65 <= b < 91), "digits": share(lambda b: 48 <= b < 58), "blank": share(lambda b: b in b" \t\n\r"),
        "beyond_ascii": share(lambda b: b > 127), "entropy": -sum(n / len(raw) * math.log2(n / len(raw)) for n in counts.values()), "mark_42": counts[42] / len(raw),
    }


def test_statistics_match_plain_counts():
    for text in ("One two two three.", "É% *** ** 12 a a a\nb B", "x"):
        got = dict(zip(quality.NAMES, quality.statistics(text), strict=True))
        for name, value in plain_statistics(text).items():
            assert got[name] == pytest.approx(value), (name, text)


def test_noisy_or_against_plain_sums_and_its_gradient_against_differences():
    rng = random.Random(11)
    docs = [(rng.randint(0, 1), rng.random() + 0.1, n := rng.randint(1, 6), [(rng.randrange(n), f, rng.randint(1, 3)) for f in rng.sample(range(5), rng.randint(0, 4))]) for _ in range(40)]
    bags, w = toxicity.Bags(docs, 5), np.array([rng.uniform(-2, 2) for _ in range(6)])

    def plain(w):
        total = 0.0
        for toxic, weight, n, hits in docs:
            none = math.prod(1 / (1 + math.exp(w[-1] + sum(w[f] * k for s, f, k in hits if s == i))) for i in range(n))
            total += weight * math.log(1 - none if toxic else none)
        return total / sum(d[1] for d in docs)

    value, gradient = bags.gradient(w)
    assert value == pytest.approx(plain(w))
    for i in range(6):
        step = np.eye(6)[i] * 1e-5
        assert gradient[i] == pytest.approx((plain(w + step) - plain(w - step)) / 2e-5, rel=1e-4, abs=1e-8)


def test_documents_score_as_their_sentences_say():
    model = toxicity.Model({"=scum": 4.0, "vil": 2.0, "=you": -1.0}, -3.0)
    text = "You scum! Vile, vile things.\nNothing here? And villains, you"
    each = [1 / (1 + math.exp(-(-3.0 + z))) for z in (3.0, 4.0, 0.0, 1.0)]
    score, offending = model.score(text)
    assert score == pytest.approx(1 - math.prod(1 - p for p in each))
    assert offending == [(i, pytest.approx(p)) for i, p in enumerate(each) if p > 0.3]


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
def test_likeness_of_real_documents_matches_a_plain_count(spark):
    """op4's columns from their own fingerprints, on every document, those of over 256 anchors too."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(syncmers.fingerprint_edits(docs).collect(), key=lambda r: -r.doc_id)

    def links(fingerprint):
        anchors, place = [], 0
        for i in range(0, len(fingerprint), 9):
            place += int(fingerprint[i + 8], 16)
            anchors.append((fingerprint[i : i + 8], place))
        return Counter((h, *((n[0], n[1] - p) if n else ())) for (h, p), n in zip(anchors, [*anchors[1:], None], strict=False))

    own = [links(r.fingerprint) for r in got]
    assert sum(x.total() > 256 for x in own) > 50
    for i, r in enumerate(got):
        for near, other in ((r.near_edited, links(r.edited_fingerprint)), (r.near_next, own[(i + 1) % len(own)])):
            union = (own[i] | other).total()
            assert near == pytest.approx((own[i] & other).total() / union if union else 1.0), r.doc_id
