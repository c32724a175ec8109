"""Operators on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables; plain versions beside them."""

import hashlib
import math
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.llm.cases import ODD, SCHEMA, none, odd
from utterlake.llm import licences, mixing, quality, simhash, syncmers, toxicity

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, None, None), (7, 1, 0), (10, 1, 1)], LABELS)


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_classifiers(spark, labels, score):
    got = score(odd(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert score(none(spark), labels).collect() == []
    assert len(score(odd(spark), spark.createDataFrame([], LABELS)).collect()) == len(ODD)


def test_toxic_sentences_are_located():
    model = toxicity.Model({"=scum": 9.0}, -6.0)
    assert [i for i, _ in model.score("Fine here. You scum! Fine.")[1]] == [1] and model.score("")[0] == 0


def test_syncmers(spark):
    rows = sorted((r for r in ODD if r[0] is not None), key=lambda r: -r[0])
    got = sorted((r for r in syncmers.fingerprint_edits(odd(spark)).collect() if r.doc_id is not None), key=lambda r: -r.doc_id)
    assert len(got) == len(rows)
    for i, (r, own) in enumerate(zip(got, rows, strict=True)):
        text = own[1] or ""
        if i + 1 < len(rows):  # a null id follows the last
            half = len(text) // 2
            edited = text[: len(text) - half] + (rows[i + 1][1] or "")[:half]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    same = {r.fingerprint for r in got if r.doc_id in (1, 2, 10)}
    assert len(same) == 1 and len(same.pop()) > 0
    assert syncmers.fingerprint_edits(none(spark)).collect() == []


def test_licences_match_a_plain_search(spark):
    got = {r.doc_id: r for r in licences.scan_licences(odd(spark)).collect()}
    for doc_id, text, *_ in ODD:
        words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        starts = [i for p in licences.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = got[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(starts), min(starts, default=None), max(starts, default=None))
    assert got[7].base_labels == "cc-by,gpl,reserved" and got[3].labels == ""
    assert licences.scan_licences(none(spark)).collect() == []


def test_mixing(spark):
    got = mixing.mix(odd(spark)).collect()
    assert len(got) == len(ODD) and all(r.copies in (math.floor(r.expected), math.floor(r.expected) + 1) and r.selected == (r.copies > 0) for r in got)
    assert abs(sum(r.weight for r in got) - sum(r.n_tokens for r in got)) < 1
    assert mixing.mix(none(spark)).collect() == []


def test_pipeline_keeps_the_columns(spark, labels, tmp_path):
    docs = spark.createDataFrame(ODD, SCHEMA)
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, f"file://{tmp_path}")
        assert i == 4 or out.columns == docs.columns
        path = f"file://{tmp_path}/{i}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.columns[:2] == ["doc_id", "n_tokens"]


def test_filtering_stages_judge_each_row_by_itself(spark, labels):
    """Rows that share an id, or have none, do not drop each other; columns named as an operator's own come through."""
    rows = [(None, f"{w} stands here alone with words of its own kind, {w}{w} {w}s", "en", "a", 1) for w in ("apple", "river", "stone", "cloud")]
    rows += [(5, "quite another matter of seven plain words here", "en", "b", 1), (5, "and one that shares only the id of the former text", "en", "b", 1)]
    rows += [(7, rows[0][1], "en", "a", 1), (8, rows[0][1], "en", "a", 1), (8, rows[0][1], "en", "a", 1)]
    named = ["_tokens", "_source", "_lang", "_topic", "_cell", "probability", "row", "rate", "first", "root", "stats", "_row"]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce("text", F.lit(""))) for c in named})
    as_given = {tuple(r) for r in docs.collect()}
    near = simhash.drop_near_copies(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in near) == sorted([(7, rows[0][1]), *((0, r[1]) for r in rows[1:4]), *((5, r[1]) for r in rows[4:6])])
    good, mixed = quality.keep_good(docs, labels).collect(), mixing.sample_mix(docs).collect()
    assert len(good) == len(rows) and mixed
    assert all(tuple(r) in as_given and r.asDict().keys() == set(docs.columns) for r in [*near, *good, *mixed])


def test_quality_rejects_row_by_row(spark):
    rows = [(i, "%% ** " * (20 + i % 7) if i % 3 == 0 else f"a plain line of text, number {i}, as people write them.", "en", "a", 1) for i in range(150)]
    rows += [(None, "%% ** " * 25, "en", "a", 1), (None, "a plain line of text, number 7, as people write them.", "en", "a", 1)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(150)], LABELS)
    kept = quality.keep_good(docs, marks).collect()
    assert sorted(r.text for r in kept) == sorted(r[1] for r in rows if not r[1].startswith("%%"))
    assert sorted(r.doc_id for r in quality.score_quality(docs, marks).where("predicted = 1 AND doc_id IS NOT NULL").collect()) == sorted(r.doc_id for r in kept if r.doc_id is not None)
