"""The whole pipeline against plain versions of its stages, one after the other."""

import hashlib
import os
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers

from tests.llm.cases import none
from tests.llm.test_dedup import near_rows, plain_components, plain_exact
from tests.llm.test_plain_versions import plain_rake
from utterlake.llm import mixing, quality


def plain_mix(rows):
    """rows: {doc_id: (text, lang, source)} -> {doc_id: how often it is kept}."""
    cells, own = {}, {}
    for d, (text, lang, source) in rows.items():
        n = len(re.findall(r"[^\t\n\x0B\f\r ]+", text or ""))
        notice = "icense" in (text or "") or "ights reserved" in (text or "")
        topic = "table" if " | " in (text or "") else "notice" if notice else "short" if n < 100 else "article" if n < 1000 else "long"
        own[d] = (source or "", lang or "", topic)
        cells[own[d]] = cells.get(own[d], 0) + n
    weights = plain_rake(cells)
    kept = {}
    for d, cell in own.items():
        rate = weights[cell] / cells[cell] if cells[cell] else 1.0
        times = mixing.KEEP * rate
        kept[d] = int(times) + (int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:8], 16) / 2**32 < times - int(times))
    return {d: n for d, n in kept.items() if n}


def test_pipeline_matches_plain_stages(spark, tmp_path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    rng = random.Random(9)
    texts = [t for _, t in near_rows(150)]
    texts += [t.upper() for t in rng.sample(texts, 20)] + ["*** %% " * rng.randint(20, 60) for _ in range(40)] + ["", None, "a | b | c", "All rights reserved, see the license."]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    at = f"file://{tmp_path}"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{at}/documents.parquet")
    labels = spark.createDataFrame([(i, int(not (t or "").startswith("***")), 0) for i, t, *_ in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{at}/labels.parquet")

    good = {r.doc_id for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    left = {d: t for d, t, *_ in rows if d in good}
    assert len(rows) - 60 < len(left) <= len(rows) - 40  # the junk goes
    left = {max(ids): left[max(ids)] for ids in plain_exact(left.items()).values()}
    left = {d: left[d] for d, _, component in plain_components(list(left.items())) if d == component}
    kept = plain_mix({d: (t, lang, source) for d, t, lang, source, _ in rows if d in left})
    assert 10 < len(kept) < len(left) < len(good) and max(kept.values()) > 1  # some documents come several times
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = Counter({(d, hashlib.sha256(np.array(library.encode(left[d] or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()): n for d, n in kept.items()})
    assert Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, at).collect()) == want


def test_stages_and_run_take_empty_tables(spark, tmp_path):
    at = f"file://{tmp_path}"
    none(spark).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    assert corpus_pipeline.run(spark, at).collect() == []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, none(spark), at)
        assert got.collect() == [] and got.columns == none(spark).columns
