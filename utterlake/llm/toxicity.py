"""Toxicity by multiple-instance learning.

A document is a bag of sentences: it is toxic with probability 1 - prod(1 - p_s), a noisy-or of its sentences' scores. A
sentence's score is a logistic function of its words and their beginnings; the weights are trained from document labels
alone through the noisy-or, and the sentences that carry a document's score are the offending ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.llm.quality import bounded, fold
from utterlake.runtime import materialize, table

#: At most about this many labelled rows of each class are fitted on, and fewer where they hold more hits of features than
#: TRAIN_HITS; the features are the strongest of all that they hold.
TRAIN_TOXIC, TRAIN_OTHER, TRAIN_HITS, FEATURES, LEAST_DOCS = 6_000, 6_000, 8_000_000, 3_000, 5
STEPS, STEP, RIDGE = 300, 0.05, 2e-3
THRESHOLD, KEPT = 0.3, 300_000
_SENTENCE, _WORD = re.compile(r"[.!?\n]+"), re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s.strip()]


class Kept(dict):
    """What of(word) gives, kept for words seen; trim() forgets all where they are too many."""

    def __init__(self, of: Callable[[str], object]):
        self.of = of

    def __missing__(self, word: str) -> object:
        got = self[word] = self.of(word)
        return got

    def trim(self) -> None:
        if len(self) > KEPT:
            self.clear()


def features(word: str) -> list[str]:
    """A word in lower case and its beginnings of 3 to 9 letters."""
    return ["=" + word, *(word[:k] for k in range(3, min(9, len(word)) + 1))]


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, Counter] = {0: Counter(), 1: Counter()}
    kept = Kept(features)
    for b in batches:
        for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
            words = set(_WORD.findall((text.as_py() or "").lower()))
            found[toxic].update({""}.union(*map(kept.__getitem__, words)))
            kept.trim()
    for toxic, counts in found.items():
        items = list(counts.items())
        for at in range(0, len(items), 1 << 15):
            part = items[at : at + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.string()), pa.array([toxic] * len(part), pa.int32()), pa.array([n for _, n in part], pa.int64())], names=["feature", "toxic", "n"])


def choose_features(sample: DataFrame) -> list[str]:
    """The features whose share of toxic documents exceeds that of the others by most (signed likelihood ratio)."""
    counts = sample.mapInArrow(_feature_counts, "feature string, toxic int, n long")
    both = counts.groupBy("feature").agg(F.sum(F.col("n") * F.col("toxic")).alias("a"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c")).where(F.col("a") >= LEAST_DOCS)
    total = {0: 0, 1: 0} | {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not all(total.values()):
        return []
    pa_, pc_ = F.col("a") / total[1], F.col("c") / total[0]
    mean = (F.col("a") + F.col("c")) / (total[0] + total[1])
    gain = F.col("a") * F.log(pa_ / mean) + F.when(F.col("c") > 0, F.col("c") * F.log(pc_ / mean)).otherwise(0.0)
    chosen = both.where((F.col("feature") != "") & (pa_ > 2 * pc_)).orderBy(gain.desc(), "feature").limit(FEATURES)
    return sorted(r.feature for r in chosen.select("feature").collect())


class Model:
    """Weights of the chosen features, and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words = Kept(lambda word: sum(weights.get(f, 0.0) for f in features(word)))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        """The document's score, and (number, score) of its offending sentences."""
        total, offending, word = 0.0, [], self.words.__getitem__
        for i, sentence in enumerate(sentences((text or "").lower())):
            z = self.bias + sum(map(word, _WORD.findall(sentence)))
            total += max(z, 0.0) + log1p(exp(-abs(z))) if z > -30 else 0.0
            if z > -0.85:  # a score of 0.3
                offending.append((i, 1 / (1 + exp(-z))))
        self.words.trim()
        return 1 - exp(-total), offending


class Bags:
    """Documents as bags of sentences in flat arrays: (toxic, weight, sentences, rows of (sentence, feature number, times))."""

    def __init__(self, docs: list[tuple[int, float, int, np.ndarray | list]], width: int):
        self.width, self.size = width, len(docs)
        self.toxic = np.array([d[0] for d in docs], float)
        weight = np.array([d[1] for d in docs], float)
        self.weight = weight / max(weight.sum(), 1e-9)
        self.bare = np.array([d[2] for d in docs], float)  # sentences without any feature
        doc_of, sent_of, flat, at = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros((0, 3), np.int32)], 0
        for i, (_, _, _, hits) in enumerate(docs):
            flat.append(np.asarray(hits, np.int32).reshape(-1, 3))
            names, own = np.unique(flat[-1][:, 0], return_inverse=True)
            doc_of.append(np.full(len(names), i))
            sent_of.append(own + at)
            at += len(names)
            self.bare[i] -= len(names)
        hits = np.concatenate(flat)
        self.doc_of, self.sent_of, self.feat_of, self.times = np.concatenate(doc_of), np.concatenate(sent_of), hits[:, 1], hits[:, 2].astype(float)

    def gradient(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """The weighted log-likelihood of the labels under the noisy-or, and its gradient. The bias is w's last value."""
        z = w[-1] + np.bincount(self.sent_of, w[self.feat_of] * self.times, len(self.doc_of)) if len(self.doc_of) else np.zeros(0)
        p, base = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-w[-1]))
        s = self.bare * np.logaddexp(0, w[-1]) + np.bincount(self.doc_of, np.logaddexp(0, z), self.size)  # -log of not toxic
        some = np.maximum(-np.expm1(-s), 1e-12)
        value = float((self.weight * np.where(self.toxic > 0, np.log(some), -s)).sum())
        pull = self.weight * np.where(self.toxic > 0, 1 / np.maximum(np.expm1(np.minimum(s, 500.0)), 1e-6), -1.0)
        by_sentence = pull[self.doc_of] * p
        return value, np.append(np.bincount(self.feat_of, by_sentence[self.sent_of] * self.times, self.width), by_sentence.sum() + (pull * self.bare).sum() * base)


def fit(docs: list[tuple[int, float, int, np.ndarray | list]], chosen: list[str]) -> Model:
    """Adam on the noisy-or likelihood of Bags, with a ridge on the weights."""
    bags = Bags(docs, len(chosen))
    w = np.zeros(len(chosen) + 1)  # the bias is last
    w[-1] = -6.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        _, grad = bags.gradient(w)
        grad[:-1] -= RIDGE * w[:-1] / max(1, len(chosen)) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w += STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    return Model({f: float(x) for f, x in zip(chosen, w[:-1], strict=True) if abs(x) > 1e-3}, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold(F.col("doc_id"), 4) != 2).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    marked = materialize(marked.where("toxic IN (0, 1)"), "labels")
    sizes = {0: 0, 1: 0} | {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not all(sizes.values()):
        share = (sizes[1] + 1e-3) / (sizes[0] + sizes[1] + 1.0)
        return Model({}, float(np.log(share / (1 - share))))
    picked = bounded(marked.where("toxic = 1"), TRAIN_TOXIC).union(bounded(marked.where("toxic = 0"), TRAIN_OTHER))
    tasks = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")  # ids: 4 * TRAIN rows at most
    sample = materialize(found.repartition(tasks), "labelled")
    chosen = choose_features(sample)
    number = {f: i for i, f in enumerate(chosen)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Kept(lambda word: tuple(number[f] for f in features(word) if f in number))
        for b in batches:
            counts, hits = [], []
            for text in b.column("text"):
                own = sentences((text.as_py() or "").lower())
                counts.append(len(own))
                summed = Counter((i, f) for i, s in enumerate(own) for fs in map(numbers.__getitem__, _WORD.findall(s)) for f in fs)
                hits.append([x for (i, f), n in summed.items() for x in (i, f, n)])
                numbers.trim()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(counts, pa.int32()), pa.array(hits, pa.list_(pa.int32()))], names=["doc_id", "toxic", "sentences", "hits"])

    found = materialize(sample.mapInArrow(bags, "doc_id long, toxic int, sentences int, hits array<int>"), "bags")
    total = found.agg(F.sum(F.size("hits"))).first()[0] or 0
    share = min(1.0, 3 * TRAIN_HITS / max(total, 1))
    if share < 1:
        found = found.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(23)), F.lit(1 << 20)) < int(share * (1 << 20)))
    got = found.limit(4 * (TRAIN_TOXIC + TRAIN_OTHER)).toArrow().combine_chunks()
    lists = pa.concat_arrays(got["hits"].chunks) if got.num_rows else pa.array([], pa.list_(pa.int32()))
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    rows = [(*r, flat[a:b].reshape(-1, 3)) for *r, a, b in zip(*(got[c].to_pylist() for c in ("doc_id", "toxic", "sentences")), ends[:-1], ends[1:], strict=True)]
    rows.sort(key=lambda r: (*r[:3], r[3].tobytes()))
    drawn = Counter(r[1] for r in rows)
    return fit([(toxic, sizes[toxic] / drawn[toxic], n, hits) for _, toxic, n, hits in rows], chosen)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, and the numbers of the offending sentences.

    score is the probability that the text's toxic label is 1. Only rows whose crc32(doc_id as text) mod 4 is not 2 are
    learned from; the score depends on the text alone. Null and empty texts have no sentences and score 0; with one value
    of the label, or none, the weights are empty. Repeated rows each give a row, null ids stay null, other columns are
    ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = train(rows, labels)
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, bias)
        for b in batches:
            got = [own.score(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0] for g in got], pa.float64()), pa.array([[i for i, _ in g[1]] for g in got], pa.list_(pa.int32()))], names=["doc_id", "score", "offending"])

    scored = rows.mapInArrow(run, "doc_id long, score double, offending array<int>")
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")


QUERIES = {"op8_toxicity": lambda spark, sf_dir: score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))}
ORACLES: dict = {}
