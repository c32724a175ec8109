"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text becomes a short vector of statistics in one pass. The trees are grown on the driver from the vectors of a
bounded sample of labelled rows, flattened into arrays, and applied to all vectors by numpy, one tree level at a time.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.runtime import materialize, table

#: At most about this many labelled rows are fitted on, picked by a hash of doc_id; all others are scored all the same.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 60, 4, 64, 0.15, 20, 1.0
THRESHOLD = 0.3
_MARKS = "*&%$#@!|?,.;:'\"()-=/"
NAMES = (
    "log_chars", "log_words", "mean_word", "longest_word", "distinct_words", "top_word", "same_as_last", "distinct_pairs", "distinct_lines", "words_a_line",
    "upper", "digits", "blank", "beyond_ascii", "marks", "deflated", "entropy", "sentence_words", *(f"mark_{ord(m)}" for m in _MARKS),
)


def statistics(text: str | None) -> list[float]:
    """The vector of a whole text; all zero for an empty one."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n, lines = len(words), [x for x in raw.split(b"\n") if x.strip()]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / len(raw)
    there = share[share > 0]
    sizes = list(map(len, words))
    marks = [float(share[ord(m)]) for m in _MARKS]
    return [
        float(np.log1p(len(raw))), float(np.log1p(n)), sum(sizes) / n, float(np.log1p(max(sizes))), len(set(words)) / n, Counter(words).most_common(1)[0][1] / n,
        sum(map(eq, words, words[1:])) / n, len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        float(share[65:91].sum()), float(share[48:58].sum()), float(share[[9, 10, 13, 32]].sum()), float(share[128:].sum()), sum(marks),
        len(zlib.compress(raw, 1)) / len(raw), float(-(there * np.log2(there)).sum()), float(np.log1p(n / (1 + counts[46] + counts[33] + counts[63]))), *marks,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([statistics(x.as_py()) for x in b.column("text")], pa.list_(pa.float32()))], names=["doc_id", "stats"])


@dataclass
class Trees:
    """All trees in flat arrays of nodes: a leaf's feature is -1, the right child stands behind the left one."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    start: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        total = np.full(len(rows), self.start)
        at_row = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(DEPTH):
                f = self.feature[node]
                step = self.left[node] + (rows[at_row, np.maximum(f, 0)] > self.threshold[node])
                node = np.where(f >= 0, step, node)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def grow(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Boosted trees for the logistic loss on histograms of BINS quantile bins. One label only, or none: a constant score."""
    mean = (labels.sum() + 1.0) / (len(labels) + 2.0)
    start = float(np.log(mean / (1 - mean)))
    feature, threshold, left, value, roots = [], [], [], [], []
    n, width = rows.shape
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
    bins = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if n else np.zeros((0, width), int)
    flat = bins + np.arange(width) * BINS
    total = np.full(n, start)

    def node() -> int:
        feature.append(-1)
        threshold.append(0.0)
        left.append(-1)
        value.append(0.0)
        return len(feature) - 1

    for _ in range(TREES if 0 < labels.sum() < len(labels) else 0):
        p = 1 / (1 + np.exp(-total))
        grad, hess = labels - p, p * (1 - p)
        roots.append(node())
        open_nodes = [(roots[-1], np.arange(n), 0)]
        while open_nodes:
            at, own, depth = open_nodes.pop()
            g, h = grad[own].sum(), hess[own].sum()
            best = (1e-3, None, None)
            if depth < DEPTH and len(own) >= 2 * LEAST_ROWS:
                keys = flat[own].ravel()
                sums = [np.bincount(keys, np.repeat(w, width), BINS * width).reshape(width, BINS).cumsum(1) for w in (grad[own], hess[own], np.ones(len(own)))]
                gl, hl, nl = sums
                gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
                gain[(nl < LEAST_ROWS) | (len(own) - nl < LEAST_ROWS)] = -1
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] > best[0] and b < len(cuts[f]):
                    best = (gain[f, b], f, b)
            if best[1] is None:
                value[at] = RATE * float(g / (h + RIDGE))
                total[own] += value[at]
                continue
            _, f, b = best
            goes = bins[own, f] > b
            feature[at], threshold[at], left[at] = int(f), float(cuts[f][b]), node()
            node()
            open_nodes += [(left[at], own[~goes], depth + 1), (left[at] + 1, own[goes], depth + 1)]
    return Trees(np.array(roots, int), np.array(feature, int), np.array(threshold), np.array(left, int), np.array(value), start)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts))


def bounded(labelled: DataFrame, rows: int) -> DataFrame:
    """About that many rows at most, picked by a hash of doc_id; all where there are fewer."""
    share = min(1.0, rows / max(labelled.count(), 1))
    return labelled if share == 1 else labelled.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * rows)


def _fitted(stats: DataFrame) -> Trees:
    """Trees from the rows of stats(stats, quality), in whatever order they come."""
    sample = stats.select("stats", "quality").limit(2 * TRAIN_ROWS).toArrow()
    x = np.array(sample["stats"].to_pylist(), np.float64).reshape(-1, len(NAMES))
    order = np.lexsort(x.T) if len(x) else np.zeros(0, int)
    return grow(x[order], sample["quality"].to_numpy().astype(np.float64)[order])


def _marked(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the labelled rows to learn from: about TRAIN_ROWS, never more than twice as many."""
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(fold(F.col("doc_id"), 5) != 0)
    return bounded(marked.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")), TRAIN_ROWS)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    score is the probability that the text's quality label is 1. Only rows whose crc32(doc_id as text) mod 5 is not 0 are
    learned from; the score depends on the text alone. Null and empty texts have statistics of zero and a score like any
    other; null labels are left out; with no labels, or one value of them, all scores are equal. Repeated rows each give a
    row, null ids stay null, other columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    stats = materialize(rows.mapInArrow(_statistics, "doc_id long, stats array<float>"), "statistics")
    trees = _fitted(stats.join(_marked(labels), "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = trees.score(np.array(b.column("stats").to_pylist(), np.float64).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got)], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns; each row's own text decides.

    The labelled rows' statistics come first, then one pass over docs scores and filters: no text is shuffled.
    """
    labelled = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(_marked(labels)), "doc_id")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([statistics(x.as_py()) for x in b.column("text")], pa.list_(pa.float32())), b.column("quality")], names=["stats", "quality"])

    trees = _fitted(labelled.select("text", "quality").mapInArrow(described, "stats array<float>, quality int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = np.array([statistics(x.as_py()) for x in b.column("text")], np.float32).astype(np.float64)
                yield b.filter(pa.array(trees.score(own) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op2_quality": lambda spark, sf_dir: score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))}
ORACLES: dict = {}
