"""SimHash near-dedup with the generalised pigeonhole principle.

Every distinct 64-bit fingerprint is cut into m groups of correlated bits. With thresholds t_i that sum to radius - m + 1,
two fingerprints within the radius agree up to t_i bits in some group i (t_i = -1 skips a group). Each fingerprint chooses
its own thresholds by dynamic programming over (probes + candidates), the candidates estimated from histograms of all
fingerprints; it probes the index within t_i in each group, and every candidate is verified. m is the number out of PARTS
of least estimated cost: few, wide groups where fingerprints are many, as a group's candidates grow with their number.

Fingerprints are distinct before the search, so copies of one text, however many, are one index entry, and links between
them cost nothing. No bucket is capped: a key that many fingerprints share is one join key, which AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.llm.components import components
from utterlake.llm.frames import free_name, row_key
from utterlake.runtime import materialize, table

SHINGLE_WORDS, SEED, RADIUS, PARTS = 4, 42, 4, (2, 3, 4)
#: Fingerprints that the cost of a number of groups is estimated on; the links found are the same for any number.
COST_ROWS = 2048
CANDIDATE_COST = 0.5  # of verifying one candidate, in probes: a probe is shuffled and sorted, a candidate is one comparison
_BLOCK = 8  # bits of a histogram


def fingerprint(text: str | None) -> int:
    """Bit i is set where it is set in over half the hashes of the text's word shingles; 0 for no words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only are lowered, and the separators are 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < SHINGLE_WORDS:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    counts, n = np.zeros(64, np.int64), len(words) - SHINGLE_WORDS + 1
    for at in range(0, n, 1 << 16):  # in blocks: memory stays bounded for very long texts
        to = min(n, at + (1 << 16))
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:to].tolist(), ends[at + SHINGLE_WORDS - 1 : to + SHINGLE_WORDS - 1].tolist(), strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(x.as_py()) for x in b.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """(doc_id, fp) for every row, and further string columns as they are."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keys)
    return rows.mapInArrow(_fingerprints, ", ".join(["doc_id long, fp long", *(f"{k} string" for k in keys)]))


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _summed(df: DataFrame, counts_of, size: int) -> np.ndarray:
    """The sum over all rows of counts_of(fingerprints), an array of fixed size: one row a task, added up in the cluster."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            if b.num_rows:
                total += counts_of(b.column("fp").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "n"])

    out = np.zeros(size, np.int64)
    for i, n in df.select("fp").mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n")).collect():
        out[i] = n
    return out


def _together(fps: np.ndarray) -> np.ndarray:
    bits = _bits(fps).astype(np.float64)
    return (bits.T @ bits).astype(np.int64).ravel()


def bit_groups(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Groups of about equal size: each grows by the free bit most correlated with it."""
    if not n:
        return [list(range(i, 64, parts)) for i in range(parts)]
    mean = together.diagonal() / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    related = np.abs((together / n - np.outer(mean, mean)) / np.outer(spread, spread))
    free, groups = set(range(64)), []
    for part in range(parts):
        size = len(free) // (parts - part)
        group = [min(free, key=lambda b: (-sum(related[b, o] for o in free if o != b), b))]
        free.discard(group[0])
        while len(group) < size:
            group.append(min(free, key=lambda b: (-related[b, group].sum(), b)))
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def _blocks(group: list[int]) -> list[list[int]]:
    return [group[i : i + _BLOCK] for i in range(0, len(group), _BLOCK)]


def _values(fps: np.ndarray, block: list[int]) -> np.ndarray:
    """The block's bits as a small number."""
    out = np.zeros(len(fps), np.int64)
    for k, bit in enumerate(block):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return out


def _within(groups: list[list[int]], histogram: list[np.ndarray], n: int, radius: int) -> list[list[np.ndarray]]:
    """For each group and block: the share of fingerprints at distance 0..radius from each value of the block."""
    distance = np.bitwise_count(np.arange(1 << _BLOCK)[:, None] ^ np.arange(1 << _BLOCK)[None, :])
    out, at = [], 0
    for group in groups:
        out.append([])
        for _ in _blocks(group):
            share = histogram[at] / max(n, 1)
            out[-1].append(np.stack([(distance == d) @ share for d in range(radius + 1)], axis=1))
            at += 1
    return out


def thresholds(fps: np.ndarray, groups: list[list[int]], within: list[list[np.ndarray]], n: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(len(fps), len(groups)) thresholds from -1 up that sum to radius - len(groups) + 1 at the least estimated cost, and that cost."""
    rows, wanted = len(fps), radius + 1  # in steps of t + 1
    best = np.full((rows, wanted + 1), np.inf)
    best[:, 0] = 0
    choices = []
    for group, blocks in zip(groups, within, strict=True):
        near = np.zeros((rows, radius + 1))
        near[:, 0] = 1
        for block, table_ in zip(_blocks(group), blocks, strict=True):
            own, spread = table_[_values(fps, block)], np.zeros_like(near)
            for a in range(radius + 1):
                for b in range(radius + 1 - a):
                    spread[:, a + b] += near[:, a] * own[:, b]
            near = spread
        cost = [np.zeros(rows)]
        probes = 0
        for t in range(radius + 1):
            probes += len(list(combinations(range(len(group)), t)))
            cost.append(probes + CANDIDATE_COST * n * near[:, : t + 1].sum(1))
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int64)
        for step in range(wanted + 1):
            for have in range(wanted + 1 - step):
                total = best[:, have] + cost[step]
                better = total < new[:, have + step]
                new[better, have + step] = total[better]
                pick[better, have + step] = step
        best = new
        choices.append(pick)
    left, out = np.full(rows, wanted), np.zeros((rows, len(groups)), np.int64)
    for i in reversed(range(len(groups))):
        step = choices[i][np.arange(rows), left]
        out[:, i] = step - 1
        left -= step
    return out, best[:, wanted]


def _prober(groups: list[list[int]], within: list[list[np.ndarray]], n: int, radius: int):
    masks = [np.uint64(sum(1 << b for b in g)) for g in groups]
    flips = [[np.array([sum(1 << b for b in c) for c in combinations(g, d)], np.uint64) for d in range(radius + 1)] for g in groups]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            chosen, _ = thresholds(fps, groups, within, n, radius)
            for i in range(len(groups)):
                for d in range(radius + 1):
                    reached = fps[chosen[:, i] >= d]
                    block = max(1, (1 << 18) // len(flips[i][d]))  # a block's probes fit into memory whatever the thresholds
                    for at in range(0, len(reached), block):
                        own = reached[at : at + block]
                        keys = ((own & masks[i])[:, None] ^ flips[i][d][None, :]).ravel()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(keys), i, np.int8)), pa.array(keys.view(np.int64)), pa.array(np.repeat(own, len(flips[i][d])).view(np.int64))], names=["part", "key", "q"]
                        )

    return probe, [int(m.view(np.int64)) for m in masks]


def _plan(nodes: DataFrame, n: int, radius: int) -> tuple[list[list[int]], list[list[np.ndarray]]]:
    """The groups of least estimated cost out of PARTS, and the shares of all fingerprints near each value of their blocks."""
    together = _summed(nodes, _together, 64 * 64).reshape(64, 64)
    plans = [bit_groups(together, n, parts) for parts in PARTS if parts <= radius + 1] or [[list(range(64))]]
    blocks = [b for groups in plans for g in groups for b in _blocks(g)]
    counts = _summed(nodes, lambda fps: np.concatenate([np.bincount(_values(fps.view(np.uint64), b), minlength=1 << _BLOCK) for b in blocks]), len(blocks) << _BLOCK)
    histograms = iter(counts.reshape(len(blocks), -1))
    within = [_within(groups, [next(histograms) for g in groups for _ in _blocks(g)], n, radius) for groups in plans]
    some = np.array([r.fp for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(COST_ROWS).collect()], np.int64).view(np.uint64)
    costs = [thresholds(some, groups, own, n, radius)[1].mean() if len(some) else 0 for groups, own in zip(plans, within, strict=True)]
    best = int(np.argmin(costs))
    return plans[best], within[best]


def near_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) for every two fingerprints of nodes(fp), distinct, that differ in 1 to radius bits; a < b, each pair once."""
    n = nodes.count()
    probe, masks = _prober(*_plan(nodes, n, radius), n, radius)
    probes = nodes.select("fp").mapInArrow(probe, "part byte, key long, q long")
    index = nodes.select(F.explode(F.array(*(F.struct(F.lit(i).cast("byte").alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"), "fp") for i, m in enumerate(masks)))).alias("e")).select("e.*")
    found = probes.join(index, ["part", "key"]).where((F.col("q") < F.col("fp")) & (F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius))
    return found.select(F.col("q").alias("a"), F.col("fp").alias("b")).distinct()


def _grouped(signed: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) for each fingerprint of signed(doc_id, fp); root is the component's least fingerprint.

    The least ids are summed up before the shuffle and written, so what follows is a plain join, which AQE splits where one
    component holds most fingerprints.
    """
    nodes = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    linked = components(near_pairs(nodes, radius)).withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = materialize(nodes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return materialize(rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "components")


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id linked to it through any chain.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows each give a row. A null doc_id
    never names a component unless all of it is null. Other columns are ignored; an empty table gives an empty result.
    """
    signed = materialize(fingerprints(docs), "fingerprints")
    return signed.join(_grouped(signed, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of docs of each component, with all its columns: that of the smallest doc_id, a null one last.

    Rows are told apart by id and text: different texts that share an id, or have none, each stay. Of several texts with
    a component's smallest id, and of repeated rows, one stays.
    """
    row = free_name(docs, "_row")
    keyed = docs.withColumn(row, row_key(F.col("text"), F.col("doc_id")))
    signed = materialize(fingerprints(keyed, row), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))
    by_text = signed.groupBy("fp").agg(least.alias("first"))
    by_group = by_text.join(_grouped(signed, RADIUS), "fp").groupBy("root").agg(F.min("first").alias("first"))
    return keyed.join(by_group.select(F.col(f"first.{row}").alias(row)), row, "left_semi").dropDuplicates([row]).drop(row)


QUERIES = {"op3_simhash_near_dedup": lambda spark, sf_dir: near_groups(table(spark, sf_dir, "documents"))}
ORACLES: dict = {}
