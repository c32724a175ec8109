"""Models at the boundary: batches through a plugged-in scorer, and speech for texts of any length.

A scorer's result for one row must not depend on the others of its batch. It is made once a task, by a factory that is
shipped to the workers. A batch that runs out of memory is halved; a row that fails alone becomes a row with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.functions import text as T
from utterlake.functions import waves as W
from utterlake.sources import wav

BATCH = 64


class WaveScorer(Protocol):
    def __call__(self, waves: list[np.ndarray]) -> list[tuple[list[int], list[int]]]:
        """(global ids, semantic ids) of each wave."""


class Voice(Protocol):
    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Samples for each text."""


def quantiser() -> WaveScorer:
    """A stand-in without weights: global ids from the first 32 samples at 2048 steps, semantic ids from all at 4096."""
    return lambda waves: [(np.floor((w[:32] + 1) * 2048).astype(int).tolist(), np.floor((w + 1) * 4096).astype(int).tolist()) for w in waves]


def tone() -> Voice:
    """A stand-in without weights: four samples a character."""
    return lambda texts: [np.repeat([(ord(c) % 97) / 97 - 0.5 for c in t], 4) for t in texts]


def in_batches(scorer: Callable[[list], list], items: list, batch: int) -> list[tuple[object, str | None]]:
    """(result, error) of each item. MemoryError halves the batch; any other failure of many is repeated one by one, so only bad rows fail."""
    out: list[tuple[object, str | None]] = []
    at = 0
    while at < len(items):
        part = items[at : at + batch]
        try:
            got = scorer(part)
            if len(got) != len(part):
                raise ValueError(f"{len(got)} results for {len(part)} rows")
            out += [(g, None) for g in got]
            at += len(part)
        except Exception as problem:
            if len(part) == 1:
                out.append((None, f"{type(problem).__name__}: {problem}"))
                at += 1
            elif isinstance(problem, MemoryError):
                batch = max(1, len(part) // 2)
            else:
                for x in part:
                    out += in_batches(scorer, [x], 1)
                at += len(part)
    return out


def scored(rows: DataFrame, key: str, wave: str, make: Callable[[], WaveScorer] = quantiser, batch: int = BATCH) -> DataFrame:
    """(key, global_ids, semantic_ids, error) of every row; a null wave has an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make()
        for b in batches:
            waves = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in b.column(1)]
            there = iter(in_batches(scorer, [w for w in waves if w is not None], batch))
            got = [(None, "no wave") if w is None else next(there) for w in waves]
            ids = [pa.array([None if r is None else r[i] for r, _ in got], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *ids, pa.array([e for _, e in got], pa.string())], names=[key, "global_ids", "semantic_ids", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(wave).cast("array<double>")).mapInArrow(run, f"{key} {kind}, global_ids array<int>, semantic_ids array<int>, error string")


def spoken(rows: DataFrame, key: str, order: str, text: str, make: Callable[[], Voice] = tone, batch: int = BATCH) -> DataFrame:
    """(key, order, wave, error) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voice = make()
        for b in batches:
            got = in_batches(voice, b.column(2).to_pylist(), batch)
            waves = pa.array([None if w is None else np.asarray(w, np.float64) for w, _ in got], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), waves, pa.array([e for _, e in got], pa.string())], names=[key, order, "wave", "error"])

    kinds = [rows.schema[c].dataType.simpleString() for c in (key, order)]
    return rows.select(key, order, F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInArrow(run, f"{key} {kinds[0]}, {order} {kinds[1]}, wave array<double>, error string")


def scored_files(files: DataFrame, key: str = "path", content: str = "content", make: Callable[[], WaveScorer] = quantiser, batch: int = BATCH) -> DataFrame:
    """(key, seconds, rate, global_ids, semantic_ids, error) of WAV files, such as wav.wav_files lists: decoded, then scored in batches.

    A file that cannot be read, or that the scorer fails on, is a row with an error. Samples pass from one to the other in
    one task, they are not shuffled.
    """
    read = wav.decoded(files, key, content)
    kept = F.struct(key, "seconds", "rate", F.col("error").alias("unread"))
    got = scored(read.select(kept.alias("_file"), "wave"), "_file", "wave", make, batch)
    return got.select(f"_file.{key}", "_file.seconds", "_file.rate", "global_ids", "semantic_ids", F.coalesce("_file.unread", "error").alias("error"))


def joined_waves(chunks: DataFrame, key: str, order: str, wave: str, overlap: int) -> DataFrame:
    """(key, wave): what crossfaded gives, as one array for each key, which fits into a task as it must into a row."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by(order)
        waves = [w for w in (x.values.to_numpy(zero_copy_only=False) for x in rows.column(wave).combine_chunks() if x.is_valid) if len(w)]
        return pa.table({key: rows.column(key)[:1], wave: pa.array([crossfade(waves, overlap)], pa.list_(pa.float64()))})

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.where(F.size(wave) > 0).select(key, order, wave).groupBy(key).applyInArrow(run, f"{key} {kind}, {wave} array<double>")


def crossfade(waves: list[np.ndarray], overlap: int) -> np.ndarray:
    """Waves added up with linear ramps over the overlap; positions stay at 0 or more."""
    ramp, starts, at = float(max(1, overlap - 1)), [], 0
    for i, w in enumerate(waves):
        starts.append(max(0, at))
        at += len(w) - (overlap if i + 1 < len(waves) else 0)
    out = np.zeros(max(s + len(w) for s, w in zip(starts, waves, strict=True)))
    for i, (start, w) in enumerate(zip(starts, waves, strict=True)):
        place, weight = np.arange(len(w)), np.ones(len(w))
        if i:
            weight = np.where(place < overlap, weight * (place / ramp), weight)
        if i + 1 < len(waves):
            weight = np.where(place >= len(w) - overlap, weight * ((len(w) - 1 - place) / ramp), weight)
        out[start : start + len(w)] += w * weight
    return out


def synthesised(requests: DataFrame, key: str, text: str, lang: str | Column | None = "en", make: Callable[[], Voice] = tone, rate: int = 16000, overlap_ms: int = 50) -> DataFrame:
    """(key, content): a WAV file for each request's text, normalised once. Long texts are spoken in chunks that are crossfaded.

    lang may be a column; a null one is told by the script. Requests without any sound (empty or null texts, a voice that fails) have null content. key must be unique.
    """
    normal = T.normalise(F.col(text), lang)
    pieces = F.when(F.length(normal) > T.LONG_TEXT, T.chunked(normal)).otherwise(F.array(normal))
    chunks = requests.select(key, F.posexplode(pieces).alias("_no", "_piece")).where("_piece != ''")
    whole = joined_waves(spoken(chunks, key, "_no", "_piece", make), key, "_no", "wave", overlap_ms * rate // 1000)
    files = wav.encoded(whole.select(key, W.prepare(F.col("wave"), rate).alias("wave")), key, "wave", rate)
    return requests.select(key).join(files, key, "left")
