"""WAV bytes: validity, header, decoding to mono samples, encoding to 16-bit PCM; and folders of WAV files."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.runtime import materialize

HEADER_BYTES = 44
_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE
DECODED = "seconds double, rate int, wave array<float>, error string"


class Format(NamedTuple):
    tag: int
    channels: int
    rate: int
    bits: int
    start: int
    size: int

    @property
    def frames(self) -> int:
        return self.size // (self.channels * self.bits // 8)


def header_at(read: Callable[[int, int], bytes], length: int) -> Format:
    """The format and where the samples lie; ValueError where this is no WAV file. A cut-off data chunk counts as far as it goes.

    read(at, n) gives n bytes of the file, which has that length; samples are not asked for.
    """
    head = read(0, min(12, length))
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE header")
    at, found = 12, None
    while at + 8 <= length:
        name, size = struct.unpack("<4sI", read(at, 8))
        at += 8
        if name == b"fmt " and size >= 16 and at + 16 <= length:
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read(at, 16))
            if tag == _EXTENSIBLE and size >= 26 and at + 26 <= length:
                tag = struct.unpack("<H", read(at + 24, 2))[0]
            if not channels or not rate or bits not in (8, 16, 24, 32, 64):
                raise ValueError("odd format")
            found = (tag, channels, rate, bits)
        elif name == b"data":
            if not found:
                raise ValueError("samples before their format")
            return Format(*found, at, min(size, length - at))
        at += size + size % 2
    raise ValueError("no samples")


def header(raw: bytes) -> Format:
    """header_at of bytes."""
    return header_at(lambda at, n: raw[at : at + n], len(raw))


def decode(raw: bytes) -> tuple[np.ndarray, int]:
    """Mono float32 samples in -1 to 1 (the mean over the channels) and their rate."""
    f = header(raw)
    body = raw[f.start : f.start + f.frames * f.channels * f.bits // 8]
    if f.tag == _FLOAT and f.bits in (32, 64):
        flat = np.frombuffer(body, f"<f{f.bits // 8}").astype(np.float64)
    elif f.tag == _PCM and f.bits == 8:
        flat = (np.frombuffer(body, np.uint8).astype(np.float64) - 128) / 128
    elif f.tag == _PCM and f.bits == 24:
        parts = np.frombuffer(body, np.uint8).reshape(-1, 3)
        flat = np.pad(parts, ((0, 0), (1, 0))).copy().view("<i4").ravel() / 2.0**31
    elif f.tag == _PCM and f.bits in (16, 32):
        flat = np.frombuffer(body, f"<i{f.bits // 8}") / 2.0 ** (f.bits - 1)
    else:
        raise ValueError(f"format {f.tag} of {f.bits} bits is not supported")
    return flat.reshape(-1, f.channels).mean(axis=1).astype(np.float32), f.rate


def encode(wave: np.ndarray, rate: int) -> bytes:
    """Mono 16-bit PCM; samples are clipped to -1 to 1 and rounded half to even."""
    body = np.rint(np.clip(np.nan_to_num(np.asarray(wave, np.float64)), -1, 1) * 32767).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, _PCM, 1, rate, rate * 2, 2, 16, b"data", len(body)) + body


def valid(content: Column) -> Column:
    """Longer than a header, RIFF at 0 and WAVE at 8; false for null."""
    return F.coalesce((F.length(content) > HEADER_BYTES) & (F.substring(content, 1, 4) == F.lit(b"RIFF")) & (F.substring(content, 9, 4) == F.lit(b"WAVE")), F.lit(False))


def encoded(rows: DataFrame, key: str, wave: str, rate: int) -> DataFrame:
    """(key, content): each wave as the bytes of a WAV file; a null wave gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            waves = (x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if w is None else encode(w, rate) for w in waves], pa.binary())], names=[key, "content"])

    return rows.select(key, F.col(wave).cast("array<double>")).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, content binary")


def save_files(files: DataFrame, folder: str, name: Column, content: str = "content") -> DataFrame:
    """(path, length) of a file in folder for each row, named by name and .wav; rows with null content or name have none.

    A file takes its name when it is complete, and a task that runs again writes the same ones. Rows of one name leave one of their files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        own = f"{TaskContext.get().taskAttemptId()}.part"
        for b in batches:
            names = b.column(0).to_pylist()
            for n, raw in zip(names, b.column(1), strict=True):
                with fs.open_output_stream(f"{root}/{n}.{own}") as out:
                    out.write(raw.as_buffer())
                fs.move(f"{root}/{n}.{own}", f"{root}/{n}.wav")
            yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{n}.wav" for n in names], pa.string()), pa.array([x.as_buffer().size for x in b.column(1)], pa.int64())], names=["path", "length"])

    rows = files.select(name.cast("string").alias("name"), content).where(F.col("name").isNotNull() & F.col(content).isNotNull())
    return materialize(rows.mapInArrow(run, "path string, length long"), "wav-list")


def decoded(files: DataFrame, key: str, content: str = "content", samples: bool = True) -> DataFrame:
    """(key, seconds, rate, wave, error): bytes that cannot be read have an error and nulls else, they fail no task.

    Without samples only headers are read and wave is null. Bytes whose header lacks the samples have null seconds.
    """

    def one(raw: bytes | None) -> tuple:
        if not raw:
            return None, None, None, "empty"
        try:
            f = header(raw)
            return f.frames / f.rate, f.rate, decode(raw)[0] if samples else None, None
        except (ValueError, struct.error, ZeroDivisionError) as problem:
            return None, None, None, str(problem)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(x.as_py()) for x in b.column(1)]
            types = (pa.float64(), pa.int32(), pa.list_(pa.float32()), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[i] for g in got], t) for i, t in enumerate(types))], names=[key, "seconds", "rate", "wave", "error"])

    return files.select(key, content).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, {DECODED}")


def wav_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of all WAV files below root; content is read only where it is selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(root).select("path", "length", "content")


def located(files: DataFrame, prefix: str, data_dir: str, speaker: str | None = None) -> DataFrame:
    """files with id, speaker and lang from paths <lang>/<data_dir>/<prefix>*/wav/<id>.wav; others go. speaker: part of its name."""
    parts = F.split("path", "/")
    rows = files.withColumns({"id": F.regexp_replace(F.element_at(parts, -1), r"\.wav$", ""), "speaker": F.try_element_at(parts, F.lit(-3)), "lang": F.try_element_at(parts, F.lit(-5))})
    rows = rows.where((F.try_element_at(parts, F.lit(-2)) == "wav") & (F.try_element_at(parts, F.lit(-4)) == data_dir) & F.startswith("speaker", F.lit(prefix)))
    return rows.where(F.contains("speaker", F.lit(speaker))) if speaker else rows
