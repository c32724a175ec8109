"""Token-ID output in files: each document compressed alone, with one zstandard dictionary for all of them.

A file: MAGIC, SHA-256 of the dictionary, bytes of an id; the documents' zstandard frames; the index, one row a
document (doc_id, offset, bytes, ids); its offset, number of rows and CRC-32, and MAGIC again. The dictionary stands beside
the files. A reader finds a document by its index row and decompresses that frame only. Every attempt of a task writes a file
of its own name; LISTED, written last, names those that count, so a task that is run again, or twice, harms nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import public_tokenizers
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.llm.bpe import byte_letters
from utterlake.runtime import dealt_by_range, scratch_path, table

MAGIC, LEVEL, END_ID, LISTED = b"UTLKIDS1", 3, 2, "files.json"
#: The dictionary is trained on about this many documents, picked by a hash of id and text over all rows; of each at most
#: SAMPLE_BLOCKS blocks of its ids, from places spread over the whole document.
DICTIONARY_DOCS, DICTIONARY_BYTES, SAMPLE_BLOCKS, BLOCK_BYTES = 1500, 64 << 10, 8, 8 << 10
_INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u4"), ("null", "?")])
_TAIL = np.dtype([("offset", "<u8"), ("rows", "<u8"), ("crc", "<u4")])
#: Signs whose class has long been the same in every version of Unicode: for these, both libraries cut alike.
_SETTLED = re.compile("[\x00-\u0233\u0386-\u0481]*")
#: Of these, all but white space other than blanks and line ends.
_PLAIN = re.compile("[\n -~\xa1-\u0233\u0386-\u0481]*")
_TWO_BLANKS = ("  ", " \n", "\n ", "\n\n")
#: The library's rule for pieces without its look-ahead, which only matters where two blanks meet: cut several times as fast.
_NO_LOOK_AHEAD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

#: A gap that is too long for tiktoken's look-ahead, which keeps it on a stack.
_LONG_GAP = re.compile(r"\s{1000}")


class ByteBpe:
    """The tokenizers library's encoding of whole texts.

    tiktoken, which holds the same vocabulary as ranks and is several times as fast, encodes the texts whose pieces it is
    sure to cut alike. The tokenizers library encodes those with a special token, signs beyond _SETTLED or a very long gap,
    and all texts where the file is of another kind or its ids are not its merges' ranks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.size = self.tok.get_vocab_size()
        ranks = self._ranks(path)
        self.plain, self.any = (ranks and tiktoken.Encoding(name, pat_str=rule, mergeable_ranks=ranks, special_tokens={}) for name, rule in (("plain", _NO_LOOK_AHEAD), ("any", public_tokenizers.PATTERN)))

    def _ranks(self, path: str) -> dict[bytes, int] | None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cutter, vocab = spec["pre_tokenizer"] or {}, spec["model"]["vocab"]
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        same_rule = cutter.get("type") == "ByteLevel" and not cutter["add_prefix_space"] and cutter.get("use_regex", True) and not spec["normalizer"]
        if not same_rule or [vocab[m] for m in merged] != list(range(256, 256 + len(merged))):
            return None
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in self.special}

    def _ids(self, text: str) -> list[int]:
        if self.plain and not any(s in text for s in self.special):
            if _PLAIN.fullmatch(text) and not any(two in text for two in _TWO_BLANKS):
                return self.plain.encode_ordinary(text)
            if _SETTLED.fullmatch(text) and not _LONG_GAP.search(text):
                return self.any.encode_ordinary(text)
        return self.tok.encode(text, add_special_tokens=False).ids

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        return (np.array(self._ids(text), "<u4").tobytes() for text in texts)


@lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def _packed(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def _blocks(ids: bytes) -> list[bytes]:
    """At most SAMPLE_BLOCKS blocks, evenly spread from the first to the last; all where there are fewer."""
    n = -(-len(ids) // BLOCK_BYTES)
    chosen = range(n) if n <= SAMPLE_BLOCKS else sorted({round(i * (n - 1) / (SAMPLE_BLOCKS - 1)) for i in range(SAMPLE_BLOCKS)})
    return [ids[i * BLOCK_BYTES : (i + 1) * BLOCK_BYTES] for i in chosen]


def train_dictionary(docs: DataFrame, path: str, width: int) -> bytes:
    """A zstandard dictionary over the serialised ids of about DICTIONARY_DOCS documents; empty only where these have no ids.

    Where the samples are too few or too alike to train on, their own bytes are the dictionary.
    """
    share = min(1.0, DICTIONARY_DOCS / max(docs.count(), 1))
    picked = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * DICTIONARY_DOCS)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in byte_bpe(path).encode([t or "" for t in b.column("text").to_pylist()]):
                yield pa.RecordBatch.from_arrays([pa.array(_blocks(_packed(own, width)), pa.binary())], names=["ids"])

    samples = sorted(bytes(r.ids) for r in picked.mapInArrow(ids, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _options(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file. It takes its name when it is complete, so no half file has it."""

    def __init__(self, uri: str, dictionary: bytes, width: int):
        self.fs, self.path = _filesystem(uri)
        self.part, self.width, self.rows = f"{self.path}.part", width, []
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **_options(dictionary))
        self.out = self.fs.open_output_stream(self.part)
        self.at = self.out.write(MAGIC + hashlib.sha256(dictionary).digest() + bytes([width]))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: unsigned 32-bit."""
        frame = self.zstd.compress(_packed(ids, self.width))
        self.rows.append((doc_id or 0, self.at, len(frame), len(ids) // 4, doc_id is None))
        self.out.write(frame)
        self.at += len(frame)

    def close(self) -> None:
        index = np.array(self.rows, _INDEX).tobytes()
        self.out.write(index + np.array([(self.at, len(self.rows), zlib.crc32(index))], _TAIL).tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.part, self.path)


class Reader:
    def __init__(self, uri: str, dictionary: bytes):
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        size, head = self.file.size(), self.file.read_at(41, 0)
        tail = np.frombuffer(self.file.read_at(_TAIL.itemsize, size - 8 - _TAIL.itemsize), _TAIL)[0]
        if head[:8] != MAGIC or self.file.read_at(8, size - 8) != MAGIC:
            raise ValueError(f"{uri} is not a complete file of token ids")
        if head[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        index = self.file.read_at(int(tail["rows"]) * _INDEX.itemsize, int(tail["offset"]))
        if zlib.crc32(index) != tail["crc"]:
            raise ValueError(f"the index of {uri} is damaged")
        self.index, self.width = np.frombuffer(index, _INDEX), head[40]
        self.zstd = zstandard.ZstdDecompressor(**_options(dictionary))

    def ids(self, row: int) -> np.ndarray:
        """The ids of the document at that row of the index; nothing else of the file is read."""
        r = self.index[row]
        raw = self.zstd.decompress(self.file.read_at(int(r["bytes"]), int(r["offset"]))) if r["ids"] else b""
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> list[tuple[str, int, int]]:
    """Encode every whole text, append end_id, and write files in ascending doc_id order, the dictionary first, the list of files last.

    Returns (file, documents, ids) in that order, as LISTED holds them: one row a file, not a document. Null texts are empty
    and null ids come first; rows with one doc_id are ordered by a hash of their text. Other columns are ignored; an empty table
    writes no file of ids.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    width = 2 if max(byte_bpe(tokenizer).size - 1, end_id) < 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dictionary = train_dictionary(rows, tokenizer, width)
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/dictionary.zstd") as f:
        f.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, name, out, ids = TaskContext.get(), "", None, 0
        for b in batches:
            for doc_id, own in zip(b.column("doc_id").to_pylist(), byte_bpe(tokenizer).encode(b.column("text").to_pylist()), strict=True):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.ids"
                    out = Writer(f"{folder}/{name}", dictionary, width)
                out.add(doc_id, own + end_id.to_bytes(4, "little"))
                ids += len(own) // 4 + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"name": name, "docs": len(out.rows), "ids": ids}])

    dealt = dealt_by_range(rows, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    files = sorted((r.name, r.docs, r.ids) for r in dealt.mapInArrow(write, "name string, docs long, ids long").collect())
    with fs.open_output_stream(f"{path}/{LISTED}") as f:
        f.write(json.dumps(files).encode())
    return files


def listed_files(folder: str) -> list[tuple[str, int, int]]:
    """(file, documents, ids) of the files that count, in their order."""
    fs, path = _filesystem(folder)
    with fs.open_input_stream(f"{path}/{LISTED}") as f:
        return [tuple(x) for x in json.loads(f.read())]


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every document in the listed files; start counts the ids of all documents before it."""
    fs, path = _filesystem(folder)
    with fs.open_input_stream(f"{path}/dictionary.zstd") as f:
        dictionary = f.read()
    parts, before = [], 0
    for name, _, ids in listed_files(folder):
        parts.append((name, before))
        before += ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
                source = Reader(f"{folder}/{name}", dictionary)
                counts = source.index["ids"].astype(np.int64)
                starts = start + np.cumsum(counts) - counts
                for at in range(0, len(counts), 1024):
                    span = range(at, min(at + 1024, len(counts)))
                    own = source.index[at : at + 1024]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(own["doc_id"], mask=own["null"]), pa.array(starts[at : at + 1024]), pa.array(counts[at : at + 1024]), pa.array([zlib.crc32(source.ids(i).tobytes()) for i in span], pa.int64()),
                    ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files_df = spark.createDataFrame(parts, "name string, start long").repartition(max(1, len(parts)))
    return files_df.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(spark: SparkSession, docs: DataFrame) -> DataFrame:
    folder = scratch_path(spark, "token-ids")
    write_token_files(docs, folder)
    return read_token_files(spark, folder)


QUERIES = {"op9_token_files": lambda spark, sf_dir: token_file_round_trip(spark, table(spark, sf_dir, "documents"))}
ORACLES: dict = {}
