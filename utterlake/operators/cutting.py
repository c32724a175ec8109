"""Texts cut into the longest pieces of a vocabulary, by a trie in flat arrays.

Edges are sorted keys (node, letter) with their targets, so one binary search takes all places of a batch one letter down.
The longest piece at every place is found level by level; a walk then takes the places that a cut from the left meets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: A vocabulary of up to so many bytes goes to the workers.
SHIPPED_BYTES = 64 << 20
#: Bytes of text that are cut at a time, behind a first text of any length. It bounds what a worker holds.
SLICE_BYTES = 1 << 20
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


class Trie:
    """Pieces with ids; the empty piece is none. Of pieces given twice the least id counts."""

    def __init__(self, pieces: list[str], ids: list[int]):
        known: dict[str, int] = {}
        for p, i in zip(pieces, ids, strict=True):
            if p:
                known[p] = min(i, known.get(p, i))
        words = sorted(known)
        self.depth = max(map(len, words), default=0)
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(sizes) - sizes
        node, made, keys, targets = np.zeros(len(words), np.int64), 1, [], []
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        values = np.array([known[w] for w in words], np.int64)
        for level in range(self.depth):
            on = np.flatnonzero(sizes > level)
            edge = node[on] << 21 | code[first[on] + level]
            own, at = np.unique(edge, return_inverse=True)
            keys.append(own)
            targets.append(made + np.arange(len(own)))
            node[on] = made + at
            made += len(own)
            done = np.flatnonzero(sizes == level + 1)
            ends.append((node[done], values[done]))
        keys_, targets_ = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (keys, targets))
        order = np.argsort(keys_)
        self.keys, self.targets = np.append(keys_[order], np.iinfo(np.int64).max), np.append(targets_[order], -1)
        self.ids = np.full(made, -1, np.int64)
        for nodes, own in ends:
            self.ids[nodes] = own

    def longest(self, code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(letters, id) of the longest piece at each place; 0 and -1 where none begins. left: letters from a place to its text's end."""
        size, found = np.zeros(len(code), np.int64), np.full(len(code), -1, np.int64)
        places, node = np.arange(len(code)), np.zeros(len(code), np.int64)
        for level in range(self.depth):
            inside = left[places] > level
            places, node = places[inside], node[inside]
            edge = node << 21 | code[places + level]
            at = np.searchsorted(self.keys, edge)
            there = self.keys[at] == edge
            places, node = places[there], self.targets[at[there]]
            if not len(places):
                break
            ends = self.ids[node] >= 0
            size[places[ends]], found[places[ends]] = level + 1, self.ids[node[ends]]
        return size, found

    def columns(self, words: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """(pieces, ids) of each word as cut gives them, as lists in flat buffers: all words take their next step at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = "".join(words)
        code = np.frombuffer(flat.encode("utf-32-le"), "<u4").astype(np.int64)
        ends = np.cumsum(sizes)
        size, found = self.longest(code, np.repeat(ends, sizes) - np.arange(len(code)))
        steps, starts = np.maximum(size, 1), np.zeros(len(code), bool)
        on = np.flatnonzero(sizes)
        places, last = (ends - sizes)[on], ends[on]
        while len(places):
            starts[places] = True
            places = places + steps[places]
            inside = places < last
            places, last = places[inside], last[inside]
        own = np.flatnonzero(starts)
        bounds = pa.array(np.concatenate([[0], np.searchsorted(own, ends)]).astype(np.int32))
        octets = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])
        offsets = np.append(octets[own], octets[-1]).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(own), pa.py_buffer(offsets), pa.py_buffer(flat.encode()))
        ids = pa.array(found[own], pa.int64(), mask=found[own] < 0)
        return pa.ListArray.from_arrays(bounds, pieces), pa.ListArray.from_arrays(bounds, ids)

    def cut(self, texts: list[str]) -> list[tuple[list[str], list[int | None]]]:
        """(pieces, ids) of each text from the left, always the longest; a letter that begins no piece stands alone and has no id."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        ends = np.cumsum(sizes)
        size, found = self.longest(code, np.repeat(ends, sizes) - np.arange(len(code)))
        steps, ids, out = np.maximum(size, 1).tolist(), found.tolist(), []
        for text, start, end in zip(texts, (ends - sizes).tolist(), ends.tolist(), strict=True):
            at, pieces, own = start, [], []
            while at < end:
                pieces.append(text[at - start : at - start + steps[at]])
                own.append(ids[at] if ids[at] >= 0 else None)
                at += steps[at]
            out.append((pieces, own))
        return out


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """batch in slices that end where the texts of column at pass a multiple of SLICE_BYTES."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    starts = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
    for start, end in zip(starts, starts[1:]):
        yield batch.slice(start, end - start)


def cut_texts(rows: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """rows with pieces and ids: the words of text (between ASCII white space) cut into the longest pieces of vocabulary(piece, id).

    A letter that begins no piece is a piece without an id. Null texts have null pieces, texts without words none. Null
    and empty pieces of the vocabulary and null ids do not count, of a piece with several ids the least does. Columns
    named pieces and ids are replaced, all others stay. A vocabulary of more than SHIPPED_BYTES is refused. No shuffle.
    """
    known = vocabulary.where("piece <> '' AND id >= 0").select(F.col("piece").cast("string").alias("piece"), F.col("id").cast("long").alias("id"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("piece") + 8), F.lit(0))).first()[0]
    if size > SHIPPED_BYTES:
        raise ValueError(f"a vocabulary of {size} bytes; at most {SHIPPED_BYTES} go to the workers")
    table = known.toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((table["piece"].to_pylist(), table["id"].to_pylist()))
    others = [c for c in rows.columns if c.lower() not in ("pieces", "ids")]
    at = others.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*shared.value)
        for b in (part for batch in batches for part in _slices(batch, at)):
            words = [None if t is None else _WORD.findall(t) for t in b.column(at).to_pylist()]
            known: dict[str, int] = {}  # different words of the slice are cut once
            of = np.fromiter((known.setdefault(w, len(known)) for ws in words if ws for w in ws), np.int64)
            last = np.cumsum([len(ws or ()) for ws in words], dtype=np.int64)
            none, cuts = np.array([ws is None for ws in words], bool), []
            for column in trie.columns(list(known)):
                taken = column.take(pa.array(of))
                bounds = np.append(0, taken.offsets.to_numpy()[last] - taken.offsets[0].as_py())
                cuts.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), taken.flatten(), mask=pa.array(none)))
            yield pa.RecordBatch.from_arrays([*b.columns, *cuts], names=[*b.schema.names, "pieces", "ids"])

    given = rows.select(*others)
    return given.mapInArrow(run, StructType([*given.schema.fields, StructField("pieces", ArrayType(StringType())), StructField("ids", ArrayType(LongType()))]))
