"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a word's tree hold (rank, position) of each adjacent pair; the root is the leftmost pair of lowest rank.
A merge changes three leaves and the paths above them, and the word is done when the root holds no mergeable pair. Short
words are merged many at a time, one tree a row of an array; a word of more than LANES bytes has its own tree.

Texts split at white space, which no merge crosses, so a worker keeps the ids of units it has seen, in bounded tables.
The library only splits the few units with signs that are new in Unicode, so that both agree on what is a letter.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from utterlake.runtime import table

LANES, KEPT = 64, 500_000
_NONE = np.iinfo(np.int64).max
#: White space as Unicode has it; str.split() would also take U+001C to U+001F.
_BLANK = "\t-\r \x85\xa0  -     　"
_SPACE, _SEPARATORS = re.compile(f"[{_BLANK}]+"), re.compile("[\x1c-\x1f]")
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_BLANK}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable Latin-1, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """The merge table and both trees."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        """pairs: (left id, right id, merged id) by rank."""
        keys = np.array([left << 24 | right for left, right, _ in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([m for *_, m in pairs], np.int32)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs)), strict=True))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where there is no merge; a negative id has none."""
        keys = left.astype(np.int64) << 24 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (right >= 0), self.ranks[at], _NONE)

    def one(self, ids: list[int]) -> list[int]:
        """A single word of any length: n leaves, O(log n) for each merge."""
        n = len(ids)
        width = 1 << max(0, (n - 1).bit_length())
        ids, tree, rank_of, none = list(ids), [_NONE] * (2 * width), self.rank_of, -1
        after, before = [*range(1, n), none], [none, *range(n - 1)]
        for i in range(n - 1):
            if (r := rank_of.get(ids[i] << 24 | ids[i + 1])) is not None:
                tree[width + i] = r << 32 | i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low

        def leaf(i: int) -> int:
            r = rank_of.get(ids[i] << 24 | ids[after[i]]) if after[i] != none else None
            return _NONE if r is None else r << 32 | i

        while (root := tree[1]) != _NONE:
            i = root & 0xFFFFFFFF
            j = after[i]
            ids[i], ids[j], after[i] = int(self.merged[root >> 32]), none, after[j]
            if after[i] != none:
                before[after[i]] = i
            put(j, _NONE)
            put(i, leaf(i))
            if before[i] != none:
                put(before[i], leaf(before[i]))
        return [x for x in ids if x != none]

    def many(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """words: (n, width) ids, rows filled up with -1, width a power of two. Returns all ids in order and their number by row."""
        n, width = words.shape
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ids = np.concatenate([words, np.full((n, 1), -1, np.int32)], axis=1)  # the last column is what follows the last symbol
        after = np.minimum(np.arange(1, width + 2), sizes[:, None]).astype(np.int32)
        after[after == sizes[:, None]] = width
        before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
        alive = np.arange(width) < sizes[:, None]
        tree = np.full((n, 2 * width), _NONE)
        leaves = self._rank(ids[:, :width], ids[:, 1:])
        tree[:, width:] = np.where(leaves < _NONE, leaves * width + np.arange(width), _NONE)
        for low in (1 << k for k in reversed(range(width.bit_length() - 1))):
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        rows = np.arange(n)
        while True:
            rows = rows[tree[rows, 1] < _NONE]
            if not len(rows):
                break
            root = tree[rows, 1]
            i, new = root % width, self.merged[root // width]
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i], after[rows, i], before[rows, k], alive[rows, j] = new, k, i, False
            h = before[rows, i]
            right = self._rank(new, ids[rows, k])
            left = self._rank(np.where(h >= 0, ids[rows, h], 1 << 22), new)
            tree[rows, width + j] = _NONE
            tree[rows, width + i] = np.where(right < _NONE, right * width + i, _NONE)
            has = np.flatnonzero(h >= 0)
            tree[rows[has], width + h[has]] = np.where(left[has] < _NONE, left[has] * width + h[has], _NONE)
            at = [width + j, width + i, np.where(h >= 0, width + h, width + i)]
            for _ in range(width.bit_length() - 1):
                at = [a >> 1 for a in at]
                for a in at:
                    tree[rows, a] = np.minimum(tree[rows, 2 * a], tree[rows, 2 * a + 1])
        return ids[:, :width][alive], alive.sum(1)


class WordBpe:
    """A tokenizer file of BPE with word ends: NFC, lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int32)
        self.end_ids = np.array([vocab[c + end] for c in letters], np.int32)
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.tokens = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in (vocab | self.special).items():
            self.tokens[i] = token.encode()
        self.library = Tokenizer.from_file(path)
        self.units: dict[str, bytes] = {}  # ids of units as they stand in texts
        self.seen: dict[str, bytes] = {}  # ids of words

    def _merge_words(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        least = 1
        while least < LANES:
            width = 2 * least
            chosen = np.flatnonzero((sizes <= width) & (sizes > (least if least > 1 else 0)))
            for at in range(0, len(chosen), 1 << 15):
                part = chosen[at : at + (1 << 15)]
                own = sizes[part]
                grid = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in part), np.uint8).reshape(-1, width)
                ids = np.where(np.arange(width) < own[:, None], self.byte_ids[grid], -1).astype(np.int32)
                ids[np.arange(len(part)), own - 1] = self.end_ids[grid[np.arange(len(part)), own - 1]]
                flat, counts = self.merges.many(ids, own)
                data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                self.seen.update((words[i], data[s:e]) for i, s, e in zip(part.tolist(), [0, *ends], ends, strict=False))
            least = width
        for i in np.flatnonzero(sizes > LANES).tolist():
            ids = self.byte_ids[np.frombuffer(raw[i], np.uint8)].tolist()
            ids[-1] = int(self.end_ids[raw[i][-1]])
            self.seen[words[i]] = np.array(self.merges.one(ids), "<u4").tobytes()

    def _split(self, unit: str) -> list[str]:
        """The words of a unit. No rule looks across white space, so a unit is normalised alone."""
        if unit.isascii():
            unit = unit.lower()
        elif unit.isprintable():  # each letter alone is lowered, so a final sigma is no special case
            unit = unicodedata.normalize("NFC", unit).replace("\u03a3", "\u03c3").lower()
        else:  # signs whose class depends on the Unicode version: the library's own
            unit = self.library.normalizer.normalize_str(unit)
            return [unit[start:end] for _, (start, end) in self.library.pre_tokenizer.pre_tokenize_str(unit)]
        return [unit] if unit.isalpha() else _WORDS.findall(unit)

    def _learn(self, units: Iterable[str]) -> None:
        """units: without white space, not yet seen."""
        split = {unit: self._split(unit) for unit in units}
        self._merge_words(list({w for words in split.values() for w in words}.difference(self.seen)))
        self.units.update((unit, b"".join([self.seen[w] for w in words])) for unit, words in split.items())

    def _units(self, text: str) -> list[str]:
        return [u for u in _SPACE.split(text) if u] if _SEPARATORS.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if max(len(self.units), len(self.seen)) > KEPT:
            self.units.clear()
            self.seen.clear()
        parts = [[t] if "<|" not in t else self.specials.split(t) for t in texts]
        units = [[p if p in self.special else self._units(p) for p in ps] for ps in parts]
        self._learn(set().union(*(p for us in units for p in us if type(p) is list)).difference(self.units))
        of = self.units.__getitem__
        return [b"".join([b"".join(map(of, p)) if type(p) is list else self.special[p].to_bytes(4, "little") for p in us]) for us in units]

    def decode(self, ids: bytes) -> bytes:
        """The tokens' texts joined by spaces, in UTF-8: the file names no decoder, and none of its tokens is left out."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    """One for each worker process: its tables last over tasks."""
    return WordBpe(path)


_TYPES = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}


def encode_decode(docs: DataFrame, path: str | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Encode each row's whole text, decode the ids, and return doc_id with the named outputs.

    outputs: n_tokens, ids (array), decoded (text), ids_sha256 (of ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the UTF-8 text). Null and empty texts have no ids and decode to an empty text. Repeated rows each
    give a row, null ids stay null, other columns are ignored, an empty table gives an empty result. No shuffle.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            ids = bpe.encode([x or "" for x in batch.column("text").to_pylist()])
            columns = {"n_tokens": [len(x) // 4 for x in ids]}
            if "ids" in outputs:
                columns["ids"] = [np.frombuffer(x, "<i4") for x in ids]
            if "ids_sha256" in outputs:
                columns["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in ids]
            if "decoded" in outputs or "decoded_sha256" in outputs:
                decoded = (bpe.decode(x) for x in ids)
                if "decoded" in outputs:
                    decoded = list(decoded)
                    columns["decoded"] = [x.decode() for x in decoded]
                columns["decoded_sha256"] = [hashlib.sha256(x).hexdigest() for x in decoded]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(columns[c], _TYPES[c][1]) for c in outputs)], names=["doc_id", *outputs])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} {_TYPES[c][0]}" for c in outputs)]))


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")
QUERIES = {"op1_bpe": lambda spark, sf_dir: encode_decode(table(spark, sf_dir, "documents"), outputs=DIGESTS)}
ORACLES: dict = {}
