"""SentencePiece encoding and decoding with vectorised merge rounds.

All new words of a batch lie in one flat array of symbols. In a round every segment finds its least pair rank, its
leftmost pairs of that rank merge at once, and the arrays are compacted; segments without a mergeable pair leave. Pairs
behind a merge that makes a pair of the same or a lower rank wait for a later round, as one merge after the other would
have it. Segments end where no piece can reach across: before a space mark, and between letters that stand side by side
in no piece.

A worker keeps the ids of words that it has seen, in a bounded table.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from utterlake.runtime import table

KEPT = 500_000
SPACE, LOST = "▁", "�".encode()
_NONE = np.iinfo(np.int32).max
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Pairs:
    """Ranks and results of symbol pairs, found by binary search."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        values = np.array(list(pairs.values()), np.int32).reshape(-1, 2)
        none = np.full(1, np.iinfo(np.int64).max)
        self.keys = np.append(keys[order], none)
        self.ranks, self.made = (np.append(values[order, i], np.int32(_NONE)) for i in (0, 1))

    def of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, result) of each pair; _NONE where there is no such piece, or where right is negative."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, keys)
        there = (self.keys[at] == keys) & (right >= 0)
        return np.where(there, self.ranks[at], _NONE), np.where(there, self.made[at], _NONE)


class PieceBpe:
    """A BPE model file with the identity normaliser, a dummy prefix, spaces kept and byte fallback; others are refused."""

    def __init__(self, path: str):
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, kinds = model.normalizer_spec, [p.type for p in model.pieces]
        if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or not {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}.issuperset(kinds) or _BYTE not in kinds:
            raise ValueError(f"{path}: not a BPE model with byte fallback that takes texts as they are")
        self.size, self.end = len(kinds), kinds.index(_CONTROL) + [p.piece for p in model.pieces if p.type == _CONTROL].index(model.trainer_spec.eos_piece or "</s>")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        bytes_ = [i for i, k in enumerate(kinds) if k == _BYTE]
        self.byte_ids = np.zeros(256, np.int32)
        self.byte_ids[[int(model.pieces[i].piece[3:-1], 16) for i in bytes_]] = bytes_
        self.numbers = list(map(str, range(self.size)))
        self.is_byte, self.is_control = (np.array([k == x for k in kinds]) for x in (_BYTE, _CONTROL))
        self.starts_with_space = np.array([k == _NORMAL and p.piece.startswith(SPACE) for k, p in zip(kinds, model.pieces, strict=True)])
        surface = model.trainer_spec.unk_surface
        self.surfaces = [
            b"" if k == _CONTROL else surface.encode() if k == _UNKNOWN else bytes([int(p.piece[3:-1], 16)]) if k == _BYTE else p.piece.replace(SPACE, " ").encode()
            for k, p in zip(kinds, model.pieces, strict=True)
        ]
        scores = sorted({-p.score for p in model.pieces})
        rank = dict(zip(scores, range(len(scores)), strict=True))
        pairs, beside = {}, set()
        for i, p in enumerate(model.pieces):
            if p.type == _NORMAL:
                for cut in range(1, len(p.piece)):
                    beside.add((ord(p.piece[cut - 1]), ord(p.piece[cut])))
                    a, b = self._symbol(p.piece[:cut]), self._symbol(p.piece[cut:])
                    if a >= 0 and b >= 0:
                        pairs[a, b] = (rank[-p.score], i)
        self.pairs, self.beside = Pairs(pairs), np.array(sorted(a << 32 | b for a, b in beside), np.int64)
        self.symbols = self.size + np.arange(sys.maxunicode + 1, dtype=np.int32)
        letters = [c for c in self.ids if len(c) == 1]
        self.symbols[list(map(ord, letters))] = [self.ids[c] for c in letters]
        self.seen: dict[str, bytes] = {}
        blank = self._merged([SPACE * 64])[0]
        self.long_blank = (16, blank[:4]) if blank == blank[:4] * 4 else None

    def _symbol(self, text: str) -> int:
        """A piece's id; a letter that is no piece has one behind all pieces; -1 for anything else."""
        return self.ids.get(text, self.size + ord(text) if len(text) == 1 else -1)

    def _merged(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        symbols = self.symbols[code]
        keys = code[:-1] << 32 | code[1:]
        at = np.minimum(np.searchsorted(self.beside, keys), len(self.beside) - 1)
        joined = (word[1:] == word[:-1]) & (self.beside[at] == keys)
        segment = np.append(0, np.cumsum(~joined)) if len(code) else np.zeros(0, np.int64)
        place, symbols = self._rounds(np.arange(len(code)), symbols, segment)
        owner = word[place]
        ids, count = self._final(symbols)
        ends = 4 * np.cumsum(np.bincount(owner, count, len(words)).astype(np.int64))
        data = ids.astype("<u4").tobytes()
        return [data[s:e] for s, e in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def _rounds(self, place: np.ndarray, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left when no pair merges: first places and symbols, in order of place. segment ascends."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = np.full(len(place), _NONE, np.int32), np.full(len(place), _NONE, np.int32)
        stale = np.arange(len(place))
        while len(place):
            n = len(place)
            last = np.append(segment[1:] != segment[:-1], True)
            right = np.append(symbols[1:], -1)
            rank[stale], made[stale] = self.pairs.of(symbols[stale], np.where(last[stale], -1, right[stale]))
            starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, n)))
            open_ = least < _NONE
            if not open_.all():
                done.append((place[~open_], symbols[~open_]))
                place, symbols, segment, rank, made, least = (x[open_] for x in (place, symbols, segment, rank, made, least))
                if not len(place):
                    break
                n = len(place)
            found = np.flatnonzero(rank == least)
            fresh = np.append(True, found[1:] != found[:-1] + 1)
            in_run = np.arange(len(found)) - np.maximum.accumulate(np.where(fresh, np.arange(len(found)), 0))
            chosen = found[in_run % 2 == 0]
            chosen = chosen[self._in_turn(chosen, symbols, segment, made, least)]
            symbols[chosen] = made[chosen]
            keep = np.ones(n, bool)
            keep[chosen + 1] = False
            changed = np.zeros(n, bool)
            changed[chosen] = True
            before = chosen - 1
            before = before[before >= 0]
            changed[before - ~keep[before]] = True  # the symbol before, or what it became part of
            place, symbols, segment, rank, made, changed = (x[keep] for x in (place, symbols, segment, rank, made, changed))
            stale = np.flatnonzero(changed)
        places, left = (np.concatenate([d[i] for d in done] or [np.zeros(0, np.int32)]) for i in (0, 1))
        order = np.argsort(places)
        return places[order].astype(np.int64), left[order]

    def _in_turn(self, chosen: np.ndarray, symbols: np.ndarray, segment: np.ndarray, made: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which of the chosen pairs would merge next to each other in turn: in each segment those up to the first that makes a pair of no higher rank."""
        n, new, own = len(symbols), made[chosen], segment[chosen]
        before = np.maximum(chosen - 1, 0)
        has_before = (chosen > 0) & (segment[before] == own)
        joined = np.append(False, chosen[1:] == chosen[:-1] + 2) & has_before
        left = np.where(joined, np.append(0, new[:-1]), symbols[before])
        after = np.minimum(chosen + 2, n - 1)
        has_after = (chosen + 2 < n) & (segment[after] == own)
        low = self.pairs.of(left, np.where(has_before, new, -1))[0] <= least[chosen]
        low |= self.pairs.of(new, np.where(has_after, symbols[after], -1))[0] <= least[chosen]
        earlier = np.cumsum(low) - low
        first = np.append(True, own[1:] != own[:-1])
        at_start = np.maximum.accumulate(np.where(first, earlier, 0))
        return earlier == at_start

    def _final(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids for each symbol): letters that are no pieces are spelled in bytes."""
        count = np.ones(len(symbols), np.int64)
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols, count
        spelled = [chr(c).encode() for c in (symbols[odd] - self.size).tolist()]
        count[odd] = list(map(len, spelled))
        ids = np.repeat(symbols, count)
        first = np.cumsum(count) - count
        places = np.repeat(first[odd], count[odd]) + np.concatenate([np.arange(len(s)) for s in spelled])
        ids[places] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids, count

    def _shorter(self, word: str) -> tuple[bytes, str]:
        """(ids of full blank pieces, the rest): a long run of blanks is taken off in pieces of 16, from the left as the merges do."""
        if self.long_blank and word.startswith(SPACE * 64):
            blanks = len(word) - len(word.lstrip(SPACE))
            n = blanks // self.long_blank[0] - 2
            return self.long_blank[1] * n, word[n * self.long_blank[0] :]
        return b"", word

    def _learn(self, words: Iterable[str]) -> None:
        words = list(words)
        cut = [self._shorter(w) for w in words]
        self.seen.update((w, head + ids) for w, (head, _), ids in zip(words, cut, self._merged([rest for _, rest in cut]), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text with the end id, as unsigned 32-bit integers."""
        if len(self.seen) > KEPT:
            self.seen.clear()
        words = [_WORDS.findall((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        if new := set().union(*words).difference(self.seen):
            self._learn(new)
        of, end = self.seen.__getitem__, int(self.end).to_bytes(4, "little")
        return [np.frombuffer(b"".join([*map(of, ws), end]), "<u4") for ws in words]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, in UTF-8: one blank of a leading mark goes, bytes that are no UTF-8 become U+FFFD each."""
        ids = np.asarray(ids, np.int64)
        parts = list(map(self.surfaces.__getitem__, ids.tolist()))
        control = self.is_control[ids]
        shown = ids[~control]
        if len(shown) and self.starts_with_space[shown[0]]:
            first = int(np.argmin(control))
            parts[first] = parts[first][1:]
        if self.is_byte[shown].any():  # bytes make characters only where they stand side by side
            cuts = np.flatnonzero(np.diff(self.is_byte[ids])) + 1
            return b"".join(_mended(b"".join(parts[s:e])) for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)], strict=True))
        return b"".join(parts)


def _mended(raw: bytes) -> bytes:
    """raw with each byte that belongs to no character replaced."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                raw[at : at + size].decode()
            except UnicodeDecodeError:
                continue
            out.append(raw[at : at + size])
            at += size
            break
        else:
            out.append(LOST)
            at += 1
    return b"".join(out)


@lru_cache(2)
def piece_bpe(path: str) -> PieceBpe:
    """One for each worker process: its table lasts over tasks."""
    return PieceBpe(path)


_TYPES = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}


def encode_decode(docs: DataFrame, path: str | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Encode each row's whole text with an end id, decode the ids, and return doc_id with the named outputs.

    outputs: n_tokens, ids (array), decoded (text), ids_sha256 (of the decimal ids joined by a blank), decoded_sha256 (of
    the UTF-8 text). Null and empty texts have the end id alone and decode to an empty text. Repeated rows each give a
    row, null ids stay null, other columns are ignored, an empty table gives an empty result. No shuffle.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(path)
        for batch in batches:
            ids = bpe.encode([x or "" for x in batch.column("text").to_pylist()])
            columns = {"n_tokens": list(map(len, ids))}
            if "ids" in outputs:
                columns["ids"] = [x.view("<i4") for x in ids]
            if "ids_sha256" in outputs:
                columns["ids_sha256"] = [hashlib.sha256(" ".join(map(bpe.numbers.__getitem__, x.tolist())).encode()).hexdigest() for x in ids]
            if "decoded" in outputs or "decoded_sha256" in outputs:
                decoded = [bpe.decode(x) for x in ids]
                columns["decoded"] = [x.decode() for x in decoded] if "decoded" in outputs else None
                columns["decoded_sha256"] = [hashlib.sha256(x).hexdigest() for x in decoded]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(columns[c], _TYPES[c][1]) for c in outputs)], names=["doc_id", *outputs])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} {_TYPES[c][0]}" for c in outputs)]))


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")
QUERIES = {"op12_sentencepiece": lambda spark, sf_dir: encode_decode(table(spark, sf_dir, "documents"), outputs=DIGESTS)}
ORACLES: dict = {}
