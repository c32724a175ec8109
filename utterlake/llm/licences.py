"""License scans with a positional index of rare words.

A template is the wording of a notice or of a licence's opening. It matches where enough of its words stand in their order,
the words between or left out shifting their places by SLACK at most: in a band of SLACK + 1 neighbouring starts, the longest
common subsequence holds a share of ALIKE of the wording. The templates' words are ranked by inverse document frequency,
counted over all documents. A match can miss few places, so of a template's rarest places, two more than it can miss, at
least two stand in the band: only these are indexed and looked up, and starts where two of them agree are compared word by
word. So the result is that of comparing the template everywhere. A match must hold the template's key phrases. The base
phrases go through the same postings: their words' places are intersected.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.runtime import table

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation either version {} of the license or at your option any later version"
_CC = "this work is licensed under a creative commons attribution {}4 0 international license"
#: (label, wording, key phrases that must stand within it)
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license",)),
    ("apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ("apache license", "version 2 0")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license", "version 3")),
    ("gpl-3.0", _GNU.format("", 3), ("gnu general public license", "version 3")),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation", ("gnu general public license", "version 3")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license", "version 2")),
    ("gpl-2.0", _GNU.format("", 2), ("gnu general public license", "version 2")),
    ("gpl-2.0", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation", ("gnu general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("lgpl", _GNU.format("lesser ", "2 1"), ("gnu lesser general public license",)),
    ("agpl-3.0", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("agpl-3.0", _GNU.format("affero ", 3), ("gnu affero general public license", "version 3")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name of", "endorse or promote products")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "hereby granted")),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("held liable", "arising from the use of this software")),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    ("cc0-1.0", "creative commons legal code cc0 1 0 universal", ("cc0 1 0",)),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to this work", ("related or neighboring rights",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-4.0", _CC.format(""), ("attribution 4 0 international",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa-4.0", _CC.format("sharealike "), ("attribution sharealike 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc-4.0", _CC.format("noncommercial "), ("attribution noncommercial 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-nd-4.0", _CC.format("noderivatives "), ("attribution noderivatives 4 0",)),
    ("cc-by", "licensed under a creative commons attribution license", ("creative commons attribution",)),
]
#: Identifiers that stand behind "SPDX-License-Identifier:", word by word as a template of their own, and their label where it is another.
SPDX = ["apache-2.0", "gpl-3.0", "gpl-2.0", "agpl-3.0", "mit", "bsd-3-clause", "isc", "mpl-2.0", "epl-2.0", "zlib", "bsl-1.0", "unlicense", "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc-by-nd-4.0", ("lgpl-2.1", "lgpl"), ("lgpl-3.0", "lgpl"), ("bsd-2-clause", "bsd")]
ALIKE, SLACK = 0.8, 4


def _spdx() -> list[tuple[str, str, tuple[str, ...]]]:
    named = [x if isinstance(x, tuple) else (x, x) for x in SPDX]
    return [(label, wording, (wording,)) for wording, label in ((f"spdx license identifier {x.replace('-', ' ').replace('.', ' ')}", label) for x, label in named)]


_TABLE = bytearray(b" " * 128 + bytes(range(128, 256)))
_TABLE[0x30:0x3A] = bytes(range(0x30, 0x3A))
_TABLE[0x61:0x7B] = _TABLE[0x41:0x5B] = bytes(range(0x61, 0x7B))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII digits, ASCII letters in lower case, and all other letters and signs beyond ASCII."""
    return (text or "").encode().translate(bytes(_TABLE)).split()


_WORDINGS = [(label, words_of(wording), [words_of(p) for p in phrases]) for label, wording, phrases in TEMPLATES + _spdx()]
_PHRASES = {label: words_of(phrase) for phrase, label in BASE.items()}


def inverse_frequencies(docs: DataFrame) -> dict[bytes, float]:
    """log((documents + 1) / (documents with the word + 1)) of each template word, over all documents."""
    wanted = {w for _, wording, _ in _WORDINGS for w in wording}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            found[b""] += b.num_rows
            for text in b.column("text"):
                found.update(wanted.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r.word): r.n for r in rows}
    return {w: log((found.get(b"", 0) + 1) / (found.get(w, 0) + 1)) for w in wanted}


def needed(n: int) -> int:
    """Words of a wording of n that make a match."""
    return ceil(ALIKE * n - 1e-9)


def aligned(wording: list[bytes], words: list[bytes], start: int) -> int:
    """Longest common subsequence of wording and words where word i of it stands at start + i to start + i + SLACK."""
    best, most = [0] * (SLACK + 1), len(words)
    for i, w in enumerate(wording):
        row, left = [], 0
        for k in range(SLACK + 1):
            at = start + i + k
            left = max(left, best[k] + (0 <= at < most and words[at] == w), best[k + 1] if k < SLACK else 0)
            row.append(left)
        best = row
    return best[-1]


class Index:
    """Postings of the templates' rarest places: word -> [(number of the template, place in it)]."""

    def __init__(self, idf: dict[bytes, float]):
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, wording, _) in enumerate(_WORDINGS):
            rarest = sorted(range(len(wording)), key=lambda i: (-idf.get(wording[i], 0.0), wording[i], i))
            for i in rarest[: len(wording) - needed(len(wording)) + 2]:
                self.postings[wording[i]].append((t, i))
        self.listed = self.postings.keys() | {w for phrase in _PHRASES.values() for w in phrase}

    def _starts(self, named: list[tuple[int, int]], places: int) -> set[int]:
        """Starts of the bands in which two places' named starts lie. named: (start, place in the wording)."""
        named.sort()
        found: set[int] = set()
        for k, (a, i) in enumerate(named):
            for b, j in named[k + 1 : k + 1 + (SLACK + 1) * places]:
                if b - a > SLACK:
                    break
                if i != j:
                    found.update(range(b - SLACK, a + 1))
        return found

    def scan(self, text: str | None) -> tuple[int, list[int], set[str], set[str], float]:
        """Number of words, the base phrases' places, base labels, all labels, score."""
        words = words_of(text)
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.listed:
                places[w].append(i)
        if not places:
            return len(words), [], set(), set(), 0.0
        starts, base = [], set()
        for label, phrase in _PHRASES.items():
            own = set(places.get(phrase[0], ()))
            for k, w in enumerate(phrase[1:], 1):
                own &= {p - k for p in places.get(w, ())} if own else own
            if own:
                base.add(label)
                starts += own
        labels, score = set(base), 1.0 if base else 0.0
        named: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for word, at in places.items():
            for t, i in self.postings.get(word, ()):
                named[t] += [(p - i, i) for p in at]
        for t, own in named.items():
            label, wording, phrases = _WORDINGS[t]
            for start in self._starts(own, len(wording)) if len(own) > 1 else ():
                alike = aligned(wording, words, start)
                if alike >= needed(len(wording)):
                    window = words[max(0, start) : start + len(wording) + SLACK]
                    if all(any(window[i : i + len(p)] == p for i in range(len(window))) for p in phrases):
                        labels.add(label)
                        score = max(score, alike / len(wording))
        return len(words), starts, base, labels, score


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a template's words that a match holds (1 for a base phrase, 0 without any). Null and empty
    texts have no words, no labels and score 0; first_word and last_word are null without a base phrase. Repeated rows
    each give a row, null ids stay null, other columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    idf = inverse_frequencies(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf)
        for b in batches:
            got = [index.scan(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([len(g[1]) for g in got], pa.int64()),
                pa.array([min(g[1], default=None) for g in got], pa.int64()), pa.array([max(g[1], default=None) for g in got], pa.int64()),
                pa.array([",".join(sorted(g[2])) for g in got], pa.string()), pa.array([",".join(sorted(g[3])) for g in got], pa.string()), pa.array([float(g[4]) for g in got], pa.float64()),
            ], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


QUERIES = {"op10_license_scan": lambda spark, sf_dir: scan_licences(table(spark, sf_dir, "documents"))}
ORACLES: dict = {}
