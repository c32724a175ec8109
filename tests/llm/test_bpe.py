import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest

from tests.llm.cases import ODD, none, odd
from utterlake.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello<|endoftext|>World <|startoftext|>x", "\x1c a\x1db", "ΟΔΥΣΣΕΥΣ Σ", "İstanbul ẞ", "á école ́", "it's we'll I'D don't 's's'", "日本語 テスト ½ ² x²",
    "😀👍🏽 test😀", "a b c​d\u0085e", "x" * 500 + " " + "ab" * 300, "ﬁ ﬀ १२३", "\x00\x01", "<|", "1234 a1b2", "", " ",
    "a\U000190b5\u23cd b", "\u1c89x \ua7cb\u0301", "x\u088f \U00010ee6", "H\u0331 \u200dE\u0301", "\U00012550 1\U00011de0",
]


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_ids_and_decoded_text_match_the_library(library):
    own = bpe.WordBpe(PATH)
    for text, ids in zip(TEXTS, own.encode(TEXTS), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False), text


def test_any_signs_match_the_library(library):
    own, rng = bpe.WordBpe(PATH), random.Random(11)
    texts = ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(3000)]
    for text, ids, want in zip(texts, own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, ascii(text)


def test_both_trees_agree(library):
    own, rng = bpe.WordBpe(PATH), random.Random(2)
    words = ["".join(rng.choices("theandrsing", k=rng.randint(1, 64))) for _ in range(500)] + ["a" * 64, "e" * 63]
    own._merge_words(words)
    for w in words:
        ids = own.byte_ids[list(w.encode())].tolist()
        ids[-1] = int(own.end_ids[ord(w[-1])])
        assert own.merges.one(ids) == np.frombuffer(own.seen[w], "<u4").tolist()


def test_tables_stay_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 10)
    own = bpe.WordBpe(PATH)
    for _ in range(3):
        assert np.frombuffer(own.encode(["many different words " + " ".join(map(str, range(50)))])[0], "<u4").size > 50


def test_odd_rows(spark, library):
    got = bpe.encode_decode(odd(spark), outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == len(ODD)
    texts = {d: t for d, t, *_ in ODD}
    for r in got:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_decode(none(spark)).collect() == []
