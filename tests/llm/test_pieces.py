import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tests.llm.cases import ODD, none, odd
from utterlake.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["abcdefghij ", "the of and ing ", "▁ ▁▁ab", "  a", "aab ", "=-_*# \n\t", "0123456789 ,.", "日本語の文字列を分割する", "éèüöß ", "नमस्ते दुनिया", "😀👍🏽‍\x00퟿", "안녕하세요 세계"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.PieceBpe(PATH)


def _same(own, library, texts):
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_eos=True), ascii(text)
        assert own.decode(ids).decode() == library.decode(ids.tolist()), ascii(text)


def test_any_texts_match_the_library(own, library):
    rng = random.Random(5)
    known = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = ["".join(rng.choice(rng.choice(SIGNS) if k % 3 == 0 else known) for _ in range(rng.choice([1, 4, 20, 90]))) for k in range(2500)]
    texts += ["".join(rng.choices(rng.choice(SIGNS), k=rng.choice([3, 30, 200]))) for _ in range(1500)]
    _same(own, library, ["", " ", "<s> </s> <unk> <0x41>", *texts])


def test_runs_of_one_sign_match_the_library(own, library):
    _same(own, library, [c * n + tail for c in "a =-▁e\n" for n in (*range(1, 40), 63, 64, 65, 79, 80, 81, 200, 1001) for tail in ("", "the", " x")])


def test_long_words_match_the_library(own, library):
    rng = random.Random(6)
    _same(own, library, ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=30000)), "ab" * 20000, "the" * 9000, "漢字" * 9000])


def test_pairs_wait_for_a_better_one_before_them(monkeypatch):
    """Merging both pairs of rank 5 at once would lose the pair of rank 3 that the first of them makes."""
    plain = pieces.PieceBpe.__new__(pieces.PieceBpe)
    a, b, ab, aba = 0, 1, 2, 3
    plain.pairs = pieces.Pairs({(a, b): (5, ab), (ab, a): (3, aba)})
    _, left = plain._rounds(np.arange(4), np.array([a, b, a, b], np.int32), np.zeros(4, np.int64))
    assert left.tolist() == [aba, b]


def test_any_ids_decode_as_the_library_does(own, library):
    rng = random.Random(7)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(3), 28705]) for _ in range(rng.randrange(8))]
        assert own.decode(np.array(ids)).decode() == library.decode(ids), ids


def test_table_stays_bounded(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 10)
    own = pieces.PieceBpe(PATH)
    for _ in range(3):
        own.encode(["many different words " + " ".join(map(str, range(50)))])
        assert len(own.seen) < 80


def test_other_models_are_refused(tmp_path):
    model = pieces.proto.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.PieceBpe(str(tmp_path / "other.model"))


def test_odd_rows(spark, library):
    got = pieces.encode_decode(odd(spark), outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == len(ODD)
    texts = {d: t for d, t, *_ in ODD}
    for r in got:
        want = library.encode(texts[r.doc_id] or "", add_eos=True)
        assert (r.ids, r.n_tokens, r.decoded) == (want, len(want), library.decode(want))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert pieces.encode_decode(none(spark)).collect() == []
