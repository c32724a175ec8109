import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tests.llm.cases import ODD, none, odd
from utterlake.llm import token_files as tf
from utterlake.runtime import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Hello,\nworld's   two  blanks\t\tand \n lines \n", " lead", "trail ", "a\n b", "a \nb", "é»x 日本 naïve, ½² x2 don't we'LL", "a\x1cb c\u0085d", "<|endoftext|> in a text", "", "\n", " ", "\n\n", "x_y_z a_b",
    "Abc*** (def) ghi!? ́x áb 12345 3.14", "\ta b", "a \x00b", "Él, ñu\nÜber",
    "a b\x00", "\nab\x7f c", " word\x01. \x02", "é \x1bx\x1b",
]


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_are_the_library_s(library):
    own, rng = tf.ByteBpe(PATH), random.Random(4)
    settled = [chr(c) for c in range(0x482) if tf._SETTLED.fullmatch(chr(c))]
    texts = TEXTS + ["".join(rng.choices("ab \n.,é'1\t ", k=40)) for _ in range(400)] + [before + c + after for c in settled for before, after in (("a", "b"), (" ", " "), ("1", "."))]
    texts += ["".join(rng.choices(settled, k=60)) for _ in range(2000)] + [" ".join("".join(rng.choices(settled, k=rng.randint(1, 5))) for _ in range(20)) for _ in range(500)]
    texts += ["ab" * 3000, "x" * 2500 + " end", "Word " * 30000, "日本" * 1200, " " * 2_000_000 + "a\n", "\n" * 999 + "b " * 5]
    assert own.plain and own.any
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_dictionary_of_few_documents_and_of_all_of_a_long_one(spark):
    few = tf.train_dictionary(spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string"), PATH, 2)
    assert few
    assert tf._blocks(b"x" * 20000) == [b"x" * 8192, b"x" * 8192, b"x" * 3616]
    spread = tf._blocks(b"".join(i.to_bytes(4, "little") * 2048 for i in range(50)))
    assert len(spread) == 8 and spread[0][0] == 0 and spread[-1][0] == 49


def test_file_gives_back_single_documents_and_refuses_damage(tmp_path):
    words = tf.byte_bpe(PATH)
    docs = [*words.encode(["some text of many words " * n for n in range(60)])]
    uri = f"file://{tmp_path}/a.ids"
    w = tf.Writer(uri, b"", 2)
    for i, ids in enumerate(docs):
        w.add(None if i == 3 else i, ids)
    assert not (tmp_path / "a.ids").exists()
    w.close()
    r = tf.Reader(uri, b"")
    assert all(r.ids(i).tobytes() == docs[i] for i in (59, 0, 30, 3)) and r.index["null"].tolist().index(True) == 3
    with pytest.raises(ValueError, match="another dictionary"):
        tf.Reader(uri, b"x")
    raw = (tmp_path / "a.ids").read_bytes()
    (tmp_path / "b.ids").write_bytes(raw[:-40] + bytes([raw[-40] ^ 1]) + raw[-39:])
    with pytest.raises(ValueError, match="damaged"):
        tf.Reader(f"file://{tmp_path}/b.ids", b"")


def test_round_trip(spark, library):
    rng = random.Random(7)
    rows = [(i * 3, " ".join(rng.choices(["the", "cat", "sat", "on", "mats", "é", "x1"], k=rng.randint(0, 200)))) for i in range(300)]
    got = sorted(tf.token_file_round_trip(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect())
    start = 0
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    folder = scratch_path(spark, "t")
    tf.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), folder)
    assert len(tf._filesystem(folder)[0].open_input_stream(tf._filesystem(folder)[1] + "/dictionary.zstd").read()) > 100


def test_files_of_other_attempts_do_not_count(spark, tmp_path):
    folder = f"file://{tmp_path}/ids"
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").repartition(3)
    files = tf.write_token_files(docs, folder)
    before = sorted(map(tuple, tf.read_token_files(spark, folder).collect()))
    first = tmp_path / "ids" / files[0][0]
    first.with_name("part-000000-999999.ids").write_bytes(first.read_bytes())
    first.with_name("part-000001-999999.ids.part").write_bytes(b"half")
    assert tf.listed_files(folder) == files and sum(n for _, n, _ in files) == 40
    assert sorted(map(tuple, tf.read_token_files(spark, folder).collect())) == before and len(before) == 40


def test_odd_rows(spark):
    got = tf.token_file_round_trip(spark, odd(spark)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in ODD), key=lambda x: -1 if x is None else x)
    assert [r.n_tokens for r in got if r.doc_id in (3, 4)] == [1, 1]
    assert tf.token_file_round_trip(spark, none(spark)).collect() == []
