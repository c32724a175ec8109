import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlake import api
from utterlake.functions import spoken
from utterlake.operators import scoring
from utterlake.sources import sinks, transcripts, wav


def stereo(bits, tag=1):
    left, right = np.array([0.5, -0.5, 0.25]), np.array([0.5, 0.5, -0.25])
    flat = np.stack([left, right], 1).ravel()
    if tag == 3:
        body = flat.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        body = (flat * 128 + 128).astype(np.uint8).tobytes()
    else:
        body = b"".join(int(x * 2 ** (bits - 1)).to_bytes(bits // 8, "little", signed=True) for x in flat)
    form = struct.pack("<HHIIHH", tag, 2, 8000, 0, bits // 4, bits)
    return b"RIFF\0\0\0\0WAVELIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize(("bits", "tag"), [(8, 1), (16, 1), (24, 1), (32, 1), (32, 3), (64, 3)])
def test_formats_decode_to_mono(bits, tag):
    wave, rate = wav.decode(stereo(bits, tag))
    assert rate == 8000 and wave.tolist() == [0.5, 0.0, 0.0]


def test_damaged_files_become_errors(spark):
    good = wav.encode(np.array([0.0, 1.0, -2.0, np.nan]), 4)
    rows = [(0, good), (1, b""), (2, None), (3, b"RIFFxxxxWAVE"), (4, good[:-3]), (5, b"no wave at all" * 9)]
    got = {r.k: r for r in wav.decoded(spark.createDataFrame(rows, "k int, content binary"), "k").collect()}
    assert got[0].seconds == 1.0 and got[0].wave[1] == pytest.approx(1, abs=1e-4) and got[0].wave[3] == 0
    assert all(got[i].error and got[i].wave is None for i in (1, 2, 3, 5)) and len(got[4].wave) == 2
    flags = spark.createDataFrame(rows, "k int, content binary").select(wav.valid(F.col("content")).alias("v")).collect()
    assert [r.v for r in flags] == [True, False, False, False, True, False]
    assert wav.decoded(spark.createDataFrame(rows, "k int, content binary"), "k", samples=False).where("wave IS NOT NULL").count() == 0


def test_folders_of_wav_files(spark, tmp_path):
    for lang, data, speaker, name in (("hi", "D", "P_a", "1"), ("hi", "D", "P_b", "2"), ("kn", "E", "P_c", "3"), ("kn", "D", "Q_d", "4")):
        folder = tmp_path / lang / data / speaker / "wav"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.wav").write_bytes(wav.encode(np.zeros(8), 16))
    files = wav.located(wav.wav_files(spark, f"file://{tmp_path}"), "P_", "D")
    assert sorted((r.id, r.speaker, r.lang) for r in files.collect()) == [("1", "P_a", "hi"), ("2", "P_b", "hi")]
    assert [r.id for r in wav.located(wav.wav_files(spark, f"file://{tmp_path}"), "P_", "D", "b").collect()] == ["2"]
    assert {r.seconds for r in wav.decoded(files, "id", samples=False).collect()} == {0.5}


def test_transcripts(spark, tmp_path):
    for folder, name, entries in (("a", "x_Transcripts.json", {"1": "old", "2": "two"}), ("a", "y_Transcripts.json", {"1": "new"}), ("b", "z_Transcripts.json", {"1": "other"})):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps({"Transcripts": {k: {"Transcript": v, "Domain": "d"} for k, v in entries.items()}}, indent=1))
    (tmp_path / "b" / "bad_Transcripts.json").write_text("{ nothing")
    (tmp_path / "b" / "other.json").write_text("{}")
    got = transcripts.read_transcripts(spark, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, got)) == [("a", "1", "new", "d"), ("a", "2", "two", "d"), ("b", "1", "other", "d")]
    assert transcripts.read_transcripts(spark, f"file://{tmp_path}", nested=False).count() == 0


def test_sinks(spark, tmp_path):
    df, at = spark.createDataFrame([("b",), ("a",), ("é",)], "t string"), f"file://{tmp_path}/"
    assert not sinks.save_manifest(df, at + "m", 5) and not (tmp_path / "m").exists() and sinks.save_manifest(df, at + "m")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.save_new(df, at + "m")
    sinks.save_corpus(df, "t", at + "c", 1)
    assert next((tmp_path / "c").glob("part-*")).read_text() == "a\nb\né\n"


def test_shards_and_flat_cache(spark, tmp_path):
    at = f"file://{tmp_path}/shards"
    assert sinks.next_shard(spark, at) == 0
    assert sinks.append_shards(spark.range(10), at, ["id"], 4) == 3 and sinks.append_shards(spark.range(20, 25), at, ["id"], 4) == 5
    (tmp_path / "shards" / "shard=000011").mkdir()
    assert sinks.next_shard(spark, at) == 12
    got = {}
    for r in sinks.read_shards(spark, at).collect():
        got.setdefault(r.shard, []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9], 3: [20, 21, 22, 23], 4: [24]}
    flat = f"file://{tmp_path}/flat"
    for rows in ([("a", 1), ("b", 2)], [("b", 9), ("c", 3)]):
        sinks.save_flat_cache(spark.createDataFrame(rows, "k string, v int"), flat, "k")
    assert {(r.k, r.v) for r in sinks.read_swapped(spark, flat).collect()} == {("a", 1), ("b", 2), ("c", 3)}


def _broken(*args):
    raise OSError("the driver is lost")


def test_a_lost_driver_leaves_the_former_table(spark, tmp_path, monkeypatch):
    flat, rows = f"file://{tmp_path}/flat", lambda *x: spark.createDataFrame(x, "k string, v int")
    got = lambda: {(r.k, r.v) for r in sinks.read_swapped(spark, flat).collect()}
    assert sinks.read_swapped(spark, flat) is None
    sinks.save_flat_cache(rows(("a", 1)), flat, "k")
    with monkeypatch.context() as m:
        m.setattr(sinks, "write_text", _broken)  # the new version is written, the pointer to it is not
        with pytest.raises(OSError):
            sinks.save_flat_cache(rows(("b", 2)), flat, "k")
    assert got() == {("a", 1)}
    sinks.save_flat_cache(rows(("b", 2)), flat, "k")
    assert got() == {("a", 1), ("b", 2)}
    sinks.save_manifest(rows(("c", 3)), flat)
    assert got() == {("c", 3)} and len([x for x in (tmp_path / "flat").iterdir() if x.name.startswith("version=")]) == 2
    spark.createDataFrame([("old", 1)], "k string, v int").write.parquet(f"file://{tmp_path}/plain")
    sinks.save_flat_cache(rows(("new", 2)), f"file://{tmp_path}/plain", "k")
    assert sinks.read_swapped(spark, f"file://{tmp_path}/plain").count() == 2


def test_an_append_that_is_repeated_adds_nothing(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/shards"
    ids = lambda: sorted((r.shard, r.id) for r in sinks.read_shards(spark, at).collect())
    sinks.append_shards(spark.range(5), at, ["id"], 2, token="one")
    assert sinks.append_shards(spark.range(5), at, ["id"], 2, token="one") == 3 and len(ids()) == 5
    moves, rename = [], sinks.rename

    def two_moves(*args):
        if len(moves) == 2:
            _broken()
        moves.append(args)
        rename(*args)

    for broken in ("write_text", "rename"):  # lost before a shard is moved in, and between two of them
        with monkeypatch.context() as m:
            m.setattr(sinks, broken, _broken if broken == "write_text" else two_moves)
            with pytest.raises(OSError):
                sinks.append_shards(spark.range(10, 18), at, ["id"], 2, token="two")
        assert len(ids()) == 5 + 2 * len(moves)
    assert sinks.append_shards(spark.range(10, 18), at, ["id"], 2, token="two") == 7
    assert ids() == [(i // 2, i) for i in range(5)] + [(3 + i // 2, 10 + i) for i in range(8)]
    assert sinks.append_shards(spark.range(20, 21), at, ["id"], 2) == 8


def test_train_and_clone(spark, tmp_path):
    files = wav.encoded(spark.createDataFrame([("a", [0.25] * 40), ("b", [0.5] * 40)], "audio_path string, w array<double>"), "audio_path", "w", 16000).union(spark.createDataFrame([("bad", b"RIFF")], "audio_path string, content binary"))
    manifest = spark.createDataFrame([("a", "one"), ("b", "two"), ("bad", "three"), ("gone", "four")], "audio_path string, text string")
    got = {r.audio_path: r for r in api.train(manifest, files).collect()}
    assert got["a"].prompt == "<|task_tts|><|start_content|>one<|end_content|>" and got["a"].completion.startswith("<|start_global_token|><|bicodec_global_25") and got["a"].error is None
    assert got["bad"].completion is None and got["bad"].error and got["gone"].error == "no file"
    assert {r.audio_path for r in api.train(manifest, files, cache=manifest.where("audio_path = 'a'"), limit=2).collect()} == {"b"}
    asked = spark.createDataFrame([(1, "a", "hello  you"), (2, "bad", "x")], "id int, voice string, text string")
    prompts = {r.id: r.prompt for r in api.clone(asked, files.withColumnRenamed("audio_path", "voice"), "id", "voice").collect()}
    assert prompts[2] is None and prompts[1].startswith("<|task_tts|><|start_content|>hello you<|end_content|><|start_global_token|><|bicodec_global_") and prompts[1].endswith("<|start_semantic_token|>")
    assert api.infer(spark.createDataFrame([(1, "hi")], "id int, text string"), "id").first().content[:4] == b"RIFF"


@pytest.mark.parametrize(("number", "words"), [
    ("0", "zero"), ("-7", "minus seven"), ("19", "nineteen"), ("100", "one hundred"), ("999", "nine hundred ninety nine"), ("1000", "one thousand"), ("20030", "twenty thousand thirty"),
    ("1000000001", "one billion one"), ("3.05", "three point zero five"), ("007", "seven"), ("1" * 16, "1" * 16), ("५", "५"),
])
def test_numbers(spark, number, words):
    assert spark.createDataFrame([(f"a {number} b",)], "x string").select(spoken.verbalised(F.col("x")).alias("y")).first().y == f"a {words} b"


def test_plug_ins(spark):
    rows = spark.createDataFrame([("I ate 2 BIG apples",), (None,)], "x string")

    def mapper(word, lang):
        if word == "big":
            raise ValueError
        return f"<{lang}:{word}>"

    got = [r.y for r in rows.select(spoken.processed(F.col("x"), "hi", spoken.english_number, mapper).alias("y")).collect()]
    assert got == ["I <hi:ate> two B I G <hi:apples>", None]
    assert [r.y for r in rows.select(spoken.processed(F.col("x")).alias("y")).collect()] == ["I ate 2 B I G apples", None]


def test_batches_are_halved_and_bad_rows_stand_alone():
    sizes = []

    def scorer(items):
        sizes.append(len(items))
        if len(items) > 3:
            raise MemoryError
        if 5 in items:
            raise ValueError("five")
        return [x * 2 for x in items]

    got = scoring.in_batches(scorer, list(range(10)), 8)
    assert [r for r, _ in got] == [0, 2, 4, 6, 8, None, 12, 14, 16, 18] and got[5][1] == "ValueError: five" and max(sizes) == 8


def test_scored_and_spoken(spark):
    waves = spark.createDataFrame([(1, [0.0, 0.5]), (2, None)], "k int, w array<double>")
    got = {r.k: r for r in scoring.scored(waves, "k", "w").collect()}
    assert got[1].semantic_ids == [4096, 6144] and got[1].error is None and got[2].error
    texts = spark.createDataFrame([(1, "Short."), (2, "A sentence of some length. " * 40), (3, ""), (4, None)], "k int, t string")
    files = {r.k: r.content for r in scoring.synthesised(texts, "k", "t", overlap_ms=1).collect()}
    assert files[3] is None and files[4] is None and wav.decode(bytes(files[1]))[0].size == 24 and wav.decode(bytes(files[2]))[0].size > 4000
