import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlake.sources import wav, wav_headers


def listed(spark, root, **options):
    return {r.path.rsplit("/", 1)[1]: r for r in wav_headers.wav_headers(spark, f"file://{root}", **options).collect()}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("wavs")
    good = wav.encode(np.zeros(1600), 16000)
    big = wav.encode(np.zeros(8_000_000), 16000)
    head, body = good[:36], good[36:]
    listing = struct.pack("<4sI", b"LIST", 300_000) + b"x" * 300_000
    (root / "hi/spk/wav").mkdir(parents=True)
    (root / "empty-folder").mkdir()
    for name, raw in {"good.wav": good, "big.wav": big, "none.wav": b"", "cut.wav": good[:30], "text.wav": b"no sound " * 9, "short.wav": good[:-200], "late.wav": head + listing + body, "UP.WAV": good, "other.txt": good}.items():
        (root / name).write_bytes(raw)
    (root / "hi/spk/wav/deep.wav").write_bytes(good)
    return root


@pytest.mark.parametrize("options", [{}, {"depth": 0}, {"depth": 3, "shares": 1}])
def test_each_file_is_listed_once_at_any_depth(spark, folder, options):
    rows = wav_headers.wav_headers(spark, f"file://{folder}", **options).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows) == sorted(["good.wav", "big.wav", "none.wav", "cut.wav", "text.wav", "short.wav", "late.wav", "UP.WAV", "deep.wav"])


def test_only_heads_are_read(spark, folder):
    got = listed(spark, folder)
    assert got["big.wav"].length > 15_000_000 and got["big.wav"].seconds == 500 and got["big.wav"].read_bytes <= 1024
    assert got["late.wav"].seconds == 0.1 and got["late.wav"].read_bytes <= 2048
    assert (got["good.wav"].rate, got["good.wav"].channels, got["good.wav"].bits, got["good.wav"].error) == (16000, 1, 16, None)


def test_damaged_files_have_no_seconds(spark, folder):
    got = listed(spark, folder)
    assert {n: (r.seconds, r.error) for n, r in got.items() if r.error} == {"none.wav": (None, "empty"), "cut.wav": (None, "no samples"), "text.wav": (None, "no RIFF/WAVE header")}
    assert got["short.wav"].seconds == pytest.approx(1500 / 16000)


def test_a_file_that_cannot_be_opened_is_a_row(tmp_path):
    import pyarrow.fs

    info = pyarrow.fs.FileInfo(f"{tmp_path}/gone.wav", type=pyarrow.fs.FileType.File, size=99)
    row = wav_headers.describe(pyarrow.fs.LocalFileSystem(), info)
    assert row["error"] and "seconds" not in row


def test_headers_agree_with_whole_files(spark, folder):
    whole = {r.path.rsplit("/", 1)[1]: (r.seconds, r.rate) for r in wav.decoded(wav.wav_files(spark, f"file://{folder}"), "path", samples=False).collect()}
    assert {n: (r.seconds, r.rate) for n, r in listed(spark, folder).items() if n in whole} == whole


def test_saved_files_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, [0.5] * i) for i in range(1, 6)] + [(None, [0.1]), (9, None)], "id long, w array<double>")
    files = wav.encoded(rows, "id", "w", 8000)
    names = wav.save_files(files, f"file://{tmp_path}/out", F.col("id")).collect()
    wav.save_files(files, f"file://{tmp_path}/out", F.col("id"))  # a second time leaves the same files
    assert sorted(r.path.rsplit("/", 1)[1] for r in names) == [f"{i}.wav" for i in range(1, 6)] == sorted(p.name for p in (tmp_path / "out").iterdir())
    assert {n: r.seconds for n, r in listed(spark, tmp_path / "out").items()} == {f"{i}.wav": i / 8000 for i in range(1, 6)}
