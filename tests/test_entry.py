import shutil
from pathlib import Path

import __spark_entry__ as entry
from utterlake.streaming import incremental


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_chunks(spark):
    assert entry.entry(spark).columns == ["doc_id", "chunk_no", "chunk"]


def test_nothing_outside_llm_imports_it():
    root = Path(entry.__file__).parent
    for path in [*(root / "utterlake").rglob("*.py"), *(root / "tests").glob("*.py")]:
        if "llm" not in path.parts and path.name != "test_entry.py":
            assert "utterlake.llm" not in path.read_text(), path


def test_stream_takes_each_file_once(spark, tmp_path):
    source, out, state = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    work = lambda df: df.select("id")
    spark.range(5).write.parquet(f"{source}/a")
    spark.range(100, 120).write.parquet(f"{source}2/a")  # a folder whose name only begins like the source's
    assert incremental.run_available(spark, source, work, "id", out, state).count() == 5
    shutil.rmtree(tmp_path / "state" / "commits")  # the first batch was written, its commit is lost
    assert incremental.run_available(spark, source, work, "id", out, state).count() == 5
    spark.range(3, 8).union(spark.range(6, 8)).write.parquet(f"{source}/b")
    assert sorted(r.id for r in incremental.run_available(spark, source, work, "id", out, state).collect()) == list(range(8))
    shutil.rmtree(tmp_path / "state")  # all state is lost
    assert incremental.run_available(spark, source, work, "id", out, state).count() == 8


def test_stream_of_a_single_file(spark, tmp_path):
    spark.range(4).coalesce(1).write.parquet(f"file://{tmp_path}/made")
    part = next((tmp_path / "made").glob("part-*.parquet"))
    for name in ("one.parquet", "one.parquet.old.parquet"):
        shutil.copy(part, tmp_path / name)
    assert incremental.run_available(spark, f"file://{tmp_path}/one.parquet", lambda df: df, "id").count() == 4
