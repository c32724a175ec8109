from pyspark.sql import functions as F

from utterlake import sql
from utterlake.functions import text as T
from utterlake.operators import rates
from utterlake.streaming import incremental

TEXTS = ["One. Two! Three", "", None, "  a\x1cb  ", "नमस्ते दुनिया। फिर?", "mixed नम text", "नम abcd", "ক খ", "a।b. " * 200, "x" * 800 + ". " + "y" * 10, "100% & more @ home", "<|bicodec_global_7|><|bicodec_global_12|>", "…  z"]


def test_sql_functions_are_the_columns(spark):
    sql.register(spark)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    pairs = {
        "clean(t)": T.clean(F.col("t")), "script(t)": T.script(F.col("t")), "split_sentences(t)": T.sentences(F.col("t")), "hash32(t)": T.hash32(F.col("t")), "train_prompt(t)": T.train_prompt(F.col("t")),
        "parse_tokens(t, 'global')": T.parse_tokens(F.col("t"), "global"), "symbols_said(t, 'en')": T.replace_symbols(F.col("t")), "symbols_said(t, 'hi')": T.replace_symbols(F.col("t"), "hi"),
        "script_scheme(script(t))": T.scheme(T.script(F.col("t"))), "render_tokens(array(i), 'semantic')": T.render_tokens(F.array("i"), "semantic"), "language_dir(t)": T.language_dir(F.col("t")),
        "lang_of_path(concat('a/', t, '/c'), 'a')": T.lang_of_path(F.concat(F.lit("a/"), "t", F.lit("/c")), "a"),
    }
    for text, column in pairs.items():
        for r in rows.select(F.expr(text).alias("a"), column.alias("b")).collect():
            assert r.a == r.b, (text, r)


def test_chunks_in_sql(spark):
    sql.register(spark, "my_")
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = spark.sql("SELECT i, c.* FROM {rows}, LATERAL my_chunks(t) c", rows=rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows.select("i", F.posexplode(T.chunked(F.col("t")))).collect()))
    few = spark.sql("SELECT i, c.* FROM {rows}, LATERAL my_chunks(t, 50) c", rows=rows).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, rows.select("i", F.posexplode(T.chunked(F.col("t"), 50))).collect()))


def test_rates_of_batches_and_streams(spark, tmp_path):
    spark.range(100).write.parquet(f"file://{tmp_path}/in")
    odd = F.when(F.col("id") % 4 == 0, "fourth")
    with rates.Rates(spark) as seen:
        rates.watched(spark.range(10), "ten", odd).write.format("noop").mode("overwrite").save()
        rates.watched(spark.range(6), "six").collect()
        spark.range(5).collect()  # not watched
        stream = rates.watched(incremental.files_of(spark, f"file://{tmp_path}/in"), "stream", odd)
        stream.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        got = {(r.name, r.kind): r for r in seen.table().collect() if r.rows}
    assert {k: (r.rows, r.errors) for k, r in got.items()} == {("ten", "batch"): (10, 3), ("six", "batch"): (6, 0), ("stream", "stream"): (100, 25)}
    assert all(r.seconds > 0 and abs(r.rows_per_second - r.rows / r.seconds) < 1e-6 for r in got.values()) and got["stream", "stream"].batch == 0
    rates.watched(spark.range(7), "after").collect()
    assert ("after", "batch") not in {(r.name, r.kind) for r in seen.table().collect()}
