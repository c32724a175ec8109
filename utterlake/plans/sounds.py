"""Queries over WAV files and waves."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterlake.operators import batches
from utterlake.plans.catalogue import query
from utterlake.runtime import numbered, scratch_path, table
from utterlake.sources import pruned, wav, wav_headers

#: Every fifth file has no bytes, every other fifth is cut within its header, another lacks its last samples.
_STATE = "CASE vec_id % 5 WHEN 1 THEN 'empty' WHEN 2 THEN 'cut' WHEN 3 THEN 'short' ELSE 'whole' END"


@query(f"""WITH f AS (SELECT vec_id, {_STATE} AS state, len(embedding) AS n FROM embeddings)
SELECT vec_id, CASE state WHEN 'whole' THEN n / 16000 WHEN 'short' THEN (n - 4) / 16000 END AS seconds, CASE WHEN state IN ('whole', 'short') THEN 16000 END AS rate,
 CASE state WHEN 'empty' THEN 'empty' WHEN 'cut' THEN 'no samples' END AS error, true AS few_bytes FROM f""")
def wav_header_scan(spark, d):
    """Durations of a folder of files, damaged ones among them, from their headers alone."""
    files = wav.encoded(table(spark, d, "embeddings"), "vec_id", "embedding", 16000)
    c, state = F.col("content"), F.expr(_STATE)
    left = F.when(state == "empty", F.substring(c, 1, 0)).when(state == "cut", F.substring(c, 1, 30)).when(state == "short", F.substring(c, F.lit(1), F.length(c) - 8)).otherwise(c)
    folder = scratch_path(spark, "wavs")
    wav.save_files(files.withColumn("content", left), folder, F.col("vec_id"))
    seen = wav_headers.wav_headers(spark, folder)
    return seen.select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).cast("long").alias("vec_id"), "seconds", "rate", "error", (F.col("read_bytes") <= 1024).alias("few_bytes"))


_BUDGET = 100_000
_PACKED = f"""l AS (SELECT doc_id, greatest(coalesce(n_chars, 0), 0) AS n FROM documents), w AS (SELECT greatest(1, CAST(ceil(max(n) / {batches.BINS}) AS BIGINT)) AS width FROM l),
 h AS (SELECT CAST(ceil(n / width) AS BIGINT) AS bin, count(*) AS c, CAST(sum(n) AS BIGINT) AS s FROM l, w GROUP BY 1),
 k AS (SELECT bin, c, least({batches.BUCKETS - 1}, {batches.BUCKETS} * coalesce(CAST(sum(s) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) // greatest(1, (SELECT CAST(sum(n) AS BIGINT) FROM l))) AS b FROM h),
 u AS (SELECT b, CAST(sum(c) AS BIGINT) AS c, greatest(1, {_BUDGET} // greatest(1, max(bin) * any_value(width))) AS cap FROM k, w GROUP BY 1),
 o AS (SELECT b, cap, coalesce(CAST(sum((c + cap - 1) // cap) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM u),
 p AS (SELECT doc_id, n, start + (row_number() OVER (PARTITION BY b ORDER BY n, doc_id) - 1) // cap AS batch FROM l JOIN w ON true JOIN k ON k.bin = CAST(ceil(n / width) AS BIGINT) JOIN o USING (b))"""


@query(f"WITH {_PACKED} SELECT doc_id, batch FROM p")
def length_batches(spark, d):
    """Documents in batches of like length, under a budget of padded characters."""
    return batches.batched(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", _BUDGET).select("doc_id", "batch")


@query(f"""WITH {_PACKED}, q AS (SELECT n, (row_number() OVER (ORDER BY doc_id) - 1) // greatest(1, {_BUDGET} // (SELECT max(n) FROM l)) AS batch FROM l),
 f AS (SELECT 'by length' AS kind, batch, n FROM p UNION ALL SELECT 'as they come', batch, n FROM q), g AS (SELECT kind, batch, count(*) AS c, max(n) AS top, sum(n) AS s FROM f GROUP BY 1, 2)
SELECT kind, count(*) AS batches, CAST(sum(c) AS BIGINT) AS rows, round(1 - sum(s) / sum(c * top), 6) AS share FROM g GROUP BY 1""")
def batch_padding(spark, d):
    """The share of padding in batches of like length, and in batches of the same budget as rows come."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    most = docs.agg(F.max("n_chars")).first()[0]
    plain = numbered(docs, [], ["doc_id"], "at").withColumn("batch", F.floor(F.col("at") / max(1, _BUDGET // max(1, most or 1))))
    both = [batches.padding(b, "n_chars").withColumn("kind", F.lit(kind)) for kind, b in (("by length", batches.batched(docs, "doc_id", "n_chars", _BUDGET)), ("as they come", plain))]
    return both[0].unionByName(both[1]).select("kind", "batches", "rows", F.round("share", 6).alias("share"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def cache_probe(spark, d):
    """Wanted rows of a cache of small shards in the order of a hash, of which only those that may hold one are opened."""
    folder = scratch_path(spark, "indexed")
    cache = table(spark, d, "documents").select("doc_id", "source", F.md5(F.col("doc_id").cast("string")).alias("h"))
    pruned.append_indexed(cache, folder, ["h"], "doc_id", 256)
    return pruned.read_wanted(spark, folder, table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id")[0].select("doc_id", "source")
