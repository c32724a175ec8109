"""Queries over streams of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterlake import sql
from utterlake.operators import cutting, rates
from utterlake.plans import catalogue, registry
from utterlake.plans.catalogue import query
from utterlake.plans.registry import _clean
from utterlake.plans.words import _BLANKS, _heads, _heads_sql
from utterlake.runtime import numbered, scratch_path, table
from utterlake.streaming import incremental


@query(f"""WITH RECURSIVE v AS MATERIALIZED (SELECT piece, row_number() OVER (ORDER BY piece) - 1 AS id FROM ({_heads_sql('benchmark')})),
 e AS (SELECT doc_id, text IS NULL AS none, w, i FROM (SELECT doc_id, text, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, text, regexp_split_to_array(text, '{_BLANKS}') AS ws FROM documents)) WHERE w <> ''),
 ws AS MATERIALIZED (SELECT DISTINCT w FROM e),
 m AS MATERIALIZED (SELECT w, pos, arg_max(id, k) AS id, max(k) AS k FROM (SELECT w, pos, unnest(range(1, 5)) AS k FROM (SELECT w, unnest(range(1, length(w) + 1)) AS pos FROM ws)) JOIN v ON piece = substr(w, pos, k) AND pos + k <= length(w) + 1 GROUP BY 1, 2),
 c AS (SELECT w, CAST(1 AS BIGINT) AS pos, '' AS ids FROM ws UNION ALL SELECT c.w, c.pos + coalesce(m.k, 1), c.ids || ' ' || coalesce(CAST(m.id AS VARCHAR), '-') FROM c LEFT JOIN m ON m.w = c.w AND m.pos = c.pos WHERE c.pos <= length(c.w)),
 t AS (SELECT doc_id, string_agg(ids, '' ORDER BY i) AS ids FROM e JOIN (SELECT w, arg_max(ids, pos) AS ids FROM c GROUP BY 1) USING (w) GROUP BY 1)
SELECT d.doc_id, md5(trim(coalesce(t.ids, ''))) AS ids_md5 FROM documents d LEFT JOIN t USING (doc_id)""")
def incremental_tokenize(spark, d):
    """Token ids of every document by the pieces of another table, as a stream that takes each document once."""
    vocabulary = numbered(_heads(spark, d, "benchmark"), [], ["piece"], "id")
    ids = F.array_join(F.transform("ids", lambda i: F.coalesce(i.cast("string"), F.lit("-"))), " ")
    work = lambda docs: cutting.cut_texts(docs.select("doc_id", "text"), "text", vocabulary).select("doc_id", F.md5(F.coalesce(ids, F.lit(""))).alias("ids_md5"))
    return incremental.run_available(spark, f"{d}/documents.parquet", work, "doc_id")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, max(event_id) AS newest FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def event_windows(spark, d):
    """Events by type in windows of six hours, counted as a stream."""
    totals = {"n": F.count(F.lit(1)), "total": F.sum("value"), "newest": F.max("event_id")}
    got = incremental.windows(spark, f"{d}/events.parquet", "ts", "6 hours", ["event_type"], totals)
    return got.select("window_start", "event_type", "n", F.round("total", 4).alias("total"), "newest")


@query("SELECT kind, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (text IS NULL OR length(text) < 40) AS BIGINT) AS errors, true AS timed FROM documents, (SELECT unnest(['batch', 'stream']) AS kind) GROUP BY 1")
def run_rates(spark, d):
    """Rows, errors and rates of a batch and of a stream over the documents, as listeners tell them."""
    short = F.when(F.coalesce(F.length("text"), F.lit(0)) < 40, "short")
    with rates.Rates(spark) as seen:
        rates.watched(table(spark, d, "documents").select("text"), "documents", short).write.format("noop").mode("overwrite").save()
        stream = rates.watched(incremental.files_of(spark, f"{d}/documents.parquet").select("text"), "documents", short)
        stream.writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "rates")).trigger(availableNow=True).start().awaitTermination()
        found = seen.table().where("name = 'documents'")
    return found.groupBy("kind").agg(F.sum("rows").alias("rows"), F.sum("errors").alias("errors"), (F.max("rows_per_second") > 0).alias("timed"))


@query(catalogue.ORACLES["text_chunks"])
def sql_chunks(spark, d):
    """The chunks of all documents in plain SQL."""
    sql.register(spark, "ul_")
    return spark.sql("SELECT d.doc_id, c.chunk_no, c.chunk FROM {docs} d, LATERAL ul_chunks(d.text) c", docs=table(spark, d, "documents"))


@query(f"""SELECT doc_id, {registry._SCRIPT_CASE} AS script, md5({_clean('text')}) AS clean_md5, len({registry._SENT.format(_clean('text'))}) AS sentences, CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) AS hash,
 split_part('datasets/' || lang || '/x', '/', 2) AS lang, '<|bicodec_global_' || doc_id || '|>' AS token FROM documents""")
def sql_functions(spark, d):
    """Text functions in plain SQL."""
    sql.register(spark, "ul_")
    return spark.sql(
        """SELECT doc_id, ul_script(text) AS script, md5(ul_clean(text)) AS clean_md5, cast(size(ul_split_sentences(ul_clean(text))) AS BIGINT) AS sentences, ul_hash32(text) AS hash,
        ul_lang_of_path(concat('datasets/', lang, '/x'), 'datasets') AS lang, ul_render_tokens(ul_parse_tokens(ul_render_tokens(array(cast(doc_id AS INT)), 'global'), 'global'), 'global') AS token FROM {docs}""",
        docs=table(spark, d, "documents"),
    )
