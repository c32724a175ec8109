"""Named queries over the driver's tables, each with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterlake import api
from utterlake.functions import spoken
from utterlake.functions import text as T
from utterlake.functions import waves as W
from utterlake.operators import corpus as C
from utterlake.operators import scoring
from utterlake.plans.catalogue import query
from utterlake.runtime import numbered, scratch_path, table
from utterlake.sources import sinks, transcripts, wav

#: Python's white space, for DuckDB.
_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _clean(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_WS}', ' ', 'g'))"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return C.utterances(_docs(spark, d))


_U = """u AS (SELECT doc_id, concat('datasets/', lang, '/corpus/', source, '/wav/', doc_id, '.wav') AS audio_path, text, source AS speaker, lang, n_chars / CAST(150 AS double) AS duration FROM documents)"""
_STATUS = f"""{_U}, m AS (SELECT u.*, CASE WHEN l.doc_id IS NULL THEN 'no_transcript' WHEN coalesce({_clean('u.text')}, '') = '' THEN 'empty_text'
 WHEN u.duration IS NULL OR u.duration < 0.05 OR u.duration > 30 THEN 'duration_filtered' ELSE 'ok' END AS status FROM u LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))"""
_HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
_SENT = r"list_filter(list_transform(regexp_extract_all({}, '[^।॥?!.]*[।॥?!.]+|[^।॥?!.]+'), lambda s: trim(s)), lambda s: s <> '')"
_CHUNKS = f"""s AS (SELECT doc_id, {_SENT.format(_clean('text'))} AS ss FROM source_texts),
r AS (SELECT doc_id, 0 AS i, CAST([] AS VARCHAR[]) AS done, '' AS open, 0 AS n FROM s
 UNION ALL
 SELECT r.doc_id, i + 1, CASE WHEN r.n > 0 AND r.n + length(ss[i + 1]) > 360 THEN list_append(done, open) ELSE done END,
  CASE WHEN r.n = 0 OR r.n + length(ss[i + 1]) > 360 THEN ss[i + 1] ELSE open || ' ' || ss[i + 1] END,
  CASE WHEN r.n > 0 AND r.n + length(ss[i + 1]) > 360 THEN length(ss[i + 1]) ELSE r.n + length(ss[i + 1]) END
 FROM r JOIN s ON r.doc_id = s.doc_id WHERE i < len(ss)),
k AS (SELECT r.doc_id, CASE WHEN r.n > 0 THEN list_append(done, open) ELSE done END AS cs FROM r JOIN s ON r.doc_id = s.doc_id WHERE i = len(ss))"""
_SCRIPT_CASE = """CASE WHEN length(regexp_replace(text, '[^\\x{00}-\\x{7F}]', '', 'g')) >= 1 AND length(regexp_replace(text, '[^\\x{00}-\\x{7F}]', '', 'g')) >= length(regexp_replace(text, '[^\\x{0900}-\\x{097F}]', '', 'g')) THEN 'en'
 WHEN length(regexp_replace(text, '[^\\x{0900}-\\x{097F}]', '', 'g')) > 0 THEN 'hi' ELSE 'en' END"""


@query(f"SELECT DISTINCT {_clean('text')} AS text FROM documents WHERE length({_clean('text')}) > 5")
def clean_corpus(spark, d):
    return C.corpus_lines(_docs(spark, d)).distinct()


@query(f"SELECT count(*) AS lines, count(DISTINCT text) AS distinct_lines FROM (SELECT {_clean('text')} AS text FROM documents) WHERE length(text) > 5")
def corpus_sizes(spark, d):
    """Lines of the corpus before and after repeats go."""
    lines = C.corpus_lines(_docs(spark, d)).groupBy("text").agg(F.count("*").alias("n"))
    return lines.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.count("*").alias("distinct_lines"))


@query(f"SELECT doc_id, {_SCRIPT_CASE} AS script FROM documents")
def detect_script(spark, d):
    return _docs(spark, d).select("doc_id", T.script(F.col("text")).alias("script"))


@query(f"SELECT script, count(*) AS n FROM (SELECT {_SCRIPT_CASE} AS script FROM conversations) GROUP BY 1")
def script_counts(spark, d):
    return table(spark, d, "conversations").groupBy(T.script(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


@query("SELECT lang, CASE lang WHEN 'bn' THEN 'bengali' WHEN 'gu' THEN 'gujarati' WHEN 'te' THEN 'telugu' WHEN 'kn' THEN 'kannada' ELSE 'devanagari' END AS scheme, count(*) AS n FROM documents GROUP BY 1, 2")
def script_scheme(spark, d):
    return _docs(spark, d).groupBy("lang", T.scheme(F.col("lang")).alias("scheme")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CAST(g - 1 AS INTEGER) AS no, ss[g] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS g FROM (SELECT doc_id, {_SENT.format(_clean('text'))} AS ss FROM documents))")
def split_sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.sentences(T.clean(F.col("text")))).alias("no", "sentence"))


@query(f"WITH RECURSIVE source_texts AS (SELECT doc_id, text FROM documents), {_CHUNKS} SELECT doc_id, CAST(g - 1 AS INTEGER) AS chunk_no, cs[g] AS chunk FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS g FROM k)")
def text_chunks(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.chunked(F.col("text"))).alias("chunk_no", "chunk"))


@query(f"WITH RECURSIVE source_texts AS (SELECT doc_id, text FROM documents), {_CHUNKS} SELECT lang, CAST(sum(len(cs)) AS BIGINT) AS n_chunks, CAST(max(len(cs)) AS BIGINT) AS most FROM k JOIN documents USING (doc_id) GROUP BY 1")
def chunk_stats(spark, d):
    n = _docs(spark, d).select("lang", F.size(T.chunked(F.col("text"))).cast("bigint").alias("n"))
    return n.groupBy("lang").agg(F.sum("n").alias("n_chunks"), F.max("n").alias("most"))


def _normal_sql(source: str, key: str, lang: str) -> str:
    acr = r"array_to_string(list_transform(regexp_extract_all(t, '[\p{L}\p{N}_&]+|[^\p{L}\p{N}_&]+'), lambda w: CASE WHEN regexp_full_match(w, '[A-Z][A-Z0-9&]*[A-Z0-9]') THEN trim(regexp_replace(w, '(.)', '\1 ', 'g')) ELSE w END), '')"
    pat = r"[$£€₹]\s?\p{Nd}+(?:\.\p{Nd}+)?"
    plural = " || CASE WHEN CAST(regexp_extract(m, '[0-9]+(\\.[0-9]+)?') AS DOUBLE) > 1 THEN 's' ELSE '' END" if lang != "hi" else ""
    names = T.CURRENCIES
    name = "CASE m[1] " + " ".join(f"WHEN '{s}' THEN '{v['hi' if lang == 'hi' else 'en']}'" for s, v in names.items()) + " END"
    cur = rf"array_to_string(list_transform(list_zip(regexp_split_to_array(t, '{pat}'), list_transform(regexp_extract_all(t, '{pat}'), lambda m: regexp_extract(m, '[0-9]+(\.[0-9]+)?') || ' ' || {name}{plural})), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '')"
    sym = "t"
    for sign, word in T.SYMBOLS.get(lang, T.SYMBOLS["en"]).items():
        sym = f"replace({sym}, '{sign}', ' {word} ')"
    return f"WITH a AS (SELECT {key}, {acr} AS t FROM ({source})), b AS (SELECT {key}, {cur} AS t FROM a), c AS (SELECT {key}, {sym} AS t FROM b) SELECT {key}, {_clean('t')} AS normal FROM c"


@query(_normal_sql("SELECT doc_id, text AS t FROM documents", "doc_id", "en"))
def normalize_text_en(spark, d):
    return _docs(spark, d).select("doc_id", T.normalise(F.col("text"), "en").alias("normal"))


@query(_normal_sql("SELECT doc_id, text AS t FROM documents", "doc_id", "hi"))
def normalize_text_hi(spark, d):
    return _docs(spark, d).select("doc_id", T.normalise(F.col("text"), "hi").alias("normal"))


#: Each row's own language: one with tables, one without, and none, which its script decides.
_OWN_LANG = "CASE WHEN lang = 'es' THEN 'hi' WHEN lang = 'fr' THEN NULL ELSE lang END"
_MIXED = f"""t AS (SELECT doc_id, text, coalesce({_OWN_LANG}, {_SCRIPT_CASE}) AS own FROM documents),
mixed AS (SELECT * FROM ({_normal_sql("SELECT doc_id, text AS t FROM t WHERE own = 'hi'", "doc_id", "hi")}) UNION ALL SELECT * FROM ({_normal_sql("SELECT doc_id, text AS t FROM t WHERE own <> 'hi'", "doc_id", "en")}))"""


@query(f"WITH {_MIXED} SELECT doc_id, normal FROM mixed")
def normalize_mixed(spark, d):
    return _docs(spark, d).select("doc_id", spoken.processed(F.col("text"), F.expr(_OWN_LANG)).alias("normal"))


@query(f"WITH RECURSIVE {_MIXED}, source_texts AS (SELECT doc_id, normal AS text FROM mixed), {_CHUNKS} SELECT doc_id, CAST(g - 1 AS INTEGER) AS chunk_no, cs[g] AS chunk FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS g FROM k)")
def normalized_chunks(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.normalised_chunks(F.col("text"), F.expr(_OWN_LANG))).alias("chunk_no", "chunk"))


@query(_normal_sql("SELECT o_orderkey, concat('Total ₹', CAST(o_totalprice AS DECIMAL(18,2)), ' @ 5% R&D for US') AS t FROM orders", "o_orderkey", "en"))
def normalize_prices(spark, d):
    price = F.concat(F.lit("Total ₹"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" @ 5% R&D for US"))
    return table(spark, d, "orders").select("o_orderkey", T.normalise(price, "en").alias("normal"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN 'chunked' ELSE 'direct' END AS route FROM documents")
def route_long_text(spark, d):
    return _docs(spark, d).select("doc_id", F.when(F.length("text") > T.LONG_TEXT, "chunked").otherwise("direct").alias("route"))


@query(f"WITH {_STATUS} SELECT doc_id, status FROM m")
def manifest_status(spark, d):
    return C.classified(_manifest(spark, d), table(spark, d, "labels")).select("doc_id", "status")


@query(f"WITH {_STATUS} SELECT status, count(*) AS n FROM m GROUP BY 1")
def status_counts(spark, d):
    return C.classified(_manifest(spark, d), table(spark, d, "labels")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {_STATUS} SELECT audio_path, text, speaker, lang, duration FROM m WHERE status = 'ok'")
def manifest(spark, d):
    return C.classified(_manifest(spark, d), table(spark, d, "labels")).where("status = 'ok'").select("audio_path", "text", "speaker", "lang", "duration")


@query(f"WITH {_STATUS} SELECT count(*) AS raw, count(*) FILTER (status = 'ok') AS final, round(CASE WHEN count(*) = 0 THEN 0 ELSE 100.0 * count(*) FILTER (status = 'ok') / count(*) END, 6) AS percent FROM m")
def retention(spark, d):
    s = C.classified(_manifest(spark, d), table(spark, d, "labels"))
    return s.agg(F.count("*").alias("raw"), F.count_if(F.col("status") == "ok").alias("final")).withColumn("percent", F.round(F.when(F.col("raw") == 0, 0.0).otherwise(F.lit(100.0).cast("double") * F.col("final") / F.col("raw")), 6))


@query(f"WITH {_U} SELECT audio_path, split_part(audio_path, '/', 2) AS lang, regexp_extract(audio_path, '([^/]+)\\.wav$', 1) AS stem, split_part(audio_path, '/', 4) AS parent FROM u")
def infer_lang_path(spark, d):
    p = F.col("audio_path")
    return _manifest(spark, d).select(p, T.lang_of_path(p, "datasets").alias("lang"), F.regexp_extract(p, r"([^/]+)\.wav$", 1).alias("stem"), F.element_at(F.split(p, "/"), -3).alias("parent"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def lang_filter(spark, d):
    return _docs(spark, d).where(F.col("lang").isin("de", "fr")).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY md5('42:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 50")
def lang_cap(spark, d):
    return C.capped(_docs(spark, d).select("doc_id", "lang"), "lang", 50)


@query("""WITH o AS (SELECT count(*) AS n FROM documents WHERE lang NOT IN ('en', 'de')), b AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents WHERE lang IN ('en', 'de'))
SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'de') UNION ALL SELECT doc_id, lang FROM b, o WHERE r <= floor(0.25 / (1 - 0.25) * n)""")
def balanced_cap(spark, d):
    return C.balanced(_docs(spark, d).select("doc_id", "lang"), ["en", "de"], 0.25)


@query("""WITH o AS (SELECT count(*) AS n FROM documents WHERE lang NOT IN ('en', 'de')), c AS (SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 120),
b AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r FROM c WHERE lang IN ('en', 'de'))
SELECT doc_id, lang FROM c WHERE lang NOT IN ('en', 'de') UNION ALL SELECT doc_id, lang FROM b, o WHERE r <= floor(0.25 / (1 - 0.25) * n)""")
def balanced_lang_cap(spark, d):
    return C.balanced_capped(_docs(spark, d).select("doc_id", "lang"), ["en", "de"], 0.25, 120)


@query("SELECT w.base, CASE WHEN EXISTS (SELECT 1 FROM documents WHERE lang = w.base) THEN 'balanced' ELSE 'proportional' END AS mode FROM (SELECT unnest(['en', 'hi']) AS base) w")
def sampling_modes(spark, d):
    return spark.createDataFrame([(x, C.sampling_mode(_docs(spark, d), [x], "balanced")) for x in ("en", "hi")], "base string, mode string")


@query(f"WITH {_STATUS} SELECT doc_id, duration FROM m WHERE status = 'ok' ORDER BY doc_id LIMIT 100")
def sample_limit(spark, d):
    return C.classified(_manifest(spark, d), table(spark, d, "labels")).where("status = 'ok'").select("doc_id", "duration").orderBy("doc_id").limit(100)


@query(f"WITH {_U} SELECT doc_id, duration FROM u ORDER BY duration, doc_id")
def duration_sort(spark, d):
    return _manifest(spark, d).select("doc_id", "duration").orderBy("duration", "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) <= greatest(1, least(count(*) OVER () - 1, round_even(count(*) OVER () * 0.02, 0))) AS is_val FROM documents")
def val_split(spark, d):
    return C.split_validation(_docs(spark, d).select("doc_id"), 0.02)


@query("SELECT source AS speaker, count(*) AS n FROM documents WHERE source <> '' GROUP BY 1 HAVING count(*) >= 2")
def speaker_groups(spark, d):
    return _docs(spark, d).where("source <> ''").groupBy(F.col("source").alias("speaker")).agg(F.count("*").alias("n")).where("n >= 2")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 32")
def speaker_pool(spark, d):
    return C.pool(_docs(spark, d).select("doc_id", "source"), "source", "doc_id", 32)


@query(f"""WITH {_U}, p AS (SELECT audio_path, speaker, row_number() OVER (PARTITION BY speaker ORDER BY audio_path) - 1 AS own, count(*) OVER (PARTITION BY speaker) AS n FROM u),
q AS (SELECT *, {_HASH.format("'refidx:' || audio_path")} % n AS f, {_HASH.format("'refsel:' || audio_path")} / CAST(4294967295 AS DOUBLE) AS x FROM p),
a AS (SELECT *, CASE WHEN x < 0.8 AND n > 1 THEN CASE WHEN f = own THEN (f + 1) % n ELSE f END ELSE own END AS pick FROM q)
SELECT a.audio_path, a.speaker, p.audio_path AS ref FROM a JOIN p ON a.speaker = p.speaker AND a.pick = p.own""")
def ref_select(spark, d):
    return C.references(_manifest(spark, d).select("audio_path", "speaker"))


_REPEATED = "SELECT audio_path, speaker FROM u UNION ALL SELECT audio_path, speaker FROM u JOIN labels USING (doc_id) WHERE toxic = 1"


@query(f"""WITH {_U}, r AS ({_REPEATED}), p AS (SELECT audio_path, speaker, row_number() OVER (PARTITION BY speaker ORDER BY audio_path) - 1 AS own, count(*) OVER (PARTITION BY speaker) AS n FROM r),
q AS (SELECT *, {_HASH.format("'refidx:' || audio_path")} % n AS f, {_HASH.format("'refsel:' || audio_path")} / CAST(4294967295 AS DOUBLE) AS x FROM p)
SELECT q.audio_path, q.speaker, CASE WHEN x < 0.8 AND q.n > 1 THEN CASE WHEN a.audio_path = q.audio_path THEN b.audio_path ELSE a.audio_path END ELSE q.audio_path END AS ref
FROM q JOIN p a ON a.speaker = q.speaker AND a.own = f JOIN p b ON b.speaker = q.speaker AND b.own = (f + 1) % q.n""")
def ref_repeats(spark, d):
    """References where some utterances come twice: a row for each row."""
    u, marked = _manifest(spark, d), table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return C.references(u.unionByName(u.join(marked, "doc_id")).select("audio_path", "speaker"))


@query(f"""WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
s AS (SELECT source, max(n) AS n FROM p GROUP BY 1 HAVING max(n) >= 2), k AS (SELECT source, n, unnest(range(0, least(10, n * (n - 1) // 2))) AS draw FROM s),
h AS (SELECT source, draw, n, {_HASH.format("'a:' || source || ':' || draw")} % n AS a, {_HASH.format("'b:' || source || ':' || draw")} % (n - 1) AS b0 FROM k)
SELECT h.source AS speaker, h.draw, x.doc_id AS ref, y.doc_id AS target FROM h JOIN p x ON x.source = h.source AND x.i = a JOIN p y ON y.source = h.source AND y.i = CASE WHEN b0 >= a THEN b0 + 1 ELSE b0 END""")
def clone_pairs(spark, d):
    return C.cloning_pairs(_docs(spark, d), "doc_id", "source")


@query("SELECT doc_id, '<|task_tts|><|start_content|>' || text || '<|end_content|>' AS prompt FROM documents")
def prompt_build(spark, d):
    return _docs(spark, d).select("doc_id", T.train_prompt(F.col("text")).alias("prompt"))


@query("SELECT u.conv_id, u.turn, '<|task_tts|><|start_content|>' || u.text || '<|end_content|>' AS prompt, a.text AS completion FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'")
def chat_prompts(spark, d):
    c = table(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion"))
    return c.where("role = 'user'").join(a, ["conv_id", "turn"]).select("conv_id", "turn", T.train_prompt(F.col("text")).alias("prompt"), "completion")


def _tokens(spark, d) -> DataFrame:
    x = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", F.col("label").alias("speaker"), F.transform(F.slice(x, 1, 32), lambda v: F.floor((v.cast("double") + 1) * 2048).cast("int")).alias("global_ids"),
        F.transform(x, lambda v: F.floor((v.cast("double") + 1) * 4096).cast("int")).alias("semantic_ids"))


_TOK = """t AS (SELECT vec_id, label AS speaker, list_transform(embedding[1:32], lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 2048) AS INTEGER)) AS g,
 list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 4096) AS INTEGER)) AS s FROM embeddings)"""


_SAID = "'<|start_global_token|>' || array_to_string(list_transform(g, lambda i: '<|bicodec_global_' || i || '|>'), '') || '<|end_global_token|><|start_semantic_token|>'"


@query(f"WITH {_TOK} SELECT vec_id, {_SAID} || array_to_string(list_transform(s, lambda i: '<|bicodec_semantic_' || i || '|>'), '') || '<|end_semantic_token|><|im_end|>' AS completion FROM t")
def prompt_completion(spark, d):
    said = T.train_completion(T.render_tokens(F.col("global_ids"), "global"), T.render_tokens(F.col("semantic_ids"), "semantic"))
    return _tokens(spark, d).select("vec_id", said.alias("completion"))


@query(f"WITH {_TOK} SELECT vec_id, '<|task_tts|><|start_content|>' || 'text ' || vec_id || '<|end_content|>' || {_SAID} AS prompt FROM t")
def prompt_inference(spark, d):
    text = F.concat(F.lit("text "), F.col("vec_id").cast("string"))
    return _tokens(spark, d).select("vec_id", T.inference_prompt(text, T.render_tokens(F.col("global_ids"), "global")).alias("prompt"))


@query(f"WITH {_TOK} SELECT vec_id, array_to_string(list_transform(s, lambda i: '<|bicodec_semantic_' || i || '|>'), '') AS tokens FROM t")
def token_render(spark, d):
    return _tokens(spark, d).select("vec_id", T.render_tokens(F.col("semantic_ids"), "semantic").alias("tokens"))


@query(f"WITH {_TOK} SELECT vec_id, array_to_string(g, ',') AS ids FROM t")
def token_parse(spark, d):
    text = _tokens(spark, d).select("vec_id", F.concat(T.render_tokens(F.col("semantic_ids"), "semantic"), T.render_tokens(F.col("global_ids"), "global")).alias("t"))
    return text.select("vec_id", F.array_join(T.parse_tokens(F.col("t"), "global").cast("array<string>"), ",").alias("ids"))


_PROMPT = "list_transform(range(0, vec_id % 40), lambda i: CAST(i AS INTEGER))"


def _prompt():
    return F.when(F.col("vec_id") % 40 > 0, F.transform(F.sequence(F.lit(0), (F.col("vec_id") % 40 - 1).cast("int")), lambda i: i)).otherwise(F.array().cast("array<int>"))


def _rows(df: DataFrame) -> DataFrame:
    text = {c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("input_ids", "labels", "attention_mask")}
    return df.select("vec_id", *text.values())


@query(f"""WITH {_TOK}, c AS (SELECT vec_id, s, {_PROMPT} || [900001] || g || [900002, 900003] AS ctx FROM t WHERE len(g) > 0 AND len(s) > 0),
k AS (SELECT vec_id, ctx, s[1:90 - len(ctx) - 2] || [900004, 900005] AS tail FROM c WHERE 90 - len(ctx) > 2)
SELECT vec_id, array_to_string(ctx || tail, ',') AS input_ids, array_to_string(list_transform(ctx, lambda x: -100) || tail, ',') AS labels, array_to_string(list_transform(ctx || tail, lambda x: 1), ',') AS attention_mask FROM k""")
def train_rows_clone(spark, d):
    return _rows(C.training_rows(_tokens(spark, d), _prompt(), 90))


@query(f"""WITH {_TOK}, c AS (SELECT vec_id, {_PROMPT} AS p, ({_PROMPT} || s)[1:60] AS w FROM t)
SELECT vec_id, array_to_string(w, ',') AS input_ids, array_to_string(list_transform(w[1:len(p)], lambda x: -100) || w[len(p) + 1:], ',') AS labels, array_to_string(list_transform(w, lambda x: 1), ',') AS attention_mask FROM c""")
def train_rows_legacy(spark, d):
    return _rows(C.legacy_training_rows(_tokens(spark, d), _prompt(), 60))


@query(f"WITH {_TOK} SELECT vec_id, len({_PROMPT} || s) AS n FROM t WHERE len({_PROMPT} || s) <= 80")
def len_filter(spark, d):
    rows = _tokens(spark, d).select("vec_id", F.concat(_prompt(), "semantic_ids").alias("ids"))
    return C.within_length(rows, F.col("ids"), 80).select("vec_id", F.size("ids").cast("bigint").alias("n"))


#: Rows with every kind of fault, told apart by their number.
_FAULTY = "CASE vec_id % 9 WHEN 1 THEN 'no_global_ids' WHEN 2 THEN 'no_semantic_ids' WHEN 3 THEN 'empty_text' ELSE CASE WHEN 90 - (vec_id % 40 + 32 + 3) <= 2 THEN 'no_room' END END"


def _faulty(spark, d) -> DataFrame:
    n, none = F.col("vec_id") % 9, F.array().cast("array<int>")
    return _tokens(spark, d).select("vec_id", F.when(n == 3, " ").otherwise("words").alias("text"), F.when(n == 1, none).otherwise(F.col("global_ids")).alias("global_ids"), F.when(n == 2, none).otherwise(F.col("semantic_ids")).alias("semantic_ids"))


@query(f"SELECT vec_id, {_FAULTY} AS reason FROM embeddings WHERE {_FAULTY} IS NOT NULL")
def row_errors(spark, d):
    """The rows that make no training row, and why."""
    return C.tolerant(_faulty(spark, d), C.refused(_prompt(), 90))[1].select("vec_id", "reason")


@query(f"SELECT count(*) AS rows, count({_FAULTY}) AS errors, round(count({_FAULTY}) / count(*), 6) AS rate FROM embeddings")
def error_counts(spark, d):
    """Rows and errors as observed while the good rows are written."""
    good, _, seen = C.tolerant(_faulty(spark, d), C.refused(_prompt(), 90))
    good.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["errors"])], "rows long, errors long").withColumn("rate", F.round(F.col("errors") / F.col("rows"), 6))


_WAVE = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings"


def _waves(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("w"))


@query(f"""WITH a AS ({_WAVE}), e AS (SELECT *, greatest(1e-4, 1e-3 * list_max(list_transform(w, lambda x: abs(x)))) AS eps FROM a),
l AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: abs(w[i]) > eps) AS loud FROM e),
t AS (SELECT vec_id, CASE WHEN len(loud) > 0 THEN w[greatest(loud[1] - 5, 1):least(loud[-1] + 5, len(w))] ELSE w END AS w FROM l),
r AS (SELECT *, sqrt(list_sum(list_transform(w, lambda x: x * x)) / len(w)) AS r FROM t), g AS (SELECT vec_id, list_transform(w, lambda x: x * CASE WHEN r > 0 AND r < 0.05 THEN least(0.05 / r, 30) ELSE 1 END) AS w FROM r),
p AS (SELECT *, list_max(list_transform(w, lambda x: abs(x))) AS p FROM g), c AS (SELECT vec_id, list_transform(w, lambda x: greatest(-1.0, least(1.0, x * CASE WHEN p > 0 AND p < 0.5 THEN 0.95 / p ELSE 1 END))) AS w FROM p)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(w[i], 6) AS sample FROM (SELECT vec_id, w, unnest(range(1, len(w) + 1)) AS i FROM c)""")
def wav_prepare(spark, d):
    return _waves(spark, d).select("vec_id", F.posexplode(W.prepare(F.col("w"), 100)).alias("pos", "sample")).withColumn("sample", F.round("sample", 6))


@query(f"SELECT vec_id, round(list_max(list_transform(w, lambda x: abs(x))), 6) AS peak, round(sqrt(list_sum(list_transform(w, lambda x: x * x)) / len(w)), 6) AS rms, round(list_sum(list_transform(w, lambda x: abs(x))) / len(w), 6) AS mean_abs FROM ({_WAVE})")
def wav_stats(spark, d):
    w = F.col("w")
    return _waves(spark, d).select("vec_id", F.round(W.peak(w), 6).alias("peak"), F.round(W.rms(w), 6).alias("rms"), F.round(W.mean_abs(w), 6).alias("mean_abs"))


@query(f"SELECT vec_id, list_sum(list_transform(w, lambda x: abs(x))) / len(w) < 1e-4 AS silent FROM ({_WAVE})")
def wav_silent(spark, d):
    return _waves(spark, d).select("vec_id", W.silent(F.col("w")).alias("silent"))


@query("SELECT vec_id, i - 1 AS pos, round((embedding[i]::DOUBLE + embedding[i + 32]::DOUBLE) / 2, 6) AS sample FROM (SELECT vec_id, embedding, unnest(range(1, 33)) AS i FROM embeddings)")
def mono_downmix(spark, d):
    m = _waves(spark, d).select("vec_id", W.mono(F.array(F.slice("w", 1, 32), F.slice("w", 33, 32))).alias("m"))
    return m.select("vec_id", F.posexplode("m").alias("pos", "sample")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("sample", 6).alias("sample"))


_MICRO = "array_to_string(list_transform({}, lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR)), ' ')"


def _micro(wave) -> Column:
    return F.array_join(F.transform(wave, lambda x: F.round(x * 1000000).cast("bigint").cast("string")), " ")


@query(f"""WITH a AS (SELECT vec_id, vec_id // 8 AS batch, CASE vec_id % 3 WHEN 0 THEN w WHEN 1 THEN w || w ELSE w || w || w END AS w FROM ({_WAVE})), b AS (SELECT *, max(len(w)) OVER (PARTITION BY batch) AS size FROM a)
SELECT vec_id, batch, size, {_MICRO.format("w || list_transform(range(size - len(w)), lambda i: CAST(0 AS DOUBLE))")} AS padded FROM b""")
def pad_batch(spark, d):
    """Whole waves of one to three times 64 samples, padded to the longest of their batch."""
    a = _waves(spark, d).select("vec_id", F.expr("vec_id div 8").alias("batch"), F.flatten(F.array_repeat("w", (F.col("vec_id") % 3 + 1).cast("int"))).alias("w"))
    b = a.withColumn("size", F.max(F.size("w")).over(Window.partitionBy("batch")))
    return b.select("vec_id", "batch", F.col("size").cast("bigint").alias("size"), _micro(W.padded(F.col("w"), F.col("size"))).alias("padded"))


@query(f"""WITH a AS (SELECT vec_id, label, w, len(w) AS n, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS no, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) IS NULL AS last FROM ({_WAVE})),
p AS (SELECT *, coalesce(sum(n - CASE WHEN last THEN 0 ELSE 8 END) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM a),
x AS (SELECT label, start, no, last, n, w, unnest(range(0, n)) AS i FROM p)
SELECT label, CAST(start + i AS BIGINT) AS pos, round(sum(w[i + 1] * CASE WHEN no > 1 AND i < 8 THEN i / 7.0 ELSE 1 END * CASE WHEN NOT last AND i >= n - 8 THEN (n - 1 - i) / 7.0 ELSE 1 END), 6) AS sample FROM x GROUP BY 1, 2""")
def crossfade(spark, d):
    return C.crossfaded(_waves(spark, d), "label", "vec_id", "w", 8).select("label", F.col("pos").cast("bigint").alias("pos"), F.round("sample", 6).alias("sample"))


@query("""SELECT id, arg_min(origin, rank) AS origin FROM (SELECT doc_id AS id, 'shards' AS origin, 0 AS rank FROM labels UNION ALL SELECT DISTINCT conv_id, 'flat', 1 FROM conversations UNION ALL SELECT doc_id, 'legacy', 2 FROM documents) GROUP BY 1""")
def cache_merge(spark, d):
    """Three caches whose keys overlap: the earliest wins."""
    keys = ((table(spark, d, "labels"), "doc_id", "shards"), (table(spark, d, "conversations").dropDuplicates(["conv_id"]), "conv_id", "flat"), (_docs(spark, d), "doc_id", "legacy"))
    return C.first_wins([x.select(F.col(key).alias("id"), F.lit(name).alias("origin")) for x, key, name in keys], "id")


@query(f"WITH {_U} SELECT doc_id, audio_path, quality, toxic FROM u JOIN labels USING (doc_id)")
def cache_hits(spark, d):
    return C.cached(_manifest(spark, d).select("doc_id", "audio_path"), table(spark, d, "labels"), "doc_id")[0]


@query("SELECT count(*) AS rows, count(*) FILTER (l.doc_id IS NULL) AS misses FROM documents d LEFT JOIN labels l USING (doc_id)")
def cache_misses(spark, d):
    """Rows and misses as observed while the hits are written."""
    hits, seen = C.cached(_manifest(spark, d).select("doc_id", "audio_path"), table(spark, d, "labels"), "doc_id")
    hits.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["misses"])], "rows long, misses long")


@query(f"WITH {_U} SELECT doc_id, audio_path FROM u WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_missing(spark, d):
    return _manifest(spark, d).select("doc_id", "audio_path").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"WITH {_U} SELECT doc_id, audio_path FROM u WHERE doc_id IN (SELECT doc_id FROM labels)")
def cache_subset(spark, d):
    return _manifest(spark, d).select("doc_id", "audio_path").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT 'out/' || source AS folder, max(doc_id) AS step, arg_max('out/' || source || '/checkpoint-' || doc_id, doc_id) AS path FROM documents GROUP BY 1")
def latest_checkpoint(spark, d):
    path = lambda name: F.concat(F.lit("out/"), "source", F.lit(f"/{name}-"), F.col("doc_id").cast("string"))
    paths = _docs(spark, d).select(F.explode(F.array(path("checkpoint"), path("log"))).alias("path"))
    return C.latest_checkpoints(paths)


@query("SELECT doc_id, substr(md5(doc_id || ':' || lang || ':' || source), 1, 12) AS fingerprint FROM documents")
def fingerprint(spark, d):
    return _docs(spark, d).select("doc_id", T.fingerprint(F.col("doc_id").cast("string"), F.col("lang"), F.col("source")).alias("fingerprint"))


def _pieces(spark, d, name: str, key: str) -> DataFrame:
    words = table(spark, d, name).select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z<>]+"))).alias("piece"), F.col(key).alias("k"))
    return words.where("piece <> ''").groupBy("piece").agg(F.min("k").alias("k"))


_WORDS = "SELECT piece, min(k) AS k FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z<>]+')) AS piece, {} AS k FROM {}) WHERE piece <> '' GROUP BY 1"
_VOCAB = f"b AS (SELECT piece, row_number() OVER (ORDER BY k, piece) - 1 AS id FROM ({_WORDS.format('item_id', 'benchmark')})), n AS (SELECT piece, k FROM ({_WORDS.format('conv_id', 'conversations')}))"


@query(f"WITH {_VOCAB} SELECT piece FROM n WHERE NOT (piece LIKE '<%' AND piece LIKE '%>') AND piece NOT IN (SELECT piece FROM b)")
def vocab_new(spark, d):
    n = _pieces(spark, d, "conversations", "conv_id").where(~(F.startswith("piece", F.lit("<")) & F.endswith("piece", F.lit(">"))))
    return n.join(_pieces(spark, d, "benchmark", "item_id"), "piece", "left_anti").select("piece")


@query(f"WITH {_VOCAB}, p AS (SELECT piece, row_number() OVER (ORDER BY k, piece) - 1 AS id FROM n) SELECT piece, id, row_number() OVER (ORDER BY id) - 1 + (SELECT max(id) + 1 FROM b) AS new_id FROM p WHERE NOT (piece LIKE '<%' AND piece LIKE '%>') AND piece NOT IN (SELECT piece FROM b)")
def vocab_ids(spark, d):
    base, n = (numbered(_pieces(spark, d, t, k), [], ["k", "piece"], "id").select("piece", "id") for t, k in (("benchmark", "item_id"), ("conversations", "conv_id")))
    return C.new_vocabulary(base, n)


@query("SELECT CAST(i - 1 AS INTEGER) AS pos, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM (SELECT embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1")
def mean_embedding(spark, d):
    return table(spark, d, "embeddings").select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("""WITH m AS (SELECT CAST(i - 1 AS BIGINT) AS pos, avg(embedding[i]::DOUBLE) AS mean FROM (SELECT embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1), n AS (SELECT unnest(range(16)) AS new_id),
u AS (SELECT new_id, pos, mean, (CAST('0x' || substr(md5('11:' || new_id || ':' || pos), 1, 8) AS BIGINT) + 1) / 4294967297.0 AS u, (CAST('0x' || substr(md5('11:' || new_id || ':' || pos), 9, 8) AS BIGINT) + 1) / 4294967297.0 AS v FROM n, m)
SELECT new_id, pos, round(mean + 0.01 * sqrt(-2 * ln(u)) * cos(2 * pi() * v), 6) AS value FROM u""")
def embed_init(spark, d):
    """16 new rows of the embedding matrix."""
    return C.new_embeddings(table(spark, d, "embeddings"), "embedding", 16, "11").select("new_id", "pos", F.round("value", 6).alias("value"))


@query("SELECT count(*) AS lines, CAST(sum(len(regexp_extract_all(text, '[^ \\t\\n\\x{0B}\\f\\r]+'))) AS BIGINT) AS words, round(avg(length(text)), 6) AS mean_chars FROM documents")
def corpus_counts(spark, d):
    return _docs(spark, d).agg(F.count("*").alias("lines"), F.sum(F.expr(r"cast(regexp_count(text, r'[^ \t\n\x0B\f\r]+') as bigint)")).alias("words"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


@query("""WITH j AS (SELECT source, d.doc_id, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))
SELECT source, count(*) AS files, count(*) FILTER (missing) AS missing, array_to_string(list_sort(list(doc_id) FILTER (missing))[1:3], ',') AS examples FROM j GROUP BY 1""")
def layout_validate(spark, d):
    known = table(spark, d, "labels").select("doc_id").distinct().withColumn("has", F.lit(True))
    j = _docs(spark, d).select("source", "doc_id").join(known, "doc_id", "left").withColumn("missing", F.col("has").isNull())
    w = Window.partitionBy("source").orderBy("doc_id")
    few = j.where("missing").withColumn("n", F.row_number().over(w)).where("n <= 3").groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("doc_id")).cast("array<string>"), ",").alias("examples"))
    return j.groupBy("source").agg(F.count("*").alias("files"), F.count_if("missing").alias("missing")).join(few, "source", "left")


@query("SELECT DISTINCT 'SPICORProject_' || source AS src, 'SYSPINProject_SPICOR_' || source AS dst, lang FROM documents WHERE length(lang) BETWEEN 2 AND 4 AND lang = lower(lang) AND lang <> upper(lang)")
def layout_plan(spark, d):
    x = _docs(spark, d).where(T.language_dir(F.col("lang"))).select(F.concat(F.lit("SPICORProject_"), "source").alias("src"), "lang").distinct()
    return x.select("src", F.regexp_replace("src", "^SPICORProject_", "SYSPINProject_SPICOR_").alias("dst"), "lang")


_DIRS = """SELECT DISTINCT lang || '/IISc_SYSPIN_Data/IISc_SYSPIN_Data/IISc_SYSPINProject_' || source AS path FROM documents UNION SELECT DISTINCT lang || '/IISc_SPICOR_Data/IISc_SPICOR_Data/IISc_SPICORProject_' || source FROM documents
 UNION SELECT DISTINCT lang || '/IISc_SYSPIN_Data/IISc_SYSPINProject_' || source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1"""


@query(f"""WITH d AS ({_DIRS}), p AS (SELECT path AS src, split_part(path, '/', 1) || '/IISc_SYSPIN_Data/' || replace(split_part(path, '/', 4), 'IISc_SPICORProject_', 'IISc_SYSPINProject_SPICOR_') AS dst,
 CASE WHEN path LIKE '%SPICOR%' THEN 'spicor' ELSE 'syspin' END AS kind FROM d WHERE split_part(path, '/', 4) <> '')
SELECT src, dst, kind, CASE WHEN dst IN (SELECT path FROM d) THEN 'skip_exists' ELSE 'move' END AS action FROM p""")
def move_plan(spark, d):
    return C.move_plan(_dirs(spark, d))


@query(f"""WITH d AS ({_DIRS}), p AS (SELECT split_part(path, '/', 1) || '/IISc_SYSPIN_Data/' || replace(split_part(path, '/', 4), 'IISc_SPICORProject_', 'IISc_SYSPINProject_SPICOR_') AS dst, CASE WHEN path LIKE '%SPICOR%' THEN 'spicor' ELSE 'syspin' END AS kind
 FROM d WHERE split_part(path, '/', 4) <> '') SELECT kind, CASE WHEN dst IN (SELECT path FROM d) THEN 'skip_exists' ELSE 'move' END AS action, count(*) AS n FROM p GROUP BY 1, 2""")
def move_counts(spark, d):
    return C.move_plan(_dirs(spark, d)).groupBy("kind", "action").agg(F.count("*").alias("n"))


def _dirs(spark, d) -> DataFrame:
    docs, done = _docs(spark, d), table(spark, d, "labels").where("toxic = 1").select("doc_id")
    flat = docs.join(done, "doc_id", "left_semi")
    path = lambda df, tail: df.select(F.concat("lang", F.lit(tail), "source").alias("path"))
    return path(docs, "/IISc_SYSPIN_Data/IISc_SYSPIN_Data/IISc_SYSPINProject_").union(path(docs, "/IISc_SPICOR_Data/IISc_SPICOR_Data/IISc_SPICORProject_")).union(path(flat, "/IISc_SYSPIN_Data/IISc_SYSPINProject_")).distinct()


@query("""WITH w AS (SELECT DISTINCT lang AS speaker, doc_id AS id, 1 AS wav FROM documents), t AS (SELECT DISTINCT 'en' AS speaker, conv_id AS id, 0 AS wav FROM conversations), a AS (SELECT speaker, id, max(wav) AS wav, count(*) AS n FROM (FROM w UNION ALL FROM t) GROUP BY 1, 2)
SELECT speaker, count(*) FILTER (n = 1 AND wav = 0) AS missing_wavs, count(*) FILTER (n = 1 AND wav = 1) AS missing_transcripts, coalesce(array_to_string(list_sort(list(id) FILTER (n = 1 AND wav = 0))[1:3], ','), '') AS missing_wavs_examples,
 coalesce(array_to_string(list_sort(list(id) FILTER (n = 1 AND wav = 1))[1:3], ','), '') AS missing_transcripts_examples FROM a GROUP BY 1""")
def layout_orphans(spark, d):
    """Sounds without a transcript and transcripts without a sound, by speaker."""
    sounds = _docs(spark, d).select(F.col("lang").alias("speaker"), F.col("doc_id").alias("id"))
    found = C.orphans(sounds, table(spark, d, "conversations").select(F.lit("en").alias("speaker"), F.col("conv_id").alias("id")), "speaker", "id")
    text = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("missing_wavs_examples", "missing_transcripts_examples")}
    return found.withColumns(text)


@query("SELECT e.name, d.source IS NOT NULL AS found FROM (SELECT unnest(['src0', 'src1', 'src19', 'src20', 'none']) AS name) e LEFT JOIN (SELECT DISTINCT source FROM documents) d ON d.source = e.name")
def artifact_check(spark, d):
    names = spark.createDataFrame([(x,) for x in ("src0", "src1", "src19", "src20", "none")], "name string")
    return names.join(_docs(spark, d).select(F.col("source").alias("name")).distinct().withColumn("has", F.lit(True)), "name", "left").select("name", F.col("has").isNotNull().alias("found"))


@query("SELECT doc_id, audio_path IS NOT NULL AS cached FROM documents LEFT JOIN (SELECT DISTINCT doc_id, 'x' AS audio_path FROM labels) USING (doc_id)")
def cache_lookup(spark, d):
    hit = table(spark, d, "labels").select("doc_id").distinct().withColumn("hit", F.lit(True))
    return _docs(spark, d).select("doc_id").join(hit, "doc_id", "left").select("doc_id", F.col("hit").isNotNull().alias("cached"))


@query("SELECT doc_id, 0 AS shard FROM labels UNION ALL SELECT doc_id, 1 FROM documents UNION ALL SELECT conv_id, 2 FROM conversations")
def shard_union(spark, d):
    """Three folders of shards, repeats included, read as one table."""
    folder = scratch_path(spark, "shards")
    for i, (name, key) in enumerate((("labels", "doc_id"), ("documents", "doc_id"), ("conversations", "conv_id"))):
        table(spark, d, name).select(F.col(key).alias("doc_id")).write.parquet(f"{folder}/shard={i}")
    return sinks.read_shards(spark, folder)


@query("WITH a AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 4096 AS shard FROM documents), n AS (SELECT max(shard) + 1 AS first FROM a) SELECT * FROM a UNION ALL SELECT conv_id, first + (row_number() OVER (ORDER BY conv_id, turn) - 1) // 4096 FROM conversations, n")
def shard_append(spark, d):
    """Shards of 4096 rows in order of their key, then more behind them."""
    folder = scratch_path(spark, "shards")
    sinks.append_shards(_docs(spark, d).select("doc_id"), folder, ["doc_id"])
    sinks.append_shards(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn"), folder, ["doc_id", "turn"])
    return sinks.read_shards(spark, folder).select("doc_id", "shard")


_ALLOWED = (0, 3, 4, 9, 17, 31, 32, 40, 63)


@query(f"SELECT vec_id, array_to_string(list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN i - 1 IN {_ALLOWED} THEN CAST(CAST(round(CAST(embedding[i] AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR) ELSE '-inf' END), ' ') AS scores FROM embeddings")
def token_mask(spark, d):
    shown = lambda x: F.when(x == float("-inf"), "-inf").otherwise(F.round(x * 1000000).cast("bigint").cast("string"))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(T.allowed_scores(F.col("embedding"), list(_ALLOWED)), shown), " ").alias("scores"))


@query(f"WITH {_TOK} SELECT count(*) AS lines, CAST(sum(len(s)) AS BIGINT) AS before, CAST(sum(len(g)) AS BIGINT) AS after, round(sum(len(s)) / sum(len(g)), 6) AS ratio FROM t")
def token_ratio(spark, d):
    return C.token_ratio(_tokens(spark, d), F.col("semantic_ids"), F.col("global_ids")).withColumn("ratio", F.round("ratio", 6))


def english_sql(m: str) -> str:
    """The English words of a number in ASCII digits, other ones as they are."""
    words = "[" + ", ".join(f"'{w}'" for w in spoken.below_hundred()) + "]"
    two = lambda n: f"CASE WHEN {n} > 0 THEN {words}[{n} + 1] END"
    parts = []
    for i, scale in enumerate(spoken.SCALES):
        n = f"CAST(substr(lpad(regexp_extract({m}, '[0-9]+'), 15, '0'), {1 + 3 * i}, 3) AS INTEGER)"
        own = f"concat_ws(' ', {two(f'({n} // 100)')} || ' hundred', {two(f'({n} % 100)')})"
        parts.append(f"nullif(concat_ws(' ', nullif({own}, ''), '{scale}'), '{scale}')" if scale else f"nullif({own}, '')")
    point = f"'point ' || array_to_string(list_transform(regexp_extract_all(regexp_extract({m}, '[.]([0-9]+)', 1), '[0-9]'), lambda x: {words}[CAST(x AS INTEGER) + 1]), ' ')"
    whole = f"concat_ws(' ', CASE WHEN {m}[1] = '-' THEN 'minus' END, coalesce(nullif(concat_ws(' ', {', '.join(parts)}), ''), 'zero'), CASE WHEN contains({m}, '.') THEN {point} END)"
    return f"CASE WHEN regexp_full_match({m}, '-?[0-9]{{1,15}}([.][0-9]+)?') THEN {whole} ELSE {m} END"


def _number_sql() -> str:
    pattern = r"-?\p{Nd}+(?:\.\p{Nd}+)?"
    spoken_list = f"list_transform(regexp_extract_all(text, '{pattern}'), lambda m: {english_sql('m')})"
    return f"SELECT doc_id, array_to_string(list_transform(list_zip(regexp_split_to_array(text, '{pattern}'), {spoken_list}), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '') AS words FROM documents"


@query(_number_sql())
def verbalize_numbers(spark, d):
    return _docs(spark, d).select("doc_id", spoken.verbalised(F.col("text")).alias("words"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding as the bytes of a WAV file."""
    return wav.encoded(table(spark, d, "embeddings"), "vec_id", "embedding", 16000)


_PCM = "CAST(round_even(greatest(-1, least(1, CAST(x AS DOUBLE))) * 32767, 0) AS BIGINT)"


@query(f"SELECT vec_id, true AS valid, CAST(44 + 2 * len(embedding) AS BIGINT) AS n_bytes, len(embedding) / 16000 AS seconds, array_to_string(list_transform(embedding, lambda x: {_PCM}), ' ') AS pcm FROM embeddings")
def wav_round_trip(spark, d):
    files = _files(spark, d)
    back = wav.decoded(files.withColumn("_key", F.struct("vec_id", wav.valid(F.col("content")).alias("valid"), F.length("content").cast("bigint").alias("n_bytes"))), "_key")
    pcm = F.transform("wave", lambda x: F.round(x.cast("double") * 32768).cast("bigint").cast("string"))
    return back.select("_key.*", "seconds", F.array_join(pcm, " ").alias("pcm"))


@query("SELECT vec_id, kind, kind = 'whole' AS valid FROM embeddings, (SELECT unnest(['whole', 'header', 'riff', 'wave', 'none']) AS kind)")
def wav_valid(spark, d):
    """Each file as it is, cut to its header, with either mark broken, and missing."""
    c = F.col("content")
    rest = lambda at: F.substring(c, F.lit(at), F.length(c))
    kinds = {"whole": c, "header": F.substring(c, 1, 44), "riff": F.concat(F.lit(b"RIFX"), rest(5)), "wave": F.concat(F.substring(c, 1, 8), F.lit(b"WAVX"), rest(13)), "none": F.lit(None).cast("binary")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("content")) for k, v in kinds.items()))).alias("f")
    return _files(spark, d).select("vec_id", each).select("vec_id", "f.kind", wav.valid(F.col("f.content")).alias("valid"))


_HEARD = "list_transform(embedding, lambda x: round_even(greatest(-1, least(1, CAST(x AS DOUBLE))) * 32767, 0) / 32768)"


@query(f"""WITH w AS (SELECT vec_id, {_HEARD} AS w FROM embeddings) SELECT vec_id, 64 / 16000 AS seconds, array_to_string(list_transform(w[1:32], lambda x: CAST(floor((x + 1) * 2048) AS INTEGER)), ' ') AS global_ids, array_to_string(list_transform(w, lambda x: CAST(floor((x + 1) * 4096) AS INTEGER)), ' ') AS semantic_ids FROM w""")
def score_files(spark, d):
    """WAV files through decoding and the stand-in scorer."""
    got = scoring.scored_files(_files(spark, d), "vec_id").where("error IS NULL")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return got.select("vec_id", "seconds", text("global_ids"), text("semantic_ids"))


@query(f"""WITH w AS (SELECT vec_id, {_HEARD} AS w FROM embeddings), t AS (SELECT vec_id, list_transform(w[1:32], lambda x: CAST(floor((x + 1) * 2048) AS INTEGER)) AS g FROM w)
SELECT item_id, '<|task_tts|><|start_content|>' || {_clean('text')} || '<|end_content|>' || {_SAID} AS prompt FROM benchmark LEFT JOIN t ON t.vec_id = item_id""")
def clone_prompts(spark, d):
    """Prompts that say each benchmark text in the voice of the file of the same number."""
    requests = table(spark, d, "benchmark").select("item_id", "text", F.col("item_id").alias("vec_id"))
    return api.clone(requests, _files(spark, d), "item_id", "vec_id")


@query("SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, text, lang AS domain FROM documents")
def transcript_parse(spark, d):
    entry = F.struct(F.col("text").alias("Transcript"), F.col("lang").alias("Domain"))
    files = _docs(spark, d).select("doc_id", F.to_json(F.struct(F.create_map(F.col("doc_id").cast("string"), entry).alias("Transcripts"))).alias("json"))
    return transcripts.parsed(files, "json", "doc_id")


@query("""SELECT vec_id, array_to_string(list_transform(embedding[1:32], lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 2048) AS INTEGER)), ' ') AS global_ids,
 array_to_string(list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 4096) AS INTEGER)), ' ') AS semantic_ids FROM embeddings""")
def codec_score(spark, d):
    got = scoring.scored(table(spark, d, "embeddings"), "vec_id", "embedding").where("error IS NULL")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return got.select("vec_id", text("global_ids"), text("semantic_ids"))


@query()
def synthesize(spark, d):
    """Speech of every benchmark text by the stand-in voice."""
    files = scoring.synthesised(table(spark, d, "benchmark"), "item_id", "text")
    return files.select("item_id", wav.valid(F.col("content")).alias("valid"), F.sha2("content", 256).alias("sha256"))


@query("SELECT vec_id, pos - 1 AS pos, round((x[pos] + x[pos + 16] + x[pos + 32] + x[pos + 48]) / 4, 6) AS mean FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, unnest(range(1, 17)) AS pos FROM embeddings)")
def layer_mix(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    mixed = W.layer_mean(*(F.slice(x, at, 16) for at in (1, 17, 33, 49)))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(mixed).alias("pos", "mean")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("mean", 6).alias("mean"))


_SPLIT = "list_filter(regexp_split_to_array(lower(text), '[^a-z<>]+'), lambda w: w <> '')"


@query(f"""WITH {_VOCAB.split(", n AS")[0]}, e AS (SELECT conv_id, turn, w, i FROM (SELECT conv_id, turn, unnest({_SPLIT}) AS w, unnest(range(len({_SPLIT}))) AS i FROM conversations)),
g AS (SELECT conv_id, turn, count(*) FILTER (b.id IS NULL) AS missing, string_agg(CAST(b.id AS VARCHAR), ' ' ORDER BY i) AS ids, len(list(DISTINCT w) FILTER (b.id IS NULL)) AS unknown FROM e LEFT JOIN b ON e.w = b.piece GROUP BY 1, 2)
SELECT c.conv_id, c.turn, CASE WHEN g.missing > 0 THEN NULL ELSE coalesce(g.ids, '') END AS ids, CAST(coalesce(g.unknown, 0) AS BIGINT) AS unknown FROM conversations c LEFT JOIN g USING (conv_id, turn)""")
def token_lookup(spark, d):
    base = numbered(_pieces(spark, d, "benchmark", "item_id"), [], ["k", "piece"], "id").select("piece", "id")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.filter(F.split(F.lower("text"), "[^a-z<>]+"), lambda w: w != "").alias("words"))
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids")
    return C.token_ids(rows, "words", base).select("conv_id", "turn", ids, F.size("unknown").cast("bigint").alias("unknown"))


@query("SELECT id, speaker, lang FROM (SELECT CAST(doc_id AS VARCHAR) AS id, 'P_' || source AS speaker, lang FROM documents) WHERE contains(speaker, 'src1')")
def speaker_dirs(spark, d):
    path = F.concat(F.lit("root/"), "lang", F.lit("/DATA/P_"), "source", F.lit("/wav/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    return wav.located(_docs(spark, d).select(path.alias("path")), "P_", "DATA", "src1").select("id", "speaker", "lang")


@query("""WITH g AS (SELECT o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT name, row_number() OVER (ORDER BY name) AS step, n <= (SELECT avg(n) FROM g) AS passed FROM g)
SELECT step, name, passed FROM c WHERE step <= coalesce((SELECT min(step) FROM c WHERE NOT passed), 1000)""")
def step_checks(spark, d):
    """Ordered checks (here that a priority has no more orders than the mean of all), up to the first that fails."""
    groups = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"))
    mean = groups.agg(F.avg("n")).first()[0]
    sizes = groups.select("name", (F.col("n") <= F.lit(mean)).alias("passed"))
    checks = numbered(sizes, [], ["name"], "at").select((F.col("at") + 1).alias("step"), "name", "passed")
    return C.checked_in_order(checks)
