"""Queries over vocabularies and numbers in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterlake.functions import spoken
from utterlake.functions import text as T
from utterlake.operators import corpus as C
from utterlake.operators import cutting
from utterlake.plans.catalogue import query
from utterlake.plans.registry import _clean, _MIXED, _OWN_LANG, _pieces, _WORDS, english_sql
from utterlake.runtime import numbered, table

_CODES = 8192
_VOCABULARY = f"v AS (SELECT piece, row_number() OVER (ORDER BY piece) - 1 AS id FROM ({_WORDS.format('item_id', 'benchmark')})), n AS (SELECT count(*) AS n FROM v)"


@query(f"""WITH {_VOCABULARY}, i AS (SELECT vec_id, id, embedding[(id * 7 + vec_id) % 64 + 1] AS score FROM embeddings, (SELECT n + unnest(range({_CODES})) AS id FROM n)),
b AS (SELECT vec_id, count(*) AS allowed, arg_min({{'id': id, 'score': score}}, {{'s': -CAST(score AS DOUBLE), 'id': id}}) AS best FROM i GROUP BY 1) SELECT vec_id, allowed, best.id AS best_id, round(CAST(best.score AS DOUBLE), 6) AS best_score FROM b""")
def codec_mask(spark, d):
    """The best of the codec tokens behind a vocabulary of words, for scores over all of it: over 8,000 ids are allowed."""
    words = numbered(_pieces(spark, d, "benchmark", "item_id").select("piece"), [], ["piece"], "id")
    n = words.count()
    codes = spark.range(_CODES).select(F.concat(F.lit("<|bicodec_semantic_"), F.col("id"), F.lit("|>")).alias("piece"), (F.col("id") + n).alias("id"))
    bits = T.bitmap(C.allowed_ids(words.unionByName(codes), F.startswith("piece", F.lit("<|bicodec_semantic_"))))
    scores = table(spark, d, "embeddings").repartition("vec_id").select("vec_id", F.expr(f"transform(sequence(0L, {n + _CODES - 1}L), i -> get(embedding, cast((i * 7 + vec_id) % 64 as int)))").alias("scores"))
    masked = scores.select("vec_id", T.allowed_scores(F.col("scores"), bits).alias("m")).withColumn("best", F.array_max("m"))
    allowed = F.size(F.filter("m", lambda x: x > float("-inf"))).cast("bigint")
    return masked.select("vec_id", allowed.alias("allowed"), (F.array_position("m", F.col("best")) - 1).alias("best_id"), F.round("best", 6).alias("best_score"))


def _cut_sql(vocabulary: str, name: str) -> str:
    """Pieces of each different word of the documents, cut by the longest piece of a vocabulary."""
    return f"""{name}_m AS MATERIALIZED (SELECT w, pos, max(k) AS k FROM (SELECT w, pos, unnest(range(1, 5)) AS k FROM (SELECT w, unnest(range(1, length(w) + 1)) AS pos FROM ws)) JOIN {vocabulary} ON piece = substr(w, pos, k) AND pos + k <= length(w) + 1 GROUP BY 1, 2),
 {name}_c AS (SELECT w, CAST(1 AS BIGINT) AS pos, 0 AS n FROM ws UNION ALL SELECT c.w, c.pos + coalesce(m.k, 1), c.n + 1 FROM {name}_c c LEFT JOIN {name}_m m ON m.w = c.w AND m.pos = c.pos WHERE c.pos <= length(c.w)),
 {name} AS (SELECT w, max(n) AS n FROM {name}_c GROUP BY 1)"""


#: A vocabulary of letters and the syllables that two tables begin their words with, so that texts need several pieces a word.
def _heads(spark, d, name: str):
    words = table(spark, d, name).select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("w")).where("w <> ''")
    heads = F.array(*(F.substring("w", 1, k) for k in (1, 2, 3, 4)))
    return words.select(F.explode(heads).alias("piece")).distinct()


def _heads_sql(name: str) -> str:
    return f"SELECT DISTINCT w[1:k] AS piece FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM {name}), (SELECT unnest([1, 2, 3, 4]) AS k) WHERE w <> ''"


_BLANKS = r"[ \t\n\x{0B}\f\r]+"


@query(f"""WITH RECURSIVE b AS MATERIALIZED ({_heads_sql('benchmark')}), a AS MATERIALIZED (SELECT piece FROM b UNION SELECT * FROM ({_heads_sql('conversations')})),
 e AS (SELECT unnest(regexp_split_to_array(text, '{_BLANKS}')) AS w FROM documents), u AS (SELECT w, count(*) AS k FROM e WHERE w <> '' GROUP BY 1), ws AS MATERIALIZED (SELECT w FROM u),
 {_cut_sql('b', 'before_')}, {_cut_sql('a', 'after_')}
SELECT (SELECT count(*) FROM documents) AS lines, CAST(sum(k * x.n) AS BIGINT) AS before, CAST(sum(k * y.n) AS BIGINT) AS after, round(sum(k * x.n) / sum(k * y.n), 6) AS ratio FROM u JOIN before_ x USING (w) JOIN after_ y USING (w)""")
def extension_ratio(spark, d):
    """Pieces that all documents are cut into before and after a vocabulary is extended by the new pieces of another table."""
    base = numbered(_heads(spark, d, "benchmark"), [], ["piece"], "id")
    more = numbered(_heads(spark, d, "conversations"), [], ["piece"], "id")
    new = C.new_vocabulary(base, more).select("piece", F.col("new_id").alias("id"))
    docs = table(spark, d, "documents").select("text")
    before = cutting.cut_texts(docs, "text", base).select("text", F.size("pieces").alias("before"))  # counts go through the second cut, not pieces
    both = cutting.cut_texts(before, "text", base.unionByName(new))
    return C.token_ratio(both, F.col("before"), F.col("pieces")).withColumn("ratio", F.round("ratio", 6))


_NUMBER = r"-?\p{Nd}+(?:\.\p{Nd}+)?"


def hindi_sql(m: str) -> str:
    """The Hindi words of a number in ASCII digits, other ones as they are."""
    words = "[" + ", ".join(f"'{w}'" for w in spoken.HINDI_BELOW_HUNDRED) + "]"
    padded, at, parts = f"lpad(regexp_extract({m}, '[0-9]+'), 15, '0')", 1, []
    for name, size in spoken.HINDI_GROUPS:
        n = f"CAST(substr({padded}, {at}, {size}) AS INTEGER)"
        parts.append(f"CASE WHEN {n} > 0 THEN {words}[{n} + 1] || '{f' {name}' if name else ''}' END")
        at += size
    point = f"'{spoken.HINDI_POINT} ' || array_to_string(list_transform(regexp_extract_all(regexp_extract({m}, '[.]([0-9]+)', 1), '[0-9]'), lambda x: {words}[CAST(x AS INTEGER) + 1]), ' ')"
    whole = f"concat_ws(' ', CASE WHEN {m}[1] = '-' THEN '{spoken.HINDI_MINUS}' END, coalesce(nullif(concat_ws(' ', {', '.join(parts)}), ''), {words}[1]), CASE WHEN contains({m}, '.') THEN {point} END)"
    return f"CASE WHEN regexp_full_match({m}, '-?[0-9]{{1,15}}([.][0-9]+)?') THEN {whole} ELSE {m} END"


def itrans_sql(word: str) -> str:
    """A word of Latin letters in Devanagari."""
    consonants = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in spoken._CONSONANTS.items() if k.isalpha()) + "}"
    vowels, signs = ("MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}" for table in (spoken._VOWELS, spoken._SIGNS))
    pattern = "|".join(sorted({k for k in (*spoken._VOWELS, *spoken._CONSONANTS) if k.isalpha()}, key=len, reverse=True)) + "|."
    one = f"CASE WHEN {consonants}[p] IS NOT NULL THEN CASE WHEN {consonants}[ps[i - 1]] IS NOT NULL THEN '्' ELSE '' END || {consonants}[p] WHEN {consonants}[ps[i - 1]] IS NOT NULL AND {signs}[p] IS NOT NULL THEN {signs}[p] ELSE CASE WHEN {consonants}[ps[i - 1]] IS NOT NULL THEN '्' ELSE '' END || coalesce({vowels}[p], p) END"
    return f"list_transform([regexp_extract_all(lower({word}), '{pattern}')], lambda ps: array_to_string(list_transform(ps, lambda p, i: {one}), '') || CASE WHEN {consonants}[ps[-1]] IS NOT NULL THEN '्' ELSE '' END)[1]"


@query(f"SELECT doc_id, array_to_string(list_transform(list_zip(regexp_split_to_array(text, '{_NUMBER}'), list_transform(regexp_extract_all(text, '{_NUMBER}'), lambda m: {hindi_sql('m')})), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '') AS words FROM documents")
def verbalize_hindi(spark, d):
    return table(spark, d, "documents").select("doc_id", spoken.verbalised(F.col("text"), spoken.hindi_number).alias("words"))


#: Numbers, runs of letters and single other signs. A run of Latin letters is a word where no digit touches it.
_RUNS = r"-?\p{Nd}+(?:\.\p{Nd}+)?|[\p{L}\p{M}_]+|[^\p{L}\p{M}\p{Nd}_]"
_BOTH = f"""CASE WHEN regexp_matches(m, '[0-9]$') THEN CASE own WHEN 'hi' THEN {hindi_sql('m')} WHEN 'en' THEN {english_sql('m')} ELSE m END
 WHEN regexp_full_match(m, '[a-zA-Z]{{2,}}') AND NOT regexp_matches(coalesce(ms[i - 1], ''), '\\p{{Nd}}$') AND NOT regexp_matches(coalesce(ms[i + 1], ''), '^\\p{{Nd}}') THEN {itrans_sql('m')} ELSE m END"""


@query(f"WITH {_MIXED}, r AS (SELECT doc_id, own, regexp_extract_all(normal, '{_RUNS}') AS ms FROM mixed JOIN t USING (doc_id)) SELECT doc_id, {_clean(f'array_to_string(list_transform(ms, lambda m, i: {_BOTH}), {chr(39) * 2})')} AS spoken FROM r")
def normalize_spoken(spark, d):
    """Normalised in each row's language, numbers as words of it, Latin words in Devanagari, in one pass."""
    said = spoken.processed(F.col("text"), F.expr(_OWN_LANG), spoken.NUMBER_WORDS, spoken.itrans)
    return table(spark, d, "documents").select("doc_id", said.alias("spoken"))
