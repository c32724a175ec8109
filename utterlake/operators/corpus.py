"""Corpus operators: manifest, selection, pairing, training rows, caches, vocabulary and layout."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from utterlake.functions import text as T
from utterlake.operators.overlap import overlapped
from utterlake.runtime import free_names, materialize, numbered

LEAST_SECONDS, MOST_SECONDS = 0.05, 30.0
#: A vocabulary of up to so many pieces and bytes goes to the workers; a larger one is joined.
SHIPPED_PIECES, SHIPPED_BYTES = 250_000, 32 << 20
#: Ids below this can be in a mask: 64 k words, half a megabyte of the plan.
MOST_IDS = 1 << 22
START_GLOBAL, END_GLOBAL, START_SEMANTIC, END_SEMANTIC, IM_END = 900001, 900002, 900003, 900004, 900005


def utterances(docs: DataFrame) -> DataFrame:
    """Manifest rows from documents: speaker is the source, duration 150 characters a second."""
    return docs.select(
        "doc_id", F.concat(F.lit("datasets/"), "lang", F.lit("/corpus/"), "source", F.lit("/wav/"), "doc_id", F.lit(".wav")).alias("audio_path"),
        "text", F.col("source").alias("speaker"), "lang", (F.col("n_chars") / F.lit(150.0).cast("double")).alias("duration"),
    )


def classified(manifest: DataFrame, transcripts: DataFrame, key: str = "doc_id") -> DataFrame:
    """manifest with status: the first that holds of no_transcript, empty_text, duration_filtered, else ok."""
    (mark,) = free_names(manifest, "_known")
    known = transcripts.select(key).distinct().withColumn(mark, F.lit(True))
    d = F.col("duration")
    status = (
        F.when(F.col(mark).isNull(), "no_transcript").when(F.coalesce(T.clean(F.col("text")), F.lit("")) == "", "empty_text")
        .when(d.isNull() | ~d.between(LEAST_SECONDS, MOST_SECONDS), "duration_filtered").otherwise("ok")
    )
    return manifest.join(known, key, "left").withColumn("status", status).drop(mark)


def shuffle_key(key: Column, seed: str = "42") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def capped(rows: DataFrame, by: str, k: int, key: str = "doc_id", seed: str = "42") -> DataFrame:
    """The first k rows of each group in shuffled order; the group limit runs before the shuffle too."""
    return _first_rows(rows, Window.partitionBy(F.coalesce(by, F.lit(""))).orderBy(shuffle_key(F.col(key), seed), key), k)


def _first_rows(rows: DataFrame, w, k: int) -> DataFrame:
    (n,) = free_names(rows, "_n")
    return rows.withColumn(n, F.row_number().over(w)).where(F.col(n) <= k).drop(n)


def balanced(rows: DataFrame, base: list[str], share: float, key: str = "doc_id", seed: str = "42") -> DataFrame:
    """Rows of the base languages capped to int(share / (1 - share) * others), in shuffled order; no cap where that says nothing."""
    if not (0 < share < 1 and base):
        return rows
    is_base = F.coalesce(F.col("lang").isin(base), F.lit(False))
    others = rows.where(~is_base).count()
    if not others:
        return rows
    return _base_capped(rows, base, int(share / (1 - share) * others), key, seed)


def balanced_capped(rows: DataFrame, base: list[str], share: float, k: int | None, key: str = "doc_id", seed: str = "42") -> DataFrame:
    """Both caps in one pass over the shuffled rows: k a language, then the base languages' together; their cap comes from the counts before either."""
    others = rows.where(~F.coalesce(F.col("lang").isin(base), F.lit(False))).count() if 0 < share < 1 and base else 0
    left = rows if k is None else capped(rows, "lang", k, key, seed)
    return _base_capped(left, base, int(share / (1 - share) * others), key, seed) if others else left


def _base_capped(rows: DataFrame, base: list[str], most: int, key: str, seed: str) -> DataFrame:
    is_base = F.coalesce(F.col("lang").isin(base), F.lit(False))
    (at,) = free_names(rows, "_at")
    return rows.where(~is_base).unionByName(numbered(rows.where(is_base), [], [shuffle_key(F.col(key), seed), key], at).where(F.col(at) < most).drop(at))


def sampling_mode(available: DataFrame, base: list[str], wanted: str, by: str = "lang") -> str:
    """wanted, but proportional where languages are there and none of them is a base one."""
    found = available.select(by).where(F.col(by).isNotNull())
    none_of_base = found.where(F.col(by).isin(base)).isEmpty() if base else True
    return "proportional" if none_of_base and not found.isEmpty() else wanted


def split_validation(rows: DataFrame, share: float, key: str = "doc_id", seed: str = "7") -> DataFrame:
    """rows with is_val for exactly clamp(round(n * share), 1, n - 1) of them, repeated keys too; none where n < 2 or share <= 0."""
    n = rows.count()
    take = 0 if n < 2 or share <= 0 else max(1, min(n - 1, round(n * share)))
    if not take:
        return rows.withColumn("is_val", F.lit(False))
    (at,) = free_names(rows, "_at")
    return numbered(rows, [], [shuffle_key(F.col(key), seed), key], at).withColumn("is_val", F.col(at) < take).drop(at)


def references(rows: DataFrame, chance: str = "0.8", key: str = "audio_path", pool_limit: int | None = None) -> DataFrame:
    """(key, speaker, ref) for each row: a reference of the same speaker, by hashes of the key; itself with probability 1 - chance, or alone.

    A speaker's pool is its rows by key, repeated ones too, or the first pool_limit of them. Where the row that a hash names
    has the row's own key, the one after it in the pool is taken. Rows without a speaker or a key keep their own key. A
    count per speaker and a numbered pool joined on (speaker, number): no pairs within a speaker are made, and a speaker of
    any size spreads over many tasks.
    """
    given = rows.select(F.col(key).alias("k"), F.col("speaker").alias("s"))
    pool = materialize(numbered(given.where((F.coalesce("s", F.lit("")) != "") & F.col("k").isNotNull()), ["s"], ["k"], "at"), "pool")
    if pool_limit:
        pool = pool.where(F.col("at") < pool_limit)
    sizes = pool.groupBy("s").agg(F.count("*").alias("n"))
    after = pool.join(sizes, "s").select("s", F.pmod(F.col("at") - 1, F.col("n")).alias("at"), F.col("k").alias("after"))
    refs = pool.withColumnRenamed("k", "ref").join(after, ["s", "at"])
    u = T.hash32(F.concat(F.lit("refsel:"), "k")) / F.lit(4294967295.0).cast("double")
    itself = -1 - F.pmod(F.xxhash64("k"), F.lit(4096))  # no place of the pool; many, so these rows do not meet in one task
    at = F.when((u < float(chance)) & (F.col("n") > 1), T.hash32(F.concat(F.lit("refidx:"), "k")) % F.col("n")).otherwise(itself)
    placed = given.join(sizes, "s", "left").withColumn("at", at)
    chosen = F.when(F.col("ref") == F.col("k"), F.col("after")).otherwise(F.coalesce("ref", "k"))
    return placed.join(refs, ["s", "at"], "left").select(F.col("k").alias(key), F.col("s").alias("speaker"), chosen.alias("ref"))


def pool(rows: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """The first k rows of each group in that order; the group limit runs before the shuffle too."""
    return _first_rows(rows, Window.partitionBy(by).orderBy(order), k)


def cloning_pairs(rows: DataFrame, key: str, speaker: str, draws: int = 10) -> DataFrame:
    """(speaker, draw, ref, target): up to draws seeded pairs of two different utterances of each speaker, never more than it has.

    A draw names two numbers, which are joined to the numbered utterances: no pairs within a speaker are made.
    """
    p = materialize(numbered(rows.select(F.col(key).alias("_key"), F.col(speaker).alias("speaker")), ["speaker"], ["_key"], "i"), "pool")
    sizes = p.groupBy("speaker").agg(F.count("*").alias("n")).where("n >= 2")
    drawn = sizes.select("speaker", "n", F.explode(F.expr(f"sequence(0L, least({draws}L, n * (n - 1) div 2) - 1)")).alias("draw"))
    a, b = (T.hash32(F.concat_ws(":", F.lit(x), "speaker", "draw")) for x in "ab")
    placed = drawn.withColumn("a", a % F.col("n")).withColumn("b0", b % (F.col("n") - 1)).withColumn("b", F.when(F.col("b0") >= F.col("a"), F.col("b0") + 1).otherwise(F.col("b0")))
    x, y = (p.select("speaker", F.col("i").alias(place), F.col("_key").alias(name)) for place, name in (("a", "ref"), ("b", "target")))
    return placed.join(x, ["speaker", "a"]).join(y, ["speaker", "b"]).select("speaker", "draw", "ref", "target")


def within_length(rows: DataFrame, tokens: Column, most: int) -> DataFrame:
    """Rows of at most that many tokens."""
    return rows.where(F.size(tokens) <= most)


def corpus_lines(docs: DataFrame, text: str = "text", least: int = 5) -> DataFrame:
    """Cleaned texts longer than least, repeats included; distinct() makes them the corpus."""
    return docs.select(T.clean(F.col(text)).alias("text")).where(F.length("text") > least)


def cached(manifest: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, Observation]:
    """Rows of manifest joined to the cache's, and an observation with rows and misses once the result has been computed.

    cache: one row a key. The manifest's rows without one are counted and go.
    """
    seen = Observation("cached")
    hit = max(free_names(manifest, "_hit") + free_names(cache, "_hit"), key=len)
    both = manifest.join(cache.withColumn(hit, F.lit(True)), key, "left")
    counted = both.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(hit).isNull()).alias("misses"))
    return counted.where(F.col(hit)).drop(hit), seen


def refused(prompt: Column, most: int) -> Column:
    """Why a row of tokens makes no training row; null where it makes one."""
    none = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    context = F.size(prompt) + F.size("global_ids") + 3
    return F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty_text").when(none("global_ids"), "no_global_ids").when(none("semantic_ids"), "no_semantic_ids").when(F.lit(most) - context <= 2, "no_room")


def tolerant(rows: DataFrame, reason: Column, name: str = "errors") -> tuple[DataFrame, DataFrame, Observation]:
    """(rows without a reason, rows with one and their reason, an observation of rows and errors for when the first has been computed).

    The reason is the column reason, replacing one of that name among the refused rows; good rows keep all of theirs.
    """
    seen = Observation(name)
    (mark,) = free_names(rows, "_reason")
    marked = rows.withColumn(mark, reason)
    good = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(mark).alias("errors"))
    return good.where(F.col(mark).isNull()).drop(mark), marked.where(F.col(mark).isNotNull()).drop("reason").withColumnRenamed(mark, "reason"), seen


def training_rows(tokens: DataFrame, prompt: Column, most: int) -> DataFrame:
    """input_ids, attention_mask, labels with the context masked by -100; rows whose context leaves room for fewer than 3 go."""
    start = F.concat(prompt, F.array(F.lit(START_GLOBAL)), "global_ids", F.array(F.lit(END_GLOBAL), F.lit(START_SEMANTIC)))
    rows = tokens.where((F.size("global_ids") > 0) & (F.size("semantic_ids") > 0)).withColumn("_ctx", start).withColumn("_room", F.lit(most) - F.size("_ctx")).where("_room > 2")
    tail = F.concat(F.slice("semantic_ids", F.lit(1), F.col("_room") - 2), F.array(F.lit(END_SEMANTIC), F.lit(IM_END)))
    return (
        rows.withColumn("_tail", tail).withColumn("input_ids", F.concat("_ctx", "_tail")).withColumn("labels", F.concat(F.array_repeat(F.lit(-100), F.size("_ctx")), "_tail"))
        .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))).drop("_ctx", "_room", "_tail")
    )


def legacy_training_rows(tokens: DataFrame, prompt: Column, most: int) -> DataFrame:
    """Prompt and completion cut to most; a prompt that fills it masks every label."""
    whole = F.slice(F.concat(prompt, "semantic_ids"), 1, most)
    rows = tokens.withColumn("input_ids", whole).withColumn("_n", F.least(F.size(prompt), F.size("input_ids")))
    labels = F.concat(F.array_repeat(F.lit(-100), F.col("_n")), F.slice("input_ids", F.col("_n") + 1, F.greatest(F.size("input_ids") - F.col("_n"), F.lit(0))))
    return rows.withColumn("labels", labels).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))).drop("_n")


def crossfaded(chunks: DataFrame, group: str, order: str, wave: str, overlap: int) -> DataFrame:
    """(group, pos, sample): chunks added up with linear ramps over the overlap, see overlap.overlapped, one row a sample at the very end."""
    pieces = overlapped(chunks, group, order, wave, overlap)
    return pieces.select(group, "at", F.posexplode("wave").alias("_i", "sample")).select(group, (F.col("at") + F.col("_i")).alias("pos"), "sample")


def first_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """Union of caches; of rows with one key that of the earliest source stays."""
    ranked = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    both = ranked[0]
    for r in ranked[1:]:
        both = both.unionByName(r)
    return both.groupBy(key).agg(F.min_by(F.struct(*sources[0].columns), "_rank").alias("_row")).select("_row.*")


def new_vocabulary(base: DataFrame, pieces: DataFrame) -> DataFrame:
    """pieces(piece, id) that are neither special (<...>) nor in base(piece, id), with new ids behind base's in order of id."""
    special = F.startswith("piece", F.lit("<")) & F.endswith("piece", F.lit(">"))
    size = base.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("n")).first().n
    new = numbered(pieces.where(~special).join(base, "piece", "left_anti").select("piece", "id"), [], ["id"], "_at")
    return new.select("piece", "id", (F.col("_at") + size).cast("bigint").alias("new_id"))


def new_embeddings(old: DataFrame, vector: str, n: int, seed: str, noise: float = 0.01) -> DataFrame:
    """(new_id, pos, value): n new rows, the mean of the old ones and normal noise, which is drawn from seed, row and place alone."""
    mean = old.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    each = mean.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("new_id"), F.col("pos").cast("bigint").alias("pos"), "mean")
    name = F.md5(F.concat_ws(":", F.lit(seed), "new_id", "pos"))
    u, v = ((F.conv(F.substring(name, at, 8), 16, 10).cast("bigint") + 1) / F.lit(4294967297.0) for at in (1, 9))
    return each.select("new_id", "pos", (F.col("mean") + noise * F.sqrt(-2 * F.log(u)) * F.cos(2 * F.lit(math.pi) * v)).alias("value"))


def allowed_ids(vocabulary: DataFrame, allowed: Column) -> list[int]:
    """The words of a bitmap over the ids of vocabulary(piece, id) for which allowed holds; negative and null ids have no place in it.

    Bits are put together in the tasks, so a word for each 64 ids comes to the driver, which the largest id bounds.
    """
    ids = vocabulary.where(allowed & (F.col("id") >= 0)).select(F.col("id").cast("long").alias("i"))
    top = ids.agg(F.max("i")).first()[0]
    if top is None:
        return []
    if top >= MOST_IDS:
        raise ValueError(f"id {top}: a mask holds ids below {MOST_IDS}")
    words = ids.groupBy(F.shiftright("i", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("w"))
    found = dict(map(tuple, words.collect()))
    return [found.get(k, 0) for k in range((top >> 6) + 1)]


def token_ids(rows: DataFrame, tokens: str, vocabulary: DataFrame) -> DataFrame:
    """rows with ids, those of its array of tokens in their order by vocabulary(piece, id), and unknown, the tokens without one.

    A row with an unknown token has null ids, so a caller can count and skip it. A null token's id is null, and it is not
    among the unknown. Of a piece with several ids the least counts. Columns named ids and unknown are replaced. The
    vocabulary's size decides whether tokens are looked up where they are or joined; the result is the same.
    """
    known = vocabulary.where("piece IS NOT NULL").groupBy("piece").agg(F.min("id").alias("id"))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("piece") + 8), F.lit(0)).alias("bytes")).first()
    given = rows.drop("ids", "unknown") if {"ids", "unknown"} & set(rows.columns) else rows
    return _ids_looked_up(given, tokens, known) if size.n <= SHIPPED_PIECES and size.bytes <= SHIPPED_BYTES else _ids_joined(given, tokens, known)


def _ids_looked_up(rows: DataFrame, tokens: str, vocabulary: DataFrame) -> DataFrame:
    """token_ids without a shuffle."""
    known = vocabulary.toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((known["piece"].combine_chunks(), known["id"].combine_chunks()))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, numbers = shared.value
        for b in batches:
            lists = b.column(tokens)
            flat = lists.flatten()
            at = pc.index_in(flat, value_set=pieces.cast(flat.type))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            unknown: list[set[str]] = [set() for _ in range(b.num_rows)]
            missing = np.flatnonzero(pc.and_(pc.is_null(at), pc.is_valid(flat)).to_numpy(zero_copy_only=False))
            for row, piece in zip(np.repeat(np.arange(b.num_rows), sizes)[missing].tolist(), flat.take(pa.array(missing)).to_pylist(), strict=True):
                unknown[row].add(piece)
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            ids = pa.ListArray.from_arrays(ends, numbers.take(at), mask=pa.array([bool(x) for x in unknown], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sorted(x) for x in unknown], pa.list_(pa.string())), ids], names=[*b.schema.names, "unknown", "ids"])

    return rows.mapInArrow(look_up, StructType([*rows.schema.fields, StructField("unknown", ArrayType(StringType())), StructField("ids", ArrayType(vocabulary.schema["id"].dataType))]))


def _ids_joined(rows: DataFrame, tokens: str, vocabulary: DataFrame) -> DataFrame:
    """token_ids by a join of each token. Rows are numbered, so equal rows stay apart."""
    row, at, mine, unseen = free_names(rows, "_row", "_at", "_ids", "_unknown")
    given = materialize(rows.withColumn(row, F.monotonically_increasing_id()), "token-rows")
    each = given.select(row, F.posexplode(tokens).alias(at, "piece")).join(vocabulary, "piece", "left")
    found = each.groupBy(row).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(at, "id"))), lambda x: x["id"]).alias(mine),
        F.array_sort(F.collect_set(F.when(F.col("id").isNull(), F.col("piece")))).alias(unseen),
    )
    none = F.array().cast("array<string>")
    joined = given.join(found, row, "left").withColumn("unknown", F.coalesce(unseen, none))
    ids = F.when(F.size("unknown") == 0, F.coalesce(mine, F.array().cast(found.schema[mine].dataType)))
    return joined.withColumn("ids", ids).drop(row, mine, unseen)


def token_ratio(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """One row: lines, tokens before and after (arrays of tokens, or their counts), and how many of the former one of the latter stands for."""
    given = rows.select(before.alias("b"), after.alias("a"))
    counts = {f.name: (F.size(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name)).cast("long") for f in given.schema}
    sums = given.withColumns(counts).agg(F.count("*").alias("lines"), F.sum("b").alias("before"), F.sum("a").alias("after"))
    return sums.withColumn("ratio", F.when(F.col("after") > 0, F.col("before") / F.col("after")))


def orphans(wavs: DataFrame, transcripts: DataFrame, group: str, key: str, examples: int = 3) -> DataFrame:
    """(group, missing_wavs, missing_transcripts, and the first few keys of each) for every group: keys that stand on one side only.

    wavs and transcripts have (group, key). A group's keys are counted and its least ones ranked before the shuffle.
    """
    sides = wavs.select(group, key).distinct().withColumn("_wav", F.lit(1)).unionByName(transcripts.select(group, key).distinct().withColumn("_wav", F.lit(0)))
    alone = sides.groupBy(group, key).agg(F.max("_wav").alias("_wav"), F.count("*").alias("_n")).withColumn("_alone", F.col("_n") == 1)
    marked = materialize(alone.select(group, key, F.when(F.col("_alone"), F.when(F.col("_wav") == 1, "missing_transcripts").otherwise("missing_wavs")).alias("_what")), "sides")
    w = Window.partitionBy(group, "_what").orderBy(key)
    first = marked.where("_what IS NOT NULL").withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= examples)
    kinds = ("missing_wavs", "missing_transcripts")
    few = first.groupBy(group).agg(*(F.sort_array(F.collect_list(F.when(F.col("_what") == k, F.col(key)))).alias(f"{k}_examples") for k in kinds))
    counts = marked.groupBy(group).agg(*(F.count_if(F.col("_what") == k).alias(k) for k in kinds))
    none = F.array().cast(few.schema[f"{kinds[0]}_examples"].dataType)
    return counts.join(few, group, "left").withColumns({f"{k}_examples": F.coalesce(f"{k}_examples", none) for k in kinds})


# Names of the folders that a corpus comes in.
_OUTER, _SPICOR, _PREFIX, _SPICOR_PREFIX = "IISc_SYSPIN_Data", "IISc_SPICOR_Data", "IISc_SYSPINProject_", "IISc_SPICORProject_"


def move_plan(dirs: DataFrame, path: str = "path") -> DataFrame:
    """(src, dst, kind, action) for each speaker folder that lies too deep: dirs has all folders as <lang>/..., no file is touched.

    Folders of the inner SYSPIN folder go up one level, those of SPICOR beside them under a new name. action is
    skip_exists where the target is there already, else move. Counters are counts by (kind, action).
    """
    p = F.split(path, "/")
    lang, outer, inner, name = (F.try_element_at(p, F.lit(i)) for i in (-4, -3, -2, -1))
    found = dirs.where(T.language_dir(lang) & (outer == inner)).select(F.col(path).alias("src"), F.concat_ws("/", F.slice(p, F.lit(1), F.size(p) - 3)).alias("_root"), outer.alias("_outer"), name.alias("_name"))
    new = F.when((F.col("_outer") == _OUTER) & F.startswith("_name", F.lit(_PREFIX)), F.struct(F.lit("syspin").alias("kind"), F.col("_name").alias("name"))).when(
        (F.col("_outer") == _SPICOR) & F.startswith("_name", F.lit(_SPICOR_PREFIX)), F.struct(F.lit("spicor").alias("kind"), F.concat(F.lit(f"{_PREFIX}SPICOR_"), F.substring("_name", F.lit(len(_SPICOR_PREFIX) + 1), F.length("_name"))).alias("name"))
    )
    planned = found.withColumn("_new", new).where("_new IS NOT NULL").select("src", F.concat_ws("/", "_root", F.lit(_OUTER), "_new.name").alias("dst"), "_new.kind")
    there = dirs.select(F.col(path).alias("dst")).distinct().withColumn("_there", F.lit(True))
    return planned.join(there, "dst", "left").select("src", "dst", "kind", F.when(F.col("_there"), "skip_exists").otherwise("move").alias("action"))


def latest_checkpoints(paths: DataFrame, path: str = "path") -> DataFrame:
    """(folder, step, path) of the highest numbered checkpoint-<step> in each folder; other paths go."""
    step = F.regexp_extract(path, r"/checkpoint-(\d+)$", 1)
    rows = paths.where(step != "").select(F.regexp_replace(path, r"/checkpoint-\d+$", "").alias("folder"), step.cast("long").alias("step"), F.col(path).alias("path"))
    return rows.groupBy("folder").agg(F.max("step").alias("step"), F.max_by("path", "step").alias("path"))


def resume_point(checkpoints: DataFrame, out: str, explicit: str | None = None) -> tuple[str | None, int]:
    """(path, phase) to go on from: the explicit path (phase 1 if it names phase1), else the latest of phase 2 in out, else of out/phase1, else none."""
    if explicit:
        return explicit, 1 if "phase1" in explicit else 2
    last = {r.folder: r.path for r in latest_checkpoints(checkpoints).where(F.col("folder").isin(out, f"{out}/phase1")).collect()}
    return (last[out], 2) if out in last else (last.get(f"{out}/phase1"), 1)


def checked_in_order(checks: DataFrame) -> DataFrame:
    """checks(step, name, passed) up to and with the first that failed."""
    first = checks.where("NOT passed").agg(F.min("step").alias("_first"))
    return checks.join(F.broadcast(first), F.col("_first").isNull() | (F.col("step") <= F.col("_first"))).drop("_first")
