"""Document fingerprints from closed syncmers, in DataFrame functions only.

A k-mer is WORDS words in a row, its inner substrings the pairs of neighbouring words in it. It is an anchor where its
least pair (by hash) is its first or its last one: that depends on the k-mer alone, so the same passage gives the same
anchors in any text. A fingerprint is all anchors in order, each with its step from the one before, so every hash and place
is in it. Anchors of two texts match where their relative positions do: the same anchor, followed by the same next one as
many words on. Likeness is the Jaccard index of these links, each counted as often as it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterlake.runtime import bucket_of, let, splitters, table, tasks_for

WORDS = 5


def anchors(text: Column) -> Column:
    """array<struct<place int, hash bigint>>: the anchors in order, place counted in words from 0.

    A text of 1 to WORDS - 1 words is one anchor; one without words, or null, has none. Letter case and the kind of white
    space make no difference.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return let(F.transform(words, lambda w: F.xxhash64(w)), _placed)


def _placed(hashes: Column) -> Column:
    n = F.size(hashes)
    pairs = F.zip_with(F.slice(hashes, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(hashes, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    def chosen(s: Column) -> Column:
        at = [lambda i, k=k: F.get(s, i + k) for k in range(WORDS - 1)]
        edge = lambda i: F.least(at[0](i), at[-1](i)) <= F.least(*(a(i) for a in at[1:-1]))
        return F.transform(F.filter(F.sequence(F.lit(0), n - WORDS), edge), lambda i: F.struct(i.alias("place"), F.xxhash64(at[0](i), at[1](i), at[-1](i)).alias("hash")))

    whole = F.when(n > 0, F.array(F.struct(F.lit(0).alias("place"), F.xxhash64(hashes).alias("hash")))).otherwise(F.array().cast("array<struct<place:int,hash:bigint>>"))
    return F.when(n >= WORDS, let(pairs, chosen)).otherwise(whole)


def packed(text: Column) -> Column:
    """array<bigint>: all anchors in order, the upper 32 bits of the hash, then 4 bits for the words since the anchor before.

    The first anchor counts from place 0. Of any WORDS - 2 k-mers in a row one is an anchor, so no step is above WORDS - 2.
    """
    steps = lambda own: F.transform(own, lambda a, i: F.shiftleft(F.shiftrightunsigned(a["hash"], 32), 4).bitwiseOR((a["place"] - F.coalesce(F.get(own, i - 1)["place"], F.lit(0))).cast("long")))
    return let(anchors(text), steps)


def links(own: Column) -> Column:
    """packed anchors -> array<bigint>, ascending: a hash of each anchor, the next one and the words between; the last has no next."""
    return F.sort_array(F.transform(own, lambda a, i: F.xxhash64(F.shiftrightunsigned(a, 4), F.coalesce(F.get(own, i + 1), F.lit(-1)))))


def as_string(own: Column) -> Column:
    """9 hex digits for each anchor: 8 of its hash, 1 of the words since the anchor before."""
    return F.lower(F.array_join(F.transform(own, lambda x: F.lpad(F.hex(x), 9, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, the Jaccard index of two arrays of numbers, each counted as often as it occurs; two empty ones are alike."""
    tagged = lambda x, side: F.transform(x, lambda v: F.shiftleft(v.cast("long"), 1).bitwiseOR(F.lit(side).cast("long")))
    start = F.struct(F.lit(None).cast("long").alias("value"), F.lit(0).alias("spare"), F.lit(0).alias("common"))

    def step(s: Column, v: Column) -> Column:
        value, right = F.shiftright(v, 1), v.bitwiseAND(F.lit(1)) == 1
        spare = F.when(s["value"].eqNullSafe(value), s["spare"]).otherwise(0)
        match = right & (spare > 0)
        return F.struct(value.alias("value"), (spare + F.when(~right, 1).when(match, -1).otherwise(0)).alias("spare"), (s["common"] + match.cast("int")).alias("common"))

    common = F.aggregate(F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))), start, step, lambda s: s["common"])
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(let(common, lambda c: c / (n - c)))


def followed(spark: SparkSession, docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, Window]:
    """docs with _bucket, _visit and a window whose lead() is the next row in descending key, the first after the last.

    Rows are dealt to ranges of the key; the first row of each range also visits the range above it, and the very first
    row the lowest range, so one exchange serves and no window spans more than a range. Drop the visitors (_visit = 1)
    after the window. Null keys come last, equal keys by a hash of their text.
    """
    n = 4 * max(2, tasks_for(docs))
    cuts = splitters(docs, key, n)
    top = docs.agg(F.max(key)).first()[0]
    bucket, k = bucket_of(F.col(key), cuts), F.col(key)
    if cuts:
        first = F.array(*map(F.lit, cuts))
        above = F.when(k == F.get(first, F.col("_own")), F.struct((F.col("_own") + 1).alias("_bucket"), F.lit(1).alias("_visit")))
    else:
        above = F.lit(None).cast("struct<_bucket:int,_visit:int>")
    around = F.when(k == F.lit(top), F.struct(F.lit(0).alias("_bucket"), F.lit(1).alias("_visit")))
    own = F.struct(F.col("_own").alias("_bucket"), F.lit(0).alias("_visit"))
    dealt = docs.withColumn("_own", bucket).withColumn("_at", F.explode(F.array_compact(F.array(own, above, around)))).select(*docs.columns, "_at._bucket", "_at._visit")
    return dealt, Window.partitionBy("_bucket").orderBy("_visit", k.desc_nulls_last(), F.xxhash64("text"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document
    in descending doc_id, the first following the last. Null texts are empty, and an empty text has an empty fingerprint.
    Null ids come last; rows of equal ids, repeated rows too, follow each other by a hash of their text and each give a
    row; where all ids are null the last row is followed by an empty text. Other columns are ignored; an empty table gives
    an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt, after = followed(docs.sparkSession, rows)
    n = F.length("text")
    paired = dealt.select("*", F.coalesce(F.lead("text").over(after), F.lit("")).alias("following"), n.alias("n"), F.floor(n / 2).cast("int").alias("half"))
    edited = paired.select("_bucket", "_visit", "doc_id", "text", "n", packed(F.col("text")).alias("own"), F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("half")), F.substring("following", F.lit(1), F.col("half"))).alias("edited"))
    linked = edited.select("*", links(F.col("own")).alias("links"))
    both = linked.select("*", F.lead("links").over(after).alias("next_links")).where("_visit = 0")
    made = both.select("doc_id", "n", F.sha2("edited", 256).alias("edited_sha256"), "own", "links", packed(F.col("edited")).alias("other"), F.coalesce("next_links", F.array().cast("array<bigint>")).alias("next_links"))
    return made.select("*", links(F.col("other")).alias("other_links")).select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", as_string(F.col("own")).alias("fingerprint"), as_string(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("links"), F.col("other_links")).alias("near_edited"), likeness(F.col("links"), F.col("next_links")).alias("near_next"),
    )


QUERIES = {"op4_syncmer_fingerprint": lambda spark, sf_dir: fingerprint_edits(table(spark, sf_dir, "documents"))}
ORACLES: dict = {}
