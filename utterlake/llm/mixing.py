"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token weights of the cells (source, language, topic) are raked to the three marginals in turn; then each document comes as
often as its cell's calibrated rate asks for: KEEP times the rate, the whole part for certain and the rest by a hash of its
id. So a cell that must grow repeats its documents, and the sample's tokens follow the targets in every marginal. Cells are
as many as the combinations that occur: up to BROADCAST_CELLS are raked in one task without a shuffle, more by sums that
are shuffled and joined. Documents are aggregated to cells before any shuffle, whatever the source's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterlake.runtime import materialize, table

TEMPER, KEEP, SEED = 0.7, 0.8, "mix"
#: Sweeps between checks of the marginals, checks at most, and the share of all tokens that a value may be off by.
SWEEPS, CHECKS, TOLERANCE = 12, 4, 1e-6
BY = ("source", "lang", "topic")
#: Up to so many cells are raked in one task and broadcast to the documents; more are raked and joined by shuffles.
BROADCAST_CELLS = 50_000
_WORD = r"[^\t\n\x0B\f\r ]+"
_TOPIC = """CASE WHEN contains({text}, ' | ') THEN 'table' WHEN contains({text}, 'icense') OR contains({text}, 'ights reserved') THEN 'notice'
  WHEN {n} < 100 THEN 'short' WHEN {n} < 1000 THEN 'article' ELSE 'long' END"""


def described(docs: DataFrame) -> DataFrame:
    """docs with _source, _lang, _topic and _tokens; null values of the first two count as ''."""
    text = "coalesce(text, '')"
    counted = docs.withColumn("_tokens", F.expr(f"cast(regexp_count({text}, r'{_WORD}') as long)"))
    return counted.withColumns({"_source": F.expr("coalesce(source, '')"), "_lang": F.expr("coalesce(lang, '')"), "_topic": F.expr(_TOPIC.format(text=text, n="_tokens"))})


def _targets(cells: DataFrame, by: str, given: DataFrame | None) -> DataFrame:
    """Each value's target, scaled to all tokens: its share in given(value, share), 0 without one; else its tokens to the power TEMPER."""
    sums = cells.groupBy(by).agg(F.sum("tokens").cast("double").alias("own"))
    if given is None:
        sums = sums.withColumn("share", F.pow("own", F.lit(TEMPER)))
    else:
        sums = sums.join(given.select(F.col("value").alias(by), F.col("share").cast("double")), by, "left").na.fill(0.0, ["share"])
    shares, tokens = sums.agg(F.coalesce(F.sum("share"), F.lit(0.0)), F.coalesce(F.sum("own"), F.lit(0.0))).first()
    return sums.select(by, (F.col("share") / shares * tokens if shares > 0 else F.lit(0.0)).alias(f"to_{by}"))


def _fitted_to(cells: DataFrame, by: str, wide: bool) -> DataFrame:
    """cells with their weights scaled so that those of each value of by reach its target."""
    if wide:
        cells, now = cells.join(cells.groupBy(by).agg(F.sum("weight").alias("_now")), by), F.col("_now")
    else:
        now = F.sum("weight").over(Window.partitionBy(by))
    return cells.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"to_{by}") / now).otherwise(0.0)).select(*BY, "tokens", *(f"to_{b}" for b in BY), "weight")


def gap(fitted: DataFrame) -> float:
    """The largest share of all tokens by which a value of any marginal misses its target."""
    off = [fitted.groupBy(by).agg(F.abs(F.sum("weight") - F.max(f"to_{by}")).alias("off"), F.max(f"to_{by}").alias("to")) for by in BY]
    found = [x.agg(F.max("off"), F.sum("to")).first() for x in off]
    return max((most / total for most, total in found if total), default=0.0)


def rake(cells: DataFrame, sweeps: int = SWEEPS, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """cells(source, lang, topic, tokens) with weight: tokens raked to the targets of the three marginals. cells are read twice or more: a table.

    targets: by source, lang or topic, a table of (value, share), for marginals other than the tempered ones. Sweeps go on
    until no value is off by more than TOLERANCE; targets that contradict each other are left after CHECKS * sweeps.
    """
    wide = cells.count() > BROADCAST_CELLS
    together = (lambda df: df) if wide else (lambda df: df.coalesce(1))
    targeted = together(cells)
    for by in BY:
        own = _targets(cells, by, (targets or {}).get(by))
        targeted = targeted.join(own if wide else F.broadcast(own), by)
    fitted = materialize(targeted.withColumn("weight", F.col("tokens").cast("double")), "cells")
    for done in range(1, CHECKS * sweeps + 1):
        fitted = together(fitted)
        for by in BY:
            fitted = _fitted_to(fitted, by, wide)
        if wide or done % 4 == 0 or done % sweeps == 0:
            fitted = materialize(fitted, "raked")
        if done % sweeps == 0 and gap(fitted) <= TOLERANCE:
            break
    return fitted.select(*BY, "tokens", "weight")


def calibrated(facts: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(_source, _lang, _topic, rate) for each cell of described rows."""
    cells = facts.groupBy(*(F.col(f"_{b}").alias(b) for b in BY)).agg(F.sum("_tokens").alias("tokens"))
    fitted = materialize(rake(materialize(cells, "tokens"), targets=targets), "fitted")
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0)
    out = fitted.select(*(F.col(b).alias(f"_{b}") for b in BY), rate.alias("rate"))
    return F.broadcast(out) if out.count() <= BROADCAST_CELLS else out


def chance() -> Column:
    """A number in [0, 1) from doc_id alone, from the text where it is null."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), name)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _copies(chance: Column) -> Column:
    times = F.lit(KEEP) * F.col("rate")
    return F.floor(times).cast("long") + (chance < times - F.floor(times)).cast("long")


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, n_tokens, weight, expected, copies, selected.

    weight is the document's calibrated tokens (n_tokens times its cell's rate), expected how often the sample should hold
    it (KEEP times the rate), copies how often it does, selected whether it does at all. targets are those of rake. Null
    source and lang count as ''; null and empty texts have no tokens and the topic 'short'; a null doc_id draws by the text;
    repeated rows share a fate; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "source", "lang")
    facts = materialize(described(rows).withColumn("_chance", chance()).drop("text", "source", "lang"), "facts")
    joined = facts.join(calibrated(facts, targets), [f"_{b}" for b in BY]).withColumn("copies", _copies(F.col("_chance")))
    return joined.select(
        "doc_id", *(F.col(f"_{b}").alias(b) for b in BY), F.col("_tokens").alias("n_tokens"), F.round(F.col("_tokens") * F.col("rate"), 4).alias("weight"),
        F.round(F.lit(KEEP) * F.col("rate"), 6).alias("expected"), "copies", (F.col("copies") > 0).alias("selected"),
    )


def sample_mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of docs with all their columns, each as often as mix's copies say: not at all, once or several times.

    So the tokens of sources, languages and topics follow their targets. Nulls count as in mix; rows that share id and text
    share a fate; columns may have any name; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", "source", "lang")
    facts = materialize(described(rows).select("_source", "_lang", "_topic", "_tokens"), "facts")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", "source", "lang")
    drawn = described(packed).join(calibrated(facts, targets), [f"_{b}" for b in BY]).select("row", _copies(chance()).cast("int").alias("times"))
    return drawn.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def _oracle() -> str:
    topic = _TOPIC.format(text="coalesce(text, '')", n="n_tokens")
    parts = [
        f"d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name, coalesce(source, '') AS source, coalesce(lang, '') AS lang, n_tokens, {topic} AS topic FROM (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS n_tokens FROM documents))",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY 1, 2, 3)",
    ]
    for by in BY:
        parts.append(f"t_{by} AS (SELECT {by}, pow(own, {TEMPER}) / sum(pow(own, {TEMPER})) OVER () * sum(own) OVER () AS to_{by} FROM (SELECT {by}, CAST(sum(tokens) AS DOUBLE) AS own FROM c GROUP BY 1))")
    parts.append("w0 AS (SELECT *, CAST(tokens AS DOUBLE) AS weight FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    step, last = 0, "true"
    taken = []
    for check in range(CHECKS):
        for _ in range(SWEEPS):
            for by in BY:
                step += 1
                parts.append(f"w{step} AS MATERIALIZED (SELECT * EXCLUDE (weight), CASE WHEN sum(weight) OVER (PARTITION BY {by}) > 0 THEN weight * to_{by} / sum(weight) OVER (PARTITION BY {by}) ELSE 0 END AS weight FROM w{step - 1} WHERE {last})")
        last = "true"
        if check + 1 < CHECKS:  # sweeps go on where a marginal is still off
            gaps = ", ".join(f"(SELECT max(o) / sum(t) FROM (SELECT abs(sum(weight) - max(to_{by})) AS o, max(to_{by}) AS t FROM w{step} GROUP BY {by}))" for by in BY)
            parts.append(f"g{check} AS MATERIALIZED (SELECT coalesce(greatest({gaps}), 0) <= {TOLERANCE} AS done)")
            taken.append(f"SELECT * FROM w{step} WHERE (SELECT done FROM g{check})")
            last = f"NOT (SELECT done FROM g{check})"
        else:
            taken.append(f"SELECT * FROM w{step}")
    parts.append(f"r AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens ELSE 1 END AS rate FROM ({' UNION ALL '.join(taken)}))")
    times = f"{KEEP} * rate"
    return f"""WITH {", ".join(parts)}, m AS (SELECT d.*, rate, CAST(floor({times}) AS BIGINT)
  + CASE WHEN CAST(CAST('0x' || substr(md5('{SEED}:' || name), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 < {times} - floor({times}) THEN 1 ELSE 0 END AS copies FROM d JOIN r USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(n_tokens * rate, 4) AS weight, round({times}, 6) AS expected, copies, copies > 0 AS selected FROM m"""


QUERIES = {"op6_mixing": lambda spark, sf_dir: mix(table(spark, sf_dir, "documents"))}
ORACLES = {"op6_mixing": _oracle()}
