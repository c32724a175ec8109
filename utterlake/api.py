"""The three calls of the command line as functions over tables: rows to train on, speech for texts, speech in a given voice.

Models stay outside: a scorer and a voice are plugged in, see operators/scoring.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.functions import text as T
from utterlake.operators import corpus, scoring
from utterlake.streaming.incremental import missing


def train(manifest: DataFrame, files: DataFrame, key: str = "audio_path", make: Callable[[], scoring.WaveScorer] = scoring.quantiser, cache: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(key, prompt, completion, error) for the manifest's utterances: their files' tokens as strings, ready for a tokenizer.

    files: (key, content). limit: only the first so many by key. cache: a former result; what it has is not computed again
    (resume). An utterance without a readable file has an error and no completion.
    """
    rows = manifest.select(key, "text")
    rows = rows.orderBy(key).limit(limit) if limit is not None else rows
    rows = missing(rows, cache, key) if cache is not None else rows
    tokens = scoring.scored_files(files.join(rows.select(key), key, "left_semi"), key, "content", make)
    done = rows.join(tokens, key, "left")
    completion = T.train_completion(T.render_tokens(F.col("global_ids"), "global"), T.render_tokens(F.col("semantic_ids"), "semantic"))
    error = F.when(F.col("global_ids").isNull(), F.coalesce("error", F.lit("no file")))
    return done.select(key, T.train_prompt(F.col("text")).alias("prompt"), F.when(F.col("global_ids").isNotNull(), completion).alias("completion"), error.alias("error"))


def infer(requests: DataFrame, key: str, text: str = "text", lang: str | None = None, make: Callable[[], scoring.Voice] = scoring.tone) -> DataFrame:
    """(key, content): a WAV file for each text, normalised in its language (that of its script without one)."""
    return scoring.synthesised(requests, key, text, lang, make)


def clone(requests: DataFrame, references: DataFrame, key: str, reference: str, text: str = "text", make: Callable[[], scoring.WaveScorer] = scoring.quantiser) -> DataFrame:
    """(key, prompt): what a model goes on from to say each text in the voice of its reference; null where that cannot be read.

    references: (reference, content), each decoded and scored once however many requests name it.
    """
    voices = scoring.scored_files(references.join(requests.select(reference).distinct(), reference, "left_semi"), reference, "content", make)
    voiced = requests.select(key, reference, text).join(voices.select(reference, "global_ids"), reference, "left")
    return voiced.select(key, T.inference_prompt(T.clean(F.col(text)), T.render_tokens(F.col("global_ids"), "global")).alias("prompt"))
