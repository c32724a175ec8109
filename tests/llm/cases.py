"""Small inputs that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 35),
    (2, "alpha BETA gamma delta epsilon zeta", "en", "a", 35),
    (3, "", "en", None, 0),
    (4, None, None, "b", None),
    (5, "   \n\t ", "de", "b", 6),
    (6, "word " * 20000, "en", "c", 100000),
    (7, "All Rights Reserved. cc by 4.0 — GNU General Public License", "en", "c", 58),
    (8, "x" * 3000 + " straße ÉCOLE 日本語 \x1c tail", "fr", "c", 3030),
    (8, "x" * 3000 + " straße ÉCOLE 日本語 \x1c tail", "fr", "c", 3030),
    (None, "no id here at all", "en", "a", 17),
    (10, "alpha beta gamma delta epsilon zeta", "en", "a", 35),
]


def odd(spark):
    """ODD with further columns whose names an operator may use itself."""
    named = ("id", "norm", "digest", "fp", "edge", "kept", "n_tokens", "component", "weight", "_row", "bucket", "score", "topic", "next_text")
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in named})


def none(spark):
    return spark.createDataFrame([], SCHEMA)
