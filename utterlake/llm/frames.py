"""Small helpers for frames with arbitrary further columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, base: str) -> str:
    """base, with underscores put before it until no column of df has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def row_key(text: Column, doc_id: Column) -> Column:
    """Names a row by its whole text and its id, so rows that share an id, or have none, keep apart."""
    return F.concat_ws(":", F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256), doc_id.cast("string"))
