"""Column expressions and plan helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcline.session import checkpoint_dir

# White space that separates words in the corpus contracts.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A table is broadcast only when its counted rows, at these widths, stay below 16 MB.
BROADCAST_BYTES = 16 << 20


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.transform(F.array(value), lambda bound: body(bound))[0]


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, everything else unchanged."""
    return F.translate(text, UPPER, LOWER)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: lineage ends here."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if ``rows`` of ``row_bytes`` are proven small, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
