"""Display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import as_column


def named_id(name: Column | str, key: Column | str, fallback: str) -> Column:
    """``Name (`id`)``, or ``<fallback> `id``` when the name is missing."""
    ticked = F.concat(F.lit("`"), as_column(key).cast("string"), F.lit("`"))
    name = as_column(name)
    known = name.isNotNull() & (name != "")
    return F.when(known, F.concat(name, F.lit(" ("), ticked, F.lit(")"))).otherwise(
        F.concat(F.lit(fallback + " "), ticked)
    )


def zone_label(*parts: Column | str) -> Column:
    return F.concat_ws(" / ", *[as_column(part) for part in parts])


def shot_result(made: Column | str) -> Column:
    outcome = as_column(made)
    return F.when(outcome.isNull(), "Unknown").when(outcome, "Made").otherwise("Missed")


def signed(value: Column | str, decimals: int, *, sign_zero: bool = True) -> Column:
    """Number with its sign and a fixed number of decimals; zero may go without a sign."""
    number = as_column(value).cast("double")
    text = F.format_string(f"%+.{decimals}f", number)
    if sign_zero:
        return text
    return F.when(number > 0, text).otherwise(F.format_string(f"%.{decimals}f", number))
