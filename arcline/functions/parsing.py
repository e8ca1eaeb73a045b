"""Text-to-value expressions for raw extracts. Unparseable input becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHUP_REGEX = r"(?i)^([A-Z]{2,3})\s+(vs\.?|@)\s+([A-Z]{2,3})$"
CLOCK_REGEX = r"(?i)^PT(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?$"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number(value: Column | str) -> Column:
    """Lenient double: bad text and NaN are NULL."""
    return F.nanvl(as_column(value).try_cast("double"), F.lit(None).cast("double"))


def integer(value: Column | str) -> Column:
    """Lenient bigint: accepts ``'1'`` and ``'1.0'``; fractions are NULL, never truncated.

    Values are read as doubles, which is exact below 2^53; larger ones are read again as
    integers. (A failed text-to-bigint cast is slow, so it is not tried first.)
    """
    text = as_column(value).cast("string")
    real = text.try_cast("double")
    return F.when(
        F.abs(real) < float(1 << 53), F.when(real == F.floor(real), real.try_cast("bigint"))
    ).when(real.isNotNull(), text.try_cast("bigint"))


def flag(value: Column | str) -> Column:
    """0/1 flag to nullable boolean; real booleans and 'true'/'false' pass through."""
    text = as_column(value).cast("string")
    return F.coalesce(text.try_cast("boolean"), number(text) != 0)


def padded_game_id(value: Column | str, width: int = 10) -> Column:
    """Left-pad with zeros to ``width``; longer ids stay whole (plain lpad would cut them)."""
    text = as_column(value).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def minutes(value: Column | str, mode: str = "row") -> Column:
    """Minutes with one decimal from a number or ``MM:SS``.

    ``mode`` 'row' decides per value; 'number' and 'clock' apply one format to the whole
    column, as decided once by :func:`arcline.operators.clean.column_formats`.
    """
    text = as_column(value).cast("string")
    parts = F.split(text, ":", 2)
    clock = number(F.get(parts, F.lit(0))) + number(F.get(parts, F.lit(1))) / F.lit(60.0)
    choices = {"row": F.coalesce(number(text), clock), "number": number(text), "clock": clock}
    return F.round(choices[mode], 1)


def game_date(value: Column | str, mode: str = "row") -> Column:
    """Date from ``YYYYMMDD`` or ISO text; ``mode`` 'row', 'compact' or 'iso'."""
    text = F.trim(as_column(value).cast("string"))
    is_compact = text.rlike(r"^\d{8}$")
    dashed = F.concat_ws(
        "-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)
    )
    choices = {
        "row": F.when(is_compact, dashed).otherwise(text),
        "compact": F.when(is_compact, dashed),
        "iso": F.when(~is_compact, text),
    }
    return choices[mode].try_cast("date")


def positive_id(value: Column | str) -> Column:
    parsed = integer(value)
    return F.when(parsed > 0, parsed)


def clean_text(value: Column | str, sentinels: tuple[str, ...] = ("", "nan", "None")) -> Column:
    """Trimmed text with the missing-value spellings turned into NULL."""
    text = F.trim(as_column(value).cast("string"))
    return F.when(~text.isin(*sentinels), text)


def upper_text(value: Column | str) -> Column:
    return F.upper(F.trim(as_column(value).cast("string")))


def ratio3(value: Column | str) -> Column:
    return F.round(number(value), 3)


def name_parts(value: Column | str) -> tuple[Column, Column]:
    """(first token, remaining tokens); either is NULL when there is nothing to hold."""
    tokens = F.filter(
        F.split(F.trim(as_column(value)), r"\s+"), lambda token: token != F.lit("")
    )
    rest = F.array_join(F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), " ")
    return F.get(tokens, F.lit(0)), F.when(F.size(tokens) > 1, rest)


def matchup(value: Column | str) -> Column:
    """Struct (team, opponent, at_home); NULL when the text is not a matchup."""
    text = F.trim(as_column(value))
    return F.when(
        text.rlike(MATCHUP_REGEX),
        F.struct(
            F.upper(F.regexp_extract(text, MATCHUP_REGEX, 1)).alias("team"),
            F.upper(F.regexp_extract(text, MATCHUP_REGEX, 3)).alias("opponent"),
            F.lower(F.regexp_extract(text, MATCHUP_REGEX, 2)).startswith("vs").alias("at_home"),
        ),
    )


def clock_seconds(value: Column | str) -> Column:
    """``PT11M43.00S`` to seconds left in the period; a bare ``PT`` is zero."""
    text = F.trim(as_column(value).cast("string"))

    def group(index: int) -> Column:
        return F.coalesce(F.regexp_extract(text, CLOCK_REGEX, index).try_cast("double"), F.lit(0.0))

    return F.when(text.rlike(CLOCK_REGEX), group(1) * 60.0 + group(2))
