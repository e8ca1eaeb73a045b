"""Query registration: a Spark callable and, where SQL can say it, the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Types both engines print alike: doubles to 6 digits, dates as text, flags as 0/1."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 6)
        elif isinstance(kind, T.BooleanType):
            column = column.cast("int")
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        elif isinstance(kind, (T.IntegerType, T.ShortType)):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Register ``function(tables)``; ``sql`` may read ``views`` and the provided tables."""

    def register(function: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: comparable(function(Tables(spark, folder)))
        if sql is not None:
            CHECKS[name] = with_views(views, sql)
        return function

    return register


def r(expression: str) -> str:
    """SQL for a double rounded like :func:`comparable`, without negative zero."""
    return f"(round(cast({expression} as double), 6) + cast(0 as double))"


def day(expression: str) -> str:
    return f"cast(cast({expression} as date) as string)"


def n(expression: str) -> str:
    return f"cast({expression} as bigint)"
