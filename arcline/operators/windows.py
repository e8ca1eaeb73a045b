"""Ordered per-key operators: shifted rolling form, forward fill, keep-first, row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .skew import CARRY, SLICE, Slices, order_position, plan_slices


def shift_roll(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: dict[str, tuple[str, str]],
    *,
    window: int = 5,
    slices: Slices | None = None,
) -> DataFrame:
    """Aggregate the ``window`` rows before each row, never the row itself.

    ``measures`` maps an output name to ('sum' | 'avg', column). A first row of a key gets
    NULL; missing values are skipped. All measures share one shuffle and one sort.
    ``order`` must be a total order within a key. ``slices`` reuses a plan made on a cheaper
    frame that has at least as many rows per key.
    """
    slices = slices or plan_slices(df, keys, order)
    rows = slices.spread(slices.carry_rows(slices.assign(df), window))
    frame = slices.window().rowsBetween(-window, -1)
    functions = {"sum": F.sum, "avg": F.avg}
    rolled = [
        functions[kind](F.col(column).cast("double")).over(frame).alias(name)
        for name, (kind, column) in measures.items()
    ]
    return slices.finish(rows.select("*", *rolled))


def fill_then_lag(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, tuple[str, str]],
    *,
    slices: Slices | None = None,
    finish: bool = True,
) -> DataFrame:
    """Forward fill each column and give the value known before the row.

    ``columns`` maps a source column to (filled name, prior name). The prior value is 0 when
    nothing is known yet; the filled value stays NULL. Passing ``slices`` reuses a plan
    whose :meth:`Slices.assign` was already applied to ``df``.
    """
    planned = slices is not None
    if not planned:
        slices = plan_slices(df, keys, order)
        df = slices.assign(df)
    rows = slices.carry_last_known(df, list(columns))
    if not planned:
        rows = slices.spread(rows)
    upto = slices.window().rowsBetween(W.unboundedPreceding, W.currentRow)
    before = slices.window().rowsBetween(W.unboundedPreceding, -1)
    added = []
    for source, (filled, prior) in columns.items():
        added.append(F.last(source, ignorenulls=True).over(upto).alias(filled))
        known = F.last(source, ignorenulls=True).over(before)
        added.append(F.coalesce(known, F.lit(0).cast(df.schema[source].dataType)).alias(prior))
    kept = [c for c in rows.columns if c not in {name for pair in columns.values() for name in pair}]
    rows = rows.select(*kept, *added)
    if finish:
        return slices.finish(rows)
    return rows if slices.hot is None else rows.where(~F.col(CARRY))


def keep_first(
    df: DataFrame, keys: list[str], order: list[Column | str] | None = None
) -> DataFrame:
    """One row per key: the first by ``order``, ties broken by all other columns.

    ``row_number() == 1`` lets Spark cut every key to one row per task before the shuffle
    (WindowGroupLimit), so a key with very many copies never gathers in one task.
    """
    ranked = [F.col(c) if isinstance(c, str) else c for c in (order or [])]
    others = [F.col(c) for c in df.columns if c not in keys]
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*ranked, *(others or keys)))
    return df.withColumn("_first", first).where(F.col("_first") == 1).drop("_first")


def longest_text(df: DataFrame, key: str, text: str, priority: str) -> DataFrame:
    """Per key the longest text; ties go to the lower ``priority``, then alphabetically."""
    order = [F.desc(F.length(text)), F.asc(priority), F.asc(text)]
    return keep_first(df.select(key, text, priority), [key], order).select(key, text)


def change_from_previous(
    df: DataFrame, key: str, order: str, value: str, carried: dict[str, str]
) -> DataFrame:
    """Difference to the previous row of the key; first rows drop out.

    ``carried`` maps a column to the name its previous value gets.
    """
    w = W.partitionBy(key).orderBy(order)
    previous = [F.lag(column).over(w).alias(name) for column, name in carried.items()]
    changed = df.select("*", (F.col(value) - F.lag(value).over(w)).alias("change"), *previous)
    return changed.where(F.col("change").isNotNull())


def number_rows(
    df: DataFrame, group: str, order: list[str], name: str = "row_id"
) -> DataFrame:
    """Dense 1-based number over (group, order) without a global sort in one task.

    Numbers within a group come from a window on the group; the offset of a group is the
    count of rows in smaller groups. A group too large for one task is cut into slices.
    ``group`` must be numeric, date or timestamp.
    """
    from .ranks import prefix_counts

    slices = plan_slices(df, [group], order)
    rows = slices.assign(df)
    rows = rows.withColumn("_in", F.row_number().over(slices.window()))
    starts = prefix_counts(df, group, {"rows": F.count(F.lit(1))}).select(
        group, F.col("rows_before").alias("_start")
    )
    if slices.hot is not None:
        sizes = rows.groupBy(group, SLICE).agg(F.count(F.lit(1)).alias("_size"))
        along = W.partitionBy(group).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
        offsets = sizes.select(
            group, SLICE, F.coalesce(F.sum("_size").over(along), F.lit(0)).alias("_offset")
        )
        rows = rows.join(offsets, [group, SLICE]).withColumn("_in", F.col("_in") + F.col("_offset"))
        rows = rows.drop("_offset")
    numbered = rows.join(starts, group).withColumn(
        name, (F.col("_start") + F.col("_in")).cast("bigint")
    )
    return numbered.drop("_in", "_start", SLICE, CARRY)


__all__ = [
    "shift_roll",
    "fill_then_lag",
    "keep_first",
    "longest_text",
    "change_from_previous",
    "number_rows",
    "order_position",
]
