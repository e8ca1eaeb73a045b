"""Ordered slices for keys too large for one task.

A window over ``partitionBy(key)`` sorts a whole key in one task. For keys holding more
rows than ``arcline.slice.rows`` the rows are cut into consecutive ranges of the leading
order column, and each (key, slice) is its own window partition. What a slice needs from
the rows before it is bounded (the last n rows, or the last known value per column), so it
is computed per slice, passed forward along the few slices of the key, and added to the
slice as marked *carry* rows that are dropped after the window. Results are unchanged.

Keys below the limit take the plain path: one shuffle, no extra columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline.session import checkpoint_dir, shuffles_dropped, slice_rows

SLICE = "_slice"
CARRY = "_carry"
LOWEST = -1.7e308


CODE_BYTES = 6
# Rows that one task sorts at a time where the number of partitions is chosen here.
TASK_ROWS = 1 << 17


def text_code(column: str, skip: int) -> Column:
    """Six bytes of a text from byte ``skip`` on as a number; never falls as the text rises."""
    part = F.hex(F.substring(F.encode(column, "UTF-8"), skip + 1, CODE_BYTES))
    return F.conv(F.rpad(part, 2 * CODE_BYTES, "0"), 16, 10).cast("double")


def common_bytes(df: DataFrame, column: str) -> int:
    """Leading bytes that all texts of a column share."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    pairs = zip((low or "").encode(), (high or "").encode())
    return next((i for i, (a, b) in enumerate(pairs) if a != b), len((low or "").encode()))


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys of which any may be NULL; NULL meets NULL."""
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_key_{k}" for k in keys])


def order_position(df: DataFrame, column: str, skip: int = 0) -> Column:
    """The order column as a double that never falls as it rises; NULLs first like ``orderBy``.

    Texts are placed by their bytes after the first ``skip``; texts that agree there tie.
    """
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, T.DateType):
        number = F.unix_date(value)
    elif isinstance(kind, T.TimestampType):
        number = F.unix_micros(value)
    elif isinstance(kind, T.TimestampNTZType):
        # Built from its parts: a cast to timestamp would depend on the session time zone.
        seconds = F.hour(value) * 3600 + F.minute(value) * 60 + F.date_part(F.lit("SECOND"), value)
        number = F.unix_date(value.cast("date")).cast("double") * 86_400 + seconds.cast("double")
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        number = value
    elif isinstance(kind, T.StringType):
        number = text_code(column, skip)
    else:
        raise TypeError(f"cannot slice on {column}: {kind.simpleString()} has no numeric position")
    return F.coalesce(number.cast("double"), F.lit(LOWEST))


def full_position(df: DataFrame, column: str, tie_break: TieBreak | None, skip: int = 0) -> Column:
    lead = order_position(df, column, skip)
    return lead if tie_break is None else lead + tie_break.fraction()


def even_shares(parts: int) -> Column:
    """The array 1/parts, 2/parts, … below 1, as one parsed literal."""
    return F.expr("array(" + ", ".join(f"{i / parts!r}D" for i in range(1, parts)) + ")")


def cut_points(df: DataFrame, position: str, parts: int) -> list[float]:
    """Values cutting the column into ``parts`` ranges of similar size, from one sketch pass."""
    if parts <= 1:
        return []
    sketch = F.percentile_approx(position, even_shares(parts), max(10_000, 10 * parts))
    return sorted(set(df.agg(sketch.alias("cuts")).first()["cuts"] or []) - {LOWEST})


def bucket_by(df: DataFrame, position: str, bounds: list[float], output: str) -> DataFrame:
    """Number of ``bounds`` at or below ``position``: binary search inside the JVM."""
    cuts = sorted(set(bounds))
    if not cuts:
        return df.withColumn(output, F.lit(0))
    bucketizer = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")],
        inputCol=position,
        outputCol=output,
        handleInvalid="keep",
    )
    return bucketizer.transform(df).withColumn(output, F.col(output).cast("int"))


def cuts_upto(cuts: Column, position: Column, parts: int) -> Column:
    """Number of ascending ``cuts`` (fewer than ``parts``) at or below ``position``: binary search."""
    steps = F.expr("array(" + ", ".join(str(2**i) for i in reversed(range(parts.bit_length() - 1))) + ")")
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= position, at + step).otherwise(at)
    )


@dataclass(frozen=True)
class TieBreak:
    """Second order column scaled into [0, 1), so that rows tied on the first can be cut.

    Adding it to the leading position keeps the order: a rounded sum can only make
    neighbours equal, and equal positions share a slice.
    """

    column: str
    low: float
    high: float
    skip: int | None = None

    def fraction(self) -> Column:
        value = F.col(self.column).cast("double") if self.skip is None else text_code(self.column, self.skip)
        scaled = (value - self.low) / (self.high - self.low + 1.0)
        return F.coalesce(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0 - 2**-30)), F.lit(0.0))


def find_tie_break(df: DataFrame, column: str) -> TieBreak | None:
    """Range of a number column, of ids that are digits of one length, or of other texts' bytes."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        found = df.agg(
            F.bool_and(F.col(column).rlike(r"^\d+$")).alias("digits"),
            F.min(F.length(column)).alias("short"),
            F.max(F.length(column)).alias("long"),
            F.min(F.col(column).try_cast("double")).alias("low"),
            F.max(F.col(column).try_cast("double")).alias("high"),
        ).first()
        if not found["digits"] or found["short"] != found["long"]:
            return TieBreak(column, 0.0, 256.0**CODE_BYTES, common_bytes(df, column))
    elif isinstance(kind, T.NumericType):
        found = df.agg(
            F.min(F.col(column).cast("double")).alias("low"),
            F.max(F.col(column).cast("double")).alias("high"),
        ).first()
    else:
        return None
    return None if found["low"] is None else TieBreak(column, found["low"], found["high"])


@dataclass(frozen=True)
class Slices:
    """How one key/order pair is cut; ``hot`` (keys and cut points) is None when no key needs cutting."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    hot: DataFrame | None
    parts: int = 1
    rows: int = 0
    tie_break: TieBreak | None = None
    skip: int = 0

    @property
    def partition(self) -> list[str]:
        return list(self.keys) if self.hot is None else [*self.keys, SLICE]

    def window(self):
        return W.partitionBy(*self.partition).orderBy(*self.order)

    def spread(self, df: DataFrame) -> DataFrame:
        """Rows dealt by partition key so that a task sorts some ``TASK_ROWS``, however many there are."""
        parts = -(-self.rows // TASK_ROWS)
        if parts <= 1:
            return df
        return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *self.partition)

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the slice number, -1 for keys left whole, and an unset carry mark (nothing on the plain path)."""
        if self.hot is None:
            return df
        position = full_position(df, self.order[0], self.tie_break, self.skip)
        placed = join_keys(df.withColumn("_position", position), self.hot, list(self.keys), "left")
        number = cuts_upto(F.col("_cuts"), F.col("_position"), self.parts)
        return (
            placed.withColumn(SLICE, F.when(F.col("_cuts").isNull(), F.lit(-1)).otherwise(number))
            .withColumn(CARRY, F.lit(False))
            .select(*df.columns, SLICE, CARRY)
        )

    def _hot_rows(self, sliced: DataFrame) -> DataFrame:
        return sliced.where(F.col(SLICE) >= 0)

    def carry_rows(self, sliced: DataFrame, n: int, where: Column | None = None) -> DataFrame:
        """Add to each slice the last ``n`` rows (meeting ``where``) of the slices before it."""
        if self.hot is None:
            return sliced
        names = sliced.columns
        source = self._hot_rows(sliced)
        if where is not None:
            source = source.where(where)
        source = self.spread(source)
        newest_first = W.partitionBy(*self.partition).orderBy(*[F.desc(c) for c in self.order])
        tails = (
            source.withColumn("_back", F.row_number().over(newest_first))
            .where(F.col("_back") <= n)
            .groupBy(*self.partition)
            .agg(
                F.reverse(
                    F.array_sort(F.collect_list(F.struct("_back", F.struct(*names).alias("row"))))
                ).alias("tail")
            )
        )
        # Every slice of the key, also those without a row meeting the condition.
        present = self._hot_rows(sliced).select(*self.partition).distinct()
        along = W.partitionBy(*self.keys).orderBy(SLICE)
        # ``_seen`` numbers the slices that have a tail; the n numbers below a slice's own are
        # the nearest earlier ones, and n tails are enough because none is empty.
        seen = F.count("tail").over(along.rowsBetween(W.unboundedPreceding, -1))
        nearest = W.partitionBy(*self.keys).orderBy("_seen").rangeBetween(-n, -1)
        before = F.flatten(F.collect_list("tail").over(nearest))
        carried = (
            join_keys(present, tails, self.partition, "left")
            .withColumn("_seen", seen)
            .withColumn("_before", before)
            .where(F.size("_before") > 0)
            .withColumn(
                "_before",
                F.when(
                    F.size("_before") > 0,
                    F.slice("_before", -F.least(F.size("_before"), F.lit(n)), n),
                ),
            )
            .select(F.col(SLICE).alias("_to"), F.explode("_before").alias("_item"))
            .select("_to", "_item.row.*")
            .withColumn(SLICE, F.col("_to"))
            .withColumn(CARRY, F.lit(True))
            .select(*names)
        )
        return sliced.unionByName(carried)

    def carry_last_known(self, sliced: DataFrame, columns: list[str]) -> DataFrame:
        """Add to each slice one row, sorting first, with the last known value per column."""
        if self.hot is None:
            return sliced
        position = F.struct(*self.order)
        last_known = [
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(c) for c in columns
        ]
        along = W.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
        carried = (
            self._hot_rows(sliced)
            .groupBy(*self.partition)
            .agg(*last_known)
            .select(*self.partition, *[F.last(c, ignorenulls=True).over(along).alias(c) for c in columns])
            .withColumn(CARRY, F.lit(True))
        )
        return sliced.unionByName(carried, allowMissingColumns=True)

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop carry rows and helper columns."""
        if self.hot is None:
            return df
        return df.where(~F.col(CARRY)).drop(SLICE, CARRY)


def plan_slices(
    df: DataFrame, keys: list[str], order: list[str], *, rows_per_slice: int | None = None
) -> Slices:
    """Find the keys that need cutting and where to cut.

    One column-pruned count per key, pre-aggregated before its shuffle. Every key above
    ``rows_per_slice`` is cut, a missing key included. Cut points are quantiles of the order
    column over the key's own rows (refined by the second order column), as many as those rows
    fill slices, so a slice holds at most about ``rows_per_slice`` rows plus exact ties. They
    stay in a table, one row per such key, joined without a hint; the driver sees the size of
    the largest key only.
    """
    spark = df.sparkSession
    limit = rows_per_slice or slice_rows(spark)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    with shuffles_dropped(spark):
        most, total = counts.agg(F.max("_rows"), F.sum("_rows")).first()
    if (most or 0) <= limit:
        return Slices(tuple(keys), tuple(order), None, rows=total or 0)
    counts = counts.where(F.col("_rows") > limit)
    # Keys of like size share their number of parts, a power of two.
    powers = range(1, (-(-most // limit) - 1).bit_length() + 1)
    checkpoint_dir(spark)
    rows = join_keys(df, counts, keys, "inner")
    tie_break = find_tie_break(rows, order[1]) if len(order) > 1 else None
    skip = common_bytes(rows, order[0]) if isinstance(df.schema[order[0]].dataType, T.StringType) else 0
    placed = rows.select(*keys, "_rows", full_position(rows, order[0], tie_break, skip).alias("_position"))
    sketches = []
    for power in powers:
        parts = 2**power
        own = (F.col("_rows") <= limit * parts) & (F.col("_rows") > limit * (parts // 2))
        position = F.when(own, F.col("_position"))
        sketches.append(F.percentile_approx(position, even_shares(parts), max(10_000, 10 * parts)))
    cuts = F.array_sort(F.array_distinct(F.array_remove(F.coalesce(*sketches), LOWEST)))
    # Written once: a second evaluation of the sketches could cut elsewhere.
    hot = placed.groupBy(*keys).agg(cuts.alias("_cuts")).checkpoint()
    return Slices(tuple(keys), tuple(order), hot, 2 ** len(powers), total, tie_break, skip)
