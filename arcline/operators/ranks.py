"""Order statistics over values: running counts, exact quantiles, rank AUC.

The base is one row per distinct value with its counts, so repeated values cost nothing
after the map-side aggregation. Distinct values are spread over ranges of similar size
(cut points from one approximate-quantile pass), each range is summed up, and the running
count inside a range is a window over that range only. Results are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcline.session import checkpoint_dir, slice_rows

from .skew import bucket_by, cut_points, even_shares, order_position

RANGE = "_range"


def value_ranges(values: DataFrame, value: str) -> list[float]:
    """Cut points of a frame of distinct values, one per ``arcline.slice.rows`` of them.

    A count decides whether cutting is needed at all; only then a sketch of the values is
    taken for the cut points.
    """
    ranges = math.ceil(values.count() / slice_rows(values.sparkSession))
    if ranges <= 1:
        return []
    placed = values.select(order_position(values, value).alias("_position"))
    return cut_points(placed, "_position", ranges)


def prefix_counts(
    df: DataFrame,
    value: str,
    counts: dict[str, Column],
    *,
    bounds: list[float] | None = None,
) -> DataFrame:
    """One row per distinct non-null value with ``counts`` and ``<name>_before``.

    ``<name>_before`` sums the count over all smaller values. Unless ``bounds`` are given, the
    counts are written once to the checkpoint folder, so ``df`` is derived once.
    """
    names = list(counts)
    grouped = (
        df.where(F.col(value).isNotNull())
        .groupBy(value)
        .agg(*[counts[name].cast("bigint").alias(name) for name in names])
    )
    if bounds is None:
        checkpoint_dir(df.sparkSession)
        grouped = grouped.checkpoint()
        bounds = value_ranges(grouped, value)
    placed = grouped.withColumn("_position", order_position(grouped, value))
    placed = bucket_by(placed, "_position", bounds, RANGE).drop("_position")
    inside = W.partitionBy(RANGE).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    running = {n: F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names}
    if not bounds:
        return placed.select(
            value, *names, *[running[n].cast("bigint").alias(f"{n}_before") for n in names]
        )
    # One row per range, and a range for every ``arcline.slice.rows`` rows: few enough to be
    # ordered in one task.
    across = W.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(RANGE)
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(RANGE, *[F.coalesce(F.sum(n).over(across), F.lit(0)).alias(f"_{n}") for n in names])
    )
    return placed.select(value, RANGE, *names, *[running[n].alias(f"{n}_in") for n in names]).join(
        offsets, RANGE
    ).select(
        value,
        *names,
        *[(F.col(f"{n}_in") + F.col(f"_{n}")).cast("bigint").alias(f"{n}_before") for n in names],
    )


def exact_quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Interpolated quantiles (linear between neighbours); only the edges reach the driver."""
    return quantiles_from_counts(prefix_counts(df, value, {"n": F.count(F.lit(1))}), value, shares)


def quantiles_from_counts(table: DataFrame, value: str, shares: list[float]) -> list[float]:
    """The same from a table of :func:`prefix_counts` whose count of all rows is ``n``."""
    total = table.agg(F.sum("n").alias("n")).first()["n"]
    if not total:
        return []
    first, last = F.col("n_before"), F.col("n_before") + F.col("n")
    picks = []
    for i, share in enumerate(shares):
        at = (total - 1) * share
        for side, position in (("lo", math.floor(at)), ("hi", math.ceil(at))):
            here = (first <= position) & (last > position)
            picks.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"{side}{i}"))
    row = table.agg(*picks).first()
    edges = []
    for i, share in enumerate(shares):
        at = (total - 1) * share
        low, high = row[f"lo{i}"], row[f"hi{i}"]
        edges.append(low + (high - low) * (at - math.floor(at)))
    return edges


def nth_smallest(df: DataFrame, value: str, position: int, *, rows: int | None = None):
    """The value at a 1-based position among non-null rows, duplicates counted.

    A known upper bound for the rows saves counting them.
    """
    small = rows is not None and rows <= slice_rows(df.sparkSession)
    table = prefix_counts(df, value, {"n": F.count(F.lit(1))}, bounds=[] if small else None)
    here = (F.col("n_before") < position) & (F.col("n_before") + F.col("n") >= position)
    return table.agg(F.max(F.when(here, F.col(value))).alias("v")).first()["v"]


def auc_expressions(label: str) -> dict[str, Column]:
    hit = F.col(label).cast("boolean")
    return {"pos": F.count_if(hit), "neg": F.count_if(~hit)}


def auc_from_counts(table: DataFrame) -> DataFrame:
    """Tie-aware rank AUC from :func:`prefix_counts` over ``auc_expressions``."""
    pairs = F.col("pos").cast("double") * (
        F.col("neg_before").cast("double") + F.col("neg").cast("double") / 2
    )
    return table.agg(
        F.try_divide(
            F.sum(pairs), F.sum("pos").cast("double") * F.sum("neg").cast("double")
        ).alias("auc")
    )


def rank_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row, one column ``auc``; NULL when a class is missing."""
    return auc_from_counts(prefix_counts(df, score, auc_expressions(label)))


def prefix_by_feature(
    known: DataFrame, feature: str, value: str, counts: dict[str, Column], running: str
) -> DataFrame:
    """One row per feature and distinct value with ``counts``, and ``running`` summed over the
    feature's smaller values as ``_before``.

    A feature is cut in one range per ``arcline.slice.rows`` of its values; all cut points come
    from one sketch pass. The counts are written once to the checkpoint folder, so ``known`` is
    derived once.
    """
    limit = slice_rows(known.sparkSession)
    checkpoint_dir(known.sparkSession)
    table = known.groupBy(feature, value).agg(*[c.cast("bigint").alias(n) for n, c in counts.items()]).checkpoint()
    sizes = table.groupBy(feature).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).collect()
    cuts = {}
    if sizes:
        sketches = []
        for i, row in enumerate(sizes):
            parts = math.ceil(row["n"] / limit)
            own = F.when(F.col(feature) == row[feature], F.col(value))
            sketches.append(F.percentile_approx(own, even_shares(parts), max(10_000, 10 * parts)).alias(f"c{i}"))
        found = table.agg(*sketches).first()
        cuts = {row[feature]: sorted(set(found[f"c{i}"] or [])) for i, row in enumerate(sizes)}
    position = F.lit(0)
    for name, edges in cuts.items():
        here = F.size(F.filter(F.lit(edges), lambda cut: cut <= F.col(value)))
        position = F.when(F.col(feature) == name, here).otherwise(position)
    placed = table.withColumn(RANGE, position)
    inside = W.partitionBy(feature, RANGE).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("_before", F.coalesce(F.sum(running).over(inside), F.lit(0)))
    if cuts:
        across = W.partitionBy(feature).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
        offsets = placed.groupBy(feature, RANGE).agg(F.sum(running).alias("_sum"))
        offsets = offsets.select(feature, RANGE, F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_start"))
        placed = placed.join(offsets, [feature, RANGE])
        placed = placed.withColumn("_before", F.col("_before") + F.col("_start")).drop("_start")
    return placed.drop(RANGE)


def auc_by_feature(long: DataFrame, feature: str, value: str, label: str) -> DataFrame:
    """Rank AUC per feature of a long frame, all features in the same few stages."""
    known = long.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    table = prefix_by_feature(known, feature, value, auc_expressions(label), "neg")
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    pairs = pos * (F.col("_before").cast("double") + neg / 2)
    return table.groupBy(feature).agg(F.try_divide(F.sum(pairs), F.sum(pos) * F.sum(neg)).alias("auc"))


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Median of every column that has values, all columns in one unpivoted pass."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])))
    known = long.where(F.col("value").isNotNull())
    table = prefix_by_feature(known, "feature", "value", {"n": F.count(F.lit(1))}, "n")
    totals = table.groupBy("feature").agg(F.sum("n").alias("_total"))
    first, last, total = F.col("_before"), F.col("_before") + F.col("n"), F.col("_total")
    low, high = F.floor((total - 1) / 2), F.floor(total / 2)
    picks = [F.max(F.when((first <= at) & (last > at), F.col("value"))).alias(name) for at, name in ((low, "low"), (high, "high"))]
    rows = table.join(totals, "feature").groupBy("feature").agg(*picks).collect()
    return {r["feature"]: r["low"] + (r["high"] - r["low"]) / 2 for r in rows}
