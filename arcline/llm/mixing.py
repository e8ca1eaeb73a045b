"""Mix sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import saved, small, word_count

# Rows of one cell that a single window task numbers.
CELL_ROWS = 250_000


def source_targets(
    sizes: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)
) -> DataFrame:
    """One row per source: mix_key, source_size, source_rows, target.

    ``sizes`` has mix_key (text, sorts as the sources should), size. Targets share ``share`` of
    all sizes by weight; a target stops at ``limit`` times its source's size and the excess goes
    to the others by weight. With sources in order of cap per weight, the level that water
    reaches is the largest of (total - caps before) / (weights from here on).
    """
    per = sizes.groupBy("mix_key").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    per = (
        per.withColumn("_place", F.row_number().over(Window.orderBy("mix_key")))
        .withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(limit)))
        .withColumn("_total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    )
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_place")
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("_level", (F.col("_total") - before) / onward)
    per = per.withColumn("_level", F.max("_level").over(Window.partitionBy()))
    return per.select(
        "mix_key",
        "source_size",
        "source_rows",
        F.least("_cap", F.col("_weight") * F.col("_level")).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    *,
    share: float = 1.5,
    limit: float = 2.0,
    weights: tuple[int, ...] = (5, 2, 1),
    seed: str = "mix",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Copies of every document in a mix whose sources come near their targets.

    Result: doc_id, source, size (words), source_size, target, copies, taken (copies x size).

    Every document of a source has the same expected copies, target / source_size. Documents
    are laid out by size class, salt and size, so that a systematic sample is stratified by
    size; the prefix sum of expected copies starts at the source's offset (a hash of seed and
    source), and a document is emitted once per integer boundary its interval crosses. The
    prefix sum is counted per cell (size class and salt) first, so a source with most of the
    rows is numbered by many tasks. The table of sources is broadcast only if its counted rows
    are proven small.

    Null text has size 0, null source is a source of its own (last in order). Salts are a hash of
    id and text, so ids of any type, null or repeated ones spread over the cells. Repeated rows are separate rows of the mix. An empty table
    gives an empty result; a source without words has target 0 and nothing taken. Other columns
    are ignored. The same rows give the same mix in any partitioning.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.when(F.col(source).isNull(), F.lit("N")).otherwise(F.concat(F.lit("A"), F.col(source))).alias("mix_key"),
        word_count(F.col(text)).alias("size"),
        F.xxhash64(F.col(text)).alias("text_hash"),
    )
    rows = saved(rows)
    targets = saved(source_targets(rows, share, limit, weights))
    targets = small(targets, targets.count(), 300)
    salts = F.ceil(F.col("source_rows") / F.lit(float(CELL_ROWS))).cast("long")
    placed = (
        rows.join(targets, "mix_key")
        .withColumn("_class", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(F.lit(0)))
        .withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text_hash"), salts))
    )
    cell = ["mix_key", "_class", "_salt"]
    counts = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows"))
    line = Window.partitionBy("mix_key").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*cell, F.coalesce(F.sum("_rows").over(line), F.lit(0)).alias("_before"))
    # Dealt by cell: a join by source must not leave a large source in one task.
    ranked = placed.repartition(*cell).withColumn("_in_cell", F.row_number().over(Window.partitionBy(*cell).orderBy("size", "doc_id", "text_hash")))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("mix_key"))), 1, 4), 16, 10).cast("double") / 65536.0
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("_before") + F.col("_in_cell")
    copies = F.floor(expected * rank + start) - F.floor(expected * (rank - 1) + start)
    return (
        ranked.join(offsets, cell)
        .withColumn("copies", copies)
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        )
    )
