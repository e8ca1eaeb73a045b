"""Benchmark decontamination by winnowed fingerprints (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import ascii_lower, let, saved, small

# Separators of contract words once lower-cased: ASCII other than letters and digits.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def benchmark_words(text: Column) -> Column:
    """Lower-cased words as an array; empty for null and for text without words."""
    plain = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS, " "))
    return F.when(F.length(plain) == 0, F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _grams(words: Column, n: int, of) -> Column:
    """``of`` applied to every run of ``n`` words, in order; empty if there are fewer."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: of(F.slice(words, i, n)))


def winnow(words: Column, gram: int, window: int) -> Column:
    """Distinct smallest gram hash of every run of ``window`` words (window >= gram)."""
    hashes = _grams(words, gram, lambda part: F.xxhash64(part, F.lit(gram)))
    return let(hashes, lambda h: F.array_distinct(_grams(h, window - gram + 1, F.array_min)))


def row_key(doc_id: Column, text: Column) -> dict[str, Column]:
    """128 bits that tell rows apart by id and text, null ids included."""
    return {"row_a": F.xxhash64(doc_id, text), "row_b": F.xxhash64(text, F.lit(1), doc_id)}


KEY = ["row_a", "row_b"]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 13,
    gram: int = 5,
    share: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    null_ids: bool = False,
    keyed: bool = False,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids, items_sha256, contaminated.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none,
    is one window. Document words inside an occurrence of a window are hit; a document is
    contaminated when n_hit > 0 and ``share`` * n_hit >= n_words.

    1. Winnowing: of every run of ``window`` words the smallest hash of a ``gram``-word gram is
       kept, on both sides, so each shared window has a common fingerprint. Whole short items
       are fingerprints of their own length, which documents are then searched for as well.
    2. Fingerprints of documents join those of items; matched documents are candidates.
    3. Hits are extended: windows of the candidates join the items' windows as text, and the
       positions they cover are counted once.

    Tables of the benchmark and the candidate ids are counted and broadcast only if they are
    proven small; beyond that the same joins shuffle. The driver receives counts and the
    distinct lengths of short items (fewer than ``window`` values).

    Null or wordless text has no words; null and wordless items have no window. Items with the
    same text count separately, repeated items with one id once. Rows repeating a doc_id give a
    row each, judged by its own text. A row without doc_id is judged with ``null_ids``, else it has
    no hits. ``keyed`` adds the columns of row_key. Empty tables give empty results, or no hits. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumns(row_key(F.col("doc_id"), F.col("text")))
    items = saved(
        benchmark.select(F.col(item_id).alias("item_id"), benchmark_words(F.col(item_text)).alias("words")).where(
            F.size("words") > 0
        )
    )
    short = F.size("words") < window
    lengths = sorted(r[0] for r in items.where(short).select(F.size("words")).distinct().collect())
    item_prints = items.select(
        F.explode(
            F.when(short, F.array(F.xxhash64("words", F.size("words")))).otherwise(
                winnow(F.col("words"), gram, window)
            )
        ).alias("print")
    ).distinct()
    windows = saved(
        items.select(
            "item_id",
            F.explode(
                F.when(short, F.array(F.array_join("words", " "))).otherwise(
                    _grams(F.col("words"), window, lambda part: F.array_join(part, " "))
                )
            ).alias("window"),
        ).distinct()
    )
    n_windows = windows.count()

    def prints(words: Column) -> Column:
        whole = [_grams(words, n, lambda part, n=n: F.xxhash64(part, F.lit(n))) for n in lengths]
        return F.concat(winnow(words, gram, window), *whole)

    # Words are made once: their number and the fingerprints are saved together.
    words = benchmark_words(F.col("text"))
    both = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), prints(w).alias("prints")))
    counted = saved(rows.select("doc_id", *KEY, both.alias("own")).select("doc_id", *KEY, "own.*"))
    judged = counted if null_ids else counted.where(F.col("doc_id").isNotNull())
    found = judged.select(*KEY, F.explode("prints").alias("print")).join(
        small(item_prints, n_windows, 16), "print", "left_semi"
    )
    candidates = saved(found.select(*KEY).distinct())

    chosen = rows.join(small(candidates, candidates.count(), 24), KEY, "left_semi")
    spans = [
        chosen.select(
            *KEY,
            F.posexplode(let(words, lambda w, n=n: _grams(w, n, lambda part: F.array_join(part, " ")))).alias("at", "window"),
            F.lit(n).alias("span"),
        )
        for n in [*lengths, window]
    ]
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    distinct_windows = small(windows.select("window").distinct(), n_windows, 200)
    hits = saved(every.join(distinct_windows, "window", "left_semi").distinct())
    covered = (
        hits.select(*KEY, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("span") - 1)).alias("at"))
        .distinct()
        .groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    named = (
        hits.select(*KEY, "window")
        .distinct()
        .join(small(windows, n_windows, 200), "window")
        .select(*KEY, F.col("item_id").cast("string").alias("item"))
        .where(F.col("item").isNotNull())
        .distinct()
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    )
    counted = counted.drop("prints")
    none = F.array().cast("array<string>")
    return (
        counted.join(covered.join(named, KEY, "left"), KEY, "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
        .withColumn("item_ids", F.coalesce("item_ids", none))
        .select(
            *(KEY if keyed else []),
            "doc_id",
            "n_words",
            "n_hit",
            F.size("item_ids").cast("long").alias("n_items"),
            "item_ids",
            F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
        )
    )
