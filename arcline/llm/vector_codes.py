"""Vector codes by part codebooks, with nearest entries searched by fixed pivots (LAESA)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, BinaryType

from .columns import saved, small

PARTS, ENTRIES, ROUNDS, PIVOTS = 8, 16, 6, 4
SCALE = 4096
# Integers must stay below this, so that squared distances of parts fit 64 bits.
LARGEST = 1 << 27
# Part vectors whose bounds a worker holds at once.
CHUNK_ROWS = 1 << 14


def whole_vectors(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(rows, their integer vectors, lengths) of the rows without null or non-finite components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
    values = column.flatten()
    flat = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    broken = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    rows = np.flatnonzero((lengths >= 0) & (broken[ends] == broken[ends - np.maximum(lengths, 0)]))
    return rows, [flat[ends[r] - lengths[r] : ends[r]] for r in rows], lengths[rows]


def to_integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component; raises where squared distances would not fit 64 bits."""
    whole = np.floor(vectors * scale)
    if whole.size and np.abs(whole).max() >= LARGEST:
        raise ValueError(f"a component is too large: floor({scale} * x) must stay below {LARGEST}")
    return whole.astype(np.int32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances (rows of a x rows of b) of integer vectors."""
    return ((a[:, None, :].astype(np.int64) - b[None, :, :].astype(np.int64)) ** 2).sum(axis=2)


def choose_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the first entries, each farthest from those chosen before."""
    apart = distances(entries, entries)
    chosen = [0]
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(apart[chosen].min(axis=0).argmax()))
    return entries[chosen]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the nearest entry of every part, and how many were evaluated.

    By the triangle inequality an entry c is at least |d(x, p) - d(p, c)| away from x for every
    pivot p. Entries are tried by rising lower bound, until the bound exceeds the best exact
    distance; only then are the others certain to be farther, so ties are never lost.
    """
    n = len(parts)
    from_pivots = np.sqrt(distances(pivots, entries).astype(np.float64))
    lower = np.zeros((n, len(entries)))
    for p in range(len(pivots)):
        np.maximum(lower, np.abs(to_pivots[:, p, None] - from_pivots[p][None, :]), out=lower)
    # Roots are rounded: a bound gives way by more than their error.
    lower = np.maximum(lower * (1.0 - 1e-9) - 1e-6, 0.0) ** 2
    order = np.argsort(lower, axis=1, kind="stable")
    best = np.full(n, np.iinfo(np.int64).max)
    index = np.full(n, len(entries))
    active, evaluated = np.arange(n), 0
    wide = parts.astype(np.int64)
    for place in range(len(entries)):
        entry = order[active, place]
        open_ = lower[active, entry] <= best[active]
        active, entry = active[open_], entry[open_]
        if not len(active):
            break
        evaluated += len(active)
        away = ((wide[active] - entries[entry]) ** 2).sum(axis=1)
        better = (away < best[active]) | ((away == best[active]) & (entry < index[active]))
        best[active[better]] = away[better]
        index[active[better]] = entry[better]
    return index, best, evaluated


def _fixed(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """A binary column of equal lengths as an array (rows x width)."""
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32, 1, column.offset * 4)[0]
    size = len(column) * width
    return np.frombuffer(data, dtype, size, int(first)).reshape(len(column), width)


def encode_vectors(
    vectors: DataFrame,
    *,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    pivots: int = PIVOTS,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error) of every kept vector, and the codebooks.

    Components become integers floor(4096 x); a vector is cut into ``parts`` equal parts. The
    codebook of a part position starts as that part of the ``entries`` smallest ids. Every round
    assigns each part to its nearest entry and moves each entry to the floored mean of its parts.
    Distances of parts to the fixed pivots are computed once and kept with the vectors; a task
    sends one sum per (part, entry), Spark adds them, and the driver sees parts x entries rows.

    Rows whose vector is null or has a null, NaN or infinite component are left out, as are those
    of another length than the vector of the smallest kept id. Null ids come after all others,
    repeated ids in order of their integers' bytes; repeated rows are rows of their own. With fewer kept
    rows than ``entries`` the codebooks are smaller; an empty table gives an empty result and no
    codebooks. Null labels count as equal. Other columns are ignored.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    kinds = [rows.schema["vec_id"], rows.schema["label"]]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, found, _ = whole_vectors(batch.column(2))
            packed = [to_integers(v).tobytes() for v in found]
            at = pa.array(kept)
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "whole"])

    parsed = rows.mapInArrow(parse, StructType([*kinds, StructField("whole", BinaryType())]))

    def smallest(df: DataFrame) -> list:
        return df.select("vec_id", "whole").orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).collect()

    first = smallest(parsed)
    if not first:
        empty = parsed.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.withColumn("label_error", F.lit(0).cast("long")), []
    size = len(first[0]["whole"])
    if size == 0 or size // 4 % parts:
        raise ValueError(f"vectors of {size // 4} components do not fall into {parts} equal parts")
    width = size // 4 // parts
    if any(len(r["whole"]) != size for r in first):
        first = smallest(parsed.where(F.octet_length("whole") == size))
    start = np.stack([np.frombuffer(r["whole"], np.int32) for r in first])
    books = [start[:, p * width : (p + 1) * width].astype(np.int64) for p in range(parts)]
    fixed = [choose_pivots(book, pivots) for book in books]
    per_part = len(fixed[0])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = _fixed(batch.column(2), np.int32, parts * width)
            roots = [np.sqrt(distances(whole[:, p * width : (p + 1) * width], fixed[p]).astype(np.float64)) for p in range(parts)]
            packed = np.concatenate(roots, axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r.tobytes() for r in packed], pa.binary())], ["vec_id", "label", "whole", "pivots"]
            )

    schema = StructType([*kinds, StructField("whole", BinaryType()), StructField("pivots", BinaryType())])
    table = saved(parsed.where(F.octet_length("whole") == size).mapInArrow(measure, schema))

    def assigned(batch: pa.RecordBatch, books: list[np.ndarray]) -> Iterator[tuple]:
        whole = _fixed(batch.column(batch.schema.get_field_index("whole")), np.int32, parts * width)
        roots = _fixed(batch.column(batch.schema.get_field_index("pivots")), np.float64, parts * per_part)
        for p in range(parts):
            own = whole[:, p * width : (p + 1) * width]
            yield p, own, *nearest(own, roots[:, p * per_part : (p + 1) * per_part], books[p], fixed[p])[:2]

    def summed(books: list[np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = np.zeros((parts, len(books[0])), np.int64)
            total = np.zeros((parts, len(books[0]), width), np.int64)
            for whole_batch in batches:
                for begin in range(0, whole_batch.num_rows, CHUNK_ROWS):
                    for p, own, index, _ in assigned(whole_batch.slice(begin, CHUNK_ROWS), books):
                        count[p] += np.bincount(index, minlength=len(books[0]))
                        np.add.at(total[p], index, own)
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(p, width).astype(np.int32)),
                    pa.array(np.repeat(e, width).astype(np.int32)),
                    pa.array(np.tile(np.arange(width, dtype=np.int32), len(p))),
                    pa.array(total[p, e].ravel()),
                    pa.array(np.repeat(count[p, e], width)),
                ],
                ["part", "entry", "place", "total", "n"],
            )

        partial = table.select("whole", "pivots").mapInArrow(run, "part int, entry int, place int, total long, n long")
        return partial.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))

    for _ in range(rounds):
        moved = [book.copy() for book in books]
        for row in summed(books).collect():
            moved[row["part"]][row["entry"], row["place"]] = row["total"] // row["n"]
        books = moved

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for begin in range(0, whole_batch.num_rows, CHUNK_ROWS):
                batch = whole_batch.slice(begin, CHUNK_ROWS)
                index = np.zeros((batch.num_rows, parts), np.uint8)
                error = np.zeros(batch.num_rows, np.int64)
                for p, _, own, away in assigned(batch, books):
                    index[:, p] = own
                    error += away
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([r.tobytes().hex() for r in index], pa.string()), pa.array(error)],
                    ["vec_id", "label", "code", "error"],
                )

    schema = StructType([*kinds]).add("code", "string").add("error", "long")
    coded = saved(table.mapInArrow(encode, schema))
    return _with_label_error(coded), books


def _with_label_error(coded: DataFrame, hot_share: float = 0.001) -> DataFrame:
    """``label_error``: error summed over equal labels, nulls together.

    Sums are made before the shuffle. Labels with at least a thousandth of the rows number a
    thousand at most: their sums are broadcast, so no such label gathers in one task.
    """
    sums = saved(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    labels, total = sums.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    same = F.col("label").eqNullSafe(F.col("_label"))
    columns = ["vec_id", "label", "code", "error", "label_error"]
    plain = small(sums, labels, 64)
    if plain is not sums:
        return coded.join(plain, same).select(*columns)
    frequent = sums.where(F.col("_n") >= total * hot_share)
    joined = coded.join(F.broadcast(frequent), same, "left")
    rest = joined.where(F.col("_n").isNull()).drop("_label", "label_error", "_n").join(sums, same)
    return joined.where(F.col("_n").isNotNull()).select(*columns).unionByName(rest.select(*columns))


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Hash of all entries' integers in decimal, by part, entry and place, joined by commas."""
    text = ",".join(str(v) for book in books for entry in book.tolist() for v in entry)
    return hashlib.sha256(text.encode()).hexdigest()
