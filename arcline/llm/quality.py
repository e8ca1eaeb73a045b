"""Quality grades by ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import LOWER, Chunk, Words, find_words, prefix_hashes, range_hashes, text_chunks, BYTE_VALUES
from .columns import small

# Buckets of hashed byte trigrams, then of hashed words, then of hashed word pairs' repetition.
TRIGRAMS, WORDS = 1 << 14, 1 << 17
REPEATED, BIAS = TRIGRAMS + WORDS, TRIGRAMS + WORDS + 1
FEATURES = TRIGRAMS + WORDS + 2
# Bytes of text turned into features at once.
CHUNK_BYTES = 1 << 19
# Rows whose gradient is formed at once.
FIT_ROWS = 500
# Letters and digits of hashed words: ASCII alphanumerics and all bytes of other characters.
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _sums(chunk_offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0.0], np.cumsum(values)))[chunk_offsets])


def text_features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value), each pair once: square roots of the shares of a row's trigrams, of
    its words, and of its words equal to the word before."""
    rows, features, values = [], [], []

    def add(row: np.ndarray, feature: np.ndarray, totals: np.ndarray) -> None:
        key, count = np.unique(row * FEATURES + feature, return_counts=True)
        row = key // FEATURES
        rows.append(row)
        features.append(key % FEATURES)
        values.append(np.sqrt(count / totals[row]))

    sizes = np.diff(chunk.offsets)
    row = np.repeat(np.arange(chunk.rows), np.maximum(sizes - 2, 0))
    if len(row):
        inside = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(sizes - 2, 0)) - np.maximum(sizes - 2, 0), np.maximum(sizes - 2, 0))
        at = chunk.offsets[:-1][row] + inside
        data = chunk.data.astype(np.int64)
        code = (data[at] << 16) | (data[at + 1] << 8) | data[at + 2]
        add(row, (code * 0x9E3779B1 >> 9) % TRIGRAMS, np.maximum(sizes - 2, 1))
    words = _letter_words(chunk)
    row = words.rows
    if len(row):
        data = LOWER[chunk.data]
        hashes = range_hashes(prefix_hashes(BYTE_VALUES[data]), words.starts, words.ends)
        totals = np.maximum(np.diff(words.first), 1)
        add(row, TRIGRAMS + (hashes >> np.uint64(20)).astype(np.int64) % WORDS, totals)
        same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])) + 1
        add(row[same], np.full(len(same), REPEATED), totals)
    rows.append(np.arange(chunk.rows))
    features.append(np.full(chunk.rows, BIAS))
    values.append(np.ones(chunk.rows))
    return np.concatenate(rows), np.concatenate(features), np.concatenate(values)


def _letter_words(chunk: Chunk) -> Words:
    spaced = Chunk(chunk.first, np.where(LETTER[chunk.data], chunk.data, np.uint8(32)), chunk.offsets)
    return find_words(spaced)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class OrdinalModel:
    """P(grade >= k) = logistic(score - threshold[k]); one weight vector, ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    @classmethod
    def fit(
        cls, row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int,
        *, rounds: int = 120, rate: float = 0.5, penalty: float = 2e-5,
    ) -> OrdinalModel:
        """Maximum likelihood by full-batch Adam; grades weigh with the square root of their rows.

        Entries (row, feature, value) are ordered by row; the gradient is summed over blocks of rows.
        """
        n = len(grade)
        counts = np.bincount(grade, minlength=grades)
        weight = 1 / np.sqrt(counts[grade])
        weight /= weight.sum()
        seen = np.zeros(FEATURES, bool)
        seen[feature] = True
        used = np.flatnonzero(seen)
        index = (np.cumsum(seen, dtype=np.int32) - 1)[feature]
        edges = np.searchsorted(row, np.arange(0, n + FIT_ROWS, FIT_ROWS))
        params = np.zeros(len(used) + grades - 1)
        gap = slice(len(used), None)
        params[gap] = np.log(2.0)
        params[len(used)] = -1.0
        m, v = np.zeros_like(params), np.zeros_like(params)

        def thresholds(p: np.ndarray) -> np.ndarray:
            return p[0] + np.concatenate(([0.0], np.cumsum(np.exp(p[1:]))))

        for t in range(1, rounds + 1):
            w, cuts = params[: len(used)], thresholds(params[gap])
            grad = np.zeros_like(params)
            d_cuts = np.zeros(grades - 1)
            for block, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                own = slice(block * FIT_ROWS, min((block + 1) * FIT_ROWS, n))
                size, level, at, x = own.stop - own.start, grade[own], index[a:b], value[a:b]
                local = row[a:b] - own.start
                score = np.bincount(local, weights=w[at] * x, minlength=size)
                tail = _logistic(score[:, None] - cuts)
                one, zero, every = np.ones((size, 1)), np.zeros((size, 1)), np.arange(size)
                bounded = np.concatenate((one, tail, zero), axis=1)
                p = np.maximum(bounded[every, level] - bounded[every, level + 1], 1e-9)
                slope = np.concatenate((zero, tail * (1 - tail), zero), axis=1)
                low, high = slope[every, level], slope[every, level + 1]
                d_score = -weight[own] * (low - high) / p
                for k in range(1, grades):
                    part = np.where(level == k, low, 0) - np.where(level + 1 == k, high, 0)
                    d_cuts[k - 1] += (weight[own] / p * part).sum()
                grad[: len(used)] += np.bincount(at, weights=d_score[local] * x, minlength=len(used))
            grad[: len(used)] += penalty * w
            grad[len(used)] = d_cuts.sum()
            for j in range(1, grades - 1):
                grad[len(used) + j] = d_cuts[j:].sum() * np.exp(params[len(used) + j])
            m = 0.9 * m + 0.1 * grad
            v = 0.99 * v + 0.01 * grad * grad
            params -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        weights = np.zeros(FEATURES)
        weights[used] = params[: len(used)]
        return cls(weights, thresholds(params[gap]))

    def tails(self, score: np.ndarray) -> np.ndarray:
        return _logistic(score[:, None] - self.thresholds)


def label_grade(quality: Column, toxic: Column) -> Column:
    """Grade of a labelled document: 0 poor, 1 sound but toxic, 2 sound; null if quality is."""
    return F.when(quality == 0, 0).when(quality == 1, F.when(toxic == 1, 1).otherwise(2))


def fit_quality(
    rated: DataFrame, texts: DataFrame, *, grades: int = 3, sample_rows: int = 8_000, doc_id: str = "doc_id", text: str = "text"
) -> OrdinalModel:
    """Fit on at most ``sample_rows`` rated documents: those with the smallest hash of the id.

    ``rated`` has doc_id and grade (0 .. grades - 1); rows without either are not used, and of
    several grades of a document the lowest counts. Ids are chosen first, their texts fetched by
    a join with that bounded list and turned into features on the executors; of several texts of
    an id the one of the smallest hash counts. Without any rated
    document every text gets the middle of the scale.
    """
    rated = rated.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1))
    ids = rated.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    ids = ids.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample_rows)
    rows = texts.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1), CHUNK_BYTES):
                row, feature, value = text_features(chunk)
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(chunk.rows + 1))
                feature, value = feature[order].astype(np.int32), value[order].astype(np.float32)
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, chunk.rows),
                        pa.array([feature[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([value[a:b].tobytes() for a, b in spans], pa.binary()),
                    ],
                    ["grade", "features", "values"],
                )

    # One row per id, so that the sample is bounded in rows however often an id repeats.
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")
    chosen = rows.join(small(ids, sample_rows, 16), "doc_id").groupBy("doc_id", "grade").agg(one).select("grade", "one.text")
    found = chosen.mapInArrow(features, "grade int, features binary, values binary").collect()
    if not found:
        return OrdinalModel(np.zeros(FEATURES), np.zeros(grades - 1))
    # The driver holds every array once: rows are dropped as they are copied.
    found = sorted(map(tuple, found), key=lambda r: (r[0], zlib.crc32(r[1]), zlib.crc32(r[2])))
    grade = np.array([r[0] for r in found])
    sizes = [len(r[1]) // 4 for r in found]
    row = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
    feature, value = np.empty(len(row), np.int32), np.empty(len(row), np.float32)
    for k, (a, b) in enumerate(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True)):
        feature[a:b], value[a:b] = np.frombuffer(found[k][1], np.int32), np.frombuffer(found[k][2], np.float32)
        found[k] = None
    return OrdinalModel.fit(row, feature, value, grade, grades)


def grade_documents(
    docs: DataFrame, model: OrdinalModel, *, keep_grade: int = 2, keep_tail: float = 0.5, text: str = "text"
) -> DataFrame:
    """Every row of ``docs`` with quality_score, expected_grade, tail_1 .. tail_k and keep.

    tail_k is the probability of grade k or better, the expected grade their sum; a row is kept
    when tail_``keep_grade`` is at least ``keep_tail``. Null and empty texts have no features but
    the bias. Repeated rows stay repeated, an empty table stays empty; existing columns of the
    result's names are replaced.
    """
    tails = [f"tail_{k}" for k in range(1, len(model.thresholds) + 1)]
    added = ["quality_score", "expected_grade", *tails, "keep"]
    rows = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = rows.columns.index(text)

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for chunk in text_chunks(batch.column(place), CHUNK_BYTES):
                row, feature, value = text_features(chunk)
                score = np.bincount(row, weights=model.weights[feature] * value, minlength=chunk.rows)
                tail = model.tails(score)
                part = batch.slice(chunk.first, chunk.rows)
                new = [score, tail.sum(axis=1), *tail.T, tail[:, keep_grade - 1] >= keep_tail]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, new)], [*part.schema.names, *added])

    schema = T.StructType(list(rows.schema.fields))
    for name in added[:-1]:
        schema = schema.add(name, "double")
    return rows.mapInArrow(grade, schema.add("keep", "boolean"))
