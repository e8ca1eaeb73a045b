"""Spelling variants: words one letter apart, found by PartEnum signatures of their letters."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import mixed
from .columns import saved

RUN = "[A-Za-zÀ-ÿ]"
DROP_EVERY = 31
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
# Letter vectors of near words differ in two places at most, so of PARTS parts at least
# PARTS - 2 are equal: a signature for every choice of that many parts.
PARTS, DISTANCE = 4, 2
CHOICES = list(itertools.combinations(range(PARTS), PARTS - DISTANCE))
# Distinct words a task counts before it sends them on, and words whose arrays it holds at once.
COUNTED_WORDS, CHUNK_WORDS = 300_000, 20_000
FACTOR = 0x9E3779B97F4A7C15


def count_words(
    docs: DataFrame,
    *,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    drop_every: int = DROP_EVERY,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(word, n): words of at least ``least_letters`` code points seen ``least_count`` times.

    Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z in lower case. With h
    the crc32 of ``<doc_id>:<run>``, a run whose h is divisible by ``drop_every`` loses the code
    point at h mod its length. Tasks count before anything is shuffled. A null id is written as
    nothing; a null text has no words.
    """
    # A run shorter than the least length cannot give a word that is long enough.
    runs = re.compile(f"{RUN}{{{least_letters},}}")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def sent() -> pa.RecordBatch:
            columns = [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())]
            total.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for owner, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = value.as_py()
                if body is None:
                    continue
                start = zlib.crc32(f"{owner}:".encode())
                own = Counter(runs.findall(body.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % drop_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_letters:
                            continue
                    total[word] += n
                if len(total) >= COUNTED_WORDS:
                    yield sent()
        yield sent()

    counted = rows.mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _runs_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, row of every place, place within its row) of rows laid end to end."""
    first = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(lengths)), lengths)
    return first, row, np.arange(len(row)) - first[row]


def letter_parts(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per part and word a sum of random values over the word's letter vector (PARTS x words).

    The vector has a place for every (letter, how many of it came before); places belong to
    parts by a hash. Equal sums mean equal parts of the vectors.
    """
    first, row, _ = _runs_of(lengths)
    order = np.lexsort((points, row))
    letter = points[order]
    fresh = np.ones(len(letter), bool)
    fresh[1:] = (letter[1:] != letter[:-1]) | (row[1:] != row[:-1])
    places = np.arange(len(letter))
    before = places - np.maximum.accumulate(np.where(fresh, places, 0))
    element = letter.astype(np.uint64) << np.uint64(32) | before.astype(np.uint64)
    value = mixed((element + np.uint64(1)) * np.uint64(FACTOR))
    part = (mixed(element ^ np.uint64(FACTOR)) >> np.uint64(40)) % np.uint64(PARTS)
    return np.stack([np.add.reduceat(np.where(part == p, value, np.uint64(0)), first) for p in range(PARTS)])


def half_hashes(points: np.ndarray, lengths: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Hashes of the first ``longer // 2`` and of the last ``longer - longer // 2`` code points (2 x words)."""
    first, row, place = _runs_of(lengths)
    power = np.cumprod(np.concatenate(([1], np.full(max(int(lengths.max()), 1), FACTOR))).astype(np.uint64), dtype=np.uint64)
    letter = mixed(points.astype(np.uint64) + np.uint64(77))
    head = longer // 2
    back = lengths[row] - 1 - place
    sums = [
        np.where(place < head[row], letter * power[place], np.uint64(0)),
        np.where(back < (longer - head)[row], letter * power[back], np.uint64(0)),
    ]
    return np.stack([np.add.reduceat(s, first) for s in sums])


def signatures(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, key, whether the word stands as the longer one) of all signatures.

    Words one edit apart share the letters before the edit and those after it. With m the length of
    the longer one they therefore agree in the first m // 2 code points or in the last m - m // 2.
    Every word is entered for partners that are not longer (m its length) and for partners one
    longer; a key holds the choice of parts, their letters, m, the half and its side.
    """
    lengths = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    parts = letter_parts(points, lengths)
    seen, keys, whole = [], [], []
    with np.errstate(over="ignore"):
        chosen = [mixed(sum(parts[p] for p in choice) + np.uint64(c + 1)) for c, choice in enumerate(CHOICES)]
        for extra in (0, 1):
            halves = half_hashes(points, lengths, lengths + extra)
            for side in (0, 1):
                stand = mixed(halves[side] + (lengths + extra).astype(np.uint64) * np.uint64(2 * FACTOR % (1 << 64) | 1) + np.uint64(side))
                for letters in chosen:
                    seen.append(np.arange(len(words)))
                    keys.append(mixed(letters ^ stand))
                    whole.append(np.full(len(words), extra == 0))
    return np.concatenate(seen), np.concatenate(keys).view(np.int64), np.concatenate(whole)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words that are one edit apart, once.

    ``words`` has distinct words and n. Signatures meet in an equi-join; the pairs that share one
    are verified by their edit distance, so an accidental equal hash gives no pair.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for begin in range(0, whole_batch.num_rows, CHUNK_WORDS):
                batch = whole_batch.slice(begin, CHUNK_WORDS)
                seen, keys, whole = signatures(batch.column(0).to_pylist())
                at = pa.array(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(whole), batch.column(0).take(at), batch.column(1).take(at)], ["key", "whole", "word", "n"]
                )

    signed = words.where(F.length("word") > 0).select("word", "n").mapInArrow(sign, "key long, whole boolean, word string, n long")
    longer = signed.where("whole").select("key", "word", "n")
    other = signed.select("key", "whole", F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Words of equal length stand on both sides: the smaller one leads. A shorter partner follows.
    once = ~F.col("whole") & (F.length("near") < F.length("word")) | F.col("whole") & (F.col("word") < F.col("near"))
    pairs = longer.join(other, "key").where(once & (F.levenshtein("word", "near", 1) == 1))
    pairs = pairs.select("word", "n", "near", "near_n").distinct()
    sides = F.array(
        F.struct("word", "n", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    return pairs.select(F.inline(sides))


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that forms (word, form) lead to, by pointer doubling.

    A form occurs more often than its word, so the way ends; every step doubles its length.
    """
    ways = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = saved(ways.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ways = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return ways


def spelling_variants(
    docs: DataFrame, *, ratio: int = RATIO, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of all texts.

    Words and their counts are those of :func:`count_words`. Two words are near if they differ by
    exactly one inserted, deleted or replaced code point. The form of a word is its near word of
    largest n (ties: the smallest in code-point order) if that n is at least ``ratio`` times its
    own, else null; the root is where the forms lead, the word itself without one.

    Repeated rows count each time. An empty table or texts without words give an empty result.
    Other columns are ignored.
    """
    counted = count_words(docs, least_letters=least_letters, least_count=least_count, doc_id=doc_id, text=text)
    words = saved(counted)
    # By word, the smallest of (-n, near) is the most frequent near word, ties in code-point order.
    most = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("most")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), most)
    joined = words.join(near, "word", "left")
    form_n = -F.col("most.less")
    accepted = form_n >= F.col("n") * ratio
    judged = saved(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(accepted, F.col("most.near")).alias("form"),
            F.when(accepted, form_n).alias("form_n"),
        )
    )
    roots = follow_forms(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
