"""Document fingerprints by randomised edit embedding and bit-sampled bands."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import mixed
from .columns import saved
from .graphs import connected

# Pieces: cut where a hash of four characters has six zero bits, and after LONGEST characters.
CUT_MASK, LONGEST = np.uint32(63), 512
# A slot looks at one piece, chosen by a hash of its first START characters, and samples SLOT_BITS steps.
SLOTS, SLOT_BITS, START = 128, 8, 16
BITS = SLOTS * SLOT_BITS
# Code points whose arrays a worker holds at once.
CHUNK_POINTS = 1 << 20
# Order of rows of one id: by this hash of the text.
TEXT_SEED = 17

_random = np.random.default_rng(20240502)
STEPS = 3 * LONGEST
# Shared random walk: advance or stay at step j on a character of class c; classes are hashed.
ADVANCE = _random.integers(0, 2, (STEPS, 256), dtype=np.uint8)
SLOT_SEED = _random.integers(1, 1 << 63, SLOTS, dtype=np.uint64)
START_FACTOR = _random.integers(1, 1 << 63, START, dtype=np.uint64) | np.uint64(1)
# Bit that a class shows where the sample k looks.
SHOWN_BIT = _random.integers(0, 2, (BITS, 256), dtype=np.uint8)


def _sampled_steps() -> np.ndarray:
    """Sampled step per (steps walked, sample): of the steps walked the first in a random order.

    Walks of like length sample the same steps, so an edit that changes the length moves few samples.
    """
    order = _random.random((STEPS, BITS), np.float32)
    first = order == np.minimum.accumulate(order, axis=0)
    step = np.where(first, np.arange(STEPS, dtype=np.int16)[:, None], np.int16(0))
    return np.maximum.accumulate(step, axis=0)


SAMPLED = _sampled_steps()
# Shared order of the bits in every band.
BANDS = 32
BAND_ORDER = np.stack([_random.permutation(BITS) for _ in range(BANDS)])
BAND_SEED = _random.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def cut_pieces(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of all rows laid end to end; pieces do not cross rows."""
    n = len(points)
    cut = np.zeros(n + 1, bool)
    if n > 4:
        p = points.astype(np.uint32)
        h = p[:-3] * np.uint32(0x9E3779B1) + p[1:-2] * np.uint32(0x85EBCA6B) + p[2:-1] * np.uint32(0xC2B2AE35) + p[3:] * np.uint32(0x27D4EB2F)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        cut[4:][(h >> np.uint32(9) & CUT_MASK) == 0] = True
    # Four characters that begin in the row before say nothing of this row.
    for inside in (1, 2, 3):
        cut[np.minimum(offsets + inside, n)] = False
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    starts, lengths = edges[:-1], np.diff(edges)
    parts = -(-lengths // LONGEST)
    at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(starts, parts) + at * LONGEST
    return begin, np.minimum(begin + LONGEST, np.repeat(edges[1:], parts))


def classes_of(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of every character with the two after it in its piece.

    Single characters agree by chance too often: unlike texts would seem a little alike.
    """
    value = points.astype(np.uint32)
    seen = value * np.uint32(0x9E3779B1)
    for ahead, factor in ((1, 0x85EBCA6B), (2, 0xC2B2AE35)):
        follows = np.zeros(len(value), np.uint32)
        follows[:-ahead] = value[ahead:]
        for back in range(1, ahead + 1):
            follows[np.maximum(ends - back, 0)] = 0
        seen += follows * np.uint32(factor)
    seen ^= seen >> np.uint32(15)
    seen *= np.uint32(0x2C1B3C6D)
    return (seen >> np.uint32(20)).astype(np.uint8)


class Walks:
    """Random walks over pieces, all of them side by side.

    A piece of n characters is walked for at most 3n steps: each step shows the current character's
    class and the shared randomness says whether to go on to the next. Pieces at a small edit distance
    soon walk in step again, so few of the shown characters differ: edit distance becomes Hamming
    distance. The shown classes are kept by step, the longest pieces first.
    """

    def __init__(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        classes = np.concatenate((classes_of(points, ends), np.zeros(1, np.uint8)))
        order = np.argsort(starts - ends, kind="stable")
        at, end = starts[order].copy(), ends[order]
        active = np.searchsorted(-3 * (end - at), -np.arange(STEPS), "left")
        self.first = np.concatenate(([0], np.cumsum(active)))
        self.shown = np.empty(self.first[-1], np.uint8)
        self.walked = np.zeros(len(order), np.int16)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        for step in range(STEPS):
            n = active[step]
            if not n:
                break
            shown = classes[at[:n]]
            going = at[:n] < end[:n]
            self.shown[self.first[step] : self.first[step + 1]] = shown
            self.walked[:n] += going
            at[:n] += ADVANCE[step][shown] & going

    def sample(self, pieces: np.ndarray, slot: int) -> np.ndarray:
        """Bits (pieces x SLOT_BITS) that a slot samples from the walks of ``pieces``."""
        rank = self.rank[pieces]
        samples = np.arange(slot * SLOT_BITS, (slot + 1) * SLOT_BITS)
        steps = SAMPLED[self.walked[rank] - 1][:, samples]
        return SHOWN_BIT[samples, self.shown[self.first[steps] + rank[:, None]]]


def start_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the first START characters of every piece (of all, where it has fewer)."""
    keys = np.zeros(len(starts), np.uint64)
    for k in range(START):
        has = np.flatnonzero(starts + k < ends)
        keys[has] += (points[starts[has] + k].astype(np.uint64) + np.uint64(1)) * START_FACTOR[k]
    return mixed(keys)


def fingerprints(texts: list[str]) -> np.ndarray:
    """Fingerprints (texts x BITS / 8 bytes): bits sampled from the embedded pieces.

    Every slot chooses the piece whose start has the smallest hash under the slot's seed (the
    first of equal ones) and samples steps of its walk. The empty text has all ones.
    """
    out = np.full((len(texts), SLOTS), 0xFF, np.uint8)
    place = np.uint64((1 << 24) - 1)
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK_POINTS):
            size += len(texts[last])
            last += 1
        part = texts[first:last]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in part])))
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, ends = cut_pieces(points, offsets)
        if len(starts):
            walks = Walks(points, starts, ends)
            keys = start_keys(points, starts, ends)
            rows = np.flatnonzero(np.diff(offsets))
            cuts = np.searchsorted(starts, offsets[:-1][rows])
            number = np.arange(len(starts), dtype=np.uint64)
            for slot in range(SLOTS):
                least = np.minimum.reduceat(mixed(keys ^ SLOT_SEED[slot]) & ~place | number, cuts)
                bits = walks.sample((least & place).astype(np.int64), slot)
                out[first + rows, slot] = np.packbits(bits, axis=1)[:, 0]
        first = last
    return out


def as_text(prints: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in prints]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints, 0 where half of the bits or more differ, linear in the Hamming distance."""
    distance = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return np.maximum(0.0, 1 - 2 * distance / BITS)


def range_heads(rows: DataFrame, part_chars: int, samples: int = 16) -> list[tuple]:
    """Ascending first keys of ranges of about ``part_chars`` characters; every one is a row's key.

    Keys are (no id, id, hash of the text) of the rows whose own hash is small, ``samples`` a range
    on average: ids of any type that has an order, rows without an id and rows of one id are split alike.
    """
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "hash")
    found = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0)), F.min(key)).first()
    parts = max(1, min(found[0], -(-found[1] // part_chars)))
    if found[2] is None:
        return []
    least = tuple(found[2])
    if parts == 1:
        return [least]
    every = max(1, found[0] // (samples * parts))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "hash"), F.lit(every)) == 0).select(key.alias("key")).distinct()
    keys = sorted((tuple(r[0]) for r in chosen.collect()), key=_ordered)
    cuts = [keys[i * len(keys) // parts] for i in range(1, parts)] if keys else []
    return sorted({least, *cuts}, key=_ordered)


def _ordered(key: tuple) -> tuple:
    """A range key that compares also where the id is missing."""
    return (key[0], 0 if key[0] else key[1], key[2])


def fingerprint_documents(
    docs: DataFrame, *, part_chars: int = 8 << 20, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A text is cut into pieces by its content (64 characters on average, 512 at most); each
    piece is embedded by the shared random walk. 128 slots choose a piece each by its start and
    sample eight bits of its walk. Likeness is linear in the Hamming distance of the sampled bits.

    The edited text replaces the last half of a row's characters by the first as many of the next
    row, in ascending order of doc_id, null ids last, rows of one id by a hash of the text, after
    the last the first. Rows are dealt into ranges of (id, hash) (16 keys per ``part_chars``
    characters are all that reaches the driver; give larger ranges for very large tables), sorted
    within ranges, and every range also receives the first row of the next one, so no task orders
    the whole table and neither rows without an id nor those of one id gather.

    Null text counts as empty. A single row is its own next row. Repeated rows are each other's
    next rows. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text", F.lit(TEXT_SEED)))
    heads = [_ordered(key) for key in range_heads(rows, part_chars)]
    last = max(len(heads) - 1, 0)

    @F.arrow_udf("struct<part: int, head: boolean>")
    def place(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        keys = [_ordered((i is None, i, h)) for i, h in zip(ids.to_pylist(), hashes.to_pylist(), strict=True)]
        part = [max(bisect_right(heads, key) - 1, 0) for key in keys]
        head = [heads[p] == key for p, key in zip(part, keys, strict=True)]
        return pa.StructArray.from_arrays([pa.array(part, pa.int32()), pa.array(head, pa.bool_())], ["part", "head"])

    placed = rows.withColumn("place", place("doc_id", "hash"))
    here = F.struct(F.col("place.part").alias("part"), F.lit(0).alias("copy"))
    before = F.when(F.col("place.part") > 0, F.col("place.part") - 1).otherwise(F.lit(last))
    copies = F.when(F.col("place.head"), F.array(here, F.struct(before.alias("part"), F.lit(1).alias("copy")))).otherwise(
        F.array(here)
    )
    dealt = (
        placed.select("doc_id", "text", "hash", F.explode(copies).alias("to"))
        .select("doc_id", "text", "to.part", "to.copy", "hash")
        .repartition("part")
        .sortWithinPartitions("part", "copy", F.col("doc_id").asc_nulls_last(), "hash", F.col("text").asc_nulls_last())
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids, texts, parts, copy = (part.column(i).to_pylist() for i in range(4))
                new = [(i, t or "", p, c) for i, t, p, c in zip(ids, texts, parts, copy, strict=True)]
                held = ([carried] if carried else []) + new
                carried = held[-1]
                yield from pairs(held, batch.schema.field(0).type)

    def pairs(held: list, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        own = [k for k in range(len(held) - 1) if held[k][3] == 0 and held[k + 1][2] == held[k][2]]
        texts = [h[1] for h in held]
        edited = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][: len(texts[k]) // 2] for k in own]
        prints, changed = fingerprints(texts), fingerprints(edited)
        mine = np.array(own, np.int64)
        shown = as_text(prints)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([held[k][0] for k in own], kind),
                pa.array([len(texts[k]) for k in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                pa.array([shown[k] for k in own], pa.string()),
                pa.array(as_text(changed), pa.string()),
                pa.array(likeness(prints[mine], changed) if own else [], pa.float64()),
                pa.array(likeness(prints[mine], prints[mine + 1]) if own else [], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    name = dict(rows.dtypes)["doc_id"]
    return dealt.mapInArrow(
        sketch,
        f"doc_id {name}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )


def print_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row, without a shuffle; null text counts as empty, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                prints = as_text(fingerprints([t or "" for t in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint string")


def groups_of(prints: DataFrame) -> DataFrame:
    """(fingerprint, rep) with the smallest id of every fingerprint; rows without an id have none."""
    known = prints.where(F.col("doc_id").isNotNull())
    return saved(known.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")))


def near_documents(prints: DataFrame, **options) -> DataFrame:
    """Links (doc_id, near_id, likeness) between documents of like fingerprints.

    ``prints`` has doc_id and fingerprint; rows without an id link with nothing. Equal fingerprints
    count as one document of the smallest id, which all others link to with likeness 1; these are
    linked as ``near_prints`` says, whose options these are. Repeated rows count once; an empty
    table gives no links.
    """
    groups = groups_of(prints)
    copies = prints.join(groups, "fingerprint").where("doc_id <> rep").distinct()
    copies = copies.select("doc_id", F.col("rep").alias("near_id"), F.lit(1.0).alias("likeness"))
    return copies.unionByName(near_prints(groups, **options))


def near_classes(prints: DataFrame, **options) -> DataFrame:
    """Every row of ``prints`` with class_id: the smallest id that links of ``near_prints`` reach.

    A document without links is its own class. A row without an id belongs to the class of the
    documents of its fingerprint, to none if there are no such documents.
    """
    groups = groups_of(prints)
    links = near_prints(groups, **options)
    roots = connected(links.select(F.col("doc_id").alias("a"), F.col("near_id").alias("b")))
    joined = groups.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classes = joined.select("fingerprint", F.coalesce("root", "rep").alias("class_id"))
    return prints.join(classes, "fingerprint", "left").select(*prints.columns, "class_id")


def near_prints(groups: DataFrame, *, at_least: float = 0.75, band_bits: int = 24, more_bits: int = 6) -> DataFrame:
    """Links (doc_id, near_id, likeness) between the rows (fingerprint, rep) of ``groups``.

    The rows meet in 32 bands of ``band_bits`` sampled bits. In every band one member, the head,
    is held against all others; those with at least ``at_least`` are linked to it, the rest of
    the band is split by its next ``more_bits`` bits and goes on until nobody is left with
    another. So a band of any size costs one comparison per member and round, members unlike the
    head still meet each other, and documents of a class are joined through heads.
    """
    name = dict(groups.dtypes)["rep"]

    def keys(used: int):
        """Per band the hash of its first ``used`` bits; of the bands that a row's mask names."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                bits = np.unpackbits(_bytes(batch.column(1)), axis=1)
                masks = batch.column(2).to_numpy()
                for band in range(BANDS):
                    row = np.flatnonzero(masks >> band & 1)
                    seen = np.packbits(bits[row][:, BAND_ORDER[band, :used]], axis=1)
                    key = np.full(len(row), BAND_SEED[band])
                    for column in seen.T:
                        key = mixed(key ^ column.astype(np.uint64))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array(np.full(len(row), 1 << band, np.int64)), pa.array(key.view(np.int64))],
                        ["rep", "mask", "key"],
                    )

        return run

    @F.arrow_udf("double")
    def like(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(likeness(_bytes(a), _bytes(b)) if len(a) else [], pa.float64())

    every = F.lit((1 << BANDS) - 1).cast("long")
    found, left, used = [], groups.select("rep", "fingerprint", every.alias("mask")), band_bits
    while True:
        keyed = left.mapInArrow(keys(min(used, BITS)), f"rep {name}, mask long, key long")
        # Only keys of several members matter; the smallest is their head.
        heads = keyed.groupBy("key").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
        met = keyed.join(heads.select("key", "head"), "key").where("rep <> head")
        pairs = met.groupBy("rep", "head").agg(F.bit_or("mask").alias("mask"))
        other = groups.select(F.col("rep").alias("head"), F.col("fingerprint").alias("other"))
        held = saved(pairs.join(groups, "rep").join(other, "head").withColumn("likeness", like("fingerprint", "other")).drop("other"))
        near = F.col("likeness") >= at_least
        found.append(held.where(near).select(F.col("rep").alias("doc_id"), F.col("head").alias("near_id"), "likeness"))
        apart = held.where(~near)
        if used >= BITS or apart.isEmpty():
            break
        left, used = apart.groupBy("rep", "fingerprint").agg(F.bit_or("mask").alias("mask")), used + more_bits
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def _bytes(prints: pa.Array) -> np.ndarray:
    """Fingerprints (rows x SLOTS) of their hexadecimal text."""
    return np.frombuffer(bytes.fromhex("".join(prints.to_pylist())), np.uint8).reshape(-1, SLOTS)
