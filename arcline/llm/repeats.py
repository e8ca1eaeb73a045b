"""Exact search for windows that start in an earlier document too, over anchored pieces.

Documents are sequences of symbols (words or bytes). Windows of one row that share an anchor
form a piece; equal windows anywhere have the same anchor. Three exchanges settle every window:

1. Pieces are dealt into buckets by anchor. Equal pieces are settled as a whole: all but those
   of the smallest document are covered. Where an anchor has several different pieces (a branch)
   the first of each asks for its windows one by one.
2. Asked windows are cut from the texts, dealt by content, and settled by the operator's method.
3. Covered runs meet their document.

Pieces travel as packed arrays, one row per chunk of text and bucket. Of pieces repeated inside a
chunk only the smallest document's are sent on, so a passage that a third of all documents share
reaches its bucket once per chunk. The number of buckets and parts grows with the bytes of text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchored_pieces
from .buffers import CHUNK_BYTES, Chunk, text_chunks
from .columns import saved

# Bytes of text per bucket of pieces and per part of documents.
PART_BYTES = 4 << 20
# A piece's code within its bucket: 28 bits of its anchor above 36 bits of its content.
ANCHOR_BITS, CONTENT_BITS = 28, 36
LAST_ID = (1 << 63) - 1
COVERED, ASKED = 0, 1

PACKED = "kind int, ids binary, versions binary, starts binary, counts binary, codes binary"


def pack(values: np.ndarray) -> bytes:
    """Bytes of an integer array plane by plane, so that equal high bytes lie together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes() if len(values) else b""


def unpack(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_versions(versions: np.ndarray) -> bytes:
    """As pack; nothing where all versions are 0, as they are unless an id has different texts."""
    return pack(versions.astype(np.int64)) if versions.any() else b""


def unpack_versions(data: bytes, ids: bytes) -> np.ndarray:
    return unpack(data, np.int64) if data else np.zeros(len(ids) // 8, np.uint8)


def pack_all(arrays: list[np.ndarray], kinds: list) -> list[bytes]:
    """Packed arrays of which the second are versions."""
    return [pack_versions(a) if i == 1 else pack(a.astype(k)) for i, (a, k) in enumerate(zip(arrays, kinds, strict=True))]


@dataclass
class Runs:
    """Runs of windows: document id and version, first window in the row, number of windows."""

    ids: np.ndarray
    versions: np.ndarray
    starts: np.ndarray
    counts: np.ndarray

    def __getitem__(self, chosen: np.ndarray) -> Runs:
        return Runs(self.ids[chosen], self.versions[chosen], self.starts[chosen], self.counts[chosen])

    def packed(self) -> list[bytes]:
        return pack_all([self.ids, self.versions, self.starts, self.counts], RUN_KINDS)

    @classmethod
    def joined(cls, columns: list[list[bytes]]) -> Runs:
        ids, versions, starts, counts = columns
        found = [[unpack(b, np.int64) for b in ids], [unpack_versions(b, i) for b, i in zip(versions, ids, strict=True)]]
        found += [[unpack(b, np.uint32) for b in starts], [unpack(b, np.uint16) for b in counts]]
        return cls(*(np.concatenate(c or [np.zeros(0, k)]) for c, k in zip(found, RUN_KINDS, strict=True)))


def split_rows(place: np.ndarray, arrays: list[np.ndarray], kinds: list, extra: tuple = ()) -> list[tuple]:
    """One row (place, *extra, packed arrays) per distinct place, order inside kept."""
    order = np.argsort(place, kind="stable")
    place = place[order]
    arrays = [a[order] for a in arrays]
    cuts = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
    return [
        (int(place[a]), *extra, *pack_all([values[a:b] for values in arrays], kinds)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)
    ]


def part_of(ids: np.ndarray, versions: np.ndarray, parts: int) -> np.ndarray:
    """Part of a row, by its id and version."""
    key = ids ^ versions
    h = ((key ^ (key >> 31)) & 0x7FFFFFFF) * 0x9E3779B1
    return (h >> 20) % parts


RUN_KINDS = [np.int64, np.int64, np.uint32, np.uint16]


def note_rows(runs: Runs, kind: int, parts: int) -> list[tuple]:
    return split_rows(part_of(runs.ids, runs.versions, parts), [runs.ids, runs.versions, runs.starts, runs.counts], RUN_KINDS, (kind,))


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow_schema(place: str) -> pa.Schema:
    return pa.schema(
        [(place, pa.int32()), ("kind", pa.int32())]
        + [(n, pa.binary()) for n in ("ids", "versions", "starts", "counts", "codes")]
    )


NOTES = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *((n, pa.binary()) for n in ("ids", "versions", "starts", "counts"))])
NOTES_DDL = "part int, kind int, ids binary, versions binary, starts binary, counts binary"

# Symbols of a chunk: one value per symbol, and rows + 1 offsets into them.
Symbols = Callable[[Chunk], tuple[np.ndarray, np.ndarray]]


@dataclass
class Sizes:
    bits: int
    parts: int

    @property
    def buckets(self) -> int:
        return 1 << self.bits


def prepared(docs: DataFrame, doc_id: str, text: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, Sizes]:
    """Rows (doc_id, id, version, text, and a struct ``carried``) and the numbers of buckets and parts.

    A null id counts after every other. The version, a 64-bit hash of the text, tells apart rows
    of one id with different texts; it is 0 for all null ids, or for all others, if none there differ.
    """
    carried = [F.struct(*carry).alias("carried")] if carry else []
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *carried)
    hashed = rows.groupBy("doc_id").agg(
        F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"), F.sum(F.octet_length("text")).alias("size")
    )
    differ, missing = F.col("low") != F.col("high"), F.col("doc_id").isNull()
    size, unnamed, named = hashed.agg(
        F.coalesce(F.sum("size"), F.lit(0)), F.count(F.when(differ & missing, 1)), F.count(F.when(differ & ~missing, 1))
    ).first()
    wanted = max(8, -(-size // PART_BYTES))
    sizes = Sizes((wanted - 1).bit_length(), wanted)
    told_apart = F.when(F.col("doc_id").isNull(), F.lit(unnamed > 0)).otherwise(F.lit(named > 0))
    rows = rows.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"),
        F.when(told_apart, F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("version"),
        "text",
        *(["carried"] if carry else []),
    )
    return rows, sizes


def piece_notes(
    rows: DataFrame, sizes: Sizes, symbols: Symbols, window: int, gram: int, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """First exchange: covered and asked runs by part (see NOTES_DDL), written to the shared folder."""
    bits, buckets, parts = sizes.bits, sizes.buckets, sizes.parts
    sent = arrow_schema("bucket")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for chunk in text_chunks(batch.column(2), chunk_bytes):
                values, first = symbols(chunk)
                pieces = anchored_pieces(values, first, window, gram)
                if not len(pieces.row):
                    continue
                row = chunk.first + pieces.row
                runs = Runs(ids[row], versions[row], pieces.start - first[pieces.row], pieces.count)
                order = np.argsort(pieces.content)
                content = pieces.content[order]
                at = np.flatnonzero(np.concatenate(([True], content[1:] != content[:-1])))
                least = np.repeat(np.minimum.reduceat(runs.ids[order], at), np.diff(np.append(at, len(order))))
                covered = np.zeros(len(order), bool)
                covered[order] = runs.ids[order] > least
                found = []
                if covered.any():
                    found.append((int(content[0] % np.uint64(buckets)), COVERED, *runs[covered].packed(), b""))
                rest, anchor, content = runs[~covered], pieces.anchor[~covered], pieces.content[~covered]
                bucket = (anchor >> np.uint64(64 - bits)).astype(np.int64)
                code = (anchor << np.uint64(bits)) >> np.uint64(64 - ANCHOR_BITS) << np.uint64(CONTENT_BITS)
                code |= content >> np.uint64(64 - CONTENT_BITS)
                found += split_rows(
                    bucket, [rest.ids, rest.versions, rest.starts, rest.counts, code], [*RUN_KINDS, np.uint64], (ASKED,)
                )
                yield as_batch(found, sent)

    def settle(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        columns = [table[n].to_pylist() for n in ("ids", "versions", "starts", "counts", "codes")]
        known = [[b for b, k in zip(c, kind, strict=True) if k == COVERED] for c in columns[:4]]
        found = note_rows(Runs.joined(known), COVERED, parts)
        mine = [[b for b, k in zip(c, kind, strict=True) if k == ASKED] for c in columns]
        if mine[0]:
            runs = Runs.joined(mine[:4])
            code = np.concatenate([unpack(b, np.uint64) for b in mine[4]])
            order = np.argsort(code)
            code, runs = code[order], runs[order]
            new = np.concatenate(([True], code[1:] != code[:-1]))
            at = np.flatnonzero(new)
            least = np.minimum.reduceat(runs.ids, at)
            covered = runs.ids > np.repeat(least, np.diff(np.append(at, len(code))))
            anchor = code >> np.uint64(CONTENT_BITS)
            first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            size = np.diff(np.append(first, len(code)))
            # An anchor whose first documents differ branches between documents.
            own = np.repeat(least, np.diff(np.append(at, len(code))))
            branch = np.repeat(np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first), size)
            found += note_rows(runs[covered], COVERED, parts)
            found += note_rows(runs[branch & ~covered], ASKED, parts)
        return pa.Table.from_batches([as_batch(found, NOTES)])

    dealt = rows.select("id", "version", "text").mapInArrow(send, f"bucket int, {PACKED}")
    return saved(dealt.groupBy("bucket").applyInArrow(settle, NOTES_DDL))


def by_part(rows: DataFrame, sizes: Sizes) -> DataFrame:
    """Rows with the part of their id and version; the hash is that of part_of."""
    key = F.col("id").bitwiseXOR(F.col("version"))
    low = key.bitwiseXOR(F.shiftright(key, 31)).bitwiseAND(F.lit(0x7FFFFFFF))
    h = F.shiftright(low * F.lit(0x9E3779B1), 20)
    return rows.withColumn("part", (h % F.lit(sizes.parts)).cast("int"))


def runs_by_row(ids: np.ndarray, versions: np.ndarray, notes: pa.Table) -> tuple[np.ndarray, Runs]:
    """Row of each run of a part's notes; a run meets every row of its id and version once."""
    runs = Runs.joined([notes[n].to_pylist() for n in ("ids", "versions", "starts", "counts")])
    order = np.lexsort((runs.counts, runs.starts, runs.versions, runs.ids))
    runs = runs[order]
    columns = (runs.ids, runs.versions, runs.starts, runs.counts)
    if len(order):
        runs = runs[np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))]
    order = np.lexsort((versions, ids))
    keys = np.rec.fromarrays([ids[order], versions[order].astype(np.int64)])
    wanted = np.rec.fromarrays([runs.ids, runs.versions.astype(np.int64)])
    low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
    times = high - low
    which = np.repeat(np.arange(len(times)), times)
    inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return order[low[which] + inside], runs[which]


def removed_mask(row: np.ndarray, runs: Runs, first: np.ndarray, window: int) -> np.ndarray:
    """True for every symbol that a covered window of its row covers."""
    change = np.zeros(first[-1] + 1, np.int64)
    begin = first[row] + runs.starts
    np.add.at(change, begin, 1)
    np.add.at(change, begin + runs.counts - 1 + window, -1)
    return np.cumsum(change[:-1]) > 0
