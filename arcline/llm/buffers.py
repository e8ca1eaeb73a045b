"""Arrow text columns as byte arrays: chunks, words and rolling hashes with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes of text whose arrays a worker holds at once (a longer text is a chunk of its own).
CHUNK_BYTES = 1 << 20

# Odd multiplier of the polynomial hash mod 2**64, its inverse, and the random value of each byte.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Chunk:
    """Consecutive rows of a batch: row numbers, text bytes and offsets (rows + 1 values)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of about ``limit`` bytes of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Chunk(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Words of a chunk: byte ranges, and for each row the index of its first word."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(chunk: Chunk) -> Words:
    """Runs of bytes other than white space; a row's end always ends a word."""
    solid = ~SPACE[chunk.data]
    edge = np.zeros(len(solid) + 1, bool)
    edge[chunk.offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, chunk.offsets))


class Powers:
    """Powers of BASE and of its inverse, grown as needed and kept by the worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= len(cls.up):
            size = max(n + 1, 1 << 16)
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, BASE))), dtype=np.uint64)
                cls.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, INVERSE))), dtype=np.uint64)
        return cls.up, cls.down


def mixed(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes: every bit of the result depends on every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values x BASE**place; ranges of them are hashes, see range_hashes."""
    up, _ = Powers.upto(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


# Longer ranges are hashed in parts: modulo a power of two, sums of powers can be made equal for
# some sequences of a thousand values and more, whatever the base is.
PART = 256


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range [start, end): equal for equal content anywhere in any chunk."""
    _, down = Powers.upto(len(prefix))
    long = np.flatnonzero(ends - starts > PART)
    out = mixed((prefix[ends] - prefix[starts]) * down[starts])
    if not len(long):
        return out
    # Each part is mixed into what came before it, so parts cannot cancel each other.
    state, at, stop = (ends - starts)[long].astype(np.uint64), starts[long].copy(), ends[long]
    going = np.arange(len(long))
    while len(going):
        here = at[going]
        to = np.minimum(here + PART, stop[going])
        part = mixed((prefix[to] - prefix[here]) * down[here])
        state[going] = mixed((state[going] ^ part) * BASE + part)
        at[going] = to
        going = going[to < stop[going]]
    out[long] = state
    return out


def word_hashes(chunk: Chunk, words: Words, data: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of every word; ``data`` may be the chunk's bytes in another case."""
    prefix = prefix_hashes(BYTE_VALUES[chunk.data if data is None else data])
    return range_hashes(prefix, words.starts, words.ends)


def run_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of n values that stay inside one row, and the row of each."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(before, counts) + np.repeat(first[:-1], counts), rows
