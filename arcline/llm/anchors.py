"""Anchored pieces: runs of windows that share a content-defined anchor, for exact repeat search."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .buffers import mixed, prefix_hashes, range_hashes


def first_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest of h[i : i + width], for every i that has so many values."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, reach = np.arange(len(h), dtype=np.int32 if len(h) < 1 << 31 else np.int64), 1
    while reach < width:
        step = min(reach, width - reach)
        later, now = best[step:], best[: len(best) - step]
        best = np.where(h[later] < h[now], later, now)
        reach += step
    return best


def spread(minima: np.ndarray) -> np.ndarray:
    """Anchor hashes dealt evenly: smallest values of a window all begin with zero bits."""
    return mixed(minima + np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Pieces:
    """Maximal runs of windows of a row with one anchor; positions count within the chunk."""

    row: np.ndarray
    start: np.ndarray  # first window
    count: np.ndarray  # windows
    anchor: np.ndarray  # hash of the anchor gram
    content: np.ndarray  # hash of all symbols of the run


def anchored_pieces(values: np.ndarray, first: np.ndarray, window: int, gram: int) -> Pieces:
    """Pieces of rows laid end to end (``first``: rows + 1 offsets); equal windows anywhere have
    equal anchors, and equal pieces equal content."""
    prefix = prefix_hashes(values)
    grams = range_hashes(prefix, np.arange(max(len(values) - gram + 1, 0)), np.arange(gram, max(len(values), gram - 1) + 1))
    anchor = first_minima(grams, window - gram + 1)
    counts = np.maximum(np.diff(first) - (window - 1), 0)
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][row]
    if not len(row):
        none = np.zeros(0, np.int64)
        return Pieces(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    own = anchor[start]
    new = np.ones(len(row), bool)
    new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(row)))
    begin = start[at]
    return Pieces(row[at], begin, count, spread(grams[own[at]]), range_hashes(prefix, begin, begin + count - 1 + window))
