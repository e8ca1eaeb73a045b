"""Removal of repeated word spans by De Bruijn compaction."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import Chunk, Words, find_words, prefix_hashes, range_hashes, text_chunks, word_hashes
from .repeats import (
    ASKED,
    COVERED,
    NOTES,
    NOTES_DDL,
    PACKED,
    Runs,
    arrow_schema,
    as_batch,
    by_part,
    note_rows,
    piece_notes,
    prepared,
    removed_mask,
    runs_by_row,
    split_rows,
    unpack,
    RUN_KINDS,
)

WINDOW, GRAM = 13, 5


def word_symbols(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    words = find_words(chunk)
    return word_hashes(chunk, words), words.first


def kept_bytes(chunk: Chunk, words: Words, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of all rows joined by one space: bytes, and rows + 1 offsets."""
    starts, ends, row = words.starts[~removed], words.ends[~removed], words.rows[~removed]
    change = np.zeros(len(chunk.data) + 1, np.int8)
    change[starts] += 1
    change[ends] -= 1
    keep = np.cumsum(change[:-1], dtype=np.int8) > 0
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    # A word that is not its row's last has white space behind it.
    spaces = ends[~last]
    data = chunk.data.copy()
    data[spaces] = 32
    keep[spaces] = True
    return data[keep], np.concatenate(([0], np.cumsum(keep)))[chunk.offsets]


def remove_repeated_words(
    docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text",
    carry: tuple[str, ...] = (), keep_layout: bool = False,
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, n_spans, spans, kept_text, kept_sha256, and a struct
    ``carried`` of the columns named by ``carry``, if any. kept_text is the kept words joined by
    one space; with ``keep_layout`` a text that loses nothing stays as it is (null stays null).

    Every window of ``window`` words is an edge of a De Bruijn graph over the documents. A word is
    removed when it lies in an edge that also starts in a document with a smaller id; spans are
    the removed runs, as (first word, words).

    * Edges that share their smallest ``gram``-word gram form a path piece through that anchor.
      Pieces meet by anchor; where an anchor has one piece content the path does not branch and the
      piece is settled as a whole. Only at branching anchors do edges meet one by one.
    * Settled runs meet their document by its id; runs that touch or overlap in the coordinates
      of that source compact into one span, which is checked against the edges it is made of.

    Contents are compared by hashes of over 70 bits (edges at branches: 64). Null text has no
    words. A null doc_id counts as larger than every id. Rows that repeat an id do not remove each
    other; rows of an id with different texts are settled separately. Texts with fewer words than a
    window keep all. Empty tables give empty results; other columns are ignored unless carried.
    """
    rows, sizes = prepared(docs, doc_id, text, carry)
    notes = piece_notes(rows, sizes, word_symbols, window, gram)
    placed = by_part(rows, sizes)
    bits, parts = sizes.bits, sizes.parts
    sent = arrow_schema("bucket")

    def edges(texts: pa.Table, asked: pa.Table) -> pa.Table:
        """Asked edges of a part's documents, dealt by hash."""
        found = []
        if asked.num_rows and texts.num_rows:
            row, runs = runs_by_row(texts["id"].to_numpy(), texts["version"].to_numpy(), asked)
            for chunk in text_chunks(texts["text"]):
                mine = (row >= chunk.first) & (row < chunk.first + chunk.rows)
                if not mine.any():
                    continue
                values, first = word_symbols(chunk)
                own = runs[mine]
                begin = first[row[mine] - chunk.first] + own.starts
                which = np.repeat(np.arange(len(begin)), own.counts)
                inside = np.arange(len(which)) - np.repeat(np.cumsum(own.counts, dtype=np.int64) - own.counts, own.counts)
                at = begin[which] + inside
                code = range_hashes(prefix_hashes(values), at, at + window)
                found += split_rows(
                    (code >> np.uint64(64 - bits)).astype(np.int64),
                    [own.ids[which], own.versions[which], own.starts[which] + inside, np.ones(len(which)), code],
                    [*RUN_KINDS, np.uint64],
                    (ASKED,),
                )
        return pa.Table.from_batches([as_batch(found, sent)])

    def settle(table: pa.Table) -> pa.Table:
        runs = Runs.joined([table[n].to_pylist() for n in ("ids", "versions", "starts", "counts")])
        code = np.concatenate([unpack(b, np.uint64) for b in table["codes"].to_pylist()])
        order = np.argsort(code)
        code, runs = code[order], runs[order]
        at = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        least = np.repeat(np.minimum.reduceat(runs.ids, at), np.diff(np.append(at, len(code))))
        return pa.Table.from_batches([as_batch(note_rows(runs[runs.ids > least], COVERED, parts), NOTES)])

    def compact(texts: pa.Table, covered: pa.Table) -> pa.Table:
        ids = texts["id"].to_numpy()
        row, runs = runs_by_row(ids, texts["version"].to_numpy(), covered)
        missing = texts["text"].is_null().to_numpy()
        results = []
        for chunk in text_chunks(texts["text"]):
            words = find_words(chunk)
            mine = (row >= chunk.first) & (row < chunk.first + chunk.rows)
            removed = removed_mask(row[mine] - chunk.first, runs[mine], words.first, window)
            data, cuts = kept_bytes(chunk, words, removed)
            sums = np.concatenate(([0], np.cumsum(removed)))[words.first]
            edge = np.diff(np.concatenate(([0], removed.astype(np.int8))))
            begins = edge == 1
            begins[words.first[:-1][words.first[:-1] < len(removed)]] |= removed[words.first[:-1][words.first[:-1] < len(removed)]]
            start = np.flatnonzero(begins)
            stops = np.concatenate((np.flatnonzero(~removed), words.first[1:]))
            stops.sort()
            end = stops[np.searchsorted(stops, start, "right")] if len(start) else start
            of = np.searchsorted(start, words.first)
            body = data.tobytes()
            whole_text = chunk.data.tobytes() if keep_layout else b""
            for k in range(chunk.rows):
                kept = body[cuts[k] : cuts[k + 1]]
                a, b = of[k], of[k + 1]
                spans = [{"first": int(s - words.first[k]), "words": int(e - s)} for s, e in zip(start[a:b], end[a:b], strict=True)]
                gone = int(sums[k + 1] - sums[k])
                shown = kept.decode("utf-8")
                if keep_layout and not gone:
                    shown = None if missing[chunk.first + k] else whole_text[chunk.offsets[k] : chunk.offsets[k + 1]].decode("utf-8")
                count = int(words.first[k + 1] - words.first[k])
                results.append((count, gone, b - a, spans, shown, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*results, strict=True)) if results else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())])), pa.string(), pa.string()]
        names = ["doc_id", "n_words", "n_removed", "n_spans", "spans", "kept_text", "kept_sha256"]
        arrays = [texts["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
        if carry:
            arrays.append(texts["carried"])
        return pa.Table.from_arrays(arrays, names + ["carried"] * bool(carry))

    whole = placed.groupBy("part")
    asked = notes.where(F.col("kind") == ASKED).groupBy("part")
    branches = whole.cogroup(asked).applyInArrow(edges, f"bucket int, {PACKED}").groupBy("bucket").applyInArrow(settle, NOTES_DDL)
    covered = notes.where(F.col("kind") == COVERED).unionByName(branches).groupBy("part")
    kinds = dict(rows.dtypes)
    return whole.cogroup(covered).applyInArrow(
        compact,
        f"doc_id {kinds['doc_id']}, n_words long, n_removed long, n_spans long,"
        " spans array<struct<first: int, words: int>>, kept_text string, kept_sha256 string"
        + (f", carried {kinds['carried']}" if carry else ""),
    )
