"""Language identification by cross-parsing entropy against suffix automata."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buffers import text_chunks
from .columns import small

UNKNOWN = "und"
# Symbols: 0 ends a training text, 1 is any run of non-letters, 2 a letter of no training text.
SPACE, OTHER = 1, 2
# Symbols below this, of the most frequent letters, have a full transition table; the others a sorted list.
DENSE = 48
# Texts are parsed in blocks of so many symbols, side by side; a phrase ends with its block.
BLOCK = 256


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 mod 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Alphabet:
    """Code points to symbols: lower-cased letters, one symbol for everything else."""

    def __init__(self, letters: str):
        self.letters = letters
        self._table = None

    def __getstate__(self):
        return {"letters": self.letters, "_table": None}

    @property
    def table(self) -> np.ndarray:
        if self._table is None:
            known = {c: i + 3 for i, c in enumerate(self.letters)}
            table = np.full(0x110000, SPACE, np.int32)
            for point in range(0x110000):
                c = chr(point)
                if c.isalpha():
                    table[point] = known.get(c.lower()[:1], OTHER)
            self._table = table
        return self._table

    def symbols(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of rows laid end to end, runs of non-letters as one, and the rows' offsets."""
        found = self.table[points]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != SPACE) | (found[:-1] != SPACE)
        keep[offsets[:-1][offsets[:-1] < len(found)]] = True
        places = np.concatenate(([0], np.cumsum(keep)))
        return found[keep], places[offsets]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is its root."""
    moves: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for s in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and s not in moves[at]:
            moves[at][s] = new
            at = link[at]
        if at >= 0:
            to = moves[at][s]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(moves)
                moves.append(moves[to].copy())
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[new] = twin
                while at >= 0 and moves[at].get(s) == to:
                    moves[at][s] = twin
                    at = link[at]
        last = new
    return moves


class LanguageModel:
    """One suffix automaton per language in a common transition table (state 0: no match)."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        counts = Counter(c for parts in texts.values() for text in parts for c in text.lower() if c.isalpha())
        self.alphabet = Alphabet("".join(sorted(counts, key=lambda c: (-counts[c], c))))
        self.symbols = len(counts) + 3
        known = {c: i + 3 for i, c in enumerate(self.alphabet.letters)}
        tables, self.roots, size = [np.zeros((1, DENSE), np.int32)], [], 1
        rare: list[tuple[int, int]] = []
        for language in self.languages:
            symbols: list[int] = []
            for text in texts[language]:
                before = 0
                for c in text.lower():
                    s = known.get(c, OTHER) if c.isalpha() else SPACE
                    if s != SPACE or before != SPACE:
                        symbols.append(s)
                    before = s
                symbols.append(0)
            moves = suffix_automaton(symbols)
            table = np.zeros((len(moves), DENSE), np.int32)
            for state, out in enumerate(moves):
                for s, to in out.items():
                    if s < DENSE:
                        table[state, s] = to + size
                    else:
                        rare.append(((state + size) * self.symbols + s, to + size))
            tables.append(table)
            self.roots.append(size)
            size += len(moves)
        self.table = np.concatenate(tables).ravel()
        rare.sort()
        # Ends with a key above all others, so that every search finds a place.
        self.rare_keys = np.array([key for key, _ in rare] + [size * self.symbols], np.int64)
        self.rare_states = np.array([to for _, to in rare] + [0], np.int32)

    def move(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Next states of (languages x rows) states on symbol c of each row; 0 where there is none."""
        to = self.table[state * np.int32(DENSE) + np.minimum(c, DENSE - 1)]
        at = np.flatnonzero(c >= DENSE)
        if len(at):
            keys = state[:, at].astype(np.int64) * self.symbols + c[at]
            place = np.searchsorted(self.rare_keys, keys)
            to[:, at] = np.where(self.rare_keys[place] == keys, self.rare_states[place], 0)
        return to

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases (languages x rows) of a greedy longest-match parse, block by block."""
        rows = len(offsets) - 1
        blocks = -(-np.diff(offsets) // BLOCK)
        row = np.repeat(np.arange(rows), blocks)
        part = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = offsets[:-1][row] + part * BLOCK
        lengths = np.minimum(offsets[1:][row] - starts, BLOCK)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, row = starts[order], lengths[order], row[order]
        roots = np.asarray(self.roots, np.int32)[:, None]
        first = self.move(np.repeat(roots, self.symbols, axis=1), np.arange(self.symbols))
        # State 0 has no way on: a block starts there, and a symbol that a language lacks is a phrase of its own.
        state = np.zeros((len(self.roots), len(row)), np.int32)
        count = np.zeros((len(self.roots), len(row)), np.int32)
        active = np.searchsorted(-lengths, -np.arange(BLOCK), "left")
        for step in range(BLOCK):
            n = active[step]
            if not n:
                break
            c = symbols[starts[:n] + step]
            to = self.move(state[:, :n], c)
            miss = to == 0
            count[:, :n] += miss
            state[:, :n] = np.where(miss, first[:, c], to)
        return np.stack([np.bincount(row, weights=per, minlength=rows) for per in count])


def training_sample(
    labelled: DataFrame, *, total_chars: int, text_chars: int, doc_id: str, text: str, lang: str
) -> dict[str, list[str]]:
    """Bounded sample of labelled texts by language: ``total_chars`` shared by the languages.

    Per language the documents with the smallest hash of the id give ``text_chars`` characters
    each, from a place in the text that a hash of the id chooses. Only ids are ranked; the texts of
    the chosen ids are fetched by a join; of several texts of an id in a language one counts, so
    the sample is bounded in rows however often an id repeats.
    """
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    languages = labelled.select(lang).distinct().count()
    if not languages:
        return {}
    each = max(1, total_chars // languages // text_chars)
    order = Window.partitionBy(lang).orderBy(F.xxhash64(F.col(doc_id), F.lit(11)), doc_id)
    ids = labelled.select(doc_id, lang).distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each)
    places = F.greatest(F.length(text) - text_chars, F.lit(0)) + 1
    part = F.substring(F.col(text), F.pmod(F.xxhash64(F.col(doc_id), F.lit(13)), places).cast("int") + 1, F.lit(text_chars))
    rows = (
        labelled.join(small(ids.drop("_n"), each * languages, 32), [doc_id, lang])
        .select(lang, doc_id, part.alias("part"))
        .groupBy(lang, doc_id)
        .agg(F.min("part").alias("part"))
        .collect()
    )
    found: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if len(parts := found.setdefault(row[0], [])) < each:
            parts.append(row[2])
    return found


def identify_languages(
    docs: DataFrame,
    *,
    total_chars: int = 100_000,
    text_chars: int = 1_000,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, symbols.

    A suffix automaton per language is built from a bounded sample of labelled rows that are not
    held out (``total_chars`` shared evenly, ``text_chars`` of a document). Every whole text is
    parsed greedily into the longest phrases each automaton knows, in blocks of 256 symbols; the
    language needing fewest phrases per symbol wins, the smaller code on ties. The score is
    1 - fewest / second fewest phrases (1 with a single language). Letters are lower-cased, runs
    of other characters count as one space; every letter of the sample is a symbol of its own, all
    others are one. Only the text enters a prediction.

    Null text, empty text and text without a letter give 'und' with score 0, as do all rows when
    nothing is labelled. A null doc_id is not held out and not learned from. Repeated rows give
    repeated results, an empty table an empty one. Other columns are ignored.
    """
    labelled = docs.where(~held_out(F.col(doc_id)))
    texts = training_sample(
        labelled, total_chars=total_chars, text_chars=text_chars, doc_id=doc_id, text=text, lang=lang
    )
    model = LanguageModel(texts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for chunk in text_chunks(batch.column(2)):
                starts = np.concatenate(([0], np.cumsum((chunk.data & 0xC0) != 0x80)))[chunk.offsets]
                points = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
                symbols, offsets = model.alphabet.symbols(points, starts)
                total = np.diff(offsets)
                letters = np.diff(np.concatenate(([0], np.cumsum(symbols != SPACE)))[offsets])
                best = np.full(chunk.rows, len(model.languages))
                score = np.zeros(chunk.rows)
                if model.languages:
                    phrases = model.phrases(symbols, offsets)
                    named = letters > 0
                    best[named] = np.argmin(phrases, axis=0)[named]
                    ranked = np.sort(phrases, axis=0)[:, named]
                    score[named] = 1 - ranked[0] / ranked[1] if len(ranked) > 1 else 1.0
                rows = slice(chunk.first, chunk.first + chunk.rows)
                part = batch.slice(rows.start, chunk.rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names[best], pa.string()), pa.array(score), pa.array(total, pa.int64())],
                    ["doc_id", "held_out", "lang_pred", "score", "symbols"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, symbols long")
