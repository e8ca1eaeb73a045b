"""Best-fit packing of documents into token sequences by bin completion (branch and bound)."""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .columns import saved

CAPACITY = 2048
# Search nodes, and steps of one enumeration of fillings, before the incumbent is taken.
NODES, STEPS = 20_000, 4_000
# Fillings of one node that are tried.
WIDTH = 6
# Share of all pieces, and rows, of one length that a single window task numbers.
CELL_SHARE, CELL_ROWS = 0.001, 250_000
# Words whose ids a worker keeps, and the id that ends every document.
KEPT_WORDS, END = 600_000, 0

Filling = tuple[tuple[int, int], ...]  # (length, times), falling


# --- search over counts of lengths ------------------------------------------------------------


def waste_bound(counts: dict[int, int], capacity: int) -> int:
    """Space that any packing of these lengths must waste.

    Around every length above half the capacity only lengths that fit its rest can stand; all of
    those are taken as liquid, and what is left over may go to the next one.
    """
    falling = sorted(counts, reverse=True)
    rising = falling[::-1]
    pool = waste = at = 0
    for size in falling:
        room = capacity - size
        if size <= room:
            break
        while rising[at] <= room:
            pool += rising[at] * counts[rising[at]]
            at += 1
        need = room * counts[size]
        waste += max(0, need - pool)
        pool = max(0, pool - need)
    return waste


def least_bins(counts: dict[int, int], capacity: int) -> int:
    total = sum(s * n for s, n in counts.items())
    return -(-(total + waste_bound(counts, capacity)) // capacity) if counts else 0


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over counts: equal bins are kept as one content with its copies."""
    by_room: dict[int, dict[Filling, int]] = {}
    has = np.zeros(capacity + 1, bool)

    def put(content: Filling, room: int, copies: int) -> None:
        group = by_room.setdefault(room, {})
        group[content] = group.get(content, 0) + copies
        has[room] = True

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = size + int(has[size:].argmax())
            if not has[room]:
                times = min(capacity // size, left)
                put(((size, times),), capacity - size * times, left // times)
                left -= left // times * times
                continue
            content, copies = by_room[room].popitem()
            has[room] = bool(by_room[room])
            times = min(room // size, left)
            taken = min(copies, left // times)
            if taken < copies:
                put(content, room, copies - taken)
            put((*content, (size, times)), room - size * times, taken)
            left -= times * taken
    return [item for group in by_room.values() for item in group.items()]


def _holds(outer: list[int], inner: list[int]) -> bool:
    """Whether the items of ``inner`` (falling) can be put into ``outer`` taken as bins."""
    if not inner:
        return True
    tried = set()
    for i, room in enumerate(outer):
        if room >= inner[0] and room not in tried:
            tried.add(room)
            outer[i] -= inner[0]
            held = _holds(outer, inner[1:])
            outer[i] += inner[0]
            if held:
                return True
    return False


def fillings(counts: dict[int, int], room: int, *, width: int = WIDTH, steps: int = STEPS) -> list[Filling]:
    """Undominated fillings of ``room``, the least waste first, then the fewest items.

    One filling dominates another if the other's items fit into its items. A single item that
    fills the room exactly dominates all. Fillings are enumerated with a rising limit of waste.
    """
    sizes = sorted((s for s in counts if s <= room and counts[s] > 0), reverse=True)
    if not sizes:
        return [()]
    if sizes[0] == room:
        return [((room, 1),)]
    smallest = sizes[-1]
    # What the lengths from each place on hold in all: no filling below it can reach more.
    held = np.cumsum([s * counts[s] for s in sizes[::-1]])[::-1].tolist()
    budget = steps
    most = room - sizes[0]
    for limit in sorted({0, most // 16, most // 4, most}):
        found: list[tuple[int, list[tuple[int, int]]]] = []
        stack: list[tuple[int, int, list[tuple[int, int]]]] = [(0, room, [])]
        while stack and budget > 0 and len(found) < 4 * width:
            budget -= 1
            at, left, chosen = stack.pop()
            if left <= limit and (left < smallest or left == 0):
                found.append((left, chosen))
                continue
            while at < len(sizes) and sizes[at] > left:
                at += 1
            if at == len(sizes):
                if left <= limit:
                    found.append((left, chosen))
                continue
            if left - held[at] > limit:
                continue
            size = sizes[at]
            stack += [(at + 1, left - size * k, [*chosen, (size, k)] if k else chosen) for k in range(min(left // size, counts[size]) + 1)]
        if found:
            break
    if not found:
        left, greedy = room, []
        for size in sizes:
            times = min(left // size, counts[size])
            if times:
                greedy.append((size, times))
                left -= size * times
        return [tuple(greedy)]
    found.sort(key=lambda f: (f[0], sum(k for _, k in f[1])))
    kept: list[tuple[list[int], Filling]] = []
    for _, chosen in found:
        items = [s for s, k in chosen for _ in range(k)]
        if len(items) <= 8 and any(len(o) <= 8 and _holds(list(o), items) for o, _ in kept):
            continue
        kept.append((items, tuple(chosen)))
        if len(kept) == width:
            break
    return [filling for _, filling in kept]


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY, *, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """(filling, copies): bins that hold all lengths, as few as the search finds.

    Best-fit decreasing is the first incumbent. Every node takes the largest length left and tries
    the undominated fillings around it; equal bins are opened together, as many copies as the
    counts allow; paths with few departures from the best filling come first. A branch ends where the waste so far and the least waste of the rest exceed what
    a better packing than the incumbent may waste. The search stops at the lower bound or after
    ``nodes`` nodes.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n > 0}
    best = best_fit(counts, capacity)
    fewest, least = sum(n for _, n in best), least_bins(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    left = dict(counts)
    path: list[tuple[Filling, int]] = []
    waste = opened = 0

    def children() -> list[Filling]:
        size = max(left)
        left[size] -= 1
        tried = fillings(left, capacity - size)
        left[size] += 1
        whole = []
        for filling in tried:
            items = Counter(dict(filling))
            items[size] += 1
            whole.append(tuple(sorted(items.items(), reverse=True)))
        return whole

    def take(filling: Filling) -> None:
        nonlocal waste, opened
        copies = min(left[s] // k for s, k in filling)
        for s, k in filling:
            left[s] -= k * copies
            if not left[s]:
                del left[s]
        path.append((filling, copies))
        opened += copies
        waste += copies * (capacity - sum(s * k for s, k in filling))

    def undo() -> None:
        nonlocal waste, opened
        filling, copies = path.pop()
        for s, k in filling:
            left[s] = left.get(s, 0) + k * copies
        opened -= copies
        waste -= copies * (capacity - sum(s * k for s, k in filling))

    # Paths that leave the first filling at most 0, 1, 2, ... times: a bad early choice is
    # undone long before all that lies below it has been tried.
    for allowed in range(len(counts) * WIDTH):
        if fewest <= least or nodes <= 0 or not counts:
            break
        cut_short = False
        stack = [(children(), 0, 0)]
        while stack and nodes > 0 and fewest > least:
            tried, at, spent = stack.pop()
            if at == len(tried) or spent + at > allowed:
                cut_short |= at < len(tried)
                if path:
                    undo()
                continue
            stack.append((tried, at + 1, spent))
            nodes -= 1
            take(tried[at])
            if not left:
                if opened < fewest:
                    best, fewest = list(path), opened
                undo()
            elif waste + waste_bound(left, capacity) > (fewest - 1) * capacity - total:
                undo()
            else:
                stack.append((children(), 0, spent + at))
        while path:
            undo()
        if not cut_short:
            break
    return best


# --- tokens -----------------------------------------------------------------------------------

# Lower-case Latin letters, digits and ASCII marks but the apostrophe: the normaliser leaves them as
# they are, and words of them fall into runs of letters, single digits and runs of marks.
_LETTERS = "a-zªµºß-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(f"[{_LETTERS}0-9{_MARKS}]+")
PIECE = re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
# Byte-level models name a byte by itself where it can be shown, else by the letters from U+0100 on.
BYTE_NAMES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
# The steps before the model that allow pieces to be looked up one by one.
NORMAL_STEPS, SPLIT_STEPS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds:
    """Ids of words by one tokenizer; a worker keeps a bounded number of words and pieces.

    Words are runs between blanks, tabs and line ends: the tokenizer parts them before anything
    else, so the ids of a text are those of its words one after the other. Where its steps are
    the known ones, plain words are parted here and only their pieces go to the model; all other
    words, and texts that may hold special tokens, are encoded by the tokenizer itself.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        parts = json.loads(content)
        steps = [(parts.get(k) or {}).get(v) or [] for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        names = [[step["type"] for step in found] for found in steps]
        self.known_steps = names == [NORMAL_STEPS, SPLIT_STEPS] and steps[1][0]["pattern"].get("Regex") == SPLIT_PATTERN
        self.special = [t["content"] for t in parts.get("added_tokens", [])]
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.words = {"": b""}
        self.pieces = {}

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            shown = piece if piece.isascii() else "".join([BYTE_NAMES[b] for b in piece.encode()])
            ids = [token.id for token in self.tokenizer.model.tokenize(shown)]
            found = self.pieces[piece] = array("I", ids).tobytes()
        return found

    def learn(self, words: list[str]) -> None:
        other = words
        if self.known_steps:
            other = []
            for word in words:
                if PLAIN.fullmatch(word):
                    self.words[word] = b"".join([self.piece(p) for p in PIECE.findall(word)])
                else:
                    other.append(word)
        for word, found in zip(other, self.tokenizer.encode_batch(other, add_special_tokens=False)):
            self.words[word] = array("I", found.ids).tobytes()

    def of(self, text: str) -> bytes:
        """Ids of a text as unsigned 32-bit integers."""
        if any(token in text for token in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self.known_steps and not any(token in text.lower() for token in self.special):
            # A-Z in lower case, as the normaliser makes them, so that fewer words are kept.
            text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        own = set(words)
        new = own.difference(self.words)
        if new and len(self.words) + len(self.pieces) + len(new) > KEPT_WORDS:
            self.forget()
            new = own - {""}
        if new:
            self.learn(list(new))
        return b"".join([self.words[w] for w in words])


_word_ids: dict[int, WordIds] = {}


def token_ids(texts: Iterable[str], tokenizer: str) -> Iterator[bytes]:
    """Ids of every text as little-endian unsigned 32-bit integers, exactly as the tokenizer gives them."""
    key = hash(tokenizer)
    if key not in _word_ids:
        _word_ids.clear()
        _word_ids[key] = WordIds(tokenizer)
    known = _word_ids[key]
    for text in texts:
        ids = known.of(text)
        yield ids if sys.byteorder == "little" else np.frombuffer(ids, np.uint32).astype("<u4").tobytes()


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32): a document's ids and the end id, cut
    only where longer than ``capacity``. Null text has the end id alone."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            texts = (value.as_py() or "" for value in batch.column(1))
            for row, ids in enumerate(token_ids(texts, tokenizer)):
                ids += end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    own = ids[4 * at : 4 * (at + capacity)]
                    owner.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(v, pa.int64()) for v in (start, length, crc)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = StructType([rows.schema["doc_id"]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return rows.mapInArrow(cut, schema)


# --- packing ----------------------------------------------------------------------------------


def slot_table(packed: list[tuple[Filling, int]]) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, offset), sorted: where the pieces of each
    length go by their rank among the pieces of that length."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for filling, copies in packed:
        offset = 0
        for size, times in filling:
            rows.append((size, used[size], times, sequence, offset))
            used[size] += times * copies
            offset += size * times
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = CAPACITY,
    nodes: int = NODES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents with sequence_id and offset, in as few sequences as the search finds.

    ``tokenizer`` is the content of a tokenizer file. Tasks count pieces per length; those counts
    (at most ``capacity`` rows, however many documents there are) are what bin completion packs,
    bins of equal content together. Pieces of a length are then numbered, in cells of bounded size,
    and their number says which copy of which bin they go to. Sequences are filled from offset 0
    without gaps. Which of several pieces of one length goes where is any; the number of
    sequences depends on the counts alone.

    Null text counts as empty and has the end id only; null ids are kept as they are; repeated
    rows are packed each. An empty table gives an empty result. Other columns are ignored.
    """
    pieces = token_pieces(docs, tokenizer, capacity=capacity, doc_id=doc_id, text=text)
    pieces = saved(pieces.withColumn("_row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = slot_table(pack_lengths(counts, capacity, nodes=nodes))
    lookup = slots[:, 0] << 44 | slots[:, 1]

    # Frequent lengths are numbered in several cells, offset by the rows of the cells before.
    limit = max(1, min(CELL_ROWS, int(sum(counts.values()) * CELL_SHARE)))
    cells = [max(1, -(-counts.get(size, 0) // limit)) for size in range(capacity + 1)]
    celled = pieces.withColumn("_cell", F.pmod("_row", F.get(F.lit(cells), F.col("length").cast("int"))))
    inside = Window.partitionBy("length", "_cell").orderBy("_row")
    ranked = celled.withColumn("_rank", F.row_number().over(inside) - 1)
    if max(cells) > 1:
        sizes = celled.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("_n"))
        line = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        before = sizes.select("length", "_cell", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
        ranked = ranked.join(before, ["length", "_cell"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*columns, F.col("_rank").cast("long").alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            slot = slots[np.searchsorted(lookup, size << 44 | rank, "right") - 1]
            copy, turn = np.divmod(rank - slot[:, 1], slot[:, 2])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(slot[:, 3] + copy), pa.array(slot[:, 4] + turn * size)],
                [*columns, "sequence_id", "offset"],
            )

    schema = StructType([*ranked.schema.fields[:5], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(place, schema)
