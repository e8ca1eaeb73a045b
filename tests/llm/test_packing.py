"""Packing: tokens against the tokenizer itself, fillings and bins against plain searches."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from arcline.llm import packing as P

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    with open(vocabularies.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


TEXTS = [
    "", " ", "one", "One two\tthree\n\nfour  five\r\nsix", "it's we'll o'clock 1234 ...!?", "é ́x a b c\x1cd\x85e",
    "ΑΣ ΟΔΟΣ. İstanbul ǅ ﬁ", "<|endoftext|> a<|startoftext|>b <| endoftext |>", "漢字 かな한글 🙂🙂", "\u0000 x​y", "word " * 50,
]


def test_ids_equal_the_tokenizer(tokenizer):
    model = tokenizers.Tokenizer.from_str(tokenizer)
    got = [np.frombuffer(b, "<u4").tolist() for b in P.token_ids(TEXTS, tokenizer)]
    assert got == [model.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_kept_words_are_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(P, "KEPT_WORDS", 3)
    model = tokenizers.Tokenizer.from_str(tokenizer)
    got = [np.frombuffer(b, "<u4").tolist() for b in P.token_ids(TEXTS * 2, tokenizer)]
    assert got == [model.encode(t, add_special_tokens=False).ids for t in TEXTS * 2]


def test_random_texts_equal_the_tokenizer(tokenizer):
    model = tokenizers.Tokenizer.from_str(tokenizer)
    r = random.Random(4)
    letters = [*"abcdeeSTßéÀÿµª'.,-!?<|>0123 \n", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "ﬁ", "́", "漢", "²", "\u00a0"]
    texts = ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(3000)]
    got = [np.frombuffer(b, "<u4").tolist() for b in P.token_ids(texts, tokenizer)]
    assert got == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizers_go_through_the_library():
    with open(vocabularies.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        other = file.read()
    assert not P.WordIds(other).known_steps


def fewest(items, capacity):
    """Least number of bins by trying every placement."""
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                place(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best


def check(packed, counts, capacity):
    held = Counter()
    for filling, copies in packed:
        assert sum(s * k for s, k in filling) <= capacity and copies > 0
        for s, k in filling:
            held[s] += k * copies
    assert held == Counter(counts)
    return sum(n for _, n in packed)


@pytest.mark.parametrize("seed", range(60))
def test_few_items_are_packed_as_well_as_possible(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 20, 50])
    items = [r.randint(1, capacity) if seed % 2 else r.randint(capacity // 5, capacity // 2 + 2) for _ in range(r.randint(1, 10))]
    counts = Counter(items)
    assert P.least_bins(counts, capacity) <= fewest(items, capacity)
    assert check(P.pack_lengths(counts, capacity, nodes=3_000), counts, capacity) == fewest(items, capacity)


def test_search_beats_best_fit():
    # Best fit decreasing needs 4 bins of 100 here, three hold everything.
    counts = Counter([44, 44, 30, 30, 30, 26, 26, 26, 22, 22])
    assert check(P.best_fit(counts, 100), counts, 100) == 4 and check(P.pack_lengths(counts, 100), counts, 100) == 3


def test_many_items_reach_the_lower_bound():
    r = np.random.default_rng(1)
    lengths = np.clip((np.exp(r.normal(6.3, 1.0, 60_000))).astype(int), 2, 2048)
    counts = Counter(lengths.tolist())
    bins = check(P.pack_lengths(counts), counts, P.CAPACITY)
    assert bins <= P.least_bins(counts, P.CAPACITY) + 1
    huge = {s: n * 1_000_000 for s, n in counts.items()}
    assert check(P.pack_lengths(huge), huge, P.CAPACITY) <= P.least_bins(huge, P.CAPACITY) * 1.0001


def test_fillings_are_undominated():
    assert P.fillings({5: 1, 3: 2, 2: 2}, 5) == [((5, 1),)]
    found = P.fillings({6: 1, 4: 1, 3: 1, 2: 1}, 7)
    assert found[0] == ((4, 1), (3, 1)) and ((2, 1),) not in found
    assert P.fillings({9: 1}, 5) == [()]


SCHEMA = "doc_id long, text string, lang string, length int, sequence_id int"


def packed_rows(spark, texts, tokenizer, **options):
    rows = [(i if i != 4 else None, t, "x", 7, 8) for i, t in enumerate(texts)]
    return P.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), tokenizer, **options).collect()


def check_sequences(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("cell_rows", [250_000, 3])
def test_pieces_and_sequences(spark, tokenizer, monkeypatch, cell_rows):
    monkeypatch.setattr(P, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(P, "CELL_SHARE", 1.0)
    model = tokenizers.Tokenizer.from_str(tokenizer)
    texts = [*TEXTS, None, None, "a b c", "a b c", "long text " * 100] + ["same words here"] * 20
    rows = packed_rows(spark, texts, tokenizer, capacity=16)
    ids = [(i if i != 4 else None, [*model.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in enumerate(texts)]
    expected = [(i, k, at, len(own[at : at + 16]), zlib.crc32(np.array(own[at : at + 16], "<u4").tobytes())) for i, own in ids for k, at in enumerate(range(0, len(own), 16))]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter(expected)
    counts = Counter(e[3] for e in expected)
    assert check_sequences(rows, 16) <= P.least_bins(counts, 16) + 1


def test_empty_table(spark, tokenizer):
    found = P.pack_documents(spark.createDataFrame([], SCHEMA), tokenizer)
    assert found.collect() == [] and found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_repeated_rows_without_id_are_many_cells(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(P, "CELL_ROWS", 5)
    df = spark.createDataFrame([(None, None)] * 40, "doc_id string, text string")
    rows = P.pack_documents(df, tokenizer, capacity=8).collect()
    assert len(rows) == 40 and check_sequences(rows, 8) == 5 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 40
