import random

import pytest

from arcline.llm.jaccard import similar_documents
from arcline.llm.substrings import remove_repeated_words
from arcline.llm.suffixes import remove_repeated_bytes

from . import brute

SCHEMA = "doc_id long, text string"


def corpus(seed, docs=60, vocabulary=400):
    """Texts with copies, shared passages, near copies, nulls, repeated rows and one long text."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 4))) + str(rnd.randrange(vocabulary) % 7)
    passage = [word() for _ in range(40)]
    rows = [(None, "a b"), (1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "One"), (None, None)]
    texts = []
    for i in range(docs):
        kind = rnd.random()
        if texts and kind < 0.15:
            text = rnd.choice(texts)
        elif texts and kind < 0.45:
            w = rnd.choice(texts).split()
            for _ in range(max(1, len(w) // 40)):
                w[rnd.randrange(len(w))] = word()
            text = " ".join(w)
        else:
            w = [word() for _ in range(rnd.randint(1, 150))]
            if kind > 0.7:
                at = rnd.randrange(len(w))
                w[at:at] = passage[rnd.randrange(20) :]
            text = rnd.choice([" ", "\n", " \t"]).join(w)
        texts.append(text)
        rows.append((rnd.randrange(10_000) if kind < 0.9 else i, text))
    rows.append((5, " ".join(["der"] * 300)))
    rows.append((6, " ".join(["der"] * 200 + ["und"] * 40)))
    rows.append((20_000, " ".join(texts) * 3))
    rows.append((3, texts[0]))
    rows.append((3, texts[0]))
    rows.append((None, texts[1]))
    return rows


def key(row):
    return tuple((x is None, x) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = remove_repeated_words(spark.createDataFrame(rows, SCHEMA).repartition(5))
    same(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute.cut_words(rows))


def test_word_spans_and_text(spark):
    shared = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"a b {shared} c"), (2, f"x  {shared}\ny"), (2, "another text under the same id")]
    docs = spark.createDataFrame([(*r, 7, "k") for r in rows], SCHEMA + ", part int, carried string")
    got = {r["kept_text"]: r for r in remove_repeated_words(docs, carry=("part", "carried")).collect()}
    assert set(got) == {f"a b {shared} c", "x y", "another text under the same id"}
    assert [tuple(s) for s in got["x y"]["spans"]] == [(1, 20)] and got["x y"]["n_spans"] == 1
    assert tuple(got["x y"]["carried"]) == (7, "k")


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes_against_brute_force(spark, seed):
    rows = corpus(seed, docs=40)
    got = remove_repeated_bytes(spark.createDataFrame(rows, SCHEMA).repartition(5))
    same(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), brute.cut_bytes(rows))


@pytest.mark.parametrize("seed", [5, 6])
def test_similar_against_brute_force(spark, seed):
    rows = corpus(seed, docs=80)
    got = similar_documents(spark.createDataFrame(rows, SCHEMA).repartition(5)).drop("node")
    same(got.collect(), brute.similar(rows))


def test_chain_of_links(spark):
    """Neighbours are similar, the ends are not: all are one component."""
    base = [f"w{i}" for i in range(120)]
    rows = [(100 - k, " ".join(base[: 100 - 0] if not k else base[4 * k : 100 + 4 * k])) for k in range(6)]
    got = similar_documents(spark.createDataFrame(rows, SCHEMA)).drop("node")
    same(got.collect(), brute.similar(rows))
    assert {r["component_id"] for r in got.collect()} == {95}


def test_frequent_shingles(spark):
    """A passage in most rows: its shingles skip the bucket, results stay the same."""
    rnd = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(str(rnd.randrange(10**6)) for _ in range(rnd.choice([3, 8, 30])))) for i in range(120)]
    got = similar_documents(spark.createDataFrame(rows, SCHEMA).coalesce(1)).drop("node")
    same(got.collect(), brute.similar(rows))


@pytest.mark.parametrize("operator", [remove_repeated_words, remove_repeated_bytes, similar_documents])
def test_empty_and_clashing_columns(spark, operator):
    empty = spark.createDataFrame([], SCHEMA)
    assert operator(empty).count() == 0
    extra = ("id", "part", "version", "node", "codes", "kind", "bucket", "n_words", "root")
    docs = spark.createDataFrame([(1, "a b c", *extra)], SCHEMA + "".join(f", {c} string" for c in extra))
    assert operator(docs).count() == 1


@pytest.mark.parametrize("doc_id", [None, 7])
def test_many_texts_under_one_id(spark, doc_id):
    """Texts that agree in 16 bits of their hash and share an id are cut and linked by themselves."""
    from pyspark.sql import functions as F

    filler = [" ".join(f"{k}.{i}" for i in range(14)) for k in range(4000)]
    seen = spark.createDataFrame([(t,) for t in filler], "text string").select("text", F.pmod(F.xxhash64("text"), F.lit(65_536)).alias("h")).collect()
    groups = {}
    for r in seen:
        groups.setdefault(r["h"], []).append(r["text"])
    alike = [t for g in groups.values() if len(g) > 1 for t in g]
    assert len(alike) > 20
    # One of each pair also stands in a document with a smaller id.
    rows = [(doc_id, t) for t in alike] + [(i, "x y " + g[0]) for i, g in enumerate(x for x in groups.values() if len(x) > 1) if i != 7]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    same(remove_repeated_words(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute.cut_words(rows))
    same(remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), brute.cut_bytes(rows))
    same(similar_documents(docs).drop("node").collect(), brute.similar(rows))


def test_repeated_rows_in_several_chunks(spark):
    """Rows that occur twice across partitions have their true overlap, not twice as much."""
    own = lambda k: [f"{k}w{i}" for i in range(43)]
    rows = [(10 * g + k, " ".join([f"{g}s{i}" for i in range(61)] + own(f"{g}{k}"))) for g in range(4) for k in range(3)] * 6
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = similar_documents(docs).drop("node").collect()
    same(got, brute.similar(rows))
    assert all(r["component_id"] == r["doc_id"] for r in got)


def thue_morse(k):
    """Word of 2**k letters and its complement: their sums of powers agree modulo 2**64 in any odd base."""
    word = "a"
    for _ in range(k):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("k", [10, 11, 12])
def test_words_made_to_collide_are_told_apart(spark, k):
    x, y = thue_morse(k)
    head = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{head} {x}"), (2, f"{head} {y}"), (3, x), (4, y), (5, f"{x} {y} " * 8), (6, f"{y} {x} " * 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = remove_repeated_words(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    same(got, brute.cut_words(rows))
    linked = {r["doc_id"]: r["component_id"] for r in similar_documents(df).collect()}
    # The first two share 8 of 10 shingles, the next two none.
    assert [linked[i] for i in (1, 2, 3, 4)] == [1, 1, 3, 4]
    cut = remove_repeated_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    same(cut, brute.cut_bytes(rows))
