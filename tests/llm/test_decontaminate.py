import random

from arcline.llm.decontaminate import decontaminate

from . import brute

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def test_against_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: rnd.choice("abcdefgh") * rnd.randint(1, 3) + str(rnd.randrange(9))
    items = [(i, ", ".join(word() for _ in range(rnd.randint(13, 40)))) for i in range(12)]
    items += [(20, "Only Three words"), (21, "ONLY three-words"), (22, "lone"), (23, None), (24, " -- "), (None, items[0][1]), (2, items[2][1]), (25, items[3][1])]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rnd.randint(0, 60))]
        part = (rnd.choice(items)[1] or "").upper().split(", ")
        at = rnd.randint(0, len(part))
        docs.append((i, " ".join(w[:20] + part[at : at + rnd.choice([12, 13, 20, 40])] + w[20:])))
    docs += [(100, None), (101, ""), (102, "é only THREE words!"), (102, "é only THREE words!"), (103, "lone " * 5000), (104, "x " * 3000 + items[0][1])]
    got = decontaminate(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS)).drop("item_ids")
    assert sorted(map(tuple, got.collect())) == sorted(brute.hits(docs, items))


def test_nulls_empty_and_clashing(spark):
    docs = spark.createDataFrame([(None, "a b", 1, "w"), (1, None, 2, "w")], DOCS + ", n_hit int, words string")
    items = spark.createDataFrame([(1, "a b", "p")], ITEMS + ", print string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate(docs, items).collect()}
    assert got == {None: (2, 0), 1: (0, 0)}
    assert decontaminate(docs.limit(0), items).count() == 0
    assert {r["n_hit"] for r in decontaminate(docs, items.limit(0)).collect()} == {0}


def test_rows_of_one_id_and_without_id(spark):
    """Every row is judged by its own text, rows without an id too."""
    items = [(1, " ".join(f"q{i}" for i in range(20)))]
    docs = [(None, items[0][1]), (None, "clean"), (5, items[0][1] + " x"), (5, "clean words"), (5, None)]
    got = decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), null_ids=True).drop("item_ids")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute.hits(docs, items), key=str)
