import random

import numpy as np

from arcline.llm.fingerprints import (
    ADVANCE,
    SAMPLED,
    SHOWN_BIT,
    SLOT_BITS,
    SLOTS,
    Walks,
    as_text,
    classes_of,
    fingerprint_documents,
    fingerprints,
    likeness,
    near_classes,
    near_documents,
    print_documents,
)

from . import brute

SCHEMA = "doc_id long, text string"


def texts(seed, n):
    rnd = random.Random(seed)
    return [" ".join("".join(rnd.choice("abcdefé𝔘") for _ in range(rnd.randint(1, 8))) for _ in range(rnd.randint(1, 300))) for _ in range(n)]


def test_edited_rows_and_likeness(spark):
    rows = list(zip(random.Random(1).sample(range(10_000), 80), texts(2, 80)))
    rows += [(None, "last"), (20_000, None), (20_001, ""), (20_002, "der " * 60_000), (rows[0][0], rows[0][1])]
    got = fingerprint_documents(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", part int").repartition(4), part_chars=5_000)
    found = [tuple(r) for r in got.select("doc_id", "n_chars", "edited_sha256").collect()]
    ordered = sorted(rows, key=lambda r: (brute.order(r[0]), r[1] is None, r[1] or ""))
    want = []
    for i, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        want.append((doc_id, len(text), brute.sha(text[: len(text) - half] + after[:half])))
    assert sorted(found, key=str) == sorted(want, key=str)
    data = got.collect()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in data)
    assert np.mean([r["near_edited"] for r in data]) > 0.2 > np.mean([r["near_next"] for r in data])
    same = [r["fingerprint"] for r in data if r["doc_id"] == rows[0][0]]
    assert len(same) == 2 and len(set(same)) == 1


def test_small_tables(spark):
    assert fingerprint_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fingerprint_documents(spark.createDataFrame([(4, "abcd")], SCHEMA)).collect()
    assert [(r["doc_id"], r["edited_sha256"], r["near_next"]) for r in one] == [(4, brute.sha("abab"), 1.0)]
    nulls = fingerprint_documents(spark.createDataFrame([(None, "ab"), (None, "cd")], SCHEMA)).collect()
    assert {r["edited_sha256"] for r in nulls} == {brute.sha("ac"), brute.sha("ca")}


def test_few_edits_stay_near():
    rnd = random.Random(3)
    base = texts(4, 1)[0] * 5
    edited = list(base)
    for _ in range(5):
        edited[rnd.randrange(len(edited))] = "#"
        del edited[rnd.randrange(len(edited))]
    prints = fingerprints([base, "".join(edited), texts(5, 1)[0]])
    assert likeness(prints[:1], prints[1:2])[0] > 0.6 > 0.1 > likeness(prints[:1], prints[2:])[0]


def test_near_documents(spark):
    base = texts(6, 4)
    rows = [(10, base[0]), (3, base[0]), (5, base[0] + " tail"), (7, base[1]), (8, base[2])]
    prints = fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "fingerprint")
    links = {(r["doc_id"], r["near_id"]): r["likeness"] for r in near_documents(prints).collect()}
    assert links[10, 3] == 1.0 and links[5, 3] >= 0.5 and set(links) == {(10, 3), (5, 3)}


def test_walk_and_samples_against_a_plain_walk():
    rnd = random.Random(8)
    points = np.array([rnd.randrange(97, 110) for _ in range(300)], np.uint32)
    starts, ends = np.array([0, 7, 8, 90]), np.array([7, 8, 90, 300])
    walks = Walks(points, starts, ends)
    classes = classes_of(points, ends)
    for piece, (start, end) in enumerate(zip(starts, ends, strict=True)):
        shown, at = [], start
        while len(shown) < 3 * (end - start) and at < end:
            shown.append(classes[at])
            at += ADVANCE[len(shown) - 1][classes[at]]
        for slot in (0, 5, SLOTS - 1):
            want = []
            for k in range(slot * SLOT_BITS, (slot + 1) * SLOT_BITS):
                step = SAMPLED[len(shown) - 1, k]
                assert step < len(shown)
                want.append(SHOWN_BIT[k, shown[step]])
            assert walks.sample(np.array([piece]), slot)[0].tolist() == want


def test_fingerprint_depends_on_its_own_text_only():
    many = ["", "a", "ab", *texts(9, 12), "x" * 3_000]
    together = fingerprints(many)
    assert all((fingerprints([t])[0] == row).all() for t, row in zip(many, together, strict=True))
    assert likeness(together[:1], together[:1])[0] == 1.0


def test_ids_of_any_type_and_many_rows_without_id(spark):
    bodies = texts(10, 120)
    rows = [(f"a{i % 50}" if i % 3 else None, t) for i, t in enumerate(bodies)]
    got = fingerprint_documents(spark.createDataFrame(rows, "doc_id string, text string").repartition(3), part_chars=2_000)
    found = got.collect()
    assert sorted((r["doc_id"] or "", r["n_chars"]) for r in found) == sorted((i or "", len(t)) for i, t in rows)
    # The edited texts come from one ring over all rows: cutting it into ranges changes nothing.
    whole = fingerprint_documents(spark.createDataFrame(rows, "doc_id string, text string"), part_chars=1 << 30).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, whole), key=str)
    large = [(2**60 + i, t) for i, t in enumerate(bodies)] + [(None, "x")]
    kept = fingerprint_documents(spark.createDataFrame(large, SCHEMA), part_chars=2_000).collect()
    assert {r["doc_id"] for r in kept} == {i for i, _ in large}
    short = spark.createDataFrame([(1, "ab"), (2, "cd")], "doc_id smallint, text string")
    assert [r["doc_id"] for r in fingerprint_documents(short).orderBy("doc_id").collect()] == [1, 2]


def test_near_classes_recall(spark):
    rnd = random.Random(11)
    bodies = [t for t in texts(12, 60) if len(t) > 200][:40]
    rows = []
    for body in bodies:
        for _ in range(rnd.choice([1, 2, 3, 12])):
            chars = list(body)
            for _ in range(rnd.randrange(1 + len(body) // 100)):
                chars[rnd.randrange(len(chars))] = rnd.choice("xyz")
            rows.append((len(rows), "".join(chars)))
    rows += [(None, bodies[0]), (len(rows), None), (len(rows) + 1, "")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    prints = print_documents(table).persist()
    same = fingerprint_documents(table).select("doc_id", "fingerprint")
    assert prints.exceptAll(same).count() == same.exceptAll(prints).count() == 0
    code = {i: fingerprints([t or ""]) for i, t in rows if i is not None}
    ids = sorted(code)
    alike = {(b, a): likeness(code[a], code[b])[0] for a in ids for b in ids if a < b}
    links = near_documents(prints).collect()
    assert links and all(abs(alike[r["doc_id"], r["near_id"]] - r["likeness"]) < 1e-9 and r["likeness"] >= 0.75 for r in links)
    found = {r["doc_id"]: r["class_id"] for r in near_classes(prints).collect() if r["doc_id"] is not None}
    near = [pair for pair, value in alike.items() if value >= 0.75]
    met = sum(found[a] == found[b] for a, b in near)
    assert len(near) > 100 and met / len(near) >= 0.9
    # A class is joined by verified links only, and its id is its smallest one.
    assert all(found[c] == c and c <= i for i, c in found.items())
    assert found[rows[-1][0]] == found[rows[-2][0]] == rows[-2][0]


def test_near_classes_of_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, fingerprint string")
    assert near_classes(empty).count() == near_documents(empty).count() == 0
    code = as_text(fingerprints(["some text"]))[0]
    nulls = spark.createDataFrame([(None, code), (None, code)], empty.schema)
    assert [r["class_id"] for r in near_classes(nulls).collect()] == [None, None]
