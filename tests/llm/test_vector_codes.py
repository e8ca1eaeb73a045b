"""Vector codes against a plain quantiser over Python integers."""

import hashlib
import math

import numpy as np
import pytest

from arcline.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[k][p] for k in range(min(entries, len(kept)))] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for row in cut:
                groups.setdefault(near(row[p], books[p])[1], []).append(row[p])
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    out, by_label = [], {}
    for (i, _, lab), row in zip(kept, cut):
        found = [near(row[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, lab))
    text = ",".join(str(v) for b in books for e in b for v in e)
    return [(i, c, e, by_label[lab]) for i, c, e, lab in out], hashlib.sha256(text.encode()).hexdigest()


def made(n, width, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, width))
    return [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.2 * r.normal(size=width)], [None, 1, 2][i % 3]) for i in range(n)]


def got(coded):
    return sorted([(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in coded.collect()], key=str)


@pytest.mark.parametrize(("n", "width"), [(300, 16), (40, 64), (5, 8)])
def test_equals_plain_quantiser(spark, n, width):
    rows = made(n, width, n)
    rows[3] = (3, None, 1)
    rows += [(1000, [None] + [0.5] * (width - 1), 1), (1001, [float("nan")] * width, 2), (1002, [float("inf")] * width, None)]
    coded, books = V.encode_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))
    expected, digest = plain(rows)
    assert got(coded) == sorted(expected, key=str) and V.codebooks_sha256(books) == digest


def test_ties_repeats_nulls_and_other_columns(spark):
    one, two = [1.0] * 8, [-1.0] * 8
    rows = [(1, one, 1), (1, one, 1), (2, two, None), (2, two, None), (None, one, 1), (None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", code string, error int")
    coded, books = V.encode_vectors(df)
    assert len(got(coded)) == 5 and {r[2] for r in got(coded)} == {0}
    assert {r[1] for r in got(coded)} == {"00" * 8, "02" * 8}
    assert got(coded) == sorted(plain(rows)[0], key=str)
    empty, none = V.encode_vectors(df.limit(0))
    assert empty.collect() == [] and none == [] and "label_error" in empty.columns
    assert V.encode_vectors(df.where("embedding is null"))[0].collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        V.encode_vectors(spark.createDataFrame([(1, [1.0] * 9, 1)], SCHEMA))


def test_text_ids_and_other_lengths(spark):
    rows = [("b", [1.0] * 8, "x"), ("a", [2.0] * 8, None), ("c", [1.0] * 16, "x")]
    coded, books = V.encode_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string"))
    assert sorted(r["vec_id"] for r in coded.collect()) == ["a", "b"] and len(books[0]) == 2


def test_bounds_save_evaluations_and_lose_nothing():
    r = np.random.default_rng(3)
    centres = r.integers(-4000, 4000, (16, 8))
    parts = (centres[r.integers(0, 16, 3000)] + r.integers(-60, 60, (3000, 8))).astype(np.int32)
    pivots = V.choose_pivots(centres.astype(np.int64), 4)
    roots = np.sqrt(V.distances(parts, pivots).astype(float))
    index, best, evaluated = V.nearest(parts, roots, centres.astype(np.int64), pivots)
    full = V.distances(parts, centres)
    assert (index == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert evaluated < 0.2 * full.size


def test_frequent_labels_without_broadcast_of_all(spark, monkeypatch):
    rows = made(60, 8, 9)
    monkeypatch.setattr(V, "small", lambda df, *_: df)
    whole = spark.createDataFrame(rows, SCHEMA)
    assert got(V.encode_vectors(whole)[0]) == sorted(plain(rows)[0], key=str)
    coded = spark.createDataFrame([(i, i % 4 or None, "", 1) for i in range(40)], "vec_id long, label int, code string, error long")
    assert {r["label_error"] for r in V._with_label_error(coded, 0.5).collect()} == {10}
