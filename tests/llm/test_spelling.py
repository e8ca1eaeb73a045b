"""Spelling variants against a plain search over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from arcline.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n int, root string"


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def plain_counts(docs, least=7):
    total = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= 2}


def plain(docs):
    counts = plain_counts(docs)
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return sorted(out)


def got(found):
    return sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in found.collect())


def made_texts(seed, docs=60):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeéà") for _ in range(r.randint(7, 10))) for _ in range(12)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(r.randint(0, 120)):
            w = stems[min(int(r.expovariate(0.4)), 11)]
            for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
                at, kind = r.randrange(len(w) + 1), r.choice("idr")
                c = r.choice("abcÉ")
                w = w[:at] + (c if kind != "d" else "") + w[at + (kind != "i") :]
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", "-", "\n", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_search(spark, seed):
    docs = made_texts(seed)
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA).repartition(4)
    expected = plain(docs)
    assert sum(r[2] for r in expected) > 100 and any(r[3] for r in expected)
    assert got(S.spelling_variants(df)) == expected


def test_long_chain_of_forms(spark):
    chain = [("aaaaaaaa" + "b" * k, 2 * 10**k) for k in range(5)]
    forms = [(w, chain[k + 1][0]) for k, (w, _) in enumerate(chain[:-1])]
    found = S.follow_forms(spark.createDataFrame(forms, "word string, form string"))
    assert {r["root"] for r in found.collect()} == {chain[-1][0]} and found.count() == 4


def test_every_edit_of_a_word_is_found(spark):
    word = "straßenbahn"
    edits = {word[:i] + word[i + 1 :] for i in range(11)}
    edits |= {word[:i] + c + word[i + 1 :] for i in range(11) for c in "zé"} | {word[:i] + c + word[i:] for i in range(12) for c in "zé"}
    far = ["strassenbahn", "bahnstraßen", "straßenbahnen", "xtraßenbahx"]
    rows = [(word, 5)] + [(w, 2) for w in sorted(edits - {word})] + [(w, 3) for w in far]
    pairs = S.near_words(spark.createDataFrame(rows, "word string, n long")).collect()
    assert {r["near"] for r in pairs if r["word"] == word} == edits - {word}
    names = [w for w, _ in rows]
    assert Counter((r["word"], r["near"]) for r in pairs) == Counter((a, b) for a in names for b in names if one_apart(a, b))


def test_very_long_and_hot_words(spark, monkeypatch):
    monkeypatch.setattr(S, "COUNTED_WORDS", 5)
    long = "ab" * 3000
    docs = [(i, f"{long} {long}c common") for i in range(4)] + [(9, "common words " * 500), (10, "comon words " * 3)]
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA)
    assert got(S.spelling_variants(df, least_letters=5)) == sorted(got(S.spelling_variants(df.repartition(3), least_letters=5)))
    assert got(S.spelling_variants(df)) == plain(docs)


def test_nothing_to_find(spark):
    odd = [(None, None), (1, ""), (2, "short 1234567 漢字漢字漢字漢字"), (None, "lonely words everywhere"), (3, "×÷" * 5)]
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in odd], SCHEMA)
    assert got(S.spelling_variants(df)) == plain(odd) == []
    assert S.spelling_variants(df.limit(0)).collect() == []
    twice = df.unionByName(df)
    assert got(S.spelling_variants(twice)) == plain(odd + odd) != []
