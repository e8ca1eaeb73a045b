import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcline.llm import language, quality
from arcline.llm.language import identify_languages, suffix_automaton
from arcline.llm.quality import OrdinalModel, fit_quality, grade_documents, label_grade


def invent(rnd, syllables, n):
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(n))


LANGUAGES = {"aa": ["tha", "ing", "er", "on"], "bb": ["sch", "ung", "ei", "ber"], "cc": ["ión", "lla", "os", "que"]}


def test_suffix_automaton_knows_all_substrings():
    text = [1, 2, 1, 1, 2, 3, 1, 2]
    moves = suffix_automaton(text)
    walk = lambda part: __import__("functools").reduce(lambda s, c: moves[s].get(c, -1) if s >= 0 else s, part, 0)
    for i in range(len(text)):
        for j in range(i, len(text) + 1):
            assert walk(text[i:j]) >= 0
    assert walk([3, 3]) < 0 and walk([2, 2]) < 0


def test_languages(spark):
    rnd = random.Random(1)
    rows = [(i, invent(rnd, LANGUAGES[lang], rnd.randint(5, 80)), lang) for i in range(300) for lang in [rnd.choice(list(LANGUAGES))]]
    extra = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 ?!", "cc"), (None, invent(rnd, LANGUAGES["bb"], 30), None), (1003, "Tha " * 60_000, None), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows + extra], "doc_id long, text string, lang string, score int, source string")
    got = identify_languages(docs.repartition(5)).collect()
    assert len(got) == len(rows) + len(extra)
    by_id = {r["doc_id"]: r for r in got}
    right = [by_id[i]["lang_pred"] == lang for i, _, lang in rows if by_id[i]["held_out"]]
    assert len(right) > 40 and np.mean(right) > 0.97
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[None]["lang_pred"] == "bb"
    assert by_id[1003]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got)
    wrong = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    again = {r["doc_id"]: r["lang_pred"] for r in identify_languages(wrong).collect()}
    assert again == {i: r["lang_pred"] for i, r in by_id.items()}
    assert {r["lang_pred"] for r in identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert identify_languages(docs.limit(0)).count() == 0


def test_ordinal_fit_orders_grades():
    rnd = np.random.default_rng(2)
    grade = rnd.integers(0, 4, 400)
    row, feature = np.repeat(np.arange(400), 2), np.tile([5, 9], 400)
    value = np.stack([grade + rnd.normal(0, 0.3, 400), np.ones(400)], axis=1).ravel()
    model = OrdinalModel.fit(row, feature, value, grade, 4)
    assert (np.diff(model.thresholds) > 0).all()
    score = np.bincount(row, weights=model.weights[feature] * value)
    tails = model.tails(score)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.corrcoef(tails.sum(axis=1), grade)[0, 1] > 0.9


def test_grades(spark):
    rnd = random.Random(3)
    rows, rated = [], []
    for i in range(400):
        words = invent(rnd, LANGUAGES["aa"], rnd.randint(20, 120)).split()
        grade = rnd.choice([0, 1, 2])
        if grade == 0:
            words = [w.upper() + "!!" for w in words]
        if grade == 1:
            words = [rnd.choice(["idiot", "moron"]) if rnd.random() < 0.1 else w for w in words] + ["idiot"]
        rows.append((i, " ".join(words)))
        rated.append((i, grade))
    extra = [(900, None), (901, ""), (None, "tha ing"), (902, "ing " * 100_000), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, "k") for r in rows + extra], "doc_id long, text string, keep string")
    labels = spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, g in rated[:300]] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    graded = labels.select("doc_id", label_grade(F.col("quality"), F.col("toxic")).alias("grade"))
    model = fit_quality(graded, docs)
    got = grade_documents(docs.repartition(3), model).collect()
    assert len(got) == len(rows) + len(extra)
    by_id = {r["doc_id"]: r for r in got}
    kept = {g: np.mean([by_id[i]["keep"] for i, grade in rated[300:] if grade == g]) for g in (0, 1, 2)}
    assert kept[0] == 0 and kept[1] < 0.3 and kept[2] > 0.9
    for r in got:
        assert 0 <= r["tail_2"] <= r["tail_1"] <= 1 and r["expected_grade"] == pytest.approx(r["tail_1"] + r["tail_2"])
    assert grade_documents(docs.limit(0), model).count() == 0
    unrated = fit_quality(graded.limit(0), docs)
    assert {r["expected_grade"] for r in grade_documents(docs, unrated).collect()} == {1.0}
    assert quality.FEATURES > quality.BIAS


def test_languages_of_several_scripts(spark):
    """Letters beyond the most frequent ones tell languages apart too."""
    rnd = random.Random(4)
    syllables = {
        "la": ["tha", "ing", "er", "on", "bcdf", "jklm", "pqsu", "vwxyz", "äöü", "ßéèê", "çñáíóú"],
        "ru": ["при", "вет", "ко", "ше", "мы"],
        "uk": ["їжа", "єв", "ґан", "ліс", "що"],
        "ko": ["한국", "어", "나라", "말"],
        "zh": ["中文", "語言", "學習", "天"],
        "ja": ["ひら", "がな", "カタ", "日本"],
    }
    share = [lang for lang in syllables for _ in range(6 if lang == "la" else 1)]
    rows = [(i, invent(rnd, syllables[lang], 30), lang) for i in range(500) for lang in [rnd.choice(share)]]
    got = identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by_id = {r["doc_id"]: r for r in got}
    right = [by_id[i]["lang_pred"] == lang for i, _, lang in rows if by_id[i]["held_out"] and lang != "la"]
    assert len(right) > 20 and np.mean(right) > 0.97
    model = language.LanguageModel({lang: [text for _, text, own in rows if own == lang][:40] for lang in syllables})
    assert len(model.alphabet.letters) == len({c for _, text, _ in rows for c in text if c.isalpha()})


def test_samples_are_bounded_in_rows(spark):
    """One id of many rows gives one text, to the classifier and to each language."""
    many = spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("tha ing er "), F.col("id")).alias("text"), F.lit("aa").alias("lang"))
    few = spark.createDataFrame([(i, f"sch ung ei ber {i}", "bb") for i in range(2, 9)], many.schema)
    docs = many.unionByName(few).repartition(4)
    sample = language.training_sample(docs, total_chars=40_000, text_chars=1_000, doc_id="doc_id", text="text", lang="lang")
    assert len(sample["aa"]) == 1 and len(sample["bb"]) == 7
    seen = []
    fit = OrdinalModel.fit
    try:
        OrdinalModel.fit = staticmethod(lambda row, feature, value, grade, grades: seen.append(grade) or fit(row, feature, value, grade, grades))
        fit_quality(spark.createDataFrame([(i, i % 3) for i in range(1, 9)], "doc_id long, grade int"), docs)
    finally:
        OrdinalModel.fit = fit
    assert sorted(seen[0].tolist()) == sorted(i % 3 for i in range(1, 9))


def test_sample_is_no_prefix(spark):
    docs = spark.createDataFrame([(i, "a" * 3_000 + "b" * 3_000, "xx") for i in range(40)], "doc_id long, text string, lang string")
    parts = language.training_sample(docs, total_chars=40_000, text_chars=1_000, doc_id="doc_id", text="text", lang="lang")["xx"]
    assert len(parts) == 40 and {len(p) for p in parts} == {1_000}
    assert any("b" in p for p in parts) and any("a" in p for p in parts)


def test_phrases_and_winner_against_a_plain_parse(spark):
    rnd = random.Random(5)
    known = {lang: [invent(rnd, LANGUAGES[lang], 12) for _ in range(3)] for lang in LANGUAGES}
    model = language.LanguageModel(known)
    rows = [(i, invent(rnd, LANGUAGES[rnd.choice(list(LANGUAGES))], rnd.randint(1, 200))) for i in range(40)]

    def plain(text, parts):
        """Fewest phrases by trying ever longer substrings, in blocks of 256 symbols."""
        count = 0
        for first in range(0, len(text), 256):
            block, at = text[first : first + 256], 0
            while at < len(block):
                end = at + 1
                while end < len(block) and any(block[at : end + 1] in p for p in parts):
                    end += 1
                count, at = count + 1, end
        return count

    text = "".join(t for _, t in rows)
    points = np.array([ord(c) for c in text], np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) for _, t in rows])))
    symbols, cuts = model.alphabet.symbols(points, offsets)
    want = [[plain(t, known[lang]) for _, t in rows] for lang in model.languages]
    assert model.phrases(symbols, cuts).tolist() == want
