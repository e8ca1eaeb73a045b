import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from arcline.llm.oracles import CHECKS  # noqa: E402
from arcline.llm.queries import QUERIES  # noqa: E402
from workloads.check import connect, difference  # noqa: E402

from . import brute  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="provided tables not found")


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in CHECKS:
        assert difference(got, connect(FOLDER).execute(CHECKS[name]).df()) is None
    else:
        table = "pages" if "html" in name else "documents"
        assert len(got) == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


@needs_data
def test_stages_against_brute_force(spark):
    """Each stage on what the one before kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    stages = dict(pipeline.STAGES)
    kept = spark.createDataFrame(
        stages["quality classifier"](spark, docs, FOLDER).collect(), docs.schema
    )
    assert kept.columns == pipeline.COLUMNS and 0.5 < kept.count() / docs.count() < 1
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    one = spark.createDataFrame(stages["n-gram Jaccard join"](spark, kept, FOLDER).collect(), docs.schema)
    assert {r["doc_id"] for r in one.collect()} == {c for _, _, c in brute.similar(rows)}
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    cut = spark.createDataFrame(stages["substring dedup"](spark, one, FOLDER).collect(), docs.schema)
    texts = {r["doc_id"]: r for r in cut.collect()}
    for doc_id, symbols, gone in brute.cut_repeats(rows, brute.words, 13):
        assert brute.words(texts[doc_id]["text"]) == [w for w, g in zip(symbols, gone) if not g]
        assert texts[doc_id]["n_chars"] == len(texts[doc_id]["text"])
    rows = [(r["doc_id"], r["text"]) for r in cut.collect()]
    clean = spark.createDataFrame(stages["benchmark decontamination"](spark, cut, FOLDER).collect(), docs.schema)
    assert {r["doc_id"] for r in clean.collect()} == {h[0] for h in brute.hits(rows, benchmark) if not h[5]}
    mixed = stages["mixing sources"](spark, clean, FOLDER).collect()
    assert sorted(r["doc_id"] for r in mixed) == sorted(r["doc_id"] for r in clean.collect())
    whole = pipeline.run(spark, FOLDER).collect()
    assert sorted(map(str, whole)) == sorted(map(str, mixed))


def test_stages_on_awkward_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", None, "a", 0), (2, "x", "en", None, 1), (2, "x", "en", None, 1), (3, "x", "en", "a", 1)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in pipeline.STAGES[1:]:
            docs = spark.createDataFrame((out := stage(spark, docs, str(tmp_path))).collect(), out.schema)
        assert sorted(r["doc_id"] or 0 for r in docs.collect()) == ([0, 1, 2] if data else [])
        kept = pipeline.quality_stage(spark, spark.createDataFrame(data, schema), str(tmp_path))
        assert kept.columns == pipeline.COLUMNS and kept.count() == len(data)


def test_near_duplicates_row_by_row(spark):
    """Null ids and repeated ids with several texts: each row counts by its own text."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcde"}
    near = text["a"] + " more"
    rows = [(None, text["b"]), (None, text["c"]), (None, near), (None, text["d"]), (None, text["d"]), (None, ""), (None, ""), (1, text["a"])]
    rows += [(7, text["e"]), (7, text["a"] + " other"), (7, text["b"] + " too"), (8, "x"), (8, "x"), (8, "y")]
    docs = spark.createDataFrame([(i, t, "en", f"s{n % 2}", len(t)) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_duplicate_stage(spark, docs.repartition(5), "").collect()
    want = [(None, text["c"]), (None, text["d"]), (None, ""), (None, ""), (1, text["a"]), (7, text["e"]), (7, text["b"] + " too"), (8, "x"), (8, "y")]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
    assert [r["source"] for r in got if r["text"] == "x"] == ["s0"]


def test_contaminated_rows_go_one_by_one(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, "clean text"), (4, item + " end"), (4, "clean too")]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("4", "clean too"), ("None", "clean text")]
