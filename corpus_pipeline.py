"""From raw documents to a training mix: five stages, each an operator over all that is left.

run() applies them to the documents of a folder; between stages the rows are written as Parquet
under the shared checkpoint folder and read again, so a lost executor never recomputes more than
one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcline.llm.columns import saved, small
from arcline.llm.decontaminate import KEY, decontaminate, row_key
from arcline.llm.jaccard import similar_rows
from arcline.llm.mixing import mix_sources
from arcline.llm.quality import fit_quality, grade_documents, label_grade
from arcline.llm.repeats import LAST_ID, prepared
from arcline.llm.substrings import remove_repeated_words
from arcline.session import checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# The classifier is trained, so SQL cannot express the rows of run().
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably of the best grade: neither poor nor toxic."""
    rated = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        "doc_id", label_grade(F.col("quality"), F.col("toxic")).alias("grade")
    )
    return grade_documents(docs.select(*COLUMNS), fit_quality(rated, docs)).where("keep").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of similar ones; of repeated rows one.

    Rows are told apart by id and text, so every row of a repeated id and every row without an id
    is judged by itself. Rows without an id count after all others, those of one id by a hash of
    their text. Rows without id and words are not known to repeat and all stay.
    """
    rows, sizes = prepared(docs, "doc_id", "text", carry=("lang", "source", "n_chars"))
    found = similar_rows(rows, sizes).where(F.struct("id", "version") == F.col("first"))
    kept = found.groupBy("id", "version").agg(
        F.when((F.col("id") == LAST_ID) & (F.max("n_shingles") == 0), 1).otherwise(F.count(F.lit(1))).alias("times")
    )
    kept = saved(kept)
    n_kept, times = kept.agg(F.count(F.lit(1)), F.max("times")).first()
    left = rows.join(small(kept, n_kept, 24), ["id", "version"])
    columns = ["doc_id", "text", "carried.lang", "carried.source", "carried.n_chars"]
    if (times or 0) <= 1:
        return left.select(*columns)
    # Of equal ids and texts the first by the other columns stays; only such rows are grouped.
    one = F.min(F.struct("doc_id", "text", "carried")).alias("one")
    again = left.where("times > 1").groupBy("id", "version").agg(one).select("one.*")
    return left.where("times = 1").select(*columns).unionByName(again.select(*columns))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of spans that a document with a smaller id has too."""
    cut = remove_repeated_words(docs, carry=("lang", "source", "n_chars"), keep_layout=True)
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("carried.n_chars"))
    return cut.select(
        "doc_id",
        F.col("kept_text").alias("text"),
        F.col("carried.lang").alias("lang"),
        F.col("carried.source").alias("source"),
        chars.alias("n_chars"),
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not count as contaminated by the benchmark."""
    judged = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), null_ids=True, keyed=True)
    bad = saved(judged.where("contaminated").select(*KEY).distinct())
    rows = docs.select(*COLUMNS).withColumns(row_key(F.col("doc_id"), F.col("text")))
    return rows.join(small(bad, bad.count(), 24), KEY, "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: how often every document is taken (copies) and the words that gives (taken)."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for place, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{place}")
        docs = spark.read.parquet(f"{folder}/{place}")
    return STAGES[-1][1](spark, docs, sf_dir)
