"""Registered queries of the corpus operators; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    fingerprints,
    html_text,
    jaccard,
    language,
    mixing,
    packing,
    quality,
    spelling,
    substrings,
    suffixes,
    urls,
    vector_codes,
)
from .columns import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Fixed rules of the contract: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, folder, "pages"), rules).select(
        "page_id",
        F.col("url_host").alias("host"),
        F.col("url_path").alias("path"),
        F.col("url_rule").alias("rule"),
        F.col("url_verdict").alias("verdict"),
    )


@query
def op8_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query
def op9_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    judged = decontaminate.decontaminate(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), null_ids=True
    )
    return judged.drop("item_ids")


@query
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rated = table(spark, folder, "labels").select(
        "doc_id", quality.label_grade(F.col("quality"), F.col("toxic")).alias("grade")
    )
    return quality.grade_documents(docs, quality.fit_quality(rated, docs)).drop("text")


@query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify_languages(table(spark, folder, "documents")).drop("symbols")


@query
def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, folder, "pages")).drop("container")


@query
def op10_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, folder, "documents"))


@query
def near_document_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of op10 by class of like fingerprints."""
    prints = fingerprints.print_documents(table(spark, folder, "documents"))
    return fingerprints.near_classes(saved(prints)).select("doc_id", "class_id")


@query
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeated_words(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


@query
def op7_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeated_bytes(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


@query
def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, folder, "documents")).drop("node")


@query
def op13_vector_code_compression(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vector_codes.encode_vectors(table(spark, folder, "embeddings"))
    digest = F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256")
    return coded.select("vec_id", "code", "error", "label_error", digest)


@query
def op11_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    # The file's content travels to the tasks: executors need no file of their own.
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer)


@query
def op12_spelling_variant_grouping(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))
