"""From raw documents to a training mix: language, near-duplicates, benchmark leaks, personal data, mix.

Each stage is ``function(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harbinger.llm import decontaminate, forest_join, language, mixing, pseudonyms
from harbinger.llm.common import fold
from harbinger.llm.queries import PSEUDONYM_KEY
from harbinger.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no learned language (without a letter); the others carry the language found."""
    models = language.learn(docs.where(~fold("doc_id", 4, 2)))
    found = language.identify(docs, models)
    kept = found.where(F.col("lang_pred") != language.UNKNOWN)
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Of its repeated rows one stays.  Rows without an id have no group to speak of and stay.
    """
    classes = forest_join.join(docs)
    first = classes.where("doc_id = class_id").select("doc_id").distinct()
    kept = docs.withColumn("_h", F.xxhash64("text")).join(first, "doc_id").dropDuplicates(["doc_id", "_h"])
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontaminate.find(docs, items).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["_leak"]), "left_anti").select(*COLUMNS)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to pseudonyms of its format; lengths are counted again."""
    changed = pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("pseudonyms", pseudonymise),
    ("mix", mix_sources),
]

ORACLE_SQL = None  # language and pseudonyms are beyond SQL; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
