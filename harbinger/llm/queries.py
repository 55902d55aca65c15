"""One registered query per operator, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harbinger.llm import (
    checks,
    compression,
    decontaminate,
    extraction,
    forest_join,
    language,
    licenses,
    mixing,
    neighbour_graph,
    pseudonyms,
    suffix_lm,
    token_alignment,
    toxicity,
    vector_codes,
)
from harbinger.llm.common import documents, fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
PSEUDONYM_KEY = "replace this key in production"


def query(name: str, check: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return add


@query("op1_forest_join", checks.NEAR_CHECK)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_join.join(documents(spark, sf_dir))


@query("op2_suffix_tree_lm")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = fold("doc_id", 7, 2)
    tree = suffix_lm.learn(docs.where(~held_out))
    scored = suffix_lm.score(docs, tree)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
                         F.lit(tree.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op3_license_rules", checks.license_check())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"),
                        F.array_join(F.array_sort("licenses"), ",").alias("licenses"), "n_unknown")


@query("op4_benchmark_windows", checks.DECONTAMINATION_CHECK)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find(documents(spark, sf_dir), items)
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


@query("op5_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = extraction.extract(pages, extraction.learn(pages))
    return found.select("page_id", "url", "text", "n_chars")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = fold("doc_id", 3, 1)
    model = toxicity.learn(docs.where(~held_out), labels.where(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    predicted = (F.col("score") >= 0.7).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"),
                         F.size("offending").alias("n_offending"))


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold("doc_id", 4, 2)
    models = language.learn(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text"), models)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op8_low_discrepancy_mix", checks.MIX_CHECK)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("source")


@query("op9_pseudonyms")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)


@query("op10_compression_bands")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.judge(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


@query("op11_descent_search")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbour_graph.nearest(vectors, F.expr("vec_id % 50 = 0"))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(documents(spark, sf_dir))[0]


@query("op13_dual_tree_codes", checks.lloyd_check())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
