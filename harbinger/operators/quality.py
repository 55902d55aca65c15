"""Input checks that give rows: one per check, with severity and count."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harbinger.functions.columns import utc_naive


def require_columns(df: DataFrame, columns: Iterable[str | None], table: str) -> None:
    missing = [c for c in columns if c and c not in df.columns]
    if missing:
        raise ValueError(f"{table} is missing required columns: {missing}")


def article_checks(articles: DataFrame, id_col: str = "article_id", date_col: str = "pub") -> DataFrame:
    """Unparseable dates, too few dates, missing and repeated ids: one pass over the table."""
    require_columns(articles, [id_col, date_col], "article table")
    parsed = utc_naive(date_col)
    counted = articles.agg(
        F.count_if(parsed.isNull()).alias("bad_dates"),
        F.min(parsed).alias("first_date"),
        F.max(parsed).alias("last_date"),
        F.count_if(F.col(id_col).isNull()).alias("null_ids"),
        F.count(id_col).alias("ids"),
        F.count_distinct(id_col).alias("distinct_ids"),
    )
    few = F.coalesce(F.col("first_date") == F.col("last_date"), F.lit(True)).cast("bigint")
    rows = [
        ("unparseable_dates", "error", F.col("bad_dates")),
        ("fewer_than_two_dates", "warning", few),
        ("missing_ids", "error", F.col("null_ids")),
        ("duplicate_ids", "warning", F.col("ids") - F.col("distinct_ids")),
    ]
    return _unfold(counted, rows)


def _unfold(counted: DataFrame, rows) -> DataFrame:
    items = F.array(
        *[
            F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), c.cast("bigint").alias("n"))
            for n, s, c in rows
        ]
    )
    return counted.select(F.explode(items).alias("r")).select("r.*")


def key_overlap(articles: DataFrame, shares: DataFrame, article_key: str = "article_id",
                share_key: str = "article_id") -> DataFrame:
    """Distinct keys found in both tables, compared as text.

    Both sides are reduced to their distinct keys before they meet, so a key that holds
    a third of the shares costs one row per task.
    """
    left = articles.select(F.col(article_key).cast("string").alias("k")).dropna().distinct()
    right = shares.select(F.col(share_key).cast("string").alias("k")).dropna().distinct()
    common = left.join(right, "k", "left_semi").agg(F.count("*").alias("n"))
    return common.select(F.lit("key_overlap").alias("check"), F.lit("warning").alias("severity"), "n")


def missing_models(spark: SparkSession, vectors: DataFrame, models: list[str]) -> DataFrame:
    """Configured models that have no vectors; an empty configuration is an error."""
    if not models:
        raise ValueError("no embedding models are configured")
    wanted = spark.createDataFrame([(str(m),) for m in models], "model STRING")
    have = vectors.select(F.col("model").cast("string").alias("model")).distinct()
    return wanted.join(have, "model", "left_anti")


def repeated_keys(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once over both tables; empty when they are disjoint."""
    both = train.select(key).unionByName(test.select(key))
    return both.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def validation_report(articles: DataFrame, shares: DataFrame | None, vectors: DataFrame,
                      models: list[str], id_col: str = "article_id", date_col: str = "pub") -> DataFrame:
    """All checks as rows ``check, severity, n``."""
    report = article_checks(articles, id_col, date_col)
    if shares is not None:
        report = report.unionByName(key_overlap(articles, shares, id_col))
    gone = missing_models(articles.sparkSession, vectors, models).agg(F.count("*").alias("n"))
    return report.unionByName(
        gone.select(F.lit("models_without_vectors").alias("check"), F.lit("error").alias("severity"), "n")
    )


def require_valid(report: DataFrame) -> None:
    """Raise on errors.  Reads the report (a handful of rows), not the tables."""
    failed = [f"{r['check']}: {r['n']}" for r in report.collect() if r["severity"] == "error" and r["n"] > 0]
    if failed:
        raise ValueError("; ".join(failed))
