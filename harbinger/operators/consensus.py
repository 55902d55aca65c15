"""Consensus labels over models and agreement statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_for(k: Column | int, max_negative: int = 0) -> Column:
    """1, 0 or null from ``n_outlier_votes`` and ``n_TOA_votes``, tested in this order."""
    k = F.lit(k) if isinstance(k, int) else k
    return (
        F.when(F.col("n_outlier_votes") < k, F.lit(None))
        .when(F.col("n_TOA_votes") >= k, 1.0)
        .when(F.col("n_TOA_votes") <= max_negative, 0.0)
        .cast("double")
    )


def labels_long(totals: DataFrame, max_k: int, max_negative: int = 0) -> DataFrame:
    """One row per (article, k) with its nullable label."""
    spread = totals.withColumn("agreement_k", F.explode(F.sequence(F.lit(1), F.lit(max_k))))
    return spread.withColumn("label_TOA", label_for(F.col("agreement_k"), max_negative))


def labels_wide(totals: DataFrame, max_k: int, max_negative: int = 0) -> DataFrame:
    """Export form with ``label_k1 ..``; a projection, no pivot needed."""
    cols = [label_for(k, max_negative).alias(f"label_k{k}") for k in range(1, max_k + 1)]
    return totals.select("*", *cols)


def fleiss_kappa(totals: DataFrame) -> DataFrame:
    """One row: kappa of the TOA votes, two categories, missing votes counted as 0.

    Only the number of ones per article enters, so one aggregation of the totals does it.
    Null without items, with one rater, or when chance agreement is 1.
    """
    n, ones = F.col("n_models").cast("double"), F.col("n_TOA_votes").cast("double")
    zeros = n - ones
    pairs = (ones * (ones - 1) + zeros * (zeros - 1)) / F.nullif(n * (n - 1), F.lit(0.0))
    agg = totals.agg(
        F.sum(ones).alias("s1"), F.sum(zeros).alias("s0"), F.sum(n).alias("s"), F.avg(pairs).alias("pbar")
    )
    p1, p0 = F.col("s1") / F.nullif(F.col("s"), F.lit(0.0)), F.col("s0") / F.nullif(F.col("s"), F.lit(0.0))
    pe = p1 * p1 + p0 * p0
    return agg.select(F.when(pe < 1, (F.col("pbar") - pe) / (1 - pe)).alias("fleiss_kappa_TOA_votes"))


def agreement_summary(totals: DataFrame, max_k: int, max_negative: int = 0) -> DataFrame:
    """Per k: retained, positive, negative, coverage, and the (single) kappa.

    All k are counted in one pass over the totals; the unfolding to rows happens on the
    one aggregated row.
    """
    aggs = [F.count("*").alias("n")]
    for k in range(1, max_k + 1):
        label = label_for(k, max_negative)
        aggs += [F.count_if(label == 1.0).alias(f"p{k}"), F.count_if(label == 0.0).alias(f"n{k}")]
    counted = totals.agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("agreement_k"),
                    (F.col(f"p{k}") + F.col(f"n{k}")).alias("retained"),
                    F.col(f"p{k}").alias("positive"),
                    F.col(f"n{k}").alias("negative"),
                )
                for k in range(1, max_k + 1)
            ]
        )
    )
    per_k = counted.select("n", rows.alias("r")).select("n", "r.*")
    kappa = fleiss_kappa(totals).scalar()
    return per_k.select(
        "agreement_k",
        "retained",
        "positive",
        "negative",
        (F.col("retained") / F.nullif(F.col("n"), F.lit(0))).alias("coverage"),
        kappa.alias("fleiss_kappa_TOA_votes"),
    )
