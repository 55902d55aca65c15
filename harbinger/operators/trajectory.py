"""From topic snapshots to trajectories of articles and votes per model.

Snapshot tables have the columns ``model, article_id, pub, snapshot_date, topic_id,
is_outlier`` (see ``harbinger.operators.topics``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger.functions.columns import topic_number, truthy, utc_naive

CATEGORIES = ["not_publication_outlier", "Oold", "TOAfirst", "TOAlate", "TODlate", "other"]


def normalise_results(results: DataFrame) -> DataFrame:
    """Types of a results table that came from text: times, topic ids, outlier flags."""
    return results.withColumns(
        {
            "pub": utc_naive("pub"),
            "snapshot_date": utc_naive("snapshot_date"),
            "topic_id": topic_number("topic_id"),
            "is_outlier": truthy("is_outlier"),
        }
    )


def after_warmup(snapshots: DataFrame, days: int) -> DataFrame:
    """Drop the first ``days`` days of each model's snapshots.

    The start is one row per model, so it is broadcast; the snapshots are not shuffled.
    """
    if days <= 0:
        return snapshots
    start = snapshots.groupBy("model").agg(F.min("snapshot_date").alias("_start"))
    cut = F.col("_start") + F.make_dt_interval(days=F.lit(days))
    return (
        snapshots.join(F.broadcast(start), "model")
        .where(F.col("snapshot_date") >= cut)
        .select(*snapshots.columns)
    )


def topic_births(snapshots: DataFrame) -> DataFrame:
    """First snapshot in which each topic has a member."""
    return (
        snapshots.where(F.col("topic_id") >= 0)
        .groupBy("model", "topic_id")
        .agg(F.min("snapshot_date").alias("topic_time"))
    )


def publication_states(snapshots: DataFrame) -> DataFrame:
    """One row per (model, article): its first snapshot at or after publication, whether
    it is an outlier there, and the first topic it joins from then on.

    One aggregation with map-side partials.  Articles without a snapshot at or after
    their publication time drop out; ``pub`` is compared unrounded.
    """
    seen = snapshots.where(F.col("snapshot_date") >= F.col("pub"))
    member = F.col("topic_id") >= 0
    first_topic = F.min_by(F.when(member, F.col("topic_id")), F.when(member, F.col("snapshot_date")))
    return seen.groupBy("model", "article_id").agg(
        F.min("pub").alias("pub"),
        F.min("snapshot_date").alias("ta"),
        F.min_by(F.col("is_outlier") | (F.col("topic_id") == -1), "snapshot_date").alias("outlier_at_pub"),
        F.min(F.when(member, F.col("snapshot_date"))).alias("join_time"),
        first_topic.alias("join_topic"),
    )


def trajectories(snapshots: DataFrame, warmup_days: int = 0) -> DataFrame:
    """Category and votes per (model, article).

    Topic births are taken after the warm-up cut, so a topic born during warm-up counts
    as born in the first snapshot kept.
    """
    kept = after_warmup(snapshots, warmup_days)
    states = publication_states(kept)
    births = topic_births(kept).withColumnRenamed("topic_id", "join_topic")
    joined = states.join(births, ["model", "join_topic"], "left")

    pub, born, joins = F.col("pub"), F.col("topic_time"), F.col("join_time")
    is_out = F.col("outlier_at_pub")
    ahead = (pub < born) & (born <= joins)
    category = (
        F.when(~is_out, "not_publication_outlier")
        .when(joins.isNull(), "Oold")
        .when(ahead & (born == joins), "TOAfirst")
        .when(ahead, "TOAlate")
        .when((born <= pub) & (pub < joins), "TODlate")
        .otherwise("other")
    )
    return joined.select(
        "model",
        "article_id",
        "pub",
        "ta",
        is_out.cast("int").alias("outlier"),
        category.isin("TOAfirst", "TOAlate").cast("int").alias("toa"),
        category.alias("trajectory"),
        F.when(is_out, F.col("join_topic")).alias("first_topic_id"),
        F.when(is_out, born).alias("first_topic_time"),
        F.when(is_out, joins).alias("integration_time"),
    )


VOTE_COLUMNS = ["outlier", "toa", "trajectory", "first_topic_id", "first_topic_time", "integration_time"]


def vote_totals(long: DataFrame, n_models: int | None = None) -> DataFrame:
    """Votes per article over all models; a model without the article votes 0.

    ``n_models`` may be given (the configured models); otherwise it is counted.
    """
    models = F.lit(n_models) if n_models is not None else long.agg(F.count_distinct("model")).scalar()
    return (
        long.groupBy("article_id", "pub")
        .agg(F.sum("outlier").alias("n_outlier_votes"), F.sum("toa").alias("n_TOA_votes"))
        .withColumn("n_models", models.cast("bigint"))
    )


def trajectory_matrix(long: DataFrame, models: list) -> DataFrame:
    """Wide export: six columns per model, then the totals.

    Grouping by (article, publication time) with a pivot over the listed models equals
    the chain of full outer joins and needs a single shuffle.
    """
    aggs = [F.first(c, ignorenulls=True).alias(c) for c in VOTE_COLUMNS]
    totals = [F.sum("outlier").alias("_o"), F.sum("toa").alias("_t")]
    wide = long.groupBy("article_id", "pub").pivot("model", models).agg(*aggs, *totals)
    votes = [F.coalesce(F.col(f"`{m}__o`"), F.lit(0)) for m in models]
    toas = [F.coalesce(F.col(f"`{m}__t`"), F.lit(0)) for m in models]

    def added(parts):
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return total

    per_model = [F.col(f"`{m}_{c}`").alias(f"{c}_{m}") for m in models for c in VOTE_COLUMNS]
    return wide.select(
        "article_id",
        F.col("pub").alias("publication_date_cleaned"),
        *per_model,
        added(votes).alias("n_outlier_votes"),
        added(toas).alias("n_TOA_votes"),
        F.lit(len(models)).cast("bigint").alias("n_models"),
    )


def unpivot_matrix(wide: DataFrame, models: list) -> DataFrame:
    """The long form of an imported matrix; missing votes become 0 rows of that model."""
    branches = [
        F.struct(
            F.lit(str(m)).alias("model"),
            F.coalesce(F.col(f"outlier_{m}").cast("int"), F.lit(0)).alias("outlier"),
            F.coalesce(F.col(f"toa_{m}").cast("int"), F.lit(0)).alias("toa"),
        )
        for m in models
    ]
    return wide.select(
        "article_id", F.col("publication_date_cleaned").alias("pub"), F.explode(F.array(*branches)).alias("v")
    ).select("article_id", "pub", "v.*")
