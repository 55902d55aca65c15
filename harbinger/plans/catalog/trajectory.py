"""Trajectories, votes and consensus labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from harbinger.functions.columns import r6
from harbinger.operators import consensus, trajectory
from harbinger.plans import inputs
from harbinger.plans.catalog import register
from harbinger.plans.twins import sql

WARMUP = 5
MAX_K = 4


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


def long_votes(spark, sf_dir):
    return trajectory.trajectories(inputs.snapshots(spark, sf_dir), WARMUP)


def totals(spark, sf_dir):
    return trajectory.vote_totals(long_votes(spark, sf_dir))


@register(
    "warmup_filter",
    sql(
        """SELECT model, strftime(min(snapshot_date), '%Y-%m-%d') AS first_kept,
        count(*) AS n_rows FROM kept GROUP BY model""",
        "kept",
    ),
)
def warmup_filter(spark, sf_dir):
    kept = trajectory.after_warmup(inputs.snapshots(spark, sf_dir), WARMUP)
    return kept.groupBy("model").agg(day(F.min("snapshot_date")).alias("first_kept"), F.count("*").alias("n_rows"))


@register(
    "topic_creation_times",
    sql("SELECT model, topic_id, strftime(topic_time, '%Y-%m-%d') AS topic_time FROM births", "births"),
)
def topic_creation_times(spark, sf_dir):
    kept = trajectory.after_warmup(inputs.snapshots(spark, sf_dir), WARMUP)
    return trajectory.topic_births(kept).withColumn("topic_time", day("topic_time"))


@register(
    "publication_rows",
    sql(
        """SELECT a.model, a.article_id, strftime(ta, '%Y-%m-%d') AS ta, CAST(out_at_pub AS INT) AS outlier,
        coalesce(strftime(join_time, '%Y-%m-%d'), '') AS join_time, coalesce(join_topic, -1) AS join_topic
        FROM at_pub a LEFT JOIN joins j USING (model, article_id)""",
        "at_pub",
        "joins",
    ),
)
def publication_rows(spark, sf_dir):
    kept = trajectory.after_warmup(inputs.snapshots(spark, sf_dir), WARMUP)
    return trajectory.publication_states(kept).select(
        "model",
        "article_id",
        day("ta").alias("ta"),
        F.col("outlier_at_pub").cast("int").alias("outlier"),
        F.coalesce(day("join_time"), F.lit("")).alias("join_time"),
        F.coalesce("join_topic", F.lit(-1)).alias("join_topic"),
    )


@register(
    "publication_rows_time_of_day",
    sql(
        """SELECT model, article_id, strftime(min(sd), '%Y-%m-%d') AS ta FROM (
          SELECT s.model, s.article_id, s.snapshot_date AS sd,
                 s.pub + to_hours(CAST(s.article_id % 5 * 3 AS INT)) AS p FROM snapshots s)
        WHERE sd >= p GROUP BY model, article_id""",
        "snapshots",
    ),
)
def publication_rows_time_of_day(spark, sf_dir):
    """``pub`` keeps its time of day while snapshots are at midnight."""
    snaps = inputs.snapshots(spark, sf_dir)
    hours = F.make_dt_interval(hours=(F.col("article_id") % 5 * 3).cast("int"))
    snaps = snaps.withColumn("pub", F.col("pub").cast("timestamp_ntz") + hours)
    return trajectory.publication_states(snaps).select("model", "article_id", day("ta").alias("ta"))


TRAJECTORY_COLUMNS = """model, article_id, strftime({a}pub, '%Y-%m-%d') AS pub, outlier,
    CAST(trajectory LIKE 'TOA%' AS INT) AS toa, trajectory, coalesce(first_topic_id, -1) AS first_topic_id,
    coalesce(strftime(first_topic_time, '%Y-%m-%d'), '') AS first_topic_time,
    coalesce(strftime(integration_time, '%Y-%m-%d'), '') AS integration_time"""


@register(
    "trajectory_categories",
    sql(f"SELECT {TRAJECTORY_COLUMNS.format(a='')} FROM trajectories", "trajectories"),
)
def trajectory_categories(spark, sf_dir):
    return long_votes(spark, sf_dir).select(
        "model",
        "article_id",
        day("pub").alias("pub"),
        "outlier",
        "toa",
        "trajectory",
        F.coalesce("first_topic_id", F.lit(-1)).alias("first_topic_id"),
        F.coalesce(day("first_topic_time"), F.lit("")).alias("first_topic_time"),
        F.coalesce(day("integration_time"), F.lit("")).alias("integration_time"),
    )


@register(
    "trajectory_matrix",
    sql(
        """SELECT article_id, strftime(pub, '%Y-%m-%d') AS publication_date_cleaned, """
        + ", ".join(
            f"""coalesce(max(CASE WHEN model = {m} THEN outlier END), -1) AS outlier_{m},
            coalesce(max(CASE WHEN model = {m} THEN CAST(trajectory LIKE 'TOA%' AS INT) END), -1) AS toa_{m},
            coalesce(max(CASE WHEN model = {m} THEN trajectory END), '') AS trajectory_{m},
            coalesce(max(CASE WHEN model = {m} THEN first_topic_id END), -1) AS first_topic_id_{m},
            coalesce(strftime(max(CASE WHEN model = {m} THEN first_topic_time END), '%Y-%m-%d'), '')
              AS first_topic_time_{m},
            coalesce(strftime(max(CASE WHEN model = {m} THEN integration_time END), '%Y-%m-%d'), '')
              AS integration_time_{m}"""
            for m in inputs.MODELS
        )
        + """, CAST(sum(outlier) AS BIGINT) AS n_outlier_votes,
        CAST(sum(CASE WHEN trajectory LIKE 'TOA%' THEN 1 ELSE 0 END) AS BIGINT) AS n_TOA_votes,
        CAST(4 AS BIGINT) AS n_models FROM trajectories GROUP BY article_id, pub""",
        "trajectories",
    ),
)
def trajectory_matrix(spark, sf_dir):
    wide = trajectory.trajectory_matrix(long_votes(spark, sf_dir), inputs.MODELS)
    shown = []
    for c in wide.columns:
        kind = c.rsplit("_", 1)[0]
        if kind in ("outlier", "toa", "first_topic_id"):
            shown.append(F.coalesce(c, F.lit(-1)).alias(c))
        elif kind in ("first_topic_time", "integration_time"):
            shown.append(F.coalesce(day(c), F.lit("")).alias(c))
        elif kind == "trajectory":
            shown.append(F.coalesce(c, F.lit("")).alias(c))
        elif c == "publication_date_cleaned":
            shown.append(day(c).alias(c))
        else:
            shown.append(F.col(c))
    return wide.select(*shown)


@register(
    "vote_totals",
    sql(
        """SELECT article_id, strftime(pub, '%Y-%m-%d') AS pub, n_outlier_votes, n_toa_votes AS n_TOA_votes,
        n_models FROM totals""",
        "totals",
    ),
)
def vote_totals(spark, sf_dir):
    return totals(spark, sf_dir).withColumn("pub", day("pub"))


@register(
    "consensus_labels",
    sql("SELECT article_id, agreement_k, label_toa AS label_TOA FROM labels_long", "labels_long"),
)
def consensus_labels(spark, sf_dir):
    long = consensus.labels_long(totals(spark, sf_dir), MAX_K)
    return long.select("article_id", "agreement_k", "label_TOA")


@register(
    "consensus_labels_wide",
    sql(
        "SELECT article_id, "
        + ", ".join(f"max(CASE WHEN agreement_k = {k} THEN label_toa END) AS label_k{k}" for k in range(1, 5))
        + " FROM labels_long GROUP BY article_id",
        "labels_long",
    ),
)
def consensus_labels_wide(spark, sf_dir):
    wide = consensus.labels_wide(totals(spark, sf_dir), MAX_K)
    return wide.select("article_id", *[f"label_k{k}" for k in range(1, MAX_K + 1)])


KAPPA = """
    SELECT CASE WHEN pe < 1 THEN (pbar - pe) / (1 - pe) END AS kappa FROM (
      SELECT pbar, p1 * p1 + p0 * p0 AS pe FROM (
        SELECT avg((n_toa_votes * (n_toa_votes - 1) + (n_models - n_toa_votes) * (n_models - n_toa_votes - 1))
                   / (n_models * (n_models - 1))::DOUBLE) AS pbar,
               sum(n_toa_votes)::DOUBLE / sum(n_models) AS p1,
               sum(n_models - n_toa_votes)::DOUBLE / sum(n_models) AS p0
        FROM totals))
"""


@register("fleiss_kappa", sql(f"SELECT round(kappa, 6) AS fleiss_kappa_TOA_votes FROM ({KAPPA})", "totals"))
def fleiss_kappa(spark, sf_dir):
    return consensus.fleiss_kappa(totals(spark, sf_dir)).select(
        r6("fleiss_kappa_TOA_votes").alias("fleiss_kappa_TOA_votes")
    )


@register(
    "agreement_summary",
    sql(
        f"""SELECT agreement_k, count(label_toa) AS retained, CAST(count_if(label_toa = 1) AS BIGINT) AS positive,
        CAST(count_if(label_toa = 0) AS BIGINT) AS negative, round(count(label_toa)::DOUBLE / count(*), 6) AS coverage,
        (SELECT round(kappa, 6) FROM ({KAPPA})) AS fleiss_kappa_TOA_votes
        FROM labels_long GROUP BY agreement_k""",
        "labels_long",
    ),
)
def agreement_summary(spark, sf_dir):
    out = consensus.agreement_summary(totals(spark, sf_dir), MAX_K)
    return out.withColumns(
        {"coverage": r6("coverage"), "fleiss_kappa_TOA_votes": r6("fleiss_kappa_TOA_votes")}
    )
