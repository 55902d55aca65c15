"""Feature tables and the feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from harbinger.functions.columns import r6
from harbinger.operators import consensus, geometry, social, texts
from harbinger.operators import features as X
from harbinger.plans import inputs
from harbinger.plans.catalog import register
from harbinger.plans.catalog.texts import mentions
from harbinger.plans.catalog.trajectory import MAX_K, WARMUP, totals
from harbinger.plans.twins import RANKED, sql
from harbinger.session import cut_lineage

SOC = social.SOCIAL_FEATURES[:4]
TEXTS = texts.TEXT_FEATURES
PCT = [f"{c}_pct" for c in RANKED]


def rounded(df, names):
    return df.withColumns({c: r6(c) for c in names})


def text_part(spark, sf_dir):
    return texts.text_features(inputs.articles(spark, sf_dir), inputs.lexicon(spark), mentions(spark, sf_dir))


def share_part(spark, sf_dir):
    hist = social.shares_as_of(inputs.articles(spark, sf_dir), inputs.shares(spark, sf_dir))
    return social.unique_users(hist).join(social.user_medians(hist), "article_id")


def geometry_part(spark, sf_dir):
    return geometry.geometry_features(
        inputs.snapshots(spark, sf_dir, with_coords=True), inputs.WIDTH, tie_decimals=6, warmup_days=WARMUP
    )


SINGLES_SQL = (
    "SELECT coalesce(m.article_id, s.article_id) AS article_id, coalesce(users, 0) AS soc_unique_users, "
    "coalesce(f, 0) AS soc_median_user_public_metrics_followers_count, coalesce(t, 0) AS soc_median_user_public_metrics_tweet_count, "
    "coalesce(l, 0) AS soc_median_user_public_metrics_listed_count, "
    + ", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in TEXTS)
    + " FROM (SELECT * FROM measures JOIN sentiment USING (article_id) JOIN entities USING (article_id)) m "
    "FULL JOIN soc s ON s.article_id = m.article_id"
)


@register(
    "single_features",
    sql(
        "SELECT article_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in SOC + TEXTS) + f" FROM ({SINGLES_SQL})",
        "measures", "sentiment", "entities", "soc",
    ),
)
def single_features(spark, sf_dir):
    out = X.single_features(text_part(spark, sf_dir), share_part(spark, sf_dir))
    return rounded(out.select("article_id", *SOC, *TEXTS), SOC + TEXTS)


LEVEL_SQL = (
    "SELECT article_id, count(*)::DOUBLE AS n_models_present, "
    + ", ".join(
        f"avg(x.{c}) AS {c}_mean, median(x.{c}) AS {c}_median, coalesce(stddev_samp(x.{c}), 0) AS {c}_std"
        for c in X.GEOMETRY
    )
    + " FROM (SELECT model, article_id, outlier_score, has_recent_outliers, n_recent_outliers, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in PCT)
    + " FROM geo_pct) x GROUP BY article_id"
)


@register(
    "model_statistics",
    """SELECT user_id AS article_id, count(*)::DOUBLE AS n_models_present, round(avg(value), 6) AS outlier_score_mean,
      round(median(value), 6) AS outlier_score_median, round(coalesce(stddev_samp(value), 0), 6) AS outlier_score_std
    FROM events GROUP BY user_id""",
)
def model_statistics(spark, sf_dir):
    """Mean, median and sample deviation per key."""
    ev = inputs.table(spark, sf_dir, "events")
    out = X.article_features(ev.select(F.col("user_id").alias("article_id"), F.col("value").alias("outlier_score")))
    return rounded(out, ["outlier_score_mean", "outlier_score_median", "outlier_score_std"])


SHOWN = ["n_models_present", *[f"{g}_{s}" for g in X.GEOMETRY for s in X.STATISTICS], *SOC, *TEXTS]


@register(
    "feature_matrix",
    sql(
        "SELECT CAST(l.article_id AS VARCHAR) AS article_url, agreement_k, label_toa AS label_TOA, "
        + ", ".join(f"round(coalesce({c}, 0), 6) + 0.0 AS {c}" for c in SHOWN)
        + f" FROM labels_long l JOIN ({LEVEL_SQL}) g USING (article_id) LEFT JOIN ({SINGLES_SQL}) s USING (article_id)"
        " WHERE label_toa IS NOT NULL",
        "labels_long", "geo_pct", "measures", "sentiment", "entities", "soc",
    ),
)
def feature_matrix(spark, sf_dir):
    """Labels, geometry, text and share features of every labelled article and k."""
    singles = X.single_features(text_part(spark, sf_dir), share_part(spark, sf_dir))
    long = X.long_features(geometry_part(spark, sf_dir), singles)
    level = cut_lineage(X.article_features(long))
    labels = consensus.labels_long(totals(spark, sf_dir), MAX_K)
    out = X.feature_matrix(level, labels)
    return out.select("article_url", "agreement_k", "label_TOA", *[r6(c).alias(c) for c in SHOWN])


@register(
    "wide_labels_to_rows",
    sql("SELECT article_id, agreement_k, label_toa AS label_TOA FROM labels_long", "labels_long"),
)
def wide_labels_to_rows(spark, sf_dir):
    return X.wide_labels_to_long(consensus.labels_wide(totals(spark, sf_dir), MAX_K))
