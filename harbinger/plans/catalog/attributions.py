"""Shapley tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harbinger.functions.columns import r6
from harbinger.operators import shapley as H
from harbinger.operators.experiments import Settings
from harbinger.operators.texts import MEASURES
from harbinger.plans import inputs
from harbinger.plans.catalog import register
from harbinger.plans.twins import sql

SMALL = Settings(rounds=5, cv_folds=2)


@register("background_sample")
def background_sample(spark, sf_dir):
    rows = inputs.document_matrix(spark, sf_dir).where(F.col("agreement_k") == 1)
    return H.background(rows, "article_url", 42).select("article_url")


@register(
    "global_attributions",
    sql(
        """SELECT feature, round(avg(abs(shap_value)), 6) AS mean_abs_shap, round(avg(shap_value), 6) AS mean_shap,
        round(avg(feature_value), 6) AS mean_feature_value, round(median(feature_value), 6) AS median_feature_value,
        round(CASE WHEN min(feature_value) < max(feature_value) THEN corr(rx, rs) END, 6) AS corr_feature_shap_spearman,
        CASE WHEN min(feature_value) = max(feature_value) THEN 'no_monotonic_direction'
          WHEN corr(rx, rs) > 0 THEN 'higher_feature_value_pushes_toward_TOA'
          WHEN corr(rx, rs) < 0 THEN 'higher_feature_value_pushes_away_from_TOA' ELSE 'no_monotonic_direction' END AS direction_hint,
        count(*) AS n_articles, CAST(count_if(y = 1) AS BIGINT) AS n_pos_articles_est,
        CAST(count_if(y = 0) AS BIGINT) AS n_neg_articles_est FROM attribution_ranks GROUP BY feature""",
        "attribution_ranks",
    ),
)
def global_attributions(spark, sf_dir):
    out = H.global_table(inputs.attributions(spark, sf_dir))
    names = ["mean_abs_shap", "mean_shap", "mean_feature_value", "median_feature_value", "corr_feature_shap_spearman"]
    return out.drop("corr_feature_shap_pvalue", "corr_feature_shap_sig").withColumns({c: r6(c) for c in names})


@register(
    "local_attributions",
    sql(
        """SELECT article_url AS media_url, feature, feature_value, shap_value, y, pred_proba,
        CASE WHEN shap_value > 0 THEN 'pushes_toward_TOA' WHEN shap_value < 0 THEN 'pushes_away_from_TOA' ELSE 'no_effect' END
          AS impact_direction FROM attributions""",
        "attributions",
    ),
)
def local_attributions(spark, sf_dir):
    return H.local_table(inputs.attributions(spark, sf_dir))


@register("boosted_tree_attributions")
def boosted_tree_attributions(spark, sf_dir):
    """The final model's attributions, summarised per feature."""
    values = H.explain_final(inputs.document_matrix(spark, sf_dir), 1, MEASURES, SMALL)
    return H.global_table(values)


@register(
    "attribution_additivity",
    "SELECT CAST(doc_id AS VARCHAR) AS article_url, 0.0::DOUBLE AS gap FROM labels JOIN documents USING (doc_id)",
)
def attribution_additivity(spark, sf_dir):
    """Attributions of an article add up to its probability minus the base value."""
    values = H.explain_final(inputs.document_matrix(spark, sf_dir), 1, MEASURES, SMALL)
    gap = F.sum("shap_value") - (F.first("pred_proba") - F.first("base_value"))
    return values.groupBy("article_url").agg(r6(gap).alias("gap"))


@register("out_of_fold_attributions")
def out_of_fold_attributions(spark, sf_dir):
    return H.explain_out_of_fold(inputs.document_matrix(spark, sf_dir), 1, MEASURES, SMALL)
