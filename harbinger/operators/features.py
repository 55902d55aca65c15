"""Assembly of the feature tables and the feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger.operators.geometry import RANKED
from harbinger.operators.social import SOCIAL_FEATURES
from harbinger.operators.texts import TEXT_FEATURES

GEOMETRY = [f"{c}_pct" for c in RANKED] + ["outlier_score", "has_recent_outliers", "n_recent_outliers"]
SINGLES = SOCIAL_FEATURES + TEXT_FEATURES
STATISTICS = ["mean", "median", "std"]
MATRIX_FEATURES = ["n_models_present", *[f"{g}_{s}" for g in GEOMETRY for s in STATISTICS], *SINGLES]
META = ["article_url", "agreement_k", "label_TOA", "horizon"]

# Name prefixes of the feature families.
FAMILIES = {
    "geom": (
        "d1_", "d2_", "margin_", "mahal_", "knn_", "outlier_proto_", "outlier_score",
        "has_recent_outliers", "n_recent_outliers", "n_models_present",
    ),
    "text": ("text_", "avg_", "total_syllables", "len_", "ner_"),
    "social": ("soc_", "media_"),
}


def ablations(columns: list[str]) -> dict[str, list[str]]:
    """Feature lists of the seven settings; settings without features are left out."""
    feats = [c for c in columns if c not in META]
    family = {name: [c for c in feats if c.startswith(p)] for name, p in FAMILIES.items()}
    sets = {"all_features": feats}
    for name in ["geom", "social", "text"]:
        sets[f"no_{name}"] = [c for c in feats if c not in family[name]]
    for name in ["geom", "social", "text"]:
        sets[f"only_{name}"] = family[name]
    return {name: cols for name, cols in sets.items() if cols}


def single_features(text: DataFrame, social: DataFrame) -> DataFrame:
    """Text and share features side by side; 0 where one of them lacks the article."""
    return text.join(social, "article_id", "full").na.fill(0.0)


def long_features(geometry: DataFrame, singles: DataFrame) -> DataFrame:
    """One row per (model, article) with its single features; nulls become 0 here, after
    ranking and before averaging over models."""
    return geometry.join(singles, "article_id", "left").na.fill(0.0)


def article_features(long: DataFrame, geometry: list[str] | None = None) -> DataFrame:
    """Mean, median and sample deviation over models, the number of models, and the single
    features, one row per article.

    A group is one article's models (the configured ensemble), so the built-in median is
    bounded.  The deviation of a single model is 0.
    """
    geometry = [c for c in (geometry or GEOMETRY) if c in long.columns]
    singles = [c for c in SINGLES if c in long.columns]
    aggs = [F.count("*").cast("double").alias("n_models_present")]
    for c in geometry:
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            F.median(c).alias(f"{c}_median"),
            F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"),
        ]
    # the single features are equal on all rows of an article
    aggs += [F.max(c).alias(c) for c in singles]
    return long.groupBy("article_id").agg(*aggs).na.fill(0.0)


def with_all_features(features: DataFrame) -> DataFrame:
    missing = [c for c in MATRIX_FEATURES if c not in features.columns]
    return features.withColumns({c: F.lit(0.0) for c in missing}) if missing else features


def wide_labels_to_long(labels: DataFrame, id_col: str = "article_id") -> DataFrame:
    """``label_k1 ..`` columns to rows; no such column is an error."""
    cols = [c for c in labels.columns if c.startswith("label_k")]
    if not cols:
        raise ValueError("no label_k* columns in the label table")
    items = F.array(
        *[F.struct(F.lit(int(c[7:])).alias("agreement_k"), F.col(c).alias("label_TOA")) for c in cols]
    )
    return labels.select(F.col(id_col).alias("article_id"), F.explode(items).alias("l")).select("article_id", "l.*")


def feature_matrix(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled (article, k) rows with all features in fixed order, nulls as 0."""
    labelled = labels.where(F.col("label_TOA").isNotNull()).select("article_id", "agreement_k", "label_TOA")
    joined = labelled.join(with_all_features(features), "article_id")
    return joined.select(
        F.col("article_id").cast("string").alias("article_url"),
        "agreement_k",
        "label_TOA",
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in MATRIX_FEATURES],
    )
