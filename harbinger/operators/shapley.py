"""Interventional Shapley values of the boosted trees on the probability scale."""

from __future__ import annotations

import re
import warnings
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.functions.columns import as_col
from harbinger.functions.keyed import average_rank, exact_median
from harbinger.operators.experiments import Settings, eligibility, fit, group_folds, numeric_features
from harbinger.operators.significance import t_tail
from harbinger.session import cut_lineage, keep

MAX_BACKGROUND = 200


def background(rows: DataFrame, key: str, seed: int, size: int = MAX_BACKGROUND) -> DataFrame:
    """At most ``size`` rows in the order of a seeded hash: a sample without replacement that
    does not depend on partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(size)


_RULE = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def leaf_boxes(gbt) -> list[tuple[float, dict[int, tuple[float, float]]]]:
    """Leaves of all trees: weighted value and, per feature on the path, its interval (lo, hi]."""
    out, weights, tree, path = [], list(gbt.treeWeights), -1, []
    for line in gbt.toDebugString.splitlines():
        text = line.strip()
        if text.startswith("Tree "):
            tree, path = tree + 1, []
        elif text.startswith("Predict:"):
            box: dict[int, tuple[float, float]] = {}
            for _, f, low, cut in path:
                lo, hi = box.get(f, (-np.inf, np.inf))
                box[f] = (lo, min(hi, cut)) if low else (max(lo, cut), hi)
            out.append((float(text.split(":", 1)[1]) * weights[tree], box))
        else:
            rule = _RULE.match(text)
            if rule:
                depth = len(line) - len(line.lstrip())
                path = [p for p in path if p[0] < depth] + [(depth, int(rule[2]), rule[3] == "<=", float(rule[4]))]
    return out


def _shares(d: int) -> np.ndarray:
    """Share of a leaf's value that goes to each of its d features, by the sets of features
    that fit only the row (mask x) and only the background row (mask b)."""
    size = 1 << d
    out = np.zeros((size, size, d))
    for mx in range(size):
        for mb in range(size):
            if (mx | mb) != size - 1:
                continue
            p = [j for j in range(d) if mx >> j & 1 and not mb >> j & 1]
            n = [j for j in range(d) if mb >> j & 1 and not mx >> j & 1]
            whole = factorial(len(p) + len(n))
            for j in p:
                out[mx, mb, j] = factorial(len(p) - 1) * factorial(len(n)) / whole
            for j in n:
                out[mx, mb, j] = -factorial(len(p)) * factorial(len(n) - 1) / whole
    return out


def _margin(leaves, x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for value, box in leaves:
        fits = np.ones(len(x), dtype=bool)
        for f, (lo, hi) in box.items():
            fits &= (x[:, f] > lo) & (x[:, f] <= hi)
        total += value * fits
    return total


def attributions(leaves, x: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Shapley values of a batch, its probabilities, and the mean background probability.

    The value of a leaf is shared exactly for every pair of row and background row.  A
    background row enters a leaf only through which of its path features it fits, so
    pairs are summed per such pattern.
    """
    mx, mb = _margin(leaves, x), _margin(leaves, base)
    px, pb = 1 / (1 + np.exp(-2 * mx)), 1 / (1 + np.exp(-2 * mb))
    gap = mx[:, None] - mb[None, :]
    flat = np.abs(gap) < 1e-12
    scale = np.where(flat, (2 * px * (1 - px))[:, None], (px[:, None] - pb[None, :]) / np.where(flat, 1.0, gap))
    tables: dict[int, np.ndarray] = {}
    phi = np.zeros(x.shape)
    for value, box in leaves:
        feats = list(box)
        d = len(feats)
        if d == 0:
            continue
        if d not in tables:
            tables[d] = _shares(d)
        code_x, code_b = np.zeros(len(x), dtype=int), np.zeros(len(base), dtype=int)
        for j, f in enumerate(feats):
            lo, hi = box[f]
            code_x |= ((x[:, f] > lo) & (x[:, f] <= hi)).astype(int) << j
            code_b |= ((base[:, f] > lo) & (base[:, f] <= hi)).astype(int) << j
        pattern = scale @ np.eye(1 << d)[code_b]
        phi[:, feats] += value * np.einsum("xb,xbj->xj", pattern, tables[d][code_x])
    return phi / len(base), px, float(pb.mean())


def shapley_values(model, rows: DataFrame, base_rows: DataFrame, features: list[str], seed: int = 42,
                   max_background: int = MAX_BACKGROUND, key: str = "article_url") -> DataFrame:
    """Long table ``key, feature, feature_value, shap_value, y, pred_proba, base_value``.

    ``model`` is the fitted pipeline.  Leaves (at most 16 per tree) and the background (at
    most ``max_background`` rows) are broadcast; the article rows stay distributed.
    """
    spark = rows.sparkSession
    # the first pipeline stages impute and build the vector
    def vectors(df: DataFrame) -> DataFrame:
        for stage in model.stages[:-1]:
            df = stage.transform(df)
        from pyspark.ml.functions import vector_to_array

        return df.withColumn("_x", vector_to_array("features"))

    ground = np.array([r["_x"] for r in vectors(background(base_rows, key, seed, max_background)).select("_x").collect()])
    shared = spark.sparkContext.broadcast((leaf_boxes(model.stages[-1]), ground))
    ready = vectors(rows).select(F.col(key).cast("string").alias(key), F.col("label_TOA").cast("int").alias("y"), "_x")

    def work(batches):
        leaves, base = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["_x"].to_numpy())
            phi, p, mean = attributions(leaves, x, base)
            yield pdf.assign(shap=list(phi), pred_proba=p, base_value=mean)

    done = ready.mapInPandas(
        work, f"{key} STRING, y INT, _x ARRAY<DOUBLE>, shap ARRAY<DOUBLE>, pred_proba DOUBLE, base_value DOUBLE"
    )
    names = F.array(*[F.lit(f) for f in features])
    each = F.explode(F.arrays_zip(names.alias("f"), F.col("_x").alias("v"), F.col("shap").alias("s")))
    return done.select(key, "y", "pred_proba", "base_value", each.alias("e")).select(
        key,
        F.col("e.f").alias("feature"),
        F.col("e.v").alias("feature_value"),
        F.col("e.s").alias("shap_value"),
        "y",
        "pred_proba",
        "base_value",
    )


# The labels of impact, direction and significance.
def impact(shap: Column | str) -> Column:
    s = as_col(shap)
    return F.when(s > 0, "pushes_toward_TOA").when(s < 0, "pushes_away_from_TOA").otherwise("no_effect")


def direction(r: Column | str) -> Column:
    r = as_col(r)
    return (
        F.when(r > 0, "higher_feature_value_pushes_toward_TOA")
        .when(r < 0, "higher_feature_value_pushes_away_from_TOA")
        .otherwise("no_monotonic_direction")
    )


def marks(p: Column | str) -> Column:
    """Stars, and nothing where the p value is missing or not small."""
    p = as_col(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def spearman(values: DataFrame) -> DataFrame:
    """Rank correlation of value and attribution per feature; null where one is constant."""
    ranked = average_rank(values.select("feature", "feature_value", "shap_value"), ["feature"], "feature_value", "rx", "_n")
    ranked = average_rank(ranked.drop("_n"), ["feature"], "shap_value", "rs", "_n")
    return ranked.groupBy("feature").agg(
        F.count("*").alias("n"),
        F.when(
            (F.min("feature_value") < F.max("feature_value")) & (F.min("shap_value") < F.max("shap_value")),
            F.covar_pop("rx", "rs") / F.nullif(F.stddev_pop("rx") * F.stddev_pop("rs"), F.lit(0.0)),
        ).alias("corr_feature_shap_spearman"),
    )


def global_table(values: DataFrame) -> DataFrame:
    """One row per feature: sizes of its attributions, its values, their rank correlation."""
    base = values.groupBy("feature").agg(
        F.avg(F.abs("shap_value")).alias("mean_abs_shap"),
        F.avg("shap_value").alias("mean_shap"),
        F.avg("feature_value").alias("mean_feature_value"),
        F.count("*").alias("n_articles"),
        F.count_if(F.col("y") == 1).alias("n_pos_articles_est"),
        F.count_if(F.col("y") == 0).alias("n_neg_articles_est"),
    )
    medians = exact_median(values, ["feature"], "feature_value", "median_feature_value")
    joined = base.join(medians, "feature").join(spearman(values).drop("n"), "feature")
    r, df = F.col("corr_feature_shap_spearman"), F.col("n_articles") - 2
    t = F.when(F.abs(r) < 1, r * F.sqrt(df / (1 - r * r)))
    p = F.when(r.isNull(), F.lit(None)).when(F.abs(r) >= 1, 0.0).otherwise(t_tail(t, df))
    return joined.withColumn("corr_feature_shap_pvalue", p).select(
        "feature", "mean_abs_shap", "mean_shap", "mean_feature_value", "median_feature_value",
        "corr_feature_shap_spearman", "corr_feature_shap_pvalue",
        marks("corr_feature_shap_pvalue").alias("corr_feature_shap_sig"),
        direction("corr_feature_shap_spearman").alias("direction_hint"),
        "n_articles", "n_pos_articles_est", "n_neg_articles_est",
    ).orderBy(F.col("mean_abs_shap").desc(), "feature")


def local_table(values: DataFrame) -> DataFrame:
    return values.select(
        F.col("article_url").alias("media_url"), "feature", "feature_value", "shap_value", "y", "pred_proba",
        impact("shap_value").alias("impact_direction"),
    )


def explain_final(matrix: DataFrame, k: int, features: list[str], s: Settings,
                  max_background: int = MAX_BACKGROUND) -> DataFrame:
    """Attributions of the model fitted on all labelled rows of one k."""
    rows = keep(numeric_features(matrix.where((F.col("agreement_k") == k) & F.col("label_TOA").isNotNull()), features))
    model = fit(rows, features, "xgb", s)
    return cut_lineage(shapley_values(model, rows, rows, features, s.seed, max_background))


def explain_out_of_fold(matrix: DataFrame, k: int, features: list[str], s: Settings,
                        max_background: int = MAX_BACKGROUND) -> DataFrame:
    """Attributions of held-out rows: medians, weight and model from the training folds,
    seed + fold for the background; training folds with one class are skipped.

    One class alone is an error.  Two classes with too few rows of the smaller one, or
    with no usable fold, give an empty table and a warning.
    """
    state = eligibility(matrix.where(F.col("agreement_k") == k), s.cv_folds).first()
    if state is None or not (state["n_pos"] and state["n_neg"]):
        raise ValueError(f"agreement_k={k} has fewer than two classes")
    nothing = matrix.sparkSession.createDataFrame(
        [], "media_url STRING, feature STRING, feature_value DOUBLE, shap_value DOUBLE, impact_direction STRING, "
        "fold INT, y INT, pred_proba DOUBLE"
    )
    if state["skipped"]:
        warnings.warn(f"agreement_k={k}: {state['skipped']}")
        return nothing
    rows = numeric_features(matrix.where((F.col("agreement_k") == k) & F.col("label_TOA").isNotNull()), features)
    folded = keep(group_folds(rows, "article_url", int(state["cv_n_splits"])))
    out = None
    for fold in range(1, int(state["cv_n_splits"]) + 1):
        train, test = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        if train.select("label_TOA").distinct().count() < 2:
            continue
        model = fit(train, features, "xgb", s)
        part = shapley_values(model, test, train, features, s.seed + fold, max_background).withColumn("fold", F.lit(fold))
        out = part if out is None else out.unionByName(part)
    if out is None:
        warnings.warn(f"agreement_k={k}: no training fold has two classes")
        return nothing
    return out.select(
        F.col("article_url").alias("media_url"), "feature", "feature_value", "shap_value",
        impact("shap_value").alias("impact_direction"), "fold", "y", "pred_proba",
    )
