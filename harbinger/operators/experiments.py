"""Grouped cross-validation of classifiers over feature families.

``matrix``: article_url, agreement_k, label_TOA and features (see ``features``).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from harbinger.functions.columns import as_col, number, ratio
from harbinger.functions.keyed import dense_index
from harbinger.session import keep

MODEL_ORDER = ["xgb", "rf", "logreg", "linear_svc", "dt"]
SCORE_COLUMNS = ["F1", "Precision", "Recall"]


@dataclass
class Settings:
    """Sizes of the models; the defaults are those of the reported experiments."""

    rounds: int = 300
    trees: int = 600
    iterations: int = 5000
    seed: int = 42
    cv_folds: int = 5
    classifiers: list[str] = field(default_factory=lambda: list(MODEL_ORDER))


def eligibility(matrix: DataFrame, cv_folds: int = 5) -> DataFrame:
    """Per k: rows, classes, fold count, and why it is skipped (empty when it is not)."""
    y = F.col("label_TOA")
    counted = matrix.where(y.isNotNull()).groupBy("agreement_k").agg(
        F.count("*").alias("n_articles"),
        F.count_if(y == 1).alias("n_pos"),
        F.count_if(y == 0).alias("n_neg"),
    )
    n, pos, neg = F.col("n_articles"), F.col("n_pos"), F.col("n_neg")
    splits = F.least(F.lit(cv_folds).cast("bigint"), n, pos, neg)
    reason = (  # fixed output texts
        F.when((n < 2) | (pos == 0) | (neg == 0), "fewer than two classes")
        .when(splits < 2, "too few minority examples")
        .otherwise("")
    )
    return counted.select("agreement_k", "n_articles", "n_pos", "n_neg", splits.alias("cv_n_splits"), reason.alias("skipped"))


def _levels(sizes: list[tuple[int, int]], n: int) -> list[tuple[int, list[int]]]:
    """How many groups of each size a fold gets when the largest groups go first, each to
    the lightest fold.  Works on the histogram (size, count)."""
    load = [0] * n
    plan = []
    for size, count in sorted(sizes, reverse=True):
        take = [0] * n
        left = count
        # all folds within one size of each other: the rest goes round in turn
        while left and max(load) - min(load) >= size:
            f = min(range(n), key=lambda i: (load[i], i))
            room = max(1, min(left, (sorted(load)[1] - load[f]) // size or 1)) if n > 1 else left
            take[f] += room
            load[f] += room * size
            left -= room
        each, extra = divmod(left, n)
        order = sorted(range(n), key=lambda i: (load[i], i))
        for pos, f in enumerate(order):
            more = each + (pos < extra)
            take[f] += more
            load[f] += more * size
        plan.append((size, take))
    return plan


def group_folds(df: DataFrame, group: str, n: int, out: str = "fold") -> DataFrame:
    """Folds 1..n such that no group is in two folds and row counts are balanced.

    Groups are numbered in hash order without a global sort.  Only the histogram of
    group sizes (one row per distinct size) reaches the driver.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_size"))
    histogram = [(r["_size"], r["n"]) for r in sizes.groupBy("_size").agg(F.count("*").alias("n")).collect()]
    numbered = dense_index(sizes, group, ["_size"])
    if len(histogram) <= 1:
        placed = numbered.select(group, (F.pmod("idx", F.lit(n)) + 1).cast("int").alias(out))
    else:
        rows = []
        for size, take in _levels(histogram, n):
            start = 0
            for f, count in enumerate(take):
                rows.append((size, start, start + count, f + 1))
                start += count
        plan = df.sparkSession.createDataFrame(rows, f"_size BIGINT, lo BIGINT, hi BIGINT, {out} INT")
        inside = (F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi"))
        placed = numbered.join(F.broadcast(plan), "_size").where(inside).select(group, out)
    return df.join(placed, group)


def class_weights(df: DataFrame, label: str = "label_TOA", within: list[str] | None = None) -> DataFrame:
    """Both weightings: ``balanced`` = n / (2 n_class), and positives by neg / pos."""
    within = within or []
    y = F.col(label)
    counts = df.groupBy(*within).agg(
        F.count("*").alias("n"), F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )
    return counts.select(
        *within,
        (F.col("n") / (2 * F.nullif("pos", F.lit(0)))).alias("balanced_pos"),
        (F.col("n") / (2 * F.nullif("neg", F.lit(0)))).alias("balanced_neg"),
        (F.col("neg") / F.greatest("pos", F.lit(1))).alias("scale_pos_weight"),
    )


def _classifier(name: str, s: Settings, total_weight: float):
    common = {"labelCol": "label", "featuresCol": "features", "weightCol": "weight"}
    if name == "xgb":
        return GBTClassifier(
            maxIter=s.rounds, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8",
            seed=s.seed, **common,
        )
    if name == "rf":
        return RandomForestClassifier(
            numTrees=s.trees, maxDepth=8, minInstancesPerNode=10, featureSubsetStrategy="sqrt", seed=s.seed, **common
        )
    if name == "logreg":
        return LogisticRegression(regParam=1.0 / max(total_weight, 1.0), elasticNetParam=0.0, maxIter=s.iterations, **common)
    if name == "linear_svc":
        return LinearSVC(regParam=1.0 / max(total_weight, 1.0), maxIter=s.iterations, **common)
    if name == "dt":
        return DecisionTreeClassifier(maxDepth=6, minInstancesPerNode=10, seed=s.seed, **common)
    raise ValueError(f"unknown classifier {name!r}")


def numeric_features(matrix: DataFrame, features: list[str]) -> DataFrame:
    """Features as numbers; what is no number becomes null, for the imputer."""
    kinds = {f.name: f.dataType for f in matrix.schema.fields}
    return matrix.withColumns(
        {c: number(F.col(c) if isinstance(kinds[c], NumericType) else F.col(c).cast("string")) for c in features}
    )


def fit(train: DataFrame, features: list[str], name: str, s: Settings, pos_weight: float | None = None):
    """Fitted pipeline: medians of the training rows, vector, scaling for linear models,
    classifier.  ``pos_weight`` overrides the weight of positives of the boosted trees."""
    y = F.col("label_TOA")
    c = train.agg(F.count("*").alias("n"), F.count_if(y == 1).alias("pos")).first()
    n, pos = c["n"], c["pos"]
    neg = n - pos
    if name == "xgb":
        up = pos_weight if pos_weight is not None else neg / max(pos, 1)
        weight, total = F.when(y == 1, F.lit(float(up))).otherwise(1.0), pos * up + neg
    else:
        wp, wn = n / (2.0 * max(pos, 1)), n / (2.0 * max(neg, 1))
        weight, total = F.when(y == 1, F.lit(wp)).otherwise(F.lit(wn)), float(n)
    ready = train.withColumns({"label": y.cast("double"), "weight": weight})
    filled = [f"{c}__filled" for c in features]
    raw = "raw_features" if name in ("logreg", "linear_svc") else "features"
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=filled, relativeError=0.0001),
        VectorAssembler(inputCols=filled, outputCol=raw),
    ]
    if raw == "raw_features":
        stages.append(StandardScaler(withMean=True, inputCol=raw, outputCol="features"))
    stages.append(_classifier(name, s, float(total)))
    return Pipeline(stages=stages).fit(ready)


def score(model, rows: DataFrame, out: str = "score") -> DataFrame:
    """Probability of the positive class; the sigmoid of the margin where a model has none."""
    predicted = model.transform(rows)
    if "probability" in predicted.columns:
        value = vector_to_array("probability")[1]
    else:
        value = 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1]))
    return predicted.select(*rows.columns, value.alias(out))


def score_measures(label: Column | str = "label_TOA", said: Column | None = None) -> dict[str, Column]:
    """F1, precision and recall as aggregates; no denominator gives 0."""
    y = as_col(label)
    yes = said if said is not None else F.col("score") >= 0.5
    tp = F.count_if((y == 1) & yes)
    fp = F.count_if((y == 0) & yes)
    fn = F.count_if((y == 1) & ~yes)
    return {"F1": ratio(2 * tp, 2 * tp + fp + fn), "Precision": ratio(tp, tp + fp), "Recall": ratio(tp, tp + fn)}


def measured(predictions: DataFrame, by: list[str], label: str = "label_TOA") -> DataFrame:
    return predictions.groupBy(*by).agg(*[c.alias(n) for n, c in score_measures(label).items()])


def constant_baselines(folded: DataFrame, all_negative: bool = False) -> DataFrame:
    """Fold scores of the constant guesses, on every fold: agreement_k, clf_name, fold, scores."""
    guesses = [("baseline_all_pos", True)] + ([("baseline_all_neg", False)] if all_negative else [])
    items = F.array(*[F.struct(F.lit(n).alias("clf_name"), F.lit(v).alias("yes")) for n, v in guesses])
    spread = folded.withColumn("g", F.explode(items)).select("*", "g.*").drop("g")
    scores = score_measures(said=F.col("yes"))
    return spread.groupBy("agreement_k", "clf_name", "fold").agg(*[c.alias(n) for n, c in scores.items()]).withColumn(
        "ablation", F.lit("baseline")
    )


def fold_summary(folds: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of each score over folds."""
    aggs = []
    for m in SCORE_COLUMNS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return folds.groupBy(*by).agg(*aggs)


FOLD_SCHEMA = (
    "agreement_k INT, clf_name STRING, ablation STRING, fold INT, n_train BIGINT, n_test BIGINT, n_train_pos BIGINT, "
    "n_train_neg BIGINT, n_test_pos BIGINT, n_test_neg BIGINT, n_features INT, F1 DOUBLE, Precision DOUBLE, Recall DOUBLE"
)


def cross_validate(matrix: DataFrame, k: int, groups: dict[str, list[str]], s: Settings) -> DataFrame:
    """Fold scores for one k over settings, classifiers and folds, fit by Spark ML.

    The driver holds only the list of fits and one score row per fit; every fit reads
    the cached, fold-tagged rows.  Folds with one class in training or test are skipped.
    The weight of positives of the boosted trees is that of the whole k.
    """
    state = [r for r in eligibility(matrix.where(F.col("agreement_k") == k), s.cv_folds).collect()]
    spark = matrix.sparkSession
    if not state or state[0]["skipped"]:
        return spark.createDataFrame([], FOLD_SCHEMA)
    splits = int(state[0]["cv_n_splits"])
    up = state[0]["n_neg"] / max(state[0]["n_pos"], 1)
    features = sorted({c for cols in groups.values() for c in cols})
    rows = numeric_features(
        matrix.where((F.col("agreement_k") == k) & F.col("label_TOA").isNotNull()), features
    )
    folded = keep(group_folds(rows, "article_url", splits))
    y = F.col("label_TOA")
    counts = {
        r["fold"]: (r["pos"], r["neg"])
        for r in folded.groupBy("fold").agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")).collect()
    }
    pos, neg = sum(c[0] for c in counts.values()), sum(c[1] for c in counts.values())
    out = []
    for ablation, cols in groups.items():
        for name in s.classifiers:
            for fold in sorted(counts):
                tp, tn = counts[fold]
                if 0 in (tp, tn, pos - tp, neg - tn):
                    continue
                model = fit(folded.where(F.col("fold") != fold), cols, name, s, up)
                got = score(model, folded.where(F.col("fold") == fold)).agg(
                    *[c.alias(m) for m, c in score_measures().items()]
                ).first()
                out.append(
                    (k, name, ablation, fold, pos + neg - tp - tn, tp + tn, pos - tp, neg - tn, tp, tn, len(cols),
                     float(got["F1"]), float(got["Precision"]), float(got["Recall"]))
                )
    folded.unpersist()
    return spark.createDataFrame(out, FOLD_SCHEMA)


def evaluate(matrix: DataFrame, ks: list[int], groups: dict[str, list[str]], s: Settings,
             all_negative: bool = False) -> DataFrame:
    """Summary rows of baselines and classifiers for every eligible k."""
    state = eligibility(matrix.where(F.col("agreement_k").isin(ks)), s.cv_folds)
    usable = {r["agreement_k"]: int(r["cv_n_splits"]) for r in state.collect() if not r["skipped"]}
    parts = []
    for k in [k for k in ks if k in usable]:
        rows = matrix.where((F.col("agreement_k") == k) & F.col("label_TOA").isNotNull())
        folded = group_folds(rows.select("article_url", "agreement_k", "label_TOA"), "article_url", usable[k])
        cols = ["agreement_k", "clf_name", "ablation", "fold", *SCORE_COLUMNS]
        parts.append(constant_baselines(folded, all_negative).select(*cols))
        parts.append(cross_validate(matrix, k, groups, s).select(*cols))
    if not parts:
        raise ValueError("no agreement threshold has two classes and enough minority examples")
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    summary = fold_summary(scores, ["agreement_k", "clf_name", "ablation"]).join(F.broadcast(state), "agreement_k")
    return summary.select(
        F.col("agreement_k").alias("outlier_k"),
        F.col("agreement_k").alias("toa_k"),
        F.lit(0).alias("toa_max_neg"),
        "cv_n_splits",
        "clf_name",
        "ablation",
        "n_articles",
        F.col("n_pos").alias("n_pos_articles_est"),
        F.col("n_neg").alias("n_neg_articles_est"),
        *[f"{m}_{x}" for m in SCORE_COLUMNS for x in ("mean", "std")],
    )


def fold_ablation(matrix: DataFrame, k: int, groups: dict[str, list[str]], s: Settings) -> DataFrame:
    """Fold rows of the boosted trees at one chosen k."""
    one = replace(s, classifiers=["xgb"])
    rows = cross_validate(matrix, k, groups, one)
    return rows.select(
        F.col("agreement_k").alias("outlier_maj"),
        F.col("agreement_k").alias("toa_min_pos"),
        F.lit(0).alias("toa_max_neg"),
        *[c for c in rows.columns if c != "agreement_k"],
    )
