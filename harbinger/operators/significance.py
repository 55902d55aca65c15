"""Paired comparison of fold scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harbinger.functions.columns import as_col

METRICS = ["F1", "Precision", "Recall"]
# The compared settings.
COMPARISONS = [
    ("all_features", "no_geom"),
    ("all_features", "only_geom"),
    ("all_features", "no_social"),
    ("all_features", "no_text"),
    ("only_geom", "only_text"),
    ("only_geom", "only_social"),
]


LONGEST_SUM = 1000
PANELS = 400


def _finite_sum(t: Column, df: Column) -> Column:
    """Probability within ``-t .. t`` for whole degrees of freedom: the angle (odd ones) and a finite sum of powers
    of its cosine."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    cos2 = F.cos(angle) * F.cos(angle)
    odd = df % 2
    terms = F.floor((df - odd) / 2).cast("int")
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(acc: Column, i: Column) -> Column:
        ratio = (2 * i - 1 + odd) / (2 * i + odd)
        return F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * ratio * cos2).cast("double").alias("term"))

    total = F.when(terms > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), zero, add, lambda acc: acc["sum"])).otherwise(0.0)
    return F.when(odd == 0, F.sin(angle) * total).otherwise(F.lit(2 / math.pi) * (angle + F.sin(angle) * F.cos(angle) * total))


def _ratio_of_areas(t: Column, df: Column) -> Column:
    """Two-sided tail as the area under a power of the cosine beyond the angle, by Simpson's rule, over the whole one."""
    end, width = F.lit(math.pi / 2), 14 / F.sqrt(df)

    def area(start: Column) -> Column:
        step = (F.least(end, start + width) - start) / PANELS
        value = lambda i: F.exp((df - 1) * F.ln(F.greatest(F.cos(start + i * step), F.lit(1e-300))))
        weight = lambda i: F.when((i == 0) | (i == PANELS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(PANELS)), F.lit(0.0), lambda acc, i: acc + weight(i) * value(i)) * step / 3

    return area(F.atan(F.abs(t) / F.sqrt(df))) / area(F.lit(0.0))


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p value of Student's t for whole degrees of freedom: a finite sum up to LONGEST_SUM of them, a ratio of
    areas beyond; null where either is null or there is no degree of freedom."""
    df = df.cast("double")
    inside = F.when(df <= LONGEST_SUM, 1 - _finite_sum(t, F.least(df, F.lit(float(LONGEST_SUM))))).otherwise(_ratio_of_areas(t, df))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside))
    return F.when(t.isNotNull() & (df >= 1), F.when(F.abs(t) == float("inf"), 0.0).otherwise(value))


def paired_scores(folds: DataFrame, comparisons: list[tuple[str, str]] | None = None) -> DataFrame:
    """metric, reference, comparison, fold, and both scores; folds missing a side drop out.

    Fold tables have one row per (setting, fold), so all of this stays tiny.
    """
    spark = folds.sparkSession
    wanted = spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(comparisons or COMPARISONS)], "pos INT, reference STRING, comparison STRING"
    )
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in METRICS])
    long = folds.select("ablation", "fold", F.explode(items).alias("i")).groupBy(
        "ablation", "fold", F.col("i.metric").alias("metric")
    ).agg(F.avg("i.score").alias("score"))
    left = long.select(F.col("ablation").alias("reference"), "fold", "metric", F.col("score").alias("ref"))
    right = long.select(F.col("ablation").alias("comparison"), "fold", "metric", F.col("score").alias("comp"))
    pairs = wanted.join(left, "reference").join(right, ["comparison", "fold", "metric"])
    return pairs.dropna(subset=["ref", "comp"])


def cohens_dz(mean: Column, sd: Column, n: Column) -> Column:
    """Paired effect size; no spread gives 0 or infinity, one pair gives null."""
    return F.when(n < 2, F.lit(None)).when(sd == 0, F.when(mean == 0, 0.0).otherwise(F.lit(float("inf")))).otherwise(
        mean / F.nullif(sd, F.lit(0.0))
    )


def benjamini_hochberg(tests: DataFrame, p: str = "paired_t_p", q: str = "paired_t_q_fdr") -> DataFrame:
    """Adjusted p values over all rows; null p are ignored and stay null.

    The table has one row per test, so the global order is cheap.
    """
    known = tests.where(F.col(p).isNotNull())
    up = Window.orderBy(p)
    total = known.agg(F.count("*").alias("n")).scalar()
    ranked = known.withColumn("_r", F.row_number().over(up)).withColumn("_raw", F.col(p) * total / F.col("_r"))
    down = Window.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = ranked.withColumn(q, F.least(F.greatest(F.min("_raw").over(down), F.lit(0.0)), F.lit(1.0)))
    rest = tests.where(F.col(p).isNull()).withColumn(q, F.lit(None).cast("double"))
    return adjusted.drop("_r", "_raw").unionByName(rest)


def stars(q: Column | str) -> Column:
    q = as_col(q)
    return F.when(q.isNull(), "n/a").when(q < 0.001, "***").when(q < 0.01, "**").when(q < 0.05, "*").otherwise("ns")


def paired_tests(folds: DataFrame, k: int, clf_name: str = "xgb",
                 comparisons: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per comparison and metric with at least two common folds.

    Without spread the statistic is null (mean 0) or infinite, and p is null or 0.
    """
    diff = F.col("ref") - F.col("comp")
    grouped = (
        paired_scores(folds, comparisons)
        .withColumn("diff", diff)
        .groupBy("pos", "metric", "reference", "comparison")
        .agg(
            F.count("*").alias("n_folds"),
            F.avg("ref").alias("reference_mean"),
            F.avg("comp").alias("comparison_mean"),
            F.avg("diff").alias("mean_diff_ref_minus_comp"),
            # equal differences have no spread, whatever float noise says
            F.when(F.max("diff") - F.min("diff") < 1e-12, 0.0).otherwise(F.stddev_samp("diff")).alias("std_diff"),
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("fold", "diff"))),
                    lambda x: F.format_string("%.4f", x.getField("diff")),
                ),
                ", ",
            ).alias("diffs_by_fold"),
        )
        .where(F.col("n_folds") >= 2)
    )
    n, mean, sd = F.col("n_folds"), F.col("mean_diff_ref_minus_comp"), F.col("std_diff")
    flat = sd == 0
    sign = F.when(mean > 0, float("inf")).when(mean < 0, float("-inf"))
    t = F.when(flat, sign).otherwise(mean / F.nullif(sd / F.sqrt(n), F.lit(0.0)))
    tested = grouped.withColumns(
        {"cohens_dz": cohens_dz(mean, sd, n), "paired_t_stat": t}
    )
    p = F.when(flat, F.when(mean == 0, F.lit(None)).otherwise(0.0)).otherwise(
        t_tail(F.when(~flat, F.col("paired_t_stat")), n - 1)
    )
    adjusted = benjamini_hochberg(tested.withColumn("paired_t_p", p))
    return adjusted.select(
        F.lit(k).alias("k"),
        F.lit(clf_name).alias("clf_name"),
        "metric",
        "reference",
        "comparison",
        "n_folds",
        "reference_mean",
        "comparison_mean",
        "mean_diff_ref_minus_comp",
        "std_diff",
        "cohens_dz",
        "paired_t_stat",
        "paired_t_p",
        "diffs_by_fold",
        "paired_t_q_fdr",
        stars("paired_t_q_fdr").alias("paired_t_sig"),
    )
