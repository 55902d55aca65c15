"""Experiments, fold statistics and paired tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from harbinger.functions.columns import r6
from harbinger.operators import experiments as E
from harbinger.operators import features as X
from harbinger.operators import significance as S
from harbinger.plans import inputs
from harbinger.plans.catalog import register
from harbinger.plans.twins import sql

SMALL = E.Settings(rounds=3, trees=5, iterations=5, cv_folds=2)


def folds(spark, sf_dir):
    return E.measured(inputs.predictions(spark, sf_dir), ["ablation", "fold"])


def rounded(df, names):
    return df.withColumns({c: r6(c) for c in names})


@register(
    "experiment_eligibility",
    """SELECT agreement_k, n AS n_articles, pos AS n_pos, n - pos AS n_neg, least(5, n, pos, n - pos) AS cv_n_splits,
      CASE WHEN n < 2 OR pos = 0 OR pos = n THEN 'fewer than two classes'
           WHEN least(5, n, pos, n - pos) < 2 THEN 'too few minority examples' ELSE '' END AS skipped
    FROM (SELECT k AS agreement_k, count(*) AS n, CAST(sum(CASE k WHEN 1 THEN quality WHEN 2 THEN toxic ELSE 1 END) AS BIGINT)
          AS pos FROM labels, (SELECT CAST(unnest([1, 2, 3]) AS INT) AS k) GROUP BY k)""",
)
def experiment_eligibility(spark, sf_dir):
    lab = inputs.table(spark, sf_dir, "labels")
    goals = [("quality", 1), ("toxic", 2), (None, 3)]
    items = F.array(
        *[
            F.struct(F.lit(k).alias("agreement_k"), (F.col(c) if c else F.lit(1)).cast("double").alias("label_TOA"))
            for c, k in goals
        ]
    )
    return E.eligibility(lab.select(F.explode(items).alias("g")).select("g.*"))


@register(
    "group_folds",
    """SELECT doc_id, CAST((row_number() OVER (ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 3),
      CAST(doc_id AS VARCHAR)) - 1) % 5 + 1 AS INT) AS fold FROM labels""",
)
def group_folds(spark, sf_dir):
    return E.group_folds(inputs.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 5)


@register(
    "group_folds_unequal",
    "SELECT user_id, count(*) AS n, 1 AS n_folds FROM events GROUP BY user_id",
)
def group_folds_unequal(spark, sf_dir):
    """Events grouped by user: every user lies in exactly one fold."""
    placed = E.group_folds(inputs.table(spark, sf_dir, "events").select("user_id"), "user_id", 5)
    return placed.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_distinct("fold").cast("int").alias("n_folds")
    )


@register(
    "class_weights",
    """SELECT source, round(n / (2 * nullif(pos, 0))::DOUBLE, 6) AS balanced_pos, round(n / (2 * nullif(n - pos, 0))::DOUBLE, 6)
      AS balanced_neg, round((n - pos) / greatest(pos, 1)::DOUBLE, 6) AS scale_pos_weight
    FROM (SELECT source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS pos FROM labels JOIN documents USING (doc_id) GROUP BY source)""",
)
def class_weights(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "labels").join(inputs.table(spark, sf_dir, "documents"), "doc_id")
    out = E.class_weights(rows, "quality", ["source"])
    return rounded(out, ["balanced_pos", "balanced_neg", "scale_pos_weight"])


@register(
    "constant_baselines",
    """SELECT CAST(1 AS INT) AS agreement_k, g AS clf_name, 'baseline' AS ablation, fold,
      round(CASE WHEN g = 'baseline_all_pos' THEN coalesce(2 * pos / nullif(pos + n, 0), 0) ELSE 0 END, 6) AS F1,
      round(CASE WHEN g = 'baseline_all_pos' THEN pos / n ELSE 0 END, 6) AS "Precision",
      CASE WHEN g = 'baseline_all_pos' AND pos > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS Recall
    FROM (SELECT CAST(doc_id % 5 + 1 AS INT) AS fold, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS pos FROM labels GROUP BY 1),
      (SELECT unnest(['baseline_all_pos', 'baseline_all_neg']) AS g)""",
)
def constant_baselines(spark, sf_dir):
    lab = inputs.table(spark, sf_dir, "labels").select(
        F.lit(1).alias("agreement_k"), (F.col("doc_id") % 5 + 1).cast("int").alias("fold"),
        F.col("quality").cast("double").alias("label_TOA"),
    )
    return rounded(E.constant_baselines(lab, all_negative=True), E.SCORE_COLUMNS)


@register(
    "fold_scores",
    sql('SELECT ablation, fold, round(f1, 6) AS F1, round(pr, 6) AS "Precision", round(rc, 6) AS Recall FROM fold_scores', "fold_scores"),
)
def fold_scores(spark, sf_dir):
    return rounded(folds(spark, sf_dir), E.SCORE_COLUMNS)


@register(
    "fold_summary",
    sql(
        """SELECT ablation, round(avg(f1), 6) AS F1_mean, round(stddev_pop(f1), 6) AS F1_std,
        round(avg(pr), 6) AS Precision_mean, round(stddev_pop(pr), 6) AS Precision_std,
        round(avg(rc), 6) AS Recall_mean, round(stddev_pop(rc), 6) AS Recall_std FROM fold_scores GROUP BY ablation""",
        "fold_scores",
    ),
)
def fold_summary(spark, sf_dir):
    out = E.fold_summary(folds(spark, sf_dir), ["ablation"])
    return rounded(out, [c for c in out.columns if c != "ablation"])


@register("classifier_grid")
def classifier_grid(spark, sf_dir):
    matrix = inputs.document_matrix(spark, sf_dir)
    groups = X.ablations(matrix.columns)
    return E.evaluate(matrix, [1], {"all_features": groups["all_features"]}, SMALL, all_negative=True)


@register("fold_ablation")
def fold_ablation(spark, sf_dir):
    matrix = inputs.document_matrix(spark, sf_dir)
    return E.fold_ablation(matrix, 1, X.ablations(matrix.columns), SMALL)


@register(
    "paired_scores",
    sql(
        """SELECT CASE metric WHEN 'f1' THEN 'F1' WHEN 'pr' THEN 'Precision' ELSE 'Recall' END AS metric, reference, comparison,
        fold, round(ref, 6) AS ref, round(comp, 6) AS comp FROM compared""",
        "compared",
    ),
)
def paired_scores(spark, sf_dir):
    out = S.paired_scores(folds(spark, sf_dir))
    return rounded(out.select("metric", "reference", "comparison", "fold", "ref", "comp"), ["ref", "comp"])


@register(
    "paired_tests",
    sql(
        """SELECT CAST(4 AS INT) AS k, 'xgb' AS clf_name, metric, reference, comparison, n AS n_folds,
        round(mr, 6) AS reference_mean, round(mc, 6) AS comparison_mean, round(md, 6) AS mean_diff_ref_minus_comp,
        round(sd, 6) AS std_diff, round(md / sd, 6) AS cohens_dz, round(t, 6) AS paired_t_stat, round(p, 6) AS paired_t_p,
        diffs AS diffs_by_fold, round(q, 6) AS paired_t_q_fdr,
        CASE WHEN q IS NULL THEN 'n/a' WHEN q < 0.001 THEN '***' WHEN q < 0.01 THEN '**' WHEN q < 0.05 THEN '*' ELSE 'ns' END
          AS paired_t_sig FROM adjusted""",
        "adjusted",
    ),
)
def paired_tests(spark, sf_dir):
    out = S.paired_tests(folds(spark, sf_dir), 4)
    return rounded(
        out,
        ["reference_mean", "comparison_mean", "mean_diff_ref_minus_comp", "std_diff", "cohens_dz", "paired_t_stat",
         "paired_t_p", "paired_t_q_fdr"],
    )


# the same tails from products written with the gamma function
@register(
    "t_tails",
    """WITH d AS (SELECT doc_id, (doc_id % 97) / 16.0::DOUBLE AS t, 1 + doc_id % 30 AS v FROM documents),
    a AS (SELECT *, atan(t / sqrt(v)) AS h FROM d),
    s AS (SELECT doc_id, coalesce(sum(CASE WHEN v % 2 = 0
          THEN exp(lgamma(j + 0.5) - lgamma(j + 1) - lgamma(0.5)) * power(cos(h), 2 * j)
          ELSE exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * power(cos(h), 2 * j + 1) END), 0) AS total
        FROM a LEFT JOIN range(15) r(j) ON j < v // 2 GROUP BY doc_id)
    SELECT doc_id, v AS df, round(greatest(0, 1 - CASE WHEN v % 2 = 0 THEN sin(h) * total ELSE 2 / pi() * (h + sin(h) * total) END), 6) + 0.0 AS p
    FROM a JOIN s USING (doc_id)""",
)
def t_tails(spark, sf_dir):
    """Tails at 1 to 30 degrees of freedom."""
    doc = inputs.table(spark, sf_dir, "documents").select("doc_id", (1 + F.col("doc_id") % 30).alias("df"))
    return doc.withColumn("p", r6(S.t_tail(F.col("doc_id") % 97 / F.lit(16.0), F.col("df"))))


@register(
    "adjusted_p_values",
    """SELECT source, p, least(min(p * m / r) OVER (ORDER BY r DESC), 1) AS q FROM (
      SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS r FROM (
        SELECT source, sum(doc_id * 7 % 1009) % 1000 / 1000.0::DOUBLE AS p FROM documents GROUP BY source))""",
)
def adjusted_p_values(spark, sf_dir):
    doc = inputs.table(spark, sf_dir, "documents")
    p = (F.sum(F.col("doc_id") * 7 % 1009) % 1000 / F.lit(1000.0)).alias("p")
    return S.benjamini_hochberg(doc.groupBy("source").agg(p), "p", "q")
