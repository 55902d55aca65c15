"""Chronological evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from harbinger.functions.columns import r6
from harbinger.operators import forward as W
from harbinger.operators.experiments import Settings
from harbinger.operators.texts import MEASURES
from harbinger.plans import inputs
from harbinger.plans.catalog import register
from harbinger.plans.twins import sql

RUNS = [(5, 2), (7, 2), (14, 2), (21, 2), (7, 12)]
SMALL = Settings(rounds=3)


def predictions(spark, sf_dir):
    rows = inputs.dated_rows(spark, sf_dir)
    return W.window_numbers(rows, 2, 7).select(
        "y", ((F.col("media_url") * 53 % 100) / F.lit(100.0)).alias("p"), "window", F.col("true_subclass").alias("sub")
    )


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


@register(
    "chain_origins",
    sql("SELECT CAST(w AS INT) AS w, CAST(m AS INT) AS m, strftime(origin, '%Y-%m-%d') AS origin FROM chain_origins", "chain_origins"),
)
def chain_origins(spark, sf_dir):
    rows = inputs.dated_rows(spark, sf_dir)
    parts = [
        W.origins(rows, m, w).select(F.lit(w).alias("w"), F.lit(m).alias("m"), day("origin").alias("origin"))
        for w, m in RUNS
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register(
    "chain_window_counts",
    sql(
        """SELECT CAST(w AS INT) AS w, CAST(m AS INT) AS m, strftime(origin, '%Y-%m-%d') AS origin, n_train,
        CAST(pos_train AS BIGINT) AS pos_train, n_test, CAST(pos_test AS BIGINT) AS pos_test,
        n_test = 0 OR pos_train = 0 OR pos_train = n_train AS skipped FROM chain_counts""",
        "chain_counts",
    ),
)
def chain_window_counts(spark, sf_dir):
    rows = inputs.dated_rows(spark, sf_dir)
    parts = [
        W.window_counts(rows, m, w).drop("window").select(
            F.lit(w).alias("w"), F.lit(m).alias("m"), day("origin").alias("origin"),
            "n_train", "pos_train", "n_test", "pos_test", "skipped",
        )
        for w, m in RUNS
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register(
    "chain_window_table",
    sql(
        """SELECT strftime(origin, '%Y-%m-%d') AS origin, n_train, CAST(pos_train AS BIGINT) AS pos_train, n_test,
        CAST(pos_test AS BIGINT) AS pos_test,
        CASE WHEN n_test = 0 OR pos_train = 0 OR pos_train = n_train THEN 'SKIPPED' WHEN pos_test = 0 THEN 'no-pos'
          ELSE printf('%.3f', (SELECT coalesce(2.0 * count_if(y = 1 AND p >= 0.5) / nullif(2 * count_if(y = 1 AND p >= 0.5)
            + count_if((y = 1) <> (p >= 0.5)), 0), 0)::DOUBLE FROM dated d WHERE d.ta > c.origin AND d.ta <= c.origin + to_days(7))) END AS win_F1
        FROM chain_counts c WHERE w = 7 AND m = 2""",
        "chain_counts",
        "dated",
    ),
)
def chain_window_table(spark, sf_dir):
    rows = inputs.dated_rows(spark, sf_dir)
    counts = W.window_counts(rows, 2, 7)
    scored = predictions(spark, sf_dir).join(counts.select("window", "origin"), "window")
    return W.window_table(counts, scored)


@register(
    "pooled_cell",
    sql(
        """SELECT round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS F1, n, pos, n - pos AS neg,
        round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS Pr, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS Rc,
        round(2 * (pos / n::DOUBLE) / (1 + pos / n::DOUBLE), 6) AS baseline FROM (
          SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, CAST(count_if(y = 1 AND p >= 0.5) AS BIGINT) AS tp,
          CAST(count_if(y = 0 AND p >= 0.5) AS BIGINT) AS fp, CAST(count_if(y = 1 AND p < 0.5) AS BIGINT) AS fn FROM dated)""",
        "dated",
    ),
)
def pooled_cell(spark, sf_dir):
    out = W.cell(predictions(spark, sf_dir)).drop("tp", "fp", "fn")
    return out.withColumns({c: r6(c) for c in ["F1", "Pr", "Rc", "baseline"]})


@register("bootstrap_interval")
def bootstrap_interval(spark, sf_dir):
    return W.bootstrap_interval(predictions(spark, sf_dir), seed=1)


@register(
    "subclass_rates",
    sql("SELECT sub, count(*) AS n, round(avg((p >= 0.5)::INT::DOUBLE), 3) AS pred_pos_rate FROM dated GROUP BY sub", "dated"),
)
def subclass_rates(spark, sf_dir):
    return W.subclass_rates(predictions(spark, sf_dir))


def loaded(spark, sf_dir):
    rows = inputs.dated_rows(spark, sf_dir)
    even = F.col("media_url") % 2 == 0
    return W.load(rows.where(even), rows.where(~even).withColumn("y_score", F.lit(0.5)))


@register(
    "chain_input",
    sql("SELECT doc_id AS media_url, y, strftime(ta, '%Y-%m-%d') AS TA FROM dated", "dated"),
)
def chain_input(spark, sf_dir):
    rows, _ = loaded(spark, sf_dir)
    return rows.select("media_url", "y", day("TA").alias("TA"))


@register("chain_main_table")
def chain_main_table(spark, sf_dir):
    rows, features = loaded(spark, sf_dir)
    return W.main_table("documents", rows, features, 5, SMALL, extended_warmup=7)


@register("chain_stability")
def chain_stability(spark, sf_dir):
    return W.stability("documents", inputs.dated_rows(spark, sf_dir), MEASURES, 6, SMALL, [14, 21])


@register("chain_grid")
def chain_grid(spark, sf_dir):
    """All settings of the reported grid, with models of full size."""
    return W.grid_summary(W.grid(inputs.dated_rows(spark, sf_dir), MEASURES, W.GRID_WARMUPS, W.GRID_WINDOWS, Settings()))


@register(
    "grid_summary",
    """SELECT count(*) AS n_configs, median(f) AS F1_median, min(f) AS F1_min, max(f) AS F1_max,
      CAST(count_if(n >= 20) AS BIGINT) AS n_enough, min(f) FILTER (n >= 20) AS F1_min_enough, max(f) FILTER (n >= 20) AS F1_max_enough
    FROM (SELECT source, count(*) AS n, (sum(n_chars) % 1000) / 1000.0::DOUBLE AS f FROM documents GROUP BY source)""",
)
def grid_summary(spark, sf_dir):
    doc = inputs.table(spark, sf_dir, "documents")
    table = doc.groupBy("source").agg(
        (F.count("*") < W.LOW_COUNT).alias("low_n"), (F.sum("n_chars") % 1000 / F.lit(1000.0)).alias("F1")
    )
    return W.grid_summary(table)
