"""Chronological evaluation: train on everything up to an origin, test on the window after it.

Rows: article_url, ta (publication-time snapshot), y, sub (trajectory class) and features.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from functools import reduce
from threading import Lock

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from harbinger.functions.columns import ratio, utc_naive
from harbinger.operators.experiments import Settings, fit, numeric_features, score
from harbinger.operators.quality import repeated_keys
from harbinger.session import cut_lineage, keep, stage

# Columns that are no features, windows, low-count mark, resamples.
META = [
    "media_url", "y", "true_subclass", "n_outlier_votes", "n_TOA_votes", "n_TODlate_votes", "n_O_votes", "TA",
    "n_models_present", "y_score", "y_pred",
]
MAIN_WINDOWS = [7, 14]
STABILITY_WINDOWS = [5, 7, 14, 21]
GRID_WARMUPS = [1, 2, 3, 4]
GRID_WINDOWS = [7, 14, 21, 28]
LOW_COUNT = 20
RESAMPLES = 2000
DAY = 86400
ROWS = 1 << 15  # rows of a task of the fits, which are many short jobs
SIDE_BY_SIDE = 8  # fits


def load(train: DataFrame, test: DataFrame) -> tuple[DataFrame, list[str]]:
    """Both splits as one table without old predictions, and its feature columns.

    An article in both splits is an error (one small job looks for it).
    """
    test = test.drop("y_score", "y_pred")
    if repeated_keys(train, test, "media_url").head(1):
        raise ValueError("duplicate articles across splits")
    both = train.drop("y_score", "y_pred").unionByName(test).withColumn("TA", utc_naive("TA"))
    return both, [c for c in both.columns if c not in META]


def _seconds(c: Column | str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp_ntz").cast("timestamp")) / 1_000_000


def window_numbers(rows: DataFrame, warmup_weeks: int, window_days: int) -> DataFrame:
    """``window`` of each row: i where TA lies in (origin i, origin i + W], -1 up to the first origin.

    Arithmetic instead of a range join of rows and origins.
    """
    start = rows.agg(F.min("TA").alias("t")).scalar()
    passed = _seconds("TA") - F.unix_micros(start.cast("timestamp_ntz").cast("timestamp")) / 1_000_000
    past = passed - warmup_weeks * 7 * DAY
    return rows.withColumn("window", F.greatest(F.ceil(past / (window_days * DAY)) - 1, F.lit(-1)).cast("int"))


def origins(rows: DataFrame, warmup_weeks: int, window_days: int) -> DataFrame:
    """Origins ``window, origin`` from min(TA) + warm-up in steps of W up to max(TA) - W; maybe none."""
    bounds = rows.agg(F.min("TA").cast("timestamp_ntz").alias("lo"), F.max("TA").cast("timestamp_ntz").alias("hi"))
    first = F.col("lo") + F.make_dt_interval(days=F.lit(warmup_weeks * 7))
    last = F.col("hi") - F.make_dt_interval(days=F.lit(window_days))
    step = F.make_dt_interval(days=F.lit(window_days))
    spread = bounds.where(first <= last).select(F.posexplode(F.sequence(first, last, step)).alias("window", "origin"))
    return spread.select("window", "origin")


def window_counts(rows: DataFrame, warmup_weeks: int, window_days: int) -> DataFrame:
    """Training and test counts per origin, and whether the window is skipped.

    Rows are counted once per window; training counts are running sums over windows.
    """
    numbered = window_numbers(rows, warmup_weeks, window_days)
    per = numbered.groupBy("window").agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("pos"))
    points = origins(rows, warmup_weeks, window_days)
    spine = points.select("window").unionByName(points.limit(1).select(F.lit(-1).alias("window")))
    filled = spine.join(per, "window", "left").na.fill(0)
    before = Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    grown = filled.select(
        "window",
        F.sum("n").over(before).alias("n_train"),
        F.sum("pos").over(before).alias("pos_train"),
        F.col("n").alias("n_test"),
        F.col("pos").alias("pos_test"),
    )
    one_class = (F.col("pos_train") == 0) | (F.col("pos_train") == F.col("n_train"))
    return points.join(grown, "window").withColumn("skipped", (F.col("n_test") == 0) | one_class)


def window_table(counts: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per origin: counts and F1 as text, ``no-pos`` without positives, ``SKIPPED`` when skipped."""
    yes, pos = F.col("p") >= 0.5, F.col("y") == 1
    tp, wrong = F.count_if(yes & pos), F.count_if(yes != pos)
    f1 = predictions.groupBy("origin").agg(ratio(2 * tp, 2 * tp + wrong).alias("f1"))
    text = (
        F.when(F.col("skipped"), "SKIPPED")
        .when(F.col("pos_test") == 0, "no-pos")
        .otherwise(F.format_string("%.3f", F.col("f1")))
    )
    return counts.join(f1, "origin", "left").select(
        F.date_format("origin", "yyyy-MM-dd").alias("origin"), "n_train", "pos_train", "n_test", "pos_test",
        text.alias("win_F1"),
    )


def roll(rows: DataFrame, features: list[str], warmup_weeks: int, window_days: int, s: Settings, fits: Fits | None = None):
    """One forward-chaining run: pooled predictions ``y, p, origin, sub`` (None without any
    window), and the counts per origin.

    The driver walks over the origins (one per window); each fit is a Spark ML job on
    the rows up to its origin, with medians and the weight of positives from them.  ``fits``: shared by other runs over
    the same rows.
    """
    if fits is not None:
        counts = window_counts(rows, warmup_weeks, window_days)
        asked = [fits.ask(w) for w in sorted(counts.collect(), key=lambda r: r["window"]) if not w["skipped"]]
        until = F.col("origin") + F.make_dt_interval(days=F.lit(window_days))
        parts = [f.result().where(F.col("TA") <= until).drop("TA") for f in asked]
        return (reduce(DataFrame.unionByName, parts) if parts else None), counts
    ready = keep(numeric_features(window_numbers(rows, warmup_weeks, window_days), features).withColumn(
        "label_TOA", F.col("y").cast("double")
    ))
    counts = window_counts(rows, warmup_weeks, window_days)
    pooled = None
    for w in sorted(counts.collect(), key=lambda r: r["window"]):
        if w["skipped"]:
            continue
        up = max(w["n_train"] - w["pos_train"], 1) / max(w["pos_train"], 1)
        model = fit(ready.where(F.col("window") < w["window"]), features, "xgb", s, up)
        part = score(model, ready.where(F.col("window") == w["window"]), "p").select(
            F.col("y").cast("int").alias("y"), "p", F.lit(w["origin"]).cast("timestamp_ntz").alias("origin"),
            F.col("true_subclass").alias("sub"),
        )
        pooled = part if pooled is None else pooled.unionByName(part)
    if pooled is not None:
        pooled = cut_lineage(pooled)
    ready.unpersist()
    return pooled, counts


def cell(predictions: DataFrame) -> DataFrame:
    """Pooled scores and counts: F1, n, pos, neg, Pr, Rc and the all-positive baseline."""
    yes, pos = F.col("p") >= 0.5, F.col("y") == 1
    counted = predictions.agg(
        F.count("*").alias("n"),
        F.count_if(pos).alias("pos"),
        F.count_if(~pos).alias("neg"),
        F.count_if(yes & pos).alias("tp"),
        F.count_if(yes & ~pos).alias("fp"),
        F.count_if(~yes & pos).alias("fn"),
    )
    share = F.col("pos") / F.nullif("n", F.lit(0))
    return counted.select(
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("F1"),
        "n", "pos", "neg", "tp", "fp", "fn",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("Pr"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("Rc"),
        (2 * share / (1 + share)).alias("baseline"),
    )


def bootstrap_interval(predictions: DataFrame, seed: int = 0, resamples: int = RESAMPLES) -> DataFrame:
    """95 % percentile interval of the pooled F1: one row ``lo, hi, used``.

    F1 depends on a resample only through its confusion counts, and those of n draws
    with replacement are multinomial.  So a resample is one draw from the four pooled
    counts, whatever the number of predictions.  Draws are seeded by resample number and
    do not depend on partitioning; resamples without a positive are left out.
    """
    spark = predictions.sparkSession
    counts = cell(predictions).select("n", "tp", "fp", "fn")
    draws = spark.range(resamples).select(F.col("id").alias("b")).crossJoin(F.broadcast(counts))  # one row of counts

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for b, n, tp, fp, fn in zip(pdf["b"], pdf["n"], pdf["tp"], pdf["fp"], pdf["fn"]):
                if n == 0:
                    continue
                shares = np.array([tp, fp, fn, n - tp - fp - fn], dtype=float) / n
                got = np.random.default_rng([seed, int(b)]).multinomial(int(n), shares)
                if got[0] + got[2] > 0:
                    out.append((int(b), 2.0 * got[0] / (2.0 * got[0] + got[1] + got[2])))
            yield pd.DataFrame(out, columns=["b", "f1"])

    scores = draws.select("b", "n", "tp", "fp", "fn").mapInPandas(draw, "b BIGINT, f1 DOUBLE")
    return scores.agg(
        F.percentile("f1", F.lit(0.025)).alias("lo"), F.percentile("f1", F.lit(0.975)).alias("hi"),
        F.count("*").alias("used"),
    )


def subclass_rates(predictions: DataFrame) -> DataFrame:
    """Rows and share predicted positive per trajectory class, three decimals."""
    return predictions.groupBy("sub").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("p") >= 0.5).cast("double")), 3).alias("pred_pos_rate")
    )


def _one(predictions: DataFrame, seed: int, resamples: int) -> dict:
    """A table cell; two single-row jobs."""
    c = cell(predictions).first().asDict()
    b = bootstrap_interval(predictions, seed, resamples).first()
    return {**c, "lo": b["lo"], "hi": b["hi"]}


def shown(c: dict) -> str:
    return f"{c['F1']:.3f} [{c['lo']:.2f}, {c['hi']:.2f}]"


def main_table(name: str, rows: DataFrame, features: list[str], warmup_weeks: int, s: Settings,
               seed: int = 1, extended_warmup: int | None = None, resamples: int = RESAMPLES) -> DataFrame:
    """One row per corpus: F1 at W = 7 and 14, baseline, and the long warm-up as a footnote."""
    cells = {}
    for w in MAIN_WINDOWS:
        predictions, _ = roll(rows, features, warmup_weeks, w, s)
        if predictions is None:
            raise ValueError(f"no usable window at W = {w} days")
        cells[w] = _one(predictions, seed, resamples)
        seed += 1
    foot = ""
    if extended_warmup is not None:
        predictions, _ = roll(rows, features, extended_warmup, 14, s)
        if predictions is not None:
            late = _one(predictions, seed, resamples)
            foot = (  # fixed output text
                f"window-fit rule pools {cells[14]['pos']}/{cells[14]['neg']} at W=14d; "
                f"{extended_warmup}-week warm-up: F1 = {shown(late)}"
            )
    row = (name, cells[7]["pos"], cells[7]["neg"], shown(cells[7]), shown(cells[14]), round(cells[7]["baseline"], 3), foot)
    return rows.sparkSession.createDataFrame(
        [row], "Corpus STRING, Pos BIGINT, Neg BIGINT, F1_W7 STRING, F1_W14 STRING, Baseline_F1 DOUBLE, footnote STRING"
    )


def stability(name: str, rows: DataFrame, features: list[str], warmup_weeks: int, s: Settings,
              windows: list[int] | None = None, seed: int = len(MAIN_WINDOWS) + 1,
              resamples: int = RESAMPLES) -> DataFrame:
    """F1 over window lengths; lengths without pooled positives are left out.

    Resampling seeds count on from the main table's, one per length, left out or not.
    """
    out = []
    for seed, w in enumerate(windows or STABILITY_WINDOWS, seed):
        predictions, _ = roll(rows, features, warmup_weeks, w, s)
        if predictions is None:
            continue
        c = _one(predictions, seed, resamples)
        if c["pos"]:
            out.append((name, f"{w}d", f"{warmup_weeks}w", round(c["F1"], 3), round(c["lo"], 3), round(c["hi"], 3),
                        c["pos"], c["pos"] < LOW_COUNT))
    return rows.sparkSession.createDataFrame(
        out, "Corpus STRING, W STRING, warmup STRING, F1 DOUBLE, lo DOUBLE, hi DOUBLE, pos BIGINT, low_n BOOLEAN"
    )


class Fits:
    """Predictions of the model of every origin, fitted once for all runs that ask; fits run side by side.

    A fit depends on its origin only, whatever warm-up and window lead there.  It predicts the ``days`` after it.
    """

    def __init__(self, rows: DataFrame, features: list[str], s: Settings, days: int):
        self.rows, self.features, self.s, self.days = rows, features, s, days
        self.pool, self.lock = ThreadPoolExecutor(SIDE_BY_SIDE), Lock()
        self.ready: DataFrame | None = None
        self.asked: dict = {}

    def __enter__(self) -> Fits:
        return self

    def __exit__(self, *failure) -> None:
        self.pool.shutdown(cancel_futures=True)
        if self.ready is not None:
            self.ready.unpersist()

    def ask(self, w: Row) -> Future:
        """``y, p, TA, origin, sub`` after the origin of a row of ``window_counts``."""
        with self.lock:
            if self.ready is None:
                tasks = max(1, -(-self.rows.count() // ROWS))
                labelled = numeric_features(self.rows, self.features).withColumn("label_TOA", F.col("y").cast("double"))
                self.ready = keep(labelled.coalesce(tasks))
            if w["origin"] not in self.asked:
                self.asked[w["origin"]] = self.pool.submit(inheritable_thread_target(self.rows.sparkSession)(self._predicted), w)
            return self.asked[w["origin"]]

    def _predicted(self, w: Row) -> DataFrame:
        when, start = F.col("TA").cast("timestamp_ntz"), F.lit(w["origin"]).cast("timestamp_ntz")
        up = max(w["n_train"] - w["pos_train"], 1) / max(w["pos_train"], 1)
        before = self.ready.where((when <= start) | when.isNull())  # no time: trained on, as without sharing
        after = self.ready.where((when > start) & (when <= start + F.make_dt_interval(days=F.lit(self.days))))
        part = score(fit(before, self.features, "xgb", self.s, up), after, "p")
        return stage(part.select(F.col("y").cast("int").alias("y"), "p", when.alias("TA"), start.alias("origin"), F.col("true_subclass").alias("sub")))


def grid(rows: DataFrame, features: list[str], warmups: list[int], windows: list[int], s: Settings) -> DataFrame:
    """Warm-up x window settings with their pooled scores; the rows are worked out once and every origin is
    fitted once for all settings, which run side by side."""
    spark = rows.sparkSession
    rows = cut_lineage(rows)

    def one(setting: tuple[int, int]):
        warmup, w = setting
        predictions, _ = roll(rows, features, warmup, w, s, fits)
        if predictions is None:
            return None
        c = cell(predictions).first()
        if not c["pos"]:
            return None
        n_windows = predictions.select("origin").distinct().count()
        return (f"{warmup}w", f"{w}d", c["n"], c["pos"], round(c["F1"], 3), round(c["Pr"], 3), round(c["Rc"], 3),
                c["pos"] < LOW_COUNT, n_windows == 1)

    settings = [(warmup, w) for warmup in warmups for w in windows]
    with Fits(rows, features, s, max(windows, default=0)) as fits, ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(one), x) for x in settings]
        out = [row for row in (f.result() for f in waiting) if row is not None]
    return spark.createDataFrame(
        out,
        "warmup STRING, window STRING, n BIGINT, pos BIGINT, F1 DOUBLE, Pr DOUBLE, Rc DOUBLE, low_n BOOLEAN, "
        "single_window BOOLEAN",
    )


def grid_summary(table: DataFrame) -> DataFrame:
    """Median and range of F1 over all settings and over those with enough positives."""
    enough = ~F.col("low_n")
    return table.agg(
        F.count("*").alias("n_configs"),
        F.median("F1").alias("F1_median"),
        F.min("F1").alias("F1_min"),
        F.max("F1").alias("F1_max"),
        F.count_if(enough).alias("n_enough"),
        F.min(F.when(enough, F.col("F1"))).alias("F1_min_enough"),
        F.max(F.when(enough, F.col("F1"))).alias("F1_max_enough"),
    )
