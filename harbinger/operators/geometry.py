"""Position of an article among the topics and articles known at its publication.

Input is a results table: model, article_id, pub, snapshot_date, topic_id, is_outlier,
outlier_score, coords.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harbinger.functions.columns import number, topic_number, truthy, utc_naive
from harbinger.functions.keyed import average_rank
from harbinger.functions.vectors import (
    diagonal_square,
    euclid,
    mean_by_dimension,
    variance_by_dimension,
)
from harbinger.operators.neighbours import BLOCK, list_summary, nearest_lists
from harbinger.operators.trajectory import after_warmup
from harbinger.session import cut_lineage, keep

RANKED = [
    "d1_nearest_centroid",
    "d2_second_centroid",
    "margin_d2_minus_d1",
    "mahal_nearest",
    "knn_mean_k20",
    "knn_std_k20",
    "outlier_proto_mean_dist",
]
RAW = RANKED + ["outlier_score", "has_recent_outliers", "n_recent_outliers"]

# Members a topic needs for its spread to count, and the variance floor.
MIN_SPREAD_MEMBERS = 5
VARIANCE_FLOOR = 1e-8
CENTROID_BLOCK = 64


def _first(df: DataFrame, *names: str) -> str | None:
    return next((n for n in names if n in df.columns), None)


def normalise_results(results: DataFrame) -> DataFrame:
    """Accept the accepted spellings: time, topic and model columns, and coordinates as
    ``umap_dim_*`` or else ``umap_*`` columns (or an array already)."""
    time, topic = _first(results, "snapshot_date", "time_window"), _first(results, "topic_id", "predicted_topic")
    if time is None or topic is None:
        raise ValueError("results need snapshot_date or time_window, and topic_id or predicted_topic")
    if "coords" in results.columns:
        coords = F.col("coords")
    else:
        dims = [c for c in results.columns if c.startswith("umap_dim_")]
        dims = dims or [c for c in results.columns if c.startswith("umap_")]
        if not dims:
            raise ValueError("results need coordinate columns umap_dim_* or umap_*")
        coords = F.array(*[F.col(c).cast("double") for c in dims])
    model = _first(results, "model", "model_name")
    topic_id = topic_number(topic)
    outlier = truthy("is_outlier") if "is_outlier" in results.columns else topic_id == -1
    score = number("outlier_score") if "outlier_score" in results.columns else F.lit(None).cast("double")
    return results.select(
        (F.col(model) if model else F.lit("model")).alias("model"),
        "article_id",
        utc_naive("pub").alias("pub"),
        utc_naive(time).alias("snapshot_date"),
        topic_id.alias("topic_id"),
        outlier.alias("is_outlier"),
        score.alias("outlier_score"),
        coords.alias("coords"),
    )


def publication_rows(results: DataFrame, warmup_days: int = 0) -> DataFrame:
    """The whole row of each article's first snapshot at or after publication."""
    kept = after_warmup(results, warmup_days)
    seen = kept.where(F.col("snapshot_date") >= F.col("pub"))
    rest = [c for c in kept.columns if c not in ("model", "article_id")]
    picked = seen.groupBy("model", "article_id").agg(
        F.min_by(F.struct(*rest), "snapshot_date").alias("r")
    )
    return picked.select("model", "article_id", "r.*")


def snapshot_axis(results: DataFrame) -> DataFrame:
    """Number of each snapshot date within its model.  One row per model and day."""
    days = results.select("model", "snapshot_date").distinct()
    return days.withColumn("at", F.row_number().over(Window.partitionBy("model").orderBy("snapshot_date")))


def history(results: DataFrame, axis: DataFrame) -> DataFrame:
    """For every snapshot number ``at``: the latest row of each article up to then.

    A row holds from its own snapshot to the one before the article's next row.  Where
    every snapshot repeats all earlier articles, each row stands for one snapshot; gaps
    are filled otherwise.  The only window is per article.
    """
    numbered = results.join(F.broadcast(axis), ["model", "snapshot_date"])
    last = axis.groupBy("model").agg(F.max("at").alias("_last"))
    nxt = F.lead("at").over(Window.partitionBy("model", "article_id").orderBy("at"))
    spans = numbered.withColumnRenamed("at", "_own").withColumn("at", F.col("_own"))
    spans = spans.withColumn("_next", nxt).join(F.broadcast(last), "model")
    until = F.coalesce(F.col("_next") - 1, F.col("_last"))
    return spans.withColumn("at", F.explode(F.sequence(F.col("_own"), until))).drop("_own", "_next", "_last")


def validity(rows: DataFrame) -> DataFrame:
    """History rows to points ``since .. until``: runs of snapshots with equal coordinates."""
    w = Window.partitionBy("model", "article_id", "coords").orderBy("at")
    island = F.col("at") - F.row_number().over(w)
    return (
        rows.select("model", "article_id", "coords", "at")
        .withColumn("_island", island)
        .groupBy("model", "article_id", "coords", "_island")
        .agg(F.min("at").alias("since"), F.max("at").alias("until"))
        .drop("_island")
    )


def topic_shapes(hist: DataFrame, dims: int) -> DataFrame:
    """Size, centroid and variance per dimension of every topic at every snapshot.

    Aggregated once per snapshot with map-side partials, not once per article.
    """
    return (
        hist.where(F.col("topic_id") != -1)
        .groupBy("model", "at", "topic_id")
        .agg(
            F.count("*").alias("n"),
            mean_by_dimension("coords", dims).alias("centroid"),
            variance_by_dimension("coords", dims, VARIANCE_FLOOR).alias("variance"),
        )
    )


def centroid_distances(queries: DataFrame, shapes: DataFrame) -> DataFrame:
    """d1, d2, margin and the smallest squared diagonal distance per query.

    The topics of a snapshot are packed in blocks of at most CENTROID_BLOCK on average;
    a query meets blocks, and each meeting gives two distances, so no row is made per
    article and topic.
    """
    counts = shapes.groupBy("model", "at").agg(F.ceil(F.count("*") / CENTROID_BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("topic_id"), F.col("parts")).cast("int")
    packed = (
        shapes.join(counts, ["model", "at"])
        .groupBy("model", "at", part.alias("part"))
        .agg(F.collect_list(F.struct("n", "centroid", "variance")).alias("topics"))
    )
    asked = queries.join(counts, ["model", "at"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    met = asked.join(packed, ["model", "at", "part"])
    x = F.col("coords")
    near = F.slice(F.array_sort(F.transform("topics", lambda t: euclid(x, t.getField("centroid")))), 1, 2)
    wide = F.filter("topics", lambda t: t.getField("n") >= MIN_SPREAD_MEMBERS)
    spread = F.array_min(
        F.transform(wide, lambda t: diagonal_square(x, t.getField("centroid"), t.getField("variance")))
    )
    merged = met.groupBy("model", "article_id", "at").agg(
        F.array_sort(F.flatten(F.collect_list(near))).alias("d"), F.min(spread).alias("mahal_nearest")
    )
    d1, d2 = F.try_element_at("d", F.lit(1)), F.try_element_at("d", F.lit(2))
    return merged.select(
        "model",
        "article_id",
        "at",
        d1.alias("d1_nearest_centroid"),
        d2.alias("d2_second_centroid"),
        (d2 - d1).alias("margin_d2_minus_d1"),
        "mahal_nearest",
    )


def recent_outliers(hist: DataFrame, lookback_days: int) -> DataFrame:
    """History rows that are outliers and not older than the lookback at their ``at``."""
    at_time = F.col("at_time") - F.make_dt_interval(days=F.lit(lookback_days))
    return hist.where(F.col("is_outlier") & (F.col("snapshot_date") >= at_time))


def density(queries: DataFrame, hist: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Mean and deviation of the k smallest distances to the history (itself included)."""
    found = nearest_lists(queries, validity(hist), k, block)
    return list_summary(found).select(
        "model", "article_id", "at", F.col("mean").alias("knn_mean_k20"), F.col("std").alias("knn_std_k20")
    )


def prototype_distance(queries: DataFrame, outliers: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Mean of the k smallest distances to recent outliers."""
    found = nearest_lists(queries, validity(outliers), k, block)
    return list_summary(found).select(
        "model", "article_id", "at", F.col("mean").alias("outlier_proto_mean_dist")
    )


def percentiles(features: DataFrame, names: list[str] | None = None, group: str = "model",
                key: str = "article_id") -> DataFrame:
    """``<name>_pct`` = average rank / (non-null count + 1) within the model; null stays null.

    All features are ranked together in long form, and one aggregation brings them back.
    """
    names = names or RANKED
    items = F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("x")) for n in names])
    long = features.select(group, key, F.explode(items).alias("i")).select(group, key, "i.*")
    ranked = average_rank(long.where(F.col("x").isNotNull()), [group, "f"], "x", "_rank", "_total")
    share = F.col("_rank") / (F.col("_total") + 1)
    back = ranked.groupBy(group, key).agg(
        *[F.max(F.when(F.col("f") == n, share)).alias(f"{n}_pct") for n in names]
    )
    return features.join(back, [group, key], "left")


def geometry_raw(results: DataFrame, dims: int, warmup_days: int = 0, knn_k: int = 20, proto_k: int = 10,
                 lookback_days: int = 1000, block: int = BLOCK) -> DataFrame:
    """The ten raw features per (model, article) at its publication-time snapshot."""
    kept = after_warmup(results, warmup_days)
    axis = snapshot_axis(kept)
    hist = history(kept, axis).join(
        F.broadcast(axis.withColumnRenamed("snapshot_date", "at_time")), ["model", "at"]
    )
    hist = keep(hist)
    ta = publication_rows(kept).join(F.broadcast(axis), ["model", "snapshot_date"])
    queries = ta.select("model", "article_id", "at", "coords")
    outs = recent_outliers(hist, lookback_days)
    counts = outs.groupBy("model", "at").agg(F.count("*").cast("double").alias("n_recent_outliers"))
    keys = ["model", "article_id", "at"]
    parts = [
        centroid_distances(queries, topic_shapes(hist, dims)),
        density(queries, hist, knn_k, block),
        prototype_distance(queries, outs, proto_k, block),
    ]
    base = ta.select(*keys, F.coalesce("outlier_score", F.lit(0.0)).alias("outlier_score"))
    joined = reduce(lambda a, b: a.join(b, keys, "left"), parts, base).join(counts, ["model", "at"], "left")
    n_out = F.coalesce("n_recent_outliers", F.lit(0.0))
    return joined.select(
        "model",
        "article_id",
        F.lit("TA").alias("horizon"),
        *RANKED,
        "outlier_score",
        (n_out > 0).cast("double").alias("has_recent_outliers"),
        n_out.alias("n_recent_outliers"),
    )


def geometry_features(results: DataFrame, dims: int, tie_decimals: int | None = None, **options) -> DataFrame:
    """Raw features and their percentiles.

    ``tie_decimals`` rounds the raw distances before ranking, so that float noise does
    not break ties.
    """
    raw = geometry_raw(results, dims, **options)
    if tie_decimals is not None:
        raw = raw.withColumns({c: F.round(c, tie_decimals) for c in RANKED})
    return percentiles(cut_lineage(raw))


def coordinates(results: DataFrame) -> int:
    """Number of coordinates, read from one row."""
    row = results.select(F.size("coords").alias("n")).first()
    return 0 if row is None else int(row["n"])
