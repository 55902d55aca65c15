"""Geometry at publication time."""

from __future__ import annotations

from pyspark.sql import functions as F

from harbinger.functions.columns import r6
from harbinger.operators import geometry as G
from harbinger.operators.trajectory import after_warmup
from harbinger.plans import inputs
from harbinger.plans.catalog import register
from harbinger.plans.twins import RANKED, sql

WARMUP = 5
DIMS = inputs.WIDTH


def results(spark, sf_dir):
    return inputs.snapshots(spark, sf_dir, with_coords=True)


def staged(spark, sf_dir):
    """History rows with the time of their snapshot, and the queries."""
    kept = after_warmup(results(spark, sf_dir), WARMUP)
    axis = G.snapshot_axis(kept)
    hist = G.history(kept, axis).join(F.broadcast(axis.withColumnRenamed("snapshot_date", "at_time")), ["model", "at"])
    asked = G.publication_rows(kept).join(F.broadcast(axis), ["model", "snapshot_date"])
    return hist, asked.select("model", "article_id", "at", "coords"), axis


def shown(df, names):
    return df.select("model", "article_id", *[r6(c).alias(c) for c in names])


@register(
    "normalised_results",
    """SELECT vec_id AS article_id, 'model' AS model, CASE WHEN label % 3 = 0 THEN -1 ELSE label END AS topic_id,
    label % 2 = 0 AS is_outlier, round(embedding[1]::DOUBLE, 6) AS x0, round(embedding[2]::DOUBLE, 6) AS x1,
    '2024-02-0' || (1 + label % 9) AS day FROM embeddings""",
)
def normalised_results(spark, sf_dir):
    emb = inputs.table(spark, sf_dir, "embeddings")
    raw = emb.select(
        F.col("vec_id").alias("article_id"),
        F.lit("2024-02-01").alias("pub"),
        F.concat(F.lit("2024-02-0"), 1 + F.col("label") % 9).alias("time_window"),
        F.when(F.col("label") % 3 == 0, F.lit("none")).otherwise(F.col("label").cast("string")).alias("predicted_topic"),
        F.when(F.col("label") % 2 == 0, F.lit("TRUE")).otherwise(F.lit("no")).alias("is_outlier"),
        F.col("embedding")[0].alias("umap_dim_0"),
        F.col("embedding")[1].alias("umap_dim_1"),
        F.lit(9.0).alias("umap_7"),
    )
    out = G.normalise_results(raw)
    return out.select(
        "article_id",
        "model",
        "topic_id",
        "is_outlier",
        r6(F.col("coords")[0]).alias("x0"),
        r6(F.col("coords")[1]).alias("x1"),
        F.date_format("snapshot_date", "yyyy-MM-dd").alias("day"),
    )


@register(
    "history_as_of",
    sql(
        """SELECT model, strftime(d, '%Y-%m-%d') AS at_time, count(*) AS n_articles, count_if(is_outlier)::BIGINT AS n_outliers,
        CAST(sum(topic_id) AS BIGINT) AS topic_sum FROM (
          SELECT s.*, t.d FROM snapshots s JOIN (SELECT DISTINCT snapshot_date AS d FROM snapshots) t ON s.snapshot_date <= t.d
          WHERE (s.article_id + dayofyear(s.snapshot_date) + s.model) % 3 <> 0
          QUALIFY row_number() OVER (PARTITION BY s.model, s.article_id, t.d ORDER BY s.snapshot_date DESC) = 1)
        GROUP BY model, d""",
        "snapshots",
    ),
)
def history_as_of(spark, sf_dir):
    """On a table with gaps: two of three snapshots of each article are there."""
    snaps = inputs.snapshots(spark, sf_dir)
    gaps = (F.col("article_id") + F.dayofyear("snapshot_date") + F.col("model")) % 3 != 0
    axis = G.snapshot_axis(snaps)
    hist = G.history(snaps.where(gaps), axis)
    named = hist.drop("snapshot_date").join(F.broadcast(axis), ["model", "at"])
    return named.groupBy("model", F.date_format("snapshot_date", "yyyy-MM-dd").alias("at_time")).agg(
        F.count("*").alias("n_articles"),
        F.count_if("is_outlier").alias("n_outliers"),
        F.sum("topic_id").alias("topic_sum"),
    )


@register(
    "topic_shapes",
    sql(
        """SELECT model, strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, topic_id, n,
        round(list_sum(centroid), 6) AS centroid_sum, round(list_sum(variance), 6) AS variance_sum FROM shapes""",
        "shapes",
    ),
)
def topic_shapes(spark, sf_dir):
    hist, _, axis = staged(spark, sf_dir)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    named = G.topic_shapes(hist, DIMS).join(F.broadcast(axis), ["model", "at"])
    return named.select(
        "model",
        F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"),
        "topic_id",
        "n",
        r6(total("centroid")).alias("centroid_sum"),
        r6(total("variance")).alias("variance_sum"),
    )


@register(
    "centroid_distances",
    sql(
        """SELECT model, article_id, round(d1, 6) AS d1_nearest_centroid, round(d2, 6) AS d2_second_centroid,
        round(d2 - d1, 6) AS margin_d2_minus_d1, round(mahal, 6) AS mahal_nearest FROM to_centroids""",
        "to_centroids",
    ),
)
def centroid_distances(spark, sf_dir):
    hist, asked, _ = staged(spark, sf_dir)
    out = G.centroid_distances(asked, G.topic_shapes(hist, DIMS))
    return shown(out, ["d1_nearest_centroid", "d2_second_centroid", "margin_d2_minus_d1", "mahal_nearest"])


@register(
    "knn_density",
    sql(
        "SELECT model, article_id, round(knn_mean, 6) AS knn_mean_k20, round(knn_std, 6) AS knn_std_k20 FROM knn",
        "knn",
    ),
)
def knn_density(spark, sf_dir):
    hist, asked, _ = staged(spark, sf_dir)
    return shown(G.density(asked, hist, 20), ["knn_mean_k20", "knn_std_k20"])


@register(
    "outlier_prototypes",
    sql("SELECT model, article_id, round(proto, 6) AS outlier_proto_mean_dist FROM proto", "proto"),
)
def outlier_prototypes(spark, sf_dir):
    hist, asked, _ = staged(spark, sf_dir)
    return shown(G.prototype_distance(asked, G.recent_outliers(hist, 1000), 10), ["outlier_proto_mean_dist"])


@register(
    "recent_outlier_counts",
    sql(
        """SELECT model, strftime(d, '%Y-%m-%d') AS at_time, count(*) AS n_recent_outliers FROM (
          SELECT s.*, t.d FROM snapshots s JOIN (SELECT DISTINCT snapshot_date AS d FROM snapshots) t ON s.snapshot_date <= t.d
          WHERE (s.article_id + dayofyear(s.snapshot_date) * 3 + s.model) % 5 <> 0
          QUALIFY row_number() OVER (PARTITION BY s.model, s.article_id, t.d ORDER BY s.snapshot_date DESC) = 1)
        WHERE is_outlier AND snapshot_date >= d - 1 GROUP BY model, d""",
        "snapshots",
    ),
)
def recent_outlier_counts(spark, sf_dir):
    """With gaps in the table, so that the one-day lookback matters."""
    snaps = inputs.snapshots(spark, sf_dir)
    gaps = (F.col("article_id") + F.dayofyear("snapshot_date") * 3 + F.col("model")) % 5 != 0
    axis = G.snapshot_axis(snaps)
    hist = G.history(snaps.where(gaps), axis).join(
        F.broadcast(axis.withColumnRenamed("snapshot_date", "at_time")), ["model", "at"]
    )
    return (
        G.recent_outliers(hist, 1)
        .groupBy("model", F.date_format("at_time", "yyyy-MM-dd").alias("at_time"))
        .agg(F.count("*").alias("n_recent_outliers"))
    )


@register(
    "model_percentiles",
    """SELECT source AS model, doc_id AS article_id, round((rank() OVER (PARTITION BY source ORDER BY x)
      + (count(*) OVER (PARTITION BY source, x) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY source) + 1), 6) AS x_pct
    FROM (SELECT *, (n_chars // 100)::DOUBLE AS x FROM documents)""",
)
def model_percentiles(spark, sf_dir):
    """Average ranks with many ties: documents by length in hundreds of characters."""
    doc = inputs.table(spark, sf_dir, "documents").select(
        F.col("source").alias("model"),
        F.col("doc_id").alias("article_id"),
        F.floor(F.col("n_chars") / 100).cast("double").alias("x"),
    )
    return shown(G.percentiles(doc, ["x"]), ["x_pct"])


PCT = [f"{c}_pct" for c in RANKED]


@register(
    "geometry_features",
    sql(
        "SELECT model, article_id, "
        + ", ".join(f"{c}" for c in RANKED)
        + ", geo.outlier_score, geo.has_recent_outliers, geo.n_recent_outliers, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in PCT)
        + " FROM geo JOIN geo_pct USING (model, article_id)",
        "geo",
        "geo_pct",
    ),
)
def geometry_features(spark, sf_dir):
    out = G.geometry_features(results(spark, sf_dir), DIMS, tie_decimals=6, warmup_days=WARMUP)
    return shown(out, G.RAW + PCT)
