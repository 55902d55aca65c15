"""Pipeline inputs derived from the given tables.

Each function has a DuckDB twin of the same name in ``harbinger.plans.twins``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harbinger.sources.tables import spread

MODELS = [0, 1, 2, 3]
WIDTH = 16
EPOCH = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(n) -> F.Column:
    return F.make_dt_interval(days=n.cast("int"))


def articles(spark: SparkSession, sf_dir: str, time_of_day: bool = False) -> DataFrame:
    doc = spread(table(spark, sf_dir, "documents"))
    pub = F.lit(EPOCH).cast("timestamp_ntz") + _days(F.col("doc_id") % 30)
    if time_of_day:
        pub = pub + F.make_dt_interval(hours=(F.col("doc_id") % 5 * 3).cast("int"))
    title = F.substring_index("text", "\n", 1)
    return doc.select(
        F.col("doc_id").alias("article_id"),
        F.col("doc_id").alias("ingest_pos"),
        pub.alias("pub"),
        title.alias("title"),
        F.expr("substr(text, length(substring_index(text, '\\n', 1)) + 2)").alias("description"),
    )


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.get_json_object("props", "$.k").cast("bigint").alias("article_id"),
        F.col("user_id").cast("string").alias("author_id"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
        F.col("value").alias("followers_count"),
        (F.col("event_id") % 1000).cast("double").alias("tweet_count"),
        (F.col("event_id") % 17).cast("double").alias("listed_count"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four views of the vectors: sixteen dimensions per model."""
    emb = table(spark, sf_dir, "embeddings")
    views = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.slice("embedding", m * WIDTH + 1, WIDTH).cast("array<double>").alias("coords"),
            )
            for m in MODELS
        ]
    )
    return emb.select(F.col("vec_id").alias("article_id"), F.explode(views).alias("v")).select(
        "v.model", "article_id", "v.coords"
    )


def snapshots(spark: SparkSession, sf_dir: str, with_coords: bool = False) -> DataFrame:
    """Snapshot table by an integer rule: 30 days, four models, every topic with a birthday."""
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), "label")
    start = F.lit(EPOCH).cast("date")
    pub_day = (F.col("article_id") % 30).cast("int")
    grown = (
        emb.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
        .withColumn("day", F.explode(F.sequence(pub_day, F.lit(29))))
        .withColumn("pub", F.date_add(start, pub_day))
    )
    m, a, label, day = F.col("model"), F.col("article_id"), F.col("label"), F.col("day")
    born = (label * 3 + m * 2) % 25
    wait = pub_day + (a * 11 + m * 5) % 12
    topic = (
        F.when(day < born, -1)
        .when(((a * 7 + m * 13) % 10 < 6) & (day < wait), -1)
        .otherwise(label)
        .cast("int")
    )
    out = grown.select(
        "model",
        "article_id",
        "pub",
        F.date_add(start, day).alias("snapshot_date"),
        topic.alias("cluster_id"),
        topic.alias("topic_id"),
        (topic == -1).alias("is_outlier"),
        (((a * 37 + m * 11) % 100) / F.lit(100.0)).alias("outlier_score"),
    )
    if with_coords:
        out = out.join(vectors(spark, sf_dir), ["model", "article_id"])
    return out


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untidy article rows: every id twice, some ids missing, dates as text in three
    spellings and some that are no dates."""
    doc = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    naive = F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(
        days=(n % 30).cast("int"), hours=(n % 5 * 3).cast("int")
    )
    plain = F.date_format(naive, "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(n % 7 == 3, F.lit("unknown"))
        .when(n % 3 == 0, F.concat(plain, F.lit("Z")))
        .when(n % 3 == 1, F.concat(plain, F.lit("+02:00")))
        .otherwise(plain)
    )
    return doc.select(
        F.when(n % 11 != 0, (n / 2).cast("bigint").cast("string")).alias("article_id"),
        n.alias("ingest_pos"),
        text.alias("pub"),
        "lang",
    )


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected items as JSON text in the three publisher spellings, with page bodies."""
    pages = spread(table(spark, sf_dir, "pages"))
    n = F.col("page_id")
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    at = F.lit("2025-04-02T07:00:00").cast("timestamp_ntz") + _days(n % 54)
    mail = F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    item = (
        F.when(
            n % 3 == 0,
            F.to_json(
                F.struct(
                    title.alias("title"),
                    F.struct(F.concat(F.lit("Paper "), n % 9).alias("title")).alias("publisher"),
                    F.col("url"),
                    mail.alias("published date"),
                )
            ),
        )
        .when(
            n % 3 == 1,
            F.to_json(
                F.struct(
                    title.alias("title"),
                    F.struct(F.concat(F.lit("Herald "), n % 9).alias("name")).alias("publisher"),
                    F.col("url").alias("link"),
                    F.date_format(at, "yyyy-MM-dd").alias("published_date"),
                )
            ),
        )
        .otherwise(
            F.to_json(
                F.struct(
                    title.alias("title"),
                    F.concat(F.lit("Gazette "), n % 9).alias("publisher"),
                    F.concat(F.lit("about "), n).alias("description"),
                    F.col("url"),
                )
            )
        )
    )
    return pages.select(
        "page_id",
        item.alias("item"),
        F.lit("changement climatique").alias("query"),
        F.date_format(at, "yyyy-MM-dd").alias("collection_day"),
        F.lit(None).cast("string").alias("full_title"),
        F.when(n % 5 != 0, F.col("html")).alias("full_text"),
    )


def payload_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of up to 100 posts as JSON text, with side lists that miss some entries."""
    ev = table(spark, sf_dir, "events")
    n, u = F.col("event_id"), F.col("user_id")
    post = F.struct(
        n.cast("string").alias("id"),
        u.cast("string").alias("author_id"),
        F.col("event_type").alias("text"),
        F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.struct(
            F.array(F.concat(F.lit("m"), n % 7), F.concat(F.lit("m"), n % 13)).alias("media_keys")
        ).alias("attachments"),
        F.struct(F.concat(F.lit("p"), n % 5).alias("place_id")).alias("geo"),
        F.array(
            F.struct((n - 1).cast("string").alias("id"), F.lit("quoted").alias("type"))
        ).alias("referenced_tweets"),
    )
    user = F.struct(
        u.cast("string").alias("id"),
        F.concat(F.lit("user "), u).alias("name"),
        F.struct(
            (u * 10).cast("double").alias("followers_count"),
            (u * 3).cast("double").alias("tweet_count"),
            (u % 4).cast("double").alias("listed_count"),
        ).alias("public_metrics"),
    )
    grouped = ev.groupBy(F.floor(n / 100).alias("page_id")).agg(
        F.collect_list(post).alias("data"),
        F.array_distinct(F.collect_list(F.when(u % 10 != 9, user))).alias("users"),
        F.collect_list(F.when(n % 2 == 0, post)).alias("tweets"),
    )
    media = F.array(*[F.struct(F.lit(f"m{i}").alias("media_key"), F.lit("photo").alias("type")) for i in range(10)])
    places = F.array(*[F.struct(F.lit(f"p{i}").alias("id"), F.lit(f"Place {i}").alias("full_name")) for i in range(4)])
    body = F.to_json(
        F.struct(
            "data",
            F.struct("users", media.alias("media"), places.alias("places"), "tweets").alias("includes"),
            F.struct(F.col("page_id").cast("string").alias("next_token")).alias("meta"),
        )
    )
    return grouped.select("page_id", body.alias("body"))


# A dozen words of the documents with made-up scores, and phrases with entity labels.
LEXICON = [
    ("the", 0.1, 0.2), ("with", 0.3, -0.4), ("that", 0.5, 0.6), ("les", 0.2, -0.1), ("avec", 0.9, 1.2),
    ("une", 0.4, -0.8), ("und", 0.7, 0.5), ("für", 0.6, -1.5), ("que", 0.8, 0.3), ("été", 1.0, 1.9),
    ("the_other", 0.3, 0.3), ("pour", 0.15, -0.25),
]
GAZETTEER = [
    ("of the", "ORG"), ("the", "LOC"), ("in", "GPE"), ("with that", "PER"), ("is", "PERSON"),
    ("les", "LOC"), ("avec", "ORG"), ("on the and", "MISC"), ("pour", "EVENT"), ("und", "PER"),
]


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "token STRING, subjectivity DOUBLE, valence DOUBLE")


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GAZETTEER, "phrase STRING, label STRING")


SETTINGS = ["all_features", "no_geom", "no_social", "no_text", "only_geom", "only_social", "only_text"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in scores of seven settings on the labelled documents in five folds."""
    lab = table(spark, sf_dir, "labels")
    items = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("ablation")) for i, n in enumerate(SETTINGS)])
    spread = lab.select("doc_id", F.col("quality").cast("double").alias("label_TOA"), F.explode(items).alias("s"))
    value = (F.col("doc_id") * 53 + F.col("s.i") * (F.col("doc_id") % 5 + 2) * 7) % 100
    return spread.select(
        "doc_id", "s.ablation", (F.col("doc_id") % 5 + 1).cast("int").alias("fold"), "label_TOA",
        (value / F.lit(100.0)).alias("score"),
    )


def document_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature matrix over the labelled documents: quality as label at k = 1, toxicity at k = 2."""
    from harbinger.functions.text import text_measures

    doc = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    goals = F.array(
        F.struct(F.lit(1).alias("agreement_k"), F.col("quality").cast("double").alias("label_TOA")),
        F.struct(F.lit(2).alias("agreement_k"), F.col("toxic").cast("double").alias("label_TOA")),
    )
    cols = text_measures("text")
    return doc.select(
        F.col("doc_id").cast("string").alias("article_url"),
        F.explode(goals).alias("g"),
        *[c.alias(n) for n, c in cols.items()],
        (F.col("n_chars") % 7).cast("double").alias("soc_unique_users"),
        ((F.col("doc_id") * 37 % 100) / F.lit(100.0)).alias("outlier_score_mean"),
    ).select("article_url", "g.*", *cols, "soc_unique_users", "outlier_score_mean")


def dated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward-chaining input: labelled documents with a publication-time date in ten weeks."""
    doc = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    from harbinger.functions.text import text_measures

    cols = text_measures("text")
    return doc.select(
        F.col("doc_id").alias("media_url"),
        (F.lit(EPOCH).cast("timestamp_ntz") + _days(F.col("doc_id") * 13 % 70)).alias("TA"),
        F.col("quality").cast("int").alias("y"),
        F.col("lang").alias("true_subclass"),
        *[c.alias(n) for n, c in cols.items()],
    )


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in attributions of three features of the labelled documents."""
    doc = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("doc_id")
    items = F.array(
        *[
            F.struct(F.lit(name).alias("feature"), value.cast("double").alias("v"), F.lit(w).alias("w"))
            for name, value, w in [("n_chars", F.col("n_chars"), 29), ("id_mod", n % 10, 31), ("constant", F.lit(1), 37)]
        ]
    )
    rows = doc.select("doc_id", "quality", F.explode(items).alias("i"))
    return rows.select(
        n.cast("string").alias("article_url"),
        "i.feature",
        F.col("i.v").alias("feature_value"),
        (((n * F.col("i.w") + 11) % 97 - 48) / F.lit(100.0)).alias("shap_value"),
        F.col("quality").alias("y"),
        (n * 53 % 100 / F.lit(100.0)).alias("pred_proba"),
    )
