"""Cleaning of articles, share records and collected news items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harbinger.functions.columns import text_or_empty, utc_naive
from harbinger.functions.keyed import first_per_key
from harbinger.functions.text import clean_text, drop_controls, fill_template, lead_paragraph, published_day
from harbinger.functions.urls import article_key, country, domain, normalise_url


def clean_articles(raw: DataFrame, frequency: str = "day", position: str = "ingest_pos") -> DataFrame:
    """Times in naive UTC, rows without id or time dropped, the first row per id kept,
    and the snapshot date.

    "First" is by the ``position`` column, since a distributed table has no file order.
    No sort: consumers that need time order ask for it.
    """
    timed = raw.withColumn("pub", utc_naive("pub")).dropna(subset=["article_id", "pub"])
    first = first_per_key(timed, ["article_id"], [F.col(position)])
    return first.withColumn("snapshot_date", F.date_trunc(frequency, "pub").cast("timestamp_ntz"))


def with_text(articles: DataFrame, template: str = "{title} {description}", out: str = "text") -> DataFrame:
    return articles.withColumn(out, fill_template(template, {c: c for c in articles.columns}))


def choose(item: str, *paths: str) -> Column:
    """First non-empty text among JSON paths; a path that leads to an object counts as absent."""
    parsed = F.try_parse_json(item)
    found = [
        F.nullif(F.try_variant_get(parsed, path, "string"), F.lit(""))
        for path in paths
    ]
    return F.coalesce(*found, F.lit(""))


def publisher_name(item: str) -> Column:
    return clean_text(choose(item, "$.publisher.title", "$.publisher.name", "$.publisher"))


def result_url(item: str) -> Column:
    return clean_text(choose(item, "$.url", "$.link"))


def published_text(item: str) -> Column:
    return choose(item, '$["published date"]', "$.published_date")


def shape_records(items: DataFrame) -> DataFrame:
    """The 15 collected columns from ``item`` (JSON text), ``query``, ``collection_day``,
    ``full_title`` and ``full_text`` (null where the page was not fetched).

    One projection.  The lead is the description where the page gives none; the
    publication date is the collection day where the item gives none.
    """
    body = clean_text("full_text")
    item_title = clean_text(choose("item", "$.title"))
    staged = items.select(
        "*",
        normalise_url(result_url("item")).alias("media_url"),
        clean_text(choose("item", "$.description")).alias("description"),
        F.coalesce(F.nullif(item_title, F.lit("")), clean_text("full_title")).alias("title"),
        item_title.alias("gnews_raw_title"),
        clean_text(choose("item", '$["published date"]')).alias("gnews_raw_published_date"),
        published_day(published_text("item")).alias("_published"),
        publisher_name("item").alias("source"),
        body.alias("body_text"),
    )
    # the body is cleaned before its lead is taken, so the lead is the whole cleaned body
    led = staged.withColumn(
        "lead_paragraph", F.coalesce(F.nullif(lead_paragraph("body_text"), F.lit("")), F.col("description"))
    )
    day = F.col("collection_day").cast("string")
    return led.select(
        article_key("media_url", "title").alias("article_id"),
        "query",
        day.alias("collection_day"),
        F.coalesce(F.nullif("_published", F.lit("")), day).alias("publication_date"),
        "title",
        "lead_paragraph",
        "description",
        clean_text(F.btrim(F.concat("title", F.lit(". "), "lead_paragraph"), F.lit(". "))).alias("embedding_text"),
        "media_url",
        "source",
        domain("media_url").alias("domain"),
        country("media_url").alias("country_inferred_from_tld"),
        "body_text",
        "gnews_raw_title",
        "gnews_raw_published_date",
    )


def richest_per_id(records: DataFrame, tie: list[Column] | None = None) -> DataFrame:
    """One record per id: with a lead before without, then with a body before without."""
    has_lead = F.length(text_or_empty("lead_paragraph")) > 0
    has_body = F.length(text_or_empty("body_text")) > 0
    ties = tie or [F.col("collection_day"), F.col("media_url"), F.col("title")]
    return first_per_key(records, ["article_id"], [~has_lead, ~has_body, *ties])


def with_clean_date(records: DataFrame) -> DataFrame:
    day = F.col("publication_date").try_cast("date")
    return records.withColumn("publication_date_cleaned", F.date_format(day, "yyyy-MM-dd"))


def finish_records(records: DataFrame) -> DataFrame:
    """Controls out of every text column, one record per id, cleaned date."""
    texts = {n: drop_controls(n) for n, t in records.dtypes if t == "string"}
    return with_clean_date(richest_per_id(records.withColumns(texts)))


def day_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day, both ends included; an end before the start is an error."""
    if end < start:
        raise ValueError("end must be on or after start")
    bounds = spark.range(1).select(F.lit(start).cast("date").alias("s"), F.lit(end).cast("date").alias("e"))
    return bounds.select(F.explode(F.sequence("s", "e")).alias("day"))


def spine_of(df: DataFrame, column: str) -> DataFrame:
    """Days between the smallest and largest date of a column; empty input gives no day."""
    bounds = df.agg(F.min(F.to_date(column)).alias("s"), F.max(F.to_date(column)).alias("e"))
    return bounds.where(F.col("s") <= F.col("e")).select(F.explode(F.sequence("s", "e")).alias("day"))


def first_column(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c and c in df.columns), None)


UNKNOWN_AUTHOR = "nan"


def prepare_shares(shares: DataFrame, url_col: str = "url", id_col: str = "article_id",
                   date_col: str = "", unknown_author: str = "keep") -> DataFrame | None:
    """Share table with the columns the social features read, or None without id or time.

    A missing author becomes one pseudo user, as text conversion does;
    ``unknown_author='drop'`` leaves such shares without a user instead.
    """
    key = first_column(shares, ["media_url", url_col, id_col, "article_url", "url"])
    when = first_column(shares, ["created_at", "publication_date_cleaned", date_col])
    if key is None or when is None:
        return None
    author = first_column(shares, ["author_id", "user_id"])
    cols = [F.col(key).alias("article_id"), utc_naive(when).alias("created_at")]
    if author is not None:
        name = F.col(author).cast("string")
        if unknown_author == "keep":
            name = F.coalesce(name, F.lit(UNKNOWN_AUTHOR))
        cols.append(name.alias("author_id"))
    for metric in ["followers_count", "tweet_count", "listed_count"]:
        found = first_column(shares, [metric, f"user_public_metrics_{metric}"])
        if found is not None:
            cols.append(F.col(found).cast("string").try_cast("double").alias(metric))
    return shares.select(*cols)
