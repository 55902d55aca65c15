"""Reading, checking and cleaning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from harbinger.functions import text as T
from harbinger.functions import urls as U
from harbinger.functions.columns import r6, topic_number, truthy
from harbinger.operators import cleaning, quality
from harbinger.plans import inputs
from harbinger.plans.catalog import register
from harbinger.plans.twins import sql
from harbinger.session import shared_folder
from harbinger.sources import payload, tables

STAMP = "yyyy-MM-dd HH:mm:ss"


@register(
    "typed_table_read",
    "SELECT source, lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY ALL",
)
def typed_table_read(spark, sf_dir):
    doc = tables.read_table(
        spark, f"{sf_dir}/documents.parquet", "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    )
    return doc.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


def _scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register(
    "table_write_and_model_union_read",
    sql(
        """SELECT CAST(model AS VARCHAR) AS model, count(*) AS n_rows,
        count(DISTINCT article_id) AS n_articles FROM snapshots GROUP BY model""",
        "snapshots",
    ),
)
def table_write_and_model_union_read(spark, sf_dir):
    root = _scratch(spark, "results")
    tables.write_table(inputs.snapshots(spark, sf_dir), root, ["model", "snapshot_date"])
    back = tables.read_model_results(spark, root)
    return back.groupBy("model").agg(
        F.count("*").alias("n_rows"), F.count_distinct("article_id").alias("n_articles")
    )


@register(
    "records_export",
    "SELECT kind, doc_id, text FROM documents, (SELECT unnest(['csv', 'jsonl']) AS kind)",
)
def records_export(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = []
    for kind in ["csv", "jsonl"]:
        path = _scratch(spark, "records") + f".{kind}"
        tables.export_records(docs, path)
        back = tables.read_table(spark, path, "doc_id BIGINT, text STRING", multi_line=True)
        parts.append(back.select(F.lit(kind).alias("kind"), "*"))
    return parts[0].unionByName(parts[1])


@register(
    "vectors_by_key",
    sql(
        """SELECT model, v.article_id, round(list_sum(coords), 6) AS total FROM vectors v
        WHERE v.article_id IN (SELECT article_id FROM articles)""",
        "vectors",
        "articles",
    ),
)
def vectors_by_key(spark, sf_dir):
    kept = tables.attach_vectors(inputs.articles(spark, sf_dir), inputs.vectors(spark, sf_dir))
    total = F.aggregate("coords", F.lit(0.0), lambda a, x: a + x)
    return kept.select("model", "article_id", r6(total).alias("total"))


@register(
    "vectors_by_position",
    sql(
        """SELECT e.vec_id AS vector, a.article_id FROM embeddings e JOIN (
          SELECT article_id, row_number() OVER (ORDER BY pub_tod, ingest_pos) - 1 AS position FROM articles) a
        ON a.position = e.vec_id""",
        "articles",
    ),
)
def vectors_by_position(spark, sf_dir):
    emb = inputs.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("vector"), F.col("vec_id").alias("position")
    )
    return tables.vectors_by_position(inputs.articles(spark, sf_dir, True), emb).select("vector", "article_id")


@register(
    "validation_report",
    sql(
        """SELECT 'unparseable_dates' AS "check", 'error' AS severity, count(*) - count(pub) AS n FROM raw_articles
        UNION ALL SELECT 'fewer_than_two_dates', 'warning', CAST(count(DISTINCT pub) < 2 AS BIGINT) FROM raw_articles
        UNION ALL SELECT 'missing_ids', 'error', count(*) - count(article_id) FROM raw_articles
        UNION ALL SELECT 'duplicate_ids', 'warning', count(article_id) - count(DISTINCT article_id) FROM raw_articles
        UNION ALL SELECT 'key_overlap', 'warning', count(DISTINCT article_id) FROM raw_articles
          WHERE article_id IN (SELECT CAST(article_id AS VARCHAR) FROM shares)
        UNION ALL SELECT 'models_without_vectors', 'error', 1""",
        "raw_articles",
        "shares",
    ),
)
def validation_report(spark, sf_dir):
    return quality.validation_report(
        inputs.raw_articles(spark, sf_dir),
        inputs.shares(spark, sf_dir),
        inputs.vectors(spark, sf_dir),
        [str(m) for m in inputs.MODELS] + ["absent"],
    )


@register(
    "article_key_overlap",
    """SELECT 'key_overlap' AS "check", 'warning' AS severity, count(DISTINCT doc_id) AS n FROM documents
    WHERE doc_id IN (SELECT CAST(json_extract(props, '$.k') AS BIGINT) FROM events)""",
)
def article_key_overlap(spark, sf_dir):
    return quality.key_overlap(inputs.articles(spark, sf_dir), inputs.shares(spark, sf_dir))


@register(
    "models_without_vectors",
    sql("SELECT m AS model FROM (SELECT unnest(['0', '3', '7', '9']) AS m) WHERE m NOT IN (SELECT CAST(model AS VARCHAR) FROM vectors)", "vectors"),
)
def models_without_vectors(spark, sf_dir):
    return quality.missing_models(spark, inputs.vectors(spark, sf_dir), ["0", "3", "7", "9"])


@register(
    "keys_in_both_splits",
    """SELECT doc_id AS key, count(*) AS n FROM (
      SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents) GROUP BY doc_id HAVING count(*) > 1""",
)
def keys_in_both_splits(spark, sf_dir):
    left = inputs.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"))
    right = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    return quality.repeated_keys(left, right, "key")


@register(
    "clean_articles",
    sql(
        """SELECT article_id, ingest_pos, strftime(pub, '%Y-%m-%d %H:%M:%S') AS pub,
        strftime(date_trunc('day', pub), '%Y-%m-%d') AS snapshot_date, lang
        FROM raw_articles WHERE article_id IS NOT NULL AND pub IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY ingest_pos) = 1""",
        "raw_articles",
    ),
)
def clean_articles(spark, sf_dir):
    out = cleaning.clean_articles(inputs.raw_articles(spark, sf_dir))
    return out.select(
        "article_id",
        "ingest_pos",
        F.date_format("pub", STAMP).alias("pub"),
        F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"),
        "lang",
    )


@register(
    "article_texts",
    sql("SELECT article_id, md5(trim(title || ' ' || description, ' ' || chr(9) || chr(10) || chr(13))) AS text_md5 FROM articles", "articles"),
)
def article_texts(spark, sf_dir):
    out = cleaning.with_text(inputs.articles(spark, sf_dir))
    return out.select("article_id", F.md5("text").alias("text_md5"))


@register(
    "normalised_urls",
    r"""SELECT page_id, u AS url, substr(sha1(u), 1, 16) AS article_id, d AS domain,
    CASE regexp_extract(d, '[^.]*$') WHEN 'fr' THEN 'France' WHEN 'ca' THEN 'Canada' WHEN 'be' THEN 'Belgium'
      WHEN 'ch' THEN 'Switzerland' WHEN 'ma' THEN 'Morocco' WHEN 'dz' THEN 'Algeria' WHEN 'tn' THEN 'Tunisia'
      WHEN 'sn' THEN 'Senegal' WHEN 'cm' THEN 'Cameroon' WHEN 'ci' THEN 'Ivory Coast' WHEN 'lu' THEN 'Luxembourg'
      WHEN 'ht' THEN 'Haiti' ELSE 'Unknown' END AS country
    FROM (SELECT page_id, u, lower(replace(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1), 'www.', '')) AS d
      FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(
              CASE page_id % 4 WHEN 0 THEN replace(url, '.example.com', '.example.fr')
                               WHEN 1 THEN replace(url, '.example.org', '.example.ca:8080') ELSE url END,
              '#.*$', ''), '([?&])utm_[^=&]*=[^&]*&?', '\1', 'gi'), '[?&]$', '') AS u FROM pages))""",
)
def normalised_urls(spark, sf_dir):
    n = F.col("page_id") % 4
    url = (
        F.when(n == 0, F.replace("url", F.lit(".example.com"), F.lit(".example.fr")))
        .when(n == 1, F.replace("url", F.lit(".example.org"), F.lit(".example.ca:8080")))
        .otherwise(F.col("url"))
    )
    pages = inputs.table(spark, sf_dir, "pages").select("page_id", url.alias("raw"))
    return pages.select(
        "page_id",
        U.normalise_url("raw").alias("url"),
        U.article_key("raw", F.lit("")).alias("article_id"),
        U.domain(U.normalise_url("raw")).alias("domain"),
        U.country(U.normalise_url("raw")).alias("country"),
    )


@register(
    "clean_texts",
    r"""SELECT doc_id, md5(trim(replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), chr(160), ' '),
      ' ' || chr(9) || chr(10) || chr(13) || chr(8195) || chr(8239))) AS dropped_md5,
    md5(trim(regexp_replace(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'),
      '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'))) AS clean_md5 FROM documents""",
)
def clean_texts(spark, sf_dir):
    doc = inputs.table(spark, sf_dir, "documents")
    return doc.select(
        "doc_id", F.md5(T.drop_controls("text")).alias("dropped_md5"), F.md5(T.clean_text("text")).alias("clean_md5")
    )


@register(
    "lead_paragraphs",
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(coalesce(list_filter(
      string_split_regex(replace(text, '. ', '.' || chr(10) || chr(10)), '\n{2,}'),
      lambda b: regexp_matches(b, '[^\s\x0b\x1c-\x1f\x85\p{Z}]'))[1], ''),
      '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'))) AS lead_md5
    FROM documents""",
)
def lead_paragraphs(spark, sf_dir):
    doc = inputs.table(spark, sf_dir, "documents")
    spaced = F.replace("text", F.lit(". "), F.lit(".\n\n"))
    return doc.select("doc_id", F.md5(T.lead_paragraph(spaced)).alias("lead_md5"))


@register(
    "published_days",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 'soon ' || o_orderkey
      ELSE strftime(o_orderdate + to_hours(CASE WHEN o_orderkey % 4 = 2 THEN 22 ELSE 9 END), '%Y-%m-%d') END AS published,
      coalesce(CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END, '') AS cleaned FROM orders""",
)
def published_days(spark, sf_dir):
    """Mail dates, ISO stamps with a zone, plain days and text that is no date."""
    orders = inputs.table(spark, sf_dir, "orders")
    n, at = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("timestamp_ntz")
    mail = F.concat(F.date_format(at, "EEE, dd MMM yyyy"), F.lit(" 09:00:00 GMT"))
    late = F.concat(F.date_format(at + F.make_dt_interval(days=F.lit(1)), "yyyy-MM-dd"), F.lit("T00:30:00+02:00"))
    raw = (
        F.when(n == 0, mail)
        .when(n == 1, F.date_format(at, "yyyy-MM-dd"))
        .when(n == 2, late)
        .otherwise(F.concat(F.lit("soon "), "o_orderkey"))
    )
    out = orders.select("o_orderkey", T.published_day(raw).alias("published"), (n < 2).alias("_plain"))
    dated = cleaning.with_clean_date(out.withColumn("publication_date", F.when(F.col("_plain"), F.col("published"))))
    return dated.select(
        "o_orderkey", "published", F.coalesce("publication_date_cleaned", F.lit("")).alias("cleaned")
    )


RECORD_COLUMNS = """article_id, query, collection_day, publication_date, title, md5(lead_paragraph) AS lead_paragraph,
    description, md5(embedding_text) AS embedding_text, media_url, source, domain,
    'Unknown' AS country_inferred_from_tld, md5(body_text) AS body_text, title AS gnews_raw_title,
    raw_published AS gnews_raw_published_date"""


def _hashed(records):
    return records.withColumns({c: F.md5(c) for c in ["lead_paragraph", "embedding_text", "body_text"]})


@register("shaped_records", sql(f"SELECT {RECORD_COLUMNS} FROM records", "records"))
def shaped_records(spark, sf_dir):
    return _hashed(cleaning.shape_records(inputs.news_items(spark, sf_dir)))


@register(
    "richest_records",
    sql(
        f"""SELECT {RECORD_COLUMNS}, publication_date AS publication_date_cleaned FROM records
        QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY (lead_paragraph <> '') DESC,
          (body_text <> '') DESC, collection_day, media_url, title) = 1""",
        "records",
    ),
)
def richest_records(spark, sf_dir):
    records = cleaning.shape_records(inputs.news_items(spark, sf_dir))
    return _hashed(cleaning.finish_records(records))


@register(
    "publisher_and_url_choice",
    sql("SELECT page_id, source, media_url FROM records", "records"),
)
def publisher_and_url_choice(spark, sf_dir):
    items = inputs.news_items(spark, sf_dir)
    return items.select(
        "page_id",
        cleaning.publisher_name("item").alias("source"),
        U.normalise_url(cleaning.result_url("item")).alias("media_url"),
    )


@register(
    "day_spine",
    """SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(
      (SELECT min(CAST(ts AS DATE)) FROM events)::TIMESTAMP,
      (SELECT max(CAST(ts AS DATE)) FROM events)::TIMESTAMP, INTERVAL 1 DAY)) AS d)""",
)
def day_spine(spark, sf_dir):
    spine = cleaning.spine_of(inputs.table(spark, sf_dir, "events"), "ts")
    return spine.select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@register(
    "prepared_shares",
    """SELECT article_id, author_id, count(*) AS n, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_at,
      round(sum(followers_count), 6) AS followers FROM (
      SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS article_id,
        CASE WHEN event_id % 20 = 0 THEN 'nan' ELSE CAST(user_id AS VARCHAR) END AS author_id,
        CAST(ts AS TIMESTAMP) AS created_at, value AS followers_count FROM events) GROUP BY ALL""",
)
def prepared_shares(spark, sf_dir):
    ev = inputs.table(spark, sf_dir, "events")
    raw = ev.select(
        F.get_json_object("props", "$.k").cast("bigint").alias("media_url"),
        F.when(F.col("event_id") % 20 != 0, F.col("user_id")).alias("user_id"),
        F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"),
        F.col("value").alias("user_public_metrics_followers_count"),
    )
    ready = cleaning.prepare_shares(raw)
    return ready.groupBy("article_id", "author_id").agg(
        F.count("*").alias("n"),
        F.date_format(F.min("created_at"), STAMP).alias("first_at"),
        r6(F.sum("followers_count")).alias("followers"),
    )


@register(
    "flag_and_topic_coercion",
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN CAST(trunc(value) AS INT) ELSE -1 END AS topic_id,
      event_type = 'view' OR event_id % 3 = 1 AS is_outlier FROM events""",
)
def flag_and_topic_coercion(spark, sf_dir):
    ev = inputs.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    topic = F.when(kind.isin("view", "click"), F.col("value").cast("string")).otherwise(kind)
    flag = F.when(kind == "view", F.lit("Yes")).otherwise((F.col("event_id") % 3).cast("string"))
    return ev.select("event_id", topic_number(topic).alias("topic_id"), truthy(flag).alias("is_outlier"))


@register(
    "enriched_posts",
    sql(
        """SELECT p.event_id AS id, CASE WHEN has_user THEN 'user ' || user_id ELSE '' END AS user_name,
        array_to_string(list_filter(['m' || (event_id % 7), 'm' || (event_id % 13)],
          lambda k: CAST(substr(k, 2) AS INT) < 10), ' ') AS media,
        CASE WHEN event_id % 5 < 4 THEN 'Place ' || (event_id % 5) ELSE '' END AS place,
        coalesce(r.ref, '') AS referenced
        FROM posts p LEFT JOIN (SELECT page_id AS pg, event_id AS e,
          event_id || ':' || CASE WHEN has_user THEN 'user ' || user_id ELSE '' END AS ref FROM posts
          WHERE event_id % 2 = 0) r ON r.pg = p.page_id AND r.e = p.event_id - 1""",
        "posts",
    ),
)
def enriched_posts(spark, sf_dir):
    posts = payload.enrich_posts(payload.parse_pages(inputs.payload_pages(spark, sf_dir)))
    return posts.select(
        F.col("id").cast("bigint").alias("id"),
        F.coalesce("user.name", F.lit("")).alias("user_name"),
        F.array_join(F.transform("media", lambda m: m.getField("media_key")), " ").alias("media"),
        F.coalesce("place.full_name", F.lit("")).alias("place"),
        F.array_join(
            F.transform(
                "referenced_full",
                lambda r: F.concat(
                    r.getField("post").getField("id"),
                    F.lit(":"),
                    F.coalesce(r.getField("user").getField("name"), F.lit("")),
                ),
            ),
            " ",
        ).alias("referenced"),
    )


@register(
    "flattened_posts",
    sql(
        """SELECT event_id AS id, user_id AS author_id, CASE WHEN has_user THEN user_id * 10 ELSE -1 END::DOUBLE
          AS user_public_metrics_followers_count, 'p' || (event_id % 5) AS geo_place_id,
        strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM posts""",
        "posts",
    ),
)
def flattened_posts(spark, sf_dir):
    """Pages are written as JSON lines, read back with their schema, enriched, flattened."""
    path = _scratch(spark, "pages")
    inputs.payload_pages(spark, sf_dir).select("body").write.text(path)
    flat = payload.flatten(payload.enrich_posts(payload.read_pages(spark, path, one_per_file=False)))
    return flat.select(
        F.col("id").cast("bigint").alias("id"),
        F.col("author_id").cast("bigint").alias("author_id"),
        F.coalesce("user_public_metrics_followers_count", F.lit(-1.0)).alias("user_public_metrics_followers_count"),
        "geo_place_id",
        "created_at",
    )
