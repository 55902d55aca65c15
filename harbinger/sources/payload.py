"""Share records as they come from the share API: pages of nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

USER = (
    "STRUCT<id: STRING, name: STRING, "
    "public_metrics: STRUCT<followers_count: DOUBLE, tweet_count: DOUBLE, listed_count: DOUBLE>>"
)
POST = (
    "STRUCT<id: STRING, author_id: STRING, text: STRING, created_at: STRING, "
    "attachments: STRUCT<media_keys: ARRAY<STRING>>, geo: STRUCT<place_id: STRING>, "
    "referenced_tweets: ARRAY<STRUCT<id: STRING, type: STRING>>>"
)
PAGE_SCHEMA = (
    f"data ARRAY<{POST}>, "
    f"includes STRUCT<users: ARRAY<{USER}>, "
    "media: ARRAY<STRUCT<media_key: STRING, type: STRING>>, "
    "places: ARRAY<STRUCT<id: STRING, full_name: STRING>>, "
    f"tweets: ARRAY<{POST}>>, meta STRUCT<next_token: STRING>"
)


def read_pages(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """One row per landed page: a JSON document per file, or per line."""
    pages = spark.read.schema(PAGE_SCHEMA).option("multiLine", one_per_file).json(path)
    return pages.withColumn("page_id", F.input_file_name())


def parse_pages(raw: DataFrame, body: str = "body") -> DataFrame:
    """Pages that lie as text in a column (one JSON document per row)."""
    parsed = raw.withColumn("_p", F.from_json(body, PAGE_SCHEMA)).drop(body)
    return parsed.select(*[c for c in parsed.columns if c != "_p"], "_p.*")


def enrich_posts(pages: DataFrame) -> DataFrame:
    """Posts with author, media, place and referenced posts looked up on their own page.

    A page is one API answer (at most 100 posts), so the side lists are small arrays and
    the lookups stay inside the row: no join and no shuffle.  A missing author or place
    is null; missing media and referenced posts are left out.
    """
    users = F.col("includes.users")
    media = F.col("includes.media")
    places = F.col("includes.places")
    tweets = F.col("includes.tweets")

    def find(items: Column, field: str, key: Column) -> Column:
        hit = F.filter(items, lambda it: it.getField(field) == key)
        return F.try_element_at(hit, F.lit(-1))

    def listed(keys: Column, items: Column, field: str) -> Column:
        found = F.transform(keys, lambda k: find(items, field, k))
        return F.filter(found, lambda it: it.isNotNull())

    names = pages.schema["data"].dataType.elementType.names

    def enriched(post: Column) -> Column:
        keys = post.getField("attachments").getField("media_keys")
        refs = listed(F.transform(post.getField("referenced_tweets"), lambda r: r.getField("id")), tweets, "id")
        return F.struct(
            *[post.getField(n).alias(n) for n in names],
            find(users, "id", post.getField("author_id")).alias("user"),
            F.when(F.size(F.coalesce(keys, F.array())) > 0, listed(keys, media, "media_key")).alias("media"),
            find(places, "id", post.getField("geo").getField("place_id")).alias("place"),
            F.transform(
                refs, lambda t: F.struct(t.alias("post"), find(users, "id", t.getField("author_id")).alias("user"))
            ).alias("referenced_full"),
        )

    # looked up before posts become rows, so no row carries the page's side lists
    return pages.select("page_id", F.inline(F.transform("data", enriched)))


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs to flat columns named by their path; arrays stay arrays."""

    def leaves(schema: StructType, path: list[str]):
        for field in schema.fields:
            if isinstance(field.dataType, StructType):
                yield from leaves(field.dataType, path + [field.name])
            else:
                yield path + [field.name]

    cols = []
    for path in leaves(df.schema, []):
        ref = F.col(f"`{path[0]}`")
        for name in path[1:]:
            ref = ref.getField(name)
        cols.append(ref.alias(sep.join(path)))
    return df.select(*cols)
