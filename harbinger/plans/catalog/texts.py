"""Text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from harbinger.functions.columns import r6
from harbinger.operators import texts
from harbinger.plans import inputs
from harbinger.plans.catalog import register
from harbinger.plans.twins import sql


def article_texts(spark, sf_dir):
    return texts.article_text(inputs.articles(spark, sf_dir))


def mentions(spark, sf_dir):
    return texts.gazetteer_mentions(article_texts(spark, sf_dir), inputs.gazetteer(spark))


def rounded(df, names):
    return df.withColumns({c: r6(c) for c in names})


@register("text_measures", sql("SELECT * FROM measures", "measures"))
def text_measures(spark, sf_dir):
    return rounded(texts.measures(article_texts(spark, sf_dir)), texts.MEASURES)


@register(
    "text_sentiment",
    sql(
        """SELECT article_id, round(text_subjectivity, 6) AS text_subjectivity,
        round(text_neutrality, 6) AS text_neutrality FROM sentiment""",
        "sentiment",
    ),
)
def text_sentiment(spark, sf_dir):
    return rounded(texts.sentiment(article_texts(spark, sf_dir), inputs.lexicon(spark)), texts.SENTIMENT)


@register("entity_counts", sql("SELECT * FROM entities", "entities"))
def entity_counts(spark, sf_dir):
    return texts.entity_counts(inputs.articles(spark, sf_dir), mentions(spark, sf_dir))


@register(
    "text_features",
    sql(
        """SELECT * REPLACE (round(text_subjectivity, 6) AS text_subjectivity, round(text_neutrality, 6)
        AS text_neutrality) FROM measures JOIN sentiment USING (article_id) JOIN entities USING (article_id)""",
        "measures",
        "sentiment",
        "entities",
    ),
)
def text_features(spark, sf_dir):
    out = texts.text_features(inputs.articles(spark, sf_dir), inputs.lexicon(spark), mentions(spark, sf_dir))
    return rounded(out, texts.TEXT_FEATURES)


@register(
    "value_entropy",
    """SELECT lang, round(-sum(p * ln(p)), 6) + 0.0 AS entropy FROM (
      SELECT lang, source, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lang) AS p
      FROM documents WHERE source IS NOT NULL GROUP BY lang, source) GROUP BY lang""",
)
def value_entropy(spark, sf_dir):
    out = texts.entropy(inputs.table(spark, sf_dir, "documents"), ["lang"], "source")
    return out.select("lang", r6("entropy").alias("entropy"))
