"""Text features per article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.functions.text import WORD, fill_template, text_measures

MEASURES = [
    "avg_sentence_len_words",
    "avg_word_len_chars",
    "total_syllables",
    "avg_syllables_per_word",
    "len_chars",
    "len_words",
]
SENTIMENT = ["text_subjectivity", "text_neutrality"]
ENTITY_COUNTS = ["ner_total_ents", "ner_distinct_ents", "ner_person", "ner_org", "ner_loc", "ner_misc"]
TEXT_FEATURES = SENTIMENT + MEASURES + ENTITY_COUNTS

# Fixed value: the normalising constant of the published compound score.
COMPOUND_ALPHA = 15.0
FEW_WORDS = 100_000  # rows of a lexicon or gazetteer that every executor holds


def held(words: DataFrame) -> DataFrame:
    """A table of words, broadcast where it has at most FEW_WORDS rows.

    Spark knows no size of a table made in the session and would shuffle every word of every text to it.
    """
    return F.broadcast(words) if words.limit(FEW_WORDS + 1).count() <= FEW_WORDS else words


def article_text(articles: DataFrame) -> DataFrame:
    """``article_id, text`` with text = title, blank, lead, trimmed."""
    text = fill_template("{title} {description}", {"title": "title", "description": "description"})
    return articles.select("article_id", text.alias("text"))


def measures(texts: DataFrame) -> DataFrame:
    """Length, sentence and syllable measures in one projection over the scan."""
    cols = text_measures("text")
    return texts.select("article_id", *[cols[n].alias(n) for n in MEASURES])


def tokens(texts: DataFrame) -> DataFrame:
    """``article_id, token``: every word in lower case."""
    return texts.select("article_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0)).alias("token"))


def sentiment(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Subjectivity (mean over matched tokens) and neutrality from a lexicon table
    ``token, subjectivity, valence``.

    Tokens meet the lexicon before they are summed; a lexicon of few rows is broadcast, so only
    partial sums are shuffled, and others are joined by token.  Articles with empty text
    get 0 for both; a text without any match is fully neutral.
    """
    found = tokens(texts).join(held(lexicon), "token")
    scores = found.groupBy("article_id").agg(F.avg("subjectivity").alias("subj"), F.sum("valence").alias("s"))
    s = F.coalesce("s", F.lit(0.0))
    empty = F.length("text") == 0
    neutral = 1 - F.abs(s / F.sqrt(s * s + COMPOUND_ALPHA))
    return texts.join(scores, "article_id", "left").select(
        "article_id",
        F.when(empty, 0.0).otherwise(F.coalesce("subj", F.lit(0.0))).alias("text_subjectivity"),
        F.when(empty, 0.0).otherwise(neutral).alias("text_neutrality"),
    )


def gazetteer_mentions(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Mentions ``article_id, ent_text, label, n``: every run of words that is a phrase of
    the gazetteer (``phrase, label``; words joined by one blank).

    Words are found once per text and become rows one by one, each with as many of the words after it as
    the longest phrase takes; one aggregate of the gazetteer finds that number.
    """
    pieces = gazetteer.select(F.split("phrase", " ").alias("pieces"), F.col("phrase").alias("ent_text"), "label")
    phrases = pieces.select(
        F.col("pieces")[0].alias("word"), F.slice("pieces", 2, F.size("pieces")).alias("rest"), "ent_text", "label"
    ).where(F.col("word").isNotNull())
    more = phrases.agg(F.max(F.size("rest"))).first()[0] or 0
    words = texts.select("article_id", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"))
    each = words.select("article_id", "words", F.posexplode("words").alias("at", "word"))
    runs = each.select("article_id", "word", F.slice("words", F.col("at") + 2, more).alias("next")) if more else (
        each.select("article_id", "word", F.expr("slice(words, 1, 0)").alias("next"))
    )
    # the join comes before the count: with a gazetteer that is broadcast, only
    # mentions are shuffled and never the words
    met = runs.join(held(phrases), "word")
    found = met.where(F.slice("next", 1, F.size("rest")) == F.col("rest"))
    return found.groupBy("article_id", "ent_text", "label").agg(F.count("*").alias("n"))


def entity_counts(articles: DataFrame, mentions: DataFrame) -> DataFrame:
    """Counts per article from mentions ``article_id, ent_text, label`` with an optional
    multiplicity ``n``; zero for articles without any."""
    n = F.col("n") if "n" in mentions.columns else F.lit(1)

    def of(labels: list[str], inside: bool = True) -> Column:
        hit = F.col("label").isin(labels)
        return F.sum(F.when(hit if inside else ~hit, n).otherwise(0)).cast("double")

    counted = mentions.groupBy("article_id").agg(
        F.sum(n).cast("double").alias("ner_total_ents"),
        F.count_distinct("ent_text").cast("double").alias("ner_distinct_ents"),
        of(["PER", "PERSON"]).alias("ner_person"),
        of(["ORG"]).alias("ner_org"),
        of(["LOC", "GPE"]).alias("ner_loc"),
        of(["PER", "PERSON", "ORG", "LOC", "GPE"], inside=False).alias("ner_misc"),
    )
    return articles.select("article_id").join(counted, "article_id", "left").na.fill(0.0, ENTITY_COUNTS)


def text_features(articles: DataFrame, lexicon: DataFrame | None = None,
                  mentions: DataFrame | None = None) -> DataFrame:
    """All text features; 0 for what has no lexicon or mention table."""
    texts = article_text(articles)
    out = measures(texts)
    if lexicon is not None:
        out = out.join(sentiment(texts, lexicon), "article_id", "left")
    if mentions is not None:
        out = out.join(entity_counts(articles, mentions), "article_id", "left")
    zero = [c for c in TEXT_FEATURES if c not in out.columns]
    out = out.withColumns({c: F.lit(0.0) for c in zero}) if zero else out
    return out.select("article_id", *TEXT_FEATURES).na.fill(0.0)


def entropy(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Shannon entropy (natural log) of the value counts per group; nulls are ignored and
    a group without values has 0."""
    counted = df.groupBy(*groups, value).agg(F.count(value).alias("c"))
    c = F.nullif(F.col("c"), F.lit(0))
    # sum(c ln c) and sum(c) give the entropy in one more aggregation
    return counted.groupBy(*groups).agg(
        F.coalesce(
            F.log(F.sum(c)) - F.sum(c * F.log(c.cast("double"))) / F.sum(c), F.lit(0.0)
        ).alias("entropy")
    )
