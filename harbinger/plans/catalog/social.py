"""Share features."""

from __future__ import annotations

from pyspark.sql import functions as F

from harbinger.functions.columns import r6
from harbinger.operators import modularity as M
from harbinger.operators import social as S
from harbinger.plans import inputs
from harbinger.plans.catalog import register
from harbinger.plans.twins import sql

STAMP = "yyyy-MM-dd HH:mm:ss"


def both(spark, sf_dir, time_of_day=False):
    return inputs.articles(spark, sf_dir, time_of_day), inputs.shares(spark, sf_dir)


@register(
    "effective_cutoffs",
    sql("SELECT article_id, strftime(cut, '%Y-%m-%d %H:%M:%S') AS cut FROM cuts_tod", "cuts_tod"),
)
def effective_cutoffs(spark, sf_dir):
    articles, _ = both(spark, sf_dir, True)
    return S.cutoffs(articles).select("article_id", F.date_format("cut", STAMP).alias("cut"))


@register(
    "shares_as_of",
    sql(
        """SELECT article_id, author_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
        followers_count, tweet_count, listed_count FROM seen""",
        "seen",
    ),
)
def shares_as_of(spark, sf_dir):
    hist = S.shares_as_of(*both(spark, sf_dir, True))
    return hist.withColumn("created_at", F.date_format("created_at", STAMP))


@register(
    "unique_share_users",
    sql("SELECT article_id, count(DISTINCT author_id)::DOUBLE AS soc_unique_users FROM seen GROUP BY article_id", "seen"),
)
def unique_share_users(spark, sf_dir):
    return S.unique_users(S.shares_as_of(*both(spark, sf_dir, True)))


@register(
    "share_user_medians",
    sql(
        "SELECT article_id, "
        + ", ".join(f"round(median({m}), 6) AS {name}" for m, name in S.METRICS.items())
        + " FROM seen GROUP BY article_id",
        "seen",
    ),
)
def share_user_medians(spark, sf_dir):
    out = S.user_medians(S.shares_as_of(*both(spark, sf_dir, True)))
    return out.withColumns({c: r6(c) for c in S.METRICS.values()})


@register(
    "first_share_pairs",
    sql("SELECT author_id, article_id, strftime(first, '%Y-%m-%d %H:%M:%S') AS first FROM firsts", "firsts"),
)
def first_share_pairs(spark, sf_dir):
    _, shares = both(spark, sf_dir)
    return S.first_shares(shares).withColumn("first", F.date_format("first", STAMP))


@register(
    "share_projection",
    sql(
        """SELECT article_id, strftime(cut, '%Y-%m-%d %H:%M:%S') AS cut, neighbour, weight FROM ego""",
        "ego",
    ),
)
def share_projection(spark, sf_dir):
    articles, shares = both(spark, sf_dir)
    ego = S.ego_edges(S.cutoffs(articles), S.share_graph(articles, shares))
    return ego.withColumn("cut", F.date_format("cut", STAMP))


@register(
    "weighted_clustering",
    sql("SELECT article_id, round(cc, 6) AS media_weighted_clustering FROM clustering", "clustering"),
)
def weighted_clustering(spark, sf_dir):
    articles, shares = both(spark, sf_dir)
    edges, cuts = S.share_graph(articles, shares), S.cutoffs(articles)
    out = S.weighted_clustering(S.stage(S.ego_edges(cuts, edges)), edges, S.heaviest(cuts, edges))
    return out.withColumn("media_weighted_clustering", r6("media_weighted_clustering"))


@register("share_communities")
def share_communities(spark, sf_dir):
    articles, shares = both(spark, sf_dir)
    parts = S.communities(S.graph_at(S.cutoffs(articles), S.share_graph(articles, shares)))
    return parts.withColumn("cut", F.date_format("cut", STAMP))


@register("modularity_communities")
def modularity_communities(spark, sf_dir):
    articles, shares = both(spark, sf_dir)
    parts = M.modularity_communities(S.graph_at(S.cutoffs(articles), S.share_graph(articles, shares)))
    return parts.withColumn("cut", F.date_format("cut", STAMP))


# no article would gain by moving to a neighbour's community, and no pair of communities by joining
@register(
    "modularity_faults",
    sql(
        """SELECT strftime(cut, '%Y-%m-%d %H:%M:%S') AS cut, count(DISTINCT l.a) AS n_articles, sum(l.w)::BIGINT AS weight,
        0::BIGINT AS n_moves, 0::BIGINT AS n_joins, true AS above_one_community FROM links l GROUP BY cut""",
        "links",
    ),
)
def modularity_faults(spark, sf_dir):
    """Gains in fractions of the whole weight, from the partition alone."""
    articles, shares = both(spark, sf_dir)
    graph = S.cut_lineage(S.graph_at(S.cutoffs(articles), S.share_graph(articles, shares)))
    parts = S.cut_lineage(M.modularity_communities(graph))
    one = parts.select("cut", F.col("article_id").alias("a"), F.col("community").alias("ca"))
    two = parts.select("cut", F.col("article_id").alias("b"), F.col("community").alias("cb"))
    ends = graph.join(one, ["cut", "a"]).join(two, ["cut", "b"])
    total = graph.groupBy("cut").agg(F.sum("weight").alias("m2"), F.count_distinct("a").alias("n_articles"))
    degree = graph.groupBy("cut", "a").agg(F.sum("weight").alias("k"))
    held = degree.join(one, ["cut", "a"]).groupBy("cut", "ca").agg(F.sum("k").alias("s"))
    other = held.select("cut", F.col("ca").alias("cb"), F.col("s").alias("t"))
    inside = ends.where("ca = cb").groupBy("cut", "a").agg(F.sum("weight").alias("stay"))
    to = ends.where("ca <> cb").groupBy("cut", "a", "ca", "cb").agg(F.sum("weight").alias("w")).join(inside, ["cut", "a"], "left")
    to = to.join(degree, ["cut", "a"]).join(held, ["cut", "ca"]).join(other, ["cut", "cb"]).join(total, "cut")
    gain = (F.col("w") - F.coalesce("stay", F.lit(0))) / F.col("m2") - F.col("k") * (F.col("t") - F.col("s") + F.col("k")) / F.col("m2") / F.col("m2")
    moves = to.groupBy("cut").agg(F.count_if(gain > 1e-12).alias("n_moves"))
    between = ends.where("ca <> cb").groupBy("cut", "ca", "cb").agg(F.sum("weight").alias("w")).join(held, ["cut", "ca"])
    between = between.join(other, ["cut", "cb"]).join(total, "cut")
    joins = between.groupBy("cut").agg(F.count_if(F.col("w") / F.col("m2") - F.col("s") * F.col("t") / F.col("m2") / F.col("m2") > 1e-12).alias("n_joins"))
    kept = ends.groupBy("cut").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("kept"))
    square = held.groupBy("cut").agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    q = F.col("kept") / F.col("m2") - F.col("square") / F.col("m2") / F.col("m2")
    out = total.join(moves, "cut", "left").join(joins, "cut", "left").join(kept, "cut").join(square, "cut")
    return out.select(
        F.date_format("cut", STAMP).alias("cut"), "n_articles", F.col("m2").alias("weight"), F.coalesce("n_moves", F.lit(0)).alias("n_moves"),
        F.coalesce("n_joins", F.lit(0)).alias("n_joins"), (q >= -1e-12).alias("above_one_community"),
    )


@register(
    "bridge_ratios",
    sql(
        """SELECT article_id, round(sum(CASE WHEN article_id % 3 <> neighbour % 3 THEN weight ELSE 0 END)
        / (sum(weight) + 1e-6), 6) + 0.0 AS media_bridge_ratio FROM ego GROUP BY article_id""",
        "ego",
    ),
)
def bridge_ratios(spark, sf_dir):
    """With a given partition: articles by id modulo three."""
    articles, shares = both(spark, sf_dir)
    cuts = S.cutoffs(articles)
    graph = S.share_graph(articles, shares)
    parts = (
        S.graph_at(cuts, graph)
        .select("cut", F.col("a").alias("article_id"), (F.col("a") % 3).alias("community"))
        .distinct()
    )
    out = S.bridge_ratios(S.ego_edges(cuts, graph), parts)
    return out.withColumn("media_bridge_ratio", r6("media_bridge_ratio"))


@register(
    "community_sizes",
    sql(
        """SELECT c.article_id, coalesce(m.n, CASE WHEN EXISTS (SELECT 1 FROM firsts WHERE first < c.cut)
          THEN 1 ELSE 0 END)::DOUBLE AS media_community_size
        FROM cuts c LEFT JOIN (SELECT DISTINCT cut, a FROM links) p ON p.cut = c.cut AND p.a = c.article_id
        LEFT JOIN (SELECT cut, a % 3 AS g, count(DISTINCT a) AS n FROM links GROUP BY cut, a % 3) m
          ON m.cut = p.cut AND m.g = p.a % 3""",
        "cuts",
        "links",
        "firsts",
    ),
)
def community_sizes(spark, sf_dir):
    """With the same given partition."""
    articles, shares = both(spark, sf_dir)
    cuts = S.cutoffs(articles)
    linked = S.graph_at(cuts, S.share_graph(articles, shares)).select("cut", F.col("a").alias("article_id")).distinct()
    parts = linked.withColumn("community", F.col("article_id") % 3)
    return S.community_sizes(cuts, parts, S.graph_start(articles, shares))


@register("social_features")
def social_features(spark, sf_dir):
    return S.social_features(*both(spark, sf_dir))


@register(
    "social_features_exact_part",
    sql(
        """SELECT a.article_id, coalesce(users, 0) AS soc_unique_users,
        coalesce(f, 0) AS soc_median_user_public_metrics_followers_count,
        coalesce(t, 0) AS soc_median_user_public_metrics_tweet_count,
        coalesce(l, 0) AS soc_median_user_public_metrics_listed_count,
        round(coalesce(cc, 0), 6) AS media_weighted_clustering
        FROM articles a LEFT JOIN soc USING (article_id) LEFT JOIN clustering USING (article_id)""",
        "articles",
        "soc",
        "clustering",
    ),
)
def social_features_exact_part(spark, sf_dir):
    """Zero-filled assembly without the two columns that rest on label propagation."""
    out = S.social_features(*both(spark, sf_dir)).drop("media_bridge_ratio", "media_community_size")
    return out.withColumn("media_weighted_clustering", r6("media_weighted_clustering"))
