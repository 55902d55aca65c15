"""Share and share-graph features of an article as of its cut-off.

``articles``: article_id, pub.  ``shares``: article_id, author_id, created_at and the
user metrics.  A share counts when it is strictly earlier than the article's cut-off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harbinger.functions.columns import as_col, nan_to_null
from harbinger.functions.keyed import exact_median
from harbinger.session import cut_lineage, stage

METRICS = {
    "followers_count": "soc_median_user_public_metrics_followers_count",
    "tweet_count": "soc_median_user_public_metrics_tweet_count",
    "listed_count": "soc_median_user_public_metrics_listed_count",
}
GRAPH_FEATURES = ["media_weighted_clustering", "media_bridge_ratio", "media_community_size"]
SOCIAL_FEATURES = ["soc_unique_users", *METRICS.values(), *GRAPH_FEATURES]

# Fixed value: keeps the bridge ratio defined without edges.
BRIDGE_EPSILON = 1e-6
USER_BLOCK = 512


def cutoff(pub: Column | str) -> Column:
    """Exact midnight becomes the next midnight; any other time stays."""
    t = as_col(pub).cast("timestamp_ntz")
    return F.when(t == F.date_trunc("day", t).cast("timestamp_ntz"), t + F.make_dt_interval(days=F.lit(1))).otherwise(t)


def cutoffs(articles: DataFrame) -> DataFrame:
    """One row per article with its cut-off; articles without a date have none.

    An article listed twice counts as in its first row (smallest ``ingest_pos``); a table
    without positions has no first row, so the earliest cut-off counts.
    """
    cut = cutoff("pub")
    first = F.min_by(cut, "ingest_pos") if "ingest_pos" in articles.columns else F.min(cut)
    return articles.groupBy("article_id").agg(first.alias("cut"))


def shares_as_of(articles: DataFrame, shares: DataFrame) -> DataFrame:
    """Shares of each article before its cut-off.  Shares without a time never count."""
    return shares.join(cutoffs(articles), "article_id").where(F.col("created_at") < F.col("cut")).drop("cut")


def unique_users(hist: DataFrame) -> DataFrame:
    """Distinct authors per article, reduced to (article, author) pairs first."""
    pairs = hist.select("article_id", "author_id").distinct()
    return pairs.groupBy("article_id").agg(F.count("author_id").cast("double").alias("soc_unique_users"))


def user_medians(hist: DataFrame) -> DataFrame:
    """Medians of the user metrics over share rows; a metric without a column is left out."""
    have = [m for m in METRICS if m in hist.columns]
    items = F.array(*[F.struct(F.lit(m).alias("metric"), nan_to_null(F.col(m)).alias("x")) for m in have])
    long = hist.select("article_id", F.explode(items).alias("i")).select("article_id", "i.*")
    medians = exact_median(long, ["article_id", "metric"], "x", "med")
    return medians.groupBy("article_id").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("med"))).alias(METRICS[m]) for m in have]
    )


def first_shares(shares: DataFrame) -> DataFrame:
    """Distinct (author, article) pairs with the time from which they exist."""
    known = shares.where(F.col("author_id").isNotNull() & F.col("article_id").isNotNull())
    return (
        known.where(F.col("created_at").isNotNull())
        .groupBy("author_id", "article_id")
        .agg(F.min("created_at").alias("first"))
    )


def graph_start(articles: DataFrame, shares: DataFrame) -> DataFrame:
    """One row: the earliest cut-off at which any (author, article) pair exists, or null."""
    return to_steps(first_shares(shares), cutoffs(articles)).agg(F.min("step").alias("start"))


def to_steps(pairs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Replace ``first`` by the earliest cut-off after it (``step``); pairs after the last
    cut-off are never seen and go.

    An equi-join on the day: the cut-offs of a day lie in one sorted array, together
    with the first cut-off of any later day.
    """
    days = (
        cuts.where(F.col("cut").isNotNull())
        .groupBy(F.to_date("cut").alias("day"))
        .agg(F.sort_array(F.collect_set("cut")).alias("times"))
    )
    later = F.min(F.element_at("times", 1)).over(
        Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    bounds = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    # every calendar day up to the last cut-off, carrying the next cut-off after it
    spine = bounds.where(F.col("lo").isNotNull()).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    filled = spine.join(days, "day", "left")
    nxt = filled.select("day", "times", later.alias("later"))
    lo = bounds.select("lo").scalar()
    own = pairs.withColumn("day", F.greatest(F.to_date("first"), lo))
    joined = own.join(nxt, "day")
    same = F.try_element_at(F.filter("times", lambda t: t > F.col("first")), F.lit(1))
    return (
        joined.withColumn("step", F.coalesce(same, F.col("later")))
        .where(F.col("step").isNotNull())
        .select(*[c for c in pairs.columns if c != "first"], "step")
    )


def projection(pairs: DataFrame, block: int = USER_BLOCK) -> DataFrame:
    """Article pairs with at least one common author: ``a < b`` and ``hist``, the number
    of common authors gained at each cut-off.

    The pair exists for an author from the later of both first shares.  An author of
    many articles is split in parts of about ``block`` articles, and every two parts meet
    under a key of their own, so no task gets an author's whole square.
    """
    sizes = pairs.groupBy("author_id").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("article_id"), F.col("parts")).cast("int")
    placed = pairs.join(sizes, "author_id").withColumn("part", part)
    left = placed.select(
        "author_id",
        F.col("article_id").alias("a"),
        F.col("step").alias("sa"),
        F.col("part").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"),
    )
    right = placed.select(
        "author_id",
        F.col("article_id").alias("b"),
        F.col("step").alias("sb"),
        F.col("part").alias("j"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"),
    )
    met = left.join(right, ["author_id", "i", "j"]).where(F.col("a") < F.col("b"))
    gained = met.groupBy("a", "b", F.greatest("sa", "sb").alias("step")).agg(F.count("*").alias("c"))
    return gained.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("step", "c"))).alias("hist"))


def weight_at(hist: Column | str, cut: Column | str) -> Column:
    """Common authors as of a cut-off."""
    return F.aggregate(
        F.filter(as_col(hist), lambda s: s.getField("step") <= as_col(cut)),
        F.lit(0).cast("bigint"),
        lambda acc, s: acc + s.getField("c"),
    )


def both_ways(edges: DataFrame) -> DataFrame:
    other = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "hist")
    return edges.select("a", "b", "hist").unionByName(other)


def ego_edges(cuts: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of each article as of its own cut-off: article_id, cut, neighbour, weight."""
    ends = both_ways(edges).withColumnRenamed("a", "article_id")
    joined = cuts.join(ends, "article_id").withColumn("weight", weight_at("hist", "cut"))
    return joined.where(F.col("weight") > 0).select("article_id", "cut", F.col("b").alias("neighbour"), "weight")


def heaviest(cuts: DataFrame, edges: DataFrame) -> DataFrame:
    """Largest edge weight of the whole graph at each cut-off: cut, max_weight; null before the first edge.

    An edge's weight only grows, so it is a step function of its history and the answer is a running
    maximum over all steps: within a day, and over the days before it.
    """
    steps = F.transform(
        F.sequence(F.lit(1), F.size("hist")),
        lambda i: F.struct(
            F.element_at("hist", i).getField("step").alias("cut"),
            F.aggregate(F.slice("hist", 1, i), F.lit(0).cast("bigint"), lambda acc, h: acc + h.getField("c")).alias("w"),
        ),
    )
    grown = edges.select(F.explode(steps).alias("s")).select("s.cut", "s.w")
    asked = cuts.where(F.col("cut").isNotNull()).select("cut", F.lit(None).cast("bigint").alias("w"))
    each = grown.unionByName(asked).groupBy("cut").agg(F.max("w").alias("w")).withColumn("day", F.to_date("cut"))
    inside = Window.partitionBy("day").orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row per calendar day
    days = each.groupBy("day").agg(F.max("w").alias("w")).select("day", F.max("w").over(earlier).alias("before"))
    joined = each.withColumn("w", F.max("w").over(inside)).join(days, "day")
    return joined.select("cut", F.greatest("w", "before").alias("max_weight"))


def triangles(edges: DataFrame, block: int = USER_BLOCK) -> DataFrame:
    """Triangles ``t, x, y`` of the final graph, once each, with the histories of their sides.

    Edges point from the end with fewer neighbours to the one with more, so a vertex
    starts at most sqrt(2 * edges) of them and hubs start few.  The arrows of a vertex are split in
    parts of about ``block``, and every two parts meet under a key of their own.
    """
    ends = edges.select("a", "b")
    degree = ends.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("deg"))
    ranked = edges.join(degree.select(F.col("v").alias("a"), F.col("deg").alias("da")), "a").join(
        degree.select(F.col("v").alias("b"), F.col("deg").alias("db")), "b"
    )
    forward = F.col("da") <= F.col("db")
    arrows = stage(ranked.select(
        F.when(forward, F.col("a")).otherwise(F.col("b")).alias("t"),
        F.when(forward, F.col("b")).otherwise(F.col("a")).alias("h"),
        "hist",
    ))
    sizes = arrows.groupBy("t").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    placed = arrows.drop("hist").join(sizes.where("parts > 1"), "t", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = placed.select("t", F.col("h").alias("x"), F.col("part").alias("i"), other.alias("j"))
    right = placed.select("t", F.col("h").alias("y"), F.col("part").alias("j"), other.alias("i"))
    wedges = left.join(right, ["t", "i", "j"]).where(F.col("x") < F.col("y")).select("t", "x", "y")
    closed = wedges.join(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("hist").alias("hxy")), ["x", "y"])
    side = arrows.select("t", F.col("h").alias("x"), F.col("hist").alias("htx"))
    return closed.join(side, ["t", "x"]).join(side.withColumnRenamed("x", "y").withColumnRenamed("htx", "hty"), ["t", "y"])


def weighted_clustering(ego: DataFrame, edges: DataFrame, top: DataFrame) -> DataFrame:
    """Geometric-mean weighted clustering of each article as of its cut-off; an article
    with fewer than two neighbours has 0.

    ``top`` is the heaviest weight at each cut-off (``heaviest``).  A triangle closes at the latest first
    step of its sides; a corner with an earlier cut-off does not see it.  Its sides are weighed
    from their histories at the corner's own cut-off, so no graph is laid out per cut-off.
    """
    found = triangles(edges)
    begin = [F.element_at(h, 1).getField("step") for h in ("htx", "hty", "hxy")]
    corners = found.select(F.explode(F.array("t", "x", "y")).alias("article_id"), F.greatest(*begin).alias("closes"), "htx", "hty", "hxy")
    degrees = ego.groupBy("article_id", "cut").agg(F.count("*").alias("deg"))
    seen = corners.join(degrees.where("deg >= 2").select("article_id", "cut"), "article_id").where(F.col("closes") <= F.col("cut"))
    weights = [weight_at(h, "cut").cast("double") for h in ("htx", "hty", "hxy")]
    closed = seen.groupBy("article_id").agg(F.sum(F.cbrt(weights[0] * weights[1] * weights[2])).alias("closed"))
    joined = degrees.join(closed, "article_id", "left").join(top, "cut", "left")
    deg = F.col("deg")
    value = F.when(
        deg >= 2, 2 * F.coalesce("closed", F.lit(0.0)) / F.col("max_weight") / (deg * (deg - 1))
    ).otherwise(0.0)
    return joined.select("article_id", value.alias("media_weighted_clustering"))


def graph_at(cuts: DataFrame, edges: DataFrame) -> DataFrame:
    """Both directions of every edge at every distinct cut-off: cut, a, b, weight.

    Edges and cut-offs meet on the calendar day.
    """
    days = (
        cuts.where(F.col("cut").isNotNull())
        .groupBy(F.to_date("cut").alias("day"))
        .agg(F.collect_set("cut").alias("times"))
    )
    last = days.agg(F.max("day").alias("hi")).scalar()
    born = edges.withColumn("_born", F.to_date(F.element_at("hist", 1).getField("step")))
    spread = born.where(F.col("_born") <= last).withColumn("day", F.explode(F.sequence("_born", last))).drop("_born")
    timed = spread.join(days, "day").withColumn("cut", F.explode("times"))
    weighted = timed.select("cut", "a", "b", weight_at("hist", "cut").alias("weight")).where(F.col("weight") > 0)
    other = weighted.select("cut", F.col("b").alias("a"), F.col("a").alias("b"), "weight")
    return weighted.unionByName(other)


def communities(graph: DataFrame) -> DataFrame:
    """Community of every linked article at every cut-off: cut, article_id, community.

    Synchronous weighted label propagation until no label changes, or until a round adds no
    weight between articles of one label: an article
    takes the label with the largest weight among its neighbours, its own label counting
    with the weight of its heaviest edge; ties go to the smallest label.  It stands in
    for modularity optimisation and gives comparable, not equal, communities.
    """
    own = graph.groupBy("cut", "a").agg(F.max("weight").alias("weight"))
    # an article votes for itself over a loop, so that a round reads the labels once
    loops = own.select("cut", "a", F.col("a").alias("b"), "weight")
    votes = cut_lineage(graph.select("cut", "a", "b", "weight").unionByName(loops))
    labels = own.select("cut", F.col("a").alias("b"), F.col("a").alias("label"))
    agreed = 0.0
    while True:
        tally = votes.join(labels, ["cut", "b"]).groupBy("cut", "a", "label").agg(F.sum("weight").alias("weight"))
        new = cut_lineage(tally.groupBy("cut", F.col("a").alias("b")).agg(
            F.max_by("label", F.struct("weight", -F.col("label"))).alias("label")
        ))
        ends = new.select("cut", F.col("b").alias("a"), F.col("label").alias("own"))
        inside = votes.where("a <> b").join(new, ["cut", "b"]).join(ends, ["cut", "a"]).where(F.col("own") == F.col("label"))
        total = inside.agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("w")).first().w
        if total <= agreed:  # settled, or swinging: the labels before are as good
            break
        labels, agreed = new, total
    labels = labels.withColumnRenamed("b", "a")
    return labels.select("cut", F.col("a").alias("article_id"), F.col("label").alias("community"))


def bridge_ratios(ego: DataFrame, parts: DataFrame) -> DataFrame:
    """Share of an article's edge weight that leaves its community, from any partition
    ``cut, article_id, community``."""
    mine = parts.withColumnRenamed("community", "mine")
    theirs = parts.select("cut", F.col("article_id").alias("neighbour"), F.col("community").alias("theirs"))
    joined = ego.join(mine, ["cut", "article_id"]).join(theirs, ["cut", "neighbour"], "left")
    inside = F.sum(F.when(F.col("mine") == F.col("theirs"), F.col("weight")).otherwise(0))
    total = F.sum("weight")
    return joined.groupBy("article_id").agg(
        ((total - inside) / (total + BRIDGE_EPSILON)).alias("media_bridge_ratio")
    )


def community_sizes(cuts: DataFrame, parts: DataFrame, start: DataFrame) -> DataFrame:
    """Members of the article's community; 1 without edges, 0 while nobody shared anything."""
    sizes = parts.groupBy("cut", "community").agg(F.count("*").cast("double").alias("members"))
    mine = cuts.join(parts, ["cut", "article_id"], "left").join(sizes, ["cut", "community"], "left")
    value = F.coalesce(
        "members", F.when(F.coalesce(F.col("cut") >= start.scalar(), F.lit(False)), 1.0).otherwise(0.0)
    )
    return mine.select("article_id", value.alias("media_community_size"))


def share_graph(articles: DataFrame, shares: DataFrame, block: int = USER_BLOCK) -> DataFrame:
    """Projected graph with the cut-offs of the articles as its time axis; a stage of its own,
    written to the shared folder, since every graph feature starts from it."""
    return cut_lineage(projection(to_steps(first_shares(shares), cutoffs(articles)), block))


def social_features(articles: DataFrame, shares: DataFrame | None) -> DataFrame:
    """All share features for every article; 0 without shares or without a date."""
    ids = articles.select("article_id").distinct()
    if shares is None or "author_id" not in shares.columns:
        return ids.withColumns({c: F.lit(0.0) for c in SOCIAL_FEATURES})
    cuts = cutoffs(articles)
    hist = shares_as_of(articles, shares)
    edges = share_graph(articles, shares)
    ego = cut_lineage(ego_edges(cuts, edges))
    # the graph is needed at the cut-offs of articles that have edges there
    graph = cut_lineage(graph_at(ego.select("cut").distinct(), edges))
    parts = cut_lineage(communities(graph))
    frames = [
        unique_users(hist),
        user_medians(hist),
        weighted_clustering(ego, edges, heaviest(cuts, edges)),
        bridge_ratios(ego, parts),
        community_sizes(cuts, parts, graph_start(articles, shares)),
    ]
    out = reduce(lambda a, b: a.join(b, "article_id", "left"), frames, ids)
    missing = [c for c in SOCIAL_FEATURES if c not in out.columns]
    out = out.withColumns({c: F.lit(0.0) for c in missing}) if missing else out
    return out.select("article_id", *[F.coalesce(nan_to_null(c), F.lit(0.0)).alias(c) for c in SOCIAL_FEATURES])
