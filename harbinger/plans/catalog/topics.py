"""Dynamic topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from harbinger.functions.columns import r6
from harbinger.operators import hierarchy as H
from harbinger.operators import topics as T
from harbinger.plans import inputs
from harbinger.plans.catalog import register
from harbinger.plans.twins import sql

DIMS = inputs.WIDTH


def articles(spark, sf_dir):
    emb = inputs.table(spark, sf_dir, "embeddings")
    pub = F.lit(inputs.EPOCH).cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("vec_id") % 30).cast("int"))
    return emb.select(F.col("vec_id").alias("article_id"), pub.alias("pub"), pub.alias("snapshot_date"))


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


def clustered(spark, sf_dir):
    """The rule-made snapshots with their day number."""
    snaps = inputs.snapshots(spark, sf_dir, with_coords=True)
    return snaps.join(F.broadcast(T.day_axis(snaps)), "snapshot_date")


def total(c):
    return r6(F.aggregate(c, F.lit(0.0), lambda a, x: a + x))


@register(
    "cumulative_snapshots",
    """SELECT strftime(d, '%Y-%m-%d') AS snapshot_date, vec_id AS article_id FROM embeddings,
      (SELECT DISTINCT DATE '2024-01-01' + CAST(vec_id % 30 AS INT) AS d FROM embeddings)
    WHERE DATE '2024-01-01' + CAST(vec_id % 30 AS INT) <= d""",
)
def cumulative_snapshots(spark, sf_dir):
    snaps = T.cumulative_snapshots(articles(spark, sf_dir))
    return snaps.select(day("snapshot_date").alias("snapshot_date"), "article_id")


@register("reduced_coordinates")
def reduced_coordinates(spark, sf_dir):
    out = T.reduce_dimensions(inputs.vectors(spark, sf_dir))
    return out.select("model", "article_id", *[r6(F.col("coords")[i]).alias(f"c{i}") for i in range(DIMS)])


# principal components keep the whole variance, in falling order, and do not vary together
@register(
    "component_variances",
    sql(
        """SELECT model, sum(v)::DOUBLE AS variance, 0::BIGINT AS n_rising, 0.0::DOUBLE AS shared FROM (
            SELECT model, i, round(var_pop(coords[i]), 9) AS v FROM vectors, range(1, %d) r(i) GROUP BY model, i) GROUP BY model"""
        % (DIMS + 1),
        "vectors",
    ).replace("sum(v)::DOUBLE", "round(sum(v), 6)"),
)
def component_variances(spark, sf_dir):
    out = T.reduce_dimensions(inputs.vectors(spark, sf_dir), DIMS)
    parts = [F.col("coords")[i] for i in range(DIMS)]
    stats = out.groupBy("model").agg(
        *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(parts)],
        *[F.covar_pop(parts[i], parts[j]).alias(f"c{i}_{j}") for i in range(DIMS) for j in range(i + 1, DIMS)],
    )
    rising = sum((F.col(f"v{i + 1}") > F.col(f"v{i}") + 1e-12).cast("long") for i in range(DIMS - 1))
    shared = F.greatest(*[F.abs(F.col(f"c{i}_{j}")) for i in range(DIMS) for j in range(i + 1, DIMS)])
    total = sum(F.col(f"v{i}") for i in range(DIMS))
    return stats.select("model", r6(total).alias("variance"), rising.alias("n_rising"), r6(shared).alias("shared"))


@register("density_clusters")
def density_clusters(spark, sf_dir):
    snaps = T.cumulative_snapshots(articles(spark, sf_dir)).join(inputs.vectors(spark, sf_dir), "article_id")
    out = T.density_clusters(snaps)
    return out.select("model", "at", "article_id", "cluster_id", r6("outlier_score").alias("outlier_score"))


RADIUS = 0.02  # of the projection below


# clusters of the whole table as one snapshot, from all pairs
@register(
    "density_partition",
    sql(
        f""", p AS (SELECT model, article_id, coords[1] AS x, coords[2] AS y FROM vectors),
        d AS (SELECT a.model, a.article_id AS a, b.article_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist
            FROM p a JOIN p b ON a.model = b.model),
        m AS (SELECT model, a FROM (SELECT model, a, dist, row_number() OVER (PARTITION BY model, a ORDER BY dist) AS k FROM d)
            WHERE k = 5 AND dist <= {RADIUS}),
        e AS (SELECT d.model, d.a, d.b FROM d JOIN m u ON u.model = d.model AND u.a = d.a
            JOIN m v ON v.model = d.model AND v.a = d.b WHERE d.dist <= {RADIUS}),
        r AS (SELECT model, a AS node, a AS root FROM m
            UNION SELECT r.model, e.b, r.root FROM r JOIN e ON e.model = r.model AND e.a = r.node),
        c AS (SELECT model, node, min(root) AS label FROM r GROUP BY model, node),
        s AS (SELECT model, label, row_number() OVER (PARTITION BY model ORDER BY label) - 1 AS cluster_id
            FROM c GROUP BY model, label HAVING count(*) >= 5)
        SELECT p.model, p.article_id, CAST(coalesce(s.cluster_id, -1) AS INT) AS cluster_id FROM p
        LEFT JOIN c ON c.model = p.model AND c.node = p.article_id LEFT JOIN s ON s.model = c.model AND s.label = c.label""",
        "vectors",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def density_partition(spark, sf_dir):
    """Clusters of all articles as one snapshot of two dimensions, within a fixed radius."""
    flat = inputs.vectors(spark, sf_dir).withColumn("coords", F.slice("coords", 1, 2))
    out = T.density_clusters(flat.withColumns({"at": F.lit(1), "first_at": F.lit(1)}), epsilon=RADIUS)
    return out.select("model", "article_id", "cluster_id")


def flat(spark, sf_dir):
    """All articles as one snapshot of two dimensions."""
    rows = inputs.vectors(spark, sf_dir).withColumn("coords", F.slice("coords", 1, 2))
    return rows.withColumns({"at": F.lit(1), "first_at": F.lit(1)})


@register("hierarchical_clusters")
def hierarchical_clusters(spark, sf_dir):
    out = H.hierarchical_clusters(T.cumulative_snapshots(articles(spark, sf_dir)).join(inputs.vectors(spark, sf_dir), "article_id"))
    return out.select("model", "at", "article_id", "cluster_id", r6("outlier_score").alias("outlier_score"))


# single linkage at one height, from all pairs: the tree's edges up to it leave the same components
@register(
    "single_linkage_cut",
    sql(
        f""", p AS (SELECT model, article_id, coords[1] AS x, coords[2] AS y FROM vectors),
        d AS (SELECT a.model, a.article_id AS a, b.article_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist
            FROM p a JOIN p b ON a.model = b.model),
        m AS (SELECT model, a, dist AS core FROM (SELECT model, a, dist, row_number() OVER (PARTITION BY model, a ORDER BY dist) AS k FROM d)
            WHERE k = 6),
        e AS (SELECT d.model, d.a, d.b FROM d JOIN m u ON u.model = d.model AND u.a = d.a
            JOIN m v ON v.model = d.model AND v.a = d.b WHERE greatest(d.dist, u.core, v.core) <= {RADIUS}),
        r AS (SELECT model, a AS node, a AS root FROM m
            UNION SELECT r.model, e.b, r.root FROM r JOIN e ON e.model = r.model AND e.a = r.node)
        SELECT model, node AS article_id, min(root) AS label FROM r GROUP BY model, node""",
        "vectors",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def single_linkage_cut(spark, sf_dir):
    rows = flat(spark, sf_dir)
    heads, core = T.core_distances(rows, 6)
    points = core.join(heads.select("model", "node", "coords"), ["model", "node"])
    forest = H.spanning_forest(points)
    parts = H.components(points.select("model", "at", "node"), forest.where(F.col("w") <= RADIUS))
    copies = rows.join(heads.select("model", "coords", "node"), ["model", "coords"])
    return copies.join(parts, ["model", "at", "node"]).select("model", "article_id", "label")


@register(
    "connected_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT lang, doc_id AS a, prev AS b FROM (
        SELECT lang, doc_id, lag(doc_id) OVER (PARTITION BY lang, source ORDER BY doc_id) AS prev FROM documents) WHERE prev IS NOT NULL),
      r AS (SELECT lang, doc_id AS node, doc_id AS root FROM documents UNION SELECT r.lang, e.a, r.root FROM r JOIN e ON e.b = r.node)
    SELECT lang, node, min(root) AS label FROM r GROUP BY lang, node""",
)
def connected_components(spark, sf_dir):
    """Documents of a language chained by source, each to the one before it."""
    from pyspark.sql import Window

    doc = inputs.table(spark, sf_dir, "documents")
    prev = F.lag("doc_id").over(Window.partitionBy("lang", "source").orderBy("doc_id"))
    edges = doc.select("lang", F.col("doc_id").alias("a"), prev.alias("b")).where(F.col("b").isNotNull())
    return T.connected_components(doc.select("lang", F.col("doc_id").alias("node")), edges, ["lang"])


CENTROIDS = (
    "SELECT model, snapshot_date, cluster_id, count(*) AS n, ["
    + ", ".join(f"avg(coords[{i}])" for i in range(1, DIMS + 1))
    + "] AS centroid FROM snapshots JOIN vectors USING (model, article_id) WHERE cluster_id <> -1 GROUP BY ALL"
)


@register(
    "cluster_centroids",
    sql(
        f"""SELECT model, CAST(snapshot_date - DATE '2024-01-01' + 1 AS INT) AS at, cluster_id, n AS n_articles,
        round(list_sum(centroid), 6) AS centroid_sum FROM ({CENTROIDS})""",
        "snapshots",
        "vectors",
    ),
)
def cluster_centroids(spark, sf_dir):
    out = T.cluster_centroids(clustered(spark, sf_dir), DIMS)
    return out.select("model", "at", "cluster_id", "n_articles", total("centroid").alias("centroid_sum"))


@register(
    "transition_costs",
    sql(
        f"""SELECT p.model, CAST(c.snapshot_date - DATE '2024-01-01' + 1 AS INT) AS at, p.cluster_id AS prev, c.cluster_id AS cur,
        round(1 - list_cosine_similarity(p.centroid, c.centroid), 6) + 0.0 AS cost
        FROM ({CENTROIDS}) p JOIN ({CENTROIDS}) c ON p.model = c.model AND p.snapshot_date + 1 = c.snapshot_date""",
        "snapshots",
        "vectors",
    ),
)
def transition_costs(spark, sf_dir):
    out = T.transition_costs(T.cluster_centroids(clustered(spark, sf_dir), DIMS))
    return out.withColumn("cost", r6("cost"))


@register("topic_matches")
def topic_matches(spark, sf_dir):
    cents = T.cluster_centroids(clustered(spark, sf_dir), DIMS)
    return T.match_topics(cents).withColumn("cost", r6("cost"))


# an assignment gives each topic of the smaller side one partner, and exchanging partners saves nothing
@register(
    "topic_match_faults",
    sql(
        f""", c AS (SELECT model, CAST(snapshot_date - DATE '2024-01-01' + 1 AS INT) AS d, count(*) AS n FROM ({CENTROIDS}) GROUP BY ALL)
        SELECT c.model, c.d AS at, least(p.n, c.n) AS n_matched, 0::BIGINT AS n_repeated, 0::BIGINT AS n_wrong_costs,
        0::BIGINT AS n_savings FROM c JOIN c p ON p.model = c.model AND p.d + 1 = c.d""",
        "snapshots",
        "vectors",
    ),
)
def topic_match_faults(spark, sf_dir):
    """Matches of any cost beside all costs: repeated topics, costs that differ, and better
    partners by exchange with another match or with an unmatched topic."""
    cents = T.cluster_centroids(clustered(spark, sf_dir), DIMS)
    costs = T.transition_costs(cents)
    matches = T.match_topics(cents, threshold=2.0)
    keys = ["model", "at"]
    mine = matches.select(*keys, "prev", F.col("cur").alias("own"), F.col("cost").alias("pays"))
    theirs = matches.select(*keys, "cur", F.col("prev").alias("other"), F.col("cost").alias("gets"))
    beside = costs.join(mine, [*keys, "prev"], "left").join(theirs, [*keys, "cur"], "left")
    back = costs.select(*keys, F.col("prev").alias("other"), F.col("cur").alias("own"), F.col("cost").alias("back"))
    swapped = beside.join(back, [*keys, "other", "own"], "left")
    now = F.coalesce("pays", F.lit(0.0)) + F.coalesce("gets", F.lit(0.0))
    saves = F.col("cost") + F.coalesce("back", F.lit(0.0)) < now - 1e-9
    same = F.col("own") == F.col("cur")
    faults = swapped.groupBy(*keys).agg(
        F.count_if(same & (F.abs(F.col("cost") - F.col("pays")) > 1e-9)).alias("n_wrong_costs"),
        F.count_if(~F.coalesce(same, F.lit(False)) & saves).alias("n_savings"),
    )
    counted = matches.groupBy(*keys).agg(
        F.count("*").alias("n_matched"),
        (2 * F.count("*") - F.count_distinct("prev") - F.count_distinct("cur")).alias("n_repeated"),
    )
    return counted.join(faults, keys, "full")


# given links: a cluster continues the cluster of the same number unless (number + day) % 4 = 0
@register(
    "topic_lineage",
    sql(
        """, n AS (SELECT DISTINCT model, CAST(snapshot_date - DATE '2024-01-01' + 1 AS INT) AS st, cluster_id FROM snapshots
            WHERE cluster_id <> -1),
        h AS (SELECT n.*, NOT EXISTS (SELECT 1 FROM n p WHERE p.model = n.model AND p.st = n.st - 1
            AND p.cluster_id = n.cluster_id) OR (n.cluster_id + n.st) % 4 = 0 AS head FROM n),
        t AS (SELECT model, st, cluster_id, row_number() OVER (PARTITION BY model ORDER BY st, cluster_id) - 1 AS topic_id
            FROM h WHERE head)
        SELECT h.model, h.st AS "at", h.cluster_id, CAST(arg_max(t.topic_id, t.st) AS INT) AS topic_id FROM h JOIN t
        ON t.model = h.model AND t.cluster_id = h.cluster_id AND t.st <= h.st GROUP BY h.model, h.st, h.cluster_id""",
        "snapshots",
    ),
)
def topic_lineage(spark, sf_dir):
    nodes = clustered(spark, sf_dir).where(F.col("cluster_id") != -1).select("model", "at", "cluster_id").distinct()
    before = nodes.select("model", (F.col("at") + 1).alias("at"), "cluster_id")
    links = nodes.join(before, ["model", "at", "cluster_id"]).where((F.col("cluster_id") + F.col("at")) % 4 != 0)
    links = links.select("model", "at", F.col("cluster_id").alias("prev"), F.col("cluster_id").alias("cur"))
    return T.topic_lineage(nodes, links)


@register(
    "topic_table",
    sql(
        f"""SELECT model, strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, cluster_id, cluster_id AS topic_id,
        n AS n_articles, round(list_sum(centroid), 6) AS centroid_sum FROM ({CENTROIDS})""",
        "snapshots",
        "vectors",
    ),
)
def topic_table(spark, sf_dir):
    out = T.topic_table(inputs.snapshots(spark, sf_dir, with_coords=True), DIMS)
    return out.select(
        "model", day("snapshot_date").alias("snapshot_date"), "cluster_id", "topic_id", "n_articles",
        total("centroid").alias("centroid_sum"),
    )


@register(
    "assignment_table",
    sql(
        """SELECT model, strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, article_id, cluster_id,
        CASE WHEN cluster_id = -1 THEN -1 ELSE cluster_id + 100 END AS topic_id, is_outlier, outlier_score FROM snapshots""",
        "snapshots",
    ),
)
def assignment_table(spark, sf_dir):
    """With given clusters and a given lineage."""
    rows = clustered(spark, sf_dir)
    snaps = rows.select("model", "at", "snapshot_date", "article_id", "pub", "coords")
    labels = rows.select("model", "at", "article_id", "cluster_id", "outlier_score")
    lineage = rows.where(F.col("cluster_id") != -1).select("model", "at", "cluster_id").distinct()
    out = T.assignment_table(snaps, labels, lineage.withColumn("topic_id", F.col("cluster_id") + 100))
    return out.drop("pub", "coords").withColumn("snapshot_date", day("snapshot_date"))


@register("reconstructed_topics")
def reconstructed_topics(spark, sf_dir):
    out = T.reconstruct(articles(spark, sf_dir), inputs.vectors(spark, sf_dir), DIMS)
    return out.groupBy("model", day("snapshot_date").alias("snapshot_date"), "topic_id").agg(F.count("*").alias("n"))
