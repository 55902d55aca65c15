"""Rules and edge cases on small literal tables."""

import itertools
import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from harbinger.functions import text as T
from harbinger.functions import urls as U
from harbinger.functions.columns import topic_number, truthy, utc_naive
from harbinger.functions.keyed import dense_index, exact_median, first_per_key
from harbinger.operators import (
    cleaning,
    consensus,
    experiments,
    features,
    forward,
    geometry,
    neighbours,
    quality,
    shapley,
    significance,
    social,
    texts,
    topics,
    trajectory,
)
from harbinger.sources import tables


def values(df, column):
    return [r[column] for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# ---------------------------------------------------------------- columns and text


@pytest.mark.parametrize(
    "raw, want",
    [
        (" https://www.a.fr/x?utm_source=b&k=1#top ", "https://www.a.fr/x?k=1"),
        ("HTTP://a.fr/x?UTM_Medium=1&fbclid=2&gclid=3&mc_cid=4&mc_eid=5", "http://a.fr/x"),
        ("http://a.fr/?q=&r=a%20b", "http://a.fr/?q=&r=a+b"),
        ("http://a.fr/?b=2&a=1&flag", "http://a.fr/?b=2&a=1&flag="),
        ("http://a.fr/?t=~x*y", "http://a.fr/?t=~x%2Ay"),
        ("", ""),
    ],
)
def test_normalised_url(spark, raw, want):
    assert one(spark, U.normalise_url(F.lit(raw))) == want


def test_domain_and_country(spark):
    assert one(spark, U.domain(F.lit("http://WWW.www.Shop.fr:80/x"))) == "www.shop.fr:80"
    assert one(spark, U.country(F.lit("https://news.sn/x"))) == "Senegal"
    assert one(spark, U.country(F.lit("https://news.fr:8080/x"))) == "Unknown"
    assert one(spark, U.country(F.lit(""))) == "Unknown"


def test_article_key_falls_back_to_title(spark):
    import hashlib

    assert one(spark, U.article_key(F.lit(""), F.lit("été"))) == hashlib.sha1("été".encode()).hexdigest()[:16]


def test_syllables_and_sentences(spark):
    words = {"eau": 1, "rythme": 2, "psst": 1, "123": 0, "_": 0, "Œuvre": 2, "b2b": 1}
    for word, n in words.items():
        assert one(spark, T.syllables(F.lit(word))) == n, word
    assert one(spark, T.syllables(F.lit(" ".join(words)))) == sum(words.values())
    assert one(spark, T.sentence_count(F.lit("A b. !  ? c d... "))) == 2
    measured = T.text_measures(F.lit(""))
    assert all(one(spark, c) == 0 for c in measured.values())


def test_cleaning_text(spark):
    assert one(spark, T.clean_text(F.lit("a \n b\x07c \t"))) == "a bc"
    assert one(spark, T.lead_paragraph(F.lit(" \n\nfirst  one\n\nsecond"))) == "first one"
    assert one(spark, T.published_day(F.lit("Wed, 02 Apr 2025 07:00:00 GMT"))) == "2025-04-02"
    assert one(spark, T.published_day(F.lit("yesterday"))) == "yesterday"
    assert one(spark, T.published_day(F.lit(""))) == ""


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Wed, 02 Apr 2025 07:00:00 GMT", "2025-04-02 07:00:00"),
        ("2 Apr 2025 01:30:00 +0200", "2025-04-01 23:30:00"),
        ("Wednesday, 2 April 2025", "2025-04-02 00:00:00"),
        ("April 2, 2025", "2025-04-02 00:00:00"),
        ("may 2, 2025", "2025-05-02 00:00:00"),
        ("20250402", "2025-04-02 00:00:00"),
        ("2025-04-02T00:30:00+02:00", "2025-04-01 22:30:00"),
        ("2025-04-02", "2025-04-02 00:00:00"),
        ("20251345", None),
        ("April 31, 2025", None),
        ("Foo 2, 2025", None),
        ("1700000000", None),
        ("soon 3", None),
        ("", None),
        (None, None),
    ],
)
def test_dates_of_one_parser(spark, raw, want):
    text = F.lit(raw).cast("string")
    assert one(spark, utc_naive(text).cast("string")) == want
    assert one(spark, T.published_day(text)) == (want[:10] if want else raw or "")


def test_coercions(spark):
    assert [one(spark, topic_number(F.lit(x))) for x in ("3", "3.0", "x", "nan")] == [3, 3, -1, -1]
    assert [one(spark, truthy(F.lit(x))) for x in ("True", "YES", "1", "0", "no")] == [True, True, True, False, False]
    assert one(spark, utc_naive(F.lit("2025-01-01T00:30:00+02:00"))) == datetime(2024, 12, 31, 22, 30)
    assert one(spark, utc_naive(F.lit("not a date"))) is None


def test_first_row_median_and_index(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (2, 9, "c")], "k INT, pos INT, v STRING")
    assert sorted(values(first_per_key(df, ["k"], [F.col("pos")]), "v")) == ["a", "c"]
    nums = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("a", 4.0), ("a", 2.0), ("b", 7.0), ("b", None)], "g STRING, x DOUBLE")
    assert {r["g"]: r["m"] for r in exact_median(nums, ["g"], "x", "m").collect()} == {"a": 3.0, "b": 7.0}
    idx = values(dense_index(spark.range(1000), "id"), "idx")
    assert sorted(idx) == list(range(1000))


def test_inputs_are_checked(spark):
    df = spark.createDataFrame([(1, "2024-01-01")], "article_id INT, pub STRING")
    with pytest.raises(ValueError):
        quality.require_columns(df, ["article_id", "", "url"], "article table")
    bad = spark.createDataFrame([(None, "x")], "article_id INT, pub STRING")
    with pytest.raises(ValueError):
        quality.require_valid(quality.article_checks(bad))
    with pytest.raises(ValueError):
        tables.export_records(df, "/tmp/none.xlsx")
    with pytest.raises(FileNotFoundError):
        tables.read_model_results(spark, "/tmp/harbinger-nothing-here")
    with pytest.raises(ValueError):
        cleaning.day_spine(spark, "2024-01-02", "2024-01-01")
    assert cleaning.day_spine(spark, "2024-01-01", "2024-01-03").count() == 3
    assert tables.read_optional_table(spark, "none") is None


# ---------------------------------------------------------------- trajectories and labels


def snaps(spark, rows):
    typed = "model INT, article_id INT, pub STRING, snapshot_date STRING, topic_id INT, is_outlier BOOLEAN"
    df = spark.createDataFrame(rows, typed)
    return df.withColumn("pub", utc_naive("pub")).withColumn("snapshot_date", utc_naive("snapshot_date"))


def test_trajectory_edge_cases(spark):
    d = "2024-01-0"
    rows = [
        # flagged as outlier although in a topic: joins at once, and its topic is as old as it
        (0, 1, d + "1", d + "1", 5, True),
        # time of day: the snapshot of its own day is before it
        (0, 2, d + "1 12:00:00", d + "1", 3, False),
        (0, 2, d + "1 12:00:00", d + "2", -1, True),
        # published after the last snapshot: dropped
        (0, 3, d + "2 08:00:00", d + "2", 3, False),
        # never joins
        (0, 4, d + "1", d + "1", -1, True),
    ]
    got = {r["article_id"]: r["trajectory"] for r in trajectory.trajectories(snaps(spark, rows)).collect()}
    assert got == {1: "other", 2: "Oold", 4: "Oold"}


def test_warmup_moves_topic_birth(spark):
    d = "2024-01-0"
    rows = [
        (0, 9, d + "1", d + "1", 7, False),
        (0, 9, d + "1", d + "3", 7, False),
        (0, 1, d + "2", d + "2", -1, True),
        (0, 1, d + "2", d + "3", 7, False),
    ]
    full = {r["article_id"]: r["trajectory"] for r in trajectory.trajectories(snaps(spark, rows)).collect()}
    cut = {r["article_id"]: r["trajectory"] for r in trajectory.trajectories(snaps(spark, rows), 2).collect()}
    assert full[1] == "TODlate" and cut[1] == "not_publication_outlier"


def test_label_rule_and_kappa(spark):
    df = spark.createDataFrame([(3, 0, 4), (3, 2, 4), (3, 1, 4), (1, 0, 4)], "n_outlier_votes INT, n_TOA_votes INT, n_models INT")
    assert values(df.select(consensus.label_for(2).alias("x")), "x") == [0.0, 1.0, None, None]
    assert values(df.select(consensus.label_for(2, 1).alias("x")), "x") == [0.0, 1.0, 0.0, None]
    alone = df.withColumn("n_models", F.lit(1))
    assert values(consensus.fleiss_kappa(alone), "fleiss_kappa_TOA_votes") == [None]
    never = df.withColumn("n_TOA_votes", F.lit(0))
    assert values(consensus.fleiss_kappa(never), "fleiss_kappa_TOA_votes") == [None]
    assert values(consensus.fleiss_kappa(df.limit(0)), "fleiss_kappa_TOA_votes") == [None]


# ---------------------------------------------------------------- geometry


@pytest.mark.parametrize("block", [1000, 16])
def test_nearest_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(200, 4)) + rng.integers(0, 4, size=(200, 1)) * 5
    pts[50:120] = pts[50]  # a third of the points are copies
    since = rng.integers(1, 10, size=200)
    until = since + rng.integers(0, 12, size=200)
    data = [(m, i, [float(x) for x in pts[i]], int(since[i]), int(until[i])) for m in (0, 1) for i in range(200)]
    points = spark.createDataFrame(data, "model INT, article_id BIGINT, coords ARRAY<DOUBLE>, since INT, until INT")
    queries = points.select("model", "article_id", F.col("since").alias("at"), "coords")
    got = neighbours.distance_summary(neighbours.nearest(queries, points, 7, block)).collect()
    assert len(got) == 400
    for r in got:
        i = r["article_id"]
        open_ = (since <= r["at"]) & (r["at"] <= until)
        d = np.sort(np.sqrt(((pts[open_] - pts[i]) ** 2).sum(axis=1)))[:7]
        assert r["n"] == len(d)
        assert math.isclose(r["mean"], d.mean(), abs_tol=1e-9) and math.isclose(r["std"], d.std(), abs_tol=1e-9)


@pytest.mark.parametrize("block", [1000, 16])
def test_kth_distances_at_all_times_against_brute_force(spark, block):
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(160, 3)) + 1e4  # far from the origin
    pts[20:60] = pts[20]
    since = rng.integers(1, 9, size=160)
    mult = rng.integers(1, 3, size=160)
    rows = [(0, i, [float(x) for x in pts[i]], int(since[i]), int(mult[i])) for i in range(160)]
    points = spark.createDataFrame(rows, "model INT, article_id BIGINT, coords ARRAY<DOUBLE>, since INT, mult BIGINT")
    got = neighbours.kth_distances(points.drop("mult"), points, 9, 4, block).collect()
    assert len(got) == (10 - since).sum()
    for r in got:
        there = np.flatnonzero(since <= r["at"])
        d = np.sort(np.repeat(np.sqrt(((pts[there] - pts[r["article_id"]]) ** 2).sum(axis=1)), mult[there]))
        assert (r["core"] is None) == (len(d) < 4)
        assert r["core"] is None or math.isclose(r["core"], d[3], abs_tol=1e-9)


def test_a_query_travels_to_one_task(spark, tmp_path, monkeypatch):
    """Rows shuffled: a query once, a point once for each task of its model."""
    monkeypatch.setattr(neighbours, "TASKS", 4)
    rng = np.random.default_rng(6)
    rows = [(0, i, [float(x) for x in rng.normal(size=8)], 1, 1) for i in range(600)]
    points = spark.createDataFrame(rows, "model INT, article_id BIGINT, coords ARRAY<DOUBLE>, since INT, until INT")
    queries = points.select("model", "article_id", F.lit(1).alias("at"), "coords")
    sent = []
    dealt = neighbours._dealt
    monkeypatch.setattr(neighbours, "_dealt", lambda a, b, n: sent.append((a.count(), b.count(), n)) or dealt(a, b, n))
    assert neighbours.nearest(queries, points, 5, 16).count() == 3000
    assert sent == [(600, 600 * 4, 4)]


def test_points_without_numbers_are_near_to_nothing(spark):
    rows = [(0, 1, [0.0, 1.0]), (0, 2, [float("nan"), 1.0]), (0, 3, [None, 1.0]), (0, 4, [float("inf"), 1.0]), (None, 5, [0.0, 1.0]), (0, 6, None)]
    df = spark.createDataFrame(rows, "model INT, article_id BIGINT, coords ARRAY<DOUBLE>").withColumns({"since": F.lit(1), "until": F.lit(1)})
    got = neighbours.nearest(df.withColumn("at", F.lit(1)), df, 3).collect()
    assert [(r["article_id"], r["neighbour"]) for r in got] == [(1, 1)]


def test_percentiles_and_missing_coordinates(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 2, 2.0), (0, 3, 5.0), (0, 4, None)], "model INT, article_id INT, x DOUBLE")
    got = {r["article_id"]: r["x_pct"] for r in geometry.percentiles(df, ["x"]).collect()}
    assert got == {1: 1.5 / 4, 2: 1.5 / 4, 3: 3 / 4, 4: None}
    with pytest.raises(ValueError):
        geometry.normalise_results(df.withColumn("snapshot_date", F.lit("2024-01-01")))


# ---------------------------------------------------------------- texts


def test_gazetteer_phrases_of_any_length(spark):
    df = spark.createDataFrame(
        [(1, "New York is new york, New York City"), (2, "York  New"), (3, None), (4, ""), (5, "a b a b a")], "article_id BIGINT, text STRING"
    )
    names = spark.createDataFrame(
        [("New York", "LOC"), ("New", "MISC"), ("New York City", "LOC"), ("a b a", "ORG"), ("a b a", "PER"), ("b  a", "PER"), (None, "PER"), ("", "ORG")],
        "phrase STRING, label STRING",
    )
    got = {tuple(r) for r in texts.gazetteer_mentions(df, names).collect()}
    assert got == {
        (1, "New York", "LOC", 2), (1, "New", "MISC", 2), (1, "New York City", "LOC", 1), (2, "New", "MISC", 1),
        (5, "a b a", "ORG", 2), (5, "a b a", "PER", 2),
    }


@pytest.mark.parametrize("few", [0, 100_000])
def test_words_of_texts_are_not_shuffled_to_few_phrases(spark, monkeypatch, few):
    monkeypatch.setattr(texts, "FEW_WORDS", few)
    df = spark.createDataFrame([(i, "of the und pour") for i in range(50)], "article_id BIGINT, text STRING")
    names = spark.createDataFrame([("of the", "ORG"), ("und", "PER")], "phrase STRING, label STRING")
    found = texts.gazetteer_mentions(df, names)
    assert found.count() == 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("broadcast" in plan) == (few > 0)


# ---------------------------------------------------------------- forward chaining


def test_grid_works_out_its_rows_once(spark, monkeypatch):
    rows = spark.range(10).select(F.regexp_count(F.col("id").cast("string"), F.lit("1")).alias("x"))
    seen = []
    monkeypatch.setattr(forward, "roll", lambda r, *rest: seen.append(r) or (None, None))
    forward.grid(rows, ["x"], [5, 6], [14, 28], None)
    assert len(seen) == 4
    assert all("regexp" not in r._jdf.queryExecution().optimizedPlan().toString() for r in seen)


# ---------------------------------------------------------------- share graph


def test_cutoff(spark):
    assert one(spark, social.cutoff(F.lit("2024-01-01"))) == datetime(2024, 1, 2)
    assert one(spark, social.cutoff(F.lit("2024-01-01 00:00:01"))) == datetime(2024, 1, 1, 0, 0, 1)


@pytest.mark.parametrize("block", [512, 3])
def test_projection_blocks(spark, block):
    rows = [(u, a, datetime(2024, 1, 1 + (u + a) % 3)) for u in range(4) for a in range(12) if (u * a) % 3 != 1]
    pairs = spark.createDataFrame(rows, "author_id INT, article_id INT, step TIMESTAMP_NTZ")
    got = {(r["a"], r["b"]): sum(h["c"] for h in r["hist"]) for r in social.projection(pairs, block).collect()}
    by_user = {}
    for u, a, _ in rows:
        by_user.setdefault(u, set()).add(a)
    want = {}
    for s in by_user.values():
        for a, b in itertools.combinations(sorted(s), 2):
            want[a, b] = want.get((a, b), 0) + 1
    assert got == want


def test_first_row_gives_the_cutoff(spark):
    rows = [("a", 1, datetime(2024, 5, 3, 9)), ("a", 2, datetime(2024, 5, 1, 9)), ("b", 3, datetime(2024, 5, 1))]
    df = spark.createDataFrame(rows, "article_id STRING, ingest_pos BIGINT, pub TIMESTAMP_NTZ")
    want = {"a": datetime(2024, 5, 3, 9), "b": datetime(2024, 5, 2)}
    assert {r["article_id"]: r["cut"] for r in social.cutoffs(df).collect()} == want
    assert {r["article_id"]: r["cut"].day for r in social.cutoffs(df.drop("ingest_pos")).collect()} == {"a": 1, "b": 2}


def test_no_shares_gives_zeros(spark):
    arts = spark.createDataFrame([(1, datetime(2024, 1, 1))], "article_id INT, pub TIMESTAMP_NTZ")
    row = social.social_features(arts, None).first()
    assert all(row[c] == 0.0 for c in social.SOCIAL_FEATURES)


def test_missing_author_is_one_user(spark):
    raw = spark.createDataFrame([("x", None, "2024-01-01"), ("y", None, "2024-01-01")], "media_url STRING, author_id STRING, created_at STRING")
    assert set(values(cleaning.prepare_shares(raw), "author_id")) == {"nan"}
    assert set(values(cleaning.prepare_shares(raw, unknown_author="drop"), "author_id")) == {None}


# ---------------------------------------------------------------- topics


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = (int(x) for x in rng.integers(1, 7, 2))
        c = rng.random((n, m))
        grid = c if n <= m else c.T
        best = min(sum(grid[i, p[i]] for i in range(min(n, m))) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        got = topics.assign(lambda a, b: grid[a:b], *grid.shape)
        assert len(set(got)) == min(n, m)
        assert math.isclose(sum(grid[r, k] for r, k in enumerate(got)), best, abs_tol=1e-9)


def topics_at(angles):
    """Centroids ``(model, at, cluster_id, centroid)`` on the unit circle, by snapshot."""
    return [(0, at, i, [math.cos(math.radians(x)), math.sin(math.radians(x))]) for at, xs in angles.items() for i, x in enumerate(xs)]


CENTROID = "model INT, at INT, cluster_id INT, centroid ARRAY<DOUBLE>"


def test_threshold_comes_after_assignment(spark):
    """Alone, topic 0 would go on as 1; the least total gives it to 0 and leaves 1 too far away."""
    rows = spark.createDataFrame(topics_at({1: [0, 60], 2: [-40, 0]}), CENTROID)
    assert {tuple(r) for r in topics.match_topics(rows).select("at", "prev", "cur").collect()} == {(2, 0, 0)}


def test_matches_of_odd_topics(spark):
    rows = topics_at({1: [0, 0, 90], 2: [90], 4: [0]}) + [(0, 5, 0, None), (0, 6, 0, [0.0, 0.0]), (0, 6, 1, [1.0, 0.0])]
    got = topics.match_topics(spark.createDataFrame(rows, CENTROID), 2.0).collect()
    assert {(r["at"], r["prev"], r["cur"], round(r["cost"], 9)) for r in got} == {(2, 2, 0, 0.0), (5, 0, 0, 1.0), (6, 0, 0, 1.0)}
    assert topics.match_topics(spark.createDataFrame([], CENTROID)).count() == 0


def test_wide_snapshots_are_matched_exactly(spark):
    """2,500 against 2,400 topics, the later ones being shifted copies, and as many of random direction."""
    rng = np.random.default_rng(3)
    old = rng.normal(size=(2500, 12))
    new = old[rng.permutation(2500)[:2400]] + rng.normal(scale=1e-3, size=(2400, 12))
    rows = [(m, at, i, [float(x) for x in c]) for m, later in ((0, new), (1, rng.normal(size=(2400, 12))))
            for at, side in ((1, old), (2, later)) for i, c in enumerate(side)]
    got = topics.match_topics(spark.createDataFrame(rows, CENTROID), 2.0).groupBy("model").agg(
        F.count_distinct("prev").alias("p"), F.count_distinct("cur").alias("c"), F.max("cost").alias("far")
    ).orderBy("model").collect()
    assert [(r["p"], r["c"]) for r in got] == [(2400, 2400)] * 2
    assert got[0]["far"] < 1e-3


def test_empty_snapshot_breaks_lineage(spark):
    nodes = spark.createDataFrame([(0, 1, 0), (0, 2, 0), (0, 4, 0), (0, 4, 1)], "model INT, at INT, cluster_id INT")
    links = spark.createDataFrame([(0, 2, 0, 0)], "model INT, at INT, prev INT, cur INT")
    got = {(r["at"], r["cluster_id"]): r["topic_id"] for r in topics.topic_lineage(nodes, links).collect()}
    assert got == {(1, 0): 0, (2, 0): 0, (4, 0): 1, (4, 1): 2}


def test_clusters_have_their_minimum_size(spark):
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(0, 0.1, (20, 3)), rng.normal(4, 0.1, (20, 3)), rng.normal(0, 9, (6, 3))])
    rows = [(0, 2, i, 1 + i % 2, [float(x) for x in p]) for i, p in enumerate(pts)]
    rows += [(0, 1, i, 1, c) for (_, _, i, f, c) in rows if f == 1]
    df = spark.createDataFrame(rows, "model INT, at INT, article_id BIGINT, first_at INT, coords ARRAY<DOUBLE>")
    got = topics.density_clusters(df, quantile=0.8).where("at = 2").collect()
    found = {r["article_id"]: r["cluster_id"] for r in got}
    assert len(found) == 46 and len({found[i] for i in range(20)} & {found[i] for i in range(20, 40)} - {-1}) == 0
    sizes = {}
    for c in found.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert all(n >= 5 for c, n in sizes.items() if c >= 0) and max(found.values()) >= 1
    assert all(0 <= r["outlier_score"] <= 1 for r in got)


@pytest.mark.parametrize(
    "places",
    [
        [0, 0.1, 0.2, 0.3, 0.4, 0.85, 0.95, 1.05, 1.15, 1.25],  # 0.4 and 0.85 are no neighbours of each other's list
        [0.0] * 6 + [0.01] * 6,  # copies fill the lists
    ],
)
def test_clusters_hold_all_links_within_epsilon(spark, places):
    rows = [(0, 1, i, 1, [float(x)]) for i, x in enumerate(places)]
    df = spark.createDataFrame(rows, "model INT, at INT, article_id BIGINT, first_at INT, coords ARRAY<DOUBLE>")
    assert set(values(topics.density_clusters(df, epsilon=0.5), "cluster_id")) == {0}


@pytest.mark.parametrize("block", [1000, 16])
def test_links_within_epsilon_against_brute_force(spark, block):
    rng = np.random.default_rng(8)
    pts = rng.random((150, 2)) * 10
    data = [(m, t, i, [float(x) for x in pts[i]], 0.6 + 0.1 * t) for m in (0, 1) for t in (1, 2) for i in range(75 * t)]
    df = spark.createDataFrame(data, "model INT, at INT, node BIGINT, coords ARRAY<DOUBLE>, eps DOUBLE")
    links = neighbours.links_within(df, block)
    got = topics.connected_components(df.select("model", "at", "node"), links, ["model", "at"]).collect()
    for t in (1, 2):
        close = np.sqrt(((pts[: 75 * t, None] - pts[None, : 75 * t]) ** 2).sum(axis=2)) <= 0.6 + 0.1 * t
        label = np.arange(75 * t)
        for _ in range(75 * t):
            label = np.where(close, label[None, :], 75 * t).min(axis=1)
        for m in (0, 1):
            assert {r["node"]: r["label"] for r in got if r["at"] == t and r["model"] == m} == dict(enumerate(label))
    if block == 1000:  # one meeting per snapshot: fewer links than its two sides have points
        assert links.count() < 2 * 2 * 225
    assert neighbours.links_within(df.limit(0)).count() == 0


# ---------------------------------------------------------------- experiments


def test_folds_are_disjoint_and_balanced(spark):
    rows = [(g, i) for g in range(30) for i in range(1 + (g % 4) ** 2)]
    df = spark.createDataFrame(rows, "g INT, i INT")
    out = experiments.group_folds(df, "g", 4).collect()
    assert len(out) == len(rows)
    fold, load = {}, {}
    for r in out:
        assert fold.setdefault(r["g"], r["fold"]) == r["fold"]
        load[r["fold"]] = load.get(r["fold"], 0) + 1
    assert len(load) == 4 and max(load.values()) - min(load.values()) <= 10


def test_t_tail_and_effect_size(spark):
    # quantiles and tails from printed tables
    tails = [
        (0.0, 1, 1.0), (0.0, 30, 1.0), (1.0, 1, 0.5), (12.7062047, 1, 0.05), (4.30265273, 2, 0.05), (3.18244631, 3, 0.05),
        (2.776445105, 4, 0.05), (-2.776445105, 4, 0.05), (2.26215716, 9, 0.05), (3.24983554, 9, 0.01), (2.04227246, 30, 0.05),
        (math.inf, 4, 0.0),
    ]
    for t, df in [(1.9, 999), (1.9, 1000), (1.9, 1001), (0.3, 5000), (5.0, 1_000_000)]:  # areas by small steps
        wide = np.linspace(0, min(math.pi / 2, 14 / math.sqrt(df)), 2_000_001)
        height = np.exp((df - 1) * np.log(np.cos(wide[:-1] + (wide[1] - wide[0]) / 2)))
        tails.append((t, df, height[wide[:-1] >= math.atan(t / math.sqrt(df))].sum() / height.sum()))
    for t, df, p in tails:
        assert math.isclose(one(spark, significance.t_tail(F.lit(t), F.lit(df))), p, abs_tol=2e-6 if df > 30 else 1e-8), (t, df)
    assert one(spark, significance.t_tail(F.lit(1.0), F.lit(0))) is None
    dz = [one(spark, significance.cohens_dz(F.lit(m), F.lit(s), F.lit(n))) for m, s, n in [(0.0, 0.0, 5), (0.1, 0.0, 5), (0.2, 0.1, 5), (0.2, 0.1, 1)]]
    assert dz == [0.0, math.inf, 2.0, None]


def test_equal_differences_have_no_spread(spark):
    rows = [(a, f, s, s, s) for a, base in (("all_features", 0.5), ("no_geom", 0.4)) for f in range(1, 6) for s in [base + f / 100]]
    folds = spark.createDataFrame(rows, "ablation STRING, fold INT, F1 DOUBLE, Precision DOUBLE, Recall DOUBLE")
    row = significance.paired_tests(folds, 4).where("metric = 'F1'").first()
    assert row["std_diff"] == 0 and row["cohens_dz"] == math.inf and row["paired_t_p"] == 0 and row["paired_t_sig"] == "***"


def test_ablation_lists():
    groups = features.ablations(["article_url", "label_TOA", *features.MATRIX_FEATURES])
    assert len(features.MATRIX_FEATURES) == 52 and len(groups) == 7
    assert "n_models_present" in groups["only_geom"] and set(groups["no_text"]) | set(groups["only_text"]) == set(groups["all_features"])
    assert "only_social" not in features.ablations(["len_words"])


def test_feature_matrix_needs_labels(spark):
    with pytest.raises(ValueError):
        features.wide_labels_to_long(spark.createDataFrame([(1, 2)], "article_id INT, other INT"))


def test_bootstrap_brackets_the_score(spark):
    rows = [(int(i % 3 == 0), ((i * 53) % 100) / 100.0) for i in range(300)]
    df = spark.createDataFrame(rows, "y INT, p DOUBLE")
    f1 = forward.cell(df).first()["F1"]
    got = forward.bootstrap_interval(df, 1, 500).first()
    assert got["lo"] <= f1 <= got["hi"]
    y, p = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]) >= 0.5
    rng, plain = np.random.default_rng(0), []
    for _ in range(500):
        i = rng.integers(0, 300, 300)
        tp, wrong = (y[i] & p[i]).sum(), (y[i] != p[i]).sum()
        plain.append(2 * tp / (2 * tp + wrong))
    lo, hi = np.percentile(plain, [2.5, 97.5])
    assert abs(lo - got["lo"]) < 0.03 and abs(hi - got["hi"]) < 0.03


def test_overlapping_splits_are_refused(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 0)], "media_url INT, TA STRING, y INT")
    with pytest.raises(ValueError):
        forward.load(df, df)


# ---------------------------------------------------------------- attributions


def test_too_few_of_a_class_gives_no_attributions(spark):
    rows = [(f"u{i}", 1, int(i == 0), float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "article_url STRING, agreement_k INT, label_TOA INT, x DOUBLE")
    with pytest.warns(UserWarning):
        assert shapley.explain_out_of_fold(df, 1, ["x"], experiments.Settings()).count() == 0
    with pytest.raises(ValueError):
        shapley.explain_out_of_fold(df.where("label_TOA = 0"), 1, ["x"], experiments.Settings())


def test_attributions_against_brute_force():
    rng = np.random.default_rng(2)
    leaves = []
    for _ in range(4):
        a, b, c = rng.normal(size=3)
        f, g = rng.choice(4, 2, replace=False)
        inf = np.inf
        leaves += [
            (rng.normal(), {f: (-inf, a), g: (-inf, b)}),
            (rng.normal(), {f: (-inf, a), g: (b, inf)}),
            (rng.normal(), {f: (a, inf), int((f + 1) % 4): (-inf, c)} if (f + 1) % 4 != f else {f: (a, inf)}),
            (rng.normal(), {f: (a, inf), int((f + 1) % 4): (c, inf)}),
        ]
    x, base = rng.normal(size=(5, 4)), rng.normal(size=(6, 4))
    phi, p, mean = shapley.attributions(leaves, x, base)
    assert np.allclose(phi.sum(axis=1), p - mean)
    margin = lambda z: shapley._margin(leaves, z)
    want = np.zeros_like(phi)
    for i, xi in enumerate(x):
        for bi in base:
            value = {}
            for mask in range(16):
                z = np.where([mask >> j & 1 for j in range(4)], xi, bi)
                value[mask] = margin(z[None])[0]
            mx, mb = value[15], value[0]
            px, pb = 1 / (1 + np.exp(-2 * mx)), 1 / (1 + np.exp(-2 * mb))
            scale = 2 * px * (1 - px) if abs(mx - mb) < 1e-12 else (px - pb) / (mx - mb)
            for j in range(4):
                for mask in range(16):
                    if not mask >> j & 1:
                        k = bin(mask).count("1")
                        w = math.factorial(k) * math.factorial(3 - k) / 24
                        want[i, j] += w * (value[mask | 1 << j] - value[mask]) * scale / len(base)
    assert np.allclose(phi, want)
