"""Round 4: work that grows with the tables, and the whole grid of settings."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from harbinger.functions.keyed import exact_quantile
from harbinger.operators import forward, hierarchy, neighbours, topics
from harbinger.operators.experiments import Settings
from harbinger.plans.catalog import forward as catalog

SNAPSHOTS = "model INT, at INT, article_id BIGINT, first_at INT, coords ARRAY<DOUBLE>"
POINTS = "model INT, at INT, node BIGINT, coords ARRAY<DOUBLE>, core DOUBLE"


def blobs(n, seed, times):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(-6, 6, (5, 2))[rng.integers(0, 5, n)] + rng.normal(0, 0.4, (n, 2)), 2)
    x[: n // 10] = x[n // 2 : n // 2 + n // 10]  # copies
    rows = []
    for i in range(n):
        first = 1 + i % times
        rows += [(seed % 2, at, i, first, [float(c) for c in x[i]]) for at in range(first, times + 1)]
    return rows


def test_one_task_a_snapshot_gives_what_joins_give(spark, monkeypatch):
    df = spark.createDataFrame(blobs(160, 4, 3) + blobs(60, 5, 3), SNAPSHOTS).localCheckpoint()
    want = {tuple(r) for r in hierarchy.hierarchical_clusters(df, few=30).withColumn("outlier_score", F.round("outlier_score", 9)).collect()}
    monkeypatch.setattr(hierarchy, "births", None)  # small snapshots need no joins
    got = {tuple(r) for r in hierarchy.hierarchical_clusters(df).withColumn("outlier_score", F.round("outlier_score", 9)).collect()}
    assert got == want and len(got) == df.count()
    assert max(r[3] for r in got) > 1


@pytest.mark.parametrize("at_once", [True, False])
def test_clusters_of_no_excess_do_not_hang_on_rounding(spark, at_once):
    """Two chains enter, and meet, at one distance: both weigh exactly nothing, which is no less than nothing."""
    chains = [[0, 1, 2, 3, 4, 20], [5, 6, 7, 8, 9, 21]]
    links = [(a, b) for c in chains for a, b in zip(c, c[1:])] + [(20, 21)]
    weights = [0.1 + 0.013 * m for m in range(12)]
    nodes = [(m, 1, i, 1, w) for m, w in enumerate(weights) for c in chains for i in c]
    edges = [(m, 1, a, b, w) for m, w in enumerate(weights) for a, b in links]
    nodes = spark.createDataFrame(nodes, "model INT, at INT, node BIGINT, mult BIGINT, core DOUBLE")
    edges = spark.createDataFrame(edges, "model INT, at INT, a BIGINT, b BIGINT, w DOUBLE")
    found = hierarchy._by_snapshot(nodes, edges, 6) if at_once else hierarchy._by_joins(nodes, edges, 6, 1 << 18)
    got = {(r["model"], r["node"]): r["chosen"] for r in found.collect()}
    assert got == {(m, i): k for m in range(len(weights)) for k, c in enumerate(chains) for i in c}


@pytest.mark.parametrize("few", [10**6, 0])
def test_forest_of_a_snapshot_that_tasks_share(spark, monkeypatch, few):
    rng = np.random.default_rng(8)
    x = np.unique(np.round(rng.normal(0, 2, (110, 2)) * 2) / 2, axis=0)
    core = rng.uniform(0.2, 1.5, len(x)).round(1)
    core[:3] = 0.0
    rows = [(0, at, i, [float(c) for c in p], float(k)) for at in (1, 2, 4) for i, (p, k) in enumerate(zip(x, core)) if i % at == 0]
    monkeypatch.setattr(neighbours, "HELD", 1)
    got = {(r["at"], r["a"], r["b"], round(r["w"], 9)) for r in hierarchy.spanning_forest(spark.createDataFrame(rows, POINTS), 16, few).collect()}
    w = np.maximum(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), np.maximum(core[:, None], core[None]))
    want = set()
    for at in (1, 2, 4):
        here = [i for i in range(len(x)) if i % at == 0]
        up = {i: i for i in here}
        for weight, i, j in sorted((w[i, j], i, j) for i in here for j in here if i < j):
            a, b = up[i], up[j]
            if a != b:
                up = {k: a if c == b else c for k, c in up.items()}
                want.add((at, i, j, round(weight, 9)))
    assert got == want


def test_points_travel_once_a_group_of_snapshots(spark, monkeypatch):
    """Not once for every pair of blocks of every snapshot."""
    seen = []
    dealt = neighbours._dealt

    def counted(asked, visitors, tasks):
        out = dealt(asked, visitors, tasks)
        seen.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "_dealt", counted)
    df = spark.createDataFrame([(0, at, i, [float(i % 37), float(i // 37)], 1.0) for at in range(1, 65) for i in range(200)], POINTS)
    assert hierarchy.spanning_forest(df, 32).count() == 64 * 199
    assert max(seen) <= 200 * neighbours.TASKS


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.999, 1.0])
def test_exact_quantile(spark, share):
    rng = np.random.default_rng(2)
    groups = {0: rng.normal(0, 1, 3000).round(3), 1: np.repeat([1.0, 2.0], [5, 5]), 2: np.array([7.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [(0, None), (3, None)]
    got = dict(exact_quantile(spark.createDataFrame(rows, "g INT, v DOUBLE"), ["g"], "v", share, "q").collect())
    assert got == {g: np.sort(x)[max(0, int(np.ceil(len(x) * share)) - 1)] for g, x in groups.items()}


def arrow(spark, rows, schema):
    return spark.createDataFrame(rows, schema).toArrow()


def looked_at(monkeypatch):
    """Pairs that the sieve is given, and whether it is given a bound for every time."""
    seen, pairs = [], neighbours._Filter.pairs

    def counted(self, y, limit, times=None):
        seen.append((len(self.a) * len(y), times is not None))
        return pairs(self, y, limit, times)

    monkeypatch.setattr(neighbours._Filter, "pairs", counted)
    return seen


def test_links_look_only_beside_the_largest_component(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 2000
    x = np.concatenate([rng.normal(0, 0.3, (n - 40, 6)), rng.normal(0, 2.0, (40, 6))])
    rows = [(0, 1, i, [float(c) for c in p], 0.8) for i, p in enumerate(x)]
    table = arrow(spark, rows, "model INT, at INT, node BIGINT, coords ARRAY<DOUBLE>, eps DOUBLE")
    seen = looked_at(monkeypatch)
    links = neighbours._Links(table, 64)
    assert sum(m for m, _ in seen) < n * n / 4
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.8
    label = np.arange(n)
    while True:
        low = np.where(d, label[None], n).min(axis=1)
        if (low == label).all():
            break
        label = low
    up = np.arange(n)
    for a, b in links.made:
        a, b = up[a], up[b]
        up[up == max(a, b)] = min(a, b)
    assert (up == label).all()


def test_histories_need_no_bound_for_every_pair(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 1500
    x, since = rng.normal(0, 1, (n, 3)), 1 + np.arange(n) % 10
    rows = [(0, i, int(t), 1, [float(c) for c in p]) for i, (p, t) in enumerate(zip(x, since))]
    table = arrow(spark, rows, "model INT, article_id BIGINT, since INT, mult BIGINT, coords ARRAY<DOUBLE>")
    seen = looked_at(monkeypatch)
    state = neighbours._Rising(table, 4, 128, 10)
    for part in (table.slice(0, 700), table.slice(700)):
        state.meet(part)
    assert sum(m for m, timed in seen if timed) < sum(m for m, _ in seen) / 4
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for at in (1, 5, 10):
        kth = np.sort(np.where(since[None] <= at, d, np.inf), axis=1)[:, 3]
        mine = since[state.ids] <= at
        assert np.allclose(state.bound[mine, at - 1], kth[state.ids[mine]])


def test_reconstruction_holds_articles_not_their_snapshots(spark, monkeypatch):
    kept, keep = [], topics.keep
    monkeypatch.setattr(topics, "keep", lambda df: kept.append(df) or keep(df))
    rng = np.random.default_rng(3)
    day = datetime.date(2024, 1, 1)
    mid = np.array([[5.0, 0.0], [0.0, 5.0]])
    ids = [*range(60), 7, 7]  # an article in three rows, of different days
    dated = [(i, day + datetime.timedelta(days=k % 4), day + datetime.timedelta(days=k % 4)) for k, i in enumerate(ids)] + [(99, day, day + datetime.timedelta(days=9))]
    articles = spark.createDataFrame(dated, "article_id BIGINT, pub DATE, snapshot_date DATE")
    coords = spark.createDataFrame([(0, i, [float(c) for c in mid[i % 2] + rng.normal(0, 0.2, 2)]) for i in range(60)], "model INT, article_id BIGINT, coords ARRAY<DOUBLE>")
    got = topics.reconstruct(articles, coords, 2, epsilon=0.5).collect()
    assert all("at" not in df.columns for df in kept) and kept
    days = [d for d in range(4)] + [9]
    for d in days:
        here = [r for r in got if r["snapshot_date"] == day + datetime.timedelta(days=d)]
        want = sum(k % 4 <= d for k in range(len(ids)))
        seven = [k % 4 for k, i in enumerate(ids) if i == 7 and k % 4 <= d]
        assert len(here) == want - len(seven) + len(seven) ** 2  # rows of one article meet each other
        assert {r["topic_id"] for r in here} <= {-1, 0, 1}


def test_the_grid_has_all_settings_and_full_models(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(catalog.W, "grid", lambda rows, features, *rest: asked.append(rest))
    monkeypatch.setattr(catalog.W, "grid_summary", lambda table: table)
    monkeypatch.setattr(catalog.inputs, "dated_rows", lambda spark, sf_dir: None)
    catalog.chain_grid(spark, "")
    assert asked == [([1, 2, 3, 4], [7, 14, 21, 28], Settings())]
    assert asked[0][2].rounds == 300


def test_the_grid_fits_an_origin_once_and_scores_as_single_runs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(240):
        a = rng.normal()
        rows.append((i, start + datetime.timedelta(days=int(i * 13 % 42)), int(a + rng.normal(0, 0.7) > 0), "s", a, rng.normal()))
    df = spark.createDataFrame(rows, "media_url INT, TA TIMESTAMP_NTZ, y INT, true_subclass STRING, f DOUBLE, g DOUBLE").coalesce(1)
    s, fits, fit = Settings(rounds=2), [], forward.fit
    monkeypatch.setattr(forward, "fit", lambda *args: fits.append(1) or fit(*args))
    got = {(r["warmup"], r["window"]): r for r in forward.grid(df, ["f", "g"], [1, 2], [7, 14], s).collect()}
    assert len(fits) == 4  # weeks 1 to 4, whatever settings lead there
    assert len(got) == 4
    for warmup in (1, 2):
        for w in (7, 14):
            predictions, _ = forward.roll(df, ["f", "g"], warmup, w, s)
            c, mine = forward.cell(predictions).first(), got[f"{warmup}w", f"{w}d"]
            assert (mine["n"], mine["pos"], mine["F1"]) == (c["n"], c["pos"], round(c["F1"], 3))
            assert mine["single_window"] == (predictions.select("origin").distinct().count() == 1)
