"""Communities by modularity: both ways of working, graphs that do not disturb each other, and known partitions."""

import itertools
import random

from harbinger.operators import modularity

SCHEMA = "cut INT, a LONG, b LONG, weight LONG"


def graphs(seed=4):
    """Three groups with many links inside at cut 1, random graphs at others."""
    draw = random.Random(seed)
    rows = []
    for cut in (1, 2, 3):
        n = 24
        for a, b in itertools.combinations(range(n), 2):
            near = cut == 1 and a % 3 == b % 3
            if draw.random() < (0.8 if near else 0.05 if cut == 1 else 0.15):
                rows += [(cut, a, b, w := draw.randint(1, 4)), (cut, b, a, w)]
    return rows


def parts(df, **options):
    return {(r["cut"], r["article_id"]): r["community"] for r in modularity.modularity_communities(df, **options).collect()}


def quality(rows, label, cut):
    mine = [r for r in rows if r[0] == cut]
    total = sum(w for *_, w in mine)
    degree, inside = {}, 0
    for _, a, b, w in mine:
        degree[a] = degree.get(a, 0) + w
        inside += w * (label[a] == label[b])
    held = {}
    for a, k in degree.items():
        held[label[a]] = held.get(label[a], 0) + k
    return inside / total - sum(s * s for s in held.values()) / total**2


def test_planted_groups_and_single_moves(spark):
    rows = graphs()
    got = parts(spark.createDataFrame(rows, SCHEMA))
    assert {a: got[1, a] for a in range(24)} == {a: a % 3 for a in range(24)}
    for cut in (1, 2, 3):
        label = {a: c for (k, a), c in got.items() if k == cut}
        now = quality(rows, label, cut)
        for a, c in itertools.product(label, set(label.values())):
            assert quality(rows, {**label, a: c}, cut) <= now + 1e-12
        for c, d in itertools.combinations(set(label.values()), 2):
            assert quality(rows, {a: c if x == d else x for a, x in label.items()}, cut) <= now + 1e-12


def test_joins_make_the_same_moves_and_graphs_go_their_own_way(spark):
    rows = graphs(9)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = parts(df)
    assert parts(df.where("cut > 1"), few=0) == {k: c for k, c in whole.items() if k[0] > 1}
    assert parts(df.where("cut = 3")) == {k: c for k, c in whole.items() if k[0] == 3}


def test_no_graph(spark):
    assert parts(spark.createDataFrame([], SCHEMA)) == {}
    assert parts(spark.createDataFrame([(1, 5, 9, 2), (1, 9, 5, 2)], SCHEMA)) == {(1, 5): 5, (1, 9): 5}
