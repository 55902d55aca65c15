"""Communities by modularity, for many graphs at once.

Every article starts alone.  A round works out the best move of every node to a neighbouring community;
a move is made where it is the best of all that touch either of its two communities.  Moves of a round
thus concern different pairs of communities, their gains add up exactly, and modularity rises with every round.
When no article gains by moving, communities are contracted to single nodes and move in the same way; articles move
again after that, until neither changes anything.  Gains are whole numbers (modularity times
twice the squared weight), so nothing hangs on rounding, and each graph goes its own way
whatever others are in the table.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.session import stage

FEW = 1 << 16  # edges that one task works on at once; larger graphs go by joins


def _settle(rows: dict, label: dict, total: int) -> bool:
    """Moves of one graph until none gains; ``rows``: node -> {neighbour: weight}.  True if any was made."""
    degree = {i: sum(r.values()) for i, r in rows.items()}
    held = defaultdict(int)
    for i, c in label.items():
        held[c] += degree[i]
    any_move = False
    while True:
        moves, best = [], {}
        for i, r in rows.items():
            near = defaultdict(int)
            for j, w in r.items():
                if j != i:
                    near[label[j]] += w
            own = label[i]
            stay = near.pop(own, 0)
            options = [(total * (w - stay) - degree[i] * (held[c] - held[own] + degree[i]), -c) for c, w in near.items()]
            gain, to = max(options, default=(0, 0))
            if gain > 0:
                move = (gain, -i, own, -to)
                moves.append(move)
                for c in (own, -to):
                    best[c] = max(best.get(c, move), move)
        made = [m for m in moves if best[m[2]] == m == best[m[3]]]
        if not made:
            return any_move
        any_move = True
        for _, i, own, to in made:
            label[-i] = to
            held[own] -= degree[-i]
            held[to] += degree[-i]


def _communities(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = defaultdict(lambda: defaultdict(int))
    for a, b, w in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["weight"].tolist()):
        rows[a][b] += w
    total = sum(sum(r.values()) for r in rows.values())
    label = {i: i for i in rows}
    while True:
        _settle(rows, label, total)
        whole = defaultdict(lambda: defaultdict(int))
        for i, r in rows.items():
            for j, w in r.items():
                whole[label[i]][label[j]] += w
        moved = {c: c for c in whole}
        if not _settle(whole, moved, total):
            break
        label = {i: moved[c] for i, c in label.items()}
    first = {}
    for i, c in label.items():
        first[c] = min(first.get(c, i), i)
    return pd.DataFrame({"article_id": list(label), "community": [first[c] for c in label.values()]})


def _whole(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,0)")


def best_moves(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``cut, node, own, to, gain`` of the best move of every node that gains by one.

    ``edges``: cut, a, b, weight, both ways.  ``labels``: cut, node, label.
    """
    degree = edges.groupBy("cut", F.col("a").alias("node")).agg(F.sum("weight").alias("degree"))
    mine = labels.join(degree, ["cut", "node"])
    held = mine.groupBy("cut", "label").agg(F.sum("degree").alias("held"))
    total = degree.groupBy("cut").agg(F.sum("degree").alias("total"))
    ends = labels.select("cut", F.col("node").alias("b"), F.col("label").alias("to"))
    near = edges.where("a <> b").join(ends, ["cut", "b"]).groupBy("cut", F.col("a").alias("node"), "to").agg(F.sum("weight").alias("w"))
    here = near.join(mine.withColumnRenamed("label", "own"), ["cut", "node"])
    stay = here.where("own = to").select("cut", "node", F.col("w").alias("stay"))
    away = here.where("own <> to").join(stay, ["cut", "node"], "left").join(total, "cut")
    away = away.join(held.select("cut", F.col("label").alias("to"), F.col("held").alias("there")), ["cut", "to"])
    away = away.join(held.select("cut", F.col("label").alias("own"), F.col("held").alias("left")), ["cut", "own"])
    more = _whole(F.col("w") - F.coalesce("stay", F.lit(0)))
    gain = _whole("total") * more - _whole("degree") * _whole(F.col("there") - F.col("left") + F.col("degree"))
    picked = away.withColumn("gain", gain).where(F.col("gain") > 0).groupBy("cut", "node", "own")
    return picked.agg(F.max(F.struct("gain", -F.col("to"))).alias("best")).select(
        "cut", "node", "own", (-F.col("best").getField("col2")).alias("to"), F.col("best.gain").alias("gain")
    )


def settle(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, bool]:
    """Labels after moves until no node of any graph gains, and whether there were any."""
    any_move = False
    while True:
        moves = stage(best_moves(edges, labels))
        order = F.struct("gain", -F.col("node"), "own", "to")
        touched = moves.select("cut", F.explode(F.array("own", "to")).alias("label"), order.alias("move"))
        best = touched.groupBy("cut", "label").agg(F.max("move").alias("best"))
        made = moves.withColumn("move", order)
        for side in ("own", "to"):
            there = best.select("cut", F.col("label").alias(side), F.col("best").alias(f"best_{side}"))
            made = made.join(there, ["cut", side])
        made = stage(made.where("move = best_own and move = best_to").select("cut", "node", "to"))
        if made.isEmpty():
            return labels, any_move
        any_move = True
        labels = stage(labels.join(made, ["cut", "node"], "left").select("cut", "node", F.coalesce("to", "label").alias("label")))


def by_joins(edges: DataFrame) -> DataFrame:
    """``cut, article_id, community`` of graphs of any size."""
    edges = stage(edges.groupBy("cut", "a", "b").agg(F.sum("weight").alias("weight")))
    labels = edges.select("cut", F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    labels = stage(labels)
    while True:
        labels, _ = settle(edges, labels)
        one = labels.select("cut", F.col("node").alias("a"), F.col("label").alias("la"))
        two = labels.select("cut", F.col("node").alias("b"), F.col("label").alias("lb"))
        whole = edges.join(one, ["cut", "a"]).join(two, ["cut", "b"])
        whole = stage(whole.groupBy("cut", F.col("la").alias("a"), F.col("lb").alias("b")).agg(F.sum("weight").alias("weight")))
        start = stage(whole.select("cut", F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
        moved, changed = settle(whole, start)
        if not changed:
            break
        labels = stage(labels.join(moved.select("cut", F.col("node").alias("label"), F.col("label").alias("to")), ["cut", "label"]).select("cut", "node", F.col("to").alias("label")))
    first = labels.groupBy("cut", "label").agg(F.min("node").alias("community"))
    return labels.join(first, ["cut", "label"]).select("cut", F.col("node").alias("article_id"), "community")


def modularity_communities(graph: DataFrame, few: int = FEW) -> DataFrame:
    """``cut, article_id, community``: the community of every linked article at every cut-off, named by its
    smallest article.

    ``graph``: cut, a, b, weight, both directions, whole weights (``graph_at``).  A graph of at most ``few`` rows is worked on
    in one task, larger ones by joins; both make the same moves.  Moving a single article, or a whole
    community into another, raises modularity nowhere in the result.
    """
    kinds = {f.name: f.dataType.simpleString() for f in graph.schema.fields}
    rows = stage(graph.select("cut", "a", "b", "weight"))
    size = rows.groupBy("cut").agg(F.count("*").alias("n"))
    small = rows.join(size.where(F.col("n") <= few).select("cut"), "cut", "left_semi")
    large = rows.join(size.where(F.col("n") > few).select("cut"), "cut", "left_semi")

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _communities(pdf).assign(cut=key[0])

    found = small.groupBy("cut").applyInPandas(work, f"article_id {kinds['a']}, community {kinds['a']}, cut {kinds['cut']}")
    found = found.select("cut", "article_id", "community")
    return found if large.isEmpty() else found.unionByName(by_joins(large))
