"""Approximate nearest neighbours by cosine: NN-descent and greedy graph search.

The graph is built over distinct vectors, so a group of copies is one node however large.
Lists start from blocks of at most about ``BLOCK`` vectors that share the signs of a few random
projections (one more blocking is by hash alone).  A round of NN-descent then joins every
node's neighbours, forward and a drawn share of the reverse ones, with each other: whoever
finds a nearer neighbour among the neighbours of a neighbour takes it.  Pairs of two old
neighbours were compared before and are left out.  Rounds end when few entries change.

A search keeps the ``beam`` nearest nodes found for a query and follows the links of those
not followed yet, all queries at once, until nobody has any left.  Searches score exactly,
in double precision; the graph itself compares half-precision directions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harbinger.session import stage

BLOCK = 1024
MEMBERS = 6  # smallest ids that a node can contribute to one answer of five, the asker among them
SLICE = 256  # nodes whose neighbours are compared at a time


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the rows that take part.

    Null, empty and zero vectors and those with null or non-finite components take no part,
    neither do rows without an id.  A repeated row counts once; an id with several vectors
    stands for the smallest of them.  Other columns are not read.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    kept = rows.where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0.0))
    return kept.groupBy("vec_id").agg(F.min("v").alias("v"))


def members(rows: DataFrame) -> DataFrame:
    """``node, vec_id, v``: at most MEMBERS ids of each distinct vector, the smallest names the node."""
    same = Window.partitionBy("v")
    first = rows.withColumn("_r", F.row_number().over(same.orderBy("vec_id"))).where(F.col("_r") <= MEMBERS)
    return first.select(F.min("vec_id").over(same).alias("node"), "vec_id", "v")


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest part near 1: exact, and nothing overflows."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists of doubles as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def directions(nodes: DataFrame, tables: int) -> DataFrame:
    """``node, dim, unit, codes``: the direction in half precision, one sign code per blocking."""
    sizes = {r["d"]: r["n"] for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    bits = {d: min(30, max(0, math.ceil(math.log2(n / BLOCK)))) for d, n in sizes.items()}

    def place(batches):
        for batch in batches:
            column = batch.column("v")
            dims = np.diff(column.offsets.to_numpy()) if len(column) else np.array([], int)
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = scaled(matrix(part.column("v")))
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                planes = np.random.default_rng(d).standard_normal((d, tables * bits[d]))
                signs = (x @ planes > 0).reshape(len(x), tables, bits[d])
                codes = (signs << np.arange(bits[d])).sum(axis=2) if bits[d] else np.zeros((len(x), tables), int)
                codes = np.hstack([codes, np.zeros((len(x), 1), int)])
                unit = [row.tobytes() for row in x.astype("<f2")]
                yield pa.record_batch(
                    [part.column("node"), pa.array(np.full(len(x), d, "i4")), pa.array(unit, pa.binary()),
                     pa.array(list(codes.astype("i4")), pa.list_(pa.int32()))],
                    names=["node", "dim", "unit", "codes"],
                )

    return nodes.mapInArrow(place, "node LONG, dim INT, unit BINARY, codes ARRAY<INT>")


def units(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f2").reshape(len(column), dim).astype("f4")


def first_lists(placed: DataFrame, width: int) -> DataFrame:
    """``a, b, s``: the nearest within each block.  A code with many vectors has many blocks."""
    spread = placed.select("node", "dim", "unit", F.posexplode("codes").alias("t", "code"))
    keys = ["dim", "t", "code"]
    parts = spread.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node", "t"), F.col("parts")).cast("int")

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        x = units(table.column("unit").combine_chunks(), table.column("dim")[0].as_py())
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        k = min(width, len(ids) - 1)
        best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), int)
        return pa.table({"a": np.repeat(ids, k), "b": ids[best.ravel()], "s": np.take_along_axis(s, best, 1).ravel()})

    blocks = spread.join(parts, keys).withColumn("part", part).groupBy(*keys, "part")
    return blocks.applyInArrow(compare, "a LONG, b LONG, s FLOAT")


def best(pairs: DataFrame, width: int) -> DataFrame:
    """The ``width`` nearest of every node; each task trims its own rows before they move."""
    once = pairs.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("a").orderBy(F.col("s").desc(), "b")
    return once.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= width).drop("_r")


def reverse(graph: DataFrame, width: int, order) -> DataFrame:
    """At most ``width`` nodes that list a node, the first ones in ``order``."""
    w = Window.partitionBy("u").orderBy(order, "c")
    turned = graph.select(F.col("b").alias("u"), F.col("a").alias("c"), "s", "fresh")
    return turned.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= width).drop("_r")


def compare_neighbours(batches):
    """Rows ``dim, near``: the neighbours of one node.  Gives a, b, s where b is nearer to a than
    the last entry of its list and one of the two is new here."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            rows = batch.slice(start, SLICE)
            for d in np.unique(rows.column("dim").to_numpy()):
                part = rows.filter(pa.array(rows.column("dim").to_numpy() == d))
                lens = np.array([len(x) for x in part.column("near")])
                flat = part.column("near").flatten()
                shape = (len(lens), lens.max())
                filled = np.arange(shape[1]) < lens[:, None]
                ids, last = np.zeros(shape, "i8"), np.full(shape, np.inf, "f4")
                fresh, x = np.zeros(shape, bool), np.zeros((*shape, d), "f4")
                ids[filled] = flat.field("c").to_numpy()
                last[filled] = flat.field("last").to_numpy()
                fresh[filled] = flat.field("fresh").to_numpy(zero_copy_only=False)
                x[filled] = units(flat.field("unit"), d)
                s = x @ x.transpose(0, 2, 1)
                new = (s > last[:, :, None]) & filled[:, None, :] & (fresh[:, :, None] | fresh[:, None, :])
                new &= ids[:, :, None] != ids[:, None, :]
                row, i, j = np.nonzero(new)
                yield pa.record_batch([pa.array(ids[row, i]), pa.array(ids[row, j]), pa.array(s[row, i, j])], names=["a", "b", "s"])


def build(placed: DataFrame, width: int = 24, settled: float = 0.3) -> DataFrame:
    """Neighbour lists ``a, b, s``.  Ends when a round changes at most ``settled`` of all entries;
    changes can only bring entries nearer, so it ends."""
    graph = best(first_lists(placed, width).withColumn("fresh", F.lit(True)), width)
    graph, turn = stage(graph), 0
    while True:
        turn += 1
        drawn = reverse(graph, width, F.xxhash64("u", "c", F.lit(turn)))
        near = graph.select(F.col("a").alias("u"), F.col("b").alias("c"), "fresh").unionByName(drawn.drop("s"))
        near = near.groupBy("u", "c").agg(F.max("fresh").alias("fresh"))
        last = graph.groupBy(F.col("a").alias("node")).agg(
            F.when(F.count("*") >= width, F.min("s")).otherwise(F.lit(-2.0)).cast("float").alias("last")
        )
        known = placed.select("node", "dim", "unit").join(last, "node").withColumnRenamed("node", "c")
        item = F.struct("c", "fresh", "last", "unit")
        packed = near.join(known, "c").groupBy("u", "dim").agg(F.collect_list(item).alias("near"), F.max("fresh").alias("any"))
        found = packed.where("any").select("dim", "near").mapInArrow(compare_neighbours, "a LONG, b LONG, s FLOAT")
        old = graph.select("a", "b", "s", F.lit(False).alias("fresh"))
        graph = stage(best(old.unionByName(found.withColumn("fresh", F.lit(True))), width))
        count = graph.agg(F.count("*").alias("n"), F.count_if("fresh").alias("new")).first()
        if count["new"] <= settled * count["n"]:
            return graph


def score_pairs(pairs: DataFrame, queries: DataFrame, nodes: DataFrame, blocks: int, many: bool) -> DataFrame:
    """``q, node, s`` of the pairs ``q, node`` whose cosine beats the query's ``bound``.

    Pairs travel as lists of ids to the block of the node's vector.  ``queries``: q, qv, bound.
    With ``many`` queries, more than a task takes at once, a block that many ask for meets them in parts.
    """
    block = F.pmod(F.xxhash64("node"), F.lit(blocks))
    asked = pairs.groupBy("q", block.alias("block")).agg(F.collect_list("node").alias("asked")).join(queries, "q")
    held = nodes.withColumn("block", block)
    if many:
        parts = asked.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        asked = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("q"), "parts").cast("int"))
        held = held.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    else:
        asked, held = asked.withColumn("part", F.lit(0)), held.withColumn("part", F.lit(0))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"q": np.array([], "i8"), "node": np.array([], "i8"), "s": np.array([], "f8")}
        if left.num_rows and right.num_rows:
            ids = right.column("node").to_numpy()
            dims = np.array([len(v) for v in right.column("v")])
            got = []
            lists = left.column("asked").combine_chunks()
            lens, wanted = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            who = np.repeat(np.arange(left.num_rows), lens)
            order = np.argsort(ids)
            at = order[np.searchsorted(ids, wanted, sorter=order)]
            q, bound = left.column("q").to_numpy(), left.column("bound").to_numpy()
            for d in np.unique(dims):  # links never lead to a vector of another length
                these = np.flatnonzero(dims[at] == d)
                row_of, x = np.cumsum(dims == d) - 1, scaled(matrix(right.column("v").filter(pa.array(dims == d)).combine_chunks()))
                mine = np.unique(who[these])
                ask_of, y = np.zeros(left.num_rows, int), scaled(matrix(left.column("qv").take(pa.array(mine)).combine_chunks()))
                ask_of[mine] = np.arange(len(mine))
                nx, ny = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
                for a in range(0, len(these), 1 << 15):
                    pick = these[a : a + (1 << 15)]
                    i, j = row_of[at[pick]], ask_of[who[pick]]
                    s = np.einsum("ij,ij->i", x[i], y[j]) / np.sqrt(nx[i] * ny[j])
                    good = s > bound[who[pick]]
                    got.append((q[who[pick]][good], wanted[pick][good], s[good]))
            out = {n: np.concatenate([g[i] for g in got]) for i, n in enumerate(out)}
        return pa.table(out)

    keys = ["block", "part"]
    sides = (asked.select(*keys, "q", "qv", "bound", "asked"), held.select(*keys, "node", "v"))
    return sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInArrow(score, "q LONG, node LONG, s DOUBLE")


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, beam: int = 192) -> DataFrame:
    """``q, node, s``: the ``beam`` nearest nodes that greedy search finds, from the query's own node.

    ``queries``: ``q``, nodes of the graph.  Ends when every node in every beam has been followed.
    """
    width = 1 << 6
    links = graph.select(F.col("a").alias("u"), F.col("b").alias("c")).unionByName(
        reverse(graph, width, F.col("s").desc()).select("u", "c")
    )
    links = stage(links.distinct())
    blocks = math.ceil(nodes.count() / BLOCK)
    vectors = stage(queries.join(nodes.select(F.col("node").alias("q"), F.col("v").alias("qv")), "q"))
    many = vectors.count() > 4 * BLOCK
    order = Window.partitionBy("q").orderBy(F.col("s").desc(), "node")
    start = vectors.withColumn("bound", F.lit(float("-inf")))
    found = score_pairs(queries.select("q", F.col("q").alias("node")), start, nodes, blocks, many)
    found = stage(found.withColumn("done", F.lit(False)))
    while not found.where("not done").isEmpty():
        seen = found.select("q", "node")
        follow = found.where("not done").select("q", F.col("node").alias("u"))
        reached = follow.join(links, "u").select("q", F.col("c").alias("node")).distinct().join(seen, ["q", "node"], "left_anti")
        bound = found.groupBy("q").agg(F.when(F.count("*") >= beam, F.min("s")).otherwise(float("-inf")).alias("bound"))
        new = score_pairs(reached, vectors.join(bound, "q"), nodes, blocks, many).withColumn("done", F.lit(False))
        both = found.withColumn("done", F.lit(True)).unionByName(new)
        both = both.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= beam).drop("_r")
        found = stage(both)
    return found.drop("done")


def nearest(vectors: DataFrame, asked, k: int = 5, key: str = "vec_id", vector: str = "embedding", tables: int = 4,
            width: int = 24, beam: int = 192, settled: float = 0.3) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each row where ``asked`` holds.

    ``asked`` is a condition on ``vec_id``.  Nearest first, ties to the smaller id; the query
    itself is no candidate.  See ``usable`` for the rows that take part; vectors are compared
    with those of their own length, and a query with fewer than ``k`` candidates gets them all.
    ``k`` is at most MEMBERS - 1.
    """
    if k >= MEMBERS:
        raise ValueError(f"k is at most {MEMBERS - 1}")
    rows = stage(usable(vectors, key, vector))
    held = stage(members(rows))
    nodes = held.where("node = vec_id").select("node", "v")
    graph = build(stage(directions(nodes, tables)), width, settled)
    asking = stage(rows.where(asked).join(nodes, "v").select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")))
    found = search(graph, nodes, asking.select("q").distinct(), beam)
    top = Window.partitionBy("q").orderBy(F.col("s").desc())
    few = found.withColumn("_r", F.rank().over(top)).where(F.col("_r") <= k + 1).drop("_r")
    each = few.join(held.select("node", "vec_id"), "node")
    # what any asker of the node can get: the first k + 1 candidates, itself among them
    first = Window.partitionBy("q").orderBy(F.col("s").desc(), "vec_id")
    each = each.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    answers = asking.join(each.select("q", "vec_id", "s"), "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("s").desc(), "vec_id"))
    ranked = answers.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("s").alias("score"))
