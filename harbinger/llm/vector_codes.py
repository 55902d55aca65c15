"""Vector codes by Lloyd's rounds over two trees.

Vectors become integers and are cut into parts; every part position has a codebook.  Points of
a block lie in one tree per position, each node with its box, its number of points and their
sum; the entries of a codebook lie in a small tree of boxes.  A round walks both trees at
once: an entry node whose box is farther from a point node than some other entry can be
goes; a point node with one entry left is assigned whole by its cached sum; leaves with
several entries left are settled by integer distances.  All bounds are integers, so the
result is that of plain rounds, ties included.

Trees are built once, within the tasks that read the vectors, and written to the shared
folder.  A round sends out the codebooks (``parts * entries`` vectors) and gets back one sum per
entry; nothing else reaches the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger.session import cut_lineage

SCALE = 4096
LIMIT = 1 << 26  # of a component's size; squares of a whole vector then fit 64 bits
LEAF = 32
BLOCK = 8192


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, label, v``: components times 4096, rounded down.  Rows whose vector is null or holds
    null or non-finite components go; other columns are not read."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")
    )
    return rows.where("v is not null").where(finite).withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE)))


def point_trees(points: np.ndarray) -> dict[str, np.ndarray]:
    """One balanced tree per part position over ``points`` (row, part, component).

    ``order`` gives the rows in leaf order (-1 fills the last leaves).  Nodes are numbered from
    the root, level by level; ``lo``, ``hi``, ``sums`` and ``count`` are by part and node.
    """
    n, parts, width = points.shape
    depth = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
    size = LEAF << depth
    order = np.full((parts, size), -1, "i4")
    order[:, :n] = np.arange(n)
    for level in range(depth):  # the wider half of a node's values goes right, rows that fill up go last
        nodes = 1 << level
        rows = order.reshape(parts, nodes, -1)
        x = np.stack([points[rows[p], p] for p in range(parts)])
        real = rows >= 0
        lo = np.where(real[..., None], x, LIMIT).min(axis=2)
        hi = np.where(real[..., None], x, -LIMIT).max(axis=2)
        axis = (hi - lo).argmax(axis=2)
        value = np.take_along_axis(x, axis[:, :, None, None], 3)[..., 0].astype("i8")
        by = np.argsort(np.where(real, value, 2 * LIMIT), axis=2, kind="stable")
        order = np.take_along_axis(rows, by, 2).reshape(parts, size)
    x = np.stack([points[order[p], p] for p in range(parts)]).reshape(parts, 1 << depth, LEAF, width)
    real = (order >= 0).reshape(parts, 1 << depth, LEAF)
    lo = np.where(real[..., None], x, LIMIT).min(axis=2)
    hi = np.where(real[..., None], x, -LIMIT).max(axis=2)
    sums, count = np.where(real[..., None], x, 0).astype("i8").sum(axis=2), real.sum(axis=2)
    los, his, all_sums, counts = [lo], [hi], [sums], [count]
    for _ in range(depth):
        lo, hi = lo.reshape(parts, -1, 2, width).min(axis=2), hi.reshape(parts, -1, 2, width).max(axis=2)
        sums, count = sums.reshape(parts, -1, 2, width).sum(axis=2), count.reshape(parts, -1, 2).sum(axis=2)
        los, his, all_sums, counts = [lo, *los], [hi, *his], [sums, *all_sums], [count, *counts]
    return {
        "order": order, "lo": np.concatenate(los, 1).astype("i4"), "hi": np.concatenate(his, 1).astype("i4"),
        "sums": np.concatenate(all_sums, 1), "count": np.concatenate(counts, 1).astype("i4"),
    }


def entry_tree(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``lo, hi, children, entry`` of a tree over a codebook; a leaf is its own child and names its
    entry.  Entries equal to an earlier one can win nothing and are left out."""
    first = np.sort(np.unique(entries, axis=0, return_index=True)[1])
    lo, hi, children, names = [], [], [], []

    def add(members: np.ndarray) -> int:
        me, x = len(lo), entries[members]
        lo.append(x.min(axis=0))
        hi.append(x.max(axis=0))
        children.append((me, me))
        names.append(members[0] if len(members) == 1 else -1)
        if len(members) > 1:
            ranked = members[np.argsort(x[:, (hi[me] - lo[me]).argmax()], kind="stable")]
            half = len(ranked) // 2
            children[me] = (add(ranked[:half]), add(ranked[half:]))
        return me

    add(first)
    return np.array(lo), np.array(hi), np.array(children), np.array(names)


def walk(tree: dict, books: np.ndarray, points: np.ndarray):
    """Yields ``part, node, entry`` of whole nodes (arrays) and then, per part, the uncertain leaves'
    ``part, rows, entry`` for single rows.  ``books``: part, entry, component."""
    parts, nodes = tree["count"].shape
    depth = (nodes + 1).bit_length() - 2
    for p in range(parts):
        e_lo, e_hi, children, names = entry_tree(books[p])
        at, of = np.array([0]), np.array([0])  # point node, entry node
        level = 0
        while True:
            lo, hi = tree["lo"][p][at].astype("i8"), tree["hi"][p][at].astype("i8")
            gap = np.maximum(0, np.maximum(lo - e_hi[of], e_lo[of] - hi))
            far = np.maximum(hi - e_lo[of], e_hi[of] - lo)
            near, most = (gap * gap).sum(axis=1), (far * far).sum(axis=1)
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            bound = np.repeat(np.minimum.reduceat(most, starts), np.diff(np.r_[starts, len(at)]))
            keep = near <= bound  # a tie may still go to the smaller index
            at, of = at[keep], of[keep]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            left = np.diff(np.r_[starts, len(at)])
            alone = np.repeat(left == 1, left) & (names[of] >= 0)
            if alone.any():
                yield p, at[alone], names[of[alone]], None
                at, of = at[~alone], of[~alone]
            if not len(at) or (level == depth and (names[of] >= 0).all()):
                break
            deeper = level < depth
            a = np.stack([2 * at + 1, 2 * at + 2], 1) if deeper else at[:, None]
            a, o = np.repeat(a, 2, axis=1), np.tile(children[of], (1, a.shape[1]))
            # a leaf entry is its own child twice
            pairs = np.unique(np.stack([a.ravel(), o.ravel()], 1), axis=0)
            pairs = pairs[tree["count"][p][pairs[:, 0]] > 0]
            at, of = pairs[:, 0], pairs[:, 1]
            level += deeper
        if len(at):
            leaf, entry = at - ((1 << depth) - 1), names[of]
            by = np.lexsort((entry, leaf))
            leaf, entry = leaf[by], entry[by]
            starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
            rows = tree["order"][p].reshape(-1, LEAF)[leaf]
            gap = points[rows, p] - books[p][entry][:, None, :]
            keyed = np.minimum.reduceat((gap * gap).sum(axis=2) * len(books[p]) + entry[:, None], starts, axis=0)
            rows = rows[starts]
            yield p, rows[rows >= 0], keyed[rows >= 0] % len(books[p]), "rows"


def to_blocks(rows: DataFrame, parts: int, length: int) -> DataFrame:
    """Blocks of at most BLOCK vectors with their trees, each made of the rows a task reads."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    trees = ["order", "lo", "hi", "sums", "count"]

    def pack(batches):
        def block(some: list[pa.RecordBatch]):
            t = pa.Table.from_batches(some)
            flat = t.column("v").combine_chunks().flatten().to_numpy()
            points = flat.reshape(t.num_rows, parts, length // parts)
            tree = point_trees(points)
            row = {c: pa.ListArray.from_arrays([0, t.num_rows], t.column(c).combine_chunks()) for c in ("vec_id", "label")}
            row["points"] = pa.array([points.astype("i4").tobytes()], pa.binary())
            row |= {c: pa.array([tree[c].tobytes()], pa.binary()) for c in trees}
            return pa.record_batch(list(row.values()), names=list(row))

        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, BLOCK - size))
                size += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if size == BLOCK:
                    yield block(held)
                    held, size = [], 0
        if size:
            yield block(held)

    kinds = f"vec_id ARRAY<{fields['vec_id']}>, label ARRAY<{fields['label']}>, points BINARY"
    return rows.select("vec_id", "label", "v").mapInArrow(pack, kinds + "".join(f", `{c}` BINARY" for c in trees))


def unpack(batch: pa.RecordBatch, i: int, parts: int, width: int) -> tuple[np.ndarray, dict]:
    def read(name: str, kind: str, *shape: int) -> np.ndarray:
        return np.frombuffer(batch.column(name)[i].as_buffer(), kind).reshape(shape)

    tree = {"order": read("order", "i4", parts, -1), "count": read("count", "i4", parts, -1)}
    tree |= {c: read(c, "i4", parts, -1, width) for c in ("lo", "hi")}
    tree["sums"] = read("sums", "i8", parts, -1, width)
    return read("points", "i4", -1, parts, width).astype("i8"), tree


def next_books(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the mean, rounded down, of the parts assigned to it."""
    parts, entries, width = books.shape

    def assign(batches):
        sums, count = np.zeros(books.shape, "i8"), np.zeros((parts, entries), "i8")
        for batch in batches:
            for i in range(batch.num_rows):
                points, tree = unpack(batch, i, parts, width)
                for p, at, entry, single in walk(tree, books, points):
                    np.add.at(count[p], entry, 1 if single else tree["count"][p][at])
                    np.add.at(sums[p], entry, points[at, p] if single else tree["sums"][p][at])
        p, e = np.nonzero(count)
        yield pa.record_batch(
            [pa.array(p.astype("i4")), pa.array(e.astype("i4")), pa.array(count[p, e]),
             pa.array(list(sums[p, e]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    found = blocks.drop("vec_id", "label").mapInArrow(assign, "part INT, entry INT, n LONG, sums ARRAY<LONG>")
    totals = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])
    books = books.copy()
    for row in totals.collect():  # at most parts * entries rows
        books[row["part"], row["entry"]] = [row[f"s{j}"] // row["n"] for j in range(width)]
    return books


def assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every vector."""
    parts, _, width = books.shape
    kinds = {f.name: f.dataType.elementType.simpleString() for f in blocks.schema.fields if f.name in ("vec_id", "label")}

    def code(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                points, tree = unpack(batch, i, parts, width)
                codes, error = np.zeros(points.shape[:2], "u1"), np.zeros(len(points), "i8")
                depth = (tree["count"].shape[1] + 1).bit_length() - 2
                for p, at, entry, single in walk(tree, books, points):
                    if not single:  # a node's rows are one stretch of the leaf order
                        level = np.frexp(at + 1)[1] - 1
                        span = LEAF << (depth - level)
                        start = (at + 1 - (1 << level)) * span
                        inside = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
                        at = tree["order"][p][np.repeat(start, span) + inside]
                        entry = np.repeat(entry, span)[at >= 0]
                        at = at[at >= 0]
                    codes[at, p] = entry
                    gap = points[at, p] - books[p][entry]
                    error[at] += (gap * gap).sum(axis=1)
                text = codes.tobytes().hex()
                yield pa.record_batch(
                    [batch.column("vec_id")[i].values, batch.column("label")[i].values,
                     pa.array([text[j : j + 2 * parts] for j in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)],
                    names=["vec_id", "label", "code", "error"],
                )

    return blocks.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code STRING, error LONG")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, key: str = "vec_id",
             vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``, one row per usable vector.

    Rows with a null or broken vector go (see ``integers``).  Codebooks start from the ``entries``
    smallest ids; null ids come last and repeated ids in the order of their vectors, every row
    counting.  Where there are fewer rows, codebooks are smaller.  All vectors should have one length that
    ``parts`` divides: where they differ, the commonest such length (the smaller of two) is coded, and
    other vectors keep their row with a null code and error.  Equal labels, nulls together, share
    ``label_error``.  A component beyond +-16384 is refused, as its squares would not fit LONG.
    """
    rows = cut_lineage(integers(vectors, key, vector, label))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(
        F.count("*").alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")
    ).collect()  # one row per length
    good = [r for r in lengths if r["d"] and r["d"] % parts == 0]
    length = min(good, key=lambda r: (-r["n"], r["d"]))["d"] if good else 0
    if any(r["d"] == length and r["most"] > LIMIT for r in good):
        raise ValueError("a component is beyond +-16384")
    fit = rows.where(F.size("v") == length) if length else rows.where("false")
    start = fit.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not start:
        books = np.zeros((parts, 0, 0), "i8")
        coded = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        books = np.array([r["v"] for r in start], "i8").reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
        blocks = cut_lineage(to_blocks(fit, parts, length))
        for _ in range(rounds):
            books = next_books(blocks, books)
        coded = assigned(blocks, books)
        if len(lengths) > 1:
            rest = rows.where(F.size("v") != length)
            coded = coded.unionByName(rest.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    coded = cut_lineage(coded)
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = coded.join(totals, coded["label"].eqNullSafe(totals["_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
