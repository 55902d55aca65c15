"""Near-duplicate join by a MinHash LSH forest with exact verification.

Each text has ``TREES`` labels of ``DEPTH`` MinHash values.  Sorted labels are a prefix trie:
texts that share a long prefix are likely very similar, and the shorter the prefix, the
less similar the texts that meet.  Prefixes are shortened down to the depth at which a
pair at the threshold shares one in some tree with at least the target recall.  Within a
shared prefix, texts are tied together longest prefix first, so a text that already hangs
together with its neighbours is not compared with them again at shorter ones.

Candidates are tied together by their signatures, and every group so tied is verified by
the exact Jaccard similarity of its shingle sets.  Pairs never become rows: tasks add up
links per text and keep a spanning forest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.llm.common import small_batches
from harbinger.llm.graph import components
from harbinger.session import cut_lineage

SHINGLE = 5
TREES, DEPTH = 16, 8
#: Rows of a shared prefix, and rows and shingles of a group, that meet in one block.
PREFIX_BLOCK, BLOCK_ROWS, BLOCK_SHINGLES = 4000, 2000, 1_000_000

_random = np.random.RandomState(20240101)
BYTE = _random.randint(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = np.uint64(0x9E3779B97F4A7C15)
MIXERS = _random.randint(0, 2**63, SHINGLE).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SLOPE = _random.randint(0, 2**63, TREES * DEPTH).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _random.randint(0, 2**63, TREES * DEPTH).astype(np.uint64)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def stop_depth(threshold: float, target: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target recall."""
    for d in range(DEPTH, 1, -1):
        if 1 - (1 - threshold**d) ** TREES >= target:
            return d
    return 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the text's five-word shingles; fewer words are one shingle, none are none."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    inside = ~BLANK[data]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    data, inside = data[starts[0] :], inside[starts[0] :]
    starts = starts - starts[0]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = np.where(inside, mixed(BYTE[data] + place.astype(np.uint64) * PLACE), np.uint64(0))
    words = mixed(np.add.reduceat(value, starts))
    if len(words) < SHINGLE:
        return mixed(np.array([sum(int(w) * int(m) for w, m in zip(words, MIXERS, strict=False)) % 2**64], dtype=np.uint64))
    n = len(words) - SHINGLE + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        total += mixed(words[i : i + n] * MIXERS[i] + np.uint64(i))
    return np.unique(mixed(total))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    least = np.full(TREES * DEPTH, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024, None] * SLOPE + SHIFT
        np.minimum(least, part.min(axis=0), out=least)
    return (mixed(least) >> np.uint64(32)).astype(np.uint64)


def signed(depth: int) -> Callable[[Column], Column]:
    """``(set, n, signature, keys)``: a hash of the shingle set, its size, a byte of every MinHash, and
    a key per tree that is equal where the first ``depth`` MinHashes are."""

    @F.pandas_udf("set binary, n int, signature binary, keys array<long>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            s = shingle_set(text)
            if not len(s):
                out.append((None, 0, None, None))
                continue
            h = min_hashes(s).reshape(TREES, DEPTH)
            key = np.arange(TREES, dtype=np.uint64)
            for d in range(depth):
                key = mixed(key * PLACE + h[:, d])
            digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            out.append((digest, len(s), (h & np.uint64(255)).astype(np.uint8).tobytes(), key.view(np.int64)))
        return pd.DataFrame(out, columns=["set", "n", "signature", "keys"])

    return sign


class Union:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = int(self.parent[x])
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def tie(signatures: np.ndarray, tree: int, depth: int, gate: float) -> list[tuple[int, int]]:
    """A forest over rows of one prefix: any two whose signatures agree in ``gate`` of their bytes end up
    connected.  Longer prefixes go first; only rows not yet connected are compared."""
    labels, n = signatures[:, tree * DEPTH : (tree + 1) * DEPTH], len(signatures)
    groups, links = Union(n), []
    for d in range(DEPTH, depth - 1, -1):
        node = np.unique(labels[:, :d], axis=0, return_inverse=True)[1].ravel() if d > depth else np.zeros(n, dtype=int)
        order = np.argsort(node, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            if len(rows) < 2:
                continue
            root = np.array([groups.find(int(r)) for r in rows])
            while True:
                kinds, sizes = np.unique(root, return_counts=True)
                if len(kinds) < 2:
                    break
                base = root == kinds[np.argmax(sizes)]
                near, rest = rows[base], rows[~base]
                reached = []
                for r in rest:
                    agree = (signatures[near] == signatures[r]).mean(axis=1) >= gate
                    if agree.any():
                        reached.append(r)
                        other = int(near[np.argmax(agree)])
                        if groups.join(int(r), other):
                            links.append((int(r), other))
                if reached:
                    root = np.array([groups.find(int(r)) for r in rows])
                else:
                    rows, root = rest, root[~base]
    return links


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in a sorted stream."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        new[0] = last is not None and first != last
        last = tuple(c[-1] for c in columns)
        cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        if cuts[0]:
            held.append(batch.slice(0, cuts[0]))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(rows: DataFrame, of: str, blocks: Column) -> DataFrame:
    """Repeat each row for every pair of blocks its own block is in: ``i <= j``, and ``own`` block.

    All pairs of blocks of a group meet, each as one unit of bounded size.
    """
    own = F.pmod(F.xxhash64("set"), F.col("_blocks")).cast("int")
    dealt = rows.withColumn("_blocks", blocks.cast("long")).withColumn("own", own)
    other = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks").cast("int") - 1)))
    return other.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("_blocks", "_other")


def candidate_links(texts: DataFrame, depth: int, gate: float) -> DataFrame:
    """``a, b``: forests over all shared prefixes of ``texts(set, signature, keys)``."""
    placed = texts.select("set", F.posexplode("keys").alias("tree", "prefix"))
    shared = placed.groupBy("prefix").agg(F.count("*").alias("_n")).where("_n > 1")
    members = placed.join(shared, "prefix").join(texts.select("set", "signature"), "set")
    units = in_blocks(members, "prefix", F.ceil(F.col("_n") / PREFIX_BLOCK)).select("prefix", "i", "j", "tree", "set", "signature")

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["prefix", "i", "j"]):
            sets = group.column("set").to_pylist()
            marks = np.frombuffer(b"".join(group.column("signature").to_pylist()), dtype=np.uint8).reshape(len(sets), -1)
            if len(sets) == 2:
                links = [(0, 1)] if (marks[0] == marks[1]).mean() >= gate else []
            else:
                links = tie(marks, group.column("tree")[0].as_py(), depth, gate) if len(sets) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sets[a] for a, _ in links], pa.binary()), pa.array([sets[b] for _, b in links], pa.binary())],
                    ["a", "b"],
                )

    dealt = units.repartition("prefix", "i", "j").sortWithinPartitions("prefix", "i", "j")
    return dealt.mapInArrow(tied, "a binary, b binary")


def exact_links(members: list[np.ndarray], own: np.ndarray, copies: np.ndarray, same: bool,
                numerator: int, denominator: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links per text (copies counted) and a spanning forest, by exact set sizes: a pair is linked where
    ``denominator * shared >= numerator * union``."""
    n = len(members)
    size = np.array([len(m) for m in members])
    doc = np.repeat(np.arange(n), size)
    kind, seen = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)[1:]
    useful = seen[kind] > 1
    kind, doc = kind[useful], doc[useful]
    order = np.argsort(kind, kind="stable")
    posted, sorted_kind = doc[order], kind[order]
    begin = np.searchsorted(sorted_kind, np.arange(len(seen)))
    end = np.searchsorted(sorted_kind, np.arange(len(seen)), side="right")
    mine = np.searchsorted(doc, np.arange(n + 1))
    links, forest, groups = np.zeros(n, dtype=np.int64), [], Union(n)
    for a in range(n):
        kinds = kind[mine[a] : mine[a + 1]]
        if not len(kinds):
            continue
        spans = np.concatenate([posted[begin[k] : end[k]] for k in kinds])
        shared = np.bincount(spans, minlength=n)
        good = denominator * shared >= numerator * (size[a] + size - shared)
        good[: a + 1] = False
        if not same:
            good &= own != own[a]
        for b in np.flatnonzero(good):
            links[a] += copies[b]
            links[b] += copies[a]
            if groups.parent[b] != groups.parent[a] and groups.join(a, int(b)):
                forest.append((a, int(b)))
    return links, forest


def verified(units: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """``a, b, links``: forests of exact links (``b`` set), and links per text (``b`` null)."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["root", "i", "j"]):
            if group.num_rows < 2:
                continue
            sets, first = np.unique(np.array(group.column("set").to_pylist(), dtype=object), return_index=True)
            own = group.column("own").to_numpy()[first]
            copies = group.column("copies").to_numpy()[first]
            texts = group.column("text")
            members = [shingle_set(texts[int(i)].as_py()) for i in first]
            same = group.column("i")[0].as_py() == group.column("j")[0].as_py()
            links, forest = exact_links(members, own, copies, same, numerator, denominator)
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([
                    pa.array([sets[i] for i in some] + [sets[a] for a, _ in forest], pa.binary()),
                    pa.array([None] * len(some) + [sets[b] for _, b in forest], pa.binary()),
                    pa.array([int(links[i]) for i in some] + [0] * len(forest), pa.int64()),
                ], ["a", "b", "links"])

    dealt = units.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return dealt.mapInArrow(checked, "a binary, b binary, links long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, target: float = 0.9995) -> DataFrame:
    """``key, class_id, n_links``; one row per row of ``docs``.

    Two texts are linked where their sets of five-word shingles (A-Z lowered, words
    divided by white space) have a Jaccard similarity of at least ``percent``; a text of
    fewer words is one shingle.  ``n_links`` counts the other rows linked to a row, copies
    included, and ``class_id`` is the smallest key of all rows connected by links.  Texts
    without a word (null, empty) have no links and are classes of their own.  Repeated
    rows are copies of each other.  A null key takes the class of its links, null if all
    of them are; extra columns are not looked at; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    depth = stop_depth(percent / 100, target)
    gate = percent / 100 - 4.5 * (percent / 100 * (1 - percent / 100) / (TREES * DEPTH)) ** 0.5
    rows = cut_lineage(
        docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("hash"), signed(depth)(F.col(text)).alias("s"))
        .select("key", "hash", "s.*")
    )
    of_first = F.min_by(F.struct("key", "hash", "n", "signature", "keys"), F.struct(F.col("key").isNull(), "key", "hash"))
    texts = cut_lineage(
        rows.where("set is not null").groupBy("set").agg(F.count("*").alias("copies"), of_first.alias("f"))
        .select("set", "copies", "f.*")
    )
    near = components(cut_lineage(candidate_links(texts, depth, gate)))
    tied = cut_lineage(near.join(texts.select("set", "copies", "key", "hash", "n"), near["node"] == texts["set"]).drop("node"))
    load = tied.groupBy("root").agg(F.sum("n").alias("_n"), F.count("*").alias("_rows"))
    blocks = F.greatest(F.ceil(F.col("_n") / BLOCK_SHINGLES), F.ceil(F.col("_rows") / BLOCK_ROWS))
    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("_hash"))
    found = tied.join(source, (F.col("hash") == F.col("_hash")) & F.col("key").eqNullSafe(F.col("_key")))
    units = in_blocks(found.join(load, "root"), "root", blocks).select("root", "i", "j", "own", "set", "copies", "text")
    exact = cut_lineage(verified(units, percent, 100))
    links = exact.where("b is null").groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    classes = components(exact.where("b is not null").select("a", "b")).withColumnRenamed("node", "set")
    placed = cut_lineage(texts.select("set", "copies", "key").join(links, "set", "left").join(classes, "set", "left"))
    named = placed.where("root is not null").groupBy("root").agg(F.min("key").alias("class_id"))
    of_set = placed.join(named, "root", "left").select(
        "set", F.coalesce("class_id", "key").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return rows.select("key", "set").join(of_set, "set", "left").select(
        F.col("key").alias(key),
        F.when(F.col("set").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
