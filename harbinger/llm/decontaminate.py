"""Benchmark decontamination by SimHash windows, in DataFrame operations only.

Windows as long as a benchmark item are laid over a document wherever both share five
words in a row, or all words of an item that has fewer: without a shared shingle no
window can be similar.  A window's SimHash then meets the items' by a multi-index: 64 bits are cut into ``BLOCKS`` blocks, and
fingerprints within ``RADIUS`` bits agree in at least one block up to ``NEAR`` bits
(if all blocks differed by more, the sum would be over the radius).  The items' side lists
all block values within ``NEAR`` bits, so an equality join finds every such pair.  Those
are verified by the exact weighted Jaccard similarity of their shingles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.session import cut_lineage

SHINGLE = 5
BITS = 64
BLOCKS, NEAR = 7, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def shingles(of: Column) -> Column:
    """Shingles of ``SHINGLE`` words as text; a shorter list of words is one shingle."""
    n = F.size(of)
    last = F.greatest(n - SHINGLE + 1, F.lit(1))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(of, i, SHINGLE), " "))
    )


def shingle_hashes(of: Column, length: int = SHINGLE) -> Column:
    """64-bit hashes of ``length`` words at their places; a shorter list of words has one, of all of them."""
    last = F.greatest(F.size(of) - length, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(of, i + k) for k in range(length)])
    )


def weight(shingle: Column) -> Column:
    """A shingle weighs its letters and digits: long words are rarer and say more."""
    return F.length(F.replace(shingle, F.lit(" "), F.lit(""))).cast("double")


def total_weight(of: Column) -> Column:
    return F.aggregate(of, F.lit(0.0), lambda acc, s: acc + weight(s))


def simhash(of: Column) -> Column:
    """Bit ``b`` is set where the shingles whose hash has it outweigh the others."""
    marked = F.transform(of, lambda s: F.struct(F.xxhash64(s).alias("h"), weight(s).alias("w")))

    def bit(b: Column) -> Column:
        balance = F.aggregate(
            marked, F.lit(0.0),
            lambda acc, x: acc + F.when(F.call_function("getbit", x["h"], b) == 1, x["w"]).otherwise(-x["w"]),
        )
        return F.when(balance > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def block_edges() -> list[tuple[int, int]]:
    """First bit and width of each block."""
    edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def block_values(fingerprint: Column) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftright(fingerprint, start).bitwiseAND(2**width - 1).alias("value"))
        for i, (start, width) in enumerate(block_edges())
    ])


def near_values(fingerprint: Column) -> Column:
    """Every block with every value within ``NEAR`` bits of its own."""

    def listed(block: int, start: int, width: int) -> Column:
        masks = [F.lit(m).cast("long") for m in range(2**width) if m.bit_count() <= NEAR]
        own = F.shiftright(fingerprint, start).bitwiseAND(2**width - 1)
        return F.transform(
            F.array(*masks), lambda m: F.struct(F.lit(block).alias("block"), own.bitwiseXOR(m).alias("value"))
        )

    return F.concat(*[listed(i, start, width) for i, (start, width) in enumerate(block_edges())])


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two sets of shingles."""
    shared = total_weight(F.array_intersect(a, b))
    return shared / (total_weight(a) + total_weight(b) - shared)


def find(docs: DataFrame, items: DataFrame, threshold: float = 0.8, text: str = "text", key: str = "doc_id",
         item_key: str = "item_id", most: int = 200_000) -> DataFrame:
    """``key, item_key, similarity, distance, at, n_words``: for each document and item the best window that
    reaches ``threshold``, ``at`` being its first word and ``distance`` the bits its fingerprint differs.

    Documents are read whole; null and empty texts match nothing, nor does an item
    without a word.  An item of fewer than ``SHINGLE`` words is found where all of them
    stand in a row, so an item of one common word is found in many documents.  Rows of one key with other text are looked at each by itself, and
    repeated rows give one result.  A null key stays null.  Other columns of either table
    are not looked at.  Empty tables give no rows.

    The items' shingles are sent out in blocks of at most ``most``: one pass over the
    documents while they fit one block, one more for each further block.
    """
    known = cut_lineage(
        items.select(F.col(item_key).alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
        .select("item", F.size("w").alias("n"), F.array_distinct(shingles(F.col("w"))).alias("shingles"),
                shingle_hashes(F.col("w")).alias("hashes"))
        .withColumn("fingerprint", simhash(F.col("shingles")))
    )
    places = cut_lineage(
        known.select("n", F.posexplode("hashes").alias("q", "h")).groupBy("n", "h").agg(F.collect_set("q").alias("q"))
        .select("h", "n", F.explode("q").alias("q"))
    )
    total = places.count()
    rounds = max(1, -(-total // most))
    dealt = places.withColumn("_round", F.pmod(F.hash("h"), F.lit(2 * rounds)))
    split = docs.select(F.col(key).alias("key"), words(F.col(text)).alias("w")).where("size(w) > 0")
    laid = split.select("key", "w", F.posexplode(shingle_hashes(F.col("w"))).alias("p", "h"))
    for r in known.where(F.col("n") < SHINGLE).select("n").distinct().collect():
        longer = split.where(F.size("w") > r.n)
        laid = laid.unionByName(longer.select("key", "w", F.posexplode(shingle_hashes(F.col("w"), r.n)).alias("p", "h")))
    parts = []
    for i in range(2 * rounds if rounds > 1 else 1):
        block = dealt.where(F.col("_round") == i) if rounds > 1 else dealt
        parts.append(laid.join(F.broadcast(block.select("h", "n", "q")), "h"))
    first = F.greatest(F.least(F.col("p") - F.col("q"), F.size("w") - F.col("n")), F.lit(0))
    hits = reduce(DataFrame.unionByName, parts).select(
        "key", first.alias("at"), "n", F.array_join(F.slice("w", first + 1, F.col("n")), " ").alias("window")
    )
    seen = cut_lineage(hits.groupBy("key", "n", "window").agg(F.min("at").alias("at")))
    windows = cut_lineage(
        seen.select("n", "window").distinct()
        .withColumn("shingles", F.array_distinct(shingles(F.split("window", " "))))
        .withColumn("fingerprint", simhash(F.col("shingles")))
    )
    asked = windows.select("n", "window", F.inline(block_values(F.col("fingerprint"))))
    listed = known.select("n", "item", F.inline(near_values(F.col("fingerprint"))))
    pairs = asked.join(listed, ["n", "block", "value"]).select("n", "window", "item").distinct()
    theirs = known.select("item", F.col("shingles").alias("wanted"), F.col("fingerprint").alias("print"))
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("print")))
    verified = (
        pairs.join(windows, ["n", "window"]).join(theirs, "item").where(distance <= RADIUS)
        .select("n", "window", "item", similarity(F.col("shingles"), F.col("wanted")).alias("similarity"),
                distance.alias("distance"))
        .where(F.col("similarity") >= threshold)
    )
    best = F.max_by(
        F.struct("similarity", "distance", "at", "n"), F.struct("similarity", -F.col("distance"), -F.col("at"))
    )
    return (
        seen.join(verified, ["n", "window"]).groupBy("key", "item").agg(best.alias("best"))
        .select(F.col("key").alias(key), F.col("item").alias(item_key), "best.similarity", "best.distance", "best.at",
                F.col("best.n").alias("n_words"))
    )
