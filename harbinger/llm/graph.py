"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``links(a, b)``, the root being the smallest of its component.

    Rounds of large-star and small-star (Kiveris et al.): every node's larger, then smaller
    neighbours are tied to its smallest one, until nothing changes.  Links never grow in
    number, minima are added up before the shuffle, and each round is checkpointed.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = cut_lineage(now), None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ends = down.select("u", F.col("m").alias("v"))
        now = cut_lineage(small.unionByName(ends).distinct())
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
