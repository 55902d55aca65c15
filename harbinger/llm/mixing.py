"""Mixing sources to target weights by a low-discrepancy schedule.

The slots of the mix are numbered; slot ``i`` gets the golden-ratio point of ``i``, and the
source whose stretch of the cumulative weights holds that point.  Such points fill every
interval evenly, so any stretch of the mix is close to the weights.  A source's slots are
ranked, and the slot of rank ``r`` takes block ``r`` of the source: its documents in hashed
order, laid end to end and cut into blocks of equal length, again from the first block
when all have been taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harbinger.session import cut_lineage

# 2**32 over the golden ratio, odd, as the step of the points; and their range.
STEP, RANGE = 2654435769, 2**32
PERIOD = 2**31


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
            most: float = 2.0) -> DataFrame:
    """``source, source_size, weight, target, first`` for ``(source, source_size)``, one row per source.

    Weights repeat over the sources in the order of their code points, null last.  The
    mix has ``share`` times all words; a source gets its weight's part but at most ``most``
    times its size, and what it cannot take goes to the others by weight.  ``first`` is the
    number of target words of earlier sources.
    """
    ordered = _positions(sizes)
    kinds = F.array(*[F.lit(w) for w in weights])
    weighed = cut_lineage(ordered.withColumn("weight", kinds[(F.col("position") % len(weights)).cast("int")]))
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first().t
    rate, full = None, -1
    while True:  # every round fills at least one more source, or ends
        cap = F.col("source_size") * most
        filled = F.lit(False) if rate is None else cap <= F.col("weight") * rate
        row = weighed.agg(
            F.sum(F.when(filled, cap).otherwise(0.0)).alias("held"), F.sum(filled.cast("long")).alias("n"),
            F.sum(F.when(~filled, F.col("weight")).otherwise(0)).alias("w"),
        ).first()
        if row.n is None or row.n == full or not row.w:
            break
        full, rate = row.n, (share * total - row.held) / row.w
    target = F.col("source_size") * most if rate is None else F.least(F.col("source_size") * most, F.col("weight") * F.lit(rate))
    out = weighed.withColumn("target", target.cast("double"))
    out = out.withColumn("words", F.round("target").cast("long"))
    return cut_lineage(_running(out, "words", "first"))


def _positions(sizes: DataFrame) -> DataFrame:
    """Sources numbered in code point order, by ranges of about equal numbers of sources."""
    return _running(sizes.withColumn("one", F.lit(1)), "one", "position", by="source").drop("one")


def _running(df: DataFrame, amount: str, out: str, by: str = "position") -> DataFrame:
    """Sum of ``amount`` over the rows before, in the order of ``by``.

    The rows are dealt out by ranges; sums inside a range and over the ranges before it
    are added, so no task holds all rows.
    """
    held = cut_lineage(
        df.repartitionByRange(F.col(by).asc_nulls_last()).withColumn("part", F.spark_partition_id())
    )
    parts = held.groupBy("part").agg(F.sum(amount).alias("_sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("part").orderBy(F.col(by).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        held.join(shift, "part")
        .withColumn(out, F.coalesce(F.sum(amount).over(inside), F.lit(0)) + F.col("_off"))
        .drop("part", "_off")
    )


def schedule(plan: DataFrame, block: int = 1000) -> DataFrame:
    """``slot, source, position, rank, block, taken``: the mix in order.  Slot ``slot`` takes the first
    ``taken`` words of block ``block`` of its source, which it is the ``rank``-th to draw from.

    Point ``slot * STEP mod RANGE`` falls into a source's stretch; stretches are cut at
    the 4096 cells of the range, so points meet them by cell.  Ranks are counted inside
    runs of slots and over the runs before.  Where the points gave a source a block too
    many or too few for its target, its last slots fall away or follow at the end.
    """
    spark = plan.sparkSession
    total = plan.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("t")).first().t
    slots = -(-total // block)
    points = spark.range(slots).select(
        F.col("id").alias("slot"), ((F.col("id") % PERIOD) * STEP % RANGE).alias("point")
    )
    cell = RANGE // 4096
    share = lambda words: F.floor(words / F.lit(float(total or 1)) * RANGE).cast("long")
    stretch = plan.where("words > 0").select(
        "position", share(F.col("first")).alias("low"), share(F.col("first") + F.col("words")).alias("high")
    )
    cells = stretch.where("high > low").withColumn(
        "cell", F.explode(F.sequence(F.expr(f"low div {cell}"), F.expr(f"(high - 1) div {cell}")))
    )
    placed = points.withColumn("cell", F.expr(f"point div {cell}")).join(cells, "cell")
    placed = placed.where("point >= low and point < high").withColumn("run", F.expr("slot div 20000"))
    runs = placed.groupBy("position", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("position").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    shift = runs.select("position", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("position", "run").orderBy("slot")
    ranked = placed.join(shift, ["position", "run"]).select(
        "slot", "position", (F.row_number().over(inside) - 1 + F.col("_off")).alias("rank")
    )
    blocks = F.expr(f"(source_size + {block - 1}) div {block}")
    needed = F.expr(f"(words div source_size) * blocks + (words % source_size + {block - 1}) div {block}")
    wanted = plan.where("words > 0").withColumn("blocks", blocks).withColumn("needed", needed)
    drawn = runs.groupBy("position").agg(F.sum("n").alias("drawn"))
    short = wanted.join(drawn, "position", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    late = short.where("needed > drawn").select(
        F.explode(F.sequence("drawn", F.col("needed") - 1)).alias("rank"), "position"
    ).select((F.lit(slots) + F.col("rank")).alias("slot"), "position", "rank")
    drawn_before = F.expr(f"(rank div blocks) * source_size + (rank % blocks) * {block}")
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.col("words") - drawn_before)
    return (
        ranked.unionByName(late).join(wanted, "position").where("rank < needed")
        .withColumn("block", F.expr("rank % blocks"))
        .select("slot", "source", "position", "rank", "block", length.cast("long").alias("taken"))
    )


def laid_out(sized: DataFrame, plan: DataFrame, digits: int = 5) -> DataFrame:
    """``doc_id, size`` with the plan's columns and ``start``, the words before it in its source.

    The order is by a hash of id and size, so that it mixes the source and never changes.
    Words are summed inside ranges of the hash and over the ranges before; there are
    about as many ranges as batches of 4,000 rows, whatever one source holds of them.
    """
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    hashed = sized.withColumn("order", order)
    ranges = min(16**digits, max(1, -(-hashed.count() // 4_000)))
    head = F.conv(F.substring("order", 1, digits), 16, 10).cast("long")
    hashed = hashed.withColumn("part", F.floor(head * ranges / 16**digits))
    known = hashed.join(plan, hashed["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    parts = known.groupBy("position", "part").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("position").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select("position", "part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    inside = (
        Window.partitionBy("position", "part").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        known.join(shift, ["position", "part"])
        .withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("_off"))
        .drop("part", "_off", "order")
    )


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def mix(docs: DataFrame, block: int = 1000, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
        most: float = 2.0) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, taken``.

    ``size`` is the words of its text (null and empty: 0, nothing to take), ``target`` the
    words the mix wants of its source, ``taken`` the words all slots together take of
    it, repeats counted.  A null source is a source.  Repeated rows are documents of
    their own; an empty table gives no rows; other columns are not carried, join them
    by ``doc_id``.  A source's ``taken`` add up to its rounded target.
    """
    sized = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    laid = cut_lineage(laid_out(sized, plan))
    draws = schedule(plan, block).groupBy("position", "block").agg(F.collect_list("taken").alias("draws"))
    pieces = laid.where("size > 0").select(
        "position", "start", "size",
        F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"),
    ).join(draws, ["position", "block"])
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    words = F.aggregate("draws", F.lit(0).cast("long"), lambda acc, d: acc + F.greatest(F.least(high, d) - low, F.lit(0)))
    taken = pieces.groupBy("position", "start").agg(F.sum(words).alias("_taken"))
    some = laid.where("size > 0").join(taken, ["position", "start"], "left")
    none = laid.where("size = 0").withColumn("_taken", F.lit(0).cast("long"))
    return some.select(laid.columns + ["_taken"]).unionByName(none).select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken")
    )
