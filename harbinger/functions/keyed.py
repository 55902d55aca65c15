"""Row choice and numbering without a one-task window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harbinger.session import keep


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the smallest ``order`` per key.

    An aggregate, not a ``row_number`` window: each task first reduces its own rows, so
    a key that holds a third of the table shuffles one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    out = picked.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest])
    return out.select(*df.columns)


def dense_index(df: DataFrame, key: str, within: list[str] | None = None, out: str = "idx",
                digits: int = 3) -> DataFrame:
    """Number rows 0.. in the order of ``(md5 prefix of key, key)``; ``key`` must be unique.

    Rows are numbered inside ``16 ** digits`` hash buckets and shifted by the number of
    rows in earlier buckets.  Only the bucket counts (at most ``16 ** digits`` per group)
    go through a running sum, never the rows.
    """
    within = within or []
    tagged = df.withColumn("_b", F.substring(F.md5(F.col(key).cast("string")), 1, digits))
    sizes = tagged.groupBy(*within, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*within, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    same = [tagged[c].eqNullSafe(shift[c]) for c in within] + [tagged["_b"] == shift["_b"]]
    joined = tagged.join(shift, reduce(lambda a, b: a & b, same)).select(tagged["*"], shift["_off"])
    rank = F.row_number().over(Window.partitionBy(*within, "_b").orderBy(F.col(key).cast("string")))
    return joined.withColumn(out, F.col("_off") + rank - 1).drop("_b", "_off")


def running_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Per group and distinct value: copies ``m``, rows up to and including it ``cum``, and
    non-null rows of the group ``total``.

    Counting first means that copies cost one row.  Groups may be large, so the running
    sum is taken in two steps: inside value buckets cut at approximate quantiles (which
    only balance the work) and over the bucket totals.  The counts are read several
    times and stay cached.
    """
    counted = keep(df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("m")))
    cuts = [i / 256 for i in range(1, 256)]
    span = counted.groupBy(*group).agg(
        F.percentile_approx(value, cuts, 2000).alias("_cuts"), F.sum("m").alias("total")
    )
    part = F.size(F.filter(F.array_distinct("_cuts"), lambda q: q < F.col(value)))
    placed = counted.join(span, group).withColumn("_b", part).drop("_cuts")
    totals = placed.groupBy(*group, "_b").agg(F.sum("m").alias("_bm"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*group, "_b", F.coalesce(F.sum("_bm").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*group, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(shift, [*group, "_b"])
        .withColumn("cum", F.col("_off") + F.sum("m").over(inside))
        .select(*group, value, "m", "cum", "total")
    )


def average_rank(df: DataFrame, group: list[str], value: str, out: str, total: str) -> DataFrame:
    """Average rank of ``value`` per group (ties share the mean rank) and the non-null count."""
    ranks = running_counts(df, group, value).select(
        *group, value, (F.col("cum") - (F.col("m") - 1) / F.lit(2.0)).alias(out), F.col("total").alias(total)
    )
    return df.join(ranks, [*group, value], "left")


def exact_median(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Median of the non-null values, the two middle ones averaged.

    Unlike the built-in aggregate it never holds a whole group in one task.
    """
    counts = running_counts(df, group, value)
    low, high = F.floor((F.col("total") + 1) / 2), F.ceil((F.col("total") + 1) / 2)
    picked = counts.groupBy(*group).agg(
        F.min(F.when(F.col("cum") >= low, F.col(value))).alias("_l"),
        F.min(F.when(F.col("cum") >= high, F.col(value))).alias("_h"),
    )
    return picked.select(*group, ((F.col("_l") + F.col("_h")) / 2).alias(out))


def exact_quantile(df: DataFrame, group: list[str], value: str, share: float, out: str) -> DataFrame:
    """Smallest value that at least ``share`` of the non-null values of a group do not exceed.

    Approximate quantiles a little to both sides of ``share`` leave few distinct values to be counted and put in order.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, value)
    room = 0.004  # 4 times what the approximation may err in rank
    spots = [max(0.0, share - room), min(1.0, share + room)]
    span = rows.groupBy(*group).agg(F.percentile_approx(value, spots, 1000).alias("_span"), F.count("*").alias("_total"))
    bounds = span.select(
        *group, "_total",
        F.when(F.lit(spots[0] > 0), F.col("_span")[0]).alias("_lo"), F.when(F.lit(spots[1] < 1), F.col("_span")[1]).alias("_hi"),
    )
    # below the lower one a group is one count; above the upper one nothing is asked for
    near = rows.join(F.broadcast(bounds), group).where(F.col("_hi").isNull() | (F.col(value) <= F.col("_hi")))
    kept = F.when(F.col("_lo").isNull() | (F.col(value) >= F.col("_lo")), F.col(value))
    counted = near.groupBy(*group, "_total", kept.alias("_v")).agg(F.count("*").alias("_m"))
    upto = Window.partitionBy(*group).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_cum", F.sum("_m").over(upto))
    return ranked.where((F.col("_cum") >= F.ceil(F.col("_total") * share)) & F.col("_v").isNotNull()).groupBy(*group).agg(F.min("_v").alias(out))
