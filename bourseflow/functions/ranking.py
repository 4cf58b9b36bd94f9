"""Exact ranks and medians that never put a whole group into one task.

A window ordered by the ranked value sorts every row of a group in a single task. Ranking groups here are few and large
(country x family x metric), so the position of a value is found in levels instead:

1. equal values are counted first (combined on the map side, so a value shared by many rows costs one row);
2. each distinct value falls into a magnitude bucket, a fixed monotone function of the value (256 buckets per power
   of two);
3. a bucket with more than MOST distinct values is cut at about SPLITS of its own values, picked by their hash, and a part that is
   still too full is cut again; so values that crowd together are spread as well as values that do not. Counts of the lower
   parts give the offset, a window inside one part gives the rest.

Buckets, picked values and parts depend on the values alone, so a task that is run again after an executor loss computes the same ones.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bourseflow.sources.stored import kept

BUCKETS_PER_OCTAVE = 256
_OFFSET = 1080
#: Distinct values that one task may sort; about how many values cut a fuller bucket; how often at most (256^4 parts).
MOST, SPLITS, LEVELS = 4096, 256, 4


def magnitude_bucket(value: Column) -> Column:
    v = value.cast("double")
    size = F.floor((F.log2(F.abs(v)) + F.lit(float(_OFFSET))) * F.lit(float(BUCKETS_PER_OCTAVE))).cast("long") + F.lit(1)
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)


def _below(splits: Column, value: Column) -> Column:
    """How many of the sorted values are smaller, by bisection."""
    steps = F.array(*[F.lit(4 * SPLITS >> k) for k in range((4 * SPLITS).bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(splits, at + step - 1) < value, step).otherwise(F.lit(0)))


def _cut(counts: DataFrame, keys: list[str], path: list[str], name: str, most: int) -> DataFrame:
    """Adds the part of each value inside its bucket; 0 in buckets of at most `most` distinct values."""
    full = counts.groupBy(*keys, *path).agg(F.count(F.lit(1)).alias("_values")).where(F.col("_values") > most)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(name), "_v"), 11) / F.lit(float(2**53))
    splits = (counts.join(full, [*keys, *path]).where(chance < F.lit(float(SPLITS)) / F.col("_values"))
              .groupBy(*keys, *path).agg(F.slice(F.sort_array(F.collect_list("_v")), 1, 4 * SPLITS).alias("_splits")))
    return (counts.join(splits, [*keys, *path], "left")
            .withColumn(name, F.when(F.col("_splits").isNull(), 0).otherwise(_below(F.col("_splits"), F.col("_v")))).drop("_splits"))


def parts(counts: DataFrame, keys: Sequence[str], value: str, most: int | None = None) -> tuple[DataFrame, list[str]]:
    """Distinct values with the columns that say, in order, which part of its group a value is in.

    The distinct values are written down once: what comes before is not computed again, and a look at their counts shows whether
    anything has to be cut at all."""
    keys, path, most = list(keys), ["_bucket"], most or MOST
    counts = kept(counts.withColumn("_v", F.col(value).cast("double")).withColumn("_bucket", magnitude_bucket(F.col(value))))
    for level in range(LEVELS):
        if counts.groupBy(*keys, *path).agg(F.count_distinct("_v").alias("n")).where(F.col("n") > most).isEmpty():
            break
        counts = _cut(counts, keys, path, f"_part{level}", most)
        path = [*path, f"_part{level}"]
    return counts.drop("_v"), path


def weights_below(counts: DataFrame, keys: Sequence[str], value: str, weight: str, most: int | None = None) -> DataFrame:
    """For each distinct value of a group: `less`, the weight of smaller values, its own weight, and `n`, that of the group."""
    keys = list(keys)
    placed, path = parts(counts, keys, value, most)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = group.orderBy(*path).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = placed.groupBy(*keys, *path).agg(F.sum(weight).alias("_all")).select(
        *keys, *path, (F.sum("_all").over(upto) - F.col("_all")).alias("_before"), F.sum("_all").over(group).alias("n"))
    inside = Window.partitionBy(*keys, *path).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("_inside", F.sum(weight).over(inside) - F.col(weight))
    return (local.join(offsets, [*keys, *path])
            .select(*keys, value, (F.col("_before") + F.col("_inside")).alias("less"), weight, "n"))


def positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value): `less` rows below it, `ties` rows equal to it, `n` rows in the group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    return weights_below(counts, keys, value, "ties")


def insert_positions(rows: DataFrame, pool: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """For each row: how many pool values of its group are below (less) and equal, and the pool size n."""
    keys = list(keys)
    counts = (pool.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("equal"))
              .unionByName(rows.groupBy(*keys, value).agg(F.lit(0).cast("long").alias("equal")))
              .groupBy(*keys, value).agg(F.sum("equal").alias("equal")))
    return rows.join(weights_below(counts, keys, value, "equal"), [*keys, value])


def with_rank(df: DataFrame, keys: Sequence[str], value: str, *, descending: bool = True,
              rank: str = "rank", total: str | None = None) -> DataFrame:
    """SQL RANK() of the non-null values inside each group; rows with a NULL value are dropped."""
    pos = positions(df, keys, value)
    place = (F.col("n") - F.col("less") - F.col("ties") if descending else F.col("less")) + F.lit(1)
    cols = [*keys, value, place.alias(rank)] + ([F.col("n").alias(total)] if total else [])
    return df.where(F.col(value).isNotNull()).join(pos.select(*cols), [*keys, value])


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, *, rank: str = "rank", total: str = "n") -> DataFrame:
    """Ascending rank where equal values share the mean of their places."""
    pos = positions(df, keys, value).select(
        *keys, value, (F.col("less") + (F.col("ties") + 1) / F.lit(2.0)).alias(rank), F.col("n").alias(total))
    return df.where(F.col(value).isNotNull()).join(pos, [*keys, value])


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Interpolated median and sample count per group.

    Counts of the magnitude buckets say which one or two of a group hold its middle; only their values are put in order. The frame is read
    twice, and the buckets of the middle (two rows a group at most) are broadcast."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, value, magnitude_bucket(F.col(value)).alias("_at"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = group.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = rows.groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_all"))
    middle = kept(sizes.withColumns({"_before": F.sum("_all").over(upto) - F.col("_all"), "n": F.sum("_all").over(group)})
              .where((F.col("_before") <= high) & (low < F.col("_before") + F.col("_all"))).drop("_all"))
    placed = positions(rows.join(F.broadcast(middle.drop("_before", "n")), [*keys, "_at"]).drop("_at"), keys, value).drop("n")
    offsets = middle.groupBy(*keys).agg(F.min("_before").alias("_before"), F.max("n").alias("n"))
    placed = placed.join(F.broadcast(offsets), keys) if keys else placed.crossJoin(F.broadcast(offsets))
    less = F.col("less") + F.col("_before")

    def covers(i: Column) -> Column:
        return ((less <= i) & (i < less + F.col("ties"))).cast("int")

    return (placed.withColumn("_w", covers(low) + covers(high)).where(F.col("_w") > 0)
            .groupBy(*keys).agg((F.sum(F.col(value).cast("double") * F.col("_w")) / F.lit(2.0)).alias(name),
                                F.max("n").alias("n")))


def with_group_stats(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Group aggregates beside the rows: partial aggregation and an equi-join, not an unordered window."""
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return df.join(stats, list(keys))
