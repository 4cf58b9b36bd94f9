"""Global order without a global window."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def with_position(df: DataFrame, keys: Sequence[str], ts: str, name: str = "pos") -> DataFrame:
    """Row number by a unique timestamp inside each key group, counted through minutes and days.

    Minute counts are summed inside a day, day counts over the calendar, so no task orders more than one minute of rows."""
    keys = list(keys)
    x = df.withColumn("_minute", F.date_trunc("minute", ts)).withColumn("_day", F.to_date(ts))
    per_min = x.groupBy(*keys, "_day", "_minute").agg(F.count(F.lit(1)).alias("_n"))
    run = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_day = run(Window.partitionBy(*keys, "_day").orderBy("_minute"))
    per_min = per_min.withColumn("_before_min", F.sum("_n").over(in_day) - F.col("_n"))
    per_day = per_min.groupBy(*keys, "_day").agg(F.sum("_n").alias("_dn"))
    days = run(Window.partitionBy(*keys).orderBy("_day"))
    per_day = per_day.withColumn("_before_day", F.sum("_dn").over(days) - F.col("_dn")).drop("_dn")
    offsets = per_min.join(per_day, [*keys, "_day"]).select(*keys, "_minute", (F.col("_before_min") + F.col("_before_day")).alias("_off"))
    inside = Window.partitionBy(*keys, "_minute").orderBy(ts)
    return (x.withColumn("_rn", F.row_number().over(inside)).join(offsets, [*keys, "_minute"])
            .withColumn(name, F.col("_off") + F.col("_rn")).drop("_minute", "_day", "_rn", "_off"))


def with_neighbours(df: DataFrame, keys: Sequence[str], pos: str, value: str, reach: int, block: int = 4096) -> DataFrame:
    """Adds `near`: the values up to `reach` places before and after each row.

    Positions are cut into blocks; rows near a block's edge are copied into the next block as context only."""
    keys = list(keys)
    b = F.floor((F.col(pos) - 1) / block)
    at = (F.col(pos) - 1) % block
    blocks = F.array_compact(F.array(F.struct(b.alias("b"), F.lit(True).alias("own")),
                                     F.when((at < reach) & (b > 0), F.struct((b - 1).alias("b"), F.lit(False).alias("own"))),
                                     F.when(at >= block - reach, F.struct((b + 1).alias("b"), F.lit(False).alias("own")))))
    x = df.withColumn("_x", F.explode(blocks))
    w = Window.partitionBy(*keys, "_x.b").orderBy(pos)
    near = F.concat(F.collect_list(value).over(w.rowsBetween(-reach, -1)), F.collect_list(value).over(w.rowsBetween(1, reach)))
    return x.withColumn("near", near).where("_x.own").drop("_x")


def page(df: DataFrame, value: str, tie: str, offset: int, limit: int, *, descending: bool = True) -> DataFrame:
    """Rows offset .. offset+limit-1 in the order of (value, NULLs last, tie ascending), with `place` (from 0), `rank` (RANK of the value)
    and `total` (rows of the frame). `tie` is a number that is unique inside a value.

    Counts of the distinct values say which ones the page touches; only rows with those are looked at, and among equal values counts of
    the ties say the same. So the depth of the page does not matter, and no task sorts more than one part of the values."""
    from bourseflow.functions.ranking import positions, weights_below
    pos = positions(df, [], value)
    start = (F.col("n") - F.col("less") - F.col("ties") if descending else F.col("less")).alias("_start")
    touched = pos.select(value, start, "ties").where((F.col("_start") < offset + limit) & (F.col("_start") + F.col("ties") > offset)).drop("ties")
    sizes = df.agg(F.count(value).alias("known"), F.count(F.lit(1)).alias("total")).first()
    rows = df.join(touched, value)
    if sizes.known < offset + limit:
        rows = rows.unionByName(df.where(F.col(value).isNull()).withColumn("_start", F.lit(sizes.known)))
    ties = rows.groupBy("_start", tie).agg(F.count(F.lit(1)).alias("_equal"))
    placed = rows.join(weights_below(ties, ["_start"], tie, "_equal").select("_start", tie, F.col("less").alias("_before")), ["_start", tie])
    place = F.col("_start") + F.col("_before")
    return (placed.where((place >= offset) & (place < offset + limit))
            .select(*df.columns, place.alias("place"), (F.col("_start") + 1).alias("rank"), F.lit(sizes.total).alias("total")))
