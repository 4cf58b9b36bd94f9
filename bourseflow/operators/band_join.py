"""Pairs of rows whose dates lie within some days of each other, as an equi-join.

Dates fall into buckets as wide as the band. A left row is copied to the two or three buckets that its band touches and joins the right
rows of the same key and bucket, so the join key carries the date: a key with many rows is spread over its buckets, and a left row meets
three bands of days at most, however many rows its key has."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _day(c: str) -> Column:
    return F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))


def candidates(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, days: int) -> DataFrame:
    """Rows that share a key and a bucket: every pair within `days` once, and few others."""
    width = max(days, 1)
    touched = F.sequence(F.floor((_day(left_on) - days) / width), F.floor((_day(left_on) + days) / width))
    spread = left.where(F.col(left_on).isNotNull()).withColumn("_bucket", F.explode(touched))
    return spread.join(right.withColumn("_bucket", F.floor(_day(right_on) / width)), [*keys, "_bucket"]).drop("_bucket")


def band_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, days: int) -> DataFrame:
    """The inner join on `keys` of rows at most `days` apart. Columns other than the keys need different names on both sides."""
    return candidates(left, right, keys, left_on, right_on, days).where(F.abs(F.datediff(left_on, right_on)) <= days)
