"""Registered queries: name -> callable(spark, folder). Each one runs over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bourseflow.session import configure
from bourseflow.sources.market_tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def present(df: DataFrame) -> DataFrame:
    """Plain result types: decimals as doubles, dates and timestamps as text, small integers as 32 or 64 bit."""
    def plain(f: T.StructField):
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.col(f.name).cast("string").alias(f.name)
        return F.col(f.name)
    return df.select([plain(f) for f in df.schema.fields])


def query(name: str):
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return present(fn(Tables(configure(spark), folder)))
        QUERIES[name] = run
        return fn
    return register
