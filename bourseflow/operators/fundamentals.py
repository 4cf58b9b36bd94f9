"""Ratios and trends from annual statements."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bourseflow.functions.exprs import dbl, half_up, ratio


def fin_ratios(annual: DataFrame, keys: Sequence[str] = ("stock_id",)) -> DataFrame:
    """Margin, ROE, debt ratio and growth of the newest annual statement of each key.

    The statement before counts as last year only when it ended 330 to 400 days earlier."""
    w = Window.partitionBy(*keys).orderBy("period_end")
    newest = Window.partitionBy(*keys).orderBy(F.desc("period_end"))
    fy = (annual.where("period_type = 'FY'")
          .withColumn("gap", F.datediff("period_end", F.lag("period_end").over(w)))
          .withColumn("prev_revenue", F.lag("revenue").over(w))
          .withColumn("prev_oi", F.lag("operating_income").over(w))
          .withColumn("rn", F.row_number().over(newest)).where("rn = 1"))

    def yoy(now: str, before: str) -> Column:
        return F.when(F.col("gap").between(330, 400), ratio(dbl(now) - dbl(before), F.abs(dbl(before))))

    equity = F.col("total_equity")
    return fy.select(
        *keys, F.col("period_end").alias("fin_period_end"),
        half_up(ratio("operating_income", "revenue"), 6).alias("operating_margin"),
        half_up(F.when(equity > 0, ratio("net_income", "total_equity")), 6).alias("roe"),
        half_up(ratio("total_debt", "total_equity"), 6).alias("debt_ratio"),
        half_up(yoy("revenue", "prev_revenue"), 6).alias("revenue_yoy"),
        half_up(yoy("operating_income", "prev_oi"), 6).alias("operating_income_yoy"))


def latest_valuation(valuations: DataFrame, keys: Sequence[str] = ("stock_id",)) -> DataFrame:
    """Newest valuation row per key; one max_by per column keeps the buffers fixed-size (hash aggregation)."""
    fields = ("per", "pbr", "eps", "bps", "market_cap", "dps", "shares_outstanding")
    return valuations.groupBy(*keys).agg(F.max("as_of").alias("valuation_as_of"),
                                         *[F.max_by(c, "as_of").alias(c) for c in fields])


def financials_trend(annual: DataFrame, limit: int) -> DataFrame:
    """The newest N annual statements of each stock with margin and ROE, oldest first."""
    newest = Window.partitionBy("stock_id").orderBy(F.desc("period_end"))
    return (annual.where("period_type = 'FY'").withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= limit)
            .drop("rn")
            .withColumn("operating_margin", half_up(ratio("operating_income", "revenue"), 6))
            .withColumn("roe", half_up(F.when(F.col("total_equity") > 0, ratio("net_income", "total_equity")), 6))
            .orderBy("stock_id", "period_end"))
