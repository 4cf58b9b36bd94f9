"""Price, fundamental and theme marts over all stocks."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bourseflow.functions.ranking import with_rank
from bourseflow.operators import fundamentals, prices
from bourseflow.plans import marts
from bourseflow.plans.catalog import query
from bourseflow.sources.market_tables import Tables


@query("v_latest_price")
def v_latest_price(t: Tables) -> DataFrame:
    return prices.latest_price(t.prices, t.stocks)


@query("v_fx_latest")
def v_fx_latest(t: Tables) -> DataFrame:
    return prices.fx_latest(t.fx)


@query("v_stock_theme")
def v_stock_theme(t: Tables) -> DataFrame:
    return marts.themes(t).select("stock_id", "group_id", "theme", "sector", "family", "commodity_linked")


@query("v_stock_metrics")
def v_stock_metrics(t: Tables) -> DataFrame:
    return marts.stock_metrics(t)


def _slice(name: str, *cols: str) -> None:
    @query(name)
    def run(t: Tables) -> DataFrame:
        return prices.price_metrics(t.prices).select("stock_id", *cols)


_slice("m_returns", "return_1w", "return_1m", "return_3m", "return_6m", "return_1y")
_slice("m_volatility", "volatility_1y")
_slice("m_max_drawdown", "max_drawdown_1y")
_slice("m_moving_avg", "ma20", "ma60", "ma120", "ma120_gap")
_slice("m_volume_ratio", "avg_volume_20d", "volume_ratio_20d")
_slice("m_range_52w", "high_52w", "low_52w", "position_52w")


@query("m_fin_ratios")
def m_fin_ratios(t: Tables) -> DataFrame:
    return fundamentals.fin_ratios(t.statements)


@query("m_market_cap_krw")
def m_market_cap_krw(t: Tables) -> DataFrame:
    return marts.stock_metrics(t).select("stock_id", "market_cap_krw", "dividend_yield")


@query("candles")
def candles(t: Tables) -> DataFrame:
    return prices.candles(t.prices, 3)


@query("stats_monthly")
def stats_monthly(t: Tables) -> DataFrame:
    return prices.stats_monthly(t.prices, "2001-10-20", 24)


@query("home_volume_surge")
def home_volume_surge(t: Tables, limit: int = 10) -> DataFrame:
    """Top volume surges per country among featured and benchmark stocks."""
    targets = t.stocks.where("is_active AND coverage IN ('featured', 'benchmark')")
    surge = prices.volume_surge(t.prices, targets).join(
        targets.select("stock_id", "ticker", "name", "market", "country", "currency"), "stock_id")
    return top_ranked(surge, ["country"], "value", limit).select(
        "rank", "stock_id", "ticker", "name", "market", "country", "currency", "value", "volume", "avg_volume_20d", "as_of")


def top_ranked(df: DataFrame, keys: list[str], value: str, limit: int, tie: str = "stock_id", descending: bool = True) -> DataFrame:
    """Top rows per group with RANK. Rows are cut per task before the shuffle (window group limit), so a large group is fine;
    inside the cut the rank of the whole group is known because everything above a kept row is kept too."""
    order = F.desc(value) if descending else F.asc(value)
    w = Window.partitionBy(*keys).orderBy(order, tie)
    cut = df.where(F.col(value).isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    return cut.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(order)).cast("long")).drop("_rn")


@query("financials_trend")
def financials_trend(t: Tables) -> DataFrame:
    return fundamentals.financials_trend(t.statements, 5)


@query("r5_return")
def r5_return(t: Tables) -> DataFrame:
    return prices.five_session_return(t.prices, "stock_id")
