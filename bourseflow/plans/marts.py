"""Marts that several queries share, wired from the market tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bourseflow.functions.exprs import half_up, ratio
from bourseflow.operators import fundamentals, prices
from bourseflow.sources.market_tables import Tables
from bourseflow.sources.stored import stored


def themes(t: Tables) -> DataFrame:
    """Primary theme and family of each stock (stocks without one have no row). Themes are a fixed short list."""
    return (t.members.where("is_primary").select("stock_id", "group_id")
            .join(F.broadcast(t.groups), "group_id"))


def with_family(t: Tables, df: DataFrame) -> DataFrame:
    """Adds group_id, theme and family; a stock without a primary theme counts as general."""
    th = themes(t).select("stock_id", "group_id", "theme", "family", "commodity_linked")
    return df.join(th, "stock_id", "left").withColumn("family", F.coalesce("family", F.lit("general")))


#: Bars that one task orders, about.
BARS_IN_TASK = 150_000


def keep_facts(t: Tables) -> Tables:
    """Daily bars and annual statements as stored tables, for queries that read them several times: each is made from the trades once, and
    everything these tables derive from them reads the stored rows."""
    if not t.facts_kept:
        bars, statements = t.prices, t.statements
        t.prices = stored(t.spark, f"bars|{t.folder}", lambda: bars)
        t.statements = stored(t.spark, f"statements|{t.folder}", lambda: statements)
        t.facts_kept = True
    return t


def bar_parts(t: Tables) -> int:
    """How many parts the bars are cut into by stock, so that a task's share does not grow with the table (a stock's bars are bounded by the
    calendar). The count of a stored table is read from its files' footers."""
    return max(1, -(-keep_facts(t).prices.count() // BARS_IN_TASK))


def stock_metrics(t: Tables, price_rows: DataFrame | None = None) -> DataFrame:
    """One wide row per stock: price metrics, newest valuation, newest annual ratios, KRW market value."""
    if price_rows is None:
        parts = bar_parts(t)
        price_rows = prices.price_metrics(t.prices.repartition(parts, "stock_id"))
    fx = prices.fx_latest(t.fx)
    s = t.stocks.select("stock_id", "market", "country", "currency")
    j = (price_rows.join(s, "stock_id")
         .join(fundamentals.latest_valuation(t.valuations), "stock_id", "left")
         .join(fundamentals.fin_ratios(t.statements), "stock_id", "left"))
    rate = fx.select(F.col("usd_krw").cast("double")).scalar()
    return (j.withColumn("fx_usd_krw", rate)
            .withColumn("market_cap_krw", half_up(F.col("market_cap") * F.when(F.col("currency") == "USD", F.col("fx_usd_krw"))
                                                  .otherwise(F.lit(1.0)), 0))
            .withColumn("dividend_yield", half_up(ratio("dps", "close"), 6)))


def metrics_table(t: Tables) -> DataFrame:
    """The wide metric rows as a stored table (one row per stock), for the reports that read them several times."""
    return stored(t.spark, f"stock metrics|{t.folder}", lambda: stock_metrics(t))
