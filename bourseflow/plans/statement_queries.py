"""Valuation rows and statement builders over the whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bourseflow.accounts import LINE_ACCOUNTS
from bourseflow.functions.exprs import half_up
from bourseflow.operators import prices, statements as st, valuations as va
from bourseflow.plans.catalog import query
from bourseflow.sources import sample_filings
from bourseflow.sources.market_tables import Tables


@query("j_asof_fy_lag")
def j_asof_fy_lag(t: Tables) -> DataFrame:
    return va.statement_lag(t.prices, t.statements).select("stock_id", "trade_date", "period_end", "ni")


@query("valuation_derived_kr")
def valuation_derived_kr(t: Tables) -> DataFrame:
    shares = t.stocks.where("country = 'KR'").select("stock_id", "shares")
    return va.derived_daily(t.prices, t.statements, shares, "2000-10-31")


@query("valuation_derived_us")
def valuation_derived_us(t: Tables) -> DataFrame:
    base = t.stocks.where("country = 'US'").select("stock_id", "shares", "share_ratio", F.when(F.col("stock_id") % 3 == 0, F.lit(1.25)).alias("dps"))
    return va.derived_latest(prices.latest_price(t.prices, t.stocks), t.statements, base)


def source_ratios(t: Tables) -> DataFrame:
    """Valuations as a source sends them: zero where there is no value."""
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return t.valuations.select("stock_id", "as_of", zero("per"), zero("pbr"), zero("eps"), zero("bps"), zero("dps"))


@query("valuation_zero_null")
def valuation_zero_null(t: Tables) -> DataFrame:
    caps = t.valuations.where("pbr IS NOT NULL").select("stock_id", "as_of", "market_cap", "shares_outstanding")
    return va.zero_is_missing(source_ratios(t), caps)


@query("valuation_from_close")
def valuation_from_close(t: Tables) -> DataFrame:
    from bourseflow.operators.fundamentals import latest_valuation
    cur = latest_valuation(t.valuations).select("stock_id", "eps", "bps", F.col("shares_outstanding").alias("shares"))
    return va.from_close(t.prices, cur)


@query("dps_carry_forward")
def dps_carry_forward(t: Tables) -> DataFrame:
    v = t.valuations.select("stock_id", "as_of", F.when(F.year("as_of") % 3 == 1, F.col("dps")).alias("dps"))
    return va.carry_dividend(v)


def foreign(t: Tables) -> DataFrame:
    """Annual statements, some of them in another currency."""
    s = F.col("stock_id") % 4
    return t.statements.withColumn("currency", F.when(s == 1, "USD").when((s == 2) & (F.year("period_end") == 1997), "JPY").when(s == 3, "krw"))


@query("j_asof_fx")
def j_asof_fx(t: Tables) -> DataFrame:
    days = t.prices.select(F.date_add("trade_date", 6).alias("day")).distinct()
    return va.rate_on(days, t.fx)


@query("fin_currency")
def fin_currency(t: Tables) -> DataFrame:
    return va.to_won(foreign(t), t.fx)


@query("fin_merge_supplement")
def fin_merge_supplement(t: Tables) -> DataFrame:
    """Main source without some cells and years; second source a few days off with other revenue for some stocks."""
    s, y = F.col("stock_id"), F.year("period_end")
    main = t.statements.where("operating_income >= 0").withColumn("net_income", F.when(s % 3 != 0, F.col("net_income"))).withColumn(
        "total_equity", F.when(y % 2 == 0, F.col("total_equity")))
    extra = (t.statements.withColumn("period_end", F.date_sub("period_end", (s % 9).cast("int")))
             .withColumn("revenue", F.when(s % 7 == 1, F.col("revenue") * 2).otherwise(F.col("revenue")))
             .withColumn("total_equity", F.when(s % 5 == 0, F.lit(0)).otherwise(F.col("total_equity"))))
    return va.merge_supplement(main, extra)


@query("fin_zero_equity")
def fin_zero_equity(t: Tables) -> DataFrame:
    s = F.col("stock_id")
    x = t.statements.select("stock_id", "period_end", "total_assets", F.when(s % 5 != 1, F.col("total_debt")).alias("total_debt"),
                            F.when(s % 3 == 0, F.lit(0)).otherwise(F.col("total_equity")).cast("decimal(24,2)").alias("total_equity"))
    return va.fix_zero_equity(x)


@query("fin_concept_priority")
def fin_concept_priority(t: Tables) -> DataFrame:
    return st.annual_from_facts(sample_filings.facts(t), 5)


@query("fin_derive_missing")
def fin_derive_missing(t: Tables) -> DataFrame:
    a = st.annual_from_facts(sample_filings.facts(t), 5)
    return a.where("derived <> ''").select("company", "period_end", "operating_income", "total_debt", "derived")


@query("fin_quarters")
def fin_quarters(t: Tables) -> DataFrame:
    return st.quarters_from_facts(sample_filings.facts(t))


@query("dps_annual")
def dps_annual(t: Tables) -> DataFrame:
    return st.dividends(sample_filings.facts(t), "2001-11-30")


@query("shares_latest")
def shares_latest(t: Tables) -> DataFrame:
    return st.newest_shares(sample_filings.shares(t))


@query("fin_account_map")
def fin_account_map(t: Tables) -> DataFrame:
    a = st.annual_from_lines(sample_filings.lines(t))
    return a.select("company", "period_end", "consolidated", *[half_up(c, 2).alias(c) for c in LINE_ACCOUNTS], "filled")
