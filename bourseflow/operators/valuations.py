"""Valuation rows derived from closes and statements, and FX conversion of statements."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from bourseflow.accounts import MONEY_ACCOUNTS
from bourseflow.functions.exprs import dbl, half_up, local_date, positive, ratio
from bourseflow.operators.band_join import band_pairs


def statement_lag(bars: DataFrame, annual: DataFrame, lag_days: int = 90) -> DataFrame:
    """Each bar with the newest annual statement published by then (end + lag <= bar date).

    Statements and bars are merged into one timeline per stock; the last statement seen is carried forward."""
    fy = annual.where("period_type = 'FY'").select(
        "stock_id", F.date_add("period_end", lag_days).alias("day"), F.lit(0).alias("kind"), F.lit(None).cast("decimal(18,4)").alias("close"),
        F.struct("period_end", dbl("net_income").alias("ni"), dbl("total_equity").alias("eq")).alias("f"))
    b = bars.select("stock_id", F.col("trade_date").alias("day"), F.lit(1).alias("kind"), "close").withColumn("f", F.lit(None).cast(fy.schema["f"].dataType))
    w = Window.partitionBy("stock_id").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (fy.unionByName(b).withColumn("f", F.last("f", ignorenulls=True).over(w)).where("kind = 1 AND f IS NOT NULL")
            .select("stock_id", F.col("day").alias("trade_date"), "close", "f.*"))


def derived_daily(bars: DataFrame, annual: DataFrame, shares: DataFrame, start: str) -> DataFrame:
    """PER, PBR, EPS, BPS and market value per bar from the lagged annual statement."""
    j = statement_lag(bars, annual).where(F.col("trade_date") >= F.lit(start).cast("date")).join(shares.where("shares > 0"), "stock_id")
    return j.select("stock_id", F.col("trade_date").alias("as_of"), *_per_share(dbl("close"), F.col("ni"), F.col("eq"), dbl("shares")))


def _per_share(close: Column, ni: Column, eq: Column, shares: Column) -> list[Column]:
    eps, bps = ni / shares, eq / shares
    return [half_up(F.when(ni > 0, close / eps), 4).alias("per"), half_up(F.when(eq > 0, close / bps), 4).alias("pbr"),
            half_up(eps, 4).alias("eps"), half_up(bps, 4).alias("bps"), half_up(close * shares, 0).alias("market_cap")]


def derived_latest(price: DataFrame, annual: DataFrame, base: DataFrame) -> DataFrame:
    """Newest close on filed shares; depositary receipts divide the shares (and multiply dividends) by their ratio."""
    newest = annual.where("period_type = 'FY'").groupBy("stock_id").agg(
        F.max_by("net_income", "period_end").cast("double").alias("ni"), F.max_by("total_equity", "period_end").cast("double").alias("eq"))
    j = price.select("stock_id", "trade_date", "close").join(base.where("shares > 0"), "stock_id").join(newest, "stock_id", "left")
    k = F.coalesce(dbl("share_ratio"), F.lit(1.0))
    shares = dbl("shares") / k
    return j.select("stock_id", F.col("trade_date").alias("as_of"), *_per_share(dbl("close"), F.col("ni"), F.col("eq"), shares),
                    half_up(shares, 0).alias("shares_outstanding"), half_up(dbl("dps") * k, 4).alias("dps"))


def zero_is_missing(ratios: DataFrame, caps: DataFrame) -> DataFrame:
    """Source zeros mean 'not computable', except a dividend of zero."""
    j = ratios.join(caps, ["stock_id", "as_of"], "left")
    return j.select("stock_id", "as_of", positive("per").alias("per"), positive("pbr").alias("pbr"), F.nullif("eps", F.lit(0)).alias("eps"),
                    F.nullif("bps", F.lit(0)).alias("bps"), "market_cap", "shares_outstanding", "dps")


def from_close(bars: DataFrame, current: DataFrame) -> DataFrame:
    """PER and PBR of every bar on the current EPS and BPS, two digits half up."""
    j = bars.select("stock_id", "trade_date", "close").join(current.select("stock_id", "eps", "bps", "shares"), "stock_id")
    per = lambda c: half_up(F.when(F.col(c) > 0, ratio("close", c)), 2)
    return j.select("stock_id", F.col("trade_date").alias("as_of"), per("eps").alias("per"), per("bps").alias("pbr"),
                    F.when(F.col("shares") > 0, half_up(dbl("close") * F.col("shares"), 4)).alias("market_cap"))


def carry_dividend(valuations: DataFrame) -> DataFrame:
    w = Window.partitionBy("stock_id").orderBy("as_of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return valuations.withColumn("dps", F.coalesce("dps", F.last("dps", ignorenulls=True).over(w)))


def rate_on(days: DataFrame, fx: DataFrame, max_age: int = 10) -> DataFrame:
    """USD/KRW on each day or the nearest earlier day within `max_age`. Both sides are bounded by the calendar."""
    daily = fx.where("granularity = 'DAILY'").select(local_date("rate_at", "Asia/Seoul").alias("day"), F.col("usd_krw").alias("rate"))
    daily = daily.groupBy("day").agg(F.max("rate").alias("rate"))
    both = daily.unionByName(days.select("day").distinct().withColumn("rate", F.lit(None).cast("decimal(12,4)")))
    both = both.groupBy("day").agg(F.max("rate").alias("rate"))
    w = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.select("day", F.last("rate", ignorenulls=True).over(w).alias("rate"),
                       F.last(F.when(F.col("rate").isNotNull(), F.col("day")), ignorenulls=True).over(w).alias("rate_day"))
    return seen.where(F.datediff("day", "rate_day") <= max_age)


def to_won(statements: DataFrame, fx: DataFrame) -> DataFrame:
    """USD statements in won at the period-end rate, keeping currency and rate. Other currencies, or a missing rate, are
    rejected: those rows come back with a problem and no amounts."""
    cur = F.upper(F.coalesce("currency", F.lit("KRW")))
    rates = rate_on(statements.select(F.col("period_end").alias("day")), fx).select(F.col("day").alias("period_end"), "rate")
    j = statements.withColumn("currency", cur).join(F.broadcast(rates), "period_end", "left")
    usd = F.col("currency") == "USD"
    problem = F.when(~F.col("currency").isin("KRW", "USD"), "currency").when(usd & F.col("rate").isNull(), "no rate")
    j = j.withColumn("problem", problem).withColumn("fx_rate", F.when(usd, F.col("rate")))
    rate = F.coalesce("fx_rate", F.lit(1)).cast("decimal(12,4)")
    amount = lambda c: F.round(F.when(F.col("problem").isNull(), F.col(c).cast("decimal(24,2)") * rate), 2).cast("decimal(24,2)").alias(c)
    return j.select("stock_id", "period_end", "currency", "fx_rate", "problem", *[amount(c) for c in MONEY_ACCOUNTS if c in statements.columns])


def merge_supplement(primary: DataFrame, extra: DataFrame, tolerance: int = 7) -> DataFrame:
    """Fill blanks of the main source from a second one whose period ends within a week, add its other periods, note revenue gaps.

    The first main row in date order is the match. Only keys are paired, by a band join; amounts join the pair that was chosen. Both
    sources have one row per stock and period."""
    amounts = [c for c in MONEY_ACCOUNTS if c in primary.columns and c in extra.columns]
    p = primary.select("stock_id", "period_end", *[dbl(c).alias(c) for c in amounts])
    s = extra.select("stock_id", F.col("period_end").alias("s_end"), *[dbl(c).alias(f"s_{c}") for c in amounts])
    pairs = band_pairs(p.select("stock_id", "period_end"), s.select("stock_id", "s_end"), ["stock_id"], "period_end", "s_end", tolerance)
    met = pairs.groupBy("stock_id", "s_end").agg(F.min("period_end").alias("period_end"))
    first = met.groupBy("stock_id", "period_end").agg(F.min("s_end").alias("s_end"))
    j = p.join(first, ["stock_id", "period_end"], "left").join(s, ["stock_id", "s_end"], "left")
    # a supplement equity of exactly zero is not a value
    sup = {c: F.col(f"s_{c}") if c != "total_equity" else F.nullif(F.col("s_total_equity"), F.lit(0.0)) for c in amounts}
    filled = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull() & sup[c].isNotNull(), F.lit(c)) for c in amounts])), ",")
    gap = F.abs(ratio("revenue", "s_revenue") - 1) > 0.02
    merged = j.select("stock_id", "period_end", *[F.coalesce(c, sup[c]).alias(c) for c in amounts],
                      filled.alias("filled"), F.coalesce(gap & (F.col("s_revenue") != 0) & (F.col("revenue") != 0), F.lit(False)).alias("revenue_gap"),
                      F.lit("primary").alias("path"))
    alone = s.join(met, ["stock_id", "s_end"], "left_anti").select(
        "stock_id", F.col("s_end").alias("period_end"), *[F.col(f"s_{c}").alias(c) for c in amounts],
        F.lit("").alias("filled"), F.lit(False).alias("revenue_gap"), F.lit("supplement").alias("path"))
    return merged.unionByName(alone)


def fix_zero_equity(statements: DataFrame) -> DataFrame:
    """An equity of exactly zero was not filed: assets minus liabilities, or NULL. Negative equity stays."""
    rest = F.col("total_assets") - F.col("total_debt")
    fixed = F.when(F.col("total_equity") == 0, F.when(rest != 0, rest)).otherwise(F.col("total_equity"))
    return statements.withColumn("equity_note", F.when(F.col("total_equity") == 0, F.when(rest != 0, "assets - debt").otherwise("blank"))).withColumn("total_equity", fixed)
