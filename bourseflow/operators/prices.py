"""Latest prices, returns, risk, moving averages and 52-week range for every stock in one pass over the bars."""
from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from bourseflow.functions.exprs import dbl, exact_mean, growth, half_up, ratio


def at_snapshots(df: DataFrame, date_col: str, snapshots: Sequence[date | str], *, max_age_days: int | None = None) -> DataFrame:
    """Repeat each row for the scoring dates that may see it (rows later than a date never reach it)."""
    dates = F.array(*[F.lit(str(d)).cast("date") for d in snapshots])

    def visible(d: Column) -> Column:
        seen = d >= F.col(date_col)
        return seen if max_age_days is None else seen & (F.datediff(d, F.col(date_col)) <= max_age_days)

    span = F.col(date_col) <= F.array_max(dates)
    if max_age_days is not None:
        span = span & (F.col(date_col) >= F.date_sub(F.array_min(dates), max_age_days))
    return df.where(span).withColumn("snapshot", F.explode(F.filter(dates, visible)))


#: No 12 months hold more bars of a key than days, so the newest 367 hold all of a year and the newest bar before it.
YEAR_OF_BARS = 367


def newest_bars(bars: DataFrame, count: int, keys: Sequence[str] = ("stock_id",)) -> DataFrame:
    """The newest `count` bars per key, numbered; each task keeps its own newest ones before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc("trade_date"))
    return bars.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= count)


def number_bars(bars: DataFrame, keys: Sequence[str] = ("stock_id",)) -> DataFrame:
    """rn = 1 is the newest bar of the key; prev is the close of the bar before."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("trade_date"))
    return (bars.withColumn("rn", F.row_number().over(newest))
            .withColumn("prev", F.lead("close").over(newest))
            .withColumn("as_of", F.first("trade_date").over(newest)))


def latest_price(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    """The two newest bars of each stock: close, change and change rate."""
    one = newest_bars(bars, 2).groupBy("stock_id").agg(
        F.max("trade_date").alias("trade_date"), F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("close"),
        F.max(F.when(F.col("rn") == 2, F.col("close"))).alias("prev_close"),
        F.max(F.when(F.col("rn") == 1, F.col("volume"))).alias("volume"))
    return (one.join(stocks.select("stock_id", "market", "country", "currency"), "stock_id")
            .select("stock_id", "market", "country", "currency", "trade_date", "close", "prev_close",
                    (F.col("close") - F.col("prev_close")).alias("change"),
                    growth("close", "prev_close").alias("change_rate"), "volume"))


def fx_latest(fx: DataFrame) -> DataFrame:
    """Newest rate; a SNAPSHOT wins over a DAILY point of the same instant."""
    return fx.orderBy(F.desc("rate_at"), F.desc(F.col("granularity") == "SNAPSHOT")).limit(1)


def price_metrics(bars: DataFrame, keys: Sequence[str] = ("stock_id",)) -> DataFrame:
    """Every price-based metric from one numbered scan and one wide aggregation (same partitioning, no extra shuffle).

    Only the newest year of bars of each key is shuffled, however long its history."""
    numbered = number_bars(newest_bars(bars, YEAR_OF_BARS, keys), keys)
    oldest_first = Window.partitionBy(*keys).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rn, close, as_of, day = F.col("rn"), F.col("close"), F.col("as_of"), F.col("trade_date")
    numbered = (numbered
                .withColumn("ret", F.when(rn <= 252, ratio("close", "prev") - 1))
                .withColumn("peak", F.max(F.when(rn <= 252, close)).over(oldest_first)))

    def upto(bound: Column) -> Column:
        return F.max_by("close", F.when(day <= bound, day))

    def mean_if(cond: Column, value: str, need: int) -> Column:
        v = F.when(cond, F.col(value))
        return F.when(F.count(v) == need, exact_mean(v))

    in_year = day > F.add_months(as_of, -12)
    agg = numbered.groupBy(*keys).agg(
        F.max("as_of").alias("as_of"),
        F.max(F.when(rn == 1, close)).alias("close"), F.max(F.when(rn == 2, close)).alias("prev_close"),
        F.max(F.when(rn == 1, F.col("volume"))).alias("volume"),
        upto(F.date_sub(as_of, 7)).alias("p1w"), upto(F.add_months(as_of, -1)).alias("p1m"),
        upto(F.add_months(as_of, -3)).alias("p3m"), upto(F.add_months(as_of, -6)).alias("p6m"),
        upto(F.add_months(as_of, -12)).alias("p1y"),
        F.when(F.count("ret") == 252, F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("vol"),
        F.when(F.count(F.when(rn <= 252, 1)) == 252, F.min(F.when(rn <= 252, ratio("close", "peak") - 1))).alias("mdd"),
        mean_if(rn <= 20, "close", 20).alias("ma20"), mean_if(rn <= 60, "close", 60).alias("ma60"),
        mean_if(rn <= 120, "close", 120).alias("ma120"),
        mean_if(rn.between(2, 21), "volume", 20).alias("avg_volume"),
        F.max(F.when(in_year, F.col("high"))).alias("high"), F.min(F.when(in_year, F.col("low"))).alias("low"),
        # closes 21, 126 and 252 sessions before the newest one, for momentum
        F.max(F.when(rn == 22, close)).alias("c_21"), F.max(F.when(rn == 127, close)).alias("c_126"),
        F.max(F.when(rn == 253, close)).alias("c_252"))
    return price_columns(agg, keys)


def price_columns(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rounded metrics from what was found at the newest bar of each key."""
    full_year = F.col("p1y").isNotNull()
    return found.select(
        *keys, "as_of", "close", growth("close", "prev_close").alias("change_rate"),
        *[growth("close", f"p{h}").alias(f"return_{h}") for h in ("1w", "1m", "3m", "6m", "1y")],
        half_up("vol", 6).alias("volatility_1y"), half_up("mdd", 6).alias("max_drawdown_1y"),
        half_up("ma20", 4).alias("ma20"), half_up("ma60", 4).alias("ma60"), half_up("ma120", 4).alias("ma120"),
        growth("close", "ma120").alias("ma120_gap"),
        F.when(full_year, F.col("high")).alias("high_52w"), F.when(full_year, F.col("low")).alias("low_52w"),
        F.when(full_year, half_up(ratio(dbl("close") - dbl("low"), dbl("high") - dbl("low")), 6)).alias("position_52w"),
        "volume", half_up("avg_volume", 0).alias("avg_volume_20d"),
        half_up(ratio("volume", "avg_volume"), 6).alias("volume_ratio_20d"), "c_21", "c_126", "c_252")


def candles(bars: DataFrame, months: int) -> DataFrame:
    """Bars within N months of each stock's own newest bar."""
    last = bars.groupBy("stock_id").agg(F.add_months(F.max("trade_date"), -months).alias("since"))
    return bars.join(last, "stock_id").where("trade_date > since").drop("since")


def stats_monthly(bars: DataFrame, today: date | str, months: int) -> DataFrame:
    """Month summaries. First and last close come from min_by / max_by, so the months combine on the map side."""
    this_month = F.trunc(F.lit(str(today)).cast("date"), "month")
    month = F.trunc("trade_date", "month")
    rows = bars.where((F.col("trade_date") >= F.add_months(this_month, -(months - 1)))
                      & (F.col("trade_date") <= F.lit(str(today)).cast("date")))
    agg = rows.groupBy("stock_id", month.alias("m")).agg(
        F.count(F.lit(1)).alias("trading_days"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"),
        exact_mean("close").alias("avg_close"), F.max("high").alias("max_high"), F.min("low").alias("min_low"),
        F.min_by("close", "trade_date").alias("first_close"), F.max_by("close", "trade_date").alias("last_close"),
        F.sum("volume").alias("total_volume"), exact_mean("volume").alias("avg_volume"))
    return agg.select("stock_id", F.date_format("m", "yyyy-MM").alias("month"), "trading_days", "first_date", "last_date",
                      half_up("avg_close", 4).alias("avg_close"), "max_high", "min_low", "first_close", "last_close",
                      growth("last_close", "first_close").alias("monthly_return"), "total_volume",
                      half_up("avg_volume", 0).alias("avg_volume"), (F.col("m") == this_month).alias("is_partial"))


def volume_surge(bars: DataFrame, targets: DataFrame) -> DataFrame:
    """Newest volume over the mean of the 20 sessions before; all 20 must exist."""
    last21 = newest_bars(bars.join(targets.select("stock_id"), "stock_id", "left_semi"), 21)
    base = F.when(F.col("rn").between(2, 21), F.col("volume"))
    agg = last21.groupBy("stock_id").agg(
        F.max("trade_date").alias("as_of"), F.max(F.when(F.col("rn") == 1, F.col("volume"))).alias("volume"),
        F.count(base).alias("days"), exact_mean(base).alias("avg_volume_20d"))
    return (agg.where("days = 20 AND volume > 0 AND avg_volume_20d > 0")
            .select("stock_id", "as_of", "volume", half_up(ratio("volume", "avg_volume_20d"), 4).alias("value"),
                    half_up("avg_volume_20d", 0).alias("avg_volume_20d")))


def five_session_return(bars: DataFrame, key: str, days: DataFrame | None = None) -> DataFrame:
    """Close over the close five sessions before, on every bar date (or on the given (key, trade_date) rows)."""
    w = Window.partitionBy(key).orderBy("trade_date")
    out = (bars.withColumn("c5", F.lag("close", 5).over(w)).where("c5 IS NOT NULL")
           .select(key, "trade_date", half_up(ratio("close", "c5") - 1, 6).alias("r5")))
    return out if days is None else out.join(days, [key, "trade_date"], "left_semi")
