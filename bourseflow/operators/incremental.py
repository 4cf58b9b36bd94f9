"""What to load next, which histories changed, and which stored rows may go."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bourseflow import constants as K
from bourseflow.functions.exprs import ratio


def previous_weekday(d: Column) -> Column:
    w = F.weekday(d)
    return F.when(w == 5, F.date_sub(d, 1)).when(w == 6, F.date_sub(d, 2)).otherwise(d)


def last_closed_day(country: Column, now: Column) -> Column:
    """Newest weekday whose data is final (after the country's cutoff time)."""
    def one(code: str) -> Column:
        zone, cutoff = K.DATA_CUTOFF[code]
        local = F.from_utc_timestamp(now, zone)
        day = local.cast("date")
        return previous_weekday(F.when(F.date_format(local, "HH:mm:ss") >= cutoff, day).otherwise(F.date_sub(day, 1)))
    return F.when(country == "KR", one("KR")).when(country == "US", one("US"))


def start_dates(stocks: DataFrame, bars: DataFrame, today: str, now: str, history_days: int = 730, full: bool = False) -> DataFrame:
    """Per stock: first and last date to request, or why nothing is requested."""
    from bourseflow.operators.cleaning import unfinished_date
    last = bars.groupBy("stock_id").agg(F.max("trade_date").alias("last"))
    day = F.lit(today).cast("date")
    local = F.least(day, F.from_utc_timestamp(F.lit(now).cast("timestamp"), F.col("timezone")).cast("date"))
    open_day = unfinished_date(F.col("timezone"), now)
    end = F.when(local == open_day, F.date_sub(local, 1)).otherwise(local)
    fresh = F.date_sub(day, history_days)
    start = fresh if full else F.coalesce(F.date_add("last", 1), fresh)
    j = stocks.select("stock_id", "timezone").join(last, "stock_id", "left").select("stock_id", start.alias("start"), end.alias("end"))
    weekend = (F.datediff("end", "start") <= 1) & (F.weekday("start") >= 5) & (F.weekday("end") >= 5)
    return j.withColumn("skip_reason", F.when(F.col("start") > F.col("end"), "up to date").when(weekend, "weekend"))


def adjusted_by_change_rate(stored: DataFrame, fresh: DataFrame, tol: float = K.ADJUST_TOLERANCE) -> DataFrame:
    """New bars with the first date on which the exchange's change rate does not fit the stored close before it.

    `flag_date` NULL: append all; otherwise append the bars before it and reload the whole history."""
    last = stored.groupBy("stock_id").agg(F.max("trade_date").alias("trade_date"), F.max_by("close", "trade_date").alias("close"))
    both = (last.withColumn("change_rate", F.lit(None).cast("double")).withColumn("fresh", F.lit(False))
            .unionByName(fresh.select("stock_id", "trade_date", "close", "change_rate").withColumn("fresh", F.lit(True))))
    w = Window.partitionBy("stock_id").orderBy("trade_date")
    expected = F.lag("close").over(w).cast("double") * (F.lit(1.0) + F.col("change_rate") / F.lit(100.0))
    both = both.withColumn("off", F.abs(ratio(F.col("close"), expected) - 1) > tol)
    flags = both.groupBy("stock_id").agg(F.min(F.when(F.col("off"), F.col("trade_date"))).alias("flag_date"))
    return both.where("fresh").drop("fresh", "off", "change_rate").join(flags, "stock_id")


def adjusted_by_overlap(stored: DataFrame, fresh: DataFrame, tol: float = K.ADJUST_TOLERANCE) -> DataFrame:
    """Stocks whose close on the last stored date differs in the new download."""
    last = stored.groupBy("stock_id").agg(F.max("trade_date").alias("trade_date"), F.max_by("close", "trade_date").alias("stored_close"))
    j = fresh.select("stock_id", "trade_date", "close").join(last, ["stock_id", "trade_date"])
    return j.where(F.abs(ratio("close", "stored_close") - 1) > tol).select("stock_id", "trade_date", "stored_close", "close")


def annual_reports(filings: DataFrame, cursor: str) -> DataFrame:
    """New annual reports after the cursor, without attachment-only ones (no state, so streams use it too)."""
    skip = F.lit(False)
    for p in K.FEED_SKIP_PREFIXES:
        skip = skip | F.col("title").startswith(p)
    return filings.where((F.col("rcept_no") > cursor) & F.col("title").contains(K.ANNUAL_REPORT_WORD) & ~skip)


def feed_filings(filings: DataFrame, cursor: str) -> DataFrame:
    """The same, one row per receipt number."""
    return annual_reports(filings, cursor).dropDuplicates(["rcept_no"])


def next_cursor(filings: DataFrame, cursor: str) -> DataFrame:
    """Where the next run starts: the greatest receipt number seen, attachment filings included (the old one when nothing came)."""
    top = filings.where(F.col("rcept_no") > cursor).agg(F.max(F.struct("rcept_no", "filed_at")).alias("t"))
    return top.select(F.coalesce("t.rcept_no", F.lit(cursor)).alias("last_rcept_no"), F.col("t.filed_at").cast("date").alias("last_rcept_dt"))


def prune_targets(stocks: DataFrame, synced: DataFrame, watched: DataFrame, held: DataFrame, today: str, grace: int = 30) -> DataFrame:
    """Benchmark stocks nobody watches or holds whose detail was not opened within the grace period."""
    old = F.col("synced_at").isNull() | (F.col("synced_at") < F.date_sub(F.lit(today).cast("date"), grace))
    return (stocks.where("coverage = 'benchmark'").select("stock_id").join(synced, "stock_id", "left").where(old)
            .join(watched.select("stock_id"), "stock_id", "left_anti").join(held.select("stock_id"), "stock_id", "left_anti")
            .select("stock_id").distinct())


def prune_prices(bars: DataFrame, targets: DataFrame, cutoff: str) -> DataFrame:
    """Rows to keep: everything of other stocks, recent bars of the targets."""
    mark = targets.withColumn("target", F.lit(True))
    return bars.join(mark, "stock_id", "left").where(F.col("target").isNull() | (F.col("trade_date") >= F.lit(cutoff).cast("date"))).drop("target")


def prune_valuations(valuations: DataFrame, targets: DataFrame, cutoff: str) -> DataFrame:
    last = valuations.groupBy("stock_id").agg(F.max("as_of").alias("last"))
    mark = targets.join(last, "stock_id").select("stock_id", F.least(F.lit(cutoff).cast("date"), "last").alias("cut"))
    return valuations.join(mark, "stock_id", "left").where("cut IS NULL OR as_of >= cut").drop("cut")


def prune_statements(statements: DataFrame, targets: DataFrame, years: int, quarters: int) -> DataFrame:
    """Keep the newest N annual and M quarterly periods of the targets."""
    annual = (F.col("period_type") == "FY").alias("annual")
    mark = targets.withColumn("target", F.lit(True))
    w = Window.partitionBy("stock_id", "annual").orderBy(F.desc("period_end"))
    s = statements.withColumn("annual", annual).withColumn("rk", F.dense_rank().over(w)).join(mark, "stock_id", "left")
    limit = F.when(F.col("annual"), F.lit(years)).otherwise(F.lit(quarters))
    return s.where(F.col("target").isNull() | (F.col("rk") <= limit)).drop("annual", "rk", "target")


def listing_changes(stocks: DataFrame, listing: DataFrame, min_ratio: float = 0.5) -> DataFrame:
    """Old list against new list per country and ticker: added, moved, renamed, deactivated.

    Nothing is deactivated in a country whose new list has fewer than half of the active listed stocks."""
    old = stocks.select("country", "ticker", F.col("market").alias("old_market"), F.col("name").alias("old_name"), "coverage", "is_active")
    new = listing.select("country", "ticker", F.col("market").alias("new_market"), F.col("name").alias("new_name"))
    sizes = (old.groupBy("country").agg(F.count_if((F.col("coverage") == "listed") & F.col("is_active")).alias("active"))
             .join(new.groupBy("country").agg(F.count(F.lit(1)).alias("fresh")), "country", "left"))
    j = old.join(new, ["country", "ticker"], "full").join(F.broadcast(sizes), "country", "left")
    listed = F.col("coverage") == "listed"
    action = (F.when(F.col("old_market").isNull(), "added")
              .when(listed & F.col("new_market").isNotNull() & (F.col("new_market") != F.col("old_market")), "moved")
              .when(listed & F.col("new_market").isNotNull() & (F.col("new_name") != F.col("old_name")), "renamed")
              .when(listed & F.col("new_market").isNotNull() & ~F.col("is_active"), "reactivated")
              .when(listed & F.col("is_active") & F.col("new_market").isNull()
                    & (F.coalesce("fresh", F.lit(0)) >= F.col("active") * F.lit(min_ratio)), "deactivated"))
    return j.withColumn("action", action).where("action IS NOT NULL").select("country", "ticker", "action", "old_market", "new_market")
