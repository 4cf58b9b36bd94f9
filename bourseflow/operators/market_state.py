"""Indices, FX cards, sector moves and the market mood."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bourseflow import constants as K
from bourseflow.functions.exprs import clamp, dbl, exact_mean, growth, half_up, local_date, ratio
from bourseflow.functions.ranking import medians


def market_indices(indices: DataFrame, index_prices: DataFrame) -> DataFrame:
    """Latest and previous close, one-year sparkline and 52-week range per index (a year of closes per index is short)."""
    w = Window.partitionBy("index_id").orderBy(F.desc("trade_date"))
    n = index_prices.withColumn("rn", F.row_number().over(w)).withColumn("as_of", F.first("trade_date").over(w))
    recent = F.col("trade_date") > F.add_months("as_of", -12)
    g = n.groupBy("index_id").agg(
        F.max("as_of").alias("as_of"), F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("close"),
        F.max(F.when(F.col("rn") == 2, F.col("close"))).alias("prev_close"),
        F.max(F.when(~recent, 1)).isNotNull().alias("full_year"),
        F.max(F.when(recent, F.col("close"))).alias("hi"), F.min(F.when(recent, F.col("close"))).alias("lo"),
        F.array_sort(F.collect_list(F.when(recent, F.struct(F.col("trade_date").alias("date"), "close")))).alias("sparkline"))
    full = F.col("full_year")
    return indices.join(g, "index_id", "left").select(
        "index_id", "code", "country", "currency", "display_order", "as_of", "close", "prev_close",
        half_up(dbl("close") - dbl("prev_close"), 4).alias("change"), growth("close", "prev_close").alias("change_rate"), "sparkline",
        F.when(full, F.col("hi")).alias("high_52w"), F.when(full, F.col("lo")).alias("low_52w"),
        F.when(full, half_up(ratio(dbl("close") - dbl("lo"), dbl("hi") - dbl("lo")), 6)).alias("position_52w"))


def fx_daily_recent(fx: DataFrame) -> DataFrame:
    """DAILY points of the last year, and whether an older point exists."""
    daily = fx.where("granularity = 'DAILY'").select(local_date("rate_at", "Asia/Seoul").alias("date"), "usd_krw")
    bounds = daily.agg(F.add_months(F.max("date"), -12).alias("since"), F.min("date").alias("first"))
    since, first = bounds.select("since").scalar(), bounds.select("first").scalar()
    return daily.where(F.col("date") > since).withColumn("full_year", first <= since)


def fx_card(fx: DataFrame) -> DataFrame:
    """Newest quote against the last DAILY point before its day; 52-week range including the quote."""
    from bourseflow.operators.prices import fx_latest
    q = fx_latest(fx).select("rate_at", dbl("usd_krw").alias("rate"), "granularity",
                             local_date("rate_at", "Asia/Seoul").alias("quote_day"))
    hist = fx_daily_recent(fx)
    day = q.select("quote_day").scalar()
    h = hist.agg(F.max_by("usd_krw", F.when(F.col("date") < day, F.col("date"))).cast("double").alias("prev_close"),
                 F.max("usd_krw").cast("double").alias("hi"), F.min("usd_krw").cast("double").alias("lo"),
                 F.coalesce(F.bool_and("full_year"), F.lit(False)).alias("full_year"))
    j = q.withColumns({c: h.select(c).scalar() for c in h.columns})
    full = F.col("full_year")
    high, low = F.greatest("hi", "rate"), F.least("lo", "rate")
    return j.select("rate_at", "rate", "granularity", "prev_close", half_up(F.col("rate") - F.col("prev_close"), 4).alias("change"),
                    half_up(ratio(F.col("rate") - F.col("prev_close"), "prev_close"), 6).alias("change_rate"),
                    F.when(full, high).alias("high_52w"), F.when(full, low).alias("low_52w"),
                    F.when(full, half_up(ratio(F.col("rate") - low, high - low), 6)).alias("position_52w"))


def fx_staleness(fx: DataFrame, now: str, ttl_hours: float) -> DataFrame:
    """The stored quote to show, and whether the newest SNAPSHOT has outlived its time to live."""
    from bourseflow.operators.prices import fx_latest
    snap = fx.where("granularity = 'SNAPSHOT'").agg(F.max("rate_at")).scalar()
    limit = F.lit(now).cast("timestamp") - F.expr(f"make_dt_interval(0, 0, 0, {ttl_hours * 3600})")
    return fx_latest(fx).select("rate_at", dbl("usd_krw").alias("usd_krw"), "granularity",
                                F.coalesce(snap <= limit, F.lit(True)).alias("stale"))


def sector_flow(bars: DataFrame, sample: DataFrame, dates: Sequence[str], min_n: int = K.MIN_SECTOR_SAMPLE) -> DataFrame:
    """Median five-session return per (as_of, country, sector) at the newest date with at least `min_n` sample bars."""
    from bourseflow.operators.prices import at_snapshots
    keys = ["snapshot", "country", "sector"]
    near = at_snapshots(bars.select("stock_id", "trade_date", "close"), "trade_date", dates, max_age_days=29)
    rows = near.join(sample.select("stock_id", "country", "sector"), "stock_id")
    per_day = rows.groupBy(*keys, "trade_date").agg(F.count(F.lit(1)).alias("cnt"))
    ref = per_day.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("cnt") >= min_n, F.col("trade_date"))),
                                                F.max("trade_date")).alias("ref_date"))
    w = Window.partitionBy(*keys, "stock_id").orderBy(F.desc("trade_date"))
    # sectors x countries x dates: short
    r = (rows.join(F.broadcast(ref), keys).where("trade_date <= ref_date")
         .withColumn("rn", F.row_number().over(w)).withColumn("c5", F.lead("close", 5).over(w))
         .where("rn = 1 AND trade_date = ref_date AND c5 IS NOT NULL")
         .withColumn("r5", ratio("close", "c5") - 1))
    return (ref.join(medians(r, keys, "r5", "sector_r5"), keys, "left")
            .select(*keys, half_up("sector_r5", 6).alias("sector_r5"), F.coalesce("n", F.lit(0)).alias("n"), "ref_date"))


def sector_series(bars: DataFrame, sample: DataFrame) -> DataFrame:
    """A level per (country, sector, date): the mean close of its stocks."""
    return (bars.select("stock_id", "trade_date", "close").join(sample.select("stock_id", "country", "sector"), "stock_id")
            .groupBy("country", "sector", "trade_date").agg(half_up(exact_mean("close"), 4).alias("close")))


def sector_change(series: DataFrame, closed: str) -> DataFrame:
    """Percent change to the session before, closed sessions only."""
    w = Window.partitionBy("country", "sector").orderBy("trade_date")
    return (series.where(F.col("trade_date") <= F.lit(closed).cast("date")).withColumn("p", F.lag("close").over(w))
            .where("p <> 0").select("country", "sector", "trade_date", half_up((ratio("close", "p") - 1) * F.lit(100.0), 4).alias("change_pct")))


def sector_board(changes: DataFrame, sectors: DataFrame) -> DataFrame:
    """All sectors of a country at the country's newest date; NULL where a sector has no value that day."""
    last = changes.groupBy("country").agg(F.max("trade_date").alias("as_of"))
    cells = changes.join(F.broadcast(last), "country").where("trade_date = as_of").select("country", "sector", "change_pct")
    return sectors.join(F.broadcast(last), "country").join(cells, ["country", "sector"], "left")


def _wilder(diffs: Column, side) -> Column:
    """Wilder's running mean of one side of the moves, as a fold over the look-back (at most 261 values)."""
    n = K.RSI_DAYS
    start = F.aggregate(F.slice(diffs, 1, n), F.lit(0.0), lambda a, x: a + side(x)) / F.lit(float(n))
    return F.aggregate(F.slice(diffs, n + 1, K.MOOD_LOOKBACK), start, lambda a, x: (a * F.lit(n - 1.0) + side(x)) / F.lit(float(n)))


def mood_components(index_prices: DataFrame, vix: DataFrame, vix_indices: Sequence[int]) -> DataFrame:
    """Mood score of every index on every date: 52-week position, gap to the 125-day mean, RSI(14) and volatility."""
    w = Window.partitionBy("index_id").orderBy("trade_date")
    last = lambda k: w.rowsBetween(-(k - 1), 0)
    close = dbl("close")
    x = index_prices.withColumn("diff", close - F.lag(close).over(w)).select(
        "index_id", "trade_date", close.alias("c"), F.row_number().over(w).alias("seen"),
        F.max(close).over(last(K.RANGE_DAYS)).alias("hi"), F.min(close).over(last(K.RANGE_DAYS)).alias("lo"),
        F.sum(F.col("close").cast("decimal(18,4)")).over(last(K.MA_DAYS)).cast("double").alias("ma_sum"),
        F.collect_list("diff").over(last(K.MOOD_LOOKBACK - 1)).alias("diffs"))
    x = x.select("index_id", "trade_date", "c", "seen", "hi", "lo", "ma_sum",
                 _wilder(F.col("diffs"), lambda d: F.greatest(d, F.lit(0.0))).alias("gain"),
                 _wilder(F.col("diffs"), lambda d: F.greatest(-d, F.lit(0.0))).alias("loss"))
    # as-of: newest volatility close not older than five days, by a sorted union with the index dates
    both = (index_prices.select("trade_date").distinct().withColumn("v", F.lit(None).cast("double"))
            .unionByName(vix.select("trade_date", dbl("close").alias("v"))))
    day = both.groupBy("trade_date").agg(F.max("v").alias("v"))
    upto = Window.partitionBy(F.lit(0)).orderBy("trade_date")          # one row per calendar date
    vday = day.select("trade_date", F.last("v", ignorenulls=True).over(upto).alias("v"),
                      F.last(F.when(F.col("v").isNotNull(), F.col("trade_date")), ignorenulls=True).over(upto).alias("vd"))
    j = x.join(F.broadcast(vday), "trade_date", "left")
    ma = F.col("ma_sum") / F.lit(float(K.MA_DAYS))
    position = F.when((F.col("seen") >= K.RANGE_DAYS) & (F.col("hi") > F.col("lo")),
                      (F.col("c") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(100.0))
    gap = F.when(F.col("seen") >= K.MA_DAYS, clamp(F.lit(50.0) + (F.col("c") / ma - 1) * F.lit(500.0), 0.0, 100.0))
    fresh = F.col("index_id").isin(*vix_indices) & (F.datediff("trade_date", "vd") <= K.VIX_MAX_LAG)
    vol = F.when(fresh, clamp((F.lit(K.VIX_HIGH) - F.col("v")) / F.lit(K.VIX_HIGH - K.VIX_LOW) * F.lit(100.0), 0.0, 100.0))
    rsi = F.when(F.col("seen") > K.RSI_DAYS, F.when(F.col("loss") == 0, F.when(F.col("gain") == 0, 50.0).otherwise(100.0))
                 .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.try_divide("gain", "loss"))))
    j = j.select("index_id", "trade_date", position.alias("price_position"), gap.alias("ma_gap_score"),
                 rsi.alias("rsi_score"), vol.alias("vix_score"))
    names = ("price_position", "ma_gap_score", "rsi_score", "vix_score")
    have = sum((F.col(c).isNotNull().cast("int") for c in names[1:]), F.col(names[0]).isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in names[1:]), F.coalesce(names[0], F.lit(0.0)))
    score = half_up(F.when(have >= 2, ratio(total, have)), 2)
    return j.select("index_id", "trade_date", *[half_up(c, 2).alias(c) for c in names], score.alias("score")).withColumn(
        "label", mood_label(F.col("score")))


def mood_label(score: Column) -> Column:
    out = F.when(score.isNull(), K.INSUFFICIENT)
    for upper, name in K.MOOD_LABELS:
        out = out.when(score < upper, name)
    return out.otherwise(K.MOOD_TOP)


def mood_points(mood: DataFrame) -> DataFrame:
    """Current session, the session before and five sessions ago per index."""
    w = Window.partitionBy("index_id").orderBy(F.desc("trade_date"))
    rn = F.row_number().over(w)
    role = F.when(F.col("rn") == 1, "current").when(F.col("rn") == 2, "previous").otherwise("week_ago")
    return (mood.withColumn("rn", rn).where(F.col("rn").isin(1, 2, 6)).withColumn("role", role)
            .select("index_id", "role", "trade_date", "score", "label"))


def mood_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keep stored rows of the current formula; rows of another version are computed again. Unscored rows are not stored."""
    good = old.where(F.col("formula_version") == K.MOOD_VERSION)
    fresh = new.where("score IS NOT NULL").withColumn("formula_version", F.lit(K.MOOD_VERSION))
    return good.unionByName(fresh.join(good, ["index_id", "trade_date"], "left_anti"))


def band(score: Column) -> Column:
    i = F.least(F.lit(4), F.floor(F.greatest(score.cast("double"), F.lit(0.0)) / 20).cast("int"))
    return F.when(score.isNull(), K.INSUFFICIENT).otherwise(F.get(F.array(*[F.lit(b) for b in K.BAND_LABELS]), i))


def market_condition(stocks: DataFrame, mood: DataFrame, flow: DataFrame, sessions: DataFrame, base: str) -> DataFrame:
    """0.7 x market mood + 0.3 x sector flow, half up; the mood is dropped when it is more than five sessions old.

    `mood` has one row per country: score and trade_date; `sessions` the trading dates per country."""
    day = F.lit(base).cast("date")
    lag = (sessions.join(F.broadcast(mood), "country").where((F.col("session_date") > F.col("trade_date")) & (F.col("session_date") <= day))
           .groupBy("country").agg(F.count(F.lit(1)).alias("lag")))
    m = mood.join(lag, "country", "left").withColumn("mood", F.when(F.coalesce("lag", F.lit(0)) <= K.MAX_MOOD_LAG, F.col("score")))
    use = (F.col("n") >= K.MIN_SECTOR_SAMPLE) & F.col("sector_r5").isNotNull()
    flow_score = half_up(clamp(F.lit(50.0) + F.when(use, F.col("sector_r5")) * F.lit(500.0), 0.0, 100.0), 2)
    j = (stocks.select("stock_id", "country", "sector").join(F.broadcast(m.select("country", "mood")), "country", "left")
         .join(F.broadcast(flow), ["country", "sector"], "left").withColumn("sector_flow", flow_score))
    raw = F.when(F.col("sector_flow").isNull(), F.col("mood")).otherwise(F.lit(0.7) * F.col("mood") + F.lit(0.3) * F.col("sector_flow"))
    score = half_up(raw, 0).cast("int")
    return j.select("stock_id", "country", "sector", score.alias("score"), band(score).alias("label"), "sector_flow")
