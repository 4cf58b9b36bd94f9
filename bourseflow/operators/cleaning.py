"""Cleaning of incoming rows; rejected rows keep the first reason that applies."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bourseflow import constants as K
from bourseflow.functions.exprs import ratio
from bourseflow.functions.ordering import with_neighbours, with_position


def keep_last(df: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """The last row of each key in arrival order (window group limit keeps one row per task and key)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(arrival))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def unfinished_date(zone: Column, now: str) -> Column:
    """Today's local date while the market is still open, else NULL."""
    local = F.from_utc_timestamp(F.lit(now).cast("timestamp"), zone)
    close = F.create_map(*[x for z, c in K.MARKET_CLOSE.items() for x in (F.lit(z), F.lit(c))])[zone]
    return F.when(F.date_format(local, "HH:mm:ss") < F.coalesce(close, F.lit("23:59:00")), local.cast("date"))


def judge_bars(raw: DataFrame, stocks: DataFrame, now: str, require_volume: bool = True) -> DataFrame:
    """Deduplicated bars with a reason column (NULL = good); bars of stocks that are not in the list are rejected too."""
    listed = stocks.select("stock_id", "timezone", F.lit(True).alias("_listed"))
    bars = keep_last(raw, ["stock_id", "trade_date"], "arrival").join(listed, "stock_id", "left")
    c = F.col
    gap = c("open").isNull() | c("high").isNull() | c("low").isNull() | c("volume").isNull()
    reason = (F.when(c("_listed").isNull(), K.BAD_UNKNOWN)
              .when(c("trade_date") == unfinished_date(c("timezone"), now), K.BAD_UNFINISHED)
              .when(c("close").isNull(), K.BAD_NO_CLOSE)
              .when(F.lit(require_volume) & gap, K.BAD_NO_OHLCV)
              .when((c("close") <= 0) | (c("low") <= 0), K.BAD_PRICE)
              .when(c("high") < c("low"), K.BAD_HIGH_LOW)
              .when(c("volume") < 0, K.BAD_VOLUME))
    return bars.withColumn("reason", reason).drop("_listed")


def clean_bars(raw: DataFrame, stocks: DataFrame, now: str, require_volume: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good bars, with their arrival, and rejected ones with reason and JSON row."""
    return split_bars(judge_bars(raw, stocks, now, require_volume))


def split_bars(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judged bars as good ones and rejected ones."""
    good = judged.where("reason IS NULL").drop("reason", "timezone")
    bad = judged.where("reason IS NOT NULL")
    return good, bad.select("reason", F.to_json(F.struct("stock_id", "trade_date", "open", "high", "low", "close", "volume")).alias("row"),
                            "stock_id", "trade_date")


def judge_fx(points: DataFrame, window: int = K.FX_WINDOW, max_dev: float = K.FX_MAX_DEVIATION) -> DataFrame:
    """FX points with the median of up to five valid points on each side and a reason (NULL = good)."""
    pts = keep_last(points, ["granularity", "rate_at"], "arrival")
    valid = with_position(pts.where("usd_krw > 0"), ["granularity"], "rate_at")
    near = with_neighbours(valid, ["granularity"], "pos", "usd_krw", window)
    s = F.array_sort("near")
    n = F.size("near")
    mid = (F.get(s, F.floor((n - 1) / 2).cast("int")).cast("double") + F.get(s, F.floor(n / 2).cast("int")).cast("double")) / F.lit(2.0)
    near = near.withColumn("median", F.when(n > 0, mid)).drop("near", "pos")
    off = F.abs(ratio("usd_krw", "median") - 1) > max_dev
    judged = near.withColumn("reason", F.when(F.coalesce(off, F.lit(False)), "deviation"))
    blank = pts.where("usd_krw IS NULL OR usd_krw <= 0").withColumn("median", F.lit(None).cast("double")).withColumn("reason", F.lit(K.BAD_FX))
    return judged.unionByName(blank.select(judged.columns))


def is_common_stock(country: Column, ticker: Column, name: Column) -> Column:
    """Ordinary shares only: Korean codes of six characters ending in 0 that are no blank-cheque company; US tickers of
    ordinary form without fund words in the name."""
    # fixed values: ticker form, fifth letters of preferred shares, rights and units, and words in names
    kr = (F.length(ticker) == 6) & ticker.endswith("0") & ~name.rlike("스팩|기업인수목적")
    us = (ticker.rlike("^[A-Z]{1,5}(-[A-OQ-Z])?$") & ~name.rlike(r"(?i)\bETF\b|\bETN\b|\bFUND\b|\bACQUISITION\b")
          & ~((F.length(ticker) == 5) & F.substring(ticker, 5, 1).isin(*"MNOPQRTUVWXZ")))
    return F.when(country == "KR", kr).otherwise(us)
