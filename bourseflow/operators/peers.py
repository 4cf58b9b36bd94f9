"""Theme comparison: ranks and averages inside a theme, rebased price series, valuation against peers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bourseflow.functions.exprs import half_up, positive, ratio
from bourseflow.functions.ranking import insert_positions, medians

# metric -> (higher is better, digits of the average)
PEER_METRICS = {"return_1m": (True, 6), "return_3m": (True, 6), "return_1y": (True, 6), "per": (False, 4), "pbr": (False, 4),
                "roe": (True, 6), "operating_margin": (True, 6), "revenue_yoy": (True, 6), "market_cap_krw": (True, 0),
                "score": (True, 2)}


def peer_values(members: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per theme, member and metric that has a value (PER and PBR only when positive)."""
    wide = members.join(metrics, "stock_id").withColumn("per", positive("per")).withColumn("pbr", positive("pbr"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in PEER_METRICS])
    return (wide.select("group_id", "stock_id", "featured", F.explode(cells).alias("c"))
            .select("group_id", "stock_id", "featured", "c.metric", "c.value").where("value IS NOT NULL"))


def peers(rows: DataFrame) -> DataFrame:
    """(theme, stock, metric) rows with value, rank and theme average.

    The comparison set of a theme is its featured members plus the stock that is looked at, so a stock outside the featured
    set is placed among the featured values and joins the average. Each row is handled once; no member pairs are built."""
    pool = rows.where("featured")
    exact = F.sum(F.col("value").cast("decimal(28,6)")).cast("double")
    sums = pool.groupBy("group_id", "metric").agg(exact.alias("total"))
    placed = insert_positions(rows, pool, ["group_id", "metric"], "value").join(F.broadcast(sums), ["group_id", "metric"], "left")
    low_first = F.col("metric").isin(*[m for m, (high, _) in PEER_METRICS.items() if not high])
    rank = F.when(low_first, F.col("less")).otherwise(F.col("n") - F.col("less") - F.col("equal")) + 1
    mean = F.when(F.col("featured"), ratio("total", "n")).otherwise(
        (F.coalesce("total", F.lit(0.0)) + F.col("value")) / (F.col("n") + 1))
    avg = F.coalesce(*[F.when(F.col("metric") == m, half_up(mean, d)) for m, (_, d) in PEER_METRICS.items()])
    return placed.select("group_id", "stock_id", "featured", "metric", "value", rank.alias("rank"), avg.alias("avg"))


def rebased(bars: DataFrame, members: DataFrame, months: int) -> DataFrame:
    """Close series per theme member with the first close of the range set to 100; the range ends at the theme's last bar."""
    mb = members.select("group_id", "stock_id")
    last = bars.groupBy("stock_id").agg(F.max("trade_date").alias("d"))
    ends = mb.join(last, "stock_id").groupBy("group_id").agg(F.add_months(F.max("d"), -months).alias("since"))
    rows = bars.select("stock_id", "trade_date", "close").join(
        mb.join(F.broadcast(ends), "group_id"), "stock_id").where("trade_date > since")
    first = F.first("close").over(Window.partitionBy("group_id", "stock_id").orderBy("trade_date"))
    return rows.select("group_id", "stock_id", "trade_date", half_up(ratio(F.col("close"), first) * F.lit(100.0), 4).alias("indexed"))


def rebased_grid(series: DataFrame) -> DataFrame:
    """Every date of the theme for every member; NULL where the member has no bar.

    The dates of a theme are bounded by the calendar, so each member row carries the short date list and explodes it."""
    dates = series.groupBy("group_id").agg(F.array_sort(F.collect_set("trade_date")).alias("dates"))
    grid = (series.select("group_id", "stock_id").distinct().join(F.broadcast(dates), "group_id")
            .select("group_id", "stock_id", F.explode("dates").alias("trade_date")))
    return grid.join(series, ["group_id", "stock_id", "trade_date"], "left")


def premium(members: DataFrame, metrics: DataFrame) -> DataFrame:
    """Own PER and PBR against the mean of the other members with a positive value: (sum - self) / (n - 1)."""
    rows = members.join(metrics.select("stock_id", "per", "pbr"), "stock_id").select(
        "group_id", "stock_id", positive("per").cast("decimal(24,4)").alias("per"), positive("pbr").cast("decimal(24,4)").alias("pbr"))
    sums = rows.groupBy("group_id").agg(*[x for c in ("per", "pbr") for x in (
        F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))])

    def diff(c: str) -> Column:
        other = ratio(F.col(f"{c}_sum") - F.col(c), F.col(f"{c}_n") - 1)
        return half_up(ratio(F.col(c), other) - F.lit(1.0), 4)

    return rows.join(F.broadcast(sums), "group_id").select("group_id", "stock_id", diff("per").alias("per_premium"),
                                                           diff("pbr").alias("pbr_premium"))


def financial_profile(metrics: DataFrame, annual: DataFrame, themed: DataFrame) -> DataFrame:
    """P/B, P/E and mean ROE (annual statements of the last 1000 days) of the financial family."""
    fin = themed.where("family = 'financial'").select("stock_id", "country", "group_id")
    fy = annual.where("period_type = 'FY'").join(fin.select("stock_id"), "stock_id", "left_semi")
    last = F.max("period_end").over(Window.partitionBy("stock_id"))
    usable = (F.datediff(F.col("last_end"), F.col("period_end")) < 1000) & (F.col("total_equity") > 0) & F.col("net_income").isNotNull()
    roe = (fy.withColumn("last_end", last).where(usable).groupBy("stock_id")
           .agg(half_up(F.avg(ratio("net_income", "total_equity")), 8).alias("roe3"), F.count(F.lit(1)).alias("roe_years")))
    m = metrics.select("stock_id", "close", "bps", "eps")
    return (fin.join(m, "stock_id").join(roe, "stock_id", "left")
            .select("stock_id", "country", "group_id",
                    half_up(F.when(F.col("bps") > 0, ratio("close", "bps")), 8).alias("pb"),
                    half_up(F.when(F.col("eps") > 0, ratio("close", "eps")), 8).alias("pe"),
                    "roe3", F.coalesce("roe_years", F.lit(0)).alias("roe_years")))


def financial_fit(profile: DataFrame, min_n: int = 8) -> DataFrame:
    """P/B against ROE inside country x theme: a least-squares line from `min_n` points on, else medians."""
    keys = ["country", "group_id"]
    pts = profile.where("roe3 IS NOT NULL AND pb IS NOT NULL")
    line = pts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("pb", "roe3").alias("slope"), F.regr_intercept("pb", "roe3").alias("intercept"),
        F.regr_sxx("pb", "roe3").alias("sxx"))
    line = line.withColumn("method", F.when((F.col("n") >= min_n) & (F.col("sxx") > 0), "regression").otherwise("median"))
    med = (medians(pts, keys, "roe3", "median_roe").drop("n").join(medians(pts, keys, "pb", "median_pb").drop("n"), keys))
    # countries x themes: a few dozen rows
    j = profile.join(F.broadcast(line.join(med, keys)), keys, "left")
    gap = F.when(F.col("method") == "regression", F.col("pb") - (F.col("intercept") + F.col("slope") * F.col("roe3"))).otherwise(
        F.col("pb") - F.col("median_pb"))
    gap = F.when(F.col("roe3").isNotNull() & F.col("pb").isNotNull() & (F.col("n") > 0), gap)
    reg = F.col("method") == "regression"
    place = (F.when(gap.isNull(), None).when(reg & (gap < 0), "below line").when(reg, "above line")
             .otherwise(F.concat(F.when(F.col("roe3") >= F.col("median_roe"), "ROE high, ").otherwise("ROE low, "),
                                 F.when(gap <= 0, "P/B low").otherwise("P/B high"))))
    return j.select("stock_id", *keys, "n", "method", half_up(F.when(reg, F.col("slope")), 4).alias("slope"),
                    half_up(F.when(reg, F.col("intercept")), 4).alias("intercept"),
                    half_up(F.when(~reg, F.col("median_roe")), 4).alias("median_roe"),
                    half_up(F.when(~reg, F.col("median_pb")), 4).alias("median_pb"),
                    half_up(gap, 4).alias("gap"), place.alias("position"))
