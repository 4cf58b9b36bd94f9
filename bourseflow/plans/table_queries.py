"""Table merging, streaming jobs run to their end, and joins and aggregates not shown by another query."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bourseflow.functions.exprs import half_up, ratio
from bourseflow.functions.ranking import medians
from bourseflow.operators.band_join import band_pairs
from bourseflow.plans import marts
from bourseflow.plans.catalog import query
from bourseflow.plans.ingest_queries import NOW, raw_bars
from bourseflow.plans.score_run import score_run, snapshots_of
from bourseflow.sources import files
from bourseflow.sources.market_tables import Tables, literal_rows
from bourseflow.streaming import jobs


# ------------------------------------------------------------------ merging
def bar_batches(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = t.prices.where("trade_date <= '2000-12-31'").select("stock_id", "trade_date", "close", "volume")
    new = t.prices.where("trade_date > '2000-06-30'").select("stock_id", "trade_date", (F.col("close") + 1).cast("decimal(18,4)").alias("close"), "volume")
    return old, new


@query("sink_upsert")
def sink_upsert(t: Tables) -> DataFrame:
    old, new = bar_batches(t)
    return files.upsert(old, new, ["stock_id", "trade_date"])


@query("sink_insert_new")
def sink_insert_new(t: Tables) -> DataFrame:
    """Conflicting rows are left as they are."""
    old, new = bar_batches(t)
    return files.upsert(old, new, ["stock_id", "trade_date"], update=False)


@query("sink_replace_keys")
def sink_replace_keys(t: Tables) -> DataFrame:
    """New annual batch for some stocks: years it does not have disappear, quarters stay."""
    cols = ["stock_id", "period_end", "period_type", "revenue"]
    old = t.statements.select(*cols).unionByName(t.quarters.select(*cols))
    asia = t.stocks.where("market = 'ASIA'").select("stock_id")
    new = t.statements.where("year(period_end) >= 1998").join(asia, "stock_id", "left_semi").select(*cols).withColumn("revenue", (F.col("revenue") + 1).cast("decimal(24,2)"))
    return files.replace_keys(old, new, "stock_id", ["stock_id", "period_end", "period_type"], ["FY"])


@query("sink_regenerate_partition")
def sink_regenerate_partition(t: Tables) -> DataFrame:
    """Scores written by date, then one date written again with other rows; the other dates stay."""
    path = jobs.workspace(t.spark)
    s = score_run(t).scores.select("stock_id", "preset", "snapshot", "score")
    again = F.lit(snapshots_of(t)[-2]).cast("date")
    files.write_partitions(s, path, "snapshot")
    files.write_partitions(s.where((F.col("snapshot") == again) & (F.col("score") >= 50)), path, "snapshot")
    return t.spark.read.parquet(path).select("stock_id", "preset", "snapshot", "score")


# ------------------------------------------------------------------ streams
LANDINGS = 4


def landing(df: DataFrame, at: str) -> Column:
    """Which of the landings brings a row: by time, in equal spans."""
    lo, hi = df.agg(F.min(at).cast("timestamp").cast("double"), F.max(at).cast("timestamp").cast("double")).first()
    span = ((hi or 0.0) - (lo or 0.0)) / LANDINGS + 1
    return F.least(F.lit(LANDINGS - 1), F.greatest(F.lit(0), F.floor((F.col(at).cast("timestamp").cast("double") - F.lit(lo or 0.0)) / span))).cast("int")


@query("st_log_quality")
def st_log_quality(t: Tables) -> DataFrame:
    """Log rows land in four spans of time; every seventh lands up to six hours later than its span."""
    w = jobs.workspace(t.spark)
    logs = t.logs.withColumn("lands_at", F.when(F.col("log_id") % 7 == 0, F.col("started_at") + F.expr("INTERVAL 6 HOURS")).otherwise(F.col("started_at")))
    jobs.finish(jobs.log_quality(jobs.land(logs, f"{w}/in", landing(logs, "lands_at"), LANDINGS), f"{w}/out", f"{w}/ckpt"))
    return t.spark.read.parquet(f"{w}/out").select("day", "job_type", "success", "failed", "skipped")


@query("st_feed_dedupe")
def st_feed_dedupe(t: Tables) -> DataFrame:
    """Every filing arrives twice, the copy a day later (so also in a later landing); each is kept once."""
    w = jobs.workspace(t.spark)
    feed = t.disclosures.withColumn("lands_at", F.col("filed_at"))
    feed = feed.unionByName(feed.withColumn("lands_at", F.col("filed_at") + F.expr("INTERVAL 1 DAY")))
    jobs.finish(jobs.feed_dedupe(jobs.land(feed, f"{w}/in", landing(feed, "lands_at"), LANDINGS), f"{w}/out", f"{w}/ckpt", cursor="00000000000005"))
    return t.spark.read.parquet(f"{w}/out").select("rcept_no", "stock_id", "title", "filed_at")


@query("st_fx_latest")
def st_fx_latest(t: Tables) -> DataFrame:
    """Quotes land in an order that has nothing to do with their time."""
    w = jobs.workspace(t.spark)
    fx = t.fx_snapshots
    jobs.finish(jobs.fx_latest(jobs.land(fx, f"{w}/in", F.pmod(F.xxhash64("rate_at"), F.lit(LANDINGS)).cast("int"), LANDINGS),
                               f"{w}/out", f"{w}/ckpt", "2024-01-31 00:00:00", 4))
    return t.spark.read.parquet(f"{w}/out").select("granularity", "rate_at", "usd_krw", "stale")


def landed_bars(df: DataFrame, path: str) -> DataFrame:
    """Bars in four spans of dates. Late ones: a twentieth of the days lands one span later, and half of the stocks' corrected rows
    (arrival 2) land before the row they correct."""
    at = landing(df, "trade_date")
    late = F.least(F.lit(LANDINGS - 1), at + 1)
    early = (F.col("arrival") == 2) & (F.col("stock_id") % 2 == 0)
    part = F.when(early, F.greatest(F.lit(0), at - 1)).when((F.col("arrival") == 2) | (F.dayofmonth("trade_date") == 6), late).otherwise(at)
    return jobs.land(df, path, part, LANDINGS)


@query("st_bars_upsert")
def st_bars_upsert(t: Tables) -> DataFrame:
    w = jobs.workspace(t.spark)
    jobs.finish(jobs.bars_upsert(landed_bars(raw_bars(t), f"{w}/in"), t.stocks, f"{w}/bars", f"{w}/bad", f"{w}/ckpt", NOW))
    return t.spark.read.parquet(f"{w}/bars").drop("month", "arrival")


@query("st_volume_surge")
def st_volume_surge(t: Tables) -> DataFrame:
    """Stored sessions up to a day, then new ones in several landings; the newest session of each stock."""
    w = jobs.workspace(t.spark)
    old = t.prices.where("trade_date <= '2001-09-30'").select("stock_id", "trade_date", "volume", F.lit(1).alias("arrival"))
    jobs.start_ring(old, f"{w}/ring", 16)
    new = t.prices.where("trade_date > '2001-09-30'").select("stock_id", "trade_date", "volume", F.lit(1).alias("arrival"))
    jobs.finish(jobs.volume_surge(landed_bars(new, f"{w}/in"), f"{w}/ring", f"{w}/out", f"{w}/ckpt", 16))
    found = t.spark.read.parquet(f"{w}/out")
    newest = found.groupBy("stock_id").agg(F.max("as_of").alias("as_of"))
    return found.join(newest, ["stock_id", "as_of"]).select("stock_id", "as_of", "volume", "value", "avg_volume_20d")


# ------------------------------------------------------------------ joins and aggregates
@query("j_left_null_row")
def j_left_null_row(t: Tables) -> DataFrame:
    """Stocks keep their row where the year has no bar."""
    bars = t.prices.where("trade_date = '2001-10-31'").select("stock_id", "close")
    return t.stocks.select("stock_id", "ticker").join(bars, "stock_id", "left")


@query("j_cross_small")
def j_cross_small(t: Tables) -> DataFrame:
    """Every sample stock with every preset (a parameter list exploded per row)."""
    presets = F.array(*[F.lit(p) for p in ("aggressive", "growth", "balanced", "value")])
    return t.stocks.where("coverage <> 'listed'").select("stock_id", F.explode(presets).alias("preset"))


@query("j_semi_exists")
def j_semi_exists(t: Tables) -> DataFrame:
    return t.stocks.join(t.reviewed(), "stock_id", "left_semi").select("stock_id", "ticker")


@query("j_flag_exists")
def j_flag_exists(t: Tables) -> DataFrame:
    hit = t.reviewed().select("stock_id").distinct().withColumn("w", F.lit(True))
    return t.stocks.join(hit, "stock_id", "left").select("stock_id", F.col("w").isNotNull().alias("is_watched"))


@query("j_anti_not_exists")
def j_anti_not_exists(t: Tables) -> DataFrame:
    return t.stocks.join(t.disclosures.where("filed_at >= '2001-07-01'"), "stock_id", "left_anti").select("stock_id")


@query("j_not_in_tuple")
def j_not_in_tuple(t: Tables) -> DataFrame:
    """Stored periods that a new batch does not have."""
    batch = t.quarters.where("operating_income >= 0").select("stock_id", "period_end", "period_type")
    return t.quarters.select("stock_id", "period_end", "period_type").join(batch, ["stock_id", "period_end", "period_type"], "left_anti")


@query("j_null_safe")
def j_null_safe(t: Tables) -> DataFrame:
    """Members per theme, stocks without a theme counted as one group of their own."""
    s = t.stocks.select("stock_id", "country", "group_id")
    n = s.groupBy("country", "group_id").agg(F.count(F.lit(1)).alias("same_theme")).select(F.col("country").alias("c"), F.col("group_id").alias("g"), "same_theme")
    return s.join(F.broadcast(n), (F.col("country") == F.col("c")) & F.col("group_id").eqNullSafe(F.col("g"))).select("stock_id", "group_id", "same_theme")


@query("j_fuzzy_period")
def j_fuzzy_period(t: Tables) -> DataFrame:
    """First quarter end within a week of each shifted annual period."""
    fy = t.statements.select("stock_id", F.date_sub("period_end", (F.col("stock_id") % 10).cast("int")).alias("p"))
    q = t.quarters.select("stock_id", F.col("period_end").alias("q"))
    return band_pairs(fy, q, ["stock_id"], "p", "q", 7).groupBy("stock_id", "p").agg(F.min("q").alias("q"))


@query("j_unnest_params")
def j_unnest_params(t: Tables) -> DataFrame:
    params = literal_rows(t.spark, ("preset", "metric", "w"), [("balanced", "volatility", 2), ("balanced", "liab_assets", 1)])
    v = score_run(t).values.select("stock_id", "snapshot", "metric", "z_adj")
    return v.join(F.broadcast(params), "metric").select("stock_id", "snapshot", "metric", "w", half_up(F.col("w") * F.col("z_adj"), 4).alias("weighted"))


@query("agg_median")
def agg_median(t: Tables) -> DataFrame:
    """Exact median unit price by return flag over every trade line."""
    from bourseflow.sources.market_tables import price4
    x = t.trades.select("flag", price4().alias("px"))
    return medians(x, ["flag"], "px")


@query("agg_weighted_mean")
def agg_weighted_mean(t: Tables) -> DataFrame:
    """Volume-weighted price by stock."""
    g = t.trades.groupBy("stock_id").agg(F.sum("cents").alias("c"), F.sum("qty").alias("q"))
    return g.select("stock_id", half_up(ratio("c", F.col("q") * 100), 4).alias("vwap"))


@query("agg_distinct")
def agg_distinct(t: Tables) -> DataFrame:
    j = t.prices.join(t.stocks.select("stock_id", "country"), "stock_id")
    return j.select("country", "trade_date").distinct()


@query("w_running_max")
def w_running_max(t: Tables) -> DataFrame:
    """Drawdown from the running peak on every bar."""
    w = Window.partitionBy("stock_id").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.prices.select("stock_id", "trade_date", half_up(ratio(F.col("close"), F.max("close").over(w)) - 1, 6).alias("drawdown"))


@query("w_tie_average_rank")
def w_tie_average_rank(t: Tables) -> DataFrame:
    """Mean rank of every event value inside its type (values repeat)."""
    from bourseflow.functions.ranking import with_average_rank
    e = t.raw("events").select("event_id", "event_type", "value")
    return with_average_rank(e, ["event_type"], "value").select("event_id", "event_type", F.col("rank").cast("double").alias("rank"), "n")


@query("w_percent_rank")
def w_percent_rank(t: Tables) -> DataFrame:
    from bourseflow.functions.ranking import positions
    o = t.raw("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    pos = positions(o, ["o_orderstatus"], "o_totalprice")
    pct = half_up(F.lit(100.0) * F.col("less") / (F.col("n") - 1), 1)
    return o.join(pos, ["o_orderstatus", "o_totalprice"]).select("o_orderkey", pct.alias("percentile"))


@query("queue_watch_rank")
def w_rank(t: Tables) -> DataFrame:
    """RANK of every portfolio by its cost, over all portfolios."""
    from bourseflow.functions.ranking import with_rank
    g = t.items.groupBy("portfolio_id").agg(F.sum("cost_krw").cast("decimal(24,2)").alias("cost_krw"))
    return with_rank(g, [], "cost_krw", total="total").select("portfolio_id", "cost_krw", "rank", "total")
