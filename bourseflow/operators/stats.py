"""Market statistics, lists, search and data-quality reports."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bourseflow import constants as K
from bourseflow.functions.exprs import dbl, half_up, positive, ratio
from bourseflow.functions.ordering import page
from bourseflow.operators.text_search import contains
from bourseflow.sources.stored import kept

RANKABLE = ("return_1m", "return_3m", "return_1y", "volume", "market_cap_krw")


def _avg(c: Column | str, scale: int, places: int) -> Column:
    v = (F.col(c) if isinstance(c, str) else c).cast(f"decimal(28,{scale})")
    return half_up(F.try_divide(F.sum(v).cast("double"), F.count(v).cast("double")), places)


def market_valuation(metrics: DataFrame, stocks: DataFrame, min_samples: int) -> DataFrame:
    s = stocks.where("is_active AND coverage = 'featured'").select("stock_id")
    per, pbr = positive("per"), positive("pbr")
    return (metrics.join(s, "stock_id").groupBy("market", "country", "currency").agg(
        F.count(F.lit(1)).alias("stocks"), F.count(per).alias("per_samples"), _avg(per, 4, 2).alias("avg_per"),
        half_up(F.min(per), 2).alias("min_per"), half_up(F.max(per), 2).alias("max_per"), _avg(pbr, 4, 2).alias("avg_pbr"),
        _avg("roe", 6, 4).alias("avg_roe"), F.sum(F.col("market_cap_krw").cast("decimal(28,0)")).cast("double").alias("total_market_cap_krw"))
        .where(F.col("stocks") >= min_samples))


def market_excluded(stocks: DataFrame, min_samples: int) -> DataFrame:
    return (stocks.where("is_active AND coverage = 'featured'").groupBy("market").agg(F.count(F.lit(1)).alias("stocks"))
            .where(F.col("stocks") < min_samples))


def group_valuation(metrics: DataFrame, members: DataFrame, stocks: DataFrame) -> DataFrame:
    s = stocks.where("coverage = 'featured'").select("stock_id")
    m = members.select("group_id", "stock_id").join(s, "stock_id").join(metrics, "stock_id")
    per, pbr = positive("per"), positive("pbr")
    low_high = lambda c, p: [half_up(F.min(c), p), half_up(F.max(c), p)]
    (min_per, max_per), (min_roe, max_roe), (min_r, max_r) = low_high(per, 2), low_high(F.col("roe"), 4), low_high(F.col("return_1y"), 4)
    return m.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("country") == "KR").alias("kr_members"),
        F.count_if(F.col("country") == "US").alias("us_members"), _avg(per, 4, 2).alias("avg_per"), min_per.alias("min_per"),
        max_per.alias("max_per"), _avg(pbr, 4, 2).alias("avg_pbr"), _avg("roe", 6, 4).alias("avg_roe"), min_roe.alias("min_roe"),
        max_roe.alias("max_roe"), _avg("operating_margin", 6, 4).alias("avg_operating_margin"), _avg("revenue_yoy", 6, 4).alias("avg_revenue_yoy"),
        _avg("return_1y", 6, 4).alias("avg_return_1y"), min_r.alias("min_return_1y"), max_r.alias("max_return_1y"),
        F.sum(F.col("market_cap_krw").cast("decimal(28,0)")).cast("double").alias("total_market_cap_krw"))


def disclosure_frequency(disclosures: DataFrame, period: str, now: str, days: int) -> DataFrame:
    """Filings per local week, month or quarter, with share of the total and running count (few periods remain after grouping)."""
    base = disclosures.where(F.col("filed_at") >= F.lit(now).cast("timestamp") - F.expr(f"make_dt_interval({days})"))
    start = F.date_trunc(period, F.from_utc_timestamp("filed_at", "Asia/Seoul")).cast("date")
    agg = base.groupBy(start.alias("period_start")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("data_source") == "DART").alias("dart"),
        F.count_if(F.col("data_source") == "SEC").alias("sec"), F.count_if(F.col("report_type").isin(*K.PERIODIC_REPORTS)).alias("periodic_reports"))
    every = Window.partitionBy(F.lit(0))
    run = every.orderBy("period_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return agg.select("*", half_up(ratio(F.col("total"), F.sum("total").over(every)), 4).alias("share"), F.sum("total").over(run).alias("cumulative"))


def job_quality(logs: DataFrame, stocks: DataFrame, since: str) -> DataFrame:
    """Per job: last success and failure with its reason, counts by outcome since a date, quarantined rows read from the notes.

    The last failure is a max over a small struct, so job types with most of the log combine on the map side."""
    l = logs
    recent = F.col("started_at") >= F.lit(since).cast("timestamp")
    refresh = F.col("source") == "REFRESH"
    is_ = lambda s: F.col("status") == s
    partial = refresh & is_("FAILED") & F.col("error").startswith("PARTIAL")
    quarantined = F.nullif(F.regexp_extract(F.coalesce("error", F.lit("")), K.QUARANTINE_NOTE, 1), F.lit("")).cast("int")
    fail = F.max(F.when(is_("FAILED"), F.struct("finished_at", "log_id", "error", "stock_id")))
    g = l.groupBy("job_type").agg(
        F.max(F.when(is_("SUCCESS"), F.col("finished_at"))).alias("last_success_at"),
        F.max(F.when(is_("SUCCESS") & refresh, F.col("finished_at"))).alias("last_refresh_success_at"), fail.alias("f"),
        F.count_if(recent & ~refresh & is_("SUCCESS")).alias("success"), F.count_if(recent & ~refresh & is_("FAILED")).alias("failed"),
        F.count_if(recent & F.coalesce(partial, F.lit(False))).alias("partial"), F.count_if(recent & is_("SKIPPED")).alias("skipped"),
        F.coalesce(F.sum(F.when(recent, quarantined)), F.lit(0)).alias("quarantined_rows"))
    names = stocks.select(F.col("stock_id").alias("sid"), F.col("ticker").alias("last_failure_target"))
    return g.join(names, F.col("f.stock_id") == F.col("sid"), "left").select(
        "job_type", "last_success_at", "last_refresh_success_at", F.col("f.finished_at").alias("last_failure_at"),
        F.left(F.split_part(F.col("f.error"), F.lit("\n"), F.lit(1)), F.lit(300)).alias("last_failure_reason"), "last_failure_target",
        "success", "failed", "partial", "skipped", "quarantined_rows")


def job_staleness(quality: DataFrame, now: str, ttl_hours: float, fast_ttl_hours: float, fast_jobs: Sequence[str]) -> DataFrame:
    """Stale when the last refresh success is older than twice the time to live; a totals row is added."""
    n = F.lit(now).cast("timestamp")
    limit = F.when(F.col("job_type").isin(*fast_jobs), F.lit(2 * fast_ttl_hours)).otherwise(F.lit(2 * ttl_hours))
    hours = (F.unix_micros(n) - F.unix_micros("last_refresh_success_at")) / F.lit(3.6e9)
    jobs = quality.select("job_type", "success", "failed", "partial", "skipped", "quarantined_rows",
                          F.coalesce(hours > limit, F.lit(True)).alias("stale"), half_up(hours, 1).alias("hours_since_success"))
    total = jobs.agg(*[F.sum(c).alias(c) for c in ("success", "failed", "partial", "skipped", "quarantined_rows")],
                     F.bool_or("stale").alias("stale")).select(F.lit("(total)").alias("job_type"), "*", F.lit(None).cast("double").alias("hours_since_success"))
    return jobs.unionByName(total)


def metric_ranking(metrics: DataFrame, stocks: DataFrame, chosen: Sequence[str], country: str | None, limit: int, descending: bool = True) -> DataFrame:
    """Top N by metric among active featured stocks. Volume units differ between markets, so it needs a country."""
    if "volume" in chosen and country is None:
        raise ValueError("volume can only be ranked inside one country")
    bad = set(chosen) - set(RANKABLE)
    if bad:
        raise ValueError(f"not rankable: {sorted(bad)}")
    s = stocks.where("is_active AND coverage = 'featured'").select("stock_id", "ticker")
    if country is not None:
        metrics = metrics.where(F.col("country") == country)
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in chosen])
    rows = metrics.join(s, "stock_id").select("stock_id", "ticker", "market", F.explode(cells).alias("c")).select(
        "stock_id", "ticker", "market", "c.metric", "c.value").where("value IS NOT NULL")
    totals = rows.groupBy("metric").agg(F.count(F.lit(1)).alias("total"))
    # only the head of the list is needed, so every task keeps its own head before the shuffle; all rows above a kept row are kept
    by = F.desc("value") if descending else F.asc("value")
    w = Window.partitionBy("metric").orderBy(by, "ticker")
    head = rows.withColumn("o", F.row_number().over(w)).where(F.col("o") <= limit).drop("o")
    ranked = head.withColumn("rank", F.rank().over(Window.partitionBy("metric").orderBy(by)).cast("long"))
    return ranked.join(F.broadcast(totals), "metric")


def stock_list(stocks: DataFrame, details: DataFrame, *, order: str = "market_cap_krw", descending: bool = True, limit: int = 20, offset: int = 0,
               country: str | None = None, sector: str | None = None, group: DataFrame | None = None, q: str | None = None) -> DataFrame:
    """Filtered, ranked page of stocks. Only the filters that are set become predicates. A page at any depth costs the same:
    value counts say which rows it holds (`ordering.page`)."""
    if order not in ("volume", "market_cap_krw"):
        raise ValueError(f"cannot order by {order}")
    rows = stocks.where("is_active")
    rows = rows.where(F.col("coverage").isin("featured", "benchmark")) if q is None else rows.where(
        contains(F.col("name"), F.lit(q)) | contains(F.col("ticker"), F.lit(q)) | contains(F.col("name_en"), F.lit(q)))
    for c, v in (("country", country), ("sector", sector)):
        if v is not None:
            rows = rows.where(F.col(c) == v)
    if group is not None:
        rows = rows.join(group.select("stock_id"), "stock_id", "left_semi")
    whole = kept(rows.join(details, "stock_id", "left"))
    return page(whole, order, "stock_id", offset, limit, descending=descending).orderBy("place").drop("place")


def range_report(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Rows and date range of each table, one aggregate per table."""
    parts = []
    for name, (df, day) in tables.items():
        low = F.min(day).cast("string") if day else F.lit(None).cast("string")
        high = F.max(day).cast("string") if day else F.lit(None).cast("string")
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"), low.alias("min_date"), high.alias("max_date"))
                     .select(F.lit(name).alias("name"), "rows", "min_date", "max_date"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def trend_label(metrics: DataFrame) -> DataFrame:
    """Long (1y, else 6m) and short (3m, else 1m) direction as one label, and the mean daily move."""
    long, short = F.coalesce("return_1y", "return_6m"), F.coalesce("return_3m", "return_1m")
    label = (F.when(long.isNull() | short.isNull(), K.INSUFFICIENT).when((long > 0) & (short >= 0), "rising")
             .when(long > 0, "resting").when(short > 0, "rebounding").otherwise("falling"))
    return metrics.select("stock_id", label.alias("trend"), half_up(F.col("volatility_1y") / F.sqrt(F.lit(252.0)), 6).alias("daily_move"))


def market_brief(indices: DataFrame, fx_change: Column, flat: float = 0.001) -> DataFrame:
    """Do the indices of a country move together, and where does the currency go."""
    sign = F.signum(dbl("change_rate"))
    g = indices.groupBy("country").agg(F.min(sign).alias("lo"), F.max(sign).alias("hi"), F.count_if(F.col("change_rate").isNull()).alias("blank"))
    word = (F.when(F.col("blank") > 0, None).when(F.col("lo") == 1, "up together").when(F.col("hi") == -1, "down together")
            .when((F.col("lo") == 0) & (F.col("hi") == 0), "flat").otherwise("mixed"))
    fx = F.when(fx_change.isNull(), None).when(F.abs(fx_change) < flat, "flat").when(fx_change < 0, "won stronger").otherwise("won weaker")
    return g.select("country", word.alias("indices"), fx.alias("fx"))
