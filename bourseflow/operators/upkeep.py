"""Due dates, refresh state, budgets, calendars, selection of the comparison sample and rankings by size."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bourseflow import constants as K
from bourseflow.functions.exprs import half_up, ratio
from bourseflow.sources.stored import stored


# ------------------------------------------------------------------ freshness
def valid_until(latest: DataFrame, fetched_at: Column) -> DataFrame:
    """Next time to fetch statements: the expected annual report, at most 90 days (spread by stock), a week when overdue.

    `latest`: stock_id and fy_end (NULL when there is none)."""
    day = lambda n: F.expr(f"make_dt_interval({n})")
    due = F.to_utc_timestamp(F.date_add(F.add_months("fy_end", 12), 90).cast("timestamp"), "Asia/Seoul") + day(7)
    spread = F.make_dt_interval((F.lit(90) - F.col("stock_id") % 7).cast("int"))
    until = (F.when(F.col("fy_end").isNull() | (due <= fetched_at), fetched_at + day(7))
             .otherwise(F.least(fetched_at + spread, due)))
    return latest.select("stock_id", "fy_end", until.alias("valid_until"))


def expire_on_report(freshness: DataFrame, filings: DataFrame, now: str) -> DataFrame:
    """Statements end at once when an annual report was filed after they were fetched."""
    annual = filings.where(F.col("title").contains(K.ANNUAL_REPORT_WORD) | F.col("report_type").isin(*K.ANNUAL_FORMS))
    newest = annual.groupBy("stock_id").agg(F.max("filed_at").alias("newest"))
    j = freshness.join(newest, "stock_id", "left")
    hit = (F.col("valid_until") > F.lit(now).cast("timestamp")) & (F.col("newest") > F.col("fetched_at"))
    return j.select("stock_id", "fetched_at", F.when(hit, F.col("fetched_at")).otherwise(F.col("valid_until")).alias("valid_until"),
                    F.coalesce(hit, F.lit(False)).alias("expired"))


def due_queue(stocks: DataFrame, freshness: DataFrame, now: str, limit: int) -> DataFrame:
    """Due stocks: never fetched first, then the longest overdue, cut at the daily budget."""
    j = stocks.select("stock_id").join(freshness.select("stock_id", "valid_until"), "stock_id", "left")
    return (j.where(F.col("valid_until").isNull() | (F.col("valid_until") <= F.lit(now).cast("timestamp")))
            .orderBy(F.asc_nulls_first("valid_until"), "stock_id").limit(limit))


def refresh_due(logs: DataFrame, now: str, ttl_hours: float, retry_hours: float) -> DataFrame:
    """Per job: when it may run again. A failure counts only when no success came at or after it."""
    n = F.lit(now).cast("timestamp")
    span = lambda h: F.expr(f"make_dt_interval(0, 0, 0, {h * 3600})")
    r = logs.where("source = 'REFRESH'").groupBy("job_type").agg(
        F.max(F.when(F.col("status") == "SUCCESS", F.col("finished_at"))).alias("last_ok"),
        F.max(F.when(F.col("status") == "FAILED", F.col("finished_at"))).alias("last_bad"))
    r = r.withColumn("last_bad", F.when(F.col("last_ok").isNull() | (F.col("last_bad") > F.col("last_ok")), F.col("last_bad")))
    due = (F.when(F.col("last_ok") > n - span(ttl_hours), F.col("last_ok") + span(ttl_hours))
           .when(F.col("last_bad") > n - span(retry_hours), F.col("last_bad") + span(retry_hours)).otherwise(n))
    return r.withColumn("due_at", due)


def retry_targets(logs: DataFrame, keys: Sequence[str], now: str, ttl_hours: float) -> DataFrame:
    """Targets that failed inside the last failed refresh run of a job, while that run is within the time to live."""
    n = F.lit(now).cast("timestamp")
    run = logs.where("source = 'REFRESH' AND status = 'FAILED'").groupBy("job_type").agg(
        F.max(F.struct("finished_at", "started_at")).alias("r"))
    run = run.select("job_type", F.col("r.started_at").alias("run_start"), F.col("r.finished_at").alias("run_end"))
    run = run.where(F.col("run_end") > n - F.expr(f"make_dt_interval(0, 0, 0, {ttl_hours * 3600})"))
    bad = logs.where("source <> 'REFRESH' AND status = 'FAILED'")
    # one row per job type
    j = bad.join(F.broadcast(run), "job_type").where("started_at >= run_start AND finished_at <= run_end")
    return j.select(*keys).distinct()


def run_status(logs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SUCCESS, PARTIAL or FAILED per run from the outcome of its targets."""
    g = logs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "SUCCESS").alias("ok"),
                                F.count_if(F.col("status") == "FAILED").alias("bad"))
    return g.withColumn("run", F.when(F.col("ok") == F.col("n"), "SUCCESS").when(F.col("bad") == F.col("n"), "FAILED").otherwise("PARTIAL"))


def valuation_stale(stocks: DataFrame, valuations: DataFrame, bars: DataFrame, now: str) -> DataFrame:
    """Stale unless a valuation exists for the last closed day or the last bar, whichever is earlier."""
    from bourseflow.operators.incremental import last_closed_day
    v = valuations.groupBy("stock_id").agg(F.max("as_of").alias("v"))
    b = bars.groupBy("stock_id").agg(F.max("trade_date").alias("b"))
    closed = last_closed_day(F.col("country"), F.lit(now).cast("timestamp"))
    j = stocks.select("stock_id", "country").join(v, "stock_id", "left").join(b, "stock_id", "left")
    return j.select("stock_id", F.coalesce(F.col("v") < F.least(closed, F.col("b")), F.lit(True)).alias("stale"))


def session_status(as_of: DataFrame, calendar: DataFrame, zones: DataFrame, now: str) -> DataFrame:
    """today / holiday / previous_session per country. `as_of`: country, as_of; `calendar`: country, session_date."""
    today = F.from_utc_timestamp(F.lit(now).cast("timestamp"), F.col("timezone")).cast("date")
    j = as_of.join(F.broadcast(zones), "country").withColumn("today", today)
    opened = calendar.join(F.broadcast(j.select("country", "today")), "country").where("session_date = today").select("country").distinct().withColumn("open", F.lit(True))
    j = j.join(opened, "country", "left")
    s = F.when(F.col("as_of") >= F.col("today"), "today").when(F.col("open"), "previous_session").otherwise("holiday")
    return j.select("country", "as_of", "today", s.alias("status"))


def sessions_between(pairs: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sessions after `start` up to and including `end`, by position in the calendar (two equi-joins, no range join).

    NULL where either day lies outside the country's calendar, which says nothing about sessions there."""
    span = calendar.groupBy("country").agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
    days = span.select("country", F.explode(F.sequence("a", "b")).alias("day"))
    w = Window.partitionBy("country").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pos = (days.join(calendar.select("country", F.col("session_date").alias("day"), F.lit(1).alias("s")), ["country", "day"], "left")
           .select("country", "day", F.sum(F.coalesce("s", F.lit(0))).over(w).alias("pos")))
    at = lambda c: F.broadcast(pos.select("country", F.col("day").alias(c), F.col("pos").alias(f"{c}_pos")))
    j = pairs.join(at("start"), ["country", "start"], "left").join(at("end"), ["country", "end"], "left")
    inside = F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull()
    n = F.when(inside & (F.col("start") >= F.col("end")), F.lit(0).cast("long")).when(inside, F.col("end_pos") - F.col("start_pos"))
    return j.select(*pairs.columns, n.alias("sessions"))


def budget_left(logs: DataFrame, now: str, jobs: Sequence[str], budget: int) -> DataFrame:
    """Provider calls since midnight in Seoul, per source, and what is left of the daily budget."""
    local = F.from_utc_timestamp(F.lit(now).cast("timestamp"), "Asia/Seoul")
    midnight = F.to_utc_timestamp(F.date_trunc("day", local), "Asia/Seoul")
    hit = F.col("job_type").isin(*jobs) & (F.col("started_at") >= midnight) & (F.col("started_at") < F.lit(now).cast("timestamp"))
    return logs.groupBy("source").agg(F.count_if(hit).alias("used")).withColumn("remaining", F.greatest(F.lit(0), F.lit(budget) - F.col("used")))


# ------------------------------------------------------------------ themes
def theme_assign(stocks: DataFrame, overrides: DataFrame, ksic: DataFrame, sic: DataFrame) -> DataFrame:
    """Primary theme: direct ticker, else longest KSIC prefix (KR) or narrowest SIC range (US); ties take the greater theme name.

    Prefixes become equi-join keys; SIC ranges are spread over their codes (four digits), so nothing is compared pairwise.
    `ksic`: prefix, theme; `sic`: low, high, theme; `overrides`: ticker, theme."""
    codes = stocks.select("stock_id", "country", "ticker", "ksic", "sic")
    best = lambda name: F.max(F.struct("w", "theme"))["theme"].alias(name)
    ends = F.sequence(F.lit(1), F.length("ksic"))
    k = (codes.where("country = 'KR' AND ksic IS NOT NULL").select("stock_id", F.explode(ends).alias("w"), "ksic")
         .withColumn("prefix", F.substring("ksic", F.lit(1), F.col("w"))).join(F.broadcast(ksic), "prefix").groupBy("stock_id").agg(best("by_ksic")))
    per_code = (sic.select(F.explode(F.sequence("low", "high")).alias("sic"), (F.col("low") - F.col("high")).alias("w"), "theme")
                .groupBy("sic").agg(best("by_sic")))
    j = (codes.join(F.broadcast(overrides.select("ticker", F.col("theme").alias("direct"))), "ticker", "left")
         .join(k, "stock_id", "left").join(F.broadcast(per_code), "sic", "left"))
    theme = F.coalesce("direct", F.when(F.col("country") == "KR", F.col("by_ksic")).when(F.col("country") == "US", F.col("by_sic")))
    return j.select("stock_id", theme.alias("theme")).where("theme IS NOT NULL")


def theme_members(primary: DataFrame, secondary: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of all themes: the primary theme of each stock and its listed secondary ones but that theme; `sector` is the primary's.

    `primary`: stock_id, theme; `secondary`: stock_id, theme; `groups`: theme, sector. A stock without primary theme has no row."""
    p = primary.join(groups.select("theme", "sector"), "theme").select("stock_id", "theme", F.lit(True).alias("is_primary"), "sector")
    own = p.select("stock_id", F.col("theme").alias("own"), "sector")
    more = (secondary.select("stock_id", "theme").distinct().join(own, "stock_id").where("theme <> own")
            .select("stock_id", "theme", F.lit(False).alias("is_primary"), "sector"))
    return p.unionByName(more)


def benchmark_select(pool: DataFrame, per_sector: int) -> DataFrame:
    """Fill each (theme, country) up to `per_sector` with the largest stocks, one per company, in theme order.

    `pool`: stock_id, country, theme, company, coverage, size (order key, larger first; NULL = not eligible).
    Share classes normally share a theme, where a window settles the company. A company met in two themes is banned in the
    later one and the pick repeated; a ban only moves others up, so earlier themes stay final. Bans are a stored table, and the number
    of rounds is at most that of the themes."""
    featured = pool.where("coverage = 'featured'")
    taken = featured.where("company IS NOT NULL").select("country", "company").distinct()
    quota = featured.groupBy("country", "theme").agg(F.count(F.lit(1)).alias("have"))
    cand = (pool.where("coverage <> 'featured' AND size IS NOT NULL AND company IS NOT NULL")
            .join(taken, ["country", "company"], "left_anti")
            .join(F.broadcast(quota), ["country", "theme"], "left").withColumn("quota", F.greatest(F.lit(0), F.lit(per_sector) - F.coalesce("have", F.lit(0)))))
    order = [F.desc("size"), F.asc("stock_id")]
    one = Window.partitionBy("country", "theme", "company").orderBy(*order)
    cand = cand.withColumn("c", F.row_number().over(one)).where("c = 1").drop("c")
    # only companies present in more than one theme can clash
    split = cand.groupBy("country", "company").agg(F.countDistinct("theme").alias("k")).where("k > 1").drop("k")
    place = Window.partitionBy("country", "theme").orderBy(*order)
    spark, key = pool.sparkSession, uuid.uuid4().hex
    banned = stored(spark, f"bans {key} 0", lambda: cand.limit(0).select("country", "theme", "company"))

    def pick() -> DataFrame:
        c = cand.join(banned, ["country", "theme", "company"], "left_anti")
        return c.withColumn("place", F.row_number().over(place)).where(F.col("place") <= F.col("quota"))

    first = Window.partitionBy("country", "company").orderBy("theme")
    # a round settles at least one more theme of each country, in theme order
    for k in range(1, cand.select("theme").distinct().count() + 2):
        clash = pick().join(split, ["country", "company"], "left_semi")
        later = clash.withColumn("f", F.row_number().over(first)).where("f > 1").select("country", "theme", "company")
        more = stored(spark, f"bans {key} {k}", lambda: banned.unionByName(later))
        if more.count() == banned.count():
            break
        banned = more
    else:
        raise RuntimeError("the selection did not settle")
    return pick().select("stock_id", "country", "theme", "company", "place")


def halted(bars: DataFrame, sample: DataFrame, everyone: DataFrame, today: str) -> DataFrame:
    """Stocks whose last bar is before the country's 21st most recent session (within 120 days)."""
    dates = (bars.where(F.col("trade_date") >= F.date_sub(F.lit(today).cast("date"), 120)).select("stock_id", "trade_date")
             .join(sample.select("stock_id", "country"), "stock_id").select("country", "trade_date").distinct())
    w = Window.partitionBy("country").orderBy(F.desc("trade_date"))
    cut = dates.withColumn("rk", F.row_number().over(w)).where("rk = 21").select("country", F.col("trade_date").alias("cut"))
    last = bars.groupBy("stock_id").agg(F.max("trade_date").alias("last"))
    return everyone.select("stock_id", "country").join(last, "stock_id").join(F.broadcast(cut), "country").where("last < cut").select("stock_id")


# ------------------------------------------------------------------ size rankings
def cap_ranking(rows: DataFrame, pool: int, tolerance: float = 1.2, inflated: float = 200.0) -> DataFrame:
    """Rank by market value: filed shares x close, replaced by the quoted value where there is one; ADR ratio when they differ.

    `rows`: stock_id, close, shares (NULL: not filed), quoted (NULL: none), assets, value_traded (NULL: price from the store),
    files_reports. Ranked lists are cut at `pool`, which is the size of the list the report asks for."""
    c = F.col
    r = rows.where("close IS NOT NULL").withColumn("filed", c("shares").cast("double") * c("close").cast("double"))
    top = lambda df, n, *order: df.orderBy(*order).limit(n).select("stock_id")
    by_cap = top(r.where("filed IS NOT NULL"), pool + pool // 3, F.desc("filed"), F.asc("stock_id"))
    no_share = r.where("shares IS NULL")
    by_value = top(no_share.where("value_traded IS NOT NULL"), pool // 3, F.desc("value_traded"), F.asc("stock_id"))
    cand = by_cap.unionByName(no_share.where("value_traded IS NULL").select("stock_id")).unionByName(by_value).withColumn("cand", F.lit(True))
    j = r.join(cand, "stock_id", "left")
    quoted = F.when(c("cand"), c("quoted").cast("double"))
    rel = ratio(c("filed"), quoted)
    off = (rel < 1 / tolerance) | (rel > tolerance)
    cap = F.when(quoted.isNotNull(), quoted).when(c("cand") & (c("filed") > F.lit(inflated) * c("assets").cast("double")), None).otherwise(c("filed"))
    j = j.select("stock_id", cap.alias("cap"), F.when(off, half_up(rel, 6)).alias("share_ratio"),
                 (c("shares").isNotNull() | c("files_reports")).alias("ok"))
    ranked = j.where("cap IS NOT NULL AND ok").orderBy(F.desc("cap"), "stock_id").limit(pool)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("cap"), "stock_id")              # at most `pool` rows
    ranked = ranked.select("stock_id", F.row_number().over(w).alias("cap_rank"), half_up("cap", 0).alias("cap_usd"))
    return j.select("stock_id", "share_ratio").join(ranked, "stock_id", "left").where("cap_rank IS NOT NULL OR share_ratio IS NOT NULL")


def work_queue(stocks: DataFrame, freshness: DataFrame, ranking: DataFrame, limit: int) -> DataFrame:
    """Listed stocks never fetched, by traded value then market value. `ranking`: stock_id, first, second."""
    todo = stocks.where("is_active AND coverage = 'listed' AND company IS NOT NULL").select("stock_id").join(freshness.select("stock_id"), "stock_id", "left_anti")
    j = todo.join(ranking, "stock_id", "left").na.fill(0.0, ["first", "second"])
    return j.orderBy(F.desc("first"), F.desc("second"), "stock_id").limit(limit)


def industry_due(stocks: DataFrame, checked: DataFrame, today: str, days: int, per_country: int) -> DataFrame:
    """Stocks whose industry code has to be checked again: featured, benchmark, then by size; a fixed number per country."""
    j = stocks.where("is_active AND company IS NOT NULL").join(checked, "stock_id", "left")
    old = F.col("checked_at").isNull() | (F.col("checked_at") < F.date_sub(F.lit(today).cast("date"), days))
    need = old & ((F.col("country") == "KR") | F.col("coverage").isin("featured", "benchmark") | F.col("cap_rank").isNotNull())
    w = Window.partitionBy("country").orderBy((F.col("coverage") == "featured").desc(), (F.col("coverage") == "benchmark").desc(),
                                              F.asc_nulls_last("cap_rank"), "stock_id")
    return j.where(need).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_country).select("country", "place", "stock_id")


def map_ids(stocks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Fill missing company ids from a mapping file; `mapped` false marks the ones left open."""
    j = stocks.select("stock_id", "ticker", "company").join(mapping.select("ticker", F.col("company").alias("found")), "ticker", "left")
    return j.select("stock_id", "ticker", F.coalesce("company", "found").alias("company"), (F.col("company").isNotNull() | F.col("found").isNotNull()).alias("mapped"))
