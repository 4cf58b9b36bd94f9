"""Market state, statistics, lists, peers and portfolios."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bourseflow import constants as K
from bourseflow.functions.exprs import dbl, growth, half_up, ratio
from bourseflow.operators import market_state, peers, portfolio, prices, stats, text_search
from bourseflow.plans import marts
from bourseflow.plans.catalog import query
from bourseflow.plans.score_queries import score_ranks
from bourseflow.plans.score_run import months_before, score_run
from bourseflow.sources.market_tables import Tables, literal_rows
from bourseflow.sources.stored import stored

# months before the newest trade of the dates whose sector flow is shown
FLOW_MONTHS = (7, 4, 0)
FAST_JOBS = ("CLICK", "VIEW")
NOW = "2024-01-31 00:00:00"


def sample(t: Tables) -> DataFrame:
    return t.stocks.where("is_active AND coverage IN ('featured', 'benchmark') AND sector IS NOT NULL")


def flow_dates(t: Tables) -> list[str]:
    return [str(months_before(t.newest_day, m)) for m in FLOW_MONTHS]


def usd_krw(t: Tables) -> Column:
    return prices.fx_latest(t.fx).select("usd_krw").scalar()


def default_scores(t: Tables) -> DataFrame:
    return score_run(t).latest.where(F.col("preset") == K.DEFAULT_PRESET).select("stock_id", "score")


def vix(t: Tables) -> DataFrame:
    """A volatility series on the dates of the last index."""
    return t.index_prices.where("index_id = 4").select("trade_date", (
        F.lit(10.0) + F.round(F.col("close") * 10000).cast("long") % 3000 / F.lit(100.0)).alias("close"))


# ------------------------------------------------------------------ market state
@query("market_indices")
def market_indices(t: Tables) -> DataFrame:
    m = market_state.market_indices(t.indices, t.index_prices)
    return m.withColumn("sparkline", F.size("sparkline"))


@query("agg_array")
def sparklines(t: Tables) -> DataFrame:
    """The sparkline arrays unrolled: one row per index, date and close."""
    m = market_state.market_indices(t.indices, t.index_prices)
    return m.select("index_id", F.inline("sparkline"))


@query("fx_daily_recent")
def fx_daily_recent(t: Tables) -> DataFrame:
    return market_state.fx_daily_recent(t.fx)


@query("fx_card")
def fx_card(t: Tables) -> DataFrame:
    return market_state.fx_card(t.fx)


@query("fx_staleness")
def fx_staleness(t: Tables) -> DataFrame:
    return market_state.fx_staleness(t.fx, NOW, 4)


@query("commodity_info")
def commodity_info(t: Tables) -> DataFrame:
    """One-year change and range position of the commodity index linked to a stock's theme (a stock's own link comes first)."""
    m = market_state.market_indices(t.indices, t.index_prices)
    first = F.get(F.col("sparkline"), 0)["close"]
    m = m.select("code", "close", "position_52w", F.when(F.col("position_52w").isNotNull(), growth("close", first)).alias("change_1y"))
    linked = marts.with_family(t, t.stocks.select("stock_id")).where("commodity_linked")
    code = F.concat(F.lit("IX-"), F.when(F.col("stock_id") % 10 == 3, "ASIA").when(F.col("group_id") < 10, "AFRICA").otherwise("EUROPE"))
    return linked.select("stock_id", "group_id", code.alias("code")).join(F.broadcast(m), "code", "left")


@query("sector_flow")
def sector_flow(t: Tables) -> DataFrame:
    return market_state.sector_flow(t.prices, sample(t), flow_dates(t))


@query("sector_change")
def sector_change(t: Tables) -> DataFrame:
    return market_state.sector_change(market_state.sector_series(t.prices, sample(t)), str(t.newest_day))


@query("sector_board")
def sector_board(t: Tables) -> DataFrame:
    changes = market_state.sector_change(market_state.sector_series(t.prices, sample(t)), str(t.newest_day))
    board = t.groups.select("sector").distinct().withColumn("country", F.explode(F.array(F.lit("KR"), F.lit("US"))))
    return market_state.sector_board(changes, board)


@query("sentiment_components")
def sentiment_components(t: Tables) -> DataFrame:
    return market_state.mood_components(t.index_prices, vix(t), (2, 3, 4))


@query("sentiment_points")
def sentiment_points(t: Tables) -> DataFrame:
    return market_state.mood_points(market_state.mood_components(t.index_prices, vix(t), (2, 3, 4)))


def country_mood(t: Tables) -> DataFrame:
    """Newest stored mood of the leading index of each country (the first in display order)."""
    leading = t.indices.groupBy("country").agg(F.min_by("index_id", F.struct("display_order", "index_id")).alias("index_id"))     # one row per country
    mood = market_state.mood_components(t.index_prices, vix(t), (2, 3, 4)).join(F.broadcast(leading), "index_id")
    return mood.where("score IS NOT NULL").groupBy("country").agg(F.max("trade_date").alias("trade_date"), F.max_by("score", "trade_date").alias("score"))


@query("market_condition")
def market_condition(t: Tables) -> DataFrame:
    flow = market_state.sector_flow(t.prices, sample(t), flow_dates(t)[-1:])
    sessions = (t.index_prices.join(F.broadcast(t.indices.select("index_id", "country")), "index_id")
                .select("country", F.col("trade_date").alias("session_date")).distinct())
    return market_state.market_condition(t.stocks, country_mood(t), flow.select("country", "sector", "sector_r5", "n"), sessions, flow_dates(t)[-1])


@query("market_brief")
def market_brief(t: Tables) -> DataFrame:
    change = market_state.fx_card(t.fx).select("change_rate").scalar()
    return stats.market_brief(market_state.market_indices(t.indices, t.index_prices), change)


# ------------------------------------------------------------------ statistics
@query("stats_market_valuation")
def stats_market_valuation(t: Tables) -> DataFrame:
    return stats.market_valuation(marts.metrics_table(t), t.stocks, 3)


@query("stats_market_excluded")
def stats_market_excluded(t: Tables) -> DataFrame:
    return stats.market_excluded(t.stocks, 8)


@query("stats_peer_group_valuation")
def stats_peer_group_valuation(t: Tables) -> DataFrame:
    return stats.group_valuation(marts.metrics_table(t), t.members, t.stocks)


@query("stats_disclosure_frequency")
def stats_disclosure_frequency(t: Tables) -> DataFrame:
    return stats.disclosure_frequency(t.disclosures, "month", "2001-08-01 00:00:00", 3650)


@query("stats_data_quality")
def stats_data_quality(t: Tables) -> DataFrame:
    return stats.job_quality(t.logs, t.stocks, "2024-01-10 00:00:00")


@query("data_quality_stale")
def data_quality_stale(t: Tables) -> DataFrame:
    return stats.job_staleness(stats.job_quality(t.logs, t.stocks, "2024-01-10 00:00:00"), NOW, 0.5, 0.25, FAST_JOBS)


@query("stats_overview")
def stats_overview(t: Tables) -> DataFrame:
    daily = t.fx.where("granularity = 'DAILY'")
    return stats.range_report({
        "stocks": (t.stocks, None), "peer_groups": (t.groups, None), "daily_prices": (t.prices, "trade_date"),
        "index_daily_prices": (t.index_prices, "trade_date"), "fx_daily": (daily, "rate_at"),
        "fx_snapshots": (t.fx.where("granularity = 'SNAPSHOT'"), "rate_at"), "valuation_snapshots": (t.valuations, "as_of"),
        "financial_fy": (t.statements.where("period_type = 'FY'"), "period_end"), "disclosures": (t.disclosures, "filed_at"),
        "refresh_success": (t.logs.where("status = 'SUCCESS'"), "finished_at"), "failed_jobs": (t.logs.where("status = 'FAILED'"), None)})


@query("status_report")
def status_report(t: Tables) -> DataFrame:
    """Bars and annual statements per stock: least, mean, most."""
    def per_stock(name: str, df: DataFrame) -> DataFrame:
        c = df.groupBy("stock_id").agg(F.count(F.lit(1)).alias("c"))
        return c.agg(F.lit(name).alias("name"), F.min("c").alias("least"), half_up(ratio(F.sum("c"), F.count("c")), 0).alias("mean"), F.max("c").alias("most"))
    return per_stock("bars", t.prices).unionByName(per_stock("fy", t.statements))


@query("stats_ranking")
def stats_ranking(t: Tables) -> DataFrame:
    return stats.metric_ranking(marts.metrics_table(t), t.stocks, ("return_1m", "return_1y", "volume", "market_cap_krw"), "US", 10)


@query("w_rank_dynamic_dir")
def ranking_ascending(t: Tables) -> DataFrame:
    return stats.metric_ranking(marts.metrics_table(t), t.stocks, ("return_3m",), None, 10, descending=False)


# ------------------------------------------------------------------ lists
def list_details(t: Tables) -> DataFrame:
    """Price, valuation and score columns per stock."""
    marts.keep_facts(t)
    m = prices.latest_price(t.prices, t.stocks).select("stock_id", "currency", F.col("trade_date").alias("as_of"), "close", "change_rate", "volume")
    from bourseflow.operators.fundamentals import latest_valuation
    v = latest_valuation(t.valuations).select("stock_id", "market_cap", "per", "pbr", "shares_outstanding")
    j = m.join(v, "stock_id", "left").join(default_scores(t), "stock_id", "left").withColumn("fx", dbl(usd_krw(t)))
    usd = F.col("currency") == "USD"
    return (j.withColumn("market_cap_krw", half_up(F.col("market_cap") * F.when(usd, F.col("fx")).otherwise(F.lit(1.0)), 0))
            .withColumn("close_krw", F.when(usd, half_up(dbl("close") * F.col("fx"), 0)).otherwise(dbl("close"))).drop("fx", "currency"))


@query("stock_list")
def stock_list(t: Tables) -> DataFrame:
    page = stats.stock_list(t.stocks, list_details(t), limit=20, offset=10)
    return page.select("rank", "total", "stock_id", "ticker", "name", "market", "sector", "as_of", "close", "change_rate", "volume", "market_cap_krw", "score")


@query("stock_list_filtered")
def stock_list_filtered(t: Tables) -> DataFrame:
    """Country, theme and text filters together, ordered by volume."""
    theme = t.members.join(F.broadcast(t.groups.where("commodity_linked").select("group_id")), "group_id")
    page = stats.stock_list(t.stocks, list_details(t), order="volume", descending=False, limit=50, country="US", group=theme, q="00")
    return page.select("rank", "total", "stock_id", "ticker", "coverage", "volume")


@query("stock_search")
def stock_search(t: Tables) -> DataFrame:
    """Fixed texts, and pieces of every stock's ticker and name: more queries than stocks."""
    fixed = literal_rows(t.spark, ("q",), [(q,) for q in ("000012", "00007", "supplier", "5", "a_b", "%")])
    own = t.stocks.select(F.explode(F.array(F.substring("ticker", 3, 3), F.upper(F.substring("ticker", 2, 5)), F.lower(F.substring("name", 4, 12)))).alias("q"))
    return text_search.search(t.stocks, fixed.unionByName(own).distinct(), 10)


@query("stock_detail")
def stock_detail(t: Tables) -> DataFrame:
    """One row per stock with its themes (primary first)."""
    g = t.members.join(F.broadcast(t.groups.select("group_id", "theme")), "group_id")
    themes = g.groupBy("stock_id").agg(F.array_sort(F.collect_list(F.struct((~F.col("is_primary")).alias("o"), "theme", "group_id"))).alias("g"))
    watched = t.watchlist.select("stock_id").distinct().withColumn("is_watched", F.lit(True))
    j = t.stocks.join(list_details(t), "stock_id", "left").join(themes, "stock_id", "left").join(watched, "stock_id", "left")
    return j.select("stock_id", "ticker", "name", "market", "currency", "as_of", "close", "close_krw", "per", "pbr", "market_cap_krw", "shares_outstanding", "score",
                    F.array_join(F.transform("g", lambda x: x["theme"]), ",").alias("groups"), F.coalesce("is_watched", F.lit(False)).alias("is_watched"))


@query("watchlist_cards")
def watchlist_cards(t: Tables) -> DataFrame:
    marts.keep_facts(t)
    lp = prices.latest_price(t.prices, t.stocks).select("stock_id", "close", "change_rate")
    j = t.watchlist.join(lp, "stock_id", "left").join(default_scores(t), "stock_id", "left")
    return j.select("user_id", "stock_id", "sort_order", "added_at", "close", "change_rate", "score", "target_price",
                    half_up(ratio(dbl("target_price") - dbl("close"), "close"), 6).alias("target_gap"))


@query("disclosures")
def disclosures(t: Tables) -> DataFrame:
    """The newest five filings of each stock (cut inside each task before the shuffle)."""
    w = Window.partitionBy("stock_id").orderBy(F.desc("filed_at"), F.desc("rcept_no"))
    return t.disclosures.withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")


@query("stock_groups")
def stock_groups(t: Tables) -> DataFrame:
    """Themes of each stock with their number of featured stocks."""
    featured = t.members.join(t.stocks.where("coverage = 'featured'").select("stock_id"), "stock_id", "left_semi")
    size = featured.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    return t.members.join(F.broadcast(t.groups.select("group_id", "theme").join(size, "group_id", "left")), "group_id").select(
        "stock_id", "group_id", "theme", "is_primary", F.coalesce("size", F.lit(0)).alias("size"))


@query("peer_groups_list")
def peer_groups_list(t: Tables) -> DataFrame:
    live = t.stocks.where("is_active AND coverage IN ('featured', 'benchmark')").select("stock_id")
    size = t.members.join(live, "stock_id", "left_semi").groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    return t.groups.join(size, "group_id", "left").select("group_id", "theme", "sector", F.coalesce("size", F.lit(0)).alias("size"))


# ------------------------------------------------------------------ peers
def peer_members(t: Tables) -> DataFrame:
    cov = t.stocks.select("stock_id", (F.col("coverage") == "featured").alias("featured"))
    return t.members.select("group_id", "stock_id").join(cov, "stock_id")


@query("peers")
def peers_query(t: Tables) -> DataFrame:
    m = marts.metrics_table(t).join(default_scores(t), "stock_id", "left")
    rows = stored(t.spark, f"peer values|{t.folder}", lambda: peers.peer_values(peer_members(t), m))
    return peers.peers(rows)


@query("peers_chart")
def peers_chart(t: Tables) -> DataFrame:
    return peers.rebased(t.prices, peer_members(t).where("featured"), 3)


@query("peers_chart_grid")
def peers_chart_grid(t: Tables) -> DataFrame:
    return peers.rebased_grid(peers.rebased(t.prices, peer_members(t).where("featured"), 1))


@query("peer_premium")
def peer_premium(t: Tables) -> DataFrame:
    return peers.premium(peer_members(t).where("featured"), marts.metrics_table(t))


def _profile(t: Tables) -> DataFrame:
    marts.keep_facts(t)
    themed = marts.with_family(t, t.stocks.where("is_active AND coverage <> 'listed'").select("stock_id", "country"))
    return stored(t.spark, f"financial profile|{t.folder}", lambda: peers.financial_profile(marts.metrics_table(t), t.statements, themed))


@query("financial_profile")
def financial_profile(t: Tables) -> DataFrame:
    return _profile(t)


@query("financial_fit")
def financial_fit(t: Tables) -> DataFrame:
    return peers.financial_fit(_profile(t), min_n=3)


@query("trend_label")
def trend_label(t: Tables) -> DataFrame:
    return stats.trend_label(prices.price_metrics(t.prices))


@query("score_band")
def score_band(t: Tables) -> DataFrame:
    """Five 20-point bands and the top percent (at least 1)."""
    latest = score_run(t).latest.where("score IS NOT NULL")
    r = score_ranks(latest)
    top = F.greatest(F.lit(1), F.ceil(F.lit(100.0) * F.col("rank_position") / F.col("rank_total"))).cast("int")
    return latest.select("stock_id", "preset", "score").join(r, ["stock_id", "preset"]).select(
        "stock_id", "preset", "score", market_state.band(F.col("score")).alias("band"), top.alias("top_percent"))


# ------------------------------------------------------------------ portfolios
def valued(t: Tables) -> DataFrame:
    lp = prices.latest_price(t.prices, t.stocks).select("stock_id", "currency", "close", "trade_date")
    return portfolio.value_items(t.items, lp, usd_krw(t))


@query("portfolio_value")
def portfolio_value(t: Tables) -> DataFrame:
    return valued(t)


@query("portfolio_summary")
def portfolio_summary(t: Tables) -> DataFrame:
    marts.keep_facts(t)
    return portfolio.summary(valued(t), t.portfolios, default_scores(t))


@query("portfolio_weights")
def portfolio_weights(t: Tables) -> DataFrame:
    return portfolio.weights(t.items, t.stocks, t.members, t.groups)


@query("portfolio_slices")
def portfolio_slices(t: Tables) -> DataFrame:
    return portfolio.slices(valued(t), t.portfolios, 5)


def unit_costs(t: Tables) -> DataFrame:
    lp = prices.latest_price(t.prices, t.stocks).select("stock_id", "currency", "close")
    fx = F.when(F.col("currency") == "USD", usd_krw(t)).otherwise(F.lit(1)).cast("decimal(8,4)")
    return lp.select("stock_id", (F.col("close").cast("decimal(14,4)") * fx).alias("unit_cost"))


@query("position_size")
def position_size(t: Tables) -> DataFrame:
    """Every watchlist entry as an order: by quantity, by amount or by weight of the seed."""
    s = F.col("stock_id") % 3
    mode = F.when(s == 0, "quantity").when(s == 1, "amount").otherwise("weight")
    value = F.when(s == 0, F.col("stock_id") % 10).when(s == 1, F.lit(30000000)).otherwise(F.lit(5)).cast("double")
    orders = t.watchlist.select(F.col("user_id").alias("portfolio_id"), "stock_id", mode.alias("mode"), value.alias("value")).join(unit_costs(t), "stock_id")
    used = t.items.groupBy("portfolio_id").agg(F.sum("cost_krw").alias("used_krw"))
    return portfolio.position_size(orders, t.portfolios, used)


def _equal(t: Tables) -> tuple[DataFrame, DataFrame]:
    targets = t.watchlist.select(F.col("user_id").alias("portfolio_id"), "stock_id")
    held = t.items.where("quantity >= 30").select("portfolio_id", "stock_id")
    budgets = t.portfolios.select("portfolio_id", F.lit(50000000).cast("decimal(24,2)").alias("budget_krw"))
    lp = prices.latest_price(t.prices, t.stocks).select("stock_id", "currency", "close")
    return portfolio.equal_weight(targets, held, lp, usd_krw(t), budgets), budgets


@query("equal_weight_preview")
def equal_weight_preview(t: Tables) -> DataFrame:
    return _equal(t)[0]


@query("equal_weight_leftover")
def equal_weight_leftover(t: Tables) -> DataFrame:
    return portfolio.leftover(*_equal(t))
