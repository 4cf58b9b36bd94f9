"""SQL for table merging, streams and single joins and aggregates."""
from __future__ import annotations

from oracle.ctes import CTES, compose, r
from oracle import filings as _filings  # noqa: F401

SQL: dict[str, str] = {}
SQL["sink_upsert"] = compose(f"SELECT stock_id, CAST(trade_date AS VARCHAR) trade_date, CASE WHEN trade_date>DATE '2000-06-30' THEN {r('close+1', 4)} ELSE close END AS close, volume FROM prices")
SQL["sink_insert_new"] = compose(f"SELECT stock_id, CAST(trade_date AS VARCHAR) trade_date, CASE WHEN trade_date>DATE '2000-12-31' THEN {r('close+1', 4)} ELSE close END AS close, volume FROM prices")
SQL["sink_replace_keys"] = compose(f"""SELECT f.stock_id, CAST(period_end AS VARCHAR) period_end, period_type, CASE WHEN s.market='ASIA' THEN {r('revenue+1', 2)} ELSE revenue END revenue FROM statements f JOIN stocks s ON s.stock_id=f.stock_id WHERE s.market<>'ASIA' OR year(period_end)>=1998
UNION ALL SELECT stock_id, CAST(period_end AS VARCHAR), period_type, revenue FROM quarters""")
SQL["sink_regenerate_partition"] = compose("SELECT stock_id, preset, CAST(snapshot AS VARCHAR) snapshot, score FROM ssc WHERE snapshot<>(SELECT snapshot FROM snaps ORDER BY snapshot DESC LIMIT 1 OFFSET 1) OR score>=50")
SQL["st_log_quality"] = compose("""SELECT CAST(CAST(started_at AS DATE) AS VARCHAR) AS day, job_type, count(*) FILTER (WHERE status='SUCCESS') success, count(*) FILTER (WHERE status='FAILED') failed, count(*) FILTER (WHERE status='SKIPPED') skipped FROM logs GROUP BY 1,2""")
SQL["st_feed_dedupe"] = compose("SELECT rcept_no, stock_id, title, CAST(filed_at AS VARCHAR) filed_at FROM disclosures WHERE rcept_no>'00000000000005' AND title='사업보고서'")
SQL["st_fx_latest"] = compose("SELECT granularity, CAST(max(rate_at) AS VARCHAR) rate_at, arg_max(usd_krw, rate_at) usd_krw, max(rate_at)<=TIMESTAMP '2024-01-30 20:00:00' stale FROM fx WHERE granularity='SNAPSHOT' GROUP BY 1")
SQL["st_bars_upsert"] = compose(f"SELECT stock_id, CAST(trade_date AS VARCHAR) trade_date, j.open, {r('high', 4)} high, {r('low', 4)} low, {r('j.close', 4)} AS close, volume FROM judged j WHERE reason IS NULL")
SQL["st_volume_surge"] = compose("SELECT stock_id, CAST(as_of AS VARCHAR) as_of, volume, value, avg_volume_20d FROM surge WHERE as_of>DATE '2001-09-30'")
SQL["j_left_null_row"] = compose("SELECT s.stock_id, s.ticker, p.close FROM stocks s LEFT JOIN prices p ON p.stock_id=s.stock_id AND p.trade_date=DATE '2001-10-31'")
SQL["j_cross_small"] = compose("SELECT stock_id, preset FROM stocks CROSS JOIN (VALUES ('aggressive'),('growth'),('balanced'),('value')) p(preset) WHERE coverage<>'listed'")
SQL["j_semi_exists"] = compose("SELECT stock_id, ticker FROM stocks s WHERE EXISTS (SELECT 1 FROM watchlist w WHERE w.stock_id=s.stock_id AND target_price>100000)")
SQL["j_flag_exists"] = compose("SELECT stock_id, EXISTS (SELECT 1 FROM watchlist w WHERE w.stock_id=s.stock_id AND target_price>100000) is_watched FROM stocks s")
SQL["j_anti_not_exists"] = compose("SELECT stock_id FROM stocks s WHERE NOT EXISTS (SELECT 1 FROM disclosures d WHERE d.stock_id=s.stock_id AND filed_at>=TIMESTAMP '2001-07-01')")
SQL["j_not_in_tuple"] = compose("SELECT stock_id, CAST(period_end AS VARCHAR) period_end, period_type FROM quarters WHERE NOT operating_income>=0")
SQL["j_null_safe"] = compose("SELECT s.stock_id, s.group_id, (SELECT count(*) FROM stocks x WHERE x.country=s.country AND x.group_id IS NOT DISTINCT FROM s.group_id) same_theme FROM stocks s")
SQL["j_fuzzy_period"] = compose("""SELECT stock_id, CAST(p AS VARCHAR) p, CAST(q AS VARCHAR) q FROM (SELECT f.stock_id, f.p, q.period_end q, row_number() OVER (PARTITION BY f.stock_id, f.p ORDER BY q.period_end) k FROM (
 SELECT stock_id, period_end-CAST(stock_id%10 AS INT) p FROM statements) f JOIN quarters q ON q.stock_id=f.stock_id AND abs(q.period_end-f.p)<=7) WHERE k=1""")
SQL["j_unnest_params"] = compose(f"""SELECT stock_id, CAST(snapshot AS VARCHAR) snapshot, n.metric, CAST(p.w AS INT) w, {r('p.w*z_adj', 4)} weighted FROM sneu n JOIN (VALUES ('volatility',2),('liab_assets',1)) p(metric, w) ON p.metric=n.metric""")
SQL["agg_median"] = compose("SELECT flag, median(px) median, count(*) n FROM trades GROUP BY 1")
SQL["agg_weighted_mean"] = compose(f"SELECT stock_id, {r('CAST(sum(cents) AS DOUBLE)/(sum(qty)*100)', 4)} vwap FROM trades GROUP BY 1")
SQL["agg_distinct"] = compose("SELECT DISTINCT s.country, CAST(p.trade_date AS VARCHAR) trade_date FROM prices p JOIN stocks s ON s.stock_id=p.stock_id")
SQL["w_running_max"] = compose(f"SELECT stock_id, CAST(trade_date AS VARCHAR) trade_date, {r('close/m-1', 6)} drawdown FROM (SELECT *, max(close) OVER (PARTITION BY stock_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING) m FROM prices)")
SQL["w_tie_average_rank"] = """SELECT event_id, event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value)-1)/2.0 AS rank, count(*) OVER (PARTITION BY event_type) n FROM events"""
SQL["w_percent_rank"] = f"SELECT o_orderkey, {r('100.0*percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice)', 1)} percentile FROM orders"
SQL["queue_watch_rank"] = compose("""SELECT portfolio_id, c cost_krw, rank() OVER (ORDER BY c DESC) AS rank, count(*) OVER () total FROM (SELECT portfolio_id, CAST(sum(CAST(cost_krw AS DECIMAL(24,2))) AS DOUBLE) c FROM items GROUP BY 1)""")
