"""SQL for price marts, fundamentals and statistics."""
from __future__ import annotations

from oracle.ctes import CTES, compose, r, rd

CTES["nb"] = """
SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) rn,
 lead(close) OVER (PARTITION BY stock_id ORDER BY trade_date DESC) prev,
 max(trade_date) OVER (PARTITION BY stock_id) last_bar FROM prices"""
CTES["lp"] = f"""
SELECT a.stock_id, s.market, s.country, s.currency, a.trade_date, a.close, a.prev prev_close, {r("a.close - a.prev", 4)} AS change,
 {r("a.close/a.prev - 1", 6)} change_rate, a.volume FROM nb a JOIN stocks s ON s.stock_id=a.stock_id WHERE a.rn=1"""


def ma(n: int) -> str:
    return (f"CASE WHEN count(*) FILTER (WHERE rn<={n})={n} THEN "
            f"{r(f'(CAST(sum(close4) FILTER (WHERE rn<={n}) AS BIGINT)/10000.0)/{n}.0', 4)} END ma{n}")


CTES["risk"] = f"""
SELECT stock_id, max(last_bar) as_of, CAST(max(CASE WHEN rn=1 THEN close END) AS DOUBLE) AS close,
 max(CASE WHEN rn=1 THEN volume END) volume, {r("max(CASE WHEN rn=1 THEN close/prev - 1 END)", 6)} change_rate,
 arg_max(close, trade_date) FILTER (WHERE trade_date<=last_bar-7) p1w,
 arg_max(close, trade_date) FILTER (WHERE trade_date<=last_bar-INTERVAL 1 MONTH) p1m,
 arg_max(close, trade_date) FILTER (WHERE trade_date<=last_bar-INTERVAL 3 MONTH) p3m,
 arg_max(close, trade_date) FILTER (WHERE trade_date<=last_bar-INTERVAL 6 MONTH) p6m,
 arg_max(close, trade_date) FILTER (WHERE trade_date<=last_bar-INTERVAL 1 YEAR) p1y,
 CASE WHEN count(close/prev) FILTER (WHERE rn<=252)=252 THEN {r("stddev_samp(close/prev-1) FILTER (WHERE rn<=252)*sqrt(252.0)", 6)} END volatility_1y,
 {ma(20)}, {ma(60)}, {ma(120)},
 CASE WHEN count(*) FILTER (WHERE rn<=120)=120 THEN (CAST(sum(close4) FILTER (WHERE rn<=120) AS BIGINT)/10000.0)/120.0 END ma120x,
 CASE WHEN count(*) FILTER (WHERE rn BETWEEN 2 AND 21)=20 THEN CAST(sum(volume) FILTER (WHERE rn BETWEEN 2 AND 21) AS BIGINT)/20.0 END av,
 max(high) FILTER (WHERE trade_date>last_bar-INTERVAL 1 YEAR) hi, min(low) FILTER (WHERE trade_date>last_bar-INTERVAL 1 YEAR) lo,
 max(CASE WHEN rn=22 THEN close END) c_21, max(CASE WHEN rn=127 THEN close END) c_126, max(CASE WHEN rn=253 THEN close END) c_252
FROM nb GROUP BY stock_id"""
CTES["mdd"] = f"""
SELECT stock_id, CASE WHEN count(*)=252 THEN {r("min(dd)", 6)} END max_drawdown_1y FROM (
 SELECT stock_id, close/max(close) OVER (PARTITION BY stock_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1 dd FROM nb WHERE rn<=252) d
GROUP BY 1"""
CTES["pm"] = f"""
SELECT k.stock_id, k.as_of, k.close, k.change_rate,
 {', '.join(f'{r(f"k.close/k.p{h} - 1", 6)} return_{h}' for h in ('1w','1m','3m','6m','1y'))},
 volatility_1y, max_drawdown_1y, ma20, ma60, ma120, {r("k.close/ma120x - 1", 6)} ma120_gap,
 CASE WHEN p1y IS NOT NULL THEN hi END high_52w, CASE WHEN p1y IS NOT NULL THEN lo END low_52w,
 CASE WHEN p1y IS NOT NULL THEN {r("(k.close-lo)/nullif(hi-lo,0)", 6)} END position_52w, volume,
 {r("av", 0)} avg_volume_20d, {r("volume/nullif(av,0)", 6)} volume_ratio_20d, c_21, c_126, c_252
FROM risk k JOIN mdd d ON d.stock_id=k.stock_id"""
CTES["fr"] = f"""
SELECT stock_id, period_end fin_period_end, {r("operating_income/nullif(revenue,0)", 6)} operating_margin,
 {r("CASE WHEN total_equity>0 THEN net_income/total_equity END", 6)} roe, {r("total_debt/nullif(total_equity,0)", 6)} debt_ratio,
 {r("CASE WHEN gap BETWEEN 330 AND 400 THEN (revenue-prv)/nullif(abs(prv),0) END", 6)} revenue_yoy,
 {r("CASE WHEN gap BETWEEN 330 AND 400 THEN (operating_income-poi)/nullif(abs(poi),0) END", 6)} operating_income_yoy
FROM (SELECT *, period_end - lag(period_end) OVER w gap, lag(revenue) OVER w prv, lag(operating_income) OVER w poi,
 row_number() OVER (PARTITION BY stock_id ORDER BY period_end DESC) rn FROM statements WINDOW w AS (PARTITION BY stock_id ORDER BY period_end)) f
WHERE rn=1"""
CTES["lv"] = """
SELECT stock_id, as_of valuation_as_of, per, pbr, eps, bps, market_cap, dps, shares_outstanding FROM (
 SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY as_of DESC) rn FROM valuations) v WHERE rn=1"""
CTES["vm"] = f"""
SELECT p.*, s.market, s.country, s.currency, v.valuation_as_of, v.per, v.pbr, v.eps, v.bps, v.market_cap, v.dps, v.shares_outstanding,
 f.fin_period_end, f.operating_margin, f.roe, f.debt_ratio, f.revenue_yoy, f.operating_income_yoy, x.usd_krw fx_usd_krw,
 {rd("v.market_cap*CASE WHEN s.currency='USD' THEN x.usd_krw ELSE 1.0 END", 0)} market_cap_krw,
 {r("v.dps/p.close", 6)} dividend_yield
FROM pm p JOIN stocks s ON s.stock_id=p.stock_id LEFT JOIN lv v ON v.stock_id=p.stock_id LEFT JOIN fr f ON f.stock_id=p.stock_id CROSS JOIN fx_latest x"""

SQL: dict[str, str] = {}
SQL["v_stock_metrics"] = compose("""
SELECT * EXCLUDE (as_of, valuation_as_of, fin_period_end), CAST(as_of AS VARCHAR) as_of, CAST(valuation_as_of AS VARCHAR) valuation_as_of,
 CAST(fin_period_end AS VARCHAR) fin_period_end FROM vm""")
SQL["v_latest_price"] = compose("SELECT * REPLACE (CAST(trade_date AS VARCHAR) AS trade_date) FROM lp")
SQL["v_fx_latest"] = compose("SELECT CAST(rate_at AS VARCHAR) rate_at, usd_krw, granularity FROM fx_latest")
SQL["v_stock_theme"] = compose("SELECT stock_id, group_id, theme, sector, family, commodity_linked FROM theme")
for name, cols in {
    "m_returns": "return_1w, return_1m, return_3m, return_6m, return_1y", "m_volatility": "volatility_1y",
    "m_max_drawdown": "max_drawdown_1y", "m_moving_avg": "ma20, ma60, ma120, ma120_gap",
    "m_volume_ratio": "avg_volume_20d, volume_ratio_20d", "m_range_52w": "high_52w, low_52w, position_52w",
}.items():
    SQL[name] = compose(f"SELECT stock_id, {cols} FROM pm")
SQL["m_fin_ratios"] = compose("SELECT * REPLACE (CAST(fin_period_end AS VARCHAR) AS fin_period_end) FROM fr")
SQL["m_market_cap_krw"] = compose("SELECT stock_id, market_cap_krw, dividend_yield FROM vm")
SQL["candles"] = compose("""
SELECT p.stock_id, CAST(trade_date AS VARCHAR) trade_date, p.open, high, low, p.close, volume FROM prices p
JOIN (SELECT stock_id, max(trade_date) - INTERVAL 3 MONTH since FROM prices GROUP BY 1) l ON l.stock_id=p.stock_id AND trade_date>since""")
SQL["stats_monthly"] = compose(f"""
SELECT stock_id, strftime(m, '%Y-%m') AS month, count(*) trading_days, CAST(min(trade_date) AS VARCHAR) first_date, CAST(max(trade_date) AS VARCHAR) last_date,
 {r("(CAST(sum(close4) AS BIGINT)/10000.0)/count(*)", 4)} avg_close, max(high) max_high, min(low) min_low,
 arg_min(close, trade_date) first_close, arg_max(close, trade_date) last_close,
 {r("arg_max(close, trade_date)/arg_min(close, trade_date) - 1", 6)} monthly_return, CAST(sum(volume) AS BIGINT) total_volume,
 {r("CAST(sum(volume) AS BIGINT)/count(*)", 0)} avg_volume, m = DATE '2001-10-01' is_partial
FROM (SELECT *, CAST(date_trunc('month', trade_date) AS DATE) m FROM prices WHERE trade_date >= DATE '1999-11-01' AND trade_date <= DATE '2001-10-20') b
GROUP BY stock_id, m""")
CTES["surge"] = f"""
SELECT stock_id, max(trade_date) as_of, max(CASE WHEN rn=1 THEN volume END) volume,
 {r("max(CASE WHEN rn=1 THEN volume END)/(CAST(sum(volume) FILTER (WHERE rn>1) AS BIGINT)/20.0)", 4)} AS value,
 {r("CAST(sum(volume) FILTER (WHERE rn>1) AS BIGINT)/20.0", 0)} avg_volume_20d
FROM nb WHERE rn<=21 GROUP BY 1 HAVING count(*)=21"""
SQL["home_volume_surge"] = compose("""
SELECT rank, stock_id, ticker, name, market, country, currency, value, volume, avg_volume_20d, as_of FROM (
 SELECT rank() OVER (PARTITION BY s.country ORDER BY g.value DESC) AS rank, row_number() OVER (PARTITION BY s.country ORDER BY g.value DESC, s.stock_id) o,
 s.stock_id, s.ticker, s.name, s.market, s.country, s.currency, g.value, g.volume, g.avg_volume_20d, CAST(g.as_of AS VARCHAR) as_of
 FROM surge g JOIN stocks s ON s.stock_id=g.stock_id WHERE s.is_active AND s.coverage IN ('featured','benchmark')) q WHERE o<=10""")
SQL["financials_trend"] = compose(f"""
SELECT stock_id, CAST(period_end AS VARCHAR) period_end, period_type, revenue, operating_income, net_income, total_assets, total_equity, total_debt,
 {r("operating_income/nullif(revenue,0)", 6)} operating_margin, {r("CASE WHEN total_equity>0 THEN net_income/total_equity END", 6)} roe
FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY period_end DESC) rn FROM statements) f WHERE rn<=5""")
SQL["r5_return"] = compose(f"""
SELECT stock_id, CAST(trade_date AS VARCHAR) trade_date, {r("close/c5 - 1", 6)} r5 FROM (
 SELECT stock_id, trade_date, close, lag(close,5) OVER (PARTITION BY stock_id ORDER BY trade_date) c5 FROM prices) x WHERE c5 IS NOT NULL""")
