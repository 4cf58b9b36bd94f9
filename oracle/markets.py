"""SQL for market state, statistics, lists, peers and portfolios."""
from __future__ import annotations

from bourseflow import constants as K
from oracle.ctes import CTES, compose, r, rd
from oracle import scoring as _scoring  # noqa: F401 - registers score tables

SQL: dict[str, str] = {}


# ------------------------------------------------------------------ market state
CTES["ib"] = """SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY trade_date DESC) rn, max(trade_date) OVER (PARTITION BY index_id) last_day FROM index_prices"""
CTES["mi"] = f"""
SELECT i.*, g.as_of, g.close, g.prev_close, {r("g.close-g.prev_close", 4)} AS change, {r("g.close/g.prev_close-1", 6)} change_rate, g.spark,
 CASE WHEN fy THEN hi END high_52w, CASE WHEN fy THEN lo END low_52w, CASE WHEN fy THEN {r("(g.close-lo)/nullif(hi-lo,0)", 6)} END position_52w, first_close
FROM indices i JOIN (SELECT index_id, max(last_day) as_of, max(CASE WHEN rn=1 THEN close END) AS close, max(CASE WHEN rn=2 THEN close END) prev_close,
 count(*) FILTER (WHERE trade_date>last_day-INTERVAL 1 YEAR) spark, bool_or(trade_date<=last_day-INTERVAL 1 YEAR) fy,
 max(close) FILTER (WHERE trade_date>last_day-INTERVAL 1 YEAR) hi, min(close) FILTER (WHERE trade_date>last_day-INTERVAL 1 YEAR) lo,
 arg_min(close, trade_date) FILTER (WHERE trade_date>last_day-INTERVAL 1 YEAR) first_close FROM ib GROUP BY 1) g ON g.index_id=i.index_id"""
SQL["market_indices"] = compose("""SELECT index_id, code, country, currency, CAST(display_order AS INT) display_order, CAST(as_of AS VARCHAR) as_of, close, prev_close, change, change_rate,
 CAST(spark AS INT) sparkline, high_52w, low_52w, position_52w FROM mi""")
SQL["agg_array"] = compose("SELECT index_id, CAST(trade_date AS VARCHAR) date, close FROM ib WHERE trade_date>last_day-INTERVAL 1 YEAR")
CTES["fxd"] = "SELECT CAST(rate_at + INTERVAL 9 HOUR AS DATE) date, usd_krw FROM fx WHERE granularity='DAILY'"
CTES["fxr"] = """SELECT date, usd_krw, (SELECT min(date) FROM fxd) <= (SELECT CAST(max(date)-INTERVAL 1 YEAR AS DATE) FROM fxd) full_year FROM fxd
 WHERE date > (SELECT CAST(max(date)-INTERVAL 1 YEAR AS DATE) FROM fxd)"""
SQL["fx_daily_recent"] = compose("SELECT CAST(date AS VARCHAR) date, usd_krw, full_year FROM fxr")
CTES["fxc"] = f"""
SELECT rate_at, rate, granularity, prev_close, {r("rate-prev_close", 4)} AS change, {r("(rate-prev_close)/prev_close", 6)} change_rate,
 CASE WHEN fy THEN greatest(hi,rate) END high_52w, CASE WHEN fy THEN least(lo,rate) END low_52w,
 CASE WHEN fy THEN {r("(rate-least(lo,rate))/(greatest(hi,rate)-least(lo,rate))", 6)} END position_52w
FROM (SELECT q.rate_at, q.usd_krw rate, q.granularity, (SELECT arg_max(usd_krw, date) FROM fxr WHERE date < (SELECT CAST(rate_at+INTERVAL 9 HOUR AS DATE) FROM fx_latest)) prev_close,
 (SELECT max(usd_krw) FROM fxr) hi, (SELECT min(usd_krw) FROM fxr) lo, (SELECT bool_and(full_year) FROM fxr) fy FROM fx_latest q)"""
SQL["fx_card"] = compose("SELECT * REPLACE (CAST(rate_at AS VARCHAR) AS rate_at) FROM fxc")
SQL["fx_staleness"] = compose("""SELECT CAST(rate_at AS VARCHAR) rate_at, usd_krw, granularity,
 (SELECT max(rate_at) FROM fx WHERE granularity='SNAPSHOT') <= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 4 HOUR stale FROM fx_latest""")
SQL["commodity_info"] = compose(f"""
SELECT l.stock_id, l.group_id, l.code, m.close, m.position_52w, CASE WHEN m.position_52w IS NOT NULL THEN {r("m.close/m.first_close-1", 6)} END change_1y
FROM (SELECT stock_id, group_id, 'IX-' || CASE WHEN stock_id%10=3 THEN 'ASIA' WHEN group_id<10 THEN 'AFRICA' ELSE 'EUROPE' END code FROM theme WHERE commodity_linked) l
LEFT JOIN mi m ON m.code=l.code""")
CTES["sample"] = "SELECT * FROM stocks WHERE is_active AND coverage IN ('featured','benchmark') AND sector IS NOT NULL"
CTES["fdates"] = "SELECT CAST(d - to_months(m) AS DATE) snapshot FROM lastday, (VALUES (7), (4), (0)) v(m)"
CTES["frows"] = """SELECT p.stock_id, p.trade_date, p.close, d.snapshot, s.country, s.sector FROM prices p JOIN fdates d ON p.trade_date<=d.snapshot AND p.trade_date>d.snapshot-30
 JOIN sample s ON s.stock_id=p.stock_id"""
CTES["fref"] = """SELECT snapshot, country, sector, coalesce(max(trade_date) FILTER (WHERE c>=5), max(trade_date)) ref_date FROM (
 SELECT snapshot, country, sector, trade_date, count(*) c FROM frows GROUP BY ALL) GROUP BY 1,2,3"""
CTES["flow"] = f"""
SELECT f.snapshot, f.country, f.sector, {r("x.m", 6)} sector_r5, coalesce(x.n,0) n, f.ref_date FROM fref f LEFT JOIN (
 SELECT snapshot, country, sector, median(close/c5-1) m, count(*) n FROM (
  SELECT w.*, row_number() OVER (PARTITION BY w.snapshot, w.stock_id ORDER BY w.trade_date DESC) rn, lead(w.close,5) OVER (PARTITION BY w.snapshot, w.stock_id ORDER BY w.trade_date DESC) c5, e.ref_date
  FROM frows w JOIN fref e ON e.snapshot=w.snapshot AND e.country=w.country AND e.sector=w.sector AND w.trade_date<=e.ref_date)
 WHERE rn=1 AND trade_date=ref_date AND c5 IS NOT NULL GROUP BY 1,2,3) x ON x.snapshot=f.snapshot AND x.country=f.country AND x.sector=f.sector"""
SQL["sector_flow"] = compose("SELECT CAST(snapshot AS VARCHAR) snapshot, country, sector, sector_r5, n, CAST(ref_date AS VARCHAR) ref_date FROM flow")
CTES["sser"] = f"""SELECT s.country, s.sector, p.trade_date, {r("(CAST(sum(p.close4) AS BIGINT)/10000.0)/count(*)", 4)} AS close FROM prices p JOIN sample s ON s.stock_id=p.stock_id GROUP BY 1,2,3"""
CTES["schg"] = f"""SELECT country, sector, trade_date, {r("(close/p-1)*100.0", 4)} change_pct FROM (
 SELECT *, lag(close) OVER (PARTITION BY country, sector ORDER BY trade_date) p FROM sser) WHERE p<>0"""
SQL["sector_change"] = compose("SELECT country, sector, CAST(trade_date AS VARCHAR) trade_date, change_pct FROM schg")
SQL["sector_board"] = compose("""
SELECT s.sector, m.country, CAST(m.as_of AS VARCHAR) as_of, c.change_pct FROM (SELECT DISTINCT sector FROM groups) s
CROSS JOIN (SELECT country, max(trade_date) as_of FROM schg GROUP BY 1) m LEFT JOIN schg c ON c.country=m.country AND c.sector=s.sector AND c.trade_date=m.as_of""")
CTES["vixs"] = "SELECT trade_date, 10.0 + (CAST(round(close*10000) AS BIGINT)%3000)/100.0 v FROM index_prices WHERE index_id=4"
CTES["ix"] = "SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY trade_date) s, close - lag(close) OVER (PARTITION BY index_id ORDER BY trade_date) d FROM index_prices"
CTES["rsi"] = """
SELECT a.index_id, a.s, sum(greatest(b.d,0.0)*w) gain, sum(greatest(-b.d,0.0)*w) loss FROM (SELECT index_id, s, greatest(s-261, 1) f FROM ix WHERE s>=15) a
JOIN (SELECT index_id, s, d FROM ix) b ON b.index_id=a.index_id AND b.s>a.f AND b.s<=a.s
JOIN (SELECT i.k, m.k mm, CASE WHEN i.k<=14 THEN pow(13.0/14.0, m.k-14)/14.0 ELSE pow(13.0/14.0, m.k-i.k)/14.0 END w
 FROM (SELECT unnest(range(1,262)) k) i JOIN (SELECT unnest(range(14,262)) k) m ON i.k<=m.k) q ON q.k=b.s-a.f AND q.mm=a.s-a.f
GROUP BY 1,2"""
CTES["moodp"] = f"""
SELECT x.index_id, x.trade_date, x.s, CASE WHEN x.s>=252 AND hi>lo THEN (close-lo)/(hi-lo)*100.0 END pp,
 CASE WHEN x.s>=125 THEN greatest(0.0, least(100.0, 50.0+(close/(ma/125.0)-1)*500.0)) END mg,
 CASE WHEN x.s>=15 THEN CASE WHEN r.loss=0 THEN CASE WHEN r.gain=0 THEN 50.0 ELSE 100.0 END ELSE 100.0-100.0/(1.0+r.gain/r.loss) END END rs,
 CASE WHEN x.index_id IN (2,3,4) AND x.trade_date-v.trade_date<=5 THEN greatest(0.0, least(100.0, (35.0-v.v)/23.0*100.0)) END vs
FROM (SELECT *, max(close) OVER w252 hi, min(close) OVER w252 lo, CAST(sum(CAST(close AS DECIMAL(18,4))) OVER w125 AS DOUBLE) ma FROM ix
 WINDOW w252 AS (PARTITION BY index_id ORDER BY trade_date ROWS 251 PRECEDING), w125 AS (PARTITION BY index_id ORDER BY trade_date ROWS 124 PRECEDING)) x
LEFT JOIN rsi r ON r.index_id=x.index_id AND r.s=x.s ASOF LEFT JOIN vixs v ON v.trade_date<=x.trade_date"""
CTES["mood"] = f"""
SELECT index_id, trade_date, {r("pp", 2)} price_position, {r("mg", 2)} ma_gap_score, {r("rs", 2)} rsi_score, {r("vs", 2)} vix_score, score,
 CASE WHEN score IS NULL THEN '{K.INSUFFICIENT}' {' '.join(f"WHEN score<{u} THEN '{n}'" for u, n in K.MOOD_LABELS)} ELSE '{K.MOOD_TOP}' END label
FROM (SELECT *, CASE WHEN k>=2 THEN {r("(coalesce(pp,0.0)+coalesce(mg,0.0)+coalesce(rs,0.0)+coalesce(vs,0.0))/nullif(k,0)", 2)} END score FROM (
 SELECT *, (pp IS NOT NULL)::INT+(mg IS NOT NULL)::INT+(rs IS NOT NULL)::INT+(vs IS NOT NULL)::INT k FROM moodp))"""
SQL["sentiment_components"] = compose("SELECT * REPLACE (CAST(trade_date AS VARCHAR) AS trade_date) FROM mood")
SQL["sentiment_points"] = compose("""SELECT index_id, CASE rn WHEN 1 THEN 'current' WHEN 2 THEN 'previous' ELSE 'week_ago' END AS role, CAST(trade_date AS VARCHAR) trade_date, score, label
 FROM (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY trade_date DESC) rn FROM mood) WHERE rn IN (1,2,6)""")
CTES["cmood"] = """SELECT i.country, m.trade_date, m.score FROM (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY trade_date DESC) rn FROM mood
 WHERE index_id IN (SELECT arg_min(index_id, display_order) FROM indices GROUP BY country) AND score IS NOT NULL) m JOIN indices i ON i.index_id=m.index_id WHERE rn=1"""
BANDS = " ".join(f"WHEN score<{20 * (i + 1)} THEN '{b}'" for i, b in enumerate(K.BAND_LABELS[:4])) + f" ELSE '{K.BAND_LABELS[4]}'"
SQL["market_condition"] = compose(f"""
SELECT stock_id, country, sector, score, CASE WHEN score IS NULL THEN '{K.INSUFFICIENT}' {BANDS} END label, sector_flow FROM (
 SELECT *, CAST({r("CASE WHEN sector_flow IS NULL THEN mood ELSE 0.7::DOUBLE*mood+0.3::DOUBLE*sector_flow END", 0)} AS INT) score FROM (
  SELECT s.stock_id, s.country, s.sector, m.mood, CASE WHEN f.n>=5 THEN {r("greatest(0.0, least(100.0, 50.0+f.sector_r5*500.0))", 2)} END sector_flow
  FROM stocks s LEFT JOIN (SELECT c.country, CASE WHEN (SELECT count(DISTINCT trade_date) FROM index_prices p JOIN indices j ON j.index_id=p.index_id
    WHERE j.country=c.country AND p.trade_date>c.trade_date AND p.trade_date<=(SELECT d FROM lastday))<=5 THEN c.score END mood FROM cmood c) m ON m.country=s.country
  LEFT JOIN (SELECT * FROM flow WHERE snapshot=(SELECT max(snapshot) FROM fdates)) f ON f.country=s.country AND f.sector=s.sector))""")
SQL["market_brief"] = compose("""
SELECT country, CASE WHEN count(*) FILTER (WHERE change_rate IS NULL)>0 THEN NULL WHEN min(sign(change_rate))=1 THEN 'up together' WHEN max(sign(change_rate))=-1 THEN 'down together'
 WHEN min(sign(change_rate))=0 AND max(sign(change_rate))=0 THEN 'flat' ELSE 'mixed' END indices,
 (SELECT CASE WHEN change_rate IS NULL THEN NULL WHEN abs(change_rate)<0.001 THEN 'flat' WHEN change_rate<0 THEN 'won stronger' ELSE 'won weaker' END FROM fxc) fx FROM mi GROUP BY 1""")
# ------------------------------------------------------------------ statistics
av = lambda c, s, p: r(f"CAST(sum(CAST({c} AS DECIMAL(28,{s}))) AS DOUBLE)/count({c})", p)
PER, PBR = "CASE WHEN per>0 THEN per END", "CASE WHEN pbr>0 THEN pbr END"
SQL["stats_market_valuation"] = compose(f"""
SELECT v.market, v.country, v.currency, count(*) stocks, count({PER}) per_samples, {av(PER, 4, 2)} avg_per, {r(f"min({PER})", 2)} min_per, {r(f"max({PER})", 2)} max_per,
 {av(PBR, 4, 2)} avg_pbr, {av("roe", 6, 4)} avg_roe, CAST(sum(CAST(market_cap_krw AS DECIMAL(28,0))) AS DOUBLE) total_market_cap_krw
FROM vm v JOIN stocks s ON s.stock_id=v.stock_id WHERE s.is_active AND s.coverage='featured' GROUP BY 1,2,3 HAVING count(*)>=3""")
SQL["stats_market_excluded"] = compose("SELECT market, count(*) stocks FROM stocks WHERE is_active AND coverage='featured' GROUP BY 1 HAVING count(*)<8")
SQL["stats_peer_group_valuation"] = compose(f"""
SELECT m.group_id, count(*) members, count(*) FILTER (WHERE v.country='KR') kr_members, count(*) FILTER (WHERE v.country='US') us_members,
 {av(PER, 4, 2)} avg_per, {r(f"min({PER})", 2)} min_per, {r(f"max({PER})", 2)} max_per, {av(PBR, 4, 2)} avg_pbr, {av("roe", 6, 4)} avg_roe, {r("min(roe)", 4)} min_roe, {r("max(roe)", 4)} max_roe,
 {av("operating_margin", 6, 4)} avg_operating_margin, {av("revenue_yoy", 6, 4)} avg_revenue_yoy, {av("return_1y", 6, 4)} avg_return_1y, {r("min(return_1y)", 4)} min_return_1y, {r("max(return_1y)", 4)} max_return_1y,
 CAST(sum(CAST(market_cap_krw AS DECIMAL(28,0))) AS DOUBLE) total_market_cap_krw
FROM members m JOIN vm v ON v.stock_id=m.stock_id JOIN stocks s ON s.stock_id=m.stock_id WHERE s.coverage='featured' GROUP BY 1""")
PERIODIC = ", ".join(f"'{x}'" for x in K.PERIODIC_REPORTS)
SQL["stats_disclosure_frequency"] = compose(f"""
SELECT CAST(p AS VARCHAR) period_start, total, dart, sec, periodic_reports, {r("total/CAST(sum(total) OVER () AS BIGINT)", 4)} share, CAST(sum(total) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS BIGINT) cumulative FROM (
 SELECT CAST(date_trunc('month', filed_at+INTERVAL 9 HOUR) AS DATE) p, count(*) total, count(*) FILTER (WHERE data_source='DART') dart, count(*) FILTER (WHERE data_source='SEC') sec,
 count(*) FILTER (WHERE report_type IN ({PERIODIC})) periodic_reports FROM disclosures WHERE filed_at>=TIMESTAMP '2001-08-01' - INTERVAL 3650 DAY GROUP BY 1)""")
CTES["dq"] = f"""
SELECT g.*, CAST(f.finished_at AS VARCHAR) last_failure_at, left(split_part(f.error, chr(10), 1), 300) last_failure_reason, s.ticker last_failure_target FROM (
 SELECT job_type, max(finished_at) FILTER (WHERE status='SUCCESS') last_success_at, max(finished_at) FILTER (WHERE status='SUCCESS' AND source='REFRESH') last_refresh_success_at,
 count(*) FILTER (WHERE rec AND source<>'REFRESH' AND status='SUCCESS') success, count(*) FILTER (WHERE rec AND source<>'REFRESH' AND status='FAILED') failed,
 count(*) FILTER (WHERE rec AND source='REFRESH' AND status='FAILED' AND error LIKE 'PARTIAL%') partial, count(*) FILTER (WHERE rec AND status='SKIPPED') skipped,
 CAST(coalesce(sum(CAST(nullif(regexp_extract(coalesce(error,''), '{K.QUARANTINE_NOTE}', 1),'') AS INT)) FILTER (WHERE rec), 0) AS BIGINT) quarantined_rows
 FROM (SELECT *, started_at>=TIMESTAMP '2024-01-10' rec FROM logs) GROUP BY 1) g
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY finished_at DESC, log_id DESC) k FROM logs WHERE status='FAILED') f ON f.job_type=g.job_type AND f.k=1
LEFT JOIN stocks s ON s.stock_id=f.stock_id"""
SQL["stats_data_quality"] = compose("SELECT * REPLACE (CAST(last_success_at AS VARCHAR) AS last_success_at, CAST(last_refresh_success_at AS VARCHAR) AS last_refresh_success_at) FROM dq")
CTES["dqs"] = f"""SELECT job_type, success, failed, partial, skipped, quarantined_rows, coalesce(h > CASE WHEN job_type IN ('CLICK','VIEW') THEN 0.5 ELSE 1.0 END, true) stale, {r("h", 1)} hours_since_success
FROM (SELECT *, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_refresh_success_at))/3.6e9 h FROM dq)"""
SQL["data_quality_stale"] = compose("""SELECT * FROM dqs UNION ALL SELECT '(total)', CAST(sum(success) AS BIGINT), CAST(sum(failed) AS BIGINT), CAST(sum(partial) AS BIGINT), CAST(sum(skipped) AS BIGINT),
 CAST(sum(quarantined_rows) AS BIGINT), bool_or(stale), NULL FROM dqs""")


def _range(name: str, src: str, day: str | None) -> str:
    d = f"CAST(min({day}) AS VARCHAR), CAST(max({day}) AS VARCHAR)" if day else "NULL, NULL"
    return f"SELECT '{name}', count(*), {d} FROM {src}"


SQL["stats_overview"] = compose("SELECT * FROM (" + " UNION ALL ".join([
    _range("stocks", "stocks", None), _range("peer_groups", "groups", None), _range("daily_prices", "prices", "trade_date"),
    _range("index_daily_prices", "index_prices", "trade_date"), _range("fx_daily", "fx WHERE granularity='DAILY'", "rate_at"),
    _range("fx_snapshots", "fx WHERE granularity='SNAPSHOT'", "rate_at"), _range("valuation_snapshots", "valuations", "as_of"),
    _range("financial_fy", "statements", "period_end"), _range("disclosures", "disclosures", "filed_at"),
    _range("refresh_success", "logs WHERE status='SUCCESS'", "finished_at"), _range("failed_jobs", "logs WHERE status='FAILED'", None)])
    + ") AS t(name, rows, min_date, max_date)")
SQL["status_report"] = compose(" UNION ALL ".join(
    f"SELECT '{n}' name, min(c) least, {r('CAST(sum(c) AS DOUBLE)/count(c)', 0)} mean, max(c) most FROM (SELECT stock_id, count(*) c FROM {s} GROUP BY 1)"
    for n, s in (("bars", "prices"), ("fy", "statements"))))


def _ranking(metrics, where: str, direction: str) -> str:
    cells = ", ".join(f"('{m}', CAST(v.{m} AS DOUBLE))" for m in metrics)
    return f"""SELECT stock_id, ticker, market, metric, value, rank, total FROM (
 SELECT *, row_number() OVER (PARTITION BY metric ORDER BY rank, ticker) o FROM (
  SELECT *, rank() OVER (PARTITION BY metric ORDER BY value {direction}) AS rank, count(*) OVER (PARTITION BY metric) total FROM (
   SELECT v.stock_id, s.ticker, v.market, x.metric, x.value FROM vm v JOIN stocks s ON s.stock_id=v.stock_id, LATERAL (VALUES {cells}) x(metric, value)
   WHERE s.is_active AND s.coverage='featured' AND x.value IS NOT NULL {where}))) WHERE o<=10"""


SQL["stats_ranking"] = compose(_ranking(("return_1m", "return_1y", "volume", "market_cap_krw"), "AND v.country='US'", "DESC"))
SQL["w_rank_dynamic_dir"] = compose(_ranking(("return_3m",), "", "ASC"))
# ------------------------------------------------------------------ lists
CTES["bal"] = "SELECT stock_id, score FROM slast WHERE preset='balanced'"
CTES["rows0"] = f"""
SELECT s.*, l.trade_date as_of, l.close, l.change_rate, l.volume, v.market_cap, v.per, v.pbr, v.shares_outstanding, b.score,
 {rd("v.market_cap*CASE WHEN s.currency='USD' THEN x.usd_krw ELSE 1.0 END", 0)} market_cap_krw, CASE WHEN s.currency='USD' THEN {r("l.close*x.usd_krw", 0)} ELSE l.close END close_krw
FROM stocks s LEFT JOIN lp l ON l.stock_id=s.stock_id LEFT JOIN lv v ON v.stock_id=s.stock_id LEFT JOIN bal b ON b.stock_id=s.stock_id CROSS JOIN fx_latest x"""
SQL["stock_list"] = compose("""
SELECT rank() OVER (ORDER BY market_cap_krw DESC NULLS LAST) AS rank, count(*) OVER () total, stock_id, ticker, name, market, sector, CAST(as_of AS VARCHAR) as_of, close, change_rate, volume, market_cap_krw, score
FROM rows0 WHERE is_active AND coverage IN ('featured','benchmark') ORDER BY market_cap_krw DESC NULLS LAST, stock_id LIMIT 20 OFFSET 10""")
SQL["stock_list_filtered"] = compose("""
SELECT rank() OVER (ORDER BY volume ASC NULLS LAST) AS rank, count(*) OVER () total, stock_id, ticker, coverage, volume FROM rows0 s
WHERE is_active AND country='US' AND (name ILIKE '%00%' OR ticker ILIKE '%00%' OR name_en ILIKE '%00%') AND EXISTS (SELECT 1 FROM members m JOIN groups g ON g.group_id=m.group_id WHERE m.stock_id=s.stock_id AND g.commodity_linked)
ORDER BY volume ASC NULLS LAST, stock_id LIMIT 50""")
QS = [("000012", "000012"), ("00007", "00007"), ("supplier", "supplier"), ("5", "5"), ("a_b", "a\\_b"), ("%", "\\%")]
SQL["stock_search"] = compose(f"""
SELECT q, stock_id, market, country, ticker, name, coverage, bucket, CAST(place AS INT) place FROM (
 SELECT *, row_number() OVER (PARTITION BY q ORDER BY bucket, coverage='listed', length(name), name, stock_id) place FROM (
  SELECT x.q, s.*, CASE WHEN upper(ticker)=upper(x.q) THEN 0 WHEN ticker ILIKE x.e || '%' ESCAPE '\\' THEN 1
   WHEN name ILIKE x.e || '%' ESCAPE '\\' OR name_en ILIKE x.e || '%' ESCAPE '\\' THEN 2 ELSE 3 END bucket
  FROM stocks s JOIN (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in QS)}) v(q, e)
   UNION SELECT q, q FROM (SELECT unnest([substr(ticker, 3, 3), upper(substr(ticker, 2, 5)), lower(substr(name, 4, 12))]) q FROM stocks)) x
   ON ticker ILIKE '%' || x.e || '%' ESCAPE '\\' OR name ILIKE '%' || x.e || '%' ESCAPE '\\' OR name_en ILIKE '%' || x.e || '%' ESCAPE '\\' WHERE is_active)) WHERE place<=10""")
SQL["stock_detail"] = compose("""
SELECT s.stock_id, ticker, name, market, currency, CAST(as_of AS VARCHAR) as_of, close, close_krw, per, pbr, market_cap_krw, shares_outstanding, score, g.groups,
 EXISTS (SELECT 1 FROM watchlist w WHERE w.stock_id=s.stock_id) is_watched
FROM rows0 s LEFT JOIN (SELECT m.stock_id, string_agg(g.theme, ',' ORDER BY NOT m.is_primary, g.theme) groups FROM members m JOIN groups g ON g.group_id=m.group_id GROUP BY 1) g ON g.stock_id=s.stock_id""")
SQL["watchlist_cards"] = compose(f"""
SELECT w.user_id, w.stock_id, w.sort_order, CAST(w.added_at AS VARCHAR) added_at, l.close, l.change_rate, b.score, w.target_price, {r("(w.target_price-l.close)/l.close", 6)} target_gap
FROM watchlist w LEFT JOIN lp l ON l.stock_id=w.stock_id LEFT JOIN bal b ON b.stock_id=w.stock_id""")
SQL["disclosures"] = compose("""SELECT rcept_no, stock_id, title, report_type, CAST(filed_at AS VARCHAR) filed_at, data_source FROM (
 SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY filed_at DESC, rcept_no DESC) rn FROM disclosures) WHERE rn<=5""")
SQL["stock_groups"] = compose("""SELECT m.stock_id, m.group_id, g.theme, m.is_primary, (SELECT count(*) FROM members x JOIN stocks s ON s.stock_id=x.stock_id WHERE x.group_id=m.group_id AND s.coverage='featured') size
FROM members m JOIN groups g ON g.group_id=m.group_id""")
SQL["peer_groups_list"] = compose("""SELECT g.group_id, g.theme, g.sector, count(s.stock_id) size FROM groups g LEFT JOIN members m ON m.group_id=g.group_id
LEFT JOIN stocks s ON s.stock_id=m.stock_id AND s.is_active AND s.coverage IN ('featured','benchmark') GROUP BY 1,2,3""")
# ------------------------------------------------------------------ peers
PM = {"return_1m": ("DESC", 6), "return_3m": ("DESC", 6), "return_1y": ("DESC", 6), "per": ("ASC", 4), "pbr": ("ASC", 4), "roe": ("DESC", 6),
      "operating_margin": ("DESC", 6), "revenue_yoy": ("DESC", 6), "market_cap_krw": ("DESC", 0), "score": ("DESC", 2)}
cells = ", ".join(f"('{m}', {d == 'ASC'}, {p}, CAST({f'CASE WHEN v.{m}>0 THEN v.{m} END' if m in ('per', 'pbr') else ('b.' if m == 'score' else 'v.') + m} AS DOUBLE))" for m, (d, p) in PM.items())
CTES["prow"] = f"""SELECT m.group_id, m.stock_id, s.coverage='featured' featured, x.metric, x.low, x.p, x.value FROM members m JOIN stocks s ON s.stock_id=m.stock_id
 JOIN vm v ON v.stock_id=m.stock_id LEFT JOIN bal b ON b.stock_id=m.stock_id, LATERAL (VALUES {cells}) x(metric, low, p, value) WHERE x.value IS NOT NULL"""
SQL["peers"] = compose(f"""
SELECT group_id, stock_id, featured, metric, value, CASE WHEN low THEN less ELSE more END + 1 AS rank,
 CASE p WHEN 6 THEN {r("a", 6)} WHEN 4 THEN {r("a", 4)} WHEN 2 THEN {r("a", 2)} ELSE {rd("a", 0)} END avg
FROM (SELECT *, CASE WHEN featured THEN s/nullif(n,0) ELSE (coalesce(s,0.0)+value)/(n+1) END a FROM (
  SELECT t.group_id, t.stock_id, t.featured, t.metric, t.low, t.p, t.value, count(*) FILTER (WHERE f.value<t.value) less, count(*) FILTER (WHERE f.value>t.value) more,
  count(f.value) n, CAST(sum(CAST(f.value AS DECIMAL(28,6))) AS DOUBLE) s
 FROM prow t LEFT JOIN (SELECT * FROM prow WHERE featured) f ON f.group_id=t.group_id AND f.metric=t.metric GROUP BY 1,2,3,4,5,6,7))""")
CTES["fmem"] = "SELECT m.group_id, m.stock_id FROM members m JOIN stocks s ON s.stock_id=m.stock_id WHERE s.coverage='featured'"


def _rebased(months: int) -> str:
    return f"""SELECT group_id, stock_id, trade_date, {r("close/base*100.0", 4)} indexed FROM (
 SELECT m.group_id, p.stock_id, p.trade_date, p.close, first_value(p.close) OVER (PARTITION BY m.group_id, p.stock_id ORDER BY p.trade_date) base
 FROM prices p JOIN fmem m ON m.stock_id=p.stock_id JOIN (SELECT group_id, max(trade_date) - INTERVAL {months} MONTH since FROM prices p JOIN fmem m ON m.stock_id=p.stock_id GROUP BY 1) e
 ON e.group_id=m.group_id AND p.trade_date>e.since)"""


CTES["reb3"], CTES["reb1"] = _rebased(3), _rebased(1)
SQL["peers_chart"] = compose("SELECT * REPLACE (CAST(trade_date AS VARCHAR) AS trade_date) FROM reb3")
SQL["peers_chart_grid"] = compose("""SELECT s.group_id, s.stock_id, CAST(d.trade_date AS VARCHAR) trade_date, x.indexed FROM (SELECT DISTINCT group_id, stock_id FROM reb1) s
 JOIN (SELECT DISTINCT group_id, trade_date FROM reb1) d ON d.group_id=s.group_id LEFT JOIN reb1 x ON x.group_id=s.group_id AND x.stock_id=s.stock_id AND x.trade_date=d.trade_date""")
pr = lambda c: r(f"{c}/nullif((CAST(sum(CAST({c} AS DECIMAL(24,4))) OVER g - CAST({c} AS DECIMAL(24,4)) AS DOUBLE))/nullif(count({c}) OVER g - 1, 0), 0) - 1", 4)
SQL["peer_premium"] = compose(f"""SELECT group_id, stock_id, {pr("per")} per_premium, {pr("pbr")} pbr_premium FROM (
 SELECT m.group_id, m.stock_id, {PER} per, {PBR} pbr FROM fmem m JOIN vm v ON v.stock_id=m.stock_id) WINDOW g AS (PARTITION BY group_id)""")
CTES["prof"] = f"""
SELECT s.stock_id, s.country, t.group_id, {r("CASE WHEN v.bps>0 THEN v.close/v.bps END", 8)} pb, {r("CASE WHEN v.eps>0 THEN v.close/v.eps END", 8)} pe, {r("q.roe", 8)} roe3, coalesce(q.yrs,0) roe_years
FROM stocks s JOIN theme t ON t.stock_id=s.stock_id AND t.family='financial' JOIN vm v ON v.stock_id=s.stock_id LEFT JOIN (
 SELECT stock_id, avg(net_income/total_equity) roe, count(*) yrs FROM (SELECT *, max(period_end) OVER (PARTITION BY stock_id) le FROM statements)
 WHERE le-period_end<1000 AND total_equity>0 GROUP BY 1) q ON q.stock_id=s.stock_id WHERE s.is_active AND s.coverage<>'listed'"""
SQL["financial_profile"] = compose("SELECT * FROM prof")
SQL["financial_fit"] = compose(f"""
SELECT stock_id, country, group_id, n, method, CASE WHEN method='regression' THEN {r("slope", 4)} END slope, CASE WHEN method='regression' THEN {r("ic", 4)} END intercept,
 CASE WHEN method='median' THEN {r("mr", 4)} END median_roe, CASE WHEN method='median' THEN {r("mp", 4)} END median_pb, {r("gap", 4)} gap,
 CASE WHEN gap IS NULL THEN NULL WHEN method='regression' THEN CASE WHEN gap<0 THEN 'below line' ELSE 'above line' END
  ELSE CASE WHEN roe3>=mr THEN 'ROE high, ' ELSE 'ROE low, ' END || CASE WHEN gap<=0 THEN 'P/B low' ELSE 'P/B high' END END AS position
FROM (SELECT p.*, l.n, l.method, l.slope, l.ic, l.mr, l.mp, CASE WHEN p.roe3 IS NOT NULL AND p.pb IS NOT NULL THEN CASE WHEN l.method='regression' THEN p.pb-(l.ic+l.slope*p.roe3) ELSE p.pb-l.mp END END gap
 FROM prof p LEFT JOIN (SELECT country, group_id, count(*) n, CASE WHEN count(*)>=3 AND regr_sxx(pb,roe3)>0 THEN 'regression' ELSE 'median' END AS method, regr_slope(pb,roe3) slope,
  regr_intercept(pb,roe3) ic, median(roe3) mr, median(pb) mp FROM prof WHERE roe3 IS NOT NULL AND pb IS NOT NULL GROUP BY 1,2) l ON l.country=p.country AND l.group_id=p.group_id)""")
SQL["trend_label"] = compose(f"""SELECT stock_id, CASE WHEN lg IS NULL OR sh IS NULL THEN '{K.INSUFFICIENT}' WHEN lg>0 AND sh>=0 THEN 'rising' WHEN lg>0 THEN 'resting' WHEN sh>0 THEN 'rebounding' ELSE 'falling' END trend,
 {r("volatility_1y/sqrt(252.0)", 6)} daily_move FROM (SELECT *, coalesce(return_1y, return_6m) lg, coalesce(return_3m, return_1m) sh FROM pm)""")
SQL["score_band"] = compose(f"""SELECT s.stock_id, s.preset, s.score, CASE {BANDS} END band, CAST(greatest(1, ceil(100.0*k.rank_position/k.rank_total)) AS INT) top_percent
FROM slast s JOIN arank k ON k.stock_id=s.stock_id AND k.preset=s.preset WHERE s.score IS NOT NULL""")
# ------------------------------------------------------------------ portfolios
CTES["val"] = f"""
SELECT portfolio_id, stock_id, quantity, cost_krw, close, fx_now, value_krw, {rd("value_krw-cost_krw", 0)} pnl_krw, {r("(value_krw-cost_krw)/nullif(cost_krw,0)", 6)} pnl_rate,
 {r("close/ref_price-1", 6)} local_return, {r("fx_now/ref_fx_rate-1", 6)} fx_return,
 {rd("CAST(quantity*(close4-ref_price4)*fx0 AS BIGINT)/10000.0", 0)} price_effect_krw, CAST((abs(CAST(quantity AS HUGEINT)*close4*(fx100-fx0*100))*2+1000000)//2000000*sign(fx100-fx0*100) AS DOUBLE) fx_effect_krw
FROM (SELECT i.*, l.close, l.close4, CAST(round(CASE WHEN s.currency='USD' THEN x.usd_krw ELSE 1.0 END*100) AS BIGINT) fx100, CASE WHEN s.currency='USD' THEN x.usd_krw ELSE 1.0 END fx_now,
 CAST((CAST(i.quantity AS HUGEINT)*l.close4*CAST(round(CASE WHEN s.currency='USD' THEN x.usd_krw ELSE 1.0 END*100) AS BIGINT)*2+1000000)//2000000 AS DOUBLE) value_krw
 FROM items i JOIN stocks s ON s.stock_id=i.stock_id LEFT JOIN (SELECT * FROM nb WHERE rn=1) l ON l.stock_id=i.stock_id CROSS JOIN fx_latest x)"""
SQL["portfolio_value"] = compose("SELECT * FROM val")
CTES["usedk"] = "SELECT portfolio_id, CAST(sum(CAST(cost_krw AS DECIMAL(24,2))) AS DOUBLE) used FROM items GROUP BY 1"
SQL["portfolio_summary"] = compose(f"""
SELECT p.portfolio_id, p.seed_krw, coalesce(g.items,0) items, coalesce(g.used,0.0) used_krw, {rd("p.seed_krw-coalesce(g.used,0.0)", 2)} remaining_krw, {r("coalesce(g.used,0.0)/p.seed_krw", 6)} usage_rate,
 coalesce(g.tv,0.0) total_value_krw, {rd("coalesce(g.tv,0.0)-coalesce(g.used,0.0)", 0)} total_pnl_krw, {r("(g.tv-g.used)/nullif(g.used,0)", 6)} total_pnl_rate, {r("g.ws/nullif(g.wc,0)", 2)} weighted_score,
 coalesce(g.pe,0.0) price_effect_krw, coalesce(g.fe,0.0) fx_effect_krw
FROM portfolios p LEFT JOIN (SELECT v.portfolio_id, count(*) items, CAST(sum(CAST(cost_krw AS DECIMAL(24,2))) AS DOUBLE) used, sum(value_krw) tv, sum(price_effect_krw) pe, sum(fx_effect_krw) fe,
 CAST(sum(CAST(cost_krw AS DECIMAL(24,2))*CAST(b.score AS DECIMAL(6,2))) AS DOUBLE) ws, CAST(sum(CAST(cost_krw AS DECIMAL(24,2))) FILTER (WHERE b.score IS NOT NULL) AS DOUBLE) wc
 FROM val v LEFT JOIN bal b ON b.stock_id=v.stock_id GROUP BY 1) g ON g.portfolio_id=p.portfolio_id""")
SQL["portfolio_weights"] = compose(f"""
SELECT k.portfolio_id, k.kind, k.name, k.cost cost_krw, {r("k.cost/u.used", 6)} weight FROM (
 SELECT portfolio_id, 'country' kind, s.country name, CAST(sum(CAST(cost_krw AS DECIMAL(24,2))) AS DOUBLE) AS cost FROM items i JOIN stocks s ON s.stock_id=i.stock_id GROUP BY ALL
 UNION ALL SELECT portfolio_id, 'theme', g.theme, CAST(sum(CAST(cost_krw AS DECIMAL(24,2))) AS DOUBLE) FROM items i JOIN members m ON m.stock_id=i.stock_id JOIN groups g ON g.group_id=m.group_id GROUP BY ALL) k
JOIN usedk u ON u.portfolio_id=k.portfolio_id""")
SQL["portfolio_slices"] = compose(f"""
WITH a AS (SELECT *, coalesce(value_krw, cost_krw) amount, row_number() OVER (PARTITION BY portfolio_id ORDER BY coalesce(value_krw, cost_krw) DESC, stock_id) rn, count(*) OVER (PARTITION BY portfolio_id) n FROM val),
 o AS (SELECT portfolio_id, 'stock ' || stock_id slice, amount FROM a WHERE rn<=5 UNION ALL SELECT portfolio_id, 'other ' || (n-5), sum(amount) FROM a WHERE rn>5 GROUP BY portfolio_id, n
  UNION ALL SELECT p.portfolio_id, 'cash', {rd("p.seed_krw-u.used", 2)} FROM portfolios p JOIN usedk u ON u.portfolio_id=p.portfolio_id WHERE p.seed_krw>u.used)
SELECT portfolio_id, slice, amount, {r("amount/t", 6)} share FROM (SELECT *, CAST(sum(CAST(amount AS DECIMAL(24,2))) OVER (PARTITION BY portfolio_id) AS DOUBLE) t FROM o)""".replace("WITH a", "SELECT * FROM (WITH a") + ")")
CTES["unit"] = """SELECT l.stock_id, l.close4*CASE WHEN s.currency='USD' THEN CAST(round(x.usd_krw*100) AS BIGINT) ELSE 100 END unit6, l.close4
FROM (SELECT * FROM nb WHERE rn=1) l JOIN stocks s ON s.stock_id=l.stock_id CROSS JOIN fx_latest x"""
SQL["position_size"] = compose(f"""
SELECT portfolio_id, stock_id, mode, quantity, cost_krw, remaining_krw, max_quantity, CASE WHEN quantity<=0 THEN 'QUANTITY_ZERO' WHEN cost_krw>remaining_krw THEN 'SEED_EXCEEDED' ELSE 'OK' END outcome FROM (
 SELECT *, CAST((CAST(quantity AS HUGEINT)*unit6*2+10000)//20000 AS DOUBLE)/100.0 cost_krw, CASE WHEN rem>0 THEN CAST(CAST(rem*100 AS BIGINT)*10000//unit6 AS BIGINT) ELSE 0 END max_quantity, rem remaining_krw FROM (
  SELECT w.user_id portfolio_id, w.stock_id, CASE w.stock_id%3 WHEN 0 THEN 'quantity' WHEN 1 THEN 'amount' ELSE 'weight' END AS mode, u.unit6, {rd("p.seed_krw-coalesce(k.used,0.0)", 2)} rem,
  CASE w.stock_id%3 WHEN 0 THEN w.stock_id%10 WHEN 1 THEN 30000000000000//u.unit6 ELSE CAST(CAST(p.seed_krw AS BIGINT)*5*10000//u.unit6 AS BIGINT) END quantity
  FROM watchlist w JOIN unit u ON u.stock_id=w.stock_id JOIN portfolios p ON p.portfolio_id=w.user_id LEFT JOIN usedk k ON k.portfolio_id=w.user_id))""")
CTES["ew"] = """
SELECT portfolio_id, stock_id, CASE WHEN reason IS NULL THEN q END quantity, CASE WHEN reason IS NULL THEN CAST((CAST(q AS HUGEINT)*unit6*2+10000)//20000 AS DOUBLE)/100.0 END cost_krw, reason FROM (
 SELECT *, CASE WHEN held THEN 'ALREADY_IN_PORTFOLIO' WHEN unit6 IS NULL THEN 'NO_PRICE' WHEN q<=0 THEN 'PRICE_ABOVE_SHARE' END reason FROM (
  SELECT w.user_id portfolio_id, w.stock_id, i.stock_id IS NOT NULL held, u.unit6, 50000000000000//nullif(u.unit6*count(*) FILTER (WHERE i.stock_id IS NULL AND u.unit6 IS NOT NULL) OVER (PARTITION BY w.user_id), 0) q
  FROM watchlist w LEFT JOIN (SELECT * FROM items WHERE quantity>=30) i ON i.portfolio_id=w.user_id AND i.stock_id=w.stock_id LEFT JOIN unit u ON u.stock_id=w.stock_id))"""
SQL["equal_weight_preview"] = compose("SELECT * FROM ew")
SQL["equal_weight_leftover"] = compose(f"""SELECT portfolio_id, CAST(50000000 AS DOUBLE) budget_krw, coalesce(t,0.0) total_cost_krw, {rd("50000000-coalesce(t,0.0)", 2)} leftover_krw, b bought FROM (
 SELECT portfolio_id, CAST(sum(CAST(cost_krw AS DECIMAL(24,2))) AS DOUBLE) t, count(quantity) b FROM ew GROUP BY 1)""")
