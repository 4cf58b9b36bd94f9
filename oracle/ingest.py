"""SQL for cleaning, incremental loading, retention, due dates, themes and selection."""
from __future__ import annotations

from bourseflow import constants as K
from oracle.ctes import CTES, compose, r
from oracle import markets as _markets  # noqa: F401

SQL: dict[str, str] = {}
CTES["rawb"] = """
SELECT p.stock_id, trade_date, CASE WHEN NOT (d=14 AND m=1) THEN p.open END AS open, CASE WHEN d=16 AND m=3 THEN p.low-1 ELSE p.high END high,
 CASE WHEN d=15 AND m=2 THEN 0.0 ELSE p.low END low, CASE WHEN NOT (d=13 AND m=0) THEN CASE WHEN d=18 THEN p.close*2 ELSE p.close END END AS close,
 CASE WHEN d=17 AND m=4 THEN -volume ELSE volume END volume FROM (SELECT *, day(trade_date) d, stock_id%5 m FROM prices) p"""
CTES["judged"] = f"""
SELECT b.*, CASE WHEN trade_date=DATE '2001-10-31' THEN '{K.BAD_UNFINISHED}' WHEN b.close IS NULL THEN '{K.BAD_NO_CLOSE}'
 WHEN b.open IS NULL OR high IS NULL OR low IS NULL OR volume IS NULL THEN '{K.BAD_NO_OHLCV}' WHEN b.close<=0 OR low<=0 THEN '{K.BAD_PRICE}'
 WHEN high<low THEN '{K.BAD_HIGH_LOW}' WHEN volume<0 THEN '{K.BAD_VOLUME}' END reason FROM rawb b"""
SQL["clean_bars"] = compose(f"SELECT stock_id, CAST(trade_date AS VARCHAR) trade_date, j.open, {r('high', 4)} high, {r('low', 4)} low, {r('j.close', 4)} AS close, volume FROM judged j WHERE reason IS NULL")
SQL["quarantine_sink"] = compose(f"""
SELECT reason, stock_id, CAST(trade_date AS VARCHAR) trade_date, '{{' || array_to_string(list_filter([
  '"stock_id":' || stock_id, '"trade_date":"' || trade_date || '"', '"open":' || printf('%.4f', x.open), '"high":' || printf('%.4f', high),
  '"low":' || printf('%.4f', low), '"close":' || printf('%.4f', x.close), '"volume":' || volume], lambda y: y IS NOT NULL), ',') || '}}' AS row
FROM (SELECT stock_id, trade_date, j.open, high, low, j.close, volume, reason FROM judged j WHERE reason IS NOT NULL
 UNION ALL SELECT stock_id + 1000000, trade_date, b.open, high, low, b.close, volume, '{K.BAD_UNKNOWN}' FROM rawb b WHERE day(trade_date)=12 AND stock_id%5=2) x""")
SQL["clean_unfinished_session"] = compose("SELECT p.stock_id, CAST(trade_date AS VARCHAR) trade_date, s.timezone FROM prices p JOIN stocks s ON s.stock_id=p.stock_id WHERE trade_date=DATE '2001-10-31'")
SQL["clean_dedupe"] = "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) rn FROM events) WHERE rn=1"
SQL["clean_fx_spike"] = compose(f"""
SELECT CAST(rate_at AS VARCHAR) rate_at, granularity, usd_krw, {r("m", 4)} median, CASE WHEN abs(usd_krw/m-1)>0.05 THEN 'deviation' END reason FROM (
 SELECT *, list_aggregate(list_concat(coalesce(a,[]), coalesce(b,[])), 'median') m FROM (
  SELECT *, list(usd_krw) OVER (PARTITION BY granularity ORDER BY rate_at ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) a,
  list(usd_krw) OVER (PARTITION BY granularity ORDER BY rate_at ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) b FROM fx))""")
SQL["src_numeric_clean"] = """SELECT c_custkey, amount, CASE WHEN amount>0 THEN amount END positive FROM (
 SELECT c_custkey, CASE WHEN c_custkey%6 IN (0,5) THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) END amount FROM customer)"""
SQL["src_common_stock_filter"] = compose("""
SELECT country, ticker, count(*) rows FROM (SELECT 'KR' country, ticker FROM stocks WHERE country='KR' AND ticker LIKE '%0' AND length(ticker)=6
 UNION ALL SELECT 'US', t FROM (SELECT upper(split_part(p_name,' ',2)) t, p_size FROM part) WHERE regexp_full_match(t, '[A-Z]{1,5}(-[A-OQ-Z])?') AND p_size%7<>0
 AND NOT (length(t)=5 AND right(t,1) IN ('M','N','O','P','Q','R','T','U','V','W','X','Z'))) GROUP BY 1,2""")
SQL["incr_start_date"] = compose("""
SELECT stock_id, CAST(s AS VARCHAR) "start", CAST(e AS VARCHAR) "end", CASE WHEN s>e THEN 'up to date' WHEN e-s<=1 AND isodow(s)>=6 AND isodow(e)>=6 THEN 'weekend' END skip_reason FROM (
 SELECT k.stock_id, coalesce(l.d+1, DATE '2001-11-04'-730) s, DATE '2001-11-03' e
 FROM stocks k LEFT JOIN (SELECT stock_id, max(trade_date) d FROM prices GROUP BY 1) l ON l.stock_id=k.stock_id)""")
CTES["nbf"] = """SELECT stock_id, trade_date, close, CASE WHEN stock_id%9=4 AND day(trade_date)>15 THEN (close/prev-1)*100.0/2 ELSE (close/prev-1)*100.0 END cr, prev FROM nb WHERE trade_date>DATE '2001-09-30'"""
SQL["incr_adjust_detect_kr"] = compose("""
SELECT stock_id, CAST(trade_date AS VARCHAR) trade_date, close, CAST(f AS VARCHAR) flag_date FROM (
 SELECT *, min(CASE WHEN abs(close/nullif(prev*(1.0+cr/100.0),0)-1)>0.005 THEN trade_date END) OVER (PARTITION BY stock_id) f FROM nbf) WHERE f IS NULL OR trade_date<f""")
SQL["incr_adjust_detect_us"] = compose("""
SELECT stock_id, CAST(trade_date AS VARCHAR) trade_date, close stored_close, CAST(round(CAST(close AS DECIMAL(18,4))/2, 4) AS DOUBLE) AS close FROM (
 SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) k FROM prices WHERE trade_date<=DATE '2001-09-30') WHERE k=1 AND trade_date>=DATE '2001-09-01' AND stock_id%8=3""")
SQL["incr_feed"] = compose("""
SELECT d.no rcept_no, d.stock_id, s.company, d.title, CAST(filed_at AS VARCHAR) filed_at FROM (SELECT *, strftime(filed_at,'%Y%m%d') || substr(rcept_no, 9, 6) no FROM disclosures WHERE filed_at>=TIMESTAMP '2001-06-28') d
JOIN stocks s ON s.stock_id=d.stock_id AND s.is_active WHERE d.no>'20010630000000' AND d.title='사업보고서'""")
CTES["tgt"] = """
SELECT s.stock_id FROM stocks s LEFT JOIN (SELECT stock_id, CAST(max(filed_at) AS DATE) d FROM disclosures WHERE report_type='10-Q' GROUP BY 1) y ON y.stock_id=s.stock_id
WHERE s.coverage='benchmark' AND (y.d IS NULL OR y.d<DATE '2001-10-31'-30) AND s.stock_id NOT IN (SELECT stock_id FROM watchlist WHERE target_price>104000) AND s.stock_id NOT IN (SELECT stock_id FROM items WHERE quantity>170)"""
CTES["allst"] = "SELECT stock_id, period_end, period_type FROM statements UNION ALL SELECT stock_id, period_end, period_type FROM quarters"
SQL["prune_retention"] = compose("""
SELECT 'prices' name, stock_id, count(*) kept FROM prices WHERE NOT (stock_id IN (SELECT stock_id FROM tgt) AND trade_date<DATE '2000-10-31') GROUP BY 2
UNION ALL SELECT 'valuations', stock_id, count(*) FROM (SELECT *, max(as_of) OVER (PARTITION BY stock_id) l FROM valuations) WHERE NOT (stock_id IN (SELECT stock_id FROM tgt) AND as_of<least(DATE '2001-10-21', l)) GROUP BY 2
UNION ALL SELECT 'statements', stock_id, count(*) FROM (SELECT *, dense_rank() OVER (PARTITION BY stock_id, period_type='FY' ORDER BY period_end DESC) k FROM allst)
 WHERE NOT (stock_id IN (SELECT stock_id FROM tgt) AND k>CASE WHEN period_type='FY' THEN 3 ELSE 8 END) GROUP BY 2
UNION ALL SELECT 'disclosures', stock_id, count(*) FROM disclosures WHERE stock_id NOT IN (SELECT stock_id FROM tgt) GROUP BY 2""")
SQL["prune_users"] = compose(f"""SELECT user_id, count(*) items FROM watchlist WHERE user_id NOT IN (SELECT user_id FROM users WHERE email IS NULL AND nickname LIKE '{K.GUEST_PREFIX}%' AND last_seen_at<TIMESTAMP '2001-03-01') GROUP BY 1""")
SQL["prune_sector"] = compose("SELECT country, sector, CAST(trade_date AS VARCHAR) trade_date, change_pct FROM schg WHERE trade_date>=(SELECT d-30 FROM lastday)")
CTES["newlist"] = """SELECT country, ticker, CASE WHEN stock_id%7=2 THEN CASE WHEN country='KR' THEN 'AMERICA' ELSE 'ASIA' END ELSE market END market,
 CASE WHEN stock_id%10=1 THEN name || ' Holdings' ELSE name END name FROM stocks WHERE s_acctbal>=0
UNION ALL SELECT 'US', 'N' || c_custkey, 'ASIA', c_name FROM customer WHERE c_nationkey=7"""
SQL["listing_sync"] = compose("""
SELECT country, ticker, action, om old_market, nm new_market FROM (SELECT *, CASE WHEN om IS NULL THEN 'added' WHEN coverage='listed' AND nm IS NOT NULL AND nm<>om THEN 'moved' WHEN coverage='listed' AND nm IS NOT NULL AND nn<>on_ THEN 'renamed'
 WHEN coverage='listed' AND nm IS NOT NULL AND NOT is_active THEN 'reactivated' WHEN coverage='listed' AND is_active AND nm IS NULL AND fresh>=0.5*active THEN 'deactivated' END AS action FROM (
 SELECT coalesce(o.country,n.country) country, coalesce(o.ticker,n.ticker) ticker, o.market om, o.name on_, o.coverage, o.is_active, n.market nm, n.name nn,
  (SELECT count(*) FROM newlist x WHERE x.country=coalesce(o.country,n.country)) fresh, (SELECT count(*) FROM stocks x WHERE x.country=coalesce(o.country,n.country) AND x.coverage='listed' AND x.is_active) active
 FROM stocks o FULL JOIN newlist n ON n.country=o.country AND n.ticker=o.ticker)) WHERE action IS NOT NULL""")
CTES["fyend"] = """SELECT s.stock_id, CASE WHEN s.stock_id%6<>5 THEN CAST(CASE WHEN s.stock_id%6=0 THEN f.e ELSE f.e - to_months(CAST(s.stock_id%6 AS INT)) END AS DATE) END fy_end FROM stocks s
LEFT JOIN (SELECT stock_id, max(period_end) e FROM statements WHERE period_end<=DATE '2000-12-31' GROUP BY 1) f ON f.stock_id=s.stock_id"""
CTES["vu"] = """SELECT stock_id, fy_end, CASE WHEN fy_end IS NULL OR due<=TIMESTAMP '2001-02-10 03:00:00' THEN TIMESTAMP '2001-02-17 03:00:00'
 ELSE least(TIMESTAMP '2001-02-10 03:00:00'+to_days(CAST(90-stock_id%7 AS INT)), due) END valid_until FROM (
 SELECT *, CAST(fy_end + INTERVAL 1 YEAR AS TIMESTAMP) + INTERVAL 97 DAY - INTERVAL 9 HOUR due FROM fyend)"""
SQL["freshness_valid_until"] = compose("SELECT stock_id, CAST(fy_end AS VARCHAR) fy_end, CAST(valid_until AS VARCHAR) valid_until FROM vu")
CTES["fresh"] = "SELECT stock_id, TIMESTAMP '2001-02-10 03:00:00' fetched_at, valid_until FROM vu WHERE fy_end IS NOT NULL"
SQL["freshness_expire"] = compose("""
SELECT f.stock_id, CAST(fetched_at AS VARCHAR) fetched_at, CAST(CASE WHEN coalesce(h,false) THEN fetched_at ELSE valid_until END AS VARCHAR) valid_until, coalesce(h,false) expired FROM (
 SELECT f.*, f.valid_until>TIMESTAMP '2001-03-01' AND d.m>f.fetched_at h FROM fresh f LEFT JOIN (SELECT stock_id, max(filed_at) m FROM disclosures
 WHERE filed_at<TIMESTAMP '2001-03-01' AND (title LIKE '%사업보고서%' OR report_type IN ('10-K','10-K/A')) GROUP BY 1) d ON d.stock_id=f.stock_id) f""")
SQL["queue_priority"] = compose("""SELECT s.stock_id, CAST(f.valid_until AS VARCHAR) valid_until FROM stocks s LEFT JOIN fresh f ON f.stock_id=s.stock_id
WHERE f.valid_until IS NULL OR f.valid_until<=TIMESTAMP '2001-05-01' ORDER BY f.valid_until ASC NULLS FIRST, s.stock_id LIMIT 40""")
SQL["refresh_due"] = compose("""
SELECT job_type, CAST(ok AS VARCHAR) last_ok, CAST(bad AS VARCHAR) last_bad, CAST(CASE WHEN ok>TIMESTAMP '2024-01-30 08:00:00' THEN ok+INTERVAL 4 HOUR WHEN bad>TIMESTAMP '2024-01-30 11:30:00' THEN bad+INTERVAL 30 MINUTE
 ELSE TIMESTAMP '2024-01-30 12:00:00' END AS VARCHAR) due_at FROM (SELECT job_type, ok, CASE WHEN ok IS NULL OR bad>ok THEN bad END bad FROM (
 SELECT job_type, max(finished_at) FILTER (WHERE status='SUCCESS') ok, max(finished_at) FILTER (WHERE status='FAILED') bad FROM logs WHERE source='REFRESH' GROUP BY 1))""")
SQL["refresh_status"] = compose("""SELECT job_type, l.source, CAST(CAST(started_at AS DATE) AS VARCHAR) AS day, count(*) n, count(*) FILTER (WHERE status='SUCCESS') ok, count(*) FILTER (WHERE status='FAILED') bad,
 CASE WHEN count(*) FILTER (WHERE status='SUCCESS')=count(*) THEN 'SUCCESS' WHEN count(*) FILTER (WHERE status='FAILED')=count(*) THEN 'FAILED' ELSE 'PARTIAL' END run FROM logs l GROUP BY 1,2,3""")
SQL["valuation_stale"] = compose("""SELECT s.stock_id, coalesce(v.v<least(CASE WHEN s.country='KR' THEN DATE '2001-10-31' ELSE DATE '2001-10-30' END, b.b), true) stale FROM stocks s
LEFT JOIN (SELECT stock_id, max(as_of) v FROM valuations WHERE as_of<=DATE '2001-10-30' GROUP BY 1) v ON v.stock_id=s.stock_id LEFT JOIN (SELECT stock_id, max(trade_date) b FROM prices GROUP BY 1) b ON b.stock_id=s.stock_id""")
SQL["last_closed_day"] = """
SELECT event_id, country, CAST(CASE isodow(d) WHEN 6 THEN d-1 WHEN 7 THEN d-2 ELSE d END AS VARCHAR) closed FROM (
 SELECT event_id, 'KR' country, CAST(ts + INTERVAL 9 HOUR AS DATE) - CASE WHEN CAST(ts + INTERVAL 9 HOUR AS TIME)>=TIME '18:00:00' THEN 0 ELSE 1 END d FROM events
 UNION ALL SELECT event_id, 'US', CAST(ts - INTERVAL 5 HOUR AS DATE) - CASE WHEN CAST(ts - INTERVAL 5 HOUR AS TIME)>=TIME '17:00:00' THEN 0 ELSE 1 END FROM events)"""
CTES["cal"] = "SELECT DISTINCT i.country, p.trade_date session_date FROM index_prices p JOIN indices i ON i.index_id=p.index_id"
SQL["session_status"] = compose("""
SELECT country, CAST(as_of AS VARCHAR) as_of, CAST(today AS VARCHAR) today, CASE WHEN as_of>=today THEN 'today' WHEN EXISTS (SELECT 1 FROM cal c WHERE c.country=x.country AND c.session_date=x.today) THEN 'previous_session' ELSE 'holiday' END status
FROM (SELECT country, max(session_date) as_of, CASE WHEN country='KR' THEN DATE '2001-10-14' ELSE DATE '2001-10-13' END today FROM cal WHERE session_date<=DATE '2001-10-12' GROUP BY 1) x""")
SQL["sessions_between"] = compose("""
SELECT x.stock_id, x.country, CAST(max(x.st) AS VARCHAR) "start", '2001-11-02' "end", CASE WHEN max(x.st)>=DATE '2001-11-02' THEN 0 ELSE count(c.session_date) END sessions FROM (
 SELECT s.stock_id, s.country, max(p.trade_date) st FROM stocks s JOIN prices p ON p.stock_id=s.stock_id GROUP BY 1,2) x
LEFT JOIN cal c ON c.country=x.country AND c.session_date>x.st AND c.session_date<=DATE '2001-11-02' GROUP BY 1,2""")
SQL["budget_used"] = compose("""SELECT l.source, count(*) FILTER (WHERE h) used, greatest(0, 500-count(*) FILTER (WHERE h)) remaining FROM (
 SELECT *, job_type IN ('PURCHASE','VIEW') AND started_at>=TIMESTAMP '2024-01-19 15:00:00' AND started_at<TIMESTAMP '2024-01-20 12:00:00' h FROM logs) l GROUP BY 1""")
CTES["rules"] = """SELECT g.group_id k, g.theme, o.theme other FROM groups g JOIN groups o ON o.group_id=(g.group_id+7)%25"""
THEME_ASSIGN = """
SELECT stock_id, theme FROM (SELECT s.stock_id, CASE s.ticker WHEN '000004' THEN 'NATION_9' WHEN '000011' THEN 'NATION_2' ELSE CASE WHEN s.country='KR' THEN k.theme ELSE c.theme END END theme FROM stocks s
LEFT JOIN (SELECT stock_id, arg_max(theme, w || theme) theme FROM (SELECT s.stock_id, length(r.prefix) w, r.theme FROM stocks s JOIN (
  SELECT lpad(CAST(k*4+i AS VARCHAR),3,'0') prefix, theme FROM rules CROSS JOIN (SELECT unnest(range(4)) i) UNION ALL SELECT lpad(CAST(k*40+5 AS VARCHAR),4,'0'), other FROM rules) r ON starts_with(s.ksic, r.prefix)) GROUP BY 1) k ON k.stock_id=s.stock_id
LEFT JOIN (SELECT stock_id, arg_max(theme, lpad(CAST(1000-w AS VARCHAR),4,'0') || theme) theme FROM (SELECT s.stock_id, r.hi-r.lo w, r.theme FROM stocks s JOIN (
  SELECT k*100+1000 lo, k*100+1099 hi, theme FROM rules UNION ALL SELECT k*100+1040, k*100+1059, other FROM rules) r ON s.sic BETWEEN r.lo AND r.hi) GROUP BY 1) c ON c.stock_id=s.stock_id) WHERE theme IS NOT NULL"""
CTES["main_theme"] = THEME_ASSIGN
SQL["theme_assign"] = compose("""SELECT p.stock_id, p.theme, true is_primary, g.sector FROM main_theme p JOIN groups g ON g.theme=p.theme
UNION ALL SELECT p.stock_id, o.theme, false, g.sector FROM main_theme p JOIN groups g ON g.theme=p.theme JOIN members m ON m.stock_id=p.stock_id AND NOT m.is_primary
JOIN groups o ON o.group_id=m.group_id WHERE o.theme<>p.theme""")
CTES["shares0"] = """SELECT s.stock_id, l.close, l.volume, CASE WHEN s.stock_id%6<>2 THEN CASE WHEN s.stock_id%8=4 THEN s.shares*1000 ELSE s.shares END END sh,
 CASE WHEN s.stock_id%4<>0 THEN v.market_cap END quoted, a.assets, CASE WHEN s.stock_id%12=2 THEN l.close*l.volume END vt, s.stock_id%5<>3 fr
FROM stocks s JOIN lp l ON l.stock_id=s.stock_id LEFT JOIN lv v ON v.stock_id=s.stock_id LEFT JOIN (SELECT stock_id, arg_max(total_assets, period_end) assets FROM statements GROUP BY 1) a ON a.stock_id=s.stock_id
WHERE s.is_active AND s.country='US'"""
CTES["shares1"] = """SELECT *, sh*close filed, row_number() OVER (ORDER BY sh*close DESC NULLS LAST, stock_id) rf, row_number() OVER (PARTITION BY sh IS NULL AND vt IS NOT NULL ORDER BY vt DESC, stock_id) rv FROM shares0"""
CTES["shares2"] = f"""SELECT *, CASE WHEN q IS NOT NULL THEN q WHEN cand AND filed>200.0*assets THEN NULL ELSE filed END cap, CASE WHEN filed/q<1/1.2::DOUBLE OR filed/q>1.2::DOUBLE THEN {r("filed/q", 6)} END share_ratio FROM (
 SELECT *, CASE WHEN cand THEN quoted END q FROM (SELECT *, (sh IS NOT NULL AND rf<=40) OR (sh IS NULL AND vt IS NULL) OR (sh IS NULL AND vt IS NOT NULL AND rv<=10) cand FROM shares1))"""
CAP_RANKING = f"""
SELECT stock_id, share_ratio, CASE WHEN k<=30 THEN CAST(k AS INT) END cap_rank, CASE WHEN k<=30 THEN {r("cap", 0)} END cap_usd FROM (
 SELECT *, CASE WHEN cap IS NOT NULL AND (sh IS NOT NULL OR fr) THEN row_number() OVER (PARTITION BY cap IS NOT NULL AND (sh IS NOT NULL OR fr) ORDER BY cap DESC, stock_id) END k FROM shares2) WHERE k<=30 OR share_ratio IS NOT NULL"""
SQL["cap_ranking"] = compose(CAP_RANKING)
SQL["trading_value_rank"] = compose("""
SELECT s.stock_id, coalesce(l.close*l.volume,0.0) AS first, coalesce(v.market_cap,0.0) AS second FROM stocks s LEFT JOIN lp l ON l.stock_id=s.stock_id LEFT JOIN lv v ON v.stock_id=s.stock_id
WHERE s.is_active AND s.coverage='listed' AND s.stock_id NOT IN (SELECT stock_id FROM fresh WHERE valid_until>TIMESTAMP '2001-05-01') ORDER BY 2 DESC, 3 DESC, 1 LIMIT 25""")
SQL["industry_due"] = compose("""
SELECT country, CAST(place AS INT) place, stock_id FROM (SELECT s.country, s.stock_id, row_number() OVER (PARTITION BY s.country ORDER BY s.coverage='featured' DESC, s.coverage='benchmark' DESC, cap_rank ASC NULLS LAST, s.stock_id) place
 FROM (SELECT *, CASE WHEN stock_id%3=0 THEN stock_id%101 END cap_rank FROM stocks) s LEFT JOIN (SELECT stock_id, CAST(max(filed_at) AS DATE) d FROM disclosures WHERE report_type='10-K' GROUP BY 1) c ON c.stock_id=s.stock_id
 WHERE s.is_active AND (c.d IS NULL OR c.d<DATE '2001-10-31'-60) AND (s.country='KR' OR s.coverage IN ('featured','benchmark') OR cap_rank IS NOT NULL)) WHERE place<=15""")
SQL["id_mapping"] = compose("""
SELECT stock_id, ticker, CASE WHEN stock_id%4<>2 THEN company WHEN sic<2500 THEN 'C' || ticker END company, stock_id%4<>2 OR sic<2500 mapped FROM stocks""")
SQL["incr_feed_cursor"] = compose("SELECT max(rcept_no) last_rcept_no, CAST(CAST(arg_max(filed_at, rcept_no) AS DATE) AS VARCHAR) last_rcept_dt FROM disclosures WHERE rcept_no>'00000000000007'")
SQL["refresh_retry"] = compose("""SELECT DISTINCT l.job_type, l.stock_id FROM logs l JOIN (SELECT job_type, max(started_at) s FROM logs WHERE logs.source='REFRESH' AND status='FAILED' GROUP BY 1) x ON x.job_type=l.job_type
WHERE l.source<>'REFRESH' AND l.status='FAILED' AND l.started_at>=x.s AND l.finished_at<=x.s+INTERVAL 1 DAY AND x.s+INTERVAL 1 DAY>TIMESTAMP '2024-01-29 00:00:00'""")

CTES["stopped"] = """
SELECT p.stock_id FROM (SELECT s.stock_id, s.country, max(p.trade_date) last FROM prices p JOIN stocks s ON s.stock_id=p.stock_id GROUP BY 1, 2) p
JOIN (SELECT country, trade_date cut FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY trade_date DESC) rk FROM (
  SELECT DISTINCT s.country, p.trade_date FROM prices p JOIN stocks s ON s.stock_id=p.stock_id WHERE s.is_active AND s.coverage<>'listed' AND p.trade_date>=DATE '2001-11-04'-120)) WHERE rk=21) c
 ON c.country=p.country WHERE p.last<c.cut"""
CTES["choice"] = """
SELECT s.stock_id, s.country, s.company, s.coverage, t.theme, v.market_cap size FROM stocks s JOIN theme t ON t.stock_id=s.stock_id AND t.family<>'none'
LEFT JOIN lv v ON v.stock_id=s.stock_id WHERE s.is_active AND s.stock_id NOT IN (SELECT stock_id FROM stopped)"""
CTES["choice_steps"] = """
SELECT theme, country, greatest(0, 2-count(*) FILTER (WHERE coverage='featured')) quota, row_number() OVER (ORDER BY theme, country) k FROM choice GROUP BY 1, 2"""
CTES["choice_lists"] = """
SELECT s.k, s.theme, s.country, s.quota, list({'id': c.stock_id, 'company': c.company, 'key': c.country || c.company} ORDER BY c.size DESC, c.stock_id) FILTER (WHERE c.stock_id IS NOT NULL) c
FROM choice_steps s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, theme, company ORDER BY size DESC, stock_id) n FROM choice
 WHERE coverage<>'featured' AND size IS NOT NULL AND company IS NOT NULL) WHERE n=1) c ON c.theme=s.theme AND c.country=s.country GROUP BY 1, 2, 3, 4"""
CTES["choice_run"] = """
SELECT CAST(0 AS BIGINT) k, (SELECT coalesce(list(country || company), []) FROM choice WHERE coverage='featured' AND company IS NOT NULL) taken, CAST([] AS STRUCT(id BIGINT, company VARCHAR, key VARCHAR)[]) fresh
UNION ALL SELECT k, list_concat(taken, list_transform(fresh, lambda y: y.key)), fresh FROM (
 SELECT a.k, x.taken, list_slice(list_filter(coalesce(a.c, []), lambda y: NOT list_contains(x.taken, y.key)), 1, a.quota) fresh FROM "choice_run" x JOIN choice_lists a ON a.k=x.k+1)"""
SQL["benchmark_select"] = compose("""
SELECT y.id stock_id, l.country, l.theme, y.company, CAST(n AS INT) place FROM choice_run r JOIN choice_lists l ON l.k=r.k,
 LATERAL (SELECT unnest(r.fresh) y, unnest(range(1, len(r.fresh)+1)) n) u""").replace("WITH ", "WITH RECURSIVE ", 1)

CTES["succ_links"] = """
SELECT l.stock_id old_id, l.new_id FROM (SELECT stock_id, unnest(CASE WHEN stock_id%7=6 THEN [stock_id-1] WHEN stock_id%70=7 THEN [stock_id+1, stock_id+2] WHEN stock_id%7 IN (1,2,3,5) THEN [stock_id+1] END) new_id
 FROM stocks) l JOIN stocks s ON s.stock_id=l.new_id"""
CTES["succ_next"] = "SELECT old_id, min(new_id) new_id FROM succ_links GROUP BY 1 HAVING count(DISTINCT new_id)=1"
CTES["succ_walk"] = """
SELECT old_id id, old_id head, 0 steps FROM succ_next
UNION ALL SELECT w.id, n.new_id, w.steps+1 FROM "succ_walk" w JOIN succ_next n ON n.old_id=w.head WHERE w.steps<20"""
CTES["succ_ids"] = """
SELECT id, CASE WHEN max(steps)=20 THEN id ELSE arg_max(head, steps) END head, CAST(CASE WHEN max(steps)=20 THEN 0 ELSE max(steps) END AS BIGINT) steps, CASE WHEN max(steps)=20 THEN 'cycle' END problem
FROM succ_walk GROUP BY 1 UNION ALL SELECT old_id, old_id, 0, 'fork' FROM succ_links GROUP BY 1 HAVING count(DISTINCT new_id)>1"""
SQL["id_succession"] = compose("SELECT id, head, steps, problem FROM succ_ids").replace("WITH ", "WITH RECURSIVE ", 1)
SQL["fin_succession"] = compose("""
SELECT stock_id, fiscal_year, CAST(period_end AS VARCHAR) period_end, from_id, steps, others, revenue, net_income FROM (
 SELECT head stock_id, fiscal_year, period_end, from_id, steps, revenue, net_income, row_number() OVER (PARTITION BY head, fiscal_year ORDER BY steps, period_end DESC, from_id) k,
  count(*) OVER (PARTITION BY head, fiscal_year)-1 others
 FROM (SELECT coalesce(i.head, f.stock_id) head, CAST(year(f.period_end) AS INT) fiscal_year, f.period_end, f.stock_id from_id, coalesce(i.steps, 0) steps, f.revenue, f.net_income
  FROM statements f LEFT JOIN succ_ids i ON i.id=f.stock_id WHERE NOT (f.stock_id%7 IN (2,3,4) AND year(f.period_end)<1996))) WHERE k=1""").replace("WITH ", "WITH RECURSIVE ", 1)
