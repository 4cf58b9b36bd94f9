"""DuckDB text of the same market tables, used only to check the Spark results."""
from __future__ import annotations

import re

from bourseflow import constants as K

CTES: dict[str, str] = {}


def r(expr: str, places: int) -> str:
    """Half-up rounding through an exact decimal, as the Spark side rounds doubles by their decimal text."""
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(38,10)), {places}) AS DOUBLE)"


def rd(expr: str, places: int) -> str:
    """The same for large amounts that have at most four digits after the point."""
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(38,4)), {places}) AS DOUBLE)"


CTES["markets"] = """
SELECT CAST(r_regionkey AS INT) market_id, r_name market, CASE WHEN r_regionkey<2 THEN 'KR' ELSE 'US' END country,
 CASE WHEN r_regionkey<2 THEN 'KRW' ELSE 'USD' END currency,
 CASE WHEN r_regionkey<2 THEN 'Asia/Seoul' ELSE 'America/New_York' END timezone FROM region"""
CTES["groups"] = """
SELECT CAST(n_nationkey AS INT) group_id, n_name theme, 'SECTOR-' || (n_nationkey % 7) sector,
 CASE WHEN n_nationkey=24 THEN 'none' WHEN n_nationkey%5=4 THEN 'financial' ELSE 'general' END family,
 n_nationkey % 6 = 2 commodity_linked FROM nation"""
CTES["stocks"] = """
SELECT s_suppkey stock_id, m.market_id, m.market, m.country, m.currency, m.timezone, lpad(CAST(s_suppkey AS VARCHAR),6,'0') ticker,
 s_name name, upper(s_name) name_en,
 CASE WHEN (s_suppkey//5)%10=0 THEN 'listed' WHEN (s_suppkey//5)%10<=5 THEN 'benchmark' ELSE 'featured' END coverage,
 s_suppkey%37<>36 is_active, lpad(CAST(CASE WHEN s_suppkey%11=10 THEN s_suppkey-5 ELSE s_suppkey END AS VARCHAR),8,'0') company,
 CASE WHEN s_suppkey%5>=2 AND s_suppkey%13=5 THEN 2 END share_ratio, 100+s_suppkey%50*20 shares,
 g.group_id, g.sector, lpad(CAST(s_nationkey*400+s_suppkey%400 AS VARCHAR),5,'0') ksic, 1000+s_nationkey*100+s_suppkey%100 sic, s_acctbal
FROM supplier JOIN markets m ON m.market_id = s_suppkey%5
LEFT JOIN groups g ON g.group_id = CASE WHEN s_suppkey%29<>28 THEN s_nationkey END"""
CTES["members"] = """
SELECT group_id, stock_id, true is_primary FROM stocks WHERE group_id IS NOT NULL
UNION ALL SELECT (group_id+1+stock_id%3)%25, stock_id, false FROM stocks WHERE group_id IS NOT NULL AND stock_id%4=1"""
CTES["theme"] = """
SELECT m.stock_id, g.group_id, g.theme, g.sector, g.family, g.commodity_linked FROM members m JOIN groups g ON g.group_id=m.group_id
WHERE m.is_primary"""
CTES["presets"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {K.PRESET_ORDER[c]}, {str(c == K.DEFAULT_PRESET).lower()}, '{f}', CAST({w} AS DOUBLE))"
    for c, ws in K.PRESETS.items() for f, w in zip(K.FACTORS, ws)) + ") AS t(preset, sort_order, is_default, factor, weight)"
CTES["trades"] = """
SELECT l_suppkey stock_id, l_orderkey order_id, l_linenumber line, CAST(l_shipdate AS DATE) trade_date,
 CAST(round(l_extendedprice*100) AS BIGINT) cents, CAST(l_quantity AS BIGINT) qty, CAST(l_extendedprice AS DECIMAL(12,2)) ext,
 CAST(l_discount AS DECIMAL(3,2)) disc, CAST(l_tax AS DECIMAL(3,2)) tax, l_returnflag flag,
 (CAST(round(l_extendedprice*100) AS BIGINT)*200 + CAST(l_quantity AS BIGINT)) // (2*CAST(l_quantity AS BIGINT)) px
FROM lineitem"""
CTES["prices"] = """
SELECT stock_id, trade_date, CAST(min(CAST(order_id*8+line AS HUGEINT)*100000000000+px) % 100000000000 AS BIGINT)/10000.0 AS open,
 max(px)/10000.0 high, min(px)/10000.0 low,
 CAST(max(CAST(order_id*8+line AS HUGEINT)*100000000000+px) % 100000000000 AS BIGINT)/10000.0 AS close,
 CAST(max(CAST(order_id*8+line AS HUGEINT)*100000000000+px) % 100000000000 AS BIGINT) AS close4,
 CAST(sum(qty) AS BIGINT) volume
FROM trades GROUP BY 1, 2"""
CTES["index_prices"] = f"""
SELECT s.market_id index_id, p.trade_date, {r("(sum(p.close4)/10000.0)/count(*)", 4)} AS close
FROM prices p JOIN stocks s ON s.stock_id=p.stock_id GROUP BY 1, 2"""
CTES["indices"] = """SELECT market_id index_id, 'IX-' || market code, market, country, currency, market_id display_order FROM markets"""


def _accounts(period: str, sums: str, type_: str) -> str:
    return f"""
SELECT stock_id, {period} period_end, CAST(CAST(ext - dsc AS DECIMAL(24,2)) AS DOUBLE) revenue,
 CAST(CAST(oi AS DECIMAL(24,2)) AS DOUBLE) operating_income, CAST(ni AS DOUBLE) net_income, CAST(assets AS DOUBLE) total_assets,
 CAST(assets - debt AS DOUBLE) total_equity, CAST(debt AS DOUBLE) total_debt, {type_} period_type
FROM (SELECT *, CAST(oi*CAST(0.8 AS DECIMAL(2,1)) + tx*CAST(0.5 AS DECIMAL(2,1)) - ext*CAST(0.018 AS DECIMAL(4,3)) AS DECIMAL(24,2)) ni,
  CAST(ext*CAST(1.4 AS DECIMAL(2,1)) + 50000 AS DECIMAL(24,2)) assets,
  CAST(ext*CAST(3+stock_id%13 AS DECIMAL(3,0))*CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(24,2)) debt
 FROM (SELECT *, CAST(ext*CAST(0.053 AS DECIMAL(4,3)) - dsc AS DECIMAL(24,5)) oi
  FROM (SELECT stock_id, {sums}, CAST(sum(ext) AS DECIMAL(20,2)) ext, CAST(sum(ext*disc) AS DECIMAL(22,4)) dsc,
   CAST(sum(ext*tax) AS DECIMAL(22,4)) tx FROM trades GROUP BY 1, 2)))"""


CTES["statements"] = _accounts("make_date(fy, 12, 31)", "CAST(year(trade_date) AS INT) fy", "'FY'")
CTES["quarters"] = _accounts("q_end", "last_day(CAST(date_trunc('quarter', trade_date) AS DATE) + INTERVAL 2 MONTH) q_end",
                             "'Q' || quarter(q_end)")
CTES["valuations"] = f"""
SELECT l.stock_id, l.as_of, CASE WHEN f.net_income>0 THEN {r("l.close/(f.net_income/s.shares)", 4)} END per,
 CASE WHEN f.total_equity>0 THEN {r("l.close/(f.total_equity/s.shares)", 4)} END pbr,
 {r("f.net_income/s.shares", 4)} eps, {r("f.total_equity/s.shares", 4)} bps, {r("l.close*s.shares", 0)} market_cap,
 s.shares shares_outstanding, CASE WHEN l.stock_id%3=0 THEN {r("l.close*0.01", 4)} END dps, 'DERIVED' AS source
FROM (SELECT stock_id, year(trade_date) yr, max(trade_date) as_of, arg_max(close, trade_date) AS close FROM prices GROUP BY 1,2) l
JOIN stocks s ON s.stock_id=l.stock_id
LEFT JOIN statements f ON f.stock_id=l.stock_id AND year(f.period_end)+1=l.yr"""
CTES["fx"] = """
SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) rate_at, (125000+CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT)%10000)/100.0 usd_krw,
 'DAILY' granularity FROM orders GROUP BY CAST(o_orderdate AS DATE)
UNION ALL SELECT ts, (125000+event_id*37%10000)/100.0, 'SNAPSHOT' FROM events WHERE event_type='purchase'"""
CTES["fx_latest"] = """
SELECT rate_at, usd_krw, granularity FROM fx ORDER BY rate_at DESC, (granularity='SNAPSHOT') DESC LIMIT 1"""
CTES["disclosures"] = """
SELECT lpad(CAST(o_orderkey AS VARCHAR),14,'0') rcept_no, o_custkey % ((SELECT max(s_suppkey) FROM supplier)+1) stock_id,
 CASE left(o_orderpriority,1) WHEN '1' THEN '[첨부추가]사업보고서' WHEN '2' THEN '사업보고서' ELSE '분기보고서' END title,
 CASE left(o_orderpriority,1) WHEN '1' THEN '10-K' WHEN '2' THEN '정기공시' WHEN '3' THEN '10-Q' ELSE '8-K' END report_type,
 o_orderdate filed_at, CASE o_orderstatus WHEN 'O' THEN 'DART' WHEN 'F' THEN 'SEC' ELSE 'KIND' END data_source FROM orders"""
CTES["items"] = """
SELECT *, CAST((CAST(quantity AS HUGEINT)*ref_price4*fx0 + 50)//100 AS DOUBLE)/100.0 cost_krw,
 ref_price4/10000.0 ref_price, CAST(fx0 AS DOUBLE) ref_fx_rate
FROM (SELECT a.portfolio_id, a.stock_id, a.quantity, a.ref_date, (a.cents*200+a.quantity)//(2*a.quantity) ref_price4,
  CASE WHEN s.currency='USD' THEN 1200+a.portfolio_id%200 ELSE 1 END fx0
 FROM (SELECT o_custkey portfolio_id, t.stock_id, CAST(sum(t.qty) AS BIGINT) quantity, CAST(sum(t.cents) AS BIGINT) cents,
   min(CAST(o_orderdate AS DATE)) ref_date FROM trades t JOIN orders ON o_orderkey=t.order_id GROUP BY 1,2) a
 JOIN stocks s ON s.stock_id=a.stock_id)"""
CTES["portfolios"] = """
SELECT c_custkey portfolio_id, c_custkey user_id, c_name name, CAST(CAST(c_acctbal AS DECIMAL(12,2))*200000+2000000000 AS DOUBLE) seed_krw
FROM customer"""
CTES["users"] = f"""
SELECT c_custkey user_id, CASE WHEN c_mktsegment='HOUSEHOLD' THEN '{K.GUEST_PREFIX}' || c_name ELSE c_name END nickname,
 CASE WHEN c_mktsegment<>'HOUSEHOLD' THEN c_name || '@example.org' END email, o.last_seen_at
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) last_seen_at FROM orders GROUP BY 1) o ON o.o_custkey=c_custkey"""
CTES["watchlist"] = """
SELECT o_custkey user_id, t.stock_id, min(CAST(o_orderdate AS DATE)) added_at, max(t.px)/10000.0 target_price,
 CAST(t.stock_id%7 AS INT) sort_order FROM trades t JOIN orders ON o_orderkey=t.order_id WHERE t.flag='R' GROUP BY 1,2"""
CTES["logs"] = """
SELECT event_id log_id, upper(event_type) job_type, CASE user_id%3 WHEN 0 THEN 'REFRESH' WHEN 1 THEN 'DART' ELSE 'SEC' END AS source,
 status, user_id stock_id, ts started_at, ts + INTERVAL 30 SECOND finished_at,
 CASE WHEN status<>'FAILED' THEN CASE WHEN user_id%4=1 THEN '격리 ' || k || '행 {}' END
  WHEN user_id%2=0 THEN 'PARTIAL ' || k || chr(10) || 'second line' ELSE 'timeout ' || k END error
FROM (SELECT *, CASE WHEN user_id%5=0 THEN 'FAILED' WHEN user_id%7=1 THEN 'SKIPPED' ELSE 'SUCCESS' END status,
 json_extract_string(props, '$.k') k FROM events)"""


def compose(final: str, extra: dict[str, str] | None = None) -> str:
    """Prefix the query with every table it mentions, in dependency order."""
    pool = {**CTES, **(extra or {})}
    done: list[str] = []

    def visit(text: str) -> None:
        for name in pool:
            if name not in done and re.search(rf"(?:FROM|JOIN)\s+{name}\b(?!\s*\()", text):
                visit(pool[name])
                if name not in done:
                    done.append(name)

    visit(final)
    body = ",\n".join(f"{n} AS ({pool[n]})" for n in done)
    return f"WITH {body}\n{final}" if body else final
