"""SQL for valuations and statement builders."""
from __future__ import annotations

from bourseflow import constants as K
from bourseflow.accounts import BALANCE_ACCOUNTS, CONCEPTS, CORE_ACCOUNTS, DIVIDEND_CONCEPTS, FLOW_ACCOUNTS, LINE_ACCOUNTS, MONEY_ACCOUNTS, STATEMENT_LINES
from bourseflow.sources import sample_filings as sf
from oracle.ctes import CTES, compose, r
from oracle import ingest as _ingest  # noqa: F401

SQL: dict[str, str] = {}


def duck(text: str) -> str:
    return (text.replace(" AS end,", ' AS "end",').replace("AS STRING", "AS VARCHAR"))


def lit(v):
    return str(v).lower() if isinstance(v, bool) else (f"'{v}'" if isinstance(v, str) else repr(v))


def values(rows) -> str:
    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


CTES["facts"] = duck(sf.facts_sql("statements", "quarters"))
CTES["shr"] = duck(sf.shares_sql("statements"))
CTES["lines"] = duck(sf.lines_sql("statements"))
CTES["asofy"] = """SELECT p.stock_id, p.trade_date, p.close, f.period_end, f.net_income ni, f.total_equity eq FROM prices p
ASOF JOIN statements f ON f.stock_id=p.stock_id AND f.period_end+90<=p.trade_date"""
CTES["asofy"] = """SELECT * FROM (SELECT p.stock_id, p.trade_date, p.close, f.period_end, f.net_income ni, f.total_equity eq,
 row_number() OVER (PARTITION BY p.stock_id, p.trade_date ORDER BY f.period_end DESC) k FROM prices p JOIN statements f ON f.stock_id=p.stock_id AND f.period_end<=p.trade_date-90) WHERE k=1"""
SQL["j_asof_fy_lag"] = compose("SELECT stock_id, CAST(trade_date AS VARCHAR) trade_date, CAST(period_end AS VARCHAR) period_end, ni FROM asofy")
per = lambda close, ni, eq, sh: (f"{r(f'CASE WHEN {ni}>0 THEN {close}/({ni}/{sh}) END', 4)} per, {r(f'CASE WHEN {eq}>0 THEN {close}/({eq}/{sh}) END', 4)} pbr, "
                                 f"{r(f'{ni}/{sh}', 4)} eps, {r(f'{eq}/{sh}', 4)} bps, {r(f'{close}*{sh}', 0)} market_cap")
SQL["valuation_derived_kr"] = compose(f"""SELECT a.stock_id, CAST(trade_date AS VARCHAR) as_of, {per("a.close", "ni", "eq", "s.shares")} FROM asofy a
JOIN stocks s ON s.stock_id=a.stock_id AND s.country='KR' WHERE trade_date>=DATE '2000-10-31'""")
SQL["valuation_derived_us"] = compose(f"""SELECT l.stock_id, CAST(l.trade_date AS VARCHAR) as_of, {per("l.close", "f.net_income", "f.total_equity", "(s.shares/coalesce(s.share_ratio,1))")},
 {r("s.shares/coalesce(s.share_ratio,1)", 0)} shares_outstanding, {r("CASE WHEN s.stock_id%3=0 THEN 1.25*coalesce(s.share_ratio,1) END", 4)} dps
FROM lp l JOIN stocks s ON s.stock_id=l.stock_id AND s.country='US' LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY period_end DESC) k FROM statements) f ON f.stock_id=l.stock_id AND f.k=1""")
SQL["valuation_zero_null"] = compose("""SELECT stock_id, CAST(as_of AS VARCHAR) as_of, CASE WHEN per>0 THEN per END per, CASE WHEN pbr>0 THEN pbr END pbr, nullif(eps,0) eps, nullif(bps,0) bps,
 CASE WHEN pbr IS NOT NULL THEN market_cap END market_cap, CASE WHEN pbr IS NOT NULL THEN shares_outstanding END shares_outstanding, coalesce(dps,0.0) dps FROM valuations""")
SQL["valuation_from_close"] = compose(f"""SELECT p.stock_id, CAST(p.trade_date AS VARCHAR) as_of, {r("CASE WHEN v.eps>0 THEN p.close/v.eps END", 2)} per, {r("CASE WHEN v.bps>0 THEN p.close/v.bps END", 2)} pbr,
 CAST(p.close4*v.shares_outstanding/10000.0 AS DOUBLE) market_cap FROM prices p JOIN lv v ON v.stock_id=p.stock_id""")
SQL["dps_carry_forward"] = compose("""SELECT stock_id, CAST(as_of AS VARCHAR) as_of, coalesce(d, last_value(d IGNORE NULLS) OVER (PARTITION BY stock_id ORDER BY as_of)) dps FROM (
 SELECT stock_id, as_of, CASE WHEN year(as_of)%3=1 THEN dps END d FROM valuations)""")


def _rate(days: str) -> str:
    return f"""SELECT day, rate, rate_day FROM (SELECT d.day, f.usd_krw rate, f.date rate_day, row_number() OVER (PARTITION BY d.day ORDER BY f.date DESC) k FROM ({days}) d
 JOIN fxd f ON f.date<=d.day AND f.date>=d.day-10) WHERE k=1"""


CTES["fxdays"] = "SELECT DISTINCT trade_date+6 AS day FROM prices UNION SELECT date FROM fxd"
SQL["j_asof_fx"] = compose("SELECT CAST(day AS VARCHAR) AS day, rate, CAST(rate_day AS VARCHAR) rate_day FROM (" + _rate("SELECT day FROM fxdays") + ")")
def won(c: str) -> str:
    x = f"CAST(round({c}*100) AS HUGEINT)*CASE WHEN cur='USD' THEN CAST(round(rate*100) AS BIGINT) ELSE 100 END"
    return f"CASE WHEN problem IS NULL THEN CAST(sign({c})*((abs({x})*2+100)//200) AS DOUBLE)/100.0 END {c}"


SQL["fin_currency"] = compose(f"""SELECT stock_id, CAST(period_end AS VARCHAR) period_end, cur currency, CASE WHEN cur='USD' THEN rate END fx_rate, problem,
 {', '.join(won(c) for c in CORE_ACCOUNTS)} FROM (
 SELECT *, CASE WHEN cur='JPY' THEN 'currency' WHEN cur='USD' AND rate IS NULL THEN 'no rate' END problem FROM (
  SELECT s.*, CASE WHEN stock_id%4=1 THEN 'USD' WHEN stock_id%4=2 AND year(period_end)=1997 THEN 'JPY' ELSE 'KRW' END cur, x.rate FROM statements s LEFT JOIN ({_rate("SELECT DISTINCT period_end AS day FROM statements")}) x ON x.day=s.period_end))""")
CTES["mp"] = """SELECT * REPLACE (CASE WHEN stock_id%3<>0 THEN net_income END AS net_income, CASE WHEN year(period_end)%2=0 THEN total_equity END AS total_equity) FROM statements WHERE operating_income>=0"""
CTES["ms"] = """SELECT * REPLACE (period_end - CAST(stock_id%9 AS INT) AS period_end, CASE WHEN stock_id%7=1 THEN revenue*2 ELSE revenue END AS revenue, CASE WHEN stock_id%5=0 THEN 0.0 ELSE total_equity END AS total_equity) FROM statements"""
sup = lambda c: f"nullif(s.{c}, 0.0)" if c == "total_equity" else f"s.{c}"
SQL["fin_merge_supplement"] = compose(f"""
SELECT p.stock_id, CAST(p.period_end AS VARCHAR) period_end, {', '.join(f"coalesce(p.{c}, {sup(c)}) {c}" for c in CORE_ACCOUNTS)},
 concat_ws(',', {', '.join(f"CASE WHEN p.{c} IS NULL AND {sup(c)} IS NOT NULL THEN '{c}' END" for c in CORE_ACCOUNTS)}) filled, coalesce(abs(p.revenue/nullif(s.revenue,0)-1)>0.02, false) revenue_gap, 'primary' path
FROM mp p LEFT JOIN ms s ON s.stock_id=p.stock_id AND abs(p.period_end-s.period_end)<=7
UNION ALL SELECT s.stock_id, CAST(s.period_end AS VARCHAR), {', '.join('s.' + c for c in CORE_ACCOUNTS)}, '', false, 'supplement' FROM ms s
WHERE NOT EXISTS (SELECT 1 FROM mp p WHERE s.stock_id=p.stock_id AND abs(p.period_end-s.period_end)<=7)""")
SQL["fin_zero_equity"] = compose("""SELECT stock_id, CAST(period_end AS VARCHAR) period_end, total_assets, d total_debt, CASE WHEN e=0 THEN CAST(nullif(CAST(total_assets AS DECIMAL(24,2))-CAST(d AS DECIMAL(24,2)),0) AS DOUBLE) ELSE e END total_equity,
 CASE WHEN e=0 THEN CASE WHEN total_assets-d<>0 THEN 'assets - debt' ELSE 'blank' END END equity_note
FROM (SELECT *, CASE WHEN stock_id%5<>1 THEN total_debt END d, CASE WHEN stock_id%3=0 THEN 0.0 ELSE total_equity END e FROM statements)""")
CTES["cmap"] = f"SELECT * FROM (VALUES {values([(c, a, i, d) for a, (cs, d) in CONCEPTS.items() for i, c in enumerate(cs)])}) v(concept, account, priority, duration)"


def _accounts(forms) -> str:
    return f"""SELECT * FROM (SELECT f.*, m.account, m.priority, m.duration, row_number() OVER (PARTITION BY company, account, f.start, f."end" ORDER BY priority) k, min(ff) OVER (PARTITION BY company, account, f.start, f."end") first_filed FROM (
 SELECT company, concept, f.start, f."end", arg_max(value, filed) AS value, min(filed) ff FROM facts f WHERE form IN ({', '.join(repr(x) for x in forms)}) GROUP BY 1,2,3,4) f
 JOIN cmap m ON m.concept=f.concept WHERE m.duration=(f.start IS NOT NULL) AND NOT (account='total_equity' AND value=0)) WHERE k=1"""


CTES["acc1"] = _accounts(K.ANNUAL_FORMS)
CTES["acc2"] = f"""SELECT company, "end" period_end, {', '.join(f"max(value) FILTER (WHERE account='{a}') {a}" for a in CONCEPTS)}, bool_or(account IN ('revenue','net_income')) is_year,
 min(first_filed) FILTER (WHERE account IN ('revenue','net_income')) filed_at,
 coalesce(string_agg(account, ',' ORDER BY account) FILTER (WHERE priority>0 AND account IN ({', '.join(repr(c) for c in CORE_ACCOUNTS)})), '') substitutes
FROM acc1 f WHERE NOT duration OR "end"-f.start BETWEEN 350 AND 380 GROUP BY 1,2"""
CTES["acc3"] = """SELECT company, period_end, revenue, coalesce(operating_income, pretax+coalesce(interest_expense,0)) operating_income, net_income, total_assets, total_equity,
 coalesce(total_debt, liabilities_and_equity-coalesce(equity_with_nci,total_equity)) total_debt, coalesce(intangibles_total, CASE WHEN intangibles_other IS NOT NULL OR goodwill IS NOT NULL THEN coalesce(intangibles_other,0)+coalesce(goodwill,0) END) intangibles,
 CASE WHEN lt IS NOT NULL OR short_debt IS NOT NULL THEN coalesce(lt,0)+coalesce(short_debt,0) END borrowings, filed_at, substitutes,
 operating_cf, comprehensive_income, equity_method_income, interest_expense, nci_net_income, cash, goodwill,
 concat_ws(',', CASE WHEN operating_income IS NULL AND pretax IS NOT NULL THEN 'operating_income' END, CASE WHEN total_debt IS NULL AND liabilities_and_equity IS NOT NULL AND coalesce(equity_with_nci,total_equity) IS NOT NULL THEN 'total_debt' END) derived
FROM (SELECT *, coalesce(ltd_total, CASE WHEN ltd_noncurrent IS NOT NULL OR ltd_current IS NOT NULL THEN coalesce(ltd_noncurrent,0)+coalesce(ltd_current,0) END) lt,
 row_number() OVER (PARTITION BY company ORDER BY period_end DESC) k FROM acc2 WHERE is_year) WHERE k<=5"""
SQL["fin_concept_priority"] = compose("SELECT company, CAST(period_end AS VARCHAR) period_end, CAST(filed_at AS VARCHAR) filed_at, substitutes, derived, "
 + ", ".join(f"CAST({c} AS DOUBLE) {c}" for c in MONEY_ACCOUNTS) + " FROM acc3")
SQL["fin_derive_missing"] = compose("SELECT company, CAST(period_end AS VARCHAR) period_end, CAST(operating_income AS DOUBLE) operating_income, CAST(total_debt AS DOUBLE) total_debt, derived FROM acc3 WHERE derived<>''")
CTES["qacc"] = _accounts(K.QUARTER_FORMS)
CTES["qspan"] = """SELECT company, fy_end, CASE WHEN fy_end-p BETWEEN 350 AND 380 THEN p+1 ELSE fy_end-364 END fy_start FROM (SELECT company, fy_end, lag(fy_end) OVER (PARTITION BY company ORDER BY fy_end) p FROM (
 SELECT DISTINCT company, "end" fy_end FROM qacc f WHERE duration AND account IN ('revenue','net_income') AND "end"-f.start BETWEEN 350 AND 380))"""
flows = ", ".join(repr(a) for a in FLOW_ACCOUNTS)
CTES["qcell"] = f"""SELECT x.*, CASE WHEN e=fy_end THEN 4 ELSE least(3, greatest(1, CAST(round((e-fy_start)/91.3) AS INT))) END k FROM (
 SELECT f.company, f.account, f.start st, f."end" e, f.value, s.fy_start, s.fy_end, CASE WHEN f."end"-f.start BETWEEN 350 AND 380 THEN 'year' WHEN f."end"-f.start BETWEEN 85 AND 100 THEN 'three' WHEN f."end"-f.start>=150 AND f."end"-f.start<350 THEN 'ytd' END kind
 FROM qacc f JOIN qspan s ON s.company=f.company AND f."end">s.fy_start AND f."end"<=s.fy_end WHERE f.duration AND account IN ({flows})) x
WHERE kind IS NOT NULL AND (kind<>'ytd' OR abs(st-fy_start)<=7) AND (e=fy_end OR e<fy_end-20)"""
cell = lambda kd, k: f"max(value) FILTER (WHERE kind='{kd}' AND k={k})"
CTES["qwide"] = f"""SELECT company, fy_end, account, {', '.join(f"{cell('three', i)} q{i}" for i in (1, 2, 3, 4))}, {cell('ytd', 2)} y2, {cell('ytd', 3)} y3, {cell('year', 4)} y4 FROM qcell GROUP BY 1,2,3"""
CTES["qhave"] = f"""SELECT company, fy_end, {', '.join(f"max(e) FILTER (WHERE k={i}) h{i}" for i in (1, 2, 3))} FROM qcell WHERE account IN ('revenue','net_income') GROUP BY 1,2"""
CTES["qchain"] = """SELECT w.*, h.h1, h.h2, h.h3, CASE WHEN h1 IS NOT NULL THEN q1 END p2, coalesce(y2, CASE WHEN h1 IS NOT NULL THEN q1 END+q2) c2,
 coalesce(y3, CASE WHEN h2 IS NOT NULL THEN coalesce(y2, CASE WHEN h1 IS NOT NULL THEN q1 END+q2) END+q3) c3 FROM qwide w JOIN qhave h ON h.company=w.company AND h.fy_end=w.fy_end"""
CTES["qlong"] = """SELECT company, account, 1 k, h1 period_end, q1 v FROM qchain UNION ALL SELECT company, account, 2, h2, coalesce(q2, y2-p2) FROM qchain
UNION ALL SELECT company, account, 3, h3, coalesce(q3, y3-CASE WHEN h2 IS NOT NULL THEN c2 END) FROM qchain UNION ALL SELECT company, account, 4, fy_end, coalesce(y4-CASE WHEN h3 IS NOT NULL THEN c3 END, q4) FROM qchain"""
CTES["qheld"] = f"""SELECT company, "end" d, {', '.join(f"{r(f'max(value) FILTER (WHERE account={a!r})', 2)} {a}" for a in BALANCE_ACCOUNTS)} FROM qacc f WHERE NOT duration GROUP BY 1,2"""
SQL["fin_quarters"] = compose(f"""SELECT q.* REPLACE (CAST(q.period_end AS VARCHAR) AS period_end), {', '.join('h.' + a for a in BALANCE_ACCOUNTS)} FROM (
 SELECT company, period_end, k, {', '.join(f"{r(f'max(v) FILTER (WHERE account={a!r})', 2)} {a}" for a in FLOW_ACCOUNTS)}
 FROM qlong WHERE period_end IS NOT NULL GROUP BY 1,2,3) q LEFT JOIN qheld h ON h.company=q.company AND h.d=q.period_end WHERE {' OR '.join(f"q.{a} IS NOT NULL" for a in FLOW_ACCOUNTS)}""")
SQL["shares_latest"] = compose("""SELECT company, CAST(arg_max(v, e) AS BIGINT) shares, CAST(max(e) AS VARCHAR) as_of FROM (SELECT company, e, max(v) v FROM (
 SELECT company, s."end" e, accn, sum(value) v FROM shr s GROUP BY 1,2,3) GROUP BY 1,2) GROUP BY 1""")
CTES["lmap"] = "SELECT * FROM (VALUES " + values(
    [(a, s, "id", x, i) for a, (sts, ids, _) in STATEMENT_LINES.items() for s in sts for i, x in enumerate(ids)]
    + [(a, s, "name", x, 100 + i) for a, (sts, _, names) in STATEMENT_LINES.items() for s in sts for i, x in enumerate(names)]) + ") v(account, statement, kind, label, priority)"
CTES["lacc"] = r"""SELECT * FROM (SELECT l.company, l.period_end, l.consolidated, l.amount, l.prior_amount, m.account, row_number() OVER (PARTITION BY l.company, l.period_end, m.account
  ORDER BY m.priority, CASE l.statement WHEN 'BS' THEN 0 WHEN 'IS' THEN 1 WHEN 'CIS' THEN 2 ELSE 3 END, l.line_no) k
 FROM (SELECT *, bool_or(consolidated) OVER (PARTITION BY company, period_end) hc, regexp_replace(regexp_replace(account_nm, '^[\sⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩIVX\d\.\-]+', ''), '\s+', '', 'g') nm FROM lines) l
 JOIN lmap m ON m.statement=l.statement AND ((m.kind='id' AND m.label=l.account_id) OR (m.kind='name' AND m.label=l.nm)) WHERE l.consolidated=l.hc AND l.amount IS NOT NULL) WHERE k=1"""
CTES["lwide"] = f"""SELECT company, period_end, bool_or(consolidated) consolidated, {', '.join(f"max(amount) FILTER (WHERE account='{c}') {c}, max(prior_amount) FILTER (WHERE account='{c}') p_{c}" for c in LINE_ACCOUNTS)}
FROM lacc GROUP BY 1,2"""
nx = lambda c: f"n.p_{c}"
SQL["fin_account_map"] = compose(f"""
SELECT a.company, CAST(a.period_end AS VARCHAR) period_end, a.consolidated, {', '.join(f"{r(f'coalesce(a.{c}, {nx(c)})', 2)} {c}" for c in LINE_ACCOUNTS)},
 concat_ws(',', {', '.join(f"CASE WHEN a.{c} IS NULL AND {nx(c)} IS NOT NULL THEN '{c}' END" for c in LINE_ACCOUNTS)}) filled
FROM lwide a LEFT JOIN lwide n ON n.company=a.company AND n.period_end=CAST(a.period_end+INTERVAL 1 YEAR AS DATE) AND n.consolidated=a.consolidated
UNION ALL SELECT b.company, CAST(CAST(b.period_end-INTERVAL 1 YEAR AS DATE) AS VARCHAR), b.consolidated, {', '.join(r(f'b.p_{c}', 2) for c in LINE_ACCOUNTS)}, 'all' FROM lwide b
WHERE NOT EXISTS (SELECT 1 FROM lwide x WHERE x.company=b.company AND x.period_end=CAST(b.period_end-INTERVAL 1 YEAR AS DATE)) AND b.period_end>(SELECT min(period_end) FROM lwide x WHERE x.company=b.company)""")
C0, C1 = DIVIDEND_CONCEPTS
SQL["dps_annual"] = compose(f"""
SELECT company, {r("dps", 4)} dps, CAST(e AS VARCHAR) period_end FROM (
 SELECT company, arg_max(value, f."end") dps, max(f."end") e FROM facts f WHERE concept='{C0}' AND form='10-K' AND f."end"-f.start BETWEEN 350 AND 380 GROUP BY 1
 UNION ALL SELECT company, sum(value), max(e) FROM (SELECT company, f.start st, f."end" e, value, row_number() OVER (PARTITION BY company ORDER BY f."end" DESC) k FROM facts f WHERE concept='{C1}') WHERE k<=4
 GROUP BY 1 HAVING count(*)=4 AND max(e)-min(st) BETWEEN 350 AND 380 AND DATE '2001-11-30'-max(e)<=400)""")
