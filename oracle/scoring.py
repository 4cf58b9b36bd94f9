"""SQL for the scoring model and the queries on its results."""
from __future__ import annotations

from bourseflow import constants as K
from bourseflow.plans.score_run import ACTIONS
from oracle.ctes import CTES, compose, r
from oracle import prices as _prices  # noqa: F401 - registers the price tables


def horner(x: str, coefs) -> str:
    out = f"({coefs[0]!r})"
    for c in coefs[1:]:
        out = f"({out}*{x}+({c!r}))"
    return out


def case_metric(position: int) -> str:
    def lit(v):
        return str(v).lower() if isinstance(v, bool) else str(v)
    return "CASE metric " + " ".join(f"WHEN '{m}' THEN {lit(spec[position])}" for m, spec in K.METRICS.items()) + " END"


LOW = K.QUANTILE_LOW
QUANTILE = (f"CASE WHEN p<{LOW} THEN {horner('q', K.QUANTILE_C)}/({horner('q', K.QUANTILE_D)}*q+1.0) "
            f"WHEN p>1.0-{LOW} THEN -({horner('q', K.QUANTILE_C)}/({horner('q', K.QUANTILE_D)}*q+1.0)) "
            f"ELSE {horner('rr', K.QUANTILE_A)}*cc/({horner('rr', K.QUANTILE_B)}*rr+1.0) END")

CTES["lastday"] = "SELECT max(trade_date) d FROM prices"
CTES["snaps"] = "SELECT CAST(d - to_months(m) AS DATE) snapshot FROM lastday, (VALUES (16), (10), (0)) v(m)"
CTES["actions"] = ("SELECT ticker, country, CAST(done AS DATE) done FROM (VALUES "
                   + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in ACTIONS) + ") v(ticker, country, done)")
CTES["smembers"] = """
SELECT s.stock_id, s.ticker, s.country, s.coverage, t.group_id, coalesce(t.family,'general') family FROM stocks s
LEFT JOIN theme t ON t.stock_id=s.stock_id WHERE s.is_active AND coalesce(t.family,'general')<>'none'"""
CTES["snb"] = """
SELECT p.stock_id, p.trade_date, p.close, n.snapshot, row_number() OVER w rn, lead(p.close) OVER w prev
FROM prices p JOIN snaps n ON p.trade_date<=n.snapshot WINDOW w AS (PARTITION BY p.stock_id, n.snapshot ORDER BY p.trade_date DESC)"""
CTES["spx"] = f"""
SELECT stock_id, snapshot, max(trade_date) price_date, max(CASE WHEN rn=1 THEN close END) AS close,
 CASE WHEN count(close/prev) FILTER (WHERE rn<=252)=252 THEN {r("stddev_samp(close/prev-1) FILTER (WHERE rn<=252)*sqrt(252.0)", 6)} END vol,
 max(CASE WHEN rn=22 THEN close END) c_21, max(CASE WHEN rn=127 THEN close END) c_126, max(CASE WHEN rn=253 THEN close END) c_252
FROM snb GROUP BY 1,2"""
CTES["sval"] = """
SELECT * FROM (SELECT v.*, n.snapshot, row_number() OVER (PARTITION BY v.stock_id, n.snapshot ORDER BY v.as_of DESC) k
 FROM valuations v JOIN snaps n ON v.as_of<=n.snapshot) x WHERE k=1"""
CTES["sfy"] = """
SELECT f.*, n.snapshot FROM statements f JOIN snaps n ON f.period_end<=n.snapshot"""
CTES["st0"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stock_id, snapshot ORDER BY period_end DESC) k FROM sfy) x WHERE k=1"
CTES["st1"] = """SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY f.stock_id, f.snapshot ORDER BY f.period_end DESC) k FROM sfy f
 JOIN st0 t ON t.stock_id=f.stock_id AND t.snapshot=f.snapshot AND t.period_end-f.period_end BETWEEN 330 AND 400) x WHERE k=1"""
CTES["st2"] = """SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY f.stock_id, f.snapshot ORDER BY f.period_end DESC) k FROM sfy f
 JOIN st1 t ON t.stock_id=f.stock_id AND t.snapshot=f.snapshot AND t.period_end-f.period_end BETWEEN 330 AND 400) x WHERE k=1"""
CTES["schain"] = """
SELECT a.stock_id, a.snapshot, a.period_end end0, a.revenue rev0, a.operating_income oi0, a.net_income ni0, a.total_assets ta0, a.total_debt debt0, a.total_equity eq0,
 b.period_end end1, b.operating_income oi1, b.net_income ni1, b.revenue rev1, b.total_assets ta1, b.total_debt debt1, b.total_equity eq1,
 c.period_end end2, c.revenue rev2, c.operating_income oi2, c.net_income ni2, c.total_assets ta2, c.total_debt debt2, c.total_equity eq2
FROM st0 a LEFT JOIN st1 b ON b.stock_id=a.stock_id AND b.snapshot=a.snapshot LEFT JOIN st2 c ON c.stock_id=a.stock_id AND c.snapshot=a.snapshot"""
CTES["scut"] = """
SELECT country, snapshot, trade_date cut_date FROM (SELECT d.*, n.snapshot, row_number() OVER (PARTITION BY country, n.snapshot ORDER BY trade_date DESC) rk
 FROM (SELECT DISTINCT s.country, p.trade_date FROM prices p JOIN stocks s ON s.stock_id=p.stock_id WHERE s.is_active AND s.coverage<>'listed') d
 JOIN snaps n ON trade_date<=n.snapshot AND trade_date>=n.snapshot-120) x WHERE rk=21"""
e = lambda i: (f"CASE WHEN family='financial' OR oi{i} IS NULL THEN ni{i} WHEN ni{i} IS NULL THEN {K.AFTER_TAX}::DOUBLE*oi{i} "
               f"ELSE least(ni{i}, oi{i}*{K.AFTER_TAX}::DOUBLE) END e{i}")
CTES["sin0"] = f"""
SELECT m.*, x.snapshot, x.price_date, x.close, x.vol, x.c_21, x.c_126, x.c_252, v.market_cap mcap, v.bps, CAST(v.shares_outstanding AS DOUBLE) shares,
 c.* EXCLUDE (stock_id, snapshot), coalesce(x.price_date<t.cut_date, false) halted, coalesce(a.done>c.end0, false) split_after,
 CAST(CASE WHEN end0 IS NULL THEN 0 WHEN end1 IS NULL THEN 1 WHEN end2 IS NULL THEN 2 ELSE 3 END AS INT) fy_count,
 {e(0)}, {e(1)}, {e(2)}, CASE WHEN family='financial' THEN ni0 ELSE oi0 END p0, CASE WHEN family='financial' THEN ni2 ELSE oi2 END p2,
 debt0/nullif(ta0,0) la0, debt2/nullif(ta2,0) la2, family='financial' fin
FROM spx x JOIN smembers m ON m.stock_id=x.stock_id LEFT JOIN sval v ON v.stock_id=x.stock_id AND v.snapshot=x.snapshot
LEFT JOIN schain c ON c.stock_id=x.stock_id AND c.snapshot=x.snapshot LEFT JOIN scut t ON t.country=m.country AND t.snapshot=x.snapshot
LEFT JOIN actions a ON a.ticker=m.ticker AND a.country=m.country"""
CTES["sin1"] = """
SELECT *, CASE WHEN fy_count=3 AND e1 IS NOT NULL AND e2 IS NOT NULL THEN least(e0,(e0+e1+e2)/3.0) ELSE e0 END e_cons,
 (oi0 IS NOT NULL)::INT + (oi0 IS NOT NULL AND coalesce(oi2>0,false))::INT + (rev0 IS NOT NULL AND rev2 IS NOT NULL)::INT
  + (oi0 IS NOT NULL AND coalesce(oi2>0 AND rev0>0 AND rev2>0,false))::INT + (la0 IS NOT NULL AND la2 IS NOT NULL)::INT sig_n,
 coalesce(oi0>0,false)::INT + coalesce(oi2>0 AND oi0>oi2,false)::INT + coalesce(rev0>rev2,false)::INT
  + coalesce(oi2>0 AND rev0>0 AND rev2>0 AND oi0/rev0>oi2/rev2,false)::INT + coalesce(la0<la2,false)::INT sig_yes,
 coalesce(eq0<=0,false) OR coalesce(bps<=0,false) neg_book,
 CASE WHEN country='KR' AND shares>0 AND eq0>0 AND bps>0 AND eq0/bps>1.03::DOUBLE*shares THEN shares/(eq0/bps) END common_share
FROM sin0"""
CTES["sall"] = """
SELECT *, CAST((fy_count=3 AND e1 IS NOT NULL AND e2 IS NOT NULL)::INT + (end2 IS NOT NULL AND (fin OR sig_n>=3))::INT AS INT) value_rules FROM sin1"""
CTES["sinp"] = "SELECT * FROM sall WHERE coverage<>'listed'"

METRIC_SQL = {
    "conservative_yield": ("CASE WHEN mcap>0 THEN e_cons*coalesce(common_share,1.0)/mcap END",
                           "CASE WHEN e_cons IS NOT NULL AND mcap>0 THEN nullif(concat_ws('; ', CASE WHEN fy_count<3 THEN 'short history ' || fy_count "
                           "WHEN e_cons<e0 THEN 'three-year mean' END, CASE WHEN common_share IS NOT NULL THEN 'common share ' || "
                           "CAST(round(CAST(common_share AS DECIMAL(38,10))*100) AS INT) || '%' END), '') END", "NULL"),
    "book_yield": ("CASE WHEN NOT neg_book THEN bps/close END", "NULL",
                   "CASE WHEN neg_book THEN 'negative equity' WHEN eq0 IS NULL AND bps IS NULL THEN 'no equity' END"),
    "trap_signal": ("CASE WHEN NOT fin AND end2 IS NOT NULL AND sig_n>=3 THEN sig_yes/sig_n END", "NULL", "CASE WHEN fin THEN 'financial' END"),
    "return_on_assets": ("CASE WHEN ta0>0 THEN p0/ta0 END", "NULL", "NULL"),
    "operating_margin": ("CASE WHEN NOT fin THEN oi0/nullif(rev0,0) END", "NULL", "CASE WHEN fin THEN 'financial' END"),
    "revenue_cagr2": ("CASE WHEN NOT fin AND end2 IS NOT NULL AND rev2>0 AND rev0 IS NOT NULL THEN CASE WHEN rev0>0 THEN sqrt(rev0/rev2)-1 ELSE -1.0 END END",
                      "NULL", "CASE WHEN fin THEN 'financial' END"),
    "profit_growth2": ("CASE WHEN end2 IS NOT NULL AND ta2>0 AND p2>0 AND p0 IS NOT NULL THEN (p0-p2)/ta2 END", "NULL",
                       "CASE WHEN end2 IS NOT NULL AND p2<=0 THEN 'loss two years ago' END"),
    "volatility": ("vol", "NULL", "NULL"),
    "liab_assets": ("CASE WHEN NOT fin THEN la0 END", "NULL", "CASE WHEN fin THEN 'financial' END"),
    "momentum": ("CASE WHEN c_252 IS NOT NULL THEN c_21/c_252-1 WHEN c_126 IS NOT NULL THEN c_21/c_126-1 END",
                 "CASE WHEN c_252 IS NULL AND c_126 IS NOT NULL THEN 'six months instead of twelve' END", "NULL"),
}


def _long(src: str) -> str:
    parts = []
    for m, (raw, note, blank) in METRIC_SQL.items():
        f = K.METRICS[m][0]
        off = "(halted OR split_after)" if f == "value" else "halted"
        why = "WHEN halted THEN 'halted'" + (" WHEN split_after THEN 'corporate action'" if f == "value" else "")
        parts.append(f"SELECT stock_id, snapshot, country, family, group_id, '{m}' metric, '{f}' factor, CASE WHEN NOT {off} THEN {raw} END raw_value, "
                     f"CASE WHEN NOT {off} THEN {note} END note, CASE {why} ELSE {blank} END null_note FROM {src}")
    return "\nUNION ALL ".join(parts)


CTES["sml"] = _long("sinp")
CTES["srn"] = f"""
SELECT * EXCLUDE (q, cc, rr, z), {r(f"CASE WHEN {case_metric(3)} THEN least(0.0, z) ELSE z END", 4)} z_raw FROM (
 SELECT *, ({QUANTILE})*{case_metric(1)} z FROM (
  SELECT *, sqrt(-2.0*ln(CASE WHEN p<0.5 THEN p ELSE 1.0-p END)) q, p-0.5 cc, (p-0.5)*(p-0.5) rr FROM (
   SELECT *, (CAST(rank() OVER (PARTITION BY snapshot, country, family, metric ORDER BY raw_value) AS DOUBLE)
     + (count(*) OVER (PARTITION BY snapshot, country, family, metric, raw_value)-1)/2.0 - 0.5)
     / count(*) OVER (PARTITION BY snapshot, country, family, metric) p
   FROM sml WHERE raw_value IS NOT NULL)))"""
CTES["sneu"] = f"""
SELECT * EXCLUDE (gn, gs), CASE WHEN NOT {case_metric(4)} OR group_id IS NULL OR gn=1 THEN z_raw
 ELSE {r(f"least(3.0, greatest(-3.0, z_raw - gn/(gn+{K.SHRINKAGE_K})*(gs/gn)))", 4)} END z_adj FROM (
 SELECT *, count(*) OVER (PARTITION BY snapshot, country, group_id, metric) gn,
  CAST(sum(CAST(z_raw AS DECIMAL(10,4))) OVER (PARTITION BY snapshot, country, group_id, metric) AS DOUBLE) gs FROM srn)"""


def _factors(values: str, z: str, inputs: str) -> str:
    w = case_metric(2)
    cols = ", ".join(f"CAST(sum(CAST({z} AS DECIMAL(10,4))*{w}) FILTER (WHERE factor='{f}') AS DOUBLE)/sum({w}) FILTER (WHERE factor='{f}') {f}_f"
                     for f in K.FACTORS)
    return f"""
SELECT i.stock_id, i.snapshot, i.country, i.family, i.group_id, i.value_rules, f.* EXCLUDE (stock_id, snapshot, value_f),
 f.value_f*CASE WHEN i.value_rules>=2 THEN 1.0 ELSE (i.value_rules+1)/3.0 END value_f
FROM {inputs} i LEFT JOIN (SELECT stock_id, snapshot, {cols} FROM {values} GROUP BY 1,2) f ON f.stock_id=i.stock_id AND f.snapshot=i.snapshot"""


CTES["sfac"] = _factors("sneu", "z_adj", "sinp")
CTES["sstd"] = "SELECT *, " + ", ".join(
    f"CASE WHEN {f}_f IS NOT NULL THEN CASE WHEN stddev_samp({f}_f) OVER g>0 THEN ({f}_f-avg({f}_f) OVER g)/stddev_samp({f}_f) OVER g ELSE 0.0 END END {f}_z"
    for f in K.FACTORS) + " FROM sfac WINDOW g AS (PARTITION BY snapshot, country, family)"
CTES["pw"] = "SELECT preset, " + ", ".join(f"max(weight) FILTER (WHERE factor='{f}') w_{f}" for f in K.FACTORS) + " FROM presets GROUP BY 1"
CTES["scmp"] = f"""
SELECT stock_id, snapshot, preset, country, family, group_id, value_rules, factor_coverage, has_required,
 {', '.join(f"{r(f + '_z', 4)} {f}_score" for f in K.FACTORS)},
 {r(f"CASE WHEN family<>'financial' AND has_required AND factor_coverage>={K.MIN_FACTORS} THEN " + "+".join(f"w_{f}*coalesce({f}_z,0.0)" for f in K.FACTORS) + " END", 10)} composite_full
FROM (SELECT *, CAST({'+'.join(f'({f}_z IS NOT NULL)::INT' for f in K.FACTORS)} AS INT) factor_coverage,
 value_z IS NOT NULL AND quality_z IS NOT NULL has_required FROM sstd) CROSS JOIN pw"""
CTES["ssc"] = f"""
SELECT c.* EXCLUDE (composite_full, n, pos), {r("composite_full", 4)} composite,
 CASE WHEN composite_full IS NULL THEN NULL WHEN n=1 THEN 50.0 ELSE {r("100.0*(n-pos)/n", 2)} END score
FROM (SELECT *, rank() OVER (PARTITION BY snapshot, preset, country, family ORDER BY composite_full DESC NULLS LAST) pos,
 count(composite_full) OVER (PARTITION BY snapshot, preset, country, family) n FROM scmp) c"""

D = "CAST(snapshot AS VARCHAR) snapshot"
SQL: dict[str, str] = {}
SQL["sc_fy_chain"] = compose(f"""SELECT stock_id, {D}, CAST(end0 AS VARCHAR) end0, CAST(end1 AS VARCHAR) end1, CAST(end2 AS VARCHAR) end2, oi0, oi1, oi2, ni0, ni1, ni2 FROM schain""")
SQL["sc_calendar_halt"] = compose(f"SELECT stock_id, {D}, country, CAST(price_date AS VARCHAR) price_date, halted FROM sinp")
SQL["sc_corporate_action"] = compose(f"SELECT stock_id, {D}, split_after FROM sinp")
SQL["sc_conservative_earnings"] = compose(f"SELECT stock_id, {D}, family, fy_count, {r('e_cons', 4)} e_cons FROM sinp")
SQL["sc_common_share"] = compose(f"SELECT stock_id, {D}, {r('common_share', 6)} common_share FROM sinp WHERE common_share IS NOT NULL")
SQL["sc_trap_signal"] = compose(f"SELECT stock_id, {D}, {r('raw_value', 6)} trap_signal FROM sml WHERE metric='trap_signal'")
SQL["sc_momentum"] = compose(f"SELECT stock_id, {D}, {r('raw_value', 6)} momentum, note FROM sml WHERE metric='momentum'")
SQL["sc_metrics_long"] = compose(f"SELECT stock_id, {D}, country, family, metric, factor, {r('raw_value', 6)} raw_value, note, null_note FROM sml")
SQL["sc_rank_normal"] = compose(f"SELECT stock_id, {D}, metric, {r('p', 8)} p, z_raw FROM srn")
SQL["sc_neutralize"] = compose(f"SELECT stock_id, {D}, metric, z_raw, z_adj FROM sneu")
SQL["sc_aggregate"] = compose(f"SELECT * EXCLUDE (snapshot, group_id), {D} FROM ssc")
SQL["fiscal_mode"] = compose(f"""SELECT {D}, country, CAST(end0 AS VARCHAR) mode_end FROM (
 SELECT snapshot, country, end0, row_number() OVER (PARTITION BY snapshot, country ORDER BY count(*) DESC, end0 DESC) k FROM sinp WHERE end0 IS NOT NULL GROUP BY 1,2,3) WHERE k=1""")
SQL["fin_basis"] = compose(f"""SELECT {D}, country, CAST(year(e) AS INT) fiscal_year, count(*) stocks FROM (
 SELECT i.snapshot, i.country, i.stock_id, max(f.period_end) e FROM sinp i JOIN sfy f ON f.stock_id=i.stock_id AND f.snapshot=i.snapshot GROUP BY 1,2,3) GROUP BY 1,2,3""")
CTES["mode_end"] = """SELECT snapshot, country, end0 mode_end FROM (
 SELECT snapshot, country, end0, row_number() OVER (PARTITION BY snapshot, country ORDER BY count(*) DESC, end0 DESC) k FROM sinp WHERE end0 IS NOT NULL GROUP BY 1,2,3) WHERE k=1"""
over = lambda i: f"coalesce(ni{i}>0 AND (oi{i}<=0 OR ni{i}>{K.ONEOFF_RATIO}::DOUBLE*oi{i}), false)"
CTES["sbadge"] = f"""
SELECT stock_id, snapshot, 'oneoff' code, CAST({'+'.join(f'(ni{i} IS NOT NULL AND oi{i} IS NOT NULL)::INT' for i in range(3))} AS INT) n,
 CAST({'+'.join(over(i) + '::INT' for i in range(3))} AS INT) k FROM sinp WHERE family<>'financial' AND {over(0)}
UNION ALL SELECT i.stock_id, i.snapshot, 'fiscal_gap', CAST(abs(end0-mode_end) AS INT), CAST(round(abs(end0-mode_end)/30.44) AS INT) FROM sinp i
 JOIN mode_end m ON m.snapshot=i.snapshot AND m.country=i.country WHERE abs(end0-mode_end)>{K.FISCAL_GAP_DAYS}
UNION ALL SELECT stock_id, snapshot, 'short_history', fy_count, CAST(2-value_rules AS INT) FROM sinp WHERE fy_count<3 OR value_rules<2"""
SQL["sc_badges"] = compose(f"SELECT stock_id, {D}, code, n, k FROM sbadge")
CTES["squal"] = f"""
SELECT s.stock_id, s.snapshot, s.preset, CASE WHEN s.family='financial' THEN s.country || '·금융' ELSE s.country END "partition", s.value_rules,
 i.fy_count fy_history, CAST(i.price_date AS VARCHAR) price_date, coalesce(m.missing,'') missing_metrics,
 concat_ws(',', {', '.join(f"CASE WHEN s.{f}_score IS NULL THEN '{f}' END" for f in K.FACTORS)}) unavailable_factors,
 CASE WHEN s.composite IS NOT NULL THEN NULL WHEN i.halted THEN 'halted' WHEN i.split_after THEN 'corporate_action' WHEN s.family='financial' THEN 'financial_profile'
  WHEN NOT s.has_required THEN 'no_financials' ELSE 'few_factors' END score_null_code, '{K.MODEL_VERSION}' model_version
FROM ssc s JOIN sinp i ON i.stock_id=s.stock_id AND i.snapshot=s.snapshot LEFT JOIN (
 SELECT stock_id, snapshot, string_agg(metric || '=' || coalesce(null_note,'no data'), '; ' ORDER BY metric || '=' || coalesce(null_note,'no data')) missing
 FROM sml WHERE raw_value IS NULL GROUP BY 1,2) m ON m.stock_id=s.stock_id AND m.snapshot=s.snapshot"""
SQL["sc_quality_struct"] = compose(f"SELECT * REPLACE (CAST(snapshot AS VARCHAR) AS snapshot) FROM squal")
# ------------------------------------------------------------------ positions
CTES["slast"] = "SELECT * FROM ssc WHERE snapshot=(SELECT max(snapshot) FROM snaps)"
SQL["sc_presets_validate"] = compose("""SELECT x.preset, problem, coalesce(n.scored, 0) scored FROM (SELECT 'growth_old' preset, 'sum' problem UNION ALL SELECT 'half', 'factors') x
LEFT JOIN (SELECT preset, count(score) scored FROM slast GROUP BY 1) n ON n.preset=x.preset""")
CTES["fpos"] = " UNION ALL ".join(
    f"SELECT stock_id, preset, country, family, group_id, '{f}' factor, {f}_score score FROM slast WHERE composite IS NOT NULL AND {f}_score IS NOT NULL"
    for f in K.FACTORS)
CTES["fposp"] = f"""SELECT *, {r("100.0*(count(*) OVER w - rank() OVER (PARTITION BY preset, country, family, factor ORDER BY score DESC))/count(*) OVER w", 2)} percentile
FROM fpos WINDOW w AS (PARTITION BY preset, country, family, factor)"""
SQL["factor_positions"] = compose("SELECT stock_id, preset, country, family, group_id, factor, score, percentile FROM fposp")
CTES["rawfac"] = _factors("sneu", "z_raw", "sinp")
CTES["tpos"] = f"""
SELECT snapshot, country, family, group_id, factor, m, position, total, CAST(ceil(100.0*position/total) AS INT) top_percent FROM (
 SELECT *, rank() OVER (PARTITION BY snapshot, country, family, factor ORDER BY m DESC) AS position, count(*) OVER (PARTITION BY snapshot, country, family, factor) total FROM (
  SELECT snapshot, country, family, group_id, factor, {r("avg(v)", 10)} m FROM (
   SELECT f.*, x.factor, x.v FROM rawfac f, LATERAL (VALUES {', '.join(f"('{f}', f.{f}_f)" for f in K.FACTORS)}) x(factor, v)
   WHERE x.v IS NOT NULL AND f.group_id IS NOT NULL AND EXISTS (SELECT 1 FROM ssc s WHERE s.stock_id=f.stock_id AND s.snapshot=f.snapshot AND s.composite IS NOT NULL))
  GROUP BY 1,2,3,4,5 HAVING count(*)>=2))"""
SQL["theme_positions"] = compose(f"SELECT {D}, country, family, group_id, factor, {r('m', 6)} score, position, total, top_percent FROM tpos")
SQL["peer_average"] = compose("SELECT country, group_id, preset, count(*) size, " + ", ".join(
    f"{r(f'CAST(sum(CAST({f}_score AS DECIMAL(10,4))) AS DOUBLE)/count({f}_score)', 4)} {f}" for f in K.FACTORS)
    + " FROM slast WHERE group_id IS NOT NULL GROUP BY 1,2,3 HAVING count(*)>=2")
CTES["arank"] = f"""SELECT stock_id, preset, rank() OVER (PARTITION BY preset, country, family ORDER BY score DESC) rank_position,
 count(*) OVER (PARTITION BY preset, country, family) rank_total,
 {r("100.0*percent_rank() OVER (PARTITION BY preset, country, family ORDER BY score)", 1)} percentile FROM slast WHERE score IS NOT NULL"""
SQL["analysis_row"] = compose("""
SELECT v.stock_id, v.market, CAST(v.as_of AS VARCHAR) as_of, v.close, v.return_1y, v.volatility_1y, v.per, v.roe, v.market_cap_krw, s.preset, s.score, s.composite,
 s.factor_coverage, k.rank_position, k.rank_total, k.percentile
FROM vm v LEFT JOIN slast s ON s.stock_id=v.stock_id AND s.preset='balanced' LEFT JOIN arank k ON k.stock_id=v.stock_id AND k.preset='balanced'""")
SQL["latest_score_filter"] = compose("SELECT stock_id, preset, CAST(snapshot AS VARCHAR) snapshot, score FROM slast")
SQL["family_filter"] = compose("""
SELECT a.country, a.family, a.preset, count(*) members, count(a.score) scored FROM slast a GROUP BY 1,2,3""")
SQL["score_contribution"] = compose(f"""
SELECT s.stock_id, s.preset, p.factor, p.weight, CASE WHEN s.composite IS NOT NULL THEN {r("p.weight*x.v", 4)} END contribution
FROM slast s JOIN presets p ON p.preset=s.preset JOIN LATERAL (SELECT CASE p.factor {' '.join(f"WHEN '{f}' THEN s.{f}_score" for f in K.FACTORS)} END v) x ON true WHERE x.v IS NOT NULL""")
SQL["presets_table"] = compose("SELECT p.*, coalesce(n.scored, 0) scored FROM (SELECT preset, sort_order, is_default, " + ", ".join(
    f"max(weight) FILTER (WHERE factor='{f}') {f}" for f in K.FACTORS) + """ FROM presets GROUP BY 1,2,3) p
LEFT JOIN (SELECT preset, count(score) scored FROM slast GROUP BY 1) n ON n.preset=p.preset""")
SQL["home_attractiveness"] = compose("""
SELECT country, family, rank, stock_id, ticker, name, market, value FROM (
 SELECT l.country, l.family, rank() OVER w AS rank, row_number() OVER (PARTITION BY l.country, l.family ORDER BY l.score DESC, l.stock_id) o, s.stock_id, s.ticker, s.name, s.market, l.score AS value
 FROM slast l JOIN stocks s ON s.stock_id=l.stock_id WHERE l.preset='balanced' AND l.score IS NOT NULL AND s.is_active AND s.coverage IN ('featured','benchmark')
 WINDOW w AS (PARTITION BY l.country, l.family ORDER BY l.score DESC)) WHERE o<=10""")
# ------------------------------------------------------------------ reference scores
CTES["rin"] = "SELECT * FROM sall WHERE coverage='listed' AND family<>'financial'"
CTES["rml"] = _long("rin")
CTES["rplaced"] = f"""
SELECT *, CASE WHEN {case_metric(3)} THEN least(0.0, z) ELSE z END zr FROM (SELECT *, ({QUANTILE})*{case_metric(1)} z FROM (
 SELECT *, sqrt(-2.0*ln(CASE WHEN p<0.5 THEN p ELSE 1.0-p END)) q, p-0.5 cc, (p-0.5)*(p-0.5) rr FROM (
  SELECT l.*, (count(*) FILTER (WHERE u.raw_value<l.raw_value) + 1 + count(*) FILTER (WHERE u.raw_value=l.raw_value)/2.0 - 0.5)/(count(*)+1) p
  FROM rml l JOIN srn u ON u.snapshot=l.snapshot AND u.country=l.country AND u.family=l.family AND u.metric=l.metric
  WHERE l.raw_value IS NOT NULL GROUP BY ALL)))"""
CTES["rgs"] = """SELECT snapshot, country, group_id, metric, count(*) gn, CAST(sum(CAST(z_raw AS DECIMAL(10,4))) AS DOUBLE) gs FROM srn
 WHERE group_id IS NOT NULL GROUP BY 1,2,3,4"""
CTES["rneu"] = f"""
SELECT stock_id, snapshot, metric, factor, CASE WHEN NOT {case_metric(4)} OR group_id IS NULL OR n=1 THEN zr
 ELSE least(3.0, greatest(-3.0, zr - n/(n+{K.SHRINKAGE_K})*((gs+zr)/n))) END z_adj
FROM (SELECT p.*, coalesce(gn,0)+1 n, coalesce(gs,0.0) gs FROM rplaced p LEFT JOIN rgs g ON g.snapshot=p.snapshot AND g.country=p.country AND g.group_id=p.group_id AND g.metric=p.metric)"""
CTES["rfac"] = f"""
SELECT i.stock_id, i.snapshot, i.country, i.family, i.group_id, f.* EXCLUDE (stock_id, snapshot, value_f),
 f.value_f*CASE WHEN i.value_rules>=2 THEN 1.0 ELSE (i.value_rules+1)/3.0 END value_f FROM rin i JOIN (SELECT stock_id, snapshot, {', '.join(
     f"sum(z_adj*{case_metric(2)}) FILTER (WHERE factor='{f}')/sum({case_metric(2)}) FILTER (WHERE factor='{f}') {f}_f" for f in K.FACTORS)}
 FROM rneu GROUP BY 1,2) f ON f.stock_id=i.stock_id AND f.snapshot=i.snapshot"""
CTES["rdist"] = "SELECT snapshot, country, family, " + ", ".join(f"avg({f}_f) {f}_m, stddev_samp({f}_f) {f}_s" for f in K.FACTORS) + " FROM sfac GROUP BY 1,2,3"
CTES["rstd"] = "SELECT r.*, " + ", ".join(
    f"CASE WHEN {f}_f IS NOT NULL THEN CASE WHEN {f}_s>0 THEN ({f}_f-{f}_m)/{f}_s ELSE 0.0 END END {f}_z" for f in K.FACTORS) + \
    " FROM rfac r LEFT JOIN rdist d ON d.snapshot=r.snapshot AND d.country=r.country AND d.family=r.family"
W = dict(zip(K.FACTORS, K.PRESETS["balanced"]))
CTES["rcmp"] = f"""
SELECT *, {r("CASE WHEN value_z IS NOT NULL AND quality_z IS NOT NULL AND factor_coverage>=3 THEN " + "+".join(f"{W[f]}::DOUBLE*coalesce({f}_z,0.0)" for f in K.FACTORS) + " END", 4)} composite
FROM (SELECT *, CAST({'+'.join(f'({f}_z IS NOT NULL)::INT' for f in K.FACTORS)} AS INT) factor_coverage FROM rstd)"""
SQL["sc_reference_score"] = compose(f"""
SELECT c.stock_id, CAST(c.snapshot AS VARCHAR) snapshot, 'balanced' preset, c.country, c.family, c.group_id, c.factor_coverage,
 {', '.join(f"{r('c.' + f + '_z', 4)} {f}_score" for f in K.FACTORS)}, c.composite, k.score, k.position, k.total, k.percentile
FROM rcmp c LEFT JOIN (SELECT c.stock_id, c.snapshot, {r("100.0*(count(*) - count(*) FILTER (WHERE u.composite>c.composite))/(count(*)+1)", 2)} score,
  count(*) FILTER (WHERE u.composite>c.composite)+1 AS position, count(*)+1 total, {r("100.0*count(*) FILTER (WHERE u.composite<c.composite)/count(*)", 1)} percentile
 FROM rcmp c JOIN ssc u ON u.snapshot=c.snapshot AND u.country=c.country AND u.family=c.family AND u.preset='balanced' AND u.composite IS NOT NULL
 WHERE c.composite IS NOT NULL GROUP BY 1,2,c.composite) k ON k.stock_id=c.stock_id AND k.snapshot=c.snapshot""")
