"""SQL for audits."""
from __future__ import annotations

from bourseflow import constants as K
from bourseflow.plans.audit_queries import PREDICATES
from oracle.ctes import CTES, compose, r
from oracle import ingest as _ingest_sql
from oracle import scoring as _scoring
from oracle import tables as _tables  # noqa: F401

SQL: dict[str, str] = {}
THEME = _ingest_sql.THEME_ASSIGN


def res(rule: str, part: str, bad: str, src: str, detail: str = "CAST(count(*) AS DOUBLE)") -> str:
    return (f"SELECT '{rule}' rule_id, CAST({part} AS VARCHAR) part, count(*) FILTER (WHERE coalesce({bad}, false)) violations, {detail} detail FROM {src} GROUP BY 2")


CTES["ain"] = "SELECT * FROM sinp WHERE snapshot=(SELECT max(snapshot) FROM snaps)"
CTES["ach"] = "SELECT * FROM schain WHERE snapshot=(SELECT max(snapshot) FROM snaps)"
CTES["apos"] = """SELECT *, rank() OVER g AS pos, count(*) OVER (PARTITION BY preset, country, family) n FROM slast WHERE score IS NOT NULL
 WINDOW g AS (PARTITION BY preset, country, family ORDER BY score DESC)"""
CTES["afacts"] = "SELECT i.stock_id, i.country, i.family, i.fy_count, CAST(i.end0 AS VARCHAR) fy_end, CAST(i.price_date AS VARCHAR) price_date, x.* EXCLUDE (stock_id) FROM ain i LEFT JOIN (SELECT s.stock_id, " + \
    ", ".join(f"max(s.{f}_score) {f}_factor" for f in K.FACTORS) + ", " + \
    ", ".join(f"max(s.score) FILTER (WHERE s.preset='{p}') {p}_percentile, max(a.pos) FILTER (WHERE s.preset='{p}') {p}_rank" for p in K.PRESETS) + \
    " FROM slast s LEFT JOIN apos a ON a.stock_id=s.stock_id AND a.preset=s.preset GROUP BY 1) x ON x.stock_id=i.stock_id"
SQL["a_facts"] = compose("SELECT * FROM afacts")
CASES = [("growth-not-top", 5, "required", None), ("scored", 7, "required", None), ("safe", 8, "target", None), ("no-score", 9, "known_fail", "D-1"),
         ("no-score", 12, "known_fail", None), ("fin", 13, "required", None), ("scored", 999999999, "required", None)]
SQL["a_cases"] = compose(f"""SELECT case_id, CAST(stock_id AS BIGINT) stock_id, CASE WHEN ok IS NULL THEN 'unverified' WHEN ok THEN 'passed' WHEN status='known_fail' AND decision IS NOT NULL THEN 'known_fail' WHEN status='target' THEN 'target_fail' ELSE 'required_fail' END outcome FROM (
 SELECT c.*, CASE WHEN f.stock_id IS NOT NULL THEN coalesce(CASE c.case_id {' '.join(f"WHEN '{k}' THEN {p}" for k, p in PREDICATES.items())} END, false) END ok
 FROM (VALUES {', '.join(f"('{a}', {b}, '{c}', {'NULL' if d is None else repr(d)})" for a, b, c, d in CASES)}) c(case_id, stock_id, status, decision) LEFT JOIN afacts f ON f.stock_id=c.stock_id)""")
SQL["a_r6"] = compose(res("a_r6_formula", "preset", "abs(score - CASE WHEN n>1 THEN 100.0*(n-pos)/n ELSE 50.0 END)>0.01", "apos") + " UNION ALL "
                      + res("a_r6_band", "preset", "n>1 AND least(4, CAST(floor(score/20) AS INT)) <> CASE WHEN 100.0*pos/n<=20 THEN 4 WHEN 100.0*pos/n<=40 THEN 3 WHEN 100.0*pos/n<=60 THEN 2 WHEN 100.0*pos/n<=80 THEN 1 ELSE 0 END", "apos") + " UNION ALL "
                      + res("a_r6_order", "preset", "hi>above+0.0002", "(SELECT *, lead(lo) OVER (PARTITION BY preset, country, family ORDER BY score) above FROM (SELECT preset, country, family, score, max(composite) hi, min(composite) lo FROM slast WHERE score IS NOT NULL GROUP BY 1,2,3,4))"))
SQL["a_oneoff"] = compose(res("a_oneoff", "country", f"e_cons > {K.AFTER_TAX}::DOUBLE*oi0+0.000001", "(SELECT * FROM ain WHERE ni0>1.2::DOUBLE*oi0 AND oi0>0 AND family<>'financial' AND mcap>0 AND NOT halted AND NOT split_after AND e_cons IS NOT NULL)"))
CTES["atop"] = """SELECT *, row_number() OVER (PARTITION BY preset, country ORDER BY score DESC, stock_id) place FROM slast WHERE family='general' AND score IS NOT NULL"""
CTES["acagr"] = "SELECT m.stock_id, m.country, m.family, m.raw_value cagr FROM sml m WHERE m.metric='revenue_cagr2' AND snapshot=(SELECT max(snapshot) FROM snaps)"
CTES["amed"] = "SELECT country, median(cagr) med FROM acagr WHERE family='general' GROUP BY 1"
P = "country || '/' || preset"
SQL["a_r1_r4"] = compose(" UNION ALL ".join([
    res("a_r1", P, f"ni0>0 AND (oi0<=0 OR ni0>2*oi0) AND e_cons>{K.AFTER_TAX}::DOUBLE*oi0+0.000001", "(SELECT t.country, t.preset, i.ni0, i.oi0, i.e_cons FROM atop t JOIN ain i ON i.stock_id=t.stock_id WHERE t.place<=10)"),
    res("a_r2", P, "oi2<0 AND coalesce(cagr,-9.0)<=med", "(SELECT t.country, t.preset, c.oi2, g.cagr, d.med FROM atop t JOIN ach c ON c.stock_id=t.stock_id JOIN acagr g ON g.stock_id=t.stock_id JOIN amed d ON d.country=t.country WHERE t.place<=20 AND t.preset='growth')"),
    res("a_r3", P, "rev0<rev1 AND rev1<rev2", "(SELECT t.country, t.preset, c.rev0, c.rev1, c.rev2 FROM atop t JOIN ach c ON c.stock_id=t.stock_id WHERE t.place<=20 AND t.preset='value')"),
    res("a_r4", P, "commodity_linked", "(SELECT t.country, t.preset, h.commodity_linked FROM atop t JOIN ach c ON c.stock_id=t.stock_id LEFT JOIN theme h ON h.stock_id=t.stock_id WHERE t.place<=10 AND t.preset='value')")]))
CTES["asc"] = "SELECT DISTINCT stock_id FROM slast WHERE score IS NOT NULL"
CTES["aba"] = """SELECT i.stock_id, i.country, abs(i.end0-m.mode_end) gap, (SELECT count(*) FROM sbadge b WHERE b.stock_id=i.stock_id AND b.snapshot=i.snapshot) nb,
 (SELECT count(*) FROM sbadge b WHERE b.stock_id=i.stock_id AND b.snapshot=i.snapshot AND b.code='fiscal_gap') ng FROM ain i JOIN asc s ON s.stock_id=i.stock_id LEFT JOIN mode_end m ON m.snapshot=i.snapshot AND m.country=i.country"""
for k in ("aba",):
    CTES[k] = CTES[k].replace("JOIN asc ", "JOIN ascored ")
CTES["ascored"] = CTES.pop("asc")
SQL["a_r5_r7"] = compose(res("a_r5", "country", "gap>182 AND ng=0", "aba") + f""" UNION ALL SELECT 'a_r7', country, CAST((d>0.30)::INT AS BIGINT), d FROM (SELECT country, {r("CAST(count(*) FILTER (WHERE nb>0) AS DOUBLE)/count(*)", 4)} d FROM aba GROUP BY 1)
 UNION ALL SELECT 'a_badge_wording', country, 0, CAST(sum(nb) AS DOUBLE) FROM aba WHERE nb>0 GROUP BY 2""")
SQL["a_r9"] = compose(res("a_r9", "country", "score IS NULL AND family='general' AND NOT has_required",
                          "(SELECT n.* FROM slast n JOIN ssc b ON b.stock_id=n.stock_id AND b.preset='balanced' AND b.snapshot=(SELECT snapshot FROM snaps ORDER BY snapshot DESC LIMIT 1 OFFSET 1) AND b.score IS NOT NULL WHERE n.preset='balanced')"))
SQL["a_trap"] = compose(res("a_trap", "country", "z_adj>0", "(SELECT * FROM sneu WHERE metric='trap_signal')"))
SQL["a_price_same_date"] = compose("""SELECT 'a_price_same_date' rule_id, country || '/' || CAST(snapshot AS VARCHAR) part, count(DISTINCT price_date)-1 violations, CAST(count(*) AS DOUBLE) detail FROM sinp i
WHERE EXISTS (SELECT 1 FROM ssc s WHERE s.stock_id=i.stock_id AND s.snapshot=i.snapshot AND s.family='general' AND s.score IS NOT NULL) GROUP BY 2""")
SQL["a_theme_position"] = compose("SELECT 'a_theme_position' rule_id, country part, 0 violations, CAST(count(*) AS DOUBLE) detail FROM tpos GROUP BY 2")
CTES["rawstd"] = "SELECT *, " + ", ".join(
    f"CASE WHEN {f}_f IS NOT NULL THEN CASE WHEN stddev_samp({f}_f) OVER g>0 THEN ({f}_f-avg({f}_f) OVER g)/stddev_samp({f}_f) OVER g ELSE 0.0 END END {f}_z"
    for f in K.FACTORS) + " FROM rawfac WINDOW g AS (PARTITION BY snapshot, country, family)"
CTES["rawcmp"] = f"""SELECT stock_id, preset, country, family, {r("CASE WHEN family<>'financial' AND value_z IS NOT NULL AND quality_z IS NOT NULL AND " + "+".join(f"({f}_z IS NOT NULL)::INT" for f in K.FACTORS) + ">=3 THEN " + "+".join(f"w_{f}*coalesce({f}_z,0.0)" for f in K.FACTORS) + " END", 10)} composite_full
FROM rawstd CROSS JOIN pw WHERE snapshot=(SELECT max(snapshot) FROM snaps)"""
SQL["a_raw_composite"] = compose("SELECT * FROM rawcmp")
SQL["a_family"] = compose(res("a_fin_family", "country", "composite IS NOT NULL OR score IS NOT NULL", "(SELECT * FROM slast WHERE family='financial')")
                          + " UNION ALL SELECT 'a_home_mix', country, 0, CAST(count(*) AS DOUBLE) FROM (SELECT *, row_number() OVER (PARTITION BY country, family ORDER BY score DESC, stock_id) k FROM slast WHERE preset='balanced' AND score IS NOT NULL) WHERE k<=20 GROUP BY 2")
SQL["a_units"] = compose(" UNION ALL ".join([
    res("a_currency", "country", "eps*ni0>0 AND (eps*sh/nullif(ni0,0)>50 OR eps*sh/nullif(ni0,0)<1/50)", "(SELECT i.country, i.ni0, v.eps, v.shares_outstanding sh FROM ain i LEFT JOIN sval v ON v.stock_id=i.stock_id AND v.snapshot=i.snapshot WHERE i.country='KR')"),
    res("a_neg_equity", "country", "false", "(SELECT * FROM ain WHERE neg_book AND NOT halted AND NOT split_after)"),
    res("a_preferred", "country", "false", "(SELECT * FROM ain WHERE common_share IS NOT NULL AND mcap>0 AND e_cons IS NOT NULL AND NOT halted AND NOT split_after)"),
    res("a_lp_equity", "'FY'", "total_equity=0 AND total_assets-total_debt<>0", "statements")]))
SQL["a_data_path"] = compose(" UNION ALL ".join([
    res("a_data_path", "country", "p NOT IN ('SEC_API','YFINANCE')", "anote"), res("a_year_gap", "country", "gap AND NOT coalesce(notes LIKE '%no prior year%', false)", "anote")]))
CTES["anote"] = r"""SELECT *, regexp_extract(split_part(coalesce(notes,''), ';', 1), '^path=(\w+)', 1) p, period_end - lag(period_end) OVER (PARTITION BY stock_id ORDER BY period_end) > 400 gap FROM (
 SELECT f.*, s.country, CASE WHEN f.stock_id%17=3 AND year(period_end)=1996 THEN NULL WHEN f.stock_id%23=9 THEN 'path=SEC_FRAMES; bulk' WHEN year(period_end)=2000 THEN 'path=SEC_API; no prior year' ELSE 'path=SEC_API' END notes
 FROM statements f JOIN stocks s ON s.stock_id=f.stock_id WHERE (year(period_end)<>1998 OR total_equity>=0) AND (year(period_end)<>1999 OR operating_income>=0))"""
SQL["a_data_path"] = compose(" UNION ALL ".join([
    res("a_data_path", "country", "p NOT IN ('SEC_API','YFINANCE')", "anote"), res("a_year_gap", "country", "gap AND NOT coalesce(notes LIKE '%no prior year%', false)", "anote")]))


def check(name: str, src: str, bad: str) -> str:
    return f"SELECT 'a_constraints' rule_id, '{name}' part, count(*) FILTER (WHERE coalesce({bad}, false)) violations, CAST(count(*) AS DOUBLE) detail FROM {src}"


dup = lambda src, keys: f"(SELECT {keys}, count(*) c FROM {src} GROUP BY {keys})"
PRICE, LOG, SCORE = "prices p", "logs", "ssc x"
SQL["a_constraints"] = compose(" UNION ALL ".join([
    check("price range", PRICE, "high<low OR low<=0 OR p.close<low OR p.close>high"), check("volume sign", PRICE, "volume<0"), check("open range", PRICE, "p.open<low OR p.open>high"),
    check("log times", LOG, "finished_at<started_at"), check("log status", LOG, "status NOT IN ('SUCCESS','FAILED','SKIPPED')"), check("failed without text", LOG, "status='FAILED' AND error IS NULL"),
    check("fx positive", "fx", "usd_krw<=0"), check("fx kind", "fx", "granularity NOT IN ('DAILY','SNAPSHOT')"), check("position", "items", "quantity<=0 OR ref_price<=0 OR ref_fx_rate<=0"),
    check("valuation signs", "valuations", "per<=0 OR pbr<=0"), check("valuation shares", "valuations", "shares_outstanding<=0"), check("market value", "valuations", "market_cap<0"),
    check("assets sign", "statements", "total_assets<0"), check("period kind", "statements", "period_type<>'FY'"), check("index close", "index_prices i", "i.close<=0"),
    check("filing fields", "disclosures", "title IS NULL OR filed_at IS NULL"), check("filing source", "disclosures", "data_source NOT IN ('DART','SEC','KIND')"),
    check("coverage kind", "stocks", "coverage NOT IN ('listed','benchmark','featured')"), check("share ratio", "stocks", "share_ratio<=0"),
    check("score range", SCORE, "score<0 OR score>100"), check("score without composite", SCORE, "score IS NOT NULL AND composite IS NULL"),
    check("price key", dup("prices", "stock_id, trade_date"), "c>1"), check("fx key", dup("fx", "granularity, rate_at"), "c>1"), check("stock key", dup("stocks", "market, ticker"), "c>1"),
    check("one primary theme", dup("members WHERE is_primary", "stock_id"), "c>1"), check("receipt number", dup("disclosures", "rcept_no"), "c>1"),
    check("statement key", dup("statements", "stock_id, period_end, period_type"), "c>1"), check("valuation key", dup("valuations", "stock_id, as_of"), "c>1"),
    check("index key", dup("index_prices", "index_id, trade_date"), "c>1"), check("watch key", dup("watchlist", "user_id, stock_id"), "c>1"),
    check("item key", dup("items", "portfolio_id, stock_id"), "c>1"), check("score key", dup("ssc", "stock_id, preset, snapshot"), "c>1"),
    check("price stock", "(SELECT DISTINCT stock_id k FROM prices)", "k NOT IN (SELECT stock_id FROM stocks)"), check("filing stock", "(SELECT DISTINCT stock_id k FROM disclosures)", "k NOT IN (SELECT stock_id FROM stocks)"),
    check("member theme", "(SELECT DISTINCT group_id k FROM members)", "k NOT IN (SELECT group_id FROM groups)"), check("item stock", "(SELECT DISTINCT stock_id k FROM items)", "k NOT IN (SELECT stock_id FROM stocks)"),
    check("watch stock", "(SELECT DISTINCT stock_id k FROM watchlist)", "k NOT IN (SELECT stock_id FROM stocks)"),
    check("weights", "(SELECT preset, sum(CAST(weight AS DECIMAL(6,3))) w FROM presets GROUP BY 1)", "w<>1"),
    check("seed", "(SELECT u.used, p.seed_krw FROM usedk u JOIN portfolios p ON p.portfolio_id=u.portfolio_id)", "used>seed_krw")]))


def scenarios() -> str:
    rows = []
    for p, ws in K.PRESETS.items():
        w = dict(zip(K.FACTORS, ws))
        for f in K.FACTORS:
            for step in (0.1, -0.1):
                if 0 <= w[f] + step <= 1:
                    m = {k: (w[f] + step if k == f else w[k] * (1 - w[f] - step) / (1 - w[f])) for k in K.FACTORS}
                    rows.append((p, f"{f}{step:+.1f}", m))
        rows.append((p, "base", w))
    return ", ".join(f"('{p}', '{s}', " + ", ".join(f"{float(m[f])!r}::DOUBLE" for f in K.FACTORS) + ")" for p, s, m in rows)


CTES["abest"] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, preset, s ORDER BY c DESC, stock_id) k FROM (
 SELECT l.country, l.preset, l.stock_id, x.s, {r(" + ".join(f"x.{f}*coalesce(l.{f}_score,0.0)" for f in K.FACTORS), 8)} c FROM slast l
 JOIN (VALUES {scenarios()}) x(p, s, {', '.join(K.FACTORS)}) ON x.p=l.preset WHERE l.family='general' AND l.composite IS NOT NULL)) WHERE k<=10"""
SQL["a_r8"] = compose(res("a_r8", P, "common<7", "(SELECT b.country, b.preset, b.s, count(o.stock_id) common FROM abest b LEFT JOIN (SELECT * FROM abest WHERE s='base') o ON o.country=b.country AND o.preset=b.preset AND o.stock_id=b.stock_id WHERE b.s<>'base' GROUP BY 1,2,3)", "CAST(min(common) AS DOUBLE)"))
CTES["awk"] = f"""SELECT l.country, l.preset, l.group_id, {r("avg(w.composite_full)", 8)} m, arg_max(l.stock_id, l.score*1000000 - l.stock_id) stock_id FROM slast l JOIN rawcmp w ON w.stock_id=l.stock_id AND w.preset=l.preset AND w.composite_full IS NOT NULL
 WHERE l.family='general' AND l.score IS NOT NULL AND l.group_id IS NOT NULL GROUP BY 1,2,3 HAVING count(*)>=2"""
CTES["awk2"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, preset ORDER BY m, group_id) o, count(*) OVER (PARTITION BY country, preset) t FROM awk) WHERE o<=ceil(t*0.3)"
SQL["a_weak_theme"] = compose(res("a_weak_theme", P, "w IS NOT NULL", "(SELECT t.country, t.preset, k.stock_id w FROM atop t LEFT JOIN awk2 k ON k.country=t.country AND k.preset=t.preset AND k.stock_id=t.stock_id WHERE t.place<=20)"))
SQL["a_themes"] = compose(res("a_theme_expected", "'all'", "theme IS DISTINCT FROM e", f"(SELECT v.e, a.theme FROM (VALUES (4,'NATION_9'),(11,'NATION_2'),(3,'NATION_0')) v(s, e) LEFT JOIN ({THEME}) a ON a.stock_id=v.s)") + " UNION ALL "
                         + res("a_top20_unreviewed", P, "NOT seen", "(SELECT t.country, t.preset, EXISTS (SELECT 1 FROM watchlist w WHERE w.stock_id=t.stock_id AND w.target_price>100000) seen FROM atop t WHERE t.place<=20)"))

CTES["asafe"] = """SELECT i.country, c.oi0, s.safety_score sf FROM ain i JOIN ach c ON c.stock_id=i.stock_id JOIN slast s ON s.stock_id=i.stock_id AND s.preset='balanced'
 WHERE i.family='general' AND c.debt0>=c.ta0 AND s.safety_score IS NOT NULL"""
SQL["a_history"] = compose(" UNION ALL ".join([
    res("a_history", "country", "fy_count<3", "ain"),
    res("a_buyback", "country", "sf<=med", "(SELECT a.*, m.med FROM asafe a JOIN (SELECT country, median(sf) med FROM asafe WHERE oi0<0 GROUP BY 1) m ON m.country=a.country WHERE a.oi0>0)"),
    res("a_fin_view", "country", "line<>(n>=3)", "(SELECT country, group_id, count(*) n, count(*)>=3 AND regr_sxx(pb,roe3)>0 line FROM prof WHERE roe3 IS NOT NULL AND pb IS NOT NULL GROUP BY 1,2)")]))
CTES["capr"] = _ingest_sql.CAP_RANKING
CTES["asz"] = """SELECT s.stock_id, r.cap_rank, r.cap_usd, a.assets, (SELECT count(*) FROM stocks x WHERE x.country=s.country AND x.company=s.company) classes FROM stocks s LEFT JOIN capr r ON r.stock_id=s.stock_id
 LEFT JOIN (SELECT stock_id, arg_max(total_assets, period_end) assets FROM statements GROUP BY 1) a ON a.stock_id=s.stock_id WHERE s.is_active AND s.country='US'"""
CTES["asmp"] = "SELECT i.*, x.score FROM sinp i LEFT JOIN (SELECT stock_id, snapshot, max(score) score FROM ssc GROUP BY 1,2) x ON x.stock_id=i.stock_id AND x.snapshot=i.snapshot"
VAL = "EXISTS (SELECT 1 FROM sml m WHERE m.stock_id=x.stock_id AND m.snapshot=x.snapshot AND m.factor='value' AND m.raw_value IS NOT NULL)"
SQL["a_sample"] = compose(" UNION ALL ".join([
    res("a_halted", "country", "score IS NOT NULL", "(SELECT * FROM asmp WHERE halted)"),
    res("a_spinoff", "country", "v OR score IS NOT NULL", f"(SELECT x.*, {VAL} v FROM asmp x WHERE split_after)"),
    res("a_tags", "country", "score IS NULL AND ni0 IS NULL AND oi0 IS NULL", "(SELECT * FROM asmp WHERE family='general' AND end0 IS NOT NULL)"),
    res("a_adr", "'US'", "cap_usd>200*assets", "(SELECT * FROM asz WHERE assets>0 AND cap_usd IS NOT NULL)"),
    res("a_multiclass", "'US'", "cap_rank IS NULL", "(SELECT * FROM asz WHERE classes>1)")]))

CTES["avol"] = """SELECT i.stock_id, i.country, i.family, m.raw_value vol, c.end0, c.end2, c.rev0, c.rev1, c.rev2, c.oi0, c.oi1, c.oi2 FROM ain i JOIN sml m ON m.stock_id=i.stock_id AND m.snapshot=i.snapshot AND m.metric='volatility'
 LEFT JOIN ach c ON c.stock_id=i.stock_id"""
CTES["av90"] = """SELECT country, max(CASE WHEN k=floor(n*0.9) THEN vol END) v90, median(vol) vmed FROM (SELECT country, vol, row_number() OVER (PARTITION BY country ORDER BY vol)-1 k, count(*) OVER (PARTITION BY country) n
 FROM avol WHERE family='general' AND vol IS NOT NULL) GROUP BY 1"""
CTES["aodd"] = """SELECT t.country, t.preset, coalesce(rev2>rev1 AND rev1>rev0, false) OR coalesce((oi0 IS NOT NULL)::INT+(oi1 IS NOT NULL)::INT+(oi2 IS NOT NULL)::INT>=2 AND least(oi0,oi1,oi2)<=0, false)
 OR coalesce(t.preset='value' AND vol>=v90, false) odd FROM atop t JOIN avol v ON v.stock_id=t.stock_id LEFT JOIN av90 q ON q.country=t.country WHERE t.place<=10"""
CTES["agood"] = """SELECT v.country, s.score FROM avol v LEFT JOIN av90 q ON q.country=v.country LEFT JOIN slast s ON s.stock_id=v.stock_id AND s.preset='balanced'
 WHERE v.family='general' AND coalesce(least(oi0,oi1,oi2)>0 AND least(rev0,rev1,rev2)>0 AND oi1 IS NOT NULL AND oi2 IS NOT NULL AND pow(rev0/rev2, 1.0/((end0-end2)/365.25))-1>=0.03
 AND list_sort([oi0/rev0, oi1/rev1, oi2/rev2])[2]>=0.10 AND NOT (oi0>oi1+oi2) AND vol<=vmed*1.2, false)"""
SQL["a_r10"] = compose(res("a_r10_odd", P, "odd", "aodd") + " UNION ALL " + res("a_r10_good", "country", "score IS NULL OR score<50", "agood"))
CTES["aclip"] = f"""SELECT country, metric, g, z_adj FROM (SELECT country, metric, z_adj, raw_value*{_scoring.case_metric(1)} g, rank() OVER (PARTITION BY country, metric ORDER BY raw_value*{_scoring.case_metric(1)} DESC) pos,
 count(*) OVER (PARTITION BY country, metric) n FROM sneu WHERE family='general' AND snapshot=(SELECT max(snapshot) FROM snaps)) WHERE pos<=ceil(n*0.07)"""
CTES["aclip2"] = """SELECT country, metric, corr(ra, rb) rho, count(*) m, var_pop(ra) va, var_pop(rb) vb FROM (SELECT country, metric, rank() OVER (PARTITION BY country, metric ORDER BY g)+(count(*) OVER (PARTITION BY country, metric, g)-1)/2.0 ra,
 rank() OVER (PARTITION BY country, metric ORDER BY z_adj)+(count(*) OVER (PARTITION BY country, metric, z_adj)-1)/2.0 rb FROM aclip) GROUP BY 1,2"""
SQL["a_clip_order"] = compose(res("a_clip_order", "country", "rho<0.5", "(SELECT * FROM aclip2 WHERE m>=3 AND va>0 AND vb>0)", r("min(rho)", 4)))
