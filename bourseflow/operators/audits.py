"""Table audits. Each returns (rule_id, part, violations, detail); a rule with nothing to check returns no row or zero."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from bourseflow import constants as K
from bourseflow.functions.exprs import half_up, ratio
from bourseflow.functions.ranking import medians, with_average_rank, with_rank
from bourseflow.operators.scoring import metric_flag


def result(df: DataFrame, rule: str, part: Column | str, bad: Column, detail: Column | None = None) -> DataFrame:
    """Violations counted per part; `detail` is an aggregate (default: rows checked)."""
    p = F.col(part) if isinstance(part, str) else part
    return df.groupBy(p.cast("string").alias("part")).agg(
        F.count_if(F.coalesce(bad, F.lit(False))).alias("violations"), (detail if detail is not None else F.count(F.lit(1))).cast("double").alias("detail")
    ).select(F.lit(rule).alias("rule_id"), "part", "violations", "detail")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def classify(ok: Column, status: Column, decision: Column) -> Column:
    """passed / known_fail / target_fail / unverified / required_fail; a known failure needs a decision number."""
    return (F.when(ok.isNull(), "unverified").when(ok, "passed").when((status == "known_fail") & decision.isNotNull(), "known_fail")
            .when(status == "target", "target_fail").otherwise("required_fail"))


# ------------------------------------------------------------------ facts per stock
def facts(scores: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row per stock of the newest date: factor scores, composites and scores per preset, rank from the stored score."""
    keys = ["preset", "country", "family"]
    ranked = with_rank(scores.select("stock_id", *keys, "score"), keys, "score", rank="pos", total="n").select("stock_id", "preset", "pos", "n")
    j = scores.join(ranked, ["stock_id", "preset"], "left")
    one = lambda p, c: F.max(F.when(F.col("preset") == p, F.col(c)))
    wide = j.groupBy("stock_id").agg(
        *[F.max(f"{f}_score").alias(f"{f}_factor") for f in K.FACTORS],
        *[x for p in K.PRESETS for x in (one(p, "score").alias(f"{p}_percentile"), one(p, "pos").alias(f"{p}_rank"), one(p, "composite").alias(f"{p}_composite"))])
    return inputs.select("stock_id", "country", "family", "fy_count", "fy_end", "price_date").join(wide, "stock_id", "left")


def expectations(facts_df: DataFrame, cases: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """Named predicates over the facts of single stocks; a comparison with NULL is false.

    `cases`: case_id, stock_id, status, decision. Predicates are Spark expressions, evaluated by the engine."""
    checks = F.array(*[F.struct(F.lit(k).alias("case_id"), F.coalesce(F.expr(p), F.lit(False)).alias("ok")) for k, p in predicates.items()])
    evaluated = facts_df.select("stock_id", F.inline(checks))
    found = evaluated.join(F.broadcast(cases.select("case_id", "stock_id")), ["case_id", "stock_id"])
    j = cases.join(found, ["case_id", "stock_id"], "left")
    return j.select("case_id", "stock_id", classify(F.col("ok"), F.col("status"), F.col("decision")).alias("outcome"))


# ------------------------------------------------------------------ score rules
def score_formula(scores: DataFrame) -> DataFrame:
    """Stored score = 100 (n - rank) / n, and the 20-point band fits the top-percent band."""
    keys = ["preset", "country", "family"]
    r = with_rank(scores.select("stock_id", *keys, "score", "composite"), keys, "score", rank="pos", total="n")
    expect = F.when(F.col("n") > 1, F.lit(100.0) * (F.col("n") - F.col("pos")) / F.col("n")).otherwise(F.lit(50.0))
    top = F.lit(100.0) * F.col("pos") / F.col("n")
    band = F.when(top <= 20, 4).when(top <= 40, 3).when(top <= 60, 2).when(top <= 80, 1).otherwise(0)
    own = F.least(F.lit(4), F.floor(F.col("score") / 20).cast("int"))
    wrong_band = (F.col("n") > 1) & (own != band)
    return result(r, "a_r6_formula", "preset", F.abs(F.col("score") - expect) > 0.01).unionByName(result(r, "a_r6_band", "preset", wrong_band))


def score_order(scores: DataFrame) -> DataFrame:
    """A clearly larger composite never has the smaller score: per score value, compare composite ranges of neighbouring scores."""
    keys = ["preset", "country", "family"]
    per = scores.where("score IS NOT NULL").groupBy(*keys, "score").agg(F.max("composite").alias("hi"), F.min("composite").alias("lo"))
    w = Window.partitionBy(*keys).orderBy("score")           # at most ten thousand score values per group
    return result(per.withColumn("above", F.lead("lo").over(w)), "a_r6_order", "preset", F.col("hi") > F.col("above") + 2e-4)


def top(scores: DataFrame, n: int) -> DataFrame:
    """Top n of each preset and country in the general family, by stored score."""
    keys = ["preset", "country"]
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "stock_id")
    rows = scores.where("family = 'general' AND score IS NOT NULL").select(*keys, "stock_id", "score", "group_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def oneoff_cut(inputs: DataFrame, after_tax: float = K.AFTER_TAX) -> DataFrame:
    """Where profit far exceeds operating profit, the stored earnings are the cut ones and the stored metric uses them."""
    over = (F.col("ni0") > F.lit(1.2) * F.col("oi0")) & (F.col("oi0") > 0) & (F.col("family") != "financial")
    cy = F.filter("metrics", lambda m: m["metric"] == "conservative_yield")[0]["raw_value"]
    x = inputs.where(over & (F.col("mcap") > 0)).withColumn("got", cy).where("got IS NOT NULL")
    expect = F.col("e_cons") * F.coalesce("common_share", F.lit(1.0)) / F.col("mcap")
    cut = F.col("e_cons") <= F.lit(after_tax) * F.col("oi0") + 1e-6
    return result(x, "a_oneoff", "country", ~cut | (F.abs(F.col("got") - expect) > F.lit(1e-6) + F.lit(1e-4) * F.abs(expect)))


def top_mix(scores: DataFrame, inputs: DataFrame, chain: DataFrame, cyclical: DataFrame) -> DataFrame:
    """Turnarounds among growth leaders, shrinking revenue and cyclical themes among value leaders, uncut one-offs in any top ten."""
    c = chain.select("stock_id", "rev0", "rev1", "rev2", "oi2", "ni0", "oi0")
    cagr = inputs.select("stock_id", "country", "family", F.filter("metrics", lambda m: m["metric"] == "revenue_cagr2")[0]["raw_value"].alias("cagr"))
    med = medians(cagr.where("family = 'general'"), ["country"], "cagr", "med").drop("n")
    t20 = top(scores, 20).join(c, "stock_id").join(cagr.select("stock_id", "cagr"), "stock_id").join(F.broadcast(med), "country")
    t10 = top(scores, 10).join(c, "stock_id").join(cyclical.select("stock_id", "commodity_linked"), "stock_id", "left")
    part = F.concat_ws("/", "country", "preset")
    uncut = (F.col("ni0") > 0) & ((F.col("oi0") <= 0) | (F.col("ni0") > 2 * F.col("oi0")))
    return union([
        result(t10.join(inputs.select("stock_id", "e_cons", F.col("oi0").alias("o")), "stock_id"), "a_r1", part,
               uncut & (F.col("e_cons") > F.lit(K.AFTER_TAX) * F.col("o") + 1e-6)),
        result(t20.where("preset = 'growth'"), "a_r2", part, (F.col("oi2") < 0) & (F.coalesce("cagr", F.lit(-9.0)) <= F.col("med"))),
        result(t20.where("preset = 'value'"), "a_r3", part, (F.col("rev0") < F.col("rev1")) & (F.col("rev1") < F.col("rev2"))),
        result(t10.where("preset = 'value'"), "a_r4", part, F.col("commodity_linked"))])


def badge_rules(inputs: DataFrame, badges: DataFrame, scores: DataFrame) -> DataFrame:
    """Every scored stock with an odd year end carries the badge; share of scored stocks with any badge (limit 30%)."""
    scored = scores.where("score IS NOT NULL").select("stock_id", "snapshot").distinct()
    b = badges.join(scored, ["stock_id", "snapshot"], "left_semi").join(inputs.select("stock_id", "snapshot", "fy_end"), ["stock_id", "snapshot"])
    has = lambda code: F.exists("badges", lambda x: x["code"] == code)
    odd = F.abs(F.datediff("fy_end", "mode_end")) > K.FISCAL_GAP_DAYS
    share = ratio(F.count_if(F.size("badges") > 0), F.count(F.lit(1)))
    r7 = b.groupBy("country").agg(half_up(share, 4).alias("detail")).select(
        F.lit("a_r7").alias("rule_id"), F.col("country").alias("part"), (F.col("detail") > 0.30).cast("long").alias("violations"), "detail")
    wording = b.select("country", F.explode("badges").alias("x"))
    return union([result(b, "a_r5", "country", odd & ~has("fiscal_gap")), r7,
                  result(wording, "a_badge_wording", "country", ~F.col("x.code").isin("oneoff", "fiscal_gap", "short_history"))])


def weight_stability(scores: DataFrame, n: int = 10) -> DataFrame:
    """Overlap of the top n when one weight moves by 0.1 and the others share the rest; fewer than seven in common is a violation.

    The scenarios are a short parameter list exploded per row; each scenario keeps only its top n per task."""
    scenarios = []
    for p, ws in K.PRESETS.items():
        w = dict(zip(K.FACTORS, ws))
        for f in K.FACTORS:
            for step in (0.1, -0.1):
                if 0 <= w[f] + step <= 1:
                    moved = {k: (w[f] + step if k == f else w[k] * (1 - w[f] - step) / (1 - w[f])) for k in K.FACTORS}
                    scenarios.append((p, f"{f}{step:+.1f}", moved))
        scenarios.append((p, "base", w))
    arr = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(s).alias("s"), *[F.lit(float(m[f])).alias(f) for f in K.FACTORS]) for p, s, m in scenarios])
    rows = scores.where("family = 'general' AND composite IS NOT NULL").withColumn("x", F.explode(arr)).where("x.p = preset")
    comp = half_up(reduce(lambda a, b: a + b, [F.col(f"x.{f}") * F.coalesce(f"{f}_score", F.lit(0.0)) for f in K.FACTORS]), 8)
    w = Window.partitionBy("country", "preset", "s").orderBy(F.desc("c"), "stock_id")
    best = rows.select("country", "preset", F.col("x.s").alias("s"), "stock_id", comp.alias("c")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    base = best.where("s = 'base'").select("country", "preset", "stock_id", F.lit(1).alias("hit"))
    common = (best.where("s <> 'base'").join(base, ["country", "preset", "stock_id"], "left").groupBy("country", "preset", "s")
              .agg(F.sum(F.coalesce("hit", F.lit(0))).alias("common")))
    return result(common, "a_r8", F.concat_ws("/", "country", "preset"), F.col("common") < 7, F.min("common"))


def lost_scores(now: DataFrame, before: DataFrame, has_statements: DataFrame) -> DataFrame:
    """Stocks scored by the model version before that have statements but no score now (families without scores aside)."""
    had = before.where("score IS NOT NULL").select("stock_id").distinct()
    n = now.groupBy("stock_id", "country", "family").agg(F.max("score").alias("score"), F.bool_or("has_required").alias("req"))
    j = had.join(n, "stock_id").join(has_statements.select("stock_id").distinct().withColumn("fin", F.lit(True)), "stock_id", "left")
    return result(j, "a_r9", "country", F.col("score").isNull() & F.coalesce("fin", F.lit(False)) & (F.col("family") == "general") & ~F.col("req"))


def independent(scores: DataFrame, inputs: DataFrame, chain: DataFrame) -> DataFrame:
    """Leaders that look odd by outside criteria (three falling revenues, an operating loss, volatility above the 90th percent
    value by position) and good companies (growth, margin, calm price) that score below 50."""
    vol = inputs.select("stock_id", "country", "family", F.filter("metrics", lambda m: m["metric"] == "volatility")[0]["raw_value"].alias("vol"))
    g = vol.where("family = 'general' AND vol IS NOT NULL")
    ranked = with_average_rank(g, ["country"], "vol", rank="avg_rank", total="n")
    from bourseflow.functions.ranking import positions
    pos = positions(g, ["country"], "vol")
    at = F.floor(F.col("n") * F.lit(0.9))
    v90 = pos.where((F.col("less") <= at) & (at < F.col("less") + F.col("ties"))).select("country", F.col("vol").alias("v90"))
    med = medians(ranked, ["country"], "vol", "vmed").drop("n")
    c = chain.select("stock_id", "end0", "end2", *[f"{x}{i}" for x in ("rev", "oi") for i in range(3)])
    j = vol.join(c, "stock_id", "left").join(F.broadcast(v90.join(med, "country")), "country", "left")
    falling = (F.col("rev2") > F.col("rev1")) & (F.col("rev1") > F.col("rev0"))
    known = [F.col(f"oi{i}").isNotNull().cast("int") for i in range(3)]
    loss = ((known[0] + known[1] + known[2]) >= 2) & (F.least("oi0", "oi1", "oi2") <= 0)
    t10 = top(scores, 10).join(j.drop("country", "family"), "stock_id")
    odd = F.coalesce(falling, F.lit(False)) | F.coalesce(loss, F.lit(False)) | F.coalesce((F.col("preset") == "value") & (F.col("vol") >= F.col("v90")), F.lit(False))
    years = F.datediff("end0", "end2") / F.lit(365.25)
    cagr = F.when((F.col("rev2") > 0) & (F.col("rev0") > 0), F.pow(F.col("rev0") / F.col("rev2"), F.lit(1.0) / years) - 1)
    margin = F.array_sort(F.array(*[ratio(f"oi{i}", f"rev{i}") for i in range(3)]))[1]
    good = ((F.least("oi0", "oi1", "oi2") > 0) & (F.least("rev0", "rev1", "rev2") > 0) & F.col("oi1").isNotNull() & F.col("oi2").isNotNull()
            & (cagr >= 0.03) & (margin >= 0.10) & ~(F.col("oi0") > F.col("oi1") + F.col("oi2")) & (F.col("vol") <= F.col("vmed") * 1.2))
    bal = scores.where(F.col("preset") == "balanced").select("stock_id", "score")
    goods = j.where((F.col("family") == "general") & F.coalesce(good, F.lit(False))).join(bal, "stock_id", "left")
    return union([result(t10, "a_r10_odd", F.concat_ws("/", "country", "preset"), odd),
                  result(goods, "a_r10_good", "country", F.col("score").isNull() | (F.col("score") < 50))])


def penalty_only(values: DataFrame) -> DataFrame:
    return result(values.where("metric = 'trap_signal'"), "a_trap", "country", F.col("z_adj") > 0)


def clip_order(values: DataFrame, share: float = 0.07, keep=lambda name, df: df) -> DataFrame:
    """Spearman correlation of raw value and final z inside the top 7% of each metric; below 0.5 is a violation."""
    keys = ["country", "metric"]
    v = values.where("family = 'general' AND z_adj IS NOT NULL").withColumn("good", F.col("raw_value") * metric_flag(1)).select("stock_id", *keys, "good", "z_adj")
    r = with_rank(v, keys, "good", rank="pos", total="n").where(F.col("pos") <= F.ceil(F.col("n") * F.lit(share)))
    r = keep("clip leaders", r)
    a = with_average_rank(r.select("stock_id", *keys, "good", "z_adj"), keys, "good", rank="ra", total="m")
    b = with_average_rank(a.select("stock_id", *keys, "z_adj", "ra"), keys, "z_adj", rank="rb", total="m")
    rho = b.groupBy(*keys).agg(ratio(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")).alias("rho"), F.count(F.lit(1)).alias("m"), F.var_pop("ra").alias("va"), F.var_pop("rb").alias("vb"))
    rho = rho.where("m >= 3 AND va > 0 AND vb > 0")
    return result(rho, "a_clip_order", "country", F.col("rho") < 0.5, half_up(F.min("rho"), 4))


def same_price_date(inputs: DataFrame, scores: DataFrame) -> DataFrame:
    """Scored general stocks of a country and date share one price date (the number of extra dates is reported)."""
    ok = scores.where("family = 'general' AND score IS NOT NULL").select("stock_id", "snapshot").distinct()
    x = inputs.join(ok, ["stock_id", "snapshot"], "left_semi").groupBy("country", "snapshot", "price_date").agg(F.count(F.lit(1)).alias("c"))
    return x.groupBy(F.concat_ws("/", "country", F.col("snapshot").cast("string")).alias("part")).agg(
        (F.count(F.lit(1)) - 1).alias("violations"), F.sum("c").cast("double").alias("detail")).select(F.lit("a_price_same_date").alias("rule_id"), "part", "violations", "detail")


def theme_position_diff(stored: DataFrame, again: DataFrame) -> DataFrame:
    """Rows that differ between the served theme ranks and an independent computation, both ways."""
    cols = ["snapshot", "country", "family", "group_id", "factor", "position", "total"]
    a, b = stored.select(*cols), again.select(*cols)
    diff = a.exceptAll(b).withColumn("side", F.lit("extra")).unionByName(b.exceptAll(a).withColumn("side", F.lit("missing")))
    base = stored.select(F.col("country"), F.lit("checked").alias("side"))
    return result(diff.select("country", "side").unionByName(base), "a_theme_position", "country", F.col("side") != "checked")


def weak_theme_leaders(scores: DataFrame, raw: DataFrame, n: int = 20, share: float = 0.3) -> DataFrame:
    """Leaders of themes whose raw mean composite is in the lowest 30% that still reach the top 20. `raw`: composites from z_raw."""
    keys = ["country", "preset", "group_id"]
    m = scores.where("family = 'general' AND score IS NOT NULL AND group_id IS NOT NULL").select("stock_id", *keys, "score").join(
        raw.select("stock_id", "preset", F.col("composite_full").alias("raw_c")), ["stock_id", "preset"]).where("raw_c IS NOT NULL")
    th = m.groupBy(*keys).agg(half_up(F.avg("raw_c"), 8).alias("mean"), F.count(F.lit(1)).alias("k"), F.max_by("stock_id", F.struct("score", (-F.col("stock_id")).alias("t"))).alias("stock_id")).where("k >= 2")
    w = Window.partitionBy("country", "preset")               # a few dozen themes
    weak = th.withColumn("o", F.row_number().over(w.orderBy("mean", "group_id"))).withColumn("t", F.count(F.lit(1)).over(w)).where(F.col("o") <= F.ceil(F.col("t") * F.lit(share)))
    hit = top(scores, n).select("country", "preset", "stock_id").join(weak.select("country", "preset", "stock_id", F.lit(True).alias("weak")), ["country", "preset", "stock_id"], "left")
    return result(hit, "a_weak_theme", F.concat_ws("/", "country", "preset"), F.coalesce("weak", F.lit(False)))


# ------------------------------------------------------------------ data rules
def unit_rules(inputs: DataFrame, metrics: DataFrame, annual: DataFrame) -> DataFrame:
    """Currency unit (filed against quoted per-share values, factor 50), negative book without B/P, common-share basis, zero equity."""
    def cell(name: str) -> Column:
        return F.filter("metrics", lambda x: x["metric"] == name)[0]["raw_value"]

    x = (inputs.join(metrics.select("stock_id", "eps", "bps", "shares_outstanding"), "stock_id", "left")
         .withColumn("bp", cell("book_yield")).withColumn("cy", cell("conservative_yield")))
    off = lambda quoted, filed: (lambda q: (q > 50) | (q < 1 / 50))(ratio(F.col(quoted) * F.col("shares_outstanding"), filed))
    unit = (F.col("eps") * F.col("ni0") > 0) & off("eps", "ni0")
    neg = F.coalesce(F.array_contains(F.transform(F.filter("metrics", lambda m: m["metric"] == "book_yield"), lambda m: m["null_note"]), "negative equity"), F.lit(False))
    expect = F.col("e_cons") * F.col("common_share") / F.col("mcap")
    lp = (F.col("total_equity") == 0) & (F.col("total_assets") - F.col("total_debt") != 0)
    return union([
        result(x.where("country = 'KR'"), "a_currency", "country", unit), result(x.where(neg), "a_neg_equity", "country", F.col("bp").isNotNull()),
        result(x.where("common_share IS NOT NULL AND cy IS NOT NULL"), "a_preferred", "country", F.abs(F.col("cy") - expect) > F.lit(1e-6) + F.lit(1e-4) * F.abs(expect)),
        result(annual, "a_lp_equity", F.lit("FY"), lp)])


def family_rules(scores: DataFrame, board: DataFrame) -> DataFrame:
    """The financial family has no composite; home lists never mix families."""
    mixed = board.join(scores.select("stock_id", F.col("family").alias("own")).distinct(), "stock_id")
    return union([result(scores.where("family = 'financial'"), "a_fin_family", "country", F.col("composite").isNotNull() | F.col("score").isNotNull()),
                  result(mixed, "a_home_mix", "country", F.col("family") != F.col("own"))])


def theme_rules(assigned: DataFrame, expected: DataFrame, leaders: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Expected primary themes; leaders whose theme nobody reviewed (recorded only)."""
    e = F.broadcast(expected).join(assigned.select("stock_id", "theme"), "stock_id", "left")
    u = leaders.join(reviewed.select("stock_id").withColumn("seen", F.lit(True)), "stock_id", "left")
    return union([result(e, "a_theme_expected", F.lit("all"), ~F.col("theme").eqNullSafe(F.col("expected"))),
                  result(u, "a_top20_unreviewed", F.concat_ws("/", "country", "preset"), F.col("seen").isNull())])


def history_rules(inputs: DataFrame, scores: DataFrame, chain: DataFrame, fit: DataFrame, min_n: int) -> DataFrame:
    """Three chained years; profitable companies with negative equity rank safer than the distressed median; a line only from n points on."""
    s = scores.where(F.col("preset") == K.DEFAULT_PRESET).select("stock_id", "safety_score")
    x = inputs.select("stock_id", "country", "family").join(chain.select("stock_id", "oi0", "ta0", "debt0"), "stock_id").join(s, "stock_id").where("family = 'general' AND debt0 >= ta0 AND safety_score IS NOT NULL")
    med = medians(x.where("oi0 < 0"), ["country"], "safety_score", "med").drop("n")
    good = x.where("oi0 > 0").join(F.broadcast(med), "country")
    groups = fit.select("country", "group_id", "n", "method").where("n IS NOT NULL").distinct()
    return union([result(inputs, "a_history", "country", F.col("fy_count") < 3), result(good, "a_buyback", "country", F.col("safety_score") <= F.col("med")),
                  result(groups, "a_fin_view", "country", (F.col("method") == "regression") != (F.col("n") >= min_n))])


def path_rules(annual: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Statement source is one of the allowed paths; no year is missing without a note. `annual`: stock_id, country, period_end, notes."""
    path = F.regexp_extract(F.split_part(F.coalesce("notes", F.lit("")), F.lit(";"), F.lit(1)), r"^path=(\w+)", 1)
    w = Window.partitionBy("stock_id").orderBy("period_end")
    gap = F.datediff("period_end", F.lag("period_end").over(w)) > 400
    x = annual.withColumn("path", path).withColumn("gap", gap)
    return union([result(x, "a_data_path", "country", ~F.col("path").isin(*allowed)),
                  result(x, "a_year_gap", "country", F.col("gap") & ~F.coalesce(F.col("notes").contains("no prior year"), F.lit(False)))])


def sample_rules(inputs: DataFrame, scores: DataFrame, ranked: DataFrame) -> DataFrame:
    """Halted and split stocks have no score; ranked value is at most 200 times assets; every company of several share classes is ranked;
    stocks with statements are not lost for missing tags."""
    s = scores.groupBy("stock_id", "snapshot").agg(F.max("score").alias("score"))
    x = inputs.join(s, ["stock_id", "snapshot"], "left")
    value = F.exists("metrics", lambda m: (m["factor"] == "value") & m["raw_value"].isNotNull())
    return union([
        result(x.where("halted"), "a_halted", "country", F.col("score").isNotNull()),
        result(x.where("split_after"), "a_spinoff", "country", value | F.col("score").isNotNull()),
        result(x.where("family = 'general' AND fy_end IS NOT NULL"), "a_tags", "country", F.col("score").isNull() & F.col("ni0").isNull() & F.col("oi0").isNull()),
        result(ranked.where("assets > 0 AND cap_usd IS NOT NULL"), "a_adr", F.lit("US"), F.col("cap_usd") > 200 * F.col("assets")),
        result(ranked.where("classes > 1"), "a_multiclass", F.lit("US"), F.col("cap_rank").isNull())])


def row_rules(df: DataFrame, **rules: str) -> DataFrame:
    """Rows that break each rule, all rules of a table in one aggregate. Names are written with underscores for blanks."""
    n = F.count(F.lit(1)).cast("double").alias("detail")
    counts = df.agg(n, *[F.count_if(F.coalesce(F.expr(bad), F.lit(False))).alias(k) for k, bad in rules.items()])
    parts = F.array(*[F.struct(F.lit(k.replace("_", " ")).alias("part"), F.col(k).alias("violations")) for k in rules])
    return counts.select("detail", F.inline(parts)).select(F.lit("a_constraints").alias("rule_id"), "part", "violations", "detail")


def by_key(df: DataFrame, *keys: str, total: str | None = None, **rules: str) -> DataFrame:
    """One row per key: how many rows have it (`c`), how many of them break each rule, and the sum of a column. All checks of a derived
    table read this, so the table is made once."""
    more = [F.sum(total).alias(total)] if total else []
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), *more, *[F.count_if(F.coalesce(F.expr(bad), F.lit(False))).alias(k) for k, bad in rules.items()])


def key_rules(counted: DataFrame, key: str, *rules: str) -> DataFrame:
    """The audit rows of a table counted by `by_key`: keys that come more than once (of all keys) and rows that break each rule (of all rows)."""
    name = lambda k: F.lit(k.replace("_", " ")).alias("part")
    none = F.lit(0).cast("long")
    sums = counted.agg(F.coalesce(F.sum("c"), none).alias("rows"), F.count(F.lit(1)).alias("keys"), F.count_if(F.col("c") > 1).alias("again"),
                       *[F.coalesce(F.sum(k), none).alias(k) for k in rules])
    parts = F.array(F.struct(name(key), F.col("again").alias("violations"), F.col("keys").cast("double").alias("detail")),
                    *[F.struct(name(k), F.col(k).alias("violations"), F.col("rows").cast("double").alias("detail")) for k in rules])
    return sums.select(F.inline(parts)).select(F.lit("a_constraints").alias("rule_id"), "part", "violations", "detail")


def constraints(t, scores_weights: DataFrame, scores: DataFrame, keep=lambda name, df: df) -> DataFrame:
    """Declared CHECK, UNIQUE and foreign-key rules of the tables, plus row-level rules that span rows.

    `keep` may store an intermediate table that several rules read."""
    rows = []

    def unique(name: str, df: DataFrame, *keys: str) -> None:
        rows.append(row_rules(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")), **{name.replace(" ", "_"): "c > 1"}))

    def refers(name: str, df: DataFrame, dim: DataFrame, key: str) -> None:
        lost = df.select(key).where(F.col(key).isNotNull()).groupBy(key).agg(F.lit(1).alias("o")).join(dim.select(key).distinct().withColumn("k", F.lit(1)), key, "left")
        rows.append(row_rules(lost, **{name.replace(" ", "_"): "k IS NULL"}))

    rows.append(row_rules(t.prices, price_range="high < low OR low <= 0 OR close < low OR close > high", volume_sign="volume < 0",
                          open_range="open < low OR open > high"))
    rows.append(row_rules(t.logs, log_times="finished_at < started_at", log_status="status NOT IN ('SUCCESS', 'FAILED', 'SKIPPED')",
                          failed_without_text="status = 'FAILED' AND error IS NULL"))
    rows.append(row_rules(t.fx, fx_positive="usd_krw <= 0", fx_kind="granularity NOT IN ('DAILY', 'SNAPSHOT')"))
    items = keep("items", by_key(t.items, "portfolio_id", "stock_id", total="cost_krw", position="quantity <= 0 OR ref_price <= 0 OR ref_fx_rate <= 0"))
    rows.append(key_rules(items, "item key", "position"))
    watched = keep("watchlist", by_key(t.watchlist, "user_id", "stock_id"))
    rows.append(key_rules(watched, "watch key"))
    valuations = by_key(t.valuations, "stock_id", "as_of", valuation_signs="per <= 0 OR pbr <= 0", valuation_shares="shares_outstanding <= 0", market_value="market_cap < 0")
    rows.append(key_rules(valuations, "valuation key", "valuation_signs", "valuation_shares", "market_value"))
    rows.append(row_rules(t.statements, assets_sign="total_assets < 0", period_kind="period_type <> 'FY'"))
    rows.append(key_rules(by_key(t.index_prices, "index_id", "trade_date", index_close="close <= 0"), "index key", "index_close"))
    rows.append(row_rules(t.disclosures, filing_fields="title IS NULL OR filed_at IS NULL", filing_source="data_source NOT IN ('DART', 'SEC', 'KIND')"))
    rows.append(row_rules(t.stocks, coverage_kind="coverage NOT IN ('listed', 'benchmark', 'featured')", share_ratio="share_ratio <= 0"))
    rows.append(row_rules(scores, score_range="score < 0 OR score > 100", score_without_composite="score IS NOT NULL AND composite IS NULL"))
    unique("price key", t.prices, "stock_id", "trade_date")
    unique("fx key", t.fx, "granularity", "rate_at")
    unique("stock key", t.stocks, "market", "ticker")
    unique("one primary theme", t.members.where("is_primary"), "stock_id")
    unique("receipt number", t.disclosures, "rcept_no")
    unique("statement key", t.statements, "stock_id", "period_end", "period_type")
    unique("score key", scores, "stock_id", "preset", "snapshot")
    refers("price stock", t.prices, t.stocks, "stock_id")
    refers("filing stock", t.disclosures, t.stocks, "stock_id")
    refers("member theme", t.members, t.groups, "group_id")
    refers("item stock", items, t.stocks, "stock_id")
    refers("watch stock", watched, t.stocks, "stock_id")
    weights = scores_weights.groupBy("preset").agg(F.sum(F.col("weight").cast("decimal(6,3)")).alias("w"))
    rows.append(row_rules(weights, weights="w <> 1"))
    used = items.groupBy("portfolio_id").agg(F.sum("cost_krw").alias("used")).join(t.portfolios, "portfolio_id")
    rows.append(row_rules(used, seed="used > seed_krw"))
    return union(rows)
