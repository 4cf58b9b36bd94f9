"""Multi-factor scores for all stocks and any number of scoring dates in one job.

Stages: metric inputs -> rank-normal z (by date, country, family, metric) -> theme neutralisation -> factor scores ->
preset composites -> percentile score. The scoring date is part of every key, so dates run side by side.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from bourseflow import constants as K
from bourseflow.functions.exprs import clamp, dbl, half_up, normal_quantile, ratio
from bourseflow.functions.ranking import insert_positions, with_average_rank, with_rank
from bourseflow.operators.point_in_time import as_of_rows

KEY = ("stock_id", "snapshot")


# ------------------------------------------------------------------ inputs
def trading_calendar_cut(bars: DataFrame, sample: DataFrame, dates: Sequence, sessions: int = 21, days: int = 120) -> DataFrame:
    """Per country and date: the 21st most recent session; a stock whose last bar is older has stopped trading."""
    held = (bars.select("stock_id", "trade_date").join(sample.select("stock_id", "country"), "stock_id")
            .groupBy("country", "trade_date").agg(F.lit(1).alias("one")).drop("one"))
    return (as_of_rows(held, "trade_date", dates, ("country",), cut_date=lambda w: F.lag("trade_date", sessions - 1).over(w))
            .where(F.col("cut_date") >= F.date_sub("snapshot", days)).select("country", "snapshot", "cut_date"))


def fiscal_chain(annual: DataFrame, dates: Sequence) -> DataFrame:
    """t, t-1 and t-2 on every date: usable annual statements whose ends are 330 to 400 days apart.

    A stock has a handful of fiscal years, so its years are gathered once and the chain of each year is read from that short array;
    a date picks the newest year that it sees."""
    usable = annual.where("period_type = 'FY' AND total_assets IS NOT NULL AND (net_income IS NOT NULL OR operating_income IS NOT NULL)")
    year = F.struct(F.col("period_end").alias("end"), dbl("revenue").alias("rev"), dbl("operating_income").alias("oi"),
                    dbl("net_income").alias("ni"), dbl("total_assets").alias("ta"), dbl("total_debt").alias("debt"),
                    dbl("total_equity").alias("eq"))
    years = usable.groupBy("stock_id").agg(F.sort_array(F.collect_list(year), asc=False).alias("years"))

    def before(end: Column) -> Column:
        return F.get(F.filter("years", lambda y: F.datediff(end, y["end"]).between(330, 400)), 0)

    chained = (years.withColumn("t0", F.explode("years")).withColumn("t1", before(F.col("t0.end")))
               .withColumn("t2", before(F.col("t1.end"))))
    parts = [F.col(f"t{i}.{f}").alias(f"{f}{i}") for i in range(3) for f in ("end", "rev", "oi", "ni", "ta", "debt", "eq")]
    return as_of_rows(chained.select("stock_id", *parts), "end0", dates)


def score_inputs(price: DataFrame, valuation: DataFrame, chain: DataFrame, members: DataFrame, cut: DataFrame,
                 actions: DataFrame, after_tax: float = K.AFTER_TAX) -> DataFrame:
    """One row per stock and scoring date: the ten raw metrics with their notes, plus the facts later steps need.

    `members` holds stock_id, ticker, country, family, group_id of the stocks to measure; `actions` the corporate actions
    (ticker, country, done) after which old statements must not be divided by new prices."""
    j = (price.join(members.where("family <> 'none'"), "stock_id")
         .join(valuation, list(KEY), "left").join(chain, list(KEY), "left")
         .join(F.broadcast(cut), ["country", "snapshot"], "left")
         .join(F.broadcast(actions), ["ticker", "country"], "left"))
    c = F.col
    fin = c("family") == "financial"

    def earn(i: int) -> Column:
        ni, oi = c(f"ni{i}"), c(f"oi{i}") * F.lit(after_tax)
        return F.when(fin | c(f"oi{i}").isNull(), ni).when(c(f"ni{i}").isNull(), oi).otherwise(F.least(ni, oi))

    def flag(cond: Column) -> Column:
        return F.coalesce(cond.cast("int"), F.lit(0))

    j = j.withColumns({"close": dbl("close"), "shares": dbl("shares_outstanding")}).withColumns({
        "mcap": F.coalesce(dbl("market_cap"), c("shares") * c("close")), "fin": fin,
        "halted": F.coalesce(c("as_of") < c("cut_date"), F.lit(False)),
        "fy_count": F.when(c("end0").isNull(), 0).when(c("end1").isNull(), 1).when(c("end2").isNull(), 2).otherwise(3),
        "e0": earn(0), "e1": earn(1), "e2": earn(2),
        "p0": F.when(fin, c("ni0")).otherwise(c("oi0")), "p2": F.when(fin, c("ni2")).otherwise(c("oi2")),
        "la0": ratio("debt0", "ta0"), "la2": ratio("debt2", "ta2")})
    three = (c("fy_count") == 3) & c("e1").isNotNull() & c("e2").isNotNull()
    was_profit = c("oi2") > 0
    margins = was_profit & (c("rev0") > 0) & (c("rev2") > 0)
    counted = (flag(c("oi0").isNotNull()) + flag(c("oi0").isNotNull() & was_profit)
               + flag(c("rev0").isNotNull() & c("rev2").isNotNull()) + flag(c("oi0").isNotNull() & margins)
               + flag(c("la0").isNotNull() & c("la2").isNotNull()))
    good = (flag(c("oi0") > 0) + flag(was_profit & (c("oi0") > c("oi2"))) + flag(c("rev0") > c("rev2"))
            + flag(margins & (ratio("oi0", "rev0") > ratio("oi2", "rev2"))) + flag(c("la0") < c("la2")))
    implied = ratio("eq0", "bps")
    j = j.withColumns({
        "e_cons": F.when(three, F.least(c("e0"), (c("e0") + c("e1") + c("e2")) / F.lit(3.0))).otherwise(c("e0")),
        "sig_n": counted, "sig_yes": good,
        "neg_book": F.coalesce(c("eq0") <= 0, F.lit(False)) | F.coalesce(c("bps") <= 0, F.lit(False)),
        "common_share": F.when((c("country") == "KR") & (c("shares") > 0) & (c("eq0") > 0) & (c("bps") > 0)
                               & (implied > F.lit(1.03) * c("shares")), ratio(c("shares"), implied)),
        "split_after": F.coalesce(c("done") > c("end0"), F.lit(False))})
    j = j.withColumn("value_rules", flag(three) + flag(c("end2").isNotNull() & (fin | (c("sig_n") >= 3))))
    has2 = c("end2").isNotNull()
    raw = {
        "conservative_yield": F.when(c("mcap") > 0, c("e_cons") * F.coalesce(c("common_share"), F.lit(1.0)) / c("mcap")),
        "book_yield": F.when(~c("neg_book"), ratio("bps", "close")),
        "trap_signal": F.when(~fin & has2 & (c("sig_n") >= 3), ratio("sig_yes", "sig_n")),
        "return_on_assets": F.when(c("ta0") > 0, ratio("p0", "ta0")),
        "operating_margin": F.when(~fin, ratio("oi0", "rev0")),
        "revenue_cagr2": F.when(~fin & has2 & (c("rev2") > 0) & c("rev0").isNotNull(),
                                F.when(c("rev0") > 0, F.sqrt(ratio("rev0", "rev2")) - 1).otherwise(F.lit(-1.0))),
        "profit_growth2": F.when(has2 & (c("ta2") > 0) & (c("p2") > 0) & c("p0").isNotNull(),
                                 ratio(c("p0") - c("p2"), c("ta2"))),
        "volatility": c("volatility_1y"),
        "liab_assets": F.when(~fin, c("la0")),
        "momentum": F.when(c("c_252").isNotNull(), ratio("c_21", "c_252") - 1)
                     .when(c("c_126").isNotNull(), ratio("c_21", "c_126") - 1),
    }
    notes = {
        "conservative_yield": F.when(c("e_cons").isNotNull() & (c("mcap") > 0), F.nullif(F.concat_ws(
            "; ", F.when(c("fy_count") < 3, F.concat(F.lit("short history "), c("fy_count").cast("string")))
                   .when(c("e_cons") < c("e0"), F.lit("three-year mean")),
            F.when(c("common_share").isNotNull(), F.concat(F.lit("common share "),
                   F.round(c("common_share").cast("decimal(38,10)") * 100, 0).cast("int").cast("string"), F.lit("%")))), F.lit(""))),
        "momentum": F.when(c("c_252").isNull() & c("c_126").isNotNull(), F.lit("six months instead of twelve")),
    }
    fin_only = F.when(fin, F.lit("financial"))
    blanks = {
        "book_yield": F.when(c("neg_book"), F.lit("negative equity"))
                       .when(c("eq0").isNull() & c("bps").isNull(), F.lit("no equity")),
        "trap_signal": fin_only, "operating_margin": fin_only, "revenue_cagr2": fin_only, "liab_assets": fin_only,
        "profit_growth2": F.when(has2 & (c("p2") <= 0), F.lit("loss two years ago")),
    }
    none = F.lit(None).cast("string")

    def metric(name: str) -> Column:
        factor = K.METRICS[name][0]
        cut_off = c("halted") | c("split_after") if factor == "value" else c("halted")
        why = F.when(c("halted"), F.lit("halted"))
        if factor == "value":
            why = why.when(c("split_after"), F.lit("corporate action"))
        return F.struct(F.lit(name).alias("metric"), F.lit(factor).alias("factor"),
                        F.when(~cut_off, raw[name]).alias("raw_value"),
                        F.when(~cut_off, notes.get(name, none)).alias("note"),
                        why.otherwise(blanks.get(name, none)).alias("null_note"))

    return j.select(*KEY, "country", "family", "group_id", "coverage", F.col("as_of").alias("price_date"), "fy_count", "value_rules",
                    F.col("end0").alias("fy_end"), "ni0", "oi0", "ni1", "oi1", "ni2", "oi2", "e_cons", "common_share", "mcap",
                    "halted", "split_after", F.array(*[metric(m) for m in K.METRICS]).alias("metrics"))


def metrics_long(inputs: DataFrame) -> DataFrame:
    """Ten rows per stock and date."""
    return inputs.select(*KEY, "country", "family", "group_id", F.explode("metrics").alias("m")).select(
        *KEY, "country", "family", "group_id", "m.*")


# ------------------------------------------------------------------ standardise, neutralise, aggregate
def metric_flag(position: int) -> Column:
    """A property of the metric table as an expression over the metric name."""
    pairs = [x for m, spec in K.METRICS.items() for x in (F.lit(m), F.lit(spec[position]))]
    return F.create_map(*pairs)[F.col("metric")]


def rank_normal(long: DataFrame) -> DataFrame:
    """p = (average rank - 1/2) / n inside date x country x family x metric, z = quantile(p) in the metric's direction."""
    ranked = with_average_rank(long, ["snapshot", "country", "family", "metric"], "raw_value")
    z = normal_quantile(F.col("p")) * metric_flag(1)
    return (ranked.withColumn("p", (F.col("rank") - F.lit(0.5)) / F.col("n"))
            .withColumn("z_raw", half_up(F.when(metric_flag(3), F.least(F.lit(0.0), z)).otherwise(z), 4)).drop("rank", "n"))


def neutralize(ranked: DataFrame, k: int = K.SHRINKAGE_K) -> DataFrame:
    """Take out n/(n+k) of the theme mean (same date, country, theme, metric) and clamp to +-3."""
    keys = ["snapshot", "country", "group_id", "metric"]
    stats = (ranked.where(F.col("group_id").isNotNull()).groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("gn"), F.sum(F.col("z_raw").cast("decimal(10,4)")).cast("double").alias("gs")))
    # themes x countries x metrics x dates: a few thousand rows whatever the number of stocks
    j = ranked.join(stats, keys, "left")
    shifted = F.col("z_raw") - F.col("gn") / (F.col("gn") + F.lit(k)) * (F.col("gs") / F.col("gn"))
    plain = ~metric_flag(4) | F.col("group_id").isNull() | (F.col("gn") == 1)
    return j.withColumn("z_adj", F.when(plain, F.col("z_raw")).otherwise(half_up(clamp(shifted, -3.0, 3.0), 4))).drop("gn", "gs")


def factor_means(values: DataFrame, z: str) -> DataFrame:
    """Weighted mean of the metrics of one factor, one column per factor."""
    w = metric_flag(2)
    v = F.col(z).cast("decimal(10,4)")

    def mean(f: str) -> Column:
        mine = (F.col("factor") == f) & F.col(z).isNotNull()
        return ratio(F.sum(F.when(mine, v * w)), F.sum(F.when(mine, w)))

    return values.groupBy(*KEY).agg(*[mean(f).alias(f"{f}_f") for f in K.FACTORS])


def value_shrink(rules: Column) -> Column:
    return F.when(rules >= 2, F.lit(1.0)).otherwise((F.coalesce(rules, F.lit(0)) + 1) / F.lit(3.0))


def factor_table(values: DataFrame, inputs: DataFrame, z: str = "z_adj") -> DataFrame:
    """Factor scores before re-standardising, with the value factor shrunk when its safeguards could not be used."""
    f = inputs.select(*KEY, "country", "family", "group_id", "value_rules").join(factor_means(values, z), list(KEY), "left")
    return f.withColumn("value_f", F.col("value_f") * value_shrink(F.col("value_rules")))


def standardize(factors: DataFrame, distribution: DataFrame | None = None) -> DataFrame:
    """Mean 0 and sample deviation 1 per factor inside date x country x family (a handful of groups)."""
    keys = ["snapshot", "country", "family"]
    dist = factors if distribution is None else distribution
    stats = dist.groupBy(*keys).agg(*[a for f in K.FACTORS for a in (
        F.avg(f"{f}_f").alias(f"{f}_m"), F.stddev_samp(f"{f}_f").alias(f"{f}_s"))])

    def scaled(f: str) -> Column:
        x, m, s = F.col(f"{f}_f"), F.col(f"{f}_m"), F.col(f"{f}_s")
        return F.when(x.isNotNull(), F.when(s > 0, (x - m) / s).otherwise(F.lit(0.0)))

    j = factors.join(F.broadcast(stats), keys, "left").withColumns({f"{f}_z": scaled(f) for f in K.FACTORS})
    return j.drop(*[f"{f}_{x}" for f in K.FACTORS for x in "ms"])


def preset_array(weights: dict[str, tuple[float, ...]] | None = None) -> Column:
    weights = weights or K.PRESETS
    return F.array(*[F.struct(F.lit(p).alias("preset"), *[F.lit(float(w)).alias(f"w_{f}") for f, w in zip(K.FACTORS, ws)])
                     for p, ws in weights.items()])


def composites(factors: DataFrame, weights: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """One row per stock, date and preset. The presets are a short parameter list, so no join is needed."""
    have = [F.col(f"{f}_z").isNotNull() for f in K.FACTORS]
    required = reduce(lambda a, b: a & b, [F.col(f"{f}_z").isNotNull() for f in K.REQUIRED_FACTORS])
    j = (factors.withColumn("factor_coverage", reduce(lambda a, b: a + b, [h.cast("int") for h in have]))
         .withColumn("has_required", required).withColumn("p", F.explode(preset_array(weights))))
    total = reduce(lambda a, b: a + b, [F.col(f"p.w_{f}") * F.coalesce(F.col(f"{f}_z"), F.lit(0.0)) for f in K.FACTORS])
    ok = (F.col("family") != "financial") & F.col("has_required") & (F.col("factor_coverage") >= K.MIN_FACTORS)
    return j.select(*KEY, F.col("p.preset").alias("preset"), "country", "family", "group_id", "value_rules", "factor_coverage",
                    "has_required", *[half_up(f"{f}_z", 4).alias(f"{f}_score") for f in K.FACTORS],
                    half_up(F.when(ok, total), 10).alias("composite_full"))


def percentile_scores(comp: DataFrame) -> DataFrame:
    """score = 100 (n - rank) / n inside date x preset x country x family; a single member gets 50."""
    keys = ["snapshot", "preset", "country", "family"]
    ranked = with_rank(comp.select(*KEY, "preset", "country", "family", "composite_full"), keys, "composite_full",
                       rank="pos", total="n").select(*KEY, "preset", "pos", "n")
    j = comp.join(ranked, [*KEY, "preset"], "left")
    n, pos = F.col("n"), F.col("pos")
    score = F.when(n == 1, F.lit(50.0)).when(n > 1, half_up(F.lit(100.0) * (n - pos) / n, 2))
    return j.withColumn("composite", half_up("composite_full", 4)).withColumn("score", score).drop("composite_full", "pos", "n")


# ------------------------------------------------------------------ explanations
def fiscal_mode(inputs: DataFrame) -> DataFrame:
    """Most frequent newest fiscal year end per date and country (ties: the later date)."""
    counts = inputs.where(F.col("fy_end").isNotNull()).groupBy("snapshot", "country", "fy_end").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("snapshot", "country").agg(F.max_by("fy_end", F.struct("c", "fy_end")).alias("mode_end"))


def _over(i: int) -> Column:
    ni, oi = F.col(f"ni{i}"), F.col(f"oi{i}")
    return (ni > 0) & ((oi <= 0) | (ni > F.lit(K.ONEOFF_RATIO) * oi))


def badges(inputs: DataFrame) -> DataFrame:
    """Warning badges as an array of (code, n, k): profit above operating profit, odd fiscal year end, short history."""
    j = inputs.join(F.broadcast(fiscal_mode(inputs)), ["snapshot", "country"], "left")
    known = [(F.col(f"ni{i}").isNotNull() & F.col(f"oi{i}").isNotNull()).cast("int") for i in range(3)]
    over = [F.coalesce(_over(i).cast("int"), F.lit(0)) for i in range(3)]

    def badge(code: str, n: Column, k: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), n.cast("int").alias("n"), k.cast("int").alias("k"))

    gap = F.abs(F.datediff("fy_end", "mode_end"))
    short = (F.col("fy_count") < 3) | (F.col("value_rules") < 2)
    return j.select(*KEY, "country", "mode_end", F.array_compact(F.array(
        F.when((F.col("family") != "financial") & _over(0), badge("oneoff", sum(known[1:], known[0]), sum(over[1:], over[0]))),
        F.when(gap > K.FISCAL_GAP_DAYS, badge("fiscal_gap", gap, F.round(gap / F.lit(30.44)))),
        F.when(short, badge("short_history", F.col("fy_count"), F.lit(2) - F.coalesce(F.col("value_rules"), F.lit(0)))))
    ).alias("badges"))


def quality(values_missing: DataFrame, scores: DataFrame, inputs: DataFrame) -> DataFrame:
    """Per stock, date and preset: partition label, missing metrics with reasons, missing factors, why there is no score.

    At most ten metrics exist per stock, so the gathered map is short."""
    missing = values_missing.groupBy(*KEY).agg(F.sort_array(F.collect_list(
        F.concat_ws("=", "metric", F.coalesce("null_note", F.lit("no data"))))).alias("missing"))
    absent = F.array_compact(F.array(*[F.when(F.col(f"{f}_score").isNull(), F.lit(f)) for f in K.FACTORS]))
    why = (F.when(F.col("composite").isNotNull(), F.lit(None).cast("string")).when(F.col("halted"), "halted")
           .when(F.col("split_after"), "corporate_action").when(F.col("family") == "financial", "financial_profile")
           .when(~F.col("has_required"), "no_financials").otherwise("few_factors"))
    j = (scores.join(inputs.select(*KEY, "halted", "split_after", "price_date", "fy_count"), list(KEY))
         .join(missing, list(KEY), "left"))
    return j.select(*KEY, "preset",
                    F.when(F.col("family") == "financial", F.concat(F.col("country"), F.lit("·금융"))).otherwise(F.col("country")).alias("partition"),
                    "value_rules", F.col("fy_count").alias("fy_history"), "price_date",
                    F.array_join(F.coalesce("missing", F.array().cast("array<string>")), "; ").alias("missing_metrics"),
                    F.array_join(absent, ",").alias("unavailable_factors"), why.alias("score_null_code"),
                    F.lit(K.MODEL_VERSION).alias("model_version"))


def preset_problems(presets: DataFrame) -> DataFrame:
    """Presets whose weights are incomplete, out of range, too fine or do not add up to one, and repeated sort orders."""
    w = F.col("weight").cast("decimal(12,6)")
    per = presets.groupBy("preset").agg(
        F.countDistinct("factor").alias("nf"), F.max(F.when(~F.col("factor").isin(*K.FACTORS), 1).otherwise(0)).alias("odd"),
        F.max(F.when((w < 0) | (w > 1) | (w != F.round(w, 3)), 1).otherwise(0)).alias("bad"), F.sum(w).alias("total"),
        F.min("sort_order").alias("sort_order"))
    dup = per.groupBy("sort_order").agg(F.count(F.lit(1)).alias("same"))
    problem = (F.when((F.col("nf") != len(K.FACTORS)) | (F.col("odd") == 1), "factors").when(F.col("bad") == 1, "range")
               .when(F.col("total") != 1, "sum").when(F.col("sort_order").isNull() | (F.col("same") > 1), "sort_order"))
    return per.join(dup, "sort_order", "left").select("preset", problem.alias("problem")).where("problem IS NOT NULL")


# ------------------------------------------------------------------ stocks outside the sample
def reference_scores(listed: DataFrame, values: DataFrame, inputs: DataFrame, scores: DataFrame, preset: str,
                     k: int = K.SHRINKAGE_K, keep=lambda name, df: df) -> DataFrame:
    """Place stocks outside the sample in the stored distribution without changing it.

    `listed` holds their inputs; `keep` may store an intermediate table to cut the lineage. Every position is found by a sorted union of both sides in value buckets, never by
    comparing each outside stock with each member."""
    part = ["snapshot", "country", "family"]
    mine = metrics_long(listed).where(F.col("raw_value").isNotNull() & (F.col("family") != "financial"))
    pool = values.where(F.col("raw_value").isNotNull())
    placed = insert_positions(mine, pool, [*part, "metric"], "raw_value")
    p = (F.col("less") + F.lit(1) + F.col("equal") / F.lit(2.0) - F.lit(0.5)) / (F.col("n") + 1)
    z = normal_quantile(F.col("p")) * metric_flag(1)
    placed = (placed.where("n > 0").withColumn("p", p)
              .withColumn("z_raw", F.when(metric_flag(3), F.least(F.lit(0.0), z)).otherwise(z)))
    gkeys = ["snapshot", "country", "group_id", "metric"]
    stats = (values.where("group_id IS NOT NULL AND z_raw IS NOT NULL").groupBy(*gkeys)
             .agg(F.count(F.lit(1)).alias("gn"), F.sum(F.col("z_raw").cast("decimal(10,4)")).cast("double").alias("gs")))
    placed = placed.join(stats, gkeys, "left")
    n = F.coalesce("gn", F.lit(0)) + 1
    shifted = F.col("z_raw") - n / (n + F.lit(k)) * ((F.coalesce("gs", F.lit(0.0)) + F.col("z_raw")) / n)
    placed = placed.withColumn("z_adj", F.when(~metric_flag(4) | F.col("group_id").isNull() | (n == 1), F.col("z_raw"))
                               .otherwise(clamp(shifted, -3.0, 3.0)))
    w = metric_flag(2)

    def mean(f: str) -> Column:
        m = F.col("factor") == f
        return ratio(F.sum(F.when(m, F.col("z_adj") * w)), F.sum(F.when(m, w)))

    placed = keep("placed", placed.select(*KEY, "metric", "factor", "z_adj"))
    mine_f = listed.where("family <> 'financial'").select(*KEY, "country", "family", "group_id", "value_rules").join(
        placed.groupBy(*KEY).agg(*[mean(f).alias(f"{f}_f") for f in K.FACTORS]), list(KEY))
    mine_f = mine_f.withColumn("value_f", F.col("value_f") * value_shrink(F.col("value_rules")))
    comp = composites(standardize(mine_f, factor_table(values, inputs)), {preset: K.PRESETS[preset]})
    comp = keep("comp", comp.withColumn("composite", half_up("composite_full", 4)).drop("composite_full"))
    stored = scores.where((F.col("preset") == preset) & F.col("composite").isNotNull())
    rank = insert_positions(comp.where(F.col("composite").isNotNull()).select(*KEY, *part[1:], "composite"), stored, part, "composite")
    total = F.col("n") + 1
    above = F.col("n") - F.col("less") - F.col("equal")
    rank = rank.select(*KEY, half_up(F.lit(100.0) * (total - above - 1) / total, 2).alias("score"), (above + 1).alias("position"),
                       total.alias("total"), half_up(F.lit(100.0) * F.col("less") / F.col("n"), 1).alias("percentile"))
    return comp.drop("has_required", "value_rules").join(rank, list(KEY), "left")
