"""Scoring stages and the queries that read stored scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bourseflow import constants as K
from bourseflow.functions.exprs import exact_mean, half_up
from bourseflow.functions.ranking import positions, with_rank
from bourseflow.operators import scoring
from bourseflow.operators.point_in_time import as_of_rows
from bourseflow.plans import marts
from bourseflow.plans.catalog import query
from bourseflow.plans.price_queries import top_ranked
from bourseflow.plans.score_run import build_inputs, score_run, snapshots_of
from bourseflow.sources.market_tables import Tables, literal_rows
from bourseflow.sources.stored import stored


@query("sc_fy_chain")
def sc_fy_chain(t: Tables) -> DataFrame:
    chain = scoring.fiscal_chain(t.statements, snapshots_of(t))
    return chain.select("stock_id", "snapshot", "end0", "end1", "end2", "oi0", "oi1", "oi2", "ni0", "ni1", "ni2")


@query("sc_calendar_halt")
def sc_calendar_halt(t: Tables) -> DataFrame:
    return score_run(t).inputs.select("stock_id", "snapshot", "country", "price_date", "halted")


@query("sc_corporate_action")
def sc_corporate_action(t: Tables) -> DataFrame:
    return score_run(t).inputs.select("stock_id", "snapshot", "split_after")


@query("sc_conservative_earnings")
def sc_conservative_earnings(t: Tables) -> DataFrame:
    return score_run(t).inputs.select("stock_id", "snapshot", "family", "fy_count", half_up("e_cons", 4).alias("e_cons"))


@query("sc_common_share")
def sc_common_share(t: Tables) -> DataFrame:
    return (score_run(t).inputs.where("common_share IS NOT NULL")
            .select("stock_id", "snapshot", half_up("common_share", 6).alias("common_share")))


def _metric(t: Tables, name: str) -> DataFrame:
    return (scoring.metrics_long(score_run(t).inputs).where(F.col("metric") == name)
            .withColumn(name, half_up("raw_value", 6)))


@query("sc_trap_signal")
def sc_trap_signal(t: Tables) -> DataFrame:
    return _metric(t, "trap_signal").select("stock_id", "snapshot", "trap_signal")


@query("sc_momentum")
def sc_momentum(t: Tables) -> DataFrame:
    return _metric(t, "momentum").select("stock_id", "snapshot", "momentum", "note")


@query("sc_metrics_long")
def sc_metrics_long(t: Tables) -> DataFrame:
    """The inputs are computed from the bars, valuations and statements here, without the stored run."""
    return scoring.metrics_long(build_inputs(t, False)).select(
        "stock_id", "snapshot", "country", "family", "metric", "factor", half_up("raw_value", 6).alias("raw_value"), "note", "null_note")


@query("sc_rank_normal")
def sc_rank_normal(t: Tables) -> DataFrame:
    ranked = scoring.rank_normal(scoring.metrics_long(score_run(t).inputs))
    return ranked.select("stock_id", "snapshot", "metric", half_up("p", 8).alias("p"), "z_raw")


@query("sc_neutralize")
def sc_neutralize(t: Tables) -> DataFrame:
    return score_run(t).values.select("stock_id", "snapshot", "metric", "z_raw", "z_adj")


@query("sc_aggregate")
def sc_aggregate(t: Tables) -> DataFrame:
    return score_run(t).scores.drop("group_id")


@query("fiscal_mode")
def fiscal_mode(t: Tables) -> DataFrame:
    return scoring.fiscal_mode(score_run(t).inputs)


@query("fin_basis")
def fin_basis(t: Tables) -> DataFrame:
    """Stocks per fiscal year of the newest annual statement, by date and country."""
    last = as_of_rows(t.statements.where("period_type = 'FY'").select("stock_id", "period_end"), "period_end", snapshots_of(t))
    return (score_run(t).inputs.select("stock_id", "snapshot", "country").join(last, ["stock_id", "snapshot"])
            .groupBy("snapshot", "country", F.year("period_end").alias("fiscal_year")).agg(F.count(F.lit(1)).alias("stocks")))


@query("sc_badges")
def sc_badges(t: Tables) -> DataFrame:
    return scoring.badges(score_run(t).inputs).select("stock_id", "snapshot", F.inline("badges"))


@query("sc_quality_struct")
def sc_quality_struct(t: Tables) -> DataFrame:
    run = score_run(t)
    missing = scoring.metrics_long(run.inputs).where("raw_value IS NULL")
    return scoring.quality(missing, run.scores, run.inputs)


@query("sc_presets_validate")
def sc_presets_validate(t: Tables) -> DataFrame:
    """The configured presets plus two broken ones: what is wrong with each, and how many scores of the newest date use it."""
    broken = literal_rows(t.spark, ("preset", "sort_order", "is_default", "factor", "weight"),
                          [("growth_old", 7, False, f, 0.3) for f in K.FACTORS] + [("half", 8, False, "value", 1.0)])
    return scoring.preset_problems(t.presets.unionByName(broken)).join(scored_by_preset(t), "preset", "left").na.fill(0, ["scored"])


def scored_by_preset(t: Tables) -> DataFrame:
    return score_run(t).latest.groupBy("preset").agg(F.count("score").alias("scored"))


@query("sc_reference_score")
def sc_reference_score(t: Tables) -> DataFrame:
    run = score_run(t)
    tag = f"{t.folder}|{','.join(snapshots_of(t))}"
    listed = stored(t.spark, f"listed inputs|{tag}", lambda: build_inputs(t, True))
    return scoring.reference_scores(listed, run.values, run.inputs, run.scores, K.DEFAULT_PRESET,
                                    keep=lambda name, df: stored(t.spark, f"listed {name}|{tag}", lambda: df))


def factor_long(scores: DataFrame, suffix: str = "_score") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"{f}{suffix}").alias("score")) for f in K.FACTORS])
    return scores.withColumn("x", F.explode(pairs)).select("*", "x.factor", F.col("x.score").alias("factor_score")).drop("x")


@query("factor_positions")
def factor_positions(t: Tables) -> DataFrame:
    """Percentile of every factor score inside preset x country x family."""
    rows = factor_long(score_run(t).latest.where("composite IS NOT NULL")).select(
        "stock_id", "preset", "country", "family", "group_id", "factor", F.col("factor_score").alias("score"))
    ranked = with_rank(rows, ["preset", "country", "family", "factor"], "score", rank="pos", total="n")
    return ranked.withColumn("percentile", half_up(F.lit(100.0) * (F.col("n") - F.col("pos")) / F.col("n"), 2)).drop("pos", "n")


def theme_position_table(values: DataFrame, inputs: DataFrame, scores: DataFrame) -> DataFrame:
    """Rank of the theme means of the factors before neutralising; themes need two scored members."""
    scored = scores.where("composite IS NOT NULL").select("stock_id", "snapshot").distinct()
    raw = (scoring.factor_table(values, inputs, "z_raw").where("group_id IS NOT NULL")
           .join(scored, ["stock_id", "snapshot"], "left_semi"))
    rows = factor_long(raw, "_f").where("factor_score IS NOT NULL")
    part = ["snapshot", "country", "family", "factor"]
    theme = (rows.groupBy(*part, "group_id").agg(half_up(F.avg("factor_score"), 10).alias("m"), F.count(F.lit(1)).alias("members"))
             .where("members >= 2"))
    return (with_rank(theme, part, "m", rank="position", total="total")
            .select(*part, "group_id", half_up("m", 6).alias("score"), "position", "total",
                    F.ceil(F.lit(100.0) * F.col("position") / F.col("total")).cast("int").alias("top_percent")))


@query("theme_positions")
def theme_positions(t: Tables) -> DataFrame:
    run = score_run(t)
    return theme_position_table(run.values, run.inputs, run.scores)


@query("peer_average")
def peer_average(t: Tables) -> DataFrame:
    """Mean factor scores of each primary theme per country and preset (two members at least)."""
    s = score_run(t).latest.where("group_id IS NOT NULL")
    means = [half_up(exact_mean(F.col(f"{f}_score").cast("decimal(10,4)")), 4).alias(f) for f in K.FACTORS]
    return s.groupBy("country", "group_id", "preset").agg(F.count(F.lit(1)).alias("size"), *means).where("size >= 2")


def score_ranks(latest: DataFrame) -> DataFrame:
    """Rank, total and percent rank of the score inside preset x country x family."""
    keys = ["preset", "country", "family"]
    pos = positions(latest, keys, "score")
    n = F.col("n")
    pct = F.when(n > 1, F.lit(100.0) * F.col("less") / (n - 1)).otherwise(F.lit(0.0))
    pos = pos.select(*keys, "score", (n - F.col("less") - F.col("ties") + 1).alias("rank_position"), n.alias("rank_total"),
                     half_up(pct, 1).alias("percentile"))
    return latest.where("score IS NOT NULL").join(pos, [*keys, "score"]).select(
        "stock_id", "preset", "rank_position", "rank_total", "percentile")


@query("analysis_row")
def analysis_row(t: Tables) -> DataFrame:
    latest = score_run(t).latest.where(F.col("preset") == K.DEFAULT_PRESET)
    cols = latest.select("stock_id", "preset", "score", "composite", "factor_coverage")
    ranks = score_ranks(latest).drop("preset")
    return (marts.metrics_table(t).select("stock_id", "market", "as_of", "close", "return_1y", "volatility_1y", "per", "roe", "market_cap_krw")
            .join(cols, "stock_id", "left").join(ranks, "stock_id", "left"))


@query("latest_score_filter")
def latest_score_filter(t: Tables) -> DataFrame:
    return score_run(t).latest.select("stock_id", "preset", "snapshot", "score")


@query("family_filter")
def family_filter(t: Tables) -> DataFrame:
    """Members and scored members of each (country, family) comparison group."""
    return score_run(t).latest.groupBy("country", "family", "preset").agg(
        F.count(F.lit(1)).alias("members"), F.count("score").alias("scored"))


@query("score_contribution")
def score_contribution(t: Tables) -> DataFrame:
    """weight x factor score; missing factors do not re-weight the others."""
    rows = factor_long(score_run(t).latest).where("factor_score IS NOT NULL")
    j = rows.join(F.broadcast(t.presets.select("preset", "factor", "weight")), ["preset", "factor"])
    value: Column = F.when(F.col("composite").isNotNull(), half_up(F.col("weight") * F.col("factor_score"), 4))
    return j.select("stock_id", "preset", "factor", "weight", value.alias("contribution"))


@query("presets_table")
def presets_table(t: Tables) -> DataFrame:
    """Weights of each preset, and how many stocks it scores on the newest date."""
    wide = t.presets.groupBy("preset", "sort_order", "is_default").pivot("factor", list(K.FACTORS)).agg(F.max("weight"))
    return wide.join(scored_by_preset(t), "preset", "left").na.fill(0, ["scored"])


@query("home_attractiveness")
def home_attractiveness(t: Tables, limit: int = 10) -> DataFrame:
    """Top scores per country and family; families are never mixed in one list."""
    s = score_run(t).latest.where((F.col("preset") == K.DEFAULT_PRESET) & F.col("score").isNotNull())
    info = t.stocks.where("is_active AND coverage IN ('featured', 'benchmark')").select("stock_id", "ticker", "name", "market")
    rows = s.select("stock_id", "country", "family", F.col("score").alias("value")).join(info, "stock_id")
    return top_ranked(rows, ["country", "family"], "value", limit).select(
        "country", "family", "rank", "stock_id", "ticker", "name", "market", "value")
