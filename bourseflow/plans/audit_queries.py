"""Audit jobs over the stored scores and the base tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bourseflow import constants as K
from bourseflow.operators import audits, peers, scoring
from bourseflow.plans import marts
from bourseflow.plans.catalog import query
from bourseflow.plans.ingest_queries import primary_themes
from bourseflow.plans.market_queries import _profile
from bourseflow.plans.price_queries import top_ranked
from bourseflow.plans.score_queries import factor_long, theme_position_table
from bourseflow.plans.score_run import score_run, snapshots_of
from bourseflow.sources.market_tables import Tables, literal_rows
from bourseflow.sources.stored import stored


def newest(df: DataFrame) -> DataFrame:
    """The rows of the newest scoring date of the table."""
    return df.where(F.col("snapshot") == df.agg(F.max("snapshot")).scalar())


def chain(t: Tables) -> DataFrame:
    return scoring.fiscal_chain(marts.keep_facts(t).statements, snapshots_of(t)[-1:])


@query("a_facts")
def a_facts(t: Tables) -> DataFrame:
    run = score_run(t)
    return audits.facts(newest(run.scores), newest(run.inputs)).drop(*[f"{p}_composite" for p in K.PRESETS])


PREDICATES = {
    "growth-not-top": "growth_rank > 3 AND value_rank > 1", "scored": "balanced_percentile IS NOT NULL",
    "safe": "safety_factor > 0", "no-score": "balanced_percentile IS NULL", "fin": "family = 'financial'",
}


@query("a_cases")
def a_cases(t: Tables) -> DataFrame:
    """Expectations on single stocks, with the four-way outcome."""
    run = score_run(t)
    cases = [("growth-not-top", 5, "required", None), ("scored", 7, "required", None), ("safe", 8, "target", None), ("no-score", 9, "known_fail", "D-1"),
             ("no-score", 12, "known_fail", None), ("fin", 13, "required", None), ("scored", 999999999, "required", None)]
    rows = literal_rows(t.spark, ("case_id", "stock_id", "status", "decision"), [(c, s, st, d or "") for c, s, st, d in cases])
    rows = rows.withColumn("stock_id", F.col("stock_id").cast("long")).withColumn("decision", F.nullif("decision", F.lit("")))
    return audits.expectations(audits.facts(newest(run.scores), newest(run.inputs)), rows, PREDICATES)


@query("a_r6")
def a_r6(t: Tables) -> DataFrame:
    s = newest(score_run(t).scores)
    return audits.score_formula(s).unionByName(audits.score_order(s))


@query("a_oneoff")
def a_oneoff(t: Tables) -> DataFrame:
    return audits.oneoff_cut(newest(score_run(t).inputs))


@query("a_r1_r4")
def a_r1_r4(t: Tables) -> DataFrame:
    run = score_run(t)
    return audits.top_mix(newest(run.scores), newest(run.inputs), chain(t).drop("snapshot"), marts.themes(t))


@query("a_r5_r7")
def a_r5_r7(t: Tables) -> DataFrame:
    run = score_run(t)
    b = scoring.badges(run.inputs)
    return audits.badge_rules(newest(run.inputs), newest(b), newest(run.scores))


@query("a_r8")
def a_r8(t: Tables) -> DataFrame:
    return audits.weight_stability(newest(score_run(t).scores))


@query("a_r9")
def a_r9(t: Tables) -> DataFrame:
    s = score_run(t).scores.where(F.col("preset") == K.DEFAULT_PRESET)
    before = s.where(F.col("snapshot") == F.lit(snapshots_of(t)[-2]).cast("date"))
    return audits.lost_scores(newest(s), before, t.statements)


@query("a_r10")
def a_r10(t: Tables) -> DataFrame:
    run = score_run(t)
    return audits.independent(newest(run.scores), newest(run.inputs), chain(t).drop("snapshot"))


@query("a_trap")
def a_trap(t: Tables) -> DataFrame:
    return audits.penalty_only(score_run(t).values)


@query("a_clip_order")
def a_clip_order(t: Tables) -> DataFrame:
    return audits.clip_order(newest(score_run(t).values), keep=lambda name, df: stored(t.spark, f"{name}|{t.folder}", lambda: df))


@query("a_price_same_date")
def a_price_same_date(t: Tables) -> DataFrame:
    run = score_run(t)
    return audits.same_price_date(run.inputs, run.scores)


@query("a_theme_position")
def a_theme_position(t: Tables) -> DataFrame:
    """Theme ranks against a second computation by native windows (themes are few)."""
    from pyspark.sql import Window
    run = score_run(t)
    served = theme_position_table(run.values, run.inputs, run.scores)
    ok = run.scores.where("composite IS NOT NULL").select("stock_id", "snapshot").distinct()
    raw = factor_long(scoring.factor_table(run.values, run.inputs, "z_raw").join(ok, ["stock_id", "snapshot"], "left_semi"), "_f")
    part = ["snapshot", "country", "family", "factor"]
    th = raw.where("factor_score IS NOT NULL AND group_id IS NOT NULL").groupBy(*part, "group_id").agg(F.avg("factor_score").alias("m"), F.count(F.lit(1)).alias("k")).where("k >= 2")
    w = Window.partitionBy(*part)
    from bourseflow.functions.exprs import half_up
    again = th.withColumn("m", half_up("m", 10)).withColumn("position", F.rank().over(w.orderBy(F.desc("m"))).cast("long")).withColumn("total", F.count(F.lit(1)).over(w))
    return audits.theme_position_diff(served, again)


def raw_composites(t: Tables) -> DataFrame:
    """The model aggregated again from the scores before neutralising."""
    run = score_run(t)
    tag = f"raw composite|{t.folder}"
    return stored(t.spark, tag, lambda: scoring.composites(scoring.standardize(
        scoring.factor_table(newest(run.values), newest(run.inputs), "z_raw"))).select("stock_id", "preset", "country", "family", "composite_full"))


@query("a_raw_composite")
def a_raw_composite(t: Tables) -> DataFrame:
    return raw_composites(t)


@query("a_weak_theme")
def a_weak_theme(t: Tables) -> DataFrame:
    return audits.weak_theme_leaders(newest(score_run(t).scores), raw_composites(t))


@query("a_units")
def a_units(t: Tables) -> DataFrame:
    from bourseflow.operators.fundamentals import latest_valuation
    v = latest_valuation(t.valuations.where(F.col("as_of") <= F.lit(snapshots_of(t)[-1]).cast("date")))
    return audits.unit_rules(newest(score_run(t).inputs), v, t.statements)


@query("a_family")
def a_family(t: Tables) -> DataFrame:
    run = score_run(t)
    s = newest(run.scores)
    board = top_ranked(s.where((F.col("preset") == K.DEFAULT_PRESET) & F.col("score").isNotNull()), ["country", "family"], "score", 20).select("stock_id", "country", "family")
    return audits.family_rules(s, board)


@query("a_themes")
def a_themes(t: Tables) -> DataFrame:
    expected = literal_rows(t.spark, ("stock_id", "expected"), [(4, "NATION_9"), (11, "NATION_2"), (3, "NATION_0")])
    leaders = audits.top(newest(score_run(t).scores), 20)
    reviewed = t.reviewed().select("stock_id").distinct()
    return audits.theme_rules(primary_themes(t), expected, leaders, reviewed)


@query("a_history")
def a_history(t: Tables) -> DataFrame:
    run = score_run(t)
    fit = peers.financial_fit(_profile(t), min_n=3)
    return audits.history_rules(newest(run.inputs), newest(run.scores), chain(t).drop("snapshot"), fit, 3)


@query("a_data_path")
def a_data_path(t: Tables) -> DataFrame:
    s, y = F.col("stock_id"), F.year("period_end")
    notes = F.when((s % 17 == 3) & (y == 1996), None).when(s % 23 == 9, "path=SEC_FRAMES; bulk").when(y == 2000, F.concat(F.lit("path=SEC_API; no prior year"))).otherwise(F.lit("path=SEC_API"))
    a = t.statements.where((y != 1998) | (F.col("total_equity") >= 0)).where((y != 1999) | (F.col("operating_income") >= 0)).withColumn("notes", notes).join(t.stocks.select("stock_id", "country"), "stock_id")
    return audits.path_rules(a, ("SEC_API", "YFINANCE"))


@query("a_sample")
def a_sample(t: Tables) -> DataFrame:
    from bourseflow.plans.ingest_queries import cap_ranking
    run = score_run(t)
    assets = marts.keep_facts(t).statements.groupBy("stock_id").agg(F.max_by("total_assets", "period_end").alias("assets"))
    classes = t.stocks.groupBy("country", "company").agg(F.count(F.lit(1)).alias("classes"))
    ranked_rows = (t.stocks.where("is_active AND country = 'US'").join(classes, ["country", "company"]).join(cap_ranking(t), "stock_id", "left").join(assets, "stock_id", "left")
              .select("stock_id", "cap_rank", "cap_usd", "assets", "classes"))
    ranked = stored(t.spark, f"ranked sizes|{t.folder}", lambda: ranked_rows)
    return audits.sample_rules(run.inputs, run.scores, ranked)


@query("a_constraints")
def a_constraints(t: Tables) -> DataFrame:
    marts.keep_facts(t)
    return audits.constraints(t, t.presets, score_run(t).scores, keep=lambda name, df: stored(t.spark, f"audited {name}|{t.folder}", lambda: df))
