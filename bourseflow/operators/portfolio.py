"""Portfolio valuation, summaries and order sizing in exact decimals, for all portfolios at once."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bourseflow.functions.exprs import half_up, ratio

WON = "decimal(24,0)"


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(24,2)")


def value_items(items: DataFrame, price: DataFrame, usd_krw: Column) -> DataFrame:
    """KRW value and profit of each position, split into price and currency effects."""
    j = items.join(price.select("stock_id", "currency", "close", "trade_date"), "stock_id", "left")
    q = F.col("quantity").try_cast("decimal(14,0)")
    close, ref = F.col("close").cast("decimal(14,4)"), F.col("ref_price").cast("decimal(14,4)")
    ref_fx = F.col("ref_fx_rate").try_cast("decimal(12,4)")
    j = j.withColumn("fx_now", F.when(F.col("currency") == "USD", usd_krw).otherwise(F.lit(1)).try_cast("decimal(12,4)"))
    fx = F.col("fx_now")
    won = lambda c: F.round(c, 0).cast(WON)
    value = won(q * close * fx)
    j = j.withColumn("value_krw", value)
    gain = F.col("value_krw").cast("decimal(24,2)") - F.col("cost_krw")
    return j.select("portfolio_id", "stock_id", "quantity", "cost_krw", "close", "fx_now", "value_krw",
                    won(gain).alias("pnl_krw"), half_up(ratio(gain, "cost_krw"), 6).alias("pnl_rate"),
                    half_up(ratio("close", "ref_price") - 1, 6).alias("local_return"),
                    half_up(ratio("fx_now", "ref_fx_rate") - 1, 6).alias("fx_return"),
                    won(q * (close - ref) * ref_fx).alias("price_effect_krw"),
                    won(q * close * (fx - ref_fx)).alias("fx_effect_krw"))


def summary(valued: DataFrame, portfolios: DataFrame, scores: DataFrame) -> DataFrame:
    """Totals per portfolio: used and remaining seed, value, profit, cost-weighted score."""
    j = valued.join(scores.select("stock_id", "score"), "stock_id", "left")
    has = F.col("value_krw").isNotNull()
    scored = F.col("score").isNotNull()
    g = j.groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("items"), money(F.sum("cost_krw")).alias("used_krw"),
        F.sum("value_krw").cast(WON).alias("total_value_krw"), money(F.sum(F.when(has, F.col("cost_krw")))).alias("valued_cost"),
        F.sum("price_effect_krw").cast(WON).alias("price_effect_krw"), F.sum("fx_effect_krw").cast(WON).alias("fx_effect_krw"),
        F.sum(F.when(scored, F.col("cost_krw") * F.col("score").cast("decimal(6,2)"))).cast("double").alias("ws"),
        F.sum(F.when(scored, F.col("cost_krw"))).cast("double").alias("wc"))
    p = portfolios.select("portfolio_id", "seed_krw").join(g, "portfolio_id", "left").na.fill(0, ["items"])
    used = F.coalesce("used_krw", F.lit(0)).cast("decimal(24,2)")
    pnl = F.coalesce("total_value_krw", F.lit(0)).cast("decimal(24,2)") - F.coalesce("valued_cost", F.lit(0)).cast("decimal(24,2)")
    return p.select("portfolio_id", "seed_krw", "items", used.alias("used_krw"), (F.col("seed_krw") - used).alias("remaining_krw"),
                    half_up(ratio(used, "seed_krw"), 6).alias("usage_rate"),
                    F.coalesce("total_value_krw", F.lit(0)).alias("total_value_krw"), F.round(pnl, 0).alias("total_pnl_krw"),
                    half_up(ratio(pnl, "valued_cost"), 6).alias("total_pnl_rate"),
                    half_up(ratio("ws", "wc"), 2).alias("weighted_score"),
                    F.coalesce("price_effect_krw", F.lit(0)).alias("price_effect_krw"),
                    F.coalesce("fx_effect_krw", F.lit(0)).alias("fx_effect_krw"))


def weights(valued: DataFrame, stocks: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Cost weight by country and by theme. A stock of two themes counts in both."""
    base = valued.select("portfolio_id", "stock_id", "cost_krw")
    used = base.groupBy("portfolio_id").agg(F.sum("cost_krw").alias("used"))
    c = base.join(stocks.select("stock_id", "country"), "stock_id").select("portfolio_id", F.lit("country").alias("kind"), F.col("country").alias("name"), "cost_krw")
    th = members.join(F.broadcast(groups.select("group_id", "theme")), "group_id").select("stock_id", "theme")
    g = base.join(th, "stock_id").select("portfolio_id", F.lit("theme").alias("kind"), F.col("theme").alias("name"), "cost_krw")
    s = c.unionByName(g).groupBy("portfolio_id", "kind", "name").agg(money(F.sum("cost_krw")).alias("cost_krw"))
    return s.join(used, "portfolio_id").select("portfolio_id", "kind", "name", "cost_krw", half_up(ratio("cost_krw", "used"), 6).alias("weight"))


def slices(valued: DataFrame, portfolios: DataFrame, top: int) -> DataFrame:
    """The largest positions, the rest as one slice, and unused cash, with their shares.

    Positions are shuffled once, by portfolio (it holds a stock once, so its rows are at most as many as the stocks), and a portfolio
    becomes one row (its largest positions, its totals, its seed), which is then cut into slices."""
    by_size = Window.partitionBy("portfolio_id").orderBy(F.desc("amount"), "stock_id")
    whole = Window.partitionBy("portfolio_id")
    amounts = valued.where(F.col("portfolio_id").isNotNull()).select(
        "portfolio_id", "stock_id", "cost_krw", F.coalesce(F.col("value_krw").cast("decimal(24,2)"), F.col("cost_krw")).alias("amount"))
    rows = (amounts.withColumns({"all_amount": F.sum("amount").over(whole), "n": F.count(F.lit(1)).over(whole), "used": F.sum("cost_krw").over(whole)})
            .withColumn("rn", F.row_number().over(by_size)).where(F.col("rn") <= max(top, 1)))
    shown = F.col("rn") <= top
    per = rows.groupBy("portfolio_id").agg(
        F.max("all_amount").alias("all_amount"), F.max("n").alias("n"), F.max("used").alias("used"), F.sum(F.when(shown, F.col("amount"))).alias("kept_amount"),
        F.collect_list(F.when(shown, F.struct("stock_id", "amount"))).alias("head"))
    seeds = portfolios.groupBy("portfolio_id").agg(F.collect_list("seed_krw").alias("seeds"))
    per = per.join(seeds, "portfolio_id", "left")

    def cut(name: Column, amount: Column) -> Column:
        return F.struct(name.alias("slice"), money(amount).alias("amount"))

    def listed(c: Column) -> Column:
        return F.coalesce(c, F.array().cast("array<struct<slice:string,amount:decimal(24,2)>>"))

    stocks = F.transform("head", lambda h: cut(F.concat(F.lit("stock "), h["stock_id"].cast("string")), h["amount"]))
    rest = F.when((F.col("n") > top) & (F.size("head") > 0),
                  F.array(cut(F.concat(F.lit("other "), (F.col("n") - top).cast("string")), F.col("all_amount") - F.col("kept_amount"))))
    free = F.transform("seeds", lambda seed: seed - F.coalesce("used", F.lit(0)))
    cash = F.transform(F.filter(free, lambda x: x > 0), lambda x: cut(F.lit("cash"), x))
    per = per.select("portfolio_id", F.concat(stocks, listed(rest), listed(cash)).alias("slices"))
    known = F.filter("slices", lambda x: x["amount"].isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("decimal(38,2)"), lambda t, x: (t + x["amount"]).cast("decimal(38,2)")))
    return (per.withColumn("t", total).select("portfolio_id", "t", F.inline("slices"))
            .select("portfolio_id", "slice", "amount", half_up(ratio("amount", "t"), 6).alias("share")))


def whole_shares(amount: Column, unit: Column) -> Column:
    """How often `unit` fits into `amount`, by whole-number division of exact hundred-millionths; NULL for a unit of zero.

    A number too large for its decimal becomes NULL for its row and does not end the job."""
    scaled = lambda c: (c.try_cast("decimal(28,8)") * F.lit(100_000_000)).try_cast("decimal(36,0)")
    return F.try_divide(scaled(amount) - F.try_mod(scaled(amount), scaled(unit)), scaled(unit)).try_cast("decimal(24,0)").try_cast("long")


def quantity_for(mode: Column, value: Column, seed: Column, unit: Column) -> Column:
    amount = F.when(mode == "weight", seed * value / F.lit(100)).otherwise(value)
    return F.when(mode == "quantity", value.try_cast("long")).otherwise(whole_shares(amount, unit))


def position_size(orders: DataFrame, portfolios: DataFrame, used: DataFrame) -> DataFrame:
    """Whole shares for a batch of orders (by quantity, amount or weight of the seed), with the outcome of the seed check.

    `orders`: portfolio_id, stock_id, mode, value, unit_cost."""
    j = (orders.join(portfolios.select("portfolio_id", "seed_krw"), "portfolio_id")
         .join(used.select("portfolio_id", "used_krw"), "portfolio_id", "left"))
    remaining = F.col("seed_krw") - F.coalesce("used_krw", F.lit(0))
    j = (j.withColumn("remaining_krw", money(remaining))
         .withColumn("quantity", quantity_for(F.col("mode"), F.col("value"), F.col("seed_krw"), F.col("unit_cost"))))
    cost = money(F.round(F.col("quantity").try_cast("decimal(14,0)") * F.col("unit_cost").cast("decimal(20,6)"), 2))
    j = j.withColumn("cost_krw", cost)
    max_q = F.when(F.col("remaining_krw") > 0, whole_shares(F.col("remaining_krw"), F.col("unit_cost"))).otherwise(F.lit(0).cast("long"))
    code = (F.when((F.col("mode") == "quantity") & (F.col("value") != F.floor("value")), "INVALID_QUANTITY")
            .when(F.col("quantity") <= 0, "QUANTITY_ZERO").when(F.col("cost_krw") > F.col("remaining_krw"), "SEED_EXCEEDED").otherwise("OK"))
    return j.select("portfolio_id", "stock_id", "mode", "quantity", "cost_krw", "remaining_krw", max_q.alias("max_quantity"), code.alias("outcome"))


def equal_weight(targets: DataFrame, held: DataFrame, price: DataFrame, usd_krw: Column, budgets: DataFrame) -> DataFrame:
    """Split each portfolio's budget evenly over its targets into whole shares, with the reason where a target is skipped.

    `targets`: portfolio_id, stock_id; `budgets`: portfolio_id, budget_krw."""
    j = (targets.join(held.select("portfolio_id", "stock_id").withColumn("held", F.lit(True)), ["portfolio_id", "stock_id"], "left")
         .join(price.select("stock_id", "currency", "close"), "stock_id", "left").join(budgets, "portfolio_id"))
    fx = F.when(F.col("currency") == "USD", usd_krw).otherwise(F.lit(1)).try_cast("decimal(12,4)")
    quoted = F.col("held").isNull() & F.col("close").isNotNull()
    j = j.withColumn("unit", F.col("close").cast("decimal(14,4)") * fx).withColumn("quoted", quoted)
    counts = j.where("quoted").groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("k"))
    j = j.join(counts, "portfolio_id", "left").withColumn("share", F.col("budget_krw").cast("decimal(26,8)") / F.col("k").cast("decimal(10,0)"))
    qty = F.when(F.col("quoted"), whole_shares(F.col("share"), F.col("unit")))
    j = j.withColumn("quantity", qty)
    reason = (F.when(F.col("held").isNotNull(), "ALREADY_IN_PORTFOLIO").when(F.col("close").isNull(), "NO_PRICE")
              .when(F.col("quantity") <= 0, "PRICE_ABOVE_SHARE"))
    cost = F.when(F.col("quantity") > 0, F.round(F.col("quantity").try_cast("decimal(14,0)") * F.col("unit").cast("decimal(20,6)"), 2).cast("decimal(24,2)"))
    return j.select("portfolio_id", "stock_id", F.when(F.col("quantity") > 0, F.col("quantity")).alias("quantity"), cost.alias("cost_krw"), reason.alias("reason"))


def leftover(preview: DataFrame, budgets: DataFrame) -> DataFrame:
    g = preview.groupBy("portfolio_id").agg(F.sum("cost_krw").alias("total"), F.count("quantity").alias("bought"))
    return budgets.join(g, "portfolio_id").select("portfolio_id", "budget_krw", money(F.coalesce("total", F.lit(0))).alias("total_cost_krw"),
                                                  money(F.col("budget_krw") - F.coalesce("total", F.lit(0))).alias("leftover_krw"), "bought")
