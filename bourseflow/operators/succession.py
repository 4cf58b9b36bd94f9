"""Companies whose id changes: chains of ids resolved for all companies at once, and yearly rows under the newest id."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bourseflow.sources.stored import kept


def newest_ids(links: DataFrame) -> DataFrame:
    """The newest id of every id that has a successor: id, head, steps, problem.

    Chains are followed by pointer jumping: every round doubles the steps, so a chain of n ids takes log2(n) joins. Null ids and links
    of an id to itself are no links, repeated links are one. An id with several successors is a `fork`: it stays the head of the ids
    before it. Ids on a circle, or leading into one, are a `cycle` and keep their own rows."""
    pairs = kept(links.select("old_id", "new_id").where("old_id <> new_id").distinct())
    once = pairs.groupBy("old_id").agg(F.min("new_id").alias("new_id"), F.count(F.lit(1)).alias("n"))
    state = kept(once.where("n = 1").select(F.col("old_id").alias("id"), F.col("new_id").alias("head"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("moved")))
    for _ in range(state.count().bit_length() + 1):
        ahead = state.select(F.col("id").alias("at"), F.col("head").alias("next"), F.col("steps").alias("more"))
        state = kept(state.join(ahead, F.col("head") == F.col("at"), "left").select(
            "id", F.coalesce("next", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("at").isNotNull().alias("moved")))
        if not state.where("moved").limit(1).count():
            break
    # what still moves after more doublings than there are ids goes round
    found = state.select("id", F.when(F.col("moved"), F.col("id")).otherwise(F.col("head")).alias("head"),
                         F.when(F.col("moved"), F.lit(0)).otherwise(F.col("steps")).cast("long").alias("steps"), F.when(F.col("moved"), F.lit("cycle")).alias("problem"))
    forks = once.where("n > 1").select(F.col("old_id").alias("id"), F.col("old_id").alias("head"), F.lit(0).cast("long").alias("steps"), F.lit("fork").alias("problem"))
    return found.unionByName(forks)


def under_newest_id(statements: DataFrame, ids: DataFrame, accounts: list[str]) -> DataFrame:
    """Yearly rows of all ids of a chain under its newest id, each year once: the id with the fewest steps to the newest one gives the
    row, then the later period end, then the smaller id. `others` counts the further ids that report the year."""
    rows = (statements.join(ids.select(F.col("id").alias("stock_id"), "head", "steps"), "stock_id", "left")
            .select(F.coalesce("head", "stock_id").alias("head"), F.year("period_end").alias("fiscal_year"),
                    F.struct(F.coalesce("steps", F.lit(0)).alias("steps"), F.datediff(F.lit("9999-12-31").cast("date"), "period_end").alias("before"),
                             F.col("stock_id").alias("from_id"), "period_end", *accounts).alias("r")))
    best = rows.groupBy("head", "fiscal_year").agg(F.min("r").alias("r"), (F.count_distinct("r.from_id") - 1).alias("others"))
    return best.select(F.col("head").alias("stock_id"), "fiscal_year", "r.period_end", "r.from_id", "r.steps", "others", *[f"r.{a}" for a in accounts])
