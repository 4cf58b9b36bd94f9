"""A scoring run: inputs, metric values and scores for a list of dates, stored once and read by the score queries."""
from __future__ import annotations

from calendar import monthrange
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, functions as F

from bourseflow.operators import point_in_time, scoring
from bourseflow.plans import marts
from bourseflow.sources.market_tables import Tables, literal_rows
from bourseflow.sources.stored import stored

# months before the newest trade of the scoring dates
MONTHS_BACK = (16, 10, 0)
# corporate actions (ticker, country, completion date), a short hand-kept list
ACTIONS = (("000006", "KR", "2001-03-02"), ("000033", "US", "2001-05-15"))


@dataclass
class ScoreRun:
    inputs: DataFrame
    values: DataFrame
    scores: DataFrame

    @property
    def latest(self) -> DataFrame:
        """Rows of the newest scoring date of the whole table (not of each stock)."""
        return self.scores.where(F.col("snapshot") == self.scores.agg(F.max("snapshot")).scalar())


def snapshots_of(t: Tables) -> tuple[str, ...]:
    """The scoring dates of a run that is given none: the newest trade's date and earlier ones."""
    return tuple(str(months_before(t.newest_day, m)) for m in MONTHS_BACK)


def months_before(day: date, months: int) -> date:
    """The same day of an earlier month, or its last day."""
    year, month = divmod(day.year * 12 + day.month - 1 - months, 12)
    return date(year, month + 1, min(day.day, monthrange(year, month + 1)[1]))


def actions(t: Tables) -> DataFrame:
    return (literal_rows(t.spark, ("ticker", "country", "done"), list(ACTIONS))
            .withColumn("done", F.col("done").cast("date")))


def build_inputs(t: Tables, listed: bool, snapshots: tuple[str, ...] | None = None) -> DataFrame:
    """Inputs of the sample (active featured and benchmark stocks) or of the listed stocks outside it, on any number of dates."""
    snapshots = snapshots or snapshots_of(t)
    parts = marts.bar_parts(t)
    sample = t.stocks.where("is_active AND coverage <> 'listed'")
    chosen = t.stocks.where("is_active AND coverage = 'listed'") if listed else sample
    chosen = marts.with_family(t, chosen.select("stock_id", "ticker", "country", "coverage"))
    bars = t.prices.join(chosen.select("stock_id"), "stock_id", "left_semi")
    return scoring.score_inputs(
        point_in_time.price_metrics_at(bars, snapshots, parts),
        point_in_time.as_of_rows(t.valuations, "as_of", snapshots).withColumnRenamed("as_of", "valuation_as_of").drop("source"),
        scoring.fiscal_chain(t.statements, snapshots), chosen,
        scoring.trading_calendar_cut(t.prices, sample, snapshots), actions(t))


def score_run(t: Tables, snapshots: tuple[str, ...] | None = None) -> ScoreRun:
    snapshots = snapshots or snapshots_of(t)
    tag = f"{t.folder}|{','.join(snapshots)}"
    inputs = stored(t.spark, f"inputs|{tag}", lambda: build_inputs(t, False, snapshots))

    def build_values() -> DataFrame:
        long = scoring.metrics_long(inputs)
        ranked = stored(t.spark, f"ranked|{tag}", lambda: scoring.rank_normal(long))
        return scoring.neutralize(ranked)

    values = stored(t.spark, f"values|{tag}", build_values)

    def build_scores() -> DataFrame:
        factors = scoring.standardize(scoring.factor_table(values, inputs))
        comp = stored(t.spark, f"comp|{tag}", lambda: scoring.composites(factors))
        return scoring.percentile_scores(comp)

    return ScoreRun(inputs, values, stored(t.spark, f"scores|{tag}", build_scores, partition_by="snapshot"))
