"""What every key looked like on each of many dates, in one pass over its rows.

The newest row of a key does not change between two of its rows, so a date only picks a row: each row knows the span of dates that see it
(from its own date to the next row's) and is repeated for the dates inside. The list of dates is turned into a place per calendar day,
which is bounded by the calendar.

Windows of bars are never gathered per date. Every bar carries what its block of bars holds up to it and from it on, and any window is
the tail of one block and the head of the next:

* sums (moving averages, mean volume) are differences of running sums, exact in decimals;
* a window of 252 bars is cut by blocks of 252 bars: moments and drawdowns of the tail and the head are merged;
* a window of twelve months is cut at the turn of the year: highs and lows of the tail of last year and the head of this one.

So the work is one shuffle by key and a few running windows over the bars, however many dates are asked for."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from bourseflow.functions.exprs import ratio
from bourseflow.operators.prices import YEAR_OF_BARS, newest_bars, price_columns

#: Returns and drawdowns look back on so many bars.
SESSIONS = 252


def _day_list(dates: Sequence[date | str]) -> list[str]:
    return sorted({str(d) for d in dates})


def _places(df: DataFrame, date_col: str, dates: list[str]) -> DataFrame:
    """Adds `_first`: the place in the sorted list of the first date that sees the row. One row per calendar day is broadcast."""
    days = F.array(*[F.lit(d).cast("date") for d in dates])
    calendar = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(dates[0]).cast("date"), F.lit(dates[-1]).cast("date"))).alias("_day"))
    calendar = calendar.select(F.col("_day").alias(date_col), F.size(F.filter(days, lambda d: d < F.col("_day"))).alias("_at"))
    return (df.where(F.col(date_col) <= F.lit(dates[-1]).cast("date")).join(F.broadcast(calendar), date_col, "left")
            .withColumn("_first", F.coalesce("_at", F.lit(0))).drop("_at"))


def _for_dates(df: DataFrame, dates: list[str], by_day: Window) -> DataFrame:
    """One row per date that sees the row as the newest of its key, as `snapshot`."""
    days = F.array(*[F.lit(d).cast("date") for d in dates])
    seen = df.withColumn("_past", F.coalesce(F.lead("_first").over(by_day), F.lit(len(dates)))).where("_past > _first")
    return seen.withColumn("snapshot", F.explode(F.slice(days, F.col("_first") + 1, F.col("_past") - F.col("_first")))).drop("_first", "_past")


def as_of_rows(df: DataFrame, date_col: str, dates: Sequence[date | str], keys: Sequence[str] = ("stock_id",), **extra) -> DataFrame:
    """The newest row of each key on every date, with `snapshot`; `extra` columns are computed over the key's rows in date order
    (functions of that window). Of rows with the same date one is taken."""
    dates = _day_list(dates)
    by_day = Window.partitionBy(*keys).orderBy(date_col)
    rows = _places(df, date_col, dates)
    return _for_dates(rows.withColumns({name: make(by_day) for name, make in extra.items()}), dates, by_day)


def _mean(sum_: str, count: str, now: Callable[[str], Column], far: int, need: int) -> Column:
    """Mean of the `need` values between the running sum `now` and the one `far` bars before; NULL unless all are there."""
    def before(c: str) -> Column:
        return F.coalesce(F.col(f"{c}_{far}"), F.lit(0))
    full = (F.col("_n") >= far) & (now(count) - before(count) == need)
    return F.when(full, (now(sum_) - before(sum_)).cast("double") / F.lit(float(need)))


def _running(bars: DataFrame) -> DataFrame:
    """Every bar with what lies behind it: neighbours, running sums, heads and tails of its blocks."""
    stock, day, close = "stock_id", "trade_date", F.col("close")
    # high and low from the bar to the end of its year, and from the start of the year to the bar
    year = Window.partitionBy(stock, "_year")
    tail, head = year.orderBy(F.desc(day)), year.orderBy(day)
    b = bars.select(stock, day, "close", "high", "low", "volume", "_first", F.year(day).alias("_year"))
    b = b.withColumns({"_tail_high": F.max("high").over(tail), "_tail_low": F.min("low").over(tail)})
    b = b.withColumns({"_head_high": F.max("high").over(head), "_head_low": F.min("low").over(head)})
    # neighbours and running sums; what the next bar starts is looked up by the bar before it
    by_day = Window.partitionBy(stock).orderBy(day)
    upto = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumns({
        "_n": F.row_number().over(by_day), "_prev": F.lag("close").over(by_day),
        "_sum": F.sum("close").over(upto), "_count": F.count("close").over(upto),
        "_volume": F.sum("volume").over(upto), "_volumes": F.count("volume").over(upto),
        "_next": F.lead(F.struct(F.col("_year").alias("year"), F.col("_tail_high").alias("high"), F.col("_tail_low").alias("low"))).over(by_day)})
    past = "OVER (PARTITION BY stock_id ORDER BY trade_date RANGE BETWEEN UNBOUNDED PRECEDING AND {} PRECEDING)"
    b = b.withColumns({f"p{h}": F.expr(f"last_value(close) {past.format(span)}") for h, span in
                       {"1w": "INTERVAL '7' DAY", "1m": "INTERVAL '1' MONTH", "3m": "INTERVAL '3' MONTH", "6m": "INTERVAL '6' MONTH",
                        "1y": "INTERVAL '12' MONTH"}.items()})
    a_year = past.format("INTERVAL '12' MONTH")
    b = b.withColumn("_start", F.expr(f"last_value(_next) {a_year}"))
    for k in (1, 20, 21, 60, 120):
        for c in ("_sum", "_count", "_volume", "_volumes"):
            if (k in (1, 21)) == c.startswith("_volume"):
                b = b.withColumn(f"{c}_{k}", F.lag(c, k).over(by_day))
    # the means are taken here, so that the windows below do not carry the wide sums along
    b = b.withColumns({**{f"ma{k}": _mean("_sum", "_count", F.col, k, k) for k in (20, 60, 120)},
                       "avg_volume": _mean("_volume", "_volumes", lambda c: F.col(f"{c}_1"), 21, 20)}).drop(
                           *[f"{c}{k}" for c in ("_sum", "_count") for k in ("", "_20", "_60", "_120")], *[f"{c}{k}" for c in ("_volume", "_volumes") for k in ("", "_1", "_21")])
    b = b.withColumns({"c_21": F.lag("close", 21).over(by_day), "c_126": F.lag("close", 126).over(by_day), "c_252": F.lag("close", SESSIONS).over(by_day)})
    # returns and drawdowns by blocks of SESSIONS bars
    b = b.withColumns({"_ret": ratio("close", "_prev") - 1, "_block": F.floor((F.col("_n") - 1) / SESSIONS)})
    block = Window.partitionBy(stock, "_block")
    back, on = block.orderBy(F.desc("_n")), block.orderBy("_n")

    def moments(w) -> Column:
        return F.struct(F.count("_ret").over(w).alias("n"), F.avg("_ret").over(w).alias("mean"),
                        (F.var_pop("_ret").over(w) * F.count("_ret").over(w)).alias("m2"))

    b = b.withColumns({"_tail": moments(back), "_tail_max": F.max("close").over(back), "_tail_min": F.min("close").over(back)})
    b = b.withColumn("_tail_fall", F.min(ratio("_tail_min", "close")).over(back))
    b = b.withColumns({"_head": moments(on), "_head_max": F.max("close").over(on), "_head_min": F.min("close").over(on)})
    b = b.withColumn("_head_fall", F.min(ratio("close", "_head_max")).over(on))
    in_order = Window.partitionBy(stock).orderBy("_block", "_n")
    return b.withColumn("_open", F.lag(F.struct("_tail", "_tail_max", "_tail_fall"), SESSIONS - 1).over(in_order))


def price_metrics_at(bars: DataFrame, dates: Sequence[date | str], parts: int | None = None) -> DataFrame:
    """The columns of `prices.price_metrics` for each stock on every date that sees a bar of it, with `snapshot`.

    `parts` says into how many parts the bars are cut by stock: a task holds its bars in several orders, so a caller that knows
    their number bounds what one task holds."""
    dates = _day_list(dates)
    first = F.lit(dates[0]).cast("date")
    # what the first date sees is its newest year of bars
    if parts:
        after = F.col("trade_date") > first
        newest = Window.partitionBy("stock_id", after).orderBy(F.desc("trade_date"))
        kept = (bars.repartition(parts, "stock_id").where(F.col("trade_date").isNotNull()).withColumn("rn", F.row_number().over(newest))
                .where(after | (F.col("rn") <= YEAR_OF_BARS)).drop("rn"))
    else:                                                # each task cuts its own before the shuffle
        kept = bars.where(F.col("trade_date") > first).unionByName(newest_bars(bars.where(F.col("trade_date") <= first), YEAR_OF_BARS).drop("rn"))
    b = _running(_places(kept, "trade_date", dates))
    seen = _for_dates(b, dates, Window.partitionBy("stock_id").orderBy("_block", "_n"))
    whole = F.col("_n") % SESSIONS == 0                  # the block itself is the window

    a, h = F.col("_open._tail"), F.col("_head")
    n = F.when(whole, h["n"]).otherwise(a["n"] + h["n"])
    apart = h["mean"] - a["mean"]
    squares = F.when(whole, h["m2"]).otherwise(a["m2"] + h["m2"] + apart * apart * (a["n"] * h["n"]) / (a["n"] + h["n"]))
    fall = F.when(whole, F.col("_head_fall")).otherwise(F.least("_open._tail_fall", "_head_fall", ratio("_head_min", "_open._tail_max")))
    old_year = F.col("_start.year") < F.col("_year")
    found = seen.withColumns({
        "as_of": F.col("trade_date"), "prev_close": F.col("_prev"),
        "vol": F.when(n == SESSIONS, F.sqrt(squares / F.lit(SESSIONS - 1.0)) * F.sqrt(F.lit(252.0))),
        "mdd": F.when((F.col("_n") >= SESSIONS), fall - 1),
        "high": F.greatest("_head_high", F.when(old_year, F.col("_start.high"))),
        "low": F.least("_head_low", F.when(old_year, F.col("_start.low")))})
    return price_columns(found, ("stock_id", "snapshot"))
