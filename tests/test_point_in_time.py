"""Many dates in one pass against the plain form, which copies every bar to every later date."""
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from bourseflow.operators import point_in_time as pit
from bourseflow.operators import prices, scoring

START = dt.date(2019, 1, 2)


@pytest.fixture(scope="module")
def bars(spark):
    rows = []
    for stock, step, n in ((1, 1, 800), (2, 3, 400), (3, 1, 252), (4, 1, 253), (5, 40, 30), (6, 1, 21), (7, 1, 1), (8, 2, 504)):
        for i in range(n):
            c = 100 + 30 * math.sin(i / 17 + stock) + i * 0.05 * (-1) ** stock
            close = round(c if (i * 7 + stock) % 50 else c / 2, 4)
            rows.append((stock, START + dt.timedelta(days=step * i), close, round(close + i % 5, 4), round(close - i % 3, 4), 1000 + i * 37 % 911))
    return (spark.createDataFrame(rows, "stock_id long, trade_date date, close double, high double, low double, volume long")
            .withColumns({c: F.col(c).cast("decimal(18,4)") for c in ("close", "high", "low")})).cache()


def same(a, b):
    a = a.select(*b.columns)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_500_dates_equal_the_copies(spark, bars):
    few = bars.where("stock_id IN (2, 5, 6, 8)")
    dates = [str(START + dt.timedelta(days=2 * i - 10)) for i in range(500)]
    same(pit.price_metrics_at(few, dates), prices.price_metrics(prices.at_snapshots(few, "trade_date", dates), scoring.KEY))


def test_window_edges_of_every_stock(spark, bars):
    dates = ["2018-12-31", "2019-01-02", "2019-12-31", "2020-01-01", "2020-02-29", "2020-03-31", "2021-02-28", "2021-03-11", "2030-01-01"]
    same(pit.price_metrics_at(bars, dates), prices.price_metrics(prices.at_snapshots(bars, "trade_date", dates), scoring.KEY))
    for d in dates[1::3]:
        same(pit.price_metrics_at(bars, [d]).drop("snapshot"), prices.price_metrics(bars.where(F.col("trade_date") <= F.lit(d).cast("date"))))


def test_rows_do_not_grow_with_dates(spark, bars):
    """One shuffle of the bars by stock (and the cut of the first year), no row per bar and date before the newest row is known."""
    plan = pit.price_metrics_at(bars, [str(START + dt.timedelta(days=i)) for i in range(300)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(slice(") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_newest_row_of_each_date(spark):
    rows = spark.createDataFrame([(1, dt.date(2020, 1, 1), "a"), (1, dt.date(2020, 1, 5), "b"), (1, dt.date(2020, 2, 1), "late"), (2, dt.date(2020, 1, 5), "c"),
                                  (None, dt.date(2020, 1, 2), "n")], "stock_id long, day date, v string")
    got = {(r.stock_id, str(r.snapshot)): r.v for r in pit.as_of_rows(rows, "day", ["2020-01-05", "2019-12-31", "2020-01-04", "2020-01-04"]).collect()}
    assert got == {(1, "2020-01-04"): "a", (1, "2020-01-05"): "b", (2, "2020-01-05"): "c", (None, "2020-01-04"): "n", (None, "2020-01-05"): "n"}


def test_empty(spark, bars):
    assert pit.price_metrics_at(bars.limit(0), ["2020-01-01"]).count() == 0
    assert pit.price_metrics_at(bars, ["2001-01-01"]).count() == 0


def test_parts_bound_what_one_task_orders(spark, bars):
    dates = ["2020-03-01", "2021-06-30"]
    cut = pit.price_metrics_at(bars, dates, parts=7)
    same(cut, pit.price_metrics_at(bars, dates))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 1      # one shuffle, of that many parts
