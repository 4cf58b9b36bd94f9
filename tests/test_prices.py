"""Price metrics on the hand-made series: close = 100 + 10 sin(i / 15) + slope * i over 420 days."""
import math
import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from bourseflow.operators import fundamentals, prices

END = date(2024, 3, 31)
N = 420
CLOSES = [round(100 + 10 * math.sin(i / 15) + i * 0.05, 4) for i in range(N)]
DAYS = [END - timedelta(days=N - 1 - i) for i in range(N)]


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(1, d, c, c + 1, c - 1, c, 1000 + (i % 7) * 100) for i, (d, c) in enumerate(zip(DAYS, CLOSES))]
    rows += [(2, d, 5.0, 5.0, 5.0, 5.0, 10) for d in DAYS[-15:]]
    df = spark.createDataFrame(rows, "stock_id long, trade_date date, open double, high double, low double, close double, volume long")
    for c in ("open", "high", "low", "close"):
        df = df.withColumn(c, F.col(c).cast("decimal(18,4)"))
    return df.cache()


def close_on_or_before(day):
    return next(c for d, c in zip(reversed(DAYS), reversed(CLOSES)) if d <= day)


def test_metrics(bars):
    m = {r.stock_id: r for r in prices.price_metrics(bars).collect()}
    r = m[1]
    last = CLOSES[-1]
    assert r.as_of == END
    assert r.return_1w == pytest.approx(last / close_on_or_before(END - timedelta(days=7)) - 1, abs=1e-6)
    assert r.return_1m == pytest.approx(last / close_on_or_before(date(2024, 2, 29)) - 1, abs=1e-6)     # month end is clamped
    assert r.return_1y == pytest.approx(last / close_on_or_before(date(2023, 3, 31)) - 1, abs=1e-6)
    rets = [b / a - 1 for a, b in zip(CLOSES[-253:], CLOSES[-252:])]
    assert r.volatility_1y == pytest.approx(statistics.stdev(rets) * math.sqrt(252), abs=1e-6)
    peak, mdd = 0.0, 0.0
    for c in CLOSES[-252:]:
        peak = max(peak, c)
        mdd = min(mdd, c / peak - 1)
    assert r.max_drawdown_1y == pytest.approx(mdd, abs=1e-6)
    assert r.ma20 == pytest.approx(sum(CLOSES[-20:]) / 20, abs=1e-4)
    assert r.ma120_gap == pytest.approx(last / (sum(CLOSES[-120:]) / 120) - 1, abs=1e-6)
    vols = [1000 + (i % 7) * 100 for i in range(N)]
    assert r.volume_ratio_20d == pytest.approx(vols[-1] / (sum(vols[-21:-1]) / 20), abs=1e-6)
    window = [c for d, c in zip(DAYS, CLOSES) if d > date(2023, 3, 31)]
    assert float(r.high_52w) == pytest.approx(max(window) + 1) and float(r.low_52w) == pytest.approx(min(window) - 1)


def test_short_history_is_null(bars):
    r = {x.stock_id: x for x in prices.price_metrics(bars).collect()}[2]
    assert r.volatility_1y is None and r.max_drawdown_1y is None and r.ma20 is None and r.volume_ratio_20d is None and r.high_52w is None


def test_snapshots_see_no_later_bars(bars):
    day = DAYS[300]
    snap = prices.price_metrics(prices.at_snapshots(bars, "trade_date", [str(day), str(END)]), ("stock_id", "snapshot"))
    r = {(x.stock_id, x.snapshot): x for x in snap.collect()}
    assert (2, day) not in r and r[(1, day)].as_of == day
    assert float(r[(1, day)].close) == CLOSES[300]


def test_candles_and_monthly(bars):
    assert prices.candles(bars, 1).where("stock_id = 1").count() == (END - date(2024, 2, 29)).days
    m = {r.month: r for r in prices.stats_monthly(bars, "2024-03-10", 2).where("stock_id = 1").collect()}
    assert set(m) == {"2024-02", "2024-03"} and m["2024-03"].is_partial and m["2024-03"].trading_days == 10
    feb = [c for d, c in zip(DAYS, CLOSES) if d.year == 2024 and d.month == 2]
    assert m["2024-02"].monthly_return == pytest.approx(feb[-1] / feb[0] - 1, abs=1e-6)


def test_fin_ratios(spark):
    df = spark.createDataFrame([(1, date(2023, 12, 31), "FY", 1000., 100., 50., 500., 200.), (1, date(2024, 12, 31), "FY", 1200., 90., 60., 400., 200.),
                                (2, date(2021, 12, 31), "FY", 10., 1., 1., -5., 1.), (2, date(2024, 12, 31), "FY", 0., 1., 1., -5., 1.)],
                               "stock_id long, period_end date, period_type string, revenue double, operating_income double, net_income double, total_equity double, total_debt double")
    r = {x.stock_id: x for x in fundamentals.fin_ratios(df).collect()}
    assert (r[1].revenue_yoy, r[1].operating_income_yoy, r[1].operating_margin, r[1].roe, r[1].debt_ratio) == (0.2, -0.1, 0.075, 0.15, 0.5)
    assert r[2].roe is None and r[2].operating_margin is None and r[2].revenue_yoy is None


def test_plan_has_no_nested_loop(bars):
    plan = prices.price_metrics(bars)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
