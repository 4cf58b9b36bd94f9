"""What keeps the work of a query in step with its input: each table is read, shuffled and made once."""
from datetime import date
from decimal import Decimal as D
from types import SimpleNamespace

from bourseflow.operators import audits, point_in_time, portfolio
from bourseflow.sources.stored import kept


def test_slices_read_the_positions_once(spark, tmp_path):
    rows = [(1, s, D(10), D(v) if v else None) for s, v in enumerate((5, 50, 40, 40, None, 7))]
    rows += [(2, 9, None, None), (3, 8, D(30), D(25)), (3, 9, D(100), None), (None, 1, D(5), D(5))]
    spark.createDataFrame(rows, "portfolio_id long, stock_id long, cost_krw decimal(24,2), value_krw decimal(24,0)").write.parquet(str(tmp_path / "p"))
    # the first portfolio comes twice, the third has spent its seed, the fourth holds nothing
    owners = spark.createDataFrame([(1, D(70)), (1, D(65)), (2, D(9)), (3, D(130)), (4, D(1))], "portfolio_id long, seed_krw decimal(24,2)")
    out = portfolio.slices(spark.read.parquet(str(tmp_path / "p")), owners, 3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = sorted((r.portfolio_id, r.slice, r.amount, r.share) for r in out.collect())
    total = 50 + 40 + 40 + 22 + 10 + 5
    assert got == [(1, "cash", D(5), round(5 / total, 6)), (1, "cash", D(10), round(10 / total, 6)), (1, "other 3", D(22), round(22 / total, 6)),
                   (1, "stock 1", D(50), round(50 / total, 6)), (1, "stock 2", D(40), round(40 / total, 6)), (1, "stock 3", D(40), round(40 / total, 6)),
                   (2, "cash", D(9), 1.0), (2, "stock 9", None, None), (3, "stock 8", D(25), 0.2), (3, "stock 9", D(100), 0.8)]


def test_constraints_make_derived_tables_once(spark):
    def table(columns, *rows):
        return spark.createDataFrame(list(rows), columns)
    day = date(2024, 1, 2)
    t = SimpleNamespace(
        prices=table("stock_id long, trade_date date, open double, high double, low double, close double, volume long", (1, day, 1.0, 1.0, 1.0, 1.0, 1)),
        logs=table("started_at date, finished_at date, status string, error string", (day, day, "SUCCESS", None)),
        fx=table("rate_at date, usd_krw double, granularity string", (day, 1.0, "DAILY")),
        items=table("portfolio_id long, stock_id long, quantity long, ref_price double, ref_fx_rate double, cost_krw decimal(24,2)",
                    (1, 1, 1, 1.0, 1.0, D(60)), (1, 1, 0, 1.0, 1.0, D(60)), (1, 7, 1, None, 1.0, D(1)), (2, None, 1, -1.0, 1.0, None)),
        valuations=table("stock_id long, as_of date, per double, pbr double, shares_outstanding long, market_cap double", (1, day, 0.0, 1.0, 1, 1.0), (1, day, 1.0, 1.0, 0, None)),
        statements=table("stock_id long, period_end date, period_type string, total_assets double", (1, day, "FY", 1.0)),
        index_prices=table("index_id int, trade_date date, close double", (1, day, 0.0), (1, None, 1.0), (1, None, 1.0)),
        disclosures=table("rcept_no string, stock_id long, title string, filed_at date, data_source string", ("1", 1, "t", day, "SEC")),
        stocks=table("stock_id long, market string, ticker string, coverage string, share_ratio int", (1, "m", "a", "listed", None)),
        members=table("group_id int, stock_id long, is_primary boolean", (1, 1, True)), groups=table("group_id int", (1,)),
        watchlist=table("user_id long, stock_id long", (1, 1), (1, 1), (2, 8)).limit(0),
        portfolios=table("portfolio_id long, seed_krw decimal(24,2)", (1, D(120)), (2, D(1))))
    scores = table("stock_id long, preset string, snapshot date, score double, composite double", (1, "p", day, 1.0, 1.0))
    weights = table("preset string, weight double", ("p", 1.0))
    made = []

    def keep(name, df):
        made.append(name)
        return kept(df)

    out = audits.constraints(t, weights, scores, keep=keep)
    assert made == ["items", "watchlist"] and "ref_fx_rate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.part: (r.violations, r.detail) for r in out.collect()}
    assert {k: got[k] for k in ("position", "item key", "item stock", "seed")} == {"position": (2, 4.0), "item key": (1, 3.0), "item stock": (1, 2.0), "seed": (1, 2.0)}
    assert {k: got[k] for k in ("watch key", "watch stock", "index close", "index key")} == {
        "watch key": (0, 0.0), "watch stock": (0, 0.0), "index close": (1, 3.0), "index key": (1, 2.0)}
    assert {k: got[k] for k in ("valuation signs", "valuation shares", "market value", "valuation key")} == {
        "valuation signs": (1, 2.0), "valuation shares": (1, 2.0), "market value": (0, 2.0), "valuation key": (1, 1.0)}


def test_windows_over_bars_carry_no_wide_sums(spark):
    bars = spark.createDataFrame([(1, date(2024, 1, d), D(d), D(d), D(d), d) for d in range(1, 29)],
                                 "stock_id long, trade_date date, close decimal(18,4), high decimal(18,4), low decimal(18,4), volume long")
    seen = point_in_time._running(point_in_time._places(bars, "trade_date", ["2024-01-28"]))
    assert not [f.name for f in seen.schema.fields if getattr(f.dataType, "precision", 0) > 18]
    got = point_in_time.price_metrics_at(bars, ["2024-01-28"]).first()
    assert (got.ma20, got.ma60, got.avg_volume_20d) == (18.5, None, 18.0)
