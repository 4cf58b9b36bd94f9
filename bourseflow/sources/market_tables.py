"""Market tables read from a folder of star-schema parquet files.

A deployment would point `Tables` at landed market data. For the sample folders the same tables are derived with Spark:
supplier -> stock, nation -> theme, region -> market, supplier x ship date -> daily bar, supplier x year -> annual
statement, orders -> filings and daily FX, customer -> portfolio and watchlist owner, events -> ingestion log and FX quotes.
Every frame is lazy, so a query only scans the columns it needs.
"""
from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bourseflow import constants as K
from bourseflow.functions.exprs import half_up

MONEY = "decimal(24,2)"
PRICE = "decimal(18,4)"


def price4(cents: str = "cents", qty: str = "qty") -> Column:
    """Unit price in 1/10000, rounded half up with integer arithmetic."""
    return F.expr(f"({cents} * 200 + {qty}) div (2 * {qty})")


def from4(c: Column) -> Column:
    return (c.cast("decimal(14,0)") * F.lit("0.0001").cast("decimal(4,4)")).cast(PRICE)


def krw(hundredths: Column) -> Column:
    return ((F.lit(125000) + hundredths).cast("decimal(10,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(12,4)")


def literal_rows(spark: SparkSession, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """A short parameter list as a table (an in-memory relation, no job)."""
    items = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.explode(F.array(*items)).alias("r")).select("r.*")


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.facts_kept = False

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ------------------------------------------------------------------ dimensions
    @cached_property
    def markets(self) -> DataFrame:
        """Five rows; the smallest key space of all, safe to broadcast."""
        home = F.col("r_regionkey") < 2
        return self.raw("region").select(
            F.col("r_regionkey").cast("int").alias("market_id"), F.col("r_name").alias("market"),
            F.when(home, "KR").otherwise("US").alias("country"), F.when(home, "KRW").otherwise("USD").alias("currency"),
            F.when(home, "Asia/Seoul").otherwise("America/New_York").alias("timezone"))

    @cached_property
    def groups(self) -> DataFrame:
        """Twenty-five themes."""
        k = F.col("n_nationkey")
        return self.raw("nation").select(
            k.cast("int").alias("group_id"), F.col("n_name").alias("theme"),
            F.concat(F.lit("SECTOR-"), (k % 7).cast("string")).alias("sector"),
            F.when(k == 24, "none").when(k % 5 == 4, "financial").otherwise("general").alias("family"),
            (k % 6 == 2).alias("commodity_linked"))

    @cached_property
    def stocks(self) -> DataFrame:
        s = F.col("s_suppkey")
        slot = F.floor(s / 5) % 10
        market = (s % 5).cast("int")
        company = F.when(s % 11 == 10, s - 5).otherwise(s)
        themed = s % 29 != 28
        base = self.raw("supplier").select(
            s.alias("stock_id"), market.alias("market_id"),
            F.lpad(s.cast("string"), 6, "0").alias("ticker"), F.col("s_name").alias("name"),
            F.upper("s_name").alias("name_en"),
            F.when(slot == 0, "listed").when(slot <= 5, "benchmark").otherwise("featured").alias("coverage"),
            (s % 37 != 36).alias("is_active"),
            F.lpad(company.cast("string"), 8, "0").alias("company"),
            F.when((market >= 2) & (s % 13 == 5), F.lit(2)).cast("int").alias("share_ratio"),
            (F.lit(100) + s % 50 * 20).alias("shares"),
            F.when(themed, F.col("s_nationkey")).cast("int").alias("group_id"),
            F.lpad((F.col("s_nationkey") * 400 + s % 400).cast("string"), 5, "0").alias("ksic"),
            (F.lit(1000) + F.col("s_nationkey") * 100 + s % 100).cast("int").alias("sic"),
            F.col("s_acctbal"))
        base = base.join(F.broadcast(self.markets), "market_id")
        return (base.join(F.broadcast(self.groups.select("group_id", "sector")), "group_id", "left"))

    @cached_property
    def members(self) -> DataFrame:
        """Theme membership: one primary theme, and a second theme for some stocks."""
        second = ((F.col("group_id") + 1 + F.col("stock_id") % 3) % 25).cast("int")
        both = F.array_compact(F.array(
            F.struct(F.col("group_id").alias("group_id"), F.lit(True).alias("is_primary")),
            F.when(F.col("stock_id") % 4 == 1, F.struct(second.alias("group_id"), F.lit(False).alias("is_primary")))))
        return (self.stocks.where(F.col("group_id").isNotNull())
                .select("stock_id", F.explode(both).alias("m")).select("m.group_id", "stock_id", "m.is_primary"))

    @cached_property
    def presets(self) -> DataFrame:
        rows = [(c, K.PRESET_ORDER[c], c == K.DEFAULT_PRESET, f, float(w))
                for c, ws in K.PRESETS.items() for f, w in zip(K.FACTORS, ws)]
        return literal_rows(self.spark, ("preset", "sort_order", "is_default", "factor", "weight"), rows)

    # ------------------------------------------------------------------ facts
    @cached_property
    def trades(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_suppkey").alias("stock_id"), F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line"), F.to_date("l_shipdate").alias("trade_date"),
            F.floor(F.col("l_extendedprice") * 100 + F.lit(0.5)).alias("cents"),
            F.col("l_quantity").cast("long").alias("qty"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("ext"),
            F.col("l_discount").cast("decimal(3,2)").alias("disc"), F.col("l_tax").cast("decimal(3,2)").alias("tax"),
            F.col("l_returnflag").alias("flag"))

    @cached_property
    def newest_day(self) -> date:
        """Date of the newest trade: the day that reports speak about unless they are given another. One scan of one column."""
        return self.trades.agg(F.max("trade_date")).first()[0] or date(1970, 1, 1)

    @cached_property
    def prices(self) -> DataFrame:
        """Daily bars. First and last trade are the least and the greatest (order, line, price), whatever their size, so the whole
        aggregation keeps fixed-size buffers and combines on the map side, also for a stock with most of the trades."""
        t = self.trades.withColumn("px", price4())
        whole = F.col("order_id").isNotNull() & F.col("line").isNotNull() & F.col("px").isNotNull()
        bars = (t.withColumn("k", F.when(whole, F.struct("order_id", "line", "px"))).groupBy("stock_id", "trade_date")
                .agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.max("px").alias("hi"), F.min("px").alias("lo"),
                     F.sum("qty").alias("volume")))
        return bars.select("stock_id", "trade_date", from4(F.col("k0.px")).alias("open"), from4(F.col("hi")).alias("high"),
                           from4(F.col("lo")).alias("low"), from4(F.col("k1.px")).alias("close"), "volume")

    @cached_property
    def indices(self) -> DataFrame:
        return self.markets.select(F.col("market_id").alias("index_id"), F.concat(F.lit("IX-"), "market").alias("code"),
                                   "market", "country", "currency", F.col("market_id").alias("display_order"))

    @cached_property
    def index_prices(self) -> DataFrame:
        """Mean close per market and date (the index level)."""
        m = self.stocks.select("stock_id", "market_id")
        return (self.prices.join(m, "stock_id").groupBy(F.col("market_id").alias("index_id"), "trade_date")
                .agg(half_up(F.try_divide(F.sum("close").cast("double"), F.count("close").cast("double")), 4).alias("close")))

    @cached_property
    def statements(self) -> DataFrame:
        """Annual statements (FY, 31 December)."""
        ext = F.sum("ext").cast("decimal(22,2)")
        sums = (self.trades.groupBy("stock_id", F.year("trade_date").alias("fy"))
                .agg(ext.alias("ext"), F.sum(F.col("ext") * F.col("disc")).cast("decimal(24,4)").alias("dsc"),
                     F.sum(F.col("ext") * F.col("tax")).cast("decimal(24,4)").alias("tx")))
        return statement_accounts(sums, F.make_date("fy", F.lit(12), F.lit(31))).withColumn("period_type", F.lit("FY"))

    @cached_property
    def quarters(self) -> DataFrame:
        """Three-month statements from the same trades."""
        q_end = F.last_day(F.add_months(F.trunc("trade_date", "quarter"), 2))
        ext = F.sum("ext").cast("decimal(22,2)")
        sums = (self.trades.groupBy("stock_id", q_end.alias("q_end"))
                .agg(ext.alias("ext"), F.sum(F.col("ext") * F.col("disc")).cast("decimal(24,4)").alias("dsc"),
                     F.sum(F.col("ext") * F.col("tax")).cast("decimal(24,4)").alias("tx")))
        return (statement_accounts(sums, F.col("q_end"))
                .withColumn("period_type", F.concat(F.lit("Q"), F.quarter("period_end").cast("string"))))

    @cached_property
    def valuations(self) -> DataFrame:
        """One valuation per stock and year at the year's last bar, on the statements of the year before."""
        last = (self.prices.groupBy("stock_id", F.year("trade_date").alias("yr"))
                .agg(F.max("trade_date").alias("as_of"), F.max_by("close", "trade_date").alias("close")))
        fy = self.statements.select("stock_id", (F.year("period_end") + 1).alias("yr"), "net_income", "total_equity")
        shares = self.stocks.select("stock_id", "shares")
        j = last.join(fy, ["stock_id", "yr"], "left").join(shares, "stock_id")
        sh = F.col("shares").cast("double")
        close, ni, eq = (F.col(c).cast("double") for c in ("close", "net_income", "total_equity"))
        return j.select(
            "stock_id", "as_of",
            F.when(ni > 0, half_up(close / (ni / sh), 4)).alias("per"),
            F.when(eq > 0, half_up(close / (eq / sh), 4)).alias("pbr"),
            half_up(ni / sh, 4).alias("eps"), half_up(eq / sh, 4).alias("bps"),
            half_up(close * sh, 0).alias("market_cap"), F.col("shares").alias("shares_outstanding"),
            F.when(F.col("stock_id") % 3 == 0, half_up(close * F.lit(0.01), 4)).alias("dps"),
            F.lit("DERIVED").alias("source"))

    @cached_property
    def fx_daily(self) -> DataFrame:
        """USD/KRW: one DAILY point per order date."""
        cents = F.floor(F.col("o_totalprice") * 100 + F.lit(0.5))
        per_day = self.raw("orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum(cents).alias("c"))
        return per_day.select(F.col("d").cast("timestamp").alias("rate_at"), krw(F.col("c") % 10000).alias("usd_krw"), F.lit("DAILY").alias("granularity"))

    @cached_property
    def fx_snapshots(self) -> DataFrame:
        """One SNAPSHOT quote per purchase event."""
        e = self.raw("events").where(F.col("event_type") == "purchase")
        return e.select(F.col("ts").cast("timestamp").alias("rate_at"), krw(F.col("event_id") * 37 % 10000).alias("usd_krw"),
                        F.lit("SNAPSHOT").alias("granularity"))

    @cached_property
    def fx(self) -> DataFrame:
        return self.fx_daily.unionByName(self.fx_snapshots)

    @cached_property
    def disclosures(self) -> DataFrame:
        last = self.raw("supplier").agg(F.max("s_suppkey")).scalar()
        status, prio = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
        return self.raw("orders").select(
            F.lpad(F.col("o_orderkey").cast("string"), 14, "0").alias("rcept_no"),
            (F.col("o_custkey") % (last + 1)).alias("stock_id"),
            F.when(prio == "1", "[첨부추가]사업보고서").when(prio == "2", "사업보고서").otherwise("분기보고서").alias("title"),
            F.when(prio == "1", "10-K").when(prio == "2", "정기공시").when(prio == "3", "10-Q").otherwise("8-K").alias("report_type"),
            F.col("o_orderdate").cast("timestamp").alias("filed_at"),
            F.when(status == "O", "DART").when(status == "F", "SEC").otherwise("KIND").alias("data_source"))

    @cached_property
    def items(self) -> DataFrame:
        """Portfolio positions: everything one customer bought from one supplier."""
        o = self.raw("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("portfolio_id"),
                                      F.to_date("o_orderdate").alias("order_date"))
        agg = (self.trades.select("order_id", "stock_id", "cents", "qty").join(o, "order_id")
               .groupBy("portfolio_id", "stock_id")
               .agg(F.sum("qty").alias("quantity"), F.sum("cents").alias("cents"), F.min("order_date").alias("ref_date")))
        cur = self.stocks.select("stock_id", "currency")
        return (agg.withColumn("ref_price", from4(price4("cents", "quantity"))).join(cur, "stock_id")
                .select("portfolio_id", "stock_id", "quantity", "ref_price",
                        F.when(F.col("currency") == "USD", F.lit(1200) + F.col("portfolio_id") % 200).otherwise(F.lit(1))
                        .cast("decimal(12,4)").alias("ref_fx_rate"), "ref_date")
                .withColumn("cost_krw", F.round(F.col("quantity").cast("decimal(18,0)")
                                                * (F.col("ref_price") * F.col("ref_fx_rate")).cast("decimal(20,4)"), 2)
                            .cast("decimal(24,2)")))

    @cached_property
    def portfolios(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("portfolio_id"), F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
            (F.col("c_acctbal").cast("decimal(12,2)") * 200000 + 2000000000).cast("decimal(24,2)").alias("seed_krw"))

    @cached_property
    def users(self) -> DataFrame:
        """Owners; guests are the household segment."""
        guest = F.col("c_mktsegment") == "HOUSEHOLD"
        o = self.raw("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderdate").alias("last_seen_at"))
        u = self.raw("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.when(guest, F.concat(F.lit(K.GUEST_PREFIX), "c_name")).otherwise(F.col("c_name")).alias("nickname"),
            F.when(~guest, F.concat("c_name", F.lit("@example.org"))).alias("email"))
        return u.join(o, "user_id", "left")

    @cached_property
    def watchlist(self) -> DataFrame:
        """A customer watches the suppliers of returned lines."""
        o = self.raw("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
                                      F.to_date("o_orderdate").alias("d"))
        t = self.trades.where(F.col("flag") == "R").select("order_id", "stock_id", price4().alias("px"))
        return (t.join(o, "order_id").groupBy("user_id", "stock_id")
                .agg(F.min("d").alias("added_at"), from4(F.max("px")).alias("target_price"))
                .withColumn("sort_order", (F.col("stock_id") % 7).cast("int")))

    def reviewed(self, least: int = 100_000) -> DataFrame:
        """The table of reviewed stocks (one row per customer and stock), made of the watched ones with a high target."""
        return self.watchlist.where(F.col("target_price") > least)

    @cached_property
    def large_positions(self) -> DataFrame:
        """The table of positions that retention must respect, made of the large items."""
        return self.items.where("quantity > 170")

    @cached_property
    def logs(self) -> DataFrame:
        u = F.col("user_id")
        k = F.get_json_object("props", "$.k")
        status = F.when(u % 5 == 0, "FAILED").when(u % 7 == 1, "SKIPPED").otherwise("SUCCESS")
        started = F.col("ts").cast("timestamp")
        error = (F.when(status != "FAILED", F.when(u % 4 == 1, F.concat(F.lit("격리 "), k, F.lit("행 {}"))))
                 .when(u % 2 == 0, F.concat(F.lit("PARTIAL "), k, F.lit("\nsecond line")))
                 .otherwise(F.concat(F.lit("timeout "), k)))
        return self.raw("events").select(
            F.col("event_id").alias("log_id"), F.upper("event_type").alias("job_type"),
            F.when(u % 3 == 0, "REFRESH").when(u % 3 == 1, "DART").otherwise("SEC").alias("source"), status.alias("status"),
            u.alias("stock_id"), started.alias("started_at"),
            (started + F.expr("make_interval(0, 0, 0, 0, 0, 0, 30)")).alias("finished_at"),
            error.alias("error"))


def statement_accounts(sums: DataFrame, period_end: Column) -> DataFrame:
    ext, dsc, tx = F.col("ext"), F.col("dsc"), F.col("tx")
    d = lambda v, p, s: F.lit(v).cast(f"decimal({p},{s})")
    debt_share = (F.lit(3) + F.col("stock_id") % 13).cast("decimal(3,0)")
    sums = sums.withColumn("oi", (ext * d("0.053", 4, 3) - dsc).cast("decimal(28,5)"))
    sums = (sums.withColumn("assets", (ext * d("1.4", 2, 1) + d("50000", 6, 0)).cast("decimal(24,2)"))
            .withColumn("debt", (ext * debt_share * d("0.1", 1, 1)).cast("decimal(24,2)"))
            .withColumn("ni", (F.col("oi") * d("0.8", 1, 1) + tx * d("0.5", 1, 1) - ext * d("0.018", 4, 3)).cast("decimal(24,2)")))
    return sums.select(
        "stock_id", period_end.alias("period_end"), (ext - dsc).cast(MONEY).alias("revenue"),
        F.col("oi").cast(MONEY).alias("operating_income"), F.col("ni").alias("net_income"),
        F.col("assets").alias("total_assets"), (F.col("assets") - F.col("debt")).cast(MONEY).alias("total_equity"),
        F.col("debt").alias("total_debt"))
