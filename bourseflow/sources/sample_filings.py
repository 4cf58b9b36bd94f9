"""Filed facts, share counts and statement lines derived from the annual and quarterly statements of the sample folders.

One text per table; both Spark and the checking engine read it."""
from __future__ import annotations

from pyspark.sql import DataFrame

from bourseflow.sources.market_tables import Tables
from bourseflow.sources.stored import stored

S = "CAST(s.stock_id AS BIGINT)"
V = lambda c: f"CAST(s.{c} AS DECIMAL(24,2))"


def _fact(concept: str, value: str, src: str, where: str, start: str, form: str = "'10-K'", filed: str = "s.period_end + 60") -> str:
    return (f"SELECT {S} AS company, '{concept}' AS concept, {start} AS start, s.period_end AS end, CAST({value} AS DECIMAL(26,3)) AS value, {form} AS form, "
            f"{filed} AS filed FROM {src} s WHERE {where}")


def facts_sql(fy: str, q: str) -> str:
    year, none = "s.period_end - 364", "CAST(NULL AS DATE)"
    three, half, nine = "s.period_end - 91", "s.period_end - 181", "s.period_end - 272"
    b = lambda c, where, v, start=year: _fact(c, v, fy, where, start)
    rows = [
        b("RevenueFromContractWithCustomerExcludingAssessedTax", "s.stock_id % 3 <> 0", V("revenue")),
        b("Revenues", "s.stock_id % 4 < 2 OR s.stock_id % 3 = 0", V("revenue") + " * 1.5"),
        # the same year filed again later with another value
        _fact("RevenueFromContractWithCustomerExcludingAssessedTax", V("revenue") + " * 2", fy, "s.stock_id % 3 <> 0 AND year(s.period_end) % 2 = 0", year, filed="s.period_end + 420"),
        b("NetIncomeLoss", "s.stock_id % 5 <> 0", V("net_income")), b("ProfitLoss", "s.stock_id % 5 < 2", V("net_income") + " + 7"),
        b("OperatingIncomeLoss", "s.stock_id % 6 <> 1", V("operating_income")),
        b("IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest", "s.stock_id % 6 < 3", V("operating_income") + " - 11"),
        b("InterestExpense", "s.stock_id % 4 = 1", "11.5"),
        b("Assets", "s.stock_id >= 0", V("total_assets"), none),
        b("StockholdersEquity", "s.stock_id >= 0", f"CASE WHEN s.stock_id % 7 = 2 THEN 0.0 ELSE {V('total_equity')} END", none),
        b("PartnersCapital", "s.stock_id % 7 = 2", V("total_equity") + " + 1", none),
        b("Liabilities", "s.stock_id % 8 <> 3", V("total_debt"), none),
        b("LiabilitiesAndStockholdersEquity", "s.stock_id % 8 < 5", V("total_assets"), none),
        b("Goodwill", "s.stock_id % 9 = 1", "500.0", none), b("IntangibleAssetsNetExcludingGoodwill", "s.stock_id % 9 < 3", "300.0", none),
        b("LongTermDebtNoncurrent", "s.stock_id % 10 < 4", "90.0", none), b("LongTermDebtCurrent", "s.stock_id % 10 < 2", "20.0", none),
        b("ShortTermBorrowings", "s.stock_id % 10 = 7", "5.0", none),
        b("NetCashProvidedByUsedInOperatingActivities", "s.stock_id % 4 <> 2", V("net_income") + " + 3"),
        b("ComprehensiveIncomeNetOfTaxIncludingPortionAttributableToNoncontrollingInterest", "s.stock_id % 3 = 0", V("net_income") + " + 4"),
        b("IncomeLossFromEquityMethodInvestments", "s.stock_id % 5 = 1", "2.5"), b("NetIncomeLossAttributableToNoncontrollingInterest", "s.stock_id % 6 = 0", "1.5"),
        b("CashAndCashEquivalentsAtCarryingValue", "s.stock_id % 2 = 0", V("total_assets") + " * 0.1", none),
    ]
    for name, c in (("NetIncomeLoss", "net_income"), ("RevenueFromContractWithCustomerExcludingAssessedTax", "revenue"), ("OperatingIncomeLoss", "operating_income"),
                    ("NetCashProvidedByUsedInOperatingActivities", "total_debt")):
        rows.append(_fact(name, V(c), q, "s.period_type <> 'Q4' AND (s.stock_id % 5 <> 3 OR s.period_type = 'Q1')", three, "'10-Q'", "s.period_end + 40"))
        rows.append(_fact(name, V(c) + " * 2", q, "s.period_type = 'Q2'", half, "'10-Q'", "s.period_end + 40"))
        rows.append(_fact(name, V(c) + " * 3", q, "s.period_type = 'Q3'", nine, "'10-Q'", "s.period_end + 40"))
    rows.append(_fact("Assets", V("total_assets"), q, "s.period_type <> 'Q4'", none, "'10-Q'", "s.period_end + 40"))
    rows.append(_fact("Liabilities", V("total_debt"), q, "s.stock_id % 8 <> 3", none, "'10-Q'", "s.period_end + 40"))
    rows.append(_fact("CommonStockDividendsPerShareDeclared", f"CAST({V('revenue')} / 1000000 AS DECIMAL(12,2))", fy, "s.stock_id % 3 = 1", year))
    rows.append(_fact("CommonStockDividendsPerShareCashPaid", "0.25 + s.stock_id % 4 * 0.5", q, "s.stock_id % 3 = 2", "s.period_end - 88", "'10-Q'", "s.period_end + 40"))
    return "\nUNION ALL ".join(rows)


def shares_sql(fy: str) -> str:
    return (f"SELECT {S} AS company, s.period_end AS end, concat('A', CAST(year(s.period_end) AS STRING)) AS accn, 1000 + s.stock_id AS value FROM {fy} s\n"
            f"UNION ALL SELECT {S}, s.period_end, concat('A', CAST(year(s.period_end) AS STRING)), 500 + s.stock_id * 2 FROM {fy} s WHERE s.stock_id % 3 = 0\n"
            f"UNION ALL SELECT {S}, s.period_end, concat('B', CAST(year(s.period_end) AS STRING)), 1100 + s.stock_id FROM {fy} s WHERE s.stock_id % 2 = 0")


def lines_sql(fy: str) -> str:
    """Statement lines by id or by a numbered, spaced name; some reports or cells are absent; a separate statement beside some."""
    last = "s.stock_id % 11 = 5 AND year(s.period_end) = 1998"

    def line(no: int, st: str, account: str, name: str, col: str, where: str) -> str:
        def one(cons: str, amount: str, has: str) -> str:
            return (f"SELECT {S} AS company, s.period_end AS period_end, {cons} AS consolidated, '{st}' AS statement, {no} AS line_no, {account} AS account_id, "
                    f"{name} AS account_nm, CAST({amount} AS DECIMAL(26,3)) AS amount, {V(col)} - 1000 AS prior_amount FROM {fy} s WHERE NOT ({last}) AND {has} AND ({where})")
        return one("true", V(col), "s.stock_id % 4 <> 3") + "\nUNION ALL " + one("false", V(col) + " * 0.5", "true")

    return "\nUNION ALL ".join([
        line(1, "BS", "'ifrs-full_Assets'", "'자산 총계'", "total_assets", "true"),
        line(2, "BS", "'-'", "'Ⅱ. 부채 총계'", "total_debt", "true"),
        line(3, "BS", "'ifrs-full_Equity'", "'자본총계'", "total_equity", "true"),
        line(4, "IS", "'-'", "'I. 영업수익'", "revenue", "s.stock_id % 3 = 0"),
        line(5, "IS", "'ifrs-full_Revenue'", "'매출액'", "revenue", "s.stock_id % 3 = 1"),
        line(6, "CIS", "'-'", "'매출액'", "revenue", "s.stock_id % 3 <> 1"),
        line(7, "IS", "'dart_OperatingIncomeLoss'", "'영업이익'", "operating_income", "s.stock_id % 5 <> 2 OR year(s.period_end) % 2 = 0"),
        line(8, "IS", "'ifrs-full_ProfitLoss'", "'당기순이익'", "net_income", "true"),
        line(9, "BS", "'-'", "'1. 현금및현금성 자산'", "total_equity", "s.stock_id % 2 = 0"),
        line(10, "BS", "'ifrs-full_Goodwill'", "'영업권'", "total_debt", "s.stock_id % 3 = 2"),
        line(11, "CIS", "'dart_InterestExpense'", "'이자비용'", "operating_income", "s.stock_id % 4 = 1"),
        line(12, "CF", "'-'", "'영업활동 현금흐름'", "net_income", "s.stock_id % 5 <> 0"),
    ])


def annual(t: Tables) -> DataFrame:
    return stored(t.spark, f"statements|{t.folder}", lambda: t.statements)


def facts(t: Tables) -> DataFrame:
    quarters = stored(t.spark, f"quarters|{t.folder}", lambda: t.quarters)
    return t.spark.sql(facts_sql("{fy}", "{q}"), fy=annual(t), q=quarters)


def shares(t: Tables) -> DataFrame:
    return t.spark.sql(shares_sql("{fy}"), fy=annual(t))


def lines(t: Tables) -> DataFrame:
    return t.spark.sql(lines_sql("{fy}"), fy=annual(t))
