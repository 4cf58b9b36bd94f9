"""How filed concepts and statement lines become accounts."""
from __future__ import annotations

# account -> (filed concepts in order of priority, is it a period amount)
CONCEPTS = {
    "revenue": (("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet",
                 "RevenueFromContractWithCustomerIncludingAssessedTax"), True),
    "operating_income": (("OperatingIncomeLoss",), True),
    "net_income": (("NetIncomeLoss", "NetIncomeLossAvailableToCommonStockholdersBasic", "ProfitLoss"), True),
    "total_assets": (("Assets",), False),
    "total_equity": (("StockholdersEquity", "PartnersCapital",
                      "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
                      "PartnersCapitalIncludingPortionAttributableToNoncontrollingInterest"), False),
    "total_debt": (("Liabilities",), False),
    "operating_cf": (("NetCashProvidedByUsedInOperatingActivities",
                      "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"), True),
    "comprehensive_income": (("ComprehensiveIncomeNetOfTax",
                              "ComprehensiveIncomeNetOfTaxIncludingPortionAttributableToNoncontrollingInterest"), True),
    "equity_method_income": (("IncomeLossFromEquityMethodInvestments",), True),
    "cash": (("CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"), False),
    "goodwill": (("Goodwill",), False),
    "interest_expense": (("InterestExpense", "InterestExpenseNonoperating", "InterestExpenseDebt", "InterestAndDebtExpense"), True),
    "nci_net_income": (("NetIncomeLossAttributableToNoncontrollingInterest",), True),
    # helpers for derived accounts
    "pretax": (("IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
                "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments"), True),
    "liabilities_and_equity": (("LiabilitiesAndStockholdersEquity",), False),
    "equity_with_nci": (("StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
                         "PartnersCapitalIncludingPortionAttributableToNoncontrollingInterest"), False),
    "intangibles_total": (("IntangibleAssetsNetIncludingGoodwill",), False),
    "intangibles_other": (("IntangibleAssetsNetExcludingGoodwill", "FiniteLivedIntangibleAssetsNet"), False),
    "ltd_total": (("LongTermDebt",), False),
    "ltd_noncurrent": (("LongTermDebtNoncurrent",), False),
    "ltd_current": (("LongTermDebtCurrent",), False),
    "short_debt": (("ShortTermBorrowings", "CommercialPaper"), False),
}
DIVIDEND_CONCEPTS = ("CommonStockDividendsPerShareDeclared", "CommonStockDividendsPerShareCashPaid")

# account -> (statements, account ids, account names), searched in this order
STATEMENT_LINES = {
    "revenue": (("IS", "CIS"), ("ifrs-full_Revenue",), ("매출액", "수익(매출액)", "영업수익", "매출", "매출액(영업수익)", "수익")),
    "operating_income": (("IS", "CIS"), ("dart_OperatingIncomeLoss",), ("영업이익(손실)", "영업이익", "영업손실", "영업손익")),
    "net_income": (("IS", "CIS"), ("ifrs-full_ProfitLossAttributableToOwnersOfParent", "ifrs-full_ProfitLoss"),
                   ("지배기업의소유주에게귀속되는당기순이익(손실)", "지배기업소유주지분", "당기순이익(손실)", "당기순이익", "연결당기순이익")),
    "total_assets": (("BS",), ("ifrs-full_Assets",), ("자산총계",)),
    "total_equity": (("BS",), ("ifrs-full_EquityAttributableToOwnersOfParent", "ifrs-full_Equity"),
                     ("지배기업의소유주에게귀속되는자본", "지배기업소유주지분", "자본총계")),
    "total_debt": (("BS",), ("ifrs-full_Liabilities",), ("부채총계",)),
    "cash": (("BS",), ("ifrs-full_CashAndCashEquivalents",), ("현금및현금성자산",)),
    "goodwill": (("BS",), ("ifrs-full_Goodwill",), ("영업권",)),
    "interest_expense": (("IS", "CIS"), ("ifrs-full_InterestExpense", "dart_InterestExpense"), ("이자비용",)),
    "operating_cf": (("CF",), ("ifrs-full_CashFlowsFromUsedInOperatingActivities",),
                     ("영업활동현금흐름", "영업활동으로인한현금흐름", "영업활동으로부터의현금흐름", "영업활동순현금흐름")),
}
CORE_ACCOUNTS = ("revenue", "operating_income", "net_income", "total_assets", "total_equity", "total_debt")
FLOW_ACCOUNTS = ("revenue", "operating_income", "net_income", "operating_cf", "comprehensive_income", "equity_method_income", "interest_expense", "nci_net_income")
BALANCE_ACCOUNTS = ("total_assets", "total_equity", "total_debt", "cash", "goodwill")
# money columns of a stored statement
MONEY_ACCOUNTS = (*CORE_ACCOUNTS, "operating_cf", "comprehensive_income", "equity_method_income", "interest_expense", "nci_net_income", "cash", "goodwill",
                  "intangibles", "borrowings")
LINE_ACCOUNTS = tuple(STATEMENT_LINES)
NAME_PREFIX = r"^[\sⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩIVX\d\.\-]+"
# columns of the bulk statement files (tab separated, cp949)
BULK_COLUMNS = {"kind": "재무제표종류", "code": "종목코드", "period_end": "결산기준일", "report": "보고서종류",
                "account_id": "항목코드", "account_nm": "항목명", "amount": "당기"}
BULK_CURRENCY, BULK_REPORT = "통화", "사업보고서"
BULK_STATEMENTS = ("재무상태표", "포괄손익계산서", "손익계산서", "연결")
