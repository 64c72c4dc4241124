"""Rule tables of the engine, as data.

Fixed values: these weights, phrases, concept names, labels and patterns decide results, so they are stated as they are.
"""

from __future__ import annotations

BM25_K1, BM25_B = 1.5, 0.75
RRF_K = 60
CHUNK_TOKENS, CHUNK_OVERLAP = 650, 80

SECTION_WEIGHTS = {"liquidity": 0.14, "debt": 0.14, "credit_facilities": 0.13, "risk_factors": 0.02, "mda": -0.02}
TITLE_WEIGHTS = {
    "liquidity and capital resources": 0.03,
    "debt and commitments": 0.03,
    "total debt maturities": 0.04,
    "committed credit facilities": 0.03,
    "other unsecured credit facilities": 0.025,
}
CONTENT_WEIGHTS = {
    "carrying value of company debt": 0.08,
    "debt payable within one year": 0.08,
    "long-term debt payable": 0.06,
    "total debt maturities": 0.08,
    "company debt excluding ford credit": 0.04,
    "company liquidity": 0.04,
    "net liquidity available for use": 0.04,
    "committed capacity totaled": 0.04,
    "remains well capitalized": 0.06,
    "funding diversified across platforms": 0.06,
    "we expect": 0.04,
    "primarily due to": 0.04,
    "driven by": 0.04,
    "derivative financial instruments": -0.08,
    "hedging activities": -0.05,
    "special purpose entities": -0.04,
}
NUMERIC_MARKS = ["$", "billion", "million", "%"]
EXPLANATION_MARKS = ["we expect", "we believe", "primarily", "reflecting", "driven by", "explained by"]

DEBT_TERMS = ["debt payable", "long-term debt", "debt maturities", "company debt excluding ford credit", "public unsecured debt", "credit agreements", "committed credit lines"]
LIQUIDITY_TERMS = ["liquidity", "capital resources", "cash equivalents", "marketable securities", "available liquidity", "net liquidity available", "committed credit"]
MANAGEMENT_TERMS = ["we believe", "we expect", "primarily due to", "primarily", "reflecting", "explained by", "driven by", "our key priority", "we manage", "remains well capitalized", "management's discussion"]
EVIDENCE_NUMBER = r"(?i)(\$\s*\(?[0-9]|\b[0-9]+(?:\.[0-9]+)?\s*(?:billion|million|%))"

FINANCIAL_NUMBER = r"(?i)(?:\$ ?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\s*(?:B|billion|million|m)?)|(?:[+-]?[0-9]+(?:\.[0-9]+)?%)"
VERIFIED_TAG = r"\[verified:\s*([A-Za-z0-9_:\-.]+)\]"
STAGE_NUMBER = r"(?<![A-Za-z])[-+]?\$?[0-9][0-9,]*(?:\.[0-9]+)?%?"

LEGAL_SUFFIXES = ["inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "plc", "class", "common", "stock", "the"]
COMPANY_ALIASES = {
    "google": "alphabet",
    "google llc": "alphabet",
    "jp morgan": "jpmorgan chase",
    "j p morgan": "jpmorgan chase",
    "jpmorgan": "jpmorgan chase",
    "facebook": "meta platforms",
    "meta": "meta platforms",
}

ADVERSE_WHEN_UP = ["debt", "liabilit", "interest", "expense", "borrow", "leverage"]
FAVOURABLE_WHEN_UP = ["cash", "liquidity", "equity", "income", "earnings", "revenue", "asset", "working_capital"]

CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
SOURCE_RANK = {"xbrl": 2, "text": 1}

SAFE_CONCEPTS = {
    "total_debt": {"DebtAndFinancingArrangementsAmount": 0.96, "DebtLongtermAndShorttermCombinedAmount": 0.96, "DebtLongtermAndShorttermCombinedAmountCompanyExcludingFordCredit": 0.95, "LongTermDebt": 0.88, "DebtInstrumentCarryingAmount": 0.85},
    "current_debt": {"DebtCurrent": 0.96, "LongTermDebtCurrent": 0.95, "CurrentPortionOfLongTermDebt": 0.93},
    "long_term_debt": {"LongTermDebtNoncurrent": 0.96, "DebtNonCurrent": 0.95},
    "cash_and_equivalents": {"CashAndCashEquivalentsAtCarryingValue": 0.98, "CashAndCashEquivalentAtCarryingValue": 0.97, "Cash": 0.92},
    "shareholders_equity": {"StockholdersEquity": 0.98, "ShareholdersEquity": 0.96},
    "net_income": {"NetIncomeLoss": 0.98, "ProfitLoss": 0.94, "NetIncome": 0.92},
    "operating_cash_flow": {"NetCashProvidedByUsedInOperatingActivities": 0.98, "CashFlowFromOperatingActivities": 0.94},
    "capital_expenditures": {"PaymentForCapitalExpenditures": 0.98, "PaymentsToAcquirePropertyPlantAndEquipment": 0.95, "CapitalExpenditures": 0.92},
    "dividend_payments": {"PaymentsOfDividends": 0.98, "PaymentsOfDividendsCommonStock": 0.95, "PaymentsOfDividendsAndDividendEquivalentsOnCommonStockAndRestrictedStockUnits": 0.92},
    "current_assets": {"AssetsCurrent": 0.98, "CurrentAssets": 0.94},
    "current_liabilities": {"LiabilitiesCurrent": 0.98, "CurrentLiabilities": 0.94},
    "inventory": {"InventoryNet": 0.98, "Inventory": 0.94},
    "interest_expense": {"InterestExpense": 0.98, "InterestAndDebtExpense": 0.98, "InterestExpenseNonoperating": 0.95},
}
SEARCH_TERMS = {
    "total_debt": ["debt"],
    "current_debt": ["debt", "current", "borrowings"],
    "long_term_debt": ["debt", "noncurrent", "longterm"],
    "cash_and_equivalents": ["cash"],
    "shareholders_equity": ["equity", "stockholders", "shareholders"],
    "net_income": ["income", "profit", "loss"],
    "operating_cash_flow": ["cash", "operating"],
    "capital_expenditures": ["capital", "expenditures", "property", "equipment"],
    "dividend_payments": ["dividend"],
    "current_assets": ["assets", "current"],
    "current_liabilities": ["liabilities", "current"],
    "inventory": ["inventory"],
    "interest_expense": ["interest"],
}
#: metric, order, lower-case parts of which one must occur, part that must not occur, class, confidence.
REJECTIONS = [
    ("total_debt", 1, ["current", "shortterm", "commercialpaper"], None, "narrower_component", 0.3),
    ("current_debt", 1, ["commercialpaper", "shorttermborrowings"], None, "narrower_component", 0.4),
    ("current_debt", 2, ["noncurrent", "=longtermdebt"], None, "broader_or_mixed", 0.2),
    ("long_term_debt", 1, ["current"], None, "narrower_component", 0.2),
    ("long_term_debt", 2, ["=longtermdebt"], None, "broader_or_mixed", 0.45),
    ("cash_and_equivalents", 1, ["restricted"], None, "broader_or_mixed", 0.35),
    ("cash_and_equivalents", 2, ["proceeds", "payments"], None, "cash_flow_proxy", 0.25),
    ("shareholders_equity", 1, ["noncontrollinginterest"], None, "broader_or_mixed", 0.35),
    ("net_income", 1, ["comprehensive"], None, "broader_or_mixed", 0.3),
    ("net_income", 2, ["attributabletononcontrollinginterest"], None, "narrower_component", 0.2),
    ("operating_cash_flow", 1, ["continuingoperations"], None, "narrower_component", 0.45),
    ("operating_cash_flow", 2, ["investing", "financing"], None, "not_relevant", 0.05),
    ("capital_expenditures", 1, ["proceeds", "sale"], None, "cash_flow_proxy", 0.2),
    ("capital_expenditures", 2, ["business", "acquisition"], None, "broader_or_mixed", 0.25),
    ("dividend_payments", 1, ["declared", "payable"], None, "broader_or_mixed", 0.35),
    ("dividend_payments", 2, ["preferred"], None, "narrower_component", 0.35),
    ("current_assets", 1, [""], "assets", "not_relevant", 0.05),
    ("current_assets", 2, ["noncurrent"], None, "not_relevant", 0.05),
    ("current_liabilities", 1, [""], "liabilities", "not_relevant", 0.05),
    ("current_liabilities", 2, ["noncurrent"], None, "not_relevant", 0.05),
    ("inventory", 1, ["reserve", "allowance"], None, "narrower_component", 0.25),
    ("interest_expense", 1, ["paid", "payment", "payments"], None, "cash_flow_proxy", 0.35),
    ("interest_expense", 2, ["lease"], None, "narrower_component", 0.3),
    ("interest_expense", 3, ["income"], "expense", "not_relevant", 0.05),
    ("interest_expense", 4, ["tax", "noncontrolling"], None, "not_relevant", 0.05),
]

CLAIM_METRIC_ORDER = [
    "company_debt_excluding_ford_credit",
    "company_debt_payable_within_one_year",
    "company_long_term_debt_payable_after_one_year",
    "company_short_term_borrowings",
    "total_balance_sheet_cash_and_marketable_securities_restricted_cash",
    "company_cash",
    "company_liquidity",
    "ford_credit_net_liquidity_available_for_use",
    "ford_credit_liquidity_sources",
    "ford_credit_committed_capacity",
]

DEPENDENCIES = {"free_cash_flow": ["operating_cash_flow", "capital_expenditures"], "total_debt": ["current_debt", "long_term_debt"]}
CROSS_CHECK_TOLERANCE = 1.0
ANNUAL_FORMS = ["10-K", "10-K/A"]

NOISE_LABELS = [
    "year ended",
    "assets",
    "liabilities and shareholders equity",
    "current assets",
    "current liabilities",
    "cash flows from operating activities",
    "cash flows from investing activities",
    "cash flows from financing activities",
]
