"""Small inline inputs for operators that the driver tables cannot feed."""

from __future__ import annotations

HEADINGS = ["Item 7A Quantitative", "Item 1A Risk Factors", "Item 7. Management's Discussion", "Liquidity and Capital Resources", "Long-Term Debt.", "Credit Facilities", "Cash Flows", "Total Debt Maturities", "Note 9 Debt and Commitments", "Note 4", "Outlook", "Plain words"]

CONCEPTS = ["LongTermDebt", "DebtCurrent", "LongTermDebtNoncurrent", "DebtInstrumentCarryingAmount", "CommercialPaper", "InterestExpense", "InterestPaidNet", "InterestExpenseNonoperating", "InterestIncomeOther", "OperatingLeaseInterest", "CashAndCashEquivalentsAtCarryingValue", "RestrictedCash", "ProceedsFromCashSale", "NetIncomeLoss", "ProfitLoss", "ComprehensiveIncomeNetOfTax", "DebtAndFinancingArrangementsAmount", "DebtLongtermAndShorttermCombinedAmount", "PaymentsOfDividends", "DividendsDeclared"]
RESOLVER_METRICS = ["total_debt", "current_debt", "long_term_debt", "cash_and_equivalents", "net_income", "dividend_payments", "interest_expense"]

REJECT_LABELS = ["property plant and equipment net", "additions to equipment not yet paid", "purchases under lease", "additional paid in capital", "lease interest", "interest paid on loans", "cash paid for interest", "interest expense", "purchases of property and equipment"]

COMPANY_QUERIES = ["ara", "BRA", "Japan Holding", "United", "the france holding co", "nation of nowhere", "UNITED KINGDOM HOLDING", "donesia", "ind", "holding", "Viet", ""]
