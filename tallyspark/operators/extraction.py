"""Numeric facts from narrative text and from tagged numbers, with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.facts import by_priority, first_in

#: Section types, metric, pattern with the fiscal year as {year}, group, method, confidence, review.
NARRATIVE = [
    (["liquidity", "mda"], "total_balance_sheet_cash_and_marketable_securities_restricted_cash", r"(?is)At December 31, {year}, total (?:balance sheet )?cash, cash equivalents, marketable securities, and restricted cash, .*? was \$\s*([0-9.]+) billion", 1, "sentence_narrative", "high", False),
    (["liquidity", "mda"], "company_cash", r"(?is)At December 31, {year}, we had Company cash of \$\s*([0-9.]+) billion and liquidity of \$\s*([0-9.]+) billion", 1, "sentence_narrative", "high", False),
    (["liquidity", "mda"], "company_liquidity", r"(?is)At December 31, {year}, we had Company cash of \$\s*([0-9.]+) billion and liquidity of \$\s*([0-9.]+) billion", 2, "sentence_narrative", "high", False),
    (["liquidity", "mda"], "company_cash", r"(?is)Balance Sheets \(\$B\)\s+Company Cash\s+\$\s*([0-9.]+)\s+\$\s*([0-9.]+)\s+Liquidity\s+([0-9.]+)\s+([0-9.]+)", 2, "table_flattened", "low", True),
    (["liquidity", "mda"], "company_liquidity", r"(?is)Balance Sheets \(\$B\)\s+Company Cash\s+\$\s*([0-9.]+)\s+\$\s*([0-9.]+)\s+Liquidity\s+([0-9.]+)\s+([0-9.]+)", 4, "table_flattened", "low", True),
    (["credit_facilities"], "ford_credit_net_liquidity_available_for_use", r"(?is)At December 31, {year}, Ford Credit.s net liquidity available for use was \$\s*([0-9.]+) billion[^.]*\.", 1, "sentence_narrative", "high", False),
    (["credit_facilities"], "ford_credit_liquidity_sources", r"(?is)At December 31, {year}, Ford Credit.s liquidity sources, including cash, committed asset-backed facilities, and unsecured credit facilities, totaled \$\s*([0-9.]+) billion[^.]*\.", 1, "sentence_narrative", "high", False),
    (["credit_facilities"], "ford_credit_committed_capacity", r"(?is)At December 31, {year}, Ford Credit.s committed capacity totaled \$\s*([0-9.]+) billion[^.]*\.", 1, "sentence_narrative", "high", False),
]
#: Tagged concepts of each debt metric, first choice first.
DEBT_CONCEPTS = {
    "company_debt_excluding_ford_credit": ["DebtLongtermAndShorttermCombinedAmountCompanyExcludingFordCredit", "DebtAndCapitalLeaseObligationsOperatingSegmentsCompanyExcludingFordCredit", "DebtLongtermAndShorttermCombinedAmountOperatingSegmentsCompanyExcludingFordCredit"],
    "company_debt_payable_within_one_year": ["LongTermDebtCurrentCompanyExcludingFordCredit", "LongTermDebtCurrentOperatingSegmentsCompanyExcludingFordCredit"],
    "company_long_term_debt_payable_after_one_year": ["LongTermDebtNoncurrentCompanyExcludingFordCredit", "LongTermDebtAndCapitalLeaseObligationsCompanyExcludingFordCredit", "LongTermDebtNoncurrentOperatingSegmentsCompanyExcludingFordCredit"],
    "company_short_term_borrowings": ["ShortTermBorrowingsCompanyExcludingFordCredit", "ShortTermBorrowingsOperatingSegmentsCompanyExcludingFordCredit"],
}


def fact_id(company: Column, year: Column, metric: Column, source: Column, confidence: Column, review: Column) -> Column:
    return F.concat_ws("_", F.lower(company), year.cast("string"), metric, source, confidence, F.when(review, F.lit("review")))


def narrative_facts(chunks: DataFrame, patterns: list[tuple] = NARRATIVE) -> DataFrame:
    """One row for each pattern that a chunk matches: values in billions, the matched text as source_text.

    chunks: company, chunk_id, fiscal_year, section_type, text. The chunk's year is part of the pattern. The
    patterns are a short fixed table, so each chunk is read once and nothing is shuffled.
    """
    text = F.translate("text", "’", "'")
    found = []
    for sections, metric, pattern, group, method, confidence, review in patterns:
        regex = F.replace(F.lit(pattern), F.lit("{year}"), F.col("fiscal_year").cast("string"))
        value = F.get(F.regexp_extract_all(text, regex, F.lit(group)), F.lit(0))
        whole = F.get(F.regexp_extract_all(text, regex, F.lit(0)), F.lit(0))
        row = F.struct(F.lit(metric).alias("metric"), value.try_cast("double").alias("value"), whole.alias("source_text"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), F.lit(review).alias("review_required"))
        found.append(F.when(F.col("section_type").isin(sections), row))
    rows = chunks.select("company", "chunk_id", "fiscal_year", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull() & x["value"].isNotNull())).alias("f"))
    flat = rows.select("company", "chunk_id", "fiscal_year", "f.*").withColumn("fact_source", F.lit("text"))
    return flat.withColumn("fact_id", fact_id(F.col("company"), F.col("fiscal_year"), F.col("metric"), F.col("fact_source"), F.col("confidence"), F.col("review_required"))).withColumn("value", F.round("value", 6))


def tagged_debt_facts(keyed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Debt metrics in billions from tagged facts (doc_id, key, year, value), by each metric's concept list, with a provenance chunk.

    The chunk is the year's first debt chunk that holds "debt payable", else its first debt chunk.
    """
    order = [(m, c, i) for m, found in DEBT_CONCEPTS.items() for i, c in enumerate(found)]
    table = F.broadcast(keyed.sparkSession.createDataFrame(order, "metric string, concept string, priority int"))  # a fixed rule table
    best = by_priority(keyed.select("doc_id", F.col("year").alias("fiscal_year"), F.col("key").alias("concept"), "value", F.lit(0).alias("pos")), table, ["doc_id", "fiscal_year"])
    debt = chunks.filter("section_type = 'debt'").withColumn("marked", F.lower("text").contains("debt payable"))
    source = first_in(debt, ["fiscal_year"], [F.desc("marked"), "chunk_id"]).select("fiscal_year", "chunk_id", excerpt(F.col("text"), ["debt payable"]).alias("source_text"))
    return best.join(source, "fiscal_year", "left").select("doc_id", "fiscal_year", "metric", "concept", F.round(F.col("value") / 1e9, 6).alias("value"), F.col("chunk_id"), "source_text")


def excerpt(text: Column, terms: list[str], size: int = 420, lead: int = 120) -> Column:
    """size characters of the squeezed text from lead characters before the first term that occurs."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    at = F.coalesce(*(F.nullif(F.locate(t.lower(), F.lower(plain)), F.lit(0)) for t in terms), F.lit(1))
    return plain.substr(F.greatest(at - lead, F.lit(1)), F.lit(size))


def all_facts(tagged: DataFrame, narrative: DataFrame) -> DataFrame:
    """Both sources as one bag of (company, metric, fiscal_year, value, fact_source)."""
    columns = ["company", "metric", "fiscal_year", "value"]
    return tagged.select(*columns, F.lit("xbrl").alias("fact_source")).unionByName(narrative.select(*columns, "fact_source"))
