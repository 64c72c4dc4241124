"""Readers and extractors on small filings, with rows that follow from reading them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyspark.operators import extraction, facts, resolution, statements
from tallyspark.plans import filings
from tallyspark.sources import readers

STATEMENT_HTML = """
<table><tr><th></th><th>2025</th><th>2024</th></tr>
<tr><td>Cash flows from operating activities</td></tr>
<tr><td>Net cash provided by operating activities</td><td>$</td><td>1,000</td><td>900</td></tr>
<tr><td>Cash flows from investing activities</td></tr>
<tr><td>Purchases of property and equipment</td><td>(<ix:nonFraction name="us-gaap:PaymentsToAcquirePropertyPlantAndEquipment">250</ix:nonFraction>)</td><td>(200)</td></tr>
<tr><td>Cash flows from financing activities</td></tr>
<tr><td>Dividends paid (cash)</td><td>(40)</td><td>—</td></tr></table>
<table><tr><td>Balance</td><td>Dec 31, 2025</td><td>Dec 31, 2024</td></tr>
<tr><td>Current assets</td></tr><tr><td>Cash and cash equivalents</td><td>77</td><td>66</td></tr>
<tr><td>Current liabilities</td></tr>
<tr><td>Loans and notes payable to banks</td><td>640</td><td>710</td></tr>
<tr><td>Debt due within one year</td><td>215</td><td>130</td></tr>
<tr><td>Long-term debt</td><td>9,000</td><td>8,000</td></tr>
<tr><td>Total liabilities and equity</td><td>20,000</td><td>19,000</td></tr></table>
"""
#: accession, fiscal_year, metric, value, concept, confidence, n_rows that follow from STATEMENT_HTML by reading it.
STATEMENT_ROWS = [
    ("a1", 2025, "operating_cash_flow", 1000.0, "statement:", "medium", 1), ("a1", 2024, "operating_cash_flow", 900.0, "statement:", "medium", 1),
    ("a1", 2025, "capital_expenditures", 250.0, "statement:PaymentsToAcquirePropertyPlantAndEquipment", "high", 1), ("a1", 2024, "capital_expenditures", -200.0, "statement:", "medium", 1),
    ("a1", 2025, "dividend_payments", -40.0, "statement:", "medium", 1),
    ("a1", 2025, "cash_and_equivalents", 77.0, "statement:", "medium", 1), ("a1", 2024, "cash_and_equivalents", 66.0, "statement:", "medium", 1),
    ("a1", 2025, "current_debt", 855.0, "statement:", "medium", 2), ("a1", 2024, "current_debt", 840.0, "statement:", "medium", 2),
    ("a1", 2025, "long_term_debt", 9000.0, "statement:", "medium", 1), ("a1", 2024, "long_term_debt", 8000.0, "statement:", "medium", 1),
]

COMPANY_FACTS = json.dumps({"cik": "37996", "entityName": "Issuer", "facts": {"us-gaap": {
    "InterestExpense": {"units": {"USD": [
        {"fy": 2024, "fp": "Q1", "form": "10-Q", "filed": "2024-05-01", "end": "2024-03-31", "val": 10_000_000},
        {"fy": 2024, "fp": "FY", "form": "10-K", "filed": "2025-02-01", "end": "2024-12-31", "val": 350_000_000},
        {"fy": 2024, "fp": "FY", "form": "10-K", "filed": "2025-01-15", "end": "2024-12-31", "val": 340_000_000}]}},
    "InterestPaidNet": {"units": {"USD": [{"fy": 2024, "fp": "FY", "form": "10-K", "filed": "2025-02-01", "end": "2024-12-31", "val": 0}]}},
    "OldOnly": {"units": {"USD": [{"fy": 2020, "fp": "FY", "form": "10-K", "filed": "2021-02-01", "end": "2020-12-31", "val": 5}]}}},
    "dei": {"Shares": {"units": {"shares": [{"fy": 2024, "fp": "FY", "form": "10-K/A", "filed": "2025-02-01", "end": "2024-12-31", "val": 900_000}]}}}}})
INVENTORY_ROWS = [("0000037996", "us-gaap", "InterestExpense", "USD", 350.0, False), ("0000037996", "us-gaap", "InterestPaidNet", "USD", 0.0, True), ("0000037996", "dei", "Shares", "shares", 900000.0, False)]

INLINE_HTML = """
<xbrli:context id="c1"><xbrli:entity/><xbrli:period><xbrli:instant>2025-12-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:context id="c2"><xbrli:segment><xbrldi:explicitMember dimension="a:Axis">x:CompanyMember</xbrldi:explicitMember></xbrli:segment><xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<ix:nonFraction name="us-gaap:Debt" contextRef="c1" unitRef="usd" scale="6">21,919</ix:nonFraction>
<ix:nonFraction name="us-gaap:Debt" contextRef="c2" unitRef="usd" scale="6" sign="-">19,944</ix:nonFraction>
<ix:nonFraction name="us-gaap:Cash" contextRef="c1" unitRef="usd" format="ixt:fixed-zero">—</ix:nonFraction>
<ix:nonFraction name="us-gaap:Other" contextRef="c1" unitRef="usd">—</ix:nonFraction>
"""
INLINE_ROWS = [(1, "Debt", 2025, 21919000000.0), (1, "DebtCompany", 2024, -19944000000.0), (1, "Cash", 2025, 0.0)]

XML_INSTANCE = """<xbrl><context id="Current_2023"><entity/><period><instant>2023-12-31</instant></period></context>
<us-gaap:Debt contextRef="Current_2023" unitRef="USD">50000000000</us-gaap:Debt><us-gaap:Small contextRef="Current_2023">-12.5</us-gaap:Small></xbrl>"""
XML_ROWS = [(1, "Debt", 2023, 50000.0), (1, "Small", 2023, -12.5)]

SUBMISSIONS = json.dumps({"cik": "320193", "name": "Issuer", "tickers": ["ISS"], "exchanges": ["NYSE"], "sic": "1", "filings": {"recent": {"form": ["10-K", "10-Q"], "accessionNumber": ["a-1", "a-2"], "filingDate": ["2025-02-01", "2024-11-01"], "reportDate": ["2024-12-31", ""], "fy": [2024, 2024], "primaryDocument": ["k.htm", "q.htm"]}}})
SUBMISSION_ROWS = [("0000320193", 0, "10-K", "a-1", "2025-02-01", 2024, "k.htm"), ("0000320193", 1, "10-Q", "a-2", "2024-11-01", 2024, "q.htm")]

NARRATIVE_CHUNKS = [
    ("F", "c1", 2025, "liquidity", "At December 31, 2025, we had Company cash of $ 28.7 billion and liquidity of $46.4 billion."),
    ("F", "c2", 2023, "liquidity", "At December 31, 2025, we had Company cash of $ 28.7 billion and liquidity of $46.4 billion."),
    ("F", "c3", 2025, "mda", "Balance Sheets ($B) Company Cash $ 28.8 $ 28.7 Liquidity 46.4 46.5 rest"),
]
#: chunk_id, metric, value, confidence, review_required, fact_id that follow from NARRATIVE_CHUNKS by reading them.
NARRATIVE_ROWS = [
    ("c1", "company_cash", 28.7, "high", False, "f_2025_company_cash_text_high"), ("c1", "company_liquidity", 46.4, "high", False, "f_2025_company_liquidity_text_high"),
    ("c3", "company_cash", 28.7, "low", True, "f_2025_company_cash_text_low_review"), ("c3", "company_liquidity", 46.5, "low", True, "f_2025_company_liquidity_text_low_review"),
]


def rows(found, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=str)


def test_statement_tables(spark):
    items = statements.statement_items(statements.table_cells(spark.createDataFrame([("a1", STATEMENT_HTML), ("a2", None), ("a3", "<p>none</p>")], "accession string, html string")))
    found = resolution.resolve_statements(items)
    assert rows(found, "accession", "fiscal_year", "metric", "value", "concept", "confidence", "n_rows") == sorted(STATEMENT_ROWS, key=str)
    register = resolution.statement_register(items, ["interest_expense", "current_debt"])
    assert rows(register, "fiscal_year", "metric", "status", "n_rows") == [(2024, "current_debt", "verified_statement", 2), (2024, "interest_expense", "statement_row_not_found", 0), (2025, "current_debt", "verified_statement", 2), (2025, "interest_expense", "statement_row_not_found", 0)]


def test_rejected_rows_are_bounded_in_order(spark):
    lines = [("a", 2025, i, "balance_sheet", f"Lease {i}" if i % 2 else f"Other {i}", f"lease {i}" if i % 2 else f"other {i}", float(i), None, "medium") for i in range(60)]
    lines += [("b", 2025, 1, "balance_sheet", "Lease", "lease", None, None, "medium")]
    items = spark.createDataFrame(lines, "accession string, fiscal_year int, pos long, statement_type string, row_label string, normalized_label string, value double, xbrl_concept string, confidence string")
    found = resolution.rejected_rows(items).orderBy("place").collect()
    assert [(r.place, r.row_label, r.value) for r in found] == [(k + 1, f"Lease {2 * k + 1}", 2.0 * k + 1) for k in range(12)]
    assert {r.reason for r in found} == {"Lease obligations are not cash capex outflow."} and {r.metric for r in found} == {"capital_expenditures"}
    assert resolution.rejected_rows(items, looked_at=4).count() == 2 and resolution.rejected_rows(items.limit(0)).count() == 0


def test_inline_facts(spark):
    docs = spark.createDataFrame([(1, INLINE_HTML), (2, None), (3, "<ix:nonFraction name=\"a:B\">1</ix:nonFraction>")], "doc_id long, html string")
    assert rows(statements.dimension_keys(statements.inline_facts(docs)), "doc_id", "key", "year", "value") == sorted(INLINE_ROWS, key=str)
    plan = statements.inline_facts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_each_pattern_of_inline_facts_stands_once_in_the_plan(spark):
    plan = statements.inline_facts(spark.createDataFrame([(1, INLINE_HTML)], "doc_id long, html string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("<ix:nonFraction") == 1 and plan.count("<xbrli:context") == 1


def test_last_attribute_and_context_count_and_odd_spellings(spark):
    html = """<XBRLI:Context id="c"><xbrli:INSTANT>  </xbrli:instant><xbrli:enddate> 2024-12-31</xbrli:endDate></xbrli:context><xbrli:context data-id="z" id="c"><xbrli:instant>2019</xbrli:instant></xbrli:context>
    <xbrli:context id="e"><xbrli:instant>  </xbrli:instant><xbrli:ENDDATE> 2024-12-31</xbrli:endDate></xbrli:context>
    <IX:nonfraction name="g:Y" title="scale=" name="g:X" contextRef="c" scale="1" scale="2" x="">4&amp;</ix:nonFraction><ix:nonFraction name="g:Z" contextRef="e" sign="-" format="a:b">(7)</ix:nonFraction><ix:nonFraction name="" contextRef="c">1</ix:nonFraction>"""
    found = statements.inline_facts(spark.createDataFrame([(1, html)], "doc_id long, html string"))
    assert rows(found, "pos", "concept", "year", "value") == [(0, "X", 2019, None), (1, "Z", 2024, -7.0)]


def test_long_renderings_stay_out_of_whole_stage_code(spark):
    """In one whole-stage method they are too long for the JVM to compile."""
    for made, mark in ((filings.inline_pages, "<ix:nonFraction"), (filings.instances, "decimals=")):
        lines = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString().splitlines()
        shown = [line for line in lines if mark in line and "Project [" in line]
        assert shown and any("lambdafunction" in line for line in shown)


def test_inline_values_contexts_and_conflicts(spark):
    context = '<xbrli:context id="{}">{}<xbrli:instant>{}-01-01</xbrli:instant></xbrli:context>'
    member = '<xbrldi:explicitMember dimension="d:{}">m:{}Member</xbrldi:explicitMember>'
    tag = '<ix:nonFraction name="g:X" contextRef="{}" {}>{}</ix:nonFraction>'
    html = context.format("c", "", 2020) + context.format("c", "", 2021) + context.format("z", member.format("B", "One") + member.format("A", "T-wo"), 2021)
    shown = [("c", "", "5"), ("c", "", "5.0000000001"), ("c", "", "7"), ("c", 'scale="3"', "(1,2<b>3</b>4)"), ("z", "", "$ 2%"), ("gone", "", "9"), ("c", "", "n/a"), ("c", 'format="x:fixed-zero"', ""), ("z", 'sign="-"', "&nbsp;3")]
    docs = spark.createDataFrame([(1, html + "".join(tag.format(*s) for s in shown))], "doc_id long, html string")
    keyed = statements.dimension_keys(statements.inline_facts(docs))
    assert rows(keyed, "key", "year", "value", "n_values", "n_conflicts") == [("X", 2021, 5.0, 5, 3), ("XOne", 2021, 2.0, 2, 1), ("XOneTwo", 2021, 2.0, 2, 1), ("XTwo", 2021, 2.0, 2, 1)]
    assert [r.value for r in statements.inline_facts(docs).orderBy("pos").collect()] == [5.0, 5.0000000001, 7.0, -1234000.0, 2.0, 9.0, None, 0.0, -3.0]


def test_company_facts_keep_the_last_good_version(spark):
    whole = json.loads(COMPANY_FACTS)
    later = json.dumps({**whole, "facts": {"dei": whole["facts"]["dei"]}})
    raw = spark.createDataFrame([("37996", 1, COMPANY_FACTS), ("37996", 2, later[:-9]), ("37996", 3, None), ("5", 1, later), ("5", 2, later), ("6", 1, "{")], "cik string, version int, json string")
    assert rows(readers.latest_good(raw), "cik", "version") == [("37996", 1), ("5", 2)]
    assert rows(readers.broken(raw), "cik", "version") == [("37996", 2), ("37996", 3), ("6", 1)]
    found = facts.inventory(readers.company_facts(readers.latest_good(raw).filter("cik = '37996'")), 2024)
    assert rows(found, "cik", "namespace", "concept", "unit", "value", "is_zero") == sorted(INVENTORY_ROWS, key=str)


def test_xml_instances(spark):
    other = """<xbrl xmlns="http://xbrl.us/x" xmlns:o='http://own'><o:context id="c1"><instant>2020-01-01</instant></o:context><o:context id="c1"><endDate> 2022-01-01</endDate></o:context>
    <LongTermDebt contextRef=" c1 ">7</LongTermDebt><o:Debt contextRef="c1">n/a</o:Debt><Assets contextRef="c2">8</Assets></xbrl>"""
    docs = spark.createDataFrame([(1, XML_INSTANCE), (2, other), (3, None), (4, "")], "doc_id long, doc string")
    assert rows(readers.xml_metrics(docs), "doc_id", "concept", "year", "value") == sorted([*XML_ROWS, (2, "LongTermDebt", 2022, 7.0)], key=str)
    assert rows(readers.instance_metrics(readers.xml_metrics(docs)), "doc_id", "year", "metric", "concept", "value") == [(1, 2023, "total_debt", "Debt", 50000.0), (2, 2022, "total_debt", "LongTermDebt", 7.0)]
    found = {r.doc_id: (r.fiscal_year, r.names) for r in readers.instance_summary(docs.filter("doc IS NOT NULL")).collect()}
    assert found[2] == (2022, ["Assets", "LongTermDebt", "endDate", "instant", "xbrl"]) and found[4] == (0, [])
    assert found[1][0] == 2023 and set(found[1][1]) == {"xbrl", "entity", "period", "instant"}


def test_submissions(spark):
    found = readers.recent_filings(readers.submissions(spark.createDataFrame([(SUBMISSIONS,)], "json string")))
    assert rows(found.withColumn("filing_date", F.col("filing_date").cast("string")), "cik", "pos", "form", "accession", "filing_date", "fy", "document") == SUBMISSION_ROWS


def test_narrative(spark):
    chunks = spark.createDataFrame(NARRATIVE_CHUNKS, "company string, chunk_id string, fiscal_year int, section_type string, text string")
    assert rows(extraction.narrative_facts(chunks), "chunk_id", "metric", "value", "confidence", "review_required", "fact_id") == sorted(NARRATIVE_ROWS, key=str)


def test_cells_are_given_out_page_by_page():
    page = "<table>" + "<tr><td>a</td><td>1</td></tr>" * 40 + "</table>"
    given: list[int] = []

    def pages():
        for i in range(50):
            given.append(i)
            yield str(i), page if i % 5 else None

    out, ahead = [], 0
    for batch in statements.cell_batches(pages(), 2 * len(page)):
        ahead = max(ahead, batch.num_rows)
        out += batch.to_pylist()
    assert ahead == 160 and len(out) == 40 * 80 and len(given) == 50
    assert out[0] == {"accession": "1", "table_no": 0, "row_no": 0, "column_no": 0, "text": "a", "tagged": None, "concept": None}
