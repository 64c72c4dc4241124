"""Filings rendered from orders and their lines: texts, inline XBRL, statement tables, company facts, submissions, XML instances.

Each renderer makes the documents by Spark from the given tables; the SQL beside a query states its rows from the
tables alone, without the rendered form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.operators import facts, ingestion, resolution, statements
from tallyspark.plans import fixtures
from tallyspark.sources import readers
from tallyspark.sources.readers import load
from tallyspark.sources.staging import kept

#: Lines that some orders show as headings; every rule of the ladder is among them.
HEADS = ["Item 1. Business", "ITEM 1", *fixtures.HEADINGS, "Committed Credit Facilities.", "Financing Activities", "Item 9B", "Credit Ratings", "  Liquidity   and Capital Resources (continued) ", "Day Revolving Credit Facility"]
CONCEPTS = ["Debt", "ShortTermBorrowings", "LongTermDebt", "StockholdersEquity", "InterestExpense", "Assets"]


def in_order(line: Column, *order: str) -> Column:
    """The lines of a group as an array, by the order columns."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"])


def bound(value: Column, shown: Callable[[Column], Column]) -> Column:
    """What shown makes of a value. The lambda also keeps a long rendering out of whole-stage code, whose single method would be too long for the JVM to compile."""
    return F.transform(F.array(value), shown)[0]


def field(items: str, name: str) -> Column:
    """One field of each struct of an array."""
    return F.transform(items, lambda x: x[name])


def cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("long")


def lines_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    heads = F.array(*map(F.lit, HEADS))
    prose = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of customer "), F.col("o_custkey").cast("string"), F.lit(" is at priority "), F.col("o_orderpriority"), F.lit(" and in state "), F.col("o_orderstatus"), F.lit(" for "), cents("o_totalprice").cast("string"), F.lit("  cents in all.  "))
    line = F.when((F.col("o_orderkey") * 7) % 6 == 0, F.element_at(heads, ((F.col("o_orderkey") * 13) % len(HEADS) + 1).cast("int"))).when(F.col("o_orderkey") % 19 == 1, F.lit("   ")).otherwise(prose)
    return o.select(F.floor(F.col("o_orderkey") / 80).cast("long").alias("doc_id"), "o_orderkey", line.alias("line"))


def filing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: eighty orders a document, a line each."""
    return lines_of_orders(spark, sf_dir).groupBy("doc_id").agg(F.array_join(in_order(F.col("line"), "o_orderkey"), "\n").alias("text"))


def filing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingestion.segmented(filing_texts(spark, sf_dir), "doc_id", whole=True)
    return out.select("doc_id", F.col("section_no").cast("long"), "name", "type", F.col("start_pos").cast("long"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def inline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, html: an order's lines as contexts and tagged numbers; lines that share a number share a context id, and the later one holds."""
    li = load(spark, sf_dir, "lineitem")
    n, part, day = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_shipdate").cast("date").cast("string")
    member = lambda axis, name: F.concat(F.lit(f'<xbrldi:explicitMember dimension="a:{axis}"> x:'), name, F.lit("Member </xbrldi:explicitMember>"))
    legal = member("LegalAxis", F.concat("l_linestatus", F.lit("Co")))
    two = F.concat(member("SegmentAxis", F.concat(F.lit("Seg-"), (part % 5).cast("string"))), member("LegalAxis", F.lit("Unit")))
    segment = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("<xbrli:segment>"), legal, F.lit("</xbrli:segment>"))).when(F.col("l_returnflag") == "A", F.concat(F.lit("<xbrli:segment>"), two, F.lit("</xbrli:segment>"))).otherwise(F.lit(""))
    period = F.when(n % 2 == 1, F.concat(F.lit("<xbrli:instant>"), day, F.lit("</xbrli:instant>"))).otherwise(F.concat(F.lit("<xbrli:startDate>1990-01-01</xbrli:startDate><xbrli:endDate> "), day, F.lit(" </xbrli:endDate>")))
    id_ = bound(n.cast("string"), lambda k: F.concat(F.lit("c"), k))
    context = F.concat(F.lit('<xbrli:context id="'), id_, F.lit('"><xbrli:entity/>'), segment, F.lit("<xbrli:period>"), period, F.lit("</xbrli:period></xbrli:context>"))
    quantity = F.col("l_quantity").cast("long").cast("string")
    price = F.concat(F.lit("<span>$ </span>"), F.format_number(F.floor(cents("l_extendedprice") / 100), 0), F.lit("."), F.lpad((cents("l_extendedprice") % 100).cast("string"), 2, "0"))
    kind = part % 7
    shown = F.when(kind == 0, F.lit("—")).when(kind == 1, F.lit("&#8212;")).when(kind == 2, F.concat(F.lit("("), quantity, F.lit(")"))).when(kind == 4, price).when(kind == 5, F.concat(quantity, F.lit("%"))).when(kind == 6, F.concat(F.lit("&nbsp;"), quantity)).otherwise(quantity)
    extra = F.when(kind == 1, F.lit(' format="ixt:fixed-zero"')).when(kind == 3, F.lit(' sign="-"')).otherwise(F.lit(""))
    ref = F.when(part % 11 == 0, F.lit("nowhere")).otherwise(id_)
    tag = F.concat(F.lit('<td><ix:nonFraction name="us-gaap:Concept'), (n % 3).cast("string"), F.lit('" contextRef="'), ref, F.lit('" unitRef="usd" scale="'), (n % 3 * 3).cast("string"), F.lit('"'), extra, F.lit(">"), shown, F.lit("</ix:nonFraction></td>"))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.struct(context.alias("c"), tag.alias("t")).alias("both"))
    held = rows.groupBy("doc_id").agg(in_order(F.col("both"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("l"))
    parts = [F.array_join(field("l", f), "\n") for f in ("c", "t")]
    return held.select("doc_id", F.concat(F.lit("<html><ix:header>"), parts[0], F.lit("</ix:header>\n"), parts[1], F.lit("</html>")).alias("html"))


def inline_xbrl_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.dimension_keys(statements.inline_facts(inline_pages(spark, sf_dir))).select("doc_id", "key", "year", "value", "n_values", "n_conflicts")


#: Rows of the rendered statements: table, label, divisor of the customer's yearly total, how it is shown.
STATEMENT_ROWS = [
    (0, "Cash flows from operating activities", None, ""), (0, "Net cash provided by operating activities", 1, "dollar"), (0, "Cash flows from investing activities", None, ""),
    (0, "Purchases of property and equipment", 10, "paid"), (0, "Equipment purchases incurred but not yet paid", 7, "plain"), (0, "Cash flows from financing activities", None, ""), (0, "Dividends paid (cash)", 40, "dash"),
    (1, "Current assets", None, ""), (1, "Cash and cash equivalents", 3, "plain"), (1, "Property and equipment, net", 4, "plain"), (1, "Current liabilities", None, ""), (1, "Loans and notes payable to banks", 5, "plain"),
    (1, "Debt due within one year", 6, "plain"), (1, "Total short term debt", 2, "fifth"), (1, "Long-term debt", 9, "plain"), (1, "Total liabilities and equity", 8, "plain"),
    (2, "Revenue", 11, "plain"), (2, "Interest expense", 12, "most"), (2, "Interest paid in cash", 13, "plain"), (2, "Lease interest", 14, "plain"), (2, "Net income", 15, "plain"),
]
STATEMENT_METRICS = ["operating_cash_flow", "capital_expenditures", "dividend_payments", "interest_expense", "current_debt", "long_term_debt", "cash_and_equivalents"]


def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accession, html: a customer's three statements; its orders with even keys are 2025, those with odd keys 2024."""
    o = load(spark, sf_dir, "orders")
    year = lambda parity: F.floor(F.sum(F.when(F.col("o_orderkey") % 2 == parity, cents("o_totalprice"))) / 100).cast("long")
    totals = o.groupBy(F.col("o_custkey").alias("c")).agg(year(0).alias("a"), year(1).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    tables = [""] * 3
    cells = {0: [], 1: [], 2: []}
    for table, label, divisor, shown in STATEMENT_ROWS:
        if divisor is None:
            cells[table].append(F.lit(f"<tr><td>{label}</td></tr>"))
            continue
        new, old = (F.format_number(F.floor(F.col(c) / divisor), 0) for c in "ab")
        if shown == "paid":
            tag = F.concat(F.lit('<ix:nonFraction name="us-gaap:PaymentsToAcquirePropertyPlantAndEquipment" contextRef="c1">'), new, F.lit("</ix:nonFraction>"))
            new, old = F.concat(F.lit("("), F.when(F.col("c") % 2 == 0, tag).otherwise(new), F.lit(")")), F.concat(F.lit("("), old, F.lit(")"))
        if shown == "dash":
            new, old = F.concat(F.lit("("), new, F.lit(")")), F.when(F.col("c") % 3 == 0, F.lit("&#8212;")).otherwise(F.concat(F.lit("("), old, F.lit(")")))
        dollar = "<td>$</td>" if shown == "dollar" else ""
        row = F.concat(F.lit(f"<tr><td><b>{label}</b></td>{dollar}<td>"), new, F.lit(f"</td>{dollar}<td>"), old, F.lit("</td></tr>"))
        some = {"fifth": F.col("c") % 5 == 0, "most": F.col("c") % 4 != 0}.get(shown)
        cells[table].append(row if some is None else F.when(some, row).otherwise(F.lit("")))
    head = F.lit("<table><tr><th>In dollars</th><th>Dec 31, 2025</th><th>Dec 31, 2024</th></tr>\n")
    tables = [F.concat(head, F.concat_ws("\n", *cells[t]), F.lit("</table>")) for t in range(3)]
    return totals.select(F.col("c").cast("string").alias("accession"), F.concat_ws("\n<p>Text between tables</p>\n", *tables).alias("html"))


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages are parsed once: their cells are kept, as items read them several times, and so are the items."""
    cells = kept(statements.table_cells(statement_pages(spark, sf_dir)), "cells")
    return kept(statements.statement_items(cells), "statements")


def statement_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolution.statement_register(statement_lines(spark, sf_dir), STATEMENT_METRICS)
    return out.select("accession", "fiscal_year", "metric", "status", "value", "concept", "confidence", "n_rows", "n_rejected")


def rejected_statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.rejected_rows(statement_lines(spark, sf_dir)).select("accession", "fiscal_year", "metric", F.col("place").cast("long").alias("place"), "row_label", "value", "reason")


def landed_company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cik, version, json: two landed versions for each customer; the first lacks the orders since 2000, and every fourth customer's second is cut off."""
    o = load(spark, sf_dir, "orders").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).filter("version = 2 OR year(o_orderdate) < 2000")
    p, key = F.col("o_orderpriority"), F.col("o_orderkey")
    concept = F.when(p == "1-URGENT", "InterestExpense").when(p == "2-HIGH", "DebtCurrent").when(p == "3-MEDIUM", "Assets").when(p == "4-NOT SPECIFIED", "Cash").otherwise("EntityShares")
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-K/A").otherwise("10-Q")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    row = F.struct(key.alias("k"), F.struct(F.year("o_orderdate").alias("fy"), F.when(key % 3 == 0, "FY").otherwise("Q4").alias("fp"), form.alias("form"), day.alias("filed"), day.alias("end"), key.cast("string").alias("accn"), F.when(key % 17 == 0, F.lit(0.0)).otherwise(cents("o_totalprice") * 10).alias("val")).alias("r"))
    rows = o.groupBy(F.col("o_custkey").alias("cik"), "version", F.when(p == "5-LOW", "dei").otherwise("us-gaap").alias("ns"), concept.alias("concept")).agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"]).alias("rows"))
    spaces = rows.groupBy("cik", "version", "ns").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct(F.create_map(F.lit("USD"), "rows").alias("units"))))).alias("m"))
    whole = spaces.groupBy("cik", "version").agg(F.map_from_entries(F.collect_list(F.struct("ns", "m"))).alias("facts"))
    json = F.to_json(F.struct(F.lit("Issuer").alias("entityName"), F.col("cik").cast("string").alias("cik"), "facts"))
    return whole.select("cik", "version", F.when((F.col("version") == 2) & (F.col("cik") % 4 == 0), json.substr(F.lit(1), F.floor(F.length(json) * 0.6).cast("int"))).otherwise(json).alias("json"))


def companyfacts_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = readers.latest_good(landed_company_facts(spark, sf_dir))
    rows = facts.inventory(readers.company_facts(good.select("json")), 1999)
    return rows.select("cik", "namespace", "concept", "unit", F.round("value", 6).alias("value"), "is_zero")


def broken_company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.broken(landed_company_facts(spark, sf_dir)).select("cik", "version")


def submissions_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-K/A").otherwise("10-Q")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    fields = {"form": form, "accessionNumber": F.concat(F.lit("a-"), key.cast("string")), "filingDate": day, "reportDate": F.when(key % 5 == 0, F.lit("")).otherwise(day), "fy": F.year("o_orderdate"), "primaryDocument": F.concat(F.lit("d"), key.cast("string"), F.lit(".htm"))}
    held = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", *(v.alias(k) for k, v in fields.items())))).alias("r"))
    recent = F.struct(*(field("r", k).alias(k) for k in fields))
    json = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.lit("Issuer").alias("name"), F.struct(recent.alias("recent")).alias("filings")))
    rows = readers.recent_filings(readers.submissions(held.select(json.alias("json"))))
    return rows.select("cik", F.col("pos").cast("long"), "form", "accession", F.col("filing_date").cast("string").alias("filing_date"), F.col("report_date").cast("string").alias("report_date"), "fy", "document")


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, doc: an order's lines as an XML instance; concepts by part, in a vocabulary's namespace or a foreign one."""
    li = load(spark, sf_dir, "lineitem")
    part, day = F.col("l_partkey"), F.col("l_shipdate").cast("date").cast("string")
    names = F.element_at(F.array(*map(F.lit, CONCEPTS)), (part % len(CONCEPTS) + 1).cast("int"))
    id_ = bound(F.year("l_shipdate").cast("string"), lambda y: F.concat(F.lit("c"), y))
    context = F.concat(F.lit('<context id="'), id_, F.lit('"><entity/><instant>'), day, F.lit("</instant></context>"))
    prefix = F.when(part % 13 == 0, "own").otherwise("us-gaap")
    number = F.when(part % 9 == 0, F.lit("n/a")).when(part % 4 == 0, cents("l_extendedprice").cast("string")).otherwise(F.concat(F.lit("-"), F.col("l_quantity").cast("long").cast("string")))
    tag = F.concat(F.lit("<"), prefix, F.lit(":"), names, F.lit(' contextRef="'), id_, F.lit('" decimals="0">'), number, F.lit("</"), prefix, F.lit(":"), names, F.lit(">"))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", context.alias("c"), tag.alias("t"))
    held = rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("c")), "\n").alias("c"), F.array_join(in_order(F.col("t"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "\n").alias("t"))
    return held.select("doc_id", F.concat(F.lit('<xbrl xmlns:us-gaap="http://xbrl.us/us-gaap/2009-01-31" xmlns:own="http://example.com/own">\n'), "c", F.lit("\n"), "t", F.lit("\n</xbrl>")).alias("doc"))


def xml_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.instance_metrics(readers.xml_metrics(instances(spark, sf_dir))).select("doc_id", "year", "metric", "concept", "value")


def xml_instance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.instance_summary(instances(spark, sf_dir)).select("doc_id", "fiscal_year", F.array_join("names", ",").alias("names"))


def heading_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the documents and of the rendered filings, with its heading rule."""
    plain = load(spark, sf_dir, "documents").select("doc_id", "text", F.lit("documents").alias("origin"))
    both = plain.unionByName(filing_texts(spark, sf_dir).withColumn("origin", F.lit("filings")))
    lines = both.select("origin", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", T.normalized_line(F.col("raw"))).filter("line <> ''")
    h = ingestion.heading(F.col("line"))
    found = lines.select("origin", "doc_id", F.col("pos").cast("long").alias("pos"), T.canonical(F.col("line")).alias("canonical"), h["name"].alias("name"), h["type"].alias("type"))
    return found.select("origin", "doc_id", "pos", F.md5("canonical").alias("digest"), "name", "type")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        filing_sections, heading_classify, inline_xbrl_facts, statement_rule_match, rejected_statement_rows, companyfacts_inventory, broken_company_facts,
        submissions_unnest, xml_instance, xml_instance_summary,
    )
}
