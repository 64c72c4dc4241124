"""DuckDB SQL for the queries over rendered filings, from the tables alone."""

from __future__ import annotations

from tallyspark.plans.filings import CONCEPTS, HEADS, STATEMENT_ROWS
from tallyspark.plans.oracles import CANONICAL, LINES, heading_case, values


def text_list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


TEXTS = rf"""raw AS (
  SELECT CAST(floor(o_orderkey / 80) AS BIGINT) AS doc_id, o_orderkey, CASE WHEN (o_orderkey * 7) % 6 = 0 THEN ({text_list(HEADS)})[(o_orderkey * 13) % {len(HEADS)} + 1] WHEN o_orderkey % 19 = 1 THEN '   '
    ELSE 'Order ' || o_orderkey || ' of customer ' || o_custkey || ' is at priority ' || o_orderpriority || ' and in state ' || o_orderstatus || ' for ' || CAST(round(o_totalprice * 100) AS BIGINT) || '  cents in all.  ' END AS raw FROM orders),
flines AS (SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o_orderkey) - 1 AS pos, trim(regexp_replace(raw, '[\t\n\f\r\x0B ]+', ' ', 'g')) AS line FROM raw) WHERE line <> ''),
fcanon AS (SELECT *, {CANONICAL.format("line")} AS canonical FROM flines)"""
LINE = """l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS ct, l_returnflag AS rf, l_linestatus AS ls, year(l_shipdate) AS y,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem)"""
FORM = "CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-K/A' ELSE '10-Q' END"
#: What each row means: metric, or for rejected rows the metric and the reason.
MEANS = {
    "Net cash provided by operating activities": "operating_cash_flow", "Purchases of property and equipment": "capital_expenditures", "Dividends paid (cash)": "dividend_payments", "Interest expense": "interest_expense",
    "Loans and notes payable to banks": "current_debt", "Debt due within one year": "current_debt", "Total short term debt": "current_debt", "Long-term debt": "long_term_debt", "Cash and cash equivalents": "cash_and_equivalents",
}
REJECTED = [
    ("Equipment purchases incurred but not yet paid", "capital_expenditures", "Capex incurred but not yet paid is not cash capex outflow."), ("Property and equipment, net", "capital_expenditures", "PPE balance is not cash capital expenditure."),
    ("Lease interest", "capital_expenditures", "Lease obligations are not cash capex outflow."), ("Interest paid in cash", "interest_expense", "Cash interest paid is not accrual interest expense."), ("Lease interest", "interest_expense", "Lease-only interest is not total interest expense."),
]
SHOWN = [(k, label, divisor, shown, MEANS.get(label)) for k, (_, label, divisor, shown) in enumerate(STATEMENT_ROWS) if divisor is not None]
ITEMS = f"""totals AS (SELECT o_custkey AS c, floor(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE o_orderkey % 2 = 0) / 100) AS a, floor(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE o_orderkey % 2 = 1) / 100) AS b FROM orders GROUP BY 1 HAVING a IS NOT NULL AND b IS NOT NULL),
shown AS (SELECT * FROM {values(SHOWN, "k, label, divisor, shown, metric")}),
items AS (SELECT CAST(c AS VARCHAR) AS accession, fy AS fiscal_year, k, label, metric, shown = 'paid' AND c % 2 = 0 AND fy = 2025 AS tagged,
    CASE WHEN shown = 'paid' AND NOT (c % 2 = 0 AND fy = 2025) THEN -x WHEN shown = 'dash' AND fy = 2024 AND c % 3 = 0 THEN NULL WHEN shown = 'dash' THEN -x ELSE x END AS value
  FROM (SELECT c, fy, shown.*, CAST(floor(CASE fy WHEN 2025 THEN a ELSE b END / divisor) AS DOUBLE) AS x FROM totals, shown, (SELECT unnest([2025, 2024]) AS fy) WHERE (shown <> 'fifth' OR c % 5 = 0) AND (shown <> 'most' OR c % 4 <> 0)))"""

SQL: dict[str, str] = {
    "filing_sections": f"""WITH {TEXTS}, marks AS (SELECT *, {heading_case("name")}, {heading_case("type")}, canonical IN ('item 1', 'item 1 business') AS body FROM fcanon),
      b AS (SELECT *, sum(CAST(body AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS nb, sum(CAST(body AS INT)) OVER (PARTITION BY doc_id) AS ab FROM marks),
      n AS (SELECT *, sum(CAST(nb >= least(2, ab) AND type IS NOT NULL AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM b),
      s AS (SELECT doc_id, section_no, arg_min(name, pos) AS name, arg_min(type, pos) AS type, min(pos) AS start_pos, string_agg(line, chr(10) ORDER BY pos) AS text FROM n WHERE section_no > 0 GROUP BY ALL),
      k AS (SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, name, type, CAST(start_pos AS BIGINT) AS start_pos, text FROM s WHERE type <> 'boundary' AND len(text) >= CASE WHEN type IN ('debt', 'credit_facilities') THEN 180 ELSE 500 END),
      w AS (SELECT doc_id, 1, 'Full Filing', 'full_filing', 0, string_agg(raw, chr(10) ORDER BY o_orderkey) FROM raw WHERE doc_id NOT IN (SELECT doc_id FROM k) GROUP BY 1)
      SELECT doc_id, section_no, name, type, start_pos, CAST(len(text) AS BIGINT) AS n_chars, md5(text) AS digest FROM (SELECT * FROM k UNION ALL SELECT * FROM w)""",
    "heading_classify": f"""WITH {LINES}, {TEXTS}, both_ AS (SELECT 'documents' AS origin, doc_id, pos, line, {CANONICAL.format("line")} AS canonical FROM lines UNION ALL SELECT 'filings', doc_id, pos, line, canonical FROM fcanon)
      SELECT origin, doc_id, CAST(pos AS BIGINT) AS pos, md5(canonical) AS digest, {heading_case("name")}, {heading_case("type")} FROM both_""",
    "inline_xbrl_facts": f"""WITH {LINE}, ctx AS (SELECT doc_id, n, arg_max(y, i) AS y, arg_max(rf, i) AS rf, arg_max(ls, i) || 'Co' AS co, 'Seg' || arg_max(p % 5, i) AS seg FROM l GROUP BY 1, 2),
      f AS (SELECT l.doc_id, i, 'Concept' || n % 3 AS c, ctx.y, rf_, co, seg, CASE p % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 4 THEN CAST(ct AS DOUBLE) / 100 WHEN 2 THEN -q WHEN 3 THEN -q ELSE q END * pow(10.0, n % 3 * 3) AS v
        FROM l JOIN (SELECT doc_id, n, y, rf AS rf_, co, seg FROM ctx) AS ctx USING (doc_id, n) WHERE p % 11 <> 0),
      keyed AS (SELECT doc_id, i, y, v, ks[j] AS key, j FROM (SELECT *, unnest(range(1, len(ks) + 1)) AS j FROM (SELECT *, CASE rf_ WHEN 'R' THEN [c || co] WHEN 'A' THEN [c || seg, c || 'Unit', c || seg || 'Unit'] ELSE [c] END AS ks FROM f WHERE v IS NOT NULL))),
      g AS (SELECT doc_id, key, y, list(v ORDER BY i, j) AS vs FROM keyed GROUP BY ALL)
      SELECT doc_id, key, CAST(y AS INT) AS year, vs[1] AS value, CAST(len(vs) AS BIGINT) AS n_values, CAST(len(list_filter(vs, lambda x: abs(x - vs[1]) > 1e-9)) AS BIGINT) AS n_conflicts FROM g""",
    "statement_rule_match": f"""WITH {ITEMS}, m AS (SELECT accession, fiscal_year, metric, min(value) AS value, bool_or(tagged) AS tagged, count(*) AS n_rows, sum(abs(value)) AS total, max(value) FILTER (WHERE shown_total) AS total_row
        FROM (SELECT *, label LIKE 'Total%' AS shown_total FROM items WHERE metric IS NOT NULL AND value IS NOT NULL) GROUP BY ALL),
      asked AS (SELECT DISTINCT accession, fiscal_year, mm.metric FROM items, (SELECT DISTINCT metric FROM shown WHERE metric IS NOT NULL) AS mm)
      SELECT a.accession, CAST(a.fiscal_year AS INT) AS fiscal_year, a.metric, CASE WHEN n_rows IS NULL THEN 'statement_row_not_found' ELSE 'verified_statement' END AS status, CASE WHEN a.metric = 'current_debt' THEN coalesce(total_row, total) ELSE value END AS value,
        CASE WHEN n_rows IS NOT NULL THEN 'statement:' || CASE WHEN tagged THEN 'PaymentsToAcquirePropertyPlantAndEquipment' ELSE '' END END AS concept, CASE WHEN tagged THEN 'high' WHEN n_rows IS NOT NULL THEN 'medium' END AS confidence, coalesce(n_rows, 0) AS n_rows,
        CAST(CASE a.metric WHEN 'capital_expenditures' THEN 3 WHEN 'interest_expense' THEN 2 ELSE 0 END AS BIGINT) AS n_rejected
      FROM asked AS a LEFT JOIN m USING (accession, fiscal_year, metric)""",
    "rejected_statement_rows": f"""WITH {ITEMS}, r AS (SELECT * FROM {values(REJECTED, "label, metric, reason")})
      SELECT accession, CAST(fiscal_year AS INT) AS fiscal_year, r.metric, row_number() OVER (PARTITION BY accession, fiscal_year, r.metric ORDER BY k) AS place, label AS row_label, value, reason FROM items JOIN r USING (label)""",
    "companyfacts_inventory": f"""WITH f AS (SELECT o_custkey AS c, o_orderkey AS k, CASE o_orderpriority WHEN '5-LOW' THEN 'dei' ELSE 'us-gaap' END AS namespace, CASE o_orderpriority WHEN '1-URGENT' THEN 'InterestExpense' WHEN '2-HIGH' THEN 'DebtCurrent' WHEN '3-MEDIUM' THEN 'Assets' WHEN '4-NOT SPECIFIED' THEN 'Cash' ELSE 'EntityShares' END AS concept,
          o_orderdate, CASE WHEN o_orderkey % 17 = 0 THEN 0.0 ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) * 10 AS DOUBLE) END AS v FROM orders WHERE year(o_orderdate) = 1999 AND {FORM} IN ('10-K', '10-K/A')),
      b AS (SELECT *, row_number() OVER (PARTITION BY c, namespace, concept ORDER BY k % 3 = 0 DESC, CAST(o_orderdate AS DATE) DESC, k) AS r FROM f)
      SELECT lpad(CAST(c AS VARCHAR), 10, '0') AS cik, namespace, concept, 'USD' AS unit, round(CASE WHEN abs(v) > 1000000 THEN v / 1000000 ELSE v END, 6) AS value, v = 0 AS is_zero FROM b WHERE r = 1""",
    "broken_company_facts": "SELECT DISTINCT o_custkey AS cik, CAST(2 AS INT) AS version FROM orders WHERE o_custkey % 4 = 0",
    "submissions_unnest": f"""SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, {FORM} AS form, 'a-' || o_orderkey AS accession, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filing_date,
        CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS report_date, CAST(year(o_orderdate) AS INT) AS fy, 'd' || o_orderkey || '.htm' AS document FROM orders""",
    "xml_instance": f"""WITH {LINE}, v AS (SELECT doc_id, i, y, p % 6 AS kind, CASE WHEN p % 4 = 0 THEN CAST(ct AS DOUBLE) ELSE CAST(-q AS DOUBLE) END AS v FROM l WHERE p % 9 <> 0),
      m AS (SELECT *, CASE kind WHEN 3 THEN 'shareholders_equity' WHEN 4 THEN 'interest_expense' WHEN 5 THEN 'total_assets' ELSE 'total_debt' END AS metric FROM v),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, y, metric ORDER BY kind, i) AS r FROM m)
      SELECT doc_id, CAST(y AS INT) AS year, metric, ({text_list(CONCEPTS)})[kind + 1] AS concept, CASE WHEN v > 1000000 THEN v / 1000000 ELSE v END AS value FROM r WHERE r = 1""",
    "xml_instance_summary": f"""WITH {LINE}, n AS (SELECT doc_id, ({text_list(CONCEPTS)})[p % 6 + 1] AS name FROM l WHERE p % 13 <> 0 UNION SELECT doc_id, unnest(['xbrl', 'entity', 'instant']) FROM l)
      SELECT doc_id, (SELECT CAST(max(y) AS INT) FROM l WHERE l.doc_id = n.doc_id) AS fiscal_year, string_agg(name, ',' ORDER BY name) AS names FROM n GROUP BY doc_id""",
}
