"""DuckDB SQL for the queries over what a research run writes."""

from __future__ import annotations

from tallyspark.functions import rules
from tallyspark.operators.reports import THEME_ITEMS
from tallyspark.plans import fixtures, views
from tallyspark.plans.filing_oracles import ITEMS
from tallyspark.operators.extraction import DEBT_CONCEPTS
from tallyspark.plans.oracles import CHUNKS, EVIDENCE, PAIRS, TOTALS, any_of, rejection_case, resolver, values
from tallyspark.plans.work import CLAIM_METRICS, STEPS, WANTED

THEME = THEME_ITEMS["leverage_analysis"].replace("'", "''")
NL = "chr(10)"


def money(x: str) -> str:
    return f"coalesce(format('{{:,.2f}}', {x}), 'n/a')"


BRIEF = f"""{TOTALS}, m AS (SELECT entity, fiscal_year, metric, CASE WHEN NOT (len(entity) % 3 = 0 AND metric = 'net_income') THEN value END AS value,
    CASE WHEN metric = 'other' AND fiscal_year = 2000 THEN 'unsupported' WHEN metric = 'interest_expense' AND len(entity) % 2 = 0 THEN 'low_confidence' ELSE 'verified' END AS status
  FROM (SELECT entity, fiscal_year, value, CASE metric WHEN '1-URGENT' THEN 'total_debt' WHEN '2-HIGH' THEN 'cash_and_equivalents' WHEN '3-MEDIUM' THEN 'net_income' WHEN '5-LOW' THEN 'interest_expense' ELSE 'other' END AS metric FROM totals WHERE fiscal_year IN (1996, 1998, 2000))),
good AS (SELECT * FROM m WHERE status = 'verified' AND value IS NOT NULL),
ch AS (SELECT *, CASE WHEN moved = 0 THEN 'mixed' WHEN {any_of("metric", rules.ADVERSE_WHEN_UP)} THEN CASE WHEN moved > 0 THEN 'adverse' ELSE 'favorable' END WHEN {any_of("metric", rules.FAVOURABLE_WHEN_UP)} THEN CASE WHEN moved > 0 THEN 'favorable' ELSE 'adverse' END ELSE 'mixed' END AS signal, replace(metric, '_', ' ') AS words
  FROM (SELECT a.entity, a.metric, a.value AS o, b.value AS n, b.value - a.value AS moved, (b.value - a.value) * 100 / nullif(abs(a.value), 0) AS percent FROM good AS a JOIN good AS b ON a.entity = b.entity AND a.metric = b.metric WHERE a.fiscal_year = 1996 AND b.fiscal_year = 2000)),
sig AS (SELECT entity, signal, string_agg('- ' || words || ' from ' || {money("o")} || ' to ' || {money("n")} || ' (' || coalesce(format('{{:,.1f}}', percent) || '%', 'n/a') || ')', {NL} ORDER BY metric) AS said FROM ch GROUP BY entity, signal),
reading AS (SELECT entity, string_agg('**' || CASE signal WHEN 'adverse' THEN 'Pressure' WHEN 'favorable' THEN 'Support' ELSE 'Depends on context' END || '**' || {NL} || said, {NL} || {NL} ORDER BY signal = 'mixed', signal) AS reading FROM sig GROUP BY 1),
yr AS (SELECT entity, fiscal_year, '### Fiscal ' || fiscal_year || {NL} || {NL} || '| Metric | Value | Status |' || {NL} || '|---|---|---|' || {NL} || string_agg('| ' || metric || ' | ' || coalesce(format('{{:,.2f}}', value) || ' USD', 'n/a') || ' | ' || CASE status WHEN 'verified' THEN '✓' WHEN 'unsupported' THEN '✗' ELSE '⚠' END || ' ' || status || ' |', {NL} ORDER BY metric) AS t FROM m GROUP BY entity, fiscal_year),
tabs AS (SELECT entity, string_agg(t, {NL} || {NL} ORDER BY fiscal_year) AS tabs FROM yr GROUP BY 1),
cc AS (SELECT entity, count(*) AS n, count(*) FILTER (WHERE signal = 'adverse') AS up, count(*) FILTER (WHERE signal = 'favorable') AS down,
  string_agg('| ' || metric || ' | ' || {money("o")} || ' | ' || {money("n")} || ' | ' || {money("moved")} || ' | ' || signal || ' |', {NL} ORDER BY metric) AS rows_,
  string_agg('- What drove ' || words || '?' || {NL}, '' ORDER BY metric) FILTER (WHERE signal = 'adverse') AS watch, string_agg('- Will ' || words || ' last?', {NL} ORDER BY metric) FILTER (WHERE signal = 'favorable') AS asks FROM ch GROUP BY 1),
mm AS (SELECT entity, count(*) AS n_all, count(*) FILTER (WHERE status = 'verified' AND value IS NOT NULL) AS n_good, string_agg('- ' || metric || ' ' || fiscal_year || ': ' || status, {NL} ORDER BY fiscal_year, metric) FILTER (WHERE NOT (status = 'verified' AND value IS NOT NULL)) AS limits FROM m GROUP BY 1)
SELECT entity, '# ' || entity || ': leverage analysis' || {NL} || {NL} || array_to_string(list_filter([
    '## Summary' || {NL} || {NL} || n_good || ' of ' || n_all || ' values are verified for fiscal 1996 and 2000.',
    '## Credit reading' || {NL} || {NL} || coalesce(reading, 'No direction can be read from these values.'),
    '## Key metrics' || {NL} || {NL} || tabs,
    '## Verified changes' || {NL} || {NL} || coalesce('| Metric | 1996 | 2000 | Change | Signal |' || {NL} || '|---|---|---|---|---|' || {NL} || rows_, 'No metric is verified in both years.'),
    '## Watch items' || {NL} || {NL} || coalesce(watch, '') || '- {THEME}',
    '## Basis' || {NL} || {NL} || n_good || ' values compared by rule; ' || coalesce(n, 0) || ' changes calculated.',
    CASE WHEN len(entity) % 2 = 1 THEN '## Evidence' || {NL} || {NL} || 'Notes on ' || entity || '.' END,
    '## Limits' || {NL} || {NL} || coalesce(limits, 'All values are verified.'), '## Questions' || {NL} || {NL} || coalesce(asks, 'None from these values.'),
    '## Conclusion' || {NL} || {NL} || 'leverage analysis: ' || CASE WHEN n IS NULL THEN 'open' WHEN up > down THEN 'weaker' WHEN down > up THEN 'stronger' ELSE 'balanced' END || '.'], lambda x: x IS NOT NULL), {NL} || {NL}) AS brief,
  CAST(9 + len(entity) % 2 AS BIGINT) AS n_sections
FROM mm JOIN tabs USING (entity) LEFT JOIN cc USING (entity) LEFT JOIN reading USING (entity)"""

PREVIEW = r"substring(trim(regexp_replace(text, '[\t\n\f\r\x0B ]+', ' ', 'g')), 1, 160)"
ROWS = f"""{CHUNKS}, ev AS (SELECT chunk_id % 50 AS query_id, chunk_id, fiscal_year AS y, CASE section_type WHEN 'en' THEN 'liquidity' WHEN 'de' THEN 'debt' WHEN 'fr' THEN 'mda' ELSE 'credit_facilities' END AS kind, section_name, lower(text) AS low, {PREVIEW} AS said, (chunk_id * 37 % 1000) / 1000.0 AS score FROM chunks),
placed AS (SELECT *, CASE kind WHEN 'liquidity' THEN 0 WHEN 'credit_facilities' THEN 1 WHEN 'debt' THEN 2 WHEN 'mda' THEN 3 ELSE 9 END AS s FROM ev),
shown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY y, s, score DESC, chunk_id) AS k FROM placed) WHERE k <= 12)"""


def pick(name: str) -> str:
    cases = []
    for i, (year, sections, phrases) in enumerate(WANTED[name]):
        test = " AND ".join([f"y = {year}" if year else "true", f"kind IN ({', '.join(map(repr, sections))})" if sections else "true", any_of("low", phrases) if phrases else "true"])
        cases.append(f"WHEN {test} THEN {i}")
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r, y, s, score DESC, chunk_id) AS j FROM (SELECT *, CASE {' '.join(cases)} END AS r FROM placed) WHERE r IS NOT NULL) WHERE j = 1)"


PICKS = ROWS + ", " + ", ".join(map(pick, WANTED))
JOINED = " ".join(f"LEFT JOIN {n} ON {n}.query_id = q.query_id" for n in WANTED)


def told(name: str) -> str:
    return f"{name}.y || ': ' || {name}.said || ' [' || {name}.chunk_id || ']'"


def lines(items: list[str], none: str) -> str:
    listed = f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({listed}) = 0 THEN '{none}' ELSE array_to_string(list_transform({listed}, lambda x: '- ' || x), {NL}) END"


FOUND = ["debt_old", "debt_new", "cash_old", "cash_new"]
CITED = ", ".join(f"'[' || {n}.chunk_id || ']'" for n in FOUND)
ANSWER = f"""{PICKS}, {EVIDENCE}, {PAIRS.removeprefix("WITH ")}, res AS (SELECT n_nationkey AS query_id, metric, o, n, entity || '|' || metric AS source, CASE WHEN metric = '1-URGENT' THEN 'verified' WHEN metric = '2-HIGH' AND len(entity) % 2 = 0 THEN 'verified' WHEN metric = '2-HIGH' THEN 'unsupported' ELSE 'not_enough_data' END AS status FROM pairs JOIN nation ON n_name = entity),
rr AS (SELECT query_id, count(*) FILTER (WHERE status = 'verified') AS n_good, count(*) FILTER (WHERE status <> 'verified') AS n_blocked, string_agg('| ' || metric || ' | ' || {money("o")} || ' | ' || {money("n")} || ' |', {NL} ORDER BY metric) FILTER (WHERE status = 'verified') AS tab,
  string_agg('- ' || metric || ' went from ' || {money("o")} || ' to ' || {money("n")} || ' [' || source || ']', {NL}) FILTER (WHERE status = 'verified' AND metric = '1-URGENT') AS debt_said, string_agg('- ' || metric || ' went from ' || {money("o")} || ' to ' || {money("n")} || ' [' || source || ']', {NL}) FILTER (WHERE status = 'verified' AND metric = '2-HIGH') AS cash_said FROM res GROUP BY 1),
tab AS (SELECT query_id, string_agg('| ' || chunk_id || ' | ' || y || ' | ' || section_name || ' | ' || format('{{:,.3f}}', score) || ' |', {NL} ORDER BY k) AS shown_tab FROM shown GROUP BY 1),
q AS (SELECT DISTINCT query_id FROM ev)
SELECT q.query_id, array_to_string([
    '## Summary' || {NL} || {NL} || CASE WHEN n_good > 0 THEN n_good || ' changes are verified.' WHEN {" AND ".join(f"{n}.chunk_id IS NOT NULL" for n in FOUND)} THEN 'Both years are covered. ' || concat_ws(' ', {CITED}) WHEN {" OR ".join(f"{n}.chunk_id IS NOT NULL" for n in FOUND)} THEN 'A part is covered. ' || concat_ws(' ', {CITED}) ELSE 'The evidence is incomplete.' END,
    '## Debt' || {NL} || {NL} || coalesce(debt_said, {lines([told("debt_old"), told("debt_new")], "Nothing was found.")}),
    '## Liquidity' || {NL} || {NL} || coalesce(cash_said, {lines([told("cash_old"), told("cash_new")], "Nothing was found.")}),
    '## Management''s words' || {NL} || {NL} || {lines([told("words_old"), told("words_new")], "None were found.")},
    '## Numeric changes' || {NL} || {NL} || coalesce('| Metric | Old | New |' || {NL} || '|---|---|---|' || {NL} || tab, 'No change is verified.'),
    '## Evidence' || {NL} || {NL} || '| Chunk | Year | Section | Score |' || {NL} || '|---|---|---|---|' || {NL} || shown_tab,
    '## Confidence' || {NL} || {NL} || CASE WHEN len(missing) = 0 THEN 'Coverage is sufficient.' ELSE 'Coverage is limited; missing: ' || array_to_string(missing, ', ') || '.' END || CASE WHEN n_blocked > 0 THEN ' ' || n_blocked || ' claims were not verified and are left out.' ELSE '' END,
    '## Questions' || {NL} || {NL} || '- Which scope of debt should decide?' || {NL} || '- Which measure of liquidity counts?', '## Trace' || {NL} || {NL} || 'trace/log'], {NL} || {NL}) AS answer,
  CAST(CASE WHEN debt_said IS NOT NULL THEN 1 ELSE (debt_old.y IS NOT NULL)::INT + (debt_new.y IS NOT NULL)::INT END + CASE WHEN cash_said IS NOT NULL THEN 1 ELSE (cash_old.y IS NOT NULL)::INT + (cash_new.y IS NOT NULL)::INT END AS BIGINT) AS n_claims
FROM q JOIN tab USING (query_id) JOIN cover USING (query_id) LEFT JOIN rr USING (query_id) {JOINED}"""

N = len(fixtures.CONCEPTS)
NAMES = "[" + ", ".join(f"'{c}'" for c in fixtures.CONCEPTS) + "]"
SAFE = [(m, c, s) for m, found in rules.SAFE_CONCEPTS.items() for c, s in found.items()]
#: Words of four letters of each metric's name, and the parts that its configured concepts hold.
TERMS = {"interest_expense": ["expense", "interest"], "dividend_payments": ["dividend", "payments"], "cash_and_equivalents": ["cash", "equivalents"]}
REGISTER_OF_CONCEPTS = f"""inv AS (SELECT * FROM (SELECT *, lower(concept) AS low FROM (SELECT cik, concept, min(unit) AS unit FROM (
    SELECT CAST(p_partkey % 97 AS VARCHAR) AS cik, ({NAMES})[p_partkey * 7 % {N} + 1] AS concept, CASE WHEN p_partkey % 13 = 0 THEN 'EUR' ELSE 'USD' END AS unit FROM part) GROUP BY ALL)) WHERE NOT (CAST(cik AS INT) % 3 = 0 AND concept IN ('InterestExpense', 'InterestExpenseNonoperating'))),
safe AS (SELECT * FROM {values(SAFE, "metric, concept, s")}),
cand AS (SELECT cik, metric, concept, CASE WHEN unit <> 'USD' THEN 'not_relevant' WHEN s IS NOT NULL THEN 'same_metric' ELSE coalesce({rejection_case(4)}, 'not_auto_resolved') END AS class, unit = 'USD' AND s IS NOT NULL AS accepted,
    CAST(CASE WHEN unit <> 'USD' THEN 0.0 WHEN s IS NOT NULL THEN s ELSE coalesce({rejection_case(5)}, 0.2) END AS DOUBLE) AS confidence FROM ({" UNION ALL ".join(f"SELECT '{m}' AS metric, * FROM inv WHERE {any_of('low', t)}" for m, t in TERMS.items())}) LEFT JOIN safe USING (metric, concept)),
b AS (SELECT *, accepted AND confidence = max(CASE WHEN accepted THEN confidence END) OVER (PARTITION BY cik, metric) AS best, row_number() OVER (PARTITION BY cik, metric, accepted ORDER BY confidence DESC, concept) AS k FROM cand),
g AS (SELECT cik, metric, count(*) FILTER (WHERE accepted) AS n_accepted, count(*) FILTER (WHERE best) AS n_best, min(concept) FILTER (WHERE best) AS c, coalesce(string_agg(concept || ' (' || class || ')', '; ' ORDER BY k) FILTER (WHERE NOT accepted AND k <= 12), '') AS related FROM b GROUP BY ALL)
SELECT cik, metric, CASE WHEN n_accepted = 0 AND related <> '' THEN 'related_only' WHEN n_accepted = 0 THEN 'unresolved' WHEN n_accepted = 1 OR n_best = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n_accepted = 1 OR n_best = 1 THEN c END AS concept, related FROM g"""
FORM = "CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-K/A' ELSE '10-Q' END"

NARRATED = """o AS (SELECT CAST(o_custkey AS VARCHAR) AS company, 'o' || o_orderkey AS chunk_id, CAST(year(o_orderdate) AS INT) AS fy, o_orderkey % 8 AS k, o_orderkey % 5 = 0 AS other, floor(CAST(round(o_totalprice * 100) AS BIGINT) / 100000) AS t FROM orders),
told AS (SELECT company, chunk_id, fy, unnest(CASE WHEN k = 2 THEN [{'metric': 'company_cash', 'v': t + 2}, {'metric': 'company_liquidity', 'v': t + 5}] WHEN other THEN [] WHEN k = 0 THEN [{'metric': 'total_balance_sheet_cash_and_marketable_securities_restricted_cash', 'v': t}]
    WHEN k = 1 THEN [{'metric': 'company_cash', 'v': t}, {'metric': 'company_liquidity', 'v': t + 3}] WHEN k = 3 THEN [{'metric': 'ford_credit_net_liquidity_available_for_use', 'v': t}] WHEN k = 4 THEN [{'metric': 'ford_credit_liquidity_sources', 'v': t}] WHEN k = 5 THEN [{'metric': 'ford_credit_committed_capacity', 'v': t}] ELSE [] END, recursive := true), k = 2 AS low FROM o)"""
TAGS = [c for found in DEBT_CONCEPTS.values() for c in found]
TAG_ORDER = [(m, c, i) for m, found in DEBT_CONCEPTS.items() for i, c in enumerate(found)]

SQL: dict[str, str] = {
    "narrative_facts": f"""WITH {NARRATED} SELECT chunk_id, metric, round(v / 10, 6) AS value, CASE WHEN low THEN 'low' ELSE 'high' END AS confidence, low AS review_required, company || '_' || fy || '_' || metric || '_text_' || CASE WHEN low THEN 'low_review' ELSE 'high' END AS fact_id FROM told""",
    "fact_bag": f"""WITH {NARRATED}, tags AS (SELECT CAST(o_custkey AS VARCHAR) AS company, CAST(year(o_orderdate) AS INT) AS fy, ({TAGS!r})[o_orderkey * 3 % {len(TAGS)} + 1] AS concept, max(CAST(round(o_totalprice * 100) AS BIGINT) * 10000) AS v FROM orders GROUP BY ALL),
      pri AS (SELECT * FROM {values(TAG_ORDER, "metric, concept, priority")}), best AS (SELECT company, fy, metric, arg_min(v, priority) AS v FROM tags JOIN pri USING (concept) GROUP BY ALL),
      src AS (SELECT DISTINCT fy FROM o WHERE k = 6),
      bag AS (SELECT company, fy, 'xbrl' AS s, round(CAST(v AS DOUBLE) / 1e9, 6) AS value FROM best WHERE fy IN (SELECT fy FROM src) UNION ALL SELECT company, fy, 'text', round(v / 10, 6) FROM told)
      SELECT company, fy AS fiscal_year, s AS fact_source, count(*) AS n, round(sum(value), 6) AS total FROM bag GROUP BY ALL""",
    "statement_analysis": f"""WITH {ITEMS}, st AS (SELECT accession AS entity, fiscal_year AS fy, metric, CASE WHEN metric = 'current_debt' THEN coalesce(max(value) FILTER (WHERE label LIKE 'Total%'), sum(value)) ELSE min(value) END AS s FROM items WHERE metric IS NOT NULL AND value IS NOT NULL GROUP BY accession, fiscal_year, metric),
      fl AS (SELECT CAST(c AS VARCHAR) AS entity, fy, unnest([{{'metric': 'operating_cash_flow', 'f': x + c % 3}}, {{'metric': 'interest_expense', 'f': floor(x / 12)}}, {{'metric': 'long_term_debt', 'f': floor(x / 9)}}], recursive := true) FROM (SELECT c, 2025 AS fy, a AS x FROM totals UNION ALL SELECT c, 2024, b FROM totals)),
      direct AS (SELECT entity, fy, metric, s, f, coalesce(s, f) AS value FROM st FULL JOIN fl USING (entity, fy, metric)),
      v AS (SELECT entity, fy, max(value) FILTER (WHERE metric = 'operating_cash_flow') - abs(max(value) FILTER (WHERE metric = 'capital_expenditures')) AS fcf, max(value) FILTER (WHERE metric = 'current_debt') + max(value) FILTER (WHERE metric = 'long_term_debt') AS debt FROM direct GROUP BY entity, fy),
      made AS (SELECT entity, fy, 'free_cash_flow' AS metric, fcf AS value FROM v UNION ALL SELECT entity, fy, 'total_debt', debt FROM v)
      SELECT entity, CAST(fy AS INT) AS fiscal_year, metric, value, CASE WHEN s IS NULL THEN 'companyfacts' ELSE 'statement' END AS source, CASE WHEN s IS NULL THEN 'resolved' WHEN f IS NULL THEN 'verified_statement' WHEN abs(s - f) <= 1 THEN 'verified_cross_checked' ELSE 'cross_check_mismatch' END AS status,
        CASE WHEN s IS NULL THEN NULL WHEN f IS NULL THEN 'not_found' WHEN abs(s - f) <= 1 THEN 'matched' ELSE 'mismatch' END AS cross_check, s - f AS difference, coalesce(abs(s - f) > 1, false) AS requires_review, CASE WHEN s IS NULL THEN 'company_facts' ELSE 'statement' END AS source_type FROM direct
      UNION ALL SELECT entity, CAST(fy AS INT), metric, value, 'deterministic_calculation', 'calculated_from_verified_inputs', NULL, NULL, false, 'none' FROM made""",
    "configured_resolution": f"""WITH {resolver()}, b AS (SELECT *, accepted AND confidence = max(CASE WHEN accepted THEN confidence END) OVER (PARTITION BY cik, metric) AS best FROM cand WHERE metric IN ('interest_expense', 'net_income')),
      g AS (SELECT cik, metric, count(*) FILTER (WHERE accepted) AS na, count(*) FILTER (WHERE best) AS nb, min(concept) FILTER (WHERE best) AS c, arg_min(value, concept) FILTER (WHERE best) AS v, bool_or(concept = 'InterestExpenseNonoperating') AS first_, bool_or(concept = 'InterestExpense') AS second_,
        max(value) FILTER (WHERE concept = 'InterestExpenseNonoperating') AS fv, max(value) FILTER (WHERE concept = 'InterestExpense') AS sv FROM b GROUP BY ALL),
      h AS (SELECT *, metric = 'interest_expense' AND (first_ OR second_) AS own, na = 1 OR nb = 1 AS one FROM g)
      SELECT cik, metric, CASE WHEN own OR one THEN 'resolved' WHEN na = 0 THEN 'unresolved' ELSE 'ambiguous' END AS status, CASE WHEN own THEN 'configured_concept' WHEN na = 0 THEN 'no_safe_candidate' WHEN na = 1 THEN 'safe_alternate' WHEN nb = 1 THEN 'highest_confidence_alternate' ELSE 'multiple_safe_candidates' END AS basis,
        CASE WHEN own THEN CASE WHEN first_ THEN 'InterestExpenseNonoperating' ELSE 'InterestExpense' END WHEN one THEN c END AS concept, CASE WHEN own THEN CASE WHEN first_ THEN fv ELSE sv END WHEN one THEN v END AS value FROM h""",
    "gap_sections": f"""WITH {CHUNKS}, {EVIDENCE}, m AS (SELECT query_id, lower(array_to_string(missing, ' ')) AS said FROM cover) SELECT query_id, concat_ws(',', CASE WHEN contains(said, 'debt') THEN 'debt' END, CASE WHEN contains(said, 'liquidity') THEN 'liquidity' END, CASE WHEN contains(said, 'credit') THEN 'credit_facilities' END, CASE WHEN contains(said, 'management') THEN 'mda' END) AS sections FROM m""",
    "flat_metrics": f"WITH {TOTALS} SELECT entity AS ticker, fiscal_year, row_number() OVER (PARTITION BY entity, fiscal_year ORDER BY metric) - 1 AS pos, metric, value FROM totals",
    "run_summary": f"WITH {TOTALS} SELECT entity AS ticker, count(DISTINCT fiscal_year) AS n_years, count(*) AS n_metrics, string_agg(DISTINCT metric, ',' ORDER BY metric) AS concepts FROM totals GROUP BY 1",
    "diagnostic_report": f"""WITH {TOTALS}, e AS (SELECT DISTINCT entity FROM totals), a AS (SELECT entity, m AS metric FROM e, (SELECT unnest(['1-URGENT', '9-NONE']) AS m)), g AS (SELECT entity, metric, list_sort(list(DISTINCT fiscal_year)) AS y FROM totals WHERE metric = '1-URGENT' AND fiscal_year IN (1996, 1997, 2002) GROUP BY 1, 2),
      j AS (SELECT a.entity, a.metric, coalesce(y, []) AS y FROM a LEFT JOIN g ON g.entity = a.entity AND g.metric = a.metric)
      SELECT entity, metric, array_to_string(y, ', ') AS covered_years, array_to_string(list_filter([1996, 1997, 2002], lambda x: NOT list_contains(y, x)), ', ') AS missing_years, CASE WHEN len(entity) % 2 = 0 THEN 'a, m' ELSE 'm, z' END AS candidates,
        CASE WHEN len(y) = 3 THEN 'covered' WHEN len(y) > 0 THEN 'partially_covered' ELSE 'not_covered' END AS diagnosis FROM j""",
    "full_brief": f"WITH {BRIEF}",
    "answer": f"WITH {ANSWER}",
    "evidence_picks": f"""WITH {PICKS}, q AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY k) AS shown FROM shown GROUP BY 1) SELECT q.query_id, {", ".join(f"{n}.chunk_id AS {n}" for n in WANTED)}, q.shown FROM q {JOINED}""",
    "stored_formulas": """WITH p AS (SELECT l_suppkey AS entity, year(l_shipdate) AS fiscal_year, sum(l_quantity) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'O') AS cd, sum(l_quantity) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'F') AS ld, sum(l_quantity) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS eq,
        sum(l_quantity) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS ca, sum(l_quantity) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'O') AS ao, sum(l_quantity) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS iv, sum(l_quantity) AS ni, CASE WHEN any_value(l_suppkey) % 4 <> 0 THEN count(*) ELSE 0 END AS ie, sum(l_linenumber) AS ocf, sum(l_linenumber % 3) AS cx FROM lineitem GROUP BY ALL),
      c AS (SELECT *, ao - (ao % 3) * 50 AS cl FROM p),
      f AS (SELECT entity, fiscal_year, unnest([{'metric': 'debt_to_equity', 'value': (cd + ld) / nullif(eq, 0)}, {'metric': 'current_ratio', 'value': ca / nullif(cl, 0)}, {'metric': 'quick_ratio', 'value': (ca - iv) / nullif(cl, 0)}, {'metric': 'interest_coverage', 'value': ni / nullif(ie, 0)}, {'metric': 'free_cash_flow', 'value': CAST(ocf - cx AS DOUBLE)}, {'metric': 'total_debt', 'value': cd + ld}], recursive := true) FROM c)
      SELECT entity, fiscal_year, metric, round(value, 6) AS value FROM f WHERE value IS NOT NULL""",
    "filing_manifest": f"""WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS cik, 'a-' || o_orderkey AS accession, {FORM} AS form, CAST(year(o_orderdate) AS INT) AS fy, o_orderkey AS pos FROM orders),
      c AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY NOT (form = '10-K' AND fy = 1997), pos) AS k FROM o WHERE form IN ('10-K', '10-Q'))
      SELECT cik, accession, form, fy AS fiscal_year, NOT (form = '10-K' AND fy = 1997) AS is_substitution, CAST(CASE WHEN CAST(cik AS BIGINT) % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS batch, 'https://www.sec.gov/Archives/edgar/data/' || regexp_replace(cik, '^0+', '') || '/' || replace(accession, '-', '') || '/' || accession || '.htm' AS document, md5('<p>' || accession || '</p>') AS digest FROM c WHERE k = 1""",
    "first_filings": """WITH w AS (SELECT DISTINCT o_custkey AS cik, CAST(year(o_orderdate) AS INT) AS fiscal_year FROM orders) SELECT cik, fiscal_year, min(o_orderkey) AS accession FROM w JOIN orders ON o_custkey = cik WHERE o_orderstatus = 'F' AND year(o_orderdate) IN (fiscal_year, fiscal_year + 1) GROUP BY 1, 2""",
    "filing_years": """SELECT o_custkey AS cik, coalesce(array_to_string(list_reverse_sort(list_distinct(list(year(o_orderdate)) FILTER (WHERE o_orderstatus = 'F'))), ','), '') AS years FROM orders GROUP BY 1""",
    "ordered_claims": f"""WITH {PAIRS} SELECT 'claim_' || entity || '_' || metric || '_{views.OLD_YEAR}_{views.NEW_YEAR}' AS claim_id, CAST(list_position({CLAIM_METRICS!r}, metric) AS INT) AS place, metric FROM pairs WHERE metric IN ({", ".join(map(repr, CLAIM_METRICS))})""",
    "resolver_register": f"WITH {REGISTER_OF_CONCEPTS}",
    "ambiguous_companies": """WITH d AS (SELECT 'C' || c_custkey AS ticker, lower(c_mktsegment) || ' ' || c_custkey % 100 || ' Holding, Inc.' AS shown, lower(c_mktsegment) || ' ' || c_custkey % 100 || ' holding' AS title, c_custkey AS pos FROM customer),
      q AS (SELECT min(c_custkey) AS query_id, lower(c_mktsegment) || ' 1' AS name FROM customer GROUP BY c_mktsegment), j AS (SELECT query_id, ticker, shown, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS k FROM q JOIN d ON starts_with(title, name))
      SELECT query_id, any_value(n) || ' companies fit: ' || string_agg(ticker || ' (' || shown || ')', '; ' ORDER BY k) AS message FROM j WHERE n > 1 AND k <= 5 GROUP BY 1""",
    "topic_memory": """WITH m AS (SELECT CAST(conv_id % 40 AS VARCHAR) AS company, list_sort(list_distinct(list(substring(text, 1, 12)))) AS s, list_sort(list_distinct(list(substring(text, 1, 5)))) AS q FROM conversations WHERE role = 'user' GROUP BY 1),
      a AS (SELECT CAST(n_nationkey AS VARCHAR) AS company FROM nation UNION ALL SELECT unnest(['100', '101', '102']))
      SELECT company, CAST(coalesce(len(string_split(array_to_string(s, '|'), '|')), 0) AS BIGINT) AS n_sections, coalesce(string_split(array_to_string(q, '|'), '|')[-1], 'start here') AS query, CAST(1 AS BIGINT) AS n_boosts FROM a LEFT JOIN m USING (company)""",
    "research_plan": f"""SELECT n_nationkey AS task_id, 'Compare ' || n_name || ' on debt and liquidity between 2023 and 2025.' AS objective, CAST({len(STEPS)} AS BIGINT) AS n_steps, n_name || ' 2025 2023 10-K 10-Q debt and liquidity' AS initial_query, CAST(3 AS INT) AS max_iterations FROM nation""",
    "next_query": f"""WITH {CHUNKS}, {EVIDENCE}, r AS (SELECT query_id, array_to_string(missing, '; ') AS said FROM cover WHERE len(missing) > 0),
      w AS (SELECT query_id, concat_ws(' ', 'Issuer', '2023 2025', CASE WHEN contains(said, 'debt') THEN 'debt maturities long-term debt payable within one year' END, CASE WHEN contains(said, 'liquidity') THEN 'liquidity capital resources cash marketable securities committed credit' END, CASE WHEN contains(said, 'management') THEN 'management discussion primarily due to we expect' END, CASE WHEN contains(said, 'numeric') THEN 'total amount billion million' END) AS query,
        CASE WHEN query_id % 2 = 0 THEN 'Issuer outlook debt' ELSE '2023 2025 first try' END AS old FROM r),
      u AS (SELECT query_id, old, unnest(string_split(query || ' ' || old, ' ')) AS word, generate_subscripts(string_split(query || ' ' || old, ' '), 1) AS i FROM w), f AS (SELECT query_id, old, word, min(i) AS i FROM u GROUP BY ALL), made AS (SELECT query_id, old, string_agg(word, ' ' ORDER BY i) AS query FROM f GROUP BY ALL)
      SELECT query_id, query, query <> old AS changed FROM made UNION ALL SELECT unnest([900, 901]), 'nothing missing', false""",
    "allowed_numbers": """WITH v AS (SELECT o_custkey, floor(CAST(round(o_totalprice * 100) AS BIGINT) / 1000) / 100 AS x FROM orders),
      r AS (SELECT o_custkey, unnest([CAST(x AS VARCHAR), format('{:.0f}', x), format('{:.1f}', x), format('{:.2f}', x), format('{:,.0f}', x), format('{:,.1f}', x), format('{:,.2f}', x)]) AS n FROM v UNION SELECT DISTINCT o_custkey, unnest(['2023', '2025']) FROM v)
      SELECT o_custkey, count(DISTINCT n) AS n, array_to_string(list_sort(list_distinct(list(n) FILTER (WHERE NOT contains(n, ',')))), '|') AS plain FROM r GROUP BY 1""",
    "compact_results": f"""WITH {PAIRS}, c AS (SELECT *, CASE WHEN len(entity) = 6 THEN NULL ELSE n END AS m FROM pairs)
      SELECT 'claim_' || entity || '_' || metric || '_{views.OLD_YEAR}_{views.NEW_YEAR}' AS claim_id, metric, CASE WHEN m IS NULL THEN 'not_enough_data' WHEN len(entity) % 5 = 0 THEN 'low_confidence' WHEN len(entity) % 4 = 0 THEN 'inconsistent' WHEN metric = '5-LOW' THEN 'unsupported' WHEN metric = '2-HIGH' AND abs(1.0 - (m - o)) > 1e-6 THEN 'unsupported' ELSE 'verified' END AS status,
        CAST({views.OLD_YEAR} AS INT) AS old_year, CAST({views.NEW_YEAR} AS INT) AS new_year, round(m - o, 2) AS absolute_change, CASE WHEN m > o THEN 'increase' WHEN m < o THEN 'decrease' WHEN m = o THEN 'no_change' END AS direction, CAST(0 AS BIGINT) AS n_evidence FROM c""",
}
