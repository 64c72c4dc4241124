"""DuckDB SQL for the registered queries, written from the operators' definitions."""

from __future__ import annotations

from tallyspark.functions import rules
from tallyspark.operators import reports
from tallyspark.plans import fixtures, views


def values(rows: list[tuple], columns: str) -> str:
    """A literal table; null, text, numbers and booleans."""

    def one(x: object) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else f"CAST({x} AS BIGINT)"

    body = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
    return f"(VALUES {body}) AS t({columns})"


def any_of(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t.replace(chr(39), chr(39) * 2)}')" for t in terms) + ")"


def weight(text: str, weights: dict[str, float]) -> str:
    return " + ".join(f"(CASE WHEN contains({text}, '{p}') THEN {w} ELSE 0.0 END)" for p, w in weights.items())


TOKENS = r"list_transform(regexp_extract_all({}, '[a-zA-Z0-9][a-zA-Z0-9\-'']*'), lambda x: lower(x))"
CHUNKS = """chunks AS (
  SELECT doc_id AS chunk_id, lang AS section_type, source AS section_name, CASE WHEN doc_id % 2 = 0 THEN 2023 ELSE 2025 END AS fiscal_year, text FROM documents)"""
TERMS = "terms AS (SELECT chunk_id, fiscal_year, " + TOKENS.format("concat_ws(' ', coalesce(section_name, ''), coalesce(section_type, ''), coalesce(text, ''))") + " AS terms FROM chunks)"
ASKED = f"qry AS (SELECT query_id, query FROM {values(list(views.QUERY_TEXTS.items()), 'query_id, query')})"
FACTS = """facts AS (
  SELECT n_name AS entity, o_orderpriority AS metric, year(o_orderdate) AS fiscal_year, o_totalprice AS value, o_orderdate AS filed,
    CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-K/A' ELSE '10-Q' END AS form,
    CASE WHEN o_orderkey % 3 = 0 THEN 'FY' ELSE 'Q4' END AS fp,
    CASE o_orderkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS confidence,
    CASE WHEN o_orderkey % 2 = 0 THEN 'xbrl' ELSE 'text' END AS fact_source, o_orderkey % 7 = 0 AS review_required, o_orderkey AS pos
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
TOTALS = FACTS + ", totals AS (SELECT entity, metric, fiscal_year, round(sum(value), 2) AS value FROM facts GROUP BY ALL)"


def bm25(where: str, top_n: int, asked: str = ASKED, last: bool = True, name: str = "sparse") -> str:
    return f"""{CHUNKS}, {TERMS}, {asked},
corpus AS (SELECT count(*) AS n, greatest(avg(len(terms)), 1.0) AS mean FROM terms WHERE {where}),
want AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.format("query")}) AS term FROM qry) GROUP BY ALL),
tf AS (SELECT chunk_id, term, length, count(*) AS tf FROM (SELECT chunk_id, len(terms) AS length, unnest(terms) AS term FROM terms WHERE {where}) WHERE term IN (SELECT term FROM want) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
scores AS (
  SELECT query_id, chunk_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 9) AS score
  FROM tf JOIN df USING (term) JOIN want USING (term), corpus GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM scores WHERE score > 0) WHERE rank <= {top_n})
""" + (f"SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM {name}" if last else "")


DENSE = f"""asked AS (SELECT list_position([{", ".join(map(str, views.QUERY_VECTORS))}], vec_id) AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id IN ({", ".join(map(str, views.QUERY_VECTORS))})),
near AS (SELECT CAST(query_id AS BIGINT) AS query_id, vec_id AS chunk_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, asked),
dense AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM near) WHERE rank <= {{}})"""
FUSED = f"""WITH {bm25("true", 30, last=False)}, {DENSE.format(30)},
fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS fused_rank FROM (
    SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score, max(CASE WHEN l = 0 THEN rank END) AS bm25_rank, max(CASE WHEN l = 1 THEN rank END) AS vector_rank, max(CASE WHEN l = 1 THEN nullif(score, 0) END) AS cosine
    FROM (SELECT 0 AS l, * FROM sparse UNION ALL SELECT 1 AS l, * FROM dense) GROUP BY query_id, chunk_id))
"""
LOW = "lower(text)"
RERANKED = f"""{FUSED}, kinds AS (
  SELECT f.*, c.text, c.section_name, CASE c.section_type WHEN 'en' THEN 'liquidity' WHEN 'de' THEN 'debt' WHEN 'fr' THEN 'risk_factors' ELSE 'mda' END AS section_type FROM fused f JOIN chunks c USING (chunk_id)),
raw AS (
  SELECT *, round(coalesce(cosine, 0.0) + CASE section_type WHEN 'liquidity' THEN 0.14 WHEN 'debt' THEN 0.14 WHEN 'risk_factors' THEN 0.02 ELSE -0.02 END
    + {weight("lower(section_name)", rules.TITLE_WEIGHTS)} + {weight(LOW, rules.CONTENT_WEIGHTS)} + least(rrf_score * 2, 0.06), 6) AS raw_score FROM kinds),
reranked AS (SELECT *, round(1 / (1 + exp(-raw_score)), 6) AS reranker_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, chunk_id) AS rerank FROM raw) WHERE rerank <= 12)
"""
CANONICAL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
LINES = r"""lines AS (
  SELECT doc_id, pos, line FROM (
    SELECT doc_id, i - 1 AS pos, trim(regexp_replace(replace(l[i], chr(160), ' '), '[\t\n\f\r\x0B ]+', ' ', 'g')) AS line
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) WHERE line <> '')"""
BARE = "regexp_replace(line, '[.]+$', '')"


def heading_case(column: str) -> str:
    """column: 0 for the name, 1 for the type."""
    ladder = [
        (r"regexp_matches(canonical, '^note [0-9]+ debt and commitments')", "'Debt and Commitments'", "debt"),
        ("regexp_matches(canonical, '^item 7a ')", "line", "boundary"),
        ("canonical IN ('item 1a risk factors', 'risk factors')", "'Risk Factors'", "risk_factors"),
        ("regexp_matches(canonical, '^item 7 management s discussion') OR canonical IN ('management s discussion and analysis', 'management discussion and analysis')", "'Management''s Discussion and Analysis'", "mda"),
        ("contains(canonical, 'liquidity and capital resources')", "'Liquidity and Capital Resources'", "liquidity"),
        ("canonical IN ('debt', 'long term debt', 'debt and commitments')", BARE, "debt"),
        ("canonical IN ('credit facilities', 'committed credit facilities', 'other unsecured credit facilities')", BARE, "credit_facilities"),
        ("canonical IN ('cash flows', 'operating activities', 'financing activities')", "line", "cash_flow"),
        ("canonical IN ('total debt maturities', 'memo unsecured long term debt maturities')", BARE, "debt"),
        ("regexp_matches(canonical, '^item [0-9]+[a-z]?$') OR regexp_matches(canonical, '^note [0-9]+')", "line", "boundary"),
        ("canonical IN ('credit ratings', 'outlook', 'cautionary note on forward looking statements', 'non gaap financial measures that supplement gaap measures', 'critical accounting estimates')", "line", "boundary"),
    ]
    cases = " ".join(f"WHEN {test} THEN {name if column == 'name' else repr(kind)}" for test, name, kind in ladder)
    return f"CASE WHEN canonical = '' OR len(canonical) > 140 OR starts_with(canonical, 'day revolving credit facility') THEN NULL {cases} END AS {column}"


CHUNKED = r"""tok AS (SELECT doc_id, source, lang, t FROM (SELECT doc_id, source, lang, list_filter(string_split_regex(text, '[\t\n\f\r\x0B ]+'), lambda x: x <> '') AS t FROM documents) WHERE len(t) > 0),
win AS (SELECT doc_id, source, lang, t, i, i * 570 AS s FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil((len(t) - 80) / 570) AS INT)))) AS i FROM tok))"""
PAIRS = TOTALS + f""", pairs AS (SELECT entity, metric, max(CASE WHEN fiscal_year = {views.OLD_YEAR} THEN value END) AS o, max(CASE WHEN fiscal_year = {views.NEW_YEAR} THEN value END) AS n FROM totals GROUP BY ALL HAVING o IS NOT NULL AND n IS NOT NULL)"""
DIRECTION = "CASE WHEN n > o THEN 'increase' WHEN n < o THEN 'decrease' ELSE 'no_change' END"
REGISTER = PAIRS + f""", named AS (SELECT entity, CASE metric WHEN '1-URGENT' THEN 'total_debt' WHEN '2-HIGH' THEN 'cash_and_equivalents' WHEN '3-MEDIUM' THEN 'net_income' WHEN '5-LOW' THEN 'interest_expense' ELSE 'other' END AS metric, o, n FROM pairs),
register AS (SELECT entity, metric, round(o, 2) AS old_value, round(n, 2) AS new_value, round(n - o, 2) AS absolute_change, round((n - o) / abs(nullif(o, 0)) * 100, 2) AS percent_change, {DIRECTION} AS direction,
  CASE WHEN n = o THEN 'mixed' WHEN {any_of("metric", rules.ADVERSE_WHEN_UP)} THEN CASE WHEN n > o THEN 'adverse' ELSE 'favorable' END WHEN {any_of("metric", rules.FAVOURABLE_WHEN_UP)} THEN CASE WHEN n > o THEN 'favorable' ELSE 'adverse' END ELSE 'mixed' END AS signal FROM named)"""


def rejection_case(what: int) -> str:
    """what: 4 for the class, 5 for the confidence."""
    parts = []
    for r in sorted(rules.REJECTIONS, key=lambda r: (r[0], r[1])):
        test = " OR ".join(f"low = '{p[1:]}'" if p.startswith("=") else f"contains(low, '{p}')" for p in r[2])
        unless = f" AND NOT contains(low, '{r[3]}')" if r[3] is not None else ""
        parts.append(f"WHEN metric = '{r[0]}' AND ({test}){unless} THEN {r[what]!r}")
    return "CASE " + " ".join(parts) + " END"


def resolver() -> str:
    n = len(fixtures.CONCEPTS)
    names = "[" + ", ".join(f"'{c}'" for c in fixtures.CONCEPTS) + "]"
    safe = [(m, c, s) for m, found in rules.SAFE_CONCEPTS.items() for c, s in found.items()]
    asked = " UNION ALL ".join(f"SELECT '{m}' AS metric, * FROM inv WHERE {any_of('low', rules.SEARCH_TERMS[m])}" for m in fixtures.RESOLVER_METRICS)
    return f"""inv AS (
  SELECT *, lower(concept) AS low FROM (
  SELECT cik, concept, min(unit) AS unit, max(value) AS value FROM (
    SELECT CAST(p_partkey % 97 AS VARCHAR) AS cik, ({names})[p_partkey * 7 % {n} + 1] AS concept, CASE WHEN p_partkey % 13 = 0 THEN 'EUR' ELSE 'USD' END AS unit, p_retailprice AS value FROM part) GROUP BY ALL)),
safe AS (SELECT * FROM {values(safe, "metric, concept, s")}),
cand AS (
  SELECT cik, metric, concept, value, CASE WHEN unit <> 'USD' THEN 'not_relevant' WHEN s IS NOT NULL THEN 'same_metric' ELSE coalesce({rejection_case(4)}, 'not_auto_resolved') END AS class,
    unit = 'USD' AND s IS NOT NULL AS accepted, CAST(CASE WHEN unit <> 'USD' THEN 0.0 WHEN s IS NOT NULL THEN s ELSE coalesce({rejection_case(5)}, 0.2) END AS DOUBLE) AS confidence
  FROM ({asked}) LEFT JOIN safe USING (metric, concept))"""


EVIDENCE = f"""kinds AS (
  SELECT chunk_id % 50 AS query_id, chunk_id, fiscal_year, section_type AS lang, CASE section_type WHEN 'en' THEN 'liquidity' WHEN 'de' THEN 'debt' WHEN 'fr' THEN 'mda' ELSE 'other' END AS section_type,
    CASE WHEN chunk_id % 3 = 0 THEN 'We expect debt maturities and liquidity of $5 million. ' || text ELSE text END AS text FROM chunks),
flags AS (
  SELECT *, coalesce(section_type = 'debt' AND {any_of(LOW, rules.DEBT_TERMS)}, false) AS debt, coalesce(section_type IN ('liquidity', 'credit_facilities', 'mda') AND {any_of(LOW, rules.LIQUIDITY_TERMS)}, false) AS liquid,
    coalesce(section_type = 'mda' AND {any_of(LOW, rules.MANAGEMENT_TERMS)} AND len(regexp_extract_all(text, '[A-Z][^.]{{40,}}\\.')) >= 2, false) AS management,
    coalesce(section_type IN ('debt', 'liquidity', 'credit_facilities', 'mda') AND regexp_matches(text, '(?i)(\\$\\s*\\(?[0-9]|\\b[0-9]+(?:\\.[0-9]+)?\\s*(?:billion|million|%))'), false) AS numeric FROM kinds),
cover AS (
  SELECT query_id, list_filter([
    CASE WHEN NOT bool_or(fiscal_year = 2023) THEN '2023 evidence' END, CASE WHEN NOT bool_or(fiscal_year = 2025) THEN '2025 evidence' END,
    CASE WHEN NOT bool_or(debt AND fiscal_year = 2023) THEN '2023 debt evidence' END, CASE WHEN NOT bool_or(debt AND fiscal_year = 2025) THEN '2025 debt evidence' END,
    CASE WHEN NOT bool_or(liquid AND fiscal_year = 2023) THEN '2023 liquidity evidence' END, CASE WHEN NOT bool_or(liquid AND fiscal_year = 2025) THEN '2025 liquidity evidence' END,
    CASE WHEN NOT bool_or(management) THEN 'management explanation' END, CASE WHEN NOT bool_or(numeric) THEN 'numeric facts' END,
    CASE WHEN NOT bool_or(lang = 'es') THEN 'es evidence' END], lambda x: x IS NOT NULL) AS missing, count(*) FILTER (WHERE debt) AS n_debt, count(*) FILTER (WHERE numeric) AS n_numeric
  FROM flags GROUP BY query_id)"""
RENDERED = """rendered AS (
  SELECT CAST(floor(o_orderkey / 10) AS BIGINT) AS doc_id, string_agg(line, chr(10) ORDER BY o_orderkey) AS text FROM (
    SELECT o_orderkey, 'Order total was $' || format('{:,}', CAST(floor(cents / 100000) AS BIGINT)) || '.' || lpad(CAST(CAST(floor(cents / 1000) AS BIGINT) % 100 AS VARCHAR), 2, '0') || CASE WHEN o_orderkey % 4 = 0 THEN ' million, up 12.5%' ELSE ' thousand' END
      || CASE WHEN o_orderkey % 3 = 0 THEN ' [verified: claim_' || o_orderkey || ']' ELSE '' END || '.' AS line FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)) GROUP BY 1)"""
SCAN = RENDERED + f""", ln AS (SELECT doc_id, i - 1 AS line_no, trim(l[i]) AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM rendered))),
nums AS (SELECT *, regexp_extract_all(line, '{rules.FINANCIAL_NUMBER}') AS numbers, string_split_regex(line, '{rules.FINANCIAL_NUMBER}') AS pieces, list_sort(list_distinct(regexp_extract_all(line, '{rules.VERIFIED_TAG}', 1))) AS tags FROM ln),
ok AS (SELECT list('claim_' || o_orderkey) AS ids FROM orders WHERE o_orderstatus = 'F'),
scan AS (SELECT doc_id, line_no, k - 1 AS ordinal, numbers[k] AS number, list_sum(list_transform(pieces[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(numbers[1 : k - 1], lambda x: len(x))), 0) AS begins, line, array_to_string(tags, ',') AS tags, bound FROM (
  SELECT doc_id, line_no, line, numbers, pieces, tags, unnest(range(1, len(numbers) + 1)) AS k, coalesce(v.tag IS NOT NULL, false) AS bound FROM nums LEFT JOIN (SELECT DISTINCT 'claim_' || o_orderkey AS tag FROM orders WHERE o_orderstatus = 'F') v ON v.tag = nums.tags[1]))"""

SQL: dict[str, str] = {
    "tokenize_counts": f"WITH {CHUNKS}, {TERMS} SELECT chunk_id, CAST(len(terms) AS BIGINT) AS n_tokens, CAST(len(list_distinct(terms)) AS BIGINT) AS n_terms FROM terms",
    "bm25_topk": "WITH " + bm25("true", 10),
    "bm25_filtered_rebuild": "WITH " + bm25("fiscal_year = 2023", 10),
    "bm25_benchmark": "WITH " + bm25("true", 3, "qry AS (SELECT item_id AS query_id, text AS query FROM benchmark)"),
    "vector_topk": f"WITH {DENSE.format(10)} SELECT query_id, rank, chunk_id, score FROM dense",
    "hybrid_rrf": FUSED + "SELECT query_id, fused_rank, chunk_id, round(rrf_score, 6) AS rrf_score, bm25_rank, vector_rank FROM fused WHERE fused_rank <= 30",
    "post_filter": FUSED + "SELECT query_id, fused_rank, chunk_id, section_name FROM fused JOIN chunks USING (chunk_id) WHERE fused_rank <= 25 AND fiscal_year = 2025 AND contains(lower(section_name), 'src1')",
    "rerank_boosts": RERANKED + f"""SELECT query_id, rerank, chunk_id, raw_score, reranker_score, array_to_string(list_sort(list_filter([section_type, CASE WHEN {any_of(LOW, rules.NUMERIC_MARKS)} THEN 'numeric_facts' END, CASE WHEN {any_of(LOW, rules.EXPLANATION_MARKS)} THEN 'management_explanation' END], lambda x: x IS NOT NULL)), ',') AS categories FROM reranked""",
    "evidence_dedupe": RERANKED + "SELECT chunk_id, reranker_score, query_id AS pass FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY reranker_score DESC, query_id) AS k FROM reranked) WHERE k = 1",
    "section_segments": f"""WITH {LINES}, marks AS (SELECT *, {CANONICAL.format("line")} IN ('item 1', 'item 1 business') AS body, len(line) <= 60 AS marked FROM lines),
      b AS (SELECT *, sum(CAST(body AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS nb, sum(CAST(body AS INT)) OVER (PARTITION BY doc_id) AS ab FROM marks),
      n AS (SELECT *, sum(CAST(nb >= least(2, ab) AND marked AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM b),
      s AS (SELECT doc_id, section_no, arg_min(line, pos) AS name, min(pos) AS start_pos, string_agg(line, chr(10) ORDER BY pos) AS text FROM n WHERE section_no > 0 GROUP BY ALL),
      t AS (SELECT *, CASE WHEN len(name) <= 20 THEN 'boundary' WHEN len(name) <= 40 THEN 'debt' ELSE 'mda' END AS type FROM s)
      SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, name, type, CAST(start_pos AS BIGINT) AS start_pos, CAST(len(text) AS BIGINT) AS n_chars, md5(text) AS digest FROM t WHERE type <> 'boundary' AND len(text) >= CASE WHEN type = 'debt' THEN 180 ELSE 500 END""",
    "chunk_windows": f"WITH {CHUNKED} SELECT doc_id, CAST(i + 1 AS BIGINT) AS chunk_no, CAST(s AS BIGINT) AS token_start, CAST(least(s + 650, len(t)) AS BIGINT) AS token_end, md5(array_to_string(t[s + 1 : s + 650], ' ')) AS digest FROM win",
    "chunk_ids": f"""WITH {CHUNKED}, k AS (SELECT doc_id, i, upper(source) AS ticker, 2023 + doc_id % 2 AS fy, lang FROM win)
      SELECT doc_id, CAST(i + 1 AS BIGINT) AS chunk_no, format('{{}}_{{}}_10K_section_{{}}_{{:03d}}', ticker, fy, lang, row_number() OVER (PARTITION BY ticker, fy, lang ORDER BY doc_id, i)) AS chunk_id FROM k""",
    "html_text": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '<x>', 'gs'), '<script[^>]*>.*?</script>', '<x>', 'gis'), '<style[^>]*>.*?</style>', '<x>', 'gis'), '<noscript[^>]*>.*?</noscript>', '<x>', 'gis') AS h FROM pages),
      e AS (SELECT page_id, list_transform(string_split_regex(h, '</?[A-Za-z!][^>]*>'), lambda x: replace(replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&')) AS parts FROM p),
      t AS (SELECT page_id, array_to_string(list_filter(list_transform(parts, lambda x: trim(x, chr(160) || ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> ''), chr(10)) AS text FROM e)
      SELECT page_id, CAST(len(text) AS BIGINT) AS n_chars, md5(text) AS digest FROM t""",
    "best_annual_fact": f"""WITH {FACTS} SELECT entity, metric, fiscal_year, value, pos AS accession FROM (SELECT *, row_number() OVER (PARTITION BY entity, metric, fiscal_year ORDER BY fp = 'FY' DESC, filed DESC, pos) AS k FROM facts WHERE form IN ('10-K', '10-K/A')) WHERE k = 1""",
    "filing_select_tier": f"""WITH {FACTS}, f AS (SELECT entity AS cik, form, CAST(filed AS DATE) AS fd, CAST(filed AS DATE) - 90 AS rd, CASE WHEN pos % 4 = 0 THEN fiscal_year END AS fy, pos FROM facts WHERE form IN ('10-K', '10-K/A')),
      w AS (SELECT DISTINCT entity AS cik, fiscal_year FROM facts),
      j AS (SELECT *, CASE WHEN fy = fiscal_year THEN 4 WHEN year(rd) = fiscal_year THEN 3 WHEN year(fd) = fiscal_year THEN 2 WHEN year(fd) = fiscal_year + 1 THEN 1 ELSE 0 END AS tier FROM w JOIN f USING (cik))
      SELECT cik, fiscal_year, pos AS accession, tier, CAST(fd AS VARCHAR) AS filing_date FROM (SELECT *, row_number() OVER (PARTITION BY cik, fiscal_year ORDER BY tier DESC, fd DESC, pos) AS k FROM j WHERE tier > 0) WHERE k = 1""",
    "fact_store": f"""WITH {FACTS} SELECT entity, metric, fiscal_year, value, confidence, fact_source, pos AS fact_id FROM (SELECT *, row_number() OVER (PARTITION BY entity, metric, fiscal_year
      ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, CASE fact_source WHEN 'xbrl' THEN 2 ELSE 1 END DESC, NOT review_required DESC, pos) AS k FROM facts) WHERE k = 1""",
    "fact_store_by_id": f"WITH {FACTS} SELECT fact_id, metric, value, pos FROM (SELECT concat_ws('_', entity, fiscal_year, confidence) AS fact_id, metric, value, pos, row_number() OVER (PARTITION BY entity, fiscal_year, confidence ORDER BY pos DESC) AS k FROM facts) WHERE k = 1",
    "priority_coalesce": f"""WITH {TOTALS}, part AS (SELECT * FROM totals WHERE len(entity) % 2 = fiscal_year % 2 AND NOT (metric = '1-URGENT' AND fiscal_year % 3 = 0)),
      p AS (SELECT * FROM {values([("urgent_first", "1-URGENT", 1), ("urgent_first", "2-HIGH", 2), ("low_first", "5-LOW", 1), ("low_first", "3-MEDIUM", 2)], "name, concept, priority")})
      SELECT entity, fiscal_year, name AS metric, concept, value FROM (SELECT *, row_number() OVER (PARTITION BY entity, fiscal_year, name ORDER BY priority) AS k FROM part JOIN p ON p.concept = part.metric) WHERE k = 1""",
    "metric_pair_change": f"WITH {PAIRS} SELECT entity, metric, o AS old_value, n AS new_value, round(n - o, 2) AS absolute_change, round((n - o) / nullif(o, 0) * 100, 4) AS percentage_change, {DIRECTION} AS direction FROM pairs",
    "verify_claims": f"""WITH {PAIRS}, c AS (SELECT *, CASE WHEN len(entity) = 6 THEN NULL ELSE n END AS m FROM pairs)
      SELECT 'claim_' || entity || '_' || metric || '_{views.OLD_YEAR}_{views.NEW_YEAR}' AS claim_id,
        CASE WHEN m IS NULL THEN 'not_enough_data' WHEN len(entity) % 5 = 0 THEN 'low_confidence' WHEN len(entity) % 4 = 0 THEN 'inconsistent' WHEN metric = '5-LOW' THEN 'unsupported' WHEN metric = '2-HIGH' AND abs(1.0 - (m - o)) > 1e-6 THEN 'unsupported' ELSE 'verified' END AS status,
        round(m - o, 2) AS absolute_change, round(round((m - o) / nullif(o, 0) * 100, 6), 4) AS percentage_change, CASE WHEN m > o THEN 'increase' WHEN m < o THEN 'decrease' WHEN m = o THEN 'no_change' END AS direction FROM c""",
    "change_register": f"WITH {REGISTER} SELECT * FROM register",
    "credit_signal_mix": f"""WITH {REGISTER}, m AS (SELECT entity, count(*) FILTER (WHERE signal = 'adverse') AS adverse, count(*) FILTER (WHERE signal = 'favorable') AS favorable, count(*) FILTER (WHERE signal = 'mixed') AS mixed FROM register GROUP BY 1)
      SELECT *, CASE WHEN adverse > favorable THEN 'weaker' WHEN favorable > adverse THEN 'stronger' ELSE 'balanced' END AS overall FROM m""",
    "brief_report": f"""WITH {REGISTER} SELECT entity, '# Change register' || chr(10) || chr(10) || '| metric | old | new | change | percent | direction | signal |' || chr(10) || '|---|---|---|---|---|---|---|' || chr(10)
      || string_agg('| ' || metric || ' | ' || format('{{:,.2f}}', old_value) || ' | ' || format('{{:,.2f}}', new_value) || ' | ' || format('{{:,.2f}}', absolute_change) || ' | ' || coalesce(format('{{:,.2f}}', percent_change) || '%', 'n/a') || ' | ' || direction || ' | ' || signal || ' |', chr(10) ORDER BY metric) AS brief FROM register GROUP BY 1""",
    "cross_check_band": f"""WITH {TOTALS}, s AS (SELECT entity, fiscal_year, round(sum(value), 2) AS statement FROM totals GROUP BY ALL), f AS (SELECT entity, fiscal_year, round(sum(value) + len(any_value(entity)) / 10, 2) AS filed FROM facts WHERE fiscal_year <> 1998 GROUP BY ALL)
      SELECT entity, fiscal_year, statement, CASE WHEN filed IS NULL THEN 'missing_cross_check' WHEN abs(statement - filed) <= 1.0 THEN 'match' ELSE 'mismatch' END AS status FROM s LEFT JOIN f USING (entity, fiscal_year)""",
    "calculated_metric": """WITH s0 AS (SELECT l_suppkey AS entity, year(l_shipdate) AS fiscal_year, round(sum(l_extendedprice), 2) AS ocf, round(-sum(l_extendedprice * l_discount), 2) AS capex, round(sum(l_quantity), 2) AS cur, round(sum(l_tax), 2) AS lt0 FROM lineitem GROUP BY ALL), s AS (SELECT *, CASE WHEN entity % 3 <> 0 THEN lt0 END AS lt FROM s0),
      u AS (SELECT entity, fiscal_year, 'operating_cash_flow' AS metric, ocf AS value, 'direct' AS source FROM s UNION ALL SELECT entity, fiscal_year, 'capital_expenditures', capex, 'direct' FROM s UNION ALL SELECT entity, fiscal_year, 'current_debt', cur, 'direct' FROM s UNION ALL SELECT entity, fiscal_year, 'long_term_debt', lt, 'direct' FROM s
        UNION ALL SELECT entity, fiscal_year, 'free_cash_flow', ocf - abs(capex), 'calculated' FROM s UNION ALL SELECT entity, fiscal_year, 'total_debt', cur + lt, 'calculated' FROM s)
      SELECT entity, fiscal_year, metric, round(value, 2) AS value, source FROM u WHERE value IS NOT NULL""",
    "coverage_partial_missing": f"""WITH {TOTALS}, part AS (SELECT * FROM totals WHERE NOT (metric = '2-HIGH' AND fiscal_year >= 1998) AND metric <> '5-LOW'),
      asked AS (SELECT DISTINCT entity, m AS metric FROM part, (SELECT unnest(['1-URGENT', '2-HIGH', '5-LOW']) AS m)),
      f AS (SELECT entity, metric, list_sort(list_distinct(list(fiscal_year))) AS y FROM part WHERE fiscal_year IN (1996, 1997, 1998, 1999) GROUP BY ALL),
      j AS (SELECT entity, metric, coalesce(y, []) AS y, list_filter([1996, 1997, 1998, 1999], lambda x: NOT list_contains(coalesce(y, []), x)) AS m FROM asked LEFT JOIN f USING (entity, metric))
      SELECT entity, metric, array_to_string(y, ',') AS covered, array_to_string(m, ',') AS missing, CASE WHEN len(m) = 0 THEN 'covered' WHEN len(y) > 0 THEN 'partially_covered' ELSE 'not_covered' END AS diagnosis FROM j""",
    "concept_search": "SELECT p_name AS concept, count(*) AS n FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue') GROUP BY 1",
    "concept_discovery": f"""WITH {FACTS}, b AS (SELECT DISTINCT entity AS cik, metric AS concept, fiscal_year FROM facts WHERE form IN ('10-K', '10-K/A') AND fiscal_year IN (1996, 1997, 1998) AND {any_of("lower(metric)", ["urgent", "low", "medium"])}),
      g AS (SELECT cik, concept, count(*) AS n_years, array_to_string(list_sort(list(fiscal_year)), ',') AS covered FROM b GROUP BY ALL) SELECT cik, row_number() OVER (PARTITION BY cik ORDER BY n_years DESC, concept) AS rank, concept, n_years, covered, false AS has_zero FROM g""",
    "resolver_classify": f"WITH {resolver()} SELECT cik, metric, concept, class, accepted, confidence FROM cand",
    "resolver_decision": f"""WITH {resolver()}, b AS (SELECT *, accepted AND confidence = max(CASE WHEN accepted THEN confidence END) OVER (PARTITION BY cik, metric) AS best FROM cand),
      g AS (SELECT cik, metric, count(*) FILTER (WHERE accepted) AS n_accepted, count(*) FILTER (WHERE NOT accepted) AS n_rejected, count(*) FILTER (WHERE best) AS n_best, min(concept) FILTER (WHERE best) AS c, arg_min(value, concept) FILTER (WHERE best) AS v FROM b GROUP BY ALL),
      s AS (SELECT *, CASE WHEN n_accepted = 0 THEN 'unresolved' WHEN n_accepted = 1 OR n_best = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM g)
      SELECT cik, metric, status, CASE WHEN n_accepted = 0 THEN 'no_safe_candidate' WHEN n_accepted = 1 THEN 'safe_alternate' WHEN n_best = 1 THEN 'highest_confidence_alternate' ELSE 'multiple_safe_candidates' END AS basis, CASE WHEN status = 'resolved' THEN c END AS concept, CASE WHEN status = 'resolved' THEN v END AS value, n_accepted, n_rejected FROM s""",
    "evidence_coverage": f"WITH {CHUNKS}, {EVIDENCE} SELECT query_id, array_to_string(missing, '; ') AS missing, CASE WHEN len(missing) = 0 THEN 'sufficient' ELSE 'rewrite_query' END AS decision, n_debt, n_numeric FROM cover",
    "query_rewrite": f"""WITH {CHUNKS}, {EVIDENCE}, m AS (SELECT query_id, array_to_string(missing, '; ') AS said FROM cover WHERE len(missing) > 0)
      SELECT query_id, concat_ws(' ', 'Issuer', '2023 2025', CASE WHEN contains(said, 'debt') THEN 'debt maturities long-term debt payable within one year' END, CASE WHEN contains(said, 'liquidity') THEN 'liquidity capital resources cash marketable securities committed credit' END, CASE WHEN contains(said, 'management') THEN 'management discussion primarily due to we expect' END, CASE WHEN contains(said, 'numeric') THEN 'total amount billion million' END) AS query, 'Missing: ' || said AS reason FROM m""",
    "guardrail_scan": f"WITH {SCAN} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(ordinal AS BIGINT) AS ordinal, number, CAST(begins AS BIGINT) AS start, CAST(begins + len(number) AS BIGINT) AS \"end\", tags, bound FROM scan",
    "guardrail_report": f"WITH {SCAN}, g AS (SELECT doc_id, count(*) AS checked, count(*) FILTER (WHERE NOT bound) AS blocked FROM scan GROUP BY 1) SELECT *, CASE WHEN blocked > 0 THEN 'block' ELSE 'pass' END AS severity FROM g",
    "guardrail_strip": f"""WITH {SCAN}, b AS (SELECT DISTINCT doc_id, line FROM scan WHERE NOT bound), k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS kept, count(*) AS n FROM ln WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = ln.doc_id AND b.line = ln.line) GROUP BY 1),
      o AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM b) THEN coalesce(kept, '') || chr(10) || chr(10) || 'Numeric guardrail note: unverified financial-number lines were removed before finalization.' ELSE text END AS text FROM rendered LEFT JOIN k USING (doc_id))
      SELECT doc_id, md5(text) AS digest, CAST(len(text) AS BIGINT) AS n_chars FROM o""",
    "stage_guard": f"""WITH {RENDERED}, ln AS (SELECT doc_id, i AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM rendered))),
      v AS (SELECT CAST(floor(o_orderkey / 10) AS BIGINT) AS doc_id, unnest([format('{{:.0f}}', x), format('{{:.1f}}', x), format('{{:.2f}}', x), CAST(x AS VARCHAR)]) AS number FROM (SELECT o_orderkey, floor(CAST(round(o_totalprice * 100) AS BIGINT) / 1000) / 100 AS x FROM orders WHERE o_orderkey % 2 = 0)),
      ok AS (SELECT DISTINCT doc_id, number FROM v UNION SELECT DISTINCT doc_id, '12.5' FROM v),
      n AS (SELECT doc_id, line_no, line, replace(trim(number, '$%'), ',', '') AS number FROM (SELECT doc_id, line_no, line, regexp_replace(unnest(regexp_extract_all(line, '(?:^|[^A-Za-z])([-+]?\\$?[0-9][0-9,]*(?:\\.[0-9]+)?%?)', 1)), '^[+]', '+') AS number FROM ln)),
      bad AS (SELECT DISTINCT doc_id, line_no FROM n WHERE NOT (coalesce(try_cast(number AS DOUBLE) = floor(try_cast(number AS DOUBLE)) AND try_cast(number AS DOUBLE) BETWEEN 1900 AND 2100, false)) AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.doc_id = n.doc_id AND ok.number = n.number)),
      g AS (SELECT ln.doc_id, count(*) FILTER (WHERE bad.line_no IS NOT NULL) AS blocked_lines, coalesce(string_agg(line, chr(10) ORDER BY ln.line_no) FILTER (WHERE bad.line_no IS NULL), '') AS text FROM ln LEFT JOIN bad ON bad.doc_id = ln.doc_id AND bad.line_no = ln.line_no GROUP BY 1)
      SELECT doc_id, CASE WHEN blocked_lines > 0 THEN 'repaired' ELSE 'pass' END AS status, blocked_lines, CAST(len(text) AS BIGINT) AS n_chars FROM g""",
    "evaluation_summary": """WITH j AS (SELECT quality = 1 AS v, toxic = 0 AS c FROM labels JOIN documents USING (doc_id)) SELECT count(*) AS n, count(*) FILTER (WHERE v) AS n_verified, count(*) FILTER (WHERE c) AS n_cited, round(count(*) FILTER (WHERE v) / count(*), 4) AS verified_ratio, round(count(*) FILTER (WHERE c) / count(*), 4) AS cited_ratio FROM j""",
    "source_mix": "SELECT string_agg(source || ': ' || n, ', ' ORDER BY source) AS sources FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)",
    "years_complete": f"WITH {TOTALS} SELECT entity, metric, count(DISTINCT fiscal_year) FILTER (WHERE fiscal_year IN (1996, 1998)) = 2 AS complete FROM totals WHERE NOT (metric = '2-HIGH' AND fiscal_year = 1998 AND len(entity) % 2 = 0) GROUP BY ALL",
    "chunk_summary": f"WITH {CHUNKS} SELECT section_type, section_name, fiscal_year, '10-K' AS filing_type, count(*) AS n_chunks, CAST(sum(len(text)) AS BIGINT) AS n_chars FROM chunks GROUP BY ALL",
    "task_cross": "SELECT concat_ws('_', n_name, lower(r_name), 2023, 2025) AS task_id, 'How did ' || n_name || '''s ' || lower(r_name) || ' change from 2023 to 2025?' AS question FROM nation, region",
    "memory_upsert": """SELECT CAST(conv_id % 40 AS VARCHAR) AS company, role AS risk_theme, array_to_string(list_sort(list_distinct(list(substring(text, 1, 12)))), '|') AS useful_sections, array_to_string(list_sort(list_distinct(list(substring(text, 1, 5)))), '|') AS successful_queries, max(lpad(CAST(conv_id AS VARCHAR), 9, '0')) AS last_updated FROM conversations GROUP BY 1, 2""",
    "trace_rollup": """SELECT user_id AS run, count(*) AS n_steps, count(*) FILTER (WHERE value > 90) AS n_failed, arg_min(event_type, (ts, event_id)) AS first_state, arg_max(event_type, (ts, event_id)) AS last_state, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS states FROM events GROUP BY 1""",
    "trace_runs": """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS run, event_id AS pos, event_type, ts, value > 95 AS failed FROM events)
      SELECT run, count(*) AS n_steps, count(*) FILTER (WHERE failed) AS n_failed, CASE WHEN bool_or(failed) THEN 'failed' WHEN CAST(run AS BIGINT) % 3 <> 0 THEN 'completed' ELSE 'open' END AS status,
        CASE WHEN CAST(run AS BIGINT) % 3 <> 0 THEN CAST(count(*) FILTER (WHERE event_type = 'click') AS INT) END AS loop_iterations, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM s GROUP BY run""",
    "critic_anti_join": """WITH c AS (SELECT conv_id || '_' || turn AS claim_id, CASE turn % 3 WHEN 0 THEN [conv_id % 60, conv_id % 7] WHEN 1 THEN [] END AS cited FROM conversations)
      SELECT claim_id, 'no_citation' AS problem FROM c WHERE cited IS NULL OR len(cited) = 0 UNION ALL SELECT DISTINCT claim_id, 'unknown_citation' FROM (SELECT claim_id, unnest(cited) AS id FROM c) WHERE id NOT IN (SELECT item_id FROM benchmark)""",
    "critic_repair": """WITH c AS (SELECT conv_id || '_' || turn AS claim_id, CASE turn % 3 WHEN 0 THEN [conv_id % 60, conv_id % 7] WHEN 1 THEN [] END AS cited FROM conversations), ids AS (SELECT list(item_id) AS ids FROM benchmark)
      SELECT claim_id, count(*) AS n FROM c, ids WHERE len(cited) > 0 GROUP BY 1 HAVING bool_and(len(list_filter(cited, lambda x: NOT list_contains(ids, x))) = 0)""",
    "entity_resolve": f"""WITH d AS (SELECT substring(n_name, 1, 3) AS ticker, lower(n_name) || ' holding' AS title, n_nationkey AS pos FROM nation),
      q AS (SELECT query_id, upper(trim(query)) AS t, array_to_string(list_filter(string_split(trim(regexp_replace(lower(replace(query, '&', ' and ')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ({", ".join(f"'{w}'" for w in rules.LEGAL_SUFFIXES)}) AND w <> ''), ' ') AS name FROM {values(list(enumerate(fixtures.COMPANY_QUERIES)), "query_id, query")}),
      m AS (SELECT query_id, name, (SELECT arg_min(ticker, pos) FROM d WHERE upper(ticker) = t) AS t1, (SELECT count(*) FROM d WHERE title = name) AS n2, (SELECT min(ticker) FROM d WHERE title = name) AS t2, (SELECT count(*) FROM d WHERE name <> '' AND starts_with(title, name)) AS n3, (SELECT min(ticker) FROM d WHERE starts_with(title, name)) AS t3,
        (SELECT count(*) FROM d WHERE name <> '' AND contains(title, name)) AS n4, (SELECT min(ticker) FROM d WHERE contains(title, name)) AS t4 FROM q),
      s AS (SELECT *, CASE WHEN t1 IS NOT NULL THEN 'ticker' WHEN n2 = 1 THEN 'title' WHEN n3 >= 1 THEN 'prefix' WHEN n4 >= 1 THEN 'part' END AS step FROM m),
      r AS (SELECT *, CASE WHEN step IS NULL THEN 'not_found' WHEN (step = 'prefix' AND n3 > 1) OR (step = 'part' AND n4 > 1) THEN 'ambiguous' ELSE 'resolved' END AS status FROM s)
      SELECT query_id, status, CASE WHEN status = 'resolved' THEN CASE step WHEN 'ticker' THEN t1 WHEN 'title' THEN t2 WHEN 'prefix' THEN t3 ELSE t4 END END AS ticker, step FROM r""",
    "analyst_notes": f"""WITH {REGISTER}, a AS (SELECT entity, metric, absolute_change AS c, replace(metric, '_', ' ') AS name, signal, CASE {" ".join(f"WHEN contains(metric, '{w}') THEN CASE WHEN absolute_change > 0 THEN '{u}' ELSE '{d}' END" for w, u, d in reports.NOTES)} END AS m, percent_change AS p FROM register),
      n AS (SELECT entity, metric, name || CASE WHEN c > 0 THEN ' rose' WHEN c < 0 THEN ' fell' ELSE ' did not change' END || CASE WHEN c <> 0 AND p IS NOT NULL THEN ' by ' || format('{{:,.2f}}', abs(p)) || '%' ELSE '' END || CASE WHEN c <> 0 AND m IS NOT NULL THEN ': ' || m ELSE '' END || '.' AS note FROM a),
      i AS (SELECT entity, coalesce(string_agg(CASE signal WHEN 'adverse' THEN 'Find what drove ' || name || ' and whether it lasts.' WHEN 'favorable' THEN 'Confirm that ' || name || ' is not a matter of timing.' END, ' ' ORDER BY metric) || ' ', '') || '{reports.THEME_ITEMS["debt_liquidity"].replace("'", "''")}' AS items FROM a GROUP BY 1)
      SELECT entity, metric, note, items FROM n JOIN i USING (entity)""",
    "compact_evidence": r"""SELECT query_id, pos, chunk_id, substring(trim(regexp_replace(text, '[\t\n\f\r\x0B ]+', ' ', 'g')), 1, 60) AS preview FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS k FROM (SELECT conv_id % 30 AS query_id, conv_id * 1000 + turn AS pos, conv_id || '_' || turn AS chunk_id, text FROM conversations)) WHERE k <= 8""",
    "parsed_tasks": """WITH m AS (SELECT doc_id AS query_id, list_filter([CASE WHEN NOT contains(lower(text), 'license') THEN 'license' END, CASE WHEN NOT contains(lower(text), 'the') THEN 'the' END, CASE WHEN NOT contains(lower(text), 'und') THEN 'und' END], lambda x: x IS NOT NULL) AS missing FROM documents)
      SELECT query_id, array_to_string(missing, ',') AS missing, len(missing) = 0 AS accepted FROM m""",
    "tool_calls": "SELECT user_id AS run, count(*) AS n_calls, string_agg(event_type, ',' ORDER BY event_id) AS names, bool_or(contains(event_type, 'retrieve')) AS used_retrieval FROM events WHERE event_type <> 'click' GROUP BY 1",
    "metric_analysis": """WITH r AS (
        SELECT l_suppkey AS entity, year(l_shipdate) AS fiscal_year, round(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'N'), 2) AS s_ocf, -floor((sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) FILTER (WHERE l_linestatus = 'F') + 50) / 100) / 100 AS s_capex,
          round(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 2) AS s_cur, round(sum(l_quantity) FILTER (WHERE l_linenumber = 1), 2) AS s_long, round(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'N') + any_value(l_suppkey) % 3, 2) AS f_ocf,
          round(sum(l_quantity) FILTER (WHERE l_linenumber = 2), 2) AS f_cur, round(sum(l_quantity) FILTER (WHERE l_linenumber = 3), 2) AS f_int, -floor((sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) + 50) / 100) / 100 AS f_capex FROM lineitem GROUP BY ALL),
      p AS (SELECT entity, fiscal_year, unnest([{'metric': 'operating_cash_flow', 's': s_ocf, 'f': f_ocf}, {'metric': 'capital_expenditures', 's': s_capex, 'f': f_capex}, {'metric': 'current_debt', 's': s_cur, 'f': f_cur}, {'metric': 'long_term_debt', 's': s_long, 'f': NULL}, {'metric': 'interest_expense', 's': NULL, 'f': f_int}], recursive := true) FROM r),
      direct AS (SELECT entity, fiscal_year, metric, CAST(coalesce(s, f) AS DOUBLE) AS value, CASE WHEN s IS NOT NULL THEN 'statement:' || metric ELSE 'f_' || metric END AS concept, CASE WHEN s IS NOT NULL THEN 'statement' ELSE 'companyfacts' END AS source,
          CASE WHEN s IS NULL THEN 'resolved' WHEN f IS NULL THEN 'verified_statement' WHEN abs(s - f) <= 1.0 THEN 'verified_cross_checked' ELSE 'cross_check_mismatch' END AS status,
          CASE WHEN s IS NULL THEN NULL WHEN f IS NULL THEN 'not_found' WHEN abs(s - f) <= 1.0 THEN 'matched' ELSE 'mismatch' END AS cross_check, CAST(s - f AS DOUBLE) AS difference, coalesce(abs(s - f) > 1.0, false) AS requires_review FROM p WHERE coalesce(s, f) IS NOT NULL),
      v AS (SELECT entity, fiscal_year, max(value) FILTER (WHERE metric = 'operating_cash_flow') - abs(max(value) FILTER (WHERE metric = 'capital_expenditures')) AS free_cash_flow, max(value) FILTER (WHERE metric = 'current_debt') + max(value) FILTER (WHERE metric = 'long_term_debt') AS total_debt FROM direct GROUP BY ALL),
      made AS (SELECT entity, fiscal_year, unnest([{'metric': 'free_cash_flow', 'value': free_cash_flow}, {'metric': 'total_debt', 'value': total_debt}], recursive := true) FROM v)
      SELECT entity, fiscal_year, metric, round(value, 2) AS value, concept, source, status, cross_check, round(difference, 2) AS difference, requires_review FROM direct
      UNION ALL SELECT entity, fiscal_year, metric, round(value, 2), NULL, CASE WHEN value IS NOT NULL THEN 'deterministic_calculation' END, CASE WHEN value IS NULL THEN 'calculated_metric' ELSE 'calculated_from_verified_inputs' END, NULL, NULL, false FROM made""",
    "coverage_diagnostics": f"""WITH {FACTS}, m AS (SELECT unnest(['urgent_total', 'high_specified', 'medium_total', 'nothing_here']) AS metric),
      asked AS (SELECT cik, m.metric FROM (SELECT DISTINCT entity AS cik FROM facts), m),
      got AS (SELECT entity AS cik, CASE metric WHEN '1-URGENT' THEN 'urgent_total' ELSE 'high_specified' END AS metric, list_sort(list(DISTINCT fiscal_year)) AS y FROM facts WHERE metric IN ('1-URGENT', '2-HIGH') AND fiscal_year IN (1996, 1997, 2001) GROUP BY 1, 2),
      concepts AS (SELECT cik, concept, count(*) AS n FROM (SELECT DISTINCT entity AS cik, metric AS concept, fiscal_year FROM facts WHERE fiscal_year IN (1996, 1997, 2001) AND form IN ('10-K', '10-K/A')) GROUP BY 1, 2),
      near AS (SELECT cik, CASE concept WHEN '3-MEDIUM' THEN 'medium_total' ELSE 'high_specified' END AS metric, concept FROM concepts WHERE concept IN ('3-MEDIUM', '4-NOT SPECIFIED')),
      j AS (SELECT asked.cik, asked.metric, coalesce(y, []) AS y, coalesce(near.concept, '') AS related FROM asked LEFT JOIN got ON got.cik = asked.cik AND got.metric = asked.metric LEFT JOIN near ON near.cik = asked.cik AND near.metric = asked.metric)
      SELECT cik, metric, array_to_string(y, ',') AS covered, array_to_string(list_filter([1996, 1997, 2001], lambda x: NOT list_contains(y, x)), ',') AS missing, related, CAST(0 AS BIGINT) AS n_zero,
        CASE WHEN related <> '' AND len(y) > 0 THEN 'partial_with_related_concepts' WHEN related <> '' THEN 'uncovered_with_related_concepts' WHEN len(y) > 0 THEN 'partial' ELSE 'uncovered' END AS diagnosis FROM j WHERE len(y) < 3""",
    "verified_by_metric": f"WITH {FACTS} SELECT entity, metric, max_by(value, pos) AS value FROM facts WHERE confidence = 'high' GROUP BY ALL",
    "unverified_mentions": """SELECT doc_id AS answer_id, metric FROM documents, (SELECT unnest(['mit_license', 'of_the', 'que_la', 'und_die']) AS metric)
      WHERE (doc_id + length(metric)) % 2 <> 0 AND contains(lower(text), replace(metric, '_', ' '))""",
    "over_fetch": FUSED + """SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS place, fused_rank AS rank, chunk_id FROM fused JOIN chunks USING (chunk_id) WHERE fused_rank <= 12 AND fiscal_year = 2025) WHERE place <= 4""",
    "supported_ticker": "SELECT n_nationkey, lower(n_name[1:1]) AS ticker, n_name[1:1] = 'I' AS accepted FROM nation",
    "last_namespace": f"WITH {FACTS}, i AS (SELECT entity AS cik, metric AS concept, confidence AS namespace, round(sum(value), 2) AS value FROM facts GROUP BY ALL) SELECT cik, concept, max(namespace) AS namespace, max_by(value, namespace) AS value FROM i GROUP BY ALL",
    "unambiguous_facts": f"WITH {FACTS} SELECT entity, metric, CAST(CAST(filed AS DATE) AS VARCHAR) AS filed, min_by(value, pos) AS value, max(value) - min(value) < 1e-9 AS agrees FROM facts GROUP BY ALL",
    "statement_rejects": f"""SELECT p_partkey, metric, CASE metric WHEN 'capital_expenditures' THEN CASE WHEN contains(l, 'property plant and equipment net') OR contains(l, 'property and equipment net') THEN 'balance_not_flow' WHEN contains(l, 'not yet paid') OR contains(l, 'incurred') THEN 'not_yet_paid' WHEN contains(l, 'lease') THEN 'lease' WHEN contains(l, 'additional paid in capital') THEN 'equity' END
        ELSE CASE WHEN contains(l, 'lease interest') THEN 'lease_only' WHEN contains(l, 'interest paid') OR contains(l, 'cash paid') THEN 'cash_paid' END END AS reason
      FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'capital_expenditures' ELSE 'interest_expense' END AS metric, ({[*fixtures.REJECT_LABELS]!r})[p_partkey % {len(fixtures.REJECT_LABELS)} + 1] AS l FROM part)""",
}
