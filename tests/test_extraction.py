"""Extraction, projections, the research loop, embeddings and workspaces on small inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.embedding import embedded
from tallyspark.operators import extraction, projections, research
from tallyspark.sources.workspace import Workspace


def test_narrative_facts_use_the_chunks_year(spark):
    text = "At December 31, 2025, we had Company cash of $ 28.7 billion and liquidity of $46.4 billion."
    chunks = spark.createDataFrame([("F", "c1", 2025, "liquidity", text), ("F", "c2", 2023, "liquidity", text), ("F", "c3", 2025, "credit_facilities", "At December 31, 2025, Ford Credit’s committed capacity totaled $ 40.1 billion overall.")], "company string, chunk_id string, fiscal_year int, section_type string, text string")
    found = {(r.chunk_id, r.metric): r.value for r in extraction.narrative_facts(chunks).collect()}
    assert found == {("c1", "company_cash"): 28.7, ("c1", "company_liquidity"): 46.4, ("c3", "ford_credit_committed_capacity"): 40.1}
    assert {r.fact_id for r in extraction.narrative_facts(chunks).collect()} >= {"f_2025_company_cash_text_high"}


def test_flattened_tables_need_review(spark):
    chunks = spark.createDataFrame([("F", "c", 2025, "mda", "Balance Sheets ($B) Company Cash $ 28.8 $ 28.7 Liquidity 46.4 46.5 rest")], "company string, chunk_id string, fiscal_year int, section_type string, text string")
    rows = extraction.narrative_facts(chunks).collect()
    assert {(r.metric, r.value, r.confidence, r.review_required) for r in rows} == {("company_cash", 28.7, "low", True), ("company_liquidity", 46.5, "low", True)}


def test_tagged_debt_takes_the_first_concept(spark):
    keyed = spark.createDataFrame([(1, "LongTermDebtCurrentOperatingSegmentsCompanyExcludingFordCredit", 2025, 2e9), (1, "LongTermDebtCurrentCompanyExcludingFordCredit", 2025, 1.5e9)], "doc_id long, key string, year int, value double")
    chunks = spark.createDataFrame([("a", 2025, "debt", "other"), ("b", 2025, "debt", "Total debt payable within one year")], "chunk_id string, fiscal_year int, section_type string, text string")
    r = extraction.tagged_debt_facts(keyed, chunks).first()
    assert (r.metric, r.value, r.chunk_id) == ("company_debt_payable_within_one_year", 1.5, "b")


def test_excerpt_starts_before_the_term(spark):
    text = "x" * 300 + " debt payable " + "y" * 600
    r = spark.createDataFrame([(text,)], "t string").select(extraction.excerpt(F.col("t"), ["debt payable"])).first()[0]
    assert len(r) == 420 and r.index("debt payable") == 120


def test_projections(spark):
    tasks = projections.parsed_tasks(spark.createDataFrame([(1, "How did debt and liquidity change from 2023 to 2025?"), (2, "Debt?")], "query_id long, question string"))
    assert {r.query_id: (r.accepted, r.missing) for r in tasks.collect()} == {1: (True, []), 2: (False, ["liquidity", "2023", "2025", "change"])}
    evidence = spark.createDataFrame([(1, i, f"c{i}", "a  b\n" * 400) for i in range(10)], "query_id long, pos int, chunk_id string, text string")
    rows = projections.compact_evidence(evidence).collect()
    assert len(rows) == 8 and all(len(r.preview) == 700 for r in rows)
    events = spark.createDataFrame([(1, 0, "tool_call", "hybrid_retrieve"), (1, 1, "text", None), (1, 2, "tool_call", "query_memory")], "run long, pos int, kind string, name string")
    assert projections.tool_calls(events).first().names == "hybrid_retrieve,query_memory"
    picked = projections.selectors(spark.createDataFrame([("m", ["A", "B"]), ("n", [])], "metric string, concepts array<string>"))
    assert [(r.priority, r.concept) for r in picked.orderBy("priority").collect()] == [(0, "A"), (1, "B")]


def test_research_stops_when_evidence_suffices(spark):
    prose = "We expect our liquidity to hold, primarily due to the cash equivalents that we keep at hand. The company believes that it manages its capital resources in line with what it needs for the time to come. "
    rows = [(f"d{y}", y, "debt", "Debt", f"long-term debt and debt maturities of $5 billion in {y}") for y in (2023, 2025)]
    rows += [(f"m{y}", y, "mda", "MDA", prose + f"liquidity {y} $1 billion debt") for y in (2023, 2025)]
    chunks = spark.createDataFrame(rows, "chunk_id string, fiscal_year int, section_type string, section_name string, text string")
    found, covered = research.research(chunks, "debt liquidity", "Issuer", [2023, 2025])
    assert found.count() == 4 and covered.first().decision == "sufficient"
    _, short = research.research(chunks.filter("fiscal_year = 2023"), "debt", "Issuer", [2023, 2025], 2)
    assert short.first().decision == "stop_incomplete"
    assert research.retrieval_sizes(1, True) == (8, 3) and research.retrieval_sizes(2, True) == (40, 12)


def test_research_keeps_the_evidence_of_a_pass(spark):
    prose = "We expect our liquidity to hold, primarily due to the cash equivalents that we keep at hand. The company believes that it manages its capital resources in line with what it needs for the time to come. "
    rows = [(f"d{y}", y, "debt", "Debt", f"long-term debt and debt maturities of $5 billion in {y}") for y in (2023, 2025)]
    rows += [(f"m{y}", y, "mda", "MDA", prose + f"liquidity {y} $1 billion debt") for y in (2023, 2025)]
    chunks = spark.createDataFrame(rows, "chunk_id string, fiscal_year int, section_type string, section_name string, text string")
    found, _ = research.research(chunks.filter("fiscal_year = 2023"), "debt", "Issuer", [2023, 2025], 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0 and "regexp_extract_all" not in plan and "Join" not in plan


def test_embeddings_are_unit_and_alike_for_alike_texts(spark):
    rows = spark.createDataFrame([("cash and debt",), ("debt and cash",), ("",)], "t string").select(embedded(F.col("t"), 16)).collect()
    assert rows[0][0] == rows[1][0] and sum(x * x for x in rows[0][0]) == pytest.approx(1) and set(rows[2][0]) == {0.0}


def test_workspace(spark, tmp_path):
    w = Workspace(str(tmp_path), "run1")
    w.write_document(spark, "task", "# Task\ntext")
    w.write_document(spark, "plan", {"b": 1, "a": [2]})
    w.write_table("numeric_facts", spark.range(2))
    assert w.read_document(spark, "task") == "# Task\ntext" and '"a"' in w.read_document(spark, "plan")
    assert spark.read.json(w.path("numeric_facts")).count() == 2
    with pytest.raises(KeyError):
        w.path("none")


def test_citations_packages_years_and_conclusions(spark):
    from tallyspark.operators import facts, reports

    r = spark.createDataFrame([(1, 1, ["b", "a"]), (1, 0, ["c", "b"])], "k long, pos int, citations array<string>")
    assert reports.citations(r, ["k"]).first().citations == "c; b; a"
    items = spark.createDataFrame([("F", "own", 2024, 2024, 1), ("F", "next", 2025, 2024, 1), ("F", "next", 2025, 2023, 2), ("F", "next", 2025, 2025, 3), ("F", "late", 2026, 2022, 4)], "ticker string, accession string, package_year int, fiscal_year int, pos int")
    assert sorted((x.fiscal_year, x.accession) for x in facts.first_package_rows(items).collect()) == [(2024, "own"), (2025, "next")]
    years = spark.createDataFrame([([2025, 2024, 2023],), ([2025],), ([],)], "y array<int>").select(facts.default_years(F.col("y"))).collect()
    assert [x[0] for x in years] == [[2024, 2023], [2025], []]
    m = spark.createDataFrame([(1, "verified"), (1, "missing"), (2, "missing")], "k long, status string")
    assert {x.k: x.n_verified for x in reports.conclusions(m, ["k"], "t").collect()} == {1: 1, 2: 0}
