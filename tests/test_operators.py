"""Operators on small inputs with known results."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.functions.tools import Registry, Tool, guarded
from tallyspark.operators import entities, evidence, facts, guardrail, ingestion, reports, resolution, retrieval, verification
from tallyspark.sources import readers


def test_bm25_prefers_the_chunk_with_the_terms_and_counts_repeats(spark):
    chunks = spark.createDataFrame([("a", "", "", "undrawn liquidity and credit lines"), ("b", "", "", "harbour crane repairs")], "chunk_id string, section_name string, section_type string, text string")
    once, twice = (retrieval.bm25(chunks, spark.createDataFrame([(1, q)], "query_id long, query string"), 5).collect() for q in ("liquidity credit", "liquidity liquidity credit credit"))
    assert [(r.chunk_id, r.rank) for r in once] == [("a", 1)] and once[0].score > 0
    assert twice[0].score == pytest.approx(2 * once[0].score)


def test_bm25_of_nothing_is_empty(spark):
    chunks = spark.createDataFrame([], "chunk_id string, section_name string, section_type string, text string")
    assert retrieval.bm25(chunks, spark.createDataFrame([(1, "x")], "query_id long, query string"), 5).count() == 0


def test_vector_search(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    assert [r.chunk_id for r in retrieval.vector_search(v, {1: [0.9, 0.1]}, 2).orderBy("rank").collect()] == ["a", "b"]


def test_rank_fusion(spark):
    def ranked(*ids):
        return spark.createDataFrame([(1, i, n + 1, 1.0) for n, i in enumerate(ids)], "query_id long, chunk_id string, rank int, score double")

    first = retrieval.reciprocal_rank_fusion([ranked("a", "b"), ranked("b", "c")]).orderBy("fused_rank").first()
    assert (first.chunk_id, first.rank_1, first.rank_2, first.fused_rank) == ("b", 2, 1, 1)


def test_chunks_overlap_and_count_up(spark):
    docs = spark.createDataFrame([("F", 2023, "10-K", "liquidity", " ".join(f"w{i}" for i in range(30)), 1), ("F", 2023, "10-K", "liquidity", "", 2)], "ticker string, fiscal_year int, filing_type string, section_type string, text string, n int")
    made = ingestion.with_chunk_ids(ingestion.chunked(docs, ["ticker", "fiscal_year", "filing_type", "section_type", "n"], 10, 2), ["n", "chunk_no"]).orderBy("chunk_no").collect()
    assert [r.chunk_id for r in made] == [f"F_2023_10K_liquidity_00{i}" for i in range(1, 5)]
    assert [(r.token_start, r.token_end) for r in made] == [(0, 10), (8, 18), (16, 26), (24, 30)]
    with pytest.raises(ValueError):
        ingestion.chunked(docs, ["n"], 10, 10)


def test_html_keeps_visible_text_only():
    html = '<p>a<script>x</script><span style="display: none">y</span><b>b<br>c</p><ix:hidden>z</ix:hidden><div hidden>h</div>d &amp; e'
    assert ingestion.visible_text(html).split("\n") == ["a", "b", "c", "d & e"]


def test_html_reference_without_semicolon_stays():
    assert ingestion.visible_text("<h1>a &amp</h1>b &lt c &ampx; &x; &#39 && <p title='&amp'>d&amp;&lt;&#39;&nbsp;e &amp;lt;") == "a &amp\nb &lt c &ampx; &x; &#39 &&\nd&<'\xa0e &lt;"
    assert ingestion.visible_text(None) == ""


def test_sections_in_the_row(spark):
    long, short = "prose of many words " * 30, "a few words " * 20
    texts = [
        "Item 1\nRisk Factors\n" + long + "\nItem 1. Business\n\n  Liquidity and\u00a0Capital   Resources \n" + long + "\nDebt.\n" + short + "\nOutlook\n" + long + "\nRisk Factors\n" + short,
        "Risk Factors\n" + long, "no heading at all\n\nbut lines", "", None, "ITEM 1\n" + "Debt\n" + short,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = ingestion.segmented(docs, "doc_id", whole=True)
    rows = [(r.doc_id, r.section_no, r.name, r.type, r.start_pos) for r in found.orderBy("doc_id", "section_no").collect()]
    assert rows == [
        (0, 1, "Liquidity and Capital Resources", "liquidity", 5), (0, 2, "Debt", "debt", 7), (1, 1, "Risk Factors", "risk_factors", 0), (2, 1, "Full Filing", "full_filing", 0),
        (3, 1, "Full Filing", "full_filing", 0), (4, 1, "Full Filing", "full_filing", 0), (5, 2, "Debt", "debt", 1),
    ]
    assert "Exchange" not in ingestion.segmented(docs, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert ingestion.segmented(docs.limit(0), "doc_id", whole=True).count() == 0 and ingestion.segmented(docs, "doc_id").count() == 4


def test_claim_statuses(spark):
    known = spark.createDataFrame([("o", 12.25, "high", False, "USD"), ("n", 14.0, "high", False, "USD"), ("low", 2.0, "low", False, "USD"), ("eur", 3.0, "high", False, "EUR")], "fact_id string, value double, confidence string, review_required boolean, unit string")
    claims = spark.createDataFrame([("ok", "change", "o", "n", 1.75), ("none", "change", "o", "x", None), ("weak", "change", "o", "low", None), ("unit", "change", "o", "eur", None), ("kind", "level", "o", "n", None), ("wrong", "change", "o", "n", 5.0)], "claim_id string, claim_type string, old_fact_id string, new_fact_id string, stated_change double")
    found = {r.claim_id: r for r in verification.verify_claims(claims, known).collect()}
    assert {k: r.status for k, r in found.items()} == {"ok": "verified", "none": "not_enough_data", "weak": "low_confidence", "unit": "inconsistent", "kind": "unsupported", "wrong": "unsupported"}
    assert found["ok"].absolute_change == pytest.approx(1.75) and found["ok"].percentage_change == pytest.approx(14.285714)


def test_percent_of_zero_is_null(spark):
    assert spark.range(1).select(T.percent_change(F.lit(0.0), F.lit(1.0))).first()[0] is None


def test_calculated_metrics_override_and_fill(spark):
    m = spark.createDataFrame([(1, "operating_cash_flow", 1000.0), (1, "capital_expenditures", -250.0), (1, "total_debt", 5.0), (1, "current_debt", 1.0), (1, "long_term_debt", 2.0), (2, "free_cash_flow", 7.0), (2, "operating_cash_flow", 1.0), (2, "capital_expenditures", 1.0)], "k long, metric string, value double")
    found = {(r.k, r.metric): (r.value, r.source) for r in resolution.with_calculated(m, ["k"]).collect()}
    assert found[1, "free_cash_flow"] == (750.0, "calculated") and found[1, "total_debt"] == (3.0, "calculated") and found[2, "free_cash_flow"] == (7.0, "direct")
    assert resolution.expanded_metrics(["free_cash_flow"]) == ["free_cash_flow", "operating_cash_flow", "capital_expenditures"]


def test_resolver_prefers_configured_concepts(spark):
    inv = spark.createDataFrame([("1", 2024, "LongTermDebt", "USD", 1.0), ("1", 2024, "DebtInstrumentCarryingAmount", "USD", 2.0), ("1", 2024, "LongTermDebtNoncurrent", "USD", 3.0)], "cik string, fiscal_year int, concept string, unit string, value double")
    candidates = resolution.classified(inv, ["total_debt"])
    plain = resolution.resolved(candidates).first()
    assert (plain.status, plain.concept, plain.n_rejected) == ("resolved", "LongTermDebt", 1)
    own = spark.createDataFrame([("total_debt", "DebtInstrumentCarryingAmount", 1)], "metric string, concept string, priority int")
    assert resolution.resolved(candidates, own).first().basis == "configured_concept"


def test_guardrail_binds_numbers_to_tags_of_their_line(spark):
    briefs = spark.createDataFrame([(1, "Borrowings came to $12.250B, +4.50%. [verified: c1]\nReserves stood at $80.125B.\nIn 2025 nothing else moved.")], "doc_id long, text string")
    ok = spark.createDataFrame([("c1", "verified")], "claim_id string, status string")
    scanned = guardrail.scan(briefs, ok)
    assert [(r.number, r.bound) for r in scanned.orderBy("line_no", "ordinal").collect()] == [("$12.250B", True), ("+4.50%", True), ("$80.125B", False)]
    text = guardrail.stripped(briefs, scanned).first().text
    assert "80.125" not in text and "In 2025" in text and text.endswith("finalization.")
    assert guardrail.report(scanned).first().severity == "block"


def test_stage_guard_drops_lines_with_other_numbers(spark):
    texts = spark.createDataFrame([(1, "Up to 50.0 in 2025\nor 731.5")], "doc_id long, text string")
    allowed = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), guardrail.renderings(F.lit(50.0)).alias("numbers"))
    r = guardrail.stage_guard(texts, allowed).first()
    assert (r.status, r.text, r.blocked_lines) == ("repaired", "Up to 50.0 in 2025", 1)


def test_coverage_names_what_is_missing(spark):
    rows = spark.createDataFrame([(1, "c", 2023, "liquidity", "Our liquidity is good", [])], "query_id long, chunk_id string, fiscal_year int, section_type string, text string, evidence_category array<string>")
    r = evidence.coverage(rows, [2023, 2025]).first()
    assert r.missing == ["2025 evidence", "2023 debt evidence", "2025 debt evidence", "2025 liquidity evidence", "management explanation", "numeric facts"] and r.decision == "rewrite_query"
    assert evidence.coverage(rows, [2023, 2025], 3).first().decision == "stop_incomplete"


def test_entities(spark):
    directory = spark.createDataFrame([("JPM", "JPMorgan Chase & Co", 0), ("A1", "Alpha One Inc", 1), ("A2", "Alpha Two Inc", 2)], "ticker string, title string, pos int")
    asked = spark.createDataFrame([(1, "JP Morgan"), (2, "alpha"), (3, "Nameless Harbour Works"), (4, "a1")], "query_id long, query string")
    assert {r.query_id: (r.status, r.ticker) for r in entities.resolve(asked, directory).collect()} == {1: ("resolved", "JPM"), 2: ("ambiguous", None), 3: ("not_found", None), 4: ("resolved", "A1")}


def test_memory_merge_counts_additions(spark):
    schema = "company string, risk_theme string, useful_sections array<string>, successful_queries array<string>, last_updated string"
    old, new = spark.createDataFrame([("F", "debt", ["a"], ["q"], "1")], schema), spark.createDataFrame([("F", "debt", ["a", "b"], None, "2"), ("G", "debt", [], ["z"], "2")], schema)
    keys, lists = ["company", "risk_theme"], ["useful_sections", "successful_queries"]
    merged = entities.merged_memory(old, new, keys, lists)
    assert {r.company: (r.useful_sections, r.last_updated) for r in merged.collect()} == {"F": (["a", "b"], "2"), "G": ([], "2")}
    assert {r.company: r.added_useful_sections for r in entities.memory_additions(old, merged, keys, lists).collect()} == {"F": 1, "G": 0}


def test_streaming_memory_and_windows(spark, tmp_path):
    from tallyspark.streaming.state import KeyedState, memory_sink, trace_windows

    schema = "company string, risk_theme string, useful_sections array<string>, successful_queries array<string>, last_updated string"
    for i, rows in enumerate([[("F", "debt", ["a"], ["q"], "1")], [("F", "debt", ["b"], ["q"], "2")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    sink = memory_sink(str(tmp_path / "state"), ["company", "risk_theme"], ["useful_sections", "successful_queries"])
    source.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert KeyedState(spark, str(tmp_path / "state"), ["company", "risk_theme"], ["useful_sections", "successful_queries"]).read(source.schema).first().useful_sections == ["a", "b"]
    steps = spark.createDataFrame([("2024-01-01 00:01:00", "x", True), ("2024-01-01 00:02:00", "x", False)], "ts string, state string, failed boolean").withColumn("ts", F.to_timestamp("ts"))
    assert trace_windows(steps).first().n_failed == 1


def test_facts_of_nested_json(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"0": {"ticker": "f", "title": "Ford", "cik_str": 37996}}))
    assert readers.tickers(spark, str(path)).first().asDict() == {"ticker": "F", "title": "Ford", "cik": "0000037996", "pos": 0}


def test_chunk_lines_are_read_by_schema(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"chunk_id": "a", "text": "x", "fiscal_year": 2023}\n\n')
    assert [(r.chunk_id, r.fiscal_year) for r in readers.chunks(spark, str(path)).collect()] == [("a", 2023)]
    readers.write_artifact(spark.createDataFrame([(1, "x")], "b int, a string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["a", "b"]


def test_company_info_and_substitution(spark):
    raw = spark.createDataFrame([(json.dumps({"cik": "1", "name": "N", "tickers": ["T"], "exchanges": ["X"], "sic": "2", "filings": {"recent": {"form": ["10-K", "10-Q", "10-K/A"], "accessionNumber": ["a", "b", "c"], "filingDate": ["2025-02-01", "2024-11-01", "2023-01-01"], "reportDate": ["2024-12-31", "", ""], "fy": [2024, 2024, 2022], "primaryDocument": ["k", "q", "r"]}}}),)], "json string")
    subs = readers.submissions(raw)
    assert readers.company_info(subs).first().years == [2024, 2023]
    filings = readers.recent_filings(subs)
    assert facts.select_or_substitute(filings, "10-K", 2024).first().is_substitution is False
    assert facts.select_or_substitute(filings, "10-K", 2020).first().is_substitution is True


def test_config_skill_and_tools(spark):
    assert readers.config_rows(spark, {"f": {"ticker": "F", "years": [1, 2]}}, "id", "id string, ticker string, years array<int>").first().years == [1, 2]
    assert readers.skill("# Required\n- a\n- `b`\n") == {"required": ["a", "b"]}
    registry = Registry()
    registry.add(Tool("add", "adds", {"a": {"type": "number"}, "b": {"type": "number"}}, lambda a, b: a + b))
    assert registry.invoke("add", {"a": 1, "b": 2}) == 3 and registry.signatures()[0]["name"] == "add"
    with pytest.raises(KeyError):
        registry.invoke("none", {})
    rows = guarded(["x", "y"], lambda s: {"x": "ok"}[s], lambda t: {"status": "pass", "text": t})
    assert [r["status"] for r in rows] == ["pass", "unavailable"]


def test_reports(spark):
    m = spark.createDataFrame([(1, "total_debt", 2023, 2.0, "verified"), (1, "total_debt", 2025, 3.0, "verified"), (1, "cash", 2023, -1.0, "verified"), (1, "cash", 2025, 1.0, "verified"), (1, "x", 2023, 0.0, "unresolved")], "k long, metric string, fiscal_year int, value double, status string")
    register = reports.change_register(m, ["k"], 2023, 2025)
    assert {r.metric: (r.percent_change, r.signal) for r in register.collect()} == {"total_debt": (50.0, "adverse"), "cash": (200.0, "favorable")}
    assert reports.signal_mix(register, ["k"]).first().overall == "balanced"
    assert reports.evaluation(spark.createDataFrame([], "verified boolean, cited boolean")).first().verified_ratio == 0.0


def test_no_query_pushes_all_columns(spark):
    """A two-column projection reads two columns."""
    from tallyspark.plans.queries import concept_search

    plan = concept_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_name:string>" in plan
