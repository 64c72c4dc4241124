"""Formulas, briefs, answers and the filing manifest on small inputs."""

from __future__ import annotations

from graphlib import CycleError

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import briefs, entities, evidence, facts, formulas, guardrail, projections, verification
from tallyspark.sources import manifest


def test_formulas(spark):
    assert formulas.names_in("abs(a - 2) / b") == {"a", "b"}
    chain = {"x": "y + 1", "y": "z * 2", "w": "x / zero"}
    assert [m for m in formulas.evaluation_order(chain) if m != "w"] == ["y", "x"]
    rows = spark.createDataFrame([("e", "z", 3.0), ("e", "zero", 0.0), ("f", "y", 4.0), ("f", "zero", None)], "entity string, metric string, value double")
    assert sorted(tuple(r) for r in formulas.evaluated(rows, ["entity"], chain).collect()) == [("e", "x", 7.0), ("e", "y", 6.0), ("f", "x", 5.0)]
    assert formulas.evaluated(rows.limit(0), ["entity"]).count() == 0
    with pytest.raises(CycleError):
        formulas.evaluation_order({"a": "b + 1", "b": "a - 1"})
    for bad in ("a ** 2", "__import__('os')", "a.b", "max(a, b)", "'x'"):
        with pytest.raises(ValueError):
            formulas.compiled(bad, {"a": F.lit(1), "b": F.lit(2)})


def test_brief_sections(spark):
    rows = [("F", "total_debt", 2023, 100.0, "USD", "verified"), ("F", "total_debt", 2025, 150.0, "USD", "verified"), ("F", "cash", 2023, 0.0, "USD", "verified"), ("F", "cash", 2025, 5.0, "USD", "verified"), ("F", "odd", 2025, None, None, "unsupported"), ("G", "cash", 2025, 1.0, "USD", "strange")]
    metrics = spark.createDataFrame(rows, "company string, metric string, fiscal_year int, value double, unit string, status string")
    notes = spark.createDataFrame([("G", "Words.")], "company string, narrative string")
    found = {r.company: r for r in briefs.full_brief(metrics, ["company"], 2023, 2025, "leverage_analysis", notes).collect()}
    assert found["F"].n_sections == 9 and found["G"].n_sections == 10
    assert "**Pressure**\n- total debt from 100.00 to 150.00 (50.0%)" in found["F"].brief and "- cash from 0.00 to 5.00 (n/a)" in found["F"].brief
    assert "| odd | n/a | ✗ unsupported |" in found["F"].brief and "| cash | 1.00 USD | ? strange |" in found["G"].brief
    assert "No metric is verified in both years." in found["G"].brief and found["G"].brief.endswith("leverage analysis: open.")
    assert briefs.full_brief(metrics.limit(0), ["company"], 2023, 2025, "x").count() == 0


def test_picks_fall_back_in_order(spark):
    rows = [(1, 10, 2023, "debt", "s", "plain", 0.9), (1, 11, 2023, "debt", "s", "has WORD", 0.1), (1, 12, 2025, "debt", "s", "plain", 0.5), (1, 13, 2025, "debt", "s", "plain", 0.5), (2, 14, 2023, "mda", None, None, 0.3)]
    chunks = spark.createDataFrame(rows, "q int, chunk_id long, fiscal_year int, section_type string, section_name string, text string, reranker_score double")
    wanted = {"a": [(2023, ["debt"], ["word"]), (2023, ["debt"], None)], "b": [(2025, ["debt"], ["word"]), (2025, None, None)], "c": [(2023, ["liquidity"], None)]}
    found = {r.q: r for r in briefs.picks(chunks, wanted, ["q"], table=3).collect()}
    assert (found[1].a.chunk_id, found[1].b.chunk_id, found[1].c) == (11, 12, None) and found[2].a is None
    assert [e.chunk_id for e in found[1].evidence_table] == [10, 11, 12]
    results = spark.createDataFrame([], "q int, metric string, old_value double, new_value double, status string, source string")
    coverage = spark.createDataFrame([(1, [], "sufficient")], "q int, missing array<string>, decision string")
    said = {r.q: r for r in briefs.synthesized(briefs.picks(chunks, wanted, ["q"]), results, coverage, ["q"], [("Debt", ["d"], ["a", "b"])], ["c"], "t").collect()}
    assert "- 2023: has WORD [11]\n- 2025: plain [12]" in said[1].answer and said[1].n_claims == 2 and "Coverage is sufficient." in said[1].answer
    assert "Nothing was found." in said[2].answer and "missing: all" in said[2].answer and said[2].n_claims == 0


def test_manifest_adds_only_what_lacks(spark, tmp_path):
    path = str(tmp_path / "filings")
    rows = [("1", "a", 2023, 2023, False), ("1", "b", 2024, 2024, False), ("1", "b", 2024, 2022, True)]
    made = spark.createDataFrame(rows, "cik string, accession string, fiscal_year int, requested_year int, is_substitution boolean").selectExpr("*", "'10-K' AS form", "cast(null AS date) AS filing_date", "'10-K' AS requested_form", "'d' AS document", "'<p>' AS html")
    assert manifest.filings(spark, path).count() == 0
    assert manifest.ingest(made.filter("accession = 'a'"), path, 1).count() == 1
    for batch in (2, 2, 3, 1):
        found = sorted((r.accession, r.batch, r.is_substitution) for r in manifest.ingest(made, path, batch).collect())
    assert found == [("a", 1, False), ("b", 2, True)]
    one = tmp_path / "one.json"
    one.write_text('{"cik": "1",\n "accession": "a", "fiscal_year": 2023, "is_substitution": false}')
    assert manifest.filing_documents(spark, str(one)).first().accession == "a"


def test_older_filing_rule_and_years(spark):
    listed = spark.createDataFrame([("c", "10-K", "2024-02-01", 5), ("c", "10-K", "2023-02-01", 7), ("c", "10-K/A", "2023-01-01", 1), ("d", "10-Q", "2023-01-01", 2)], "cik string, form string, filing_date string, pos int").withColumn("filing_date", F.to_date("filing_date"))
    wanted = spark.createDataFrame([("c", 2023), ("c", 2022), ("c", 2020), ("d", 2023)], "cik string, fiscal_year int")
    assert sorted((r.cik, r.fiscal_year, r.pos) for r in facts.first_filings(listed, wanted).collect()) == [("c", 2022, 7), ("c", 2023, 5)]
    assert {r.cik: r.years for r in facts.filing_years(listed).collect()} == {"c": [2024, 2023], "d": []}


def test_small_projections(spark):
    pairs = spark.createDataFrame([("m", 1.0, 2.0), ("n", 3.0, 1.0), ("o", 1.0, 1.0)], "metric string, old_value double, new_value double")
    assert {(r.metric, r.place) for r in verification.ordered_claims(pairs, ["metric"], ["n", "m"], 1, 2).collect()} == {("n", 1), ("m", 2)}
    kept = projections.compact_results(pairs.withColumn("other", F.lit(1)))
    assert kept.columns == projections.RESULT_FIELDS and kept.first().evidence == []
    numbers = guardrail.allowed_numbers(spark.createDataFrame([("k", 1234.5), ("k", None)], "k string, value double"), "k", [2025]).first().numbers
    assert {"1234.5", "1,234.50", "2025"} <= set(numbers) and None not in numbers
    plan = evidence.plans(spark.createDataFrame([(1, "F", [2025, 2023], ["10-K"])], "task_id int, company string, years array<int>, forms array<string>"), ["s"], "debt").first()
    assert plan.initial_query == "F 2025 2023 10-K debt" and plan.objective == "Compare F on debt between 2023 and 2025."
    asked = spark.createDataFrame([(1, "Aa"), (2, "zz"), (3, "")], "query_id int, query string")
    directory = spark.createDataFrame([(f"T{i}", f"Aa {i} Inc", i) for i in range(7)], "ticker string, title string, pos int")
    said = entities.ambiguous_messages(asked, directory).collect()
    assert [(r.query_id, r.message) for r in said] == [(1, "7 companies fit: " + "; ".join(f"T{i} (Aa {i} Inc)" for i in range(5)))]
    memory = spark.createDataFrame([("F", ["a"], ["q1", "q2"])], "company string, s array<string>, successful_queries array<string>")
    topics = spark.createDataFrame([("F",), ("G",)], "company string")
    assert sorted((r.company, r.query, len(r.s)) for r in entities.topic_memory(topics, memory, ["company"], ["s", "successful_queries"], "d").collect()) == [("F", "q2", 1), ("G", "d", 0)]
    assert {r.query for r in entities.topic_memory(topics, memory, ["company"], ["s", "successful_queries"], "d", use_memory=False).collect()} == {"d"}
