"""Queries over what a research run writes: briefs, answers, registers, plans, memory, manifests; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.operators import analysis, briefs, entities, evidence, extraction, facts, formulas, guardrail, projections, resolution, retrieval, verification
from tallyspark.plans import filings, fixtures, queries, views
from tallyspark.sources import manifest
from tallyspark.sources.readers import load
from tallyspark.sources.staging import fresh_path, kept

BRIEF_YEARS = (1996, 1998, 2000)
TOPICS = [("Debt", ["1-URGENT"], ["debt_old", "debt_new"]), ("Liquidity", ["2-HIGH"], ["cash_old", "cash_new"])]
WANTED: dict[str, list[briefs.Choice]] = {
    "debt_old": [(2023, ["debt"], ["lizenz"]), (2023, ["debt"], None)], "debt_new": [(2025, ["debt"], ["lizenz"]), (2025, ["debt"], None)],
    "cash_old": [(2023, ["liquidity"], None)], "cash_new": [(2025, ["liquidity"], None)], "words_old": [(2023, ["mda"], ["license"])], "words_new": [(2025, ["mda"], ["license"]), (None, None, ["license"])],
}
STEPS = ["Retrieve debt evidence", "Retrieve liquidity evidence", "Check coverage", "Write"]
CLAIM_METRICS = ["5-LOW", "1-URGENT", "3-MEDIUM"]


def brief_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("metric") == "1-URGENT", "total_debt").when(F.col("metric") == "2-HIGH", "cash_and_equivalents").when(F.col("metric") == "3-MEDIUM", "net_income").when(F.col("metric") == "5-LOW", "interest_expense").otherwise("other")
    status = F.when((F.col("metric") == "other") & (F.col("fiscal_year") == 2000), "unsupported").when((F.col("metric") == "interest_expense") & (F.length("entity") % 2 == 0), "low_confidence").otherwise("verified")
    some = views.annual_totals(spark, sf_dir).filter(F.col("fiscal_year").isin(*BRIEF_YEARS)).withColumn("metric", named)
    return some.withColumns({"value": F.when(~((F.length("entity") % 3 == 0) & (F.col("metric") == "net_income")), F.col("value")), "status": status, "unit": F.lit("USD")})


def full_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = load(spark, sf_dir, "nation").filter(F.length("n_name") % 2 == 1).select(F.col("n_name").alias("entity"), F.concat(F.lit("Notes on "), "n_name", F.lit(".")).alias("narrative"))
    return briefs.full_brief(brief_metrics(spark, sf_dir), ["entity"], 1996, 2000, "leverage_analysis", notes)


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("section_type") == "en", "liquidity").when(F.col("section_type") == "de", "debt").when(F.col("section_type") == "fr", "mda").otherwise("credit_facilities")
    return views.chunks(spark, sf_dir).select((F.col("chunk_id") % 50).alias("query_id"), "chunk_id", "fiscal_year", kind.alias("section_type"), "section_name", "text", ((F.col("chunk_id") * 37 % 1000) / 1000).alias("reranker_score"))


def answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = facts.year_pairs(views.annual_totals(spark, sf_dir), ["entity", "metric"], views.OLD_YEAR, views.NEW_YEAR)
    status = F.when(F.col("metric") == "1-URGENT", "verified").when((F.col("metric") == "2-HIGH") & (F.length("entity") % 2 == 0), "verified").when(F.col("metric") == "2-HIGH", "unsupported").otherwise("not_enough_data")
    nations = load(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"), F.col("n_nationkey").cast("long").alias("query_id"))
    results = pairs.join(nations, "entity").select("query_id", "metric", "old_value", "new_value", status.alias("status"), F.concat_ws("|", "entity", "metric").alias("source"))
    covered = queries.covered(spark, sf_dir).select(F.col("query_id"), "missing", "decision")
    found = briefs.picks(evidence_rows(spark, sf_dir), WANTED, ["query_id"])
    return briefs.synthesized(found, results, covered, ["query_id"], TOPICS, ["words_old", "words_new"], "trace/log")


def evidence_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = briefs.picks(evidence_rows(spark, sf_dir), WANTED, ["query_id"])
    return found.select("query_id", *(F.col(n)["chunk_id"].alias(n) for n in WANTED), F.array_join(F.transform("evidence_table", lambda e: e["chunk_id"].cast("string")), ",").alias("shown"))


def stored_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    part = lambda flag, status: F.sum(F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), F.col("l_quantity")))
    sums = {"current_debt": part("N", "O"), "long_term_debt": part("N", "F"), "shareholders_equity": part("R", "O"), "current_assets": part("R", "F"), "current_liabilities": part("A", "O") - part("A", "O") % 3 * 50, "inventory": part("A", "F"), "net_income": F.sum("l_quantity"), "interest_expense": F.when(F.col("l_suppkey") % 4 != 0, F.count(F.lit(1)).cast("double")).otherwise(F.lit(0.0)), "operating_cash_flow": F.sum("l_linenumber").cast("double"), "capital_expenditures": -F.sum(F.col("l_linenumber") % 3).cast("double")}
    wide = li.groupBy("l_suppkey", F.year("l_shipdate").alias("fiscal_year")).agg(*(v.alias(k) for k, v in sums.items())).withColumnRenamed("l_suppkey", "entity")
    long = wide.unpivot(["entity", "fiscal_year"], list(sums), "metric", "value")
    return formulas.evaluated(long, ["entity", "fiscal_year"]).select("entity", "fiscal_year", "metric", F.round("value", 6).alias("value"))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings of customers from their orders, with the 10-K of 1997 asked for; where there is none the first 10-K or 10-Q stands in."""
    o = load(spark, sf_dir, "orders")
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-K/A").otherwise("10-Q")
    listed = o.select(F.col("o_custkey").cast("string").alias("cik"), F.concat(F.lit("a-"), F.col("o_orderkey").cast("string")).alias("accession"), form.alias("form"), F.year("o_orderdate").alias("fy"), F.col("o_orderdate").cast("date").alias("filing_date"), F.col("o_orderkey").alias("pos"))
    chosen = facts.select_or_substitute(listed, "10-K", 1997)
    return chosen.select("cik", "accession", "form", F.col("fy").cast("int").alias("fiscal_year"), "filing_date", F.lit("10-K").alias("requested_form"), F.lit(1997).alias("requested_year"), "is_substitution", T.archive_url(F.col("cik"), F.col("accession"), F.concat("accession", F.lit(".htm"))).alias("document"), F.concat(F.lit("<p>"), "accession", F.lit("</p>")).alias("html"))


def filing_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, the second over everything, then the second once more and a third: only what was lacking is added."""
    path, all_ = fresh_path(spark, "filings"), packages(spark, sf_dir)
    manifest.ingest(all_.filter("cast(cik AS bigint) % 2 = 0"), path, 1)
    for batch in (2, 2, 3):
        manifest.ingest(all_, path, batch)
    return manifest.filings(spark, path).select("cik", "accession", "form", "fiscal_year", "is_substitution", "batch", "document", F.md5("html").alias("digest"))


def listed_filings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = load(spark, sf_dir, "orders")
    form = F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-K/A")
    listed = o.select(F.col("o_custkey").alias("cik"), form.alias("form"), F.col("o_orderdate").cast("date").alias("filing_date"), F.col("o_orderkey").alias("pos"))
    return listed, o.select(F.col("o_custkey").alias("cik"), F.year("o_orderdate").alias("fiscal_year")).distinct()


def first_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.first_filings(*listed_filings(spark, sf_dir)).select("cik", "fiscal_year", F.col("pos").alias("accession"))


def filing_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.filing_years(listed_filings(spark, sf_dir)[0]).select("cik", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"))


def ordered_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = facts.year_pairs(views.annual_totals(spark, sf_dir), ["entity", "metric"], views.OLD_YEAR, views.NEW_YEAR)
    return verification.ordered_claims(pairs, ["entity", "metric"], CLAIM_METRICS, views.OLD_YEAR, views.NEW_YEAR).select("claim_id", "place", "metric")


def resolver_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every concept's metrics by the terms of their names and configured concepts; what was rejected is listed."""
    configured = {"interest_expense": ["us-gaap:InterestExpense"], "dividend_payments": ["us-gaap:PaymentsOfDividends"], "cash_and_equivalents": ["us-gaap:Cash"]}
    terms = {m: analysis.search_terms(m, c, analysis.RESOLUTION_PARTS) for m, c in configured.items()}
    inventory = queries.resolver_inputs(spark, sf_dir).filter("NOT (cast(cik AS int) % 3 = 0 AND concept IN ('InterestExpense', 'InterestExpenseNonoperating'))")
    found = resolution.classified(inventory, list(configured), terms)
    out = resolution.with_related(found, resolution.resolved(found))
    return out.select("cik", "metric", "status", "concept", F.array_join("related", "; ").alias("related"))


def ambiguous_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first letters of the customers' names and their segments, asked of a directory of all customers."""
    c = load(spark, sf_dir, "customer")
    directory = c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), F.concat(F.lower("c_mktsegment"), F.lit(" "), (F.col("c_custkey") % 100).cast("string"), F.lit(" Holding, Inc.")).alias("title"), F.col("c_custkey").alias("pos"))
    asked = c.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("query_id")).select("query_id", F.concat("c_mktsegment", F.lit(" 1")).alias("query"))
    return entities.ambiguous_messages(asked, directory)


def topic_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = queries.memory_upsert(spark, sf_dir).select("company", "risk_theme", F.split("useful_sections", r"\|").alias("useful_sections"), F.split("successful_queries", r"\|").alias("successful_queries"))
    asked = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("company")).union(spark.range(100, 103).select(F.col("id").cast("string"))).withColumn("risk_theme", F.lit("user"))
    known = entities.topic_memory(asked, state, ["company", "risk_theme"], ["useful_sections", "successful_queries"], "start here")
    boosts = retrieval.memory_section_boosts(F.array(F.lit("Debt note"), F.lit("Other")))
    return known.select("company", F.size("useful_sections").cast("long").alias("n_sections"), "query", F.size(boosts).cast("long").alias("n_boosts"))


def research_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("task_id"), F.col("n_name").alias("company"), F.array(F.lit(2025), F.lit(2023)).alias("years"), F.array(F.lit("10-K"), F.lit("10-Q")).alias("forms"))
    out = evidence.plans(tasks, STEPS, "debt and liquidity")
    return out.select("task_id", "objective", F.size("steps").cast("long").alias("n_steps"), "initial_query", "max_iterations")


def next_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewrites = queries.query_rewrite(spark, sf_dir)
    previous = rewrites.select("query_id").withColumn("query", F.when(F.col("query_id") % 2 == 0, "Issuer outlook debt").otherwise("2023 2025 first try")).union(spark.range(900, 902).select("id", F.lit("nothing missing")))
    return evidence.next_query(rewrites, previous)


def allowed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_custkey", (F.floor(queries.cents() / 1000) / 100).alias("value"))
    out = guardrail.allowed_numbers(o, "o_custkey", [2025, 2023])
    return out.select("o_custkey", F.size("numbers").cast("long").alias("n"), F.array_join(F.filter("numbers", lambda n: ~n.contains(",")), "|").alias("plain"))


def compact_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = verification.verify_claims(*queries.claim_inputs(spark, sf_dir)).withColumns({"metric": F.element_at(F.split("old_fact_id", r"\|"), 2), "old_year": F.lit(views.OLD_YEAR), "new_year": F.lit(views.NEW_YEAR)})
    out = projections.compact_results(claims)
    return out.select("claim_id", "metric", "status", "old_year", "new_year", F.round("absolute_change", 2).alias("absolute_change"), "direction", F.size("evidence").cast("long").alias("n_evidence"))


def narrative_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as passages of a filing: a sentence or flattened table with amounts in billions, every fifth of another year."""
    o, key = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    tenths = F.floor(filings.cents("o_totalprice") / 100_000)
    amount = lambda plus: F.concat(F.floor((tenths + plus) / 10).cast("string"), F.lit("."), ((tenths + plus) % 10).cast("string"))
    begin = F.concat(F.lit("At December 31, "), (F.year("o_orderdate") - F.when(key % 5 == 0, 1).otherwise(0)).cast("string"), F.lit(", "))
    forms = [
        F.concat(begin, F.lit("total balance sheet cash, cash equivalents, marketable securities, and restricted cash, as reported, was $ "), amount(0), F.lit(" billion.")),
        F.concat(begin, F.lit("we had Company cash of $"), amount(0), F.lit(" billion and liquidity of $"), amount(3), F.lit(" billion.")),
        F.concat(F.lit("Balance Sheets ($B)  Company Cash $ "), amount(1), F.lit(" $ "), amount(2), F.lit(" Liquidity "), amount(4), F.lit(" "), amount(5)),
        F.concat(begin, F.lit("Ford Credit\u2019s net liquidity available for use was $"), amount(0), F.lit(" billion, as planned.")),
        F.concat(begin, F.lit("Ford Credit's liquidity sources, including cash, committed asset-backed facilities, and unsecured credit facilities, totaled $"), amount(0), F.lit(" billion in all.")),
        F.concat(begin, F.lit("Ford Credit's committed capacity totaled $"), amount(0), F.lit(" billion.")),
        F.concat(F.lit("Debt payable within one year was "), amount(0), F.lit(".")), F.lit("Debt was as before."),
    ]
    kind = F.element_at(F.array(*map(F.lit, ["liquidity", "mda", "mda", "credit_facilities", "credit_facilities", "credit_facilities", "debt", "debt"])), (key % 8 + 1).cast("int"))
    return o.select(F.col("o_custkey").cast("string").alias("company"), F.concat(F.lit("o"), key.cast("string")).alias("chunk_id"), F.year("o_orderdate").alias("fiscal_year"), kind.alias("section_type"), F.element_at(F.array(*forms), (key % 8 + 1).cast("int")).alias("text"))


def narrative_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.narrative_facts(narrative_chunks(spark, sf_dir)).select("chunk_id", "metric", "value", "confidence", "review_required", "fact_id")


def fact_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debt facts from tags with concepts by order, and the narrative's, as one bag; counted and added up by company and year."""
    concepts = [c for found in extraction.DEBT_CONCEPTS.values() for c in found]
    key = F.element_at(F.array(*map(F.lit, concepts)), (F.col("o_orderkey") * 3 % len(concepts) + 1).cast("int"))
    keyed = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("doc_id"), key.alias("key"), F.year("o_orderdate").alias("year")).agg(F.max(filings.cents("o_totalprice") * 10_000).cast("double").alias("value"))
    chunks = narrative_chunks(spark, sf_dir)
    tagged = extraction.tagged_debt_facts(keyed, chunks).withColumn("company", F.col("doc_id"))
    told = extraction.narrative_facts(chunks)
    bag = extraction.all_facts(tagged.filter("chunk_id IS NOT NULL AND source_text LIKE '%ebt payable%'"), told)
    return bag.groupBy("company", "fiscal_year", "fact_source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def statement_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered statements' metrics, cross-checked with filed facts that the resolver accepts, with calculated metrics."""
    keys = ["entity", "fiscal_year"]
    stated = resolution.resolve_statements(filings.statement_lines(spark, sf_dir)).withColumnRenamed("accession", "entity")
    o, price = load(spark, sf_dir, "orders"), filings.cents("o_totalprice")
    year = F.when(F.col("o_orderkey") % 2 == 0, 2025).otherwise(2024)
    sums = o.groupBy(F.col("o_custkey").alias("c"), year.alias("fiscal_year")).agg(F.floor(F.sum(price) / 100).alias("x"))
    both = sums.join(sums.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n = 2"), "c")
    filed = both.select(F.col("c").cast("string").alias("cik"), "fiscal_year", F.inline(F.array(*(F.struct(F.lit(n).alias("concept"), v.cast("double").alias("value")) for n, v in (("NetCashProvidedByUsedInOperatingActivities", F.col("x") + F.col("c") % 3), ("InterestExpense", F.floor(F.col("x") / 12)), ("LongTermDebtNoncurrent", F.floor(F.col("x") / 9))))))).withColumn("unit", F.lit("USD"))
    accepted = resolution.resolved(resolution.classified(filed, ["operating_cash_flow", "interest_expense", "long_term_debt"])).filter("status = 'resolved'").withColumnRenamed("cik", "entity")
    direct = kept(analysis.composed(stated, accepted, keys), "analysis")  # the register reads it several times
    rows = projections.resolution_rows(analysis.register(direct, keys, ["free_cash_flow", "total_debt"]))
    return rows.select(*keys, "metric", "value", "source", "status", "cross_check", "difference", "requires_review", "source_type")


def configured_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured concepts, first choice first, before the rules."""
    own = spark.createDataFrame([("interest_expense", "InterestExpenseNonoperating", 1), ("interest_expense", "InterestExpense", 2), ("net_income", "NoSuchConcept", 1)], "metric string, concept string, priority int")
    found = resolution.classified(queries.resolver_inputs(spark, sf_dir), ["interest_expense", "net_income"])
    return resolution.resolved(found, own).select("cik", "metric", "status", "basis", "concept", "value")


def gap_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.covered(spark, sf_dir).select("query_id", F.array_join(evidence.gap_sections(F.col("missing")), ",").alias("sections"))


def flat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly maps of metrics, as results hold them, made flat again."""
    rows = views.annual_totals(spark, sf_dir).groupBy("entity", "fiscal_year").agg(F.sort_array(F.collect_list(F.struct("metric", "value"))).alias("m"))
    results = rows.groupBy(F.col("entity").alias("ticker")).agg(F.map_from_entries(F.collect_list(F.struct("fiscal_year", "m"))).alias("metrics_by_year"))
    return projections.metric_rows(results).select("ticker", "fiscal_year", F.col("pos").cast("long").alias("pos"), "metric", "value")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.run_summary(views.annual_totals(spark, sf_dir).select(F.col("entity").alias("ticker"), "fiscal_year", F.col("metric").alias("concept")))


def diagnostic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = resolution.coverage_gaps(views.annual_totals(spark, sf_dir), ["entity"], ["1-URGENT", "9-NONE"], [1996, 1997, 2002])
    named = F.array_sort(F.filter(F.array(F.lit("z"), F.when(F.length("entity") % 2 == 0, F.lit("a")), F.lit("m")), lambda x: x.isNotNull()))
    return projections.diagnostic_rows(gaps.withColumn("candidates", named), ["entity"], most=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        full_brief, answer, evidence_picks, stored_formulas, filing_manifest, first_filings, filing_years, ordered_claims, resolver_register,
        ambiguous_companies, topic_memory, research_plan, next_query, allowed_numbers, compact_results,
        narrative_facts, fact_bag, statement_analysis, configured_resolution, gap_sections, flat_metrics, run_summary, diagnostic_report,
    )
}
