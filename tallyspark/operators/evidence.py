"""Evidence coverage of a question's years and categories, and the rewriting of its query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import rules
from tallyspark.functions.text import contains_any

CATEGORIES = ["debt", "liquidity", "management_explanation", "numeric_facts"]


def is_management_explanation() -> Column:
    """Prose of management: an mda chunk with a management phrase and two sentences of 40 characters or more."""
    sentences = F.size(F.regexp_extract_all("text", F.lit(r"[A-Z][^.]{40,}\."), 0))
    return (F.col("section_type") == "mda") & contains_any(F.lower("text"), rules.MANAGEMENT_TERMS) & (sentences >= 2)


def supports() -> dict[str, Column]:
    """What a chunk supports, by category."""
    low = F.lower("text")
    return {
        "debt": (F.col("section_type") == "debt") & contains_any(low, rules.DEBT_TERMS),
        "liquidity": F.col("section_type").isin("liquidity", "credit_facilities", "mda") & contains_any(low, rules.LIQUIDITY_TERMS),
        "management_explanation": is_management_explanation(),
        "numeric_facts": F.col("section_type").isin("debt", "liquidity", "credit_facilities", "mda") & F.col("text").rlike(rules.EVIDENCE_NUMBER),
    }


def coverage(evidence: DataFrame, years: list[int], iteration: int = 1, max_iterations: int = 3, required: list[str] = CATEGORIES) -> DataFrame:  # noqa: B006
    """query_id, the missing parts in order, the decision and what supports each category.

    evidence: query_id, chunk_id, fiscal_year, section_type, text, evidence_category. Debt and liquidity are needed for every
    year; other required categories anywhere. One aggregation; supporting ids are sorted.
    """
    flags = supports()
    marked = evidence.select("query_id", "chunk_id", "fiscal_year", "evidence_category", *(F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()))
    extra = sorted(set(required) - set(CATEGORIES))
    grouped = marked.groupBy("query_id").agg(
        F.collect_set("fiscal_year").alias("years"),
        F.collect_set(F.when(F.col("debt"), F.col("fiscal_year"))).alias("debt_years"),
        F.collect_set(F.when(F.col("liquidity"), F.col("fiscal_year"))).alias("liquidity_years"),
        *(F.bool_or(c).alias(f"has_{c}") for c in ("management_explanation", "numeric_facts")),
        *(F.bool_or(F.array_contains(F.transform("evidence_category", F.lower), c)).alias(f"has_{c}") for c in extra),
        *(F.sort_array(F.collect_set(F.when(F.col(k), F.col("chunk_id")))).alias(f"{k}_chunks") for k in flags),
    )
    parts = [F.when(~F.array_contains("years", y), F.lit(f"{y} evidence")) for y in sorted(years)]
    for kind in ("debt", "liquidity"):
        parts += [F.when(~F.array_contains(f"{kind}_years", y), F.lit(f"{y} {kind} evidence")) for y in sorted(years) if kind in required]
    parts += [F.when(~F.col(f"has_{c}"), F.lit(c.replace("_", " "))) for c in ("management_explanation", "numeric_facts") if c in required]
    parts += [F.when(~F.col(f"has_{c}"), F.lit(f"{c} evidence")) for c in extra]
    missing = F.filter(F.array(*parts), lambda x: x.isNotNull())
    decision = F.when(F.size("missing") == 0, "sufficient").when(F.lit(iteration < max_iterations), "rewrite_query").otherwise("stop_incomplete")
    return grouped.withColumn("missing", missing).withColumn("decision", decision)


def rewritten(covered: DataFrame, company: str, years: list[int]) -> DataFrame:
    """query_id, query, reason: a query that asks for the missing parts."""
    asks = {"debt": "debt maturities long-term debt payable within one year", "liquidity": "liquidity capital resources cash marketable securities committed credit", "management": "management discussion primarily due to we expect", "numeric": "total amount billion million"}
    said = F.array_join("missing", "; ")
    words = F.concat_ws(" ", F.lit(company), F.lit(" ".join(map(str, sorted(years)))), *(F.when(said.contains(k), F.lit(v)) for k, v in asks.items()))
    return covered.filter("decision = 'rewrite_query'").select("query_id", words.alias("query"), F.concat(F.lit("Missing: "), said).alias("reason"))


def plans(tasks: DataFrame, steps: list[str], topic: str, most: int = 3) -> DataFrame:
    """task_id, objective, steps, initial_query, max_iterations: the plan that a task begins with. tasks: task_id, company, years, forms."""
    words = F.concat_ws(" ", "company", F.array_join(F.transform("years", lambda y: y.cast("string")), " "), F.array_join("forms", " "), F.lit(topic))
    ends = [F.array_min("years").cast("string"), F.array_max("years").cast("string")]
    objective = F.concat(F.lit("Compare "), F.col("company"), F.lit(f" on {topic} between "), ends[0], F.lit(" and "), ends[1], F.lit("."))
    return tasks.select("task_id", objective.alias("objective"), F.array(*map(F.lit, steps)).alias("steps"), words.alias("initial_query"), F.lit(most).alias("max_iterations"))


def next_query(rewrites: DataFrame, previous: DataFrame) -> DataFrame:
    """query_id, query, changed: the rewritten query with the words of the previous one that it lacks, in their order.

    rewrites: query_id, query; previous: query_id, query. A query that asks for nothing new stays as it was.
    """
    p, r = previous.select("query_id", F.col("query").alias("before")), rewrites.select("query_id", "query")
    joined = p.join(r, "query_id", "left")
    old, new = F.split("before", " "), F.split(F.coalesce("query", F.lit("")), " ")
    words = F.array_distinct(F.filter(F.concat(new, old), lambda w: w != ""))
    made = F.when(F.col("query").isNull(), F.col("before")).otherwise(F.array_join(words, " "))
    return joined.select("query_id", made.alias("query"), (made != F.col("before")).alias("changed"))


def gap_sections(gaps: Column) -> Column:
    """The section types that can fill the gaps."""
    said = F.lower(F.array_join(gaps, " "))
    return F.filter(F.array(F.when(said.contains("debt"), "debt"), F.when(said.contains("liquidity"), "liquidity"), F.when(said.contains("credit"), "credit_facilities"), F.when(said.contains("management"), "mda")), lambda x: x.isNotNull())
