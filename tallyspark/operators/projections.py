"""Flat views of nested results: metric rows, resolution rows, diagnostics, evidence previews, task specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.text import preview

REQUIRED_TERMS = ["debt", "liquidity", "2023", "2025", "change"]


def metric_rows(results: DataFrame) -> DataFrame:
    """One row for each metric of each year from year -> metrics maps, ordered by year and place in pos."""
    years = results.select("ticker", F.explode("metrics_by_year").alias("fiscal_year", "metrics"))
    return years.select("ticker", "fiscal_year", F.posexplode("metrics").alias("pos", "m")).select("ticker", "fiscal_year", "pos", "m.*")


def selectors(metrics: DataFrame) -> DataFrame:
    """metric, concept, priority of configured metrics with concepts."""
    return metrics.filter("size(concepts) > 0").select("metric", F.posexplode("concepts").alias("priority", "concept"))


def resolution_rows(resolutions: DataFrame) -> DataFrame:
    """Resolutions with the kind of their source."""
    kind = F.when(F.col("concept").startswith("statement:"), "statement").when(F.col("concept").startswith("calculated:"), "calculated").when(F.col("concept").isNotNull(), "company_facts").otherwise("none")
    return resolutions.withColumn("source_type", kind)


def diagnostic_rows(diagnostics: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """keys, metric and its diagnostics with arrays joined; at most `most` candidates are shown."""
    years = [F.array_join(F.transform(c, lambda y: y.cast("string")), ", ").alias(c) for c in ("covered_years", "missing_years")]
    return diagnostics.select(*keys, "metric", *years, F.array_join(F.slice("candidates", 1, most), ", ").alias("candidates"), "diagnosis")


def compact_evidence(evidence: DataFrame, limit: int = 8, size: int = 700) -> DataFrame:
    """The first rows by pos of each query with a preview of their text."""
    numbered = evidence.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).filter(F.col("_n") <= limit)
    return numbered.select("query_id", "pos", "chunk_id", preview(F.col("text"), size).alias("preview"))


def parsed_tasks(questions: DataFrame, terms: list[str] = REQUIRED_TERMS) -> DataFrame:
    """query_id, missing: the terms that a question lacks; a task is accepted if none is missing."""
    lacking = F.filter(F.array(*(F.when(~F.lower("question").contains(t), F.lit(t)) for t in terms)), lambda t: t.isNotNull())
    return questions.select("query_id", lacking.alias("missing")).withColumn("accepted", F.size("missing") == 0)


RESULT_FIELDS = ["claim_id", "metric", "status", "old_year", "new_year", "old_value", "new_value", "absolute_change", "percentage_change", "direction", "unit", "evidence"]


def compact_results(results: DataFrame) -> DataFrame:
    """The twelve fields that a verified result is shown with; a field that is not there is null, evidence an empty list."""
    none = {"evidence": F.array().cast("array<string>")}
    return results.select(*(F.coalesce(F.col(c), none[c]).alias(c) if c in results.columns and c in none else F.col(c) if c in results.columns else none.get(c, F.lit(None)).alias(c) for c in RESULT_FIELDS))


def run_summary(results: DataFrame) -> DataFrame:
    """ticker, years, metrics and distinct concepts in one row each."""
    return results.groupBy("ticker").agg(F.count_distinct("fiscal_year").alias("n_years"), F.count(F.lit(1)).alias("n_metrics"), F.array_join(F.sort_array(F.collect_set("concept")), ",").alias("concepts"))


def tool_calls(events: DataFrame) -> DataFrame:
    """run, n_calls, names, used_retrieval of tool-loop events (run, pos, kind, name)."""
    calls = events.filter("kind = 'tool_call'")
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), ",")
    return calls.groupBy("run").agg(F.count(F.lit(1)).alias("n_calls"), names.alias("names"), F.bool_or(F.col("name").contains("retrieve")).alias("used_retrieval"))
