"""Claims over facts and their verification; answers held against evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import change, direction, percent_change


def propose_claims(pairs: DataFrame, keys: list[str], old_year: int, new_year: int) -> DataFrame:
    """A claim for each pair: claim_id and a sentence with both values to three decimals."""
    name = F.concat_ws("_", *keys)
    moved = direction(F.col("old_value"), F.col("new_value"))
    sentence = F.format_string(f"%s moved from %.3f in {old_year} to %.3f in {new_year} (%s).", name, F.col("old_value"), F.col("new_value"), moved)
    return pairs.withColumns({"claim_id": F.concat(F.lit("claim_"), name, F.lit(f"_{old_year}_{new_year}")), "sentence": sentence})


def ordered_claims(pairs: DataFrame, keys: list[str], metrics: list[str], old_year: int, new_year: int) -> DataFrame:
    """Claims for the listed metrics alone, with place: where the list has the metric. pairs: keys with metric among them, both values."""
    places = F.create_map(*(x for i, m in enumerate(metrics) for x in (F.lit(m), F.lit(i + 1))))
    claims = propose_claims(pairs.filter(F.col("metric").isin(metrics)), keys, old_year, new_year)
    return claims.withColumn("place", places[F.col("metric")])


def verify_claims(claims: DataFrame, facts: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Add status, absolute_change, percentage_change and direction to claims.

    claims: claim_id, claim_type, old_fact_id, new_fact_id, stated_change. facts: fact_id, value, confidence,
    review_required, unit. not_enough_data: a fact is missing; low_confidence: a fact is of low confidence or
    needs review; inconsistent: units differ; unsupported: no change claim, or the stated change is another; else verified.
    """
    old = facts.select(F.col("fact_id").alias("old_fact_id"), *(F.col(c).alias(f"old_{c}") for c in ("value", "confidence", "review_required", "unit")))
    new = facts.select(F.col("fact_id").alias("new_fact_id"), *(F.col(c).alias(f"new_{c}") for c in ("value", "confidence", "review_required", "unit")))
    joined = claims.join(old, "old_fact_id", "left").join(new, "new_fact_id", "left")
    moved = change(F.col("old_value"), F.col("new_value"))
    weak = (F.col("old_confidence") == "low") | (F.col("new_confidence") == "low") | F.col("old_review_required") | F.col("new_review_required")
    status = (
        F.when(F.col("old_value").isNull() | F.col("new_value").isNull(), "not_enough_data")
        .when(weak, "low_confidence")
        .when(F.col("old_unit") != F.col("new_unit"), "inconsistent")
        .when(F.col("claim_type") != "change", "unsupported")
        .when(F.col("stated_change").isNotNull() & (F.abs(F.col("stated_change") - moved) > tolerance), "unsupported")
        .otherwise("verified")
    )
    return joined.withColumns({"status": status, "absolute_change": F.round(moved, 6), "percentage_change": F.round(percent_change(F.col("old_value"), F.col("new_value")), 6), "direction": F.when(moved.isNotNull(), direction(F.col("old_value"), F.col("new_value")))})


def uncited(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, problem: no_citation, or unknown_citation where a cited chunk is not in the evidence."""
    none = claims.filter("cited IS NULL OR size(cited) = 0").select("claim_id", F.lit("no_citation").alias("problem"))
    cited = claims.select("claim_id", F.explode("cited").alias("chunk_id"))
    unknown = cited.join(evidence.select("chunk_id"), "chunk_id", "left_anti").select("claim_id", F.lit("unknown_citation").alias("problem")).distinct()
    return none.union(unknown)


def repaired(claims: DataFrame, problems: DataFrame) -> DataFrame:
    """Claims without a problem."""
    return claims.join(problems.select("claim_id"), "claim_id", "left_anti")


def banded(left: Column, right: Column, tolerance: float) -> Column:
    """missing_cross_check, match within the absolute tolerance, or mismatch."""
    return F.when(right.isNull(), "missing_cross_check").when(F.abs(left - right) <= tolerance, "match").otherwise("mismatch")
