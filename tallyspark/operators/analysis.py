"""The composed analysis: statement rows first, else company facts, cross-checked, with calculated metrics and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.text import contains_any
from tallyspark.operators import resolution
from tallyspark.operators.facts import best_annual_facts

#: Parts of concept names that add a search term to a metric, for resolution and for diagnostics.
RESOLUTION_PARTS = ["Debt", "Cash", "Interest", "Dividend", "Assets", "Liabilities"]
DIAGNOSTIC_PARTS = ["Interest", "Debt", "Cash", "Lease"]


def search_terms(metric: str, concepts: list[str], parts: list[str]) -> list[str]:
    """Words of four letters or more of a metric's name, and the parts that its configured concepts hold; sorted."""
    local = [c.split(":")[-1] for c in concepts]
    return sorted({w for w in metric.split("_") if len(w) >= 4} | {p.lower() for p in parts for c in local if p in c})


def composed(statement: DataFrame, companyfacts: DataFrame, keys: list[str], tolerance: float = 1.0) -> DataFrame:
    """keys, metric, value, concept, source, status, cross_check, difference, requires_review: one row for each metric of a key.

    statement and companyfacts: keys, metric, value, concept. A statement's value wins and is checked against
    the filed one; else the filed value holds. Both sides meet in one aggregation; of several rows of a
    side the smallest (value, concept) counts. Rows without a value count for nothing.
    """

    def side(rows: DataFrame, own: str, other: str) -> DataFrame:
        pair = F.struct(F.col("value").cast("double").alias("value"), F.col("concept").cast("string").alias("concept"))
        return rows.filter("value IS NOT NULL").select(*keys, "metric", pair.alias(own), F.lit(None).cast("struct<value:double,concept:string>").alias(other))

    both = side(statement, "s", "f").unionByName(side(companyfacts, "f", "s")).groupBy(*keys, "metric").agg(F.min("s").alias("s"), F.min("f").alias("f"))
    stated, filed = F.col("s").isNotNull(), F.col("f").isNotNull()
    difference = F.when(stated & filed, F.col("s.value") - F.col("f.value"))
    check = F.when(stated, F.when(~filed, "not_found").when(F.abs(difference) <= tolerance, "matched").otherwise("mismatch"))
    status = F.when(~stated, "resolved").when(check == "matched", "verified_cross_checked").when(check == "mismatch", "cross_check_mismatch").otherwise("verified_statement")
    return both.select(
        *keys, "metric", F.coalesce("s.value", "f.value").alias("value"), F.when(stated, F.col("s.concept")).otherwise(F.col("f.concept")).alias("concept"),
        F.when(stated, "statement").otherwise("companyfacts").alias("source"), status.alias("status"), check.alias("cross_check"), difference.alias("difference"), F.coalesce(check == "mismatch", F.lit(False)).alias("requires_review"),
    )


def register(direct: DataFrame, keys: list[str], calculated: list[str]) -> DataFrame:
    """The resolution register: direct rows, rows of calculated metrics, and a trace row for each calculated metric without a value.

    direct: the rows of composed(). A calculated value takes the place of a direct one of that name.
    """
    values = resolution.with_calculated(direct.select(*keys, "metric", "value"), keys).filter(F.col("source") == "calculated").select(*keys, "metric", "value")
    made = values.select(*keys, "metric", "value", F.lit(None).cast("string").alias("concept"), F.lit("deterministic_calculation").alias("source"), F.lit("calculated_from_verified_inputs").alias("status"), F.lit(None).cast("string").alias("cross_check"), F.lit(None).cast("double").alias("difference"), F.lit(False).alias("requires_review"))
    held = direct.join(values.select(*keys, "metric"), [*keys, "metric"], "left_anti").unionByName(made)
    traces = direct.select(*keys).distinct().withColumn("metric", F.explode(F.array(*map(F.lit, calculated)))).join(held.select(*keys, "metric"), [*keys, "metric"], "left_anti")
    empty = {"value": "double", "concept": "string", "source": "string", "cross_check": "string", "difference": "double"}
    return held.unionByName(traces.withColumns({**{c: F.lit(None).cast(t) for c, t in empty.items()}, "status": F.lit("calculated_metric"), "requires_review": F.lit(False)}))


def diagnosed(values: DataFrame, facts: DataFrame, configured: dict[str, list[str]], years: list[int], most: int = 8) -> DataFrame:
    """cik, metric, covered_years, missing_years, related, zero_values, diagnosis of the metrics that lack a year.

    values: cik, fiscal_year, metric, value. facts: cik, concept, fy, fp, form, filed, end, val, pos. configured names each
    metric's concepts. Related concepts hold a search term of the metric and are not configured; of these, and of
    those with a zero, at most the first few by covered years are listed, which is what the report shows.
    """
    gaps = resolution.coverage_gaps(values.withColumnRenamed("cik", "entity"), ["entity"], list(configured), years).filter("size(missing_years) > 0").withColumnRenamed("entity", "cik").drop("diagnosis")
    best = best_annual_facts(facts.filter(F.col("fy").isin(years) & F.col("val").isNotNull()), ["cik", "concept", "fy"])
    found = best.groupBy("cik", "concept").agg(F.count(F.lit(1)).alias("n_years"), F.bool_or(F.col("val") == 0).alias("has_zero"))
    asked = F.array(*(F.struct(F.lit(m).alias("metric"), contains_any(F.lower("concept"), search_terms(m, c, DIAGNOSTIC_PARTS)).alias("hit"), (~F.col("concept").isin([x.split(":")[-1] for x in c])).alias("other")) for m, c in configured.items()))
    near = found.withColumn("m", F.explode(F.filter(asked, lambda a: a["hit"]))).select("cik", "concept", "n_years", "has_zero", "m.metric", "m.other")
    order = Window.partitionBy("cik", "metric")
    place = {"r": F.sum(F.col("other").cast("int")).over(order.orderBy(F.desc("n_years"), "concept")), "z": F.sum(F.col("has_zero").cast("int")).over(order.orderBy(F.desc("n_years"), "concept"))}

    def listed(flag: str, rank: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(F.col(flag) & (F.col(rank) <= most), F.struct(rank, "concept")))), lambda x: x["concept"])

    lists = near.withColumns(place).groupBy("cik", "metric").agg(listed("other", "r").alias("related"), listed("has_zero", "z").alias("zero_values"))
    none = F.array().cast("array<string>")
    joined = gaps.join(lists, ["cik", "metric"], "left").withColumns({c: F.coalesce(c, none) for c in ("related", "zero_values")})
    partial, related = F.size("covered_years") > 0, F.size("related") > 0
    says = F.when(related & partial, "partial_with_related_concepts").when(related, "uncovered_with_related_concepts").when(partial, "partial").otherwise("uncovered")
    return joined.withColumn("diagnosis", says)


def verified_by_metric(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last verified result of each metric. results: keys, metric, status, value and an order that no two rows share."""
    return results.filter("status = 'verified'").groupBy(*keys, "metric").agg(F.max_by("value", order).alias("value"))


def unverified_mentions(answers: DataFrame, results: DataFrame) -> DataFrame:
    """answer_id, metric: metrics of an answer's results that none verified but its text names.

    answers: answer_id, text; results: answer_id, metric, status. They meet by answer_id, so no answer is tried with another's metrics.
    """
    open_ = results.filter(F.coalesce(F.col("status") != "verified", F.lit(True))).select("answer_id", "metric").distinct()
    return answers.join(open_, "answer_id").filter(F.lower("text").contains(F.replace("metric", F.lit("_"), F.lit(" ")))).select("answer_id", "metric")


def over_fetched(ranked: DataFrame, n: int, years: list[int] | None = None, sections: list[str] | None = None, most: int = 25) -> DataFrame:
    """The first n of each query's results that fit the filters, out of the first 3 n (at most `most`) fetched; without filters the first n.

    ranked: query_id, rank, fiscal_year, section_name.
    """
    from tallyspark.operators.retrieval import post_filtered

    fetched = ranked.filter(F.col("rank") <= (min(max(3 * n, n), most) if years or sections else n))
    order = Window.partitionBy("query_id").orderBy("rank")
    return post_filtered(fetched, years, sections).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def supported(rows: DataFrame, ticker: str, known: list[str]) -> DataFrame:
    """Add accepted: whether the ticker, whatever its case, is among the known ones; a null one is not."""
    return rows.withColumn("accepted", F.coalesce(F.upper(ticker).isin([k.upper() for k in known]), F.lit(False)))
