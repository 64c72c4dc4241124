"""Aggregates and reports over verified metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import rules
from tallyspark.functions.text import contains_any, direction, percent_change_abs
from tallyspark.operators.facts import year_pairs


def credit_signal(metric: Column, moved: Column) -> Column:
    """adverse, favorable or mixed: the adverse words are tested first, no change is mixed."""
    low = F.lower(metric)
    return (
        F.when(moved == 0, "mixed")
        .when(contains_any(low, rules.ADVERSE_WHEN_UP), F.when(moved > 0, "adverse").otherwise("favorable"))
        .when(contains_any(low, rules.FAVOURABLE_WHEN_UP), F.when(moved > 0, "favorable").otherwise("adverse"))
        .otherwise("mixed")
    )


def change_register(metrics: DataFrame, keys: list[str], old_year: int, new_year: int) -> DataFrame:
    """keys, metric, both values, change, percent of the old magnitude, direction and signal."""
    pairs = year_pairs(metrics.filter("value IS NOT NULL AND status = 'verified'"), [*keys, "metric"], old_year, new_year)
    moved = F.col("new_value") - F.col("old_value")
    return pairs.select(
        *keys,
        "metric",
        F.round("old_value", 2).alias("old_value"),
        F.round("new_value", 2).alias("new_value"),
        F.round(moved, 2).alias("absolute_change"),
        F.round(percent_change_abs(F.col("old_value"), F.col("new_value")), 2).alias("percent_change"),
        direction(F.col("old_value"), F.col("new_value")).alias("direction"),
        credit_signal(F.col("metric"), moved).alias("signal"),
    )


def signal_mix(register: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by signal and the overall label of each key."""
    counts = register.groupBy(*keys).agg(*(F.sum((F.col("signal") == s).cast("long")).alias(s) for s in ("adverse", "favorable", "mixed")))
    label = F.when(F.col("adverse") > F.col("favorable"), "weaker").when(F.col("favorable") > F.col("adverse"), "stronger").otherwise("balanced")
    return counts.withColumn("overall", label)


def evaluation(rows: DataFrame) -> DataFrame:
    """n, verified, cited and their ratios of rows with booleans verified and cited; ratios of nothing are 0."""
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("verified").cast("long")), F.lit(0)).alias("n_verified"), F.coalesce(F.sum(F.col("cited").cast("long")), F.lit(0)).alias("n_cited"))
    return sums.select("*", *(F.round(F.coalesce(F.try_divide(F.col(f"n_{c}"), F.col("n")), F.lit(0.0)), 4).alias(f"{c}_ratio") for c in ("verified", "cited")))


def source_counts(metrics: DataFrame) -> DataFrame:
    """One row: 'source: count' of all sources in the order of their names."""
    counts = metrics.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    said = F.transform(F.sort_array(F.collect_list(F.struct("source", "n"))), lambda x: F.concat(x["source"], F.lit(": "), x["n"].cast("string")))
    return counts.agg(F.array_join(said, ", ").alias("sources"))


def years_complete(metrics: DataFrame, keys: list[str], years: list[int]) -> DataFrame:
    """Whether each metric of each key has all years."""
    return metrics.groupBy(*keys, "metric").agg(F.forall(F.array(*map(F.lit, years)), lambda y: F.array_contains(F.collect_set("fiscal_year"), y)).alias("complete"))


def brief(register: DataFrame, keys: list[str], title: str) -> DataFrame:
    """keys, brief: a markdown table of the changes of each key, in the order of the metrics."""
    pct = F.coalesce(F.concat(F.format_number("percent_change", 2), F.lit("%")), F.lit("n/a"))
    line = F.concat_ws(" | ", "metric", F.format_number("old_value", 2), F.format_number("new_value", 2), F.format_number("absolute_change", 2), pct, "direction", "signal")
    rows = F.transform(F.sort_array(F.collect_list(F.struct(F.col("metric"), line.alias("line")))), lambda x: F.concat(F.lit("| "), x["line"], F.lit(" |")))
    head = f"# {title}\n\n| metric | old | new | change | percent | direction | signal |\n|---|---|---|---|---|---|---|\n"
    return register.groupBy(*keys).agg(F.concat(F.lit(head), F.array_join(rows, "\n")).alias("brief"))


#: Word in a metric's name, what a rise means, what a fall means; the first word that occurs decides.
NOTES = [
    ("debt", "more leverage or refinancing need", "less debt to carry"),
    ("cash", "more liquidity at hand", "less liquidity at hand"),
    ("liquidity", "more liquidity at hand", "less liquidity at hand"),
    ("equity", "a larger base below creditors", "a smaller base below creditors"),
    ("income", "more cash from operations", "less cash from operations"),
    ("earnings", "more cash from operations", "less cash from operations"),
    ("interest", "a higher cost of financing", "a lower cost of financing"),
]
THEME_ITEMS = {
    "leverage_analysis": "Compare debt with operating income and interest cover.",
    "debt_liquidity": "Reconcile cash, credit lines and maturities with management's commentary.",
    "cash_flow_coverage": "Compare cash generation with debt service and capital spending.",
}
OTHER_ITEM = "Check commitments off the balance sheet and events after its date."


def analyst_note(metric: Column, moved: Column, percent: Column) -> Column:
    """A sentence on a metric's movement; without a known word it states the movement alone."""
    name = F.replace(metric, F.lit("_"), F.lit(" "))
    said = F.concat_ws(" ", name, F.when(moved > 0, "rose").when(moved < 0, "fell").otherwise("did not change"), F.when((moved != 0) & percent.isNotNull(), F.concat(F.lit("by "), F.format_number(F.abs(percent), 2), F.lit("%"))))
    meaning = F.when(moved == 0, F.lit(None))
    for word, up, down in NOTES:
        meaning = meaning.when(F.lower(metric).contains(word), F.when(moved > 0, up).otherwise(down))
    return F.concat(said, F.coalesce(F.concat(F.lit(": "), meaning), F.lit("")), F.lit("."))


def watch_items(register: DataFrame, keys: list[str], theme: str) -> DataFrame:
    """keys, items: what to look into, one for each adverse or favourable metric in their order, then the theme's."""
    name = F.replace("metric", F.lit("_"), F.lit(" "))
    ask = F.when(F.col("signal") == "adverse", F.concat(F.lit("Find what drove "), name, F.lit(" and whether it lasts."))).when(F.col("signal") == "favorable", F.concat(F.lit("Confirm that "), name, F.lit(" is not a matter of timing.")))
    listed = F.transform(F.sort_array(F.collect_list(F.when(ask.isNotNull(), F.struct("metric", ask.alias("ask"))))), lambda x: x["ask"])
    return register.groupBy(*keys).agg(F.array_distinct(F.concat(listed, F.array(F.lit(THEME_ITEMS.get(theme, OTHER_ITEM))))).alias("items"))


def conclusions(metrics: DataFrame, keys: list[str], theme: str) -> DataFrame:
    """keys, n_verified, conclusion: whether the theme is supported by verified metrics."""
    counted = metrics.groupBy(*keys).agg(F.sum((F.col("status") == "verified").cast("long")).alias("n_verified"), F.count(F.lit(1)).alias("n"))
    said = F.when(F.col("n_verified") == 0, F.lit(f"{theme} cannot be assessed: no verified metric.")).otherwise(F.format_string(f"{theme} rests on %d verified metrics of %d.", "n_verified", "n"))
    return counted.select(*keys, "n_verified", said.alias("conclusion"))


def citations(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, citations: the distinct citations of all results in the order of pos."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "citations"))), lambda x: x["citations"])
    return results.groupBy(*keys).agg(F.array_join(F.array_distinct(F.flatten(ordered)), "; ").alias("citations"))
