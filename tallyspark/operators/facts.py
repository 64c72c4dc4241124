"""Fact selection: best annual fact, filing choice, fact store, priority lists, concept inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import rules
from tallyspark.functions.text import contains_any, scaled_usd


def first_in(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by order. Catalyst limits groups before the shuffle, so a hot key is cheap."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def best_annual_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's annual-form facts the one of the full year, then the latest filed, then the latest end; ties to the smaller pos."""
    annual = facts.filter(F.col("form").isin(rules.ANNUAL_FORMS))
    return first_in(annual, keys, [F.desc(F.coalesce(F.col("fp") == "FY", F.lit(False))), F.desc("filed"), F.desc("end"), "pos"])


def filing_tier(fiscal_year: Column) -> Column:
    """4 for the filing's own fiscal year, 3 for its report year, 2 for its filing year, 1 for the year before that."""
    return F.when(F.col("fy") == fiscal_year, 4).when(F.year("report_date") == fiscal_year, 3).when(F.year("filing_date") == fiscal_year, 2).when(F.year("filing_date") == fiscal_year + 1, 1).otherwise(0)


def select_filings(filings: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (cik, fiscal_year) the annual filing of the highest tier, then the latest filed.

    filings: cik, form, accession, filing_date, report_date, fy, pos. Only filings of a tier above 0 count.
    """
    joined = wanted.join(filings.filter(F.col("form").isin(rules.ANNUAL_FORMS)), "cik").withColumn("tier", filing_tier(F.col("fiscal_year"))).filter("tier > 0")
    return first_in(joined, ["cik", "fiscal_year"], [F.desc("tier"), F.desc("filing_date"), "pos"])


def first_filings(filings: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (cik, fiscal_year) the first exact 10-K in source order (pos) that was filed in that year or the next: the older rule."""
    joined = wanted.join(filings.filter("form = '10-K'"), "cik").filter(F.year("filing_date").isin(F.col("fiscal_year"), F.col("fiscal_year") + 1))
    return first_in(joined, ["cik", "fiscal_year"], ["pos"])


def filing_years(filings: DataFrame) -> DataFrame:
    """cik, years: the distinct years in which an exact 10-K was filed, latest first; companies without one get an empty list."""
    year = F.when(F.col("form") == "10-K", F.year("filing_date"))
    return filings.groupBy("cik").agg(F.sort_array(F.collect_set(year), asc=False).alias("years"))


def select_or_substitute(filings: DataFrame, form: str, fiscal_year: int) -> DataFrame:
    """The first filing of the form and year of each cik, else its first 10-K or 10-Q, flagged as a substitution."""
    exact = (F.col("form") == form) & (F.col("fy") == fiscal_year)
    usable = filings.filter(exact | F.col("form").isin("10-K", "10-Q")).withColumn("is_substitution", ~exact)
    return first_in(usable, ["cik"], ["is_substitution", "pos"])


def fact_rank() -> Column:
    """Confidence, then source, then whether no review is required, as one comparable value."""
    confidence = F.coalesce(*(F.when(F.col("confidence") == k, F.lit(v)) for k, v in rules.CONFIDENCE_RANK.items()), F.lit(0))
    source = F.coalesce(*(F.when(F.col("fact_source") == k, F.lit(v)) for k, v in rules.SOURCE_RANK.items()), F.lit(0))
    return F.struct(confidence.alias("c"), source.alias("s"), (~F.coalesce("review_required", F.lit(False))).alias("r"))


def facts_by_key(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The store's row for each key: the highest rank, and the first of equals."""
    return first_in(facts.withColumn("_rank", fact_rank()), keys, [F.desc("_rank"), "pos"]).drop("_rank")


def facts_by_id(facts: DataFrame, keys: list[str] = ["fact_id"]) -> DataFrame:  # noqa: B006
    """The store's row for each id: the last one added."""
    return first_in(facts, keys, [F.desc("pos")])


def by_priority(facts: DataFrame, priorities: DataFrame, keys: list[str]) -> DataFrame:
    """For each key and metric the first concept of its priority list that has a value.

    priorities: metric, concept, priority; a rule table, which Catalyst broadcasts while it is small.
    """
    joined = facts.filter("value IS NOT NULL").join(priorities, "concept")
    return first_in(joined, [*keys, "metric"], ["priority", "pos"])


def unambiguous(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The first value of each key, and whether all its values agree (within 1e-9)."""
    first = first_in(facts.filter("value IS NOT NULL"), keys, ["pos"]).select(*keys, "value")
    spread = facts.groupBy(*keys).agg((F.max("value") - F.min("value") < 1e-9).alias("agrees"))
    return first.join(spread, keys)


def inventory(facts: DataFrame, fiscal_year: Column | int) -> DataFrame:
    """The concept inventory of a year: for each (cik, namespace, concept) the best annual fact, scaled.

    facts: cik, namespace, concept, unit, fy, fp, form, filed, end, val, pos.
    """
    year = F.lit(fiscal_year) if isinstance(fiscal_year, int) else fiscal_year
    best = best_annual_facts(facts.filter((F.col("fy") == year) & F.col("val").isNotNull()), ["cik", "namespace", "concept"])
    return best.select("cik", "namespace", "concept", "unit", "fy", "filed", "end", scaled_usd(F.col("val")).alias("value"), (F.col("val") == 0).alias("is_zero"))


def last_namespace(inventory_rows: DataFrame) -> DataFrame:
    """One row for each (cik, concept): the lexicographically last namespace wins."""
    return first_in(inventory_rows, ["cik", "concept"], [F.desc("namespace")])


def search_concepts(concepts: DataFrame, terms: list[str]) -> DataFrame:
    """Rows whose concept holds any of the terms of three letters or more, whatever the case."""
    return concepts.filter(contains_any(F.lower("concept"), [t.lower() for t in terms if len(t) >= 3]))


def discover_concepts(facts: DataFrame, terms: list[str], years: list[int]) -> DataFrame:
    """concept, covered_years, n_years, has_zero of the matching concepts; most years first by the rank column."""
    best = best_annual_facts(search_concepts(facts, terms).filter(F.col("fy").isin(years) & F.col("val").isNotNull()), ["cik", "concept", "fy"])
    found = best.groupBy("cik", "concept").agg(F.sort_array(F.collect_set("fy")).alias("covered_years"), F.bool_or(F.col("val") == 0).alias("has_zero"))
    counted = found.withColumn("n_years", F.size("covered_years"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("n_years"), "concept")))


def year_pairs(facts: DataFrame, keys: list[str], old_year: int, new_year: int) -> DataFrame:
    """keys, old_value, new_value of the keys that have both years; one pass and one shuffle instead of a self join."""
    both = facts.filter(F.col("fiscal_year").isin(old_year, new_year)).groupBy(*keys)
    paired = both.agg(F.max(F.when(F.col("fiscal_year") == old_year, F.col("value"))).alias("old_value"), F.max(F.when(F.col("fiscal_year") == new_year, F.col("value"))).alias("new_value"))
    return paired.filter("old_value IS NOT NULL AND new_value IS NOT NULL")


def first_package_rows(items: DataFrame) -> DataFrame:
    """Statement rows of each (ticker, fiscal_year) from the first package that has any: the year's own, else the next year's.

    items: ticker, accession, package_year, fiscal_year, pos and more. Rows of other packages are dropped.
    """
    near = items.filter((F.col("package_year") == F.col("fiscal_year")) | (F.col("package_year") == F.col("fiscal_year") + 1))
    first = near.groupBy("ticker", "fiscal_year").agg(F.min(F.struct("package_year", "accession")).alias("p")).select("ticker", "fiscal_year", F.col("p.accession").alias("accession"))
    return near.join(first, ["ticker", "fiscal_year", "accession"], "left_semi")


def default_years(years: Column) -> Column:
    """The two years that a task takes without a choice: the last two of the descending list."""
    return F.slice(years, F.greatest(F.size(years) - 1, F.lit(1)), 2)
