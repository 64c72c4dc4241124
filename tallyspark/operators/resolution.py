"""Metric resolution: rules that accept or reject concepts and statement rows, calculated metrics, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import rules
from tallyspark.functions.text import contains_any
from tallyspark.operators.facts import first_in


def safe_concepts(spark: SparkSession) -> DataFrame:
    rows = [(m, c, s) for m, found in rules.SAFE_CONCEPTS.items() for c, s in found.items()]
    return spark.createDataFrame(rows, "metric string, concept string, safe_confidence double")


def rejection(concept: Column, metric: Column) -> Column:
    """(class, confidence) of the first rejection rule of the metric that fits the concept, or null."""
    low, pick = F.lower(concept), F.when(F.lit(False), F.lit(None))
    for name, _, any_of, unless, label, confidence in sorted(rules.REJECTIONS, key=lambda r: (r[0], r[1])):
        fits = F.lit(False)
        for part in any_of:
            fits = fits | (low == part[1:] if part.startswith("=") else low.contains(part))
        if unless is not None:
            fits = fits & ~low.contains(unless)
        pick = pick.when((metric == name) & fits, F.struct(F.lit(label).alias("class"), F.lit(confidence).alias("confidence")))
    return pick


def classified(inventory: DataFrame, metrics: list[str], terms_of: dict[str, list[str]] | None = None) -> DataFrame:
    """Every concept that a metric's search terms find, with its class, acceptance and confidence for that metric.

    terms_of gives each metric's terms, such as analysis.search_terms makes of its name and configured concepts (default: the fixed
    table). inventory: cik, fiscal_year, concept, unit, value. Metrics and rules are a fixed table, so this is one narrow pass.
    """
    terms = F.array(*(F.struct(F.lit(m).alias("metric"), contains_any(F.lower("concept"), (terms_of or rules.SEARCH_TERMS)[m]).alias("hit")) for m in metrics))
    asked = inventory.withColumn("m", F.explode(F.filter(terms, lambda t: t["hit"]))).withColumn("metric", F.col("m.metric")).drop("m")
    joined = asked.join(F.broadcast(safe_concepts(inventory.sparkSession)), ["metric", "concept"], "left")  # a fixed rule table
    wrong_unit = F.coalesce((F.col("unit") != "") & (F.col("unit") != "USD"), F.lit(False))
    safe = F.col("safe_confidence").isNotNull()
    no = rejection(F.col("concept"), F.col("metric"))
    return joined.withColumn("no", no).select(
        "cik",
        "fiscal_year",
        "metric",
        "concept",
        "value",
        F.when(wrong_unit, "not_relevant").when(safe, "same_metric").otherwise(F.coalesce("no.class", F.lit("not_auto_resolved"))).alias("class"),
        (~wrong_unit & safe).alias("accepted"),
        F.when(wrong_unit, F.lit(0.0)).when(safe, F.col("safe_confidence")).otherwise(F.coalesce("no.confidence", F.lit(0.2))).alias("confidence"),
    )


def resolved(candidates: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """One row for each (cik, fiscal_year, metric): status, concept, value, basis, accepted and rejected counts.

    A configured concept (metric, concept, priority) wins. Else one accepted candidate resolves, a single
    highest confidence resolves by rank, and a tie is ambiguous; without any the metric is unresolved.
    """
    keys = ["cik", "fiscal_year", "metric"]
    best = F.max(F.when(F.col("accepted"), F.col("confidence"))).over(Window.partitionBy(*keys))
    at_best = candidates.withColumn("is_best", F.col("accepted") & (F.col("confidence") == best))
    counted = at_best.groupBy(*keys).agg(
        F.sum(F.col("accepted").cast("long")).alias("n_accepted"),
        F.sum((~F.col("accepted")).cast("long")).alias("n_rejected"),
        F.sum(F.col("is_best").cast("long")).alias("n_best"),
        F.min(F.when(F.col("is_best"), F.struct("concept", "value"))).alias("pick"),
    )
    status = F.when(F.col("n_accepted") == 0, "unresolved").when((F.col("n_accepted") == 1) | (F.col("n_best") == 1), "resolved").otherwise("ambiguous")
    basis = F.when(F.col("n_accepted") == 0, "no_safe_candidate").when(F.col("n_accepted") == 1, "safe_alternate").when(F.col("n_best") == 1, "highest_confidence_alternate").otherwise("multiple_safe_candidates")
    ruled = counted.withColumns({"status": status, "basis": basis}).withColumns({c: F.when(F.col("status") == "resolved", F.col(f"pick.{c}")) for c in ("concept", "value")})
    out = ruled.select(*keys, "status", "basis", "concept", "value", "n_accepted", "n_rejected")
    if configured is None:
        return out
    chosen = first_in(candidates.join(configured, ["metric", "concept"]), keys, ["priority", "concept"]).select(*keys, F.col("concept").alias("own_concept"), F.col("value").alias("own_value"))
    joined, own = out.join(chosen, keys, "left"), F.col("own_concept").isNotNull()
    return joined.select(*keys, F.when(own, "resolved").otherwise(F.col("status")).alias("status"), F.when(own, "configured_concept").otherwise(F.col("basis")).alias("basis"), F.when(own, F.col("own_concept")).otherwise(F.col("concept")).alias("concept"), F.when(own, F.col("own_value")).otherwise(F.col("value")).alias("value"), "n_accepted", "n_rejected")


def with_related(candidates: DataFrame, out: DataFrame, most: int = 12) -> DataFrame:
    """The rows of resolved() with related (the concepts that were found and rejected, surest first, at most `most`) and a status for them.

    A metric without a safe candidate but with related concepts is related_only: they are listed for review and never used.
    """
    keys = ["cik", "fiscal_year", "metric"]
    order = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "concept")
    near = candidates.filter("NOT accepted").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    lists = near.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "concept", "class"))), lambda x: F.concat(x["concept"], F.lit(" ("), x["class"], F.lit(")"))).alias("related"))
    joined = out.join(lists, keys, "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))
    return joined.withColumn("status", F.when((F.col("status") == "unresolved") & (F.size("related") > 0), "related_only").otherwise(F.col("status")))


def statement_metric() -> Column:
    """The metrics that a statement row (statement_type, normalized_label, xbrl_concept) stands for.

    Fixed values: the labels, statement types and concepts of each metric.
    """
    label, kind = F.col("normalized_label"), F.col("statement_type")
    has = label.contains
    cash_flow, balance = kind == "cash_flow_statement", kind == "balance_sheet"
    tests = {
        "operating_cash_flow": cash_flow & has("net cash") & has("operating activities"),
        "capital_expenditures": cash_flow & ~contains_any(label, ["not yet paid", "incurred", "lease", "additional paid in capital"]) & ((has("property and equipment") & contains_any(label, ["purchase", "additions", "acquire"])) | has("capital expenditure")),
        "dividend_payments": cash_flow & has("dividend") & contains_any(label, ["paid", "payment"]) & ~contains_any(label, ["per share", "declared"]),
        "interest_expense": (kind == "income_statement") & ((has("interest expense") & ~has("income")) | F.coalesce(F.col("xbrl_concept").isin("InterestExpenseDebt", "InterestExpense", "InterestExpenseNonoperating"), F.lit(False))),
        "current_debt": balance & (has("short term debt") | (contains_any(label, ["current portion", "current maturities", "due within one year"]) & has("debt")) | has("loans and notes payable")),
        "long_term_debt": balance & has("long term debt") & ~contains_any(label, ["current", "within one year"]),
        "cash_and_equivalents": balance & (label == "cash and cash equivalents"),
    }
    return F.filter(F.array(*(F.when(test, F.lit(m)) for m, test in tests.items())), lambda m: m.isNotNull())


def statement_reject_reason(metric: Column) -> Column:
    """Why a related row is not the metric, or null."""
    has = F.col("normalized_label").contains
    capex = F.when(has("property plant and equipment net") | has("property and equipment net"), "balance_not_flow").when(has("not yet paid") | has("incurred"), "not_yet_paid").when(has("lease"), "lease").when(has("additional paid in capital"), "equity")
    interest = F.when(has("lease interest"), "lease_only").when(has("interest paid") | has("cash paid"), "cash_paid")
    return F.when(metric == "capital_expenditures", capex).when(metric == "interest_expense", interest)


#: What the register says of a rejected row.
REASONS = {
    "balance_not_flow": "PPE balance is not cash capital expenditure.",
    "not_yet_paid": "Capex incurred but not yet paid is not cash capex outflow.",
    "lease": "Lease obligations are not cash capex outflow.",
    "equity": "Additional paid-in capital is equity, not capex.",
    "lease_only": "Lease-only interest is not total interest expense.",
    "cash_paid": "Cash interest paid is not accrual interest expense.",
}


def rejected_rows(items: DataFrame, looked_at: int = 30, listed: int = 12) -> DataFrame:
    """accession, fiscal_year, metric, place, row_label, value, reason: rows that look like a metric and are not, by place.

    items: as for resolve_statements, with row_label. Of each filing's year the first looked_at rows are judged, and of those
    rejected for a metric the first listed are kept: what the register shows. Both are window limits, so no task holds more of a group.
    """
    year = ["accession", "fiscal_year"]
    first = Window.partitionBy(*year).orderBy("pos")
    near = items.filter("value IS NOT NULL").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= looked_at)
    judged = F.array(*(F.struct(F.lit(m).alias("metric"), statement_reject_reason(F.lit(m)).alias("code")) for m in ("capital_expenditures", "interest_expense")))
    found = near.select(*year, "pos", "row_label", "value", F.inline(judged)).filter("code IS NOT NULL")
    order = Window.partitionBy(*year, "metric").orderBy("pos")
    says = F.coalesce(*(F.when(F.col("code") == c, F.lit(t)) for c, t in REASONS.items()))
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= listed).select(*year, "metric", "place", "row_label", "value", says.alias("reason"))


def statement_register(items: DataFrame, metrics: list[str]) -> DataFrame:
    """accession, fiscal_year, metric, status, value, concept, confidence, n_rows, n_rejected: a row for each metric of each filing's year.

    A metric without a row that means it is a statement_row_not_found; rejected_rows lists what looked like it.
    """
    keys = ["accession", "fiscal_year", "metric"]
    asked = items.filter("value IS NOT NULL").select("accession", "fiscal_year").distinct().withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    rejects = rejected_rows(items).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rejected"))
    joined = asked.join(resolve_statements(items), keys, "left").join(rejects, keys, "left")
    status = F.when(F.col("n_rows").isNotNull(), "verified_statement").otherwise("statement_row_not_found")
    return joined.select(*keys, status.alias("status"), "value", "concept", "confidence", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), F.coalesce("n_rejected", F.lit(0).cast("long")).alias("n_rejected"))


def resolve_statements(items: DataFrame) -> DataFrame:
    """(accession, fiscal_year, metric) -> value, concept, confidence, n_rows from statement rows.

    items: accession, fiscal_year, pos, statement_type, normalized_label, value, xbrl_concept, confidence. The
    first high-confidence row wins, else the first. Current debt takes a total row where there is one;
    else the magnitudes of its distinct labels (the last value of each) are added.
    """
    keys = ["accession", "fiscal_year", "metric"]
    matched = items.filter("value IS NOT NULL").withColumn("metric", F.explode(statement_metric()))
    best = first_in(matched, keys, [F.desc(F.col("confidence") == "high"), "pos"]).select(*keys, "value", "xbrl_concept", "confidence")
    debt = matched.filter("metric = 'current_debt'")
    parts = first_in(debt, [*keys, "normalized_label"], [F.desc("pos")])
    summed = parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.abs("value")).alias("total"),
        F.max(F.when(F.col("normalized_label").startswith("total"), F.col("value"))).alias("total_row"),
        F.max("value").alias("only"),
        F.bool_and(F.col("confidence") == "high").alias("all_high"),
    )
    joined, is_sum = best.join(summed, keys, "left"), (F.col("n_rows") > 1) & F.col("total_row").isNull()
    value = F.when(F.col("n_rows").isNull(), F.col("value")).when(F.col("total_row").isNotNull(), F.col("total_row")).when(is_sum, F.col("total")).otherwise(F.col("only"))
    confidence = F.when(F.coalesce(is_sum, F.lit(False)), F.when(F.col("all_high"), "high").otherwise("medium")).otherwise(F.col("confidence"))
    return joined.select(*keys, value.alias("value"), F.concat(F.lit("statement:"), F.coalesce("xbrl_concept", F.lit(""))).alias("concept"), confidence.alias("confidence"), F.coalesce("n_rows", F.lit(1).cast("long")).alias("n_rows"))


def with_calculated(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics (keys, metric, value) with free cash flow where it is missing and total debt from its parts where both exist.

    One aggregation holds the four parts of a key; the new rows join the old by union.
    """

    def of(m: str) -> Column:
        return F.max(F.when(F.col("metric") == m, F.col("value")))

    parts = metrics.groupBy(*keys).agg(*(of(m).alias(m) for m in ("operating_cash_flow", "capital_expenditures", "free_cash_flow", "current_debt", "long_term_debt")))
    cash = F.when(F.col("free_cash_flow").isNull(), F.col("operating_cash_flow") - F.abs("capital_expenditures"))
    made = parts.select(*keys, F.explode(F.array(F.struct(F.lit("free_cash_flow").alias("metric"), cash.alias("value")), F.struct(F.lit("total_debt").alias("metric"), (F.col("current_debt") + F.col("long_term_debt")).alias("value")))).alias("m")).select(*keys, "m.metric", "m.value").filter("value IS NOT NULL")
    kept = metrics.select(*keys, "metric", "value").join(made.select(*keys, "metric"), [*keys, "metric"], "left_anti")
    return kept.withColumn("source", F.lit("direct")).unionByName(made.withColumn("source", F.lit("calculated")))


def expanded_metrics(metrics: list[str]) -> list[str]:
    """The metrics with their missing dependencies appended, one level deep."""
    return list(dict.fromkeys([*metrics, *(d for m in metrics for d in rules.DEPENDENCIES.get(m, []))]))


def coverage_gaps(values: DataFrame, keys: list[str], wanted: list[str], years: list[int]) -> DataFrame:
    """keys, metric, covered_years, missing_years, diagnosis for every wanted metric of every key."""
    found = values.filter(F.col("metric").isin(wanted) & F.col("fiscal_year").isin(years) & F.col("value").isNotNull()).groupBy(*keys, "metric").agg(F.sort_array(F.collect_set("fiscal_year")).alias("covered_years"))
    asked = values.select(*keys).distinct().withColumn("metric", F.explode(F.array(*map(F.lit, wanted))))
    joined = asked.join(found, [*keys, "metric"], "left").withColumn("covered_years", F.coalesce("covered_years", F.array().cast("array<int>")))
    missing = F.array_except(F.array(*(F.lit(y) for y in sorted(years))), "covered_years")
    diagnosis = F.when(F.size("missing_years") == 0, "covered").when(F.size("covered_years") > 0, "partially_covered").otherwise("not_covered")
    return joined.withColumn("missing_years", missing).withColumn("diagnosis", diagnosis)
