"""Numeric guardrails over prose: every financial number must be bound to a verified claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import rules
from tallyspark.functions.text import matches


def financial_numbers(text: Column) -> Column:
    """(found, start, end) of the financial quantities of a text, in code points."""
    return matches(text, rules.FINANCIAL_NUMBER)


def tags(line: Column) -> Column:
    return F.sort_array(F.array_distinct(F.regexp_extract_all(line, F.lit(rules.VERIFIED_TAG), 1)))


def scan(briefs: DataFrame, verified: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, ordinal, number, start, end, line, tags, bound: each financial number of each line, with its place in the line as it stands.

    A number is bound if its line has a tag of a verified claim. verified: claim_id, status. Lines never meet other
    documents' lines; tags meet the verified claims in one join.
    """
    lines = briefs.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).select(key, "line_no", F.trim("raw").alias("line"), tags(F.col("raw")).alias("tags"), financial_numbers(F.col("raw")).alias("numbers")).filter("size(numbers) > 0")
    ok = verified.filter("status = 'verified' AND claim_id IS NOT NULL").select(F.col("claim_id").alias("tag")).distinct()
    bound = lines.select(key, "line_no", F.explode("tags").alias("tag")).join(ok, "tag", "left_semi").select(key, "line_no", F.lit(True).alias("bound")).distinct()
    joined = lines.join(bound, [key, "line_no"], "left")
    rows = joined.select(key, "line_no", F.posexplode("numbers").alias("ordinal", "m"), "line", "tags", F.coalesce("bound", F.lit(False)).alias("bound"))
    return rows.select(key, "line_no", "ordinal", F.col("m.found").alias("number"), "m.start", "m.end", "line", "tags", "bound")


def report(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and severity for each document with numbers."""
    counts = scanned.groupBy(key).agg(F.count(F.lit(1)).alias("checked"), F.sum((~F.col("bound")).cast("int")).alias("blocked"))
    return counts.withColumn("severity", F.when(F.col("blocked") > 0, "block").otherwise("pass"))


def stripped(briefs: DataFrame, scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: briefs without the lines that hold a blocked number, with a closing note where any went."""
    blocked = scanned.filter("NOT bound").groupBy(key).agg(F.collect_set("line").alias("_blocked"))
    joined = briefs.join(blocked, key, "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_blocked", F.trim(x))), "\n")
    note = "\n\nNumeric guardrail note: unverified financial-number lines were removed before finalization."
    return joined.select(key, F.when(F.col("_blocked").isNull(), F.col("text")).otherwise(F.concat(kept, F.lit(note))).alias("text"))


def renderings(value: Column) -> Column:
    """The ways a stage may write a value."""
    whole, one, two = (F.format_number(value, n) for n in (0, 1, 2))
    plain = [F.replace(x, F.lit(","), F.lit("")) for x in (whole, one, two)]
    return F.array_distinct(F.array(value.cast("string"), *plain, whole, one, two))


def allowed_numbers(values: DataFrame, key: str, years: list[int]) -> DataFrame:
    """key, numbers: every way a stage may write one of the key's values, and the years, sorted; nulls have no rendering."""
    made = values.groupBy(key).agg(F.flatten(F.collect_set(renderings(F.col("value")))).alias("n"))
    own = F.filter("n", lambda x: x.isNotNull())
    return made.select(key, F.sort_array(F.array_distinct(F.concat(own, F.array(*(F.lit(str(y)) for y in sorted(years)))))).alias("numbers"))


def stage_numbers(line: Column) -> Column:
    """Numbers of a line, without $ and %, leaving out years (whole numbers from 1900 to 2100)."""
    found = F.transform(F.regexp_extract_all(line, F.lit(rules.STAGE_NUMBER), 0), lambda n: F.regexp_replace(n, r"^[$%]+|[$%]+$", ""))

    def is_year(n: Column) -> Column:
        v = F.regexp_replace(n, ",", "").try_cast("double")
        return F.coalesce((v == F.floor(v)) & v.between(1900, 2100), n == "")

    return F.filter(found, lambda n: ~is_year(n))


def stage_guard(texts: DataFrame, allowed: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, status, text, blocked_lines: lines with a number that is not allowed for the document are dropped.

    allowed: key, numbers (array of renderings).
    """
    joined = texts.join(allowed, key, "left")
    normal = F.transform(F.coalesce("numbers", F.array().cast("array<string>")), lambda n: F.replace(n, F.lit(","), F.lit("")))
    lines = joined.select(key, F.split("text", "\n").alias("lines"), normal.alias("ok"))

    def bad(line: Column) -> Column:
        return F.exists(stage_numbers(line), lambda n: ~F.array_contains("ok", F.replace(n, F.lit(","), F.lit(""))))

    out = lines.select(key, F.filter("lines", lambda x: ~bad(x)).alias("kept"), F.size(F.filter("lines", bad)).alias("blocked_lines"))
    return out.select(key, F.when(F.col("blocked_lines") > 0, "repaired").otherwise("pass").alias("status"), F.array_join("kept", "\n").alias("text"), "blocked_lines")
