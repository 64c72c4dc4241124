"""Readers and writers: chunk JSONL, ticker directory, company facts, submissions, configuration, artifacts."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import cik10, last_entries
from tallyspark.operators.facts import first_in

CHUNK = "company string, ticker string, cik string, fiscal_year int, filing_type string, section_name string, section_type string, chunk_id string, text string, source_url string, filing_date string, accession_number string, char_start int, char_end int"
FACTS = "entityName string, cik string, facts map<string, map<string, struct<units: map<string, array<struct<fy: int, fp: string, form: string, filed: string, end: string, accn: string, val: double>>>>>>"
SUBMISSIONS = "cik string, name string, tickers array<string>, exchanges array<string>, sic string, filings struct<recent: struct<form: array<string>, accessionNumber: array<string>, filingDate: array<string>, reportDate: array<string>, fy: array<int>, primaryDocument: array<string>>>"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; blank lines are skipped, a line of another shape fails the read."""
    return spark.read.schema(CHUNK).option("mode", "FAILFAST").json(path)


def tickers(spark: SparkSession, path: str) -> DataFrame:
    """ticker, title, cik (ten digits), pos from a ticker directory {index: {ticker, title, cik_str}}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<ticker: string, title: string, cik_str: long>>").alias("m"))
    rows = raw.select(F.explode("m").alias("idx", "r"))
    return rows.select(F.upper("r.ticker").alias("ticker"), F.col("r.title").alias("title"), cik10(F.col("r.cik_str")).alias("cik"), F.col("idx").cast("int").alias("pos"))


def submissions(raw: DataFrame) -> DataFrame:
    """Parse a column json of submissions; cik, name, tickers, exchanges, sic, recent."""
    parsed = raw.select(F.from_json("json", SUBMISSIONS).alias("s"))
    return parsed.select(cik10(F.col("s.cik")).alias("cik"), "s.name", "s.tickers", "s.exchanges", "s.sic", F.col("s.filings.recent").alias("recent"))


def recent_filings(subs: DataFrame) -> DataFrame:
    """cik, pos, form, accession, filing_date, report_date, fy, document: the struct of arrays as rows."""
    r = "recent"
    zipped = F.arrays_zip(*(F.col(f"{r}.{c}").alias(c) for c in ("form", "accessionNumber", "filingDate", "reportDate", "fy", "primaryDocument")))
    rows = subs.select("cik", F.posexplode(zipped).alias("pos", "f"))
    return rows.select("cik", "pos", F.col("f.form").alias("form"), F.col("f.accessionNumber").alias("accession"), F.col("f.filingDate").try_cast("date").alias("filing_date"), F.col("f.reportDate").try_cast("date").alias("report_date"), F.col("f.fy").alias("fy"), F.col("f.primaryDocument").alias("document"))


def company_info(subs: DataFrame) -> DataFrame:
    """cik, name, ticker, sector, sic, years: distinct years of annual filings, by report date else filing date, latest first."""
    years = F.transform(F.filter(F.arrays_zip(F.col("recent.form").alias("form"), F.col("recent.reportDate").alias("r"), F.col("recent.filingDate").alias("d")), lambda f: f["form"].isin("10-K", "10-K/A")), lambda f: F.year(F.coalesce(f["r"].try_cast("date"), f["d"].try_cast("date"))))
    return subs.select("cik", "name", F.get("tickers", F.lit(0)).alias("ticker"), F.get("exchanges", F.lit(0)).alias("sector"), "sic", F.sort_array(F.array_distinct(F.filter(years, lambda y: y.isNotNull())), asc=False).alias("years"))


def company_facts(raw: DataFrame) -> DataFrame:
    """cik, namespace, concept, unit, pos, fy, fp, form, filed, end, val from a column json of company facts."""
    parsed = raw.select(F.from_json("json", FACTS).alias("j")).select(cik10(F.col("j.cik")).alias("cik"), F.explode("j.facts").alias("namespace", "concepts"))
    units = parsed.select("cik", "namespace", F.explode("concepts").alias("concept", "c")).select("cik", "namespace", "concept", F.explode("c.units").alias("unit", "rows"))
    return units.select("cik", "namespace", "concept", "unit", F.posexplode("rows").alias("pos", "r")).select("cik", "namespace", "concept", "unit", "pos", "r.fy", "r.fp", "r.form", F.col("r.filed").try_cast("date").alias("filed"), F.col("r.end").try_cast("date").alias("end"), "r.val")


def latest_good(raw: DataFrame, schema: str = FACTS) -> DataFrame:
    """cik, version, json of the last version of each landed file that can be read whole; a broken later one does not hide it.

    raw: cik, version, json. Files without any good version give no row; see broken() for what was passed over.
    """
    return first_in(_with_state(raw, schema).filter("NOT is_broken").drop("is_broken"), ["cik"], [F.desc("version")])


def broken(raw: DataFrame, schema: str = FACTS) -> DataFrame:
    """cik, version of the landed files that cannot be read whole."""
    return _with_state(raw, schema).filter("is_broken").select("cik", "version")


def _with_state(raw: DataFrame, schema: str) -> DataFrame:
    parsed = F.from_json("json", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"})
    return raw.withColumn("is_broken", F.col("json").isNull() | parsed["_corrupt_record"].isNotNull())


#: The concepts of each metric of an XML instance, first choice first.
INSTANCE_CONCEPTS = {
    "total_debt": ["Debt", "ShortTermBorrowings", "LongTermDebt"],
    "shareholders_equity": ["StockholdersEquity", "ShareholdersEquity"],
    "total_assets": ["Assets"],
    "total_liabilities": ["Liabilities"],
    "interest_expense": ["InterestExpense"],
    "operating_cash_flow": ["OperatingActivitiesCashFlow"],
    "current_assets": ["AssetsCurrent"],
    "current_liabilities": ["LiabilitiesCurrent"],
}


def instance_metrics(facts: DataFrame) -> DataFrame:
    """doc_id, year, metric, concept, value from the rows of xml_metrics: of each metric's concepts the first with a value in the year.

    The list of concepts is part of the expression, so a row finds its metric by itself; the first value in the document's order counts.
    """
    choices = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(c).alias("c"), F.lit(i).alias("priority")) for m, found in INSTANCE_CONCEPTS.items() for i, c in enumerate(found)))
    named = facts.filter("value IS NOT NULL AND year IS NOT NULL").withColumn("m", F.get(F.filter(choices, lambda x: x["c"] == F.col("concept")), F.lit(0))).filter("m IS NOT NULL")
    first = named.groupBy("doc_id", "year", F.col("m.metric").alias("metric")).agg(F.min(F.struct("m.priority", "pos", "concept", "value")).alias("f"))
    return first.select("doc_id", "year", "metric", "f.concept", "f.value")


def instance_summary(docs: DataFrame) -> DataFrame:
    """doc_id, fiscal_year (the latest year of a context; 0 without one), names (sorted distinct names of its elements).

    An element counts if its namespace is one of XBRL's vocabularies, or if it has none and is no context. docs: doc_id, doc.
    """
    years = F.transform(F.regexp_extract_all("doc", F.lit(r"<(?:[\w.-]+:)?(?:instant|endDate)\s*>\s*([0-9]{4})"), 1), lambda y: y.try_cast("int"))
    declared = F.zip_with(F.regexp_extract_all("doc", F.lit(r"xmlns:?([\w.-]*)\s*=\s*[\"']([^\"']*)"), 1), F.regexp_extract_all("doc", F.lit(r"xmlns:?([\w.-]*)\s*=\s*[\"']([^\"']*)"), 2), lambda p, u: F.struct(p.alias("p"), u.alias("u")))
    known = F.transform(F.filter("declared", lambda d: d["u"].contains("xbrl.us") | d["u"].contains("xbrl.ifrg")), lambda d: d["p"])
    bare = ~F.exists("declared", lambda d: d["p"] == "")
    tag = r"<(?:([\w.-]+):)?([\w.-]+)"
    elements = F.zip_with(F.regexp_extract_all("doc", F.lit(tag), 1), F.regexp_extract_all("doc", F.lit(tag), 2), lambda p, n: F.struct(p.alias("p"), n.alias("n")))
    counted = F.filter("elements", lambda e: F.array_contains("known", e["p"]) | ((e["p"] == "") & F.col("bare") & ~F.endswith(e["n"], F.lit("context"))))
    read = docs.select("doc_id", F.coalesce(F.array_max(years), F.lit(0)).alias("fiscal_year"), declared.alias("declared"), elements.alias("elements"))
    return read.select("doc_id", "fiscal_year", "elements", known.alias("known"), bare.alias("bare")).select("doc_id", "fiscal_year", F.sort_array(F.array_distinct(F.transform(counted, lambda e: e["n"]))).alias("names"))


def xml_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, pos, concept, year, value (in millions over a million) of an XBRL instance document in column doc.

    A document's contexts are a map in its row, in which its elements look themselves up; of contexts with one id the last
    counts, and elements of an unknown context are left out. Nothing is shuffled.
    """
    blocks = F.regexp_extract_all("doc", F.lit(r"(?s)<(?:[\w.-]+:)?context\b.*?</(?:[\w.-]+:)?context>"), 0)
    year = lambda b: F.regexp_extract(b, r"<(?:[\w.-]+:)?(?:instant|endDate)\s*>\s*([0-9]{4})", 1).try_cast("int")
    known = last_entries(F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"\bid=[\"']([^\"']*)", 1).alias("key"), year(b).alias("value"))))
    tag = r"<(?:[\w.-]+:)?([\w.-]+)\b[^>]*contextRef=[\"']\s*([^\"']*?)\s*[\"'][^>]*>\s*(-?[0-9][0-9.]*)\s*<"
    both = F.arrays_zip(F.regexp_extract_all("doc", F.lit(tag), 1).alias("concept"), F.regexp_extract_all("doc", F.lit(tag), 2).alias("context"), F.regexp_extract_all("doc", F.lit(tag), 3).alias("value"))
    found = F.transform(F.array(known), lambda m: F.transform(both, lambda f, i: F.struct(i.alias("pos"), f["concept"].alias("concept"), F.map_contains_key(m, f["context"]).alias("known"), F.try_element_at(m, f["context"]).alias("year"), f["value"].try_cast("double").alias("v"))))[0]
    rows = docs.select("doc_id", F.inline(found)).filter("known")
    return rows.select("doc_id", "pos", "concept", "year", F.when(F.col("v") > 1e6, F.col("v") / 1e6).otherwise(F.col("v")).alias("value"))


def config_rows(spark: SparkSession, entries: dict[str, dict[str, Any]], key: str, schema: str) -> DataFrame:
    """A configuration mapping as a dimension; key names the column that holds the entry's name. The first of equal names wins."""
    names = [f.strip().split(" ")[0] for f in re.split(r",(?![^<]*>)", schema)]
    return spark.createDataFrame([tuple({key: name, **entry}.get(c) for c in names) for name, entry in entries.items()], schema)


def load_yaml(path: str) -> dict[str, Any]:
    """A YAML file as a mapping. The YAML package is optional, so it is imported only here."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def skill(markdown: str) -> dict[str, list[str]]:
    """Heading -> list items of a markdown document."""
    found: dict[str, list[str]] = {}
    heading = ""
    for line in markdown.splitlines():
        if m := re.match(r"#+\s+(.*)", line):
            heading = m[1].strip().lower()
        elif (m := re.match(r"\s*[-*]\s+(.*)", line)) and heading:
            found.setdefault(heading, []).append(m[1].strip().strip("`"))
    return found


def write_artifact(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as JSON lines; columns in the order of their names."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)
