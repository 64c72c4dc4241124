"""Whole briefs and answers: one aggregation gathers what a company or task has, and its sections are written from that row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import contains_any, preview
from tallyspark.operators.reports import OTHER_ITEM, THEME_ITEMS, credit_signal

#: The order of sections in an answer's evidence; other types come last.
SECTION_ORDER = {"liquidity": 0, "credit_facilities": 1, "debt": 2, "mda": 3}
MARKS = {"verified": "✓", "unsupported": "✗", "low_confidence": "⚠"}
SIGNALS = [("adverse", "Pressure"), ("favorable", "Support"), ("mixed", "Depends on context")]


def money(value: Column) -> Column:
    return F.coalesce(F.format_number(value, 2), F.lit("n/a"))


def listed(items: Column, none: str) -> Column:
    """Lines of a list; none where there are none."""
    return F.when(F.size(items) == 0, F.lit(none)).otherwise(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def joined_sections(sections: list[tuple[str, Column]]) -> Column:
    """Markdown of titled sections in their order; a null body leaves its section out."""
    return F.array_join(F.filter(F.array(*(F.concat(F.lit(f"## {title}\n\n"), body) for title, body in sections)), lambda s: s.isNotNull()), "\n\n")


def full_brief(metrics: DataFrame, keys: list[str], old_year: int, new_year: int, theme: str, evidence: DataFrame | None = None) -> DataFrame:
    """keys, brief, n_sections: nine sections on each key's metrics, and a tenth with its narrative where evidence (keys, narrative) has one.

    metrics: keys, metric, fiscal_year, value, unit, status; one row a metric and year, of which a key has a bounded number. They are gathered once,
    by year and metric; the sections are then written in the row. Years without rows are left out of the tables; null values show as n/a.
    """
    row = F.struct("fiscal_year", "metric", F.col("value").cast("double").alias("value"), "unit", "status")
    held = metrics.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("m"))
    m, good = F.col("m"), lambda e: (e["status"] == "verified") & e["value"].isNotNull()
    of = lambda year: F.filter(m, lambda e: (e["fiscal_year"] == year) & good(e))

    def change(a: Column) -> Column:
        b = F.get(F.filter(of(new_year), lambda e: e["metric"] == a["metric"]), F.lit(0))
        moved = b["value"] - a["value"]
        return F.struct(a["metric"].alias("metric"), a["value"].alias("o"), b["value"].alias("n"), moved.alias("moved"), F.try_divide(moved * 100, F.abs(a["value"])).alias("percent"), credit_signal(a["metric"], moved).alias("signal"))

    wide = held.withColumn("changes", F.filter(F.transform(of(old_year), change), lambda c: c["n"].isNotNull()))
    c = F.col("changes")
    words = lambda x: F.replace(x["metric"], F.lit("_"), F.lit(" "))
    moved = lambda x: F.concat(words(x), F.lit(" from "), money(x["o"]), F.lit(" to "), money(x["n"]), F.lit(" ("), F.coalesce(F.concat(F.format_number(x["percent"], 1), F.lit("%")), F.lit("n/a")), F.lit(")"))
    of_signal = lambda s: F.filter(c, lambda x: x["signal"] == s)
    read = F.array_join(F.filter(F.array(*(F.when(F.size(of_signal(s)) > 0, F.concat(F.lit(f"**{name}**\n"), listed(F.transform(of_signal(s), moved), ""))) for s, name in SIGNALS)), lambda x: x.isNotNull()), "\n\n")
    shown = lambda e: F.concat(F.lit("| "), e["metric"], F.lit(" | "), F.when(e["value"].isNull(), F.lit("n/a")).otherwise(F.concat_ws(" ", F.format_number(e["value"], 2), e["unit"])), F.lit(" | "), F.coalesce(*(F.when(e["status"] == s, F.lit(mark)) for s, mark in MARKS.items()), F.lit("?")), F.lit(" "), e["status"], F.lit(" |"))
    years = F.array_sort(F.array_distinct(F.transform(m, lambda e: e["fiscal_year"])))
    table = lambda y: F.concat(F.lit("### Fiscal "), y.cast("string"), F.lit("\n\n| Metric | Value | Status |\n|---|---|---|\n"), F.array_join(F.transform(F.filter(m, lambda e: e["fiscal_year"] == y), shown), "\n"))
    change_row = lambda x: F.concat(F.lit("| "), x["metric"], F.lit(" | "), money(x["o"]), F.lit(" | "), money(x["n"]), F.lit(" | "), money(x["moved"]), F.lit(" | "), x["signal"], F.lit(" |"))
    changes = F.when(F.size(c) == 0, F.lit("No metric is verified in both years.")).otherwise(F.concat(F.lit(f"| Metric | {old_year} | {new_year} | Change | Signal |\n|---|---|---|---|---|\n"), F.array_join(F.transform(c, change_row), "\n")))
    count = lambda some: F.size(some).cast("string")
    verified, open_ = F.filter(m, good), F.filter(m, lambda e: ~good(e))
    up, down = F.size(of_signal("adverse")), F.size(of_signal("favorable"))
    overall = F.when(F.size(c) == 0, "open").when(up > down, "weaker").when(down > up, "stronger").otherwise("balanced")
    sections = [
        ("Summary", F.concat(count(verified), F.lit(" of "), count(m), F.lit(f" values are verified for fiscal {old_year} and {new_year}."))),
        ("Credit reading", F.when(F.size(c) == 0, F.lit("No direction can be read from these values.")).otherwise(read)),
        ("Key metrics", F.array_join(F.transform(years, table), "\n\n")),
        ("Verified changes", changes),
        ("Watch items", listed(F.concat(F.transform(of_signal("adverse"), lambda x: F.concat(F.lit("What drove "), words(x), F.lit("?"))), F.array(F.lit(THEME_ITEMS.get(theme, OTHER_ITEM)))), "")),
        ("Basis", F.concat(count(verified), F.lit(" values compared by rule; "), count(c), F.lit(" changes calculated."))),
        ("Evidence", F.col("narrative")) if evidence is not None else ("Evidence", F.lit(None).cast("string")),
        ("Limits", listed(F.transform(open_, lambda e: F.concat(e["metric"], F.lit(" "), e["fiscal_year"].cast("string"), F.lit(": "), e["status"])), "All values are verified.")),
        ("Questions", listed(F.transform(of_signal("favorable"), lambda x: F.concat(F.lit("Will "), words(x), F.lit(" last?"))), "None from these values.")),
        ("Conclusion", F.concat(F.lit(f"{theme.replace('_', ' ')}: "), overall, F.lit("."))),
    ]
    if evidence is not None:
        wide = wide.join(evidence.select(*keys, "narrative"), keys, "left")
    body = joined_sections(sections)
    title = F.concat(F.lit("# "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)), F.lit(f": {theme.replace('_', ' ')}\n\n"))
    return wide.select(*keys, F.concat(title, body).alias("brief"), F.size(F.regexp_extract_all(body, F.lit(r"(?m)^## "), 0)).cast("long").alias("n_sections"))


Choice = tuple[int | None, list[str] | None, list[str] | None]


def picks(evidence: DataFrame, wanted: dict[str, list[Choice]], keys: list[str], shown: int = 160, table: int = 12) -> DataFrame:
    """keys, a column for each name of wanted with its chunk (chunk_id, fiscal_year, section_name, said), and the evidence table.

    evidence: keys, chunk_id, fiscal_year, section_type, section_name, text, reranker_score. Each name has choices of (year, section types, phrases),
    first choice first; a chunk that fits an earlier choice goes before one that fits a later one, and of equals the first by year,
    section, falling score and chunk_id counts. All names are found in one aggregation, which keeps a chunk for each.
    table holds the first rows of all evidence in that order: what the answer shows.
    """
    place = F.coalesce(*(F.when(F.col("section_type") == s, F.lit(i)) for s, i in SECTION_ORDER.items()), F.lit(9))
    order = [F.col("fiscal_year").alias("y"), place.alias("s"), (-F.col("reranker_score")).alias("r"), F.col("chunk_id").alias("c")]
    chunk = F.struct("chunk_id", "fiscal_year", "section_name", preview(F.col("text"), shown).alias("said"), "reranker_score")
    found = []
    for name, choices in wanted.items():
        rank = F.lit(None).cast("int")
        for i, (year, sections, phrases) in reversed(list(enumerate(choices))):
            fits = F.lit(True)
            if year is not None:
                fits = fits & (F.col("fiscal_year") == year)
            if sections:
                fits = fits & F.col("section_type").isin(sections)
            if phrases:
                fits = fits & contains_any(F.lower("text"), phrases)
            rank = F.when(fits, F.lit(i)).otherwise(rank)
        found.append(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), *order, chunk.alias("chunk"))))["chunk"].alias(name))
    return evidence.groupBy(*keys).agg(*found).join(first_rows(evidence, keys, order, chunk, table), keys)


def first_rows(evidence: DataFrame, keys: list[str], order: list[Column], chunk: Column, most: int) -> DataFrame:
    """The first rows of each key's evidence, cut before the shuffle by Spark's window limit."""
    from pyspark.sql.window import Window

    placed = evidence.withColumn("_o", F.struct(*order)).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_o"))).filter(F.col("_n") <= most)
    return placed.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", chunk.alias("chunk")))), lambda x: x["chunk"]).alias("evidence_table"))


def cited(chunk: Column) -> Column:
    return F.concat(F.lit("["), chunk["chunk_id"].cast("string"), F.lit("]"))


def synthesized(found: DataFrame, results: DataFrame, coverage: DataFrame, keys: list[str], topics: list[tuple[str, list[str], list[str]]], explained: list[str], trace: str) -> DataFrame:
    """keys, answer, n_claims: a cited answer for each row of picks.

    topics: title, metrics, names of picks: a topic tells its verified changes (results: keys, metric, old_value, new_value, status, source), else what was
    picked for it. explained names the picks of management's words. coverage: keys, missing, decision. Results of a key are gathered
    once and stay in the order of their metrics; a task without results or coverage still gets an answer.
    """
    row = F.struct("metric", F.col("old_value").cast("double").alias("o"), F.col("new_value").cast("double").alias("n"), "status", F.col("source").cast("string").alias("source"))
    gathered = results.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("results"))
    none = F.array().cast("array<struct<metric:string,o:double,n:double,status:string,source:string>>")
    rows = found.join(gathered, keys, "left").join(coverage.select(*keys, "missing", "decision"), keys, "left").withColumn("results", F.coalesce("results", none))
    good, blocked = F.filter("results", lambda r: r["status"] == "verified"), F.filter("results", lambda r: F.coalesce(r["status"] != "verified", F.lit(True)))
    words = lambda r: F.replace(r["metric"], F.lit("_"), F.lit(" "))
    told = lambda r: F.concat(words(r), F.lit(" went from "), money(r["o"]), F.lit(" to "), money(r["n"]), F.lit(" ["), r["source"], F.lit("]"))
    said = lambda name: F.when(F.col(name).isNotNull(), F.concat(F.col(name)["fiscal_year"].cast("string"), F.lit(": "), F.col(name)["said"], F.lit(" "), cited(F.col(name))))
    present = lambda *columns: F.filter(F.array(*columns), lambda x: x.isNotNull())
    sections, claims = [], F.lit(0)
    for title, metrics, names in topics:
        own = F.filter(good, _among(metrics))
        lines = F.when(F.size(own) > 0, F.transform(own, told)).otherwise(present(*(said(n) for n in names)))
        sections.append((title, listed(lines, "Nothing was found.")))
        claims = claims + F.size(lines)
    cells = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    every = [n for _, _, names in topics for n in names]
    summary = F.when(F.size(good) > 0, F.concat(F.size(good).cast("string"), F.lit(" changes are verified.")))
    summary = summary.when(F.forall(F.array(*(F.col(n).isNotNull() for n in every)), lambda x: x), F.concat(F.lit("Both years are covered. "), F.concat_ws(" ", *(cited(F.col(n)) for n in every))))
    summary = summary.when(F.exists(F.array(*(F.col(n).isNotNull() for n in every)), lambda x: x), F.concat(F.lit("A part is covered. "), F.concat_ws(" ", *(cited(F.col(n)) for n in every)))).otherwise(F.lit("The evidence is incomplete."))
    confidence = F.when(F.col("decision") == "sufficient", F.lit("Coverage is sufficient.")).otherwise(F.concat(F.lit("Coverage is limited; missing: "), F.coalesce(F.array_join("missing", ", "), F.lit("all")), F.lit(".")))
    body = [
        ("Summary", summary),
        *sections,
        ("Management's words", listed(present(*(said(n) for n in explained)), "None were found.")),
        ("Numeric changes", F.when(F.size(good) == 0, F.lit("No change is verified.")).otherwise(F.concat(F.lit("| Metric | Old | New |\n|---|---|---|\n"), F.array_join(F.transform(good, lambda r: cells(words(r), money(r["o"]), money(r["n"]))), "\n")))),
        ("Evidence", F.concat(F.lit("| Chunk | Year | Section | Score |\n|---|---|---|---|\n"), F.array_join(F.transform("evidence_table", lambda e: cells(e["chunk_id"].cast("string"), e["fiscal_year"].cast("string"), e["section_name"], F.format_number(e["reranker_score"], 3))), "\n"))),
        ("Confidence", F.concat(confidence, F.when(F.size(blocked) > 0, F.concat(F.lit(" "), F.size(blocked).cast("string"), F.lit(" claims were not verified and are left out."))).otherwise(F.lit("")))),
        ("Questions", F.lit("- Which scope of debt should decide?\n- Which measure of liquidity counts?")),
        ("Trace", F.lit(trace)),
    ]
    return rows.select(*keys, joined_sections(body).alias("answer"), claims.cast("long").alias("n_claims"))


def _among(metrics: list[str]):
    return lambda r: r["metric"].isin(metrics)
