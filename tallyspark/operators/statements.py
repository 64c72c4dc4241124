"""Statement tables of filing HTML and facts of inline XBRL."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import rules
from tallyspark.functions.text import display_number, normalized_label
from tallyspark.operators.facts import first_in


class Tables(HTMLParser):
    """Cells of all tables: (table, row, column, text, tagged, concept).

    tagged is the text of a tagged number in the cell, without what stands around the tag; concept is its name.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple[int, int, int, str, str | None, str | None]] = []
        self.table, self.row, self.column = -1, -1, -1
        self.text: list[str] | None = None
        self.tagged: list[str] | None = None
        self.in_tag = False
        self.concept: str | None = None

    def close_cell(self) -> None:
        if self.text is not None:
            text, tagged = (None if x is None else re.sub(r"\s+", " ", " ".join(x)).strip() for x in (self.text, self.tagged))
            self.cells.append((self.table, self.row, self.column, text or "", tagged, self.concept))
            self.text = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.close_cell()
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.close_cell()
            self.row, self.column = self.row + 1, -1
        elif tag in ("td", "th"):
            self.close_cell()
            self.column, self.text, self.tagged, self.in_tag, self.concept = self.column + 1, [], None, False, None
        elif tag.endswith("nonfraction") and self.text is not None and self.tagged is None:
            self.tagged, self.in_tag = [], True
            self.concept = (dict(attrs).get("name") or "").split(":")[-1] or None

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()
        elif tag.endswith("nonfraction"):
            self.in_tag = False

    def handle_data(self, data: str) -> None:
        if self.text is not None and data.strip():
            self.text.append(data.strip())
            if self.in_tag and self.tagged is not None:
                self.tagged.append(data.strip())


#: Characters of pages whose cells a Python worker holds at once.
HELD_CHARS = 1 << 18
CELLS = pa.schema([("accession", pa.string()), *((c, pa.int32()) for c in ("table_no", "row_no", "column_no")), *((c, pa.string()) for c in ("text", "tagged", "concept"))])


def cell_batches(pages: Iterator[tuple[str | None, str | None]], held_chars: int = HELD_CHARS) -> Iterator[pa.RecordBatch]:
    """The cells of (accession, html) pages, given out as soon as the pages since the last batch have held_chars characters."""

    def batch(cells: list[tuple]) -> pa.RecordBatch:
        columns = zip(*cells) if cells else [()] * len(CELLS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CELLS, strict=True)], schema=CELLS)

    cells, chars = [], 0
    for accession, html in pages:
        parser = Tables()
        parser.feed(html or "")
        parser.close()
        parser.close_cell()
        cells += [(accession, *c) for c in parser.cells]
        chars += len(html or "")
        if chars >= held_chars:
            yield batch(cells)
            cells, chars = [], 0
    yield batch(cells)


def table_cells(filings: DataFrame) -> DataFrame:
    """accession, table_no, row_no, column_no, text, tagged, concept for every cell of every table. filings: accession, html.

    A task holds the cells of HELD_CHARS characters of pages (or of one longer page), whatever the size of its batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            yield from cell_batches((a.as_py(), h.as_py()) for a, h in zip(given.column("accession"), given.column("html"), strict=True))

    pages = filings.select(F.col("accession").cast("string").alias("accession"), "html")
    return pages.mapInArrow(run, "accession string, table_no int, row_no int, column_no int, text string, tagged string, concept string")


def statement_type(text: Column) -> Column:
    """The statement that a table's canonical text belongs to, or null. The phrases of each statement."""
    has = text.contains
    flow = has("operating activities") & has("investing activities") & has("financing activities") & has("net cash")
    balance = has("current assets") & has("current liabilities") & (has("shareholders equity") | has("shareowners equity") | has("liabilities and equity"))
    income = (has("net income") | has("net earnings")) & (has("revenue") | has("sales")) & ~has("cash flows from operating activities")
    return F.when(flow, "cash_flow_statement").when(balance, "balance_sheet").when(income, "income_statement")


def statement_items(cells: DataFrame) -> DataFrame:
    """accession, table_no, pos, fiscal_year, statement_type, row_label, normalized_label, value, xbrl_concept, confidence.

    The k-th value cell of a row belongs to the k-th year of the table's first eight rows; the label is what stands
    before the first value. A table is one group, so its work does not grow with the corpus.
    """
    keys = ["accession", "table_no"]
    whole = cells.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "column_no", "text"))), lambda x: x["text"]), " ").alias("text"))
    kinds = whole.select(*keys, statement_type(normalized_label(F.col("text"))).alias("statement_type")).filter("statement_type IS NOT NULL")
    year = F.element_at(F.regexp_extract_all("text", F.lit(r"20[0-9]{2}"), 0), -1)
    named = cells.filter("row_no < 8").filter(F.col("text").rlike(r"20[0-9]{2}")).withColumn("year", year.cast("int"))
    first = first_in(named, [*keys, "year"], ["row_no", "column_no"])
    years = first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "column_no", "year"))), lambda x: x["year"]).alias("years"))
    value = display_number(F.coalesce("tagged", "text"), F.col("concept").isNotNull())
    parsed = cells.withColumns({"value": value, "is_value": F.col("tagged").isNotNull() | value.isNotNull()})
    row = F.sort_array(F.collect_list(F.struct("column_no", "text", "concept", "value", "is_value")))
    rows = parsed.groupBy(*keys, "row_no").agg(row.alias("cells")).join(kinds, keys).join(years, keys)
    values = F.filter("cells", lambda c: c["is_value"])
    label_cells = F.filter("cells", lambda c: (c["column_no"] < F.get("values", F.lit(0))["column_no"]) & ~c["text"].isin("", "$", "(", ")"))
    labelled = rows.withColumn("values", values).filter("size(values) > 0").withColumn("row_label", F.array_join(F.transform(label_cells, lambda c: c["text"]), " ")).withColumn("normalized_label", normalized_label(F.col("row_label")))
    wanted = labelled.filter((F.col("normalized_label") != "") & ~F.col("normalized_label").isin(rules.NOISE_LABELS))
    zipped = wanted.select(*keys, "row_no", "statement_type", "row_label", "normalized_label", F.posexplode(F.arrays_zip(F.col("years"), F.slice("values", 1, F.size("years")).alias("v"))).alias("k", "z"))
    found = zipped.filter("z.v IS NOT NULL AND z.years IS NOT NULL AND z.v.value IS NOT NULL")
    concept = F.col("z.v.concept")
    return found.select(*keys, (F.col("table_no") * 100_000 + F.col("row_no")).alias("pos"), F.col("z.years").alias("fiscal_year"), "statement_type", "row_label", "normalized_label", F.col("z.v.value").alias("value"), concept.alias("xbrl_concept"), F.when(concept.isNotNull(), "high").otherwise("medium").alias("confidence"))


def unescaped(text: Column) -> Column:
    """The text without the entities that stand in numbers, dates and names. Text without an ampersand costs no pattern."""
    plain = text
    for entity, character in (("&(nbsp|#160|#xa0);", "\u00a0"), ("&(mdash|#8212);", "\u2014"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.regexp_replace(plain, f"(?i){entity}", character)
    return F.when(text.contains("&"), plain).otherwise(text)


def qname_part(name: Column) -> Column:
    return F.substring_index(unescaped(F.trim(name)), ":", -1)


def context_id(block: Column) -> Column:
    return F.regexp_extract(F.substring_index(block, ">", 1), r"[^-A-Za-z0-9_:]id=\"([^\"]*)\"", 1)


def context_described(block: Column, lower: Column) -> Column:
    """year (of the instant, else the end date) and dimensions (axis and member, in their order) of a context. lower: the block's lower case, which tells what need not be sought."""
    member = r"(?is)<xbrldi:explicitMember\b[^>]*dimension=\"([^\"]+)\"[^>]*>(.*?)</xbrldi:explicitMember>"

    def date(tag: str) -> Column:
        """The first four characters of the tag's trimmed text; null if it has none."""
        found = F.regexp_extract(block, rf"(?is)<xbrli:{tag}>[\x20]*((?:(?!</xbrli:{tag}>).){{0,4}}).*?</xbrli:{tag}>", 1)
        return F.when(lower.contains(f"<xbrli:{tag.lower()}>"), found)

    axes, members = F.regexp_extract_all(block, F.lit(member), 1), F.regexp_extract_all(block, F.lit(member), 2)
    dimensions = F.zip_with(axes, members, lambda a, m: F.struct(qname_part(a).alias("axis"), qname_part(m).alias("member")))
    years = F.filter(F.array(date("instant"), date("endDate")), lambda d: d != "")
    return F.struct(F.get(years, F.lit(0)).try_cast("int").alias("year"), F.when(lower.contains("<xbrldi:explicitmember"), dimensions).otherwise(no_dimensions()).alias("dimensions"))


def no_dimensions() -> Column:
    return F.array().cast("array<struct<axis:string,member:string>>")


def fact_value(text: Column, scale: Column, format_: Column, sign: Column) -> Column:
    """A tagged number, of its text without tags and entities; a dash or nothing is zero only in a fixed-zero format; parentheses or sign="-" negate; scale shifts."""
    zero = F.coalesce(F.endswith(format_, F.lit("fixed-zero")), F.lit(False))
    bare = F.when(text.contains("(") | text.contains(")"), F.regexp_replace(text, r"^[()]+|[()]+$", "")).otherwise(text)
    number = F.translate(bare, "$,%", "").try_cast("double")
    scaled = number * F.pow(F.lit(10.0), F.coalesce(scale.try_cast("int"), F.lit(0)))
    negative = (F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")"))) | F.coalesce(sign == "-", F.lit(False))
    return F.when(text.isin("", "-", "\u2014"), F.when(zero, F.lit(0.0))).otherwise(scaled * F.when(negative, F.lit(-1.0)).otherwise(F.lit(1.0)))


def inline_facts(docs: DataFrame) -> DataFrame:
    """doc_id, pos, concept, year, dimensions, unit, value of every tagged number that names a concept and a context.

    docs: doc_id, html. A document's contexts are arrays in its row, in which its tags look themselves up, so the HTML is read once
    and nothing is shuffled. A tag of an unknown context has no year and no dimensions; a null html has no tags. Of contexts with one
    id, and of a tag's attributes with one name, the last counts. Each step's results are array elements, so that the next one reads
    them and no pattern runs twice.
    """
    context, tag, pair = r"(?is)<xbrli:context\b[^>]*>.*?</xbrli:context>", r"(?is)<ix:nonFraction\b([^>]*>.*?)</ix:nonFraction>", r"[A-Za-z_:][-A-Za-z0-9_:]*=\"[^\"]*\""
    found = docs.select("doc_id", F.reverse(F.regexp_extract_all("html", F.lit(context), 0)).alias("blocks"), F.regexp_extract_all("html", F.lit(tag), 1).alias("tags"))
    lower = F.transform("blocks", lambda b: F.struct(b.alias("block"), F.lower(b).alias("lower")))
    read = found.select("doc_id", F.transform("blocks", context_id).alias("ids"), F.transform(lower, lambda b: context_described(b["block"], b["lower"])).alias("described"), "tags")

    def cut(t: Column) -> Column:
        inner = F.substr(t, F.instr(t, ">") + 1)
        return F.struct(F.regexp_extract_all(F.substring_index(t, ">", 1), F.lit(pair), 0).alias("pairs"), F.when(t.contains("<"), F.regexp_replace(inner, r"(?s)<[^>]+>", "")).otherwise(inner).alias("bare"))

    def attribute(t: Column, name: str) -> Column:
        last = F.try_element_at(F.filter(t["pairs"], lambda p: p.startswith(f'{name}="')), F.lit(-1))
        return F.substring_index(F.substring_index(last, '"', -2), '"', 1)

    def named(t: Column, i: Column) -> Column:
        attributes = (attribute(t, n).alias(n) for n in ("name", "contextRef", "unitRef", "format", "scale", "sign"))
        return F.struct(i.alias("pos"), *attributes, F.trim(F.replace(unescaped(t["bare"]), F.lit("\u00a0"), F.lit(""))).alias("text"))

    def placed(t: Column) -> Column:
        return F.struct(t.alias("t"), F.get("described", (F.array_position("ids", t["contextRef"]) - 1).cast("int")).alias("context"))

    def fact(f: Column) -> Column:
        t = f["t"]
        value = fact_value(t["text"], t["scale"], t["format"], t["sign"])
        return F.struct(t["pos"].alias("pos"), qname_part(t["name"]).alias("concept"), f["context"]["year"].alias("year"), F.coalesce(f["context"]["dimensions"], no_dimensions()).alias("dimensions"), t["unitRef"].alias("unit"), value.alias("value"))

    tags = F.filter(F.transform(F.transform("tags", cut), named), lambda t: (t["name"] != "") & (t["contextRef"] != ""))
    return read.select("doc_id", F.inline(F.transform(F.transform(tags, placed), fact)))


def member_suffix(dimension: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(dimension["member"], "Member$", ""), "[^A-Za-z0-9]", "")


def dimension_keys(facts: DataFrame) -> DataFrame:
    """doc_id, key, year, value, n_values, n_conflicts: the concept, or the concept with its members' suffixes; the first value of each counts.

    A fact with several members also has the key of all suffixes, in the context's order. n_conflicts counts values that differ
    from the first by more than 1e-9, which are ignored. The values of a key are those of one document.
    """
    suffixes = F.filter(F.transform("dimensions", member_suffix), lambda s: s != "")
    single = F.transform(suffixes, lambda s: F.concat("concept", s))
    all_members = F.filter(F.array(F.concat("concept", F.array_join(suffixes, ""))), lambda k: F.size(suffixes) > 0)
    keys = F.when(F.size("dimensions") > 1, F.concat(single, all_members)).when(F.size("dimensions") == 1, single).otherwise(F.array("concept"))
    keyed = facts.filter("value IS NOT NULL AND year IS NOT NULL").select("doc_id", "pos", "year", "value", F.posexplode(keys).alias("k", "key"))
    held = keyed.groupBy("doc_id", "key", "year").agg(F.sort_array(F.collect_list(F.struct("pos", "k", "value"))).alias("v"))
    first = F.col("v")[0]["value"]
    differing = F.filter("v", lambda x: F.abs(x["value"] - F.col("v")[0]["value"]) > 1e-9)
    return held.select("doc_id", "key", "year", first.alias("value"), F.size("v").cast("long").alias("n_values"), F.size(differing).cast("long").alias("n_conflicts"))
