"""Text expressions: tokens, canonical forms, previews and number rendering. All stay in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions import rules


def tokens(text: Column) -> Column:
    """Lower-case search tokens: a letter or digit, then letters, digits, hyphens and apostrophes."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[a-zA-Z0-9][a-zA-Z0-9\-']*"), 0), F.lower)


def searchable(section_name: Column, section_type: Column, text: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(section_name, F.lit("")), F.coalesce(section_type, F.lit("")), F.coalesce(text, F.lit("")))


def blank_tokens(text: Column) -> Column:
    """White-space tokens; none of an empty text."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def normalized_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, " ", " "), r"\s+", " "))


def canonical(line: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " "))


def normalized_label(label: Column) -> Column:
    """A statement row's label: no parentheticals, then canonical."""
    return canonical(F.regexp_replace(label, r"\([^)]*\)", " "))


def normalized_company(name: Column) -> Column:
    """A company name without legal suffixes."""
    words = F.split(canonical(F.replace(name, F.lit("&"), F.lit(" and "))), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(rules.LEGAL_SUFFIXES) & (w != "")), " ")


def preview(text: Column, size: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, size)


def contains_any(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | text.contains(t)
    return found


def phrase_weight(text: Column, weights: dict[str, float]) -> Column:
    """The sum of the weights of all phrases that occur in text."""
    total = F.lit(0.0)
    for phrase, weight in weights.items():
        total = total + F.when(text.contains(phrase), F.lit(weight)).otherwise(F.lit(0.0))
    return total


def cik10(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def archive_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), F.regexp_replace(cik.cast("string"), "^0+", ""), F.replace(accession, F.lit("-"), F.lit("")), document)


def change(old: Column, new: Column) -> Column:
    return new - old


def percent_change(old: Column, new: Column) -> Column:
    """Percent of the signed old value; null on a zero base."""
    return F.when(old != 0, (new - old) / old * 100)


def percent_change_abs(old: Column, new: Column) -> Column:
    """Percent of the old value's magnitude, as reports use it."""
    return F.when(old != 0, (new - old) / F.abs(old) * 100)


def direction(old: Column, new: Column) -> Column:
    return F.when(new > old, "increase").when(new < old, "decrease").otherwise("no_change")


def scaled_usd(value: Column) -> Column:
    """Millions where the magnitude is over a million, else as it is."""
    return F.when(F.abs(value) > 1_000_000, value / 1e6).otherwise(value)


def display_number(text: Column, zero_for_dash: Column) -> Column:
    """A statement cell's number: parentheses mean negative, a dash is 0 only where zero_for_dash holds."""
    value = F.trim(F.regexp_replace(F.translate(text, " ", " "), r"\s+", " "))
    number = F.regexp_extract(F.regexp_replace(F.regexp_replace(value, r"[$,()]", ""), "—", "0"), r"-?[0-9]+(?:\.[0-9]+)?", 0)
    amount = number.try_cast("double")
    signed = F.when(value.contains("(") & value.contains(")"), -F.abs(amount)).otherwise(amount)
    return F.when(value.isin("", "$", "(", ")"), F.lit(None)).when(value.isin("-", "—", "$ -", "$ —"), F.when(zero_for_dash, F.lit(0.0))).when(value.rlike("[0-9]"), signed)


def last_entries(entries: Column) -> Column:
    """A map of (key, value) entries; of equal keys the last one counts."""

    def kept(e: Column) -> Column:
        later = F.reverse(F.transform(e, lambda x: x["key"]))
        return F.transform(F.array(later), lambda keys: F.filter(e, lambda x, i: F.array_position(keys, x["key"]) == F.size(e) - i))[0]

    return F.map_from_entries(F.transform(F.array(entries), kept)[0])


def prefix_sums(counts: Column, block: int = 64) -> Column:
    """For each place of an array of numbers the sum of those before it; by blocks, so that no array is copied for each element."""

    def total(some: Column) -> Column:
        return F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + x)

    def placed(blocks: Column) -> Column:
        before = F.transform(blocks, lambda _, b: total(F.slice(blocks, 1, b)))
        return F.transform(F.array(before), lambda held: F.transform(counts, lambda _, i: held[F.floor(i / block).cast("int")] + total(F.slice(counts, F.floor(i / block).cast("int") * block + 1, i % block))))[0]

    starts = F.sequence(F.lit(0), F.ceil(F.size(counts) / block).cast("int"))
    sums = F.transform(starts, lambda b: total(F.slice(counts, b * block + 1, block)))
    return F.transform(F.array(sums), placed)[0]


def matches(text: Column, pattern: str) -> Column:
    """(found, start, end) of the pattern's successive matches, in code points, end exclusive. The pattern must not fit a control character.

    Spark's extraction gives no places, so each match is set between marks and the pieces' lengths are added up.
    """
    mark = "\u0001"
    pieces = F.split(F.regexp_replace(F.translate(text, mark, "\u0002"), pattern, f"{mark}$0{mark}"), mark)

    def found(p: Column) -> Column:
        at = prefix_sums(F.transform(p, lambda x: F.length(x)))
        every = F.transform(F.array(at), lambda a: F.transform(p, lambda x, i: F.struct(x.alias("found"), a[i].alias("start"), (a[i] + F.length(x)).alias("end"), (i % 2 == 1).alias("inside"))))[0]
        return F.transform(F.filter(every, lambda m: m["inside"]), lambda m: F.struct(m["found"], m["start"], m["end"]))

    return F.transform(F.array(pieces), found)[0]
