"""Fill-in-middle transformation by escaped marker injection (operator 11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is a word with the white space before it; white space at the end of a text is one of its own.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: The sentinels of the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What ends a unit inside the marked text, and what escapes both in the text; none is white space, so units stay as they are.
END, ESCAPE = "\u0001", "\u0002"


def escaped(text: Column) -> Column:
    """The text without END: ESCAPE becomes ESCAPE e, END becomes ESCAPE m."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(END), F.lit(ESCAPE + "m"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "m"), F.lit(END)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def units(marked: Column, count: Column) -> Column:
    """The first count units of a marked text; the last -count ones, with what follows the last END, for a negative count."""
    return F.call_function("substring_index", marked, F.lit(END), count.cast("int"))


def plain_text(marked: Column) -> Column:
    return unescaped(F.replace(marked, F.lit(END), F.lit("")))


def draw(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th group of eight hexadecimal digits of the SHA-256 of seed:doc_id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, suffix_first_percent: int = 80) -> DataFrame:
    """Cut each whole text at two drawn unit borders into prefix, middle and suffix, and put the middle last.

    docs: doc_id, text; other columns, of any name, are ignored. An END is put after every unit of the escaped text, their
    number counts the units, and the parts are ranked pieces between them. Returns one row per input row: doc_id, n (units),
    form, prefix_chars, middle_chars (code points; null where plain), output. percent of the texts are transformed,
    and suffix_first_percent of these as spm (suffix before prefix), the others as psm; the rest stay plain.
    A null text reads as empty; empty texts and texts that hold a sentinel stay plain. A null doc_id draws as an empty
    one; rows with equal ids draw alike, so equal rows give equal rows. Very long texts are cut as all others; an
    empty table gives no rows. Nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), escaped(text).alias("e"))
    marked = base.select("doc_id", "text", F.regexp_replace("e", UNIT, "$0" + END).alias("m"), F.length("e").alias("c"))
    counted = marked.select("doc_id", "text", "m", (F.length("m") - F.col("c")).cast("long").alias("n"))
    h = [draw(F.col("doc_id"), seed, k) for k in range(4)]
    holds = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    stays = (F.col("text") == "") | holds | (h[2] % 100 >= percent)
    form = F.when(stays, "plain").when(h[3] % 100 < suffix_first_percent, "spm").otherwise("psm")
    cuts = [h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)]
    placed = counted.select("doc_id", "text", "m", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    a, b, moved = F.col("a"), F.col("b"), F.col("form") != "plain"
    parts = placed.select(
        "doc_id", "text", "n", "form",
        F.when(moved, plain_text(units(F.col("m"), a))).alias("prefix"),
        F.when(moved, plain_text(units(units(F.col("m"), b), a - b))).alias("middle"),
        F.when(moved, plain_text(units(F.col("m"), b - F.col("n") - 1))).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return parts.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The exact text, from output and form alone. No other sentinel can arise where the parts meet, as they overlap nowhere."""

    def after(sentinel: str, value: Column) -> Column:
        return F.call_function("substring", value, F.locate(sentinel, value) + len(sentinel))

    def before(sentinel: str, value: Column) -> Column:
        return F.call_function("substring_index", value, F.lit(sentinel), F.lit(1))

    middle = after(MIDDLE, output)
    psm = F.concat(before(SUFFIX, after(PREFIX, output)), middle, before(MIDDLE, after(SUFFIX, output)))
    spm = F.concat(before(MIDDLE, after(PREFIX, output)), middle, before(PREFIX, after(SUFFIX, output)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
