"""Quality rules by cross-document line frequency (operator 3, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import SPACE_CLASS, fresh, let, stage


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")


def repeated_window_words(tokens: Column, width: int = 3, small: int = 64) -> Column:
    """Words that lie in a window of three words which occurs twice or more in the array.

    Windows are compared by 64-bit hashes. Few repeated hashes are looked up one by one; many are found
    by sorting (hash, position), so the cost stays n log n on very long texts.
    """

    def covered(positions: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(0), F.size(positions) - 1), lambda j: F.when(j == F.size(positions) - 1, F.lit(width)).otherwise(F.least(F.lit(width), positions[j + 1] - positions[j])))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def few(h: Column, repeated: Column) -> Column:
        at = F.transform(h, lambda x, i: F.when(F.array_contains(repeated, x), i))
        return let(F.filter(at, lambda p: p.isNotNull()), covered)

    def many(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(
            pairs,
            lambda s: let(
                F.sort_array(
                    F.filter(
                        F.transform(s, lambda e, j: F.when(((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["x"] == e["x"])) | ((j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["x"] == e["x"])), e["i"])),
                        lambda p: p.isNotNull(),
                    )
                ),
                covered,
            ),
        )

    def of(h: Column) -> Column:
        repeats = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(F.transform(s, lambda x, j: F.when((j > 0) & (s[F.greatest(j - 1, F.lit(0))] == x), x)), lambda x: x.isNotNull())))
        found = let(repeats, lambda r: F.when(F.size(r) == 0, F.lit(0).cast("long")).when(F.size(r) <= small, few(h, r)).otherwise(many(h)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(found)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(w[i + k] for k in range(width))))

    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) < width, F.lit(0).cast("long")).otherwise(let(let(hashed, windows), of))


def line_key(line: Column) -> Column:
    """The first 60 bits of the MD5 of a normalised line: lower case, digits as 0, white space squeezed."""
    normal = F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), SPACE_CLASS, " ")
    return F.conv(F.substring(F.md5(F.trim(normal)), 1, 15), 16, 10).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def document_measures(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, th (hash of the text), host, measures, lines (key and characters)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("\u0000")).alias("host"), text.alias("text"))
    split = base.select("doc_id", "host", "text", words(F.col("text")).alias("w"), worded_lines(F.col("text")).alias("l"))
    return split.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("th"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\u000b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.transform("l", lambda x: F.struct(line_key(x).alias("k"), F.length(x).alias("n"))).alias("lines"),
    )


def distinct_lines(lines: Column) -> Column:
    """The different (key, characters) of an array, by sorting: comparing each with all others would be quadratic."""
    return let(F.sort_array(lines), lambda s: F.filter(s, lambda x, i: (i == 0) | (x["k"] != s[F.greatest(i - 1, F.lit(0))]["k"]) | (x["n"] != s[F.greatest(i - 1, F.lit(0))]["n"])))


def frequent_lines(measured: DataFrame, min_docs: int, max_share: float, min_variety: float) -> DataFrame:
    """(host, k) of the lines above the limits whose carriers are no family of near copies.

    Documents are counted once per distinct text. The lines above the limits are found first; a carrier is
    then told by what they leave of it. It looks like a copy only if at most a quarter of its characters are
    its own and it is hardly longer than the most that any carrier of the line has of lines above the limits:
    at 8/9, two texts that share all of these lines have similarity 0.8. Such carriers count by their
    smallest other key, all others count each as itself, and the line needs min_variety such values a text.
    Every grouping is combined on the map side first.
    """
    lines = distinct_lines(F.col("lines"))
    keys = F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["k"])))
    every = measured.select("host", "th", F.explode(F.array_distinct(F.transform("lines", lambda x: x["k"]))).alias("k"))
    counts = every.groupBy("host", "k", "th").agg(F.lit(1).alias("one")).groupBy("host", "k").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > min_docs)
    hosts = measured.groupBy("host", "th").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    above = stage(counts.join(hosts, "host").filter(F.col("n_docs") > F.col("host_docs") * max_share).select("host", "k", "n_docs"), "quality")
    total = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    pieces = measured.select("host", "th", keys.alias("keys"), total.alias("total"), lines.alias("l")).select("host", "th", F.get("keys", F.lit(0)).alias("least"), F.get("keys", F.lit(1)).alias("second"), "total", F.inline("l"))
    held = pieces.join(above.select("host", "k"), ["host", "k"]).groupBy("host", "th", "least", "second", "total", "k", "n").agg(F.lit(1).alias("one"))
    texts = held.groupBy("host", "th", "least", "second", "total").agg(F.sum("n").alias("shared"), F.collect_set("k").alias("ks"))
    carried = stage(texts.select("host", "th", "least", "second", "total", "shared", F.explode("ks").alias("k")), "quality")
    most = stage(carried.groupBy("host", "k").agg(F.max("shared").alias("most")), "quality")
    alike = (4 * (F.col("total") - F.col("shared")) <= F.col("total")) & (8 * F.col("total") <= 9 * F.col("most"))
    other = F.when(F.col("k") == F.col("least"), F.coalesce("second", "k")).otherwise(F.col("least"))
    signed = carried.join(most, ["host", "k"]).select("host", "k", alike.alias("alike"), F.when(alike, other).otherwise(F.col("th")).alias("sig"))
    varied = signed.groupBy("host", "k", "alike", "sig").agg(F.lit(1).alias("one")).groupBy("host", "k").agg(F.count(F.lit(1)).alias("n_sigs"))
    return stage(above.join(varied, ["host", "k"]).filter(F.col("n_sigs") >= F.col("n_docs") * min_variety).select("host", "k"), "quality")


def line_rules(docs: DataFrame, min_docs: int = 20, max_share: float = 0.05, min_variety: float = 0.5, min_left: float = 0.3, max_repeat_share: int = 50, min_words: int = 50) -> DataFrame:
    """Judge each document by its own measures and by what is left without its host's boilerplate lines.

    docs: doc_id, text, source; other columns are ignored. A line is boilerplate in its host (source) if
    more than min_docs distinct texts and more than max_share of the host's texts carry it, see
    frequent_lines. A document is depleted if less than min_left of the characters of its lines remain.
    Returns one row per input row: doc_id, th, the measures, base_failed, removed (keys of its boilerplate
    lines), removed_at (their places among the lines that hold a word), left_share, kept. Null or empty texts have no words and fail; a null source is a host of its
    own; a null doc_id is carried through; rows with the same doc_id are judged each by its own text.
    """
    measured = stage(document_measures(docs), "quality")
    frequent = frequent_lines(measured, min_docs, max_share, min_variety)
    carried = measured.select("doc_id", "th", "host", F.posexplode(F.transform("lines", lambda x: x["k"])).alias("at", "k"))
    found = carried.join(frequent, ["host", "k"]).groupBy("doc_id", "th", "host", "k", "at").agg(F.lit(1).alias("one"))
    removed = found.groupBy("doc_id", "th", "host").agg(F.collect_set("k").alias("removed"), F.sort_array(F.collect_list("at")).alias("removed_at"))
    m, r = measured.alias("m"), removed.alias("r")
    same = F.col("m.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("m.th") == F.col("r.th")) & (F.col("m.host") == F.col("r.host"))
    joined = m.join(r, same, "left").select("m.*", F.coalesce("r.removed", F.array().cast("array<bigint>")).alias("removed"), F.coalesce("r.removed_at", F.array().cast("array<int>")).alias("removed_at"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    gone = F.aggregate("removed_at", F.lit(0).cast("long"), lambda a, i: a + F.col("lines")[i]["n"])
    left = total - gone
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_share * F.col("n_words"))
    shares = joined.withColumn("left_share", F.when(total > 0, left / total).otherwise(F.lit(0.0))).withColumn("base_failed", failed)
    return shares.select("doc_id", "th", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed", "removed_at", "left_share", (~F.col("base_failed") & (F.col("left_share") >= min_left)).alias("kept"))


def cleaned(docs: DataFrame, **limits: float) -> DataFrame:
    """The kept documents without their boilerplate lines, in the columns of docs; n_chars, if there, follows the text.

    Null, empty and short texts go; a null source is a host of its own; rows with a null doc_id, several rows with one
    doc_id and equal rows are each kept or dropped by their own text. Lines without a word stay; very long
    texts are judged whole; an empty table gives no rows. Columns of any name are carried.
    """
    judged = line_rules(docs, **limits).filter("kept").groupBy("doc_id", "th", "host").agg(F.first("removed_at").alias("removed_at"))
    id_, hash_, host, gone, text = fresh(docs, "id", "hash", "host", "gone", "left_text")
    own = docs.withColumns({id_: F.col("doc_id").cast("long"), hash_: F.xxhash64(F.coalesce("text", F.lit(""))), host: F.coalesce("source", F.lit("\u0000"))})
    known = judged.select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"), F.col("host").alias("k_host"), F.col("removed_at").alias(gone)).alias("k")
    joined = own.join(known, F.col(id_).eqNullSafe(F.col("k.k_id")) & (F.col(hash_) == F.col("k.k_th")) & (F.col(host) == F.col("k.k_host")))
    split = F.split(own["text"], "\n")
    worded = F.filter(F.transform(split, lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    places = let(worded, lambda w: F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.transform(gone, lambda j: w[j])))
    kept_lines = F.array_join(let(split, lambda l: F.transform(places, lambda i: l[i])), "\n")
    out = joined.withColumn(text, F.when(F.size(gone) > 0, kept_lines).otherwise(own["text"]))
    return out.select(*(F.col(text).alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else own["`" + c + "`"].alias(c) for c in docs.columns))
