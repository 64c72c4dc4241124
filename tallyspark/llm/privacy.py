"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find (operator 2)."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import fresh, salted_join, stage

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns' parts; each starts where a match can start at all, so long runs cost linear time.
EMAIL_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: A quoted literal that something is set to: a seed of the kind secret if it holds letters and digits.
ASSIGNED = re.compile(r"""[=:] ?(["'])([A-Za-z0-9+/_.-]{20,}+=*+)\1""")
#: Kinds that spans may have; the first four are those of the base patterns.
ALL_KINDS = [*KINDS, "secret"]
#: Forms that a bootstrapped pattern may extract, with the kinds each may be. Only the number of digits and groups, which
#: makes the form, is bounded. A secret's form is that of its seeds, which are no base spans and need a trusted pattern, too.
FORMS = {
    "secret": (ASSIGNED, ("secret",)),
    "at": (re.compile(r"(?<![\w.+-])(?i:[\w.+-]{2,}+(?:@| ?[\[(]at[\])] ?| at )[\w-]++(?:(?:\.| ?[\[(]dot[\])] ?| dot )[\w-]++)*+)"), ("email",)),
    "groups": (re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![\w:])"), ("ip",)),
    "digits": (re.compile(r"(?<![\w+.-])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,18}(?![\w-])"), ("card", "phone")),
    "literal": (re.compile(r"(?<![\w+/.-])[A-Za-z0-9+/_-]{20,}+(?![\w.])"), ("secret",)),
}
AT = re.compile(r"@|[\[(]at[\])]| at ", re.IGNORECASE)
DOT = re.compile(r"@|\.| dot |[\[(]dot[\])]", re.IGNORECASE)
WORD = re.compile(r"[^\W_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def octet(digits: str) -> bool:
    """Whether a run of digits of any length says at most 255."""
    said = digits.lstrip("0")
    return len(said) <= 3 and int(said or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ so that runs without one cost nothing."""
    free = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in EMAIL_LOCAL_CHARS:
            begin -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    found = [(s, 0, e) for s, e in emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(octet(p) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


class Contexts:
    """Lexical patterns around the spans of a text: two words before, one before, one after, on the same line.

    The words are those of the whole text, found once, so no pattern holds a part of a word.
    """

    def __init__(self, text: str) -> None:
        self.text, self.begins, self.ends = text, array("q"), array("q")
        for m in WORD.finditer(text):
            self.begins.append(m.start())
            self.ends.append(m.end())

    def of(self, start: int, end: int) -> list[str]:
        text, last = self.text, bisect_right(self.ends, start) - 1
        before: list[str] = []
        for i in range(last, max(-1, last - 2), -1):
            if text.find("\n", self.ends[i], self.begins[i + 1] if i < last else start) >= 0:
                break
            before.insert(0, text[self.begins[i] : self.ends[i]].lower())
        made = [f"{before[0]} {before[1]} _"] if len(before) == 2 else []
        after = bisect_left(self.begins, end)
        follows = [text[self.begins[after] : self.ends[after]].lower()] if after < len(self.begins) and text.find("\n", end, self.begins[after]) < 0 else []
        return made + [f"{w} _" for w in before[-1:]] + [f"_ {w}" for w in follows]


class Taken:
    """Disjoint intervals in order."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.begins, self.ends = array("q"), array("q")
        for s, e in spans:  # sorted by start
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.begins.append(s)
                self.ends.append(e)

    def add(self, s: int, e: int) -> bool:
        """Take (s, e) if nothing of it is taken."""
        i = bisect_right(self.begins, s)
        if (i and self.ends[i - 1] > s) or (i < len(self.begins) and self.begins[i] < e):
            return False
        self.begins.insert(i, s)
        self.ends.insert(i, e)
        return True


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """(form, start, end) of what looks like an identifier, form by form."""
    has_digit = bool(DIGIT.search(text))
    here = {"secret": has_digit and ("=" in text or ":" in text), "at": bool(AT.search(text) and DOT.search(text)), "groups": has_digit and ":" in text, "digits": has_digit, "literal": has_digit}
    for form, (pattern, _) in FORMS.items():
        for m in pattern.finditer(text) if here[form] else ():
            s, e = m.span(2 if form == "secret" else 0)
            said = text[s:e]
            if form == "at" and not DOT.search(said) or form in ("secret", "literal") and (said.isalpha() or not DIGIT.search(said) or not any(map(str.isalpha, said))):
                continue
            yield form, s, e


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and candidates with their contexts; a candidate overlaps no base span and no earlier candidate."""
    taken = Taken([(s, e) for s, _, e in base])
    met = [(KINDS[k], s, e) for s, k, e in base] + [x for x in candidates(text) if taken.add(x[1], x[2])]
    around = Contexts(text) if met else None
    return [{"form": form, "start": s, "end": e, "instance": text[s:e].lower(), "patterns": around.of(s, e)} for form, s, e in met]


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, th (hash of the text), base spans, occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([(n, pa.int32()) for n in "ske"]))
        found = pa.list_(pa.struct([("form", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
        for batch in batches:
            base, met = [], []
            for text in batch.column("text"):
                text = text.as_py()
                b = base_spans(text)
                base.append([{"s": s, "k": k, "e": e} for s, k, e in b])
                met.append(occurrences(text, b))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(base, spans), pa.array(met, found)], names=["doc_id", "th", "base", "found"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    return rows.mapInArrow(run, "doc_id long, th long, base array<struct<s:int,k:int,e:int>>, found array<struct<form:string,start:int,end:int,instance:string,patterns:array<string>>>")


def trusted_patterns(found: DataFrame, min_seeds: int, threshold: float, rounds: int, min_share: float, epsilon: float) -> DataFrame:
    """(pattern, kind, score) of the high-confidence patterns, by iterative scoring of the pattern-instance graph.

    A pattern's score for a kind is the mean score of its distinct instances, with one failure added;
    seeds of the kind score 1, of another kind 0, and a candidate the mean score of its patterns. The scores
    are the fixed point of this: each round solves every pattern for its own share in its candidates, and
    rounds go on until no score changes by epsilon; every so many rounds the scores are staged and compared.
    As the fixed point lets candidates confirm one another, a pattern needs min_share of seeds among its
    instances, besides what seeds of other kinds cost it; that share also bounds the number of rounds.
    Candidates in the same patterns count together. Every pattern's sums are combined on the map side, and
    joins on patterns are salted, so a frequent word lands in no one task.
    """
    seed_forms = [*KINDS, "secret"]
    free = [form for form in FORMS if form not in seed_forms]
    allowed = F.create_map(*(x for form in free for x in (F.lit(form), F.array(*map(F.lit, FORMS[form][1])))))
    edges = found.select(F.explode("patterns").alias("pattern"), "instance", "form").groupBy("pattern", "instance", "form").agg(F.lit(1).alias("one"))
    is_seed = F.col("form").isin(seed_forms)
    counts = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *(F.sum((F.col("form") == f).cast("int")).alias(f) for f in [*seed_forms, *free]))
    by_kind = counts.withColumn("kind", F.explode(F.array(*map(F.lit, ALL_KINDS))))
    seeds = F.element_at(F.create_map(*(x for k in ALL_KINDS for x in (F.lit(k), F.col(k)))), F.col("kind"))
    open_to = sum((F.when(F.col("kind").isin(list(FORMS[form][1])), F.col(form)).otherwise(0) for form in free), F.lit(0))
    has_use = (F.col("open") > 0) | (F.col("kind") == "secret")  # a base pattern's seeds are spans as they are
    possible = by_kind.withColumns({"seeds": seeds, "open": open_to}).filter((F.col("seeds") >= min_seeds) & (F.col("seeds") >= min_share * F.col("n")) & has_use & ((F.col("seeds") + F.col("open")) / (F.col("n") + 1) >= threshold))
    possible = stage(possible.select("pattern", "kind", "n", "seeds"), "privacy")
    scores = possible.withColumn("score", F.col("seeds") / (F.col("n") + 1))
    unseen = edges.filter(~is_seed).withColumn("kind", F.explode(F.element_at(allowed, F.col("form")))).select("pattern", "instance", "kind")
    sets = salted_join(unseen, possible.select("pattern", "kind"), ["pattern", "kind"]).groupBy("instance", "kind").agg(F.sort_array(F.collect_set("pattern")).alias("patterns"))
    sets = stage(sets.groupBy("kind", "patterns").agg(F.count(F.lit(1)).alias("weight")), "privacy")
    if sets.isEmpty():  # seeds alone decide
        return scores.filter(F.col("score") >= threshold).select("pattern", "kind", "score")
    graph = stage(sets.select("kind", F.xxhash64("patterns").alias("set"), "weight", F.size("patterns").alias("d"), F.explode("patterns").alias("pattern")), "privacy")
    own = graph.groupBy("pattern", "kind").agg(F.sum(F.col("weight") / F.col("d")).alias("own"))
    fixed = stage(possible.join(own, ["pattern", "kind"], "left").withColumn("own", F.coalesce("own", F.lit(0.0))), "privacy")
    last = scores = stage(fixed.withColumn("score", F.col("seeds") / (F.col("n") + 1 - F.col("own"))).select("pattern", "kind", "score"), "privacy")
    while True:
        for _ in range(rounds):
            scored = salted_join(graph, scores, ["pattern", "kind"])
            shares = scored.join(scored.groupBy("set", "kind").agg(F.sum("score").alias("s")), ["set", "kind"])
            gains = shares.groupBy("pattern", "kind").agg(F.sum(F.col("weight") * (F.col("s") - F.col("score")) / F.col("d")).alias("gain"))
            last, scores = scores, fixed.join(gains, ["pattern", "kind"], "left").select("pattern", "kind", ((F.col("seeds") + F.coalesce("gain", F.lit(0.0))) / (F.col("n") + 1 - F.col("own"))).alias("score"))
        scores = stage(scores.join(last.withColumnRenamed("score", "last"), ["pattern", "kind"]), "privacy")
        if scores.agg(F.max(F.abs(F.col("score") - F.col("last")))).first()[0] < epsilon:
            break
        scores = scores.drop("last")
    return scores.filter(F.col("score") >= threshold).select("pattern", "kind", "score")


def personal_data(docs: DataFrame, min_seeds: int = 5, threshold: float = 0.8, rounds: int = 3, min_share: float = 0.1, epsilon: float = 1e-4) -> DataFrame:
    """doc_id, th, base and all_spans (arrays of start s, kind k as a place in ALL_KINDS, end e) for every row of docs.

    docs: doc_id, text; other columns are ignored. Base patterns always hold. Their matches are seeds, and
    so are quoted literals that something is set to (kind secret), which are spans only in a trusted pattern;
    patterns of the words around seeds that score threshold or more with min_seeds distinct seeds, and one
    seed in ten distinct instances (min_share), extract further identifiers of allowed forms; of several kinds
    that fit a span, the one of greatest score, then the last by name. Null and empty texts have no spans;
    very long ones are scanned whole in linear time; a null doc_id is carried through; rows with one doc_id
    are each scanned; equal rows give equal rows; an empty table gives none.
    """
    scanned = stage(scan(docs), "privacy")
    found = scanned.select("doc_id", "th", F.explode("found").alias("f")).select("doc_id", "th", "f.*")
    trusted = trusted_patterns(found, min_seeds, threshold, rounds, min_share, epsilon)
    allowed = F.create_map(*(x for form, (_, kinds) in FORMS.items() for x in (F.lit(form), F.array(*map(F.lit, kinds)))))
    open_ = found.filter(~F.col("form").isin(KINDS)).withColumn("kind", F.explode(F.element_at(allowed, F.col("form")))).select("doc_id", "th", "start", "end", "kind", F.explode("patterns").alias("pattern"))
    hits = salted_join(open_, trusted, ["pattern", "kind"]).groupBy("doc_id", "th", "start", "end").agg(F.max(F.struct("score", "kind")).alias("best"))
    place = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("best.kind")).cast("int") - 1
    extra = hits.groupBy("doc_id", "th").agg(F.collect_set(F.struct(F.col("start").alias("s"), place.alias("k"), F.col("end").alias("e"))).alias("extra"))
    s, x = scanned.alias("s"), extra.alias("x")
    joined = s.join(x, F.col("s.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("s.th") == F.col("x.th")), "left")
    spans = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "extra")))
    return joined.select(F.col("s.doc_id").alias("doc_id"), F.col("s.th").alias("th"), "base", spans.alias("all_spans"))


def count_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def written(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, ALL_KINDS)), x["k"] + 1), x["s"], x["e"])), ",")


def cover(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Each text with its spans, sorted by start, replaced; null where there is nothing to replace."""

    def one(text: str | None, found: Iterable | None) -> str | None:
        if text is None or found is None:
            return None
        out, at = [], 0
        for x in found:
            if x["s"] >= at:
                out += [text[at : x["s"]], f"[{ALL_KINDS[x['k']].upper()}]"]
            at = max(at, x["e"])
        return "".join([*out, text[at:]])

    return pd.Series([one(t, f) for t, f in zip(texts, spans, strict=True)], dtype=object)


def redacted(docs: DataFrame, **parameters: float) -> DataFrame:
    """docs with every span replaced by its kind in square brackets, in the columns of docs; n_chars, if there, follows the text.

    Overlapping spans count as one, named by the first. Rows without spans, null and empty texts stay as they
    are; rows with one doc_id, null or not, are each treated by their own text; no row goes.
    """
    found = personal_data(docs, **parameters).filter("size(all_spans) > 0").groupBy("doc_id", "th").agg(F.first("all_spans").alias("all_spans"))
    id_, hash_, spans, text = fresh(docs, "id", "hash", "spans", "covered")
    own = docs.withColumns({id_: F.col("doc_id").cast("long"), hash_: F.xxhash64(F.coalesce("text", F.lit("")))})
    known = found.select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"), F.col("all_spans").alias(spans)).alias("k")
    joined = own.join(known, F.col(id_).eqNullSafe(F.col("k.k_id")) & (F.col(hash_) == F.col("k.k_th")), "left")
    covered = F.pandas_udf(cover, "string")
    out = joined.withColumn(text, F.when(F.col(spans).isNotNull(), covered(own["text"], F.col(spans))).otherwise(own["text"]))
    return out.select(*(F.col(text).alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else own["`" + c + "`"].alias(c) for c in docs.columns))
