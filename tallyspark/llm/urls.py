"""URL filters: fixed host and path rules, then a path-template tree (operator 8, DataFrame functions only)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import salted_join, stage

#: Verdict, host, path of the base rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path; both are empty for a null url or one without ://."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract("rest", r"^[^/?#]*", 0)
    parted = pages.select(F.col("page_id").cast("long").alias("page_id"), rest.alias("rest")).withColumn("raw", raw)
    after = F.col("rest").substr(F.length("raw") + 1, F.length("rest"))
    return parted.select("page_id", F.translate("raw", string.ascii_uppercase, string.ascii_lowercase).alias("host"), F.regexp_extract(after, r"^[^?#]*", 0).alias("path"))


def rule_of(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls. rules is a short fixed list."""
    rule = verdict = None
    for says, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = (F.when if rule is None else rule.when)(fits, host + path)
        verdict = (F.when if verdict is None else verdict.when)(fits, says)
    return rule, verdict


def typed_segments(path: Column) -> Column:
    """Segments below the root with runs of digits as {n} and long hexadecimal runs as {h}."""
    general = F.regexp_replace(F.regexp_replace(path, r"(?<![A-Za-z0-9])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}(?![A-Za-z0-9])", "{h}"), r"[0-9]+", "{n}")
    return F.split(F.regexp_replace(general, r"^/", ""), "/")


def pooled_runs(siblings: Column, z_limit: float, weight: float, prior: float) -> Column:
    """Arrays of names from an array of (share, name, n, bad) sorted by share: runs of branches that hardly differ.

    A branch joins the run before it while a two-proportion test cannot tell it from the pooled share of the whole
    run; so the ends of a run do not drift apart.
    """

    def smoothed(x: Column) -> Column:
        return (x["bad"] + weight * prior) / (x["n"] + weight)

    def step(runs: Column, x: Column) -> Column:
        last = F.element_at(runs, -1)
        a, b = last["n"] + weight, x["n"] + weight
        pooled = (smoothed(last) * a + smoothed(x) * b) / (a + b)
        z = F.abs(smoothed(last) - smoothed(x)) / F.sqrt(pooled * (1 - pooled) * (1 / a + 1 / b) + F.lit(1e-12))
        alone = F.struct(F.array(x["name"]).alias("names"), x["n"].alias("n"), x["bad"].alias("bad"))
        joined = F.struct(F.concat(last["names"], F.array(x["name"])).alias("names"), (last["n"] + x["n"]).alias("n"), (last["bad"] + x["bad"]).alias("bad"))
        return F.when((F.size(runs) > 0) & (z <= z_limit), F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(runs, F.array(alone)))

    none = F.array().cast("array<struct<names:array<string>,n:bigint,bad:bigint>>")
    return F.transform(F.aggregate(siblings, none, lambda runs, x: F.when(F.size(runs) == 0, F.array(F.struct(F.array(x["name"]).alias("names"), x["n"].alias("n"), x["bad"].alias("bad")))).otherwise(step(runs, x))), lambda r: r["names"])


def template_tree(shapes: DataFrame, max_children: int, rare: float, z_limit: float, weight: float, prior: float) -> DataFrame:
    """Give each (host, segments) its template, from the root on until no node has two shapes.

    All shapes of a node first follow the segments that they share. At a node with more than
    max_children branches, those with less than the share rare of its pages become
    one wildcard. Then siblings with the same numbers of segments below, sorted by smoothed bad share, are merged
    in runs, see pooled_runs. A node keeps at most max_children + 1 / rare branches, so its arrays of
    siblings are small, even for a host of any size. What is alone in its node keeps its segments.
    """
    t = shapes.withColumns({"template": F.lit(""), "rest": F.col("segments")})
    done = None
    while True:
        nodes = t.groupBy("host", "template").agg(F.count(F.lit(1)).alias("shapes"), F.min("rest").alias("least"), F.max("rest").alias("most"))
        differs = F.array_position(F.zip_with(F.slice("least", 1, F.least(F.size("least"), F.size("most"))), F.slice("most", 1, F.least(F.size("least"), F.size("most"))), lambda a, b: a != b), True)
        shared = F.when(differs > 0, differs - 1).otherwise(F.least(F.size("least"), F.size("most"))).cast("int")  # what least and most share, all share
        ahead = t.join(nodes.select("host", "template", "shapes", shared.alias("shared")), ["host", "template"])
        step = F.when(F.col("shapes") == 1, F.size("rest")).otherwise(F.col("shared"))
        followed = F.when(step > 0, F.concat("template", F.lit("/"), F.array_join(F.slice("rest", 1, step), "/"))).otherwise(F.col("template"))
        left = F.slice("rest", step + 1, F.size("rest"))
        t = stage(ahead.select(*shapes.columns, followed.alias("template"), left.alias("rest")), "urltree")
        ended = t.filter("size(rest) = 0").drop("rest")
        done = ended if done is None else done.union(ended)
        t = t.filter("size(rest) > 0").withColumn("seg", F.get("rest", F.lit(0)))
        if t.isEmpty():
            return stage(done, "urltree")
        branches = t.groupBy("host", "template", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "n_labelled", "n_bad")), F.sort_array(F.collect_set(F.size("rest"))).alias("below"))
        nodes = branches.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("pages"))
        general = branches.join(nodes, ["host", "template"]).withColumn("name", F.when((F.col("children") > max_children) & (F.col("n") < F.col("pages") * rare), F.lit("*")).otherwise(F.col("seg")))
        kept = general.groupBy("host", "template", "name").agg(F.sum("n_labelled").alias("n"), F.sum("n_bad").alias("bad"), F.array_join(F.array_distinct(F.sort_array(F.flatten(F.collect_set("below")))), ",").alias("below"))
        share = (F.col("bad") + weight * prior) / (F.col("n") + weight)
        siblings = kept.groupBy("host", "template", "below").agg(F.sort_array(F.collect_list(F.struct(share.alias("share"), "name", "n", "bad"))).alias("siblings"))
        merged = siblings.select("host", "template", F.explode(pooled_runs(F.col("siblings"), z_limit, weight, prior)).alias("names"))
        names = merged.select("host", "template", F.explode("names").alias("name"), F.array_join(F.sort_array("names"), "|").alias("branch"))
        renamed = general.select("host", "template", "seg", "name").join(names, ["host", "template", "name"]).select("host", "template", "seg", "branch")
        below = salted_join(t, renamed, ["host", "template", "seg"])
        t = stage(below.select(*shapes.columns, F.concat("template", F.lit("/"), "branch").alias("template"), F.slice("rest", 2, F.size("rest")).alias("rest")), "urltree")
        ended = t.filter("size(rest) = 0").drop("rest")
        done = done.union(ended)
        t = t.filter("size(rest) > 0")


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES, max_children: int = 20, rare: float = 0.05, z_limit: float = 1.0, weight: float = 5.0, max_bad: float = 0.5) -> DataFrame:
    """Judge each page: page_id, host, path, rule, template, bad_share, verdict.

    pages: page_id, url. labelled: doc_id and bad (0 or 1); a page carries the label of the document that
    the last number in its path names. A rule decides where one fits. Elsewhere a page is blocked if its
    host's template has a smoothed bad share over max_bad: (bad + weight * prior) / (labelled + weight),
    prior being the bad share of all labelled pages (0 without labels). Null urls have an empty host and
    path and are judged like any other host; several labels of a document count as the worst. A number too
    great for a long names no document. Paths of any length and depth are read whole; repeated rows and null
    page_ids are each judged; no pages give no rows; other columns are ignored.
    """
    number = F.regexp_extract("path", r"([0-9]+)[^0-9/]*/?$", 1)
    parted = with_parts(pages).withColumns({"segments": typed_segments(F.col("path")), "number": number.try_cast("long")})
    parted = stage(parted.withColumn("shape", F.array_join("segments", "/")), "urls")
    bad = labelled.groupBy(F.col("doc_id").cast("long").alias("number")).agg(F.max("bad").alias("bad"))
    numbers = parted.groupBy("host", "shape", "segments", "number").agg(F.count(F.lit(1)).alias("n"))
    marked = numbers.join(bad, "number", "left")
    shapes = stage(
        marked.groupBy("host", "shape", "segments").agg(
            F.sum("n").alias("n"), F.sum(F.when(F.col("bad").isNotNull(), F.col("n")).otherwise(0)).alias("n_labelled"), F.sum(F.when(F.col("bad") == 1, F.col("n")).otherwise(0)).alias("n_bad")
        ),
        "urls",
    )
    sums = shapes.agg(F.sum("n_labelled").alias("n"), F.sum("n_bad").alias("bad")).first()
    prior = float(sums["bad"] / sums["n"]) if sums["n"] else 0.0
    tree = template_tree(shapes, max_children, rare, z_limit, weight, prior)
    judged = tree.groupBy("host", "template").agg(F.sum("n_labelled").alias("n"), F.sum("n_bad").alias("bad")).withColumn("bad_share", (F.col("bad") + weight * prior) / (F.col("n") + weight))
    by_shape = tree.select("host", "shape", "template").join(judged.select("host", "template", "bad_share"), ["host", "template"])
    rule, verdict = rule_of(rules)
    out = salted_join(parted, by_shape, ["host", "shape"]).withColumns({"rule": rule, "rule_verdict": verdict})
    method = F.when(F.col("bad_share") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", "template", "bad_share", F.coalesce("rule_verdict", method).alias("verdict"))
