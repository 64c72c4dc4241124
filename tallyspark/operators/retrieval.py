"""Retrieval: BM25, vector search, rank fusion, reranking. Rankings are total orders: score, then chunk_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import rules
from tallyspark.functions.text import contains_any, phrase_weight, searchable, tokens
from tallyspark.sources.staging import kept


#: Query terms up to which a scan is told them, so that it counts no other tokens.
SCANNED_TERMS = 10_000
#: Query terms up to which they are sent to every task: a few MB.
BROADCAST_TERMS = 100_000
#: Pairs of a query and a chunk that a task scores and sorts: up to about 500 MB.
SCORED_PAIRS = 1 << 19


def filtered(chunks: DataFrame, fiscal_years: list[int] | None = None, filing_types: list[str] | None = None) -> DataFrame:
    """Chunks of the given years and forms; no filter where a list is missing or empty."""
    if fiscal_years:
        chunks = chunks.filter(F.col("fiscal_year").isin(fiscal_years))
    return chunks.filter(F.col("filing_type").isin(filing_types)) if filing_types else chunks


def post_filtered(results: DataFrame, fiscal_years: list[int] | None = None, sections: list[str] | None = None) -> DataFrame:
    """Filter a ranked list: the year in the list, and any section a part of the section's name."""
    if fiscal_years:
        results = results.filter(F.col("fiscal_year").isin(fiscal_years))
    return results.filter(contains_any(F.lower("section_name"), [s.lower() for s in sections])) if sections else results


def document_terms(chunks: DataFrame) -> DataFrame:
    """chunk_id, terms (all tokens in order), length."""
    return chunks.select("chunk_id", tokens(searchable(F.col("section_name"), F.col("section_type"), F.col("text"))).alias("terms")).withColumn("length", F.size("terms"))


def term_counts(terms: Column) -> Column:
    """(term, tf) of an array of tokens, counted in the row by sorting."""
    ordered = F.sort_array(terms)

    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (s[i] != s[F.greatest(i - 1, F.lit(0))]))
        return F.transform(F.array(starts), lambda at: F.transform(at, lambda i, j: F.struct(s[i].alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).alias("tf"))))[0]

    return F.when(F.size(terms) > 0, F.transform(F.array(ordered), counted)[0])


def bm25(chunks: DataFrame, queries: DataFrame, top_n: int, k1: float = rules.BM25_K1, b: float = rules.BM25_B) -> DataFrame:
    """query_id, chunk_id, score, rank: the top_n chunks of positive score for each query.

    Statistics are those of chunks as given, so filter before for statistics of the filtered corpus. A query's repeated term counts
    as often. The texts are read and cut into tokens once: a row's counts of the queries' terms and its length are worked out in the
    row and kept, and statistics and scores come from what is kept. Up to SCANNED_TERMS terms are named to the scan; with more,
    all of a row's tokens are counted and kept, and those of some query are picked out by a join.
    Counts are dealt by chunk_id, to as many tasks as leave each at most about SCORED_PAIRS pairs. The queries' weights are sent there (up to
    BROADCAST_TERMS of them), so pairs of a query and a chunk are made, summed and cut to the top_n of each query without a shuffle of their own.
    Rows of equal chunk_id and length are one chunk in the counts of terms.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = asked.select("term").distinct()
    named = [r["term"] for r in terms.limit(SCANNED_TERMS + 1).collect()]
    few = len(named) <= SCANNED_TERMS
    wanted = F.filter("terms", lambda t: t.isin(named)) if few else F.col("terms")
    docs = document_terms(chunks).select("chunk_id", "length", wanted.alias("wanted"))
    docs = kept(docs.select("chunk_id", "length", term_counts(F.col("wanted")).alias("counts")), "counts")
    corpus = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean")).first()
    n, mean = corpus["n"], max(corpus["mean"], 1.0)
    size = asked.agg(F.count(F.lit(1)).alias("terms"), F.count_distinct("query_id").alias("queries")).first()
    tasks = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-n * size["queries"] // SCORED_PAIRS))
    postings = docs.select("chunk_id", "length", F.inline("counts"))
    if not few:
        postings = postings.join(F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms, "term", "left_semi")
    postings = postings.repartition(tasks, "chunk_id")
    tf = postings.groupBy("chunk_id", "length", "term").agg(F.sum("tf").alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = kept(asked.join(df, "term").select("query_id", "term", (F.col("times") * idf).alias("weight")), "weights")
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    parts = tf.select("chunk_id", "term", part.alias("part")).join(F.broadcast(weighed) if size["terms"] <= BROADCAST_TERMS else weighed, "term")
    scored = parts.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("part")), 9).alias("score"))
    return top(scored.filter("score > 0"), top_n)


def top(scored: DataFrame, top_n: int, score: str = "score", rank: str = "rank") -> DataFrame:
    """The top_n rows of each query with their rank from 1; ties go to the smaller chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return scored.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= top_n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_search(vectors: DataFrame, queries: dict[int, list[float]], top_n: int) -> DataFrame:
    """query_id, chunk_id, score, rank by inner product with a few given query vectors; one pass over vectors."""
    asked = F.array(*(F.struct(F.lit(i).cast("long").alias("query_id"), F.array(*map(F.lit, map(float, q))).alias("q")) for i, q in queries.items()))
    scored = vectors.select("chunk_id", "embedding", F.explode(asked).alias("asked")).select(F.col("asked.query_id"), "chunk_id", F.round(dot(F.col("embedding"), F.col("asked.q")), 6).alias("score"))
    return top(scored, top_n)


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = rules.RRF_K) -> DataFrame:
    """query_id, chunk_id, rrf_score, rank_1, score_1, rank_2, ... , fused_rank over any number of ranked lists.

    A list's missing or zero rank or score counts as missing. One shuffle over the union of the lists.
    """
    union = None
    for i, one in enumerate(lists):
        part = one.select("query_id", "chunk_id", F.lit(i).alias("list"), F.col("rank").cast("long").alias("rank"), F.col("score").cast("double").alias("score"))
        union = part if union is None else union.unionByName(part)
    found = [F.max(F.when(F.col("list") == i, F.nullif(c, F.lit(0)))).alias(f"{c}_{i + 1}") for i in range(len(lists)) for c in ("rank", "score")]
    fused = union.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf_score"), *found)
    return top(fused, 2**31 - 1, "rrf_score", "fused_rank")


def rerank(candidates: DataFrame, top_k: int) -> DataFrame:
    """Add raw_score, reranker_score (logistic) and rerank; the top_k of each query.

    candidates: query_id, chunk_id, section_name, section_type, text, cosine, rrf_score. The raw score is the
    cosine plus the weights of section, title phrases and content phrases and a bounded fusion share.
    """
    section = F.lit(0.0)
    for name, weight in rules.SECTION_WEIGHTS.items():
        section = F.when(F.col("section_type") == name, F.lit(weight)).otherwise(section)
    raw = F.coalesce("cosine", F.lit(0.0)) + section + phrase_weight(F.lower("section_name"), rules.TITLE_WEIGHTS) + phrase_weight(F.lower("text"), rules.CONTENT_WEIGHTS) + F.least(F.col("rrf_score") * 2, F.lit(0.06))
    ranked = top(candidates.withColumn("raw_score", F.round(raw, 6)), top_k, "raw_score", "rerank")
    return ranked.withColumn("reranker_score", F.round(1 / (1 + F.exp(-F.col("raw_score"))), 6))


def evidence_categories(section_type: Column, text: Column) -> Column:
    """Sorted distinct categories of a chunk."""
    low = F.lower(text)
    flags = F.array(section_type, F.when(contains_any(low, rules.NUMERIC_MARKS), "numeric_facts"), F.when(contains_any(low, rules.EXPLANATION_MARKS), "management_explanation"))
    return F.sort_array(F.array_distinct(F.filter(flags, lambda x: x.isNotNull())))


def deduplicated(evidence: DataFrame) -> DataFrame:
    """The best row of each chunk over several passes (highest score, then earliest pass), best first by position."""
    best = Window.partitionBy("chunk_id").orderBy(F.desc("reranker_score"), "pass")
    return evidence.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def memory_section_boosts(sections: Column) -> Column:
    """(section, weight) entries that a topic's memory suggests, for the sections it found useful."""
    weights = {"liquidity": 1.5, "debt": 1.5, "commitment": 1.3, "management": 1.2}
    return F.filter(F.flatten(F.transform(sections, lambda s: F.array(*(F.when(F.lower(s).contains(k), F.struct(s.alias("section"), F.lit(w).alias("weight"))) for k, w in weights.items())))), lambda e: e.isNotNull())
