"""The bounded research loop: retrieve, rerank, gather evidence, check coverage, rewrite the query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import evidence, retrieval
from tallyspark.sources.staging import kept


def retrieval_sizes(iteration: int, narrow_first: bool = False, query: str = "") -> tuple[int, int]:
    """(candidates, evidence) of an iteration: 40 and 12, or 8 and 3 for a narrow first pass, 8 and 12 if its query is strong."""
    if not (narrow_first and iteration == 1):
        return 40, 12
    strong = len(query) > 80 and all(w in query.lower() for w in ("debt", "liquidity"))
    return (8, 12) if strong else (8, 3)


def research(chunks: DataFrame, query: str, company: str, years: list[int], max_iterations: int = 3) -> tuple[DataFrame, DataFrame]:
    """(evidence, coverage) for one question over a chunk table with section types.

    Every pass runs on the cluster; the driver sees one row of coverage a pass and decides whether to go on. A pass reads the texts twice, to count
    terms and to fetch those of its candidates, which are a bounded list and go to the tasks; its evidence is kept, so that no later pass works it out again.
    """
    spark = chunks.sparkSession
    gathered, covered = None, None
    for iteration in range(1, max_iterations + 1):
        candidates, keep = retrieval_sizes(iteration)
        found = retrieval.bm25(chunks, spark.createDataFrame([(1, query)], "query_id long, query string"), candidates)
        fused = chunks.join(F.broadcast(retrieval.reciprocal_rank_fusion([found])), "chunk_id").withColumn("cosine", F.lit(0.0))
        ranked = retrieval.rerank(fused, keep).withColumn("pass", F.lit(iteration)).withColumn("evidence_category", retrieval.evidence_categories(F.col("section_type"), F.col("text")))
        ranked = kept(ranked.select("query_id", "chunk_id", "fiscal_year", "section_type", "text", "evidence_category", "reranker_score", "pass"), "evidence")
        gathered = ranked if gathered is None else retrieval.deduplicated(gathered.unionByName(ranked))
        covered = evidence.coverage(gathered, years, iteration, max_iterations)
        row = evidence.rewritten(covered, company, years).first()
        if row is None:
            break
        query = row["query"]
    return gathered, covered
