"""A kept inverted index for BM25: built in one pass, reused by every search, with bounds that let searches skip blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import rules
from tallyspark.functions.text import tokens
from tallyspark.operators.retrieval import BROADCAST_TERMS, document_terms, term_counts, top

#: Chunks of a block: all postings of a term in a block are one row.
BLOCK_CHUNKS = 256
#: Query terms up to which the scan of the index is told them, so that it skips row groups.
PUSHED_TERMS = 1000
#: The term under which each block counts its chunks and their tokens.
ALL = ""


@dataclass(frozen=True)
class Index:
    """Below path: postings (term, block, chunk_id, tf, length; head on the first of a term and block) and heads (term, block, n, n_tokens, max_tf, min_length), sorted by term."""

    spark: SparkSession
    path: str
    n: int
    mean: float

    def heads(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/heads")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings").drop("head")


def build(chunks: DataFrame, path: str, block_chunks: int = BLOCK_CHUNKS) -> Index:
    """Write the index of chunks (chunk_id, section_name, section_type, text) below path.

    Tokens are counted in the row, so one shuffle deals the postings, and the first posting of a term in a block carries the block's head,
    so that heads are read off the written postings without another shuffle; a block is a bounded set of chunks by hash, so a frequent
    term is spread over all blocks. Files are sorted by term, so that searches read the row groups of their terms.
    Null texts have no tokens and count as chunks; rows with equal chunk_id are chunks of their own in the counts.
    """
    blocks = max(1, -(-chunks.count() // block_chunks))
    docs = document_terms(chunks)
    every = F.array(F.struct(F.lit(ALL).alias("term"), F.lit(0).alias("tf")))
    counts = F.concat(every, F.coalesce(term_counts(F.col("terms")), F.array().cast("array<struct<term:string,tf:int>>")))
    rows = docs.select(F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int").alias("block"), "chunk_id", "length", F.inline(counts))
    dealt = rows.repartition("term", "block").sortWithinPartitions("term", "block", "chunk_id")
    group = Window.partitionBy("term", "block")
    head = F.struct(F.count(F.lit(1)).over(group).alias("n"), F.sum("length").over(group).alias("n_tokens"), F.max("tf").over(group).alias("max_tf"), F.min("length").over(group).alias("min_length"))
    first = F.row_number().over(group.orderBy("chunk_id")) == 1
    dealt.select("term", "block", "chunk_id", "tf", "length", F.when(first, head).alias("head")).write.mode("overwrite").parquet(f"{path}/postings")
    written = chunks.sparkSession.read.parquet(f"{path}/postings")
    written.filter("head IS NOT NULL").select("term", "block", "head.*").write.mode("overwrite").parquet(f"{path}/heads")
    return opened(chunks.sparkSession, path)


def opened(spark: SparkSession, path: str) -> Index:
    """An index that build() wrote."""
    total = spark.read.parquet(f"{path}/heads").filter(F.col("term") == ALL).agg(F.sum("n").alias("n"), F.sum("n_tokens").alias("t")).first()
    n = total["n"] or 0
    return Index(spark, path, n, max((total["t"] or 0) / n if n else 0.0, 1.0))


def search(index: Index, queries: DataFrame, top_n: int, k1: float = rules.BM25_K1, b: float = rules.BM25_B, seeds: int = 2) -> DataFrame:
    """query_id, chunk_id, score, rank: the top_n chunks of positive score for each query (query_id, query).

    A block's bound for a query adds, over the query's terms, what the block's largest count and shortest chunk could score.
    The blocks with the highest bounds are scored first; only blocks whose bound reaches the top_n-th score found there are
    scored after them, so the result is exact. Bounds are read without the postings. Pairs of a query and a chunk of an open block are shuffled: for a few queries
    that is little; many long ones, which leave most blocks open, are better asked by retrieval.bm25.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = asked.select("term").distinct()
    named = [r["term"] for r in terms.limit(PUSHED_TERMS + 1).collect()]
    few = terms.count() <= BROADCAST_TERMS if len(named) > PUSHED_TERMS else True

    def of_terms(rows: DataFrame) -> DataFrame:
        if len(named) <= PUSHED_TERMS:
            return rows.filter(F.col("term").isin(named))
        return rows.join(F.broadcast(terms) if few else terms, "term", "left_semi")

    held = of_terms(index.heads())
    df = held.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").select("query_id", "term", (F.col("times") * idf).alias("weight"))

    def part(tf: Column, length: Column) -> Column:
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / index.mean))

    bounds = held.select("term", "block", "n", part(F.col("max_tf"), F.col("min_length")).alias("most")).join(weighed, "term").groupBy("query_id", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"), F.max("n").alias("n"))

    def scored(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select("query_id", "block").join(weighed, "query_id")
        rows = of_terms(index.postings()).join(wanted, ["term", "block"])
        return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") * part(F.col("tf"), F.col("length"))), 9).alias("score")).filter("score > 0")

    ranked = top(bounds.withColumnRenamed("block", "chunk_id"), seeds, "bound").withColumnRenamed("chunk_id", "block")
    found = top(scored(ranked), top_n).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("k"))
    floor = found.select("query_id", F.when(F.col("k") >= top_n, F.col("least")).otherwise(F.lit(0.0)).alias("floor"))
    open_ = bounds.join(floor, "query_id", "left").filter(F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - 1e-6)
    return top(scored(open_), top_n)
