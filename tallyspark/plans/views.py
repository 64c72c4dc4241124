"""Stand-in views of the driver tables: documents as chunks, orders as annual facts, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import index
from tallyspark.sources.readers import load
from tallyspark.sources.staging import fresh_path

QUERY_TEXTS = {1: "the of the and to", 2: "licensed under the license", 3: "der die und das", 4: "que los las del token"}
QUERY_VECTORS = [0, 7, 13]
OLD_YEAR, NEW_YEAR = 1996, 2000


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("section_type"), F.col("source").alias("section_name"), F.when(F.col("doc_id") % 2 == 0, 2023).otherwise(2025).alias("fiscal_year"), F.lit("10-K").alias("filing_type"), "text")


#: Indexes of this application by the folder of their tables, which do not change.
KEPT: dict[tuple[str, str], index.Index] = {}


def kept_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of all chunks, built by the first query that searches and reused by the others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in KEPT:
        KEPT[key] = index.build(chunks(spark, sf_dir), fresh_path(spark, "bm25"))
    return KEPT[key]


def search_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUERY_TEXTS.items()), "query_id long, query string")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> dict[int, list[float]]:
    """The vectors of a few fixed ids: at most as many rows as QUERY_VECTORS."""
    rows = load(spark, sf_dir, "embeddings").filter(F.col("vec_id").isin(QUERY_VECTORS)).select("vec_id", "embedding").collect()
    return {QUERY_VECTORS.index(r["vec_id"]) + 1: r["embedding"] for r in rows}


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filed facts: the entity is the nation, the metric the priority, the form the status."""
    o, c, n = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.select(
        F.col("n_name").alias("entity"),
        F.col("o_orderpriority").alias("metric"),
        F.year("o_orderdate").alias("fiscal_year"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderdate").alias("filed"),
        F.col("o_orderdate").alias("end"),
        F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-K/A").otherwise("10-Q").alias("form"),
        F.when(F.col("o_orderkey") % 3 == 0, "FY").otherwise("Q4").alias("fp"),
        F.when(F.col("o_orderkey") % 5 == 0, "high").when(F.col("o_orderkey") % 5 == 1, "low").otherwise("medium").alias("confidence"),
        F.when(F.col("o_orderkey") % 2 == 0, "xbrl").otherwise("text").alias("fact_source"),
        (F.col("o_orderkey") % 7 == 0).alias("review_required"),
        F.col("o_orderkey").alias("pos"),
    )


def annual_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("entity", "metric", "fiscal_year").agg(F.round(F.sum("value"), 2).alias("value"))
